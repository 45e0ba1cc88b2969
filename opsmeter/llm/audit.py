"""How text filters interact: a sparse document-term matrix decides two, all orders are weighed."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from itertools import permutations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from opsmeter.llm.common import _LETTERS, _tables, configure, mix, new_folder, pieces_of, scratch, stored, text_buffer, utf8

# bytes of text that make one shard of the matrix; a longer text is a shard of its own
SHARD_BYTES = 8 << 20
PIECE_BYTES = 1 << 20
# parts of the dictionary: at least so many, and one for so many words of shards
DICTIONARY_PARTS = 256
PART_WORDS = 500_000

_BLANK = np.zeros(256, bool)
_BLANK[[9, 10, 11, 12, 13, 32]] = True
# The characters that condition D looks for.
_ODD = np.zeros(256, bool)
_ODD[list(b"#$%&*|")] = True

# The five conditions, by bit.
FILTERS = "ABCDE"

# what a shard knows of its rows besides the matrix
ROWS = """ids array<bigint>, parts array<string>, digests array<binary>, points array<bigint>,
    capitals array<bigint>, odd array<boolean>"""
LOCAL = f"shard bigint, {ROWS}, starts binary, columns binary, counts binary, n_words bigint, words binary"
MATRIX = f"shard bigint, {ROWS}, starts array<int>, columns array<bigint>, counts array<int>"
_ROW_NAMES = ["ids", "parts", "digests", "points", "capitals", "odd"]


def _squeezed(raw: bytes) -> bytes:
    return len(raw).to_bytes(8, "little") + pa.compress(raw, "zstd", asbytes=True)


def _whole(data: bytes) -> bytes:
    return pa.decompress(data[8:], int.from_bytes(data[:8], "little"), "zstd", asbytes=True)


def _packed(values: np.ndarray) -> bytes:
    """32-bit numbers as compressed differences, equal bytes side by side: rising ones get small."""
    steps = np.diff(values.astype("<i4"), prepend=np.int32(0)).astype("<i4")
    return _squeezed(steps.view(np.uint8).reshape(-1, 4).T.tobytes())


def _unpacked(data: bytes) -> np.ndarray:
    raw = np.frombuffer(_whole(data), np.uint8)
    steps = np.ascontiguousarray(raw.reshape(4, -1).T).view("<i4").ravel()
    return np.cumsum(steps, dtype=np.int32)


def _lists(arrays: list[pa.Array]) -> pa.Array:
    """One list per array."""
    offsets = np.concatenate(([0], np.cumsum([len(a) for a in arrays]))).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.concat_arrays(arrays))


def _per_text(found: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """How often ``found`` holds within each text's bytes."""
    return np.diff(np.searchsorted(np.flatnonzero(found), offsets))


def _split(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The words' bytes one after another, their lengths, and how many each text has."""
    n = len(raw)
    letter = ~_BLANK[raw]
    edge = np.zeros(n + 1, bool)
    edge[offsets] = True
    begins = letter & edge[:n]
    begins[1:] |= letter[1:] & ~letter[:-1]
    ends = letter & edge[1:]
    ends[:-1] |= letter[:-1] & ~letter[1:]
    begins = np.flatnonzero(begins)
    return raw[letter], np.flatnonzero(ends) + 1 - begins, np.diff(np.searchsorted(begins, offsets))


def _strings(raw: np.ndarray, lengths: np.ndarray) -> pa.Array:
    bounds = np.concatenate(([0], np.cumsum(lengths, dtype=np.int64)))
    return pa.LargeStringArray.from_buffers(len(lengths), pa.py_buffer(bounds), pa.py_buffer(raw))


def word_hashes(words: pa.Array) -> np.ndarray:
    """A 64-bit hash of each string's bytes."""
    out = [np.zeros(0, np.uint64)]
    for start, stop in pieces_of(words, PIECE_BYTES):
        raw, offsets = text_buffer(words.slice(start, stop - start))
        powers, inverses = _tables(len(raw) + 1)
        total = np.concatenate((np.zeros(1, np.uint64), np.cumsum(_LETTERS[raw] * powers[: len(raw)])))
        sums = (total[offsets[1:]] - total[offsets[:-1]]) * inverses[offsets[:-1]]
        out.append(mix(sums + np.diff(offsets).astype(np.uint64)))
    return np.concatenate(out)


def word_order(words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The order of distinct words by hash, then by their bytes, and the hashes in that order."""
    hashes = word_hashes(words)
    order = np.argsort(hashes, kind="stable")
    hashes = hashes[order]
    for first in np.flatnonzero((hashes[1:] == hashes[:-1]) & np.append(True, hashes[1:-1] != hashes[:-2])):
        last = first + int(np.searchsorted(hashes[first:], hashes[first], "right"))
        order[first:last] = sorted(order[first:last], key=lambda i: words[int(i)].as_py().encode())
    return order, hashes


def term_counts(words: pa.Array, per_text: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, pa.Array]:
    """A matrix in compressed rows: row starts, columns, counts, and the words of the columns.

    ``words`` are those of all texts one after another, ``per_text`` says how many are whose.
    Words are compared as they are. Columns follow ``word_order`` and rise within a row.
    """
    coded = words.dictionary_encode()
    order, _ = word_order(coded.dictionary)
    place = np.empty(len(order), np.int64)
    place[order] = np.arange(len(order))
    owners = np.repeat(np.arange(len(per_text), dtype=np.int64), per_text)
    cells = np.sort((owners << 32) | place[coded.indices.to_numpy()])
    new = np.flatnonzero(np.concatenate(([True], cells[1:] != cells[:-1]))) if len(cells) else cells
    counts = np.diff(np.append(new, len(cells)))
    cells = cells[new]
    starts = np.searchsorted(cells, np.arange(len(per_text) + 1, dtype=np.int64) << 32)
    return starts, cells & 0xFFFFFFFF, counts, coded.dictionary.take(pa.array(order))


class _Shard:
    """Rows gathered for one shard: their words' bytes and what is counted of their texts."""

    def __init__(self, name: int):
        self.name, self.size = name, 0
        self.rows: list[list[pa.Array]] = []
        self.words: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

    def add(self, batch: pa.RecordBatch) -> None:
        raw, offsets = text_buffer(batch.column("text"))
        facts = [
            # a code point starts at every byte that continues none
            np.diff(offsets) - _per_text((raw & 0xC0) == 0x80, offsets),
            _per_text((raw >= 65) & (raw <= 90), offsets),
            _per_text(_ODD[raw], offsets) > 0,
        ]
        self.rows.append([batch.column(x) for x in ("doc_id", "part", "digest")] + [pa.array(x) for x in facts])
        self.words.append(_split(raw, offsets))
        self.size += len(raw)

    def matrix(self) -> pa.RecordBatch:
        raw, lengths, per_text = (np.concatenate(x) for x in zip(*self.words, strict=True))
        starts, columns, counts, words = term_counts(_strings(raw, lengths), per_text)
        text = " ".join(words.to_pylist()).encode()
        facts = [_lists([pa.concat_arrays(x)]) for x in ([list(y) for y in zip(*self.rows, strict=True)])]
        numbers = [pa.array([_packed(x)], pa.binary()) for x in (starts, columns, counts)]
        return pa.RecordBatch.from_arrays(
            [
                pa.array([self.name], pa.int64()), *facts, *numbers,
                pa.array([len(words)], pa.int64()), pa.array([_squeezed(text)], pa.binary()),
            ],
            ["shard", *_ROW_NAMES, "starts", "columns", "counts", "n_words", "words"],
        )


def local_shards(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", part: str = "source"
) -> DataFrame:
    """Shards of consecutive rows as ``LOCAL``: their matrix over the shard's own words; stored.

    The words are one text, in the order of their columns; the numbers are compressed.
    """
    configure(docs.sparkSession)
    rows = docs.selectExpr(
        f"cast(`{doc_id}` AS BIGINT) AS doc_id",
        f"coalesce(cast(`{part}` AS STRING), '') AS part",
        f"unhex(sha2(cast({utf8(text)} AS BINARY), 256)) AS digest",
        f"{utf8(text)} AS text",
        "monotonically_increasing_id() AS place",
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard = None
        for batch in batches:
            _, offsets = text_buffer(batch.column("text"))
            for start, stop in pieces_of(batch.column("text"), PIECE_BYTES):
                if shard and shard.size + int(offsets[stop] - offsets[start]) > SHARD_BYTES:
                    yield shard.matrix()
                    shard = None
                # the number of the first row names the shard
                shard = shard or _Shard(batch.column("place")[start].as_py())
                shard.add(batch.slice(start, stop - start))
        if shard:
            yield shard.matrix()

    spark = docs.sparkSession
    path = new_folder(spark, "term-shards")
    # shards are large rows: look at the size of what is buffered after each of them
    rows.mapInArrow(run, LOCAL).write.option("compression", "zstd").option(
        "parquet.block.size.row.check.min", "1"
    ).option("parquet.block.size.row.check.max", "1").parquet(path)
    return spark.read.schema(LOCAL).parquet(path)


def _read_words(data: bytes) -> pa.Array:
    raw = np.frombuffer(_whole(data), np.uint8)
    letters, lengths, _ = _split(raw, np.array([0, len(raw)]))
    return _strings(letters, lengths)


def terms(shards: DataFrame) -> DataFrame:
    """``shard, first, before, ranks``: numbers of the shards' words in a dictionary of all; stored.

    The term of a shard's word ``first + i`` is ``before + ranks[i]``; equal words have equal
    terms in all shards, from 0 without gaps, in ``word_order``. Every shard has a word once,
    however often its texts do. Ranges of the words' hashes make the dictionary's parts, whose
    number follows the words; a shard's words of one part lie side by side and move as
    one row. A word's rank in its part, after the words of earlier parts, is its term.
    """
    total = shards.selectExpr("sum(n_words) AS n").first()["n"] or 0
    parts = np.uint64(max(DICTIONARY_PARTS, -(-total // PART_WORDS)))

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for shard, data in zip(*(batch.column(i).to_pylist() for i in range(2)), strict=True):
                words = _read_words(data)
                if not len(words):
                    continue
                _, hashes = word_order(words)  # they are in that order
                part = ((hashes >> np.uint64(32)) * parts) >> np.uint64(32)
                firsts = np.flatnonzero(np.concatenate(([True], part[1:] != part[:-1])))
                raw = _whole(data)
                _, offsets = text_buffer(words)
                # in the text every word but the first is behind a blank
                begins = (offsets[:-1] + np.arange(len(words))).tolist()
                rows = [
                    (int(part[a]), shard, int(a), _squeezed(raw[begins[a] : begins[b] - 1 if b < len(words) else None]))
                    for a, b in zip(firsts, np.append(firsts[1:], len(words)), strict=True)
                ]
                kinds = [pa.int32(), pa.int64(), pa.int32(), pa.binary()]
                arrays = [pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)]
                yield pa.RecordBatch.from_arrays(arrays, ["part", "shard", "first", "words"])

    def rank(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        lists = [_read_words(x) for x in table["words"].to_pylist()]
        bounds = np.concatenate(([0], np.cumsum([len(x) for x in lists])))
        coded = pa.concat_arrays(lists).dictionary_encode()
        order, _ = word_order(coded.dictionary)
        ranks = np.empty(len(order), np.int64)
        ranks[order] = np.arange(len(order))
        ranks = ranks[coded.indices.to_numpy()]
        packed = [_packed(ranks[a:b]) for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
        return table.select(["part", "shard", "first"]).append_column(
            "ranks", pa.array(packed, pa.binary())
        ).append_column("size", pa.array(np.full(len(table), len(order), np.int64)))

    dealt = shards.select("shard", "words").mapInArrow(deal, "part int, shard bigint, first int, words binary")
    ranked = stored(
        dealt.groupBy("part").applyInArrow(rank, "part int, shard bigint, first int, ranks binary, size bigint"),
        "ranked-words",
    )
    # one row per part: their number follows from the words by a factor of PART_WORDS
    earlier = "ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING"
    sizes = ranked.groupBy("part").agg(F.max("size").alias("size"))
    before = sizes.selectExpr(
        "part AS of_part", f"coalesce(sum(size) OVER (ORDER BY part {earlier}), 0L) AS before"
    )
    return ranked.join(stored(before, "dictionary-parts"), F.expr("part = of_part")).select(
        "shard", "first", "before", "ranks"
    )


def _numbers(table: pa.Table, n: int) -> np.ndarray:
    """The terms of a shard's ``n`` words from its rows of ``terms``."""
    out = np.empty(n, np.int64)
    for first, before, ranks in zip(*(table[x].to_pylist() for x in ("first", "before", "ranks")), strict=True):
        ranks = _unpacked(ranks)
        out[first : first + len(ranks)] = before + ranks.astype(np.int64)
    return out


def dictionary(shards: DataFrame, numbered: DataFrame) -> DataFrame:
    """``word, term`` of every word of the shards, given their ``terms``."""

    def spell(left: pa.Table, right: pa.Table) -> pa.Table:
        words = _read_words(left["words"][0].as_py())
        return pa.table({"word": words.cast(pa.string()), "term": _numbers(right, len(words))})

    listed = shards.select("shard", "words").groupBy("shard").cogroup(numbered.groupBy("shard"))
    return listed.applyInArrow(spell, "word string, term bigint").distinct()


@dataclass
class Rows:
    """A shard of the matrix in a task: row ``i`` has ``counts[starts[i]:starts[i + 1]]`` of ``columns`` there."""

    shard: int
    facts: dict[str, pa.Array]  # of each row: ROWS
    starts: np.ndarray
    columns: np.ndarray
    counts: np.ndarray


def _encoded(shards: DataFrame, numbered: DataFrame, finish: Callable[[Rows], pa.Table], schema: str) -> DataFrame:
    """``finish`` of every shard of the matrix over the dictionary's terms."""

    def encode(left: pa.Table, right: pa.Table) -> pa.Table:
        left = left.combine_chunks()
        term = _numbers(right, left["n_words"][0].as_py())
        starts, columns, counts = (_unpacked(left[x][0].as_py()) for x in ("starts", "columns", "counts"))
        facts = {name: left[name][0].values for name in _ROW_NAMES}
        # words of a shard are in the dictionary's order, so columns rise as before
        return finish(Rows(left["shard"][0].as_py(), facts, starts, term[columns], counts))

    rows = shards.drop("words").groupBy("shard").cogroup(numbered.groupBy("shard"))
    return rows.applyInArrow(encode, schema)


def encoded(shards: DataFrame, numbered: DataFrame) -> DataFrame:
    """``MATRIX`` from ``local_shards`` and their ``terms``."""

    def row(rows: Rows) -> pa.Table:
        arrays = [pa.array([rows.shard]), *[_lists([rows.facts[name]]) for name in _ROW_NAMES]]
        matrix = zip((rows.starts, rows.columns, rows.counts), (pa.int32(), pa.int64(), pa.int32()), strict=True)
        arrays += [_lists([pa.array(x, k)]) for x, k in matrix]
        return pa.Table.from_arrays(arrays, ["shard", *_ROW_NAMES, "starts", "columns", "counts"])

    return _encoded(shards, numbered, row, MATRIX)


def term_matrix(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", part: str = "source"
) -> DataFrame:
    """The document-term matrix over a dictionary of all words, in shards of compressed rows.

    One row per shard (``MATRIX``): row ``i`` has ``counts[starts[i]:starts[i + 1]]`` of the
    terms ``columns[starts[i]:starts[i + 1]]``, which rise. Beside the matrix stand the
    rows' ids, parts, digests and character counts.
    """
    shards = local_shards(docs, doc_id, text, part)
    return encoded(shards, terms(shards))


def failures(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", part: str = "source"
) -> DataFrame:
    """``doc_id, part, digest, mask``: which of the conditions A to D each row fails, by bit.

    Row sums of the matrix are the words, its cells per row the distinct words: A is under 50
    words, B fewer than 65 distinct ones in 100. C is more than 5 capitals A-Z in 100 code
    points, D any of ``#$%&*|``. Each shard is decided where it is encoded.
    """

    def decide(rows: Rows) -> pa.Table:
        starts = rows.starts.astype(np.int64)
        summed = np.concatenate(([0], np.cumsum(rows.counts, dtype=np.int64)))
        words, distinct = np.diff(summed[starts]), np.diff(starts)
        capitals, points = (rows.facts[name].to_numpy() for name in ("capitals", "points"))
        mask = (
            (words < 50) * 1
            + (100 * distinct < 65 * words) * 2
            + (100 * capitals > 5 * points) * 4
            + rows.facts["odd"].to_numpy(zero_copy_only=False) * 8
        )
        columns = [rows.facts[name] for name in ("ids", "parts", "digests")]
        return pa.Table.from_arrays([*columns, pa.array(mask.astype(np.int32))], ["doc_id", "part", "digest", "mask"])

    shards = local_shards(docs, doc_id, text, part)
    return _encoded(shards, terms(shards), decide, "doc_id bigint, part string, digest binary, mask int")


def masks(failed: DataFrame, labels: DataFrame, doc_id: str = "doc_id") -> DataFrame:
    """``part, mask, rows, good, toxic``: rows by the conditions that they fail, E among them.

    E: a smaller id has the same text, in any part. Equal rows are counted before anything
    moves, and of each text only the counts by part, mask and labels meet, so a text that
    many rows share is no task's burden. Rows without an id never fail E, and none fails
    because of them. An id labelled more than once is good or toxic if any label says so.
    """
    key = ["digest", "part", "mask"]
    rows = failed.groupBy(*key, "doc_id").agg(F.count(F.lit(1)).alias("rows"))
    known = (
        labels.selectExpr(f"cast(`{doc_id}` AS BIGINT) AS of_id", "quality <=> 1 AS good", "toxic <=> 1 AS toxic")
        .where("of_id IS NOT NULL AND (good OR toxic)")
        .groupBy("of_id")
        .agg(F.max("good").alias("good"), F.max("toxic").alias("toxic"))
    )
    labelled = rows.where("doc_id IS NOT NULL").join(known, F.expr("doc_id = of_id"), "left").selectExpr(
        *key, "doc_id", "rows", "coalesce(good, false) AS good", "coalesce(toxic, false) AS toxic"
    )
    nameless = rows.where("doc_id IS NULL").selectExpr(*key, "doc_id", "rows", "false AS good", "false AS toxic")
    groups = labelled.union(nameless).groupBy(*key, "good", "toxic").agg(
        F.min(F.expr("IF(doc_id IS NULL, NULL, struct(doc_id, rows))")).alias("least"),
        F.sum("rows").alias("rows"),
        F.expr("coalesce(sum(rows) FILTER (WHERE doc_id IS NULL), 0L) AS nameless"),
    )
    # a text's groups: at most one for each part and pair of labels
    firsts = groups.selectExpr("*", "min(least.doc_id) OVER (PARTITION BY digest) AS first_id")
    passing = "nameless + IF(least.doc_id <=> first_id AND first_id IS NOT NULL, least.rows, 0L)"
    split = firsts.selectExpr(
        "part", "good", "toxic",
        f"""explode(array(struct(mask, {passing} AS rows),
                          struct(mask + 16 AS mask, rows - ({passing}) AS rows))) AS x""",
    )
    return split.where("x.rows > 0").groupBy("part", F.col("x.mask").alias("mask")).agg(
        F.expr("sum(x.rows) AS rows"),
        F.expr("coalesce(sum(x.rows) FILTER (WHERE good), 0L) AS good"),
        F.expr("coalesce(sum(x.rows) FILTER (WHERE toxic), 0L) AS toxic"),
    )


def all_orders() -> str:
    """SQL: an array of every step of every order: its filter's bit and the bits applied before."""
    steps = []
    for order in permutations(FILTERS):
        earlier = 0
        for i, name in enumerate(order):
            bit = 1 << FILTERS.index(name)
            steps.append(f"struct('{''.join(order)}' AS filter_order, {i + 1} AS step, {bit} AS bit, {earlier} AS earlier)")
            earlier |= bit
    return f"array({', '.join(steps)})"


def interactions(counted: DataFrame) -> DataFrame:
    """The audit's rows from ``masks``: every part, order and step, zeros included.

    A part has at most 32 masks, which meet the 600 steps in one array, so a part's rows come
    from one row. A row failing k conditions is removed by each of them in 120 / k orders.
    """
    cells = counted.groupBy("part").agg(F.collect_list(F.struct("mask", "rows", "good", "toxic")).alias("cells"))
    steps = cells.selectExpr("part", "cells", f"explode({all_orders()}) AS s").selectExpr(
        "part", "s.filter_order AS filter_order", "s.step AS step", "s.bit AS bit", "s.earlier AS earlier", "cells"
    )

    def total(value: str, when: str) -> str:
        return f"aggregate(cells, 0L, (a, c) -> a + IF({when}, {value}, 0L))"

    removed = "(c.mask & earlier) = 0 AND (c.mask & bit) <> 0"
    return steps.selectExpr(
        "part", "filter_order", "step",
        f"{total('c.rows', '(c.mask & (earlier | bit)) = 0')} AS kept",
        f"{total('c.rows', removed)} AS removed",
        f"{total('c.rows', '(c.mask & earlier) <> 0 AND (c.mask & bit) <> 0')} AS redundant",
        f"{total('c.rows', 'c.mask = bit')} AS unique_fails",
        f"{total('c.good', removed)} AS good_lost",
        f"{total('c.toxic', removed)} AS toxic_lost",
        f"{total('c.rows * (120 div bit_count(c.mask))', '(c.mask & bit) <> 0')} AS shapley",
    )


def filter_audit(
    docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", part: str = "source"
) -> DataFrame:
    """What each of five filters removes in each part of ``docs``, in all 120 orders.

    ``part, filter_order, step, kept, removed, redundant, unique_fails, good_lost,
    toxic_lost, shapley``; counts are rows within the part. A matrix of documents and
    terms over whole texts decides A and B (``failures``), labels and repeats follow
    (``masks``).

    A null text counts as empty: it fails A, and not B, C or D. A null part counts as the
    empty string, together with parts of that name. Null ids: see ``masks``. Repeated rows
    count each; they have one id, so none fails E because of another. Further
    columns are ignored, whatever their names; an empty table gives no rows.
    """
    with scratch(docs.sparkSession) as keep:
        failed = stored(failures(docs, doc_id, text, part), "failures")
        counted = stored(masks(failed, labels, doc_id), "masks")
        keep(counted)
    return interactions(counted)
