"""Documents whose sets of word n-grams are alike: prefix filters under several token orders."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from opsmeter.llm import sketch
from opsmeter.llm.common import (
    configure,
    fresh,
    mix,
    pieces_of,
    scratch,
    sequence_hashes,
    sorted_distinct,
    stored,
    utf8,
    word_hashes,
)
from opsmeter.llm.components import connected

BATCH_BYTES = 1 << 20
# counters of how often tokens occur, and bits of the filter of ids whose texts are needed
COUNTER_BITS = 20
FILTER_BITS = 26
# sets around one centre from which it pays to know how each of them differs from it
CROWD = 32


@dataclass(frozen=True)
class Settings:
    """Shingles of ``words`` words, similarity of ``percent``, that many token orders."""

    words: int = 4
    percent: int = 85
    orders: int = 3


def shingle_sets(texts: pa.Array, length: int) -> list[np.ndarray]:
    """Sorted distinct hashes of each text's runs of ``length`` words, or of all its fewer words."""
    words, bounds = word_hashes(texts)
    grams = sequence_hashes(words, length)
    sets = []
    for low, high in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
        if high - low >= length:
            sets.append(sorted_distinct(grams[low : high - length + 1]))
        else:
            sets.append(sequence_hashes(words[low:high], high - low) if high > low else words[:0])
    return sets


def set_key(tokens: np.ndarray) -> int:
    """A 64-bit name of a set; ``collided`` makes sure that no two sets share one."""
    return int.from_bytes(hashlib.blake2b(tokens.tobytes(), digest_size=8).digest(), "little", signed=True)


def check_name(tokens: np.ndarray) -> int:
    """A second, independent 64-bit name."""
    digest = hashlib.blake2b(tokens.tobytes(), digest_size=8, person=b"check")
    return int.from_bytes(digest.digest(), "little", signed=True)


def least_overlap(n: int, percent: int) -> int:
    """Tokens that a set of ``n`` shares at least with any set it links to."""
    return -(-percent * n // 100)


def prefix_length(n: int, percent: int) -> int:
    return n - least_overlap(n, percent) + 1


def needed_overlap(n: int, m: int, percent: int) -> int:
    """Tokens that sets of ``n`` and ``m`` share at least if they link."""
    return -(-percent * (n + m) // (100 + percent))


def needed_in_prefix(n: int, m: int, percent: int) -> int:
    """Tokens that the prefixes of linked sets of ``n`` and ``m`` share at least, in any order.

    Take the set whose prefix ends first: of its prefix, only tokens that the other set
    lacks are not in the other's prefix, and it can lack ``n`` less the overlap.
    """
    overlap = needed_overlap(n, m, percent)
    return max(1, min(prefix_length(x, percent) - (x - overlap) for x in (n, m)))


def bucket(tokens: np.ndarray) -> np.ndarray:
    return (tokens >> np.uint64(64 - COUNTER_BITS)).astype(np.int64)


def levels_of(counts: np.ndarray) -> np.ndarray:
    """Coarse frequency of each bucket: 0 up to what chance makes of rare tokens, then by doubling.

    Any levels give a right order, since all sets use the same; these keep tokens that
    many documents share at the end, out of the prefixes.
    """
    usual = np.median(counts) if len(counts) else 0
    excess = counts.astype(np.float64) - (usual + 4 * np.sqrt(usual) + 4)
    return np.where(excess > 0, 1 + np.log2(np.maximum(excess, 1)), 0).astype(np.uint8)


def ordered(tokens: np.ndarray, levels: np.ndarray, order: int) -> np.ndarray:
    """Sort keys of sorted ``tokens`` in one global order: rare first, then by a seeded hash.

    Equal keys keep the tokens' own order under a stable sort.
    """
    rank = levels[bucket(tokens)].astype(np.uint64) << np.uint64(56)
    return rank | (mix(tokens, 100 + order) >> np.uint64(8))


def prefix(tokens: np.ndarray, levels: np.ndarray, order: int, percent: int) -> np.ndarray:
    keys = ordered(tokens, levels, order)
    return tokens[np.argsort(keys, kind="stable")[: prefix_length(len(tokens), percent)]]


def _common(a: np.ndarray, b: np.ndarray) -> int:
    """How many values two arrays of distinct values share."""
    both = np.sort(np.concatenate((a, b)))
    return int((both[1:] == both[:-1]).sum())


def similar(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    """The exact test."""
    if not len(a) or not len(b) or 100 * min(len(a), len(b)) < percent * max(len(a), len(b)):
        return False
    shared = _common(a, b)
    return 100 * shared >= percent * (len(a) + len(b) - shared)


def _rows(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    return docs.selectExpr(f"cast(`{doc_id}` AS BIGINT) AS doc_id", f"{utf8(text)} AS text")


def _name_sets(rows: DataFrame, settings: Settings) -> DataFrame:
    """``doc_id, n, name, check`` per row, and a row with token counters per task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(1 << COUNTER_BITS, np.uint64)
        names = ["doc_id", "n", "name", "check", "counts"]
        for batch in batches:
            sizes, keys, checks = [], [], []
            for start, stop in pieces_of(batch.column(1), BATCH_BYTES):
                sets = shingle_sets(batch.column(1).slice(start, stop - start), settings.words)
                counts += np.bincount(bucket(np.concatenate(sets)), minlength=len(counts)).astype(np.uint64)
                sizes += map(len, sets)
                keys += map(set_key, sets)
                checks += map(check_name, sets)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(sizes, pa.int64()), pa.array(keys, pa.int64()),
                 pa.array(checks, pa.int64()), pa.nulls(len(sizes), pa.binary())], names,
            )
        none = pa.nulls(1, pa.int64())
        yield pa.RecordBatch.from_arrays(
            [none, none, none, none, pa.array([sketch.packed(counts)], pa.binary())], names
        )

    return rows.mapInArrow(run, "doc_id bigint, n bigint, name bigint, check bigint, counts binary")


def _postings(rows: DataFrame, levels, settings: Settings) -> DataFrame:
    """``token, name, n`` for the prefix of every set under the first order, once per task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in batches:
            for start, stop in pieces_of(batch.column(1), BATCH_BYTES):
                tokens, keys, sizes = [], [], []
                for own in shingle_sets(batch.column(1).slice(start, stop - start), settings.words):
                    key = set_key(own)
                    if len(own) and key not in seen:
                        seen.add(key)
                        tokens.append(prefix(own, levels.value, 0, settings.percent))
                        keys.append(key)
                        sizes.append(len(own))
                if tokens:
                    lengths = [len(x) for x in tokens]
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array(np.concatenate(tokens).view(np.int64)),
                            pa.array(np.repeat(np.array(keys, np.int64), lengths)),
                            pa.array(np.repeat(np.array(sizes, np.int32), lengths)),
                        ],
                        ["token", "name", "n"],
                    )

    return rows.mapInArrow(run, "token bigint, name bigint, n int")


def _filter_bits(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Byte and bit that stand for each id in the filter."""
    place = (mix(ids.view(np.uint64), 5) >> np.uint64(64 - FILTER_BITS)).astype(np.int64)
    return place >> 3, np.left_shift(1, place & 7).astype(np.uint8)


def _needed(pairs: DataFrame, classes: DataFrame) -> DataFrame:
    """``name, rep`` of the sets in ``pairs (a, b)``: the documents that stand for them."""
    names = pairs.selectExpr("a AS name").union(pairs.selectExpr("b AS name")).distinct()
    return stored(names.join(classes.select("name", "rep"), "name"), "needed")


def _maybe(rows: DataFrame, needed: DataFrame) -> DataFrame:
    """``doc_id, text`` of the needed documents and few others, by a filter of fixed size over their ids."""

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.zeros(1 << (FILTER_BITS - 3), np.uint8)
        for batch in batches:
            at, bit = _filter_bits(batch.column(0).to_numpy())
            np.bitwise_or.at(bits, at, bit)
        yield pa.RecordBatch.from_arrays([pa.array([sketch.packed(bits)], pa.binary())], ["table"])

    parts = needed.select("rep").mapInArrow(mark, "table binary")
    bits = sketch.combined(parts, np.zeros(1 << (FILTER_BITS - 3), np.uint8), np.bitwise_or)
    shared = rows.sparkSession.sparkContext.broadcast(bits)

    def choose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, bit = _filter_bits(batch.column(0).to_numpy())
            yield batch.filter(pa.array((shared.value[at] & bit) > 0))

    return rows.where("doc_id IS NOT NULL").mapInArrow(choose, "doc_id bigint, text string")


def _texts(rows: DataFrame, pairs: DataFrame, classes: DataFrame) -> DataFrame:
    """``name, text`` of the sets in ``pairs (a, b)``, read from the documents that stand for them.

    The filter spares most other texts the way into the join; the join then decides.
    """
    needed = _needed(pairs, classes)
    found = _maybe(rows, needed).join(needed, F.col("doc_id") == F.col("rep")).select("name", "text")
    return stored(found, "texts")


def _alike_in_all_orders(
    pairs: DataFrame, rows: DataFrame, classes: DataFrame, levels, settings: Settings
) -> DataFrame:
    """The ``pairs (a, b)`` whose prefixes share enough tokens under each of the further orders.

    The sets' prefixes come from the tasks that read their documents, under all orders at
    once; names and tokens move, texts do not. Intersecting these filters with the first
    order's, which made the pairs, leaves those whose texts are worth fetching.
    """
    percent = settings.percent
    needed = _needed(pairs, classes)

    def prefixes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start, stop in pieces_of(batch.column(1), BATCH_BYTES):
                sets = shingle_sets(batch.column(1).slice(start, stop - start), settings.words)
                columns = [[] for _ in range(settings.orders - 1)]
                for own in sets:
                    for order, column in enumerate(columns, 1):
                        column.append(prefix(own, levels.value, order, percent).view(np.int64))
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(start, stop - start),
                        pa.array([set_key(own) for own in sets], pa.int64()),
                        pa.array([len(own) for own in sets], pa.int32()),
                        *[pa.array(column, pa.list_(pa.int64())) for column in columns],
                    ],
                    ["doc_id", "own_name", "n", *names],
                )

    names = [f"prefix_{order}" for order in range(1, settings.orders)]
    schema = ", ".join(["doc_id bigint, own_name bigint, n int", *[f"{x} array<bigint>" for x in names]])
    # an id listed with several texts brings all of them; only the named sets count
    found = stored(
        _maybe(rows, needed)
        .mapInArrow(prefixes, schema)
        .join(needed, F.expr("doc_id = rep AND own_name = name"))
        .select("name", "n", *names)
        .dropDuplicates(["name"]),
        "prefixes",
    )
    left = found.selectExpr("name AS a", "n", *[f"{x} AS left_{x}" for x in names])
    right = found.selectExpr("name AS b", "n AS m", *[f"{x} AS right_{x}" for x in names])
    alike = " AND ".join(
        f"size(array_intersect(left_{x}, right_{x})) >= {_needed_sql('n', 'm', percent)}" for x in names
    )
    return stored(pairs.join(left, "a").join(right, "b").where(alike or "true").select(*pairs.columns), "alike")


def _with_texts(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    left = texts.selectExpr("name AS a", "text AS left_text")
    right = texts.selectExpr("name AS b", "text AS right_text")
    return pairs.join(left, "a").join(right, "b").select("a", "b", "left_text", "right_text")


def _judged(judge, settings: Settings):
    """Apply ``judge(names, left sets, right sets)`` to pairs with texts, some at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start, stop in pieces_of(batch.column(2), BATCH_BYTES):
                some = batch.slice(start, stop - start)
                left, right = (shingle_sets(some.column(i), settings.words) for i in (2, 3))
                names = zip(some.column(0).to_pylist(), some.column(1).to_pylist(), strict=True)
                yield judge(list(names), left, right)

    return run


def _verified(pairs: DataFrame, texts: DataFrame, settings: Settings) -> DataFrame:
    """The ``pairs (a, b)`` of set names that link, judged from the sets' texts."""

    def judge(names, left, right):
        keep = [
            # an id listed with several texts brings all of them; only the named sets count
            (a, b)
            for (a, b), x, y in zip(names, left, right, strict=True)
            if set_key(x) == a and set_key(y) == b and similar(x, y, settings.percent)
        ]
        columns = list(zip(*keep, strict=True)) or [(), ()]
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["a", "b"])

    both = _with_texts(pairs, texts)
    return stored(both.mapInArrow(_judged(judge, settings), "a bigint, b bigint"), "links")


def _allowed(n, m, percent: int):
    """How much linked sets of ``n`` and ``m`` differ at most: tokens in just one of them."""
    return n + m - 2 * (-(-percent * (n + m) // (100 + percent)))


def _partner_sizes(n: int, percent: int) -> np.ndarray:
    return np.arange(least_overlap(n, percent), 100 * n // percent + 1)


def difference(own: np.ndarray, centre: np.ndarray, linked: bool, percent: int) -> tuple | None:
    """How a set differs from its centre: ``(tokens, added, removed, spare)``, or None if too much.

    ``tokens`` is the size ``d`` of the difference, ``added`` all tokens that the centre lacks.
    Sets ``x`` and ``y`` with one centre differ by ``d_x + d_y`` less twice what their
    differences share. If ``x`` does not link with the centre, ``x`` and ``y`` can only link
    if the differences share ``k = (d_x + d_y - allowed) / 2`` tokens. In any order that all
    sets use, one of these is not among the last ``spare`` of the difference: the least
    ``k``, less one. ``removed`` are those that only the centre has, in a seeded order.

    None where no such ``k`` is certain, and for sets that are not near their centre.
    """
    added = np.setdiff1d(own, centre, assume_unique=True)
    removed = np.setdiff1d(centre, own, assume_unique=True)
    d, n, m = len(added) + len(removed), len(own), len(centre)
    sizes = _partner_sizes(n, percent)
    if d > 3 * _allowed(n, m, percent):
        return None
    if linked:
        least = int((2 * percent * d / (100 + percent) - 1) // 2)
    else:
        if (_allowed(n, sizes, percent) - np.abs(sizes - m)).max() >= d:
            return None
        least = d - int(_allowed(n, sizes, percent).max())
    return d, added, removed[np.argsort(mix(removed, 200), kind="stable")], max(1, least) - 1


STARS = (
    "name bigint, centre bigint, linked boolean, near boolean, n bigint, d bigint, "
    "spare bigint, added array<bigint>, removed array<bigint>"
)


def _star_differences(pairs: DataFrame, texts: DataFrame, settings: Settings) -> DataFrame:
    """For pairs of a set and its centre whether they link, and how the set differs: ``STARS``."""

    def judge(names, left, right):
        rows = []
        for (a, b), x, y in zip(names, left, right, strict=True):
            if set_key(x) != a or set_key(y) != b:
                continue
            linked = similar(x, y, settings.percent)
            found = difference(x, y, linked, settings.percent)
            d, added, removed, spare = found or (0, x[:0], x[:0], 0)
            rows.append((a, b, linked, bool(found), len(x), d, spare,
                         added.view(np.int64).tolist(), removed.view(np.int64).tolist()))
        columns = list(zip(*rows, strict=True)) or [()] * 9
        kinds = [pa.int64(), pa.int64(), pa.bool_(), pa.bool_(), pa.int64(), pa.int64(), pa.int64(),
                 pa.list_(pa.int64()), pa.list_(pa.int64())]
        return pa.RecordBatch.from_arrays(
            [pa.array(c, k) for c, k in zip(columns, kinds, strict=True)],
            [part.split()[0] for part in STARS.split(", ")],
        )

    return stored(_with_texts(pairs, texts).mapInArrow(_judged(judge, settings), STARS), "stars")


def similarity_components(
    docs: DataFrame, settings: Settings | None = None, doc_id: str = "doc_id", text: str = "text"
) -> DataFrame:
    """``doc_id, n_shingles, component_id`` for every row of ``docs``.

    Two documents link when the Jaccard similarity of their sets of word n-grams is
    ``percent`` or more; the component is the smallest id reachable by links.

    Linked sets share many tokens among the first few of each under any global order
    (``needed_in_prefix``). A candidate pair must do so under all ``orders`` orders, by names and
    tokens alone: the first by a join on prefix tokens, the others by the prefixes of the
    pairs that it leaves (``_alike_in_all_orders``). Only then are texts fetched. All orders put
    tokens last that many documents share (counted over all rows in a table of fixed size)
    and differ by a seeded hash.

    Equal sets are one vertex, named by hashes whose uniqueness is checked. Groups of many
    near copies do not make all their pairs. Each set is first compared with one centre, the
    set whose tokens' lists are longest among those it shares most prefix tokens with. What
    links is one component, and only pairs of different components matter from there.
    Of sets around one centre, pairs can link only if they differ from the centre alike
    (``difference``), so they meet by such tokens; all other pairs meet by prefix tokens.
    Links inside a component cannot change the answer.

    Null and empty texts, and texts of white space, have no shingles and link with nothing.
    Rows with a null id link with nothing and get a null component. Rows that repeat an id
    are one vertex with all their texts. Further columns are ignored; an empty table gives
    no rows.
    """
    settings = settings or Settings()
    spark = docs.sparkSession
    configure(spark)
    rows = _rows(docs, doc_id, text)
    with scratch(spark) as keep:
        sets, placed = _placed_sets(rows, settings)
        keep(sets, placed)
    return sets.where("counts IS NULL").join(placed, "name", "left").selectExpr(
        "doc_id",
        "n AS n_shingles",
        "IF(doc_id IS NULL OR n = 0, doc_id, component) AS component_id",
    )


def _placed_sets(rows: DataFrame, settings: Settings) -> tuple[DataFrame, DataFrame]:
    """The sets' names (``_name_sets``) and ``name, component`` of every set, both stored."""
    percent = settings.percent
    spark = rows.sparkSession
    named = stored(_name_sets(rows, settings), "sets")
    parts = named.where("counts IS NOT NULL").select("counts")
    counts = sketch.combined(parts, np.zeros(1 << COUNTER_BITS, np.uint64), np.add)
    levels = spark.sparkContext.broadcast(levels_of(counts))
    sets = named.where("counts IS NULL").drop("counts")
    classes = stored(
        sets.where("n > 0 AND doc_id IS NOT NULL")
        .groupBy("name")
        .agg(
            F.min("doc_id").alias("rep"),
            (F.min("check") != F.max("check")).alias("collided"),
        ),
        "classes",
    )
    if not classes.where("collided").isEmpty():
        raise ValueError("two sets share a 64-bit name")

    lists = _lists(_postings(rows.where("doc_id IS NOT NULL"), levels, settings))
    nearest = stored(_centres(lists, percent), "centres")
    # in a crowd the differences are of use whether a set links with its centre or not
    pairs = nearest.where("NOT in_crowd").select("a", "b")
    pairs = _alike_in_all_orders(pairs, rows, classes, levels, settings)
    centres = stored(pairs.union(nearest.where("in_crowd").select("a", "b")), "alike-centres")
    stars = _star_differences(centres, _texts(rows, centres, classes), settings)
    links = stars.where("linked").selectExpr("name AS a", "centre AS b")
    labels = connected(links).withColumnRenamed("component_id", "label")

    around = stars.where("near").selectExpr("name AS id", "centre AS hub")
    hubs = stars.where("near").selectExpr("centre AS id").distinct()
    hubs = hubs.join(around.select("id"), "id", "left_anti").selectExpr("id", "id AS hub")
    marks = stored(around.union(hubs).join(labels, "id", "full_outer"), "marks")
    candidates = stored(
        _pairs(lists, marks, percent).union(_pairs_around(stars, labels, percent)).distinct(), "candidates"
    )
    candidates = _alike_in_all_orders(candidates, rows, classes, levels, settings)
    links = links.union(_verified(candidates, _texts(rows, candidates, classes), settings))

    reps = classes.select("name", "rep")
    ends = links.join(reps.select(F.col("name").alias("a"), F.col("rep").alias("rep_a")), "a").join(
        reps.select(F.col("name").alias("b"), F.col("rep").alias("rep_b")), "b"
    )
    reached = connected(ends.selectExpr("rep_a AS a", "rep_b AS b")).withColumnRenamed("id", "rep")
    placed = stored(
        reps.join(reached, "rep", "left").selectExpr("name", "coalesce(component_id, rep) AS component"),
        "placed",
    )
    return named, placed


def without_near_copies(
    docs: DataFrame, settings: Settings | None = None, doc_id: str = "doc_id", text: str = "text"
) -> DataFrame:
    """The rows of ``docs`` whose id is the smallest of its component, or null, unchanged.

    All columns stay, whatever their names. Rows that repeat an id stay or go together.
    """
    (gone_id,) = fresh(docs, "gone_id")
    placed = stored(similarity_components(docs, settings, doc_id, text), "components")
    gone = placed.where("component_id < doc_id").select(F.col("doc_id").alias(gone_id)).distinct()
    # ids to drop grow with the input: no broadcast, whatever this input's size
    return docs.join(gone.hint("merge"), F.col(f"`{doc_id}`").cast("bigint") == F.col(gone_id), "left_anti")


# --- candidates -----------------------------------------------------------------


def _allowed_sql(n: str, m: str, percent: int) -> str:
    return f"({n} + {m} - 2 * (({percent} * ({n} + {m}) + {99 + percent}) div {100 + percent}))"


def _needed_sql(n: str, m: str, percent: int) -> str:
    """SQL of ``needed_in_prefix``."""

    def spare(x: str) -> str:
        kept = f"{x} - ({percent} * {x} + 99) div 100 + 1"
        overlap = f"({percent} * ({n} + {m}) + {99 + percent}) div {100 + percent}"
        return f"({kept}) - ({x} - {overlap})"

    return f"greatest(1, least({spare(n)}, {spare(m)}))"


def _size_sql(n: str, m: str, percent: int) -> str:
    return f"100 * least({n}, {m}) >= {percent} * greatest({n}, {m})"


def _lists(postings: DataFrame) -> DataFrame:
    """The postings of tokens that several sets have, each with its list's centre.

    The centre of a list is the set whose tokens' lists are longest in all: near copies
    have tokens of their own, what they were copied from has not, and so it is the centre
    of nearly all their lists.
    """
    shared = stored(
        postings.selectExpr(
            "*", "min(name) OVER (PARTITION BY token) AS low", "max(name) OVER (PARTITION BY token) AS high",
            "count(1) OVER (PARTITION BY token) AS size",
        ).where("low < high").select("token", "name", "n", "size"),
        "postings",
    )
    scores = shared.groupBy("name").agg(F.sum("size").alias("score"))
    return stored(
        shared.join(scores, "name").selectExpr(
            "token", "name", "n",
            "max(struct(score / n AS score, name, n)) OVER (PARTITION BY token) AS centre",
        ).selectExpr("token", "name", "n", "centre.name AS centre", "centre.n AS centre_n"),
        "lists",
    )


def _centres(lists: DataFrame, percent: int) -> DataFrame:
    """For each set the centre it shares most prefix tokens with: at most one pair a set.

    Pairs that share too few tokens to link are left out, unless ``CROWD`` sets or more share
    tokens with that centre (``in_crowd``): then knowing how a set differs spares it all their pairs.
    """
    counted = stored(
        lists.where(f"name <> centre AND {_size_sql('n', 'centre_n', percent)}")
        .groupBy("name", "n", "centre", "centre_n")
        .agg(F.count(F.lit(1)).alias("tokens")),
        "counted",
    )
    crowds = counted.groupBy("centre").count().where(f"count >= {CROWD}").selectExpr("centre AS crowded")
    known = counted.join(crowds, F.expr("centre = crowded"), "left").selectExpr(
        "name", "n", "centre", "centre_n", "tokens", "crowded IS NOT NULL AS in_crowd"
    )
    best = (
        known.where(f"in_crowd OR tokens >= {_needed_sql('n', 'centre_n', percent)}")
        .groupBy("name")
        .agg(F.max(F.struct("tokens", "centre", "in_crowd")).alias("best"))
    )
    return best.selectExpr("name AS a", "best.centre AS b", "best.in_crowd AS in_crowd")


def _pairs(lists: DataFrame, marks: DataFrame, percent: int) -> DataFrame:
    """Pairs of different components and different centres whose prefixes share enough tokens."""
    marked = lists.select("token", "name", "n").join(
        marks.withColumnRenamed("id", "name"), "name", "left"
    ).selectExpr("token", "name", "n", "coalesce(label, name) AS label", "hub")
    # lists within one component, or around one centre, make no pairs
    mixed = stored(
        marked.selectExpr(
            "*", "min(label) OVER (PARTITION BY token) AS low", "max(label) OVER (PARTITION BY token) AS high",
            "min(coalesce(hub, name)) OVER (PARTITION BY token) AS low_hub",
            "max(coalesce(hub, name)) OVER (PARTITION BY token) AS high_hub",
        )
        .where("low < high AND low_hub < high_hub")
        .select("token", "name", "n", "label", "hub"),
        "mixed",
    )
    left = mixed.selectExpr("token", "name AS a", "n", "label", "hub")
    right = mixed.selectExpr("token", "name AS b", "n AS m", "label AS right_label", "hub AS right_hub")
    return (
        left.join(right, "token")
        .where(
            f"""a < b AND label <> right_label AND coalesce(hub <> right_hub, true)
                AND {_size_sql('n', 'm', percent)}"""
        )
        .groupBy("a", "b", "n", "m")
        .agg(F.count(F.lit(1)).alias("tokens"))
        .where(f"tokens >= {_needed_sql('n', 'm', percent)}")
        .select("a", "b")
    )


def _pairs_around(stars: DataFrame, labels: DataFrame, percent: int) -> DataFrame:
    """Pairs of different components around one centre whose differences share enough.

    All sets order the tokens of their differences alike: added ones that few sets around
    the centre have, then removed ones by a seed, then added ones that ``CROWD`` or more
    have, the most frequent last. Sets meet by all tokens but their last ``spare``, so a token
    that makes a crowd brings no pairs together where others must be shared as well. What
    they share is counted; skipped added ones may come to that, as many as either set skips.
    """
    near = stars.where("near").join(labels.withColumnRenamed("id", "name"), "name", "left")
    own = ["centre", "name"]
    listed = near.selectExpr(*own, "explode(added) AS token")
    frequent = listed.groupBy("centre", "token").agg(F.count(F.lit(1)).alias("times")).where(f"times >= {CROWD}")
    last = listed.join(frequent, ["centre", "token"]).groupBy(*own).agg(
        F.sort_array(F.collect_list(F.struct("times", "token")), asc=False).alias("last")
    )
    sets = near.join(last, own, "left").selectExpr(
        *own, "n", "d", "cast(size(removed) AS BIGINT) AS removals", "coalesce(label, name) AS label", "spare",
        "added", "removed",
        "transform(slice(coalesce(last, array()), 1, cast(spare AS INT)), t -> t.token) AS skipped",
    ).selectExpr(
        *own, "n", "d", "removals", "label", "removed", "cast(size(skipped) AS BIGINT) AS skips",
        "array_except(added, skipped) AS added",
        "greatest(0L, removals - (spare - size(skipped))) AS kept",
    )
    tokens = sets.selectExpr(
        *own, "n", "d", "removals", "kept", "skips", "label",
        "explode(concat(transform(added, t -> struct(t AS token, true AS is_added)),"
        " transform(slice(removed, 1, cast(kept AS INT)), t -> struct(t AS token, false AS is_added)))) AS t",
    ).selectExpr("centre", "t.token", "t.is_added", "name", "n", "d", "removals", "kept", "skips", "label")
    mixed = stored(
        tokens.selectExpr(
            "*", "min(label) OVER (PARTITION BY centre, token) AS low",
            "max(label) OVER (PARTITION BY centre, token) AS high",
        ).where("low < high").drop("low", "high"),
        "differences",
    )
    left = mixed.withColumnRenamed("name", "a")
    right = mixed.selectExpr(
        "centre", "token", "name AS b", "n AS m", "d AS e", "removals AS right_removals",
        "kept AS right_kept", "skips AS right_skips", "label AS right_label",
    )
    # tokens to be shared among those that are not skipped added ones
    needed = f"((d + e - {_allowed_sql('n', 'm', percent)}) div 2 - greatest(skips, right_skips))"
    sizes = ["a", "b", "n", "m", "d", "e", "removals", "right_removals", "kept", "right_kept", "skips", "right_skips"]
    shared = (
        left.join(right, ["centre", "token"])
        .where(
            f"""a < b AND label <> right_label AND {_size_sql('n', 'm', percent)}
                AND {needed} <= least(d, e)
                AND (is_added OR least(removals, right_removals) >= {needed})"""
        )
        .groupBy(*sizes)
        .agg(
            F.expr("count_if(is_added) AS same_added"), F.expr("count_if(NOT is_added) AS same_removed")
        )
    )
    return shared.where(
        f"""CASE WHEN same_added > 0 THEN same_added + least(removals, right_removals) >= {needed}
            ELSE same_removed >= least(kept - (removals - {needed}),
                                       right_kept - (right_removals - {needed})) END"""
    ).select("a", "b")
