"""Document likelihood under a subword lattice: all segmentations, weighted, summed."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from opsmeter.llm.common import configure, mix, pieces_of, remainder, stored, utf8

BATCH_BYTES = 1 << 20
# distinct words of one block, about: a task's dictionary starts anew beyond that
BLOCK_WORDS = 300_000
# rows that a task gathers before it deals them out to the blocks
DEALT_ROWS = 400_000
# words whose lattices are summed together: many of one length make numpy's steps worth it
WORD_BATCH = 50_000

MARK = 0xFF  # stands for the piece mark; no byte of UTF-8 has this value
_FILTER = 20


@dataclass(frozen=True)
class Settings:
    """``folds``: rows held out are those with remainder 0. ``prior``: weight of the given scores."""

    folds: int = 10
    rounds: int = 2
    prior: float = 2000.0
    rank_offset: float = 20.0
    byte_mass: float = 0.001


class Vocabulary:
    """Pieces of an existing vocabulary, findable by hashes of byte strings, and their scores."""

    def __init__(self, path: str):
        import sentencepiece

        library = sentencepiece.SentencePieceProcessor(model_file=path)
        names, scores = [bytes([i]) for i in range(256)], [0.0] * 256
        for i in range(library.get_piece_size()):
            if library.is_control(i) or library.is_unknown(i) or library.is_byte(i) or library.is_unused(i):
                continue
            name = library.id_to_piece(i)
            # no piece reaches into the next word
            if "▁" not in name[1:]:
                names.append(name.encode().replace("▁".encode(), bytes([MARK])))
                scores.append(library.get_score(i))
        self.names, self.scores = names, np.array(scores)
        self.longest = max(map(len, names))
        self.letters = mix(np.arange(256, dtype=np.uint64), 991) | np.uint64(1)
        self._powers(64)
        # single bytes have the first 256 places; a piece of one byte is that byte's
        table: dict[bytes, int] = {}
        for place, name in enumerate(names):
            table.setdefault(name, place)
        self.size = len(names)
        keys = np.array([self._hash(name) for name in table], np.uint64)
        order = np.argsort(keys)
        self.keys, self.places = keys[order], np.array(list(table.values()))[order]
        if (self.keys[1:] == self.keys[:-1]).any():
            raise ValueError("two pieces share a hash")
        self.filter = np.zeros(1 << _FILTER, bool)
        self.filter[(self.keys >> np.uint64(64 - _FILTER)).astype(np.int64)] = True

    def _powers(self, n: int) -> None:
        base = 0xD6E8FEB86659FD93
        up = np.full(n + 1, base, np.uint64)
        down = np.full(n + 1, pow(base, -1, 2**64), np.uint64)
        up[0] = down[0] = 1
        self.up, self.down = np.multiply.accumulate(up), np.multiply.accumulate(down)

    def _hash(self, name: bytes) -> int:
        raw = np.frombuffer(name, np.uint8)
        if len(raw) >= len(self.up):
            self._powers(2 * len(raw))
        return int(mix((self.letters[raw] * self.up[: len(raw)]).sum(dtype=np.uint64)[None])[0])

    def given(self, settings: Settings) -> np.ndarray:
        """Log probabilities that the vocabulary's own scores stand for.

        Scores that are log probabilities, as a unigram vocabulary has, are taken as such.
        Scores that are minus a merge's rank are read by Zipf's law, as one over the rank
        and an offset. The 256 bytes share ``byte_mass``, so every text has a segmentation.
        """
        own = self.scores[256:]
        ranks = len(own) > 0 and own.min() < -1000
        weights = 1 / (settings.rank_offset - own) if ranks else np.exp(own)
        p = np.concatenate(
            (np.full(256, settings.byte_mass / 256), (1 - settings.byte_mass) * weights / weights.sum())
        )
        return np.log(self.merged(p))

    def merged(self, p: np.ndarray) -> np.ndarray:
        """Weights of pieces that spell the same moved to the place that stands for them."""
        if not hasattr(self, "alias"):
            first: dict[bytes, int] = {}
            self.alias = np.array([first.setdefault(name, i) for i, name in enumerate(self.names)])
        out = np.bincount(self.alias, p, self.size)
        return np.maximum(out, 1e-300)

    def arcs(self, words: np.ndarray) -> list[list[tuple[int, np.ndarray, np.ndarray]]]:
        """For each end in equally long ``words`` (rows of bytes): arcs ``(length, rows, places)``."""
        n = words.shape[1]
        if n >= len(self.up):
            self._powers(2 * n)
        total = np.zeros((len(words), n + 1), np.uint64)
        np.cumsum(self.letters[words] * self.up[:n], axis=1, out=total[:, 1:])
        out = []
        for end in range(1, n + 1):
            found = []
            lengths = range(1, min(end, self.longest) + 1)
            starts = np.array([end - length for length in lengths])
            hashes = mix((total[:, end, None] - total[:, starts]) * self.down[starts])
            maybe = self.filter[(hashes >> np.uint64(64 - _FILTER)).astype(np.int64)]
            rows, which = np.nonzero(maybe)
            keys = hashes[rows, which]
            at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
            hit = self.keys[at] == keys
            rows, which, at = rows[hit], which[hit], self.places[at[hit]]
            order = np.argsort(which, kind="stable")
            rows, which, at = rows[order], which[order], at[order]
            cuts = np.searchsorted(which, np.arange(len(starts) + 1))
            for k, length in enumerate(lengths):
                if cuts[k] < cuts[k + 1]:
                    part = slice(cuts[k], cuts[k + 1])
                    found.append((length, rows[part], at[part]))
            out.append(found)
        return out


def forward(arcs, rows: int, logp: np.ndarray) -> np.ndarray:
    """Log of the summed weight of all segmentations of each prefix, ``rows x (n + 1)``."""
    alpha = np.full((rows, len(arcs) + 1), -np.inf)
    alpha[:, 0] = 0
    for end, found in enumerate(arcs, 1):
        for length, own, places in found:
            alpha[own, end] = np.logaddexp(alpha[own, end], alpha[own, end - length] + logp[places])
    return alpha


def expected(arcs, rows: int, logp: np.ndarray, size: int) -> np.ndarray:
    """How often each piece is expected in a segmentation of the words, one each."""
    alpha = forward(arcs, rows, logp)
    beta = np.full_like(alpha, -np.inf)
    beta[:, -1] = 0
    counts = np.zeros(size)
    for end in range(len(arcs), 0, -1):
        for length, own, places in arcs[end - 1]:
            through = logp[places] + beta[own, end]
            share = np.exp(alpha[own, end - length] + through - alpha[own, -1])
            counts += np.bincount(places, share, size)
            beta[own, end - length] = np.logaddexp(beta[own, end - length], through)
    return counts


def by_length(words: list[bytes]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places and bytes, mark first, of words of one length, in groups of bounded size."""
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    order = np.argsort(sizes, kind="stable")
    bounds = np.flatnonzero(np.diff(sizes[order], prepend=-1)).tolist() + [len(order)]
    for low, high in zip(bounds[:-1], bounds[1:], strict=True):
        n = int(sizes[order[low]])
        step = max(1, 200_000 // (n + 1))
        for start in range(low, high, step):
            own = order[start : min(high, start + step)]
            raw = np.frombuffer(b"".join(words[i] for i in own), np.uint8).reshape(len(own), n)
            yield own, np.concatenate((np.full((len(own), 1), MARK, np.uint8), raw), 1)


def marginals(vocabulary: Vocabulary, words: list[bytes], logp: np.ndarray) -> np.ndarray:
    """Log probability of each word: the summed weight of all its segmentations."""
    out = np.zeros(len(words))
    for own, raw in by_length(words):
        out[own] = forward(vocabulary.arcs(raw), len(own), logp)[:, -1]
    return out


def gathered(batches: Iterator[pa.RecordBatch], rows: int) -> Iterator[pa.Table]:
    """Arrow batches put together to about ``rows`` rows."""
    held, size = [], 0
    for batch in batches:
        held.append(batch)
        size += batch.num_rows
        if size >= rows:
            yield pa.Table.from_batches(held)
            held, size = [], 0
    if size:
        yield pa.Table.from_batches(held)


_vocabularies: dict[str, Vocabulary] = {}


def vocabulary(path: str) -> Vocabulary:
    return _vocabularies.get(path) or _vocabularies.setdefault(path, Vocabulary(path))


class _Numbers(dict):
    """Words numbered as they come."""

    def __missing__(self, word: bytes) -> int:
        self[word] = number = len(self)
        return number


BLOCKS = (
    "block bigint, doc_id bigint, held_out boolean, n_tokens bigint, places binary, times binary, "
    "word string, number int, train bigint"
)


def _blocks(rows: DataFrame) -> DataFrame:
    """Documents as numbers of words, and the words of each block: ``BLOCKS``.

    A block is a run of a task's documents with a dictionary of bounded size. Document rows
    hold the numbers of their distinct words and how often each occurs; dictionary rows
    hold a word's number and how often the block's learning documents have it.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [part.split()[0] for part in BLOCKS.split(", ")]
        kinds = [pa.int64(), pa.int64(), pa.bool_(), pa.int64(), pa.binary(), pa.binary(), pa.string(),
                 pa.int32(), pa.int64()]
        first = TaskContext.get().partitionId() << 24
        # how often each word was learnt grows with the dictionary, not with the documents
        numbers, learnt, block = _Numbers(), np.zeros(1 << 16, np.int64), first

        def batch_of(**columns) -> pa.RecordBatch:
            size = len(next(iter(columns.values())))
            arrays = [
                pa.array(columns[n], k) if n in columns else pa.nulls(size, k)
                for n, k in zip(names, kinds, strict=True)
            ]
            return pa.RecordBatch.from_arrays(arrays, names)

        def dictionary() -> Iterator[pa.RecordBatch]:
            words = list(numbers)
            for start in range(0, len(words), 10_000):
                some = words[start : start + 10_000]
                yield batch_of(
                    block=np.full(len(some), block), word=[w.decode() for w in some],
                    number=np.arange(start, start + len(some), dtype=np.int32),
                    train=learnt[start : start + len(some)],
                )

        for batch in batches:
            ids, held = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for start, stop in pieces_of(batch.column(2), BATCH_BYTES):
                out = {"block": [], "doc_id": [], "held_out": [], "n_tokens": [], "places": [], "times": []}
                for i in range(start, stop):
                    words = batch.column(2)[i].as_py().encode().lower().split()
                    found = np.fromiter(map(numbers.__getitem__, words), np.uint32, len(words))
                    places, times = np.unique(found, return_counts=True)
                    times = times.astype(np.uint32)
                    if len(learnt) < len(numbers):
                        learnt = np.concatenate((learnt, np.zeros(max(len(learnt), len(numbers)), np.int64)))
                    if not held[i]:
                        learnt[places] += times
                    row = block, ids[i], held[i], len(words) + 1, places.tobytes(), times.tobytes()
                    for column, value in zip(out.values(), row, strict=True):
                        column.append(value)
                yield batch_of(**out)
                if len(numbers) >= BLOCK_WORDS:
                    yield from dictionary()
                    numbers, learnt, block = _Numbers(), np.zeros(1 << 16, np.int64), block + 1
        if numbers:
            yield from dictionary()

    return rows.mapInArrow(run, BLOCKS)


def _learnt_weights(words: DataFrame, path: str, settings: Settings) -> np.ndarray:
    """Log weights of the pieces: the given scores, fitted to the distinct words of ``words``.

    Each round counts how often each piece is expected in the segmentations of every word,
    once per distinct word, since whole words stand for themselves and pieces are for the
    words not seen; ``prior`` counts go to the given weights. What a task returns has
    the vocabulary's size.
    """
    spark = words.sparkSession
    pieces = vocabulary(path)
    given = pieces.given(settings)
    logp = given
    for _ in range(settings.rounds):
        shared = spark.sparkContext.broadcast(logp)

        def count(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            own = vocabulary(path)
            counts = np.zeros(own.size)
            for table in gathered(batches, WORD_BATCH):
                some = [w.encode() for w in table.column(0).to_pylist()]
                for rows, raw in by_length(some):
                    counts += expected(own.arcs(raw), len(rows), shared.value, own.size)
            yield pa.RecordBatch.from_arrays(
                [pa.array([0], pa.int64()), pa.array([counts.tobytes()], pa.binary())], ["at", "counts"]
            )

        def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = np.zeros(len(given))
            for batch in batches:
                for value in batch.column(1):
                    total += np.frombuffer(value.as_py())
            yield pa.RecordBatch.from_arrays(
                [pa.array([0], pa.int64()), pa.array([total.tobytes()], pa.binary())], ["at", "counts"]
            )

        parts = words.select("word").mapInArrow(count, "at bigint, counts binary")
        level = parts.repartition(16).mapInArrow(add, "at bigint, counts binary")
        row = level.repartition(1).mapInArrow(add, "at bigint, counts binary").first()
        counts = np.frombuffer(row["counts"]) if row else np.zeros(len(given))
        weights = counts + settings.prior * np.exp(given)
        logp = np.log(np.maximum(weights, 1e-300)) - np.log(weights.sum())
    return logp


def document_scores(
    docs: DataFrame,
    path: str,
    settings: Settings | None = None,
    doc_id: str = "doc_id",
    text: str = "text",
) -> DataFrame:
    """``doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score`` per row.

    Tokens are the words ``[^\\x20\\x09-\\x0D]+`` with A-Z lowered, then one end. The base is
    a unigram of tokens with 0.1 added to each count. The model's score is the log10
    probability of the text, summed over all segmentations into the pieces of an
    existing vocabulary (``path``) and whole known words: a word is a lattice whose arcs
    are the pieces that spell it, the first with the word mark, with weight ``d``, and
    one arc over the whole word with its share of the training tokens, with weight
    ``1 - d``; ``d`` is the share of words seen once, which estimates how many are new. A
    forward recursion in log space sums the lattice. Pieces do not cross words, so
    the document's marginal is the sum of its words' and the end's.

    Documents whose crc32 of the id is 0 modulo ``folds`` are held out: nothing is learnt
    from them. Each task numbers the words of its documents and writes dictionaries of
    bounded size; only these move, once by word, to be counted and scored, and once by
    block, to meet their documents. A word has one row per block, so no word is hot.

    Null texts count as empty: one token, the end. Null ids and repeated rows get a row
    each. Without training rows all counts are zero: the base is as its formula gives, all
    weight is on pieces, and the end is certain. An empty table gives no rows. Further
    columns are ignored.
    """
    settings = settings or Settings()
    spark = docs.sparkSession
    configure(spark)
    rows = docs.selectExpr(
        f"cast(`{doc_id}` AS BIGINT) AS doc_id",
        f"{remainder(doc_id, settings.folds)} = 0 AS held_out",
        f"{utf8(text)} AS text",
    )
    blocks = stored(_blocks(rows), "blocks")
    texts = blocks.where("word IS NULL").select("block", "doc_id", "held_out", "n_tokens", "places", "times")
    words = stored(
        blocks.where("word IS NOT NULL").selectExpr(
            "word", "block", "number",
            "sum(train) OVER (PARTITION BY word) AS known",
            "row_number() OVER (PARTITION BY word ORDER BY block, number) = 1 AS first",
        ),
        "words",
    )
    seen = words.where("first AND known > 0").selectExpr(
        "count(1) AS kinds", "coalesce(sum(known), 0) AS total", "count_if(known = 1) AS once"
    ).first()
    ends = texts.where("NOT held_out").count()
    total = seen["total"] + ends
    kinds = seen["kinds"] + (ends > 0)
    unseen = min(max(seen["once"] / total, 1e-6), 0.5) if total else 1.0
    logp = _learnt_weights(words.where("first AND known > 0"), path, settings)
    shared = spark.sparkContext.broadcast(logp)

    def log_known(known: np.ndarray) -> np.ndarray:
        with np.errstate(divide="ignore"):
            return np.log(known / max(total, 1)) + np.log1p(-unseen)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = vocabulary(path)
        held: list[tuple[np.ndarray, ...]] = []
        size = 0

        def deal() -> pa.RecordBatch:
            block, number, known, logs = (np.concatenate(x) for x in zip(*held, strict=True))
            order = np.argsort(block, kind="stable")
            block = block[order]
            names, starts = np.unique(block, return_index=True)
            cuts = [slice(a, b) for a, b in zip(starts, [*starts[1:], len(block)], strict=True)]
            parts = [x[order] for x in (number.astype("<u4"), known.astype("<i8"), logs)]
            columns = [[part[cut].tobytes() for cut in cuts] for part in parts]
            return pa.RecordBatch.from_arrays(
                [pa.array(names), *[pa.array(c, pa.binary()) for c in columns]],
                ["block", "numbers", "known", "logs"],
            )

        for table in gathered(batches, WORD_BATCH):
            names = table.column(0).combine_chunks().dictionary_encode()
            distinct = [w.encode() for w in names.dictionary.to_pylist()]
            logs = marginals(own, distinct, shared.value)[names.indices.to_numpy()]
            known = table.column(3).to_numpy().astype(np.float64)
            if total:
                logs = np.logaddexp(log_known(known), logs + np.log(unseen))
            held.append((table.column(1).to_numpy(), table.column(2).to_numpy(), known, logs))
            size += len(logs)
            if size >= DEALT_ROWS:
                yield deal()
                held, size = [], 0
        if held:
            yield deal()

    scored = words.select("word", "block", "number", "known").mapInArrow(
        score, "block bigint, numbers binary, known binary, logs binary"
    )

    def finish(key, docs: pa.Table, parts: pa.Table) -> pa.Table:
        numbers, known, logs = (
            np.concatenate([np.frombuffer(x.as_py(), kind) for x in parts[name]] or [np.zeros(0, kind)])
            for name, kind in (("numbers", "<u4"), ("known", "<i8"), ("logs", "<f8"))
        )
        count, log = np.zeros(len(numbers), np.int64), np.zeros(len(numbers))
        count[numbers], log[numbers] = known, logs
        smooth = np.log10((count + 0.1) / (total + 0.1 * (kinds + 1)))
        end_base = np.log10((ends + 0.1) / (total + 0.1 * (kinds + 1)))
        end_log = np.log(ends / total) + np.log1p(-unseen) if ends else 0.0
        n_known, base, scores = [], [], []
        for places, times in zip(docs["places"], docs["times"], strict=True):
            at = np.frombuffer(places.as_py(), np.uint32)
            n = np.frombuffer(times.as_py(), np.uint32).astype(np.int64)
            n_known.append(int(n[count[at] > 0].sum()) + (ends > 0))
            base.append(float(smooth[at] @ n + end_base))
            scores.append(float((log[at] @ n + end_log) / np.log(10)))
        return pa.table(
            {
                "doc_id": docs["doc_id"], "held_out": docs["held_out"], "n_tokens": docs["n_tokens"],
                "n_known": pa.array(n_known, pa.int64()),
                "train_tokens": pa.array([total] * len(docs), pa.int64()),
                "base_score": pa.array(base, pa.float64()), "score": pa.array(scores, pa.float64()),
            }
        )

    return texts.groupBy("block").cogroup(scored.groupBy("block")).applyInArrow(
        finish,
        "doc_id bigint, held_out boolean, n_tokens bigint, n_known bigint, train_tokens bigint, "
        "base_score double, score double",
    )
