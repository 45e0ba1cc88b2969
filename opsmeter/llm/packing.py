"""Token pieces packed into fixed-size sequences by the sum-of-squares rule."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from opsmeter.llm.common import configure, pieces_of, stored, utf8

BATCH_BYTES = 1 << 20
MEMORY_WORDS = 500_000
# pieces that one task packs; their lengths are all it holds
BLOCK_PIECES = 200_000

_SPECIAL = "<|"


class TextEncoder:
    """Ids of a byte-level BPE of the ``tokenizers`` library as little-endian 32-bit bytes.

    Its pattern starts a token at each space between two visible characters, so texts
    are cut there and the parts remembered. ``ranks`` names the same vocabulary as ranks,
    which encode unknown parts faster; parts with special strings, and texts with other
    runs of spaces, go to the library.
    """

    def __init__(self, path: str, ranks: str | None, pattern: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_padding()
        self.tokenizer.no_truncation()
        self.plain = None
        if ranks:
            import base64

            import tiktoken

            with open(ranks, "rb") as file:
                table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, file)}
            self.plain = tiktoken.Encoding("plain", pat_str=pattern, mergeable_ranks=table, special_tokens={})
            names = [self.plain.decode_single_token_bytes(i) for i in range(self.plain.n_vocab)]
            self.leads = np.array([name.startswith(b" ") for name in names])
        self.memory: dict[str, bytes] = {}

    def _whole(self, text: str) -> bytes:
        if self.plain is None or _SPECIAL in text:
            ids = self.tokenizer.encode(text, add_special_tokens=False).ids
        else:
            ids = self.plain.encode_ordinary(text)
        return np.array(ids, "<u4").tobytes()

    def _learn(self, words: list[str]) -> None:
        """Encode words behind spaces; as one text, where each begins at a token with a space."""
        apart = [word for word in words if self.plain is None or _SPECIAL in word]
        self.memory.update((word, self._whole(f" {word}")) for word in apart)
        words = [word for word in words if _SPECIAL not in word] if self.plain else []
        if words:
            ids = np.array(self.plain.encode_ordinary(f" {' '.join(words)}"), "<u4")
            bounds = [*(4 * np.flatnonzero(self.leads[ids])).tolist(), 4 * len(ids)]
            raw = ids.tobytes()
            self.memory.update(
                (word, raw[start:end]) for word, start, end in zip(words, bounds[:-1], bounds[1:], strict=True)
            )

    def encode(self, texts: list[str]) -> list[bytes]:
        split = [text.split(" ") for text in texts]
        words = set().union(*(x[1:] for x in split))
        if len(self.memory) + len(words) > MEMORY_WORDS:
            self.memory = {}
        new = words.difference(self.memory)
        unsafe = {word for word in new if not word or word[0].isspace() or word[-1].isspace()}
        self.memory.update(dict.fromkeys(unsafe))
        self._learn(list(new - unsafe))
        get = self.memory.__getitem__
        out = []
        for text, (first, *rest) in zip(texts, split, strict=True):
            if rest and first and not first[-1].isspace():
                try:
                    out.append(self._whole(first) + b"".join(map(get, rest)))
                    continue
                except TypeError:  # an unsafe part, which has no ids of its own
                    pass
            out.append(self._whole(text))
        return out


_encoders: dict[str, TextEncoder] = {}

PIECES = "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint"


def cut(size: int, limit: int) -> list[tuple[int, int]]:
    """``(start, length)`` of a document's pieces: the first takes what does not fill one."""
    first = size % limit or min(size, limit)
    return [(0, first)] + [(start, limit) for start in range(first, size, limit)]


def token_pieces(
    docs: DataFrame,
    tokenizer: str,
    ranks: str | None = None,
    pattern: str = "",
    limit: int = 2048,
    end_id: int = 0,
    doc_id: str = "doc_id",
    text: str = "text",
    with_ids: bool = False,
) -> DataFrame:
    """The pieces of every row's ids, ``end_id`` added: ``PIECES``, with ``ids`` if asked for.

    Only documents of more than ``limit`` ids are cut. A null text counts as empty and so
    has ``end_id`` alone.
    """
    configure(docs.sparkSession)
    end = np.array([end_id], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            work = _encoders.get(tokenizer)
            if work is None:
                work = _encoders[tokenizer] = TextEncoder(tokenizer, ranks, pattern)
            for first, stop in pieces_of(batch.column(1), BATCH_BYTES):
                out = []
                names = batch.column(0).slice(first, stop - first).to_pylist()
                texts = batch.column(1).slice(first, stop - first).to_pylist()
                for name, ids in zip(names, work.encode(texts), strict=True):
                    ids += end
                    for i, (start, length) in enumerate(cut(len(ids) // 4, limit)):
                        part = ids[4 * start : 4 * (start + length)]
                        out.append((name, i, start, length, zlib.crc32(part), part if with_ids else None))
                columns = list(zip(*out, strict=True))
                kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]
                arrays = [pa.array(c, k) for c, k in zip(columns, kinds, strict=False)]
                if with_ids:
                    flat = np.frombuffer(b"".join(columns[5]), "<u4").astype(np.int32)
                    offsets = np.concatenate(([0], np.cumsum(columns[3]))).astype(np.int32)
                    arrays.append(pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat)))
                yield pa.RecordBatch.from_arrays(
                    arrays, ["doc_id", "piece", "start", "length", "ids_crc32", "ids"][: len(arrays)]
                )

    rows = docs.selectExpr(f"cast(`{doc_id}` AS BIGINT) AS doc_id", f"{utf8(text)} AS text")
    return rows.mapInArrow(run, PIECES + (", ids array<int>" if with_ids else ""))


def sum_of_squares(lengths: np.ndarray, limit: int) -> tuple[np.ndarray, np.ndarray]:
    """Bin and offset of each piece, longest first, as the sum-of-squares rule places them.

    ``open_bins[g]`` counts the bins with residual gap ``g``. A piece of length ``n`` goes
    where the sum of the squared counts gets smallest: from gap ``g`` to ``g - n``
    changes it by ``2 (open_bins[g - n] - open_bins[g]) + 2``, a bin that fills up leaves
    the counts, and a new bin adds ``2 open_bins[limit - n] + 1``. Ties take the tightest
    open bin. Pieces of the full length get bins of their own.
    """
    counts = np.zeros(limit + 1, np.int64)
    bins_of: list[list[int]] = [[] for _ in range(limit + 1)]
    bins, offsets = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
    made = 0
    for i in np.argsort(-lengths, kind="stable").tolist():
        n = int(lengths[i])
        if n == limit:
            bins[i], made = made, made + 1
            continue
        change = 2 * (counts[: limit - n] - counts[n:limit]) + 2
        change[0] = 1 - 2 * counts[n]
        change[counts[n:limit] == 0] = np.iinfo(np.int64).max
        best = int(change.argmin())
        new = 2 * int(counts[limit - n]) + 1
        if change[best] <= new:
            gap = best + n
            place = bins_of[gap].pop()
            counts[gap] -= 1
        else:
            gap, place, made = limit, made, made + 1
        bins[i], offsets[i] = place, limit - gap
        if gap > n:
            bins_of[gap - n].append(place)
            counts[gap - n] += 1
    return bins, offsets


def best_fit(lengths: np.ndarray, limit: int) -> tuple[np.ndarray, np.ndarray]:
    """Bin and offset of each piece, longest first, each into the tightest gap that holds it."""
    bins_of: list[list[int]] = [[] for _ in range(limit + 1)]
    counts = np.zeros(limit + 1, np.int64)
    bins, offsets = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
    made = 0
    for i in np.argsort(-lengths, kind="stable").tolist():
        n = int(lengths[i])
        gap = n + int((counts[n:] > 0).argmax())
        if counts[gap]:
            place = bins_of[gap].pop()
            counts[gap] -= 1
        else:
            gap, place, made = limit, made, made + 1
        bins[i], offsets[i] = place, limit - gap
        if gap > n:
            bins_of[gap - n].append(place)
            counts[gap - n] += 1
    return bins, offsets


def reseated(lengths: np.ndarray, bins: np.ndarray, offsets: np.ndarray, limit: int) -> tuple[np.ndarray, np.ndarray]:
    """The sum-of-squares places, with the bins that the rule left open packed once more.

    The rule fills most bins to the last place by keeping gaps of all sizes open for pieces
    that may come. At the end none comes, and gaps are left over. The pieces of these open bins go
    into the tightest gaps instead, if that needs fewer bins; full bins stay as they are.
    """
    fill = np.bincount(bins, lengths)
    is_open = fill < limit
    chosen = np.flatnonzero(is_open[bins])
    again, at = best_fit(lengths[chosen], limit)
    if not len(chosen) or again.max() + 1 >= is_open.sum():
        return bins, offsets
    full = np.cumsum(~is_open) - 1  # full bins come first, in their order
    bins, offsets = full[bins], offsets.copy()
    bins[chosen], offsets[chosen] = again + (~is_open).sum(), at
    return bins, offsets


def packed(pieces: DataFrame, limit: int = 2048, block: int = BLOCK_PIECES) -> DataFrame:
    """``pieces`` with ``sequence_id`` and ``offset``, their place in sequences of ``limit`` ids.

    The pieces are dealt by a hash of all their columns but the ids into blocks of about
    ``block``; equal rows are counted first and dealt out in turn from there, so neither null
    nor repeated ids gather in a block. One task packs one block, holding its lengths only,
    places them (``sum_of_squares``, then ``reseated``) and numbers its sequences by itself. So no
    task grows with the input, and each block ends with few sequences that are not full. Places do not depend on the order of rows.
    ``pieces`` must be a stored table: it is counted and then read again.
    """
    blocks = max(1, -(-pieces.count() // block))
    columns = pieces.columns
    keys = [name for name in columns if name != "ids"]
    equal = pieces.groupBy(*columns).agg(F.count(F.lit(1)).alias("copies"))
    turns = equal.withColumn("turn", F.expr(f"explode(sequence(0L, least(copies, {blocks}L) - 1))"))
    dealt = turns.selectExpr(
        *columns,
        f"cast(pmod(pmod(xxhash64({', '.join(keys)}), {blocks}) + turn, {blocks}) AS INT) AS block",
        f"copies div {blocks} + IF(turn < copies % {blocks}, 1, 0) AS share",
    )

    def pack(table: pa.Table) -> pa.Table:
        table = table.sort_by([(name, "ascending") for name in keys])
        table = table.take(pa.array(np.repeat(np.arange(len(table)), table["share"].to_numpy())))
        lengths = table["length"].to_numpy()
        bins, offsets = reseated(lengths, *sum_of_squares(lengths, limit), limit)
        base = table["block"][0].as_py() << 32
        return table.select(columns).append_column("sequence_id", pa.array(bins + base)).append_column(
            "offset", pa.array(offsets)
        )

    schema = ", ".join(f"`{name}` {kind}" for name, kind in pieces.dtypes)
    return dealt.groupBy("block").applyInArrow(pack, f"{schema}, sequence_id bigint, offset bigint")


def packed_documents(docs: DataFrame, tokenizer: str, limit: int = 2048, **options) -> DataFrame:
    """All pieces of ``docs`` with their place, as ``token_pieces`` and ``packed`` say.

    Null texts count as empty and take one id. Null ids and repeated rows get pieces of
    their own, each row its own place. An empty table gives no rows. Further columns are
    ignored.
    """
    return packed(stored(token_pieces(docs, tokenizer, limit=limit, **options), "pieces"), limit)
