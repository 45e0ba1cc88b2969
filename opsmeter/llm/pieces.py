"""SentencePiece encoding with the source span of every piece, and decoding."""

from __future__ import annotations

import hashlib
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from opsmeter.llm.common import configure, pieces_of, utf8

MARK = "▁"  # stands for a space inside pieces
BATCH_BYTES = 1 << 20
MEMORY_WORDS = 400_000


def _fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """Numbered fields of a serialised protocol buffer message."""

    def number() -> int:
        nonlocal at
        value = shift = 0
        while True:
            byte = data[at]
            at += 1
            value |= (byte & 127) << shift
            shift += 7
            if byte < 128:
                return value

    at = 0
    while at < len(data):
        tag = number()
        kind = tag & 7
        if kind == 0:
            yield tag >> 3, number()
            continue
        size = number() if kind == 2 else {1: 8, 5: 4}[kind]
        yield tag >> 3, data[at : at + size]
        at += size


class CharacterMap:
    """The compiled map of a normaliser: prefixes of UTF-8 text and what replaces them.

    The blob holds the byte size of a double-array trie, the trie's 32-bit units, and the
    replacements, each ended by a zero byte.
    """

    def __init__(self, blob: bytes):
        self.units: list[int] = []
        self.pool = b""
        if blob:
            (size,) = struct.unpack_from("<I", blob)
            self.units = list(struct.unpack_from(f"<{size // 4}I", blob, 4))
            self.pool = blob[4 + size :]

    @staticmethod
    def _jump(unit: int) -> int:
        return (unit >> 10) << ((unit & (1 << 9)) >> 6)

    def longest(self, data: bytes, at: int) -> tuple[int, bytes] | None:
        """Length and replacement of the longest mapped prefix of ``data[at:]``."""
        units = self.units
        if not units:
            return None
        found = None
        node = self._jump(units[0])
        for i in range(at, len(data)):
            node ^= data[i]
            if node >= len(units):
                break
            unit = units[node]
            if unit & ((1 << 31) | 0xFF) != data[i]:
                break
            node ^= self._jump(unit)
            if unit >> 8 & 1:
                found = (i + 1 - at, units[node] & 0x7FFFFFFF)
        if found is None:
            return None
        start = found[1]
        return found[0], self.pool[start : self.pool.index(b"\0", start)]


class Normalizer:
    """Text to the bytes that the pieces spell, with the source offset of each byte."""

    def __init__(self, model: bytes):
        spec = b""
        for field, value in _fields(model):
            if field == 3:
                spec = value
        known = {2: b"", 3: 1, 4: 1, 5: 1, **dict(_fields(spec))}
        self.map = CharacterMap(known[2])
        self.prefix, self.squeeze, self.escape = bool(known[3]), bool(known[4]), bool(known[5])

    def run(self, text: str) -> tuple[bytes, np.ndarray]:
        """Normalised bytes and, for each of them and the end, the source byte it starts at.

        All bytes that replace one mapped prefix point to that prefix's first byte.
        """
        source = text.encode()
        space = MARK.encode() if self.escape else b" "
        if not source:
            return b"", np.zeros(1, np.int64)
        if self.map.units or self.squeeze:
            return self._slow(source, space)
        raw = np.frombuffer(source, np.uint8)
        width = np.where(raw == 32, len(space), 1)
        origin = np.repeat(np.arange(len(raw)), width)
        body = source.replace(b" ", space)
        if self.prefix:
            body, origin = space + body, np.concatenate((np.zeros(len(space), np.int64), origin))
        return body, np.append(origin, len(raw))

    def _slow(self, source: bytes, space: bytes) -> tuple[bytes, np.ndarray]:
        chunks, at = [], 0
        while at < len(source):
            hit = self.map.longest(source, at)
            if hit is None:
                lead = source[at]
                size = 1 if lead < 0x80 else 2 if lead < 0xE0 else 3 if lead < 0xF0 else 4
                hit = size, source[at : at + size]
            chunks.append((at, hit[1]))
            at += hit[0]
        end = len(source)
        if self.squeeze:
            while chunks and not chunks[0][1].strip(b" "):
                chunks.pop(0)
            if not chunks:
                return b"", np.array([end])
        out, origin = bytearray(), []
        if self.prefix:
            out += space
            origin += [chunks[0][0]] * len(space)
        blank = self.squeeze
        for start, text in chunks:
            for byte in text:
                if byte == 32 and self.squeeze and blank:
                    continue
                blank = byte == 32
                piece = space if byte == 32 else bytes([byte])
                out += piece
                origin += [start] * len(piece)
        if self.squeeze:
            while out.endswith(space):
                end = origin[-1]
                del out[-len(space) :], origin[-len(space) :]
        return bytes(out), np.append(np.array(origin, np.int64), end)


class PieceEncoder:
    """Ids exactly as the library gives them, their source spans, and decoding.

    No piece of the vocabulary has a space mark behind another character and the mark is
    written before each word, so merges never cross a single space: words between single
    spaces are encoded once and remembered. Texts with other spaces, and vocabularies or
    normalisers without that property, go to the library whole.
    """

    def __init__(self, path: str):
        import sentencepiece

        with open(path, "rb") as file:
            model = file.read()
        self.library = sentencepiece.SentencePieceProcessor(model_proto=model)
        self.normalizer = Normalizer(model)
        size = self.library.get_piece_size()
        names = [self.library.id_to_piece(i) for i in range(size)]
        self.single = np.array([self.library.is_byte(i) for i in range(size)])
        self.unknown = self.library.unk_id()
        self.widths = np.where(self.single, 1, [len(name.encode()) for name in names])
        self.leads = np.array([name.startswith(MARK) for name in names])
        plain = self.normalizer
        self.by_word = (
            not plain.map.units and plain.prefix and plain.escape and not plain.squeeze
            and all(MARK not in name.lstrip(MARK) for name in names)
        )
        self.memory: dict[str, bytes] = {}
        self.numbers = [str(i) for i in range(size)]

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """Ids of each text, without begin or end ids."""
        whole, split = [], []
        for text in texts:
            words = text.split(" ") if self.by_word and MARK not in text else [""]
            split.append(words if all(words) else None)
            if split[-1] is None:
                whole.append(text)
        words = set().union(*(x for x in split if x))
        if len(self.memory) + len(words) > MEMORY_WORDS:
            self.memory = {}
        self._learn(list(words.difference(self.memory)))
        rest = iter(self.library.encode(whole, num_threads=1) if whole else [])
        get = self.memory.__getitem__
        return [
            np.array(next(rest), np.uint32) if x is None else np.frombuffer(b"".join(map(get, x)), np.uint32)
            for x in split
        ]

    def _learn(self, words: list[str]) -> None:
        """Encode ``words`` as one text; each begins at a piece that begins with the mark."""
        for first in range(0, len(words), 500):
            some = words[first : first + 500]
            ids = np.array(self.library.encode(" ".join(some)), np.uint32)
            bounds = [*(4 * np.flatnonzero(self.leads[ids])).tolist(), 4 * len(ids)]
            raw = ids.tobytes()
            self.memory.update(
                (word, raw[start:end]) for word, start, end in zip(some, bounds[:-1], bounds[1:], strict=True)
            )

    def spans(self, text: str, ids: np.ndarray) -> np.ndarray:
        """Source bytes ``[start, end)`` of each id: the bytes its piece was made from.

        Pieces made from parts of one mapped prefix share that prefix's span.
        """
        body, origin = self.normalizer.run(text)
        widths = self.widths[ids]
        unknown = np.flatnonzero(ids == self.unknown)
        if len(unknown):
            widths = widths.copy()
            self._unknown_widths(body, ids, widths, unknown)
        ends = np.cumsum(widths)
        if len(body) != (ends[-1] if len(ends) else 0):
            raise ValueError("pieces do not spell the normalised text")
        starts = ends - widths
        begin = origin[starts]
        # the first source byte after this piece's last one's origin
        after = np.searchsorted(origin, origin[ends - 1], "right") if len(ends) else ends
        return np.stack((begin, origin[np.minimum(after, len(origin) - 1)]), 1)

    def _unknown_widths(self, body, ids, widths, unknown) -> None:
        """An unknown id covers the text up to the next known piece."""
        at = 0
        places = set(unknown.tolist())
        for i in range(len(ids)):
            if i in places:
                if i + 1 < len(ids):
                    following = self.library.id_to_piece(int(ids[i + 1])).encode()
                    widths[i] = body.index(following, at + 1) - at
                else:
                    widths[i] = len(body) - at
            at += int(widths[i])

    def decode(self, ids: list[list[int]]) -> list[str]:
        return self.library.decode(ids, num_threads=1)


_encoders: dict[str, PieceEncoder] = {}


def encoder(path: str) -> PieceEncoder:
    return _encoders.get(path) or _encoders.setdefault(path, PieceEncoder(path))



def piece_tokens(docs: DataFrame, model: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, ids, starts, ends, decoded`` of every row: ids, their source bytes, text again.

    ``model`` is the path of a SentencePiece model at the same place on every executor.
    Normalisation replaces the longest prefix that the model's compiled character map
    knows and records where each byte came from; pieces are projected through that
    alignment to ``[start, end)`` in the UTF-8 bytes of the text. Whole texts, no sampling,
    no begin or end ids. Null texts count as empty: no ids, empty text. Null ids and
    repeated rows give a row each; further columns are ignored; an empty table gives none.
    """
    configure(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            work = encoder(model)
            for start, stop in pieces_of(batch.column(1), BATCH_BYTES):
                texts = batch.column(1).slice(start, stop - start).to_pylist()
                ids = work.encode(texts)
                spans = [work.spans(t, i) for t, i in zip(texts, ids, strict=True)]
                offsets = np.concatenate(([0], np.cumsum([len(i) for i in ids]))).astype(np.int32)
                flat = np.concatenate(spans) if spans else np.zeros((0, 2), np.int64)

                def lists(values: np.ndarray, offsets=offsets) -> pa.Array:
                    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values))

                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(start, stop - start),
                        lists(np.concatenate(ids).astype(np.int32)),
                        lists(np.ascontiguousarray(flat[:, 0], np.int32)),
                        lists(np.ascontiguousarray(flat[:, 1], np.int32)),
                        pa.array(work.decode([i.tolist() for i in ids]), pa.string()),
                    ],
                    ["doc_id", "ids", "starts", "ends", "decoded"],
                )

    rows = docs.selectExpr(f"cast(`{doc_id}` AS BIGINT) AS doc_id", f"{utf8(text)} AS text")
    return rows.mapInArrow(
        run, "doc_id bigint, ids array<int>, starts array<int>, ends array<int>, decoded string"
    )


def piece_digests(docs: DataFrame, model: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, n_tokens, n_bytes_spanned, ids_sha256, decoded_sha256`` of every row.

    The same encoding, projection and decoding as ``piece_tokens`` (same edge cases), of
    which only digests leave the task: of the decimal ids joined by commas, and of the
    decoded text. ``n_bytes_spanned`` is where the last piece's span ends, the text's size
    unless its end vanishes in normalisation.
    """
    configure(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            work = encoder(model)
            sizes, spanned, of_ids, of_text = [], [], [], []
            for start, stop in pieces_of(batch.column(1), BATCH_BYTES):
                texts = batch.column(1).slice(start, stop - start).to_pylist()
                encoded = work.encode(texts)
                for text, ids in zip(texts, encoded, strict=True):
                    spans = work.spans(text, ids)
                    spanned.append(int(spans[-1, 1]) if len(ids) else 0)
                plain = [ids.tolist() for ids in encoded]
                for ids, text in zip(plain, work.decode(plain), strict=True):
                    sizes.append(len(ids))
                    joined = ",".join(map(work.numbers.__getitem__, ids))
                    of_ids.append(hashlib.sha256(joined.encode()).hexdigest())
                    of_text.append(hashlib.sha256(text.encode()).hexdigest())
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0), pa.array(sizes, pa.int64()), pa.array(spanned, pa.int64()),
                    pa.array(of_ids, pa.string()), pa.array(of_text, pa.string()),
                ],
                ["doc_id", "n_tokens", "n_bytes_spanned", "ids_sha256", "decoded_sha256"],
            )

    rows = docs.selectExpr(f"cast(`{doc_id}` AS BIGINT) AS doc_id", f"{utf8(text)} AS text")
    return rows.mapInArrow(
        run,
        "doc_id bigint, n_tokens bigint, n_bytes_spanned bigint, ids_sha256 string, decoded_sha256 string",
    )
