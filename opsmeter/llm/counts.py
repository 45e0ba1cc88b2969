"""Token counts: batches of distinct words, lengths only."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from opsmeter.llm.common import configure, pieces_of, text_buffer, utf8

# bytes of text that are split and counted at a time
BATCH_BYTES = 1 << 20
# words whose counts a worker remembers; it starts anew beyond that
MEMORY_WORDS = 600_000
# bytes of words given to the tokenizer at a time
ENCODE_BYTES = 1 << 16
# marks that end words so often that they are counted apart
MARKS = ".,;:!?"


class WordCounter:
    """Token counts of texts for a tokenizer whose tokens never reach across white space.

    A text is cut at ASCII white space, which is safe for such a tokenizer whatever the
    text's length. The distinct unknown words go to the library in batches of bounded
    bytes; only their numbers of tokens are kept.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_padding()
        self.tokenizer.no_truncation()
        self.counts: dict[str, int] = {}

    def _learn(self, words: set[str]) -> None:
        """Count new words; what differs in case or a last mark only is encoded once.

        A mark behind a letter is a token sequence of its own, and letters are lowered
        one by one: both hold for the tokenizers this class is made for.
        """
        cores = {word: _core(word) for word in words}
        batch, size = [], 0
        for core in {core for core, _ in cores.values()}.difference(self.counts):
            batch.append(core)
            size += len(core)
            if size >= ENCODE_BYTES:
                self._encode(batch)
                batch, size = [], 0
        self._encode(batch + [mark for mark in MARKS if mark not in self.counts])
        get = self.counts.__getitem__
        self.counts.update({word: get(core) + (get(mark) if mark else 0) for word, (core, mark) in cores.items()})

    def _encode(self, words: list[str]) -> None:
        """Count the tokens of ``words`` from one encoding of them all, by their places."""
        if not words:
            return
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        starts = np.concatenate(([0], np.cumsum(sizes + 1)[:-1]))
        found = self.tokenizer.encode(" ".join(words), add_special_tokens=False)
        places = np.fromiter((start for start, _ in found.offsets), np.int64, len(found))
        counts = np.bincount(np.searchsorted(starts, places, "right") - 1, minlength=len(words))
        self.counts.update(zip(words, counts.tolist(), strict=True))

    def count(self, texts: list[str]) -> np.ndarray:
        split = [_words(text) for text in texts]
        words = set().union(*split)
        if len(self.counts) + len(words) > MEMORY_WORDS:
            self.counts = {}
        self._learn(words.difference(self.counts))
        get = self.counts.__getitem__
        return np.fromiter((sum(map(get, words)) for words in split), np.int64, len(split))


def _core(word: str) -> tuple[str, str]:
    mark = word[-1] if word[-1] in MARKS and word[:-1].isalpha() else ""
    core = word[:-1] if mark else word
    return (core.lower() if core.isascii() and core.isalpha() else core), mark


_SPACE = re.compile("[ \t\n\r]+")
# white space of Python's that not every regular expression library takes for such
_OTHER = re.compile("[\x0b\x0c\x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]")


def _words(text: str) -> list[str]:
    if _OTHER.search(text):
        return [word for word in _SPACE.split(text) if word]
    return text.split()


_counters: dict[str, WordCounter] = {}


def token_counts(
    docs: DataFrame, tokenizer: str, limit: int = 2048, doc_id: str = "doc_id", text: str = "text"
) -> DataFrame:
    """``doc_id, n_bytes, n_tokens, over_limit`` for every row of ``docs``.

    ``tokenizer`` is the path of a ``.json`` file of the ``tokenizers`` library that drops
    white space; it must lie at the same place on every executor. Texts are counted whole,
    without added special tokens, and special strings inside them are what the library
    takes them for. Arrow batches are bounded by bytes (``configure``) and processed in
    pieces of ``BATCH_BYTES``, so a piece costs about the same whatever the texts' lengths.

    Null texts count as empty: no bytes, no tokens, not over the limit. Null ids and
    repeated rows give a row each; further columns are ignored; an empty table gives none.
    """
    configure(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counter = _counters.get(tokenizer) or _counters.setdefault(tokenizer, WordCounter(tokenizer))
            texts = batch.column(1)
            parts = [
                counter.count(texts.slice(start, stop - start).to_pylist())
                for start, stop in pieces_of(texts, BATCH_BYTES)
            ]
            tokens = np.concatenate(parts) if parts else np.zeros(0, np.int64)
            _, offsets = text_buffer(texts)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(np.diff(offsets)), pa.array(tokens), pa.array(tokens > limit)],
                ["doc_id", "n_bytes", "n_tokens", "over_limit"],
            )

    rows = docs.selectExpr(f"cast(`{doc_id}` AS BIGINT) AS doc_id", f"{utf8(text)} AS text")
    return rows.mapInArrow(run, "doc_id bigint, n_bytes bigint, n_tokens bigint, over_limit boolean")
