"""Quality classifier: hashed word n-grams, logistic loss, follow-the-regularised-leader."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from opsmeter.llm.common import configure, pieces_of, remainder, sequence_hashes, utf8, word_hashes

BATCH_BYTES = 1 << 20


@dataclass(frozen=True)
class Settings:
    """How the classifier is fitted; ``sample`` bounds the rows it learns from.

    Few rows are gone through more often: until a pass lowers the mean loss of its rows, each
    before the model learns it, by less than the share ``settled``, or ``steps`` rows have
    been learnt from; two passes at least.
    """

    bits: int = 18  # of the hashed weights
    orders: tuple[int, ...] = (1, 2)  # words per n-gram
    sample: int = 12_000  # labelled rows at most, about
    steps: int = 24_000
    settled: float = 0.02
    alpha: float = 1.0
    beta: float = 1.0
    l1: float = 0.01
    l2: float = 0.1


def features(texts: pa.Array, settings: Settings) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct hashed n-grams of each text with values of unit length.

    Returns places and values of all texts one after another, and each text's range. The
    value of an n-gram is the logarithm of one plus its count, over the text's norm; place
    0 is the bias with value 1, which every text has, an empty one nothing else.
    """
    words, bounds = word_hashes(texts)
    size = 1 << settings.bits
    keys = [np.arange(len(texts), dtype=np.uint64) << np.uint64(settings.bits)]
    for order in settings.orders:
        grams = sequence_hashes(words, order)
        lengths = np.maximum(np.diff(bounds) - order + 1, 0)
        owner = np.repeat(np.arange(len(texts), dtype=np.uint64), lengths)
        inside = np.arange(lengths.sum()) - np.repeat(np.cumsum(lengths) - lengths, lengths)
        grams = grams[np.repeat(bounds[:-1], lengths) + inside]
        keys.append((owner << np.uint64(settings.bits)) | (grams % np.uint64(size - 1) + np.uint64(1)))
    keys, counts = np.unique(np.concatenate(keys), return_counts=True)
    owner = (keys >> np.uint64(settings.bits)).astype(np.int64)
    places = (keys & np.uint64(size - 1)).astype(np.int64)
    values = np.log1p(counts)
    values[places == 0] = 0
    norms = np.sqrt(np.bincount(owner, values * values, len(texts)))
    values /= np.maximum(norms, 1e-12)[owner]
    values[places == 0] = 1
    return places, values, np.searchsorted(owner, np.arange(len(texts) + 1))


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -35, 35)))


class Ftrl:
    """Per-coordinate follow-the-regularised-leader for the logistic loss.

    ``z`` gathers gradients less what earlier steps account for, ``n`` their squares; the
    weights follow from both in closed form and are zero while ``|z| <= l1``.
    """

    def __init__(self, settings: Settings):
        self.settings = settings
        self.z = np.zeros(1 << settings.bits)
        self.n = np.zeros(1 << settings.bits)

    def weights(self, at=slice(None)) -> np.ndarray:
        s, z, n = self.settings, self.z[at], self.n[at]
        shrunk = np.sign(z) * np.maximum(np.abs(z) - s.l1, 0)
        return -shrunk / ((s.beta + np.sqrt(n)) / s.alpha + s.l2)

    def learn(self, places: np.ndarray, values: np.ndarray, label: int) -> float:
        """One step; the row's loss before it."""
        weights = self.weights(places)
        margin = float(weights @ values)
        gradient = (sigmoid(margin) - label) * values
        n = self.n[places]
        step = (np.sqrt(n + gradient * gradient) - np.sqrt(n)) / self.settings.alpha
        self.z[places] += gradient - step * weights
        self.n[places] = n + gradient * gradient
        return float(np.logaddexp(0, -margin if label else margin))

    def fit(self, rows: list[tuple[np.ndarray, np.ndarray, int]]) -> int:
        """Go through the rows until the loss settles; how many passes it took."""
        before, done = np.inf, 0
        while rows and (done < 2 or (done + 1) * len(rows) <= self.settings.steps):
            loss = sum(self.learn(*row) for row in rows) / len(rows)
            done += 1
            if loss > (1 - self.settings.settled) * before and done > 1:
                break
            before = loss
        return done


def fit(rows: DataFrame, known: DataFrame, settings: Settings) -> np.ndarray:
    """Weights learnt from the texts of ``rows`` that ``known (doc_id, label, order)`` names.

    Of more than ``settings.sample`` labels those with the smallest ``order`` modulo 2^31
    are drawn, about that many, before any text is read; one task then learns from
    them in that order. Without labels the weights are zero.
    """
    total = known.count()
    if total > settings.sample:
        known = known.where(f"pmod(`order`, {2**31}) < {int(settings.sample / total * 2**31)}")
    # about ``sample`` rows of three numbers: bounded by the parameter whatever the input
    chosen = rows.select("doc_id", "text").join(F.broadcast(known), "doc_id")

    def train(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # only the hashed features of the sample are held, not its texts
        data, order = [], []
        for batch in batches:
            labels = batch.column(1).to_numpy()
            for start, stop in pieces_of(batch.column(2), BATCH_BYTES):
                places, values, bounds = features(batch.column(2).slice(start, stop - start), settings)
                places, values = places.astype(np.int32), values.astype(np.float32)
                for i in range(stop - start):
                    own = slice(bounds[i], bounds[i + 1])
                    data.append((places[own].copy(), values[own].copy(), int(labels[start + i])))
            order.append(batch.column(0).to_numpy())
        model = Ftrl(settings)
        by_hash = np.argsort(np.concatenate(order), kind="stable") if order else []
        model.fit([data[i] for i in by_hash])
        weights = model.weights().astype(np.float64)
        yield pa.RecordBatch.from_arrays([pa.array([weights.tobytes()], pa.binary())], ["weights"])

    one = chosen.selectExpr("pmod(`order`, 2147483648L) AS place", "cast(label AS INT) AS label", "text").repartition(1)
    row = one.mapInArrow(train, "weights binary").first()
    return np.frombuffer(row["weights"]) if row else np.zeros(1 << settings.bits)


def _model(rows: DataFrame, labels: DataFrame, settings: Settings, folds: int, doc_id: str):
    """The broadcast weights, learnt from the labels of rows that are not held out."""
    known = labels.selectExpr(f"cast(`{doc_id}` AS BIGINT) AS doc_id", "quality AS label").where(
        f"label IN (0, 1) AND {remainder('doc_id', folds)} <> 0"
    )
    weights = fit(rows, known.withColumn("order", F.expr("xxhash64(doc_id, 17)")), settings)
    return rows.sparkSession.sparkContext.broadcast(weights)


def _scores(texts: pa.Array, weights: np.ndarray, settings: Settings) -> np.ndarray:
    found = [np.zeros(0)]
    for start, stop in pieces_of(texts, BATCH_BYTES):
        places, values, bounds = features(texts.slice(start, stop - start), settings)
        found.append(sigmoid(np.add.reduceat(weights[places] * values, bounds[:-1])))
    return np.concatenate(found)


def quality_scores(
    docs: DataFrame,
    labels: DataFrame,
    settings: Settings | None = None,
    threshold: float = 0.3,
    folds: int = 5,
    doc_id: str = "doc_id",
    text: str = "text",
) -> DataFrame:
    """``doc_id, held_out, score, predicted`` for every row of ``docs``.

    ``labels`` has ``doc_id`` and ``quality`` (1 good, 0 bad). A document is held out when
    the crc32 of its id as text is 0 modulo ``folds``; labels of held-out documents are
    never read. The score is the sigmoid of a sparse dot product between the hashed n-grams
    of the whole text and the weights, which are small and the same size for any input.

    Null texts count as empty and get the bias's score. Labels that are null, neither 0 nor
    1, or of unknown documents teach nothing; a document labelled twice teaches twice. Null
    ids and repeated rows get a row each. An empty table gives no rows, empty labels the
    score 0.5. Further columns are ignored, whatever their names.
    """
    settings = settings or Settings()
    configure(docs.sparkSession)
    rows = docs.selectExpr(
        f"cast(`{doc_id}` AS BIGINT) AS doc_id",
        f"{remainder(doc_id, folds)} = 0 AS held_out",
        f"{utf8(text)} AS text",
    )
    shared = _model(rows, labels, settings, folds, doc_id)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            scores = _scores(batch.column(2), shared.value, settings)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0), batch.column(1), pa.array(scores),
                    pa.array((scores >= threshold).astype(np.int32)),
                ],
                ["doc_id", "held_out", "score", "predicted"],
            )

    return rows.mapInArrow(score, "doc_id bigint, held_out boolean, score double, predicted int")


def accepted(
    docs: DataFrame,
    labels: DataFrame,
    settings: Settings | None = None,
    threshold: float = 0.3,
    folds: int = 5,
    doc_id: str = "doc_id",
    text: str = "text",
) -> DataFrame:
    """The rows of ``docs`` with a score of ``threshold`` or more, unchanged; as ``quality_scores``."""
    settings = settings or Settings()
    configure(docs.sparkSession)
    rows = docs.selectExpr(f"cast(`{doc_id}` AS BIGINT) AS doc_id", f"{utf8(text)} AS text")
    shared = _model(rows, labels, settings, folds, doc_id)
    names = docs.columns

    def choose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            scores = _scores(batch.column(len(names)), shared.value, settings)
            yield batch.filter(pa.array(scores >= threshold)).select(names)

    scored_text = "quality_text"
    while scored_text in names:
        scored_text += "_"
    return docs.selectExpr("*", f"{utf8(text)} AS `{scored_text}`").mapInArrow(choose, docs.schema)
