"""Exact duplicates with a disk-backed streaming state."""

from __future__ import annotations

from collections.abc import Callable
from contextlib import contextmanager
from uuid import uuid4

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from opsmeter.llm.common import columns_of, fresh, new_folder, stored, utf8

STATE_SETTINGS = {
    "spark.sql.streaming.stateStore.providerClass": (
        "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
    ),
    # write changes only; snapshots follow in the background
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
}
# The number of state partitions is fixed when a state is first used, so it follows the rows
# logged then and not the session's shuffles; each RocksDB instance has files of its own.
STATE_PARTITIONS_CONF = "spark.sql.streaming.internal.stateStore.partitions"
ROWS_PER_STATE = 250_000
# bits of the filter of places whose texts are compared: 8 MB whatever the input
FILTER_BITS = 26


@contextmanager
def _settings(spark: SparkSession, values: dict[str, str]):
    before = {name: spark.conf.get(name, None) for name in values}
    for name, value in values.items():
        spark.conf.set(name, value)
    try:
        yield
    finally:
        for name, value in before.items():
            spark.conf.unset(name) if value is None else spark.conf.set(name, value)


def sha256(text: Column) -> Column:
    return F.sha2(text.cast("binary"), 256)


class DedupState:
    """Digests seen so far, each with its group's size, largest id and where that text lies.

    ``folder`` holds the contents (``id, body``), a log of ``(digest, size, id, locator)``, and
    the checkpoint of a streaming aggregation over the log, whose RocksDB state never expires.
    A locator is the name of a file of the contents and the row in it. ``add`` stores
    and logs a batch of documents and lets the stream take it in; ``groups`` reads the
    state; ``hit_texts`` reads the contents of all that share a digest. A stream that died resumes from its
    checkpoint with the next ``add``.
    """

    CONTENT = "id bigint, body string"
    SCHEMA = "digest string, size bigint, id bigint, locator string"

    def __init__(self, spark: SparkSession, folder: str, digest: Callable[[Column], Column] = None):
        self.spark, self.folder, self.digest = spark, folder, digest or sha256

    @property
    def log(self) -> DataFrame:
        return self.spark.read.schema(self.SCHEMA).parquet(f"{self.folder}/log")

    @property
    def contents(self) -> DataFrame:
        """``id, body, locator`` of everything added so far."""
        rows = self.spark.read.schema(self.CONTENT).parquet(f"{self.folder}/content/*")
        return rows.selectExpr("id", "body", "concat(_metadata.file_name, ':', _metadata.row_index) AS locator")

    def add(self, docs: DataFrame) -> None:
        """Store and log ``docs (id, body)`` and run the stream until it has seen them all."""
        batch = f"{self.folder}/content/{uuid4()}"
        docs.write.option("compression", "zstd").parquet(batch)
        stored_rows = self.spark.read.schema(self.CONTENT).parquet(batch)
        logged = stored_rows.select(
            self.digest(F.col("body")).alias("digest"),
            F.octet_length("body").cast("bigint").alias("size"),
            "id",
            F.expr("concat(_metadata.file_name, ':', _metadata.row_index)").alias("locator"),
        )
        logged.write.mode("append").option("compression", "zstd").parquet(f"{self.folder}/log")
        states = max(4, -(-self.log.count() // ROWS_PER_STATE))
        with _settings(self.spark, STATE_SETTINGS | {STATE_PARTITIONS_CONF: str(states)}):
            stream = self.spark.readStream.schema(self.SCHEMA).parquet(f"{self.folder}/log")
            grouped = stream.groupBy("digest", "size").agg(
                F.max(F.struct("id", "locator")).alias("kept"), F.count(F.lit(1)).alias("copies")
            )
            grouped.writeStream.format("noop").outputMode("update").option(
                "checkpointLocation", f"{self.folder}/state"
            ).trigger(availableNow=True).start().awaitTermination()

    def groups(self) -> DataFrame:
        """``(digest, size, keep_id, locator, group_size)`` of every digest in the state."""
        with _settings(self.spark, STATE_SETTINGS):
            state = self.spark.read.format("statestore").load(f"{self.folder}/state")
        kept, copies = state.schema["value"].dataType.names
        return state.select(
            "key.*",
            F.col(f"value.{kept}.id").alias("keep_id"),
            F.col(f"value.{kept}.locator").alias("locator"),
            F.col(f"value.{copies}").alias("group_size"),
        )

    def hit_texts(self, hits: DataFrame) -> DataFrame:
        """``digest, size, body, id, locator`` of the rows with a digest of ``hits``, and few others.

        The log says where their texts lie. A filter of fixed size, one bit for the hash of each
        of these places, goes to the tasks that scan the contents; a text whose
        place is not among them goes no further. What else passes by chance does no harm.
        """
        wanted = self.log.join(hits.select("digest", "size").hint("merge"), ["digest", "size"], "left_semi")
        place = f"pmod(xxhash64(locator), {1 << FILTER_BITS}L) + 1"
        bits = wanted.selectExpr(f"{place} AS place").groupBy(
            F.expr("bitmap_bucket_number(place)").alias("of_bucket")
        ).agg(F.expr("bitmap_construct_agg(bitmap_bit_position(place))").alias("bits"))
        # at most 2^26 bits in buckets of 4 KB: 8 MB whatever the input
        bits = F.broadcast(stored(bits, "filter"))
        scanned = self.contents.selectExpr("*", f"{place} AS place").selectExpr(
            "*", "bitmap_bucket_number(place) AS bucket", "bitmap_bit_position(place) AS bit"
        )
        byte = "cast(conv(hex(substring(bits, cast(bit div 8 + 1 AS INT), 1)), 16, 10) AS INT)"
        found = scanned.join(bits, F.expr("bucket = of_bucket")).where(
            f"(shiftright({byte}, cast(bit % 8 AS INT)) & 1) = 1"
        )
        return found.select(
            self.digest(F.col("body")).alias("digest"),
            F.octet_length("body").cast("bigint").alias("size"),
            "body", "id", "locator",
        )


def exact_groups(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", digest=None
) -> DataFrame:
    """One row per row of ``docs``: ``doc_id, keep_id, group_size, kept, text_sha256``.

    Rows with identical texts form a group, of which the largest id stays; nothing is
    normalised. The documents run through ``DedupState``. Wherever it reports a hit, the
    full bytes of that digest's texts are read back by their locators and compared: they are
    grouped by text, so copies collapse in every task before they move, and no other text
    moves at all. Should texts share a digest without being equal, their
    rows are grouped by the text itself.

    A null text counts as empty, and empty texts are a group like any other. Null ids
    never beat others; if a group has no id, ``keep_id`` is null and all its rows stay.
    Rows that repeat an id and its text are one document listed twice: both get the same
    answer and both count in ``group_size``. Further columns are ignored, whatever their
    names; an empty table gives no rows.

    ``digest`` maps a text column to a string column, SHA-256 if not given; tests pass a weak one.
    """
    spark = docs.sparkSession
    state = DedupState(spark, new_folder(spark, "dedup"), digest)
    state.add(docs.select(F.col(f"`{doc_id}`").cast("bigint").alias("id"), F.expr(utf8(text)).alias("body")))

    hits = stored(state.groups().where("group_size > 1"), "hits")
    suspects = state.hit_texts(hits)
    variants = stored(
        suspects.groupBy("digest", "size", "body").agg(
            F.max(F.struct("id", "locator")).alias("kept"), F.count(F.lit(1)).alias("group_size")
        ).select("digest", "size", "body", F.col("kept.id").alias("keep_id"), "kept.locator", "group_size"),
        "variants",
    )
    key = ["digest", "size"]
    checked = stored(
        variants.groupBy(*key).agg(
            F.count(F.lit(1)).alias("texts"),
            F.max("keep_id").alias("keep_id"),
            F.sum("group_size").alias("group_size"),
        ),
        "checked",
    )
    answer = """id AS doc_id, {keep} AS keep_id, {size} AS group_size,
        id <=> {keep} AS kept, digest AS text_sha256"""
    single = "IF(group_size IS NULL, id, keep_id)"
    result = (
        state.log.join(checked, key, "left")
        .where("texts IS NULL OR texts = 1")
        .selectExpr(*_list(answer.format(keep=single, size="coalesce(group_size, 1L)")))
    )
    clashes = checked.where("texts > 1").select(*key)
    if not clashes.isEmpty():
        clashing = variants.join(clashes, key, "left_semi")
        exact = suspects.drop("locator").join(clashing, [*key, "body"]).selectExpr(
            *_list(answer.format(keep="keep_id", size="group_size"))
        )
        result = result.union(exact)
    return result


def _list(text: str) -> list[str]:
    """The items of a select list without nested commas outside parentheses."""
    items, depth, start = [], 0, 0
    for i, c in enumerate(text):
        depth += (c == "(") - (c == ")")
        if c == "," and not depth:
            items.append(text[start:i])
            start = i + 1
    return [*items, text[start:]]


def without_copies(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns, whatever their names.

    A document listed twice, id and text alike, stays once: the row that is first as JSON
    of all its columns. Groups without any id keep one row, chosen alike. Such rows collapse
    in every task before they move.
    """
    names = fresh(docs, "kept_id", "kept_digest", "kept_rows", "own_digest", "first_row")
    kept_id, kept_digest, kept_rows, own_digest, first_row = names
    groups = exact_groups(docs, doc_id, text)
    chosen = stored(
        groups.where("kept")
        .groupBy(F.col("doc_id").alias(kept_id), F.col("text_sha256").alias(kept_digest))
        .agg(F.count(F.lit(1)).alias(kept_rows)),
        "chosen",
    )
    marked = docs.withColumn(own_digest, sha256(F.expr(utf8(text))))
    own_id = F.col(f"`{doc_id}`").cast("bigint")
    same = own_id.eqNullSafe(F.col(kept_id)) & (F.col(own_digest) == F.col(kept_digest))
    once = marked.join(chosen.where(f"{kept_rows} = 1"), same, "left_semi").drop(own_digest)
    several = chosen.where(f"{kept_rows} > 1")
    if several.isEmpty():
        return once
    row = F.struct(*columns_of(docs))
    firsts = (
        marked.join(several, same, "left_semi")
        .groupBy(own_id.alias(kept_id), F.col(own_digest))
        .agg(F.min_by(row, F.to_json(row, {"ignoreNullFields": "false"})).alias(first_row))
    )
    return once.union(firsts.select(f"{first_row}.*"))
