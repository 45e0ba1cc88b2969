"""A uniformly shuffled, evenly sharded copy of a table, in two passes and SQL only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from opsmeter.llm.common import columns_of, fresh, stored, utf8

# bytes of text in one bucket, about what a task sorts in memory
BUCKET_BYTES = 16 << 20
# tasks that draw the buckets' orders
ORDER_PARTS = 64


def row_size(text: str = "text") -> str:
    """SQL: UTF-8 bytes of the text plus eight for the id."""
    return f"cast(octet_length({utf8(text)}) AS BIGINT) + 8"


def _scattered(docs: DataFrame, buckets: int, seed: int, doc_id: str, text: str, bucket: str, tie: str) -> DataFrame:
    """``docs`` with the number of each row's bucket, and a hash that tells apart what id and text do not.

    A seeded hash of id and text deals the rows. Rows that repeat both would meet in one
    bucket: equal ones are counted first, before they move, and dealt to the buckets in turn from
    where their hash says. Their copies are listed where each bucket's share has arrived.
    """
    names = fresh(docs, "row_key", "repeated_key", "row_json", "own_row", "row_copies", "row_turn", "row_share")
    key, repeated_key, row_json, row, copies, turn, share = names
    kinds = dict(docs.dtypes)
    # hashes take no maps; JSON takes everything
    hashed = ", ".join(f"`{c}`" for c in docs.columns if "map<" not in kinds[c])
    marked = docs.withColumn(key, F.expr(f"xxhash64({seed}, `{doc_id}`, `{text}`)"))
    repeated = stored(
        marked.groupBy(F.col(key).alias(repeated_key)).count().where("count > 1").select(repeated_key),
        "repeated-rows",
    )
    same = F.col(key) == F.col(repeated_key)
    add = [f"cast(pmod({key}, {buckets}) AS BIGINT) AS {bucket}", f"xxhash64({hashed}) AS {tie}"]
    own = [f"`{c}`" for c in docs.columns]
    singles = marked.join(repeated, same, "left_anti").selectExpr(*own, *add)
    if repeated.isEmpty():
        return singles
    whole = F.struct(*columns_of(docs))
    counted = (
        marked.join(repeated, same, "left_semi")
        .groupBy(F.to_json(whole, {"ignoreNullFields": "false"}).alias(row_json), F.col(key))
        .agg(F.first(whole).alias(row), F.count(F.lit(1)).alias(copies))
    )
    dealt = (
        counted.selectExpr("*", f"explode(sequence(0L, least({copies}, {buckets}L) - 1)) AS {turn}")
        .selectExpr(
            f"{row}.*",
            f"cast(pmod(pmod({key}, {buckets}) + {turn}, {buckets}) AS BIGINT) AS {bucket}",
            f"{copies} div {buckets} + IF({turn} < {copies} % {buckets}, 1, 0) AS {share}",
        )
        .repartition(bucket)
        .withColumn(share, F.expr(f"explode(sequence(1L, {share}))"))
        .selectExpr(*own, bucket, add[1])
    )
    return singles.union(dealt)


def shuffled(
    docs: DataFrame,
    shards: int = 24,
    seed: int = 7,
    bucket_bytes: int = BUCKET_BYTES,
    doc_id: str = "doc_id",
    text: str = "text",
) -> DataFrame:
    """The rows of ``docs`` with two more columns, ``shard`` and ``slot``: a random order, dealt out in turn.

    First pass: a seeded hash of id and text scatters the records uniformly into as many
    buckets as ``bucket_bytes`` asks for, and each bucket's rows are counted. Second pass:
    each bucket is put in a fixed order, and a Fisher-Yates shuffle of its places (Spark's
    ``shuffle``, one array of whole numbers per bucket) gives every record a new
    one. With the rows of all earlier buckets before it, that place is the record's
    rank ``r`` in the whole order; it goes to shard ``r mod shards``, slot ``r div shards``.
    So shards differ by one row at most, slots have no gaps, and a record's shard and slot
    are chance, whatever its source, its copies or its neighbours.

    Every bucket is written in its new order, one after another in a task's file, and the result
    reads these files. Records move once, with their texts; sorting them can spill. The rows before a
    bucket are sums over the bucket counts, one row for each ``bucket_bytes`` of input: first
    within 1,024 groups of buckets, then over the groups. The same rows and arguments give
    the same result, whatever the partitions.

    Null ids hash as such, null texts weigh nothing. Repeated rows get a place each and
    are spread over the buckets. All columns stay, whatever their names; should one be called
    ``shard`` or ``slot``, the added column's name ends in an underscore. They are the last
    two. An empty table gives no rows.
    """
    names = fresh(docs, "shard", "slot", "bucket", "place", "tie", "order_", "earlier", "of_bucket", "bucket_rows")
    shard, slot, bucket, place, tie, order, earlier, of_bucket, size = names
    own = [f"`{c}`" for c in docs.columns]
    total = docs.selectExpr(f"sum({row_size(text)}) AS bytes").first()["bytes"] or 0
    buckets = max(1, -(-total // bucket_bytes))
    scattered = _scattered(docs, buckets, seed, doc_id, text, bucket, tie)
    counts = scattered.groupBy(bucket).agg(F.count(F.lit(1)).alias(size))
    counts = stored(counts.selectExpr(f"{bucket} AS bucket", f"{size} AS size", f"pmod({bucket}, 1024) AS part"), "bucket-counts")
    parts = counts.groupBy("part").agg(F.sum("size").alias("part_rows"))
    parts = parts.selectExpr(
        "part AS p",
        """coalesce(sum(part_rows) OVER (ORDER BY part
           ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS part_earlier""",
    )
    inside = counts.selectExpr(
        "bucket", "size", "part",
        """coalesce(sum(size) OVER (PARTITION BY part ORDER BY bucket
           ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS part_inside""",
    )
    # The shuffles draw random numbers by partition and row: always as many partitions, by
    # number, ordered, so that a bucket meets the same ones whatever the session's settings.
    orders = (
        inside.join(F.broadcast(parts), F.col("part") == F.col("p"))
        .selectExpr(f"bucket AS {of_bucket}", "size", f"part_earlier + part_inside AS {earlier}")
        .repartition(ORDER_PARTS, of_bucket)
        .sortWithinPartitions(of_bucket)
        .select(of_bucket, earlier, F.shuffle(F.expr("sequence(0L, size - 1)"), seed).alias(order))
    )
    placed = scattered.selectExpr(
        "*", f"row_number() OVER (PARTITION BY {bucket} ORDER BY `{doc_id}`, `{text}`, {tie}) AS {place}"
    )
    ranked = placed.join(orders, F.col(bucket) == F.col(of_bucket)).selectExpr(
        *own, f"{earlier} + element_at({order}, {place}) AS {place}"
    )
    written = stored(ranked.sortWithinPartitions(place), "buckets")
    return written.selectExpr(
        *own, f"cast(pmod({place}, {shards}) AS INT) AS {shard}", f"{place} div {shards} AS {slot}"
    )


def write_shards(placed: DataFrame, path: str) -> None:
    """Write ``shuffled`` rows, one folder per shard (``shard=<n>``), each in the order of its slots.

    A range of slots of a shard is one task and one file, so a shard larger than a task
    becomes several files, in order by name.
    """
    place = placed.columns[-2:]
    placed.repartitionByRange(*place).sortWithinPartitions(*place).write.partitionBy(place[0]).parquet(path)


def digests(placed: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, size, text_crc32, law, shard, slot, grown_shard`` of shuffled documents."""
    shard, slot = placed.columns[-2:]
    return placed.selectExpr(
        f"cast(`{doc_id}` AS BIGINT) AS doc_id",
        f"{row_size(text)} AS size",
        f"crc32(cast({utf8(text)} AS BINARY)) AS text_crc32",
        "'rows' AS law",
        f"{shard} AS shard",
        f"{slot} AS slot",
        "cast(NULL AS INT) AS grown_shard",
    )
