"""Distinct counts that add up: bitmaps over dense ids, one stored table for all grains."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from opsmeter.operators.ranges import running_total
from opsmeter.operators.staging import stage

# the quarter of a month key
QUARTER = "concat(left(order_month, 4), '-Q', cast(ceil(cast(right(order_month, 2) AS INT) / 3) AS INT))"


def dense_ids(df: DataFrame, key: str, near: str) -> DataFrame:
    """``key, number`` of every key but null: 1, 2, ... without gaps, by the key's least ``near``.

    Keys that occur together in time get numbers side by side, so that the bitmaps of a
    month are few and full.
    """
    keys = df.where(f"{key} IS NOT NULL").groupBy(key).agg(F.min(near).alias("near"), F.lit(1).alias("one"))
    return running_total(keys, ["near", key], "one", "before").selectExpr(key, "before + 1 AS number")


def bitmaps(rows: DataFrame, grains: list[str], measures: dict[str, str], near: str) -> DataFrame:
    """``grains, measure, bucket, bits``: which ids of each measure's key a grain's rows have.

    ``measures`` maps a name to the key whose ids are counted. Ids are numbered first
    (``dense_ids``); a bucket has 32,768 of them, one bit each. The bits of two sets of rows
    are merged by OR, so coarser grains and later loads need no rows. Bits are made in
    each task before they move; a row of the result has at most 4 KB.
    """
    parts = []
    for name, key in measures.items():
        numbers = stage(dense_ids(rows, key, near)).withColumnRenamed(key, "numbered_key")
        placed = rows.select(*grains, key).distinct().join(numbers, F.expr(f"{key} = numbered_key"))
        parts.append(
            placed.groupBy(*grains, F.expr("bitmap_bucket_number(number)").alias("bucket"))
            .agg(F.expr("bitmap_construct_agg(bitmap_bit_position(number))").alias("bits"))
            .selectExpr(*grains, f"'{name}' AS measure", "bucket", "bits")
        )
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def distinct_counts(bits: DataFrame, grain: str, measures: list[str], name: str) -> DataFrame:
    """``grain, value`` and the distinct ids of each measure per value of the SQL ``grain``."""
    merged = bits.groupBy(F.expr(grain).alias("value"), "measure", "bucket").agg(
        F.expr("bitmap_count(bitmap_or_agg(bits))").alias("ids")
    )
    counts = [F.expr(f"coalesce(sum(ids) FILTER (WHERE measure = '{m}'), 0L)").alias(m) for m in measures]
    return merged.groupBy("value").agg(*counts).select(F.lit(name).alias("grain"), "value", *measures)


GRAINS = {"month": "order_month", "quarter": QUARTER, "region": "rep_region", "channel": "channel"}
MEASURES = {"orders": "order_id", "customers": "customer_id"}


def order_bitmaps(orders: DataFrame) -> DataFrame:
    """Orders and customers per month, region and channel, from ``orders_enriched``; worth storing."""
    return bitmaps(orders, ["order_month", "rep_region", "channel"], MEASURES, "order_month")


def reach(stored_bits: DataFrame) -> DataFrame:
    """Distinct orders and customers per month, quarter, region and channel, from one table."""
    out = None
    for name, grain in GRAINS.items():
        counts = distinct_counts(stored_bits, grain, list(MEASURES), name)
        out = counts if out is None else out.unionByName(counts)
    return out
