"""The star as tables whose facts lie together by order."""

from __future__ import annotations

from pyspark.sql import SparkSession

from opsmeter.plans.sales import Star
from opsmeter.sources.star import COLUMNS

BY_ORDER = ("fact_orders", "fact_order_items", "fact_returns")


def write_bucketed(star: Star, database: str, buckets: int) -> None:
    """Write the star as tables of ``database``, the facts in ``buckets`` sorted buckets by order.

    Written once, items, orders and returns then meet by order without moving: ``buckets`` tasks
    each read their bucket of both sides. A bucket should fit a task, so their number
    follows the size of the items. Every writing task adds one file to each bucket it has
    rows of; the rows are dealt by bucket first, so that is one file.
    """
    for name in COLUMNS:
        rows = getattr(star, name)
        if name in BY_ORDER:
            rows = rows.repartition(buckets, "order_id")
            writer = rows.write.bucketBy(buckets, "order_id").sortBy("order_id")
        else:
            writer = rows.write
        writer.mode("overwrite").format("parquet").saveAsTable(f"{database}.{name}")


def read_bucketed(spark: SparkSession, database: str) -> Star:
    """The star as ``write_bucketed`` left it, types included; plans over it keep its buckets."""
    return Star(**{name: spark.table(f"{database}.{name}") for name in COLUMNS})
