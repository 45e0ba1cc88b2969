"""Running sums over a whole table without a task that sees all of it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from opsmeter.operators.staging import stage


def running_total(df: DataFrame, order: list[str], value: str, name: str) -> DataFrame:
    """``df`` with ``name``, the sum of ``value`` over all rows that come before by ``order``.

    The rows are dealt into ranges of ``order`` and stored with their range's number. Each
    range is summed by itself, and its rows by a window within it; what the ranges before it
    hold is one number per range, of which there are as many as shuffle partitions.
    Rows that are equal by ``order`` follow each other in no fixed order.
    """
    ranged = stage(df.repartitionByRange(*order).selectExpr("*", "spark_partition_id() AS in_range"))
    sums = ranged.groupBy("in_range").agg(F.sum(value).alias("total")).collect()
    before, offsets = 0, []
    for row in sorted(sums, key=lambda row: row["in_range"]):
        offsets.append((row["in_range"], before))
        before += row["total"] or 0
    earlier = df.sparkSession.createDataFrame(offsets, "of_range int, before_range bigint")
    columns = ", ".join(f"`{c}`" for c in order)
    inside = f"""coalesce(sum({value}) OVER (PARTITION BY in_range ORDER BY {columns}
        ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)"""
    return ranged.join(earlier, F.expr("in_range = of_range")).selectExpr(
        *[f"`{c}`" for c in df.columns], f"before_range + {inside} AS {name}"
    )
