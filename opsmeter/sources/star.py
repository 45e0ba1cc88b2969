"""The six base tables of the sales star."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession

from opsmeter.plans.sales import Star
from opsmeter.sources.text import missing_to_null, read_csv

# wide enough to hold what sources write; only line values are rounded, after multiplying
EXACT = "DECIMAL(18,6)"

# table -> its columns; a type makes the source's column a number of that type
COLUMNS = {
    "dim_reps": {"rep_id": None, "rep_name": None, "region": None},
    "dim_customers": {"customer_id": None, "customer_name": None, "segment": None, "region": None},
    "dim_products": {
        "product_id": None,
        "product_name": None,
        "category": None,
        "unit_cost": EXACT,
    },
    "fact_orders": {
        "order_id": None,
        "customer_id": None,
        "rep_id": None,
        "order_date": None,
        "channel": None,
        "discount_rate": "DOUBLE",
    },
    "fact_order_items": {
        "order_item_id": None,
        "order_id": None,
        "product_id": None,
        "quantity": EXACT,
        "unit_price": EXACT,
        "unit_cost": EXACT,
    },
    "fact_returns": {"return_id": None, "order_id": None, "return_date": None, "reason": None},
}


def _typed(df: DataFrame, columns: dict[str, str | None]) -> DataFrame:
    """The columns of a table; numbers that cannot be read are null."""
    return df.selectExpr(
        *[f"try_cast({c} AS {kind}) AS {c}" if kind else c for c, kind in columns.items()]
    )


def unreadable_numbers(spark: SparkSession, folder: str, fmt: str = "parquet") -> DataFrame:
    """``table_name, column_name, rows``: how many cells of each number column are no number."""
    counts = []
    for name, columns in COLUMNS.items():
        numbers = {c: kind for c, kind in columns.items() if kind}
        if not numbers:
            continue
        bad = ", ".join(
            f"""named_struct('column_name', '{c}', 'rows',
                count_if({c} IS NOT NULL AND try_cast({c} AS {kind}) IS NULL))"""
            for c, kind in numbers.items()
        )
        raw = _raw(spark, folder, fmt, name)
        counts.append(
            raw.selectExpr(f"array({bad}) AS counts").selectExpr(f"'{name}' AS table_name", "inline(counts)")
        )
    return reduce(DataFrame.union, counts)


def _raw(spark: SparkSession, folder: str, fmt: str, name: str) -> DataFrame:
    if fmt == "table":
        return spark.table(f"{folder}.{name}")
    if fmt == "csv":
        return missing_to_null(read_csv(spark, f"{folder}/{name}.csv"))
    return spark.read.format(fmt).load(f"{folder}/{name}")


def read_star(spark: SparkSession, folder: str, fmt: str = "parquet") -> Star:
    """``folder/<table>`` in a file format, or ``folder`` as a database with ``fmt="table"``."""

    return Star(**{name: _typed(_raw(spark, folder, fmt, name), c) for name, c in COLUMNS.items()})
