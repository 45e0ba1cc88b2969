"""The derived inputs in loads that arrive one after another, and tables that outlive a run."""

from __future__ import annotations

from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from opsmeter.operators.loads import KeyIndex
from opsmeter.operators.staging import session_area, stage
from opsmeter.plans import reach, sales
from opsmeter.plans.cohorts import CohortState
from opsmeter.sources.buckets import read_bucketed, write_bucketed
from testbed import frames

LOADS = 3


def _folder(spark: SparkSession, name: str) -> str:
    return f"{session_area(spark)}/{name}-{uuid4()}"


def _loads(df: DataFrame, key: str) -> list[tuple[str, DataFrame]]:
    """All rows, dealt into loads by a hash: neither time nor key says which comes first."""
    stored = stage(df.withColumn("arrives", F.expr(f"pmod(xxhash64({key}, 3), {LOADS})")))
    return [(f"load{n}", stored.where(f"arrives = {n}").drop("arrives")) for n in range(LOADS)]


def repeated_keys(spark: SparkSession, folder: str) -> DataFrame:
    """Transaction ids of several rows, as loads find them one after another."""
    index = KeyIndex(spark, _folder(spark, "keys"), parts=int(spark.conf.get("spark.sql.shuffle.partitions")))
    found = []
    for name, rows in _loads(frames.transactions_raw(spark, folder), "row_id"):
        found.append(stage(index.repeated(name, rows, "transaction_id")))
        found.append(stage(index.newly_repeated(name, rows, "transaction_id")))
        index.add(name, rows, "transaction_id")
    out = found[0]
    for keys in found[1:]:
        out = out.union(keys)
    return out.distinct()


def cohorts(spark: SparkSession, folder: str) -> DataFrame:
    """The cohorts after all loads, each of which moves customers to older cohorts."""
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    state = CohortState(spark, _folder(spark, "cohorts"), parts, "bigint")
    orders = sales.orders_enriched(frames.star(spark, folder)).select("order_id", "customer_id", "order_month")
    for name, rows in _loads(orders, "order_id"):
        state.merge(name, rows)
    return state.customer_cohorts()


def reach_by_grain(spark: SparkSession, folder: str) -> DataFrame:
    return reach.reach(stage(reach.order_bitmaps(stage(sales.orders_enriched(frames.star(spark, folder))))))


def bucketed_star(spark: SparkSession, folder: str) -> sales.Star:
    """The star written to buckets by order and read again."""
    database = f"bucketed_{uuid4().hex}"
    spark.sql(f"CREATE DATABASE {database} LOCATION '{_folder(spark, 'bucketed')}'")
    write_bucketed(frames.star(spark, folder), database, int(spark.conf.get("spark.sql.shuffle.partitions")))
    return read_bucketed(spark, database)
