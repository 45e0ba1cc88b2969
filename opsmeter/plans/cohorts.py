"""Cohorts that follow the loads: only customers of a load are looked at again."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from opsmeter.functions.numbers import rounded_ratio
from opsmeter.operators.loads import LoadLog
from opsmeter.operators.staging import stage
from opsmeter.sources.sinks import Release, read_result

COUNTS = "cohort_month string, activity_month string, active_customers bigint"


class CohortState:
    """Months in which each customer ordered, and the cohorts that follow, between loads.

    The months are a log, one row per customer and month that no earlier load had, dealt by
    customer. The cohorts are counts per first month and month of activity. A load changes them by
    what its customers had before and have now: when an order arrives that is older than
    a customer's first one, all the customer's months move to the older cohort.

    The counts and the names of the loads in them are released together, after the
    load's months are written; so a load that died is run again, and one that ended is not
    counted twice.
    """

    def __init__(self, spark: SparkSession, folder: str, parts: int = 64, kind: str = "string"):
        self.spark, self.folder = spark, folder.rstrip("/")
        self.log = LoadLog(spark, f"{self.folder}/months", f"customer_id {kind}, order_month string", "customer_id", parts)

    def _released(self, name: str, schema: str) -> DataFrame:
        try:
            return read_result(self.spark, f"{self.folder}/cohorts", name)
        except FileNotFoundError:
            return self.spark.createDataFrame([], schema)

    def merge(self, load: str, months: DataFrame) -> None:
        """Take in ``months (customer_id, order_month)`` of a load; repeats and order do not matter."""
        merged = self._released("loads", "load string")
        if not merged.where(F.col("load") == load).isEmpty():
            return
        own = stage(
            months.where("customer_id IS NOT NULL AND order_month IS NOT NULL")
            .select("customer_id", "order_month")
            .distinct()
        )
        before = stage(
            self.log.touching(own.select("customer_id").distinct(), but=load).select("customer_id", "order_month")
        )
        same = ["customer_id", "order_month"]
        new = stage(own.join(before, same, "left_anti"))
        changed = new.select("customer_id").distinct()
        old = before.join(changed, "customer_id", "left_semi")
        change = _counted(old.union(new), 1).union(_counted(old, -1))
        counts = (
            self._released("counts", COUNTS)
            .union(change)
            .groupBy("cohort_month", "activity_month")
            .agg(F.sum("active_customers").alias("active_customers"))
            .where("active_customers <> 0")
        )
        self.log.write(load, new)
        with Release(self.spark, f"{self.folder}/cohorts") as release:
            release.save_report(counts, "counts")
            release.save_report(merged.union(self.spark.createDataFrame([(load,)], "load string")), "loads")

    def customer_first_order(self) -> DataFrame:
        """First order month per customer over all loads."""
        return self.log.rows().groupBy("customer_id").agg(F.min("order_month").alias("first_order_month"))

    def customer_cohorts(self) -> DataFrame:
        """As ``sales.customer_cohorts``, from the counts alone."""
        return (
            self._released("counts", COUNTS)
            .selectExpr(
                "cohort_month",
                "activity_month",
                "max(active_customers) OVER (PARTITION BY cohort_month) AS cohort_customers",
                "active_customers",
            )
            .selectExpr("*", f"{rounded_ratio('active_customers', 'cohort_customers', 4)} AS retention_rate")
            .orderBy("cohort_month", "activity_month")
        )


def _counted(months: DataFrame, sign: int) -> DataFrame:
    first = "min(order_month) OVER (PARTITION BY customer_id) AS cohort_month"
    return (
        months.selectExpr(first, "order_month AS activity_month")
        .groupBy("cohort_month", "activity_month")
        .agg(F.expr(f"{sign} * count(1) AS active_customers"))
    )
