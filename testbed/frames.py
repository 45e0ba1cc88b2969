"""Inputs of the jobs, derived by Spark from the driver's tables (FIXTURES.md section 2).

Every view covers its whole source tables. Nulls, bad values, repeated ids and
dangling keys are planted by integer arithmetic on the source keys.
"""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from opsmeter.plans.sales import Star

AS_OF = datetime(2002, 1, 1)

SCHEMAS = {
    "region": "r_regionkey INT, r_name STRING",
    "nation": "n_nationkey INT, n_name STRING, n_regionkey INT",
    "customer": """c_custkey BIGINT, c_name STRING, c_nationkey INT, c_acctbal DOUBLE,
        c_mktsegment STRING""",
    "supplier": "s_suppkey BIGINT, s_name STRING, s_nationkey INT, s_acctbal DOUBLE",
    "part": """p_partkey BIGINT, p_name STRING, p_brand STRING, p_type STRING, p_size INT,
        p_retailprice DOUBLE""",
    "orders": """o_orderkey BIGINT, o_custkey BIGINT, o_orderstatus STRING, o_totalprice DOUBLE,
        o_orderdate TIMESTAMP_NTZ, o_orderpriority STRING""",
    "lineitem": """l_orderkey BIGINT, l_partkey BIGINT, l_suppkey BIGINT, l_linenumber INT,
        l_quantity DOUBLE, l_extendedprice DOUBLE, l_discount DOUBLE, l_tax DOUBLE,
        l_returnflag STRING, l_linestatus STRING, l_shipdate TIMESTAMP_NTZ""",
}


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A driver table; the schema is stated, which saves a job to infer it."""
    return spark.read.schema(SCHEMAS[name]).parquet(f"{folder}/{name}.parquet")


def tickets_raw(spark: SparkSession, folder: str, keep_copy: bool = False) -> DataFrame:
    orders = table(spark, folder, "orders")
    customer = table(spark, folder, "customer").selectExpr(
        "c_custkey AS o_custkey", "c_mktsegment"
    )
    timed = (
        orders.join(customer, "o_custkey")
        .selectExpr("*", "o_orderkey AS k")
        .withColumn("created_at", F.expr("o_orderdate + make_dt_interval(0, 0, k * 37 % 1440)"))
        .withColumn(
            "triage_at",
            F.expr("created_at + make_dt_interval(0, 0, k * 13 % 180 + k * 7 % 360)"),
        )
        .withColumn("work_at", F.expr("triage_at + make_dt_interval(0, 0, k * 11 % 1440)"))
    )
    tickets = timed.selectExpr(
        "k",
        "concat('T', IF(k % 50 = 7, k - 7, k)) AS ticket_id",
        "created_at",
        "IF(k % 97 = 0, NULL, created_at + make_dt_interval(0, 0, k * 13 % 180)) AS intake_at",
        "triage_at",
        "work_at",
        "work_at + make_dt_interval(0, 0, IF(k % 89 = 0, -3000, k * 17 % 480)) AS resolved_at",
        "c_mktsegment AS category",
        """CASE o_orderpriority WHEN '1-URGENT' THEN 'Critical' WHEN '2-HIGH' THEN 'High'
           WHEN '3-MEDIUM' THEN 'Medium' WHEN '5-LOW' THEN 'Low' END AS priority""",
        "element_at(array('Email', 'Web', 'Phone', 'Chat'), CAST(k % 4 AS INT) + 1) AS channel",
        "concat('Team-', substr('ABCD', CAST(o_custkey % 4 AS INT) + 1, 1)) AS owner_team",
        """CASE o_orderpriority WHEN '1-URGENT' THEN 8 WHEN '2-HIGH' THEN 24
           WHEN '3-MEDIUM' THEN 48 WHEN '5-LOW' THEN 72 END AS sla_target_hours""",
    )
    # exact copies of some rows, without scanning twice
    copies = F.when(F.col("k") % 101 == 0, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    copied = tickets.withColumn("copy", F.explode(copies)).drop("k")
    return copied if keep_copy else copied.drop("copy")


def customers_raw(spark: SparkSession, folder: str) -> DataFrame:
    return (
        table(spark, folder, "customer")
        .withColumnRenamed("c_custkey", "c")
        .selectExpr(
            "c AS row_id",
            """CASE WHEN c % 211 = 3 THEN NULL WHEN c % 50 = 9 THEN concat('C', c - 1)
               ELSE concat('C', c) END AS customer_id""",
            """CASE WHEN c % 33 = 1 THEN NULL WHEN c % 71 = 2 THEN '  '
               WHEN c % 50 = 3 THEN 'not-an-email'
               ELSE concat('user', c, '@example.com') END AS email""",
            """CASE WHEN c % 90 = 4 THEN NULL WHEN c % 90 = 5 THEN '2001-02-30'
               WHEN c % 100 = 6 THEN '2002-01-11'
               ELSE concat('200', c % 2, '-0', c % 9 + 1, '-1', c % 10) END AS signup_date""",
            """CASE WHEN c % 120 = 8 THEN NULL WHEN c % 100 = 7 THEN 'XX'
               ELSE element_at(array('US', 'CA', 'MX', 'GB', 'DE', 'IN'), c_nationkey % 6 + 1)
               END AS country""",
            """CASE WHEN c % 150 = 10 THEN 'Paused' WHEN c % 7 = 0 THEN 'Inactive'
               ELSE 'Active' END AS status""",
        )
    )


def transactions_raw(spark: SparkSession, folder: str) -> DataFrame:
    return (
        table(spark, folder, "orders")
        .withColumnRenamed("o_orderkey", "k")
        .selectExpr(
            "k AS row_id",
            """CASE WHEN k % 401 = 5 THEN NULL WHEN k % 100 = 9 THEN concat('T', k - 1)
               ELSE concat('T', k) END AS transaction_id""",
            """CASE WHEN k % 301 = 6 THEN NULL WHEN k % 67 = 2 THEN 'C999999999'
               ELSE concat('C', o_custkey) END AS customer_id""",
            """CASE WHEN k % 200 = 3 THEN NULL WHEN k % 500 = 4 THEN 'not-a-date'
               WHEN k % 100 = 5 THEN '2002-01-08'
               ELSE substr(CAST(o_orderdate AS STRING), 1, 10) END AS transaction_date""",
            """CASE WHEN k % 250 = 1 THEN NULL WHEN k % 250 = 2 THEN 'abc'
               WHEN k % 50 = 6 THEN concat('-', k % 900 + 1, '.5')
               WHEN k % 100 = 8 THEN '0' ELSE concat(k % 900 + 1, '.25') END AS amount""",
            """CASE WHEN k % 100 = 11 THEN 'XXX'
               ELSE element_at(array('USD', 'CAD', 'GBP', 'EUR'), CAST(k % 4 AS INT) + 1)
               END AS currency""",
            """CASE WHEN k % 100 = 12 THEN 'Kiosk'
               ELSE element_at(array('Web', 'Mobile', 'Store', 'Partner'), CAST(k % 4 AS INT) + 1)
               END AS channel""",
        )
    )


def star(spark: SparkSession, folder: str) -> Star:
    places = (
        table(spark, folder, "nation")
        .join(table(spark, folder, "region"), F.expr("n_regionkey = r_regionkey"))
        .select("n_nationkey", F.col("r_name").alias("region"))
    )
    customers = (
        table(spark, folder, "customer")
        .join(places, F.expr("c_nationkey = n_nationkey"))
        .selectExpr(
            "c_custkey AS customer_id", "c_name AS customer_name", "c_mktsegment AS segment", "region"
        )
    )
    reps = (
        table(spark, folder, "supplier")
        .join(places, F.expr("s_nationkey = n_nationkey"))
        .selectExpr("s_suppkey AS rep_id", "s_name AS rep_name", "region")
    )
    products = (
        table(spark, folder, "part")
        .withColumn("list_price", F.expr("CAST(p_retailprice AS DECIMAL(18,2))"))
        .selectExpr(
            "p_partkey AS product_id",
            "p_name AS product_name",
            "p_type AS category",
            "list_price",
            """CAST(round(list_price * (45 + p_partkey % 31) / 100, 2) AS DECIMAL(18,2))
               AS unit_cost""",
        )
    )
    # representatives are numbered from 0; one number more is nobody's
    reps_and_one = table(spark, folder, "supplier").agg(F.expr("count(1) + 1 AS n")).scalar()
    orders = (
        table(spark, folder, "orders")
        .withColumnRenamed("o_orderkey", "k")
        .withColumn("numbers", reps_and_one)
        .selectExpr(
            "k AS order_id",
            "IF(k % 40 = 39, o_custkey + 1000000000, o_custkey) AS customer_id",
            "k % numbers AS rep_id",
            "substr(CAST(o_orderdate AS STRING), 1, 10) AS order_date",
            """CASE WHEN k % 20 < 11 THEN 'Web' WHEN k % 20 < 18 THEN 'Sales'
               ELSE 'Partner' END AS channel""",
            "(k % 19) / 100D AS discount_rate",
        )
    )
    # every order key resolves, so the order's discount follows from the key alone
    items = (
        table(spark, folder, "lineitem")
        .selectExpr("l_orderkey AS order_id", "l_linenumber", "l_partkey AS product_id")
        .join(products.select("product_id", "list_price", "unit_cost"), "product_id")
        .selectExpr(
            "concat_ws('-', order_id, l_linenumber, product_id) AS order_item_id",
            "order_id",
            "product_id",
            "CAST(product_id % 5 + 1 AS INT) AS quantity",
            """CAST(round(list_price * (100 - order_id % 19) / 100, 2) AS DECIMAL(18,2))
               AS unit_price""",
            "unit_cost",
        )
    )
    returns = (
        table(spark, folder, "orders")
        .withColumnRenamed("o_orderkey", "k")
        .where("k % 23 = 0 OR (k % 41 = 0 AND k % 20 < 11)")
        .selectExpr(
            "concat('RET', k) AS return_id",
            "k AS order_id",
            """CAST(CAST(o_orderdate AS DATE) + CAST(3 + k % 42 AS INT) AS STRING)
               AS return_date""",
            """element_at(array('Damaged', 'Wrong item', 'Late delivery', 'Customer changed mind',
               'Other'), CAST(k % 5 AS INT) + 1) AS reason""",
        )
    )
    return Star(customers, products, reps, orders, items, returns)
