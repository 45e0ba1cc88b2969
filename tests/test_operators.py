import random
import statistics
from contextlib import contextmanager

import pytest
from pyspark.sql import functions as F

from opsmeter.operators.keys import mark_rows, repeated_keys, unmatched_keys
from opsmeter.operators.median import weighted_median
from opsmeter.operators.staging import clear, session_area, shared_folder, stage, staging_area
from opsmeter.plans import sales
from tests.conftest import executed_plan


def test_repeated_and_unmatched_keys_treat_null_as_a_key(rows):
    left = rows("k STRING", ("a",), ("a",), ("b",), (None,), (None,), ("c",))
    right = rows("id STRING", ("a",), ("a",), (None,))
    assert {r[0] for r in repeated_keys(left, "k").collect()} == {"a", None}
    unmatched = unmatched_keys(left, "k", right, "id").collect()
    assert sorted(str(r[0]) for r in unmatched) == ["None", "b", "c"]
    marked = mark_rows(left, "k", repeated_keys(left, "k"), "twice").collect()
    assert sorted((str(k), twice) for k, twice in marked) == [
        ("None", True),
        ("None", True),
        ("a", True),
        ("a", True),
        ("b", False),
        ("c", False),
    ]


@contextmanager
def small_skew_limits(spark):
    """No broadcasts, and partitions counting as skewed from 200 KB."""
    settings = {
        "spark.sql.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "200KB",
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "2",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "100KB",
        "spark.sql.adaptive.coalescePartitions.enabled": "false",
        "spark.sql.shuffle.partitions": "16",
    }
    before = {name: spark.conf.get(name, None) for name in settings}
    for name, value in settings.items():
        spark.conf.set(name, value)
    try:
        yield
    finally:
        for name, value in before.items():
            spark.conf.unset(name) if value is None else spark.conf.set(name, value)


def test_hot_key_is_split_when_marking(spark):
    """A key with a third of the rows must not end up in one task."""
    table = spark.range(0, 200_000, 1, 8).selectExpr(
        "IF(id % 3 = 0, 'hot', concat('k', id)) AS k", "sha2(CAST(id AS STRING), 256) AS payload"
    )
    with small_skew_limits(spark):
        marked = mark_rows(table, "k", stage(repeated_keys(table, "k")), "twice")
        assert marked.where("twice").count() == 66_667
        assert "skew=true" in executed_plan(marked.groupBy("twice").agg(F.max("payload")))


@pytest.mark.parametrize("unique", [False, True])
def test_hot_customer_is_split_in_sales(spark, unique):
    """A customer with a third of the orders is split where the orders meet the customers."""
    orders = spark.range(0, 300_000, 1, 8).selectExpr(
        "sha2(CAST(id AS STRING), 256) AS order_id", "IF(id % 3 = 0, 0, id) AS customer_id",
        "1 AS rep_id", "'2024-01-01' AS order_date", "'Web' AS channel", "0D AS discount_rate",
    )
    customers = spark.range(300_000).selectExpr(
        "id AS customer_id", "'n' AS customer_name", "'s' AS segment", "'r' AS region"
    )
    items = orders.selectExpr(
        "order_id AS order_item_id", "order_id", "1 AS product_id", "1 AS quantity",
        "CAST(2 AS DECIMAL(18,2)) AS unit_price", "CAST(1 AS DECIMAL(18,2)) AS unit_cost",
    )
    one = spark.range(1, 2)
    star = sales.Star(
        customers,
        one.selectExpr("id AS product_id", "'p' AS product_name", "'c' AS category"),
        one.selectExpr("id AS rep_id", "'r' AS rep_name", "'w' AS region"),
        orders,
        items,
        one.selectExpr("'x' AS return_id", "'x' AS order_id", "'x' AS return_date", "'x' AS reason"),
    )
    with small_skew_limits(spark):
        kpi = sales.kpi_by_channel(sales.order_sales(star, unique_orders=unique), unique)
        assert "SortMergeJoin(skew=true) [customer_id" in executed_plan(kpi)
        assert kpi.collect()[0].orders == 300_000


@pytest.mark.parametrize("count", [1, 2, 7, 100, 101])
def test_median_of_random_values(spark, count):
    chance = random.Random(count)
    values = [chance.choice([0, 5, chance.randrange(2**20), chance.randrange(2**59)]) for _ in range(count)]
    weights = [chance.randrange(1, 4) for _ in values]
    frame = spark.createDataFrame(list(zip(values, weights)), "v BIGINT, w BIGINT")
    everything = [v for v, w in zip(values, weights) for _ in range(w)]
    result = weighted_median(frame, "v", "w").collect()
    assert [r[0] for r in result] == pytest.approx([statistics.median(everything)], rel=1e-15)


def test_median_of_nothing_is_null(rows):
    assert weighted_median(rows("v BIGINT, w BIGINT", (None, 3)), "v", "w").collect()[0][0] is None


def test_stage_writes_to_the_shared_folder(spark):
    copy = stage(spark.range(5).selectExpr("id", "CAST(NULL AS STRING) AS nothing"))
    assert copy.count() == 5
    named = spark.conf.get("spark.checkpoint.dir", None)
    assert named is None or shared_folder(spark) == named
    assert all(shared_folder(spark) in f for f in copy.inputFiles())


def test_staging_area_is_removed(spark):
    import os

    with staging_area(spark) as area:
        copy = stage(spark.range(5))
        assert copy.count() == 5 and all(area in f for f in copy.inputFiles())
        assert os.path.isdir(area)
    assert not os.path.exists(area)


def test_everything_staged_can_be_removed(spark, folder):
    """Also what registered queries stage, and without changing the session's settings."""
    import os

    import __spark_entry__

    before = dict(spark.sparkContext.getConf().getAll()), spark.conf.get("spark.checkpoint.dir", None)
    for name in ("dq_overall", "ticket_kpi_overall", "kpi_by_region", "csv_dq_issues"):
        __spark_entry__.queries()[name](spark, folder).count()
    area = session_area(spark).removeprefix("file:")
    assert os.listdir(area)
    clear(spark)
    assert not os.path.exists(area)
    assert before == (
        dict(spark.sparkContext.getConf().getAll()),
        spark.conf.get("spark.checkpoint.dir", None),
    )
