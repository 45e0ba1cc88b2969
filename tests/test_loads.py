"""Tables that grow by loads, mergeable distinct counts, and tables in buckets."""

import random
from dataclasses import replace

import pytest

from opsmeter.operators.keys import repeated_keys
from opsmeter.operators.loads import KeyIndex, LoadLog
from opsmeter.plans import quality, reach, sales
from opsmeter.plans.cohorts import CohortState
from opsmeter.sources.buckets import read_bucketed, write_bucketed
from testbed import frames
from tests.conftest import executed_plan


def keys_of(frame):
    return sorted(str(r[0]) for r in frame.collect())


def test_a_later_load_flags_keys_of_the_first(spark, rows, tmp_path):
    schema = "k string, v int"
    first = rows(schema, ("a", 1), ("b", 1), ("b", 2), ("c", 1), (None, 1))
    second = rows(schema, ("a", 3), ("b", 3), ("d", 3), (None, 4))
    third = rows(schema, ("a", 5), ("e", 5), ("e", 6))
    index = KeyIndex(spark, str(tmp_path / "index"), parts=8)
    expected = [(["b"], []), (["None", "a", "b"], ["None", "a"]), (["a", "e"], [])]
    for name, load, (repeated, newly) in zip("xyz", (first, second, third), expected):
        for _ in range(2):  # a load that is run again finds the same
            assert keys_of(index.repeated(name, load, "k")) == repeated
            assert keys_of(index.newly_repeated(name, load, "k")) == newly
            index.add(name, load, "k")
    everything = first.union(second).union(third)
    totals = {r.key: r.n for r in index.log.rows().groupBy("key").agg({"copies": "sum"}).toDF("key", "n").collect()}
    assert {k for k, n in totals.items() if n > 1} == {r.k for r in repeated_keys(everything, "k").collect()}


def test_a_load_reads_only_its_parts(spark, rows, tmp_path):
    index = KeyIndex(spark, str(tmp_path / "index"), kind="bigint", parts=16)
    index.add("x", spark.range(2000).withColumnRenamed("id", "k"), "k")
    load = rows("k bigint", (5,), (70,), (9000,))
    before = index.log.touching(load, but="y")
    files = {f.split("part=")[1].split("/")[0] for f in before.select("part").inputFiles()}
    assert "PartitionFilters" in executed_plan(before) and sorted(r.key for r in before.collect()) == [5, 70]
    scan = next(line for line in executed_plan(before).splitlines() if "PartitionFilters" in line)
    assert "part" in scan.split("PartitionFilters")[1].split("]")[0] and len(files) == 16
    parts = {r[0] for r in load.selectExpr("cast(pmod(xxhash64(k), 16) AS INT)").collect()}
    assert {r.part for r in before.collect()} <= parts


def test_rules_over_loads(spark, folder, tmp_path):
    """The unique rule of a load, told by the index, is that of all rows so far."""
    people = frames.customers_raw(spark, folder)
    checks = quality.customer_checks(frames.AS_OF)
    loads = [people.where("row_id % 2 = 0"), people.where("row_id % 2 = 1")]
    index = KeyIndex(spark, str(tmp_path / "index"), parts=4)
    index.add("0", loads[0], "customer_id")
    flagged = quality.flag_customers(loads[1], index.repeated("1", loads[1], "customer_id"))
    got = quality.issues(flagged, checks).where("rule = 'unique'").select("record_id")
    whole = quality.flag_customers(people).where("row_id % 2 = 1")
    expected = quality.issues(whole, checks).where("rule = 'unique'").select("record_id")
    assert keys_of(got) == keys_of(expected) != []


def test_log_of_nothing(spark, rows, tmp_path):
    log = LoadLog(spark, str(tmp_path / "log"), "key string, n bigint", "key")
    assert log.rows().collect() == [] and log.touching(rows("k string", ("a",))).collect() == []
    log.write("x", rows("key string, n bigint"))
    assert log.rows().collect() == []


@pytest.mark.parametrize("seed", range(3))
def test_cohorts_in_any_order_of_arrival(spark, tmp_path, seed):
    rng = random.Random(seed)
    months = [f"20{y:02d}-{m:02d}" for y in (20, 21) for m in range(1, 13)]
    orders = [(rng.randrange(25) or None, rng.choice(months)) for _ in range(160)] + [(3, None)]
    rng.shuffle(orders)
    state = CohortState(spark, str(tmp_path / "state"), parts=4, kind="bigint")
    schema, done = "customer_id bigint, order_month string", []
    cuts = sorted(rng.sample(range(len(orders)), 3))
    for n, (a, b) in enumerate(zip([0, *cuts], [*cuts, len(orders)])):
        load = spark.createDataFrame(orders[a:b], schema)
        state.merge(f"l{n}", load)
        state.merge(f"l{n}", load)  # once more changes nothing
        done += orders[a:b]
        known = [o for o in done if None not in o]
        whole = spark.createDataFrame(known, schema)
        assert state.customer_cohorts().collect() == sales.customer_cohorts(whole).collect()
        assert sorted(state.customer_first_order().collect()) == sorted(sales.customer_first_order(whole).collect())


def test_a_load_that_died_is_run_again(spark, rows, tmp_path, monkeypatch):
    schema = "customer_id bigint, order_month string"
    state = CohortState(spark, str(tmp_path / "state"), parts=4, kind="bigint")
    state.merge("a", rows(schema, (1, "2020-03"), (2, "2020-04")))
    second = rows(schema, (1, "2020-01"), (1, "2020-03"), (3, "2020-03"))
    from opsmeter.plans import cohorts

    def dies(*args):
        raise RuntimeError("lost")

    with monkeypatch.context() as patch:
        patch.setattr(cohorts.Release, "commit", dies)
        with pytest.raises(RuntimeError):
            state.merge("b", second)
    assert [tuple(r)[:4] for r in state.customer_cohorts().collect()] == [
        ("2020-03", "2020-03", 1, 1), ("2020-04", "2020-04", 1, 1)
    ]
    state.merge("b", second)
    assert [tuple(r)[:4] for r in state.customer_cohorts().collect()] == [
        ("2020-01", "2020-01", 1, 1), ("2020-01", "2020-03", 1, 1), ("2020-03", "2020-03", 1, 1), ("2020-04", "2020-04", 1, 1)
    ]


def test_bitmaps_merge_exactly(spark):
    rng = random.Random(5)
    data = [
        (rng.randrange(90_000) if rng.random() > 0.01 else None, f"c{rng.randrange(700)}", f"2020-{rng.randrange(1, 13):02d}",
         rng.choice("NS"), rng.choice("ab"))
        for _ in range(40_000)
    ]
    orders = spark.createDataFrame(data, "order_id bigint, customer_id string, order_month string, rep_region string, channel string")
    bits = reach.order_bitmaps(orders)
    assert bits.selectExpr("max(octet_length(bits)) AS n").first().n <= 4096
    grains = {"month": lambda r: r[2], "quarter": lambda r: f"2020-Q{(int(r[2][5:]) + 2) // 3}",
              "region": lambda r: r[3], "channel": lambda r: r[4]}
    expected = {}
    for name, grain in grains.items():
        for r in data:
            orders_of, customers_of = expected.setdefault((name, grain(r)), (set(), set()))
            orders_of.add(r[0])
            customers_of.add(r[1])
    got = {(r.grain, r.value): (r.orders, r.customers) for r in reach.reach(bits).collect()}
    assert got == {k: (len(a - {None}), len(b)) for k, (a, b) in expected.items()}


def test_dense_ids_follow_time(spark, rows):
    frame = rows("k string, m string", ("z", "01"), ("a", "02"), ("z", "03"), (None, "01"), ("b", "01"))
    assert sorted(map(tuple, reach.dense_ids(frame, "k", "m").collect())) == [("a", 3), ("b", 1), ("z", 2)]


def test_items_meet_orders_where_they_lie(spark, folder):
    spark.sql("CREATE DATABASE IF NOT EXISTS by_order")
    star = frames.star(spark, folder)
    write_bucketed(star, "by_order", 6)
    stored = read_bucketed(spark, "by_order")
    name = "spark.sql.autoBroadcastJoinThreshold"
    before = spark.conf.get(name)
    try:
        spark.conf.set(name, "30000")  # dimensions are broadcast, facts are not
        for view in (sales.order_items_enriched, sales.returns_enriched):
            for found, moves in ((stored, False), (star, True)):
                # returns are few here: a hint keeps them from being broadcast
                found = replace(found, fact_returns=found.fact_returns.hint("merge"))
                plan = executed_plan(view(found))
                assert "SortMergeJoin" in plan and ("hashpartitioning(order_id" in plan) == moves, plan
    finally:
        spark.conf.set(name, before)
    assert stored.fact_order_items.inputFiles() and len(stored.fact_order_items.inputFiles()) <= 6
