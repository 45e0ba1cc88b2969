import csv
import glob
import os
import random
import subprocess
import sys
from datetime import datetime
from pathlib import Path

import pytest

from opsmeter.operators.ranges import running_total
from opsmeter.plans import quality, runs
from opsmeter.sources.sinks import Release, publish, read_result, result_path, sweep
from opsmeter.sources.star import read_star
from opsmeter.sources.text import (
    MISSING_WORDS,
    Quarantine,
    broken_files,
    missing_to_null,
    read_csv,
    read_records,
    read_tickets,
    scan_csv,
    split_shifts,
    with_row_positions,
)
from testbed import files, frames
from tests.test_sales import DATA, DDL


def lines(folder):
    out = []
    for path in sorted(glob.glob(f"{folder}/part-*.csv")):
        with open(path, newline="", encoding="utf-8") as f:
            out += list(csv.DictReader(f))
    return out


def result(spark, folder, name):
    """The lines of a CSV table of the last commit."""
    return lines(result_path(spark, str(folder), name, "csv").removeprefix("file:"))


def write_csv(path, header, rows):
    with open(path, "w", newline="", encoding="utf-8") as f:
        csv.writer(f).writerows([header, *rows])
    return str(path)


def test_csv_reading(spark, tmp_path):
    path = write_csv(
        tmp_path / "a.csv",
        ["﻿id", "text"],
        [(1, 'say "hi", twice'), ("NA", ""), (" NA", "  "), ("null", "xä"), ("", "keep")],
    )
    got = [tuple(r) for r in missing_to_null(read_csv(spark, path)).collect()]
    assert got == [("1", 'say "hi", twice'), (None, None), (" NA", "  "), (None, "xä"), (None, "keep")]
    assert len(MISSING_WORDS) == 19


def test_row_positions_whatever_the_splits(spark, tmp_path):
    for part in range(3):
        write_csv(tmp_path / f"part{part}.csv", ["n"], [(part * 10_000 + i,) for i in range(10_000)])
    name = "spark.sql.files.maxPartitionBytes"
    before = spark.conf.get(name)
    try:
        spark.conf.set(name, "7000")
        plain = read_csv(spark, str(tmp_path), multi_line=False)
        assert plain.rdd.getNumPartitions() > 10
        frame = with_row_positions(plain)
        for size in ("3000", "50000", before):  # another layout by the time of the action
            spark.conf.set(name, size)
            assert frame.where("row_id <> n").count() == 0 and frame.count() == 30_000
        plan = frame._jdf.queryExecution().optimizedPlan().toString()
        assert "Window" not in plan and "strategy=broadcast" not in plan  # offsets are stored
    finally:
        spark.conf.set(name, before)


def test_files_follow_the_shuffle_partitions(spark, tmp_path):
    name = "spark.sql.adaptive.coalescePartitions.enabled"
    before = spark.conf.get(name)
    raw = spark.range(1000).selectExpr("1000 - id AS file_order", "concat('\"', 1000 - id, '\",\n') AS n")
    try:
        spark.conf.set(name, "false")
        files._write(raw, str(tmp_path / "raw"), "file_order")
    finally:
        spark.conf.set(name, before)
    assert len(glob.glob(f"{tmp_path}/raw/part-*.csv")) == int(spark.conf.get("spark.sql.shuffle.partitions"))
    read = read_records(spark, str(tmp_path / "raw")).collect()
    assert sorted((r.row_id, r.n) for r in read) == [(i, f'"{i + 1}",\n') for i in range(1000)]


def test_quoted_line_breaks_and_odd_records(spark, tmp_path):
    path = write_csv(tmp_path / "a.csv", ["a", "b"], [("x\ny", 1), ("q,\"z", 2)])
    assert [tuple(r) for r in read_csv(spark, path).collect()] == [("x\ny", "1"), ('q,"z', "2")]
    assert read_csv(spark, path, multi_line=True).count() == 2
    with pytest.raises(Exception, match="open quote"):
        read_csv(spark, path, multi_line=False).collect()
    short = write_csv(tmp_path / "short.csv", ["a", "b"], [(1,), (2, 3)])
    assert [tuple(r) for r in read_csv(spark, short).collect()] == [("1", None), ("2", "3")]
    for mode in (None, True, False):
        long = write_csv(tmp_path / "long.csv", ["a", "b"], [(1, 2), (1, "2,2", 3)])
        with pytest.raises(Exception, match="wrong number of cells"):
            read_csv(spark, long, mode).select("a").collect()


def test_headers_of_a_folder_must_agree(spark, tmp_path):
    (tmp_path / "f").mkdir()
    write_csv(tmp_path / "f" / "1.csv", ["a", "b"], [(1, 2)])
    write_csv(tmp_path / "f" / "2.csv", ["b", "a"], [(3, 4)])
    with pytest.raises(Exception, match="(?i)header"):
        read_csv(spark, str(tmp_path / "f")).collect()


def test_tickets_run_twice_gives_the_same(spark, folder, tmp_path):
    raw = frames.tickets_raw(spark, folder)
    raw.coalesce(3).write.option("header", True).csv(str(tmp_path / "raw"))
    results = []
    for _ in range(2):
        runs.run_tickets(spark, str(tmp_path / "raw"), str(tmp_path / "out"), "csv")
        results.append({
            name: sorted(map(str, result(spark, tmp_path / "out", name)))
            for name in ["tickets_clean", "tickets_rejected", "kpi_overall", "kpi_by_priority",
                         "kpi_by_category", "kpi_by_owner", "kpi_bottlenecks"]
        })
    assert results[0] == results[1]
    assert [len(v) for v in results[0].values()] == [1468, 32, 1, 4, 5, 4, 4]
    overall = result(spark, tmp_path / "out", "kpi_overall")[0]
    assert overall["rows_raw"] == "1515" and overall["rows_valid_timeline"] == "1468"


def test_quality_run(spark, folder, tmp_path):
    for name, frame in [("c", frames.customers_raw(spark, folder)), ("t", frames.transactions_raw(spark, folder))]:
        # null and empty cells look alike in the file, as they do in the inputs
        frame.drop("row_id").write.option("header", True).csv(str(tmp_path / name))
    runs.run_quality(
        spark, str(tmp_path / "c"), str(tmp_path / "t"), str(tmp_path / "out"), datetime(2002, 1, 1), "csv"
    )
    card = result(spark, tmp_path / "out", "dq_summary")
    assert [r["table"] for r in card] == ["OVERALL", "customers", "transactions"]
    log = result(spark, tmp_path / "out", "dq_issues")
    assert len(log) == int(card[0]["issue_count"]) and list(card[0])[:2] == ["table", "rows"]
    assert len(result(spark, tmp_path / "out", "dq_record_status")) == 1650
    assert len(result(spark, tmp_path / "out", "dq_failure_rates")) == 19
    assert len(result(spark, tmp_path / "out", "dq_top_rules")) == 10
    assert [r["severity"] for r in result(spark, tmp_path / "out", "dq_issues_by_severity")][0] == "high"


def test_missing_ids_are_named_by_their_line(spark, tmp_path):
    people = write_csv(
        tmp_path / "people.csv",
        ["customer_id", "email", "signup_date", "country", "status"],
        [("C1", "a@b.c", "2020-01-01", "US", "Active"), ("NA", "a@b.c", "2020-01-01", "US", "Active")],
    )
    payments = write_csv(
        tmp_path / "payments.csv",
        ["transaction_id", "customer_id", "transaction_date", "amount", "currency", "channel"],
        [("T1", "C1", "2020-01-01", "1", "USD", "Web"), ("T2", "C1", "2020-01-01", "1", "USD", "Web"),
         ("", "C1", "2020-01-01", "1", "USD", "Web")],
    )
    assert read_records(spark, people).columns[0] == "row_id"
    runs.run_quality(spark, people, payments, str(tmp_path / "out"), datetime(2021, 1, 1), "csv")
    log = result(spark, tmp_path / "out", "dq_issues")
    assert [(r["table"], r["record_id"], r["rule"]) for r in log] == [
        ("customers", "row_1", "not_null"),
        ("transactions", "row_2", "not_null"),
    ]


SALES_TABLES = ["kpi_monthly", "kpi_by_region", "kpi_by_channel", "kpi_top_products", "kpi_returns_by_reason",
                "kpi_returns_by_channel", "customer_first_order", "customer_cohorts"]


@pytest.mark.parametrize("fmt", ["parquet", "csv"])
def test_sales_run(spark, tmp_path, fmt):
    for name, ddl in DDL.items():
        if fmt == "csv":
            columns = [c.split()[0] for c in ddl.replace("DECIMAL(18,2)", "D").split(",")]
            write_csv(tmp_path / f"{name}.csv", columns, DATA[name])
        else:
            spark.createDataFrame(DATA[name], ddl).write.parquet(str(tmp_path / name))
    star = read_star(spark, str(tmp_path), fmt)
    out = str(tmp_path / "out")
    for _ in range(2):  # a second run replaces the first
        runs.run_sales(star, out, "parquet")
        runs.sanity_checks(star, out, "parquet")
    sizes = {name: read_result(spark, out, name).count() for name in SALES_TABLES}
    assert sizes == {"kpi_monthly": 4, "kpi_by_region": 2, "kpi_by_channel": 2, "kpi_top_products": 2,
                     "kpi_returns_by_reason": 3, "kpi_returns_by_channel": 6, "customer_first_order": 3,
                     "customer_cohorts": 5}
    assert spark.sql("SELECT count(*) FROM v_order_items_enriched").collect()[0][0] == 9
    assert spark.sql("SELECT count(DISTINCT return_month) FROM v_returns_enriched").collect()[0][0] == 2
    assert spark.table("v_orders_enriched").count() == 8


def test_results_as_catalog_tables(spark, tmp_path):
    spark.sql("CREATE DATABASE IF NOT EXISTS sales_src")
    spark.sql("CREATE DATABASE IF NOT EXISTS sales_out")
    for name, ddl in DDL.items():
        spark.createDataFrame(DATA[name], ddl).write.mode("overwrite").saveAsTable(f"sales_src.{name}")
    star = read_star(spark, "sales_src", "table")
    runs.run_sales(star, "sales_out", "table")
    runs.run_sales(star, "sales_out", "table")
    assert spark.table("sales_out.kpi_monthly").count() == 4


# --- many tasks for files whose cells hold no line breaks ---


LINES = [
    ('1,"a,b",c', False), ('1,"say ""hi""",', False), ("plain,5,x", False), ('"",,""', False), ("", False), (",", False),
    ('"open', True), ('end",2', True), ('x"y,"z', True), ('a"b"c,d', False), ('"a" b,"c', True), ('"a"b,c', True),
    ('5" pipe,x', True), ('"' + "long " * 20000 + '"', False), ('"a""', True), (' "a b",c', False),
]


@pytest.mark.parametrize("line, broken", LINES)
def test_lines_that_may_go_on(spark, tmp_path, line, broken):
    (tmp_path / "a.csv").write_text(f"h,i\n{line}\n")
    assert [r.broken for r in broken_files(spark, str(tmp_path)).collect()] == [broken]


def test_only_files_with_line_breaks_are_read_whole(spark, tmp_path):
    folder = tmp_path / "in put"  # names are encoded in what Spark reports
    folder.mkdir()
    rows = {f"part {i}.csv": [(f"{i}-{j}", "x\ny" if i == 1 and j % 2 else 'q ""') for j in range(3000)] for i in range(3)}
    for name, data in rows.items():
        write_csv(folder / name, ["n", "t"], data)
    name = "spark.sql.files.maxPartitionBytes"
    before = spark.conf.get(name)
    try:
        spark.conf.set(name, "8000")
        scan = scan_csv(spark, str(folder))
        tasks = scan.selectExpr("_split_file", "spark_partition_id() AS task").distinct().groupBy("_split_file").count()
        assert sorted((r._split_file[-5], r["count"] > 3) for r in tasks.collect()) == [("0", True), ("1", False), ("2", True)]
        got = [(r.n, r.t) for r in read_csv(spark, str(folder)).collect()]
        found = read_records(spark, str(folder)).orderBy("row_id").collect()
    finally:
        spark.conf.set(name, before)
    expected = [row for data in rows.values() for row in data]
    assert sorted(got) == sorted(expected)
    assert [(r.row_id, r.n, r.t) for r in found] == [(i, *row) for i, row in enumerate(expected)]


@pytest.mark.parametrize("seed", range(6))
def test_random_cells_are_read_as_python_reads_them(spark, tmp_path, seed):
    """Whatever the cells hold: by default, and read whole, the records are those of csv.reader."""
    rng = random.Random(seed)
    letters = ["a", "b", '"', ",", " ", "é"] + ["\n"] * (seed % 2)
    expected = []
    for part in range(3):
        data = [("id" + str(i), *["".join(rng.choices(letters, k=rng.randrange(6))) + "." for _ in range(2)]) for i in range(60)]
        write_csv(tmp_path / f"{part}.csv", ["k", "a", "b"], data)
        expected += data
    for mode in (None, True):
        assert sorted(tuple(r) for r in read_csv(spark, str(tmp_path), mode).collect()) == sorted(expected)


# --- positions ---


def test_positions_of_100_000_files(spark):
    splits = spark.range(100_000).selectExpr(
        "xxhash64(id) AS split_id", "concat('f', lpad(id div 2, 6, '0')) AS split_file",
        "(id % 2) * 4096 AS split_start", "id % 5 AS size", "id * 1000 AS first_place",
    )
    shifts = split_shifts(splits.repartition(7))
    plan = shifts._jdf.queryExecution().executedPlan().toString()
    assert "SinglePartition" not in plan and "Window" in plan
    got = {r.of_split: r["shift"] for r in shifts.collect()}
    before = 0
    for r in splits.orderBy("split_file", "split_start").collect():
        assert got[r.split_id] == before - r.first_place
        before += r["size"]


def test_running_total_of_little(spark, rows):
    schema = "k string, v bigint"
    assert running_total(rows(schema), ["k"], "v", "before").collect() == []
    got = running_total(rows(schema, ("b", 2), ("a", 1), (None, 5), ("c", None), ("d", 3)), ["k"], "v", "before")
    assert sorted((r.before, r.k or "") for r in got.collect()) == [(0, ""), (5, "a"), (6, "b"), (8, "c"), (8, "d")]


# --- bad records ---


def bad_folder(tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "1.csv").write_text("a,b\n1,2\n1,2,3\n5\n6,\"x\ny\"\n")
    (tmp_path / "in" / "2.csv").write_text('a,b\n7,8\n9,10,"open\n')
    return str(tmp_path / "in")


@pytest.mark.parametrize("mode", [None, True])
def test_bad_records_go_to_the_quarantine(spark, tmp_path, mode):
    source = bad_folder(tmp_path)
    for _ in range(2):  # a second read replaces the first one's findings
        quarantine = Quarantine(str(tmp_path / "bad"), 0.5)
        good = read_csv(spark, source, mode, quarantine).collect()
        assert sorted(map(tuple, good)) == [("1", "2"), ("5", None), ("6", "x\ny"), ("7", "8")]
        bad = spark.read.parquet(str(tmp_path / "bad")).collect()
        assert sorted((os.path.basename(r.file), r.text.strip()) for r in bad) == [("1.csv", "1,2,3"), ("2.csv", '9,10,"open')]
    # positions count the records that are left
    numbered = read_records(spark, source, mode, quarantine).orderBy("row_id").collect()
    assert [(r.row_id, r.a) for r in numbered] == [(0, "1"), (1, "5"), (2, "6"), (3, "7")]


def test_too_many_bad_records_fail(spark, tmp_path):
    source = bad_folder(tmp_path)
    with pytest.raises(ValueError, match="2 of 6 CSV records are bad"):
        read_csv(spark, source, quarantine=Quarantine(str(tmp_path / "bad"), 0.3))
    assert spark.read.parquet(str(tmp_path / "bad")).count() == 2
    with pytest.raises(Exception, match="wrong number of cells"):
        read_csv(spark, source).collect()


def test_a_run_goes_on_without_bad_records(spark, folder, tmp_path):
    raw = frames.tickets_raw(spark, folder)
    raw.coalesce(1).write.option("header", True).csv(str(tmp_path / "raw"))
    (path,) = glob.glob(f"{tmp_path}/raw/part-*.csv")
    header = Path(path).read_text().split("\n", 1)[0]
    (tmp_path / "raw" / "z.csv").write_text(f"{header}\nx{',' * len(header.split(','))}\n")
    out = str(tmp_path / "out")
    with pytest.raises(Exception, match="wrong number of cells"):
        runs.run_tickets(spark, str(tmp_path / "raw"), out, "csv")
    runs.run_tickets(spark, str(tmp_path / "raw"), out, "csv", bad_share=0.01)
    assert result(spark, out, "kpi_overall")[0]["rows_raw"] == "1515"
    assert spark.read.parquet(f"{out}/_quarantine/tickets").count() == 1


# --- releases ---


def test_readers_see_whole_runs(spark, tmp_path):
    out = str(tmp_path / "out")
    with pytest.raises(FileNotFoundError):
        read_result(spark, out, "a")
    for n in (1, 2):
        with Release(spark, out) as release:
            release.save(spark.range(n), "a")
            release.save_report(spark.range(10 * n), "b")
            if n == 2:  # nothing of a run shows before its end
                assert (read_result(spark, out, "a").count(), read_result(spark, out, "b").count()) == (1, 10)
    before = read_result(spark, out, "a")
    with pytest.raises(ZeroDivisionError), Release(spark, out) as release:
        release.save(spark.range(3), "a")
        raise ZeroDivisionError
    assert (read_result(spark, out, "a").count(), read_result(spark, out, "b").count()) == (2, 20)
    assert sweep(spark, out) == []  # the failed run removed its files
    for n in (4, 5):  # tables that a run does not write stay
        with Release(spark, out) as release:
            release.save(spark.range(n), "c")
    assert [read_result(spark, out, name).count() for name in "abc"] == [2, 20, 5]
    assert before.count() == 2 and len(glob.glob(f"{out}/_commits/0*")) == 2


def test_commits_at_the_same_time(spark, tmp_path, monkeypatch):
    """A run that finds its number taken names the other run's tables too."""
    out = str(tmp_path / "out")
    first, second = Release(spark, out), Release(spark, out)
    first.save(spark.range(1), "a")
    second.save(spark.range(2), "b")
    renamed, tries = Release._renamed, []

    def late(self, path, name):
        if self is first and not tries:
            tries.append(name)
            second.commit()
        return renamed(self, path, name)

    monkeypatch.setattr(Release, "_renamed", late)
    first.commit()
    assert [read_result(spark, out, name).count() for name in "ab"] == [1, 2]
    assert sorted(os.path.basename(p) for p in glob.glob(f"{out}/_commits/*")) == ["000000000001.json", "000000000002.json"]


KILLED = """
import os, sys
sys.path.insert(0, {root!r})
from opsmeter.plans import runs, tickets
from opsmeter.session import build_session

spark = build_session("killed", "local[2]", **{{"spark.ui.enabled": "false", "spark.sql.warehouse.dir": {warehouse!r}}})
tickets.kpi_overall = lambda counts: os._exit(9)  # two tables are written, five are not
runs.run_tickets(spark, {source!r}, {out!r}, "csv")
"""


def test_a_killed_run_leaves_the_old_state(spark, folder, tmp_path):
    frames.tickets_raw(spark, folder).coalesce(2).write.option("header", True).csv(str(tmp_path / "raw"))
    out = str(tmp_path / "out")
    runs.run_tickets(spark, str(tmp_path / "raw"), out, "csv")
    names = ["tickets_clean", "tickets_rejected", "kpi_overall", "kpi_bottlenecks"]
    old = {name: result_path(spark, out, name, "csv") for name in names}
    script = KILLED.format(
        root=str(Path(__file__).resolve().parents[1]), source=str(tmp_path / "raw"), out=out,
        warehouse=str(tmp_path / "warehouse"),
    )
    assert subprocess.run([sys.executable, "-c", script], capture_output=True, timeout=300).returncode == 9
    assert {name: result_path(spark, out, name, "csv") for name in names} == old
    assert len(result(spark, out, "tickets_clean")) == 1468
    assert len(sweep(spark, out)) == 1 and sweep(spark, out) == []
    assert len(result(spark, out, "kpi_bottlenecks")) == 4


def test_releases_as_tables(spark):
    spark.sql("CREATE DATABASE IF NOT EXISTS released")
    for n in (1, 2):
        with Release(spark, "released", "table") as release:
            release.save(spark.range(n), "a")
            release.save(spark.range(n).selectExpr("id", *["'x' AS more"] * (n - 1)), "b")
    assert spark.table("released.a").count() == 2 and spark.table("released.b").columns == ["id", "more"]
    assert read_result(spark, "released", "b", "table").count() == 2
    # a commit whose tables were not moved yet
    release = Release(spark, "released", "table")
    release.save(spark.range(7), "a")
    release.fmt = "parquet"
    release.commit()
    assert spark.table("released.a").count() == 2
    publish(spark, "released")
    assert spark.table("released.a").count() == 7


# --- counts on the way ---


def test_watched_rows_give_the_same_counts(spark, folder, tmp_path):
    people, payments = frames.customers_raw(spark, folder), frames.transactions_raw(spark, folder)
    tables = [
        (quality.flag_customers(people), quality.customer_checks(frames.AS_OF)),
        (quality.flag_transactions(payments, people), quality.transaction_checks(frames.AS_OF)),
    ]
    watched = [(quality.Watched(*table), table[1]) for table in tables]
    status = quality.combined(*[quality.record_status(w.rows, checks) for w, checks in watched])
    status.write.parquet(str(tmp_path / "status"))
    for (w, _), table in zip(watched, tables):
        assert w.counts().collect() == quality.counts(*table).collect()
        assert w.counts().schema == quality.counts(*table).schema
    empty = quality.Watched(tables[0][0].limit(0), tables[0][1])
    quality.record_status(empty.rows, tables[0][1]).write.parquet(str(tmp_path / "none"))
    assert set(empty.counts().first().asDict().values()) == {0}
