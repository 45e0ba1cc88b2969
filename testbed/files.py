"""The derived inputs as CSV files, with quotes, line breaks and missing-value words planted.

Files go to the staging area; rows are written in order of their key, so a record's
position in the files follows from the key.
"""

from __future__ import annotations

from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from opsmeter.operators.staging import session_area
from opsmeter.plans import quality, runs, sales
from opsmeter.sources.sinks import CSV_OPTIONS, Release, read_result
from opsmeter.sources.star import COLUMNS, read_star
from opsmeter.sources.text import Quarantine, read_records, read_tickets
from testbed import frames


def _new_folder(spark: SparkSession, name: str) -> str:
    return f"{session_area(spark)}/{name}-{uuid4()}"


def _write(df: DataFrame, path: str, key: str) -> None:
    """As many files as the session's shuffles have partitions, fewer for small tables."""
    ordered = df.repartitionByRange(key).sortWithinPartitions(key)
    texts = [F.col(c).cast("string").alias(c) for c in df.columns if c != "file_order"]
    ordered.select(*texts).write.options(**CSV_OPTIONS).csv(path)


def tickets(spark: SparkSession, folder: str) -> DataFrame:
    """Raw tickets as ``read_tickets`` finds them.

    The two copies of some rows hold different times that cannot be read, so they are equal
    once read. Some categories hold quotes, a comma and a line break, some a word for missing.
    """
    number = "CAST(substr(ticket_id, 2) AS BIGINT)"
    raw = frames.tickets_raw(spark, folder, keep_copy=True)
    texts = raw.withColumns(
        {
            "intake_at": F.expr(
                f"""IF({number} % 2 = 0 AND {number} % 101 = 0,
                       IF(copy = 0, 'unreadable', 'not a time'), CAST(intake_at AS STRING))"""
            ),
            "category": F.expr(
                f"""CASE {number} % 10 WHEN 3 THEN concat('say "', category, '",\\n', category)
                    WHEN 4 THEN 'N/A' ELSE category END"""
            ),
        }
    ).drop("copy")
    path = _new_folder(spark, "tickets")
    _write(texts, path, "ticket_id")
    return read_tickets(spark, path)


def records(spark: SparkSession, raw: DataFrame) -> DataFrame:
    """``raw`` as ``read_records`` finds it; ``row_id`` is then the place in the files."""
    path = _new_folder(spark, "records")
    _write(raw.withColumnRenamed("row_id", "file_order"), path, "file_order")
    return read_records(spark, path)


def star(spark: SparkSession, folder: str) -> sales.Star:
    """The star as ``read_star`` finds it in CSV files."""
    derived, path = frames.star(spark, folder), _new_folder(spark, "star")
    for name, columns in COLUMNS.items():
        frame = getattr(derived, name).select(*columns)
        _write(frame, f"{path}/{name}.csv", frame.columns[0])
    return read_star(spark, path, "csv")


def quarantined(spark: SparkSession, folder: str) -> DataFrame:
    """Customers as lines, some with a cell too many: those in quarantine, and how many are left.

    ``record`` is the bad record's text, ``ids_left`` the number of ids among the others.
    """
    path = _new_folder(spark, "flawed")
    raw = frames.customers_raw(spark, folder)
    names = [c for c in raw.columns if c != "row_id"]
    cells = ", ".join(f"coalesce({c}, '')" for c in names)
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    lines = raw.selectExpr(
        f"cast(pmod(row_id, {parts}) AS INT) AS file",
        "row_id",
        f"concat(concat_ws(',', {cells}), IF(row_id % 97 = 0, ',one more', '')) AS line",
    )
    headers = lines.select("file").distinct().selectExpr("file", "-1L AS row_id", f"'{','.join(names)}' AS line")
    # a file's rows lie in one partition, the header before them
    ordered = headers.union(lines).repartition(parts, "file").sortWithinPartitions("file", "row_id")
    ordered.select("file", "line").write.partitionBy("file").text(path)
    quarantine = Quarantine(f"{path}-bad", allowed=0.05)
    left = read_records(spark, f"{path}/file=*", quarantine=quarantine)
    bad = spark.read.parquet(quarantine.folder)
    return bad.select(
        F.col("text").alias("record"), left.agg(F.expr("count(customer_id) AS n")).scalar().alias("ids_left")
    )


def saved(df: DataFrame, name: str, fmt: str) -> DataFrame:
    """``df`` released as a result table and read again."""
    spark = df.sparkSession
    target = _new_folder(spark, "results")
    if fmt == "table":
        folder, target = target, f"results_{uuid4().hex}"
        spark.sql(f"CREATE DATABASE {target} LOCATION '{folder}'")
    for n in range(2):  # a second run replaces the first
        with Release(spark, target, fmt) as release:
            release.save_report(df if n else df.limit(1), name)
    return spark.table(f"{target}.{name}") if fmt == "table" else read_result(spark, target, name, fmt, df.schema)


def watched_scorecard(tables: list[tuple[DataFrame, quality.Checks]]) -> DataFrame:
    """The scorecard from counts taken while the record status was written."""
    spark = tables[0][0].sparkSession
    watched = [(quality.Watched(*table), table[1]) for table in tables]
    status = quality.combined(*[quality.record_status(w.rows, checks) for w, checks in watched])
    with Release(spark, _new_folder(spark, "status")) as release:
        release.save(status, "dq_record_status")
    return quality.scorecard(*[quality.table_summary(w.counts(), checks) for w, checks in watched])


def view_counts(spark: SparkSession, folder: str) -> DataFrame:
    """A query by SQL over the registered views, which replace earlier ones."""
    for _ in range(2):
        runs.register_views(frames.star(spark, folder))
    return spark.sql(
        """SELECT o.segment, count(DISTINCT o.order_id) AS orders, count(r.return_id) AS returns
           FROM v_orders_enriched o LEFT JOIN v_returns_enriched r ON r.order_id = o.order_id
           GROUP BY o.segment"""
    )
