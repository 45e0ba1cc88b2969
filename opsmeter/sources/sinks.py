"""Result tables: rewritten in full by every run."""

from __future__ import annotations

import json
from uuid import uuid4

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

CSV_OPTIONS = {
    "header": "true",
    "escape": '"',
    "emptyValue": "",
    "ignoreLeadingWhiteSpace": "false",
    "ignoreTrailingWhiteSpace": "false",
    "timestampNTZFormat": "yyyy-MM-dd HH:mm:ss.SSSSSS",
}

# folders of a release below its target: the runs' tables, and one small file per commit
RUNS, COMMITS = "_runs", "_commits"


def _write(df: DataFrame, path: str, fmt: str, mode: str = "overwrite") -> None:
    if fmt == "csv":
        df.write.mode(mode).options(**CSV_OPTIONS).csv(path)
    else:
        df.write.mode(mode).format(fmt).save(path)


def save(df: DataFrame, folder: str, name: str, fmt: str = "parquet") -> None:
    """Replace ``folder/name`` by the rows of ``df``, or table ``folder.name`` with ``fmt="table"``.

    One table, in place: readers find none while it is written, nor after a run that
    died. ``Release`` replaces all tables of a run at once.
    """
    if fmt == "table":
        df.write.mode("overwrite").saveAsTable(f"{folder}.{name}")
    else:
        _write(df, f"{folder}/{name}", fmt)


def save_report(df: DataFrame, folder: str, name: str, fmt: str = "parquet") -> None:
    """``save`` for a KPI table of few rows: one file, in the order of ``df``."""
    save(df.coalesce(1), folder, name, fmt)


def _fs(spark: SparkSession, path: str):
    handle = spark._jvm.org.apache.hadoop.fs.Path(path)
    return handle.getFileSystem(spark._jsc.hadoopConfiguration()), handle


def _names(spark: SparkSession, path: str) -> list[str]:
    files, handle = _fs(spark, path)
    return sorted(x.getPath().getName() for x in files.listStatus(handle)) if files.exists(handle) else []


def _remove(spark: SparkSession, path: str) -> None:
    files, handle = _fs(spark, path)
    files.delete(handle, True)


def _root(spark: SparkSession, target: str, fmt: str) -> str:
    """Where the files are: the target itself, or the folder of the database that it names."""
    return spark.catalog.getDatabase(target).locationUri if fmt == "table" else target.rstrip("/")


def _commits(spark: SparkSession, root: str) -> list[str]:
    """Names of the commits, oldest first."""
    return [name for name in _names(spark, f"{root}/{COMMITS}") if not name.startswith((".", "_"))]


def _manifest(spark: SparkSession, root: str, commit: str) -> dict[str, str]:
    """Table name -> the run whose files it has, as of a commit."""
    files, path = _fs(spark, f"{root}/{COMMITS}/{commit}")
    stream = files.open(path)
    try:
        return json.loads(spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
    finally:
        stream.close()


def _current(spark: SparkSession, root: str) -> dict[str, str]:
    commits = _commits(spark, root)
    return _manifest(spark, root, commits[-1]) if commits else {}


def result_path(spark: SparkSession, target: str, name: str, fmt: str = "parquet") -> str:
    """The folder of a table as of the last commit."""
    root = _root(spark, target, fmt)
    run = _current(spark, root).get(name)
    if run is None:
        raise FileNotFoundError(f"no run has committed a table {name} in {root}")
    return f"{root}/{RUNS}/{run}/{name}"


def read_result(
    spark: SparkSession, target: str, name: str, fmt: str = "parquet", schema: StructType | None = None
) -> DataFrame:
    """A table as of the last commit. The frame stays on that run's files.

    ``schema`` gives the columns of a CSV their types; all are text without it.
    """
    path = result_path(spark, target, name, fmt)
    if fmt != "csv":
        return spark.read.format("parquet" if fmt == "table" else fmt).load(path)
    reader = spark.read.options(header=True, escape='"', timestampNTZFormat=CSV_OPTIONS["timestampNTZFormat"])
    return (reader.schema(schema) if schema else reader).csv(path)


class Release:
    """All tables of a run, shown together once the run has ended.

        with Release(spark, target, fmt) as release:
            release.save(df, name)

    Tables go to a folder of the run's own. Leaving the block without an error commits
    them: one small file, the next in number, says which run each table of the target is
    from. It appears whole, by a rename, and readers follow the last one (``read_result``).
    So they see all of a run's tables or none, and the earlier run whole when this one
    dies. Tables that the run did not write stay as they were. Runs that commit at the same
    time take numbers one after the other.

    With ``fmt="table"`` the target is a database; its tables lie over the committed files, and
    the commit moves their locations (``publish``), one after another. Should that be
    interrupted, ``publish`` does it again.

    What the last ``keep`` commits name stays, for readers that still use it. A run that fails
    removes what it wrote; a killed one leaves a folder that nothing reads (``sweep``).
    """

    def __init__(self, spark: SparkSession, target: str, fmt: str = "parquet", keep: int = 2):
        self.spark, self.target, self.fmt, self.keep = spark, target, fmt, max(1, keep)
        self.root = _root(spark, target, fmt)
        self.run = str(uuid4())
        self.tables: list[str] = []

    def __enter__(self) -> Release:
        return self

    def __exit__(self, kind, error, trace) -> None:
        if kind is None:
            self.commit()
        else:
            _remove(self.spark, f"{self.root}/{RUNS}/{self.run}")

    def save(self, df: DataFrame, name: str) -> None:
        fmt = "parquet" if self.fmt == "table" else self.fmt
        _write(df, f"{self.root}/{RUNS}/{self.run}/{name}", fmt, "errorifexists")
        self.tables.append(name)

    def save_report(self, df: DataFrame, name: str) -> None:
        """``save`` for a KPI table of few rows: one file, in the order of ``df``."""
        self.save(df.coalesce(1), name)

    def commit(self) -> None:
        written = f"{self.root}/{COMMITS}/_{self.run}"
        while True:
            commits = _commits(self.spark, self.root)
            number = int(commits[-1].split(".")[0]) + 1 if commits else 1
            manifest = _current(self.spark, self.root) | dict.fromkeys(self.tables, self.run)
            files, path = _fs(self.spark, written)
            stream = files.create(path, True)
            stream.write(json.dumps(manifest, sort_keys=True).encode())
            stream.close()
            if self._renamed(path, f"{self.root}/{COMMITS}/{number:012d}.json"):
                break  # else another run took the number: its tables belong in the manifest
        if self.fmt == "table":
            publish(self.spark, self.target)
        self._drop_old()

    def _renamed(self, path, name: str) -> bool:
        hadoop = self.spark._jvm.org.apache.hadoop.fs
        context = hadoop.FileContext.getFileContext(path.toUri(), self.spark._jsc.hadoopConfiguration())
        none = self.spark.sparkContext._gateway.new_array(getattr(hadoop, "Options$Rename"), 0)
        try:
            context.rename(context.makeQualified(path), context.makeQualified(hadoop.Path(name)), none)
        except Py4JJavaError as error:
            if "FileAlreadyExists" in error.java_exception.getClass().getName():
                return False
            raise
        return True

    def _drop_old(self) -> None:
        commits = _commits(self.spark, self.root)
        kept = {run for c in commits[-self.keep :] for run in _manifest(self.spark, self.root, c).values()}
        for commit in commits[: -self.keep]:
            runs = set(_manifest(self.spark, self.root, commit).values())
            # the commit first: none may name files that are gone
            _remove(self.spark, f"{self.root}/{COMMITS}/{commit}")
            for run in runs - kept:
                _remove(self.spark, f"{self.root}/{RUNS}/{run}")


def publish(spark: SparkSession, database: str) -> None:
    """Let every table of the database's last commit lie over the files that it names."""
    root = _root(spark, database, "table")
    for name, run in _current(spark, root).items():
        table, path = f"{database}.{name}", f"{root}/{RUNS}/{run}/{name}"
        if spark.catalog.tableExists(table):
            if spark.table(table).schema == spark.read.parquet(path).schema:
                spark.sql(f"ALTER TABLE {table} SET LOCATION '{path}'")
                spark.catalog.refreshTable(table)
                continue
            # other columns than before; an external table's files stay
            spark.sql(f"DROP TABLE {table}")
        spark.catalog.createTable(table, path, "parquet")


def sweep(spark: SparkSession, target: str, fmt: str = "parquet") -> list[str]:
    """Remove folders of runs that no commit names. Only while no run is under way."""
    root = _root(spark, target, fmt)
    named = {run for commit in _commits(spark, root) for run in _manifest(spark, root, commit).values()}
    left = sorted(set(_names(spark, f"{root}/{RUNS}")) - named)
    for run in left:
        _remove(spark, f"{root}/{RUNS}/{run}")
    return left
