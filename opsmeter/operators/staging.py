"""Intermediate tables in the cluster's shared folder."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar
from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession

CHECKPOINT_CONF = "spark.checkpoint.dir"

_area: ContextVar[str | None] = ContextVar("staging_area", default=None)


def shared_folder(spark: SparkSession) -> str:
    """The folder the session names in ``spark.checkpoint.dir``, else one in the warehouse.

    Both are shared by all executors; the session's settings stay as they are.
    """
    folder = spark.conf.get(CHECKPOINT_CONF, None)
    return folder or f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/staging"


def _path(spark: SparkSession, folder: str):
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    return path.getFileSystem(spark._jsc.hadoopConfiguration()), path


def session_area(spark: SparkSession) -> str:
    """The folder of everything the application stages outside a ``staging_area``.

    ``clear`` removes it, and so does the end of the application.
    """
    folder = f"{shared_folder(spark)}/opsmeter-{spark.sparkContext.applicationId}"
    files, path = _path(spark, folder)
    files.deleteOnExit(path)
    return folder


def clear(spark: SparkSession) -> None:
    """Remove what the application staged; frames over it end with it."""
    files, path = _path(spark, session_area(spark))
    files.delete(path, True)


@contextmanager
def staging_area(spark: SparkSession) -> Iterator[str]:
    """Everything staged inside the ``with`` block goes to one folder, removed at its end.

    Results must be written before that; frames over the staged tables end with it.
    """
    folder = f"{shared_folder(spark)}/opsmeter-{uuid4()}"
    token = _area.set(folder)
    try:
        yield folder
    finally:
        _area.reset(token)
        files, path = _path(spark, folder)
        files.delete(path, True)


def stage(df: DataFrame) -> DataFrame:
    """Write ``df`` once and read it back, so that several consumers share one run.

    Runs a job. The copy outlives lost executors, and its size is known to the planner.
    """
    spark = df.sparkSession
    path = f"{_area.get() or session_area(spark)}/staged-{uuid4()}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
