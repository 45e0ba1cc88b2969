"""Tables that grow by loads, dealt into parts by a hash of their key."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


class LoadLog:
    """Rows with a key, each load in a folder of its own, dealt into ``parts`` parts by key.

    Writing a load again replaces it, so a load that died half way is simply run again. What
    keys have in common with the log is read from their parts alone.
    """

    def __init__(self, spark: SparkSession, folder: str, schema: str, key: str, parts: int = 64):
        self.spark, self.folder, self.schema, self.key, self.parts = spark, folder.rstrip("/"), schema, key, parts

    def _part(self, key: str) -> str:
        return f"cast(pmod(xxhash64({key}), {self.parts}) AS INT)"

    def _exists(self) -> bool:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(self.folder)
        files = path.getFileSystem(self.spark._jsc.hadoopConfiguration())
        return files.exists(path) and len(files.listStatus(path)) > 0

    def rows(self, but: str | None = None) -> DataFrame:
        """All rows with ``load`` and ``part``, but for those of the load ``but``."""
        schema = StructType.fromDDL(f"{self.schema}, load string, part int")
        if not self._exists():
            return self.spark.createDataFrame([], schema)
        rows = self.spark.read.schema(schema).parquet(self.folder)
        return rows if but is None else rows.where(F.col("load") != but)

    def write(self, load: str, rows: DataFrame) -> None:
        """Make ``rows`` what the load has: one file or a few per part."""
        dealt = rows.selectExpr("*", f"{self._part(self.key)} AS part")
        # by part and a little more, so that a part with many rows is not one task's
        spread = dealt.repartition(F.col("part"), F.expr(f"pmod(xxhash64({self.key}, 1), 4)"))
        spread.write.mode("overwrite").partitionBy("part").parquet(f"{self.folder}/load={load}")

    def touching(self, keys: DataFrame, but: str | None = None) -> DataFrame:
        """The log's rows with a key of ``keys`` (one column, distinct): only their parts are read."""
        name = keys.columns[0]
        parts = [r[0] for r in keys.selectExpr(self._part(f"`{name}`")).distinct().collect()]
        rows = self.rows(but).where(F.col("part").isin(parts))
        wanted = keys.select(F.col(f"`{name}`").alias("wanted_key"))
        return rows.join(wanted, F.expr(f"{self.key} <=> wanted_key"), "left_semi")


class KeyIndex:
    """How often each key of a table occurred, over all loads of the table.

    One row per key and load. A load's keys meet only the parts of the index that they
    belong to, and no rows of earlier loads. A missing key counts as one key, as in
    ``repeated_keys``.
    """

    def __init__(self, spark: SparkSession, folder: str, kind: str = "string", parts: int = 64):
        self.log = LoadLog(spark, folder, f"key {kind}, copies bigint", "key", parts)

    @staticmethod
    def _counted(rows: DataFrame, key: str) -> DataFrame:
        return rows.groupBy(F.col(f"`{key}`").alias("key")).agg(F.count(F.lit(1)).alias("copies"))

    def add(self, load: str, rows: DataFrame, key: str) -> None:
        """Take in the keys of a load; the same load again changes nothing."""
        self.log.write(load, self._counted(rows, key))

    def _met(self, load: str, rows: DataFrame, key: str) -> DataFrame:
        """``key, copies, earlier`` of a load's keys: how often now, and in other loads."""
        own = self._counted(rows, key)
        others = self.log.touching(own.select("key"), but=load)
        before = others.groupBy(F.col("key").alias("old_key")).agg(F.sum("copies").alias("earlier"))
        return own.join(before, F.expr("key <=> old_key"), "left").selectExpr(
            "key", "copies", "coalesce(earlier, 0L) AS earlier"
        )

    def repeated(self, load: str, rows: DataFrame, key: str) -> DataFrame:
        """Keys of the load that occur more than once in it or in other loads: for ``mark_rows``."""
        return self._met(load, rows, key).where("copies + earlier > 1").select(F.col("key").alias(key))

    def newly_repeated(self, load: str, rows: DataFrame, key: str) -> DataFrame:
        """Keys that one earlier row had, which this load repeats: that row's flag changes now."""
        return self._met(load, rows, key).where("earlier = 1").select(F.col("key").alias(key))
