"""Intermediate tables in the folder that driver and executors share."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_LEFT: list[tuple[SparkSession, str]] = []


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir of the session; a temporary folder of our own only where that is unset and all runs on one machine."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        found = f"file://{tempfile.mkdtemp(prefix='nodeloom-')}"
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def drop(spark: SparkSession, path: str) -> None:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


class Scratch:
    """Tables written once and read again: they cut lineage and outlive lost executors."""

    def __init__(self, spark: SparkSession, what: str):
        self.spark = spark
        self.root = f"{shared_dir(spark)}/nodeloom-{what}-{uuid.uuid4().hex}"
        self._n = 0
        if not _LEFT:
            atexit.register(_sweep)
        _LEFT.append((spark, self.root))

    def keep(self, df: DataFrame, what: str = "t") -> DataFrame:
        self._n += 1
        path = f"{self.root}/{self._n}-{what}"
        df.write.parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._scratch_path = path
        return out

    def drop(self, *tables: DataFrame) -> None:
        """Tables that no later step reads."""
        for t in tables:
            drop(self.spark, t._scratch_path)


def _sweep() -> None:
    for spark, root in _LEFT:
        try:
            if spark._jsc.sc().isStopped():
                continue
            drop(spark, root)
        except Exception:  # noqa: BLE001 the JVM may be gone at exit
            return
