"""Steps of an iterative job written as tables in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_own: dict[str, str] = {}


def folder(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``; a temporary folder only for a local session that has none."""
    found = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    app = spark.sparkContext.applicationId
    if app not in _own:
        _own[app] = tempfile.mkdtemp(prefix="skyloom-steps-")
    return _own[app]


class Steps:
    """Tables of one job. ``dropped`` deletes one that no later step reads."""

    def __init__(self, spark: SparkSession, name: str) -> None:
        self.spark, self.root, self.count = spark, f"{folder(spark)}/skyloom-{name}-{uuid.uuid4().hex}", 0
        self.paths: dict[int, str] = {}

    def staged(self, df: DataFrame) -> DataFrame:
        """``df``, written and read again: lost executors cost their tasks only, and lineage ends here."""
        path = f"{self.root}/{self.count}"
        self.count += 1
        df.write.parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        self.paths[id(out)] = path
        return out

    def dropped(self, df: DataFrame) -> None:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(self.paths.pop(id(df)))
        path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)
