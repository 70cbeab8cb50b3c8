"""Numbering of rows without ordering a whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def numbered(rows: DataFrame, key: str, name: str, buckets: int = 1024) -> tuple[DataFrame, int]:
    """``rows`` numbered from 0 in the order of buckets of a hash of the key, then of the key, and how many they are: buckets are
    numbered each by itself and moved by the sizes of those before, so no task orders the whole table."""
    dealt = rows.withColumn("_bucket", F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int"))
    sizes = sorted((r["_bucket"], r["count"]) for r in dealt.groupBy("_bucket").count().collect())  # a row a bucket
    before, total = [], 0
    for bucket, n in sizes:
        before.append((bucket, total))
        total += n
    table = rows.sparkSession.createDataFrame(before, "_bucket int, _before long")
    placed = dealt.withColumn("_k", F.row_number().over(Window.partitionBy("_bucket").orderBy(key))).join(F.broadcast(table), "_bucket")
    return placed.withColumn(name, F.col("_before") + F.col("_k") - 1).drop("_bucket", "_before", "_k"), total
