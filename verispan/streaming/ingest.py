"""Resumable ingest: new files of a folder, each read once, later runs go on where the last one ended."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def ingest_new(spark: SparkSession, source: str, target: str, progress: str, schema: T.StructType | str, keys: list[str], time: str | None = None) -> None:
    """Move JSON lines that came since the last run to parquet and stop. progress holds what has been read.

    With a time column, rows whose key the target holds already, or an earlier row
    of the batch has, are left out, however late they come; every other row is
    written, whatever its time. Null keys count as equal. Without one, rows are taken as they come.
    """
    d = spark.readStream.schema(schema).json(source)
    if time and time not in d.columns:
        raise ValueError(f"there is no column {time}")
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    there = lambda path: hadoop(path).getFileSystem(spark._jsc.hadoopConfiguration()).exists(hadoop(path))
    if time and there(f"{target}/_spark_metadata"):
        # readers of such a folder see only what its log names
        raise ValueError(f"{target} was written by a file sink; ingest with a time column needs a new target and progress")

    def add(batch: DataFrame, _: int) -> None:
        new = batch.dropDuplicates(keys)
        if there(target):
            held = batch.sparkSession.read.schema(batch.schema).parquet(target).select(*(F.col(k).alias(f"_held_{k}") for k in keys)).distinct()
            new = new.join(held, reduce(lambda x, y: x & y, (F.col(k).eqNullSafe(F.col(f"_held_{k}")) for k in keys)), "left_anti")
        new.write.mode("append").parquet(target)

    out = d.writeStream.foreachBatch(add) if time else d.writeStream.format("parquet").option("path", target)
    out.option("checkpointLocation", progress).trigger(availableNow=True).start().awaitTermination()
