"""Streaming forms of the bucketed operators: the engine's extension for live series."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_stream(spark: SparkSession, path: str, schema, files: int = 1) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(path)


def tumbling(df: DataFrame, time: str, keys: list[str], value: str, width: str = "3 hours", late: str = "1 day") -> DataFrame:
    """n-hour means, sums and counts with a watermark; state of closed windows is dropped."""
    d = df.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, late)
    g = d.groupBy(F.window(time, width), *keys).agg(F.count("*").alias("n"), F.sum(value).alias("total"), F.avg(value).alias("mean"))
    return g.select(F.col("window.start").alias("start"), *keys, "n", "total", "mean")


def sessions(df: DataFrame, time: str, keys: list[str], value: str, gap: str = "2 hours", late: str = "1 day") -> DataFrame:
    d = df.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, late)
    g = d.groupBy(F.session_window(time, gap), *keys).agg(F.count("*").alias("n"), F.sum(value).alias("total"))
    return g.select(F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), *keys, "n", "total")
