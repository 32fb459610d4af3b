"""Session factory and a lazy catalog of parquet tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, FloatType


def session(name: str = "gridloom", **conf) -> SparkSession:
    """UTC, adaptive execution with skew handling; ``conf`` overrides."""
    base = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
    }
    return SparkSession.builder.appName(name).config(map=base | {k.replace("__", "."): v for k, v in conf.items()}).getOrCreate()


def nan_to_null(df: DataFrame) -> DataFrame:
    """The engine's missing value is NULL: aggregates skip it, as they do not NaN."""
    cols = {f.name for f in df.schema if isinstance(f.dataType, (DoubleType, FloatType))}
    return df.select(*[F.when(~F.isnan(c), F.col(c)).alias(c) if c in cols else F.col(c) for c in df.columns])


class Catalog:
    """Tables of one folder, read when asked for."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_"):
            raise AttributeError(name)
        return self.spark.read.parquet(f"{self.root}/{name}.parquet")
