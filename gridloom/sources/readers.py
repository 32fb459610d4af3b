"""Sources and sinks: delimited files, JSON and GeoJSON, registries, network folders."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

COMPONENTS = ("buses", "generators", "links", "lines", "loads", "storage_units", "stores", "transformers", "carriers", "global_constraints", "snapshots", "series")


def read_csv(spark: SparkSession, path: str, schema: str, sep: str = ",", null: str = "", comment: str | None = None, quote: str = '"', booleans: dict[str, tuple[str, str]] | None = None) -> DataFrame:
    """Explicit schema; ``booleans`` maps a column to its (true, false) words."""
    opts = {"header": True, "sep": sep, "nullValue": null, "quote": quote} | ({"comment": comment} if comment else {})
    df = spark.read.options(**opts).schema(schema).csv(path)
    for c, (yes, no) in (booleans or {}).items():
        df = df.withColumn(c, F.when(F.col(c) == yes, True).when(F.col(c) == no, False))
    return df


def read_geojson(spark: SparkSession, path: str, properties: str) -> DataFrame:
    """One row per feature: its properties, the geometry's type and coordinates (JSON text)."""
    schema = f"features array<struct<properties: struct<{properties}>, geometry: struct<type: string, coordinates: string>>>"
    f = spark.read.option("multiLine", True).schema(schema).json(path).select(F.explode("features").alias("f"))
    return f.select("f.properties.*", F.col("f.geometry.type").alias("geometry_type"), F.col("f.geometry.coordinates").alias("coordinates"))


def read_osm(spark: SparkSession, path: str) -> DataFrame:
    """Elements of an Overpass answer: type, id, tags (map), nodes, members."""
    schema = "elements array<struct<type: string, id: bigint, lat: double, lon: double, tags: map<string,string>, nodes: array<bigint>, members: array<struct<type: string, ref: bigint, role: string>>>>"
    return spark.read.option("multiLine", True).schema(schema).json(path).select(F.explode("elements").alias("e")).select("e.*")


def write_network(tables: dict[str, DataFrame], path: str, meta: dict | None = None) -> None:
    """One parquet table per component and a JSON table of metadata."""
    for name, df in tables.items():
        if name not in COMPONENTS:
            raise ValueError(f"unknown component {name}")
        df.write.mode("overwrite").parquet(f"{path}/{name}.parquet")
    spark = next(iter(tables.values())).sparkSession
    spark.createDataFrame([(json.dumps(meta or {}),)], "meta string").write.mode("overwrite").parquet(f"{path}/meta.parquet")


def read_network(spark: SparkSession, path: str) -> tuple[dict[str, DataFrame], dict]:
    out = {}
    for name in COMPONENTS:
        try:
            out[name] = spark.read.parquet(f"{path}/{name}.parquet")
        except Exception as e:  # a network need not have every component
            if "PATH_NOT_FOUND" not in str(e):
                raise
    return out, json.loads(spark.read.parquet(f"{path}/meta.parquet").first()["meta"])


def switchable(static: DataFrame, series: DataFrame, attr: str, snapshots: DataFrame) -> DataFrame:
    """Dense view of an attribute: the time-varying value where there is one, else the static one."""
    dense = static.select("name", F.col(attr).alias("_s")).crossJoin(snapshots.select("snapshot"))
    t = series.where(F.col("attr") == attr).select("name", "snapshot", "value")
    return dense.join(t, ["name", "snapshot"], "left").select("name", "snapshot", F.coalesce("value", "_s").alias(attr))


def write_rounded(df: DataFrame, path: str, digits: int = 5, fmt: str = "parquet") -> None:
    cols = [F.round(f.name, digits).alias(f.name) if f.dataType.simpleString() in ("double", "float") else F.col(f.name) for f in df.schema]
    df.select(*cols).write.mode("overwrite").format(fmt).options(**({"header": True} if fmt == "csv" else {})).save(path)


def read_table(spark: SparkSession, path: str, sep: str = ",", skip: int = 0, header: int = 1, na: tuple[str, ...] = ("",), comment: str | None = None) -> DataFrame:
    """Delimited text with an irregular head: ``skip`` lines, then ``header`` lines of names (levels are
    joined by |, an empty upper level repeats the one to its left), ``sep`` as a pattern, words for
    missing values; all columns are strings.  A file is read as one row, so it is for parameter
    files, not for data that is to be split."""
    lines = spark.read.text(path, wholetext=True).select(F.posexplode(F.split("value", "\r?\n")).alias("pos", "line")).where(F.trim("line") != "")
    if comment:
        lines = lines.where(~F.startswith("line", F.lit(comment)))
    cells = lines.where(F.col("pos") >= skip).select("pos", F.transform(F.split("line", sep), lambda x: F.trim(x)).alias("x"))
    top = [r["x"] for r in cells.where(F.col("pos") < skip + header).orderBy("pos").collect()]  # the header lines
    levels = []
    for i, row in enumerate(top):
        filled, last = [], ""
        for x in row:
            last = x or (last if i < len(top) - 1 else "")
            filled.append(last)
        levels.append(filled)
    width = max((len(x) for x in levels), default=0)
    names = ["|".join(x for x in (lev[k] if k < len(lev) else "" for lev in levels) if x) or f"_c{k}" for k in range(width)]
    cell = lambda k: F.get("x", F.lit(k))
    return cells.where(F.col("pos") >= skip + header).select(*[F.when(~cell(k).isin(*na), cell(k)).alias(n) for k, n in enumerate(names)])


def write_geojson(df: DataFrame, path: str, kind: str = "geometry_type", coordinates: str = "coordinates") -> None:
    """One feature a line (newline-delimited GeoJSON): the geometry's coordinates are JSON text, all
    other columns are properties."""
    props = F.to_json(F.struct(*[c for c in df.columns if c not in (kind, coordinates)]))
    geometry = F.concat(F.lit('{"type":"'), F.col(kind), F.lit('","coordinates":'), F.col(coordinates), F.lit("}"))
    line = F.concat(F.lit('{"type":"Feature","properties":'), props, F.lit(',"geometry":'), F.coalesce(geometry, F.lit("null")), F.lit("}"))
    df.select(line.alias("value")).write.mode("overwrite").text(path)


def read_features(spark: SparkSession, path: str, properties: str) -> DataFrame:
    """Newline-delimited GeoJSON, as ``write_geojson`` writes it."""
    f = spark.read.schema(f"properties struct<{properties}>, geometry struct<type: string, coordinates: string>").json(path)
    return f.select("properties.*", F.col("geometry.type").alias("geometry_type"), F.col("geometry.coordinates").alias("coordinates"))
