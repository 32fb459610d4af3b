"""Base network: raw tables of buses and branches to typed components with electrical parameters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .graph import prune_dangling


def tag(df: DataFrame, kind: str) -> Column:
    """"oid" (digits) or "country" (two capitals) of a tag text such as ``"oid"=>"12"``; NULL without tags."""
    if "tags" not in df.columns:
        return F.lit(None).cast("string")
    got = F.regexp_extract("tags", {"oid": '"oid"=>"(\\d+)"', "country": '"country"=>"([A-Z]{2})"'}[kind], 1)
    return F.when(got != "", got)


def _truth(c: str) -> Column:
    return F.when(F.col(c).cast("string").isin("t", "true"), True).when(F.col(c).cast("string").isin("f", "false"), False)


def buses(raw: DataFrame, regions: DataFrame | None, countries: list[str], v_min: float, v_max: float) -> DataFrame:
    """Buses inside the shape (polygons of ``regions``, if given) and the countries, with a voltage in
    the range, none, or direct current."""
    b = raw.withColumnRenamed("voltage", "v_nom").withColumn("carrier", F.when(_truth("dc"), "DC").otherwise("AC")).withColumn("under_construction", F.coalesce(_truth("under_construction"), F.lit(False)))
    if "country" in b.columns:
        b = b.where(F.col("country").isin(*countries))
    b = b.where(F.col("v_nom").between(v_min, v_max) | F.col("v_nom").isNull() | (F.col("carrier") == "DC"))
    if regions is not None:
        from .spatial import contained

        inside = contained(b.select(F.col("bus_id").alias("id"), "x", "y"), regions).select(F.col("id").alias("bus_id"))
        b = b.join(inside, "bus_id", "left_semi")
    return b.drop("dc", "station_id")


def branches(raw: DataFrame, bus_table: DataFrame, carrier: str, kind: str) -> DataFrame:
    """Lines, links, converters or transformers with both ends among the buses: metres become
    kilometres, voltage v_nom and circuits num_parallel."""
    d = raw
    for old, new in (("voltage", "v_nom"), ("circuits", "num_parallel")):
        if kind == "line" and old in d.columns:
            d = d.withColumnRenamed(old, new)
    if "length" in d.columns:
        d = d.withColumn("length", F.col("length") / 1e3)
    for c in ("underground", "under_construction"):
        if c in d.columns:
            d = d.withColumn(c, _truth(c))
    return prune_dangling(d, bus_table, ["bus0", "bus1"], "bus_id").withColumn("carrier", F.lit(carrier))


def line_parameters(lines: DataFrame, types: dict[float, str], currents: dict[str, float], s_max_pu: float) -> DataFrame:
    """Type of the nearest voltage (the first on a tie), s_max_pu, and s_nom = sqrt(3) * i_nom * v_nom
    * num_parallel of the type's current."""
    from .frames import closest

    d = closest(lines, "v_nom", list(types.items()), "type")
    current = F.element_at(F.create_map(*[F.lit(x) for kv in currents.items() for x in kv]), F.col("type"))
    return d.withColumns({"s_max_pu": F.lit(s_max_pu), "s_nom": F.sqrt(F.lit(3.0)) * current * F.col("v_nom") * F.col("num_parallel")})


def link_parameters(links: DataFrame, p_max_pu: float = 1.0, p_min_pu: float | None = None) -> DataFrame:
    return links.withColumns({"p_max_pu": F.lit(p_max_pu), "p_min_pu": F.lit(-p_max_pu if p_min_pu is None else p_min_pu), "carrier": F.lit("DC"), "dc": F.lit(True)})


def converter_parameters(converters: DataFrame, p_nom: float = 2000.0, p_max_pu: float = 1.0) -> DataFrame:
    d = converters if "p_nom" in converters.columns else converters.withColumn("p_nom", F.lit(p_nom))
    return d.withColumns({"p_max_pu": F.lit(p_max_pu), "p_min_pu": F.lit(-p_max_pu), "under_construction": F.lit(False), "underground": F.lit(False), "dc": F.lit(False)})


def transformer_parameters(transformers: DataFrame, x: float = 0.1, s_nom: float = 2000.0, kind: str = "") -> DataFrame:
    d = transformers if "s_nom" in transformers.columns else transformers.withColumn("s_nom", F.lit(s_nom))
    return d.withColumns({"x": F.lit(x), "type": F.lit(kind)})


def under_construction(df: DataFrame, mode: str, capacity: list[str]) -> DataFrame:
    """``zero``: no capacity while under construction; ``remove``: left out; ``keep``: as it is."""
    if mode == "remove":
        return df.where(~F.coalesce("under_construction", F.lit(False)))
    if mode == "zero":
        return df.withColumns({c: F.when(F.coalesce("under_construction", F.lit(False)), F.lit(0.0)).otherwise(F.col(c)) for c in capacity})
    if mode != "keep":
        raise ValueError(f"unknown mode {mode}")
    return df


def corrections(df: DataFrame, rules: DataFrame, key: str, attr: str) -> DataFrame:
    """(by: oid or index, id, value) rules: the attribute of the rows with that tag or key is replaced."""
    d = df.withColumn("_oid", tag(df, "oid"))
    by_oid = rules.where("by = 'oid'").select(F.col("id").alias("_oid"), F.col("value").alias("_a"))
    by_key = rules.where("by = 'index'").select(F.col("id").alias(key), F.col("value").alias("_b"))
    j = d.join(by_oid, "_oid", "left").join(by_key, key, "left")
    return j.select(*[F.coalesce("_b", "_a", c).alias(c) if c == attr else F.col(c) for c in df.columns])


def closest_links(links: DataFrame, new: DataFrame, reach: float = 1.5) -> DataFrame:
    """new id, link: the existing link (id, x0, y0, x1, y1 in degrees) whose end points are nearest as
    one 4-D point, in either direction, within ``reach``.

    An equi-join on cells of the size of the reach: a new link looks into the 81 cells around
    each of its directions."""
    cell = lambda c: F.floor(F.col(c) / reach).cast("long")
    ends = ("x0", "y0", "x1", "y1")
    old = links.select(F.col("id").alias("link"), *[F.col(c).alias(f"o{c}") for c in ends], *[cell(c).alias(f"c{i}") for i, c in enumerate(ends)])
    both = new.select("id", *ends).unionByName(new.select("id", F.col("x1").alias("x0"), F.col("y1").alias("y0"), F.col("x0").alias("x1"), F.col("y0").alias("y1")))
    look = both
    for i, c in enumerate(ends):
        look = look.withColumn(f"c{i}", F.explode(F.array(cell(c) - 1, cell(c), cell(c) + 1)))
    d = F.sqrt(sum(((F.col(c) - F.col(f"o{c}")) * (F.col(c) - F.col(f"o{c}")) for c in ends), F.lit(0.0)))
    hit = look.join(old, [f"c{i}" for i in range(4)]).select("id", "link", d.alias("d")).where(F.col("d") < reach)
    return hit.groupBy("id").agg(F.min(F.struct("d", "link")).alias("m")).select("id", F.col("m.link").alias("link"))
