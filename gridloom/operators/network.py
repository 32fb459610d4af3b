"""Network construction steps: parallel lines, transformers, capacities, chains, allocation."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .graph import canonical_edges, components


def merge_parallel(lines: DataFrame) -> DataFrame:
    """Lines of one geometry and voltage become one: circuits add up and the first id (up to its
    first -, if lines were merged) stays; every id then gets the voltage in kV."""
    g = lines.groupBy("geometry", "voltage").agg(F.min("line_id").alias("first"), F.sum("circuits").alias("circuits"), F.count("*").alias("n"), F.array_join(F.array_sort(F.collect_set("line_id")), ";").alias("contains"))
    kv = F.floor(F.col("voltage") / 1000).cast("string")
    base = F.when(F.col("n") > 1, F.substring_index("first", "-", 1)).otherwise(F.col("first"))
    return g.select(F.concat(base, F.lit("-"), kv).alias("line_id"), "geometry", "voltage", "circuits", "contains")


def station_transformers(buses: DataFrame) -> DataFrame:
    """A transformer for every pair of buses (in the order of their ids) of a station with more
    than one voltage; its rating is the larger capacity of the two buses."""
    many = buses.groupBy("station_id").agg(F.countDistinct("voltage").alias("n")).where("n > 1").select("station_id")
    b = buses.join(many, "station_id", "left_semi").select("station_id", "bus_id", "voltage", "s_nom")
    # The buses of one station are few; a station is one array.
    g = b.groupBy("station_id").agg(F.array_sort(F.collect_list(F.struct("bus_id", "voltage", "s_nom"))).alias("x"))
    p = g.select("station_id", "x", F.posexplode("x").alias("i", "a")).select("station_id", "a", F.explode(F.expr("slice(x, i + 2, size(x))")).alias("b"))
    kv = lambda c: F.floor(F.col(c) / 1000).cast("string")
    name = F.concat_ws("-", F.col("station_id").cast("string"), kv("a.voltage"), kv("b.voltage"))
    return p.select(name.alias("transformer_id"), "station_id", F.col("a.bus_id").alias("bus0"), F.col("b.bus_id").alias("bus1"), F.col("a.voltage").alias("v0"), F.col("b.voltage").alias("v1"), F.greatest("a.s_nom", "b.s_nom").alias("s_nom"))


def bus_capacity(branches: DataFrame) -> DataFrame:
    """Sum of the ratings of all branches at a bus, both ends, rounded up."""
    ends = branches.select(F.col("bus0").alias("bus"), "s_nom").unionAll(branches.select(F.col("bus1").alias("bus"), "s_nom"))
    return ends.groupBy("bus").agg(F.ceil(F.sum("s_nom")).cast("long").alias("s_nom"))


def line_rating(num_parallel, v_nom, i_nom):
    """MVA of a line: sqrt(3) * V * I per circuit."""
    return num_parallel * F.lit(3.0) ** 0.5 * v_nom * i_nom


def circuits_to_one_voltage(num_parallel, v_nom, target: float):
    """Parallel circuits scaled to a common voltage by the square of the ratio."""
    return num_parallel * (v_nom / target) ** 2


def copperplate(buses: DataFrame, branches: DataFrame, groups: list[list[str]]) -> tuple[DataFrame, DataFrame]:
    """(branches without those inside a zone, links of infinite capacity from a zone's first bus
    to its others).  A zone is a group of buses named by them; any other bus is its own."""
    rows = [("_".join(g), b, i) for g in groups for i, b in enumerate(g)]
    z = buses.sparkSession.createDataFrame(rows, "zone string, name string, pos int")
    have = z.join(buses.select("name"), "name", "left_semi")
    left = branches
    for p in ("bus0", "bus1"):
        m = z.select(F.col("name").alias(p), F.col("zone").alias(f"_{p}"))
        left = left.join(m, p, "left").withColumn(f"_{p}", F.coalesce(f"_{p}", p))
    left = left.where("_bus0 <> _bus1").select(*branches.columns)
    w = W.partitionBy("zone").orderBy("pos")
    hub = have.withColumns({"hub": F.first("name").over(w), "i": F.row_number().over(w) - 2}).where("i >= 0")
    new = hub.select(F.concat_ws("_", F.lit("copper"), "zone", F.col("i").cast("string")).alias("name"), F.lit("copper").alias("carrier"), F.col("hub").alias("bus0"), F.col("name").alias("bus1"), F.lit(float("inf")).alias("p_nom"), F.lit(-1.0).alias("p_min_pu"))
    return left, new


def integer_weights(df: DataFrame, by: str, weight: str) -> DataFrame:
    """Weights 1..100 relative to the group's greatest."""
    top = F.max(weight).over(W.partitionBy(by))
    return df.withColumn("w", F.greatest(F.coalesce(F.floor(F.try_divide(F.col(weight), top) * 100), F.lit(0)), F.lit(1)).cast("int"))


def allocate_clusters(load: dict[str, float], limit: dict[str, int], n: int) -> dict[str, int]:
    """Whole clusters per country near n times its load share, 1 at least and ``limit`` at
    most: the greedy step with the least squared error is optimal for this convex problem."""
    total = sum(load.values()) or 1.0
    goal = {k: n * v / total for k, v in load.items()}
    out = {k: 1 for k in load}
    if sum(out.values()) > n or sum(limit.values()) < n:
        raise ValueError("no allocation with these bounds")
    while sum(out.values()) < n:
        best = max((k for k in out if out[k] < limit[k]), key=lambda k: (2 * (goal[k] - out[k]) - 1, k))
        out[best] += 1
    return out


def fold_chains(links: DataFrame, keep: DataFrame) -> DataFrame:
    """Chains of links over buses of degree 2 that are not in ``keep`` become one link:
    chain, length (sum), p_nom (least), n.  Each chain is a component of the graph of links
    that share such a bus.
    """
    l = links.select(F.col("name").cast("string").alias("name"), "bus0", "bus1", "length", "p_nom")
    ends = l.select("name", F.col("bus0").alias("bus")).unionAll(l.select("name", F.col("bus1").alias("bus")))
    inner = ends.groupBy("bus").agg(F.count("*").alias("d"), F.min("name").alias("a"), F.max("name").alias("b")).where("d = 2 AND a <> b").join(keep.select("bus"), "bus", "left_anti")
    chains = components(l.select(F.col("name").alias("id")), inner.select("a", "b"))
    return l.join(chains, l["name"] == chains["id"]).groupBy(F.col("component").alias("chain")).agg(F.sum("length").alias("length"), F.min("p_nom").alias("p_nom"), F.count("*").alias("n"))


def topology(branches: DataFrame, factor: float = 1.0) -> DataFrame:
    """Undirected corridors between buses with mean length and summed rating."""
    c = canonical_edges(branches, "bus0", "bus1")
    return c.groupBy("bus0", "bus1").agg((F.avg("length") * factor).alias("length"), F.sum("s_nom").alias("s_nom"))
