"""Graphs as edge tables: components, closure, relaxations, stubs, busmaps.

Iterations are driver loops over distributed steps; lineage is cut by written tables.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def cut(df: DataFrame) -> DataFrame:
    """``df`` written once to the folder that all executors share and read back: its lineage ends
    there, with the plan's size estimates, which would multiply with every round of joins."""
    spark = df.sparkSession
    sc = spark.sparkContext
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if sc._jsc.sc().getCheckpointDir().isEmpty():
            if not sc.master.startswith("local"):
                raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
            sc.setCheckpointDir(tempfile.mkdtemp(prefix="gridloom-"))
        root = sc._jsc.sc().getCheckpointDir().get()
    path = f"{root.rstrip('/')}/cut-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


_cut = cut


def canonical_edges(edges: DataFrame, a: str, b: str) -> DataFrame:
    """Undirected: the lesser end first; self-loops dropped."""
    return edges.where(F.col(a) != F.col(b)).withColumns({a: F.least(a, b), b: F.greatest(a, b)})


def components(nodes: DataFrame, edges: DataFrame, rounds: int = 100) -> DataFrame:
    """(id) and (a, b) -> id, component: the least id reachable; isolated nodes included.

    Alternates two steps until no edge changes: every node sends its greater neighbours to the
    least of its neighbourhood, then its lesser ones.  Long paths halve, so rounds grow with
    their logarithm; minima are partial aggregates, and the join back to a hot node's edges
    is by broadcast or skew handling, as the optimizer sees its size.
    """
    e = _cut(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct())
    for _ in range(rounds):
        both = e.unionAll(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        pair = F.array(F.struct("a", F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))
        new = _cut(large.join(low, "a").select(F.explode(pair).alias("p")).select("p.a", "p.b").where("a <> b").distinct())
        same = not new.exceptAll(e).take(1) and not e.exceptAll(new).take(1)
        e = new
        if same:
            lab = e.groupBy(F.col("a").alias("_i")).agg(F.min("b").alias("_c"))
            return nodes.select("id").join(lab, F.col("id") == F.col("_i"), "left").select("id", F.coalesce("_c", "id").alias("component"))
    raise RuntimeError("components did not settle")


def largest_component(labels: DataFrame) -> DataFrame:
    top = labels.groupBy("component").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "component").limit(1)
    return labels.join(top.select("component"), "component", "left_semi")


def closure(mapping: DataFrame, rounds: int = 40) -> DataFrame:
    """(src, dst) with chains -> src and the last dst, by doubling."""
    m = _cut(mapping.select("src", "dst"))
    for _ in range(rounds):
        nxt = m.select(F.col("src").alias("s2"), F.col("dst").alias("d2"))
        j = _cut(m.join(nxt, m["dst"] == nxt["s2"], "left").select("src", F.coalesce("d2", "dst").alias("dst"), (F.col("d2").isNotNull() & (F.col("d2") != F.col("dst"))).alias("moved")))
        m = j.select("src", "dst")
        if not j.where("moved").take(1):
            return m
    raise RuntimeError("the mapping has a cycle")


def shortest_paths(edges: DataFrame, sources: DataFrame, limit: float | None = None, rounds: int = 200) -> DataFrame:
    """(a, b, weight) undirected, (id) -> id, source, dist: the nearest source, least id on a
    tie; paths beyond ``limit`` are not followed."""
    e = edges.select("a", "b", "weight")
    both = _cut(e.unionAll(e.select(F.col("b").alias("a"), F.col("a").alias("b"), "weight")).groupBy("a", "b").agg(F.min("weight").alias("weight")))
    best = _cut(sources.select("id", F.col("id").alias("source"), F.lit(0.0).alias("dist")).distinct())
    front = best
    for _ in range(rounds):
        step = front.join(both, front["id"] == both["a"]).select(F.col("b").alias("id"), "source", (F.col("dist") + F.col("weight")).alias("dist"))
        if limit is not None:
            step = step.where(F.col("dist") <= limit)
        cand = step.groupBy("id").agg(F.min(F.struct("dist", "source")).alias("n"))
        old = best.select(F.col("id").alias("_i"), F.struct("dist", "source").alias("o"))
        front = _cut(cand.join(old, cand["id"] == old["_i"], "left").where("o IS NULL OR n < o").select("id", "n.source", "n.dist"))
        if not front.take(1):
            return best
        best = _cut(best.join(front.select("id"), "id", "left_anti").unionByName(front.select("id", "source", "dist")))
    raise RuntimeError("shortest paths did not settle")


def prune_stubs(nodes: DataFrame, edges: DataFrame, rounds: int = 1000) -> DataFrame:
    """id -> bus: nodes of degree 1 are folded, again and again, into their only neighbour."""
    e = _cut(canonical_edges(edges.select("a", "b"), "a", "b").distinct())
    m = nodes.sparkSession.createDataFrame([], nodes.select(F.col("id").alias("src"), F.col("id").alias("dst")).schema)
    for _ in range(rounds):
        ends = e.select(F.col("a").alias("id"), F.col("b").alias("other")).unionAll(e.select(F.col("b").alias("id"), F.col("a").alias("other")))
        leaf = ends.groupBy("id").agg(F.count("*").alias("n"), F.min("other").alias("other")).where("n = 1")
        # Of a lone pair, the greater id is folded.
        partner = leaf.select(F.col("id").alias("pid"))
        drop = _cut(leaf.join(partner, leaf["other"] == partner["pid"], "left").where("pid IS NULL OR id > other").select(F.col("id").alias("src"), F.col("other").alias("dst")))
        if not drop.take(1):
            break
        m = m.unionByName(drop)
        gone = drop.select(F.col("src").alias("x"))
        e = _cut(e.join(gone, e["a"] == gone["x"], "left_anti").join(gone, e["b"] == gone["x"], "left_anti"))
    full = closure(m)
    return nodes.select("id").join(full, F.col("id") == F.col("src"), "left").select("id", F.coalesce("dst", "id").alias("bus"))


def map_branches(branches: DataFrame, busmap: DataFrame, ports: list[str], by: list[str], aggs: dict) -> DataFrame:
    """Map every port through (old, new), drop branches whose ports meet, merge parallels."""
    d = branches
    for p in ports:
        m = busmap.select(F.col("old").alias("_o"), F.col("new").alias("_n"))
        d = d.join(m, d[p] == m["_o"], "left").withColumn(p, F.coalesce("_n", p)).drop("_o", "_n")
    d = canonical_edges(d, ports[0], ports[1])
    return d.groupBy(*ports, *by).agg(*[v.alias(k) for k, v in aggs.items()])


def prune_dangling(branches: DataFrame, buses: DataFrame, ports: list[str], id_col: str = "name") -> DataFrame:
    """Branches with all ports among the buses."""
    for p in ports:
        b = buses.select(F.col(id_col).alias("_b"))
        branches = branches.join(b, branches[p] == b["_b"], "left_semi")
    return branches


def lossy_split(links: DataFrame, per_1000km: float, static: float = 1.0) -> DataFrame:
    """Bidirectional links as two lossy ones; the reversed one costs nothing and is marked."""
    eff = F.lit(static) * F.pow(F.lit(per_1000km), F.col("length") / 1000)
    fwd = links.withColumns({"efficiency": eff, "reversed": F.lit(False)})
    swap = {"name": F.concat("name", F.lit("-reversed")), "bus0": F.col("bus1"), "bus1": F.col("bus0"), "capital_cost": F.lit(0.0), "reversed": F.lit(True)}
    return fwd.unionByName(fwd.select(*[swap[c].alias(c) if c in swap else F.col(c) for c in fwd.columns]))
