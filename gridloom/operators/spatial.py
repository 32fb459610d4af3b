"""Spatial joins without a geometry library: nearest, grids, polygons, overlays of boxes."""

from __future__ import annotations

from functools import reduce
from itertools import product

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.scalars import EARTH_KM, haversine


#: Cells of the nearest search: cubes around the unit sphere with edges of 2^(1 - level); level -1 is one cube.
LEVELS = range(-1, 21)
_SHIFT = (1.1234, 1.2417, 1.1971)  # keeps the equator and the great meridians off the cubes' faces


def _known(*cols) -> Column:
    return reduce(lambda a, b: a & b, [F.col(c).isNotNull() & (F.abs(c) < float("inf")) for c in cols])


def _cube(x: Column, y: Column, level: Column) -> Column:
    lon, lat = F.radians(x), F.radians(y)
    at = (F.cos(lat) * F.cos(lon), F.cos(lat) * F.sin(lon), F.sin(lat))
    return F.struct(level.alias("level"), *[F.floor((a + s) * F.pow(F.lit(2.0), level - 1)).alias(n) for n, a, s in zip("ijk", at, _SHIFT)])


def nearest(points: DataFrame, sites: DataFrame, within: str, point_id: str, site_id: str) -> DataFrame:
    """The nearest site of the same ``within`` group (x, y in degrees), least id on a tie.

    Exact, without all pairs: places that occur several times are searched once.  A site in the
    smallest occupied cube around a point bounds the distance; nothing nearer is beyond the 27
    cubes of an edge of at least that bound, and only their sites are compared.  Without known
    coordinates the distance is null and the site the group's least id.
    """
    s = sites.select(F.col(within).alias("_g"), F.col(site_id).alias("_sid"), F.col("x").alias("_sx"), F.col("y").alias("_sy"))
    levels = F.array(*map(F.lit, LEVELS))
    cube = ["_g", "level", "i", "j", "k"]
    place = s.where(_known("_sx", "_sy")).groupBy("_g", "_sx", "_sy").agg(F.min("_sid").alias("_sid"))
    at = place.select("*", F.explode(F.transform(levels, lambda l: _cube(F.col("_sx"), F.col("_sy"), l))).alias("c")).select("_g", "c.*", "_sid", "_sx", "_sy")
    some = at.groupBy(*cube).agg(F.min(F.struct("_sid", "_sx", "_sy")).alias("m"))
    p = points.select(F.col(within).alias("_g"), F.col("x").alias("_x"), F.col("y").alias("_y")).where(_known("_x", "_y")).distinct()
    own = p.select("*", F.explode(F.transform(levels, lambda l: _cube(F.col("_x"), F.col("_y"), l))).alias("c")).select("_g", "_x", "_y", "c.*")
    met = own.join(some, cube).groupBy("_g", "_x", "_y").agg(F.max(F.struct("level", "m")).alias("m"))
    # The chord to that site, with a reserve for rounding.
    chord = 2 * F.sin(haversine(F.col("_x"), F.col("_y"), F.col("m.m._sx"), F.col("m.m._sy")) / (2 * EARTH_KM)) * (1 + 1e-6) + 1e-9
    level = F.greatest(F.least(F.floor(1 - F.log2(chord)).cast("int"), F.lit(LEVELS[-1])), F.lit(LEVELS[0]))
    c = met.select("_g", "_x", "_y", _cube(F.col("_x"), F.col("_y"), level).alias("c"))
    around = F.array(*[F.struct(*[(F.col(f"c.{n}") + d).alias(n) for n, d in zip("ijk", step)]) for step in product((-1, 0, 1), repeat=3)])
    asked = c.select("_g", "_x", "_y", "c.level", F.explode(around).alias("a")).select("_g", "_x", "_y", "level", "a.*")
    d = haversine(F.col("_x"), F.col("_y"), F.col("_sx"), F.col("_sy"))
    best = asked.join(at, cube).groupBy("_g", "_x", "_y").agg(F.min(F.struct(d.alias("d"), F.col("_sid").alias("s"))).alias("b"))
    least = s.groupBy("_g").agg(F.min("_sid").alias("least"))
    j = points.select(F.col(within).alias("_g"), F.col(point_id), F.col("x").alias("_x"), F.col("y").alias("_y")).join(least, "_g").join(best, ["_g", "_x", "_y"], "left")
    m = F.min(F.struct(F.col("b").isNull().alias("none"), F.col("b.d").alias("d"), F.coalesce("b.s", "least").alias("s")))
    return j.groupBy(point_id).agg(m.alias("m")).select(point_id, F.col("m.s").alias(site_id), F.col("m.d").alias("km"))


def cells(x, y, size: float):
    return F.floor(x / size).cast("long"), F.floor(y / size).cast("long")


def within_radius(a: DataFrame, b: DataFrame, km: float, size_deg: float = 1.0) -> DataFrame:
    """Pairs (a_id, b_id, km) up to a distance: an equi-join on grid cells, b in the cells
    that the radius can reach, across the date line and the poles too."""
    reach = int(np.ceil(km / 111.0 / size_deg))
    around = int(np.ceil(360 / size_deg))  # the last column is narrower if the size does not divide 360
    ax, ay = cells(F.pmod(F.col("x"), F.lit(360.0)), F.col("y"), size_deg)
    ax = F.pmod(ax, F.lit(around))
    left = a.select(F.col("id").alias("a_id"), F.col("x").alias("ax"), F.col("y").alias("ay"), ax.alias("cx"), ay.alias("cy"))
    bx, by = cells(F.pmod(F.col("x"), F.lit(360.0)), F.col("y"), size_deg)
    wide = F.ceil(reach / F.greatest(F.cos(F.radians(F.least(F.abs(F.col("y")) + reach * size_deg, F.lit(89.0)))), F.lit(0.02))).cast("long") + int(around * size_deg != 360)
    wide = F.when(F.abs(F.col("y")) + reach * size_deg >= 88, F.lit(around)).otherwise(F.least(wide, F.lit(around)))
    right = b.select(F.col("id").alias("b_id"), F.col("x").alias("bx"), F.col("y").alias("by"), bx.alias("gx"), by.alias("gy"), wide.alias("w"))
    right = right.withColumn("cx", F.explode(F.expr(f"array_distinct(transform(sequence(gx - w, gx + w), g -> pmod(g, {around})))"))).withColumn("cy", F.explode(F.expr(f"sequence(gy - {reach}L, gy + {reach}L)")))
    d = haversine(F.col("ax"), F.col("ay"), F.col("bx"), F.col("by"))
    return left.join(right, ["cx", "cy"]).select("a_id", "b_id", d.alias("km")).where(F.col("km") <= km)


def in_polygon(px: np.ndarray, py: np.ndarray, ring: np.ndarray) -> np.ndarray:
    """Even-odd rule for points against one ring of (x, y) vertices."""
    inside = np.zeros(len(px), bool)
    x1, y1 = ring[:, 0], ring[:, 1]
    x2, y2 = np.roll(x1, -1), np.roll(y1, -1)
    for a, b, c, d in zip(x1, y1, x2, y2):
        cross = (b > py) != (d > py)
        if b != d:
            inside ^= cross & (px < (c - a) * (py - b) / (d - b) + a)
    return inside


def contained(points: DataFrame, polygons: DataFrame, size: float = 1.0) -> DataFrame:
    """(id, x, y) and (region, ring: array of [x, y]) -> id, region; the least region if
    several hold the point.  Grid cells of the rings' boxes prefilter."""
    xs, ys = F.transform("ring", lambda p: p[0]), F.transform("ring", lambda p: p[1])
    box = polygons.select("region", "ring", F.array_min(xs).alias("x0"), F.array_max(xs).alias("x1"), F.array_min(ys).alias("y0"), F.array_max(ys).alias("y1"))
    box = box.withColumn("cx", F.explode(F.expr(f"sequence(cast(floor(x0 / {size}) as bigint), cast(floor(x1 / {size}) as bigint))")))
    box = box.withColumn("cy", F.explode(F.expr(f"sequence(cast(floor(y0 / {size}) as bigint), cast(floor(y1 / {size}) as bigint))")))
    cx, cy = cells(F.col("x"), F.col("y"), size)
    pairs = points.select("id", "x", "y", cx.alias("cx"), cy.alias("cy")).join(box, ["cx", "cy"]).where("x between x0 and x1 and y between y0 and y1")
    kind = points.schema["id"].dataType.simpleString(), polygons.schema["region"].dataType.simpleString()

    def test(batches):
        for b in batches:
            t = pa.Table.from_batches([b]).to_pandas()
            keep = np.zeros(len(t), bool)
            for _, g in t.groupby("region"):
                ring = np.array([list(p) for p in g["ring"].iloc[0]], float)
                keep[g.index] = in_polygon(g["x"].to_numpy(), g["y"].to_numpy(), ring)
            yield pa.RecordBatch.from_pandas(t.loc[keep, ["id", "region"]], preserve_index=False)

    hit = pairs.select("id", "region", "x", "y", "ring").mapInArrow(test, f"id {kind[0]}, region {kind[1]}")
    return hit.groupBy("id").agg(F.min("region").alias("region"))


def box_shares(source: DataFrame, target: DataFrame, size: float = 1.0) -> DataFrame:
    """Area-weighted overlay of boxes (id, x0, y0, x1, y1): source, target, share of the source's
    area.  Boxes meet by equal grid cells of ``size``; a pair is counted in the cell that holds the
    lower left corner of their overlap."""

    def spread(d: DataFrame, p: str) -> DataFrame:
        d = d.select(F.col("id").alias({"s": "source", "t": "target"}[p]), *[F.col(c).alias(f"{p}{c}") for c in ("x0", "y0", "x1", "y1")])
        for axis in ("x", "y"):
            d = d.withColumn(f"c{axis}", F.explode(F.expr(f"sequence(cast(floor({p}{axis}0 / {size}) as bigint), cast(floor({p}{axis}1 / {size}) as bigint))")))
        return d

    w = F.least("sx1", "tx1") - F.greatest("sx0", "tx0")
    h = F.least("sy1", "ty1") - F.greatest("sy0", "ty0")
    j = spread(source, "s").join(spread(target, "t"), ["cx", "cy"]).where((w > 0) & (h > 0))
    ox, oy = cells(F.greatest("sx0", "tx0"), F.greatest("sy0", "ty0"), size)
    j = j.where((ox == F.col("cx")) & (oy == F.col("cy")))
    return j.select("source", "target", (w * h / ((F.col("sx1") - F.col("sx0")) * (F.col("sy1") - F.col("sy0")))).alias("share"))


def assign_by_overlap(shares: DataFrame) -> DataFrame:
    """The target with the greatest share, the least one on a tie."""
    best = W.partitionBy("source").orderBy(F.desc("share"), "target")
    return shares.withColumn("_r", F.row_number().over(best)).where("_r = 1").select("source", "target")


def on_ring(px: np.ndarray, py: np.ndarray, ring: np.ndarray, eps: float = 1e-12) -> np.ndarray:
    """Whether points are on the border of a ring."""
    a, b = ring, np.roll(ring, -1, axis=0)
    hit = np.zeros(len(px), bool)
    for (x0, y0), (x1, y1) in zip(a, b):
        cross = (x1 - x0) * (py - y0) - (y1 - y0) * (px - x0)
        scale = max(abs(x1 - x0), abs(y1 - y0), 1.0)
        hit |= (np.abs(cross) <= eps * scale) & (px >= min(x0, x1)) & (px <= max(x0, x1)) & (py >= min(y0, y1)) & (py <= max(y0, y1))
    return hit


def assign_regions(points: DataFrame, polygons: DataFrame, size: float = 1.0) -> DataFrame:
    """id, region of every point: strictly inside, else on a border (the least region of several), else
    the region with the nearest centroid (mean of the ring by area).

    Candidates for the first two come by grid cells; the last joins the points left with all
    regions, which are the regions of a map."""
    xs, ys = F.transform("ring", lambda p: p[0]), F.transform("ring", lambda p: p[1])
    box = polygons.select("region", "ring", F.array_min(xs).alias("x0"), F.array_max(xs).alias("x1"), F.array_min(ys).alias("y0"), F.array_max(ys).alias("y1"))
    spread = lambda lo, hi: F.explode(F.expr(f"sequence(cast(floor({lo} / {size}) as bigint), cast(floor({hi} / {size}) as bigint))"))
    box = box.withColumn("cx", spread("x0", "x1")).withColumn("cy", spread("y0", "y1"))
    cx, cy = cells(F.col("x"), F.col("y"), size)
    pairs = points.select("id", "x", "y", cx.alias("cx"), cy.alias("cy")).join(box, ["cx", "cy"]).where("x between x0 and x1 and y between y0 and y1")
    kind = points.schema["id"].dataType.simpleString(), polygons.schema["region"].dataType.simpleString()

    def test(batches):
        for b in batches:
            t = pa.Table.from_batches([b]).to_pandas()
            rank = np.full(len(t), 2)
            for _, g in t.groupby("region"):
                ring = np.array([list(p) for p in g["ring"].iloc[0]], float)
                x, y = g["x"].to_numpy(), g["y"].to_numpy()
                edge = on_ring(x, y, ring)
                rank[g.index] = np.where(edge, 1, np.where(in_polygon(x, y, ring), 0, 2))
            t["rank"] = rank
            yield pa.RecordBatch.from_pandas(t.loc[rank < 2, ["id", "region", "rank"]], preserve_index=False)

    hit = pairs.select("id", "region", "x", "y", "ring").mapInArrow(test, f"id {kind[0]}, region {kind[1]}, rank long")
    got = hit.groupBy("id").agg(F.min(F.struct("rank", "region")).alias("m")).select("id", "m.region")
    mids = polygons.select("region", *[c.alias(n) for c, n in zip(_centroid(), ("_cx", "_cy"))])
    left = points.select("id", "x", "y").join(got, "id", "left_anti").crossJoin(F.broadcast(mids))  # points outside, and the regions of a map
    near = left.groupBy("id").agg(F.min(F.struct(haversine(F.col("x"), F.col("y"), F.col("_cx"), F.col("_cy")).alias("d"), "region")).alias("m")).select("id", "m.region")
    return got.unionByName(near)


def _centroid():
    """x and y of the centroid of ``ring``, by area."""
    nxt = F.expr("concat(slice(ring, 2, size(ring) - 1), slice(ring, 1, 1))")
    edges = F.arrays_zip(F.col("ring").alias("a"), nxt.alias("b"))
    cross = lambda e: e["a"][0] * e["b"][1] - e["b"][0] * e["a"][1]
    total = lambda f: F.aggregate(edges, F.lit(0.0), lambda s, e: s + f(e))
    area = total(cross) * 3
    return [total(lambda e, i=i: (e["a"][i] + e["b"][i]) * cross(e)) / area for i in (0, 1)]


def adjacency(polygons: DataFrame, size: float = 1.0) -> DataFrame:
    """Pairs a < b of regions that touch or overlap: boxes meet by grid cells; then a vertex of one is in
    or on the other, or two edges cross."""
    xs, ys = F.transform("ring", lambda p: p[0]), F.transform("ring", lambda p: p[1])
    box = polygons.select("region", "ring", F.array_min(xs).alias("x0"), F.array_max(xs).alias("x1"), F.array_min(ys).alias("y0"), F.array_max(ys).alias("y1"))
    spread = lambda lo, hi: F.explode(F.expr(f"sequence(cast(floor({lo} / {size}) as bigint), cast(floor({hi} / {size}) as bigint))"))
    at = box.select("region", "x0", "x1", "y0", "y1", spread("x0", "x1").alias("cx")).withColumn("cy", spread("y0", "y1"))
    o = at.select(*[F.col(c).alias(f"o{c}") for c in ("region", "x0", "x1", "y0", "y1")], "cx", "cy")
    meet = at.join(o, ["cx", "cy"]).where("region < oregion AND x0 <= ox1 AND ox0 <= x1 AND y0 <= oy1 AND oy0 <= y1").select(F.col("region").alias("a"), F.col("oregion").alias("b")).distinct()
    j = meet.join(polygons.select(F.col("region").alias("a"), F.col("ring").alias("ra")), "a").join(polygons.select(F.col("region").alias("b"), F.col("ring").alias("rb")), "b")
    kind = polygons.schema["region"].dataType.simpleString()

    def touch(p: np.ndarray, q: np.ndarray) -> bool:
        for u, v in ((p, q), (q, p)):
            if (in_polygon(u[:, 0], u[:, 1], v) | on_ring(u[:, 0], u[:, 1], v)).any():
                return True
        side = lambda a, b, c: (b[..., 0] - a[..., 0]) * (c[..., 1] - a[..., 1]) - (b[..., 1] - a[..., 1]) * (c[..., 0] - a[..., 0])
        a, b = p[:, None], np.roll(p, -1, axis=0)[:, None]
        c, d = q[None], np.roll(q, -1, axis=0)[None]
        return bool(((side(a, b, c) * side(a, b, d) < 0) & (side(c, d, a) * side(c, d, b) < 0)).any())

    def test(batches):
        for x in batches:
            keep = [touch(np.array(p, float), np.array(q, float)) for p, q in zip(x.column("ra").to_pylist(), x.column("rb").to_pylist())]
            yield pa.RecordBatch.from_arrays([x.column("a"), x.column("b")], ["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return j.select("a", "b", "ra", "rb").mapInArrow(test, f"a {kind}, b {kind}")


def overlap_or_nearest(shares: DataFrame, nearest_target: DataFrame) -> DataFrame:
    """The target of the greatest share; a source without any overlap takes its nearest one."""
    best = assign_by_overlap(shares).select("source", F.col("target").alias("_t"))
    return nearest_target.join(best, "source", "left").select("source", F.coalesce("_t", "target").alias("target"))
