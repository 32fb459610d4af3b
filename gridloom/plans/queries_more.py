"""Base network, places, profiles, prices and physics as queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import scalars
from ..operators import allocation, base_network, network, sectors, spatial, temporal
from ..sources import readers
from .network_views import ctes, view
from .registry import query, r


# --------------------------------------------------------------- base network
def _raw_buses(c):
    k = F.col("s_suppkey")
    return c.supplier.select(k.cast("string").alias("bus_id"), F.when(k % 7 != 0, 110.0 + (k % 5) * 90).alias("voltage"), F.when(k % 11 == 0, "t").otherwise("f").alias("dc"), F.when(k % 3 == 0, "t").when(k % 3 == 1, "f").alias("under_construction"), (k % 20).cast("double").alias("x"), (k % 9).cast("double").alias("y"), F.concat(F.lit("C"), (k % 4).cast("string")).alias("country"))


_B = "b AS (SELECT s_suppkey::VARCHAR AS bus_id, CASE WHEN s_suppkey % 7 <> 0 THEN 110.0 + (s_suppkey % 5) * 90 END AS v_nom, CASE WHEN s_suppkey % 11 = 0 THEN 'DC' ELSE 'AC' END AS carrier, s_suppkey % 3 = 0 AS under_construction FROM supplier WHERE s_suppkey % 4 < 3 AND (s_suppkey % 7 = 0 OR s_suppkey % 11 = 0 OR 110 + (s_suppkey % 5) * 90 BETWEEN 200 AND 400))"


@query(f"WITH {_B} SELECT * FROM b")
def base_buses(c):
    return base_network.buses(_raw_buses(c), None, ["C0", "C1", "C2"], 200.0, 400.0).select("bus_id", "v_nom", "carrier", "under_construction")


_LN = """l AS (SELECT c_custkey::VARCHAR AS line_id, (c_custkey % (SELECT count(*) FROM supplier))::VARCHAR AS bus0, (c_custkey * 7 % (SELECT count(*) FROM supplier))::VARCHAR AS bus1, 220.0 + (c_custkey % 8) * 40 AS v_nom, 1.0 + c_custkey % 3 AS num_parallel, c_custkey * 1.0 AS length, c_custkey % 5 = 0 AS uc FROM customer)"""


@query(f"""WITH {_B}, {_LN}, t AS (SELECT *, CASE WHEN v_nom <= 260 THEN '220' WHEN v_nom <= 340 THEN '300' ELSE '380' END AS type FROM l WHERE bus0 IN (SELECT bus_id FROM b) AND bus1 IN (SELECT bus_id FROM b))
 SELECT line_id, length / 1000 AS length, type, CASE WHEN uc THEN 0 ELSE num_parallel END AS num_parallel, round(CASE WHEN uc THEN 0 ELSE sqrt(3.0) * CASE type WHEN '220' THEN 1.29 WHEN '300' THEN 1.935 ELSE 2.58 END * v_nom * num_parallel END, 4) AS s_nom FROM t""")
def base_lines(c):
    k, n = F.col("c_custkey"), c.supplier.count()
    raw = c.customer.select(k.cast("string").alias("line_id"), (k % n).cast("string").alias("bus0"), (k * 7 % n).cast("string").alias("bus1"), (220.0 + (k % 8) * 40).alias("voltage"), (1.0 + k % 3).alias("circuits"), (k * 1.0).alias("length"), F.when(k % 5 == 0, "t").otherwise("f").alias("under_construction"))
    b = base_network.buses(_raw_buses(c), None, ["C0", "C1", "C2"], 200.0, 400.0)
    l = base_network.line_parameters(base_network.branches(raw, b, "AC", "line"), {220.0: "220", 300.0: "300", 380.0: "380"}, {"220": 1.29, "300": 1.935, "380": 2.58}, 0.7)
    return base_network.under_construction(l, "zero", ["num_parallel", "s_nom"]).select("line_id", "length", "type", "num_parallel", r("s_nom").alias("s_nom"))


@query("SELECT p_partkey::VARCHAR AS link_id, CASE WHEN p_partkey % 10 = 3 THEN 5.0 WHEN p_partkey % 4 = 1 THEN 7.0 ELSE p_size * 1.0 END AS p_nom, CASE WHEN p_partkey % 2 = 0 THEN 'FR' END AS country FROM part")
def tag_corrections(c):
    k = F.col("p_partkey")
    d = c.part.select(k.cast("string").alias("link_id"), (F.col("p_size") * 1.0).alias("p_nom"), F.concat(F.lit('"oid"=>"'), (k % 4).cast("string"), F.lit('", '), F.when(k % 2 == 0, '"country"=>"FR"').otherwise('"country"=>"fr"')).alias("tags"))
    one = c.part.where("p_partkey % 10 = 3").select(F.lit("index").alias("by"), k.cast("string").alias("id"), F.lit(5.0).alias("value"))
    rules = one.unionByName(c.spark.createDataFrame([("oid", "1", 7.0)], "by string, id string, value double"))
    out = base_network.corrections(d, rules, "link_id", "p_nom")
    return out.select("link_id", "p_nom", base_network.tag(out, "country").alias("country"))


_EN = "(k % 17) * 1.3 AS x0, (k % 11) * 1.7 AS y0, (k % 13) * 0.9 AS x1, (k % 7) * 2.1 AS y1"


@query(f"""WITH o AS (SELECT s_suppkey AS id, {_EN.replace('k', 's_suppkey')} FROM supplier), n AS (SELECT c_custkey AS id, {_EN.replace('k', '(c_custkey * 5 + 2)')} FROM customer), b AS (SELECT * FROM n UNION ALL SELECT id, x1, y1, x0, y0 FROM n),
 d AS (SELECT b.id, o.id AS link, sqrt((b.x0 - o.x0)**2 + (b.y0 - o.y0)**2 + (b.x1 - o.x1)**2 + (b.y1 - o.y1)**2) AS d FROM b, o) SELECT id, round(min(d), 5) AS d FROM d WHERE d < 1.5 GROUP BY 1""")
def closest_links(c):
    ends = lambda k: [((k % 17) * 1.3).alias("x0"), ((k % 11) * 1.7).alias("y0"), ((k % 13) * 0.9).alias("x1"), ((k % 7) * 2.1).alias("y1")]
    old = c.supplier.select(F.col("s_suppkey").alias("id"), *ends(F.col("s_suppkey")))
    new = c.customer.select(F.col("c_custkey").alias("id"), *ends(F.col("c_custkey") * 5 + 2))
    got = base_network.closest_links(old, new, 1.5)
    j = got.join(new, "id").join(old.select(F.col("id").alias("link"), *[F.col(x).alias(f"o{x}") for x in ("x0", "y0", "x1", "y1")]), "link")
    d = lambda a, b: F.least(*[F.sqrt(sum(((F.col(x) - F.col(f"o{y}")) ** 2 for x, y in zip(e, ("x0", "y0", "x1", "y1"))), F.lit(0.0))) for e in (a, b)])
    return j.select("id", r(d(("x0", "y0", "x1", "y1"), ("x1", "y1", "x0", "y0")), 5).alias("d"))


# --------------------------------------------------------------------- places
_RINGS = [("a", [[0.0, 0.0], [10.0, 0.0], [10.0, 10.0], [0.0, 10.0]]), ("b", [[10.0, 0.0], [20.0, 0.0], [20.0, 10.0], [10.0, 10.0]]), ("c", [[40.0, 40.0], [50.0, 40.0], [50.0, 50.0], [40.0, 50.0]])]


@query("""WITH p AS (SELECT c_custkey AS id, (c_custkey % 12) * 5.0 AS x, (c_custkey % 11) * 5.0 AS y FROM customer), z(region, x0, y0, x1, y1) AS (VALUES ('a', 0, 0, 10, 10), ('b', 10, 0, 20, 10), ('c', 40, 40, 50, 50)),
 i AS (SELECT id, min(region) AS region FROM p JOIN z ON x > x0 AND x < x1 AND y > y0 AND y < y1 GROUP BY 1), t AS (SELECT id, min(region) AS region FROM p JOIN z ON x >= x0 AND x <= x1 AND y >= y0 AND y <= y1 GROUP BY 1),
 n AS (SELECT id, arg_min(region, (2 * 6371.0 * asin(sqrt(pow(sin(radians((y0 + y1) / 2 - y) / 2), 2) + cos(radians(y)) * cos(radians((y0 + y1) / 2)) * pow(sin(radians((x0 + x1) / 2 - x) / 2), 2))), region)) AS region FROM p, z GROUP BY 1)
 SELECT p.id, coalesce(i.region, t.region, n.region) AS region FROM p LEFT JOIN i ON i.id = p.id LEFT JOIN t ON t.id = p.id LEFT JOIN n ON n.id = p.id""")
def region_fallback(c):
    p = c.customer.select(F.col("c_custkey").alias("id"), ((F.col("c_custkey") % 12) * 5.0).alias("x"), ((F.col("c_custkey") % 11) * 5.0).alias("y"))
    return spatial.assign_regions(p, c.spark.createDataFrame(_RINGS, "region string, ring array<array<double>>"), 5.0)


@query("SELECT * FROM (VALUES ('a', 'b'), ('a', 'd'), ('b', 'd'), ('d', 'e')) t(a, b)")
def region_adjacency(c):
    rings = [*_RINGS, ("d", [[5.0, 5.0], [15.0, 5.0], [15.0, 30.0], [5.0, 30.0]]), ("e", [[7.0, 12.0], [8.0, 12.0], [8.0, 13.0], [7.0, 13.0]])]
    return spatial.adjacency(c.spark.createDataFrame(rings, "region string, ring array<array<double>>"), 5.0)


@query(f"""{ctes('generators')}, s AS (SELECT name, 'B' || CAST(floor(k / 16) AS INT) % 25 AS target, p_nom AS share FROM generators WHERE k % 3 = 0) SELECT g.name AS source, coalesce(s.target, 'near') AS target FROM generators g LEFT JOIN s ON s.name = g.name""")
def overlap_fallback(c):
    g = view(c, "generators")
    shares = g.where("k % 3 = 0").select(F.col("name").alias("source"), F.concat(F.lit("B"), (F.floor(F.col("k") / 16).cast("int") % 25).cast("string")).alias("target"), F.col("p_nom").alias("share"))
    near = g.select(F.col("name").alias("source"), F.lit("near").alias("target"))
    return spatial.overlap_or_nearest(shares, near)


# ------------------------------------------------------------ profiles, prices
@query("WITH h AS (SELECT event_type, date_trunc('hour', ts) AS t, sum(value) AS v FROM events GROUP BY 1, 2) SELECT event_type, t, round(v / sum(v) OVER (PARTITION BY event_type) * length(event_type) * 1000, 6) AS p FROM h")
def profile_total(c):
    h = c.events.groupBy("event_type", F.date_trunc("hour", "ts").cast("timestamp_ntz").alias("t")).agg(F.sum("value").alias("v"))
    totals = c.events.select("event_type").distinct().withColumn("total", F.length("event_type") * 1000.0)
    return temporal.profile_times_total(h, totals, "event_type", "v", "total").select("event_type", "t", r("v", 6).alias("p"))


@query("WITH m AS (SELECT date_trunc('month', o_orderdate) AS t, avg(o_totalprice) AS p FROM orders GROUP BY 1) SELECT t, round(p / (SELECT avg(p) FROM m WHERE year(t) = 1995) * 30, 6) AS p FROM m")
def monthly_price_scaled(c):
    m = c.orders.groupBy(F.date_trunc("month", "o_orderdate").cast("timestamp_ntz").alias("t")).agg(F.avg("o_totalprice").alias("p"))
    return temporal.scale_to_year(m, "t", "p", 1995, 30.0).withColumn("p", r("p", 6))


@query(f"{ctes('generators', 'snapshots')} SELECT name, snapshot, round(marginal_cost + (20 + snapshot) * CASE carrier WHEN 'coal' THEN 0.3361 WHEN 'OCGT' THEN 0.198 ELSE 0 END / efficiency, 6) AS marginal_cost FROM generators, snapshots")
def emission_prices(c):
    price = view(c, "snapshots").select("snapshot", (20.0 + F.col("snapshot")).alias("price"))
    k = c.spark.createDataFrame([("coal", 0.3361), ("OCGT", 0.198)], "carrier string, co2_emissions double")
    return sectors.emission_prices(view(c, "generators"), k, price).select("name", "snapshot", r("marginal_cost", 6).alias("marginal_cost"))


@query("WITH d AS (SELECT event_type, ts::DATE AS d, avg(value) AS t FROM events GROUP BY 1, 2) SELECT event_type, year(d) AS y, round(sum(greatest(60 - t, 0)), 6) AS hdd FROM d GROUP BY 1, 2")
def degree_days(c):
    return temporal.degree_days(c.events, ["event_type"], "ts", "value", 60.0).select("event_type", F.col("year").cast("long").alias("y"), r("hdd", 6).alias("hdd"))


@query("SELECT month(ts) AS month, event_type, round(avg(6.81 - 0.121 * (55 - value) + 0.00063 * (55 - value) ** 2), 6) AS cop FROM events GROUP BY 1, 2")
def cop_monthly(c):
    cop = scalars.cop_quadratic(55.0 - F.col("value"), 6.81, -0.121, 0.00063)
    return c.events.groupBy(F.month("ts").cast("long").alias("month"), "event_type").agg(r(F.avg(cop), 6).alias("cop"))


@query("WITH p AS (SELECT event_type, dayofweek(ts) AS d, avg(value) AS v FROM events GROUP BY ALL), s AS (SELECT event_type, avg(v) AS m, min(v) AS lo FROM p GROUP BY 1) SELECT p.event_type, d::INT AS d, round(0.95 - (0.95 - 0.8) * (v - lo) / (m - lo), 6) AS a FROM p JOIN s ON s.event_type = p.event_type")
def vehicle_availability(c):
    p = c.events.groupBy("event_type", (F.dayofweek("ts") - 1).alias("d")).agg(F.avg("value").alias("v"))
    s = p.groupBy("event_type").agg(F.avg("v").alias("m"), F.min("v").alias("lo"))
    return p.join(s, "event_type").select("event_type", "d", r(scalars.availability(F.col("v"), 0.95, 0.8, F.col("m"), F.col("lo")), 6).alias("a"))


@query("SELECT event_id, round(CASE WHEN value <= 10 THEN 90 WHEN value >= 60 THEN 65 ELSE 90 - 25 * (value - 10) / 50 END, 6) AS forward, round(0.5 + 25.5 / (1 + exp(0.15 * (14 - value))), 6) AS river, round(0.05 * (1 + 0.00403 * (value - 20)), 8) AS ohm, CASE WHEN value < 5 THEN 5 WHEN value > 80 THEN 80 ELSE value END AS clipped FROM events")
def physics(c):
    from ..operators.frames import clip

    v = F.col("value")
    return c.events.select("event_id", r(scalars.forward_temperature(v, 90.0, 65.0, 10.0, 60.0), 6).alias("forward"), r(scalars.sigmoid_temperature(v, 0.5, 26.0, 0.15, 14.0), 6).alias("river"), r(scalars.resistance(F.lit(0.05), v), 8).alias("ohm"), clip(v, 5.0, 80.0).alias("clipped"))


@query("SELECT p_partkey, round(sqrt(3.0) * 380 * 2.58 * p_size, 6) AS s_nom, round(p_size * (220.0 / 380) ** 2, 8) AS circuits FROM part")
def line_ratings(c):
    n = F.col("p_size").cast("double")
    return c.part.select("p_partkey", r(network.line_rating(n, F.lit(380.0), 2.58), 6).alias("s_nom"), r(network.circuits_to_one_voltage(n, F.lit(220.0), 380.0), 8).alias("circuits"))


@query("WITH s AS (SELECT c_nationkey AS country, c_custkey AS plant, abs(c_acctbal) AS p FROM customer) SELECT plant, k AS t, round((country + 1) * 100.0 * k * p / sum(p) OVER (PARTITION BY country, k), 6) AS inflow FROM s, (VALUES (1), (2)) v(k)")
def hydro_inflow(c):
    plants = c.customer.select(F.col("c_nationkey").alias("country"), F.col("c_custkey").alias("plant"), F.abs("c_acctbal").alias("p_nom"))
    flow = c.nation.select(F.col("n_nationkey").alias("country"), F.explode(F.array(F.lit(1), F.lit(2))).alias("t")).withColumn("v", (F.col("country") + 1) * 100.0 * F.col("t"))
    return allocation.hydro_inflow(flow, plants, "country", "t", "v").withColumn("inflow", r("inflow", 6))


@query(f"{ctes('generators_t')} SELECT g.name, s.snapshot, round(CASE WHEN carrier IN ('solar', 'onwind') THEN t.p_max_pu ELSE 0.9 END, 6) AS p_max_pu FROM generators g CROSS JOIN snapshots s JOIN generators_t t ON t.name = g.name AND t.snapshot = s.snapshot")
def switchable_attribute(c):
    g = view(c, "generators").withColumn("p_max_pu", F.lit(0.9))
    series = view(c, "generators_t").join(g.where("carrier IN ('solar', 'onwind')").select("name"), "name", "left_semi").select("name", "snapshot", F.lit("p_max_pu").alias("attr"), F.col("p_max_pu").alias("value"))
    return readers.switchable(g, series, "p_max_pu", view(c, "snapshots")).select("name", "snapshot", r("p_max_pu", 6).alias("p_max_pu"))


@query("""WITH n AS (SELECT s_suppkey AS node, s_nationkey AS ct, (s_suppkey % 50)::DOUBLE AS x, (s_suppkey % 30)::DOUBLE AS y FROM supplier), p AS (SELECT c_custkey AS port, c_nationkey AS ct, (c_custkey % 50 + 0.25) AS x, (c_custkey % 30 + 0.1) AS y, (c_custkey % 9 + 1)::DOUBLE AS o FROM customer),
 d AS (SELECT port, o, p.ct, arg_min(node, (2 * 6371.0 * asin(sqrt(pow(sin(radians(n.y - p.y) / 2), 2) + cos(radians(p.y)) * cos(radians(n.y)) * pow(sin(radians(n.x - p.x) / 2), 2))), node)) AS node FROM p JOIN n ON n.ct = p.ct GROUP BY 1, 2, 3)
 SELECT ct, node, round(sum(o) / sum(sum(o)) OVER (PARTITION BY ct), 8) AS share FROM d GROUP BY ct, node""")
def port_shares(c):
    k, s = F.col("c_custkey"), F.col("s_suppkey")
    ports = c.customer.select(k.alias("port"), F.col("c_nationkey").alias("ct"), (k % 50 + 0.25).cast("double").alias("x"), (k % 30 + 0.1).cast("double").alias("y"), (k % 9 + 1).cast("double").alias("outflow"))
    nodes = c.supplier.select(s.alias("node"), F.col("s_nationkey").alias("ct"), (s % 50).cast("double").alias("x"), (s % 30).cast("double").alias("y"))
    return sectors.port_shares(ports, nodes, "ct").withColumn("share", r("share", 8))


@query("WITH RECURSIVE i AS (SELECT p_partkey AS k, [p_size * 1.0, 2.0, -1.0, 4.0] AS f FROM part), s(k, t, e) AS (SELECT k, 0, 10.0::DOUBLE FROM i UNION ALL SELECT s.k, t + 1, e * 0.99 + f[t + 1] FROM s JOIN i ON i.k = s.k WHERE t < 4) SELECT k, t, round(e, 8) AS e FROM s")
def storage_levels(c):
    f = F.array((F.col("p_size") * 1.0), F.lit(2.0), F.lit(-1.0), F.lit(4.0))
    levels = scalars.storage_levels(f, F.lit(10.0), 0.99)
    return c.part.select(F.col("p_partkey").alias("k"), F.posexplode(levels).alias("t", "e")).select("k", "t", r("e", 8).alias("e"))
