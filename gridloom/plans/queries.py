"""Registered queries over the test tables, each with the SQL that must give the same rows.

Roles: nation = bus and country, region = super-region, part = technology (p_type is its
carrier), supplier = plant, customer = load, lineitem = dispatch, events = series.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import scalars
from ..operators import allocation, cleaning, clustering, frames, graph, network, sectors, spatial, temporal
from . import summary
from .registry import ORACLE, QUERIES, query, r  # noqa: F401


# ------------------------------------------------------------ network mapping
def dispatch(c) -> DataFrame:
    """lineitem as dispatch: quantity is power, price per unit the marginal cost, returns consume."""
    l = c.lineitem.select("l_orderkey", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount", "l_returnflag", "l_shipdate")
    j = (
        l.join(c.part.select(F.col("p_partkey").alias("l_partkey"), F.col("p_type").alias("carrier")), "l_partkey")
        .join(c.supplier.select(F.col("s_suppkey").alias("l_suppkey"), F.col("s_nationkey").alias("n_nationkey")), "l_suppkey")
        .join(c.nation.select("n_nationkey", F.col("n_name").alias("bus"), "n_regionkey"), "n_nationkey")
    )
    return j.select(
        F.lit("Generator").alias("component"), F.col("l_suppkey").alias("name"), "carrier", "bus", "n_regionkey", F.col("l_shipdate").alias("snapshot"), F.col("l_quantity").alias("p"),
        (1 - F.col("l_discount")).alias("w"), F.when(F.col("l_returnflag") == "R", -1.0).otherwise(1.0).alias("sign"), (F.col("l_extendedprice") / F.col("l_quantity")).alias("marginal_cost"), "l_orderkey", "l_partkey",
    )


_D = """d AS (SELECT 'Generator' AS component, s_suppkey AS name, p_type AS carrier, n_name AS bus, n_regionkey, l_shipdate AS snapshot, l_quantity AS p, 1 - l_discount AS w,
  CASE WHEN l_returnflag = 'R' THEN -1.0 ELSE 1.0 END AS sign, l_extendedprice / l_quantity AS marginal_cost, l_orderkey, l_partkey
  FROM lineitem JOIN part ON p_partkey = l_partkey JOIN supplier ON s_suppkey = l_suppkey JOIN nation ON n_nationkey = s_nationkey)"""


def assets(c) -> DataFrame:
    return c.part.select("p_partkey", F.col("p_type").alias("carrier"), F.col("p_brand").alias("bus"), F.col("p_size").cast("double").alias("p_nom_opt"), F.col("p_retailprice").alias("capital_cost"), (F.col("p_size") / 50.0).alias("efficiency"))


def hourly(c) -> DataFrame:
    """Events as an hourly series per type, with gaps (NULL) where nothing happened."""
    e = c.events.groupBy("event_type", F.date_trunc("hour", "ts").cast("timestamp_ntz").alias("t")).agg(F.avg("value").alias("v"))
    span = c.events.agg(F.date_trunc("hour", F.min("ts")).cast("timestamp_ntz").alias("a"), F.date_trunc("hour", F.max("ts")).cast("timestamp_ntz").alias("b"))
    spine = span.select(F.explode(F.expr("sequence(a, b, interval 1 hour)")).alias("t")).crossJoin(c.events.select("event_type").distinct())
    return frames.reindex(e, spine, ["event_type", "t"])


_H = """h AS (SELECT s.event_type, s.t, e.v FROM
  (SELECT * FROM (SELECT unnest(generate_series(date_trunc('hour', min(ts)), date_trunc('hour', max(ts)), INTERVAL 1 HOUR)) AS t FROM events), (SELECT DISTINCT event_type FROM events)) s
  LEFT JOIN (SELECT event_type, date_trunc('hour', ts) AS t, avg(value) AS v FROM events GROUP BY 1, 2) e USING (event_type, t))"""


# ------------------------------------------------------------------ summaries
@query(f"WITH {_D} SELECT component, carrier, bus, round(sum(sign * p * w), 4) AS energy FROM d GROUP BY ALL")
def energy_balance(c):
    return summary.energy_balance(dispatch(c), ["component", "carrier", "bus"]).withColumn("energy", r("energy"))


@query(f"""WITH {_D}, m AS (SELECT carrier, bus, sum(abs(p) * w * marginal_cost) AS value, 'marginal' AS cost FROM d GROUP BY ALL),
 k AS (SELECT p_type AS carrier, p_brand AS bus, sum(p_retailprice * p_size) AS value, 'capital' AS cost FROM part GROUP BY ALL)
 SELECT carrier, bus, round(value, 2) AS value, cost FROM (SELECT * FROM m UNION ALL SELECT * FROM k)""")
def nodal_costs(c):
    return summary.costs(assets(c), dispatch(c), ["carrier", "bus"]).withColumn("value", r("value", 2))


@query("SELECT p_type AS carrier, round(sum(p_size), 4) AS p_nom_opt FROM part GROUP BY 1")
def capacities(c):
    return summary.capacities(assets(c), ["carrier"]).withColumn("p_nom_opt", r("p_nom_opt"))


@query("""WITH y AS (SELECT o_orderstatus AS label, year(o_orderdate)::DOUBLE AS x, sum(o_totalprice) AS y FROM orders GROUP BY ALL),
 v AS (SELECT label, rate, x, y / pow(1 + rate, x - 1992) AS v FROM y, (SELECT unnest([0.0, 0.05, 0.09]) AS rate)),
 a AS (SELECT label, rate, (v + lag(v) OVER w) / 2 * (x - lag(x) OVER w) AS a FROM v WINDOW w AS (PARTITION BY label, rate ORDER BY x))
 SELECT label, rate, round(coalesce(sum(a), 0), 2) AS total FROM a GROUP BY ALL""")
def cumulative_costs(c):
    y = c.orders.groupBy(F.col("o_orderstatus").alias("label"), F.year("o_orderdate").alias("x")).agg(F.sum("o_totalprice").alias("y"))
    return temporal.trapezoid(y, ["label"], "x", "y", [0.0, 0.05, 0.09], 1992.0).withColumn("total", r("total", 2))


@query("""WITH u AS (SELECT 'orders' AS k, o_orderstatus AS label, year(o_orderdate) AS y, o_totalprice AS v FROM orders UNION ALL SELECT 'lines', l_linestatus, year(l_shipdate), l_extendedprice FROM lineitem)
 SELECT k, label, round(sum(v) FILTER (WHERE y = 1994), 2) AS "1994", round(sum(v) FILTER (WHERE y = 1995), 2) AS "1995", round(sum(v) FILTER (WHERE y = 1996), 2) AS "1996" FROM u GROUP BY ALL""")
def global_summary_pivot(c):
    o = c.orders.select(F.lit("orders").alias("k"), F.col("o_orderstatus").alias("label"), F.year("o_orderdate").alias("y"), F.col("o_totalprice").alias("v"))
    l = c.lineitem.select(F.lit("lines").alias("k"), F.col("l_linestatus").alias("label"), F.year("l_shipdate").alias("y"), F.col("l_extendedprice").alias("v"))
    return summary.wide(o.unionByName(l), ["k", "label"], "y", [1994, 1995, 1996], "v").select("k", "label", *[r(y, 2).alias(y) for y in ("1994", "1995", "1996")])


@query("""SELECT c_custkey, coalesce(CASE WHEN n_name IS NOT NULL AND c_nationkey % 3 <> 0 THEN n_name END, CASE WHEN c_mktsegment <> 'BUILDING' THEN c_mktsegment END, 'EU') AS location
 FROM customer LEFT JOIN nation ON n_nationkey = c_nationkey""")
def assign_location(c):
    d = c.customer.join(c.nation.select(F.col("n_nationkey").alias("c_nationkey"), "n_name"), "c_nationkey", "left")
    d = d.withColumn("l0", F.when(F.col("c_nationkey") % 3 != 0, F.col("n_name")).otherwise("EU")).withColumn("l1", F.when(F.col("c_mktsegment") == "BUILDING", "").otherwise(F.col("c_mktsegment")))
    return summary.assign_location(d, ["l0", "l1"]).select("c_custkey", "location")


@query("""WITH l AS (SELECT l_orderkey AS name, l_suppkey::VARCHAR AS bus0, CASE WHEN l_linenumber % 2 = 0 THEN '' ELSE l_partkey::VARCHAR END AS bus1, l_quantity AS p0, -l_quantity * 0.9 AS p1 FROM lineitem)
 SELECT port, count(*) AS n, round(sum(p), 4) AS p FROM (SELECT 0 AS port, -p0 AS p FROM l WHERE bus0 <> '' UNION ALL SELECT 1, -p1 FROM l WHERE bus1 <> '') GROUP BY 1""")
def link_ports(c):
    l = c.lineitem.select(F.col("l_orderkey").alias("name"), F.col("l_suppkey").cast("string").alias("bus0"), F.when(F.col("l_linenumber") % 2 == 0, "").otherwise(F.col("l_partkey").cast("string")).alias("bus1"), F.col("l_quantity").alias("p0"), (-F.col("l_quantity") * 0.9).alias("p1"))
    return summary.ports_long(l, 2).groupBy("port").agg(F.count("*").alias("n"), r(F.sum("p")).alias("p"))


# -------------------------------------------------- aggregation and allocation
@query("""SELECT p_type AS carrier, round(sum(p_retailprice), 2) AS cost, round(avg(p_size), 6) AS size, min(p_size) AS smallest, string_agg(DISTINCT p_brand, ';' ORDER BY p_brand) AS brands, arg_min(p_name, p_partkey) AS name FROM part GROUP BY 1""")
def capacities_by_strategy(c):
    p = c.part.select(F.col("p_type").alias("carrier"), F.col("p_retailprice").alias("cost"), F.col("p_size").alias("size"), F.col("p_size").alias("smallest"), F.col("p_brand").alias("brands"), F.col("p_name").alias("name"), "p_partkey")
    g = frames.strategies(p, ["carrier"], {"cost": "sum", "size": "mean", "smallest": "min", "brands": "join", "name": "first"}, order="p_partkey")
    return g.select("carrier", r("cost", 2).alias("cost"), r("size", 6).alias("size"), "smallest", "brands", "name")


@query("""SELECT p_type AS carrier, round(sum(p_size / 50.0 * l_quantity) / sum(l_quantity), 6) AS efficiency FROM lineitem JOIN part ON p_partkey = l_partkey GROUP BY 1""")
def capacity_weighted_efficiency(c):
    j = c.lineitem.select(F.col("l_partkey").alias("p_partkey"), "l_quantity").join(assets(c), "p_partkey")
    return j.groupBy("carrier").agg(r(frames.weighted_avg(F.col("efficiency"), F.col("l_quantity")), 6).alias("efficiency"))


@query("""WITH s AS (SELECT s_nationkey AS ct, s_suppkey AS node, CASE WHEN s_suppkey % 4 <> 0 THEN abs(s_acctbal) END AS a FROM supplier),
 q AS (SELECT ct, quantile_cont(a, 0.2) AS q FROM s GROUP BY 1), f AS (SELECT s.ct, node, coalesce(a, q) AS v FROM s JOIN q ON q.ct = s.ct),
 k AS (SELECT ct, node, coalesce(v / nullif(sum(v) OVER (PARTITION BY ct), 0), 1.0 / count(*) OVER (PARTITION BY ct)) AS share FROM f),
 p AS (SELECT c_nationkey AS ct, c_custkey AS node, abs(c_acctbal) AS w FROM customer WHERE c_nationkey NOT IN (SELECT ct FROM k))
 SELECT ct, node, round(share, 8) AS share FROM k UNION ALL SELECT ct, node, round(w / nullif(sum(w) OVER (PARTITION BY ct), 0), 8) FROM p""")
def distribution_key(c):
    s = c.supplier.select(F.col("s_nationkey").alias("ct"), F.col("s_suppkey").alias("node"), F.when(F.col("s_suppkey") % 4 != 0, F.abs("s_acctbal")).alias("a"))
    p = c.customer.select(F.col("c_nationkey").alias("ct"), F.col("c_custkey").alias("node"), F.abs("c_acctbal").alias("w"))
    return allocation.with_fallback(allocation.distribution_key(s, "ct", "node", "a"), p, "ct", "node", "w").withColumn("share", r("share", 8))


@query("""WITH t AS (SELECT n_nationkey AS ct, n_nationkey * 100.0 + 50 AS total FROM nation)
 SELECT ct, node, round(total * w / sum(w) OVER (PARTITION BY ct), 6) AS total FROM (SELECT c_nationkey AS ct, c_custkey AS node, abs(c_acctbal) AS w FROM customer) JOIN t USING (ct)""")
def population_weighted_disagg(c):
    t = c.nation.select(F.col("n_nationkey").alias("ct"), (F.col("n_nationkey") * 100.0 + 50).alias("total"))
    k = c.customer.select(F.col("c_nationkey").alias("ct"), F.col("c_custkey").alias("node"), frames.normed(F.abs("c_acctbal"), "c_nationkey").alias("share"))
    return allocation.disaggregate(t, k, "ct", "total").select("ct", "node", r("total", 6).alias("total"))


@query("""WITH g AS (SELECT c_nationkey AS ct, c_custkey AS region, abs(c_acctbal) AS gdp, (c_custkey % 7 + 1)::DOUBLE AS pop FROM customer),
 m AS (SELECT ct, region, 0.6 * gdp / sum(gdp) OVER w + 0.4 * pop / sum(pop) OVER w AS m FROM g WINDOW w AS (PARTITION BY ct))
 SELECT ct, region, round(1000.0 * m / sum(m) OVER (PARTITION BY ct), 6) AS load FROM m""")
def upsample_load(c):
    g = c.customer.select(F.col("c_nationkey").alias("ct"), F.col("c_custkey").alias("region"), F.abs("c_acctbal").alias("gdp"), (F.col("c_custkey") % 7 + 1).cast("double").alias("pop"))
    load = c.nation.select(F.col("n_nationkey").alias("ct"), F.lit(1000.0).alias("load"))
    return allocation.upsample(load, g, "ct", "load", "gdp", "pop").select("ct", "region", r("load", 6).alias("load"))


@query("""WITH b AS (SELECT p_partkey AS tech, 'size' AS parameter, p_size::DOUBLE AS value FROM part UNION ALL SELECT p_partkey, 'price', p_retailprice FROM part),
 k AS (SELECT p_partkey AS tech, 'size' AS parameter, 99.0 AS value FROM part WHERE p_partkey % 10 = 0)
 SELECT tech, parameter, round(CASE WHEN parameter = 'price' THEN 7.5 ELSE coalesce(k.value, b.value) END, 4) AS value FROM b LEFT JOIN k USING (tech, parameter)""")
def override_costs(c):
    p = c.part.withColumn("tech", F.col("p_partkey").cast("string"))
    b = p.select("tech", F.lit("size").alias("parameter"), F.col("p_size").cast("double").alias("value")).unionByName(p.select("tech", F.lit("price").alias("parameter"), F.col("p_retailprice").alias("value")))
    k = p.where("p_partkey % 10 = 0").select("tech", F.lit("size").alias("parameter"), F.lit(99.0).alias("value"))
    every = c.region.limit(1).select(F.lit("all").alias("tech"), F.lit("price").alias("parameter"), F.lit(7.5).alias("value"))
    return frames.override(b, k.unionByName(every), "tech", "parameter", "value").select(F.col("tech").cast("long").alias("tech"), "parameter", r("value").alias("value"))


@query("""SELECT p_partkey, round(CASE WHEN p_size % 5 = 0 THEN 1.0 / (p_size + 1) ELSE 0.07 / (1 - 1 / pow(1.07, p_size + 1)) END, 8) AS a FROM part""")
def annuity(c):
    rate = F.when(F.col("p_size") % 5 == 0, 0.0).otherwise(0.07)
    return c.part.select("p_partkey", r(scalars.annuity((F.col("p_size") + 1).cast("double"), rate), 8).alias("a"))


@query("""SELECT g, count(*) AS n FROM (SELECT CASE WHEN y <= 1993 THEN 1993 WHEN y <= 1995 THEN 1995 WHEN y <= 1997 THEN 1997 END AS g FROM (SELECT year(o_orderdate) AS y FROM orders)) GROUP BY 1""")
def vintage_bins(c):
    return allocation.vintage_bins(c.orders.select(F.year("o_orderdate").alias("y")), "y", [1993, 1995, 1997], "g").groupBy("g").agg(F.count("*").alias("n"))


@query("""SELECT level, substr(p_brand, 1, level::INT) AS code, round(sum(p_retailprice), 2) AS v FROM part, (SELECT unnest([5, 6, 7, 8]) AS level) WHERE length(p_brand) >= level GROUP BY ALL""")
def prefix_rollup(c):
    return frames.prefix_rollup(c.part.withColumnRenamed("p_retailprice", "v"), "p_brand", "v", (5, 8)).withColumn("v", r("v", 2))


@query("""WITH b AS (SELECT p_partkey, p_retailprice AS v FROM part), u AS (SELECT p_partkey, CASE WHEN p_partkey % 2 = 0 THEN 1.5 END AS v FROM part WHERE p_partkey % 3 = 0)
 SELECT b.p_partkey, round(coalesce(u.v, b.v), 4) AS v FROM b LEFT JOIN u USING (p_partkey)""")
def update_values(c):
    u = c.part.where("p_partkey % 3 = 0").select("p_partkey", F.when(F.col("p_partkey") % 2 == 0, 1.5).alias("v"))
    return frames.update(c.part.select("p_partkey", F.col("p_retailprice").alias("v")), u, ["p_partkey"], ["v"]).withColumn("v", r("v"))


@query("""WITH a AS (SELECT s_nationkey AS k, sum(s_acctbal) AS x FROM supplier WHERE s_nationkey < 15 GROUP BY 1), b AS (SELECT c_nationkey AS k, sum(c_acctbal) AS y FROM customer WHERE c_nationkey > 8 GROUP BY 1)
 SELECT coalesce(a.k, b.k) AS k, round(coalesce(x, 0) - coalesce(y, 0), 2) AS d, round(coalesce(x, y), 2) AS first FROM a FULL JOIN b ON a.k = b.k""")
def align_subtract(c):
    a = c.supplier.where("s_nationkey < 15").groupBy(F.col("s_nationkey").alias("k")).agg(F.sum("s_acctbal").alias("x"))
    b = c.customer.where("c_nationkey > 8").groupBy(F.col("c_nationkey").alias("k")).agg(F.sum("c_acctbal").alias("y"))
    first = frames.combine_first(a, b.withColumnRenamed("y", "x"), ["k"], ["x"]).select("k", r("x", 2).alias("first"))
    return frames.align(a, b, ["k"], 0.0).select("k", r(F.col("x") - F.col("y"), 2).alias("d")).join(first, "k")


@query("""WITH g AS (SELECT c_nationkey AS ct, c_custkey AS node, abs(c_acctbal) AS pot, (c_custkey % 5)::DOUBLE AS have FROM customer), s AS (SELECT ct, sum(have) AS have FROM g GROUP BY 1),
 a AS (SELECT g.ct, node, pot / sum(pot) OVER (PARTITION BY g.ct) * greatest(100.0 - s.have, 0) AS a FROM g JOIN s ON s.ct = g.ct)
 SELECT ct, node, round(CASE WHEN a > 0.1 THEN a ELSE 0 END, 6) AS added FROM a""")
def capacity_gap(c):
    g = c.customer.select(F.col("c_nationkey").alias("ct"), F.col("c_custkey").alias("node"), F.abs("c_acctbal").alias("pot"), (F.col("c_custkey") % 5).cast("double").alias("have"))
    t = c.nation.select(F.col("n_nationkey").alias("ct"), F.lit(100.0).alias("target"))
    return allocation.capacity_gap(g, t, "ct", "node", "pot", "have", "target").withColumn("added", r("added", 6))


# ------------------------------------------------------------------- temporal
@query(f"""WITH {_H}, i AS (SELECT *, count(v) OVER (PARTITION BY event_type ORDER BY t) AS isl FROM h)
 SELECT event_type, t, CASE WHEN v IS NULL THEN count(*) FILTER (WHERE v IS NULL) OVER (PARTITION BY event_type, isl) ELSE 0 END AS gap_len FROM i""")
def gap_runs(c):
    return temporal.gap_runs(hourly(c), ["event_type"], "t", "v").select("event_type", "t", "gap_len")


@query(f"""WITH {_H}, n AS (SELECT *, row_number() OVER w AS i FROM h WINDOW w AS (PARTITION BY event_type ORDER BY t)),
 p AS (SELECT *, max(CASE WHEN v IS NOT NULL THEN i END) OVER (PARTITION BY event_type ORDER BY i) AS pi, min(CASE WHEN v IS NOT NULL THEN i END) OVER (PARTITION BY event_type ORDER BY i ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS ni FROM n)
 SELECT p.event_type, p.t, round(CASE WHEN p.v IS NOT NULL THEN p.v WHEN p.i - pi <= 3 AND ni IS NOT NULL THEN a.v + (b.v - a.v) * (p.i - pi) / (ni - pi) WHEN p.i - pi <= 3 THEN a.v END, 6) AS filled
 FROM p LEFT JOIN n a ON a.event_type = p.event_type AND a.i = pi LEFT JOIN n b ON b.event_type = p.event_type AND b.i = ni""")
def interpolate_limit3(c):
    return temporal.interpolate(hourly(c), ["event_type"], "t", "v", 3, "filled").select("event_type", "t", r("filled", 6).alias("filled"))


@query(f"WITH {_H} SELECT a.event_type, a.t, round(coalesce(a.v, b.v), 6) AS filled FROM h a LEFT JOIN h b ON b.event_type = a.event_type AND a.t = b.t + INTERVAL 7 DAY")
def shift_fill_1w(c):
    return temporal.shift_fill(hourly(c), ["event_type"], "t", "v", "7 days", "filled").select("event_type", "t", r("filled", 6).alias("filled"))


@query("SELECT event_type, time_bucket(INTERVAL 3 HOUR, ts, TIMESTAMP '1970-01-01') AS bucket, round(avg(value), 6) AS value, round(sum(user_id), 4) AS w FROM events GROUP BY ALL")
def resample_3h(c):
    d = temporal.nhour(c.events.withColumn("w", F.col("user_id").cast("double")), ["event_type"], "ts", 3, ["value"], ["w"])
    return d.select("event_type", "bucket", r("value", 6).alias("value"), r("w").alias("w"))


@query("""WITH s AS (SELECT unnest(generate_series(TIMESTAMP '2024-02-28', TIMESTAMP '2024-03-02 23:00:00', INTERVAL 1 HOUR)) AS t)
 SELECT t, CASE WHEN t = TIMESTAMP '2024-03-01' THEN 24.0 ELSE 1.0 END AS w FROM s WHERE NOT (month(t) = 2 AND day(t) = 29)""")
def leap_day_weight_shift(c):
    s = temporal.snapshots(c.spark, [("2024-02-28", "2024-03-03")]).select(F.col("snapshot").alias("t"), F.lit(1.0).alias("w"))
    return temporal.leap_day_shift(s, "t", "w")


@query("""SELECT key, count(*) AS n FROM (SELECT ((isodow(l) - 1) * 24 + hour(l))::INT AS key FROM (SELECT timezone('Europe/Berlin', timezone('UTC', ts)) AS l FROM events)) GROUP BY 1""")
def weekly_profile_local(c):
    return c.events.groupBy(temporal.week_hour(F.col("ts"), "Europe/Berlin").alias("key")).agg(F.count("*").alias("n"))


@query("""WITH d AS (SELECT event_type, ts::DATE AS d, avg(value) AS v FROM events GROUP BY ALL),
 m AS (SELECT *, CASE WHEN count(v) OVER w = 5 THEN avg(v) OVER w END AS r FROM d WINDOW w AS (PARTITION BY event_type ORDER BY d ROWS 4 PRECEDING))
 SELECT event_type, d::VARCHAR AS d, round(first_value(r IGNORE NULLS) OVER (PARTITION BY event_type ORDER BY d ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING), 6) AS m FROM m""")
def rolling_mean_bfill(c):
    d = c.events.groupBy("event_type", F.to_date("ts").alias("d")).agg(F.avg("value").alias("v"))
    return temporal.rolling_mean(d, ["event_type"], "d", "v", 5, "m").select("event_type", F.col("d").cast("string").alias("d"), r("m", 6).alias("m"))


@query("""WITH y AS (SELECT o_orderpriority AS k, year(o_orderdate) AS y, sum(o_totalprice) AS v FROM orders GROUP BY ALL)
 SELECT k, y, round(CASE WHEN lag(v) OVER w IS NULL THEN v ELSE greatest(v - lag(v) OVER w, 0) END, 2) AS d FROM y WINDOW w AS (PARTITION BY k ORDER BY y)""")
def yearly_increment_clip(c):
    y = c.orders.groupBy(F.col("o_orderpriority").alias("k"), F.year("o_orderdate").cast("long").alias("y")).agg(F.sum("o_totalprice").alias("v"))
    return temporal.increments(y, ["k"], "y", "v", "d").select("k", "y", r("d", 2).alias("d"))


@query("""WITH s AS (SELECT unnest(generate_series(TIMESTAMP '2024-01-05', TIMESTAMP '2024-01-07 23:00:00', INTERVAL 1 HOUR)) AS t),
 e AS (SELECT date_trunc('hour', ts) AS t, sum(value) AS v FROM events GROUP BY 1), f AS (SELECT s.t, last_value(v IGNORE NULLS) OVER (ORDER BY s.t ROWS UNBOUNDED PRECEDING) AS v FROM s LEFT JOIN e ON e.t = s.t)
 SELECT hour(t)::INT AS hour, round(max(v) FILTER (WHERE day(t) = 5), 4) AS "01-05", round(max(v) FILTER (WHERE day(t) = 6), 4) AS "01-06", round(max(v) FILTER (WHERE day(t) = 7), 4) AS "01-07" FROM f GROUP BY 1""")
def heatmap_day_hour(c):
    e = c.events.groupBy(F.date_trunc("hour", "ts").cast("timestamp_ntz").alias("t")).agg(F.sum("value").alias("v"))
    spine = temporal.snapshots(c.spark, [("2024-01-05", "2024-01-08")])
    return temporal.heatmap(e, spine, "t", "v", ["01-05", "01-06", "01-07"]).select("hour", *[r(F.col(f"`{d}`")).alias(d) for d in ("01-05", "01-06", "01-07")])


@query("SELECT event_type, idx - 1 AS idx, round(v * 24, 4) AS w FROM (SELECT event_type, row_number() OVER (PARTITION BY event_type ORDER BY d) AS idx, v FROM (SELECT event_type, ts::DATE AS d, avg(value) AS v FROM events GROUP BY ALL)) WHERE (idx - 1) % 24 = 0")
def every_nth_snapshot(c):
    d = c.events.groupBy("event_type", F.to_date("ts").alias("d")).agg(F.avg("value").alias("w"))
    d = d.withColumn("idx", F.row_number().over(W.partitionBy("event_type").orderBy("d")).cast("long") - 1).select("event_type", "idx", "w")
    return temporal.every_nth(d, "idx", 24, ["w"]).withColumn("w", r("w"))


@query("""WITH d AS (SELECT event_type, ts::DATE AS d, avg(value) AS v FROM events GROUP BY ALL), n AS (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY d) - 1 AS i, count(*) OVER (PARTITION BY event_type) AS n FROM d)
 SELECT a.event_type, a.i, round(b.v, 6) AS shifted FROM n a JOIN n b ON b.event_type = a.event_type AND b.i = (a.i - 3 + a.n) % a.n""")
def cyclic_shift(c):
    d = c.events.groupBy("event_type", F.to_date("ts").alias("d")).agg(F.avg("value").alias("v"))
    d = d.withColumn("i", F.row_number().over(W.partitionBy("event_type").orderBy("d")).cast("long") - 1)
    return temporal.cyclic_shift(d, ["event_type"], "i", "v", 3, "shifted").select("event_type", "i", r("shifted", 6).alias("shifted"))


@query("""SELECT period, round(list_sum([1 / pow(1.02, x) for x in generate_series(start, start + years - 1)]), 8) AS objective FROM (VALUES (2030, 0, 10), (2040, 10, 10), (2050, 20, 5)) t(period, start, years)""")
def period_weights(c):
    p = c.spark.createDataFrame([(2030, 0, 10), (2040, 10, 10), (2050, 20, 5)], "period int, start int, years int")
    return temporal.period_weights(p, "start", "years", 0.02).select("period", r("objective", 8).alias("objective"))


@query("""SELECT count(*) AS n, min(t) AS first, max(t) AS last FROM (SELECT unnest(generate_series(TIMESTAMP '2024-02-01', TIMESTAMP '2024-03-31 23:00:00', INTERVAL 1 HOUR)) AS t UNION SELECT unnest(generate_series(TIMESTAMP '2024-07-01', TIMESTAMP '2024-07-02 23:00:00', INTERVAL 1 HOUR))) WHERE NOT (month(t) = 2 AND day(t) = 29)""")
def snapshot_ranges(c):
    s = temporal.snapshots(c.spark, [("2024-02-01", "2024-04-01"), ("2024-07-01", "2024-07-03")], drop_leap_day=True)
    return s.agg(F.count("*").alias("n"), F.min("snapshot").alias("first"), F.max("snapshot").alias("last"))


@query("""WITH r AS (SELECT * FROM (VALUES (DATE '2024-01-03', 10), (DATE '2024-01-12', 20)) t(day, size)) SELECT event_id, round(value * size, 4) AS value FROM events JOIN r ON ts::DATE = day""")
def representative_days(c):
    days = c.spark.createDataFrame([("2024-01-03", 10), ("2024-01-12", 20)], "day string, size int").withColumn("day", F.to_date("day"))
    return temporal.representative_days(c.events.select("event_id", "ts", "value"), "ts", days, "value").select("event_id", r("value").alias("value"))


@query("""WITH a AS (SELECT * FROM (VALUES (DATE '2024-01-01', DATE '2024-01-03'), (DATE '2024-01-02', DATE '2024-01-03'), (DATE '2024-01-03', DATE '2024-01-03')) t(day, rep))
 SELECT event_id, day + (ts - date_trunc('day', ts)) AS ts FROM events JOIN a ON ts::DATE = rep""")
def expand_days(c):
    a = c.spark.createDataFrame([("2024-01-01", "2024-01-03"), ("2024-01-02", "2024-01-03"), ("2024-01-03", "2024-01-03")], "day string, rep_day string")
    return temporal.expand_days(c.events.select("event_id", "ts"), "ts", a.select(F.to_date("day").alias("day"), F.to_date("rep_day").alias("rep_day"))).select("event_id", "ts")


@query()
def segmentation(c):
    d = c.events.groupBy("event_type", F.to_date("ts").cast("timestamp_ntz").alias("t")).agg(F.avg("value").alias("v"), F.count("*").cast("double").alias("n"))
    return temporal.segments(d, ["event_type"], "t", ["v", "n"], 6)


@query("SELECT round(avg(CASE WHEN value < 20 THEN (20 - value) * 0.3 WHEN value > 60 THEN (value - 60) * 0.5 WHEN value > 20 AND value < 60 THEN 0 ELSE value END), 6) AS factor FROM events")
def degree_factor(c):
    return c.events.agg(r(F.avg(scalars.degree_factor(F.col("value"), 20.0, 60.0, 0.3, 0.5)), 6).alias("factor"))


# ------------------------------------------------------------------- cleaning
@query("""SELECT CASE WHEN n > 1 THEN id || '-' || i::VARCHAR ELSE id END AS id, v, w FROM (SELECT p_partkey::VARCHAR AS id, CASE WHEN p_partkey % 2 = 0 THEN 2 ELSE 1 END AS n, unnest(CASE WHEN p_partkey % 2 = 0 THEN [1, 2] ELSE [1] END) AS i,
 unnest(CASE WHEN p_partkey % 2 = 0 THEN ['220', '380'] ELSE ['110'] END) AS v, unnest(CASE WHEN p_partkey % 2 = 0 THEN ['3', '6'] ELSE ['3'] END) AS w FROM part)""")
def split_cells(c):
    even = F.col("p_partkey") % 2 == 0
    d = c.part.select(F.col("p_partkey").alias("id"), F.when(even, "220;380").otherwise("110").alias("v"), F.when(even, "3;6").otherwise("3").alias("w"))
    return cleaning.split_cells(d, "id", ["v", "w"])


@query("SELECT p_partkey FROM part WHERE p_size >= 30 OR p_partkey % 50 >= 30")
def voltage_filter(c):
    v = F.concat_ws(";", F.col("p_size").cast("string"), (F.col("p_partkey") % 50).cast("string"), F.lit("x"))
    return c.part.where(cleaning.any_at_least(v, 30)).select("p_partkey")


@query("SELECT source, string_agg(DISTINCT lang, ';' ORDER BY lang) AS lang, min(doc_id) AS doc_id FROM documents GROUP BY 1")
def dedup_concat_country(c):
    return cleaning.dedup_concat(c.documents, "source", "lang", ["doc_id"])


@query("""SELECT p_partkey, arg_min(n, d * 1000 + i) AS type FROM (SELECT p_partkey, abs(p_size * 10.0 - x) AS d, i, n FROM part, (VALUES (220.0, 0, 'a'), (300.0, 1, 'b'), (380.0, 2, 'c')) t(x, i, n)) GROUP BY 1""")
def nearest_type(c):
    return frames.closest(c.part.select("p_partkey", (F.col("p_size") * 10.0).alias("v")), "v", [(220.0, "a"), (300.0, "b"), (380.0, "c")], "type").select("p_partkey", "type")


@query("""SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events""")
def json_props(c):
    return c.events.select("event_id", F.from_json("props", "k bigint")["k"].alias("k"))


@query("SELECT doc_id, lang = 'en' AS en, lang = 'de' AS de, source = 'src1' AS src1 FROM documents")
def one_hot_tags(c):
    return cleaning.one_hot_tags(c.documents.select("doc_id", F.concat_ws(" ", "lang", "source").alias("tags")), ["doc_id"], "tags", ["en", "de", "src1"])


# ----------------------------------------------------------------------- joins
@query("SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_partkey IN (SELECT p_partkey FROM part WHERE p_size > 25) AND l_suppkey IN (SELECT s_suppkey FROM supplier WHERE s_acctbal > 0)")
def anti_semi_branches(c):
    l = graph.prune_dangling(c.lineitem, c.part.where("p_size > 25"), ["l_partkey"], "p_partkey")
    return graph.prune_dangling(l, c.supplier.where("s_acctbal > 0"), ["l_suppkey"], "s_suppkey").select("l_orderkey", "l_linenumber")


@query("SELECT c_custkey, n_name AS bus FROM customer LEFT JOIN (SELECT * FROM nation WHERE n_regionkey < 3) n ON n_nationkey = c_nationkey")
def lookup_map(c):
    return frames.lookup(c.customer.select("c_custkey", "c_nationkey"), c.nation.where("n_regionkey < 3"), "c_nationkey", "n_nationkey", "n_name", "bus").select("c_custkey", "bus")


# ----------------------------------------------------------------------- graph
def branch_edges(c) -> DataFrame:
    """Suppliers of an order are joined in a chain; a sparse multigraph of plants."""
    l = c.lineitem.select("l_orderkey", "l_linenumber", "l_suppkey", "l_quantity")
    nxt = F.lead("l_suppkey").over(W.partitionBy("l_orderkey").orderBy("l_linenumber", "l_suppkey", "l_quantity"))
    return l.withColumn("b", nxt).where("b is not null and b <> l_suppkey").select(F.col("l_suppkey").alias("a"), "b", F.col("l_quantity").alias("weight"))


_E = """e AS (SELECT a, b, weight FROM (SELECT l_suppkey AS a, lead(l_suppkey) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_suppkey, l_quantity) AS b, l_quantity AS weight FROM lineitem) WHERE b IS NOT NULL AND b <> a)"""


@query(f"WITH {_E} SELECT least(a, b) AS a, greatest(a, b) AS b, count(*) AS n, round(avg(weight), 6) AS weight FROM e GROUP BY 1, 2")
def edge_canonical(c):
    return graph.canonical_edges(branch_edges(c), "a", "b").groupBy("a", "b").agg(F.count("*").alias("n"), r(F.avg("weight"), 6).alias("weight"))


@query(f"WITH {_E}, m AS (SELECT s_suppkey AS old, s_nationkey AS new FROM supplier), j AS (SELECT x.new AS a, y.new AS b, weight FROM e JOIN m x ON x.old = a JOIN m y ON y.old = b) SELECT least(a, b)::BIGINT AS a, greatest(a, b)::BIGINT AS b, count(*) AS n, round(sum(weight), 4) AS weight FROM j WHERE a <> b GROUP BY 1, 2")
def busmap_aggregate(c):
    m = c.supplier.select(F.col("s_suppkey").alias("old"), F.col("s_nationkey").cast("long").alias("new"))
    return graph.map_branches(branch_edges(c), m, ["a", "b"], [], {"n": F.count("*"), "weight": r(F.sum("weight"))})


_BOTH = "u AS (SELECT a, b, weight FROM e UNION ALL SELECT b, a, weight FROM e)"


@query(f"WITH RECURSIVE {_E}, u AS (SELECT DISTINCT a, b FROM (SELECT a, b FROM e UNION ALL SELECT b, a FROM e)), t(id, r) AS (SELECT s_suppkey, s_suppkey FROM supplier UNION SELECT t.id, u.b FROM t JOIN u ON u.a = t.r) SELECT id, min(r) AS component FROM t GROUP BY 1")
def components(c):
    return graph.components(c.supplier.select(F.col("s_suppkey").alias("id")), branch_edges(c))


@query("WITH m AS (SELECT p_partkey AS src, p_partkey // 2 AS dst FROM part WHERE p_partkey % 2 = 0 AND p_partkey > 0) SELECT src, dst FROM (SELECT src, src // (src & -src) AS dst FROM m)")
def trafo_closure(c):
    return graph.closure(c.part.where("p_partkey % 2 = 0 AND p_partkey > 0").select(F.col("p_partkey").alias("src"), F.expr("p_partkey div 2").alias("dst")))


@query(f"WITH {_E}, l AS (SELECT a || '-' || b AS name, a, b, max(weight) AS weight FROM e GROUP BY ALL) SELECT name, a AS bus0, b AS bus1, round(pow(0.97, weight / 1000), 8) AS efficiency, false AS reversed FROM l UNION ALL SELECT name || '-reversed', b, a, round(pow(0.97, weight / 1000), 8), true FROM l")
def lossy_links(c):
    l = branch_edges(c).groupBy("a", "b").agg(F.max("weight").alias("weight")).withColumn("name", F.concat_ws("-", F.col("a").cast("string"), F.col("b").cast("string")))
    out = graph.lossy_split(l.select("name", F.col("a").alias("bus0"), F.col("b").alias("bus1"), F.col("weight").alias("length"), F.lit(1.0).alias("capital_cost")), 0.97)
    return out.select("name", "bus0", "bus1", r("efficiency", 8).alias("efficiency"), "reversed")


# ------------------------------------------------------------------ clustering
_F = """f AS (SELECT event_type, d AS day, avg(value) AS mean, stddev_pop(value) AS std, min(value) AS lo, max(value) AS hi, coalesce(max(step), 0) AS ramp_max FROM
 (SELECT event_type, ts::DATE AS d, value, abs(value - lag(value) OVER (PARTITION BY event_type, ts::DATE ORDER BY ts, event_id)) AS step FROM events) GROUP BY ALL)"""


def features(c) -> DataFrame:
    return clustering.daily_features(c.events, "event_type", "ts", "value")


@query(f"WITH {_F} SELECT event_type, day::VARCHAR AS day, round((mean - avg(mean) OVER ()) / stddev_pop(mean) OVER (), 5) AS mean, round((hi - avg(hi) OVER ()) / stddev_pop(hi) OVER (), 5) AS hi FROM f")
def zscore(c):
    return clustering.scale(features(c), ["mean", "hi"]).select("event_type", F.col("day").cast("string").alias("day"), r("mean", 5).alias("mean"), r("hi", 5).alias("hi"))


_P = "f AS (SELECT event_type, ts::DATE AS day, avg(value) AS mean FROM events GROUP BY ALL), p AS (SELECT x.event_type AS a, y.event_type AS b, sqrt(sum((x.mean - y.mean) * (x.mean - y.mean))) AS dist FROM f x JOIN f y ON x.day = y.day AND x.event_type < y.event_type GROUP BY ALL)"


@query(f"WITH {_P}, s AS (SELECT id, sum(dist) AS total FROM (SELECT a AS id, dist FROM p UNION ALL SELECT b, dist FROM p) GROUP BY 1) SELECT 'all' AS cluster, arg_min(id, total) AS medoid, count(*) AS size FROM s")
def medoids(c):
    p = clustering.distances(features(c), "event_type", ["day"], "mean")
    return clustering.medoids(p, c.events.select(F.col("event_type").alias("id"), F.lit("all").alias("cluster")).distinct())


@query()
def hac_threshold(c):
    return clustering.hac_points(c.embeddings, "label", "vec_id", "embedding", 1.35)


# --------------------------------------------------------------------- spatial
_XY = "(c_custkey % 360 - 180)::DOUBLE AS x, (c_custkey % 140 - 70)::DOUBLE AS y"
_HAV = "2 * 6371.0 * asin(sqrt(pow(sin(radians({y2} - {y1}) / 2), 2) + cos(radians({y1})) * cos(radians({y2})) * pow(sin(radians({x2} - {x1}) / 2), 2)))"


def customers_xy(c) -> DataFrame:
    return c.customer.select(F.col("c_custkey").alias("id"), F.col("c_nationkey").alias("ct"), (F.col("c_custkey") % 360 - 180).cast("double").alias("x"), (F.col("c_custkey") % 140 - 70).cast("double").alias("y"))


def suppliers_xy(c) -> DataFrame:
    return c.supplier.select(F.col("s_suppkey").alias("sid"), F.col("s_nationkey").alias("ct"), (F.col("s_suppkey") * 7 % 360 - 180).cast("double").alias("x"), (F.col("s_suppkey") * 3 % 140 - 70).cast("double").alias("y"))


@query(f"WITH a AS (SELECT c_custkey AS id, c_nationkey AS ct, {_XY} FROM customer), b AS (SELECT s_suppkey AS sid, s_nationkey AS ct, (s_suppkey * 7 % 360 - 180)::DOUBLE AS x, (s_suppkey * 3 % 140 - 70)::DOUBLE AS y FROM supplier) SELECT a.id, round(min({_HAV.format(x1='a.x', y1='a.y', x2='b.x', y2='b.y')}), 4) AS km FROM a JOIN b ON a.ct = b.ct GROUP BY 1")
def nearest_site(c):
    return spatial.nearest(customers_xy(c), suppliers_xy(c), "ct", "id", "sid").select("id", r("km").alias("km"))


@query(f"WITH a AS (SELECT c_custkey AS id, {_XY} FROM customer), b AS (SELECT s_suppkey AS sid, (s_suppkey * 7 % 360 - 180)::DOUBLE AS x, (s_suppkey * 3 % 140 - 70)::DOUBLE AS y FROM supplier) SELECT a.id AS a_id, b.sid AS b_id, round({_HAV.format(x1='a.x', y1='a.y', x2='b.x', y2='b.y')}, 4) AS km FROM a, b WHERE {_HAV.format(x1='a.x', y1='a.y', x2='b.x', y2='b.y')} <= 300")
def radius_join(c):
    return spatial.within_radius(customers_xy(c), suppliers_xy(c).withColumnRenamed("sid", "id"), 300.0).withColumn("km", r("km"))


@query(f"WITH a AS (SELECT c_custkey AS id, {_XY} FROM customer) SELECT id, CASE WHEN x > 0 AND x < 20 AND y > 0 AND y < 20 - x THEN 't' WHEN x > -50.5 AND x < -20.5 AND y > -30.5 AND y < 10.5 THEN 'q' END AS region FROM a WHERE (x > 0 AND x < 20 AND y > 0 AND y < 20 - x) OR (x > -50.5 AND x < -20.5 AND y > -30.5 AND y < 10.5)")
def point_in_region(c):
    rings = [("t", [[0.001, 0.001], [19.5, 0.001], [0.001, 19.5]]), ("q", [[-50.5, -30.5], [-20.5, -30.5], [-20.5, 10.5], [-50.5, 10.5]])]
    return spatial.contained(customers_xy(c), c.spark.createDataFrame(rings, "region string, ring array<array<double>>"), 5.0)


@query("""WITH s AS (SELECT n_nationkey AS id, (n_nationkey % 5)::DOUBLE AS x0, (n_nationkey % 5 + 1.5)::DOUBLE AS x1, (n_nationkey // 5)::DOUBLE AS y0, (n_nationkey // 5 + 1)::DOUBLE AS y1 FROM nation), t AS (SELECT r_regionkey AS id, r_regionkey::DOUBLE AS x0, r_regionkey + 1.0 AS x1, 0.0 AS y0, 3.0 AS y1 FROM region)
 SELECT s.id AS source, t.id AS target, round((least(s.x1, t.x1) - greatest(s.x0, t.x0)) * (least(s.y1, t.y1) - greatest(s.y0, t.y0)) / ((s.x1 - s.x0) * (s.y1 - s.y0)), 8) AS share FROM s JOIN t ON s.x0 < t.x1 AND t.x0 < s.x1 AND s.y0 < t.y1 AND t.y0 < s.y1""")
def area_overlay(c):
    k = F.col("n_nationkey")
    s = c.nation.select(k.alias("id"), (k % 5).cast("double").alias("x0"), (k % 5 + 1.5).cast("double").alias("x1"), F.floor(k / 5).cast("double").alias("y0"), (F.floor(k / 5) + 1).cast("double").alias("y1"))
    q = F.col("r_regionkey")
    t = c.region.select(q.alias("id"), q.cast("double").alias("x0"), (q + 1.0).alias("x1"), F.lit(0.0).alias("y0"), F.lit(3.0).alias("y1"))
    return spatial.box_shares(s, t).withColumn("share", r("share", 8))


# ----------------------------------------------------------- scalars and rules
@query("""SELECT p_partkey, round(CASE WHEN p_size * 25.0 < 500 THEN p_size * 25.0 * 3 WHEN p_size * 25.0 < 600 THEN 1500 + (p_size * 25.0 - 500) * 35 WHEN p_size * 25.0 < 900 THEN 5000 + (p_size * 25.0 - 600) * 6250 / 300 ELSE 11250 + (p_size * 25.0 - 900) * 10450 / 300 END, 4) AS mw FROM part""")
def pipe_capacity(c):
    return c.part.select("p_partkey", r(scalars.pipe_capacity(F.col("p_size") * 25.0)).alias("mw"))


@query("""WITH t AS (SELECT event_id, value + 273.15 AS x FROM events), m AS (SELECT event_id, CASE WHEN 343.15 = 313.15 THEN 343.15 ELSE 30.0 / ln(343.15 / 313.15) END AS hot, CASE WHEN x = x - 3 THEN x ELSE 3.0 / ln(x / (x - 3)) END AS cold FROM t)
 SELECT event_id, round(CASE WHEN hot > cold THEN 0.5 * hot / (hot - cold) END, 4) AS cop FROM m""")
def cop_lorenz(c):
    x = F.col("value") + 273.15
    return c.events.select("event_id", r(scalars.cop_lorenz(F.lit(313.15), F.lit(343.15), x, x - 3.0)).alias("cop"))


# -------------------------------------------------------- network construction
def lines(c) -> DataFrame:
    return c.lineitem.select(F.col("l_orderkey").cast("string").alias("line_id"), (F.col("l_partkey") % 50).alias("geometry"), (F.col("l_linenumber") * 110000).alias("voltage"), F.col("l_quantity").alias("circuits"))


@query("SELECT bus, ceil(sum(s))::BIGINT AS s_nom FROM (SELECT l_suppkey AS bus, round(l_quantity * 1.7, 1) AS s FROM lineitem UNION ALL SELECT l_partkey, round(l_quantity * 1.7, 1) FROM lineitem) GROUP BY 1")
def bus_capacity(c):
    return network.bus_capacity(c.lineitem.select(F.col("l_suppkey").alias("bus0"), F.col("l_partkey").alias("bus1"), F.round(F.col("l_quantity") * 1.7, 1).alias("s_nom")))


@query("SELECT c_custkey, greatest(coalesce(floor(abs(c_acctbal) / nullif(max(abs(c_acctbal)) OVER (PARTITION BY c_nationkey), 0) * 100), 0), 1)::INT AS w FROM customer")
def integer_weights(c):
    return network.integer_weights(c.customer.withColumn("x", F.abs("c_acctbal")), "c_nationkey", "x").select("c_custkey", "w")


@query("WITH s AS (SELECT s_suppkey, s_suppkey // 10 AS c, (s_suppkey % 7 + 1)::DOUBLE AS l FROM supplier WHERE s_suppkey % 10 <> 9) SELECT min(s_suppkey::VARCHAR) AS chain, round(sum(l), 4) AS length, round(min(l), 4) AS p_nom, count(*) AS n FROM s GROUP BY c")
def fold_chains(c):
    """Links i to i + 1 within decades: nine links of a decade make one chain."""
    k = F.col("s_suppkey")
    l = c.supplier.where("s_suppkey % 10 <> 9").select(k.alias("name"), k.alias("bus0"), (k + 1).alias("bus1"), (k % 7 + 1).cast("double").alias("length"), (k % 7 + 1).cast("double").alias("p_nom"))
    out = network.fold_chains(l, c.supplier.where("s_suppkey < 0").select(k.alias("bus")))
    return out.select("chain", r("length").alias("length"), r("p_nom").alias("p_nom"), "n")


# ----------------------------------------------------- multi-period summaries
@query(f"WITH {_D}, y AS (SELECT year(snapshot) AS period, carrier, sum(sign * p * w) AS energy FROM d GROUP BY ALL) SELECT carrier, round(sum(energy) FILTER (WHERE period = 1994), 4) AS \"1994\", round(sum(energy) FILTER (WHERE period = 1996), 4) AS \"1996\" FROM y GROUP BY 1")
def energy_by_period(c):
    e = summary.energy_balance(dispatch(c).withColumn("period", F.year("snapshot")), ["carrier", "period"])
    return summary.wide(e, ["carrier"], "period", [1994, 1996], "energy").select("carrier", r("1994").alias("1994"), r("1996").alias("1996"))


# ----------------------------------------------------- costs, energy, heat
@query("""WITH p AS (SELECT p_partkey AS technology, p_retailprice AS inv, (p_size % 3)::DOUBLE AS fom, CASE WHEN p_size % 2 = 0 THEN p_size + 5.0 ELSE 25.0 END AS life FROM part)
 SELECT technology, round((0.07 / (1 - 1 / pow(1.07, life)) + fom / 100) * inv, 4) AS capital_cost, round(1.5 + 20.0 / 0.4, 4) AS marginal_cost FROM p""")
def prepare_costs(c):
    p = c.part.select(F.col("p_partkey").alias("technology"), "p_retailprice", "p_size")
    long = (
        p.select("technology", F.lit("investment").alias("parameter"), F.col("p_retailprice").alias("value"))
        .unionByName(p.select("technology", F.lit("FOM").alias("parameter"), (F.col("p_size") % 3).cast("double").alias("value")))
        .unionByName(p.where("p_size % 2 = 0").select("technology", F.lit("lifetime").alias("parameter"), (F.col("p_size") + 5.0).alias("value")))
    )
    out = sectors.prepare_costs(long, {"investment": 0, "FOM": 0, "lifetime": 25, "discount rate": 0.07, "VOM": 1.5, "fuel": 20, "efficiency": 0.4})
    return out.select("technology", r("capital_cost").alias("capital_cost"), r("marginal_cost").alias("marginal_cost"))


@query("""WITH a AS (SELECT s_nationkey AS k, sum(s_acctbal) AS a FROM supplier WHERE s_nationkey < 18 GROUP BY 1), b AS (SELECT c_nationkey AS k, sum(c_acctbal) AS b FROM customer WHERE c_nationkey > 5 GROUP BY 1)
 SELECT coalesce(a.k, b.k) AS k, round(coalesce(a * 0.7 + b * 0.3, b, a), 4) AS value FROM a FULL JOIN b ON a.k = b.k""")
def blend_ratios(c):
    a = c.supplier.where("s_nationkey < 18").groupBy(F.col("s_nationkey").alias("k")).agg(F.sum("s_acctbal").alias("value"))
    b = c.customer.where("c_nationkey > 5").groupBy(F.col("c_nationkey").alias("k")).agg(F.sum("c_acctbal").alias("value"))
    return sectors.blend_ratios(a, b, ["k"], 0.3).withColumn("value", r("value"))


@query("""WITH d AS (SELECT c_custkey AS id, c_nationkey AS k, abs(c_acctbal) + 1 AS v FROM customer) SELECT id, round(CASE WHEN k < 10 THEN v * 1000 / sum(v) OVER (PARTITION BY k) ELSE v END, 4) AS v FROM d""")
def rescale_totals(c):
    d = c.customer.select(F.col("c_custkey").alias("id"), F.col("c_nationkey").alias("k"), (F.abs("c_acctbal") + 1).alias("v"))
    ref = c.nation.where("n_nationkey < 10").select(F.col("n_nationkey").alias("k"), F.lit(1000.0).alias("v"))
    return sectors.rescale(d, ref, "k", "v").select("id", r("v").alias("v"))


@query("""WITH d AS (SELECT n_regionkey AS k, n_nationkey AS y, (n_nationkey * 10)::DOUBLE AS v FROM nation), s AS (SELECT * FROM (VALUES (0, 7, 0.25), (0, 8, 0.75)) t(old, new, share))
 SELECT coalesce(new, k) AS k, y, round(sum(v * coalesce(share, 1.0)), 4) AS v FROM d LEFT JOIN s ON old = k GROUP BY 1, 2""")
def split_dissolved(c):
    d = c.nation.select(F.col("n_regionkey").alias("k"), F.col("n_nationkey").alias("y"), (F.col("n_nationkey") * 10).cast("double").alias("v"))
    s = c.spark.createDataFrame([(0, 7, 0.25), (0, 8, 0.75)], "old int, new int, share double")
    return sectors.split_dissolved(d, s, "k", "v").withColumn("v", r("v"))


@query("SELECT p_partkey, coalesce(nullif((p_size % 2)::DOUBLE, 0), nullif((p_size % 3)::DOUBLE, 0), p_retailprice) AS v FROM part")
def estimate_fallback(c):
    d = c.part.select("p_partkey", (F.col("p_size") % 2).cast("double").alias("a"), (F.col("p_size") % 3).cast("double").alias("b"), F.col("p_retailprice").alias("z"))
    return sectors.fallback(d, ["a", "b", "z"], "v").select("p_partkey", "v")


@query("""WITH n AS (SELECT c_nationkey AS ct, c_custkey AS node, (c_custkey % 9 + 1)::DOUBLE AS pop, (c_custkey % 4) / 4.0 AS u FROM customer), s AS (SELECT *, pop / sum(pop) OVER (PARTITION BY ct) AS sh FROM n)
 SELECT node, 'boiler' AS technology, area, round(500.0 * sh * CASE WHEN area = 'urban' THEN u ELSE 1 - u END, 6) AS value FROM s, (VALUES ('urban'), ('rural')) a(area)""")
def heating_distribution(c):
    t = c.nation.select(F.col("n_nationkey").alias("ct"), F.lit("boiler").alias("technology"), F.lit(500.0).alias("value"))
    n = c.customer.select(F.col("c_nationkey").alias("ct"), F.col("c_custkey").alias("node"), (F.col("c_custkey") % 9 + 1).cast("double").alias("population"), ((F.col("c_custkey") % 4) / 4.0).alias("urban_fraction"))
    return sectors.heating_distribution(t, n, "ct").withColumn("value", r("value", 6))


@query("""WITH m AS (SELECT p_type AS k, p_name AS measure, p_retailprice AS cost, p_size / 50.0 AS saving FROM part WHERE p_size >= 20) SELECT DISTINCT k, first_value(measure) OVER w AS measure, first_value(cost) OVER w AS cost FROM m WINDOW w AS (PARTITION BY k ORDER BY cost, measure)""")
def retrofit_measure(c):
    d = c.part.select(F.col("p_type").alias("k"), F.col("p_name").alias("measure"), F.col("p_retailprice").alias("cost"), (F.col("p_size") / 50.0).alias("saving"))
    return sectors.cheapest_measure(d, ["k"], 0.4)


from . import queries_constraints, queries_more, queries_rules, queries_statistics  # noqa: E402, F401  more queries register themselves
