"""Cleaning, construction, cost and clustering rules as queries; the SQL states each rule anew."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import scalars
from ..operators import allocation, cleaning, clustering, frames, graph, network, sectors, temporal
from .network_views import ctes, view
from .registry import query, r

# ------------------------------------------------------------------- cleaning
#: Tags as they are found, one for each rule of the ladder and some plain ones.
_TAGS = ["400/220/110 kV'", "400/220/110/20_kv", "2x25000", "380000é220000", "380kvv/220", "11000l400", "(temp 150000)", "low", "minor", "medium", "med", "20m", "high", "23000-109000", "380000>220000", "110000:20000", "1<2", "1,5", "380 kV/220", "20kva", "nan", "<na>", "partial", "1/3", "3x2;2", "single", "quad", "fivefold?", "yes", "3_4", "3", "6;12", "", "16,7", "50 Hz", "50;16.67"]
_TAGSQL = "(VALUES " + ", ".join(f"({i}, '{t.replace(chr(39), chr(39) * 2)}')" for i, t in enumerate(_TAGS)) + ") t(i, tag)"


def _clean_sql(kind: str) -> str:
    """The literal replacements of a kind, nested in their order."""
    out = "lower(tag)"
    for old, new in cleaning.TAG_WORDS[kind]:
        out = f"replace({out}, '{old.replace(chr(39), chr(39) * 2)}', '{new}')"
    return f"regexp_replace({out}, '[^0-9;{'.' if kind == 'frequency' else ''}]', '', 'g')"


@query(f"SELECT doc_id, i, {', '.join(f'{_clean_sql(k)} AS {k}' for k in cleaning.TAG_WORDS)} FROM documents, {_TAGSQL} WHERE i = doc_id % {len(_TAGS)}")
def clean_tags(c):
    t = c.spark.createDataFrame(list(enumerate(_TAGS)), "i int, tag string")
    d = c.documents.select("doc_id", (F.col("doc_id") % len(_TAGS)).cast("int").alias("i")).join(t, "i")
    return d.select("doc_id", "i", *[cleaning.clean_numbers(F.col("tag"), k).alias(k) for k in cleaning.TAG_WORDS])


_LINES = """(VALUES ('w1', '', '', '', '110000', 1), ('w2', '', '', '0', '110000', 1), ('w3', '7', '', '50', '110000', 1), ('w4', '5', '', '0', '110000', 1), ('w5', '2', '', '16.7', '110000', 1), ('w6', '', '3', '50', '110000', 1), ('w7-1', '6;3', '', '50', '220000;110000', 2), ('w7-2', '6;3', '', '50', '220000;110000', 2),
 ('w8-1', '', '2;1', '50', '220000;110000', 2), ('w8-2', '', '2;1', '0', '220000;110000', 2), ('w9-1', '', '4', '50', '380000;220000', 2), ('w10-1', '12', '', '50', '380000;220000', 2), ('w11', '0', '', '50', '110000', 1), ('w12-3', '3;3', '', '50', '1;2;3', 3)) AS t(id, cables, circuits, frequency, voltage_original, split_elements)"""


@query("SELECT * FROM (VALUES ('w1', '1', '50'), ('w2', '1', '0'), ('w3', '2', '50'), ('w4', '2', '0'), ('w5', '1', '50'), ('w6', '3', '50'), ('w7-1', '2', '50'), ('w7-2', '1', '50'), ('w8-1', '2', '50'), ('w8-2', '1', '0'), ('w9-1', '2', '50'), ('w10-1', '2', '50'), ('w11', '1', '50'), ('w12-3', '1', '50')) t(id, circuits, frequency)")
def circuit_ladder(c):
    return cleaning.circuit_ladder(c.spark.sql(f"SELECT * FROM {_LINES}")).select("id", "circuits", "frequency")


@query("SELECT p_partkey, CASE WHEN n > 1 THEN p_name || ' ' || n ELSE p_name END AS name FROM (SELECT *, row_number() OVER (PARTITION BY p_brand, p_type ORDER BY p_partkey) AS n FROM part)")
def name_dedup_suffix(c):
    return cleaning.suffix_names(c.part.select("p_partkey", "p_brand", "p_type", F.col("p_name").alias("name")), ["p_brand", "p_type"], "name", ["p_partkey"]).select("p_partkey", "name")


_GAS = "SELECT p_partkey, CASE WHEN p_size % 7 < 5 THEN 'Natural Gas' WHEN p_size % 7 = 5 THEN 'Oil' ELSE 'Hard Coal' END AS Fueltype, CASE p_size % 5 WHEN 0 THEN 'Steam Turbine' WHEN 1 THEN 'Combustion Engine' WHEN 2 THEN 'Not Found' WHEN 3 THEN 'CCGT' END AS Technology FROM part"


@query(f"WITH g AS ({_GAS}) SELECT p_partkey, Fueltype AS fuel, CASE WHEN Fueltype <> 'Natural Gas' THEN Technology WHEN Technology = 'Combustion Engine' THEN 'OCGT' WHEN Technology = 'CCGT' THEN 'CCGT' ELSE 'CCGT' END AS technology FROM g")
def repair_gas(c):
    c.part.createOrReplaceTempView("part")
    return cleaning.repair_gas(c.spark.sql(_GAS)).select("p_partkey", F.col("Fueltype").alias("fuel"), F.col("Technology").alias("technology"))


@query(f"WITH g AS ({_GAS}) SELECT p_partkey, CASE WHEN Technology IN ('OCGT', 'CCGT') THEN 'Natural Gas' ELSE Fueltype END AS fuel FROM g")
def gas_fuel(c):
    c.part.createOrReplaceTempView("part")
    return cleaning.gas_fuel(c.spark.sql(_GAS)).select("p_partkey", F.col("Fueltype").alias("fuel"))


_V = [
    ("grid", "1.10", "primary", "latest supported", "2024-01-01", "https://g"), ("grid", "1.9", "primary", "deprecated", "2023-01-01", None), ("grid", "1.10", "archive", "latest supported", "2024-01-01", "https://a"),
    ("load", "2", "archive", "latest supported", "2024-02-01", None), ("load", "2", "archive", "latest supported", "2024-02-01", "https://b"), ("load", "3", "primary", "latest supported", "2024-3-1", "ftp://x"),
    ("wind", "V3", "build", "might-work shiny", "2024-03-01", ""), ("wind", "unknown", "elsewhere", "latest", "2024-03-01", None), ("grid", "1.8", "build", "not-tested", "2022-01-01", "https://h:8080/x"),
]


def registry(c):
    return c.spark.createDataFrame([(i, *x) for i, x in enumerate(_V)], "pos int, dataset string, version string, source string, tags string, added string, url string")


@query("SELECT '1.10' AS version, 'https://a' AS url, 'data/grid/archive/1.10' AS folder")
def versions_latest(c):
    return cleaning.resolve_version(registry(c), "grid", "archive").select("version", "url", "folder")


@query("""SELECT * FROM (VALUES ('repeated', 'load', 'archive', 2), ('latest', 'load', 'archive', 2), ('latest differs', 'load', '', 2), ('order', 'load', '', 1), ('order', 'grid', '', 2), ('scattered', 'grid', '', 4), ('no url', 'load', 'archive', 1),
 ('version', 'wind', 'build', 1), ('tag', 'wind', 'build', 1), ('source', 'wind', 'elsewhere', 1), ('date', 'load', 'primary', 1), ('url', 'load', 'primary', 1), ('url', 'grid', 'build', 1)) t(rule, dataset, source, n)
 WHERE NOT (rule = 'order' AND dataset = 'grid') UNION ALL SELECT 'order', 'grid', '', 1""")
def versions_contract(c):
    return cleaning.registry_faults(registry(c))


# --------------------------------------------------------------------- tables
@query("SELECT 'intersection' AS how, n_name FROM nation WHERE n_nationkey IN (SELECT s_nationkey FROM supplier WHERE s_acctbal > 3000) AND n_nationkey IN (SELECT c_nationkey FROM customer WHERE c_acctbal > 9000) UNION ALL SELECT 'difference', n_name FROM nation WHERE n_nationkey IN (SELECT s_nationkey FROM supplier WHERE s_acctbal > 3000) AND n_nationkey NOT IN (SELECT c_nationkey FROM customer WHERE c_acctbal > 9000) UNION ALL SELECT 'symmetric_difference', n_name FROM nation WHERE (n_nationkey IN (SELECT s_nationkey FROM supplier WHERE s_acctbal > 3000)) <> (n_nationkey IN (SELECT c_nationkey FROM customer WHERE c_acctbal > 9000)) UNION ALL SELECT 'union', n_name FROM nation WHERE (n_nationkey IN (SELECT s_nationkey FROM supplier WHERE s_acctbal > 3000)) OR (n_nationkey IN (SELECT c_nationkey FROM customer WHERE c_acctbal > 9000))")
def key_sets(c):
    a, b = c.supplier.where("s_acctbal > 3000").select(F.col("s_nationkey").alias("n_nationkey")), c.customer.where("c_acctbal > 9000").select(F.col("c_nationkey").alias("n_nationkey"))
    parts = [frames.key_sets(a, b, "n_nationkey", how).select(F.lit(how).alias("how"), "n_nationkey") for how in ("intersection", "difference", "symmetric_difference", "union")]
    u = parts[0]
    for p in parts[1:]:
        u = u.unionByName(p)
    return u.join(c.nation.select("n_nationkey", "n_name"), "n_nationkey").select("how", "n_name")


@query("SELECT l_orderkey, l_linenumber, p_name, p_size FROM lineitem JOIN part ON p_partkey = l_partkey")
def gather_rows(c):
    return frames.gather(c.part.select("p_partkey", "p_name", "p_size"), c.lineitem.select("l_orderkey", "l_linenumber", F.col("l_partkey").alias("p_partkey")), "p_partkey").drop("p_partkey")


@query("SELECT p_partkey, CASE WHEN p_size > 25 THEN p_retailprice END AS a, CASE WHEN p_size > 25 THEN p_size ELSE -1 END AS b FROM part")
def where_null(c):
    p = c.part.select("p_partkey", F.col("p_retailprice").alias("a"), F.col("p_size").alias("b"), "p_size")
    return frames.where(frames.where(p, F.col("p_size") > 25, ["a"]), F.col("p_size") > 25, ["b"], F.lit(-1)).drop("p_size")


@query("SELECT p_partkey FROM part WHERE p_type IN ('PROMO', 'ECONOMY', (SELECT min(p_type) FROM part)) AND NOT p_size > 40 AND p_brand <> 'x''@y'")
def where_text(c):
    kinds = ["PROMO", "ECONOMY", c.part.agg(F.min("p_type")).first()[0]]
    return frames.where_query(c.part, "p_type in @kinds & ~ (p_size > @top) and p_brand != \"x'@y\"", kinds=kinds, top=40).select("p_partkey")


@query("SELECT c_custkey, c_nationkey, c_acctbal FROM customer")
def column_filter(c):
    return frames.select_columns(c.customer, regex=r"^c_(nation|acct)", keep=["c_custkey"])


@query("SELECT o_orderpriority AS k, count(*) AS n, count(DISTINCT o_orderstatus) AS states, round(median(o_totalprice), 4) AS median, round(var_samp(o_totalprice), 0) AS var, round(stddev_pop(o_totalprice), 4) AS std0, round(quantile_cont(o_totalprice, 0.25), 4) AS q25, round(quantile_cont(o_totalprice, 0.75), 4) AS q75 FROM orders GROUP BY 1")
def group_statistics(c):
    o = c.orders.withColumnRenamed("o_orderpriority", "k")
    g = frames.statistics(o, ["k"], "o_totalprice").join(o.groupBy("k").agg(F.countDistinct("o_orderstatus").alias("states")), "k")
    return g.select("k", "n", "states", r("median").alias("median"), r("var", 0).alias("var"), r("std0").alias("std0"), r("q25").alias("q25"), r("q75").alias("q75"))


@query("SELECT p_brand, count(*) AS n FROM part WHERE p_brand IS NOT NULL GROUP BY 1")
def value_counts(c):
    return frames.value_counts(c.part, "p_brand")


@query("SELECT 'cost' AS variable, round(sum(c_acctbal) FILTER (WHERE c_mktsegment = 'BUILDING'), 2) AS \"BUILDING\", round(sum(c_acctbal) FILTER (WHERE c_mktsegment = 'MACHINERY'), 2) AS \"MACHINERY\" FROM customer UNION ALL SELECT 'n', count(*) FILTER (WHERE c_mktsegment = 'BUILDING'), count(*) FILTER (WHERE c_mktsegment = 'MACHINERY') FROM customer")
def transpose(c):
    d = c.customer.groupBy("c_mktsegment").agg(r(F.sum("c_acctbal"), 2).alias("cost"), F.count("*").cast("double").alias("n"))
    return frames.transpose(d, "c_mktsegment", ["cost", "n"], ["BUILDING", "MACHINERY"])


@query("SELECT p_type, CASE p_type WHEN 'STANDARD' THEN 1 WHEN 'ECONOMY' THEN 2 ELSE row_number() OVER (PARTITION BY p_type IN ('STANDARD', 'ECONOMY') ORDER BY p_type) + (SELECT count(DISTINCT p_type) FROM part WHERE p_type IN ('STANDARD', 'ECONOMY')) END AS rank FROM (SELECT DISTINCT p_type FROM part)")
def preferred_order(c):
    return frames.preferred_order(c.part.select("p_type").distinct(), "p_type", ["STANDARD", "ECONOMY"]).select("p_type", F.col("rank").cast("long").alias("rank"))


@query("""WITH e AS (SELECT p_partkey, p_retailprice AS x FROM part), q AS (SELECT quantile_cont(x, 0.1) AS a, quantile_cont(x, 0.9) AS b FROM e)
 SELECT CASE WHEN x <= a THEN 'low' WHEN x <= b THEN 'mid' ELSE 'high' END AS class, count(*) AS n FROM e, q GROUP BY 1""")
def efficiency_classes(c):
    return frames.class_by_quantiles(c.part, "p_retailprice").groupBy("class").agg(F.count("*").alias("n"))


@query("""WITH w AS (SELECT *, min(p_retailprice) OVER w - 0.001 AS lo, max(p_retailprice) OVER w + 0.001 AS hi FROM part WINDOW w AS (PARTITION BY p_type))
 SELECT p_type, bin, count(*) AS n FROM (SELECT p_type, (floor((p_retailprice - lo) / ((hi - lo) / 4)) + 1)::BIGINT AS bin FROM w) GROUP BY ALL""")
def resource_bins(c):
    return frames.equal_width_bins(c.part, "p_type", "p_retailprice", 4).groupBy("p_type", "bin").agg(F.count("*").alias("n"))


@query("""WITH y AS (SELECT o_orderpriority AS k, year(o_orderdate) AS x, sum(o_totalprice) AS y FROM orders GROUP BY ALL), f AS (SELECT k, regr_slope(y, x) AS m, regr_intercept(y, x) AS b FROM y WHERE x <> 1994 GROUP BY 1)
 SELECT y.k, x, round(CASE WHEN x = 1994 THEN m * x + b ELSE y END, 0) AS y FROM y JOIN f ON f.k = y.k""")
def linear_fit_predict(c):
    y = c.orders.groupBy(F.col("o_orderpriority").alias("k"), F.year("o_orderdate").cast("long").alias("x")).agg(F.sum("o_totalprice").alias("y"))
    d = y.withColumn("y", F.when(F.col("x") != 1994, F.col("y")))
    return frames.linear_fill(d, ["k"], "x", "y", "z").select("k", "x", r("z", 0).alias("y"))


@query("""SELECT coalesce(r_name, 'tot') AS region, coalesce(n_name, 'tot') AS nation, count(*) AS n, round(sum(c_acctbal), 2) AS v FROM customer JOIN nation ON n_nationkey = c_nationkey JOIN region ON r_regionkey = n_regionkey GROUP BY ROLLUP (r_name, n_name)""")
def grouping_tot(c):
    j = c.customer.join(c.nation, F.col("c_nationkey") == F.col("n_nationkey")).join(c.region, F.col("n_regionkey") == F.col("r_regionkey"))
    return frames.subtotals(j.withColumnsRenamed({"r_name": "region", "n_name": "nation"}), ["region", "nation"], {"n": F.count("*"), "v": r(F.sum("c_acctbal"), 2)})


@query("SELECT n_name, p_type, 0.0 AS p_nom FROM nation, (SELECT DISTINCT p_type FROM part)")
def everywhere_plants(c):
    return allocation.everywhere(c.nation.select(F.col("n_name")), c.part.select("p_type").distinct())


@query("SELECT c_custkey, round(CASE WHEN r = 'factor' THEN c_acctbal * f WHEN r = 'absolute' THEN f ELSE c_acctbal END, 4) AS v FROM customer LEFT JOIN (VALUES ('BUILDING', 'factor', 0.5), ('MACHINERY', 'absolute', 7.0)) t(s, r, f) ON s = c_mktsegment")
def adjust_attributes(c):
    rules = c.spark.createDataFrame([("BUILDING", "factor", 0.5), ("MACHINERY", "absolute", 7.0)], "c_mktsegment string, mode string, factor double")
    return frames.adjust(c.customer.select("c_custkey", "c_mktsegment", F.col("c_acctbal").alias("v")), rules, ["c_mktsegment"], "v").select("c_custkey", r("v").alias("v"))


@query("SELECT p_brand, arg_min(p_partkey, p_retailprice * 1e7 + p_partkey) AS p_partkey FROM part GROUP BY 1")
def dedup_first(c):
    return frames.dedup_first(c.part, ["p_brand"], ["p_retailprice", "p_partkey"]).select("p_brand", "p_partkey")


_HV = """h AS (SELECT s.event_type, s.t, e.v FROM
  (SELECT * FROM (SELECT unnest(generate_series(date_trunc('hour', min(ts)), date_trunc('hour', max(ts)), INTERVAL 1 HOUR)) AS t FROM events), (SELECT DISTINCT event_type FROM events)) s
  LEFT JOIN (SELECT event_type, date_trunc('hour', ts) AS t, avg(value) AS v FROM events GROUP BY 1, 2) e USING (event_type, t))"""


@query(f"WITH {_HV} SELECT event_type, t, round(last_value(v IGNORE NULLS) OVER (PARTITION BY event_type ORDER BY t), 6) AS f, round(first_value(v IGNORE NULLS) OVER (PARTITION BY event_type ORDER BY t ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING), 6) AS b FROM h")
def group_fills(c):
    from .queries import hourly

    h = hourly(c).withColumns({"f": F.col("v"), "b": F.col("v")})
    d = frames.fill(frames.fill(h, ["event_type"], "t", "f"), ["event_type"], "t", "b", "bfill")
    return d.select("event_type", "t", r("f", 6).alias("f"), r("b", 6).alias("b"))


@query("""WITH p AS (SELECT event_type, date_trunc('day', ts) AS t, avg(value) AS price FROM events GROUP BY ALL) SELECT e.event_id, round(p.price, 6) AS price FROM events e ASOF LEFT JOIN p ON e.event_type = p.event_type AND e.ts >= p.t""")
def asof_price(c):
    p = c.events.groupBy("event_type", F.date_trunc("day", "ts").cast("timestamp_ntz").alias("ts")).agg(F.avg("value").alias("price"))
    return temporal.asof(c.events.select("event_id", "event_type", "ts"), p, "ts", "price", ["event_type"]).select("event_id", r("price", 6).alias("price"))


@query(f"WITH {_HV} SELECT a.event_type, a.t, round(CASE WHEN a.t BETWEEN TIMESTAMP '2024-01-10 03:00' AND TIMESTAMP '2024-01-12 20:00' AND a.event_type = k THEN b.v ELSE a.v END, 6) AS v FROM h a LEFT JOIN h b ON b.event_type = a.event_type AND b.t = a.t - INTERVAL 2 DAY, (SELECT min(event_type) AS k FROM events)")
def slice_copy(c):
    from .queries import hourly

    k = c.events.agg(F.min("event_type").alias("event_type"))
    rules = k.select("event_type", F.expr("timestamp_ntz'2024-01-10 03:00:00'").alias("start"), F.expr("timestamp_ntz'2024-01-12 20:00:00'").alias("stop"), F.expr("interval '2' day").alias("delta"))
    return temporal.copy_slices(hourly(c), ["event_type"], "t", "v", rules).select("event_type", "t", r("v", 6).alias("v"))


@query(f"WITH {_HV}, k AS (SELECT min(event_type) AS a, max(event_type) AS b FROM events) SELECT event_type, t, round(v, 6) AS v FROM h, k WHERE event_type <> a UNION ALL SELECT a, t, round(v * 5.7 / 2.9, 6) FROM h, k WHERE event_type = b")
def substitute_series(c):
    from .queries import hourly

    h = hourly(c)
    k = c.events.agg(F.min("event_type").alias("to"), F.max("event_type").alias("source"))
    gone = h.join(k.select(F.col("to").alias("event_type")), "event_type", "left_anti")
    return temporal.substitute(gone, "event_type", "t", "v", k.withColumn("factor", F.lit(5.7 / 2.9))).select("event_type", "t", r("v", 6).alias("v"))


# --------------------------------------------------------------- construction
_L = "l AS (SELECT 'way/' || l_orderkey || CASE WHEN l_linenumber % 2 = 0 THEN '-' || l_linenumber ELSE '' END AS line_id, l_partkey % 50 AS geometry, l_linenumber * 110000 AS voltage, l_quantity AS circuits FROM lineitem)"


@query(f"WITH {_L} SELECT CASE WHEN count(*) > 1 THEN string_split(min(line_id), '-')[1] ELSE min(line_id) END || '-' || (voltage // 1000) AS line_id, geometry, voltage, round(sum(circuits), 4) AS circuits FROM l GROUP BY geometry, voltage")
def merge_parallel_lines(c):
    k = F.concat(F.lit("way/"), F.col("l_orderkey").cast("string"), F.when(F.col("l_linenumber") % 2 == 0, F.concat(F.lit("-"), F.col("l_linenumber").cast("string"))).otherwise(""))
    l = c.lineitem.select(k.alias("line_id"), (F.col("l_partkey") % 50).alias("geometry"), (F.col("l_linenumber") * 110000).alias("voltage"), F.col("l_quantity").alias("circuits"))
    return network.merge_parallel(l).select("line_id", "geometry", "voltage", r("circuits").alias("circuits"))


@query("""WITH b AS (SELECT s_nationkey AS station_id, s_suppkey AS bus_id, (s_suppkey % 3 + 1) * 110000 AS voltage, abs(s_acctbal) AS s_nom FROM supplier), m AS (SELECT station_id FROM b GROUP BY 1 HAVING count(DISTINCT voltage) > 1)
 SELECT a.station_id || '-' || (a.voltage // 1000) || '-' || (b.voltage // 1000) AS transformer_id, a.bus_id AS bus0, b.bus_id AS bus1, round(greatest(a.s_nom, b.s_nom), 4) AS s_nom FROM b a JOIN b ON b.station_id = a.station_id AND a.bus_id < b.bus_id WHERE a.station_id IN (SELECT station_id FROM m)""")
def station_transformers(c):
    b = c.supplier.select(F.col("s_nationkey").alias("station_id"), F.col("s_suppkey").alias("bus_id"), ((F.col("s_suppkey") % 3 + 1) * 110000).alias("voltage"), F.abs("s_acctbal").alias("s_nom"))
    return network.station_transformers(b).select("transformer_id", "bus0", "bus1", r("s_nom").alias("s_nom"))


@query(f"{ctes('lines')}, z(name, zone) AS (VALUES ('B0', 'B0_B1_B2'), ('B1', 'B0_B1_B2'), ('B2', 'B0_B1_B2'), ('B7', 'B7_B8'), ('B8', 'B7_B8')) SELECT l.name, bus0, bus1 FROM lines l LEFT JOIN z a ON a.name = bus0 LEFT JOIN z b ON b.name = bus1 WHERE coalesce(a.zone, bus0) <> coalesce(b.zone, bus1) UNION ALL SELECT * FROM (VALUES ('copper_B0_B1_B2_0', 'B0', 'B1'), ('copper_B0_B1_B2_1', 'B0', 'B2'), ('copper_B7_B8_0', 'B7', 'B8')) t")
def copperplate(c):
    left, new = network.copperplate(view(c, "buses"), view(c, "lines"), [["B0", "B1", "B2"], ["B7", "B8"]])
    return left.select("name", "bus0", "bus1").unionByName(new.select("name", "bus0", "bus1"))


@query("""WITH a AS (SELECT p_partkey AS k, p_size::DOUBLE AS p, 1980 + p_partkey % 40 AS b, CASE WHEN p_partkey % 9 = 0 THEN 'inf'::DOUBLE ELSE (20 + p_partkey % 30)::DOUBLE END AS l, p_partkey % 4 < 2 AS x, p_partkey % 5 = 0 AS chp FROM part),
 t AS (SELECT *, CASE WHEN chp AND x THEN 10 * 0.4 * 0.8 / 0.9 ELSE 10 END AS least FROM a)
 SELECT 'L' || k || CASE WHEN chp THEN ' urban central CHP heat' ELSE ' solar' END AS name, p AS p_nom FROM t WHERE l < 'inf'::DOUBLE AND b + l > 2030 AND NOT (x AND p < least) UNION ALL SELECT 'L' || k || ' urban central CHP electric', p FROM t WHERE chp AND l < 'inf'::DOUBLE AND b + l > 2030 AND NOT (x AND p < 10)""")
def brownfield(c):
    k = F.col("p_partkey")
    chp = k % 5 == 0
    base = c.part.select(k.alias("k"), chp.alias("chp"), F.col("p_size").cast("double").alias("p_nom_opt"), (k % 40 + 1980).alias("build_year"), F.when(k % 9 == 0, float("inf")).otherwise((k % 30 + 20).cast("double")).alias("lifetime"), (k % 4 < 2).alias("p_nom_extendable"), F.lit(0.8).alias("p_nom_ratio"))
    name = F.concat(F.lit("L"), F.col("k").cast("string"), F.when(F.col("chp"), " urban central CHP heat").otherwise(" solar"))
    heat = base.select(name.alias("name"), "*", F.lit(0.9).alias("efficiency"))
    power = base.where("chp").select(F.concat(F.lit("L"), F.col("k").cast("string"), F.lit(" urban central CHP electric")).alias("name"), "*", F.lit(0.4).alias("efficiency"))
    return allocation.brownfield(heat.unionByName(power), 2030).select("name", "p_nom")


@query("""SELECT c_nationkey, c_custkey, NOT (sum(w) OVER (PARTITION BY c_nationkey ORDER BY c_acctbal, c_custkey ROWS UNBOUNDED PRECEDING) / sum(w) OVER (PARTITION BY c_nationkey) < 0.5) AS urban FROM (SELECT *, (c_custkey % 2 + 1)::DOUBLE AS w FROM customer)""")
def density_cut(c):
    d = c.customer.select("c_nationkey", "c_custkey", F.struct("c_acctbal", "c_custkey").alias("o"), (F.col("c_custkey") % 2 + 1).cast("double").alias("w"))
    return allocation.density_cut(d, "c_nationkey", "o", "w", 0.5).select("c_nationkey", "c_custkey", "urban")


_ST = "s AS (SELECT s_suppkey AS id FROM supplier), st AS (SELECT c_custkey AS k, c_custkey % (SELECT count(*) FROM supplier) AS core FROM customer)"


@query(f"WITH {_ST} SELECT 's' || id AS id, 's' || id AS bus FROM s UNION ALL SELECT 'c' || k, 's' || core FROM st UNION ALL SELECT 'p' || p_partkey, 's' || core FROM part JOIN st ON k = p_partkey % (SELECT count(*) FROM customer)")
def stub_removal(c):
    """A ring of suppliers, customers on it as stubs, and parts as stubs of customers."""
    text = lambda p, x: F.concat(F.lit(p), x.cast("string"))
    n, m = c.supplier.count(), c.customer.count()
    s, k, p = F.col("s_suppkey"), F.col("c_custkey"), F.col("p_partkey")
    ring = c.supplier.select(text("s", s).alias("a"), text("s", (s + 1) % n).alias("b"))
    cust = c.customer.select(text("c", k).alias("a"), text("s", k % n).alias("b"))
    part = c.part.select(text("p", p).alias("a"), text("c", p % m).alias("b"))
    edges = ring.unionByName(cust).unionByName(part)
    return graph.prune_stubs(edges.select(F.col("a").alias("id")), edges)


_E = """e AS (SELECT a, b, weight FROM (SELECT l_suppkey AS a, lead(l_suppkey) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_suppkey, l_quantity) AS b, l_quantity AS weight FROM lineitem) WHERE b IS NOT NULL AND b <> a)"""


@query(f"""WITH RECURSIVE {_E}, u AS (SELECT a, b, min(weight) AS weight FROM (SELECT a, b, weight FROM e UNION ALL SELECT b, a, weight FROM e) GROUP BY ALL),
 t(id, source, dist) AS (SELECT s_suppkey, s_suppkey, 0.0::DOUBLE FROM supplier WHERE s_acctbal > 7000 UNION SELECT u.b, t.source, t.dist + u.weight FROM t JOIN u ON u.a = t.id WHERE t.dist + u.weight <= 6)
 SELECT id, min(source) AS source, dist FROM t WHERE (id, dist) IN (SELECT (id, min(dist)) FROM t GROUP BY id) GROUP BY id, dist""")
def shortest_path(c):
    from .queries import branch_edges

    s = c.supplier.where("s_acctbal > 7000").select(F.col("s_suppkey").alias("id"))
    return graph.shortest_paths(branch_edges(c), s, limit=6.0)


@query(f"WITH RECURSIVE {_E}, u AS (SELECT DISTINCT a, b FROM (SELECT a, b FROM e WHERE weight > 49 UNION ALL SELECT b, a FROM e WHERE weight > 49)), t(id, r) AS (SELECT s_suppkey, s_suppkey FROM supplier UNION SELECT t.id, u.b FROM t JOIN u ON u.a = t.r), k AS (SELECT id, min(r) AS c FROM t GROUP BY 1), n AS (SELECT c, count(*) AS n FROM k GROUP BY 1) SELECT id FROM k WHERE c = (SELECT c FROM n ORDER BY n DESC, c LIMIT 1)")
def largest_component(c):
    from .queries import branch_edges

    k = graph.components(c.supplier.select(F.col("s_suppkey").alias("id")), branch_edges(c).where("weight > 49"))
    return graph.largest_component(k).select("id")


# ---------------------------------------------------------------------- costs
@query("""WITH p AS (SELECT 'k' || p_partkey AS t, p_retailprice AS c FROM part) SELECT 'battery' AS technology, round((SELECT c FROM p WHERE t = 'k2') + 6 * (SELECT c FROM p WHERE t = 'k1'), 4) AS capital_cost, 0.0 AS marginal_cost
 UNION ALL SELECT 'H2', round((SELECT c FROM p WHERE t = 'k4') + 168 * (SELECT c FROM p WHERE t = 'k3') + (SELECT c FROM p WHERE t = 'k5'), 4), 0.0""")
def storage_costs(c):
    k = c.part.select(F.concat(F.lit("k"), F.col("p_partkey").cast("string")).alias("technology"), F.col("p_retailprice").alias("capital_cost"))
    return sectors.storage_costs(k, {"battery": ("k1", "k2", None, 6.0), "H2": ("k3", "k4", "k5", 168.0)}).select("technology", r("capital_cost").alias("capital_cost"), "marginal_cost")


@query("SELECT c_nationkey AS k, round(sum(c_acctbal * CASE c_mktsegment WHEN 'BUILDING' THEN 0.3361 WHEN 'MACHINERY' THEN 0.4068 WHEN 'AUTOMOBILE' THEN 0.198 ELSE 0 END), 4) AS co2 FROM customer GROUP BY 1")
def emissions_from_fuel(c):
    f = c.spark.createDataFrame([("BUILDING", 0.3361), ("MACHINERY", 0.4068), ("AUTOMOBILE", 0.198)], "fuel string, factor double")
    return sectors.emissions_from_fuel(c.customer.select(F.col("c_nationkey").alias("k"), F.col("c_mktsegment").alias("fuel"), F.col("c_acctbal").alias("value")), ["k"], f).withColumn("co2", r("co2"))


@query("SELECT c_custkey, round(s + 0.5 * greatest(greatest(u, s) * p - s, 0), 8) AS district_fraction, round(greatest(u, s), 8) AS urban_fraction FROM (SELECT c_custkey, (c_custkey % 5) / 10.0 AS s, (c_custkey % 4) / 4.0 AS u, 0.3 + (c_custkey % 3) / 5.0 AS p FROM customer)")
def district_heat_share(c):
    k = F.col("c_custkey")
    d = c.customer.select("c_custkey", ((k % 5) / 10.0).alias("share"), ((k % 4) / 4.0).alias("urban_fraction"), (0.3 + (k % 3) / 5.0).alias("potential"))
    return sectors.district_heat_share(d, 0.5).select("c_custkey", r("district_fraction", 8).alias("district_fraction"), r("urban_fraction", 8).alias("urban_fraction"))


@query("SELECT p_partkey, CASE WHEN p_size % 4 = 0 THEN 'transmission lines' WHEN p_size % 4 = 1 THEN 'heating' WHEN p_size % 4 = 2 THEN 'battery storage' ELSE 'solar PV' END AS tech FROM part")
def rename_techs(c):
    k = F.col("p_size") % 4
    name = F.when(k == 0, "urban AC").when(k == 1, "residential rural heat pump").when(k == 2, "urban home battery").otherwise("residential solar")
    return c.part.select("p_partkey", scalars.rename_tech(name, ["residential ", "urban "], ["heat pump"], {"heat pump": "heating", "battery": "battery storage"}, {"AC": "transmission lines", "solar": "solar PV"}).alias("tech"))


@query("SELECT p_partkey, round(CASE WHEN p_size % 3 = 0 THEN p_retailprice * 1e3 WHEN p_size % 3 = 1 THEN p_retailprice / 1e3 ELSE p_retailprice END, 4) AS v, CASE WHEN p_size % 3 = 2 THEN 'EUR/MWh' ELSE 'EUR/MW' END AS unit FROM part")
def unit_conversion(c):
    k = F.col("p_size") % 3
    v, u = scalars.to_mw(F.col("p_retailprice"), F.when(k == 0, "EUR/kW").when(k == 1, "EUR/GW").otherwise("EUR/MWh"))
    return c.part.select("p_partkey", r(v).alias("v"), u.alias("unit"))


@query("SELECT n_nationkey, CASE n_name WHEN 'FRANCE' THEN 'FR' WHEN 'GERMANY' THEN 'DE' WHEN 'ROMANIA' THEN 'RO' WHEN 'UNITED KINGDOM' THEN 'GB' END AS code FROM nation")
def country_codes(c):
    return c.nation.select("n_nationkey", scalars.country(F.col("n_name")).alias("code"))


# ----------------------------------------------------------------- clustering
_X = """x AS (SELECT event_type AS node, d AS day, 'value_' || s AS feature, v AS value FROM (SELECT event_type, ts::DATE AS d, avg(value) AS "mean", max(value) AS "max", min(value) AS "min", stddev_pop(value) AS "std", coalesce(max(step), 0) AS ramp_max, sum(value) AS energy
 FROM (SELECT event_type, ts, value, abs(value - lag(value) OVER (PARTITION BY event_type, ts::DATE ORDER BY ts)) AS step FROM (SELECT event_type, date_trunc('hour', ts) AS ts, avg(value) AS value FROM events GROUP BY ALL)) GROUP BY ALL) UNPIVOT (v FOR s IN ("mean", "max", "min", "std", ramp_max, energy)))"""


def _tensor(c):
    h = c.events.groupBy("event_type", F.date_trunc("hour", "ts").cast("timestamp_ntz").alias("ts")).agg(F.avg("value").alias("value")).withColumn("attr", F.lit("value"))
    return clustering.feature_tensor(h, "event_type", "ts", "attr", "value")


@query(f"WITH {_X} SELECT node, day::VARCHAR AS day, feature, round(value, 6) AS value FROM x")
def feature_tensor(c):
    return _tensor(c).select("node", F.col("day").cast("string").alias("day"), "feature", r("value", 6).alias("value"))


_Z = "z AS (SELECT node, day, feature, (value - avg(value) OVER w) / (stddev_pop(value) OVER w + 1e-12) AS value FROM x WINDOW w AS (PARTITION BY feature))"


@query(f"WITH {_X}, m AS (SELECT node, day, feature, (value - min(value) OVER w) / (max(value) OVER w - min(value) OVER w + 1e-12) AS v FROM x WINDOW w AS (PARTITION BY feature)) SELECT node, day::VARCHAR AS day, feature, round(least(greatest(v, 0), 1), 5) AS value FROM m")
def minmax_features(c):
    return clustering.scale_features(_tensor(c), "minmax").select("node", F.col("day").cast("string").alias("day"), "feature", r("value", 5).alias("value"))


_NW = "w AS (SELECT DISTINCT day, 1.0 + day(day) % 3 AS w FROM x), nd AS (SELECT a.node AS a, b.node AS b, sqrt(sum(w / (SELECT sum(w) + 1e-12 FROM w) * (a.value - b.value) * (a.value - b.value))) AS dist FROM z a JOIN z b ON b.day = a.day AND b.feature = a.feature AND a.node < b.node JOIN w ON w.day = a.day GROUP BY 1, 2)"


def _distances(c):
    x = clustering.scale_features(_tensor(c))
    days = x.select("day").distinct().withColumn("weight", 1.0 + F.dayofmonth("day") % 3)
    return x, clustering.node_distances(x, days)


@query(f"WITH {_X}, {_Z}, {_NW} SELECT a, b, round(least(greatest(dist / ((SELECT quantile_cont(dist, 0.95) FROM nd) + 1e-12), 0), 1), 5) AS dist FROM nd")
def pairwise_dist_norm(c):
    return clustering.scale_distances(_distances(c)[1]).withColumn("dist", r("dist", 5))


@query(f"WITH {_X}, {_Z}, {_NW} SELECT a, b, round(0.85 * dist + 0.15 * (length(a) + length(b)), 5) AS dist FROM nd")
def blend_distances(c):
    d = _distances(c)[1]
    geo = d.select("a", "b", (F.length("a") + F.length("b")).cast("double").alias("dist"))
    return clustering.blend(d, geo, 0.85).withColumn("dist", r("dist", 5))


_CM = "lab AS (SELECT DISTINCT node, left(node, 1) AS cluster, length(node)::DOUBLE AS w FROM x), cm AS (SELECT cluster, day, feature, sum(value * w) / sum(w) AS value, (SELECT count(*) FROM lab k WHERE k.cluster = lab.cluster) AS size FROM z JOIN lab ON lab.node = z.node GROUP BY cluster, day, feature)"


def _means(c):
    x = clustering.scale_features(_tensor(c))
    ids = x.select(F.col("node").alias("id")).distinct()
    return clustering.cluster_means(x, ids.withColumn("cluster", F.substring("id", 1, 1)), ids.withColumn("weight", F.length("id").cast("double")))


@query(f"WITH {_X}, {_Z}, {_CM} SELECT cluster, day::VARCHAR AS day, feature, round(value, 5) AS value, size FROM cm")
def cluster_means(c):
    return _means(c).select("cluster", F.col("day").cast("string").alias("day"), "feature", r("value", 5).alias("value"), "size")


@query(f"WITH {_X}, {_Z}, {_CM}, y AS (SELECT *, value * sqrt(size / ((SELECT count(*) FROM lab) + 1e-12)) AS v FROM cm) SELECT a.day::VARCHAR AS a, b.day::VARCHAR AS b, round(sqrt(sum((a.v - b.v) * (a.v - b.v))), 4) AS dist FROM y a JOIN y b ON b.cluster = a.cluster AND b.feature = a.feature AND a.day < b.day GROUP BY 1, 2")
def day_distances(c):
    return clustering.day_distances(_means(c)).select(F.col("a").cast("string").alias("a"), F.col("b").cast("string").alias("b"), r("dist").alias("dist"))


@query()
def alternating_reducer(c):
    x = _tensor(c)
    ids = x.select(F.col("node").alias("a")).distinct()
    geo = ids.join(ids.select(F.col("a").alias("b")), F.col("a") < F.col("b")).withColumn("dist", (F.length("a") + F.length("b")).cast("double"))  # the nodes of a network
    nodes, days, reps = clustering.alternate(x, geo, 0.9, 0.75)
    t = clustering.reduction_tables(nodes, days, reps)
    rows = [t["nodes"].select(F.lit("node").alias("kind"), F.col("node").alias("id"), F.col("cluster").alias("cluster")), t["days"].select(F.lit("day"), F.col("day").cast("string"), F.col("rep_day").cast("string")), t["rep_days"].select(F.lit("rep"), F.col("day").cast("string"), F.col("weight").cast("int").cast("string"))]
    return rows[0].union(rows[1]).union(rows[2])


@query(f"{ctes('buses', 'generators_t')}, g AS (SELECT bus, snapshot, CASE WHEN sum(p_nom) > 0 THEN sum(p_max_pu * p_nom) / sum(p_nom) ELSE avg(p_max_pu) END AS cf FROM generators_t t JOIN generators x ON x.name = t.name WHERE carrier = 'solar' GROUP BY 1, 2) SELECT b.name AS bus, s.snapshot, round(least(greatest(coalesce(cf, 0), 0), 1), 6) AS cf FROM buses b CROSS JOIN snapshots s LEFT JOIN g ON g.bus = b.name AND g.snapshot = s.snapshot")
def bus_capacity_factors(c):
    b = view(c, "buses").select(F.col("name").alias("bus"))
    return clustering.bus_capacity_factors(b, view(c, "generators"), view(c, "generators_t"), "solar").withColumn("cf", r("cf", 6))


@query(f"{ctes('buses', 'loads_t')}, g AS (SELECT bus, snapshot, sum(p) AS p FROM loads_t t JOIN loads x ON x.name = t.name GROUP BY 1, 2) SELECT b.bus, s.snapshot, round(coalesce(p, 0), 4) AS p FROM (SELECT DISTINCT bus FROM loads) b CROSS JOIN snapshots s LEFT JOIN g ON g.bus = b.bus AND g.snapshot = s.snapshot")
def bus_loads(c):
    return clustering.bus_loads(clustering.load_buses(view(c, "loads")), view(c, "loads"), view(c, "loads_t")).withColumn("p", r("p"))


@query("WITH b AS (SELECT 'N' || n_nationkey || s AS name, 'N' || n_nationkey AS base, n_nationkey AS k, s FROM nation, (VALUES (''), (' H2'), (' battery'), (' heat')) t(s)) SELECT name, CASE WHEN s = ' heat' THEN name ELSE 'N' || (k % 5 + 5) || s END AS \"to\" FROM b")
def full_busmap(c):
    k = F.col("n_nationkey")
    n = lambda x: F.concat(F.lit("N"), x.cast("string"))
    labels = c.nation.select(n(k).alias("id"), (k % 5).alias("cluster"))
    reps = labels.select("cluster").distinct().withColumn("medoid", n(F.col("cluster") + 5))
    buses = c.nation.select(F.explode(F.array(*[F.concat(n(k), F.lit(s)) for s in ("", " H2", " battery", " heat")])).alias("name"))
    return clustering.busmap(buses, labels, reps)
