"""Statistics of a solved network as queries over the network views."""

from __future__ import annotations

from pyspark.sql import functions as F

from . import statistics as st
from .network_views import ctes, view
from .registry import query, r

COMPONENTS = {"Generator": "generators", "Load": "loads", "Store": "stores", "StorageUnit": "storage_units", "Link": "links", "Line": "lines"}


def _static(c) -> dict:
    return {k: view(c, v) for k, v in COMPONENTS.items()}


def _flows(c):
    return st.flows(_static(c), {k: view(c, f"{v}_t") for k, v in COMPONENTS.items()}, view(c, "buses"), view(c, "snapshots"))


def _assets(c):
    return st.assets(_static(c), view(c, "buses"))


def _dated(c):
    return _flows(c).join(view(c, "snapshots").select("snapshot", "w_generators", "w_stores", "w_objective"), "snapshot")


_VIEWS = ("generators_t", "loads_t", "stores_t", "storage_units_t", "links_t", "lines_t", "prices", "periods")
_ONE = "SELECT '{0}' AS component, x.name, carrier, 0 AS port, bus, s.snapshot, {1} AS w, {2} AS p, s.period, w_generators, w_stores, w_objective FROM {3}_t t JOIN {3} x ON x.name = t.name JOIN snapshots s ON s.snapshot = t.snapshot"
_TWO = "SELECT '{0}', x.name, carrier, {1}, bus{1}, s.snapshot, w_objective, {2}, s.period, w_generators, w_stores, w_objective FROM {3}_t t JOIN {3} x ON x.name = t.name JOIN snapshots s ON s.snapshot = t.snapshot WHERE bus{1} <> ''"
_F = "f0 AS (" + " UNION ALL ".join([
    _ONE.format("Generator", "w_generators", "p", "generators"), _ONE.format("Load", "w_objective", "-p", "loads"), _ONE.format("Store", "w_stores", "p", "stores"), _ONE.format("StorageUnit", "w_stores", "p", "storage_units"),
    _TWO.format("Link", 0, "-p0", "links"), _TWO.format("Link", 1, "-p1", "links"), _TWO.format("Link", 2, "-p2", "links"), _TWO.format("Line", 0, "-p0", "lines"), _TWO.format("Line", 1, "p0", "lines"),
]) + "), f AS (SELECT f0.*, b.carrier AS bus_carrier, b.location, b.country FROM f0 JOIN buses b ON b.name = f0.bus)"
_LOC = "coalesce({}, 'EU')".format
_AT = "(SELECT nullif(location, 'EU') FROM buses b WHERE b.name = x.{})".format
_A = "a AS (" + " UNION ALL ".join(
    f"SELECT '{c}' AS component, name, carrier, {_LOC(', '.join(_AT(b) for b in buses))} AS location, {cap} AS capacity, {inst} AS installed, capital_cost, {mar} AS marginal_cost, build_year, lifetime FROM {t} x"
    for c, t, buses, cap, inst, mar in (
        ("Generator", "generators", ("bus",), "p_nom_opt", "p_nom", "marginal_cost"), ("Store", "stores", ("bus",), "e_nom_opt", "e_nom_opt", "marginal_cost"), ("StorageUnit", "storage_units", ("bus",), "p_nom_opt", "p_nom_opt", "marginal_cost"),
        ("Link", "links", ("bus0", "bus1", "bus2"), "p_nom_opt", "p_nom", "marginal_cost"), ("Line", "lines", ("bus0", "bus1"), "s_nom_opt", "s_nom_opt", "0.0"),
    )
) + ")"
_USE = "CASE component WHEN 'Link' THEN -p WHEN 'StorageUnit' THEN greatest(p, 0) ELSE p END"
_OPEX = f"o AS (SELECT component, name, sum({_USE} * w) AS u FROM f WHERE port = 0 AND component NOT IN ('Load', 'Line') GROUP BY 1, 2)"


def _sql(rows: str, *more: str) -> str:
    return f"{ctes(*_VIEWS)}, {', '.join([_F, _A, *more])} {rows}"


@query(_sql("SELECT component, carrier, bus_carrier, round(sum(p * w), 2) AS energy FROM f GROUP BY 1, 2, 3"))
def port_energy_balance(c):
    return st.energy_balance(_flows(c), ["carrier", "bus_carrier"]).withColumn("energy", r("energy", 2))


@query(_sql("SELECT component, carrier, location, bus_carrier, round(sum(p * w), 2) AS energy FROM f GROUP BY 1, 2, 3, 4"))
def nodal_energy_balance(c):
    return st.energy_balance(_flows(c), ["carrier", "location", "bus_carrier"]).withColumn("energy", r("energy", 2))


@query(_sql("SELECT 'capital' AS cost, component, location, carrier, round(sum(capacity * capital_cost), 2) AS value FROM a GROUP BY 2, 3, 4 UNION ALL SELECT 'marginal', a.component, location, carrier, round(sum(u * marginal_cost), 2) FROM o JOIN a ON a.component = o.component AND a.name = o.name GROUP BY 2, 3, 4", _OPEX))
def component_costs(c):
    return st.costs(_assets(c), _flows(c), ["location", "carrier"]).withColumn("value", r("value", 2))


@query(_sql("SELECT component, location, carrier, round(sum(capacity), 4) AS capacity FROM a GROUP BY 1, 2, 3"))
def nodal_capacities(c):
    return st.capacities(_assets(c), ["location", "carrier"]).withColumn("capacity", r("capacity"))


@query(_sql("SELECT a.component, location, carrier, round(sum(m) / nullif(sum(capacity), 0), 6) AS capacity_factor FROM a LEFT JOIN m ON m.component = a.component AND m.name = a.name WHERE a.component IN ('Generator', 'StorageUnit', 'Line') GROUP BY 1, 2, 3", "m AS (SELECT component, name, sum(CASE component WHEN 'Line' THEN abs(p) ELSE p END * w) / sum(w) AS m FROM f WHERE port = 0 GROUP BY 1, 2)"))
def capacity_factors(c):
    return st.capacity_factors(_assets(c), _flows(c), ["location", "carrier"]).withColumn("capacity_factor", r("capacity_factor", 6))


@query(_sql("SELECT l.carrier, round(l / nullif(c * (SELECT sum(w_generators) FROM snapshots), 0) * 100, 4) AS curtailment FROM l JOIN k ON k.carrier = l.carrier",
 "g AS (SELECT * FROM generators WHERE bus IN (SELECT name FROM buses WHERE carrier IN ('AC', 'low voltage')))", "l AS (SELECT carrier, sum((p_max_pu * p_nom_opt - p) * w_generators) AS l FROM generators_t t JOIN g ON g.name = t.name JOIN snapshots s ON s.snapshot = t.snapshot GROUP BY 1)", "k AS (SELECT carrier, sum(p_nom_opt) AS c FROM g GROUP BY 1)"))
def curtailment(c):
    return st.curtailment(_flows(c), _assets(c), view(c, "generators_t").select("name", "snapshot", "p_max_pu"), view(c, "snapshots"), ["AC", "low voltage"]).withColumn("curtailment", r("curtailment"))


@query(f"{ctes('prices')}, b AS (SELECT carrier, bus, avg(price) AS x FROM prices p JOIN buses b ON b.name = bus GROUP BY 1, 2) SELECT carrier, round(avg(x), 6) AS price FROM b GROUP BY 1")
def prices(c):
    return st.prices(view(c, "prices"), view(c, "buses")).withColumn("price", r("price", 6))


@query(_sql("SELECT bus_carrier AS carrier, round(sum(l * coalesce(price, 1) * w_generators) / sum(l * w_generators), 6) AS price FROM l JOIN snapshots s ON s.snapshot = l.snapshot LEFT JOIN (SELECT * FROM prices WHERE bus <> 'B1') q ON q.bus = l.bus AND q.snapshot = l.snapshot GROUP BY 1 HAVING sum(l) > 0",
 "l AS (SELECT bus_carrier, bus, snapshot, sum(-least(p, 0)) AS l FROM f WHERE bus_carrier <> 'H2' OR p > 0 GROUP BY 1, 2, 3)"))
def weighted_prices(c):
    f = _flows(c).where("bus_carrier <> 'H2' OR p > 0")  # one carrier without load, one bus without prices
    return st.weighted_prices(f, view(c, "prices").where("bus <> 'B1'"), view(c, "snapshots")).withColumn("price", r("price", 6))


@query(_sql("SELECT carrier, round(sum(greatest(p, 0) * w * price) / sum(greatest(p, 0) * w), 6) AS market_value FROM f JOIN prices q ON q.bus = f.bus AND q.snapshot = f.snapshot WHERE bus_carrier = 'AC' GROUP BY 1 HAVING sum(greatest(p, 0) * w) > 0"))
def market_values(c):
    return st.market_values(_flows(c), view(c, "prices")).withColumn("market_value", r("market_value", 6))


_PM = "SELECT 'electricity_price_zero_hours' AS metric, avg(CASE WHEN price < 0.1 THEN 1.0 ELSE 0 END) AS value FROM q UNION ALL SELECT 'electricity_price_mean', avg(price) FROM q UNION ALL SELECT 'electricity_price_std', stddev_samp(price) FROM q"
_Q = "q AS (SELECT price FROM prices p JOIN buses b ON b.name = p.bus WHERE carrier = 'AC')"


@query(f"{ctes('prices')}, {_Q}, z AS ({_PM}) SELECT metric, round(value, 6) AS value FROM z")
def price_metrics(c):
    return st.price_metrics(view(c, "prices"), view(c, "buses")).withColumn("value", r("value", 6))


@query(_sql(f"""SELECT metric, round(value, 4) AS value FROM (SELECT 'line_volume_DC' AS metric, sum(length * p_nom_opt) AS value FROM links WHERE carrier = 'DC' UNION ALL SELECT 'line_volume_AC', sum(length * s_nom_opt) FROM lines
 UNION ALL SELECT 'line_volume', (SELECT sum(length * p_nom_opt) FROM links WHERE carrier = 'DC') + (SELECT sum(length * s_nom_opt) FROM lines) UNION ALL SELECT 'total costs', (SELECT sum(capacity * capital_cost) FROM a) + (SELECT sum(u * marginal_cost) FROM o JOIN a ON a.component = o.component AND a.name = o.name)
 UNION ALL SELECT 'line_volume_limit', 1e6 UNION ALL SELECT 'line_volume_shadow', -3.5 UNION ALL SELECT 'co2_shadow', -80.0 UNION ALL {_PM})""", _OPEX, _Q))
def network_metrics(c):
    g = c.spark.createDataFrame([("lv_limit", 1e6, -3.5), ("CO2Limit", 0.0, -80.0)], "name string, constant double, mu double")
    lengths = view(c, "links").select(F.lit("Link").alias("component"), "name", "length").unionByName(view(c, "lines").select(F.lit("Line").alias("component"), "name", "length"))
    return st.metrics(_assets(c), _flows(c), lengths, view(c, "prices"), view(c, "buses"), g).withColumn("value", r("value"))


_SHED = "NOT (component = 'Generator' AND carrier = 'Load') AND component <> 'Line'"


@query(_sql(f"""SELECT statistic, component, carrier, round(value, 5) AS value FROM (
 SELECT 'capacity_factor' AS statistic, a.component, carrier, sum(m) / nullif(sum(capacity), 0) AS value FROM a LEFT JOIN m ON m.component = a.component AND m.name = a.name WHERE a.component IN ('Generator', 'StorageUnit', 'Line') GROUP BY 2, 3 HAVING sum(m) / nullif(sum(capacity), 0) IS NOT NULL
 UNION ALL SELECT 'installed_capacity', component, carrier, sum(installed) / 1e3 FROM a WHERE {_SHED} GROUP BY 2, 3 UNION ALL SELECT 'optimal_capacity', component, carrier, sum(capacity) / 1e3 FROM a WHERE {_SHED} GROUP BY 2, 3
 UNION ALL SELECT 'capital_expenditure', component, carrier, sum(capacity * capital_cost) FROM a GROUP BY 2, 3 UNION ALL SELECT 'operational_expenditure', a.component, carrier, sum(u * marginal_cost) FROM o JOIN a ON a.component = o.component AND a.name = o.name GROUP BY 2, 3
 UNION ALL SELECT 'curtailment', 'Generator', carrier, sum((p_max_pu * p_nom_opt - p) * w_generators) FROM generators_t t JOIN generators g ON g.name = t.name JOIN snapshots s ON s.snapshot = t.snapshot GROUP BY 3
 UNION ALL SELECT 'supply', component, carrier, sum(greatest(p, 0) * w) / 1e6 FROM f WHERE component <> 'Line' GROUP BY 2, 3 UNION ALL SELECT 'withdrawal', component, carrier, sum(-least(p, 0) * w) / -1e6 FROM f WHERE component <> 'Line' GROUP BY 2, 3
 UNION ALL SELECT 'market_value', component, carrier, sum(greatest(p, 0) * w * price) / nullif(sum(greatest(p, 0) * w), 0) FROM f JOIN prices q ON q.bus = f.bus AND q.snapshot = f.snapshot GROUP BY 2, 3)""",
 _OPEX, "m AS (SELECT component, name, sum(CASE component WHEN 'Line' THEN abs(p) ELSE p END * w) / sum(w) AS m FROM f WHERE port = 0 GROUP BY 1, 2)"))
def bar_statistics(c):
    return st.bars(_assets(c), _flows(c), view(c, "generators_t").select("name", "snapshot", "p_max_pu"), view(c, "prices")).withColumn("value", r("value", 5))


@query(_sql("SELECT snapshot, carrier, round(p, 4) AS p FROM d WHERE carrier IN (SELECT carrier FROM d GROUP BY 1 HAVING sum(abs(p)) > 0.01)", "d AS (SELECT snapshot, carrier, sum(p) AS p FROM f WHERE bus = 'B2' GROUP BY 1, 2)"))
def bus_balance(c):
    return st.bus_balance(_flows(c), "B2").withColumn("p", r("p"))


@query(_sql("""SELECT snapshot, e.carrier, rank, round(greatest(p, 0), 6) AS positive, round(least(p, 0), 6) AS negative FROM e JOIN (SELECT carrier, row_number() OVER (ORDER BY v NULLS LAST, carrier) AS rank FROM (SELECT carrier, var_samp(p) / nullif(max(p) * max(p), 0) AS v FROM e GROUP BY 1)) k ON k.carrier = e.carrier""",
 "d AS (SELECT snapshot, carrier, sum(p) / 1e3 AS p FROM f WHERE bus_carrier IN ('AC', 'low voltage') GROUP BY 1, 2)", "s AS (SELECT carrier FROM d GROUP BY 1 HAVING max(abs(p)) < 0.5 AND sum(abs(p)) / 5 < 0.3)", "e AS (SELECT snapshot, CASE WHEN carrier IN (SELECT carrier FROM s) THEN 'other' ELSE carrier END AS carrier, sum(p) AS p FROM d GROUP BY 1, 2)"))
def balance_series(c):
    d = st.balance_series(_flows(c), ["AC", "low voltage"], 0.5, 0.3)
    return d.select("snapshot", "carrier", F.col("rank").cast("long").alias("rank"), r("positive", 6).alias("positive"), r("negative", 6).alias("negative"))


_INNER = "i AS (SELECT component, name, max(CASE WHEN port = 0 THEN bus END) AS bus0, max(CASE WHEN port = 1 THEN bus END) AS bus1 FROM f WHERE bus_carrier = 'AC' AND component IN ('Line', 'Link') GROUP BY 1, 2 HAVING bus0 IS NOT NULL AND bus1 IS NOT NULL)"


@query(_sql("SELECT bus, carrier, round(sum(p * w), 2) AS energy FROM f WHERE bus_carrier = 'AC' AND (component, name) NOT IN (SELECT (component, name) FROM i) GROUP BY 1, 2 HAVING abs(sum(p * w)) > 0", _INNER))
def balance_map_buses(c):
    return st.balance_map(_flows(c), "AC")[0].withColumn("energy", r("energy", 2))


@query(_sql("SELECT f.component, f.name, bus0, bus1, round(sum(-p * w), 2) AS flow FROM f JOIN i ON i.component = f.component AND i.name = f.name WHERE port = 0 GROUP BY 1, 2, 3, 4", _INNER))
def balance_map_flows(c):
    return st.balance_map(_flows(c), "AC")[1].withColumn("flow", r("flow", 2))


@query(f"{ctes('generators', 'storage_units', 'links', 'loads_t')} SELECT 'Generator' AS part, carrier, round(sum(p_nom_opt), 4) AS value FROM generators GROUP BY 2 UNION ALL SELECT 'StorageUnit', carrier, round(sum(p_nom_opt), 4) FROM storage_units GROUP BY 2 UNION ALL SELECT 'Link', carrier, round(sum(p_nom_opt), 4) FROM links GROUP BY 2 UNION ALL SELECT 'Load', carrier, round(sum(p) / count(DISTINCT snapshot), 4) FROM loads_t t JOIN loads l ON l.name = t.name GROUP BY 2")
def aggregate_p_nom(c):
    load = view(c, "loads_t").join(view(c, "loads").select("name", "carrier"), "name")
    return st.aggregate_p_nom(_static(c), load).withColumn("value", r("value"))


@query(_sql("SELECT component AS part, carrier, round(sum(p), 4) AS value FROM f WHERE component NOT IN ('Link', 'Line') GROUP BY 1, 2"))
def aggregate_p(c):
    return st.aggregate_p(_flows(c)).withColumn("value", r("value"))


@query(f"{ctes('storage_units', 'stores')} SELECT 'StorageUnit' AS part, carrier, sum(p_nom_opt * max_hours) AS value FROM storage_units GROUP BY 2 UNION ALL SELECT 'Store', carrier, sum(e_nom_opt) FROM stores GROUP BY 2")
def aggregate_e_nom(c):
    return st.aggregate_e_nom(view(c, "storage_units"), view(c, "stores"))


@query(f"{ctes('generators_t', 'storage_units_t')} SELECT 'Generator' AS part, carrier, round(sum(p_max_pu * p_nom_opt) - sum(p), 4) AS value FROM generators_t t JOIN generators g ON g.name = t.name GROUP BY 2 UNION ALL SELECT 'StorageUnit', carrier, round(sum(inflow) - sum(p), 4) FROM storage_units_t t JOIN storage_units u ON u.name = t.name GROUP BY 2")
def aggregate_p_curtailed(c):
    return st.aggregate_p_curtailed(view(c, "generators"), view(c, "generators_t"), view(c, "storage_units"), view(c, "storage_units_t")).withColumn("value", r("value"))


@query(_sql("""SELECT component, cost, carrier, round(value, 2) AS value FROM (SELECT component, 'capital' AS cost, carrier, sum(capacity * capital_cost) AS value FROM a GROUP BY 1, 3
 UNION ALL SELECT a.component, 'marginal', carrier, sum(u * marginal_cost) FROM d JOIN a ON a.component = d.component AND a.name = d.name WHERE d.component <> 'StorageUnit' OR u > 0 GROUP BY 1, 3)""", "d AS (SELECT component, name, sum(CASE component WHEN 'Link' THEN -p ELSE p END) AS u FROM f WHERE port = 0 AND component IN ('Link', 'Generator', 'StorageUnit', 'Store') GROUP BY 1, 2)"))
def aggregate_costs(c):
    return st.aggregate_costs(_assets(c), _flows(c)).withColumn("value", r("value", 2))


# ------------------------------------------------------- perfect foresight
_ALIVE = "v AS (SELECT a.*, period, objective / years AS d FROM a JOIN periods ON build_year <= period AND period < build_year + lifetime)"


@query(_sql(f"""SELECT period, component, carrier, cost, round(value, 2) AS value FROM (SELECT period, component, carrier, 'capital' AS cost, sum(capacity * capital_cost * d) AS value FROM v GROUP BY 1, 2, 3
 UNION ALL SELECT u.period, a.component, carrier, 'marginal', sum(u * objective / years * CASE WHEN a.component = 'Store' AND carrier = 'co2 stored' AND marginal_cost <= -100 THEN -20 ELSE marginal_cost END) FROM u JOIN a ON a.component = u.component AND a.name = u.name JOIN periods p ON p.period = u.period GROUP BY 1, 2, 3)""",
 _ALIVE, "u AS (SELECT period, component, name, sum(CASE component WHEN 'Link' THEN -p * w_generators WHEN 'StorageUnit' THEN greatest(p, 0) * w_stores ELSE round(p, 2) * w_generators END) AS u FROM f WHERE port = 0 AND component NOT IN ('Load', 'Line') GROUP BY 1, 2, 3)"))
def period_costs(c):
    return st.period_costs(_assets(c), _dated(c), view(c, "periods")).withColumn("value", r("value", 2))


@query(_sql("SELECT period, component, carrier, round(sum(capacity), 4) AS capacity FROM v GROUP BY 1, 2, 3", _ALIVE))
def period_capacities(c):
    return st.period_capacities(_assets(c), view(c, "periods")).withColumn("capacity", r("capacity"))


@query(_sql("SELECT period, component, carrier, round(sum(p * w_generators), 2) AS energy FROM f GROUP BY 1, 2, 3"))
def period_energy(c):
    return st.period_energy(_dated(c)).withColumn("energy", r("energy", 2))


@query(_sql("SELECT period, bus_carrier, component, CASE WHEN component IN ('Link', 'Line') THEN carrier || port ELSE carrier END AS carrier, round(sum(p * CASE WHEN component = 'Generator' THEN w_generators WHEN component IN ('Link', 'Line') THEN w_objective ELSE w_stores END), 2) AS energy FROM f GROUP BY 1, 2, 3, 4"))
def period_supply_energy(c):
    return st.period_supply_energy(_dated(c)).withColumn("energy", r("energy", 2))


@query(_sql("""SELECT bus_carrier, component, carrier, round(sum(s), 4) AS supply FROM (SELECT bus_carrier, component, name, CASE WHEN component IN ('Link', 'Line') THEN carrier || port ELSE carrier END AS carrier,
 CASE WHEN component IN ('Link', 'Line') AND port = 1 THEN max(p) WHEN component IN ('Link', 'Line') THEN -max(-p) WHEN component = 'Load' THEN -max(-p) ELSE max(p) END AS s FROM f GROUP BY bus_carrier, component, name, f.carrier, port) GROUP BY 1, 2, 3"""))
def max_supply(c):
    return st.max_supply(_flows(c)).withColumn("supply", r("supply"))


@query(f"{ctes('generators_t')} SELECT carrier, round((sum(p_max_pu * p_nom_opt) - sum(p)) / sum(p_max_pu * p_nom_opt) * 100, 3) AS curtailment FROM generators_t t JOIN generators g ON g.name = t.name GROUP BY 1")
def plain_curtailment(c):
    return st.plain_curtailment(view(c, "generators"), view(c, "generators_t"))


@query(_sql("SELECT component, carrier, round(arg_max(v, port), 6) AS market_value FROM (SELECT component, carrier, port, sum(p * price) / nullif(sum(p), 0) AS v FROM f JOIN prices q ON q.bus = f.bus AND q.snapshot = f.snapshot WHERE bus_carrier = 'AC' AND (component = 'Generator' OR component = 'Link' AND port < 2) GROUP BY 1, 2, 3) GROUP BY 1, 2"))
def plain_market_values(c):
    return st.plain_market_values(_flows(c), view(c, "prices")).withColumn("market_value", r("market_value", 6))


@query(f"{ctes('prices')}, b AS (SELECT bus, count(*) FILTER (WHERE price < 0.1) AS z, count(*) AS n, avg(price) AS m, stddev_samp(price) AS s FROM prices p JOIN buses b ON b.name = p.bus WHERE carrier = 'AC' GROUP BY 1) SELECT 'zero_hours' AS metric, round(sum(z) / sum(n), 6) AS value FROM b UNION ALL SELECT 'mean', round(avg(m), 6) FROM b UNION ALL SELECT 'standard_deviation', round(stddev_samp(s), 6) FROM b")
def price_deviation(c):
    return st.price_deviation(view(c, "prices"), view(c, "buses")).withColumn("value", r("value", 6))


@query("WITH y AS (SELECT o_orderstatus AS label, year(o_orderdate) AS year, sum(o_totalprice) AS cost FROM orders GROUP BY ALL) SELECT label, year, rate, round(cost / pow(1 + rate, year - 1992), 2) AS cost FROM y, (SELECT unnest([0.0, 0.01, 0.02, 0.03, 0.04, 0.05, 0.06, 0.07, 0.08, 0.09]) AS rate)")
def discounted_costs_by_period(c):
    y = c.orders.groupBy(F.col("o_orderstatus").alias("label"), F.year("o_orderdate").cast("long").alias("year")).agg(F.sum("o_totalprice").alias("cost"))
    return st.discounted(y, [k / 100 for k in range(10)], 1992).withColumn("cost", r("cost", 2))


@query("WITH d AS (SELECT p_type AS carrier, p_size % 3 AS col, sum(CASE WHEN p_partkey % 4 = 0 THEN -p_size * 2.0 ELSE p_size * 1.0 END) AS value FROM part GROUP BY 1, 2) SELECT carrier, col, round(value, 2) AS value FROM d WHERE carrier IN (SELECT carrier FROM d GROUP BY 1 HAVING max(value) >= 20)")
def threshold_drop(c):
    d = c.part.select(F.col("p_type").alias("carrier"), (F.col("p_size") % 3).alias("col"), F.when(F.col("p_partkey") % 4 == 0, F.col("p_size") * -2.0).otherwise(F.col("p_size") * 1.0).alias("value"))
    return st.drop_small(d, ["carrier"], "value", 20.0, ["col"]).withColumn("value", r("value", 2))
