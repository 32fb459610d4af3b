"""The constraint families as queries: coefficient rows over the network views."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import constraints
from .network_views import ctes, view
from .registry import query, r

_OUT = 'constraint, row_key, var, round(coef, 6) AS coef, sense, round(rhs, 4) AS rhs'.replace("constraint,", '"constraint",')


def _tidy(df):
    return df.select("constraint", "row_key", "var", r("coef", 6).alias("coef"), "sense", r("rhs", 4).alias("rhs"))


def _sql(views: tuple, more: str, rows: str) -> str:
    """Rows are given as (constraint, row_key, var, coef, sense, rhs) selects."""
    return f"{ctes(*views)}{', ' + more if more else ''}, z(\"constraint\", row_key, var, coef, sense, rhs) AS ({rows}) SELECT {_OUT} FROM z"


@query(f"""{ctes('generators')}, u AS (SELECT string_split(name, ' ' || carrier)[1] || ' ' || carrier || '-2030' AS name, sum(p_nom) AS used FROM generators WHERE NOT p_nom_extendable AND carrier IN ('solar', 'solar-hsat', 'onwind', 'offwind-ac') GROUP BY 1),
 d AS (SELECT g.name, p_nom_min, p_nom_max - coalesce(used, 0) AS x FROM generators g LEFT JOIN u ON u.name = g.name)
 SELECT name, round(greatest(CASE WHEN p_nom_min > x THEN p_nom_min ELSE x END, 0), 4) AS p_nom_max FROM d""")
def land_use(c):
    return constraints.land_use(view(c, "generators"), "2030").select("name", r("p_nom_max").alias("p_nom_max"))


@query(_sql(("generators",), "", """SELECT 'nom_max_' || carrier || '_' || build_year, bus, 'Generator-p_nom:' || name, 1.0, '<=', min(p_nom_max) OVER (PARTITION BY carrier, bus, build_year) FROM generators WHERE p_nom_extendable AND carrier <> 'nuclear'"""))
def land_use_perfect(c):
    g = view(c, "generators")  # nuclear has no technical limit
    return _tidy(constraints.land_use_perfect(g.withColumn("p_nom_max", F.when(F.col("carrier") == "nuclear", float("inf")).otherwise(F.col("p_nom_max")))))


@query(_sql(("generators",), "a AS (SELECT bus, sum(p_nom_max) AS x FROM generators WHERE carrier = 'solar' AND p_nom_extendable GROUP BY 1), b AS (SELECT bus, sum(p_nom) * 1.13 AS y FROM generators WHERE carrier = 'solar-hsat' GROUP BY 1)",
 """SELECT 'solar_potential', g.bus, 'Generator-p_nom:' || name, CASE WHEN carrier = 'solar-hsat' THEN 1.13 ELSE 1 END, '<=', greatest(x - y, 0) FROM generators g JOIN a ON a.bus = g.bus JOIN b ON b.bus = g.bus WHERE p_nom_extendable AND carrier LIKE 'solar%'"""))
def solar_potential(c):
    return _tidy(constraints.solar_potential(view(c, "generators"), 1.13))


@query(_sql(("snapshots",), "", "SELECT 'co2_sequestration_limit', period::VARCHAR, 'co2 sequestered', 1.0, '>=', -1e6 * sum(w_generators) / 8760 * CASE period WHEN 2030 THEN 50.0 ELSE 125.0 END FROM snapshots GROUP BY period"))
def sequestration_limit(c):
    return _tidy(constraints.sequestration_limit(view(c, "snapshots"), {2020: 0.0, 2030: 50.0, 2050: 200.0}))


_S = "s AS (SELECT st.name AS store FROM stores st JOIN buses b ON b.name = st.bus WHERE b.carrier IN ('AC', 'H2') AND NOT e_cyclic), e AS (SELECT period, max(snapshot) AS last FROM snapshots GROUP BY 1), l AS (SELECT * FROM (VALUES ('co2-2030', 2030, 1e3), ('co2-2040', 2040, 5e2)) t(name, period, constant))"


def _limits(c):
    return c.spark.createDataFrame([("co2-2030", 2030, 1e3), ("co2-2040", 2040, 5e2)], "name string, period int, constant double")


@query(_sql(("stores", "buses", "snapshots"), _S, """SELECT l.name, store, 'Store-e:' || store || '@' || last, 1.0, '<=', constant FROM l JOIN e ON e.period = l.period, s
 UNION ALL SELECT l.name, store, 'Store-e:' || store || '@' || (SELECT last FROM e WHERE period = 2030), -1.0, '<=', constant FROM l, s WHERE l.period = 2040"""))
def carbon_constraint(c):
    return _tidy(constraints.carbon_constraint(view(c, "stores"), view(c, "buses"), view(c, "snapshots"), _limits(c), ["AC", "H2"]))


@query(_sql(("stores", "buses", "snapshots", "periods"), _S, "SELECT l.name, store, 'Store-e:' || store || '@' || last, years, '<=', constant FROM l JOIN e ON e.period = l.period JOIN periods p ON p.period = l.period, s"))
def carbon_budget(c):
    return _tidy(constraints.carbon_budget(view(c, "stores"), view(c, "buses"), view(c, "snapshots"), view(c, "periods"), _limits(c), ["AC", "H2"]))


@query(_sql(("stores", "buses", "snapshots"), _S, "SELECT l.name, store, 'Store-e:' || store || '@' || (SELECT max(snapshot) FROM snapshots), 1.0, '<=', constant FROM l, s WHERE l.period = 2030"))
def co2_atmosphere(c):
    return _tidy(constraints.co2_atmosphere(view(c, "stores"), view(c, "buses"), view(c, "snapshots"), _limits(c).where("period = 2030"), ["AC", "H2"]))


@query("SELECT carrier, growth * 10 * 1.3 * 1000 AS max_growth, relative AS max_relative_growth FROM (VALUES ('solar', 20.0, 3.0), ('onwind', 10.0, NULL)) t(carrier, growth, relative)")
def max_growth(c):
    d = c.spark.createDataFrame([("solar", 20.0, 3.0), ("onwind", 10.0, None)], "carrier string, growth double, relative double")
    return constraints.max_growth(d, view(c, "periods"), 1.3)


_BOIL = """g AS (SELECT 'L' || p_partkey || ' gas boiler-2020' AS name, 'gas boiler' AS carrier, 'B' || p_partkey % 25 AS bus1, p_size * 1.0 AS p_nom, 'L' || p_partkey || ' retrofitted H2 boiler-2020' AS h2 FROM part WHERE p_partkey % 3 = 0),
 h AS (SELECT bus, snapshot, sum(p) AS p FROM loads_t t JOIN loads l ON l.name = t.name WHERE l.carrier = 'heat' GROUP BY ALL), x AS (SELECT bus, snapshot, p / max(p) OVER (PARTITION BY bus, snapshot < 3) AS q FROM h),
 j AS (SELECT g.name, h2, s.snapshot, p_nom * coalesce(q, 0) AS rhs FROM g CROSS JOIN snapshots s LEFT JOIN x ON x.bus = bus1 AND x.snapshot = s.snapshot)"""


@query(_sql(("loads_t",), _BOIL, "SELECT 'gas_retrofit', name || '@' || snapshot, 'Link-p:' || name || '@' || snapshot, 1.0, '=', rhs FROM j UNION ALL SELECT 'gas_retrofit', name || '@' || snapshot, 'Link-p:' || h2 || '@' || snapshot, 1.0, '=', rhs FROM j"))
def boiler_retrofit(c):
    p = c.part.where("p_partkey % 3 = 0")
    one = lambda kind, ext: p.select(F.concat(F.lit("L"), F.col("p_partkey").cast("string"), F.lit(f" {kind}-2020")).alias("name"), F.lit(kind).alias("carrier"), F.concat(F.lit("B"), (F.col("p_partkey") % 25).cast("string")).alias("bus1"), (F.col("p_size") * 1.0).alias("p_nom"), F.lit(ext).alias("p_nom_extendable"))
    heat = view(c, "loads_t").join(view(c, "loads").where("carrier = 'heat'").select("name", "bus"), "name").groupBy("bus", "snapshot").agg(F.sum("p").alias("p"))
    return _tidy(constraints.boiler_retrofit(one("gas boiler", False).unionByName(one("retrofitted H2 boiler", True)), heat, view(c, "snapshots")))


_G = "g AS (SELECT *, 'C' || (k % 5) AS country FROM generators)"


@query(_sql(("generators",), f"{_G}, h AS (SELECT country, carrier, sum(p_nom) AS have FROM g WHERE NOT p_nom_extendable GROUP BY 1, 2), l AS (SELECT * FROM (VALUES ('C1', 'solar', 100.0, 9000.0), ('C2', 'onwind', NULL, 20.0), ('C3', 'OCGT', 30000.0, NULL)) t(country, carrier, lo, hi))",
 """SELECT CASE WHEN m THEN 'limit_min' ELSE 'limit_max' END, g.country || ' ' || g.carrier, g.name, 1.0, CASE WHEN m THEN '>=' ELSE '<=' END, greatest(CASE WHEN m THEN lo ELSE hi END - coalesce(have, 0), 0)
 FROM g JOIN l ON l.country = g.country AND l.carrier = g.carrier LEFT JOIN h ON h.country = g.country AND h.carrier = g.carrier, (VALUES (true), (false)) v(m) WHERE p_nom_extendable AND CASE WHEN m THEN lo ELSE hi END IS NOT NULL"""))
def limit_constraints(c):
    g = view(c, "generators").withColumn("country", F.concat(F.lit("C"), (F.col("k") % 5).cast("string")))
    lim = c.spark.createDataFrame([("C1", "solar", 100.0, 9000.0), ("C2", "onwind", None, 20.0), ("C3", "OCGT", 30000.0, None)], "country string, carrier string, min double, max double")
    return _tidy(constraints.country_carrier_limits(g, lim))


@query(_sql(("generators", "loads_t", "storage_units_t", "buses"), """n AS (SELECT country, sum(p * w_generators) AS d FROM loads_t t JOIN loads l ON l.name = t.name JOIN buses b ON b.name = l.bus JOIN snapshots s ON s.snapshot = t.snapshot GROUP BY 1),
 f AS (SELECT country, sum(inflow * w_stores) AS i FROM storage_units_t t JOIN storage_units u ON u.name = t.name JOIN buses b ON b.name = u.bus JOIN snapshots s ON s.snapshot = t.snapshot GROUP BY 1), q AS (SELECT n.country, 0.1 * (0.7 * d - coalesce(i, 0)) AS rhs FROM n LEFT JOIN f ON f.country = n.country)""",
 """SELECT 'equity_min', q.country, 'Generator-p:' || g.name || '@' || s.snapshot, 0.1 * w_generators, '>=', rhs FROM generators g JOIN buses b ON b.name = g.bus JOIN q ON q.country = b.country, snapshots s
 UNION ALL SELECT 'equity_min', q.country, 'StorageUnit-spill:' || u.name || '@' || s.snapshot, -0.1 * w_stores, '>=', rhs FROM storage_units u JOIN buses b ON b.name = u.bus JOIN q ON q.country = b.country, snapshots s"""))
def self_sufficiency(c):
    b = view(c, "buses").select(F.col("name").alias("bus"), "country")
    loads = view(c, "loads_t").join(view(c, "loads").select("name", "bus"), "name").join(b, "bus")
    units = view(c, "storage_units_t").join(view(c, "storage_units").select("name", "bus"), "name").join(b, "bus")
    return _tidy(constraints.self_sufficiency(view(c, "generators").join(b, "bus"), loads, units, view(c, "snapshots"), "country", 0.7))


@query(_sql(("generators",), "", "SELECT 'bau_mincaps', carrier, 'Generator-p_nom:' || name, 1.0, '>=', CASE carrier WHEN 'solar' THEN 10 ELSE 25 END FROM generators WHERE p_nom_extendable AND carrier IN ('solar', 'OCGT')"))
def minimum_capacity(c):
    return _tidy(constraints.minimum_capacity(view(c, "generators"), {"solar": 10, "OCGT": 25}))


@query(_sql(("generators", "loads_t"), "", "SELECT 'safe_mintotalcap', 'peak', 'Generator-p_nom:' || name, 1.0, '>=', 1.1 * (SELECT max(p) FROM (SELECT sum(p) AS p FROM loads_t GROUP BY snapshot)) - (SELECT sum(p_nom) FROM generators WHERE NOT p_nom_extendable AND carrier IN ('nuclear', 'coal')) FROM generators WHERE p_nom_extendable AND carrier IN ('nuclear', 'coal')"))
def reserve_margin(c):
    return _tidy(constraints.reserve_margin(view(c, "generators"), view(c, "loads_t"), 0.1, ["nuclear", "coal"]))


@query(_sql(("generators_t", "loads_t"), """v AS (SELECT t.name, snapshot, p_max_pu FROM generators_t t JOIN generators g ON g.name = t.name WHERE carrier IN ('solar', 'onwind')), d AS (SELECT snapshot, sum(p) AS d FROM loads_t GROUP BY 1),
 f AS (SELECT snapshot, sum(p_max_pu * p_nom) AS f FROM v JOIN generators g ON g.name = v.name WHERE NOT p_nom_extendable GROUP BY 1), q AS (SELECT d.snapshot, 0.02 * d + 0.03 * coalesce(f, 0) + 400 AS rhs FROM d LEFT JOIN f ON f.snapshot = d.snapshot),
 u AS (SELECT g.name, q.snapshot, p_nom_extendable AS x, coalesce(p_max_pu, 1.0) AS pu, CASE WHEN p_nom_extendable THEN 0 ELSE coalesce(p_max_pu, 1.0) * p_nom END AS top FROM generators g CROSS JOIN q LEFT JOIN v ON v.name = g.name AND v.snapshot = q.snapshot)""",
 """SELECT 'reserve_margin', q.snapshot::VARCHAR, 'Generator-r:' || g.name || '@' || q.snapshot, 1.0, '>=', rhs FROM generators g, q
 UNION ALL SELECT 'reserve_margin', q.snapshot::VARCHAR, 'Generator-p_nom:' || v.name, -0.03 * p_max_pu, '>=', rhs FROM v JOIN generators g ON g.name = v.name JOIN q ON q.snapshot = v.snapshot WHERE p_nom_extendable
 UNION ALL SELECT 'Generator-p-reserve-upper', name || '@' || snapshot, a || name || '@' || snapshot, 1.0, '<=', top FROM u, (VALUES ('Generator-p:'), ('Generator-r:')) k(a)
 UNION ALL SELECT 'Generator-p-reserve-upper', name || '@' || snapshot, 'Generator-p_nom:' || name, -pu, '<=', top FROM u WHERE x"""))
def operational_reserve(c):
    g = view(c, "generators")
    a = view(c, "generators_t").join(g.where("carrier IN ('solar', 'onwind')").select("name"), "name", "left_semi")
    return _tidy(constraints.operational_reserve(g, a, view(c, "loads_t"), 0.02, 0.03, 400.0))


def _named(c, *kinds):
    """Links called "L<key> <kind>-2030" for every part, with capacities and efficiencies of its size."""
    k = F.col("p_partkey").cast("string")
    kind = F.explode(F.array(*map(F.lit, kinds))).alias("kind")
    d = c.part.select("p_partkey", "p_size", kind)
    return d.select(F.concat(F.lit("L"), k, F.lit(" "), F.col("kind"), F.lit("-2030")).alias("name"), (F.col("p_partkey") % 3 > 0).alias("p_nom_extendable"), (F.col("p_size") / 50.0).alias("efficiency"), (F.col("p_size") * 1.0).alias("p_nom"), "kind", (F.col("p_partkey") % 7 + 0.5).alias("energy_to_power"), (F.col("p_size") / 100.0).alias("p_nom_ratio"), F.lit(0.75).alias("c_b"), (F.col("p_partkey") % 5 == 0).alias("reversed"))


def _ratio_sql(name: str, kinds: tuple) -> str:
    v = ", ".join(f"('{k}')" for k in kinds)
    return _sql(("periods",), f"p AS (SELECT 'L' || p_partkey || ' ' || k AS x, p_size / 50.0 AS eff FROM part, (VALUES {v}) t(k) WHERE p_partkey % 3 > 0)", f"SELECT '{name}', x || '-2030', 'Link-p_nom:' || x || ' charger-2030', 1.0, '=', 0 FROM p UNION ALL SELECT '{name}', x || '-2030', 'Link-p_nom:' || x || ' discharger-2030', -eff, '=', 0 FROM p")


@query(_ratio_sql("Link-charger_ratio", ("battery", "home battery")))
def battery_balance(c):
    return _tidy(constraints.battery_balance(_named(c, "battery charger", "battery discharger", "home battery charger", "home battery discharger", "heat pump")))


@query(_ratio_sql("TES_charger_ratio", ("urban central water tanks", "urban central water pits", "urban central aquifer thermal energy storage")))
def tes_charger_ratio(c):
    kinds = [f"urban central {k} {x}" for k in ("water tanks", "water pits", "aquifer thermal energy storage") for x in ("charger", "discharger")]
    return _tidy(constraints.tes_charger_ratio(_named(c, *kinds, "battery charger")))


@query(_sql(("periods",), "p AS (SELECT 'L' || p_partkey || ' ' || k AS x, p_partkey % 7 + 0.5 AS e FROM part, (VALUES ('rural water tanks'), ('urban central water pits')) t(k) WHERE p_partkey % 3 > 0)", "SELECT 'TES_energy_to_power_ratio', x || '-2030', 'Store-e_nom:' || x || '-2030', 1.0, '=', 0 FROM p UNION ALL SELECT 'TES_energy_to_power_ratio', x || '-2030', 'Link-p_nom:' || x || ' charger-2030', -e, '=', 0 FROM p"))
def tes_energy_to_power(c):
    stores = _named(c, "rural water tanks", "urban central water pits").withColumnRenamed("p_nom_extendable", "e_nom_extendable")
    return _tidy(constraints.tes_energy_to_power(_named(c, "rural water tanks charger", "urban central water pits charger"), stores))


@query(_sql(("periods",), "p AS (SELECT 'L' || p_partkey AS x FROM part WHERE p_partkey % 2 = 0)", "SELECT 'Link-bidirectional_sync', x, 'Link-p_nom:' || x || '-reversed', 1.0, '=', 0 FROM p UNION ALL SELECT 'Link-bidirectional_sync', x, 'Link-p_nom:' || x, -1.0, '=', 0 FROM p"))
def bidirectional_sync(c):
    k = F.concat(F.lit("L"), F.col("p_partkey").cast("string"))
    l = c.part.select(k.alias("name"), (F.col("p_partkey") % 2 == 0).alias("p_nom_extendable"), F.lit(False).alias("reversed"))
    return _tidy(constraints.bidirectional_sync(l.unionByName(l.select(F.concat("name", F.lit("-reversed")).alias("name"), "p_nom_extendable", F.lit(True).alias("reversed")))))


@query(_sql(("snapshots",), """p AS (SELECT 'L' || p_partkey || ' urban central gas CHP ' AS x, p_partkey % 3 > 0 AS ext, p_size / 50.0 AS eff, p_size / 100.0 AS ratio, p_size * 1.0 AS cap FROM part),
 t AS (SELECT *, x || 'electric-2030' AS e, x || 'heat-2030' AS h FROM p, snapshots)""",
 """SELECT 'chplink-fix_p_nom_ratio', x || 'electric-2030', 'Link-p_nom:' || x || 'electric-2030', ratio * eff, '=', 0.0 FROM p WHERE ext UNION ALL SELECT 'chplink-fix_p_nom_ratio', x || 'electric-2030', 'Link-p_nom:' || x || 'heat-2030', -eff, '=', 0 FROM p WHERE ext
 UNION ALL SELECT 'chplink-top_iso_fuel_line_ext', e || '@' || snapshot, 'Link-p:' || u || '@' || snapshot, 1, '<=', 0 FROM (SELECT *, unnest([e, h]) AS u FROM t) WHERE ext UNION ALL SELECT 'chplink-top_iso_fuel_line_ext', e || '@' || snapshot, 'Link-p_nom:' || e, -1, '<=', 0 FROM t WHERE ext
 UNION ALL SELECT 'chplink-top_iso_fuel_line_fix', e || '@' || snapshot, 'Link-p:' || u || '@' || snapshot, 1, '<=', cap FROM (SELECT *, unnest([e, h]) AS u FROM t) WHERE NOT ext
 UNION ALL SELECT 'chplink-backpressure', e || '@' || snapshot, 'Link-p:' || h || '@' || snapshot, eff * 0.75, '<=', 0 FROM t UNION ALL SELECT 'chplink-backpressure', e || '@' || snapshot, 'Link-p:' || e || '@' || snapshot, -eff, '<=', 0 FROM t"""))
def chp_region(c):
    return _tidy(constraints.chp(_named(c, "urban central gas CHP electric", "urban central gas CHP heat", "urban central heat pump"), view(c, "snapshots")))


@query(_sql(("periods",), "p AS (SELECT 'L' || p_partkey AS x, p_size * 1.0 AS cap FROM part WHERE p_partkey % 3 > 0 AND p_partkey % 5 > 0)", "SELECT 'Link-pipe_retrofit', x || ' -2030', 'Link-p_nom:' || x || ' gas pipeline-2030', 1.0, '=', cap FROM p UNION ALL SELECT 'Link-pipe_retrofit', x || ' -2030', 'Link-p_nom:' || x || ' H2 pipeline retrofitted-2030', 1 / 0.6, '=', cap FROM p"))
def pipe_retrofit(c):
    return _tidy(constraints.pipe_retrofit(_named(c, "gas pipeline", "H2 pipeline retrofitted").withColumnRenamed("kind", "carrier"), 0.6))


@query(_sql(("periods",), "p AS (SELECT p_partkey AS k FROM part)", "SELECT 'upper_bound_charging_capacity_of_geothermal_reservoir', 'B' || k, 'StorageUnit-p_nom:unit ' || k, 1.0, '<=', 0 FROM p WHERE k % 2 = 0 UNION ALL SELECT 'upper_bound_charging_capacity_of_geothermal_reservoir', 'B' || k, 'Link-p_nom:well ' || k, -1.0, '<=', 0 FROM p WHERE k % 2 = 0"))
def geothermal_charging(c):
    k = F.col("p_partkey").cast("string")
    carrier = F.when(F.col("p_partkey") % 2 == 0, "geothermal heat").otherwise("hydro").alias("carrier")
    wells = c.part.select(F.concat(F.lit("well "), k).alias("name"), F.concat(F.lit("B"), k).alias("bus1"), carrier)
    return _tidy(constraints.geothermal_charging(wells, c.part.select(F.concat(F.lit("unit "), k).alias("name"), F.concat(F.lit("B"), k).alias("bus"), carrier)))


@query(_sql(("generators", "links", "snapshots"), "q AS (SELECT snapshot, w_generators AS w, (SELECT sum(w_generators) FROM snapshots) / 8760 * 3e6 AS rhs FROM snapshots)", "SELECT 'import_limit', 'import', 'Generator-p:' || name || '@' || snapshot, w, '<=', rhs FROM generators, q WHERE carrier LIKE '%import%' UNION ALL SELECT 'import_limit', 'import', 'Link-p:' || name || '@' || snapshot, w * efficiency, '<=', rhs FROM links, q WHERE carrier LIKE '%import%'"))
def import_limit(c):
    return _tidy(constraints.import_limit(view(c, "generators"), view(c, "links"), view(c, "snapshots"), 3.0))


@query(_sql(("generators", "snapshots"), "", "SELECT 'co2', 'co2', name || '@' || snapshot, CASE carrier WHEN 'OCGT' THEN 0.2 ELSE 0.34 END / efficiency * w_generators, '<=', 1e6 FROM generators, snapshots WHERE carrier IN ('OCGT', 'coal')"))
def emission_cap(c):
    k = c.spark.createDataFrame([("OCGT", 0.2), ("coal", 0.34), ("solar", 0.0)], "carrier string, co2_emissions double")
    return _tidy(constraints.emissions(view(c, "generators"), k, view(c, "snapshots").select("snapshot", "w_generators"), 1e6))


@query(f"{ctes('generators_t')} SELECT name, snapshot, CASE WHEN p_max_pu <= 0.2 THEN 0 ELSE p_max_pu END AS p_max_pu FROM generators_t")
def clip_small(c):
    return constraints.clip_small(view(c, "generators_t").select("name", "snapshot", "p_max_pu"), "p_max_pu", 0.2)
