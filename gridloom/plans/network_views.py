"""The test tables seen as a solved network, in SQL that Spark and DuckDB both read.

nation = buses and lines, supplier = generators, customer = loads, part = stores, storage
units and links, region = snapshots of two investment periods.  A query gets the view as a
DataFrame; its oracle gets the same text as a common table expression, and states the rule
on its own.
"""

from __future__ import annotations

from pyspark.sql import DataFrame

_CARRIER = "CASE k % 8 WHEN 0 THEN 'solar' WHEN 1 THEN 'solar-hsat' WHEN 2 THEN 'onwind' WHEN 3 THEN 'offwind-ac' WHEN 4 THEN 'OCGT' WHEN 5 THEN 'nuclear' WHEN 6 THEN 'import gas' ELSE 'coal' END"
_NAME = "CAST({} AS STRING)".format

VIEWS = {
    "snapshots": "SELECT CAST(r_regionkey AS INT) AS snapshot, CASE WHEN r_regionkey < 3 THEN 2030 ELSE 2040 END AS period, 1700e0 + r_regionkey * 10 AS w_generators, 1600e0 + r_regionkey * 10 AS w_stores, 1500e0 + r_regionkey AS w_objective FROM region",
    "periods": "SELECT * FROM (VALUES (2030, 10e0, 9e0), (2040, 5e0, 4e0)) AS t(period, years, objective)",
    "buses": f"SELECT 'B' || {_NAME('n_nationkey')} AS name, CASE n_nationkey % 5 WHEN 3 THEN 'H2' WHEN 4 THEN 'low voltage' ELSE 'AC' END AS carrier, 'C' || {_NAME('n_regionkey')} AS country, CASE WHEN n_nationkey % 9 = 8 THEN 'EU' ELSE 'L' || {_NAME('n_regionkey')} END AS location, n_nationkey AS k FROM nation",
    "generators": f"""SELECT 'N' || {_NAME('m')} || ' ' || {_CARRIER} || CASE WHEN h = 1 THEN '-2030' ELSE '-2020' END AS name, 'B' || {_NAME('m % 25')} AS bus, {_CARRIER} AS carrier, h = 1 AS p_nom_extendable, a AS p_nom, (k % 5) * 900e0 AS p_nom_min, 6000e0 AS p_nom_max,
 a + (k % 7) * 10 AS p_nom_opt, 100e0 + k % 9 AS capital_cost, 1e0 + k % 4 AS marginal_cost, 5e-1 + (k % 3) / 10e0 AS efficiency, CASE WHEN h = 1 THEN 2030 ELSE 2000 END AS build_year, CASE WHEN k % 6 = 0 THEN 60e0 ELSE 25e0 END AS lifetime, 1e0 AS sign, k
 FROM (SELECT s_suppkey AS k, CAST(floor(s_suppkey / 16) AS INT) AS m, CAST(floor(s_suppkey / 8) AS INT) % 2 AS h, abs(s_acctbal) AS a FROM supplier) AS s""",
    "generators_t": "SELECT g.name, s.snapshot, g.p_nom_opt * ((g.k + s.snapshot) % 5) / 5e0 AS p, CAST((g.k * 3 + s.snapshot) % 10 AS DOUBLE) / 10e0 + 5e-2 AS p_max_pu FROM generators AS g CROSS JOIN snapshots AS s",
    "loads": f"SELECT 'load ' || {_NAME('c_custkey')} AS name, 'B' || {_NAME('c_nationkey')} AS bus, CASE c_custkey % 3 WHEN 0 THEN 'electricity' WHEN 1 THEN 'heat' ELSE 'industry' END AS carrier, abs(c_acctbal) AS a FROM customer",
    "loads_t": "SELECT l.name, s.snapshot, l.a * (1 + s.snapshot / 10e0) AS p FROM loads AS l CROSS JOIN snapshots AS s",
    "stores": f"SELECT 'store ' || {_NAME('p_partkey')} AS name, 'B' || {_NAME('p_partkey % 25')} AS bus, CASE p_partkey % 2 WHEN 0 THEN 'co2 stored' ELSE 'battery' END AS carrier, p_size * 1e0 AS e_nom_opt, p_partkey % 4 = 0 AS e_cyclic, 10e0 + p_partkey % 7 AS capital_cost, CASE WHEN p_partkey % 10 = 0 THEN -150e0 ELSE 1e0 END AS marginal_cost, p_partkey AS k, 2030 AS build_year, 30e0 AS lifetime FROM part WHERE p_partkey % 3 = 0",
    "stores_t": "SELECT x.name, s.snapshot, ((x.k + s.snapshot) % 7 - 3) * 1e0 AS p FROM stores AS x CROSS JOIN snapshots AS s",
    "storage_units": f"SELECT 'unit ' || {_NAME('p_partkey')} AS name, 'B' || {_NAME('p_partkey % 25')} AS bus, CASE p_partkey % 2 WHEN 0 THEN 'hydro' ELSE 'PHS' END AS carrier, p_size * 1e0 AS p_nom_opt, 6e0 AS max_hours, 20e0 + p_partkey % 5 AS capital_cost, 2e0 AS marginal_cost, p_partkey AS k, 2020 AS build_year, 80e0 AS lifetime FROM part WHERE p_partkey % 3 = 1",
    "storage_units_t": "SELECT x.name, s.snapshot, ((x.k + 2 * s.snapshot) % 9 - 4) * 1e0 AS p, ((x.k + s.snapshot) % 3) * 1e0 AS inflow FROM storage_units AS x CROSS JOIN snapshots AS s",
    "links": f"""SELECT 'link ' || {_NAME('p_partkey')} AS name, 'B' || {_NAME('p_partkey % 25')} AS bus0, 'B' || {_NAME('(p_partkey * 7 + 3) % 25')} AS bus1, CASE WHEN p_partkey % 4 = 0 THEN '' ELSE 'B' || {_NAME('(p_partkey + 8) % 25')} END AS bus2,
 CASE p_partkey % 5 WHEN 0 THEN 'DC' WHEN 1 THEN 'H2 Electrolysis' WHEN 2 THEN 'import H2' WHEN 3 THEN 'gas boiler' ELSE 'heat pump' END AS carrier, p_size * 1e0 AS p_nom_opt, p_size * 2e0 AS p_nom, p_partkey % 2 = 0 AS p_nom_extendable, 100e0 + p_partkey % 50 AS length, 6e-1 AS efficiency, 30e0 + p_partkey % 3 AS capital_cost, 5e-1 AS marginal_cost, 2025 AS build_year, 20e0 AS lifetime, p_partkey AS k FROM part WHERE p_partkey % 3 = 2""",
    "links_t": "SELECT x.name, s.snapshot, ((x.k + s.snapshot) % 6) * 1e0 AS p0, ((x.k + s.snapshot) % 6) * -6e-1 AS p1, ((x.k + s.snapshot) % 6) * -1e-1 AS p2 FROM links AS x CROSS JOIN snapshots AS s",
    "lines": f"SELECT 'line ' || {_NAME('n_nationkey')} AS name, 'B' || {_NAME('n_nationkey')} AS bus0, 'B' || {_NAME('(n_nationkey + 1) % 25')} AS bus1, 'AC' AS carrier, 50e0 + n_nationkey AS length, 400e0 + n_nationkey * 3 AS s_nom_opt, 7e0 AS capital_cost, n_nationkey AS k, 1990 AS build_year, 100e0 AS lifetime FROM nation",
    "lines_t": "SELECT x.name, s.snapshot, ((x.k + s.snapshot) % 4 - 1) * 10e0 AS p0 FROM lines AS x CROSS JOIN snapshots AS s",
    "prices": "SELECT b.name AS bus, s.snapshot, ((b.k * 7 + s.snapshot * 3) % 20) * 25e-1 AS price FROM buses AS b CROSS JOIN snapshots AS s",
}
_NEEDS = {"generators_t": ("generators", "snapshots"), "loads_t": ("loads", "snapshots"), "stores_t": ("stores", "snapshots"), "storage_units_t": ("storage_units", "snapshots"), "links_t": ("links", "snapshots"), "lines_t": ("lines", "snapshots"), "prices": ("buses", "snapshots")}
_TABLES = ("region", "nation", "supplier", "customer", "part")


def _order(names: tuple[str, ...]) -> list[str]:
    out: list[str] = []
    for n in names:
        out += [x for x in (*_NEEDS.get(n, ()), n) if x not in out]
    return out


def ctes(*names: str) -> str:
    """``WITH`` clause of the views named and those that they read."""
    return "WITH " + ",\n".join(f"{n} AS ({VIEWS[n]})" for n in _order(names))


def view(c, name: str) -> DataFrame:
    """A view as a DataFrame."""
    sources = {t: getattr(c, t) for t in _TABLES}
    have = {n: VIEWS[n] for n in _order((name,))}
    text = have.pop(name)
    for t, df in sources.items():
        df.createOrReplaceTempView(t)
    return c.spark.sql((f"WITH {', '.join(f'{n} AS ({v})' for n, v in have.items())} " if have else "") + text)
