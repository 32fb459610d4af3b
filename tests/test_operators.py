"""Edge cases of the engine's operators on small inline tables."""

import datetime as dt
import math
import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridloom.functions import scalars
from gridloom.operators import allocation, cleaning, clustering, constraints, frames, graph, network, spatial, temporal
from gridloom.plans import summary
from gridloom.session import nan_to_null
from gridloom.sources import readers


def rows(df, *cols):
    return sorted(tuple(r) for r in (df.select(*cols) if cols else df).collect())


def test_nan_becomes_null(spark):
    df = spark.createDataFrame([(1, float("nan")), (2, 1.0)], "k int, v double")
    assert rows(nan_to_null(df).where("v is null"), "k") == [(1,)]


def test_update_adds_no_rows_and_skips_null(spark):
    a = spark.createDataFrame([("a", 1.0), ("b", 2.0)], "k string, v double")
    b = spark.createDataFrame([("a", None), ("b", 9.0), ("c", 5.0)], "k string, v double")
    assert rows(frames.update(a, b, ["k"], ["v"])) == [("a", 1.0), ("b", 9.0)]
    assert rows(frames.combine_first(a, b, ["k"], ["v"])) == [("a", 1.0), ("b", 2.0), ("c", 5.0)]


def test_override_wildcard_wins(spark):
    base = spark.createDataFrame([("x", "rate", 0.1), ("y", "rate", 0.2), ("x", "life", 20.0)], "t string, p string, v double")
    custom = spark.createDataFrame([("x", "life", 25.0), ("z", "life", 9.0), ("all", "rate", 0.07)], "t string, p string, v double")
    got = {(t, p): v for t, p, v in frames.override(base, custom, "t", "p", "v").collect()}
    assert got == {("x", "rate"): 0.07, ("y", "rate"): 0.07, ("z", "rate"): 0.07, ("x", "life"): 25.0, ("z", "life"): 9.0}


def test_weighted_avg_falls_back_to_mean(spark):
    df = spark.createDataFrame([("a", 1.0, 0.0), ("a", 3.0, 0.0), ("b", 1.0, 1.0), ("b", 4.0, 2.0)], "g string, v double, w double")
    assert rows(df.groupBy("g").agg(frames.weighted_avg(F.col("v"), F.col("w")).alias("m"))) == [("a", 2.0), ("b", 3.0)]


def test_strategies_drop_null_keys(spark):
    df = spark.createDataFrame([("a", 1.0, 2), ("a", 3.0, 1), (None, 5.0, 3)], "g string, v double, o int")
    got = frames.strategies(df, ["g"], {"v": "first"}, order="o")
    assert rows(got) == [("a", 3.0)]


def test_clip_keeps_null(spark):
    df = spark.createDataFrame([(None,), (5.0,), (-5.0,)], "v double").select(frames.clip(F.col("v"), 0.0, 1.0).alias("v"))
    assert sorted(str(r[0]) for r in df.collect()) == ["0.0", "1.0", "None"]


def test_closest_first_wins_on_tie(spark):
    df = spark.createDataFrame([(220.0,), (300.0,), (330.0,), (400.0,), (500.0,), (340.0,)], "v double")
    got = dict(rows(frames.closest(df, "v", [(220.0, "220"), (300.0, "300"), (380.0, "380")], "t")))
    assert got == {220.0: "220", 300.0: "300", 330.0: "300", 400.0: "380", 500.0: "380", 340.0: "300"}


def test_snapshots_two_ranges_and_leap_day(spark):
    s = temporal.snapshots(spark, [("2024-02-28", "2024-03-02"), ("2025-01-01", "2025-01-02")], "6 hours", drop_leap_day=True)
    assert s.count() == 12
    assert s.where("day(snapshot) = 29").count() == 0


def _series(spark, values):
    t0 = dt.datetime(2024, 1, 1)
    return spark.createDataFrame([("a", t0 + dt.timedelta(hours=i), v) for i, v in enumerate(values)], "k string, t timestamp_ntz, v double")


def test_gaps_of_many_lengths(spark):
    v = [1.0, None, None, 2.0, None, None, None, 3.0] + [None] * 200
    g = [r["gap_len"] for r in temporal.gap_runs(_series(spark, v), ["k"], "t", "v").orderBy("t").collect()]
    assert g[:8] == [0, 2, 2, 0, 3, 3, 3, 0] and set(g[8:]) == {200}


def test_interpolation_limit(spark):
    v = [None, 1.0, None, None, 4.0, None, None, None, None, 9.0, None, None, None]
    got = [r["f"] for r in temporal.interpolate(_series(spark, v), ["k"], "t", "v", 2, "f").orderBy("t").collect()]
    assert got == [None, 1.0, 2.0, 3.0, 4.0, 5.0, 6.0, None, None, 9.0, 9.0, 9.0, None]


def test_asof_backward_and_bfill(spark):
    left = _series(spark, [0.0] * 4).drop("v")
    right = _series(spark, [None, 5.0, None, 7.0]).where("v is not null")
    got = [r["v"] for r in temporal.asof(left, right, "t", "v", ["k"]).orderBy("t").collect()]
    assert got == [None, 5.0, 5.0, 7.0]
    assert [r["v"] for r in temporal.asof(left, right, "t", "v", ["k"], bfill=True).orderBy("t").collect()] == [5.0, 5.0, 5.0, 7.0]


def test_segments_cover_series(spark):
    df = _series(spark, [1.0, 1.0, 1.0, 9.0, 9.0, 5.0]).withColumn("y", F.lit(1))
    got = temporal.segments(df, ["y"], "t", ["v"], 3).orderBy("segment").collect()
    assert [(r["length"], r["v"]) for r in got] == [(3, 1.0), (2, 9.0), (1, 5.0)]


def test_distribution_key_uniform_group(spark):
    df = spark.createDataFrame([("a", 1, 1.0), ("a", 2, 3.0), ("a", 3, None), ("b", 4, None), ("b", 5, None)], "g string, n int, v double")
    got = {r["n"]: r["share"] for r in allocation.distribution_key(df, "g", "n", "v").collect()}
    assert math.isclose(sum(got[i] for i in (1, 2, 3)), 1) and got[4] == got[5] == 0.5


def test_brownfield_infinite_lifetime(spark):
    df = spark.createDataFrame(
        [("a", 2000, float("inf"), 50.0, True), ("b", 2010, 30.0, 50.0, True), ("c", 1990, 30.0, 50.0, True), ("d", 2015, 30.0, 5.0, True), ("e", 2015, 30.0, 10.0, True), ("f", 2015, 30.0, 5.0, False)],
        "name string, build_year int, lifetime double, p_nom_opt double, p_nom_extendable boolean",
    ).withColumns({"efficiency": F.lit(1.0), "p_nom_ratio": F.lit(1.0)})
    assert rows(allocation.brownfield(df, 2030), "name") == [("b",), ("e",), ("f",)]


def test_split_cells_and_voltage(spark):
    df = spark.createDataFrame([("w1", "220000;380000", "3;6"), ("w2", "110000", "3")], "id string, v string, c string")
    assert rows(cleaning.split_cells(df, "id", ["v", "c"])) == [("w1-1", "220000", "3"), ("w1-2", "380000", "6"), ("w2", "110000", "3")]
    assert rows(df.where(cleaning.any_at_least(F.col("v"), 200000)), "id") == [("w1",)]


def test_gas_repair(spark):
    df = spark.createDataFrame([("Natural Gas", "Steam Turbine"), ("Natural Gas", "Combustion Engine"), ("Natural Gas", None), ("Hydro", "Not Found")], "Fueltype string, Technology string")
    assert rows(cleaning.repair_gas(df)) == [("Hydro", "Not Found"), ("Natural Gas", "CCGT"), ("Natural Gas", "CCGT"), ("Natural Gas", "OCGT")]
    fuels = spark.createDataFrame([("Oil", "OCGT"), ("x", "CCGT"), ("Hydro", None)], "Fueltype string, Technology string")
    assert rows(cleaning.gas_fuel(fuels), "Fueltype") == [("Hydro",), ("Natural Gas",), ("Natural Gas",)]


def test_three_voltages_make_three_transformers(spark):
    b = spark.createDataFrame([("s", i, v, float(i)) for i, v in enumerate((110000, 220000, 380000))] + [("t", 9, 110000, 1.0), ("t", 10, 110000, 1.0)], "station_id string, bus_id int, voltage int, s_nom double")
    assert rows(network.station_transformers(b), "transformer_id", "s_nom") == [("s-110-220", 1.0), ("s-110-380", 2.0), ("s-220-380", 2.0)]


def test_gather_misses_are_errors(spark):
    df, keys = spark.createDataFrame([(1, "a")], "k int, v string"), spark.createDataFrame([(1,), (1,)], "k int")
    assert rows(frames.gather(df, keys, "k")) == [(1, "a"), (1, "a")]
    with pytest.raises(Exception, match="no k 2"):
        frames.gather(df, spark.createDataFrame([(2,)], "k int"), "k").collect()


def test_versions_need_one_supported_row(spark):
    df = spark.createDataFrame([("a", "1", "primary", "latest"), ("b", "1", "primary", "latest supported"), ("b", "2", "primary", "latest supported")], "dataset string, version string, source string, tags string")
    with pytest.raises(ValueError):
        cleaning.resolve_version(df, "a", "primary")
    with pytest.raises(Exception, match="several rows"):
        cleaning.resolve_version(df, "b", "primary").collect()


def test_charger_without_partner(spark):
    l = spark.createDataFrame([("A battery charger", True, 0.9)], "name string, p_nom_extendable boolean, efficiency double")
    with pytest.raises(Exception, match="no partner"):
        constraints.battery_balance(l).collect()


def _edges(spark, pairs):
    return spark.createDataFrame(pairs, "a int, b int, weight double")


def test_graph_two_components_and_stub(spark):
    nodes = spark.createDataFrame([(i,) for i in range(1, 8)], "id int")
    e = _edges(spark, [(1, 2, 1.0), (2, 3, 1.0), (3, 1, 1.0), (3, 4, 1.0), (5, 6, 1.0), (6, 5, 2.0)])
    assert rows(graph.components(nodes, e)) == [(1, 1), (2, 1), (3, 1), (4, 1), (5, 5), (6, 5), (7, 7)]
    assert dict(rows(graph.prune_stubs(nodes, e))) == {1: 1, 2: 2, 3: 3, 4: 3, 5: 5, 6: 5, 7: 7}
    got = {r["id"]: (r["source"], r["dist"]) for r in graph.shortest_paths(e, nodes.where("id = 4"), limit=2.0).collect()}
    assert got == {4: (4, 0.0), 3: (4, 1.0), 1: (4, 2.0), 2: (4, 2.0)}
    assert rows(graph.closure(spark.createDataFrame([(1, 2), (2, 3), (9, 8)], "src int, dst int"))) == [(1, 3), (2, 3), (9, 8)]


def test_busmap_drops_self_loops_and_merges(spark):
    m = spark.createDataFrame([(1, 10), (2, 10), (3, 20)], "old int, new int")
    e = _edges(spark, [(1, 2, 1.0), (1, 3, 2.0), (3, 2, 5.0)])
    assert rows(graph.map_branches(e, m, ["a", "b"], [], {"s": F.sum("weight")})) == [(10, 20, 7.0)]


def test_hac_and_constant_scaling(spark):
    d = np.array([[0, 1, 9], [1, 0, 9], [9, 9, 0]], float)
    assert clustering.linkage_labels(d, 2.0).tolist() == [0, 0, 2]
    assert clustering.linkage_labels(d, 2.0, connected=np.eye(3)).tolist() == [0, 1, 2]
    df = spark.createDataFrame([(1.0,), (1.0,)], "v double")
    assert rows(clustering.scale(df, ["v"])) == [(0.0,), (0.0,)]


def test_polygon_and_overlap_ties(spark):
    pts = spark.createDataFrame([(1, 0.5, 0.5), (2, 5.0, 5.0)], "id int, x double, y double")
    ring = spark.createDataFrame([("r", [[0.0, 0.0], [1.0, 0.0], [1.0, 1.0], [0.0, 1.0]])], "region string, ring array<array<double>>")
    assert rows(spatial.contained(pts, ring)) == [(1, "r")]
    s = spark.createDataFrame([("s", 0.0, 0.0, 2.0, 1.0)], "id string, x0 double, y0 double, x1 double, y1 double")
    t = spark.createDataFrame([("a", 0.0, 0.0, 1.0, 1.0), ("b", 1.0, 0.0, 2.0, 1.0)], "id string, x0 double, y0 double, x1 double, y1 double")
    assert rows(spatial.assign_by_overlap(spatial.box_shares(s, t))) == [("s", "a")]


def test_ports_skip_empty_third_port(spark):
    l = spark.createDataFrame([("x", "a", "b", "", 5.0, -4.0, 0.0)], "name string, bus0 string, bus1 string, bus2 string, p0 double, p1 double, p2 double")
    assert rows(summary.ports_long(l, 3), "bus", "p") == [("a", -5.0), ("b", 4.0)]


def test_land_use(spark):
    """What exists is taken off; a minimum above the rest raises it; never under 0."""
    rows_ = [("A wind-2030", "wind", True, 0.0, 0.0, 10.0), ("A wind-2000", "wind", False, 25.0, 0.0, 0.0), ("B wind-2030", "wind", True, 0.0, 7.0, 10.0), ("B wind-2010", "wind", False, 4.0, 0.0, 0.0)]
    g = spark.createDataFrame(rows_, "name string, carrier string, p_nom_extendable boolean, p_nom double, p_nom_min double, p_nom_max double")
    got = dict(rows(constraints.land_use(g, "2030", ("wind",)), "name", "p_nom_max"))
    assert got["A wind-2030"] == 0.0 and got["B wind-2030"] == 7.0


def test_reducer_settles(spark):
    """Two groups of nodes and two kinds of days are found; one node alone is kept."""
    day0 = dt.date(2024, 1, 1)
    data = [(n, day0 + dt.timedelta(days=d), "f", 10.0 * (n >= "c") + 5.0 * (d % 2) + 0.01 * d) for n in "abcd" for d in range(6)]
    x = spark.createDataFrame(data, "node string, day date, feature string, value double")
    geo = spark.createDataFrame([(a, b, 1.0 if (a >= "c") == (b >= "c") else 9.0) for a in "abcd" for b in "abcd" if a < b], "a string, b string, dist double")
    nodes, days, reps = clustering.alternate(x, geo, 0.5, 0.5)
    assert rows(nodes) == [("a", "a"), ("b", "a"), ("c", "c"), ("d", "c")]
    assert {r["id"].day % 2: r["cluster"] for r in days.collect()} == {1: day0, 0: day0 + dt.timedelta(days=1)} and sorted(r["weight"] for r in reps.collect()) == [3.0, 3.0]
    one = clustering.alternate(x.where("node = 'a'"), geo.where("false"), 0.5, 0.5)
    assert rows(one[0]) == [("a", "a")]


def test_deadband_bound_keeps_raw(spark):
    df = spark.createDataFrame([(10.0,), (15.0,), (17.0,), (25.0,)], "t double").select("t", scalars.degree_factor(F.col("t"), 15.0, 20.0, 2.0, 3.0).alias("f"))
    assert rows(df) == [(10.0, 10.0), (15.0, 15.0), (17.0, 0.0), (25.0, 15.0)]


def test_network_round_trip(spark, tmp_path):
    buses = spark.createDataFrame([("a", 380.0)], "name string, v_nom double")
    readers.write_network({"buses": buses}, str(tmp_path / "n"), {"year": 2030})
    tables, meta = readers.read_network(spark, str(tmp_path / "n"))
    assert rows(tables["buses"]) == [("a", 380.0)] and meta == {"year": 2030}


def test_csv_booleans_and_ids(spark, tmp_path):
    (tmp_path / "b.csv").write_text("bus_id,voltage,dc\n0523,380.0,f\n5232,,t\n")
    df = readers.read_csv(spark, str(tmp_path / "b.csv"), "bus_id string, voltage double, dc string", booleans={"dc": ("t", "f")})
    assert sorted(map(str, rows(df))) == ["('0523', 380.0, False)", "('5232', None, True)"]


def test_geojson(spark, tmp_path):
    (tmp_path / "g.json").write_text('{"features": [{"properties": {"name": "p"}, "geometry": {"type": "Point", "coordinates": [1.5, 2]}}]}')
    assert rows(readers.read_geojson(spark, str(tmp_path / "g.json"), "name: string"), "name", "geometry_type") == [("p", "Point")]


def test_streaming_matches_batch(spark, tmp_path):
    from gridloom.streaming import windows

    t0 = dt.datetime(2024, 1, 1)
    df = spark.createDataFrame([(t0 + dt.timedelta(minutes=20 * i), "a", float(i)) for i in range(30)], "ts timestamp_ntz, k string, value double")
    df.coalesce(2).write.parquet(str(tmp_path / "in"))
    q = windows.tumbling(windows.read_stream(spark, str(tmp_path / "in"), df.schema, 10), "ts", ["k"], "value").writeStream.outputMode("complete").format("memory").queryName("tumble").start()
    q.processAllAvailable()
    q.stop()
    batch = temporal.nhour(df, ["k"], "ts", 3, ["value"], [])
    assert sorted(r["mean"] for r in spark.table("tumble").collect()) == sorted(r["value"] for r in batch.collect())


def test_options_and_years():
    from gridloom.plans.options import at_year, parse_options

    o = parse_options("Co2L0.5-3h-solar+c0.5-EQ0.7c-lv1.25-CF+a+b+true-cb40ex0-T")
    assert o["co2_limit"] == 0.5 and o["resolution"] == ("mean", 3) and o["adjust"] == [("solar", "capital_cost", 0.5)]
    assert o["self_sufficiency"] == (0.7, "country") and o["line_limit"] == ("volume", 1.25) and o["config"] == [(["a", "b"], True)]
    assert o["carbon_budget"] == (40.0, "exponential", 0.0) and o["other"] == ["T"]
    table = {2020: 1.0, 2030: 3.0}
    assert [at_year(table, y) for y in (2010, 2020, 2025, 2040)] == [1.0, 1.0, 2.0, 3.0] and at_year(7, 2030) == 7


def test_carbon_path_spends_budget():
    from gridloom.plans.options import carbon_path

    for kind in ("exponential", "beta"):
        path = carbon_path(kind, 40.0, 4.0, list(range(2020, 2200)))
        assert abs(sum(path.values()) - 40.0) < 3.0 and path[2020] == 4.0


def test_cluster_allocation():
    from gridloom.operators.network import allocate_clusters

    assert allocate_clusters({"a": 60.0, "b": 30.0, "c": 10.0}, {"a": 4, "b": 9, "c": 9}, 10) == {"a": 4, "b": 4, "c": 2}


def test_balance_series_ranks_alike_in_any_order(spark):
    from gridloom.plans import statistics as st

    parts = {"a": (1e16, 0.0, -1e16), "b": (1e16, -1e16, 0.0)}  # in this order a sum of doubles loses what "a" adds in between
    data = [("AC", t, c, x + (t * 1e3 if x == 0 else 0)) for c, xs in parts.items() for t in (1, 2, 3) for x in xs]
    f = spark.createDataFrame(data, "bus_carrier string, snapshot int, carrier string, p double").coalesce(1)
    got = rows(st.balance_series(f, ["AC"], 0.5, 0.3), "carrier", "snapshot", "rank", "positive")
    assert got == [(c, t, k, float(t)) for k, c in ((1, "a"), (2, "b")) for t in (1, 2, 3)]


def test_balance_series_ranks_as_sql_row_by_row(spark):
    """At sf0.01 the SQL gives one result on any number of threads; carriers of one shape are ranked by rounding."""
    duckdb, sf = pytest.importorskip("duckdb"), "/root/testdata/sf0.01"
    if not os.path.isdir(sf):
        pytest.skip("no test tables")
    from gridloom.plans.queries import ORACLE, QUERIES

    con = duckdb.connect(config={"threads": 1})
    for t in ("region", "nation", "customer", "supplier", "part"):
        con.execute(f"create view {t} as select * from read_parquet('{sf}/{t}.parquet')")
    want = con.execute(f"SELECT DISTINCT carrier, rank FROM ({ORACLE['balance_series']})").fetchall()
    assert rows(QUERIES["balance_series"](spark, sf).select("carrier", "rank").distinct(), "carrier", "rank") == sorted(want)


def test_nearest_equals_all_pairs(spark):
    rng = np.random.default_rng(4)
    hav = lambda a, b: 2 * 6371.0 * math.asin(min(1.0, math.sqrt(math.sin(math.radians(b[1] - a[1]) / 2) ** 2 + math.cos(math.radians(a[1])) * math.cos(math.radians(b[1])) * math.sin(math.radians(b[0] - a[0]) / 2) ** 2)))
    spread = lambda n, size: [(float(rng.uniform(-180, 180)), float(rng.uniform(-90, 90))) for _ in range(n)] + [(float(x), float(y)) for x, y in rng.normal((10, 50), size, (n, 2))]
    odd = [(180.0, 0.0), (-180.0, 0.0), (0.0, 90.0), (77.0, 90.0), (0.0, -90.0), (0.0, 0.0), (10.0, 50.0), (10.0, 50.0)]
    points = [(i, i % 2, *xy) for i, xy in enumerate(spread(40, 0.01) + odd)]
    sites = [(i, i % 3, *xy) for i, xy in enumerate(spread(30, 0.001) + odd)]
    p = spark.createDataFrame([*points, (1000, 0, None, 1.0), (1001, 9, 1.0, 1.0)], "id int, g int, x double, y double")
    s = spark.createDataFrame([*sites, (-1, 0, None, 5.0)], "sid int, g int, x double, y double")
    got = {i: (sid, km) for i, sid, km in spatial.nearest(p, s, "g", "id", "sid").collect()}
    assert got.pop(1000) == (-1, None) and set(got) == {q[0] for q in points}
    for i, g, *xy in points:
        km = {q: hav(xy, at) for q, h, *at in sites if h == g}
        assert got[i][1] == pytest.approx(min(km.values()), abs=1e-4) and km[got[i][0]] == pytest.approx(min(km.values()), abs=1e-4)


def test_port_shares_by_nearest_known_node(spark):
    from gridloom.operators import sectors

    ports = spark.createDataFrame([(1, "A", 179.9, 0.0, 3.0), (2, "A", 0.0, 50.0, 1.0), (3, "B", 5.0, 5.0, 2.0)], "port int, ct string, x double, y double, outflow double")
    nodes = spark.createDataFrame([(7, "A", -179.9, 0.0), (8, "A", 0.0, 51.0), (6, "A", None, 0.0), (9, "B", 0.0, 0.0)], "node int, ct string, x double, y double")
    assert rows(sectors.port_shares(ports, nodes, "ct"), "ct", "node", "share") == [("A", 7, 0.75), ("A", 8, 0.25), ("B", 9, 1.0)]


def test_port_shares_of_one_port_in_two_countries(spark):
    from gridloom.operators import sectors

    ports = spark.createDataFrame([(1, "A", 0.0, 0.0, 2.0), (1, "B", 5.0, 5.0, 1.0), (None, "B", 5.0, 5.0, 1.0), (3, "B", None, 0.0, 2.0)], "port int, ct string, x double, y double, outflow double")
    nodes = spark.createDataFrame([(7, "A", 0.0, 1.0), (8, "B", 5.0, 6.0), (6, "B", 80.0, 0.0)], "node int, ct string, x double, y double")
    assert rows(sectors.port_shares(ports, nodes, "ct"), "ct", "node", "share") == [("A", 7, 1.0), ("B", 6, 0.5), ("B", 8, 0.5)]
