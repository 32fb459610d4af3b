"""Sources and sinks with irregular heads and geometry, and the base network's loaders."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridloom.operators import base_network, temporal
from gridloom.plans.queries import QUERIES
from gridloom.sources import readers

SF = "/root/testdata/sf0.001"


def test_table_with_two_header_rows(spark, tmp_path):
    (tmp_path / "a.csv").write_text("junk line\n,2030,,2040\ncountry ,min,max,min\n# a remark\nDE , 1,--,3\nFR,,5 ,n/a\n")
    d = readers.read_table(spark, str(tmp_path / "a.csv"), skip=1, header=2, na=("", "--", "n/a"), comment="#")
    assert d.columns == ["country", "2030|min", "2030|max", "2040|min"]
    assert sorted(tuple(r) for r in d.collect()) == [("DE", "1", None, "3"), ("FR", None, "5", None)]


def test_table_with_pattern_separator(spark, tmp_path):
    (tmp_path / "b.txt").write_text("k   v\na    1\nb\t2\n")
    assert sorted(tuple(r) for r in readers.read_table(spark, str(tmp_path / "b.txt"), sep=r"\s+").collect()) == [("a", "1"), ("b", "2")]


def test_geojson_round_trip(spark, tmp_path):
    d = spark.createDataFrame([("p", 1, "Point", "[1.5,2.0]"), ("q", None, None, None)], "name string, n int, geometry_type string, coordinates string")
    readers.write_geojson(d, str(tmp_path / "g"))
    assert sorted(map(tuple, readers.read_features(spark, str(tmp_path / "g"), "name: string, n: int").collect())) == [("p", 1, "Point", "[1.5,2.0]"), ("q", None, None, None)]


def test_rounded_csv(spark, tmp_path):
    readers.write_rounded(spark.createDataFrame([(1, 2.34567)], "k int, v double"), str(tmp_path / "r"), 2, "csv")
    assert spark.read.csv(str(tmp_path / "r"), header=True).first()["v"] == "2.35"


@pytest.fixture
def buses(spark):
    rows = [("5231", 380.0, "f", "f", 6.9, 45.7, "IT"), ("5232", 380.0, "f", None, 6.8, 45.6, "IT"), ("1", 63.0, "f", "f", 6.8, 45.6, "IT"), ("2", 150.0, "t", "f", 6.8, 45.6, "IT"), ("3", None, "f", "t", 6.8, 45.6, "IT"), ("4", 380.0, "f", "f", 60.0, 45.6, "IT"), ("6", 380.0, "f", "f", 6.8, 45.6, "XX")]
    raw = spark.createDataFrame(rows, "bus_id string, voltage double, dc string, under_construction string, x double, y double, country string")
    shape = spark.createDataFrame([("eu", [[0.0, 40.0], [20.0, 40.0], [20.0, 50.0], [0.0, 50.0]])], "region string, ring array<array<double>>")
    return base_network.buses(raw, shape, ["IT", "FR"], 220.0, 750.0)


def test_buses(buses):
    got = {r["bus_id"]: (r["v_nom"], r["carrier"], r["under_construction"]) for r in buses.collect()}
    assert got == {"5231": (380.0, "AC", False), "5232": (380.0, "AC", False), "2": (150.0, "DC", False), "3": (None, "AC", True)}


def test_branches_need_both_ends(spark, buses):
    l = spark.createDataFrame([("a", "5231", "5232", 330.0, 2.0, 1000.0, "f", "t"), ("b", "5231", "9", 380.0, 1.0, 1.0, "f", "f")], "line_id string, bus0 string, bus1 string, voltage double, circuits double, length double, underground string, under_construction string")
    d = base_network.line_parameters(base_network.branches(l, buses, "AC", "line"), {220.0: "t220", 300.0: "t300", 380.0: "t380"}, {"t220": 1.0, "t300": 2.0, "t380": 3.0}, 0.7)
    r = d.collect()
    assert [(x["line_id"], x["length"], x["type"], x["underground"], x["carrier"]) for x in r] == [("a", 1.0, "t300", False, "AC")]
    assert np.isclose(r[0]["s_nom"], 3**0.5 * 2.0 * 330.0 * 2.0)
    assert base_network.under_construction(d, "remove", []).count() == 0 and base_network.under_construction(d, "zero", ["s_nom"]).first()["s_nom"] == 0.0
    c = base_network.converter_parameters(d.select("bus0", "bus1")).first()
    assert (c["p_nom"], c["p_max_pu"], c["p_min_pu"]) == (2000.0, 1.0, -1.0)


def test_slice_copy_needs_its_whole_source(spark):
    import datetime as dt

    t0 = dt.datetime(2024, 1, 1)
    d = spark.createDataFrame([("a", t0 + dt.timedelta(days=i), float(i)) for i in range(6)], "k string, t timestamp_ntz, v double")
    rules = spark.createDataFrame([("a", t0 + dt.timedelta(days=4), t0 + dt.timedelta(days=5))], "k string, start timestamp_ntz, stop timestamp_ntz")
    got = lambda days: [r["v"] for r in temporal.copy_slices(d, ["k"], "t", "v", rules.withColumn("delta", F.expr(f"interval '{days}' day"))).orderBy("t").collect()]
    assert got(2) == [0.0, 1.0, 2.0, 3.0, 2.0, 3.0] and got(5) == [0.0, 1.0, 2.0, 3.0, 4.0, 5.0]


def test_segmentation_by_plain_merging(spark):
    """Neighbouring days merge by the least increase of the squared error until six segments are left."""
    rows = spark.read.parquet(f"{SF}/events.parquet").toPandas()
    rows["t"] = rows["ts"].dt.floor("D")
    got = {}
    for r in QUERIES["segmentation"](spark, SF).collect():
        got.setdefault(r["event_type"], []).append((r["segment"], r["start"], r["length"]))
    for kind, g in rows.groupby("event_type"):
        day = g.groupby("t").agg(v=("value", "mean"), n=("value", "size")).sort_index()
        x = day.to_numpy(float)
        z = x / np.abs(x).max(0)
        parts = [[i] for i in range(len(z))]
        err = lambda p: ((z[p] - z[p].mean(0)) ** 2).sum()
        while len(parts) > 6:
            k = min(range(len(parts) - 1), key=lambda i: err(parts[i] + parts[i + 1]) - err(parts[i]) - err(parts[i + 1]))
            parts[k : k + 2] = [parts[k] + parts[k + 1]]
        want = [(i, day.index[p[0]].to_pydatetime(), len(p)) for i, p in enumerate(parts)]
        assert sorted(got[kind]) == want
