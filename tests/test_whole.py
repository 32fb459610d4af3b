"""Queries that once covered a part of their tables."""

import numpy as np

from gridloom.operators import clustering, spatial
from gridloom.plans.queries import QUERIES

SF = "/root/testdata/sf0.001"


def test_merged_equals_linkage():
    rng = np.random.default_rng(1)
    for n in (0, 1, 2, 30, 60):
        for x in (rng.normal(size=(n, 3)), rng.integers(0, 3, (n, 2)).astype(float)):
            d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(-1))
            for method in ("average", "complete"):
                for t in (0.5, 1.5):
                    assert (clustering.merged(d.copy(), t, method) == clustering.linkage_labels(d, t, method)).all()


def test_hac_clusters_every_vector(spark):
    rows = spark.read.parquet(f"{SF}/embeddings.parquet").select("label", "vec_id", "embedding").collect()
    got = {r["id"]: (r["label"], r["cluster"]) for r in QUERIES["hac_threshold"](spark, SF).collect()}
    assert set(got) == {r["vec_id"] for r in rows}
    for label in {r["label"] for r in rows}:
        own = sorted((r["vec_id"], r["embedding"]) for r in rows if r["label"] == label)
        x = np.array([v for _, v in own], float)
        lab = clustering.linkage_labels(np.sqrt(((x[:, None] - x[None]) ** 2).sum(-1)), 1.35)
        assert {i: got[i] for i, _ in own} == {i: (label, own[k][0]) for (i, _), k in zip(own, lab)}


def test_hac_points_alone(spark):
    d = spark.createDataFrame([(1, 5, [0.0]), (2, 6, [0.0]), (2, 7, [9.0]), (2, 8, None), (2, 9, [9.5])], "label int, vec_id long, embedding array<float>")
    got = {tuple(r) for r in clustering.hac_points(d, "label", "vec_id", "embedding", 1.0).collect()}
    assert got == {(1, 5, 5), (2, 6, 6), (2, 7, 7), (2, 8, 8), (2, 9, 7)}


def test_radius_across_date_line_and_pole(spark):
    rng = np.random.default_rng(2)
    x, y = rng.uniform(-180, 180, 400), np.r_[rng.uniform(-89.9, 89.9, 200), rng.uniform(85, 90, 200)]
    x[:60], y[:60] = np.where(x[:60] < 0, -180, 178) + rng.uniform(0, 2, 60), rng.uniform(-5, 5, 60)
    p = [(i, float(a), float(b)) for i, (a, b) in enumerate(zip(x, y))]
    lon, lat = np.radians(x), np.radians(y)
    h = np.sin((lat[:, None] - lat) / 2) ** 2 + np.cos(lat[:, None]) * np.cos(lat) * np.sin((lon[:, None] - lon) / 2) ** 2
    want = set(zip(*map(np.ndarray.tolist, np.nonzero(2 * 6371.0 * np.arcsin(np.sqrt(h)) <= 300))))
    d = spark.createDataFrame(p, "id long, x double, y double")
    for size in (1.0, 0.7):
        rows = [(r["a_id"], r["b_id"]) for r in spatial.within_radius(d, d, 300.0, size).collect()]
        assert len(rows) == len(set(rows)) and set(rows) == want
