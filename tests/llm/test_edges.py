"""Nulls, empty and long texts, ties, repeated rows, empty tables and clashing columns."""

import random

import pytest
from pyspark.sql import functions as F

from gridloom.llm import ctw, jaccard_rtree, license_digest, lsa_decontam, mixing, pii_bootstrap, rp_forest, suffix_dedup, toxicity_fm, warc_index

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size long, h string, key string, block int, id long, items string, component string"


def _docs(spark, rows):
    return spark.createDataFrame([(i, t, "en", s, len(t or ""), 7, "x", "y", 3, 5, "z", "c") for i, t, s in rows], SCHEMA)


LONG = " ".join(f"w{random.Random(3).randint(0, 9)}{k}" for k in range(30000))
ROWS = [
    (1, None, "a"), (2, "", "a"), (3, "   \n\t", None), (4, "one", "b"), (5, "one", "b"), (5, "one", "b"), (None, "no id here at all", None), (None, None, "a"), (6, LONG, "b"), (7, LONG, "c"),
    (8, "mail x@y.org from 10.0.0.1 now", "c"), (8, "the same id, another text", "c"), (9, "ÄÖ é 漢字 😀 " * 30, "c"), (10, "aaaa" * 5000, "c"), (11, "SPDX-License-Identifier: MIT", "a"),
]


@pytest.fixture(scope="module")
def docs(spark):
    return _docs(spark, ROWS)


@pytest.fixture(scope="module")
def none(spark):
    return _docs(spark, []).where("false")


def labels(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, quality int, toxic int")


LABELS = [(1, 0, 0), (4, 1, 1), (4, 1, 0), (5, 0, None), (None, 1, 1), (8, 0, 0), (9, 1, 0)]


def test_ctw(spark, docs, none):
    got = ctw.score(docs)
    r = got.collect()
    assert len(r) == len(ROWS) and all(x["score"] <= 0 and x["n_tokens"] >= 1 for x in r)
    by = [x for x in r if x["doc_id"] in (1, 2)]
    assert len({x["score"] for x in by}) == 1 and all(x["n_tokens"] == 1 and x["n_bytes"] == 0 for x in by)
    assert ctw.score(none).count() == 0


def test_ctw_probabilities_sum_to_one(spark):
    """Over all next bytes the frozen tree's probabilities sum to one, seen context or not."""
    import numpy as np

    rng = np.random.default_rng(1)
    code = rng.integers(97, 101, (400, ctw.DEPTH + 1)).astype(np.uint64)
    key = np.zeros(400, np.uint64)
    for c in range(ctw.DEPTH + 1):
        key = (key << np.uint64(8)) | code[:, c]
    key, cnt = np.unique(key, return_counts=True)
    ctx = key[5] >> np.uint64(8)
    every = np.union1d(key, (ctx << np.uint64(8)) | np.arange(256, dtype=np.uint64))
    full = np.zeros(len(every), np.int64)
    full[np.searchsorted(every, key)] = cnt
    a, b, lw = np.zeros((256, 256)), np.zeros((256, 256)), np.zeros((256, 256))
    rows = []
    for j in range(8):
        s = ctw.Subtree(every, full, j)
        for k, x, y, w in zip(s.key.tolist(), s.a, s.b, s.lw):
            a[k >> 16, k & 255] += x
            b[k >> 16, k & 255] += y
            lw[k >> 16, k & 255] += w
    rows = [{"near": n, "pid": p, "a": a[n, p], "b": b[n, p], "lw": lw[n, p]} for n in range(256) for p in range(256) if a[n, p] + b[n, p] > 0 or lw[n, p]]
    p = 10 ** ctw.log_probs(every, full, ctw.Top(rows))
    assert abs(p[(every >> np.uint64(8)) == ctx].sum() - 1) < 1e-9


def test_decontam(spark, docs, none):
    item = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi"
    items = spark.createDataFrame([(1, item), (2, None), (3, ""), (None, item), (4, item), (5, "one two")], "item_id long, text string")
    extra = _docs(spark, [(20, LONG + " " + item.upper(), "a"), (21, item.replace("eta theta", "ETA, (theta)"), "a"), (22, item.replace("delta ", "").replace(" mu", " mew"), "a"), (23, "say one two now", "b"), (24, "one and two", "b")])
    got = {r["doc_id"]: r["items"] for r in lsa_decontam.decontaminate(docs.unionByName(extra), items).collect() if r["doc_id"] is not None}
    assert got[20] == got[21] == got[22] == [1, 4]
    assert got[23] == [5] and got[24] == [] and got[1] == got[2] == got[6] == []
    assert lsa_decontam.decontaminate(none, items).count() == 0
    assert lsa_decontam.decontaminate(docs, items.where("false")).where("size(items) > 0").count() == 0


def test_forest(spark):
    rows = [(1, [1.0, 0.0]), (2, [1.0, 0.0]), (3, [1.0, 0.0]), (4, None), (5, [0.0, 0.0]), (6, [float("nan"), 1.0]), (7, [1.0]), (8, [None, 1.0]), (20, [1.0, 0.0]), (20, [1.0, 0.0]), (9, [float("inf"), 0.0]), (10, [-1.0, 0.5]), (None, [1.0, 0.0])]
    v = spark.createDataFrame([(*r, 1.0, "x") for r in rows], "vec_id long, embedding array<float>, score double, cell string")
    got = [tuple(r) for r in rp_forest.search(v, F.col("vec_id") % 20 == 0).orderBy("rank").collect()]
    assert got == [(20, 1, 1, 1.0), (20, 2, 2, 1.0), (20, 3, 3, 1.0), (20, 4, 10, -1.0)]
    assert rp_forest.search(v.where("false"), F.col("vec_id") % 20 == 0).count() == 0


def test_licences(spark, docs, none):
    mit = license_digest.KNOWN["MIT"].replace("Copyright (c) 2020 A", "COPYRIGHT © 1999, Somebody Else").replace("license", "licence").upper()
    more = _docs(spark, [(30, mit, "a"), (31, mit + " more", "a")])
    got = {r["doc_id"]: r["license_id"] for r in license_digest.scan(docs.unionByName(more)).collect()}
    assert got[30] == "MIT" and got[31] is None and got[11] == "SPDX-MIT" and got[1] is None and got[2] is None
    for t in [x[1] for x in ROWS if x[1] is not LONG] + [mit]:
        assert license_digest.digest_py(t) == spark.range(1).select(F.sha2(license_digest.canonical(F.lit(t).cast("string")), 256)).first()[0]
    assert license_digest.scan(none).count() == 0


def test_pii(spark, docs, none):
    got = pii_bootstrap.report(pii_bootstrap.extract(docs)).collect()
    assert len(got) == len(ROWS)
    assert [r["spans"] for r in got if r["n_email"]] == ["email:5:12,ip:18:26"]
    assert pii_bootstrap.extract(none).count() == 0
    clean = {(r["doc_id"], r["text"]) for r in pii_bootstrap.redact(docs).collect()}
    assert (8, "mail [EMAIL] from [IP] now") in clean and (1, None) in clean and pii_bootstrap.redact(docs).columns == docs.columns


def test_pii_bootstrap_discovers(spark):
    """Numbers after a context that only phone numbers follow are found without a plus sign."""
    known = [(i, f"please dial +1 (555) {100 + i}-4{i:03d} today", "a") for i in range(30)]
    new = [(100, "please dial (555) 777-8888 today", "a"), (101, "part number (555) 777-9999 here", "a")]
    got = {r["doc_id"]: r["spans"] for r in pii_bootstrap.report(pii_bootstrap.extract(_docs(spark, known + new))).collect()}
    assert got[100] == "phone:12:26" and got[101] == ""


def test_toxicity(spark, docs, none):
    lab = labels(spark, LABELS)
    r = toxicity_fm.report(docs, lab).collect()
    assert len(r) == len(ROWS) and all(0 <= x["score"] <= 1 for x in r)
    assert toxicity_fm.report(none, lab).count() == 0
    assert toxicity_fm.report(docs, lab.where("false")).count() == len(ROWS)


def test_toxicity_learns_interaction(spark):
    """Toxic only if an insult meets a group; each alone is harmless."""
    rng = random.Random(0)
    rows, lab = [], []
    for i in range(1200):
        a, b = rng.random() < 0.5, rng.random() < 0.5
        w = [f"f{rng.randint(0, 40)}" for _ in range(12)] + ["insult"] * a + ["group"] * b
        rng.shuffle(w)
        rows.append((i, " ".join(w), "s"))
        lab.append((i, 0, int(a and b)))
    got = toxicity_fm.report(_docs(spark, rows), labels(spark, lab)).where("held_out").collect()
    truth = {i: y for i, _, y in lab}
    assert sum(r["predicted"] == truth[r["doc_id"]] for r in got) / len(got) > 0.97


def test_mix(spark, docs, none):
    r = mixing.mix(docs, keep=["doc_id"]).collect()
    assert len(r) == len(ROWS) and all(0 <= x["taken"] <= 2 * x["size"] for x in r)
    by = {}
    for x in r:
        by.setdefault((x["target"], x["source_size"]), []).append(x["taken"])
    assert all(abs(sum(t) - k[0]) <= 1 for k, t in by.items() if k[1])
    assert mixing.mix(none, keep=["doc_id"]).count() == 0


def test_long_texts_make_blocks_of_fewer(spark, monkeypatch):
    words = [f"w{k}" for k in range(400)]
    near = spark.createDataFrame([(i, " ".join(words[:-1] + [f"end{i}"])) for i in range(40)], "doc_id long, text string")
    monkeypatch.setattr(jaccard_rtree, "BULK", 2000)
    families = spark.createDataFrame([(i, 0, 396) for i in range(40)], "id long, component long, n long")
    tasks = jaccard_rtree.tasks_of(families, [1, 100, 1000]).groupBy("kind", "band", "lo", "hi").agg(F.count("*").alias("m"))
    assert tasks.agg(F.max("m")).first()[0] < 40  # not the whole family in one task
    assert {r["component_id"] for r in jaccard_rtree.join(near).collect()} == {0}


def test_jaccard(spark, docs, none):
    got = sorted((str(r["doc_id"]), r["n_shingles"], r["component_id"]) for r in jaccard_rtree.join(docs, k=3, num=90, den=100).collect())
    d = {k: (n, c) for k, n, c in got}
    assert d["1"] == (0, 1) and d["2"] == (0, 2) and d["3"] == (0, 3) and d["4"] == (1, 4) and d["5"] == (1, 4) and d["7"] == (d["6"][0], 6) and d["None"][1] is None
    assert jaccard_rtree.join(none).count() == 0


def test_suffix(spark, docs, none):
    got = {(r["doc_id"], r["n_bytes"]): r for r in suffix_dedup.dedup(docs).collect()}
    n = len(LONG)
    assert got[6, n]["n_removed"] == 0 and got[7, n]["n_removed"] == n and got[7, n]["n_spans"] == 1
    assert got[10, 20000]["n_removed"] == 20000 - 1 and got[1, 0]["n_spans"] == 0
    assert suffix_dedup.dedup(none).count() == 0


def test_warc(spark):
    big = "<p>x</p>" * 400
    rows = [(1, "http://b.example.com/1", big), (2, "http://a.example.com/?q=ü", big), (3, None, big), (4, "http://a.example.com:8080/x", "short"), (5, "not a url", "short"), (6, "http://[bad", None), (6, "http://[bad", None), (None, "http://z.org", big)]
    pages = spark.createDataFrame([(*r, "k", 1) for r in rows], "page_id long, url string, html string, key string, h int")
    got = sorted((tuple(r) for r in warc_index.archive(pages).collect()), key=str)
    kinds = {(r[0], r[3], r[4]) for r in got}
    assert len(got) == len(rows)
    assert {(1, "revisit", 3), (2, "revisit", 3), (3, "response", None), (None, "revisit", 3), (4, "response", None), (5, "response", None)} <= kinds
    assert warc_index.archive(pages.where("false")).count() == 0


def test_warc_lookup(spark):
    pages = spark.createDataFrame([(i, f"http://h{i % 7}.example.com/p{i % 50}", f"<p>{i}</p>") for i in range(3000)], "page_id long, url string, html string")
    table, root = warc_index.write(pages, shards=3)
    urls = pages.where("page_id in (11, 49, 2999)").select("url").unionByName(spark.createDataFrame([("http://nowhere.org/",)], "url string"))
    got = sorted(r["page_id"] for r in warc_index.lookup(urls, table, root).collect())
    want = sorted(r["page_id"] for r in pages.join(urls, "url", "left_semi").collect())
    assert got == want


def test_forest_scores_each_visited_pair_once_and_exactly():
    import numpy as np

    rng = np.random.default_rng(2)
    x = rng.normal(size=(600, 9)) * 10.0 ** rng.integers(-3, 3, (600, 1))
    q, qid, xid = x[:50], np.arange(50), np.arange(600)
    f = rp_forest.Forest(x, 3, 5)
    leaves = f.leaves(x)
    sizes = np.stack([np.bincount(leaves[:, t], minlength=32) for t in range(3)])
    stop = f.stop(q, sizes, 0.7 * len(x))
    seen = np.zeros((3, 50, 600), bool)
    for t in range(3):
        seen[t] = (f.priorities(q, t) <= stop[:, None])[:, leaves[:, t]]
    exact = (q[:, None] * x[None]).sum(2)
    bound = np.sort(exact, 1)[:, -60]
    bound[:5] = -np.inf
    got = [(r, i, s) for t in range(3) for part in rp_forest._nearest(f, t, q, qid, stop, bound, x, xid, leaves) for r, i, s in zip(*part)]
    want = {(r, i): exact[r, i] for r, i in zip(*np.nonzero(seen.any(0) & (exact >= bound[:, None]))) if r != i}
    assert len(got) == len(want) and {(r, i): s for r, i, s in got} == want


def test_components_drop_what_their_edges_came_from(spark, monkeypatch):
    from gridloom.llm import common

    calls = []
    monkeypatch.setattr(common, "tidy", calls.append)
    edges = spark.createDataFrame([(i + 1, i) for i in range(40)] + [(101, 100)], "a long, b long")
    got = {r["id"]: r["component"] for r in common.connected_components(edges).collect()}
    assert got == {i: 0 for i in range(41)} | {100: 100, 101: 100} and len(calls) == 2


def test_machine_is_fitted_by_a_task(spark, monkeypatch):
    """The sample's rows do not come to the driver."""
    rows = [(i, "good words here" if i % 2 else "bad insult there", "s") for i in range(80)]
    lab = spark.createDataFrame([(i, 1, 1 - i % 2) for i in range(80)], "doc_id long, quality int, toxic int")
    sizes = []
    real = type(lab).toArrow
    monkeypatch.setattr(type(lab), "toArrow", lambda self: (sizes.append(self.columns), real(self))[1])
    m = toxicity_fm.train(_docs(spark, rows), lab)
    assert sizes == [["bucket", "n", "toxic"]] and abs(m.w).max() > 0


def test_freed_native_memory_of_the_driver_goes_back(spark):
    """What the C library keeps of freed pieces: they lie below one that is still in use."""
    import re
    from pathlib import Path

    from gridloom.llm import common

    jvm = spark.sparkContext._jvm
    status = Path(f"/proc/{jvm.java.lang.ProcessHandle.current().pid()}/smaps_rollup")
    if not status.exists() or not common.trim(spark):
        pytest.skip("no such figures, or a JVM that cannot trim")
    held = lambda: int(re.search(r"\nAnonymous:\s+(\d+)", status.read_text())[1]) >> 10
    field = jvm.java.lang.Class.forName("sun.misc.Unsafe").getDeclaredField("theUnsafe")
    field.setAccessible(True)
    unsafe = field.get(None)
    at = [unsafe.allocateMemory(1 << 16) for _ in range(2400)]
    for a in at:
        unsafe.setMemory(a, 1 << 16, 1)
    for a in at[:-1]:
        unsafe.freeMemory(a)
    jvm.System.gc()
    before = held()
    assert common.materialise(spark.range(10)).count() == 10
    after = held()
    unsafe.freeMemory(at[-1])
    assert after < before - 75  # of 150


def test_jaccard_common_passage_joins_no_families(spark, monkeypatch):
    """A passage that all documents repeat: families are the near copies alone, and no link is lost."""
    import random

    from pyspark.sql import functions as F

    rng = random.Random(3)
    passage = [f"p{i}" for i in range(40)]
    docs = []
    for f in range(150):
        base = [f"d{f}w{i}" for i in range(rng.choice([140, 145, 150]))]
        base[10:10] = passage
        for c in range(2 if f % 5 == 0 else 1):
            docs.append((len(docs), " ".join(base[: len(base) - c])))
    sizes = []
    plain = jaccard_rtree.tasks_of
    monkeypatch.setattr(jaccard_rtree, "tasks_of", lambda fam, low: sizes.extend(r["count"] for r in fam.groupBy("component").count().collect()) or plain(fam, low))
    df = spark.createDataFrame(docs, "doc_id long, text string")
    got = jaccard_rtree.join(df).groupBy("component_id").agg(F.count("*").alias("m")).where("m > 1")
    assert got.count() == 30 and max(sizes) < 20


def test_jaccard_common_signatures(spark):
    """Each document passes over its most common signatures only as far as all its texts may."""
    rows = [(a, None, s, m, v) for a, s, m, v in (
        (1, 7, 9, 2), (1, 8, 6, 2), (2, 7, 9, 2), (2, 8, 6, 2), (3, 7, 9, 0), (4, 7, 9, 0),  # 1 and 2 pass over 7
        (5, 8, 6, 4), (5, 9, 5, 0),  # two texts: the lesser reserve holds
        (6, 7, 9, 3), (6, 8, 6, 2),  # bands apart
    )]
    met = spark.createDataFrame(rows, jaccard_rtree.MET)
    assert sorted(tuple(r) for r in jaccard_rtree.common_edges(met).collect()) == [(2, 1), (4, 3), (5, 1)]
