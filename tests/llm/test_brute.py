"""The operators' queries against brute force on the smallest tables."""

import hashlib
import math
import os
import re
import zlib
from collections import Counter

import duckdb
import numpy as np
import pandas as pd
import pytest

import corpus_pipeline
from gridloom.llm import lsa_decontam, mixing, queries, toxicity_fm

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def table(name, cols):
    return duckdb.sql(f"select {cols} from read_parquet('{SF}/{name}.parquet')").fetchall()


@pytest.fixture(scope="module")
def docs():
    return sorted((i, t or "") for i, t in table("documents", "doc_id, text"))


def by_id(df, key="doc_id"):
    return {r[key]: r for r in df.collect()}


def test_ctw_base_and_score(spark, docs):
    got = by_id(queries.op1_ctw(spark, SF))
    toks = {i: WORD.findall(t.translate(LOWER)) + [None] for i, t in docs}
    held = {i: zlib.crc32(str(i).encode()) % 7 == 2 for i in toks}
    count = Counter(w for i, ws in toks.items() if not held[i] for w in ws)
    n, v = sum(count.values()), len(count)
    for i, ws in toks.items():
        r = got[i]
        assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == (held[i], len(ws), sum(count[w] > 0 for w in ws), n)
        assert math.isclose(r["base_score"], sum(math.log10((count[w] + 1) / (n + v + 1)) for w in ws), rel_tol=1e-9)
    # Better than a uniform byte by far, on texts it has not seen.
    bits = [r["bits_per_byte"] for r in got.values() if r["held_out"] and r["n_bytes"] > 200]
    assert np.median(bits) < 3.2


def kt_tree(train, depth):
    """A plain context tree over bits: {(prefix, context): [zeros, ones]} of every depth, and a
    function that gives the log10 probability of a byte string by the frozen, mixed tree."""
    count = {}

    def walk(text):
        data = bytes([0xFF] * depth) + text.translate(LOWER).encode() + b"\xff"
        for p in range(depth, len(data)):
            ctx, prefix = data[p - depth : p], 1
            for j in range(8):
                bit = data[p] >> (7 - j) & 1
                yield prefix, ctx, bit
                prefix = prefix << 1 | bit

    for t in train:
        for prefix, ctx, bit in walk(t):
            for d in range(depth + 1):
                count.setdefault((prefix, ctx[depth - d :]), [0, 0])[bit] += 1
    kids, weight = {}, {}
    for prefix, ctx in count:
        if ctx:
            kids.setdefault((prefix, ctx[1:]), []).append((prefix, ctx))

    def log_kt(a, b):
        return math.lgamma(a + 0.5) + math.lgamma(b + 0.5) - math.lgamma(a + b + 1) - math.log(math.pi)

    lw = {}
    for node in sorted(count, key=lambda n: -len(n[1])):
        own = log_kt(*count[node])
        if len(node[1]) == depth:
            lw[node], weight[node] = own, 1.0
        else:
            below = sum(lw[k] for k in kids[node])
            top = max(own, below)
            lw[node] = top + math.log(0.5 * math.exp(own - top) + 0.5 * math.exp(below - top))
            weight[node] = math.exp(own - math.log(2) - lw[node])

    def prob(text):
        total = 0.0
        for prefix, ctx, bit in walk(text):
            p = 0.5
            for d in range(depth, -1, -1):
                node = (prefix, ctx[depth - d :])
                if node in count:
                    a = count[node]
                    kt = (a[bit] + 0.5) / (a[0] + a[1] + 1)
                    p = weight[node] * kt + (1 - weight[node]) * p
            total += math.log10(p)
        return total

    return prob


def test_ctw_score_by_dictionary(spark, docs, monkeypatch):
    """Scores of a few texts, learned and held out, against a tree of dictionaries; in one block and in several."""
    from gridloom.llm import ctw

    few = [(i, t[:400]) for i, t in docs if t][:24] + [(9001, ""), (9002, "AbC ü"), (9003, "never seen \u6f22")]
    held = {i: zlib.crc32(str(i).encode()) % 7 == 2 for i, _ in few}
    prob = kt_tree([t for i, t in few if not held[i]], ctw.DEPTH)
    df = spark.createDataFrame(few, "doc_id long, text string")
    for size in (ctw.BLOCK_BYTES, 3000):
        monkeypatch.setattr(ctw, "BLOCK_BYTES", size)
        got = by_id(ctw.score(df))
        assert all(math.isclose(got[i]["score"], prob(t), rel_tol=1e-7, abs_tol=1e-7) for i, t in few)


def test_decontam_by_all_pairs(spark):
    """Candidates against the longest common subsequence of every item with every context of every
    passage: verbatim, stretched, cut, shuffled and frequent items."""
    import random

    rng = random.Random(4)
    word = lambda: "".join(rng.choices("abcdefghij", k=4))
    items = [[word() for _ in range(n)] for n in (9, 20, 24, 40, 60, 90)]
    docs = []
    for i in range(60):
        w = [word() for _ in range(rng.choice([30, 120, 400]))]
        for _ in range(rng.choice([0, 1, 1])):
            own = list(rng.choice(items))
            kind = rng.randrange(4)
            own = {0: own, 1: [x for y in own for x in (y, word())], 2: [x for x in own if rng.random() < 0.85], 3: rng.sample(own, len(own))}[kind]
            at = rng.randrange(len(w))
            w[at:at] = own
        docs.append((i, " ".join(w)))
    got = by_id(lsa_decontam.decontaminate(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame([(k, " ".join(w)) for k, w in enumerate(items)], "item_id long, text string")))
    step, wide = lsa_decontam.STEP_WORDS, lsa_decontam.STEP_WORDS * lsa_decontam.BLOCKS
    sure = 0
    for i, t in docs:
        w, want = t.split(), {}
        for k, item in enumerate(items):
            slack = lsa_decontam.STRETCH * len(item)
            spans = {(max(a - slack, 0), min(a + wide + slack, len(w))) for a in range(0, max(1, len(w) - wide + step), step)}
            want[k] = max(lsa_decontam.lcs(item, w[a:z]) / len(item) for a, z in spans)
        hits = {k for k, v in want.items() if v >= 0.8}
        maybe = {k for k, v in want.items() if v >= 0.6}
        assert hits <= set(got[i]["items"]) <= maybe, (i, hits, got[i]["items"], maybe)
        sure += len(hits)
    assert sure >= 15


def test_decontam_finds_planted(spark, docs):
    def fold(t):
        return re.findall(r"[a-z0-9\x80-\U0010ffff]+", t.lower())

    items = {i: fold(t) for i, t in table("benchmark", "item_id, text")}
    grams = {}
    for i, w in items.items():
        for k in range(len(w) - 7):
            grams.setdefault(tuple(w[k : k + 8]), set()).add(i)
    got = by_id(queries.op2_lsa_decontam(spark, SF))
    for d, t in docs:
        w, hits = fold(t), Counter()
        for k in range(len(w) - 7):
            hits.update(grams.get(tuple(w[k : k + 8]), ()))
        sure = {i for i, c in hits.items() if c >= 0.8 * (len(items[i]) - 7)}
        assert sure <= set(got[d]["items"]) <= set(hits) | sure


def test_lcs_by_dynamic_programming():
    rng = np.random.default_rng(0)
    for _ in range(200):
        a, b = rng.integers(0, 6, rng.integers(0, 30)).tolist(), rng.integers(0, 6, rng.integers(0, 30)).tolist()
        d = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                d[i + 1][j + 1] = d[i][j] + 1 if x == y else max(d[i][j + 1], d[i + 1][j])
        assert lsa_decontam.lcs(a, b) == d[-1][-1]


def test_forest_recall(spark):
    rows = table("embeddings", "vec_id, embedding")
    ids, x = np.array([r[0] for r in rows]), np.array([r[1] for r in rows], np.float64)
    got = {}
    for r in queries.op3_rp_forest(spark, SF).collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    right = total = 0
    for q in np.flatnonzero(ids % 20 == 0):
        s = x @ x[q]
        s[q] = -np.inf
        best = set(ids[np.lexsort((ids, -s))[:20]].tolist())
        mine = sorted(got[int(ids[q])])
        assert [m[0] for m in mine] == list(range(1, 21)) and all(a[2] >= b[2] for a, b in zip(mine, mine[1:]))
        assert all(math.isclose(m[2], float(x[np.flatnonzero(ids == m[1])[0]] @ x[q]), rel_tol=1e-9) for m in mine)
        right, total = right + len(best & {m[1] for m in mine}), total + 20
    assert right / total >= 0.9


def test_forest_recall_by_share(spark):
    """12,000 vectors without structure, where the queue ends by its share alone."""
    from pyspark.sql import functions as F

    from gridloom.llm import rp_forest

    x = np.random.default_rng(3).normal(size=(12000, 24)).astype(np.float32)
    v = spark.createDataFrame([(i, row) for i, row in enumerate(x.tolist())], "vec_id long, embedding array<float>")
    got = {}
    for r in rp_forest.search(v, F.col("vec_id") % 100 == 0).collect():
        got.setdefault(r["query_id"], set()).add(r["vec_id"])
    x = x.astype(np.float64)
    right = 0
    for q in range(0, len(x), 100):
        s = x @ x[q]
        s[q] = -np.inf
        right += len(got[q] & set(np.argsort(-s)[:20].tolist()))
    assert right / (20 * len(got)) >= 0.9 and len(got) == 120


def test_machine_by_plain_sums():
    """Scores and one epoch's steps against the formula, pair by pair and term by term."""
    rng = np.random.default_rng(0)
    x = rng.random(32)
    x[:4] = 0
    m, plain = toxicity_fm.Machine(x, 3), toxicity_fm.Machine(x, 3)
    docs = [sorted(rng.choice(32, rng.integers(0, 9), replace=False).tolist()) for _ in range(40)]
    y = rng.integers(0, 2, 40).astype(float)
    size = np.array([len(d) for d in docs])
    term = np.array([t for d in docs for t in d], np.int32)

    def score(k, d):
        return k.w0 + sum(float(k.w[t]) * x[t] for t in d) + sum(float(k.v[a] @ k.v[b]) * x[a] * x[b] for i, a in enumerate(d) for b in d[i + 1 :])

    steps = toxicity_fm.minibatches(np.cumsum(size) - size, size, term, y, batch=16)
    m.fit(steps, 0.5, epochs=1)
    order, turn = np.random.default_rng(1).permutation(40), np.random.default_rng(1).permutation(len(steps))
    gw, gv, g0 = np.full(32, 1e-8), np.full((32, 3), 1e-8), 1e-8
    for k in turn:
        rows = order[16 * k : 16 * k + 16]
        err = [(1 / (1 + math.exp(-score(plain, docs[r]))) - y[r]) / len(rows) for r in rows]
        dw, dv, used = np.zeros(32), np.zeros((32, 3)), sorted({t for r in rows for t in docs[r]})
        for e, r in zip(err, rows):
            for t in docs[r]:
                dw[t] += e * x[t]
                dv[t] += e * x[t] * sum((plain.v[u] * x[u] for u in docs[r] if u != t), np.zeros(3))
        for t in used:
            a, b = dw[t] + 1e-4 * plain.w[t], dv[t] + 1e-4 * plain.v[t]
            gw[t], gv[t] = gw[t] + a**2, gv[t] + b**2
            plain.w[t] -= 0.1 * a / math.sqrt(gw[t])
            plain.v[t] -= 0.1 * b / np.sqrt(gv[t])
        g0 += sum(err) ** 2
        plain.w0 -= 0.1 * sum(err) / math.sqrt(g0)
    assert np.allclose(m.w, plain.w, atol=1e-3) and np.allclose(m.v, plain.v, atol=1e-3) and math.isclose(m.w0, plain.w0, abs_tol=1e-3)
    z = m.raw(np.r_[0, np.cumsum(size)], term)[0]
    assert np.allclose(z, [score(m, d) for d in docs], atol=1e-4)


def test_pii_spans_by_plain_graph(spark):
    """Discovered spans against the same graph walked in Python, a chain of rounds included."""
    from gridloom.llm import pii_bootstrap as P

    mails = [f"user{i}@site{i}.org" for i in range(8)]
    texts = [f"please write to {x} soon" for x in [*mails, "name_0"]]
    for k in range(1, 6):  # the k-th word is accepted once the name before is known, and then gives the next name
        texts += [f"say word{'abcdef'[k]} {x} soon" for x in [*mails[:4], f"name_{k - 1}", f"name_{k}"]]
    texts += ["say name_5 again", "item no_such_thing here", "address 10.0.0.1 up"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = {r["doc_id"]: r for r in P.extract(df).collect()}
    seen = {(p, x["v"]) for r in found.values() for x in r["base"] for p in {x["l"], f"{x['l']} _ {x['r']}"}}
    known = {x["v"]: x["kind"] for r in found.values() for x in r["base"]}
    # Candidates of these texts are their tokens with a digit, @, _ or an inner dot.
    for t in texts:
        w = t.split()
        for k, x in enumerate(w):
            if re.search(r"[0-9@_]|\.[A-Za-z]", x) and x not in known:
                seen |= {(w[k - 1], x), (f"{w[k - 1]} _ {w[k + 1]}", x)}
    new, rounds = {}, 0
    while True:
        good = {}
        for p in {p for p, _ in seen}:
            own = [known.get(v) for q, v in seen if q == p]
            for kind in set(own) - {None}:
                if own.count(kind) >= 5 and own.count(kind) / len(own) >= 0.8:
                    good.setdefault(p, []).append((kind, min(own.count(kind) / len(own), 0.999)))
        score = {}
        for p, v in seen:
            if v not in known:
                for kind, c in good.get(p, ()):
                    score[v, kind] = score.get((v, kind), 1.0) * (1 - c)
        fresh = {}
        for (v, kind), miss in sorted(score.items()):
            if 1 - miss >= 0.9 and (v not in fresh or 1 - miss > fresh[v][0]):
                fresh[v] = (1 - miss, kind)
        if not fresh:
            break
        rounds += 1
        new |= {v: k for v, (_, k) in fresh.items()}
        known |= {v: k for v, (_, k) in fresh.items()}
    want = {i: sorted((new[x], x) for x in t.split() if x in new) for i, t in enumerate(texts)}
    assert {i: sorted((x["kind"], x["v"]) for x in r["more"]) for i, r in found.items()} == want
    assert rounds >= 4 and (0, "name_5") in want[len(texts) - 3] and not want[len(texts) - 2]


def test_pii_base(spark, docs):
    kinds = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}

    def luhn(d):
        return sum(n if k % 2 == 0 else (2 * n - 9 * (n > 4)) for k, n in enumerate(map(int, reversed(d)))) % 10 == 0

    got = by_id(queries.op5_pii_bootstrap(spark, SF))
    for i, t in docs:
        spans, counts = [], []
        for k, p in kinds.items():
            own = []
            for m in re.finditer(p, t):
                v, d = m.group(), re.sub("[^0-9]", "", m.group())
                ok = {"email": True, "ip": k != "ip" or all(int(x) <= 255 for x in v.split(".")), "card": 13 <= len(d) <= 19 and luhn(d), "phone": 9 <= len(d) <= 15}[k]
                if ok:
                    own.append(f"{k}:{m.start()}:{m.end()}")
            spans += own
            counts.append(len(own))
        r = got[i]
        assert [r["n_email"], r["n_ip"], r["n_card"], r["n_phone"]] == counts
        assert r["base_sha256"] == hashlib.sha256(",".join(spans).encode()).hexdigest()
        assert set(spans) <= set(r["spans"].split(",")) | {""}


def sets(docs, k):
    out = {}
    for i, t in docs:
        w = WORD.findall(t.translate(LOWER))
        out[i] = {tuple(w[j : j + k]) for j in range(max(1, len(w) - k + 1))} if w else set()
    return out


def components(s, num, den):
    up = {i: i for i in s}

    def find(x):
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    ids = sorted(s)
    for n, i in enumerate(ids):
        for j in ids[n + 1 :]:
            a, b = s[i], s[j]
            if a and b and min(len(a), len(b)) * den >= max(len(a), len(b)) * num:
                both = len(a & b)
                if both * den >= num * (len(a) + len(b) - both):
                    x, y = find(i), find(j)
                    up[max(x, y)] = min(x, y)
    return {i: find(i) for i in s}


def test_jaccard(spark, docs):
    s = sets(docs, 3)
    want = components(s, 90, 100)
    got = by_id(queries.op8_jaccard_rtree(spark, SF))
    assert {i: (r["n_shingles"], r["component_id"]) for i, r in got.items()} == {i: (len(s[i]), want[i]) for i in s}


@pytest.mark.parametrize("block", [2048, 3])
def test_jaccard_near_threshold(spark, monkeypatch, block):
    """Planted families around the threshold, sizes over many bands."""
    import random

    from gridloom.llm import jaccard_rtree

    monkeypatch.setattr(jaccard_rtree, "BLOCK", block)
    rng = random.Random(5)
    docs = []
    for f in range(40):
        base = [f"f{f}w{k}" for k in range(rng.choice([3, 9, 11, 20, 50, 130, 400]))]
        for _ in range(6):
            w = list(base)
            for _ in range(rng.randint(0, max(1, len(w) // 25))):
                w[rng.randrange(len(w))] = f"x{rng.random()}"
            docs.append((len(docs), " ".join(w)))
    grow = [f"g{k}" for k in range(60)]  # a chain over several bands
    docs += [(1000 + m, " ".join(grow[:m])) for m in range(12, 60)]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    for k, num, den in ((3, 90, 100), (5, 8, 10)):
        want = components(sets(docs, k), num, den)
        got = by_id(jaccard_rtree.join(df, k, num, den))
        assert {i: r["component_id"] for i, r in got.items()} == want


def test_suffix(spark, docs):
    got = by_id(queries.op9_suffix_dedup(spark, SF))
    seen = set()
    for i, t in docs:
        b = t.encode()
        gone = bytearray(len(b))
        for p in range(len(b) - 99):
            w = b[p : p + 100]
            if w in seen:
                gone[p : p + 100] = b"\1" * 100
            seen.add(w)
        kept = bytes(x for x, g in zip(b, gone) if not g)
        spans = sum(1 for p in range(len(b)) if gone[p] and (p == 0 or not gone[p - 1]))
        r = got[i]
        assert (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) == (len(b), sum(gone), spans, hashlib.sha256(kept).hexdigest())


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "pages"):
        con.execute(f"create view {t} as select * from read_parquet('{SF}/{t}.parquet')")
    got, want = queries.queries()[name](spark, SF).toPandas(), con.execute(queries.oracle_sql()[name]).df()
    cols = sorted(want.columns)
    assert sorted(got.columns) == cols

    def norm(d):
        return sorted(tuple("" if pd.isna(x) else f"{float(x):.6f}" if isinstance(x, (int, float)) or hasattr(x, "dtype") else str(x) for x in r) for r in d[cols].astype(object).itertuples(index=False))

    assert norm(got) == norm(want)


def test_pipeline_stages(spark, docs):
    """Each stage's decision against brute force on that stage's own input."""
    d = spark.read.parquet(f"{SF}/documents.parquet")
    kept = {}
    for name, stage in corpus_pipeline.STAGES:
        before = d
        d = corpus_pipeline.materialise(stage(spark, d, SF), name)
        if name != "mixture":
            assert d.columns == before.columns
        kept[name] = (by_id(before), by_id(d))
    before, after = kept["toxicity"]
    score = by_id(toxicity_fm.report(spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")))
    assert set(after) == {i for i in before if not score[i]["predicted"]}
    before, after = kept["near_duplicates"]
    comp = components(sets([(i, r["text"] or "") for i, r in before.items()], 5), 8, 10)
    assert set(after) == {i for i in before if comp[i] == i}
    before, after = kept["personal_data"]
    assert set(after) == set(before) and not any(re.search(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", r["text"]) for r in after.values())
    before, after = kept["benchmark_leaks"]
    found = by_id(lsa_decontam.decontaminate(spark.createDataFrame([(i, r["text"]) for i, r in before.items()], "doc_id long, text string"), spark.read.parquet(f"{SF}/benchmark.parquet")))
    assert set(after) == {i for i in before if not found[i]["items"]}
    before, _ = kept["mixture"]
    taken = {r["doc_id"]: r for r in mixing.mix(spark.createDataFrame([(i, r["text"], r["source"]) for i, r in before.items()], "doc_id long, text string, source string"), keep=["doc_id"]).collect()}
    have = {}
    for r in d.collect():
        assert len(WORD.findall(r["text"])) == r["taken"] and before[r["doc_id"]]["text"].startswith(r["text"])
        have[r["doc_id"]] = have.get(r["doc_id"], 0) + r["taken"]
    assert have == {i: r["taken"] for i, r in taken.items() if r["taken"]}


def test_pipeline_edges(spark):
    """Nulls, empty texts, repeated rows, clashing columns and an empty table through every stage."""
    text = " ".join(f"word{k}" for k in range(40))
    rows = [(1, None, "en", "a", 0, "x"), (2, "", "en", None, 0, "x"), (3, text, "en", "a", 9, "x"), (3, text, "en", "a", 9, "x"), (4, text, "en", "b", 9, "x"), (None, "alone here", None, "b", None, "x"), (5, "mail a@b.org", "en", "b", 3, "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, score string").withColumnRenamed("score", "component_id")
    for name, stage in corpus_pipeline.STAGES:
        before = docs
        docs = corpus_pipeline.materialise(stage(spark, docs, SF), name)
        empty = stage(spark, before.where("false"), SF)
        assert empty.count() == 0, name
        if name == "near_duplicates":
            assert sorted(str(r["doc_id"]) for r in docs.collect()) == ["1", "2", "3", "5", "None"]
        if name == "personal_data":
            assert {(r["doc_id"], r["text"], r["n_chars"]) for r in docs.collect() if r["doc_id"] in (1, 2, 5)} == {(1, None, None), (2, "", 0), (5, "mail [EMAIL]", 12)}
    assert {r["doc_id"] for r in docs.collect()} <= {3, None, 5}
