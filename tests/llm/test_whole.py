"""Cases in which an operator once did less than the whole job."""

from __future__ import annotations

import random

from gridloom.llm import ctw, lsa_decontam


def test_frequent_leaks_are_reported(spark):
    rng = random.Random(3)
    word = lambda: "".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=8))
    leak, rare, half = ([word() for _ in range(30)] for _ in range(3))
    half[:20] = leak[:20]  # most of its words are frequent, the others in one document
    rows = []
    for i in range(60):
        w = [word() for _ in range(70)]
        put = leak if i % 3 == 0 else rare if i == 1 else half if i == 2 else []
        rows.append((i, " ".join(w[:25] + put + w[25:])))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    items = spark.createDataFrame([(1, " ".join(leak)), (2, " ".join(rare)), (3, " ".join(half))], "item_id long, text string")
    got = {r["doc_id"]: r["items"] for r in lsa_decontam.decontaminate(docs, items).collect()}
    for i in range(60):
        want = {1} if i % 3 == 0 else {2} if i == 1 else {3} if i == 2 else set()
        assert want <= set(got[i]), (i, got[i])
        assert i % 3 == 0 or i == 2 or set(got[i]) == want
    two = docs.where("doc_id in (0, 3) or doc_id > 4 and doc_id % 3 > 0").limit(14)  # a leak in a few of 20-39 passages
    assert {r["doc_id"] for r in lsa_decontam.decontaminate(two, items).where("array_contains(items, 1)").collect()} == {0, 3}


def test_contexts_of_six_bytes_are_learned(spark):
    """The sixth byte back decides the next one, and the five between never do."""
    rng = random.Random(5)
    rows = []
    for i in range(200):
        first = [rng.choice("xy") for _ in range(200)]
        rows.append((i, "".join(c + "-----" + ("0" if c == "x" else "1") for c in first)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    bits = [r["bits_per_byte"] for r in ctw.score(docs).where("held_out").collect()]
    assert bits and max(bits) < 0.2  # 1/7 for the random byte of each seven; another 1/7 if the decided one is not learned
