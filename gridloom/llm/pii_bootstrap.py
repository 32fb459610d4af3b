"""Personal data by bootstrapped contextual extraction, in DataFrame functions only.

Base spans (email, ip, card, phone) come from fixed patterns and checks.  They seed
a pattern-instance graph: a pattern is the lower-cased word before a span, or that and
the word after it; an instance is a value seen there.  Candidates are all tokens that may
be an identifier, whatever their shape: tokens with a digit, @, _, [ or an inner dot, with
the groups of digits that follow, and spelled-out addresses.  In every round a pattern's
confidence for a kind is the share of its distinct instances, candidates included, that are
known of that kind (with a minimum support); an instance's confidence is
1 - prod(1 - confidence) over its accepted patterns, and instances above the threshold are
known in the next round.  Rounds end when one finds nothing new.  A value takes the kind of
its best confidence.  All occurrences of a found value become spans; base spans stay.

Offsets are code points, end exclusive.  Edge cases: null text is empty; identical
(doc_id, text) rows get identical results each; an empty table gives an empty result;
a null doc_id is kept; only doc_id and text are read, so extra columns cannot clash.
Text length is unlimited: patterns use possessive quantifiers, so none backtracks or
recurses over a long run, and spans are found in chunks, so time grows with the text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialise

KINDS = ("email", "ip", "card", "phone")
_LOCAL = "A-Za-z0-9._%+-"
#: The given patterns.  "(?<![x])|\G" starts a run once instead of at each of its characters.
BASE = {
    "email": rf"(?:(?<![{_LOCAL}])|\G)[{_LOCAL}]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:(?<![0-9])|\G)[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9]++(?:[\x20-][0-9]++)*+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: What a text must hold for a kind's pattern to be worth trying.
NEEDS = {"email": "@", "ip": ".", "card": None, "phone": "+"}
_SPACE = r"\x20\x09-\x0D"
#: Tokens that may be an identifier: spelled-out addresses, or a token with a telling character and the groups of digits after it.
LOOSE = (
    rf"(?<![^{_SPACE}])(?:[{_LOCAL}]++(?:\x20at\x20|\x20?[\[(]at[\])]\x20?)[A-Za-z0-9-]++(?:(?:\.|\x20dot\x20|\x20?[\[(]dot[\])]\x20?)[A-Za-z0-9-]++)++"
    rf"|(?=[^{_SPACE}0-9@_\[.]*+(?:[0-9@_\[]|\.[A-Za-z]))[^{_SPACE}]++(?:\x20[+(]?[0-9][^{_SPACE}]*+)*+)"
)
LOOSE_NEEDS = r"[0-9@_\[]|\.[A-Za-z]|\x20at\x20|\(at\)"
_SPAN = "array<struct<kind:int,s:int,e:int,v:string,l:string,r:string>>"
#: Spans folded in one step; a step copies what it has found so far, so long lists are folded in two levels.
CHUNK = 256


def _word(x: Column) -> Column:
    return F.lower(F.regexp_replace(x, r"[^\pL\pN]+", ""))


def _chunks(items: Column) -> Column:
    """An array in pieces of CHUNK; not for an empty one."""
    return F.transform(F.sequence(F.lit(0), F.floor((F.size(items) - 1) / CHUNK).cast("int")), lambda c: F.slice(items, c * CHUNK + 1, F.lit(CHUNK)))


def _spans(text: Column, pattern: str, kind: int, holds, trim: bool = False) -> Column:
    """Spans of the hits that hold, with the words before and after them."""
    hits = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    gaps = F.split(text, pattern, -1)
    n = F.size(hits)
    pairs = F.arrays_zip(hits.alias("v"), F.slice(gaps, F.lit(1), n).alias("g"), F.slice(gaps, F.lit(2), n).alias("n"))
    none = F.array().cast(_SPAN)

    def step(acc, x):
        at = acc["at"] + F.length(x["g"])
        v, s = x["v"], at
        if trim:  # punctuation around a token is not of it
            left = F.regexp_replace(v, r"^[^\pL\pN+(]++", "")
            s = at + F.length(v) - F.length(left)
            v = F.reverse(F.regexp_replace(F.reverse(left), r"^[^\pL\pN)\]]++", ""))
        before = _word(F.reverse(F.regexp_extract(F.reverse(x["g"]), rf"^[{_SPACE}]*+([^{_SPACE}]++)", 1)))
        after = _word(F.regexp_extract(x["n"], rf"^[^\pL\pN]*+([^{_SPACE}]++)", 1))
        one = F.struct(F.lit(kind).alias("kind"), s.cast("int").alias("s"), (s + F.length(v)).cast("int").alias("e"), v.alias("v"), before.alias("l"), after.alias("r"))
        out = F.when(holds(v), F.concat(acc["out"], F.array(one)).cast(_SPAN)).otherwise(acc["out"])
        return F.struct((at + F.length(x["v"])).cast("int").alias("at"), out.alias("out"))

    def move(by):
        return lambda x: F.struct(x["kind"].alias("kind"), (x["s"] + by).cast("int").alias("s"), (x["e"] + by).cast("int").alias("e"), x["v"].alias("v"), x["l"].alias("l"), x["r"].alias("r"))

    def join(acc, c):
        return F.struct((acc["at"] + c["at"]).cast("int").alias("at"), F.concat(acc["out"], F.array(F.transform(c["out"], move(acc["at"])).cast(_SPAN))).alias("out"))

    def fold(p):
        parts = F.transform(_chunks(p), lambda c: F.aggregate(c, F.struct(F.lit(0).alias("at"), none.alias("out")), step))
        return F.aggregate(parts, F.struct(F.lit(0).alias("at"), F.array().cast(f"array<{_SPAN}>").alias("out")), join, lambda acc: F.flatten(acc["out"]))

    # A one-element array binds the pairs to a variable, so the patterns run once.
    return F.transform(F.array(pairs), lambda p: F.when(F.size(p) > 0, fold(p)).otherwise(none))[0]


def _digits(v: Column) -> Column:
    return F.regexp_replace(v, "[^0-9]", "")


def _luhn(v: Column) -> Column:
    d = F.split(F.reverse(_digits(v)), "")
    def weigh(x, i):
        n = x.cast("int")
        return F.when(i % 2 == 0, n).otherwise(F.when(n > 4, n * 2 - 9).otherwise(n * 2))
    return F.aggregate(F.transform(F.filter(d, lambda x: x != ""), weigh), F.lit(0), lambda a, x: a + x) % 10 == 0


def _holds(kind: str, v: Column) -> Column:
    if kind == "ip":
        return v.rlike(r"^(?:0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{1,2})(?:\.|$)){4}$")
    if kind == "card":
        return F.length(_digits(v)).between(13, 19) & _luhn(F.when(F.length(_digits(v)).between(13, 19), v).otherwise("1"))
    if kind == "phone":
        return F.length(_digits(v)).between(9, 15)
    return F.lit(True)


def _of(i: int):
    return lambda x: x["kind"] == i


def base_spans(text: Column) -> dict[str, Column]:
    none = F.array().cast(_SPAN)
    out = {}
    for i, kind in enumerate(KINDS):
        found = _spans(text, BASE[kind], i, lambda v, kind=kind: _holds(kind, v))
        need = F.contains(text, F.lit(NEEDS[kind])) if NEEDS[kind] else F.lit(True)
        # A card needs 13 digits with single separators at most; this test is cheap and safe.
        need = text.rlike(r"[0-9](?:[\x20-]?[0-9]){12}") if kind == "card" else need & text.rlike("[0-9]") if kind != "email" else need
        out[kind] = F.when(need, found).otherwise(none)
    return out


def loose_spans(text: Column) -> Column:
    return F.when(text.rlike(LOOSE_NEEDS), _spans(text, LOOSE, -1, lambda v: F.length(v) > 0, trim=True)).otherwise(F.array().cast(_SPAN))


def score_graph(edges: DataFrame, min_support: int = 5, pattern_conf: float = 0.8, instance_conf: float = 0.9, rounds: int = 1000) -> DataFrame:
    """(pattern, value, kind: of a base span, else -1), distinct -> (kind, value) of newly
    known instances, at the fixed point.  Every step is a partial aggregation or a join with
    the accepted patterns alone, so a hot pattern never sits in one task."""
    seeds = edges.where("kind >= 0").select("value", "kind").distinct()
    links = edges.where("pattern <> ''").select("pattern", "value").distinct()
    new = None
    for _ in range(rounds):
        known = links.join(seeds, "value", "left")
        size = links.groupBy("pattern").agg(F.count("*").alias("n"))
        good = (
            known.where("kind IS NOT NULL").groupBy("pattern", "kind").agg(F.count("*").alias("hit")).where(F.col("hit") >= min_support)
            .join(size, "pattern").where(F.col("hit") / F.col("n") >= pattern_conf)
            .select("pattern", F.col("kind").alias("k"), F.least(F.col("hit") / F.col("n"), F.lit(0.999)).alias("conf"))
        )
        found = (
            known.where("kind IS NULL").join(good, "pattern")
            .groupBy("k", "value").agg((1 - F.exp(F.sum(F.log(1 - F.col("conf"))))).alias("conf")).where(F.col("conf") >= instance_conf)
            .groupBy("value").agg(F.max(F.struct(F.col("conf"), (-F.col("k")).alias("k"))).alias("m")).select("value", (-F.col("m.k")).cast("int").alias("kind"))
        )
        found = materialise(found, "pii")
        new = found if new is None else new.unionByName(found)
        if not found.take(1):
            return new
        seeds = materialise(seeds.unionByName(found), "pii")
    raise RuntimeError("the pattern graph did not settle")


def extract(docs: DataFrame, min_support: int = 5, pattern_conf: float = 0.8, instance_conf: float = 0.9) -> DataFrame:
    """doc_id, h (xxhash64 of the text), base and more: arrays of (kind, s, e, v, l, r)."""
    text = F.coalesce("text", F.lit(""))
    t = docs.select("doc_id", text.alias("text")).select("doc_id", "text", F.xxhash64("text").alias("h"), *[c.alias(k) for k, c in base_spans(F.col("text")).items()])
    t = t.select("doc_id", "h", "text", F.concat(*KINDS).alias("base"))
    # Candidates are looked for beside the base spans: those are blanked, at their length.
    blank = replace_spans(F.col("text"), F.col("base"), lambda x: F.concat(F.lit(" "), F.repeat(F.lit("\u0001"), x["e"] - x["s"] - 2), F.lit(" ")), lambda n: F.repeat(F.lit("\u0001"), n))
    rest = F.when(F.size("base") > 0, blank).otherwise(F.col("text"))
    t = materialise(t.select("doc_id", "h", "base", F.transform(F.array(rest), loose_spans)[0].alias("loose")), "pii")

    def patterns(x):
        pair = F.when((x["l"] != "") & (x["r"] != ""), F.concat(x["l"], F.lit(" _ "), x["r"])).otherwise("")
        return F.struct(x["kind"].alias("kind"), x["v"].alias("value"), F.array_distinct(F.array(x["l"], pair)).alias("patterns"))

    seen = t.select(F.explode(F.transform(F.concat("base", "loose"), patterns)).alias("x"))
    edges = materialise(seen.select("x.kind", "x.value", F.explode("x.patterns").alias("pattern")).distinct(), "pii")
    new = score_graph(edges, min_support, pattern_conf, instance_conf)
    more = (
        t.where(F.size("loose") > 0).select("doc_id", "h", F.explode("loose").alias("x"))
        .join(new.select(F.col("kind").alias("nk"), F.col("value").alias("nv")), F.col("x.v") == F.col("nv"))
        .select("doc_id", "h", F.struct(F.col("nk").alias("kind"), "x.s", "x.e", "x.v", "x.l", "x.r").alias("x"))
        .groupBy(F.coalesce("doc_id", F.lit(-1)).alias("_d"), F.col("doc_id").isNull().alias("_n"), F.col("h").alias("_h"))
        .agg(F.collect_set("x").alias("more"))
    )
    on = (F.coalesce(t["doc_id"], F.lit(-1)) == more["_d"]) & (t["doc_id"].isNull() == more["_n"]) & (t["h"] == more["_h"])
    # Only rows with loose spans go through the join; the others pass by it.
    rest = t.where(F.size("loose") == 0).select("doc_id", "h", "base", F.array().cast(_SPAN).alias("more"))
    hit = t.where(F.size("loose") > 0).join(more, on, "left").select("doc_id", "h", "base", F.coalesce("more", F.array().cast(_SPAN)).alias("more"))
    return rest.unionByName(hit)


def _line(spans: Column) -> Column:
    ordered = F.array_sort(F.transform(spans, lambda x: F.struct(x["kind"].alias("k"), x["s"].alias("s"), x["e"].alias("e"))))
    name = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(ordered, lambda x: F.concat_ws(":", F.element_at(name, x["k"] + 1), x["s"].cast("string"), x["e"].cast("string"))), ",")


def report(found: DataFrame) -> DataFrame:
    """The digest columns of ``extract``'s spans; the n_ columns count base spans."""
    counts = [F.size(F.filter("base", _of(i))).cast("long").alias(f"n_{k}") for i, k in enumerate(KINDS)]
    return found.select(
        "doc_id", *counts, F.sha2(_line(F.col("base")), 256).alias("base_sha256"), _line(F.concat("base", "more")).alias("spans"), F.size("more").cast("long").alias("n_more")
    )


def replace_spans(text: Column, spans: Column, put, extend=None) -> Column:
    """The text with every span replaced by ``put(span)``; not for an empty array.  Of spans that
    overlap, the first one's replacement stands for all, with ``extend(n)`` for n more places.  Spans are folded in chunks, each
    on its own piece of the text."""
    ordered = F.array_sort(F.transform(spans, lambda x: F.struct(x["s"].alias("s"), x["e"].alias("e"), x["kind"].alias("kind"))))

    def step(piece, origin):
        def one(acc, x):
            gap = F.substring(piece, acc["at"] - origin + 1, F.greatest(x["s"] - acc["at"], F.lit(0)))
            same = F.concat(acc["out"], extend(F.greatest(x["e"] - acc["at"], F.lit(0)))) if extend else acc["out"]
            out = F.when(x["s"] < acc["at"], same).otherwise(F.concat(acc["out"], gap, put(x)))
            return F.struct(F.greatest(x["e"], acc["at"]).alias("at"), out.alias("out"))

        return one

    def place(acc, c):
        end = F.greatest(acc["at"], F.array_max(F.transform(c, lambda x: x["e"])))
        part = F.struct(acc["at"].alias("from"), end.alias("to"), c.alias("c"))
        return F.struct(end.alias("at"), F.concat(acc["out"], F.array(part)).alias("out"))

    def cut(p):
        def one(piece):
            return F.aggregate(p["c"], F.struct(p["from"].alias("at"), F.lit("").alias("out")), step(piece, p["from"]), lambda acc: acc["out"])

        return F.transform(F.array(F.substring(text, p["from"] + 1, p["to"] - p["from"])), one)[0]

    empty = F.array().cast("array<struct<from:int,to:int,c:array<struct<s:int,e:int,kind:int>>>>")

    def whole(o):
        parts = F.aggregate(_chunks(o), F.struct(F.lit(0).alias("at"), empty.alias("out")), place, lambda acc: acc["out"])
        last = F.array_max(F.transform(o, lambda x: x["e"]))
        return F.concat(F.array_join(F.transform(parts, cut), ""), F.substring(text, last + 1, F.length(text)))

    return F.transform(F.array(ordered), whole)[0]


def redact(docs: DataFrame, mask: str = "[{}]", **options) -> DataFrame:
    """``docs`` with every span found replaced by its kind; all columns kept.

    Spans that overlap (of different kinds) are merged from the left; the first kind
    names the mask.
    """
    found = extract(docs, **options)
    spans = found.where((F.size("base") > 0) | (F.size("more") > 0)).select(
        F.coalesce("doc_id", F.lit(-1)).alias("_d"), F.col("doc_id").isNull().alias("_n"), F.col("h").alias("_h"), F.concat("base", "more").alias("_spans")
    ).dropDuplicates(["_d", "_n", "_h"])
    text = F.coalesce(docs["text"], F.lit(""))
    j = docs.join(spans.hint("merge"), (F.coalesce(docs["doc_id"], F.lit(-1)) == spans["_d"]) & (docs["doc_id"].isNull() == spans["_n"]) & (F.xxhash64(text) == spans["_h"]), "left")
    names = F.array(*[F.lit(mask.format(k.upper())) for k in KINDS])
    clean = replace_spans(docs["text"], F.col("_spans"), lambda x: F.element_at(names, x["kind"] + 1))
    return j.select(*[F.when(F.col("_spans").isNull(), docs["text"]).otherwise(clean).alias("text") if c == "text" else docs[c] for c in docs.columns])
