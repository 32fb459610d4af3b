"""N-gram Jaccard join by an R-tree over count vectors.

A document's set holds its distinct k-word shingles; two documents link when
|A and B| >= theta |A or B|.

Method.  Shingles are hashed into ``GROUPS`` groups; a document's counts per group are a
point.  The overlap of two sets is at most the summed coordinate minima of their points;
an R-tree over the points (bulk-loaded; a node keeps the coordinate maxima and the size
range below it) discards what cannot reach the overlap that theta asks for, and the
pairs that survive are verified on the sets.

Scale.  A tree over a whole corpus discards nearly all pairs, but a search visits nodes in
proportion to the corpus (figures in README), so trees are built per family, and families
are found exactly: linked sets of sizes a <= b differ in at
most t(a) = a (1 - theta) / theta shingles.  Sets of one size band are cut, by another
hash, into more than t(band) parts, so linked sets agree wholly in at least one part.
Equal parts join documents into families (connected components); a lone document has no
partner.  A pair's bands are the same or neighbours, so each document is cut for its own
band and the one below.  The number of parts has a reserve over t: a pair agrees in one part
more than the reserve, so a document passes over that many parts, its empty ones first, then
those in which most documents agree (above ``COMMON``).  What two documents both have, both
order alike, so of the parts that a pair agrees in, the two together pass over no more than
either's reserve, and one is left.  Passages that many documents repeat so join nothing else
into families.  A document with more empty parts than its reserve has them all compared.

Equal sets are one representative (their smallest id).  Families of more than
``BLOCK`` representatives, or ``BULK`` shingles, are cut by size band and compared block by
block, in tasks of two blocks each, so a set travels to two or three tasks.  A task emits a spanning forest of its links, never all pairs; no link between components
is lost, since a document is only spared the pairs inside its own component.

Edge cases: null, empty or blank text has no shingles and is its own component; fewer
than k words make one shingle; rows with equal ids are merged into one row (the union of
their links, the largest set's n_shingles); a null id gets a null component and links
nothing; an empty table gives an empty result; only the id and text are read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import U64, as_bytes, column, connected_components, lower_ascii, materialise, mix64, partitions, pieces, shingle_hashes, word_hashes, word_spans

GROUPS = 256
BLOCK = 2048
#: Shingles of a block's sets: long documents make blocks of fewer.
BULK = 1 << 22
#: Signatures are dealt to this many buckets at least, so that what meets in several of
#: them grows with the documents alone.
BUCKETS = 64
#: A part in which more documents agree than this can be passed over.
COMMON = 4
#: Candidates verified in one step.
CHECKS = 64
_SIGN = np.int64(np.iinfo(np.int64).min)


def doc_sets(buf: np.ndarray, offs: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(distinct shingle hashes, sorted within each document; number per document)."""
    low = lower_ascii(buf)
    s, e, n = word_spans(low, offs)
    h, m = shingle_hashes(word_hashes(low, s, e), n, k)
    doc = np.repeat(np.arange(len(m)), m)
    order = np.lexsort((h, doc))
    h, doc = h[order], doc[order]
    keep = np.ones(len(h), bool)
    keep[1:] = (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])
    return h[keep], np.bincount(doc[keep], minlength=len(m))


class Bands:
    """Size bands and the number of parts each is cut into."""

    def __init__(self, num: int, den: int):
        self.num, self.den = num, den  # theta = num / den
        self.low = [1]

    def of(self, sizes: np.ndarray) -> np.ndarray:
        while self.low[-1] <= sizes.max(initial=1):
            # Sets of size a link with sizes up to floor(a / theta): the next band starts beyond.
            self.low.append(self.low[-1] * self.den // self.num + 1)
        return np.searchsorted(np.array(self.low), sizes, "right") - 1

    def parts(self, band: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(parts, differing shingles at most) of pairs whose smaller set is in ``band``."""
        low = np.array(self.low + [self.low[-1] * self.den // self.num + 1])
        a = low[band + 1] - 1
        b = a * self.den // self.num
        # |A xor B| <= (1 - theta) / (1 + theta) (a + b)
        t = (self.den - self.num) * (a + b) // (self.den + self.num)
        return (11 * t) // 10 + 4, t


def signatures(h: np.ndarray, n: np.ndarray, bands: Bands) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(signature, document, spare) of the parts of every document, for its band and the one
    below: spare is twice the number of these parts that may be passed over, plus one for an odd band."""
    out, who, over = [], [], []
    band = bands.of(np.maximum(n, 1))
    doc_all = np.repeat(np.arange(len(n)), n)
    for below in (0, 1):
        b = band - below
        p, t = bands.parts(np.maximum(b, 0))
        use = (n > 0) & (b >= 0)
        first = np.cumsum(np.where(use, p, 0)) - np.where(use, p, 0)
        ok = use[doc_all]
        doc, x = doc_all[ok], h[ok]
        part = (mix64(x ^ U64(0xA5A5)) % p[doc].astype(U64)).astype(np.int64)
        total = int(np.where(use, p, 0).sum())
        at = first[doc] + part
        acc = np.zeros(total, U64)
        np.add.at(acc, at, mix64(x))
        size = np.bincount(at, minlength=total)
        owner = np.repeat(np.arange(len(n)), np.where(use, p, 0))
        within = np.arange(total) - first[owner]
        empty = np.bincount(owner[size == 0], minlength=len(n))
        take = (size > 0) | (empty >= p - t)[owner]
        key = (b[owner].astype(U64) << U64(40)) | within.astype(U64)
        sig = mix64(mix64(key) + acc * U64(0x9E3779B97F4A7C15) + size.astype(U64))
        spare = np.clip(p - t - 1 - empty, 0, (1 << 15) - 1).astype(np.uint16) * np.uint16(2) + (b % 2).astype(np.uint16)
        out.append(sig[take])
        who.append(owner[take])
        over.append(spare[owner[take]])
    return np.concatenate(out), np.concatenate(who), np.concatenate(over)


MET = "a long, b long, sig long, agree int, spare int"


def meet(t: pa.Table) -> pa.Table:
    """Of a bucket's signatures: a and b, each document with the least of those that agree with
    it; of signatures common to more than ``COMMON`` documents one row each of a, sig, agree
    (their number) and spare, as not every document needs them."""
    sig, doc, spare = (np.frombuffer(b"".join(t.column(c).to_pylist()), kind) for c, kind in (("sigs", U64), ("docs", np.int64), ("spares", np.uint16)))
    order = np.lexsort((spare, doc, sig))
    sig, doc, spare = sig[order], doc[order], spare[order]
    once = np.ones(len(sig), bool)
    once[1:] = (sig[1:] != sig[:-1]) | (doc[1:] != doc[:-1])  # repeated rows, the least spare
    sig, doc, spare = sig[once], doc[once], spare[once]
    first = np.flatnonzero(np.r_[True, sig[1:] != sig[:-1]]) if len(sig) else np.zeros(0, np.int64)
    m = np.diff(np.r_[first, len(sig)])
    agree, least = np.repeat(m, m), np.repeat(doc[first], m)
    few, many = (agree <= COMMON) & (doc != least), agree > COMMON
    pair = np.unique(np.stack([doc[few], least[few]], 1), axis=0)
    none = lambda n, kind: pa.nulls(n, kind)
    n, k = len(pair), int(many.sum())
    edges = [pa.array(pair[:, 0]), pa.array(pair[:, 1]), none(n, pa.int64()), none(n, pa.int32()), none(n, pa.int32())]
    rows = [pa.array(doc[many]), none(k, pa.int64()), pa.array(sig[many].view(np.int64)), pa.array(agree[many].astype(np.int32)), pa.array(spare[many].astype(np.int32))]
    return pa.table([pa.chunked_array([x, y]) for x, y in zip(edges, rows)], names=["a", "b", "sig", "agree", "spare"])


def common_edges(met: DataFrame) -> DataFrame:
    """a, b: agreements in common signatures that a document does not pass over.  Each passes
    over its most common ones, as many as it may (texts of one id: as many as each of them may)."""
    own = W.partitionBy("a", F.col("spare") % 2)
    m = met.where("sig IS NOT NULL")
    m = m.withColumn("may", F.min("spare").over(own)).withColumn("at", F.row_number().over(own.orderBy(F.col("agree").desc(), "sig")))
    kept = m.where("at > shiftright(may, 1)").select("a", "sig")
    least = kept.groupBy("sig").agg(F.min("a").alias("b"))
    return kept.join(least, "sig").where("a <> b").select("a", "b")


def _scan(batch: pa.RecordBatch, k: int):
    buf, offs = as_bytes(column(batch, "text"))
    for i, j in pieces(offs):
        yield i, j, *doc_sets(buf[offs[i] : offs[j]], offs[i : j + 1] - offs[i], k)


def _set_hash(h: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit sums that name a set."""
    doc = np.repeat(np.arange(len(n)), n)
    a, b = np.zeros(len(n), U64), np.zeros(len(n), U64)
    np.add.at(a, doc, mix64(h ^ U64(1)))
    np.add.at(b, doc, mix64(h ^ U64(0x5BD1E995)))
    return a.view(np.int64), b.view(np.int64)


class RTree:
    """Bulk-loaded over count vectors: rows ordered by the widest coordinates, leaves of
    ``fan`` rows, levels of ``fan`` nodes; a node keeps coordinate maxima and sizes."""

    def __init__(self, points: np.ndarray, sizes: np.ndarray, fan: int = 16):
        self.fan = fan
        self.order = self._tile(np.arange(len(points)), points, sizes)
        pts, n = points[self.order], sizes[self.order]
        self.levels = [(pts, n, n)]
        while len(self.levels[-1][0]) > fan:
            top, lo, hi = self.levels[-1]
            cut = np.arange(0, len(top), fan)
            self.levels.append((np.maximum.reduceat(top, cut), np.minimum.reduceat(lo, cut), np.maximum.reduceat(hi, cut)))

    def _tile(self, rows: np.ndarray, points: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """Sort by size first, then split runs at medians of their widest coordinate."""
        if len(rows) <= self.fan:
            return rows
        spread = points[rows].max(0).astype(np.int64) - points[rows].min(0)
        g = int(spread.argmax())
        span = int(sizes[rows].max()) - int(sizes[rows].min())
        key = sizes[rows] if span >= 2 * spread[g] else points[rows, g]
        half = max(self.fan, (len(rows) // 2 + self.fan - 1) // self.fan * self.fan)
        if half >= len(rows):
            half = len(rows) // 2
        by = rows[np.argsort(key, kind="stable")]
        return np.concatenate([self._tile(by[:half], points, sizes), self._tile(by[half:], points, sizes)])

    def search(self, point: np.ndarray, size: int, num: int, den: int) -> np.ndarray:
        """Rows whose bounded overlap can reach theta: min-sum >= theta / (1 + theta) (a + b)."""
        at = np.arange(len(self.levels[-1][0]))
        for lev in range(len(self.levels) - 1, -1, -1):
            top, lo, hi = self.levels[lev]
            at = at[(lo[at] * num <= size * den) & (hi[at] * den >= size * num)]
            bound = np.minimum(top[at], point).sum(1, dtype=np.int32)
            at = at[bound.astype(np.int64) * (den + num) >= num * (size + np.maximum(lo[at], -(-size * num // den)))]
            if lev:
                at = (at[:, None] * self.fan + np.arange(self.fan)).ravel()
                at = at[at < len(self.levels[lev - 1][0])]
        return self.order[at]


def link_blocks(ids: np.ndarray, side: np.ndarray, sets: list[np.ndarray], within: bool, num: int, den: int) -> list[tuple[int, int]]:
    """A spanning forest of the links between side 0 and side 1 and, if ``within``, inside side 0."""
    n = np.array([len(s) for s in sets])
    flat = np.concatenate(sets).view(U64) if len(sets) else np.zeros(0, U64)
    start = np.cumsum(n) - n
    points = np.zeros((len(n), GROUPS), np.int16 if n.max(initial=0) < 1 << 15 else np.int32)
    for i, own in enumerate(sets):
        points[i] = np.bincount((own.view(U64) % U64(GROUPS)).astype(np.int64), minlength=GROUPS)
    root = np.arange(len(n))
    out = []
    base = np.flatnonzero(side == 0)
    if not len(base):
        return out
    tree = RTree(points[base], n[base])
    for q in range(len(n)) if within else np.flatnonzero(side == 1):
        found = base[tree.search(points[q], int(n[q]), num, den)]
        if side[q] == 0:
            found = found[found > q]
        found = found[root[found] != root[q]]
        while len(found):
            # A few candidates at a time: the first link spares the rest of its component.
            some = found[:CHECKS]
            size = n[some]
            at = np.repeat(start[some] - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))
            x = flat[at]
            own = flat[start[q] : start[q] + n[q]]
            hit = own[np.minimum(np.searchsorted(own, x), len(own) - 1)] == x
            both = np.add.reduceat(hit, np.cumsum(size) - size, dtype=np.int64)
            for c in some[both * (den + num) >= num * (n[q] + size)]:
                if root[c] != root[q]:
                    out.append((int(ids[q]), int(ids[c])))
                    root[root == root[c]] = root[q]
            found = found[CHECKS:]
            found = found[root[found] != root[q]]
    return out


def tasks_of(families: DataFrame, low: list[int]) -> DataFrame:
    """(id, component, n) -> id, component, kind, band, lo, hi, side, within: the tasks that
    a representative takes part in.

    A family of up to BLOCK, and BULK shingles, is one task.  A larger one is cut by size band,
    since linked sets are of one band or of neighbours, and a band into blocks of about BLOCK
    or BULK, whichever are more: every block meets the blocks of its own band and of the next.
    """
    band = F.size(F.filter(F.array(*map(F.lit, low)), lambda x: x <= F.col("n"))) - 1
    f = families.select("id", "component", "n", band.alias("band"))
    sizes = f.groupBy("component", "band").agg((F.count("*") / BLOCK).alias("c"), (F.sum("n") / BULK).alias("w"))
    total = sizes.groupBy("component").agg(F.greatest(F.sum("c"), F.sum("w")).alias("m"))
    blocks = sizes.select("component", "band", F.ceil(F.greatest("c", "w")).cast("int").alias("k"))
    plan = blocks.join(total, "component")
    for name, step in (("up", 1), ("down", -1)):
        plan = plan.join(blocks.select("component", (F.col("band") - step).alias("band"), F.col("k").alias(name)), ["component", "band"], "left")
    d = f.join(plan, ["component", "band"]).withColumn("own", F.pmod(F.xxhash64("id"), F.col("k")).cast("int"))
    zero = F.lit(0)

    def task(kind, band, lo, hi, side, within):
        return F.struct(F.lit(kind).alias("kind"), band.cast("int").alias("band"), lo.cast("int").alias("lo"), hi.cast("int").alias("hi"), F.lit(side).alias("side") if isinstance(side, int) else side.alias("side"), within.alias("within"))

    alone = F.array(task(0, zero, zero, zero, 0, F.lit(True)))
    lower = F.transform(F.sequence(zero, F.greatest(F.coalesce("up", zero), F.lit(1)) - 1), lambda j: task(1, F.col("band"), F.col("own"), j, 0, (F.col("k") == 1) & (j == 0)))
    upper = F.when(F.col("down") > 0, F.transform(F.sequence(zero, F.col("down") - 1), lambda i: task(1, F.col("band") - 1, i, F.col("own"), 1, (F.col("down") == 1) & (F.col("own") == 0)))).otherwise(F.array().cast("array<struct<kind:int,band:int,lo:int,hi:int,side:int,within:boolean>>"))
    same = F.when(F.col("k") > 1, F.transform(F.sequence(zero, F.col("k") - 1), lambda o: task(2, F.col("band"), F.least("own", o), F.greatest("own", o), F.when(F.col("own") <= o, 0).otherwise(1), F.col("own") == o))).otherwise(F.array().cast("array<struct<kind:int,band:int,lo:int,hi:int,side:int,within:boolean>>"))
    every = F.when(F.col("m") <= 1, alone).otherwise(F.concat(lower, upper, same))
    return d.select("id", "component", F.explode(every).alias("x")).select("id", "component", "x.*")


def join(docs: DataFrame, k: int = 5, num: int = 8, den: int = 10, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, n_shingles, component_id for similarity num / den on k-word shingles."""
    spark = docs.sparkSession
    d = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))

    def sets_of(batches):
        for b in batches:
            ids = column(b, "id")
            for i, j, h, n in _scan(b, k):
                x, y = _set_hash(h, n)
                yield pa.RecordBatch.from_arrays([ids[i:j], pa.array(n.astype(np.int64)), pa.array(x), pa.array(y)], ["id", "n", "x", "y"])

    every = materialise(d.mapInArrow(sets_of, "id long, n long, x long, y long"), "sets")
    filled = every.where("n > 0 AND id IS NOT NULL")
    total = filled.agg(F.max("n").alias("top"), F.sum("n").alias("all")).first()
    # Buckets and tasks by the number of shingles, so that neither grows with the input.
    buckets = max(BUCKETS, partitions(spark), (total["all"] or 0) >> 21)
    tasks = max(partitions(spark), (total["all"] or 0) >> 22)
    reps = filled.groupBy("n", "x", "y").agg(F.min("id").alias("rep"))

    def sigs_of(batches):
        bands = Bands(num, den)
        seen: set = set()  # exact copies within a task are cut once
        for b in batches:
            ids = column(b, "id").to_numpy()
            for i, _, h, n in _scan(b, k):
                new = np.zeros(len(n), bool)
                for r, v in enumerate(zip(n.tolist(), *(z.tolist() for z in _set_hash(h, n)))):
                    if v not in seen:
                        new[r] = True
                        if len(seen) < 1 << 20:
                            seen.add(v)
                keep = np.repeat(new, n)
                n = np.where(new, n, 0)
                sig, who, spare = signatures(h[keep], n, bands)
                dest = (mix64(sig) % U64(buckets)).astype(np.int64)
                order = np.argsort(dest, kind="stable")
                sig, who, spare, dest = sig[order], who[order], spare[order], dest[order]
                cut = np.flatnonzero(np.r_[True, dest[1:] != dest[:-1]]) if len(dest) else np.zeros(0, np.int64)
                ends = np.r_[cut[1:], len(dest)] if len(dest) else cut
                doc = ids[i + who]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(dest[cut]), *[pa.array([v[a:z].tobytes() for a, z in zip(cut, ends)], pa.binary()) for v in (sig, doc, spare)]], ["bucket", "sigs", "docs", "spares"]
                )

    packed = d.where("id IS NOT NULL").mapInArrow(sigs_of, "bucket long, sigs binary, docs binary, spares binary")
    met = materialise(packed.repartition(tasks, "bucket").groupBy("bucket").applyInArrow(meet, MET), "met")
    shared = met.where("sig IS NULL").select("a", "b").unionAll(common_edges(met))
    # Copies of one set meet too; what matters are pairs of different sets.
    rep_of = filled.join(reps, ["n", "x", "y"]).where("id <> rep").select("id", "rep")
    rep_of = materialise(rep_of.groupBy("id").agg(F.min("rep").alias("rep")), "rep")
    e = shared.distinct()
    for side in ("a", "b"):
        e = e.join(rep_of.select(F.col("id").alias(side), F.col("rep").alias(f"r{side}")), side, "left").withColumn(side, F.coalesce(f"r{side}", side)).drop(f"r{side}")
    families = materialise(connected_components(e.where("a <> b")), "fam")
    bands = Bands(num, den)
    bands.of(np.array([total["top"] or 1]))
    places = tasks_of(families.join(reps.select(F.col("rep").alias("id"), "n"), "id"), bands.low)

    def with_sets(batches):
        for b in batches:
            for i, j, h, n in _scan(b, k):
                at = np.r_[0, np.cumsum(n) * 8].astype(np.int64)
                packed_sets = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(n), [None, pa.py_buffer(at), pa.py_buffer(h)]).cast(pa.binary())
                yield pa.RecordBatch.from_arrays([b.column("id").slice(i, j - i), b.column("tasks").slice(i, j - i), packed_sets], ["id", "tasks", "set"])

    task_type = "array<struct<component:bigint,kind:int,band:int,lo:int,hi:int,side:int,within:boolean>>"
    packed_tasks = places.groupBy("id").agg(F.collect_list(F.struct("component", "kind", "band", "lo", "hi", "side", "within")).alias("tasks"))
    texts = d.join(packed_tasks.hint("merge"), "id").select("id", "tasks", "text").mapInArrow(with_sets, f"id long, tasks {task_type}, set binary").where("length(set) > 0")
    spread = texts.select("id", "set", F.explode("tasks").alias("t")).select("t.*", "id", "set")
    spread = spread.withColumn("bucket", F.when(F.col("kind") == 0, F.pmod(F.xxhash64("component"), F.lit(4 * buckets))).otherwise(F.xxhash64("component", "kind", "band", "lo", "hi")))

    def verify(t: pa.Table) -> pa.Table:
        names = ("component", "kind", "band", "lo", "hi")
        order = np.lexsort([t.column(c).to_numpy() for c in ("id", *names[::-1])])
        key = np.stack([t.column(c).to_numpy()[order] for c in names])
        ids, side = t.column("id").to_numpy()[order], t.column("side").to_numpy()[order]
        sets = [np.frombuffer(x.as_buffer(), U64) for x in t.column("set")]  # no copies
        within = t.column("within").to_numpy()[order]
        cut = np.flatnonzero(np.r_[True, (key[:, 1:] != key[:, :-1]).any(0)])
        pairs: list = []
        for a, z in zip(cut, np.r_[cut[1:], key.shape[1]]):
            pairs += link_blocks(ids[a:z], side[a:z], [sets[r] for r in order[a:z]], bool(within[a:z].any()), num, den)
        arr = np.array(pairs, np.int64).reshape(-1, 2)
        return pa.table([arr[:, 0], arr[:, 1]], names=["a", "b"])

    links = spread.repartition(tasks, "bucket").groupBy("bucket").applyInArrow(verify, "a long, b long").where("a <> b")
    comps = connected_components(links.unionByName(_same_id(filled, reps)))
    rep_comp = reps.join(comps.withColumnRenamed("id", "rep"), "rep", "left").select("n", "x", "y", F.coalesce("component", "rep").alias("c"))
    got = every.join(rep_comp, ["n", "x", "y"], "left").select("id", "n", F.when(F.col("n") > 0, F.col("c")).otherwise(F.col("id")).alias("c"))
    known = got.where("id IS NOT NULL").groupBy("id").agg(F.max("n").alias("n"), F.min("c").alias("c"))
    out = known.unionByName(got.where("id IS NULL").select("id", "n", F.lit(None).cast("long").alias("c")))
    return out.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), F.col("c").alias("component_id"))


def _same_id(filled: DataFrame, reps: DataFrame) -> DataFrame:
    """Rows of one id with different sets: links between the sets' representatives."""
    many = filled.select("id", "n", "x", "y").distinct()
    twice = many.groupBy("id").agg(F.count("*").alias("m")).where("m > 1").select("id")
    r = many.join(twice, "id").join(reps, ["n", "x", "y"]).select("id", "rep")
    return r.groupBy("id").agg(F.min("rep").alias("b"), F.collect_set("rep").alias("all")).select(F.explode("all").alias("a"), "b").where("a <> b")
