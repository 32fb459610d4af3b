"""Nearest neighbours by a forest of random-projection trees with one shared queue.

Every tree splits by a random direction per level and, in every node, the median of a
bounded sample (``sample_rows``) along it.  All rows are indexed: each gets one leaf per
tree.  A query visits the (tree, leaf) pairs of all trees in one order of priority, the
squared distance to the violated splits, until the leaves visited hold
``share`` times the rows; since leaf sizes are known, the queue's end is one priority per
query.  Rows of the visited leaves are reranked by their exact inner product; a pair is
scored in the first tree whose leaf holds it, and a task returns no row under the 2k-th
best of the sample: single precision, with a reserve for its error, sets most pairs aside, and
only what is left is looked up in the queues and summed exactly.  Queries left with fewer than k rows by that are searched once more
without it.

Scale: rows are dealt by (tree, leaf range, salt), queries in blocks of ``QUERY_BLOCK``;
a task holds one block and one range, and returns k rows per query.  Leaves with more
than ``CELL`` rows (copies of one vector) are salted.  The driver holds the sample, the
splits and the leaf sizes, all bounded by parameters.

Edge cases: rows with a null id, and vectors that are null, zero or hold null or non-finite
components take no part; vectors of different lengths have no inner product, so each
length is searched apart; repeated ids count once per
query, and a query's own id is never its neighbour; equal scores go by the smaller id;
an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import materialise

QUERY_BLOCK = 8192
CELL = 16384
CHUNK = 2048


def usable(vec: Column) -> Column:
    fine = F.forall(vec, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return vec.isNotNull() & fine & F.exists(vec, lambda x: x != 0)


def _matrix(col: pa.Array | pa.ChunkedArray) -> np.ndarray:
    a = col.combine_chunks() if isinstance(col, pa.ChunkedArray) else col
    n = len(a)
    return np.asarray(a.flatten(), dtype=np.float64).reshape(n, -1) if n else np.zeros((0, 0))


class Forest:
    """Directions (trees, dim, depth) and thresholds (trees, 2^depth - 1, heap order)."""

    def __init__(self, sample: np.ndarray, trees: int, depth: int, seed: int = 0):
        rng = np.random.default_rng(seed)
        dim = sample.shape[1]
        self.trees, self.depth = trees, depth
        d = rng.normal(size=(trees, dim, depth))
        for t in range(trees):
            for c in range(0, depth, dim):  # orthogonal levels, as far as the dimension goes
                d[t, :, c : c + dim] = np.linalg.qr(d[t, :, c : c + dim])[0]
        self.dirs = d
        self.cuts = np.zeros((trees, (1 << depth) - 1))
        for t in range(trees):
            proj = sample @ d[t]
            node = np.zeros(len(sample), np.int64)
            for lev in range(depth):
                for x in range((1 << lev) - 1, (1 << (lev + 1)) - 1):
                    own = proj[node == x, lev]
                    self.cuts[t, x] = np.median(own) if len(own) else 0.0
                node = 2 * node + 1 + (proj[:, lev] > self.cuts[t, node])

    def leaves(self, x: np.ndarray) -> np.ndarray:
        """(rows, trees) leaf numbers."""
        out = np.empty((len(x), self.trees), np.int64)
        for t in range(self.trees):
            proj = x @ self.dirs[t]
            node = np.zeros(len(x), np.int64)
            for lev in range(self.depth):
                node = 2 * node + 1 + (proj[:, lev] > self.cuts[t, node])
            out[:, t] = node - ((1 << self.depth) - 1)
        return out

    def priorities(self, q: np.ndarray, t: int) -> np.ndarray:
        """(queries, leaves): squared distance to the splits that the leaf is beyond."""
        proj = q @ self.dirs[t]
        cost = np.zeros((len(q), 1))
        for lev in range(self.depth):
            gap = proj[:, lev : lev + 1] - self.cuts[t, (1 << lev) - 1 : (1 << (lev + 1)) - 1][None]
            both = np.stack([np.where(gap > 0, gap, 0) ** 2, np.where(gap > 0, 0, gap) ** 2], 2)
            cost = (cost[:, :, None] + both).reshape(len(q), -1)
        return cost

    def visited(self, q: np.ndarray, t: int, stop: np.ndarray, r: np.ndarray, leaf: np.ndarray) -> np.ndarray:
        """Whether query r[i] visits leaf[i] of tree t: the priority of single leaves."""
        proj, node = q @ self.dirs[t], leaf + (1 << self.depth)
        cost = np.zeros(len(r))
        for lev in range(self.depth):
            gap = proj[r, lev] - self.cuts[t, (node >> (self.depth - lev)) - 1]
            right = (node >> (self.depth - lev - 1)) & 1 == 1
            cost += np.where((gap > 0) != right, gap, 0) ** 2
        return cost <= stop[r]

    def stop(self, q: np.ndarray, sizes: np.ndarray, budget: float) -> np.ndarray:
        """The priority at which a query's shared queue has visited ``budget`` rows."""
        p = np.concatenate([self.priorities(q, t) for t in range(self.trees)], 1)
        order = np.argsort(p, 1)
        seen = np.cumsum(sizes.reshape(-1)[order], 1)
        last = np.minimum((seen < budget).sum(1), p.shape[1] - 1)
        return p[np.arange(len(q)), order[np.arange(len(q)), last]]


def _nearest(forest: Forest, t: int, q, qid, stop, bound, x, xid, leaves):
    """(query, row id, exact score) of the pairs that tree ``t`` is the first to visit and whose
    score is ``bound`` or more."""
    # Scores in single precision, scaled to fit; they err by less than the slack.
    high, top = np.abs(q).max(1), np.abs(x).max()
    a, b = (q / high[:, None]).astype(np.float32), (x / top).astype(np.float32)
    slack = 4e-7 * (q.shape[1] + 8) * np.linalg.norm(a, axis=1).astype(float) * float(np.linalg.norm(b, axis=1).max())
    least = np.nextafter((bound / high / top - slack).astype(np.float32), np.float32(-np.inf))
    rs, cs = np.nonzero(a @ b.T >= least[:, None])
    out = []
    for lo in range(0, len(rs), 32768):
        r, c = rs[lo : lo + 32768], cs[lo : lo + 32768]
        for e in range(t, -1, -1):
            seen = forest.visited(q, e, stop, r, leaves[c, e]) == (e == t)
            r, c = r[seen], c[seen]
        r, c = r[qid[r] != xid[c]], c[qid[r] != xid[c]]
        exact = (q[r] * x[c]).sum(1)  # the same sum for a pair wherever it is met
        ok = exact >= bound[r]
        out.append((r[ok], xid[c[ok]], exact[ok]))
    return out


def search(vectors: DataFrame, is_query: Column, k: int = 20, trees: int = 6, share: float = 1.4, sample_rows: int = 65536, leaf_rows: int = 24, max_depth: int = 13, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score.  The queue ends when the leaves visited, over all trees, hold
    ``share`` times the rows (a row counts in every tree that it is met in), at every size: it
    trades work for recall (1.4: at least 0.9 even on structureless data)."""
    spark = vectors.sparkSession
    v = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).cast("array<double>").alias("vec"), is_query.alias("isq"))
    v = v.where(F.col("id").isNotNull() & usable(F.col("vec")))
    out = spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    for r in v.groupBy(F.size("vec").alias("dim")).agg(F.count("*").alias("n")).orderBy("dim").collect():  # a row for each length
        out = out.unionByName(_search(v.where(F.size("vec") == r["dim"]), r["dim"], r["n"], k, trees, share, sample_rows, leaf_rows, max_depth))
    return out


def _search(v: DataFrame, dim: int, n: int, k: int, trees: int, share: float, sample_rows: int, leaf_rows: int, max_depth: int) -> DataFrame:
    spark = v.sparkSession
    drawn = F.pmod(F.xxhash64("id", F.lit("rp")), F.lit(1 << 30)) < int((1 << 30) * min(1.0, sample_rows / n))
    drawn_rows = v.where(drawn).select("id", "vec").limit(2 * sample_rows).toArrow().sort_by("id")
    sample, sample_id = _matrix(drawn_rows.column("vec")), drawn_rows.column("id").to_numpy()
    depth = int(np.clip(np.floor(np.log2(max(n / leaf_rows, 2))), 1, min(max_depth, np.log2(max(len(sample) / 8, 2)))))
    forest = Forest(sample if len(sample) else np.zeros((1, dim)), trees, depth)
    bc = spark.sparkContext.broadcast(forest)
    few = slice(None, None, max(1, len(sample) // 8192))
    bc_sample = spark.sparkContext.broadcast((sample[few], sample_id[few]))  # at most 16,384 rows, for a first bound of the scores

    def place(batches):
        for b in batches:
            for lo in range(0, b.num_rows, 4096):
                part = b.slice(lo, 4096)
                leaves = bc.value.leaves(_matrix(part.column("vec")))
                yield pa.RecordBatch.from_arrays([part.column("id"), part.column("vec"), pa.array(list(leaves), pa.list_(pa.int64()))], ["id", "vec", "leaves"])

    placed = v.select("id", "vec").mapInArrow(place, "id long, vec array<double>, leaves array<long>")
    placed_once = materialise(placed, "rp")
    rows = placed_once.select("id", "vec", "leaves", F.posexplode("leaves").alias("tree", "leaf"))
    sizes = np.zeros((trees, 1 << depth), np.int64)
    for r in placed_once.select(F.posexplode("leaves").alias("tree", "leaf")).groupBy("tree", "leaf").count().collect():
        sizes[r["tree"], r["leaf"]] = r["count"]
    budget = share * n

    # Ranges of leaves of about CELL rows; a leaf beyond that is a range of its own, salted.
    cell = np.zeros((trees, 1 << depth), np.int64)
    salts: dict[int, int] = {}
    cells = 0
    for t in range(trees):
        held = 0
        for leaf in range(1 << depth):
            s = int(sizes[t, leaf])
            if held and held + s > CELL:
                cells, held = cells + 1, 0
            cell[t, leaf] = cells
            held += s
            if s > CELL:
                salts[cells] = -(-s // CELL)
        cells += 1
    def cut(batches):
        m = bc.value
        for b in batches:
            for lo in range(0, b.num_rows, 256):
                part = b.slice(lo, 256)
                q = _matrix(part.column("vec"))
                stop = m.stop(q, sizes, budget)
                visits = np.zeros((len(q), cells), bool)
                for t in range(trees):
                    r, leaf = np.nonzero(m.priorities(q, t) <= stop[:, None])
                    visits[r, cell[t, leaf]] = True
                # Rows under the 2k-th best of the sample are hardly among the k nearest found.
                near, near_id = bc_sample.value
                bound = np.full(len(q), -np.inf)
                if len(near) > 2 * k:
                    s = q @ near.T
                    s[part.column("id").to_numpy()[:, None] == near_id[None]] = -np.inf
                    _, again = np.unique(near_id, return_index=True)  # an id counts once
                    s = s[:, again]
                    if s.shape[1] > 2 * k:
                        top = -np.partition(-s, 2 * k - 1, 1)[:, 2 * k - 1]
                        bound = top - 1e-9 * np.maximum(np.abs(s, where=np.isfinite(s), out=np.zeros_like(s)).max(1), 1e-300)
                yield pa.RecordBatch.from_arrays([part.column("id"), part.column("vec"), pa.array(stop), pa.array(bound), pa.array([np.flatnonzero(x) for x in visits], pa.list_(pa.int64()))], ["query_id", "q", "stop", "bound", "cells"])

    queries = v.where("isq").groupBy("id").agg(F.min("vec").alias("vec")).mapInArrow(cut, "query_id long, q array<double>, stop double, bound double, cells array<long>")
    queries = materialise(queries, "rp")
    blocks = max(1, -(-queries.count() // QUERY_BLOCK))
    lut = spark.createDataFrame([(t, leaf, int(cell[t, leaf]), salts.get(int(cell[t, leaf]), 1)) for t in range(trees) for leaf in range(1 << depth)], "tree int, leaf long, cell long, salts int")
    data = rows.join(F.broadcast(lut), ["tree", "leaf"]).select(  # at most trees x 2^max_depth rows
        "tree", "cell", F.pmod(F.xxhash64("id", "vec"), F.col("salts")).cast("long").alias("salt"), "id", "vec", "leaves", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block")
    )
    every = lut.select("cell", "salts").distinct()
    asked = queries.select("query_id", "q", "stop", "bound", F.pmod(F.xxhash64("query_id", F.lit("b")), F.lit(blocks)).cast("int").alias("block"), F.explode("cells").alias("cell"))
    asked = asked.join(F.broadcast(every), "cell").select("query_id", "q", "stop", "bound", "cell", "block", F.explode(F.sequence(F.lit(0).cast("long"), F.col("salts").cast("long") - 1)).alias("salt"))
    out_schema = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.float64())])

    def rerank(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows or not right.num_rows:
            return out_schema.empty_table()
        t = left.column("tree")[0].as_py()
        x, xid = _matrix(left.column("vec")), left.column("id").to_numpy()
        leaves = np.asarray(left.column("leaves").combine_chunks().flatten()).reshape(len(x), -1)
        ids, scs, qids = [], [], []
        for a in range(0, right.num_rows, 512):
            part = right.slice(a, 512)
            q, qid = _matrix(part.column("q")), part.column("query_id").to_numpy()
            stop, bound = part.column("stop").to_numpy(), part.column("bound").to_numpy()
            found = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))]
            for b in range(0, len(x), CHUNK):
                found += _nearest(bc.value, t, q, qid, stop, bound, x[b : b + CHUNK], xid[b : b + CHUNK], leaves[b : b + CHUNK])
            r, i, s = (np.concatenate(z) for z in zip(*found))
            order = np.lexsort((i, -s, r))
            r, i, s = r[order], i[order], s[order]
            new = np.ones(len(r), bool)
            new[1:] = (r[1:] != r[:-1]) | (i[1:] != i[:-1])
            r, i, s = r[new], i[new], s[new]
            first = np.searchsorted(r, r)
            ok = np.arange(len(r)) - first < k
            qids.append(qid[r[ok]]), ids.append(i[ok]), scs.append(s[ok])
        return pa.table([np.concatenate(qids), np.concatenate(ids), np.concatenate(scs)], schema=out_schema)

    def run(wanted: DataFrame) -> DataFrame:
        pairs = data.groupBy("cell", "salt", "block").cogroup(wanted.groupBy("cell", "salt", "block"))
        return materialise(pairs.applyInArrow(rerank, "query_id long, vec_id long, score double"), "rp")

    near = run(asked)
    have = near.groupBy("query_id").agg(F.countDistinct("vec_id").alias("have"))
    short = queries.where("bound > double('-Infinity')").select("query_id").join(have, "query_id", "left").where(F.coalesce("have", F.lit(0)) < k).select("query_id")
    if short.take(1):
        again = asked.join(short, "query_id").withColumn("bound", F.lit(float("-inf")))
        near = near.join(short, "query_id", "left_anti").unionByName(run(again))
    best = near.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    order = W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return best.select("query_id", F.row_number().over(order).alias("rank"), "vec_id", "score").where(F.col("rank") <= k)
