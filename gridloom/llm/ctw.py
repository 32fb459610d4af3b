"""Language-model scoring by context-tree weighting over bytes.

Every byte is decomposed into 8 binary decisions; a decision's place in the byte (its
prefix, 255 of them) has a tree over the ``DEPTH`` preceding bytes.  A node estimates
with Krichevsky-Trofimov counts and is weighted half and half against the product of its
children, so all depths are mixed by how well they explain the training texts.  The
frozen tree then predicts: p_s = w_s KT_s + (1 - w_s) p_child, an unseen node giving 1/2.
Texts are ASCII-lowered, preceded and ended by the byte 0xFF (never part of UTF-8), so
the probabilities of all texts sum to one.

Distribution.  Texts are dealt, compressed, to blocks of about ``BLOCK_BYTES`` by a hash
of doc_id; scores do not depend on the number of blocks.  A block yields its distinct (context, byte) grams and tokens with their training counts, in
packed columns; grams are dealt by the two nearest context bytes, so that each such subtree
is weighted in one task, and what meets there is written once with its summed counts.  The
depths 0 and 1 above, at most 65,280 nodes, are summed and broadcast.  Each block then
gets back the log-probabilities of just its own grams and the counts of its own tokens, in
the order of its keys, which it works out again from its texts.

Edge cases: null text is empty and is one end token; null doc_id counts as the empty
string in the fold; repeated rows are learned and scored each; an empty table, or one
without training rows, gives defined scores (KT of no counts: 8 bits a byte); other
columns are not read.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import U64, as_bytes, column, lower_ascii, materialise, mix64, partitions, pieces, word_hashes, word_spans

DEPTH = 6
BLOCK_BYTES = 12 << 20
#: log10 probabilities travel as multiples of 2^-40, below the error of the log-gamma series.
FINE = 2.0**40
END_TOKEN = 0  # a token hash of its own; word hashes are odd
_LN2 = math.log(2.0)


def grams(low: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Codes (DEPTH context bytes, byte) of every byte and end, and their number per document."""
    n = np.diff(offs)
    m = n + 1
    at = np.cumsum(m + DEPTH) - (m + DEPTH)
    padded = np.full(int((m + DEPTH).sum()), 0xFF, np.uint8)
    padded[np.arange(len(low)) + np.repeat(at + DEPTH - offs[:-1], n)] = low
    code = padded[: len(padded) - DEPTH].astype(U64)
    for i in range(1, DEPTH + 1):
        code = (code << U64(8)) | padded[i : len(padded) - DEPTH + i]
    keep = np.ones(len(code), bool)
    inner = (at[1:, None] + np.arange(-DEPTH, 0)).ravel()
    keep[inner[inner < len(code)]] = False
    return code[keep], m


def tokens(low: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Token hashes (end token last in each document) and their number per document."""
    s, e, n = word_spans(low, offs)
    out = np.zeros(len(s) + len(n), np.int64)
    ends = np.cumsum(n + 1) - 1
    is_word = np.ones(len(out), bool)
    is_word[ends] = False
    out[is_word] = (word_hashes(low, s, e) | U64(1)).view(np.int64)
    return out, n + 1


def _merge(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    key = np.concatenate([p[0] for p in parts])
    cnt = np.concatenate([p[1] for p in parts])
    order = np.argsort(key, kind="stable")
    key, cnt = key[order], cnt[order]
    cut = np.flatnonzero(np.r_[True, key[1:] != key[:-1]]) if len(key) else np.zeros(0, np.int64)
    return key[cut], np.add.reduceat(cnt, cut) if len(cut) else cnt


def _count(codes: np.ndarray, learn: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct codes with the number of those to learn from."""
    s = np.sort((codes.view(U64) << U64(1)) | learn.astype(U64)) if codes.dtype == U64 else None
    if s is not None:
        key, bit = s >> U64(1), (s & U64(1)).astype(np.int64)
    else:
        order = np.argsort(codes, kind="stable")
        key, bit = codes[order], learn[order].astype(np.int64)
    cut = np.flatnonzero(np.r_[True, key[1:] != key[:-1]]) if len(key) else np.zeros(0, np.int64)
    return key[cut].view(np.int64), np.add.reduceat(bit, cut) if len(cut) else bit


class Table:
    """Sorted or unsorted int64 keys -> values, by open hashing in a few vector steps."""

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        self.levels = []
        left = np.arange(len(keys))
        level = 0
        while len(left):
            bits = max(4, int(len(left)).bit_length() + 1)
            slot = self._slot(keys[left], bits, level)
            owner = np.full(1 << bits, -1, np.int64)
            owner[slot] = left
            placed = owner[slot] == left
            used = owner >= 0
            k, v = np.full(1 << bits, np.iinfo(np.int64).min, np.int64), np.zeros(1 << bits, values.dtype)
            k[used], v[used] = keys[owner[used]], values[owner[used]]
            self.levels.append((bits, k, v))
            left = left[~placed]
            level += 1

    @staticmethod
    def _slot(keys, bits, level):
        x = keys.view(U64) * U64(0x9E3779B97F4A7C15 + 2 * level * 0x632BE59BD9B4E019 & (1 << 64) - 1 | 1)
        return ((x ^ (x >> U64(31))) * U64(0xBF58476D1CE4E5B9) >> U64(64 - bits)).astype(np.int64)

    def get(self, keys: np.ndarray, dtype=np.float64) -> np.ndarray:
        out = np.zeros(len(keys), dtype)
        left = None
        for level, (bits, k, v) in enumerate(self.levels):
            q = keys if left is None else keys[left]
            slot = self._slot(q, bits, level)
            hit = k[slot] == q
            if left is None:
                out = np.where(hit, v[slot], 0).astype(dtype, copy=False)
                left = np.flatnonzero(~hit)
            else:
                out[left[hit]] = v[slot[hit]]
                left = left[~hit]
            if not len(left):
                break
        return out


# ------------------------------------------------------------------ the tree
def _lgamma(x: np.ndarray) -> np.ndarray:
    shift = np.zeros_like(x)
    for i in range(8):
        shift += np.log(x + i)
    y = x + 8
    return (y - 0.5) * np.log(y) - y + 0.5 * math.log(2 * math.pi) + 1 / (12 * y) - 1 / (360 * y**3) + 1 / (1260 * y**5) - shift


def log_kt(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Natural log of the KT probability of a zeros and b ones."""
    return _lgamma(a + 0.5) + _lgamma(b + 0.5) - _lgamma(a + b + 1.0) - math.log(math.pi)


def weigh(a: np.ndarray, b: np.ndarray, below: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(log weighted probability, weight of the node's own estimate)."""
    own = log_kt(a, b)
    lw = np.logaddexp(own, below) - _LN2
    return lw, np.exp(own - _LN2 - lw)


class Subtree:
    """Nodes at depths 2..DEPTH of the grams of one or more nearest-two-byte contexts, for
    bit ``j`` of the byte.  Grams come with their contexts reversed, nearest byte first."""

    def __init__(self, code: np.ndarray, count: np.ndarray, j: int):
        byte = code & U64(0xFF)
        self.bit = ((byte >> U64(7 - j)) & U64(1)).astype(np.int64)
        pid = (U64(1) << U64(j)) | (byte >> U64(8 - j))
        ctx = code >> U64(8)
        near = np.zeros_like(ctx)
        for i in range(DEPTH):  # nearest byte into the highest place
            near = (near << U64(8)) | ((ctx >> U64(8 * i)) & U64(0xFF))
        self.index, self.nodes = [], []
        key, a, b = (near << U64(8)) | pid, np.where(self.bit == 0, count, 0).astype(np.float64), np.where(self.bit == 1, count, 0).astype(np.float64)
        below = None
        for depth in range(DEPTH, 1, -1):
            uniq, inv = np.unique(key, return_inverse=True)
            a, b = np.bincount(inv, a, len(uniq)), np.bincount(inv, b, len(uniq))
            if below is None:
                lw, w = log_kt(a, b), np.ones(len(uniq))
            else:
                lw, w = weigh(a, b, np.bincount(inv, below, len(uniq)))
            self.index.append(inv)
            self.nodes.append((a, b, w))
            self.key, self.lw = uniq, lw
            below = lw
            key = ((uniq >> U64(16)) << U64(8)) | (uniq & U64(0xFF))
        self.a, self.b = a, b

    def predict(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Per gram: probability of its bit from depth 2 down."""
        path = self.index[0]
        p = None
        for lev, (a, b, w) in enumerate(self.nodes):
            if lev:
                path = self.index[lev][path]
            kt = (np.where(self.bit == 0, a[path], b[path]) + 0.5) / (a[path] + b[path] + 1.0)
            p = kt if p is None else w[path] * kt + (1 - w[path]) * p
        return p


class Top:
    """Depths 0 and 1, dense: counts and weights by (nearest byte, prefix) and by prefix."""

    def __init__(self, rows):
        a, b, below = np.zeros((256, 256)), np.zeros((256, 256)), np.zeros((256, 256))
        for r in rows:
            a[r["near"], r["pid"]], b[r["near"], r["pid"]], below[r["near"], r["pid"]] = r["a"], r["b"], r["lw"]
        self.a1, self.b1 = a, b
        lw, self.w1 = weigh(a, b, below)
        self.a0, self.b0 = a.sum(0), b.sum(0)
        _, self.w0 = weigh(self.a0, self.b0, lw.sum(0))

    def mix(self, near, pid, bit, p):
        for a, b, w in ((self.a1[near, pid], self.b1[near, pid], self.w1[near, pid]), (self.a0[pid], self.b0[pid], self.w0[pid])):
            p = w * (np.where(bit == 0, a, b) + 0.5) / (a + b + 1.0) + (1 - w) * p
        return p


def pack(x: np.ndarray, delta: bool = False) -> bytes:
    """A compressed column; ``delta`` for sorted keys."""
    x = np.ascontiguousarray(np.diff(x, prepend=x.dtype.type(0)) if delta else x)
    planes = x.view(np.uint8).reshape(len(x), -1).T.tobytes()
    return len(planes).to_bytes(8, "little") + pa.compress(planes, codec="zstd", asbytes=True)


def unpack(data: bytes, dtype, delta: bool = False) -> np.ndarray:
    size = int.from_bytes(data[:8], "little")
    width = np.dtype(dtype).itemsize
    raw = np.frombuffer(pa.decompress(data[8:], size, codec="zstd", asbytes=True), np.uint8)
    x = np.ascontiguousarray(raw.reshape(width, -1).T).reshape(-1).view(dtype)
    return np.cumsum(x, dtype=dtype) if delta else x


def _stats(key: np.ndarray, cnt: np.ndarray) -> list[np.ndarray]:
    """near, pid, a, b, lw of the nodes at depth 2, summed by nearest byte and prefix."""
    out = []
    for j in range(8):
        s = Subtree(key.view(U64), cnt, j)
        pid, near = (s.key & U64(0xFF)).astype(np.int64), (s.key >> U64(16)).astype(np.int64)
        u, inv = np.unique(near << 8 | pid, return_inverse=True)
        out.append((u >> 8, u & 0xFF, np.bincount(inv, s.a), np.bincount(inv, s.b), np.bincount(inv, s.lw)))
    return [np.concatenate(c) for c in zip(*out)]


GATHERED = "kind int, bucket long, blocks array<long>, keys array<binary>, counts binary, n long, v long, near array<long>, pid array<long>, a array<double>, b array<double>, lw array<double>"


def gather(t: pa.Table) -> pa.Table:
    """One row for a bucket: its blocks' keys as they came, the summed counts of the distinct
    keys in order, and for grams the sums that depths 0 and 1 need."""
    kind, packed = t.column("kind")[0].as_py(), t.column("keys").to_pylist()
    key, cnt = _merge([(unpack(k, np.int64, True), unpack(c, np.int64)) for k, c in zip(packed, t.column("vals").to_pylist())])
    stats = _stats(key, cnt) if kind == 0 else [np.zeros(0, np.int64)] * 2 + [np.zeros(0)] * 3
    cols = [kind, t.column("bucket")[0].as_py(), t.column("block").to_pylist(), packed, pack(cnt.astype(np.int64)), int(cnt.sum()), int((cnt > 0).sum()), *stats]
    types = [pa.int32(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.binary()), pa.binary(), pa.int64(), pa.int64(), *[pa.list_(pa.int64())] * 2, *[pa.list_(pa.float64())] * 3]
    return pa.table([pa.array([c], x) for c, x in zip(cols, types)], names=[x.split()[0] for x in GATHERED.split(", ")])


def _answers(batches, value):
    """For every block its keys' values, in the order of its keys; ``value``: (kind, keys, counts) -> int64."""
    for b in batches:
        for r in range(b.num_rows):
            kind, bucket, blocks, keys, counts = (b.column(c)[r].as_py() for c in ("kind", "bucket", "blocks", "keys", "counts"))
            own = [unpack(k, np.int64, True) for k in keys]
            key = np.unique(np.concatenate(own))
            val = value(kind, key, unpack(counts, np.int64))
            for block, k in zip(blocks, own):
                yield pa.RecordBatch.from_pydict({"block": [block], "kind": pa.array([kind], pa.int32()), "bucket": [bucket], "vals": [pack(val[np.searchsorted(key, k)])]})


def log_probs(code: np.ndarray, cnt: np.ndarray, top: Top) -> np.ndarray:
    """log10 probability of each gram's byte in its context."""
    near = ((code >> U64(8)) & U64(0xFF)).astype(np.int64)
    byte = (code & U64(0xFF)).astype(np.int64)
    total = np.zeros(len(code))
    for j in range(8):
        s = Subtree(code, cnt, j)
        total += np.log10(top.mix(near, (1 << j) | (byte >> (8 - j)), s.bit, s.predict()))
    return total


# -------------------------------------------------------------- distribution
def fold(doc_id, mod: int = 7, keep: int = 2):
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % mod == keep


def _deal(batches):
    """Rows (block, ids, held, sizes, texts): the documents of a batch that go to one block, compressed."""
    codec = pa.Codec("zstd", compression_level=3)
    for b in batches:
        buf, offs = as_bytes(column(b, "text"))
        ids, held, block = column(b, "doc_id"), column(b, "held"), column(b, "block").to_numpy()
        order = np.argsort(block, kind="stable")
        cut = np.flatnonzero(np.r_[True, np.diff(block[order]) != 0]) if len(order) else np.zeros(0, np.int64)
        ends = np.r_[cut[1:], len(order)].astype(np.int64)
        data, sizes = [], []
        for x, y in zip(cut, ends):
            r = order[x:y]
            sizes.append((offs[r + 1] - offs[r]).astype(np.int64).tobytes())
            raw = b"".join([buf[offs[i] : offs[i + 1]].tobytes() for i in r])
            data.append(len(raw).to_bytes(8, "little") + codec.compress(raw, asbytes=True))
        at = pa.array(np.r_[cut, len(order)].astype(np.int32))
        take = pa.array(order)
        lists = [pa.ListArray.from_arrays(at, c.take(take)) if len(order) else pa.array([], pa.list_(c.type)) for c in (ids, held)]
        yield pa.RecordBatch.from_arrays([pa.array(block[order][cut]), *lists, pa.array(sizes, pa.binary()), pa.array(data, pa.binary())], ["block", "ids", "held", "sizes", "texts"])


def _dealt(t: pa.Table) -> tuple[np.ndarray, np.ndarray, pa.Array, np.ndarray]:
    """(bytes, offsets, ids, held) of a block's documents."""
    raw = [pa.decompress(x[8:], int.from_bytes(x[:8], "little"), codec="zstd", asbytes=True) for x in t.column("texts").to_pylist()]
    size = np.frombuffer(b"".join(t.column("sizes").to_pylist()), np.int64)
    ids, held = t.column("ids").combine_chunks().flatten(), t.column("held").combine_chunks().flatten()
    return np.frombuffer(b"".join(raw), np.uint8), np.r_[0, np.cumsum(size)], ids, held.to_numpy(zero_copy_only=False).astype(bool)


def _distinct(buf: np.ndarray, offs: np.ndarray, held: np.ndarray):
    """(keys, training counts) of a block's grams and of its tokens."""
    found: list = [[], []]
    for i, j in pieces(offs):
        low, o = lower_ascii(buf[offs[i] : offs[j]]), offs[i : j + 1] - offs[i]
        for make, into in zip((grams, tokens), found):
            code, n = make(low, o)
            into.append(_count(code, np.repeat(~held[i:j], n)))
            if len(into) > 8:
                into[:] = [_merge(into)]
    return [_merge(x) for x in found]


def _by_bucket(key: np.ndarray, kind: int, buckets: int):
    """(order of the keys by bucket, starts and ends of the buckets' runs, their numbers)."""
    near = (key.view(U64) >> U64(8)) & U64(0xFFFF) if kind == 0 else key.view(U64)  # the nearest two bytes of the context
    dest = (mix64(near) % U64(buckets)).astype(np.int64)
    order = np.argsort(dest, kind="stable")
    dest = dest[order]
    cut = np.flatnonzero(np.r_[True, dest[1:] != dest[:-1]]) if len(dest) else np.zeros(0, np.int64)
    return order, cut, np.r_[cut[1:], len(dest)].astype(np.int64), dest[cut]


def _block_counts(t: pa.Table, buckets: int) -> pa.Table:
    buf, offs, _, held = _dealt(t)
    block = t.column("block")[0].as_py()
    rows: list = []
    for kind, (key, cnt) in enumerate(_distinct(buf, offs, held)):
        order, cut, ends, dest = _by_bucket(key, kind, buckets)
        for x, y, d in zip(cut, ends, dest.tolist()):
            r = order[x:y]
            rows.append((block, kind, d, pack(key[r], True), pack(cnt[r].astype(np.int64))))
    return pa.table([pa.array(c, x) for c, x in zip(zip(*rows), (pa.int64(), pa.int32(), pa.int64(), pa.binary(), pa.binary()))], names=["block", "kind", "bucket", "keys", "vals"])


def score(docs: DataFrame, mod: int = 7, keep: int = 2) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, n_bytes and
    bits_per_byte (the code length)."""
    spark = docs.sparkSession
    d = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), fold(F.col("doc_id"), mod, keep).alias("held"))
    size = d.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = max(1, -(-size // BLOCK_BYTES), min(partitions(spark), size >> 20))
    d = d.withColumn("block", F.pmod(F.xxhash64(F.coalesce("doc_id", F.lit(-1)), F.length("text")), F.lit(blocks)))
    buckets = max(64, partitions(spark), size >> 25)
    id_type = d.schema["doc_id"].dataType.simpleString()
    d = d.mapInArrow(_deal, f"block long, ids array<{id_type}>, held array<boolean>, sizes binary, texts binary")
    counts = d.groupBy("block").applyInArrow(lambda t: _block_counts(t, buckets), "block long, kind int, bucket long, keys binary, vals binary")
    met = materialise(counts.groupBy("bucket", "kind").applyInArrow(gather, GATHERED), "ctw")
    stat = met.where("kind = 1").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.coalesce(F.sum("v"), F.lit(0)).alias("v")).first()
    total, vocab = stat["n"], stat["v"]
    top = Top(
        met.where("kind = 0").select(F.explode(F.arrays_zip("near", "pid", "a", "b", "lw")).alias("x")).select("x.*")
        .groupBy("near", "pid").agg(F.sum("a").alias("a"), F.sum("b").alias("b"), F.sum("lw").alias("lw")).collect()  # at most 65,280 rows
    )
    bc = spark.sparkContext.broadcast(top)

    def value(kind: int, key: np.ndarray, cnt: np.ndarray) -> np.ndarray:
        return np.round(log_probs(key.view(U64), cnt, bc.value) * FINE).astype(np.int64) if kind == 0 else cnt

    values = met.select("kind", "bucket", "blocks", "keys", "counts").mapInArrow(lambda batches: _answers(batches, value), "block long, kind int, bucket long, vals binary")

    def apply(left: pa.Table, right: pa.Table) -> pa.Table:
        buf, offs, ids, held = _dealt(left)
        right = right.sort_by([("kind", "ascending"), ("bucket", "ascending")])
        kinds, vals = right.column("kind").to_numpy(), right.column("vals").to_pylist()
        look = []
        for kind, (key, _) in enumerate(_distinct(buf, offs, held)):
            order = _by_bucket(key, kind, buckets)[0]
            got = np.concatenate([unpack(vals[r], np.int64) for r in np.flatnonzero(kinds == kind)])
            look.append(Table(key[order], got))
        gram, tok = look
        cols: list = []
        for i, j in pieces(offs):
            low, o = lower_ascii(buf[offs[i] : offs[j]]), offs[i : j + 1] - offs[i]
            code, n = grams(low, o)
            lp = np.add.reduceat(gram.get(code.view(np.int64)) / FINE, np.cumsum(n) - n)
            h, m = tokens(low, o)
            c = tok.get(h)
            first = np.cumsum(m) - m
            base = np.add.reduceat(np.log10((c + 1) / (total + vocab + 1)), first)
            cols.append((m, np.add.reduceat((c > 0).astype(np.int64), first), base, lp, n - 1))
        m, k, base, lp, n = (np.concatenate(x) for x in zip(*cols))
        bits = -lp / math.log10(2) / np.maximum(n, 1)
        return pa.table([ids, held, m, k, np.full(len(m), total, np.int64), base, lp, n, bits], names=[x.split()[0] for x in schema.split(", ")])

    schema = f"doc_id {id_type}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double, n_bytes long, bits_per_byte double"
    return d.groupBy("block").cogroup(values.groupBy("block")).applyInArrow(apply, schema)
