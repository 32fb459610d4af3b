"""Removal of bytes covered by repeated 100-byte strings, from merged Burrows-Wheeler
transforms of document shards.

Alignment.  Every 100-byte window has an anchor, the rightmost least hash of its 32-byte
strings.  Equal windows have equal anchors at equal offsets, so windows fall into
classes, (anchor, offset), that can be treated apart: the suffixes of a class are already
aligned.  Anchors that occur once in the corpus are dropped after an exact count.

Transforms.  The segments around one anchor are a text collection.  Its transform is built
column by column from the right, as for the transform of a set of strings: the order of the
suffixes that start in column c + 1 is refined, by a stable partition on the symbols in
column c (the transform's column c: symbols in the order of the suffixes after them), into
the order of those that start in column c.  Common prefixes follow with it: equal symbols
extend the least common prefix between their old places by one.  Runs with common prefixes
of 100 or more are the repeated intervals; all but the first start (smaller document, then
earlier start) of a run are repeats.

Shards and their merge.  A block of documents is a shard.  It reduces its own collection
first, so that of each distinct window one start leaves the shard, and emits the transform
of what is left, not its text.  The merge of all shards keeps an interleave, for every place
in the common order the shard that stands there, and refines it column by column: the next
symbol of each place is read from its shard's transform in the shard's own order, a stable
partition gives the next interleave, and common prefixes and repeated intervals follow as
above.  No suffix is sorted anew, and a string is seen at most once per shard, even a line
with a third of all occurrences.  Whole-text copies are found by their text, one document
each going on.

Edge cases: null text is empty; texts under 100 bytes lose nothing; rows with equal
doc_id and text are one document and get one result each; equal doc_id with different
texts: ordered by a hash of the text; a null doc_id comes last; an empty table gives an
empty result; only doc_id and text are read.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import STEP, U64, as_bytes, column, materialise, mix64, partitions, pieces, prefix_hash

WIDTH = 100
GRAM = 32
REACH = WIDTH - GRAM  # windows start up to this far before their anchor
COLS = REACH + WIDTH
PAD = 0xFF
BLOCK_BYTES = 12 << 20
LAST = np.iinfo(np.int64).max
META = np.dtype([("key", "<u8"), ("doc", "<i8"), ("h", "<i8"), ("block", "<i4"), ("at", "<i8"), ("lo", "<i4"), ("n", "<i4")])


def anchors(buf: np.ndarray, offs: np.ndarray):
    """Yield (document, anchor hash, anchor, first, last) arrays: the windows that start in
    [first, last] (byte positions in the document) have this anchor."""
    for i, j in pieces(offs):
        if j - i == 1 and offs[j] - offs[i] > STEP:  # a long document, in overlapping parts
            for s in range(int(offs[i]), int(offs[j]), STEP):
                e = min(s + STEP + WIDTH - 1, int(offs[j]))
                if e - s >= WIDTH:
                    d, k, a, lo, hi = _anchors(buf[s:e], np.array([0, e - s]))
                    yield d + i, k, a + s - offs[i], lo + s - offs[i], hi + s - offs[i]
        else:
            d, k, a, lo, hi = _anchors(buf[offs[i] : offs[j]], offs[i : j + 1] - offs[i])
            base = offs[i:j] - offs[i]
            yield d + i, k, a - base[d], lo - base[d], hi - base[d]


def _anchors(b: np.ndarray, offs: np.ndarray):
    n = len(b) - WIDTH + 1
    none = np.zeros(0, np.int64)
    if n <= 0:
        return none, none.view(U64), none, none, none
    p, inv = prefix_hash(b)
    m = len(b) - GRAM + 1
    h = mix64((p[GRAM:] - p[:-GRAM]) * inv[:m])
    low = U64((1 << 24) - 1)
    best = (h & ~low) | (low - np.arange(m, dtype=U64))
    width = 1
    while width * 2 <= REACH + 1:
        best = np.minimum(best[:-width], best[width:])
        width *= 2
    rest = REACH + 1 - width
    best = np.minimum(best[: len(best) - rest], best[rest:]) if rest else best
    at = (low - (best[:n] & low)).astype(np.int64)
    ok = np.zeros(n + 1, bool)
    size = np.diff(offs)
    start, stop = offs[:-1][size >= WIDTH], offs[1:][size >= WIDTH] - WIDTH + 1
    mark = np.zeros(n + 2, np.int8)
    np.add.at(mark, start, 1)
    np.add.at(mark, stop, -1)
    ok = np.cumsum(mark[:n]).astype(bool)
    edge = np.ones(n, bool)
    edge[1:] = (at[1:] != at[:-1]) | (ok[1:] != ok[:-1])
    edge[start] = True
    lo = np.flatnonzero(edge)
    hi = np.r_[lo[1:] - 1, n - 1]
    keep = ok[lo]
    lo, hi = lo[keep], hi[keep]
    return np.searchsorted(offs, lo, "right") - 1, h[at[lo]], at[lo], lo, hi


def refine(cls: np.ndarray, rank: np.ndarray, column, shard: np.ndarray | None = None, flags: bool = True) -> np.ndarray:
    """The interleave refinement of segments that stand by class, then by shard, then in their
    shard's order.  ``column(c, order, slot)``: the symbols in column c in the order of the
    suffixes of column c + 1, ``order`` being the segments there and ``slot`` the places of
    their shards' transforms.  Returns (segments, REACH + 1) flags, the window that starts in
    this column repeats one of a smaller rank; or, without ``flags``, the transform."""
    m = len(cls)
    out = np.zeros((REACH + 1, m), bool) if flags else np.empty((COLS, m), np.uint8)
    order, slot = np.arange(m), np.arange(m)
    head = np.ones(m, bool)
    head[1:] = cls[1:] != cls[:-1]
    group = np.cumsum(head) - 1
    lcp = np.zeros(m, np.int32)
    for col in range(COLS - 1, -1, -1):
        sym = column(col, order, slot)
        if not flags:
            out[col] = sym
        differ = np.zeros(m, bool)
        differ[1:] = (sym[1:] != sym[:-1]) & ~head[1:]
        lcp += 1
        if differ.any():
            hit = np.zeros(group[-1] + 1, bool)
            hit[group[differ]] = True
            at = np.flatnonzero(hit[group])
            key = group[at].astype(np.int64) << 8 | sym[at]
            perm = np.argsort(key, kind="stable")
            if flags:
                old = lcp[at]
                new = np.ones(len(at), np.int32)
                same = np.flatnonzero(key[perm][1:] == key[perm][:-1])
                if len(same):
                    # The least common prefix over the old places between two neighbours.
                    span = np.empty(2 * len(same), np.int64)
                    span[0::2], span[1::2] = perm[same] + 1, perm[same + 1] + 1
                    new[same + 1] = np.minimum.reduceat(np.r_[old, np.int32(1)], span)[0::2]
                fresh = np.ones(len(at), bool)
                fresh[same + 1] = False
                new[fresh] = 0
                lcp[at] = new
            order[at] = order[at[perm]]
            sym[at] = sym[at[perm]]
            if shard is not None:
                # The new interleave: each shard's places are its transform's, in their order.
                slot[at[np.argsort(group[at].astype(np.int64) << 32 | shard[order[at]], kind="stable")]] = at
        if flags:
            lcp[head] = 0
            lcp[sym == PAD] = 0
            if col <= REACH:
                first = lcp < WIDTH
                if not first.all():
                    begin = np.flatnonzero(first)
                    least = np.minimum.reduceat(rank[order], begin)
                    out[col, order] = rank[order] > np.repeat(least, np.diff(np.r_[begin, m]))
    return out.T if flags else out


def columns_of(meta: np.ndarray, begin: np.ndarray, text: np.ndarray) -> np.ndarray:
    """(COLS, segments) symbols, PAD outside a segment; a segment's text begins in the column of
    its first window."""
    first = (REACH - (meta["at"] - meta["lo"])).astype(np.int64)
    size = meta["n"].astype(np.int64) + WIDTH - 1
    own = np.repeat(np.arange(len(meta)), size)
    step = np.arange(len(own)) - np.repeat(np.cumsum(size) - size, size)
    cols = np.full((COLS, len(meta)), PAD, np.uint8)
    cols[first[own] + step, own] = text[np.repeat(begin, size) + step]
    return cols


def _runs(flags: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows, first and last columns of the runs of True in each row."""
    pad = np.zeros((flags.shape[0], flags.shape[1] + 2), np.int8)
    pad[:, 1:-1] = flags
    d = np.diff(pad, axis=1)
    r, a = np.nonzero(d == 1)
    _, z = np.nonzero(d == -1)
    return r, a, z - 1


def _ranks(meta: np.ndarray) -> np.ndarray:
    rank = np.empty(len(meta), np.int64)
    rank[np.lexsort((meta["at"], meta["h"], meta["doc"]))] = np.arange(len(meta))
    return rank


def _batches(cls: np.ndarray, by: np.ndarray, batch: int):
    """Rows of whole classes, about ``batch`` at a time, in the order ``by``."""
    cut = np.flatnonzero(np.r_[True, cls[by][1:] != cls[by][:-1]]) if len(by) else np.zeros(0, np.int64)
    ends = np.r_[cut[1:], len(by)] if len(by) else cut
    i = 0
    while i < len(cut):
        j = max(i + 1, int(np.searchsorted(ends, cut[i] + batch, "right")))
        yield by[cut[i] : ends[j - 1]]
        i = j


def _valid(meta: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Columns in which a window of the segment starts, and the first of them."""
    first = (REACH - (meta["at"] - meta["lo"])).astype(np.int64)
    col = np.arange(REACH + 1)
    return (col >= first[:, None]) & (col < (first + meta["n"])[:, None]), first


def _gone(meta: np.ndarray, flags: np.ndarray) -> np.ndarray:
    """(block, doc, h, start, end) of the bytes that the flagged windows cover."""
    valid, first = _valid(meta)
    r, a, z = _runs(flags & valid)
    return np.stack([meta["block"][r], meta["doc"][r], meta["h"][r], meta["lo"][r] + a - first[r], meta["lo"][r] + z - first[r] + WIDTH]).astype(np.int64)


def reduce_shard(meta: np.ndarray, text: np.ndarray, batch: int = 1 << 14):
    """Repeats among a shard's segments, and the transform of what is first.

    Returns removed (block, doc, h, start, end), the meta of the segments left, by class and
    rank, and their transform (COLS, segments).  ``text``: the segments' bytes, one after another."""
    end = np.cumsum(meta["n"].astype(np.int64) + WIDTH - 1)
    begin = end - (meta["n"] + WIDTH - 1)
    _, cls = np.unique(meta["key"], return_inverse=True)
    rank = _ranks(meta)
    gone, metas, bwts = [np.zeros((5, 0), np.int64)], [meta[:0]], [np.zeros((COLS, 0), np.uint8)]
    for rows in _batches(cls, np.lexsort((rank, cls)), batch):
        part = meta[rows]
        cols = columns_of(part, begin[rows], text)
        flags = refine(cls[rows], rank[rows], lambda c, order, slot, cols=cols: cols[c][order])
        gone.append(_gone(part, flags))
        valid, first = _valid(part)
        r, a, z = _runs(valid & ~flags)  # by segment, so still by class and rank
        left = part[r].copy()
        left["lo"] += (a - first[r]).astype(np.int32)
        left["n"] = z - a + 1
        size = left["n"].astype(np.int64) + WIDTH - 1
        _, start = _valid(left)
        kept = np.full((COLS, len(left)), PAD, np.uint8)
        own = np.repeat(np.arange(len(left)), size)
        place = start[own] + np.arange(len(own)) - np.repeat(np.cumsum(size) - size, size)
        kept[place, own] = cols[place, r[own]]
        metas.append(left)
        bwts.append(refine(cls[rows][r], rank[rows][r], lambda c, order, slot, kept=kept: kept[c][order], flags=False))
    return np.concatenate(gone, 1), np.concatenate(metas), np.concatenate(bwts, 1)


def merge_shards(metas: list[np.ndarray], bwts: list[np.ndarray], batch: int = 1 << 14) -> np.ndarray:
    """Repeats between shards, (block, doc, h, start, end), from their transforms alone.  A class
    that one shard has alone has nothing left to merge."""
    meta = np.concatenate(metas)
    shard = np.repeat(np.arange(len(metas)), [len(m) for m in metas])
    _, cls = np.unique(meta["key"], return_inverse=True)
    rank = _ranks(meta)
    by = np.lexsort((np.arange(len(meta)), shard, cls))
    c, s = cls[by], shard[by]
    lone = np.ones(int(cls.max(initial=-1)) + 1, bool)
    lone[c[1:][(c[1:] == c[:-1]) & (s[1:] != s[:-1])]] = False
    by = by[~lone[c]]
    base = np.cumsum([0, *(len(m) for m in metas)])
    gone = [np.zeros((5, 0), np.int64)]
    for rows in _batches(cls, by, batch):
        bwt = np.empty((COLS, len(rows)), np.uint8)
        for i in np.unique(shard[rows]):
            own = np.flatnonzero(shard[rows] == i)
            bwt[:, own] = bwts[i][:, rows[own] - base[i]]
        flags = refine(cls[rows], rank[rows], lambda c, order, slot, bwt=bwt: bwt[c][slot], shard[rows])
        gone.append(_gone(meta[rows], flags))
    return np.concatenate(gone, 1)


def _by(dest: np.ndarray):
    """(destination, its rows) of an array of destinations."""
    order = np.argsort(dest, kind="stable")
    d = dest[order]
    cut = np.flatnonzero(np.r_[True, d[1:] != d[:-1]]) if len(d) else np.zeros(0, np.int64)
    for a, z in zip(cut, np.r_[cut[1:], len(d)] if len(d) else cut):
        yield int(d[a]), order[a:z]


def _one_each(t: pa.Table):
    """Distinct texts of a block with their least doc_id; (text array, ids, hashes, rows by text)."""
    texts, ids = t.column("text").to_pylist(), t.column("ids").to_pylist()
    at: dict[str, int] = {}
    rows: list[list] = []
    keep: list[int] = []
    for r, (x, own) in enumerate(zip(texts, ids)):
        if x not in at:
            at[x] = len(rows)
            rows.append([])
            keep.append(r)
        rows[at[x]] += own
    arr = t.column("text").combine_chunks().take(pa.array(keep, pa.int64()))
    h = t.column("h").combine_chunks().take(pa.array(keep, pa.int64())).to_numpy()
    least = np.array([min((LAST if v is None else v) for v in r) for r in rows], np.int64)
    return arr, least, h, rows


def dedup(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 of every row."""
    return _run(docs, texts=False)


def kept_text(docs: DataFrame) -> DataFrame:
    """The same with ``kept``, the remaining bytes."""
    return _run(docs, texts=True)


def _run(docs: DataFrame, texts: bool) -> DataFrame:
    spark = docs.sparkSession
    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    size = d.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = int(max(1, -(-size // BLOCK_BYTES), min(partitions(spark), size >> 20)))
    buckets = int(max(partitions(spark), size >> 25))  # about 32 MB of text each
    d = d.withColumn("h", F.xxhash64("text")).withColumn("block", F.pmod("h", F.lit(blocks)).cast("int"))

    def count(batches):
        for b in batches:
            buf, offs = as_bytes(column(b, "text"))
            block = column(b, "block").to_numpy()
            keys, where = [], []
            for doc, key, _, _, _ in anchors(buf, offs):
                keys.append(key)
                where.append(block[doc])
            if not keys:
                continue
            key, blk = np.concatenate(keys), np.concatenate(where)
            rows = [(t, key[r].tobytes(), blk[r].astype(np.int32).tobytes()) for t, r in _by((key % U64(buckets)).astype(np.int64))]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows)], ["bucket", "keys", "blocks"])

    def meet(t: pa.Table) -> pa.Table:
        key = np.frombuffer(b"".join(t.column("keys").to_pylist()), U64)
        blk = np.frombuffer(b"".join(t.column("blocks").to_pylist()), np.int32)
        order = np.lexsort((blk, key))
        key, blk = key[order], blk[order]
        same = key[1:] == key[:-1]
        twice = np.r_[False, same] | np.r_[same, False]
        new = np.ones(len(key), bool)
        new[1:] = ~(same & (blk[1:] == blk[:-1]))
        key, blk = key[twice & new], blk[twice & new]
        rows = [(b, key[r].tobytes()) for b, r in _by(blk)]
        return pa.table([pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.binary())], names=["block", "keys"])

    hot = d.mapInArrow(count, "bucket long, keys binary, blocks binary").groupBy("bucket").applyInArrow(meet, "block int, keys binary")

    def gather(batches):
        """Copies within a batch travel as one text with its doc_ids."""
        for b in batches:
            seen: dict[str, int] = {}
            first, ids = [], []
            for r, (x, i) in enumerate(zip(column(b, "text").to_pylist(), column(b, "doc_id").to_pylist())):
                if x in seen:
                    ids[seen[x]].append(i)
                else:
                    seen[x] = len(first)
                    first.append(r)
                    ids.append([i])
            take = b.take(pa.array(first, pa.int64()))
            yield pa.RecordBatch.from_arrays([take.column("block"), take.column("h"), take.column("text"), pa.array(ids, pa.list_(pa.int64()))], ["block", "h", "text", "ids"])

    sent = d.mapInArrow(gather, "block int, h long, text string, ids array<long>")

    def cut(left: pa.Table, right: pa.Table) -> pa.Table:
        schema = pa.schema([("bucket", pa.int64()), ("meta", pa.binary()), ("bwt", pa.binary()), ("gone", pa.binary())])
        if not left.num_rows or not right.num_rows:
            return schema.empty_table()
        block = left.column("block")[0].as_py()
        known = np.unique(np.frombuffer(b"".join(right.column("keys").to_pylist()), U64))
        arr, least, h, _ = _one_each(left)
        buf, offs = as_bytes(arr)
        metas, segs = [], []
        for doc, key, at, lo, hi in anchors(buf, offs):
            pos = np.minimum(np.searchsorted(known, key), len(known) - 1)
            ok = known[pos] == key
            doc, key, at, lo, hi = doc[ok], key[ok], at[ok], lo[ok], hi[ok]
            m = np.zeros(len(doc), META)
            m["key"], m["doc"], m["h"], m["block"], m["at"], m["lo"], m["n"] = key, least[doc], h[doc], block, at, lo, hi - lo + 1
            n = m["n"].astype(np.int64) + WIDTH - 1
            segs.append(buf[np.repeat(offs[doc] + lo, n) + np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)])
            metas.append(m)
        if not metas:
            return schema.empty_table()
        gone, meta, bwt = reduce_shard(np.concatenate(metas), np.concatenate(segs))
        rows = [(-1 - block, None, None, np.ascontiguousarray(gone).tobytes())]
        for t, r in _by((meta["key"] % U64(buckets)).astype(np.int64)):
            rows.append((t, meta[r].tobytes(), pa.compress(np.ascontiguousarray(bwt[:, r]).tobytes(), codec="zstd", asbytes=True), None))
        return pa.table([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)

    shards = materialise(sent.groupBy("block").cogroup(hot.groupBy("block")).applyInArrow(cut, "bucket long, meta binary, bwt binary, gone binary"), "bwt")

    def merge(t: pa.Table) -> pa.Table:
        metas = [np.frombuffer(x, META) for x in t.column("meta").to_pylist()]
        bwts = [np.frombuffer(pa.decompress(x, COLS * len(m), codec="zstd", asbytes=True), np.uint8).reshape(COLS, -1) for x, m in zip(t.column("bwt").to_pylist(), metas)]
        gone = merge_shards(metas, bwts)
        rows = [(b, np.ascontiguousarray(gone[:, r]).tobytes()) for b, r in _by(gone[0])]
        return pa.table([pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.binary())], names=["block", "gone"])

    merged = shards.where("bucket >= 0").select("bucket", "meta", "bwt").groupBy("bucket").applyInArrow(merge, "block int, gone binary")
    own = shards.where("bucket < 0").select((-1 - F.col("bucket")).cast("int").alias("block"), "gone")

    def finish(left: pa.Table, right: pa.Table) -> pa.Table:
        parts = [np.frombuffer(x, np.int64).reshape(5, -1) for x in right.column("gone").to_pylist()] if right.num_rows else []
        gone = np.concatenate([np.zeros((5, 0), np.int64), *parts], 1)
        arr, least, h, rows = _one_each(left) if left.num_rows else (pa.array([], pa.string()), np.zeros(0, np.int64), np.zeros(0, np.int64), [])
        at = {k: i for i, k in enumerate(zip(least.tolist(), h.tolist()))}
        spans: dict[int, list] = {}
        for doc, hh, s, e in zip(*gone[1:].tolist()):
            spans.setdefault(at[doc, hh], []).append((s, e))
        out: list = []
        empty = hashlib.sha256(b"").hexdigest()
        for i, text in enumerate(arr.to_pylist()):
            raw = text.encode()
            runs, kept, last = [], [], 0
            for s, e in sorted(spans.get(i, ())):
                if runs and s <= runs[-1][1]:
                    runs[-1][1] = max(runs[-1][1], e)
                else:
                    runs.append([s, e])
            for s, e in runs:
                kept.append(raw[last:s])
                last = e
            rest = b"".join([*kept, raw[last:]])
            first = (len(raw), len(raw) - len(rest), len(runs), hashlib.sha256(rest).hexdigest(), rest if texts else None)
            copy = (len(raw), len(raw), 1, empty, b"" if texts else None) if len(raw) >= WIDTH else first
            out += [(v, *(first if (LAST if v is None else v) == least[i] else copy)) for v in rows[i]]
        types = [pa.int64()] * 4 + [pa.string(), pa.binary()]
        cols = list(zip(*out)) if out else [[]] * 6
        return pa.table([pa.array(c, t) for c, t in zip(cols, types)], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"])

    result = sent.groupBy("block").cogroup(merged.unionByName(own).groupBy("block")).applyInArrow(finish, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary")
    return result if texts else result.drop("kept")
