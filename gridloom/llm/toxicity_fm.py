"""Toxicity by a factorization machine over hashed terms.

score = sigmoid(w0 + sum w_i x_i + sum_{i<j} <v_i, v_j> x_i x_j), x_i the relevance of a term's
hash bucket if the text holds it, else 0; the pairwise part learns combinations (an insult with
a group mention) that additive weights miss.

Counts of documents by bucket and label cover every training row.  A bucket's relevance is
c / (c + ``SOFT``), c the chi-squared statistic between label and presence: near 1 for telling
terms, some hundredths for others, 0 for a bucket that no training row holds.  Every one of
the 2^``BITS`` buckets has its own weights (8 factors and a linear one, with the relevance
10 MB in all), so no term is left out.  The weights are fitted on a sample of ``max_rows``
expected labelled rows, drawn by a seeded hash of doc_id, so that a rerun takes the same.

Edge cases: null or empty text has no terms and scores the model's bias; rows with a
null label are not learned from; several labels of one doc_id: toxic if any is; without
any training label or without both classes every score is the smoothed share of toxic
rows (0.05 where there are none); repeated documents score alike; only doc_id, text and toxic are read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import U64, as_bytes, column, fold_words, materialise, mix64, pieces, prefix_hash, release, tidy, word_spans

BITS = 18
THRESHOLD = 0.3
SOFT = 30.0
#: Word beginnings of so many bytes are terms as well: they carry over to unseen compounds.
PREFIXES = (5, 7)


def doc_terms(buf: np.ndarray, offs: np.ndarray, bits: int = BITS) -> tuple[np.ndarray, np.ndarray]:
    """(document, bucket) pairs, distinct: lowered runs of letters, digits and non-ASCII
    bytes, and the beginnings of longer ones."""
    spaced = fold_words(buf)
    s, e, n = word_spans(spaced, offs)
    p, inv = prefix_hash(spaced)
    h = mix64((p[e] - p[s]) * inv[s] + (e - s).astype(U64))
    doc = np.repeat(np.arange(len(n), dtype=np.uint64), n)
    docs, hashes = [doc], [h]
    for size in PREFIXES:
        long = e - s > size
        at = s[long]
        docs.append(doc[long])
        hashes.append(mix64((p[at + size] - p[at]) * inv[at] + U64(size << 32)))
    doc, h = np.concatenate(docs), np.concatenate(hashes)
    pair = np.unique((doc << U64(bits)) | (h & U64((1 << bits) - 1)))
    return (pair >> U64(bits)).astype(np.int64), (pair & U64((1 << bits) - 1)).astype(np.int64)


def _terms_of(batch: pa.RecordBatch):
    texts = column(batch, "text")
    buf, offs = as_bytes(texts)
    for i, j in pieces(offs):
        yield i, j, *doc_terms(buf[offs[i] : offs[j]], offs[i : j + 1] - offs[i])


def held(doc_id, mod: int = 4, keep: int = 2):
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % mod == keep


def training_rows(docs: DataFrame, labels: DataFrame, mod: int = 4, keep: int = 2, bits: int = BITS) -> DataFrame:
    """doc_id, terms, toxic of labelled rows outside the held-out fold.

    Terms, not texts, move to the labels; the join is by shuffle at every size, since
    the number of labels has no bound.
    """
    lab = labels.where("doc_id IS NOT NULL AND toxic IS NOT NULL").groupBy("doc_id").agg(F.max(F.col("toxic").cast("int")).alias("toxic"))
    src = docs.select("doc_id", "text").where("doc_id IS NOT NULL").where(~held(F.col("doc_id"), mod, keep))

    def read(batches):
        for b in batches:
            for i, j, d, t in _terms_of(b):
                at = np.searchsorted(d, np.arange(j - i + 1)).astype(np.int32)
                yield pa.RecordBatch.from_arrays([b.column(0).slice(i, j - i), pa.ListArray.from_arrays(pa.array(at), pa.array(t.astype(np.int32)))], ["doc_id", "terms"])

    id_type = src.schema["doc_id"].dataType.simpleString()
    return src.mapInArrow(read, f"doc_id {id_type}, terms array<int>").join(lab.hint("merge"), "doc_id")


def term_counts(rows: DataFrame, bits: int = BITS) -> DataFrame:
    """bucket (-1: all documents), n, toxic: at most 2^bits + 1 rows."""

    def count(batches):
        size = 1 << bits
        n, tox, docs, dtox = np.zeros(size, np.int64), np.zeros(size, np.int64), 0, 0
        for b in batches:
            y = column(b, "toxic").to_numpy(zero_copy_only=False).astype(np.int64)
            docs, dtox = docs + len(y), dtox + int(y.sum())
            lists = column(b, "terms")
            t = lists.flatten().to_numpy()
            n += np.bincount(t, minlength=size)
            tox += np.bincount(t, weights=np.repeat(y, lists.value_lengths().to_numpy()), minlength=size).astype(np.int64)
        if docs:
            at = np.flatnonzero(n)
            yield pa.RecordBatch.from_arrays([pa.array(np.r_[-1, at]), pa.array(np.r_[docs, n[at]]), pa.array(np.r_[dtox, tox[at]])], ["bucket", "n", "toxic"])

    part = rows.mapInArrow(count, "bucket long, n long, toxic long")
    return part.groupBy("bucket").agg(F.sum("n").alias("n"), F.sum("toxic").alias("toxic"))


def relevance(counts: pa.Table, bits: int = BITS) -> tuple[np.ndarray, int]:
    """(each bucket's relevance, training rows)."""
    bucket, count, marked = (counts.column(c).to_numpy() for c in ("bucket", "n", "toxic"))
    every = bucket < 0
    docs, toxic = int(count[every].sum()), int(marked[every].sum())
    n, tox = np.zeros(1 << bits), np.zeros(1 << bits)
    n[bucket[~every]], tox[bucket[~every]] = count[~every], marked[~every]
    share = toxic / max(docs, 1)
    spread = n * share * (1 - share) * (1 - n / max(docs, 1))
    stat = (tox - n * share) ** 2 / np.maximum(spread, 1e-9)
    return np.where(n > 0, stat / (stat + SOFT), 0.0), docs


class Machine:
    """Weights of all hash buckets and their relevance."""

    def __init__(self, x: np.ndarray, factors: int = 8, seed: int = 1):
        rng = np.random.default_rng(seed)
        self.x, self.w0, self.w = x.astype(np.float32), 0.0, np.zeros(len(x), np.float32)
        self.v = rng.normal(0, 0.05, (len(x), factors)).astype(np.float32)

    def raw(self, at: np.ndarray, term: np.ndarray, own: tuple | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Scores before the sigmoid of the documents whose terms are term[at[i]:at[i + 1]], and
        their factor sums; ``own``: the (x, w, v) that ``term`` points into."""
        x, w, v = own or (self.x, self.w, self.v)
        some = np.flatnonzero(np.diff(at))
        z, s = np.full(len(at) - 1, self.w0), np.zeros((len(at) - 1, v.shape[1]), np.float32)
        if len(some):
            part = (v * x[:, None])[term] if own else v[term] * x[term, None]
            s[some] = np.add.reduceat(part, at[some], axis=0)
            z[some] += np.add.reduceat((w * x)[term] - 0.5 * np.einsum("ij,ij->i", part, part), at[some])
            z += 0.5 * np.einsum("ij,ij->i", s, s)
        return z, s

    def fit(self, steps: list[tuple], share: float, epochs: int = 10, rate: float = 0.1, l2: float = 1e-4, seed: int = 1) -> None:
        """Logistic loss, AdaGrad over minibatches in a new order each epoch; a step touches only the
        weights of its own terms.  ``share``: of toxic rows, which sets the first bias."""
        rng = np.random.default_rng(seed)
        self.w0 = float(np.log(share / (1 - share)))
        gw, gv, g0 = np.full(len(self.w), 1e-8, np.float32), np.full(self.v.shape, 1e-8, np.float32), 1e-8
        for _ in range(epochs):
            for k in rng.permutation(len(steps)):
                y, ends, use, ix = steps[k]
                by = np.argsort(ix, kind="stable")  # the places of each term, one term after another
                docs = np.repeat(np.arange(len(y), dtype=np.int16), np.diff(ends))[by]
                cut = np.searchsorted(ix[by], np.arange(len(use)).astype(ix.dtype))
                x, w, v = self.x[use], self.w[use], self.v[use]
                z, s = self.raw(ends, ix, (x, w, v))
                err = ((1 / (1 + np.exp(-np.clip(z, -30, 30))) - y) / len(y)).astype(np.float32)
                if len(use):
                    # The derivative by v_t is x_t (the document's factor sum less x_t v_t).
                    total = np.add.reduceat(err[docs], cut) * x
                    dw = total + l2 * w
                    dv = np.add.reduceat((err[:, None] * s)[docs], cut, axis=0) * x[:, None] - (total * x)[:, None] * v + l2 * v
                    gw[use] += dw**2
                    gv[use] += dv**2
                    self.w[use] = w - rate * dw / np.sqrt(gw[use])
                    self.v[use] = v - rate * dv / np.sqrt(gv[use])
                g0 += float(err.sum()) ** 2
                self.w0 -= rate * float(err.sum()) / np.sqrt(g0)


def minibatches(start: np.ndarray, size: np.ndarray, term: np.ndarray, y: np.ndarray, batch: int = 512, seed: int = 1) -> list[tuple]:
    """(labels, ends of the documents, distinct terms, terms as places in them) of batches drawn once;
    the i-th document's terms are term[start[i]:][:size[i]]."""
    out = []
    order = np.random.default_rng(seed).permutation(len(y))
    for lo in range(0, len(y), batch):
        own = order[lo : lo + batch]
        ends = np.r_[0, np.cumsum(size[own])]
        t = term[np.arange(ends[-1]) - np.repeat(ends[:-1], size[own]) + np.repeat(start[own], size[own])]
        use, ix = np.unique(t, return_inverse=True)
        out.append((y[own], ends, use, ix.astype(np.uint16 if len(use) < 1 << 16 else np.int32)))
    return out


def train(docs: DataFrame, labels: DataFrame, max_rows: int = 40_000, factors: int = 8, mod: int = 4, keep: int = 2) -> Machine:
    """A machine fitted on rows outside the fold ``crc32(doc_id) mod mod = keep``.

    One task fits it, on the terms of max_rows expected rows: some 600 of 4 bytes a row, 100 MB
    at the default, whatever the size of the input.  To the driver come 2^BITS counts at most and
    the weights.
    """
    rows = materialise(training_rows(docs, labels, mod, keep), "tox")
    x, total = relevance(term_counts(rows).toArrow())
    # A seeded share of the rows, so that max_rows are expected at most and no sort is needed.
    drawn = F.pmod(F.xxhash64("doc_id", F.lit("fm")), F.lit(1 << 30)) < int((1 << 30) * min(1.0, max_rows / max(total, 1)))
    sample = rows.where(drawn).select("terms", "toxic", F.xxhash64("doc_id", "terms").alias("k"))
    x = x.astype(np.float32)

    def fit(batches):
        share, steps = _sample_steps(list(batches))
        m = Machine(x, factors)
        m.w0 = float(np.log(share / (1 - share)))
        if steps:
            m.fit(steps, share)
        del steps
        release()  # later tasks of this worker find it as small as before
        yield pa.RecordBatch.from_arrays([pa.array([m.w0]), pa.array([m.w.tobytes()], pa.binary()), pa.array([m.v.tobytes()], pa.binary())], ["w0", "w", "v"])

    packed = sample.mapInArrow(_squeeze, "k binary, toxic binary, size binary, n long, terms binary").repartition(1)
    got = packed.mapInArrow(fit, "w0 double, w binary, v binary").first()
    m = Machine(x, factors)
    m.w0 = float(np.log(0.05 / 0.95))
    if got:  # nothing, where Spark skips a task without rows
        m.w0, m.w, m.v = got["w0"], np.frombuffer(got["w"], np.float32), np.frombuffer(got["v"], np.float32).reshape(m.v.shape)
    del got
    tidy(docs.sparkSession)
    release()
    return m


def _squeeze(batches):
    """A batch of the sample as one row, its terms compressed."""
    for b in batches:
        lists = column(b, "terms")
        step = np.diff(lists.flatten().to_numpy(), prepend=np.int32(0))  # terms rise within a document, so differences are small
        raw = step.astype(np.int32).view(np.uint8).reshape(-1, 4).T.tobytes()
        cols = [column(b, "k").to_numpy(), column(b, "toxic").to_numpy().astype(np.int64), lists.value_lengths().to_numpy().astype(np.int64)]
        yield pa.RecordBatch.from_arrays([*[pa.array([c.tobytes()], pa.binary()) for c in cols], pa.array([len(raw)]), pa.array([pa.compress(raw, codec="zstd", asbytes=True)], pa.binary())], ["k", "toxic", "size", "n", "terms"])


def _sample_steps(parts: list[pa.RecordBatch]) -> tuple[float, list[tuple]]:
    """(smoothed share of toxic rows, the sample's minibatches; none without both classes).  The rows
    are put in one order, however they came; only the batches outlive this call."""
    meta = [(np.frombuffer(r["k"], np.int64), np.frombuffer(r["toxic"], np.int64), np.frombuffer(r["size"], np.int64)) for p in parts for r in p.select(["k", "toxic", "size"]).to_pylist()]
    k, y, size = (np.concatenate([np.zeros(0, np.int64), *x]) for x in (zip(*meta) if meta else ([], [], [])))
    share = (y.sum() + 0.1) / (len(y) + 2)  # 0.05 without any row
    if y.min(initial=1) == y.max(initial=0):
        return share, []
    term, at = np.empty(int(size.sum()), np.int32), 0
    for p in parts:
        for data, n in zip(p.column("terms"), p.column("n").to_pylist()):
            raw = np.frombuffer(pa.decompress(data.as_buffer(), n, codec="zstd"), np.uint8)
            np.cumsum(np.ascontiguousarray(raw.reshape(4, -1).T).reshape(-1).view(np.int32), dtype=np.int32, out=term[at : at + n // 4])
            at += n // 4
    parts = meta = p = data = raw = None  # noqa: F841
    release()
    order = np.lexsort((y, k))
    return share, minibatches((np.cumsum(size) - size)[order], size[order], term, y[order].astype(np.float64))


def score(docs: DataFrame, machine: Machine, keep: list[str]) -> DataFrame:
    """``keep`` columns and score of every document; one pass over whole texts."""
    bc = docs.sparkSession.sparkContext.broadcast(machine)  # of a fixed size: 2^BITS x (factors + 2) numbers
    schema = docs.select(*keep).schema.add("score", "double")
    src = docs.select(*[F.col(c).alias(f"_k{i}") for i, c in enumerate(keep)], F.col("text").alias("text"))

    def run(batches):
        m = bc.value
        for b in batches:
            z = np.full(b.num_rows, m.w0)
            for i, j, d, t in _terms_of(b):
                z[i:j] = m.raw(np.searchsorted(d, np.arange(j - i + 1)), t)[0]
            p = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
            yield pa.RecordBatch.from_arrays([b.column(i) for i in range(len(keep))] + [pa.array(p)], names=[f.name for f in schema])

    return src.mapInArrow(run, schema)


def classify(docs: DataFrame, labels: DataFrame, keep: list[str] | None = None, **options) -> DataFrame:
    keep = keep or ["doc_id"]
    return score(docs, train(docs, labels, **options), keep)


def report(docs: DataFrame, labels: DataFrame) -> DataFrame:
    s = classify(docs, labels)
    return s.select("doc_id", held(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
