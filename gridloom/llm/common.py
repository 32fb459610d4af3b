"""Shared pieces of the training-data operators.

Spark side: reading tables, cutting lineage with a table written to the shared
checkpoint folder, connected components.  Worker side: whole-column byte views
of Arrow strings, and a vectorised tokenizer that works on UTF-8 bytes.
"""

from __future__ import annotations

import ctypes
import gc
import tempfile
import uuid

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from py4j.protocol import Py4JError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

U64 = np.uint64
_R = 0x9E3779B97F4A7C15
_R_INV = pow(_R, -1, 1 << 64)
#: Bytes of text that one vectorised step handles; bounds temporaries.
STEP = 1 << 19


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The cluster's checkpoint folder.  Where none is set, a temporary one in local mode; on a
    cluster a local folder would lose data, so that is an error."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        if not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="gridloom-"))
    return sc._jsc.sc().getCheckpointDir().get().rstrip("/")


def materialise(df: DataFrame, tag: str = "t") -> DataFrame:
    """Write ``df`` once to the shared folder and read it back: lineage ends there,
    and a lost executor costs a reread, not a recomputation."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{tag}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    trim(spark)
    return spark.read.schema(df.schema).parquet(path)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def release() -> None:
    """Freed memory of this process goes back to the system, as far as its C library can."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):
        pass


def trim(spark: SparkSession) -> bool:
    """Freed native memory of the driver's JVM goes back to the system; False where its version cannot.

    Spark runs each exchange on a thread of its own, and the C library keeps what these and the
    JIT's threads have freed in an arena for each few: hundreds of MB after some hundred exchanges.
    """
    jvm, gateway = spark.sparkContext._jvm, spark.sparkContext._gateway
    try:
        of = jvm.java.lang.Class.forName
        kinds = gateway.new_array(jvm.java.lang.Class, 4)
        kinds[0], kinds[1] = of("javax.management.ObjectName"), of("java.lang.String")
        kinds[2], kinds[3] = of("[Ljava.lang.Object;"), of("[Ljava.lang.String;")
        args = gateway.new_array(jvm.java.lang.Object, 4)
        args[0], args[1] = jvm.javax.management.ObjectName("com.sun.management:type=DiagnosticCommand"), "systemTrimNativeHeap"
        # By the interface's method: the server's own class is not open to reflection.
        of("javax.management.MBeanServer").getMethod("invoke", kinds).invoke(jvm.java.lang.management.ManagementFactory.getPlatformMBeanServer(), args)
    except Py4JError:
        return False
    return True


def tidy(spark: SparkSession) -> None:
    """Shuffle files of finished plans go now, not when the driver's JVM happens to collect its
    garbage; its heap and its native memory shrink too."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()
    trim(spark)


def _digest(edges: DataFrame) -> tuple:
    """Number and two 64-bit sums of distinct edges."""
    hashes = [F.bit_xor(F.xxhash64("a", "b", F.lit(i))) for i in (0, 1)]
    return tuple(edges.agg(F.count("*"), *hashes).first())


def connected_components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """(a, b) long pairs, a != b -> (id, component): the smallest id reachable.

    Alternates large-star and small-star steps: every step replaces edges by edges
    to smaller ids, and stops when no edge changes.  Nothing is collected but their
    digest; each round is cut by a written table.
    """
    spark = edges.sparkSession
    e = materialise(
        edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct(), "cc"
    )
    tidy(spark)  # what the edges came from
    was = _digest(e)
    for _ in range(rounds):
        both = e.unionAll(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = (
            large.join(low, "a")
            .select(F.explode(F.array(F.struct("a", F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("p"))
            .select("p.a", "p.b").where("a <> b").distinct()
        )
        e = materialise(small, "cc")
        now = _digest(e)
        if now == was:
            break
        was = now
    else:
        raise RuntimeError("connected components did not settle")
    tidy(spark)
    roots = e.select(F.col("b").alias("id"), F.col("b").alias("component")).distinct()
    return e.select(F.col("a").alias("id"), F.col("b").alias("component")).unionAll(roots)


# ---------------------------------------------------------------- worker side
def column(batch: pa.RecordBatch | pa.Table, name: str) -> pa.Array:
    col = batch.column(name)
    return col.combine_chunks() if isinstance(col, pa.ChunkedArray) else col


def as_bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Arrow strings -> (all bytes, offsets); null is empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    n = len(texts)
    if not n:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    arr = pc.fill_null(texts, "").cast(pa.large_string())
    _, off, data = arr.buffers()
    offs = np.frombuffer(off, np.int64)[arr.offset : arr.offset + n + 1]
    buf = np.frombuffer(data, np.uint8)[offs[0] : offs[-1]] if data is not None else np.zeros(0, np.uint8)
    return buf, offs - offs[0]


def pieces(offs: np.ndarray, step: int = STEP):
    """Ranges of documents of about ``step`` bytes (one document at least)."""
    i, n = 0, len(offs) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offs, offs[i] + step, "right")) - 1)
        yield i, j
        i = j


_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 9, 10, 11, 12, 13]] = True


_WORDY = np.zeros(256, bool)
_WORDY[[*range(48, 58), *range(97, 123), *range(128, 256)]] = True


def fold_words(buf: np.ndarray) -> np.ndarray:
    """ASCII and Latin-1 letters lowered; all but letters, digits and non-ASCII bytes become spaces."""
    low = _LOWER[buf]
    if len(low):  # U+00C0..U+00DE are C3 80..C3 9E; C3 97 is a sign
        upper = (low[1:] >= 0x80) & (low[1:] <= 0x9E) & (low[1:] != 0x97) & (low[:-1] == 0xC3)
        low[1:][upper] += 0x20
    return np.where(_WORDY[low], low, np.uint8(32))


def lower_ascii(buf: np.ndarray) -> np.ndarray:
    return _LOWER[buf]


def mix64(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


_POW: dict[str, np.ndarray] = {}


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_POW.get("r", ())) < n + 1:
        m = max(n + 1, STEP + 1)
        for key, base in (("r", _R), ("i", _R_INV)):
            p = np.full(m, base, U64)
            p[0] = 1
            _POW[key] = np.cumprod(p, dtype=U64)
    return _POW["r"], _POW["i"]


def prefix_hash(buf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(P, r^-i): the hash of bytes [s, e) is (P[e] - P[s]) * r^-s modulo 2^64."""
    r, inv = powers(len(buf))
    p = np.empty(len(buf) + 1, U64)
    p[0] = 0
    np.cumsum((buf.astype(U64) + U64(1)) * r[: len(buf)], out=p[1:])
    return p, inv


def word_spans(buf: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends (byte positions) and counts per document of [^\\x20\\x09-\\x0D]+."""
    if not len(buf):
        z = np.zeros(0, np.int64)
        return z, z, np.zeros(len(offs) - 1, np.int64)
    space = _SPACE[buf]
    edge = np.empty(len(buf), bool)
    edge[0] = True
    edge[1:] = space[:-1]
    inner = offs[:-1]
    edge[inner[inner < len(buf)]] = True
    starts = np.flatnonzero(edge & ~space)
    edge[-1] = True
    edge[:-1] = space[1:]
    last = offs[1:] - 1
    edge[last[last >= 0]] = True
    ends = np.flatnonzero(edge & ~space) + 1
    return starts, ends, np.diff(np.searchsorted(starts, offs))


def word_hashes(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    p, inv = prefix_hash(buf)
    return mix64((p[ends] - p[starts]) * inv[starts] + (ends - starts).astype(U64))


def shingle_hashes(words: np.ndarray, counts: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all k-word sequences (with fewer words, the whole as one) and the
    number per document; no shingle crosses documents."""
    n = len(words)
    ends = np.cumsum(counts)
    begins = ends - counts
    full = np.maximum(counts - k + 1, 0)
    out_n = np.where(counts == 0, 0, np.maximum(full, 1))
    o_end = np.cumsum(out_n)
    doc = np.repeat(np.arange(len(counts)), out_n)
    at = np.arange(int(out_n.sum())) - np.repeat(o_end - out_n, out_n) + begins[doc]
    length = np.minimum(counts[doc], k)
    h = length.astype(U64) * U64(0xD6E8FEB86659FD93)
    for i in range(k):
        use = length > i
        w = words[np.minimum(at + i, max(n - 1, 0))]
        h = np.where(use, mix64(h * U64(_R) + w), h)
    return h, out_n
