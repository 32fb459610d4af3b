"""WARC archives with a two-level capture index.

Writing: rows are range-sorted by (reversed-host URL key, page id); every task writes
one .warc.gz of separately compressed records plus, beside it, an index shard: sorted
key lines in compressed blocks of ``BLOCK`` lines, and a sparse directory of the first
key of each block.  The second level over shards is one small table of first and last
keys (one row per shard, so bounded by the number of tasks; the driver checks that there
are at most ``SHARDS``).

Reading: a lookup binary-searches the second level for the shards that can hold a key,
then, in the order of shards and keys, each shard's directory, range-reads the block and
then the records.  Keys are range-dealt, so a shard's captures may be read by several tasks,
and a task holds one block of lines and some records.  ``archive`` reads every page back
by its key in this way; ``read_all`` walks the index without keys.

Files go to the shared folder, under a name of the task attempt, and are renamed when
whole; the row that names them comes from the successful attempt only, so lost
executors leave at worst unused files.

Edge cases: null html is an empty payload; a null URL has the key ")"; pages that
repeat whole rows are records of their own; of rows with equal payload and equal
largest page_id all are responses; a null page_id counts as smallest and is refered to
as null; an empty table gives an empty result.  Only page_id, url and html are read.
"""

from __future__ import annotations

import bisect
import hashlib
import io
import json
import uuid
import zlib
from urllib.parse import quote, urlsplit

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialise, partitions, shared_dir

BLOCK = 512
SHARDS = 1 << 20
#: Payloads in more rows than this are joined by broadcast: at most rows / HOT digests.
HOT = 1 << 16
MIN_REVISIT = 1000


def surt(url: str | None) -> str:
    """http://www.Example.com:80/a?b -> com,example)/a?b (user info, default port, www and fragment dropped)."""
    if not url:
        return ")"
    try:
        u = urlsplit(url.strip() if "://" in url else "http://" + url.strip())
        host, port = (u.hostname or "").lower(), u.port
    except ValueError:
        return quote(url.lower(), safe=":/?&=,)(%;@!$'*+~.#[]-_")
    host = host.removeprefix("www.")
    key = ",".join(reversed(host.split("."))) + (f":{port}" if port and port not in (80, 443) else "")
    return quote(key + ")" + (u.path or "/").lower() + (f"?{u.query.lower()}" if u.query else ""), safe=":/?&=,)(%;@!$'*+~.#[]-_")


def revisits(pages: DataFrame) -> DataFrame:
    """page_id, url, h, refers_to of the rows that repeat a payload; no html in it.

    The largest page_id per digest is a partial aggregate over long payloads only, so a
    payload with a third of all rows costs one row per task.
    """
    long = pages.select("page_id", "url", "html").where(F.octet_length("html") >= MIN_REVISIT)
    p = materialise(long.select("page_id", "url", _row_hash().alias("h"), F.sha1(F.col("html").cast("binary")).alias("digest")), "warc")
    top = p.groupBy("digest").agg(F.max("page_id").alias("top"), F.count("*").alias("n")).where("n > 1")
    marked = p.join(F.broadcast(top.where(F.col("n") > HOT).select("digest", F.col("top").alias("hot"))), "digest", "left")
    rare = marked.where("hot IS NULL").join(top.where(F.col("n") <= HOT).select("digest", "top"), "digest")
    every = rare.unionByName(marked.where("hot IS NOT NULL").withColumn("top", F.col("hot")))
    return every.where(~F.col("page_id").eqNullSafe(F.col("top"))).select("page_id", "url", "h", F.col("top").alias("refers_to")).distinct()


def _row_hash():
    return F.xxhash64("url", F.coalesce("html", F.lit("")))


def _key(url: pa.Array) -> pa.Array:
    return pa.array([surt(x) for x in url.to_pylist()], pa.string())


def keyed(df: DataFrame, url: str = "url") -> DataFrame:
    """``df`` with the key of its URLs, in whole Arrow columns."""
    return df.withColumn("key", F.arrow_udf(_key, "string")(url))


def _head(kind: str, fields: list[tuple[str, str]], length: int) -> bytes:
    lines = [f"WARC-Type: {kind}", *(f"{k}: {v}" for k, v in fields), "Content-Type: application/http; msgtype=response", f"Content-Length: {length}"]
    return ("WARC/1.1\r\n" + "\r\n".join(lines) + "\r\n\r\n").encode()


def _gz(data: bytes, level: int = 1) -> bytes:
    c = zlib.compressobj(level, zlib.DEFLATED, 31)
    return c.compress(data) + c.flush()


def record(page_id, url, html: str, refers_to, revisit: bool) -> bytes:
    """One compressed record; a revisit holds the HTTP head alone."""
    payload = html.encode("utf-8", "surrogatepass")
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    fields = [
        ("WARC-Record-ID", f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'page:{page_id}')}>"),
        ("WARC-Date", "2024-01-01T00:00:00Z"),
        ("WARC-Target-URI", quote(url or "", safe=":/?&=,)(%;@!$'*+~.#[]-_")),
        ("WARC-Payload-Digest", f"sha1:{hashlib.sha1(payload).hexdigest()}"),
        ("X-Page-Id", json.dumps(page_id)),
        ("X-Payload-Length", str(len(payload))),
    ]
    if revisit:
        fields += [
            ("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"),
            ("WARC-Refers-To", f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'page:{refers_to}')}>"),
            ("X-Refers-To-Page", json.dumps(refers_to)),
        ]
        body = http
    else:
        body = http + payload
    return _gz(_head("revisit" if revisit else "response", fields, len(body)) + body + b"\r\n\r\n")


def parse(data: bytes) -> dict:
    """A compressed record -> type, headers, payload (None for a revisit)."""
    raw = zlib.decompress(data, 31)
    head, _, rest = raw.partition(b"\r\n\r\n")
    headers = dict(x.split(": ", 1) for x in head.decode().split("\r\n")[1:])
    body = rest[: int(headers["Content-Length"])]
    kind = headers["WARC-Type"]
    return {"type": kind, "headers": headers, "payload": body.partition(b"\r\n\r\n")[2] if kind == "response" else None}


SHARD = "shard string, first string, last string, records long"


def _filesystem(root: str):
    return pafs.FileSystem.from_uri(root if "://" in root or root.startswith("file:") else "file://" + root)


def write(pages: DataFrame, root: str | None = None, shards: int | None = None) -> tuple[DataFrame, str]:
    """Write archives and index shards below ``root``; returns the shard table."""
    spark = pages.sparkSession
    root = root or f"{shared_dir(spark)}/warc-{uuid.uuid4().hex}"
    if root.startswith("file:/") and not root.startswith("file://"):
        root = "file://" + root[5:]
    fs, base = _filesystem(root)
    fs.create_dir(base, recursive=True)
    # The pages move once.  Marks of revisits travel along the same sort key and come
    # right before their rows.
    rows = pages.select("page_id", "url", _row_hash().alias("h"), F.lit(1).alias("row"), F.lit(None).cast("long").alias("refers_to"), F.coalesce("html", F.lit("")).alias("html"))
    marks = revisits(pages).select("page_id", "url", "h", F.lit(0).alias("row"), "refers_to", F.lit(None).cast("string").alias("html"))
    ordered = keyed(rows.unionByName(marks)).repartitionByRange(shards or partitions(spark), "key", "page_id", "h").sortWithinPartitions("key", "page_id", "h", "row")

    def save(batches):
        out = mark = None
        for batch in batches:
            for row in zip(*[batch.column(c).to_pylist() for c in ("key", "page_id", "url", "html", "h", "row", "refers_to")]):
                if not row[5]:
                    mark = (row[0], row[1], row[4]), row[6]
                    continue
                revisit = mark is not None and mark[0] == (row[0], row[1], row[4])
                if out is None:
                    fs, base = _filesystem(root)
                    name = uuid.uuid4().hex
                    out = fs.open_output_stream(f"{base}/{name}.warc.gz.part", compression=None)
                    idx = io.BytesIO()
                    directory, block, at, count, first = [], [], 0, 0, row[0]
                data = record(*row[1:4], mark[1] if revisit else None, revisit)
                out.write(data)
                block.append(f"{row[0]} {json.dumps([row[1], at, len(data)])}\n")
                at, count, last = at + len(data), count + 1, row[0]
                if len(block) == BLOCK:
                    _flush(block, idx, directory)
        if out is not None:
            _flush(block, idx, directory)
            out.close()
            with fs.open_output_stream(f"{base}/{name}.cdx.gz", compression=None) as f:
                f.write(idx.getvalue())
            with fs.open_output_stream(f"{base}/{name}.dir", compression=None) as f:
                f.write(json.dumps(directory).encode())
            fs.move(f"{base}/{name}.warc.gz.part", f"{base}/{name}.warc.gz")
            yield pa.RecordBatch.from_pylist([{"shard": name, "first": first, "last": last, "records": count}], schema=_SHARD_ARROW)

    table = ordered.mapInArrow(save, SHARD)
    return materialise(table, "warc"), root


_SHARD_ARROW = pa.schema([("shard", pa.string()), ("first", pa.string()), ("last", pa.string()), ("records", pa.int64())])


def _flush(block: list[str], idx: io.BytesIO, directory: list) -> None:
    if block:
        data = _gz("".join(block).encode(), 6)
        directory.append([block[0].split(" ", 1)[0], idx.tell(), len(data)])
        idx.write(data)
        block.clear()


def _lines(fs, base: str, shard: str, entry: list, cdx=None) -> list[tuple[str, list]]:
    with cdx or fs.open_input_file(f"{base}/{shard}.cdx.gz") as f:
        text = zlib.decompress(f.read_at(entry[2], entry[1]), 31).decode()
    return [(k, json.loads(rest)) for k, rest in (x.split(" ", 1) for x in text.splitlines())]


class Shard:
    """An open shard: its sparse directory, and the last block of lines that was read."""

    def __init__(self, root: str, name: str, at: int = 0):
        self.fs, self.base = _filesystem(root)
        self.name, self.at = name, at
        self.directory = directory_of(self.fs, self.base, name)
        self.firsts = [d[0] for d in self.directory]
        self.warc = self.fs.open_input_file(f"{self.base}/{name}.warc.gz")
        self.block, self.lines = -1, []

    def find(self, key: str):
        """[page_id, offset, length] of every capture of ``key``: binary search of the sparse
        directory, then a range read for each block that can hold the key."""
        i = max(bisect.bisect_left(self.firsts, key) - 1, 0)
        while i < len(self.directory) and self.firsts[i] <= key:
            if i != self.block:
                self.block, self.lines = i, _lines(self.fs, self.base, self.name, self.directory[i])
            j = bisect.bisect_left(self.lines, key, key=lambda x: x[0])
            while j < len(self.lines) and self.lines[j][0] == key:
                yield self.lines[j][1]
                j += 1
            i += 1


def directory_of(fs, base: str, shard: str) -> list:
    with fs.open_input_file(f"{base}/{shard}.dir") as f:
        return json.loads(f.read())


RECORD = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, url string"


def _row(rec: dict) -> dict:
    h = rec["headers"]
    payload = rec["payload"]
    if payload is not None:  # measured, not copied from the headers
        n, digest = len(payload), hashlib.sha1(payload).hexdigest()
        if h["WARC-Payload-Digest"] != f"sha1:{digest}":
            raise ValueError(f"digest of page {h['X-Page-Id']} does not match its payload")
    else:
        n, digest = int(h["X-Payload-Length"]), h["WARC-Payload-Digest"].removeprefix("sha1:")
    return {
        "page_id": json.loads(h["X-Page-Id"]), "payload_bytes": n, "payload_digest": digest, "record_type": rec["type"],
        "refers_to": json.loads(h.get("X-Refers-To-Page", "null")), "url": h["WARC-Target-URI"],
    }


_RECORD_ARROW = pa.schema([("page_id", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("url", pa.string())])


def _per_shard(table: DataFrame) -> DataFrame:
    n = max(1, partitions(table.sparkSession))
    return table.repartition(n, "shard")


def read_all(table: DataFrame, root: str) -> DataFrame:
    """Every record, by walking each shard's index and range-reading its archive."""

    def load(batches):
        for batch in batches:
            for shard in batch.column("shard").to_pylist():
                fs, base = _filesystem(root)
                with fs.open_input_file(f"{base}/{shard}.warc.gz") as warc:
                    for entry in directory_of(fs, base, shard):
                        lines = _lines(fs, base, shard, entry)
                        yield pa.RecordBatch.from_pylist([_row(parse(warc.read_at(n, at))) for _, (_, at, n) in lines], schema=_RECORD_ARROW)

    return _per_shard(table).mapInArrow(load, RECORD)


def lookup(urls: DataFrame, table: DataFrame, root: str) -> DataFrame:
    """Captures of the ``url`` column's URLs: RECORD plus key."""
    spark = urls.sparkSession
    found = table.select("first", "last", "shard").limit(SHARDS + 1).collect()
    if len(found) > SHARDS:
        raise ValueError("too many shards for the second level")
    ranges = sorted(tuple(r) for r in found)
    if not ranges:
        return spark.createDataFrame([], RECORD + ", key string")
    # Shards are ordered and may share a first or last key with their neighbours.
    level = spark.sparkContext.broadcast(([r[0] for r in ranges], [r[1] for r in ranges], [r[2] for r in ranges]))

    def route(batches):
        firsts, lasts, shards = level.value
        for b in batches:
            at, key = [], []
            for k in b.column("key").to_pylist():
                i = bisect.bisect_left(lasts, k)
                while i < len(shards) and firsts[i] <= k:
                    at.append(i)
                    key.append(k)
                    i += 1
            yield pa.RecordBatch.from_pydict({"at": pa.array(at, pa.int32()), "key": pa.array(key, pa.string())})

    hits = keyed(urls.select("url")).select("key").distinct().mapInArrow(route, "at int, key string")
    ordered = hits.repartitionByRange(partitions(spark), "at", "key").sortWithinPartitions("at", "key")
    schema = _RECORD_ARROW.append(pa.field("key", pa.string()))

    def search(batches):
        reader, rows = None, []
        for b in batches:
            for at, k in zip(b.column("at").to_pylist(), b.column("key").to_pylist()):
                if reader is None or reader.at != at:
                    reader = Shard(root, level.value[2][at], at)
                for _, offset, n in reader.find(k):
                    rows.append(_row(parse(reader.warc.read_at(n, offset))) | {"key": k})
                    if len(rows) == BLOCK:
                        yield pa.RecordBatch.from_pylist(rows, schema=schema)
                        rows = []
        if rows:
            yield pa.RecordBatch.from_pylist(rows, schema=schema)

    return ordered.mapInArrow(search, RECORD + ", key string")


def archive(pages: DataFrame) -> DataFrame:
    """Write, then read every page back by its URL's key."""
    table, root = write(pages)
    return lookup(pages, table, root).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


ORACLE = """
WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
d AS (SELECT page_id, octet_length(encode(h))::BIGINT AS n, sha1(h) AS dig FROM p),
m AS (SELECT dig, max(page_id) AS top, count(*) AS c FROM d WHERE n >= 1000 GROUP BY dig)
SELECT d.page_id, n AS payload_bytes, d.dig AS payload_digest,
       CASE WHEN c > 1 AND page_id <> top THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN c > 1 AND page_id <> top THEN top END AS refers_to
FROM d LEFT JOIN m ON m.dig = d.dig
"""
