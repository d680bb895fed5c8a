"""WARC archives with a two-level capture index.

``write`` puts one compressed record per page into archives: of records with equal payloads
the smallest page_id becomes the response, the others revisit it. ``build_index`` sorts the
captures by reversed-host key into compressed blocks of lines and keeps a sparse directory
of the blocks. ``lookup`` routes keys to index parts by their bounds, finds blocks by binary
search in a part's directory and reads only these; ``fetch`` reads records by ranges.
"""

from __future__ import annotations

import base64
import bisect
import hashlib
import json
import zlib
from urllib.parse import urlsplit

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from landsift.llm import files
from landsift.llm.common import new_folder, written

#: Bytes after which a task begins a new archive.
ARCHIVE_BYTES = 256 << 20
#: Bytes of an archive that one task reads.
STRIPE_BYTES = 16 << 20
#: Captures in a block of the index.
BLOCK_LINES = 256
#: Date of records of tables that carry none.
DATE = "2000-01-01T00:00:00Z"

CAPTURES = "key string, page_id long, url string, path string, offset long, length long"
DIRECTORY = "part int, path string, first string, last string, offset long, length long"
RECORDS = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, payload binary"


def surt(url: str | None) -> str:
    """Reversed-host key of a URL: ``com,example,www:8080)/path?query``; empty for null.

    The scheme, user and fragment are left out, the host is folded to lower case. What does
    not parse as a URL is kept whole after a bracket.
    """
    if url is None:
        return ""
    try:
        parts = urlsplit(url)
        host, port = parts.hostname or "", parts.port
    except ValueError:
        return ")" + url
    if not host:
        return ")" + url
    key = ",".join(reversed(host.split("."))) + (f":{port}" if port else "") + ")" + (parts.path or "/")
    return key + (f"?{parts.query}" if parts.query else "")


def record_id(page_id: int | None) -> str:
    return f"<urn:page:{'null' if page_id is None else page_id}>"


def _page_of(name: str) -> int | None:
    inner = name.removeprefix("<urn:page:").removesuffix(">")
    return None if inner == "null" else int(inner)


def _record(page_id, url, payload: bytes, sha1: str, refers_to, revisit: bool, date: str) -> bytes:
    digest = base64.b32encode(bytes.fromhex(sha1)).decode()
    head = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: {record_id(page_id)}", f"WARC-Date: {date}"]
    if url is not None:
        head.append("WARC-Target-URI: " + url.encode("unicode_escape").decode().replace(" ", "%20"))
        head.append("X-Url: " + json.dumps(url))
    head += [f"WARC-Payload-Digest: sha1:{digest}", f"X-Payload-Length: {len(payload)}", "Content-Type: application/http; msgtype=response"]
    if revisit:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: {record_id(refers_to)}"]
    block = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block += b"" if revisit else payload
    head.append(f"Content-Length: {len(block)}")
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def _packed(record: bytes) -> bytes:
    squeeze = zlib.compressobj(1, zlib.DEFLATED, 31)
    return squeeze.compress(record) + squeeze.flush()


def parse(data: bytes) -> dict:
    """Head fields and payload of one compressed record."""
    record = zlib.decompress(data, 31)
    head, _, rest = record.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
    block = rest[: int(fields["Content-Length"])]
    return fields | {"payload": block.partition(b"\r\n\r\n")[2]}


def marked(pages: DataFrame, page_id: str = "page_id", html: str = "html", at_least: int = 0) -> DataFrame:
    """page_id, url, payload, sha1, revisit and refers_to of every page.

    The smallest page_id of equal payloads (SHA-1 and length) of ``at_least`` bytes is found
    by an aggregation that reduces before it shuffles. Null html is an empty payload; null
    page_ids come last; rows that repeat the smallest page_id are responses too.
    """
    payload = F.coalesce(F.encode(html, "UTF-8"), F.lit(b""))
    rows = pages.select(F.col(page_id).cast("long").alias("page_id"), "url", payload.alias("payload")).withColumn("sha1", F.sha1("payload"))
    key = F.when(F.length("payload") >= at_least, F.concat_ws(":", "sha1", F.length("payload"))).alias("same")
    rows = rows.withColumn("same", key)
    first = rows.groupBy("same").agg(F.min("page_id").alias("first"), F.count("*").alias("n")).filter("n > 1 AND same IS NOT NULL").drop("n")
    return rows.join(first, "same", "left").select(
        "page_id", "url", "payload", "sha1",
        F.coalesce(F.col("first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first")), F.lit(False)).alias("revisit"),
        F.col("first").alias("refers_to"),
    )


def write(pages: DataFrame, folder: str, date: str = DATE, **options) -> DataFrame:
    """Write the archives of ``marked`` pages; the table of captures (one row per page)."""

    def put(batches):
        out, path, at = None, "", 0
        for batch in batches:
            rows = []
            for r in batch.to_pylist():
                if out is None or at >= ARCHIVE_BYTES:
                    if out is not None:
                        out.close()
                    path, at = files.new_file(folder, TaskContext.get().partitionId(), ".warc.gz"), 0
                    out = files.create(path)
                data = _packed(_record(r["page_id"], r["url"], r["payload"], r["sha1"], r["refers_to"], r["revisit"], date))
                out.write(data)
                rows.append((surt(r["url"]), r["page_id"], r["url"], path, at, len(data)))
                at += len(data)
            yield _batch(rows, CAPTURES)
        if out is not None:
            out.close()

    return written(marked(pages, **options).mapInArrow(put, CAPTURES), "warc-captures")


_KINDS = {"string": pa.string(), "long": pa.int64(), "int": pa.int32(), "binary": pa.binary()}


def _batch(rows: list[tuple], schema: str) -> pa.RecordBatch:
    names, kinds = zip(*(x.split() for x in schema.split(", ")), strict=True)
    columns = list(zip(*rows, strict=True)) if rows else [()] * len(names)
    return pa.RecordBatch.from_arrays([pa.array(c, _KINDS[k]) for c, k in zip(columns, kinds, strict=True)], list(names))


def build_index(captures: DataFrame, folder: str) -> DataFrame:
    """Write the compressed blocks of sorted captures; the block directory as a table.

    The parts are ranges of (key, page_id), so that one key with many captures is split.
    """
    spark = captures.sparkSession
    order = ["key", "page_id", "path", "offset"]
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))

    def put(batches):
        part = TaskContext.get().partitionId()
        out, path, at, lines, found = None, "", 0, [], []

        def flush():
            nonlocal out, path, at, lines
            if out is None:
                path = files.new_file(folder, part, ".cdx.z")
                out = files.create(path)
            data = zlib.compress("\n".join(json.dumps(x) for x in lines).encode(), 6)
            out.write(data)
            found.append((part, path, lines[0][0], lines[-1][0], at, len(data)))
            at += len(data)
            lines = []

        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                lines.append(row)
                if len(lines) == BLOCK_LINES:
                    flush()
        if lines:
            flush()
        if out is not None:
            out.close()
        yield _batch(found, DIRECTORY)

    dealt = captures.select(CAPTURES.replace(" string", "").replace(" long", "").split(", "))
    dealt = dealt.repartitionByRange(n, *order).sortWithinPartitions(*order)
    return written(dealt.mapInArrow(put, DIRECTORY), "warc-directory")


def lookup(keys: DataFrame, directory: DataFrame) -> DataFrame:
    """All captures of the given distinct keys (column ``key``).

    The bounds of the index parts, one row per index file and so at most as many as shuffle
    partitions, are all that goes to the driver and the tasks. A key goes to the parts whose
    bounds hold it. There keys come in order, the part's directory is searched by bisection
    and each block is read once, by its range.
    """
    bounds = sorted((r["part"], r["a"], r["z"]) for r in directory.groupBy("part").agg(F.min("first").alias("a"), F.max("last").alias("z")).collect())
    firsts, lasts, parts = [b[1] for b in bounds], [b[2] for b in bounds], [b[0] for b in bounds]

    def route(batches):
        for batch in batches:
            rows = []
            for key in batch.column("key").to_pylist():
                low, high = bisect.bisect_left(lasts, key), bisect.bisect_right(firsts, key)
                rows += [(parts[k], key) for k in range(low, high)]
            yield _batch(rows, "part int, key string")

    def search(batches):
        of, blocks, ends, f, at, lines = None, [], [], None, -1, []
        for batch in batches:
            rows = []
            for part, key, entries in zip(*(batch.column(c).to_pylist() for c in ("part", "key", "entries")), strict=True):
                if entries is not None:  # a part's directory comes before its keys
                    blocks, of, at = sorted((b["offset"], b["length"], b["first"], b["last"]) for b in entries), part, -1
                    ends = [b[3] for b in blocks]
                    if f is not None:
                        f.close()
                    f = files.open_ranges(entries[0]["path"])
                    continue
                if of != part:
                    continue
                k = bisect.bisect_left(ends, key)
                while k < len(blocks) and blocks[k][2] <= key:
                    if k != at:
                        at, lines = k, [json.loads(x) for x in zlib.decompress(f.read_at(blocks[k][1], blocks[k][0])).decode().split("\n")]
                    rows += [tuple(x) for x in lines[bisect.bisect_left(lines, key, key=lambda x: x[0]) : bisect.bisect_right(lines, key, key=lambda x: x[0])]]
                    k += 1
            yield _batch(rows, CAPTURES)
        if f is not None:
            f.close()

    n = int(keys.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    sparse = directory.groupBy("part").agg(F.collect_list(F.struct("path", "first", "last", "offset", "length")).alias("entries"))
    routed = keys.select("key").mapInArrow(route, "part int, key string")
    both = routed.withColumn("entries", F.lit(None).cast(sparse.schema["entries"].dataType)).unionByName(sparse.withColumn("key", F.lit("")).select("part", "key", "entries"))
    ordered = both.repartition(n, "part").sortWithinPartitions("part", F.col("entries").isNull(), "key")
    return ordered.mapInArrow(search, CAPTURES)


def fetch(captures: DataFrame, payloads: bool = True) -> DataFrame:
    """The records of captures, read from the archives by ranges, in the archives' order.

    payload_bytes and payload_digest of responses are those of the payload as read; revisits
    tell them of the payload they refer to. ``payloads=False`` leaves the payload null.
    """
    def get(batches):
        f, of = None, None
        for batch in batches:
            rows = []
            for path, offset, length in zip(*(batch.column(c).to_pylist() for c in ("path", "offset", "length")), strict=True):
                if path != of:
                    if f is not None:
                        f.close()
                    f, of = files.open_ranges(path), path
                r = parse(f.read_at(length, offset))
                kind, payload = r["WARC-Type"], r["payload"]
                if kind == "response":
                    size, digest, refers = len(payload), base64.b32encode(hashlib.sha1(payload).digest()).decode(), None
                else:
                    size, digest = int(r["X-Payload-Length"]), r["WARC-Payload-Digest"].removeprefix("sha1:")
                    refers = _page_of(r["WARC-Refers-To"])
                url = json.loads(r["X-Url"]) if "X-Url" in r else None
                rows.append((_page_of(r["WARC-Record-ID"]), url, size, digest, kind, refers, payload if payloads and kind == "response" else None))
            yield _batch(rows, RECORDS)
        if f is not None:
            f.close()

    n = int(captures.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    stripe = F.floor(F.col("offset") / STRIPE_BYTES)
    dealt = captures.select("path", "offset", "length").repartition(n, "path", stripe).sortWithinPartitions("path", "offset")
    return dealt.mapInArrow(get, RECORDS)


def keys_of(pages: DataFrame, url: str = "url") -> DataFrame:
    """The distinct keys of a column of URLs."""
    def make(batches):
        for batch in batches:
            yield _batch([(surt(u),) for u in batch.column("url").to_pylist()], "key string")

    return pages.select(F.col(url).alias("url")).mapInArrow(make, "key string").distinct()


def archive(pages: DataFrame, **options) -> tuple[DataFrame, DataFrame]:
    """Write archives and index of a table of pages: its captures and block directory."""
    folder = new_folder(pages.sparkSession, "warc")
    captures = write(pages, folder, **options)
    return captures, build_index(captures, folder)
