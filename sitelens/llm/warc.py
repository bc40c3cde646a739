"""WARC archives with a two-level capture index.

Writing: one WARC record per page, each its own gzip member, in archives of at most
about ``ARCHIVE_BYTES``. Of pages with equal payloads of at least ``LEAST_REVISIT``
bytes, the one with the smallest page_id is stored as a response, the others as
revisit records that refer to it.

Index: every capture has a sort key, its URL with the host reversed, then its page
id. Captures are range-partitioned and sorted by key; each run of ``BLOCK_LINES``
lines becomes one compressed block. The directory holds a block's first key only.
A lookup finds the block by binary search in the directory, the line by binary
search in the block, and reads that record's byte range from its archive.

The directory grows with the captures, so it is searched in parts: at most ``ROUTES``
evenly spaced keys of it route a lookup to its part, each part is searched with the
lookups routed there, and lookups are dealt out by block.

Archives live under the shared folder and are named by task attempt; only names
that a committed attempt wrote reach the index, so a rerun after a lost executor
leaves at most an unused file.

Defined cases: a null html is an empty payload; a null url has the key "-"; rows
that repeat a page_id are records of their own, told apart by their place among
equal keys, and all rows of the smallest page_id of a payload are responses; null
page ids sort before all others; an empty table gives empty archives and index.
"""

from __future__ import annotations

import gzip
import hashlib
import re
import uuid
import zlib
from urllib.parse import urlsplit

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, functions as F

from sitelens.llm.common import materialise, shared_root

LEAST_REVISIT = 100
ARCHIVE_BYTES = 64 << 20
BLOCK_LINES = 3000
ROUTES = 1024
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "2024-01-01T00:00:00Z"


def sort_key(url: str | None) -> str:
    """``http://www.Example.com:80/a?b`` becomes ``com,example)/a?b``."""
    if not url:
        return "-"
    try:
        parts = urlsplit(url.strip())
        host, port = (parts.hostname or "").rstrip("."), parts.port
    except ValueError:
        return url.strip().lower()
    if not host:
        return url.strip().lower()
    host = re.sub(r"^www\d*\.", "", host)
    port_text = f":{port}" if port and port != {"http": 80, "https": 443}.get(parts.scheme) else ""
    return ",".join(reversed(host.split("."))) + port_text + ")" + (parts.path or "/") + \
        (f"?{parts.query}" if parts.query else "")


def page_order(page_id: int | None) -> str:
    """Sixteen digits in which ids of either sign sort as numbers."""
    return f"{(page_id if page_id is not None else -(1 << 63)) + (1 << 63):016x}"


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None) -> bytes:
    """One WARC/1.1 record; revisits carry no payload. ``digest`` is the full payload's SHA-256."""
    kind = "response" if refers_to is None else "revisit"
    block = payload if refers_to is None else b""
    name = uuid.uuid5(uuid.NAMESPACE_URL, f"{page_id}|{url}")
    lines = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <urn:uuid:{name}>", f"WARC-Date: {DATE}",
             f"WARC-Target-URI: {re.sub(r'[\r\n]+', ' ', url or '')}", f"WARC-Page-ID: {'' if page_id is None else page_id}",
             f"WARC-Payload-Digest: sha256:{digest}", f"WARC-Page-Payload-Length: {len(payload)}"]
    if refers_to is not None:
        lines += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To-Page: {refers_to}"]
    lines += ["Content-Type: text/html; charset=utf-8", f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode("utf-8", "replace") + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse(member: bytes) -> tuple[dict[str, str], bytes]:
    """Header fields and block of one compressed record; raises if it is not whole."""
    data = gzip.decompress(member)
    head, rest = data.split(b"\r\n\r\n", 1)
    lines = head.decode("utf-8").split("\r\n")
    if lines[0] != "WARC/1.1":
        raise ValueError("not a WARC record")
    fields = {k.lower(): v for k, v in (x.split(": ", 1) if ": " in x else (x.rstrip(":"), "") for x in lines[1:])}
    n = int(fields["content-length"])
    if rest[n:] != b"\r\n\r\n":
        raise ValueError("record of another length than it says")
    return fields, rest[:n]


def _open(folder: str):
    """File system and path of a URI or plain path that all executors share."""
    return fs.FileSystem.from_uri(folder) if "://" in folder or folder.startswith("file:") else \
        (fs.LocalFileSystem(), folder)


def with_references(pages: DataFrame, page_id: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """(page_id, url, payload, digest, refers_to): null refers_to means a response.

    First copies come from a map-side combined aggregate; the join is on the digest,
    where adaptive execution splits a payload that very many pages share.
    """
    rows = pages.select(F.col(page_id).cast("bigint").alias("page_id"), F.col(url).alias("url"),
                        F.coalesce(F.col(html).cast("binary"), F.lit(b"")).alias("payload")) \
        .withColumn("digest", F.sha2("payload", 256))
    long = F.octet_length("payload") >= LEAST_REVISIT
    copies = rows.where(long & F.col("page_id").isNotNull()).groupBy("digest").agg(
        F.min("page_id").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1").select("digest", "first")
    joined = rows.join(copies, "digest", "left")
    revisit = long & (F.col("first") < F.col("page_id"))
    return joined.select("page_id", "url", "payload", "digest", F.when(revisit, F.col("first")).alias("refers_to"))


def write_archives(rows: DataFrame, folder: str) -> DataFrame:
    """Write the records; the captures (key, page_id, archive, offset, length), materialised."""
    def run(batches):
        where, base = _open(folder)
        stream, name, at, archive = None, "", 0, 0
        attempt = uuid.uuid4().hex
        for batch in batches:
            out = []
            for page, url, payload, digest, refers in zip(*(batch.column(i).to_pylist() for i in range(5))):
                if stream is None or at >= ARCHIVE_BYTES:
                    if stream is not None:
                        stream.close()
                    name, at, archive = f"pages-{attempt}-{archive:05d}.warc.gz", 0, archive + 1
                    stream = where.open_output_stream(f"{base}/{name}", compression=None)
                member = gzip.compress(record(page, url, payload, digest, refers), 6, mtime=0)
                stream.write(member)
                out.append((f"{sort_key(url)} {page_order(page)}", page, name, at, len(member)))
                at += len(member)
            cols = list(zip(*out)) if out else [[]] * 5
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(cols, (pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64()))],
                ["key", "page_id", "archive", "offset", "length"])
        if stream is not None:
            stream.close()

    where, base = _open(folder)
    where.create_dir(base, recursive=True)
    return materialise(rows.select("page_id", "url", "payload", "digest", "refers_to").mapInArrow(
        run, "key string, page_id bigint, archive string, offset bigint, length bigint"))


def build_index(captures: DataFrame) -> DataFrame:
    """(part, block, first_key, last_key, lines, data): sorted, compressed blocks, materialised."""
    def run(batches):
        held: list[str] = []
        block = 0

        def packed(lines: list[str], number: int) -> pa.RecordBatch:
            data = zlib.compress("\n".join(lines).encode("utf-8", "surrogatepass"), 6)
            keys = [lines[0].split("\t", 1)[0], lines[-1].split("\t", 1)[0]]
            return pa.RecordBatch.from_arrays(
                [pa.array([number], pa.int64()), pa.array(keys[:1], pa.string()), pa.array(keys[1:], pa.string()),
                 pa.array([len(lines)], pa.int64()), pa.array([data], pa.binary())],
                ["block", "first_key", "last_key", "lines", "data"])

        for batch in batches:
            held += ["\t".join(map(str, r)) for r in zip(*(batch.column(i).to_pylist() for i in range(4)))]
            while len(held) >= BLOCK_LINES:
                yield packed(held[:BLOCK_LINES], block)
                held, block = held[BLOCK_LINES:], block + 1
        if held:
            yield packed(held, block)

    # Tabs and line ends cannot occur in a line's fields but the key.
    key = F.regexp_replace("key", r"[\t\r\n]+", " ")
    ordered = captures.select(key.alias("key"), "archive", "offset", "length") \
        .repartitionByRange("key", "archive", "offset").sortWithinPartitions("key", "archive", "offset")
    return materialise(ordered.mapInArrow(
        run, "block bigint, first_key string, last_key string, lines bigint, data binary")
        .withColumn("part", F.spark_partition_id()))


def lookup(keys: DataFrame, index: DataFrame) -> DataFrame:
    """(key, archive, offset, length): all captures of the distinct ``key`` values that the index has.

    A key that equals a whole line's key (URL and page) matches it; a key without a
    page matches every capture of the URL.
    """
    directory = index.select("part", "block", "first_key", "last_key")
    n = directory.count()
    step = max(1, -(-n // ROUTES))
    # Block numbers count from 0 in every part, so this keeps at most ROUTES + parts rows.
    routes = sorted(r[0] for r in directory.where(F.pmod("block", F.lit(step)) == 0)
                    .select("first_key").collect())

    def route(batches):
        edges = np.array(routes, object)
        for batch in batches:
            asked = batch.column(0).to_pylist()
            # A URL's captures may begin in one route and end in a later one.
            low = _at(edges, asked)
            high = _at(edges, [k + " ~" for k in asked])
            yield _spread(low, high, [batch.column(0)], ["key"])

    wanted = keys.select(F.regexp_replace("key", r"[\t\r\n]+", " ").alias("key")).distinct() \
        .mapInArrow(route, "route bigint, key string")
    entries = directory.select(F.col("first_key").alias("key"), "part", "block", "last_key") \
        .mapInArrow(_with_route(routes), "route bigint, key string, part int, block bigint, last_key string")

    def search(entry: pa.Table, asked: pa.Table) -> pa.Table:
        """Binary search of a directory part: the last block that begins at or before each key.

        A URL without a page, or lines that repeat a key, may go on into following blocks.
        """
        order = np.argsort(np.array(entry.column("key").to_pylist(), object), kind="stable")
        firsts = [entry.column("key")[int(i)].as_py() for i in order]
        lasts = [entry.column("last_key")[int(i)].as_py() for i in order]
        parts, blocks = entry.column("part").to_numpy()[order], entry.column("block").to_numpy()[order]
        edges = np.array(firsts, object)
        out = []
        for key in asked.column("key").to_pylist():
            i = max(0, int(np.searchsorted(edges, key, "left")) - 1) if len(edges) else 0
            while i < len(firsts) and (firsts[i] <= key or firsts[i].startswith(key + " ")):
                if lasts[i] >= key:
                    out.append((parts[i], blocks[i], key))
                i += 1
        cols = list(zip(*out)) if out else [[], [], []]
        return pa.table([pa.array(cols[0], pa.int32()), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.string())],
                        ["part", "block", "key"])

    hits = entries.groupBy("route").cogroup(wanted.groupBy("route")).applyInArrow(
        search, "part int, block bigint, key string")

    def scan(block: pa.Table, asked: pa.Table) -> pa.Table:
        if not block.num_rows or not asked.num_rows:
            return _CAPTURES.empty_table()
        lines = zlib.decompress(block.column("data")[0].as_py()).decode("utf-8", "surrogatepass").split("\n")
        rows = [x.split("\t") for x in lines]
        edges = np.array([r[0] for r in rows], object)
        out = []
        for key in asked.column("key").to_pylist():
            i = int(np.searchsorted(edges, key, "left"))
            while i < len(rows) and (rows[i][0] == key or rows[i][0].startswith(key + " ")):
                out.append((rows[i][0], rows[i][1], int(rows[i][2]), int(rows[i][3])))
                i += 1
        cols = list(zip(*out)) if out else [[]] * 4
        return pa.table([pa.array(c, t) for c, t in zip(cols, _CAPTURES.types)], schema=_CAPTURES)

    return index.select("part", "block", "data").groupBy("part", "block") \
        .cogroup(hits.groupBy("part", "block")).applyInArrow(
            scan, "key string, archive string, offset bigint, length bigint").distinct()


_CAPTURES = pa.schema([("key", pa.string()), ("archive", pa.string()), ("offset", pa.int64()), ("length", pa.int64())])


def _at(edges: np.ndarray, keys: list[str]) -> np.ndarray:
    """The route of each key: the last edge at or before it."""
    if not len(edges) or not keys:
        return np.zeros(len(keys), np.int64)
    return np.maximum(np.searchsorted(edges, np.array(keys, object), "right") - 1, 0)


def _spread(low: np.ndarray, high: np.ndarray, columns: list, names: list[str]) -> pa.RecordBatch:
    """Each row once for every route from ``low`` to ``high``."""
    n = high - low + 1
    take = pa.array(np.repeat(np.arange(len(n)), n), pa.int64())
    at = np.repeat(low, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    return pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), *(c.take(take) for c in columns)], ["route", *names])


def _with_route(routes: list[str]):
    """Directory entries with every route that one of their lines may be asked through."""
    def run(batches):
        edges = np.array(routes, object)
        for batch in batches:
            yield _spread(_at(edges, batch.column(0).to_pylist()), _at(edges, batch.column(3).to_pylist()),
                          [batch.column(i) for i in range(4)], ["key", "part", "block", "last_key"])

    return run


def read_ranges(captures: DataFrame, folder: str) -> DataFrame:
    """Read each capture's byte range and check what the record says about itself.

    (page_id, url, record_type, payload_bytes, payload_digest, refers_to, payload).
    """
    schema = ("page_id bigint, url string, record_type string, payload_bytes bigint, payload_digest string, "
              "refers_to bigint, payload binary")

    def run(batches):
        where, base = _open(folder)
        name, source = None, None
        for batch in batches:
            out = []
            for archive, offset, length in zip(*(batch.column(i).to_pylist() for i in range(3))):
                if archive != name:
                    if source is not None:
                        source.close()
                    name, source = archive, where.open_input_file(f"{base}/{archive}")
                fields, block = parse(source.read_at(length, offset))
                digest = fields["warc-payload-digest"].removeprefix("sha256:")
                revisit = fields["warc-type"] == "revisit"
                if not revisit and (hashlib.sha256(block).hexdigest() != digest
                                    or len(block) != int(fields["warc-page-payload-length"])):
                    raise ValueError(f"payload of {fields['warc-record-id']} is damaged")
                page = fields["warc-page-id"]
                out.append((int(page) if page else None, fields["warc-target-uri"], fields["warc-type"],
                            int(fields["warc-page-payload-length"]), digest,
                            int(fields["warc-refers-to-page"]) if revisit else None, None if revisit else block))
            cols = list(zip(*out)) if out else [[]] * 7
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(),
                                                       pa.int64(), pa.binary()))],
                ["page_id", "url", "record_type", "payload_bytes", "payload_digest", "refers_to", "payload"])
        if source is not None:
            source.close()

    # An archive is read in stretches of about 4 MB, each in order of offset.
    return captures.select("archive", "offset", "length") \
        .repartition("archive", F.floor(F.col("offset") / (4 << 20))).sortWithinPartitions("archive", "offset") \
        .mapInArrow(run, schema)


def archive_round_trip(pages: DataFrame, page_id: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """Write all pages, index them, look every page up and read it back: one row per page."""
    folder = f"{shared_root(pages.sparkSession)}/archives-{uuid.uuid4().hex}"
    captures = write_archives(with_references(pages, page_id, url, html), folder)
    index = build_index(captures)
    found = lookup(captures.select("key"), index)
    return read_ranges(found, folder).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
