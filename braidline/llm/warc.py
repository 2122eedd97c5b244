"""WARC archives: a writer with revisit records, and a splittable reader.

Each partition writes one file of gzip members, one record a member. Of records with
equal payloads of at least ``min_bytes`` bytes, the one with the largest id is the
response and the others are revisits, which keep the HTTP headers (so the payload's
length and digest) and name the response.

The reader deals every file out in byte ranges. A task looks in its range for the gzip
magic and takes a place for a member only if the bytes that follow decode to a WARC
header; from the first such place on, members follow one another. A record belongs to
the range in which its member starts, so each is read exactly once, whatever the ranges.
"""

from __future__ import annotations

import base64
import hashlib
import zlib

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fresh_path, materialise
from .token_files import open_store

MAGIC = b"\x1f\x8b\x08"
CRLF = b"\r\n"
ID_URN = "urn:braidline:record:"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
READ, FEED = 1 << 18, 1 << 13
HOT_SHARES = 10_000
SENT_ROWS = 500_000


def one_line(x) -> str:
    """A header value; line breaks would end it."""
    return "".join(c if c >= " " else " " for c in str(x))


def record(kind: str, key, uri: str, date: str, payload: bytes, n_bytes: int, digest: str, refers_to=None) -> bytes:
    """A response or revisit record. ``digest`` is hex SHA-1; a null id has no URN."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {n_bytes}\r\n\r\n".encode()
    block = http + (payload if kind == "response" else b"")
    head = [
        "WARC/1.1",
        f"WARC-Type: {kind}",
        f"WARC-Record-ID: <{ID_URN}{'' if key is None else key}>",
        f"WARC-Date: {date}",
        f"WARC-Target-URI: {one_line(uri)}",
        f"WARC-Payload-Digest: sha1:{base64.b32encode(bytes.fromhex(digest)).decode()}",
        f"Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(block)}",
    ]
    if kind == "revisit":
        head += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: <{ID_URN}{refers_to}>", "WARC-Truncated: length"]
    return "\r\n".join(head).encode() + CRLF * 2 + block + CRLF * 2


def gzip_member(data: bytes, level: int = 4) -> bytes:
    c = zlib.compressobj(level, zlib.DEFLATED, 31)
    return c.compress(data) + c.flush()


def headers(block: bytes) -> tuple[dict[str, str], int]:
    """Fields of a header block (lower-case names; first line under ''), and its size."""
    end = block.index(CRLF * 2)
    first, *lines = block[:end].decode("utf-8", "replace").split("\r\n")
    fields = {"": first}
    for line in lines:
        name, _, value = line.partition(":")
        fields[name.strip().lower()] = value.strip()
    return fields, end + 4


def write_archives(pages: DataFrame, *, id_col="page_id", url_col="url", html_col="html", min_bytes: int = 1000, sent_rows: int = SENT_ROWS) -> DataFrame:
    """Write all rows; returns the manifest (url, size, records), which names only files
    of tasks that ended well. Null html counts as empty, null url as an empty one; rows
    that share an id, or have none, are a record each; an empty table gives no files.
    Payloads are equal if two digests and the length are.

    Payloads of ``min_bytes`` bytes are counted by digest. What repeats, a short row a
    payload, is sent to where the payloads lie if that is no more than ``SENT_ROWS`` rows.
    Beyond, only what fills more than one of ``HOT_SHARES`` shares of the table is (so at
    most that many rows), and the others meet by digest, no group larger than a share."""
    payload = F.encode(F.coalesce(F.col(html_col), F.lit("")), "UTF-8")
    rows = pages.select(F.col(id_col).cast("long").alias("key"), F.coalesce(F.col(url_col), F.lit("")).alias("uri"), payload.alias("payload"))
    rows = rows.withColumns({"n_bytes": F.octet_length("payload").cast("long"), "digest": F.sha1("payload"), "check": F.xxhash64("payload")})
    same = ["digest", "n_bytes", "check"]
    again = rows.where(F.col("n_bytes") >= min_bytes).groupBy(*same).agg(F.max("key").alias("kept"), F.count("*").alias("n")).where("n > 1")
    again = materialise(again, "warc-copies")
    if again.count() <= sent_rows:
        marked = rows.join(F.broadcast(again.drop("n")), same, "left")
    else:
        hot = F.col("n") > -(-pages.count() // HOT_SHARES)
        marked = rows.join(F.broadcast(again.where(hot).select(*same, F.col("kept").alias("hot_kept"), F.lit(True).alias("hot"))), same, "left")
        # rows that are marked already, or too short, carry a number that no group has, and spread
        meets = (F.col("n_bytes") >= min_bytes) & F.col("hot").isNull()
        marked = marked.withColumn("spread", F.when(meets, 0).otherwise(1 + F.monotonically_increasing_id()))
        cold = again.where(~hot).drop("n").withColumn("spread", F.lit(0).cast("long"))
        marked = marked.join(cold.hint("shuffle_hash"), [*same, "spread"], "left").withColumn("kept", F.coalesce("kept", "hot_kept"))
    refers = F.when(F.col("kept").isNotNull() & ~F.col("kept").eqNullSafe(F.col("key")), F.col("kept"))
    marked = marked.select("key", "uri", "payload", "n_bytes", "digest", refers.alias("refers_to"))
    folder = fresh_path(pages.sparkSession, "warc")
    store, at = open_store(folder)
    store.create_dir(at, recursive=True)

    def write(batches):
        import datetime
        import uuid

        url = f"{folder}/part-{uuid.uuid4().hex}.warc.gz"
        date = datetime.datetime.now(datetime.timezone.utc).strftime("%Y-%m-%dT%H:%M:%SZ")
        n = size = 0
        out = None
        for b in batches:
            for row in zip(*(c.to_pylist() for c in b.columns)):
                if out is None:
                    store, at = open_store(url)
                    out = store.open_output_stream(at, compression=None)
                key, uri, payload, n_bytes, digest, refers_to = row
                member = gzip_member(record("response" if refers_to is None else "revisit", key, uri, date, payload, n_bytes, digest, refers_to))
                out.write(member)
                n, size = n + 1, size + len(member)
        if out is not None:
            out.close()
            yield pa.record_batch([pa.array([url]), pa.array([size], pa.int64()), pa.array([n], pa.int64())], ["url", "size", "records"])

    return materialise(marked.mapInArrow(write, "url string, size long, records long"), "warc-manifest")


class _Members:
    """Decoded members of a file from a place on, read forward through one buffer."""

    def __init__(self, f, size: int):
        self.f, self.size = f, size
        self.low, self.held = 0, b""

    def ahead(self, start: int, least: int = 1):
        """Bytes from ``start`` on that the buffer holds: at least ``least``, if present."""
        i = start - self.low
        if not 0 <= i <= len(self.held):
            self.f.seek(start)
            self.low, self.held, i = start, b"", 0
        if len(self.held) - i < least and self.low + len(self.held) < self.size:
            self.held = self.held[i:] + self.f.read(READ)
            self.low, i = start, 0
        return memoryview(self.held)[i:]

    def pieces(self, start: int):
        """The decoded pieces of the member at ``start``, each with the place after it."""
        z, at = zlib.decompressobj(31), start
        while not z.eof and at < self.size:
            chunk = self.ahead(at)[:FEED]
            piece = z.decompress(chunk)
            at += len(chunk) - len(z.unused_data)
            yield piece, at

    def decode(self, start: int):
        """Bytes of the member at ``start`` and the place after it; None if it is no gzip
        member."""
        out, at = [], start
        try:
            for piece, at in self.pieces(start):
                out.append(piece)
        except zlib.error:
            return None
        return b"".join(out), at

    def is_record(self, start: int) -> bool:
        """Whether the bytes decode to a WARC header, however long."""
        head = b""
        try:
            for piece, _ in self.pieces(start):
                seen = max(0, len(head) - 3)
                head += piece
                if not head.startswith(b"WARC/1."[: len(head)]):
                    return False
                if head.find(CRLF * 2, seen) >= 0:
                    return True
        except zlib.error:
            pass
        return False

    def first(self, start: int, end: int) -> int | None:
        """The first member that starts in the range."""
        at = start
        while at < end:
            window = bytes(self.ahead(at, len(MAGIC))[: end - at + len(MAGIC) - 1])
            i = window.find(MAGIC)
            if i < 0:
                at += max(1, len(window) - len(MAGIC) + 1)
            elif self.is_record(at + i):
                return at + i
            else:
                at += i + 1
        return None


def read_archives(manifest: DataFrame, *, split_bytes: int = 8 << 20, with_payload: bool = True) -> DataFrame:
    """page_id, url, payload_bytes, payload_digest, record_type, refers_to and (unless
    left out) payload of every record; a revisit's payload is null. A record without an id
    reads back without one, repeated ones a row each, and no files as no rows."""
    ranges = manifest.select("url", "size", F.explode(F.expr(f"sequence(0, greatest(size - 1, 0), {split_bytes})")).alias("start"))
    n = max(1, ranges.count())
    ranges = ranges.repartition(min(n, 20_000))
    names = ["page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to"] + ["payload"] * with_payload

    def number(urn: str):
        digits = urn.strip("<>").removeprefix(ID_URN)
        return int(digits) if digits else None

    def parse(data: bytes):
        fields, at = headers(data)
        kind = fields.get("warc-type")
        if kind not in ("response", "revisit"):
            return None
        block = data[at : at + int(fields["content-length"])]
        http, at = headers(block)
        said = base64.b32decode(fields["warc-payload-digest"].removeprefix("sha1:")).hex()
        payload, n = None, int(http["content-length"])
        if kind == "response":
            payload = block[at:]
            if len(payload) != n or hashlib.sha1(payload).hexdigest() != said:
                raise ValueError(f"damaged record {fields['warc-record-id']}")
        refers = number(fields["warc-refers-to"]) if kind == "revisit" else None
        return (number(fields["warc-record-id"]), fields["warc-target-uri"], n, said, kind, refers) + (payload,) * with_payload

    types = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64()] + [pa.binary()] * with_payload

    def batch(rows):
        return pa.record_batch([pa.array(c, t) for c, t in zip(zip(*rows), types)], names)

    def read(batches):
        for b in batches:
            for url, size, start in zip(*(c.to_pylist() for c in b.columns)):
                store, at = open_store(url)
                with store.open_input_file(at) as f:
                    members, end = _Members(f, size), min(start + split_bytes, size)
                    at, rows, held = members.first(start, end), [], 0
                    while at is not None and at < end:
                        found = members.decode(at)
                        if found is None:
                            raise ValueError(f"damaged member at {at} of {url}")
                        if row := parse(found[0]):
                            rows.append(row)
                            held += len(found[0])
                        at = found[1]
                        if held > 8 << 20 or len(rows) >= 5000:
                            yield batch(rows)
                            rows, held = [], 0
                    if rows:
                        yield batch(rows)

    schema = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long"
    return ranges.mapInArrow(read, schema + ", payload binary" * with_payload)


ORACLE = """
WITH p AS (
  SELECT page_id, coalesce(html, '') AS html, octet_length(encode(coalesce(html, ''))) AS payload_bytes FROM pages),
r AS (SELECT *, CASE WHEN payload_bytes >= 1000 THEN max(page_id) OVER (PARTITION BY html) ELSE page_id END AS kept FROM p)
SELECT page_id, payload_bytes::BIGINT AS payload_bytes, sha1(html) AS payload_digest,
       CASE WHEN kept = page_id THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN kept <> page_id THEN kept END AS refers_to
FROM r
"""
