"""WARC archives: one gzip member per record, written and read by Spark.

Writing.  Python tasks compress records; Spark's own text writer puts the
bytes down, so files appear through its commit protocol and a task that is
lost or run twice leaves no half file.  A gzip member ends with the
little-endian length of its content, whose top byte is 0 below 16 MiB; that
byte is given as the writer's line separator, so the file is exactly the
concatenation of the members.  A longer record is followed by an empty member
(which readers skip), whose last byte is again 0.

Reading.  Each task owns a byte range.  It scans for the gzip magic, accepts a
place only if the member there inflates to a WARC version line and headers
with a Content-Length, and then owns that record even if it ends beyond the
range; the next search starts at the member's end.  A record that starts
before the range belongs to the task before.  False magics inside compressed
data fail the header check and the scan goes on one byte later.

Equal payloads of at least ``min_bytes`` are stored once, as the response
with the largest id; the others are revisit records that hold the HTTP headers
(so the payload's length) and the digest.

Defined cases: null payload is empty; a row without id is a revisit if its
payload is stored under another id, else a response without id; rows that
repeat the largest id are responses; a null url leaves the target URI out;
payloads of any length are written and read whole, in time and memory in
proportion to their length (a Spark value holds 2 GB at most); an empty table
gives archives without records, and those an empty result; other columns of the
input, whatever their names, take no part.
"""

from __future__ import annotations

import base64
import hashlib
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskloom.llm.common import small_batches, table, text_or_empty
from riskloom.session import scratch_path

MAGIC = b"\x1f\x8b\x08"
EMPTY_MEMBER = zlib.compressobj(1, zlib.DEFLATED, 31).flush()
VERSION = b"WARC/1.1\r\n"
DATE = "2024-01-01T00:00:00Z"
SPLIT_BYTES = 16 << 20   # bytes of a reading task's range
CHUNK = 1 << 20          # bytes read at once,
FEED = 1 << 14           # fed to the inflater at once,
FIRST_BYTES = 64         # at first: enough for a member's header and a little of its text;
INFLATE = 1 << 20        # and bytes inflated at once
BATCH_BYTES = 8 << 20    # payload bytes in an output batch


# ------------------------------------------------------------------ writing --

def base32_digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record_uri(page_id) -> str:
    return "<urn:page:>" if page_id is None else f"<urn:page:{page_id}>"


def record_bytes(page_id, url: str | None, payload: bytes, refers_to, is_response: bool, date: str = DATE) -> bytes:
    """One record as a gzip member (see the module's text on its last byte)."""
    http = (f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n").encode()
    block = http + payload if is_response else http
    head = [("WARC-Type", "response" if is_response else "revisit"), ("WARC-Record-ID", record_uri(page_id)), ("WARC-Date", date)]
    if url is not None:
        head.append(("WARC-Target-URI", "".join(c for c in url if c not in "\r\n")))
    head.append(("WARC-Payload-Digest", "sha1:" + base32_digest(payload)))
    if not is_response:
        head += [("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"),
                 ("WARC-Refers-To", record_uri(refers_to))]
    head += [("Content-Type", "application/http; msgtype=response"), ("Content-Length", str(len(block)))]
    raw = VERSION + "".join(f"{k}: {v}\r\n" for k, v in head).encode() + b"\r\n" + block + b"\r\n\r\n"
    z = zlib.compressobj(6, zlib.DEFLATED, 31)
    member = z.compress(raw) + z.flush()
    return member if member[-1] == 0 else member + EMPTY_MEMBER


def _records(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        cols = [c.to_pylist() for c in (b.column("id"), b.column("url"), b.column("payload"), b.column("refers_to"))]
        out = [record_bytes(i, u, p, r, r is None)[:-1] for i, u, p, r in zip(*cols)]
        yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], ["record"])


def revisits(df: DataFrame, id_col: str, payload: F.Column, min_bytes: int = 0) -> DataFrame:
    """(id, digest, refers_to) of the rows that repeat a payload stored under a
    larger id.  Only ids and digests are shuffled; the largest id per digest
    is a partial aggregate, so a payload that fills a third of the table is
    no hot group there."""
    d = df.select(F.col(id_col).alias("_i"), F.sha1(payload).alias("_d"), F.octet_length(payload).alias("_n")).filter(F.col("_n") >= min_bytes)
    top = d.groupBy("_d").agg(F.max("_i").alias("refers_to"), F.count(F.lit(1)).alias("_c")).filter("_c > 1").select(F.col("_d").alias("_k"), "refers_to")
    return (d.join(top, F.col("_d") == F.col("_k")).filter(~F.col("_i").eqNullSafe(F.col("refers_to")))
            .select("_i", "_d", "refers_to").distinct())


def write_warc(df: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html",
               min_bytes: int = 0) -> None:
    """Archives of ``df`` below ``path``, one record per row."""
    small_batches(df.sparkSession)
    payload = text_or_empty(payload_col).cast("binary")
    again = revisits(df, id_col, payload, min_bytes)
    rows = df.select(F.col(id_col).alias("id"), F.col(url_col).alias("url"), payload.alias("payload"), F.sha1(payload).alias("d"))
    rows = (rows.join(again, F.col("id").eqNullSafe(F.col("_i")) & (F.col("d") == F.col("_d")), "left")
            .select("id", "url", "payload", "refers_to"))
    records = rows.mapInArrow(_records, "record binary")
    # the writer copies a string's bytes as they are
    records.select(F.col("record").cast("string").alias("value")).write.option("lineSep", "\u0000").text(path)


# ------------------------------------------------------------------ reading --

class _Range:
    """Bytes of a file, in pieces as they are asked for; the last piece read is
    kept, so looking on a little or back a little costs no second read."""

    def __init__(self, f, size: int):
        self.f, self.size, self.base, self.buf = f, size, 0, b""

    def _have(self, pos: int) -> bool:
        if not self.base <= pos < self.base + len(self.buf):
            if pos >= self.size:
                return False
            self.f.seek(pos)
            self.base, self.buf = pos, self.f.read(min(CHUNK, self.size - pos))
        return bool(self.buf)

    def at(self, pos: int, n: int) -> memoryview:
        """Up to ``n`` bytes from ``pos`` on; fewer at the end of the piece at
        hand, none at the file's."""
        if not self._have(pos):
            return memoryview(b"")
        return memoryview(self.buf)[pos - self.base:pos - self.base + n]

    def find(self, what: bytes, pos: int, end: int) -> int:
        """Where ``what`` begins next in [pos, end); -1 if nowhere."""
        while pos < end and self._have(pos):
            found = self.buf.find(what, pos - self.base)
            if found >= 0:
                return self.base + found if self.base + found < end else -1
            last = self.base + len(self.buf)
            if last >= self.size:
                return -1
            pos = max(pos, last - len(what) + 1)
            if pos < end:       # it may go on in the next piece
                self.f.seek(pos)
                self.base, self.buf = pos, self.f.read(min(CHUNK, self.size - pos))
        return -1


def _headers(raw: bytes) -> dict[str, str]:
    out = {}
    for line in raw.split(b"\r\n"):
        k, sep, v = line.partition(b":")
        if sep:
            out[k.strip().lower().decode("latin-1")] = v.strip().decode("utf-8", "replace")
    return out


def member_at(r: _Range, at: int):
    """(headers, block, end) of the record whose gzip member starts at ``at``;
    None if there is none.

    A few bytes are inflated first: a magic that stands in other data by chance
    fails there, at the format or at the version line.  Then input goes through
    piece by piece and is let go; the headers and the block are kept as lists
    of pieces, so a member costs its own length once, however long it is."""
    z, pos, first = zlib.decompressobj(31), at, True
    head, text, parts, have, want, end = None, bytearray(), [], 0, 0, b""
    data = b""
    while not z.eof:
        if not data:
            data = r.at(pos, FIRST_BYTES if first else FEED)
            if not data:
                return None
            pos += len(data)
        try:
            out = z.decompress(data, FIRST_BYTES if first else INFLATE)
        except zlib.error:
            return None
        first, data = False, z.unconsumed_tail
        if head is None:
            seen = max(0, len(text) - 3)    # headers may be of any length: look on from here
            text += out
            if text[:7] != b"WARC/1."[:len(text)]:
                return None
            cut = text.find(b"\r\n\r\n", seen)
            if cut < 0:
                continue
            head = _headers(bytes(text[:cut]))
            if "warc-type" not in head or not head.get("content-length", "").isdigit():
                return None
            out, text, want = bytes(text[cut + 4:]), bytearray(), int(head["content-length"])
        if out and have < want:
            parts.append(out[:want - have])
            have += len(parts[-1])
    if head is None or have < want:
        return None
    return head, b"".join(parts), pos - len(z.unused_data) - len(data)


def scan_range(f, size: int, start: int, end: int) -> Iterator[tuple[dict[str, str], bytes]]:
    """The records that start in [start, end) of a file of ``size`` bytes."""
    r, at = _Range(f, size), start
    while (at := r.find(MAGIC, at, end)) >= 0:
        if (got := member_at(r, at)) is None:
            at += 1
        else:
            yield got[:2]
            at = got[2]


def _read_ranges(with_payload: bool):
    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        names = ["record_type", "record_id", "target_uri", "date", "refers_to_id", "payload_digest", "payload_bytes", "stored_digest", "payload"]
        types = [pa.string()] * 6 + [pa.int64(), pa.string(), pa.binary()]

        def batch(rows):
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names)

        for b in batches:
            for path, size, start, end in zip(*(c.to_pylist() for c in b.columns)):
                store, name = fs.FileSystem.from_uri(path)
                rows, held = [], 0
                with store.open_input_file(name) as f:
                    for head, block in scan_range(f, size, start, end):
                        cut = block.find(b"\r\n\r\n")
                        http, body = (_headers(block[:cut]), block[cut + 4:]) if cut >= 0 else ({}, block)
                        revisit = head["warc-type"] == "revisit"
                        n = http.get("content-length", "")
                        rows.append((head["warc-type"], head.get("warc-record-id"), head.get("warc-target-uri"), head.get("warc-date"),
                                     head.get("warc-refers-to"), head.get("warc-payload-digest", "").removeprefix("sha1:") or None,
                                     int(n) if revisit and n.isdigit() else len(body), None if revisit else base32_digest(body),
                                     body if with_payload and not revisit else None))
                        held += 300 + len(head.get("warc-target-uri", "")) + (len(body) if with_payload else 0)
                        if held >= BATCH_BYTES:
                            yield batch(rows)
                            rows, held = [], 0
                if rows:
                    yield batch(rows)
    return read


_RECORD = ("record_type string, record_id string, target_uri string, date string, refers_to_id string, "
           "payload_digest string, payload_bytes long, stored_digest string, payload binary")


def read_warc(spark, path: str, split_bytes: int = SPLIT_BYTES, with_payload: bool = True) -> DataFrame:
    """The records below ``path`` (files of gzip members), one row each:
    type, id, URI, date, what it refers to, the payload's digest and length as
    the headers state them, and for stored payloads the digest of the bytes
    and (``with_payload``) the bytes.  Spark lists the files; tasks open them
    by byte range through pyarrow's file systems."""
    files = spark.read.format("binaryFile").load(path).select("path", F.col("length").alias("size")).filter("size > 0")
    ranges = (files.select("path", "size", F.explode(F.expr(f"sequence(0L, size - 1, {int(split_bytes)}L)")).alias("start"))
              .withColumn("end", F.expr(f"least(size, start + {int(split_bytes)}L)")))
    n = max(1, ranges.count())
    dealt = ranges.repartitionByRange(min(n, 100_000), "path", "start")
    return dealt.mapInArrow(_read_ranges(with_payload), _RECORD)


def page_records(records: DataFrame) -> DataFrame:
    """The contract's columns of the records read."""
    def page(c):
        return F.regexp_extract(F.col(c), r"^<urn:page:(-?[0-9]+)>$", 1).try_cast("long")
    return records.select(
        page("record_id").alias("page_id"), "payload_bytes",
        F.coalesce("stored_digest", "payload_digest").alias("payload_digest"), "record_type",
        F.when(F.col("record_type") == "revisit", page("refers_to_id")).alias("refers_to"), "target_uri")


def op3_warc(spark, sf_dir):
    path = scratch_path(spark, "warc")
    write_warc(table(spark, sf_dir, "pages"), path)
    return page_records(read_warc(spark, path, with_payload=False))


SQL = """
with p as (select page_id, coalesce(html, '') as html, url from pages),
d as (select *, sha1(html) as h from p),
r as (select h, max(page_id) as top from d group by h),
b as (
  select d.page_id, strlen(d.html) as payload_bytes, d.url, r.top, d.page_id is not distinct from r.top as is_response,
         array_to_string([['0000','0001','0010','0011','0100','0101','0110','0111','1000','1001','1010','1011','1100','1101','1110','1111']
                          [strpos('0123456789abcdef', c)] for c in string_split(d.h, '')], '') as bits
  from d join r on d.h = r.h)
select page_id, cast(payload_bytes as bigint) as payload_bytes,
       array_to_string([substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
         cast(1 + 16 * cast(substr(bits, 5 * i + 1, 1) as int) + 8 * cast(substr(bits, 5 * i + 2, 1) as int) + 4 * cast(substr(bits, 5 * i + 3, 1) as int)
              + 2 * cast(substr(bits, 5 * i + 4, 1) as int) + cast(substr(bits, 5 * i + 5, 1) as int) as int), 1) for i in range(0, 32)], '') as payload_digest,
       case when is_response then 'response' else 'revisit' end as record_type,
       case when is_response then null else top end as refers_to,
       url as target_uri
from b
"""
