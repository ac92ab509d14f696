"""WARC archives: writing with revisit records, and a reader that salvages damaged files.

Writing is done with DataFrame functions: of records with equal payloads the one with the smallest
page id is a ``response``, the others are ``revisit`` records without a payload.  Spark's text
writer stores the records one after another (each ends with CRLF CRLF) in the shared folder.

Reading: each file is walked record by record.  A record is accepted if its version line, header,
length, end and block digest hold; a gzip member if it inflates with the right checksum.  After a
failed check the reader looks for the next member (``1f 8b 08``) or version line from which a
record holds again, goes on from there, and reports the bytes between as a quarantined gap.  The
content of a member is walked in the same way.  Of a member that does not hold, the records before the
damage are accepted, but not one that ends right at it.

A file is read as a whole (below 2 GiB), so the writer bounds the bytes of a file: records are
written by classes of size, and the larger the class, the fewer records go into a file.  A file holds
at most ``FILE_BYTES``, or one record that is larger.

Defined results: a null payload is empty; pages with equal payload and the same smallest id are all
responses; a null id counts as larger than any other and is written as ``null``; line breaks in a
URI become blanks, a null URI has no header line; an empty table gives no archive records; extra
columns are not read.
"""

from __future__ import annotations

import base64
import hashlib
import zlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vinterra.llm.common import scratch_path, written

#: Most records of an archive, and most bytes of one with more than one record.
MAX_RECORDS = 2000
FILE_BYTES = 128 << 20
#: A class holds records of up to so many times the size of the class before it.
CLASS_FACTOR = 16
#: More than the header lines of a record need without its URI.
HEADER_BYTES = 1000
VERSION = b"WARC/1."
MEMBER = b"\x1f\x8b\x08"
#: Most bytes of a version line; header lines have no bound.
MAX_VERSION_LINE = 64
#: Bytes inflated at a time.
PIECE = 1 << 16
#: Header fields that every record has, and has once.
ONCE = {"warc-type", "warc-record-id", "content-length"}
#: Date of capture in the records of tables that have none.
CAPTURED = "2024-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
CRLF = "\r\n"
BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"


def base32_sha1(payload: Column) -> Column:
    """Bare base32 SHA-1 of a binary column: each five hex digits are four base32 digits."""
    hexed = F.sha1(payload)
    plain = "0123456789ABCDEFGHIJKLMNOPQRSTUV"
    four = [F.lpad(F.conv(F.substring(hexed, 1 + 5 * i, 5), 16, 32), 4, "0") for i in range(8)]
    return F.translate(F.upper(F.concat(*four)), plain, BASE32)


def with_digest(pages: DataFrame, id_col: str = "page_id", uri_col: str = "url", payload_col: str = "html") -> DataFrame:
    payload = F.coalesce(F.col(payload_col), F.lit(""))
    return pages.select(
        F.col(id_col).alias("page_id"),
        F.regexp_replace(F.col(uri_col), r"[\r\n]+", " ").alias("uri"),
        payload.alias("payload"),
        base32_sha1(payload.cast("binary")).alias("digest"),
    )


def capture_records(pages: DataFrame, id_col: str = "page_id", uri_col: str = "url", payload_col: str = "html") -> DataFrame:
    """``record`` texts without their last line feed, one per page, and ``most_bytes``, a bound of their length."""
    p = with_digest(pages, id_col, uri_col, payload_col)
    # Digests alone are aggregated (partially first, so copies cost nothing).  Only those that occur
    # more than once are looked up again: by a broadcast if their table is small, else by a shuffle.
    first = p.select("page_id", "digest").groupBy("digest").agg(F.min("page_id").alias("first_id"), F.count(F.lit(1)).alias("copies"))
    p = p.join(written(first.where("copies > 1"), "warc-copies"), "digest", "left")
    revisit = F.col("copies").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first_id"))
    name = lambda c: F.concat(F.lit("<urn:page:"), F.coalesce(c.cast("string"), F.lit("null")), F.lit(">"))
    block = F.when(revisit, F.lit("")).otherwise(F.col("payload"))
    line = lambda k, v: F.concat(F.lit(f"{k}: "), v, F.lit(CRLF))
    return p.select(
        F.concat(
            F.lit("WARC/1.1" + CRLF),
            line("WARC-Type", F.when(revisit, F.lit("revisit")).otherwise(F.lit("response"))),
            line("WARC-Record-ID", name(F.col("page_id"))),
            line("WARC-Date", F.lit(CAPTURED)),
            F.coalesce(line("WARC-Target-URI", F.col("uri")), F.lit("")),
            line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("digest"))),
            line("WARC-Block-Digest", F.concat(F.lit("sha1:"), base32_sha1(block.cast("binary")))),
            F.when(revisit, F.concat(line("WARC-Refers-To", name(F.col("first_id"))), line("WARC-Profile", F.lit(PROFILE)))).otherwise(""),
            line("Content-Type", F.lit("text/html; charset=utf-8")),
            line("Content-Length", F.octet_length(block).cast("string")),
            F.lit(CRLF),
            block,
            F.lit(CRLF + "\r"),
        ).alias("record"),
        (F.octet_length("payload") + F.coalesce(F.octet_length("uri"), F.lit(0)).cast("long") + HEADER_BYTES).alias("most_bytes"),
    )


def class_limits() -> list[tuple[int, int]]:
    """``(most bytes of a record, records of a file)`` per class; records beyond the last have files of their own."""
    out, n = [], MAX_RECORDS
    while n > 1:
        out.append((FILE_BYTES // n, n))
        n //= CLASS_FACTOR
    return out


def write_warc(pages: DataFrame, path: str | None = None, **columns) -> str:
    """Write ``pages`` as archives below ``path`` (default: a fresh shared folder) and return it."""
    path = path or scratch_path(pages.sparkSession, "warc")
    records = capture_records(pages, **columns)
    limits = class_limits()
    kind = F.lit(len(limits))
    for c in range(len(limits) - 1, -1, -1):
        kind = F.when(F.col("most_bytes") <= limits[c][0], F.lit(c)).otherwise(kind)
    # at most one small number per class; only classes that occur are written, each by a scan of its own
    found = sorted(r.kind for r in records.select(kind.alias("kind")).distinct().collect())
    for c in found or [0]:
        most = limits[c][1] if c < len(limits) else 1
        out = records.where(kind == c).select("record").write.mode("append" if c in found[1:] else "error")
        out.option("lineSep", "\n").option("maxRecordsPerFile", most).text(path)
    return path


def sha1_32(block: bytes) -> str:
    return base64.b32encode(hashlib.sha1(block).digest()).decode()


def parse_record(data: bytes, at: int = 0):
    """``(headers, block start, block end, record end)``, or the reason why no record holds at ``at``."""
    if not data.startswith(VERSION, at):
        return "no version line"
    stop = data.find(b"\r\n", at, at + MAX_VERSION_LINE)
    if stop < 0:
        return "no end of version line"
    headers = {}
    # line by line, so that the search ends with the first line that is none of a header
    while not data.startswith(b"\r\n\r\n", stop):
        begin = stop + 2
        stop = data.find(b"\n", begin) - 1
        if stop < begin:
            return "no end of header"
        row = data[begin:stop]
        key, colon, value = row.partition(b":")
        if not colon or b"\r" in row or data[stop] != 13:
            return "bad header line"
        name = key.strip().lower().decode("latin-1")
        if name in ONCE and name in headers:
            return "two headers in one"
        headers[name] = value.strip().decode("utf-8", "replace")
    if not ONCE <= headers.keys():
        return "header field missing"
    length = headers["content-length"]
    if not (length.isascii() and length.isdigit()):
        return "no length"
    start = stop + 4
    end = start + int(length)
    if end + 4 > len(data):
        return "cut off"
    if data[end : end + 4] != b"\r\n\r\n":
        return "wrong length"
    said = headers.get("warc-block-digest", "")
    if said.startswith("sha1:") and said[5:] != sha1_32(data[start:end]):
        return "wrong digest"
    return headers, start, end, end + 4


def inflate(data: bytes, at: int):
    """``(content, end, damage)`` of the gzip member at ``at``.

    ``damage`` is None if the member holds; otherwise ``content`` is what inflated before the damage,
    and ``end`` where the inflater stopped.
    """
    stream = zlib.decompressobj(31)
    out, pos = [], at
    while not stream.eof:
        piece = data[pos : pos + PIECE]
        if not piece:
            return b"".join(out), pos, "cut off member"
        before = stream.copy()
        try:
            out.append(stream.decompress(piece))
        except zlib.error:
            try:  # once more, byte by byte: what inflates before the damage is kept
                for k in range(len(piece)):
                    out.append(before.decompress(piece[k : k + 1]))
                    pos += 1
            except zlib.error:
                pass
            return b"".join(out), pos, "bad member"
        pos += len(piece)
    return b"".join(out), pos - len(stream.unused_data), None


def member_records(content: bytes, sure: bool):
    """Yield ``(start, end, headers, block, None)`` and, for gaps, ``(start, end, None, None, reason)`` of inflated content.

    Unless ``sure``, the checksum of the member does not vouch for the content: records without a
    block digest of their own are gaps.
    """
    at, bad, reason = 0, None, ""
    while at < len(content):
        rec = parse_record(content, at)
        if not isinstance(rec, str) and not sure and not rec[0].get("warc-block-digest", "").startswith("sha1:"):
            rec = "no digest in a bad member"
        if isinstance(rec, str):
            if bad is None:
                bad, reason = at, rec
            place = content.find(VERSION, at + 1)
            at = len(content) if place < 0 else place
            continue
        if bad is not None:
            yield bad, at, None, None, reason
            bad = None
        yield at, rec[3], rec[0], content[rec[1] : rec[2]], None
        at = rec[3]
    if bad is not None:
        yield bad, len(content), None, None, reason


def salvage(data: bytes):
    """Yield ``(offset, length, headers, block, None)`` and, for gaps, ``(offset, length, None, None, reason)``.

    Records of a gzip member have its offset and length.  A gap inside the content of a member that
    holds has the member's offset plus its own in the content, and its length there; a damaged member
    is a gap of the file, after the records that inflated before the damage.
    """
    at, bad, reason = 0, None, ""
    ahead = {VERSION: -1, MEMBER: -1}  # the next place of each mark, found once
    inflated, until = b"", 0  # content of the last damaged member, and where it stopped
    while at < len(data):
        found, why, end, sound = [], "no record", at, True
        if data.startswith(MEMBER, at):
            content, end, damage = inflate(data, at)
            sound = damage is None
            inner = list(member_records(content, damage != "bad member"))
            if not sound:  # nothing shows that a record at the very end of the content is whole
                inner = [x for x in inner if x[1] < len(content)]
            if any(h is not None for _, _, h, _, _ in inner):
                for start, stop, h, block, gap in inner:
                    if h is not None:
                        found.append((at, end - at, h, block, None))
                    elif sound:
                        found.append((at + start, stop - start, None, None, gap))
            why = damage or (inner[0][4] if inner else why)
            if found and not sound:
                inflated, until = content[: max(x[1] for x in inner if x[2] is not None)], end
        else:
            rec = parse_record(data, at)
            if isinstance(rec, str):
                why = rec
            elif at < until and data[at : rec[3]] in inflated:
                why = "read from its member"  # stored uncompressed in a damaged member
            else:
                end = rec[3]
                found = [(at, end - at, rec[0], data[rec[1] : rec[2]], None)]
        if found:
            if bad is not None:
                yield bad, at - bad, None, None, reason
                bad = None
            yield from found
            if sound:
                at = end
                continue
        if bad is None:
            bad, reason = at, why
        for mark in ahead:
            if ahead[mark] <= at:
                place = data.find(mark, at + 1)
                ahead[mark] = len(data) if place < 0 else place
        at = min(ahead.values())
    if bad is not None:
        yield bad, len(data) - bad, None, None, reason


READ_SCHEMA = (
    "path string, offset long, length long, gap_reason string, page_id long, record_type string, uri string, "
    "payload_bytes long, payload_digest string, refers_to long, payload binary"
)


def read_warc(spark: SparkSession, path: str, with_payload: bool = True) -> DataFrame:
    """Records and quarantined gaps (rows with a ``gap_reason``) of the archives below ``path``.

    For a response, ``payload_bytes`` and ``payload_digest`` are measured from the block that was
    read; for a revisit the digest is the one in its header, and its bytes are null.
    """

    def page(name: str):
        digits = name.removeprefix("<urn:page:").removesuffix(">")
        return int(digits) if digits.lstrip("-").isdigit() else None

    def read(batches):
        schema = pa.schema(
            [("path", pa.string()), ("offset", pa.int64()), ("length", pa.int64()), ("gap_reason", pa.string()), ("page_id", pa.int64()),
             ("record_type", pa.string()), ("uri", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()),
             ("refers_to", pa.int64()), ("payload", pa.binary())]
        )
        for batch in batches:
            for file, data in zip(batch.column(0), batch.column(1)):
                rows, held = [], 0
                name = file.as_py()
                for offset, length, h, block, reason in salvage(data.as_py()):
                    if h is None:
                        rows.append((name, offset, length, reason) + (None,) * 7)
                        continue
                    kind = h.get("warc-type", "")
                    again = kind == "revisit"
                    digest = h.get("warc-payload-digest", "").removeprefix("sha1:") if again else sha1_32(block)
                    rows.append(
                        (name, offset, length, None, page(h.get("warc-record-id", "")), kind, h.get("warc-target-uri"), None if again else len(block),
                         digest, page(h.get("warc-refers-to", "")), block if with_payload else None)
                    )
                    held += len(block) if with_payload else 0
                    if len(rows) >= 5000 or held > 8 << 20:
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), schema.types)], schema=schema)
                        rows, held = [], 0
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), schema.types)], schema=schema)

    files = spark.read.format("binaryFile").load(path).select("path", "content")
    return files.mapInArrow(read, READ_SCHEMA)


def captures(records: DataFrame) -> DataFrame:
    """``page_id, payload_bytes, payload_digest, record_type, refers_to`` of the records read.

    A revisit takes its bytes from the response that it refers to (null if that one was lost).
    """
    sound = records.where("gap_reason is null").select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
    whole = sound.where("record_type = 'response'")
    size = whole.groupBy("payload_digest").agg(F.max("payload_bytes").alias("full_bytes"))
    again = sound.where("record_type = 'revisit'").join(size, "payload_digest", "left")
    return whole.withColumn("refers_to", F.lit(None).cast("long")).unionByName(
        again.select("page_id", F.col("full_bytes").alias("payload_bytes"), "payload_digest", "record_type", "refers_to")
    )


ORACLE = """
WITH p AS (SELECT page_id, strlen(coalesce(html, ''))::BIGINT AS payload_bytes, sha1(coalesce(html, '')) AS h FROM pages),
d AS (
  SELECT *, array_to_string([
    substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
      1 + ((('0x' || substr(h, 1 + 5 * (i // 4)::INT, 5))::BIGINT >> (15 - 5 * (i % 4))) & 31)::INT, 1) for i in range(0, 32)], '') AS payload_digest,
    min(page_id) OVER (PARTITION BY h) AS first_id
  FROM p)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN page_id IS NOT DISTINCT FROM first_id THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id IS DISTINCT FROM first_id THEN first_id END AS refers_to
FROM d
"""
