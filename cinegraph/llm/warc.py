"""WARC archives with revisit resolution (operator 2).

Writing: only headers (digest, length, page id) are shuffled by payload digest; of the pages with equal payloads
the one with the largest id becomes the response, the others become revisit records that name it. A record is
composed by SQL expressions and written by Spark's own text writer, whose line separator is the blank line that
ends a WARC record, so a file is a plain (gzipped) WARC/1.1 stream and task commits make the write safe against
lost executors; a task writes a file of its own split, RECORDS_IN_FILE records at most. Only pages that may become
revisits are shuffled with their payloads, the others are written where they are read. Reading: files are parsed by Content-Length alone, every response's digest is verified, and
revisit records are joined to the responses that they refer to.

A payload may be shared by a third of all pages: joins on a digest run over salted keys, and only groups of two
or more pages are repeated for the salts.

Edge cases: a null payload counts as empty; a page without an id is a revisit of any equal page that has one,
else a response; all rows that hold the largest id of a group are responses; a missing url leaves its header
out; control characters in a url are percent-encoded.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from datetime import datetime, timezone

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cinegraph.llm.common import flagged, scratch, shared_dir, tune

SALTS = 16
#: Bounds a file when rows are short; one task writes one file otherwise.
RECORDS_IN_FILE = 50_000
#: Fixed values of the formats.
BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
HTTP_HEAD = "HTTP/1.1 200 OK\\r\\nContent-Type: text/html; charset=utf-8\\r\\n\\r\\n"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

RECORD = "page_id long, url string, record_type string, payload_digest string, payload_bytes long, refers_to long"


def with_digest(pages: DataFrame, payload: str, digest: str, length: str) -> DataFrame:
    """Adds the length and the bare upper-case base32 SHA-1: five hex digits give four characters."""
    five = F.expr("transform(sequence(0, 7), i -> cast(conv(substring(_hex, i * 5 + 1, 5), 16, 10) as int))")
    chars = F.expr(f"array_join(transform(flatten(transform(_five, n -> array(shiftright(n, 15), shiftright(n, 10) & 31, shiftright(n, 5) & 31, n & 31))), k -> substring('{BASE32}', k + 1, 1)), '')")
    return (
        pages.withColumn("_hex", F.sha1(F.col(payload)))
        .withColumn("_five", five)
        .withColumn(digest, chars)
        .withColumn(length, F.octet_length(F.col(payload)).cast("long"))
        .drop("_hex", "_five")
    )


def _urn(page_id: Column, digest: Column) -> Column:
    h = F.md5(F.concat_ws("/", page_id.cast("string"), digest))
    return F.concat(F.lit("<urn:uuid:"), *[x for i, n, d in ((1, 8, "-"), (9, 4, "-"), (13, 4, "-"), (17, 4, "-"), (21, 12, ">")) for x in (F.substring(h, i, n), F.lit(d))])


def resolve(pages: DataFrame, min_payload: int = 0) -> DataFrame:
    """page_id, url, payload, digest, n_bytes, refers_to (null: the page is a response)."""
    base = pages.select("page_id", "url", F.coalesce(F.col("html"), F.lit("")).alias("payload"))
    base = with_digest(base, "payload", "digest", "n_bytes")
    heads = scratch(base.select("page_id", "digest", "n_bytes"), "warc-heads")
    groups = heads.groupBy("digest", "n_bytes").agg(F.count("*").alias("n"), F.max("page_id").alias("refers_to"))
    groups = groups.where((F.col("n") > 1) & F.col("refers_to").isNotNull() & (F.col("n_bytes") >= min_payload)).drop("n")
    groups = groups.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    heads = heads.withColumn("salt", F.pmod(F.xxhash64("page_id"), F.lit(SALTS)).cast("int"))
    revisits = heads.join(groups, ["digest", "n_bytes", "salt"]).where(~F.col("page_id").eqNullSafe(F.col("refers_to")))
    revisits = revisits.select(F.col("page_id").alias("r_id"), F.col("digest").alias("r_digest"), F.col("n_bytes").alias("r_bytes"), "refers_to").distinct()
    revisits = scratch(revisits, "warc-revisits")
    mark = lambda page, digest: F.xxhash64(page, digest).alias("_mark")
    base = flagged(base.withColumn("_mark", mark("page_id", "digest")), revisits.select(mark("r_id", "r_digest")), "_mark").drop("_mark")
    plain, some = base.where("not flag").drop("flag"), base.where("flag").drop("flag")
    same = some.page_id.eqNullSafe(revisits.r_id) & (some.digest == revisits.r_digest) & (some.n_bytes == revisits.r_bytes)
    return plain.withColumn("refers_to", F.lit(None).cast("long")).unionByName(some.join(revisits, same, "left").drop("r_id", "r_digest", "r_bytes"))


def _escaped(url: Column) -> Column:
    """Control characters percent-encoded."""
    out = url
    for k in [*range(0x20), 0x7F]:
        out = F.replace(out, F.lit(chr(k)), F.lit(f"%{k:02X}"))
    return F.when(url.rlike(r"[\x00-\x1F\x7F]"), out).otherwise(url)


def write(pages: DataFrame, path: str, min_payload: int = 0, date: str | None = None) -> None:
    """Writes a record per page: a response with its payload, or a revisit record without it. date: now, if not given."""
    c = F.col
    revisit = c("refers_to").isNotNull()
    nl = F.lit("\r\n")
    head = F.expr(f"'{HTTP_HEAD}'")
    block = F.when(revisit, head).otherwise(F.concat(head, c("payload")))
    url = _escaped(c("url"))
    date = date or datetime.now(timezone.utc).strftime("%Y-%m-%dT%H:%M:%SZ")
    line = lambda name, value: F.concat(F.lit(f"{name}: "), value, nl)
    some = lambda x: F.coalesce(x, F.lit(""))
    record = F.concat(
        F.lit("WARC/1.1\r\n"),
        line("WARC-Type", F.when(revisit, F.lit("revisit")).otherwise(F.lit("response"))),
        line("WARC-Record-ID", _urn(c("page_id"), c("digest"))),
        line("WARC-Date", F.lit(date)),
        some(line("WARC-Target-URI", F.when(F.length(url) > 0, url))),
        some(line("X-Page-ID", c("page_id").cast("string"))),
        line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), c("digest"))),
        F.when(revisit, F.concat(line("WARC-Profile", F.lit(REVISIT_PROFILE)), line("WARC-Refers-To", _urn(c("refers_to"), c("digest"))), line("X-Refers-To-Page-ID", c("refers_to").cast("string")))).otherwise(F.lit("")),
        line("Content-Type", F.lit("application/http; msgtype=response")),
        line("Content-Length", F.octet_length(block).cast("string")),
        nl,
        block,
    )
    rows = resolve(pages, min_payload).select(record.alias("value"))
    rows.write.option("lineSep", "\r\n\r\n").option("compression", "gzip").option("maxRecordsPerFile", RECORDS_IN_FILE).text(path)


def _records(content: bytes, gz: bool) -> Iterator[tuple[dict[str, str], bytes]]:
    """Headers and block of each record; the archive is inflated piece by piece."""
    view, at, buf = memoryview(content), 0, bytearray()
    inflate = zlib.decompressobj(31) if gz else None

    def more() -> bool:
        nonlocal at, inflate
        if at >= len(view):
            return False
        piece = view[at : at + (1 << 20)]
        at += len(piece)
        if inflate is None:
            buf.extend(piece)
            return True
        while len(piece):
            buf.extend(inflate.decompress(piece))
            piece = inflate.unused_data if inflate.eof else b""
            if inflate.eof:
                inflate = zlib.decompressobj(31)
        return True

    def upto(n: int) -> bool:
        while len(buf) < n and more():
            pass
        return len(buf) >= n

    while upto(1):
        while (end := buf.find(b"\r\n\r\n")) < 0:
            if not more():
                raise ValueError("a record without an end of its headers")
        lines = bytes(buf[:end]).decode("utf-8", "replace").split("\r\n")
        if not lines[0].startswith("WARC/"):
            raise ValueError(f"no WARC record: {lines[0][:80]!r}")
        head = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
        size = int(head["content-length"])
        if not upto(end + 4 + size):
            raise ValueError("a record is cut off")
        yield head, bytes(buf[end + 4 : end + 4 + size])
        upto(end + 8 + size)
        del buf[: end + 8 + size]


def read(spark: SparkSession, path: str, with_payload: bool = False) -> DataFrame:
    """RECORD columns of all archives under path (and the payload); revisits take their length from their response."""
    import base64
    import hashlib

    tune(spark)
    schema = RECORD + (", payload binary" if with_payload else "")
    names = [x.split()[0] for x in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.int64(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.binary()]
        out: list[list] = [[] for _ in names]
        held = 0

        def flush() -> pa.RecordBatch:
            b = pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(out, kinds, strict=False)], names=names)
            for x in out:
                x.clear()
            return b

        for b in batches:
            for place, content in zip(b.column(0), b.column(1), strict=True):
                for h, block in _records(content.as_py(), place.as_py().endswith(".gz")):
                    kind = h["warc-type"]
                    if kind not in ("response", "revisit"):
                        continue
                    digest = h["warc-payload-digest"].removeprefix("sha1:")
                    payload = block[block.index(b"\r\n\r\n") + 4 :] if kind == "response" else None
                    if payload is not None and base64.b32encode(hashlib.sha1(payload).digest()).decode() != digest:
                        raise ValueError(f"record {h.get('warc-record-id')}: the payload does not match its digest")
                    ids = [int(h[k]) if k in h else None for k in ("x-page-id", "x-refers-to-page-id")]
                    row = [ids[0], h.get("warc-target-uri"), kind, digest, None if payload is None else len(payload), ids[1], payload]
                    for x, v in zip(out, row, strict=False):
                        x.append(v)
                    held += len(block)
                    if len(out[0]) >= 2000 or held > 8 << 20:
                        held = 0
                        yield flush()
        yield flush()

    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    found = files.select("path", "content").mapInArrow(run, schema)
    if not with_payload:
        found = scratch(found, "warc-headers")  # read three times below
    reps = found.where("record_type = 'response' and page_id is not null").select(F.col("page_id").alias("refers_to"), "payload_digest", F.col("payload_bytes").alias("of_response"))
    revisits = found.where("record_type = 'revisit'")
    wanted = revisits.select("refers_to", "payload_digest").distinct()
    reps = reps.join(wanted, ["refers_to", "payload_digest"], "left_semi").groupBy("refers_to", "payload_digest").agg(F.max("of_response").alias("of_response"))
    reps = reps.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    revisits = revisits.withColumn("salt", F.pmod(F.xxhash64("page_id"), F.lit(SALTS)).cast("int"))
    resolved = revisits.join(reps, ["refers_to", "payload_digest", "salt"], "left").withColumn("payload_bytes", F.col("of_response"))
    return found.where("record_type = 'response'").select(names).unionByName(resolved.select(names))


def round_trip(pages: DataFrame, path: str | None = None, min_payload: int = 0) -> DataFrame:
    """Writes the archives (into the shared folder unless a path is given) and reads them back."""
    import uuid

    spark = pages.sparkSession
    path = path or f"{shared_dir(spark)}/warc-{uuid.uuid4().hex}"
    write(pages, path, min_payload)
    return read(spark, path).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


ROUND_TRIP_SQL = f"""
WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
d AS (SELECT page_id, octet_length(encode(h)) AS payload_bytes, sha1(h) AS x FROM p),
b AS (SELECT page_id, payload_bytes, list_aggregate(list_transform(range(32), lambda i: substr('{BASE32}', 1 + (((('0x' || substr(x, 5 * (i // 4) + 1, 5))::INT >> (15 - 5 * (i % 4))) & 31))::INT, 1)), 'string_agg', '') AS payload_digest FROM d),
m AS (SELECT *, max(page_id) OVER (PARTITION BY payload_digest, payload_bytes) AS r FROM b)
SELECT page_id, payload_bytes::BIGINT AS payload_bytes, payload_digest, CASE WHEN page_id = r THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> r THEN r END AS refers_to FROM m"""
