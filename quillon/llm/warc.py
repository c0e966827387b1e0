"""WARC archives with revisit records for payloads that were seen before.

Headers (no payloads) are shuffled by payload digest: of each digest one record
becomes the response and every other joins to it as a revisit.  Verdicts go back to
the pages by their place in their file, and the archives are written by Spark's text
writer, whose line separator, ``CR LF CR LF``, is what ends a WARC record: files are
committed as a whole, on whatever file system the shared folder is, and gzip'd.
A file begins with a warcinfo record and holds about ``ARCHIVE_BYTES`` of payloads, so it can
be read whole.  Headers are fresh: date, record id and lengths are those of the writing.
Reading follows each record's Content-Length, so payloads may hold any bytes; a response's
digest is taken of its payload, and a revisit's is held against its original's.

Of equal payloads of ``least_bytes`` or more the largest page_id is the response (of
several rows with that page_id, one of them); smaller payloads are all responses.
Null html is an empty payload; null page_ids sort lowest; a null url gives a record
without a target; an empty table gives no records; other columns are not written.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import io
import math

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ROW, identified, new_path, partitions, written

CRLF = "\r\n"
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
ARCHIVE_BYTES = 64 << 20
RESULT = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long"


def base32_sha1(payload: Column) -> Column:
    """Upper-case base32 of the SHA-1: five hex digits are four letters."""
    digest = F.sha1(payload)

    def letters(i: int) -> Column:
        v = F.conv(F.substring(digest, 5 * i + 1, 5), 16, 10).cast("int")
        return F.concat(*(F.substring(F.lit(ALPHABET), F.shiftright(v, k).bitwiseAND(31) + 1, F.lit(1)) for k in (15, 10, 5, 0)))

    return F.concat(*map(letters, range(8)))


def verdicts(headers: DataFrame, least_bytes: int = 0) -> DataFrame:
    """Headers (ROW, page_id, digest, bytes) with record_type, refers_to, target and target's row."""
    one = F.struct(F.col("page_id"), *ROW, F.col("url"))
    originals = headers.where(F.col("bytes") >= least_bytes).groupBy("digest", "bytes").agg(F.max(one).alias("o"))
    df = headers.join(originals, ["digest", "bytes"], "left")
    same = (F.col(f"o.{ROW[0]}") == F.col(ROW[0])) & (F.col(f"o.{ROW[1]}") == F.col(ROW[1]))
    revisit = F.col("o").isNotNull() & ~F.coalesce(same, F.lit(False))
    return df.select(*ROW, "digest", "bytes", F.when(revisit, F.col("o")).alias("o"))


def write_archives(pages: DataFrame, path: str, least_bytes: int = 0, date: Column | None = None) -> None:
    """Write a record per page (page_id, url, html) as gzip'd WARC files under ``path``."""
    spark = pages.sparkSession
    keyed = identified(pages.select("page_id", "url", "html"))
    payload = F.coalesce("html", F.lit(""))
    headers = keyed.select(*ROW, "page_id", "url", base32_sha1(payload).alias("digest"), F.octet_length(payload).cast("long").alias("bytes"))
    own = written(verdicts(headers, least_bytes), "headers")
    files = max(partitions(spark), math.ceil((own.agg(F.sum("bytes")).first()[0] or 0) / ARCHIVE_BYTES))
    df = keyed.repartition(files, *ROW).join(own.repartition(files, *ROW), ROW)  # one shuffle, a file a partition
    date = F.date_format(F.to_utc_timestamp(F.current_timestamp(), F.current_timezone()), "yyyy-MM-dd'T'HH:mm:ss'Z'") if date is None else date
    name = lambda f, r: F.concat(F.lit("<urn:sha1:"), F.sha1(F.concat_ws(":", f, r)), F.lit(">"))
    line = lambda key, value: F.coalesce(F.concat(F.lit(f"{key}: "), value.cast("string"), F.lit(CRLF)), F.lit(""))
    uri = lambda c: F.regexp_replace(c, "[\\x00-\\x20\\x7f]", "%20")
    o = F.col("o")
    http = F.concat(F.lit(f"HTTP/1.1 200 OK{CRLF}Content-Type: text/html; charset=utf-8{CRLF}"), line("Content-Length", F.col("bytes")), F.lit(CRLF))
    kept = F.when(o.isNull(), F.col("bytes")).otherwise(0)
    record = F.concat(
        F.lit(f"WARC/1.1{CRLF}"),
        line("WARC-Type", F.when(o.isNull(), "response").otherwise("revisit")),
        line("WARC-Record-ID", name(F.col(ROW[0]), F.col(ROW[1]))),
        line("WARC-Date", date),
        line("WARC-Target-URI", uri(F.col("url"))),
        line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), "digest")),
        line("WARC-Profile", F.when(o.isNotNull(), "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")),
        line("WARC-Refers-To", F.when(o.isNotNull(), name(o[ROW[0]], o[ROW[1]]))),
        line("WARC-Refers-To-Target-URI", uri(o["url"])),
        line("WARC-Refers-To-Date", F.when(o.isNotNull(), date)),
        line("X-Page-Id", F.col("page_id")),
        line("X-Refers-To-Page-Id", o["page_id"]),
        line("Content-Type", F.lit("application/http; msgtype=response")),
        line("Content-Length", F.octet_length(http) + kept),
        F.lit(CRLF),
        http,
        F.when(o.isNull(), payload).otherwise(""),
    )
    about = f"software: quillon{CRLF}format: WARC File Format 1.1{CRLF}"
    info = F.concat(
        F.lit(f"WARC/1.1{CRLF}WARC-Type: warcinfo{CRLF}"),
        line("WARC-Record-ID", F.concat(F.lit("<urn:uuid:"), F.uuid(), F.lit(">"))),
        line("WARC-Date", date),
        F.lit(f"Content-Type: application/warc-fields{CRLF}Content-Length: {len(about)}{CRLF}{CRLF}{about}{CRLF}{CRLF}"),
    )
    first = F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1) == 0
    out = df.select(F.concat(F.when(first, info).otherwise(""), record).alias("value"))
    out.write.option("lineSep", CRLF * 2).option("compression", "gzip").option("zlib.compress.level", "BEST_SPEED").text(path)


def records(f) -> "iter":
    """(headers, block) of every record of an open archive."""
    while first := f.readline():
        if first.strip() != b"WARC/1.1":
            raise ValueError(f"no record starts with {first[:20]!r}")
        headers = {}
        while (row := f.readline()).strip():
            key, _, value = row.decode("utf-8", "surrogatepass").partition(":")
            headers[key] = value.strip()
        block = f.read(int(headers["Content-Length"]))
        if f.read(4) != b"\r\n\r\n":
            raise ValueError("a record's block doesn't end where its length says")
        yield headers, block


def read_archives(spark, path: str) -> DataFrame:
    """One row per response or revisit; what their headers say of payloads and originals is checked."""

    def run(batches):
        kinds = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string()]
        names = [*(x.split()[0] for x in RESULT.split(", ")), "record"]
        for batch in batches:
            for content in batch.column(0):
                rows = []
                for h, block in records(gzip.open(io.BytesIO(content.as_buffer()))):
                    if h["WARC-Type"] == "warcinfo":
                        continue
                    http, _, payload = block.partition(b"\r\n\r\n")
                    size = int(http.rpartition(b"Content-Length: ")[2])
                    digest, kind = h["WARC-Payload-Digest"].removeprefix("sha1:"), h["WARC-Type"]
                    if kind == "response" and (len(payload) != size or base64.b32encode(hashlib.sha1(payload).digest()).decode() != digest):
                        raise ValueError("a payload differs from its header")
                    page, to = h.get("X-Page-Id"), h.get("X-Refers-To-Page-Id")
                    rows.append((page and int(page), h.get("WARC-Target-URI"), size, digest, kind, to and int(to), h.get("WARC-Refers-To", h["WARC-Record-ID"])))
                columns = list(zip(*rows, strict=True)) or [[]] * 7
                yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(columns, kinds, strict=True)], names=names)

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.gz").load(path).select("content")
    found = written(files.mapInArrow(run, f"{RESULT}, record string"), "records")
    groups = found.groupBy("record").agg(F.min("payload_digest").alias("a"), F.max("payload_digest").alias("b"), F.sum((F.col("record_type") == "response").cast("int")).alias("n"))
    if not groups.where("a <> b OR n <> 1").isEmpty():
        raise ValueError("a revisit differs from its original, or has none")
    return found.drop("record")


def op9_warc_revisits(spark, sf_dir: str) -> DataFrame:
    path = new_path(spark, "warc")
    write_archives(spark.read.parquet(f"{sf_dir}/pages.parquet"), path)
    return read_archives(spark, path).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


ORACLE_SQL = f"""
WITH p AS (SELECT page_id, coalesce(html, '') AS t, sha1(coalesce(html, '')) AS h FROM pages),
r AS (SELECT *, row_number() OVER (PARTITION BY h ORDER BY page_id DESC) AS n, max(page_id) OVER (PARTITION BY h) AS top FROM p)
SELECT page_id, strlen(t)::BIGINT AS payload_bytes,
  array_to_string(list_transform(range(0, 8), lambda i: list_aggregate(list_transform([15, 10, 5, 0],
    lambda k: substr('{ALPHABET}', ((('0x' || substr(h, (5 * i + 1)::INT, 5))::BIGINT >> k) & 31)::INT + 1, 1)), 'string_agg', '')), '') AS payload_digest,
  CASE WHEN n = 1 THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN n > 1 THEN top END AS refers_to
FROM r
"""
