"""Content-addressed WARC archive.

An archive is two tables in one folder. `payloads` holds each distinct payload once, under its SHA-256. `headers` holds
the exact header bytes of every record and the SHA-256 that its payload has. Original records are header + block + CRLF
CRLF, where the block of a response is its HTTP head and the payload that a join brings back; a revisit has the HTTP
head alone and refers to the response. Reading verifies each stored payload against its address.

Copies are found on digests: payloads are reduced within each partition before the one shuffle that carries them (the
smallest id of a digest wins), so a payload with a third of all rows arrives once per map task. Only narrow rows (id, digest,
header) are joined by digest afterwards; Spark's adaptive skew join splits a hot digest there.

Defined results: a null payload is the empty payload; of equal payloads of at least `min_revisit_bytes` bytes the record
with the smallest id is the response and the others are revisits (null ids come last); rows that repeat that id with that payload are
responses too; shorter payloads are all responses; a null url is empty, CR and LF in it are percent-encoded; an empty
table gives an empty archive. Other columns are ignored, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from payloom.llm.common import shared_path, table, utf8

ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
DATE = "1970-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def base32(hex_col: Column) -> Column:
    """Base32 of a hex string whose length is a multiple of ten digits, without padding."""
    parts = []
    for at in (1, 11, 21, 31):
        chunk = F.conv(F.substring(hex_col, at, 10), 16, 10).cast("long")
        parts += [F.substring(F.lit(ALPHABET), (F.shiftright(chunk, shift).bitwiseAND(F.lit(31)) + 1).cast("int"), F.lit(1)) for shift in range(35, -1, -5)]
    return F.concat(*parts)


def _header(kind: Column, rec: Column, url: Column, digest: Column, refers: Column, block: Column) -> Column:
    revisit = kind == "revisit"
    return F.concat(
        F.lit("WARC/1.1\r\nWARC-Type: "), kind,
        F.lit("\r\nWARC-Record-ID: <urn:record:"), rec,
        F.lit(f">\r\nWARC-Date: {DATE}\r\nWARC-Target-URI: "), url,
        F.lit("\r\nWARC-Payload-Digest: sha1:"), digest,
        F.when(revisit, F.concat(F.lit(f"\r\nWARC-Profile: {PROFILE}\r\nWARC-Refers-To: <urn:record:"), refers, F.lit(">"))).otherwise(F.lit("")),
        F.lit("\r\nContent-Type: application/http; msgtype=response\r\nContent-Length: "), block.cast("string"), F.lit("\r\n\r\n"),
    )


def write_archive(pages: DataFrame, path: str, *, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", min_revisit_bytes: int = 0) -> None:
    """Write the archive of pages to path (tables payloads and headers)."""
    spark = pages.sparkSession
    payload = F.coalesce(utf8(F.col(payload_col)), F.lit(b""))
    rows = pages.select(F.col(id_col).alias("id"), F.coalesce(F.col(url_col).cast("string"), F.lit("")).alias("url"), payload.alias("payload")).withColumn("address", F.unhex(F.sha2("payload", 256)))
    first = F.min(F.struct(F.col("id").isNull().alias("no_id"), F.col("id"), F.col("payload"))).alias("first")
    rows.groupBy("address").agg(first).select("address", F.col("first.id").alias("first_id"), F.col("first.payload").alias("payload")).write.option("compression", "zstd").parquet(f"{path}/payloads")
    kept = spark.read.parquet(f"{path}/payloads").select("address", "first_id", F.length("payload").cast("long").alias("size"), F.sha1("payload").alias("sha1"))
    narrow = rows.select("id", "url", "address")
    own = F.col("id").eqNullSafe(F.col("first_id"))
    kind = F.when(own | (F.col("size") < min_revisit_bytes), "response").otherwise("revisit")
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.col("size").cast("string"), F.lit("\r\n\r\n"))
    url = F.regexp_replace(F.regexp_replace("url", "\r", "%0D"), "\n", "%0A")
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    narrow.join(kept, "address").withColumn("kind", kind).withColumn("http", http).select(
        "address",
        _header(F.col("kind"), text("id"), url, base32(F.col("sha1")), text("first_id"), F.length("http") + F.when(F.col("kind") == "response", F.col("size")).otherwise(0)).cast("binary").alias("header"),
        F.col("http").cast("binary").alias("http"),
    ).write.option("compression", "zstd").parquet(f"{path}/headers")


def verified_payloads(spark: SparkSession, path: str) -> DataFrame:
    """address, payload of the archive; a payload that doesn't have its address ends the query."""
    ok = F.unhex(F.sha2("payload", 256)) == F.col("address")
    return spark.read.parquet(f"{path}/payloads").select("address", F.when(ok, F.col("payload")).otherwise(F.raise_error(F.lit("a stored payload does not match its digest"))).alias("payload"))


def _field(name: str) -> Column:
    return F.regexp_extract(F.col("header").cast("string"), rf"\r\n{name}: ([^\r]*)\r\n", 1)


def read_headers(spark: SparkSession, path: str, id_type: str = "bigint") -> DataFrame:
    """The records' parsed headers: id, record_type, refers_to, digest, url, content_length, address, header, http."""
    number = lambda c: F.nullif(F.regexp_extract(c, "<urn:record:(.*)>", 1), F.lit("")).cast(id_type)
    return spark.read.parquet(f"{path}/headers").select(
        number(_field("WARC-Record-ID")).alias("id"),
        _field("WARC-Type").alias("record_type"),
        number(_field("WARC-Refers-To")).alias("refers_to"),
        F.substring_index(_field("WARC-Payload-Digest"), ":", -1).alias("digest"),
        _field("WARC-Target-URI").alias("url"),
        _field("Content-Length").cast("long").alias("content_length"),
        "address", "header", "http",
    )


def reconstruct(spark: SparkSession, path: str, id_type: str = "bigint") -> DataFrame:
    """id, record (the original WARC record's bytes), payload (the full one, for revisits too)."""
    joined = read_headers(spark, path, id_type).join(verified_payloads(spark, path), "address")
    body = F.when(F.col("record_type") == "response", F.col("payload")).otherwise(F.lit(b""))
    return joined.select("id", F.concat("header", "http", body, F.lit(b"\r\n\r\n")).alias("record"), "payload")


def op2_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = shared_path(spark, "warc")
    write_archive(table(spark, sf_dir, "pages"), path, min_revisit_bytes=0)
    kept = verified_payloads(spark, path).select("address", F.length("payload").cast("long").alias("payload_bytes"), base32(F.sha1("payload")).alias("payload_digest"))
    return read_headers(spark, path).join(kept, "address").select(F.col("id").alias("page_id"), "payload_bytes", "payload_digest", "record_type", "refers_to")


_CHARS = " || ".join(f"substr('{ALPHABET}', (((('0x' || substr(h, {at}, 10))::BIGINT >> {shift}) & 31) + 1)::BIGINT, 1)" for at in (1, 11, 21, 31) for shift in range(35, -1, -5))
OP2_SQL = f"""
WITH p AS (SELECT page_id, coalesce(html, '') AS body, sha1(coalesce(html, '')) AS h FROM pages),
r AS (SELECT page_id, strlen(body)::BIGINT AS payload_bytes, {_CHARS} AS payload_digest, min(page_id) OVER (PARTITION BY body) AS first_id FROM p)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN page_id = first_id THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id <> first_id THEN first_id END AS refers_to FROM r
"""

QUERIES = {"op2_warc": op2_warc}
ORACLES = {"op2_warc": OP2_SQL}
