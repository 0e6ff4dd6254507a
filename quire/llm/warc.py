"""Content-addressed WARC archives.

Two tables make an archive. ``payloads`` stores the bytes of each distinct payload once, under its SHA-256.
``headers`` stores each record's exact header bytes (WARC header and HTTP header) and the digest it points to.
Records come back by joining the two, byte for byte.

Digests are verified: when payloads are stored, rows of one digest must agree in length and a second hash; when
they are read, the digest is computed again from the stored bytes. Either check ends the job where it fails.

All of it is DataFrame expressions. Copies meet in a grouped aggregation that combines before its shuffle, so a
payload that a third of all records share moves once a task; the joins on the digest leave a hot digest to
adaptive skew splitting on the header side.

Defined results: a null payload is empty; payloads under ``min_bytes`` are always responses; rows that repeat a
page and its payload are records of one type each; a null page id refers to the smallest id of its payload where
there is one, else is a response; a null url is written as ``urn:null``; a payload of any length is one value of its row; of pages that tie for the smallest id
with one payload, all are responses; other columns are ignored, whatever their names; an empty table gives an empty archive.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .base import new_path

CRLF = "\r\n"
DATE = "2024-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def _checked(ok: Column, value: Column, said: str) -> Column:
    return F.when(ok, value).otherwise(F.raise_error(said).cast("string"))


def write_archive(pages: DataFrame, path: str, key: str = "page_id", url: str = "url", payload: str = "html", min_bytes: int = 100, date: str = DATE) -> None:
    """Write ``pages`` as the archive at ``path``."""
    spark = pages.sparkSession
    src = pages.select(F.col(key).alias("id"), F.col(url).alias("url"), F.encode(F.coalesce(F.col(payload).cast("string"), F.lit("")), "UTF-8").alias("payload"))
    src = src.withColumns({"digest": F.sha2("payload", 256), "n": F.length("payload").cast("long")})
    check = F.xxhash64("payload")
    stored = src.groupBy("digest").agg(
        F.min("id").alias("first_id"), F.min("n").alias("n"), F.max("n").alias("n2"), F.min(check).alias("c"), F.max(check).alias("c2"), F.any_value("payload").alias("payload")
    )
    same = (F.col("n") == F.col("n2")) & (F.col("c") == F.col("c2"))
    stored.select(_checked(same, F.col("digest"), "payloads of one digest differ").alias("digest"), "first_id", "n", "payload").write.option("compression", "zstd").parquet(f"{path}/payloads")

    firsts = spark.read.parquet(f"{path}/payloads").select("digest", "first_id")
    index = src.select("id", "url", "n", "digest").join(firsts, "digest")
    revisit = (F.col("n") >= min_bytes) & F.col("first_id").isNotNull() & ~F.col("id").eqNullSafe(F.col("first_id"))
    name = lambda c: F.concat(F.lit("<urn:page:"), F.coalesce(c.cast("string"), F.lit("null")), F.lit(">"))
    http = F.concat(F.lit(f"HTTP/1.1 200 OK{CRLF}Content-Type: text/html; charset=utf-8{CRLF}Content-Length: "), F.col("n").cast("string"), F.lit(CRLF + CRLF))
    kind = F.when(revisit, "revisit").otherwise("response")
    lines = F.concat(
        F.lit(f"WARC/1.1{CRLF}WARC-Type: "), kind,
        F.lit(f"{CRLF}WARC-Record-ID: "), name(F.col("id")),
        F.lit(f"{CRLF}WARC-Date: {date}{CRLF}WARC-Target-URI: "), F.coalesce(F.regexp_replace("url", r"[\r\n]", "%0A"), F.lit("urn:null")),
        F.lit(f"{CRLF}WARC-Payload-Digest: sha256:"), F.col("digest"),
        F.when(revisit, F.concat(F.lit(f"{CRLF}WARC-Profile: {PROFILE}{CRLF}WARC-Refers-To: "), name(F.col("first_id")))).otherwise(F.lit("")),
        F.lit(f"{CRLF}Content-Type: application/http; msgtype=response{CRLF}Content-Length: "),
        (F.length(http) + F.when(revisit, F.lit(0)).otherwise(F.col("n"))).cast("string"), F.lit(CRLF + CRLF), http,
    )
    index.select(F.encode(lines, "UTF-8").alias("header"), "digest").write.option("compression", "zstd").parquet(f"{path}/headers")


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """The archive's records: ``header``, ``payload`` (the full one, also of revisits), its ``digest`` computed again, and ``record``, the bytes of the original record."""
    headers = spark.read.parquet(f"{path}/headers")
    payloads = spark.read.parquet(f"{path}/payloads").select(F.col("digest").alias("told"), "payload")
    again = F.sha2("payload", 256)
    payloads = payloads.select("told", "payload", _checked(F.col("told") == again, again, "a stored payload doesn't match its digest").alias("digest"))
    both = headers.withColumnRenamed("digest", "told").join(payloads, "told", "left")
    shown = F.decode("header", "UTF-8")
    body = F.when(_field(shown, "WARC-Type") == "revisit", F.lit(b"")).otherwise(F.col("payload"))
    return both.select("header", "payload", "digest", F.concat("header", body, F.lit(b"\r\n\r\n")).alias("record"))


def _field(shown: Column, name: str) -> Column:
    found = F.regexp_extract(shown, rf"\r\n{name}: ([^\r\n]*)", 1)
    return F.when(found != "", found)


def parse_records(records: DataFrame) -> DataFrame:
    """What the records say: page_id, payload_bytes, payload_digest, record_type, refers_to, target_uri, record_bytes."""
    shown = F.decode("header", "UTF-8")
    number = lambda c: F.regexp_extract(c, r"^<urn:page:(-?\d+)>$", 1).try_cast("long")
    whole = F.regexp_extract(shown, r"\r\nContent-Type: application/http; msgtype=response\r\nContent-Length: (\d+)\r\n\r\n", 1).cast("long")
    head = F.length(F.regexp_extract(shown, r"(?s)^(.*?\r\n\r\n)", 1))
    block = F.length("record") - F.length(F.encode(F.regexp_extract(shown, r"(?s)^(.*?\r\n\r\n)", 1), "UTF-8")) - 4
    told = F.regexp_replace(_field(shown, "WARC-Payload-Digest"), "^sha256:", "")
    digest = _checked((told == F.col("digest")) & (block == whole) & (head > 0), F.col("digest"), "a record doesn't match its header")
    return records.select(
        number(_field(shown, "WARC-Record-ID")).alias("page_id"),
        F.length("payload").cast("long").alias("payload_bytes"),
        digest.alias("payload_digest"),
        _field(shown, "WARC-Type").alias("record_type"),
        number(_field(shown, "WARC-Refers-To")).alias("refers_to"),
        _field(shown, "WARC-Target-URI").alias("target_uri"),
        F.length("record").cast("long").alias("record_bytes"),
    )


def archived(pages: DataFrame) -> DataFrame:
    """Write ``pages`` to a fresh archive in the shared folder and read it back."""
    spark = pages.sparkSession
    path = new_path(spark, "warc")
    write_archive(pages, path)
    return parse_records(read_records(spark, path)).drop("target_uri", "record_bytes")


ORACLE = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
     d AS (SELECT page_id, octet_length(encode(html))::BIGINT AS payload_bytes, sha256(html) AS payload_digest FROM p),
     f AS (SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS first_id FROM d)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN payload_bytes >= 100 AND page_id <> first_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN payload_bytes >= 100 AND page_id <> first_id THEN first_id END AS refers_to
FROM f
"""
