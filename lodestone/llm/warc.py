"""Content-addressed WARC archive.

Payload bytes are stored once per verified SHA-256 digest, exact record headers in a table of their own, and records
are put together again by a join on the digest. All steps are built-in expressions.
"""

from __future__ import annotations

from datetime import UTC, datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import new_path, table, written

MIN_REVISIT_BYTES = 100
#: Copies of one payload from which on its records are dealt over several tasks, this many to each.
HOT = 1000


def spread(rows: DataFrame, hot: DataFrame) -> DataFrame:
    """``rows`` with ``salt``: a place for each record of a hot digest, 0 for all others."""
    out = rows.join(hot, "digest", "left")  # hot is small, at most the number of rows / HOT, and written with its size
    return out.withColumn("salt", F.coalesce(F.pmod(F.xxhash64("page_id"), F.col("salts")), F.lit(0))).drop("salts")


def on_digest(records: DataFrame, one: DataFrame, counts: DataFrame) -> DataFrame:
    """``records`` joined to the one row that ``one`` has for each digest; hot digests meet in several tasks."""
    hot = written(counts.groupBy("digest").count().where(F.col("count") > HOT).select("digest", F.ceil(F.col("count") / HOT).cast("long").alias("salts")), "hot")
    copies = one.join(hot, "digest", "left").withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.coalesce("salts", F.lit(1).cast("long")) - 1))).drop("salts")
    return spread(records, hot).join(copies, ["digest", "salt"]).drop("salt")


def write_archive(pages: DataFrame, path: str, min_bytes: int = MIN_REVISIT_BYTES, date: str | None = None) -> None:
    """Write ``path/payloads`` (digest, payload) and ``path/headers`` (page_id, header).

    Null html is an empty payload; a null url an empty target. Among equal payloads of ``min_bytes`` or more the
    smallest page_id is the response; rows that repeat that page_id with the same payload are responses too. A null
    page_id counts as larger than any other. Extra columns are ignored. An empty table gives an empty archive.
    ``date`` (UTC, as in 2024-01-31T12:00:00Z) is that of all records, the time of writing where it isn't given.
    """
    date = date or datetime.now(UTC).strftime("%Y-%m-%dT%H:%M:%SZ")
    payload = F.coalesce(F.col("html").cast("binary"), F.lit(b""))
    base = pages.select("page_id", "url", payload.alias("payload"))
    # One pass over the payloads leaves a narrow table for all that follows.
    facts = written(base.select("page_id", "url", F.sha2("payload", 256).alias("digest"), F.octet_length("payload").cast("long").alias("size"), F.md5("payload").alias("second")), "facts")
    same = (F.min("size") == F.max("size")) & (F.min("second") == F.max("second"))
    rank = F.struct(F.col("page_id").isNull().alias("none"), F.col("page_id").alias("id"))
    # The digest is trusted only when a second digest and the length agree within each group.
    firsts = facts.groupBy("digest").agg(F.when(same, F.min(rank)).otherwise(F.raise_error(F.lit("two payloads share a SHA-256 digest"))).alias("first"))
    firsts = written(firsts.select("digest", "first.none", F.col("first.id").alias("first_id"), F.coalesce("first.id", F.lit(0).cast("long")).alias("rank")), "firsts")

    # Grouping by the join's own keys needs no further exchange, and no task gets all copies of a payload.
    keyed = base.select(F.sha2("payload", 256).alias("digest"), F.col("page_id").isNull().alias("none"), F.coalesce("page_id", F.lit(0).cast("long")).alias("rank"), "payload")
    keys = ["digest", "none", "rank"]
    once = keyed.join(firsts.select(*keys), keys)
    once.groupBy(*keys).agg(F.first("payload").alias("payload")).select("digest", "payload").write.parquet(f"{path}/payloads")

    kept = on_digest(facts.drop("second"), firsts.select("digest", "first_id"), facts)
    response = (F.col("size") < min_bytes) | F.col("page_id").eqNullSafe(F.col("first_id"))
    uri = F.regexp_replace(F.regexp_replace(F.coalesce("url", F.lit("")), "\r", "%0D"), "\n", "%0A")
    name = lambda c: F.concat(F.lit("<urn:page:"), F.coalesce(F.col(c).cast("string"), F.lit("null")), F.lit(">"))
    # A record's block is a response of HTTP: its own head is kept with the record's, the payload apart.
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.col("size").cast("string"), F.lit("\r\n\r\n"))
    length = F.octet_length(http) + F.when(response, F.col("size")).otherwise(0)
    header = F.concat(
        F.lit("WARC/1.1\r\nWARC-Type: "), F.when(response, "response").otherwise("revisit"),
        F.lit("\r\nWARC-Record-ID: "), name("page_id"),
        F.lit(f"\r\nWARC-Date: {date}\r\nWARC-Target-URI: "), uri,
        F.when(response, "").otherwise(F.concat(F.lit("\r\nWARC-Refers-To: "), name("first_id"), F.lit("\r\nWARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"))),
        F.lit("\r\nWARC-Payload-Digest: sha256:"), F.col("digest"),
        F.lit("\r\nContent-Type: application/http; msgtype=response\r\nContent-Length: "), length.cast("string"), F.lit("\r\n\r\n"), http,
    )
    kept.select("page_id", header.alias("header")).write.parquet(f"{path}/headers")


def read_archive(spark: SparkSession, path: str) -> DataFrame:
    """(page_id, header, record, payload, payload_digest): whole records, rebuilt by a join on the digest.

    ``header`` ends with the head of the HTTP response. ``record`` holds the bytes of the WARC record, whose block
    has no payload for a revisit; ``payload`` is the full one for every record. A stored payload that no longer has
    its digest raises.
    """
    headers = spark.read.schema("page_id long, header string").parquet(f"{path}/headers")
    payloads = spark.read.schema("digest string, payload binary").parquet(f"{path}/payloads")
    checked = payloads.select("digest", F.when(F.sha2("payload", 256) == F.col("digest"), F.col("payload")).otherwise(F.raise_error(F.lit("damaged payload")).cast("binary")).alias("payload"))
    named = headers.withColumn("digest", field("WARC-Payload-Digest", "sha256:([0-9a-f]{64})"))
    rows = on_digest(named, checked, named)
    block = F.when(field("WARC-Type") == "response", F.col("payload")).otherwise(F.lit(b""))
    return rows.select(
        "page_id", "header", F.concat(F.col("header").cast("binary"), block, F.lit(b"\r\n\r\n")).alias("record"), "payload", F.col("digest").alias("payload_digest")
    )


def field(name: str, value: str = "([^\r\n]*)"):
    """A named field of the header; its first match, so a target can't pose as a later field."""
    return F.regexp_extract("header", f"\r\n{name}: {value}\r\n", 1)


def op10_warc_content_addressed(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_path(spark, "warc")
    write_archive(table(spark, sf_dir, "pages"), path)
    kind = field("WARC-Type")
    return read_archive(spark, path).select(
        "page_id", F.octet_length("payload").cast("long").alias("payload_bytes"), "payload_digest", kind.alias("record_type"),
        F.when(kind == "revisit", field("WARC-Refers-To", "<urn:page:(-?[0-9]+)>").try_cast("long")).alias("refers_to"),
    )


ORACLE_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
q AS (SELECT page_id, CAST(octet_length(encode(h)) AS BIGINT) AS payload_bytes, sha256(h) AS payload_digest, min(page_id) OVER (PARTITION BY h) AS f FROM p)
SELECT page_id, payload_bytes, payload_digest,
  CASE WHEN payload_bytes < 100 OR page_id = f THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN payload_bytes < 100 OR page_id = f THEN NULL ELSE f END AS refers_to
FROM q
"""
