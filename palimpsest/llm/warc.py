"""Content-addressed WARC archive (operator 2).

``write_archive`` keeps two tables in a folder: ``payloads`` (address, payload), each distinct
payload once under its SHA-256, and ``headers`` (page_id, address, header), the exact header
block of every record. ``read_archive`` joins them into the original records. A digest is
verified both ways: copies that share an address must also share length and MD5 when they
are written, and stored bytes must hash to their address when they are read.

A null payload is empty. A null id takes no part in choosing the response of a group, and its
record is a response. Rows that repeat the largest id of a group are all responses. Null
addresses (url) leave out WARC-Target-URI; line breaks in one are percent-encoded.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palimpsest.llm._base import table
from palimpsest.sources.store import shared_dir

NAME = "op2_warc_archive"
LEAST = 1000
DATE = "2024-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
ENDS = "\r\n"


def _records(pages: DataFrame, id_col: str, url_col: str, payload_col: str) -> DataFrame:
    payload = F.coalesce(F.col(payload_col).cast("binary"), F.lit("").cast("binary"))
    return pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), payload.alias("payload")).withColumn("address", F.sha2("payload", 256))


def write_archive(
    pages: DataFrame,
    path: str,
    least: int = LEAST,
    date: str = DATE,
    id_col: str = "page_id",
    url_col: str = "url",
    payload_col: str = "html",
) -> None:
    """Write ``path/payloads`` and ``path/headers``.

    Of records with equal payloads of ``least`` bytes or more, the one with the largest id is
    a response and the others revisit it.
    """
    spark = pages.sparkSession
    records = _records(pages, id_col, url_col, payload_col)
    check = F.concat_ws(":", F.length("payload").cast("string"), F.md5("payload"))
    (
        records.groupBy("address")
        .agg(F.first("payload").alias("payload"), F.min(check).alias("low"), F.max(check).alias("high"))
        .where(F.when(F.col("low") == F.col("high"), True).otherwise(F.raise_error(F.concat(F.lit("two payloads share the address "), "address"))))
        .select("address", "payload")
        .write.parquet(f"{path}/payloads")
    )
    keys = records.select("page_id", "url", "address", F.length("payload").cast("long").alias("n"), F.sha1("payload").alias("sha1"))
    # One row per repeated payload; written, so that the join below can split a hot address.
    (
        keys.where((F.col("n") >= least) & F.col("page_id").isNotNull())
        .groupBy("address")
        .agg(F.max("page_id").alias("response"), F.count("*").alias("copies"))
        .where("copies > 1")
        .select("address", "response")
        .write.parquet(f"{path}/repeated")
    )
    revisit = F.col("response").isNotNull() & (F.col("page_id") < F.col("response"))
    name = lambda c: F.concat(F.lit("<urn:page:"), F.coalesce(c.cast("string"), F.lit("")), F.lit(">"))
    line = lambda key, value: F.concat(F.lit(f"{key}: "), value)
    url = F.replace(F.replace("url", F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A"))
    header = F.concat(
        F.concat_ws(
            ENDS,
            F.lit("WARC/1.1"),
            line("WARC-Type", F.when(revisit, "revisit").otherwise("response")),
            line("WARC-Record-ID", name(F.col("page_id"))),
            F.lit(f"WARC-Date: {date}"),
            line("WARC-Target-URI", url),
            F.when(revisit, F.lit(f"WARC-Profile: {PROFILE}")),
            F.when(revisit, line("WARC-Refers-To", name(F.col("response")))),
            line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), "sha1")),
            F.lit("Content-Type: text/html; charset=utf-8"),
            line("Content-Length", F.when(revisit, F.lit(0)).otherwise(F.col("n")).cast("string")),
        ),
        F.lit(ENDS * 2),
    )
    (
        keys.join(spark.read.parquet(f"{path}/repeated"), "address", "left")
        .select("page_id", "address", header.alias("header"))
        .write.parquet(f"{path}/headers")
    )


def read_headers(spark: SparkSession, path: str) -> DataFrame:
    """What the stored header blocks say, one row per record."""
    field = lambda key: F.nullif(F.regexp_extract("header", f"\r\n{key}: ([^\r]*)\r\n", 1), F.lit(""))
    number = lambda key: F.nullif(F.regexp_extract(field(key), "^<urn:page:(-?[0-9]*)>$", 1), F.lit("")).cast("long")
    return spark.read.parquet(f"{path}/headers").select(
        number("WARC-Record-ID").alias("page_id"),
        "address",
        "header",
        field("WARC-Type").alias("record_type"),
        number("WARC-Refers-To").alias("refers_to"),
        F.regexp_extract(field("WARC-Payload-Digest"), "^sha1:(.*)$", 1).alias("named_digest"),
        field("WARC-Target-URI").alias("url"),
    )


def read_payloads(spark: SparkSession, path: str) -> DataFrame:
    """The payload store, every payload's bytes checked against its address."""
    stored = spark.read.parquet(f"{path}/payloads")
    return stored.where(F.when(F.sha2("payload", 256) == F.col("address"), True).otherwise(F.raise_error(F.concat(F.lit("damaged payload "), "address"))))


def read_archive(spark: SparkSession, path: str) -> DataFrame:
    """Original records: header fields, the full payload, and the record's bytes."""
    block = F.when(F.col("record_type") == "revisit", F.lit("").cast("binary")).otherwise(F.col("payload"))
    return (
        read_headers(spark, path)
        .join(read_payloads(spark, path), "address")
        .withColumn("record", F.concat(F.col("header").cast("binary"), block, F.lit(ENDS * 2).cast("binary")))
    )


def export_warc(spark: SparkSession, path: str, out: str) -> None:
    """Plain WARC files (gzip) in ``out``, for payloads in UTF-8."""
    whole = F.expr("substring(record, 1, length(record) - 4)").cast("string")
    read_archive(spark, path).select(whole.alias("value")).write.option("lineSep", ENDS * 2).option("compression", "gzip").text(out)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = f"{shared_dir(spark)}/warc"
    write_archive(table(spark, sf_dir, "pages"), path)
    whole = read_archive(spark, path).withColumn("payload_bytes", F.length("payload").cast("long")).withColumn("payload_digest", F.sha1("payload"))
    block = F.when(F.col("record_type") == "revisit", F.lit(0)).otherwise(F.col("payload_bytes"))
    faults = (
        (F.col("payload_digest") == F.col("named_digest"), "a header names another digest than its payload has"),
        (F.length("record") == F.octet_length("header") + block + 2 * len(ENDS), "a record is not as long as its parts"),
        (F.regexp_extract("header", "\r\nContent-Length: ([0-9]+)\r\n", 1) == block.cast("string"), "a header names another length than its record has"),
    )
    for fine, why in faults:
        whole = whole.where(F.when(fine, True).otherwise(F.raise_error(F.lit(why))))
    return whole.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


ORACLE = f"""
WITH p AS (
  SELECT page_id, coalesce(html, '') AS html, CAST(strlen(coalesce(html, '')) AS BIGINT) AS n FROM pages
), g AS (
  SELECT html, max(page_id) AS response FROM p WHERE n >= {LEAST} GROUP BY html
)
SELECT p.page_id, p.n AS payload_bytes, sha1(p.html) AS payload_digest,
       CASE WHEN p.page_id < g.response THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN p.page_id < g.response THEN g.response END AS refers_to
FROM p LEFT JOIN g ON p.html = g.html AND p.n >= {LEAST}
"""
