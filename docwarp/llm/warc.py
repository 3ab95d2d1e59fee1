"""A content-addressed WARC archive.

``payloads`` (digest, payload, first_id, parts, salts) holds the bytes of every distinct payload once under its SHA-256; ``headers``
(page_id, digest, part, header) holds the exact header bytes of every record. A join of the two rebuilds every original record; digests
are computed again from the stored bytes and compared. Records of a payload that very many share are dealt to ``parts`` joins of it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docwarp.llm.common import scratch_path

BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
SALTS = 128  # tasks over which the records of one payload spread when they are written
PART = 256  # records of one payload that meet it in one place when they are read


def base32_sha1(data: Column) -> Column:
    """Bare upper-case base32 of the SHA-1: eight groups of five hex digits, each four base32 digits."""
    hexed = F.sha1(data)
    groups = F.transform(F.sequence(F.lit(0), F.lit(7)), lambda i: F.conv(F.substring(hexed, i * 5 + 1, F.lit(5)), 16, 10).cast("int"))
    digit = lambda n, by: F.substring(F.lit(BASE32), F.shiftright(n, by).bitwiseAND(31) + 1, F.lit(1))
    return F.array_join(F.transform(groups, lambda n: F.concat(*(digit(n, by) for by in (15, 10, 5, 0)))), "")


def write_archive(pages: DataFrame, path: str, least: int = 0, date: str = "1970-01-01T00:00:00Z") -> str:
    """Write a record per row of ``pages`` (page_id, url, html) under ``path``; returns ``path``.

    The payload is the html in UTF-8 (null: empty). Of records whose payloads are equal and at least ``least`` bytes long, the one with the
    largest page_id is the response and the others revisit it; shorter ones are responses all. Repeated rows: the response and
    its exact repeats are responses. Null url: an empty target; null page_id: a record of its own that others come before. ``date``: the
    WARC-Date of all records, as pages have none. Rows with one page_id share a record id. Extra columns are ignored; an empty table
    gives an empty archive.
    """
    spark = pages.sparkSession
    payload = F.coalesce(F.encode("html", "UTF-8"), F.lit(b""))
    salt = F.pmod(F.xxhash64("page_id"), F.lit(SALTS)).cast("int")
    rows = pages.select("page_id", "url", payload.alias("payload"), salt.alias("salt")).withColumn("digest", F.sha2("payload", 256)).withColumn("n", F.octet_length("payload").cast("long"))
    # Payloads move once; tasks merge equal ones before.
    once = rows.groupBy("digest").agg(
        F.first("payload").alias("payload"), F.max("page_id").alias("first_id"), F.min("n").alias("least"), F.max("n").alias("most"), F.count("*").alias("records"), F.collect_set("salt").alias("salts")
    )
    sound = F.when(F.col("least") == F.col("most"), F.col("payload")).otherwise(F.raise_error(F.lit("two payloads share a digest")).cast("binary"))
    once.select("digest", sound.alias("payload"), "first_id", F.ceil(F.col("records") / PART).cast("int").alias("parts"), "salts").write.option("compression", "zstd").parquet(f"{path}/payloads")
    firsts = _payloads(spark, path).select("digest", "first_id", "parts", F.explode("salts").alias("salt"))
    heads = rows.select("page_id", F.coalesce("url", F.lit("")).alias("url"), "digest", "salt", "n", base32_sha1(F.col("payload")).alias("sha1"))
    found = heads.join(firsts, ["digest", "salt"]).withColumn("refers_to", F.when((F.col("n") >= least) & (F.col("page_id") != F.col("first_id")), F.col("first_id")))
    line = lambda name, value: F.concat(F.lit(f"{name}: "), value, F.lit("\r\n"))
    header = F.concat(
        F.lit("WARC/1.1\r\n"),
        line("WARC-Type", F.when(F.col("refers_to").isNull(), F.lit("response")).otherwise(F.lit("revisit"))),
        line("WARC-Record-ID", F.concat(F.lit("<urn:page:"), F.coalesce(F.col("page_id").cast("string"), F.lit("")), F.lit(">"))),
        line("WARC-Date", F.lit(date)),
        line("WARC-Target-URI", F.regexp_replace("url", "[\r\n]+", " ")),
        line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("sha1"))),
        F.when(F.col("refers_to").isNull(), F.lit("")).otherwise(
            F.concat(line("WARC-Profile", F.lit("http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")), line("WARC-Refers-To", F.concat(F.lit("<urn:page:"), F.col("refers_to").cast("string"), F.lit(">"))))
        ),
        line("Content-Type", F.lit("text/html; charset=utf-8")),
        line("Content-Length", F.when(F.col("refers_to").isNull(), F.col("n")).otherwise(F.lit(0)).cast("string")),
        F.lit("\r\n"),
    )
    part = F.pmod(F.xxhash64("page_id", "url"), F.col("parts")).cast("int")
    found.select("page_id", "digest", part.alias("part"), F.encode(header, "UTF-8").alias("header")).write.option("compression", "zstd").parquet(f"{path}/headers")
    return path


def _payloads(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("digest string, payload binary, first_id long, parts int, salts array<int>").parquet(f"{path}/payloads")


def _sound(payload: Column) -> Column:
    return F.when(F.sha2(payload, 256) == F.col("digest"), payload).otherwise(F.raise_error(F.lit("a payload is damaged")))


def read_payloads(spark: SparkSession, path: str) -> DataFrame:
    """digest, payload; a payload without its digest fails the job."""
    return _payloads(spark, path).select("digest", _sound(F.col("payload")).alias("payload"))


def read_headers(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("page_id long, digest string, part int, header binary").parquet(f"{path}/headers")


def field(header: Column, name: str) -> Column:
    """A header field's value; null if the record has none."""
    found = F.regexp_extract(header, rf"\r\n{name}: ([^\r\n]*)\r\n", 1)
    return F.when(F.contains(header, F.lit(f"\r\n{name}: ")), found)


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """Every record as it was: ``page_id, header, payload`` (the full one, for revisits too) and ``record`` (its WARC bytes)."""
    dealt = _payloads(spark, path).select("digest", _sound(F.col("payload")).alias("payload"), F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"))
    joined = read_headers(spark, path).join(dealt, ["digest", "part"])
    body = F.when(F.contains(F.decode("header", "UTF-8"), F.lit("\r\nWARC-Refers-To: ")), F.lit(b"")).otherwise(F.col("payload"))
    return joined.select("page_id", "header", "payload", F.concat("header", body, F.lit(b"\r\n\r\n")).alias("record"))


def index(spark: SparkSession, path: str) -> DataFrame:
    """``page_id, payload_bytes, payload_digest, record_type, refers_to`` of every record as it is rebuilt from the archive.

    A header that names another digest than its record's payload has fails the job.
    """
    records = read_records(spark, path).select("page_id", F.decode("header", "UTF-8").alias("header"), F.octet_length("payload").cast("long").alias("payload_bytes"), base32_sha1(F.col("payload")).alias("payload_digest"))
    named = field(F.col("header"), "WARC-Payload-Digest") == F.concat(F.lit("sha1:"), F.col("payload_digest"))
    return records.select(
        "page_id", "payload_bytes", F.when(named, F.col("payload_digest")).otherwise(F.raise_error(F.lit("a record names another digest"))).alias("payload_digest"),
        field(F.col("header"), "WARC-Type").alias("record_type"), F.regexp_extract(field(F.col("header"), "WARC-Refers-To"), "page:(-?[0-9]+)>", 1).try_cast("long").alias("refers_to"),
    )


def archive(pages: DataFrame, least: int = 0) -> DataFrame:
    """Write an archive in the shared folder and return its ``index``."""
    spark = pages.sparkSession
    return index(spark, write_archive(pages, scratch_path(spark, "warc"), least))
