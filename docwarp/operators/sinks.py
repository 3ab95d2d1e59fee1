"""Sinks and source-side helpers: manifests, fingerprints, replaced chunks, audit rows, global ranks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from docwarp.operators.scratch import written


def global_rank(rows: DataFrame, order: list[Column]) -> DataFrame:
    """rank over all rows. They are sorted by range and written once; only a count per partition meets in one place."""
    parts = written(rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_part", F.spark_partition_id()), "ranked")
    counts = parts.groupBy("_part").agg(F.count("*").alias("n"))
    ahead = counts.select("_part", (F.sum("n").over(Window.orderBy("_part")) - F.col("n")).alias("_before"))
    inside = F.row_number().over(Window.partitionBy("_part").orderBy(*order))
    ranked = parts.join(F.broadcast(ahead), "_part")  # one row per partition of the sort
    return ranked.withColumn("rank", (F.col("_before") + inside).cast("long")).drop("_part", "_before")


EXTENSIONS = ("hwp", "hwpx", "docx", "pdf")


def scan_folder(spark: SparkSession, root: str, extensions: tuple[str, ...] = EXTENSIONS) -> DataFrame:
    """path, length, modificationTime of a folder's files; their content is never read. Spark lists no empty files, in which there is nothing to parse."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root).select("path", "length", "modificationTime")
    return files.where(F.lower(F.substring_index("path", ".", -1)).isin(*extensions))


def manifest(files: DataFrame, root: str) -> DataFrame:
    """relative path, title and extension of files under ``root``; others are dropped."""
    prefix = root.rstrip("/") + "/"
    rows = files.where(F.startswith("path", F.lit(prefix))).withColumn("source_path", F.substring("path", len(prefix) + 1, 2147483647))
    name = F.substring_index("source_path", "/", -1)
    return rows.select("source_path", F.regexp_replace(name, r"\.[^.]*$", "").alias("title"), F.lower(F.regexp_extract(name, r"\.([^.]*)$", 1)).alias("extension"))


def fingerprint(content: Column, length: Column) -> Column:
    """sha256 and whether the bytes still have the listed length."""
    return F.struct(F.sha2(content, 256).alias("content_hash"), (F.octet_length(content) == length).alias("stable"))


def container(content: Column) -> Column:
    head = F.hex(F.substring(content, 1, 8))
    return F.when(F.octet_length(content) == 0, "EMPTY").when(head == "D0CF11E0A1B11AE1", "OLE").when(F.startswith(head, F.lit("504B0304")), "ZIP").otherwise("UNKNOWN")


def replace_chunks(old: DataFrame, new: DataFrame) -> DataFrame:
    """All chunks once the revisions in ``new`` have theirs replaced; nothing of a longer old list stays."""
    return old.join(new.select("revision_id").distinct(), "revision_id", "left_anti").unionByName(new)


#: Keys that must never be written down. Fixed values.
FORBIDDEN = ("password", "password_hash", "new_password", "current_password", "token", "token_hash", "session_token", "reset_token", "secret")


def scrub(metadata: Column) -> Column:
    """struct(kept, _redacted): the map without forbidden keys, and the sorted forbidden keys that it had (null: none)."""
    gone = F.array_sort(F.filter(F.map_keys(metadata), lambda k: k.isin(*FORBIDDEN)))
    kept = F.map_filter(metadata, lambda k, v: ~k.isin(*FORBIDDEN))
    return F.struct(kept.alias("kept"), F.when(F.size(gone) > 0, gone).alias("_redacted"))
