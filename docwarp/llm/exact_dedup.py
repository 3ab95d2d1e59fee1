"""Exact deduplication without a hot task, by DataFrame operations only.

Texts are equal when they are identical after deleting every character of ``[\\x20\\x09-\\x0D]``. Three stages compare the full
normalised content, never the digest alone: Spark's map-side combine merges equal texts of a task; digest groups split by a
salt of the id merge what tasks leave; the salt winners of a group combine globally. A group thus costs a task one row per
salt and upstream task, whatever its size. Its members learn the outcome by salt, too, from one row for each salt that they have.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SPACES = "\x20\x09\x0a\x0b\x0c\x0d"


def normalised(text: Column) -> Column:
    return reduce(lambda t, c: F.replace(t, F.lit(c), F.lit("")), SPACES, F.coalesce(text, F.lit("")))


def _keyed(docs: DataFrame, salts: int) -> DataFrame:
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).withColumn("content", normalised(F.col("text")))
    return rows.select(
        "doc_id", "content", F.char_length("text").alias("chars"), F.sha2("content", 256).alias("digest"), F.xxhash64("content").alias("mark"), F.xxhash64("text").alias("own"),
        F.pmod(F.xxhash64("doc_id"), F.lit(salts)).cast("int").alias("salt"),
    )


def groups(docs: DataFrame, salts: int = 128) -> DataFrame:
    """One row per distinct text: ``digest, mark`` (a second hash), ``keep_id, keep_own`` (hash of the original text), ``group_size, salts``
    (those of its members, at most ``salts`` ones).

    Of equal texts the row with the most code points in the original text, then the smallest doc_id, then the largest hash of
    the original text stays; a null doc_id comes after all others. Should two different texts ever share both hashes, the job fails rather than mix them.
    """
    best = F.struct("chars", F.bitwise_not("doc_id").alias("order"), "own")  # ~id falls as id grows, without overflow
    merged = _keyed(docs, salts).groupBy("digest", "mark", "content", "salt").agg(F.max(best).alias("best"), F.count("*").alias("n"))
    whole = merged.groupBy("digest", "mark", "content").agg(F.max("best").alias("best"), F.sum("n").alias("n"), F.collect_list("salt").alias("salts"))
    once = whole.groupBy("digest", "mark").agg(F.first("best").alias("best"), F.first("n").alias("n"), F.count("*").alias("texts"), F.first("salts").alias("salts"))
    return once.select(
        "digest", "mark", F.bitwise_not("best.order").alias("keep_id"), F.col("best.own").alias("keep_own"),
        F.when(F.col("texts") == 1, F.col("n")).otherwise(F.raise_error(F.lit("two texts share their digests"))).alias("group_size"), "salts",
    )


def decide(docs: DataFrame, salts: int = 128) -> DataFrame:
    """One row per row of ``docs``: ``doc_id, keep_id, group_size, kept, text_sha256``.

    Null and empty texts and texts of white space alone are equal to each other. Rows that share a doc_id are one document:
    all copies of the row that stays are ``kept``. Extra columns are ignored; an empty table gives no rows.
    """
    members = _keyed(docs, salts).select("doc_id", "digest", "mark", "salt")
    outcome = groups(docs, salts).withColumn("salt", F.explode("salts"))
    return members.join(outcome, ["digest", "mark", "salt"]).select(
        "doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), F.col("digest").alias("text_sha256")
    )


def dedup(docs: DataFrame, salts: int = 128) -> DataFrame:
    """``docs`` with one document of each group, all columns kept, extra ones too.

    Rows with equal doc_id and original text are one document and stay together. A null doc_id comes after all others: such a row
    stays only where no equal text has an id, and one row of them stays.
    """
    kept = groups(docs, salts).select("keep_id", "keep_own")
    rows = docs.select(F.struct("*").alias("row"), F.col("doc_id").alias("id"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("own"))
    left = rows.join(kept, F.col("id").eqNullSafe(F.col("keep_id")) & (F.col("own") == F.col("keep_own")), "left_semi")
    if not docs.where("doc_id IS NULL").isEmpty():
        left = left.where("id IS NOT NULL").unionByName(left.where("id IS NULL").dropDuplicates(["own"]))
    return left.select("row.*")
