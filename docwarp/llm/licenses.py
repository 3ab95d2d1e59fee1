"""License scans by diagonal voting, with DataFrame operations only.

All rolling word 2-gram hashes of all texts join the positions of the same hashes in license templates. A match votes for the
diagonal (text position minus template position); neighbouring diagonals with several votes merge and take single votes beside
them, so that a word added or left out does not break a match; each merged span is verified on the words themselves. Short base
phrases must match word for word on one diagonal.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from docwarp.llm.common import ascii_lower

WORDS = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"


@dataclass(frozen=True)
class Template:
    label: str
    words: str  # lower-case words separated by single spaces
    base: bool = False


#: Fixed phrases and labels.
BASE = (Template("mit", "mit license", True), Template("apache", "apache license", True), Template("gpl", "general public license", True))
#: Well-known notices, as their words.
NOTICES = (
    Template("mit-notice", "released under the mit license"),
    Template("apache-notice", "licensed under the apache license version 2 0"),
    Template("gpl-notice", "this work is licensed under the gnu general public license version 3"),
    Template("mit-text", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files"),
    Template("apache-text", "you may not use this file except in compliance with the license you may obtain a copy of the license at"),
    Template("gpl-text", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation"),
    Template("bsd-text", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
)
#: Templates beyond this many words are joined without a broadcast.
BROADCAST_WORDS = 200_000


def words_of(text: Column) -> Column:
    return F.regexp_extract_all(ascii_lower(F.coalesce(text, F.lit(""))), F.lit(WORDS), F.lit(0))


def _grams(words: Column) -> Column:
    """Hashes of neighbouring word pairs; ``words`` holds two at least."""
    return F.transform(F.sequence(F.lit(0), F.size(words) - 2), lambda i: F.xxhash64(F.get(words, i), F.get(words, i + 1)))


def template_table(spark: SparkSession, templates: tuple[Template, ...]) -> DataFrame:
    """tid, label, base, words, tpos, gram."""
    if any(len(t.words.split(" ")) < 2 for t in templates):
        raise ValueError("a template needs two words at least")
    rows = [(i, t.label, t.base, t.words.split(" ")) for i, t in enumerate(templates)]
    found = spark.createDataFrame(rows, "tid int, label string, base boolean, words array<string>")
    return found.select("tid", "label", "base", "words", F.posexplode(_grams(F.col("words"))).alias("tpos", "gram"))


def scan(docs: DataFrame, templates: tuple[Template, ...] = BASE + NOTICES, tolerance: int = 2, least: float = 0.8) -> DataFrame:
    """One row per row of ``docs``: ``doc_id, n_words, spans`` (array of label, base, start, length, score; in words from 0).

    ``tolerance``: diagonals at most so far apart merge. ``least``: a merged span counts if it shares this much of the words
    (shared distinct words by all distinct words of span and template). Null and empty texts have no words and no spans.
    Repeated rows give a row each; extra columns are ignored; very long texts are scanned whole.
    """
    spark = docs.sparkSession
    rows = docs.select("doc_id", "text", F.xxhash64("text").alias("_mark"))
    table = template_table(spark, templates)
    small = sum(len(t.words.split(" ")) for t in templates) <= BROADCAST_WORDS
    info = table.where("tpos = 0").select("tid", "label", "base", "words", F.size("words").alias("n_template"))
    grams = (
        rows.select("doc_id", "_mark", words_of(F.col("text")).alias("w")).where(F.size("w") >= 2)
        .select("doc_id", "_mark", F.posexplode(_grams(F.col("w"))).alias("pos", "gram"))
    )
    places = table.select("tid", "tpos", "gram")
    votes = grams.join(F.broadcast(places) if small else places, "gram")
    # sets, not counts: repeated rows vote once
    diagonals = votes.groupBy("doc_id", "_mark", "tid", (F.col("pos") - F.col("tpos")).alias("diagonal")).agg(
        F.collect_set("tpos").alias("seen"), F.min("pos").alias("first"), F.max("pos").alias("last")
    )
    diagonals = diagonals.join(F.broadcast(info.select("tid", "base", "n_template")) if small else info.select("tid", "base", "n_template"), "tid")
    exact = diagonals.where(F.col("base") & (F.size("seen") == F.col("n_template") - 1)).select("doc_id", "_mark", "tid", "first", "last")
    # islands of strong diagonals; a single vote joins the one that it is next to
    whole = Window.partitionBy("doc_id", "_mark", "tid").orderBy("diagonal")
    upto, onward = whole.rowsBetween(Window.unboundedPreceding, 0), whole.rowsBetween(0, Window.unboundedFollowing)
    strong = F.when(F.size("seen") >= 2, F.col("diagonal"))
    near = diagonals.where(~F.col("base")).withColumn("below", F.last(strong, ignorenulls=True).over(upto)).withColumn("above", F.first(strong, ignorenulls=True).over(onward))
    near = near.withColumn("core", F.when(F.col("diagonal") - F.col("below") <= tolerance, F.col("below")).when(F.col("above") - F.col("diagonal") <= tolerance, F.col("above"))).where("core IS NOT NULL")
    by = Window.partitionBy("doc_id", "_mark", "tid").orderBy("core", "diagonal")
    islands = near.withColumn("new", F.when(F.col("core") - F.lag("core").over(by) <= tolerance, 0).otherwise(1)).withColumn("island", F.sum("new").over(by))
    # an island of many diagonals is split, so that no span is longer than two templates
    begin = F.min("core").over(Window.partitionBy("doc_id", "_mark", "tid", "island"))
    parts = islands.withColumn("part", F.floor((F.col("core") - begin) / (F.floor(F.col("n_template") / 2) + 1)))
    merged = (
        parts.groupBy("doc_id", "_mark", "tid", "n_template", "island", "part")
        .agg(F.size(F.array_distinct(F.flatten(F.collect_list("seen")))).alias("votes"), F.min("first").alias("first"), F.max("last").alias("last"))
        .where(F.col("votes") >= 0.5 * (F.col("n_template") - 1))
        .select("doc_id", "_mark", "tid", "first", "last")
    )
    found = exact.unionByName(merged).join(F.broadcast(info) if small else info, "tid")
    lists = found.groupBy("doc_id", "_mark").agg(
        F.array_sort(F.collect_list(F.struct("first", "tid", "label", "base", "words", (F.col("last") - F.col("first") + 2).alias("n")))).alias("found")
    )
    key = lists.withColumnsRenamed({"doc_id": "_id", "_mark": "_of"})
    joined = rows.join(key, rows["doc_id"].eqNullSafe(key["_id"]) & (rows["_mark"] == key["_of"]), "left").select(
        "doc_id", words_of(F.col("text")).alias("w"), "found"
    )

    def verify(c: Column) -> Column:
        own = F.slice(F.col("w"), c["first"] + 1, c["n"])
        shared = F.size(F.array_intersect(own, c["words"])) / F.size(F.array_union(own, c["words"]))
        score = F.when(c["base"], F.when(own == c["words"], 1.0).otherwise(0.0)).otherwise(shared)
        return F.struct(c["label"].alias("label"), c["base"].alias("base"), c["first"].cast("long").alias("start"), c["n"].cast("long").alias("length"), score.alias("score"))

    spans = F.filter(F.transform(F.coalesce("found", F.array()), verify), lambda s: F.when(s["base"], s["score"] == 1.0).otherwise(s["score"] >= least))
    return joined.select("doc_id", F.size("w").cast("long").alias("n_words"), spans.alias("spans"))
