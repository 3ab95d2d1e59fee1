"""Alternative retrieval methods: full text, trigram, vector, rank fusion and boosted scores. Inputs and results carry request_id."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from docwarp.functions import similarity as sim
from docwarp.operators.ranking import body_hits, similar_texts, small, title_hits
from docwarp.operators.sinks import global_rank
from docwarp.operators.textindex import TextIndex

RRF_K = 60
KEYS = ["request_id", "document_id"]


def top(rows: DataFrame, k: int, score: str = "score") -> DataFrame:
    """The k best of each request with rank; ties go to the smaller id."""
    rank = F.row_number().over(Window.partitionBy("request_id").orderBy(F.desc(score), "document_id"))
    return rows.withColumn("rank", rank.cast("long")).where(F.col("rank") <= k)


def full_rank(rows: DataFrame, score: str = "score") -> DataFrame:
    """Every row with its rank within its request. All requests are ranked together by range, so none meets in one task."""
    ranked = global_rank(rows, [F.asc("request_id"), F.desc(score), F.asc("document_id")])
    ahead = ranked.groupBy("request_id").agg((F.min("rank") - 1).alias("ahead"))
    return ranked.join(ahead, "request_id").withColumn("rank", F.col("rank") - F.col("ahead")).drop("ahead")


def full_text(texts: DataFrame | TextIndex, asks: DataFrame, every: bool) -> DataFrame:
    """request_id, document_id, score of documents with all (``every``) or any query tokens, by cover density. (document_id, text) are
    indexed first; an index that is there already is searched."""
    return (texts if isinstance(texts, TextIndex) else TextIndex.build(texts)).search(asks, every)


def trigram_search(texts: DataFrame, asks: DataFrame, least: float = 0.20) -> DataFrame:
    """greatest(title, content similarity) of (document_id, title, text), where it reaches ``least``."""
    fields = texts.select(F.col("document_id").alias("key"), "title", "text")
    near = lambda c: similar_texts(fields.select("key", F.col(c).alias("text")), asks.select("request_id", "query"), least)
    both = near("title").unionByName(near("text"))
    return both.groupBy("request_id", F.col("key").alias("document_id")).agg(F.max("score").alias("score"))


def vector_max(scored: DataFrame) -> DataFrame:
    return scored.groupBy(*KEYS).agg(F.round(F.max("score"), 6).alias("score"))


def rrf(rankings: list[DataFrame], k: int = RRF_K) -> DataFrame:
    """Reciprocal rank fusion of rankings with rank from 1."""
    rows = rankings[0].select(*KEYS, "rank")
    for r in rankings[1:]:
        rows = rows.unionByName(r.select(*KEYS, "rank"))
    return rows.groupBy(*KEYS).agg(F.round(F.sum(1.0 / (k + F.col("rank"))), 6).alias("score"))


def hybrid(scores: list[DataFrame], candidates: int, top_k: int) -> DataFrame:
    """Fuse the first max(candidates, top_k) of every method."""
    depth = max(candidates, top_k)
    return top(rrf([top(s, depth) for s in scores]), top_k)


def gated(semantic: DataFrame, lexical: DataFrame) -> DataFrame:
    """The semantic scores of lexical hits; without any hit nothing."""
    return semantic.join(lexical.select(*KEYS), KEYS, "left_semi")


def union_rrf(semantic: DataFrame, lexical: DataFrame, gate: bool) -> DataFrame:
    """Fusion of both full rankings; with ``gate`` only for requests with a lexical hit."""
    fused = rrf([full_rank(semantic), full_rank(lexical)])
    return fused.join(lexical.select("request_id").distinct(), "request_id", "left_semi") if gate else fused


def chunk_lexical(found: DataFrame, chunks: DataFrame, asks: DataFrame, least: float = 0.6) -> DataFrame:
    """body_lexical: the best word similarity of any chunk of each document that reaches ``least``; candidates come from shared trigrams."""
    docs = found.select("request_id", F.col("id").alias("document_id"), "current_revision_id")
    own = chunks.select(F.col("id").alias("key"), F.col("revision_id").alias("current_revision_id"), "text").join(docs.select("current_revision_id").distinct(), "current_revision_id", "left_semi")
    near = similar_texts(own.select("key", "text"), asks.select("request_id", "query"), least).join(own.select("key", "current_revision_id"), "key")
    return near.join(docs, ["request_id", "current_revision_id"]).groupBy(*KEYS).agg(F.max("score").alias("body_lexical"))


def components(found: DataFrame, chunks: DataFrame, best: DataFrame, asks: DataFrame, texts: DataFrame | None = None) -> DataFrame:
    """One row per request and document: semantic, title_trigram, body_lexical, body_contains, title_contains. Sweeps share it."""
    rows = found.select("request_id", F.col("id").alias("document_id"), "title").join(small(asks.select("request_id", "title_query")), "request_id")
    holds = body_hits(found, asks, sim.fold_separators, texts).withColumn("holds", F.lit(True))
    rows = rows.join(title_hits(found, asks, "title_query", texts), KEYS, "left").join(holds, KEYS, "left").select(
        *KEYS, F.round(F.coalesce("title_score", F.lit(0.0)), 6).alias("title_trigram"), F.col("holds").isNotNull().alias("body_contains"), F.contains(F.col("title"), F.col("title_query")).alias("title_contains")
    )
    rows = rows.join(best.select(*KEYS, F.round("score", 6).alias("semantic")), KEYS).join(chunk_lexical(found, chunks, asks), KEYS, "left")
    return rows.withColumn("body_lexical", F.coalesce("body_lexical", F.lit(0.0)))


def exact_title(parts: DataFrame) -> DataFrame:
    return parts.select(*KEYS, (F.col("semantic") + F.when(F.col("title_contains"), 1.0).otherwise(0.0)).alias("score"))


def title_proportional(parts: DataFrame) -> DataFrame:
    return parts.select(*KEYS, (F.col("semantic") + 1.0 * F.col("title_trigram")).alias("score"))


def field_aware(parts: DataFrame) -> DataFrame:
    return parts.select(*KEYS, (F.col("semantic") + F.col("title_trigram") + 0.3 * F.col("body_lexical") + F.when(F.col("title_contains"), 1.0).otherwise(0.0)).alias("score"))


def strong_body(parts: DataFrame, boost: Column, threshold: Column) -> DataFrame:
    return parts.withColumn("score", F.col("semantic") + F.when(F.col("body_lexical") >= threshold, boost).otherwise(0.0))


def exact_body(parts: DataFrame, boost: Column) -> DataFrame:
    return parts.withColumn("score", F.col("semantic") + F.when(F.col("body_contains"), boost).otherwise(0.0))


def selective(parts: DataFrame, fires: Column, boost: Column, ceiling: Column, by: list[str] | None = None) -> DataFrame:
    """The boost counts only where 0 < n <= max(1, floor(total * ceiling)) of a request's documents have it."""
    keys = ["request_id", *(by or [])]
    counts = parts.groupBy(*keys).agg(F.count_if(fires).alias("n"), F.count("*").alias("total"))
    told = (F.col("n") > 0) & (F.col("n") <= F.greatest(F.lit(1), F.floor(F.col("total") * ceiling)))
    rows = parts.join(counts, keys)
    return rows.withColumn("score", F.col("semantic") + F.when(told & fires, boost).otherwise(0.0)).drop("n", "total")


def two_lists(parts: DataFrame) -> DataFrame:
    """Fusion of a semantic and a body ranking over the same documents, ranks from 0."""
    first = full_rank(parts.select(*KEYS, "semantic"), "semantic").select(*KEYS, F.col("rank").alias("a"))
    second = full_rank(parts.select(*KEYS, "body_lexical"), "body_lexical").select(*KEYS, F.col("rank").alias("b"))
    return first.join(second, KEYS).select(*KEYS, F.round(1.0 / (RRF_K + F.col("a")) + 1.0 / (RRF_K + F.col("b")), 6).alias("score"))
