"""Queries: folder scans, JSON-lines datasets, corpus loads and metric sinks, each read back from what was written."""

from __future__ import annotations

from pyspark.sql import functions as F

from docwarp.operators import sinks as sk
from docwarp.operators.scratch import scratch_path
from docwarp.plans.registry import query
from docwarp.sources import files as fl
from docwarp.sources.fixtures import Tables, oracle


@query("S1_scan_folder")
def s1(spark, sf):
    """The folder of the tables themselves."""
    rows = sk.scan_folder(spark, sf, ("parquet",))
    return rows.select(F.substring_index("path", "/", -1).alias("filename"), F.col("length").alias("size"), F.lower(F.substring_index("path", ".", -1)).alias("extension"))


_LABELLED = "SELECT CAST(query_id AS VARCHAR) AS query_id, text AS query, (SELECT list(CAST(document_id AS VARCHAR) ORDER BY document_id) FROM qrels q WHERE q.query_id = evals.query_id) AS rel, category FROM evals"


@query("S5_load_queries", oracle("SELECT query_id, query, CAST(coalesce(len(rel), 0) AS BIGINT) AS n_relevant, rel[1] AS primary_document, 'c' || category AS category, CASE WHEN category = 1 THEN 'hard' ELSE 'unknown' END AS difficulty FROM labelled_", labelled_=_LABELLED))
def s5(spark, sf):
    t = Tables(spark, sf)
    rel = t.qrels.groupBy("query_id").agg(F.array_sort(F.collect_list("document_id")).alias("rel"))
    ids = F.transform(F.coalesce("rel", F.array().cast("array<bigint>")), lambda d: d.cast("string"))
    rows = t.evals.join(rel, "query_id", "left").select(
        F.col("query_id").cast("string").alias("query_id"), F.col("text").alias("query"), ids.alias("relevant_documents"), F.get(ids, F.lit(0)).alias("primary_document"), F.concat(F.lit("c"), F.col("category").cast("string")).alias("category"), F.when(F.col("category") == 1, "hard").alias("difficulty")
    )
    path = scratch_path(spark, "queries")
    rows.write.json(path)
    return fl.load_queries(spark, path).select("query_id", "query", F.size("relevant_documents").cast("long").alias("n_relevant"), "primary_document", "category", "difficulty")


@query("S5_load_documents", oracle("SELECT CAST(d AS VARCHAR) AS document_id, title, source AS department, 2010 + d % 15 AS year, file_type AS document_type, sha256(text) AS digest FROM base"))
def s5b(spark, sf):
    d, path = F.col("d"), scratch_path(spark, "documents")
    Tables(spark, sf).base.select(d.cast("string").alias("document_id"), "title", F.col("source").alias("department"), (d % 15 + 2010).alias("year"), F.col("file_type").alias("document_type"), "text").write.json(path)
    return fl.load_documents(spark, path).select("document_id", "title", "department", "year", "document_type", F.sha2("text", 256).alias("digest"))


@query("S6_load_corpus", oracle("SELECT c.document_id, chunk_index, sha256(text) AS digest, vec_id IS NOT NULL AS embedded FROM chunks c JOIN docs d ON d.current_revision_id = c.revision_id WHERE NOT d.is_deleted"))
def s6(spark, sf):
    t = Tables(spark, sf)
    docs = t.docs.where("NOT is_deleted").select(F.col("id").alias("document_id"), "title", "current_revision_id")
    chunks = t.chunks.join(docs.select(F.col("current_revision_id").alias("revision_id")), "revision_id", "left_semi")
    vectors = chunks.join(t.vectors, "vec_id").select("document_id", "chunk_index", "embedding")
    stored = fl.load_corpus(docs.drop("current_revision_id"), chunks.select("document_id", "chunk_index", "text"), vectors, scratch_path(spark, "corpus"))
    return stored.select("document_id", "chunk_index", F.sha2("text", 256).alias("digest"), F.col("embedding").isNotNull().alias("embedded"))


_BY = "SELECT format AS method, 'c' || (id % 3) AS category, count(*) AS queries, CASE WHEN id % 3 = 2 THEN CAST('NaN' AS DOUBLE) ELSE round(avg(size_bytes), 4) END AS recall FROM records GROUP BY format, id % 3"


def by_category(t: Tables):
    rows = t.records.groupBy(F.col("format").alias("method"), (F.col("id") % 3).alias("k")).agg(F.count("*").cast("double").alias("queries"), F.round(F.avg("size_bytes"), 4).alias("recall"))
    return rows.select("method", F.concat(F.lit("c"), F.col("k").cast("string")).alias("category"), "queries", F.when(F.col("k") == 2, float("nan")).otherwise(F.col("recall")).alias("recall"))


@query("S7_json_lines", oracle("SELECT method, category, CAST(queries AS DOUBLE) AS queries, CASE WHEN isnan(recall) THEN NULL ELSE recall END AS recall FROM by_", by_=_BY))
def s7(spark, sf):
    path, rows = scratch_path(spark, "lines"), by_category(Tables(spark, sf))
    fl.write_json_lines(rows, path)
    return spark.read.schema(rows.schema).json(path)


_LANGS = ["de", "en", "es", "fr"]


@query("S7_category_csv", oracle("SELECT category, metric, " + ", ".join(f"max(CASE WHEN method = '{m}' THEN CASE WHEN isnan(value) THEN NULL ELSE value END END) AS {m}" for m in _LANGS) + " FROM (SELECT method, category, 'queries' AS metric, CAST(queries AS DOUBLE) AS value FROM by_ UNION ALL SELECT method, category, 'recall', recall FROM by_) GROUP BY 1, 2", by_=_BY))
def s7b(spark, sf):
    path = scratch_path(spark, "csv")
    rows = fl.category_table(by_category(Tables(spark, sf)), _LANGS, ["queries", "recall"])
    fl.write_csv(rows, path)
    return spark.read.schema(rows.schema).option("header", True).csv(path)
