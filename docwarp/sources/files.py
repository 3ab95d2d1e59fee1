"""Files in and out: folder scans, JSON-lines datasets, rebuilt corpora, metric sinks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

QUERIES = "query_id string, query string, relevant_documents array<string>, primary_document string, category string, difficulty string"
DOCUMENTS = "document_id string, title string, department string, year long, document_type string, text string"


def load_documents(spark: SparkSession, path: str) -> DataFrame:
    """Evaluation documents from JSON lines; blank lines are left out, a malformed one fails."""
    return spark.read.schema(DOCUMENTS).option("mode", "FAILFAST").json(path)


def load_queries(spark: SparkSession, path: str) -> DataFrame:
    """Evaluation queries from JSON lines; a query without a difficulty is ``unknown``."""
    rows = spark.read.schema(QUERIES).option("mode", "FAILFAST").json(path)
    return rows.withColumn("difficulty", F.coalesce("difficulty", F.lit("unknown")))


def load_corpus(documents: DataFrame, chunks: DataFrame, embeddings: DataFrame, path: str) -> DataFrame:
    """Replace the corpus under ``path`` by these documents and their chunks, with vectors where there are any; returns the chunks as stored.

    ``chunks``: document_id, chunk_index, text; ``embeddings``: document_id, chunk_index, embedding.
    """
    spark = documents.sparkSession
    documents.write.mode("overwrite").parquet(f"{path}/documents")
    rows = chunks.join(documents.select("document_id"), "document_id", "left_semi").join(embeddings, ["document_id", "chunk_index"], "left")
    rows.write.mode("overwrite").parquet(f"{path}/chunks")
    return spark.read.schema(rows.schema).parquet(f"{path}/chunks")


def without_nan(rows: DataFrame) -> DataFrame:
    """NaN in any floating column becomes null, which JSON and CSV can hold."""
    floats = [f.name for f in rows.schema.fields if isinstance(f.dataType, T.DoubleType | T.FloatType)]
    return rows.withColumns({c: F.nanvl(F.col(c), F.lit(None).cast(rows.schema[c].dataType)) for c in floats}) if floats else rows


def write_json_lines(rows: DataFrame, path: str) -> None:
    """A JSON object per row, with nulls."""
    without_nan(rows).write.option("ignoreNullFields", "false").mode("overwrite").json(path)


def category_table(metrics: DataFrame, methods: list[str], names: list[str]) -> DataFrame:
    """category, metric and a column per method, from rows (method, category, one column per metric of ``names``)."""
    long = without_nan(metrics).unpivot(["method", "category"], names, "metric", "value")
    return long.groupBy("category", "metric").pivot("method", methods).agg(F.first("value"))


def write_csv(rows: DataFrame, path: str) -> None:
    """CSV with a header; null is an empty field."""
    rows.write.option("header", True).mode("overwrite").csv(path)
