"""Embedding of passages and queries by a pluggable model, and the all-or-nothing write of a revision's vectors."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docwarp.functions.text import vector_problem

#: What passages and queries begin with, and the result codes. Fixed values.
PREFIX = {"passage": "passage: ", "query": "query: "}
EMBEDDED, NO_CHUNKS, INVALID_VECTOR = "EMBEDDED", "NO_CHUNKS", "INVALID_VECTOR"
Model = Callable[[list[str]], np.ndarray]
_TOKEN = re.compile(r"[^\W_]+")
#: Letters that str.lower() makes two of, or lowers by their place in a word, and what they are letter by letter.
_SIMPLE = str.maketrans("\u0130\u03a3", "i\u03c3")


def hashing_model(dimension: int = 64) -> Model:
    """A model without weights: each token adds or subtracts one at a place, both by its MD5; vectors have length one."""

    def embed(texts: list[str]) -> np.ndarray:
        out = np.zeros((len(texts), dimension))
        for i, text in enumerate(texts):
            for token in _TOKEN.findall(text.translate(_SIMPLE).lower()):
                digest = hashlib.md5(token.encode(), usedforsecurity=False).digest()
                out[i, int.from_bytes(digest[:4], "big") % dimension] += 1 if digest[4] < 128 else -1
        norm = np.linalg.norm(out, axis=1, keepdims=True)
        return out / np.where(norm == 0, 1, norm)

    return embed


def embed(texts: DataFrame, kind: str, load: Callable[[], Model] = hashing_model, batch: int = 256) -> DataFrame:
    """id, embedding of (id, text), with the prefix of its ``kind``. ``load`` makes the model, once per task; null texts are empty."""
    prefix = PREFIX[kind]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = load()
        for rows in batches:
            for at in range(0, rows.num_rows, batch):
                part = rows.slice(at, batch)
                vectors = model([prefix + (t or "") for t in part.column(1).to_pylist()]).astype(np.float32)
                ends = np.arange(len(vectors) + 1, dtype=np.int32) * vectors.shape[1]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.ListArray.from_arrays(pa.array(ends), pa.array(vectors.ravel()))], ["id", "embedding"])

    return texts.select("id", "text").mapInArrow(run, "id long, embedding array<float>")


def embed_revisions(revisions: DataFrame, chunks: DataFrame, provider: str, model: str, dimension: int, version: str, now: Column) -> tuple[DataFrame, DataFrame]:
    """(revisions, chunks) once the vectors of chunks (id, revision_id, embedding) are stored for revisions (id, embedding_status, embedded_at).

    All vectors of a revision are stored or none: one that is missing or unsound fails it and leaves no vector. A revision without chunks
    fails. Only success stamps the provenance and the time.
    """
    judged = chunks.withColumn("_bad", vector_problem(F.col("embedding"), dimension).isNotNull())
    verdicts = judged.groupBy(F.col("revision_id").alias("id")).agg(F.bool_or("_bad").alias("_bad"))
    rows = revisions.join(verdicts, "id", "left")
    code = F.when(F.col("_bad").isNull(), NO_CHUNKS).when(F.col("_bad"), INVALID_VECTOR).otherwise(EMBEDDED)
    ok = code == EMBEDDED
    stamped = rows.select(
        "id", F.when(ok, "SUCCESS").otherwise("FAILED").alias("embedding_status"), code.alias("result_code"), F.when(ok, provider).alias("embedding_provider"), F.when(ok, model).alias("embedding_model"),
        F.when(ok, dimension).cast("long").alias("embedding_dimension"), F.when(ok, version).alias("embedding_version"), F.when(ok, now).otherwise(F.col("embedded_at")).alias("embedded_at"),
    )
    kept = chunks.join(verdicts.withColumnRenamed("id", "revision_id"), "revision_id")
    return stamped, kept.select("id", "revision_id", F.when(~F.col("_bad"), F.col("embedding")).alias("embedding"))
