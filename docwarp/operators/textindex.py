"""Full text from an inverted index that is a table.

``build`` writes one row per token and document: the token's bucket (a partition of the table), the document, where the token stands as steps
from one place to the next, and, apart, in how many documents each token is. Searches read the buckets of their tokens only, begin
with the documents of the rarest token and then fetch the others' places there.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docwarp.functions import similarity as sim
from docwarp.operators.eligibility import small
from docwarp.operators.scratch import scratch_path

BUCKETS = 64
KEYS = ["request_id", "document_id"]


def needed_tokens(known: DataFrame, rare: DataFrame) -> DataFrame:
    """token, bucket of the requests whose tokens are all there."""
    return known.join(rare.select("request_id"), "request_id", "left_semi").select("token", "bucket").distinct()


def bucket(token: Column) -> Column:
    return F.pmod(F.xxhash64(token), F.lit(BUCKETS)).cast("int")


def spread(rows: DataFrame) -> DataFrame:
    """Deal rows of a few large files to all cores."""
    n = rows.sparkSession.sparkContext.defaultParallelism
    return rows if rows.rdd.getNumPartitions() >= n else rows.repartition(n)


def postings(texts: DataFrame) -> DataFrame:
    """token, document_id, steps (places of the token, each as the distance from the one before) of (document_id, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                lists = pc.fill_null(part.column(1), [])
                sizes = pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64)
                found = lists.flatten().dictionary_encode()
                code = found.indices.to_numpy().astype(np.int64)
                row = np.repeat(np.arange(len(sizes)), sizes)
                place = np.arange(len(row)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
                key = row * max(len(found.dictionary), 1) + code
                order = np.argsort(key, kind="stable")
                key, place = key[order], place[order]
                first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, np.int64)
                steps = np.diff(place, prepend=0)
                steps[first] = place[first]
                runs = pa.ListArray.from_arrays(pa.array(np.append(first, len(key)), pa.int32()), pa.array(steps, pa.int32()))
                tokens = found.dictionary.take(pa.array(key[first] % max(len(found.dictionary), 1)))
                documents = part.column(0).take(pa.array(row[order][first]))
                yield pa.RecordBatch.from_arrays([tokens, documents, runs], ["token", "document_id", "steps"])

    rows = spread(texts.select("document_id", "text")).select("document_id", sim.words(F.col("text")).alias("words"))
    return rows.mapInArrow(run, f"token string, document_id {dict(texts.dtypes)['document_id']}, steps array<int>")


def tokens_of(asks: DataFrame) -> DataFrame:
    """request_id, n (distinct tokens of the query), token."""
    q = asks.select("request_id", F.array_distinct(sim.words(F.col("query"))).alias("q"))
    return q.select("request_id", F.size("q").alias("n"), F.explode("q").alias("token"))


@dataclass
class TextIndex:
    """The postings by bucket and the tokens' document counts, both written."""

    places: DataFrame
    counts: DataFrame

    @staticmethod
    def _written(rows: DataFrame) -> TextIndex:
        spark = rows.sparkSession
        at = scratch_path(spark, "index")
        rows = rows.withColumn("bucket", bucket(F.col("token")))
        rows.repartition("bucket").write.partitionBy("bucket").parquet(f"{at}/places")
        places = spark.read.schema(rows.schema).parquet(f"{at}/places")
        counts = places.groupBy("token", "bucket").agg(F.count("*").alias("documents"))
        counts.repartition("bucket").write.partitionBy("bucket").parquet(f"{at}/counts")
        return TextIndex(places, spark.read.schema(counts.schema).parquet(f"{at}/counts"))

    @staticmethod
    def build(texts: DataFrame) -> TextIndex:
        """Index (document_id, text). Null and empty texts have no tokens; rows with one id are one document with the places of all of them."""
        return TextIndex._written(postings(texts))

    def renew(self, texts: DataFrame) -> TextIndex:
        """The index with the given documents (document_id, text) as they are now, all others as they were; a null text takes one out."""
        kept = self.places.join(texts.select("document_id"), "document_id", "left_anti").select("token", "document_id", "steps")
        return TextIndex._written(kept.unionByName(postings(texts)))

    def search(self, asks: DataFrame, every: bool) -> DataFrame:
        """request_id, document_id, score of documents with all (``every``) or any tokens of a query, by cover density.

        A minimal cover is a shortest stretch with each query token that the document has; it is worth 0.1 / (1 + other words in it).
        """
        asked = tokens_of(asks).withColumn("bucket", bucket(F.col("token")))
        read = [r["bucket"] for r in asked.select("bucket").distinct().collect()]  # at most BUCKETS numbers
        places = self.places.where(F.col("bucket").isin(read) if read else F.lit(False))
        if every:
            counts = self.counts.where(F.col("bucket").isin(read) if read else F.lit(False))
            known = small(asked).join(counts, ["token", "bucket"])
            rare = known.groupBy("request_id", "n").agg(F.min_by("token", F.struct("documents", "token")).alias("token"), F.count("*").alias("has"))
            rare = rare.where("has = n").select("request_id", "token", bucket(F.col("token")).alias("bucket"))
            first = places.select("token", "bucket", "document_id").join(small(rare), ["token", "bucket"]).select(*KEYS).distinct()
            # places travel once for each token and document, not once more for each request that asks for the token; what they meet are
            # the few documents of each request's rarest token
            needed = first.join(small(asked), "request_id")
            own = places.join(small(needed_tokens(known, rare)), ["token", "bucket"], "left_semi")
            hits = needed.drop("bucket").join(own.drop("bucket"), ["token", "document_id"])
        else:
            hits = places.join(small(asked), ["token", "bucket"])
        return _density(hits.select(*KEYS, "n", "token", "steps"), every)


def _density(hits: DataFrame, every: bool) -> DataFrame:
    """request_id, document_id, score of (request_id, document_id, n, token, steps). Rows of a request and document follow each other in a task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _whole_groups(batches):
            key = [rows.column(i).to_numpy(zero_copy_only=False) for i in (0, 1)]
            row_of = np.cumsum(np.concatenate([[False], (key[0][1:] != key[0][:-1]) | (key[1][1:] != key[1][:-1])]))
            firsts = np.flatnonzero(np.diff(row_of, prepend=-1))
            n_rows = len(firsts)
            # number the tokens of a row: a token that comes twice (rows of one document) counts once
            name = rows.column(3).dictionary_encode().indices.to_numpy().astype(np.int64)
            distinct, which = np.unique(row_of * (int(name.max(initial=0)) + 1) + name, return_inverse=True)
            owner = distinct // (int(name.max(initial=0)) + 1)
            have = np.bincount(owner, minlength=n_rows)
            number = (np.arange(len(distinct)) - np.repeat(np.cumsum(have) - have, have))[which]
            steps = rows.column(4)
            n = pc.list_value_length(steps).to_numpy(zero_copy_only=False).astype(np.int64)
            place = np.cumsum(steps.flatten().to_numpy(zero_copy_only=False).astype(np.int64))
            begin = np.cumsum(n) - n
            place = place - np.repeat(np.where(begin > 0, place[begin - 1], 0), n)
            row, token = np.repeat(row_of, n), np.repeat(number, n)
            order = np.lexsort((place, row))
            row, place, token = row[order], place[order], token[order]
            least = np.full(len(row), np.iinfo(np.int64).max)
            there = np.ones(len(row), bool)
            wide = int(place.max(initial=0)) + 2
            for k in range(int(have.max(initial=0))):  # the last place of the row's k-th token so far
                last = np.maximum.accumulate(np.where(token == k, row * wide + place + 1, 0)) - row * wide - 1
                needed = k < have[row]
                there &= ~needed | (last >= 0)
                least = np.where(needed, np.minimum(least, last), least)
            row, place, least = row[there], place[there], least[there]
            cover = np.flatnonzero(np.concatenate([[True], (row[1:] != row[:-1]) | (least[1:] != least[:-1])])) if len(row) else np.zeros(0, np.int64)
            row, place, least = row[cover], place[cover], least[cover]  # the first end of each beginning
            worth = 0.1 / (1 + place - least + 1 - have[row])
            score = np.bincount(row, weights=worth, minlength=n_rows)
            told = have == rows.column(2).to_numpy(zero_copy_only=False)[firsts] if every else np.ones(n_rows, bool)
            kept = pa.array(firsts[told])
            yield pa.RecordBatch.from_arrays([rows.column(0).take(kept), rows.column(1).take(kept), pa.array(score[told])], [*KEYS, "score"])

    kinds = dict(hits.dtypes)
    dealt = hits.repartition("document_id").sortWithinPartitions(*KEYS)
    scored = dealt.mapInArrow(run, f"request_id {kinds['request_id']}, document_id {kinds['document_id']}, score double")
    return scored.withColumn("score", F.round("score", 6))


def _whole_groups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rows of some batches, cut between groups of equal first two columns only."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        a, b = (batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 1))
        cut = int(np.flatnonzero((a != a[-1]) | (b != b[-1]))[-1]) + 1 if ((a != a[-1]) | (b != b[-1])).any() else 0
        if cut or not held:
            held.append(batch.slice(0, cut))
            whole = [x for x in held if x.num_rows]
            if cut and whole:
                yield pa.Table.from_batches(whole).combine_chunks().to_batches()[0]
            held = [batch.slice(cut)] if cut else [*held, batch]
        else:
            last = held[-1]
            same = last.num_rows and last.column(0)[-1].as_py() == a[0].item() and last.column(1)[-1].as_py() == b[0].item()
            if not same:
                yield from pa.Table.from_batches([x for x in held if x.num_rows]).combine_chunks().to_batches()[:1]
                held = []
            held.append(batch)
    held = [x for x in held if x.num_rows]
    if held:
        yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]
