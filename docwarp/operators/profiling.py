"""Corpus profiling and retrieval evaluation as aggregations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from docwarp.operators.scratch import written
from docwarp.operators.sinks import global_rank

CODES = ("TEXT_EXTRACTED", "OCR_REQUIRED", "ENCRYPTED", "EMPTY_DOCUMENT", "PARSE_FAILED")
#: Size classes, half open, in bytes; sizes outside all of them are in the last. Fixed values.
BUCKETS = (("< 1 MB", 0, 1 << 20), ("1-5 MB", 1 << 20, 5 << 20), ("5-20 MB", 5 << 20, 20 << 20), ("20-50 MB", 20 << 20, 50 << 20), ("> 50 MB", 50 << 20, 1 << 62))
#: What is taken out of a failure's message, in this order, and what takes its place. Fixed values.
REASON_PATTERNS = ((r"""(/[^\s'"]+)+|([A-Za-z]:\\[^\s'"]+)""", " "), (r"""['"][^'"]*['"]""", " "), (r"[0-9]+", "N"), (r"\s+", " "))


def anonymous_ids(records: DataFrame) -> DataFrame:
    """id, anonymous_id: EXT-001 onwards within a format, by the path's hash. Ranked over all rows by range, so no format meets in one task."""
    hashed = records.select("id", "format", F.sha2("path", 256).alias("hash"))
    ranked = global_rank(hashed, [F.asc("format"), F.asc("hash"), F.asc("id")])
    ahead = ranked.groupBy("format").agg((F.min("rank") - 1).alias("ahead"))
    return ranked.join(ahead, "format").select("id", F.format_string("%s-%03d", F.upper("format"), F.col("rank") - F.col("ahead")).alias("anonymous_id"))


def failure_reason(message: Column, detail: Column) -> Column:
    """The detail, or else the message, without paths and quoted parts and with its numbers as N, at most 80 characters; UNKNOWN where nothing is left."""
    text = F.when(detail != "", detail).otherwise(F.coalesce(message, F.lit("")))
    for pattern, to in REASON_PATTERNS:
        text = F.regexp_replace(text, pattern, to)
    short = F.substring(F.btrim(text, F.lit(" .:;,-")), 1, 80)
    return F.when(short == "", "UNKNOWN").otherwise(short)


def size_bucket(size: Column) -> Column:
    out = F.lit(BUCKETS[-1][0])
    for name, low, high in BUCKETS[:-1]:
        out = F.when((size >= low) & (size < high), name).otherwise(out)
    return out


def code_of(code: Column) -> Column:
    return F.coalesce(code, F.lit("PARSE_FAILED"))


def result_matrix(records: DataFrame, formats: list[str]) -> DataFrame:
    """A row per result code (also unseen ones), a column per format, and the total."""
    dim = records.sparkSession.createDataFrame([(c,) for c in CODES], "code string")
    counts = records.select(code_of(F.col("result_code")).alias("code"), "format").groupBy("code").pivot("format", formats).count()
    rows = dim.join(counts, "code", "left").select("code", *[F.coalesce(F.col(f), F.lit(0)).alias(f) for f in formats])
    return rows.withColumn("total", sum((F.col(f) for f in formats), F.lit(0).cast("long")))


def format_summary(records: DataFrame) -> DataFrame:
    """Counts and success rate by format, and over all (null)."""
    ok = F.count_if(F.col("result_code") == "TEXT_EXTRACTED")
    return records.groupingSets([["format"], []], "format").agg(F.count("*").alias("n"), ok.alias("n_success"), F.round(ok / F.count("*"), 6).alias("rate"))


def _bin(v: Column, low: Column, high: Column, kind: str, bins: int) -> Column:
    """The bin of a value between low and high (low < high), never falling as values grow; low is in the first bin and high in the last."""
    if kind in ("double", "float"):
        width, half = high - low, lambda x: x / 2  # a width beyond all numbers is halved
        share = F.when(F.abs(width) < float("inf"), (v - low) / width).otherwise((half(v) - half(low)) / (half(high) - half(low)))
        odd = F.isnan(high) | (F.abs(high) == float("inf")) | (F.abs(low) == float("inf"))
    else:
        exact = lambda x: x.cast("decimal(20,0)") if kind in ("tinyint", "smallint", "int", "bigint") else x
        share, odd = (exact(v) - exact(low)).cast("double") / (exact(high) - exact(low)).cast("double"), F.lit(False)
    inner = F.when(odd, 1).otherwise(F.least(F.floor(share * bins), F.lit(bins - 1)).cast("int"))
    return F.when(v == high, bins - 1).when(v == low, 0).otherwise(inner)


def nearest_ranks(rows: DataFrame, by: list[str], value: str, percents: list[int], bins: int = 4096, few: int = 10_000) -> DataFrame:
    """by, percent, n, found, most: exact nearest-rank percentiles of a group's numbers that are not null, by narrowing histograms.

    The rank of p is round-half-even(p / 100 * n + 0.5), clamped. Each round counts the values between a goal's bounds in ``bins`` equal
    widths, with each bin's least and largest value, and goes on in the bin that holds the rank, until its values are equal or at most
    ``few``, which are then sorted. No step sorts or gathers a group, whatever its size. Null group keys are a group; empty input gives no row.
    """
    kept = written(rows.where(F.col(value).isNotNull()).select(*by, F.col(value).alias("_v")), "ranked")
    kind = kept.schema["_v"].dataType.simpleString()
    ends = kept.groupBy(*by).agg(F.count("*").alias("n"), F.min("_v").alias("low"), F.max("_v").alias("high"))
    at = F.bround(F.lit(1.0) * F.col("percent") / 100.0 * F.col("n") + 0.5).cast("long")
    goals = ends.select(*by, F.explode(F.array(*map(F.lit, percents))).alias("percent"), "n", F.col("high").alias("most"), "low", "high", F.col("n").alias("c"))
    goals = written(goals.withColumn("rank", F.least(F.greatest(at, F.lit(1)), F.col("n"))), "goals")
    names = [F.col(c).alias(f"_g{i}") for i, c in enumerate(by)]

    def values_of(some: DataFrame) -> DataFrame:
        """The rows between the bounds of goals; these are few, so that Spark sends them to the rows."""
        on = [F.col(c).eqNullSafe(F.col(f"_g{i}")) for i, c in enumerate(by)]
        return kept.join(some.select(*names, *[c for c in some.columns if c not in by]), [*on, F.col("_v").between(F.col("low"), F.col("high"))])

    wide = (F.col("low") != F.col("high")) & (F.col("c") > few)
    while not goals.where(wide).isEmpty():
        spread = values_of(goals.where(wide)).groupBy(*by, "percent", "n", "most", "rank", _bin(F.col("_v"), F.col("low"), F.col("high"), kind, bins).alias("bin"))
        counts = spread.agg(F.count("*").alias("c"), F.min("_v").alias("low"), F.max("_v").alias("high"))
        upto = F.sum("c").over(Window.partitionBy(*by, "percent").orderBy("bin"))  # over at most ``bins`` rows
        held = counts.withColumn("upto", upto).where((F.col("rank") <= F.col("upto")) & (F.col("rank") > F.col("upto") - F.col("c")))
        inside = held.withColumn("rank", F.col("rank") - F.col("upto") + F.col("c")).select(*goals.columns)
        goals = written(goals.where(~wide).unionByName(inside), "goals")
    equal = goals.where(F.col("low") == F.col("high")).withColumn("found", F.col("low"))
    last = values_of(goals.where(F.col("low") != F.col("high"))).groupBy(*by, "percent", "n", "most", "rank").agg(F.array_sort(F.collect_list("_v")).alias("v"))
    columns = [*by, "percent", "n", "found", "most"]
    return equal.select(*columns).unionByName(last.withColumn("found", F.get("v", (F.col("rank") - 1).cast("int"))).select(*columns))


def stats(rows: DataFrame, by: list[str], value: str) -> DataFrame:
    """n, p50, p95, most of ``value`` by group."""
    pick = lambda p: F.max(F.when(F.col("percent") == p, F.col("found"))).alias(f"p{p}")
    return nearest_ranks(rows, by, value, [50, 95]).groupBy(*by).agg(F.max("n").alias("n"), pick(50), pick(95), F.max("most").alias("most"))


def failure_buckets(records: DataFrame) -> DataFrame:
    rows = records.where(code_of(F.col("result_code")) != "TEXT_EXTRACTED")
    return rows.groupBy(code_of(F.col("result_code")).alias("code"), failure_reason(F.col("message"), F.col("detail")).alias("reason")).agg(F.count("*").alias("n"))


def determinism_sample(records: DataFrame, limit: int) -> DataFrame:
    """Per format the largest, slowest and fattest record, then others by id, ``limit`` in all, each once."""
    tops = []
    for order, c in enumerate(("size_bytes", "parse_time_ms", "peak_rss")):
        best = records.groupBy("format").agg(F.max_by("id", F.struct(F.col(c), (-F.col("id")).alias("k"))).alias("id"))
        tops.append(best.select("format", "id", F.lit(order).alias("turn")))
    fill = records.select("format", "id", F.lit(3).alias("turn"))
    rows = tops[0].unionByName(tops[1]).unionByName(tops[2]).unionByName(fill).groupBy("format", "id").agg(F.min("turn").alias("turn"))
    rank = F.row_number().over(Window.partitionBy("format").orderBy("turn", "id"))
    return rows.withColumn("rank", rank.cast("long")).where(F.col("rank") <= limit).select("format", "id", "rank")


def determinism_verdict(runs: DataFrame, fields: list[str]) -> DataFrame:
    """id, deterministic: one value per field over all runs; null counts as a value."""
    same = [F.count_distinct(F.coalesce(F.col(f), F.lit("\x00"))) == 1 for f in fields]
    verdict = same[0]
    for s in same[1:]:
        verdict = verdict & s
    return runs.groupBy("id").agg(verdict.alias("deterministic"))


def chunk_statistics(chunks: DataFrame, budget: int) -> DataFrame:
    t = F.col("token_count")
    return chunks.agg(
        F.count("*").alias("n"), F.round(F.avg(t), 6).alias("mean"), F.round(F.percentile(t, 0.5), 6).alias("p50"), F.round(F.percentile(t, 0.95), 6).alias("p95"), F.min(t).alias("least"), F.max(t).alias("most"), F.count_if(t < 16).alias("tiny"), F.count_if(t > budget).alias("oversize")
    )


def crowding(scored: DataFrame, k: int = 5) -> DataFrame:
    """request_id, distinct documents and the most chunks of one among each request's k best chunks."""
    rank = F.row_number().over(Window.partitionBy("request_id").orderBy(F.desc("score"), "document_id", "chunk_index"))
    tops = scored.withColumn("rank", rank).where(F.col("rank") <= k).groupBy("request_id", "document_id").agg(F.count("*").alias("c"))
    return tops.groupBy("request_id").agg(F.count("*").alias("documents"), F.max("c").alias("most"))


KEYS = ["method", "query_id"]


def recall_at(rankings: DataFrame, qrels: DataFrame, queries: DataFrame, k: int, on_empty: float | None = 0.0) -> DataFrame:
    """method, query_id, recall; ``on_empty`` for queries without relevant documents."""
    n = qrels.groupBy("query_id").agg(F.count("*").alias("n"))
    hits = rankings.where(F.col("rank") <= k).join(qrels, ["query_id", "document_id"]).groupBy(*KEYS).agg(F.count("*").alias("hits"))
    rows = all_queries(rankings, queries).join(n, "query_id", "left").join(hits, KEYS, "left")
    return rows.select(*KEYS, F.when(F.col("n").isNull(), F.lit(on_empty)).otherwise(F.round(F.coalesce("hits", F.lit(0)) / F.col("n"), 6)).alias("recall"))


def all_queries(rankings: DataFrame, queries: DataFrame) -> DataFrame:
    """Every query for every method (a few names)."""
    return queries.select("query_id").crossJoin(F.broadcast(rankings.select("method").distinct()))


def reciprocal_rank(rankings: DataFrame, qrels: DataFrame, queries: DataFrame, k: int | None = None) -> DataFrame:
    rows = rankings if k is None else rankings.where(F.col("rank") <= k)
    first = rows.join(qrels, ["query_id", "document_id"]).groupBy(*KEYS).agg(F.min("rank").alias("first"))
    return all_queries(rankings, queries).join(first, KEYS, "left").select(*KEYS, F.round(F.coalesce(1 / F.col("first"), F.lit(0.0)), 6).alias("rr"))


def primary_rank(rankings: DataFrame, primary: DataFrame, queries: DataFrame) -> DataFrame:
    """Rank of each query's primary document, and whether it is among the first 1 and 5."""
    own = rankings.join(primary.select("query_id", F.col("primary").alias("document_id")), ["query_id", "document_id"]).select(*KEYS, "rank")
    rows = all_queries(rankings, queries).join(own, KEYS, "left")
    hit = lambda k: F.coalesce((F.col("rank") <= k).cast("int"), F.lit(0))
    return rows.select(*KEYS, "rank", hit(1).alias("p1"), hit(5).alias("p5"))


def ndcg_at(rankings: DataFrame, gains: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """Graded nDCG; gains: query_id, document_id, gain."""
    discount = lambda r: F.log2(r + 1)
    dcg = rankings.where(F.col("rank") <= k).join(gains, ["query_id", "document_id"]).groupBy(*KEYS).agg(F.sum(F.col("gain") / discount(F.col("rank"))).alias("dcg"))
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("gain"), "document_id"))
    ideal = gains.withColumn("r", place).where(F.col("r") <= k).groupBy("query_id").agg(F.sum(F.col("gain") / discount(F.col("r"))).alias("idcg"))
    rows = all_queries(rankings, queries).join(ideal, "query_id", "left").join(dcg, KEYS, "left")
    return rows.select(*KEYS, F.round(F.when(F.col("idcg") > 0, F.coalesce("dcg", F.lit(0.0)) / F.col("idcg")).otherwise(0.0), 6).alias("ndcg"))


def hit_precision(rankings: DataFrame, qrels: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """hit and precision at k; precision always divides by k."""
    hits = rankings.where(F.col("rank") <= k).join(qrels, ["query_id", "document_id"]).groupBy(*KEYS).agg(F.count("*").alias("hits"))
    rows = all_queries(rankings, queries).join(hits, KEYS, "left").withColumn("hits", F.coalesce("hits", F.lit(0)))
    return rows.select(*KEYS, (F.col("hits") > 0).cast("int").alias("hit"), F.round(F.col("hits") / k, 6).alias("precision"))


def report(metrics: DataFrame, queries: DataFrame) -> DataFrame:
    """Means by method and category, over all categories and over all (nulls), of answerable queries."""
    rows = metrics.join(queries.select("query_id", "category", "answerable"), "query_id").where("answerable")
    return rows.rollup("method", "category").agg(F.count("*").alias("n"), F.round(F.avg("recall"), 4).alias("recall"), F.round(F.avg("rr"), 4).alias("mrr"))


def no_answer(rankings: DataFrame, qrels: DataFrame, queries: DataFrame) -> DataFrame:
    """By method: share of unanswerable queries with no result, results returned for them, and irrelevant results per query."""
    got = rankings.join(qrels.withColumn("rel", F.lit(1)), ["query_id", "document_id"], "left").groupBy(*KEYS).agg(F.count("*").alias("n"), F.count_if(F.col("rel").isNull()).alias("irrelevant"))
    rows = all_queries(rankings, queries).join(got, KEYS, "left").join(queries.select("query_id", "answerable"), "query_id")
    n = F.coalesce("n", F.lit(0))
    none = ~F.col("answerable")
    return rows.groupBy("method").agg(
        F.round(F.sum(F.when(none & (n == 0), 1).otherwise(0)) / F.greatest(F.count_if(none), F.lit(1)), 6).alias("zero_rate"), F.sum(F.when(none, n).otherwise(0)).alias("false_positives"), F.round(F.avg(F.coalesce("irrelevant", F.lit(0))), 6).alias("irrelevant")
    )


def label_violations(queries: DataFrame, qrels: DataFrame, docs: DataFrame) -> DataFrame:
    """query_id, rule: labels of unknown documents or queries, repeated labels, a primary that is not relevant."""
    unknown = qrels.join(docs.select(F.col("id").alias("document_id")), "document_id", "left_anti").select("query_id", F.lit("UNKNOWN_DOCUMENT").alias("rule"))
    stray = qrels.join(queries.select("query_id"), "query_id", "left_anti").select("query_id", F.lit("UNKNOWN_QUERY").alias("rule"))
    twice = qrels.groupBy("query_id", "document_id").agg(F.count("*").alias("n")).where("n > 1").select("query_id", F.lit("REPEATED").alias("rule"))
    primary = queries.where("primary IS NOT NULL").select("query_id", F.col("primary").alias("document_id")).join(qrels, ["query_id", "document_id"], "left_anti").select("query_id", F.lit("PRIMARY_NOT_RELEVANT").alias("rule"))
    return unknown.unionByName(stray).unionByName(twice).unionByName(primary)


def best_configuration(configs: DataFrame, keys: list[str]) -> DataFrame:
    """The name of the configuration that is first by ``keys``, each the larger the better."""
    return configs.agg(F.max_by("name", F.struct(*keys)).alias("name"))


def ranking_changes(before: DataFrame, after: DataFrame, k: int = 3) -> DataFrame:
    """query_id, changed, changed_first between the first k of two variants."""
    tops = lambda df, c: df.where(F.col("rank") <= k).groupBy("query_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "document_id"))), lambda x: x["document_id"]).alias(c))
    rows = tops(before, "a").join(tops(after, "b"), "query_id", "full_outer")
    return rows.select("query_id", (~F.col("a").eqNullSafe(F.col("b"))).alias("changed"), (~F.get("a", F.lit(0)).eqNullSafe(F.get("b", F.lit(0)))).alias("changed_first"))
