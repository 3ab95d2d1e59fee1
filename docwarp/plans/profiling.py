"""Queries: corpus profiling and retrieval evaluation."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from docwarp.operators import profiling as pf
from docwarp.operators import ranking as rk
from docwarp.operators import retrieval as rt
from docwarp.operators.scratch import written
from docwarp.plans.ranking import FTS, Asked, orc, texts_of, top_sql
from docwarp.plans.registry import query
from docwarp.sources.fixtures import Tables, oracle

CODE = "coalesce(result_code, 'PARSE_FAILED')"
REASON = r"""coalesce(nullif(substr(trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(CASE WHEN detail <> '' THEN detail ELSE coalesce(message, '') END, '(/[^\s''"]+)+|([A-Za-z]:\\[^\s''"]+)', ' ', 'g'), '[''"][^''"]*[''"]', ' ', 'g'), '[0-9]+', 'N', 'g'), '\s+', ' ', 'g'), ' .:;,-'), 1, 80), ''), 'UNKNOWN')"""
BUCKET = "CASE WHEN size_bytes < 1048576 THEN '< 1 MB' WHEN size_bytes < 5242880 THEN '1-5 MB' WHEN size_bytes < 20971520 THEN '5-20 MB' WHEN size_bytes < 52428800 THEN '20-50 MB' ELSE '> 50 MB' END"
DETAILED = {"detailed": r"SELECT *, CASE id % 5 WHEN 0 THEN '' WHEN 1 THEN 'C:\docs\' || source || '\a.hwp: bad ' || chr(39) || 'x' || id || chr(39) || ' at ' || id || ';' WHEN 2 THEN '/srv/' || id END AS detail FROM records JOIN (SELECT doc_id AS id, source FROM documents) USING (id)"}


def detailed(t: Tables):
    d, text = F.col("id"), F.col("id").cast("string")
    windows = F.concat(F.lit("C:\\docs\\"), "source", F.lit("\\a.hwp: bad 'x"), text, F.lit("' at "), text, F.lit(";"))
    rows = t.records.join(t.raw("documents").select(F.col("doc_id").alias("id"), "source"), "id")
    return rows.withColumn("detail", F.when(d % 5 == 0, "").when(d % 5 == 1, windows).when(d % 5 == 2, F.concat(F.lit("/srv/"), text)))


def stats_sql(rows: str, by: str, value: str) -> str:
    at = "CAST(least(greatest(round_even({p} / 100.0 * n + 0.5, 0), 1), n) AS BIGINT)"
    pick = lambda p: f"min({value}) FILTER (k = {at.format(p=p)})"
    return f"SELECT {by}, max(n) AS n, {pick(50)} AS p50, {pick(95)} AS p95, max({value}) AS most FROM (SELECT {by}, {value}, row_number() OVER (PARTITION BY {by} ORDER BY {value}) AS k, count(*) OVER (PARTITION BY {by}) AS n FROM ({rows})) GROUP BY {by}"


@query("C1_anonymous_ids", oracle("SELECT id, upper(format) || '-' || CASE WHEN n < 1000 THEN lpad(CAST(n AS VARCHAR), 3, '0') ELSE CAST(n AS VARCHAR) END AS anonymous_id FROM (SELECT *, row_number() OVER (PARTITION BY format ORDER BY sha256(path), id) AS n FROM records)"))
def c1(spark, sf):
    return pf.anonymous_ids(Tables(spark, sf).records)


@query("C2_failure_reason", oracle(f"SELECT id, {REASON} AS reason FROM detailed", **DETAILED))
def c2(spark, sf):
    return detailed(Tables(spark, sf)).select("id", pf.failure_reason(F.col("message"), F.col("detail")).alias("reason"))


@query("C5_size_buckets", oracle(f"SELECT {BUCKET} AS bucket, count(*) AS n FROM records GROUP BY 1"))
def c5(spark, sf):
    return Tables(spark, sf).records.groupBy(pf.size_bucket(F.col("size_bytes")).alias("bucket")).agg(F.count("*").alias("n"))


@query("C6_result_matrix", oracle("SELECT code, " + ", ".join(f"count(*) FILTER (format = '{f}') AS {f}" for f in ("de", "en", "es", "fr")) + f", count(r.id) AS total FROM (SELECT unnest(['TEXT_EXTRACTED', 'OCR_REQUIRED', 'ENCRYPTED', 'EMPTY_DOCUMENT', 'PARSE_FAILED']) AS code) c LEFT JOIN records r ON {CODE} = code GROUP BY code"))
def c6(spark, sf):
    return pf.result_matrix(Tables(spark, sf).records, ["de", "en", "es", "fr"])


@query("C7_format_summary", oracle("SELECT format, count(*) AS n, count(*) FILTER (result_code = 'TEXT_EXTRACTED') AS n_success, round(count(*) FILTER (result_code = 'TEXT_EXTRACTED') / count(*), 6) AS rate FROM records GROUP BY GROUPING SETS ((format), ())"))
def c7(spark, sf):
    return pf.format_summary(Tables(spark, sf).records)


@query("C8_nearest_rank", oracle(stats_sql("SELECT format, size_bytes FROM records", "format", "size_bytes")))
def c8(spark, sf):
    return pf.stats(Tables(spark, sf).records, ["format"], "size_bytes")


@query("C9_performance", oracle(stats_sql(f"SELECT {BUCKET} AS bucket, format, size_bytes FROM records", "bucket, format", "size_bytes")))
def c9(spark, sf):
    rows = Tables(spark, sf).records.withColumn("bucket", pf.size_bucket(F.col("size_bytes")))
    return pf.stats(rows, ["bucket", "format"], "size_bytes")


@query("C10_memory_ratio", oracle(stats_sql("SELECT format, round(peak_rss / size_bytes, 6) AS ratio FROM records WHERE size_bytes >= 1048576", "format", "ratio")))
def c10(spark, sf):
    rows = Tables(spark, sf).records.where("size_bytes >= 1048576").withColumn("ratio", F.round(F.col("peak_rss") / F.col("size_bytes"), 6))
    return pf.stats(rows, ["format"], "ratio")


@query("C11_failure_buckets", oracle(f"SELECT {CODE} AS code, {REASON} AS reason, count(*) AS n FROM detailed WHERE {CODE} <> 'TEXT_EXTRACTED' GROUP BY 1, 2", **DETAILED))
def c11(spark, sf):
    return pf.failure_buckets(detailed(Tables(spark, sf)))


@query("C11_container_mismatches", oracle("SELECT format, count(*) AS n FROM records WHERE container_ok = false GROUP BY 1"))
def c11b(spark, sf):
    return Tables(spark, sf).records.where(F.col("container_ok") == F.lit(False)).groupBy("format").agg(F.count("*").alias("n"))


_TURN = "SELECT format, arg_max(id, ({c}, -id)) AS id, {k} AS turn FROM records GROUP BY format"


@query("C12_determinism_sample", oracle("SELECT * FROM (SELECT format, id, row_number() OVER (PARTITION BY format ORDER BY turn, id) AS rank FROM (SELECT format, id, min(turn) AS turn FROM (" + " UNION ALL ".join(_TURN.format(c=c, k=k) for k, c in enumerate(("size_bytes", "parse_time_ms", "peak_rss"))) + " UNION ALL SELECT format, id, 3 FROM records) GROUP BY 1, 2)) WHERE rank <= 6"))
def c12(spark, sf):
    return pf.determinism_sample(Tables(spark, sf).records, 6)


@query("C13_determinism_verdict", oracle("SELECT id, id % 4 <> 0 AS deterministic FROM records"))
def c13(spark, sf):
    rows = Tables(spark, sf).records
    runs = rows.select("id", "hash", "result_code").unionByName(rows.select("id", F.when(F.col("id") % 4 == 0, F.lit(None)).otherwise(F.col("hash")).alias("hash"), "result_code"))
    return pf.determinism_verdict(runs, ["hash", "result_code"])


@query("C14_review_worklist", oracle("SELECT id, severity, n_tables, row_number() OVER (ORDER BY severity DESC, n_tables DESC, id) AS rank FROM (SELECT id, id % 3 AS severity, id % 17 AS n_tables FROM records)"))
def c14(spark, sf):
    from docwarp.operators.sinks import global_rank

    rows = Tables(spark, sf).records.select("id", (F.col("id") % 3).alias("severity"), (F.col("id") % 17).alias("n_tables"))
    return global_rank(rows, [F.desc("severity"), F.desc("n_tables"), F.asc("id")])


@query("C15_chunk_statistics", oracle("SELECT count(*) AS n, round(avg(token_count), 6) AS mean, round(quantile_cont(token_count, 0.5), 6) AS p50, round(quantile_cont(token_count, 0.95), 6) AS p95, min(token_count) AS least, max(token_count) AS most, count(*) FILTER (token_count < 16) AS tiny, count(*) FILTER (token_count > 64) AS oversize FROM chunks"))
def c15(spark, sf):
    return pf.chunk_statistics(Tables(spark, sf).chunks, 64)


@query("C16_crowding", orc("SELECT request_id, count(*) AS documents, max(c) AS most FROM (SELECT request_id, document_id, count(*) AS c FROM (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY request_id ORDER BY score DESC, document_id, chunk_index) <= 5) GROUP BY 1, 2) GROUP BY 1"))
def c16(spark, sf):
    a = Asked(spark, sf)
    return pf.crowding(rk.scored_chunks(a.found, a.t.chunks, a.t.vectors, a.asks))


@query("C17_batch_summary", oracle(f"SELECT count(*) AS n, count(*) FILTER ({CODE} = 'TEXT_EXTRACTED') AS n_success, count(*) FILTER (id % 4 <> 0 AND {CODE} = 'TEXT_EXTRACTED') AS n_deterministic, sum(size_bytes) AS bytes, max(size_bytes) AS most FROM records"))
def c17(spark, sf):
    ok = pf.code_of(F.col("result_code")) == "TEXT_EXTRACTED"
    return Tables(spark, sf).records.agg(F.count("*").alias("n"), F.count_if(ok).alias("n_success"), F.count_if(ok & (F.col("id") % 4 != 0)).alias("n_deterministic"), F.sum("size_bytes").alias("bytes"), F.max("size_bytes").alias("most"))


# -- evaluation: full-text search for all and for any of the words ranks documents for the benchmark's queries

METHODS = FTS | {
    "queries_": "SELECT query_id, category, (SELECT min(document_id) FROM qrels q WHERE q.query_id = evals.query_id) AS primary_id, query_id IN (SELECT query_id FROM qrels) AS answerable FROM evals",
    "asks": "SELECT query_id AS request_id, text AS query FROM evals",
    "rankings": f"SELECT method, request_id AS query_id, document_id, rank FROM (SELECT 'all_words' AS method, * FROM ({top_sql('SELECT * FROM density WHERE k = n', 10)}) UNION ALL SELECT 'any_word', * FROM ({top_sql('SELECT * FROM density', 10)}))",
    "allq": "SELECT query_id, method FROM evals, (SELECT DISTINCT method FROM rankings)",
    "gains": "SELECT q.query_id, document_id, CASE WHEN document_id = primary_id THEN 2 ELSE 1 END AS gain FROM qrels q JOIN queries_ USING (query_id)",
    "rec": "SELECT a.method, a.query_id, CASE WHEN n IS NULL THEN 0.0 ELSE round(coalesce(h, 0) / n, 6) END AS recall FROM allq a LEFT JOIN (SELECT query_id, count(*) AS n FROM qrels GROUP BY 1) USING (query_id) LEFT JOIN (SELECT method, query_id, count(*) AS h FROM rankings JOIN qrels USING (query_id, document_id) WHERE rank <= 5 GROUP BY 1, 2) USING (method, query_id)",
    "recip": "SELECT a.method, a.query_id, round(coalesce(1 / f, 0), 6) AS rr FROM allq a LEFT JOIN (SELECT method, query_id, min(rank) AS f FROM rankings JOIN qrels USING (query_id, document_id) GROUP BY 1, 2) USING (method, query_id)",
}


def ev(sql: str) -> str:
    return oracle(sql, **METHODS)


class Eval:
    def __init__(self, spark, sf):
        t = Tables(spark, sf)
        self.docs, self.qrels = t.docs, written(t.qrels, "qrels")
        first = self.qrels.groupBy("query_id").agg(F.min("document_id").alias("primary"))
        self.queries = t.evals.join(first, "query_id", "left").select("query_id", "category", "primary", F.col("primary").isNotNull().alias("answerable"))
        asks, texts = t.evals.select(F.col("query_id").alias("request_id"), F.col("text").alias("query")), texts_of(t)
        one = lambda name, every: rt.top(rt.full_text(texts, asks, every), 10).select(F.lit(name).alias("method"), F.col("request_id").alias("query_id"), "document_id", "rank")
        self.rankings = written(one("all_words", True).unionByName(one("any_word", False)), "rankings")
        self.gains = self.qrels.join(self.queries, "query_id").select("query_id", "document_id", F.when(F.col("document_id") == F.col("primary"), 2).otherwise(1).alias("gain"))


@query("V1_recall", ev("SELECT * FROM rec"))
def v1(spark, sf):
    e = Eval(spark, sf)
    return pf.recall_at(e.rankings, e.qrels, e.queries, 5)


@query("V2_reciprocal_rank", ev("SELECT * FROM recip"))
def v2(spark, sf):
    e = Eval(spark, sf)
    return pf.reciprocal_rank(e.rankings, e.qrels, e.queries)


@query("V3_primary_rank", ev("SELECT a.method, a.query_id, r.rank, coalesce(CAST(r.rank <= 1 AS INT), 0) AS p1, coalesce(CAST(r.rank <= 5 AS INT), 0) AS p5 FROM allq a LEFT JOIN (SELECT method, r.query_id, rank FROM rankings r JOIN queries_ q ON q.query_id = r.query_id AND q.primary_id = r.document_id) r ON r.method = a.method AND r.query_id = a.query_id"))
def v3(spark, sf):
    e = Eval(spark, sf)
    return pf.primary_rank(e.rankings, e.queries, e.queries)


def _ndcg(gains: str) -> str:
    return f"""SELECT a.method, a.query_id, round(CASE WHEN i > 0 THEN coalesce(g, 0) / i ELSE 0 END, 6) AS ndcg FROM allq a LEFT JOIN (SELECT query_id, sum(gain / log2(r + 1)) AS i FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY gain DESC, document_id) AS r FROM ({gains})) WHERE r <= 5 GROUP BY 1) USING (query_id)
  LEFT JOIN (SELECT method, query_id, sum(gain / log2(rank + 1)) AS g FROM rankings JOIN ({gains}) USING (query_id, document_id) WHERE rank <= 5 GROUP BY 1, 2) USING (method, query_id)"""


@query("V4_graded_ndcg", ev(_ndcg("SELECT * FROM gains")))
def v4(spark, sf):
    e = Eval(spark, sf)
    return pf.ndcg_at(e.rankings, e.gains, e.queries, 5)


@query("V5_hit_precision", ev(f"SELECT h.*, ndcg FROM (SELECT a.method, a.query_id, CAST(coalesce(h, 0) > 0 AS INT) AS hit, round(coalesce(h, 0) / 5, 6) AS precision FROM allq a LEFT JOIN (SELECT method, query_id, count(*) AS h FROM rankings JOIN qrels USING (query_id, document_id) WHERE rank <= 5 GROUP BY 1, 2) USING (method, query_id)) h JOIN ({_ndcg('SELECT *, 1 AS gain FROM qrels')}) USING (method, query_id)"))
def v5(spark, sf):
    e = Eval(spark, sf)
    return pf.hit_precision(e.rankings, e.qrels, e.queries, 5).join(pf.ndcg_at(e.rankings, e.qrels.withColumn("gain", F.lit(1)), e.queries, 5), ["method", "query_id"])


@query("V6_method_report", ev("SELECT method, category, count(*) AS n, round(avg(recall), 4) AS recall, round(avg(rr), 4) AS mrr FROM rec JOIN recip USING (method, query_id) JOIN queries_ USING (query_id) WHERE answerable GROUP BY ROLLUP (method, category)"))
def v6(spark, sf):
    e = Eval(spark, sf)
    rows = pf.recall_at(e.rankings, e.qrels, e.queries, 5).join(pf.reciprocal_rank(e.rankings, e.qrels, e.queries), ["method", "query_id"])
    return pf.report(rows, e.queries)


@query("V7_no_answer", ev("SELECT method, round(count(*) FILTER (NOT answerable AND coalesce(n, 0) = 0) / greatest(count(*) FILTER (NOT answerable), 1), 6) AS zero_rate, CAST(coalesce(sum(n) FILTER (NOT answerable), 0) AS BIGINT) AS false_positives, round(avg(coalesce(bad, 0)), 6) AS irrelevant FROM allq LEFT JOIN (SELECT method, r.query_id, count(*) AS n, count(*) FILTER (q.query_id IS NULL) AS bad FROM rankings r LEFT JOIN qrels q ON q.query_id = r.query_id AND q.document_id = r.document_id GROUP BY 1, 2) USING (method, query_id) JOIN queries_ USING (query_id) GROUP BY 1"))
def v7(spark, sf):
    e = Eval(spark, sf)
    return pf.no_answer(e.rankings, e.qrels, e.queries)


@query("V8_label_violations", oracle("SELECT query_id, 'UNKNOWN_DOCUMENT' AS rule FROM labels_ WHERE document_id NOT IN (SELECT id FROM docs) UNION ALL SELECT query_id, 'UNKNOWN_QUERY' FROM labels_ WHERE query_id NOT IN (SELECT query_id FROM evals) UNION ALL SELECT query_id, 'REPEATED' FROM labels_ GROUP BY query_id, document_id HAVING count(*) > 1 UNION ALL SELECT query_id, 'PRIMARY_NOT_RELEVANT' FROM (SELECT query_id, primary_id + query_id % 2 AS p FROM queries_ WHERE primary_id IS NOT NULL) x WHERE NOT EXISTS (SELECT 1 FROM labels_ l WHERE l.query_id = x.query_id AND l.document_id = x.p)", **METHODS, labels_="SELECT query_id + CASE WHEN query_id % 7 = 0 THEN 1000 ELSE 0 END AS query_id, document_id + CASE WHEN query_id % 5 = 0 THEN 1000000 ELSE 0 END AS document_id FROM qrels UNION ALL SELECT query_id, document_id FROM qrels WHERE query_id % 3 = 0"))
def v8(spark, sf):
    e = Eval(spark, sf)
    q = F.col("query_id")
    labels = e.qrels.select((q + F.when(q % 7 == 0, 1000).otherwise(0)).alias("query_id"), (F.col("document_id") + F.when(q % 5 == 0, 1000000).otherwise(0)).alias("document_id")).unionByName(e.qrels.where(q % 3 == 0))
    return pf.label_violations(e.queries.withColumn("primary", F.col("primary") + q % 2), labels, e.docs)


@query("V12_ranking_changes", ev("SELECT query_id, a IS DISTINCT FROM b AS changed, a[1] IS DISTINCT FROM b[1] AS changed_first FROM (SELECT query_id, list(document_id ORDER BY rank) FILTER (method = 'all_words') AS a, list(document_id ORDER BY rank) FILTER (method = 'any_word') AS b FROM rankings WHERE rank <= 3 GROUP BY 1)"))
def v12(spark, sf):
    e = Eval(spark, sf)
    return pf.ranking_changes(e.rankings.where("method = 'all_words'"), e.rankings.where("method = 'any_word'"))


@query("V14_best_configuration", ev("SELECT arg_max(method, (r, m, method)) AS name FROM (SELECT method, round(avg(recall), 6) AS r, round(avg(rr), 6) AS m FROM rec JOIN recip USING (method, query_id) GROUP BY 1)"))
def v14(spark, sf):
    e = Eval(spark, sf)
    rows = pf.recall_at(e.rankings, e.qrels, e.queries, 5).join(pf.reciprocal_rank(e.rankings, e.qrels, e.queries), ["method", "query_id"])
    return pf.best_configuration(rows.groupBy(F.col("method").alias("name")).agg(F.round(F.avg("recall"), 6).alias("recall"), F.round(F.avg("rr"), 6).alias("rr")), ["recall", "rr", "name"])
