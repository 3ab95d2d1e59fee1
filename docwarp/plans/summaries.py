"""Queries: embeddings, summary plans, generated answers."""

from __future__ import annotations

from pyspark.sql import functions as F

from docwarp.operators import embed as em
from docwarp.operators import lifecycle as lc
from docwarp.operators import summary as sm
from docwarp.plans.registry import query
from docwarp.sources.fixtures import NOW, Tables, oracle

_VECTOR = r"""SELECT id, bucket, s / sqrt(sum(s * s) OVER (PARTITION BY id)) AS value FROM (SELECT id, CAST(concat('0x', substr(md5(w), 1, 8)) AS BIGINT) % 64 AS bucket, sum(CASE WHEN substr(md5(w), 9, 1) < '8' THEN 1 ELSE -1 END) AS s
  FROM (SELECT d AS id, unnest(regexp_extract_all(lower({0} || text), '[\p{{L}}\p{{N}}]+')) AS w FROM base) GROUP BY 1, 2)"""


@query("E1_embedding", oracle(" UNION ALL ".join(f"SELECT '{k}' AS kind, id, bucket, round(CAST(CAST(value AS FLOAT) AS DOUBLE), 5) AS value FROM ({_VECTOR.format(repr(p))}) WHERE value <> 0" for k, p in em.PREFIX.items())))
def e1(spark, sf):
    texts = Tables(spark, sf).base.where("text IS NOT NULL").select(F.col("d").alias("id"), "text")  # in SQL a null text has no vector
    one = lambda kind: em.embed(texts, kind).select(F.lit(kind).alias("kind"), "id", F.posexplode("embedding").alias("bucket", "value"))
    rows = one("passage").unionByName(one("query")).where("value <> 0")
    return rows.select("kind", "id", F.col("bucket").cast("long").alias("bucket"), F.round(F.col("value").cast("double"), 5).alias("value"))


_EMBEDDED = f"""SELECT r.id AS revision_id, CASE WHEN n IS NULL OR bad THEN 'FAILED' ELSE 'SUCCESS' END AS status, CASE WHEN n IS NULL THEN 'NO_CHUNKS' WHEN bad THEN 'INVALID_VECTOR' ELSE 'EMBEDDED' END AS code, CASE WHEN n IS NOT NULL AND NOT bad THEN 'local' END AS provider,
  CASE WHEN n IS NOT NULL AND NOT bad THEN CAST(64 AS BIGINT) END AS dimension, CASE WHEN n IS NOT NULL AND NOT bad THEN TIMESTAMP '{NOW}' ELSE r.created_at END AS embedded_at, CASE WHEN n IS NOT NULL AND NOT bad THEN n ELSE 0 END AS n_vectors
  FROM revisions r LEFT JOIN (SELECT revision_id, count(*) AS n, bool_or(vec_id IS NULL) AS bad FROM chunks WHERE document_id % 10 <> 3 GROUP BY 1) c ON c.revision_id = r.id"""


@query("E3_revision_embedding", oracle(_EMBEDDED))
def e3(spark, sf):
    t = Tables(spark, sf)
    chunks = t.chunks.where("document_id % 10 <> 3").join(t.vectors, "vec_id", "left").select("id", "revision_id", "embedding")
    revisions, stored = em.embed_revisions(t.revisions.select("id", "embedding_status", F.col("created_at").alias("embedded_at")), chunks, "local", "hashing", 64, "1", F.lit(NOW).cast("timestamp"))
    n = stored.where("embedding IS NOT NULL").groupBy(F.col("revision_id").alias("id")).agg(F.count("*").alias("n"))
    rows = revisions.join(n, "id", "left")
    return rows.select(F.col("id").alias("revision_id"), F.col("embedding_status").alias("status"), F.col("result_code").alias("code"), F.col("embedding_provider").alias("provider"), F.col("embedding_dimension").alias("dimension"), "embedded_at", F.coalesce("n", F.lit(0)).alias("n_vectors"))


# chunks under section titles of three chunks each; of every fifth document without any
_TITLE = "CASE WHEN document_id % 5 <> 0 AND (chunk_index // 3) % 4 <> 3 THEN 's' || (chunk_index // 3) % 4 END"
PLAN = {
    "use_": f"SELECT revision_id, chunk_index, text, {_TITLE} AS s FROM chunks WHERE regexp_replace(text, '\\s+', '', 'g') <> ''",
    "isl_": "SELECT *, sum(CASE WHEN rn = 1 OR s IS DISTINCT FROM b THEN 1 ELSE 0 END) OVER (PARTITION BY revision_id ORDER BY chunk_index) AS island FROM (SELECT *, lag(s) OVER w AS b, row_number() OVER w AS rn FROM use_ WINDOW w AS (PARTITION BY revision_id ORDER BY chunk_index))",
    "sec_": "SELECT *, CASE WHEN max(island) OVER (PARTITION BY revision_id) > 1 THEN island ELSE chunk_index END AS sec FROM isl_",
    "item_": "SELECT *, row_number() OVER (PARTITION BY revision_id ORDER BY chunk_index, part) AS i FROM (SELECT revision_id, chunk_index, sec, part, length(substr(text, (part - 1) * 5800 + 1, 5800)) + 200 AS w FROM sec_, generate_series(1, greatest(1, CAST(ceil(length(text) / 5800) AS BIGINT))) AS g(part))",
}
_RUNS = """a_ AS (SELECT revision_id, i, CAST(1 AS BIGINT) AS p, w AS total, sec, true AS first FROM item_ WHERE i = 1
  UNION ALL SELECT q.revision_id, q.i, CASE WHEN q.sec = a.sec AND a.total + q.w <= 6000 THEN a.p ELSE a.p + 1 END, CASE WHEN q.sec = a.sec AND a.total + q.w <= 6000 THEN a.total + q.w ELSE q.w END, q.sec, q.sec <> a.sec FROM a_ a JOIN item_ q ON q.revision_id = a.revision_id AND q.i = a.i + 1),
run_ AS (SELECT revision_id, p, max(total) AS total, bool_or(first) AS first FROM a_ GROUP BY 1, 2),
b_ AS (SELECT revision_id, p, CAST(0 AS BIGINT) AS g, total FROM run_ WHERE p = 1
  UNION ALL SELECT r.revision_id, r.p, CASE WHEN r.first AND b.total + r.total <= 6000 THEN b.g ELSE b.g + 1 END, CASE WHEN r.first AND b.total + r.total <= 6000 THEN b.total + r.total ELSE r.total END FROM b_ b JOIN run_ r ON r.revision_id = b.revision_id AND r.p = b.p + 1)"""


def recursive(sql: str, **more: str) -> str:
    return oracle(f"WITH {_RUNS} {sql}", **more).replace("WITH ", "WITH RECURSIVE ", 1)


def titled(t: Tables):
    block = F.expr("(chunk_index div 3) % 4")
    title = F.when((F.col("document_id") % 5 != 0) & (block != 3), F.concat(F.lit("s"), block.cast("string")))
    return t.chunks.select("revision_id", "chunk_index", title.alias("section_title"), "text")


@query("G3_budget_packing", recursive("SELECT i.revision_id, i.chunk_index, i.part, b.g AS grp FROM item_ i JOIN a_ a ON a.revision_id = i.revision_id AND a.i = i.i JOIN b_ b ON b.revision_id = a.revision_id AND b.p = a.p", **PLAN))
def g3(spark, sf):
    return sm.pack(sm.summary_items(titled(Tables(spark, sf))))


_CHAIN = "SELECT *, CASE WHEN n > 1 THEN CAST(ceil(n / 6.0) AS BIGINT) ELSE 0 END AS l0, " + ", ".join(f"CASE WHEN l{k} > 1 THEN CAST(ceil(l{k} / 6.0) AS BIGINT) ELSE 0 END AS l{k + 1}" for k in range(6)) + " FROM count_"


@query("G4_summary_plan", recursive(", count_ AS (SELECT r.id AS revision_id, coalesce(max(g) + 1, 0) AS n FROM revisions r LEFT JOIN b_ b ON b.revision_id = r.id GROUP BY 1), chain_ AS (" + _CHAIN + ") SELECT revision_id, n AS n_groups, n > 1 AS hierarchical, CASE WHEN n <= 1 THEN n ELSE n + l0 + l1 + l2 + l3 + l4 + l5 + l6 END AS max_calls, CASE WHEN n <= 1 THEN n ELSE n + l0 + l1 + l2 + l3 + l4 + l5 + l6 END > 200 AS oversized FROM chain_", **PLAN))
def g4(spark, sf):
    t = Tables(spark, sf)
    return sm.plan(t.revisions, titled(t))


_FLAT = r"trim(regexp_replace(text, '\s+', ' ', 'g'))"


@query("G5_reduction_level", recursive("SELECT i.revision_id, i.chunk_index, c.text, b.g AS grp FROM item_ i JOIN cut_ c ON c.revision_id = i.revision_id AND c.chunk_index = i.chunk_index JOIN a_ a ON a.revision_id = i.revision_id AND a.i = i.i JOIN b_ b ON b.revision_id = a.revision_id AND b.p = a.p",
    cut_=f"SELECT revision_id, chunk_index, CASE WHEN length({_FLAT}) <= 700 THEN {_FLAT} ELSE rtrim(left({_FLAT}, 700)) || '…' END AS text FROM chunks",
    item_="SELECT revision_id, chunk_index, 0 AS sec, length(text) + 200 AS w, row_number() OVER (PARTITION BY revision_id ORDER BY chunk_index) AS i FROM cut_"))
def g5(spark, sf):
    return sm.reduce_level(Tables(spark, sf).chunks.select("revision_id", "chunk_index", "text"))


@query("G7_save_summary", oracle(f"SELECT id, CASE WHEN document_id % 4 < 3 THEN ['SUCCESS', 'FAILED', 'SKIPPED'][CAST(document_id % 4 + 1 AS INT)] ELSE 'PENDING' END AS summary_status, CASE WHEN document_id % 4 = 0 THEN left(extracted_text, 30) WHEN document_id % 2 = 1 THEN 'old' END AS summary, CASE WHEN document_id % 4 = 0 THEN 'local' END AS summary_provider, CASE WHEN document_id % 4 = 0 THEN TIMESTAMP '{NOW}' END AS summarized_at FROM revisions"))
def g7(spark, sf):
    d, none = F.col("document_id"), F.lit(None).cast("string")
    revisions = Tables(spark, sf).revisions.select("id", "document_id", "extracted_text", F.lit("PENDING").alias("summary_status"), F.when(d % 2 == 1, "old").alias("summary"), none.alias("summary_provider"), none.alias("summary_model"), none.alias("summary_prompt_version"), F.lit(None).cast("timestamp").alias("summarized_at"))
    ok = d % 4 == 0
    results = revisions.where(d % 4 < 3).select("id", F.get(F.array(F.lit("SUCCESS"), F.lit("FAILED"), F.lit("SKIPPED")), d % 4).alias("status"), F.when(ok, F.substring("extracted_text", 1, 30)).alias("summary"), F.when(ok, "local").alias("summary_provider"), none.alias("summary_model"), none.alias("summary_prompt_version"))
    return lc.save_summary(revisions, results, F.lit(NOW).cast("timestamp")).select("id", "summary_status", "summary", "summary_provider", "summarized_at")


# answers of every kind: malformed, with a key too many, of a wrong type, citing unknown chunks, unanswerable, blank, sound
_RAW = """CASE WHEN m % 5 = 0 THEN '{"answerable": tru' WHEN m % 13 = 0 THEN '{"answerable": "true", "answer": "x", "citation_chunk_ids": []}' WHEN m % 17 = 0 THEN '{"answerable": true, "answer": "x", "citation_chunk_ids": [], "more": 1}'
  WHEN m % 7 = 0 THEN '{"answerable": true, "answer": "x", "citation_chunk_ids": ["' || c || '", "none"]}' WHEN m % 11 = 0 THEN '{"answerable": false, "answer": "", "citation_chunk_ids": ["' || c || '"]}'
  WHEN m % 19 = 0 THEN '{"answerable": true, "answer": " ", "citation_chunk_ids": ["' || c || '"]}' ELSE '{"answerable": true, "answer": "answer ' || m || '", "citation_chunk_ids": ["' || c || '", "' || c || '"]}' END"""


@query("G9_generation_validation", oracle(f"""SELECT id, CASE WHEN good THEN answer ELSE '{sm.REFUSAL}' END AS answer, NOT good AS refused, CASE WHEN good OR sound AND able = 'false' THEN array_to_string(cited, ',') ELSE '' END AS citations FROM (SELECT *, sound AND able = 'true' AND len(cited) > 0 AND trim(answer) <> '' AS good FROM (
  SELECT id, js->>'$.answer' AS answer, js->>'$.answerable' AS able, coalesce(json_valid(raw) AND list_sort(json_keys(js)) = ['answer', 'answerable', 'citation_chunk_ids'] AND json_type(js, '$.answerable') = 'BOOLEAN' AND json_type(js, '$.answer') = 'VARCHAR' AND json_type(js, '$.citation_chunk_ids') = 'ARRAY' AND len(list_filter(cited, lambda x: NOT list_contains(context, x))) = 0, false) AS sound, cited
  FROM (SELECT *, list_distinct(from_json(js->'$.citation_chunk_ids', '["VARCHAR"]')) AS cited FROM (SELECT *, CASE WHEN json_valid(raw) THEN CAST(raw AS JSON) END AS js FROM raw_))))""",
    raw_=f"SELECT m AS id, {_RAW} AS raw, context FROM (SELECT message_id AS m, min(CAST(chunk_id AS VARCHAR)) AS c, list(CAST(chunk_id AS VARCHAR)) AS context FROM sources GROUP BY 1)"))
def g9(spark, sf):
    rows = Tables(spark, sf).sources.groupBy(F.col("message_id").alias("id")).agg(F.min(F.col("chunk_id").cast("string")).alias("c"), F.collect_list(F.col("chunk_id").cast("string")).alias("context"))
    m, c = F.col("id"), F.col("c")
    text = lambda *parts: F.concat(*[p if not isinstance(p, str) else F.lit(p) for p in parts])
    raw = (
        F.when(m % 5 == 0, '{"answerable": tru').when(m % 13 == 0, '{"answerable": "true", "answer": "x", "citation_chunk_ids": []}').when(m % 17 == 0, '{"answerable": true, "answer": "x", "citation_chunk_ids": [], "more": 1}')
        .when(m % 7 == 0, text('{"answerable": true, "answer": "x", "citation_chunk_ids": ["', c, '", "none"]}')).when(m % 11 == 0, text('{"answerable": false, "answer": "", "citation_chunk_ids": ["', c, '"]}'))
        .when(m % 19 == 0, text('{"answerable": true, "answer": " ", "citation_chunk_ids": ["', c, '"]}')).otherwise(text('{"answerable": true, "answer": "answer ', m.cast("string"), '", "citation_chunk_ids": ["', c, '", "', c, '"]}'))
    )
    return sm.validate(rows.select("id", raw.alias("raw"), "context")).select("id", "answer", "refused", F.array_join("citations", ",").alias("citations"))
