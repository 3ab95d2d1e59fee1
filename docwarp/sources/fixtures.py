"""The engine's tables derived from the star-schema test tables, in Spark and, with the same arithmetic, in DuckDB SQL."""

from __future__ import annotations

import re
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from docwarp.operators.eligibility import small

TOKEN = r"[\p{L}\p{N}_]+|[^\p{L}\p{N}_\s]"
NOW = "2024-01-15 00:00:00"

#: DuckDB definitions; ``oracle`` prepends those a query needs.
CTES: dict[str, str] = {
    "departments": "SELECT CAST(n_nationkey AS BIGINT) AS id, n_name AS name FROM nation",
    "users": """SELECT CAST(c_custkey AS BIGINT) AS id, CASE WHEN c_custkey % 10 <> 9 THEN CAST(c_nationkey AS BIGINT) END AS department_id, c_custkey % 11 <> 10 AS is_active,
  CASE c_custkey % 13 WHEN 11 THEN 'PENDING' WHEN 12 THEN 'DISABLED' ELSE 'ACTIVE' END AS status FROM customer""",
    "base": """SELECT doc_id AS d, lang, source, text, ['hwp', 'hwpx', 'docx', 'pdf'][CAST(doc_id % 4 + 1 AS INT)] AS file_type,
  'doc' || doc_id || ['_report', '_manual', '_requirements', '_rfp', '', '_guide_report'][CAST(doc_id % 6 + 1 AS INT)] || CASE WHEN doc_id % 7 <> 6 THEN '_' || (2010 + doc_id % 15) ELSE '' END AS title FROM documents""",
    "docs": """SELECT d AS id, title, title || '.' || file_type AS original_filename, CASE WHEN d % 5 = 0 THEN '' ELSE source || '/' || lang || '/' END || title || '.' || file_type AS source_path,
  file_type, CASE WHEN d % 8 <> 7 THEN d % 25 END AS department_id, d % 150 AS owner_id, TIMESTAMP '2024-01-01' + to_hours(CAST(d % 97 AS INT)) AS updated_at, d % 29 = 28 AS is_deleted,
  CASE WHEN d % 31 = 30 THEN TIMESTAMP '2024-01-02' END AS missing_since, d * 10 + 1 + d % 3 AS latest_revision_id,
  CASE WHEN d % 17 = 16 THEN NULL WHEN d % 6 <> 5 THEN d * 10 + 1 + d % 3 WHEN d % 3 > 0 THEN d * 10 + d % 3 END AS current_revision_id FROM base""",
    "revisions": """SELECT d * 10 + k AS id, d AS document_id, k AS revision_no, array_to_string(list_slice(string_split(text, chr(10)), 1, greatest(1, len(string_split(text, chr(10))) - (1 + d % 3 - k))), chr(10)) AS extracted_text,
  sha256(array_to_string(list_slice(string_split(text, chr(10)), 1, greatest(1, len(string_split(text, chr(10))) - (1 + d % 3 - k))), chr(10))) AS content_hash,
  'SUCCESS' AS parse_status, CASE WHEN d % 17 = 16 THEN 'OCR_REQUIRED' ELSE 'TEXT_EXTRACTED' END AS parse_result_code, CASE WHEN k = 1 + d % 3 AND d % 6 = 5 THEN 'PENDING' ELSE 'SUCCESS' END AS embedding_status,
  CASE WHEN d % 7 <> 6 THEN 2010 + d % 15 END AS document_year, TIMESTAMP '2024-01-01' + to_hours(CAST(k AS INT)) + to_minutes(CAST(d % 1000 AS INT)) AS created_at
  FROM base, generate_series(1, 1 + d % 3) AS g(k)""",
    "perms": """SELECT id AS document_id, CAST(NULL AS BIGINT) AS user_id, CAST(NULL AS BIGINT) AS department_id, true AS is_public, 'READ' AS permission FROM docs WHERE id % 3 = 0
  UNION ALL SELECT id, id % 20, NULL, false, ['READ', 'WRITE', 'ADMIN'][CAST((id // 3) % 3 + 1 AS INT)] FROM docs WHERE id % 3 = 1
  UNION ALL SELECT id, NULL, id % 25, false, 'READ' FROM docs WHERE id % 6 = 2""",
    "tags": "SELECT CAST(i AS BIGINT) AS id, 'tag' || lpad(CAST(i AS VARCHAR), 2, '0') AS name FROM generate_series(1, 10) AS g(i)",
    "doc_tags": "SELECT id AS document_id, id % 5 + 1 AS tag_id FROM docs UNION SELECT id, id % 10 + 1 FROM docs",
    "paragraphs": """SELECT r.id AS revision_id, r.document_id, g.i AS index, string_split(extracted_text, chr(10))[CAST(g.i + 1 AS INT)] AS text,
  CASE WHEN r.document_id % 4 = 3 THEN g.i // 20 + 1 END AS page_number FROM revisions r, generate_series(0, len(string_split(extracted_text, chr(10))) - 1) AS g(i)""",
    "chunks": f"""SELECT revision_id * 1000 + index AS id, revision_id, document_id, index AS chunk_index, text, index AS paragraph_start, index AS paragraph_end, page_number,
  CAST(len(regexp_extract_all(text, '{TOKEN}')) AS BIGINT) AS token_count, CASE WHEN (document_id + index) % 37 <> 36 THEN (document_id * 31 + index) % 500 END AS vec_id FROM paragraphs""",
    "vectors": "SELECT vec_id, embedding FROM embeddings",
    "requests": """SELECT * FROM (VALUES (1, 1), (2, 9), (3, 10), (4, 11), (5, -1)) AS t(request_id, user_id)""",
    "readable": """SELECT DISTINCT request_id, document_id FROM requests q LEFT JOIN users u ON u.id = q.user_id JOIN perms p ON p.permission IN ('READ', 'WRITE', 'ADMIN')
  AND ((p.is_public AND u.id IS NOT NULL AND u.is_active AND u.status = 'ACTIVE') OR p.user_id = q.user_id OR (p.department_id IS NOT NULL AND p.department_id = u.department_id))""",
    "ready": "SELECT * FROM revisions WHERE parse_status = 'SUCCESS' AND coalesce(parse_result_code, '') = 'TEXT_EXTRACTED' AND embedding_status = 'SUCCESS'",
    "eligible": """SELECT a.request_id, d.*, r.document_year, r.extracted_text, dep.name AS department_name FROM readable a JOIN docs d ON d.id = a.document_id JOIN ready r ON r.id = d.current_revision_id AND r.document_id = d.id
  LEFT JOIN departments dep ON dep.id = d.department_id WHERE NOT d.is_deleted""",
    "asks": """SELECT q AS request_id, [1, 9, 3, 10][CAST(q % 4 + 1 AS INT)] AS user_id, (q * 7) % 500 AS vec_id, 'doc' || (q * 3) AS title_query,
  string_split(text, ' ')[2] || ' ' || string_split(text, ' ')[3] AS query FROM (SELECT doc_id // 50 + 1 AS q, text FROM documents WHERE doc_id % 50 = 0)""",
    "jobs": """SELECT event_id AS id, (event_id % (SELECT count(*) FROM documents)) * 10 + 1 AS revision_id, ['PARSE', 'EMBED', 'SUMMARIZE'][CAST(event_id % 3 + 1 AS INT)] AS job_type,
  CASE event_type WHEN 'view' THEN 'SUCCESS' WHEN 'purchase' THEN 'SUCCESS' WHEN 'error' THEN 'FAILED' WHEN 'click' THEN 'PENDING' ELSE 'RUNNING' END AS status, CAST(event_id % 4 AS BIGINT) AS attempt_count, CAST(3 AS BIGINT) AS max_attempts,
  ts AS created_at, CASE WHEN event_type <> 'click' THEN ts END AS started_at, CASE WHEN event_type IN ('view', 'purchase', 'error') THEN ts + INTERVAL 60 SECOND END AS finished_at,
  CASE WHEN event_id % 7 = 0 THEN ts + INTERVAL 5 MINUTE END AS next_attempt_at, CASE event_type WHEN 'error' THEN 'TIMEOUT' WHEN 'view' THEN 'OK' WHEN 'purchase' THEN 'OK' END AS result_code FROM events""",
    "sessions": """SELECT conv_id AS id, conv_id % 20 AS user_id, 'chat ' || conv_id AS title, CASE WHEN conv_id % 2 = 1 THEN conv_id % (SELECT count(*) FROM documents) END AS document_id,
  TIMESTAMP '2024-01-01' + to_hours(CAST(conv_id % 5000 AS INT)) AS updated_at FROM (SELECT DISTINCT conv_id FROM conversations)""",
    "messages": """SELECT conv_id * 100 + turn AS id, conv_id AS session_id, turn, role, text AS content, CASE WHEN role = 'assistant' THEN conv_id % 9 = 0 END AS refused,
  TIMESTAMP '2024-01-01' + to_hours(CAST(conv_id % 5000 AS INT)) + to_minutes(CAST(turn AS INT)) AS created_at FROM conversations""",
    "sources": """SELECT m.id AS message_id, (((m.id + k) % (SELECT count(*) FROM documents)) * 10 + 1) * 1000 AS chunk_id, (m.id + k) % (SELECT count(*) FROM documents) AS document_id, 'SOURCE ' || (k + 1) AS source_label, CAST(k + 1 AS BIGINT) AS retrieval_rank
  FROM messages m, generate_series(0, 1) AS g(k) WHERE m.role = 'assistant'""",
    "records": """SELECT doc_id AS id, source || '/' || doc_id || '.' || lang AS path, lang AS format, length(text) * 1024 AS size_bytes, length(text) / 7.0 AS parse_time_ms, (length(text) * 1024) * (1 + doc_id % 5) AS peak_rss,
  CASE doc_id % 7 WHEN 0 THEN 'OCR_REQUIRED' WHEN 1 THEN 'ENCRYPTED' WHEN 2 THEN 'EMPTY_DOCUMENT' WHEN 3 THEN NULL ELSE 'TEXT_EXTRACTED' END AS result_code,
  'Could not read /srv/share/' || source || '/file' || doc_id || '.hwp at offset ' || (doc_id * 17) || ' in "stream ' || (doc_id % 3) || '"' AS message, sha256(text) AS hash, CASE WHEN doc_id % 11 = 0 THEN NULL ELSE doc_id % 5 <> 0 END AS container_ok FROM documents""",
    "evals": """SELECT item_id AS query_id, array_to_string(list_slice(string_split(text, ' '), 1, 6), ' ') AS text, substr(text, 1, 60) AS probe, CAST(item_id % 4 AS BIGINT) AS category FROM benchmark""",
    "qrels": "SELECT query_id, doc_id AS document_id FROM evals JOIN documents ON contains(documents.text, probe)",
}


#: Costly definitions that a query may use more than once.
_ONCE = {"parts", "body_ws", "states", "rankings", "qrels"}


def oracle(sql: str, **more: str) -> str:
    """``sql`` with the definitions that it needs in front."""
    known = CTES | more
    need: list[str] = []

    def add(text: str) -> None:
        for name in known:
            if name not in need and re.search(rf"\b(?:FROM|JOIN|,)\s+{name}\b", text):
                add(known[name])
                if name not in need:
                    need.append(name)

    add(sql)
    body = sql.strip()
    head = "WITH " + ", ".join(f"{n} AS {'MATERIALIZED ' if n in _ONCE else ''}({known[n]})" for n in need) if need else ""
    if body.upper().startswith("WITH "):
        body = (", " if need else "WITH ") + body[5:]
    return f"{head} {body}"


class Tables:
    """Lazy DataFrames by name; the same names as in ``CTES``."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.dir = spark, sf_dir

    def raw(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.dir}/{name}.parquet")

    @cached_property
    def departments(self) -> DataFrame:
        return self.raw("nation").select(F.col("n_nationkey").cast("long").alias("id"), F.col("n_name").alias("name"))

    @cached_property
    def users(self) -> DataFrame:
        k = F.col("c_custkey")
        status = F.when(k % 13 == 11, "PENDING").when(k % 13 == 12, "DISABLED").otherwise("ACTIVE")
        return self.raw("customer").select(k.cast("long").alias("id"), F.when(k % 10 != 9, F.col("c_nationkey").cast("long")).alias("department_id"), (k % 11 != 10).alias("is_active"), status.alias("status"))

    @cached_property
    def base(self) -> DataFrame:
        d = F.col("doc_id")
        pick = lambda values, i: F.element_at(F.array(*[F.lit(v) for v in values]), (i + 1).cast("int"))
        year = F.when(d % 7 != 6, F.concat(F.lit("_"), (F.lit(2010) + d % 15).cast("string"))).otherwise("")
        title = F.concat(F.lit("doc"), d.cast("string"), pick(["_report", "_manual", "_requirements", "_rfp", "", "_guide_report"], d % 6), year)
        return self.raw("documents").select(d.alias("d"), "lang", "source", "text", pick(["hwp", "hwpx", "docx", "pdf"], d % 4).alias("file_type"), title.alias("title"))

    @cached_property
    def docs(self) -> DataFrame:
        d = F.col("d")
        name = F.concat("title", F.lit("."), "file_type")
        folder = F.when(d % 5 == 0, "").otherwise(F.concat("source", F.lit("/"), "lang", F.lit("/")))
        return self.base.select(
            d.alias("id"), "title", name.alias("original_filename"), F.concat(folder, name).alias("source_path"), "file_type", F.when(d % 8 != 7, d % 25).alias("department_id"), (d % 150).alias("owner_id"),
            F.expr("timestamp'2024-01-01' + make_dt_interval(0, cast(d % 97 as int))").alias("updated_at"), (d % 29 == 28).alias("is_deleted"), F.expr("CASE WHEN d % 31 = 30 THEN timestamp'2024-01-02' END").alias("missing_since"),
            (d * 10 + 1 + d % 3).alias("latest_revision_id"), F.when(d % 17 == 16, None).when(d % 6 != 5, d * 10 + 1 + d % 3).when(d % 3 > 0, d * 10 + d % 3).alias("current_revision_id"),
        )

    @cached_property
    def revisions(self) -> DataFrame:
        d, k = F.col("d"), F.col("k")
        lines = F.split("text", "\n")
        text = F.array_join(F.slice(lines, F.lit(1), F.greatest(F.lit(1), F.size(lines) - (1 + d % 3 - k)).cast("int")), "\n")
        rows = self.base.select("d", "text", F.explode(F.sequence(F.lit(1).cast("long"), 1 + d % 3)).alias("k")).withColumn("extracted_text", text)
        return rows.select(
            (d * 10 + k).alias("id"), d.alias("document_id"), k.alias("revision_no"), "extracted_text", F.sha2("extracted_text", 256).alias("content_hash"), F.lit("SUCCESS").alias("parse_status"),
            F.when(d % 17 == 16, "OCR_REQUIRED").otherwise("TEXT_EXTRACTED").alias("parse_result_code"), F.when((k == 1 + d % 3) & (d % 6 == 5), "PENDING").otherwise("SUCCESS").alias("embedding_status"),
            F.when(d % 7 != 6, F.lit(2010) + d % 15).alias("document_year"), F.expr("timestamp'2024-01-01' + make_dt_interval(0, cast(k as int), cast(d % 1000 as int))").alias("created_at"),
        )

    @cached_property
    def perms(self) -> DataFrame:
        d, none = F.col("id"), F.lit(None).cast("long")
        kind = F.element_at(F.array(F.lit("READ"), F.lit("WRITE"), F.lit("ADMIN")), (F.expr("id div 3") % 3 + 1).cast("int"))
        row = lambda user, dep, public, perm: (d.alias("document_id"), user.alias("user_id"), dep.alias("department_id"), F.lit(public).alias("is_public"), perm.alias("permission"))
        docs = self.docs.select("id")
        return (
            docs.where(d % 3 == 0).select(*row(none, none, True, F.lit("READ")))
            .unionByName(docs.where(d % 3 == 1).select(*row(d % 20, none, False, kind)))
            .unionByName(docs.where(d % 6 == 2).select(*row(none, d % 25, False, F.lit("READ"))))
        )

    @cached_property
    def tags(self) -> DataFrame:
        return self.spark.range(1, 11).select("id", F.concat(F.lit("tag"), F.lpad(F.col("id").cast("string"), 2, "0")).alias("name"))

    @cached_property
    def doc_tags(self) -> DataFrame:
        d = F.col("id")
        return self.docs.select(d.alias("document_id"), F.explode(F.array_distinct(F.array(d % 5 + 1, d % 10 + 1))).alias("tag_id"))

    @cached_property
    def paragraphs(self) -> DataFrame:
        rows = self.revisions.select(F.col("id").alias("revision_id"), "document_id", F.posexplode(F.split("extracted_text", "\n")).alias("i", "text"))
        page = F.when(F.col("document_id") % 4 == 3, F.expr("cast(i as bigint) div 20") + 1)
        return rows.select("revision_id", "document_id", F.col("i").cast("long").alias("index"), "text", page.alias("page_number"))

    @cached_property
    def chunks(self) -> DataFrame:
        d, i = F.col("document_id"), F.col("index")
        return self.paragraphs.select(
            (F.col("revision_id") * 1000 + i).alias("id"), "revision_id", "document_id", i.alias("chunk_index"), "text", i.alias("paragraph_start"), i.alias("paragraph_end"), "page_number",
            F.regexp_count("text", F.lit(TOKEN)).cast("long").alias("token_count"), F.when((d + i) % 37 != 36, (d * 31 + i) % 500).alias("vec_id"),
        )

    @cached_property
    def vectors(self) -> DataFrame:
        return self.raw("embeddings").select("vec_id", "embedding")

    @cached_property
    def requests(self) -> DataFrame:
        return self.spark.createDataFrame([(1, 1), (2, 9), (3, 10), (4, 11), (5, -1)], "request_id long, user_id long")

    @cached_property
    def asks(self) -> DataFrame:
        """A request for every document whose id is divisible by 50."""
        q = F.col("q")
        rows = self.raw("documents").where("doc_id % 50 = 0").select((F.expr("doc_id div 50") + 1).alias("q"), F.split("text", " ").alias("w"))
        user = F.element_at(F.array(F.lit(1), F.lit(9), F.lit(3), F.lit(10)), (q % 4 + 1).cast("int")).cast("long")
        return rows.select(q.alias("request_id"), user.alias("user_id"), ((q * 7) % 500).alias("vec_id"), F.concat(F.lit("doc"), (q * 3).cast("string")).alias("title_query"), F.concat(F.get("w", F.lit(1)), F.lit(" "), F.get("w", F.lit(2))).alias("query"))

    @cached_property
    def n_documents(self) -> DataFrame:
        return self.raw("documents").agg(F.count("*").alias("n"))

    @cached_property
    def jobs(self) -> DataFrame:
        e, t = F.col("event_id"), F.col("event_type")
        rows = self.raw("events").crossJoin(F.broadcast(self.n_documents))  # one row
        status = F.when(t.isin("view", "purchase"), "SUCCESS").when(t == "error", "FAILED").when(t == "click", "PENDING").otherwise("RUNNING")
        return rows.select(
            e.alias("id"), ((e % F.col("n")) * 10 + 1).alias("revision_id"), F.element_at(F.array(F.lit("PARSE"), F.lit("EMBED"), F.lit("SUMMARIZE")), (e % 3 + 1).cast("int")).alias("job_type"), status.alias("status"),
            (e % 4).cast("long").alias("attempt_count"), F.lit(3).cast("long").alias("max_attempts"), F.col("ts").alias("created_at"), F.when(t != "click", F.col("ts")).alias("started_at"),
            F.when(t.isin("view", "purchase", "error"), F.expr("ts + interval 60 seconds")).alias("finished_at"), F.when(e % 7 == 0, F.expr("ts + interval 5 minutes")).alias("next_attempt_at"),
            F.when(t == "error", "TIMEOUT").when(t.isin("view", "purchase"), "OK").alias("result_code"),
        )

    @cached_property
    def sessions(self) -> DataFrame:
        c = F.col("conv_id")
        rows = self.raw("conversations").select("conv_id").distinct().crossJoin(F.broadcast(self.n_documents))
        return rows.select(c.alias("id"), (c % 20).alias("user_id"), F.concat(F.lit("chat "), c.cast("string")).alias("title"), F.when(c % 2 == 1, c % F.col("n")).alias("document_id"), F.expr("timestamp'2024-01-01' + make_dt_interval(0, cast(conv_id % 5000 as int))").alias("updated_at"))

    @cached_property
    def messages(self) -> DataFrame:
        c = F.col("conv_id")
        at = F.expr("timestamp'2024-01-01' + make_dt_interval(0, cast(conv_id % 5000 as int), cast(turn as int))")
        return self.raw("conversations").select((c * 100 + F.col("turn")).alias("id"), c.alias("session_id"), "turn", "role", F.col("text").alias("content"), F.when(F.col("role") == "assistant", c % 9 == 0).alias("refused"), at.alias("created_at"))

    @cached_property
    def sources(self) -> DataFrame:
        rows = self.messages.where("role = 'assistant'").crossJoin(F.broadcast(self.n_documents)).select("id", "n", F.explode(F.array(F.lit(0), F.lit(1))).alias("k"))
        d = (F.col("id") + F.col("k")) % F.col("n")
        return rows.select(F.col("id").alias("message_id"), ((d * 10 + 1) * 1000).alias("chunk_id"), d.alias("document_id"), F.concat(F.lit("SOURCE "), (F.col("k") + 1).cast("string")).alias("source_label"), (F.col("k") + 1).cast("long").alias("retrieval_rank"))

    @cached_property
    def records(self) -> DataFrame:
        d, n = F.col("doc_id"), F.char_length("text").cast("long")
        code = F.when(d % 7 == 0, "OCR_REQUIRED").when(d % 7 == 1, "ENCRYPTED").when(d % 7 == 2, "EMPTY_DOCUMENT").when(d % 7 == 3, None).otherwise("TEXT_EXTRACTED")
        message = F.format_string('Could not read /srv/share/%s/file%d.hwp at offset %d in "stream %d"', F.col("source"), d, d * 17, d % 3)
        return self.raw("documents").select(
            d.alias("id"), F.concat(F.col("source"), F.lit("/"), d.cast("string"), F.lit("."), F.col("lang")).alias("path"), F.col("lang").alias("format"), (n * 1024).alias("size_bytes"), (n / 7.0).alias("parse_time_ms"), (n * 1024 * (1 + d % 5)).alias("peak_rss"),
            code.alias("result_code"), message.alias("message"), F.sha2("text", 256).alias("hash"), F.when(d % 11 != 0, d % 5 != 0).alias("container_ok"),
        )

    @cached_property
    def evals(self) -> DataFrame:
        words = F.slice(F.split("text", " "), 1, 6)
        return self.raw("benchmark").select(F.col("item_id").alias("query_id"), F.array_join(words, " ").alias("text"), F.substring("text", 1, 60).alias("probe"), (F.col("item_id") % 4).alias("category"))

    @cached_property
    def qrels(self) -> DataFrame:
        """Documents that hold a query's probe: they meet over a word inside the probe, then the whole probe is looked for."""
        words = F.split("probe", " ")
        inner = F.slice(words, F.lit(2), F.greatest(F.size(words) - 2, F.lit(0)))  # whole words of any text that holds the probe
        longest = F.element_at(F.array_sort(inner, lambda a, b: F.char_length(a) - F.char_length(b)), -1)
        asked = self.evals.select("query_id", "probe", F.when(F.size(inner) > 0, longest).alias("word"))
        texts = self.raw("documents").select(F.col("doc_id").alias("document_id"), F.col("text").alias("body"))
        met = texts.select("document_id", "body", F.explode(F.array_distinct(F.split("body", " "))).alias("word")).join(small(asked.where("word IS NOT NULL")), "word")
        rest = texts.join(small(asked.where("word IS NULL")), F.contains("body", F.col("probe")))
        found = met.where(F.contains("body", F.col("probe"))).select("query_id", "document_id")
        return found.unionByName(rest.select("query_id", "document_id"))
