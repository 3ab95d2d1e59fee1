"""Queries: ranking and retrieval."""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import functions as F

from docwarp.functions import similarity as sim
from docwarp.operators import eligibility as el
from docwarp.operators import ranking as rk
from docwarp.operators import retrieval as rt
from docwarp.operators.scratch import unsent, written
from docwarp.operators.textindex import spread
from docwarp.plans.registry import query
from docwarp.sources.fixtures import Tables, oracle


def trg(text: str) -> str:
    return rf"flatten([[substr('  ' || w || ' ', i, 3) FOR i IN range(1, length(w) + 2)] FOR w IN list_filter(regexp_split_to_array(lower({text}), '[^\p{{L}}\p{{N}}]+'), lambda x: x <> '')])"


def ws(rows: str, keep: str, q: str = "query", t: str = "text", bound: str = "") -> str:
    """Rows (a CTE name) with their word similarity as ``ws``, kept columns ``keep``; ``bound`` leaves out extents too long for a high value."""
    return f"""SELECT {keep}, coalesce(max(c / (n + d - c)), 0) AS ws FROM (SELECT {keep}, len(q) AS n, len(list_intersect(t[i:j], q)) AS c, len(list_distinct(t[i:j])) AS d
  FROM (SELECT *, unnest(m) AS i FROM (SELECT *, [k FOR k IN range(1, len(t) + 1) IF list_contains(q, t[k])] AS m FROM (SELECT {keep}, list_distinct({trg(q)}) AS q, {trg(t)} AS t FROM {rows}))) x, unnest(m) AS u(j) WHERE j >= i{bound}) GROUP BY {keep}"""


ASK = {"requests": "SELECT request_id, user_id FROM asks"}
SCORED = ASK | {
    "scored": """SELECT e.request_id, e.id AS document_id, c.id AS chunk_id, c.chunk_index, list_cosine_similarity(CAST(v.embedding AS DOUBLE[]), CAST(w.embedding AS DOUBLE[])) AS score
  FROM eligible e JOIN chunks c ON c.revision_id = e.current_revision_id JOIN vectors v ON v.vec_id = c.vec_id JOIN asks a ON a.request_id = e.request_id JOIN vectors w ON w.vec_id = a.vec_id""",
    "best": "SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY request_id, document_id ORDER BY score DESC, chunk_index) = 1",
    "titled": "SELECT e.request_id, e.id AS document_id, title, a.query, a.title_query FROM eligible e JOIN asks a ON a.request_id = e.request_id",
    "title_ws": ws("titled", "request_id, document_id", "query", "title"),
    "title_ws2": ws("titled", "request_id, document_id", "title_query", "title"),
    "body_hit": "SELECT e.request_id, e.id AS document_id, contains(lower(extracted_text), lower(query)) AS has FROM eligible e JOIN asks a ON a.request_id = e.request_id",
    "body_fire": "SELECT request_id FROM body_hit GROUP BY 1 HAVING count(*) FILTER (has) BETWEEN 1 AND count(*) * 0.5",
    "meant": """SELECT b.*, b.score AS semantic, round(b.score + 0.075 * coalesce(t.ws, 0) + CASE WHEN h.has AND f.request_id IS NOT NULL THEN 0.1 ELSE 0 END, 6) AS total_score FROM best b LEFT JOIN title_ws t ON t.request_id = b.request_id AND t.document_id = b.document_id
  LEFT JOIN body_hit h ON h.request_id = b.request_id AND h.document_id = b.document_id LEFT JOIN body_fire f ON f.request_id = b.request_id""",
    "paged": "SELECT * FROM (SELECT request_id, document_id, chunk_id, total_score AS score, row_number() OVER (PARTITION BY request_id ORDER BY total_score DESC, document_id) AS rank, count(*) OVER (PARTITION BY request_id) AS total FROM meant) WHERE rank <= 20",
    "body_rows": "SELECT e.request_id, e.id AS document_id, c.id AS chunk_id, c.text, a.query FROM eligible e JOIN chunks c ON c.revision_id = e.current_revision_id JOIN asks a ON a.request_id = e.request_id",
    "body_near": f"SELECT * FROM body_rows WHERE len(list_intersect({trg('text')}, {trg('query')})) >= {{0}} * len(list_distinct({trg('query')}))".replace("{0}", "0.6"),
    "body_ws": ws("body_near", "request_id, document_id, chunk_id", bound=" AND j - i < 3 * len(q)"),
    "body_lex": "SELECT request_id, document_id, round(max(ws), 6) AS body_lexical FROM body_ws WHERE round(ws, 6) >= 0.6 GROUP BY 1, 2",
    "parts": r"""SELECT e.request_id, e.id AS document_id, round(b.score, 6) AS semantic, coalesce(round(t.ws, 6), 0) AS title_trigram, coalesce(l.body_lexical, 0) AS body_lexical, contains(regexp_replace(lower(e.extracted_text), '[\s_.,/()\[\]-]+', ' ', 'g'), regexp_replace(lower(a.query), '[\s_.,/()\[\]-]+', ' ', 'g')) AS body_contains,
  contains(e.title, a.title_query) AS title_contains FROM eligible e JOIN asks a ON a.request_id = e.request_id JOIN best b ON b.request_id = e.request_id AND b.document_id = e.id LEFT JOIN title_ws2 t ON t.request_id = e.request_id AND t.document_id = e.id LEFT JOIN body_lex l ON l.request_id = e.request_id AND l.document_id = e.id""",
    "sem": "SELECT request_id, document_id, semantic AS score FROM parts",
    "lex": "SELECT request_id, document_id, body_lexical AS score FROM parts WHERE body_lexical >= 0.6",
}


def orc(sql: str) -> str:
    return oracle(sql, **SCORED)


class Asked:
    """Everything that the branches of a ranking query share, written once and read by each of them."""

    def __init__(self, spark, sf):
        self.t = Tables(spark, sf)
        self.asks = written(self.t.asks, "asks")

    @cached_property
    def found(self):
        """The eligible documents of each request, without their texts."""
        t = self.t
        return unsent(written(el.eligible(self.asks, t.users, t.perms, t.docs, t.revisions, t.departments).drop("extracted_text"), "eligible"))

    @cached_property
    def same(self):
        """Which requests may read the same documents."""
        return written(el.alike(self.asks, self.t.users), "alike")

    @cached_property
    def kinds(self):
        """The eligible documents of one request of each kind: as many as callers that differ, whatever the number of requests."""
        t = self.t
        asks = self.asks.join(self.same.select(F.col("like").alias("request_id")).distinct(), "request_id", "left_semi")
        return unsent(written(el.eligible(asks, t.users, t.perms, t.docs, t.revisions, t.departments).drop("extracted_text"), "kinds"))

    @cached_property
    def texts(self):
        return written(spread(el.ready_texts(self.t.docs, self.t.revisions)), "texts")

    @cached_property
    def best(self):
        return rk.best_chunks(self.found, self.t.chunks, self.t.vectors, self.asks)

    @cached_property
    def meant(self):
        return rk.semantic(self.found, self.t.chunks, self.t.vectors, self.asks, texts=self.texts)

    @cached_property
    def parts(self):
        """Score components; the rankings that are made of them read one table."""
        return unsent(written(rt.components(self.found, self.t.chunks, self.best, self.asks, self.texts), "components"))

    @property
    def sem(self):
        return self.parts.select("request_id", "document_id", F.col("semantic").alias("score"))

    @property
    def lex(self):
        return self.parts.where("body_lexical >= 0.6").select("request_id", "document_id", F.col("body_lexical").alias("score"))


def ranks(df, k=None):
    rows = df.select("request_id", "document_id", F.round("score", 6).alias("score"))
    return rt.full_rank(rows) if k is None else rt.top(rows, k)


def top_sql(rows: str, k: int = 1 << 30) -> str:
    return f"SELECT * FROM (SELECT request_id, document_id, round(score, 6) AS score, row_number() OVER (PARTITION BY request_id ORDER BY round(score, 6) DESC, document_id) AS rank FROM ({rows})) WHERE rank <= {k}"


@query("R1_browse", orc("SELECT * FROM (SELECT request_id, id AS document_id, title, updated_at, row_number() OVER (PARTITION BY request_id ORDER BY updated_at DESC, id) AS rank, count(*) OVER (PARTITION BY request_id) AS total FROM eligible) WHERE rank <= 20"))
def r1(spark, sf):
    a = Asked(spark, sf)
    return el.for_all(rk.browse(a.kinds), a.same)


@query("R2_cosine", orc("SELECT request_id, document_id, chunk_id, round(score, 6) AS score FROM scored"))
def r2(spark, sf):
    a = Asked(spark, sf)
    return rk.scored_chunks(a.found, a.t.chunks, a.t.vectors, a.asks).select("request_id", "document_id", "chunk_id", F.round("score", 6).alias("score"))


@query("R3_best_chunk", orc("SELECT request_id, document_id, chunk_id, round(score, 6) AS score FROM best"))
def r3(spark, sf):
    return Asked(spark, sf).best.select("request_id", "document_id", "chunk_id", F.round("score", 6).alias("score"))


@query("R4_title_boost", orc("SELECT request_id, document_id, round(coalesce(ws, 0) * 0.075, 6) AS boost FROM titled LEFT JOIN title_ws2 USING (request_id, document_id)"))
def r4(spark, sf):
    a = Asked(spark, sf)
    return rk.title_scores(a.found, a.asks, "title_query").select("request_id", "document_id", F.round(F.col("title_score") * rk.TITLE_BOOST, 6).alias("boost"))


@query("R5_body_boost", orc("SELECT request_id, document_id FROM body_hit WHERE has AND request_id IN (SELECT request_id FROM body_fire)"))
def r5(spark, sf):
    a = Asked(spark, sf)
    return rk.body_matches(a.kinds, a.asks, texts=a.texts, same=a.same)


@query("R6_semantic_search", orc("SELECT request_id, document_id, chunk_id, score, rank, total FROM paged"))
def r6(spark, sf):
    return rk.ranked(Asked(spark, sf).meant).select("request_id", "document_id", "chunk_id", "score", "rank", "total")


_SOLID = "(length(trim({0})) >= 20 AND (length({0}) - length(regexp_replace({0}, '[가-힣A-Za-z0-9]', '', 'g'))) / greatest(length({0}), 1) >= 0.35 AND NOT (length(trim({0})) < 40 AND contains({0}, '|')))"


@query("R7_snippet_chunk", oracle(f"""SELECT p.request_id, p.document_id, coalesce(s.cand, p.chunk_id) AS snippet_id FROM paged p LEFT JOIN
  (SELECT * FROM fit LEFT JOIN fit_ws USING (request_id, document_id, cand) QUALIFY row_number() OVER (PARTITION BY request_id, document_id ORDER BY has DESC, round(coalesce(ws, 0), 6) DESC, chunk_index) = 1) s ON s.request_id = p.request_id AND s.document_id = p.document_id""",
  **SCORED, fit=f"""SELECT p.request_id, p.document_id, c.id AS cand, c.chunk_index, c.text, a.query, contains(lower(c.text), lower(a.query)) AS has FROM paged p JOIN chunks k ON k.id = p.chunk_id JOIN chunks c ON c.revision_id = k.revision_id JOIN asks a ON a.request_id = p.request_id
  WHERE contains(lower(c.text), lower(a.query)) OR (NOT {_SOLID.format('k.text')} AND {_SOLID.format('c.text')})""", fit_has="SELECT * FROM fit WHERE has", fit_ws=ws("fit_has", "request_id, document_id, cand")))
def r7(spark, sf):
    a = Asked(spark, sf)
    return rk.snippets(rk.ranked(a.meant), a.found, a.t.chunks, a.asks)


@query("R8_substantial", oracle(f"SELECT id AS chunk_id, {_SOLID.format('text')} AS substantial FROM chunks"))
def r8(spark, sf):
    return Tables(spark, sf).chunks.select(F.col("id").alias("chunk_id"), sim.substantial(F.col("text")).alias("substantial"))


@query("R9_lexical_search")
def r9(spark, sf):
    a = Asked(spark, sf)
    return rk.ranked(rk.lexical(a.found, a.asks, texts=a.texts))


@query("R10_lexical_chunk", orc("""SELECT h.request_id, h.document_id, c.chunk_id, c.chunk_score FROM (SELECT request_id, document_id FROM body_hit WHERE has) h LEFT JOIN
  (SELECT request_id, document_id, chunk_id, round(ws, 6) AS chunk_score FROM body_ws WHERE round(ws, 6) >= 0.6 QUALIFY row_number() OVER (PARTITION BY request_id, document_id ORDER BY round(ws, 6) DESC, chunk_id) = 1) c USING (request_id, document_id)"""))
def r10(spark, sf):
    a = Asked(spark, sf)
    hits = rk.body_hits(a.found, a.asks.where(F.trim("query") != ""), F.lower, a.texts)
    return rk.lexical_chunks(hits, a.found, a.t.chunks, a.asks, 0.6)


@query("R11_pagination", orc("SELECT * FROM (SELECT request_id, id AS document_id, row_number() OVER (PARTITION BY request_id ORDER BY updated_at DESC, id) AS rank, count(*) OVER (PARTITION BY request_id) AS total FROM eligible) WHERE rank > 40 AND rank <= 60"))
def r11(spark, sf):
    a = Asked(spark, sf)
    return el.for_all(rk.browse(a.kinds, 40, 20), a.same).select("request_id", "document_id", "rank", "total")


@query("R12_mode_routing")
def r12(spark, sf):
    a = Asked(spark, sf)
    q = F.col("request_id") % 3
    modes = a.asks.withColumn("query", F.when(q == 0, F.lit(" ")).otherwise(F.col("query"))).withColumn("mode", F.when(q == 1, "lexical"))
    return rk.route(a.found, a.t.chunks, a.t.vectors, modes, texts=a.texts)


@query("R13_display_snippet", oracle(r"SELECT id AS chunk_id, CASE WHEN length(f) > 200 THEN rtrim(substr(f, 1, 200)) || '…' ELSE f END AS snippet FROM (SELECT id, trim(regexp_replace(text, '\s+', ' ', 'g')) AS f FROM chunks)"))
def r13(spark, sf):
    return Tables(spark, sf).chunks.select(F.col("id").alias("chunk_id"), sim.display_snippet(F.col("text")).alias("snippet"))


@query("R14_query_digest", oracle("SELECT query_id, CASE WHEN trim(text) <> '' THEN substr(sha256(text), 1, 12) END AS digest FROM evals"))
def r14(spark, sf):
    return Tables(spark, sf).evals.select("query_id", sim.query_digest(F.col("text")).alias("digest"))


@query("R15_citation_anchor", oracle("""SELECT c.id AS chunk_id, CASE WHEN p THEN 'page' ELSE 'paragraph' END AS type, CASE WHEN NOT p THEN paragraph_start END AS paragraph_index, CASE WHEN NOT p THEN paragraph_end END AS paragraph_end, CASE WHEN p THEN page_number END AS page_number
  FROM (SELECT c.*, d.file_type = 'pdf' AND page_number IS NOT NULL AS p FROM chunks c JOIN docs d ON d.id = c.document_id) c"""))
def r15(spark, sf):
    t = Tables(spark, sf)
    rows = t.chunks.join(t.docs.select(F.col("id").alias("document_id"), "file_type"), "document_id")
    return rows.select(F.col("id").alias("chunk_id"), sim.citation_anchor(F.col("file_type"), F.col("paragraph_start"), F.col("paragraph_end"), F.col("page_number")).alias("a")).select("chunk_id", "a.*")


@query("R16_public_projection", orc("SELECT p.request_id, p.rank, d.id AS document_id, d.title, d.file_type, d.source_path FROM paged p JOIN docs d ON d.id = p.document_id"))
def r16(spark, sf):
    a = Asked(spark, sf)
    docs = a.t.docs.select(F.col("id").alias("document_id"), "title", "file_type", "source_path")
    return rk.ranked(a.meant).join(docs, "document_id").select("request_id", "rank", "document_id", "title", "file_type", "source_path")


@query("R17_hydrate_context", orc("""SELECT i.request_id, i.position, c.id AS chunk_id, c.document_id, c.text FROM (SELECT request_id, k AS position, (((request_id * 11 + k * 3) * 10 + 1) * 1000 + k % 3) AS id FROM asks, generate_series(0, 29) AS g(k)) i
  JOIN chunks c ON c.id = i.id JOIN eligible e ON e.request_id = i.request_id AND e.id = c.document_id AND e.current_revision_id = c.revision_id WHERE length(c.text) <= 250"""))
def r17(spark, sf):
    a = Asked(spark, sf)
    ids = F.transform(F.sequence(F.lit(0), F.lit(29)), lambda k: ((F.col("request_id") * 11 + k * 3) * 10 + 1) * 1000 + k % 3)
    return rk.hydrate(a.asks.select("request_id", ids.alias("ids")), a.kinds, a.t.chunks, 250, a.same)


@query("R18_batched_search", orc(top_sql("SELECT request_id, document_id, total_score AS score FROM meant", 5)))
def r18(spark, sf):
    return ranks(Asked(spark, sf).meant, 5)


@query("X1_word_similarity", orc("SELECT request_id, document_id, coalesce(round(ws, 6), 0) AS ws FROM titled LEFT JOIN title_ws2 USING (request_id, document_id)"))
def x1(spark, sf):
    a = Asked(spark, sf)
    return rk.title_scores(a.found, a.asks, "title_query").select("request_id", "document_id", F.round("title_score", 6).alias("ws"))


@query("X2_trigram_candidates", oracle(f"""SELECT request_id, c.id AS key, round(len(list_intersect(q, t)) / len(q), 6) AS bound FROM (SELECT request_id, list_distinct({trg('query')}) AS q FROM asks) a, (SELECT id, list_distinct({trg('text')}) AS t FROM chunks) c WHERE len(list_intersect(q, t)) >= 0.6 * len(q)"""))
def x2(spark, sf):
    t = Tables(spark, sf)
    return rk.trigram_candidates(t.chunks.select(F.col("id").alias("key"), "text"), t.asks, 0.6).withColumn("bound", F.round("bound", 6))


def texts_of(t: Tables):
    return t.base.select(F.col("d").alias("document_id"), "title", "text")


@query("X3_trigram_search")
def x3(spark, sf):
    t = Tables(spark, sf)
    return rt.top(rt.trigram_search(texts_of(t), t.asks), 10)


FTS = {
    "tok": r"SELECT d AS document_id, i AS pos, w[CAST(i AS INT)] AS token FROM (SELECT d, list_filter(regexp_split_to_array(lower(text), '[^\p{L}\p{N}]+'), lambda x: x <> '') AS w FROM base), unnest(generate_series(1, len(w))) AS g(i)",
    "qtok": r"SELECT request_id, len(q) AS n, unnest(q) AS token FROM (SELECT request_id, list_distinct(list_filter(regexp_split_to_array(lower(query), '[^\p{L}\p{N}]+'), lambda x: x <> '')) AS q FROM asks)",
    "hit": "SELECT q.request_id, t.document_id, t.pos, t.token, q.n FROM tok t JOIN qtok q ON q.token = t.token",
    "own": "SELECT request_id, document_id, n, count(DISTINCT token) AS k FROM hit GROUP BY ALL",
    "lasts": """SELECT h.request_id, h.document_id, h.pos, t.token, max(CASE WHEN h.token = t.token THEN h.pos END) OVER (PARTITION BY h.request_id, h.document_id, t.token ORDER BY h.pos) AS last FROM hit h JOIN (SELECT DISTINCT request_id, document_id, token FROM hit) t ON t.request_id = h.request_id AND t.document_id = h.document_id""",
    "ends": "SELECT l.request_id, l.document_id, l.pos, o.k, o.n, min(last) AS b FROM lasts l JOIN own o ON o.request_id = l.request_id AND o.document_id = l.document_id GROUP BY ALL HAVING count(last) = o.k",
    "covers": "SELECT request_id, document_id, k, n, b, min(pos) AS e FROM ends GROUP BY ALL",
    "density": "SELECT request_id, document_id, k, n, round(sum(0.1 / (1 + e - b + 1 - k)), 6) AS score FROM covers GROUP BY ALL",
}


@query("X4_fts_and", oracle(top_sql("SELECT * FROM density WHERE k = n", 10), **FTS))
def x4(spark, sf):
    t = Tables(spark, sf)
    return rt.top(rt.full_text(texts_of(t), t.asks, True), 10)


@query("X5_fts_or", oracle(top_sql("SELECT * FROM density", 10), **FTS))
def x5(spark, sf):
    t = Tables(spark, sf)
    return rt.top(rt.full_text(texts_of(t), t.asks, False), 10)


@query("X6_vector_max", orc(top_sql("SELECT request_id, document_id, max(score) AS score FROM scored GROUP BY 1, 2", 10)))
def x6(spark, sf):
    a = Asked(spark, sf)
    return rt.top(rt.vector_max(a.best), 10)


_RRF = "SELECT request_id, document_id, sum(1.0 / (60 + rank)) AS score FROM ({}) GROUP BY 1, 2"
_SEMR, _LEXR = top_sql("SELECT * FROM sem"), top_sql("SELECT * FROM lex")


@query("X7_rrf", orc(top_sql(_RRF.format(f"{_SEMR} UNION ALL {_LEXR}"), 10)))
def x7(spark, sf):
    a = Asked(spark, sf)
    return ranks(rt.rrf([ranks(a.sem), ranks(a.lex)]), 10)


@query("X8_hybrid_depth", orc(top_sql(_RRF.format(f"{top_sql('SELECT * FROM sem', 15)} UNION ALL {top_sql('SELECT * FROM lex', 15)}"), 5)))
def x8(spark, sf):
    a = Asked(spark, sf)
    return rt.hybrid([a.sem, a.lex], 15, 5)


@query("X9_lexical_gate", orc(top_sql("SELECT * FROM sem WHERE (request_id, document_id) IN (SELECT (request_id, document_id) FROM lex)")))
def x9(spark, sf):
    a = Asked(spark, sf)
    return ranks(rt.gated(a.sem, a.lex))


@query("X10_gated_rrf", orc(top_sql(_RRF.format(f"{_SEMR} UNION ALL {_LEXR}") + " HAVING request_id IN (SELECT request_id FROM lex)")))
def x10(spark, sf):
    a = Asked(spark, sf)
    return ranks(rt.union_rrf(a.sem, a.lex, True))


@query("X11_single_rankings", orc(f"SELECT 'semantic' AS method, * FROM ({_SEMR}) UNION ALL SELECT 'lexical', * FROM ({_LEXR})"))
def x11(spark, sf):
    a = Asked(spark, sf)
    return ranks(a.sem).withColumn("method", F.lit("semantic")).unionByName(ranks(a.lex).withColumn("method", F.lit("lexical")))


@query("X12_exact_title", orc(top_sql("SELECT request_id, document_id, semantic + CASE WHEN title_contains THEN 1 ELSE 0 END AS score FROM parts", 10)))
def x12(spark, sf):
    return ranks(rt.exact_title(Asked(spark, sf).parts), 10)


@query("X13_title_trigram", orc(top_sql("SELECT request_id, document_id, semantic + title_trigram AS score FROM parts", 10)))
def x13(spark, sf):
    return ranks(rt.title_proportional(Asked(spark, sf).parts), 10)


@query("X14_field_aware", orc(top_sql("SELECT request_id, document_id, semantic + title_trigram + 0.3 * body_lexical + CASE WHEN title_contains THEN 1 ELSE 0 END AS score FROM parts", 10)))
def x14(spark, sf):
    return ranks(rt.field_aware(Asked(spark, sf).parts), 10)


@query("X15_components", orc("SELECT * FROM parts"))
def x15(spark, sf):
    return Asked(spark, sf).parts


@query("X16_folded_containment", orc("SELECT request_id, document_id FROM parts WHERE body_contains"))
def x16(spark, sf):
    return Asked(spark, sf).parts.where("body_contains").select("request_id", "document_id")


@query("X17_body_boosts", orc(f"SELECT 'strong' AS kind, * FROM ({top_sql('SELECT request_id, document_id, semantic + CASE WHEN body_lexical >= 0.6 THEN 0.1 ELSE 0 END AS score FROM parts', 10)}) UNION ALL SELECT 'exact', * FROM ({top_sql('SELECT request_id, document_id, semantic + CASE WHEN body_contains THEN 0.1 ELSE 0 END AS score FROM parts', 10)})"))
def x17(spark, sf):
    parts = Asked(spark, sf).parts
    strong = ranks(rt.strong_body(parts, F.lit(0.1), F.lit(0.6)), 10).withColumn("kind", F.lit("strong"))
    return strong.unionByName(ranks(rt.exact_body(parts, F.lit(0.1)), 10).withColumn("kind", F.lit("exact")))


def _sel(fires: str) -> str:
    return top_sql(f"SELECT request_id, document_id, semantic + CASE WHEN {fires} AND n > 0 AND n <= greatest(1, floor(total * 0.2)) THEN 0.1 ELSE 0 END AS score FROM (SELECT *, count(*) FILTER ({fires}) OVER (PARTITION BY request_id) AS n, count(*) OVER (PARTITION BY request_id) AS total FROM parts)", 10)


@query("X18_selective_boosts", orc(f"SELECT 'strong' AS kind, * FROM ({_sel('body_lexical >= 0.6')}) UNION ALL SELECT 'exact', * FROM ({_sel('body_contains')})"))
def x18(spark, sf):
    parts = Asked(spark, sf).parts
    strong = ranks(rt.selective(parts, F.col("body_lexical") >= 0.6, F.lit(0.1), F.lit(0.2)), 10).withColumn("kind", F.lit("strong"))
    return strong.unionByName(ranks(rt.selective(parts, F.col("body_contains"), F.lit(0.1), F.lit(0.2)), 10).withColumn("kind", F.lit("exact")))


@query("X19_two_lists", orc(top_sql("SELECT request_id, document_id, 1.0 / (60 + row_number() OVER (PARTITION BY request_id ORDER BY semantic DESC, document_id)) + 1.0 / (60 + row_number() OVER (PARTITION BY request_id ORDER BY body_lexical DESC, document_id)) AS score FROM parts", 10)))
def x19(spark, sf):
    return ranks(rt.two_lists(Asked(spark, sf).parts), 10)
