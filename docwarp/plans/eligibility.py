"""Queries: scans of the catalogue's eligible part, navigation, details, permissions."""

from __future__ import annotations

from pyspark.sql import functions as F

from docwarp.operators import eligibility as el
from docwarp.operators import navigate as nv
from docwarp.plans.registry import query
from docwarp.sources.fixtures import Tables, oracle


def eligible(t: Tables, where=None):
    return el.eligible(t.requests, t.users, t.perms, t.docs, t.revisions, t.departments, where)


def visible(t: Tables):
    return el.visible(t.requests, t.users, t.perms, t.docs)


SEEN = {"seen": "SELECT a.request_id, d.* FROM readable a JOIN docs d ON d.id = a.document_id WHERE NOT d.is_deleted"}


@query("F1_read_acl", oracle("SELECT request_id, document_id FROM readable"))
def f1(spark, sf):
    t = Tables(spark, sf)
    return el.readable(t.requests, t.users, t.perms)


@query("F2_is_ready", oracle("SELECT id AS revision_id, parse_status = 'SUCCESS' AND coalesce(parse_result_code, '') = 'TEXT_EXTRACTED' AND embedding_status = 'SUCCESS' AS is_ready FROM revisions"))
def f2(spark, sf):
    return Tables(spark, sf).revisions.select(F.col("id").alias("revision_id"), el.is_ready().alias("is_ready"))


@query("F3_current_ready_chunks", oracle("SELECT c.id, c.document_id, c.chunk_index FROM chunks c JOIN ready r ON r.id = c.revision_id JOIN docs d ON d.id = r.document_id AND d.current_revision_id = r.id WHERE NOT d.is_deleted"))
def f3(spark, sf):
    t = Tables(spark, sf)
    return el.current_ready_chunks(t.docs, t.revisions, t.chunks).select("id", "document_id", "chunk_index")


@query("F4_eligible", oracle("SELECT request_id, id AS document_id, title, department_name, document_year FROM eligible"))
def f4(spark, sf):
    return eligible(Tables(spark, sf)).select("request_id", F.col("id").alias("document_id"), "title", "department_name", "document_year")


@query("F5_field_filters", oracle("SELECT request_id, id AS document_id FROM eligible WHERE department_id IN (1, 2, 3, 4, 5, 6) AND document_year BETWEEN 2012 AND 2020 AND file_type IN ('pdf', 'docx')"))
def f5(spark, sf):
    where = F.col("department_id").isin(1, 2, 3, 4, 5, 6) & F.col("document_year").between(2012, 2020) & F.col("file_type").isin("pdf", "docx")
    return eligible(Tables(spark, sf), where).select("request_id", F.col("id").alias("document_id"))


@query("F6_folder_subtree", oracle("SELECT request_id, id AS document_id, source_path FROM eligible WHERE starts_with(source_path, 'src1/')"))
def f6(spark, sf):
    return eligible(Tables(spark, sf), el.in_folder("src1")).select("request_id", F.col("id").alias("document_id"), "source_path")


@query("F7_top_level", oracle("SELECT request_id, id AS document_id FROM eligible WHERE NOT contains(source_path, '/')"))
def f7(spark, sf):
    return eligible(Tables(spark, sf), el.top_level()).select("request_id", F.col("id").alias("document_id"))


@query("F8_all_tags", oracle("SELECT request_id, id AS document_id FROM eligible WHERE (SELECT count(DISTINCT tag_id) FROM doc_tags t WHERE t.document_id = eligible.id AND tag_id IN (1, 6)) = 2"))
def f8(spark, sf):
    t = Tables(spark, sf)
    return el.with_all_tags(eligible(t), t.doc_tags, [1, 6]).select("request_id", F.col("id").alias("document_id"))


@query("F9_document_scope", oracle("SELECT request_id, id AS document_id FROM eligible WHERE id = 21"))
def f9(spark, sf):
    return eligible(Tables(spark, sf), F.col("id") == 21).select("request_id", F.col("id").alias("document_id"))


@query("F10_has_newer_revision", oracle("SELECT id AS document_id, latest_revision_id IS DISTINCT FROM current_revision_id AS has_newer FROM docs"))
def f10(spark, sf):
    return Tables(spark, sf).docs.select(F.col("id").alias("document_id"), el.has_newer_revision().alias("has_newer"))


@query("F11_ordered_tags", oracle("SELECT d.id AS document_id, coalesce(string_agg(t.name || ':' || t.id, ',' ORDER BY t.name, t.id), '') AS tags FROM docs d LEFT JOIN doc_tags x ON x.document_id = d.id LEFT JOIN tags t ON t.id = x.tag_id GROUP BY d.id"))
def f11(spark, sf):
    t = Tables(spark, sf)
    return el.ordered_tags(t.docs, t.doc_tags, t.tags).select("document_id", F.array_join(F.transform("tags", lambda x: F.concat_ws(":", x["name"], x["id"])), ",").alias("tags"))


@query("F12_accessible_ids", oracle("SELECT request_id, id AS document_id FROM eligible"))
def f12(spark, sf):
    return eligible(Tables(spark, sf)).select("request_id", F.col("id").alias("document_id"))


@query("F13_year_facet", oracle("SELECT request_id, document_year, row_number() OVER (PARTITION BY request_id ORDER BY document_year DESC) AS rank FROM (SELECT DISTINCT request_id, document_year FROM eligible WHERE document_year IS NOT NULL)"))
def f13(spark, sf):
    from pyspark.sql.window import Window

    rank = F.row_number().over(Window.partitionBy("request_id").orderBy(F.desc("document_year")))
    return el.available_years(eligible(Tables(spark, sf))).withColumn("rank", rank.cast("long"))


_NEEDLE = "CASE d % 4 WHEN 0 THEN '50%_' || d WHEN 1 THEN '  ' WHEN 2 THEN 'a\\b' ELSE title END"


@query("F14_escape_like", oracle(rf"SELECT d, CASE WHEN trim(q) <> '' THEN '%' || replace(replace(replace(trim(q), '\', '\\'), '%', '\%'), '_', '\_') || '%' END AS pattern FROM (SELECT d, CASE d % 4 WHEN 0 THEN '50%_' || d WHEN 1 THEN '  ' WHEN 2 THEN 'a\b' ELSE title END AS q FROM base)"))
def f14(spark, sf):
    d = F.col("d")
    q = F.when(d % 4 == 0, F.concat(F.lit("50%_"), d.cast("string"))).when(d % 4 == 1, "  ").when(d % 4 == 2, "a\\b").otherwise(F.col("title"))
    return Tables(spark, sf).base.select("d", el.body_pattern(q).alias("pattern"))


@query("F15_check_folder", oracle(r"""SELECT d, CASE WHEN p = '' THEN 'EMPTY' WHEN p LIKE '/%' THEN 'ABSOLUTE' WHEN contains(p, '\') THEN 'BACKSLASH' WHEN list_contains(string_split(p, '/'), '') THEN 'EMPTY_SEGMENT'
  WHEN list_contains(string_split(p, '/'), '.') OR list_contains(string_split(p, '/'), '..') THEN 'DOT_SEGMENT' WHEN p <> trim(p) THEN 'NOT_CANONICAL' END AS error
  FROM (SELECT d, CASE d % 7 WHEN 0 THEN '' WHEN 1 THEN '/' || source WHEN 2 THEN source || '\x' WHEN 3 THEN source || '//' || lang WHEN 4 THEN source || '/../' || lang WHEN 5 THEN ' ' || source ELSE source || '/' || lang END AS p FROM base)"""))
def f15(spark, sf):
    d, s = F.col("d"), F.col("source")
    p = F.when(d % 7 == 0, "").when(d % 7 == 1, F.concat(F.lit("/"), s)).when(d % 7 == 2, F.concat(s, F.lit("\\x"))).when(d % 7 == 3, F.concat_ws("//", s, "lang")).when(d % 7 == 4, F.concat_ws("/../", s, "lang")).when(d % 7 == 5, F.concat(F.lit(" "), s)).otherwise(F.concat_ws("/", s, "lang"))
    return Tables(spark, sf).base.select("d", p.alias("p")).select("d", el.check_folder(F.col("p")).alias("error"))


@query("F16_check_requests", oracle("""SELECT request_id, array_to_string(list_sort(list_filter([CASE WHEN mode = 'fuzzy' THEN 'MODE' END, CASE WHEN length(query) > 512 THEN 'QUERY_TOO_LONG' END, CASE WHEN page < 1 THEN 'PAGE' END, CASE WHEN page_size > 100 OR page_size < 1 THEN 'PAGE_SIZE' END, CASE WHEN top_level_only THEN 'FOLDER_AND_TOP_LEVEL' END], lambda x: x IS NOT NULL)), ',') AS errors
  FROM (SELECT event_id AS request_id, CASE event_id % 4 WHEN 0 THEN 'browse' WHEN 1 THEN 'Semantic' WHEN 2 THEN 'fuzzy' END AS mode, repeat('q', CAST(event_id % 600 AS INT)) AS query, event_id % 5 AS page, event_id % 120 AS page_size, event_id % 9 = 0 AS top_level_only FROM events)"""))
def f16(spark, sf):
    e = F.col("event_id")
    log = Tables(spark, sf).raw("events").select(
        e.alias("request_id"), F.when(e % 4 == 0, "browse").when(e % 4 == 1, "Semantic").when(e % 4 == 2, "fuzzy").alias("mode"), F.repeat(F.lit("q"), (e % 600).cast("int")).alias("query"),
        (e % 5).alias("page"), (e % 120).alias("page_size"), F.lit("src1/en").alias("folder"), (e % 9 == 0).alias("top_level_only"),
    )
    return el.check_requests(log).select("request_id", F.array_join("errors", ",").alias("errors"))


TREE = {"tree": """SELECT request_id, array_to_string(parts[1:k], '/') AS path, parts[CAST(k AS INT)] AS segment, k AS depth, CASE WHEN k > 1 THEN array_to_string(parts[1:k - 1], '/') END AS parent, count(*) AS n
  FROM (SELECT request_id, string_split(source_path, '/') AS parts FROM eligible) e, unnest(generate_series(1, len(parts) - 1)) AS g(k) GROUP BY ALL"""}


@query("N1_folder_tree", oracle("SELECT * FROM tree", **TREE))
def n1(spark, sf):
    return nv.folder_tree(eligible(Tables(spark, sf)))


@query("N2_browsable_count", oracle("SELECT request_id, count(*) AS n FROM eligible GROUP BY 1"))
def n2(spark, sf):
    return nv.browsable_count(eligible(Tables(spark, sf)))


@query("N3_top_level_count", oracle("SELECT request_id, count(*) FILTER (NOT contains(source_path, '/')) AS n FROM eligible GROUP BY 1"))
def n3(spark, sf):
    return nv.top_level_count(eligible(Tables(spark, sf)))


@query("N4_path_parts", oracle("SELECT id AS document_id, CASE WHEN contains(source_path, '/') THEN regexp_extract(source_path, '^(.*)/[^/]*$', 1) END AS folder, regexp_extract(source_path, '[^/]*$') AS name FROM docs"))
def n4(spark, sf):
    folder, name = nv.path_parts(F.col("source_path"))
    return Tables(spark, sf).docs.select(F.col("id").alias("document_id"), folder.alias("folder"), name.alias("name"))


@query("D1_document_detail", oracle("""SELECT s.request_id, s.id AS document_id, s.title, d.name AS department, u.status AS owner_status, c.revision_no AS current_no, l.revision_no AS latest_no, coalesce(c.document_year, l.document_year) AS year,
  coalesce(c.id IN (SELECT id FROM ready), false) AS is_searchable, s.missing_since IS NULL AS downloadable FROM seen s LEFT JOIN revisions c ON c.id = s.current_revision_id LEFT JOIN revisions l ON l.id = s.latest_revision_id
  LEFT JOIN departments d ON d.id = s.department_id LEFT JOIN users u ON u.id = s.owner_id""", **SEEN))
def d1(spark, sf):
    t = Tables(spark, sf)
    return nv.detail(visible(t), t.revisions, t.departments, t.users)


@query("D2_text_preview", oracle("""SELECT a.document_id, a.total, p.rank, p.chunk_index, p.text, a.total > 7 AS has_more FROM (SELECT document_id, count(*) AS total FROM ready_chunks GROUP BY 1) a
  LEFT JOIN (SELECT *, row_number() OVER (PARTITION BY document_id ORDER BY chunk_index) AS rank FROM ready_chunks) p ON p.document_id = a.document_id AND p.rank > 2 AND p.rank <= 7""",
  ready_chunks="SELECT c.* FROM chunks c JOIN ready r ON r.id = c.revision_id JOIN docs d ON d.current_revision_id = r.id WHERE NOT d.is_deleted"))
def d2(spark, sf):
    t = Tables(spark, sf)
    return nv.text_preview(el.current_ready_chunks(t.docs, t.revisions, t.chunks), 2, 5)


@query("D3_revision_history", oracle("SELECT * FROM (SELECT s.request_id, s.id AS document_id, r.revision_no, row_number() OVER (PARTITION BY s.request_id, s.id ORDER BY revision_no DESC) AS rank, coalesce(r.id = s.current_revision_id, false) AS is_current FROM seen s JOIN revisions r ON r.document_id = s.id) WHERE rank <= 2", **SEEN))
def d3(spark, sf):
    t = Tables(spark, sf)
    return nv.revision_history(visible(t), t.revisions, 0, 2)


@query("D4_comparable_revision", oracle("SELECT r.document_id, r.revision_no, (SELECT max(b.revision_no) FROM revisions b WHERE b.document_id = r.document_id AND b.revision_no < r.revision_no AND b.extracted_text IS NOT NULL) AS base_no FROM revisions r"))
def d4(spark, sf):
    return nv.comparable_pairs(Tables(spark, sf).revisions).drop("extracted_text")


@query("D5_paragraph_units", oracle(r"SELECT id AS revision_id, CAST(len(u) AS BIGINT) AS n, sha256(array_to_string(u, chr(10))) AS digest FROM (SELECT id, list_filter([trim(x) FOR x IN string_split(extracted_text, chr(10))], lambda x: x <> '' AND NOT regexp_matches(x, '^[\s|]+$')) AS u FROM revisions)"))
def d5(spark, sf):
    units = nv.paragraph_units(F.col("extracted_text"))
    return Tables(spark, sf).revisions.select(F.col("id").alias("revision_id"), F.size(units).cast("long").alias("n"), F.sha2(F.array_join(units, "\n"), 256).alias("digest"))


@query("D6_paragraph_diff")
def d6(spark, sf):
    revs = Tables(spark, sf).revisions
    pairs = nv.comparable_pairs(revs).where("base_no IS NOT NULL").withColumnRenamed("extracted_text", "new_text")
    old = revs.select("document_id", F.col("revision_no").alias("base_no"), F.col("extracted_text").alias("old_text"))
    return nv.paragraph_diff(pairs.join(old, ["document_id", "base_no"]))


@query("D7_vocabulary", oracle("SELECT * FROM (SELECT name, id, row_number() OVER (ORDER BY name, id) AS rank, count(*) OVER () AS total FROM departments) WHERE rank > 5 AND rank <= 15"))
def d7(spark, sf):
    return nv.vocabulary(Tables(spark, sf).departments, 5, 10)


_STATE = "SELECT *, ['SUCCESS', 'SKIPPED', 'PENDING'][CAST(document_id % 3 + 1 AS INT)] AS summary_status FROM revisions"


def with_summary(revs):
    status = F.element_at(F.array(F.lit("SUCCESS"), F.lit("SKIPPED"), F.lit("PENDING")), (F.col("document_id") % 3 + 1).cast("int"))
    return revs.withColumn("summary_status", status)


_CODED = "SELECT * REPLACE (CASE WHEN result_code IS NOT NULL THEN ['NO_TEXT', 'TOO_LARGE', 'PROVIDER_DISABLED', 'TIMEOUT'][CAST(id % 4 + 1 AS INT)] END AS result_code) FROM jobs"


@query("D8_summary_state", oracle("""SELECT s.id AS revision_id, summary_status AS state, CASE WHEN summary_status = 'SKIPPED' THEN CASE WHEN code IS NULL THEN 'PROVIDER_DISABLED' WHEN code IN ('NO_TEXT', 'TOO_LARGE', 'PROVIDER_DISABLED') THEN code END END AS reason,
  CASE WHEN summary_status = 'SKIPPED' THEN 'PROVIDER_DISABLED' END AS reason_when_off
  FROM states s LEFT JOIN (SELECT revision_id, result_code AS code FROM coded WHERE job_type = 'SUMMARIZE' AND result_code IS NOT NULL QUALIFY row_number() OVER (PARTITION BY revision_id ORDER BY finished_at DESC NULLS LAST, created_at DESC, id DESC) = 1) j ON j.revision_id = s.id""", states=_STATE, coded=_CODED))
def d8(spark, sf):
    t = Tables(spark, sf)
    codes = F.array(*[F.lit(c) for c in ("NO_TEXT", "TOO_LARGE", "PROVIDER_DISABLED", "TIMEOUT")])
    jobs = t.jobs.withColumn("result_code", F.when(F.col("result_code").isNotNull(), F.get(codes, F.col("id") % 4)))
    revisions = with_summary(t.revisions)
    off = nv.summary_state(revisions, jobs, available=False).select("revision_id", F.col("reason").alias("reason_when_off"))
    return nv.summary_state(revisions, jobs).join(off, "revision_id")


@query("D9_relocation_state", oracle("""SELECT d.id AS document_id, coalesce(r.embedding_status = 'PENDING', false) AS latest_pending, d.id IN (SELECT document_id FROM active) AS has_active_job, NOT coalesce(r.embedding_status = 'PENDING', false) AND d.id NOT IN (SELECT document_id FROM active) AS may_move
  FROM docs d LEFT JOIN revisions r ON r.id = d.latest_revision_id""", active="SELECT DISTINCT document_id FROM jobs JOIN revisions r ON r.id = jobs.revision_id WHERE status IN ('PENDING', 'RUNNING')"))
def d9(spark, sf):
    t = Tables(spark, sf)
    return nv.relocation_state(t.docs, t.revisions, t.jobs)


_NEW = "id AS document_id, CAST({} AS BIGINT) AS user_id, CAST(NULL AS BIGINT) AS department_id, {} AS is_public, 'READ' AS permission FROM docs WHERE NOT is_deleted AND id NOT IN (SELECT document_id FROM perms WHERE {})"


@query("P1_grant_user", oracle("SELECT " + _NEW.format("4", "false", "user_id = 4")))
def p1(spark, sf):
    t = Tables(spark, sf)
    return nv.grant_missing(t.docs, t.perms, F.col("user_id") == 4, "user", 4)


@query("P2_grant_public", oracle("SELECT " + _NEW.format("NULL", "true", "is_public")))
def p2(spark, sf):
    t = Tables(spark, sf)
    return nv.grant_missing(t.docs, t.perms, F.col("is_public"), "public", None)


@query("P3_revoke_read", oracle("SELECT * FROM perms WHERE NOT coalesce(user_id = 4 AND permission = 'READ', false)"))
def p3(spark, sf):
    return nv.revoke_read(Tables(spark, sf).perms, 4)


@query("P4_principal_violations", oracle("""SELECT document_id, 'PRINCIPALS' AS rule FROM broken WHERE (user_id IS NOT NULL)::INT + (department_id IS NOT NULL)::INT + is_public::INT <> 1
  UNION ALL SELECT document_id, 'PUBLIC_TWICE' FROM broken WHERE is_public GROUP BY document_id HAVING count(*) > 1""",
  broken="SELECT document_id, user_id, department_id, is_public OR document_id % 50 = 4 AS is_public, permission FROM perms UNION ALL SELECT * FROM perms WHERE is_public AND document_id % 90 = 3"))
def p4(spark, sf):
    perms = Tables(spark, sf).perms
    d = F.col("document_id")
    return nv.principal_violations(perms.withColumn("is_public", F.col("is_public") | (d % 50 == 4)).unionByName(perms.where(F.col("is_public") & (d % 90 == 3))))
