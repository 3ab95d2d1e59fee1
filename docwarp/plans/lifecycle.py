"""Queries: catalogue reconciliation and the job ledger."""

from __future__ import annotations

from pyspark.sql import functions as F

from docwarp.operators import eligibility as el
from docwarp.operators import lifecycle as lc
from docwarp.plans.eligibility import with_summary
from docwarp.plans.registry import query
from docwarp.sources.fixtures import NOW, Tables, oracle

CAT = {
    "catalogue": "SELECT d.id, d.source_path, d.title, d.is_deleted, d.missing_since, d.updated_at AS created_at, sha256(b.text) AS hash FROM docs d JOIN base b ON b.d = d.id",
    "manifest": """SELECT source_path, CASE WHEN d % 11 = 10 THEN sha256(b.text || 'x') ELSE sha256(b.text) END AS hash FROM docs JOIN base b ON b.d = docs.id WHERE d % 13 <> 12 UNION ALL
  SELECT 'moved/' || original_filename, sha256(b.text) FROM docs JOIN base b ON b.d = docs.id WHERE d % 26 = 25 UNION ALL SELECT 'new/' || original_filename, sha256(reverse(b.text)) FROM docs JOIN base b ON b.d = docs.id WHERE d % 19 = 18""",
    "states": """SELECT coalesce(c.source_path, m.source_path) AS source_path, c.id, c.hash, m.hash AS new_hash, c.missing_since, c.is_deleted, CASE WHEN c.id IS NULL THEN 'unplaced' WHEN m.source_path IS NULL THEN CASE WHEN c.is_deleted THEN 'deleted' ELSE 'vanished' END
  WHEN c.hash IS DISTINCT FROM m.hash THEN 'modified' WHEN c.is_deleted OR c.missing_since IS NOT NULL THEN 'restored' ELSE 'unchanged' END AS state FROM catalogue c FULL JOIN manifest m ON m.source_path = c.source_path""",
    "pairs": """SELECT l.id, l.old_path, n.new_path FROM (SELECT hash, min(id) AS id, min(source_path) AS old_path FROM states WHERE state = 'vanished' AND missing_since IS NULL GROUP BY 1 HAVING count(*) = 1) l
  JOIN (SELECT new_hash, min(source_path) AS new_path FROM states WHERE state = 'unplaced' GROUP BY 1 HAVING count(*) = 1) n ON n.new_hash = l.hash""",
}


def orc(sql: str, **more: str) -> str:
    return oracle(sql, **CAT, **more)


class Cat:
    def __init__(self, spark, sf):
        self.t = t = Tables(spark, sf)
        text = t.base.select(F.col("d").alias("id"), "text")
        self.docs = t.docs.join(text, "id").select("id", "source_path", "title", "is_deleted", "missing_since", F.col("updated_at").alias("created_at"), F.sha2("text", 256).alias("hash"))
        rows = t.docs.select("id", "source_path", "original_filename").join(text, "id")
        d = F.col("id")
        row = lambda path, data: (path.alias("source_path"), F.sha2(data, 256).alias("hash"))
        self.manifest = (
            rows.where(d % 13 != 12).select(*row(F.col("source_path"), F.when(d % 11 == 10, F.concat("text", F.lit("x"))).otherwise(F.col("text"))))
            .unionByName(rows.where(d % 26 == 25).select(*row(F.concat(F.lit("moved/"), "original_filename"), F.col("text"))))
            .unionByName(rows.where(d % 19 == 18).select(*row(F.concat(F.lit("new/"), "original_filename"), F.reverse("text"))))
        )
        self.states = lc.classify(self.manifest, self.docs)
        self.pairs = lc.pair_renames(self.states)


def now():
    return F.lit(NOW).cast("timestamp")


@query("Y1_classify", orc("SELECT source_path, id, state FROM states"))
def y1(spark, sf):
    return Cat(spark, sf).states.select("source_path", "id", "state")


@query("Y2_existing_by_path", orc("SELECT id, source_path FROM twice QUALIFY row_number() OVER (PARTITION BY source_path ORDER BY is_deleted, created_at, id) = 1", twice="SELECT id, regexp_replace(source_path, '[0-9]+', '') AS source_path, is_deleted, created_at FROM catalogue"))
def y2(spark, sf):
    docs = Cat(spark, sf).docs.withColumn("source_path", F.regexp_replace("source_path", "^([^0-9]*)[0-9]+", "$1"))
    return lc.existing_by_path(docs).select("id", "source_path")


@query("Y3_rename_pairs", orc("SELECT * FROM pairs"))
def y3(spark, sf):
    return Cat(spark, sf).pairs


@query("Y4_relocate", orc("SELECT c.id, coalesce(p.new_path, c.source_path) AS source_path, CASE WHEN p.new_path IS NULL THEN title ELSE regexp_replace(regexp_extract(p.new_path, '[^/]*$'), '\\.[^.]*$', '') END AS title FROM catalogue c LEFT JOIN pairs p ON p.id = c.id"))
def y4(spark, sf):
    c = Cat(spark, sf)
    return lc.relocate(c.docs, c.pairs).select("id", "source_path", "title")


@query("Y5_new_documents", orc("SELECT source_path, regexp_replace(regexp_extract(source_path, '[^/]*$'), '\\.[^.]*$', '') AS title, new_hash AS hash, CAST(1 AS BIGINT) AS revision_no FROM states WHERE state = 'unplaced' AND source_path NOT IN (SELECT new_path FROM pairs)"))
def y5(spark, sf):
    c = Cat(spark, sf)
    return lc.new_documents(c.states, c.pairs)


@query("Y6_next_revision", oracle("SELECT d.id AS document_id, coalesce(max(revision_no), 0) + 1 AS revision_no FROM docs d LEFT JOIN revisions r ON r.document_id = d.id AND r.revision_no < 3 AND d.id % 4 <> 0 GROUP BY d.id"))
def y6(spark, sf):
    t = Tables(spark, sf)
    return lc.next_revision(t.revisions.where("revision_no < 3 AND document_id % 4 <> 0"), t.docs)


@query("Y7_latest_revision", oracle("SELECT document_id, max(id) AS revision_id, max(revision_no) AS revision_no FROM revisions GROUP BY 1"))
def y7(spark, sf):
    return lc.latest_revision(Tables(spark, sf).revisions)


@query("Y8_promote_current", oracle("SELECT d.id, coalesce((SELECT max(r.id) FROM ready r WHERE r.document_id = d.id), d.current_revision_id) AS current_revision_id FROM docs d"))
def y8(spark, sf):
    t = Tables(spark, sf)
    return lc.promote_current(t.docs, t.revisions.where(el.is_ready()).withColumnRenamed("id", "revision_id"))


@query("Y9_mark_missing", orc(f"SELECT c.id, CASE WHEN c.source_path NOT IN (SELECT source_path FROM manifest) AND c.id NOT IN (SELECT id FROM pairs) THEN coalesce(missing_since, TIMESTAMP '{NOW}') END AS missing_since FROM catalogue c WHERE NOT is_deleted"))
def y9(spark, sf):
    c = Cat(spark, sf)
    return lc.mark_missing(c.docs, c.manifest, c.pairs, now())


@query("Y10_expire_missing", orc(f"SELECT id FROM catalogue WHERE NOT is_deleted AND missing_since <= TIMESTAMP '{NOW}' - INTERVAL 86400 SECOND"))
def y10(spark, sf):
    return lc.expire_missing(Cat(spark, sf).docs, now(), "interval 86400 seconds")


@query("Y11_restore_seen", orc("SELECT id FROM catalogue WHERE (is_deleted OR missing_since IS NOT NULL) AND source_path IN (SELECT source_path FROM manifest)"))
def y11(spark, sf):
    c = Cat(spark, sf)
    return lc.restore_seen(c.docs, c.manifest)


@query("Y12_scan_counters", orc("SELECT " + ", ".join(f"count(*) FILTER (state = '{s}') AS {s}" for s in ("unplaced", "unchanged", "modified", "restored", "vanished")) + ", (SELECT count(*) FROM pairs) AS renamed FROM states"))
def y12(spark, sf):
    c = Cat(spark, sf)
    return lc.scan_counters(c.states, c.pairs)


@query("Y13_reconcile", orc(f"""SELECT id, source_path, hash, missing_since, CASE WHEN here THEN false ELSE is_deleted OR missing_since <= TIMESTAMP '{NOW}' - INTERVAL 86400 SECOND END AS is_deleted FROM (SELECT s.id, coalesce(p.new_path, s.source_path) AS source_path, coalesce(new_hash, hash) AS hash, is_deleted,
  state IN ('unchanged', 'modified', 'restored') OR p.new_path IS NOT NULL AS here, CASE WHEN NOT (state IN ('unchanged', 'modified', 'restored') OR p.new_path IS NOT NULL) THEN coalesce(missing_since, TIMESTAMP '{NOW}') END AS missing_since FROM states s LEFT JOIN pairs p ON p.id = s.id WHERE s.id IS NOT NULL)
  UNION ALL SELECT NULL, source_path, new_hash, NULL, false FROM states WHERE state = 'unplaced' AND source_path NOT IN (SELECT new_path FROM pairs)"""))
def y13(spark, sf):
    c = Cat(spark, sf)
    return lc.reconcile(c.manifest, c.docs, now(), "interval 86400 seconds")


_WORDS = ", ".join(f"('{k}', '{w}', {len(w)}, {i})" for k, ws in lc.KEYWORDS.items() for i, w in enumerate(ws))
_NAMES = ["", "사용자 매뉴얼 v2.hwp", "Final_Report.pdf", "요구사항_정의서 최종보고서.docx", "rfp-guide.v1.pdf", "착수보고 및 입찰.hwp", "...", "기능정의서"]
KIND = {
    "named": "SELECT id, CASE WHEN id % 3 = 0 THEN [" + ", ".join(f"'{n}'" for n in _NAMES) + "][CAST(id % 8 + 1 AS INT)] ELSE original_filename END AS name FROM docs",
    "folded": r"""SELECT id, regexp_replace(lower(CASE WHEN contains(name, '.') THEN regexp_replace(name, '\.[^.]*$', '') ELSE name END), '[\s_\-.,\[\]()<>~!@#$%^&+=|/\\''"`:;]+', '', 'g') AS f FROM named""",
    "kind_hits": f"SELECT id, kind, len, word FROM folded, (VALUES {_WORDS}) AS w(kind, word, len, no) WHERE contains(f, word) QUALIFY row_number() OVER (PARTITION BY id, kind ORDER BY len DESC, no) = 1",
    "kind_best": "SELECT id, min(kind) AS kind, min(word) AS word, count(*) AS n, string_agg(kind, '_' ORDER BY kind) AS all_kinds FROM (SELECT * FROM kind_hits QUALIFY len = max(len) OVER (PARTITION BY id)) GROUP BY id",
    "kinds": "SELECT d.id, CASE WHEN n = 1 THEN kind ELSE 'OTHER' END AS kind, CASE WHEN f = '' THEN 'EMPTY_FILENAME' WHEN n IS NULL THEN 'NO_KEYWORD_MATCH' WHEN n > 1 THEN 'AMBIGUOUS_' || all_kinds ELSE 'KEYWORD_MATCH' END AS reason, CASE WHEN n = 1 THEN word END AS matched FROM folded d LEFT JOIN kind_best b ON b.id = d.id",
    "labelled": "SELECT k.id, '종류:' || CASE kind " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in lc.LABELS.items()) + " END AS tag FROM kinds k",
    "old_tags": f"SELECT id AS document_id, 'tag' || (id % 5) AS tag FROM docs UNION ALL SELECT id, '종류:' || CASE id % 3 WHEN 0 THEN '보고서' ELSE '{lc.LABELS[lc.OTHER]}' END FROM docs WHERE id % 2 = 0",
}


def named(t: Tables):
    odd = F.array(*[F.lit(n) for n in _NAMES])
    return t.docs.select("id", F.when(F.col("id") % 3 == 0, F.get(odd, F.col("id") % 8)).otherwise(F.col("original_filename")).alias("name"))


def old_tags(t: Tables):
    d = F.col("id")
    plain = t.docs.select(d.alias("document_id"), F.concat(F.lit("tag"), (d % 5).cast("string")).alias("tag"))
    return plain.unionByName(t.docs.where(d % 2 == 0).select(d.alias("document_id"), F.concat(F.lit("종류:"), F.when(d % 3 == 0, "보고서").otherwise(lc.LABELS[lc.OTHER])).alias("tag")))


@query("T17_classify_name", oracle("SELECT * FROM kinds", **KIND))
def t17(spark, sf):
    return lc.classify_kind(named(Tables(spark, sf)))


@query("Y14_kind_tags", oracle("""SELECT document_id, tag, false AS changed FROM old_tags WHERE NOT starts_with(tag, '종류:') UNION ALL SELECT k.id, k.tag, NOT coalesce(o.tag = k.tag, false) FROM labelled k LEFT JOIN (SELECT * FROM old_tags WHERE starts_with(tag, '종류:')) o ON o.document_id = k.id""", **KIND))
def y14(spark, sf):
    t = Tables(spark, sf)
    return lc.upsert_kind_tags(old_tags(t), lc.classify_kind(named(t)))


@query("Y15_reparse_candidates", oracle("SELECT r.id, r.document_id FROM revisions r JOIN docs d ON d.latest_revision_id = r.id WHERE r.document_id % 5 = 1 AND NOT d.is_deleted AND d.missing_since IS NULL AND d.file_type IN ('pdf', 'hwp') ORDER BY r.created_at, r.id LIMIT 25"))
def y15(spark, sf):
    t = Tables(spark, sf)
    revs = t.revisions.withColumn("parse_status", F.when(F.col("document_id") % 5 == 1, "UNSUPPORTED").otherwise("SUCCESS"))
    return lc.reparse_candidates(t.docs, revs, ["pdf", "hwp"], 25)


@query("J1_enqueue_parse", oracle("SELECT id AS revision_id, 'PARSE' AS job_type FROM revisions WHERE revision_no = 1 AND id NOT IN (SELECT revision_id FROM jobs WHERE job_type = 'PARSE' AND status IN ('PENDING', 'RUNNING'))"))
def j1(spark, sf):
    t = Tables(spark, sf)
    return lc.enqueue(t.revisions.where("revision_no = 1").select(F.col("id").alias("revision_id")), t.jobs, "PARSE")


@query("J2_enqueue_gated", oracle("SELECT id AS revision_id, 'EMBED' AS job_type FROM revisions WHERE parse_result_code = 'TEXT_EXTRACTED' AND embedding_status = 'PENDING' AND id NOT IN (SELECT revision_id FROM jobs WHERE job_type = 'EMBED' AND status IN ('PENDING', 'RUNNING')) UNION ALL SELECT id, 'SUMMARIZE' FROM ready WHERE id NOT IN (SELECT revision_id FROM jobs WHERE job_type = 'SUMMARIZE' AND status IN ('PENDING', 'RUNNING'))"))
def j2(spark, sf):
    t = Tables(spark, sf)
    embed = t.revisions.where("parse_result_code = 'TEXT_EXTRACTED' AND embedding_status = 'PENDING'").select(F.col("id").alias("revision_id"))
    return lc.enqueue(embed, t.jobs, "EMBED").unionByName(lc.enqueue(t.revisions.where(el.is_ready()).select(F.col("id").alias("revision_id")), t.jobs, "SUMMARIZE"))


@query("J3_claim", oracle(f"SELECT id, 'RUNNING' AS status, attempt_count + 1 AS attempt_count, TIMESTAMP '{NOW}' AS started_at FROM jobs WHERE job_type = 'PARSE' AND status = 'PENDING' AND (next_attempt_at IS NULL OR next_attempt_at <= TIMESTAMP '{NOW}') AND attempt_count < max_attempts ORDER BY created_at, id LIMIT 50"))
def j3(spark, sf):
    return lc.claim(Tables(spark, sf).jobs, "PARSE", now(), 50)


@query("J4_recover_stale", oracle(f"SELECT id, CASE WHEN attempt_count < max_attempts THEN 'PENDING' ELSE 'FAILED' END AS status FROM jobs WHERE status = 'RUNNING' AND started_at <= TIMESTAMP '{NOW}' - INTERVAL 900 SECOND"))
def j4(spark, sf):
    return lc.recover_stale(Tables(spark, sf).jobs, now(), 900)


@query("J5_fenced_finish", oracle("SELECT r.id, CASE WHEN j.id IS NOT NULL THEN 'SUCCESS' ELSE 'SUPERSEDED' END AS outcome FROM (SELECT id, attempt_count - id % 2 AS attempt_count FROM jobs WHERE id % 3 = 0) r LEFT JOIN jobs j ON j.id = r.id AND j.attempt_count = r.attempt_count AND j.status = 'RUNNING'"))
def j5(spark, sf):
    jobs = Tables(spark, sf).jobs
    results = jobs.where("id % 3 = 0").select("id", (F.col("attempt_count") - F.col("id") % 2).alias("attempt_count"), F.lit("SUCCESS").alias("result_status"))
    return lc.finish(jobs, results)


@query("J6_retry_reset", oracle("SELECT id, 'PENDING' AS status FROM jobs WHERE status = 'FAILED' AND attempt_count < max_attempts"))
def j6(spark, sf):
    return lc.retry_failed(Tables(spark, sf).jobs)


@query("J7_unsummarised", oracle("SELECT id AS revision_id FROM (SELECT *, ['SUCCESS', 'SKIPPED', 'PENDING'][CAST(document_id % 3 + 1 AS INT)] AS s FROM ready) WHERE s = 'PENDING' AND id NOT IN (SELECT revision_id FROM jobs WHERE job_type = 'SUMMARIZE' AND status IN ('PENDING', 'RUNNING')) ORDER BY created_at, id LIMIT 40"))
def j7(spark, sf):
    t = Tables(spark, sf)
    rows = with_summary(t.revisions.where(el.is_ready())).where("summary_status = 'PENDING'")
    free = lc.enqueue(rows.select(F.col("id").alias("revision_id")), t.jobs, "SUMMARIZE").select("revision_id")
    return rows.join(free, rows["id"] == free["revision_id"], "left_semi").orderBy("created_at", "id").limit(40).select(F.col("id").alias("revision_id"))


_SUMMED = "SELECT *, ['SUCCESS', 'SKIPPED', 'PENDING'][CAST(document_id % 3 + 1 AS INT)] AS summary_status, CASE WHEN document_id % 3 = 0 OR document_id % 7 = 1 THEN left(extracted_text, 40) END AS summary FROM {}"


def summed(revs):
    return with_summary(revs).withColumn("summary", F.when((F.col("document_id") % 3 == 0) | (F.col("document_id") % 7 == 1), F.substring("extracted_text", 1, 40)))


@query("J8_resume_skipped", oracle(f"SELECT id AS revision_id FROM ({_SUMMED.format('ready')}) WHERE summary_status = 'SKIPPED' AND summary IS NULL ORDER BY created_at, id LIMIT 1000"))
def j8(spark, sf):
    return lc.resume_skipped(summed(Tables(spark, sf).revisions), el.is_ready())


@query("J8_skip_summaries", oracle(f"SELECT id AS revision_id, CASE WHEN revision_no = 1 AND summary_status = 'PENDING' THEN 'SKIPPED' ELSE summary_status END AS summary_status FROM ({_SUMMED.format('revisions')})"))
def j8b(spark, sf):
    rows = summed(Tables(spark, sf).revisions)
    return lc.skip_summaries(rows, rows.where("revision_no = 1").select(F.col("id").alias("revision_id"))).select(F.col("id").alias("revision_id"), "summary_status")


_IDLE = f"SELECT id AS revision_id, {{}} AS outcome FROM ({_SUMMED.format('ready')}) WHERE summary_status = 'PENDING' AND id NOT IN (SELECT revision_id FROM jobs WHERE job_type = 'SUMMARIZE' AND status IN ('PENDING', 'RUNNING')) ORDER BY created_at, id LIMIT 1000"


@query("J8_reconcile_summaries", oracle("SELECT * FROM (" + _IDLE.format("'queued'") + ") UNION ALL SELECT * FROM (" + _IDLE.format("'skipped'") + ")"))
def j8c(spark, sf):
    t = Tables(spark, sf)
    done = lambda on: lc.reconcile_summaries(summed(t.revisions), el.is_ready(), t.jobs, on)
    return done(True).unionByName(done(False))


@query("J9_stage_outcomes", oracle("SELECT job_type, result_code, count(*) AS n FROM (SELECT job_type, coalesce(result_code, 'NONE') AS result_code FROM jobs) GROUP BY ROLLUP (job_type, result_code)"))
def j9(spark, sf):
    return lc.stage_outcomes(Tables(spark, sf).jobs)
