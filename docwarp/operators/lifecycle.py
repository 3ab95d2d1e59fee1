"""Catalogue reconciliation and the job ledger as set-based transitions: old tables and inputs in, new tables out. ``now`` is an argument."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from docwarp.functions.text import compose

ACTIVE = ("PENDING", "RUNNING")


def existing_by_path(docs: DataFrame) -> DataFrame:
    """One document per path: one that is not deleted before a deleted one, then the oldest."""
    rank = F.row_number().over(Window.partitionBy("source_path").orderBy("is_deleted", F.asc_nulls_last("created_at"), "id"))
    return docs.withColumn("rn", rank).where("rn = 1").drop("rn")


def classify(manifest: DataFrame, docs: DataFrame) -> DataFrame:
    """source_path, id, state of a full outer join by path: unplaced, unchanged, modified, restored or vanished. Only the hash says modified."""
    seen = manifest.select("source_path", F.col("hash").alias("new_hash"), F.lit(True).alias("seen"))
    rows = existing_by_path(docs).join(seen, "source_path", "full_outer")
    gone = F.coalesce("is_deleted", F.lit(False)) | F.col("missing_since").isNotNull()
    state = F.when(F.col("id").isNull(), "unplaced").when(F.col("seen").isNull(), F.when(F.col("is_deleted"), "deleted").otherwise("vanished")).when(~F.col("hash").eqNullSafe(F.col("new_hash")), "modified").when(gone, "restored").otherwise("unchanged")
    return rows.select("source_path", "id", "hash", "new_hash", "missing_since", "is_deleted", state.alias("state"))


def pair_renames(states: DataFrame) -> DataFrame:
    """id, old_path, new_path where a vanished and an unplaced file share a hash that is unique on both sides."""
    lost = states.where("state = 'vanished' AND missing_since IS NULL").groupBy(F.col("hash").alias("h")).agg(F.count("*").alias("n"), F.min("id").alias("id"), F.min("source_path").alias("old_path")).where("n = 1")
    new = states.where("state = 'unplaced'").groupBy(F.col("new_hash").alias("h")).agg(F.count("*").alias("n"), F.min("source_path").alias("new_path")).where("n = 1")
    return lost.select("h", "id", "old_path").join(new.select("h", "new_path"), "h").select("id", "old_path", "new_path")


def file_title(path: Column) -> Column:
    return F.regexp_replace(F.substring_index(path, "/", -1), r"\.[^.]*$", "")


def relocate(docs: DataFrame, pairs: DataFrame) -> DataFrame:
    """Documents with the paths, names and titles of their renames; nothing else changes."""
    moved = docs.join(pairs.select("id", "new_path"), "id", "left")
    path = F.coalesce("new_path", "source_path")
    return moved.select(*[path.alias(c) if c == "source_path" else F.when(F.col("new_path").isNull(), F.col(c)).otherwise(file_title(F.col("new_path"))).alias(c) if c == "title" else F.col(c) for c in docs.columns])


def new_documents(states: DataFrame, pairs: DataFrame) -> DataFrame:
    """source_path, title, hash, revision_no of files that are neither known nor renamed."""
    rest = states.where("state = 'unplaced'").join(pairs.select(F.col("new_path").alias("source_path")), "source_path", "left_anti")
    return rest.select("source_path", file_title(F.col("source_path")).alias("title"), F.col("new_hash").alias("hash"), F.lit(1).cast("long").alias("revision_no"))


def next_revision(revisions: DataFrame, of: DataFrame) -> DataFrame:
    """document_id, revision_no to give each document of ``of`` (id)."""
    top = revisions.groupBy("document_id").agg(F.max("revision_no").alias("top"))
    return of.select(F.col("id").alias("document_id")).join(top, "document_id", "left").select("document_id", (F.coalesce("top", F.lit(0)) + 1).cast("long").alias("revision_no"))


def latest_revision(revisions: DataFrame) -> DataFrame:
    return revisions.groupBy("document_id").agg(F.max_by("id", "revision_no").alias("revision_id"), F.max("revision_no").alias("revision_no"))


def promote_current(docs: DataFrame, ready: DataFrame) -> DataFrame:
    """id, current_revision_id: the highest READY revision; unchanged without one."""
    best = ready.groupBy(F.col("document_id").alias("id")).agg(F.max_by(F.col("revision_id"), "revision_no").alias("best"))
    return docs.select("id", "current_revision_id").join(best, "id", "left").select("id", F.coalesce("best", "current_revision_id").alias("current_revision_id"))


def mark_missing(docs: DataFrame, seen: DataFrame, pairs: DataFrame, now: Column) -> DataFrame:
    """id, missing_since: unseen, unpaired documents start or go on missing; seen ones are not missing."""
    found = seen.select("source_path").distinct().withColumn("seen", F.lit(True))
    rows = docs.where("NOT is_deleted").join(found, "source_path", "left").join(pairs.select("id", F.lit(True).alias("paired")), "id", "left")
    here = F.coalesce("seen", F.lit(False)) | F.coalesce("paired", F.lit(False))
    return rows.select("id", F.when(~here, F.coalesce("missing_since", now)).alias("missing_since"))


def expire_missing(docs: DataFrame, now: Column, grace: str) -> DataFrame:
    """Ids to delete softly: missing for ``grace`` or longer."""
    return docs.where(~F.col("is_deleted") & (F.col("missing_since") <= now - F.expr(grace))).select("id")


def restore_seen(docs: DataFrame, seen: DataFrame) -> DataFrame:
    """Ids of missing or deleted documents whose path is there again."""
    back = docs.where("is_deleted OR missing_since IS NOT NULL")
    return back.join(seen.select("source_path").distinct(), "source_path", "left_semi").select("id")


def scan_counters(states: DataFrame, pairs: DataFrame) -> DataFrame:
    counts = states.agg(*[F.count_if(F.col("state") == s).alias(s) for s in ("unplaced", "unchanged", "modified", "restored", "vanished")])
    return counts.crossJoin(pairs.agg(F.count("*").alias("renamed")))


def reconcile(manifest: DataFrame, docs: DataFrame, now: Column, grace: str) -> DataFrame:
    """The next catalogue: id (null for new documents), source_path, hash, missing_since, is_deleted. The same manifest again changes nothing."""
    states = classify(manifest, docs)
    pairs = pair_renames(states)
    new = new_documents(states, pairs).select(F.lit(None).cast("long").alias("id"), "source_path", "hash", F.lit(None).cast("timestamp").alias("missing_since"), F.lit(False).alias("is_deleted"))
    known = states.where("id IS NOT NULL").join(pairs.select("id", "new_path"), "id", "left")
    here = F.col("state").isin("unchanged", "modified", "restored") | F.col("new_path").isNotNull()
    missing = F.when(~here, F.coalesce("missing_since", now))
    gone = F.when(here, F.lit(False)).otherwise(F.col("is_deleted") | (missing <= now - F.expr(grace)))
    kept = known.select("id", F.coalesce("new_path", "source_path").alias("source_path"), F.coalesce("new_hash", "hash").alias("hash"), missing.alias("missing_since"), gone.alias("is_deleted"))
    return kept.unionByName(new)


#: Labels of the kinds and the words that name them in a file name. Fixed values.
LABELS = {"MANUAL": "매뉴얼", "REQUIREMENTS": "요구사항 정의서", "PROPOSAL": "제안·입찰 문서", "REPORT": "보고서", "OTHER": "기타"}
KEYWORDS = {
    "REQUIREMENTS": (
        "요구사항정의서", "기능요구사항정의서", "요구사항명세서", "요구사항명세", "기능요구사항", "요구사항", "기능정의서",
        "requirementspecification", "requirements", "requirement",
    ),
    "PROPOSAL": ("제안요청서", "과업지시서", "입찰공고", "제안평가", "제안서", "견적요청서", "입찰", "낙찰", "rfp"),
    "REPORT": ("완료보고서", "착수보고서", "중간보고서", "결과보고서", "최종보고서", "수행보고서", "완료보고", "착수보고", "보고서", "report"),
    "MANUAL": ("사용자매뉴얼", "설치매뉴얼", "운영매뉴얼", "관리자매뉴얼", "사용자가이드", "사용설명서", "설치가이드", "매뉴얼", "안내서", "manual", "guide"),
}
OTHER = "OTHER"
#: Characters that are left out of a name before its words are sought. Fixed values.
SEPARATORS = r"""[\s_\-.,\[\]()<>~!@#$%^&+=|/\\'"`:;]+"""


def fold_name(name: Column) -> Column:
    """A file name without its extension and separators, composed and in lower case."""
    stem = F.when(F.contains(name, F.lit(".")), F.regexp_extract(name, r"(?s)\A(.*)\.", 1)).otherwise(name)
    return F.regexp_replace(F.lower(compose(stem)), SEPARATORS, "")


def classify_kind(names: DataFrame) -> DataFrame:
    """id, kind, reason, matched of (id, name): the kind with the longest keyword in the folded name; equally long ones of several kinds give OTHER."""
    folded = names.select("id", fold_name(F.coalesce("name", F.lit(""))).alias("folded"))
    rows = [(kind, w, len(w), i) for kind, ws in KEYWORDS.items() for i, w in enumerate(ws)]
    words = names.sparkSession.createDataFrame(rows, "kind string, word string, len int, no int")
    hits = folded.join(F.broadcast(words), F.contains("folded", F.col("word")))  # a fixed vocabulary
    best = hits.groupBy("id", "kind").agg(F.max("len").alias("len"), F.min_by("word", F.struct(-F.col("len"), "no")).alias("word"))
    ranked = best.groupBy("id").agg(F.array_sort(F.collect_list(F.struct((-F.col("len")).alias("less"), "kind", "word"))).alias("b"))  # four kinds at most
    winners = F.filter("b", lambda x: x["less"] == F.get("b", F.lit(0))["less"])
    out = folded.join(ranked, "id", "left").withColumn("w", winners)
    one = F.size("w") == 1
    several = F.concat(F.lit("AMBIGUOUS_"), F.array_join(F.array_sort(F.transform("w", lambda x: x["kind"])), "_"))
    reason = F.when(F.col("folded") == "", "EMPTY_FILENAME").when(F.col("w").isNull(), "NO_KEYWORD_MATCH").when(one, "KEYWORD_MATCH").otherwise(several)
    winner = F.get("w", F.lit(0))
    return out.select("id", F.when(one, winner["kind"]).otherwise(OTHER).alias("kind"), reason.alias("reason"), F.when(one, winner["word"]).alias("matched"))


def upsert_kind_tags(doc_tags: DataFrame, kinds: DataFrame) -> DataFrame:
    """document_id, tag, changed: exactly one kind tag per document, others stay; ``changed`` says whether it is new."""
    old = doc_tags.where(F.startswith("tag", F.lit("종류:"))).select("document_id", F.col("tag").alias("old"))
    new = kinds.select(F.col("id").alias("document_id"), F.concat(F.lit("종류:"), F.element_at(F.create_map(*[F.lit(x) for kv in LABELS.items() for x in kv]), F.col("kind"))).alias("tag"))
    same = old.groupBy("document_id").agg(F.count("*").alias("n"), F.min("old").alias("old"))
    flagged = new.join(same, "document_id", "left").select("document_id", "tag", (~F.coalesce((F.col("n") == 1) & (F.col("old") == F.col("tag")), F.lit(False))).alias("changed"))
    others = doc_tags.where(~F.startswith("tag", F.lit("종류:"))).select("document_id", "tag", F.lit(False).alias("changed"))
    return others.unionByName(flagged)


def reparse_candidates(docs: DataFrame, revisions: DataFrame, types: list[str], limit: int) -> DataFrame:
    """The oldest UNSUPPORTED latest revisions of present documents whose type can now be parsed."""
    live = docs.where("NOT is_deleted AND missing_since IS NULL").where(F.lower("file_type").isin(types)).select(F.col("latest_revision_id").alias("id"))
    return revisions.where("parse_status = 'UNSUPPORTED'").join(live, "id", "left_semi").orderBy("created_at", "id").limit(limit).select("id", "document_id")


def enqueue(candidates: DataFrame, jobs: DataFrame, job_type: str) -> DataFrame:
    """revision_id, job_type of candidates (revision_id) without an active job of that type."""
    busy = jobs.where((F.col("job_type") == job_type) & F.col("status").isin(*ACTIVE)).select("revision_id")
    return candidates.select("revision_id").distinct().join(busy, "revision_id", "left_anti").withColumn("job_type", F.lit(job_type))


def claim(jobs: DataFrame, job_type: str, now: Column, limit: int) -> DataFrame:
    """The first ``limit`` due jobs, as they are once claimed."""
    due = jobs.where((F.col("job_type") == job_type) & (F.col("status") == "PENDING") & (F.col("next_attempt_at").isNull() | (F.col("next_attempt_at") <= now)) & (F.col("attempt_count") < F.col("max_attempts")))
    return due.orderBy("created_at", "id").limit(limit).select("id", F.lit("RUNNING").alias("status"), (F.col("attempt_count") + 1).alias("attempt_count"), now.alias("started_at"))


def recover_stale(jobs: DataFrame, now: Column, seconds: int) -> DataFrame:
    """id, status of jobs that ran too long: another attempt if any is left, else FAILED."""
    stale = jobs.where((F.col("status") == "RUNNING") & (F.col("started_at") <= now - F.expr(f"interval {seconds} seconds")))
    return stale.select("id", F.when(F.col("attempt_count") < F.col("max_attempts"), "PENDING").otherwise("FAILED").alias("status"))


def finish(jobs: DataFrame, results: DataFrame) -> DataFrame:
    """id, outcome of results (id, attempt_count, result_status): applied only to the running attempt, else superseded."""
    running = jobs.where("status = 'RUNNING'").select("id", "attempt_count", F.lit(True).alias("mine"))
    return results.join(running, ["id", "attempt_count"], "left").select("id", F.when(F.col("mine"), F.col("result_status")).otherwise("SUPERSEDED").alias("outcome"))


def retry_failed(jobs: DataFrame) -> DataFrame:
    return jobs.where("status = 'FAILED' AND attempt_count < max_attempts").select("id", F.lit("PENDING").alias("status"))


def stage_outcomes(jobs: DataFrame) -> DataFrame:
    """Counts by job type and result code, with totals (null) from a rollup."""
    return jobs.withColumn("result_code", F.coalesce("result_code", F.lit("NONE"))).rollup("job_type", "result_code").agg(F.count("*").alias("n"))


def skip_summaries(revisions: DataFrame, of: DataFrame) -> DataFrame:
    """Revisions once no summary will be written for those of ``of`` (revision_id): PENDING becomes SKIPPED, any other state stays."""
    marks = of.select(F.col("revision_id").alias("id")).distinct().withColumn("_skip", F.lit(True))
    rows = revisions.join(marks, "id", "left")
    status = F.when(F.col("_skip") & (F.col("summary_status") == "PENDING"), "SKIPPED").otherwise(F.col("summary_status"))
    return rows.withColumn("summary_status", status).drop("_skip")


def resume_skipped(revisions: DataFrame, ready: Column, limit: int = 1000) -> DataFrame:
    """revision_id of the first ``limit`` READY revisions without a summary that were skipped; they become PENDING."""
    return revisions.where(ready & (F.col("summary_status") == "SKIPPED") & F.col("summary").isNull()).orderBy("created_at", "id").limit(limit).select(F.col("id").alias("revision_id"))


def unsummarised(revisions: DataFrame, ready: Column, jobs: DataFrame, limit: int) -> DataFrame:
    """revision_id of the first ``limit`` READY revisions whose summary is PENDING and that no job is at work on."""
    rows = revisions.where(ready & (F.col("summary_status") == "PENDING"))
    free = enqueue(rows.select(F.col("id").alias("revision_id")), jobs, "SUMMARIZE").select(F.col("revision_id").alias("id"))
    return rows.join(free, "id", "left_semi").orderBy("created_at", "id").limit(limit).select(F.col("id").alias("revision_id"))


def reconcile_summaries(revisions: DataFrame, ready: Column, jobs: DataFrame, enabled: bool, limit: int = 1000) -> DataFrame:
    """revision_id, outcome: READY revisions without an answer get a job where generation is ``enabled``, else they are skipped."""
    return unsummarised(revisions, ready, jobs, limit).withColumn("outcome", F.lit("queued" if enabled else "skipped"))


def save_summary(revisions: DataFrame, results: DataFrame, now: Column) -> DataFrame:
    """Revisions (id, summary_status, summary, summary_provider, summary_model, summary_prompt_version, summarized_at) once ``results``
    (id, status, and new values or nulls) are written; a null leaves the old value, only SUCCESS sets the time, no other revision changes."""
    fields = ["summary", "summary_provider", "summary_model", "summary_prompt_version"]
    rows = revisions.join(results.select("id", F.col("status").alias("_status"), *[F.col(c).alias(f"_{c}") for c in fields]), "id", "left")
    values = {c: F.coalesce(f"_{c}", c) for c in fields} | {
        "summary_status": F.coalesce("_status", "summary_status"), "summarized_at": F.when(F.col("_status") == "SUCCESS", now).otherwise(F.col("summarized_at"))
    }
    return rows.select(*[values.get(c, F.col(c)).alias(c) for c in revisions.columns])
