"""Folder navigation, document details and revision comparison."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from docwarp.operators.eligibility import is_ready, top_level


def folder_tree(found: DataFrame) -> DataFrame:
    """request_id, path, segment, depth, parent, n: every folder above an eligible document, with the documents in its subtree."""
    parts = F.split("source_path", "/")
    deep = found.select("request_id", parts.alias("parts")).where(F.size("parts") > 1)  # sequence(1, 0) would run downwards
    rows = deep.select("request_id", "parts", F.explode(F.sequence(F.lit(1), F.size("parts") - 1)).alias("depth"))
    path = lambda k: F.array_join(F.slice("parts", F.lit(1), k), "/")
    keyed = rows.select("request_id", path(F.col("depth")).alias("path"), F.get("parts", F.col("depth") - 1).alias("segment"), F.col("depth").cast("long").alias("depth"), F.when(F.col("depth") > 1, path(F.col("depth") - 1)).alias("parent"))
    return keyed.groupBy("request_id", "path", "segment", "depth", "parent").agg(F.count("*").alias("n"))


def browsable_count(found: DataFrame) -> DataFrame:
    return found.groupBy("request_id").agg(F.count("*").alias("n"))


def top_level_count(found: DataFrame) -> DataFrame:
    return found.groupBy("request_id").agg(F.count_if(top_level()).alias("n"))


def path_parts(path: Column) -> tuple[Column, Column]:
    """(folder or null, file name)."""
    name = F.substring_index(path, "/", -1)
    folder = F.when(F.contains(path, F.lit("/")), F.substring(path, F.lit(1), F.char_length(path) - F.char_length(name) - 1))
    return folder, name


def detail(seen: DataFrame, revisions: DataFrame, departments: DataFrame, users: DataFrame) -> DataFrame:
    """One row per visible document with its current and latest revision, department and owner."""
    rev = lambda p: revisions.select(F.col("id").alias(f"{p}_revision_id"), F.col("revision_no").alias(f"{p}_no"), is_ready().alias(f"{p}_ready"), F.col("document_year").alias(f"{p}_year"))
    rows = seen.join(rev("current"), "current_revision_id", "left").join(rev("latest"), "latest_revision_id", "left")
    rows = rows.join(departments.select(F.col("id").alias("department_id"), F.col("name").alias("department")), "department_id", "left")
    rows = rows.join(users.select(F.col("id").alias("owner_id"), F.col("status").alias("owner_status")), "owner_id", "left")
    return rows.select(
        "request_id", F.col("id").alias("document_id"), "title", "department", "owner_status", "current_no", "latest_no", F.coalesce("current_year", "latest_year").alias("year"),
        F.coalesce("current_ready", F.lit(False)).alias("is_searchable"), F.col("missing_since").isNull().alias("downloadable"),
    )


def text_preview(chunks: DataFrame, offset: int, limit: int) -> DataFrame:
    """A page of each document's chunks in order, with the total and whether more follow."""
    rank = F.row_number().over(Window.partitionBy("document_id").orderBy("chunk_index"))
    page = chunks.withColumn("rank", rank).where((F.col("rank") > offset) & (F.col("rank") <= offset + limit)).select("document_id", F.col("rank").cast("long").alias("rank"), "chunk_index", "text")
    totals = chunks.groupBy("document_id").agg(F.count("*").alias("total"))
    return totals.join(page, "document_id", "left").withColumn("has_more", F.col("total") > offset + limit)


def revision_history(seen: DataFrame, revisions: DataFrame, offset: int, limit: int) -> DataFrame:
    """A page of each visible document's revisions, newest first."""
    rows = seen.select("request_id", F.col("id").alias("document_id"), "current_revision_id").join(revisions.select(F.col("id").alias("revision_id"), "document_id", "revision_no"), "document_id")
    rank = F.row_number().over(Window.partitionBy("request_id", "document_id").orderBy(F.desc("revision_no")))
    rows = rows.withColumn("rank", rank.cast("long")).where((F.col("rank") > offset) & (F.col("rank") <= offset + limit))
    return rows.select("request_id", "document_id", "revision_no", "rank", F.coalesce(F.col("revision_id") == F.col("current_revision_id"), F.lit(False)).alias("is_current"))


def comparable_pairs(revisions: DataFrame) -> DataFrame:
    """Each revision with the nearest earlier one that has text (an as-of join by number)."""
    before = Window.partitionBy("document_id").orderBy("revision_no").rowsBetween(Window.unboundedPreceding, -1)
    own = F.when(F.col("extracted_text").isNotNull(), F.col("revision_no"))
    return revisions.select("document_id", "revision_no", F.last(own, ignorenulls=True).over(before).alias("base_no"), "extracted_text")


def paragraph_units(text: Column) -> Column:
    """Lines that carry content: trimmed, without blanks, block markers and rows of separators alone."""
    lines = F.transform(F.split(text, "\n"), lambda t: F.trim(t))  # bare F.trim would take a line's place as the characters to trim
    return F.filter(lines, lambda t: (t != "") & ~t.isin("[문단]", "[표]") & ~F.regexp_like(t, F.lit(r"^[\s|]+$")))


def paragraph_diff(pairs: DataFrame, most: int = 200) -> DataFrame:
    """document_id, revision_no, n_added, n_removed, added, removed, truncated for (old, new) texts, by sequence opcodes in Arrow batches."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from difflib import SequenceMatcher

        for batch in batches:
            out = [[], [], [], [], []]
            for old, new in zip(batch.column("old").to_pylist(), batch.column("new").to_pylist(), strict=True):
                added, removed = [], []
                for op, a, b, c, d in SequenceMatcher(None, old or [], new or [], autojunk=False).get_opcodes():
                    if op != "equal":
                        removed += (old or [])[a:b]
                        added += (new or [])[c:d]
                for column, value in zip(out, (len(added), len(removed), added[:most], removed[:most], max(len(added), len(removed)) > most), strict=True):
                    column.append(value)
            types = [pa.int64(), pa.int64(), pa.list_(pa.string()), pa.list_(pa.string()), pa.bool_()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *(pa.array(c, t) for c, t in zip(out, types, strict=True))], ["document_id", "revision_no", "n_added", "n_removed", "added", "removed", "truncated"])

    units = pairs.select("document_id", "revision_no", paragraph_units(F.col("old_text")).alias("old"), paragraph_units(F.col("new_text")).alias("new"))
    return units.mapInArrow(run, "document_id long, revision_no long, n_added long, n_removed long, added array<string>, removed array<string>, truncated boolean")


def vocabulary(rows: DataFrame, offset: int, limit: int) -> DataFrame:
    """A page of a small dimension (name, id) in order, with the total."""
    named = rows.select("name", "id").distinct()
    page = named.orderBy("name", "id").offset(offset).limit(limit)
    rank = F.row_number().over(Window.orderBy("name", "id"))  # at most ``limit`` rows
    return page.withColumn("rank", (rank + offset).cast("long")).crossJoin(F.broadcast(named.agg(F.count("*").alias("total"))))


#: Codes that may be told. Fixed values.
REASONS = ("NO_TEXT", "TOO_LARGE", "PROVIDER_DISABLED")


def summary_state(revisions: DataFrame, jobs: DataFrame, available: bool = True) -> DataFrame:
    """revision_id, state, reason: only SKIPPED has one, the code of the latest SUMMARIZE job that has any, null if it may not be told.

    Where generation is not ``available``, or no job decided, the provider was off.
    """
    order = F.struct(F.col("finished_at").isNotNull(), F.col("finished_at"), "created_at", "id")
    latest = jobs.where("job_type = 'SUMMARIZE' AND result_code IS NOT NULL").groupBy("revision_id").agg(F.max_by("result_code", order).alias("code"))
    rows = revisions.select(F.col("id").alias("revision_id"), F.col("summary_status").alias("state")).join(latest, "revision_id", "left")
    code = F.when(F.col("code").isNull() | F.lit(not available), "PROVIDER_DISABLED").when(F.col("code").isin(*REASONS), F.col("code"))
    return rows.select("revision_id", "state", F.when(F.col("state") == "SKIPPED", code).alias("reason"))


def relocation_state(docs: DataFrame, revisions: DataFrame, jobs: DataFrame) -> DataFrame:
    """document_id, latest_pending, has_active_job, may_move."""
    active = jobs.where("status IN ('PENDING', 'RUNNING')").join(revisions.select(F.col("id").alias("revision_id"), "document_id"), "revision_id").select(F.col("document_id"), F.lit(True).alias("active")).distinct()
    latest = revisions.select(F.col("id").alias("latest_revision_id"), (F.col("embedding_status") == "PENDING").alias("latest_pending"))
    rows = docs.select(F.col("id").alias("document_id"), "latest_revision_id").join(latest, "latest_revision_id", "left").join(active, "document_id", "left")
    busy = F.coalesce("active", F.lit(False))
    pending = F.coalesce("latest_pending", F.lit(False))
    return rows.select("document_id", pending.alias("latest_pending"), busy.alias("has_active_job"), (~busy & ~pending).alias("may_move"))


def grant_missing(docs: DataFrame, perms: DataFrame, who: Column, principal: str, value) -> DataFrame:
    """New READ rows for documents that are not deleted and where the principal has no row yet."""
    have = perms.where(who).select(F.col("document_id").alias("id"))
    new = docs.where("NOT is_deleted").select("id").join(have, "id", "left_anti")
    user = F.lit(value).cast("long") if principal == "user" else F.lit(None).cast("long")
    return new.select(F.col("id").alias("document_id"), user.alias("user_id"), F.lit(None).cast("long").alias("department_id"), F.lit(principal == "public").alias("is_public"), F.lit("READ").alias("permission"))


def revoke_read(perms: DataFrame, user_id: int) -> DataFrame:
    """All rows but that user's READ ones; WRITE and ADMIN stay."""
    return perms.where(~(F.col("user_id").eqNullSafe(F.lit(user_id)) & (F.col("permission") == "READ")))


def principal_violations(perms: DataFrame) -> DataFrame:
    """document_id, rule of rows without exactly one principal, and of repeated public rows."""
    n = F.col("user_id").isNotNull().cast("int") + F.col("department_id").isNotNull().cast("int") + F.col("is_public").cast("int")
    wrong = perms.where(n != 1).select("document_id", F.lit("PRINCIPALS").alias("rule"))
    twice = perms.where("is_public").groupBy("document_id").agg(F.count("*").alias("k")).where("k > 1").select("document_id", F.lit("PUBLIC_TWICE").alias("rule"))
    return wrong.unionByName(twice)
