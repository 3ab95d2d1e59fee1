"""Which documents a caller may see. Every ranking starts from ``eligible``; requests come as a table, so one job serves many callers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Tables of at most this many rows are broadcast; larger ones are joined by the shuffle.
BROADCAST_ROWS = 10_000


def small(df: DataFrame) -> DataFrame:
    """``df`` with a broadcast hint if it has been counted to be small."""
    return F.broadcast(df) if df.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else df


READ_PERMISSIONS = ("READ", "WRITE", "ADMIN")


#: Shares that the grants of a principal are dealt to, so that no principal (above all: everybody) meets in one task.
SHARES = 32


def principal_sets(requests: DataFrame, users: DataFrame) -> DataFrame:
    """request_id, caller (who the request may read as: its sorted principals). Requests with equal callers read the same documents.

    Principals are everybody (active accounts only), the user and the user's department.
    """
    known = users.select(F.col("id").alias("user_id"), "department_id", ((F.col("status") == "ACTIVE") & F.col("is_active")).alias("active"))
    rows = requests.select("request_id", "user_id").join(known, "user_id", "left")
    principals = F.array(F.when(F.col("active"), "all"), F.concat(F.lit("u"), F.col("user_id")), F.concat(F.lit("d"), F.col("department_id")))
    return rows.select("request_id", F.array_sort(F.array_compact(principals)).alias("caller"))


def alike(requests: DataFrame, users: DataFrame) -> DataFrame:
    """request_id, like (the least request that may read the same documents, by equal principals)."""
    sets = principal_sets(requests, users)
    return sets.join(sets.groupBy("caller").agg(F.min("request_id").alias("like")), "caller").select("request_id", "like")


def for_all(rows: DataFrame, same: DataFrame) -> DataFrame:
    """``rows`` of one request of each kind for every request of ``same`` (request_id, like)."""
    out = rows.withColumnRenamed("request_id", "like").join(small(same), "like")
    return out.select(*rows.columns)


def readable(requests: DataFrame, users: DataFrame, perms: DataFrame) -> DataFrame:
    """request_id, document_id of every grant that reaches the caller. Default deny; three principals; only public grants ask for an active account.

    Grants and callers meet over one key, the principal, once for each distinct caller; requests then take their caller's documents.
    """
    sets = principal_sets(requests, users)
    principal = F.when(F.col("is_public"), "all").when(F.col("user_id").isNotNull(), F.concat(F.lit("u"), F.col("user_id")))
    principal = F.coalesce(principal, F.concat(F.lit("d"), F.col("department_id")))
    grants = perms.where(F.col("permission").isin(*READ_PERMISSIONS)).select("document_id", principal.alias("principal"))
    grants = grants.where("principal IS NOT NULL").withColumn("share", F.pmod(F.xxhash64("document_id"), F.lit(SHARES)).cast("int"))
    callers = sets.select("caller").distinct().select("caller", F.explode("caller").alias("principal"))
    callers = callers.select("caller", "principal", F.explode(F.sequence(F.lit(0), F.lit(SHARES - 1))).alias("share"))
    reach = grants.join(callers, ["principal", "share"]).select("caller", "document_id", "share").distinct()
    asked = sets.select("request_id", "caller", F.explode(F.sequence(F.lit(0), F.lit(SHARES - 1))).alias("share"))
    return reach.join(asked, ["caller", "share"]).select("request_id", "document_id")


def is_ready() -> Column:
    """READY from a revision's columns; never null because of a null code."""
    return (F.col("parse_status") == "SUCCESS") & (F.coalesce("parse_result_code", F.lit("")) == "TEXT_EXTRACTED") & (F.col("embedding_status") == "SUCCESS")


def current_ready_chunks(docs: DataFrame, revisions: DataFrame, chunks: DataFrame) -> DataFrame:
    """Chunks of current READY revisions of documents that are not deleted."""
    ready = revisions.where(is_ready()).select(F.col("id").alias("revision_id"), F.col("document_id").alias("_doc"))
    live = docs.where("NOT is_deleted").select(F.col("id").alias("_doc"), F.col("current_revision_id").alias("revision_id"))
    return chunks.join(ready.join(live, ["_doc", "revision_id"]).select("revision_id"), "revision_id", "left_semi")


def eligible(requests: DataFrame, users: DataFrame, perms: DataFrame, docs: DataFrame, revisions: DataFrame, departments: DataFrame, where: Column | None = None) -> DataFrame:
    """request_id and the documents the caller may search: readable, not deleted, current revision READY; ``where`` narrows before any join with text."""
    live = docs.where("NOT is_deleted")
    ready = revisions.where(is_ready()).select(F.col("id").alias("current_revision_id"), F.col("document_id").alias("id"), "document_year", "extracted_text")
    names = departments.select(F.col("id").alias("department_id"), F.col("name").alias("department_name"))
    rows = live.join(ready, ["id", "current_revision_id"])
    if where is not None:
        rows = rows.where(where)
    # grants of other documents never meet a request
    grants = perms.join(rows.select(F.col("id").alias("document_id")), "document_id", "left_semi")
    return readable(requests, users, grants).withColumnRenamed("document_id", "id").join(rows, "id").join(names, "department_id", "left")


def ready_texts(docs: DataFrame, revisions: DataFrame) -> DataFrame:
    """id, title, extracted_text of every document that somebody may be able to search: not deleted, its current revision READY."""
    ready = revisions.where(is_ready()).select(F.col("id").alias("current_revision_id"), F.col("document_id").alias("id"), "extracted_text")
    return docs.where("NOT is_deleted").join(ready, ["id", "current_revision_id"]).select("id", "title", "extracted_text")


def in_folder(folder: str) -> Column:
    """Literal subtree test that ends at a separator."""
    return F.startswith(F.col("source_path"), F.lit(folder + "/"))


def top_level() -> Column:
    return F.instr("source_path", "/") == 0


def with_all_tags(rows: DataFrame, doc_tags: DataFrame, tag_ids: list[int]) -> DataFrame:
    """Relational division: documents that have every tag."""
    wanted = sorted(set(tag_ids))
    having = doc_tags.where(F.col("tag_id").isin(wanted)).groupBy("document_id").agg(F.count_distinct("tag_id").alias("n")).where(F.col("n") == len(wanted))
    return rows.join(having.select(F.col("document_id").alias("id")), "id", "left_semi")


def has_newer_revision() -> Column:
    return ~F.col("latest_revision_id").eqNullSafe(F.col("current_revision_id"))


def ordered_tags(docs: DataFrame, doc_tags: DataFrame, tags: DataFrame) -> DataFrame:
    """document_id, tags: array of (name, id) in order; empty without any."""
    named = doc_tags.join(F.broadcast(tags.select(F.col("id").alias("tag_id"), "name")), "tag_id")  # the tag vocabulary is a small dimension
    lists = named.groupBy("document_id").agg(F.sort_array(F.collect_list(F.struct("name", F.col("tag_id").alias("id")))).alias("tags"))
    empty = F.array().cast("array<struct<name:string,id:bigint>>")
    return docs.select(F.col("id").alias("document_id")).join(lists, "document_id", "left").select("document_id", F.coalesce("tags", empty).alias("tags"))


def available_years(found: DataFrame) -> DataFrame:
    return found.where("document_year IS NOT NULL").select("request_id", "document_year").distinct()


def escape_like(text: Column) -> Column:
    for c in ("\\", "%", "_"):
        text = F.replace(text, F.lit(c), F.lit("\\" + c))
    return text


def body_pattern(query: Column) -> Column:
    """LIKE pattern for a literal needle; null (no test) where the query is blank."""
    q = F.trim(query)
    return F.when(F.char_length(q) > 0, F.concat(F.lit("%"), escape_like(q), F.lit("%")))


def check_folder(raw: Column) -> Column:
    """Why a folder path is refused, or null."""
    parts = F.split(raw, "/", -1)
    return (
        F.when(raw.isNull() | (raw == ""), "EMPTY").when(F.startswith(raw, F.lit("/")), "ABSOLUTE").when(F.contains(raw, F.lit("\\")), "BACKSLASH")
        .when(F.exists(parts, lambda p: p == ""), "EMPTY_SEGMENT").when(F.exists(parts, lambda p: p.isin(".", "..")), "DOT_SEGMENT").when(raw != F.trim(raw), "NOT_CANONICAL")
    )


MODES, PAGE_MOST, QUERY_MOST = ("browse", "semantic", "lexical"), 100, 512


def check_requests(log: DataFrame) -> DataFrame:
    """request_id, errors (sorted codes) of a table of requests: mode, query, page, page_size, folder, top_level_only."""
    rules = [
        (F.col("mode").isNotNull() & ~F.lower("mode").isin(*MODES), "MODE"), (F.char_length("query") > QUERY_MOST, "QUERY_TOO_LONG"), (F.col("page") < 1, "PAGE"),
        ((F.col("page_size") < 1) | (F.col("page_size") > PAGE_MOST), "PAGE_SIZE"), (F.col("folder").isNotNull() & F.col("top_level_only"), "FOLDER_AND_TOP_LEVEL"), (F.col("folder").isNotNull() & check_folder(F.col("folder")).isNotNull(), "FOLDER"),
    ]
    return log.select("request_id", F.array_sort(F.array_compact(F.array(*[F.when(rule, code) for rule, code in rules]))).alias("errors"))


def visible(requests: DataFrame, users: DataFrame, perms: DataFrame, docs: DataFrame) -> DataFrame:
    """Documents the caller may look at (READY not asked for), with request_id."""
    return readable(requests, users, perms).withColumnRenamed("document_id", "id").join(docs.where("NOT is_deleted"), "id")
