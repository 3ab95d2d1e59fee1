"""Text functions: normalisation, tokens and spans, front matter, years and dates, canonical paths, folds for chunking and summaries."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import pandas_udf
from pyspark.sql.window import Window

from docwarp.functions.segments import segments

TOKEN = r"[\p{L}\p{N}_]+|[^\p{L}\p{N}_\s]"


@pandas_udf(T.StringType())
def _nfc(text: pd.Series) -> pd.Series:
    return text.map(lambda t: None if t is None else unicodedata.normalize("NFC", t))


def compose(text: Column) -> Column:
    """NFC; only texts with other than ASCII go through Python."""
    odd = F.regexp_like(text, F.lit(r"[^\x00-\x7F]"))
    return F.when(odd, _nfc(F.when(odd, text))).otherwise(text)


def collapse(text: Column) -> Column:
    """Odd spaces folded, white space collapsed, trimmed."""
    return F.trim(F.regexp_replace(F.translate(text, "\ufeff", " "), r"[\p{IsWhite_Space}\x1c-\x1f]+", " "))


def normalize(text: Column) -> Column:
    """NFC, odd spaces folded, white space collapsed, trimmed; case stays."""
    return collapse(compose(text))


def token_count(text: Column) -> Column:
    return F.regexp_count(text, F.lit(TOKEN)).cast("long")


def token_spans(text: Column, limit: int) -> Column:
    """Pieces of at most ``limit`` tokens, with the white space after each token."""
    return F.regexp_extract_all(text, F.lit(rf"(?:(?:[\p{{L}}\p{{N}}_]++|[^\p{{L}}\p{{N}}_\s])\s*+){{1,{limit}}}"), F.lit(0))


def chunk_documents(blocks: DataFrame, limit: int) -> DataFrame:
    """Greedy paragraph-aware chunks of blocks (revision_id, index, text, page, maybe section_title): revision_id, chunk_index, text,
    paragraph_start, paragraph_end, token_count, section_title and page_number (the first ones that are not null).

    Blocks are joined by an empty line while their tokens fit; a new page begins a chunk; a block over the limit is cut into spans that
    keep its anchor. Blank blocks are left out. A revision's blocks meet in one row; next-pointers over running token sums find its chunks.
    """
    title = F.col("section_title") if "section_title" in blocks.columns else F.lit(None).cast("string")
    rows = blocks.where(F.trim("text") != "").select("revision_id", "index", "text", "page", title.alias("section_title"), token_count(F.col("text")).alias("n"))
    cut = F.col("n") > limit
    # spans of an oversize block become blocks of their own that nothing may join
    spans = F.when(cut, F.transform(token_spans(F.col("text"), limit), lambda s: F.rtrim(s))).otherwise(F.array("text"))
    pieces = rows.select("revision_id", "index", "page", "section_title", cut.alias("cut"), "n", F.posexplode(spans).alias("part", "text"))
    pieces = pieces.withColumn("n", F.when(F.col("cut"), token_count(F.col("text"))).otherwise(F.col("n")))
    lists = pieces.groupBy("revision_id").agg(
        F.array_sort(F.collect_list(F.struct("index", "part", "page", "section_title", "cut", "n", "text"))).alias("blocks"))
    apart = lambda x, before: x["cut"] | before["cut"] | ~x["page"].eqNullSafe(before["page"])
    cuts = segments(F.col("blocks"), lambda x: x["n"], lambda x: F.lit(0), apart, limit)
    chunks = lists.select("revision_id", cuts.alias("chunks")).select("revision_id", F.posexplode("chunks").alias("chunk_index", "blocks"))
    of = lambda c: F.transform("blocks", lambda b: b[c])
    first = lambda c: F.get(F.array_compact(of(c)), F.lit(0))
    return chunks.select(
        "revision_id", F.col("chunk_index").cast("long").alias("chunk_index"), F.array_join(of("text"), "\n\n").alias("text"),
        F.array_min(of("index")).alias("paragraph_start"), F.array_max(of("index")).alias("paragraph_end"),
        F.aggregate(of("n"), F.lit(0).cast("long"), lambda a, n: a + n).alias("token_count"),
        first("section_title").alias("section_title"), first("page").alias("page_number"),
    )


def sentence_chunks(docs: DataFrame) -> DataFrame:
    """document_id, chunk_index, text: the title, then the sentences."""
    parts = F.filter(F.transform(F.split("text", r"(?<=[.!?])\s+"), lambda s: F.trim(s)), lambda s: s != "")
    return docs.select("document_id", F.posexplode(F.concat(F.array("title"), parts)).alias("chunk_index", "text")).withColumn("chunk_index", F.col("chunk_index").cast("long"))


#: Markers of the blocks of a document's normalised text. Fixed values.
PARAGRAPH, TABLE, CELL = "[문단]", "[표]", " | "


def front_matter(text: Column, blocks: int = 20, most: int = 2000) -> Column:
    """The text before its 21st block marker, at most 2000 characters."""
    head = F.substring(text, 1, most + 8)  # a marker that begins within ``most`` is whole here
    parts = F.split(head, r"(?<![^\n])(?=\[(?:문단|표)\](?:\n|\z))", -1)
    marked = F.regexp_like(F.get(parts, F.lit(0)), F.lit(r"\A\[(?:문단|표)\](?:\n|\z)"))
    return F.substring(F.array_join(F.slice(parts, F.lit(1), F.lit(blocks + 1) - marked.cast("int")), ""), 1, most)


#: Forms of a date with year, month and day. Fixed values.
_DATE = (
    r"(?<![0-9])[0-9]{4}\p{IsWhite_Space}*[.\-/]\p{IsWhite_Space}*[0-9]{1,2}\p{IsWhite_Space}*[.\-/]\p{IsWhite_Space}*[0-9]{1,2}(?![0-9])"
    r"|(?<![0-9])[0-9]{4}\p{IsWhite_Space}*년\p{IsWhite_Space}*[0-9]{1,2}\p{IsWhite_Space}*월\p{IsWhite_Space}*[0-9]{1,2}\p{IsWhite_Space}*일"
)
LEAST_YEAR, MOST_YEAR = 1900, 2100


def full_dates(text: Column) -> Column:
    """Array of struct(date, evidence): all valid dates written with year, month and day, 1900 to 2100, in order."""
    found = F.regexp_extract_all(text, F.lit(_DATE), F.lit(0))

    def read(m: Column) -> Column:
        numbers = F.regexp_extract_all(m, F.lit("[0-9]+"), F.lit(0))
        return F.struct(F.try_to_date(F.array_join(numbers, "-"), "yyyy-M-d").alias("date"), F.trim(F.regexp_replace(m, r"\p{IsWhite_Space}+", " ")).alias("evidence"))

    return F.filter(F.transform(found, read), lambda x: x["date"].isNotNull() & F.year(x["date"]).between(LEAST_YEAR, MOST_YEAR))


def bare_years(text: Column) -> Column:
    """Four-digit numbers from 1900 to 2100 that stand alone, in order."""
    numbers = F.regexp_extract_all(text, F.lit("(?<![0-9])[0-9]{4}(?![0-9])"), F.lit(0))
    return F.filter(F.transform(numbers, lambda n: n.cast("int")), lambda y: y.between(LEAST_YEAR, MOST_YEAR))


def decide_year(title: Column, text: Column) -> Column:
    """struct(year, reason, evidence): of the text's front matter the one year of its full dates, else its one bare year; else the file name's.

    Several years at one step stop the chain. Evidence is what was read, or the years that compete.
    """
    front = front_matter(F.coalesce(text, F.lit("")))
    dates, bare, named = full_dates(front), bare_years(front), bare_years(F.coalesce(title, F.lit("")))

    def step(years: Column, evidence: Column, found: str, several: str, other: Column) -> Column:
        distinct = F.array_sort(F.array_distinct(years))
        one = F.struct(F.get(distinct, F.lit(0)).alias("year"), F.lit(found).alias("reason"), evidence.alias("evidence"))
        many = F.struct(F.lit(None).cast("int").alias("year"), F.lit(several).alias("reason"), F.array_join(F.transform(distinct, lambda y: y.cast("string")), ", ").alias("evidence"))
        return F.when(F.size(distinct) == 1, one).when(F.size(distinct) > 1, many).otherwise(other)

    none = F.struct(
        F.lit(None).cast("int").alias("year"), F.when(F.coalesce(title, F.lit("")) == "", "EMPTY_TITLE").otherwise("NO_YEAR_IN_RANGE").alias("reason"), F.lit(None).cast("string").alias("evidence")
    )
    first = lambda years: F.get(years, F.lit(0)).cast("string")
    by_name = step(named, first(named), "SINGLE_YEAR_IN_TITLE", "AMBIGUOUS_MULTIPLE_YEARS", none)
    by_year = step(bare, first(bare), "YEAR_IN_FRONT_MATTER", "AMBIGUOUS_YEARS_IN_FRONT_MATTER", by_name)
    return step(F.transform(dates, lambda x: F.year(x["date"])), F.get(dates, F.lit(0))["evidence"], "FULL_DATE_IN_FRONT_MATTER", "AMBIGUOUS_FULL_DATES", by_year)


def document_date(text: Column) -> Column:
    """The one date that the front matter states, else null; a file name never gives one."""
    days = F.array_distinct(F.transform(full_dates(front_matter(F.coalesce(text, F.lit("")))), lambda x: x["date"]))
    return F.when(F.size(days) == 1, F.get(days, F.lit(0)))


def carry_headings(paragraphs: DataFrame) -> DataFrame:
    """Each paragraph with the title of the last heading up to it."""
    heading = (F.char_length(F.trim("text")) > 0) & (F.char_length("text") < 40) & ~F.endswith("text", F.lit("."))
    upto = Window.partitionBy("revision_id").orderBy("index").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return paragraphs.withColumn("section_title", F.last(F.when(heading, F.trim("text")), ignorenulls=True).over(upto))


def cell_grid(cells: DataFrame) -> DataFrame:
    """table_id, row, column, text for every place of each table's extent; several cells of a place are joined by a newline."""
    extents = cells.groupBy("table_id").agg(F.max(F.col("row") + F.col("row_span")).alias("rows"), F.max(F.col("column") + F.col("column_span")).alias("columns"))
    places = extents.select("table_id", F.explode(F.sequence(F.lit(0).cast("long"), F.col("rows") - 1)).alias("row"), "columns").select("table_id", "row", F.explode(F.sequence(F.lit(0).cast("long"), F.col("columns") - 1)).alias("column"))
    texts = cells.groupBy("table_id", "row", "column").agg(F.array_join(F.array_sort(F.collect_list("text")), "\n").alias("text"))
    return places.join(texts, ["table_id", "row", "column"], "left").select("table_id", "row", "column", F.coalesce("text", F.lit("")).alias("text"))


def classify_empty(text: Column, images: Column, least: int = 1, few: int = 200, many: int = 3) -> Column:
    """struct(code, warnings) by a document's text without outer white space and its number of images."""
    n = F.char_length(F.regexp_replace(F.coalesce(text, F.lit("")), r"\A\p{IsWhite_Space}+|\p{IsWhite_Space}+\z", ""))
    code = F.when(n >= least, "TEXT_EXTRACTED").when(images > 0, "OCR_REQUIRED").otherwise("EMPTY_DOCUMENT")
    suspect = (n >= least) & (n < few) & (images >= many)
    return F.struct(code.alias("code"), F.when(suspect, F.array(F.lit("POSSIBLE_SCANNED_DOCUMENT"))).otherwise(F.array().cast("array<string>")).alias("warnings"))


#: Result codes that a parser reached on purpose. Fixed values.
DETERMINED = ("TEXT_EXTRACTED", "EMPTY_DOCUMENT", "OCR_REQUIRED", "ENCRYPTED", "CORRUPT", "UNSUPPORTED_FORMAT")


def parse_status(code: Column) -> Column:
    return F.when(code.isNull(), "PENDING").when(code.isin(*DETERMINED), "SUCCESS").otherwise("FAILED")


def downstream_status(code: Column) -> Column:
    """The embedding status that a parse outcome leads to."""
    return F.when(code.isNull() | (code == "TEXT_EXTRACTED"), "PENDING").otherwise("SKIPPED")


def vector_problem(vector: Column, size: int) -> Column:
    """Why a vector is refused, or null."""
    norm = F.sqrt(F.aggregate(vector, F.lit(0.0), lambda s, v: s + v.cast("double") * v.cast("double")))
    return F.when(vector.isNull(), "MISSING").when(F.size(vector) != size, "DIMENSION").when(F.exists(vector, lambda v: F.isnan(v) | (F.abs(v) == float("inf"))), "NOT_FINITE").when(F.abs(norm - 1) > 1e-3, "NOT_UNIT")


def section_islands(chunks: DataFrame) -> DataFrame:
    """Chunks with the number of their run of equal section titles (null equals null)."""
    order = Window.partitionBy("revision_id").orderBy("chunk_index")
    new = ~F.col("section_title").eqNullSafe(F.lag("section_title").over(order)) | F.lag("chunk_index").over(order).isNull()
    return chunks.withColumn("island", F.sum(new.cast("long")).over(order))


def split_oversize(texts: DataFrame, most: int = 5800) -> DataFrame:
    """id, part, text: pieces of at most ``most`` characters, numbered from 1."""
    n = F.greatest(F.lit(1), F.ceil(F.char_length("text") / most).cast("int"))
    return texts.select("id", F.explode(F.sequence(F.lit(1), n)).alias("part"), "text").select("id", F.col("part").cast("long").alias("part"), F.substring(F.col("text"), (F.col("part") - 1) * most + 1, F.lit(most)).alias("text"))


def json_length(*fields: Column) -> Column:
    """Characters of a flat JSON object with a blank after each colon and comma, null fields included and other than ASCII as it is."""
    return F.char_length(F.to_json(F.struct(*fields), {"ignoreNullFields": "false"})) + 2 * len(fields) - 1


#: Formats whose chunks are anchored by paragraph, and those anchored by page. Fixed values.
BY_PARAGRAPH, BY_PAGE = ("hwp", "hwpx", "docx"), ("pdf",)


def evidence_length() -> Column:
    """Characters of a chunk's JSON item: its ids as strings, title, file type, section, anchor and text."""
    kind = lambda name: F.lit(name).alias("type")
    paragraph = json_length(kind("paragraph"), F.col("paragraph_start").alias("paragraph_index"), F.col("paragraph_end").alias("paragraph_end"))
    page = json_length(kind("page"), F.col("page_number"))
    anchor = F.when(F.col("file_type").isin(*BY_PARAGRAPH) & F.col("paragraph_start").isNotNull(), paragraph).when(
        F.col("file_type").isin(*BY_PAGE) & (F.col("page_number") >= 1), page).otherwise(json_length(kind("none")))
    ids = [F.col(c).cast("string").alias(c) for c in ("document_id", "revision_id", "chunk_id")]
    rest = json_length(*ids, *map(F.col, ("title", "file_type", "section_title", "text")))
    return (rest + len(', "anchor": ') + anchor).cast("long")


def assemble_context(chunks: DataFrame, most: int, budget: int) -> DataFrame:
    """request_id, ids of the chunks kept in order, and used: the length of the JSON array of their items, which may not go over ``budget``.

    ``chunks`` has request_id, position, document_id, revision_id, chunk_id, title, file_type, section_title, paragraph_start,
    paragraph_end, page_number and text. Blank texts and repeats are skipped; a chunk that does not fit is skipped and later ones are
    still tried. An empty array has two characters. Only lengths are gathered by request.
    """
    solid = F.coalesce(F.regexp_like("text", F.lit(r"[^\p{IsWhite_Space}\x1c-\x1f]")), F.lit(False))
    rows = chunks.select("request_id", F.struct("position", "chunk_id", evidence_length().alias("n"), solid.alias("solid")).alias("c"))
    lists = rows.groupBy("request_id").agg(F.array_sort(F.collect_list("c")).alias("c"))
    zero = F.struct(F.array().cast("array<bigint>").alias("ids"), F.lit(2).cast("long").alias("used"))

    def step(acc: Column, c: Column) -> Column:
        used = acc["used"] + c["n"] + F.when(F.size(acc["ids"]) > 0, 2).otherwise(0)
        fits = c["solid"] & ~F.array_contains(acc["ids"], c["chunk_id"]) & (F.size(acc["ids"]) < most) & (used <= budget)
        return F.when(fits, F.struct(F.concat(acc["ids"], F.array(c["chunk_id"])).alias("ids"), used.alias("used"))).otherwise(acc)

    folded = lists.select("request_id", F.aggregate("c", zero, step).alias("f"))
    return folded.select("request_id", "f.ids", F.col("f.used").alias("used"))


def anchors_complete(indexes: Column) -> Column:
    """Whether paragraph indexes (in order) count from 0 without gaps; true where there are none."""
    n = F.size(indexes)
    return (n == 0) | (indexes == F.sequence(F.lit(0).cast("long"), F.greatest(n, F.lit(1)).cast("long") - 1))


def refine_year(discovered: Column, has_text: Column, decided: Column) -> Column:
    """The year found in the text, null included, where there is text; else the year from the file name."""
    return F.when(has_text, decided).otherwise(discovered)


def save_vectors(chunks: DataFrame, fresh: DataFrame, touched: DataFrame) -> DataFrame:
    """Chunks (id, revision_id, vec_id, ...) once all vectors of the ``touched`` revisions are replaced by ``fresh`` (id, vec_id); chunks without a new one lose theirs."""
    marks = touched.select("revision_id").distinct().withColumn("_touched", F.lit(True))
    rows = chunks.join(marks, "revision_id", "left").join(fresh.select("id", F.col("vec_id").alias("_fresh")), "id", "left")
    return rows.withColumn("vec_id", F.when(F.col("_touched"), F.col("_fresh")).otherwise(F.col("vec_id"))).drop("_touched", "_fresh")


def citation_labels(context: DataFrame, cited: DataFrame) -> DataFrame:
    """request_id, chunk_id, retrieval_rank (its place in the context, from 1), source_label for the cited chunks of each context (request_id, position, chunk_id)."""
    ranked = context.withColumn("retrieval_rank", F.row_number().over(Window.partitionBy("request_id").orderBy("position")).cast("long"))
    rows = ranked.join(cited.select("request_id", "chunk_id").distinct(), ["request_id", "chunk_id"], "left_semi")
    number = F.row_number().over(Window.partitionBy("request_id").orderBy("retrieval_rank"))
    return rows.select("request_id", "chunk_id", "retrieval_rank", F.concat(F.lit("SOURCE "), number.cast("string")).alias("source_label"))


def scoped_sessions(requests: DataFrame, visible: DataFrame) -> DataFrame:
    """Session requests (session_id, document_id) with ``created``: those without a scope, or whose document their user may see (``visible``: session_id, document_id)."""
    seen = visible.select("session_id", "document_id").distinct().withColumn("_seen", F.lit(True))
    rows = requests.join(seen, ["session_id", "document_id"], "left")
    return rows.withColumn("created", F.col("document_id").isNull() | F.coalesce("_seen", F.lit(False))).drop("_seen")


def transcript(messages: DataFrame, sources: DataFrame, visible: DataFrame) -> DataFrame:
    """Messages (session_id, id, turn, role, content) with ``sources`` (their labels by rank, nulls last) and content hidden where a cited document may not be seen.

    ``sources``: message_id, document_id, retrieval_rank, source_label; ``visible``: session_id, document_id.
    """
    seen = visible.select("session_id", "document_id").distinct().withColumn("_seen", F.lit(True))
    cited = sources.join(messages.select(F.col("id").alias("message_id"), "session_id"), "message_id").join(seen, ["session_id", "document_id"], "left")
    lists = cited.groupBy(F.col("message_id").alias("id")).agg(
        F.array_sort(F.collect_list(F.struct(F.col("retrieval_rank").isNull().alias("last"), "retrieval_rank", "source_label"))).alias("_all"), F.bool_or(F.col("_seen").isNull()).alias("_hidden")
    )
    rows = messages.join(lists, "id", "left")
    content = F.when((F.col("role") == "assistant") & F.coalesce("_hidden", F.lit(False)), None).otherwise(F.col("content"))
    return rows.select("session_id", "id", "turn", "role", content.alias("content"), F.coalesce(F.transform("_all", lambda s: s["source_label"]), F.array().cast("array<string>")).alias("sources"))
