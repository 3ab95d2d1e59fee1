"""Parsed documents as nested columns: normalised text, canonical JSON, blocks, chunking strategies, structure checks.

A parsed document is a row with ``paragraphs`` (array of index, text, page_number, section_title) and ``tables`` (array of index, rows,
paragraph_index, page_number, declared_rows, declared_columns, merged), ``warnings`` and the parser's name, version and file type.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from docwarp.functions.segments import segments
from docwarp.functions.text import CELL, PARAGRAPH, TABLE, collapse, compose, token_count, token_spans

PARAGRAPHS = "array<struct<index:bigint,text:string,page_number:bigint,section_title:string>>"
TABLES = "array<struct<index:bigint,rows:array<array<string>>,paragraph_index:bigint,page_number:bigint,declared_rows:bigint,declared_columns:bigint,merged:boolean>>"
NORMALIZER_VERSION = "1.0.0"  # fixed value


def composed(docs: DataFrame) -> DataFrame:
    """The documents with all texts in NFC. The columns go through JSON, whose own characters never combine with others."""
    fresh = {c: F.from_json(compose(F.to_json(c)), docs.schema[c].dataType) for c in ("paragraphs", "tables")}
    return docs.withColumns(fresh)


def _table_lines(t: Column) -> Column:
    return F.transform(t["rows"], lambda r: F.array_join(F.transform(r, collapse), CELL))


def _anchored(p: Column) -> Column:
    return F.filter("tables", lambda t: t["paragraph_index"] == p["index"])


def _trailing() -> Column:
    """Tables whose anchor no paragraph has, by anchor, then those without one."""
    lost = F.filter(F.transform("tables", lambda t, i: F.struct(t["paragraph_index"].alias("anchor"), i.alias("i"), t.alias("t"))), lambda x: x["anchor"].isNotNull() & ~F.exists("paragraphs", lambda p: p["index"] == x["anchor"]))
    ordered = F.transform(F.array_sort(F.transform(lost, lambda x: F.struct(x["anchor"].alias("anchor"), x["i"].alias("i")))), lambda k: F.get("tables", k["i"]))
    return F.concat(ordered, F.filter("tables", lambda t: t["paragraph_index"].isNull()))


def normalized_text() -> Column:
    """Flat searchable text of ``composed`` documents: marked paragraphs, each followed by its tables; other tables at the end."""
    render = lambda t: F.concat(F.array(F.lit(TABLE)), _table_lines(t))

    def one(p: Column) -> Column:
        text = collapse(p["text"])
        return F.concat(F.when(text != "", F.array(F.lit(PARAGRAPH), text)).otherwise(F.array().cast("array<string>")), F.flatten(F.transform(_anchored(p), render)))

    return F.array_join(F.concat(F.flatten(F.transform("paragraphs", one)), F.flatten(F.transform(_trailing(), render))), "\n")


def canonical_json(text: Column) -> Column:
    """Compact JSON of a parse result with sorted keys and warnings, nulls kept; where the file lies plays no part."""
    none = lambda c: F.lit(None).cast("string").alias(c)
    paragraph = lambda p: F.struct(
        p["index"].alias("index"), p["page_number"].alias("page_number"), none("paragraph_type"), none("section_index"), p["section_title"].alias("section_title"), none("style_name"), p["text"].alias("text")
    )
    table = lambda t: F.struct(
        t["declared_columns"].alias("declared_column_count"), t["declared_rows"].alias("declared_row_count"), t["merged"].alias("has_merged_cells"), t["index"].alias("index"), t["page_number"].alias("page_number"),
        t["paragraph_index"].alias("paragraph_index"), t["rows"].alias("rows"), none("section_index"),
    )
    fields = F.struct(
        "file_type", text.alias("normalized_text"), F.lit(NORMALIZER_VERSION).alias("normalizer_version"), F.transform("paragraphs", paragraph).alias("paragraphs"), "parser_name", "parser_version",
        F.lit(1).alias("schema"), F.transform("tables", table).alias("tables"), F.array_sort("warnings").alias("warnings"),
    )
    return F.to_json(fields, {"ignoreNullFields": "false"})


def blocks() -> Column:
    """Array of paragraph_index, text, is_table, section_title, page_number: non-blank paragraphs and tables in reading order."""
    block = lambda index, text, table, title, page: F.struct(index.alias("paragraph_index"), text.alias("text"), F.lit(table).alias("is_table"), title.alias("section_title"), page.alias("page_number"))
    rendered = lambda t: F.array_join(_table_lines(t), "\n")

    def one(p: Column) -> Column:
        own = F.array(block(p["index"], collapse(p["text"]), False, p["section_title"], p["page_number"]))
        return F.concat(own, F.transform(_anchored(p), lambda t: block(p["index"], rendered(t), True, p["section_title"], t["page_number"])))

    last = F.coalesce(F.element_at(F.when(F.size("paragraphs") > 0, F.col("paragraphs")), -1)["index"], F.lit(0))
    none, nowhere = F.lit(None).cast("string"), F.lit(None).cast("long")
    rest = F.transform(_trailing(), lambda t: block(F.coalesce(t["paragraph_index"], last), rendered(t), True, none, nowhere))
    return F.filter(F.concat(F.flatten(F.transform("paragraphs", one)), rest), lambda b: F.trim(F.regexp_replace(b["text"], r"\s+", " ")) != "")


def fixed_windows(blocks_: DataFrame, size: int) -> DataFrame:
    """id, chunk_index, text, first, last: windows of ``size`` tokens over a document's blocks (id, paragraph_index, text), joined by empty lines; the anchors of the blocks that they reach."""
    order = Window.partitionBy("id").orderBy("paragraph_index")
    n = F.char_length("text") + 2
    placed = blocks_.withColumn("start", (F.sum(n).over(order) - n).cast("long"))
    whole = blocks_.groupBy("id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("paragraph_index", "text"))), lambda b: b["text"]), "\n\n").alias("text"))
    spans = whole.select("id", F.posexplode(token_spans(F.col("text"), size)).alias("part", "text"))
    upto = Window.partitionBy("id").orderBy("part")
    spans = spans.withColumn("end", F.sum(F.char_length("text")).over(upto).cast("long")).withColumn("start", F.col("end") - F.char_length("text"))
    # the last block that begins at or before a window's start, and before its end
    row = lambda pos, kind, part, index: (F.col("id"), pos.alias("pos"), F.lit(kind).alias("kind"), part.alias("part"), index.alias("index"))
    none = F.lit(None).cast("long")
    events = placed.select(*row(F.col("start"), 1, none, F.col("paragraph_index")))
    events = events.unionByName(spans.select(*row(F.col("start"), 2, F.col("part").cast("long"), none))).unionByName(spans.select(*row(F.col("end"), 0, F.col("part").cast("long"), none)))
    before = Window.partitionBy("id").orderBy("pos", "kind").rowsBetween(Window.unboundedPreceding, 0)
    found = events.withColumn("at", F.last("index", ignorenulls=True).over(before)).where("part IS NOT NULL")
    anchors = found.groupBy("id", "part").agg(F.max(F.when(F.col("kind") == 2, F.col("at"))).alias("first"), F.max(F.when(F.col("kind") == 0, F.col("at"))).alias("last"))
    kept = spans.where(F.trim(F.regexp_replace("text", r"\s+", " ")) != "").join(anchors, ["id", "part"])
    return kept.select("id", (F.row_number().over(upto) - 1).cast("long").alias("chunk_index"), "text", "first", "last")


def table_chunks(blocks_: DataFrame, size: int) -> DataFrame:
    """id, chunk_index, kind, text, first, last of blocks (id, paragraph_index, text, header, rows): prose is packed as paragraphs, and a
    table's rows in order under its header, which every chunk of it repeats. A row that does not fit with the header is an ERROR chunk.
    """
    table = F.col("header").isNotNull()
    n, limit = token_count(F.col("text")), F.lit(size)
    spans = F.when(table, F.col("rows")).when(n > limit, token_spans(F.col("text"), size)).otherwise(F.array("text"))
    cut = ~table & (n > limit)
    rows = blocks_.where(table | (F.trim("text") != "")).select("id", "paragraph_index", table.alias("table"), "header", cut.alias("cut"), F.posexplode(spans).alias("part", "text"))
    rows = rows.withColumn("n", token_count(F.col("text"))).withColumn("head", F.when(F.col("table"), token_count(F.col("header"))).otherwise(0).cast("long"))
    rows = rows.withColumn("wrong", F.col("table") & (F.col("head") + F.col("n") > size))
    lists = rows.groupBy("id").agg(
        F.array_sort(F.collect_list(F.struct("paragraph_index", "part", "table", "cut", "wrong", "n", "head", "header", "text"))).alias("blocks"))
    shut = lambda x: x["cut"] | x["wrong"]
    apart = lambda x, before: (
        shut(x) | shut(before) | (x["table"] != before["table"]) | (x["table"] & (x["paragraph_index"] != before["paragraph_index"])))
    cuts = segments(F.col("blocks"), lambda x: x["n"], lambda x: x["head"], apart, size)
    chunks = lists.select("id", cuts.alias("chunks")).select("id", F.posexplode("chunks").alias("chunk_index", "blocks"))
    of = lambda c: F.transform("blocks", lambda b: b[c])
    top = F.get("blocks", F.lit(0))
    kind = F.when(top["wrong"], "ERROR").when(top["table"], "TABLE").otherwise("TEXT")
    text = F.when(top["table"], F.concat_ws("\n", top["header"], of("text"))).otherwise(F.array_join(of("text"), "\n\n"))
    return chunks.select(
        "id", F.col("chunk_index").cast("long").alias("chunk_index"), kind.alias("kind"), text.alias("text"),
        F.array_min(of("paragraph_index")).alias("first"), F.array_max(of("paragraph_index")).alias("last"))


def structured(docs: DataFrame, layouts: DataFrame) -> DataFrame:
    """id, block, kind, text, problem of (id, heading, text) around its layouts (id, source_text, header, rows): the heading, prose by sentence and line, tables.

    A source text that does not occur exactly once, or overlaps another, gives one row with the ``problem`` instead of the document.
    """
    found = layouts.groupBy("id").agg(F.collect_list(F.struct("source_text", "header", "rows")).alias("layouts"))
    rows = docs.join(found, "id", "left").withColumn("layouts", F.coalesce("layouts", F.array().cast(found.schema["layouts"].dataType)))
    place = lambda x: F.struct(F.instr(F.col("text"), x["source_text"]).alias("at"), F.char_length(x["source_text"]).alias("n"), x.alias("t"))
    times = lambda x: (F.char_length("text") - F.char_length(F.replace(F.col("text"), x["source_text"], F.lit("")))) / F.nullif(F.char_length(x["source_text"]), F.lit(0))
    again = lambda x: F.instr(F.substring(F.col("text"), F.instr(F.col("text"), x["source_text"]) + 1, F.char_length("text")), x["source_text"]) > 0
    rows = rows.withColumn("stray", F.exists("layouts", lambda x: F.coalesce(times(x) != 1, F.lit(True)) | again(x))).withColumn("spots", F.array_sort(F.transform("layouts", place), lambda a, b: a["at"] - b["at"]))
    end = lambda i: F.when(i < 0, 1).otherwise(F.get("spots", i)["at"] + F.get("spots", i)["n"])
    rows = rows.withColumn("overlap", F.exists(F.transform("spots", lambda s, i: s["at"] < end(i - 1)), lambda x: x))
    prose = lambda text: F.transform(F.filter(F.split(F.replace(text, F.lit("다. "), F.lit("다.\n")), "\n", -1), lambda s: collapse(s) != ""), lambda s: F.struct(F.lit("TEXT").alias("kind"), F.trim(s).alias("text")))
    cells = lambda t: F.concat_ws("\n", F.array_join(t["header"], CELL), F.transform(t["rows"], lambda r: F.array_join(r, CELL)))
    middle = F.flatten(F.transform("spots", lambda s, i: F.concat(prose(F.substring(F.col("text"), end(i - 1), s["at"] - end(i - 1))), F.array(F.struct(F.lit("TABLE").alias("kind"), cells(s["t"]).alias("text"))))))
    rest = prose(F.substring(F.col("text"), end(F.size("spots") - 1), F.char_length("text")))
    whole = F.concat(F.array(F.struct(F.lit("TEXT").alias("kind"), F.col("heading").alias("text"))), middle, rest)
    good = rows.where("NOT stray AND NOT overlap").select("id", F.posexplode(whole).alias("block", "b")).select("id", F.col("block").cast("long").alias("block"), "b.kind", "b.text", F.lit(None).cast("string").alias("problem"))
    none = F.lit(None).cast("string")
    bad = rows.where("stray OR overlap").select("id", F.lit(None).cast("long").alias("block"), none.alias("kind"), none.alias("text"), F.when(F.col("stray"), "NO_UNIQUE_MATCH").otherwise("OVERLAP").alias("problem"))
    return good.unionByName(bad)


def page_blocks(pages: DataFrame) -> DataFrame:
    """id, block, text of (id, text): paragraphs of a page's text. An empty line ends one, and so does a line that ends a sentence."""
    lines = F.split(F.regexp_replace("text", "\r\n?", "\n"), "\n[ \t\f\x0b　]*\n", -1)
    rows = pages.select("id", F.posexplode(lines).alias("section", "s")).select("id", "section", F.posexplode(F.split("s", "\n", -1)).alias("line", "t"))
    rows = rows.withColumn("t", F.regexp_replace("t", r"\A[\p{IsWhite_Space}]+|[\p{IsWhite_Space}]+\z", "")).where("t <> ''")
    ends = F.regexp_like("t", F.lit("[.?!。．？！][\"'”’)\\]」』）]*\\z"))
    order = Window.partitionBy("id").orderBy("section", "line")
    fresh = F.lag("section").over(order).isNull() | (F.lag("section").over(order) != F.col("section")) | F.lag("ends").over(order)
    rows = rows.withColumn("ends", ends).withColumn("fresh", fresh.cast("int")).withColumn("block", (F.sum("fresh").over(order) - 1).cast("long"))
    return rows.groupBy("id", "block").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("section", "line", "t"))), lambda x: x["t"]), "\n").alias("text"))


#: Warnings that say a table's grid disagrees with its file, and those that ask for a look. Fixed values.
FAILS = ("TABLE_ROW_COUNT_MISMATCH", "TABLE_COLUMN_COUNT_MISMATCH", "TABLE_CELL_COUNT_MISMATCH", "MERGED_CELL_STRUCTURE_LOSS", "TABLE_CELL_ADDRESS_COLLISION")
WARNS = ("MERGED_CELLS_PRESENT", "NESTED_TABLE_FLATTENED", "TABLE_CELL_ADDRESS_UNREADABLE")


def _columns_of(t: Column) -> Column:
    return F.coalesce(F.array_max(F.transform(t["rows"], F.size)), F.lit(0))


def structure_warnings() -> Column:
    """Sorted codes of the tables whose grid is not what their file declares."""
    rows_off = lambda t: t["declared_rows"].isNotNull() & (F.size(t["rows"]) != t["declared_rows"])
    columns_off = lambda t: t["declared_columns"].isNotNull() & (_columns_of(t) != t["declared_columns"])
    codes = ((rows_off, FAILS[0]), (columns_off, FAILS[1]), (lambda t: t["merged"] & (rows_off(t) | columns_off(t)), FAILS[3]))
    return F.array_sort(F.array_compact(F.array(*[F.when(F.exists("tables", test), code) for test, code in codes])))


def table_verdict() -> Column:
    """struct(verdict, reasons): FAIL, PASS_WITH_WARNING or PASS over a document's warnings and tables, with all reasons, sorted."""
    fails = F.filter("warnings", lambda w: w.isin(*FAILS))
    told = F.filter(F.array_sort(F.array_distinct("warnings")), lambda w: w.isin(*WARNS))
    # a warning counts where no failing one comes before it by name
    told = F.filter(told, lambda w: (F.size(fails) == 0) | (w < F.array_min(fails)))
    off = lambda declared, own: (lambda t: (t[declared] > 0) & (own(t) != t[declared]))
    checks = (
        (off("declared_rows", lambda t: F.size(t["rows"])), "ROW_COUNT_DISAGREES_WITH_FILE"), (off("declared_columns", _columns_of), "COLUMN_COUNT_DISAGREES_WITH_FILE"),
    )
    any_table = lambda check: F.exists("tables", lambda t: F.coalesce(check(t), F.lit(False)))
    wrong = F.array_compact(F.array(*[F.when(any_table(check), code) for check, code in checks]))
    loose = F.when((F.size("paragraphs") > 0) & F.exists("tables", lambda t: t["paragraph_index"].isNull()), F.array(F.lit("TABLE_NOT_ANCHORED_TO_PARAGRAPH"))).otherwise(F.array().cast("array<string>"))
    reasons = F.array_sort(F.array_distinct(F.concat(fails, told, wrong, loose)))
    verdict = F.when(F.size(F.concat(fails, wrong)) > 0, "FAIL").when(F.size(F.concat(told, loose)) > 0, "PASS_WITH_WARNING").otherwise("PASS")
    none = F.size("tables") == 0
    return F.struct(F.when(none, "PASS").otherwise(verdict).alias("verdict"), F.when(none, F.array().cast("array<string>")).otherwise(reasons).alias("reasons"))


def structure_metrics(text: Column) -> Column:
    """struct of a parsed document's counts and anchors."""
    cells = F.aggregate("tables", F.lit(0), lambda n, t: n + F.aggregate(t["rows"], F.lit(0), lambda k, r: k + F.size(r)))
    ordered = F.aggregate("paragraphs", F.lit(0).cast("long"), lambda n, p: F.when((n >= 0) & (p["index"] == n), n + 1).otherwise(F.lit(-1).cast("long"))) >= 0
    return F.struct(
        F.size("paragraphs").cast("long").alias("n_paragraphs"), F.size("tables").cast("long").alias("n_tables"), cells.cast("long").alias("n_cells"), F.char_length(text).cast("long").alias("text_length"),
        F.size(F.filter("paragraphs", lambda p: F.coalesce(p["section_title"], F.lit("")) != "")).cast("long").alias("n_titled"), F.when(ordered, "AVAILABLE").otherwise("NOT_AVAILABLE").alias("anchors"),
    )
