"""Queries: parsed documents, their text, blocks and checks, and file names."""

from __future__ import annotations

from pyspark.sql import functions as F

from docwarp.functions import parsed as ps
from docwarp.functions import paths
from docwarp.functions import text as tx
from docwarp.operators import parse as pr
from docwarp.plans.registry import query
from docwarp.sources.fixtures import TOKEN, Tables, oracle

#: Parsed documents derived from the documents: a paragraph a line, up to two tables of words, some of them without a known anchor.
_WORD = "string_split(text, ' ')"
PARSED = {
    "p_": """SELECT d, i - 1 AS idx, string_split(text, chr(10))[i] AS text, CASE WHEN d % 4 = 3 THEN (i - 1) // 20 + 1 END AS page, CASE WHEN ((i - 1) // 10) % 2 = 0 THEN 's' || ((i - 1) // 10) END AS title
  FROM base, generate_series(1, len(string_split(text, chr(10)))) AS g(i)""",
    "t_": f"""SELECT d, k AS idx, CASE (d + k) % 5 WHEN 0 THEN NULL WHEN 1 THEN 1000000 - k ELSE (d + k) % 3 END AS anchor, [{_WORD}[1 + k : 2 + k], {_WORD}[3 + k : 4 + k]] AS rows,
  CASE WHEN d % 7 <> 3 THEN 2 + CASE WHEN d % 7 = 0 THEN 1 ELSE 0 END END AS declared_rows, CASE WHEN d % 11 = 0 THEN 3 END AS declared_columns, d % 4 = 1 AS merged FROM base, generate_series(0, 1) AS g(k) WHERE k < d % 3""",
}
_NORM = r"trim(regexp_replace(nfc_normalize({}), '\s+', ' ', 'g'))"


def psql(sql: str, **more: str) -> str:
    return oracle(sql, **PARSED, **more)


def documents(spark, sf):
    d, w = F.col("d"), F.split("text", " ")
    line = lambda x, i: F.struct(
        i.cast("long").alias("index"), x.alias("text"), F.when(F.col("d") % 4 == 3, F.floor(i / 20) + 1).alias("page_number"), F.when(F.floor(i / 10) % 2 == 0, F.concat(F.lit("s"), F.floor(i / 10).cast("string"))).alias("section_title")
    )
    anchor = lambda k: F.when((d + k) % 5 == 0, None).when((d + k) % 5 == 1, F.lit(1000000 - k)).otherwise((d + k) % 3)
    two = lambda k: F.slice(w, k + 1, 2)
    table = lambda k: F.struct(
        F.lit(k).cast("long").alias("index"), F.array(two(k), two(k + 2)).alias("rows"), anchor(k).cast("long").alias("paragraph_index"), F.lit(None).cast("long").alias("page_number"),
        F.when(d % 7 != 3, F.lit(2) + (d % 7 == 0).cast("int")).cast("long").alias("declared_rows"), F.when(d % 11 == 0, 3).cast("long").alias("declared_columns"), (d % 4 == 1).alias("merged"),
    )
    return Tables(spark, sf).base.select(
        "d", "file_type", F.lit("lines").alias("parser_name"), F.lit("1").alias("parser_version"), F.transform(F.split("text", "\n", -1), line).cast(ps.PARAGRAPHS).alias("paragraphs"),
        F.slice(F.array(table(0), table(1)), F.lit(1), (d % 3).cast("int")).cast(ps.TABLES).alias("tables"), F.when(d % 9 == 0, F.array(F.lit("NESTED_TABLE_FLATTENED"), F.lit("MERGED_CELLS_PRESENT"))).when(d % 13 == 0, F.array(F.lit("TABLE_CELL_COUNT_MISMATCH"), F.lit("NESTED_TABLE_FLATTENED"))).otherwise(F.array().cast("array<string>")).alias("warnings"),
    )


_CELLS = "array_to_string([{0} FOR c IN r], ' | ')".format(_NORM.format("c"))
LINES = f"""SELECT d, 0 AS part, idx AS a, -1 AS b, '[문단]' || chr(10) || {_NORM.format('text')} AS line FROM p_ WHERE {_NORM.format('text')} <> ''
  UNION ALL SELECT t.d, CASE WHEN anchor IS NULL THEN 2 WHEN p.idx IS NULL THEN 1 ELSE 0 END, coalesce(anchor, 0), t.idx, '[표]' || chr(10) || array_to_string([{_CELLS} FOR r IN rows], chr(10)) FROM t_ t LEFT JOIN p_ p ON p.d = t.d AND p.idx = t.anchor"""
_TEXT = "SELECT d, string_agg(line, chr(10) ORDER BY part, a, b) AS text FROM lines_ GROUP BY d"


@query("T2_normalized_text", psql("SELECT d, sha256(text) AS digest, length(text) AS n_chars FROM flat_", lines_=LINES, flat_=_TEXT))
def t2(spark, sf):
    rows = ps.composed(documents(spark, sf)).select("d", ps.normalized_text().alias("text"))
    return rows.select("d", F.sha2("text", 256).alias("digest"), F.char_length("text").cast("long").alias("n_chars"))


_JSON = """SELECT b.d, to_json(struct_pack(file_type := file_type, normalized_text := f.text, normalizer_version := '1.0.0', paragraphs := ps, parser_name := 'lines', parser_version := '1', schema := 1, tables := coalesce(ts, []),
  warnings := CASE WHEN b.d % 9 = 0 THEN ['MERGED_CELLS_PRESENT', 'NESTED_TABLE_FLATTENED'] WHEN b.d % 13 = 0 THEN ['NESTED_TABLE_FLATTENED', 'TABLE_CELL_COUNT_MISMATCH'] ELSE CAST([] AS VARCHAR[]) END)) AS js
  FROM base b JOIN flat_ f USING (d) JOIN (SELECT d, list(struct_pack(index := idx, page_number := page, paragraph_type := NULL::VARCHAR, section_index := NULL::VARCHAR, section_title := title, style_name := NULL::VARCHAR, text := text) ORDER BY idx) AS ps FROM p_ GROUP BY d) USING (d)
  LEFT JOIN (SELECT d, list(struct_pack(declared_column_count := declared_columns, declared_row_count := declared_rows, has_merged_cells := merged, index := idx, page_number := NULL::BIGINT, paragraph_index := anchor, rows := rows, section_index := NULL::VARCHAR) ORDER BY idx) AS ts FROM t_ GROUP BY d) USING (d)"""


@query("T3_canonical_hash", psql("SELECT d, sha256(js) AS content_hash, sha256(text) AS text_hash FROM json_ JOIN flat_ USING (d)", lines_=LINES, flat_=_TEXT, json_=_JSON))
def t3(spark, sf):
    docs = documents(spark, sf)
    flat = ps.composed(docs).select("d", ps.normalized_text().alias("flat"))
    rows = docs.join(flat, "d")
    return rows.select("d", F.sha2(ps.canonical_json(F.col("flat")), 256).alias("content_hash"), F.sha2("flat", 256).alias("text_hash"))


BLOCKS = f"""SELECT d, 0 AS part, idx AS a, -1 AS b, idx AS paragraph_index, {_NORM.format('text')} AS text, false AS is_table, title AS section_title, page AS page_number FROM p_
  UNION ALL SELECT t.d, CASE WHEN anchor IS NULL THEN 2 WHEN p.idx IS NULL THEN 1 ELSE 0 END, coalesce(anchor, 0), t.idx, coalesce(anchor, l.last), array_to_string([{_CELLS} FOR r IN rows], chr(10)), true, p.title, NULL
  FROM t_ t LEFT JOIN p_ p ON p.d = t.d AND p.idx = t.anchor JOIN (SELECT d, max(idx) AS last FROM p_ GROUP BY d) l ON l.d = t.d"""


@query("T4_blocks", psql(r"SELECT d, row_number() OVER (PARTITION BY d ORDER BY part, a, b) - 1 AS block, paragraph_index, text, is_table, section_title, page_number FROM blocks_ WHERE regexp_replace(text, '\s+', '', 'g') <> ''", blocks_=BLOCKS))
def t4(spark, sf):
    return ps.composed(documents(spark, sf)).select("d", F.posexplode(ps.blocks()).alias("block", "b")).select("d", F.col("block").cast("long").alias("block"), "b.*")


_LINES = f"SELECT d AS id, idx AS paragraph_index, {_NORM.format('text')} AS text FROM p_ WHERE {_NORM.format('text')} <> ''"
_SPAN = r"(?:(?:[\p{L}\p{N}_]+|[^\p{L}\p{N}_\s])\s*){1,64}"


@query("T8_fixed_windows", psql("""SELECT s.id, row_number() OVER (PARTITION BY s.id ORDER BY part) - 1 AS chunk_index, s.text, min(paragraph_index) AS first, max(paragraph_index) AS last FROM spans_ s JOIN placed_ b ON b.id = s.id AND b.a < s.z AND b.z > s.a GROUP BY s.id, part, s.text""",
    l_=_LINES, whole_="SELECT id, string_agg(text, chr(10) || chr(10) ORDER BY paragraph_index) AS text FROM l_ GROUP BY id",
    placed_="SELECT *, a + length(text) AS z FROM (SELECT *, sum(length(text) + 2) OVER (PARTITION BY id ORDER BY paragraph_index) - length(text) - 2 AS a FROM l_)",
    spans_=f"SELECT id, part, t[part] AS text, sum(length(t[part])) OVER (PARTITION BY id ORDER BY part) AS z, z - length(t[part]) AS a FROM (SELECT id, regexp_extract_all(text, '{_SPAN}') AS t FROM whole_), generate_series(1, len(t)) AS g(part)"))
def t8(spark, sf):
    rows = ps.composed(documents(spark, sf)).select(F.col("d").alias("id"), F.explode("paragraphs").alias("p"))
    return ps.fixed_windows(rows.select("id", F.col("p.index").alias("paragraph_index"), tx.collapse(F.col("p.text")).alias("text")).where("text <> ''"), 64)


# every fourth line is a table whose rows are its sentences under a header
_LAID = f"""SELECT d AS id, idx AS paragraph_index, t AS text, CASE WHEN idx % 4 = 3 THEN 'col a | col b' END AS header, CASE WHEN idx % 4 = 3 THEN list_filter(string_split(t, '. '), lambda x: x <> '') END AS rows
  FROM (SELECT d, idx, {_NORM.format('text')} AS t FROM p_) WHERE t <> ''"""
def _count(text: str) -> str:
    return f"CAST(len(regexp_extract_all({text}, '{TOKEN}')) AS BIGINT)"



_T9 = f"""WITH RECURSIVE kept AS (SELECT id, i, CAST(0 AS BIGINT) AS c, head + n AS used, paragraph_index, tab, cut OR wrong AS shut FROM r_ WHERE i = 1
  UNION ALL SELECT id, i, CASE WHEN fresh THEN c + 1 ELSE c END, CASE WHEN fresh THEN head + n ELSE used + n END, paragraph_index, tab, cut OR wrong FROM (
  SELECT q.*, k.c, k.used, k.shut OR q.cut OR q.wrong OR q.tab <> k.tab OR (q.tab AND q.paragraph_index <> k.paragraph_index) OR k.used + q.n > 64 AS fresh FROM kept k JOIN r_ q ON q.id = k.id AND q.i = k.i + 1))
SELECT q.id, c AS chunk_index, CASE WHEN any_value(wrong) THEN 'ERROR' WHEN any_value(q.tab) THEN 'TABLE' ELSE 'TEXT' END AS kind, CASE WHEN any_value(q.tab) THEN any_value(header) || chr(10) || string_agg(text, chr(10) ORDER BY i) ELSE string_agg(text, chr(10) || chr(10) ORDER BY i) END AS text,
  min(q.paragraph_index) AS first, max(q.paragraph_index) AS last FROM kept k JOIN r_ q USING (id, i) GROUP BY q.id, c"""


@query("T9_table_chunks", psql("WITH " + _T9.removeprefix("WITH RECURSIVE "), laid_=_LAID,
    x_=f"SELECT id, paragraph_index, header, header IS NOT NULL AS tab, header IS NULL AND {_count('text')} > 64 AS cut, CASE WHEN header IS NOT NULL THEN rows WHEN {_count('text')} > 64 THEN regexp_extract_all(text, '{_SPAN}') ELSE [text] END AS ts FROM laid_",
    r_=f"SELECT *, row_number() OVER (PARTITION BY id ORDER BY paragraph_index, part) AS i, head + n > 64 AND tab AS wrong FROM (SELECT id, paragraph_index, header, tab, cut, part, ts[part] AS text, {_count('ts[part]')} AS n, CASE WHEN tab THEN {_count('header')} ELSE 0 END AS head FROM x_, generate_series(1, len(ts)) AS g(part))").replace("WITH ", "WITH RECURSIVE ", 1))
def t9(spark, sf):
    rows = ps.composed(documents(spark, sf)).select(F.col("d").alias("id"), F.explode("paragraphs").alias("p"))
    laid = rows.select("id", F.col("p.index").alias("paragraph_index"), tx.collapse(F.col("p.text")).alias("text")).where("text <> ''")
    table = F.col("paragraph_index") % 4 == 3
    return ps.table_chunks(laid.select("*", F.when(table, "col a | col b").alias("header"), F.when(table, F.filter(F.split("text", r"\. ", -1), lambda x: x != "")).alias("rows")), 64)


@query("T11_structured", oracle(r"""SELECT id, CASE WHEN ok THEN row_number() OVER (PARTITION BY id ORDER BY ord, k) - 1 END AS block, kind, text, problem FROM (
  SELECT id, ok, 0 AS ord, 0 AS k, 'TEXT' AS kind, title AS text, NULL AS problem FROM m_ WHERE ok
  UNION ALL SELECT id, ok, 1, i, 'TEXT', trim(x[i]), NULL FROM (SELECT id, ok, string_split(replace(left(text, spot - 1), '다. ', '다.' || chr(10)), chr(10)) AS x FROM m_ WHERE ok), generate_series(1, len(x)) AS g(i) WHERE regexp_replace(x[i], '\s+', '', 'g') <> ''
  UNION ALL SELECT id, ok, 2, 0, 'TABLE', 'a | b' || chr(10) || 'x | ' || id, NULL FROM m_ WHERE ok AND src IS NOT NULL
  UNION ALL SELECT id, ok, 3, i, 'TEXT', trim(x[i]), NULL FROM (SELECT id, ok, string_split(replace(substr(text, spot + length(coalesce(src, ''))), '다. ', '다.' || chr(10)), chr(10)) AS x FROM m_ WHERE ok AND src IS NOT NULL), generate_series(1, len(x)) AS g(i) WHERE regexp_replace(x[i], '\s+', '', 'g') <> ''
  UNION ALL SELECT id, ok, 0, 0, NULL, NULL, 'NO_UNIQUE_MATCH' FROM m_ WHERE NOT ok)""",
    m_="""SELECT id, title, text, src, CASE WHEN src IS NULL THEN length(text) + 1 ELSE strpos(text, src) END AS spot, src IS NULL OR (contains(text, src) AND NOT contains(substr(text, strpos(text, src) + 1), src)) AS ok FROM (SELECT d AS id, title, text, CASE WHEN d % 2 = 0 THEN CASE WHEN d % 10 = 0 THEN left(text, 1) ELSE substr(text, 11, 30) END END AS src FROM base)"""))
def t11(spark, sf):
    docs = Tables(spark, sf).base.select(F.col("d").alias("id"), F.col("title").alias("heading"), "text")
    source = F.when(F.col("id") % 10 == 0, F.substring("text", 1, 1)).otherwise(F.substring("text", 11, 30))
    rows = F.array(F.array(F.lit("x"), F.col("id").cast("string")))
    return ps.structured(docs, docs.where("id % 2 = 0").select("id", source.alias("source_text"), F.array(F.lit("a"), F.lit("b")).alias("header"), rows.alias("rows")))


_PAGED = "CASE WHEN d % 3 = 0 THEN replace(text, chr(10), chr(10) || ' ' || chr(10)) WHEN d % 3 = 1 THEN replace(text, ' ', chr(13) || chr(10)) ELSE replace(text, '. ', '.' || chr(10)) END"


@query("T12_page_blocks", oracle(r"""SELECT id, block, string_agg(t, chr(10) ORDER BY section, line) AS text FROM (SELECT *, sum(CASE WHEN b_section IS NULL OR b_section <> section OR b_ends THEN 1 ELSE 0 END) OVER (PARTITION BY id ORDER BY section, line) - 1 AS block FROM (
  SELECT *, lag(section) OVER w AS b_section, lag(ends) OVER w AS b_ends FROM l_ WINDOW w AS (PARTITION BY id ORDER BY section, line))) GROUP BY id, block""",
    s_=f"SELECT d AS id, regexp_split_to_array(replace({_PAGED}, chr(13) || chr(10), chr(10)), '\\n[ \\t]*\\n') AS s FROM base",
    l_=r"""SELECT *, regexp_matches(t, '[.?!。．？！]["''”’)\]」』）]*$') AS ends FROM (SELECT id, section, line, trim(x[line], chr(32) || chr(9)) AS t FROM (SELECT id, section, string_split(s[section], chr(10)) AS x FROM s_, generate_series(1, len(s)) AS g(section)), generate_series(1, len(x)) AS h(line)) WHERE t <> ''"""))
def t12(spark, sf):
    d, nl = F.col("d"), F.lit("\n")
    text = F.when(d % 3 == 0, F.replace("text", nl, F.lit("\n \n"))).when(d % 3 == 1, F.replace("text", F.lit(" "), F.lit("\r\n"))).otherwise(F.replace("text", F.lit(". "), F.lit(".\n")))
    return ps.page_blocks(Tables(spark, sf).base.select(d.alias("id"), text.alias("text")))


_NAMED = "SELECT d, CASE d % 4 WHEN 0 THEN source || '/%B0%E8ȹ%BC%AD' || d || '/50%25.hwp' WHEN 1 THEN source || '/%FF%FE/' || lang WHEN 2 THEN source || '/a%252Fb' ELSE source || '/요구' || d END AS canonical, CASE d % 4 WHEN 0 THEN source || '/계획서' || d || '/50%.hwp' WHEN 2 THEN source || '/a%2Fb' WHEN 3 THEN source || '/요구' || d END AS shown, source FROM base"


def names(spark, sf):
    d, utf8 = F.col("d"), lambda *c: F.encode(F.concat(*c), "UTF-8")
    number = d.cast("string")
    name = (
        F.when(d % 4 == 0, F.concat(utf8("source", F.lit("/")), F.unhex(F.lit("B0E8C8B9BCAD")), utf8(number, F.lit("/50%.hwp")))).when(d % 4 == 1, F.concat(utf8("source", F.lit("/")), F.unhex(F.lit("FFFE")), utf8(F.lit("/"), "lang")))
        .when(d % 4 == 2, utf8("source", F.lit("/a%2Fb"))).otherwise(utf8("source", F.lit("/요구"), number))
    )
    return Tables(spark, sf).base.select("d", "source", name.alias("name"))


@query("T18_canonical_path", oracle("SELECT d, canonical, true AS same, true AS ok, d % 2 = 1 AS plain_ok FROM named_", named_=_NAMED))
def t18(spark, sf):
    rows = names(spark, sf).withColumn("canonical", paths.to_canonical(F.col("name")))
    plain = F.when(F.col("d") % 2 == 1, F.concat("source", F.lit("/%80%25"))).when(F.col("d") % 4 == 0, F.lit("50%")).otherwise(F.lit("a%2Fb"))
    return rows.select("d", "canonical", (paths.from_canonical(F.col("canonical")) == F.col("name")).alias("same"), paths.is_canonical(F.col("canonical")).alias("ok"), paths.is_canonical(plain).alias("plain_ok"))


@query("T19_display_name", oracle("SELECT d, CASE WHEN d % 4 = 1 THEN source || '/%FF%FE/' || lang ELSE shown END AS shown FROM named_ JOIN (SELECT d, lang FROM base) USING (d)", named_=_NAMED))
def t19(spark, sf):
    return names(spark, sf).select("d", paths.display_name(paths.to_canonical(F.col("name"))).alias("shown"))


_OFF = "SELECT d, bool_or(declared_rows <> 2) AS r, bool_or(declared_columns <> greatest(len(rows[1]), len(rows[2]))) AS c, bool_or(merged AND (coalesce(declared_rows <> 2, false) OR coalesce(declared_columns <> greatest(len(rows[1]), len(rows[2])), false))) AS m, bool_or(anchor IS NULL) AS loose FROM t_ GROUP BY d"


@query("T22_table_warnings", psql("SELECT base.d, concat_ws(',', CASE WHEN m THEN 'MERGED_CELL_STRUCTURE_LOSS' END, CASE WHEN c THEN 'TABLE_COLUMN_COUNT_MISMATCH' END, CASE WHEN r THEN 'TABLE_ROW_COUNT_MISMATCH' END) AS warnings FROM base LEFT JOIN off_ ON off_.d = base.d", off_=_OFF))
def t22(spark, sf):
    return documents(spark, sf).select("d", F.array_join(ps.structure_warnings(), ",").alias("warnings"))


@query("C3_table_verdict", psql("""SELECT b.d, CASE WHEN o.d IS NULL THEN 'PASS' WHEN b.d % 9 <> 0 AND b.d % 13 = 0 OR coalesce(r, false) OR coalesce(c, false) THEN 'FAIL' WHEN b.d % 9 = 0 OR loose THEN 'PASS_WITH_WARNING' ELSE 'PASS' END AS verdict,
  CASE WHEN o.d IS NULL THEN '' ELSE concat_ws(',', CASE WHEN c THEN 'COLUMN_COUNT_DISAGREES_WITH_FILE' END, CASE WHEN b.d % 9 = 0 THEN 'MERGED_CELLS_PRESENT' END, CASE WHEN b.d % 9 = 0 OR b.d % 13 = 0 THEN 'NESTED_TABLE_FLATTENED' END, CASE WHEN r THEN 'ROW_COUNT_DISAGREES_WITH_FILE' END,
  CASE WHEN b.d % 9 <> 0 AND b.d % 13 = 0 THEN 'TABLE_CELL_COUNT_MISMATCH' END, CASE WHEN loose THEN 'TABLE_NOT_ANCHORED_TO_PARAGRAPH' END) END AS reasons FROM base b LEFT JOIN off_ o ON o.d = b.d""", off_=_OFF))
def c3(spark, sf):
    rows = documents(spark, sf).select("d", ps.table_verdict().alias("v"))
    return rows.select("d", "v.verdict", F.array_join("v.reasons", ",").alias("reasons"))


@query("C18_structure_metrics", psql("""SELECT b.d, n AS n_paragraphs, coalesce(k, 0) AS n_tables, coalesce(cells, 0) AS n_cells, length(f.text) AS text_length, titled AS n_titled, 'AVAILABLE' AS anchors FROM base b JOIN flat_ f USING (d) JOIN (SELECT d, count(*) AS n, count(title) AS titled FROM p_ GROUP BY d) USING (d)
  LEFT JOIN (SELECT d, count(*) AS k, CAST(sum(len(rows[1]) + len(rows[2])) AS BIGINT) AS cells FROM t_ GROUP BY d) USING (d)""", lines_=LINES, flat_=_TEXT))
def c18(spark, sf):
    rows = ps.composed(documents(spark, sf)).withColumn("flat", ps.normalized_text())
    return rows.select("d", ps.structure_metrics(F.col("flat")).alias("m")).select("d", "m.*")


def pages(spark, sf):
    return Tables(spark, sf).raw("pages").select(F.col("page_id").alias("id"), F.col("html").alias("data"))


@query("T25_parse_job")
def t25(spark, sf):
    """Pages as parsed documents, with their text, blocks and checks."""
    docs = ps.composed(pr.parse(pages(spark, sf)))
    rows = docs.withColumn("flat", ps.normalized_text()).withColumn("m", ps.structure_metrics(F.col("flat"))).withColumn("v", ps.table_verdict())
    code = F.col("parse_result_code")
    return rows.select(
        "id", code, tx.parse_status(code).alias("parse_status"), tx.downstream_status(code).alias("embedding_status"), F.array_join("warnings", ",").alias("warnings"), F.size(ps.blocks()).cast("long").alias("n_blocks"),
        "m.*", F.sha2("flat", 256).alias("text_hash"), F.sha2(ps.canonical_json(F.col("flat")), 256).alias("content_hash"), "v.verdict",
    )
