"""Parsed documents, file names, years, kinds and summaries on small cases."""

import datetime

import pytest
from pyspark.sql import functions as F

from docwarp.functions import parsed as ps
from docwarp.functions import paths
from docwarp.functions import text as tx
from docwarp.operators import lifecycle as lc
from docwarp.operators import parse as pr
from docwarp.operators import sinks as sk
from docwarp.operators import summary as sm


def one(spark, value, column):
    return spark.createDataFrame([(value,)], "x string").select(column(F.col("x")).alias("y")).first().y


YEARS = [
    ("report", "[문단]\n작성일: 2025. 11. 26.\n[문단]\n2024 plan", 2025, "FULL_DATE_IN_FRONT_MATTER", "2025. 11. 26", datetime.date(2025, 11, 26)),
    ("report", "2025년 11월 26일 작성", 2025, "FULL_DATE_IN_FRONT_MATTER", "2025년 11월 26일", datetime.date(2025, 11, 26)),
    ("report", "2025.01.05 and 2025.12.20", 2025, "FULL_DATE_IN_FRONT_MATTER", "2025.01.05", None),
    ("report", "2025. 11. 26. again 2025.11.26", 2025, "FULL_DATE_IN_FRONT_MATTER", "2025. 11. 26", datetime.date(2025, 11, 26)),
    ("report 2020", "2024-01-01 2025-01-01", None, "AMBIGUOUS_FULL_DATES", "2024, 2025", None),
    ("report", "2025-02-30 in 2024", None, "AMBIGUOUS_YEARS_IN_FRONT_MATTER", "2024, 2025", None),
    ("report", "2026년도 plan", 2026, "YEAR_IN_FRONT_MATTER", "2026", None),
    ("report 2020", "2025-2026 plan", None, "AMBIGUOUS_YEARS_IN_FRONT_MATTER", "2025, 2026", None),
    ("report_2020", "No. 20260908 of 1202612", 2020, "SINGLE_YEAR_IN_TITLE", "2020", None),
    ("2020-2021 report", None, None, "AMBIGUOUS_MULTIPLE_YEARS", "2020, 2021", None),
    ("report 1899 2101", "", None, "NO_YEAR_IN_RANGE", None, None),
    ("", None, None, "EMPTY_TITLE", None, None),
    ("a 1900", "\n".join(["[문단]\nx"] * 20) + "\n[표]\n2024-01-01", 1900, "SINGLE_YEAR_IN_TITLE", "1900", None),
    ("a", "\n".join(["[문단]\nx"] * 19) + "\n[표]\n2024-01-01", 2024, "FULL_DATE_IN_FRONT_MATTER", "2024-01-01", datetime.date(2024, 1, 1)),
    ("a", "x" * 1997 + " 2024-01-01", None, "NO_YEAR_IN_RANGE", None, None),
]


def test_years(spark):
    rows = spark.createDataFrame([(i, t, x) for i, (t, x, *_) in enumerate(YEARS)], "i int, title string, text string")
    got = rows.select("i", tx.decide_year(F.col("title"), F.col("text")).alias("y"), tx.document_date(F.col("text")).alias("d")).orderBy("i").collect()
    assert [(r.y.year, r.y.reason, r.y.evidence, r.d) for r in got] == [tuple(y[2:]) for y in YEARS]


KINDS = [
    ("사용자 매뉴얼 v2.pdf", "MANUAL", "KEYWORD_MATCH", "사용자매뉴얼"), ("요구사항_정의서 최종보고서.hwp", "REQUIREMENTS", "KEYWORD_MATCH", "요구사항정의서"), ("Final-Report.docx", "REPORT", "KEYWORD_MATCH", "report"),
    ("사용자 매뉴얼", "MANUAL", "KEYWORD_MATCH", "사용자매뉴얼"), ("notes.txt", "OTHER", "NO_KEYWORD_MATCH", None), ("", "OTHER", "EMPTY_FILENAME", None),
    ("...", "OTHER", "EMPTY_FILENAME", None), ("보고서 매뉴얼.hwp", "OTHER", "AMBIGUOUS_MANUAL_REPORT", None), (None, "OTHER", "EMPTY_FILENAME", None), ("rfp.guide.pdf", "MANUAL", "KEYWORD_MATCH", "guide"),
]


def test_kinds(spark):
    import unicodedata

    names = [*KINDS, (unicodedata.normalize("NFD", "사용자매뉴얼.pdf"), "MANUAL", "KEYWORD_MATCH", "사용자매뉴얼")]
    rows = spark.createDataFrame([(i, k[0]) for i, k in enumerate(names)], "id int, name string")
    got = {r.id: (r.kind, r.reason, r.matched) for r in lc.classify_kind(rows).collect()}
    assert got == {i: tuple(k[1:]) for i, k in enumerate(names)}


def test_paths(spark):
    raw = [b"plain/name.hwp", "요구/50%.hwp".encode(), b"\xb0\xe8\xc8\xb9\xbc\xad/a", b"a/%41\xff", b"", None]
    rows = spark.createDataFrame([(i, r) for i, r in enumerate(raw)], "i int, name binary").withColumn("c", paths.to_canonical(F.col("name")))
    got = {r.i: r for r in rows.select("i", "name", "c", paths.from_canonical(F.col("c")).alias("back"), paths.is_canonical(F.col("c")).alias("ok"), paths.display_name(F.col("c")).alias("shown")).collect()}
    assert [got[i].c for i in range(6)] == ["plain/name.hwp", "요구/50%25.hwp", "%B0%E8ȹ%BC%AD/a", "a/%2541%FF", "", None]
    assert all(got[i].back == got[i].name and (got[i].ok or got[i].c is None) for i in range(6))
    assert got[2].shown == "계획서/a" and got[1].shown == "요구/50%.hwp"
    for text, ok in (("50%off", False), ("%2F", False), ("%41", False), ("%b0", False), ("%25", True), ("%80x", True), ("a", True)):
        assert one(spark, text, paths.is_canonical) is ok


def test_failure_reasons_and_sizes(spark):
    from docwarp.operators import profiling as pf

    for message, detail, want in (
        ("bad /srv/a/b.hwp at 17", None, "bad at N"), ("x", "C:\\docs\\a.hwp: 'secret' 12", "N"), ("", "", "UNKNOWN"), (None, None, "UNKNOWN"), ('no "stream 3" found.', None, "no found"), ("/only/a/path", None, "UNKNOWN"),
    ):
        got = spark.createDataFrame([(message, detail)], "m string, d string").select(pf.failure_reason(F.col("m"), F.col("d")).alias("r")).first().r
        assert got == want
    sizes = [0, (1 << 20) - 1, 1 << 20, 5 << 20, 20 << 20, 50 << 20]
    got = spark.createDataFrame([(s,) for s in sizes], "s long").orderBy("s").select(pf.size_bucket(F.col("s")).alias("b")).collect()
    assert [r.b for r in got] == ["< 1 MB", "< 1 MB", "1-5 MB", "5-20 MB", "20-50 MB", "> 50 MB"]


def test_audit_keeps_no_credentials(spark):
    keys = ["kind", *sk.FORBIDDEN]
    row = spark.range(1).select(sk.scrub(F.create_map(*[x for k in keys for x in (F.lit(k), F.lit("v"))])).alias("m")).first().m
    assert row.kept == {"kind": "v"} and row["_redacted"] == sorted(sk.FORBIDDEN)
    assert spark.range(1).select(sk.scrub(F.create_map(F.lit("a"), F.lit("b"))).alias("m")).first().m["_redacted"] is None


PAGE = """<html><head><title>T</title><style>p{}</style></head><body><h1>One  &amp; two</h1><p>First <b>bold</b> text.</p><table><tr><th>a</th><th>b</th></tr><tr><td colspan=2>x<table><tr><td>in</td></tr></table></td></tr></table>
<script>no()</script><h2>Next</h2>Loose text<br>and more</body></html>"""


def test_parse_job_isolates_files(spark):
    def parser(data):
        if data == "boom":
            raise RuntimeError("secret path /x")
        return pr.parse_html(data)

    files = spark.createDataFrame([(1, PAGE), (2, "boom"), (3, None), (4, "<img src=a>"), (5, "<p>" + "x" * 5 + "<img><img><img>")], "id long, data string")
    got = {r.id: r for r in pr.parse(files, parser).collect()}
    assert {i: r.parse_result_code for i, r in got.items()} == {1: "TEXT_EXTRACTED", 2: "PARSE_FAILED", 3: "EMPTY_DOCUMENT", 4: "OCR_REQUIRED", 5: "TEXT_EXTRACTED"}
    assert got[2].error == "RuntimeError" and got[5].warnings == ["POSSIBLE_SCANNED_DOCUMENT"]
    page = got[1]
    assert [(p["index"], p.text, p.section_title) for p in page.paragraphs] == [(0, "T", None), (1, "One & two", "One & two"), (2, "First bold text.", "One & two"), (3, "Next", "Next"), (4, "Loose text", "Next"), (5, "and more", "Next")]
    assert [t.rows for t in page.tables] == [[["in"]], [["a", "b"], ["x"]]] and {t.paragraph_index for t in page.tables} == {2}
    assert page.warnings == ["MERGED_CELLS_PRESENT", "NESTED_TABLE_FLATTENED"]


def test_blocks_and_text_of_a_page(spark):
    docs = ps.composed(pr.parse(spark.createDataFrame([(1, PAGE)], "id long, data string")))
    row = docs.select(ps.normalized_text().alias("t"), ps.blocks().alias("b"), ps.table_verdict().alias("v")).first()
    assert row.t.startswith("[문단]\nT\n[문단]\nOne & two\n[문단]\nFirst bold text.\n[표]\nin\n[표]\na | b\nx\n[문단]\nNext")
    assert [(b.paragraph_index, b.is_table) for b in row.b] == [(0, False), (1, False), (2, False), (2, True), (2, True), (3, False), (4, False), (5, False)]
    assert row.v.verdict == "PASS_WITH_WARNING"


def test_hash_does_not_depend_on_warning_order(spark):
    empty = lambda kind: F.array().cast(kind)
    rows = spark.createDataFrame([(["b", "a"],), (["a", "b"],)], "warnings array<string>").withColumns({
        "paragraphs": empty(ps.PARAGRAPHS), "tables": empty(ps.TABLES), "file_type": F.lit("x"), "parser_name": F.lit("p"), "parser_version": F.lit(None).cast("string"),
    })
    found = {r.j for r in rows.select(ps.canonical_json(F.lit("")).alias("j")).collect()}
    assert len(found) == 1 and '"parser_version":null' in next(iter(found)) and next(iter(found)).startswith('{"file_type":"x","normalized_text":""')


def test_page_blocks(spark):
    text = "One line\r\nand its end.\r\nNext (quoted.)\n\n  \nAfter a gap\n \t \nlast\u3002\nx"
    got = ps.page_blocks(spark.createDataFrame([(1, text)], "id long, text string")).orderBy("block").collect()
    assert [r.text for r in got] == ["One line\nand its end.", "Next (quoted.)", "After a gap", "last\u3002", "x"]


def test_table_chunks_repeat_the_header(spark):
    rows = [(1, 0, "intro words", None, None), (1, 1, "", "h1 h2", ["a b", "c d", "e f", " ".join(["w"] * 9)]), (1, 2, "tail", None, None)]
    got = ps.table_chunks(spark.createDataFrame(rows, "id long, paragraph_index long, text string, header string, rows array<string>"), 6).orderBy("chunk_index").collect()
    assert [(c.kind, c.text) for c in got] == [("TEXT", "intro words"), ("TABLE", "h1 h2\na b\nc d"), ("TABLE", "h1 h2\ne f"), ("ERROR", "h1 h2\n" + " ".join(["w"] * 9)), ("TEXT", "tail")]


def test_pack():
    assert sm._pack([3000, 2900, 100], [1, 1, 1]) == [0, 0, 0]
    assert sm._pack([3000, 3100, 100], [1, 1, 2]) == [0, 1, 1]
    assert sm._pack([2000, 3000, 3000, 500], [1, 2, 2, 3]) == [0, 1, 1, 2]  # a section's first run joins whole or not at all
    assert sm._pack([2000, 3000, 4000], [1, 2, 2]) == [0, 0, 1]
    assert sm._pack([], []) == []


def test_reduction_calls(spark):
    def calls(n):
        total = 0
        while n > 1:
            n = -(-n // 6)
            total += n
        return total

    counts = [0, 1, 2, 6, 7, 36, 37, 200, 1000, 10**6]
    got = spark.createDataFrame([(n,) for n in counts], "n long").select("n", sm.reduction_calls(F.col("n")).alias("c")).collect()
    assert {r.n: r.c for r in got} == {n: calls(n) for n in counts}


@pytest.mark.parametrize(
    ("raw", "want"),
    [
        ('{"answerable": true, "answer": "a", "citation_chunk_ids": ["1", "1"]}', ("a", False, ["1"])), ('{"answerable": true, "answer": "a", "citation_chunk_ids": ["1", "9"]}', (sm.REFUSAL, True, [])),
        ('{"answerable": true, "answer": "a", "citation_chunk_ids": []}', (sm.REFUSAL, True, [])), ('{"answerable": false, "answer": "", "citation_chunk_ids": ["2"]}', (sm.REFUSAL, True, ["2"])),
        ('{"answerable": 1, "answer": "a", "citation_chunk_ids": ["1"]}', (sm.REFUSAL, True, [])), ('{"answerable": true, "answer": "a", "citation_chunk_ids": [1]}', (sm.REFUSAL, True, [])),
        ('{"answerable": true, "answer": "a"}', (sm.REFUSAL, True, [])), ("[]", (sm.REFUSAL, True, [])), ("", (sm.REFUSAL, True, [])), (None, (sm.REFUSAL, True, [])),
        ('{"answerable": true, "answer": "' + "x" * 8001 + '", "citation_chunk_ids": ["1"]}', (sm.REFUSAL, True, [])),
    ],
)
def test_generations(spark, raw, want):
    row = sm.validate(spark.createDataFrame([(raw, ["1", "2"])], "raw string, context array<string>")).first()
    assert (row.answer, row.refused, row.citations) == want
