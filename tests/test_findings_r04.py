"""Findings of round 4: each of these failed before its change."""

import zlib

import pandas as pd
from pyspark.sql import functions as F

import corpus_pipeline
from docwarp.functions import text as tx
from docwarp.operators import navigate as nv
from docwarp.operators import ranking as rk
from docwarp.operators.textindex import TextIndex
from docwarp.plans import catalog
from docwarp.plans import text as plans
from docwarp.plans.ranking import Asked
from docwarp.sources.fixtures import Tables
from docwarp.streaming.timers import Expiry


def test_a_line_keeps_the_digits_of_its_place(spark):
    """Lines and sentences lose blanks only, whatever their place."""
    lines = ["0 zero 0", " 1 one 1 ", "22 two 2", "  ", "4 four 44"]
    rows = spark.createDataFrame([("\n".join(lines),)], "text string")
    assert rows.select(nv.paragraph_units(F.col("text"))).first()[0] == ["0 zero 0", "1 one 1", "22 two 2", "4 four 44"]
    docs = spark.createDataFrame([(7, "title", "0 is 0. 1 is 1. 2 and 22! 3 or 3 ")], "document_id long, title string, text string")
    found = sorted((r.chunk_index, r.text) for r in tx.sentence_chunks(docs).collect())
    assert found == [(0, "title"), (1, "0 is 0."), (2, "1 is 1."), (3, "2 and 22!"), (4, "3 or 3")]


def test_pairs_are_never_broadcast(spark, sf):
    """Tables of request and document pairs are tiny as files and large as rows; joins with them shuffle."""
    asked = Asked(spark, sf)
    wanted = spark.range(1_000_000).select(F.col("id").alias("request_id"), F.col("id").alias("document_id"))
    for pairs in (asked.found.select("request_id", F.col("id").alias("document_id")), asked.parts.select("request_id", "document_id")):
        plan = wanted.join(pairs, ["request_id", "document_id"])._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin" in plan and "BroadcastHashJoin" not in plan


def _base(spark, texts):
    rows = [(i, t, "en", "web") for i, t in texts]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")


def test_text_files_are_no_containers(spark, tmp_path):
    """As in S4's SQL, whatever the text is."""
    _base(spark, [(3, ""), (7, "PK\x03\x04"), (11, "a"), (15, None), (0, ""), (1, ""), (2, "x")]).write.parquet(f"{tmp_path}/documents.parquet")
    found = {r.id: r.container for r in catalog.queries()["S4_container"](spark, str(tmp_path)).collect()}
    assert found == {3: "UNKNOWN", 7: "UNKNOWN", 11: "UNKNOWN", 15: "UNKNOWN", 0: "OLE", 1: "ZIP", 2: "EMPTY"}


def test_embedding_of_odd_texts(spark, duck, tmp_path):
    """Null texts, letters that lower in two ways and empty texts are as in E1's SQL."""
    _base(spark, [(1, None), (2, ""), (3, "ΟΔΟΣ ΑΣ"), (4, "İstanbul x"), (5, "a_b 12")]).write.parquet(f"{tmp_path}/documents.parquet")
    got = sorted(map(tuple, catalog.queries()["E1_embedding"](spark, str(tmp_path)).collect()))
    con = duck.cursor()
    con.execute(f"CREATE SCHEMA odd; SET schema = 'odd'; CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    assert got == sorted(con.execute(catalog.oracle_sql()["E1_embedding"]).fetchall())


def test_pipeline_tells_languages(spark):
    """The language stage learns from every labelled document and keeps what it predicts (F32)."""
    texts = {"en": "the cat sat on the mat and looked at the dog", "es": "el perro mira la casa desde la calle"}
    out = [i for i in range(1, 300) if zlib.crc32(str(i).encode()) % 4 == 2]
    rows = [(i, texts["en"], "en") for i in range(1, 300) if i not in out] + [(i, texts["es"], "es") for i in out] + [(900, "1 2 3", "en"), (901, None, "en")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    found = corpus_pipeline.language(spark, docs, "").collect()
    assert len(found) == 299 and {(r.lang, r.lang_pred) for r in found} == {("en", "en"), ("es", "es")} and all(0 < r.score <= 1 for r in found)


def test_requests_of_one_kind_are_ranked_once(spark, sf):
    """Pages, body hits and contexts come from one request of each kind of caller; the pairs of all requests are never made."""
    asked = Asked(spark, sf)
    rows = asked.asks.crossJoin(spark.range(3).toDF("k"))  # three requests of each caller, one of them without a query
    asked.asks = rows.withColumn("request_id", F.col("request_id") * 3 + F.col("k")).withColumn("query", F.when(F.col("k") == 2, "").otherwise(F.col("query")))
    callers = asked.asks.select("user_id").distinct().count()
    assert asked.kinds.select("request_id").distinct().count() <= callers < asked.asks.count()
    one = lambda df: sorted(map(tuple, df.select("request_id", "document_id").collect()))
    want = one(rk.body_hits(asked.found, asked.asks, F.lower, asked.texts))
    assert want and one(rk.body_hits(asked.kinds, asked.asks, F.lower, asked.texts, asked.same)) == want
    for name in ("R1_browse", "R11_pagination", "R5_body_boost", "R17_hydrate_context"):
        files = "".join(catalog.queries()[name](spark, sf).inputFiles())
        assert "docwarp-kinds-" in files and "docwarp-eligible-" not in files


def test_sessions_meet_only_documents_they_name(spark, sf):
    """No join makes a row for every session and readable document."""
    t = Tables(spark, sf)
    asked = t.sessions.select(F.col("id").alias("session_id"), "document_id")
    pairs = plans.opened(t, asked)
    named = asked.where("document_id IS NOT NULL").count()
    assert 0 < pairs.count() <= named and pairs.join(asked, ["session_id", "document_id"], "left_anti").isEmpty()


def test_state_is_asked_only_for_what_changes():
    """An attempt that starts and ends in one batch costs one look at the state and writes nothing."""
    calls = []

    class State:
        get = lambda self: calls.append("get")
        clear = lambda self: calls.append("clear")
        update = lambda self, v: calls.append("update")
        exists = lambda self: calls.append("exists")

    class Handle:
        getValueState = lambda self, *a: State()  # noqa: E731, N815
        listTimers = lambda self: calls.append("list") or []  # noqa: E731, N815
        registerTimer = lambda self, at: calls.append("timer")  # noqa: E731, N815

    class Values:
        getCurrentWatermarkInMs = lambda self: calls.append("watermark") or 0  # noqa: E731, N815

    job = Expiry(900_000_000)
    job.init(Handle())
    rows = pd.DataFrame({"key": ["k", "k"], "at": [60_000_000, 0], "starts": [False, True]})
    assert list(job.handleInputRows(("k",), iter([rows]), Values())) == [] and calls == ["get"]
    calls.clear()
    assert list(job.handleInputRows(("k",), iter([rows[1:]]), Values())) == [] and calls == ["get", "watermark", "timer", "update"]


def test_places_travel_once_a_token_and_document(spark):
    """A search for all words sends the places of a token once, however many requests ask for it."""
    texts = spark.createDataFrame([(d, "common " * 40 + f"rare{d}") for d in range(200)], "document_id long, text string")
    asks = spark.createDataFrame([(q, f"common rare{q}") for q in range(100)] + [(500, "common nowhere"), (501, "common")], "request_id long, query string")
    index = TextIndex.build(texts)
    found = index.search(asks, True)
    got = found.collect()
    assert len(got) == 100 + 200 and {(r.request_id, r.document_id) for r in got if r.request_id < 500} == {(q, q) for q in range(100)}
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    joined = [line for line in plan.splitlines() if "steps" in line and "request_id" in line and "Join" in line]
    assert not joined and "LeftSemi, ((request_id" not in plan
