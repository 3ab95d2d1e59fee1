"""Rankings without SQL, against brute force over every pair on a small table."""

import random

import pytest
from pyspark.sql import functions as F

from docwarp.functions import similarity as sim
from docwarp.operators import ranking as rk
from docwarp.operators import retrieval as rt
from docwarp.operators.sinks import global_rank
from tests.test_operators import mirror

WORDS = "alpha beta gamma delta alphabet betas gam policy report 2024".split()


@pytest.fixture(scope="module")
def corpus(spark):
    rng = random.Random(9)
    docs = [(i, f"{rng.choice(WORDS)} {rng.choice(WORDS)}", " ".join(rng.choices(WORDS, k=rng.randint(0, 9))), i * 10) for i in range(1, 25)]
    asks = [(1, "alpha beta", 1), (2, "gamma report", 2), (3, "zzz", 3), (4, "alphabet", 1)]
    pairs = [(q, *d) for q, _, _ in asks for d in docs if (q * 7 + d[0]) % 3]
    found = spark.createDataFrame(pairs, "request_id long, id long, title string, extracted_text string, current_revision_id long").withColumn("updated_at", F.timestamp_seconds("id"))
    return docs, asks, pairs, found, spark.createDataFrame(asks, "request_id long, query string, vec_id long")


def best(query, title, text):
    return max(mirror(query, title), mirror(query, text))


def test_lexical(corpus):
    _, asks, pairs, found, table = corpus
    text = {q: t for q, t, _ in asks}
    want = {(q, d): round(s, 6) for q, d, title, body, _ in pairs if (s := best(text[q], title, body)) >= 0.2}
    rows = rk.ranked(rk.lexical(found, table), 0, 100).collect()
    assert {(r.request_id, r.document_id): r.score for r in rows} == pytest.approx(want)
    for q in text:
        own = sorted((r for r in rows if r.request_id == q), key=lambda r: r["rank"])
        assert [r.document_id for r in own] == [d for _, d in sorted((-s, d) for (k, d), s in want.items() if k == q)]
        assert all(r.total == len(own) for r in own)


def test_trigram_search(spark, corpus):
    docs, asks, _, _, table = corpus
    rows = rt.trigram_search(spark.createDataFrame([d[:3] for d in docs], "document_id long, title string, text string"), table).collect()
    want = {(q, d): round(s, 6) for q, t, _ in asks for d, title, body, _ in docs if (s := best(t, title, body)) >= 0.2}
    assert {(r.request_id, r.document_id): r.score for r in rows} == pytest.approx(want)


def test_routing(spark, corpus):
    docs, _, pairs, found, table = corpus
    chunks = spark.createDataFrame([(d * 100 + k, d * 10, k, (d + k) % 5) for d, *_ in docs for k in range(2)], "id long, revision_id long, chunk_index long, vec_id long")
    vectors = spark.createDataFrame([(v, [float(v + 1), 1.0, float(v % 2)]) for v in range(5)], "vec_id long, embedding array<float>")
    modes = table.withColumn("mode", F.when(F.col("request_id") == 2, "lexical")).withColumn("query", F.when(F.col("request_id") == 3, " ").otherwise(F.col("query")))
    rows = rk.route(found, chunks, vectors, modes).collect()
    mode = {r.request_id: r.mode for r in rows}
    assert mode == {1: "semantic", 2: "lexical", 3: "browse", 4: "semantic"}
    shown = [r.document_id for r in sorted((r for r in rows if r.request_id == 3), key=lambda r: r["rank"])]
    assert shown == sorted((p[1] for p in pairs if p[0] == 3), reverse=True)[:20]
    unit = lambda v: [x / sum(y * y for y in v) ** 0.5 for x in v]
    vec = {v: unit([v + 1, 1, v % 2]) for v in range(5)}
    score = {}
    for q, d, title, body, _ in pairs:
        if q in (1, 4):
            cos = max(sum(a * b for a, b in zip(vec[(d + k) % 5], vec[1])) for k in range(2))
            query = {1: "alpha beta", 4: "alphabet"}[q]
            hits = [p[1] for p in pairs if p[0] == q and query in p[3]]
            few = 0 < len(hits) <= 0.5 * sum(p[0] == q for p in pairs)
            score[q, d] = cos + 0.075 * mirror(query, title) + 0.1 * (few and d in hits)
    for r in rows:
        if r.mode == "semantic":
            assert r.score == pytest.approx(score[r.request_id, r.document_id], abs=1e-6)


def test_long_texts_match_all_extents(spark):
    rng = random.Random(2)
    for _ in range(40):
        query, text = " ".join(rng.choices(WORDS, k=2)), " ".join(rng.choices([*WORDS, "noise", "other", "al"], k=rng.randint(0, 40)))
        assert sim.similarity(query, text) == pytest.approx(mirror(query, text))


def test_full_ranks(spark):
    rows = spark.range(1000).select((F.col("id") % 3).alias("request_id"), F.col("id").alias("document_id"), (F.col("id") % 7).cast("double").alias("score"))
    got = {(r.request_id, r.document_id): r["rank"] for r in rt.full_rank(rows).collect()}
    for q in range(3):
        order = sorted((-(d % 7), d) for d in range(1000) if d % 3 == q)
        assert [got[q, d] for _, d in order] == list(range(1, len(order) + 1))
    assert [r.id for r in global_rank(spark.range(50), [F.desc("id")]).orderBy("rank").collect()] == list(range(49, -1, -1))


def test_similarities_equal_all_extents():
    """Every extent of every pair, in all scripts, with repeats, nulls and blanks; a floor may only lower what lies under it."""
    import numpy as np

    from docwarp.functions.extents import similarities

    r = random.Random(3)
    words = ["foo", "food", "bar", "barn", "b", "ab", "aaa", "aaaa", "Éa", "x1", "42", "문서"]
    texts = [" ".join(r.choice(words) for _ in range(r.randint(0, 8))) for _ in range(40)] + [None, "", "..", "a" * 30, "İx ß"]
    queries = [" ".join(r.choice(words) for _ in range(r.randint(0, 4))) for _ in range(20)] + [None, "", "-"]
    t, q = map(np.ravel, np.meshgrid(np.arange(len(texts)), np.arange(len(queries))))
    want = np.array([mirror(queries[j], texts[i]) for i, j in zip(t, q)])
    assert np.allclose(similarities(texts, queries, t, q), want, atol=1e-12)
    some = similarities(texts, queries, t, q, 0.4)
    assert np.allclose(some[want >= 0.4], want[want >= 0.4], atol=1e-12) and (some[want < 0.4] < 0.4).all()


def test_text_index(spark):
    """Places, scores of repeated and interleaved tokens, renewal by document, and a plan that reads the query's buckets only."""
    from docwarp.operators.textindex import TextIndex, bucket

    docs = [(1, "red fish blue fish"), (2, "blue whale, red! RED fish"), (3, None), (4, ""), (5, "one two three")]
    index = TextIndex.build(spark.createDataFrame(docs, "document_id long, text string"))
    asks = spark.createDataFrame([(1, "red fish"), (2, "fish whale"), (3, "none here"), (4, "..")], "request_id long, query string")
    found = lambda i, every: {(r.request_id, r.document_id): r.score for r in i.search(asks, every).collect()}
    # document 1: red fish(2) is a cover; document 2: the second red with fish, the first one is farther
    assert found(index, True) == {(1, 1): 0.1, (1, 2): 0.1, (2, 2): round(0.1 / 3, 6)}
    assert found(index, False) == {(1, 1): 0.1, (1, 2): 0.1, (2, 1): 0.2, (2, 2): round(0.1 / 3, 6)}
    again = index.renew(spark.createDataFrame([(1, "a whale of a fish"), (2, None)], "document_id long, text string"))
    assert found(again, True) == {(2, 1): round(0.1 / 3, 6)}
    assert {r.token: r.documents for r in again.counts.collect()}["fish"] == 1
    one = spark.createDataFrame([(1, "whale")], "request_id long, query string")
    plan = index.search(one, True)._jdf.queryExecution().executedPlan().toString()
    at = spark.range(1).select(bucket(F.lit("whale"))).first()[0]
    assert f"(bucket#" in plan and "PartitionFilters" in plan and f"= {at})" in plan


def test_contained(spark):
    """Needles of every length class against plain containment, with letters of all scripts, repeats, nulls and blanks; no nested loop."""
    import random

    from docwarp.operators.containment import contained

    r = random.Random(2)
    letters = "ab ć문.😀"
    texts = [(i, "".join(r.choice(letters) for _ in range(r.randint(0, 90)))) for i in range(60)] + [(60, None), (61, ""), (62, "ab" * 300)]
    cuts = [(lambda t, n: t[r.randint(0, max(0, len(t) - n)) :][:n])(texts[r.randint(0, 59)][1], r.choice([1, 2, 3, 4, 5, 7, 9, 10, 17, 18, 25, 45, 80])) for _ in range(80)]
    needles = list(enumerate([*cuts, "", None, "zz", "ab" * 20]))
    found = contained(spark.createDataFrame(texts, "key long, body string"), spark.createDataFrame(needles, "request_id long, needle string"))
    want = {(i, k) for i, n in needles if n for k, t in texts if t and n in t}
    assert {tuple(x) for x in found.select("request_id", "key").collect()} == want
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_best_chunks_equal_scored_chunks(spark, sf):
    """One matrix product a document gives what scoring pair by pair gives, also with zero and null vectors and unknown ones."""
    from docwarp.operators import ranking as rk

    vectors = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.6, 0.8]), (3, [0.0, 0.0]), (4, None), (5, [1.0, 0.0])], "vec_id long, embedding array<float>")
    chunks = spark.createDataFrame([(i, i // 3, i // 3, i % 3, v) for i, v in enumerate([1, 5, 2, 3, 4, None, 2, 1, 5])], "id long, revision_id long, document_id long, chunk_index long, vec_id long")
    found = spark.createDataFrame([(q, d, d) for q in (1, 2, 3, 4) for d in (0, 1, 2)], "request_id long, id long, current_revision_id long")
    asks = spark.createDataFrame([(1, 1), (2, 2), (3, 3), (4, 9)], "request_id long, vec_id long")
    rows = lambda df: sorted((r.request_id, r.document_id, r.chunk_id, r.chunk_index, round(r.score, 6)) for r in df.collect())
    got = rows(rk.best_chunks(found, chunks, vectors, asks))
    assert got == rows(rk.best_chunk(rk.scored_chunks(found, chunks, vectors, asks))) and (1, 0, 0, 0, 1.0) in got and len(got) == 4


def test_callers_with_equal_principals_share_a_set(spark, sf):
    from docwarp.operators import eligibility as el
    from docwarp.sources.fixtures import Tables

    t = Tables(spark, sf)
    many = spark.createDataFrame([(i, (1, 9, 10, -1)[i % 4]) for i in range(200)], "request_id long, user_id long")
    sets = el.principal_sets(many, t.users)
    assert sets.count() == 200 and sets.select("caller").distinct().count() == 4
    rows = el.readable(many, t.users, t.perms)
    plan = rows._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan
    assert rows.where("request_id % 4 = 3").isEmpty() and rows.count() == rows.distinct().count()
