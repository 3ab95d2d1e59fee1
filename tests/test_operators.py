"""Scenarios and invariants on small tables."""

import json
import random

import pytest
import regex
from pyspark.sql import functions as F

from docwarp.functions import similarity as sim
from docwarp.functions import text as tx
from docwarp.functions.segments import segments
from docwarp.operators import eligibility as el
from docwarp.operators import lifecycle as lc
from docwarp.operators import navigate as nv
from docwarp.operators import profiling as pf


def trigrams(text):
    return [f"  {w} "[i : i + 3] for w in regex.split(r"[^\p{L}\p{N}]+", (text or "").lower()) if w for i in range(len(w) + 1)]


def mirror(query, text):
    """word_similarity over all extents."""
    q, t = set(trigrams(query)), trigrams(text)
    return max([len(q & set(t[i:j])) / len(q | set(t[i:j])) for i in range(len(t)) for j in range(i + 1, len(t) + 1)], default=0.0)


def test_word_similarity_matches_all_extents(spark):
    rng = random.Random(5)
    words = ["alpha", "beta", "gamma", "al", "ph", "bet", "a"]
    pairs = [(" ".join(rng.choices(words, k=2)), " ".join(rng.choices(words, k=rng.randint(0, 6)))) for _ in range(60)] + [("x", ""), ("", "x")]
    df = spark.createDataFrame(pairs, "q string, t string")
    rows = df.select("q", "t", sim.word_similarity_short(F.col("q"), F.col("t")).alias("a"), sim.word_similarity(F.col("q"), F.col("t")).alias("b")).collect()
    for r in rows:
        want = mirror(r.q, r.t)
        assert r.a == pytest.approx(want) and r.b == pytest.approx(want)


def test_default_deny_and_principals(spark):
    users = spark.createDataFrame([(1, 7, True, "ACTIVE"), (2, None, True, "PENDING")], "id long, department_id long, is_active boolean, status string")
    perms = spark.createDataFrame([(10, None, None, True, "READ"), (11, 1, None, False, "WRITE"), (12, None, 7, False, "READ"), (13, 1, None, False, "NONE")], "document_id long, user_id long, department_id long, is_public boolean, permission string")
    requests = spark.createDataFrame([(1, 1), (2, 2), (3, 99)], "request_id long, user_id long")
    got = {tuple(r) for r in el.readable(requests, users, perms).collect()}
    assert got == {(1, 10), (1, 11), (1, 12)}


def test_rename_needs_a_unique_hash(spark):
    docs = spark.createDataFrame([(1, "a", "h1"), (2, "b", "h2"), (3, "c", "h2")], "id long, source_path string, hash string").select("*", F.lit(False).alias("is_deleted"), F.lit(None).cast("timestamp").alias("missing_since"), F.current_timestamp().alias("created_at"))
    manifest = spark.createDataFrame([("x", "h1"), ("y", "h2")], "source_path string, hash string")
    states = lc.classify(manifest, docs)
    assert [tuple(r) for r in lc.pair_renames(states).collect()] == [(1, "a", "x")]


def test_reconcile_is_idempotent(spark):
    docs = spark.createDataFrame([(1, "a", "h1"), (2, "b", "h2")], "id long, source_path string, hash string").select("*", F.lit(False).alias("is_deleted"), F.lit(None).cast("timestamp").alias("missing_since"), F.lit("2024-01-01").cast("timestamp").alias("created_at"))
    manifest = spark.createDataFrame([("a", "h1"), ("b", "h2")], "source_path string, hash string")
    now = F.lit("2024-02-01").cast("timestamp")
    out = lc.reconcile(manifest, docs, now, "interval 1 day")
    assert {(r.id, r.source_path, r.missing_since, r.is_deleted) for r in out.collect()} == {(1, "a", None, False), (2, "b", None, False)}


def test_paragraph_diff_sees_moves(spark):
    pairs = spark.createDataFrame([(1, 2, "a\nb\nc", "b\nc\na\nd")], "document_id long, revision_no long, old_text string, new_text string")
    r = nv.paragraph_diff(pairs).first()
    assert (r.n_added, r.n_removed, r.truncated) == (2, 1, False)


def test_chunks_keep_order_and_budget(spark):
    rows = [(1, i, " ".join(f"w{j}" for j in range(n)), 1 if i < 3 else 2) for i, n in enumerate([3, 4, 5, 30, 2, 2])]
    blocks = spark.createDataFrame(rows, "revision_id long, index long, text string, page long")
    out = tx.chunk_documents(blocks, 10).orderBy("chunk_index").collect()
    assert [(c.paragraph_start, c.paragraph_end, c.token_count) for c in out] == [(0, 1, 7), (2, 2, 5), (3, 3, 10), (3, 3, 10), (3, 3, 10), (4, 5, 4)]


def test_context_budget_is_the_length_of_the_json_array(spark):
    texts = ["x" * 50 + '"\n\t\x01\\', "y" * 400, "x" * 50 + '"\n\t\x01\\', "한글 / \u2028é" * 3, "\u3000 \n", "p" * 10, None]
    ids = [5, 6, 5, 7, 8, 9, 10]
    kinds = [("hwp", 3, 4, None), ("hwp", 3, 4, None), ("hwp", 3, 4, None), ("pdf", 1, 1, 12), ("pdf", 1, 1, 2), ("pdf", 1, 1, None), ("txt", 1, 1, 1)]
    rows = [(1, i, 11, 12, k, "Ti\"tle", f, None if i else "sec", a, z, p, t) for i, (k, t, (f, a, z, p)) in enumerate(zip(ids, texts, kinds, strict=True))]
    schema = """request_id long, position long, document_id long, revision_id long, chunk_id long, title string, file_type string, section_title string,
        paragraph_start long, paragraph_end long, page_number long, text string"""

    def item(r):
        f, a, z, p = r[6], r[8], r[9], r[10]
        anchor = {"type": "none"}
        if f in ("hwp", "hwpx", "docx"):
            anchor = {"type": "paragraph", "paragraph_index": a, "paragraph_end": z}
        elif f == "pdf" and p:
            anchor = {"type": "page", "page_number": p}
        return dict(document_id=str(r[2]), revision_id=str(r[3]), chunk_id=str(r[4]), title=r[5], file_type=f, section_title=r[7], anchor=anchor, text=r[11])

    want = len(json.dumps([item(rows[i]) for i in (0, 3, 5)], ensure_ascii=False))
    frame = spark.createDataFrame(rows, schema)
    exact, short = tx.assemble_context(frame, 5, want).first(), tx.assemble_context(frame, 5, want - 1).first()
    assert (exact.ids, exact.used) == ([5, 7, 9], want)
    assert short.ids == [5, 7]
    assert tx.assemble_context(frame, 5, 10).first().used == 2


def test_segments_are_greedy(spark):
    random.seed(4)
    lists = [[(random.randint(0, 9), random.randint(0, 3), random.random() < 0.1) for _ in range(random.choice([0, 1, 5, 300]))] for _ in range(60)]
    frame = spark.createDataFrame([(i, x) for i, x in enumerate(lists)], "id long, rows array<struct<n:int,h:int,b:boolean>>").repartition(3)
    cut = segments(F.col("rows"), lambda x: x["n"], lambda x: x["h"], lambda x, before: x["b"], 12)
    got = {r.id: [[tuple(x) for x in c] for c in r.c] for r in frame.select("id", cut.alias("c")).collect()}
    for i, rows in enumerate(lists):
        want, used = [], 0
        for n, h, b in rows:
            if not want or b or used + n > 12:
                want.append([])
                used = h
            want[-1].append((n, h, b))
            used += n
        assert got[i] == want


def test_nearest_rank_of_a_group_of_a_million_values(spark):
    big = spark.range(0, 1_000_000, 1, 8).select(F.lit("a").alias("g"), ((F.col("id") * 7919 + 13) % 1_000_003).alias("v"))
    few = spark.createDataFrame([(None, 5), (None, 5), ("b", -3), ("c", None), ("b", 2**62), ("b", -(2**62))], "g string, v long")
    rows = big.unionByName(few)
    got = {r.g: tuple(r)[1:] for r in pf.stats(rows, ["g"], "v").collect()}
    v = sorted((i * 7919 + 13) % 1_000_003 for i in range(1_000_000))
    at = lambda p, n: max(1, min(n, round(p / 100 * n + 0.5)))
    assert got == {"a": (1_000_000, v[at(50, len(v)) - 1], v[at(95, len(v)) - 1], v[-1]), None: (2, 5, 5, 5), "b": (3, -3, 2**62, 2**62)}


def test_nearest_rank_of_hard_doubles(spark):
    inf = float("inf")
    values = [-inf, inf, 1.7e308, -1.7e308, 0.0, 5e-324, *(1.5**k for k in range(-300, 300))]
    rows = spark.createDataFrame([(v,) for v in values], "v double")
    percents = [1, 25, 50, 75, 99, 100]
    got = {r.percent: r.found for r in pf.nearest_ranks(rows, [], "v", percents, bins=8, few=3).collect()}
    v = sorted(values)
    assert got == {p: v[max(1, min(len(v), round(p / 100 * len(v) + 0.5))) - 1] for p in percents}
    assert pf.nearest_ranks(rows.limit(0), [], "v", [50]).where("n > 0").count() == 0

