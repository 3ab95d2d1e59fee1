"""More of the training-data operators: clashing names, hot groups, brute force over methods' own results."""

import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from docwarp.llm import chat, decontaminate, exact_dedup, langid, licenses, near_dedup, queries, substring_dedup, tokenstore, warc
from docwarp.llm.common import table
from docwarp.llm.tokens import Encoder, tokenizer_json
from tests.llm.test_llm import components


def test_substring_dedup_takes_any_names(spark):
    passage = " ".join(f"Sentence {i} has a few words of its own here." for i in range(6))
    names = ["_id", "_mark", "_removed", "_own", "id", "of", "own", "row", "cleaned", "mark", "sure"]
    rows = [(1, f"A. {passage} B.", *names), (2, f"C. {passage} D.", *names), (3, None, *names)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, " + ", ".join(f"{n} string" for n in names))
    out = {r.doc_id: r for r in substring_dedup.dedup(docs).collect()}
    assert all(r[n] == n for r in out.values() for n in names) and out[2].text.split() == ["C.", "D."] and out[3].text is None


def test_substring_dedup_hot_spans(spark, monkeypatch):
    """A span of every document, over many slices; many ranges of one document."""
    monkeypatch.setattr(substring_dedup, "SLICE", 5)
    hot = "This very common passage stands in every document that there is. It has a second sentence with many more words than the first one has."
    rows = [(i, f"Number {i} begins. {hot} Number {i} ends.") for i in range(300)]
    many = " ".join(f"{hot} Own{i} words only." for i in range(200))
    out = {r.doc_id: r for r in substring_dedup.dedup(spark.createDataFrame([*rows, (999, many)], "doc_id long, text string").repartition(7)).collect()}
    assert out[0].text == rows[0][1] and all(out[i].text.split() == f"Number {i} begins. Number {i} ends.".split() for i in range(1, 300))
    assert out[999].text.split() == " ".join(f"Own{i} words only." for i in range(200)).split() and len(out[999].removed) == 200


def test_warc_common_payload(spark):
    rows = [(i, f"http://h/{i}", "same page", "x", "y") for i in range(700)] + [(5, "http://h/again", "same page", "x", "y"), (1000, "u", "é" * 100_000, "x", "y"), (1001, "u", None, "x", "y")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, digest string, payload string")
    path = warc.write_archive(pages, warc.scratch_path(spark, "test"))
    got = {r.page_id: r for r in warc.index(spark, path).collect()}
    assert all((got[i].record_type, got[i].refers_to, got[i].payload_bytes) == ("revisit", 699, 9) for i in range(699)) and got[699].record_type == "response"
    assert got[1000].payload_bytes == 200_000 and got[1001].payload_bytes == 0 and warc.index(spark, path).count() == len(rows)
    assert warc.read_payloads(spark, path).count() == 3
    records = {r.page_id: bytes(r.record) for r in warc.read_records(spark, path).collect()}
    assert records[699].endswith(b"\r\n\r\nsame page\r\n\r\n") and b"\r\nWARC-Date: 1970-01-01T00:00:00Z\r\n" in records[3] and records[3].endswith(b"Content-Length: 0\r\n\r\n\r\n\r\n")


def words(text):
    return re.findall(licenses.WORDS, (text or "").translate({i: i + 32 for i in range(65, 91)}))


def test_license_notices_brute_force(spark, sf):
    """Each notice with at most one word added, left out or replaced is found where three words stay together and what its pairs of words span is alike, each found span is as like its notice as it says, and no document without a likely window has a label."""
    rng = random.Random(8)
    rows, want = [], {}
    for i in range(120):
        t = rng.choice(licenses.NOTICES)
        w = t.words.split()
        at, kind = rng.randrange(1, len(w) - 1), i % 4
        changed = w[:at] + {0: [w[at]], 1: ["added", w[at]], 2: [], 3: ["other"]}[kind] + w[at + 1 :]
        noise = lambda n: [f"n{rng.randrange(10**6)}" for _ in range(n)]
        rows.append((10_000 + i, " ".join([*noise(rng.randrange(30)), *changed, *noise(rng.randrange(30))]).upper()))
        left, right = w[:at], w[at + (kind > 1) :]
        kept = changed if min(len(left), len(right)) > 1 else max(left, right, key=len)  # a lone word beside the change has no pair
        like = len(set(w) & set(kept)) / len(set(w) | set(kept))
        want[10_000 + i] = t.label if like >= 0.8 and max(len(left), len(right)) >= 3 else None  # a diagonal needs two votes
    docs = table(spark, sf, "documents").select("doc_id", "text").unionByName(spark.createDataFrame([*rows, *rows[:5]], "doc_id long, text string"))
    found = licenses.scan(docs).collect()
    texts = {r.doc_id: words(r.text) for r in docs.collect()}
    by_label = {t.label: set(t.words.split()) for t in licenses.NOTICES}
    n_of = {t.label: len(t.words.split()) for t in licenses.NOTICES}
    for r in found:
        w = texts[r.doc_id]
        for s in r.spans:
            if not s.base:
                own = set(w[s.start : s.start + s.length])
                assert s.score == pytest.approx(len(own & by_label[s.label]) / len(own | by_label[s.label])) and s.score >= 0.8
        labels = {s.label for s in r.spans if not s.base}
        if r.doc_id >= 10_000 and want[r.doc_id]:
            assert want[r.doc_id] in labels
        if r.doc_id < 10_000:
            likely = {k for k, ws in by_label.items() for i in range(len(w)) if w[i] in ws for n in range(n_of[k] - 3, n_of[k] + 5) for own in [set(w[i : i + n])] if len(own & ws) >= 0.8 * len(own | ws)}
            assert labels <= likely
    assert Counter(r.doc_id for r in found)[10_000] == 2


def test_license_single_vote_joins(spark):
    texts = ["released under the standard mit license", "x " * 50_000 + "released under the mit license " * 20]
    out = {r.doc_id: r.spans for r in licenses.scan(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert {s.label for s in out[0]} == {"mit", "mit-notice"} and sum(s.label == "mit-notice" for s in out[1]) == 20


def test_long_conversation(spark):
    rows = [(1, i, "assistant" if i % 2 else "user", f"turn {i}") for i in range(5000)]
    out = chat.read_chats(chat.format_chats(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))).first()
    assert [t.text for t in out.turns] == [r[3] for r in rows] and out.loss_text == "".join(r[3] for r in rows if r[2] == "assistant")


@pytest.mark.parametrize("percent", [85, 80])
def test_near_dedup_large_sets(spark, percent):
    """Sets over the size that is compared in place, in groups of near copies and of texts that share much but are no copies."""
    rng = random.Random(5)
    rows = []
    for g in range(2):
        base = [f"g{g}w{i}" for i in range(900)]
        for i in range(40):
            keep = (0.004, 0.02)[g]
            rows.append((len(rows), " ".join(w if rng.random() > keep else f"v{rng.randrange(10**9)}" for w in base)))
    rows += [(1000 + i, " ".join([*[f"c{k}" for k in range(500)], *[f"own{i}_{k}" for k in range(130)]])) for i in range(40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = Counter(tuple(r) for r in near_dedup.link(docs, percent=percent, reps=3, block=6).select("doc_id", "n_shingles", "component_id").collect())
    assert got == Counter(components(rows, percent))


def test_blocks_give_few_links():
    """All members of a block are alike: a link a join, not a link a pair."""
    sets = [np.sort(np.random.default_rng(1).integers(0, 2**64, 300, dtype=np.uint64)) for _ in range(1)]
    group = [(1, bytes([i, i >> 8]), bytes([i, i >> 8]), 300, sets[0].tobytes(), None) for i in range(256)]
    assert len(near_dedup._block(7, group, 85, 5.5)) == 255
    large = [(1, bytes([i, i >> 8]), bytes([i, i >> 8]), 2000, near_dedup.registers(sets[0]).tobytes(), None) for i in range(200)]
    found = near_dedup._block(7, large, 85, 5.5)
    assert (None, None, None, 7) in found and len(found) <= 200 * (1 + near_dedup.EACH)


def test_exact_dedup_hot_group(spark):
    rows = [(i, "the same  text" if i % 3 == 0 else "thesametext " if i % 3 == 1 else f"own {i}", i, i) for i in range(3000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, digest long, salt long")
    got = {r.doc_id: r for r in exact_dedup.decide(docs, salts=8).collect()}
    assert len(got) == 3000 and all((got[i].keep_id, got[i].group_size, got[i].kept) == ((0, 2000, i == 0) if i % 3 < 2 else (i, 1, True)) for i in range(3000))
    kept = exact_dedup.dedup(docs)
    assert kept.columns == docs.columns and kept.count() == 1001


def test_every_language_is_learned(spark):
    rows = [(7, "the cat sat on the mat and looked at the dog", "en")] * 3000 + [(1, "el perro mira la casa desde la calle", "es"), (None, "le chat dort sur la table", "fr"), (2, None, "de"), (3, "x", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = langid.train(docs, docs_per_lang=50, epochs=1)
    assert model.langs == ["en", "es", "fr"]
    assert queries.held_out() is not None and docs.select(queries.held_out().alias("h")).where("h IS NULL").count() == 0
    assert langid.keep_identified(docs, None).count() == 3003


def test_prediction_is_the_plain_convolution():
    rng = np.random.default_rng(3)
    model = langid.ByteCNN.fresh(["a", "b", "c"], 64, (2, 3, 4, 5), 8, 16, rng)
    model.bias = [rng.normal(0, 1, len(b)).astype(np.float32) for b in model.bias]
    x = rng.integers(0, 256, (20, 64)).astype(np.uint8)
    features = []
    for w, k, b in zip(model.widths, model.filters, model.bias):
        z = np.stack([np.concatenate([model.embed[x[:, i + o]] for o in range(w)], axis=1) @ k for i in range(64 - w + 1)], axis=1)
        features.append(z.max(axis=1) + b)
    want = langid.softmax(np.maximum(np.concatenate(features, axis=1), 0) @ model.dense + model.dense_bias)
    assert np.allclose(model.predict(x, model.tables()), want, atol=1e-4)


def test_token_store_on_documents(spark, sf):
    """The registered query against the library, over the whole table."""
    e = Encoder(tokenizer_json())
    want, at = {}, 0
    for r in table(spark, sf, "documents").orderBy("doc_id").collect():
        ids = [*e.tok.encode(r.text or "", add_special_tokens=False).ids, 2]
        want[r.doc_id] = (at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        at += len(ids)
    assert {r.doc_id: (r.start, r.n_tokens, r.ids_crc32) for r in queries.op9_token_store(spark, sf).collect()} == want


def test_token_store_finds_damage(spark):
    docs = spark.createDataFrame([(1, "some words to keep"), (2, "other words")], "doc_id long, text string")
    path = tokenstore.write_store(docs, tokenstore.scratch_path(spark, "test"))
    kept = tokenstore.read_chunks(spark, path).collect()
    bad = [(c.digest, c.n_ids, bytes(c.ids)[:-1] + b"\x07") for c in kept]
    rows = spark.createDataFrame(bad, "digest binary, n_ids long, ids binary").selectExpr("cast(null as long) row_id", "cast(null as long) doc_id", "digest", "n_ids", "ids", "cast(null as array<binary>) parts")
    rows.write.mode("overwrite").parquet(f"{path}/parts/kind=chunk")
    with pytest.raises(Exception, match="don't match"):
        tokenstore.read_documents(spark, path).collect()


def test_decontamination_brute_force(spark, sf):
    """Against plain search for every window, with one block and with many that cut long items."""
    items = table(spark, sf, "benchmark").select("item_id", "text").unionByName(spark.createDataFrame([(9001, " ".join(f"long{i}" for i in range(300))), (9002, "tiny")], "item_id long, text string"))
    more = [(50_001, "x " + " ".join(f"LONG{i}" for i in range(40, 75)) + " y"), (50_002, "a tiny thing"), (50_003, " ".join(f"long{i}" for i in range(9)))]
    docs = table(spark, sf, "documents").select("doc_id", "text").unionByName(spark.createDataFrame(more, "doc_id long, text string"))
    owners = {}
    for r in items.collect():
        for w in decontaminate.windows(decontaminate.words_of(r.text), 10):
            owners.setdefault(tuple(w.split()), set()).add(r.item_id)
    want = {}
    for r in docs.collect():
        w = decontaminate.words_of(r.text)
        hit, ids = set(), set()
        for n in {len(k) for k in owners}:
            for i in range(len(w) - n + 1):
                if (found := owners.get(tuple(w[i : i + n]))):
                    hit |= set(range(i, i + n))
                    ids |= found
        want[r.doc_id] = (len(w), len(hit), sorted(ids))
    for chars in (2_000_000, 6_000):
        got = decontaminate.find_contamination(docs, items, block_chars=chars)
        assert {r.doc_id: (r.n_words, r.n_hit, r["items"]) for r in got.select("doc_id", "n_words", "n_hit", F.col("items")).collect()} == want


def test_decontamination_runs_one_worker_and_automaton(spark, monkeypatch):
    words = lambda k: " ".join(f"w{k}x{j}" for j in range(10))
    items = spark.createDataFrame([(k, words(k)) for k in range(14)], "item_id long, text string")
    rows = [(k, f"before {words(k)} between {words((k + 1) % 14)} after") for k in range(20)] + [(20, None), (21, "clean")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    made = decontaminate._automata(items, 10, 60)[0]
    assert len(made) == 14
    for value, key in made:  # only the last one asked for is held
        decontaminate._automaton(value, key, 10)
        assert list(decontaminate._AUTOMATA) == [key]
    monkeypatch.setattr(decontaminate, "HELD", 100)
    got = decontaminate.find_contamination(docs, items, block_chars=60)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert plan.count("MapInArrow") == 1
    for r in got.collect():
        own = {k for k in (r.doc_id, (r.doc_id + 1) % 14) if k < 14} if r.doc_id < 20 else set()
        assert (set(r["items"]), r.n_hit) == (own, 10 * len(own))
    left = decontaminate.decontaminate(docs, items, block_chars=60)
    assert left._jdf.queryExecution().executedPlan().toString().count("MapInArrow") == 1
    assert {r.doc_id for r in left.collect()} == {20, 21}


def test_substring_dedup_without_white_space(spark):
    import random

    random.seed(8)
    some = lambda lo, hi, n: "".join(chr(random.randint(lo, hi)) for _ in range(n))
    chinese = "".join(some(0x4E00, 0x9000, random.randint(4, 30)) + random.choice("。！？") for _ in range(40))
    thai, code = some(0x0E01, 0x0E30, 400), some(97, 122, 400)
    for passage in (chinese, thai, code):
        own = some(0x4E00, 0x9000, 60) + "。"
        rows = [(1, passage), (2, passage), (3, own), (4, passage + "\n" + own[:20])]
        out = {r.doc_id: r.text for r in substring_dedup.dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
        assert (out[1], out[2], out[3], out[4].strip()) == (passage, "", own, own[:20])
    inside = spark.createDataFrame([(1, chinese), (2, some(0x4E00, 0x9000, 90) + "。" + chinese + some(0x4E00, 0x9000, 90))], "doc_id long, text string")
    left = {r.doc_id: r.text for r in substring_dedup.dedup(inside).collect()}
    assert left[1] == chinese and len(left[2]) <= 200


def test_near_dedup_ends_in_few_rounds(spark, monkeypatch):
    """Members of a key that are all far apart: rounds take ever more of them, so their number does not grow with the key's size."""
    rounds, write = [], near_dedup.written

    def counted(df, name, *more):
        rounds.append(name)
        assert rounds.count("met") <= 4, "a round for every few members"
        return write(df, name, *more)

    monkeypatch.setattr(near_dedup, "written", counted)
    common = [f"c{k}" for k in range(300)]
    rows = [(i, " ".join([*common, *[f"own{i}_{k}" for k in range(50)]])) for i in range(30)]
    rows.append((30, rows[7][1] + " more"))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = Counter(tuple(r) for r in near_dedup.link(docs, percent=90, reps=1, block=2).select("doc_id", "n_shingles", "component_id").collect())
    assert got == Counter(components(rows, 90)) and rounds.count("met") > 1


def test_near_dedup_leaves_texts_where_they_are(spark):
    """Of many texts two are near: no round sends those that no join wants."""
    draw = random.Random(5)
    rows = [(i, " ".join(f"w{draw.randrange(10**9)}" for _ in range(1500))) for i in range(150)]
    rows.append((150, rows[7][1] + " more"))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    sc, name = spark.sparkContext._jsc.sc(), "spark.sql.autoBroadcastJoinThreshold"

    def moved():
        sc.listenerBus().waitUntilEmpty()
        return sc.statusStore().executorList(False).head().totalShuffleWrite()

    before, as_set = moved(), spark.conf.get(name)
    spark.conf.set(name, -1)  # a small table stands for one too large to be broadcast
    try:
        got = Counter(tuple(r) for r in near_dedup.link(docs).select("doc_id", "n_shingles", "component_id").collect())
    finally:
        spark.conf.set(name, as_set)
    assert got == Counter((i, 1498 + (i == 150), 7 if i == 150 else i) for i, _ in rows)
    assert moved() - before < sum(len(t) for _, t in rows) / 4


@pytest.mark.parametrize("marks", [64, 1 << 23])
def test_near_dedup_likely_rows_lose_no_partner(spark, marks, monkeypatch):
    """Bits that are crowded let more rows by, never fewer."""
    monkeypatch.setattr(near_dedup, "MARKS", marks)
    rows = spark.range(-500, 500).select(F.xxhash64("id").alias("h"), "id")
    wanted = rows.where("id % 7 = 0")
    left = near_dedup._likely(rows, wanted.select("h"), "h")
    assert left.columns == rows.columns and left.join(wanted, "h", "left_semi").count() == wanted.count() <= left.count()
    assert (left.count() == wanted.count()) == (marks > 64) and near_dedup._likely(rows, wanted.where("false").select("h"), "h").count() == 0
