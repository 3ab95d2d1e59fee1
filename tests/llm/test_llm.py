"""The training-data operators: edge cases, brute force, round trips, held-out accuracy."""

import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from docwarp.llm import chat, decontaminate, exact_dedup, langid, licenses, near_dedup, packing, queries, substring_dedup, tokenstore, warc
from docwarp.llm.common import table
from docwarp.llm.tokens import Encoder, tokenizer_json

DOCS = "doc_id long, text string, lang string, source string, n_chars long, keep_id long, node string"
LONG = " ".join(f"word{i} thing" for i in range(60_000))
ROWS = [(1, None), (2, ""), (3, " \n\t "), (4, "A b c."), (5, "a B  c."), (5, "a B  c."), (6, LONG), (7, "é" * 10), (None, "A b c."), (8, "MIT License"), (9, "x")]


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls, blanks, ties, repeated rows, a null id, a very long text, extra columns with clashing names."""
    return spark.createDataFrame([(i, t, "en", None, None, 5, "n") for i, t in ROWS], DOCS)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], DOCS)


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_against_sql(name, same):
    same(queries.QUERIES[name], queries.ORACLES[name])


def ids_of(text):
    e = the_encoder()
    return [*e.tok.encode(text or "", add_special_tokens=False).ids, 2]


_E = []


def the_encoder():
    if not _E:
        _E.append(Encoder(tokenizer_json()))
    return _E[0]


def test_encoder_equals_the_library():
    import pyarrow as pa

    e = the_encoder()
    texts = ["", None, "don't stop, it's 3.5% ±²\x1cfoo*** ΑΣ. J\u030cx", "a\n\nb </w> <|endoftext|>x", "日本語 テスト", "Ünï Éa ÑÑ.., \u0301x'll they're", LONG]
    small = Encoder(tokenizer_json(), memo=50, chars=200)
    for enc in (e, small):
        got = [list(map(int, x)) for _, _, ids, n in enc.encode(pa.array(texts)) for x in np.split(ids, np.cumsum(n)[:-1])]
        assert got == [e.tok.encode(t or "", add_special_tokens=False).ids for t in texts]


def test_substring_dedup(spark, odd, none):
    passage = " ".join(f"Sentence {i} has a few words of its own here." for i in range(6))
    rows = [(1, f"Start one. {passage} End one."), (2, f"Start two.\n{passage}\nEnd two."), (3, "A clean text of its own with nothing in common. It stays as it is, of course, for it repeats nothing at all.")]
    out = {r.doc_id: r for r in substring_dedup.dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert out[1].text == rows[0][1] and out[3].text == rows[2][1] and not out[3].removed
    assert out[2].text.split() == "Start two. End two.".split() and passage.endswith(rows[1][1][out[2].removed[0].start : out[2].removed[0].end][-20:])
    back = substring_dedup.dedup(odd)
    assert back.count() == len(ROWS) and set(odd.columns) < set(back.columns)
    assert {r.text for r in back.where("doc_id <= 5").collect()} == {t for i, t in ROWS if i and i <= 5}
    assert substring_dedup.dedup(none).count() == 0


def test_substring_dedup_brute_force(spark, sf):
    docs = table(spark, sf, "documents")
    seen, want = set(), {}
    for r in docs.orderBy("doc_id").collect():
        drop = np.zeros(len(r.text) + 1, np.int64)
        for a, b, digest in substring_dedup.spans(r.text, 3, 25):
            if digest in seen:
                drop[a] += 1
                drop[b] -= 1
            seen.add(digest)
        gone = np.cumsum(drop)[:-1] > 0
        want[r.doc_id] = "".join(c for c, g in zip(r.text, gone) if not g)
    assert {r.doc_id: r.text for r in substring_dedup.dedup(docs).collect()} == want


def test_substring_dedup_inside_long_sentences(spark):
    """A passage without stops that begins after a differing number of words, with and without other scripts' stops."""
    rng = random.Random(4)
    new = lambda n: [f"w{rng.randrange(10**9)}" for _ in range(n)]
    for stop in ("", "。"):
        passage = " ".join(w + stop * (i % 9 == 8) for i, w in enumerate(new(60)))
        rows = [(i, " ".join([*new(10 + i), passage, *new(30 - i)])) for i in range(26)]
        out = {r.doc_id: r for r in substring_dedup.dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
        assert out[0].text == rows[0][1] and not out[0].removed
        for i, text in rows[1:]:
            gone = " ".join(text[r.start : r.end] for r in out[i].removed)
            assert gone in passage and len(gone.split()) >= 35


def test_substring_dedup_all_runs(spark):
    """Against every run of 3 sentences or more and of 2 with 25 words, by its own cutting of texts without long sentences."""
    rng = random.Random(6)
    pool = [" ".join(f"p{i}_{k}" for k in range(rng.randint(1, 25))) + "." for i in range(60)]
    pool[:4] = [" ".join(f"p{i}_{k}" for k in range(n)) + "." for i, n in enumerate((12, 14, 15, 5))]
    texts = [pool[:4], ["First here.", *pool[:4], "Last here."]]
    for i in range(60):
        at = rng.randrange(4, 50)
        texts.append([f"Begins {i}.", *pool[at : at + rng.randint(1, 9)], f"Parts {i}.", *pool[at // 2 : at // 2 + 4], f"Ends {i}."])
    seen, want = set(), {}
    for d, sentences in enumerate(texts):
        gone = set()
        for i in range(len(sentences)):
            for j in range(i + 2, len(sentences) + 1):
                run = " ".join(sentences[i:j])
                if j - i >= 3 or len(run.split()) >= 25:
                    if run in seen:
                        gone |= set(range(i, j))
                    seen.add(run)
        want[d] = [s for i, s in enumerate(sentences) if i not in gone]
    assert want[1] == ["First here.", "Last here."]
    docs = spark.createDataFrame([(d, " ".join(s)) for d, s in enumerate(texts)], "doc_id long, text string")
    assert {r.doc_id: r.text.split() for r in substring_dedup.dedup(docs).collect()} == {d: " ".join(s).split() for d, s in want.items()}


def test_substring_dedup_cuts_repeated_words(spark):
    for p in (1, 2, 3, 4, 7):
        words = [f"v{i % p}" for i in range(400)]
        rows = [(i, " ".join([f"own{i}_{k}" for k in range(i)] + words)) for i in range(1, 9)]
        out = {r.doc_id: r.text.split() for r in substring_dedup.dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
        assert all(len(out[i]) < i + 60 for i in range(2, 9))


def test_warc(spark):
    rows = [(1, "http://a", "x"), (2, None, "x"), (3, "u", None), (4, "u", ""), (None, "u", "y"), (2, None, "x")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    path = warc.write_archive(pages, warc.scratch_path(spark, "test"))
    got = sorted([tuple(r) for r in warc.index(spark, path).select("page_id", "payload_bytes", "record_type", "refers_to").collect()], key=str)
    assert got == sorted([(1, 1, "revisit", 2), (2, 1, "response", None), (2, 1, "response", None), (3, 0, "revisit", 4), (4, 0, "response", None), (None, 1, "response", None)], key=str)
    records = {(r.page_id, bytes(r.payload)) for r in warc.read_records(spark, path).collect()}
    assert records == {(i, (h or "").encode()) for i, _, h in rows} and warc.read_payloads(spark, path).count() == 3
    assert {r.record_type for r in warc.archive(pages, least=5).collect()} == {"response"}
    assert warc.archive(pages.limit(0)).count() == 0


def test_licenses_brute_force(spark, sf, odd, none):
    docs = table(spark, sf, "documents").select("doc_id", "text").unionByName(odd.select("doc_id", "text")).unionByName(spark.createDataFrame([(100_000, "the mit license general public license General-Public LICENSE mit")], "doc_id long, text string"))
    want = Counter()
    for r in docs.collect():
        w = re.findall(licenses.WORDS, (r.text or "").translate({i: i + 32 for i in range(65, 91)}))
        at = [i for t in licenses.BASE for i in range(len(w)) if w[i : i + len(t.words.split())] == t.words.split()]
        want[r.doc_id, len(w), len(at), min(at, default=None), max(at, default=None)] += 1
    found = licenses.scan(docs).collect()
    base = [[s for s in r.spans if s.base] for r in found]
    assert want == Counter((r.doc_id, r.n_words, len(b), min((s.start for s in b), default=None), max((s.start for s in b), default=None)) for r, b in zip(found, base))
    assert licenses.scan(none).count() == 0


def test_license_notice_with_a_word_added(spark):
    text = "so: permission is hereby granted, free of any charge, to any person obtaining a copy of this software and associated documentation files"
    spans = licenses.scan(spark.createDataFrame([(1, text)], "doc_id long, text string")).first().spans
    assert [s.label for s in spans] == ["mit-text"]


def test_chat_round_trip(spark):
    bad = ["</s>[INST] ok [/INST]", "\\</s>", "\\\\[SEP]\\", "<</s>s>", " [SEP] ", "", None, "a\nb", "<s>"]
    rows = [(1, i, ["user", "assistant", "assistant"][i % 3], t) for i, t in enumerate(bad)] + [(2, 0, None, "x"), (2, 0, "user", "x"), (2, None, "assistant", "y"), (None, 0, "a [/INST] b", "z")]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("formatted", F.lit(1))
    out = {r.conv_id: r for r in chat.read_chats(chat.format_chats(turns)).collect()}
    assert [(t.role, t.text) for t in out[1].turns] == [(r, t or "") for _, _, r, t in rows[: len(bad)]]
    assert out[1].loss_text == "".join(t or "" for _, _, r, t in rows[: len(bad)] if r == "assistant")
    assert [(t.role, t.text) for t in out[2].turns] == [("assistant", "y"), ("", "x"), ("user", "x")] and out[None].turns[0].role == "a [/INST] b"
    assert chat.format_chats(turns.limit(0)).count() == 0


def shingles(text, width=3):
    w = re.findall("[^\x20\x09-\x0d]+", (text or "").translate({i: i + 32 for i in range(65, 91)}))
    return {tuple(w[i : i + width]) for i in range(max(1, len(w) - width + 1))} if w else set()


def components(rows, least=85, width=3):
    sets = [shingles(t, width) for _, t in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            if a and 100 * len(a & sets[j]) >= least * len(a | sets[j]):
                root[find(i)] = find(j)
    least_of = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least_of[find(i)] = min(least_of.get(find(i), d), d)
    return [(d, len(s), least_of.get(find(i), d)) for i, ((d, _), s) in enumerate(zip(rows, sets))]


def test_near_dedup_brute_force(spark, odd, none):
    rng = random.Random(3)
    base = [f"w{rng.randrange(3000)}" for _ in range(140)]
    rows = list(ROWS)
    for i in range(120):  # near the threshold: few links, many members of a key
        words = [w for w in base if rng.random() > 0.035]
        rows.append((100 + i, " ".join(words)))
    rows += [(300 + i, " ".join(f"z{i}_{k}" for k in range(n))) for i, n in enumerate((1, 2, 3, 600))] + [(310, " ".join(f"z3_{k}" for k in range(590)))]
    for i in range(30):  # sets of so few shingles that the prefix filter finds them
        words = [f"q{i}_{k}" for k in range(14)]
        rows += [(400 + 2 * i, " ".join(words)), (401 + 2 * i, " ".join(words[: 14 - i % 3]))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = Counter(tuple(r) for r in near_dedup.link(docs, reps=2, block=4).select("doc_id", "n_shingles", "component_id").collect())
    assert got == Counter(components(rows))
    assert near_dedup.link(none).count() == 0 and near_dedup.dedup(odd).columns == odd.columns


def test_dedup_by_rows(spark):
    """Rows with null or shared ids: unrelated texts stay, one row of each group stays."""
    w = lambda k, n=40: " ".join(f"{k}{i}" for i in range(n))
    for far in (w("a") + " z", w("a").replace(" ", "\t")):  # a near and an exact copy
        rows = [(1, w("a"), "x"), (None, far, "y"), (None, w("b"), "clean"), (2, w("c"), "x"), (7, w("d"), "x"), (7, w("e"), "clean")]
        rows += [(None, w("f"), "r1"), (None, w("f"), "r2"), (None, far.replace("a", "f"), "r3"), (9, w("g"), "r1"), (9, far.replace("a", "g"), "r2"), (None, None, "n"), (5, w("h"), "x"), (5, w("h"), "x")]
        rows += [(6, w("d"), "x")]
        docs = spark.createDataFrame(rows, "doc_id long, text string, note string")
        near = "\t" not in far
        kept = (near_dedup if near else exact_dedup).dedup(docs)
        assert kept.columns == docs.columns
        got = Counter((r.doc_id, (r.text or "")[:1]) for r in kept.collect())
        assert got == Counter({(1, "a"): 1, (None, "b"): 1, (2, "c"): 1, (6, "d"): 1, (7, "e"): 1, (None, "f"): 1, (9, "g"): 1, (None, ""): 1, (5, "h"): 2})
    blank = spark.createDataFrame([(None, None), (None, None), (None, " ")], "doc_id long, text string")
    assert near_dedup.dedup(blank).count() == 3 and exact_dedup.dedup(blank).count() == 1


def test_register_estimate():
    rng = np.random.default_rng(1)
    found = []
    for _ in range(60):
        u = rng.integers(0, 2**64, 1000, dtype=np.uint64)
        a, b = np.unique(u[75:]), np.unique(u[:-75])
        ra, rb = near_dedup.registers(a), near_dedup.registers(b)
        found.append(near_dedup.estimate(ra[None], rb[None], np.array([len(a)]), np.array([len(b)]))[0])
    assert abs(np.mean(found) - 0.85) < 0.02


def test_exact_dedup(odd, none):
    got = Counter(tuple(r) for r in exact_dedup.decide(odd).select("doc_id", "keep_id", "group_size", "kept").collect())
    want = Counter({(i, 3, 3, i == 3): 1 for i in (1, 2, 3)})
    want.update({(4, 4, 2, True): 1, (None, 4, 2, False): 1, (5, 5, 2, True): 2} | {(i, i, 1, True): 1 for i in (6, 7, 8, 9)})
    assert got == want
    kept = exact_dedup.dedup(odd)
    assert kept.columns == odd.columns and sorted(r.doc_id for r in kept.collect()) == [3, 4, 5, 5, 6, 7, 8, 9]
    assert exact_dedup.decide(none).count() == 0


def test_best_fill_is_optimal():
    rng = random.Random(2)
    for _ in range(200):
        counts = Counter(rng.randint(1, 30) for _ in range(rng.randint(1, 8)))
        picked = packing.best_fill(counts, sorted(counts), 40)
        assert all(picked[k] <= counts[k] for k in picked)
        sums = {0}
        for v in counts.elements():
            sums |= {s + v for s in sums if s + v <= 40}
        assert sum(k * n for k, n in picked.items()) == max(sums)


def test_packing(spark, sf, odd, none):
    docs = table(spark, sf, "documents").select("doc_id", "text").unionByName(odd.where("doc_id IS NOT NULL").select((F.col("doc_id") + 10_000).alias("doc_id"), "text").distinct())
    pieces = packing.pack(docs, pool=16).collect()
    ids = {r.doc_id: ids_of(r.text) for r in docs.collect()}
    by_doc, by_seq = {}, {}
    for p in pieces:
        assert p.ids_crc32 == zlib.crc32(np.array(ids[p.doc_id][p.start : p.start + p.length], "<u4").tobytes()) and p.doc_tokens == len(ids[p.doc_id])
        by_doc.setdefault(p.doc_id, []).append((p.start, p.length))
        by_seq.setdefault(p.sequence_id, []).append((p.offset, p.length))
    for d, parts in by_doc.items():
        assert [s for s, _ in sorted(parts)] == [0, *np.cumsum([n for _, n in sorted(parts)])[:-1]] and sum(n for _, n in parts) == len(ids[d])
    for parts in by_seq.values():
        total = sum(n for _, n in parts)
        assert [s for s, _ in sorted(parts)] == [0, *np.cumsum([n for _, n in sorted(parts)])[:-1]] and total & (total - 1) == 0 and total <= 4096
    assert set(by_doc) == set(ids) and packing.pack(none).count() == 0


def test_language_id(spark, sf, odd, none):
    docs = table(spark, sf, "documents")
    rows = queries.op8_language_id(spark, sf).join(docs.select("doc_id", "lang"), "doc_id").where("held_out").collect()
    assert sum(r.lang == r.lang_pred for r in rows) / len(rows) > 0.95 and all(0 <= r.score <= 1 for r in rows)
    model = langid.train(docs, docs_per_lang=20)
    out = {r.doc_id: r.lang_pred for r in langid.predict(odd, model).collect()}
    assert out[1] == out[2] == out[3] == "und" and out[6] in model.langs
    assert langid.train(none) is None and {r.lang_pred for r in langid.predict(odd, None).collect()} == {"und"}
    kept = langid.keep_identified(odd, model)
    assert kept.columns == odd.columns and kept.count() == len(ROWS) - 3


def test_token_store(spark, odd, none):
    path = tokenstore.write_store(odd, tokenstore.scratch_path(spark, "test"))
    want, at = [], 0
    for i, t in sorted(ROWS, key=lambda r: (r[0] is not None, r[0] or 0)):
        ids = ids_of(t)
        want.append((i, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        at += len(ids)
    got = tokenstore.verified_digests(spark, path).orderBy("start").select("doc_id", "start", "n_tokens", "ids_crc32").collect()
    assert [tuple(r) for r in got] == want
    whole = tokenstore.read_documents(spark, path).orderBy("start").select("doc_id", "start", "n_tokens", F.crc32("ids")).collect()
    assert [tuple(r) for r in whole] == want
    assert tokenstore.read_chunks(spark, path).count() < tokenstore.read_recipes(spark, path).count()
    assert tokenstore.store_and_read(none).count() == 0


def test_decontamination(spark, odd, none):
    item = "one two three four five six seven eight nine ten eleven"
    items = spark.createDataFrame([(1, item), (2, "short item"), (3, None), (4, "..."), (None, "x")], "item_id long, text string")
    docs = spark.createDataFrame([(1, "Zero ONE two, three-four five six seven eight nine TEN! eleven. é short item"), (2, "one two three"), (3, "shorty items")], "doc_id long, text string")
    for chars in (1 << 20, 30):  # one block, several blocks
        out = {r.doc_id: r for r in decontaminate.find_contamination(docs, items, block_chars=chars).collect()}
        assert (out[1].n_words, out[1].n_hit, out[1].items) == (15, 13, [1, 2]) and out[2].n_hit == out[3].n_hit == 0
        text = docs.first().text
        assert [text[s.start : s.end] for s in out[1].spans] == ["ONE two, three-four five six seven eight nine TEN! eleven", "short item"]
        assert sorted(r.doc_id for r in decontaminate.decontaminate(docs, items, block_chars=chars).collect()) == [2, 3]
    assert decontaminate.find_contamination(odd, items).count() == len(ROWS) and decontaminate.find_contamination(none, items.limit(0)).count() == 0


def test_pipeline(spark, sf):
    docs = table(spark, sf, "documents")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    out = corpus_pipeline.run(spark, sf)
    norm = lambda t: re.sub("[\x20\x09-\x0d]", "", t or "")
    best = {}
    for d, t in rows:
        if t and any(c.isalpha() for c in t) and (norm(t) not in best or (-len(t), d) < best[norm(t)][0]):
            best[norm(t)] = ((-len(t), d), (d, t))
    left = [x for _, x in best.values()]
    keep = {d for d, _, c in components(left, 80, 5) if d == c}
    items = {w for r in table(spark, sf, "benchmark").collect() for w in decontaminate.windows(decontaminate.words_of(r.text), 10)}
    keep = {d for d, t in left if d in keep and not items & set(decontaminate.windows(decontaminate.words_of(t), 10))}
    assert {r.doc_id for r in out.select("doc_id").distinct().collect()} == keep
