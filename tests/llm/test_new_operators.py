"""Phrase collocations, personal data and token alignment: brute force, edge cases, hot groups."""

import hashlib
import random
import re
from bisect import bisect_left
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from docwarp.llm import align, collocations, common, near_dedup, pii, queries, substring_dedup
from docwarp.llm.common import table
from docwarp.llm.tokens import _byte_alphabet

LONG = " ".join(f"word{i} thing" for i in range(40_000))
DOCS = "doc_id long, text string, lang string, batch string, phrase string, spans string, n long, mark string, row string"
ROWS = [(1, None), (2, ""), (3, " \n\t "), (4, "a.b@c.org a.b@c.org +1 (555) 555-0100"), (4, "a.b@c.org a.b@c.org +1 (555) 555-0100"), (5, LONG), (None, "x 1.2.3.4"), (6, "é" * 5000)]


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls, blanks, repeated rows, a null id, very long texts, extra columns with clashing names."""
    return spark.createDataFrame([(i, t, None, "b", "p", "s", 5, "m", "r") for i, t in ROWS], DOCS)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], DOCS)


# --- phrases ---------------------------------------------------------------------------------------------------------------


def phrases(rows, most, least, percent, top):
    """The definition, in plain Python."""
    count, total, out = defaultdict(Counter), Counter(), []
    for text, lang in rows:
        lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", lower):
            words = re.findall(r"[^\x20\x09]+", piece)
            total[lang or "und"] += len(words)
            for k in range(1, most + 1):
                for i in range(len(words) - k + 1):
                    count[lang or "und"][tuple(words[i : i + k])] += 1
    for lang, f in count.items():
        n, found = total[lang], {p: a for p, a in f.items() if len(p) > 1 and a >= least}
        longer = Counter()
        for p, a in found.items():
            for part in {p[i : i + k] for k in range(2, len(p)) for i in range(len(p) - k + 1)}:
                longer[part] = max(longer[part], a)
        rows = []
        for p, a in found.items():
            if 100 * longer[p] < percent * a:
                cuts = [(1000 * a * n // (f[p[:k]] * f[p[k:]]), k, f[p[:k]], f[p[k:]]) for k in range(1, len(p))]
                score, _, left, right = min(cuts)
                rows.append((-score, -a, " ".join(p).encode(), left, right))
        out += [(lang, rank, p.decode(), -a, left, right, n, -s) for rank, (s, a, p, left, right) in enumerate(sorted(rows)[:top], 1)]
    return sorted(out)


@pytest.mark.parametrize(("least", "percent", "counters"), [(3, 100, 1 << 16), (2, 60, 8), (5, 100, 64)])
def test_collocations_brute_force(spark, least, percent, counters):
    """Also with arrays of counters so small that nearly everything shares one."""
    r = random.Random(least)
    words = ["the", "The", "of", "new", "york", "é", "\x0b", "a.b", "x,", "city!", "\t", "\x00z"]
    rows = [(" ".join(r.choice(words) for _ in range(r.randint(0, 40))), r.choice(["en", "de", None, "und"])) for _ in range(120)] + [(None, "en"), ("", None)]
    docs = spark.createDataFrame([(t, lang, 1) for t, lang in rows], "text string, lang string, n long").repartition(3)
    got = sorted(map(tuple, collocations.mine(docs, 4, least, percent, 50, counters).collect()))
    assert got == phrases(rows, 4, least, percent, 50) and len(got) > 20


def test_collocations_edges(odd, none, spark):
    assert collocations.mine(none).count() == 0
    rows = collocations.mine(odd, least=2).collect()
    assert {r.lang for r in rows} == {"und"} and "a b@c" not in {r.phrase for r in rows}
    hot = spark.range(3000).select(F.lit("very common pair here").alias("text"), F.lit("en").alias("lang")).repartition(6)
    only = collocations.mine(hot).collect()
    assert [(r.phrase, r.a, r.l, r.r, r.n, r.score) for r in only] == [("very common pair here", 3000, 3000, 3000, 12000, 4000)]


def test_collocations_add_up_equal_windows_of_a_task(spark):
    """A task that reads several batches gives a window once, not once a batch."""
    docs = spark.range(30_000).select(F.lit("a few words").alias("text"), F.lit("en").alias("lang")).coalesce(1)
    got = sorted(map(tuple, collocations.emitted(docs, 3).collect()))
    assert got == [("en", "a", "few", "words", 30_000), ("en", "few", "words", "", 30_000), ("en", "words", "", "", 30_000)]
    rows = pa.RecordBatch.from_pydict({"w": [str(i % 7) for i in range(20)], "n": [1] * 20})
    for limit in (4, 10, 100):  # also where too many different rows are held
        sums = Counter()
        for batch in collocations.combined(iter([rows, rows]), limit):
            for row in batch.to_pylist():
                sums[row["w"]] += row["n"]
        assert sums == Counter({str(i): 2 * sum(k % 7 == i for k in range(20)) for i in range(7)})


# --- personal data ---------------------------------------------------------------------------------------------------------


def patterns(text):
    out = [(m.start(), 0, m.end()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    out += [(m.start(), 1, m.end()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if all(int(p) <= 255 for p in m[0].split("."))]
    for kind, pattern, low, high in ((2, r"[0-9]([\x20-]?[0-9])+", 12, 19), (3, r"\+[0-9][\x20().0-9-]+[0-9]", 9, 15)):
        for m in re.finditer(pattern, text):
            digits = [int(c) for c in re.sub("[^0-9]", "", m[0])]
            check = sum(digits[-1::-2]) + sum(sum(divmod(2 * d, 10)) for d in digits[-2::-2])
            if low <= len(digits) <= high and (kind == 3 or check % 10 == 0):
                out.append((m.start(), kind, m.end()))
    return sorted(out)


def test_patterns_equal_the_given_ones():
    r = random.Random(7)
    parts = ["0000", "1.2.3.4", "256.1.1.1", "a@b.c", "4111111111111111", "+1 (555) 555-0100", "٣", "é"]
    for _ in range(20_000):
        text = "".join(r.choice("0123456789 .@+-()aZ_%\n") if r.random() < 0.8 else r.choice(parts) for _ in range(r.randint(1, 40)))
        assert pii.base_spans(text) == patterns(text), text
    assert pii.base_spans("a" * 300_000 + "@ " + "1" * 300_000 + " +" + "(" * 300_000) == []  # linear


def exact(model, nodes):
    """Marginals by summing over all labellings."""
    unary, n = pii.features(nodes) @ model.unary, len(nodes.doc)
    weights = np.zeros((n, pii.LABELS))
    for labels in np.ndindex(*[pii.LABELS] * n):
        score = sum(unary[i, y] for i, y in enumerate(labels)) + sum(model.chain[labels[a], labels[b]] for a, b in nodes.chain) + sum(model.skip[labels[a], labels[b]] for a, b in nodes.skip)
        for i, y in enumerate(labels):
            weights[i, y] += np.exp(score)
    return weights / weights.sum(axis=1, keepdims=True)


def test_message_passing_is_exact_without_loops(spark, sf):
    """Chain and skip links of a tree; with a loop it comes near."""
    rng = np.random.default_rng(1)
    skip = rng.normal(size=(5, 5))
    model = pii.Model(rng.normal(size=(3 * len(pii._TRAITS) + 3, 5)) * 0.3, rng.normal(size=(5, 5)), skip + skip.T)
    tree = pii.nodes_of(["12345678 9 then 12345678 and a@b.cd far from x@b.cd"])
    assert len(tree.chain) == 1 and len(tree.skip) == 2
    assert np.allclose(pii.beliefs(model, tree, 60), exact(model, tree), atol=1e-5)
    loop = pii.nodes_of(["12345678 9 12345678"])
    assert np.abs(pii.beliefs(model, loop, 60) - exact(model, loop)).max() < 0.2


def test_pii(spark, sf, odd, none):
    docs = table(spark, sf, "documents")
    model = pii.train(docs)
    assert {r.doc_id: r.spans for r in pii.find(docs, model).collect()}.keys() == {r.doc_id for r in docs.collect()}
    for r, text in ((r, {d.doc_id: d.text for d in docs.collect()}[r.doc_id]) for r in queries.op12_pii(spark, sf).collect()):
        base = patterns(text or "")
        names = [f"{pii.KINDS[k]}:{a}:{b}" for a, k, b in base]
        assert r.base_sha256 == hashlib.sha256(",".join(names).encode()).hexdigest() and set(names) <= set(r.spans.split(","))  | {""}
        assert (r.n_email, r.n_ip, r.n_card, r.n_phone) == tuple(sum(k == i for _, k, _ in base) for i in range(4))
    text = "call +1 (743) 555-3824 4465758382889437 now, version 3.0 of 2024"
    assert pii.base_spans(text) == []  # they run into each other
    found = pii.find(spark.createDataFrame([(1, text)], "doc_id long, text string"), model)
    assert [(s.kind, text[s.start : s.end], s.base) for s in found.first().spans] == [("phone", "+1 (743) 555-3824", False), ("card", "4465758382889437", False)]
    assert found.select(pii.redact(F.lit(text), F.col("spans"))).first()[0] == "call [phone] [card] now, version 3.0 of 2024"
    assert pii.find(none, model).count() == 0 and pii.find(odd, pii.train(none)).count() == len(ROWS)


# --- tokens ----------------------------------------------------------------------------------------------------------------


def aligned(rows):
    """The definition, text by text."""
    import public_tokenizers
    import sentencepiece
    from tokenizers import Tokenizer

    a = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    a.encode_special_tokens = True
    b = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    back = {c: x for x, c in _byte_alphabet().items()}
    docs, counts = [], Counter()
    for i, text in rows:
        ids = a.encode(" " + (text or ""), add_special_tokens=False).ids, b.encode(text or "")
        raw = [bytes(back[c] for c in a.id_to_token(x)) for x in ids[0]], [bytes([int(b.id_to_piece(x)[1:-1], 16)]) if b.IsByte(x) else b.id_to_piece(x).replace("▁", " ").encode() for x in ids[1]]
        groups = []
        if text and all(b"".join(x) == (" " + text).encode() for x in raw):
            at = [np.cumsum([len(x) for x in side]).tolist() for side in raw]
            cuts = sorted(set(at[0]) & set(at[1]))
            groups = [([], []) for _ in cuts]
            for side in (0, 1):
                for token, end in zip(ids[side], at[side], strict=True):
                    groups[bisect_left(cuts, end)][side].append(token)
        docs.append((i, groups))
        counts.update({(x, y) for u, v in groups for x in u for y in v})
    best = Counter()
    for (x, _), n in counts.items():
        best[x] = max(best[x], n)
    out = []
    for i, groups in docs:
        links = [(x, y) for u, v in groups for x in u for y in v]
        told = ";".join(",".join(map(str, u)) + "|" + ",".join(map(str, v)) for u, v in groups)
        digest = hashlib.sha256(told.encode()).hexdigest() if groups else ""
        out.append((i, sum(len(u) for u, _ in groups), sum(len(v) for _, v in groups), len(groups), len(links), sum(counts[x] == best[x[0]] for x in links), sum(counts[x] for x in links), digest))
    return sorted(out, key=repr)


def test_alignment_brute_force(spark, sf):
    odd = [None, "", " ", "  ", "a", "  two  blanks ", "tab\t x", "x \t y", "nb  x", "　 x  y", "a▁b", "don't <|endoftext|> </s> <0x0A>", "日本語 テスト 😀😀", "line\nnext\r\n\n last ", "x" * 5000, "ab " * 300, "é à ḯ \x00 \x1f y", "\x85 x\x85 y", "€ £  z ﻿ q", "ſ ΑΣ … — “q” ", "ab " * 300]
    docs = table(spark, sf, "documents").select("doc_id", "text").unionByName(spark.createDataFrame([(10_000 + i, t) for i, t in enumerate(odd)], "doc_id long, text string"))
    got = sorted((tuple(r) for r in align.align(docs.repartition(3)).collect()), key=repr)
    assert got == aligned([(r.doc_id, r.text) for r in docs.collect()])


def test_pointer_jumping():
    r = random.Random(4)
    for _ in range(300):
        n = r.randint(1, 40)
        ends = [np.array(sorted({n, *r.sample(range(1, n + 1), r.randint(0, n - 1))})) for _ in range(2)]
        cuts = sorted(set(ends[0]) & set(ends[1]))
        of_a, of_b, groups = align.jump(*ends)
        assert groups == len(cuts) and [of_a.tolist(), of_b.tolist()] == [[bisect_left(cuts, e) for e in side] for side in ends]
    assert align.jump(np.zeros(0, int), np.zeros(0, int))[2] == 0


def test_alignment_edges(odd, none):
    assert align.align(none).count() == 0
    rows = sorted(map(tuple, align.align(odd).collect()), key=repr)
    assert len(rows) == len(ROWS) and rows == aligned([(i, t) for i, t in ROWS])


def test_near_dedup_keeps_clashing_columns(spark):
    same = " ".join(f"w{i}" for i in range(60))
    rows = [(i, t, "own", "id", 7, "n", "row") for i, t in [(1, same), (2, same), (3, "other words here"), (None, same + " x"), (None, "alone it stands"), (None, "alone it stands")]]
    docs = spark.createDataFrame(rows, "doc_id long, text string, _own string, _id string, _mark long, _n string, row string")
    left = near_dedup.dedup(docs, width=5, percent=80)
    assert left.columns == docs.columns
    assert sorted(map(tuple, left.collect()), key=repr) == sorted([rows[0], rows[2], rows[4]], key=repr)


def test_substring_dedup_short_runs(spark):
    """Every run of several whole sentences counts, however short; of two sentences if asked for; parts of a sentence do not."""
    three = "The quick fox ran home today. Then it slept all night long. It was fine."
    rows = [(1, f"One. {three} Uno."), (2, f"Two. {three} Dos."), (3, "Three. It was fine. The quick fox ran home today. Then it slept all night long. Tres.")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    texts = lambda n: {r.doc_id: r.text.split() for r in substring_dedup.dedup(docs, several=n).collect()}
    assert texts(3) == {1: rows[0][1].split(), 2: ["Two.", "Dos."], 3: rows[2][1].split()}
    assert texts(2) == {1: rows[0][1].split(), 2: ["Two.", "Dos."], 3: "Three. It was fine. Tres.".split()}
    for text in ("to " * 40, " ".join(f"w{i}" for i in range(24))):
        pairs = spark.createDataFrame([(1, text), (2, text)], "doc_id long, text string")
        assert (substring_dedup.dedup(pairs).where("doc_id = 2").first().text.strip() == "") == (text.count(" ") > 30)


def test_join_split(spark, monkeypatch):
    """Hot and null keys spread over tasks; results are those of a plain join."""
    monkeypatch.setattr(common, "HOT_ROWS", 50)
    rows = spark.createDataFrame([(i, b"hot" if i % 2 else bytes([i % 7]) if i % 3 else None) for i in range(3000)], "row_id long, k binary")
    single = spark.createDataFrame([(b"hot", "a"), (b"\x01", "b"), (b"none", "c")], "k binary, v string")
    for how in ("inner", "left"):
        got = common.join_split(rows, single, "k", "row_id", how)
        assert sorted(got.select("row_id", "v").collect()) == sorted(rows.join(single, "k", how).select("row_id", "v").collect())
    assert common._hot(rows.select(F.xxhash64("k").alias("h")).limit(0)) == []
    salts = rows.where("row_id % 2 = 1").select(F.pmod(F.xxhash64("row_id"), F.lit(common.SALTS)).alias("s")).distinct().count()
    assert salts == common.SALTS


def test_collocations_windows_leave_once_a_core(spark, monkeypatch):
    """Equal windows of many splits of a table are added up before they leave."""
    seen, emit = [], collocations.emitted

    def counted(*args):
        seen.append(emit(*args).count())
        return emit(*args)

    monkeypatch.setattr(collocations, "emitted", counted)
    rows = [(f"alpha beta gamma delta. epsilon zeta eta {'theta iota' if i % 2 else 'kappa'}", "en") for i in range(640)]
    docs, cores = spark.createDataFrame(rows, "text string, lang string"), spark.sparkContext.defaultParallelism
    got = [sorted(map(tuple, collocations.frequencies(d, counters=1 << 16).collect())) for d in (docs.coalesce(1), docs.repartition(8 * cores))]
    assert got[0] == got[1] and len(got[0]) > 10 and seen[1] <= cores * seen[0]
