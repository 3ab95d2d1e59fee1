"""The registered queries of the training-data operators, with DuckDB SQL where it can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docwarp.llm import align, chat, collocations, decontaminate, exact_dedup, langid, licenses, near_dedup, packing, pii, substring_dedup, tokenstore, warc
from docwarp.llm.common import table

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

WORDS = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[name] = f
        if sql is not None:
            ORACLES[name] = sql
        return f

    return add


@query("op7_packing")
def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"))


def held_out() -> Column:
    """A null doc_id is not held out."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2, F.lit(False))


@query("op8_language_id")
def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = langid.train(docs.where(~held_out()))
    return langid.predict(docs, model).select("doc_id", held_out().alias("held_out"), "lang_pred", "score")


@query("op9_token_store")
def op9_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokenstore.store_and_read(table(spark, sf_dir, "documents")).select("doc_id", "start", "n_tokens", "ids_crc32")


@query(
    "op10_decontamination",
    f"""
WITH dw AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{WORDS}') AS w FROM documents),
iw AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{WORDS}') AS w FROM benchmark WHERE item_id IS NOT NULL),
win AS (SELECT DISTINCT item_id, least(len(w), 10) AS n, array_to_string(w[i : i + 9], ' ') AS win FROM iw, unnest(generate_series(1, greatest(len(w) - 9, 1))) AS t(i) WHERE len(w) > 0),
sizes AS (SELECT DISTINCT n FROM win),
places AS (SELECT doc_id, i, n, array_to_string(w[i : i + n - 1], ' ') AS win FROM dw, sizes, unnest(generate_series(1, len(w) - n + 1)) AS t(i) WHERE len(w) >= n),
found AS (SELECT p.doc_id, p.i, p.n, win.item_id FROM places p JOIN win ON p.n = win.n AND p.win = win.win),
hits AS (SELECT doc_id, count(DISTINCT i + k) AS n_hit FROM found, unnest(generate_series(0, n - 1)) AS t(k) GROUP BY doc_id),
items AS (SELECT doc_id, count(*) AS n_items, string_agg(id, ',' ORDER BY id) AS ids FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS id FROM found) GROUP BY doc_id)
SELECT dw.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM dw LEFT JOIN hits USING (doc_id) LEFT JOIN items USING (doc_id)
""",
)
def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.find_contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), with_spans=False)
    ids = F.array_sort(F.transform("items", lambda i: i.cast("string")))
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join(ids, ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"),
    )


@query(
    "op2_warc_archive",
    """
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS b FROM pages),
d AS (SELECT page_id, octet_length(b) AS n, sha1(b) AS h, sha256(b) AS s FROM p),
w AS (SELECT s, max(page_id) AS first_id FROM d GROUP BY s),
digits AS (SELECT page_id, string_agg(substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST((v >> k) & 31 AS INTEGER) + 1, 1), '' ORDER BY g, k DESC) AS b32
  FROM (SELECT page_id, g, CAST('0x' || substr(h, g * 5 + 1, 5) AS BIGINT) AS v FROM d, unnest(generate_series(0, 7)) AS t(g)), unnest([15, 10, 5, 0]) AS u(k) GROUP BY page_id)
SELECT d.page_id, CAST(n AS BIGINT) AS payload_bytes, b32 AS payload_digest, CASE WHEN d.page_id = first_id THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN d.page_id <> first_id THEN first_id END AS refers_to
FROM d JOIN w USING (s) JOIN digits ON digits.page_id = d.page_id
""",
)
def op2_warc_archive(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.archive(table(spark, sf_dir, "pages"))


_LABELS = "array_sort(array_distinct(transform({}, s -> s.label)))"


@query("op3_license_scan")
def op3_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = licenses.scan(table(spark, sf_dir, "documents")).withColumn("base", F.filter("spans", lambda s: s["base"]))
    starts = F.transform("base", lambda s: s["start"])
    return found.select(
        "doc_id", "n_words", F.size("base").cast("long").alias("n_base"), F.array_min(starts).alias("first_word"), F.array_max(starts).alias("last_word"),
        F.array_join(F.expr(_LABELS.format("base")), ",").alias("base_labels"), F.array_join(F.expr(_LABELS.format("spans")), ",").alias("labels"),
        F.coalesce(F.array_max(F.transform("spans", lambda s: s["score"])), F.lit(0.0)).alias("score"),
    )


_ESCAPED = r"regexp_replace({}, '(\\*(?:</?s>|\[/?INST\]|\[SEP\]))', '\\\1', 'g')"


@query(
    "op4_chat_format",
    f"""
WITH t AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'),
p AS (SELECT *, lag(role) OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS before FROM t)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(length({_ESCAPED.format('text')}) + CASE WHEN before = role THEN 7 ELSE 24 + length({_ESCAPED.format('role')}) END) AS BIGINT) AS formatted_chars
FROM p GROUP BY conv_id
""",
)
def op4_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = "</s>[INST] ok [/INST]"
    more = spark.createDataFrame([(-1, 0, "user", said), (-1, 1, "assistant", said)], "conv_id long, turn long, role string, text string")
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(more)
    read = chat.read_chats(chat.format_chats(turns))
    flat = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return read.select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(flat, 256).alias("turns_sha256"), F.char_length("loss_text").cast("long").alias("loss_chars"),
        F.sha2("loss_text", 256).alias("loss_sha256"), F.char_length("formatted").cast("long").alias("formatted_chars"),
    )


@query(
    "op6_exact_dedup",
    r"""
WITH n AS (SELECT doc_id, length(coalesce(text, '')) AS chars, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS norm FROM documents),
k AS (SELECT norm, arg_max(doc_id, (chars, -doc_id)) AS keep_id, count(*) AS group_size FROM n GROUP BY norm)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(norm) AS text_sha256 FROM n JOIN k USING (norm)
""",
)
def op6_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.decide(table(spark, sf_dir, "documents"))


@query(
    "op5_minhash_near_dedup",
    r"""
WITH RECURSIVE d AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(w[i : i + 2], ' ') AS s FROM d, unnest(generate_series(1, greatest(len(w) - 2, 1))) AS t(i) WHERE len(w) > 0),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
e AS (SELECT a, b FROM (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM s x JOIN s y ON x.s = y.s AND x.doc_id <> y.doc_id GROUP BY 1, 2) JOIN n AS p ON p.doc_id = a JOIN n AS q ON q.doc_id = b WHERE 100 * c >= 85 * (p.n + q.n - c)),
r AS (SELECT doc_id, doc_id AS other FROM d UNION SELECT r.doc_id, e.b FROM r JOIN e ON r.other = e.a)
SELECT d.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, c.component_id, d.doc_id = c.component_id AS kept
FROM d LEFT JOIN n USING (doc_id) JOIN (SELECT doc_id, min(other) AS component_id FROM r GROUP BY doc_id) c USING (doc_id)
""",
)
def op5_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.link(table(spark, sf_dir, "documents"))


@query("op1_substring_dedup")
def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", F.char_length("text").cast("long").alias("n_chars"))
    cleaned = substring_dedup.dedup(docs)
    return cleaned.select(
        "doc_id", "n_chars", F.char_length("text").cast("long").alias("n_kept"), F.size("removed").cast("long").alias("n_removed"),
        F.array_join(F.transform("removed", lambda r: F.concat_ws("-", r["start"], r["end"])), ",").alias("removed_chars"), "text",
    )


@query(
    "op11_collocations",
    r"""
WITH t AS (SELECT coalesce(lang, 'und') AS lang, string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]') AS ps FROM documents),
p AS (SELECT lang, list_filter(string_split_regex(piece, '[\x20\x09]+'), lambda x: x <> '') AS w FROM (SELECT lang, unnest(ps) AS piece FROM t)),
total AS (SELECT lang, sum(len(w)) AS n FROM p GROUP BY lang),
f AS (SELECT lang, k, array_to_string(w[i : i + k - 1], ' ') AS phrase, any_value(w[i : i + k - 1]) AS w, count(*) AS n
  FROM p, unnest(generate_series(1, 5)) AS s(k), unnest(generate_series(1, len(w) - k + 1)) AS u(i) WHERE len(w) >= k GROUP BY 1, 2, 3 HAVING count(*) >= 100),
c AS (SELECT * FROM f WHERE k > 1),
inside AS (SELECT DISTINCT c.lang, array_to_string(w[i : i + m - 1], ' ') AS phrase, n FROM c, unnest(generate_series(2, k - 1)) AS s(m), unnest(generate_series(1, k - m + 1)) AS u(i)),
kept AS (SELECT * FROM c WHERE NOT EXISTS (SELECT 1 FROM inside WHERE inside.lang = c.lang AND inside.phrase = c.phrase AND 100 * inside.n >= 100 * c.n)),
cuts AS (SELECT kept.lang, kept.phrase, kept.n AS a, j, x.n AS l, y.n AS r, total.n AS n,
    (CAST(1000 AS HUGEINT) * kept.n * total.n) // (CAST(x.n AS HUGEINT) * y.n) AS score
  FROM kept JOIN total USING (lang), unnest(generate_series(1, k - 1)) AS s(j)
  JOIN f AS x ON x.lang = kept.lang AND x.phrase = array_to_string(kept.w[:j], ' ') JOIN f AS y ON y.lang = kept.lang AND y.phrase = array_to_string(kept.w[j + 1 :], ' ')),
best AS (SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, j) = 1)
SELECT lang, CAST(rank AS BIGINT) AS rank, phrase, CAST(a AS BIGINT) AS a, CAST(l AS BIGINT) AS l, CAST(r AS BIGINT) AS r, CAST(n AS BIGINT) AS n, CAST(score AS BIGINT) AS score
FROM (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM best) WHERE rank <= 2000
""",
)
def op11_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.mine(table(spark, sf_dir, "documents"))


@query("op12_pii")
def op12_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = pii.find(docs, pii.train(docs)).withColumn("base", F.filter("spans", lambda s: s["base"]))
    counts = [F.expr(f"CAST(size(filter(base, s -> s.kind = '{k}')) AS long)").alias(f"n_{k}") for k in pii.KINDS]
    return found.select("doc_id", *counts, F.sha2(pii.listed(F.col("base")), 256).alias("base_sha256"), pii.listed(F.col("spans")).alias("spans"))


@query("op13_token_alignment")
def op13_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return align.align(table(spark, sf_dir, "documents"))


@query("pipeline")
def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)
