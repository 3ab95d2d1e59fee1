"""Phrase collocations from one count of padded longest windows.

Every word opens one window: itself and, as lead columns, the words after it up to ``most`` of them or the end of its piece;
missing words are padded with ''. Equal windows are counted once, and Spark's ROLLUP over the window's columns sums successively
shorter prefixes: the sum over a prefix of k words is the number of occurrences of that phrase, overlaps included, as each
occurrence opens exactly one window. No n-gram of any order is exploded by itself.

A window also ends where no candidate can go on. Before, two passes count phrases by hash in fixed arrays of counters: words and
pairs first, then longer phrases of pairs that are left. A counter is never less than the count of any phrase in it, so a phrase
whose counter stays under ``least`` is no candidate or part of one, and windows are padded there (wholly, at a rare word). Results
do not depend on it; it keeps what is shuffled near the number of frequent phrases as long as the arrays are not crowded: about
one counter for ten words of the corpus. They have ``counters`` bytes each in a task and an eighth of that as bits, the
only thing that is broadcast.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from docwarp.llm.common import LOWER_BYTES, written

#: What a byte of a text is: part of a word, a gap between words, or the end of a piece.
_KINDS = np.zeros(256, np.uint8)
_KINDS[[0x20, 0x09]] = 1
_KINDS[list(b".,;:!?\x0a\x0b\x0c\x0d")] = 2
_LOWER = np.frombuffer(LOWER_BYTES, np.uint8)
SLICE, CHUNK = 4 << 20, 1 << 16
ROWS = 1 << 19  # windows that a task holds before it adds up equal ones


def _mix(x: np.ndarray) -> np.ndarray:
    """Scatter 64-bit numbers."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def slices(batch: pa.RecordBatch, size: int = SLICE) -> Iterator[tuple[pa.Array, pa.Array]]:
    """(texts, langs) of rows with about ``size`` bytes of text together, or one longer text."""
    texts, langs = pc.fill_null(batch.column(0), ""), pc.fill_null(batch.column(1), "und")
    ends = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False).astype(np.int64))
    at = 0
    while at < len(texts):
        end = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + size, "right")))
        yield texts.slice(at, end - at), langs.slice(at, end - at)
        at = end


class Words:
    """The words of some texts as numbers: ``names`` (distinct words), ``langs`` (distinct languages), ``code`` and ``lang`` of each
    occurrence, ``goes_on`` (the next word is in the same piece)."""

    def __init__(self, texts: pa.Array, langs: pa.Array):
        end = [pa.scalar(x, pa.large_string()) for x in ("", "\n")]
        lines = pc.binary_join_element_wise(texts.cast(pa.large_string()), *end)  # each text ends its last piece
        ends_of = np.frombuffer(lines.buffers()[1], np.int64, len(texts) + 1, 8 * lines.offset)
        data = _LOWER[np.frombuffer(lines.buffers()[2], np.uint8)[ends_of[0] : ends_of[-1]]]
        kind = _KINDS[data]
        word = kind == 0
        edge = np.flatnonzero(np.diff(np.concatenate([[False], word, [False]]).view(np.int8)))
        starts, ends = edge[::2], edge[1::2]
        offsets = np.concatenate([[0], np.cumsum(ends - starts)])
        words = pa.LargeStringArray.from_buffers(len(starts), pa.py_buffer(offsets), pa.py_buffer(data[word]))
        found = words.dictionary_encode()
        self.names, self.code = found.dictionary, found.indices.to_numpy().astype(np.int64)
        pieces = np.flatnonzero(kind == 2)
        at = np.searchsorted(pieces, starts)
        self.goes_on = np.concatenate([at[1:] == at[:-1], [False]]) if len(starts) else np.zeros(0, bool)
        spoken = langs.dictionary_encode()
        self.langs = spoken.dictionary
        self.lang = spoken.indices.to_numpy().astype(np.int64)[np.searchsorted(ends_of[1:] - ends_of[0], starts, "right")]

    def _hashes(self, names: pa.Array) -> np.ndarray:
        import xxhash

        return np.fromiter((xxhash.xxh3_64_intdigest(x) for x in names.to_pylist()), np.uint64, len(names))

    def chains(self, most: int, *allowed: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(k, places, hashes of language and phrase) of the phrases of k words, k from 1 to ``most``. The counters that are given, of up
        to two words and of more, cut off what they do not allow; phrases go on only where the part after their first word does."""
        names, langs = self._hashes(self.names), self._hashes(self.langs)
        at, marks = np.arange(len(self.code)), _mix(names[self.code] + _mix(langs)[self.lang])
        names = _mix(names)
        for k in range(1, most + 1):
            if k > 1:
                goes = self.goes_on[at + k - 2]
                if k > 2:
                    goes = goes & left[at + 1]  # noqa: F821
                at, marks = at[goes], marks[goes]
                marks = _mix(marks * np.uint64(3) + names[self.code[at + k - 1]])
            which = 0 if k < 3 else 1
            if which < len(allowed):
                bits = allowed[which]
                may = bits[marks & np.uint64(len(bits) - 1)]
                at, marks = at[may], marks[may]
            yield k, at, marks
            left = np.zeros(len(self.code) + 1, bool)
            left[at] = True


def _few(docs: DataFrame) -> DataFrame:
    """Texts and languages in at most one task a core: a task gives what it counts once, however often it has it, so fewer rows leave the
    more of the texts a task reads. It holds no more for it."""
    rows, cores = docs.select("text", "lang"), docs.sparkSession.sparkContext.defaultParallelism
    return rows.coalesce(cores) if rows.rdd.getNumPartitions() > cores else rows


def bounds(docs: DataFrame, orders: tuple[int, int], least: int, counters: int, before: np.ndarray | None = None) -> np.ndarray:
    """One bit per counter: whether the phrases of so many words in it (both included) may reach ``least`` together. ``before`` are the
    bits for words and pairs. The array has a fixed size, whatever the input."""
    chunk, full = min(CHUNK, counters), min(least, 255)
    bits = None if before is None else docs.sparkSession.sparkContext.broadcast(np.packbits(before))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = np.zeros(counters, np.uint8)
        allowed = () if bits is None else (np.unpackbits(bits.value).astype(bool),)
        for batch in batches:
            for texts, langs in slices(batch):
                for k, _, marks in Words(texts, langs).chains(orders[1], *allowed):
                    if k >= orders[0]:
                        slots, n = np.unique(marks & np.uint64(counters - 1), return_counts=True)
                        own[slots] = np.minimum(own[slots] + np.minimum(n, 255), full)
        used = np.flatnonzero(own.reshape(-1, chunk).any(axis=1))
        for part in np.array_split(used, max(1, len(used) // 64)):
            packed = [pa.compress(own[k * chunk : (k + 1) * chunk].tobytes(), "zstd", asbytes=True) for k in part]
            yield pa.RecordBatch.from_arrays([pa.array(part, pa.int32()), pa.array(packed, pa.binary())], ["part", "counts"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, total = None, None
        bits = lambda: pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([np.packbits(total >= full).tobytes()], pa.binary())], ["part", "bits"])
        for batch in batches:
            for k, blob in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if k != part:
                    if part is not None:
                        yield bits()
                    part, total = k, np.zeros(chunk, np.uint16)
                total = np.minimum(total + np.frombuffer(pa.decompress(blob, chunk, "zstd"), np.uint8), full).astype(np.uint16)
        if part is not None:
            yield bits()

    parts = docs.select("text", "lang").mapInArrow(count, "part int, counts binary")
    merged = parts.repartition("part").sortWithinPartitions("part").mapInArrow(add, "part int, bits binary")
    out = np.zeros((counters // chunk, chunk // 8), np.uint8)
    for row in merged.collect():  # counters / 8 bytes in all
        out[row["part"]] = np.frombuffer(row["bits"], np.uint8)
    return np.unpackbits(out.ravel()).astype(bool)


def _rank(values: np.ndarray) -> np.ndarray:
    return np.unique(values, return_inverse=True)[1].astype(np.int64)


def combined(batches: Iterator[pa.RecordBatch], rows: int = ROWS) -> Iterator[pa.RecordBatch]:
    """Rows with their last column, n, summed over equal ones; about ``rows`` are held, and what stays above half of it goes out as it is."""
    held: list[pa.RecordBatch] = []

    def added() -> pa.RecordBatch:
        *keys, n = held[0].schema.names
        table = pa.Table.from_batches(held).group_by(keys, use_threads=False).aggregate([(n, "sum")])
        return table.select([*keys, f"{n}_sum"]).rename_columns([*keys, n]).combine_chunks().to_batches()[0]

    for batch in batches:
        if batch.num_rows:
            held.append(batch)
        if sum(x.num_rows for x in held) > rows:
            held = [added()]
            if held[0].num_rows > rows // 2:
                yield held.pop()
    if held:
        yield added()


def emitted(docs: DataFrame, most: int, *allowed: np.ndarray) -> DataFrame:
    """lang, w1 .. w<most>, n: the padded longest windows of a task's texts and how often it has each; equal ones are added up before they leave."""
    names = [f"w{i + 1}" for i in range(most)]
    bits = docs.sparkSession.sparkContext.broadcast([np.packbits(x) for x in allowed])

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        may = [np.unpackbits(x).astype(bool) for x in bits.value]
        for batch in batches:
            for texts, langs in slices(batch):
                words = Words(texts, langs)
                length = np.zeros(len(words.code), np.int8)
                for k, at, _ in words.chains(most, *may):
                    length[at] = k
                vocabulary = len(words.names) + 1
                lead = np.concatenate([words.code, np.full(most, -1)])
                # windows of at most one word are counted by number (the last one is the padding), longer ones column by column
                short, longer = np.flatnonzero(length < 2), np.flatnonzero(length > 1)
                first_word = np.where(length[short] == 0, vocabulary - 1, words.code[short])
                single, counts = np.unique(words.lang[short] * vocabulary + first_word, return_counts=True)
                columns, key = [lead[longer]], _rank(words.lang[longer] * vocabulary + lead[longer])
                for i in range(1, most):
                    columns.append(np.where(length[longer] > i, lead[longer + i], -1))
                    key = _rank(key * vocabulary + columns[-1] + 1)
                _, first, n = np.unique(key, return_index=True, return_counts=True)
                texts_of = pa.concat_arrays([words.names.cast(pa.string()), pa.array([""])])  # -1 is the padding
                take = lambda c: texts_of.take(pa.array(np.where(c < 0, len(texts_of) - 1, c)))
                pad = np.full(len(single), -1)
                rows = [words.langs.take(pa.array(np.concatenate([single // vocabulary, words.lang[longer][first]])))]
                rows += [take(np.concatenate([single % vocabulary if i == 0 else pad, c[first]])) for i, c in enumerate(columns)]
                yield pa.RecordBatch.from_arrays([*rows, pa.array(np.concatenate([counts, n]), pa.int64())], ["lang", *names, "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in combined(found(batches)):
            for at in range(0, table.num_rows, 50_000):
                yield table.slice(at, 50_000)

    kinds = ", ".join(f"{c} string" for c in ["lang", *names])
    return docs.select("text", "lang").mapInArrow(run, f"{kinds}, n long")


def windows(docs: DataFrame, most: int, *allowed: np.ndarray) -> DataFrame:
    """lang, w1 .. w<most>, n: the padded longest windows of all texts and how often each occurs."""
    names = [f"w{i + 1}" for i in range(most)]
    return emitted(docs, most, *allowed).groupBy("lang", *names).agg(F.sum("n").alias("n"))


def frequencies(docs: DataFrame, most: int = 5, least: int = 100, counters: int = 1 << 25) -> DataFrame:
    """lang, words (how many; 0: the language as a whole), phrase (space-joined), n: all phrases of up to ``most`` words that occur
    ``least`` times in a language, and the number of all its words."""
    docs, names = _few(docs), [f"w{i + 1}" for i in range(most)]
    allowed = [bounds(docs, (1, 2), least, counters)]
    if most > 2:
        allowed.append(bounds(docs, (3, most), least, counters, *allowed))
    sums = docs.sparkSession.sql(
        f"SELECT lang, {', '.join(names)}, sum(n) AS n FROM {{windows}} GROUP BY lang, ROLLUP ({', '.join(names)})",
        windows=windows(docs, most, *allowed),
    )
    length = sum(F.col(c).isNotNull().cast("int") for c in names)
    # a prefix that ends in padding is a shorter phrase's row, which is counted at its own length
    whole = F.coalesce(*[F.col(c) for c in reversed(names)], F.lit("-")) != ""
    phrase = F.array_join(F.array(*names), " ")
    kept = sums.where(whole & ((F.col("n") >= least) | F.col("w1").isNull()))
    return written(kept.select("lang", length.alias("words"), phrase.alias("phrase"), "n"), "phrases")


def mine(docs: DataFrame, most: int = 5, least: int = 100, percent: int = 100, top: int = 2000, counters: int = 1 << 25, salts: int = 64) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: each language's first ``top`` phrases of 2 to ``most`` words with a >= ``least`` occurrences.

    A-Z are lower-cased; words are runs of anything but blanks and tabs inside pieces, which end at ``[.,;:!?\\x0A-\\x0D]``. l and r count
    the parts before and after the cut with the lowest score floor(1000 * a * n / (l * r)), the first such cut on ties; n counts all
    words of the language. Phrases inside a longer candidate with ``percent`` of their occurrences or more are left out. Order: score
    and a descending, phrase ascending in UTF-8 bytes. Null texts are empty, a null lang is ``und``; repeated rows count again;
    an empty table gives no rows; extra columns are ignored. ``counters`` must be a power of two of at least 8.
    """
    found = frequencies(docs, most, least, counters)
    phrases = found.where("words > 0")
    candidates = phrases.where("words > 1").select("lang", "phrase", F.split("phrase", " ").alias("w"), F.col("n").alias("a"))
    # what lies inside a longer candidate, with the most occurrences of such
    pieces = F.expr(
        "explode(array_distinct(flatten(transform(sequence(2, size(w) - 1), k -> transform(sequence(1, size(w) - k + 1), i -> array_join(slice(w, i, k), ' ')))))) AS phrase"
    )
    inside = candidates.where("size(w) > 2").select("lang", pieces, "a").groupBy("lang", "phrase").agg(F.max("a").alias("longer"))
    wide = lambda c: F.col(c).cast("decimal(20,0)")
    left = candidates.join(inside, ["lang", "phrase"], "left").where(F.col("longer").isNull() | (100 * wide("longer") < percent * wide("a")))
    # both parts of each cut
    cuts = left.select("lang", "phrase", "w", "a", F.explode(F.sequence(F.lit(1), F.size("w") - 1)).alias("k"))
    cuts = cuts.select("lang", "phrase", "a", "k", F.expr("array_join(slice(w, 1, k), ' ')").alias("first"), F.expr("array_join(slice(w, k + 1, size(w) - k), ' ')").alias("rest"))
    for part, name in (("first", "l"), ("rest", "r")):
        cuts = cuts.join(phrases.select("lang", F.col("phrase").alias(part), F.col("n").alias(name)), ["lang", part])
    totals = found.where("words = 0").select("lang", "n")
    scored = cuts.join(totals, "lang").withColumn("score", F.expr("(1000 * (CAST(a AS decimal(18,0)) * CAST(n AS decimal(17,0)))) div (CAST(l AS decimal(18,0)) * CAST(r AS decimal(18,0)))"))
    best = scored.groupBy("lang", "phrase", "a", "n").agg(F.min(F.struct("score", "k", "l", "r")).alias("cut")).select("lang", "phrase", "a", "cut.l", "cut.r", "n", "cut.score")
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    for part in (["lang", F.pmod(F.xxhash64("phrase"), F.lit(salts))], ["lang"]):  # the first of each salt, then of those
        best = best.withColumn("rank", F.row_number().over(Window.partitionBy(*part).orderBy(*order))).where(F.col("rank") <= top)
    return best.select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", F.col("score").cast("long").alias("score"))
