"""Substring deduplication over sliding spans of sentences.

A text is cut into units: sentences (they end after ``. ! ?`` before white space, after the full stops of other scripts, or at a
line's end), and sentences of more than LONG words into parts. Words stand between white space; of scripts without blanks, and of runs
of more than WIDE characters, each character is a word. A part begins at each word whose hash (with the word before) is the least of those at most NEAR words away, so
equal passages are cut alike wherever they begin, but for some words at their ends. A run of units counts if it has ``several`` whole
sentences, of whatever length, or, being two units at least, ``least_words`` words: parts of sentences and pairs of sentences are no
run of several by themselves. A span is the shortest run that counts from a given unit on, or up to it; together they cover whatever
any longer run that repeats does. Every span of every text is hashed (128 bits, over the units' words); equal hashes meet globally, in one
exchange; the first occurrence (smallest doc_id, then position) stays and every unit under another occurrence is removed. Within a
bounded slice of a task's spans all occurrences but the first are known to go already, so that a span which half of the documents
hold sends one row per slice to where its occurrences meet.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from hashlib import blake2b
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

LONG = 25
NEAR = 3  # parts of long sentences have more words than this, equal hashes apart, and 2 * NEAR + 1 on average
WIDE = 200  # longer runs without white space are words by character
#: Characters that end a sentence whatever follows: full stops of scripts that set no blank after them.
_STOPS = "\u3002\uff0e\uff61\uff01\uff1f\u0964\u0965\u104a\u104b\u17d4\u1362\u06d4\u061f"
#: Scripts that put no blanks between words: Thai to Myanmar, Khmer, kana and Han. A character of them is a word.
_CLOSE = "\u0e00-\u109f\u1780-\u17ff\u3040-\u30ff\u31f0-\u31ff\u3400-\u4dbf\u4e00-\u9fff\uf900-\ufaff\U00020000-\U0003ffff"
_SENTENCE = re.compile(rf"[^\n]*?(?:[.!?]+(?=\s)|[{_STOPS}]+)|[^\n]+|\n", re.ASCII)
_WORD = re.compile(rf"[{_CLOSE}]|[^\s{_CLOSE}]+")
_HAS_CLOSE = re.compile(f"[{_CLOSE}]")


def places(text: str, start: int, end: int) -> list[tuple[int, int]]:
    """(start, end) of the words in a part of a text."""
    out: list[tuple[int, int]] = []
    for m in _WORD.finditer(text, start, end):
        a, b = m.span()
        out.extend([(a, b)] if b - a <= WIDE else [(i, i + 1) for i in range(a, b)])
    return out


def cuts(words: list[bytes]) -> list[int]:
    """Where parts of a long sentence begin: its start and the least hashes nearby. Equal hashes all count, so repeated words are cut alike too."""
    hashes = [crc32(w, crc32(v)) for v, w in zip([b"", *words], words)]  # noqa: B905, the last word has no next
    return [0, *(i for i in range(1, len(words)) if hashes[i] <= min(hashes[max(i - NEAR, 0) : i + NEAR + 1]))]


def units(text: str) -> list[tuple[int, int, list[str], bool]]:
    """(start, end, words, whole) of the units with words, by character offsets; ``whole``: a sentence, no part of one."""
    out = []
    close = _HAS_CLOSE.search(text) is not None
    for m in _SENTENCE.finditer(text):
        words = m[0].split()
        if not words:
            continue
        apart = close or max(map(len, words)) > WIDE
        at = places(text, m.start(), m.end()) if apart or len(words) > LONG else []
        if apart:
            words = [text[a:b] for a, b in at]
        if len(words) <= LONG:
            out.append((m.start(), m.end(), words, True))
        else:
            first = cuts([w.encode() for w in words])
            for a, b in zip(first, [*first[1:], len(at)], strict=True):
                out.append((at[a][0], at[b - 1][1], words[a:b], False))
    return out


def spans(text: str, several: int, least_words: int) -> Iterator[tuple[int, int, bytes]]:
    """(start, end, digest) of the shortest spans that begin and that end at each unit, each once and by place; none where the text is too short."""
    found = units(text)
    data = [" ".join(w).encode() for _, _, w, _ in found]
    n_words = np.concatenate([[0], np.cumsum([len(w) for _, _, w, _ in found], dtype=np.int64)]).tolist()
    n_whole = np.concatenate([[0], np.cumsum([whole for _, _, _, whole in found], dtype=np.int64)]).tolist()

    def counts(begin: int, end: int) -> bool:
        return n_whole[end] - n_whole[begin] >= several or (end - begin >= 2 and n_words[end] - n_words[begin] >= least_words)

    shortest: set[tuple[int, int]] = set()
    end = 0
    for begin in range(len(found)):
        while end < len(found) and not counts(begin, end):
            end += 1
        if not counts(begin, end):
            break
        shortest.add((begin, end))
    begin = 0
    for end in range(1, len(found) + 1):
        while counts(begin + 1, end):
            begin += 1
        if counts(begin, end):
            shortest.add((begin, end))
    for begin, end in sorted(shortest):
        yield found[begin][0], found[end - 1][1], blake2b(b" ".join(data[begin:end]), digest_size=16).digest()


SLICE = 500_000  # spans that a task compares at a time
_SPANS = "doc_id long, mark long, at long, h1 long, h2 long, sure boolean"
_AT = 31  # bits of a span's length; its start is above them, so spans sort by start


def _slice(ids: list, marks: list[int], ats: list[int], digests: list[bytes]) -> pa.RecordBatch:
    """A batch of _SPANS. Spans that follow an equal one of the same slice are sure to go; their hashes no longer matter and spread them."""
    pair = np.frombuffer(b"".join(digests), np.int64).reshape(-1, 2).copy()
    doc_ids = pa.array(ids, pa.int64())
    last, ident = np.asarray(doc_ids.is_null()), doc_ids.fill_null(0).to_numpy()
    mark, at = np.array(marks, np.int64), np.array(ats, np.int64)
    sure = np.zeros(len(ids), bool)
    order = np.argsort(pair[:, 0], kind="stable")
    same = np.diff(pair[order, 0]) == 0
    some = order[np.concatenate([same, [False]]) | np.concatenate([[False], same])]
    if len(some):
        keys = np.stack([pair[some, 0], pair[some, 1], last[some], ident[some], mark[some], at[some]])
        by = np.lexsort(keys[::-1])
        keys, some = keys[:, by], some[by]
        begins = np.concatenate([[True], (np.diff(keys[:2]) != 0).any(axis=0)])
        first = np.maximum.accumulate(np.where(begins, np.arange(len(some)), 0))
        sure[some] = (keys[2:] != keys[2:, first]).any(axis=0)  # repeated rows of the first one stay with it
    pair[sure] = np.stack([ident ^ mark, at], axis=1)[sure]
    columns = [doc_ids, pa.array(mark), pa.array(at), pa.array(pair[:, 0]), pa.array(pair[:, 1]), pa.array(sure)]
    return pa.RecordBatch.from_arrays(columns, [c.split()[0] for c in _SPANS.split(", ")])


def find_repeats(docs: DataFrame, several: int = 3, least_words: int = 25) -> DataFrame:
    """``doc_id, mark`` (hash of the text)``, removed``: sorted merged ranges [start, end) of characters under non-first spans; only documents with any."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: tuple[list, list, list, list] = ([], [], [], [])
        for batch in batches:
            ids, marks = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for i in range(batch.num_rows):
                for start, end, digest in spans(batch.column(2)[i].as_py() or "", several, least_words):
                    for column, value in zip(held, (ids[i], marks[i], start << _AT | end - start, digest), strict=True):
                        column.append(value)
                if len(held[0]) > SLICE:
                    yield _slice(*held)
                    held = ([], [], [], [])
        if held[0]:
            yield _slice(*held)

    found = docs.select("doc_id", F.xxhash64("text").alias("mark"), "text").mapInArrow(run, _SPANS)
    place = Window.partitionBy("h1", "h2", "sure").orderBy(F.col("doc_id").isNull(), "doc_id", "mark", "at")
    start = F.shiftright("at", _AT)
    end = start + F.col("at").bitwiseAND(F.lit((1 << _AT) - 1))
    later = found.withColumn("rank", F.rank().over(place)).where("sure OR rank > 1").select("doc_id", "mark", start.alias("start"), end.alias("end"))
    # ranges that touch are one: a range begins where none before reaches
    inside = Window.partitionBy("doc_id", "mark").orderBy("start", "end")
    reach = F.max("end").over(inside.rowsBetween(Window.unboundedPreceding, -1))
    ranges = later.withColumn("new", F.coalesce(F.col("start") > reach, F.lit(True)).cast("int")).withColumn("no", F.sum("new").over(inside))
    merged = ranges.groupBy("doc_id", "mark", "no").agg(F.min("start").alias("start"), F.max("end").alias("end"))
    return merged.groupBy("doc_id", "mark").agg(F.array_sort(F.collect_list(F.struct("start", "end"))).alias("removed"))


def _without(text: pa.Array, removed: pa.Array) -> pa.Array:
    """Texts without their ranges; null where there are none."""
    out = []
    for t, ranges in zip(text.to_pylist(), removed.to_pylist(), strict=True):
        if ranges is None:
            out.append(None)
        else:
            at = [0, *(x for r in ranges for x in (r["start"], r["end"])), len(t)]
            out.append("".join(t[a:b] for a, b in zip(at[::2], at[1::2], strict=True)))
    return pa.array(out, pa.string())


def dedup(docs: DataFrame, several: int = 3, least_words: int = 25) -> DataFrame:
    """``docs``, all columns kept, with ``text`` cleaned and a column ``removed`` (ranges of the original text, maybe none).

    Null and empty texts stay as they are. Repeats within a document count as well. Rows with equal doc_id and text are one
    document and are cleaned alike; a null doc_id comes after all others. An extra column named ``removed`` is replaced. Very
    long texts are processed whole. What was left between removed ranges is joined as it stands.
    """
    repeats = find_repeats(docs, several, least_words).withColumnsRenamed({"doc_id": "id", "mark": "of"})
    kept = [c for c in docs.columns if c != "removed"]
    rows = docs.select(F.struct(*kept).alias("row"), F.col("doc_id"), F.xxhash64("text").alias("own"))  # no name of the table's meets ours
    joined = rows.join(repeats, F.col("doc_id").eqNullSafe(F.col("id")) & (F.col("own") == F.col("of")), "left")
    cleaned = F.arrow_udf(_without, "string")(F.when(F.col("removed").isNotNull(), F.col("row.text")), "removed")
    none = F.array().cast("array<struct<start:long,end:long>>")
    fields = [F.coalesce("cleaned", F.col("row.text")).alias("text") if c == "text" else F.col("row")[c].alias(c) for c in kept]
    return joined.withColumn("cleaned", cleaned).select(*fields, F.coalesce("removed", none).alias("removed"))
