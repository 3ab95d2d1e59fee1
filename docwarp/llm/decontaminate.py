"""Benchmark decontamination with Aho-Corasick automata over normalised windows of the test items.

Text and items are normalised alike: A-Z lower-cased, words ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` joined by single spaces. A window is
``width`` consecutive item words; an item with fewer words (but not none) is one window. One automaton holds all windows and
scans each text once. Its size is checked: items are put into blocks of at most ``block_chars`` characters of windows (an automaton
takes some 50 bytes for each), one automaton per block. For a benchmark beyond one block a task holds a bounded part of its texts and
scans it with the blocks' automata in turn: one worker a task and one automaton a worker, whatever the benchmark, with the same result.
Blocks hold the items' words, cut with overlap where an item is longer; the driver sees one at a time.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.core.broadcast import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docwarp.llm.common import LOWER_BYTES

_DELIMITERS = bytes([*range(0x00, 0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x80)])
#: One pass: delimiters become spaces, A-Z become a-z, bytes of other characters stay.
NORMAL = LOWER_BYTES.translate(bytes(0x20 if b in _DELIMITERS else b for b in range(256)))
WORD = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")
SCHEMA = "doc_id long, n_words long, n_hit long, items array<long>, spans array<struct<start:long,end:long>>"


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode().translate(NORMAL).split()


def windows(words: list[bytes], width: int) -> Iterator[bytes]:
    for i in range(max(1, len(words) - width + 1) if words else 0):
        yield b" ".join(words[i : i + width])


Block = list[tuple[int, bytes]]


def blocks(items: Iterator, width: int, block_chars: int) -> Iterator[Block]:
    """(item_id, words joined by spaces) of the items, in blocks whose windows have a bounded number of characters; never cut inside a window."""
    block: Block = []
    used = 0
    for item_id, text in items:
        words = words_of(text)
        start = 0
        for i, w in enumerate(windows(words, width)):
            if used and used + len(w) > block_chars:
                if i > start:
                    block.append((item_id, b" ".join(words[start : i + width - 1])))
                yield block
                block, used, start = [], 0, i
            used += len(w)
        if words:
            block.append((item_id, b" ".join(words[start:])))
    if block:
        yield block


_AUTOMATA: dict[str, object] = {}


def _automaton(value: Broadcast, key: str, width: int):
    """The automaton of one block; a worker process holds one at a time, and the block only while it is built."""
    if key not in _AUTOMATA:
        import ahocorasick

        _AUTOMATA.clear()
        owners: dict[bytes, set[int]] = {}
        for item_id, words in value.load_from_path(value._path) if value._path else value.value:
            for w in windows(words.split(b" "), width):
                owners.setdefault(w, set()).add(item_id)
        auto = ahocorasick.Automaton()
        for w, ids in owners.items():
            auto.add_word(f" {w.decode('latin-1')} ", (len(w) + 2, w.count(b" ") + 1, tuple(ids)))
        auto.make_automaton()
        _AUTOMATA[key] = auto
    return _AUTOMATA[key]


def _found(auto, words: list[bytes]) -> list:
    """(end offset, (size, words, items)) of every occurrence, overlapping ones too."""
    return list(auto.iter(f" {b' '.join(words).decode('latin-1')} ")) if words and len(auto) else []


def _runs(words: list[bytes], found: list, runs: list[dict]) -> list[dict]:
    """Runs [start, end) of hit words: those of ``found`` and earlier ``runs`` together."""
    starts = np.cumsum([1, *(len(w) + 1 for w in words)])  # of each word in the normalised text
    mark = np.zeros(len(words) + 1, np.int64)
    for end, (size, n, _) in found:
        first = int(np.searchsorted(starts, end - size + 2))
        mark[first] += 1
        mark[first + n] -= 1
    for r in runs:
        mark[r["start"]] += 1
        mark[r["end"]] -= 1
    edges = np.flatnonzero(np.diff(np.concatenate([[0], (np.cumsum(mark)[:-1] > 0).astype(np.int8), [0]])))
    return [{"start": int(a), "end": int(b)} for a, b in zip(edges[::2], edges[1::2], strict=True)]


_LOWER = {ord(c): c.lower() for c in map(chr, range(65, 91))}
_SPANS = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
#: Bytes of text that a task holds while the automata of a benchmark beyond one block are built for it in turn.
HELD = 64_000_000


def _parts(batches: Iterator[pa.RecordBatch], held: int) -> Iterator[pa.RecordBatch]:
    """Batches joined until they have ``held`` bytes."""
    some: list[pa.RecordBatch] = []
    for batch in batches:
        some.append(batch)
        if sum(b.nbytes for b in some) >= held:
            yield pa.concat_batches(some)
            some = []
    if some:
        yield pa.concat_batches(some)


def _automata(benchmark: DataFrame, width: int, block_chars: int) -> tuple[list[tuple[Broadcast, str]], int]:
    """The benchmark's blocks as (broadcast, key), and the bytes of text to hold: none for one block, whose automaton a worker keeps."""
    context = benchmark.sparkSession.sparkContext
    found = [(context.broadcast(block), uuid.uuid4().hex) for block in _blocks_of(benchmark, width, block_chars)]
    return found, HELD if len(found) > 1 else 0


def _blocks_of(benchmark: DataFrame, width: int, block_chars: int) -> Iterator[Block]:
    """The benchmark streams through the driver, a bounded block at a time. An empty benchmark is one empty block."""
    rows = benchmark.where(F.col("item_id").isNotNull()).select("item_id", "text").toLocalIterator()
    found = blocks(((r[0], r[1]) for r in rows), width, block_chars)
    yield next(found, [])
    yield from found


def find_contamination(
    docs: DataFrame, benchmark: DataFrame, width: int = 10, block_chars: int = 2_000_000, with_spans: bool = True
) -> DataFrame:
    """One row per row of ``docs``: ``doc_id, n_words, n_hit, items`` (sorted ids of items with an occurring window) and ``spans``
    of hit words as character offsets [start, end) in the original text (empty without ``with_spans``).

    Null and empty texts have no words and are clean. Repeated rows give a row each. Items without words never match; null
    item ids are left out. With no items at all every document is clean. Extra columns are ignored. Very long texts are
    scanned whole.
    """
    automata, held = _automata(benchmark, width, block_chars)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in _parts(batches, held):
            n, texts = part.num_rows, part.column(1)
            counts, items = np.zeros(n, np.int64), [set() for _ in range(n)]
            runs: list[list[dict]] = [[] for _ in range(n)]
            for value, key in automata:
                auto = _automaton(value, key, width)
                for i in range(n):
                    words = words_of(texts[i].as_py())
                    counts[i] = len(words)
                    found = _found(auto, words)
                    if found:
                        runs[i] = _runs(words, found, runs[i])
                        items[i].update(k for _, x in found for k in x[2])
            hits = [sum(r["end"] - r["start"] for r in own) for own in runs]
            spans: list[list[dict]] = [[] for _ in range(n)]
            for i in np.flatnonzero(hits) if with_spans else ():
                at = [m.span() for m in WORD.finditer(texts[int(i)].as_py().translate(_LOWER))]
                spans[i] = [{"start": at[r["start"]][0], "end": at[r["end"] - 1][1]} for r in runs[i]]
            columns = [part.column(0), pa.array(counts), pa.array(hits, pa.int64()), pa.array(map(sorted, items), pa.list_(pa.int64())), pa.array(spans, _SPANS)]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_words", "n_hit", "items", "spans"])

    return docs.select("doc_id", "text").mapInArrow(run, SCHEMA)


def decontaminate(docs: DataFrame, benchmark: DataFrame, width: int = 10, block_chars: int = 2_000_000) -> DataFrame:
    """``docs`` without the rows that hold any window of a benchmark item. All columns of the rest stay, extra ones too."""
    at = docs.columns.index("text")
    automata, held = _automata(benchmark, width, block_chars)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in _parts(batches, held):
            texts, clean = part.column(at), np.ones(part.num_rows, bool)
            for value, key in automata:
                auto = _automaton(value, key, width)
                for i in np.flatnonzero(clean):
                    clean[i] = not _found(auto, words_of(texts[int(i)].as_py()))
            yield part.filter(pa.array(clean))

    return docs.mapInArrow(run, docs.schema)
