"""Packing of token sequences by minimum bin slack.

Every document's ids (then an end id) are cut into pieces and the pieces fill windows of ``capacity`` tokens. The pieces
still to place form a multiset of lengths; for each window the largest length is fixed and a subset-sum over bit sets
(one Python integer per step, binary-split counts) picks the multiset of remaining lengths whose sum comes closest to the
capacity; the counts are backtracked from the stored sets. Any slack that is left is closed by cutting one more piece.
What is left at the end of a task is cut into sequences whose lengths are powers of two, which are never padded. So no
sequence has padding, no shuffle is needed, and a task holds at most ``pool`` pieces at a time.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort
from collections import deque
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from docwarp.llm.tokens import encoder, tokenizer_json

SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def best_fill(counts: dict[int, int], lengths: list[int], capacity: int) -> dict[int, int]:
    """How many pieces of each length to take so that their sum comes closest to ``capacity`` from below. ``lengths``: sorted keys of ``counts``."""
    mask, reach, steps = (1 << (capacity + 1)) - 1, 1, []
    for at in range(bisect_left(lengths, capacity + 1) - 1, -1, -1):
        length = lengths[at]
        left, take = min(counts[length], capacity // length), 1
        while left > 0:
            n = min(take, left)
            steps.append((length, n, reach))
            reach |= (reach << (length * n)) & mask
            left -= n
            take *= 2
        if reach >> capacity & 1:
            break
    at, picked = reach.bit_length() - 1, {}
    for length, n, before in reversed(steps):
        if not before >> at & 1:
            at -= length * n
            picked[length] = picked.get(length, 0) + n
    return picked


class Pool:
    """Pieces waiting for a window, by length."""

    def __init__(self, capacity: int):
        self.capacity, self.by, self.lengths, self.counts = capacity, {}, [], {}
        self.pieces = self.tokens = 0

    def add(self, piece: tuple) -> None:
        n = len(piece[3])
        if not self.counts.get(n):
            insort(self.lengths, n)
            self.by[n] = deque()
        self.by[n].append(piece)
        self.counts[n] = self.counts.get(n, 0) + 1
        self.pieces += 1
        self.tokens += n

    def take(self, n: int) -> tuple:
        self.pieces -= 1
        self.tokens -= n
        self.counts[n] -= 1
        piece = self.by[n].popleft()
        if not self.counts[n]:
            del self.counts[n], self.by[n], self.lengths[bisect_left(self.lengths, n)]
        return piece

    def cut(self, n: int) -> tuple:
        """The first ``n`` tokens of the shortest longer piece; the rest stays."""
        at = bisect_left(self.lengths, n)
        doc, start, total, ids = self.take(self.lengths[at])
        if len(ids) > n:
            self.add((doc, start + n, total, ids[n:]))
        return doc, start, total, ids[:n]

    def window(self) -> list[tuple]:
        """Pieces that fill one window exactly. The pool holds at least a window's tokens."""
        largest = self.lengths[-1]
        out, room = [self.take(largest)], self.capacity - largest
        if room and self.lengths:
            for n, k in best_fill(self.counts, self.lengths, room).items():
                out += [self.take(n) for _ in range(k)]
                room -= n * k
        return out + ([self.cut(room)] if room else [])

    def tail(self) -> Iterator[list[tuple]]:
        """What is left, as sequences of power-of-two lengths."""
        while self.tokens:
            room, out = 1 << (min(self.tokens, self.capacity).bit_length() - 1), []
            while room:
                n = min(room, self.lengths[-1])
                out.append(self.cut(n))
                room -= n
            yield out


def pack(
    docs: DataFrame, tokenizer_path: str | None = None, capacity: int = 4096, end_id: int = 2, pool: int = 4096, with_ids: bool = False
) -> DataFrame:
    """One row per piece: ``doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset`` (and ``ids`` if asked for).

    ``docs`` needs ``doc_id`` and ``text``; other columns are ignored. Null or empty text: the end id alone. Repeated rows
    and repeated ids are packed once per row. Null ``doc_id`` stays null. An empty table gives no rows. Texts of any length
    are encoded in bounded slices. ``sequence_id`` is unique over the whole result.
    """
    if capacity < 1 or capacity & (capacity - 1):
        raise ValueError("capacity must be a power of two")
    spec = docs.sparkSession.sparkContext.broadcast(tokenizer_json(tokenizer_path))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, waiting = encoder(spec.value), Pool(capacity)
        seq, rows = TaskContext.get().partitionId() << 40, []

        def close(pieces: list[tuple]) -> None:
            nonlocal seq
            at = 0
            for doc, start, total, ids in pieces:
                crc = zlib.crc32(ids.astype("<u4").tobytes())
                rows.append((doc, start, len(ids), crc, total, seq, at, *([ids.astype(np.int32)] if with_ids else [])))
                at += len(ids)
            seq += 1

        def flush() -> pa.RecordBatch:
            names = [c.split()[0] for c in SCHEMA.split(", ")]
            out = [pa.array([r[i] for r in rows], pa.int64()) for i in range(len(names))]
            if with_ids:
                names.append("ids")
                out.append(pa.array([r[-1] for r in rows], pa.list_(pa.int32())))
            rows.clear()
            return pa.RecordBatch.from_arrays(out, names)

        for batch in batches:
            doc_ids = batch.column(0).to_pylist()
            for at, n, ids, sizes in enc.encode(batch.column(1)):
                ends = np.cumsum(sizes)
                for k in range(n):
                    own = np.append(ids[ends[k] - sizes[k] : ends[k]], np.uint32(end_id)).astype(np.uint32)
                    doc, total = doc_ids[at + k], len(own)
                    whole = total - total % capacity
                    for s in range(0, whole, capacity):
                        close([(doc, s, total, own[s : s + capacity])])
                    if total > whole:
                        waiting.add((doc, whole, total, own[whole:]))
                    while waiting.pieces > pool and waiting.tokens >= capacity:
                        close(waiting.window())
                if len(rows) > (500 if with_ids else 20_000):
                    yield flush()
        while waiting.tokens >= capacity:
            close(waiting.window())
        for pieces in waiting.tail():
            close(pieces)
        yield flush()

    return docs.select("doc_id", "text").mapInArrow(run, SCHEMA + (", ids array<int>" if with_ids else ""))
