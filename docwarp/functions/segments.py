"""Greedy segmentation of rows by running sums, for all lists of a batch at once."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F


def reachable(follow: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Which nodes are met by going from ``starts`` along ``follow`` (each node's next one; the last node follows itself).

    The hops double: after k rounds all nodes within 2^k hops of a start are marked, so a list's length costs its logarithm.
    """
    met = np.zeros(len(follow), bool)
    met[starts] = True
    hops = 1
    while hops < len(follow):
        met[follow[met]] = True
        follow = follow[follow]
        hops *= 2
    return met


def greedy_starts(weights: np.ndarray, heads: np.ndarray, barriers: np.ndarray, limit: int) -> np.ndarray:
    """Which rows begin a segment: at each barrier, and where a segment's head and the weights of its rows would go beyond ``limit``.

    A segment holds at least one row. The first row is a barrier.
    """
    n = len(weights)
    if n == 0:
        return np.zeros(0, bool)
    upto = np.concatenate([[0], np.cumsum(weights)])
    edges = np.append(np.flatnonzero(barriers), n)
    end = edges[np.searchsorted(edges, np.arange(n), side="right")]
    fits = np.searchsorted(upto, upto[:-1] + limit - heads, side="right") - 1  # the first row that the sum no longer holds
    follow = np.minimum(np.maximum(fits, np.arange(n) + 1), end)
    return reachable(np.append(follow, n), edges[:-1])[:n]


def _of_lists(limit: int):
    def run(rows: pa.Array) -> pa.Array:
        flat = rows.flatten()
        sizes = rows.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
        offsets = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)
        number = lambda c: flat.field(c).to_numpy(zero_copy_only=False)
        barriers = number("barrier").astype(bool)
        barriers[offsets[:-1][sizes > 0]] = True
        at = np.flatnonzero(greedy_starts(number("n").astype(np.int64), number("head").astype(np.int64), barriers, limit))
        cuts = np.searchsorted(at, offsets)
        inside = at - np.repeat(offsets[:-1], np.diff(cuts))
        ends = np.repeat(np.diff(offsets), np.diff(cuts))  # a segment ends where the next one of its list begins
        ends[:-1] = np.where(inside[1:] > 0, inside[1:], ends[:-1])
        spans = pa.StructArray.from_arrays([pa.array(inside + 1, pa.int32()), pa.array(ends - inside, pa.int32())], ["at", "n"])
        return pa.ListArray.from_arrays(pa.array(cuts, pa.int32()), spans)

    return run


def segments(rows: Column, weight, head, barrier, limit: int) -> Column:
    """The array ``rows`` as an array of greedy segments of at most ``limit``; only numbers go through Python.

    ``weight`` and ``head`` give a row's numbers (of a segment the first row's head counts), ``barrier`` of a row and the one before
    it (null at the first) whether a segment begins there in any case.
    """
    numbers = F.transform(rows, lambda x, i: F.struct(
        weight(x).cast("long").alias("n"), head(x).cast("long").alias("head"), F.coalesce(barrier(x, F.get(rows, i - 1)), F.lit(True)).alias("barrier")))
    spans = F.arrow_udf(_of_lists(limit), "array<struct<at:int,n:int>>")(numbers)
    return F.transform(spans, lambda s: F.slice(rows, s["at"], s["n"]))
