"""Trigram word similarity of many (query, text) pairs at once.

A text is its sequence of trigrams, kept flat with those of all other texts of a batch; sorted by (text, trigram) they are its postings,
which give a query's places in a text by two searches and each place's neighbours of the same trigram. All extents of all pairs then grow
together, one trigram a step, as arrays.
"""

from __future__ import annotations

from functools import cache

import numpy as np

#: Trigrams of texts that pairs may hold together before they are compared.
BLOCK = 8_000_000


@cache
def _word_characters() -> np.ndarray:
    """Whether a code point is a letter or a digit."""
    import regex

    points = [i for i in range(0x110000) if not 0xD800 <= i < 0xE000]
    out = np.zeros(0x110000, bool)
    out[[ord(c) for c in regex.findall(r"[\p{L}\p{N}]", "".join(map(chr, points)))]] = True
    return out


def trigrams_of(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """The trigrams of the padded lower-case words of each text in order, three code points in a number, and where each text's begin (one more
    at the end)."""
    lowered = [(t or "").lower() for t in texts]
    points = np.frombuffer("\0".join(lowered).encode("utf-32-le"), np.uint32)
    inside = _word_characters()[points]
    edges = np.flatnonzero(np.diff(np.concatenate([[False], inside, [False]]).view(np.int8)))
    starts, sizes = edges[::2], edges[1::2] - edges[::2]
    firsts = np.cumsum([0, *(len(t) + 1 for t in lowered)])
    padded = np.full(int(sizes.sum()) + 3 * len(sizes), 32, np.int64)
    at = np.cumsum(sizes + 3) - (sizes + 3)  # each word's place with two blanks before it and one after
    within = np.arange(int(sizes.sum())) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    padded[np.repeat(at + 2, sizes) + within] = points[np.repeat(starts, sizes) + within]
    counts = sizes + 1
    begin = np.repeat(at - (np.cumsum(counts) - counts), counts) + np.arange(int(counts.sum()))
    codes = padded[begin] << 42 | padded[begin + 1] << 21 | padded[begin + 2]
    words = np.searchsorted(starts, firsts)  # words before each text
    return codes, np.concatenate([[0], np.cumsum(counts)])[words]


def _slices(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """start .. start + count - 1 of each, one after the other."""
    return np.repeat(starts - (np.cumsum(counts) - counts), counts) + np.arange(int(counts.sum()))


def similarities(texts: list[str | None], queries: list[str | None], text_of: np.ndarray, query_of: np.ndarray, least: float = 0.0) -> np.ndarray:
    """Word similarity of the pairs (``text_of``, ``query_of``): the best |Q and E| / |Q or E| of any extent E of the text's trigrams.

    Values under ``least`` may come out as less than they are. The best extent begins and ends on a trigram of the query and does not
    hold the one it begins with twice, so each place of a query's trigram opens one extent, which grows until that trigram comes
    again, the text ends, or what else it holds keeps it under the pair's best value.
    """
    codes, offsets = trigrams_of(texts)
    asked, asked_at = trigrams_of(queries)
    names, ranks = np.unique(np.concatenate([codes, asked]), return_inverse=True)
    ranks, wanted = ranks[: len(codes)].astype(np.int64), ranks[len(codes) :].astype(np.int64)
    n_names = max(len(names), 1)
    own_text = np.repeat(np.arange(len(texts)), np.diff(offsets))
    keys = own_text * n_names + ranks
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    before, after = np.full(len(codes), -1), np.full(len(codes), len(codes))
    again = keys[1:] == keys[:-1]
    before[order[1:][again]], after[order[:-1][again]] = order[:-1][again], order[1:][again]
    # distinct trigrams of each query
    own_query = np.repeat(np.arange(len(queries)), np.diff(asked_at))
    distinct = np.unique(own_query * n_names + wanted)
    wanted, sizes = distinct % n_names, np.bincount(distinct // n_names, minlength=len(queries))
    wanted_at = np.cumsum(sizes) - sizes
    out = np.zeros(len(text_of))
    lengths = np.diff(offsets)[text_of]
    ends = np.cumsum(lengths)
    first = 0
    while first < len(text_of):
        last = max(first + 1, int(np.searchsorted(ends, (ends[first - 1] if first else 0) + BLOCK, "right")))
        t, q = text_of[first:last], query_of[first:last]
        n = sizes[q]
        of = np.repeat(np.arange(len(t)), n)
        looked = t[of] * n_names + wanted[_slices(wanted_at[q], n)]
        lo, hi = np.searchsorted(keys, looked), np.searchsorted(keys, looked, "right")
        pair, start = np.repeat(of, hi - lo), order[_slices(lo, hi - lo)]
        out[first:last] = _grow(pair, start, n, offsets[t], offsets[t + 1], before, after, least)
        first = last
    return out


def _grow(pair: np.ndarray, start: np.ndarray, n: np.ndarray, begins: np.ndarray, ends: np.ndarray, before: np.ndarray, after: np.ndarray, least: float) -> np.ndarray:
    """The best value of each pair, from the places of its query's trigrams (pair, start) in its text (begins to ends)."""
    best = np.zeros(len(n))
    lengths = ends - begins
    shift = np.cumsum(lengths) - lengths - begins  # from a place in the texts to one in the pair's own stretch
    shared_here = np.zeros(int(lengths.sum()), bool)
    shared_here[shift[pair] + start] = True
    at, stop = start.copy(), np.minimum(after[start], ends[pair])
    shared, other = np.zeros(len(pair), np.int64), np.zeros(len(pair), np.int64)
    size, floor = n[pair], least * (1 - 1e-9)
    shift = shift[pair]
    while len(pair):
        hit, new = shared_here[shift + at], before[at] < start
        shared += hit & new
        other += ~hit & new
        np.maximum.at(best, pair[hit], shared[hit] / (size[hit] + other[hit]))
        at = at + 1
        # no extent that goes on can be worth more than size / (size + other)
        live = (at < stop) & (size > np.maximum(best[pair], floor) * (size + other))
        if not live.all():
            pair, start, at, stop, shared, other, size, shift = (x[live] for x in (pair, start, at, stop, shared, other, size, shift))
    return best
