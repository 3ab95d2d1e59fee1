"""MinHash near-duplicate detection with HyperMinHash registers.

A document's set holds the 64-bit hashes of its distinct word shingles. Documents with equal sets form a class (by a 128-bit digest
of the set), so copies never multiply. Per class, each of ``2**BUCKETS`` buckets keeps of its smallest hash the number of leading zeros
and MANTISSA further bits in 16 bits. Bands of neighbouring registers (empty ones filled from others by a fixed rule) are the candidate
keys; sets too small for registers to say much use the hashes of an exact prefix filter as keys instead.

Candidates of a key are not all pairs: first the smallest id is compared with the rest of the key, then members are dealt to blocks of
bounded size, compared inside a block and with some members chosen from the smallest components, and only across components; who has
been compared with all leaves, a key of one block at once. A key that many members share which are no copies is split first by what else
near pairs must share. So a group costs a few rows per member, and no link between different texts is lost: rounds go on until every
key lies within one component.
A pair's Jaccard is estimated from the registers, corrected for registers that agree by chance; what is clearly below the threshold
goes, the rest is verified on the full sets, exactly. Of a block's links those that join components come out, one a join.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from itertools import islice

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from docwarp.llm.common import join_split, written

BUCKETS, MANTISSA = 8, 10  # 256 registers of 16 bits
SMALL = 48  # sets of fewer shingles use prefix keys
EMPTY = 0xFFFF
EXACT = 512  # sets of at most so many shingles are compared in full where members meet
BLOCK = 256  # members of a key that one block compares with each other and with the chosen ones
TOGETHER = 64  # sets whose registers are made at a time
PAIRS = 1 << 14  # pairs whose registers are compared at a time
EACH = 4  # pairs with large sets that a member of a block leaves to verify in a round; the rest waits for their outcome
CROWD = 16  # keys of more blocks are split
MARKS = 1 << 23  # bits that tell which rows a join may want


def _mix(x: np.ndarray) -> np.ndarray:
    """splitmix64's finish; fixed constants."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingle_sets(texts: pa.Array, width: int, chars: int = 8_000_000) -> Iterator[np.ndarray]:
    """Sorted distinct shingle hashes of each text, a bounded slice of texts at a time.

    A-Z are lower-cased; words are runs of non-white-space (ASCII). A text of fewer than ``width`` words, but not none, is one shingle.
    """
    import xxhash

    texts = pc.fill_null(texts, "")
    sizes = np.asarray(pc.binary_length(texts), np.int64)
    at = 0
    while at < len(texts):
        end, total = at + 1, int(sizes[at])
        while end < len(texts) and total + sizes[end] <= chars:
            total += int(sizes[end])
            end += 1
        words = pc.ascii_split_whitespace(pc.ascii_lower(texts.slice(at, end - at)))
        flat = words.flatten().dictionary_encode()
        offsets = np.asarray(words.offsets, np.int64)
        offsets = offsets - offsets[0]
        names = flat.dictionary.to_pylist()
        own = np.array([xxhash.xxh3_64_intdigest(w.encode()) for w in names], np.uint64)
        full = np.array([bool(w) for w in names], bool)
        codes = flat.indices.to_numpy()
        real = full[codes] if len(names) else np.zeros(0, bool)
        ends = np.concatenate([[0], np.cumsum(real)])[offsets]
        h = own[codes[real]] if len(names) else np.zeros(0, np.uint64)
        rolled = np.full(max(len(h) - width + 1, 0), width, np.uint64)
        for j in range(width):
            rolled = _mix(rolled * np.uint64(0x9E3779B97F4A7C15) + h[j : j + len(rolled)])
        for i in range(end - at):
            a, b = int(ends[i]), int(ends[i + 1])
            if b - a >= width:
                yield np.unique(rolled[a : b - width + 1])
            elif b > a:
                one = np.full(1, b - a, np.uint64)
                for j in range(a, b):
                    one = _mix(one * np.uint64(0x9E3779B97F4A7C15) + h[j : j + 1])
                yield one
            else:
                yield np.zeros(0, np.uint64)
        at = end


def registers_of(sets: list[np.ndarray]) -> np.ndarray:
    """Registers of several sorted sets, a row each: per bucket of the top bits, the smallest remaining hash as leading zeros and mantissa; EMPTY where there is none."""
    n = 1 << BUCKETS
    out = np.full(len(sets) * n, EMPTY, np.uint16)
    flat = np.concatenate(sets) if sets else np.zeros(0, np.uint64)
    place = np.repeat(np.arange(len(sets)) * n, [len(s) for s in sets]) + (flat >> np.uint64(64 - BUCKETS)).astype(np.int64)
    first = np.flatnonzero(np.concatenate([[True], place[1:] != place[:-1]])[: len(flat)])  # sets are sorted
    rest = (flat[first] << np.uint64(BUCKETS)) | np.uint64(1)
    zeros = (64 - np.frexp((rest >> np.uint64(11)).astype(np.float64))[1] - 11).clip(0, 62).astype(np.uint64)
    mantissa = (rest << (zeros + np.uint64(1))) >> np.uint64(64 - MANTISSA)
    out[place[first]] = (zeros << np.uint64(MANTISSA)) | mantissa
    return out.reshape(-1, n)


def registers(hashes: np.ndarray) -> np.ndarray:
    return registers_of([hashes])[0]


_ORDER = np.random.default_rng(11).permuted(np.tile(np.arange(1 << BUCKETS), (1 << BUCKETS, 1)), axis=1)


def rows_for(percent: int, miss: float = 1e-6) -> int:
    """Registers a band, the most with which a pair at the threshold shares no band with a probability under ``miss``."""
    t, m = percent / 100, 1 << BUCKETS
    return max(r for r in range(1, 17) if r == 1 or (1 - t**r) ** (m // r) < miss)


def band_keys_of(regs: np.ndarray, size: int) -> np.ndarray:
    """One 64-bit key per band for each row of registers, of which some are full. An empty one takes the first full one in a fixed random order of its own."""
    full = regs != EMPTY
    filled = regs.astype(np.uint64)
    rows, gaps = np.nonzero(~full)
    source, open_, j = _ORDER[gaps, 0], np.arange(len(gaps)), 1
    while len(open_ := open_[~full[rows[open_], source[open_]]]):
        source[open_] = _ORDER[gaps[open_], j]
        j += 1
    filled[rows, gaps] = regs[rows, source].astype(np.uint64) | (source.astype(np.uint64) << np.uint64(16))
    n = regs.shape[1] // size
    parts = filled[:, : n * size].reshape(len(regs), n, size)
    key = np.tile(np.arange(1, n + 1, dtype=np.uint64), (len(regs), 1))
    for j in range(size):
        key = _mix(key * np.uint64(0x9E3779B97F4A7C15) + parts[:, :, j])
    return key


def band_keys(regs: np.ndarray, size: int) -> np.ndarray:
    return band_keys_of(regs[None], size)[0]


def prefix_keys(hashes: np.ndarray, percent: int, more: int = 0) -> np.ndarray:
    """Sets with a Jaccard of ``percent`` / 100 share 1 + ``more`` of these (or all of the smaller set): the smallest hashes, as many as the prefix filter needs."""
    n = len(hashes)
    return hashes[: n - (-(-percent * n // 100)) + 1 + more] ^ np.uint64(0x5BD1E9955BD1E995)


def _features(docs: DataFrame, width: int, percent: int) -> DataFrame:
    band = rows_for(percent)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from hashlib import blake2b

        for batch in batches:
            sizes, nodes, regs, keys = [], [], [], []
            found = shingle_sets(batch.column(2), width)
            while some := list(islice(found, TOGETHER)):
                rows = registers_of(some)
                banded = iter(band_keys_of(rows[[len(s) >= SMALL for s in some]], band))
                for s, r in zip(some, rows, strict=True):
                    sizes.append(len(s))
                    nodes.append(blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None)
                    regs.append(r.tobytes() if len(s) else None)
                    own = [prefix_keys(s, percent)] if len(s) and percent * len(s) < 100 * SMALL else []
                    own += [next(banded)] if len(s) >= SMALL else []
                    keys.append(np.concatenate(own).view(np.int64) if own else np.zeros(0, np.int64))
            columns = [batch.column(0), batch.column(1), pa.array(sizes, pa.int64()), pa.array(nodes, pa.binary()), pa.array(regs, pa.binary()), pa.array(keys, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "mark", "n", "node", "regs", "keys"])

    schema = "doc_id long, mark long, n long, node binary, regs binary, keys array<long>"
    return docs.select("doc_id", F.xxhash64("text").alias("mark"), "text").mapInArrow(run, schema)


def estimate(a: np.ndarray, b: np.ndarray, n_a: np.ndarray, n_b: np.ndarray) -> np.ndarray:
    """Jaccard of pairs from their registers (one pair a row): the share of agreeing registers, less those that agree by chance.

    Two different minima of a bucket agree by chance when they fall on one code. With sets of n elements over m buckets a minimum is
    near exponential with rate n / m, and codes split each octave of it in 2**MANTISSA parts.
    """
    either = ((a != EMPTY) | (b != EMPTY)).sum(axis=1)
    same = ((a == b) & (a != EMPTY)).sum(axis=1)
    octaves = np.exp2(-np.arange(1, 64, dtype=np.float64))

    def octave(n: np.ndarray) -> np.ndarray:
        rate = (n / (1 << BUCKETS))[:, None]
        return np.exp(-rate * octaves) - np.exp(-2 * rate * octaves)

    chance = (octave(n_a) * octave(n_b)).sum(axis=1) / (1 << MANTISSA)
    return (same / np.maximum(either, 1) - chance) / (1 - chance)


def _may_reach(a: np.ndarray, b: np.ndarray, n_a: np.ndarray, n_b: np.ndarray, percent: int, sigmas: float) -> tuple[np.ndarray, np.ndarray]:
    """(which pairs may reach the threshold, their estimates); sets of fewer than SMALL shingles always may."""
    used = np.maximum(((a != EMPTY) | (b != EMPTY)).sum(axis=1), 1)
    t, found = percent / 100, estimate(a, b, n_a, n_b)
    return (found >= t - sigmas * np.sqrt(t * (1 - t) / used) - 1.0 / used) | (np.minimum(n_a, n_b) < SMALL), found


def _estimated(pairs: DataFrame, percent: int, sigmas: float) -> DataFrame:
    """Pairs (a, b, with regs and sizes) that may reach the threshold."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n_a, n_b = (batch.column(c).to_numpy() for c in ("n_a", "n_b"))
            a, b = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint16).reshape(len(n_a), -1) for c in ("regs_a", "regs_b"))
            keep, _ = _may_reach(a, b, n_a, n_b, percent, sigmas)
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b")], ["a", "b"]).filter(pa.array(keep))

    close = 100 * F.least("n_a", "n_b") >= percent * F.greatest("n_a", "n_b")
    return pairs.where(close).select("a", "b", "n_a", "n_b", "regs_a", "regs_b").mapInArrow(run, "a binary, b binary")


def _verified(pairs: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b, set_a, set_b: sorted hashes) as a, b, near: whether they reach the threshold on their full sets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column("set_a"), batch.column("set_b"), strict=True):
                a, b = (np.frombuffer(v.as_buffer(), np.uint64) for v in (x, y))
                both = np.concatenate([a, b])
                both.sort(kind="stable")
                shared = int((both[1:] == both[:-1]).sum())
                keep.append(100 * shared >= percent * (len(a) + len(b) - shared))
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b"), pa.array(keep, pa.bool_())], ["a", "b", "near"])

    return pairs.select("a", "b", "set_a", "set_b").mapInArrow(run, "a binary, b binary, near boolean")


def _star(edges: DataFrame) -> DataFrame:
    """A round of alternating stars on edges (u, v) with u > v: written edges of the same components, closer to stars."""
    # large star: every larger neighbour points at the smallest neighbour or the node itself
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
    # small star: the node and its smaller neighbours point at the smallest
    least = large.groupBy("u").agg(F.min("v").alias("m"))
    small = large.join(least, "u").select(F.explode(F.array("u", "v")).alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
    return written(small, "edges")


def _edges(pairs: DataFrame) -> DataFrame:
    """Edges (u, v), u > v, of pairs (a, b)."""
    return pairs.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v")


def _finished(now: DataFrame) -> DataFrame:
    """Edges (u, v) after as many rounds of stars as it takes: v is the smallest node of u's component."""
    state = lambda: tuple(now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first())
    before, after = None, state()
    while before != after:
        now = _star(now)
        before, after = after, state()
    return now


def _labels(edges: DataFrame) -> DataFrame:
    """node, comp for every node of edges (u, v): a node of its component, the smallest one if the stars are finished. Nodes with one
    label are of one component; before the stars are finished a component may have several labels."""
    tops = edges.select(F.col("v").alias("node")).distinct().join(edges.select(F.col("u").alias("node")), "node", "left_anti")
    return edges.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("comp")).unionByName(tops.select("node", F.col("node").alias("comp")))


def components(edges: DataFrame) -> DataFrame:
    """node, comp (smallest node of the component) for every node of ``edges`` (a, b), by alternating stars; each round is written."""
    return _labels(_finished(_edges(edges)))


def _likely(rows: DataFrame, wanted: DataFrame, number: str) -> DataFrame:
    """``rows`` without most of those whose ``number`` (an expression, a hashed long) none of ``wanted`` has, so that they need not travel to a join
    with these. Bits of wanted numbers, MARKS of them at most, are broadcast in words of 64; no row that has a partner is lost."""
    word = F.expr(f"shiftrightunsigned({number}, 6) & {MARKS // 64 - 1}")
    bit = lambda one: F.expr(f"shiftleft({one}, CAST({number} & 63 AS int))")
    marks = wanted.groupBy(word.alias("_word")).agg(F.bit_or(bit("1L")).alias("_bits"))
    hit = rows.withColumn("_word", word).join(F.broadcast(marks), "_word")
    return hit.where(F.col("_bits").bitwiseAND(bit("1L")) != 0).select(*rows.columns)


def _pairs(pairs: DataFrame, nodes: DataFrame, fields: list[str]) -> DataFrame:
    """Add fields of both ends of written pairs."""
    nodes = _likely(nodes, pairs.select(F.explode(F.array("a", "b")).alias("node")), "xxhash64(node)")
    for end in ("a", "b"):
        side = nodes.select(F.col("node").alias(end), *[F.col(f).alias(f"{f}_{end}") for f in fields])
        pairs = pairs.join(side, end)
    return pairs


def link(docs: DataFrame, width: int = 3, percent: int = 85, reps: int = BLOCK, block: int = BLOCK, sigmas: float = 5.5) -> DataFrame:
    """One row per row of ``docs``: ``doc_id, n_shingles, component_id, kept``.

    Documents with 100 * |intersection| >= ``percent`` * |union| of their sets are linked; component_id is the smallest doc_id of a
    connected component. Null texts and texts without words have an empty set, are linked with nothing and are kept. Repeated rows
    and documents with equal sets are linked. Rows that share a doc_id are told apart by their texts; a null doc_id never names a
    component others have an id for. Extra columns are ignored; an empty table gives no rows.
    """
    return _linked(docs, width, percent, reps, block, sigmas).select("doc_id", "n_shingles", "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))


def _linked(docs: DataFrame, width: int = 3, percent: int = 85, reps: int = BLOCK, block: int = BLOCK, sigmas: float = 5.5) -> DataFrame:
    """One row per row of ``docs``: ``doc_id, mark`` (hash of the text)``, n_shingles, component_id, best`` (last, doc_id, mark of the
    component's row that stays; null without words)."""
    features = written(_features(docs, width, percent), "features")
    own = features.where("node IS NOT NULL").select("node", F.struct("doc_id", "mark", "n", "regs", "keys").alias("own"))
    nodes = written(own.groupBy("node").agg(F.min_by("own", F.struct(F.col("own.doc_id").isNull(), F.col("own.doc_id"), F.col("own.mark"))).alias("o")).select("node", "o.*"), "nodes")
    keyed = nodes.select("node", F.explode(F.array_distinct("keys")).alias("key"))
    of_key = Window.partitionBy("key")  # keys travel once: most have one member
    crowd = keyed.select("key", "node", F.count("*").over(of_key).alias("members"), F.min("node").over(of_key).alias("rep")).where("members > 1")
    live = written(crowd.select("key", "node", "rep"), "members")
    pairs = live.where("node <> rep").select(F.col("rep").alias("a"), F.col("node").alias("b"))
    pairs = written(_estimated(_pairs(pairs.distinct(), nodes, ["n", "regs"]), percent, sigmas), "pairs")
    live = live.where("node <> rep").select("key", "node")
    edges, sets, sure, data, refuted, again = None, None, None, None, None, None
    most, each, check = reps, EACH, not pairs.isEmpty()
    while True:
        found = [] if sure is None else [_edges(sure)]
        if check:
            need = pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct()
            if sets is not None:
                need = need.join(sets.select("node"), "node", "left_anti")
            more = written(_sets(docs, nodes.join(need, "node", "left_semi"), width), "sets")
            sets = more if sets is None else sets.unionByName(more)
            tried = written(_verified(_pairs(pairs, sets, ["set"]), percent), "links")
            found.append(_edges(tried.where("near")))
            if again is not None:
                fell = tried.where("NOT near").select("a", "b")
                refuted = fell if refuted is None else refuted.unionByName(fell)
        if found:
            # one round of stars: labels that are not final cost comparisons, never links
            edges = _star(reduce(DataFrame.unionByName, found if edges is None else [edges, *found]))
        # members still to compare: of keys that more than one component reaches
        now = written(_mixed(_with_comps(live, None if edges is None else _labels(edges))), "members")
        if now.isEmpty():
            break
        if data is None:  # once, what the members that may still meet are compared by
            here = nodes.join(now.select("node").distinct(), "node", "left_semi")
            small = here.where(F.col("n") <= EXACT)
            exact = _sets(docs, small, width).join(small.select("node", "n"), "node").select("node", "n", F.col("set").alias("data"))
            data = written(exact.unionByName(here.where(F.col("n") > EXACT).select("node", "n", F.col("regs").alias("data"))), "data")
            now = _split(now, data, percent, CROWD * block)
        sized = now.join(now.groupBy("key", "comp").agg(F.count("*").alias("size")), ["key", "comp"])
        rank = F.row_number().over(Window.partitionBy("key").orderBy("size", "comp", "node"))
        chosen = written(sized.withColumn("rank", rank).where(F.col("rank") <= most).select("key", F.col("node").alias("rep"), F.col("comp").alias("rep_comp"), "rank"), "reps")
        met = written(_meet(now, chosen, data, refuted, percent, sigmas, block, each), "met")
        sure, pairs = met.where("sure").select("a", "b"), met.where("NOT sure").select("a", "b")
        n_sure, n_pairs, n_waiting = met.agg(F.count_if(F.col("sure")), F.count_if(~F.col("sure")), F.count("key")).first()
        sure, check = sure if n_sure else None, n_pairs > 0
        again = met.where("key IS NOT NULL").select("key").distinct() if n_waiting else None
        rest = now.join(now.groupBy("key").agg(F.count("*").alias("size")).where(F.col("size") > block), "key", "left_semi")
        live = rest.join(chosen.select("key", F.col("rep").alias("node")), ["key", "node"], "left_anti").select("key", "node")
        if again is not None:
            live = live.join(again, "key", "left_anti").unionByName(now.join(again, "key", "left_semi").select("key", "node"))
        most, each = CROWD * reps, CROWD * each  # few keys are left: their members all meet at once, and their pairs are all verified
    # every node's component, then its smallest document
    comps = None if edges is None else written(_labels(_finished(edges)), "comps")
    of = nodes.select("node", "doc_id", "mark") if comps is None else nodes.select("node", "doc_id", "mark").join(comps, "node", "left")
    of = of.select("node", "doc_id", "mark", F.coalesce("comp", "node").alias("comp") if comps is not None else F.col("node").alias("comp"))
    best = F.min(F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "mark")).alias("best")
    names = of.join(of.groupBy("comp").agg(F.min("doc_id").alias("component_id"), best), "comp").select("node", "component_id", "best")
    out = join_split(features.drop("regs", "keys"), names, "node", "doc_id", "left").withColumn("component_id", F.coalesce("component_id", "doc_id"))
    return out.select("doc_id", "mark", F.col("n").alias("n_shingles"), "component_id", "best")


def _with_comps(live: DataFrame, comps: DataFrame | None) -> DataFrame:
    """Add ``comp`` to (key, node): the node's component, or the node itself."""
    if comps is None:
        return live.select("key", "node", F.col("node").alias("comp"))
    return live.join(comps, "node", "left").select("key", "node", F.coalesce("comp", "node").alias("comp"))


def _mixed(members: DataFrame) -> DataFrame:
    """Members (key, node, comp) of keys that more than one component reaches."""
    mixed = members.groupBy("key").agg(F.min("comp").alias("low"), F.max("comp").alias("high")).where("low <> high").select("key")
    return members.join(mixed, "key", "left_semi")


def _split(now: DataFrame, data: DataFrame, percent: int, most: int) -> DataFrame:
    """Members of keys with more than ``most`` of them come under finer keys instead: pairs of a near pair's shared features.

    Near sets below the prefix keys' bound share two elements of a prefix that is longer by one, exactly; sets with bands share one of
    the many bands of few registers apart from the key's own, more surely than one of the first keys.
    """
    if percent <= 50:  # small near sets may share one element only
        return now
    wide_band, fine_band = rows_for(percent), rows_for(percent, 1e-12)
    crowds = written(now.groupBy("key").agg(F.count("*").alias("size")).where(F.col("size") > most).select("key"), "crowds")
    if crowds.isEmpty():
        return now

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, sizes = (batch.column(i).to_numpy() for i in (0, 3))
            finer, counts = [], []
            for key, n, value in zip(keys, sizes, batch.column(4), strict=True):
                value = value.as_py()
                regs = np.frombuffer(value, np.uint16) if n > EXACT else registers(np.frombuffer(value, np.uint64))
                own = []
                if n >= SMALL:
                    fine = band_keys(regs, fine_band)
                    at = np.flatnonzero(band_keys(regs, wide_band) == key.view(np.uint64)) * wide_band  # the key's registers
                    starts = np.arange(len(fine)) * fine_band
                    apart = (starts[:, None] + fine_band <= at) | (starts[:, None] >= at + wide_band)
                    own.append(fine[apart.all(axis=1)])
                own += [prefix_keys(np.frombuffer(value, np.uint64), percent, 1)] if percent * n < 100 * SMALL else []
                own = np.concatenate(own)
                own = own[own != key.view(np.uint64)]
                finer.append(_mix(own ^ _mix(key.view(np.uint64) + np.uint64(1))).view(np.int64))
                counts.append(len(own))
            who = pa.array(np.repeat(np.arange(batch.num_rows), counts))
            columns = [pa.array(np.concatenate(finer)), batch.column(1).take(who), batch.column(2).take(who)]
            yield pa.RecordBatch.from_arrays(columns, ["key", "node", "comp"])

    wide = now.join(crowds, "key", "left_semi").join(data, "node").select("key", "node", "comp", "n", "data")
    finer = _mixed(written(wide.mapInArrow(run, "key long, node binary, comp binary").distinct(), "finer"))
    return written(now.join(crowds, "key", "left_anti").unionByName(finer), "members")


def _meet(now: DataFrame, chosen: DataFrame, data: DataFrame, refuted: DataFrame | None, percent: int, sigmas: float, block: int = BLOCK, each: int = EACH) -> DataFrame:
    """Compare the chosen members of each key with its members of other components: a, b, sure, or the key that has to be met again.

    A key's members are dealt to blocks by a hash and its chosen ones (bounded) go to each of them, so rows grow as the members do; a
    key of one block needs no chosen ones. The members of a block are compared inside the task with each other and the chosen ones, and
    only links that join components come out, or, of large sets, a few pairs per member to verify. ``refuted`` pairs are not tried again.
    """
    sizes = now.groupBy("key").agg(F.ceil(F.count("*") / block).cast("int").alias("blocks"))
    members = now.join(sizes, "key").select("key", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int").alias("block"), F.lit(1).alias("role"), "node", "comp")
    asked = chosen.join(sizes.where("blocks > 1"), "key").select(
        "key", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), F.lit(0).alias("role"), F.col("rep").alias("node"), F.col("rep_comp").alias("comp")
    )
    rows = members.unionByName(asked).join(data, "node")
    if refuted is None:
        rows = rows.withColumn("no", F.lit(None).cast("array<binary>"))
    else:
        rows = rows.join(refuted.groupBy(F.col("a").alias("node")).agg(F.collect_set("b").alias("no")), "node", "left")
    rows = rows.select("key", "block", "role", "node", "comp", "n", "data", "no")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, name, out = [], None, set()
        for batch in batches:
            for row in zip(*(batch.column(i).to_pylist() for i in range(8)), strict=True):
                if row[:2] != name:
                    out |= _block(name and name[0], group, percent, sigmas, each)
                    group, name = [], row[:2]
                    if len(out) > 20_000:
                        yield _met(out)
                        out = set()
                group.append(row[2:])
        yield _met(out | _block(name and name[0], group, percent, sigmas, each))

    return rows.repartition("key", "block").sortWithinPartitions("key", "block").mapInArrow(run, "a binary, b binary, sure boolean, key long").distinct()


def _met(out: set) -> pa.RecordBatch:
    columns = list(zip(*out, strict=True)) or [()] * 4
    types = [pa.binary(), pa.binary(), pa.bool_(), pa.int64()]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], ["a", "b", "sure", "key"])


class _Joined:
    """Which components are one."""

    def __init__(self, n: int):
        self.root = list(range(n))

    def find(self, i: int) -> int:
        while self.root[i] != i:
            self.root[i] = self.root[self.root[i]]
            i = self.root[i]
        return i

    def join(self, i: int, j: int) -> bool:
        i, j = self.find(i), self.find(j)
        self.root[i] = j
        return i != j

    def all(self) -> np.ndarray:
        return np.array([self.find(i) for i in range(len(self.root))])


def _block(key: int | None, group: list[tuple], percent: int, sigmas: float, each: int = EACH) -> set:
    """(a, b, sure, null) of a block's rows (role, node, comp, n, data, no), and (null, null, null, key) if pairs are left for the next round."""
    out: set = set()
    if len(group) < 2:
        return out
    # members first; each meets the members after it and the chosen ones of other blocks, of which the smaller one of a pair is asked
    own = {row[1] for row in group if row[0]}
    twice = {row[1] for row in group if not row[0]} & own
    group = sorted((row for row in group if row[0] or row[1] not in own), key=lambda row: not row[0])
    if len(group) < 2 or not own:
        return out
    roles, nodes, names, sizes, data, refuted = zip(*group, strict=True)
    n, inside = np.array(sizes), sum(roles)
    known: dict[bytes, int] = {}
    comp = np.array([known.setdefault(c, len(known)) for c in names])
    may = np.triu(comp[:inside, None] != comp[None])
    may &= 100 * np.minimum.outer(n[:inside], n) >= percent * np.maximum.outer(n[:inside], n)
    order = np.argsort(np.argsort(np.array(nodes, object)))
    may[:, inside:] &= ~np.array([x in twice for x in nodes[:inside]])[:, None] | (order[:inside, None] < order[None, inside:])
    places: dict[bytes, list[int]] = {}
    for i, node in enumerate(nodes):
        places.setdefault(node, []).append(i)
    for i, partners in enumerate(refuted):
        for j in (j for p in partners or () for j in places.get(p, ())):
            if min(i, j) < inside:
                may[min(i, j), max(i, j)] = False
    first, second = np.nonzero(may)
    if not len(first):
        return out
    # what the registers leave, likely pairs first
    sets = {i: np.frombuffer(data[i], np.uint64) for i in np.flatnonzero(n <= EXACT).tolist()}
    regs = np.empty((len(group), 1 << BUCKETS), np.uint16)
    regs[n <= EXACT] = registers_of(list(sets.values()))
    for i in np.flatnonzero(n > EXACT).tolist():
        regs[i] = np.frombuffer(data[i], np.uint16)
    parts = [slice(at, at + PAIRS) for at in range(0, len(first), PAIRS)]
    tried = [_may_reach(regs[first[p]], regs[second[p]], n[first[p]], n[second[p]], percent, sigmas) for p in parts]
    keep, likely = (np.concatenate([t[i] for t in tried]) for i in (0, 1))
    first, second, likely = first[keep], second[keep], likely[keep]
    order = np.argsort(-likely, kind="stable")
    first, second = first[order], second[order]
    joined = _Joined(len(known))
    pair = lambda i, j, sure: (min(nodes[i], nodes[j]), max(nodes[i], nodes[j]), sure, None)
    # both sets are here: verify pair by pair while that joins components, the rest of them all at once
    here = (n[first] <= EXACT) & (n[second] <= EXACT)
    i_here, j_here = first[here].tolist(), second[here].tolist()
    tries = 4 * len(group)
    for at, (i, j) in enumerate(zip(i_here, j_here, strict=True)):
        if joined.find(comp[i]) == joined.find(comp[j]):
            continue
        if tries == 0:
            root = joined.all()[comp]
            i, j = (np.array(x[at:]) for x in (i_here, j_here))
            open_ = root[i] != root[j]
            i, j = i[open_], j[open_]
            left, right = np.unique(i), np.unique(j)
            shared = _shared([sets[k] for k in left.tolist()], [sets[k] for k in right.tolist()])[np.searchsorted(left, i), np.searchsorted(right, j)]
            near = 100 * shared >= percent * (n[i] + n[j] - shared)
            out |= {pair(x, y, True) for x, y in zip(i[near].tolist(), j[near].tolist(), strict=True) if joined.join(comp[x], comp[y])}
            break
        tries -= 1
        shared = len(np.intersect1d(sets[i], sets[j], assume_unique=True))
        if 100 * shared >= percent * (n[i] + n[j] - shared):
            joined.join(comp[i], comp[j])
            out.add(pair(i, j, True))
    # large sets: some pairs per member to verify
    root, held, waits = joined.all()[comp], np.zeros(len(group), np.int64), False
    hoped = _Joined(len(known))
    for i, j in zip(first[~here].tolist(), second[~here].tolist(), strict=True):
        if root[i] == root[j]:
            continue
        if hoped.join(root[i], root[j]) or max(held[i], held[j]) < each:
            held[[i, j]] += 1
            out.add(pair(i, j, False))
        else:
            waits = True
    return out | {(None, None, None, key)} if waits else out


def _shared(left: list[np.ndarray], right: list[np.ndarray], columns: int = 4096) -> np.ndarray:
    """Sizes of the intersections of all of ``left`` with all of ``right``: products of indicator matrices, some columns at a time."""
    names, codes = np.unique(np.concatenate(left + right), return_inverse=True)
    sides = []
    for sets, codes_of in ((left, codes[: sum(map(len, left))]), (right, codes[sum(map(len, left)) :])):
        order = np.argsort(codes_of, kind="stable")
        sides.append((np.repeat(np.arange(len(sets)), [len(s) for s in sets])[order], codes_of[order]))
    shared = np.zeros((len(left), len(right)), np.int64)
    for at in range(0, len(names), columns):
        parts = []
        for (rows, cols), sets in zip(sides, (left, right), strict=True):
            a, b = np.searchsorted(cols, [at, at + columns])
            m = np.zeros((len(sets), min(columns, len(names) - at)), np.float32)
            m[rows[a:b], cols[a:b] - at] = 1
            parts.append(m)
        shared += (parts[0] @ parts[1].T).astype(np.int64)
    return shared


def _sets(docs: DataFrame, nodes: DataFrame, width: int) -> DataFrame:
    """node, set (sorted hashes) of the given nodes, from the text of one document of each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [s.tobytes() for s in shingle_sets(batch.column(1), width)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sets, pa.binary())], ["node", "set"])

    rows = docs.select("doc_id", F.xxhash64("text").alias("mark"), "text")
    wanted = nodes.select("node", F.col("doc_id").alias("_id"), F.col("mark").alias("_mark"))
    rows = _likely(rows, nodes.select("mark"), "mark")
    found = rows.join(wanted, (rows["mark"] == wanted["_mark"]) & rows["doc_id"].eqNullSafe(wanted["_id"]))
    return found.select("node", "text").mapInArrow(run, "node binary, set binary").dropDuplicates(["node"])


def dedup(docs: DataFrame, **kw) -> DataFrame:
    """``docs`` with one document of each component, all columns kept, extra ones too.

    It is the one with the smallest doc_id (null after all others), then the smallest hash of its text. Rows with equal doc_id and
    text are one document and stay together; of those without an id one row stays. Rows whose text has no words all stay.
    """
    linked = _linked(docs, **kw).where("best IS NOT NULL")
    own = F.col("doc_id").eqNullSafe(F.col("best.doc_id")) & (F.col("mark") == F.col("best.mark"))
    dropped = linked.where(~own).select(F.col("doc_id").alias("drop_id"), F.col("mark").alias("drop_mark"))
    # a whole row is one column, so that no name of its columns can clash
    rows = docs.select(F.struct("*").alias("row")).select("row", F.col("row.doc_id").alias("doc_id"), F.xxhash64("row.text").alias("mark"))
    left = rows.join(dropped, F.col("doc_id").eqNullSafe(F.col("drop_id")) & (F.col("mark") == F.col("drop_mark")), "left_anti")
    again = linked.where("doc_id IS NULL").groupBy("mark").agg(F.count("*").alias("n")).where("n > 1").select("mark")
    if again.isEmpty():
        return left.select("row.*")
    again = written(again, "again")
    one = left.where("doc_id IS NULL").join(again, "mark", "left_semi").dropDuplicates(["mark"])
    others = left.where("doc_id IS NOT NULL").unionByName(left.where("doc_id IS NULL").join(again, "mark", "left_anti"))
    return others.unionByName(one).select("row.*")
