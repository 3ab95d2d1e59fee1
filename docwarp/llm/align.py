"""Alignment of two tokenizers' tokens over the same bytes.

Both tokenizers encode `` text``. Byte offsets at which a token of either ends cut the tokens into groups. Groups are found by pointer
jumping: every token points to its farthest-right overlapping token, and successors are doubled in one vectorised step after another
until each token knows its component's last token.

Texts are handled as units: stretches that begin with a blank after a character that is no white space. Neither tokenizer has a token
that goes on over such a blank (A's rule splits there, and no piece of B has an inner blank), so a unit's tokens are the same
wherever it stands, and each distinct unit of a batch is encoded and aligned once. What a document needs is how often it has
each unit; what has to meet across the corpus are the id pairs of a batch of documents, not of each document.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docwarp.llm.common import written
from docwarp.llm.tokens import _byte_alphabet, ragged

SLICE, ENTRIES, MEMO, PART = 4 << 20, 1_000_000, 200_000, 4096
_LOADED: dict[str, "Pair"] = {}


def starts_of(counts: np.ndarray) -> np.ndarray:
    return np.cumsum(counts) - counts


def jump(a_ends: np.ndarray, b_ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """Groups of two token sequences over the same bytes, given their ends: (group of each A token, of each B token, groups).

    A token points to the one that ends farthest right among those it overlaps, itself included; of two with equal ends to A's. The
    pointers lead to the last A token of each group, which points to itself.
    """
    n = len(a_ends)
    last_b, last_a = np.searchsorted(b_ends, a_ends), np.searchsorted(a_ends, b_ends)  # the tokens of the other side over one's last byte
    own = np.arange(n)
    to = np.concatenate([np.where(b_ends[last_b] > a_ends, n + last_b, own) if n else own, last_a])
    while True:
        further = to[to]
        if np.array_equal(further, to):
            break
        to = further
    number = np.cumsum(to[:n] == own) - 1
    return number[to[:n]], number[to[n:]], int(number[-1]) + 1 if n else 0


class Pair:
    """Both tokenizers, and the units met last with all that is known of them."""

    def __init__(self, a: str, b: bytes):
        import os

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # Spark has a task on each core already
        import sentencepiece
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_str(a)
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor()
        self.b.LoadFromSerializedProto(b)
        back = {c: x for x, c in _byte_alphabet().items()}
        names = [self.a.id_to_token(i) or "" for i in range(self.a.get_vocab_size())]
        self.a_bytes = [bytes(back[c] for c in x) if all(c in back for c in x) else x.encode() for x in names]
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        self.b_bytes = [bytes([int(p[1:-1], 16)]) if self.b.IsByte(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)]
        self.sizes = [np.array([len(x) for x in t], np.int64) for t in (self.a_bytes, self.b_bytes)]
        self.forget()

    def forget(self) -> None:
        self.seen: dict[str, int] = {}
        self.numbers = np.zeros((0, 5), np.int64)  # A tokens, B tokens, groups, links, whether the bytes are equal
        self.groups = pa.array([], pa.string())
        self.links = (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64))  # id pairs, weights, pairs of each unit

    def codes(self, units: list[str]) -> np.ndarray:
        """Numbers of distinct units; new ones are encoded and aligned."""
        new = [u for u in units if u not in self.seen]
        if new:
            self._learn(new)
        return np.fromiter((self.seen[u] for u in units), np.int64, len(units))

    def _learn(self, units: list[str]) -> None:
        sides, counts, equal = ([], []), ([], []), []
        for at in range(0, len(units), PART):
            part = units[at : at + PART]
            found = [e.ids for e in self.a.encode_batch_fast(part, add_special_tokens=False)], self.b.encode([u[1:] for u in part])  # B adds the first blank itself
            same = np.ones(len(part), bool)
            for table, ids in zip((self.a_bytes, self.b_bytes), found, strict=True):
                same &= np.fromiter((b"".join([table[i] for i in x]) == u.encode() for x, u in zip(ids, part, strict=True)), bool, len(part))
            for side, count, ids in zip(sides, counts, found, strict=True):
                count.append(np.fromiter(map(len, ids), np.int64, len(part)) * same)
                side.append(np.fromiter((x for own, ok in zip(ids, same, strict=True) if ok for x in own), np.int64, count[-1].sum()))
            equal.append(same)
        sides, counts, equal = [np.concatenate(x) for x in sides], [np.concatenate(x) for x in counts], np.concatenate(equal)
        ends = [np.cumsum(size[ids]) for size, ids in zip(self.sizes, sides, strict=True)]
        of_a, of_b, n = jump(*ends)
        in_a, in_b = np.bincount(of_a, minlength=n), np.bincount(of_b, minlength=n)
        unit = np.empty(n, np.int64)
        unit[of_a] = np.repeat(np.arange(len(units)), counts[0])
        groups = np.bincount(unit, minlength=len(units))
        n_links = np.zeros(len(units), np.int64)
        np.add.at(n_links, unit, in_a * in_b)
        texts = []
        for ids, sizes in zip(sides, (in_a, in_b), strict=True):
            each = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]), pa.int32()), pa.array(ids).cast(pa.string()))
            texts.append(pc.binary_join(each, ","))
        both = pc.binary_join_element_wise(*texts, "|")
        both = pc.binary_join(pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(groups)]), pa.int32()), both), ";")
        pairs, weights, per_unit = self._links(sides, in_a, in_b, unit, len(units))
        at = len(self.seen)
        self.seen.update((u, at + i) for i, u in enumerate(units))
        self.numbers = np.concatenate([self.numbers, np.stack([*counts, groups, n_links, equal], axis=1)])
        self.groups = pa.concat_arrays([self.groups, both])
        self.links = tuple(np.concatenate(x) for x in zip(self.links, (pairs, weights, per_unit), strict=True))

    @staticmethod
    def _links(sides: list[np.ndarray], in_a: np.ndarray, in_b: np.ndarray, unit: np.ndarray, units: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Id pairs (A's id * 2^32 + B's) with weights, unit by unit; a group with many tokens gives each of its id pairs once."""
        a, b = sides
        start_a, start_b = starts_of(in_a), starts_of(in_b)
        small = in_a * in_b <= 1024
        # of a small group all occurrence pairs: each A token with all B tokens of its group
        partners = np.where(small, in_b, 0)
        each = np.repeat(partners, in_a)
        pairs = np.repeat(a, each) << 32 | ragged(b, np.repeat(start_b, in_a), each)[0]
        weights, of = np.ones(len(pairs), np.int64), np.repeat(unit, in_a * partners)
        for g in np.flatnonzero(~small):
            ids_a, n_a = np.unique(a[start_a[g] : start_a[g] + in_a[g]], return_counts=True)
            ids_b, n_b = np.unique(b[start_b[g] : start_b[g] + in_b[g]], return_counts=True)
            pairs = np.concatenate([pairs, (ids_a[:, None] << 32 | ids_b).ravel()])
            weights = np.concatenate([weights, np.outer(n_a, n_b).ravel()])
            of = np.concatenate([of, np.full(len(ids_a) * len(ids_b), unit[g])])
        order = np.argsort(of, kind="stable")
        return pairs[order], weights[order], np.bincount(of, minlength=units)


def unit_cuts(data: np.ndarray, doc_starts: np.ndarray) -> np.ndarray:
    """Where units begin in the bytes of texts with a blank before each: at each text, and at blanks between a character that is no white
    space and a byte that is none."""
    n = len(data)
    blank = np.flatnonzero(data[1:-1] == 0x20) + 1 if n > 2 else np.zeros(0, np.int64)
    before, after = data[blank - 1], data[blank + 1]
    at = lambda k: data[np.maximum(blank - k, 0)]
    # the last bytes of white space outside ASCII: U+0085, U+00A0, U+1680, U+180E, U+2000 to U+205F, U+3000
    wide = (at(2) == 0xC2) & ((before == 0x85) | (before == 0xA0)) | (at(3) == 0xE1) & ((at(2) == 0x9A) | (at(2) == 0xA0)) & (before < 0x90)
    wide |= (at(3) == 0xE2) & ((at(2) == 0x80) | (at(2) == 0x81)) | (at(3) == 0xE3) & (at(2) == 0x80) & (before == 0x80)
    ok = (before > 0x20) & (before != 0x7F) & ~wide & (after > 0x20) & (after != 0x7F)
    first = np.zeros(n + 1, bool)
    first[doc_starts] = True
    cut = first.copy()
    cut[blank[ok & ~first[blank + 1]]] = True  # a blank that ends a text is none
    return np.flatnonzero(cut[:n])


def _packed(*columns: np.ndarray) -> bytes:
    """Numbers of any size, compressed, with their lengths before them."""
    raw = np.concatenate([[len(columns)], [len(c) for c in columns], *columns]).astype(np.int64)
    small = len(raw) == 0 or (raw.min() >= 0 and raw.max() < 1 << 31)
    raw = raw.astype(np.int32) if small else raw
    return (b"s" if small else b"l") + raw.nbytes.to_bytes(8, "little") + pa.compress(raw.tobytes(), "zstd", asbytes=True)


def _unpacked(blob: bytes) -> list[np.ndarray]:
    raw = np.frombuffer(pa.decompress(blob[9:], int.from_bytes(blob[1:9], "little"), "zstd"), np.int32 if blob[:1] == b"s" else np.int64).astype(np.int64)
    n = int(raw[0])
    return np.split(raw[n + 1 :], np.cumsum(raw[1 : n + 1])[:-1])


class Batch:
    """Documents whose units are numbered together."""

    def __init__(self, tools: Pair, partition: int):
        self.tools, self.partition, self.number = tools, partition, 0
        self.clear()

    def clear(self) -> None:
        self.rows: list[list] = []  # id, A tokens, B tokens, groups, links, hash
        self.units: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []  # units of documents, how often, units of each document
        self.size = 0

    def add(self, ids: list, texts: pa.Array) -> None:
        """Texts are not empty."""
        tools = self.tools
        spaced = pc.binary_join_element_wise(" ", texts.cast(pa.string()), "")
        ends = np.frombuffer(spaced.buffers()[1], np.int32, len(texts) + 1, 4 * spaced.offset).astype(np.int64)
        cuts = unit_cuts(np.frombuffer(spaced.buffers()[2], np.uint8)[: ends[-1]], ends[:-1])
        offsets = pa.py_buffer(np.append(cuts, ends[-1]).astype(np.int32))
        found = pa.StringArray.from_buffers(len(cuts), offsets, spaced.buffers()[2]).dictionary_encode()
        code = tools.codes(found.dictionary.to_pylist())[found.indices.to_numpy()]
        doc = np.searchsorted(ends[1:], cuts, "right")
        whole = np.bincount(doc, weights=1 - tools.numbers[code, 4], minlength=len(ids)) == 0
        code, doc = code[whole[doc]], doc[whole[doc]]
        sums = np.stack([np.bincount(doc, weights=tools.numbers[code, k], minlength=len(ids)).astype(np.int64) for k in range(4)], axis=1)
        per_doc = np.concatenate([[0], np.cumsum(np.bincount(doc, minlength=len(ids)))])
        marks = []
        for a, b, ok in zip(per_doc[:-1], per_doc[1:], whole, strict=True):
            digest = hashlib.sha256()
            for at in range(a, b, 1_000_000):  # bounded strings, however long the text
                part = tools.groups.take(pa.array(code[at : min(b, at + 1_000_000)]))
                joined = pc.binary_join(pa.ListArray.from_arrays(pa.array([0, len(part)], pa.int32()), part), ";")[0].as_py()
                digest.update((";" if at > a else "").encode() + joined.encode())
            marks.append(digest.hexdigest() if ok else "")
        self.rows += [[i, *map(int, s), m] for i, s, m in zip(ids, sums, marks, strict=True)]
        both, times = np.unique(doc * len(tools.seen) + code, return_counts=True)
        doc = both // len(tools.seen)
        self.units.append((both % len(tools.seen), times, np.bincount(doc, minlength=len(ids))))
        self.size += len(both)

    def flush(self) -> Iterator[pa.RecordBatch]:
        """A row per document with its units, and one with the batch's id pairs, how many documents have each, and each unit's links."""
        if not self.rows:
            return
        name = self.partition << 32 | self.number
        code, times, per_doc = (np.concatenate(x) for x in zip(*self.units, strict=True))
        used, code = np.unique(code, return_inverse=True)
        pairs, weights, sizes = self.tools.links
        at = starts_of(sizes)[used]
        links, _ = ragged(pairs, at, sizes[used])
        weights, _ = ragged(weights, at, sizes[used])
        links, slots = np.unique(links, return_inverse=True)
        in_unit = sizes[used]
        # documents that have a pair: distinct (document, pair), some documents at a time
        docs_of = np.zeros(len(links), np.int64)
        firsts, rows = np.concatenate([[0], np.cumsum(per_doc)]), 0
        while rows < len(per_doc):
            end = max(rows + 1, int(np.searchsorted(firsts, firsts[rows] + ENTRIES // 2, "right")) - 1)
            own = code[firsts[rows] : firsts[end]]
            doc = np.repeat(np.arange(end - rows), per_doc[rows:end])
            here, n = ragged(slots, starts_of(in_unit)[own], in_unit[own])
            docs_of += np.bincount(np.unique(np.repeat(doc, n) * max(len(links), 1) + here, return_counts=True)[0] % max(len(links), 1), minlength=len(links))
            rows = end
        packed = []
        for a, b in zip(firsts[:-1], firsts[1:], strict=True):
            steps = np.diff(code[a:b], prepend=0)
            packed.append(_packed(steps, times[a:b]))
        columns = list(zip(*self.rows, strict=True))
        own = [pa.array([name] * len(packed), pa.int64()), *(pa.array(c, t) for c, t in zip(columns, [pa.int64()] * 5 + [pa.string()], strict=True))]
        nothing = pa.nulls(len(packed), pa.binary())
        blank = [pa.nulls(1, t) for t in [pa.int64()] * 5 + [pa.string(), pa.binary()]]
        kinds = ["batch", "doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "units", "pairs", "docs", "links"]
        blobs = [pa.array([_packed(*x)], pa.binary()) for x in ([links], [docs_of], [in_unit, slots, weights])]
        yield pa.RecordBatch.from_arrays([*own, pa.array(packed, pa.binary()), nothing, nothing, nothing], kinds)
        yield pa.RecordBatch.from_arrays([pa.array([name], pa.int64()), *blank, *blobs], kinds)
        self.number += 1
        self.clear()
        if len(self.tools.seen) > MEMO:
            self.tools.forget()


ENCODED = (
    "batch long, doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, units binary, "
    "pairs binary, docs binary, links binary"
)


def encode(docs: DataFrame, a: str, b: bytes) -> DataFrame:
    """Rows of documents and of batches, as ``Batch.flush`` makes them."""
    spec = docs.sparkSession.sparkContext.broadcast((a, b))  # the tokenizers' files, a few MB

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        if "pair" not in _LOADED:
            _LOADED["pair"] = Pair(*spec.value)
            _LOADED["files"] = spec.value
        elif _LOADED["files"] != spec.value:
            _LOADED["pair"], _LOADED["files"] = Pair(*spec.value), spec.value
        batch = Batch(_LOADED["pair"], TaskContext.get().partitionId())
        for rows in batches:
            texts = pc.fill_null(rows.column(1), "")
            sizes = pc.binary_length(texts).to_numpy(zero_copy_only=False).astype(np.int64)
            empty = rows.column(0).filter(pa.array(sizes == 0)).to_pylist()
            batch.rows += [[i, 0, 0, 0, 0, ""] for i in empty]
            batch.units.append((np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(empty), np.int64)))
            ids, texts, sizes = rows.column(0).filter(pa.array(sizes > 0)), texts.filter(pa.array(sizes > 0)), sizes[sizes > 0]
            ends, at = np.cumsum(sizes), 0
            while at < len(texts):
                end = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + SLICE, "right")))
                batch.add(ids.slice(at, end - at).to_pylist(), texts.slice(at, end - at))
                at = end
                if batch.size > ENTRIES:
                    yield from batch.flush()
        yield from batch.flush()

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, ENCODED)


def pairs_of(encoded: DataFrame) -> DataFrame:
    """batch, place (in the batch), a, b, docs: the id pairs of each batch and how many of its documents have them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            for name, links, docs in zip(*(rows.column(i).to_pylist() for i in range(3)), strict=True):
                (links,), (docs,) = _unpacked(links), _unpacked(docs)
                for at in range(0, len(links), 100_000):
                    part = links[at : at + 100_000]
                    columns = [np.full(len(part), name), np.arange(at, at + len(part)), part >> 32, part & 0xFFFFFFFF, docs[at : at + 100_000]]
                    kinds = [pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int64()]
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["batch", "place", "a", "b", "docs"])

    return encoded.where("pairs IS NOT NULL").select("batch", "pairs", "docs").mapInArrow(run, "batch long, place int, a int, b int, docs long")


def counted(pairs: DataFrame) -> DataFrame:
    """a, b, count (documents that hold the pair), best (the highest count of A's id)."""
    counts = pairs.groupBy("a", "b").agg(F.sum("docs").alias("count"))
    highest = counts.groupBy("a").agg(F.max("count").alias("highest"))
    return counts.join(highest, "a").select("a", "b", "count", (F.col("count") == F.col("highest")).alias("best"))


def _answers(docs: pa.Table, found: pa.Table) -> pa.Table:
    """n_best and count_sum of a batch's documents."""
    docs = docs.combine_chunks()
    whole = docs.filter(pc.is_valid(docs["links"]))
    docs = docs.filter(pc.is_null(docs["links"]))
    names = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    in_unit, slots, weights = _unpacked(whole["links"][0].as_py())
    n, order = len(in_unit), np.argsort(found["place"].to_numpy())
    counts, best = found["count"].to_numpy()[order], found["best"].to_numpy().astype(np.int64)[order]
    unit = np.repeat(np.arange(n), in_unit)
    per_unit = []
    for values in (best, counts):
        total = np.zeros(n, np.int64)
        np.add.at(total, unit, weights * values[slots])
        per_unit.append(total)
    sums = []
    for packed in docs["units"].to_pylist():
        steps, times = _unpacked(packed)
        sums.append([int((t[np.cumsum(steps)] * times).sum()) for t in per_unit])
    columns = {c: docs[c] for c in names if c in docs.column_names}
    columns |= {c: pa.array([s[i] for s in sums], pa.int64()) for i, c in enumerate(("n_best", "count_sum"))}
    return pa.table([columns[c] for c in names], names)


def align(docs: DataFrame, a: str | None = None, b: str | None = None) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256 of every row.

    ``a`` is the path of a byte-level BPE file, ``b`` of a sentencepiece BPE model with byte fallback. Links are all pairs of an A and
    a B token occurrence in one group; a pair of ids counts the documents that hold it linked; n_best are links whose count is the highest of
    their A id (ties included), count_sum sums the counts of all links. Texts that are null or empty, or that a tokenizer's bytes
    do not give back, have zeros and ''. Repeated rows are documents of their own; an empty table gives no rows; extra columns are ignored.
    """
    import public_tokenizers

    with open(a or public_tokenizers.path("byte_bpe_50k.json"), encoding="utf-8") as f:
        spec = f.read()
    with open(b or public_tokenizers.path("piece_bpe_32k.model"), "rb") as f:
        model = f.read()
    encoded = written(encode(docs, spec, model), "encoded")
    pairs = pairs_of(encoded)
    found = pairs.drop("docs").join(counted(pairs), ["a", "b"]).select("batch", "place", "count", "best")
    out = "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"
    return encoded.drop("pairs", "docs").groupBy("batch").cogroup(found.groupBy("batch")).applyInArrow(_answers, out)
