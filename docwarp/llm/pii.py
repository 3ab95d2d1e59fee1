"""Personal data in whole texts: fixed patterns, and a skip-chain conditional random field that adds what they miss.

The patterns (email, ip, card, phone) are taken as they are. They miss entities that run into each other, such as a card number right
after a telephone number. The field labels tokens: every token with a digit or an @ is a node (all others are nothing for sure), adjacent
nodes are joined by chain potentials, and nodes far apart in a document that repeat or resemble each other share skip potentials. It
is trained on what the patterns find in a bounded sample, by pseudo-likelihood; loopy message passing, a fixed number of rounds, makes the
labels of a document agree. Its spans are added where no pattern's span lies; the patterns' own always stay.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

KINDS = ("email", "ip", "card", "phone")
LABELS = len(KINDS) + 1  # and nothing, the last
NOTHING, UNKNOWN = len(KINDS), len(KINDS) + 1
SPAN = "array<struct<kind string, start long, end long, base boolean>>"

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)+")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_NOT_DIGIT = re.compile(r"[^0-9]+")
_TOKEN, _MARK = re.compile(r"\S+"), re.compile("[0-9@]")
_CORE = re.compile(r"[^\W_]")


def luhn(digits: str) -> bool:
    n = [int(c) for c in reversed(digits)]
    return (sum(n[::2]) + sum(2 * d - 9 * (d > 4) for d in n[1::2])) % 10 == 0


def _small(part: str) -> bool:
    """A decimal number of at most 255, leading zeros allowed, however long."""
    part = part.lstrip("0")
    return len(part) < 3 or len(part) == 3 and part <= "255"


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """From each @ whose domain fits back over the local part: linear, and what the pattern matches from the left."""
    last, at = 0, text.find("@")
    while at >= 0:
        domain = _DOMAIN.match(text, at)
        if domain:
            start = at
            while start > last and text[start - 1] in _LOCAL:
                start -= 1
            if start < at:
                yield start, domain.end()
                last = domain.end()
        at = text.find("@", at + 1)


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the patterns' matches that pass their checks, by start, then kind."""
    out = [(a, 0, b) for a, b in _emails(text)]
    out += [(m.start(), 1, m.end()) for m in _IP.finditer(text) if all(map(_small, m[0].split(".")))]
    for m in _CARD.finditer(text):
        digits = _NOT_DIGIT.sub("", m[0]) if m.end() - m.start() <= 37 else ""  # 19 digits with a separator between each
        if 12 <= len(digits) <= 19 and luhn(digits):
            out.append((m.start(), 2, m.end()))
    out += [(m.start(), 3, m.end()) for m in _PHONE.finditer(text) if 9 <= len(_NOT_DIGIT.sub("", m[0])) <= 15]
    return sorted(out)


#: What is said of a token, one bit each.
_TRAITS = (
    "plus", "at", "address", "digits only", "1 digit", "2 digits", "3 digits", "4 digits", "5-6 digits", "7-8 digits", "9-11 digits",
    "12-19 digits", "20 digits", "four parts", "four small parts", "dot", "dash", "letters", "luhn", "brackets", "other signs",
)
_BIT = {name: 1 << i for i, name in enumerate(_TRAITS)}
_ADDRESS = re.compile(r"[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)+")
_FOUR = re.compile(r"[0-9]++(?:\.[0-9]++){3}")
_LETTER, _OTHER = re.compile(r"[^\W\d_]"), re.compile(r"[^\w\s.()+@-]")


def traits(token: str, core: str) -> int:
    digits = _NOT_DIGIT.sub("", core)
    n = len(digits)
    names = [("plus", core.startswith("+")), ("at", "@" in core), ("address", _ADDRESS.fullmatch(core)), ("digits only", n == len(core))]
    names.append(((None, "1 digit", "2 digits", "3 digits", "4 digits")[n] if n < 5 else "5-6 digits" if n < 7 else "7-8 digits" if n < 9 else "9-11 digits" if n < 12 else "12-19 digits" if n < 20 else "20 digits", n))
    four = _FOUR.fullmatch(core)
    names += [("four parts", four), ("four small parts", four and all(map(_small, core.split("."))))]
    names += [("dot", "." in core), ("dash", "-" in core), ("letters", _LETTER.search(core)), ("luhn", 12 <= n <= 19 and luhn(digits))]
    names += [("brackets", "(" in token and ")" in token), ("other signs", _OTHER.search(core))]
    return sum(_BIT[name] for name, holds in names if holds)


@dataclass
class Nodes:
    """Nodes of some documents: where they stand, their traits, and the links between them."""

    doc: np.ndarray
    start: np.ndarray
    end: np.ndarray
    place: np.ndarray  # number of the token in its document
    traits: np.ndarray
    digits: np.ndarray
    chain: np.ndarray  # (first, second) of adjacent nodes
    skip: np.ndarray  # of nodes that repeat or resemble each other


def nodes_of(texts: list[str], most: int | None = None) -> Nodes:
    """Nodes of each text; a repeated token is linked with its occurrence before, so links grow as the text does."""
    rows, chain, skip = [], [], []
    for doc, text in enumerate(texts):
        before: dict[str, int] = {}
        first = len(rows)
        for place, m in enumerate(_TOKEN.finditer(text)):
            token = m[0]
            if not _MARK.search(token):
                continue
            if most is not None and len(rows) - first >= most:
                break
            head = _CORE.search(token)
            if not head:  # an @ alone
                continue
            start = head.start() - (token[head.start() - 1 : head.start()] == "+")
            end = len(token)
            while not _CORE.match(token, end - 1):
                end -= 1
            core = token[start:end]
            digits = _NOT_DIGIT.sub("", core)
            at = len(rows)
            if at > first and rows[-1][3] == place - 1:
                chain.append((at - 1, at))
            keys = ([core.lower()] if len(core) >= 5 else []) + (["#" + digits] if len(digits) >= 7 else []) + (["@" + core.rpartition("@")[2].lower()] if "@" in core else [])
            for other in {before[k] for k in keys if k in before}:
                skip.append((other, at))
            before.update((k, at) for k in keys)
            rows.append((doc, m.start() + start, m.start() + end, place, traits(token, core), len(digits)))
    columns = np.array(rows, np.int64).reshape(-1, 6).T
    pairs = [np.array(x, np.int64).reshape(-1, 2) for x in (chain, skip)]
    return Nodes(*columns, *pairs)


def features(nodes: Nodes) -> np.ndarray:
    """Traits of each node and of its neighbours, with a constant."""
    n = len(_TRAITS)
    own = (nodes.traits[:, None] >> np.arange(n) & 1).astype(np.float32)
    out = np.zeros((len(own), 3 * n + 3), np.float32)
    out[:, :n], out[:, -1] = own, 1
    a, b = nodes.chain.T
    out[a, n : 2 * n], out[b, 2 * n : 3 * n] = own[b], own[a]
    out[a, -3], out[b, -2] = 1, 1
    return out


@dataclass
class Model:
    unary: np.ndarray  # features x labels
    chain: np.ndarray  # label x label, first and second of adjacent nodes
    skip: np.ndarray  # label x label, symmetric


def _softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def fit(nodes: Nodes, labels: np.ndarray, rounds: int = 300, rate: float = 0.1, decay: float = 1e-3) -> Model:
    """Weights with the highest pseudo-likelihood: each node's label given its traits and the labels of its neighbours. Adam over all nodes."""
    x, n = features(nodes), len(labels)
    seen = np.eye(LABELS + 1, LABELS, dtype=np.float32)[labels]  # an unknown label says nothing and is not learned from
    known = (labels != UNKNOWN)[:, None]
    around = np.zeros((3, n, LABELS), np.float32)  # labels before, after, linked
    a, b = nodes.chain.T
    c, d = nodes.skip.T
    np.add.at(around[0], b, seen[a])
    np.add.at(around[1], a, seen[b])
    np.add.at(around[2], c, seen[d])
    np.add.at(around[2], d, seen[c])
    weights = [np.zeros((x.shape[1], LABELS)), np.zeros((LABELS, LABELS)), np.zeros((LABELS, LABELS))]
    moments = [(np.zeros_like(w), np.zeros_like(w)) for w in weights]
    for step in range(1, rounds + 1):
        unary, chain, skip = weights
        miss = known * (seen - _softmax(x @ unary + around[0] @ chain + around[1] @ chain.T + around[2] @ skip))
        slope = around[2].T @ miss
        slopes = [x.T @ miss, around[0].T @ miss + miss.T @ around[1], (slope + slope.T) / 2]
        for w, g, m in zip(weights, slopes, moments, strict=True):
            g = g / max(n, 1) - decay * w
            m[0][...] = 0.9 * m[0] + 0.1 * g
            m[1][...] = 0.999 * m[1] + 0.001 * g * g
            w += rate * (m[0] / (1 - 0.9**step)) / (np.sqrt(m[1] / (1 - 0.999**step)) + 1e-8)
    return Model(*weights)


def beliefs(model: Model, nodes: Nodes, rounds: int = 12) -> np.ndarray:
    """Label probabilities of each node by loopy sum-product message passing along chain and skip links, a fixed number of rounds."""
    unary = features(nodes) @ model.unary
    pairs = np.concatenate([nodes.chain, nodes.skip])
    if not len(pairs):
        return _softmax(unary)
    kind = np.repeat([0, 1], [len(nodes.chain), len(nodes.skip)])
    potentials = np.exp(np.stack([model.chain, model.skip]))
    source, target = np.concatenate([pairs, pairs[:, ::-1]]).T
    across = np.concatenate([potentials[kind], potentials[kind].transpose(0, 2, 1)])
    back = np.concatenate([np.arange(len(pairs), 2 * len(pairs)), np.arange(len(pairs))])
    messages = np.zeros((2 * len(pairs), LABELS))
    total = unary
    for _ in range(rounds):
        leaving = _softmax(total[source] - messages[back])
        new = np.log(np.einsum("ek,ekl->el", leaving, across))
        messages = 0.5 * messages + 0.5 * (new - new.mean(axis=1, keepdims=True))
        total = unary.copy()
        np.add.at(total, target, messages)
    return _softmax(total)


def run_ons(text: str) -> list[tuple[int, int]]:
    """Matches of card and phone with too many digits: more than one entity, of which the patterns say nothing."""
    return [m.span() for pattern, most in ((_CARD, 19), (_PHONE, 15)) for m in pattern.finditer(text) if len(_NOT_DIGIT.sub("", m[0])) > most]


def labels_of(nodes: Nodes, texts: list[str]) -> np.ndarray:
    """The kind of the pattern's span that covers a node; unknown inside run-ons, else nothing."""
    out = np.full(len(nodes.doc), NOTHING)
    for doc, text in enumerate(texts):
        lo, hi = np.searchsorted(nodes.doc, [doc, doc + 1])
        place = lambda start, end: slice(lo + np.searchsorted(nodes.end[lo:hi], start, "right"), lo + np.searchsorted(nodes.start[lo:hi], end, "left"))  # noqa: B023, E731
        for span in run_ons(text):
            out[place(*span)] = UNKNOWN
        for start, kind, end in reversed(base_spans(text)):
            out[place(start, end)] = kind
    return out


def added_spans(nodes: Nodes, chances: np.ndarray, spans: list[list[tuple[int, int, int]]]) -> list[list[tuple[int, int, int]]]:
    """What the field finds outside the patterns' spans: runs of adjacent nodes of one kind that can be one entity of it."""
    best = chances.argmax(axis=1)
    best[chances.max(axis=1) < 0.5] = NOTHING
    plus = nodes.traits & _BIT["plus"] != 0
    out: list[list[tuple[int, int, int]]] = [[] for _ in spans]
    runs: list[list[int]] = []  # doc, kind, start, end, digits, last place
    for i in np.flatnonzero(best != NOTHING).tolist():
        doc, kind, place = int(nodes.doc[i]), int(best[i]), int(nodes.place[i])
        last = runs[-1] if runs else None
        whole = kind < 2 or kind == 2 and nodes.digits[i] >= 12 or kind == 3 and plus[i]
        if last and last[0] == doc and last[1] == kind and last[5] == place - 1 and not whole and not (kind == 2 and last[4] >= 12):
            last[3:] = [int(nodes.end[i]), last[4] + int(nodes.digits[i]), place]
        else:
            runs.append([doc, kind, int(nodes.start[i]), int(nodes.end[i]), int(nodes.digits[i]), place])
    for doc, kind, start, end, digits, _ in runs:
        fits = kind < 2 or 12 <= digits <= 19 if kind != 3 else 9 <= digits <= 15
        if fits and not any(s < end and start < e for s, _, e in spans[doc]):
            out[doc].append((start, kind, end))
    return out


def train(docs: DataFrame, sample: int = 4000, nodes_per_doc: int = 200) -> Model:
    """A model from at most ``sample`` documents that have a digit or an @ (those with the least hash of id and text), of each of them the
    first ``nodes_per_doc`` nodes; labels are what the patterns find there. Without such documents it finds nothing."""
    rows = docs.select(F.col("doc_id"), "text").where(F.col("text").rlike("[0-9@]")).withColumn("mark", F.xxhash64("doc_id", "text"))
    least = [r["mark"] for r in rows.select("mark").orderBy("mark").limit(sample).collect()]
    kinds = "mark long, traits binary, labels binary, chain binary, skip binary"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for mark, text in zip(*(batch.column(i).to_pylist() for i in range(2)), strict=True):
                nodes = nodes_of([text], nodes_per_doc)
                columns = [nodes.traits, labels_of(nodes, [text]), nodes.chain, nodes.skip]
                yield pa.RecordBatch.from_arrays([pa.array([mark], pa.int64()), *(pa.array([c.astype(np.int64).tobytes()], pa.binary()) for c in columns)], ["mark", "traits", "labels", "chain", "skip"])

    found = rows.where(F.col("mark") <= least[-1]).select("mark", "text").mapInArrow(run, kinds).collect() if least else []
    parts, at = [], 0
    for r in sorted(found, key=lambda r: (r["mark"], r["traits"]))[:sample]:
        own = [np.frombuffer(r[c], np.int64) for c in ("traits", "labels", "chain", "skip")]
        parts.append((own[0], own[1], own[2].reshape(-1, 2) + at, own[3].reshape(-1, 2) + at))
        at += len(own[0])
    if not at:
        unary = np.zeros((3 * len(_TRAITS) + 3, LABELS))
        unary[-1, NOTHING] = 20
        return Model(unary, np.zeros((LABELS, LABELS)), np.zeros((LABELS, LABELS)))
    said, labels, chain, skip = (np.concatenate(x) for x in zip(*parts, strict=True))
    none = np.zeros(at, np.int64)
    return fit(Nodes(none, none, none, none, said, none, chain, skip), labels)


def spans_of(texts: list[str], model: Model) -> list[list[tuple[int, int, int, bool]]]:
    """(start, kind, end, base) of each text, by start, then kind."""
    base = [base_spans(t) for t in texts]
    nodes = nodes_of(texts)
    more = added_spans(nodes, beliefs(model, nodes), base) if len(nodes.doc) else [[] for _ in texts]
    return [sorted([(*s, True) for s in a] + [(*s, False) for s in b]) for a, b in zip(base, more, strict=True)]


def _found(texts: pa.Array, model: Model, chars: int = 4_000_000) -> list[list[tuple[int, int, int, bool]]]:
    """Spans of each text; those without a digit or an @ have none. Some texts at a time."""
    out: list[list[tuple[int, int, int, bool]]] = [[] for _ in range(len(texts))]
    texts = pc.fill_null(texts, "")
    which = np.flatnonzero(pc.match_substring_regex(texts, "[0-9@]").to_numpy(zero_copy_only=False)).tolist()
    while which:
        some, size = [], 0
        while which and (not some or size < chars):
            some.append((which[0], texts[which.pop(0)].as_py()))
            size += len(some[-1][1])
        for (i, _), spans in zip(some, spans_of([t for _, t in some], model), strict=True):
            out[i] = spans
    return out


def find(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, spans (kind, start, end in code points, end exclusive, base: the patterns' own) of every row, by start, then kind.

    Null and empty texts have none; repeated rows answer alike; an empty table gives no rows; extra columns are ignored. A document's
    result depends on its text and the model alone.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            spans = [[{"kind": KINDS[k], "start": a, "end": b, "base": own} for a, k, b, own in s] for s in _found(batch.column(1), model)]
            kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("base", pa.bool_())]))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(spans, kind)], ["doc_id", "spans"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, f"doc_id long, spans {SPAN}")


def redact(text: Column, spans: Column) -> Column:
    """The text with each span replaced by its kind in brackets; of overlapping spans the first counts."""
    start = F.struct(F.lit("").alias("done"), F.lit(0).cast("long").alias("at"))
    step = lambda s, x: F.when(x["start"] < s["at"], s).otherwise(
        F.struct(F.concat(s["done"], F.substr(text, s["at"] + 1, x["start"] - s["at"]), F.lit("["), x["kind"], F.lit("]")).alias("done"), x["end"].alias("at"))
    )
    return F.aggregate(spans, start, step, lambda s: F.concat(s["done"], F.substr(text, s["at"] + 1)))


def listed(spans: Column) -> Column:
    """kind:start:end of each span, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
