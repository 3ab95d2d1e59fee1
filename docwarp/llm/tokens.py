"""Token ids of whole text columns with the ``tokenizers`` library, inside Arrow tasks.

Ids always come from the library. For a tokenizer whose rules never look across white space the words of a batch are
made distinct first and each distinct word of a bounded slice is encoded once (the first words seen are kept in a small memo);
any other tokenizer encodes whole texts. Both give the ids of ``Tokenizer.encode(text, add_special_tokens=False)``.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Words whose pre-tokens are one run of letters and maybe one run of stops.
_STOPS = "!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~"  # ASCII punctuation but the apostrophe, which may begin a contraction
_LETTERS = "^[a-zA-ZÀ-ÖØ-öø-ÿ]+"
_PLAIN = _LETTERS + r"[!-&(-/:-@\[-`{-~]*$"
#: The pre-tokenizer pattern under which words are independent. Fixed value.
_WORD_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
_ENCODERS: dict[str, "Encoder"] = {}


def tokenizer_json(path: str | None = None) -> str:
    """The tokenizer file's content, read on the driver and shipped to tasks (a few MB, whatever the input)."""
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path("word_bpe_49k.json")
    with open(path, encoding="utf-8") as f:
        return f.read()


def _byte_alphabet() -> dict[int, str]:
    """The printable character that byte-level BPE uses for each byte: printable Latin-1 bytes stand for themselves, the rest follow from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(rest)}


class Encoder:
    def __init__(self, spec: str, memo: int = 1_000_000, chars: int = 16_000_000):
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_str(spec)
        self.memo, self.chars = memo, chars
        self.by_word = self._by_word(json.loads(spec))
        self.alphabet = {b: c for b, c in _byte_alphabet().items() if b != 10}  # no word has a line feed
        self.words = pa.array([], pa.string())
        self.ids = np.zeros(0, np.uint32)
        self.counts = np.zeros(0, np.int64)

    @staticmethod
    def _by_word(spec: dict) -> bool:
        """Whether the file has the rules under which white-space separated words are encoded independently."""
        try:
            kinds = [n["type"] for n in spec["normalizer"]["normalizers"]]
            split, level = spec["pre_tokenizer"]["pretokenizers"]
            return (
                kinds == ["NFC", "Replace", "Lowercase"]
                and split["pattern"] == {"Regex": _WORD_PATTERN}
                and (split["behavior"], split["invert"]) == ("Removed", True)
                and (level["type"], level["add_prefix_space"], level["use_regex"]) == ("ByteLevel", False, False)
                and spec["model"]["type"] == "BPE"
                and not spec["model"]["dropout"]
                and not any(re.search("[a-z ]{3}", t["content"]) is None for t in spec.get("added_tokens", []))
            )
        except (KeyError, TypeError, ValueError):
            return False

    def _ids(self, words: pa.Array, plain: np.ndarray) -> list[list[int]]:
        """Ids of each word. A plain one is a pre-token, given lower-case: its bytes in the byte alphabet go to the library's BPE model; others go through the tokenizer."""
        joined = pc.binary_join(pa.ListArray.from_arrays(pa.array([0, len(words)], pa.int32()), words), "\n")
        mapped = joined[0].as_py().encode().decode("latin-1").translate(self.alphabet).split("\n") if len(words) else []
        others = np.flatnonzero(~plain)
        for i in others:
            mapped[i] = ""
        run = self.tok.model.tokenize
        ids = [[t.id for t in run(m)] for m in mapped]
        for i, w in zip(others, words.take(pa.array(others)).to_pylist(), strict=True):
            ids[i] = self.tok.encode(w, add_special_tokens=False).ids
        return ids

    def _encoded(self, words: pa.Array, plain: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids, ids per word). Words of the memo are looked up, others encoded once each; the first ones fill the memo."""
        found = words.dictionary_encode()
        names, codes = found.dictionary, found.indices.to_numpy()
        known = pc.index_in(names, value_set=self.words)
        unknown = pc.is_null(known).to_numpy(zero_copy_only=False)
        simple = np.ones(len(names), bool)
        simple[codes[~plain]] = False
        new = names.filter(pa.array(unknown))
        ids = self._ids(new, simple[unknown])
        counts = np.concatenate([self.counts, np.array([len(x) for x in ids], np.int64)])
        flat = np.concatenate([self.ids, np.fromiter(chain.from_iterable(ids), np.uint32)])
        starts = np.cumsum(counts) - counts
        slots = np.empty(len(names), np.int64)
        slots[~unknown] = known.drop_null().to_numpy()
        slots[unknown] = len(self.words) + np.arange(len(new))
        more = min(self.memo - len(self.words), len(new))
        if more > 0:
            self.words = pa.concat_arrays([self.words, new.slice(0, more)])
            self.counts = counts[: len(self.words)]
            self.ids = flat[: self.counts.sum()]
        slots = slots[codes]
        return ragged(flat, starts[slots], counts[slots])

    def _distinct(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all words, ids per word). Letters then stops are two pre-tokens; all else goes through the whole tokenizer."""
        plain = pc.match_substring_regex(words, _PLAIN).to_numpy(zero_copy_only=False)
        core = pc.utf8_lower(pc.ascii_rtrim(words, characters=_STOPS))
        stops = pc.if_else(pa.array(plain), pc.replace_substring_regex(words, _LETTERS, ""), "")
        core = pc.if_else(pa.array(plain), core, words)
        n = len(words)
        both = pa.concat_arrays([core, stops]).take(pa.array(np.arange(2 * n).reshape(2, n).T.ravel()))
        ids, sizes = self._encoded(both, np.stack([plain, np.ones(n, bool)], axis=1).ravel())
        return ids, sizes.reshape(n, 2).sum(axis=1)

    def _some(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids, ids per text) of a bounded slice."""
        if not self.by_word:
            found = self.tok.encode_batch(texts.to_pylist(), add_special_tokens=False)
            sizes = np.array([len(e.ids) for e in found], np.int64)
            return np.concatenate([np.zeros(0, np.uint32), *(np.array(e.ids, np.uint32) for e in found)]), sizes
        words = pc.ascii_split_whitespace(texts)
        flat = words.flatten().dictionary_encode()
        offsets = np.asarray(words.offsets, np.int64)
        offsets = offsets - offsets[0]
        if len(flat) == 0:
            return np.zeros(0, np.uint32), np.zeros(len(texts), np.int64)
        ids, sizes = self._distinct(flat.dictionary)
        codes = flat.indices.to_numpy()
        starts = np.cumsum(sizes) - sizes
        out, n = ragged(ids, starts[codes], sizes[codes])
        ends = np.concatenate([[0], np.cumsum(n)])
        return out, np.diff(ends[offsets])

    def _pieces(self, text: str) -> list[str]:
        """A very long text, cut before white space where words are independent, so that memory stays bounded."""
        if not self.by_word or len(text) <= self.chars:
            return [text]
        out, at = [], 0
        while at < len(text):
            end = min(len(text), at + self.chars)
            if end < len(text):
                gap = max(text.rfind(c, at + 1, end) for c in " \n\t\r")
                end = gap if gap > at else end if text[end].isascii() and text[end].isspace() else _next_gap(text, end)
            out.append(text[at:end])
            at = end
        return out

    def encode(self, texts: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
        """Yield (first row, rows, ids, ids per row) for slices of bounded size; null is an empty text."""
        if isinstance(texts, pa.ChunkedArray):
            texts = texts.combine_chunks()
        texts = pc.fill_null(texts, "")
        if pa.types.is_large_string(texts.type) or pa.types.is_string(texts.type):
            sizes = np.asarray(pc.binary_length(texts), np.int64)
        at = 0
        while at < len(texts):
            end, total = at + 1, int(sizes[at])
            while end < len(texts) and total + sizes[end] <= self.chars:
                total += int(sizes[end])
                end += 1
            if total > self.chars:  # one long text
                ids = [self._some(pa.array([p]))[0] for p in self._pieces(texts[at].as_py())]
                ids = np.concatenate(ids)
                yield at, 1, ids, np.array([len(ids)], np.int64)
            else:
                ids, n = self._some(texts.slice(at, end - at))
                yield at, end - at, ids, n
            at = end


def ragged(values: np.ndarray, starts: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The slices ``values[start : start + count]`` one after the other, and their lengths."""
    ends = np.cumsum(counts)
    where = np.repeat(starts - ends + counts, counts)
    where += np.arange(len(where))
    return values[where], counts


def _next_gap(text: str, at: int) -> int:
    m = re.compile("[ \n\t\r]").search(text, at)
    return m.start() if m else len(text)


def encoder(spec: str) -> Encoder:
    """One encoder per worker process and tokenizer."""
    if spec not in _ENCODERS:
        _ENCODERS.clear()
        _ENCODERS[spec] = Encoder(spec)
    return _ENCODERS[spec]
