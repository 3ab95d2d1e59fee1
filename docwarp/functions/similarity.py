"""Trigram word similarity, cosine similarity and small text functions, as column expressions where they can be."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import pandas_udf

from docwarp.functions.extents import similarities

_SPLIT = r"[^\p{L}\p{N}]+"


def words(text: Column) -> Column:
    return F.filter(F.split(F.lower(text), _SPLIT, -1), lambda w: w != "")


def trigrams(text: Column) -> Column:
    """Ordered trigrams of the padded lower-case words."""
    def of(w: Column) -> Column:
        padded = F.concat(F.lit("  "), w, F.lit(" "))
        return F.transform(F.sequence(F.lit(1), F.char_length(w) + 1), lambda i: F.substring(padded, i, F.lit(3)))

    return F.flatten(F.transform(words(text), of))


def distinct_trigrams(text: Column) -> Column:
    return F.array_distinct(trigrams(text))


def word_similarity_short(query: Column, text: Column) -> Column:
    """word_similarity for short texts (titles): all extents of the text's trigrams that begin and end on a shared one."""
    q, t = distinct_trigrams(query), trigrams(text)

    def best(q: Column, t: Column, at: Column) -> Column:
        def of(i: Column, j: Column) -> Column:
            part = F.slice(t, i, j - i + 1)
            shared = F.size(F.array_intersect(part, q))
            return shared / (F.size(q) + F.size(F.array_distinct(part)) - shared)

        inner = lambda i: F.array_max(F.transform(F.filter(at, lambda j: j >= i), lambda j: of(i, j)))
        return F.coalesce(F.array_max(F.transform(at, inner)), F.lit(0.0))

    at = F.filter(F.when(F.size(t) > 0, F.sequence(F.lit(1), F.size(t))).otherwise(F.array().cast("array<int>")), lambda i: F.array_contains(q, F.get(t, i - 1)))
    return best(q, t, at)


def similarity(query: str | None, text: str | None) -> float:
    """word_similarity of two strings."""
    return float(similarities([text], [query], np.zeros(1, np.int64), np.zeros(1, np.int64))[0])


@pandas_udf(T.DoubleType())
def word_similarity(query: pd.Series, text: pd.Series) -> pd.Series:
    """word_similarity of pairs of any length, all pairs of an Arrow batch together; 0 where either is null."""
    text_of, texts = pd.factorize(text.fillna(""))
    query_of, queries = pd.factorize(query.fillna(""))
    return pd.Series(similarities(list(texts), list(queries), text_of.astype(np.int64), query_of.astype(np.int64)))


def cosine(a: Column, b: Column) -> Column:
    """Exact cosine in double precision; null for a null or zero vector; vectors of unequal size fail."""
    return cosine_by(a, b, length(a), length(b))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)


def length(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine_by(a: Column, b: Column, length_a: Column, length_b: Column) -> Column:
    """``cosine`` of vectors whose lengths are known."""
    norm = length_a * length_b
    sized = F.when(F.size(a) == F.size(b), F.lit(1.0)).otherwise(F.raise_error(F.lit("vectors differ in size")).cast("double"))
    return F.when(a.isNotNull() & b.isNotNull() & (norm > 0), sized * dot(a, b) / norm)


def contains_text(text: Column, needle: Column) -> Column:
    """Literal case-insensitive containment; never true for a blank needle."""
    return (F.trim(needle) != "") & F.contains(F.lower(text), F.lower(needle))


def substantial(text: Column) -> Column:
    """Whether a chunk is worth showing: long enough, enough letters or digits, not a short table row."""
    n = F.char_length(F.trim(text))
    solid = F.char_length(text) - F.char_length(F.regexp_replace(text, "[가-힣A-Za-z0-9]", ""))
    return (n >= 20) & (solid / F.greatest(F.char_length(text), F.lit(1)) >= 0.35) & ~((n < 40) & F.contains(text, F.lit("|")))


def display_snippet(text: Column, most: int = 200) -> Column:
    flat = F.trim(F.regexp_replace(text, r"\s+", " "))
    return F.when(F.char_length(flat) > most, F.concat(F.rtrim(F.substring(flat, 1, most)), F.lit("…"))).otherwise(flat)


def query_digest(query: Column) -> Column:
    return F.when(F.trim(query) != "", F.substring(F.sha2(query, 256), 1, 12))


def citation_anchor(file_type: Column, start: Column, end: Column, page: Column) -> Column:
    paged = (file_type == "pdf") & page.isNotNull()
    none = F.lit(None).cast("long")
    return F.struct(
        F.when(paged, "page").otherwise("paragraph").alias("type"), F.when(paged, none).otherwise(start).alias("paragraph_index"), F.when(paged, none).otherwise(end).alias("paragraph_end"), F.when(paged, page).alias("page_number")
    )


def fold_separators(text: Column) -> Column:
    return F.regexp_replace(F.lower(text), r"[\s_.,/()\[\]-]+", " ")
