"""Language identification with a byte-level convolutional network trained in numpy.

Bytes are embedded, filters of several widths slide over fixed-length windows, each filter's maximum over the window goes
through a ReLU and a dense softmax layer. A document's prediction is the byte-weighted mean of the softmax over all its
windows: the whole text counts, in batches of windows of bounded size.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

SCHEMA = "doc_id long, lang_pred string, score double"
UNKNOWN = "und"


@dataclass
class ByteCNN:
    langs: list[str]
    window: int
    widths: tuple[int, ...]
    embed: np.ndarray  # 256 x d; row 0 (padding) stays zero
    filters: list[np.ndarray]  # per width: (width * d) x f
    bias: list[np.ndarray]
    dense: np.ndarray  # (widths * f) x langs
    dense_bias: np.ndarray

    @classmethod
    def fresh(cls, langs: list[str], window: int, widths: tuple[int, ...], d: int, f: int, rng) -> ByteCNN:
        embed = rng.normal(0, 0.5, (256, d)).astype(np.float32)
        embed[0] = 0
        filters = [rng.normal(0, (2 / (w * d)) ** 0.5, (w * d, f)).astype(np.float32) for w in widths]
        n = len(widths) * f
        return cls(langs, window, widths, embed, filters, [np.zeros(f, np.float32) for _ in widths], rng.normal(0, n**-0.5, (n, len(langs))).astype(np.float32), np.zeros(len(langs), np.float32))

    def _parts(self) -> list[np.ndarray]:
        return [self.embed, *self.filters, *self.bias, self.dense, self.dense_bias]

    def _step(self, x: np.ndarray, y: np.ndarray) -> tuple[float, list[np.ndarray]]:
        """Loss and gradients for windows ``x`` (n x window bytes) and classes ``y``."""
        n, d = len(x), self.embed.shape[1]
        e = self.embed[x]
        columns, tops, features = [], [], []
        for w, k, b in zip(self.widths, self.filters, self.bias, strict=True):
            at = self.window - w + 1
            c = np.concatenate([e[:, o : o + at] for o in range(w)], axis=2)
            z = c.reshape(n * at, w * d) @ k
            z = z.reshape(n, at, -1)
            top = z.argmax(axis=1)
            columns.append(c)
            tops.append(top)
            features.append(np.take_along_axis(z, top[:, None], 1)[:, 0] + b)
        h = np.concatenate(features, axis=1)
        a = np.maximum(h, 0)
        logits = a @ self.dense + self.dense_bias
        p = softmax(logits)
        loss = float(-np.log(p[np.arange(n), y] + 1e-9).mean())
        g = p.copy()
        g[np.arange(n), y] -= 1
        g /= n
        g_dense, g_dense_bias = a.T @ g, g.sum(axis=0)
        gh = (g @ self.dense.T) * (h > 0)
        g_embed, g_filters, g_bias = np.zeros_like(self.embed), [], []
        for i, (w, k) in enumerate(zip(self.widths, self.filters, strict=True)):
            f = k.shape[1]
            gi = gh[:, i * f : (i + 1) * f]
            best = columns[i][np.arange(n)[:, None], tops[i]]  # n x f x (w d)
            g_filters.append(np.einsum("nfk,nf->kf", best, gi))
            g_bias.append(gi.sum(axis=0))
            back = gi[:, :, None] * k.T[None]  # n x f x (w d)
            for o in range(w):
                np.add.at(g_embed, x[np.arange(n)[:, None], tops[i] + o], back[:, :, o * d : (o + 1) * d])
        g_embed[0] = 0
        return loss, [g_embed, *g_filters, *g_bias, g_dense, g_dense_bias]

    def fit(self, x: np.ndarray, y: np.ndarray, rng, epochs: int, batch: int, rate: float) -> ByteCNN:
        """Adam on mini-batches."""
        m = [np.zeros_like(p) for p in self._parts()]
        v = [np.zeros_like(p) for p in self._parts()]
        t = 0
        for _ in range(epochs):
            order = rng.permutation(len(x))
            for s in range(0, len(x), batch):
                rows = order[s : s + batch]
                _, grads = self._step(x[rows], y[rows])
                t += 1
                for p, g, mi, vi in zip(self._parts(), grads, m, v, strict=True):
                    mi += 0.1 * (g - mi)
                    vi += 0.01 * (g * g - vi)
                    p -= (rate * (mi / (1 - 0.9**t)) / (np.sqrt(vi / (1 - 0.99**t)) + 1e-8)).astype(np.float32)
        return self

    def tables(self) -> list[list[np.ndarray]]:
        """For prediction: what each pair of neighbouring bytes (or a last single byte) adds to each filter."""
        d, out = self.embed.shape[1], []
        for w, k in zip(self.widths, self.filters, strict=True):
            one = [self.embed @ k[o * d : (o + 1) * d] for o in range(w)]
            pairs = [(one[o][:, None] + one[o + 1][None]).reshape(65536, -1).astype(np.float32) for o in range(0, w - 1, 2)]
            out.append(pairs + ([one[-1].astype(np.float32)] if w % 2 else []))
        return out

    def predict(self, x: np.ndarray, tables: list[list[np.ndarray]]) -> np.ndarray:
        """Class probabilities of windows ``x``."""
        pairs = (x[:, :-1].astype(np.uint16) << 8) | x[:, 1:]
        features = []
        for w, parts, b in zip(self.widths, tables, self.bias, strict=True):
            at = self.window - w + 1
            z = parts[0][pairs[:, :at]]
            for i, part in enumerate(parts[1:], 1):
                code = x if len(part) == 256 else pairs
                z += part[code[:, 2 * i : 2 * i + at]]
            features.append(z.max(axis=1) + b)
        return softmax(np.maximum(np.concatenate(features, axis=1), 0) @ self.dense + self.dense_bias)


def softmax(z: np.ndarray) -> np.ndarray:
    z = np.exp(z - z.max(axis=1, keepdims=True))
    return z / z.sum(axis=1, keepdims=True)


def cut(data: bytes, window: int) -> np.ndarray:
    """All windows of a text's bytes, the last one padded with zeros."""
    n = -(-len(data) // window)
    return np.frombuffer(data + bytes(n * window - len(data)), np.uint8).reshape(n, window)


def train(
    labelled: DataFrame, window: int = 256, docs_per_lang: int = 400, windows_per_doc: int = 5, max_langs: int = 500,
    widths: tuple[int, ...] = (2, 3, 4), dims: int = 8, filters: int = 16, epochs: int = 4, batch: int = 64, rate: float = 0.01, seed: int = 7,
) -> ByteCNN | None:
    """Fit on a bounded sample of ``labelled`` (doc_id, text, lang): at most ``docs_per_lang`` documents of a language, picked by
    a hash of id and text, at most ``windows_per_doc`` evenly spaced windows of each, the ``max_langs`` most frequent languages
    (others can never be predicted). Every one of these languages is in the sample, also where all of its rows are alike.

    Rows without text or lang are not learned from. Without any usable row there is no model (None).
    """
    usable = labelled.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & (F.length("text") > 0)).select("doc_id", "text", "lang")
    # A hash threshold per language leaves about twice what is wanted, so that the ranking below is small whatever the corpus.
    # The least hash of a language always stays.
    order = F.xxhash64("doc_id", "text")
    sizes = usable.groupBy("lang").agg(F.count("*").alias("n"), F.min(order).alias("least")).orderBy(F.desc("n"), "lang").limit(max_langs)
    share = F.least(F.lit(1.0), F.lit(2.0 * docs_per_lang + 50) / F.col("n"))
    limits = F.broadcast(sizes.select("lang", share.alias("share"), "least"))  # max_langs rows at most
    near = usable.join(limits, "lang").where((F.pmod(order, F.lit(1 << 30)) < F.col("share") * (1 << 30)) | (order == F.col("least")))
    pick = Window.partitionBy("lang").orderBy(order, "doc_id")
    data = F.encode("text", "UTF-8")
    picked = near.withColumn("_n", F.row_number().over(pick)).where(F.col("_n") <= docs_per_lang)
    step = F.greatest(F.lit(window), F.floor(F.octet_length("text") / windows_per_doc).cast("int"))
    sample = (
        picked.select("lang", "doc_id", data.alias("data"), step.alias("step"))
        .select("lang", "doc_id", "data", F.posexplode(F.sequence(F.lit(1), F.octet_length("data"), F.col("step"))).alias("k", "at"))
        .where(F.col("k") < windows_per_doc)
        .select("lang", "doc_id", "k", F.expr(f"substring(data, at, {window})").alias("data"))
    )
    rows = sorted((r[0], r[1], r[2], bytes(r[3])) for r in sample.collect())  # bounded by the parameters
    langs = sorted({r[0] for r in rows})
    if not rows:
        return None
    rng = np.random.default_rng(seed)
    x = np.concatenate([cut(r[3], window)[:1] for r in rows])
    y = np.array([langs.index(r[0]) for r in rows])
    return ByteCNN.fresh(langs, window, widths, dims, filters, rng).fit(x, y, rng, epochs, batch, rate)


def has_letter(text: str) -> bool:
    return any(c.isalpha() for c in text)


def predict(docs: DataFrame, model: ByteCNN | None, batch_windows: int = 256) -> DataFrame:
    """One row per row of ``docs``: ``doc_id, lang_pred, score`` (mean probability of the predicted language, 0 to 1).

    Null texts, texts without any letter (empty ones too) and everything where there is no model: ``und`` with score 0.
    Repeated rows give a row each, extra columns are ignored, very long texts are predicted from all their windows.
    """
    value = docs.sparkSession.sparkContext.broadcast(model)
    return docs.select("doc_id", "text").mapInArrow(lambda batches: _predict(batches, value.value, batch_windows, None), SCHEMA)


def keep_identified(docs: DataFrame, model: ByteCNN | None, min_score: float = 0.0, batch_windows: int = 256, told: bool = False) -> DataFrame:
    """``docs`` without rows whose language is ``und`` or whose score is under ``min_score``; all columns stay. With ``told`` they get
    ``lang_pred, score`` of ``predict`` (in the place of columns with these names).

    Where there is no model, only rows without text or without a letter go.
    """
    docs = docs.drop("lang_pred", "score") if told else docs
    value, at = docs.sparkSession.sparkContext.broadcast(model), docs.columns.index("text")
    schema = T.StructType([*docs.schema, *(T.StructType.fromDDL("lang_pred string, score double") if told else [])])
    return docs.mapInArrow(lambda batches: _predict(batches, value.value, batch_windows, (at, min_score, told)), schema)


def _predict(batches: Iterator[pa.RecordBatch], model: ByteCNN | None, batch_windows: int, keep: tuple | None) -> Iterator[pa.RecordBatch]:
    tables = model.tables() if model else None
    for batch in batches:
        texts = batch.column(keep[0] if keep else 1)
        n = batch.num_rows
        total = np.zeros((n, len(model.langs) if model else 1))
        sizes, lettered = np.zeros(n), np.zeros(n, bool)
        pending: list[np.ndarray] = []
        owners: list[np.ndarray] = []
        weights: list[np.ndarray] = []
        held = 0

        def settle() -> None:
            nonlocal held
            if held:
                x, own, weight = np.concatenate(pending), np.concatenate(owners), np.concatenate(weights)
                for s in range(0, len(x), batch_windows):
                    p = model.predict(x[s : s + batch_windows], tables)
                    np.add.at(total, own[s : s + batch_windows], p * weight[s : s + batch_windows, None])
            pending.clear(), owners.clear(), weights.clear()
            held = 0

        for i in range(n):
            text = texts[i].as_py()
            if not text or not has_letter(text):
                continue
            lettered[i] = True
            if not model:
                continue
            data = text.encode()
            sizes[i] = len(data)
            x = cut(data, model.window)
            weight = np.full(len(x), model.window, np.float64)
            weight[-1] = len(data) - (len(x) - 1) * model.window
            pending.append(x)
            owners.append(np.full(len(x), i))
            weights.append(weight)
            held += len(x)
            if held >= 16 * batch_windows:
                settle()
        settle()
        best = total.argmax(axis=1)
        known = sizes > 0
        score = np.where(known, total[np.arange(n), best] / np.maximum(sizes, 1), 0.0).clip(0, 1)
        langs = [model.langs[b] if k else UNKNOWN for b, k in zip(best, known, strict=True)] if not keep or keep[2] else []
        if keep:
            if keep[2]:
                batch = pa.RecordBatch.from_arrays([*batch.columns, pa.array(langs, pa.string()), pa.array(score)], [*batch.schema.names, "lang_pred", "score"])
            yield batch.filter(pa.array(known & (score >= keep[1]) if model else lettered))
        else:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(langs, pa.string()), pa.array(score)], ["doc_id", "lang_pred", "score"])
