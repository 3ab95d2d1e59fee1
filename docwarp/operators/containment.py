"""Which texts hold which needles, as equi-joins.

A needle and any text that holds it share the least q-gram (by hash) of every window of the needle's length or less. Needles fall into classes by
length; each class has a gram and a window size. Texts give the least grams of their windows for the classes in use, those that some
needle may have (a bit array of fixed size tells); a needle goes under its rarest gram, and what meets there is compared whole.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docwarp.operators.scratch import written
from docwarp.operators.textindex import spread

#: (least length of a needle, gram, grams in a window): a needle of a class has at least one whole window.
CLASSES = [(1, 1, 1), (2, 2, 1), (3, 3, 1), (4, 4, 1), (6, 5, 2), (10, 6, 5), (18, 8, 11), (40, 8, 33)]
BITS = 1 << 24


def grams(text: str, q: int, window: int) -> np.ndarray:
    """Distinct hashes of the least q-gram of each window; a text without a whole window has none."""
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    n = len(points) - q + 1
    if n < window:
        return np.zeros(0, np.int64)
    x = np.zeros(n, np.uint64)
    for j in range(q):
        x = x * np.uint64(0x9E3779B97F4A7C15) + points[j : j + n] + np.uint64(1)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(32)
    least = x[: n - window + 1].copy()
    for j in range(1, window):
        np.minimum(least, x[j : j + n - window + 1], out=least)
    return np.unique(least).view(np.int64)


def _class(length: int) -> int:
    return sum(length >= least for least, _, _ in CLASSES) - 1


def contained(texts: DataFrame, needles: DataFrame) -> DataFrame:
    """request_id, key of texts (key, body) that hold a needle (request_id, needle), letter by letter. An empty needle and a null are in none."""
    spark = texts.sparkSession
    ids, keys = dict(needles.dtypes)["request_id"], dict(texts.dtypes)["key"]

    def of_needles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [(i, c := _class(len(t)), grams(t, *CLASSES[c][1:])) for i, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)]
            counts = [len(g) for *_, g in found]
            columns = [np.repeat(np.arange(len(found)), counts), np.repeat([c for _, c, _ in found], counts), np.concatenate([np.zeros(0, np.int64), *(g for *_, g in found)])]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(columns[0].astype(np.int64))), pa.array(columns[1], pa.int32()), pa.array(columns[2], pa.int64())], ["request_id", "class", "gram"])

    asked = needles.where("needle <> ''").select("request_id", "needle")
    sought = written(asked.mapInArrow(of_needles, f"request_id {ids}, class int, gram long"), "sought")
    slot = F.pmod(F.xxhash64("class", "gram"), F.lit(BITS))
    classes = [r["class"] for r in sought.select("class").distinct().collect()]  # at most len(CLASSES)
    marks = np.zeros(BITS // 8, np.uint8)
    width = 32 * 1024  # bits of a row of the bitmap functions
    rows = sought.select(F.bitmap_bucket_number(slot + 1).alias("k"), F.bitmap_bit_position(slot + 1).alias("b"))  # they count from 1
    rows = rows.groupBy("k").agg(F.bitmap_construct_agg("b").alias("bits"))
    for r in rows.toLocalIterator():  # BITS bits in all
        at = (r["k"] - 1) * width // 8
        part = np.frombuffer(bytes(r["bits"]), np.uint8)[: len(marks) - at]
        marks[at : at + len(part)] |= part
    held = spark.sparkContext.broadcast(marks)

    def of_texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, text in enumerate(batch.column(1).to_pylist()):
                for c in classes:
                    found = grams(text or "", *CLASSES[c][1:])
                    if len(found):
                        names = [batch.column(0).take(pa.array(np.full(len(found), row))), pa.array(np.full(len(found), c), pa.int32()), pa.array(found)]
                        yield pa.RecordBatch.from_arrays(names, ["key", "class", "gram"])

    def wanted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.column(3).to_numpy()
            yield batch.filter(pa.array(held.value[at >> 3] >> (at & 7).astype(np.uint8) & 1 == 1)).select(["key", "class", "gram"])

    own = spread(texts.select("key", "body")).mapInArrow(of_texts, f"key {keys}, class int, gram long").withColumn("slot", slot)
    own = written(own.mapInArrow(wanted, f"key {keys}, class int, gram long"), "grams")
    counts = own.groupBy("class", "gram").agg(F.count("*").alias("texts"))
    rarest = sought.join(counts, ["class", "gram"], "left").groupBy("request_id", "class").agg(F.min_by("gram", F.struct(F.coalesce("texts", F.lit(0)), "gram")).alias("gram"))
    met = own.join(rarest, ["class", "gram"]).select("request_id", "key")
    pairs = met.join(asked, "request_id").join(texts.select("key", "body"), "key")
    return pairs.where(F.contains("body", F.col("needle"))).select("request_id", "key")
