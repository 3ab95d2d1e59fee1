"""Shared helpers: tables, scratch storage, ASCII lower-casing, running offsets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from docwarp.operators.scratch import scratch_path, shared_dir, written

__all__ = ["LOWER_BYTES", "UPPER", "ascii_lower", "join_split", "running_offsets", "scratch_path", "shared_dir", "table", "written"]

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: bytes.translate table that lower-cases A-Z only.
LOWER_BYTES = bytes(range(256)).translate(bytes.maketrans(UPPER.encode(), UPPER.lower().encode()))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z and nothing else."""
    return F.translate(text, UPPER, UPPER.lower())


def running_offsets(df: DataFrame, order: list[str], value: str, out: str = "start") -> DataFrame:
    """Add ``out``: the sum of ``value`` over all rows before this one in ``order``.

    Rows are range-partitioned and written once; only one total per partition meets in one place.
    """
    ranged = df.repartitionByRange(*[F.col(c) for c in order]).sortWithinPartitions(*order)
    parts = written(ranged.withColumn("_part", F.spark_partition_id()), "ranged")
    ahead = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    totals = parts.groupBy("_part").agg(F.sum(value).alias("_total"))
    before = totals.select("_part", F.coalesce(F.sum("_total").over(ahead), F.lit(0)).alias("_before"))
    inside = Window.partitionBy("_part").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return (
        parts.join(F.broadcast(before), "_part")  # one row per partition of the sort
        .withColumn(out, (F.col("_before") + F.coalesce(F.sum(value).over(inside), F.lit(0))).cast(T.LongType()))
        .drop("_part", "_before")
    )


HOT = 1000  # a key is hot if it holds more than one in HOT of all rows ...
HOT_ROWS = 10_000  # ... and more rows than this, which are no burden to a task
SALTS = 64


def _hot(keys: DataFrame) -> list[int]:
    """Values of the long column ``h`` that are hot; fewer than 2 * HOT of them.

    From a sketch of bounded size that tasks merge, so that no rows are shuffled. It finds all hot values.
    """
    got = keys.agg(F.count("h").alias("n"), F.expr(f"approx_top_k(h, {2 * HOT}, {16 * HOT})").alias("top")).first()
    return [t["item"] for t in got["top"] or [] if t["count"] > max(got["n"] / HOT, HOT_ROWS)]


def join_split(rows: DataFrame, single: DataFrame, key: str, spread: str, how: str = "inner") -> DataFrame:
    """``rows`` joined with ``single`` (one row a key) by ``key``; rows of hot keys go to SALTS tasks by ``spread``, single rows to each.

    ``spread`` is a column of ``rows`` that tells a key's rows apart. ``rows`` are read twice. Which keys count as hot changes where
    rows meet, never what comes out; null keys meet nothing and are spread.
    """
    hot = _hot(rows.where(F.col(key).isNotNull()).select(F.xxhash64(key).alias("h")))
    is_hot = F.xxhash64(key).isin(hot)
    dealt = rows.withColumn("_salt", F.when(is_hot | F.col(key).isNull(), F.pmod(F.xxhash64(spread), F.lit(SALTS))).otherwise(0).cast("int"))
    salts = F.when(is_hot, F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0)))
    return dealt.join(single.withColumn("_salt", F.explode(salts)), [key, "_salt"], how).drop("_salt")
