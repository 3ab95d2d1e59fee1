"""Continuous manifest intake: every micro-batch is reconciled with the catalogue as the batch transition does it.

The catalogue is a log. A micro-batch appends only the rows that it changes, by bucket of path; a reader takes each path's newest row.
``fold`` pieces of one level are merged into one of the next, so that a row is rewritten once a level and ``n`` batches are read from at
most ``fold - 1`` pieces a level. A piece counts once its write has ended; pieces that a merge replaced go when the next batch begins.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

CATALOGUE = "source_path string, hash string, revision_no long, first_seen timestamp"
COLUMNS = ["source_path", "hash", "revision_no", "first_seen"]
BUCKETS = 64


def changes(catalogue: DataFrame, last: DataFrame) -> DataFrame:
    """The catalogue's new rows for files (source_path, new_hash, seen_at, a row a path): new paths, and new hashes as the next revision."""
    rows = last.join(catalogue, "source_path", "left").where(~F.col("hash").eqNullSafe(F.col("new_hash")))
    number = (F.coalesce("revision_no", F.lit(0)) + 1).cast("long")
    return rows.select("source_path", F.col("new_hash").alias("hash"), number.alias("revision_no"), F.coalesce("first_seen", "seen_at").alias("first_seen"))


def last_seen(batch: DataFrame) -> DataFrame:
    """The last seen hash of each path; rows without a hash or path say nothing."""
    rows = batch.where("hash IS NOT NULL AND source_path IS NOT NULL")
    return rows.groupBy("source_path").agg(F.max_by("hash", F.struct("seen_at", "hash")).alias("new_hash"), F.max("seen_at").alias("seen_at"))


def newest(rows: DataFrame) -> DataFrame:
    """Each path's row of the highest revision."""
    best = rows.groupBy("source_path").agg(F.max_by(F.struct("hash", "revision_no", "first_seen"), "revision_no").alias("r"))
    return best.select("source_path", "r.*")


def merged(catalogue: DataFrame, batch: DataFrame) -> DataFrame:
    """The catalogue once the files (source_path, hash, seen_at) of a batch are taken in.

    A file that the catalogue has with this hash changes nothing, so a batch that comes again does not either.
    """
    return newest(catalogue.select(*COLUMNS).unionByName(changes(catalogue, last_seen(batch))))


class Log:
    """The pieces of a catalogue under a path: ``level=l/batch=n`` holds the changes of the fold^l batches that end with batch n."""

    def __init__(self, spark: SparkSession, path: str, fold: int = 8) -> None:
        self.spark, self.path, self.fold = spark, path.rstrip("/"), fold
        self._make = spark._jvm.org.apache.hadoop.fs.Path
        self._files = self._make(path).getFileSystem(spark._jsc.hadoopConfiguration())

    def piece(self, level: int, batch: int) -> str:
        return f"{self.path}/level={level}/batch={batch}"

    def _has(self, at: str) -> bool:
        return self._files.exists(self._make(at))

    def whole(self, level: int, batch: int) -> bool:
        return self._has(self.piece(level, batch) + "/_SUCCESS")

    def _names(self, at: str) -> list[int]:
        found = [s.getPath().getName() for s in self._files.listStatus(self._make(at))] if self._has(at) else []
        return [int(n.split("=")[1]) for n in found if "=" in n]

    def length(self) -> int:
        """How many batches the log holds."""
        return max((b + 1 for level in self._names(self.path) for b in self._names(f"{self.path}/level={level}") if self.whole(level, b)), default=0)

    def cover(self, n: int) -> list[tuple[int, int]]:
        """(level, batch) of the fewest whole pieces that hold the first n batches."""
        out = []
        while n > 0:
            sizes = [level for level in range(n.bit_length()) if n % self.fold**level == 0]
            level = next(lv for lv in reversed(sizes) if self.whole(lv, n - 1))
            out.append((level, n - 1))
            n -= self.fold**level
        return out

    def read(self, pieces: list[tuple[int, int]]) -> DataFrame:
        """All rows of pieces, with their bucket; a filter on it leaves out the others' files."""
        schema = CATALOGUE + ", level int, batch int, bucket int"
        if not pieces:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).option("basePath", self.path).parquet(*[self.piece(*p) for p in pieces])

    def write(self, rows: DataFrame, level: int, batch: int) -> None:
        bucket = F.pmod(F.xxhash64("source_path"), F.lit(BUCKETS)).cast("int")
        rows.select(*COLUMNS, bucket.alias("bucket")).repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(self.piece(level, batch))

    def append(self, batch: DataFrame, n: int) -> None:
        """Take in batch n. What an attempt before a failure left of it is overwritten, never read."""
        for level, b in [(lv, n - 1 - i * self.fold**lv) for lv in self._levels(n) for i in range(self.fold)]:
            self._files.delete(self._make(self.piece(level, b)), True)
        last = last_seen(batch).persist()
        bucket = F.pmod(F.xxhash64("source_path"), F.lit(BUCKETS)).cast("int")
        touched = [r[0] for r in last.select(bucket.alias("b")).distinct().collect()]  # at most ``BUCKETS`` numbers
        now = newest(self.read(self.cover(n)).where(F.col("bucket").isin(touched)))
        self.write(changes(now, last), 0, n)
        last.unpersist()
        for level in self._levels(n + 1):
            parts = [(level, n - i * self.fold**level) for i in range(self.fold)]
            self.write(newest(self.read(parts)), level + 1, n)

    def _levels(self, n: int) -> list[int]:
        """The levels whose last ``fold`` pieces are merged once there are n batches."""
        return [level for level in range(n.bit_length()) if n and n % self.fold ** (level + 1) == 0]


def take_in(files: DataFrame, path: str, checkpoint: str, fold: int = 8) -> None:
    """Run a stream of files (source_path, hash, seen_at) to its end; its changes are logged under ``path``."""

    def each(batch: DataFrame, n: int) -> None:
        Log(batch.sparkSession, path, fold).append(batch, n)

    query = files.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()


def catalogue(spark: SparkSession, path: str, fold: int = 8) -> DataFrame:
    """The catalogue as of the last whole batch; ``fold`` as it was written with."""
    log = Log(spark, path, fold)
    return newest(log.read(log.cover(log.length())))
