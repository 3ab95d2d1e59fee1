"""A content-addressed store of token ids.

Layout under one folder (Parquet): ``parts/kind=chunk`` (digest, n_ids, ids: little-endian, unsigned, two bytes an id where the
vocabulary allows it and else four; every distinct chunk once), ``parts/kind=document`` (row_id, doc_id, n_ids, digest: the Merkle
root, parts: the digests of its chunks in order, which is its recipe), ``manifests`` (row_id, doc_id, start, n_tokens, n_chunks,
merkle_root: one row per document in ascending doc_id order; start counts the ids of all documents before it).

Chunks are cut where a rolling hash of the last ids says so, so equal stretches give equal chunks wherever they stand. A
digest is the SHA-256 of a chunk's bytes, the Merkle root is taken over the chunk digests. A reader joins recipes and chunks, rebuilds
the id stream of each document, recomputes every digest from the stored bytes and the root from them, and fails on a difference.
"""

from __future__ import annotations

import hashlib
import zlib
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docwarp.llm.common import join_split, running_offsets, scratch_path
from docwarp.llm.tokens import encoder, tokenizer_json

WINDOW, LEAST, MOST, BITS = 8, 64, 4096, 9  # rolling window; least and most ids of a chunk; 2**BITS ids apart on average
_WRITE = "kind string, row_id long, doc_id long, digest binary, n_ids long, ids binary, parts array<binary>"

_GEAR = [np.zeros(0, np.uint32)]


def _gear(most: int) -> np.ndarray:
    """A 32-bit mix of every id up to ``most`` (bounded by the vocabulary); the constants are fixed values of murmur3's finish."""
    if most >= len(_GEAR[0]):
        x = np.arange(max(1 << 16, most + 1), dtype=np.uint32) + np.uint32(0x9E3779B9)
        x = (x ^ (x >> np.uint32(16))) * np.uint32(0x85EBCA6B)
        x = (x ^ (x >> np.uint32(13))) * np.uint32(0xC2B2AE35)
        _GEAR[0] = x ^ (x >> np.uint32(16))
    return _GEAR[0]


def candidates(ids: np.ndarray, block: int = 1 << 15) -> np.ndarray:
    """Positions after which a rolling hash of the last WINDOW ids allows a cut; in blocks that stay in the processor's cache."""
    gear, out = _gear(int(ids.max(initial=0))), []
    for at in range(0, len(ids), block):
        first = max(0, at - WINDOW + 1)
        g = gear[ids[first : at + block]]
        h = g.copy()
        for j in range(1, WINDOW):
            h[j:] += g[:-j] << np.uint32(j)
        out.append(np.flatnonzero(h[at - first :] >> np.uint32(32 - BITS) == 0) + at + 1)
    return np.concatenate(out) if out else np.zeros(0, np.int64)


def cuts(found: list[int], start: int, end: int) -> list[int]:
    """Chunk ends of one document that spans [start, end) of a stream with the given candidates.

    LEAST exceeds WINDOW, so a cut never depends on ids before the chunk: equal documents are cut alike.
    """
    out, at = [], start
    while end - at > LEAST:
        k = bisect_left(found, at + LEAST)
        nxt = min(found[k] if k < len(found) else end, at + MOST, end)
        if nxt >= end:
            break
        out.append(nxt)
        at = nxt
    return [*out, end] if end > start else out


def merkle(digests: list[bytes]) -> bytes:
    """Binary tree of SHA-256 over the leaves; an odd node goes up as it is; no leaves give the digest of nothing."""
    if not digests:
        return hashlib.sha256(b"").digest()
    level = digests
    while len(level) > 1:
        level = [hashlib.sha256(b"\x01" + level[i] + level[i + 1]).digest() if i + 1 < len(level) else level[i] for i in range(0, len(level), 2)]
    return level[0]


def _binary(values: list[bytes]) -> pa.Array:
    return pa.array(values, pa.binary())


def _rows(docs: DataFrame, spec, end_id: int) -> DataFrame:
    """A row per document with its recipe, and each chunk once per task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, row, seen = encoder(spec.value), TaskContext.get().partitionId() << 40, set()
        width = "<u2" if max(enc.tok.get_vocab_size(), end_id + 1) <= 1 << 16 else "<u4"
        for batch in batches:
            for at, n, ids, sizes in enc.encode(batch.column(1)):
                ends = np.cumsum(sizes + 1)
                stream = np.insert(ids, np.cumsum(sizes), end_id)
                data, size = memoryview(stream.astype(width).tobytes()), int(width[2])
                found = candidates(stream).tolist()
                roots, parts, counts, new, new_sizes, new_ids = [], [], [], [], [], []
                start = 0
                for end in ends.tolist():
                    digests = []
                    for stop in cuts(found, start, end):
                        piece = data[size * start : size * stop]
                        digest = hashlib.sha256(piece).digest()
                        digests.append(digest)
                        short = digest[:16]
                        if short not in seen:
                            if len(seen) < 200_000:  # only spares shuffle; the store below is exact
                                seen.add(short)
                            new.append(digest)
                            new_sizes.append(stop - start)
                            new_ids.append(bytes(piece))
                        start = stop
                    roots.append(merkle(digests))
                    parts += digests
                    counts.append(len(digests))
                lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)), _binary(parts))
                names = [c.split()[0] for c in _WRITE.split(", ")]
                long = pa.int64()
                kinds = pa.array(["document"]).take(pa.array(np.zeros(n, np.int8)))
                heads = [kinds, pa.array(np.arange(row, row + n)), batch.column(0).slice(at, n), _binary(roots), pa.array(sizes + 1, long), pa.nulls(n, pa.binary()), lists]
                yield pa.RecordBatch.from_arrays(heads, names)
                k = len(new)
                kinds = pa.array(["chunk"]).take(pa.array(np.zeros(k, np.int8)))
                chunks = [kinds, pa.nulls(k, long), pa.nulls(k, long), _binary(new), pa.array(new_sizes, long), _binary(new_ids), pa.nulls(k, lists.type)]
                yield pa.RecordBatch.from_arrays(chunks, names)
                row += n

    return docs.select("doc_id", "text").mapInArrow(run, _WRITE)


def write_store(docs: DataFrame, path: str, tokenizer_path: str | None = None, end_id: int = 2) -> str:
    """Encode every whole text (null: empty), append ``end_id``, and write the store. Returns ``path``.

    The texts are encoded once; one shuffle by digest leaves every distinct chunk once (equal digests with unequal lengths
    fail). Repeated rows and repeated doc_ids are documents of their own; null doc_ids come first. Extra columns are ignored.
    An empty table gives an empty store. Very long texts are encoded in bounded slices.
    """
    spark = docs.sparkSession
    spec = spark.sparkContext.broadcast(tokenizer_json(tokenizer_path))
    # by digest for chunks and by row for documents, of which many may be equal; tasks have merged their chunks already
    key = F.xxhash64("row_id", F.when(F.col("row_id").isNull(), F.col("digest")))
    rows = _rows(docs, spec, end_id).withColumn("key", key).repartition("key")
    once = rows.groupBy("kind", "key", "digest", "row_id").agg(
        F.first("doc_id").alias("doc_id"), F.first("ids").alias("ids"), F.first("parts").alias("parts"), F.min("n_ids").alias("n_ids"), F.max("n_ids").alias("most")
    )
    sound = F.when(F.col("n_ids") == F.col("most"), F.col("n_ids")).otherwise(F.raise_error(F.lit("two chunks share a digest")))
    columns = ["row_id", "doc_id", "digest", sound.alias("n_ids"), "ids", "parts", "kind"]
    once.select(*columns).write.partitionBy("kind").option("compression", "zstd").parquet(f"{path}/parts")
    heads = _part(spark, path, "document").select(
        "row_id", "doc_id", F.col("n_ids").alias("n_tokens"), F.size("parts").cast("long").alias("n_chunks"), F.col("digest").alias("merkle_root")
    )
    ordered = running_offsets(heads, ["doc_id", "row_id"], "n_tokens")
    ordered.repartitionByRange("doc_id", "row_id").sortWithinPartitions("doc_id", "row_id").write.parquet(f"{path}/manifests")
    return path


def _part(spark: SparkSession, path: str, kind: str) -> DataFrame:
    schema = T.StructType.fromDDL("row_id long, doc_id long, digest binary, n_ids long, ids binary, parts array<binary>")
    at = f"{path}/parts/kind={kind}"
    return spark.read.schema(schema).parquet(at) if _exists(spark, at) else spark.createDataFrame([], schema)


def _exists(spark: SparkSession, path: str) -> bool:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at)


def read_chunks(spark: SparkSession, path: str) -> DataFrame:
    """digest, n_ids, ids of every stored chunk."""
    return _part(spark, path, "chunk").select("digest", "n_ids", "ids")


def read_recipes(spark: SparkSession, path: str) -> DataFrame:
    """row_id, chunk_no, digest: which chunks make up a document, in order."""
    return _part(spark, path, "document").select("row_id", F.posexplode("parts").alias("chunk_no", "digest"))


def read_manifests(spark: SparkSession, path: str) -> DataFrame:
    schema = "row_id long, doc_id long, n_tokens long, n_chunks long, merkle_root binary, start long"
    return spark.read.schema(schema).parquet(f"{path}/manifests")


def _rebuilt(spark: SparkSession, path: str, schema: str, value) -> DataFrame:
    """A row per document: row_id, doc_id, start, n_tokens and ``value`` of its ids' bytes (four an id).

    Recipes join the chunks, those of hot chunks in many tasks; a document's manifest and chunks then meet by row_id, in order, and only one document is held at a time.
    A chunk whose bytes don't have the digest that the recipe names, or a document whose root, number of chunks or of ids is not the
    manifest's, fails the job.
    """
    pieces = join_split(read_recipes(spark, path), read_chunks(spark, path).select("digest", "ids"), "digest", "row_id").select("row_id", "chunk_no", "ids")
    heads = read_manifests(spark, path).withColumn("chunk_no", F.lit(-1))
    rows = heads.unionByName(pieces, allowMissingColumns=True).repartition("row_id").sortWithinPartitions("row_id", "chunk_no")
    order = ["row_id", "chunk_no", "ids", "doc_id", "start", "n_tokens", "n_chunks", "merkle_root"]
    names = [c.split()[0] for c in schema.split(", ")]
    types = [pa.int64()] * 4 + [pa.binary() if "binary" in schema else pa.int64()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        head, leaves, data, out = None, [], [], []

        def close() -> None:
            if head is None:
                return
            row_id, doc_id, start, n_tokens, n_chunks, root = head
            whole = b"".join(data)
            if len(leaves) != n_chunks or merkle(leaves) != root or len(whole) not in (2 * n_tokens, 4 * n_tokens):
                raise ValueError("a document's chunks don't match its manifest")
            ids = np.frombuffer(whole, "<u2").astype("<u4").tobytes() if len(whole) == 2 * n_tokens else whole
            out.append((row_id, doc_id, start, n_tokens, value(ids)))

        def flush() -> pa.RecordBatch:
            batch = pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*out), types, strict=True)], names)
            out.clear()
            return batch

        for batch in batches:
            row_ids, nos = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            edges = np.flatnonzero(nos < 0)
            heads = {int(i): r for i, r in zip(edges, zip(*(batch.column(j).take(pa.array(edges)).to_pylist() for j in (0, 3, 4, 5, 6, 7))), strict=True)}
            for i, piece in enumerate(batch.column(2)):
                if i in heads:
                    close()
                    head, leaves, data = heads[i], [], []
                else:
                    if head is None or row_ids[i] != head[0]:
                        raise ValueError("a document has no manifest")
                    data.append(piece.as_py())
                    leaves.append(hashlib.sha256(data[-1]).digest())
            if len(out) > 4000:
                yield flush()
        close()
        if out:
            yield flush()

    return rows.select(*order).mapInArrow(run, schema)


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """``row_id, doc_id, start, n_tokens, ids`` (binary, little-endian unsigned 32-bit), rebuilt by joining recipes and chunks, and verified."""
    return _rebuilt(spark, path, "row_id long, doc_id long, start long, n_tokens long, ids binary", lambda ids: ids)


def verified_digests(spark: SparkSession, path: str) -> DataFrame:
    """``row_id, doc_id, start, n_tokens, ids_crc32`` of every stored document: as ``read_documents``, with the CRC-32 of the rebuilt ids in their place."""
    return _rebuilt(spark, path, "row_id long, doc_id long, start long, n_tokens long, ids_crc32 long", zlib.crc32)


def store_and_read(docs: DataFrame, tokenizer_path: str | None = None, end_id: int = 2) -> DataFrame:
    """Write a store in the shared folder and return what ``verified_digests`` reads from it."""
    spark = docs.sparkSession
    return verified_digests(spark, write_store(docs, scratch_path(spark, "tokens"), tokenizer_path, end_id))
