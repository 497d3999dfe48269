"""Packing in the order of a space-filling curve.

A document's words are hashed to a vector of BUCKETS signed, damped counts, which a fixed random
matrix projects to DIMS numbers. These are scaled by their range over all documents and become a
Hilbert key; documents are range-sorted by it, so like ones are neighbours, and laid end to end.
Every CAPACITY tokens of that line are a pack: no pack but the last has room left, whatever the
number of partitions, and a document that crosses an edge goes on in the next pack.

Tokens are runs of characters that aren't white space. A document without any (null, empty) has one
row, of 0 tokens, in the pack where it stands, the last at most. Ties of the key go by ``doc_id``
(null first), then by tokens; repeated rows are packed as often as they occur. Extra columns are
ignored. An empty table has no packs. Documents longer than a pack fill several.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quire.llm.common import INK, U64, chunks, hashes, lowered, offsets, raw, slim, spans, written

CAPACITY = 2048
BUCKETS, DIMS, BITS = 256, 4, 15
SEED = 23


def projection(buckets: int = BUCKETS, dims: int = DIMS, seed: int = SEED) -> np.ndarray:
    return np.random.default_rng(seed).standard_normal((buckets, dims))


def vectors(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Tokens of each text, and its coordinates; those of a text without tokens are 0."""
    n = len(texts)
    off, data = raw(lowered(texts))
    starts, ends, rows = spans(off, data, INK)
    h = hashes(data, starts, ends)
    sign = np.where((h >> U64(40)) & U64(1), 1.0, -1.0)
    count = np.bincount(rows * BUCKETS + (h % U64(BUCKETS)).astype(np.int64), weights=sign, minlength=n * BUCKETS).reshape(n, BUCKETS)
    v = np.sign(count) * np.log1p(np.abs(count))
    norm = np.sqrt((v * v).sum(1, keepdims=True))
    return np.diff(offsets(rows, n)), (v / np.maximum(norm, 1e-12)) @ projection()


def hilbert(cells: np.ndarray, bits: int = BITS) -> np.ndarray:
    """Keys along the Hilbert curve of rows of cell numbers (Skilling's transform, for all rows at once)."""
    x = cells.astype(np.int64).T.copy()
    dims, top = len(x), 1 << (bits - 1)
    q = top
    while q > 1:
        p = q - 1
        for i in range(dims):
            high = (x[i] & q) != 0
            t = np.where(high, 0, (x[0] ^ x[i]) & p)
            x[0] = np.where(high, x[0] ^ p, x[0] ^ t)
            if i:
                x[i] ^= t
        q >>= 1
    for i in range(1, dims):
        x[i] ^= x[i - 1]
    t = np.zeros_like(x[0])
    q = top
    while q > 1:
        t = np.where(x[-1] & q, t ^ (q - 1), t)
        q >>= 1
    x ^= t
    key = np.zeros_like(x[0])
    for b in range(bits - 1, -1, -1):
        for i in range(dims):
            key = key << 1 | (x[i] >> b) & 1
    return key


def placed(docs: DataFrame) -> DataFrame:
    """``doc_id``, ``n_tokens`` and ``hilbert_key`` of every row."""
    names = [f"c{i}" for i in range(DIMS)]

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in chunks(batch):
                n, c = vectors(part["text"])
                yield pa.RecordBatch.from_arrays([part["doc_id"], pa.array(n), *(pa.array(c[:, i]) for i in range(DIMS))], ["doc_id", "n_tokens", *names])

    points = written(slim(docs).mapInArrow(measure, "doc_id bigint, n_tokens bigint, " + ", ".join(f"{c} double" for c in names)), "points")
    span = points.filter("n_tokens > 0").agg(*[f(c) for c in names for f in (F.min, F.max)]).first()
    low, high = (np.array([span[2 * i + k] or 0.0 for i in range(DIMS)]) for k in (0, 1))

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            c = np.stack([np.asarray(batch[x]) for x in names], 1)
            cells = np.clip((c - low) / np.maximum(high - low, 1e-12) * (1 << BITS), 0, (1 << BITS) - 1)
            yield pa.RecordBatch.from_arrays([batch["doc_id"], batch["n_tokens"], pa.array(hilbert(cells))], ["doc_id", "n_tokens", "hilbert_key"])

    return points.mapInArrow(keyed, "doc_id bigint, n_tokens bigint, hilbert_key bigint")


def packed(docs: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """A row for each document in each pack: ``pack_id``, ``pack_offset``, ``doc_id``, ``doc_offset``, ``n_tokens``, ``hilbert_key``."""
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = placed(docs).repartitionByRange(parts, "hilbert_key", "doc_id", "n_tokens").sortWithinPartitions("hilbert_key", "doc_id", "n_tokens")

    def upto(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = 0
        for batch in batches:
            at = total + np.cumsum(np.asarray(batch["n_tokens"]))
            total = int(at[-1]) if len(at) else total
            yield batch.append_column("upto", pa.array(at, pa.int64()))

    line = ranged.withColumn("part", F.spark_partition_id()).mapInArrow(upto, "doc_id bigint, n_tokens bigint, hilbert_key bigint, part int, upto bigint")
    line = written(line, "curve")
    # one row a partition, however much each holds
    ends = line.groupBy("part").agg(F.max("upto").alias("tokens"))
    ends = ends.select("part", (F.sum("tokens").over(Window.orderBy("part")) - F.col("tokens")).alias("base"), F.sum("tokens").over(Window.partitionBy()).alias("total"))
    begin = F.col("base") + F.col("upto") - F.col("n_tokens")
    rows = line.join(F.broadcast(ends), "part").withColumn("begin", begin)
    first = F.expr(f"least(begin DIV {capacity}, greatest(total - 1, 0) DIV {capacity})")
    last = F.expr(f"greatest(begin + n_tokens - 1, begin) DIV {capacity}")
    rows = rows.withColumn("pack_id", F.explode(F.sequence(first, F.greatest(first, F.least(last, F.expr(f"greatest(total - 1, 0) DIV {capacity}"))))))
    start = F.greatest(F.col("begin"), F.col("pack_id") * capacity)
    return rows.select(
        "pack_id",
        (start - F.col("pack_id") * capacity).alias("pack_offset"),
        "doc_id",
        (start - F.col("begin")).alias("doc_offset"),
        (F.least(F.col("begin") + F.col("n_tokens"), (F.col("pack_id") + 1) * capacity) - start).alias("n_tokens"),
        "hilbert_key",
    )
