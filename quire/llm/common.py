"""Scratch tables, Arrow plumbing and vectorised text kernels of this subpackage."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs as pfs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

U64 = np.uint64
#: Text handled at once by a kernel; a longer document is handled alone and whole.
CHUNK_BYTES = 2 << 20
#: Rows handled at once, so that a row number fits 16 bits.
CHUNK_ROWS = 1 << 15


def shared_dir(spark: SparkSession) -> str:
    """Folder that all executors share: ``spark.checkpoint.dir``, or one of our own in local mode."""
    named = spark.sparkContext.getConf().get("spark.checkpoint.dir", None) or spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a shared folder on a cluster")
    own = tempfile.mkdtemp(prefix="quire-llm-")
    spark.conf.set("spark.checkpoint.dir", own)
    return own


def scratch_path(spark: SparkSession, tag: str) -> str:
    return f"{shared_dir(spark)}/{tag}-{uuid.uuid4().hex}"


def written(df: DataFrame, tag: str, path: str | None = None) -> DataFrame:
    """Cut the lineage of ``df`` with a parquet table in the shared folder."""
    path = path or scratch_path(df.sparkSession, tag)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def remove(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def file_system(path: str) -> tuple[pfs.FileSystem, str]:
    """File system and path in it, in any task, of a path or URI as Spark takes them."""
    return pfs.FileSystem.from_uri(path if "://" in path or not path.startswith("file:") else "file://" + path[5:])


def column(df: DataFrame, name: str, kind: str) -> DataFrame:
    """``df`` must have ``name``; a void or otherwise typed column is cast to ``kind``."""
    if name not in df.columns:
        raise ValueError(f"column {name!r} is missing; there are {df.columns}")
    return df if dict(df.dtypes)[name] == kind else df.withColumn(name, F.col(f"`{name}`").cast(kind))


def slim(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Key and text only, under the names ``doc_id`` and ``text``, so extra columns can't clash."""
    df = column(column(df, key, "bigint"), text, "string")
    return df.select(F.col(f"`{key}`").alias("doc_id"), F.col(f"`{text}`").alias("text"))


def rows_mapped(docs: DataFrame, run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> DataFrame:
    """``docs`` through a function of Arrow batches that goes by position and keeps the columns, whatever their names."""
    plain = docs.toDF(*(f"c{i}" for i in range(len(docs.columns))))
    return plain.mapInArrow(run, plain.schema).toDF(*docs.columns)


# --- Arrow -------------------------------------------------------------------------------


def raw(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Offsets (n + 1) and UTF-8 bytes; a null counts as an empty text."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    _, off, data = texts.buffers()
    off = np.frombuffer(off, np.int64)[texts.offset : texts.offset + len(texts) + 1] if len(texts) else np.zeros(1, np.int64)
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return off - off[0], data[off[0] : off[-1]]


def chunks(batch: pa.RecordBatch, text: str | int = "text") -> Iterator[pa.RecordBatch]:
    """Slices of at most CHUNK_ROWS rows and, but for single longer texts, CHUNK_BYTES bytes of the column named ``text`` or at that place."""
    off, _ = raw(batch.column(batch.schema.get_field_index(text) if isinstance(text, str) else text))
    at, n = 0, batch.num_rows
    while at < n:
        to = int(np.searchsorted(off, off[at] + CHUNK_BYTES, "right")) - 1
        to = min(max(to, at + 1), at + CHUNK_ROWS, n)
        yield batch.slice(at, to - at)
        at = to


def strings(off: np.ndarray, data: np.ndarray) -> pa.Array:
    """Text column of UTF-8 bytes; bytes that aren't UTF-8 become U+FFFD."""
    binary = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(off) - 1, [None, pa.py_buffer(np.ascontiguousarray(off, np.int64)), pa.py_buffer(np.ascontiguousarray(data))])
    try:
        return binary.cast(pa.large_string()).cast(pa.string())
    except pa.ArrowInvalid:
        return pa.array([b.decode("utf-8", "replace") for b in binary.to_pylist()], pa.string())


def blobs(values: np.ndarray, off: np.ndarray) -> pa.Array:
    """Binary column whose row i holds ``values[off[i]:off[i + 1]]``."""
    values = np.ascontiguousarray(values)
    if values.nbytes >= 1 << 31:
        raise ValueError("over 2 GB in the blobs of one batch")
    return pa.BinaryArray.from_buffers(pa.binary(), len(off) - 1, [None, pa.py_buffer((np.asarray(off, np.int64) * values.itemsize).astype(np.int32)), pa.py_buffer(values)])


def unblob(column: pa.Array, kind: type) -> tuple[np.ndarray, np.ndarray]:
    """All values of a binary column in one array, and its offsets."""
    column = column.cast(pa.large_binary())
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    _, off, data = column.buffers()
    off = np.frombuffer(off, np.int64)[column.offset : column.offset + len(column) + 1]
    size = np.dtype(kind).itemsize
    data = np.frombuffer(data, np.uint8)[off[0] : off[-1]] if data is not None and data.size else np.zeros(0, np.uint8)
    return data.copy().view(kind), (off - off[0]) // size


def lists(values: np.ndarray, off: np.ndarray, kind: pa.DataType) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.asarray(off, np.int32), pa.int32()), pa.array(values, kind))


# --- words -------------------------------------------------------------------------------

_RNG = np.random.default_rng(20240229)
BYTE_VALUE = _RNG.integers(1, 2**63, 256, dtype=U64) * U64(2) + U64(1)
BASE = U64(0x9E3779B97F4A7C15)
INVERSE = U64(pow(int(BASE), -1, 2**64))
#: Letters, digits and every byte of a character beyond ASCII are of a word.
WORD = np.zeros(256, bool)
WORD[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True
#: Anything but ASCII white space.
INK = np.ones(256, bool)
INK[[9, 10, 11, 12, 13, 32]] = False
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if _powers and _powers[0][0].size >= n:
        return _powers[0]
    size = max(n, CHUNK_BYTES + 2)
    made = tuple(np.concatenate([np.ones(1, U64), np.cumprod(np.full(size - 1, x, U64))]) for x in (BASE, INVERSE))
    if size <= 4 * CHUNK_BYTES:
        _powers[0] = made
    return made


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser of splitmix64."""
    x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


def spans(off: np.ndarray, data: np.ndarray, of: np.ndarray = WORD) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and row numbers of the maximal runs of bytes in ``of``; none crosses a row's end."""
    if not data.size:
        none = np.zeros(0, np.int64)
        return none, none, none
    inside = of[data]
    edge = np.zeros(data.size + 1, bool)
    edge[off] = True
    before = np.concatenate([[False], inside[:-1]])
    starts = np.flatnonzero(inside & (~before | edge[:-1]))
    after = np.concatenate([inside[1:], [False]])
    ends = np.flatnonzero(inside & (~after | edge[1:])) + 1
    counts = np.searchsorted(starts, off, "left")
    return starts, ends, np.repeat(np.arange(len(off) - 1), np.diff(counts))


def hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hash of each ``data[start:end]``, the same wherever it stands."""
    up, down = powers(data.size + 1)
    total = np.concatenate([np.zeros(1, U64), np.cumsum(BYTE_VALUE[data] * up[: data.size])])
    return mix((total[ends] - total[starts]) * down[starts] + (ends - starts).astype(U64))


def offsets(rows: np.ndarray, n: int) -> np.ndarray:
    """Where each of n rows begins in the ascending array ``rows``; n + 1 numbers."""
    return np.searchsorted(rows, np.arange(n + 1), "left")


def lowered(texts: pa.Array) -> pa.Array:
    return pc.utf8_lower(texts)


def sums(values: np.ndarray, off: np.ndarray) -> np.ndarray:
    """Sums over the rows that ``off`` bounds; 0 for empty rows."""
    total = np.concatenate([np.zeros((1, *values.shape[1:]), np.float64), np.cumsum(values, axis=0, dtype=np.float64)])
    return total[off[1:]] - total[off[:-1]]
