"""Byte-pair encoding and decoding with a contiguous rank array.

A word's parts stand side by side in an array of token ids, and beside them the rank of every
adjacent pair. The smallest rank is found by scanning, its boundary is deleted, the ranks left and
right of it are refreshed, until no pair has a rank. Many short words are handled at once, as rows
of one matrix; words of over SHORT bytes use a heap over the same ranks. Each distinct word of a
Python worker is encoded once.

Null texts encode to null and decode to null; an empty text has no tokens; ids outside the
vocabulary (and null ids) decode to U+FFFD, as do bytes that aren't UTF-8. Special-token strings in
a text are ordinary text. Repeated rows are encoded alike; extra columns are left out of the result.
"""

from __future__ import annotations

import base64
import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs as pfs
import regex
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from quire.llm.common import chunks, column, lists, slim, strings

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
SHORT = 64
#: Distinct words that a worker remembers before it starts afresh; results don't depend on it.
REMEMBERED = 400_000
NONE = np.int32(2**31 - 1)
UNKNOWN = "�".encode()


def load_ranks(path: str = VOCABULARY) -> list[bytes]:
    """Tokens in the order of their ranks, from lines of a base64 token and its rank."""
    fs, inner = pfs.FileSystem.from_uri(path if "://" in path else f"file://{path}")
    with fs.open_input_stream(inner) as f:
        pairs = sorted((int(rank), base64.b64decode(token)) for token, rank in (line.split() for line in f.read().splitlines() if line))
    if [r for r, _ in pairs] != list(range(len(pairs))):
        raise ValueError(f"{path}: ranks must be 0, 1, 2, ...")
    return [t for _, t in pairs]


def _classes() -> np.ndarray:
    """1 letters, 2 numbers, 3 white space, 0 the rest, by code point."""
    table = np.zeros(0x110000, np.uint8)
    points = [*range(0xD800), *range(0xE000, 0x110000)]
    every, at = "".join(map(chr, points)), np.array(points)
    for k, pattern in ((1, r"\p{L}+"), (2, r"\p{N}+"), (3, r"\p{White_Space}+")):
        for m in regex.finditer(pattern, every):
            table[at[m.start() : m.end()]] = k
    return table


class Encoder:
    """Encoder and decoder of one vocabulary; kept by a Python worker between batches."""

    def __init__(self, tokens: list[bytes]):
        self.tokens = tokens
        self.rank = {t: i for i, t in enumerate(tokens)}
        self.size = np.int64(len(tokens))
        self.byte = np.array([self.rank[bytes([b])] for b in range(256)], np.int32)
        keys, to = [], []
        get = self.rank.get
        for i, t in enumerate(tokens):
            for k in range(1, len(t)):
                a, b = get(t[:k]), get(t[k:])
                if a is not None and b is not None:
                    keys.append(a * len(tokens) + b)
                    to.append(i)
        order = np.argsort(np.array(keys, np.int64), kind="stable")
        self.keys = np.append(np.array(keys, np.int64)[order], np.int64(2**62))
        self.to = np.append(np.array(to, np.int32)[order], NONE)
        self.classes = _classes()
        self.token_off = np.cumsum([0, *map(len, tokens), len(UNKNOWN)])
        self.token_bytes = np.frombuffer(b"".join([*tokens, UNKNOWN]), np.uint8)
        self.forget()

    def forget(self) -> None:
        self.known: dict[str, int] = {}
        self.at, self.flat = np.zeros(1, np.int64), np.zeros(0, np.int32)

    def pair(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Rank of each pair of neighbours, NONE where they don't merge."""
        key = a.astype(np.int64) * self.size + b
        i = np.searchsorted(self.keys, key)
        return np.where(self.keys[i] == key, self.to[i], NONE)

    def boundaries(self, text: str, starts: np.ndarray) -> np.ndarray:
        """Where the words of the pattern ``'s|'t|'re|'ve|'m|'ll|'d| ?\\p{L}+| ?\\p{N}+| ?[^\\s\\p{L}\\p{N}]+|\\s+(?!\\S)|\\s+`` begin; ``starts``: where texts begin."""
        cp = np.frombuffer(text.encode("utf-32-le"), np.uint32)
        n = cp.size
        kind = self.classes[cp]
        first = np.zeros(n + 1, bool)
        first[starts] = True
        first = first[:n]
        cut = first | np.concatenate([[True], kind[1:] != kind[:-1]])
        run = np.flatnonzero(cut & (kind != 3) & ~first)
        run = run[kind[run - 1] == 3]
        cut[run - 1] = True
        cut[run[cp[run - 1] == 32]] = False
        q = np.flatnonzero((cp == 39) & cut)
        q = q[q + 1 < n]
        q = q[(kind[q + 1] == 1) & ~first[q + 1]]
        if q.size:
            c1 = cp[q + 1]
            more = q + 2 < n
            c2 = np.where(more & ~first[np.minimum(q + 2, n - 1)], cp[np.minimum(q + 2, n - 1)], 0)
            size = np.where(np.isin(c1, [115, 116, 109, 100]), 1, np.where(((c1 == 114) | (c1 == 118)) & (c2 == 101) | (c1 == 108) & (c2 == 108), 2, 0))
            q, size = q[size > 0], size[size > 0]
            cut[q + 1] = False
            end = q + 1 + size
            cut[end[end < n]] = True
        return np.flatnonzero(cut)

    def merge(self, words: list[bytes]) -> list[np.ndarray]:
        """Token ids of words that are no tokens themselves."""
        out: list[np.ndarray] = [None] * len(words)
        size = np.fromiter(map(len, words), np.int64, len(words))
        low = 0
        for high in (4, 8, 12, 16, 24, 32, 48, SHORT):
            of = np.flatnonzero((size > low) & (size <= high))
            low = high
            for at in range(0, of.size, 20_000):
                self._short([words[i] for i in of[at : at + 20_000]], of[at : at + 20_000], size[of[at : at + 20_000]], high, out)
        for i in np.flatnonzero(size > SHORT):
            out[i] = self._long(words[i])
        return out

    def _short(self, words: list[bytes], of: np.ndarray, size: np.ndarray, width: int, out: list) -> None:
        ids = self.byte[np.frombuffer(b"".join(w.ljust(width, b"\0") for w in words), np.uint8).reshape(-1, width)]
        rank = self.pair(ids[:, :-1], ids[:, 1:])
        columns = np.arange(width - 1)
        rank[columns[None, :] >= size[:, None] - 1] = NONE
        while of.size:
            j = rank.argmin(1)
            rows = np.arange(of.size)
            least = rank[rows, j]
            done = least == NONE
            if done.any():
                for i, r, n in zip(of[done], ids[done], size[done], strict=True):
                    out[i] = r[:n].copy()
                left = ~done
                of, ids, rank, size, j, least = of[left], ids[left], rank[left], size[left], j[left], least[left]
                rows = np.arange(of.size)
                if not of.size:
                    break
            ids[rows, j] = least
            if width > 2:
                # the boundary after j goes: what stands right of it moves one place to the left
                shift = columns[None, :] > j[:, None]
                ids[:, :-1] = np.where(shift, ids[:, 1:], ids[:, :-1])
                rank[:, :-1] = np.where(shift[:, :-1] | (columns[None, :-1] == j[:, None]), rank[:, 1:], rank[:, :-1])
            rank[:, -1] = NONE
            size -= 1
            has = j + 1 < size
            rank[rows, np.minimum(j, width - 2)] = np.where(has, self.pair(ids[rows, j], ids[rows, np.minimum(j + 1, width - 1)]), NONE)
            has = j > 0
            rank[rows[has], j[has] - 1] = self.pair(ids[rows[has], j[has] - 1], ids[rows[has], j[has]])

    def _long(self, word: bytes) -> np.ndarray:
        n = len(word)
        ids, after, before = self.byte[np.frombuffer(word, np.uint8)].tolist(), [*range(1, n), -1], [*range(-1, n - 1)]
        first = self.pair(np.array(ids[:-1]), np.array(ids[1:])).tolist()
        heap = [(r, i, ids[i], ids[i + 1]) for i, r in enumerate(first) if r != NONE]
        heapq.heapify(heap)
        tokens, rank = self.tokens, self.rank
        while heap:
            r, i, a, b = heapq.heappop(heap)
            j = after[i]
            if ids[i] != a or j < 0 or ids[j] != b:
                continue
            ids[i], ids[j], after[i] = r, -1, after[j]
            if after[j] >= 0:
                before[after[j]] = i
            for x, y in ((before[i], i), (i, after[i])):
                if x >= 0 and y >= 0 and (to := rank.get(tokens[ids[x]] + tokens[ids[y]])) is not None:
                    heapq.heappush(heap, (to, x, ids[x], ids[y]))
        return np.array([i for i in ids if i >= 0], np.int32)

    def encode(self, texts: pa.Array) -> pa.Array:
        """List column of token ids."""
        if isinstance(texts, pa.ChunkedArray):
            texts = texts.combine_chunks()
        null = texts.is_null()
        full = pc.fill_null(texts, "")
        starts = np.concatenate([[0], np.cumsum(pc.utf8_length(full).to_numpy(zero_copy_only=False))]).astype(np.int64)
        text = "".join(full.to_pylist())
        if not text:
            return pc.if_else(null, pa.scalar(None, pa.list_(pa.int32())), lists(np.zeros(0, np.int32), np.zeros(len(texts) + 1), pa.int32()))
        cut = self.boundaries(text, starts)
        at = cut.tolist()
        words = [text[a:b] for a, b in zip(at, [*at[1:], len(text)], strict=True)]
        if len(self.known) > REMEMBERED:
            self.forget()
        new = [w for w in set(words) if w not in self.known]
        if new:
            encoded = [w.encode() for w in new]
            whole = [self.rank.get(w) for w in encoded]
            rest = iter(self.merge([w for w, r in zip(encoded, whole, strict=True) if r is None]))
            made = [np.array([r], np.int32) if r is not None else next(rest) for r in whole]
            self.known.update(zip(new, range(len(self.known), len(self.known) + len(new)), strict=True))
            self.at = np.concatenate([self.at, self.at[-1] + np.cumsum(np.fromiter(map(len, made), np.int64, len(made)))])
            self.flat = np.concatenate([self.flat, *made])
        which = np.fromiter(map(self.known.__getitem__, words), np.int64, len(words))
        begin, count = self.at[which], self.at[which + 1] - self.at[which]
        end = np.concatenate([[0], np.cumsum(count)])
        tokens = self.flat[np.repeat(begin - end[:-1], count) + np.arange(end[-1])]
        off = end[np.searchsorted(cut, starts, "left")]
        made = lists(tokens, off, pa.int32())
        return pc.if_else(null, pa.scalar(None, made.type), made) if null.true_count else made

    def decode(self, ids: pa.Array) -> pa.Array:
        """Text column of a list column of token ids."""
        if isinstance(ids, pa.ChunkedArray):
            ids = ids.combine_chunks()
        null = ids.is_null()
        off = np.concatenate([[0], np.cumsum(pc.fill_null(pc.list_value_length(ids), 0).to_numpy(zero_copy_only=False))]).astype(np.int64)
        flat = pc.fill_null(ids.flatten(), -1).to_numpy(zero_copy_only=False).astype(np.int64)
        flat = np.where((flat < 0) | (flat >= self.size), self.size, flat)
        begin, count = self.token_off[flat], self.token_off[flat + 1] - self.token_off[flat]
        end = np.concatenate([[0], np.cumsum(count)])
        data = self.token_bytes[np.repeat(begin - end[:-1], count) + np.arange(end[-1])]
        made = strings(end[off], data)
        return pc.if_else(null, pa.scalar(None, pa.string()), made) if null.true_count else made


_encoders: dict[int, Encoder] = {}


def _encoder(ranks: Broadcast) -> Encoder:
    key = getattr(ranks, "_jid", 0) or id(ranks)
    if key not in _encoders:
        _encoders.clear()
        _encoders[key] = Encoder(ranks.value)
    return _encoders[key]


def vocabulary(spark: SparkSession, path: str = VOCABULARY) -> Broadcast:
    """The ranks, to be sent once to each executor; their size is the vocabulary's, whatever the data."""
    return spark.sparkContext.broadcast(load_ranks(path))


def encode(docs: DataFrame, ranks: Broadcast, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id``, ``n_bytes``, ``token_ids`` of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(ranks)
        for batch in batches:
            for part in chunks(batch):
                ids = encoder.encode(part["text"])
                yield pa.RecordBatch.from_arrays([part["doc_id"], pc.binary_length(part["text"]).cast(pa.int64()), ids], ["doc_id", "n_bytes", "token_ids"])

    return slim(docs, key, text).mapInArrow(run, "doc_id bigint, n_bytes bigint, token_ids array<int>")


def decode(tokens: DataFrame, ranks: Broadcast, ids: str = "token_ids", to: str = "text") -> DataFrame:
    """The columns of ``tokens`` and the text of its token ids; a column already named ``to`` is replaced."""
    tokens = column(tokens, ids, "array<int>").drop(to)
    place = tokens.columns.index(ids)
    plain = tokens.toDF(*(f"c{i}" for i in range(len(tokens.columns))))
    schema = StructType([*plain.schema.fields, StructField("decoded", StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(ranks)
        for batch in batches:
            for at in range(0, max(batch.num_rows, 1), 512):
                part = batch.slice(at, 512)
                yield pa.RecordBatch.from_arrays([*part.columns, encoder.decode(part.column(place))], schema.names)

    return plain.mapInArrow(run, schema).toDF(*tokens.columns, to)


def round_trip(docs: DataFrame, ranks: Broadcast) -> DataFrame:
    """Token ids of every document, and the MD5 of the text that they decode to."""
    return decode(encode(docs, ranks), ranks).select("doc_id", "n_bytes", F.size("token_ids").alias("n_tokens"), "token_ids", F.md5("text").alias("decoded_md5"))
