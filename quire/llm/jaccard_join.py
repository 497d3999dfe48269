"""Near-duplicate groups by an exact Jaccard join over word n-grams, with token-combination prefixes.

The tokens of a document are its distinct n-grams of words (runs of letters, digits and characters
beyond ASCII, in lower case); a document of fewer words has them all as its one token. All tokens
stand in one order, rare before frequent. Of a document of s tokens, a partner with Jaccard >= t
lacks at most s - ceil(t * s), so a prefix is *covered* once it holds more units than that: a token
of a rare class is a unit, and of m tokens in one frequent class all but one are. Two partners then
share a rare token, or two tokens of one frequent class, among their prefixes. Rare tokens are
indexed singly and frequent ones by pairs within their class, so a passage in many documents alone
makes no candidates where rarer tokens cover the prefix. The prefix is extended until it is covered.

1. Documents -> per chunk of rows its distinct token fingerprints with their counts, by range of
   fingerprint, and which documents have them (one shuffle of about 6 bytes a token). Counts are summed
   within a chunk first, so a token in every document makes one entry a chunk and no hot group.
2. Per range: frequency of every token over the whole corpus; tokens of one document are dropped, as
   no partner has them (their number stays known).
3. Per document: those where too few tokens are shared to have a partner end here.
4. Prefixes -> index entries -> candidate families, each a component of "has an index entry in common";
   an entry goes out once a batch of documents, the others of the batch being tied to its first. Of
   equal token sets one is indexed. In a large corpus many n-grams are shared by chance, and single
   rare tokens then tie most documents into one family; the documents of families of over BLOCK are
   indexed again by pairs of tokens only, which no less leave no partner out, and fall into finer ones.
5. Per family: Jaccard of the real token sets, exact; a pair already in one group needn't be compared.
   Families that still have over BLOCK documents are compared block against block in many tasks.
6. Groups: components of the pairs found. Equal token sets are compared as one.

Fingerprints have 32 bits more than the number of ranges needs, as in a hash join of that size.
Documents without words (null, empty, only punctuation) are in no group. Repeated rows are copies of
each other. A null ``doc_id`` takes part and stays null. Ties need no rule: groups are components.
Extra columns are ignored. There are no limits on text length, partners or candidates.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.dataset as pads
import pyarrow.fs as pfs
from pyspark import TaskContext
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.llm.common import U64, blobs, chunks, column, file_system, hashes, lowered, mix, offsets, raw, scratch_path, spans, unblob, written
from quire.llm.components import components

N = 3
THRESHOLD = 0.6
#: Tokens of at most so many documents are indexed singly.
RARE = 8
#: Documents compared at once; larger families are cut into blocks.
BLOCK = 4096
#: Tokens that one range of fingerprints holds, about.
RANGE_TOKENS = 1 << 20
#: Decisions that are sent to every executor; more are joined by a shuffle.
BROADCAST_ROWS = 1_000_000

ODD = U64(0xD6E8FEB86659FD93)


def needed(size: np.ndarray, t: float) -> np.ndarray:
    """Tokens that a partner has of a document of ``size`` tokens, at least."""
    return np.ceil(t * size - 1e-9).astype(np.int64)


def tokens(texts: pa.Array, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Row and 64-bit hash of every n-gram, repeats included, rows ascending."""
    off, data = raw(lowered(texts))
    starts, ends, rows = spans(off, data)
    h = hashes(data, starts, ends)
    count = len(h) - n + 1
    out_rows, out = np.zeros(0, np.int64), np.zeros(0, U64)
    if count > 0:
        at = np.flatnonzero(rows[:count] == rows[n - 1 :])
        g = np.zeros(at.size, U64)
        for k in range(n):
            g = (g + h[at + k]) * ODD
        out_rows, out = rows[at], mix(g)
    words = np.bincount(rows, minlength=len(off) - 1) if rows.size else np.zeros(len(off) - 1, np.int64)
    short = np.flatnonzero((words > 0) & (words < n))
    if short.size:
        first = np.searchsorted(rows, short)
        g = np.zeros(short.size, U64)
        for k in range(n - 1):
            more = k < words[short]
            g[more] = (g[more] + h[first[more] + k]) * ODD
        out_rows, out = np.concatenate([out_rows, short]), np.concatenate([out, mix(g + words[short].astype(U64))])
        order = np.argsort(out_rows, kind="stable")
        out_rows, out = out_rows[order], out[order]
    return out_rows, out


def distinct(rows: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.lexsort((values, rows))
    rows, values = rows[order], values[order]
    new = np.ones(rows.size, bool)
    new[1:] = (rows[1:] != rows[:-1]) | (values[1:] != values[:-1])
    return rows[new], values[new]


def _tokenised(docs: DataFrame, n: int, bits: int) -> DataFrame:
    """Per chunk of rows: a blob of its distinct token fingerprints and their counts for each range, and one row (range < 0) of the documents' ids and sizes and of which documents have each fingerprint."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunk = TaskContext.get().partitionId() << 20
        for batch in batches:
            for part in chunks(batch):
                rows, g = tokens(part["text"], n)
                fp = g >> U64(32 - bits)
                if 32 + bits + 15 <= 64:
                    key = np.unique(rows.astype(U64) << U64(32 + bits) | fp)
                    rows, fp = (key >> U64(32 + bits)).astype(np.int64), key & U64((1 << (32 + bits)) - 1)
                else:
                    rows, fp = distinct(rows, fp)
                size = np.bincount(rows, minlength=part.num_rows).astype(np.int32)
                order = np.argsort(fp, kind="stable")
                rows, fp = rows[order].astype(np.uint16), fp[order]
                new = np.ones(fp.size, bool)
                new[1:] = fp[1:] != fp[:-1]
                first = np.flatnonzero(new)
                fp, count = fp[first], np.diff(np.append(first, rows.size)).astype(np.uint16)
                off = np.searchsorted(fp >> U64(32), np.arange((1 << bits) + 1, dtype=U64))
                full = np.flatnonzero(np.diff(off))
                cut = np.append(off[full], off[-1])
                ids = np.concatenate([np.asarray(part[c].fill_null(0)).astype(np.int64) for c in ("doc_id", "h", "file", "row")] + [np.asarray(part["doc_id"].is_valid()).astype(np.int64)])
                own = np.concatenate([size.view(np.uint8), rows.view(np.uint8), np.packbits(new)])
                k = len(full) + 1
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.append(full, -1 - int(mix(np.array([chunk], U64))[0] % U64(1 << bits))), pa.int32()),
                        pa.array(np.full(k, chunk), pa.int64()),
                        pa.array(np.append(np.diff(cut), 0), pa.int32()),
                        pa.concat_arrays([blobs(fp.astype(np.uint32), cut), blobs(ids, np.array([0, ids.size]))]),
                        pa.concat_arrays([blobs(count, cut), blobs(own, np.array([0, own.size]))]),
                    ],
                    ["range", "chunk", "n", "keys", "rows"],
                )
                chunk += 1

    return docs.mapInArrow(run, "range int, chunk bigint, n int, keys binary, rows binary")


def frequency_code(df: np.ndarray) -> np.ndarray:
    """A byte that grows with the number of documents: exact to 127, then in steps of a fifth."""
    return np.where(df < 128, df, 128 + np.floor(3.5 * np.log2(np.maximum(df, 128) / 128))).astype(np.uint8)


def _frequent(blobs_: DataFrame) -> DataFrame:
    """The same by the chunk's fingerprints that over one document of the corpus has: those, which they are (a bit each), and the code of their number of documents.

    A group has each fingerprint once a chunk, so one that every document has makes it no larger than the number of chunks.
    """
    schema = pa.schema([("range", pa.int32()), ("chunk", pa.int64()), ("n", pa.int32()), ("keys", pa.binary()), ("rows", pa.binary()), ("dfs", pa.binary())])

    def run(table: pa.Table) -> pa.Table:
        if table["range"][0].as_py() < 0:
            return table.append_column("dfs", pa.nulls(table.num_rows, pa.binary())).cast(schema)
        keys, off = unblob(table["keys"], np.uint32)
        count, _ = unblob(table["rows"], np.uint16)
        order = np.argsort(keys)
        new = np.ones(keys.size, bool)
        new[1:] = keys[order][1:] != keys[order][:-1]
        which = np.cumsum(new) - 1
        df = np.empty(keys.size, np.int64)
        df[order] = np.bincount(which, count[order]).astype(np.int64)[which]
        kept = df > 1
        cut = np.concatenate([[0], np.cumsum(kept)])[off]
        n = np.diff(off)
        begin = np.concatenate([[0], np.cumsum((n + 7) // 8)])
        bits = np.zeros(begin[-1] * 8, bool)
        bits[np.arange(keys.size) + np.repeat(begin[:-1] * 8 - off[:-1], n)] = kept
        return pa.Table.from_arrays([table["range"], table["chunk"], table["n"], blobs(keys[kept], cut), blobs(np.packbits(bits), begin), blobs(frequency_code(df[kept]), cut)], schema=schema)

    return blobs_.groupBy("range").applyInArrow(run, "range int, chunk bigint, n int, keys binary, rows binary, dfs binary")


SURVIVOR = "uid bigint, doc_id bigint, h bigint, file bigint, row bigint, size int, k1 bigint, k2 bigint, grams binary, dfs binary"


def _survivors(found: DataFrame, t: float) -> DataFrame:
    """Documents that share tokens enough to have a partner: their shared tokens, ascending, and a key that equal token sets share."""

    def run(table: pa.Table) -> pa.Table:
        ranges = np.asarray(table["range"])
        meta = int(np.flatnonzero(ranges < 0)[0])
        ids = np.frombuffer(table["keys"][meta].as_py(), np.int64).reshape(5, -1)
        own = np.frombuffer(table["rows"][meta].as_py(), np.uint8)
        size = own[: 4 * ids.shape[1]].view(np.int32).astype(np.int64)
        own, total = own[4 * ids.shape[1] :], int(size.sum())
        rows = own[: 2 * total].copy().view(np.uint16).astype(np.int64)
        which = np.cumsum(np.unpackbits(own[2 * total :], count=total)) - 1
        at = np.flatnonzero(ranges >= 0)
        rest = table.take(pa.array(at[np.argsort(ranges[at])]))
        keys, off = unblob(rest["keys"], np.uint32)
        df = unblob(rest["dfs"], np.uint8)[0]
        fp = np.repeat(np.asarray(rest["range"]).astype(U64), np.diff(off)) << U64(32) | keys.astype(U64)
        bits, byte = unblob(rest["rows"], np.uint8)
        n = np.asarray(rest["n"]).astype(np.int64)
        begin = np.concatenate([[0], np.cumsum(n)])
        known = np.unpackbits(bits)[np.arange(begin[-1]) + np.repeat(byte[:-1] * 8 - begin[:-1], n)].astype(bool)
        number = np.cumsum(known) - 1
        here = known[which] if total else np.zeros(0, bool)
        rows, which = rows[here], number[which[here]] if total else rows
        fp, df = fp[which], df[which]
        shared = np.bincount(rows, minlength=size.size)
        alive = (size > 0) & (shared >= needed(size, t))
        kept = alive[rows]
        rows, fp, df = rows[kept], fp[kept], df[kept]
        order = np.lexsort((fp, rows))
        rows, fp, df = rows[order], fp[order], df[order]
        cut = offsets(rows, size.size)
        total = np.concatenate([np.zeros(1, U64), np.cumsum(mix(fp ^ ODD))])
        total2 = np.concatenate([np.zeros(1, U64), np.cumsum(mix(fp * ODD + U64(1)))])
        uid = (table["chunk"][0].as_py() << 15) + np.arange(size.size)
        whole = shared == size
        k1 = np.where(whole, (total[cut[1:]] - total[cut[:-1]]).view(np.int64), uid)
        k2 = np.where(whole, ((total2[cut[1:]] - total2[cut[:-1]]) | U64(1)).view(np.int64), 0)
        a = np.flatnonzero(alive)
        cut = np.append(cut[a], cut[-1])
        return pa.Table.from_arrays(
            [pa.array(uid[a]), pa.array(ids[0][a], mask=ids[4][a] == 0), *(pa.array(ids[i][a]) for i in (1, 2, 3)), pa.array(size[a], pa.int32()), pa.array(k1[a]), pa.array(k2[a]), blobs(fp, cut), blobs(df, cut)],
            ["uid", "doc_id", "h", "file", "row", "size", "k1", "k2", "grams", "dfs"],
        )

    return found.groupBy("chunk").applyInArrow(run, SURVIVOR)


def signatures(rows: np.ndarray, fp: np.ndarray, df: np.ndarray, size: np.ndarray, t: float, rare: int) -> tuple[np.ndarray, np.ndarray]:
    """Row and hash of every index entry. ``rows``, ``fp``, ``df``: the shared tokens, rows ascending; ``size``: all tokens of each row.

    Classes of frequent tokens must be as many as suit the size of a document, and the same for two
    partners. So documents are indexed by the power of two below their size, and again, with the
    classes of that boundary, where a partner may lie beyond one.
    """
    order = np.lexsort((fp, df, rows))
    rows, fp, df = rows[order], fp[order], df[order]
    single = (df <= rare) | (size[rows] == 1)
    n = size.size
    begin = offsets(rows, n)
    lone = size - np.diff(begin)
    need = size - needed(size, t) + 1 - lone
    level = np.frexp(size.astype(np.float64))[1] - 1
    above, below = 2.0 ** (level + 1), 2.0**level
    out_rows, out = [], []
    for step, joins in ((0, np.ones(n, bool)), (1, size >= t * above - 1e-9), (-1, t * size < below + 1e-9)):
        of = joins[rows]
        r, g, one = rows[of], fp[of], single[of]
        if not r.size:
            continue
        lower = np.maximum(below if step == 0 else np.ceil(t * (above if step > 0 else below) - 1e-9), 1).astype(np.int64)
        classes = np.maximum(1, np.minimum(lower - needed(lower, t) + 1, needed(lower, t) - 1))
        tag = (2 * level + step).astype(U64)
        cls = (mix(g ^ (tag[r] * ODD)) % classes[r].astype(U64)).astype(np.int64)
        where = r * np.int64(1 << 32) + cls
        unit = one.copy()
        many = np.flatnonzero(~one)
        _, first = np.unique(where[many], return_index=True)
        again = np.ones(many.size, bool)
        again[first] = False
        unit[many] = again
        covered = np.cumsum(unit) - unit
        start = offsets(r, n)
        base = np.append(covered, covered[-1] + unit[-1])[np.minimum(start[:-1], r.size)]
        prefix = covered - base[r] < need[r]
        if step == 0:
            s = prefix & one
            out_rows.append(r[s])
            out.append(mix(g[s] + ODD))
        p = np.flatnonzero(prefix & ~one)
        p = p[np.argsort(where[p], kind="stable")]
        w = where[p]
        new = np.ones(p.size, bool)
        new[1:] = w[1:] != w[:-1]
        head = np.maximum.accumulate(np.where(new, np.arange(p.size), 0))
        place = np.arange(p.size) - head
        second = np.repeat(np.arange(p.size), place)
        done = np.cumsum(place) - place
        first_ = np.repeat(head - done, place) + np.arange(second.size)
        x, y = g[p[first_]], g[p[second]]
        x, y = np.minimum(x, y), np.maximum(x, y)
        out_rows.append(r[p[second]])
        out.append(mix(mix(x + tag[r[p[second]]] * ODD) ^ (y * ODD)))
    return (np.concatenate(out_rows), np.concatenate(out)) if out else (np.zeros(0, np.int64), np.zeros(0, U64))


def _index(survivors: DataFrame, t: float, rare: int, bits: int) -> DataFrame:
    """Blobs of index entries and the first document of a batch that has each, by range of entry; the batch's other documents are tied to that one in rows of range < 0."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                part = batch.slice(at, 1024)
                fp, off = unblob(part["grams"], U64)
                df, _ = unblob(part["dfs"], np.uint8)
                rows = np.repeat(np.arange(part.num_rows), np.diff(off))
                r, s = signatures(rows, fp, df, np.asarray(part["size"]).astype(np.int64), t, rare)
                pairs, s, u = _tied(s, np.asarray(part["uid"])[r])
                off = np.searchsorted(s >> U64(64 - bits), np.arange((1 << bits) + 1, dtype=U64)) if bits else np.array([0, s.size])
                full = np.flatnonzero(np.diff(off))
                cut = np.append(off[full], off[-1])
                own = -1 - int(mix(np.array([part["uid"][0].as_py()], U64))[0] % U64(1 << bits))
                yield pa.RecordBatch.from_arrays([pa.array(np.append(full, own), pa.int32()), pa.concat_arrays([blobs(s, cut), blobs(pairs[:, 0], np.array([0, len(pairs)]))]), pa.concat_arrays([blobs(u, cut), blobs(pairs[:, 1], np.array([0, len(pairs)]))])], ["range", "entries", "uids"])

    return survivors.select("uid", "size", "grams", "dfs").mapInArrow(run, "range int, entries binary, uids binary")


def _tied(s: np.ndarray, u: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Each document with the first that has an entry in common; the entries, ascending, and that first document of each."""
    order = np.lexsort((u, s))
    s, u = s[order], u[order]
    new = np.ones(s.size, bool)
    new[1:] = s[1:] != s[:-1]
    least = u[np.maximum.accumulate(np.where(new, np.arange(s.size), 0))] if s.size else u
    return np.unique(np.stack([u, least], 1)[u != least], axis=0), s[new], u[new]


def _candidates(index: DataFrame) -> DataFrame:
    """Each document with the first document that has an index entry in common."""

    def run(table: pa.Table) -> pa.Table:
        s, _ = unblob(table["entries"], U64)
        u, _ = unblob(table["uids"], np.int64)
        pairs = np.stack([s.view(np.int64), u], 1) if table["range"][0].as_py() < 0 else _tied(s, u)[0]
        return pa.Table.from_arrays([pa.array(pairs[:, 0], pa.int64()), pa.array(pairs[:, 1], pa.int64())], ["a", "b"])

    return index.groupBy("range").applyInArrow(run, "a bigint, b bigint").distinct()


def grouped(fp: np.ndarray, off: np.ndarray, size: np.ndarray, t: float) -> np.ndarray:
    """For each token set of a family the first of its group: components of all pairs with Jaccard >= t."""
    _, ids = np.unique(fp, return_inverse=True)
    flag = np.zeros(ids.max() + 1 if ids.size else 1, bool)
    group = np.full(size.size, -1)
    todo = np.arange(size.size)
    ids_of = ids
    start = off[:-1]

    def rest(which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        count = off[which + 1] - off[which]
        end = np.concatenate([[0], np.cumsum(count)])
        return ids[np.repeat(start[which] - end[:-1], count) + np.arange(end[-1])], end

    ids_of, end = rest(todo)
    while todo.size:
        seed = todo[0]
        group[seed] = seed
        todo = todo[1:]
        ids_of, end = ids_of[end[1] :], end[1:] - end[1]
        queue = [seed]
        while queue and todo.size:
            x = queue.pop()
            own = ids[off[x] : off[x + 1]]
            flag[own] = True
            total = np.concatenate([[0], np.cumsum(flag[ids_of], dtype=np.int64)])
            flag[own] = False
            both = total[end[1:]] - total[end[:-1]]
            hit = both / (size[x] + size[todo] - both) >= t
            if hit.any():
                queue.extend(todo[hit].tolist())
                group[todo[hit]] = seed
                todo = todo[~hit]
                ids_of, end = rest(todo)
    return group


def _families(survivors: DataFrame, left_out: DataFrame, t: float, rare: int, bits: int) -> DataFrame:
    """Components of "has an index entry in common" of the survivors but for those that are ``left_out``, by their place; no row is moved."""
    gone = left_out.select(F.col("at").alias("file"), F.col("nth").alias("row"))
    some = _without(survivors, gone, gone.count())
    return written(components(written(_candidates(_index(some, t, rare, bits)), "near-candidates")), "near-families")


def _verified(survivors: DataFrame, members: DataFrame, families: DataFrame, t: float, block: int) -> DataFrame:
    """Pairs that tie every group together, each within one family."""
    ones = members.filter("uid = rep").select("uid").join(families.withColumnRenamed("node", "uid"), "uid")
    sizes = ones.groupBy("component").agg(F.count("*").alias("m")).filter("m > 1")
    placed = ones.join(sizes, "component").withColumn("q", F.ceil(F.col("m") / F.lit(block)).cast("int"))
    placed = placed.withColumn("c", F.pmod(F.xxhash64("uid"), F.col("q")).cast("int")).withColumn("o", F.explode(F.sequence(F.lit(0), F.col("q") - 1)))
    placed = written(placed.select("uid", "component", F.least("c", "o").alias("lo"), F.greatest("c", "o").alias("hi")), "family-blocks")
    buckets = max(1, placed.count() // block)
    placed = placed.withColumn("bucket", F.pmod(F.xxhash64("component", "lo", "hi"), F.lit(buckets)).cast("int"))

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by([("component", "ascending"), ("lo", "ascending"), ("hi", "ascending"), ("uid", "ascending")]).combine_chunks()
        keys = np.stack([np.asarray(table[c]).astype(np.int64) for c in ("component", "lo", "hi")], 1)
        cut = np.concatenate([[0], np.flatnonzero((keys[1:] != keys[:-1]).any(1)) + 1, [len(keys)]])
        fp, off = unblob(table["grams"], U64)
        size, uid = np.asarray(table["size"]).astype(np.int64), np.asarray(table["uid"])
        a, b = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for i, j in zip(cut[:-1], cut[1:], strict=True):
            if j - i > 1:
                g = grouped(fp[off[i] : off[j]], off[i : j + 1] - off[i], size[i:j], t)
                tied = np.flatnonzero(g != np.arange(j - i))
                a.append(uid[i + tied])
                b.append(uid[i + g[tied]])
        return pa.Table.from_arrays([pa.array(np.concatenate(a), pa.int64()), pa.array(np.concatenate(b), pa.int64())], ["a", "b"])

    return survivors.select("uid", "size", "grams").join(placed, "uid").groupBy("bucket").applyInArrow(run, "a bigint, b bigint")


def near_duplicates(docs: DataFrame, n: int = N, threshold: float = THRESHOLD, rare: int = RARE, block: int = BLOCK, range_tokens: int = RANGE_TOKENS) -> DataFrame:
    """``doc_id``, ``h`` (the text's hash), ``file`` and ``row`` (where the row stands, if ``docs`` is read from Parquet files), ``grp`` and ``uid`` of every row that has a partner; rows of one group share ``grp``."""
    if not 0.5 < threshold <= 1:
        raise ValueError("the threshold must be over 0.5 and at most 1")
    file, row = _place(docs) or (F.lit(0).cast("bigint"), F.lit(0).cast("bigint"))
    docs = column(column(docs, "doc_id", "bigint"), "text", "string").select("doc_id", "text", F.xxhash64("text").alias("h"), file.alias("file"), row.alias("row"))
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    bits = max(0, int(np.ceil(np.log2(max(1, size / 6 / range_tokens)))))
    survivors = written(_survivors(_frequent(_tokenised(docs, n, bits)), threshold), "near-survivors")
    keys = survivors.groupBy("k1", "k2").agg(F.min("uid").alias("rep"))
    at, nth = _place(survivors)
    members = survivors.select("uid", "doc_id", "h", "file", "row", "k1", "k2", at.alias("at"), nth.alias("nth")).join(keys, ["k1", "k2"])
    members = written(members.select("uid", "doc_id", "h", "file", "row", "rep", "at", "nth"), "near-members")
    families = _families(survivors, members.filter("uid <> rep"), threshold, rare, bits)
    sizes = written(families.groupBy("component").count().filter(F.col("count") > block).select("component"), "near-crowds")
    if sizes.limit(1).count():
        crowd = written(families.join(sizes, "component").select(F.col("node").alias("uid")), "near-crowd")
        finer = _families(survivors, members.join(crowd, "uid", "left_anti"), threshold, 0, bits)
        families = families.join(sizes, "component", "left_anti").select("node", "component").unionByName(finer)
    ties = components(written(_verified(survivors, members, families, threshold, block), "near-pairs"))
    labelled = members.join(ties.withColumnRenamed("node", "rep"), "rep", "left").withColumn("grp", F.coalesce("component", "rep"))
    return written(labelled.select("doc_id", "h", "file", "row", "grp", "uid"), "near-groups")


def groups(docs: DataFrame, **parameters) -> DataFrame:
    """``doc_id``, ``group_id`` (the group's smallest ``doc_id``) and ``group_size`` (rows) of every row that has a near copy."""
    found = near_duplicates(docs, **parameters)
    sizes = found.groupBy("grp").agg(F.min("doc_id").alias("group_id"), F.count("*").alias("group_size")).filter("group_size > 1")
    return found.join(sizes, "grp").select("doc_id", "group_id", "group_size")


def _place(docs: DataFrame) -> tuple[Column, Column] | None:
    """Hash of the file and number of the row in it, if the rows of ``docs`` come straight from Parquet files."""
    place = F.xxhash64("_metadata.file_path"), F.col("_metadata.row_index")
    if "_metadata" in docs.columns:
        return None
    try:
        docs.select(*place)
    except AnalysisException:
        return None
    return place


def _without(docs: DataFrame, gone: DataFrame, n: int) -> DataFrame:
    """``docs`` without the ``n`` rows whose place is in ``gone``; no row is moved: a task reads the places of its own files."""
    file, row = _place(docs)
    placed = docs.toDF(*(f"c{i}" for i in range(len(docs.columns)))).withColumns({"file": file, "row": row})
    if n <= BROADCAST_ROWS:
        return placed.join(F.broadcast(gone), ["file", "row"], "left_anti").drop("file", "row").toDF(*docs.columns)
    buckets, path = math.ceil(n / BROADCAST_ROWS), scratch_path(docs.sparkSession, "near-gone")
    gone.withColumn("bucket", F.pmod("file", F.lit(buckets))).repartition(buckets, "bucket").sortWithinPartitions("file", "row").write.partitionBy("bucket").parquet(path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, at = file_system(path)
        last, rows = None, np.zeros(0, np.int64)
        for batch in batches:
            file, row = np.asarray(batch["file"]), np.asarray(batch["row"])
            keep = np.ones(batch.num_rows, bool)
            for f in np.unique(file):
                if f != last:
                    folder = f"{at}/bucket={int(f) % buckets}"
                    found = pads.dataset(folder, filesystem=fs, format="parquet").to_table(["row"], filter=pads.field("file") == int(f))["row"] if fs.get_file_info(folder).type == pfs.FileType.Directory else pa.array([], pa.int64())
                    last, rows = f, np.sort(np.asarray(found))
                own = np.flatnonzero(file == f)
                near = np.minimum(np.searchsorted(rows, row[own]), max(rows.size - 1, 0))
                keep[own] = rows[near] != row[own] if rows.size else True
            yield batch.select(batch.schema.names[:-2]).filter(pa.array(keep))

    return placed.mapInArrow(run, placed.drop("file", "row").schema).toDF(*docs.columns)


def deduplicated(docs: DataFrame, **parameters) -> DataFrame:
    """``docs`` with one row of each group, that of the smallest ``doc_id`` (and, among rows of that id, text hash); other rows as they are.

    Rows read straight from Parquet files are left out by their place in them, the first place of equal
    rows staying, without moving any. Others are joined by ``doc_id`` and text hash, and any one of
    rows equal in both stays.
    """
    found = near_duplicates(docs, **parameters)
    if _place(docs) is not None:
        best = found.groupBy("grp").agg(F.min(F.struct("doc_id", "h", "file", "row")).alias("best"), F.count("*").alias("n")).filter("n > 1")
        gone = written(found.join(best, "grp").filter(F.struct("doc_id", "h", "file", "row") != F.col("best")).select("file", "row"), "near-marks")
        return _without(docs, gone, gone.count())
    best = found.groupBy("grp").agg(F.min(F.struct("doc_id", "h")).alias("best"), F.count("*").alias("n")).filter("n > 1")
    rows = found.join(best, "grp").groupBy("doc_id", "h").agg(F.count("*").alias("times"), F.max((F.struct("doc_id", "h") == F.col("best")).cast("int")).alias("is_best"))
    marks = written(rows.filter("is_best = 0 OR times > 1").select(F.col("doc_id").alias("__id"), F.col("h").alias("__h"), F.col("is_best").alias("__best")), "near-marks")
    joined = docs.join(marks, docs["doc_id"].cast("bigint").eqNullSafe(marks["__id"]) & (F.xxhash64(docs["text"].cast("string")) == marks["__h"]), "left")
    own = [docs[f"`{c}`"] for c in docs.columns]
    kept = joined.filter(marks["__best"].isNull()).select(*own)
    if marks.filter("__best = 1").limit(1).count():
        again = joined.filter(marks["__best"] == 1).select(F.struct(*own).alias("row"), marks["__id"].alias("i"), marks["__h"].alias("h"))
        kept = kept.unionByName(again.dropDuplicates(["i", "h"]).select("row.*"))
    return kept


SQL = f"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(lower(text), '[a-z0-9\\x{{80}}-\\x{{10FFFF}}]+') AS ws FROM documents),
g AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(ws) >= {N} THEN [array_to_string(ws[i:i + {N - 1}], ' ') for i in range(1, len(ws) - {N - 2})]
                                      WHEN len(ws) > 0 THEN [array_to_string(ws, ' ')] ELSE [] END) AS gram FROM w),
s AS (SELECT doc_id, count(*) AS n FROM g GROUP BY doc_id),
p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS common FROM g a JOIN g b ON a.gram = b.gram AND a.doc_id < b.doc_id GROUP BY ALL),
e AS (SELECT x, y FROM p JOIN s sx ON x = sx.doc_id JOIN s sy ON y = sy.doc_id WHERE common / (sx.n + sy.n - common) >= {THRESHOLD}),
u AS (SELECT x, y FROM e UNION ALL SELECT y, x FROM e),
r(x, y) AS (SELECT x, y FROM u UNION SELECT r.x, u.y FROM r JOIN u ON r.y = u.x),
c AS (SELECT x AS doc_id, least(min(y), x) AS group_id FROM r GROUP BY x)
SELECT doc_id, group_id, count(*) OVER (PARTITION BY group_id) AS group_size FROM c
"""
