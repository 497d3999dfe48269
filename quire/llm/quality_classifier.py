"""Quality classifier: attention-based multiple-instance learning.

A document is a bag of passages of PASSAGE words. Every passage is encoded (word embeddings and style
shares, through tanh); gated attention, learned from the documents' labels alone, weighs the passages;
the weighted representation is scored. There is one attention and score for quality and one for
toxicity, over the same encoder. Trained here, on a bounded sample of labelled rows, by Adam. The
words that tell are counted where the texts are; of the sample only the known words, passage sizes
and styles reach the driver, through the shared folder into files that it maps, so that its memory
holds a few documents at a time, whatever their length.

A document is rejected if its quality is under, or its toxicity over, a threshold calibrated on
held-out rows of the sample so that a share ALLOWED of the clean ones is given up.

A text without words (null, empty) has no passages: scores null, rejected. Null labels are left out;
of several labels of one ``doc_id`` the worst counts. Without labels of both kinds a score is null and
rejects nothing. Texts are read whole, whatever their length; repeated rows get equal results; extra
columns are left out of the scores and kept by ``kept``.
"""

from __future__ import annotations

import os
import tempfile
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.dataset as pads
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm.common import U64, chunks, file_system, hashes, lists, lowered, offsets, raw, remove, rows_mapped, scratch_path, slim, spans, sums, written
from quire.llm.quality_rules import DIGIT, MARK, SYMBOL, UPPER, labelled

PASSAGE = 64
#: Labelled rows that the model is fitted on, at most, and the bytes of the text of each; longer ones are left out of the fitting.
SAMPLE, ROW_BYTES = 6000, 1 << 18
#: The model knows every word of at least MIN_DOCS fitted rows that goes with a label by SIGNIFICANT standard deviations; others say too little to be learned.
MIN_DOCS, SIGNIFICANT = 4, 6.0
HIDDEN, GATE = 24, 16
EPOCHS, BATCH, RATE, DECAY = 16, 32, 0.01, 0.05
#: Share of the words that each step of the training leaves out, lest documents be known by heart.
DROPPED = 0.3
ALLOWED = 0.004
SLOT_BITS = 20
TASKS = ("quality", "toxic")
#: A character of a word.
ANY_WORD = r"[^\x00-/:-@\[-`{-\x7f]"
STYLES = 7


def passages(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Word hashes, where each passage's words begin, where each document's passages begin, and a row of styles for each passage."""
    n = len(texts)
    off, data = raw(texts)
    low_off, low = raw(lowered(texts))
    starts, ends, rows = spans(low_off, low)
    h = hashes(low, starts, ends)
    count = np.diff(offsets(rows, n))
    many = -(-count // PASSAGE)
    doc = np.concatenate([[0], np.cumsum(many)])
    first = np.concatenate([[0], np.cumsum(count)])[:-1]
    begin = np.repeat(first - doc[:-1] * PASSAGE, many) + np.arange(doc[-1]) * PASSAGE
    begin = np.append(begin, h.size).astype(np.int64)
    # lowering may change a character's bytes, so styles are read from spans of the text as it stands
    s, e, r = spans(off, data)
    if s.size != starts.size:
        s, r = np.minimum(starts, max(data.size - 1, 0)), rows
    edge = s[begin[:-1]] if begin.size > 1 else np.zeros(0, np.int64)
    edge = np.append(edge, data.size)
    size = np.maximum(np.diff(edge), 1)
    words = np.maximum(np.diff(begin), 1)
    same = np.zeros(h.size, bool)
    same[1:] = (h[1:] == h[:-1]) & (rows[1:] == rows[:-1])
    style = np.stack([sums(t[data], edge) / size for t in (UPPER, DIGIT, SYMBOL, MARK)] + [sums(same, begin) / words, sums(ends - starts, begin) / words / 10, words / PASSAGE], 1) if words.size else np.zeros((0, STYLES))
    style[:, :6] *= np.array([3, 3, 3, 3, 2, 1])
    return h, begin, doc, style.astype(np.float32)


def _segment(values: np.ndarray, off: np.ndarray) -> np.ndarray:
    """Sums over non-empty segments."""
    return np.add.reduceat(values, off[:-1], axis=0) if len(off) > 1 else np.zeros((0, *values.shape[1:]), values.dtype)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + np.tanh(0.5 * x))


@dataclass
class Model:
    #: Hashes of the known words, ascending, and which of the SLOT_BITS first bits any of them has.
    vocabulary: np.ndarray
    some: np.ndarray
    weights: dict[str, np.ndarray]
    thresholds: dict[str, float | None] = field(default_factory=dict)

    def words(self, h: np.ndarray) -> np.ndarray:
        """Number of each word; the last for the unknown, whose embedding stays 0."""
        word = np.full(h.size, self.vocabulary.size)
        at = np.flatnonzero(self.some[(h >> U64(64 - SLOT_BITS)).astype(np.int64)])
        if at.size:
            near = np.minimum(np.searchsorted(self.vocabulary, h[at]), self.vocabulary.size - 1)
            word[at] = np.where(self.vocabulary[near] == h[at], near, self.vocabulary.size)
        return word

    def known(self, word: np.ndarray, begin: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The same without the unknown words, as they add nothing, but for one at the start of each passage, so that none is empty."""
        kept = word != len(self.weights["E"]) - 1
        kept[begin[:-1]] = True
        return word[kept], np.concatenate([[0], np.cumsum(kept)])[begin]

    def encode(self, word: np.ndarray, begin: np.ndarray, size: np.ndarray, style: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Passages of ``size`` words, whose known ones begin at ``begin``."""
        w = self.weights
        scale = (1 / np.sqrt(size + 1)).astype(np.float32)[:, None]
        return np.tanh(_segment(w["E"][word], begin) * scale + style @ w["S"] + w["b"]), scale

    def attend(self, h: np.ndarray, doc: np.ndarray, t: int) -> tuple:
        """Gates, attention, document vectors and logits of task t; every document has a passage."""
        w = self.weights
        a, s = np.tanh(h @ w["V"][t]), _sigmoid(h @ w["U"][t])
        logit = (a * s) @ w["w"][t]
        top = np.repeat(np.maximum.reduceat(logit, doc[:-1]), np.diff(doc))
        e = np.exp(logit - top)
        alpha = e / np.repeat(_segment(e, doc), np.diff(doc))
        z = _segment(alpha[:, None] * h, doc)
        return a, s, alpha, z, z @ w["c"][t] + w["d"][t]


def counted(hashes_: np.ndarray, doc: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Every distinct word, the number of documents that have it, and how many of them have each label."""
    order = np.lexsort((hashes_, doc))
    doc, hashes_ = doc[order], hashes_[order]
    new = np.ones(doc.size, bool)
    new[1:] = (doc[1:] != doc[:-1]) | (hashes_[1:] != hashes_[:-1])
    doc, hashes_ = doc[new], hashes_[new]
    del order, new
    words, which, docs = np.unique(hashes_, return_inverse=True, return_counts=True)
    return words, docs, np.stack([np.bincount(which, weights=y[doc, t], minlength=words.size) for t in range(2)], 1)


def telling(docs: np.ndarray, seen: np.ndarray, share: np.ndarray) -> np.ndarray:
    """Which words go with a label; ``share``: of the documents with words, those that have each label."""
    p = np.clip(share, 1e-3, 1 - 1e-3)
    return (docs >= MIN_DOCS) & ((np.abs(seen - docs[:, None] * p) / np.sqrt(docs[:, None] * p * (1 - p))).max(1) >= SIGNIFICANT)


def _fresh(known: np.ndarray, rng: np.random.Generator) -> Model:
    """A model of the words ``known``, ascending, that has learned nothing yet."""
    some = np.zeros(1 << SLOT_BITS, bool)
    some[(known >> U64(64 - SLOT_BITS)).astype(np.int64)] = True
    shape = {"E": (known.size + 1, HIDDEN), "S": (STYLES, HIDDEN), "b": (HIDDEN,), "V": (2, HIDDEN, GATE), "U": (2, HIDDEN, GATE), "w": (2, GATE), "c": (2, HIDDEN), "d": (2,)}
    w = {k: (rng.normal(0, {"E": 0.05, "b": 0, "d": 0}.get(k, 0.3), s)).astype(np.float32) for k, s in shape.items()}
    w["E"][-1] = 0
    return Model(known, some, w)


def fit(h: np.ndarray, begin: np.ndarray, doc: np.ndarray, style: np.ndarray, y: np.ndarray, seed: int = 7, epochs: int = EPOCHS, allowed: float = ALLOWED) -> Model:
    """A model of documents given as ``passages`` gives them; ``y``: a row of labels (quality, toxic) for each. A fifth is held out for the thresholds."""
    rng = np.random.default_rng(seed)
    n = len(doc) - 1
    held = rng.permutation(n) < n // 5
    words_of = np.repeat(np.arange(n, dtype=np.int32), np.diff(begin[doc]))
    fitted = ~held[words_of]
    words, docs, seen = counted(h[fitted], words_of[fitted], y)
    model = _fresh(words[telling(docs, seen, y[np.unique(words_of[fitted])].mean(0))] if words.size else words, rng)
    size = np.diff(begin)
    word, begin = model.known(model.words(h), begin)
    return _learned(model, word, begin, size, doc, style, y, held, np.arange(n), rng, epochs, allowed)


def _learned(model: Model, word, begin, size, doc, style, y: np.ndarray, held: np.ndarray, first: np.ndarray, rng: np.random.Generator, epochs: int, allowed: float) -> Model:
    """``model``, fitted on the documents that aren't ``held``; ``first``: their order, before it is shuffled. Words, passages and styles are only read for a few documents at a time."""
    w = model.weights
    m, v = ({k: np.zeros_like(x) for k, x in w.items()} for _ in range(2))
    share = np.clip(y[~held].mean(0), 1e-3, 1 - 1e-3)
    step, train = 0, first[~held[first]]
    for epoch in range(epochs):
        order = rng.permutation(train)
        rate = RATE * (1 - epoch / epochs)
        for at in range(0, order.size, BATCH):
            part, *rest = _part(word, begin, size, doc, style, order[at : at + BATCH])
            part[rng.random(part.size) < DROPPED] = model.vocabulary.size
            g = _gradients(model, part, *rest, y[order[at : at + BATCH]], np.arange(len(rest[2]) - 1), share)
            step += 1
            for k, x in g.items():
                m[k] += 0.1 * (x - m[k])
                v[k] += 0.005 * (x * x - v[k])
                w[k] -= rate * (m[k] / (1 - 0.9**step) / (np.sqrt(v[k] / (1 - 0.995**step)) + 1e-7) + DECAY * w[k])
            w["E"][-1] = 0
    check = first[held[first]] if held.any() else first
    clean = check[(y[check] == [1, 0]).all(1)]
    p = [scores(model, *_part(word, begin, size, doc, style, clean[at : at + BATCH]))[0] for at in range(0, clean.size, BATCH)]
    p = np.concatenate(p) if p else np.zeros((0, 2))
    for t, name in enumerate(TASKS):
        if np.ptp(y[:, t]) == 0 or not clean.size:
            model.thresholds[name] = None
        elif t == 0:
            model.thresholds[name] = float(min(0.5, np.quantile(p[:, 0], allowed, method="lower") - 1e-6))
        else:
            model.thresholds[name] = float(max(0.5, np.quantile(p[:, 1], 1 - allowed, method="higher") + 1e-6))
    return model


def _part(word, begin, size, doc, style, of: np.ndarray) -> tuple:
    """The documents ``of`` alone, in that order."""
    which, doc = _pick(doc, of)
    at, begin = _pick(begin, which)
    return np.array(word[at]), begin, size[which], doc, np.array(style[which])


def _pick(off: np.ndarray, of: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Members of the segments ``of``, and where each segment begins among them."""
    count = off[of + 1] - off[of]
    end = np.concatenate([[0], np.cumsum(count)])
    return np.repeat(off[of] - end[:-1], count) + np.arange(end[-1]), end


def _gradients(model: Model, word, begin, size, doc, style, y, of, share) -> dict[str, np.ndarray]:
    w = model.weights
    which, doc = _pick(doc, of)
    at, begin = _pick(begin, which)
    word, style, y = word[at], style[which], y[of]
    h, scale = model.encode(word, begin, size[which], style)
    dh = np.zeros_like(h)
    g = {k: np.zeros_like(x) for k, x in w.items()}
    for t in range(2):
        a, s, alpha, z, logit = model.attend(h, doc, t)
        weight = np.where(y[:, t] > 0, 0.5 / share[t], 0.5 / (1 - share[t]))
        d = ((_sigmoid(logit) - y[:, t]) * weight / len(of)).astype(np.float32)
        g["c"][t], g["d"][t] = d @ z, d.sum()
        dz = np.repeat(d, np.diff(doc))[:, None] * w["c"][t]
        dalpha = (dz * h).sum(1)
        dh += alpha[:, None] * dz
        da = alpha * (dalpha - np.repeat(_segment(alpha * dalpha, doc), np.diff(doc)))
        g["w"][t] = da @ (a * s)
        d1, d2 = da[:, None] * w["w"][t] * s * (1 - a * a), da[:, None] * w["w"][t] * a * s * (1 - s)
        g["V"][t], g["U"][t] = h.T @ d1, h.T @ d2
        dh += d1 @ w["V"][t].T + d2 @ w["U"][t].T
    dpre = dh * (1 - h * h)
    g["S"], g["b"] = style.T @ dpre, dpre.sum(0)
    np.add.at(g["E"], word, np.repeat(dpre * scale, np.diff(begin), axis=0))
    return g


def scores(model: Model, word, begin, size, doc, style) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For documents with passages: quality and toxicity; the passage with most weight for each, and that weight."""
    h, _ = model.encode(word, begin, size, style)
    p, top, most = (np.zeros((len(doc) - 1, 2)) for _ in range(3))
    for t in range(2):
        _, _, alpha, _, logit = model.attend(h, doc, t)
        p[:, t] = _sigmoid(logit.astype(np.float64))
        order = np.lexsort((np.arange(alpha.size), -alpha, np.repeat(np.arange(len(doc) - 1), np.diff(doc))))
        top[:, t] = order[doc[:-1]] - doc[:-1]
        most[:, t] = alpha[order[doc[:-1]]]
    return p, top, most


def labelled_sample(docs: DataFrame, labels: DataFrame, limit: int) -> DataFrame:
    """At most ``limit`` labelled rows, those of the smallest hash of ``doc_id``: ``doc_id``, ``good``, ``toxic`` and the text."""
    chosen = labelled(labels).withColumn("o", F.xxhash64("doc_id")).orderBy("o", "doc_id").limit(limit).drop("o")
    return slim(docs).join(F.broadcast(chosen), "doc_id")


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, seed: int = 7, epochs: int = EPOCHS, allowed: float = ALLOWED) -> Model | None:
    """A model of at most ``sample`` labelled rows of at most ROW_BYTES bytes (a row that is repeated counts once), or None without such rows. A fifth is held out for the thresholds."""
    spark, made = docs.sparkSession, [scratch_path(docs.sparkSession, f"classifier-{x}") for x in ("rows", "passages")]
    rows = labelled_sample(docs, labels, sample).filter((F.octet_length("text") <= ROW_BYTES) & F.col("text").rlike(ANY_WORD))
    rows = written(rows.withColumn("h", F.xxhash64("text")).dropDuplicates(["doc_id", "h"]), "", made[0])
    rng = np.random.default_rng(seed)
    try:
        keys = rows.select("doc_id", "h", "good", "toxic").toPandas().sort_values(["doc_id", "h"], ignore_index=True)
        n = len(keys)
        if not n:
            return None
        held, y = rng.permutation(n) < n // 5, (keys[["good", "toxic"]].to_numpy() > 0).astype(np.float32)
        numbers = spark.createDataFrame(keys[["doc_id", "h"]].assign(number=range(n), held=held), "doc_id bigint, h bigint, number int, held boolean")
        rows = rows.join(F.broadcast(numbers), ["doc_id", "h"])
        model = _fresh(_told(rows, y[~held].mean(0)), rng)
        _prepared(rows, model).write.option("compression", "zstd").parquet(made[1])
        with tempfile.TemporaryDirectory() as folder:
            *read, number = _mapped(made[1], folder)
            return _learned(model, *read, y[number], held[number], np.argsort(number), rng, epochs, allowed)
    finally:
        for path in made:
            remove(spark, path)


def _told(rows: DataFrame, share: np.ndarray) -> np.ndarray:
    """Hashes of all words of the rows not held that go with a label, ascending."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in chunks(batch):
                h, begin, doc, _ = passages(part["text"])
                y = np.stack([np.asarray(part["good"]) > 0, np.asarray(part["toxic"]) > 0], 1)
                words, docs, seen = counted(h, np.repeat(np.arange(part.num_rows), np.diff(begin[doc])), y)
                yield pa.RecordBatch.from_arrays([pa.array(words.view(np.int64)), *(pa.array(x.astype(np.int64)) for x in (docs, seen[:, 0], seen[:, 1]))], ["word", "docs", "good", "toxic"])

    def choose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            docs, seen = np.asarray(batch["docs"]), np.stack([np.asarray(batch["good"]), np.asarray(batch["toxic"])], 1)
            yield batch.select(["word"]).filter(pa.array(telling(docs, seen, share)))

    counts = rows.filter("NOT held").select("good", "toxic", "text").mapInArrow(count, "word bigint, docs bigint, good bigint, toxic bigint")
    counts = counts.groupBy("word").agg(*(F.sum(c).alias(c) for c in ("docs", "good", "toxic"))).filter(F.col("docs") >= MIN_DOCS)
    return np.sort(counts.mapInArrow(choose, "word bigint").toArrow()["word"].to_numpy().astype(np.int64).view(U64))


def _prepared(rows: DataFrame, model: Model) -> DataFrame:
    """Of every row, by its number: its known words as numbers, how many of them each passage has, the passages' sizes and styles."""
    sent = rows.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in chunks(batch):
                h, begin, doc, style = passages(part["text"])
                word, known = sent.value.known(sent.value.words(h), begin)
                arrays = [lists(word, known[doc], pa.int32()), lists(np.diff(known), doc, pa.int32()), lists(np.diff(begin), doc, pa.int32()), lists(style.ravel(), doc * STYLES, pa.float32())]
                yield pa.RecordBatch.from_arrays([part["number"], *arrays], ["number", "word", "known", "size", "style"])

    return rows.select("number", "text").mapInArrow(run, "number int, word array<int>, known array<int>, size array<int>, style array<float>")


def _mapped(path: str, folder: str) -> tuple:
    """Words, passages and styles of a table that ``_prepared`` made, as ``_learned`` takes them, words and styles in files of ``folder``; and the rows' numbers."""
    fs, at = file_system(path)
    known, size, doc, number = [], [], [], []
    names = [os.path.join(folder, k) for k in ("word", "style")]
    with open(names[0], "wb") as words, open(names[1], "wb") as styles:
        for batch in pads.dataset(at, filesystem=fs, format="parquet").to_batches(batch_size=64, batch_readahead=1, fragment_readahead=1):
            for file, k in ((words, "word"), (styles, "style")):
                file.write(np.ascontiguousarray(batch[k].flatten()).tobytes())
            known.append(np.asarray(batch["known"].flatten()))
            size.append(np.asarray(batch["size"].flatten()))
            doc.append(np.asarray(pc.list_value_length(batch["size"])))
            number.append(np.asarray(batch["number"]))
    known, size, doc, number = (np.concatenate(x).astype(np.int64) for x in (known, size, doc, number))
    word, style = np.memmap(names[0], np.int32, "r"), np.memmap(names[1], np.float32, "r").reshape(-1, STYLES)
    return word, np.concatenate([[0], np.cumsum(known)]), size, np.concatenate([[0], np.cumsum(doc)]), style, number


def verdict(texts: pa.Array, model: Model | None) -> dict[str, pa.Array]:
    h, begin, doc, style = passages(texts)
    n = len(texts)
    full = np.diff(doc) > 0
    p, top, most = (np.zeros((n, 2)) for _ in range(3))
    keep, known = full.copy(), model.thresholds if model is not None else dict.fromkeys(TASKS)
    if model is not None and full.any():
        p[full], top[full], most[full] = scores(model, *model.known(model.words(h), begin), np.diff(begin), np.append(doc[:-1][full], doc[-1]), style)
        if known["quality"] is not None:
            keep &= p[:, 0] >= known["quality"]
        if known["toxic"] is not None:
            keep &= p[:, 1] <= known["toxic"]
    out = {"n_passages": pa.array(np.diff(doc).astype(np.int32))}
    for t, name in enumerate(TASKS):
        none = ~full | (known[name] is None)
        out |= {f"{name}_score": pa.array(p[:, t], mask=none), f"{name}_passage": pa.array(top[:, t].astype(np.int32), mask=none), f"{name}_attention": pa.array(most[:, t], mask=none)}
    return out | {"keep": pa.array(keep)}


def judged(docs: DataFrame, model: Model | None) -> DataFrame:
    """Scores, the passage of most weight and ``keep`` of every row."""
    sent = docs.sparkSession.sparkContext.broadcast(model)
    schema = "doc_id bigint, n_passages int, " + ", ".join(f"{t}_score double, {t}_passage int, {t}_attention double" for t in TASKS) + ", keep boolean"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in chunks(batch):
                got = verdict(part["text"], sent.value)
                yield pa.RecordBatch.from_arrays([part["doc_id"], *got.values()], ["doc_id", *got])

    return slim(docs).mapInArrow(run, schema)


def kept(docs: DataFrame, model: Model | None) -> DataFrame:
    """The rows of ``docs``, all columns, that aren't rejected."""
    sent = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            slimmed = pa.RecordBatch.from_arrays([pa.array(range(batch.num_rows), pa.int64()), batch.column(at).cast(pa.string())], ["i", "text"])
            keep = [verdict(part["text"], sent.value)["keep"] for part in chunks(slimmed)]
            if keep:
                yield batch.filter(pa.concat_arrays(keep))

    return rows_mapped(docs, run)
