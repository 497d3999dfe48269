"""Language of every word, by a linear-chain conditional random field.

Each word has features (prefixes and suffixes of up to AFFIX characters, character n-grams, and
membership in a lexicon of each language); a language's emission is the sum of its weights for them.
Transitions between the languages of neighbouring words, and of the first and last word, are learned
with them, by gradient ascent on the likelihood of labelled sequences. Forward-backward gives every
word the probability of each language in its whole text; the likeliest is its label.

The labelled sequences are a bounded sample of documents with a language (SAMPLE a language, of at most
ROW_BYTES bytes; of each, a window of WINDOW words that an epoch draws anew), half of them spliced from
passages of documents of different languages, so that the field learns how code-switching looks.
Words are runs of letters and other characters beyond ASCII; digits and marks are in no word.

A text without words (null, empty) has no runs, null language and 0 switches. Equal probabilities go
to the first language in order. Texts of any length are labelled whole: blocks of words are multiplied
out side by side and joined exactly. Repeated rows get equal results; extra columns are ignored;
training rows with a null language or text are left out, and without any there are no labels.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quire.llm.common import BYTE_VALUE, U64, chunks, column, lowered, mix, offsets, powers, raw, slim, spans

LETTERS = np.zeros(256, bool)
LETTERS[[*range(65, 91), *range(97, 123), *range(128, 256)]] = True
AFFIX = 3
BITS = 15
#: Documents of each language that the field is fitted on, at most, and the bytes of each; longer ones are left out of the fitting.
SAMPLE, ROW_BYTES = 150, 1 << 18
#: Words of a fitted document that one epoch uses, a window that begins anywhere in it.
WINDOW = 160
BLOCK = 64
LEXICON = {
    "de": "der die das und ist nicht ein eine mit von zu den auf für im dem als auch es an werden aus er hat dass sie nach wird bei",
    "en": "the of and to in is that it was for on are with be at by this from or an have not you which one had but what all were",
    "es": "el la de que y en los del se las por un para con no una su al es lo como más o pero sus le ha me si sin",
    "fr": "le la les de des et un une du que est pour dans qui par sur au pas plus avec ce il ne se sont ou elle son cette",
}


def word_table(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Bytes, starts, ends, rows and hashes of the words."""
    off, data = raw(lowered(texts))
    starts, ends, rows = spans(off, data, LETTERS)
    return data, starts, ends, rows, _hash(data, starts, ends, 0)


def _hash(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, kind: int) -> np.ndarray:
    up, down = powers(data.size + 1)
    total = np.concatenate([np.zeros(1, U64), np.cumsum(BYTE_VALUE[data] * up[: data.size])])
    return mix((total[ends] - total[starts]) * down[starts] + (ends - starts + 1000 * kind).astype(U64))


def features(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashed features of each word, and where each word's begin. Affixes and n-grams are of bytes; edges of words count as n-gram bytes."""
    n = starts.size
    size = ends - starts
    up, down = powers(data.size + 1)
    total = np.concatenate([np.zeros(1, U64), np.cumsum(BYTE_VALUE[data] * up[: data.size])])
    sub = lambda a, b, kind: mix((total[b] - total[a]) * down[a] + (b - a + 1000 * kind).astype(U64))
    words, found = [np.arange(n)], [sub(starts, ends, 1)]
    for k in range(1, AFFIX + 1):
        at = np.flatnonzero(size >= k)
        words += [at, at]
        found += [sub(starts[at], starts[at] + k, 2), sub(ends[at] - k, ends[at], 3)]
    for k in (2, 3):
        many = np.maximum(size - k + 1, 0)
        end = np.concatenate([[0], np.cumsum(many)])
        which = np.repeat(np.arange(n), many)
        a = starts[which] + np.arange(end[-1]) - end[:-1][which]
        words.append(which)
        found.append(sub(a, a + k, 4))
    words, found = np.concatenate(words), np.concatenate(found)
    order = np.argsort(words, kind="stable")
    return (found[order] >> U64(64 - BITS)).astype(np.int64), offsets(words[order], n)


@dataclass
class Field:
    languages: list[str]
    weights: np.ndarray
    lexicon: dict[int, int]
    lexical: np.ndarray
    trans: np.ndarray
    first: np.ndarray
    last: np.ndarray

    def emissions(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray, h: np.ndarray) -> np.ndarray:
        """Score of every language for every word; each distinct word is scored once."""
        if not h.size:
            return np.zeros((0, len(self.languages)))
        _, one, which = np.unique(h, return_index=True, return_inverse=True)
        f, off = features(data, starts[one], ends[one])
        score = np.add.reduceat(self.weights[f], off[:-1], axis=0) / np.diff(off)[:, None]
        member = np.array([self.lexicon.get(int(x), -1) for x in h[one]])
        score += self.lexical[member]
        return score[which]


def _normal(x: np.ndarray) -> np.ndarray:
    return x / x.sum(-1, keepdims=True)


def messages(emission: np.ndarray, rows: np.ndarray, trans: np.ndarray, first: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Forward-backward over all texts at once: every word's probabilities, its forward message, its emission times its backward message, and the transition odds.

    Words are cut into blocks of BLOCK; a block's transition matrices are multiplied out for all
    blocks side by side, the products chained over the blocks, and messages filled in within them.
    """
    n, k = emission.shape
    if not n:
        return emission, emission, emission, np.exp(trans)
    e = np.exp(emission - emission.max(1, keepdims=True))
    t, begin, end = np.exp(trans - trans.max()), np.exp(first - first.max()), np.exp(last - last.max())
    head = np.ones(n, bool)
    head[1:] = rows[1:] != rows[:-1]
    tail = np.append(head[1:], True)
    e[tail] *= end
    blocks = -(-n // BLOCK)
    pad = blocks * BLOCK - n
    ep = np.concatenate([e, np.ones((pad, k))]).reshape(blocks, BLOCK, k)
    hp = np.concatenate([head, np.ones(pad, bool)]).reshape(blocks, BLOCK)
    reset = np.broadcast_to(begin, (k, k))

    def step(m: np.ndarray, i: int) -> np.ndarray:
        moved = (m.reshape(-1, k) @ t).reshape(m.shape)
        h = hp[:, i]
        if h.any():
            moved[h] = reset if m.ndim == 3 else begin
        moved *= ep[:, i, None, :] if m.ndim == 3 else ep[:, i]
        return moved / moved.sum(-1, keepdims=True).max(-2, keepdims=True) if m.ndim == 3 else _normal(moved)

    product = np.broadcast_to(np.eye(k), (blocks, k, k)).copy()
    for i in range(BLOCK):
        product = step(product, i)
    incoming = np.empty((blocks, k))
    v = np.full(k, 1 / k)
    for b in range(blocks):
        incoming[b] = v
        v = v @ product[b]
        v = v / v.sum()
    forward = np.empty((blocks, BLOCK, k))
    m = incoming
    for i in range(BLOCK):
        m = step(m, i)
        forward[:, i] = m
    # beta before place i: what the words from i on say of the one before; 1 where a text begins
    outgoing = np.empty((blocks, k))
    v = np.ones(k)
    back = np.broadcast_to(np.eye(k), (blocks, k, k)).copy()

    def back_step(m: np.ndarray, i: int) -> np.ndarray:
        h = hp[:, i]
        if m.ndim == 3:
            x = t @ (ep[:, i, :, None] * m)
            if h.any():
                x[h] = ((begin * ep[h, i])[:, None, :] @ m[h])
            return x / x.sum((-1, -2), keepdims=True)
        x = (ep[:, i] * m) @ t.T
        if h.any():
            x[h] = 1.0
        return _normal(x)

    for i in range(BLOCK - 1, -1, -1):
        back = back_step(back, i)
    for b in range(blocks - 1, -1, -1):
        outgoing[b] = v
        v = back[b] @ v
        v = v / v.sum()
        if hp[b, 0]:
            v = np.full(k, 1 / k)
    beta = np.empty((blocks, BLOCK, k))
    m = outgoing
    for i in range(BLOCK - 1, -1, -1):
        beta[:, i] = m
        m = back_step(m, i)
    forward, beta = forward.reshape(-1, k)[:n], beta.reshape(-1, k)[:n]
    return _normal(forward * beta), forward, e * beta, t


def marginals(emission: np.ndarray, rows: np.ndarray, trans: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """Probability of each language of each word."""
    return messages(emission, rows, trans, first, last)[0]


def fit(texts: list[str], langs: list[str], seed: int = 5, epochs: int = 14, rate: float = 0.15, passage: int = 40, window: int = WINDOW) -> Field | None:
    """A field of texts of one language each; see the module's note on splicing."""
    languages = sorted({x for x in langs if x})
    if not languages:
        return None
    rng = np.random.default_rng(seed)
    k = len(languages)
    data, starts, ends, rows, h = word_table(pa.array(texts, pa.string()))
    label = np.array([languages.index(x) if x else -1 for x in langs])
    lexicon = {}
    for i, lang in enumerate(languages):
        for w in LEXICON.get(lang, "").split():
            x = int(word_table(pa.array([w]))[4][0])
            lexicon[x] = k if x in lexicon and lexicon[x] != i else i
    f, foff = features(data, starts, ends)
    member = np.array([lexicon.get(int(x), -1) for x in h]) if h.size else np.zeros(0, int)
    field = Field(languages, np.zeros((1 << BITS, k)), lexicon, np.zeros((k + 2, k)), np.zeros((k, k)), np.zeros(k), np.zeros(k))
    params = [field.weights, field.lexical, field.trans, field.first, field.last]
    moments = [np.full(p.shape, 1e-8) for p in params]
    docs = np.split(np.arange(rows.size), np.searchsorted(rows, np.arange(1, len(texts))))
    docs = [(d, label[i]) for i, d in enumerate(docs) if d.size and label[i] >= 0]
    if not docs:
        return None
    for epoch in range(epochs):
        pieces = []
        for d, y in docs:
            a = int(rng.integers(0, max(1, d.size - window)))
            d = d[a : a + window]
            if rng.random() < 0.5:
                pieces.append([(d, y)])
            else:
                pieces += [[(p, y)] for p in np.split(d, np.sort(rng.integers(0, d.size + 1, 3))) if p.size]
        whole = [p for p in pieces if p[0][0].size > passage]
        parts = [p[0] for p in pieces if p[0][0].size <= passage]
        order = rng.permutation(len(parts))
        spliced = [[parts[i] for i in order[a : a + 4]] for a in range(0, len(order), 4)]
        sequences = whole + spliced
        for at in range(0, len(sequences), 32):
            batch = [sequences[i] for i in rng.permutation(len(sequences))[:32]] if epoch % 2 else sequences[at : at + 32]
            words = np.concatenate([p for s in batch for p, _ in s])
            truth = np.concatenate([np.full(p.size, y) for s in batch for p, y in s])
            seq = np.concatenate([np.full(sum(p.size for p, _ in s), i) for i, s in enumerate(batch)])
            _step(field, params, moments, f, foff, member, words, truth, seq, rate * (1 - epoch / epochs))
    return field


def _step(field, params, moments, f, foff, member, words, truth, seq, rate) -> None:
    """One step of AdaGrad on the mean log-likelihood of a batch of sequences."""
    k, n = len(field.languages), words.size
    count = foff[words + 1] - foff[words]
    end = np.concatenate([[0], np.cumsum(count)])
    ids = f[np.repeat(foff[words] - end[:-1], count) + np.arange(end[-1])]
    emission = np.add.reduceat(field.weights[ids], end[:-1], axis=0) / count[:, None] + field.lexical[member[words]]
    p, forward, after, t = messages(emission, seq, field.trans, field.first, field.last)
    head = np.ones(n, bool)
    head[1:] = seq[1:] != seq[:-1]
    tail = np.append(head[1:], True)
    one = np.eye(k)[truth]
    d = (one - p) / n
    grads = [np.zeros_like(x) for x in params]
    np.add.at(grads[0], ids, np.repeat(d / count[:, None], count, axis=0))
    np.add.at(grads[1], member[words], d)
    inner = np.flatnonzero(~head)
    pair = forward[inner - 1][:, :, None] * t * after[inner][:, None, :]
    pair = (pair / pair.sum((1, 2), keepdims=True)).sum(0)
    np.add.at(grads[2], (truth[inner - 1], truth[inner]), 1 / n)
    grads[2] -= pair / n
    grads[3], grads[4] = d[head].sum(0), d[tail].sum(0)
    for x, g, m in zip(params, grads, moments, strict=True):
        m += g * g
        x += rate * g / np.sqrt(m)
        x *= 1 - 1e-5


def train(docs: DataFrame, sample: int = SAMPLE, **parameters) -> Field | None:
    """A field of at most ``sample`` documents of each language in column ``lang``, those of the smallest hash of ``doc_id``."""
    docs = column(column(column(docs, "doc_id", "bigint"), "lang", "string"), "text", "string").select("doc_id", "lang", "text")
    known = docs.filter(f"lang IS NOT NULL AND text IS NOT NULL AND doc_id IS NOT NULL AND octet_length(text) <= {ROW_BYTES}")
    first = F.row_number().over(Window.partitionBy("lang").orderBy(F.xxhash64("doc_id"), "doc_id"))
    chosen = known.select("lang", "doc_id").withColumn("n", first).filter(F.col("n") <= sample).select("lang", "doc_id").distinct()
    rows = known.join(F.broadcast(chosen), ["lang", "doc_id"]).toPandas().sort_values(["lang", "doc_id", "text"])
    return fit(rows["text"].tolist(), rows["lang"].tolist(), **parameters)


RESULT = "doc_id bigint, n_words int, lang string, lang_words int, switches int, confidence double, runs array<struct<lang:string,first_word:int,n_words:int>>"


def label(texts: pa.Array, field: Field | None) -> list[pa.Array]:
    """Words, main language and its words, switches, mean probability of the labels, and runs of words of one language, of each text."""
    n = len(texts)
    data, starts, ends, rows, h = word_table(texts)
    words = np.diff(offsets(rows, n))
    run_type = pa.struct([("lang", pa.string()), ("first_word", pa.int32()), ("n_words", pa.int32())])
    if field is None:
        none = pa.nulls(n, pa.string())
        return [pa.array(words.astype(np.int32)), none, pa.nulls(n, pa.int32()), pa.nulls(n, pa.int32()), pa.nulls(n, pa.float64()), pa.nulls(n, pa.list_(run_type))]
    p = marginals(field.emissions(data, starts, ends, h), rows, field.trans, field.first, field.last)
    k = len(field.languages)
    y = p.argmax(1) if len(p) else np.zeros(0, int)
    counts = np.bincount(rows * k + y, minlength=n * k).reshape(n, k)
    main = counts.argmax(1)
    new = np.ones(y.size, bool)
    new[1:] = (rows[1:] != rows[:-1]) | (y[1:] != y[:-1])
    at = np.flatnonzero(new)
    size = np.diff(np.append(at, y.size))
    run_off = offsets(rows[at], n)
    first = at - np.searchsorted(rows, rows[at])
    sure = np.bincount(rows, weights=p.max(1) if len(p) else None, minlength=n) / np.maximum(words, 1)
    names = pa.array(field.languages)
    runs = pa.ListArray.from_arrays(pa.array(run_off, pa.int32()), pa.StructArray.from_arrays([names.take(pa.array(y[at])), pa.array(first, pa.int32()), pa.array(size, pa.int32())], ["lang", "first_word", "n_words"]))
    none = words == 0
    return [
        pa.array(words.astype(np.int32)),
        names.take(pa.array(main, mask=none)),
        pa.array(counts[np.arange(n), main].astype(np.int32)),
        pa.array(np.maximum(np.diff(run_off) - 1, 0).astype(np.int32)),
        pa.array(sure, mask=none),
        runs,
    ]


def labelled(docs: DataFrame, field: Field | None) -> DataFrame:
    """RESULT for every row."""
    sent = docs.sparkSession.sparkContext.broadcast(field)
    names = [x.split()[0] for x in RESULT.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in chunks(batch):
                yield pa.RecordBatch.from_arrays([part["doc_id"], *label(part["text"], sent.value)], names)

    return slim(docs).mapInArrow(run, RESULT)
