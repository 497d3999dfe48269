"""Quality rules: an isolation forest on rule statistics.

Every document gets the statistics in STATS from its whole text; shares are taken over a few units
more than the text has, so that a very short text isn't odd by rounding. A forest of random splits is
grown on the good labelled rows, of which each tree draws SUBSAMPLE, splitting the box that all labelled rows
span (not only where a node's rows lie, as a cluster of like junk would then look usual); the fewer
splits it takes to set a document apart, the more anomalous it is. Rules of one kind (GROUPS) have a forest of their own, so that one odd habit isn't
lost among many usual statistics. Length is in no group: few good rows are long, so a forest that splits on
it would take one chance repeat in a long text for an anomaly. Each forest's threshold is calibrated on all labelled rows, whose scores are counted exactly
where they are: the lowest that spares all but ALLOWED of the good rows. A document over any threshold is rejected.

A null or empty text, and one without words, has all statistics 0, scores null, and is rejected.
Without labelled good rows (no labels, or none whose text has words) there is no forest: scores are
null and only texts without words are rejected. Labels that are null are left out; a ``doc_id``
labelled twice counts as good only if all its labels say so. Repeated rows get equal results.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm.common import INK, U64, chunks, column, hashes, lowered, offsets, raw, remove, rows_mapped, scratch_path, slim, spans, sums, written

STATS = ["log_words", "word_length", "upper", "digits", "symbols", "same_as_last", "distinct", "line_words", "repeated_lines", "top_word", "stop_words", "marked_words"]
GROUPS = {"casing": ["upper", "word_length"], "symbols": ["symbols", "marked_words", "digits"], "structure": ["stop_words", "line_words"], "repetition": ["same_as_last", "distinct", "top_word"], "lines": ["repeated_lines"]}
#: Trees of a forest, and the good labelled rows that each draws: the subsampling that the method consists in.
TREES, SUBSAMPLE = 64, 256
#: Share of the good labelled rows that each threshold may give up.
ALLOWED = 0.001
SEED = 11
#: Scores are counted in so many steps, and by their exact values within the steps where a threshold lies.
STEPS = 1 << 16
STOP = "the of and to in is that it was for on are with be at by this from or an a die der und das von zu den mit ist im des auf für dem nicht ein eine als auch le la les de des et un une du que est pour dans qui par sur au pas plus avec el los las del que y en se por con una para es al lo como más".split()


def _flag(*codes) -> np.ndarray:
    table = np.zeros(256, bool)
    table[list(codes)] = True
    return table


UPPER, DIGIT = _flag(*range(65, 91)), _flag(*range(48, 58))
SYMBOL = _flag(*(c for c in range(33, 127) if not chr(c).isalnum() and chr(c) not in ".,;:!?'\"-()"))
MARK, LINE = _flag(*map(ord, ".,;:!?'\"-()")), _flag(10)
NOT_LINE = ~LINE
_stop: np.ndarray | None = None


def statistics(texts: pa.Array) -> np.ndarray:
    """A row of STATS for each text."""
    global _stop
    n = len(texts)
    off, data = raw(texts)
    low_off, low = raw(lowered(texts))
    starts, ends, rows = spans(low_off, low, INK)
    h = hashes(low, starts, ends)
    if _stop is None:
        o, d = raw(pa.array(sorted(set(STOP))))
        _stop = np.sort(hashes(d, o[:-1], o[1:]))
    words = offsets(rows, n)
    count = np.diff(words)
    one = count + 5
    size = np.diff(off) + 30

    def share(table: np.ndarray) -> np.ndarray:
        return sums(table[data], off) / size

    chars = pc.utf8_length(pc.fill_null(texts, "")).to_numpy(zero_copy_only=False)
    capitals = chars * 0.0 + sums(UPPER[data] | np.concatenate([[False], (data[:-1] == 0xC3) & (data[1:] >= 0x80) & (data[1:] <= 0x9E)]) if data.size else np.zeros(0), off)
    length = ends - starts
    same = np.zeros(h.size, bool)
    same[1:] = (h[1:] == h[:-1]) & (rows[1:] == rows[:-1])
    order = np.lexsort((h, rows))
    hs, rs = h[order], rows[order]
    new = np.ones(hs.size, bool)
    new[1:] = (hs[1:] != hs[:-1]) | (rs[1:] != rs[:-1])
    at = np.flatnonzero(new)
    times = np.diff(np.append(at, hs.size))
    top = np.zeros(n)
    np.maximum.at(top, rs[at], times)
    stop = _stop[np.minimum(np.searchsorted(_stop, h), _stop.size - 1)] == h
    last = low[ends - 1] if ends.size else np.zeros(0, np.uint8)
    plain = (last >= 128) | ((last >= 97) & (last <= 122)) | np.isin(last, np.frombuffer(b".,;:?'\")", np.uint8))
    ls, le, lr = spans(off, data, NOT_LINE)
    lh = hashes(data, ls, le)
    order = np.lexsort((lh, lr))
    lhs, lrs = lh[order], lr[order]
    again = np.zeros(lhs.size, bool)
    again[1:] = (lhs[1:] == lhs[:-1]) & (lrs[1:] == lrs[:-1])
    lines = np.bincount(lr, minlength=n)
    found = {
        "log_words": np.log1p(count),
        "word_length": (sums(length, words) + 25) / one,
        "upper": capitals / (chars + 30),
        "digits": share(DIGIT),
        "symbols": share(SYMBOL),
        "same_as_last": sums(same, words) / one,
        "distinct": np.log(np.bincount(rs[at], minlength=n) + 5) / np.log(one) if at.size else np.zeros(n),
        "line_words": np.log1p(count / np.maximum(lines, 1)),
        "repeated_lines": np.bincount(lrs[again], minlength=n) / (lines + 4) if lrs.size else np.zeros(n),
        "top_word": top / one,
        "stop_words": sums(stop, words) / one,
        "marked_words": (count - sums(plain, words)) / one,
    }
    table = np.stack([found[k] for k in STATS], 1)
    table[count == 0] = 0
    return table


def _mean_path(n: float) -> float:
    """Splits that an unsuccessful search takes in a tree of n rows."""
    return 0.0 if n <= 1 else 1.0 if n <= 2 else 2 * (np.log(n - 1) + 0.5772156649) - 2 * (n - 1) / n


class Forest:
    """Trees as arrays: node i splits on ``feature[i]`` at ``cut[i]`` and goes to ``child[i]`` or the node after it; leaves have their path length in ``cut``."""

    def __init__(self, x: np.ndarray, box: np.ndarray, trees: int, subsample: int, rng: np.random.Generator):
        self.subsample = min(subsample, len(x))
        limit = int(np.ceil(np.log2(max(self.subsample, 2)))) + 4
        self.feature, self.cut, self.child, self.roots = [], [], [], []

        def grow(rows: np.ndarray, low: np.ndarray, high: np.ndarray, depth: int) -> None:
            i = len(self.feature)
            usable = np.flatnonzero(high > low)
            leaf = depth >= limit or len(rows) <= 1 or not usable.size
            f = -1 if leaf else rng.choice(usable)
            cut = depth + _mean_path(len(rows)) if leaf else low[f] + rng.random() * (high[f] - low[f])
            self.feature.append(f)
            self.cut.append(cut)
            self.child.append(0)
            if leaf:
                return
            left = x[rows, f] <= cut
            upper, lower = high.copy(), low.copy()
            upper[f] = lower[f] = cut
            grow(rows[left], low, upper, depth + 1)
            self.child[i] = len(self.feature)
            grow(rows[~left], lower, high, depth + 1)

        for _ in range(trees):
            self.roots.append(len(self.feature))
            grow(rng.choice(len(x), self.subsample, replace=False), *box, 0)
        self.feature, self.cut, self.child = np.array(self.feature), np.array(self.cut), np.array(self.child)

    def paths(self, x: np.ndarray) -> np.ndarray:
        """Mean path length of each row."""
        total = np.zeros(len(x))
        for root in self.roots:
            at = np.full(len(x), root)
            todo = np.arange(len(x))
            while todo.size:
                node = at[todo]
                inner = self.feature[node] >= 0
                todo, node = todo[inner], node[inner]
                at[todo] = np.where(x[todo, self.feature[node]] <= self.cut[node], node + 1, self.child[node])
            total += self.cut[at]
        return total / len(self.roots)

    def score(self, x: np.ndarray) -> np.ndarray:
        """2 to the power of minus the path length over the usual one: towards 1 the more anomalous."""
        return np.exp2(-self.paths(x) / max(_mean_path(self.subsample), 1e-9))


@dataclass
class Rules:
    forests: dict[str, Forest]
    thresholds: dict[str, float]

    def scores(self, x: np.ndarray) -> np.ndarray:
        return np.stack([f.score(x[:, [STATS.index(s) for s in GROUPS[g]]]) for g, f in self.forests.items()], 1)


def labelled(labels: DataFrame) -> DataFrame:
    """``doc_id``, ``good`` and ``toxic`` of every labelled ``doc_id``; the worst of several labels counts."""
    labels = column(column(column(labels, "doc_id", "bigint"), "quality", "int"), "toxic", "int")
    return labels.filter("doc_id IS NOT NULL AND quality IS NOT NULL").groupBy("doc_id").agg(F.min("quality").alias("good"), F.max(F.coalesce("toxic", F.lit(0))).alias("toxic"))


def train(docs: DataFrame, labels: DataFrame, trees: int = TREES, subsample: int = SUBSAMPLE, allowed: float = ALLOWED, seed: int = SEED) -> Rules | None:
    """Rules from all labelled rows that have words, a repeated row counting once: statistics and scores are made and counted where the rows are.

    Only the rows that the trees draw reach the driver, at most ``trees * subsample``, those of the
    smallest hash of all good ones. At most a share ``allowed`` of the good rows is over a threshold.
    """
    spark = docs.sparkSession
    made = [scratch_path(spark, f"rules-{x}") for x in ("rows", "scores")]
    good = labelled(labels).select("doc_id", (F.col("good") > 0).cast("int").alias("good"))
    try:
        rows = written(measured(slim(docs), ["doc_id"]).filter("log_words > 0").join(good, "doc_id").distinct(), "", made[0])
        box = rows.agg(F.sum("good").alias("good"), *(f(s).alias(f"{f.__name__}_{s}") for s in STATS for f in (F.min, F.max))).first()
        if not box["good"]:
            return None
        low, high = (np.array([box[f"{f}_{s}"] for s in STATS]) for f in ("min", "max"))
        drawn = rows.filter("good = 1").withColumn("o", F.xxhash64(F.lit(seed), "doc_id", *STATS)).orderBy("o", "doc_id").limit(trees * subsample)
        x, rng = drawn.select(*STATS).toPandas().to_numpy(float), np.random.default_rng(seed)
        forests = {}
        for g, stats in GROUPS.items():
            of = [STATS.index(s) for s in stats]
            forests[g] = Forest(x[:, of], np.stack([low[of], high[of]]), trees, subsample, rng)
        rules = Rules(forests, {})
        rules.thresholds = calibrated(written(_scored(rows, rules), "", made[1]), allowed)
        return rules
    finally:
        for path in made:
            remove(spark, path)


def _scored(rows: DataFrame, rules: Rules) -> DataFrame:
    """``good`` and every group's score of every row of statistics."""
    sent = rows.sparkSession.sparkContext.broadcast(rules)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            score = sent.value.scores(np.stack([np.asarray(batch[s]) for s in STATS], 1))
            yield pa.RecordBatch.from_arrays([batch["good"], *(pa.array(score[:, i]) for i in range(len(GROUPS)))], ["good", *GROUPS])

    return rows.mapInArrow(run, ", ".join(["good int", *(f"{g} double" for g in GROUPS)]))


def _counted(scored: DataFrame, within: list[list[int]] | None = None) -> dict[tuple[int, int], tuple[np.ndarray, np.ndarray]]:
    """By group and ``good``: the steps that rows' scores are in, ascending, and the number of rows; or the same of the scores ``within`` each group's steps."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            good = np.asarray(batch["good"])
            for i, g in enumerate(GROUPS):
                score = np.asarray(batch[g])
                step = np.floor(score * STEPS)
                for kind in (0, 1):
                    of = good == kind
                    values, n = np.unique(step[of] if within is None else score[of & np.isin(step, within[i])], return_counts=True)
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(n.size, i, np.int32)), pa.array(np.full(n.size, kind, np.int32)), pa.array(values.astype(float)), pa.array(n.astype(np.int64))], ["i", "good", "value", "n"])

    rows = scored.mapInArrow(run, "i int, good int, value double, n bigint").groupBy("i", "good", "value").agg(F.sum("n").alias("n")).toPandas().sort_values("value")
    of = {k: (r["value"].to_numpy(float), r["n"].to_numpy(np.int64)) for k, r in rows.groupby(["i", "good"])}
    return {(i, kind): of.get((i, kind), (np.zeros(0), np.zeros(0, np.int64))) for i in range(len(GROUPS)) for kind in (0, 1)}


def _place(n: np.ndarray, rank: int) -> tuple[int, int]:
    """Which of the values that ``n`` rows each have the row of this rank has, and its rank among those."""
    end = np.cumsum(n)
    at = int(np.searchsorted(end, rank, "right"))
    return at, int(rank - (end[at] - n[at]))


def calibrated(scored: DataFrame, allowed: float) -> dict[str, float]:
    """Of each group: half-way from the last good score that stays to the next anomalous one above it, by the quantiles of all rows; a forest that finds no anomalies rejects nothing new."""
    steps, many = _counted(scored), range(len(GROUPS))
    last = []
    for i in many:
        step, n = steps[i, 1]
        at, rank = _place(n, int(np.ceil((1 - allowed) * (n.sum() - 1))))
        last.append((step[at], rank))
    near = _counted(scored, [[step] for step, _ in last])
    limit = [near[i, 1][0][_place(near[i, 1][1], rank)[0]] for i, (_, rank) in enumerate(last)]
    # the poor rows beyond the limit: those of its own step by their scores, the others by their steps
    places, total = [], []
    for i in many:
        step, n = steps[i, 0]
        above = step > last[i][0]
        beyond = np.append(near[i, 0][1][near[i, 0][0] > limit[i]].sum(), n[above])
        total.append(0.02 * (beyond.sum() - 1))
        places.append([(np.append(last[i][0], step[above])[at], rank) for at, rank in (_place(beyond, int(f(total[i]))) for f in (np.floor, np.ceil))] if beyond.sum() else [])
    far = _counted(scored, [[step for step, _ in p] for p in places])
    thresholds = {}
    for i, g in enumerate(GROUPS):
        value, n = far[i, 0]
        found = []
        for step, rank in places[i]:
            own = (np.floor(value * STEPS) == step) & (value > limit[i])
            found.append(value[own][_place(n[own], rank)[0]])
        thresholds[g] = float((limit[i] + found[0] + (found[1] - found[0]) * (total[i] % 1)) / 2) if found else float(limit[i] + 0.02)
    return thresholds


def measured(docs: DataFrame, keep: list[str]) -> DataFrame:
    """Columns ``keep`` and STATS of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in chunks(batch):
                x = statistics(part["text"])
                yield pa.RecordBatch.from_arrays([*(part[k] for k in keep), *(pa.array(x[:, i]) for i in range(len(STATS)))], [*keep, *STATS])

    kinds = dict(docs.dtypes)
    return docs.select(*keep, "text").mapInArrow(run, ", ".join([f"{k} {kinds[k]}" for k in keep] + [f"{s} double" for s in STATS]))


def judged(docs: DataFrame, rules: Rules | None) -> DataFrame:
    """``doc_id``, every group's score, ``rejected_by`` (groups over their threshold, or ``empty``) and ``keep``, of every row."""
    groups = list(GROUPS)
    sent = docs.sparkSession.sparkContext.broadcast(rules)
    schema = "doc_id bigint, " + ", ".join(f"{g}_score double" for g in groups) + ", rejected_by string, keep boolean"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rules = sent.value
        for batch in batches:
            for part in chunks(batch):
                yield pa.RecordBatch.from_arrays([part["doc_id"], *verdict(part["text"], rules)], ["doc_id", *(f"{g}_score" for g in groups), "rejected_by", "keep"])

    return slim(docs).mapInArrow(run, schema)


def verdict(texts: pa.Array, rules: Rules | None) -> list[pa.Array]:
    x = statistics(texts)
    empty = x[:, STATS.index("log_words")] == 0
    if rules is None:
        score, over = np.full((len(x), len(GROUPS)), np.nan), np.zeros((len(x), len(GROUPS)), bool)
    else:
        score = rules.scores(x)
        over = (score > np.array(list(rules.thresholds.values()))) & ~empty[:, None]
    why = ["empty" if e else ",".join(g for g, o in zip(GROUPS, row, strict=True) if o) for e, row in zip(empty, over, strict=True)]
    mask = empty | (rules is None)
    return [*(pa.array(score[:, i], mask=mask) for i in range(len(GROUPS))), pa.array(why, pa.string()), pa.array(~empty & ~over.any(1))]


def kept(docs: DataFrame, rules: Rules | None) -> DataFrame:
    """The rows of ``docs``, all columns, that no rule rejects."""
    sent = docs.sparkSession.sparkContext.broadcast(rules)
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            text = batch.column(at).cast(pa.string())
            slimmed = pa.RecordBatch.from_arrays([pa.array(range(batch.num_rows), pa.int64()), text], ["i", "text"])
            keep = [verdict(part["text"], sent.value)[-1] for part in chunks(slimmed)]
            if keep:
                yield batch.filter(pa.concat_arrays(keep))

    return rows_mapped(docs, run)
