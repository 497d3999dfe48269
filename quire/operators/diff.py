"""Gold against candidate label spans: which cells they share, how they line up, and a document's score.

A spans table has ``doc_id, span_id, label, gold boolean``; a span's cells are rows ``doc_id, span_id,
at`` (its place in the span), ``page, cx, cy`` (the cell's centre, exact), ``pins`` (an array of
``pin:label`` strings, innermost first) and ``char``. A span's key is its own, and so is a place in it.

:func:`comparison_table`, :func:`matches` of :func:`aligned` and :func:`summary` say what is meant, table by
table, and shuffle cells several times. :func:`compared`, :func:`matched` and :func:`scored` give the same
rows from documents that each hold their spans and cells (:func:`documents`): nothing of a document is
compared with another's, so they need no shuffle at all.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.functions.arrays import coded, expanded, flat, packed, starts_of

SKIPPED = [" ", ","]


def is_gold(team: str, path: str = "path"):
    """Whether an annotation's path ends in the name of the team whose annotations are gold."""
    return F.col(path).endswith(team)


def shared_points(spans: DataFrame, cells: DataFrame) -> DataFrame:
    """Cells that a gold and a candidate span of a document have in common, by page and centre."""
    own = cells.join(spans.select("doc_id", "span_id", "gold"), ["doc_id", "span_id"])
    g = own.filter("gold").select("doc_id", "page", "cx", "cy", F.col("span_id").alias("g"), F.col("at").alias("g_at"), F.col("pins").alias("g_pins"))
    n = own.filter("NOT gold").select("doc_id", "page", "cx", "cy", F.col("span_id").alias("n"), F.col("at").alias("n_at"), F.col("pins").alias("n_pins"))
    return g.join(n, ["doc_id", "page", "cx", "cy"])


def compared_pins(a, b):
    """Position by position whether two stacks are the same; the longer one's rest is different."""
    return F.forall(F.zip_with(a, b, lambda x, y: x.eqNullSafe(y)), lambda same: same)


def comparison_table(spans: DataFrame, cells: DataFrame) -> DataFrame:
    """For each overlapping gold and candidate span: shared cells, and how many have the same pins."""
    points = shared_points(spans, cells).withColumn("same", compared_pins("g_pins", "n_pins"))
    return points.groupBy("doc_id", "g", "n").agg(F.count("*").alias("cells"), F.count_if("same").alias("same"))


def aligned(spans: DataFrame, cells: DataFrame) -> DataFrame:
    """Cells of overlapping spans side by side, lined up at their first shared cell: ``g_char`` or ``n_char`` is null where one has none."""
    anchor = shared_points(spans, cells).groupBy("doc_id", "g", "n").agg(F.min(F.struct("g_at", "n_at")).alias("a")).select("doc_id", "g", "n", F.col("a.g_at").alias("ga"), F.col("a.n_at").alias("na"))
    left = anchor.join(cells.select("doc_id", F.col("span_id").alias("g"), "at", F.col("char").alias("g_char")), ["doc_id", "g"]).select("doc_id", "g", "n", (F.col("at") - F.col("ga")).alias("place"), "g_char", F.lit(True).alias("in_g"))
    right = anchor.join(cells.select("doc_id", F.col("span_id").alias("n"), "at", F.col("char").alias("n_char")), ["doc_id", "n"]).select("doc_id", "g", "n", (F.col("at") - F.col("na")).alias("place"), "n_char", F.lit(True).alias("in_n"))
    return left.join(right, ["doc_id", "g", "n", "place"], "full_outer").withColumn("in_g", F.coalesce("in_g", F.lit(False))).withColumn("in_n", F.coalesce("in_n", F.lit(False)))


def matches(lined: DataFrame) -> DataFrame:
    """Per pair: ``exact`` if all cells are in both; ``loose`` if all are but blanks and commas at the ends."""
    both = F.col("in_g") & F.col("in_n")
    skip = F.coalesce("g_char", "n_char").isin(SKIPPED)
    inner = lined.withColumn("__keep", ~skip)
    edge = inner.filter("__keep").groupBy("doc_id", "g", "n").agg(F.min("place").alias("lo"), F.max("place").alias("hi"))
    joined = lined.join(edge, ["doc_id", "g", "n"], "left")
    inside = F.col("place").between(F.col("lo"), F.col("hi"))
    return joined.groupBy("doc_id", "g", "n").agg(F.every(both).alias("exact"), F.coalesce(F.every(F.when(inside, both)), F.lit(True)).alias("loose"))


def summary(spans: DataFrame, cells: DataFrame) -> DataFrame:
    """A row a document: golds, matched correctly, with errors and not at all; candidates without a gold; shares of the denominator (golds and unmatched candidates), and the share with loose matches of the one like-labelled candidate counted in."""
    pairs = comparison_table(spans, cells).join(matches(aligned(spans, cells)), ["doc_id", "g", "n"])
    names = spans.select("doc_id", "span_id", "label")
    pairs = pairs.join(names.select("doc_id", F.col("span_id").alias("g"), F.col("label").alias("gl")), ["doc_id", "g"]).join(names.select("doc_id", F.col("span_id").alias("n"), F.col("label").alias("nl")), ["doc_id", "n"])
    correct = (F.col("cells") == F.col("same")) & F.col("exact")
    alike = F.col("gl") == F.col("nl")
    per = pairs.groupBy("doc_id", "g").agg(F.bool_or(correct).alias("ok"), (F.count_if(alike) == 1).alias("one"), F.bool_or(alike & F.col("loose")).alias("loose"))
    golds = spans.filter("gold").select("doc_id", F.col("span_id").alias("g")).join(per, ["doc_id", "g"], "left")
    per_doc = golds.groupBy("doc_id").agg(F.count("*").alias("golds"), F.count_if("ok").alias("correct"), F.count_if(~F.col("ok")).alias("with_errors"), F.count_if(F.col("ok").isNull()).alias("unmatched"), F.count_if(~F.col("ok") & F.col("one") & F.col("loose")).alias("fixed"))
    free = spans.filter("NOT gold").select("doc_id", F.col("span_id").alias("n")).join(pairs.select("doc_id", "n"), ["doc_id", "n"], "left_anti").groupBy("doc_id").agg(F.count("*").alias("extra"))
    out = per_doc.join(free, "doc_id", "full_outer").na.fill(0)
    return _shares(out)


def _shares(out: DataFrame) -> DataFrame:
    denom = F.col("golds") + F.col("extra")
    share = lambda x: F.round(F.try_divide(x, denom) * 100, 2)
    return out.withColumn("correct_pct", share(F.col("correct"))).withColumn("error_pct", share(F.col("extra") + F.col("unmatched") + F.col("with_errors"))).withColumn("adjusted_pct", share(F.col("correct") + F.col("fixed")))


# --- document by document ---------------------------------------------------------------

#: Cells that are compared at once; a document of more is compared alone.
CELLS = 1 << 20


def documents(spans: DataFrame, cells: DataFrame) -> DataFrame:
    """A row a document: ``doc_id`` and its ``spans``, each with its ``cells``."""
    own = cells.groupBy("doc_id", "span_id").agg(F.collect_list(F.struct("at", "page", "cx", "cy", "pins", "char")).alias("cells"))
    none = F.array().cast(dict(own.dtypes)["cells"])
    return spans.join(own, ["doc_id", "span_id"], "left").groupBy("doc_id").agg(F.collect_list(F.struct("span_id", "label", "gold", F.coalesce("cells", none).alias("cells"))).alias("spans"))


class _Part:
    """Documents of a batch as flat arrays: spans by document, cells by span; and the pairs of spans that share cells."""

    def __init__(self, spans: pa.Array):
        self.doc_off, values = flat(spans)
        self.span_id, label, gold, cells = values.flatten()
        self.cell_off, values = flat(cells)
        at, page, cx, cy, pins, char = values.flatten()
        n_spans, n_cells = len(self.span_id), len(at)
        self.doc = np.repeat(np.arange(len(spans)), np.diff(self.doc_off))
        self.label = coded(label)
        self.gold = gold.fill_null(False).to_numpy(zero_copy_only=False)
        self.free = ~gold.fill_null(True).to_numpy(zero_copy_only=False)
        self.at = at.fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
        self.blank, self.named = (pc.is_in(char, pa.array(SKIPPED)).to_numpy(zero_copy_only=False), char.is_valid().to_numpy(zero_copy_only=False))
        span = np.repeat(np.arange(n_spans), np.diff(self.cell_off))
        # stacks are the same if they are so at every place, and what one lacks is null
        depth, ids = flat(pins)
        ids, stack = coded(ids) + 1, np.zeros(n_cells, np.int64)
        for i in range(int(np.diff(depth).max(initial=0))):
            has = np.diff(depth) > i
            here = np.zeros(n_cells, np.int64)
            here[has] = ids[depth[:-1][has] + i]
            stack = here if i == 0 else packed([stack, here])
        known = pins.is_valid().to_numpy(zero_copy_only=False)
        # cells of gold spans and of others in the same place
        whole = (page.is_valid().to_numpy(zero_copy_only=False)) & (cx.is_valid().to_numpy(zero_copy_only=False)) & (cy.is_valid().to_numpy(zero_copy_only=False))
        place = packed([self.doc[span], *(x.fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64) for x in (page, cx, cy))])
        g, n = np.flatnonzero(self.gold[span] & whole), np.flatnonzero(self.free[span] & whole)
        n = n[np.argsort(place[n], kind="stable")]
        low, high = (np.searchsorted(place[n], place[g], side) for side in ("left", "right"))
        of, which = expanded(low, high)
        g, n = g[of], n[which]
        key = span[g] * np.int64(max(n_spans, 1)) + span[n]
        order = np.argsort(key, kind="stable")
        key, g, n = key[order], g[order], n[order]
        first = starts_of(key)
        self.g, self.n = key[first] // max(n_spans, 1), key[first] % max(n_spans, 1)
        same = (stack[g] == stack[n]) & known[g] & known[n]
        self.cells = np.diff(np.append(first, key.size))
        self.same = np.add.reduceat(same.astype(np.int64), first) if first.size else self.cells
        # both spans' places count from their first shared cell
        self.g_at, self.n_at = np.zeros(first.size, np.int64), np.zeros(first.size, np.int64)
        if first.size:
            wide = int(self.at.max() - self.at.min()) + 1
            least = np.minimum.reduceat((self.at[g] - self.at.min()) * wide + self.at[n] - self.at.min(), first)
            self.g_at, self.n_at = least // wide + self.at.min(), least % wide + self.at.min()

    def lined_up(self) -> tuple[np.ndarray, np.ndarray]:
        """Of every pair whether it is matched exactly, and loosely."""
        if not self.g.size:
            return np.zeros(0, bool), np.zeros(0, bool)
        (p, c), (q, d) = (expanded(self.cell_off[s], self.cell_off[s + 1]) for s in (self.g, self.n))
        pair, cell, own = np.concatenate([p, q]), np.concatenate([c, d]), np.arange(p.size + q.size) < p.size
        place = self.at[cell] - np.where(own, self.g_at[pair], self.n_at[pair])
        least, wide = place.min(), int(place.max() - place.min()) + 1
        key = pair * np.int64(wide) + place - least
        order = np.argsort(key, kind="stable")
        key, cell, own = key[order], cell[order], own[order]
        first = starts_of(key)
        ink = self.named[cell] & ~self.blank[cell]
        in_g, in_n = np.logical_or.reduceat(own, first), np.logical_or.reduceat(~own, first)
        named_g, ink_g, ink_n = np.logical_or.reduceat(own & self.named[cell], first), np.logical_or.reduceat(own & ink, first), np.logical_or.reduceat(~own & ink, first)
        kept, both = np.where(named_g, ink_g, ink_n), in_g & in_n
        pair, place = key[first] // wide, key[first] % wide
        rows = starts_of(pair)
        low = np.minimum.reduceat(np.where(kept, place, wide), rows)[pair]
        high = np.maximum.reduceat(np.where(kept, place, -1), rows)[pair]
        return np.logical_and.reduceat(both, rows), np.logical_and.reduceat(both | (place < low) | (place > high), rows)

    def scores(self) -> tuple[np.ndarray, list[np.ndarray]]:
        """Documents with a gold span or a candidate without one, and their counts as in :func:`summary`."""
        exact, loose = self.lined_up()
        alike = (self.label[self.g] == self.label[self.n]) & (self.label[self.g] >= 0)
        count = lambda at, n: np.bincount(at, minlength=n)
        spans, docs = self.gold.size, len(self.doc_off) - 1
        met, ok = count(self.g, spans) > 0, count(self.g[(self.cells == self.same) & exact], spans) > 0
        mended = met & ~ok & (count(self.g[alike], spans) == 1) & (count(self.g[alike & loose], spans) > 0)
        extra = self.free & (count(self.n, spans) == 0)
        per = [count(self.doc[x], docs) for x in (self.gold, self.gold & ok, self.gold & met & ~ok, self.gold & ~met, self.gold & mended, extra)]
        return np.flatnonzero((per[0] > 0) | (per[-1] > 0)), per


def _by_document(docs: DataFrame, made: Callable[[pa.RecordBatch, _Part], list[pa.Array]], schema: str) -> DataFrame:
    most = CELLS

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            off, values = flat(batch["spans"])
            cells = flat(values.flatten()[3])[0][off]
            at = 0
            while at < batch.num_rows:
                to = min(max(int(np.searchsorted(cells, cells[at] + most, "right")) - 1, at + 1), batch.num_rows)
                part = batch.slice(at, to - at)
                arrays = made(part, _Part(part["spans"]))
                yield pa.RecordBatch.from_arrays(arrays, [c.split()[0] for c in schema.split(", ")])
                at = to

    return docs.select("doc_id", "spans").mapInArrow(run, schema)


def _types(docs: DataFrame) -> tuple[str, str]:
    return dict(docs.dtypes)["doc_id"], docs.schema["spans"].dataType.elementType["span_id"].dataType.simpleString()


def _keys(part: pa.RecordBatch, of: _Part) -> list[pa.Array]:
    return [part["doc_id"].take(pa.array(of.doc[of.g])), of.span_id.take(pa.array(of.g)), of.span_id.take(pa.array(of.n))]


def compared(docs: DataFrame) -> DataFrame:
    """:func:`comparison_table` of :func:`documents`."""
    doc, span = _types(docs)
    return _by_document(docs, lambda part, of: [*_keys(part, of), pa.array(of.cells.astype(np.int64)), pa.array(of.same)], f"doc_id {doc}, g {span}, n {span}, cells bigint, same bigint")


def matched(docs: DataFrame) -> DataFrame:
    """:func:`matches` of :func:`documents`, their cells :func:`aligned`."""
    doc, span = _types(docs)
    return _by_document(docs, lambda part, of: [*_keys(part, of), *map(pa.array, of.lined_up())], f"doc_id {doc}, g {span}, n {span}, exact boolean, loose boolean")


def scored(docs: DataFrame) -> DataFrame:
    """:func:`summary` of :func:`documents`."""

    def made(part: pa.RecordBatch, of: _Part) -> list[pa.Array]:
        at, counts = of.scores()
        return [part["doc_id"].take(pa.array(at)), *(pa.array(x[at].astype(np.int64)) for x in counts)]

    names = ("golds", "correct", "with_errors", "unmatched", "fixed", "extra")
    return _shares(_by_document(docs, made, f"doc_id {_types(docs)[0]}, " + ", ".join(f"{x} bigint" for x in names)))
