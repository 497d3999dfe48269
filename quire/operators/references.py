"""Reference blocks: cutting a column of references into entries and checking their markers."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quire.functions.arrays import flat
from quire.operators.cluster import nearest_bins
from quire.operators.sequence import group_by_pairs

BLOCK = ("doc_id", "page", "block")


def leftmost(glyphs: DataFrame, zones: DataFrame, shift: int = 400) -> DataFrame:
    """The leftmost glyph of each line within the left half of a zone (``zl, zt, zw, zh``), widened by ``shift`` to the left."""
    inside = glyphs.join(zones, ["doc_id", "page"]).filter((F.col("l") >= F.col("zl") - shift) & (F.col("l") < F.col("zl") + F.col("zw") / 2) & (F.col("t") >= F.col("zt")) & (F.col("t") + F.col("h") <= F.col("zt") + F.col("zh")))
    first = F.struct("l", "item_id", "t", "char")
    return inside.groupBy(*BLOCK, "line").agg(F.min(first).alias("f")).select(*BLOCK, "line", "f.*")


def hanging(lines: DataFrame, tolerance: int = 100) -> DataFrame:
    """Entries of a hanging indent: one begins at each line as far left as any (within the tolerance); ``top`` and ``height`` to the next one, the last to the zone's end (``bottom``)."""
    w = Window.partitionBy(*BLOCK)
    starts = lines.withColumn("edge", F.min("l").over(w)).filter(F.col("l") <= F.col("edge") + tolerance)
    order = w.orderBy("t", "line")
    return starts.select(*BLOCK, F.row_number().over(order).alias("entry"), F.col("t").alias("top"), (F.coalesce(F.lead("t").over(order), F.col("bottom")) - F.col("t")).alias("height"))


def justified(lines: DataFrame, tolerance: float = 1.0) -> DataFrame:
    """Lines of unindented entries with ``entry``: a new one where the step down is over the threshold, which lies between the two commonest steps (a tenth more than their mean)."""
    w = Window.partitionBy(*BLOCK)
    order = w.orderBy("t", "line")
    stepped = lines.withColumn("__step", F.col("t") - F.lag("t").over(order))
    # of a block only the different steps and their counts are looked at, many blocks a call
    counts = stepped.groupBy(*BLOCK, "__step").agg(F.count("*").alias("__n")).groupBy(*BLOCK).agg(F.collect_list(F.struct("__step", "__n")).alias("__steps"))
    kinds = dict(lines.dtypes)

    def limits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[tuple, float | None] = {}
        for batch in batches:
            off, values = flat(batch["__steps"])
            step, n = (x.to_pylist() for x in values.flatten())
            out = []
            for i, j in zip(off[:-1].tolist(), off[1:].tolist(), strict=True):
                steps = tuple(sorted((s, c) for s, c in zip(step[i:j], n[i:j], strict=True) if s is not None))
                if steps not in known:
                    if len(known) > 100_000:
                        known.clear()
                    known[steps] = step_limit(steps, tolerance)
                out.append(known[steps])
            yield pa.RecordBatch.from_arrays([*(batch[k] for k in BLOCK), pa.array(out, pa.float64())], [*BLOCK, "__limit"])

    limit = counts.mapInArrow(limits, ", ".join(f"{k} {kinds[k]}" for k in BLOCK) + ", __limit double")
    parted = stepped.join(limit, list(BLOCK)).withColumn("__new", F.coalesce((F.col("__step") > F.col("__limit")).cast("int"), F.lit(0)))
    return parted.withColumn("entry", F.sum("__new").over(order.rowsBetween(Window.unboundedPreceding, 0)).cast("int")).select(*lines.columns, "entry")


def step_limit(steps: Sequence[tuple[int, int]], tolerance: float) -> float | None:
    """The threshold of (step, count) pairs; none if all steps are alike."""
    bins = nearest_bins(steps, tolerance)
    if len(bins) < 2:
        return None
    spans = sorted((min([h[0], *(v for v, _ in n)]), max([h[0], *(v for v, _ in n)])) for h, n in bins[:2])
    return (spans[0][1] + spans[1][0]) / 2 + 10


def kept(entries: DataFrame, labelled: DataFrame, least: int = 2) -> DataFrame:
    """Without the entries already labelled, and those of at most ``least`` characters."""
    return entries.filter(F.length(F.trim("text")) > least).join(labelled, ["doc_id", "entry"], "left_anti")


def markers(entries: DataFrame) -> DataFrame:
    """The kind and value of each entry's marker: ``[n]``, ``n.``, or the first word."""
    text = F.ltrim("text")
    bracket, number, word = F.regexp_extract(text, r"^\[(\d{1,9})\]", 1), F.regexp_extract(text, r"^(\d{1,9})[.)\s]", 1), F.regexp_extract(text, r"^(\p{L}[\p{L}'’-]*)", 1)
    kind = F.when(bracket != "", "bracket").when(number != "", "number").when(word != "", "alpha")
    return entries.withColumn("kind", kind).withColumn("number", F.when(F.col("kind") == "bracket", bracket).when(F.col("kind") == "number", number).cast("int")).withColumn("word", F.when(F.col("kind") == "alpha", F.lower(word)))


def checked(entries: DataFrame) -> DataFrame:
    """Whether a document's entries have markers of one kind that go up: numbers one by one, names not backwards (a step back of one letter is let pass)."""
    w = Window.partitionBy("doc_id").orderBy("entry")
    m = markers(entries).withColumn("step", F.col("number") - F.lag("number").over(w)).withColumn("back", F.ascii(F.lag("word").over(w)) - F.ascii("word"))
    return m.groupBy("doc_id").agg((F.countDistinct(F.coalesce("kind", F.lit(""))) == 1).alias("one_kind"), F.every(F.coalesce(F.col("step") == 1, F.lit(True))).alias("numbers_rise"), F.every(F.coalesce(F.col("back") <= 1, F.lit(True))).alias("names_rise"), F.count("*").alias("n"))


def by_gap(lines: DataFrame, limit: int) -> DataFrame:
    """Entries parted where lines are further apart than a given limit."""
    return group_by_pairs(lines, BLOCK, ["t", "line"], lambda p, c: c("t") - p("t") <= limit, "entry")
