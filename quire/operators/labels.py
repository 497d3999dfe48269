"""BIOLU label spans over sequences: pins, extents, siblings, schemas and span trees.

A labelled sequence is a table of cells (keys, ``pos`` from 0) and one of spans (keys, ``label``,
``begin``, ``len``, ``ord``: the order in which they were put on, so later ones are inner). Pins are
derived from spans; a cell's stack has the innermost on top, index 0.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.operators.sequence import group_by_pairs

PIN_TYPE = "array<struct<pin:string,label:string>>"


def pin(pos: Column, begin: Column, length: Column) -> Column:
    """U for a span of one; else B first, L last, I between."""
    return F.when(length == 1, "U").when(pos == begin, "B").when(pos == begin + length - 1, "L").otherwise("I")


def pins(spans: DataFrame, keys: Sequence[str]) -> DataFrame:
    """A row for each cell under each span: ``pos``, ``pin``, ``label``, ``ord``, and where the span begins."""
    spread = spans.filter("len > 0").withColumn("pos", F.explode(F.expr("sequence(begin, begin + len - 1)")))
    return spread.select(*keys, "pos", pin(F.col("pos"), F.col("begin"), F.col("len")).alias("pin"), "label", "ord", "begin", "len")


def stacks(cells: DataFrame, spans: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Cells with their ``pins``, the innermost first."""
    item = F.struct((-F.col("ord")).alias("o"), "pin", "label")
    per = pins(spans, keys).groupBy(*keys, "pos").agg(F.transform(F.sort_array(F.collect_list(item)), lambda p: F.struct(p["pin"].alias("pin"), p["label"].alias("label"))).alias("pins"))
    return cells.join(per, [*keys, "pos"], "left").withColumn("pins", F.coalesce("pins", F.array().cast(PIN_TYPE)))


def has_label(stack: Column, label: str) -> Column:
    return F.exists(stack, lambda p: p["label"] == label)


def has_pin(stack: Column, pin_: str, label: str) -> Column:
    return F.exists(stack, lambda p: (p["label"] == label) & (p["pin"] == pin_))


def top_pin(stack: Column) -> Column:
    return F.get(stack, F.lit(0))


def top_label(stack: Column) -> Column:
    return top_pin(stack)["label"]


def find_pin(stack: Column, label: str) -> Column:
    return F.get(F.filter(stack, lambda p: p["label"] == label), F.lit(0))


def pop_to_label(stack: Column, label: str) -> Column:
    """Without the label and what lies within it, above it on the stack; unchanged if it isn't there."""
    at = F.array_position(F.transform(stack, lambda p: p["label"]), label)
    return F.when(at > 0, F.slice(stack, (at + 1).cast("int"), F.greatest(F.size(stack) - at.cast("int"), F.lit(0)))).otherwise(stack)


def extents(pinned: DataFrame, keys: Sequence[str]) -> DataFrame:
    """For every pin its span, found from the pins alone: the nearest B (or U) before and L (or U) after."""
    w = Window.partitionBy(*keys, "label").orderBy("pos")
    first = F.last(F.when(F.col("pin").isin("B", "U"), F.col("pos")), True).over(w.rowsBetween(Window.unboundedPreceding, 0))
    last = F.first(F.when(F.col("pin").isin("L", "U"), F.col("pos")), True).over(w.rowsBetween(0, Window.unboundedFollowing))
    return pinned.withColumn("begin", first).withColumn("len", last - first + 1)


def span_table(pinned: DataFrame, keys: Sequence[str]) -> DataFrame:
    """One row a span: label, begin, len."""
    return extents(pinned, keys).filter(F.col("pin").isin("B", "U")).select(*keys, "label", "begin", "len")


def unlabelled_extents(stacked: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Maximal runs of cells without pins."""
    bare = group_by_pairs(stacked.withColumn("bare", F.size("pins") == 0), keys, ["pos"], lambda p, c: p("bare") == c("bare"))
    return bare.filter("bare").groupBy(*keys, "grp").agg(F.min("pos").alias("begin"), F.count("*").alias("len")).drop("grp")


def sibling_runs(stacked: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Maximal runs of cells of equally labelled stacks."""
    named = stacked.withColumn("names", F.array_join(F.transform("pins", lambda p: p["label"]), "/"))
    runs = group_by_pairs(named, keys, ["pos"], lambda p, c: p("names") == c("names"))
    return runs.groupBy(*keys, "grp", "names").agg(F.min("pos").alias("begin"), F.count("*").alias("len")).drop("grp")


def unlabel_near(spans: DataFrame, keys: Sequence[str], at: Column, label: str) -> DataFrame:
    """Without the innermost span of a label around a place, and the spans within it put on later."""
    over = spans.filter((F.col("label") == label) & (F.col("begin") <= at) & (at < F.col("begin") + F.col("len")))
    gone = over.groupBy(*keys).agg(F.max_by(F.struct("begin", "len", "ord"), "ord").alias("g"))
    marked = spans.join(gone, list(keys), "left")
    g = F.col("g")
    inner = (F.col("ord") >= g["ord"]) & (F.col("begin") >= g["begin"]) & (F.col("begin") + F.col("len") <= g["begin"] + g["len"])
    return marked.filter(g.isNull() | ~inner).drop("g")


def parents(spans: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Every span with its parent's ``ord``: the nearest one put on before it that contains it."""
    c, p = spans.alias("c"), spans.alias("p")
    on = [F.col(f"c.{k}").eqNullSafe(F.col(f"p.{k}")) for k in keys] + [F.col("p.ord") < F.col("c.ord"), F.col("p.begin") <= F.col("c.begin"), F.expr("p.begin + p.len >= c.begin + c.len")]
    cond = on[0]
    for x in on[1:]:
        cond = cond & x
    up = c.join(p, cond, "left").groupBy(*[F.col(f"c.{k}").alias(k) for k in keys], F.col("c.label").alias("label"), F.col("c.begin").alias("begin"), F.col("c.len").alias("len"), F.col("c.ord").alias("ord"))
    return up.agg(F.max("p.ord").alias("parent"))


def depths(spans: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Every span with how many spans put on before it contain it."""
    c, p = spans.alias("c"), spans.alias("p")
    cond = (F.col("p.ord") < F.col("c.ord")) & (F.col("p.begin") <= F.col("c.begin")) & F.expr("p.begin + p.len >= c.begin + c.len")
    for k in keys:
        cond = cond & F.col(f"c.{k}").eqNullSafe(F.col(f"p.{k}"))
    return c.join(p, cond, "left").groupBy(*[F.col(f"c.{x}").alias(x) for x in [*keys, "label", "begin", "len", "ord"]]).agg(F.count("p.ord").alias("depth"))


def spans_json(spans: DataFrame, keys: Sequence[str]) -> DataFrame:
    """All spans of a key as one JSON text, outer before inner."""
    item = F.struct("ord", "label", "begin", "len")
    return spans.groupBy(*keys).agg(F.to_json(F.transform(F.sort_array(F.collect_list(item)), lambda s: F.struct(s["label"].alias("label"), s["begin"].alias("begin"), s["len"].alias("len")))).alias("json"))


def spans_from_json(texts: DataFrame, keys: Sequence[str], column: str = "json") -> DataFrame:
    """The spans again, ``ord`` by their place in the text."""
    read = F.from_json(column, "array<struct<label:string,begin:int,len:int>>", {"mode": "FAILFAST"})
    return texts.select(*keys, F.posexplode(read).alias("ord", "s")).select(*keys, "s.label", "s.begin", "s.len", "ord")


def counted(pinned: DataFrame, keys: Sequence[str]) -> DataFrame:
    return pinned.groupBy(*keys, "pin", "label").agg(F.count("*").alias("n"))


def printed(stacked: DataFrame, keys: Sequence[str], char: str = "char") -> DataFrame:
    """A line of the sequence's characters, and one of its innermost pins, ``.`` where there is none."""
    item = F.struct("pos", F.col(char).alias("c"), F.coalesce(top_pin(F.col("pins"))["pin"], F.lit(".")).alias("p"))
    rows = F.sort_array(F.collect_list(item))
    line = lambda f: F.array_join(F.transform(rows, f), "")
    return stacked.groupBy(*keys).agg(line(lambda r: r["c"]).alias("text"), line(lambda r: r["p"]).alias("pins"))


# --- schemas ----------------------------------------------------------------------------


def schema_table(spark, name: str, tree: dict) -> DataFrame:
    """Flattened label schema: ``schema, label, parent, depth, ord, abbrev``, from nested dicts."""
    rows: list[tuple] = []

    def walk(children: dict, parent: str | None, depth: int) -> None:
        for label, below in children.items():
            rows.append((name, label, parent, depth, len(rows), abbreviation(label)))
            walk(below, label, depth + 1)

    walk(tree, None, 0)
    return spark.createDataFrame(rows, "schema string, label string, parent string, depth int, ord int, abbrev string")


def abbreviation(label: str) -> str:
    """Two characters of a label: its capitals, then its other letters."""
    return ("".join(c for c in label if c.isupper()) + "".join(c for c in label if c.islower()))[:2]


HEADER_SCHEMA = {"HeaderLabels": {"Title": {}, "Abstract": {}, "Authors": {"Author": {"FirstName": {}, "MiddleName": {}, "LastName": {}}}, "Affiliations": {"Affiliation": {}, "Email": {}, "Address": {}}, "Keywords": {}}}
REFERENCE_SCHEMA = {"Authors": {"Author": {"FirstName": {}, "MiddleName": {}, "LastName": {}}}, "RefMarker": {"RefNumber": {}}, "Journal": {}, "Title": {}}


def top_labels(schema: DataFrame) -> DataFrame:
    return schema.filter("parent IS NULL").orderBy("ord")


def child_labels(schema: DataFrame, label: str) -> DataFrame:
    return schema.filter(F.col("parent") == label).orderBy("ord")
