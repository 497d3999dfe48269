"""Aggregations: bounds, modes, marginals, pivots, ordered pages and collection algebra."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.functions.geometry import Box


def union_bounds(df: DataFrame, keys: Sequence[str], box: Box | None = None) -> DataFrame:
    """MBR of all boxes of each key, as ``l, t, w, h``."""
    b = box or Box.of()
    edges = df.groupBy(*keys).agg(F.min(b.left).alias("l"), F.min(b.top).alias("t"), F.max(b.right).alias("__r"), F.max(b.bottom).alias("__b"))
    return edges.select(*keys, "l", "t", (F.col("__r") - F.col("l")).alias("w"), (F.col("__b") - F.col("t")).alias("h"))


def most_common(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """The commonest value of each key and its count; the least of equally common ones."""
    counts = df.groupBy(*keys, value).agg(F.count("*").alias("n"))
    best = F.min_by(F.struct(F.col(value).alias("v"), F.col("n").alias("n")), F.struct(-F.col("n"), F.col(value)))
    return counts.groupBy(*keys).agg(best.alias("b")).select(*keys, F.col("b.v").alias(value), F.col("b.n").alias("n"))


def offset_of_commonest(df: DataFrame, keys: Sequence[str], char: str, offset: str, order: str) -> DataFrame:
    """The offset at the first place of the key's commonest character (the first in order of equals)."""
    per = df.groupBy(*keys, char).agg(F.count("*").alias("n"), F.min_by(offset, order).alias("o"))
    return per.groupBy(*keys).agg(F.min_by("o", F.struct(-F.col("n"), F.col(char))).alias("offset"))


def table(df: DataFrame, row: str, col: str, value: Column, fold: Callable[[Column], Column]) -> DataFrame:
    """A sparse table ``r, c, a``: one folded value for each row and column that has any."""
    return df.groupBy(F.col(row).alias("r"), F.col(col).alias("c")).agg(fold(value).alias("a"))


def put(cells: DataFrame, changes: DataFrame) -> DataFrame:
    """Cells with those of ``changes`` set."""
    return cells.join(changes, ["r", "c"], "left_anti").unionByName(changes)


def modify(cells: DataFrame, changes: DataFrame, merge: Callable[[Column, Column], Column]) -> DataFrame:
    """Cells with ``merge(old, new)`` where both have one; a cell that is new is set."""
    both = cells.withColumnRenamed("a", "old").join(changes.withColumnRenamed("a", "new"), ["r", "c"], "full_outer")
    return both.select("r", "c", F.when(F.col("old").isNull(), F.col("new")).when(F.col("new").isNull(), F.col("old")).otherwise(merge(F.col("old"), F.col("new"))).alias("a"))


def row_marginals(cells: DataFrame, fold: Callable[[Column], Column] = F.sum) -> DataFrame:
    return cells.groupBy("r").agg(fold(F.col("a")).alias("a"))


def column_marginals(cells: DataFrame, fold: Callable[[Column], Column] = F.sum) -> DataFrame:
    return cells.groupBy("c").agg(fold(F.col("a")).alias("a"))


def marginals(cells: DataFrame, fold: Callable[[Column], Column] = F.sum) -> DataFrame:
    """Both marginals of one pass; the other key is null."""
    return cells.groupingSets([["r"], ["c"]], "r", "c").agg(fold(F.col("a")).alias("a"))


def pivoted(cells: DataFrame, columns: Sequence, total: str | None = None, fill=0) -> DataFrame:
    """One row a row key, one column a column key, gaps filled, and the row's sum if ``total`` names it."""
    wide = cells.groupBy("r").pivot("c", list(columns)).agg(F.first("a")).na.fill(fill)
    return wide.withColumn(total, sum((F.col(f"`{c}`") for c in columns), F.lit(0))) if total else wide


def zero_kept_counts(df: DataFrame, key: str, values: Sequence[str], where: Column | None = None) -> DataFrame:
    """A count for each of the given values, 0 included."""
    dim = df.sparkSession.createDataFrame([(v,) for v in values], f"{key} string")
    found = (df if where is None else df.filter(where)).groupBy(key).agg(F.count("*").alias("n"))
    return F.broadcast(dim).join(found, key, "left").select(key, F.coalesce("n", F.lit(0)).alias("n"))


def page_of(df: DataFrame, order: Sequence[str | Column], take: int = 0, skip: int = 0) -> DataFrame:
    """``take`` rows (0: all) after the first ``skip``, in a total order."""
    df = df.orderBy(*order)
    df = df.offset(skip) if skip else df
    return df.limit(take) if take else df


def top_k(df: DataFrame, keys: Sequence[str], order: Sequence[str | Column], k: int) -> DataFrame:
    """The first k rows of each key; Spark cuts every partition to k before the shuffle."""
    n = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn("rank", n).filter(F.col("rank") <= k)


def listing(docs: DataFrame, annotations: DataFrame, key: str, label: str, take: int = 100, skip: int = 0) -> DataFrame:
    """Documents of a page with how many labels they have, and which."""
    counts = annotations.groupBy(key).agg(F.count(label).alias("n_labels"), F.sort_array(F.collect_set(label)).alias("labels"))
    page = page_of(docs.select(key), [key], take, skip)
    return page.join(counts, key, "left").select(key, F.coalesce("n_labels", F.lit(0)).alias("n_labels"), F.coalesce("labels", F.array().cast("array<string>")).alias("labels"))


def zip_all(left: DataFrame, right: DataFrame, keys: Sequence[str], at: str) -> DataFrame:
    """Both sides' values of the same place, null where one is shorter."""
    return left.join(right, [*keys, at], "full_outer")


# --- fonts ------------------------------------------------------------------------------

COMMON_LETTERS = "etaoinshrdlu"
BIGRAMS = "al an ar as at be ce ch co de ea ed en er es ha he hi ic in io is it le li ll ma me nd ne ng nt of om on or ou ra re ri ro se si st te th ti to ur ve".split()
TRIGRAMS = "ain all and are ate ati com con cti ear ect ent ere ers ess est eve for hat her his ica ing int ion ist iti ith ive men nce not one ons our per pro rat rea res sta ted ter tha the thi tio ver was wit".split()
LIGATURES = ["ﬀ", "ﬁ", "ﬂ", "ﬃ", "ﬄ", "Æ", "æ", "Œ", "œ"]


def font_evidence(glyphs: DataFrame, keys: Sequence[str] = ("font",), order: Sequence[str] = ("doc_id", "item_id")) -> DataFrame:
    """Per font: common bigrams and trigrams of following glyphs, ligatures, and a count of each frequent letter."""
    w = Window.partitionBy(*keys, order[0]).orderBy(*order)
    c = F.lower("char")
    pairs = glyphs.withColumn("bi", F.concat(F.lag(c).over(w), c)).withColumn("tri", F.concat(F.lag(c, 2).over(w), F.lag(c).over(w), c))
    letters = [F.count_if(c == x).alias(f"n_{x}") for x in COMMON_LETTERS]
    return pairs.groupBy(*keys).agg(F.count_if(F.col("bi").isin(BIGRAMS)).alias("bigrams"), F.count_if(F.col("tri").isin(TRIGRAMS)).alias("trigrams"), F.count_if(F.col("char").isin(LIGATURES)).alias("ligatures"), *letters)


def is_text_font(evidence: DataFrame) -> DataFrame:
    """Whether a font sets natural language: enough frequent letters, or common n-grams, or a ligature."""
    kinds = sum(((F.col(f"n_{x}") > 0).cast("int") for x in COMMON_LETTERS), F.lit(0))
    return evidence.withColumn("text_font", (kinds >= 5) | (F.col("bigrams") > 2) | (F.col("trigrams") > 2) | (F.col("ligatures") > 0))


def glyphs_per_page(glyphs: DataFrame, keys: Sequence[str] = ("font", "page")) -> DataFrame:
    return glyphs.groupBy(*keys).agg(F.count("*").alias("n"))


def letters_by_height(glyphs: DataFrame, keys: Sequence[str], height: str = "h") -> DataFrame:
    """The letters of each height, sorted, as one string."""
    return glyphs.groupBy(*keys, height).agg(F.array_join(F.sort_array(F.collect_set("char")), "").alias("letters"))


def scaled_metrics(glyphs: DataFrame, keys: Sequence[str], height: str = "h") -> DataFrame:
    """Per font and scale the height of the first capital, midrise, ascending and descending letter by character."""
    first = lambda chars: F.min_by(height, F.when(F.col("char").isin(list(chars)), F.col("char")))
    return glyphs.groupBy(*keys).agg(first("ABCDEFGHIJKLMNOPQRSTUVWXYZ").alias("cap"), first("acemnorsuvwxz").alias("midrise"), first("bdfhklt").alias("ascent"), first("gjpqy").alias("descent"))


def fonts_by_use(glyphs: DataFrame) -> DataFrame:
    """Fonts of each document, the most used first, ties by name."""
    counts = glyphs.groupBy("doc_id", "font").agg(F.count("*").alias("n"))
    return counts.withColumn("rank", F.row_number().over(Window.partitionBy("doc_id").orderBy(F.desc("n"), "font")))
