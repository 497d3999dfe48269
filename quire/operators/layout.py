"""From glyphs to text: runs, font metrics, lines, columns, blocks, words, shapes of line pairs.

A glyphs table has ``doc_id, page, item_id`` (extraction order), ``char, font``, the glyph box
``l, t, w, h`` and the bottom ``fb`` of its font box. Pages are independent, so everything is keyed by
document and page; steps that consume glyphs as they go are one pandas call a page.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.functions.arrays import characters, packed, starts_of
from quire.functions.geometry import Box, Line, Trapezoid, angle_class
from quire.operators.aggregates import most_common, union_bounds
from quire.operators.cluster import nearest_bins, sparse_histogram
from quire.operators.sequence import group_by_pairs

PAGE = ("doc_id", "page")
#: Text handled at once by a kernel; a longer line is handled alone.
TEXT_BYTES = 1 << 21


# --- glyphs -----------------------------------------------------------------------------


def accepted(glyphs: DataFrame, cap: int = 10_000) -> DataFrame:
    """Glyphs that are shown: no control characters or blanks, within the page (``pw, ph``), not rotated; a page of over ``cap`` is an error when read."""
    ok = glyphs.filter((F.ascii("char") > 32) & (F.ascii("char") != 160) & (F.col("l") >= 0) & (F.col("t") >= 0) & (F.col("l") + F.col("w") <= F.col("pw")) & (F.col("t") + F.col("h") <= F.col("ph")))
    n = F.count("*").over(Window.partitionBy(*PAGE))
    ok = ok.withColumn("__n", n).filter(F.when(F.col("__n") <= cap, True).otherwise(F.raise_error(F.lit("too many glyphs on a page"))))
    return ok.filter("rotation = 0").drop("__n")


def with_similar(glyphs: DataFrame) -> DataFrame:
    """``prev_similar``: the glyph before, if it is of the same font, scale, rotation and baseline and reading goes on."""
    w = Window.partitionBy(*PAGE).orderBy("item_id")
    p = lambda c: F.lag(c).over(w)
    same = (p("font") == F.col("font")) & (p("scale") == F.col("scale")) & (p("rotation") == F.col("rotation"))
    on = F.when(F.col("rotation").isin(0, 180), p("fb") == F.col("fb")).otherwise(p("l") == F.col("l"))
    ahead = F.when(F.col("rotation") == 180, p("l") > F.col("l")).when(F.col("rotation") == 0, p("l") < F.col("l")).otherwise(F.lit(True))
    return glyphs.withColumn("prev_similar", F.when(same & on & ahead, p("item_id")))


def substituted(glyphs: DataFrame, table: DataFrame) -> DataFrame:
    """Characters by a substitution table (``char, to``), which may give several; surrogates become a mark with their code."""
    joined = glyphs.join(F.broadcast(table), "char", "left")
    return joined.withColumn("char", F.coalesce("to", "char")).drop("to")


# --- runs and fonts ---------------------------------------------------------------------


def text_runs(glyphs: DataFrame) -> DataFrame:
    """Glyphs with ``run``: each goes on from the glyph it is similar to."""
    return group_by_pairs(glyphs, PAGE, ["item_id"], lambda p, c: c("prev_similar") == p("item_id"), "run")


def symbol_runs(glyphs: DataFrame) -> DataFrame:
    """Runs of following ids to the right of each other on one level."""
    level = lambda p, c: (p("t") + p("h") >= c("t")) & (c("t") + c("h") >= p("t"))
    return group_by_pairs(glyphs, PAGE, ["item_id"], lambda p, c: (p("item_id") == c("item_id") - 1) & (p("l") < c("l")) & level(p, c), "run")


def baselines(runs: DataFrame) -> DataFrame:
    """One line a run, from its leftmost glyph to its last one's right edge, at the font's bottom."""
    return runs.groupBy(*PAGE, "run").agg(F.min("l").alias("x1"), F.min_by("fb", "l").alias("y1"), F.max_by(F.col("l") + F.col("w"), "item_id").alias("x2"), F.max_by("fb", "item_id").alias("y2"), F.min("item_id").alias("first_id"), F.count("*").alias("n"), F.min_by("font", "item_id").alias("font"))


def clear_of(lines: DataFrame, regions: DataFrame) -> DataFrame:
    """Baselines that no region (images) meets."""
    from quire.operators.spatial import semi_range_join

    box = lines.select("*", F.col("x1").alias("al"), F.least("y1", "y2").alias("at"), (F.col("x2") - F.col("x1")).alias("aw"), F.abs(F.col("y2") - F.col("y1")).alias("ah"))
    hit = regions.select(*PAGE, F.col("l").alias("bl"), F.col("t").alias("bt"), F.col("w").alias("bw"), F.col("h").alias("bh"))
    return semi_range_join(box, hit, PAGE, [*PAGE, "run"], anti=True).drop("al", "at", "aw", "ah")


def font_metrics(runs: DataFrame) -> DataFrame:
    """Offsets above the baseline of each font: top of capitals, ascenders and midrise letters, depth of descenders, with fallbacks from the top."""
    kind = lambda chars, x: F.min_by(x, F.when(F.col("char").isin(list(chars)), F.struct("char", "item_id")))
    up, down = F.col("fb") - F.col("t"), F.col("t") + F.col("h") - F.col("fb")
    m = runs.groupBy("doc_id", "font").agg(F.max(up).alias("top"), kind("ABCDEFGHIJKLMNOPQRSTUVWXYZ", up).alias("cap"), kind("bdfhklt", up).alias("ascent"), kind("acemnorsuvwxz", up).alias("midrise"), kind("gjpqy", down).alias("descent"), F.max(down).alias("bottom"))
    return m.select("doc_id", "font", "top", F.coalesce("cap", "top").alias("cap"), F.coalesce("ascent", "top").alias("ascent"), F.coalesce("midrise", (F.col("top") * 0.77).cast("int")).alias("midrise"), F.coalesce("descent", (F.col("top") * 0.23).cast("int")).alias("descent"), "bottom")


def name_variants(font: Column) -> Column:
    """A subset tag before ``+`` and a style after ``,`` may be left out: all names of a font."""
    return F.array_distinct(F.array(font, F.regexp_extract(font, r"^(?:.*\+)?(.*)$", 1), F.regexp_extract(font, r"^([^,]*)", 1), F.regexp_extract(font, r"^(?:.*\+)?([^,]*)", 1)))


def borrowed_metrics(symbolic: DataFrame, metrics: DataFrame) -> DataFrame:
    """Symbol fonts (``doc_id, font``) with the metrics of the first text font that shares a name variant."""
    a = symbolic.select("doc_id", "font", F.explode(name_variants(F.col("font"))).alias("v"))
    b = metrics.select("doc_id", F.col("font").alias("from_font"), F.explode(name_variants(F.col("font"))).alias("v"), *[c for c in metrics.columns if c not in ("doc_id", "font")])
    first = F.row_number().over(Window.partitionBy("doc_id", "font").orderBy("from_font"))
    return a.join(b, ["doc_id", "v"]).drop("v").distinct().withColumn("__n", first).filter("__n = 1").drop("__n")


def run_widths(runs: DataFrame) -> DataFrame:
    """Per page the commonest font, and its runs' widths."""
    top = most_common(runs, PAGE, "font").select(*PAGE, "font")
    boxes = union_bounds(runs.join(top, [*PAGE, "font"]), [*PAGE, "run", "font"])
    return boxes.groupBy(*PAGE, "font", "w").agg(F.count("*").alias("n"))


def line_spacings(lines: DataFrame, nearest: int = 2) -> DataFrame:
    """For every line the distances to the nearest ones below that it overlaps sideways."""
    a, b = lines.alias("a"), lines.alias("b")
    below = (F.col("b.t") > F.col("a.t")) & (F.col("a.l") < F.col("b.l") + F.col("b.w")) & (F.col("b.l") < F.col("a.l") + F.col("a.w"))
    on = below & (F.col("a.doc_id") == F.col("b.doc_id")) & (F.col("a.page") == F.col("b.page"))
    pairs = a.join(b, on).select(F.col("a.doc_id").alias("doc_id"), F.col("a.page").alias("page"), F.col("a.line").alias("line"), F.col("b.line").alias("below"), F.expr("b.t - a.t").alias("gap"))
    n = F.row_number().over(Window.partitionBy(*PAGE, "line").orderBy("gap", "below"))
    return pairs.withColumn("nth", n).filter(F.col("nth") <= nearest)


# --- lines ------------------------------------------------------------------------------

LINE_SCHEMA = "doc_id bigint, page int, line int, item_id bigint, char string, l int, t int, w int, h int, font string, primary_font string"


def text_lines(runs: DataFrame, metrics: DataFrame) -> DataFrame:
    """Every glyph with its line. Fonts are taken by use on the page, each run of a font opens its band
    from ascent to descent, and the glyphs in it that follow on from the run's are its line, unless
    their order by id and from left to right differ while more than one group is in the band."""
    m = runs.join(metrics.select("doc_id", "font", "ascent", "descent"), ["doc_id", "font"], "left").fillna(0, ["ascent", "descent"])

    def page(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("item_id").reset_index(drop=True)
        names, font = np.unique(part["font"].to_numpy(object), return_inverse=True)
        line = fold_lines(part["item_id"].to_numpy(), font, *(part[c].to_numpy() for c in ("run", "l", "t", "h", "fb", "ascent", "descent")))
        part, font, line = part[line >= 0], font[line >= 0], line[line >= 0]
        used = np.zeros((int(line.max()) + 1, names.size), np.int64)
        np.add.at(used, (line, font), 1)
        order = np.argsort(line, kind="stable")
        lines = part.assign(line=line, primary_font=names[used.argmax(1)][line]).iloc[order]
        return lines[[c.split()[0] for c in LINE_SCHEMA.split(", ")]]

    return m.groupBy(*PAGE).applyInPandas(page, LINE_SCHEMA)


def fold_lines(item: np.ndarray, font: np.ndarray, run: np.ndarray, l: np.ndarray, t: np.ndarray, h: np.ndarray, fb: np.ndarray, ascent: np.ndarray, descent: np.ndarray) -> np.ndarray:  # noqa: E741
    """The line of each glyph of a page, as :func:`text_lines` finds it, glyphs by id and fonts numbered by name.

    What a run has left beyond a gap in the ids when its line is taken is in no line: -1. Following glyphs of one height and place are taken as one piece, so a line costs as many steps as it has pieces."""
    n = item.size
    used = np.bincount(font)
    rank = np.empty(used.size, np.int64)
    rank[np.lexsort((np.arange(used.size), -used))] = np.arange(used.size)
    order = np.lexsort((run, rank[font]))
    cut = np.ones(n + 1, bool)
    cut[1:n] = (run[order][1:] != run[order][:-1]) | (font[order][1:] != font[order][:-1])
    edge = np.flatnonzero(cut)
    firsts, lasts, edge = order[edge[:-1]].tolist(), order[edge[1:] - 1].tolist(), edge.tolist()
    follows = np.zeros(n, bool)
    follows[1:] = np.diff(item) == 1
    piece = np.ones(n, bool)
    piece[1:] = ~(follows[1:] & (t[1:] == t[:-1]) & (h[1:] == h[:-1]))
    begin = np.flatnonzero(piece)
    of, tops, bottoms = (np.cumsum(piece) - 1).tolist(), t[begin], (t + h)[begin]
    left = np.diff(np.append(begin, n))
    joined, high, low = follows[begin].tolist(), tops.tolist(), bottoms.tolist()
    begin = [*begin.tolist(), n]
    fall = np.concatenate([np.zeros(1, np.int64), np.cumsum(l[1:] < l[:-1])]).tolist()
    up, down = (fb - ascent).tolist(), (fb + descent).tolist()
    free, line, number = bytearray(b"\1" * n), np.full(n, -1), 0
    for k, (first, last) in enumerate(zip(firsts, lasts, strict=True)):
        whole = last - first + 1 == edge[k + 1] - edge[k]
        own = range(first, last + 1) if whole else order[edge[k] : edge[k + 1]].tolist()
        root = free.find(1, first, last + 1) if whole else next((i for i in own if free[i]), -1)
        if root < 0:
            continue
        top, bottom, s, taken = up[root], down[root], of[root], None
        if high[s] <= bottom and low[s] >= top:
            least, most = free.rfind(0, 0, root) + 1, free.find(0, root)
            most, e = n if most < 0 else most, s
            while begin[s] > least and joined[s] and high[s - 1] <= bottom and low[s - 1] >= top:
                s -= 1
            while begin[e + 1] < most and joined[e + 1] and high[e + 1] <= bottom and low[e + 1] >= top:
                e += 1
            a, b = max(begin[s], least), min(begin[e + 1], most)
            # others in the band make more groups than one
            if fall[b - 1] == fall[a] or left[(tops <= bottom) & (bottoms >= top)].sum() == b - a:
                taken = range(a, b)
        if taken is None:
            taken = [i for i in own if free[i]]
            for i in taken:
                free[i] = 0
                left[of[i]] -= 1
            line[taken] = number
        else:
            free[a:b], line[a:b] = bytes(b - a), number
            for i in range(s, e + 1):
                left[i] -= min(begin[i + 1], b) - max(begin[i], a)
        number += 1
    return line


def line_boxes(lined: DataFrame) -> DataFrame:
    boxes = union_bounds(lined, [*PAGE, "line"])
    return boxes.join(lined.groupBy(*PAGE, "line").agg(F.min("item_id").alias("first_id"), F.max("item_id").alias("last_id"), F.count("*").alias("n")), [*PAGE, "line"])


def font_ranges(lined: DataFrame) -> DataFrame:
    """Runs of one font along each line: font, begin, len."""
    keys = [*PAGE, "line"]
    placed = lined.withColumn("pos", F.row_number().over(Window.partitionBy(*keys).orderBy("l", "item_id")) - 1)
    runs = group_by_pairs(placed, keys, ["pos"], lambda p, c: p("font") == c("font"))
    return runs.groupBy(*keys, "grp", "font").agg(F.min("pos").alias("begin"), F.count("*").alias("len")).drop("grp")


def scripts(lined: DataFrame, metrics: DataFrame) -> DataFrame:
    """Glyphs of another font than their line's, set off from its middle band, as ``Sup`` or ``Sub`` spans: begin, len, label."""
    keys = [*PAGE, "line"]
    base = metrics.select("doc_id", F.col("font").alias("primary_font"), "midrise")
    w = Window.partitionBy(*keys)
    main = lined.withColumn("bottom", F.max(F.when(F.col("font") == F.col("primary_font"), F.col("t") + F.col("h"))).over(w)).withColumn("top", F.min(F.when(F.col("font") == F.col("primary_font"), F.col("t"))).over(w)).join(base, ["doc_id", "primary_font"], "left")
    middle = F.col("bottom") - F.coalesce("midrise", (F.col("bottom") - F.col("top"))) / 2
    other = F.col("font") != F.col("primary_font")
    script = F.when(other & (F.col("t") + F.col("h") <= middle), "Sup").when(other & (F.col("t") >= middle), "Sub")
    placed = main.withColumn("script", script).withColumn("pos", F.row_number().over(Window.partitionBy(*keys).orderBy("l", "item_id")) - 1)
    runs = group_by_pairs(placed, keys, ["pos"], lambda p, c: p("script").eqNullSafe(c("script")))
    return runs.filter("script IS NOT NULL").groupBy(*keys, "grp", F.col("script").alias("label")).agg(F.min("pos").alias("begin"), F.count("*").alias("len")).drop("grp")


def clip_between(box: Box, x1: Column, x2: Column) -> Column:
    return box.vertical_slice(x1, x2 - x1)


# --- text -------------------------------------------------------------------------------


def word_gap(gaps: Sequence[int], widest: int, tolerance: float = 0.5) -> int:
    """The least gap that parts words: the widest glyph if gaps are all alike; else half-way from the largest usual gap to the commonest one of over twice that, or a unit more than the usual."""
    values, n = np.unique(np.asarray(gaps, np.int64), return_counts=True)
    return least_gap(list(zip(values.tolist(), n.tolist(), strict=True)), widest, tolerance) if values.size else 0


def least_gap(counts: Sequence[tuple[int, int]], widest: int, tolerance: float = 0.5) -> int:
    """:func:`word_gap` of different gaps and how often there are."""
    bins = nearest_bins(counts, tolerance)
    if len(bins) == 1:
        return int(widest)
    head, near = bins[0]
    usual = max([head[0], *(v for v, _ in near)])
    wider = [h[0] for h, _ in bins if h[0] > 2 * usual]
    return int((usual + wider[0]) / 2) if wider else usual + 100


def line_texts(lined: DataFrame, spans: DataFrame | None = None) -> DataFrame:
    """The text of each line: words parted at wide gaps, scripts as ``^{..}`` and ``_{..}``, lines by their first id."""
    keys = [*PAGE, "line"]
    order = Window.partitionBy(*keys).orderBy("l", "item_id")
    placed = lined.withColumn("pos", F.row_number().over(order) - 1).withColumn("gap", F.coalesce(F.lead("l").over(order) - F.col("l") - F.col("w"), F.lit(0)))
    if spans is None:
        marked = placed.withColumn("mark", F.lit(None).cast("string")).withColumn("sb", F.lit(0)).withColumn("se", F.lit(0))
    else:
        s = spans.select(*keys, F.col("label").alias("mark"), F.col("begin").alias("sb"), (F.col("begin") + F.col("len") - 1).alias("se")).alias("s")
        p = placed.alias("p")
        on = F.expr("p.doc_id = s.doc_id AND p.page = s.page AND p.line = s.line AND p.pos BETWEEN s.sb AND s.se")
        marked = p.join(s, on, "left").select("p.*", "mark", "sb", "se")

    def write(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("pos")
        least, text, right = word_gap(part["gap"].tolist(), part["w"].max()), "", None
        for r in part.itertuples():
            if right is not None and r.l - right >= least:
                text += " "
            if isinstance(r.mark, str) and r.pos == r.sb:
                text += "^{" if r.mark == "Sup" else "_{"
            text += r.char
            if isinstance(r.mark, str) and r.pos == r.se:
                text += "}"
            right = r.l + r.w
        return pd.DataFrame({"doc_id": [part["doc_id"].iloc[0]], "page": [part["page"].iloc[0]], "line": [part["line"].iloc[0]], "first_id": [part["item_id"].min()], "text": [text]})

    return marked.groupBy(*keys).applyInPandas(write, "doc_id bigint, page int, line int, first_id bigint, text string")


def page_texts(texts: DataFrame, clip: DataFrame | None = None) -> DataFrame:
    rows = F.sort_array(F.collect_list(F.struct("first_id", "text")))
    chosen = texts if clip is None else texts.join(clip, [*PAGE, "line"], "left_semi")
    return chosen.groupBy(*PAGE).agg(F.array_join(F.transform(rows, lambda r: r["text"]), "\n").alias("text"))


# --- columns and blocks -----------------------------------------------------------------


def column_candidates(lines: DataFrame, page_right: Column, left: bool = True, width: float = 1.4) -> DataFrame:
    """Buckets of line starts (or ends) with over one point, that end before the page does: edge, points, first and last y."""
    x = F.col("l") if left else F.col("l") + F.col("w")
    at = lines.withColumn("x", x / 100.0).withColumn("y", F.col("t") + F.col("h"))
    bins = sparse_histogram(at, PAGE, "x", width, "bucket").filter("n > 1")
    bins = bins.filter(((F.col("bucket") + 1) * width * 100) < page_right)
    hits = at.withColumn("bucket", F.floor(F.col("x") / F.lit(width))).join(bins, [*PAGE, "bucket"])
    return hits.groupBy(*PAGE, "bucket").agg(F.countDistinct("y").alias("points"), F.min("y").alias("top"), F.max("y").alias("bottom")).filter("points > 1")


def column_clusters(lines: DataFrame, columns: DataFrame, left: bool = True, width: float = 1.4) -> DataFrame:
    """Runs of over one line, down a column's band, that don't cross its edge; and each line's jump from the one above."""
    edge = columns.select(*PAGE, "bucket", "top", "bottom", (F.col("bucket") * width * 100).alias("lo"), ((F.col("bucket") + 1) * width * 100).alias("hi"))
    y, right = F.col("t") + F.col("h"), F.col("l") + F.col("w")
    rows = lines.join(edge, list(PAGE)).withColumn("y", y).filter(F.col("y").between(F.col("top"), F.col("bottom")) & (F.col("l") <= F.col("hi")) & (right >= F.col("lo")))
    rows = rows.withColumn("inside", (F.col("l") >= F.col("lo")) if left else (right <= F.col("hi")))
    keys = [*PAGE, "bucket"]
    runs = group_by_pairs(rows, keys, ["y", "line"], lambda p, c: p("inside") == c("inside"))
    w = Window.partitionBy(*keys, "grp")
    return runs.withColumn("size", F.count("*").over(w)).filter("inside AND size > 1").withColumn("jump", F.col("y") - F.lag("y").over(w.orderBy("y", "line")))


def blocks(lines: DataFrame, epsilon: int = 500) -> DataFrame:
    """Lines with ``block``: a line goes on from the one before if its ids follow, it stands lower, near it, and they overlap sideways."""
    follows = lambda p, c: (p("last_id") + 1 == c("first_id")) & (p("t") + p("h") < c("t") + c("h")) & (c("t") - p("t") - p("h") <= p("h") + epsilon) & (p("l") < c("l") + c("w")) & (c("l") < p("l") + p("w"))
    return group_by_pairs(lines, PAGE, ["first_id"], follows, "block")


# --- shapes of line pairs ---------------------------------------------------------------


def line_pairs(lines: DataFrame) -> DataFrame:
    """Each line with the next by first id, if it is strictly below and neither left nor right of it: their trapezoid's angles and classes."""
    w = Window.partitionBy(*PAGE).orderBy("first_id")
    nxt = lines.select("*", *[F.lead(c).over(w).alias(f"b{c}") for c in "ltwh"], F.lead("line").over(w).alias("below"))
    a, b = Box.of(), Box.of("b")
    pairs = nxt.filter(F.col("below").isNotNull() & a.above(b) & a.in_line_with(b))
    base = lambda x: Line(x.left, x.bottom, x.right, x.bottom)
    t = Trapezoid.of_lines(base(a), base(b))
    return pairs.withColumn("left_class", angle_class(t.left_angle())).withColumn("right_class", angle_class(t.right_angle()))


def shape_class(pairs: DataFrame) -> DataFrame:
    """What a pair of lines looks like."""
    is_ = lambda a, b: (F.col("left_class") == a) & (F.col("right_class") == b)
    return pairs.withColumn("shape", F.when(is_("Right", "Right"), "ParaBegin").when(is_("Acute", "Right"), "IndentedParaBegin").when(is_("Right", "Obtuse"), "ParaLast").when(is_("Obtuse", "Acute"), "ParaLastAndBegin").otherwise("Other"))


def caption_begins(text: Column) -> Column:
    return F.lower(F.regexp_replace(text, " ", "")).rlike("^(fig|table)")


def votes(shapes: DataFrame, texts: DataFrame) -> DataFrame:
    """Pins that pairs of lines give their two lines, counted: a paragraph begins, goes on or ends; a caption begins."""
    s = F.col("shape")
    vote = lambda line, pin_, cond: F.when(cond, F.struct(F.col(line).alias("line"), F.lit(pin_).alias("pin"), F.lit("Para").alias("label")))
    given = [vote("line", "B", s == "IndentedParaBegin"), vote("below", "I", s.isin("ParaBegin", "IndentedParaBegin")), vote("line", "I", s == "ParaBegin"), vote("below", "L", s == "ParaLast"), vote("line", "L", s == "ParaLastAndBegin"), vote("below", "B", s == "ParaLastAndBegin")]
    # one pass over the pairs, whatever the number of votes
    para = shapes.select(*PAGE, F.inline(F.filter(F.array(*given), lambda v: v.isNotNull())))
    caption = texts.filter(caption_begins(F.col("text"))).select(*PAGE, "line", F.lit("B").alias("pin"), F.lit("Caption").alias("label"))
    return para.unionByName(caption).groupBy(*PAGE, "line", "pin", "label").agg(F.count("*").alias("n"))


def trigrams(texts: DataFrame) -> DataFrame:
    """An inverted index of the lines' character trigrams."""
    x = F.lower("text")
    # a substring is found by walking from the start, so lines are cut into characters once and shifted against themselves
    cut = texts.select(*PAGE, "line", F.split(x, "").alias("c")).withColumn("n", F.greatest(F.size("c") - 2, F.lit(0)))
    a, b, c = (F.slice("c", i, F.col("n")) for i in (1, 2, 3))
    tri = F.zip_with(F.zip_with(a, b, lambda x, y: F.concat(x, y)), c, lambda x, y: F.concat(x, y))
    return cut.select(*PAGE, "line", F.explode(F.array_distinct(tri)).alias("tri")).groupBy("tri").agg(F.count("*").alias("n_lines"), F.sort_array(F.collect_list(F.struct(*PAGE, "line"))).alias("lines"))


def trigram_counts(texts: DataFrame) -> DataFrame:
    """``tri`` and ``n_lines`` of :func:`trigrams`: a line's trigrams are found as numbers, and those of many lines counted before they are shuffled."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            size = np.concatenate([np.zeros(1, np.int64), np.cumsum(pc.fill_null(pc.binary_length(batch["x"]), 0).to_numpy(zero_copy_only=False), dtype=np.int64)])
            at = 0
            while at < batch.num_rows:
                to = min(max(int(np.searchsorted(size, size[at] + TEXT_BYTES, "right")) - 1, at + 1), batch.num_rows)
                row, char = characters(batch["x"].slice(at, to - at))
                at, char = to, char.astype(np.int64)
                whole = np.flatnonzero(row[2:] == row[:-2])
                # characters are numbered anew, so that one sort of short numbers finds each line's different trigrams
                some = np.flatnonzero(np.bincount(char)) if char.size else char
                place = np.zeros(int(some.max(initial=0)) + 1, np.int64)
                place[some] = np.arange(some.size)
                code, k = place[char], max(some.size, 1)
                tri = (code[whole] * k + code[whole + 1]) * k + code[whole + 2]
                if int(row.max(initial=0) + 1) * k**3 < 1 << 62:
                    key = np.sort(row[whole] * np.int64(k**3) + tri)
                    words, n = np.unique(key[starts_of(key)] % k**3, return_counts=True)
                else:
                    order = np.lexsort((row[whole], tri))
                    key = packed([row[whole][order], tri[order]])
                    words, n = np.unique(tri[order][starts_of(key)], return_counts=True)
                words = some[words // k**2] << 42 | some[words // k % k] << 21 | some[words % k]
                text = "".join(map(chr, np.stack([words >> 42, words >> 21 & 0x1FFFFF, words & 0x1FFFFF], 1).ravel().tolist()))
                yield pa.RecordBatch.from_arrays([pa.array([text[i : i + 3] for i in range(0, len(text), 3)], pa.string()), pa.array(n.astype(np.int64))], ["tri", "n"])

    return texts.select(F.lower("text").alias("x")).mapInArrow(run, "tri string, n bigint").groupBy("tri").agg(F.sum("n").alias("n_lines"))


def glyphs_of_text(cells: DataFrame) -> DataFrame:
    """Grid cells as a glyphs table of one page a document; characters of a kind share a font, so that fonts vary as in real pages."""
    font = F.when(F.col("char").rlike(r"^[0-9]$"), "Digits").when(F.col("char").rlike(r"^\p{Lu}$"), "Caps").otherwise("Body")
    g = cells.filter(F.trim("char") != "").withColumn("page", F.lit(0)).withColumn("font", font).withColumn("scale", F.lit(1)).withColumn("rotation", F.lit(0))
    n = F.row_number().over(Window.partitionBy("doc_id").orderBy("row", "col"))
    return g.withColumn("item_id", n.cast("bigint")).withColumn("fb", F.col("t") + F.col("h"))
