"""What the queries shuffle, and their kernels against the definitions table by table."""

import random
from collections import Counter

import pandas as pd
import pytest
from pyspark.sql import functions as F

from quire import registry
from quire.operators import aggregates, cluster, diff, grid, interval_join, layout, pages, references

SMALL = "/root/testdata/sf0.001"


def shuffled(spark, df):
    """Records that the stages of one run of ``df`` write for a shuffle."""
    sc = spark.sparkContext
    group = f"shuffled-{random.random()}"
    sc.setJobGroup(group, "")
    df.write.format("noop").mode("overwrite").save()
    jsc = sc._jsc.sc()
    jsc.listenerBus().waitUntilEmpty()
    stages = {s for j in sc.statusTracker().getJobIdsForGroup(group) for s in sc.statusTracker().getJobInfo(j).stageIds}
    sc._jsc.clearJobGroup()
    store, total = jsc.statusStore(), 0
    for s in stages:
        total += store.lastStageAttempt(s).shuffleWriteRecords()
    return total


def same_rows(one, two):
    assert sorted(one.columns) == sorted(two.columns)
    rows = [Counter(map(repr, df.select(*sorted(one.columns)).collect())) for df in (one, two)]
    assert rows[0] == rows[1] and rows[0]


# --- gold and candidate annotations -----------------------------------------------------


@pytest.fixture(scope="module")
def annotated(spark):
    r, spans, cells = random.Random(5), [], []
    for doc in range(30):
        for span in range(r.randrange(1, 9)):
            gold = r.choice([True, False, None]) if doc < 25 else True
            spans.append((doc, span, r.choice(["A", "B", None]), gold))
            xs = r.sample(range(12), r.randrange(0, 6))
            cells += [(doc, span, at, r.choice([0, 0, 1, None]), x, r.choice([0, 0, None]), r.choice([None, [], ["B:A"], ["B:A"], ["I:A", "B:B"], ["B:A", None]]), r.choice([" ", ",", "a", "b", None])) for at, x in enumerate(xs)]
    r.shuffle(cells)
    return spark.createDataFrame(spans, "doc_id bigint, span_id int, label string, gold boolean"), spark.createDataFrame(cells, "doc_id bigint, span_id int, at int, page int, cx int, cy int, pins array<string>, char string")


def test_compared(annotated):
    same_rows(diff.comparison_table(*annotated), diff.compared(diff.documents(*annotated)))


def test_matched(annotated):
    same_rows(diff.matches(diff.aligned(*annotated)), diff.matched(diff.documents(*annotated)))


def test_scored(annotated):
    same_rows(diff.summary(*annotated), diff.scored(diff.documents(*annotated)))


def test_documents_of_many_cells_are_compared_alone(annotated, monkeypatch):
    whole = diff.matched(diff.documents(*annotated)).collect()
    monkeypatch.setattr(diff, "CELLS", 1)
    assert Counter(map(repr, diff.matched(diff.documents(*annotated)).collect())) == Counter(map(repr, whole))


@pytest.mark.parametrize("name", ["dif_comparison", "dif_matching", "dif_summary"])
def test_annotations_shuffle_line_items_only(spark, name):
    items = spark.read.parquet(f"{SMALL}/lineitem.parquet").count()
    assert shuffled(spark, registry.QUERIES[name](spark, SMALL)) <= items


# --- grids ------------------------------------------------------------------------------

TEXTS = ["ab c\n\n  d\te  \nfg hi jk lm no pq\n\n", "", None, "   ", "0123456789", "01234567890", " x\n" * 30, "é𝒳 ß\n" + "y" * 200 + "\n\n z", "\n\nü" + "w" * 80, "a\n" + "b" * 40 + "\n" + "c" * 90]


@pytest.fixture(scope="module")
def texts(spark):
    return spark.createDataFrame(list(enumerate(TEXTS)), "doc_id bigint, text string")


KEY = ["doc_id"]


def cells_of(rows, *more):
    return grid.cells_of_rows(rows, KEY, *more)


@pytest.mark.parametrize("row,col", [(0, 10), (2, 1), (0, 0), (1, 500)])
def test_split_row(texts, row, col):
    # cells that have moved down keep their boxes, so boxes are left out
    one, two = grid.split_row(grid.from_text(texts), KEY, row, col), cells_of(grid.split_row_of_rows(grid.rows_of_text(texts), KEY, row, col))
    same_rows(*(x.select("doc_id", "row", "col", "char") for x in (one, two)))


@pytest.mark.parametrize("begin,length", [(50, 100), (0, 5), (5, 60), (3, 0)])
def test_clip_and_label(texts, begin, length):
    cells, rows = grid.from_text(texts), grid.rows_of_text(texts)
    one, two = grid.clip_to_interval(cells, KEY, begin, length), cells_of(grid.clip_rows_to_interval(rows, KEY, begin, length), "index")
    assert Counter(map(repr, one.select("doc_id", "row", "col", "char", "l", "t", F.col("index").cast("bigint")).collect())) == Counter(map(repr, two.select("doc_id", "row", "col", "char", "l", "t", F.col("index").cast("bigint")).collect()))
    one, two = (f(x, KEY, "Header", begin, length) for f, x in ((grid.label_sequence, cells), (grid.label_sequence_of_rows, rows)))
    assert Counter(map(repr, one.select(*one.columns).collect())) == Counter(map(repr, two.select(*one.columns).collect()))


def test_text_and_json_of_rows(texts):
    cells, rows = grid.from_text(texts), grid.rows_of_text(texts)
    same_rows(grid.to_text(grid.trim_right(cells, KEY), KEY), grid.text_of_rows(rows, KEY))
    same_rows(grid.to_json(cells, KEY, F.concat(F.lit("d"), F.col("doc_id"))), grid.json_of_rows(rows, KEY, F.concat(F.lit("d"), F.col("doc_id"))))


@pytest.mark.parametrize("name", ["grd_text", "grd_clipped", "grd_split_rows", "grd_label_sequence", "grd_json_round_trip"])
def test_grids_shuffle_no_cells(spark, name):
    rows = grid.rows_of_text(spark.read.parquet(f"{SMALL}/documents.parquet")).count()
    assert shuffled(spark, registry.QUERIES[name](spark, SMALL)) <= 3 * rows


# --- intervals, votes, trigrams, references ---------------------------------------------


def test_stab_counts(spark):
    r = random.Random(3)
    spans = spark.createDataFrame([(r.randrange(40), s := r.randrange(60), s + r.randrange(-1, 9), r.randrange(3)) for _ in range(120)], "id int, s int, e int, k int")
    points = spark.createDataFrame([(r.choice([None, *range(70)]), r.randrange(3)) for _ in range(900)], "p int, k int")
    one = interval_join.stab(spans, points, "s", "e", "p", 8, ["k"]).groupBy("id").agg(F.count("*").alias("n"), F.min("p").alias("first"))
    same_rows(one, interval_join.stab_counts(spans, points, "s", "e", "p", 8, ["id"], ["k"]))


def test_stabbing_joins_counted_points(spark):
    spans = spark.range(2000).select("id", (F.col("id") % 5).cast("int").alias("s"), (F.col("id") % 5 + 3).cast("int").alias("e"))
    points = spark.range(2000).select((F.col("id") % 7).cast("int").alias("p"))
    found = interval_join.stab_counts(spans, points, "s", "e", "p", 8, ["id"])
    assert shuffled(spark, found) < 10_000  # all pairs would be over a million
    assert found.agg(F.sum("n")).first()[0] == sum(1 for i in range(2000) for j in range(2000) if i % 5 <= j % 7 <= i % 5 + 3)


def test_votes_take_one_pass(spark):
    df = registry.QUERIES["shp_votes"](spark, SMALL)
    assert df._jdf.queryExecution().optimizedPlan().toString().count("Relation") == 2


def test_trigram_counts(spark):
    rows = [(i, 0, 0, x) for i, x in enumerate([None, "", "ab", "abc", "Aaaaa aaa", "é𝒳ß x", "𝒳𝒳𝒳𝒳", "abcabc\tabc", "abc", "İstan"])]
    lines = spark.createDataFrame(rows, "doc_id bigint, page int, line int, text string")
    same_rows(layout.trigrams(lines).select("tri", "n_lines"), layout.trigram_counts(lines))


def test_trigrams_are_counted_before_the_shuffle(spark):
    lines = spark.range(0, 4000, 1, 4).select(F.col("id").alias("doc_id"), F.lit(0).alias("page"), F.lit(0).alias("line"), F.concat(F.lit("the same words "), F.col("id")).alias("text"))
    assert shuffled(spark, layout.trigram_counts(lines)) < 10_000


@pytest.mark.parametrize("tolerance", [1.0, 3.0])
def test_justified(spark, tolerance):
    r, rows = random.Random(9), []
    for doc in range(25):
        t = 0
        for line in range(r.randrange(1, 30)):
            rows.append((doc, 0, 0, line, t, f"x{line}"))
            t += r.choice([0, 900, 1000, 1000, 1010, 1700, 3000] if doc else [1000])
    r.shuffle(rows)
    lines = spark.createDataFrame(rows, "doc_id bigint, page int, block int, line int, t int, text string")

    def fold(part):
        part = part.sort_values(["t", "line"]).reset_index(drop=True)
        bins = cluster.nearest_bins(list(part["t"].diff().dropna().astype(int).value_counts().items()), tolerance)
        if len(bins) < 2:
            return part.assign(entry=0)
        spans = sorted((min([h[0], *(v for v, _ in n)]), max([h[0], *(v for v, _ in n)])) for h, n in bins[:2])
        return part.assign(entry=(part["t"].diff() > (spans[0][1] + spans[1][0]) / 2 + 10).cumsum().astype(int))

    plain = lines.groupBy("doc_id", "page", "block").applyInPandas(fold, "doc_id bigint, page int, block int, line int, t int, text string, entry int")
    same_rows(plain, references.justified(lines, tolerance))


# --- glyphs of whole pages --------------------------------------------------------------


def plain_fold(part):
    """Glyphs of a page, line by line, straight from the definition."""
    part = part.sort_values("item_id").reset_index(drop=True)
    free, line, number = pd.Series(True, part.index), pd.Series(-1, part.index), 0
    counts = part.groupby("font")["item_id"].count()
    for font in sorted(counts.index, key=lambda f: (-counts[f], f)):
        for _, run in part[part["font"] == font].groupby("run", sort=True):
            if not free[run.index].any():
                continue
            root = run[free[run.index]].iloc[0]
            top, bottom = root["fb"] - root["ascent"], root["fb"] + root["descent"]
            band = part[free & (part["t"] <= bottom) & (part["t"] + part["h"] >= top)]
            groups = (band["item_id"].diff() != 1).cumsum()
            taken = band[groups == groups[root.name]] if root.name in band.index else run[free[run.index]]
            if not taken["l"].is_monotonic_increasing and groups.nunique() > 1:
                taken = run[free[run.index]]
            free[taken.index], line[taken.index] = False, number
            number += 1
    return part.assign(line=line)


@pytest.mark.parametrize("seed", range(60))
def test_fold_lines(seed):
    r = random.Random(seed)
    n, ids = r.randrange(1, 80), 0
    rows = []
    for _ in range(n):
        ids += r.choice([1, 1, 1, 1, 1, 2])
        new = not rows or r.random() < 0.3
        before = rows[-1] if rows else None
        t = r.choice([0, 0, 10, 20, 30]) if new else before["t"]
        rows.append({"item_id": ids, "font": r.randrange(3) if new else before["font"], "run": (before["run"] + 1 if before else 0) if new else before["run"], "l": r.randrange(0, 300) if new else before["l"] + r.choice([1, 5, -3]), "t": t, "h": r.choice([8, 9, 12]) if new else before["h"], "fb": t + 9 + r.choice([0, 0, 40]), "ascent": r.choice([0, 5, 9]), "descent": r.choice([0, 1, 3])})
    if seed % 4 == 0:
        for row in rows:
            row["run"] = r.randrange(5)
    part = pd.DataFrame(rows)
    want = plain_fold(part)["line"].tolist()
    got = layout.fold_lines(*(part[c].to_numpy() for c in ("item_id", "font", "run", "l", "t", "h", "fb", "ascent", "descent"))).tolist()
    assert got == want


@pytest.fixture(scope="module")
def glyphs(spark):
    r = random.Random(1)
    word = lambda: "".join(r.choice(["e", "t", "a", "n", "x", "g", "B", "É", "7", "ß", "ﬁ", "𝒳", "İ", "the", "ing"]) for _ in range(r.randrange(1, 9)))
    texts = TEXTS + ["\n".join(" " * r.randrange(4) + (" " * r.choice([1, 1, 3])).join(word() for _ in range(r.randrange(0, 9))) for _ in range(r.randrange(1, 12))) for _ in range(25)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    table = layout.with_similar(layout.glyphs_of_text(grid.from_text(docs))).persist()
    return table, pages.of_rows(grid.rows_of_text(docs)).persist()


def columns_of(df, like):
    return df.select(*[F.col(c).cast(t) for c, t in like.dtypes])


def test_runs_and_fonts(glyphs):
    table, whole = glyphs
    runs = layout.text_runs(table)
    for slow, fast in (
        (layout.baselines(runs), pages.baselines(whole)),
        (layout.symbol_runs(table).groupBy("doc_id", "run").agg(F.count("*").alias("n"), F.min("item_id").alias("first_id")), pages.symbol_runs(whole)),
        (layout.font_metrics(runs), pages.font_metrics(whole)),
        (aggregates.font_evidence(table, ("font",)), pages.font_evidence(whole)),
    ):
        same_rows(columns_of(slow, fast), fast)


def test_lines(glyphs):
    table, whole = glyphs
    runs = layout.text_runs(table)
    lined = layout.text_lines(runs, layout.font_metrics(runs)).persist()
    for slow, fast in ((layout.line_boxes(lined), pages.line_boxes(whole)), (layout.font_ranges(lined), pages.font_ranges(whole)), (layout.line_texts(lined), pages.line_texts(whole))):
        assert [(c, t) for c, t in slow.dtypes] == [(c, t) for c, t in fast.dtypes]
        same_rows(slow, fast)


@pytest.mark.parametrize("name", ["seg_baselines", "seg_symbol_runs", "fnt_metrics", "fnt_evidence", "lin_lines", "lin_texts", "lin_font_ranges"])
def test_glyphs_are_not_shuffled(spark, name):
    rows = grid.rows_of_text(spark.read.parquet(f"{SMALL}/documents.parquet")).count()
    assert shuffled(spark, registry.QUERIES[name](spark, SMALL)) <= rows
