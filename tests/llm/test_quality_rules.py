import numpy as np
import pyarrow as pa
import pytest

from quire.llm import quality_rules as qr


def walked(forest, row):
    """Mean path of one row, tree by tree."""
    total = 0.0
    for at in forest.roots:
        while forest.feature[at] >= 0:
            at = at + 1 if row[forest.feature[at]] <= forest.cut[at] else forest.child[at]
        total += forest.cut[at]
    return total / len(forest.roots)


@pytest.fixture(scope="module")
def rules(small):
    return qr.train(small("documents"), small("labels"))


def test_the_whole_table_against_walking_the_trees(small, rules):
    docs = small("documents").collect()
    x = qr.statistics(pa.array([r["text"] for r in docs]))
    got = {r["doc_id"]: r for r in qr.judged(small("documents"), rules).collect()}
    for r, row in zip(docs, x, strict=True):
        over = []
        for g, f in rules.forests.items():
            part = row[[qr.STATS.index(s) for s in qr.GROUPS[g]]]
            score = 2 ** (-walked(f, part) / qr._mean_path(f.subsample))
            assert got[r["doc_id"]][f"{g}_score"] == pytest.approx(score)
            over += [g] if score > rules.thresholds[g] else []
        assert got[r["doc_id"]]["rejected_by"] == ",".join(over) and got[r["doc_id"]]["keep"] == (not over)
    assert {r["doc_id"] for r in qr.kept(small("documents"), rules).collect()} == {k for k, r in got.items() if r["keep"]}


def test_statistics_against_counting_by_hand():
    text = "The cat sat, the cat sat!\nThe cat sat\nThe cat sat\n99 $$ | END"
    got = dict(zip(qr.STATS, qr.statistics(pa.array([text]))[0], strict=True))
    words = text.lower().split()
    one = len(words) + 5
    assert got["log_words"] == pytest.approx(np.log1p(len(words)))
    assert got["digits"] == pytest.approx(2 / (len(text) + 30))
    assert got["symbols"] == pytest.approx(3 / (len(text) + 30))
    assert got["top_word"] == pytest.approx(max(map(words.count, words)) / one)
    assert got["repeated_lines"] == pytest.approx(1 / (4 + 4))
    assert got["upper"] == pytest.approx(6 / (len(text) + 30))
    assert got["stop_words"] == pytest.approx(4 / one)


def test_held_out_rows(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    fitted = qr.train(docs, labels.filter("doc_id % 2 = 0"))
    rows = qr.judged(docs, fitted).join(labels.filter("doc_id % 2 = 1"), "doc_id").select("keep", "quality").toPandas()
    good = rows["quality"] == 1
    assert rows[good]["keep"].mean() > 0.985
    assert rows[~good]["keep"].mean() < 0.6


def test_long_clean_texts_with_a_few_repeated_lines_are_kept(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    fitted = qr.train(docs, labels)
    found = [634, 1039, 1386, 6565, 8926]
    assert {r["doc_id"] for r in qr.kept(docs.filter(docs.doc_id.isin(found)), fitted).collect()} == set(found)
    # good texts joined to one of over 10,000 words, three of its short lines said again
    good = docs.join(labels.filter("quality = 1 AND toxic = 0"), "doc_id").filter("lang = 'en'").orderBy("doc_id").limit(60).collect()
    lines = [s for r in good for s in r["text"].split("\n")]
    short = sorted(dict.fromkeys(lines), key=len)[:3]
    score, why = (qr.verdict(pa.array(["\n".join(lines + short)]), fitted)[i][0].as_py() for i in (list(qr.GROUPS).index("lines"), -2))
    assert sum(len(s.split()) for s in lines) > 10_000
    assert score <= fitted.thresholds["lines"] and why == ""
    again = qr.verdict(pa.array(["\n".join(lines[:40] * 3)]), fitted)[-2][0].as_py()
    assert "lines" in again


def test_odd_rows(odd, nothing, rules, small):
    got = qr.judged(odd, rules).collect()
    assert len(got) == 12
    assert sorted((r["doc_id"] or 0, r["rejected_by"]) for r in got if r["rejected_by"] == "empty") == [(0, "empty"), (2, "empty"), (3, "empty"), (4, "empty")]
    kept = qr.kept(odd, rules)
    assert kept.columns == odd.columns and kept.count() == sum(r["keep"] for r in got)
    assert qr.judged(nothing, rules).count() == qr.kept(nothing, rules).count() == 0


def test_without_labels_only_empty_texts_go(odd, nothing, small):
    rules = qr.train(odd, small("labels").limit(0))
    assert rules is None
    assert sorted(r["doc_id"] or 0 for r in qr.kept(odd, rules).collect()) == [0, 1, 1, 5, 6, 7, 8, 9]
    assert qr.train(nothing, small("labels")) is None


def test_every_labelled_row_counts(spark):
    """Thresholds are the quantiles of the scores of all labelled rows, 11,940 here, by brute force."""
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    docs, labels = docs.join(labels.select("doc_id"), "doc_id"), labels.drop("toxic")
    many, told = docs.limit(0).select("doc_id", "text"), labels.limit(0)
    for i in range(3):
        many = many.unionByName(docs.selectExpr(f"doc_id + {i} * 1000000 AS doc_id", f"substring(text, {1 + 60 * i}, 900) AS text"))
        told = told.unionByName(labels.selectExpr(f"doc_id + {i} * 1000000 AS doc_id", "quality"))
    rules = qr.train(many.unionByName(many.limit(50)), told.withColumn("toxic", told["quality"] * 0))
    rows = many.join(told, "doc_id").toPandas()
    x = qr.statistics(pa.array(rows["text"]))
    full = x[:, 0] > 0
    x, good = x[full], rows["quality"].to_numpy()[full] > 0
    assert len(x) > 8000
    for i, g in enumerate(qr.GROUPS):
        score = rules.scores(x)[:, i]
        limit = np.quantile(score[good], 1 - qr.ALLOWED, method="higher")
        beyond = score[~good & (score > limit)]
        assert rules.thresholds[g] == pytest.approx((limit + np.quantile(beyond, 0.02)) / 2 if beyond.size else limit + 0.02, abs=1e-12), g
