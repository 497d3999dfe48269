import copy

import numpy as np
import pyarrow as pa
import pytest

from quire.llm import quality_classifier as qc


MEDIUM = "/root/testdata/sf0.1"


@pytest.fixture(scope="module")
def tables(spark):
    return [spark.read.parquet(f"{MEDIUM}/{t}.parquet") for t in ("documents", "labels")]


@pytest.fixture(scope="module")
def model(tables):
    docs, labels = tables
    return qc.train(docs, labels.filter("doc_id % 2 = 0"))


def plainly(model, text):
    """Scores of one text, passage by passage."""
    h, begin, doc, style = qc.passages(pa.array([text]))
    w, unknown = model.weights, len(model.weights["E"]) - 1
    hidden = []
    for i in range(doc[-1]):
        ids = [x for x in model.words(h[begin[i] : begin[i + 1]]) if x != unknown]
        total = sum((w["E"][x] for x in ids), np.zeros(qc.HIDDEN))
        hidden.append(np.tanh(total / np.sqrt(begin[i + 1] - begin[i] + 1) + style[i] @ w["S"] + w["b"]))
    out = []
    for t in range(2):
        logit = np.array([(np.tanh(x @ w["V"][t]) / (1 + np.exp(-(x @ w["U"][t])))) @ w["w"][t] for x in hidden])
        a = np.exp(logit - logit.max())
        z = (a / a.sum()) @ np.array(hidden)
        out.append(1 / (1 + np.exp(-(z @ w["c"][t] + w["d"][t]))))
    return out


def test_the_whole_table_against_scoring_passage_by_passage(small, model):
    rows = {r["doc_id"]: r["text"] for r in small("documents").collect()}
    for r in qc.judged(small("documents"), model).collect():
        q, t = plainly(model, rows[r["doc_id"]])
        assert r["quality_score"] == pytest.approx(q, abs=1e-3) and r["toxic_score"] == pytest.approx(t, abs=1e-3)
        assert r["keep"] == (r["quality_score"] >= model.thresholds["quality"] and r["toxic_score"] <= model.thresholds["toxic"])
        assert 0 <= r["quality_passage"] < r["n_passages"] == -(-len(qc.passages(pa.array([rows[r["doc_id"]]]))[0]) // qc.PASSAGE)


def test_gradients_against_differences():
    texts = ["bad words here " * 30, "good prose of many kinds " * 40, "one", "more good prose, and some bad words " * 9] * 4
    h, begin, doc, style = qc.passages(pa.array(texts))
    y = np.array([[0, 1], [1, 0], [1, 0], [0, 0]] * 4, np.float32)
    model = qc.fit(h, begin, doc, style, y, epochs=1)
    model.weights = {k: v.astype(np.float64) for k, v in model.weights.items()}
    size = np.diff(begin)
    word, begin = model.known(model.words(h), begin)
    of, share = np.arange(16), y.mean(0)

    def loss(m):
        p = np.clip(qc.scores(m, word, begin, size, doc, style)[0], 1e-12, 1 - 1e-12)
        w = np.where(y > 0, 0.5 / share, 0.5 / (1 - share))
        return -(w * (y * np.log(p) + (1 - y) * np.log(1 - p))).sum() / 16

    g = qc._gradients(model, word, begin, size, doc, style, y, of, share)
    for k in ("S", "b", "V", "U", "w", "c", "d"):
        for i in list(np.ndindex(model.weights[k].shape))[:6]:
            ends = []
            for step in (1e-4, -1e-4):
                m = copy.deepcopy(model)
                m.weights[k][i] += step
                ends.append(loss(m))
            assert g[k][i] == pytest.approx((ends[0] - ends[1]) / 2e-4, abs=2e-4), k


def test_held_out_rows(tables, model):
    docs, labels = tables
    rows = qc.judged(docs, model).join(labels.filter("doc_id % 2 = 1"), "doc_id").toPandas()
    clean = (rows["quality"] == 1) & (rows["toxic"] == 0)
    assert rows[clean]["keep"].mean() > 0.97
    assert rows[rows["toxic"] == 1]["keep"].mean() < 0.1

    def auc(score, y):
        rank = score.rank()
        return (rank[y].sum() - y.sum() * (y.sum() + 1) / 2) / (y.sum() * (~y).sum())

    assert auc(rows["toxic_score"], rows["toxic"] == 1) > 0.97
    assert auc(rows["quality_score"], rows["quality"] == 1) > 0.85


def test_the_same_whatever_the_batches(small, model):
    docs = small("documents")
    kept = {r["doc_id"] for r in qc.kept(docs, model).collect()}
    assert kept == {r["doc_id"] for r in qc.judged(docs.repartition(7), model).collect() if r["keep"]}


def test_odd_rows(odd, nothing, model, small):
    got = qc.judged(odd, model).collect()
    assert len(got) == 12 and {r["doc_id"] for r in got if r["n_passages"] == 0} == {2, 3, 4, 9, None}
    assert all(r["quality_score"] is None and not r["keep"] for r in got if r["n_passages"] == 0)
    kept = qc.kept(odd, model)
    assert kept.columns == odd.columns and kept.count() == sum(r["keep"] for r in got)
    assert qc.judged(nothing, model).count() == qc.kept(nothing, model).count() == 0


def test_without_labels(odd, small):
    assert qc.train(odd, small("labels").limit(0)) is None
    assert sorted(r["doc_id"] or 0 for r in qc.kept(odd, None).collect()) == [0, 1, 1, 5, 6, 7, 8]


def test_the_fitted_rows_do_not_pass_through_the_drivers_results(spark, tables):
    """Long labelled rows, of more bytes than the driver may be sent: they are fitted on as they are, and a repeated row counts once."""
    docs, labels = tables
    rows = docs.join(labels, "doc_id").filter("doc_id % 4 = 0").orderBy("doc_id")
    texts = rows.selectExpr("doc_id", "repeat(concat(text, ' '), cast(least(100000 / (length(text) + 1) + 1, 200) as int)) AS text").repartition(8)
    limit = spark.conf.get("spark.driver.maxResultSize", "1g")
    sent = spark.sparkContext._jsc.sc().conf()
    sent.set("spark.driver.maxResultSize", "8m")
    try:
        model = qc.train(texts.unionByName(texts), labels)
    finally:
        sent.set("spark.driver.maxResultSize", limit)
    assert model.thresholds["quality"] is not None and model.vocabulary.size
    once = qc.train(texts, labels)
    assert all(np.array_equal(model.weights[k], once.weights[k]) for k in once.weights) and model.thresholds == once.thresholds
