import itertools

import numpy as np
import pyarrow as pa
import pytest

from quire.llm import language_id as li


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet("/root/testdata/sf0.1/documents.parquet")


@pytest.fixture(scope="module")
def field(docs):
    return li.train(docs.filter("doc_id % 2 = 0"))


def every_path(emission, trans, first, last):
    n, k = emission.shape
    p = np.zeros((n, k))
    for y in itertools.product(range(k), repeat=n):
        w = np.exp(first[y[0]] + last[y[-1]] + sum(emission[i, y[i]] for i in range(n)) + sum(trans[a, b] for a, b in zip(y, y[1:], strict=False)))
        p[np.arange(n), y] += w
    return p / p.sum(1, keepdims=True)


def test_forward_backward_against_every_path():
    rng = np.random.default_rng(2)
    for sizes in ([1], [6], [2, 1, 5, 3]):
        emission, trans, first, last = rng.normal(size=(sum(sizes), 3)), rng.normal(size=(3, 3)), rng.normal(size=3), rng.normal(size=3)
        rows = np.repeat(np.arange(len(sizes)), sizes)
        want = np.concatenate([every_path(emission[rows == i], trans, first, last) for i in range(len(sizes))])
        assert np.allclose(li.marginals(emission, rows, trans, first, last), want)


def test_forward_backward_over_many_blocks_against_one_word_at_a_time():
    rng = np.random.default_rng(3)
    rows = np.repeat([0, 1, 2, 3], [1, 500, 64, 777])
    k = 4
    emission, trans, first, last = rng.normal(size=(rows.size, k)) * 3, rng.normal(size=(k, k)), rng.normal(size=k), rng.normal(size=k)
    got = li.marginals(emission, rows, trans, first, last)
    for d in range(4):
        e = emission[rows == d]
        fwd, bwd = np.zeros_like(e), np.zeros_like(e)
        for i in range(len(e)):
            fwd[i] = e[i] + (first if i == 0 else np.logaddexp.reduce(fwd[i - 1][:, None] + trans, axis=0))
        for i in range(len(e) - 1, -1, -1):
            bwd[i] = last if i == len(e) - 1 else np.logaddexp.reduce(trans + e[i + 1] + bwd[i + 1], axis=1)
        p = np.exp(fwd + bwd - (fwd + bwd).max(1, keepdims=True))
        assert np.allclose(got[rows == d], p / p.sum(1, keepdims=True))


def test_held_out_documents(docs, field):
    # junk without language-bearing words has no language to find
    rows = li.labelled(docs.filter("doc_id % 2 = 1"), field).join(docs.select("doc_id", docs["lang"].alias("truth")), "doc_id").filter("n_words >= 5").toPandas()
    assert (rows["lang"] == rows["truth"]).mean() > 0.95


def test_words_of_code_switched_texts(docs, field):
    texts = {}
    for r in docs.filter("doc_id % 2 = 1 AND n_chars > 600").orderBy("doc_id").collect():
        texts.setdefault(r["lang"], []).append(li.word_table(pa.array([r["text"]])) and r["text"].split())
    right = total = 0
    rng = np.random.default_rng(6)
    for _ in range(60):
        a, b = rng.choice(list(texts), 2, replace=False)
        x, y = texts[a][rng.integers(len(texts[a]))][:40], texts[b][rng.integers(len(texts[b]))][:40]
        first, whole = (len(li.word_table(pa.array([t]))[1]) for t in (" ".join(x), " ".join(x + y)))
        runs = li.label(pa.array([" ".join(x + y)]), field)[-1][0].as_py()
        got = [r["lang"] for r in runs for _ in range(r["n_words"])]
        right += sum(g == (a if i < first else b) for i, g in enumerate(got))
        total += whole
    assert right / total > 0.9


def test_the_same_whatever_the_batches(small, field):
    docs = small("documents")
    a, b = (sorted((r["doc_id"], r["lang"], r["switches"], str(r["runs"])) for r in li.labelled(d, field).collect()) for d in (docs, docs.repartition(9)))
    assert a == b


def test_odd_rows(odd, nothing, field, small):
    got = {(r["doc_id"], r["n_words"], r["lang"] is None, r["switches"]) for r in li.labelled(odd, field).collect()}
    assert {(2, 0, True, 0), (3, 0, True, 0), (4, 0, True, 0), (9, 0, True, 0), (None, 0, True, 0)} <= got
    assert li.labelled(odd, field).count() == 12 and li.labelled(nothing, field).count() == 0
    for rows in li.labelled(odd, field).select("n_words", "runs").collect():
        assert sum(r["n_words"] for r in rows["runs"]) == rows["n_words"]
    assert li.train(nothing) is None
    assert {r["lang"] for r in li.labelled(odd, None).collect()} == {None}
