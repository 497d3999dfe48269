import numpy as np
import pytest

from quire.llm import embedding_dedup as ed


def brute(rows, threshold):
    """Groups by comparing every pair."""
    ids = [k for k, _ in rows]
    x = [np.array(v, float) if v is not None and len(v) and None not in v else None for _, v in rows]
    group = list(range(len(rows)))

    def top(i):
        while group[i] != i:
            i = group[i]
        return i

    def usable(v):
        return v is not None and np.isfinite(v).all() and (v != 0).any()

    good = [i for i in range(len(rows)) if usable(x[i])]
    for size in {x[i].size for i in good}:
        own = [i for i in good if x[i].size == size]
        unit = np.stack([x[i] / np.linalg.norm(x[i]) for i in own])
        for i, j in np.argwhere(np.triu(unit @ unit.T >= threshold, 1)):
            a, b = sorted((top(own[i]), top(own[j])))
            group[b] = a
    found = {}
    for i in range(len(rows)):
        found.setdefault(top(i), []).append(ids[i])
    return {tuple(sorted(v, key=lambda k: (k is None, k))) for v in found.values() if len(v) > 1}


def groups(df):
    found = {}
    for r in df.collect():
        found.setdefault(r["group_id"], []).append(r["vec_id"])
    return {tuple(sorted(v, key=lambda k: (k is None, k))) for v in found.values()}


def planted(n, size, seed, noise):
    rng = np.random.default_rng(seed)
    base = rng.normal(size=(n, size))
    rows = [v for v in base]
    for i in range(0, n, 3):
        rows += [base[i] + rng.normal(size=size) * noise * np.linalg.norm(base[i]) / np.sqrt(size) for _ in range(1 + i % 4)]
    return [(i, [float(x) for x in v]) for i, v in enumerate(rows)]


def pairs(found):
    return {(a, b) for g in found for a in g for b in g if a < b}


@pytest.mark.parametrize("parameters", [{}, {"node_rows": 300, "leaf": 64}, {"leaf": 32}])
def test_recall_and_precision_against_every_pair(spark, parameters):
    rows = planted(900, 32, 4, 0.2)
    want = pairs(brute(rows, ed.THRESHOLD))
    got = pairs(groups(ed.near_duplicates(spark.createDataFrame(rows, "vec_id bigint, embedding array<float>"), **parameters)))
    assert len(want) > 500 and got <= want
    assert len(got & want) >= 0.9 * len(want)


def test_the_whole_table(spark, small):
    rows = [(r["vec_id"], list(r["embedding"])) for r in small("embeddings").collect()]
    for threshold in (0.95, 0.6):
        want = pairs(brute(rows, threshold))
        got = pairs(groups(ed.near_duplicates(small("embeddings"), threshold=threshold)))
        assert len(got & want) >= 0.9 * len(want) and got <= want


def test_thousands_of_copies_are_one_group(spark):
    rows = [(i, [1.0, 2.0, 3.0]) for i in range(3000)] + [(9000, [2.0, 4.0, 6.0]), (9001, [-1.0, 0.0, 0.0])]
    got = ed.near_duplicates(spark.createDataFrame(rows, "vec_id bigint, embedding array<float>"), leaf=16).collect()
    assert len(got) == 3001 and {(r["group_id"], r["group_size"]) for r in got} == {(0, 3001)}


def test_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, None), (2, []), (3, [0.0, 0.0]), (4, [nan, 1.0]), (5, [inf, 1.0]), (6, [None, 1.0]), (7, [1.0, 1.0]), (7, [1.0, 1.0]), (None, [2.0, 2.0]), (8, [1.0, 1.0, 0.0]), (9, [1.0, -1.0])]
    df = spark.createDataFrame([(*r, 5, "u", 1, 2, "x") for r in rows], "vec_id bigint, embedding array<float>, size int, unit string, uid int, grp int, `a.b` string")
    assert [tuple(r) for r in ed.near_duplicates(df).orderBy("vec_id").collect()] == [(None, 7, 3), (7, 7, 3), (7, 7, 3)]
    assert ed.near_duplicates(df.limit(0)).count() == 0


def test_cuts_learned_from_a_sample(spark):
    rows = planted(900, 32, 6, 0.2)
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>")
    units = ed.unit_vectors(df).withColumn("uid", ed.F.monotonically_increasing_id())
    cuts = ed._learned(units, 2, 0.05, 200, 1000, ed.SEED)
    assert len({t for _, t, _ in cuts}) == 2 and max(n for *_, n in cuts) > 3
    placed = ed._placed(units, 2, cuts, ed.SEED)
    assert placed.select("uid", "tree").distinct().count() == 2 * len(rows)
    want = pairs(brute(rows, ed.THRESHOLD))
    got = pairs(groups(ed.near_duplicates(df, node_rows=200, sample=1000, leaf=64)))
    assert got <= want and len(got & want) >= 0.9 * len(want)


def test_jittered_copies_against_sql(spark, small):
    import duckdb

    from quire.llm.registry import op8_jittered_copies

    duckdb.sql("CREATE OR REPLACE VIEW embeddings AS FROM '/root/testdata/sf0.001/embeddings.parquet'")
    want = duckdb.sql(ed.JITTERED_SQL).fetchall()
    got = op8_jittered_copies(spark, "/root/testdata/sf0.001").collect()
    assert len(want) > 500 and sorted(map(tuple, got)) == sorted(want)
