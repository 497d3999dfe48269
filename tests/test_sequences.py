"""Grouping, clustering and intervals on small inputs, against plain Python."""

import random

import pytest
from pyspark.sql import functions as F

from quire.operators import cluster, interval_join, sequence, trees


def numbers(spark, values):
    return spark.createDataFrame([(1, i, v) for i, v in enumerate(values)], "k int, i int, v int")


def groups(df, value="v"):
    found = {}
    for r in df.orderBy("i").collect():
        found.setdefault(r["grp"], []).append(r[value])
    return list(found.values())


def test_groups_by_pairs_and_splits(spark):
    assert groups(sequence.group_by_pairs(numbers(spark, [0, 1, 2, 3, 4]), ["k"], ["i"], lambda p, c: c("v") % 3 != 0)) == [[0, 1, 2], [3, 4]]
    assert groups(sequence.split_on_pairs(numbers(spark, [1, 2, 3]), ["k"], ["i"], lambda p, c: c("v") > 2)) == [[1, 2], [3]]
    assert groups(sequence.group_by_pairs(numbers(spark, [1, None, None, 2]), ["k"], ["i"], lambda p, c: p("v") == c("v"))) == [[1], [None], [None], [2]]
    assert groups(sequence.group_by_pairs(numbers(spark, []), ["k"], ["i"], lambda p, c: p("v") == c("v"))) == []


def test_windows_that_depend_on_the_group_so_far(spark):
    got = sequence.group_by_window(numbers(spark, [1, 1, 1, 2, 2, 3]), ["k"], ["i"], lambda w, r: (w["v"] == r["v"]).all())
    assert groups(got) == [[1, 1, 1], [2, 2], [3]]


@pytest.mark.parametrize(("words", "want"), [("abc abd def ghi", ["abc abd", "def", "ghi"]), ("qwe abd ef ri", ["qwe ef", "abd", "ri"])])
def test_greedy_clusters(words, want):
    got = cluster.greedy_groups(words.split(), lambda a, b: bool(set(a) & set(b)))
    assert [" ".join(g) for g in got] == want


def test_components_against_merging_sets(spark):
    r = random.Random(4)
    edges = [(r.randrange(200), r.randrange(200)) for _ in range(130)] + [(1000 + i, 1001 + i) for i in range(60)]
    sets = {x: {x} for e in edges for x in e}
    for a, b in edges:
        if sets[a] is not sets[b]:
            merged = sets[a] | sets[b]
            for x in merged:
                sets[x] = merged
    got = {}
    for row in cluster.connected_components(spark.createDataFrame(edges, "a bigint, b bigint")).collect():
        got.setdefault(row["component"], set()).add(row["node"])
    # a loop ties a node to nothing
    assert {frozenset(s) for s in got.values()} == {frozenset(s) for s in sets.values() if len(s) > 1}
    assert all(k == min(s) for k, s in got.items())


@pytest.mark.parametrize("width", [0.5, 3.0, 1000.0])
def test_interval_joins_against_every_pair(spark, width):
    r = random.Random(2)
    rows = [(i, a := r.uniform(-50, 50), a + r.choice((0, 0.3, 4, 60))) for i in range(80)]
    points = [(i, r.uniform(-60, 60)) for i in range(60)]
    left = spark.createDataFrame(rows, "i int, s double, e double")
    right = left.select(F.col("i").alias("j"), F.col("s").alias("s2"), F.col("e").alias("e2"))
    got = {(x["i"], x["j"]) for x in interval_join.overlap(left, right, ("s", "e"), ("s2", "e2"), width).collect()}
    assert got == {(a[0], b[0]) for a in rows for b in rows if a[1] <= b[2] and b[1] <= a[2]}
    at = spark.createDataFrame(points, "p int, x double")
    got = interval_join.stab(left, at, "s", "e", "x", width).collect()
    assert len(got) == len({(x["i"], x["p"]) for x in got})
    assert {(x["i"], x["p"]) for x in got} == {(a[0], p[0]) for a in rows for p in points if a[1] <= p[1] <= a[2]}


def test_forests(spark):
    edges = spark.createDataFrame([(41, 42), (42, 43), (43, 44), (44, 45), (42, 47), (43, 48), (42, 49)], "parent bigint, child bigint")
    assert [r["node"] for r in trees.preorder(edges).orderBy("place").collect()] == [41, 42, 43, 44, 45, 48, 47, 49]
    two = spark.createDataFrame([(0, 1), (0, 2), (1, 3), (1, 4), (2, 5), (10, 11), (20, 21)], "parent bigint, child bigint")
    assert sorted(r["path"] for r in trees.leaf_paths(two).collect()) == [[0, 1, 3], [0, 1, 4], [0, 2, 5], [10, 11], [20, 21]]
    assert trees.preorder(edges.limit(0)).count() == 0


def test_union_find():
    d = cluster.DisjointSets(range(1, 7))
    for pair in ((2, 3), (4, 5), (5, 6)):
        d.union(*pair)
    assert sorted(map(sorted, d.sets())) == [[1], [2, 3], [4, 5, 6]]
    with pytest.raises(ValueError):
        d.add(1)


def test_trees_deeper_than_a_hundred_levels(spark):
    from quire.operators import trees

    edges = spark.createDataFrame([(i, i + 1) for i in range(150)], "parent bigint, child bigint")
    assert [r["path"] for r in trees.leaf_paths(edges).collect()] == [list(range(151))]


def test_trigrams_of_short_null_and_astral_texts(spark):
    from quire.operators import layout

    rows = [(1, 0, 0, "abcabc"), (1, 0, 1, "ab"), (1, 0, 2, ""), (1, 0, 3, None), (2, 0, 0, "x\U0001f600yz")]
    got = {r["tri"]: r["n_lines"] for r in layout.trigrams(spark.createDataFrame(rows, "doc_id bigint, page int, line int, text string")).collect()}
    assert got == {"abc": 1, "bca": 1, "cab": 1, "x\U0001f600y": 1, "\U0001f600yz": 1}
