"""The curation store, path queries, geometry and sources on small inputs."""

import os

import pytest
from pyspark.sql import functions as F

from quire.functions import fixed, text
from quire.functions.geometry import Box
from quire.operators import grid, spatial
from quire.plans import store
from quire.sources import corpus
from quire.streaming import corpus_stream

LOCKS = "lock bigint, document bigint, holder bigint, path string, status string"


def test_three_users_take_turns_at_ten_locks(spark):
    locks = store.created_locks(spark.createDataFrame([], LOCKS), spark.range(10).select(F.col("id").alias("document")), "A.B")
    for user in (1, 2, 3):
        locks = store.acquired(locks, user, "A.B")
    assert count(locks) == {"Locked": 3, "Available": 7}
    assert [r["holder"] for r in store.acquired(locks, 1, "A.B").filter("holder = 1").collect()] == [1]
    for r in locks.filter("status = 'Locked'").collect():
        locks = store.released(locks, r["lock"])
    assert count(locks) == {"Completed": 3, "Available": 7}


def test_no_user_has_one_document_twice_on_a_path(spark):
    locks = store.created_locks(spark.createDataFrame([], LOCKS), spark.range(2).select(F.col("id").alias("document")), "A", 2)
    for _ in range(4):
        locks, mine = store.next_assignment(locks, 1, "A")
        for r in mine.collect():
            locks = store.released(locks, r["lock"])
    assert count(locks) == {"Completed": 2, "Available": 2}


def count(locks):
    return {r["status"]: r["count"] for r in locks.groupBy("status").count().collect()}


@pytest.mark.parametrize(("query", "hit"), [("*.B.C", True), ("A.*.C", True), ("A.B.*", True), ("A.B.C", True), ("A", False), ("*", True), ("B.*", False)])
def test_path_queries(spark, query, hit):
    assert spark.createDataFrame([("A.B.C",)], "path string").filter(text.path_matches(F.col("path"), query)).count() == hit


def test_moving_to_an_unknown_path_is_an_error(spark):
    paths, entries = spark.createDataFrame([(1, "A")], "pathid bigint, path string"), spark.createDataFrame([(7, 1)], "document bigint, pathid bigint")
    assert store.moved_entry(store.made_directory(paths, "A.B"), entries, 7, "A.B").first()["pathid"] == 2
    with pytest.raises(Exception, match="rows found: 0"):
        store.moved_entry(paths, entries, 7, "nowhere").collect()


def test_exact_numbers(spark):
    row = spark.range(1).select(fixed.to_exact(F.lit(1.999)).alias("a"), fixed.to_exact(F.lit(-1.999)).alias("b"), fixed.multiply(F.lit(1), F.lit(1)).alias("c")).first()
    assert tuple(row) == (199, -199, 0)


def test_range_join_against_every_pair(spark):
    import random

    r = random.Random(9)
    rows = [(1, i, r.randrange(-5000, 5000), r.randrange(-5000, 5000), r.randrange(0, 3000), r.randrange(0, 3000)) for i in range(90)]
    df = lambda p: spark.createDataFrame(rows, f"page int, {p}_id int, {p}l int, {p}t int, {p}w int, {p}h int")
    got = spatial.range_join(df("a"), df("b"), ["page"]).collect()
    want = {(a[1], b[1]) for a in rows for b in rows if a[2] <= b[2] + b[4] and b[2] <= a[2] + a[4] and a[3] <= b[3] + b[5] and b[3] <= a[3] + a[5]}
    assert len(got) == len(want) and {(x["a_id"], x["b_id"]) for x in got} == want


def test_boxes_of_no_width_meet_but_do_not_intersect(spark):
    a, b = Box(F.lit(0), F.lit(0), F.lit(100), F.lit(100)), Box(F.lit(100), F.lit(0), F.lit(50), F.lit(50))
    assert tuple(spark.range(1).select(a.meets(b), a.intersects(b)).first()) == (True, False)


def test_text_to_grid_and_back(spark):
    docs = spark.createDataFrame([(1, "abc\ndef\nghi"), (2, ""), (3, None), (4, "  x\n\n y")], "doc_id bigint, text string")
    back = {r["doc_id"]: r["text"] for r in grid.to_text(grid.from_text(docs), ["doc_id"]).collect()}
    assert back[1] == "abc\ndef\nghi" and not back.get(2) and not back.get(3)


def test_a_corpus_is_made_once_and_read(spark, tmp_path):
    for name in ("b.pdf", "a.ps", "c.txt"):
        (tmp_path / name).write_text(name)
    assert corpus.init_corpus(str(tmp_path)) == ["a.ps.d", "b.pdf.d"] and corpus.init_corpus(str(tmp_path)) == []
    assert os.path.exists(tmp_path / corpus.SENTINEL)
    assert [r["entry"] for r in corpus.entries(spark, str(tmp_path)).collect()] == ["a.ps.d", "b.pdf.d"]
    assert [r["text"] for r in corpus.artifact(spark, str(tmp_path), "b.pdf").collect()] == ["b.pdf"]
    with pytest.raises(ValueError):
        corpus.inputs(spark, "tape", str(tmp_path))


def test_a_stream_goes_on_where_it_left_off(spark, tmp_path):
    source, sink, at = (str(tmp_path / x) for x in ("in", "out", "at"))
    for k in range(2):
        spark.createDataFrame([(k, "ab\ncd")], "doc_id bigint, text string").write.mode("append").parquet(source)
        corpus_stream.drain(corpus_stream.text_grids(corpus_stream.documents(spark, source)), sink, at).awaitTermination()
        assert spark.read.parquet(sink).count() == 4 * (k + 1)
