import random
import re
from collections import defaultdict

import pytest

from quire.llm import jaccard_join as jj


def grams(text, n=jj.N):
    w = re.findall(r"[a-z0-9\x80-\U0010ffff]+", (text or "").lower())
    return {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if len(w) >= n else ({tuple(w)} if w else set())


def brute(rows, n=jj.N, t=jj.THRESHOLD):
    """Groups of row numbers, by comparing every pair."""
    sets = [grams(x, n) for _, x in rows]
    group = list(range(len(rows)))

    def top(i):
        while group[i] != i:
            i = group[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j]:
                both = len(sets[i] & sets[j])
                if both / (len(sets[i]) + len(sets[j]) - both) >= t:
                    a, b = sorted((top(i), top(j)))
                    group[b] = a
    out = defaultdict(list)
    for i in range(len(rows)):
        out[top(i)].append(i)
    return {k: v for k, v in out.items() if len(v) > 1}


def check(spark, rows, **parameters):
    got = jj.groups(spark.createDataFrame(rows, "doc_id bigint, text string"), **parameters).collect()
    want = []
    for members in brute(rows, parameters.get("n", jj.N), parameters.get("threshold", jj.THRESHOLD)).values():
        ids = [rows[i][0] for i in members]
        least = min((i for i in ids if i is not None), default=None)
        want += [(i, least, len(members)) for i in ids]
    key = lambda r: tuple((x is None, x or 0) for x in r)
    assert sorted(map(tuple, got), key=key) == sorted(want, key=key)
    return want


def edited(r, words, share):
    return [w if r.random() > share else f"e{r.randrange(10**6)}" for w in words]


@pytest.mark.parametrize("parameters", [{}, {"threshold": 0.8}, {"n": 2, "threshold": 0.55}, {"rare": 1}, {"block": 3}, {"range_tokens": 64}, {"rare": 2, "block": 2, "range_tokens": 100}])
def test_groups_are_those_of_comparing_every_pair(spark, prose, parameters):
    r = random.Random(5)
    shared = prose(60, 99).split()
    rows = []
    for f in range(14):
        base = prose(r.choice((4, 12, 40, 150)), f).split()
        for _ in range(r.choice((1, 2, 3, 9))):
            rows.append((len(rows), " ".join(edited(r, base, r.choice((0, 0.01, 0.05, 0.12))))))
    # one passage in many documents of their own
    rows += [(1000 + i, " ".join(shared + prose(r.choice((10, 30, 60, 200)), 500 + i).split())) for i in range(40)]
    r.shuffle(rows)
    assert check(spark, rows, **parameters)


def test_documents_of_small_vocabularies(spark):
    r = random.Random(8)
    rows = [(i, " ".join(r.choice("abcd") for _ in range(r.randrange(1, 30)))) for i in range(120)]
    assert check(spark, rows)
    assert check(spark, rows, n=1, rare=1)


def test_the_whole_table(spark, small):
    assert check(spark, [(r["doc_id"], r["text"]) for r in small("documents").collect()])


def test_odd_rows(spark, odd, odd_rows, nothing):
    check(spark, [r[:2] for r in odd_rows])
    found = {tuple(r) for r in jj.groups(odd).collect()}
    assert found == {(1, 1, 2), (5, 5, 2), (6, 5, 2)}
    assert jj.groups(nothing).count() == jj.deduplicated(nothing).count() == 0
    kept = jj.deduplicated(odd)
    assert kept.columns == odd.columns
    assert sorted(r["doc_id"] or 0 for r in kept.collect()) == [0, 0, 1, 2, 3, 4, 5, 7, 8, 9]


def test_one_of_each_group_stays(spark, small):
    docs = small("documents")
    rows = sorted((r["doc_id"], r["text"]) for r in docs.collect())
    gone = {rows[i][0] for v in brute(rows).values() for i in v[1:]}
    assert {r["doc_id"] for r in jj.deduplicated(docs).collect()} == {k for k, _ in rows} - gone


def test_thresholds_it_can_not_do_are_refused(odd):
    with pytest.raises(ValueError):
        jj.groups(odd, threshold=0.5)


def test_an_ngram_of_every_row_makes_one_entry_a_chunk(spark, prose):
    rows = [(i, "the very same licence line " + prose(30, i)) for i in range(3000)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(4)
    placed = docs.selectExpr("doc_id", "text", "xxhash64(text) AS h", "0L AS file", "0L AS row")
    sent = jj._tokenised(placed, 3, 0).filter("range >= 0").collect()
    keys = [k for r in sent for k in memoryview(bytes(r["keys"])).cast("I")]
    counts = [c for r in sent for c in memoryview(bytes(r["rows"])).cast("H")]
    assert len(sent) <= 8 and max(keys.count(k) for k, c in zip(keys, counts, strict=True) if c > 100) <= len(sent)
    assert sum(c for c in counts if c > 100) >= 3 * 3000


def test_frequencies_of_any_size_keep_their_order():
    df = [1, 2, 127, 128, 200, 255, 256, 10**6, 10**9, 10**12]
    code = jj.frequency_code(jj.np.array(df)).astype(int).tolist()
    assert code == sorted(code) and code[:3] == [1, 2, 127] and code[5] < code[7] < code[8] < code[9] <= 255


@pytest.mark.parametrize("limit", [10**6, 5])
def test_rows_of_files_are_left_out_by_place(spark, odd, tmp_path, monkeypatch, prose, limit):
    monkeypatch.setattr(jj, "BROADCAST_ROWS", limit)
    path = str(tmp_path / "docs")
    copies = spark.createDataFrame([(100 + i, prose(50, i % 7), "en", None, i, "u", 1, "r", 2, "b") for i in range(70)], odd.schema)
    odd.unionByName(copies).repartition(5).write.parquet(path)
    kept = jj.deduplicated(spark.read.parquet(path))
    assert kept.columns == odd.columns
    assert sorted(r["doc_id"] or 0 for r in kept.collect()) == [0, 0, 1, 2, 3, 4, 5, 7, 8, 9, *range(100, 107)]


def test_ngrams_shared_by_chance_do_not_tie_all_documents_together(spark, monkeypatch):
    """Few words, so that most n-grams are in some other document: families stay small, and no pair is lost."""
    r = random.Random(3)
    texts = [[f"w{r.randrange(24)}" for _ in range(40)] for _ in range(900)]
    texts += [[w if r.random() > 0.03 else f"w{r.randrange(24)}" for w in t] for t in texts[:60]] + texts[60:90]
    rows = [(i, " ".join(t)) for i, t in enumerate(texts)]
    largest, verified = [], jj._verified

    def watched(survivors, members, families, *rest):
        largest.append(families.groupBy("component").count().agg({"count": "max"}).first()[0])
        return verified(survivors, members, families, *rest)

    monkeypatch.setattr(jj, "_verified", watched)
    assert check(spark, rows, block=50)
    assert largest[0] <= 50
