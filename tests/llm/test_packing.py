import itertools
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest

from quire.llm import packing


def brute(placed, capacity):
    """Documents in the order of their keys laid end to end, token by token."""
    rows = sorted(placed, key=lambda r: (r["hilbert_key"], r["doc_id"] is not None, r["doc_id"] or 0, r["n_tokens"]))
    total, at, out = sum(r["n_tokens"] for r in rows), 0, []
    for r in rows:
        if r["n_tokens"] == 0:
            pack = min(at // capacity, max(total - 1, 0) // capacity)
            out.append((pack, at - pack * capacity, r["doc_id"], 0, 0))
            continue
        done = 0
        while done < r["n_tokens"]:
            pack, offset = divmod(at, capacity)
            n = min(capacity - offset, r["n_tokens"] - done)
            out.append((pack, offset, r["doc_id"], done, n))
            done, at = done + n, at + n
    return out


def got(docs, **parameters):
    return [(r["pack_id"], r["pack_offset"], r["doc_id"], r["doc_offset"], r["n_tokens"]) for r in packing.packed(docs, **parameters).collect()]


@pytest.mark.parametrize("capacity", [packing.CAPACITY, 64, 7])
def test_the_whole_table_against_laying_token_by_token(small, capacity):
    docs = small("documents")
    found = got(docs, capacity=capacity)
    assert sorted(map(repr, found)) == sorted(map(repr, brute(packing.placed(docs).collect(), capacity)))
    fill, whole = defaultdict(int), {r["doc_id"]: len([w for w in r["text"].split() if w]) for r in docs.collect()}
    for p, _, _, _, n in found:
        fill[p] += n
    assert all(fill[p] == capacity for p in fill if p != max(fill)) and sum(fill.values()) == sum(whole.values())


@pytest.mark.parametrize(("dims", "bits"), [(2, 4), (3, 3), (4, 2)])
def test_the_curve_visits_every_cell_once_by_single_steps(dims, bits):
    cells = np.array(list(itertools.product(range(1 << bits), repeat=dims)))
    key = packing.hilbert(cells, bits)
    assert sorted(key) == list(range(len(cells)))
    assert (np.abs(np.diff(cells[np.argsort(key)], axis=0)).sum(1) == 1).all()


def test_copies_and_like_texts_are_neighbours(spark, prose):
    rows = [(i, prose(300, i // 2)) for i in range(60)]
    order = [r["doc_id"] for r in packing.placed(spark.createDataFrame(rows, "doc_id bigint, text string")).orderBy("hilbert_key", "doc_id").collect()]
    place = {d: i for i, d in enumerate(order)}
    assert all(place[i + 1] == place[i] + 1 for i in range(0, 60, 2))


def test_vectors_don_t_depend_on_the_batch(small):
    texts = [r["text"] for r in small("documents").collect()]
    n, v = packing.vectors(pa.array(texts))
    for i in (0, 7, 99):
        m, w = packing.vectors(pa.array([texts[i]]))
        assert m[0] == n[i] == len(texts[i].split()) and np.allclose(w[0], v[i])


def test_odd_rows(odd, nothing):
    for capacity in (5, packing.CAPACITY):
        found = got(odd, capacity=capacity)
        assert sorted(map(repr, found)) == sorted(map(repr, brute(packing.placed(odd).collect(), capacity)))
    assert got(nothing) == []
    assert sorted(map(repr, got(odd.filter("text IS NULL"), capacity=5))) == ["(0, 0, 2, 0, 0)", "(0, 0, None, 0, 0)"]
