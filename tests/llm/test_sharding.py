import hashlib
from collections import Counter

import pytest

from quire.llm import sharding


def brute(rows, slots, shards):
    slot = [int(hashlib.md5(("" if k is None else str(k)).encode()).hexdigest()[:8], 16) % slots for k, _ in rows]
    size = Counter()
    for s, (_, t) in zip(slot, rows, strict=True):
        size[s] += len((t or "").encode())
    v0 = {s: s * shards // slots for s in range(slots)}
    fair = -(-sum(size.values()) // shards)
    v1, used, moving = {}, Counter(), []
    upto = Counter()
    for s in range(slots):
        upto[v0[s]] += size[s]
        if upto[v0[s]] <= fair:
            v1[s] = v0[s]
            used[v0[s]] += size[s]
        else:
            moving.append(s)
    at = 0
    room, edge = [], 0
    for k in range(shards):
        room.append((edge, edge + fair - used[k]))
        edge += fair - used[k]
    for s in moving:
        v1[s] = next((k for k, (a, b) in enumerate(room) if a <= at < b), v0[s])
        at += size[s]
    return [(k, s, len((t or "").encode()), v0[s], v1[s]) for (k, t), s in zip(rows, slot, strict=True)], size, v1, fair


@pytest.mark.parametrize(("slots", "shards"), [(4096, 64), (64, 5)])
def test_against_placing_one_by_one(spark, small, slots, shards):
    rows = [(r["doc_id"], r["text"]) for r in small("documents").collect()]
    got = sharding.shard_documents(small("documents"), slots=slots, shards=shards).collect()
    want, size, v1, fair = brute(rows, slots, shards)
    assert sorted(map(tuple, got)) == sorted(want)
    load = Counter()
    for s, k in v1.items():
        load[k] += size[s]
    assert max(load.values()) <= fair + max(size.values())


def test_versions_stay(spark, small, tmp_path):
    store = sharding.SlotMapStore(spark, str(tmp_path / "map"))
    store.put(sharding.even_map(spark, 8, 2), 0)
    with pytest.raises(Exception, match="exist"):
        store.put(sharding.even_map(spark, 8, 4), 0)
    store.put(sharding.even_map(spark, 8, 4), 1)
    assert store.latest() == 1 and store.get(0).agg({"shard": "max"}).first()[0] == 1


def test_odd_rows(odd, odd_rows, nothing):
    want = brute([r[:2] for r in odd_rows], sharding.SLOTS, sharding.SHARDS)[0]
    assert sorted(map(repr, (tuple(r) for r in sharding.shard_documents(odd).collect()))) == sorted(map(repr, want))
    assert sharding.shard_documents(nothing).count() == 0
