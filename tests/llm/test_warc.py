import gzip
import json
import os

import pytest

from quire.llm import warc


def write(path, data):
    with open(path, "wb") as f:
        f.write(data)
    return str(path)


def test_every_page_comes_back(spark, small):
    key = lambda r: r["page_id"]
    want = [(r["page_id"], r["url"], r["html"], len(r["html"].encode())) for r in sorted(small("pages").collect(), key=key)]
    assert [tuple(r) for r in sorted(warc.normalised_pages(small("pages")).collect(), key=key)] == want


def test_monolithic_files_are_one_stream_and_rewritten_ones_a_member_a_record(spark, small, tmp_path):
    files = warc.write_monolithic(small("pages").repartition(3), f"{tmp_path}/whole")
    index = warc.normalise(files, f"{tmp_path}/members")
    assert files.count() >= 1 and index.count() == small("pages").count()
    side = {(r["file"], r["offset"]): r for r in warc.read_index(spark, f"{tmp_path}/members").collect()}
    assert len(side) == index.count()
    for path in {k[0] for k in side}:
        data = open(path, "rb").read()
        rows = sorted((r for (f, _), r in side.items() if f == path), key=lambda r: r["offset"])
        assert rows[0]["offset"] == 0 and rows[-1]["offset"] + rows[-1]["length"] == len(data)
        for a, b in zip(rows, rows[1:], strict=False):
            assert a["offset"] + a["length"] == b["offset"]
        for r in rows:
            one = gzip.decompress(data[r["offset"] : r["offset"] + r["length"]])
            assert one.count(b"WARC-Record-ID: ") == 1 and one.startswith(b"WARC/1.0\r\n") and r["record_id"].encode() in one


def test_broken_tails_keep_what_is_before_them(spark, tmp_path):
    whole = b"".join(warc.record(i, f"http://a/{i}", b"x" * 1000 * i) for i in range(5))
    packed = gzip.compress(whole)
    paths = [
        write(tmp_path / "good.warc.gz", packed),
        write(tmp_path / "cut.warc.gz", packed[:-200]),
        write(tmp_path / "junk.warc.gz", gzip.compress(whole + b"no record\r\n\r\nat all")),
        write(tmp_path / "many.warc.gz", b"".join(gzip.compress(warc.record(i, None, b"y")) for i in range(3))),
        write(tmp_path / "none.warc.gz", gzip.compress(b"")),
    ]
    files = spark.createDataFrame([(p,) for p in paths], "file string")
    rows = warc.normalise(files, f"{tmp_path}/out").collect()
    by = lambda name: [r for r in rows if r["file"].endswith(name)]
    assert [r["status"] for r in by("good.warc.gz")] == ["ok"] * 5
    assert [r["status"] for r in by("junk.warc.gz")] == ["ok"] * 5 + ["malformed"]
    assert by("cut.warc.gz")[-1]["status"] == "truncated" and by("cut.warc.gz")[-1]["offset"] is None
    assert len(by("many.warc.gz")) == 3 and not by("none.warc.gz")
    assert warc.read_records(warc.read_index(spark, f"{tmp_path}/out")).count() == sum(r["status"] == "ok" for r in rows)
    assert len([f for f in os.listdir(tmp_path / "out") if f.endswith(".idx")]) == 5
    for f in os.listdir(tmp_path / "out"):
        if f.endswith(".idx"):
            [json.loads(x) for x in open(tmp_path / "out" / f)]


def test_odd_rows(spark, prose):
    rows = [(1, "http://a/é ?q=%20", "<p>ü</p>"), (1, "http://a/é ?q=%20", "<p>ü</p>"), (2, None, None), (None, "", ""), (3, "u\r\nX: y", prose(200_000, 3)), (4, "raw:x", "\r\n\r\nWARC/1.0\r\n\r\n\x00")]
    pages = spark.createDataFrame([(*r, "k", 1, "f") for r in rows], "page_id bigint, url string, html string, k string, offset int, `file.x` string")
    want = [(*r, len((r[2] or "").encode())) for r in rows]
    assert sorted(map(repr, (tuple(r) for r in warc.normalised_pages(pages).collect()))) == sorted(map(repr, want))
    assert warc.normalised_pages(pages.limit(0)).count() == 0


@pytest.mark.parametrize("size", [0, 1, warc.READ, 3 * warc.READ + 7])
def test_payloads_of_any_length(spark, tmp_path, size):
    pages = spark.createDataFrame([(1, "u", "z" * size)], "page_id bigint, url string, html string")
    assert warc.normalised_pages(pages).first()["html"] == "z" * size


def test_good_records_after_bad_ones_are_kept(spark, tmp_path):
    good = [warc.record(i, f"http://a/{i}", b"x" * 100) for i in range(4)]
    none = b"WARC/1.0\r\nContent-Length: \xc2\xb2\r\n\r\nabc\r\n\r\n"
    long = b"WARC/1.0\r\nContent-Length: 999999\r\n\r\nabc\r\n\r\n"
    short = b"WARC/1.0\r\nContent-Length: 1\r\n\r\nabc\r\n\r\n"
    for bad in (none, long, short, b"no record at all\r\n", b"z" * (3 << 20) + b"\r\n"):
        got = [s for *_, s in warc.parsed(iter([good[0] + bad + good[1] + good[2]]))]
        assert got == ["ok", "malformed", "ok", "ok"], bad[:40]
        pieces = good[0] + bad + good[1] + bad + good[2]
        got = [s for *_, s in warc.parsed(pieces[i : i + 7001] for i in range(0, len(pieces), 7001))]
        assert got == ["ok", "malformed", "ok", "malformed", "ok"], bad[:40]
    path = write(tmp_path / "mixed.warc.gz", gzip.compress(good[0] + none + good[1] + good[2]))
    warc.normalise(spark.createDataFrame([(path,)], "file string"), f"{tmp_path}/out")
    assert sorted(r["page_id"] for r in warc.read_records(warc.read_index(spark, f"{tmp_path}/out")).collect()) == [0, 1, 2]


def test_records_of_other_writers(spark, tmp_path):
    head = b"WARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:uuid:1>\r\nWARC-Target-URI: https://x.org/a%20b?q=%2F\r\nX-Page-Id: abc\r\nContent-Length: 4\r\n\r\nbody\r\n\r\n"
    info = b"WARC/1.0\r\nWARC-Type: warcinfo\r\nContent-Length: 0\r\n\r\n\r\n\r\n"
    path = write(tmp_path / "other.warc.gz", gzip.compress(info + head))
    rows = warc.normalise(spark.createDataFrame([(path,)], "file string"), f"{tmp_path}/out").collect()
    assert [(r["uri"], r["page_id"], r["status"]) for r in rows] == [(None, None, "ok"), ("https://x.org/a%20b?q=%2F", None, "ok")]
    assert sorted((r["url"] or "", r["html"]) for r in warc.read_records(warc.read_index(spark, f"{tmp_path}/out")).collect()) == [("", ""), ("https://x.org/a%20b?q=%2F", "body")]


@pytest.mark.parametrize("uri", ["https://x.org/a%20b?q=%2F", "raw:x", "http://a/é ü", " x", "a\r\nb: c", "", None])
def test_uris_are_kept_as_they_stand(uri):
    data = warc.record(1, uri, b"")
    assert warc._uri(warc._headers(data[: data.index(b"\r\n\r\n")])) == uri
    if uri and "%" in uri:
        assert f"WARC-Target-URI: {uri}\r\n".encode() in data


def test_a_record_cut_by_the_streams_end(spark):
    data = warc.record(1, "u", b"x" * 50)
    assert [s for *_, s in warc.parsed(iter([data + data[:-30]]))] == ["ok", "truncated"]
    assert [s for *_, s in warc.parsed(iter([data + data[:20]]))] == ["ok", "truncated"]


def test_reading_back_takes_more_than_one_task(spark, tmp_path, prose, monkeypatch):
    monkeypatch.setattr(warc, "TASK_BYTES", 20_000)
    pages = spark.createDataFrame([(i, "u", prose(2000, i)) for i in range(30)], "page_id bigint, url string, html string").coalesce(1)
    warc.normalise(warc.write_monolithic(pages, f"{tmp_path}/a"), f"{tmp_path}/b")
    back = warc.read_records(warc.read_index(spark, f"{tmp_path}/b"))
    assert back.rdd.getNumPartitions() > 3 and back.count() == 30
