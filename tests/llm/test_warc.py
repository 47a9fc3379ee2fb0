import gzip
import random

import pytest

from moodgauge.llm import warc

ROWS = [(1, "http://a.example/x", "<p>é</p>"), (2, None, "<p>é</p>"), (3, "http://a.example/y\r\nX: 1", None),
        (4, "http://b.example", ""), (None, "http://c.example", "<p>é</p>"), (5, "http://d.example", "z" * 300_000),
        (5, "http://d.example", "z" * 300_000), (6, "http://e.example", "WARC/1.1\r\n\r\nHTTP/1.1 200 OK\r\n\r\nno record"),
        (None, None, "alone")]


@pytest.fixture(scope="module")
def pages(spark):
    return spark.createDataFrame([(*r, "q") for r in ROWS], "page_id long, url string, html string, digest string")


def expected():
    top = {}
    for i, _, h in ROWS:
        if i is not None:
            top[h or ""] = max(top.get(h or "", i), i)
    out = []
    for i, _, h in ROWS:
        raw, first = (h or "").encode(), top.get(h or "")
        again = first is not None and i != first
        out.append((i, len(raw), warc.digest(raw), "revisit" if again else "response", first if again else None))
    return sorted(out, key=str)


def test_round_trip(pages):
    got = warc.round_trip(pages)
    rows = got.collect()
    assert sorted(((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in rows), key=str) == expected()
    texts = {r.page_id: bytes(r.payload).decode() for r in rows if r.record_type == "response" and r.page_id is not None}
    assert texts == {i: h or "" for i, _, h in ROWS if i in texts}
    assert {r.url for r in rows if r.page_id == 3} == {"http://a.example/y%0D%0AX: 1"}


def test_small_payloads_are_stored_in_full(pages):
    got = warc.round_trip(pages, min_bytes=1000).collect()
    assert {r.record_type for r in got if r.payload_bytes < 1000} == {"response"}


def test_every_split_of_an_archive(tmp_path):
    rng = random.Random(1)
    body = [f"<p>{'é' * rng.randrange(3000)}{rng.random()}</p>".encode() for _ in range(60)]
    junk = [b"", b"\x1f\x8b\x08 no member", gzip.compress(b"not a record"), b"\x1f\x8b\x08", b"\0" * 70_000]
    raw, at = b"", []
    for i, x in enumerate(body):
        raw += junk[i % 5]
        at.append(len(raw))
        raw += warc.record("response", i, f"http://x/{i}", x, None)
    raw += b"\x1f\x8b"
    path = str(tmp_path / "a.warc.gz")
    with open(path, "wb") as f:
        f.write(raw)
    for step in (len(raw), 50_000, 4096, 777):
        got = [r for lo in range(0, len(raw), step) for r in warc.read_range(path, lo, lo + step, len(raw))]
        assert [g[0] for g in got] == at, step
        assert [g[2].partition(b"\r\n\r\n")[2] for g in got] == body


def test_cut_off_archive(tmp_path):
    raw = b"".join(warc.record("response", i, "u", b"x" * 5000, None) for i in range(3))
    path = str(tmp_path / "b.warc.gz")
    with open(path, "wb") as f:
        f.write(raw[:-10])
    assert len(list(warc.read_range(path, 0, len(raw), len(raw) - 10))) == 2


def test_empty_table(spark):
    assert warc.round_trip(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0
