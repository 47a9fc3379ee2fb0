"""Sources and sinks (A1-A8, B1-B7) on small landed files."""

import json
import os

import pytest
from pyspark.sql import functions as F

from moodgauge import schemas
from moodgauge.operators import posts, report
from moodgauge.sinks import files as sinks
from moodgauge.sources import files as src


def _write(path, text):
    os.makedirs(os.path.dirname(path), exist_ok=True)
    with open(path, "w", encoding="utf-8") as f:
        f.write(text)


def test_jsonl_blank_lines_and_failfast(spark, tmp_path):
    p = str(tmp_path / "a.jsonl")
    _write(p, '{"id": "x", "ticker": "NVDA", "compound": 0.5}\n\n{"id": "y"}\n')
    assert src.read_jsonl(spark, p, schemas.SCORED).count() == 2
    bad = str(tmp_path / "b.jsonl")
    _write(bad, '{"id": "x"}\n{not json\n')
    with pytest.raises(Exception):
        src.read_jsonl(spark, bad, schemas.SCORED).collect()


def test_latest_snapshot(spark, tmp_path):
    d = str(tmp_path / "raw")
    _write(f"{d}/yahoo_news_2026-02-01_2026-02-08.jsonl", '{"ticker": "OLD"}\n')
    _write(f"{d}/yahoo_news_2026-02-10_2026-02-17.jsonl", '{"ticker": "NEW"}\n')
    _write(f"{d}/other.jsonl", '{"ticker": "ZZZ"}\n')
    got = src.latest_snapshot(spark, d, "yahoo_news_*.jsonl", schemas.NEWS_RAW).collect()
    assert [r["ticker"] for r in got] == ["NEW"]
    with pytest.raises(FileNotFoundError):
        src.latest_snapshot(spark, d, "nothing_*.jsonl", schemas.NEWS_RAW)


def test_entity_terms(spark, tmp_path):
    p = str(tmp_path / "keywords.json")
    _write(p, json.dumps({"Nvidia": ["cuda", "graphics", "ai"], "Empty": None}))
    got = [(r["entity"], r["ord"], r["term"]) for r in
           src.read_entity_terms(spark, p).orderBy("entity", "ord").collect()]
    assert got == [("Nvidia", 0, "cuda"), ("Nvidia", 1, "graphics"), ("Nvidia", 2, "ai")]
    assert src.read_entity_terms(spark, str(tmp_path / "missing.json")).count() == 0
    out = str(tmp_path / "out")
    sinks.write_entity_terms(src.read_entity_terms(spark, p), out)
    back = src.read_entity_terms(spark, out)
    assert sorted(r["term"] for r in back.collect()) == ["ai", "cuda", "graphics"]
    assert [r["term"] for r in back.orderBy("ord").collect()] == ["cuda", "graphics", "ai"]


def test_listing_flatten_and_normalize(spark, tmp_path):
    page = {"kind": "Listing", "data": {"after": None, "children": [
        {"kind": "t3", "data": {"id": "p1", "name": "t3_p1", "created_utc": 1771286400.0,
                                "title": "Hello\x00 world", "selftext": " body\n\ttext ",
                                "subreddit": "stocks", "author": "a", "permalink": "/r/x/1",
                                "url": "https://u", "over_18": False, "score": 3,
                                "num_comments": 1}},
        {"kind": "t3", "data": {"id": "p2", "created_utc": 0, "title": None,
                                "over_18": True}},
    ]}}
    _write(str(tmp_path / "pages/page1.json"), json.dumps(page))
    flat = src.flatten_listing(spark, str(tmp_path / "pages"))
    assert [r["pos"] for r in flat.orderBy("pos").collect()] == [0, 1]
    n = {r["id"]: r for r in posts.normalize_posts(flat).collect()}
    assert n["p1"]["title"] == "Hello world" and n["p1"]["text"] == "Hello world body text"
    assert n["p1"]["permalink"] == "https://www.reddit.com/r/x/1"
    assert str(n["p1"]["date_utc"]) == "2026-02-17"
    assert n["p2"]["date_utc"] is None and n["p2"]["score"] == 0 and n["p2"]["text"] == ""
    assert n["p2"]["over_18"] is True


def test_news_flatten(spark, tmp_path):
    items = [
        {"ticker": " nvda", "content": {"pubDate": "2026-02-12T18:30:00Z", "title": "T",
                                        "summary": "", "description": "D",
                                        "canonicalUrl": {"url": None},
                                        "clickThroughUrl": {"url": "https://c"},
                                        "provider": {"displayName": "P"}}},
        {"ticker": "nvda", "content": {"pubDate": "bad"}},
        {"ticker": "nvda", "content": {"title": "no date"}},
    ]
    p = str(tmp_path / "news.jsonl")
    _write(p, "\n".join(json.dumps(i) for i in items))
    raw = src.read_jsonl(spark, p, schemas.NEWS_ITEM)
    rows = src.flatten_news(raw).collect()
    assert len(rows) == 1
    r = rows[0]
    assert (r["ticker"], r["link"], r["summary"], r["publisher"], str(r["date"])) == \
        ("NVDA", "https://c", "D", "P", "2026-02-12")


def test_prices_and_vix(spark, tmp_path):
    good = str(tmp_path / "p.json")
    _write(good, json.dumps([{"date": "2026-02-10T00:00:00.000Z", "adjOpen": 1.0, "adjHigh": 2.0,
                              "adjLow": 0.5, "adjClose": 1.5, "adjVolume": 10}]))
    r = src.read_prices(spark, good).first()
    assert str(r["date"]) == "2026-02-10" and r["adjClose"] == 1.5
    err = str(tmp_path / "e.json")
    _write(err, json.dumps({"detail": "Error"}))
    with pytest.raises(ValueError):
        src.read_prices(spark, err)
    empty = str(tmp_path / "z.json")
    _write(empty, "[]")
    with pytest.raises(ValueError):
        src.read_prices(spark, empty)
    vix = str(tmp_path / "v.json")
    _write(vix, json.dumps([{"Date": "2026-02-10", "Open": 1, "High": 2, "Low": 1, "Close": 2,
                             "Volume": 0}]))
    assert str(src.read_vix(spark, vix).first()["Date"]) == "2026-02-10"


def test_writers(spark, tmp_path):
    df = spark.createDataFrame([("a", None, 1.0), ("b", "café", 2.0)], "id string, t string, v double")
    n = sinks.write_jsonl(df, str(tmp_path / "j"))
    assert n == 2
    text = "".join(open(os.path.join(tmp_path / "j", f)).read()
                   for f in os.listdir(tmp_path / "j") if f.endswith(".json"))
    assert '"t":null' in text and "café" in text      # nulls kept, Unicode unescaped
    sinks.write_table(df, str(tmp_path / "c"), fmt="csv")
    assert spark.read.option("header", True).csv(str(tmp_path / "c")).count() == 2
    sinks.write_table(df, str(tmp_path / "q"))
    with pytest.raises(Exception):   # overwrite: false guard
        sinks.write_table(df, str(tmp_path / "q"), mode="errorifexists")
    assert src.read_table(spark, str(tmp_path / "q")).count() == 2


def test_report_folders(spark, tmp_path):
    rows = [("a", "X", "2026-01-01", 0.5), ("b", "Y", "2026-01-01", 0.1),
            ("c", None, "2026-01-02", 0.2)]
    df = spark.createDataFrame(rows, "id string, ticker string, date string, compound double")
    rep = report.sentiment_report(df, "date", "compound", group="ticker", id_col="id")
    out = str(tmp_path / "rep")
    sinks.write_report(rep, out)
    assert sorted(d for d in os.listdir(out) if d.startswith("report_group=")) == \
        ["report_group=X", "report_group=Y", "report_group=__overall__"]


def test_strip_zone(spark):
    import datetime as dt
    df = spark.createDataFrame([(dt.datetime(2024, 1, 1, 15, 0),)], "ts timestamp_ntz") \
        .select(F.col("ts").cast("timestamp").alias("ts"))
    r = sinks.strip_zone(df, ["ts"], "America/New_York").first()
    assert r["ts"] == dt.datetime(2024, 1, 1, 10, 0)


def test_news_rows_buffer_then_window_then_limit(spark, tmp_path):
    def item(t, day, ok=True):
        return {"ticker": t, "content": {"pubDate": (f"2026-02-{day:02d}T12:00:00Z" if ok
                                                     else "not a date"), "title": f"{t}{day}"}}
    rows = []
    # A: 298 items before the window, 2 junk dates, then 5 in the window -
    # all in-window items lie past the 300-item buffer, so none is kept
    rows += [item("A", 1) for _ in range(298)] + [item("A", 12, ok=False)] * 2
    rows += [item("A", 12) for _ in range(5)]
    # B: in-window items first: the limit keeps the first two
    rows += [item("b", 12), item("b", 1), item("b", 13), item("b", 14)]
    p = str(tmp_path / "n.jsonl")
    _write(p, "\n".join(json.dumps(r) for r in rows))
    raw = src.read_jsonl(spark, p, schemas.NEWS_ITEM).withColumn(
        "ord", F.monotonically_increasing_id())
    got = src.news_rows(raw, "ord", start="2026-02-17", end="2026-02-10", limit=2)
    out = sorted((r["ticker"], r["title"]) for r in got.collect())
    assert out == [("B", "b12"), ("B", "b13")]
