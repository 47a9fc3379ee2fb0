"""File-to-file jobs end to end on small landed files."""

import json
import os

import pytest
from pyspark.sql import functions as F

from scorers import hashed_bag
from moodgauge import jobs
from moodgauge.schemas import SCORED
from moodgauge.sinks.files import write_entity_terms
from moodgauge.sources.files import read_entity_terms, read_jsonl


def _write(path, text):
    os.makedirs(os.path.dirname(path), exist_ok=True)
    with open(path, "w", encoding="utf-8") as f:
        f.write(text)


def test_social_chain(spark, tmp_path):
    # consensus keywords from landed responses
    resp = [{"entity": "Nvidia", "run": r, "attempt": 1,
             "text": "cuda graphics gaming chips ai"} for r in range(3)]
    _write(str(tmp_path / "resp/r.jsonl"), "\n".join(json.dumps(x) for x in resp))
    terms = jobs.consensus_terms_job(spark, str(tmp_path / "resp"), str(tmp_path / "kw"), k=5)
    assert terms.count() == 5
    got = [r["term"] for r in read_entity_terms(spark, str(tmp_path / "kw")).orderBy("ord").collect()]
    assert got == ["cuda", "graphics", "gaming", "chips", "ai"]

    # landed listing pages -> matched posts -> scored rows -> report folders
    def post(i, day, title, over18=False):
        return {"kind": "t3", "data": {"id": f"p{i}", "name": f"t3_p{i}",
                                       "created_utc": 1771200000.0 + day * 86400,
                                       "title": title, "selftext": "", "subreddit": "stocks",
                                       "author": "a", "permalink": f"/r/s/{i}", "url": "u",
                                       "over_18": over18, "score": 1, "num_comments": 0}}
    page1 = {"kind": "Listing", "data": {"after": "x", "children": [
        post(1, 0, "NVIDIA is good"), post(2, 0, "said nothing"), post(3, 1, "bad cuda day"),
        post(4, 1, "nvidia", over18=True)]}}
    page2 = {"kind": "Listing", "data": {"after": None, "children": [
        post(1, 0, "duplicate of p1, dropped"), post(5, 2, "Gaming is good")]}}
    # page 10 comes after page 2; a blank first copy hides a later one
    page2["data"]["children"] += [post(6, 2, " "), post(7, 2, "from page 2: ai")]
    page10 = {"kind": "Listing", "data": {"after": None, "children": [
        post(6, 2, "cuda, but a copy of a blank post"), post(7, 2, "a copy from page 10: cuda")]}}
    _write(str(tmp_path / "pages/page_1.json"), json.dumps(page1))
    _write(str(tmp_path / "pages/page_2.json"), json.dumps(page2, indent=2))
    _write(str(tmp_path / "pages/page_10.json"), json.dumps(page10))
    n = jobs.social_posts_job(spark, str(tmp_path / "pages"), str(tmp_path / "kw"),
                              str(tmp_path / "matched"), k=5, cap=200)
    assert n == 5     # p1, p2 ("ai" in "said"), p3, p5, p7; p4 flagged, copies and p6 dropped
    m = {r["source_id"]: r["matched_term"] for r in
         spark.read.json(str(tmp_path / "matched")).collect()}
    assert m == {"p1": "NVIDIA", "p2": "ai", "p3": "cuda", "p5": "Gaming", "p7": "ai"}
    row = spark.read.json(str(tmp_path / "matched")).where("source_id = 'p1'").first()
    assert (row["platform"], row["subreddit"], row["title"], row["score"], row["post_url"]) == \
        ("reddit", "stocks", "NVIDIA is good", 1, "u")

    k = jobs.score_posts_job(spark, str(tmp_path / "matched"), str(tmp_path / "scored"),
                             {"good": 2.0, "bad": -2.0})
    assert k == 5
    rep = jobs.report_job(spark, str(tmp_path / "scored"), str(tmp_path / "report"),
                          group_col="match_term")
    overall = {str(r["day"]): r["n_posts"] for r in rep.where("report_group IS NULL").collect()}
    assert sum(overall.values()) == 5
    assert os.path.isdir(tmp_path / "report/daily_sentiment_stats/report_group=__overall__")


def test_news_labels_merge(spark, tmp_path):
    raw = [{"ticker": "nvda", "date": "2026-02-16", "title": "Up", "link": "https://a",
            "summary": "good"},
           {"ticker": "amd", "date": "2026-02-16", "title": "Up", "link": "https://a",
            "summary": "good"},
           {"ticker": "nvda", "date": "2026-02-17", "title": "   ", "link": None,
            "summary": ""}]
    _write(str(tmp_path / "raw/yahoo_news_2026-02-10_2026-02-17.jsonl"),
           "\n".join(json.dumps(x) for x in raw))
    n = jobs.score_news_job(spark, str(tmp_path / "raw"), str(tmp_path / "news"), hashed_bag())
    assert n == 3
    news = {(r["ticker"], r["date"]): r for r in
            read_jsonl(spark, str(tmp_path / "news"), SCORED).collect()}
    blank = news[("NVDA", "2026-02-17")]
    assert (blank["neg"], blank["neu"], blank["pos"]) == (0.0, 1.0, 0.0)
    assert news[("AMD", "2026-02-16")]["id"].endswith(":AMD")

    prices = [{"date": f"2026-01-{d:02d}T00:00:00.000Z", "adjOpen": 1, "adjHigh": 1,
               "adjLow": 1, "adjClose": 100 + d, "adjVolume": 1} for d in range(1, 26)]
    prices += [{"date": "2026-02-16T00:00:00.000Z", "adjOpen": 1, "adjHigh": 1,
                "adjLow": 1, "adjClose": 130, "adjVolume": 1}]
    _write(str(tmp_path / "px.json"), json.dumps(prices))
    lab = jobs.labels_job(spark, str(tmp_path / "px.json"), "NVDA", str(tmp_path / "labels"))
    assert lab.where(F.col("rv").isNotNull()).count() == 6

    # social rows carry entity names and a weekend's date
    _write(str(tmp_path / "social/s.jsonl"), json.dumps(
        {"id": "x", "ticker": "Nvidia", "date": "2026-02-14", "neg": 0.0, "neu": 0.5,
         "pos": 0.5, "compound": 0.4}))
    args = (spark, str(tmp_path / "social"), str(tmp_path / "news"), str(tmp_path / "labels"), str(tmp_path / "merged"))
    merged = jobs.merge_job(*args, how="inner", names=["Nvidia", "Intel"], symbols=["NVDA", "INTC"])
    rows = merged.collect()
    assert len(rows) == 1 and rows[0]["ticker"] == "NVDA" and str(rows[0]["date"]) == "2026-02-16"
    with pytest.raises(Exception, match="already exists"):
        jobs.merge_job(*args)


def test_news_fields(spark, tmp_path):
    raw = [{"symbol": "nvda", "date": "2026-02-16", "title": "T", "article_url": "https://a", "description": " d", "text": "body "}]
    _write(str(tmp_path / "raw/yahoo_news_2026.jsonl"), json.dumps(raw[0]))
    seen = spark.sparkContext.accumulator(0)

    def factory():
        def score(texts):
            seen.add(sum(t == "T d body" for t in texts))
            return [[0.0, 0.0, 0.0]] * len(texts)
        return score

    assert jobs.score_news_job(spark, str(tmp_path / "raw"), str(tmp_path / "out"), factory) == 1
    r = read_jsonl(spark, str(tmp_path / "out"), SCORED).first()
    assert (r["ticker"], r["permalink"]) == ("NVDA", "https://a") and seen.value >= 1


def test_prices_of_many_tickers(spark, tmp_path):
    for t, base in (("nvda", 100), ("AMD", 50)):
        px = [{"date": f"2026-01-{d:02d}T00:00:00.000Z", "adjClose": base + d % 3} for d in range(1, 26)]
        _write(str(tmp_path / f"px/{t}.json"), json.dumps(px, indent=1))
    _write(str(tmp_path / "vix.json"), json.dumps([{"Date": "2026-01-25", "Close": 17.5}], indent=1))
    lab = jobs.labels_job(spark, str(tmp_path / "px"), None, str(tmp_path / "labels"), vix_path=str(tmp_path / "vix.json"))
    got = {(r["ticker"], str(r["date"])): r["index_close"] for r in lab.where("date >= '2026-01-24'").collect()}
    assert got == {("NVDA", "2026-01-24"): None, ("NVDA", "2026-01-25"): 17.5,
                   ("AMD", "2026-01-24"): None, ("AMD", "2026-01-25"): 17.5}


def test_entity_map_of_any_layout(spark, tmp_path):
    m = {"Nvidia": ["cuda", "ai"], "Intel": [], "AMD": None}
    _write(str(tmp_path / "m/keywords.json"), json.dumps(m, indent=2))
    rows = [(r["entity"], r["ord"], r["term"]) for r in read_entity_terms(spark, str(tmp_path / "m/keywords.json")).collect()]
    assert rows == [("Nvidia", 0, "cuda"), ("Nvidia", 1, "ai")]
    terms = spark.createDataFrame([("b", 1, "y"), ("b", 0, "x"), ("a", 0, "z")], "entity string, ord int, term string")
    write_entity_terms(terms, str(tmp_path / "out"))
    files = [f for f in os.listdir(tmp_path / "out") if f.startswith("part-")]
    assert [json.load(open(tmp_path / "out" / f)) for f in files] == [{"a": ["z"], "b": ["x", "y"]}]


def test_cli(spark, tmp_path, capsys):
    from moodgauge.__main__ import main
    resp = [{"entity": "NVDA", "run": r, "attempt": 1, "text": "AMD INTC QCOM and NVDA"}
            for r in range(4)]
    _write(str(tmp_path / "resp/r.jsonl"), "\n".join(json.dumps(x) for x in resp))
    main(["consensus-terms", "--responses", str(tmp_path / "resp"), "--out",
          str(tmp_path / "peers"), "--k", "6", "--kind", "peers"])
    assert json.loads(capsys.readouterr().out.strip().splitlines()[-1]) == \
        {"cmd": "consensus-terms", "terms": 3}
    got = [r["term"] for r in read_entity_terms(spark, str(tmp_path / "peers")).orderBy("ord").collect()]
    assert got == ["AMD", "INTC", "QCOM"]
