"""Hand-made edge tables (FIXTURES.md section 3), a few rows each."""

import datetime as dt
import math

import numpy as np
from pyspark.sql import functions as F

from scorers import hashed_bag
from moodgauge.functions import time as tm
from moodgauge.operators import (consensus, dedup, features, filters, market,
                                 match, scoring)


def _terms(spark, d):
    rows = [(e, i, t) for e, ts in d.items() for i, t in enumerate(ts)]
    return spark.createDataFrame(rows, "entity string, ord int, term string")


def _match(spark, method):
    docs = spark.createDataFrame([
        (1, "He said so"),
        (2, "Buy $NVIDIA now"),
        (3, "mention of mentor"),
        (4, "AMD rocks"),
        (5, "   "),
        (6, None),
    ], "doc_id long, text string")
    terms = _terms(spark, {"Nvidia": ["ai", "cuda"], "Intel": ["ment", "men"], "AMD": [""]})
    out = match.match_entities(docs, terms, "text", k=5, method=method)
    return {(r["doc_id"], r["entity"]): r["matched_term"] for r in out.collect()}


def test_term_hits_substring(spark):
    got = _match(spark, "theta")
    assert got[(1, "Nvidia")] == "ai"            # "ai" inside "said"
    assert got[(2, "Nvidia")] == "$NVIDIA"       # leftmost hit, as written
    assert got[(3, "Intel")] == "ment"           # equal position: earlier term
    assert got[(4, "AMD")] == "AMD"              # name without keywords
    assert not any(k[0] in (5, 6) for k in got)  # blank / null text never match
    assert _match(spark, "regex") == got
    assert _match(spark, "grams") == got


def test_term_hits_token(spark):
    got = _match(spark, "token")
    assert (1, "Nvidia") not in got              # whole words only
    assert got[(2, "Nvidia")] == "$NVIDIA"     # as written
    assert got[(4, "AMD")] == "AMD"


def test_theta_chunked_plan_equals_single_broadcast(spark):
    docs = spark.createDataFrame([(1, "cuda and graphics"), (2, "ai said"), (3, "nothing")],
                                 "doc_id long, text string")
    terms = _terms(spark, {"Nvidia": ["cuda", "ai"], "Intel": ["graphics"], "Arm": ["said"]})
    one = match.match_entities(docs, terms, "text", method="theta")
    many = match.match_entities(docs, terms, "text", method="theta", max_broadcast_rows=2)
    key = lambda df: sorted((r["doc_id"], r["entity"], r["matched_term"]) for r in df.collect())  # noqa
    assert key(one) == key(many)


def test_cap_order(spark):
    df = spark.createDataFrame([("a", 5), ("b", 1), ("c", 4), ("d", 2), ("e", 3)],
                               "id string, ord int").withColumn("k", F.lit("x"))
    got = [r["id"] for r in dedup.topk_per_key(df, ["k"], ["ord"], 3).orderBy("ord").collect()]
    assert got == ["b", "d", "e"]


def test_dedupe_first_drops_null_keys(spark):
    df = spark.createDataFrame([(1, "a"), (2, "a"), (3, None), (0, "b")], "o int, key string")
    got = sorted((r["o"], r["key"]) for r in dedup.dedupe_first(df, "key", ["o"]).collect())
    assert got == [(0, "b"), (1, "a")]


def test_consensus_ties_and_rejections(spark):
    resp = spark.createDataFrame([
        ("E", 1, 1, "alpha beta gamma stock"),
        ("E", 2, 1, "beta"),
        ("E", 2, 2, "gamma beta alpha delta"),
        ("E", 3, 1, "x1"),
        ("E", 3, 2, "y1"),
    ], "entity string, run long, attempt long, text string")
    kw = consensus.extract_keywords(resp, k=4)
    words = {(r["run"], r["attempt"]): r["words"] for r in kw.collect()}
    assert words[(1, 1)] == ["alpha", "beta", "gamma"]   # banned word dropped
    acc = consensus.accept_attempt(kw, k=4, floor=3)
    got = {r["run"]: r["attempt"] for r in acc.collect()}
    assert got == {1: 1, 2: 2}                           # run 3 has no accepted attempt
    top = consensus.consensus_topk(acc, k=2).orderBy("rank").collect()
    assert [(r["term"], r["n_runs"]) for r in top] == [("alpha", 2), ("beta", 2)]


def test_accept_with_small_k(spark):
    resp = spark.createDataFrame([("E", 1, 1, "one two")],
                                 "entity string, run long, attempt long, text string")
    acc = consensus.accept_attempt(consensus.extract_keywords(resp, k=2), k=2, floor=3)
    assert acc.count() == 1     # the threshold is capped at k


def test_symbols(spark):
    resp = spark.createDataFrame(
        [("NVDA", 1, 1, "BRK.B and nvda plus ABCDEF and NVDA then ÉAB XÉ AMD, AMD")],
        "entity string, run long, attempt long, text string")
    got = consensus.extract_symbols(resp, k=6).first()["words"]
    assert got == ["BRK.B", "AMD"]


def test_date_window_swapped_inclusive(spark):
    ts = [dt.datetime(2024, 1, 9, 23, 59), dt.datetime(2024, 1, 10, 0, 0),
          dt.datetime(2024, 1, 20, 23, 59, 59), dt.datetime(2024, 1, 21, 0, 0)]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(ts)], "id int, ts timestamp_ntz")
    got = sorted(r["id"] for r in filters.date_window(df, "ts", "2024-01-20", "2024-01-10").collect())
    assert got == [1, 2]


def test_parse_iso_forms(spark):
    df = spark.createDataFrame([("a", "2024-01-01T10:00:00Z"), ("b", "2024-01-01T10:00:00+00:00"),
                                ("c", "2024-01-01T10:00:00"), ("d", ""), ("e", "junk"),
                                ("f", "2024-01-01T10:00:00+02:00"), ("g", None)],
                               "k string, s string")
    got = {r["k"]: r["t"] for r in
           df.select("k", tm.parse_iso("s").cast("timestamp_ntz").alias("t")).collect()}
    ten = dt.datetime(2024, 1, 1, 10, 0)
    assert got["a"] == got["b"] == got["c"] == ten
    assert got["f"] == dt.datetime(2024, 1, 1, 8, 0)
    assert got["d"] is None and got["e"] is None and got["g"] is None


def test_session_roll(spark):
    ticks = spark.createDataFrame([
        (1, "T", dt.datetime(2024, 3, 8, 20, 59)),   # Fri 15:59 EST
        (2, "T", dt.datetime(2024, 3, 8, 21, 0)),    # Fri 16:00 EST -> Sat -> Mon bar
        (3, "T", dt.datetime(2024, 3, 11, 19, 59)),  # Mon 15:59 EDT (after the clock change)
        (4, "T", dt.datetime(2024, 3, 11, 20, 0)),   # Mon 16:00 EDT -> Tue
        (5, "T", dt.datetime(2024, 3, 12, 22, 0)),   # past the last bar
    ], "event_id long, ticker string, ts timestamp_ntz")
    bars = spark.createDataFrame([("T", dt.date(2024, 3, 8)), ("T", dt.date(2024, 3, 11)),
                                  ("T", dt.date(2024, 3, 12))], "ticker string, date date")
    got = {r["event_id"]: (r["session_day"], r["trade_date"]) for r in
           market.session_dates(ticks, bars).collect()}
    d = dt.date
    assert got[1] == (d(2024, 3, 8), d(2024, 3, 8))
    assert got[2] == (d(2024, 3, 9), d(2024, 3, 11))
    assert got[3] == (d(2024, 3, 11), d(2024, 3, 11))
    assert got[4] == (d(2024, 3, 12), d(2024, 3, 12))
    assert got[5] == (d(2024, 3, 13), None)


def test_short_series(spark):
    rng = np.random.default_rng(1)
    rows = []
    for name, n_ret in (("s19", 19), ("s20", 20), ("s21", 21)):
        closes = 100 * np.exp(np.cumsum(rng.normal(0, 0.01, n_ret + 1)))
        rows += [(name, dt.date(2024, 1, 1) + dt.timedelta(days=i), float(c))
                 for i, c in enumerate(closes)]
    bars = spark.createDataFrame(rows, "ticker string, date date, close double")
    rv = market.realized_vol(market.log_returns(bars), n=20, year=252).toPandas()
    n_rv = rv.dropna(subset=["rv"]).groupby("ticker").size().to_dict()
    assert n_rv.get("s19", 0) == 0 and n_rv["s20"] == 1 and n_rv["s21"] == 2
    s20 = rv[rv.ticker == "s20"].sort_values("date")
    expect = np.std(s20.log_ret.dropna().to_numpy(), ddof=1) * math.sqrt(252)
    assert abs(s20.rv.dropna().iloc[0] - expect) < 1e-12
    lab = market.vol_label(market.realized_vol(market.log_returns(bars))).toPandas()
    s21 = lab[lab.ticker == "s21"].sort_values("date")
    assert abs(s21.rv_1d.iloc[-2] - s21.rv.iloc[-1]) < 1e-15


def test_blank_and_equal_logits(spark):
    df = spark.createDataFrame([(1, "   "), (2, None), (3, "some words")], "doc_id long, text string")
    got = {r["doc_id"]: r for r in scoring.model_score(df, "text", "doc_id", hashed_bag()).collect()}
    for i in (1, 2):
        assert (got[i]["neg"], got[i]["neu"], got[i]["pos"], got[i]["compound"]) == (0.0, 1.0, 0.0, 0.0)
    assert abs(got[3]["neg"] + got[3]["neu"] + got[3]["pos"] - 1) < 1e-12
    lg = spark.createDataFrame([(1, 0.3, 0.3, 0.3)], "id int, p double, n double, u double")
    r = scoring.softmax_scores(lg, "p", "n", "u", keep=["id"]).first()
    assert abs(r["pos"] - 1 / 3) < 1e-15 and r["compound"] == 0.0


def test_lexicon_rules(spark):
    lex = {"good": 2.0, "bad": -2.0}
    df = spark.createDataFrame([(1, "very good"), (2, "not good"), (3, "not very good"),
                                (4, ""), (5, "bad day")], "doc_id long, text string")
    got = {r["doc_id"]: r for r in scoring.lexicon_score(df, lex, "doc_id", "text").collect()}
    comp = lambda s: s / math.sqrt(s * s + 15)
    assert abs(got[1]["compound"] - comp(2.293)) < 1e-12
    assert abs(got[2]["compound"] - comp(-1.48)) < 1e-12
    assert abs(got[3]["compound"] - comp(2.293 * -0.74)) < 1e-12
    assert (got[4]["neg"], got[4]["neu"], got[4]["pos"], got[4]["compound"]) == (0, 0, 0, 0)
    # "bad day": neg = |(-2) - 1| / (3 + 1), neu = 1 / 4
    assert abs(got[5]["neg"] - 0.75) < 1e-12 and abs(got[5]["neu"] - 0.25) < 1e-12


def test_duplicate_keys_contract(spark):
    df = spark.createDataFrame([("A", dt.date(2024, 1, 1)), ("A", dt.date(2024, 1, 1)),
                                ("A", dt.date(2024, 1, 2)), (None, dt.date(2024, 1, 2))],
                               "ticker string, date date")
    r = features.check_join_contract(df).first()
    assert (r["n_rows"], r["n_null_key_rows"], r["n_dup_keys"], r["n_dup_rows"]) == (4, 1, 1, 2)


def test_expand_universe_order(spark):
    base = spark.createDataFrame([("nvda", 1), ("amd", 2)], "ticker string, ord int")
    peers = spark.createDataFrame([("nvda", 1, "amd"), ("nvda", 2, "NVDA"), ("nvda", 3, "intc"),
                                   ("amd", 1, "mu")], "entity string, ord int, term string")
    got = [r["ticker"] for r in dedup.expand_universe(base, peers).orderBy("ord").collect()]
    assert got == ["NVDA", "AMD", "INTC", "MU"]


def test_rolling_days_differs_from_rows(spark):
    from moodgauge.operators import report
    daily = spark.createDataFrame([(dt.date(2024, 1, 1), 1.0), (dt.date(2024, 1, 2), 3.0),
                                   (dt.date(2024, 1, 9), 5.0)], "day date, score_std double")
    rows = {r["day"].day: r["score_std_roll"] for r in
            report.rolling_mean(daily, n=5, unit="rows").collect()}
    days = {r["day"].day: r["score_std_roll"] for r in
            report.rolling_mean(daily, n=5, unit="days").collect()}
    assert rows[9] == 3.0 and days[9] is None and rows[2] == days[2] == 2.0


def test_weekly_and_monthly_bars(spark):
    ticks = spark.createDataFrame([
        ("T", dt.datetime(2024, 1, 1, 10), 1.0),   # Monday
        ("T", dt.datetime(2024, 1, 3, 10), 3.0),
        ("T", dt.datetime(2024, 1, 7, 10), 2.0),   # Sunday, same week
        ("T", dt.datetime(2024, 1, 8, 10), 5.0),   # next week
    ], "ticker string, ts timestamp_ntz, price double")
    w = {r["date"]: r for r in market.ohlc_bars(ticks, freq="week").collect()}
    r = w[dt.date(2024, 1, 1)]
    assert (r["open"], r["high"], r["low"], r["close"], r["volume"]) == (1.0, 3.0, 1.0, 2.0, 3)
    assert w[dt.date(2024, 1, 8)]["volume"] == 1
    m = market.ohlc_bars(ticks, freq="month").collect()
    assert len(m) == 1 and m[0]["close"] == 5.0


def test_approximate_median_and_quartiles_close(spark):
    from moodgauge.operators import report
    ev = spark.read.parquet("/root/testdata/sf0.01/events.parquet")
    ex = {r["day"]: r["score_median"] for r in
          report.daily_stats(ev, "ts", "value", "event_id").collect()}
    ap = {r["day"]: r["score_median"] for r in
          report.daily_stats(ev, "ts", "value", "event_id", median="approx").collect()}
    assert ex.keys() == ap.keys()
    assert max(abs(ex[d] - ap[d]) for d in ex) < 1.0     # values span ~0-100
    bx = report.boxplot_summary(ev, "ts", "value", 14, "event_type", "event_id", exact=False)
    assert bx.count() == 70
