"""One key holding a third of all rows: results stay whole and equal to a
brute-force pandas computation (the plans pre-reduce the hot key on the map
side; see tests/test_plans.py and PLANS.md)."""

import datetime as dt

import numpy as np
import pandas as pd

from moodgauge.operators import consensus, dedup, report

N = 30_000


def _frame(spark):
    rng = np.random.default_rng(7)
    keys = np.where(np.arange(N) % 3 == 0, "HOT", "k" + (rng.integers(0, 500, N)).astype(str))
    days = rng.integers(0, 5, N)
    pdf = pd.DataFrame({
        "id": np.arange(N), "key": keys,
        "date": [str(dt.date(2024, 1, 1) + dt.timedelta(days=int(d))) for d in days],
        "score": np.round(rng.normal(0, 1, N), 4),
    })
    return pdf, spark.createDataFrame(pdf).repartition(12)


def test_hot_key_keep_first_and_cap(spark):
    pdf, df = _frame(spark)
    first = dedup.dedupe_first(df, "key", ["id"]).toPandas().set_index("key")["id"]
    want = pdf.groupby("key")["id"].min()
    assert first.sort_index().equals(want.sort_index())
    top = dedup.topk_per_key(df, ["key"], ["id"], 50).toPandas()
    assert (top[top.key == "HOT"].id.sort_values().tolist()
            == pdf[pdf.key == "HOT"].id.nsmallest(50).sort_values().tolist())
    assert len(top) == pdf.groupby("key").size().clip(upper=50).sum()


def test_hot_group_report(spark):
    pdf, df = _frame(spark)
    rep = report.sentiment_report(df, "date", "score", group="key", id_col="id").toPandas()
    hot = rep[rep.report_group == "HOT"].set_index("day").sort_index()
    g = pdf[pdf.key == "HOT"].groupby("date")["score"]
    assert hot.n_posts.tolist() == g.count().tolist()
    assert np.allclose(hot.score_mean, g.mean().values)
    assert np.allclose(hot.score_std, g.std().values)
    assert np.allclose(hot.score_median, g.median().values)
    overall = rep[rep.report_group.isna()].sort_values("day")
    assert overall.n_posts.sum() == N


def test_hot_entity_consensus(spark):
    rows = [("HOT" if i % 3 == 0 else f"E{i % 7}", i, 1, f"alpha beta w{i % 11} w{i % 13}")
            for i in range(3000)]
    resp = spark.createDataFrame(rows, "entity string, run long, attempt long, text string")
    acc = consensus.accept_attempt(consensus.extract_keywords(resp, k=4), k=4, floor=3)
    top = consensus.consensus_topk(acc, k=2).where("entity = 'HOT'").orderBy("rank").collect()
    assert [(r["term"], r["n_runs"]) for r in top] == [("alpha", 1000), ("beta", 1000)]


def test_exact_quantiles_of_a_hot_day(spark, monkeypatch):
    """One day holds most rows, all values distinct; others are small, tied,
    or one value repeated. Brackets are used for the large ones only."""
    import numpy as np

    from moodgauge.operators import report
    monkeypatch.setattr(report, "_SKETCH", 100)
    rng = np.random.default_rng(3)
    days = {"a": rng.normal(size=30_000), "b": np.repeat([1.0, 2.0, 3.0], 2_000), "c": np.full(1_500, 7.5),
            "d": rng.integers(0, 5, 3_001).astype(float), "e": np.array([4.0]), "f": np.array([1.0, 2.0]), "g": rng.normal(size=1_001)}
    rows = [(d, float(v)) for d, vs in days.items() for v in vs]
    df = spark.createDataFrame(rows, "day string, score double").repartition(6)
    probs = [0.0, 0.25, 0.5, 0.75, 1.0]
    got = {r["day"]: r["q"] for r in report.exact_quantiles(df, ["day"], probs).collect()}
    assert got.keys() == days.keys()
    for d, vs in days.items():
        assert np.allclose(got[d], np.quantile(vs, probs)), d
