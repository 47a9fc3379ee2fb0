"""Model stage (M1-M5): pipeline save/load, prediction, time split."""

import datetime as dt

from pyspark.ml import PipelineModel
from pyspark.sql import functions as F

from moodgauge.operators import model, scoring


def _data(spark):
    rows = []
    for t, a in (("A", 2.0), ("B", -1.0)):
        for i in range(30):
            x = float(i)
            rows.append((t, dt.date(2024, 1, 1) + dt.timedelta(days=i), x, a * x + 1.0))
    return spark.createDataFrame(rows, "ticker string, date date, x double, y double")


def test_fit_save_load_predict(spark, tmp_path):
    df = _data(spark).where(F.col("ticker") == "A")
    m = model.fit(df, ["x"], "y")
    p = str(tmp_path / "m")
    m.write().overwrite().save(p)
    back = PipelineModel.load(p)
    pred = model.predict(back, df, str(tmp_path / "pred"))
    err = pred.select(F.max(F.abs(F.col("prediction") - F.col("y")))).first()[0]
    assert err < 1e-6
    assert spark.read.parquet(str(tmp_path / "pred")).count() == 30


def test_per_ticker_fit_and_evaluate(spark):
    df = _data(spark)
    coef = {r["ticker"]: (r["slope"], r["intercept"]) for r in
            model.fit_per_ticker(df, "x", "y").collect()}
    assert abs(coef["A"][0] - 2.0) < 1e-9 and abs(coef["B"][1] - 1.0) < 1e-9
    ev = model.evaluate(model.apply_linear(df, model.fit_per_ticker(df, "x", "y"), "x"),
                        "y", "y_hat", ["ticker"])
    for r in ev.collect():
        assert r["mae"] < 1e-9 and abs(r["r2"] - 1.0) < 1e-9


def test_time_split_no_overlap(spark):
    s = model.time_split(_data(spark), "date", 0.8)
    tr = s.where("split = 'train'").agg(F.max("date")).first()[0]
    te = s.where("split = 'test'").agg(F.min("date")).first()[0]
    assert tr < te
    assert s.where("split = 'train'").select("date").distinct().count() == 24


def _bag_brute(texts, labelled):
    import math
    import re
    find = lambda t: re.findall(r"[^\W_]+", (t or "").lower())
    classes = ("positive", "negative", "neutral")
    total = [sum(k == c for _, k in labelled) for c in classes]
    words = {w for t, _ in labelled for w in find(t)}
    weight = {w: [math.log((sum(k == c and w in find(t) for t, k in labelled) + 1) / (n + 2))
                  for c, n in zip(classes, total)] for w in words}
    out = []
    for t in texts:
        at = [weight[w] for w in find(t) if w in weight]
        z = [math.exp(sum(x) / len(x)) for x in zip(*at)] if at else [1.0] * 3
        p, g, u = (0, 0, 1) if not (t or "").strip() else [x / sum(z) for x in z]
        out.append((round(p, 9), round(g, 9), round(u, 9)))
    return out


def test_every_word_of_the_labelled_texts_weighs(spark):
    labelled = [(f"common{j} words of text {i}", ("positive", "neutral")[i % 2]) for i in range(30) for j in range(4)]
    labelled += [(f"zzrare{i} slur", "negative") for i in range(6_000)]      # more words than any fixed table
    known = spark.createDataFrame(labelled, "text string, kind string")
    weights = scoring.fit_bag_weights(known, "kind")
    assert weights.where("word = 'zzrare5999'").count() == 1
    assert weights.count() == 6_000 + 1 + 4 + 3 + 30
    small = labelled[:80] + [("zzrare7 slur slur", "negative")]
    texts = ["zzrare7 here", "words of zzrare7 slur slur", "", None, "\t \n", "unknown", "common1 common1 TEXT", "unknown"]
    docs = spark.createDataFrame(list(enumerate(texts)) + [(0, texts[0])], "doc_id long, text string").repartition(3)
    weights = scoring.fit_bag_weights(spark.createDataFrame(small, "text string, kind string"), "kind")
    want = sorted(zip([*range(len(texts)), 0], _bag_brute(texts + texts[:1], small)))
    for ceiling in (100_000, 3):        # broadcast, shuffle
        got = scoring.bag_score(docs, weights, max_broadcast_rows=ceiling).collect()
        assert sorted((r["doc_id"], (round(r["pos"], 9), round(r["neg"], 9), round(r["neu"], 9))) for r in got) == want
