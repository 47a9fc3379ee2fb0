"""Quality ranking: held-out accuracy, pairs and defined cases."""

import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from moodgauge.llm import preference as pf
from moodgauge.llm.quality import measure_texts
from texts import prose


@pytest.fixture(scope="module")
def labelled(spark):
    rng = random.Random(23)
    rows = []
    for i in range(600):
        n = rng.randrange(30, 200)
        if i % 4:
            rows.append((i, prose(rng, n).replace(" w1", ". W1"), 1))
        else:
            bad = [lambda: " ".join(x.upper() + "!!" for x in prose(rng, n).split()), lambda: " | ".join(prose(rng, n).split()),
                   lambda: prose(rng, 3), lambda: " ".join([prose(rng, 2)] * n)]
            rows.append((i, rng.choice(bad)(), 0))
    rows += [(1000, None, 0), (1001, "", 0), (None, "without id", 1), (1002, rows[1][1], 1)]
    docs = spark.createDataFrame([(i, t, "x", 0.0, 1) for i, t, _ in rows], "doc_id long, text string, key string, score double, label int")
    labels = spark.createDataFrame([(i, q, "y") for i, _, q in rows] + [(1, 1, "y"), (2, None, "y"), (5000, 1, "y"), (3, 7, "y")],
                                   "doc_id long, quality int, text string")
    return docs.repartition(4), labels, rows


def test_held_out_accuracy(spark, labelled):
    docs, labels, rows = labelled
    held = F.crc32(F.col("doc_id").cast("string")) % 3 == 1
    got = {r.doc_id: r.score for r in pf.rank_quality(docs, labels.where(~held)).collect()}
    assert len(got) == len(rows) and all(0 <= s <= 1 for s in got.values())
    out = [(got[i] >= 0.5) == (q == 1) for i, _, q in rows if i is not None and zlib.crc32(str(i).encode()) % 3 == 1]
    assert np.mean(out) >= 0.97
    assert got[1000] == got[1001]


def test_held_out_labels_are_no_input(spark, labelled):
    docs, labels, _ = labelled
    held = F.crc32(F.col("doc_id").cast("string")) % 3 == 1
    other = labels.withColumn("quality", F.when(held, 1 - F.col("quality")).otherwise(F.col("quality")))
    a = {r.doc_id: r.score for r in pf.rank_quality(docs, labels.where(~held)).collect()}
    b = {r.doc_id: r.score for r in pf.rank_quality(docs, other.where(~held)).collect()}
    assert all(abs(a[i] - b[i]) < 1e-4 for i in a)


def test_pairs_and_sample(spark, labelled):
    docs, labels, rows = labelled
    sample = pf.sampled_labels(labels)
    assert {(r.id, r.label) for r in sample.collect()} == {(i, q) for i, _, q in rows if i is not None} | {(5000, 1)}
    few = pf.sampled_labels(labels, most=100).collect()
    assert 60 <= sum(r.label == 1 for r in few) <= 140 and len({r.weight for r in few}) == 2
    own = pf.labelled_features(docs, sample)
    bad, good = own.where("label = 0").count(), own.where("label = 1").count()
    pairs = pf.preference_pairs(own).count()
    assert 0.7 * pf.PARTNERS * good < pairs < 1.4 * pf.PARTNERS * good
    # equal texts of a label are one row; the empty text and null too
    assert good == len({t for i, t, q in rows if q == 1 and i is not None}) and bad < len([1 for *_, q in rows if q == 0])


def test_strength_is_learned_from_differences(spark):
    """Weights equal a plain gradient descent on the same pairs."""
    rng = np.random.default_rng(2)
    x = rng.normal(0, 1, (120, 3))
    y = (x @ [2.0, -1.0, 0.0] + rng.normal(0, 1.5, 120) > 0).astype(int)
    rows = spark.createDataFrame([(int(c), i, 1.0, v.tolist()) for i, (c, v) in enumerate(zip(y, x))],
                                 "label int, key long, weight double, x array<double>")
    got = pf.fit(rows)
    pairs = [(np.array(r.win), np.array(r.lose)) for r in pf.preference_pairs(rows).collect()]
    d = np.array([a - z for a, z in pairs])
    w = np.zeros(3)
    for _ in range(20000):
        w += 0.5 * (d.T @ (1 / (1 + np.exp(d @ w)))) / len(d)
    assert np.allclose(got.weights, w, atol=0.05)     # the fit has a small penalty
    strength = np.sort(x @ got.weights)
    worse = int((y == 0).sum())
    assert strength[worse - 1] < got.threshold < strength[worse]


@pytest.mark.parametrize("labels,share", [([], 0.5), ([1, 1], 1.0), ([0], 0.0)])
def test_without_pairs(spark, labels, share):
    rows = spark.createDataFrame([(c, i, 1.0, [0.0]) for i, c in enumerate(labels)], "label int, key long, weight double, x array<double>")
    model = pf.fit(rows)
    assert model.weights is None and model.scores(pa.array(["a", None])).tolist() == [share, share]


def test_features_of_whole_texts(corpus):
    texts = [t for _, t in corpus]
    got = pf.features(pa.array(texts, pa.string()))
    assert got.shape == (len(texts), len(pf.FEATURES)) and np.isfinite(got).all()
    col = {f: i for i, f in enumerate(pf.FEATURES)}
    n = measure_texts(pa.array(texts, pa.string()))["n_words"]
    assert np.allclose(got[:, col["log_words"]], np.log1p(n))
    for t, x in zip(texts, got):
        raw = (t or "").encode()
        share = sum(0x41 <= c <= 0x5A for c in raw) / max(len(raw), 1)
        assert np.isclose(x[col["upper_share"]], share ** 0.5) and np.isclose(x[col["upper_0.05"]], min(share, 0.05) / 0.05)


def test_empty_tables(spark, no_docs):
    labels = spark.createDataFrame([], "doc_id long, quality int")
    assert pf.rank_quality(no_docs, labels).count() == 0


def test_every_labelled_text_is_learned_from(spark):
    n = 45_000
    docs = spark.range(n).select(F.col("id").alias("doc_id"), F.concat(F.lit("text "), F.col("id").cast("string")).alias("text"))
    labels = spark.range(0, n, 2).select(F.col("id").alias("doc_id"), F.lit(1).alias("quality"))
    rows = pf.labelled_features(docs, pf.sampled_labels(labels))
    assert rows.count() == n // 2 and rows.agg(F.sum("weight")).first()[0] == n // 2


@pytest.mark.parametrize("share", [0.0, 0.013, 0.5, 0.77777, 1.0])
def test_percentile_without_a_table_of_all_values(spark, share, monkeypatch):
    monkeypatch.setattr(pf, "FEW_VALUES", 50)
    rng = np.random.default_rng(5)
    x = np.concatenate([rng.normal(0, 1, 1500), rng.lognormal(0, 4, 1000), np.repeat(0.25, 800)])
    rows = spark.createDataFrame([(float(v), int(w)) for v, w in zip(x, rng.integers(1, 5, len(x)))], "x double, n long")
    two = spark.range(200).select((F.col("id") % 2).cast("double").alias("x"), F.lit(1).cast("long").alias("n"))
    assert pf.weighted_percentile(two, 0.5) == 0.5
    assert pf.weighted_percentile(rows, share) == pytest.approx(rows.agg(F.percentile("x", share, F.col("n"))).first()[0], rel=1e-12)
