"""Quality scores learned from preference pairs (Bradley-Terry).

Labelled texts of the better label are preferred to those of the other one. A
text's strength is a weighted sum of features of its words, lines and
characters; the chance that one text is preferred to another is the logistic
of their difference in strength. So the weights are a logistic regression on
feature differences of pairs, without an intercept.

A text is accepted if its strength is at or above a quantile of the strengths
of the labelled texts: the share of the other label among them, so as many
are turned down as the labels say. The score is the chance that the text is
preferred to one at that quantile: 0.5 and more is above it.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from moodgauge.llm.common import checked_small, map_arrow, written
from moodgauge.llm.quality import measure_texts
from moodgauge.llm.words import blocks, mix
from moodgauge.session import ensure_checkpoint_dir, key_filter

MAX_BROADCAST = 250_000     # narrow rows
PARTNERS = 4                # pairs of each text of the more common label
REGULARISATION = 1e-4

# bytes whose share of a text is a feature
_CLASSES = {
    "upper": range(0x41, 0x5B), "digits": range(0x30, 0x3A), "symbols": b"#*$%&|<>", "bars": b"|", "marks": b"!?",
    "stops": b".,;:", "brackets": b"(){}[]=_/\\\"'@~^`+", "lines": b"\n", "wide": range(0x80, 0x100),
}
# shares up to these bounds count, besides the whole share
_STEPS = (0.01, 0.05, 0.2)
_WORD_STEPS = (5, 20, 50, 200)

FEATURES = (
    [f"{c}_{s}" for c in _CLASSES for s in ("share", *_STEPS)]
    + ["log_words", *[f"words_{n}" for n in _WORD_STEPS], "word_chars", "word_chars_4", "word_chars_8"]
    + [f"{m}_{s}" for m in ("repeated", "same_lines", "distinct", "upper_words") for s in ("share", 0.1, 0.5)]
    + ["line_words", "stop_words"]
)


def _flags(members) -> np.ndarray:
    out = np.zeros(256, bool)
    out[list(members)] = True
    return out


_TABLES = {c: _flags(m) for c, m in _CLASSES.items()}


def features(column) -> np.ndarray:
    """(texts, FEATURES) of a column of texts, whole texts; nulls are empty."""
    out = np.zeros((len(column), len(FEATURES)))
    col = {f: i for i, f in enumerate(FEATURES)}
    m = measure_texts(column)
    words = m["n_words"]
    some = np.maximum(words, 1)

    def steps(name, share):
        out[:, col[f"{name}_share"]] = np.sqrt(share)
        for s in (x for x in (*_STEPS, 0.1, 0.5) if f"{name}_{x}" in col):
            out[:, col[f"{name}_{s}"]] = np.minimum(share, s) / s

    counts = {c: np.zeros(len(column)) for c in _CLASSES}
    chars, distinct, upper_words = np.zeros(len(column)), np.zeros(len(column)), np.zeros(len(column))
    for b in blocks(column):
        rows = slice(b.first, b.first + b.n_texts)
        chars[rows] = np.diff(b.offsets)
        for c, table in _TABLES.items():
            counts[c][rows] = b.count(table[b.data])
        text = b.text_of_word()
        key = np.unique(mix(b.word_hash(lower=True) ^ (text.astype(np.uint64) << np.uint64(40))), return_index=True)[1]
        distinct[rows] = np.bincount(text[key], minlength=b.n_texts)
        # words without a small letter and with two capitals or more
        upper = np.concatenate([[0], np.cumsum(_TABLES["upper"][b.data])])
        lower = np.concatenate([[0], np.cumsum((b.data >= 0x61) & (b.data <= 0x7A))])
        loud = (upper[b.ends] - upper[b.starts] >= 2) & (lower[b.ends] == lower[b.starts])
        upper_words[rows] = np.bincount(text[loud], minlength=b.n_texts)
    for c in _CLASSES:
        steps(c, counts[c] / np.maximum(chars, 1))
    out[:, col["log_words"]] = np.log1p(words)
    for n in _WORD_STEPS:
        out[:, col[f"words_{n}"]] = np.minimum(words, n) / n
    mean = m["word_chars"] / some
    out[:, col["word_chars"]] = np.log1p(mean)
    out[:, col["word_chars_4"]] = np.minimum(mean, 4) / 4
    out[:, col["word_chars_8"]] = np.minimum(mean, 8) / 8
    steps("repeated", m["n_repeat_words"] / some)
    steps("same_lines", m["n_dup_lines"] / (counts["lines"] + 1))
    # the share of distinct words falls with the length of a text
    steps("distinct", np.log1p(distinct) / np.maximum(np.log1p(words), 1))
    steps("upper_words", upper_words / some)
    out[:, col["line_words"]] = np.log1p(words / (counts["lines"] + 1))
    out[:, col["stop_words"]] = np.log1p(words / (counts["stops"] + 1))
    return out


# --------------------------------------------------------------------------
# Fit and score
# --------------------------------------------------------------------------

@dataclass
class Ranking:
    """Weights of FEATURES and the strength at the accepted quantile; without
    weights every text scores ``threshold``'s share."""

    weights: np.ndarray | None
    threshold: float

    def scores(self, column) -> np.ndarray:
        if self.weights is None:
            return np.full(len(column), self.threshold)
        strength = features(column) @ self.weights - self.threshold
        return 1 / (1 + np.exp(-np.clip(strength, -700, 700)))


def sampled_labels(labels: DataFrame, id_col: str = "doc_id", label_col: str = "quality",
                   most: int | None = None) -> DataFrame:
    """(id, label, weight): every id of the labels 0 and 1, each of weight 1;
    or, if the caller gives ``most``, about so many of each label, chosen by a
    hash of the id, and how many ids each stands for. Null ids, other labels
    and repeated rows don't count."""
    own = labels.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("int").alias("label"))
    own = own.where("id is not null and label in (0, 1)").distinct()
    if most is None:
        return own.withColumn("weight", F.lit(1.0))
    n = {r["label"]: r["n"] for r in own.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}
    rate = {k: min(1.0, most / v) for k, v in n.items()}
    place = F.pmod(F.xxhash64(F.lit("sample"), "id"), F.lit(1_000_000))
    keep, weight = F.lit(0.0), F.lit(1.0)
    for k, r in rate.items():
        keep = F.when(F.col("label") == k, F.lit(r * 1e6)).otherwise(keep)
        weight = F.when(F.col("label") == k, F.lit(1 / r)).otherwise(weight)
    return own.where(place < keep).withColumn("weight", weight)


def labelled_features(docs: DataFrame, sample: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Written table (label, weight, key, x) of the distinct labelled texts;
    equal texts of a label are one row. Texts stay where they are: those that
    have no label are left out by a filter of the ids, and the features of
    the others, not their texts, meet the labels."""
    sample = written(sample, "labels")
    src = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    src = src.where(F.col("id").isNotNull() & key_filter(sample, "id")(F.col("id"))).select(
        "id", F.xxhash64(F.coalesce("text", F.lit(""))).alias("key"), "text")

    def run(batch: pa.RecordBatch):
        x = features(batch.column("text"))
        at = np.arange(0, x.size + 1, x.shape[1])
        yield {**{c: batch.column(c) for c in ("id", "key")},
               "x": pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(x.ravel()))}

    rows = map_arrow(src, run, "id long, key long, x array<double>").join(checked_small(sample, MAX_BROADCAST), "id")
    return written(rows.groupBy("label", "key").agg(F.sum("weight").alias("weight"), F.first("x").alias("x")), "labelled")


def preference_pairs(rows: DataFrame, partners: int = PARTNERS) -> DataFrame:
    """(win, lose): feature rows of pairs of a text of label 1 and one of
    label 0. In each of ``partners`` rounds both fall into seeded hash
    buckets, as many as there are texts of the rarer label, and meet there:
    every text has about as many partners as rounds, or more if it is of the
    rarer label, and no bucket is large as the texts are distinct."""
    n = {r["label"]: r["n"] for r in rows.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}
    buckets = max(1, min(n.get(0, 0), n.get(1, 0)))
    turns = F.explode(F.sequence(F.lit(1), F.lit(partners))).alias("turn")

    def side(label, name):
        own = rows.where(F.col("label") == label).select("key", F.col("x").alias(name), turns)
        return own.select(name, "turn", F.pmod(F.xxhash64("turn", F.lit(label), "key"), F.lit(buckets)).alias("bucket"))

    return side(1, "win").join(side(0, "lose"), ["turn", "bucket"]).select("win", "lose")


BINS, FEW_VALUES = 4096, 10_000


def weighted_percentile(rows: DataFrame, share: float) -> float:
    """What ``percentile(x, share, n)`` gives over ``rows`` (x, n), without
    all values in one task: the range that holds the rank is cut into bins,
    whose sums come to the driver, until few values are in it."""
    lo, hi, total = rows.agg(F.min("x"), F.max("x"), F.sum("n")).first()
    place = (total - 1) * share
    first, last = int(np.floor(place)), int(np.ceil(place))
    below, many = 0, rows.count()
    while many > FEW_VALUES and lo < hi:
        width = (hi - lo) / BINS
        if not lo + width > lo:
            break       # neighbouring numbers
        bins = rows.where(F.col("x").between(lo, hi)).groupBy(
            F.least(F.floor((F.col("x") - lo) / width), F.lit(BINS - 1)).alias("b")).agg(
            F.sum("n").alias("w"), F.count(F.lit(1)).alias("rows"), F.min("x").alias("lo"), F.max("x").alias("hi")).orderBy("b").collect()
        upto = below + np.cumsum([r["w"] for r in bins])
        a, z = np.searchsorted(upto, [first, last], side="right")
        if a < z:       # the two ranks lie on both sides of a bin's end
            return (last - place) * bins[a]["hi"] + (place - first) * bins[z]["lo"]
        below, lo, hi, many = (upto[a - 1] if a else below), bins[a]["lo"], bins[a]["hi"], bins[a]["rows"]
    # equal values are one row; the loop left few different ones
    values = rows.where(F.col("x").between(lo, hi)).groupBy("x").agg(F.sum("n").alias("w")).orderBy("x").collect()
    upto = below + np.cumsum([r["w"] for r in values])
    x, y = (values[i]["x"] for i in np.searchsorted(upto, [first, last], side="right"))
    return x if x == y else (last - place) * x + (place - first) * y


def _differences(batch: pa.RecordBatch):
    win, lose, turned = (batch.column(c) for c in ("win", "lose", "turned"))
    turned = turned.to_numpy()
    n = np.diff(win.offsets.to_numpy())
    x = (win.flatten().to_numpy() - lose.flatten().to_numpy()) * np.repeat(1.0 - 2.0 * turned, n)
    at = np.concatenate([[0], np.cumsum(n)])
    yield {"label": 1.0 - turned, "x": pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(x))}


def fit(rows: DataFrame) -> Ranking:
    """Ranking learned from ``labelled_features``. Without texts of both
    labels there are no pairs, and every text scores the share of label 1
    (one half without any)."""
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.functions import array_to_vector
    share = {r["label"]: (r["w"], r["n"]) for r in rows.groupBy("label").agg(
        F.sum("weight").alias("w"), F.count(F.lit(1)).alias("n")).collect()}
    worse, better = share.get(0, (0, 0))[0], share.get(1, (0, 0))[0]
    if not worse or not better:
        return Ranking(None, 0.5 if worse == better else better / (worse + better))
    # a pair turned round has the opposite label; the halves balance
    pairs = preference_pairs(rows).select("win", "lose", F.pmod(F.xxhash64("win", "lose"), F.lit(2)).cast("int").alias("turned"))
    pairs = written(map_arrow(pairs, _differences, "label double, x array<double>"), "pairs")
    pairs = pairs.select("label", array_to_vector("x").alias("features"))
    weights = LogisticRegression(fitIntercept=False, standardization=True, regParam=REGULARISATION,
                                 maxIter=100, tol=1e-6).fit(pairs).coefficients.toArray()
    weights = np.round(weights, 6)
    dot = F.aggregate(F.zip_with("x", F.lit(weights.tolist()), lambda a, b: a * b), F.lit(0.0), lambda s, v: s + v)
    # half way between the last text turned down and the first accepted
    cut = (worse - 0.5) / max(worse + better - 1, 1)
    strengths = written(rows.select(dot.alias("x"), F.greatest(F.lit(1), F.round("weight")).cast("long").alias("n")), "strengths")
    return Ranking(weights, float(weighted_percentile(strengths, min(max(cut, 0.0), 1.0))))


def score_documents(docs: DataFrame, ranking: Ranking, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: ``id_col`` and score (0 to 1, higher is
    better). Null and empty texts have the features of an empty text; ids may
    be null or repeated; other columns are not read. Row-local: whole texts,
    a task holds one Arrow batch."""
    src = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))

    def run(batch: pa.RecordBatch):
        yield {"id": batch.column("id"), "score": ranking.scores(batch.column("text"))}

    out = map_arrow(src, run, f"id {src.schema['id'].dataType.simpleString()}, score double")
    return out.withColumnRenamed("id", id_col) if id_col != "id" else out


def rank_quality(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                 label_col: str = "quality") -> DataFrame:
    """``score_documents`` of ``docs`` by a ranking learned from ``labels``
    (``id_col``, ``label_col``) of some of them."""
    ensure_checkpoint_dir(docs.sparkSession)
    rows = labelled_features(docs, sampled_labels(labels, id_col, label_col), id_col, text_col)
    return score_documents(docs, fit(rows), id_col, text_col)
