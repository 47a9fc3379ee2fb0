"""Text scoring as distributed jobs (H1-H5).

H1 lexicon scoring: tokens (with their three predecessors) are exploded and
hash-joined with the size-checked, broadcast lexicon; the sums are a partial
aggregate per document.

H2 model scoring runs a pluggable scorer in ``mapInArrow`` over Arrow
batches; the scorer is built once per Python worker. A linear bag of words
needs no plug-in: its weight table, of any size, is joined with the tokens.
"""

from __future__ import annotations

import re
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import strip, word_tokens
from ..session import MAX_BROADCAST_ROWS, checked_broadcast, cut_lineage, ship_package

# Fixed values (rule constants from Hutto & Gilbert, ICWSM 2014):
NEGATION_SCALAR = -0.74      # multiplier for a negated word
NORMALIZE_ALPHA = 15.0       # compound = s / sqrt(s^2 + alpha)
BOOST_DECAY = (1.0, 0.95, 0.9)  # weight of a booster 1, 2, 3 words back

# Default negation words and boosters (ours, small).
DEFAULT_NEGATIONS = ["not", "no", "never", "none", "nobody", "nothing",
                     "neither", "nor", "cannot", "without"]
DEFAULT_BOOSTERS = {"very": 0.293, "extremely": 0.293, "really": 0.293,
                    "highly": 0.293, "so": 0.293, "barely": -0.293,
                    "hardly": -0.293, "slightly": -0.293}


def _lit_map(d: dict) -> Column:
    if not d:
        return F.create_map().cast("map<string,double>")
    keys = F.array(*[F.lit(k) for k in d])
    vals = F.array(*[F.lit(float(v)) for v in d.values()])
    return F.map_from_arrays(keys, vals)


def _neighbours(toks: Column) -> Column:
    """``array<struct<t, p1, p2, p3>>``: each token with the three before it
    (null before the start), from shifted copies of the array. No lambda
    reads the outer array, so the expression stays linear in the tokens even
    if the optimizer inlines the token column into a pushed-down filter."""
    n = F.size(toks)
    pad = F.array(*[F.lit(None).cast("string")] * 3)
    ext = F.concat(pad, toks)
    return F.arrays_zip(toks.alias("t"), F.slice(ext, 3, n).alias("p1"),
                        F.slice(ext, 2, n).alias("p2"), F.slice(ext, 1, n).alias("p3"))


def lexicon_score(docs: DataFrame, lexicon, id_col: str = "doc_id",
                  text_col: str = "text", negations: list[str] | None = None,
                  boosters: dict | None = None,
                  max_lexicon_rows: int = MAX_BROADCAST_ROWS) -> DataFrame:
    """H1: ``(id, neg, neu, pos, compound)`` per row of ``docs``.

    Per token ``i`` (lower-cased letter/digit runs): ``v0`` = lexicon
    valence (0 if absent); for a non-zero ``v0`` each booster 1..3 tokens
    back adds ``sign(v0) * b * decay``; a negation word 1..3 tokens back
    multiplies by -0.74. ``s`` = sum; compound = ``s / sqrt(s^2 + 15)``;
    pos / neg / neu = ``sum(v+1 | v>0)``, ``|sum(v-1 | v<0)|`` and the
    count of zero tokens, each over their total. No tokens -> all 0.

    Plan: each token carries its three predecessors (shifted copies of the
    token array, zipped; row-local), tokens are exploded and looked up in the
    lexicon with a broadcast *hash* join (O(1) per token whatever the lexicon
    size; the lexicon is size-checked first, a shuffle join past the
    ceiling), and the per-document sums are a partial aggregate in the same
    stage, so the only shuffle carries one row per document. Booster and
    negation lists are short and are consulted only for lexicon hits. (An
    inline-map variant with higher-order functions measured slower even for a
    12-word lexicon, and a map lookup scans its keys.)
    """
    spark = docs.sparkSession
    boost = _lit_map(DEFAULT_BOOSTERS if boosters is None else boosters)
    negs = F.array(*[F.lit(w) for w in (DEFAULT_NEGATIONS if negations is None else negations)])
    if isinstance(lexicon, dict):
        lex = spark.createDataFrame([(str(k).lower(), float(v)) for k, v in lexicon.items()],
                                    "__t string, __v double")
    else:
        lex = lexicon.select(F.lower(F.col(lexicon.columns[0])).alias("__t"),
                             F.col(lexicon.columns[1]).cast("double").alias("__v"))
    lex_b, _ = checked_broadcast(lex, max_lexicon_rows)
    lex = lex_b if lex_b is not None else lex

    # n_tok is computed before the explode, so the token array is not
    # carried into every exploded row
    # sums are per row, so rows that repeat an id are answered each
    toks = docs.select(F.col(id_col), F.monotonically_increasing_id().alias("__row"),
                       word_tokens(text_col).alias("__toks")) \
               .withColumn("n_tok", F.size("__toks"))
    ex = toks.select(F.col(id_col), "__row", "n_tok",
                     F.explode_outer(_neighbours(F.col("__toks"))).alias("c"))
    ex = ex.select(id_col, "__row", "n_tok", F.col("c.t").alias("__t"), "c.p1", "c.p2", "c.p3")
    hit = ex.join(lex, "__t", "left")

    v0 = F.coalesce(F.col("__v"), F.lit(0.0))
    prev = [F.col("p1"), F.col("p2"), F.col("p3")]
    b = sum((F.coalesce(F.try_element_at(boost, p), F.lit(0.0)) * d
             for p, d in zip(prev, BOOST_DECAY)), F.lit(0.0))
    v1 = v0 + F.signum(v0) * b
    negated = (F.coalesce(F.array_contains(negs, prev[0]), F.lit(False))
               | F.coalesce(F.array_contains(negs, prev[1]), F.lit(False))
               | F.coalesce(F.array_contains(negs, prev[2]), F.lit(False)))
    v = F.when(v0 == 0, F.lit(0.0)).when(negated, v1 * NEGATION_SCALAR).otherwise(v1)
    per_tok = hit.select(id_col, "__row", "n_tok", v.alias("v"))
    sums = per_tok.groupBy("__row", id_col).agg(
        F.max("n_tok").alias("n_tok"),
        F.sum("v").alias("s"),
        F.sum(F.when(F.col("v") > 0, F.col("v") + 1)).alias("ps"),
        F.sum(F.when(F.col("v") < 0, F.col("v") - 1)).alias("ng"),
        F.count(F.when(F.col("v") != 0, F.lit(1))).alias("nz"),
    )
    zero = F.lit(0.0)
    scored = sums.select(
        F.col(id_col), F.coalesce("s", zero).alias("s"), F.coalesce("ps", zero).alias("ps"),
        F.abs(F.coalesce("ng", zero)).alias("ns"),
        (F.col("n_tok") - F.col("nz")).cast("double").alias("nu"))
    return _finish(scored, id_col)


def _finish(scored: DataFrame, id_col: str) -> DataFrame:
    """(id, s, ps, ns, nu) -> (id, neg, neu, pos, compound)."""
    zero = F.lit(0.0)
    total = F.col("ps") + F.col("ns") + F.col("nu")
    frac = lambda c: F.when(total > 0, F.col(c) / total).otherwise(zero)
    return scored.select(
        F.col(id_col),
        frac("ns").alias("neg"), frac("nu").alias("neu"), frac("ps").alias("pos"),
        (F.col("s") / F.sqrt(F.col("s") * F.col("s") + F.lit(NORMALIZE_ALPHA))).alias("compound"),
    )


def softmax_scores(df: DataFrame, pos, neg, neu, keep: list[str] | None = None) -> DataFrame:
    """H3: three logits -> probabilities (max-shifted softmax) and
    ``compound = pos - neg``; plain columns, code-generated."""
    cols = {"pos": F.col(pos) if isinstance(pos, str) else pos,
            "neg": F.col(neg) if isinstance(neg, str) else neg,
            "neu": F.col(neu) if isinstance(neu, str) else neu}
    cols = {k: v.cast("double") for k, v in cols.items()}
    m = F.greatest(*cols.values())
    ex = {k: F.exp(v - m) for k, v in cols.items()}
    z = ex["pos"] + ex["neg"] + ex["neu"]
    out = df.select(*(keep or []),
                    (ex["neg"] / z).alias("neg"), (ex["neu"] / z).alias("neu"),
                    (ex["pos"] / z).alias("pos"))
    return out.withColumn("compound", F.col("pos") - F.col("neg"))


# ---------------------------------------------------------------- H2 ----

def fit_bag_weights(docs: DataFrame, label_col: str, text_col: str = "text",
                    max_words: int | None = None) -> DataFrame:
    """Weights ``(word, pos, neg, neu)`` of a linear bag-of-words model: the
    log of the smoothed share of each class's texts that have the word.

    ``label_col`` holds ``positive``, ``negative`` or ``neutral``; other rows
    are left out. Counts are over all labelled texts and every word of theirs
    has a weight, unless ``max_words`` asks for the words that most texts
    have (ties by word) alone."""
    classes = {"pos": "positive", "neg": "negative", "neu": "neutral"}
    known = docs.where(F.col(label_col).isin(*classes.values()))
    toks = known.select(F.col(label_col).alias("c"), F.explode(F.array_distinct(word_tokens(text_col))).alias("word"))
    words = toks.groupBy("word").agg(F.count(F.lit(1)).alias("n"), *[
        F.count(F.when(F.col("c") == c, F.lit(1))).alias(k) for k, c in classes.items()])
    total = known.agg(*[F.count(F.when(F.col(label_col) == c, F.lit(1))).alias(f"n_{k}") for k, c in classes.items()])
    if max_words is not None:
        words = words.orderBy(F.col("n").desc(), "word").limit(max_words)
    return words.join(F.broadcast(total)).select("word", *[       # one row of totals
        F.log((F.col(k) + 1) / (F.col(f"n_{k}") + 2)).alias(k) for k in classes])


# copies of a weight table that is joined through a shuffle: the tokens of a
# very common word go to so many tasks
WORD_COPIES = 8


def _hits_of_many(rows: DataFrame, toks: DataFrame, own: list[str], w: DataFrame, most: int) -> DataFrame:
    """Tokens with their weights from a table that is too large to broadcast:
    the words that most texts have are, up to the ceiling; what is left,
    counted per row and word, meets the rare words in a shuffle join, where a
    word with many rows after all is dealt to several tasks."""
    texts = rows.select(F.explode(F.array_distinct("toks")).alias("__word")).groupBy("__word").agg(F.count(F.lit(1)).alias("__in"))
    used = cut_lineage(w.join(texts, "__word"))
    common, _ = checked_broadcast(used.orderBy(F.col("__in").desc(), "__word").limit(most).drop("__in"), most)
    if common is None:
        common = F.broadcast(used.limit(0).drop("__in"))
    rare = used.drop("__in").join(common.select("__word"), "__word", "left_anti")
    copies = rare.withColumn("__copy", F.explode(F.sequence(F.lit(0), F.lit(WORD_COPIES - 1))))
    near = toks.withColumn("n", F.lit(1)).join(common, "__word", "left")
    # a text without a token, too, keeps a row
    seen = near.where(F.col("__pos").isNotNull() | F.col("__word").isNull())
    rest = near.where(F.col("__pos").isNull() & F.col("__word").isNotNull()).groupBy(*own, "__word").agg(F.sum("n").alias("n"))
    rest = rest.withColumn("__copy", F.pmod(F.xxhash64("__row"), F.lit(WORD_COPIES)).cast("int")).join(
        copies, ["__word", "__copy"], "left").drop("__copy")
    return seen.select(*own, "n", "__pos", "__neg", "__neu").unionByName(rest.select(*own, "n", "__pos", "__neg", "__neu"))


def bag_score(docs: DataFrame, weights: DataFrame, text_col: str = "text", id_col: str = "doc_id",
              keep: list[str] | None = None, max_broadcast_rows: int = MAX_BROADCAST_ROWS) -> DataFrame:
    """H2 with a linear bag-of-words model: the logits of a text are the mean
    weights ``(word, pos, neg, neu)`` of its tokens (letter/digit runs,
    lower-cased) that are in the table; without one they are equal. Blank
    texts and the output are as in ``model_score``.

    Plan: a table of checked size is broadcast and looked up, so the sums are
    a partial aggregate per row before the only shuffle. Of a larger one the
    words that most texts have are broadcast, and only the rare ones meet the
    tokens that are left, counted per row, in a shuffle join."""
    keep = list(keep or [])
    w = weights.select(F.col("word").alias("__word"), *[F.col(k).alias(f"__{k}") for k in ("pos", "neg", "neu")])
    small, _ = checked_broadcast(w, max_broadcast_rows)
    # sums are per row, so rows that repeat an id are answered each
    cols = list(dict.fromkeys([id_col, *keep]))
    own = ["__row", "__blank", *[f"__own{i}" for i in range(len(cols))]]
    blank = strip(F.coalesce(F.col(text_col), F.lit(""))) == ""
    rows = docs.select(F.monotonically_increasing_id().alias("__row"), blank.alias("__blank"),
                       *[F.col(f"`{c}`").alias(f"__own{i}") for i, c in enumerate(cols)],
                       word_tokens(text_col).alias("toks"))
    toks = rows.select(*own, F.explode_outer("toks").alias("__word"))
    if small is not None:
        hit = toks.withColumn("n", F.lit(1)).join(small, "__word", "left")
    else:
        hit = _hits_of_many(rows, toks, own, w, max_broadcast_rows)
    n = F.sum(F.when(F.col("__pos").isNotNull(), F.col("n")))
    sums = hit.groupBy(*own).agg(*[
        F.coalesce(F.sum(F.col(f"__{k}") * F.col("n")) / n, F.lit(0.0)).alias(f"__{k}") for k in ("pos", "neg", "neu")])
    p = softmax_scores(sums, "__pos", "__neg", "__neu", keep=own)
    zero, one = F.lit(0.0), F.lit(1.0)
    return p.select(*[F.col(f"__own{i}").alias(c) for i, c in enumerate(cols)], *[
        F.when(F.col("__blank"), one if k == "neu" else zero).otherwise(F.col(k)).alias(k)
        for k in ("neg", "neu", "pos", "compound")])


_SCORERS: dict = {}


def _scorer(key: str, factory: Callable):
    if key not in _SCORERS:  # built once per Python worker
        _SCORERS[key] = factory()
    return _SCORERS[key]


def _content_key(factory: Callable) -> str:
    """Digest of the pickled factory, made on the driver: the same for every
    task, whatever object the factory is unpickled into."""
    import hashlib

    from pyspark import cloudpickle
    return hashlib.sha256(cloudpickle.dumps(factory)).hexdigest()


def model_score(df: DataFrame, text_col: str, id_col: str, scorer_factory: Callable,
                max_tokens: int | None = None,
                batch_rows: int = 256, keep: list[str] | None = None,
                scorer_key: str | None = None,
                labels: tuple[str, str, str] = ("positive", "negative", "neutral")) -> DataFrame:
    """Score text with a pluggable model over Arrow batches.

    Plug-in protocol: ``scorer_factory()`` gives a scorer, and
    ``scorer(texts: list[str])`` the (n, 3) logits of stripped, non-blank
    texts. Blank (after strip) -> ``(neg 0, neu 1, pos 0, compound 0)``
    without calling the model; otherwise softmax over the three logits and
    ``compound = pos - neg``. Output ``(id, [keep...], neg, neu, pos,
    compound)``; ``keep`` columns ride along in the same batches, so no join
    back is needed.

    The plug-in gets whole texts and cuts them itself (word pieces are its
    affair); ``max_tokens`` cuts white-space tokens before it if asked for.
    It is built once per Python worker: ``scorer_key`` names it, by default a
    digest of the pickled factory. ``labels`` says which of its logits is
    which.
    """
    cols = [id_col, *(keep or [])]
    key = scorer_key or _content_key(scorer_factory)
    place = [labels.index(x) for x in ("positive", "negative", "neutral")]
    kinds = [df.schema[c].dataType.simpleString() for c in cols]
    schema = ", ".join([f"own{i} {k}" for i, k in enumerate(kinds)] + ["neg double", "neu double", "pos double", "compound double"])

    def run(batches):
        scorer = _scorer(key, scorer_factory)
        for batch in batches:
            texts = [(t or "").strip() for t in batch.column("text").to_pylist()]
            live = [i for i, t in enumerate(texts) if t]
            p = np.tile([0.0, 0.0, 1.0], (len(texts), 1))       # positive, negative, neutral
            for lo in range(0, len(live), batch_rows):
                at = live[lo:lo + batch_rows]
                cut = [texts[i] if max_tokens is None else " ".join(texts[i].split()[:max_tokens]) for i in at]
                logits = np.asarray(scorer(cut), dtype=float)[:, place]
                x = np.exp(logits - logits.max(axis=1, keepdims=True))
                p[at] = x / x.sum(axis=1, keepdims=True)
            own = [batch.column(f"own{i}") for i in range(len(cols))]
            scores = [pa.array(x) for x in (p[:, 1], p[:, 2], p[:, 0], p[:, 0] - p[:, 1])]
            yield pa.record_batch(own + scores, names=[f"own{i}" for i in range(len(cols))] + ["neg", "neu", "pos", "compound"])

    ship_package(df.sparkSession)
    src = df.select(*[F.col(f"`{c}`").alias(f"own{i}") for i, c in enumerate(cols)],
                    F.col(f"`{text_col}`").cast("string").alias("text"))
    out = src.mapInArrow(run, schema)
    return out.select(*[F.col(f"own{i}").alias(c) for i, c in enumerate(cols)], "neg", "neu", "pos", "compound")


MAX_PLUGIN_WORDS = 1_000_000


class BagScorer:
    """Plug-in with the weights of a linear bag-of-words model: the logits of
    a text are the mean weights of its lower-cased letter/digit runs that are
    in the table, or equal without one."""

    def __init__(self, words: list[str], weights: np.ndarray):
        self.row = {w: i for i, w in enumerate(words)}
        self.weights = weights

    def __call__(self, texts: list[str]) -> np.ndarray:
        out = np.zeros((len(texts), 3))
        for i, t in enumerate(texts):
            at = [self.row[w] for w in _RUNS.findall(t.lower()) if w in self.row]
            if at:
                out[i] = self.weights[at].mean(axis=0)
        return out


_RUNS = re.compile(r"[^\W_]+")


def bag_scorer(weights: DataFrame) -> Callable | None:
    """Factory of a ``BagScorer`` over ``weights`` (word, pos, neg, neu),
    broadcast to the executors; None if the table has more than
    ``MAX_PLUGIN_WORDS`` words (``bag_score`` takes any number)."""
    if weights.limit(MAX_PLUGIN_WORDS + 1).count() > MAX_PLUGIN_WORDS:
        return None
    t = weights.select("word", "pos", "neg", "neu").toArrow()
    shared = weights.sparkSession.sparkContext.broadcast(
        (t["word"].to_pylist(), np.column_stack([t[c].to_numpy() for c in ("pos", "neg", "neu")])))
    return lambda: BagScorer(*shared.value)


def score_cache(df: DataFrame, cache: DataFrame, key: str,
                score_fn: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """H4: score only the keys absent from the stored ``cache``, then union
    with it. Of the cache the anti-join reads the key column only; a cache of
    checked size is broadcast, so no text is shuffled."""
    keys = cache.select(key).distinct()
    small, _ = checked_broadcast(keys)
    fresh = df.join(small if small is not None else keys, key, "left_anti")
    return cache.unionByName(score_fn(fresh))
