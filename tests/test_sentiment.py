"""The rule set of H1 against a plain loop over tokens."""

import math
import random
import re

import pytest
from pyspark.sql import functions as F

from moodgauge.operators import sentiment as se
from moodgauge.operators.scoring import BOOST_DECAY
from moodgauge.session import key_filter

LEX = {"good": 1.9, "bad": -2.5, "great": 3.1, "fine": 0.8}
IDIOMS = {"bad good": 2.2, "not so bad": 1.1, "so bad": -3.0}
NEG, BOOST, TURN = ["not", "never"], {"very": 0.293, "hardly": -0.293}, ["but", "yet"]


def caps(w):
    return len(w) > 1 and w.upper() == w and w.lower() != w


def brute(text):
    toks = re.findall(r"[^\W_]+|[.,;:!?\n]", text or "")
    words = [(i, t) for i, t in enumerate(toks) if t not in ".,;:!?\n"]
    n_caps = sum(caps(t) for _, t in words)
    mixed = 0 < n_caps < len(words)
    turn = next((i for i, t in words if t.lower() in TURN), None)
    xs = []
    for i, t in words:
        back = []
        for k in (1, 2, 3):
            if i - k < 0 or toks[i - k] in ".,;:!?\n":
                break
            back.append(toks[i - k])
        low = [b.lower() for b in back]
        v = LEX.get(t.lower(), 0)
        if len(low) >= 1:
            v = IDIOMS.get(f"{low[0]} {t.lower()}", v)
        if len(low) >= 2:
            v = IDIOMS.get(f"{low[1]} {low[0]} {t.lower()}", v)
        if not v:
            xs.append(0.0)
            continue
        x, sign = v, math.copysign(1, v)
        if mixed and caps(t):
            x += sign * se.CAPS_PUSH
        for b, decay in zip(back, BOOST_DECAY):
            p = BOOST.get(b.lower(), 0)
            if p and mixed and caps(b):
                p += math.copysign(se.CAPS_PUSH, p)
            x += sign * p * decay
        if any(b in NEG for b in low):
            x *= -0.74
        if turn is not None and i != turn:
            x *= 0.5 if i < turn else 1.5
        xs.append(x)
    e = min((text or "").count("!"), 4) * 0.292
    q = (text or "").count("?")
    e += 0.96 if q > 3 else q * 0.18 if q > 1 else 0
    s = sum(xs)
    s += (s > 0) * e - (s < 0) * e
    pos, neg, neu = sum(x + 1 for x in xs if x > 0), sum(1 - x for x in xs if x < 0), sum(x == 0 for x in xs)
    pos, neg = pos + e * (pos > neg), neg + e * (neg > pos)
    total = pos + neg + neu
    share = [x / total if total else 0.0 for x in (neg, neu, pos)]
    return [round(x, 9) + 0.0 for x in (*share, s / math.sqrt(s * s + 15))]


@pytest.mark.parametrize("ceiling", [100_000, 0])
def test_rules(spark, ceiling):
    rng = random.Random(4)
    vocabulary = ["good", "BAD", "bad", "Great", "GREAT", "not", "never", "very", "VERY", "hardly", "so", "but", "yet",
                  "x", "day", "fine", ".", ",", "!", "??", "\n", "!!!"]
    texts = [" ".join(rng.choice(vocabulary) for _ in range(rng.randrange(0, 14))) for _ in range(150)]
    texts += [None, "", "!!!", "????", "\n\n", "GOOD DAY", "Good DAY not so bad", "not, good", "ß GROSS good", texts[0]]
    rows = [(i // 2, t, "x", 1) for i, t in enumerate(texts)] + [(None, "good", "x", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, id string, pos int").repartition(3)
    lex = spark.createDataFrame([*LEX.items(), ("good", 9.0), (None, 1.0)], "w string, v double")
    idioms = spark.createDataFrame(list(IDIOMS.items()), "w string, v double")
    got = se.sentiment_rules(docs, lex, idioms, negations=NEG, boosters=BOOST, contrasts=TURN, max_broadcast_rows=ceiling).collect()
    want = [(i, *brute(t)) for i, t, *_ in rows]
    assert sorted(map(repr, ((r.doc_id, *[round(x, 9) + 0.0 for x in (r.neg, r.neu, r.pos, r.compound)]) for r in got))) == sorted(map(repr, want))


def test_clause_cuts_the_window(spark):
    lex = spark.createDataFrame([("good", 2.0)], "w string, v double")
    docs = spark.createDataFrame([(1, "not good"), (2, "not, good"), (3, "not\ngood"), (4, "")], "doc_id long, text string")
    got = {r.doc_id: r.compound for r in se.sentiment_rules(docs, lex, negations=["not"]).collect()}
    assert got[1] < 0 < got[2] == got[3] and got[4] == 0


def test_lexicon_of_labels(spark):
    rows = [("up up day", 1)] * 3 + [("down day", 0)] * 3 + [("rare", 1), ("day", None)]
    got = {r.term: r.valence for r in se.label_lexicon(spark.createDataFrame(rows, "text string, good int"), "good").collect()}
    assert got == {"up": 4.0, "down": -4.0, "day": pytest.approx(-4 / 7)}
    assert se.label_lexicon(spark.createDataFrame([], "text string, good int"), "good").count() == 0


@pytest.mark.parametrize("counted", [True, False])
def test_tokens_that_need_no_shuffle_stay_out_of_it(spark, monkeypatch, counted):
    """Past the broadcast ceiling neither tokens that the lexicon lacks nor,
    if counts are known, its most common terms meet it in a shuffle."""
    terms = [("good", 1.0, 9000), ("bad", -1.0, 8000), *[(f"w{i}", 1.5, 2) for i in range(50)]]
    docs = spark.createDataFrame([(i, f"good w{i} not bad! " + "plain " * 200) for i in range(50)] + [(None, ""), (3, "none here")],
                                 "doc_id long, text string")
    lex = spark.createDataFrame(terms, "w string, v double, n long")
    want = se.sentiment_rules(docs, lex).collect()
    sent, shuffled = [], se._shuffled
    monkeypatch.setattr(se, "_shuffled", lambda rows, *a: sent.append(rows.count()) or shuffled(rows, *a))
    got = se.sentiment_rules(docs, lex, max_broadcast_rows=2, count_col="n" if counted else None).collect()
    plain = lambda rows: sorted(repr([r.doc_id, *(round(x, 9) + 0.0 for x in r[1:])]) for r in rows)
    assert plain(got) == plain(want) and len(got) == 52
    # of 10,252 tokens: one row of every text, the rare terms, and the common ones too where no counts are known
    assert sent[-1] < 120 if counted else sent[-1] < 240


@pytest.mark.parametrize("longs", [1, 1 << 12])
def test_key_filter_loses_no_key(spark, longs):
    keys = spark.createDataFrame([(f"k{i}",) for i in range(3000)] + [(None,)], "k string")
    rows = spark.createDataFrame([(f"k{i}",) for i in range(9000)], "v string")
    test = key_filter(keys, "k", max_longs=longs)
    passed = {r.v for r in rows.where(test(F.col("v"))).collect()}
    assert {f"k{i}" for i in range(3000)} <= passed
    assert longs == 1 or len(passed) < 3600
    assert rows.where(key_filter(keys.limit(0), "k")(F.col("v"))).count() == 0
