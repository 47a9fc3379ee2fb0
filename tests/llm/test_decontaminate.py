import math
import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from moodgauge.llm import decontaminate as dc
from moodgauge.llm.words import blocks
from texts import UPPER, edit, prose

TOKEN = re.compile(r"[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")


def tokens(text):
    return TOKEN.findall((text or "").translate(UPPER))


@pytest.fixture(scope="module")
def bench():
    rng = random.Random(21)
    # a small vocabulary: many passages share words with many items
    return [(k, prose(rng, rng.randrange(12, 70), 300)) for k in range(40)] + [(40, None), (41, ""), (42, "?!"), (43, "word")]


@pytest.fixture(scope="module")
def texts(bench):
    rng = random.Random(22)
    rows = [prose(rng, rng.randrange(0, 900), 300) for _ in range(40)]
    for k in range(0, 40, 2):       # whole items, some edited, in the middle of other text
        rows.append(f"{prose(rng, rng.randrange(300), 300)}, {edit(rng, bench[k][1], 0.1 * (k % 4 == 2)).upper()}. {prose(rng, 90, 300)}")
    rows += [bench[1][1], bench[3][1][: len(bench[3][1]) // 3], None, "", "word", prose(rng, 30000, 300)]
    return list(enumerate(rows))


def brute(rows, bench, index_stride):
    """All items scored for all passages."""
    items = {k: tokens(t) for k, t in bench if tokens(t)}
    n, mean = len(items), sum(map(len, items.values())) / len(items)
    df = Counter(w for ws in items.values() for w in set(ws))

    def impacts(ws):
        out = {w: math.log(1 + (n - df[w] + .5) / (df[w] + .5)) * tf * 2.2 / (tf + 1.2 * (.25 + .75 * len(ws) / mean))
               for w, tf in Counter(ws).items()}
        total = sum(out.values())
        return {w: x / total for w, x in out.items()}

    def grams(ws, m):
        m = min(m, len(ws))
        return {tuple(ws[i:i + m]) for i in range(len(ws) - m + 1)} if ws else set()

    want = {}
    for k, ws in items.items():
        imp, stride = impacts(ws), index_stride[k]
        cut = len(ws) - max(1, int(len(ws) * .25)) if len(ws) > 1 else 1
        q, a = grams(ws[:cut], 2), grams(ws[cut:], 1)
        for d, t in rows:
            tw = tokens(t)
            for p in range(max(-(-len(tw) // stride) - 1, 1)):
                w = tw[p * stride:(p + 2) * stride]
                score = sum(x for u, x in imp.items() if u in set(w))
                if score >= .6 - 1e-9:
                    have = {tuple(w[i:i + m]) for m in (1, 2) for i in range(len(w) - m + 1)}
                    share = [len(g & have) / len(g) if g else 1.0 for g in (q, a)]
                    if min(share) >= .5:
                        found = (round(score, 9), *(round(s, 9) for s in share))
                        want[d, k] = max(want.get((d, k), (0, 0, 0)), found)
    return want


def test_leaks_against_all_passages_and_items(spark, bench, texts):
    b = spark.createDataFrame(bench, "item_id long, text string")
    found = next(dc.indexes(b))
    stride = {found[1][i]: x.stride for x in found[0] for i in x.items}
    df = spark.createDataFrame([(*r, "s") for r in texts], "doc_id long, text string, score string").repartition(4)
    got = {(r.doc_id, r.item_id): (round(r.score, 9), round(r.question_overlap, 9), round(r.answer_overlap, 9))
           for r in dc.leaks(df, b).collect()}
    want = brute(texts, bench, stride)
    assert got.keys() == want.keys()
    for k, v in want.items():
        assert np.allclose(got[k], v)
    assert {(40 + k // 2, k) for k in range(0, 40, 2)} <= got.keys()       # every planted item
    assert {d for d, _ in got} & set(range(40)) == set()                     # no clean text
    kept = dc.keep_clean(df, b)
    assert kept.columns == df.columns
    assert sorted(r.doc_id for r in kept.collect()) == sorted({d for d, _ in texts} - {d for d, _ in got})


def test_several_indexes(spark, bench, texts, monkeypatch):
    b = spark.createDataFrame(bench, "item_id long, text string")
    df = spark.createDataFrame(texts[30:], "doc_id long, text string").repartition(2)
    one = sorted((r.doc_id, r.item_id, round(r.score, 9)) for r in dc.leaks(df, b).collect())
    monkeypatch.setattr(dc, "INDEX_WORDS", 400)
    assert sorted((r.doc_id, r.item_id, round(r.score, 9)) for r in dc.leaks(df, b).collect()) == one


def test_blocks_are_skipped(spark, bench):
    """The pivot and the block bounds leave few items to score in full."""
    found = next(dc.indexes(spark.createDataFrame(bench, "item_id long, text string")))[0]
    assert all((np.diff(x.term_max) >= 0).all() and x.block.max() == (len(x.items) - 1) // dc.ITEMS_PER_BLOCK for x in found)
    b = next(blocks(pa.array(["nothing in common " * 40]), separators=dc._PUNCT))
    assert all(dc.search(x, b, b.word_hash(lower=True)) == [] for x in found)


def test_empty_tables(spark, bench, no_docs):
    b = spark.createDataFrame(bench, "item_id long, text string")
    none = spark.createDataFrame([], "item_id long, text string")
    some = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    assert dc.leaks(no_docs, b).count() == 0 == dc.leaks(some, none).count()
    assert dc.keep_clean(some, none).count() == 1 and dc.keep_clean(no_docs, b).count() == 0
    assert dc.leaks(some, none).columns == dc.leaks(some, b).columns


def test_scripts_without_spaces_and_other_separators(spark):
    rng = random.Random(2)
    kana = lambda n: "".join(chr(rng.randrange(0x4E00, 0x4E00 + 900)) for _ in range(n))
    item, words = kana(60), [f"word{rng.randrange(9999)}" for _ in range(30)]
    b = spark.createDataFrame([(1, item), (2, " ".join(words))], "item_id long, text string")
    rows = [(1, kana(100) + item + "。" + kana(100)), (2, kana(260)), (3, "\u3000".join(["x", *words, "y"])),
            (4, "\u00ab" + "\u2014".join(words) + "\u00bb"), (5, "\u3000".join(f"other{i}" for i in range(40)))]
    got = {(r.doc_id, r.item_id) for r in dc.leaks(spark.createDataFrame(rows, "doc_id long, text string"), b).collect()}
    assert got == {(1, 1), (3, 2), (4, 2)}
