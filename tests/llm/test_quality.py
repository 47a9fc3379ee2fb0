from collections import Counter

import pytest

from texts import words
from moodgauge.llm import quality


def brute(text):
    w = words(text)
    grams = [tuple(w[i:i + 8]) for i in range(len(w) - 7)]
    n = Counter(grams)
    again = {j for i, g in enumerate(grams) if n[g] > 1 for j in range(i, i + 8)}
    lines = [x for x in (text or "").split("\n") if words(x)]
    return (len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)), len(again))


def bits(n_words, chars, symbols, dup, again):
    fails = [n_words < 20, 100 * again > 30 * n_words, 10 * symbols > n_words, 10 * dup > n_words,
             chars > 12 * n_words, chars < 2 * n_words]
    return sum(1 << i for i, f in enumerate(fails) if f)


def test_ledger_against_brute_force(docs, corpus):
    got = sorted((r.doc_id or -1, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.fail_bits)
                 for r in quality.ledger(docs).collect())
    want = sorted((i or -1, *brute(t), bits(*brute(t))) for i, t in corpus)
    assert got == want


def test_policies_are_bit_arithmetic(docs, corpus):
    kept = quality.keep_documents(docs)
    assert kept.columns == docs.columns
    want = sorted(i or -1 for i, t in corpus if not bits(*brute(t)))
    assert sorted(r.doc_id or -1 for r in kept.collect()) == want
    base = quality.keep_documents(docs, "base")
    assert sorted(r.doc_id or -1 for r in base.collect()) == sorted(i or -1 for i, t in corpus if not bits(*brute(t)) & 3)


def test_ablations(docs, corpus):
    got = {r.rule: (r.n_failed, r.n_failed_alone, r.n_kept_without) for r in quality.ablations(quality.ledger(docs)).collect()}
    all_bits = [bits(*brute(t)) for _, t in corpus]
    for name, b in quality.BIT.items():
        assert got[name] == (sum(x >> b & 1 for x in all_bits), sum(x == 1 << b for x in all_bits),
                             sum(x in (0, 1 << b) for x in all_bits))


def test_empty_table(no_docs):
    led = quality.ledger(no_docs)
    assert led.count() == 0
    assert quality.keep_documents(no_docs).count() == 0
    assert {r.n_failed for r in quality.ablations(led).collect()} == {0}


@pytest.mark.parametrize("policy", list(quality.POLICIES))
def test_every_policy_names_rules(policy):
    assert 0 < quality.mask(policy) < 1 << len(quality.RULES)


def test_keep_documents_with_columns_of_any_kind(spark):
    good = " ".join(f"word{i}" for i in range(40))
    rows = [(1, good, {"a": 1}, 5, [1.5]), (2, "short", {"b": 2}, 6, None), (None, good, None, None, [])]
    df = spark.createDataFrame(rows, "doc_id long, text string, measures map<string,int>, n_words int, words array<double>")
    got = quality.keep_documents(df)
    assert got.columns == df.columns and got.schema == df.schema
    assert sorted(map(repr, (tuple(r) for r in got.collect()))) == sorted(map(repr, (rows[0], rows[2])))
