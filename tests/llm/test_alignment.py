"""Token alignment against brute force with the two libraries."""

import hashlib
import os
import random
from collections import Counter

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from moodgauge.llm import alignment as al
from moodgauge.llm.queries import byte_model, piece_model


@pytest.fixture(scope="module")
def tokens():
    with open(byte_model(), "rb") as f, open(piece_model(), "rb") as g:
        return al.Tokens(f.read(), g.read(), True)


def both(tokens, text):
    """Ids of whole texts by the libraries; nothing if a side differs."""
    if not text:
        return [], []
    a = tokens.a.encode(" " + text, add_special_tokens=False).ids
    b = tokens.b.encode(text)
    raw = (" " + text).encode()
    if b"".join(tokens.a_bytes[i] for i in a) != raw or b"".join(tokens.b_bytes[i] for i in b) != raw:
        return [], []
    return a, b


def groups(tokens, a, b):
    out, i, j, x, y = [], 0, 0, 0, 0
    while i < len(a):
        lo, x, y = (i, j), x + tokens.a_len[a[i]], y + tokens.b_len[b[j]]
        i, j = i + 1, j + 1
        while x != y:
            if x < y:
                x, i = x + tokens.a_len[a[i]], i + 1
            else:
                y, j = y + tokens.b_len[b[j]], j + 1
        out.append((a[lo[0]:i], b[lo[1]:j]))
    return out


def expected(tokens, texts):
    per = [groups(tokens, *both(tokens, t)) for t in texts]
    links = [[(x, y) for a, b in g for x in a for y in b] for g in per]
    count = Counter(p for own in links for p in set(own))
    best = {}
    for (a, _), n in count.items():
        best[a] = max(best.get(a, 0), n)
    out = []
    for g, own in zip(per, links):
        text = ";".join(",".join(map(str, a)) + "|" + ",".join(map(str, b)) for a, b in g)
        out.append((sum(len(a) for a, _ in g), sum(len(b) for _, b in g), len(g), len(own),
                    sum(count[p] == best[p[0]] for p in own), sum(count[p] for p in own),
                    hashlib.sha256(text.encode()).hexdigest() if g else ""))
    return out


ODD = [None, "", " ", "\n", "a  b", " a", "a ", "a \n b\n  c \t d", "a▁b", "<|endoftext|> <s> <unk> <0x41>", "\x00", "a\x1c b",
       "x\x85 y  z", "'s 's  's it's", "= " * 50, "ab" * 3000, "日本語 テキスト 　 ก็", "👩‍👩‍👧 é é", "one", "x" * 5000]


@given(st.lists(st.integers(1, 9), min_size=1, max_size=60), st.randoms(use_true_random=False))
def test_irregular_groups(steps, rng):
    ends = [sum(steps[:k + 1]) for k in range(len(steps))]
    a = sorted({e for e in ends if rng.random() < 0.8} | {ends[-1]})
    b = sorted({e for e in ends if rng.random() < 0.8} | {ends[-1]})
    want, lo = [], (0, 0)
    for e in sorted(set(a) & set(b)):
        hi = a.index(e) + 1, b.index(e) + 1
        if hi[0] - lo[0] > 1 or hi[1] - lo[1] > 1:
            want.append((lo[0], hi[0], lo[1], hi[1]))
        lo = hi
    assert al.irregular_groups(a, b) == want


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(st.one_of(st.sampled_from(" \n\tab1'.▁\x1c é"), st.characters(exclude_categories=["Cs"]))), max_size=4))
def test_texts_by_parts(tokens, texts):
    got = tokens.align(texts)
    for k, t in enumerate(texts):
        a, b = both(tokens, t)
        assert got.a[got.a_at[k]:got.a_at[k + 1]].tolist() == a
        assert got.b[got.b_at[k]:got.b_at[k + 1]].tolist() == b


def test_white_space_of_all_characters(tokens):
    texts = [f"x{c} y {c} 1{c}2  {c}" for c in map(chr, range(1, 0x3100))]
    want = [hashlib.sha256(";".join(",".join(map(str, a)) + "|" + ",".join(map(str, b)) for a, b in g).encode()).hexdigest() if g else ""
            for g in (groups(tokens, *both(tokens, t)) for t in texts)]
    assert tokens.align(texts).digests() == want


def test_forgetting(tokens, monkeypatch):
    monkeypatch.setattr(al, "PARTS", 5)
    texts = [f"a{k} b{k % 3} c" for k in range(12)]
    got = [tokens.align(texts[k:k + 2]).digests() for k in range(0, 12, 2)]
    tokens._forget()
    monkeypatch.setattr(al, "PARTS", 1000)
    assert sum(got, []) == tokens.align(texts).digests()


def row(r):
    return (r.n_a, r.n_b, r.n_groups, r.n_links, r.n_best, r.count_sum, r.groups_sha256)


@pytest.mark.parametrize("hot_pairs", [0, 50, 1 << 19])
def test_token_links(spark, tokens, corpus, hot_pairs):
    rng = random.Random(3)
    words = ["ndenth,", "Ciónueí", "ososmente.", "queieta", "répatre.", "dieäverge", "the", "of", "and\nthe"]
    texts = [" ".join(rng.choice(words) for _ in range(rng.randrange(1, 60))) for _ in range(30)]
    texts += ODD + [t for _, t in corpus if not t or len(t) < 3000][:40] + [texts[0], texts[0]]
    rows = [(None if k == 5 else k // 2, t, "z", k, "p") for k, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, row string, pair long, id string").repartition(4)
    got = al.token_links(docs, byte_model(), piece_model(), hot_pairs=hot_pairs).collect()
    want = expected(tokens, texts)
    assert sorted(map(repr, ((r.doc_id, *row(r)) for r in got))) == sorted(
        map(repr, ((i, *w) for (i, *_), w in zip(rows, want))))


def test_large_groups_by_distinct_ids(spark, tokens, monkeypatch):
    texts = ["répatre. dieäverge " * 20, "ndenth, " * 9]
    want = [x.tolist() for x in tokens.align(texts).pairs()]
    monkeypatch.setattr(al, "GROUP_LINKS", 1)
    assert [x.tolist() for x in tokens.align(texts).pairs()] == want


def test_align_gives_groups(spark, tokens):
    docs = spark.createDataFrame([(1, "répatre. the ndenth,"), (2, None), (3, "one")], "doc_id long, text string")
    for r in al.align(docs, byte_model(), piece_model()).collect():
        a, b = both(tokens, {1: "répatre. the ndenth,", 2: None, 3: "one"}[r.doc_id])
        assert (r.a_ids, r.b_ids) == (a, b)
        ends = [(0, 0), *zip(r.a_ends, r.b_ends)]
        assert [(a[x:p], b[y:q]) for (x, y), (p, q) in zip(ends, ends[1:])] == groups(tokens, a, b)


def test_pair_counts(spark, tokens):
    texts = ["the répatre.", "the the", None, "répatre."]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {(r.a_id, r.b_id): r.n_docs for r in al.pair_counts(docs, byte_model(), piece_model()).collect()}
    links = [{(x, y) for a, b in groups(tokens, *both(tokens, t)) for x in a for y in b} for t in texts]
    assert got == Counter(p for own in links for p in own)


def test_empty_table(spark, no_docs):
    assert al.token_links(no_docs, byte_model(), piece_model()).count() == 0


def test_whole_texts_without_cuts(tokens):
    with open(byte_model(), "rb") as f, open(piece_model(), "rb") as g:
        whole = al.Tokens(f.read(), g.read(), False)
    texts = [t for t in ODD if t is None or len(t) < 400] + ["répatre. dieäverge the"]
    assert whole.align(texts).digests() == tokens.align(texts).digests()
    assert os.path.exists(piece_model())
