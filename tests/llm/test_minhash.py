import random
from collections import defaultdict

import pytest

from moodgauge.llm import minhash
from moodgauge.llm.components import components
from texts import UPPER, edit, prose, words


def shingles(text):
    w = words((text or "").translate(UPPER))
    return frozenset(tuple(w[i:i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset()


def brute(rows):
    """{id: (n_shingles, component)} by comparing all pairs."""
    sets = {i: shingles(t) for i, t in rows if i is not None}
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for a in ids:
        for b in ids:
            if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), find(i)) for i in ids}


def answers(df):
    return {r.doc_id: (r.n_shingles, r.component_id) for r in df.collect() if r.doc_id is not None}


def test_against_all_pairs(docs, corpus):
    got = minhash.near_duplicates(docs)
    assert answers(got) == brute(corpus)
    assert got.count() == len(corpus)
    for r in got.collect():
        if r.doc_id is None:
            assert r.component_id is None and r.kept
        else:
            assert r.kept == (r.doc_id == r.component_id)


def chains(seed, n=160):
    """Near copies of near copies: links reach far through the middle."""
    rng = random.Random(seed)
    base = prose(rng, 120)
    pool = [base]
    for _ in range(n):
        pool.append(edit(rng, rng.choice(pool), rng.choice([0.005, 0.01, 0.02, 0.04])))
    return [(i, t) for i, t in enumerate(pool)]


@pytest.mark.parametrize("seed", [1, 2])
def test_one_large_group_with_chains(spark, seed, monkeypatch):
    monkeypatch.setattr(minhash, "BLOCK_CLASSES", 24)     # several blocks to a cluster
    rows = chains(seed)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    assert answers(minhash.near_duplicates(df)) == brute(rows)


def test_keep_one_of_each_group(docs, corpus):
    kept = minhash.keep_one(docs)
    assert kept.columns == docs.columns
    want = brute(corpus)
    got = [r.doc_id for r in kept.collect()]
    assert sorted(i for i in got if i is not None) == sorted(i for i, (_, c) in want.items() if i == c)
    assert got.count(None) == 1


def test_empty_table(no_docs):
    assert minhash.near_duplicates(no_docs).count() == 0
    assert minhash.keep_one(no_docs).count() == 0


def test_components(spark):
    rng = random.Random(4)
    edges = [(i, i + 1) for i in range(60)] + [(rng.randrange(100, 200), rng.randrange(100, 200)) for _ in range(70)]
    edges += [(5, 5), (None, 3), (61, 60), (300, 299)]
    near = defaultdict(set)
    for a, b in edges:
        if a is not None and a != b:
            near[a].add(b)
            near[b].add(a)
    want = {}
    for v in sorted(near):
        stack = [] if v in want else [v]
        while stack:
            x = stack.pop()
            if x not in want:
                want[x] = v
                stack += near[x]
    got = components(spark.createDataFrame(edges, "u long, v long"))
    assert {r.node: r.component for r in got.collect()} == want
    assert components(spark.createDataFrame([], "u long, v long")).count() == 0


def test_few_edges_are_settled_by_one_task(spark, monkeypatch):
    """One written table for a chain that takes several passes; more edges
    than one task takes go through the passes and give the same."""
    from moodgauge.llm import components as own
    rng = random.Random(7)
    rows = [(i, i + 1) for i in range(200)] + [(rng.randrange(300, 500), rng.randrange(300, 500)) for _ in range(120)]
    edges = spark.createDataFrame(rows + [(5, 5), (None, 3), (-4, 250)], "u long, v long").repartition(3)
    made, write = [], own.written
    monkeypatch.setattr(own, "written", lambda df, name: made.append(name) or write(df, name))
    few = sorted(map(tuple, own.components(edges).collect()))
    assert len(made) == 1
    monkeypatch.setattr(own, "FEW_EDGES", 10)
    assert sorted(map(tuple, own.components(edges).collect())) == few and len(made) > 2


def test_rows_that_repeat_an_id_with_other_texts(spark):
    rng = random.Random(8)
    a, b, c, d = (prose(rng, 80) for _ in range(4))
    b1, c1 = b + " tail", c + " tail"
    rows = [(1, a, "x"), (2, a, "x"), (2, b, "x"), (3, b, "x"),     # 1 has the first a, 2 the first b
            (3, c, "x"), (4, c1, "x"), (2, b1, "y"),                # b1 ~ b under one id, c1 ~ c
            (3, d, "x"), (3, d, "x"), (3, None, "x"), (3, None, "x"), (3, None, None), (3, "", "x")]
    rows += [(7, prose(rng, 60), "z") for _ in range(40)]           # one id, forty texts
    df = spark.createDataFrame(rows, "doc_id long, text string, more string").repartition(4)
    near = {(r.doc_id, r.class_id, r.component_id, r.stays) for r in minhash.near_duplicates(df.where("text != ''")).collect()}
    # of the two shingle sets that id 2 has in its component one stays; both are kept by the id
    assert all(r.kept == (r.doc_id == r.component_id) for r in minhash.near_duplicates(df).collect())
    assert {(1, 1, 1, True), (2, 1, 1, False), (2, 2, 2, True), (2, 2, 2, False), (3, 2, 2, False),
            (3, 3, 3, True), (4, 4, 3, False)} <= near
    got = [tuple(r) for r in minhash.keep_one(df).collect()]
    assert len(got) == len(set(got))
    by_b = [r for r in got if r[1] in (b, b1)]
    assert len(by_b) == 1 and by_b[0][0] == 2                       # one of the two texts stays
    assert set(got) - set(by_b) == {(1, a, "x"), (3, c, "x"), (3, d, "x"), (3, None, "x"), (3, None, None), (3, "", "x"),
                                    *[r for r in rows if r[0] == 7]}


def test_columns_of_any_name_and_type(spark):
    rng = random.Random(12)
    a, b = prose(rng, 80), prose(rng, 80)
    rows = [(1, a, {"k": 1}, 1, 2), (2, a, {"k": 2}, 3, 4), (3, b, None, 5, 6), (3, b, {"x": 1, "y": 2}, 5, 6), (3, None, {"z": 1}, 5, 6)]
    df = spark.createDataFrame(rows, "doc_id long, text string, again map<string,int>, gone int, __gone int")
    got = minhash.keep_one(df)
    assert got.columns == df.columns
    out = sorted(((r.doc_id, r.text) for r in got.collect()), key=repr)
    assert out == sorted([(1, a), (3, b), (3, None)], key=repr)
    assert sorted(r.doc_id for r in minhash.keep_one(df.where("doc_id < 3")).collect()) == [1]
