import random
from collections import defaultdict

import pyarrow as pa

from moodgauge.llm import suffix_dedup
from moodgauge.llm.words import blocks
from texts import prose, words


def brute(rows, size=50):
    """{id: words covered by repeated windows} from all windows of all texts."""
    places = defaultdict(set)
    for i, t in set(rows):
        w = words(t)
        for j in range(len(w) - size + 1):
            places[tuple(w[j:j + size])].add((i, t, j))
    cover = defaultdict(set)
    for at in places.values():
        if len(at) > 1:
            for i, t, j in at:
                cover[i, t] |= set(range(j, j + size))
    return cover, places


def small(corpus):
    return [(i, t) for i, t in corpus if len(t or "") < 50_000]


def covered(spans):
    return {x for s in spans for x in range(s["lo"], s["hi"])}


def test_passages_against_all_windows(spark, corpus):
    rows = small(corpus)
    want, _ = brute(rows)
    df = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, gram int").repartition(5)
    got = suffix_dedup.passages(df).collect()
    assert len(got) == len(want)
    by_id = defaultdict(list)
    for (i, _), w in want.items():
        by_id[i].append(w)
    for r in got:
        assert covered(r.passages) in by_id[r.doc_id]
        assert covered(r.cut) <= covered(r.passages)
        for a, b in zip(r.passages, r.passages[1:]):
            assert a["hi"] < b["lo"]


def test_shuffle_plan_gives_the_same(spark, corpus, monkeypatch):
    df = spark.createDataFrame(small(corpus), "doc_id long, text string").repartition(3)
    a = {(r.doc_id, str(r.passages), str(r.cut)) for r in suffix_dedup.passages(df).collect()}
    monkeypatch.setattr(suffix_dedup, "BROADCAST_GRAMS", 0)
    assert {(r.doc_id, str(r.passages), str(r.cut)) for r in suffix_dedup.passages(df).collect()} == a


def test_cut_keeps_one_copy_of_everything(spark):
    rng = random.Random(3)
    p, q = prose(rng, 60), prose(rng, 49)
    rows = [(1, f"{prose(rng, 30)} {p}\n{prose(rng, 20)}", 0), (2, f"{p}  {prose(rng, 10)}", 0), (3, p, 0),
            (4, f"é {p} {p}", 0), (5, q, 0), (6, q, 0), (7, None, 0), (8, "", 0), (9, "again " * 400, 0)]
    df = spark.createDataFrame(rows, "doc_id long, text string, n_chars long")
    got = {r.doc_id: r for r in suffix_dedup.cut_repeats(df, length_col="n_chars").collect()}
    assert got[1].text == rows[0][1] and got[1].n_chars == 0          # the first occurrence, row as it is
    assert words(got[2].text) == words(rows[1][1])[60:] and got[2].n_chars == len(got[2].text)
    assert 3 not in got                                               # nothing left
    assert words(got[4].text) == ["é"]
    assert got[5].text == got[6].text == q                            # 49 words are no passage
    assert got[7].text is None and got[8].text == ""
    assert len(words(got[9].text)) == 50
    assert suffix_dedup.cut_repeats(df).columns == df.columns


def test_minimisers_are_smallest_grams():
    rng = random.Random(8)
    texts = [prose(rng, n) for n in (0, 19, 49, 50, 51, 300)] + ["a " * 80]
    b = next(blocks(pa.array(texts)))
    start, at, gram = suffix_dedup.minimisers(b)
    assert len(start) == sum(max(len(words(t)) - 49, 0) for t in texts)
    for s, a in zip(start, at):
        g = gram[s:s + suffix_dedup.WINDOW] >> 24
        assert a == s + int(g.argmin())


def test_empty_table(no_docs):
    assert suffix_dedup.passages(no_docs).count() == 0
    assert suffix_dedup.cut_repeats(no_docs).count() == 0


def test_columns_of_any_name(spark):
    rng = random.Random(31)
    shared = prose(rng, 60)
    rows = [(1, f"{prose(rng, 10)} {shared}", 1, {"a": 1}), (2, f"{shared} tail", 2, None), (3, None, 3, {"b": 2})]
    df = spark.createDataFrame(rows, "doc_id long, text string, spans int, of_id map<string,int>")
    got = {r.doc_id: r for r in suffix_dedup.cut_repeats(df).collect()}
    assert got[1].text == rows[0][1] and got[2].text.strip() == "tail" and got[3].text is None
    assert (got[2].spans, got[1].of_id, got[3].of_id) == (2, {"a": 1}, {"b": 2})
