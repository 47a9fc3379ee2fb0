"""Vector codes against brute force."""

import hashlib
import math
from collections import defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from moodgauge.llm import vector_codes as vc


def nearest(entries, q):
    return min((sum((x - y) ** 2 for x, y in zip(e, q)), i) for i, e in enumerate(entries))


@settings(max_examples=200, deadline=None)
@given(st.lists(st.lists(st.integers(-6, 6), min_size=3, max_size=3), min_size=1, max_size=40),
       st.lists(st.lists(st.integers(-9, 9), min_size=3, max_size=3), min_size=1, max_size=30))
def test_orchard_finds_the_nearest(entries, queries):
    got, d = vc.Orchard(np.array(entries, np.int64)).nearest(np.array(queries, np.int64))
    want = [nearest(entries, q) for q in queries]
    assert list(zip(d.tolist(), got.tolist())) == want


def test_orchard_measures_few():
    rng = np.random.default_rng(5)
    entries = rng.integers(-100, 100, (64, 2))
    search = vc.Orchard(entries)
    search.nearest(entries[rng.integers(0, 64, 2000)] + rng.integers(-2, 3, (2000, 2)))
    assert search.measured < 2000 * 16


def brute(rows, parts=vc.PARTS, entries=vc.ENTRIES, rounds=vc.ROUNDS):
    kept = [(i, lab, [math.floor(256 * x) for x in v]) for i, v, lab in rows
            if v and all(x is not None and math.isfinite(x) for x in v)]
    w = len(kept[0][2]) // parts
    cut = [[v[p * w:(p + 1) * w] for p in range(parts)] for _, _, v in kept]
    first = sorted(range(len(kept)), key=lambda k: (kept[k][0] is None, kept[k][0] or 0, kept[k][2]))[:entries]
    books = [[cut[k][p] for k in first] for p in range(parts)]
    for _ in range(rounds):
        for p in range(parts):
            own = defaultdict(list)
            for c in cut:
                own[nearest(books[p], c[p])[1]].append(c[p])
            books[p] = [[sum(x) // len(own[e]) for x in zip(*own[e])] if e in own else books[p][e] for e in range(len(books[p]))]
    out, total = [], defaultdict(int)
    for (i, lab, _), c in zip(kept, cut):
        best = [nearest(books[p], c[p]) for p in range(parts)]
        out.append((i, lab, "".join(f"{e:02x}" for _, e in best), sum(d for d, _ in best)))
        total[lab] += out[-1][3]
    sha = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
    return sorted((repr((i, code, err, total[lab], sha)) for i, lab, code, err in out))


def rows_of(rng, n, width):
    return [(i, [float(np.float32(x)) for x in rng.normal(0, 0.2, width)], None if i % 7 == 0 else i % 3) for i in range(n)]


@pytest.mark.parametrize("n,width", [(150, 32), (20, 16)])
def test_compress(spark, n, width):
    rows = rows_of(np.random.default_rng(n), n, width)
    rows += [(n + 1, None, 1), (n + 2, [None] + [0.0] * (width - 1), 1), (n + 3, [float("nan")] * width, 0),
             (n + 4, [float("inf")] + [0.1] * (width - 1), 0), (n + 5, [], 2),
             (3, rows[9][1], 2), (4, rows[4][1], 1), (None, rows[5][1], None), (n + 6, rows[0][1], 1)]
    df = spark.createDataFrame([(*r, "x", 1.5) for r in rows], "vec_id long, embedding array<float>, label int, v string, error double")
    got = vc.compress(df.repartition(4)).collect()
    assert sorted(repr((r.vec_id, r.code, r.error, r.label_error, r.codebooks_sha256)) for r in got) == brute(rows)


def test_other_lengths_go(spark):
    rows = rows_of(np.random.default_rng(1), 12, 16) + [(50, [0.1] * 8, 1), (51, [0.1] * 32, 1)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    assert {r.vec_id for r in vc.compress(df).collect()} == set(range(12))


def test_large_components_and_odd_widths_fail(spark):
    schema = "vec_id long, embedding array<double>, label int"
    with pytest.raises(Exception, match="component"):
        vc.compress(spark.createDataFrame([(1, [1e6] * 16, 1)], schema)).collect()
    with pytest.raises(ValueError, match="equal parts"):
        vc.compress(spark.createDataFrame([(1, [1.0] * 17, 1)], schema))


def test_empty_table(spark):
    df = spark.createDataFrame([], "vec_id long, embedding array<float>, label int")
    got = vc.compress(df)
    assert got.count() == 0 and got.columns == ["vec_id", "code", "error", "label_error", "codebooks_sha256"]
    none = spark.createDataFrame([(1, None, 1)], "vec_id long, embedding array<float>, label int")
    assert vc.compress(none).count() == 0
