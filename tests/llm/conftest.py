"""Small tables for the training-data operators: nulls, empty and very long
texts, ties, repeated rows, and extra columns with clashing names."""

import os
import random
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from texts import edit, prose  # noqa: E402


@pytest.fixture(scope="session")
def corpus():
    """(doc_id, text) with every odd case; ids unique but for one repeated
    row and one null id."""
    rng = random.Random(11)
    base = [prose(rng, rng.randrange(1, 400)) for _ in range(60)]
    shared = prose(rng, 70)
    rows = list(base)
    rows += [base[3], base[3], base[3].upper()]                             # copies
    rows += [edit(rng, base[5] + " " + base[6], r) for r in (0.0, 0.01, 0.02, 0.03, 0.04, 0.05, 0.06, 0.08) for _ in range(6)]
    rows += [f"{prose(rng, 30)} {shared}\n{prose(rng, 25)}" for _ in range(12)]
    rows += [None, "", " \n\t ", "one", "one two three four", "ONE two three four", "\n\nline a\nline a\nline b\n"]
    rows += [prose(rng, 40000), " ".join(["again"] * 3000), "x" * 200000, "a\x0bb\x0cc\rd\x85e f"]
    ids = list(range(100, 100 + len(rows)))
    rng.shuffle(ids)
    out = list(zip(ids, rows))
    out += [out[0], (None, base[7])]
    return out


@pytest.fixture(scope="session")
def docs(spark, corpus):
    # columns with names that the operators use inside
    return spark.createDataFrame(
        [(i, t, "x", 1, 2, "y") for i, t in corpus],
        "doc_id long, text string, id string, n_words int, size int, shard string").repartition(5)


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], "doc_id long, text string")
