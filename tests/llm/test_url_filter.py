import math
import random
import re

import pytest

from moodgauge.llm import url_filter as uf

URLS = [None, "", "no scheme/x", "http://", "http://Example.ORG/es/1", "https://a.example.org/es", "https://example.org/en/1?x=1&y=2#f",
        "https://example.org/en/2", "http://x.com/fr/", "http://x.com/fr", "http://x.com/de/a", "http://xcom/fr/a", "http://com/fr/a",
        "http://a.org?q=1", "http://a.org", "http://badexample.org/es/1", "http://É.com/fr/É?", "a://b://c/d", "http://x.org/\n/es/", "http://" + "a" * 50000]


def split(url):
    m = re.match(r"(?s).*?://([^/?#]*)([^?#]*)", url or "")
    host = m[1] if m else ""
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in host), m[2] if m else ""


def brute_rule(host, path):
    best = None
    for r, v in uf.RULES:
        h, _, rest = r.partition("/")
        if (host == h or host.endswith("." + h)) and path.startswith("/" + rest) and (best is None or len(r) > len(best[0])):
            best = (r, v)
    return best or (None, None)


@pytest.fixture(scope="module")
def labelled(spark):
    rng = random.Random(9)
    rows = []
    for _ in range(1200):
        bad = rng.random() < 0.4
        host = rng.choice(["win-cash-now.biz", "free--pills.biz"] if bad else ["news.example.net", "wiki.example.edu"])
        tail = f"/{rng.randrange(10**9)}/{rng.randrange(10**9)}?a={rng.random()}&b=1" if bad else f"/{rng.choice(['history', 'music'])}"
        rows.append((f"http://{host}{tail}", int(bad)))
    return spark.createDataFrame([*rows, (None, None), ("http://x", None)], "url string, label int")


@pytest.fixture(scope="module")
def model(labelled):
    return uf.UrlModel(labelled)


def test_rules_and_parts(spark, model):
    df = spark.createDataFrame([(i, u, "h", "r") for i, u in enumerate(URLS)], "page_id long, url string, host string, rule string")
    got = {r.page_id: r for r in uf.judge(df, model).collect()}
    for i, u in enumerate(URLS):
        host, path = split(u)
        rule, verdict = brute_rule(host, path)
        r = got[i]
        assert (r.host, r.path, r.rule) == (host, path, rule), u
        assert r.verdict == (verdict or ("block" if r.score >= 0.5 else "allow")), u


def test_features(spark):
    df = spark.createDataFrame([(u,) for u in URLS[:-1]], "url string")
    for r in uf.features(df, "url").collect():
        u = r.url or ""
        p = [u.count(c) / len(u) for c in set(u)]
        assert math.isclose(r.f_entropy, -sum(x * math.log2(x) for x in p), abs_tol=1e-9), u
        assert r.f_url_length == len(u) and r.f_digit_ratio == pytest.approx(sum(c in "0123456789" for c in u) / max(len(u), 1))
        q = re.search(r"(?s)\?([^#]+)", u)
        assert r.f_params == (len(q[1].split("&")) if q else 0), u
        assert r.f_depth == split(u)[1].count("/")


def test_held_out_accuracy(spark, labelled, model):
    rows = [(r.url, r.label) for r in labelled.where("label is not null").collect()]
    rng = random.Random(10)
    fresh = [(re.sub(r"\d+", lambda m: str(rng.randrange(10**9)), u), y) for u, y in rows[:400]]
    df = spark.createDataFrame([(i, u) for i, (u, _) in enumerate(fresh)], "page_id long, url string")
    got = {r.page_id: r.verdict == "block" for r in uf.judge(df, model, rules=[]).collect()}
    assert sum(got[i] == bool(y) for i, (_, y) in enumerate(fresh)) >= 0.95 * len(fresh)


def test_one_kind_of_label_and_none(spark, labelled):
    df = spark.createDataFrame([(1, "http://a.b/c")], "page_id long, url string")
    assert uf.judge(df, uf.UrlModel(labelled.where("label = 1"))).first().verdict == "block"
    assert uf.judge(df, uf.UrlModel(labelled.where("false"))).first().verdict == "allow"
    assert uf.judge(df.where("false"), uf.UrlModel(labelled.where("label = 0"))).count() == 0
