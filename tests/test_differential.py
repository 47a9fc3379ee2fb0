"""Differential checks: Spark operators against plain
Python written from the reference's semantics, on whole small fixtures."""

import math
import re

from pyspark.sql import Window
from pyspark.sql import functions as F

from moodgauge.functions.text import BANNED_KEYWORDS, clean_text, merge_text, strip, word_tokens
from moodgauge.functions.time import parse_iso
from moodgauge.operators import consensus, match, report
from moodgauge.plans.config import ENTITY_TERMS, KEYWORD_COUNT

SF = "/root/testdata/sf0.001"


def _py_clean(t):
    return " ".join((t or "").replace("\0", " ").split())


def _unicode_words(text):
    """Longest runs of word characters, by a scan over the characters."""
    start = None
    for i, c in enumerate(text + " "):
        inside = c.isalnum() or c == "_"
        if inside and start is None:
            start = i
        elif not inside and start is not None:
            yield start, text[start:i]
            start = None


def _py_keywords(text, k):
    ok = (w for _, w in _unicode_words((text or "").lower())
          if w.isascii() and "_" not in w and len(w) > 1 and w[0].isalpha() and w not in BANNED_KEYWORDS)
    return list(dict.fromkeys(ok))[:k]


def _py_symbols(text, own, k):
    def short(w):
        return w.isascii() and w.isalpha() and w.isupper() and len(w) <= 5

    words = dict(_unicode_words(text or ""))
    found, used = [], set()
    for at, w in words.items():
        if at in used or not short(w):
            continue
        end = at + len(w)
        share = words.get(end + 1, "") if (text or "")[end:end + 1] == "." else ""
        if len(share) == 1 and short(share):    # the class of a share: BRK.B
            used.add(end + 1)
            w = f"{w}.{share}"
        found.append(w)
    return [w for w in dict.fromkeys(found) if w != own.upper()][:k]


def _texts(spark):
    d = spark.read.parquet(f"{SF}/documents.parquet").select(F.col("doc_id").alias("id"), "text")
    c = spark.read.parquet(f"{SF}/conversations.parquet").select(
        (F.col("conv_id") * 1000 + F.col("turn") + 10_000_000).alias("id"), "text")
    b = spark.read.parquet(f"{SF}/benchmark.parquet").select(
        (F.col("item_id") + 20_000_000).alias("id"), "text")
    return d.unionByName(c).unionByName(b)


def test_clean_text_equals_python(spark):
    rows = _texts(spark).select("id", "text", clean_text("text").alias("c")).collect()
    assert len(rows) > 200
    bad = [r["id"] for r in rows if r["c"] != _py_clean(r["text"])]
    assert not bad, bad[:5]


def test_keywords_and_symbols_equal_python(spark):
    df = _texts(spark).withColumn("entity", F.lit("NVDA"))
    kw = {r["id"]: r["words"] for r in
          consensus.extract_keywords(df, k=15).select("id", "words").collect()}
    sy = {r["id"]: r["words"] for r in
          consensus.extract_symbols(df, k=6).select("id", "words").collect()}
    texts = {r["id"]: r["text"] for r in df.select("id", "text").collect()}
    assert all(kw[i] == _py_keywords(t, 15) for i, t in texts.items())
    assert all(sy[i] == _py_symbols(t, "NVDA", 6) for i, t in texts.items())
    assert sum(len(v) for v in sy.values()) > 50      # symbols do occur


def test_entity_match_equals_python_re(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    rows = [(e, i, t) for e, ts in ENTITY_TERMS.items() for i, t in enumerate(ts)]
    terms = spark.createDataFrame(rows, "entity string, ord int, term string")
    got = {(r["doc_id"], r["entity"]): r["matched_term"] for r in
           match.match_entities(docs, terms, "text", k=KEYWORD_COUNT).collect()}
    want = {}
    for r in docs.collect():
        text = (r["text"] or "").strip()
        if not text:
            continue
        for e, kws in ENTITY_TERMS.items():
            alts = [re.escape(t) for t in [e, f"${e}"] + kws[:KEYWORD_COUNT] if t]
            m = re.search("(" + "|".join(alts) + ")", text, flags=re.IGNORECASE)
            if m:
                want[(r["doc_id"], e)] = m.group(1)
    assert got == want and len(want) > 50


def test_report_equals_stats_union(spark):
    ev = spark.read.parquet(f"{SF}/events.parquet")
    rep = report.sentiment_report(ev, "ts", "value", group="event_type", id_col="event_id")
    overall = report.daily_stats(ev, "ts", "value", "event_id")
    grouped = report.daily_stats(ev, "ts", "value", "event_id", group="event_type")
    cols = ["n_posts", "score_mean", "score_std", "score_var", "score_median"]
    a = {(r["report_group"], r["day"]): tuple(r[c] for c in cols) for r in rep.collect()}
    b = {(None, r["day"]): tuple(r[c] for c in cols) for r in overall.collect()}
    b.update({(r["grp"], r["day"]): tuple(r[c] for c in cols) for r in grouped.collect()})
    assert a.keys() == b.keys()
    for k in a:
        for x, y in zip(a[k], b[k]):
            assert (x is None and y is None) or math.isclose(x, y, rel_tol=1e-12, abs_tol=1e-12)


def _vocabulary(spark, docs):
    voc = (docs.select(F.explode(word_tokens("text")).alias("t")).where(F.length("t") >= 4)
           .groupBy("t").count().orderBy(F.col("count").desc(), "t").limit(600))
    return voc.withColumn("i", F.row_number().over(Window.orderBy("t")) - 1).select(
        F.concat(F.lit("E"), (F.col("i") / 10).cast("int").cast("string")).alias("entity"),
        (F.col("i") % 10).cast("int").alias("ord"), F.col("t").alias("term"))


def _matches(df):
    return sorted((r["doc_id"], r["entity"], r["matched_term"]) for r in df.collect())


def test_grams_equal_theta_on_many_terms(spark):
    d = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    d = d.unionByName(d.limit(20))          # repeated rows are answered each
    terms = _vocabulary(spark, d)
    a = _matches(match.match_entities(d, terms, method="theta"))
    assert len(a) > 1000
    assert _matches(match.match_entities(d, terms, method="grams")) == a
    assert _matches(match.match_entities(d, terms, method="grams", max_broadcast_rows=300)) == a


def test_hits_of_entities_are_in_no_shuffle_and_blocks_change_no_row(spark, monkeypatch):
    d = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    d = d.unionByName(d.limit(20)).repartition(3)
    terms = _vocabulary(spark, d)
    # terms of many entities, one twice, and one longer than a window of text
    long = " ".join(d.where("length(text) > 200").orderBy("doc_id").first()["text"].split())[:90]
    terms = terms.unionByName(terms.limit(200).withColumn("entity", F.concat("entity", F.lit("b"))))
    terms = terms.unionByName(terms.limit(9)).unionByName(
        spark.createDataFrame([("long", 0, long)], terms.schema))
    a = _matches(match.match_entities(d, terms, method="theta"))
    monkeypatch.setattr(match, "TERM_BLOCK", 150)
    monkeypatch.setattr(match, "PAIR_BLOCK", 150)
    b = match.match_entities(d, terms, method="grams")
    assert _matches(b) == a
    plan = b._jdf.queryExecution().executedPlan().toString()
    dealt = re.findall(r"hashpartitioning\(([^)]*)\)", plan)
    assert dealt and not [x for x in dealt if "entity" in x]


ODD_TEXTS = ["İİİ buy NVIDIA now", "\u212aelvin and ſaid", "ΣΑΣ σας ς", "Deep  Learning, deep learning!", "c++ C++x xc++",
             "a$name $NAME", "µ Μ μ", "\tİstanbul\n", " \u2003 ", "ﬆop ﬅop", "ΐ ΐ"]
ODD_TERMS = {"kelvin": ["said", "istanbul"], "name": ["deep learning", "c++", "σας"], "µ": ["ﬅ", "ΐ"], "NVIDIA": ["ii"]}


def test_all_methods_equal_python_re_on_odd_characters(spark, monkeypatch):
    docs = spark.createDataFrame(list(enumerate(ODD_TEXTS)), "doc_id long, text string")
    terms = spark.createDataFrame([(e, i, t) for e, ts in ODD_TERMS.items() for i, t in enumerate(ts)],
                                  "entity string, ord int, term string")
    plain, whole = [], []
    for i, t in enumerate(ODD_TEXTS):
        for e, ts in ODD_TERMS.items():
            alts = "|".join(re.escape(x) for x in [e, f"${e}", *ts])
            for out, rx in ((plain, f"({alts})"), (whole, rf"(?<![^\W_])({alts})(?![^\W_])")):
                m = re.search(rx, t.strip(), flags=re.IGNORECASE)
                if m:
                    out.append((i, e, m[1]))
    for method in ("theta", "grams", "regex"):
        assert _matches(match.match_entities(docs, terms, method=method)) == sorted(plain), method
    assert _matches(match.match_entities(docs, terms, method="token")) == sorted(whole)
    monkeypatch.setattr(match, "TESTED_TERMS", 0)
    assert _matches(match.match_entities(docs, terms, method="token")) == sorted(whole)


def test_grams_search_in_batches_equals_theta_on_odd_texts_and_columns(spark, monkeypatch):
    monkeypatch.setattr(match, "FEW_TERMS", 0)
    many = "".join(map(chr, range(0x4E00, 0x4E00 + 700)))          # more characters than classes
    texts = ODD_TEXTS + [many, many[::-1], "x" * 41 + many[:40], "thunderstorm\nthunderstruck thunders", "\U0001f600 Name"]
    rows = [(i, t, [t, None], f"{i}") for i, t in enumerate(texts + [None, texts[3]])]
    docs = spark.createDataFrame(rows, "doc_id long, text string, tags array<string>, months string").repartition(2)
    # a column that Arrow cannot carry
    docs = docs.select("doc_id", "text", "tags", F.expr("make_ym_interval(0, cast(months AS int))").alias("span"))
    kept = {**ODD_TERMS, "cjk": list(many[::3]), "long": ["x" * 41, many[:17], many[5:40], "x" * 42, "storm\nthunder"],
            "thunder": ["thunders", "thunderstorm", "thunderstruck", "thunderstorms"], "ties": ["thunderstruck", "thunder"]}
    # of hits at one place the least ord wins, and a null one comes first
    terms = spark.createDataFrame([(e, None if t == "thunderstruck" else i, t) for e, ts in kept.items()
                                   for i, t in enumerate(ts)], "entity string, ord int, term string")

    def rows_of(method, **more):
        found = match.match_entities(docs, terms, method=method, **more)
        return found, sorted(str(r) for r in found.select(*[F.col(c).cast("string") for c in found.columns]).collect())

    want = rows_of("theta")[1]
    assert len(want) >= 20
    found, got = rows_of("grams")
    assert got == want
    assert found.columns == ["doc_id", "text", "tags", "span", "entity", "matched_term"]
    monkeypatch.setattr(match, "NAMES", 1)
    monkeypatch.setattr(match, "STRETCH", 7)
    want = rows_of("theta", keep=["doc_id"])[1]
    found, got = rows_of("grams", keep=["doc_id"])
    assert got == want
    # no column but the kept is read after the search, and no candidate is a row of a join
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" in plan and "ArrowEvalPython" not in plan and "Join" not in plan
    assert "text" not in plan[:plan.index("Exchange")]
    # bytes that are no text stand beside hits
    docs = spark.sql("SELECT 1L AS doc_id, cast(X'FF204E616D65' AS STRING) AS text UNION ALL SELECT 2L, 'no \u4e00'")
    assert rows_of("grams", keep=["doc_id"])[1] == rows_of("theta", keep=["doc_id"])[1] != []


def test_fold_equals_python_ignorecase_on_every_bmp_char(spark):
    chars = [c for c in map(chr, range(0x10000)) if not 0xD800 <= ord(c) <= 0xDFFF]
    df = spark.createDataFrame([(c,) for c in chars], "c string")
    got = {r["c"]: r["f"] for r in df.where(~F.col("c").rlike("^\\p{Cn}$")).select("c", match.fold("c").alias("f")).collect()}
    by = {}
    for c, f in got.items():
        assert len(f) == 1, hex(ord(c))
        by.setdefault(f, []).append(c)
    for f, group in by.items():         # equal folds match each other ...
        rx = re.compile(re.escape(group[0]), re.IGNORECASE)
        assert all(rx.fullmatch(c) for c in group), [hex(ord(c)) for c in group]
    for c, f in got.items():            # ... and a character its other cases
        for o in {c.upper(), c.lower()} & got.keys():
            if re.fullmatch(re.escape(c), o, re.IGNORECASE):
                assert got[o] == f, hex(ord(c))


ISO = ["2024-02-29", "2024-02-30", "2023-02-29", "20240229", "2024-W09", "2024-W09-4", "2024W094", "2020-W53-7", "2021-W53", "2024-W00",
       "2024-W10-8", "2024-01-05T10", "2024-01-05T10:07", "2024-01-05T10:07:09", "2024-01-05 10:07:09", "2024-01-05x10:07", "2024-01-05T1007",
       "2024-01-05T100709", "2024-01-05T100709.5", "20240105T100709Z", "2024-01-05T10:07:09.1", "2024-01-05T10:07:09,123456789",
       "2024-01-05T10:07:09.999999999", "2024-01-05T10:07:09Z", "2024-01-05T10:07Z", "2024-01-05T10:07:09z", "2024-01-05T10:07:09+0000",
       "2024-01-05T10:07:09+02", "2024-01-05T10:07:09-05:30", "2024-01-05T10:07:09+05:30:15", "2024-01-05T10:07:09+05:30:15.25",
       "2024-01-05T10:60", "2024-01-05T25:00", "2024-01-05T10:07:60", "2024-01-05T10:07:09+25:00", "2024-01-05T10:07:09+01:60", "2024-01-05T",
       "2024-1-5", "24-01-05", "0000-01-01", "9999-12-31T23:59:59", "0001-01-01", "junk", "", "2024-13-01", "2024-00-10", "2024-01-05T10:7",
       "2024-01-05T10:07:09.", "  2024-01-05T10:07:09\n", "2024-01-05T10:07:09 +02:00", "2024-01-05T-10", "2024-001"]


def test_parse_iso_equals_python_fromisoformat(spark):
    import datetime as dt
    want = []
    for s in ISO:
        try:
            t = dt.datetime.fromisoformat(s.strip())
            t = t if t.tzinfo else t.replace(tzinfo=dt.timezone.utc)
            epoch = dt.datetime(1970, 1, 1, tzinfo=dt.timezone.utc)
            want.append((t - epoch) // dt.timedelta(microseconds=1))
        except ValueError:
            want.append(None)
    df = spark.createDataFrame(list(enumerate([*ISO, None])), "i int, s string")
    got = [r["u"] for r in df.select("i", F.unix_micros(parse_iso("s")).alias("u")).orderBy("i").collect()]
    assert [(s, g, w) for s, g, w in zip(ISO, got, want) if g != w] == []
    assert got[-1] is None and sum(w is not None for w in want) > 25


def test_strip_equals_python(spark):
    rows = ["\tfoo\n", "\n", " \u2003a b\x1c ", "", "\x85x\xa0", "a", "\x00a "]
    df = spark.createDataFrame([(i, s) for i, s in enumerate(rows)], "i int, s string")
    assert [r["t"] for r in df.select("i", strip("s").alias("t")).orderBy("i").collect()] == [s.strip() for s in rows]
    one = df.limit(1).select(merge_text(F.lit("\tfoo\n"), F.lit("\n"), F.lit("\u2003bar")).alias("m")).first()
    assert one["m"] == "foo bar"


def test_whitespace_class_equals_python_on_every_bmp_char(spark):
    chars = [chr(c) for c in range(0x10000) if not 0xD800 <= c <= 0xDFFF]
    df = spark.createDataFrame([(i, f"a{c}b") for i, c in enumerate(chars)], "i int, t string")
    got = {r["i"]: r["c"] for r in df.select("i", clean_text("t").alias("c")).collect()}
    bad = [hex(ord(c)) for i, c in enumerate(chars) if got[i] != _py_clean(f"a{c}b")]
    assert not bad, bad[:10]


def test_tokenisers_equal_python_on_every_bmp_char_the_jvm_knows(spark):
    chars = [chr(c) for c in range(0x10000) if not 0xD800 <= c <= 0xDFFF]
    cdf = spark.createDataFrame([(c,) for c in chars], "c string")
    # letters added after the JVM's Unicode version are unassigned there
    known = {r["c"] for r in cdf.where(~F.col("c").rlike("^\\p{Cn}$")).collect()}
    rows = [(i, f"ab{c}cd x{c} {c}yz", "NVDA") for i, c in enumerate(chars) if c in known]
    rows += [(100000 + i, f"AB{c}CD X{c} {c}YZ", "NVDA") for i, c in enumerate(chars) if c in known]
    df = spark.createDataFrame(rows, "id int, text string, entity string")
    kw = {r["id"]: r["words"] for r in consensus.extract_keywords(df, k=15).collect()}
    sy = {r["id"]: r["words"] for r in consensus.extract_symbols(df, k=6).collect()}
    assert [r[0] for r in rows if kw[r[0]] != _py_keywords(r[1], 15)] == []
    assert [r[0] for r in rows if sy[r[0]] != _py_symbols(r[1], "NVDA", 6)] == []


def test_terms_past_the_byte_ceiling(spark, monkeypatch):
    monkeypatch.setattr(match.checked_broadcast, "__defaults__", (match.MAX_BROADCAST_ROWS, 2_000))
    long = "long term " * 400
    words = [f"word{i}" for i in range(300)] + ["ai", "$", "word1 word2", long.strip(), "x" * 3_000]
    terms = spark.createDataFrame([("one", i, w) for i, w in enumerate(words)] + [("two", 0, "word7"), ("empty", 0, "")],
                                  "entity string, ord int, term string")
    texts = ["said Word7 and word1 word2", long + "WORD299", "nothing", None, "a two $", "word30", "word30", "\nTwoİai"]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id int, text string").repartition(3)
    want = []
    for i, t in enumerate(texts):
        low = (t or "").strip().translate({0x130: "i"}).lower()
        for e, kw in (("one", words), ("two", ["word7"]), ("empty", [])):
            hits = [(low.find(w), n, len(w)) for n, w in enumerate([e, "$" + e, *kw]) if w in low]
            if hits:
                at, _, size = min(hits)
                want.append((i, e, (t or "").strip()[at:at + size]))
    assert len(want) > 8
    for method in ("grams", "theta", "regex"):
        got = match.match_entities(docs, terms, method=method).select("doc_id", "entity", "matched_term").collect()
        assert sorted(tuple(r) for r in got) == sorted(want), method
