import math
import random

import pytest

from moodgauge.llm import language as lg
from texts import edit

SYLLABLES = {"aa": ["ka", "ro", "mi", "ten"], "bb": ["sch", "ung", "keit", "ver", "ä"], "cc": ["eau", "oux", "ment", "é"]}


def speak(rng, lang, n):
    return " ".join("".join(rng.choice(SYLLABLES[lang]) for _ in range(rng.randrange(1, 5))).capitalize() for _ in range(n))


@pytest.fixture(scope="module")
def spoken():
    rng = random.Random(1)
    return [(i, speak(rng, lang, rng.randrange(1, 60)), lang) for i, lang in enumerate(["aa", "bb", "cc"] * 60)]


def brute_phrases(learned, text):
    n, at = 0, 0
    while at < len(text):
        size = 1
        while at + size < len(text) and text[at:at + size + 1] in learned:
            size += 1
        n, at = n + 1, at + size
    return n


def brute_letters(text):
    kept = "".join(c if c.isalpha() else " " for c in text.lower())
    return f" {' '.join(kept.split())} " if kept.strip() else ""


def brute_predict(learned, text):
    """Whole-text parse by substring tests alone."""
    seen = brute_letters(text or "")
    if not seen:
        return "und", 0.0
    cost = sorted((brute_phrases(t, seen) * math.log2(len(t) + 1), k) for k, t in learned.items())
    return cost[0][1], 1 - cost[0][0] / cost[1][0]


def test_automaton_finds_longest_matches():
    rng = random.Random(7)
    learned = lg.letters(speak(rng, "bb", 60))
    a = lg.Automaton(learned)
    for _ in range(300):
        text = lg.letters(edit(rng, speak(rng, rng.choice(list(SYLLABLES)), rng.randrange(1, 9)), 0.1))
        assert a.phrases(text) == brute_phrases(learned, text)
    assert a.phrases("") == 0 and lg.Automaton("").phrases("ab") == 2 and lg.Automaton("a").phrases("bab") == 3


def test_held_out_accuracy(spark, spoken):
    df = spark.createDataFrame([(*r, 0.5) for r in spoken], "doc_id long, text string, lang string, score double")
    got = {r.doc_id: r for r in lg.identify(df, df.where("doc_id < 90")).collect()}
    right = [got[i].lang_pred == lang for i, _, lang in spoken if i >= 90]
    assert sum(right) >= 0.95 * len(right)
    assert all(0 <= r.score <= 1 for r in got.values())


def test_whole_texts_equal_brute_force(spark, spoken):
    df = spark.createDataFrame(spoken, "doc_id long, text string, lang string")
    learn = df.where("doc_id < 60")
    learned = {}
    for k in SYLLABLES:     # every text fits the bound, in whatever order
        learned[k] = lg.training_texts(learn, "doc_id", "text", "lang")[k]
        own = sorted(brute_letters(t).strip() for i, t, lang in spoken if i < 60 and lang == k)
        assert sorted(learned[k].split()) == sorted(" ".join(own).split())
    for r in lg.identify(df, learn).collect():
        lang, score = brute_predict(learned, spoken[r.doc_id][1])
        assert (r.lang_pred, round(r.score, 9)) == (lang, round(score, 9))


def test_long_runs_and_hot_rows_are_learned(spark):
    """A language of one endless run of letters, one whose rows are all the
    same, and one without ids."""
    rows = ([(i, "\u65e5\u672c\u8a9e\u306e\u6587\u7ae0" * 40, "ja") for i in range(5)]
            + [(77, "karo miten roka", "aa")] * 6000 + [(None, "sch\u00e4 ungkeit", "bb")] * 3 + [(9, "12 34", "none")])
    learn = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    assert set(lg.training_texts(learn, "doc_id", "text", "lang")) == {"ja", "aa", "bb"}
    ask = spark.createDataFrame([(1, "\u672c\u8a9e\u306e\u6587"), (2, "miten karo"), (3, "ung sch\u00e4")], "doc_id long, text string")
    assert {r.doc_id: r.lang_pred for r in lg.identify(ask, learn).collect()} == {1: "ja", 2: "aa", 3: "bb"}


def test_learned_text_is_bounded(spark, monkeypatch):
    monkeypatch.setattr(lg, "CHARS_PER_LANGUAGE", 50)
    learn = spark.createDataFrame([(i, "karo miten " * 9, k) for i, k in enumerate(["aa", "bb"] * 4)],
                                  "doc_id long, text string, lang string")
    got = lg.training_texts(learn, "doc_id", "text", "lang")
    assert set(got) == {"aa", "bb"} and all(0 < len(v) <= 52 for v in got.values())
    monkeypatch.setattr(lg, "CHARS_IN_ALL", 60)
    assert all(0 < len(v) <= 32 for v in lg.training_texts(learn, "doc_id", "text", "lang").values())


def test_odd_texts(spark, docs, corpus, spoken):
    learn = spark.createDataFrame([*spoken, (900, None, "aa"), (901, "x", None), (None, "karo", "aa")],
                                  "doc_id long, text string, lang string")
    rows = [(1, None), (2, ""), (3, "12 ?! ²"), (4, "_ 7"), (5, "KARO²MI"), (6, "日本語" * 20000), (7, "karo " * 50000), (7, "karo")]
    got = lg.identify(spark.createDataFrame(rows, "doc_id long, text string"), learn).collect()
    assert [(r.lang_pred, r.score) for r in got if r.doc_id <= 4] == [("und", 0.0)] * 4
    assert {r.lang_pred for r in got if r.doc_id in (5, 7)} == {"aa"}
    assert [r.lang_pred for r in got if r.doc_id == 6][0] in ("aa", "bb", "cc")
    assert len(got) == len(rows)
    assert lg.identify(docs, learn).count() == len(corpus)


def test_ties_and_nothing_learned(spark, no_docs):
    learn = spark.createDataFrame([(1, "same words", "b"), (2, "same words", "a")], "doc_id long, text string, lang string")
    one = spark.createDataFrame([(5, "words")], "doc_id long, text string")
    r = lg.identify(one, learn).first()
    assert (r.lang_pred, r.score) == ("a", 0.0)
    assert lg.identify(one, learn.where("false")).first().lang_pred == "und"
    assert lg.identify(one, learn.where("lang = 'b'")).first().score == 1.0
    assert lg.identify(no_docs, learn).count() == 0


def test_parse_stops_past_the_second_best_language(monkeypatch):
    """Same answer as whole parses; a language that can no longer be one of
    the best two is not parsed to the end."""
    rng = random.Random(5)
    learned = {k: lg.letters(speak(rng, k, 200)) for k in SYLLABLES} | {"dd": " zq zx" * 3000 + " "}
    model = lg.Model(learned)
    read = dict.fromkeys(learned, 0)
    whole = lg.Automaton.parse

    def counted(self, text, state):
        read[model.languages[model.automata.index(self)]] += len(text)
        return whole(self, text, state)

    monkeypatch.setattr(lg.Automaton, "parse", counted)
    for n in (1, 40, 3000):
        for lang in SYLLABLES:
            text = edit(rng, speak(rng, lang, n), 0.05)
            read = dict.fromkeys(learned, 0)
            got = model.predict(text)
            want = brute_predict(learned, text)
            assert (got[0], round(got[1], 9)) == (want[0], round(want[1], 9))
    assert read["cc"] == len(lg.letters(text)) and read["dd"] < 0.9 * read["cc"]


def test_letters_of_every_character():
    """The short way for Latin-1 gives what the long way gives."""
    for text in map(chr, range(0x3000)):
        for around in (text, f"Ab{text}cD", f"a {text} b", f"5{text}_{text}É"):
            long = lg.letters(around + " \u0416")       # a letter past Latin-1
            short = lg.letters(around + " z")
            assert short.rstrip().removesuffix("z") == long.rstrip().removesuffix("\u0436")
