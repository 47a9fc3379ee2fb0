"""Language identification by cross-parsing entropy.

The labelled texts of every language, lower-cased, with one space between
their runs of letters, make one suffix automaton. A text to judge is written
the same way and parsed from left to right, across its words, into the
longest pieces that occur in the language's text; the fewer phrases, the
closer the language. Phrase counts are normalised by the length of the
learned text (a phrase costs log2 of the places it can be copied from).
"""

from __future__ import annotations

import gc
import hashlib
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from moodgauge.llm.common import checked_small, map_arrow
from moodgauge.session import ensure_checkpoint_dir

# bounds of what is learned: texts and characters per language, and
# characters of all languages together, shared evenly
TEXTS_PER_LANGUAGE = 400
CHARS_PER_LANGUAGE = 120_000
CHARS_IN_ALL = 1_200_000
UNDETERMINED = "und"
_TOKEN = re.compile(r"[^\W\d_]+")
# the same for texts of Latin-1 alone: a space for what is no letter, and the
# digits of other kinds, which _TOKEN takes into a run, go
_LATIN = bytes(c if chr(c).isalpha() else 0x20 for c in range(256))
_LATIN_DIGITS = bytes(c for c in range(256) if _TOKEN.match(chr(c)) and not chr(c).isalpha())


def letters(text: str) -> str:
    """Lower-cased runs of letters with a space before, between and after
    them; empty without letters."""
    low = text.lower()
    try:
        runs = low.encode("latin-1").translate(_LATIN, _LATIN_DIGITS).decode("latin-1").split()
        return f" {' '.join(runs)} " if runs else ""
    except UnicodeEncodeError:
        runs = _TOKEN.findall(low)
    joined = " ".join(runs)
    if not joined.replace(" ", "").isalpha():       # digits of other kinds
        joined = " ".join(filter(None, ("".join(filter(str.isalpha, r)) for r in runs)))
    return f" {joined} " if joined else ""


# characters parsed by every language, and between two looks at the costs
HEAD, STRETCH = 256, 256

# the state before a text, and after a character that was not learned
_NOWHERE: dict = {}


class Automaton:
    """Suffix automaton: from the root, every substring of the text is a
    path, and only those. A state is the dict of the states after it."""

    def __init__(self, text: str):
        link, length, last = [-1], [0], 0
        nexts: list[dict] = [{}]
        for c in text:
            cur = len(nexts)
            nexts.append({})
            length.append(length[last] + 1)
            link.append(0)
            p = last
            while p >= 0 and c not in nexts[p]:
                nexts[p][c] = cur
                p = link[p]
            if p >= 0:
                q = nexts[p][c]
                if length[q] == length[p] + 1:
                    link[cur] = q
                else:       # q also ends longer substrings: part them
                    clone = len(nexts)
                    nexts.append(dict(nexts[q]))
                    length.append(length[p] + 1)
                    link.append(link[q])
                    while p >= 0 and nexts[p].get(c) == q:
                        nexts[p][c] = clone
                        p = link[p]
                    link[q] = link[cur] = clone
            last = cur
        # copied in the order of their lengths: short states are met most
        # often and lie close together in memory
        order = sorted(range(len(nexts)), key=length.__getitem__)
        states: list[dict] = [{}] * len(nexts)
        for s in order:
            states[s] = dict(nexts[s])
        for state in states:
            for c, to in state.items():
                state[c] = states[to]
        self.root = states[0]

    def phrases(self, text: str) -> int:
        """Number of phrases of the greedy parse: longest matches, or single
        characters that occur nowhere."""
        return self.parse(text, _NOWHERE)[0]

    def parse(self, text: str, state: dict) -> tuple[int, dict]:
        """Number of phrases that start in ``text``, which follows a text that
        led to ``state``, and the state after it."""
        root = self.root
        n = 0
        for c in text:
            if c in state:
                state = state[c]
            else:                   # a phrase starts with c
                n += 1
                try:
                    state = root[c]
                except KeyError:    # asked once: no text leads back to the root
                    state = root[c] = _NOWHERE
        return n, state


class Model:
    """Automata of all learned languages, in the order of their names."""

    def __init__(self, learned: dict[str, str]):
        self.languages = sorted(learned)
        self.automata = [Automaton(learned[k]) for k in self.languages]
        self.cost = np.log2([len(learned[k]) + 1 for k in self.languages])

    def predict(self, text: str | None) -> tuple[str, float]:
        """(language, score); the score is how much cheaper the best parse is
        than the second (0: a tie, which the first name in order wins)."""
        seen = letters(text or "")
        if not seen or not self.languages:
            return UNDETERMINED, 0.0
        total = self._totals(seen)
        best = int(np.argmin(total))
        rest = np.delete(total, best)
        score = 1.0 if not len(rest) else float(1 - total[best] / rest.min())
        return self.languages[best], min(max(score, 0.0), 1.0)

    def _totals(self, seen: str) -> np.ndarray:
        """Cost of the parse by every language. Languages that are ahead after
        the first characters are parsed first; the others stop once they cost
        more than the second best, and what they cost so far stands for them:
        neither the best two nor their costs depend on it."""
        heads = [a.parse(seen[:HEAD], _NOWHERE) for a in self.automata]
        total = np.array([n for n, _ in heads]) * self.cost
        second = [np.inf, np.inf]       # the lowest two of whole parses
        for i in np.argsort(total, kind="stable"):
            n, state = heads[i]
            for at in range(HEAD, len(seen), STRETCH):
                if n * self.cost[i] > second[1]:
                    break
                more, state = self.automata[i].parse(seen[at:at + STRETCH], state)
                n += more
            total[i] = n * self.cost[i]
            second = sorted([*second, total[i]])[:2]
        return total


def training_texts(docs: DataFrame, id_col: str, text_col: str, lang_col: str) -> dict[str, str]:
    """The text that each language is learned from: of a bounded sample of
    its labelled texts, the TEXTS_PER_LANGUAGE whose id hashes lowest, whole
    texts in that order until the language's characters are used up; the text
    that crosses the bound is cut there. Every language with a letter in some
    labelled text has a sample."""
    text = F.col(text_col).cast("string")
    known = (docs.select(F.col(id_col).alias("id"), text.alias("text"), F.col(lang_col).cast("string").alias("lang"))
             .where("lang is not null and text is not null").where(F.col("text").rlike("\\p{L}")))
    # by count and hash first, so that few rows more than needed are ranked,
    # however many texts a language has; the lowest hash is always among them,
    # also where one id or row is most of a language
    place = F.pmod(F.xxhash64("id"), F.lit(1 << 30)) / F.lit(float(1 << 30))
    seen = known.groupBy("lang").agg(F.count(F.lit(1)).alias("n"), F.min(place).alias("low"))
    seen = seen.select(F.col("lang").alias("of"), "n", "low")
    near = known.join(checked_small(seen, 10_000), F.col("lang") == F.col("of")).where(
        (place * F.col("n") < 4.0 * TEXTS_PER_LANGUAGE) | (place == F.col("low")))
    by = Window.partitionBy("lang").orderBy(place, F.xxhash64("text"), "id")
    sample = near.withColumn("r", F.row_number().over(by)).where(F.col("r") <= TEXTS_PER_LANGUAGE)
    chars = min(CHARS_PER_LANGUAGE, CHARS_IN_ALL // max(seen.count(), 1))
    before = F.sum(F.length("text")).over(Window.partitionBy("lang").orderBy("r").rowsBetween(
        Window.unboundedPreceding, -1))
    sample = sample.withColumn("left", F.lit(chars) - F.coalesce(before, F.lit(0))).where("left > 0")
    found: dict[str, list[str]] = {}
    for r in sample.select("lang", "r", F.expr("substring(text, 1, int(left))").alias("text")).orderBy("lang", "r").collect():
        found.setdefault(r.lang, []).append(letters(r.text))
    joined = {k: "".join(v).replace("  ", " ") for k, v in found.items()}
    return {k: v for k, v in joined.items() if v}


_MODELS: dict[str, Model] = {}


def identify(docs: DataFrame, learn: DataFrame, id_col: str = "doc_id", text_col: str = "text",
             lang_col: str = "lang") -> DataFrame:
    """One row per row of ``docs``: ``id_col``, lang_pred and score, learned
    from the texts and languages of ``learn`` (a bounded sample of it: at
    most 400 texts and 120,000 characters a language, 1.2 million in all).

    Texts that are null or have no letter, and all texts if nothing was
    learned, are ``und`` with score 0. Whole texts are parsed, at any length
    of their runs of letters; ids, languages and other columns of ``docs``
    are no input of a prediction; ids may be null or repeated. Work is
    row-local."""
    spark = docs.sparkSession
    ensure_checkpoint_dir(spark)
    learned = training_texts(learn, id_col, text_col, lang_col)
    key = hashlib.sha256(repr(sorted(learned.items())).encode()).hexdigest()
    shared = spark.sparkContext.broadcast(learned)      # at most CHARS_IN_ALL characters
    src = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))

    def run(batch: pa.RecordBatch):
        if key not in _MODELS:      # one model per worker process
            _MODELS.clear()
            gc.disable()            # its many states need no visits
            try:
                _MODELS[key] = Model(shared.value)
                gc.freeze()
            finally:
                gc.enable()
        model = _MODELS[key]
        for at in range(0, batch.num_rows, 512):
            rows = batch.slice(at, 512)
            got = [model.predict(t) for t in rows.column("text").to_pylist()]
            yield {"id": rows.column("id"), "lang_pred": [g[0] for g in got], "score": [g[1] for g in got]}

    out = map_arrow(src, run, f"id {src.schema['id'].dataType.simpleString()}, lang_pred string, score double")
    return out.withColumnRenamed("id", id_col) if id_col != "id" else out
