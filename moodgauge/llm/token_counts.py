"""Token counts of a unigram tokenizer without making the tokens.

An Aho-Corasick automaton over the vocabulary names, at every character, the
pieces that end there, longest first. Dynamic programming over the characters
carries two numbers per place: the best score and the pieces of that path. A
path replaces another only if it scores strictly more, so of equals the one
whose last piece starts first stays, as in the tokenizer. A character no piece
of its own matches is an unknown one (lowest score less 10) and counts as many
tokens as it has UTF-8 bytes.

The pieces and scores are those of a tokenizer file, read as a unigram
vocabulary. No piece has the space mark after another character, so texts are
cut before runs of marks and the count of a part is remembered. Scores add up
exactly (whole numbers in doubles), so parts add up to the whole.
"""

from __future__ import annotations

import hashlib
import re
from collections import deque

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from moodgauge.llm.common import map_arrow
from moodgauge.llm.sentencepiece_codec import MARK, NORMAL, PART_CHARS, PARTS, Normaliser, read_model
from moodgauge.session import ensure_checkpoint_dir

UNKNOWN_PENALTY = 10.0


class Matcher:
    """Aho-Corasick automaton of pieces with scores."""

    def __init__(self, pieces: dict[str, float]):
        self.goto: list[dict[str, int]] = [{}]
        ends: list[tuple[int, float] | None] = [None]
        for piece, score in pieces.items():
            s = 0
            for c in piece:
                to = self.goto[s].get(c)
                if to is None:
                    to = self.goto[s][c] = len(self.goto)
                    self.goto.append({})
                    ends.append(None)
                s = to
            ends[s] = (len(piece), score)
        self.fail = [0] * len(self.goto)
        # all pieces that end at a state, longest first
        self.ending: list[tuple[tuple[int, float], ...]] = [()] * len(self.goto)
        queue = deque([0])
        while queue:
            s = queue.popleft()
            own = (ends[s],) if ends[s] else ()
            self.ending[s] = own + (self.ending[self.fail[s]] if s else ())
            for c, to in self.goto[s].items():
                f = self.fail[s]
                while s and f and c not in self.goto[f]:
                    f = self.fail[f]
                self.fail[to] = self.goto[f].get(c, 0) if s else 0
                queue.append(to)

    def step(self, state: int, c: str) -> int:
        while state and c not in self.goto[state]:
            state = self.fail[state]
        return self.goto[state].get(c, 0)


class Counter:
    """Scores and counts of texts under a model file's vocabulary."""

    def __init__(self, model: dict):
        self.normaliser = Normaliser(model)
        pieces = {t: s for t, s, k in model["pieces"] if k == NORMAL}
        self.byte_fallback = model["byte_fallback"]
        self.unknown = min(pieces.values(), default=0.0) - UNKNOWN_PENALTY
        self.matcher = Matcher(pieces)
        # without byte pieces, a run of unknown characters may cross a cut
        split = self.byte_fallback and not any(re.search(f"[^{MARK}]{MARK}", t) for t in pieces)
        self.cut = re.compile(f"{MARK}+[^{MARK}]*|[^{MARK}]+") if split else re.compile("(?s).+")
        self.seen: dict[str, tuple[float, int]] = {}

    def part(self, part: str) -> tuple[float, int]:
        """(best score, pieces) of one part."""
        m, state = self.matcher, 0
        best, count = [0.0], [0]
        unknown = [False]       # whether the best path ends with an unknown character
        for i, c in enumerate(part):
            state = m.step(state, c)
            top, n, lost, alone = None, 0, False, False
            for size, score in m.ending[state]:
                alone |= size == 1
                total = best[i + 1 - size] + score
                if top is None or total > top:
                    top, n, lost = total, count[i + 1 - size] + 1, False
            if not alone:
                total = best[i] + self.unknown
                if top is None or total > top:
                    # without byte pieces, unknown characters in a row are one token
                    more = len(c.encode()) if self.byte_fallback else int(not unknown[i])
                    top, n, lost = total, count[i] + more, True
            best.append(top)
            count.append(n)
            unknown.append(lost)
        return best[-1], count[-1]

    def count(self, text: str | None) -> tuple[int, float]:
        score, n = 0.0, 0
        seen = self.seen
        for part in self.cut.findall(self.normaliser.quick(text or "")):
            got = seen.get(part)
            if got is None:
                got = self.part(part)
                if len(part) <= PART_CHARS:
                    if len(seen) >= PARTS:
                        seen.clear()
                    seen[part] = got
            score += got[0]
            n += got[1]
        return n, score


_COUNTERS: dict[str, Counter] = {}


def token_counts(docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: ``id_col``, n_tokens and score (of the best
    path, -0.0 never). Null and empty texts have no tokens and score 0. Ids
    may be null or repeated; other columns are not read. Whole texts are
    counted, row by row; a task holds one batch and the remembered parts."""
    spark = docs.sparkSession
    ensure_checkpoint_dir(spark)
    model = read_model(model_path)
    key = hashlib.sha256(repr(sorted(model.items())).encode()).hexdigest()
    shared = spark.sparkContext.broadcast(model)        # the vocabulary file, a few hundred KB
    src = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))

    def run(batch: pa.RecordBatch):
        if key not in _COUNTERS:
            _COUNTERS.clear()
            _COUNTERS[key] = Counter(shared.value)
        for at in range(0, batch.num_rows, 512):
            rows = batch.slice(at, 512)
            got = [_COUNTERS[key].count(t) for t in rows.column("text").to_pylist()]
            yield {"id": rows.column("id"), "n_tokens": [g[0] for g in got], "score": [g[1] for g in got]}

    out = map_arrow(src, run, f"id {src.schema['id'].dataType.simpleString()}, n_tokens long, score double")
    return out.withColumnRenamed("id", id_col) if id_col != "id" else out
