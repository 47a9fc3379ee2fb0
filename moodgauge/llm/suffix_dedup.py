"""Repeated passages through sparse suffixes.

A full suffix array keeps one suffix per word. Here only the suffixes at
minimiser positions are kept: the word whose GRAM-word hash is smallest in
some run of WINDOW consecutive grams. Two equal passages of GRAM + WINDOW - 1
= 50 words choose the same positions, so no such passage is lost while about
one word in sixteen is kept.

1. Bring equal suffixes together by the hash of their first GRAM words. A
   suffix that no other shares these words with cannot lie in a repeated
   passage and is dropped.
2. Extend the others: to the left as far as they stay the smallest of their
   window, and to the right to the full 50 words, giving the 50-word windows
   that the suffix stands for. Windows are equal if the hashes of their
   suffix and of their 50 words are (128 bits together).
3. Merge the repeated windows of a text into its longest passages.

Sorting the suffixes and comparing each with its neighbour alone would lose
passages: the neighbour is the suffix with the longest match to the right,
while a passage that reaches far to the left may be shared with another one.
Grouping by suffix and window compares every suffix with all that share its
words, without writing a pair, so it takes the place of the sorted order.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from moodgauge.llm.common import map_arrow, small_batches, unused, written
from moodgauge.llm.words import blocks, window_hash
from moodgauge.session import ensure_checkpoint_dir, ship_package

WORDS = 50
GRAM = 20
WINDOW = WORDS - GRAM + 1
# 8 MB of hashes; beyond it the suffixes are joined through a shuffle
BROADCAST_GRAMS = 1_000_000


def _text_key(text):
    return F.xxhash64(text)


def _source(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    text = F.col(text_col).cast("string")
    return docs.select(F.col(id_col).cast("long").alias("id"), _text_key(text).alias("tkey"), text.alias("text"))


def minimisers(block) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For every 50-word window of a block: its first word, the word of its
    minimiser (the leftmost smallest gram), and all gram hashes by word."""
    wh = block.word_hash()
    first, _ = block.windows(GRAM)
    gram = np.full(len(wh) + 1, np.iinfo(np.uint64).max, np.uint64)
    gram[first] = window_hash(wh, first, GRAM)
    # a value is compared first, then its place: both in one 64-bit number
    bits = max(int(len(wh)).bit_length(), 24)
    packed = (gram[:-1] >> np.uint64(bits) << np.uint64(bits)) | np.arange(len(wh), dtype=np.uint64)
    low, span = packed, 1
    while span < WINDOW:        # minimum of runs of span, then of WINDOW grams
        step = min(span, WINDOW - span)
        if len(low) <= step:
            break
        low = np.minimum(low[:-step], low[step:])
        span += step
    start, _ = block.windows(WORDS)
    at = (low[start] & np.uint64((1 << bits) - 1)).astype(np.int64) if len(start) else start
    return start, at, gram


def kept_suffixes(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, tkey, gram): hash of the first GRAM words of every kept suffix."""
    def run(batch: pa.RecordBatch):
        ids, keys = batch.column("id"), batch.column("tkey")
        for b in blocks(batch.column("text")):
            _, at, gram = minimisers(b)
            at = np.unique(at)
            if len(at):
                row = pa.array(b.first + np.searchsorted(b.word_at, at, "right") - 1)
                yield {"id": ids.take(row), "tkey": keys.take(row), "gram": gram[at].view(np.int64)}

    return map_arrow(_source(docs, id_col, text_col), run, "id long, tkey long, gram long")


def windows_at(src: DataFrame, grams: DataFrame) -> DataFrame:
    """(id, tkey, start, gram, wins): the 50-word windows from ``start`` on
    of every suffix of (id, tkey, text) that starts with one of ``grams``."""
    def run(batch: pa.RecordBatch):
        ids, keys = batch.column("id"), batch.column("tkey")
        for b in blocks(batch.column("text")):
            start, at, gram = minimisers(b)
            if not len(start):
                continue
            # consecutive windows of one suffix travel in one row
            win = window_hash(b.word_hash(), start, WORDS)
            text = np.searchsorted(b.word_at, start, "right") - 1
            new = np.ones(len(start), bool)
            new[1:] = (at[1:] != at[:-1]) | (text[1:] != text[:-1])
            head = np.flatnonzero(new)
            row = pa.array(b.first + text[head])
            yield {"id": ids.take(row), "tkey": keys.take(row), "start": start[head] - b.word_at[text[head]],
                   "gram": gram[at[head]].view(np.int64),
                   "wins": pa.ListArray.from_arrays(pa.array(np.append(head, len(start)), pa.int32()),
                                                    pa.array(win.view(np.int64)))}

    rows = map_arrow(src, run, "id long, tkey long, start long, gram long, wins array<long>")
    return rows.join(grams, "gram", "left_semi")


def repeated_windows(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, tkey, start, gram, win, first_id): windows that occur at two
    places, with the id that keeps them, the smallest."""
    suffixes = kept_suffixes(docs, id_col, text_col)
    grams = written(suffixes.groupBy("gram").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("gram"), "grams")
    src = _source(docs, id_col, text_col)
    if grams.limit(BROADCAST_GRAMS + 1).count() <= BROADCAST_GRAMS:
        met = windows_at(src, F.broadcast(grams))
    else:   # first find the texts with such a suffix, on narrow rows
        texts = written(suffixes.join(grams, "gram", "left_semi").select("id", "tkey").distinct(), "texts")
        texts = texts.select(F.col("id").alias("i"), F.col("tkey").alias("t"))
        met = windows_at(src.join(texts, F.col("tkey").eqNullSafe(F.col("t")) & F.col("id").eqNullSafe(F.col("i")),
                                  "left_semi"), grams)
    # read twice rather than written: the windows are several times the hashes
    flat = (met.select("id", "tkey", "gram", F.posexplode("wins").alias("j", "win"), "start")
            .select("id", "tkey", (F.col("start") + F.col("j")).cast("int").alias("start"), "gram", "win"))
    low = F.coalesce("id", F.lit(-(1 << 63)))
    # equal rows have equal places and do not repeat each other
    place = F.xxhash64(low, "tkey", "start")
    twice = flat.groupBy("gram", "win").agg(
        F.min(low).alias("first_id"), F.min(place).alias("p0"), F.max(place).alias("p1")
    ).where("p0 < p1").select("gram", "win", "first_id")
    # written, so that both sides of the join are shuffled for it and a window
    # that very many texts have is split over tasks
    return flat.join(written(twice, "twice"), ["gram", "win"])


def passages(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per text with repeated passages: ``id_col``, text_key,
    ``passages`` (first word and word after the last of every longest run of
    words covered by 50-word windows that occur elsewhere, in this or another
    text) and ``cut`` (the part of them that is not the first occurrence:
    first is the smallest id, and in it the leftmost place).

    Words are runs of non-separators, compared as they are. Texts that are
    null, empty or shorter than 50 words have no row. Rows equal in id and
    text are one document: they do not repeat each other and share one row.
    A null id sorts before all others. Other columns are not read."""
    ensure_checkpoint_dir(docs.sparkSession)
    hits = repeated_windows(docs, id_col, text_col)
    # all places of one text: bounded by the length of the text
    mine = F.coalesce("id", F.lit(-(1 << 63))) == F.col("first_id")
    own = hits.groupBy("id", "tkey").agg(F.collect_set(F.when(mine, F.struct("start", "win"))).alias("mine"),
                                         F.collect_set(F.when(~mine, F.col("start"))).alias("other"))
    ship_package(docs.sparkSession)

    spans = "array<struct<lo:long,hi:long>>"

    def run(batch: pa.RecordBatch):
        found, cut = [], []
        for mine, other in zip(batch.column("mine"), batch.column("other")):
            start, win = (mine.values.field(i).to_numpy(zero_copy_only=False) for i in range(2))
            order = np.argsort(start, kind="stable")
            start, win = start[order], win[order]
            other = other.values.to_numpy(zero_copy_only=False)
            leftmost = np.zeros(len(win), bool)
            leftmost[np.unique(win, return_index=True)[1]] = True
            size = int(max([*start[-1:], other.max(initial=0)])) + WORDS
            found.append(_runs(_covered(start, size) | _covered(other, size)))
            # words of a first occurrence stay, also where it overlaps itself
            stay = _covered(start[leftmost], size)
            cut.append(_runs(_covered(other, size) | (_covered(start[~leftmost], size) & ~stay)))
        yield {"id": batch.column("id"), "tkey": batch.column("tkey"), "passages": found, "cut": cut}

    out = map_arrow(own, run, f"id long, tkey long, passages {spans}, cut {spans}")
    return out.select(F.col("id").alias(id_col), F.col("tkey").alias("text_key"), "passages", "cut")


def _covered(start: np.ndarray, size: int) -> np.ndarray:
    """Words covered by the 50-word windows at ``start``."""
    n = np.bincount(start, minlength=size + 1) - np.bincount(start + WORDS, minlength=size + 1)
    return np.cumsum(n[:size]) > 0


def _runs(covered: np.ndarray) -> list[dict]:
    edge = np.flatnonzero(np.diff(np.concatenate([[0], covered.astype(np.int8), [0]])))
    return [{"lo": int(a), "hi": int(z)} for a, z in zip(edge[::2], edge[1::2])]


def cut_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length_col: str | None = None) -> DataFrame:
    """``docs`` with every occurrence of a repeated passage but the first cut
    out of the text; ``length_col`` gets the new length of a text that
    changed. Rows of which no word is left go; all others stay as they are."""
    row, tkey, spans, new = (unused(docs, c) for c in ("of_id", "of_text", "spans", "shorter"))
    found = written(passages(docs, id_col, text_col).where(F.size("cut") > 0)
                    .select(F.col(id_col).alias(row), F.col("text_key").alias(tkey), F.col("cut").alias(spans)), "passages")
    ship_package(docs.sparkSession)
    small_batches(docs.sparkSession)

    @arrow_udf("string")
    def without(text: pa.Array, cut: pa.Array) -> pa.Array:
        return pa.array([_without(t, c) for t, c in zip(text.to_pylist(), cut.to_pylist())], pa.string())

    text = F.col(f"`{text_col}`")
    key = _text_key(text.cast("string"))
    small = found.limit(200_001).count() <= 200_000
    side = F.broadcast(found) if small and _spans_bounded(found, spans) else found
    j = docs.join(side, F.col(f"`{id_col}`").cast("long").eqNullSafe(F.col(row)) & (key == F.col(tkey)), "left")
    same = j.where(F.col(spans).isNull()).select(*[F.col(f"`{c}`") for c in docs.columns])
    changed = j.where(F.col(spans).isNotNull()).withColumn(new, without(text.cast("string"), F.col(spans)))
    changed = changed.where(F.length(F.regexp_replace(new, "[\\x20\\x09-\\x0D]+", "")) > 0)
    cols = []
    for f in docs.schema.fields:
        c = F.col(f"`{f.name}`")
        if f.name == text_col:
            c = F.col(new)
        elif f.name == length_col:
            c = F.length(new)
        cols.append(c.cast(f.dataType).alias(f.name))
    return same.unionAll(changed.select(*cols))


def _spans_bounded(found: DataFrame, spans: str) -> bool:
    """At most a million spans in all: 16 MB."""
    return (found.agg(F.sum(F.size(spans))).first()[0] or 0) <= 1_000_000


def _without(text: str | None, cut: list[dict] | None) -> str | None:
    if text is None or not cut:
        return text
    raw = text.encode()
    b = next(blocks(pa.array([text])))
    out, at = [], 0
    for c in cut:
        out.append(raw[at:b.starts[c["lo"]]])
        at = b.ends[c["hi"] - 1]
    return b"".join([*out, raw[at:]]).decode()
