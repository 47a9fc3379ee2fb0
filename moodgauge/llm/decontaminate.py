"""Benchmark decontamination: a BM25 index of the test items, searched with
every passage of every text by block-max WAND.

Passages are windows of two strides of words, one stride apart; a stride is
at least as long as any item of its index, so an item copied into a text lies
whole in some passage. Impacts are divided by the item's score of itself: an
item scores 1 if the passage has all its words, and one threshold holds for
all items.

Search of a batch of passages, all in array arithmetic:
1. the terms of a passage are taken by ascending maximum impact; the first
   ones whose maxima stay below the threshold in sum cannot bring any item to
   it alone (the WAND pivot), so only the posting blocks of the others are
   opened;
2. the maxima of the opened blocks plus that remainder bound each block of
   items; blocks below the threshold are skipped;
3. items of the blocks left are scored in full;
4. retrieved items are verified: the passage must have half of the word pairs
   of the item's question and half of the words of its answer.
"""

from __future__ import annotations

import re
import unicodedata
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from moodgauge.llm.common import map_arrow, written
from moodgauge.llm.words import blocks, string_array, window_hash
from moodgauge.session import ensure_checkpoint_dir, ship_package

K1, B = 1.2, 0.75
THRESHOLD = 0.6
# the last quarter of an item's words is its answer
ANSWER_SHARE = 0.25
QUESTION_GRAM, ANSWER_GRAM, OVERLAP = 2, 1, 0.5
ITEMS_PER_BLOCK = 8
MIN_STRIDE = 64
# items per index; a larger benchmark is searched index by index
INDEX_WORDS = 2_000_000

# scripts that are written without spaces: each of their code points is a word
_UNSPACED = [(0x0E00, 0x0EFF), (0x1000, 0x109F), (0x1780, 0x17FF), (0x3041, 0x30FF), (0x3400, 0x4DBF),
             (0x4E00, 0x9FFF), (0xF900, 0xFAFF), (0x20000, 0x3FFFF)]


def _separator_ranges() -> list[tuple[int, int]]:
    """Runs of non-ASCII spaces, punctuation, symbols and controls."""
    out: list[tuple[int, int]] = []
    for c in range(0x80, 0x10000):
        kind = unicodedata.category(chr(c))
        if kind[0] in "ZPS" or kind == "Cc":
            if out and out[-1][1] == c - 1:
                out[-1] = out[-1][0], c
            else:
                out.append((c, c))
    return out


_SEPARATORS = _separator_ranges()
_SEPARATOR = re.compile("[" + "".join(f"{chr(a)}-{chr(z)}" for a, z in _SEPARATORS) + "]")
_LETTER = re.compile("[" + "".join(f"{chr(a)}-{chr(z)}" for a, z in _UNSPACED) + "]")
# the same characters for Arrow's regular expressions
_CHANGED = "[" + "".join(f"\\x{{{a:X}}}-\\x{{{z:X}}}" for a, z in _SEPARATORS + _UNSPACED) + "]"


def spaced(column) -> pa.Array:
    """A column of texts in which non-ASCII separators are spaces, and code
    points of unspaced scripts stand between spaces. Texts without such
    characters are as they were."""
    texts = string_array(column)
    at = np.flatnonzero(pc.match_substring_regex(texts, _CHANGED).to_numpy(zero_copy_only=False)) if len(texts) else []
    if not len(at):
        return texts
    out = texts.to_pylist()
    for i in at:
        out[i] = _LETTER.sub(r" \g<0> ", _SEPARATOR.sub(" ", out[i]))
    return pa.array(out, pa.large_string())


# letters and digits make words here: ASCII punctuation separates them
_PUNCT = np.array([c < 128 and not chr(c).isalnum() for c in range(256)])


@dataclass
class Index:
    """Inverted index of a few items; terms are numbered by ascending
    maximum impact."""

    stride: int
    items: np.ndarray           # row numbers of the items
    vocab: np.ndarray           # sorted word hashes
    term_of: np.ndarray         # term number of each of them
    term_max: np.ndarray        # by term
    block_at: np.ndarray        # postings of term t: block_at[t]:block_at[t + 1]
    block: np.ndarray
    block_max: np.ndarray
    block_terms: list[np.ndarray]    # by block: its terms, and their impacts
    impacts: list[np.ndarray]        # on its items (terms x items)
    question: list[np.ndarray]  # hashes of word pairs
    answer: list[np.ndarray]    # hashes of words


def _grams(words: np.ndarray, size: int) -> np.ndarray:
    n = min(size, len(words))
    return np.unique(window_hash(words, np.arange(len(words) - n + 1), n)) if n else np.zeros(0, np.uint64)


def build(items: list[tuple[int, np.ndarray]], df: dict[int, int], n_items: int, mean_words: float) -> Index:
    """Index of (row number, word hashes) given statistics of all items."""
    # items that share their commonest words (those of one language) make
    # blocks together, so a block's maxima stay close to its items' impacts
    items = sorted(items, key=lambda x: (max((df[t], t) for t in x[1].tolist()), len(x[1]), x[0]))
    words = [w for _, w in items]
    term, tf, at = [], [], [0]
    for w in words:
        t, n = np.unique(w, return_counts=True)
        term.append(t)
        tf.append(n)
        at.append(at[-1] + len(t))
    term, tf, at = np.concatenate(term), np.concatenate(tf), np.array(at)
    idf = np.array([np.log(1 + (n_items - df[t] + 0.5) / (df[t] + 0.5)) for t in term.tolist()])
    size = np.repeat([len(w) for w in words], np.diff(at))
    impact = idf * tf * (K1 + 1) / (tf + K1 * (1 - B + B * size / mean_words))
    impact /= np.repeat(np.add.reduceat(impact, at[:-1]), np.diff(at))
    vocab, inv = np.unique(term, return_inverse=True)
    top = np.zeros(len(vocab))
    np.maximum.at(top, inv, impact)
    term_of = np.empty(len(vocab), np.int64)
    term_of[np.argsort(top, kind="stable")] = np.arange(len(vocab))
    item_term = term_of[inv]
    block = np.repeat(np.arange(len(items)) // ITEMS_PER_BLOCK, np.diff(at))
    n_blocks = int(block[-1]) + 1
    key, inv = np.unique(item_term * n_blocks + block, return_inverse=True)
    block_max = np.zeros(len(key))
    np.maximum.at(block_max, inv, impact)
    block_terms, impacts = [], []
    for first in range(0, len(items), ITEMS_PER_BLOCK):
        last = min(first + ITEMS_PER_BLOCK, len(items))
        own = slice(at[first], at[last])
        terms, row = np.unique(item_term[own], return_inverse=True)
        weight = np.zeros((len(terms), last - first), np.float32)
        weight[row, np.repeat(np.arange(last - first), np.diff(at[first:last + 1]))] = impact[own]
        block_terms.append(terms)
        impacts.append(weight)
    cut = [len(w) - max(1, int(len(w) * ANSWER_SHARE)) if len(w) > 1 else 1 for w in words]
    return Index(max(MIN_STRIDE, max(map(len, words))), np.array([i for i, _ in items]), vocab, term_of, np.sort(top),
                 np.searchsorted(key // n_blocks, np.arange(len(vocab) + 1)), key % n_blocks, block_max,
                 block_terms, impacts,
                 [_grams(w[:c], QUESTION_GRAM) for w, c in zip(words, cut)], [_grams(w[c:], ANSWER_GRAM) for w, c in zip(words, cut)])


def _spread(start: np.ndarray, count: np.ndarray) -> np.ndarray:
    """start[i], start[i] + 1, ... (count[i] of them) for every i."""
    before = np.cumsum(count) - count
    return np.arange(int(count.sum())) - np.repeat(before - start, count)


def search(index: Index, b, word_hash: np.ndarray) -> list[tuple[int, int, float, float, float]]:
    """(text, item, score, question overlap, answer overlap) of the verified
    items in the texts of a block, the best passage of each."""
    v = np.minimum(np.searchsorted(index.vocab, word_hash), len(index.vocab) - 1)
    at = np.flatnonzero(index.vocab[v] == word_hash)
    if not len(at):
        return []
    term = index.term_of[v[at]]
    text = np.searchsorted(b.word_at, at, "right") - 1
    strides = np.maximum(-(-b.n_words // index.stride), 1)
    n_pass = np.maximum(strides - 1, 1)
    base = np.cumsum(n_pass) - n_pass
    j = (at - b.word_at[text]) // index.stride
    n_terms = len(index.vocab)
    key = np.concatenate([(base[text] + np.minimum(j, n_pass[text] - 1)) * n_terms + term,
                          (base[text] + np.maximum(j - 1, 0)) * n_terms + term])
    key = np.unique(key)
    passage, term = np.divmod(key, n_terms)
    # pivot: terms of a passage come by ascending maximum impact
    top = index.term_max[term]
    total = np.cumsum(top)
    first = np.searchsorted(passage, passage)
    reach = total - (total - top)[first]
    opened = reach >= THRESHOLD - 1e-9
    if not opened.any():
        return []
    below = np.bincount(passage[~opened], top[~opened], minlength=int(base[-1] + n_pass[-1]))
    n_blocks = int(index.block.max()) + 1
    t = term[opened]
    count = index.block_at[t + 1] - index.block_at[t]
    post = _spread(index.block_at[t], count)
    pair, inv = np.unique(np.repeat(passage[opened], count) * n_blocks + index.block[post], return_inverse=True)
    bound = np.bincount(inv, index.block_max[post])
    cand_pass, cand_block = np.divmod(pair, n_blocks)
    alive = bound + below[cand_pass] >= THRESHOLD - 1e-9
    cand_pass, cand_block = cand_pass[alive], cand_block[alive]
    if not len(cand_pass):
        return []
    # full scores of the items of the blocks left
    hits = []
    for rows in _slices(cand_pass):
        hits += _full_scores(index, passage, term, cand_pass[rows], cand_block[rows])
    best: dict[tuple[int, int], tuple[float, float, float]] = {}
    for p, i, score in hits:
        d = int(np.searchsorted(base, p, "right")) - 1
        lo = int(b.word_at[d]) + (p - int(base[d])) * index.stride
        words = word_hash[lo:min(lo + 2 * index.stride, int(b.word_at[d + 1]))]
        q, a = (_share(part[i], words) for part in (index.question, index.answer))
        found = (score, q, a)
        if q >= OVERLAP and a >= OVERLAP and found > best.get((d, i), (0.0, 0.0, 0.0)):
            best[d, i] = found
    return [(d, int(index.items[i]), *f) for (d, i), f in sorted(best.items())]


PASSAGES = 1024     # scored together at most


def _slices(cand_pass: np.ndarray):
    """Cut candidates (sorted by passage) so that few passages meet."""
    new = np.concatenate([[True], cand_pass[1:] != cand_pass[:-1]])
    place = np.cumsum(new) - 1
    cuts = np.searchsorted(place, np.arange(0, place[-1] + PASSAGES + 1, PASSAGES))
    return (slice(a, z) for a, z in zip(cuts, cuts[1:]) if a < z)


def _full_scores(index: Index, passage, term, cand_pass, cand_block) -> list[tuple[int, int, float]]:
    """(passage, item, score) at the threshold or above, among the items of
    the candidate blocks; ``passage`` and ``term`` are sorted pairs."""
    own = np.unique(cand_pass)
    a, z = np.searchsorted(passage, [own[0], own[-1] + 1])
    row = np.searchsorted(own, passage[a:z])
    keep = own[np.minimum(row, len(own) - 1)] == passage[a:z]
    local, col = np.unique(term[a:z][keep], return_inverse=True)
    has = np.zeros((len(own), len(local)), np.float32)
    has[row[keep], col] = 1
    out = []
    order = np.argsort(cand_block, kind="stable")
    blocks_, cut = np.unique(cand_block[order], return_index=True)
    for b, of in zip(blocks_.tolist(), np.split(np.searchsorted(own, cand_pass[order]), cut[1:])):
        at = np.minimum(np.searchsorted(local, index.block_terms[b]), len(local) - 1)
        there = local[at] == index.block_terms[b]
        score = has[np.ix_(of, at[there])] @ index.impacts[b][there]
        for p, i in np.argwhere(score >= THRESHOLD - 1e-4):
            # in full precision
            exact = float(has[of[p], at[there]].astype(np.float64) @ index.impacts[b][there, i].astype(np.float64))
            if exact >= THRESHOLD - 1e-6:
                out.append((int(own[of[p]]), b * ITEMS_PER_BLOCK + int(i), exact))
    return out


def _share(grams: np.ndarray, words: np.ndarray) -> float:
    if not len(grams):
        return 1.0
    have = [window_hash(words, np.arange(max(len(words) - n + 1, 0)), n) for n in range(1, QUESTION_GRAM + 1)]
    return float(np.isin(grams, np.concatenate(have)).mean())


# --------------------------------------------------------------------------
# Spark plan
# --------------------------------------------------------------------------

def _item_words(benchmark: DataFrame, id_col: str, text_col: str) -> DataFrame:
    src = benchmark.select(F.col(id_col).cast("long").alias("item"), F.col(text_col).cast("string").alias("text"))

    def run(batch: pa.RecordBatch):
        ids = batch.column("item")
        for b in blocks(spaced(batch.column("text")), separators=_PUNCT):
            yield {"item": ids.slice(b.first, b.n_texts),
                   "words": pa.ListArray.from_arrays(pa.array(b.word_at, pa.int32()), pa.array(b.word_hash(lower=True).view(np.int64)))}

    return map_arrow(src, run, "item long, words array<long>").where(F.size("words") > 0)


def indexes(benchmark: DataFrame, id_col: str = "item_id", text_col: str = "text"):
    """Indexes of a benchmark, each of at most INDEX_WORDS words (or one
    item), with the item ids of their row numbers; statistics are those of
    the whole benchmark. Yields (list of Index, list of ids)."""
    spark = benchmark.sparkSession
    ensure_checkpoint_dir(spark)
    items = written(_item_words(benchmark, id_col, text_col), "items")
    n_items, n_words = items.agg(F.count(F.lit(1)), F.sum(F.size("words"))).first()
    if not n_items:
        return
    groups = max(1, -(-n_words // INDEX_WORDS))
    df = items.select(F.explode(F.array_distinct("words")).alias("t")).groupBy("t").agg(F.count(F.lit(1)).alias("n"))
    df = written(df, "terms") if groups > 1 else df
    part = F.pmod(F.xxhash64("words"), F.lit(groups))
    for g in range(groups):
        own = items.where(part == g) if groups > 1 else items
        rows = own.collect()        # at most about INDEX_WORDS words
        if not rows:
            continue
        need = own.select(F.explode("words").alias("t")).distinct()
        freq = {np.int64(r.t).view(np.uint64).item(): r.n for r in (df.join(need, "t", "left_semi") if groups > 1 else df).collect()}
        parsed = sorted(((i, np.array(r.words, np.int64).view(np.uint64)) for i, r in enumerate(rows)),
                        key=lambda x: (len(x[1]), x[0]))
        # one index for each power of two of the item length
        by_size: dict[int, list] = {}
        for i, w in parsed:
            by_size.setdefault(max(MIN_STRIDE, len(w) - 1).bit_length(), []).append((i, w))
        yield [build(x, freq, n_items, n_words / n_items) for x in by_size.values()], [r.item for r in rows]


def _search_texts(found: list[Index], column):
    for b in blocks(spaced(column), separators=_PUNCT):
        wh = b.word_hash(lower=True)
        for index in found:
            for text, item, *scores in search(index, b, wh):
                yield b.first + text, item, *scores


def leaks(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text",
          item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """One row per text and item that leaked into it: ``id_col``, item_id,
    score (share of the item's BM25 score, 0.6 or more), question_overlap
    (share of its word pairs, 0.5 or more) and answer_overlap (share of its
    words, 0.5 or more) of the best passage. An answer is the last quarter of
    an item's words; of a single word there is none, which overlaps in full.

    Words are lower-cased (A-Z) runs between white space, punctuation and
    symbols of any script; each code point of a script that is written
    without spaces (Chinese, Japanese, Thai, ...) is a word.
    Null and empty texts and items match nothing; an empty benchmark gives no
    rows; repeated rows and items are answered each; ids may be null. Work is
    row-local: nothing but the index (bounded, see INDEX_WORDS) is moved."""
    spark = docs.sparkSession
    src = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    schema = (f"id {src.schema['id'].dataType.simpleString()}, item_id long, score double, "
              "question_overlap double, answer_overlap double")
    out = None
    for found, ids in indexes(benchmark, item_col, item_text_col):
        shared = spark.sparkContext.broadcast((found, ids))

        def run(batch: pa.RecordBatch, shared=shared):
            found, ids = shared.value
            hits = list(_search_texts(found, batch.column("text")))
            cols = list(zip(*hits)) if hits else [[]] * 5
            yield {"id": batch.column("id").take(pa.array(cols[0], pa.int64())), "item_id": [ids[i] for i in cols[1]],
                   "score": cols[2], "question_overlap": cols[3], "answer_overlap": cols[4]}

        part = map_arrow(src, run, schema)
        out = part if out is None else out.unionAll(part)
    if out is None:
        out = spark.createDataFrame([], schema)
    return out.withColumnRenamed("id", id_col) if id_col != "id" else out


def keep_clean(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id",
               item_text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, all columns as they are, into whose text no item
    leaked. Decided row by row, so ids may be null or repeated."""
    spark = docs.sparkSession
    ship_package(spark)
    text = F.col(f"`{text_col}`").cast("string")
    for found, _ in indexes(benchmark, item_col, item_text_col):
        docs = docs.where(_clean(spark.sparkContext.broadcast(found))(text))
    return docs


def _clean(shared):
    @arrow_udf("boolean")
    def clean(text: pa.Array) -> pa.Array:
        ok = np.ones(len(text), bool)
        ok[[hit[0] for hit in _search_texts(shared.value, text)]] = False
        return pa.array(ok)

    return clean
