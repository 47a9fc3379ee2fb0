"""Quality rules as a bitmask ledger.

Every rule is evaluated once per document; the ledger keeps the measurements
and one failure bit per rule. Policies are versioned sets of rules, so a
verdict, a new policy version or an ablation is bit arithmetic over the
ledger and never reads a text again.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from moodgauge.llm.common import map_arrow, small_batches, unused
from moodgauge.llm.words import blocks, mix, spans_hash, window_hash
from moodgauge.session import ship_package

WINDOW = 8
_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(b"#*$%&|<>")] = True

MEASURES = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long"

# Rule number in this list = bit in the ledger. A rule is a SQL condition on
# the measurements that is true when the document fails; append, never reorder.
RULES = [
    ("few_words", "n_words < 20"),
    ("repeated_windows", "100 * n_repeat_words > 30 * n_words"),
    ("many_symbols", "10 * n_symbols > n_words"),
    ("repeated_lines", "10 * n_dup_lines > n_words"),
    ("long_words", "word_chars > 12 * n_words"),
    ("short_words", "word_chars < 2 * n_words"),
]
BIT = {name: i for i, (name, _) in enumerate(RULES)}

BASE = ("few_words", "repeated_windows")
POLICIES = {
    "base": BASE,
    "v1": BASE + ("many_symbols", "repeated_lines", "long_words", "short_words"),
}
DEFAULT_POLICY = "v1"


def mask(policy: str | tuple[str, ...]) -> int:
    names = POLICIES[policy] if isinstance(policy, str) else policy
    return sum(1 << BIT[n] for n in names)


def measure_texts(column) -> dict[str, np.ndarray]:
    """Measurements of a column of texts; nulls and empty texts have zeros."""
    n = len(column)
    out = {k: np.zeros(n, np.int64) for k in
           ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")}
    for b in blocks(column):
        rows = slice(b.first, b.first + b.n_texts)
        out["n_words"][rows] = b.n_words
        # code points in words: all lead bytes but the separators
        sep = (b.data == 0x20) | ((b.data >= 0x09) & (b.data <= 0x0D))
        out["word_chars"][rows] = b.count(((b.data & 0xC0) != 0x80) & ~sep)
        out["n_symbols"][rows] = b.count(_SYMBOL[b.data])
        out["n_dup_lines"][rows] = _dup_lines(b)
        out["n_repeat_words"][rows] = _repeat_words(b)
    return out


def _dup_lines(b) -> np.ndarray:
    breaks = np.flatnonzero(b.data == 0x0A)
    lo = np.sort(np.concatenate([b.offsets[:-1], breaks + 1]))
    hi = np.sort(np.concatenate([b.offsets[1:], breaks]))
    worded = np.searchsorted(b.starts, hi) > np.searchsorted(b.starts, lo)
    lo, hi = lo[worded], hi[worded]
    text = np.searchsorted(b.offsets, lo, "right") - 1
    key = mix(spans_hash(b.data, lo, hi) ^ (text.astype(np.uint64) << np.uint64(32)))
    _, at = np.unique(key, return_index=True)
    n = np.bincount(text, minlength=b.n_texts)
    return n - np.bincount(text[at], minlength=b.n_texts)


def _repeat_words(b) -> np.ndarray:
    first, text = b.windows(WINDOW)
    if not len(first):
        return np.zeros(b.n_texts, np.int64)
    key = mix(window_hash(b.word_hash(), first, WINDOW) ^ (text.astype(np.uint64) << np.uint64(32)))
    order = np.argsort(key)
    same = key[order[1:]] == key[order[:-1]]
    twice = np.zeros(len(key), bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    at = first[twice]
    n = len(b.starts)
    cover = np.bincount(at, minlength=n + WINDOW) - np.bincount(at + WINDOW, minlength=n + WINDOW)
    c = np.concatenate([[0], np.cumsum(np.cumsum(cover[:n]) > 0)])
    return c[b.word_at[1:]] - c[b.word_at[:-1]]


def fail_bits() -> Column:
    bits = [F.when(F.expr(cond), F.lit(1 << i)).otherwise(F.lit(0)).cast("long")
            for i, (_, cond) in enumerate(RULES)]
    total = bits[0]
    for b in bits[1:]:
        total = total.bitwiseOR(b)
    return total


def ledger(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: ``id_col``, the measurements and ``fail_bits``.

    Null and empty texts measure zero and so fail ``few_words``; repeated
    rows are measured each; other columns are not read. Work is row-local:
    no shuffle, and a task holds one Arrow batch."""
    src = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    id_type = src.schema["id"].dataType.simpleString()

    def run(batch: pa.RecordBatch):
        yield {"id": batch.column("id"), **measure_texts(batch.column("text"))}

    rows = map_arrow(src, run, f"id {id_type}, {MEASURES}").withColumn("fail_bits", fail_bits())
    return rows.withColumnRenamed("id", id_col) if id_col != "id" else rows


def passes(policy: str | tuple[str, ...] = DEFAULT_POLICY, bits: str = "fail_bits") -> Column:
    return F.col(bits).bitwiseAND(F.lit(mask(policy)).cast("long")) == 0


def ablations(led: DataFrame, policy: str | tuple[str, ...] = DEFAULT_POLICY) -> DataFrame:
    """Per rule of the policy: documents that fail it, that fail it alone
    (they would come back if it were dropped), and the kept count without it.
    The ledger is first reduced to one row per distinct mask."""
    names = POLICIES[policy] if isinstance(policy, str) else policy
    bits = F.col("fail_bits").bitwiseAND(F.lit(mask(names)).cast("long"))
    by_mask = led.groupBy(bits.alias("m")).agg(F.count(F.lit(1)).alias("n"))
    rules = led.sparkSession.createDataFrame([(n, 1 << BIT[n]) for n in names], "rule string, bit long")
    # both sides are bounded by the rule list: at most 2**rules masks
    pairs = by_mask.select("n", "m", F.explode(F.lit([1 << BIT[n] for n in names]).cast("array<long>")).alias("bit"))
    hit = F.col("m").bitwiseAND(F.col("bit")) != 0
    alone = F.col("m") == F.col("bit")
    kept = F.col("m").isin(0) | alone
    agg = pairs.groupBy("bit").agg(F.sum(F.when(hit, F.col("n")).otherwise(0)).alias("n_failed"),
                                   F.sum(F.when(alone, F.col("n")).otherwise(0)).alias("n_failed_alone"),
                                   F.sum(F.when(kept, F.col("n")).otherwise(0)).alias("n_kept_without"))
    return rules.join(agg, "bit", "left").select(
        "rule", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("n_failed", "n_failed_alone", "n_kept_without")])


def keep_documents(docs: DataFrame, policy: str = DEFAULT_POLICY, id_col: str = "doc_id",
                   text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, all columns as they are, whose text passes the
    policy. Decided row by row, so ids may be null or repeated. Rows go
    through the workers batch by batch with their measurements beside them:
    nothing is queued or joined."""
    spark = docs.sparkSession
    ship_package(spark)
    small_batches(spark)
    name, words = unused(docs, "measures"), unused(docs, "words")
    src = docs.withColumn(words, F.col(f"`{text_col}`").cast("string"))
    same = docs.schema[text_col].dataType.simpleString() == "string"
    src = docs if same else src
    at = src.columns.index(text_col if same else words)
    fields = StructType.fromDDL(MEASURES)

    def run(batches):
        for batch in batches:
            m = measure_texts(batch.column(at))
            found = pa.StructArray.from_arrays([pa.array(v) for v in m.values()], names=list(m))
            yield pa.RecordBatch.from_arrays([*batch.columns, found], names=[*batch.schema.names, name])
        pa.default_memory_pool().release_unused()

    led = src.mapInArrow(run, StructType([*src.schema.fields, StructField(name, fields)]))
    bits = [F.when(F.expr(re.sub(r"\b([a-z]+_[a-z_]+)\b", rf"`{name}`.\1", cond)), F.lit(1 << i)).otherwise(F.lit(0))
            for i, (_, cond) in enumerate(RULES)]
    fail = bits[0]
    for b in bits[1:]:
        fail = fail.bitwiseOR(b)
    return led.where(fail.bitwiseAND(F.lit(mask(policy))) == 0).select(*[F.col(f"`{c}`") for c in docs.columns])
