"""Candidate consensus over landed model responses.

Input: ``responses(entity, run, attempt, text)``; calling a model is not
part of this library. Per response the candidates are extracted with
built-in regex and array functions (row-local, no shuffle); per run the
first acceptable attempt is kept; per entity the terms named by the most
runs win.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import (BANNED_KEYWORDS, keyword_candidates,
                              ordered_distinct_head, symbol_candidates)


def extract_keywords(responses: DataFrame, k: int = 15,
                     banned: list[str] | None = None, text_col: str = "text") -> DataFrame:
    """G1: lower-cased whole words ``[a-z][a-z0-9]+``, minus the banned
    words, distinct in first-seen order, first ``k``. Adds ``words``."""
    b = BANNED_KEYWORDS if banned is None else banned
    return responses.withColumn(
        "words", ordered_distinct_head(keyword_candidates(text_col), k, b))


def extract_symbols(responses: DataFrame, k: int = 6, entity_col: str = "entity",
                    symbol_col: str | None = None, text_col: str = "text") -> DataFrame:
    """Symbols ``[A-Z]{1,5}`` with an optional ``.X``, case-sensitive,
    minus the entity's own symbol (``symbol_col``, else the upper-cased
    entity), distinct in order, first ``k``. Adds ``words``."""
    own = F.upper(F.col(symbol_col or entity_col))
    cands = F.filter(symbol_candidates(text_col), lambda s: s != own)
    return responses.withColumn("words", F.slice(F.array_distinct(cands), 1, k))


def accept_attempt(df: DataFrame, k: int, floor: int = 3) -> DataFrame:
    """Per (entity, run) the first attempt with at least
    ``least(k, max(floor, k // 2))`` words (keywords: floor 3; symbols:
    floor 2). Runs without such an attempt yield no row."""
    need = min(k, max(floor, k // 2))
    ok = df.where(F.size("words") >= need)
    return (ok.groupBy("entity", "run")
              .agg(F.min_by(F.struct("attempt", "words"), F.col("attempt")).alias("a"))
              .select("entity", "run", F.col("a.attempt").alias("attempt"),
                      F.col("a.words").alias("words")))


def consensus_topk(accepted: DataFrame, k: int, normalize: str = "lower") -> DataFrame:
    """Per entity, count the runs each term appears in (once per run)
    and keep the ``k`` most frequent. Ties: earliest run, then position in
    that run, then the term.

    Output (entity, rank, term, n_runs). The (entity, term) counts are a
    partial aggregate; the top-k window gets a partial WindowGroupLimit
    before its shuffle, so a hot entity sends at most ``k`` rows per task.
    """
    norm = F.lower if normalize == "lower" else F.upper
    ex = accepted.select("entity", "run",
                         F.posexplode("words").alias("pos", "term"))
    ex = ex.withColumn("term", F.trim(norm("term")))
    per_run = ex.groupBy("entity", "run", "term").agg(F.min("pos").alias("pos"))
    counts = per_run.groupBy("entity", "term").agg(
        F.count(F.lit(1)).alias("n_runs"),
        F.min(F.struct("run", "pos")).alias("first"))
    w = Window.partitionBy("entity").orderBy(
        F.col("n_runs").desc(), F.col("first.run"), F.col("first.pos"), F.col("term"))
    return (counts.withColumn("rank", F.row_number().over(w))
                  .where(F.col("rank") <= k)
                  .select("entity", F.col("rank").cast("bigint").alias("rank"),
                          "term", "n_runs"))
