"""Keep-first dedup, unions, ordered distinct lists and per-key caps
(E1-E3, F5-F7).

Arrival order does not exist in Spark, so every keep-first and cap takes an
explicit order key. Caps are ``row_number() <= n`` windows: Catalyst plans
them with a partial ``WindowGroupLimit`` before the shuffle, so each map task
sends at most ``n`` rows per key and a key holding a third of all rows is cut
down before it reaches one task.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _order(order) -> list[Column]:
    return [F.col(o) if isinstance(o, str) else o for o in
            (order if isinstance(order, (list, tuple)) else [order])]


def topk_per_key(df: DataFrame, keys: list[str], order, n: int,
                 rank_col: str | None = None) -> DataFrame:
    """First ``n`` rows per key in ``order`` (ties broken by the
    order list itself, so give it a unique last column)."""
    w = Window.partitionBy(*keys).orderBy(*_order(order))
    rn = rank_col or "__rn"
    out = df.withColumn(rn, F.row_number().over(w)).where(F.col(rn) <= n)
    return out if rank_col else out.drop(rn)


def dedupe_first(df: DataFrame, key, order) -> DataFrame:
    """Keep the first row per key in ``order``; null keys are dropped.

    A text as key is replaced by its SHA-256, 32 bytes for a text of any
    length, so no text is shuffled unless the caller wants it back."""
    kc = F.col(key) if isinstance(key, str) else key
    if df.select(kc.alias("k")).schema["k"].dataType.simpleString() == "string":
        kc = F.unhex(F.sha2(kc, 256))
    tmp = df.withColumn("__key", kc).where(F.col("__key").isNotNull())
    return topk_per_key(tmp, ["__key"], order, 1).drop("__key")


def union_pools(*dfs: DataFrame) -> DataFrame:
    """Union all by column name (missing columns become null)."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), dfs)


def expand_universe(base: DataFrame, peers: DataFrame) -> DataFrame:
    """Ordered distinct union of base tickers and their peers, upper-cased.

    ``base``: (ticker, ord); ``peers``: (entity, ord, term) where entity is a
    base ticker. Order: base ticker order, the base ticker first, then its
    peers in their order. Output (ticker, ord) with ord 1-based over the
    universe.
    """
    b = base.select(F.upper("ticker").alias("entity_u"), F.col("ord").alias("bord"),
                    F.col("ticker").alias("entity"))
    own = b.select(F.col("entity_u").alias("ticker"), "bord", F.lit(-1).alias("pord"))
    p = (peers.join(b, "entity", "inner")
         .select(F.upper("term").alias("ticker"), "bord", F.col("ord").alias("pord")))
    allp = own.unionByName(p)
    first = allp.groupBy("ticker").agg(F.min(F.struct("bord", "pord")).alias("o"))
    w = Window.orderBy(F.col("o.bord"), F.col("o.pord"), "ticker")
    # the universe is a config-sized list (base x peers); one ordered window
    return first.select("ticker", F.row_number().over(w).cast("bigint").alias("ord"))


def buffered_limit(df: DataFrame, keys: list[str], order, keep, buffer: int | None = None,
                   limit: int = 200) -> DataFrame:
    """per key, buffer the first ``max(3*limit, 300)`` rows in ``order``,
    *then* apply the filter ``keep`` (a Column), *then* keep ``limit`` rows.
    The order of the three steps defines the output."""
    buf = buffer if buffer is not None else max(3 * limit, 300)
    stage1 = topk_per_key(df, keys, order, buf)
    return topk_per_key(stage1.where(keep), keys, order, limit)
