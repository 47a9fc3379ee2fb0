"""Feature merge and the (ticker, date) join contract (K1-K4)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

KEYS = ["ticker", "date"]


def merge_features(*dfs: DataFrame, keys: list[str] | None = None,
                   how: str = "inner") -> DataFrame:
    """K1: equi-join feature and label tables on ``(ticker, date)``.

    No join hint: with AQE on, Spark reads the runtime size of each side and
    picks a broadcast or a sort-merge join; inputs already hash-partitioned
    on the keys by their own daily aggregates are joined without another
    shuffle.
    """
    k = keys or KEYS
    return reduce(lambda a, b: a.join(b, k, how), dfs)


def check_join_contract(df: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """K2: one row: total rows, rows with a null key column, keys seen more
    than once and the rows in them. Computed with two aggregates (the
    per-key count is a partial aggregate, so a hot key is pre-reduced)."""
    k = keys or KEYS
    any_null = reduce(lambda a, b: a | b, [F.col(c).isNull() for c in k])
    per_key = df.groupBy(*k).agg(F.count(F.lit(1)).alias("n"),
                                 F.max(any_null.cast("int")).alias("has_null"))
    return per_key.agg(
        F.sum("n").cast("bigint").alias("n_rows"),
        F.coalesce(F.sum(F.when(F.col("has_null") == 1, F.col("n"))), F.lit(0))
         .cast("bigint").alias("n_null_key_rows"),
        F.count(F.when((F.col("n") > 1) & (F.col("has_null") == 0), 1))
         .cast("bigint").alias("n_dup_keys"),
        F.coalesce(F.sum(F.when((F.col("n") > 1) & (F.col("has_null") == 0), F.col("n"))),
                   F.lit(0)).cast("bigint").alias("n_dup_rows"),
    )


def assert_join_contract(df: DataFrame, keys: list[str] | None = None) -> None:
    r = check_join_contract(df, keys).first()
    if r["n_null_key_rows"] or r["n_dup_keys"]:
        raise ValueError(f"join contract broken: {r.asDict()}")


def symbol_map(spark, names: list[str], symbols: list[str]) -> DataFrame:
    """K3: two parallel configuration lists zipped by position into an
    ``(entity, symbol, ord)`` dimension."""
    if len(names) != len(symbols):
        raise ValueError("names and symbols differ in length")
    z = F.arrays_zip(F.array(*[F.lit(x) for x in names]).alias("entity"),
                     F.array(*[F.lit(x) for x in symbols]).alias("symbol"))
    return spark.range(1).select(F.posexplode(z).alias("ord", "z")) \
        .select(F.col("z.entity").alias("entity"), F.col("z.symbol").alias("symbol"), "ord")


def attach_symbol(df: DataFrame, dim: DataFrame, entity_col: str = "entity") -> DataFrame:
    """K3: entity -> symbol through an equi-join with the dimension (AQE
    broadcasts it when small)."""
    d = dim.select(F.col("entity").alias(entity_col), "symbol")
    return df.join(d, entity_col, "left")


def roll_to_calendar(df: DataFrame, calendar: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """J5 on dates: each (ticker, date) of ``df`` moves to the first date at
    or after it that ``calendar`` (ticker, date) has, so a weekend counts to
    the next session; null past the last one. The as-of step runs on the
    distinct keys of both, one row per ticker and day."""
    t, d = keys or KEYS
    own = df.select(F.col(t).alias("__t"), F.col(d).alias("__d")).distinct()
    cal = calendar.select(F.col(t).alias("__t"), F.col(d).alias("__d")).distinct()
    u = own.withColumn("bar", F.lit(None).cast("date")).unionByName(cal.withColumn("bar", F.col("__d")))
    w = (Window.partitionBy("__t").orderBy(F.col("__d").desc(), F.col("bar").asc_nulls_last())
         .rowsBetween(Window.unboundedPreceding, 0))
    to = u.withColumn("__to", F.min("bar").over(w)).where(F.col("bar").isNull()).drop("bar")
    j = df.join(to, (F.col(t) == F.col("__t")) & (F.col(d) == F.col("__d")), "left")
    return j.withColumn(d, F.col("__to")).drop("__t", "__d", "__to")


def market_index_join(bars: DataFrame, index: DataFrame) -> DataFrame:
    """K4: stock bars left-joined with the index series on the date. The
    index has one row per date, so it stays small at any scale."""
    ix = index.select(F.col("date"), F.col("close").alias("index_close"))
    return bars.join(ix, "date", "left")
