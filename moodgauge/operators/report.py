"""Daily sentiment statistics, rolling windows and box-plot numbers.

Shapes follow the reference report: one row per calendar day with
``n_posts`` (count of non-null ids, not rows), mean, sample std and var
(null on one-row days), exact median, and the mean of the daily std over the
last 5 *rows* with at least 2 values.

Scale notes
-----------
* Overall and per-group reports come from one ``GROUPING SETS`` aggregate:
  partial aggregation runs before the shuffle, so a hot group or day is
  pre-reduced on every map task and never gathered raw into one task.
* Exact medians and quartiles take two passes: a fixed-size sketch brackets
  them, and only the values inside the bracket are ranked, so no task holds
  the values of a hot day. ``median="approx"`` keeps the sketch's answer.
* Windows run on the daily table (one row per group and day), never on raw
  rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.time import coerce_date
from ..session import checked_broadcast, cut_lineage


def _score(col: str) -> Column:
    s = F.col(col).cast("double")
    return F.when(F.isnan(s), F.lit(None).cast("double")).otherwise(s)


def prepare(df: DataFrame, date_col: str, score_col: str, id_col: str = "id",
            group: str | None = None) -> DataFrame:
    """Coerce the date (bad -> null), NaN -> null, drop rows without a
    date or a score. Output columns: day, score, id[, grp]."""
    dtype = df.schema[date_col].dataType.simpleString()
    cols = [coerce_date(date_col, dtype).alias("day"), _score(score_col).alias("score"),
            F.col(id_col).alias("id")]
    if group:
        cols.append(F.col(group).cast("string").alias("grp"))
    return df.select(*cols).where(F.col("day").isNotNull() & F.col("score").isNotNull())


# relative rank error of the sketch that brackets a quantile; groups of up to
# ten times its inverse are ranked as they are
_SKETCH = 1_000


def _sketch(base: DataFrame, keys: list[str], probs: list[float]) -> DataFrame:
    """Written table, one row per key: ``qn`` (number of scores) and ``ends``,
    the sketched bounds that hold each quantile of ``probs`` between them."""
    gap = 2.0 / _SKETCH
    ends = [max(p - gap, 0.0) for p in probs] + [min(p + gap, 1.0) for p in probs]
    return cut_lineage(base.groupBy(*keys).agg(
        F.count("score").alias("qn"),
        F.percentile_approx("score", F.array(*[F.lit(e) for e in ends]), _SKETCH).alias("ends")))


def _cells(base: DataFrame, sketch: DataFrame, keys: list[str], probs: list[float], fences: bool = False) -> DataFrame:
    """Per key and quantile ``i``: ``v``, ``n`` for every value inside the
    bracket, and one cell without a value for the rows below it.

    With ``fences`` also what lies beyond the box's fences, as far as the
    brackets tell: i = -1 below and i = -2 above, every value that may be
    beyond, and one cell without a value for the others, of which ``lo`` and
    ``hi`` are the extremes."""
    small, _ = checked_broadcast(sketch)
    rows = base.select(*keys, "score").join(small if small is not None else sketch, keys)
    x, end, k = F.col("score"), F.col("ends"), len(probs)
    whole = F.col("qn") <= 10 * _SKETCH
    cells = [F.when(whole | (x <= end[i + k]), F.struct(
        F.lit(i).alias("i"), F.when(whole | (x >= end[i]), x).alias("v"))) for i in range(k)]
    if fences:      # the fences are 2.5 q1 - 1.5 q3 and 2.5 q3 - 1.5 q1
        below = whole | (x <= 2.5 * end[k] - 1.5 * end[k - 1])
        above = whole | (x >= 2.5 * end[k - 1] - 1.5 * end[k])
        cells += [F.struct(F.lit(-1).alias("i"), F.when(below, x).alias("v")),
                  F.struct(F.lit(-2).alias("i"), F.when(above, x).alias("v"))]
    cell = F.explode(F.filter(F.array(*cells), lambda c: c.isNotNull())).alias("c")
    return rows.select(*keys, "qn", "score", cell).groupBy(*keys, "qn", F.col("c.i").alias("i"), F.col("c.v").alias("v")).agg(
        F.count(F.lit(1)).alias("n"), F.min("score").alias("lo"), F.max("score").alias("hi"))


def _ranked(cells: DataFrame, keys: list[str], probs: list[float]) -> DataFrame:
    """``keys`` and ``q``, the quantiles in the order of ``probs``, from
    their cells."""
    # the rows below the bracket come first, as one null value
    upto = F.sum("n").over(Window.partitionBy(*keys, "i").orderBy(F.col("v").asc_nulls_first()))
    p = F.element_at(F.array(*[F.lit(x) for x in probs]), F.col("i") + 1)
    at = cells.where("i >= 0").withColumn("upto", upto).withColumn("pos", p * (F.col("qn") - 1))

    def value(rank):
        return F.max(F.when((F.col("upto") - F.col("n") <= rank) & (rank < F.col("upto")), F.col("v")))

    found = at.groupBy(*keys, "i").agg(value(F.floor("pos")).alias("a"), value(F.ceil("pos")).alias("z"),
                                       F.first("pos").alias("pos"))
    missed = F.raise_error(F.lit("a quantile lies outside its sketched bracket")).cast("double")
    q = F.when(F.col("a").isNull() | F.col("z").isNull(), missed).otherwise(
        F.col("a") + (F.col("z") - F.col("a")) * (F.col("pos") - F.floor("pos")))
    return found.select(*keys, "i", q.alias("v")).groupBy(*keys).agg(
        F.array(*[F.max(F.when(F.col("i") == i, F.col("v"))) for i in range(len(probs))]).alias("q"))


def exact_quantiles(base: DataFrame, keys: list[str], probs: list[float], sketch: DataFrame | None = None) -> DataFrame:
    """Exact linear quantiles of ``score`` per key (keys must not be null):
    ``keys`` and ``q``, an array in the order of ``probs``.

    A fixed-size sketch brackets each quantile. In a second pass the rows
    below a bracket collapse into one count and the values inside it into
    counts per value, both before the shuffle, so a key with most of all rows
    sends a few thousandths of them to the task that ranks. A quantile that
    its bracket doesn't hold fails the job."""
    sketch = _sketch(base, keys, probs) if sketch is None else sketch
    return _ranked(_cells(base, sketch, keys, probs), keys, probs)


def _stats():
    return [
        F.count("id").alias("n_posts"),
        F.avg("score").alias("score_mean"),
        F.stddev_samp("score").alias("score_std"),
        F.var_samp("score").alias("score_var"),
    ]


def _approx_median():
    return F.percentile_approx("score", 0.5, 10000).cast("double").alias("score_median")


def daily_stats(df: DataFrame, date_col: str = "date", score_col: str = "compound",
                id_col: str = "id", group: str | None = None,
                median: str = "exact") -> DataFrame:
    """Daily stats, overall or per group (null groups dropped).
    The median is exact, or that of a sketch with ``median="approx"``."""
    base = prepare(df, date_col, score_col, id_col, group)
    keys = ["day"]
    if group:
        base = base.where(F.col("grp").isNotNull())
        keys = ["grp", "day"]
    if median != "exact":
        return base.groupBy(*keys).agg(*_stats(), _approx_median())
    mid = exact_quantiles(base, keys, [0.5]).select(*keys, F.col("q")[0].alias("score_median"))
    return base.groupBy(*keys).agg(*_stats()).join(mid, keys)


def rolling_mean(daily: DataFrame, col: str = "score_std", group: str | None = None,
                 n: int = 5, min_obs: int = 2, unit: str = "rows",
                 out: str = "score_std_roll") -> DataFrame:
    """Mean of ``col`` over the last ``n`` rows (or ``n`` calendar
    days with ``unit='days'``); null unless the frame holds at least
    ``min_obs`` non-null values. A null current value still gets a mean."""
    parts = [group] if group else []
    if unit == "rows":
        w = Window.partitionBy(*parts).orderBy("day").rowsBetween(-(n - 1), 0)
    else:
        w = (Window.partitionBy(*parts).orderBy(F.unix_date("day"))
             .rangeBetween(-(n - 1), 0))
    return daily.withColumn(
        out, F.when(F.count(col).over(w) >= min_obs, F.avg(col).over(w)))


def sentiment_report(df: DataFrame, date_col: str = "date", score_col: str = "compound",
                     group: str | None = None, id_col: str = "id", rows: int = 5,
                     median: str = "exact") -> DataFrame:
    """I3 (flagship): overall and per-group daily reports in one aggregate.

    Output: report_group (null = overall), day, n_posts, score_mean,
    score_std, score_var, score_median, score_std_roll.
    """
    if not group:
        return rolling_mean(daily_stats(df, date_col, score_col, id_col, None, median),
                            n=rows).withColumn("report_group", F.lit(None).cast("string"))
    base = prepare(df, date_col, score_col, id_col, group)
    more = [] if median == "exact" else [_approx_median()]
    agg = (base.groupingSets([["day"], ["grp", "day"]], "grp", "day")
           .agg(*_stats(), *more, F.grouping("grp").cast("int").alias("is_overall")))
    # rows whose own group is null belong to the overall report only
    agg = agg.where((F.col("is_overall") == 1) | F.col("grp").isNotNull())
    if median == "exact":
        both = F.array(F.struct(F.lit(1).alias("o"), F.lit("").alias("g")), F.struct(F.lit(0).alias("o"), F.col("grp").alias("g")))
        keyed = base.select("day", "score", F.explode(both).alias("k")).select(
            F.col("k.o").alias("o"), F.col("k.g").alias("g"), F.col("day").alias("d"), "score").where("g is not null")
        mid = exact_quantiles(keyed, ["o", "g", "d"], [0.5]).withColumn("score_median", F.col("q")[0])
        agg = agg.join(mid, (F.col("o") == F.col("is_overall")) & (F.col("d") == F.col("day"))
                       & (F.col("g") == F.when(F.col("is_overall") == 1, F.lit("")).otherwise(F.col("grp"))))
    w = (Window.partitionBy("is_overall", "grp").orderBy("day")
         .rowsBetween(-(rows - 1), 0))
    return agg.select(
        F.when(F.col("is_overall") == 0, F.col("grp")).alias("report_group"),
        "day", "n_posts", "score_mean", "score_std", "score_var", "score_median",
        F.when(F.count("score_std").over(w) >= 2, F.avg("score_std").over(w))
         .alias("score_std_roll"),
    )


def mean_band(daily: DataFrame) -> DataFrame:
    """Mean +- one std; a null std counts as 0."""
    sd = F.coalesce(F.col("score_std"), F.lit(0.0))
    return daily.withColumn("band_lower", F.col("score_mean") - sd) \
                .withColumn("band_upper", F.col("score_mean") + sd)


def recent_days(df: DataFrame, date_col: str, score_col: str, n: int = 14,
                group: str | None = None, id_col: str = "id") -> DataFrame:
    """Rows of the last ``n`` distinct days that have data (per group).

    Days are ranked on the distinct (group, day) table, which holds one row
    per group and day; the days to keep, at most ``n`` rows per group, are
    broadcast after a check, so the rows are not shuffled. Two reads.
    """
    base, parts = _grouped(df, date_col, score_col, id_col, group)
    keep = _last_days(base.select(*parts, "day").distinct(), parts, n)
    small, _ = checked_broadcast(keep)
    return base.join(small if small is not None else keep, parts + ["day"], "inner")


def _grouped(df: DataFrame, date_col: str, score_col: str, id_col: str, group: str | None) -> tuple[DataFrame, list[str]]:
    base = prepare(df, date_col, score_col, id_col, group)
    return (base.where(F.col("grp").isNotNull()), ["grp"]) if group else (base, [])


def _last_days(days: DataFrame, parts: list[str], n: int) -> DataFrame:
    w = Window.partitionBy(*parts).orderBy(F.col("day").desc())
    return days.withColumn("day_rank", F.dense_rank().over(w)).where(f"day_rank <= {n}")


QUARTILES = [0.25, 0.5, 0.75]


def _boxes(q: DataFrame, keys: list[str]) -> DataFrame:
    return (q.select(*keys, F.col("q")[0].alias("q1"), F.col("q")[1].alias("median"), F.col("q")[2].alias("q3"))
            .withColumn("iqr", F.col("q3") - F.col("q1"))
            .withColumn("fence_lo", F.col("q1") - 1.5 * F.col("iqr"))
            .withColumn("fence_hi", F.col("q3") + 1.5 * F.col("iqr")))


def _recent_sketch(base: DataFrame, parts: list[str], n_days: int) -> DataFrame:
    """The sketch of every day, of which the recent ones stay: the days are
    ranked on it, so they cost no read of their own."""
    sketch = _sketch(base, [*parts, "day"], QUARTILES)
    return _last_days(sketch, parts, n_days).drop("day_rank")


def boxplot_summary(df: DataFrame, date_col: str, score_col: str, n_days: int = 14,
                    group: str | None = None, id_col: str = "id",
                    exact: bool = True) -> DataFrame:
    """I8: per recent day, linear quartiles, whiskers at the furthest value
    within 1.5 IQR of the box, and the outlier count. ``exact=False`` takes
    the quartiles from a fixed-size sketch (for unrounded scores at scale).

    Two reads: the sketch of each day, and one pass that counts the values
    near the quartiles and those that may lie beyond the fences; the sketch
    of the recent days is broadcast after a check."""
    base, parts = _grouped(df, date_col, score_col, id_col, group)
    keys = [*parts, "day"]
    if not exact:
        return _sketched_summary(base, parts, n_days)
    cells = cut_lineage(_cells(base, _recent_sketch(base, parts, n_days), keys, QUARTILES, fences=True))
    box = _boxes(_ranked(cells, keys, QUARTILES), keys)
    # values beyond the fences are outliers; of the others the furthest counts
    beyond = cells.where("i < 0").join(box, keys)
    low, high = F.col("i") == -1, F.col("i") == -2
    out = F.when(low, F.col("v") < F.col("fence_lo")).otherwise(F.col("v") > F.col("fence_hi"))
    out = F.coalesce(out, F.lit(False))
    return beyond.groupBy(*keys, F.col("qn").alias("n"), "q1", "median", "q3", "iqr").agg(
        F.min(F.when(low & ~out, F.col("lo"))).alias("whisker_lo"),
        F.max(F.when(high & ~out, F.col("hi"))).alias("whisker_hi"),
        F.coalesce(F.sum(F.when(out, F.col("n"))), F.lit(0)).alias("n_outliers"))


def _sketched_summary(base: DataFrame, parts: list[str], n_days: int) -> DataFrame:
    keys = [*parts, "day"]
    q = F.percentile_approx("score", F.array(*[F.lit(p) for p in QUARTILES]), 10000).cast("array<double>").alias("q")
    days = cut_lineage(base.groupBy(*keys).agg(q, F.count("score").alias("n")))
    days = _last_days(days, parts, n_days)
    box = _boxes(days, keys).join(days.select(*keys, "n"), keys)
    small, _ = checked_broadcast(box)
    inside = F.col("score").between(F.col("fence_lo"), F.col("fence_hi"))
    j = base.join(small if small is not None else box, keys, "inner")
    return j.groupBy(*keys, "n", "q1", "median", "q3", "iqr").agg(
        F.min(F.when(inside, F.col("score"))).alias("whisker_lo"),
        F.max(F.when(inside, F.col("score"))).alias("whisker_hi"),
        F.count(F.when(~inside, F.lit(1))).alias("n_outliers"),
    )


def boxplot_outliers(df: DataFrame, date_col: str, score_col: str, n_days: int = 14,
                     group: str | None = None, id_col: str = "id") -> DataFrame:
    """I8: the outlier points (outside 1.5 IQR) of the recent days. Three
    reads: sketch, quartiles, and the rows beyond the fences, which are
    broadcast after a check."""
    base, parts = _grouped(df, date_col, score_col, id_col, group)
    keys = [*parts, "day"]
    q = exact_quantiles(base, keys, QUARTILES, _recent_sketch(base, parts, n_days))
    fences = cut_lineage(_boxes(q, keys).select(*keys, "fence_lo", "fence_hi"))
    small, _ = checked_broadcast(fences)
    j = base.join(small if small is not None else fences, keys, "inner")
    return j.where(~F.col("score").between(F.col("fence_lo"), F.col("fence_hi"))) \
            .select(*parts, "day", "id", "score")


def daily_features(df: DataFrame, ticker_col: str, ts_col: str, fields: list[str],
                   prefix: str = "") -> DataFrame:
    """Mean of each score field per ``(ticker, date)`` (1-day bucket)."""
    dtype = df.schema[ts_col].dataType.simpleString()
    return (df.withColumn("date", coerce_date(ts_col, dtype))
              .where(F.col("date").isNotNull())
              .groupBy(F.col(ticker_col).alias("ticker"), "date")
              .agg(*[F.avg(f).alias(f"{prefix}{f}_mean") for f in fields],
                   F.count(F.lit(1)).alias(f"{prefix}n")))
