"""Baseline model stage (M1-M5): fit, predict, evaluate, time split.

The reference only declares this stage (an abstract fit/predict/save/load
class and script stubs); metric names, the split rule and the baseline
model are ours and are written down here.
"""

from __future__ import annotations

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import LinearRegression
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def fit(df: DataFrame, features: list[str], label: str) -> PipelineModel:
    """M1 / M2: ``VectorAssembler`` + ``LinearRegression`` pipeline; save
    and load with ``model.write().overwrite().save(p)`` /
    ``PipelineModel.load(p)`` (no pickle)."""
    train = df.where(F.col(label).isNotNull())
    for f in features:
        train = train.where(F.col(f).isNotNull())
    pipe = Pipeline(stages=[
        VectorAssembler(inputCols=features, outputCol="features"),
        LinearRegression(featuresCol="features", labelCol=label, predictionCol="prediction"),
    ])
    return pipe.fit(train)


def predict(model: PipelineModel, df: DataFrame, path: str | None = None) -> DataFrame:
    """M3: predictions; written as Parquet when ``path`` is given."""
    out = model.transform(df).drop("features")
    if path:
        out.write.mode("overwrite").parquet(path)
    return out


def fit_per_ticker(df: DataFrame, x: str, y: str) -> DataFrame:
    """M2 (SQL form): least-squares slope and intercept per ticker with
    ``regr_slope`` / ``regr_intercept`` (pairs with a null are skipped)."""
    return df.groupBy("ticker").agg(
        F.regr_slope(y, x).alias("slope"), F.regr_intercept(y, x).alias("intercept"),
        F.regr_count(y, x).alias("n"))


def apply_linear(df: DataFrame, coef: DataFrame, x: str, out: str = "y_hat") -> DataFrame:
    return df.join(coef.select("ticker", "slope", "intercept"), "ticker", "inner") \
             .withColumn(out, F.col("intercept") + F.col("slope") * F.col(x))


def evaluate(df: DataFrame, y: str, y_hat: str, by: list[str] | None = None) -> DataFrame:
    """M4: MAE, RMSE and R^2 (1 - SSE / SST) per group, over rows where both
    values are present."""
    d = df.where(F.col(y).isNotNull() & F.col(y_hat).isNotNull())
    e = F.col(y) - F.col(y_hat)
    g = d.groupBy(*(by or []))
    return g.agg(
        F.count(F.lit(1)).alias("n"),
        F.avg(F.abs(e)).alias("mae"),
        F.sqrt(F.avg(e * e)).alias("rmse"),
        (F.lit(1.0) - F.sum(e * e) / (F.count(F.lit(1)) * F.var_pop(y))).alias("r2"),
    )


def time_split(df: DataFrame, date_col: str = "date", fraction: float = 0.8) -> DataFrame:
    """M5: time-ordered split, never random. With ``n`` distinct dates, the
    first ``ceil(fraction * n)`` dates are ``train`` and the rest ``test``.

    The cut date comes from the distinct-date table (one row per day) as a
    scalar subquery, so the plan stays lazy and the rows are never joined
    with anything.
    """
    dates = df.select(F.col(date_col).alias("__d")).distinct()
    ranked = (dates.withColumn("__r", F.row_number().over(Window.orderBy("__d")))
                   .withColumn("__n", F.count(F.lit(1)).over(Window.partitionBy())))
    k = F.ceil(F.col("__n") * F.lit(float(fraction)) - F.lit(1e-9))
    cut = ranked.where(F.col("__r") <= k).agg(F.max("__d")).scalar()
    return df.withColumn("split", F.when(F.col(date_col) <= cut, F.lit("train"))
                         .otherwise(F.lit("test")))
