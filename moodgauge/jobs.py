"""File-to-file jobs: the surveyed project's entry points, each one lazy
Spark plan from landed files to written outputs.

| reference entry point                 | job                                  |
| ------------------------------------- | ------------------------------------ |
| build keywords / peers (model calls)  | ``consensus_terms_job`` (landed responses) |
| fetch + match social posts            | ``social_posts_job`` (landed listing pages) |
| score social posts (lexicon)          | ``score_posts_job``                  |
| score news (model)                    | ``score_news_job``                   |
| daily report + the plots' numbers     | ``report_job``                       |
| labels from prices                    | ``labels_job``                       |
| merge features and labels             | ``merge_job``                        |

Fetching over HTTP and calling a language model are not part of the
engine; the jobs start from the files those steps land.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import schemas
from .functions.text import first_nonempty, merge_text, norm_ticker, row_id
from .functions.time import coerce_date, session_day
from .operators import (consensus, dedup, features, filters, market, match, posts,
                        report, scoring)
from .sinks import files as sinks
from .sources import files as src

RESPONSES = "entity string, run long, attempt long, text string"
MATCHED = schemas.struct(
    ("id", schemas.S), ("source_id", schemas.S), ("platform", schemas.S), ("ticker", schemas.S),
    ("matched_term", schemas.S), ("subreddit", schemas.S), ("author", schemas.S),
    ("created_utc", schemas.D), ("date_utc", schemas.S), ("title", schemas.S), ("selftext", schemas.S),
    ("text", schemas.S), ("score", schemas.L), ("num_comments", schemas.L), ("permalink", schemas.S),
    ("post_url", schemas.S))


def _mode(overwrite: bool) -> str:
    return "overwrite" if overwrite else "errorifexists"


def consensus_terms_job(spark: SparkSession, responses_path: str, out_path: str,
                        k: int = 5, kind: str = "keywords", overwrite: bool = False) -> DataFrame:
    """Landed model responses (JSONL: entity, run, attempt, text) -> the
    entity map JSON of consensus keywords (``kind='keywords'``, floor 3) or
    peer symbols (``kind='peers'``, floor 2)."""
    resp = spark.read.schema(RESPONSES).option("mode", "FAILFAST").json(responses_path)
    if kind == "keywords":
        words, floor, norm = consensus.extract_keywords(resp, k=k), 3, "lower"
    else:
        words, floor, norm = consensus.extract_symbols(resp, k=k), 2, "upper"
    acc = consensus.accept_attempt(words, k=k, floor=floor)
    top = consensus.consensus_topk(acc, k=k, normalize=norm)
    terms = top.select("entity", (F.col("rank") - 1).cast("int").alias("ord"), "term")
    sinks.write_entity_terms(terms, out_path, _mode(overwrite))
    return terms


def social_posts_job(spark: SparkSession, pages_path: str | list[str], terms_path: str, out_path: str,
                     k: int = 15, cap: int | None = 200, include_flagged: bool = False,
                     overwrite: bool = False) -> int:
    """Landed listing pages (one folder per source, in fetch order) + entity
    map -> matched posts (JSONL): flatten, normalise, drop flagged posts, keep
    the first copy of each id in arrival order (source, page, position), drop
    blank ones, match entities by substring, keep the first ``cap`` matches
    per entity. Returns the rows written.

    First copies are found on the narrow (id, order) columns; matching is
    row-local, and the matches are joined to the first copies."""
    keys = ["source_rank", "page", "pos"]
    p = posts.normalize_posts(src.flatten_listing(spark, pages_path), keep=keys)
    p = filters.flag_filter(p, "over_18", include_flagged).withColumn("ord", F.struct(*keys)).drop(*keys)
    first = p.where(F.col("id").isNotNull()).groupBy("id").agg(F.min("ord").alias("ord"))
    m = match.match_entities(filters.drop_blank(p, "id", "text"), src.read_entity_terms(spark, terms_path),
                             "text", k=k)
    m = m.join(first, ["id", "ord"], "left_semi")
    if cap is not None:
        m = dedup.topk_per_key(m, ["entity"], ["ord"], cap)
    out = m.select(
        F.concat(F.lit("reddit:"), "id", F.lit(":"), "entity").alias("id"),
        F.col("id").alias("source_id"), "platform", F.col("entity").alias("ticker"), "matched_term",
        "subreddit", "author", "created_utc", F.col("date_utc").cast("string").alias("date_utc"),
        "title", "selftext", "text", "score", "num_comments", "permalink", "post_url")
    return sinks.write_jsonl(out, out_path, _mode(overwrite))


def score_posts_job(spark: SparkSession, in_path: str, out_path: str, lexicon,
                    negations: list[str] | None = None, boosters: dict | None = None,
                    session: bool = False, overwrite: bool = False) -> int:
    """Matched posts -> scored rows (id, ticker, match_term, date, neg, neu,
    pos, compound, permalink) with the lexicon scorer; a post matched by
    several entities is scored once. With ``session`` the date is the trading
    session that the post falls into."""
    rows = src.read_jsonl(spark, in_path, MATCHED)
    once = rows.select(F.col("text").alias("key"), "text").distinct()
    sc = scoring.lexicon_score(once, lexicon, "key", "text", negations, boosters)
    date = F.col("date_utc")
    if session:
        date = F.coalesce(session_day(F.timestamp_seconds("created_utc")).cast("string"), date)
    out = rows.join(sc, rows["text"] == sc["key"], "inner").select(
        "id", "ticker", F.col("matched_term").alias("match_term"),
        date.alias("date"), "neg", "neu", "pos", "compound", "permalink")
    return sinks.write_jsonl(posts.scored_view(out), out_path, _mode(overwrite))


def score_news_job(spark: SparkSession, raw_dir: str, out_path: str,
                   scorer_factory: Callable | None = None, weights: DataFrame | None = None,
                   glob: str = "yahoo_news_*.jsonl", overwrite: bool = False) -> int:
    """Newest raw news snapshot -> scored rows: ticker (or symbol)
    normalised, stable id from the first link present (or title|summary),
    text = title + summary (or description) + text merged. An article listed
    under several tickers is scored once.

    The model is a plug-in (``scorer_factory``) or the weight table of a
    linear bag of words (``weights``: word, pos, neg, neu); one of them must
    be given."""
    if (scorer_factory is None) == (weights is None):
        raise ValueError("give either a scorer or a weight table")
    raw = src.latest_snapshot(spark, raw_dir, glob, schemas.NEWS_RAW)
    ticker = norm_ticker(first_nonempty("ticker", "symbol"))
    link = first_nonempty("link", "permalink", "url", "article_url")
    rows = raw.select("date", "title", ticker.alias("ticker"), link.alias("permalink"),
                      first_nonempty("summary", "description").alias("summary"), F.col("text").alias("body"))
    rows = rows.select(
        row_id("yahoo", "permalink", "title", "summary", F.col("ticker")).alias("id"),
        "ticker", "date", "permalink", merge_text("title", "summary", "body").alias("text"))
    once = rows.select(F.col("text").alias("key"), "text").distinct()
    sc = (scoring.bag_score(once, weights, "text", "key") if scorer_factory is None
          else scoring.model_score(once, "text", "key", scorer_factory))
    scored = rows.join(sc, rows["text"] == sc["key"], "inner")
    return sinks.write_jsonl(posts.scored_view(scored), out_path, _mode(overwrite))


def report_job(spark: SparkSession, scored_path: str, out_dir: str, date_col: str = "date",
               score_col: str = "compound", group_col: str | None = None,
               id_col: str = "id", rows: int = 5, recent_days: int = 14,
               overwrite: bool = False) -> DataFrame:
    """Scored rows -> report folders (overall + one per group, CSV) and the
    box-plot numbers of the recent days (Parquet), in single jobs."""
    scored = src.read_jsonl(spark, scored_path, schemas.SCORED)
    rep = report.sentiment_report(scored, date_col, score_col, group_col, id_col, rows)
    sinks.write_report(rep, f"{out_dir}/daily_sentiment_stats", mode=_mode(overwrite))
    box = report.boxplot_summary(scored, date_col, score_col, recent_days, group_col, id_col)
    sinks.write_table(box, f"{out_dir}/boxplot_summary", mode=_mode(overwrite))
    return rep


def labels_job(spark: SparkSession, prices_path: str, ticker: str | None, out_path: str,
               window: int = 20, year: int = 252, horizon: int = 1, vix_path: str | None = None,
               overwrite: bool = False) -> DataFrame:
    """Daily price lists -> log returns, realized volatility and the
    ``rv_1d`` label per (ticker, date), written as Parquet. ``prices_path``
    may hold one file per ticker; the ticker is then the file's name, unless
    one is given. ``vix_path`` adds the index close of the day."""
    px = src.read_prices(spark, prices_path)
    own = F.lit(ticker) if ticker is not None else F.col("ticker")
    px = px.select(own.alias("ticker"), "date", F.col("adjClose").alias("close"))
    lab = market.vol_label(market.realized_vol(market.log_returns(px), window, year),
                           horizon)
    if vix_path is not None:
        ix = src.read_vix(spark, vix_path).select(F.col("Date").alias("date"), F.col("Close").alias("close"))
        lab = features.market_index_join(lab, ix)
    sinks.write_table(lab, out_path, mode=_mode(overwrite))
    return lab


def merge_job(spark: SparkSession, social_path: str, news_path: str, labels_path: str,
              out_path: str, how: str = "inner", names: list[str] | None = None,
              symbols: list[str] | None = None, roll: bool = True,
              overwrite: bool = False) -> DataFrame:
    """Scored social rows + scored news rows + labels -> merged daily table
    on (ticker, date).

    ``names`` and ``symbols`` (parallel lists) turn entity names of the
    social rows into symbols; a ticker that is no name stays. With ``roll``,
    dates without a label move to the next one that has (weekends, holidays).
    The join contract is checked where it can break: on the names and on the
    labels."""
    fields = ["compound", "pos", "neu", "neg"]
    lab = spark.read.parquet(labels_path).select("ticker", "date", "rv_1d")
    features.assert_join_contract(lab)
    soc = src.read_jsonl(spark, social_path, schemas.SCORED)
    if names is not None:
        dim = features.symbol_map(spark, names, symbols or [])
        features.assert_join_contract(dim, ["entity"])
        soc = features.attach_symbol(soc, dim, "ticker").withColumn(
            "ticker", norm_ticker(F.coalesce("symbol", "ticker"))).drop("symbol")
    news = src.read_jsonl(spark, news_path, schemas.SCORED)
    daily = []
    for rows, prefix in ((soc, "social_"), (news, "news_")):
        rows = rows.withColumn("date", coerce_date("date"))
        if roll:
            rows = features.roll_to_calendar(rows, lab)
        daily.append(report.daily_features(rows, "ticker", "date", fields, prefix=prefix))
    merged = features.merge_features(*daily, lab, how=how)
    sinks.write_table(merged, out_path, mode=_mode(overwrite))
    return merged
