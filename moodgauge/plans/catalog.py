"""Registered queries: one per operator row of the survey.

Each query is ``(spark, sf_dir) -> DataFrame`` over the whole given tables
and ends in ``normalize`` (doubles rounded to 6 places, integers as bigint)
so it can be compared with its SQL twin in ``oracle.py``.
"""

from __future__ import annotations

import functools
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as tx
from ..functions import time as tm
from ..operators import (consensus, dedup, features, filters, market, match, model, posts,
                         report, scoring, sentiment)
from ..session import checked_broadcast, cut_lineage, scratch_path, spread
from ..sources import files as sources
from ..streaming import landing
from .config import (ENTITY_TERMS, KEYWORD_COUNT, PEER_COUNT, POSTS_PER_ENTITY,
                     QUERY_BOOSTERS, QUERY_CONTRASTS, QUERY_LEXICON, QUERY_NEGATIONS)
from .tables import news_items, normalize, responses, social_listing, table, ticks

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def query(name: str):
    """Register ``fn`` under ``name``. Dates and instants in the queries are
    defined in UTC, so the session zone is pinned first (as
    ``build_session`` does)."""
    def deco(fn):
        @functools.wraps(fn)
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            spark.conf.set("spark.sql.session.timeZone", "UTC")
            return fn(spark, sf_dir)
        QUERIES[name] = run
        return fn
    return deco


# --------------------------------------------------------------------------
# I: daily statistics and report (flagship first)
# --------------------------------------------------------------------------

@query("sentiment_report")
def q_sentiment_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    ev = table(spark, sf_dir, "events")
    rep = report.sentiment_report(ev, date_col="ts", score_col="value",
                                  group="event_type", id_col="event_id", rows=5)
    return normalize(rep)


def _events(spark, sf_dir):
    return table(spark, sf_dir, "events")


@query("daily_stats")
def q_daily_stats(spark, sf_dir):
    return normalize(report.daily_stats(_events(spark, sf_dir), "ts", "value", "event_id"))


@query("daily_stats_by_group")
def q_daily_stats_by_group(spark, sf_dir):
    return normalize(report.daily_stats(_events(spark, sf_dir), "ts", "value", "event_id",
                                        group="event_type"))


@query("rolling_std")
def q_rolling_std(spark, sf_dir):
    d = report.daily_stats(_events(spark, sf_dir), "ts", "value", "event_id", group="event_type")
    r = report.rolling_mean(d, "score_std", group="grp", n=5, min_obs=2, unit="rows")
    return normalize(r.select("grp", "day", "score_std", "score_std_roll"))


@query("rolling_std_range")
def q_rolling_std_range(spark, sf_dir):
    # per user: days with data have gaps, so 5 rows and 5 calendar days differ
    d = report.daily_stats(_events(spark, sf_dir), "ts", "value", "event_id", group="user_id")
    r = report.rolling_mean(d, "score_std", group="grp", n=5, min_obs=2, unit="days")
    return normalize(r.select("grp", "day", "score_std", "score_std_roll"))


@query("mean_band")
def q_mean_band(spark, sf_dir):
    d = report.daily_stats(_events(spark, sf_dir), "ts", "value", "event_id", group="event_type")
    return normalize(report.mean_band(d).select("grp", "day", "score_mean",
                                                "band_lower", "band_upper"))


@query("recent_days")
def q_recent_days(spark, sf_dir):
    return normalize(report.recent_days(_events(spark, sf_dir), "ts", "value", 14,
                                        "event_type", "event_id"))


@query("boxplot_summary")
def q_boxplot_summary(spark, sf_dir):
    return normalize(report.boxplot_summary(_events(spark, sf_dir), "ts", "value", 14,
                                            "event_type", "event_id"))


@query("boxplot_outliers")
def q_boxplot_outliers(spark, sf_dir):
    return normalize(report.boxplot_outliers(_events(spark, sf_dir), "ts", "value", 14,
                                             "event_type", "event_id"))


@query("daily_features")
def q_daily_features(spark, sf_dir):
    return normalize(report.daily_features(_events(spark, sf_dir), "event_type", "ts", ["value"]))


# --------------------------------------------------------------------------
# C / D / H5: text functions, normalisation, filters
# --------------------------------------------------------------------------


def _docs(spark, sf_dir):
    return table(spark, sf_dir, "documents")


def _page_fields(spark, sf_dir):
    p = table(spark, sf_dir, "pages")
    return p.select(
        "page_id", "url",
        # padded with white space of several kinds, as vendor fields are
        F.concat(F.lit("\t"), F.regexp_extract("html", "<title>([^<]*)</title>", 1), F.lit("\n")).alias("title"),
        F.concat(F.lit("\n"), F.regexp_extract("html", "<h1>([^<]*)</h1>", 1)).alias("h1"),
        # every paragraph of the page, up to its next tag
        F.concat(F.array_join(F.regexp_extract_all("html", F.lit("<p>([^<]*)"), 1), "\n"), F.lit("\u2003")).alias("p1"),
        F.regexp_extract("url", "^[a-z]+://[^/]+/([a-z]{2})/", 1).alias("lang"),
        # a clean https URL counts as the permalink; others fall back
        F.regexp_extract("url", "^(https://[^?#]*)$", 1).alias("link"),
    )


@query("clean_text")
def q_clean_text(spark, sf_dir):
    return _docs(spark, sf_dir).select("doc_id", tx.clean_text("text").alias("text_clean"))


@query("normalize_posts")
def q_normalize_posts(spark, sf_dir):
    p = posts.normalize_posts(social_listing(spark, sf_dir))
    return normalize(p.select("id", "subreddit", "author", "created_utc", "date_utc",
                              "title", "selftext", "text", "score", "num_comments",
                              "permalink", "post_url", "over_18"))


@query("epoch_to_date")
def q_epoch_to_date(spark, sf_dir):
    ev = _events(spark, sf_dir)
    secs = tm.to_epoch_seconds("ts")
    return normalize(ev.select("event_id", secs.alias("created_utc"),
                               tm.epoch_to_date(secs).alias("date_utc")))


def _iso_strings(ev):
    """One ISO-8601 shape for each remainder of the event id, and junk."""
    day, clock = F.date_format("ts", "yyyy-MM-dd"), F.date_format("ts", "HH:mm:ss")
    full = F.concat(day, F.lit("T"), clock)
    shapes = [full, F.concat(full, F.lit("Z")), F.concat(full, F.lit("+00:00")), F.concat(full, F.lit("+02:00")),
              F.concat(full, F.lit("-0530")), F.concat(day, F.lit(" "), clock), day,
              F.date_format("ts", "yyyy-MM-dd'T'HH:mm"), F.date_format("ts", "yyyyMMdd'T'HHmmss'Z'"),
              F.concat(full, F.lit(".123456789")), F.concat(full, F.lit(",5+01")),
              F.concat(F.lit("\t "), full, F.lit(" \n")), F.concat(F.lit("junk-"), full), F.concat(full, F.lit("z"))]
    s = F.lit("")
    for i, shape in enumerate(shapes):
        s = F.when(F.col("event_id") % (len(shapes) + 1) == i, shape).otherwise(s)
    return ev.select("event_id", s.alias("pub"))


@query("parse_iso")
def q_parse_iso(spark, sf_dir):
    s = _iso_strings(_events(spark, sf_dir))
    p = s.select("event_id", tm.parse_iso("pub").alias("published_at")) \
         .where(F.col("published_at").isNotNull())
    return p.select("event_id", F.col("published_at").cast("timestamp_ntz").alias("published_at"),
                    F.to_date("published_at").alias("date"))


@query("first_nonempty")
def q_first_nonempty(spark, sf_dir):
    p = _page_fields(spark, sf_dir)
    return p.select("page_id", tx.first_nonempty("link", "title", "h1", "url").alias("value"))


@query("merge_text")
def q_merge_text(spark, sf_dir):
    p = _page_fields(spark, sf_dir)
    return p.select("page_id", tx.merge_text("title", "h1", "p1").alias("merged"))


@query("row_id")
def q_row_id(spark, sf_dir):
    p = _page_fields(spark, sf_dir)
    t = tx.norm_ticker("lang")
    return p.select("page_id", tx.row_id("yahoo", "link", "title", "p1", t).alias("id"))


@query("news_rows")
def q_news_rows(spark, sf_dir):
    """A6 + D1 + F6: flatten landed news items, buffering the first
    max(3 x 20, 300) items per ticker before the date filter, then keep 20."""
    out = sources.news_rows(news_items(spark, sf_dir), "ord", start="2024-01-25",
                            end="2024-01-05", limit=20)
    return out.select("page_id", "event_id", "ticker", "date",
                      F.col("published_at").cast("timestamp_ntz").alias("published_at"),
                      "title", "link", "publisher", "summary")


@query("date_window")
def q_date_window(spark, sf_dir):
    ev = _events(spark, sf_dir)
    # bounds given swapped on purpose: the operator puts them in order
    w = filters.date_window(ev, "ts", start="2024-01-20", end="2024-01-10")
    return normalize(w.select("event_id", "event_type", "value",
                              F.to_date("ts").alias("date")))


@query("flag_filter")
def q_flag_filter(spark, sf_dir):
    d = _docs(spark, sf_dir).select("doc_id", "lang", "source")
    lab = table(spark, sf_dir, "labels").select("doc_id", (F.col("toxic") == 1).alias("over_18"))
    return filters.flag_filter(d.join(lab, "doc_id", "left"), "over_18") \
        .select("doc_id", "lang", "source")


@query("source_filter")
def q_source_filter(spark, sf_dir):
    d = _docs(spark, sf_dir)
    return filters.source_filter(d, "en", ["src1", "src2", "src3"]).select("doc_id", "source")


@query("truncate_tokens")
def q_truncate_tokens(spark, sf_dir):
    d = _docs(spark, sf_dir).select("doc_id", tx.clean_text("text").alias("c"))
    return d.select("doc_id", tx.token_count("c", cleaned=True).alias("n_tokens"),
                    tx.truncate_tokens("c", 256, cleaned=True).alias("text_256"))


# --------------------------------------------------------------------------
# E / F: dedup, unions, caps, entity matching
# --------------------------------------------------------------------------


def entity_terms(spark) -> DataFrame:
    """The entity -> keywords configuration as a long table."""
    rows = [(e, i, t) for e, ts in ENTITY_TERMS.items() for i, t in enumerate(ts)]
    return spark.createDataFrame(rows, "entity string, ord int, term string")


@query("dedupe_first")
def q_dedupe_first(spark, sf_dir):
    d = _docs(spark, sf_dir)
    return dedup.dedupe_first(d, "text", ["doc_id"]).select("doc_id", "lang", "source")


@query("union_pools")
def q_union_pools(spark, sf_dir):
    d = _docs(spark, sf_dir).select(F.lit("documents").alias("pool"),
                                    F.col("doc_id").alias("id"), "source",
                                    F.length("text").cast("bigint").alias("n_chars"))
    p = table(spark, sf_dir, "pages").select(F.lit("pages").alias("pool"),
                                             F.col("page_id").alias("id"),
                                             F.length("html").cast("bigint").alias("n_chars"))
    return dedup.union_pools(d, p)


def _matches(spark, sf_dir, method="theta"):
    # matching costs far more than a shuffle of a small file
    d = spread(_docs(spark, sf_dir).select("doc_id", "text"))
    return match.match_entities(d, entity_terms(spark), "text", k=KEYWORD_COUNT,
                                method=method)


@query("entity_match")
def q_entity_match(spark, sf_dir):
    return _matches(spark, sf_dir).select("doc_id", "entity", "matched_term")


@query("entity_match_automaton")
def q_entity_match_automaton(spark, sf_dir):
    # the query's earlier name; q-grams answer it now
    return _matches(spark, sf_dir, "grams").select("doc_id", "entity", "matched_term")


@query("entity_match_many_terms")
def q_entity_match_many_terms(spark, sf_dir):
    """Thousands of terms: the words of 8 letters and more of every
    conversation, searched in all documents."""
    words = table(spark, sf_dir, "conversations").select(
        F.concat(F.lit("conv"), F.col("conv_id").cast("string")).alias("entity"),
        F.explode(F.regexp_extract_all(F.lower("text"), F.lit("\\p{L}+"), 0)).alias("term"))
    words = words.where(F.length("term") >= 8).distinct()
    rank = F.row_number().over(Window.partitionBy("entity").orderBy("term"))
    terms = words.select("entity", (rank - 1).alias("ord"), "term")
    # the table of terms is written once; a small file of texts is dealt out
    terms = cut_lineage(terms)
    d = spread(_docs(spark, sf_dir).select("doc_id", "text"))
    return match.match_entities(d, terms, "text", method="grams", keep=["doc_id"])


@query("entity_match_regex")
def q_entity_match_regex(spark, sf_dir):
    return _matches(spark, sf_dir, "regex").select("doc_id", "entity", "matched_term")


@query("entity_match_token")
def q_entity_match_token(spark, sf_dir):
    return _matches(spark, sf_dir, "token").select("doc_id", "entity", "matched_term")


@query("topk_per_entity")
def q_topk_per_entity(spark, sf_dir):
    m = _matches(spark, sf_dir)
    top = dedup.topk_per_key(m, ["entity"], ["doc_id"], POSTS_PER_ENTITY, rank_col="rank")
    return normalize(top.select("doc_id", "entity", "matched_term", "rank"))


@query("buffered_limit")
def q_buffered_limit(spark, sf_dir):
    ev = _events(spark, sf_dir)
    keep = (F.col("ts") >= F.lit("2024-01-03").cast("timestamp_ntz")) & \
           (F.col("ts") < F.lit("2024-01-10").cast("timestamp_ntz"))
    out = dedup.buffered_limit(ev, ["event_type"], ["ts", "event_id"], keep, limit=200)
    return out.select("event_id", "event_type", F.to_date("ts").alias("date"))


@query("cap_per_day")
def q_cap_per_day(spark, sf_dir):
    ev = _events(spark, sf_dir).withColumn("date", F.to_date("ts"))
    out = dedup.topk_per_key(ev, ["event_type", "date"],
                             [F.col("ts").desc(), F.col("event_id").desc()], 50,
                             rank_col="rank")
    return normalize(out.select("event_id", "event_type", "date", "rank"))


# --------------------------------------------------------------------------
# G: candidate consensus over landed responses; E3 universe
# --------------------------------------------------------------------------


def _keywords(spark, sf_dir):
    return consensus.extract_keywords(responses(spark, sf_dir), k=KEYWORD_COUNT)


def _consensus_keywords(spark, sf_dir):
    acc = consensus.accept_attempt(_keywords(spark, sf_dir), k=KEYWORD_COUNT, floor=3)
    return consensus.consensus_topk(acc, k=KEYWORD_COUNT)


@query("extract_keywords")
def q_extract_keywords(spark, sf_dir):
    k = _keywords(spark, sf_dir)
    return k.select("entity", "run", "attempt", F.array_join("words", " ").alias("keywords"),
                    F.size("words").cast("bigint").alias("n_keywords"))


@query("extract_symbols")
def q_extract_symbols(spark, sf_dir):
    s = consensus.extract_symbols(responses(spark, sf_dir), k=PEER_COUNT)
    return s.select("entity", "run", "attempt", F.array_join("words", " ").alias("symbols"),
                    F.size("words").cast("bigint").alias("n_symbols"))


@query("accept_attempt")
def q_accept_attempt(spark, sf_dir):
    a = consensus.accept_attempt(_keywords(spark, sf_dir), k=KEYWORD_COUNT, floor=3)
    return a.select("entity", "run", "attempt", F.array_join("words", " ").alias("keywords"))


@query("consensus_topk")
def q_consensus_topk(spark, sf_dir):
    return _consensus_keywords(spark, sf_dir)


@query("expand_universe")
def q_expand_universe(spark, sf_dir):
    # base: the entities in name order; their peers: the consensus terms
    peers = _consensus_keywords(spark, sf_dir).select(
        "entity", F.col("rank").alias("ord"), "term")
    base = peers.select(F.col("entity").alias("ticker")).distinct() \
        .withColumn("ord", F.dense_rank().over(Window.orderBy("ticker")))
    return dedup.expand_universe(base, peers)


# --------------------------------------------------------------------------
# H: scoring
# --------------------------------------------------------------------------


def _lexicon_scores(df):
    return scoring.lexicon_score(df, QUERY_LEXICON, "doc_id", "text",
                                 negations=QUERY_NEGATIONS, boosters=QUERY_BOOSTERS)


@query("lexicon_score")
def q_lexicon_score(spark, sf_dir):
    return normalize(_lexicon_scores(_docs(spark, sf_dir)))


@query("softmax_scores")
def q_softmax_scores(spark, sf_dir):
    # logit order of the model's labels: positive, negative, neutral; each is
    # the sum of every third component
    sums = [F.expr(f"aggregate(filter(embedding, (x, i) -> i % 3 = {k}), 0D, (s, x) -> s + coalesce(double(x), 0D))")
            for k in range(3)]
    e = table(spark, sf_dir, "embeddings").select("vec_id", *[c.alias(f"l{k}") for k, c in enumerate(sums)])
    return normalize(scoring.softmax_scores(e, "l0", "l1", "l2", keep=["vec_id"]))


@query("score_cache")
def q_score_cache(spark, sf_dir):
    docs = _docs(spark, sf_dir)
    # the cache: the stored scores of the labelled documents
    labelled = docs.join(table(spark, sf_dir, "labels").select("doc_id"), "doc_id", "left_semi")
    path = scratch_path(spark, f"scores-{uuid.uuid4().hex}")
    _lexicon_scores(labelled).write.parquet(path)
    return normalize(scoring.score_cache(docs, spark.read.parquet(path), "doc_id", _lexicon_scores))


def _bag_model(spark, sf_dir):
    """All documents, and a linear bag-of-words model fitted on the labelled
    ones (toxic: negative; else good: positive; else neutral)."""
    docs = spread(_docs(spark, sf_dir).select("doc_id", "text"))
    kind = (F.when(F.col("toxic") == 1, F.lit("negative")).when(F.col("quality") == 1, F.lit("positive"))
             .otherwise(F.lit("neutral")))
    labelled = docs.join(table(spark, sf_dir, "labels").select("doc_id", kind.alias("kind")), "doc_id")
    # fitted once: every word of the labelled texts
    return docs, cut_lineage(scoring.fit_bag_weights(labelled, "kind"))


@query("model_score")
def q_model_score(spark, sf_dir):
    docs, weights = _bag_model(spark, sf_dir)
    return normalize(scoring.bag_score(docs, weights, "text", "doc_id"))


@query("model_plugin")
def q_model_plugin(spark, sf_dir):
    """The same model as a plug-in, its weights broadcast to the workers
    (a table past the plug-in's bound is joined instead)."""
    docs, weights = _bag_model(spark, sf_dir)
    scorer = scoring.bag_scorer(weights)
    if scorer is None:
        return normalize(scoring.bag_score(docs, weights, "text", "doc_id"))
    return normalize(scoring.model_score(docs, "text", "doc_id", scorer))


@query("sentiment_rules")
def q_sentiment_rules(spark, sf_dir):
    """The whole rule set, with a lexicon from the labelled documents (good
    quality and not toxic against the others) and idioms from the openings
    of the benchmark items."""
    docs = _docs(spark, sf_dir).select("doc_id", "text")
    good = ((F.col("quality") == 1) & (F.col("toxic") == 0)).cast("int")
    known = docs.join(table(spark, sf_dir, "labels").select("doc_id", good.alias("good")), "doc_id")
    lexicon = cut_lineage(sentiment.label_lexicon(known, "good"))
    items = table(spark, sf_dir, "benchmark").select(
        "item_id", F.regexp_extract_all(F.lower("text"), F.lit("[\\p{L}\\p{N}]+"), 0).alias("w"))
    side = F.when(F.col("item_id") % 2 == 0, 1.0).otherwise(-1.0)
    n = F.explode(F.array(F.lit(2), F.lit(3))).alias("n")
    idioms = items.select("w", side.alias("side"), n).where(F.size("w") >= F.col("n")).select(
        F.array_join(F.slice("w", F.lit(1), F.col("n")), " ").alias("phrase"), (F.col("side") * (F.col("n") - 0.5)).alias("valence"))
    out = sentiment.sentiment_rules(spread(docs), lexicon, idioms, "doc_id", "text", QUERY_NEGATIONS, QUERY_BOOSTERS, QUERY_CONTRASTS,
                                    count_col="n_texts")
    return normalize(out)


# --------------------------------------------------------------------------
# J / K / M: bars, returns, volatility labels, merge, model stage
# --------------------------------------------------------------------------


def _bars(spark, sf_dir):
    return market.ohlc_bars(ticks(spark, sf_dir), "ticker", "ts", "price", "day", tie="event_id")


def _labels(spark, sf_dir):
    r = market.realized_vol(market.log_returns(_bars(spark, sf_dir)), n=20, year=252)
    return market.vol_label(r, horizon=1)


def _merged(spark, sf_dir):
    social = report.daily_features(_events(spark, sf_dir), "event_type", "ts", ["value"])
    lab = _labels(spark, sf_dir).select("ticker", "date", "log_ret", "rv", "rv_1d")
    return features.merge_features(social, lab)


@query("ohlc_bars")
def q_ohlc_bars(spark, sf_dir):
    return normalize(_bars(spark, sf_dir))


@query("log_returns")
def q_log_returns(spark, sf_dir):
    r = market.log_returns(_bars(spark, sf_dir))
    return normalize(r.select("ticker", "date", "close", "log_ret"))


@query("realized_vol")
def q_realized_vol(spark, sf_dir):
    r = market.realized_vol(market.log_returns(_bars(spark, sf_dir)), n=20, year=252)
    return normalize(r.select("ticker", "date", "log_ret", "rv"))


@query("vol_label")
def q_vol_label(spark, sf_dir):
    return normalize(_labels(spark, sf_dir).select("ticker", "date", "rv", "rv_1d"))


@query("session_date")
def q_session_date(spark, sf_dir):
    s = market.session_dates(ticks(spark, sf_dir), _bars(spark, sf_dir), ts="ts",
                             entity="ticker", zone="America/New_York", close_hour=16)
    return s.select("event_id", "ticker", "session_day", "trade_date")


@query("daily_spine")
def q_daily_spine(spark, sf_dir):
    ev = _events(spark, sf_dir)
    daily = ev.groupBy(F.col("user_id").cast("string").alias("ticker"),
                       F.to_date("ts").alias("date")).agg(F.count(F.lit(1)).alias("n"))
    return market.daily_spine(daily, "ticker", "date", fill_zero=["n"])


@query("merge_features")
def q_merge_features(spark, sf_dir):
    return normalize(_merged(spark, sf_dir))


@query("merge_all")
def q_merge_all(spark, sf_dir):
    """K1 in full: social rows, news rows and labels on (ticker, date). News
    carry language codes, which a dimension turns into tickers; dates of both
    roll to the next session, weekdays with a bar."""
    bars = cut_lineage(_bars(spark, sf_dir).where(F.weekday("date") < 5))
    lab = market.vol_label(market.realized_vol(market.log_returns(bars), n=20, year=252), horizon=1)
    ev = _events(spark, sf_dir)
    social = ev.select(F.col("event_type").alias("ticker"), F.to_date("ts").alias("date"), "value")
    items = sources.flatten_news(news_items(spark, sf_dir)).select("ticker", "date", "event_id")
    dim = features.symbol_map(spark, ["EN", "FR", "DE", "ES"], ["click", "view", "purchase", "signup"])
    news = features.attach_symbol(items.join(ev.select("event_id", "value"), "event_id"), dim, "ticker")
    news = news.where(F.col("symbol").isNotNull()).select(F.col("symbol").alias("ticker"), "date", "value")
    daily = [report.daily_features(features.roll_to_calendar(rows, bars), "ticker", "date", ["value"], prefix)
             for rows, prefix in ((social, "social_"), (news, "news_"))]
    features.assert_join_contract(lab)
    return normalize(features.merge_features(*daily, lab.select("ticker", "date", "log_ret", "rv", "rv_1d")))


@query("join_contract")
def q_join_contract(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem")
    return features.check_join_contract(li, ["l_orderkey", "l_linenumber"])


@query("symbol_map")
def q_symbol_map(spark, sf_dir):
    nation = table(spark, sf_dir, "nation")
    dim = nation.select(F.col("n_name").alias("entity"),
                        F.upper(F.substring("n_name", 1, 4)).alias("symbol"))
    cust = table(spark, sf_dir, "customer").join(
        nation.select(F.col("n_nationkey").alias("c_nationkey"), F.col("n_name").alias("entity")),
        "c_nationkey", "left")
    return features.attach_symbol(cust, dim, "entity").select("c_custkey", "entity", "symbol")


@query("market_index_join")
def q_market_index_join(spark, sf_dir):
    t = ticks(spark, sf_dir)
    bars = market.ohlc_bars(t, "ticker", "ts", "price", "day")
    index = market.ohlc_bars(t.withColumn("ticker", F.lit("INDEX")), "ticker", "ts", "price", "day")
    j = features.market_index_join(bars, index.select("date", "close"))
    return normalize(j.select("ticker", "date", "close", "index_close"))


@query("time_split")
def q_time_split(spark, sf_dir):
    m = _merged(spark, sf_dir)
    return model.time_split(m, "date", 0.8).select("ticker", "date", "split")


@query("fit_per_ticker")
def q_fit_per_ticker(spark, sf_dir):
    return normalize(model.fit_per_ticker(_merged(spark, sf_dir), "value_mean", "rv_1d"))


@query("evaluate")
def q_evaluate(spark, sf_dir):
    # the daily table is written once; the cut date, the fit and the test
    # rows all read that
    s = model.time_split(cut_lineage(_merged(spark, sf_dir)), "date", 0.8)
    coef = model.fit_per_ticker(s.where(F.col("split") == "train"), "value_mean", "rv_1d")
    pred = model.apply_linear(s.where(F.col("split") == "test"), coef, "value_mean")
    return normalize(model.evaluate(pred, "rv_1d", "y_hat", ["ticker"]))


# --------------------------------------------------------------------------
# X: Structured Streaming over a landing folder
# --------------------------------------------------------------------------


@query("stream_daily_stats")
def q_stream_daily_stats(spark, sf_dir):
    """A file-source stream over the given event files de-duplicates ids
    within the watermark and keeps daily tumbling stats per type. The delay
    covers the month that the files span, so no order of the files makes a
    row late; if one still were, the run fails."""
    run = scratch_path(spark, f"stream-{uuid.uuid4().hex}")
    given = table(spark, sf_dir, "events").schema
    raw = spark.readStream.schema(given).parquet(f"{sf_dir.rstrip('/')}/events.parquet*")
    s = raw.select(F.col("event_id").alias("id"), F.col("ts").cast("timestamp").alias("ts"),
                   F.col("event_type").alias("grp"), F.col("value").alias("score"))
    s = s.withWatermark("ts", "40 days").dropDuplicatesWithinWatermark(["id"])
    stats = landing.stream_daily_stats(s, "ts", "score", "grp", "id")
    landing.run_complete_to_table(stats, f"{run}/checkpoint", f"{run}/out", strict=True)
    return normalize(spark.read.parquet(f"{run}/out"))


# --------------------------------------------------------------------------
# End to end: landed posts -> daily sentiment report by matched term
# --------------------------------------------------------------------------

def social_scored_rows(spark, sf_dir, limit: bool = True) -> DataFrame:
    """Posts normalised, unflagged, keep-first by id, non-blank; matched to
    entities (substring rule) and capped per entity in arrival order; each
    matched post scored once and joined back to its matches.
    Output: row_id, matched_term, date_utc, neg, neu, pos, compound.

    Plan: first copies are found on (id, order) alone, matching is row-local,
    and both are joined and capped as narrow rows; the capped matches (at
    most cap x entities rows; all with ``limit=False``) are written once. The
    texts of the capped posts are fetched by a second scan of the source
    behind a size-checked semi-join, so no text is ever shuffled."""
    def open_posts(listing):
        return filters.flag_filter(posts.normalize_posts(listing, keep=["ord"]), "over_18")

    # arrival order: ids as numbers, without assuming that they are
    src = social_listing(spark, sf_dir).withColumn("ord", F.struct(F.length("id").alias("n"), F.col("id").alias("i")))
    p = open_posts(src)
    first = p.where(F.col("id").isNotNull()).groupBy("id").agg(F.min("ord").alias("ord"))
    m = match.match_entities(filters.drop_blank(p, "id", "text").select("id", "ord", "text", "date_utc"),
                             entity_terms(spark), "text", k=KEYWORD_COUNT)
    # ids and terms only from here on
    m = m.select("id", "ord", "entity", "matched_term", "date_utc").join(first, ["id", "ord"], "left_semi")
    cap = cut_lineage(dedup.topk_per_key(m, ["entity"], ["ord"], POSTS_PER_ENTITY) if limit else m)
    keys = cap.select("id", "ord").distinct()
    keys_b, _ = checked_broadcast(keys)
    todo = open_posts(src.join(keys_b if keys_b is not None else keys, ["id", "ord"], "left_semi"))
    sc = scoring.lexicon_score(todo.select(F.struct("id", "ord").alias("key"), "text"), QUERY_LEXICON, "key", "text",
                               negations=QUERY_NEGATIONS, boosters=QUERY_BOOSTERS)
    sc = sc.select(F.col("key.id").alias("id"), F.col("key.ord").alias("ord"), "neg", "neu", "pos", "compound")
    scored = cap.join(sc, ["id", "ord"], "inner").select(
        F.concat(F.lit("reddit:"), "id", F.lit(":"), "entity").alias("row_id"),
        "matched_term", "date_utc", "neg", "neu", "pos", "compound")
    # the scored rows are the hand-off to the report (as in the reference's
    # scored-rows table): written once, so later filters never reach back
    # into the scoring expressions
    return cut_lineage(scored)


@query("social_report")
def q_social_report(spark, sf_dir):
    rows = social_scored_rows(spark, sf_dir)
    return normalize(report.sentiment_report(rows, "date_utc", "compound",
                                             group="matched_term", id_col="row_id", rows=5))


from . import landed  # noqa: E402,F401  (registers the queries over landed files)
