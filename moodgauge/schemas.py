"""Fixed schemas of the landed sources and of the tables the operators emit."""

from __future__ import annotations

from pyspark.sql import types as T

S, D, L, B, TS, DT = (T.StringType(), T.DoubleType(), T.LongType(),
                      T.BooleanType(), T.TimestampType(), T.DateType())


def struct(*fields) -> T.StructType:
    return T.StructType([T.StructField(n, t, True) for n, t in fields])


# Scored rows written by the scoring stage (C9; ours keeps ticker and term).
SCORED = struct(("id", S), ("ticker", S), ("match_term", S), ("date", S),
                ("neg", D), ("neu", D), ("pos", D), ("compound", D),
                ("permalink", S))

# Raw news rows as landed by the news fetcher (A6 output).
NEWS_RAW = struct(("ticker", S), ("date", S), ("published_at", S),
                  ("title", S), ("link", S), ("publisher", S), ("summary", S),
                  ("symbol", S), ("description", S), ("text", S),
                  ("permalink", S), ("url", S), ("article_url", S))

# One landed news item (A6 input): the vendor's nested record.
NEWS_ITEM = struct(
    ("ticker", S),
    ("content", struct(
        ("pubDate", S), ("title", S), ("summary", S), ("description", S),
        ("canonicalUrl", struct(("url", S))),
        ("clickThroughUrl", struct(("url", S))),
        ("provider", struct(("displayName", S))),
    )),
)

# Fields of one social post inside a listing page (A5).
POST_DATA = struct(
    ("id", S), ("name", S), ("created_utc", D), ("title", S), ("selftext", S),
    ("subreddit", S), ("author", S), ("permalink", S), ("url", S),
    ("over_18", B), ("score", L), ("num_comments", L),
)

LISTING_PAGE = struct(
    ("kind", S),
    ("data", struct(
        ("after", S),
        ("children", T.ArrayType(struct(("kind", S), ("data", POST_DATA)))),
    )),
)

# Daily price records.
PRICES = struct(("date", S), ("adjOpen", D), ("adjHigh", D), ("adjLow", D),
                ("adjClose", D), ("adjVolume", L))

# Volatility-index history.
VIX = struct(("Date", S), ("Open", D), ("High", D), ("Low", D), ("Close", D),
             ("Volume", L))

# Entity -> terms map as landed JSON (A3): {"Nvidia": ["cuda", ...]}.
ENTITY_MAP = T.MapType(S, T.ArrayType(S))

# Normalised social post (C2 output).
POST = struct(
    ("platform", S), ("type", S), ("id", S), ("fullname", S),
    ("subreddit", S), ("author", S), ("created_utc", D), ("date_utc", DT),
    ("title", S), ("selftext", S), ("text", S), ("score", L),
    ("num_comments", L), ("permalink", S), ("post_url", S), ("over_18", B),
)
