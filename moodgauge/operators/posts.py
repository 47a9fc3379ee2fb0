"""Social post normalisation and the scored-row projection."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import SOCIAL_SITE, blank_to_null, clean_text, site_permalink
from ..functions.time import epoch_to_date


def normalize_posts(listing: DataFrame, site: str = SOCIAL_SITE,
                    platform: str = "reddit", keep: list[str] | None = None) -> DataFrame:
    """One projection over landed posts: defaults (``""``, 0, false),
    casts, cleaned title/selftext, ``text = clean(title + "\\n" + selftext)``,
    site prefix for ``/``-relative permalinks, UTC date of ``created_utc``
    (0 or missing -> null). ``keep`` columns (e.g. order keys) are carried."""
    title = clean_text("title")
    selftext = clean_text("selftext")
    created = F.coalesce(F.col("created_utc").cast("double"), F.lit(0.0))
    return listing.select(
        F.lit(platform).alias("platform"),
        F.lit("submission").alias("type"),
        F.col("id").cast("string").alias("id"),
        F.col("name").alias("fullname"),
        F.coalesce("subreddit", F.lit("")).alias("subreddit"),
        F.coalesce("author", F.lit("")).alias("author"),
        created.alias("created_utc"),
        epoch_to_date(created).alias("date_utc"),
        title.alias("title"),
        selftext.alias("selftext"),
        # = clean(title + "\n" + selftext): both parts are already cleaned, so
        # joining the non-empty ones with one space gives the same text
        # without a third regex pass
        F.concat_ws(" ", blank_to_null(title), blank_to_null(selftext)).alias("text"),
        F.coalesce(F.col("score").cast("bigint"), F.lit(0).cast("bigint")).alias("score"),
        F.coalesce(F.col("num_comments").cast("bigint"), F.lit(0).cast("bigint")).alias("num_comments"),
        site_permalink("permalink", site).alias("permalink"),
        F.coalesce("url", F.lit("")).alias("post_url"),
        F.coalesce(F.col("over_18").cast("boolean"), F.lit(False)).alias("over_18"),
        *(keep or []),
    )


def scored_view(df: DataFrame) -> DataFrame:
    """The fixed columns of a scored row (ours keeps ticker and term)."""
    keep = ["id", "ticker", "match_term", "date", "neg", "neu", "pos", "compound", "permalink"]
    return df.select(*[c for c in keep if c in df.columns])
