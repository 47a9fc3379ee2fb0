"""Loading the driver tables and the stand-in views built from them.

The stand-ins (see FIXTURES.md section 2) map the generic test tables onto
the shapes the operators expect; each is a projection or a join of the
given tables, so its size grows with them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import spread

TABLES = ("region nation customer supplier part orders lineitem events documents "
          "embeddings pages benchmark labels conversations").split()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def normalize(df: DataFrame, digits: int = 6) -> DataFrame:
    """Comparison form of a result: doubles rounded, integers as bigint.

    Spark and DuckDB add floating values in different orders and type
    ``row_number``/``size`` differently; registered queries and their SQL
    both end in this form.
    """
    cols = []
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, (T.DoubleType, T.FloatType, T.DecimalType)):
            c = F.round(c.cast("double"), digits)
        elif isinstance(f.dataType, (T.IntegerType, T.ShortType, T.ByteType)):
            c = c.cast("bigint")
        cols.append(c.alias(f.name))
    return df.select(*cols)


def responses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Landed model responses ``(entity, run, attempt, text)``.

    Every turn of ``conversations`` is a response: entity = ``E{conv_id % 5}``
    (five entities), run = conversation, attempt = rank of the turn in its
    conversation (1-based, by turn number).
    """
    conv = table(spark, sf_dir, "conversations")
    w = Window.partitionBy("conv_id").orderBy("turn")
    return conv.select(
        F.concat(F.lit("E"), (F.col("conv_id") % 5).cast("string")).alias("entity"),
        F.col("conv_id").alias("run"),
        F.row_number().over(w).cast("bigint").alias("attempt"),
        "text",
    )


RESPONSES_SQL = """
responses AS (
  SELECT 'E' || CAST(conv_id % 5 AS VARCHAR) AS entity, conv_id AS run,
         CAST(row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS BIGINT) AS attempt,
         text
  FROM conversations
)"""


def ticks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Price ticks: entity = event_type, price = value, instant = ts (UTC)."""
    ev = table(spark, sf_dir, "events")
    return ev.select(F.col("event_type").alias("ticker"), "ts",
                     F.col("value").alias("price"), "event_id")


def social_listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Landed social posts (input of C2): documents with their page, flag and
    time.

    id = doc_id; title = first line of the text, selftext = the rest;
    subreddit = source; author = lang; created_utc = epoch of the event with
    the same id; permalink = path of the page URL (site-relative), url = the
    page URL; over_18 = toxic label; score = n_chars.
    """
    d = spread(table(spark, sf_dir, "documents"))
    p = table(spark, sf_dir, "pages").select(F.col("page_id").alias("doc_id"), "url")
    lab = table(spark, sf_dir, "labels").select("doc_id", "toxic")
    ev = table(spark, sf_dir, "events").select(F.col("event_id").alias("doc_id"), "ts")
    j = d.join(p, "doc_id", "left").join(lab, "doc_id", "left").join(ev, "doc_id", "left")
    text = F.col("text")
    nl = F.instr(text, "\n")
    return j.select(
        F.col("doc_id").cast("string").alias("id"),
        F.concat(F.lit("t3_"), F.col("doc_id").cast("string")).alias("name"),
        (F.unix_micros(F.col("ts").cast("timestamp")) / F.lit(1e6)).alias("created_utc"),
        F.when(nl > 0, F.substring(text, 1, nl - 1)).otherwise(text).alias("title"),
        F.when(nl > 0, F.expr("substring(text, instr(text, '\n') + 1)")).alias("selftext"),
        F.col("source").alias("subreddit"),
        F.col("lang").alias("author"),
        F.regexp_extract("url", "^[a-z]+://[^/]+(/.*)?$", 1).alias("permalink"),
        F.col("url"),
        (F.col("toxic") == 1).alias("over_18"),
        F.col("n_chars").alias("score"),
        F.lit(None).cast("bigint").alias("num_comments"),
    )


SOCIAL_LISTING_SQL = """
social_listing AS (
  SELECT CAST(d.doc_id AS VARCHAR) AS id,
         't3_' || CAST(d.doc_id AS VARCHAR) AS name,
         epoch_us(e.ts) / 1e6 AS created_utc,
         CASE WHEN strpos(d.text, chr(10)) > 0 THEN substr(d.text, 1, strpos(d.text, chr(10)) - 1) ELSE d.text END AS title,
         CASE WHEN strpos(d.text, chr(10)) > 0 THEN substr(d.text, strpos(d.text, chr(10)) + 1) END AS selftext,
         d.source AS subreddit, d.lang AS author,
         regexp_extract(p.url, '^[a-z]+://[^/]+(/.*)?$', 1) AS permalink,
         p.url AS url, (l.toxic = 1) AS over_18, d.n_chars AS score,
         CAST(NULL AS BIGINT) AS num_comments
  FROM documents d
  LEFT JOIN pages p ON p.page_id = d.doc_id
  LEFT JOIN labels l ON l.doc_id = d.doc_id
  LEFT JOIN events e ON e.event_id = d.doc_id
)"""


# events per page: the news items that a page is the article of
ITEMS_PER_PAGE = 40


def news_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Landed vendor news items (input of A6) as nested records, one per
    event, whose article is the page ``event_id div 40`` (a page without an
    event is an item without a time): ticker = language code of the URL path,
    pubDate = the event instant as ISO text (``Z`` suffix; the 'error'
    events carry an unparsable text), title = the page title, summary empty
    and description = the first heading, canonical URL only for https pages,
    click-through URL = the page URL, provider = the host. Arrival order
    ``ord``: the first items of all pages, then their second ones, ...; the
    parts of a page are taken from its html once, before the join."""
    url = F.col("url")
    p = table(spark, sf_dir, "pages").select(
        "page_id", "url",
        F.regexp_extract(url, "^[a-z]+://[^/]+/([a-z]{2})/", 1).alias("ticker"),
        F.regexp_extract("html", "<title>([^<]*)</title>", 1).alias("title"),
        F.regexp_extract("html", "<h1>([^<]*)</h1>", 1).alias("description"),
        F.regexp_extract(url, "^[a-z]+://([^/?#]+)", 1).alias("host"))
    ev = table(spark, sf_dir, "events").select(
        "event_id", "ts", "event_type", F.expr(f"event_id div {ITEMS_PER_PAGE}").alias("page_id"))
    j = p.join(ev, "page_id", "left")
    nth = F.coalesce(F.col("event_id") % ITEMS_PER_PAGE, F.lit(0))
    iso = F.concat(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss"), F.lit("Z"))
    pub = F.when(F.col("event_type") == "error", F.lit("not a date")).otherwise(iso)
    return j.select(
        "page_id", "event_id", F.struct(nth.alias("nth"), "page_id").alias("ord"), "ticker",
        F.struct(
            pub.alias("pubDate"), "title", F.lit("").alias("summary"), "description",
            F.struct(F.when(url.startswith("https://"), url).alias("url")).alias("canonicalUrl"),
            F.struct(url.alias("url")).alias("clickThroughUrl"),
            F.struct(F.col("host").alias("displayName")).alias("provider"),
        ).alias("content"),
    )


NEWS_ITEMS_SQL = f"""
news_items AS (
  SELECT p.page_id, e.event_id, coalesce(e.event_id % {ITEMS_PER_PAGE}, 0) AS nth,
         regexp_extract(p.url, '^[a-z]+://[^/]+/([a-z]{{2}})/', 1) AS ticker,
         CASE WHEN e.event_type = 'error' THEN 'not a date'
              ELSE strftime(e.ts, '%Y-%m-%dT%H:%M:%S') || 'Z' END AS pub,
         regexp_extract(p.html, '<title>([^<]*)</title>', 1) AS title,
         regexp_extract(p.html, '<h1>([^<]*)</h1>', 1) AS description,
         CASE WHEN starts_with(p.url, 'https://') THEN p.url END AS canonical,
         p.url AS click,
         regexp_extract(p.url, '^[a-z]+://([^/?#]+)', 1) AS publisher
  FROM pages p LEFT JOIN events e ON e.event_id // {ITEMS_PER_PAGE} = p.page_id
)"""
