"""Scans of landed files (rows A1-A8).

Every reader takes an explicit schema: no inference pass over the data, and
the same column types on every run.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import schemas


def read_jsonl(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """A1: JSON-lines scan. Blank lines are skipped; a malformed line fails
    the job (FAILFAST), as in the reference."""
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def scan_jsonl(spark: SparkSession, path: str, schema: T.StructType, bad_col: str = "bad_line") -> DataFrame:
    """A1 beside the failing mode: every line comes back, a malformed one
    with null fields and its text in ``bad_col`` (null for good lines), so
    bad records are counted in the pass that reads the good ones."""
    raw = T.StructType([*schema.fields, T.StructField(bad_col, T.StringType())])
    df = (spark.read.schema(raw).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", bad_col).json(path))
    good = F.col(bad_col).isNull()
    return df.select(*[F.when(good, F.col(f"`{f.name}`")).alias(f.name) for f in schema.fields], bad_col)


# CSV that gives every text back: quotes doubled, records over several lines,
# white space kept, empty texts quoted and nulls not
CSV_OPTIONS = {"header": "true", "quote": '"', "escape": '"', "multiLine": "true", "nullValue": "", "emptyValue": '""',
               "ignoreLeadingWhiteSpace": "false", "ignoreTrailingWhiteSpace": "false"}

# stands for a quoted empty text while it is read, as an unquoted one is null
_EMPTY = "\x00empty\x00"


def read_csv(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """A4: CSV written by ``sinks.write_csv`` (or in that form). Records may
    span lines, so a file is one task; write as many files as tasks are
    wanted."""
    df = spark.read.schema(schema).options(**{**CSV_OPTIONS, "emptyValue": _EMPTY}).csv(path)
    texts = {f.name for f in schema.fields if isinstance(f.dataType, T.StringType)}
    cols = [F.col(f"`{c}`") for c in df.columns]
    return df.select(*[F.when(c == _EMPTY, F.lit("")).otherwise(c).alias(n) if n in texts else c
                       for n, c in zip(df.columns, cols)])


def newest_snapshot(spark: SparkSession, directory: str, glob: str, schema: T.StructType, fmt: str = "json") -> DataFrame:
    """A2 for snapshots that are folders of files: rows of the
    lexicographically last folder under ``directory`` that matches ``glob``
    (its name carries the date window).

    File paths alone are listed to find it; the scan is of the whole
    directory under a filter on the file's own metadata, which Spark applies
    to the file list, so files of other snapshots are not opened."""
    name = F.element_at(F.split("path", "/"), -2)
    like = "^" + glob.replace(".", "[.]").replace("*", ".*") + "$"
    listing = (spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(directory)
               .select(name.alias("name")).where(F.col("name").rlike(like)))
    last = listing.agg(F.max("name").alias("n")).first()["n"]
    if last is None:
        raise FileNotFoundError(f"no {glob} under {directory}")
    df = (spark.read.schema(schema).option("recursiveFileLookup", "true").option("mode", "FAILFAST")
          .format(fmt).load(directory))
    return df.where(F.col("_metadata.file_path").contains(f"/{last}/"))


def read_report(spark: SparkSession, path: str, schema: T.StructType, group_col: str = "report_group") -> DataFrame:
    """Report folders written by ``sinks.write_report`` as CSV; the overall
    report has a null group."""
    df = spark.read.schema(schema).option("header", True).csv(path)
    return df.withColumn(group_col, F.nullif(F.col(group_col), F.lit("__overall__")))


def read_table(spark: SparkSession, path: str, fmt: str = "parquet",
               schema: T.StructType | None = None, header: bool = True) -> DataFrame:
    """A4: CSV / Parquet / JSON scan."""
    r = spark.read
    if schema is not None:
        r = r.schema(schema)
    if fmt == "csv":
        r = r.option("header", header)
    return r.format(fmt).load(path)


def latest_snapshot(spark: SparkSession, directory: str, glob: str,
                    schema: T.StructType) -> DataFrame:
    """A2: read the lexicographically last file matching ``glob``.

    File names carry the date window, so the last name is the newest
    snapshot. Only file paths are listed (the binary-file source prunes the
    content column); the one chosen path comes back as a scalar.
    """
    listing = (spark.read.format("binaryFile")
               .option("pathGlobFilter", glob)
               .load(directory)
               .select(F.element_at(F.split("path", "/"), -1).alias("name"), "path"))
    row = listing.agg(F.max_by("path", "name").alias("p")).first()
    if row is None or row["p"] is None:
        raise FileNotFoundError(f"no {glob} under {directory}")
    return read_jsonl(spark, row["p"], schema)


def read_entity_terms(spark: SparkSession, path: str) -> DataFrame:
    """A3: entity-map JSON ``{entity: [term, ...]}`` -> ``(entity, ord, term)``.

    A missing file gives an empty table, a null list no rows; term order is
    kept in ``ord`` (0-based). A file holds one map, however it is laid out
    (pretty-printed or on one line).
    """
    out_schema = "entity string, ord int, term string"
    try:
        raw = spark.read.text(path, wholetext=True)
        raw.schema  # resolve the path now
    except Exception as e:  # missing file = empty map
        if "PATH_NOT_FOUND" in str(e) or "does not exist" in str(e):
            return spark.createDataFrame([], out_schema)
        raise
    m = raw.select(F.from_json("value", schemas.ENTITY_MAP).alias("m"))
    kv = m.select(F.explode("m").alias("entity", "terms"))
    return (kv.select("entity", F.posexplode(F.coalesce(
                "terms", F.array().cast("array<string>"))).alias("ord", "term"))
              .select("entity", F.col("ord").cast("int"), F.col("term").cast("string")))


def flatten_listing(spark: SparkSession, path: str | list[str], page_from: str = "file_name") -> DataFrame:
    """A5: landed listing pages (one JSON document per file) -> one row per
    post with its arrival-order key: ``source_rank``, ``page`` and ``pos``.

    ``path`` is one path or a list of paths in the order the sources were
    fetched; ``source_rank`` is the place in that list. ``page`` is the file
    name with its numbers padded, so that page 10 comes after page 2; with
    ``page_from="file_path"`` it is the whole path, for pages in folders."""
    paths = [path] if isinstance(path, str) else list(path)
    name = F.regexp_replace(F.col(f"_metadata.{page_from}"), "(\\d+)", "000000000000000000$1")
    name = F.regexp_replace(name, "0*(\\d{18})(?!\\d)", "$1")
    out = None
    for rank, one in enumerate(paths):
        pages = (spark.read.schema(schemas.LISTING_PAGE).option("multiLine", True).json(one)
                 .select(F.lit(rank).alias("source_rank"), name.alias("page"), "data"))
        rows = pages.select("source_rank", "page", F.posexplode("data.children").alias("pos", "child")) \
                    .select("source_rank", "page", "pos", "child.data.*")
        out = rows if out is None else out.unionByName(rows)
    return out


def flatten_news(raw: DataFrame, keep_unparsed: bool = False) -> DataFrame:
    """Vendor news record -> flat news row.

    link = canonical URL, else click-through URL; summary = summary, else
    description (first truthy value); published_at parsed as UTC. Rows whose
    pubDate is missing or unparsable are dropped (kept with a null instant
    when ``keep_unparsed``). Other input columns (order keys) are carried.
    """
    from ..functions.text import first_nonempty, norm_ticker
    from ..functions.time import parse_iso
    c = F.col("content")
    published = parse_iso(c["pubDate"])
    out = (raw.select(
        norm_ticker("ticker").alias("ticker"),
        published.alias("published_at"),
        c["title"].alias("title"),
        F.nullif(first_nonempty(c["canonicalUrl"]["url"], c["clickThroughUrl"]["url"]),
                 F.lit("")).alias("link"),
        c["provider"]["displayName"].alias("publisher"),
        F.nullif(first_nonempty(c["summary"], c["description"]), F.lit("")).alias("summary"),
        *[x for x in raw.columns if x not in ("ticker", "content")],
    ))
    out = out if keep_unparsed else out.where(F.col("published_at").isNotNull())
    return out.withColumn("date", F.to_date("published_at"))


def read_prices(spark: SparkSession, path: str, eager: bool = True) -> DataFrame:
    """Daily price lists (a JSON array of records per file, laid out in
    any way; ``path`` may be a folder or glob of many files, read in one
    plan). ``ticker`` is the name of a ``ticker=`` folder or else the file
    name without its extension, in upper case. A JSON object payload (the
    vendor's error form) or an empty list in any file is an error: at once
    with ``eager``, else when the rows are read, without a pass of its own."""
    from ..functions.text import norm_ticker, strip
    folder = F.regexp_extract(F.col("_metadata.file_path"), "/ticker=([^/]+)/", 1)
    name = F.regexp_extract(F.col("_metadata.file_name"), "^([^.]*)", 1)
    ticker = norm_ticker(F.when(folder != "", folder).otherwise(name))
    text = spark.read.text(path, wholetext=True).select(
        strip(F.col("value")).alias("v"), ticker.alias("ticker"), F.col("_metadata.file_path").alias("f"))
    empty = ~F.col("v").startswith("[") | F.col("v").rlike("^\\[\\s*\\]$")
    if eager:
        bad = text.where(empty).select("f").first()
        if bad is not None:
            raise ValueError(f"price payload is not a list of rows: {bad['f']}")
    rows = F.from_json("v", T.ArrayType(schemas.PRICES), {"mode": "FAILFAST"})
    wrong = F.raise_error(F.concat(F.lit("price payload is not a list of rows: "), "f")).cast(T.ArrayType(schemas.PRICES))
    df = text.select(F.explode(F.when(empty, wrong).otherwise(rows)).alias("r"), "ticker").select("r.*", "ticker")
    if eager and df.limit(1).count() == 0:
        raise ValueError(f"no price rows in {path}")
    return df.withColumn("date", F.to_date(F.substring("date", 1, 10)))


def read_vix(spark: SparkSession, path: str) -> DataFrame:
    """Volatility-index history; ``Date`` is ``YYYY-MM-DD``; empty is an
    error."""
    df = spark.read.schema(schemas.VIX).option("multiLine", True).json(path)
    if df.limit(1).count() == 0:
        raise ValueError(f"no index rows in {path}")
    return df.withColumn("Date", F.to_date("Date"))


def news_rows(raw: DataFrame, order: str, start: str | None = None, end: str | None = None,
              limit: int = 200, today: str | None = None) -> DataFrame:
    """A6 + D1 + F6 in the reference's order, per ticker: buffer the first
    ``max(3*limit, 300)`` raw items in ``order``, *then* drop items without
    a parsable pubDate and outside the inclusive date window, *then* keep
    ``limit``. ``order`` is the arrival-order column of the landed items."""
    import datetime as _dt

    from ..operators.dedup import topk_per_key
    end_d = _dt.date.fromisoformat(end) if end else (
        _dt.date.fromisoformat(today) if today else _dt.date.today())
    start_d = _dt.date.fromisoformat(start) if start else end_d - _dt.timedelta(days=7)
    lo, hi = min(start_d, end_d), max(start_d, end_d)
    from ..functions.text import norm_ticker
    keyed = raw.withColumn("__t", norm_ticker("ticker"))
    buffered = topk_per_key(keyed, ["__t"], [order], max(3 * limit, 300)).drop("__t")
    flat = flatten_news(buffered)
    kept = flat.where(F.col("date").between(F.lit(lo), F.lit(hi)))
    return topk_per_key(kept, ["ticker"], [order], limit)
