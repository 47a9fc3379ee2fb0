"""Registered queries over landed files: the given tables are written in the
form a source has (JSON lines, listing pages, price lists, ...) into a new
folder under the shared scratch folder and read back by the source's scan."""

from __future__ import annotations

import uuid

from pyspark.ml import PipelineModel
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators import market, model, report
from ..session import scratch_path
from ..sinks import files as sinks
from ..sources import files as sources
from ..streaming import landing
from .catalog import _bars, _docs, _events, _merged, query
from .tables import normalize, table, ticks

PAGE = 100              # documents' ids on a listing page
MAP_ENTITIES = 64       # entities in one landed map


def _folder(spark, name: str) -> str:
    return scratch_path(spark, f"{name}-{uuid.uuid4().hex}")


@query("scan_jsonl")
def q_scan_jsonl(spark, sf_dir):
    """A1: all documents as JSON lines, and for every benchmark item a line
    that breaks off; good rows and bad lines come from one pass."""
    docs = _docs(spark, sf_dir).select("doc_id", "text", "lang", "source", "n_chars")
    good = docs.select(F.to_json(F.struct(*docs.columns), {"ignoreNullFields": "false"}).alias("value"))
    cut = table(spark, sf_dir, "benchmark").select(F.concat(F.lit('{"doc_id": '), "item_id", F.lit(', "text": "')).alias("value"))
    path = _folder(spark, "jsonl")
    good.unionByName(cut).write.text(path)
    rows = sources.scan_jsonl(spark, path, docs.schema)
    return normalize(rows.select("doc_id", "lang", "source", "n_chars", F.length("text").alias("text_chars"),
                                 F.sha1("text").alias("text_sha1"), "bad_line"))


@query("scan_csv")
def q_scan_csv(spark, sf_dir):
    """A4 / B2: all documents written as CSV and read back, whole texts."""
    docs = _docs(spark, sf_dir)
    path = _folder(spark, "csv")
    sinks.write_csv(docs, path)
    return sources.read_csv(spark, path, docs.schema)


@query("latest_snapshot")
def q_latest_snapshot(spark, sf_dir):
    """A2: events landed as weekly snapshots, of which the newest is read."""
    ev = _events(spark, sf_dir).withColumn("us", F.unix_micros(F.col("ts").cast("timestamp"))).drop("ts")
    week = F.date_trunc("week", F.timestamp_micros("us")).cast("date")
    name = F.concat(F.lit("events_"), week.cast("string"), F.lit("_"), F.date_add(week, 6).cast("string"))
    path = _folder(spark, "snapshots")
    ev.withColumn("snapshot", name).write.partitionBy("snapshot").json(path)
    got = sources.newest_snapshot(spark, path, "snapshot=events_*", ev.schema)
    return normalize(got.select("event_id", "user_id", "event_type", "value", "props",
                                F.timestamp_micros("us").cast("timestamp_ntz").alias("ts")))


@query("listing_rows")
def q_listing_rows(spark, sf_dir):
    """A5: documents landed as listing pages, a nested JSON document over
    many lines per page and language, and flattened in arrival order."""
    nl = F.instr("text", "\n")
    post = F.struct(
        F.col("doc_id").cast("string").alias("id"),
        F.when(nl > 0, F.expr("substring(text, 1, instr(text, '\n') - 1)")).otherwise(F.col("text")).alias("title"),
        F.when(nl > 0, F.expr("substring(text, instr(text, '\n') + 1)")).alias("selftext"),
        F.col("source").alias("subreddit"), F.col("n_chars").alias("score"))
    rows = _docs(spark, sf_dir).select(
        F.coalesce("lang", F.lit("none")).alias("listing"), F.expr(f"doc_id div {PAGE} + 1").alias("page"), "doc_id",
        F.struct(F.lit("t3").alias("kind"), post.alias("data")).alias("child"))
    pages = rows.groupBy("listing", "page").agg(     # at most PAGE ids on a page
        F.transform(F.array_sort(F.collect_list(F.struct("doc_id", "child"))), lambda c: c["child"]).alias("children"))
    doc = F.struct(F.lit("Listing").alias("kind"), F.struct(
        F.concat(F.lit("t3_"), F.col("page").cast("string")).alias("after"), F.col("children")).alias("data"))
    path = _folder(spark, "listing")
    pages.select("listing", "page", F.to_json(doc, {"pretty": "true"}).alias("value")).write.partitionBy("listing", "page").text(path)
    flat = sources.flatten_listing(spark, path, page_from="file_path")
    return normalize(flat.select(
        F.regexp_extract("page", "/listing=([^/]*)/", 1).alias("listing"),
        F.regexp_extract("page", "/page=0*([0-9]+)/", 1).cast("long").alias("page"), "pos", "id", "title",
        F.length("selftext").alias("selftext_chars"), "subreddit", "score"))


@query("entity_map_roundtrip")
def q_entity_map_roundtrip(spark, sf_dir):
    """The first word of every turn as the terms of a conversation,
    written as JSON maps and read back in order."""
    conv = table(spark, sf_dir, "conversations")
    terms = conv.select(F.concat(F.lit("conv"), F.col("conv_id").cast("string")).alias("entity"), F.col("turn").alias("ord"),
                        F.coalesce(F.regexp_extract(F.lower("text"), "\\p{L}+", 0), F.lit("")).alias("term"))
    path = _folder(spark, "maps")
    sinks.write_entity_terms(terms, path, max_entities=MAP_ENTITIES)
    return normalize(sources.read_entity_terms(spark, path))


@query("price_rows")
def q_price_rows(spark, sf_dir):
    """Daily bars landed as one price list per ticker."""
    row = F.struct(F.date_format("date", "yyyy-MM-dd'T'00:00:00.000'Z'").alias("date"), F.col("open").alias("adjOpen"),
                   F.col("high").alias("adjHigh"), F.col("low").alias("adjLow"), F.col("close").alias("adjClose"),
                   F.col("volume").alias("adjVolume"))
    lists = _bars(spark, sf_dir).groupBy("ticker").agg(F.to_json(F.array_sort(F.collect_list(row))).alias("value"))
    path = _folder(spark, "prices")
    lists.write.partitionBy("ticker").text(path)
    return normalize(sources.read_prices(spark, path, eager=False))


@query("vix_rows")
def q_vix_rows(spark, sf_dir):
    """The daily index over all tickers, landed as one history file."""
    bars = market.ohlc_bars(ticks(spark, sf_dir).withColumn("ticker", F.lit("INDEX")), "ticker", "ts", "price", "day", tie="event_id")
    row = F.struct(F.col("date").cast("string").alias("Date"), F.col("open").alias("Open"), F.col("high").alias("High"),
                   F.col("low").alias("Low"), F.col("close").alias("Close"), F.col("volume").alias("Volume"))
    path = _folder(spark, "vix")
    bars.agg(F.to_json(F.array_sort(F.collect_list(row))).alias("value")).coalesce(1).write.text(path)
    return normalize(sources.read_vix(spark, path))


@query("report_folders")
def q_report_folders(spark, sf_dir):
    """Report folders of all event types; then a second run without
    the first type replaces the folders of its own groups and the overall
    one, and leaves that type's as it was."""
    ev = _events(spark, sf_dir)
    path = _folder(spark, "report")
    first = report.sentiment_report(ev, "ts", "value", "event_type", "event_id")
    sinks.write_report(first, path, replace="groups")
    least = ev.agg(F.min("event_type").alias("t")).first()["t"]
    second = report.sentiment_report(ev.where(F.col("event_type") > F.lit(least)), "ts", "value", "event_type", "event_id")
    sinks.write_report(second, path, replace="groups")
    # the group is in the folders' names
    fields = [f for f in first.schema.fields if f.name != "report_group"]
    schema = T.StructType([*fields, T.StructField("report_group", T.StringType())])
    return normalize(sources.read_report(spark, path, schema))


@query("strip_zone")
def q_strip_zone(spark, sf_dir):
    """Instants all over the year (so both clocks of New York occur) as
    wall time, written and read back."""
    shift = F.make_dt_interval(days=(F.col("event_id") % 365).cast("int"))
    ev = _events(spark, sf_dir).select("event_id", (F.col("ts") + shift).alias("ts"))
    path = _folder(spark, "wall")
    sinks.write_table(sinks.strip_zone(ev, ["ts"], "America/New_York"), path)
    return spark.read.parquet(path)


@query("ml_predict")
def q_ml_predict(spark, sf_dir):
    """M1 / M3: the daily table fitted by a pipeline, which is saved, loaded
    and applied to all of it."""
    merged = _merged(spark, sf_dir)
    path = _folder(spark, "model")
    model.fit(merged, ["value_mean"], "rv_1d").write().overwrite().save(f"{path}/model")
    out = model.predict(PipelineModel.load(f"{path}/model"), merged, f"{path}/predictions")
    return normalize(out.select("ticker", "date", "value_mean", "prediction"))


@query("stream_resume")
def q_stream_resume(spark, sf_dir):
    """The first half of the events' time lands and is read by a stream;
    then the second half lands, with the last day of the first half once
    more, and the stream resumes from its checkpoint. What it has appended
    by then is every event once."""
    ev = _events(spark, sf_dir).select("event_id", F.col("ts").cast("timestamp").alias("ts"), "event_type", "value")
    lo, hi = ev.agg(F.min(F.unix_micros("ts")), F.max(F.unix_micros("ts"))).first()
    run = _folder(spark, "resume")
    clock = {"timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX"}
    mid, day = (lo or 0) + ((hi or 0) - (lo or 0)) // 2, 86_400_000_000
    us = F.unix_micros("ts")
    parts = [ev.where(us < mid), ev.where((us >= mid) | us.isNull()).unionByName(ev.where((us < mid) & (us >= mid - day)))]
    with landing.rocksdb_state(spark):
        for part in parts:
            part.write.mode("append").options(**clock).json(f"{run}/landing")
            s = landing.stream_landing(spark, f"{run}/landing", ev.schema, "ts", "event_id", "2 days", options=clock)
            landing.run_available(s, f"{run}/checkpoint", f"{run}/out", strict=True)
    got = spark.read.schema(ev.schema).parquet(f"{run}/out")
    return normalize(got.select("event_id", "event_type", "value", F.col("ts").cast("timestamp_ntz").alias("ts")))
