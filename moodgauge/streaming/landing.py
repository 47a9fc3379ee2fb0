"""Structured Streaming over a landing folder.

X1: new JSON-lines files in a folder become a stream; rows are
de-duplicated by id within the watermark (state is bounded by the delay).
X2: daily tumbling statistics per group on that stream; rows later than the
watermark are dropped. Only mergeable aggregates are kept (count, mean,
sample std and var, whose buffers are central moments), no median.
"""

from __future__ import annotations

import contextlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def stream_landing(spark: SparkSession, directory: str, schema: T.StructType | str,
                   ts_col: str = "ts", id_col: str = "id", delay: str = "1 day",
                   fmt: str = "json", max_files_per_trigger: int | None = None,
                   options: dict | None = None) -> DataFrame:
    """File-source stream with a watermark on ``ts_col`` and
    ``dropDuplicatesWithinWatermark(id)``."""
    r = spark.readStream.schema(schema).format(fmt).options(**(options or {}))
    if max_files_per_trigger:
        r = r.option("maxFilesPerTrigger", max_files_per_trigger)
    s = r.load(directory)
    return s.withWatermark(ts_col, delay).dropDuplicatesWithinWatermark([id_col])


def stream_daily_stats(stream: DataFrame, ts_col: str = "ts", score_col: str = "score",
                       group_col: str = "grp", id_col: str = "id",
                       delay: str | None = None) -> DataFrame:
    """Per (group, UTC day) count of ids, mean, sample std and var.

    ``delay`` sets a watermark here when the input has none; the window is
    emitted once the watermark passes its end (append mode)."""
    s = stream.withWatermark(ts_col, delay) if delay else stream
    x = F.col(score_col).cast("double")
    agg = s.groupBy(F.col(group_col).alias("grp"), F.window(ts_col, "1 day").alias("w")).agg(
        F.count(id_col).alias("n_posts"),
        F.avg(x).alias("score_mean"),
        F.stddev_samp(x).alias("score_std"),
        F.var_samp(x).alias("score_var"),
    )
    return agg.select("grp", F.to_date(F.col("w.start")).alias("day"), "n_posts",
                      "score_mean", "score_std", "score_var")


# Fixed value: Spark's state store on RocksDB, which keeps state off the heap
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


@contextlib.contextmanager
def rocksdb_state(spark: SparkSession):
    """Streams started inside keep their state in RocksDB (a checkpoint stays
    with the store it was made with)."""
    key = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(key, None)
    spark.conf.set(key, ROCKSDB)
    try:
        yield
    finally:
        spark.conf.unset(key) if before is None else spark.conf.set(key, before)


class LateRows(RuntimeError):
    """A bounded run dropped rows that were later than the watermark."""


def _finish(query, strict: bool, seen: dict | None = None) -> int:
    """Wait for the run and count the rows it dropped as late; with
    ``strict`` such rows are an error, not a silent loss. ``seen`` gets the
    rows that the state holds in the end."""
    query.awaitTermination()
    if seen is not None:
        last = [p for p in query.recentProgress if p.stateOperators][-1:]
        seen["state_rows"] = sum(op.numRowsTotal for p in last for op in p.stateOperators)
    late = sum(op.numRowsDroppedByWatermark for p in query.recentProgress for op in p.stateOperators)
    if strict and late:
        raise LateRows(f"{late} rows were later than the watermark; use a longer delay or larger batches")
    return late


def run_available(df: DataFrame, checkpoint: str, sink_path: str,
                  fmt: str = "parquet", strict: bool = False, seen: dict | None = None) -> int:
    """Run a stream over everything landed so far (``availableNow``) into a
    file sink with its own checkpoint, then stop. Restarting with the same
    checkpoint resumes exactly where it stopped. Returns the rows dropped as
    late (``strict``: raises ``LateRows`` instead)."""
    q = (df.writeStream.format(fmt).outputMode("append")
         .option("checkpointLocation", checkpoint)
         .trigger(availableNow=True).start(sink_path))
    return _finish(q, strict, seen)


def run_complete_to_table(df: DataFrame, checkpoint: str, table_path: str, strict: bool = False) -> int:
    """Run an aggregating stream over everything landed so far in complete
    mode; every micro-batch overwrites ``table_path`` with the full result
    (Parquet), so the table always holds a whole, consistent answer. Returns
    the rows dropped as late (``strict``: raises ``LateRows`` instead)."""
    def write(batch: DataFrame, _epoch: int) -> None:
        batch.write.mode("overwrite").parquet(table_path)

    q = (df.writeStream.outputMode("complete")
         .option("checkpointLocation", checkpoint)
         .foreachBatch(write).trigger(availableNow=True).start())
    return _finish(q, strict)
