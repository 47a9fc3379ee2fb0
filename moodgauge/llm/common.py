"""Shared helpers of the operators in this folder."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from moodgauge.session import ensure_checkpoint_dir, ship_package, small_batches


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder for written tables under the cluster's shared checkpoint
    folder, which all executors see."""
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: later steps never
    recompute it, and losing an executor loses none of it."""
    path = scratch(df.sparkSession, name)
    df.write.option("parquet.block.size", GROUP_BYTES).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


# bytes of a row group of a table written between steps: a task holds one
GROUP_BYTES = 32 << 20


def unused(df: DataFrame, name: str) -> str:
    """``name``, or a longer one, that no column of ``df`` has."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def map_arrow(df: DataFrame, fn: Callable[[pa.RecordBatch], Iterator[dict]], schema: str,
              done: Callable[[], None] | None = None) -> DataFrame:
    """Apply ``fn`` to every Arrow batch; it yields dicts of columns. ``done``
    is called in the worker at the end of a task."""
    ship_package(df.sparkSession)
    small_batches(df.sparkSession)

    from pyspark.sql.types import _parse_datatype_string
    from pyspark.sql.pandas.types import to_arrow_schema
    out = to_arrow_schema(_parse_datatype_string(schema))

    def run(batches):
        try:
            for batch in batches:
                for cols in fn(batch):
                    yield pa.record_batch([pa.array(cols[f.name], f.type) if not isinstance(cols[f.name], pa.Array)
                                           else cols[f.name].cast(f.type) for f in out], schema=out)
        finally:
            if done is not None:
                done()
            pa.default_memory_pool().release_unused()

    return df.mapInArrow(run, schema)


def checked_small(df: DataFrame, max_rows: int) -> DataFrame:
    """``df`` with a broadcast hint if a count shows at most ``max_rows``
    rows (of a few fixed-width columns); else as it is, for a shuffle join."""
    return F.broadcast(df) if df.limit(max_rows + 1).count() <= max_rows else df
