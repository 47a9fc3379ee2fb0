"""Random shards by a two-pass external shuffle.

Pass 1 scatters the records uniformly into buckets by a seeded hash of their
id; the number of buckets follows from the total size, so a bucket fits in
memory at any scale. Pass 2 sorts each bucket into a fixed order, shuffles it
with a seeded Fisher-Yates shuffle and writes it. The buckets one after the
other are one random order of all records, which is cut into shards of equal
row counts (law ``rows``). Everything depends on the records and the seed
only, so a task that runs again writes the same rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, LongType, StructField, StructType

from moodgauge.llm.common import checked_small, scratch, written
from moodgauge.session import ensure_checkpoint_dir, ship_package

SHARDS = 40
SEED = 20240229
BUCKET_BYTES = 24 << 20
OVERHEAD = 16


def record_size(text):
    """UTF-8 bytes of the text (null: none) plus 16."""
    return (F.coalesce(F.octet_length(text), F.lit(0)) + F.lit(OVERHEAD)).cast("long")


def fisher_yates(n: int, seed: list[int]) -> np.ndarray:
    """A uniform order of n places: each place, from the last down, changes
    with a place at or before it."""
    rng = np.random.Generator(np.random.PCG64(np.random.SeedSequence(seed)))
    order = np.arange(n).tolist()
    for i, j in zip(range(n - 1, 0, -1), rng.integers(0, np.arange(n, 1, -1)).tolist()):
        order[i], order[j] = order[j], order[i]
    return np.array(order, np.int64)


def _bucket(n: int):
    return F.pmod(F.col("place"), F.lit(n)).cast("long")


def _tallied(rows: DataFrame, n: int) -> DataFrame:
    return rows.groupBy(_bucket(n).alias("bucket")).agg(F.count(F.lit(1)).alias("rows"), F.sum("size").alias("bytes"))


def _offsets(rows: DataFrame, n: int) -> tuple[DataFrame, int]:
    """(bucket, offset): the rows in the buckets before; and all rows."""
    # one row per bucket
    before = Window.orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    out = written(_tallied(rows, n).select(
        "bucket", "rows", F.coalesce(F.sum("rows").over(before), F.lit(0)).alias("offset")), "buckets")
    return out.select("bucket", "offset"), out.agg(F.sum("rows")).first()[0] or 0


def placed(docs: DataFrame, seed: int, id_col: str, text_col: str, bucket_bytes: int) -> tuple[DataFrame, int]:
    """Rows (place, tie, size, record) and the number of buckets that the
    places are dealt to.

    A row's place is decided by its id alone, so that counting the buckets
    reads narrow columns. Where a bucket comes out several times too large,
    ids with a quarter of a bucket or more are looked for: their rows are
    placed by the hash of the whole row, and if equal rows are as many, one
    by one. The places are then written, so that all readers see the same."""
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    text = F.col(f"`{text_col}`").cast("string")
    whole = F.xxhash64(*[F.col(f"`{f.name}`") for f in docs.schema if "map<" not in f.dataType.simpleString()])
    key = F.coalesce(F.col(f"`{id_col}`").cast("string"), F.lit("null"))
    place = F.xxhash64(F.lit(seed), key)
    if docs.where(F.col(f"`{id_col}`").isNull()).limit(1).count():
        place = F.when(F.col(f"`{id_col}`").isNull(), F.xxhash64(F.lit(seed), whole)).otherwise(place)
    total = docs.agg(F.sum(record_size(text))).first()[0] or 0
    n = max(1, -(-total // bucket_bytes))
    rows = docs.select(place.alias("place"), whole.alias("tie"), record_size(text).alias("size"), row.alias("record"))
    heavy = written(_tallied(rows, n).where(F.col("bytes") > 4 * bucket_bytes).select("bucket"), "heavy")
    if n == 1 or not heavy.limit(1).count():
        return rows, n
    keyed = docs.select(place.alias("place"), key.alias("key"), whole.alias("tie"), record_size(text).alias("size"))
    large = keyed.withColumn("bucket", _bucket(n)).join(checked_small(heavy, 1_000_000), "bucket", "left_semi")
    equal = written(large.groupBy("key", "tie").agg(F.sum("size").alias("bytes"), F.count(F.lit(1)).alias("n")), "equal-rows")
    # a single large row can't be spread
    many = (F.col("bytes") >= bucket_bytes // 4) & (F.col("n") > 1)
    ids = equal.groupBy("key").agg(F.sum("bytes").alias("bytes"), F.sum("n").alias("n")).where(many)
    ids = checked_small(written(ids.select("key", F.lit(True).alias("hot_id")), "hot-ids"), 1_000_000)
    ties = checked_small(written(equal.where(many).select("key", "tie", F.lit(True).alias("hot_row")), "hot-rows"), 1_000_000)
    rows = docs.select(place.alias("place"), key.alias("key"), whole.alias("tie"), record_size(text).alias("size"), row.alias("record"))
    rows = rows.join(ids, "key", "left").join(ties, ["key", "tie"], "left")
    by_row = F.xxhash64(F.lit(seed), "key", "tie")
    one_by_one = F.xxhash64(F.lit(seed), "key", "tie", F.monotonically_increasing_id())
    new = F.when(F.col("hot_row"), one_by_one).when(F.col("hot_id"), by_row).otherwise(F.col("place"))
    return written(rows.select(new.alias("place"), "tie", "size", "record"), "placed"), n


def shuffle_into_shards(docs: DataFrame, shards: int = SHARDS, seed: int = SEED, id_col: str = "doc_id",
                        text_col: str = "text", bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """All rows of ``docs`` as a struct column ``record``, with ``shard``,
    ``slot`` (gapless from 0 within the shard) and ``size``.

    Counts of shards differ by one row at most. Rows that repeat an id fall
    into one bucket, unless they would fill it: see ``placed``. Ties of id
    are ordered by a hash of the whole row (maps aside), so only rows equal
    in every column are interchangeable. Null ids are spread by that hash,
    null texts have size 16, an empty table gives no rows, and names of other
    columns may be any. ``size`` and the buckets count the text; wide other
    columns need a smaller ``bucket_bytes``."""
    spark = docs.sparkSession
    ensure_checkpoint_dir(spark)
    ship_package(spark)
    rows, n = placed(docs, seed, id_col, text_col, bucket_bytes)
    offsets, n_rows = _offsets(rows, n)
    scattered = rows.withColumn("bucket", _bucket(n)).join(
        F.broadcast(offsets) if n <= 100_000 else offsets, "bucket")
    each, more = divmod(n_rows, shards)

    def permuted(table: pa.Table) -> pa.Table:
        table = table.take(pc.sort_indices(table, sort_keys=[("place", "ascending"), ("tie", "ascending")]))
        b = table["bucket"][0].as_py()
        order = fisher_yates(table.num_rows, [seed, b])
        table = table.take(pa.array(order))
        # the first `more` shards have one row more than the others
        g = table["offset"][0].as_py() + np.arange(table.num_rows, dtype=np.int64)
        wide = more * (each + 1)
        shard = np.where(g < wide, g // (each + 1), more + (g - wide) // max(each, 1))
        first = np.where(g < wide, shard * (each + 1), wide + (shard - more) * each)
        return pa.table({"record": table["record"], "size": table["size"],
                         "shard": pa.array(shard.astype(np.int32)), "slot": pa.array(g - first)})

    schema = StructType([StructField("record", docs.schema), StructField("size", LongType()),
                         StructField("shard", IntegerType()), StructField("slot", LongType())])
    return scattered.groupBy("bucket").applyInArrow(permuted, schema)


def write_shards(docs: DataFrame, path: str | None = None, **options) -> DataFrame:
    """Write the shards as Parquet, one folder per shard, under ``path`` (a
    new folder in the shared checkpoint folder if none is given) and return
    what was written."""
    path = path or scratch(docs.sparkSession, "shards")
    rows = shuffle_into_shards(docs, **options)
    rows.write.partitionBy("shard").parquet(path)
    return docs.sparkSession.read.schema(rows.schema).parquet(path)
