"""Session settings and small plan helpers shared by all operators.

Everything here is plain PySpark: a builder with the settings the operators
assume (UTC session zone, ANSI on, AQE on), a lineage cut that writes to the
cluster's shared checkpoint folder, and a size-checked broadcast.
"""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Ceilings for a side we broadcast: rows, and bytes of its values. Past either
# the operators join through a shuffle.
MAX_BROADCAST_ROWS = 100_000
MAX_BROADCAST_BYTES = 32 << 20
# files of less are gone through before a shuffle of them has paid
SPREAD_BYTES = 4 << 20


def build_session(master: str | None = None, app: str = "moodgauge",
                  shuffle_partitions: int | None = None,
                  extra: dict | None = None) -> SparkSession:
    """Session with the settings the operators are written against."""
    b = SparkSession.builder.appName(app)
    if master:
        b = b.master(master)
    conf = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.ansi.enabled": "true",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        # methods past the size that the JVM compiles run as plain iterators,
        # which it does compile
        "spark.sql.codegen.hugeMethodLimit": "8000",
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
        # checkpoint files of materialised intermediates are removed once the
        # checkpointed DataFrame is garbage-collected
        "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
    }
    if shuffle_partitions:
        conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    conf.update(extra or {})
    for k, v in conf.items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the shared checkpoint folder.

    ``spark.checkpoint.dir`` names it on a cluster (HDFS, S3, ...) and is used
    as is; else the folder the application set on the context. Only a
    ``local`` master, where driver and executors are one process, gets a
    folder of its own, under the warehouse; any other master without the
    setting is an error, since its executors would not see such a folder.
    """
    try:
        sc = spark.sparkContext
    except Exception:  # Spark Connect: checkpoint() reads the conf only
        sc = None
    path = spark.conf.get("spark.checkpoint.dir", None)
    current = sc.getCheckpointDir() if sc is not None else None
    if not path and current:
        return current          # set on the context by the application
    if not path:
        master = sc.master if sc is not None else ""
        if not (master == "local" or master.startswith("local[")):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        warehouse = spark.conf.get("spark.sql.warehouse.dir").rstrip("/")
        path = f"{warehouse}/_checkpoints-{uuid.uuid4().hex}"
        spark.conf.set("spark.checkpoint.dir", path)
    if sc is not None and not current:
        sc.setCheckpointDir(path)
    return path


def cut_lineage(df: DataFrame) -> DataFrame:
    """Reliable checkpoint into the shared checkpoint folder (survives the
    loss of an executor, unlike a local checkpoint)."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def scratch_path(spark: SparkSession, name: str) -> str:
    """A sub-folder of the shared checkpoint folder for written tables."""
    base = ensure_checkpoint_dir(spark)
    return os.path.join(base, name)


def checked_broadcast(df: DataFrame, max_rows: int = MAX_BROADCAST_ROWS,
                      max_bytes: int = MAX_BROADCAST_BYTES):
    """Broadcast ``df`` only after proving that it has at most ``max_rows``
    rows and ``max_bytes`` bytes of values (strings and nested values by
    their length as text, others 8 bytes each).

    Returns ``(broadcast_df, n_rows)`` or ``(None, n_rows)`` when it is too
    large; callers then take their non-broadcast plan.
    """
    size = F.lit(0).cast("long")
    for f in df.schema.fields:
        kind = f.dataType.simpleString()
        c = F.col(f"`{f.name}`")
        if kind in ("string", "binary"):
            size = size + F.coalesce(F.octet_length(c), F.lit(0))
        elif kind.startswith(("array", "map", "struct")):
            size = size + F.coalesce(F.octet_length(F.to_json(F.struct(c))), F.lit(0))
        else:
            size = size + F.lit(8)
    n, total = df.agg(F.count(F.lit(1)), F.sum(size)).first()
    if n <= max_rows and (total or 0) <= max_bytes:
        return F.broadcast(df), n
    return None, n


# longs of a key filter at most (8 MB)
FILTER_LONGS = 1 << 20


def key_filter(keys: DataFrame, col: str, max_longs: int = FILTER_LONGS) -> Callable[[Column], Column]:
    """A test that is true for every value of ``keys[col]`` and false for
    nearly all other values: it takes most rows out before a shuffle join that
    would not match them. The keys' hashes set bits, 16 for each key or more,
    of one array of at most ``max_longs`` longs; a table of more keys than
    that serves lets more rows pass, and loses none. ``keys`` is read twice."""
    n = keys.count()
    longs = 1 << 6
    while longs < max_longs and longs * 4 < n:
        longs *= 2

    def place(c: Column) -> tuple[Column, Column]:
        h = F.xxhash64(c)
        bit = F.call_function("shiftleft", F.lit(1).cast("long"), h.bitwiseAND(F.lit(63)).cast("int"))
        return F.pmod(F.shiftright(h, 6), F.lit(longs)).cast("int"), bit

    at, bit = place(F.col(f"`{col}`"))
    some = keys.select(at.alias("at"), bit.alias("bit")).groupBy("at").agg(F.bit_or("bit").alias("bits"))
    full = keys.sparkSession.range(longs).select(F.col("id").cast("int").alias("at")).join(some, "at", "left").agg(
        F.array_sort(F.collect_list(F.struct("at", F.coalesce("bits", F.lit(0).cast("long")).alias("bits")))).alias("l"))
    bits = cut_lineage(full.select(F.col("l.bits").alias("bits")))

    def test(c: Column) -> Column:
        at, bit = place(c)
        return F.get(bits.scalar(), at).bitwiseAND(bit) != 0

    return test


def spread(df: DataFrame, least_bytes: int = SPREAD_BYTES) -> DataFrame:
    """``df``, read from files, dealt over the cores if its input comes in
    fewer parts than there are cores (one file of one row group, say): for
    work that spends far more on a row than a shuffle of it costs. Inputs of
    many parts, which is what large ones are, and files of less than
    ``least_bytes`` in all stay as they are."""
    try:
        cores, parts = df.sparkSession.sparkContext.defaultParallelism, df.rdd.getNumPartitions()
    except Exception:  # Spark Connect has neither
        return df
    if parts >= cores:
        return df
    try:
        files = df.select("_metadata.file_path", "_metadata.file_size").distinct()
        size = files.agg(F.sum("file_size")).first()[0] or 0
    except AnalysisException:  # not straight from files
        return df.repartition(cores)
    return df if size < least_bytes else df.repartition(cores)


# limits of an Arrow batch: texts are long, and a worker keeps the memory
# of its largest batch
BATCH_ROWS, BATCH_BYTES = 2_000, 4 << 20


def small_batches(spark: SparkSession) -> None:
    """Lower the session's limits of Arrow batches to those above."""
    for key, most in (("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS),
                      ("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)):
        now = spark.conf.get(key, None)
        try:
            low = now is not None and 0 < int(now) <= most
        except ValueError:      # a size with a unit
            low = False
        if not low:
            spark.conf.set(key, str(most))


_SHIPPED: set = set()


def ship_package(spark: SparkSession) -> None:
    """Make this package importable on executors (for the Python-side
    operators) by adding a zip of it with ``addPyFile``, once per
    application. The zip is built on the driver; Spark serves it to the
    executors."""
    import shutil
    try:
        sc = spark.sparkContext
    except Exception:  # Spark Connect session
        sc = None
    app = sc.applicationId if sc is not None else spark.conf.get("spark.app.id", "connect")
    if app in _SHIPPED:
        return
    submitted = spark.conf.get("spark.submit.pyFiles", "") or ""
    if "moodgauge" in submitted:  # already shipped with --py-files
        _SHIPPED.add(app)
        return
    pkg_dir = os.path.dirname(os.path.abspath(__file__))
    out = tempfile.mkdtemp(prefix="moodgauge-pyfiles-")
    archive = shutil.make_archive(os.path.join(out, "moodgauge"), "zip",
                                  root_dir=os.path.dirname(pkg_dir), base_dir="moodgauge")
    if sc is not None:
        sc.addPyFile(archive)
    else:
        spark.addArtifacts(archive, pyfile=True)
    _SHIPPED.add(app)
