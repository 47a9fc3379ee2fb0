"""Vector codes by product quantisation with Orchard's search.

Vectors of integers are cut into equal consecutive parts; every part position
has a codebook. A codebook starts as the parts of the first vectors and is
fitted by rounds of assignment and componentwise floor means.

The nearest entry is found by Orchard's search: every entry has the list of
all entries sorted by distance from it. A query starts at some entry and goes
along its list; an entry that is nearer (or as near, with a lower index)
becomes the current one and the search jumps to its list; visited entries are
marked and not measured again. The search stops where the list is beyond
twice the query's distance from the current entry: by the triangle inequality
whatever follows is farther than the current entry. All arithmetic is on
integers, so the result is the exact nearest entry, ties to the lower index.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from moodgauge.llm.common import checked_small, map_arrow, written
from moodgauge.session import ensure_checkpoint_dir

SCALE = 256
PARTS = 16
ENTRIES = 64
ROUNDS = 2
LARGEST = 1 << 18       # of a component: squared distances stay within 64 bits


class Orchard:
    """Nearest of the entries (k, width) to queries, by Orchard's search."""

    def __init__(self, entries: np.ndarray):
        self.entries = entries
        apart = ((entries[:, None, :] - entries[None, :, :]) ** 2).sum(2)
        self.lists = np.argsort(apart, axis=1, kind="stable")
        self.apart = np.take_along_axis(apart, self.lists, 1)
        total = entries.sum(1)
        self.by_sum = np.argsort(total, kind="stable")
        self.sums = total[self.by_sum]
        self.measured = 0       # distances computed, for tests of the pruning

    def _start(self, queries: np.ndarray) -> np.ndarray:
        """An entry with about the same sum of components."""
        at = np.searchsorted(self.sums, queries.sum(1))
        return self.by_sum[np.minimum(at, len(self.sums) - 1)]

    def nearest(self, queries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(index of the nearest entry, squared distance) of every query;
        all queries step through their lists together."""
        n, k = len(queries), len(self.entries)
        now = self._start(queries)
        best = ((queries - self.entries[now]) ** 2).sum(1)
        seen = np.zeros((n, k), bool)
        seen[np.arange(n), now] = True
        place = np.zeros(n, np.int64)
        live = np.arange(n)
        self.measured += n
        while len(live):
            at = place[live]
            # beyond twice the distance: four times the squared one
            live = live[(at < k) & (self.apart[now[live], np.minimum(at, k - 1)] <= 4 * best[live])]
            entry = self.lists[now[live], place[live]]
            place[live] += 1
            new = ~seen[live, entry]
            q, entry = live[new], entry[new]
            seen[q, entry] = True
            d = ((queries[q] - self.entries[entry]) ** 2).sum(1)
            self.measured += len(q)
            nearer = (d < best[q]) | ((d == best[q]) & (entry < now[q]))
            q = q[nearer]
            now[q], best[q], place[q] = entry[nearer], d[nearer], 0
        return now, best


class Codebooks:
    """One codebook (k, width) for each part position: (parts, k, width)."""

    def __init__(self, entries: np.ndarray):
        self.entries = entries
        self.searches = [Orchard(e) for e in entries]

    def assign(self, vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Codes (n, parts) and squared distances summed over the parts."""
        cut = vectors.reshape(len(vectors), len(self.entries), -1)
        codes = np.empty((len(vectors), len(self.entries)), np.int64)
        error = np.zeros(len(vectors), np.int64)
        for p, search in enumerate(self.searches):
            codes[:, p], d = search.nearest(np.ascontiguousarray(cut[:, p]))
            error += d
        return codes, error

    def sha256(self) -> str:
        return hashlib.sha256(",".join(map(str, self.entries.ravel().tolist())).encode()).hexdigest()


# --------------------------------------------------------------------------
# Spark plan
# --------------------------------------------------------------------------

def whole_vectors(df: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding",
                  label_col: str | None = "label") -> DataFrame:
    """(id, label, v) of the rows whose vector has only finite components;
    each becomes floor(SCALE * x). Rows whose vector is empty, or of another
    length than most (of equally common lengths the longer one counts), go."""
    c = F.col(f"`{vec_col}`")
    finite = F.forall(c, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    small = F.forall(c, lambda x: F.abs(x) < LARGEST)
    whole = F.transform(c, lambda x: F.floor(F.lit(SCALE) * x.cast("double")).cast("long"))
    label = F.col(f"`{label_col}`") if label_col else F.lit(None).cast("int")
    kept = df.where(c.isNotNull()).where(finite).where(F.size(c) > 0).select(
        F.col(f"`{id_col}`").alias("id"), label.alias("label"),
        F.when(small, whole).otherwise(F.raise_error(F.lit(f"a component of {LARGEST} or more"))).alias("v"))
    size = kept.groupBy(F.size("v").alias("n")).agg(F.count(F.lit(1)).alias("rows")).orderBy(F.desc("rows"), F.desc("n")).first()
    return kept.where(F.size("v") == F.lit(size["n"] if size else 0))


def _matrix(column, width: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, width)


def fit(vectors: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> Codebooks | None:
    """Codebooks of ``vectors`` (id, v): started from the ``entries`` smallest
    ids (equal ids by their vectors, null ids last), then ``rounds`` of
    assignment and floor means. Tasks send sums and counts of every entry,
    parts x entries rows; codebooks are of that size too. None if there are
    no vectors; fewer vectors than ``entries`` give as many entries."""
    first = vectors.select("id", "v").orderBy(F.asc_nulls_last("id"), "v").limit(entries).collect()
    if not first:
        return None
    width = len(first[0]["v"])
    if width % parts:
        raise ValueError(f"vectors of {width} components can't be cut into {parts} equal parts")
    start = np.array([r["v"] for r in first], np.int64).reshape(len(first), parts, -1)
    books = Codebooks(np.ascontiguousarray(start.transpose(1, 0, 2)))
    spark = vectors.sparkSession
    for _ in range(rounds):
        shared = spark.sparkContext.broadcast(books.entries)

        def run(batch: pa.RecordBatch, shared=shared, width=width):
            own = Codebooks(shared.value)
            rows = _matrix(batch.column("v"), width)
            codes, _ = own.assign(rows)
            k, w = own.entries.shape[1:]
            cut = rows.reshape(len(rows), parts, w)
            out = {"part": [], "entry": [], "n": [], "total": []}
            for p in range(parts):
                n = np.bincount(codes[:, p], minlength=k)
                total = np.zeros((k, w), np.int64)
                np.add.at(total, codes[:, p], cut[:, p])
                used = np.flatnonzero(n)
                out["part"] += [p] * len(used)
                out["entry"] += used.tolist()
                out["n"] += n[used].tolist()
                out["total"] += total[used].tolist()
            yield out

        sums = map_arrow(vectors.select("v"), run, "part int, entry int, n long, total array<long>")
        w = width // parts
        means = sums.groupBy("part", "entry").agg(
            F.sum("n").alias("n"), *[F.sum(F.col("total")[j]).alias(f"t{j}") for j in range(w)]).collect()
        new = books.entries.copy()
        for r in means:     # at most parts x entries rows; // goes down
            new[r["part"], r["entry"]] = [r[f"t{j}"] // r["n"] for j in range(w)]
        books = Codebooks(new)
    return books


def encode(vectors: DataFrame, books: Codebooks) -> DataFrame:
    """(id, label, code, error) of ``vectors`` (id, label, v): code has two
    hex digits for each part's index in its codebook, error is the sum of
    squared distances. Row-local."""
    shared = vectors.sparkSession.sparkContext.broadcast(books.entries)
    width = books.entries.shape[0] * books.entries.shape[2]
    if books.entries.shape[1] > 256:
        raise ValueError("two hex digits hold an index below 256")

    def run(batch: pa.RecordBatch):
        codes, error = Codebooks(shared.value).assign(_matrix(batch.column("v"), width))
        code = [row.tobytes().hex() for row in codes.astype(np.uint8)]
        yield {"id": batch.column("id"), "label": batch.column("label"), "code": code, "error": error}

    kinds = {f.name: f.dataType.simpleString() for f in vectors.schema}
    return map_arrow(vectors, run, f"id {kinds['id']}, label {kinds['label']}, code string, error long")


def compress(df: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label",
             parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> DataFrame:
    """One row per kept row: ``id_col``, code, error, label_error (error
    summed over the rows of an equal label, nulls together) and
    codebooks_sha256 (of all final entries' components by part, entry and
    position, as decimal numbers with commas).

    Kept are rows that ``whole_vectors`` keeps; ids may be null or repeated,
    every row is encoded on its own; an empty table gives no rows. Components
    must be below LARGEST in size; a larger one fails the job. Other columns
    are not read."""
    spark = df.sparkSession
    ensure_checkpoint_dir(spark)
    vectors = whole_vectors(df, id_col, vec_col, label_col)
    books = fit(vectors, parts, entries, rounds)
    if books is None:
        kind = df.schema[id_col].dataType.simpleString()
        return spark.createDataFrame([], f"`{id_col}` {kind}, code string, error long, label_error long, codebooks_sha256 string")
    rows = written(encode(vectors, books), "codes")
    totals = rows.groupBy("label").agg(F.sum("error").alias("label_error"))
    # a narrow row per label: broadcast after a count, else a shuffle join
    totals = checked_small(written(totals.withColumnRenamed("label", "of"), "label-errors"), 1_000_000)
    return rows.join(totals, F.col("label").eqNullSafe(F.col("of"))).select(
        F.col("id").alias(id_col), "code", "error", "label_error", F.lit(books.sha256()).alias("codebooks_sha256"))
