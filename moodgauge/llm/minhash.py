"""MinHash near-duplicates through an inverted join of signature coordinates."""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from moodgauge.llm.common import checked_small, map_arrow, unused, written
from moodgauge.llm.components import components
from moodgauge.llm.words import blocks, mix, spans_hash, window_hash
from moodgauge.session import ensure_checkpoint_dir

SHINGLE = 5
COORDINATES = 64
# Pairs at similarity 0.75 share 48 of 64 coordinates on average; the chance
# of fewer than 30 is 4e-7.
MATCHES = 30
PERCENT = 75

_rng = np.random.Generator(np.random.PCG64(20240229))
_XOR = _rng.integers(0, 1 << 64, COORDINATES, np.uint64)
_MUL = _rng.integers(0, 1 << 64, COORDINATES, np.uint64) | np.uint64(1)


def shingle_sets(b, size: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of each text of a block, and how many
    each text has. A text of 1 to size-1 words is one shingle."""
    wh = b.word_hash(lower=True)
    first, text = b.windows(size)
    values, texts = [window_hash(wh, first, size)], [text]
    for k in range(1, size):
        short = np.flatnonzero(b.n_words == k)
        values.append(window_hash(wh, b.word_at[short], k))
        texts.append(short)
    v, t = np.concatenate(values), np.concatenate(texts)
    order = np.lexsort((v, t))
    v, t = v[order], t[order]
    new = np.ones(len(v), bool)
    new[1:] = (v[1:] != v[:-1]) | (t[1:] != t[:-1])
    return v[new], np.bincount(t[new], minlength=b.n_texts)


def signatures(values: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """(sets, COORDINATES) minima; sets without members have no row."""
    full = counts[counts > 0]
    at = np.cumsum(full) - full
    out = np.empty((len(full), COORDINATES), np.uint64)
    y = np.empty(len(values), np.uint64)
    for k in range(COORDINATES if len(full) else 0):
        np.bitwise_xor(values, _XOR[k], out=y)
        np.multiply(y, _MUL[k], out=y)
        out[:, k] = np.minimum.reduceat(y, at)
    return out


# --------------------------------------------------------------------------
# Spark plan
# --------------------------------------------------------------------------

def sketch(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: id, n_shingles, a 128-bit key of the shingle
    set (k1, k2; null without shingles) and the signature."""
    src = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))

    def run(batch: pa.RecordBatch):
        ids = batch.column("id")
        for b, values, counts, k1, k2 in _set_blocks(batch.column("text")):
            full = counts > 0
            at = np.concatenate([[0], np.cumsum(full * COORDINATES)])
            sig = pa.ListArray.from_arrays(pa.array(at, pa.int32(), mask=np.append(~full, False)),
                                           pa.array(signatures(values, counts).ravel().view(np.int64)))
            yield {"id": ids.slice(b.first, b.n_texts), "n_shingles": counts,
                   "k1": pa.array(k1, mask=~full), "k2": pa.array(k2, mask=~full), "sig": sig}

    return map_arrow(src, run, "id long, n_shingles long, k1 long, k2 long, sig array<long>")


def _set_blocks(texts):
    for b in blocks(texts):
        values, counts = shingle_sets(b)
        hi = np.cumsum(counts)
        lo = hi - counts
        k1 = spans_hash(values, lo, hi).view(np.int64)
        k2 = spans_hash(mix(values ^ np.uint64(0xD6E8FEB86659FD93)), lo, hi).view(np.int64)
        yield b, values, counts, k1, k2


def class_sets(docs: DataFrame, wanted: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Full shingle sets (cid, n, sig, members) of the classes in ``wanted``
    (cid, low, k1, k2, sig), from a second scan of the texts."""
    keys = checked_small(wanted.select(F.col("low").alias("id")).distinct(), 2_000_000)
    src = docs.select(F.col(id_col).cast("long").alias("id"),
                      F.col(text_col).cast("string").alias("text")).join(keys, "id", "left_semi")

    def run(batch: pa.RecordBatch):
        ids = batch.column("id")
        for b, values, counts, k1, k2 in _set_blocks(batch.column("text")):
            at = np.concatenate([[0], np.cumsum(counts)])
            yield {"low": ids.slice(b.first, b.n_texts), "k1": k1, "k2": k2,
                   "members": pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(values.view(np.int64)))}

    sets = map_arrow(src, run, "low long, k1 long, k2 long, members array<long>")
    # an id may be repeated with another text or in a row equal to this one
    return (sets.join(wanted, ["low", "k1", "k2"]).groupBy("cid")
            .agg(F.first("sig").alias("sig"), F.first("members").alias("members"))
            .withColumn("n", F.size("members").cast("long")))


def postings(classes: DataFrame) -> DataFrame:
    """Prefix postings (key, cid) of classes (cid, sig).

    Every class is posted under its 64 coordinate-value pairs. Two classes
    with at least MATCHES common pairs share at least one outside the
    MATCHES - 1 most frequent ones of each, frequency being a global order:
    those are skipped, which takes the hottest lists out of the join. Pairs
    that occur in one class only are dropped before anything is joined."""
    flat = classes.select("cid", F.posexplode("sig").alias("k", "v")).select(
        "cid", F.xxhash64("k", "v").alias("key"))
    lists = flat.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    shared = flat.join(lists, "key").groupBy("cid").agg(
        F.sort_array(F.collect_list(F.struct("n", "key"))).alias("l")).where(F.size("l") >= MATCHES)
    return shared.select("cid", F.explode(F.slice("l", F.lit(1), F.size("l") - F.lit(MATCHES - 1))).alias("p")).select(
        F.col("p.key").alias("key"), "cid")


def _similar(a: str, b: str, na: str, nb: str):
    both = F.size(F.array_intersect(a, b))
    return F.lit(100) * both >= F.lit(PERCENT) * (F.col(na) + F.col(nb) - both)


def _verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Pairs (u, v) that reach the match threshold and whose full sets are
    similar enough."""
    def side(x):
        return sets.select(F.col("cid").alias(x), F.col("sig").alias(f"s_{x}"),
                           F.col("members").alias(f"m_{x}"), F.col("n").alias(f"n_{x}"))
    j = pairs.join(side("u"), "u").join(side("v"), "v")
    same = F.aggregate(F.zip_with("s_u", "s_v", lambda x, y: F.when(x == y, 1).otherwise(0)),
                       F.lit(0), lambda acc, x: acc + x)
    return j.where(same >= MATCHES).where(_similar("m_u", "m_v", "n_u", "n_v")).select("u", "v")


def links(sets: DataFrame, post: DataFrame) -> DataFrame:
    """Verified links (u, v) that connect exactly what all links connect.

    Round by round, the members of each posting list are held against one
    leader of the list (linear in the list), and lists whose members are all
    in one component are done. When that stops helping, what is left is
    compared in full by ``_block_links``."""
    spark = sets.sparkSession
    found, left, turn = None, None, 0
    comp = spark.createDataFrame([], "node long, component long")
    while True:
        now = post.join(comp, post["cid"] == comp["node"], "left").select(
            "key", "cid", F.coalesce("component", "cid").alias("comp"))
        rank = F.col("cid") if turn == 0 else F.xxhash64("cid", F.lit(turn))
        lists = now.groupBy("key").agg(
            F.count(F.lit(1)).alias("size"), F.min("comp").alias("lo"), F.max("comp").alias("hi"),
            F.min_by("cid", rank).alias("lead"), F.min_by("comp", rank).alias("lead_comp"))
        # a list of two is settled by its one comparison
        todo = written(lists.where(F.col("lo") < F.col("hi")).where(F.col("size") > F.lit(1 if turn == 0 else 2)), "lists")
        size = todo.agg(F.sum("size")).first()[0] or 0
        if size == 0 or (left is not None and size > 0.9 * left):
            break
        left = size
        pairs = now.join(todo, "key").where("comp != lead_comp").select(
            F.least("cid", "lead").alias("u"), F.greatest("cid", "lead").alias("v")).distinct()
        good = _verified(pairs, sets)
        found = written(good if found is None else good.unionAll(found), "links")
        comp = written(components(found), "components")
        turn += 1
    if found is None:
        return spark.createDataFrame([], "u long, v long")
    if size:
        found = found.unionAll(_block_links(now.join(todo.select("key"), "key", "left_semi"), sets))
    return found


BLOCK_CLASSES = 512
BLOCK_MEMBERS = 500_000


def _block_links(rest: DataFrame, sets: DataFrame) -> DataFrame:
    """Links among the classes of the lists in ``rest`` (key, cid, comp).

    Classes that share lists, directly or through others, form a cluster;
    similar sets differ in size by a third at most, so a cluster is cut by
    size into overlapping bands, and a band into blocks of bounded size.
    Every pair of blocks is one task: exact intersections of all its pairs,
    of which only links that join two components leave the task."""
    rest = written(rest, "rest")
    lead = rest.groupBy("key").agg(F.min("cid").alias("v"))
    cluster = components(rest.join(lead, "key").select(F.col("cid").alias("u"), "v"))
    one = rest.groupBy("cid").agg(F.first("comp").alias("comp"))
    band = F.floor(F.log("n") / F.lit(np.log(1.34).item())).cast("long")
    member = (one.join(cluster, one["cid"] == cluster["node"]).join(sets.select("cid", "n"), "cid")
              .select("cid", "comp", F.col("component").alias("cluster"), "n",
                      F.explode(F.array(band, band - 1)).alias("band")))
    member = written(member, "members")
    sizes = member.groupBy("cluster", "band").agg(
        F.min("comp").alias("lo"), F.max("comp").alias("hi"),
        F.ceil(F.greatest(F.count(F.lit(1)) / BLOCK_CLASSES, F.sum("n") / BLOCK_MEMBERS)).cast("int").alias("nb")
    ).where("lo < hi")
    at = F.pmod(F.xxhash64("cid"), F.col("nb")).cast("int")
    tasks = (member.join(sizes.select("cluster", "band", "nb"), ["cluster", "band"])
             .select("cid", "comp", "cluster", "band", at.alias("b"), F.explode(F.sequence(F.lit(0), F.col("nb") - 1)).alias("x"))
             .select("cid", "comp", "cluster", "band", F.least("b", "x").alias("i"), F.greatest("b", "x").alias("j"))
             .join(sets.select("cid", "sig", "members"), "cid"))
    return tasks.groupBy("cluster", "band", "i", "j").applyInArrow(_compare, "u long, v long")


def _rows(column) -> tuple[np.ndarray, np.ndarray]:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False), np.diff(column.offsets.to_numpy())


def _compare(table: pa.Table) -> pa.Table:
    cid = table["cid"].to_numpy()
    sig = _rows(table["sig"])[0].reshape(len(cid), COORDINATES)
    values, n = _rows(table["members"])
    _, col = np.unique(values, return_inverse=True)
    row = np.repeat(np.arange(len(cid)), n)
    # only shingles of several sets count for intersections
    shared = np.bincount(col)[col] > 1
    row, col = row[shared], np.unique(col[shared], return_inverse=True)[1]
    both = np.zeros((len(cid), len(cid)), np.float32)
    step = max(256, 4_000_000 // max(len(cid), 1))
    order = np.argsort(col, kind="stable")
    row, col = row[order], col[order]
    for lo in range(0, (int(col[-1]) + 1) if len(col) else 0, step):
        a, z = np.searchsorted(col, [lo, lo + step])
        has = np.zeros((len(cid), step), np.float32)
        has[row[a:z], col[a:z] - lo] = 1
        both += has @ has.T
    union = n[:, None] + n[None, :] - both
    similar = np.triu(100 * both >= PERCENT * union, 1)
    _, root = np.unique(table["comp"].to_numpy(), return_inverse=True)
    parent = list(range(len(cid)))

    def find(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    out = []
    for a, z in np.argwhere(similar & (root[:, None] != root[None, :])):
        x, y = find(int(root[a])), find(int(root[z]))
        if x != y and (sig[a] == sig[z]).sum() >= MATCHES:
            parent[x] = y
            out.append((int(cid[a]), int(cid[z])))
    return pa.table({"u": pa.array([o[0] for o in out], pa.int64()), "v": pa.array([o[1] for o in out], pa.int64())})


def _near(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """One row per input row: id, n_shingles, k1, k2, class_id, component_id
    and stays (whether the row's own text stands for its component).

    The nodes of the links are classes, numbered here; ids do not name them,
    as one id may be the smallest of several classes."""
    sk = written(sketch(docs, id_col, text_col), "sketch")
    # copies collapse first: one row per shingle set goes into the join
    classes = written(sk.where("id is not null and k1 is not null").groupBy("k1", "k2", "n_shingles", "sig")
                      .agg(F.min("id").alias("low"), F.count(F.lit(1)).alias("copies"))
                      .withColumn("cid", F.monotonically_increasing_id()), "classes")
    post = written(postings(classes), "postings")
    wanted = classes.join(post.select("cid").distinct(), "cid", "left_semi").select("cid", "low", "k1", "k2", "sig")
    sets = written(class_sets(docs, written(wanted, "wanted"), id_col, text_col), "sets")
    comp = components(links(sets, post))
    own = classes.select("k1", "k2", "low", "cid", "copies").join(comp, F.col("cid") == F.col("node"), "left")
    own = written(own.where("copies > 1 or component is not null")
                  .select("k1", "k2", "low", F.col("component").alias("root")), "own")
    # of a component the smallest (id, shingle set) stands for it
    tops = own.where("root is not null").groupBy("root").agg(F.min(F.struct("low", "k1", "k2")).alias("top"))
    tops = checked_small(written(tops, "tops"), 2_000_000)
    # only classes with copies or links need an answer of their own
    named = own.join(tops, "root", "left").select(
        "k1", "k2", "low", F.coalesce(F.col("top"), F.struct("low", "k1", "k2")).alias("top"))
    out = sk.select("id", "n_shingles", "k1", "k2").join(written(named, "named"), ["k1", "k2"], "left")
    given = F.col("id").isNotNull()
    stays = ~given | F.col("top").isNull() | (F.struct(F.col("id").alias("low"), "k1", "k2") == F.col("top"))
    return out.select("id", "n_shingles", "k1", "k2", F.when(given, F.coalesce("low", "id")).alias("class_id"),
                      F.when(given, F.coalesce("top.low", "id")).alias("component_id"), stays.alias("stays"))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: id, n_shingles, class_id (smallest id with the
    same shingle set), component_id (smallest id reachable over links), kept
    (id = component_id) and stays.

    Words are lower-cased (A-Z) runs of non-separators; a text of one to four
    words is one shingle; null texts and texts without words have no shingle
    and are linked with nothing. Rows without an id are linked with nothing,
    have null class and component and are kept. Rows that repeat an id are
    answered each by its own text; where that id stands for a component with
    several shingle sets of its own, ``stays`` is true for the one with the
    smallest key alone. Other columns are not read."""
    ensure_checkpoint_dir(docs.sparkSession)
    kept = F.coalesce(F.col("id") == F.col("component_id"), F.lit(True))
    return _near(docs, id_col, text_col).select(
        F.col("id").alias(id_col), "n_shingles", "class_id", "component_id", kept.alias("kept"), "stays")


def _hashable(docs: DataFrame) -> list:
    """The cells of a row for a hash: maps, which have none, as text; a null
    changes no hash, so its place goes in as well."""
    out = []
    for f in docs.schema:
        c = F.col(f"`{f.name}`")
        plain = not re.search("map<|variant|interval", f.dataType.simpleString())
        out += [c if plain else F.to_json(F.struct(c)), c.isNull()]
    return out


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with one row of every component, that of the smallest id; all
    columns as they are, of any name and type. Rows that repeat an id are
    decided each by its own text; of those with the same shingle set one
    stays (the one whose row hash is smallest). Of equal rows without a
    shingle one stays. Rows without an id all stay."""
    ensure_checkpoint_dir(docs.sparkSession)
    near = written(_near(docs, id_col, text_col), "near")
    idc = F.col(f"`{id_col}`").cast("long")
    gone_id, again_id = unused(docs, "gone"), unused(docs, "again")
    again = written(near.where("id is not null").groupBy("id").agg(F.count(F.lit(1)).alias("n"))
                    .where("n > 1").select(F.col("id").alias(again_id)), "again")
    gone = near.where("not stays").select(F.col("id").alias(gone_id)).distinct()
    if not again.limit(1).count():
        return docs.join(checked_small(gone, 2_000_000), idc == F.col(gone_id), "left_anti")
    again = checked_small(again, 2_000_000)
    gone = gone.join(again, F.col(gone_id) == F.col(again_id), "left_anti")
    once = docs.join(again, idc == F.col(again_id), "left_anti")
    once = once.join(checked_small(gone, 2_000_000), idc == F.col(gone_id), "left_anti")
    cells = _hashable(docs)
    row = ["id", "h1", "h2"]
    rep = docs.join(again, idc == F.col(again_id), "left_semi").select(
        idc.alias("id"), F.xxhash64(*cells).alias("h1"), F.xxhash64(F.lit(1), *cells).alias("h2"),
        F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    rep = written(rep.groupBy(*row).agg(F.first("row").alias("row")), "repeated")
    keyed = written(_row_keys(rep.select(*row, F.col(f"row.`{text_col}`").cast("string").alias("text"))), "keyed")
    kept = near.where("stays and k1 is not null").join(again, F.col("id") == F.col(again_id), "left_semi")
    pick = keyed.where("k1 is not null").groupBy("id", "k1", "k2").agg(F.min(F.struct("h1", "h2")).alias("h"))
    pick = pick.join(kept.select("id", "k1", "k2").distinct(), ["id", "k1", "k2"], "left_semi")
    pick = pick.select("id", "h.h1", "h.h2").unionAll(keyed.where("k1 is null").select(*row))
    return once.unionAll(rep.join(pick, row, "left_semi").select("row.*"))


def _row_keys(rows: DataFrame) -> DataFrame:
    """(id, h1, h2, k1, k2) of rows (id, h1, h2, text)."""
    def run(batch: pa.RecordBatch):
        for b, _, counts, k1, k2 in _set_blocks(batch.column("text")):
            own = {c: batch.column(c).slice(b.first, b.n_texts) for c in ("id", "h1", "h2")}
            yield {**own, "k1": pa.array(k1, mask=counts == 0), "k2": pa.array(k2, mask=counts == 0)}

    return map_arrow(rows, run, "id long, h1 long, h2 long, k1 long, k2 long")
