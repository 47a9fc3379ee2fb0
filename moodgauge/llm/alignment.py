"""Alignment of the tokens of two tokenizers by diagonal run skipping.

Tokens of both cover the same bytes, so each side is a rising array of token
ends. Places where both have an end cut the tokens into groups. Most groups
are one token to one token, and along such a stretch the two arrays agree at
a constant shift of their indexes: slices of doubling length are compared at
the current shift and jumped over, a slice that differs is halved down to the
first difference. The irregular group there is resolved token by token, and
the shift moves by what it holds more on one side.

Every token of one side is linked with every token of the other in its group.
A pair of ids is counted once for each document that holds it linked. Per
document the distinct pairs and their numbers of links are written once; pair
counts and the sums over the links are made from that table, so texts are
tokenised once.

Both tokenizers cut a text before a space that follows a non-space, so both
have an end there and parts are aligned one by one: a worker remembers the
tokens and groups of the parts it has seen, and only new parts are encoded
and aligned. Where a tokenizer's file doesn't allow that, a text is one part.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from moodgauge.llm.common import map_arrow, written
from moodgauge.llm.sentencepiece_codec import MARK, read_model
from moodgauge.session import ensure_checkpoint_dir

PARTS = 1 << 19             # remembered parts of a worker, and their tokens;
PART_TOKENS = 1 << 22       # past either the worker forgets and starts anew
JOINED = 64                 # new parts that the byte-level library sees at once
SLICE_BYTES = 1 << 20       # texts aligned at once
GROUP_LINKS = 1 << 16       # larger groups are reduced to distinct ids first
HOT_PAIRS = 1 << 19         # the most counted pairs are broadcast, 17 bytes each
KEPT_PAIRS = 1 << 21        # distinct pairs a task holds before it passes them on

_CUT = re.compile(r"\s*\S+(?:[^\S ]\s*\S+)*(?:\s+\Z)?|\s+")
_ODD = re.compile(r"\s |\s\Z")     # without these, a text is cut at every space


def irregular_groups(a: list[int], b: list[int]) -> list[tuple[int, int, int, int]]:
    """(a_lo, a_hi, b_lo, b_hi) of every group but those of one token to one,
    from two rising lists of token ends with the same last end."""
    out = []
    i = shift = 0
    n = len(a)
    while i < n:
        size = 4
        while a[i:i + size] == b[i + shift:i + shift + size]:
            i += size
            if i >= n:
                return out
            size *= 2
        while size > 1:
            size //= 2
            if a[i:i + size] == b[i + shift:i + shift + size]:
                i += size
        j = i + shift
        lo = (i, j)
        x, y = a[i], b[j]
        while x != y:
            if x < y:
                i += 1
                x = a[i]
            else:
                j += 1
                y = b[j]
        i += 1
        j += 1
        out.append((lo[0], i, lo[1], j))
        shift = j - i
    return out


# --------------------------------------------------------------------------
# Tokens
# --------------------------------------------------------------------------

def _byte_alphabet() -> dict[str, int]:
    """Characters of a byte-level vocabulary: printable bytes stand for
    themselves, the others follow U+0100 in order."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [x for x in range(256) if x not in shown]
    return {chr(x): x for x in shown} | {chr(0x100 + k): x for k, x in enumerate(rest)}


class _Grown:
    """An array that grows at its end."""

    def __init__(self, kind):
        self.data, self.size = np.zeros(1024, kind), 0

    def add(self, values: np.ndarray) -> None:
        end = self.size + len(values)
        if end > len(self.data):
            self.data = np.concatenate([self.data, np.zeros(max(end, 2 * len(self.data)) - len(self.data), self.data.dtype)])
        self.data[self.size:end] = values
        self.size = end


class _Side:
    """Tokens of the remembered parts on one side, one part after another."""

    def __init__(self):
        self.ids, self.last, self.at = _Grown(np.int32), _Grown(bool), _Grown(np.int64)
        self.at.add(np.zeros(1, np.int64))

    def add(self, ids: np.ndarray, n: np.ndarray, last: np.ndarray) -> None:
        self.at.add(self.ids.size + np.cumsum(n))
        self.ids.add(ids)
        self.last.add(last)

    def get(self, parts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids and flags of parts in a row, and their numbers of tokens."""
        lo = self.at.data[parts]
        n = self.at.data[parts + 1] - lo
        place = np.arange(int(n.sum())) + np.repeat(lo - (np.cumsum(n) - n), n)
        return self.ids.data[place], self.last.data[place], n


class Tokens:
    """Ids of texts by both tokenizers and their groups; files are given by
    their bytes. Parts are remembered with their tokens and groups."""

    def __init__(self, byte_file: bytes, piece_file: bytes, cuts: bool):
        import sentencepiece
        from tokenizers import Tokenizer
        self.a = Tokenizer.from_str(byte_file.decode())
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_proto=piece_file)
        alphabet = _byte_alphabet()
        self.a_bytes = [b""] * self.a.get_vocab_size()
        for piece, i in self.a.get_vocab().items():
            known = all(c in alphabet for c in piece)
            self.a_bytes[i] = bytes(alphabet[c] for c in piece) if known else piece.encode()
        size = self.b.get_piece_size()
        self.b_bytes = [bytes([int(self.b.id_to_piece(i)[3:-1], 16)]) if self.b.is_byte(i)
                        else self.b.id_to_piece(i).replace(MARK, " ").encode() for i in range(size)]
        self.a_len = np.array([len(x) for x in self.a_bytes], np.int64)
        self.b_len = np.array([len(x) for x in self.b_bytes], np.int64)
        self.a_digits, self.b_digits = _digits(len(self.a_bytes)), _digits(size)
        self.cuts = cuts
        self._forget()

    def _forget(self) -> None:
        self.index: dict[str, int] = {}
        self.sides = _Side(), _Side()
        self.whole = _Grown(bool)       # whether both sides give the part back

    def _split(self, text: str | None) -> list[str]:
        """Parts of space + text, without the space each begins with."""
        if not text or MARK in text:
            return []
        if not self.cuts:
            return [text]
        if _ODD.search(" " + text):
            return [p[1:] for p in _CUT.findall(" " + text)]
        return text.split(" ")

    def _encode(self, parts: list[str]) -> tuple[list[np.ndarray], list[np.ndarray], bool]:
        """Flat ids and numbers of ids of each part, on both sides; whether
        they give every part back."""
        raw = np.array([len(p.encode()) + 1 for p in parts], np.int64)
        step = JOINED if self.cuts else 1
        joined = [" " + " ".join(parts[k:k + step]) for k in range(0, len(parts), step)]
        a = [np.array(e.ids, np.int32) for e in self.a.encode_batch_fast(joined, add_special_tokens=False)]
        a = np.concatenate(a) if a else np.zeros(0, np.int32)
        ends = np.cumsum(self.a_len[a])
        b = self.b.encode(parts, num_threads=1)
        n_b = np.fromiter(map(len, b), np.int64, len(b))
        b = np.fromiter(chain.from_iterable(b), np.int32, int(n_b.sum()))
        n_a = np.diff(np.searchsorted(ends, np.cumsum(raw), "right"), prepend=0)
        text = "".join(joined).encode()
        same = (b"".join(map(self.a_bytes.__getitem__, a.tolist())) == text
                and b"".join(map(self.b_bytes.__getitem__, b.tolist())) == text
                and np.array_equal(_sums(self.a_len[a], n_a), raw) and np.array_equal(_sums(self.b_len[b], n_b), raw))
        return [a, b], [n_a, n_b], same

    def _learn(self, parts: list[str]) -> None:
        ids, n, same = self._encode(parts)
        good = np.ones(len(parts), bool)
        if not same:        # find the parts that one side doesn't give back
            for k, part in enumerate(parts):
                x = self.a.encode(" " + part, add_special_tokens=False).ids
                y = self.b.encode(part)
                raw = (" " + part).encode()
                good[k] = (b"".join(map(self.a_bytes.__getitem__, x)) == raw
                           and b"".join(map(self.b_bytes.__getitem__, y)) == raw)
            kept = [p for p, g in zip(parts, good) if g]
            ids, own, same = self._encode(kept)
            n = [np.zeros(len(parts), np.int64) for _ in own]
            for to, values in zip(n, own):
                to[good] = values
        ends = [np.cumsum(size[x]).tolist() for size, x in zip((self.a_len, self.b_len), ids)]
        odd = np.array(irregular_groups(*ends), np.int64).reshape(-1, 4)
        for k, side in enumerate(self.sides):
            side.add(ids[k], n[k], _flags(len(ids[k]), odd[:, 2 * k], odd[:, 2 * k + 1]))
        self.index.update(zip(parts, range(self.whole.size, self.whole.size + len(parts))))
        self.whole.add(good)

    def align(self, texts: list[str | None]) -> "Aligned":
        own = [self._split(t) for t in texts]
        flat = list(chain.from_iterable(own))
        new = list(dict.fromkeys(p for p in flat if p not in self.index))
        if len(self.index) + len(new) > PARTS or self.sides[0].ids.size > PART_TOKENS:
            self._forget()
            new = list(dict.fromkeys(flat))
        if new:
            self._learn(new)
        part = np.fromiter(map(self.index.__getitem__, flat), np.int64, len(flat))
        text = np.repeat(np.arange(len(texts)), [len(p) for p in own])
        lost = np.zeros(len(texts), bool)
        lost[text[~self.whole.data[part]]] = True
        part, text = part[~lost[text]], text[~lost[text]]
        sides = []
        for side in self.sides:
            ids, last, n = side.get(part)
            at = np.concatenate([[0], np.cumsum(np.bincount(text, n, len(texts)).astype(np.int64))])
            sides.append((ids, last, at))
        return Aligned(self, *sides)


def _sums(values: np.ndarray, n: np.ndarray) -> np.ndarray:
    total = np.concatenate([[0], np.cumsum(values)])
    ends = np.cumsum(n)
    return total[ends] - total[ends - n]


def _digits(n: int) -> np.ndarray:
    """(n, width) decimal digits of 0..n-1 as bytes, zero bytes after them."""
    width = len(str(max(n - 1, 0)))
    return np.array([str(i) for i in range(n)], f"S{width}").view(np.uint8).reshape(n, width)


def _cuts(byte_file: dict, model: dict) -> bool:
    """Whether both tokenizers treat the parts of ``_CUT`` one by one."""
    pre = byte_file.get("pre_tokenizer") or {}
    by_bytes = (not byte_file.get("normalizer") and pre.get("type") == "ByteLevel" and pre.get("use_regex", True)
                and not pre.get("add_prefix_space") and not byte_file["model"].get("dropout"))
    inner = any(re.search(f"[^{MARK}]{MARK}", t) for t, _, _ in model["pieces"])
    plain = (not model["charsmap"] and model["add_dummy_prefix"] and model["escape_whitespaces"]
             and not model["remove_extra_whitespaces"] and model["byte_fallback"])
    return bool(by_bytes and plain and not inner)


# --------------------------------------------------------------------------
# Groups and links of a slice of texts
# --------------------------------------------------------------------------

def _flags(n: int, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """Set for the last token of every group; groups are single tokens but
    for lo..hi."""
    inner = np.zeros(n, np.int32)
    inner[lo] += 1
    inner[hi - 1] -= 1
    return np.cumsum(inner) == 0


class Aligned:
    """Groups of a run of texts; arrays run over all their tokens."""

    def __init__(self, tokens: Tokens, a: tuple, b: tuple):
        self.tokens = tokens
        self.a, self.a_last, self.a_at = a
        self.b, self.b_last, self.b_at = b
        # bounds of every group on both sides
        self.a_hi, self.b_hi = np.flatnonzero(self.a_last) + 1, np.flatnonzero(self.b_last) + 1
        self.a_lo, self.b_lo = np.append(0, self.a_hi[:-1])[:len(self.a_hi)], np.append(0, self.b_hi[:-1])[:len(self.b_hi)]
        # group of a token, and groups before a text
        self.group_at = np.searchsorted(self.a_hi, self.a_at, "right")
        self.links = (self.a_hi - self.a_lo) * (self.b_hi - self.b_lo)

    def per_text(self, values: np.ndarray) -> np.ndarray:
        """Sums over the groups of each text."""
        total = np.concatenate([[0], np.cumsum(values)])
        return total[self.group_at[1:]] - total[self.group_at[:-1]]

    def digests(self) -> list[str]:
        """Hash of ``a1,a2|b1;a3|b2,b3`` of each text, '' without tokens."""
        ga, gb = np.cumsum(self.a_last) - self.a_last, np.cumsum(self.b_last) - self.b_last
        at_a = np.arange(len(self.a)) + self.b_lo[ga]
        at_b = np.arange(len(self.b)) + self.a_hi[gb]
        da, db = self.tokens.a_digits, self.tokens.b_digits
        width = max(da.shape[1], db.shape[1]) + 1
        cells = np.zeros((len(self.a) + len(self.b), width), np.uint8)
        cells[at_a, :da.shape[1]] = da[self.a]
        cells[at_b, :db.shape[1]] = db[self.b]
        cells[at_a, -1] = np.where(self.a_last, ord("|"), ord(","))
        cells[at_b, -1] = np.where(self.b_last, ord(";"), ord(","))
        ends = self.a_at[1:] + self.b_at[1:]
        cells[ends[np.diff(self.a_at) > 0] - 1, -1] = 0      # no mark after a text's last group
        full = cells != 0
        size = np.concatenate([[0], np.cumsum(full.sum(1))])
        raw = cells[full].tobytes()
        starts = self.a_at[:-1] + self.b_at[:-1]
        return [hashlib.sha256(raw[size[x]:size[y]]).hexdigest() if y > x else "" for x, y in zip(starts, ends)]

    def pairs(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Distinct linked pairs of ids of all texts: text, pair
        (a * size of B's vocabulary + b) and number of links, in order."""
        size = len(self.tokens.b_bytes)
        text = np.repeat(np.arange(len(self.group_at) - 1), np.diff(self.group_at))
        big = self.links > GROUP_LINKS
        n = np.where(big, 0, self.links)
        group = np.repeat(np.arange(len(n)), n)
        k = np.arange(len(group)) - np.repeat(np.cumsum(n) - n, n)
        wide = np.repeat(self.b_hi - self.b_lo, n)
        key = self.a[self.a_lo[group] + k // wide].astype(np.int64) * size + self.b[self.b_lo[group] + k % wide]
        keys, texts, counts = [key], [text[group]], [np.ones(len(key), np.int64)]
        for g in np.flatnonzero(big):
            x, nx = np.unique(self.a[self.a_lo[g]:self.a_hi[g]], return_counts=True)
            y, ny = np.unique(self.b[self.b_lo[g]:self.b_hi[g]], return_counts=True)
            keys.append((x.astype(np.int64)[:, None] * size + y[None, :]).ravel())
            counts.append((nx[:, None] * ny[None, :]).ravel())
            texts.append(np.full(len(keys[-1]), text[g]))
        span = len(self.tokens.a_bytes) * size
        both = np.concatenate(texts) * span + np.concatenate(keys)
        if len(keys) == 1:
            both = np.sort(both)
            n = None
        else:
            order = np.argsort(both, kind="stable")
            both, n = both[order], np.concatenate(counts)[order]
        first = np.flatnonzero(np.append(True, both[1:] != both[:-1])[:len(both)])
        links = np.diff(np.append(first, len(both))) if n is None else np.add.reduceat(n, first) if len(first) else first
        return both[first] // span, both[first] % span, links


def slices(texts: list[str | None]) -> Iterator[tuple[int, int]]:
    """Runs of texts of about SLICE_BYTES; a longer text is a run alone."""
    lo = size = 0
    for k, t in enumerate(texts):
        if k > lo and size + len(t or "") > SLICE_BYTES:
            yield lo, k
            lo, size = k, 0
        size += len(t or "")
    if len(texts) > lo:
        yield lo, len(texts)


_TOKENS: dict[str, Tokens] = {}


class _Files:
    """Both tokenizer files, broadcast; ``tokens`` is one object a worker."""

    def __init__(self, spark: SparkSession, byte_path: str, piece_path: str):
        with open(byte_path, "rb") as f, open(piece_path, "rb") as g:
            files = f.read(), g.read()
        spec, model = json.loads(files[0]), read_model(piece_path)
        self.sizes = len(spec["model"]["vocab"]) + len(spec.get("added_tokens") or ()), len(model["pieces"])
        self.key = hashlib.sha256(files[0] + files[1]).hexdigest()
        self.files = spark.sparkContext.broadcast((*files, _cuts(spec, model)))     # a few MB

    def tokens(self) -> Tokens:
        if self.key not in _TOKENS:
            import os
            os.environ["TOKENIZERS_PARALLELISM"] = "false"      # the task has one core
            _TOKENS.clear()
            _TOKENS[self.key] = Tokens(*self.files.value)
        return _TOKENS[self.key]


def _lists(values: np.ndarray, at: np.ndarray, kind: pa.DataType) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(values, kind))


def align(docs: DataFrame, byte_path: str, piece_path: str, id_col: str = "doc_id",
          text_col: str = "text") -> DataFrame:
    """One row per input row: ``id_col``, a_ids, b_ids and, for every group,
    the number of its last token on both sides (a_ends, b_ends; exclusive).

    Texts that are null, empty, or not given back byte by byte by both
    tokenizers have no tokens. Ids may be null or repeated, rows repeated;
    other columns are not read. Row-local: a task holds one Arrow batch and
    the tokens of a slice of it."""
    ensure_checkpoint_dir(docs.sparkSession)
    files = _Files(docs.sparkSession, byte_path, piece_path)
    src = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))

    def run(batch: pa.RecordBatch):
        texts = batch.column("text").to_pylist()
        for lo, hi in slices(texts):
            got = files.tokens().align(texts[lo:hi])
            groups = np.diff(got.group_at)
            yield {"id": batch.column("id").slice(lo, hi - lo),
                   "a_ids": _lists(got.a, got.a_at, pa.int32()), "b_ids": _lists(got.b, got.b_at, pa.int32()),
                   "a_ends": _lists(got.a_hi - np.repeat(got.a_at[:-1], groups), got.group_at, pa.int32()),
                   "b_ends": _lists(got.b_hi - np.repeat(got.b_at[:-1], groups), got.group_at, pa.int32())}

    kind = src.schema["id"].dataType.simpleString()
    out = map_arrow(src, run, f"id {kind}, a_ids array<int>, b_ids array<int>, a_ends array<int>, b_ends array<int>")
    return out.withColumnRenamed("id", id_col) if id_col != "id" else out


def _linked(docs: DataFrame, files: _Files, id_col: str, text_col: str) -> DataFrame:
    """Written table: row number, id, sizes, hash of the groups, distinct
    pairs of ids and their numbers of links."""
    narrow = files.sizes[0] * files.sizes[1] < 1 << 31
    kind = "int" if narrow else "long"
    src = docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("id"),
                      F.col(text_col).cast("string").alias("text"))

    def run(batch: pa.RecordBatch):
        texts = batch.column("text").to_pylist()
        for lo, hi in slices(texts):
            got = files.tokens().align(texts[lo:hi])
            text, pair, links = got.pairs()
            at = np.searchsorted(text, np.arange(hi - lo + 1))
            yield {"row": batch.column("row").slice(lo, hi - lo), "id": batch.column("id").slice(lo, hi - lo),
                   "n_a": np.diff(got.a_at), "n_b": np.diff(got.b_at), "n_groups": np.diff(got.group_at),
                   "n_links": got.per_text(got.links), "groups_sha256": got.digests(),
                   "pairs": _lists(pair, at, pa.int32() if narrow else pa.int64()), "links": _lists(links, at, pa.int64())}

    out = map_arrow(src, run, f"row long, id {src.schema['id'].dataType.simpleString()}, n_a long, n_b long, n_groups long, "
                              f"n_links long, groups_sha256 string, pairs array<{kind}>, links array<long>")
    return written(out, "alignment")


def _count_pairs(linked: DataFrame) -> DataFrame:
    """(pair, n): documents that hold a pair linked. Tasks count before the
    shuffle and hold a bounded number of pairs."""
    def compact(keys, counts):
        k, at = np.unique(np.concatenate(keys), return_inverse=True)
        return k, np.bincount(at, np.concatenate(counts)).astype(np.int64)

    def run(batches):
        keys, counts, size = [], [], 0
        for batch in batches:
            own = batch.column("pairs").flatten().to_numpy(zero_copy_only=False).astype(np.int64)
            k, n = np.unique(own, return_counts=True)
            keys.append(k)
            counts.append(n)
            size += len(k)
            if size > 2 * KEPT_PAIRS:
                k, n = compact(keys, counts)
                keys, counts, size = [k], [n], len(k)
                if size > KEPT_PAIRS:
                    yield pa.record_batch({"pair": pa.array(k), "n": pa.array(n)})
                    keys, counts, size = [], [], 0
        if keys:
            k, n = compact(keys, counts)
            yield pa.record_batch({"pair": pa.array(k), "n": pa.array(n)})

    part = linked.select("pairs").mapInArrow(run, "pair long, n long")
    return part.groupBy("pair").agg(F.sum("n").alias("n"))


def pair_counts(docs: DataFrame, byte_path: str, piece_path: str, id_col: str = "doc_id",
                text_col: str = "text") -> DataFrame:
    """(a_id, b_id, n_docs, best) of every linked pair of ids of the corpus;
    best if no pair of the same a_id has a higher count."""
    ensure_checkpoint_dir(docs.sparkSession)
    files = _Files(docs.sparkSession, byte_path, piece_path)
    return _ranked(_linked(docs, files, id_col, text_col), files.sizes[1]).select("a_id", "b_id", "n_docs", "best")


def _ranked(linked: DataFrame, size: int) -> DataFrame:
    counts = written(_count_pairs(linked), "pairs").withColumn("a_id", F.expr(f"pair div {size}"))
    top = counts.groupBy("a_id").agg(F.max("n").alias("top"))       # at most one row per id of A
    return counts.join(F.broadcast(top), "a_id").select(
        "pair", "a_id", F.col("pair") % size, F.col("n").alias("n_docs"), (F.col("n") == F.col("top")).alias("best")
    ).toDF("pair", "a_id", "b_id", "n_docs", "best")


def _level(ranked: DataFrame, most: int) -> int:
    """Least count such that at most ``most`` pairs have it or more; pairs
    are tallied by count in steps of an eighth of a power of two."""
    step = F.floor(F.log2("n_docs") * 8).cast("int")
    tally = {r["step"]: r["n"] for r in ranked.groupBy(step.alias("step")).agg(F.count(F.lit(1)).alias("n")).collect()}
    total = 0
    for s in sorted(tally, reverse=True):
        total += tally[s]
        if total > most:
            return s + 1
    return 0


def token_links(docs: DataFrame, byte_path: str, piece_path: str, id_col: str = "doc_id", text_col: str = "text",
                hot_pairs: int = HOT_PAIRS) -> DataFrame:
    """One row per input row: ``id_col``, n_a, n_b, n_groups, n_links, n_best
    (links whose pair has the highest count of its A id, ties included),
    count_sum (of the pairs' counts over all links) and groups_sha256.

    Texts that are null, empty, or not given back byte by byte by both
    tokenizers have zeros and an empty hash, and count for no pair. Each row
    is a document: repeated rows and ids count each. Other columns are not
    read; an empty table gives no rows.

    The ``hot_pairs`` most counted pairs are broadcast, which resolves nearly
    all links inside the tasks; the rare rest meets its counts in a shuffle
    join on the pair, where no key is hot."""
    spark = docs.sparkSession
    ensure_checkpoint_dir(spark)
    files = _Files(spark, byte_path, piece_path)
    linked = _linked(docs, files, id_col, text_col)
    ranked = written(_ranked(linked, files.sizes[1]), "ranked")
    level = _level(ranked, hot_pairs)
    hot = F.floor(F.log2("n_docs") * 8).cast("int") >= level
    top = ranked.where(hot).select("pair", "n_docs", "best").toArrow()      # at most hot_pairs rows
    keys = top["pair"].to_numpy()
    order = np.argsort(keys)
    table = spark.sparkContext.broadcast((keys[order], top["n_docs"].to_numpy()[order],
                                          top["best"].combine_chunks().to_numpy(zero_copy_only=False)[order]))
    own = ["row", "id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256"]
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in linked.schema if f.name in own)

    def run(batch: pa.RecordBatch):
        known, n_docs, best = table.value
        pairs, links = batch.column("pairs"), batch.column("links")
        size = np.diff(pairs.offsets.to_numpy())
        pair = pairs.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
        link = links.flatten().to_numpy(zero_copy_only=False)
        at = np.minimum(np.searchsorted(known, pair), max(len(known) - 1, 0))
        found = known[at] == pair if len(known) else np.zeros(len(pair), bool)
        at = at[found]

        def per_row(values):
            full = np.zeros(len(pair) + 1, np.int64)
            full[1:][found] = values
            np.cumsum(full, out=full)
            ends = np.cumsum(size)
            return full[ends] - full[ends - size]

        row = np.repeat(np.arange(len(size)), size)[~found]
        rest = np.searchsorted(row, np.arange(len(size) + 1))
        yield {**{c: batch.column(c) for c in own}, "n_best": per_row(link[found] * best[at]),
               "count_sum": per_row(link[found] * n_docs[at]),
               "rest": _lists(pair[~found], rest, pa.int64()), "rest_links": _lists(link[~found], rest, pa.int64())}

    out = map_arrow(linked, run, f"{schema}, n_best long, count_sum long, rest array<long>, rest_links array<long>")
    if level > 0:
        rare = out.where(F.size("rest") > 0).select("row", F.arrays_zip("rest", "rest_links").alias("z")) \
            .select("row", F.explode("z").alias("z")).select("row", F.col("z.rest").alias("pair"), F.col("z.rest_links").alias("k"))
        more = rare.join(ranked.where(~hot), "pair").groupBy("row").agg(
            F.sum(F.when(F.col("best"), F.col("k")).otherwise(0)).alias("more_best"), F.sum(F.col("k") * F.col("n_docs")).alias("more_sum"))
        out = out.drop("rest", "rest_links").join(more, "row", "left")
        out = (out.withColumn("n_best", F.col("n_best") + F.coalesce("more_best", F.lit(0)))
               .withColumn("count_sum", F.col("count_sum") + F.coalesce("more_sum", F.lit(0))))
    return out.select(F.col("id").alias(id_col), "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")
