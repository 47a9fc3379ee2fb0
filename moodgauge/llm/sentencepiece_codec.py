"""Offset-preserving SentencePiece encoding and decoding.

The model file (its path is a parameter) is read once on the driver; its
pieces, flags and compiled character map (a few hundred KB) are broadcast.

Normalisation walks the text by longest prefix of the character map, a
double-array trie, and records for every normalised byte the source byte it
came from. A text is then cut before every run of the space mark: if no piece
has the mark after another character, pieces never cross such a cut, so each
part is merged on its own and its result is remembered. Piece ends,
projected through the recorded alignment, are byte spans of the source.
"""

from __future__ import annotations

import hashlib
import heapq
import re
import struct

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from moodgauge.llm.common import map_arrow

MARK = "▁"
# fixed values of the model file's format: piece types
NORMAL, UNKNOWN, CONTROL, USER_DEFINED, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
# parts longer than this are not remembered; of the others, so many at most, and
# fewer where pieces are returned: executors then hold their columns as well, and
# a worker that waits for its next task holds none
PART_CHARS, PARTS, PARTS_BESIDE_PIECES = 64, 500_000, 40_000


# --------------------------------------------------------------------------
# Model file
# --------------------------------------------------------------------------

def _fields(buf: bytes):
    """(number, value) of a protocol-buffer message."""
    at = 0

    def varint():
        nonlocal at
        n = shift = 0
        while True:
            byte = buf[at]
            at += 1
            n |= (byte & 0x7F) << shift
            shift += 7
            if byte < 0x80:
                return n

    while at < len(buf):
        tag = varint()
        if tag & 7 == 0:
            yield tag >> 3, varint()
        elif tag & 7 == 2:
            n = varint()
            yield tag >> 3, buf[at:at + n]
            at += n
        else:
            n = 4 if tag & 7 == 5 else 8
            yield tag >> 3, buf[at:at + n]
            at += n


def read_model(path: str) -> dict:
    """Pieces (text, score, type) and settings of a model file."""
    with open(path, "rb") as f:
        raw = f.read()
    model = {"pieces": [], "charsmap": b"", "add_dummy_prefix": True, "remove_extra_whitespaces": True,
             "escape_whitespaces": True, "byte_fallback": False, "model_type": 1}
    # fixed numbers of the file's format
    for field, value in _fields(raw):
        if field == 1:
            p = dict(_fields(value))
            model["pieces"].append((p[1].decode(), struct.unpack("<f", p[2])[0] if 2 in p else 0.0, p.get(3, NORMAL)))
        elif field == 2:
            t = dict(_fields(value))
            model["model_type"] = t.get(3, 1)
            model["byte_fallback"] = bool(t.get(35, 0))
        elif field == 3:
            n = dict(_fields(value))
            model["charsmap"] = n.get(2, b"")
            for key, number in (("add_dummy_prefix", 3), ("remove_extra_whitespaces", 4), ("escape_whitespaces", 5)):
                model[key] = bool(n.get(number, 1))
    return model


# --------------------------------------------------------------------------
# Normalisation
# --------------------------------------------------------------------------

class CharacterMap:
    """Longest-prefix lookup in a compiled character map: a 4-byte size, a
    double-array trie of that many bytes, then the replacement strings, each
    ended by a zero byte. An empty map replaces nothing."""

    def __init__(self, blob: bytes):
        self.units = np.zeros(0, np.uint32)
        self.strings = b""
        if blob:
            (size,) = struct.unpack_from("<I", blob)
            self.units = np.frombuffer(blob, "<u4", size // 4, 4)
            self.strings = blob[4 + size:]

    def longest(self, data: bytes, at: int) -> tuple[int, bytes] | None:
        """Length of the longest key at ``at`` and its replacement."""
        units, best = self.units, None
        if not len(units):
            return None
        pos = _offset(int(units[0]))
        for i in range(at, len(data)):
            if data[i] == 0:
                break
            pos ^= data[i]
            if pos >= len(units):
                break
            unit = int(units[pos])
            if unit & 0x800000FF != data[i]:
                break
            pos ^= _offset(unit)
            if unit >> 8 & 1:       # a key ends here; its value is next
                value = int(units[pos]) & 0x7FFFFFFF
                best = i + 1 - at, self.strings[value:self.strings.index(b"\0", value)]
        return best


def _offset(unit: int) -> int:
    return (unit >> 10) << ((unit & 0x200) >> 6)


class Normaliser:
    """Text to normalised text plus, per normalised byte, its source byte."""

    def __init__(self, model: dict):
        self.map = CharacterMap(model["charsmap"])
        self.prefix = model["add_dummy_prefix"]
        self.squeeze = model["remove_extra_whitespaces"]
        self.space = MARK if model["escape_whitespaces"] else " "
        self.plain = not model["charsmap"] and not self.squeeze

    def quick(self, text: str) -> str:
        """The normalised text where no alignment is asked for."""
        if not self.plain:
            return self.aligned(text)[0]
        return (self.space if self.prefix and text else "") + text.replace(" ", self.space)

    def _chunks(self, data: bytes):
        at = 0
        while at < len(data):
            hit = self.map.longest(data, at)
            if hit:
                yield at, hit[0], hit[1]
            else:
                n = 1 + (data[at] >= 0xC0) + (data[at] >= 0xE0) + (data[at] >= 0xF0)
                hit = n, data[at:at + n]
                yield at, n, hit[1]
            at += hit[0]

    def aligned(self, text: str) -> tuple[str, np.ndarray]:
        """(normalised, source): source[i] is the source byte that the i-th
        normalised byte comes from; one more entry holds the end."""
        data = text.encode()
        if self.plain:
            return self._aligned_plain(data, text)
        space = self.space.encode()
        out, src, end = [], [], 0
        chunks = list(self._chunks(data))
        if self.squeeze:            # spaces at both ends go
            while chunks and chunks[0][2] in (b" ", b""):
                chunks.pop(0)
            while chunks and chunks[-1][2] in (b" ", b""):
                chunks.pop()
        if not chunks:
            return "", np.zeros(1, np.int64)
        end = chunks[-1][0] + chunks[-1][1]
        if self.prefix:
            out.append(space)
            src += [chunks[0][0]] * len(space)
        after_space = self.squeeze
        for at, _, piece in chunks:
            for byte in (piece[i:i + 1] for i in range(len(piece))):
                if byte == b" ":
                    if after_space and self.squeeze:
                        continue
                    byte, after_space = space, True
                else:
                    after_space = False
                out.append(byte)
                src += [at] * len(byte)
        return b"".join(out).decode(), np.array([*src, end], np.int64)

    def _aligned_plain(self, data: bytes, text: str) -> tuple[str, np.ndarray]:
        raw = np.frombuffer(data, np.uint8)
        wide = np.where(raw == 0x20, len(self.space.encode()), 1)
        # a character's bytes all come from its first byte
        lead = np.maximum.accumulate(np.where((raw & 0xC0) != 0x80, np.arange(len(raw)), 0)) if len(raw) else raw.astype(np.int64)
        src = np.repeat(lead, wide)
        if self.prefix and len(raw):
            src = np.concatenate([np.zeros(len(self.space.encode()), np.int64), src])
        return self.quick(text), np.append(src, len(raw))


# --------------------------------------------------------------------------
# Encoding and decoding
# --------------------------------------------------------------------------

class Codec:
    """Encoder and decoder for one model of merge (BPE) type."""

    def __init__(self, model: dict):
        if model["model_type"] != 2:
            raise ValueError("the model is not of merge type")
        self.normaliser = Normaliser(model)
        self.pieces = {t: (i, s) for i, (t, s, k) in enumerate(model["pieces"]) if k in (NORMAL, USER_DEFINED, UNUSED)}
        if any(k in (USER_DEFINED, UNUSED) for _, _, k in model["pieces"]):
            raise ValueError("user-defined and unused pieces are not supported")
        self.rank = {t: -s for t, (_, s) in self.pieces.items()}     # lowest is merged first
        self.unknown = next(i for i, p in enumerate(model["pieces"]) if p[2] == UNKNOWN)
        self.byte_ids = [i for i, p in enumerate(model["pieces"]) if p[2] == BYTE] if model["byte_fallback"] else []
        ids = {t: i for i, (t, _, _) in enumerate(model["pieces"])}
        self.begin, self.end = ids["<s>"], ids["</s>"]
        # pieces never cross a cut before a run of marks if none has a mark
        # after another character
        split = not any(re.search(f"[^{MARK}]{MARK}", t) for t in self.pieces)
        self.cut = re.compile(f"{MARK}+[^{MARK}]*|[^{MARK}]+") if split else re.compile("(?s).+")
        self.parts = _Parts(self)
        # for decoding: bytes of every id, and ids that are single bytes
        self.surface = [t.replace(MARK, " ").encode() if k == NORMAL else b"" for t, _, k in model["pieces"]]
        self.surface[self.unknown] = " ⁇ ".encode()
        self.control = np.array([k == CONTROL for _, _, k in model["pieces"]])
        self.byte_of = {i: n for n, i in enumerate(self.byte_ids)}
        for i, n in self.byte_of.items():
            self.surface[i] = bytes([n])
        # normalised bytes of every id; a byte piece is one of them, and all
        # bytes of a character are aligned with its first source byte, so the
        # span of the character falls to the last of its byte pieces
        self.widths = np.array([len(t.encode()) if k == NORMAL else int(k == BYTE) for t, _, k in model["pieces"]], np.int64)
        self.prefix = model["add_dummy_prefix"] or model["remove_extra_whitespaces"]

    # -- encoding

    def encode(self, text: str) -> bytes:
        """Ids as little-endian 32-bit integers, without begin and end."""
        return b"".join(map(self.parts.__getitem__, self.cut.findall(self.normaliser.quick(text))))

    def encode_spans(self, text: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids with the source bytes [lo, hi) of each piece."""
        normal, source = self.normaliser.aligned(text)
        ids = np.frombuffer(b"".join(map(self.parts.__getitem__, self.cut.findall(normal))), "<u4")
        widths = self.widths[ids]
        if not self.byte_ids and (ids == self.unknown).any():
            raise ValueError("spans of unknown characters need a model with byte pieces")
        ends = np.cumsum(widths)
        return ids, source[ends - widths], source[ends]

    def merge(self, part: str) -> list[int]:
        """Ids of the pieces of one part: the best-scored pair of neighbours
        is merged first, the leftmost of equals."""
        sym = list(part)
        if len(sym) <= PART_CHARS:
            self._merge_short(sym)
        else:
            sym = self._merge_long(sym)
        out = []
        for s in sym:
            hit = self.pieces.get(s)
            if hit is not None:
                out.append(hit[0])
            elif self.byte_ids:
                out += [self.byte_ids[c] for c in s.encode()]
            else:
                out.append(self.unknown)
        return out

    def _merge_short(self, sym: list[str]) -> None:
        get, none = self.rank.get, float("inf")
        ranks = [get(a + b, none) for a, b in zip(sym, sym[1:])]
        while ranks:
            best = min(ranks)
            if best == none:
                break
            i = ranks.index(best)
            sym[i:i + 2] = [sym[i] + sym[i + 1]]
            del ranks[i]
            if i < len(ranks):
                ranks[i] = get(sym[i] + sym[i + 1], none)
            if i:
                ranks[i - 1] = get(sym[i - 1] + sym[i], none)

    def _merge_long(self, sym: list[str]) -> list[str]:
        n = len(sym)
        before, after = list(range(-1, n - 1)), list(range(1, n + 1))
        heap: list[tuple[float, int, int, str]] = []

        def offer(a, b):
            if 0 <= a and b < n:
                rank = self.rank.get(sym[a] + sym[b])
                if rank is not None:
                    heapq.heappush(heap, (rank, a, b, sym[a] + sym[b]))

        for i in range(n - 1):
            offer(i, i + 1)
        while heap:
            _, a, b, joined = heapq.heappop(heap)
            if not sym[a] or not sym[b] or sym[a] + sym[b] != joined or after[a] != b:
                continue
            sym[a], sym[b] = joined, ""
            after[a] = after[b]
            if after[a] < n:
                before[after[a]] = a
            offer(before[a], a)
            offer(a, after[a])
        return [s for s in sym if s]

    # -- decoding

    def decode(self, ids: np.ndarray) -> str:
        """Text of ids: control ids say nothing, the space of the dummy
        prefix goes, and bytes that are not UTF-8 become U+FFFD one by one."""
        inside = np.flatnonzero(self.control[ids[1:-1]]) + 1
        # a control id also ends a run of byte pieces
        runs = [b"".join(map(self.surface.__getitem__, run.tolist())) for run in np.split(ids, inside)]
        if self.prefix:
            first = next((i for i in map(int, ids) if self.surface[i]), self.unknown)
            if first != self.unknown and first not in self.byte_of:
                k = next(k for k, run in enumerate(runs) if run)
                runs[k] = runs[k].removeprefix(b" ")
        return "".join(run.decode(errors="bytewise") for run in runs)


def _bytewise(error: UnicodeDecodeError):
    return "�", error.start + 1


import codecs  # noqa: E402

codecs.register_error("bytewise", _bytewise)


class _Parts(dict):
    """Part -> its ids as bytes, merged when first seen. When half of ``most``
    are held they become the older half, and the older ones that were not met
    again since go: common parts stay, and memory is bounded."""

    def __init__(self, codec: Codec, most: int = PARTS):
        super().__init__()
        self.codec, self.most = codec, most
        self.older: dict[str, bytes] = {}

    def __missing__(self, part: str) -> bytes:
        ids = self.older.get(part)
        if ids is None:
            got = self.codec.merge(part)
            ids = struct.pack(f"<{len(got)}I", *got)
        if len(part) <= PART_CHARS:
            if len(self) >= self.most // 2:
                self.older = dict(self)
                self.clear()
            self[part] = ids
        return ids

    def forget(self) -> None:
        self.clear()
        self.older = {}


_CODECS: dict[str, Codec] = {}


def codec_of(model: dict, key: str) -> Codec:
    """One codec per worker process and model."""
    if key not in _CODECS:
        _CODECS.clear()
        _CODECS[key] = Codec(model)
    return _CODECS[key]


def forget_parts(key: str) -> None:
    if key in _CODECS:
        _CODECS[key].parts.forget()


def encode_documents(docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text",
                     pieces: bool = True) -> DataFrame:
    """One row per input row: ``id_col``, n_tokens (begin and end included),
    ids_sha256, decoded_sha256, n_source_bytes (bytes of the text that the
    piece spans cover) and, with ``pieces``, ids, offsets and decoded. Without
    begin and end, piece i covers the bytes offsets[i] to offsets[i + 1] of the
    text; of the pieces of a character written byte by byte, the last one
    carries its span.

    Null and empty texts have the begin and end ids only. Repeated rows and
    null ids are answered row by row; other columns are not read. A batch of
    rows is handled text by text, so a task holds one batch and one text's
    arrays."""
    spark = docs.sparkSession
    model = read_model(model_path)
    key = hashlib.sha256(repr(sorted(model.items())).encode()).hexdigest()
    shared = spark.sparkContext.broadcast(model)
    src = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    schema = (f"id {src.schema['id'].dataType.simpleString()}, n_tokens long, ids_sha256 string, "
              "decoded_sha256 string, n_source_bytes long")
    if pieces:
        schema += ", ids array<int>, offsets array<int>, decoded string"

    def run(batch: pa.RecordBatch):
        codec = codec_of(shared.value, key)
        codec.parts.most = PARTS_BESIDE_PIECES if pieces else PARTS
        edge = struct.pack("<I", codec.begin), struct.pack("<I", codec.end)
        for at in range(0, batch.num_rows, 256):
            rows = batch.slice(at, 256)
            out: dict[str, list] = {name: [] for name in
                                    ("n_tokens", "ids_sha256", "decoded_sha256", "n_source_bytes",
                                     "ids", "offsets", "decoded")}
            for text in rows.column("text").to_pylist():
                ids, lo, hi = codec.encode_spans(text or "")
                raw = edge[0] + ids.tobytes() + edge[1]
                whole = np.frombuffer(raw, "<u4")
                decoded = codec.decode(whole)
                out["n_tokens"].append(len(whole))
                out["ids_sha256"].append(hashlib.sha256(raw).hexdigest())
                out["decoded_sha256"].append(hashlib.sha256(decoded.encode()).hexdigest())
                out["n_source_bytes"].append(int((hi - lo).sum()))
                if pieces:
                    out["ids"].append(whole.astype(np.int32))
                    # every piece begins where the one before ends
                    out["offsets"].append(np.concatenate([lo[:1], hi]).astype(np.int32))
                    out["decoded"].append(decoded)
            yield {"id": rows.column("id"), **out}

    got = map_arrow(src, run, schema, (lambda: forget_parts(key)) if pieces else None)
    return got.withColumnRenamed("id", id_col) if id_col != "id" else got
