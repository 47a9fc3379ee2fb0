import hashlib
import random
import struct

import numpy as np
import pytest

from moodgauge.llm import sentencepiece_codec as codec

P = pytest.importorskip("public_tokenizers")
spm = pytest.importorskip("sentencepiece")
MODEL = P.path("piece_bpe_32k.model")
BITS = ["a", "the ", "▁", " ", "  ", "\n", "\t", "é", "中文", "😀", "‍", "12", "Hello", "ing", "<s>", "<unk>",
        "<0x41>", "\x00", "　", "ß", "    ", "internationalisation"]


@pytest.fixture(scope="module")
def pair():
    return codec.Codec(codec.read_model(MODEL)), spm.SentencePieceProcessor(model_file=MODEL)


def odd_texts(n, seed=5):
    rng = random.Random(seed)
    for k in range(n):
        if k % 3:
            yield "".join(rng.choice(BITS) for _ in range(rng.randrange(30)))
        else:
            yield "".join(chr(rng.choice([rng.randrange(32, 127), rng.randrange(0x3000), rng.randrange(0x10000, 0x20000)]))
                          for _ in range(rng.randrange(40)))
    yield "unbrokenword" * 2000
    yield "字" * 3000


def test_encode_decode_and_spans_as_the_library(pair):
    mine, library = pair
    for t in odd_texts(1500):
        ids, lo, hi = mine.encode_spans(t)
        whole = [mine.begin, *ids.tolist(), mine.end]
        assert whole == library.encode(t, add_bos=True, add_eos=True), repr(t)
        assert mine.decode(np.array(whole)) == library.decode(whole), repr(t)
        pieces = library.encode(t, return_type="proto").pieces
        assert list(zip(lo.tolist(), hi.tolist())) == [(p.begin, p.end) for p in pieces], repr(t)


def test_decode_of_any_ids(pair):
    mine, library = pair
    rng = random.Random(6)
    for _ in range(1500):
        ids = [rng.choice([rng.randrange(1, 32000), rng.randrange(3, 259), 1, 2, 259]) for _ in range(rng.randrange(12))]
        assert mine.decode(np.array(ids, np.int64)) == library.decode(ids), ids


def test_documents(docs, corpus, pair):
    library = pair[1]
    got = {r.doc_id: r for r in codec.encode_documents(docs, MODEL).collect()}
    for i, t in corpus:
        ids = library.encode(t or "", add_bos=True, add_eos=True)
        r = got[i]
        assert list(r.ids) == ids and r.n_tokens == len(ids)
        assert r.ids_sha256 == hashlib.sha256(struct.pack(f"<{len(ids)}I", *ids)).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(library.decode(ids).encode()).hexdigest()
        assert r.decoded == library.decode(ids)
        spans = [(p.begin, p.end) for p in library.encode(t or "", return_type="proto").pieces]
        assert list(zip(r.offsets, r.offsets[1:])) == spans
        assert r.n_source_bytes == len((t or "").encode())


def test_empty_table(no_docs):
    assert codec.encode_documents(no_docs, MODEL).count() == 0


# -- a compiled character map, built here by hand ---------------------------

def compiled(rules):
    """Double-array trie and strings of {key: replacement}."""
    strings, value = b"", {}
    for k, v in rules.items():
        value[k] = len(strings)
        strings += v + b"\0"
    units, used, bases = {0: 0}, {0}, set()

    def place(prefix, at):
        kids = sorted({k[len(prefix)] for k in value if k.startswith(prefix) and len(k) > len(prefix)})
        own = prefix in value
        base = 1
        while base in bases or any((base ^ x) in used for x in [*kids, *([0] if own else [])]):
            base += 1
        bases.add(base)
        for x in [*kids, *([0] if own else [])]:
            used.add(base ^ x)
        units[at] = units.get(at, 0) & 0xFF | ((at ^ base) << 10) | (0x100 if own else 0)
        if own:
            units[base] = 0x80000000 | value[prefix]
        for x in kids:
            units[base ^ x] = x
            place(prefix + bytes([x]), base ^ x)

    place(b"", 0)
    n = max(units) + 1
    trie = struct.pack(f"<{n}I", *(units.get(i, 0) for i in range(n)))
    return struct.pack("<I", len(trie)) + trie + strings


RULES = {b"ab": b"X", b"abc": b"yy", "é".encode(): b"e", b"\t": b" ", "ﬁ".encode(): b"fi", b"q": b""}


def brute_map(text):
    data, at, out = text.encode(), 0, []
    while at < len(data):
        for n in range(len(data) - at, 0, -1):
            if data[at:at + n] in RULES:
                out += [(at, b) for b in RULES[data[at:at + n]]]
                break
        else:
            n = len(data[at:].decode()[0].encode())
            out += [(at, b) for b in data[at:at + n]]
        at += n
    return out


def test_longest_prefix_normalisation_records_sources():
    model = {"charsmap": compiled(RULES), "add_dummy_prefix": False, "remove_extra_whitespaces": False,
             "escape_whitespaces": False}
    norm = codec.Normaliser(model)
    rng = random.Random(2)
    for _ in range(400):
        t = "".join(rng.choice(["a", "b", "c", "abc", "é", "\t", "ﬁ", "q", "zé", "日", " "]) for _ in range(rng.randrange(12)))
        text, source = norm.aligned(t)
        want = brute_map(t)
        assert text.encode() == bytes(b for _, b in want), repr(t)
        assert source.tolist()[:-1] == [a for a, _ in want], repr(t)


def test_extra_spaces_are_removed():
    model = {"charsmap": compiled(RULES), "add_dummy_prefix": True, "remove_extra_whitespaces": True, "escape_whitespaces": True}
    text, source = codec.Normaliser(model).aligned("  ab  c\t\td ")
    assert text == "▁X▁c▁d"
    assert source.tolist() == [2, 2, 2, 2, 4, 4, 4, 6, 7, 7, 7, 9, 10]


def test_remembered_parts_are_bounded_and_common_ones_stay(pair):
    mine = codec.Codec(codec.read_model(MODEL))
    mine.parts.most = 8
    merged, merge = [], mine.merge
    mine.merge = lambda part: merged.append(part) or merge(part)
    for i, t in enumerate(odd_texts(300)):
        assert mine.encode(f"{t} common") == pair[0].encode(f"{t} common")
        assert mine.encode(f"word{i} common") == pair[0].encode(f"word{i} common")
        assert len(mine.parts) + len(mine.parts.older) <= 8
    merged.clear()
    for i in range(100):
        mine.encode(f"once{i} common")
    assert merged.count(f"{codec.MARK}common") <= 1 and len(merged) <= 101


def test_a_waiting_worker_holds_no_parts_of_the_last_task(spark):
    docs = spark.createDataFrame([(i, f"word{i} and other{i % 7} words") for i in range(400)], "doc_id long, text string")
    codec.encode_documents(docs.repartition(4), MODEL).collect()

    def held(batches):
        import pyarrow as pa

        from moodgauge.llm import sentencepiece_codec

        for _ in batches:
            pass
        parts = [c.parts for c in sentencepiece_codec._CODECS.values()]
        yield pa.record_batch([pa.array([len(parts)]), pa.array([sum(len(p) + len(p.older) for p in parts)])], ["codecs", "parts"])

    got = spark.range(8).repartition(4).mapInArrow(held, "codecs long, parts long").collect()
    assert not [r for r in got if r["parts"]]
