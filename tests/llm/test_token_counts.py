import random
import re

import pytest

from moodgauge.llm import token_counts as tc
from texts import prose

P = pytest.importorskip("public_tokenizers")
MODEL = P.path("piece_bpe_32k.model")
MARK = "▁"


def model(pieces, byte_fallback=True):
    return {"pieces": [(p, s, 1) for p, s in pieces], "charsmap": b"", "add_dummy_prefix": True,
            "remove_extra_whitespaces": False, "escape_whitespaces": True, "byte_fallback": byte_fallback, "model_type": 1}


def brute(pieces, text, byte_fallback=True):
    """Best path over the whole text; of equals, the earlier start of the
    last piece."""
    text = (MARK if text else "") + text.replace(" ", MARK)
    score = dict(pieces)
    lost = min(score.values()) - 10
    best = [(0.0, 0, False)]
    for end in range(1, len(text) + 1):
        top = None
        for start in range(end):
            piece = text[start:end]
            if piece in score:
                cand = (best[start][0] + score[piece], best[start][1] + 1, False)
            elif end - start == 1:
                cand = (best[start][0] + lost, best[start][1] + (len(piece.encode()) if byte_fallback else not best[start][2]), True)
            else:
                continue
            if top is None or cand[0] > top[0]:
                top = cand
        best.append(top)
    return best[-1][1], best[-1][0]


@pytest.mark.parametrize("seed", range(6))
def test_against_whole_text_search(seed):
    rng = random.Random(seed)
    pieces = list({"".join(rng.choice("abé" + MARK * (n == 0)) for n in range(rng.randrange(1, 5))): -float(rng.randrange(1, 9))
                   for _ in range(25)}.items())
    for fallback in (True, False):
        c = tc.Counter(model(pieces, fallback))
        for _ in range(150):
            t = "".join(rng.choice("abéz  字") for _ in range(rng.randrange(25)))
            assert c.count(t) == brute(pieces, t, fallback), (t, pieces)


def test_equal_scores_keep_the_longer_last_piece():
    pieces = [(MARK, -1.0), ("a", -1.0), ("ab", -2.0), ("b", -1.0), ("bc", -1.0), ("c", -1.0), ("abc", -3.0)]
    c = tc.Counter(model(pieces))
    assert c.part("ab") == (-2.0, 1)        # "ab" starts first
    assert c.part("abc") == (-2.0, 2)       # "a" "bc" beats "abc"


def test_as_the_tokenizer_library():
    tokenizers = pytest.importorskip("tokenizers")
    from moodgauge.llm.sentencepiece_codec import read_model
    m = read_model(MODEL)
    vocab = [(t, s) for t, s, k in m["pieces"] if k in (1, 6)]
    # byte pieces are in the list only to be named
    low = min(s for _, s in vocab)
    vocab = [(t, s if not re.fullmatch("<0x..>", t) else low) for t, s in vocab]
    lib = tokenizers.Tokenizer(tokenizers.models.Unigram([("<unk>", 0.0), *vocab], unk_id=0, byte_fallback=True))
    c = tc.Counter(m)
    rng = random.Random(3)
    for _ in range(300):
        t = "".join(rng.choice(["the ", "internation", "é", "中", "🦄", "\n", "x", "ing ", "  ", "12"]) for _ in range(rng.randrange(20)))
        assert c.count(t)[0] == len(lib.encode((MARK if t else "") + t.replace(" ", MARK)).ids), repr(t)


def test_documents(docs, corpus, no_docs):
    from moodgauge.llm.sentencepiece_codec import read_model
    got = sorted((r.doc_id or -1, r.n_tokens, r.score) for r in tc.token_counts(docs, MODEL).collect())
    c = tc.Counter(read_model(MODEL))
    assert got == sorted((i or -1, *c.count(t)) for i, t in corpus)
    assert c.count(None) == c.count("") == (0, 0.0)
    assert tc.token_counts(no_docs, MODEL).count() == 0
    assert c.count(prose(random.Random(1), 5))[0] >= 5
