import hashlib
import random

import pytest

from graphloom.llm import bpe
from graphloom.llm.queries import vocabulary

SCHEMA = "doc_id long, text string, hash string, copy long, k int"


def brute(text):
    coder = bpe.encoder(*vocabulary())
    ids = coder.encode_ordinary(text or "")
    return len(ids), hashlib.sha256(bpe.packed(ids)).hexdigest(), hashlib.sha256((text or "").encode()).hexdigest()


def long_text(seed, n):
    rng = random.Random(seed)
    words = ["the", "été", "x", "don't", "12345", "<|endoftext|>", "  ", "\n", "\t\n ", "日本語", "👍🏽", "...", "aaaaaaaa", "'s", " '"]
    return "".join(rng.choice(words) + rng.choice(["", " ", " ", "\n"]) for _ in range(n))


def test_whole_texts_equal_the_library(spark):
    texts = [None, "", "a", " ", "é" * 2000, " " * 1500, "word " * 500, *(long_text(s, n) for s, n in enumerate((5, 80, 400, 1500)))]
    rows = [(i, t, "h", 1, 2) for i, t in enumerate(texts)]
    rows += [rows[-1], rows[-1], (rows[-1][0], rows[-2][1], None, None, None), (None, texts[-1], None, 3, 4)]
    got = bpe.encode(spark.createDataFrame(rows, SCHEMA), *vocabulary(), chunk=300, overlap=60).collect()
    expect = sorted((str(i), *brute(t)) for i, t, *_ in rows)
    assert sorted((str(r.doc_id), r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in got) == expect
    decoded = bpe.decode(spark.createDataFrame(got, bpe.OUT), *vocabulary()).collect()
    assert sorted(bytes(r.raw).decode() for r in decoded) == sorted(t or "" for _, t, *_ in rows)


def test_empty_table(spark):
    assert bpe.encode(spark.createDataFrame([], SCHEMA), *vocabulary()).count() == 0


@pytest.mark.parametrize("seed", range(4))
def test_shared_starts_are_cuts(seed):
    """A place where pre-tokens of both neighbours begin splits the encoding."""
    text, coder = long_text(seed, 200), bpe.encoder(*vocabulary())
    whole = set(bpe.starts_in(text, 0, len(text), vocabulary()[1]))
    for cut in sorted(whole)[:: 7]:
        assert coder.encode_ordinary(text[:cut]) + coder.encode_ordinary(text[cut:]) == coder.encode_ordinary(text)
