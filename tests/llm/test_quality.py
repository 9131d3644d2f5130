import random
import re

import pytest

from graphloom.llm import quality

SCHEMA = "doc_id long, text string, n_words long, kept string"


def brute(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    seen, dup_lines, dup_chars = set(), 0, 0
    for line in text.split("\n"):
        own = re.findall(r"[^\x20\x09-\x0D]+", line)
        if own and line in seen:
            dup_lines, dup_chars = dup_lines + 1, dup_chars + sum(map(len, own))
        seen.add(line)
    grams = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    inside = {i + d for i, g in enumerate(grams) if grams.count(g) > 1 for d in range(3)}
    chars, much = sum(map(len, words)), dup_chars / max(1, sum(map(len, words))) > quality.LINE_LIMIT
    for n, limit in quality.NGRAM_LIMITS.items():
        had, hit = set(), set()
        for i in range(len(words) - n + 1):
            g = tuple(words[i : i + n])
            hit |= set(range(i, i + n)) if g in had else set()
            had.add(g)
        much |= sum(len(words[i]) for i in hit) / max(1, chars) > limit
    failed = len(words) < 50 or 100 * len(inside) > 50 * len(words)
    return len(words), chars, sum(c in quality.SYMBOLS for c in text), dup_lines, len(inside), failed, not failed and not much


def texts():
    rng = random.Random(3)
    yield from (None, "", " \n\t", "one", "\n\none\none\n", "é é é\né é é\n", "#*$%&|<>", "a b a b", "x\n" * 80)
    for n in (3, 49, 50, 60, 120, 400):
        for size in (3, 30, 3000):
            yield "".join(f"{rng.randrange(size)}é#"[: rng.randrange(1, 6)] + rng.choice([" ", "\n", "  ", "\r\n"]) for _ in range(n))
    line = " ".join(f"w{i}" for i in range(9))
    for times in (1, 2, 3, 4):
        yield "\n".join([line] * times + [" ".join(f"v{i}" for i in range(60))])


def test_equals_brute_force(spark):
    rows = [(i, t, 7, "x") for i, t in enumerate(texts())] + [(None, "a b c", None, None), (1, "", None, None), (1, "", None, None)]
    got = quality.score(spark.createDataFrame(rows, SCHEMA)).collect()
    fields = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")
    assert sorted((str(r.doc_id), *(r[f] for f in fields)) for r in got) == sorted((str(i), *brute(t)) for i, t, *_ in rows)


def test_keep_returns_the_same_columns(spark):
    good = " ".join(f"w{i}" for i in range(60))
    df = spark.createDataFrame([(1, good, 5, "a"), (1, good, 5, "a"), (2, "x y " * 60, None, "b"), (3, None, None, None)], SCHEMA)
    out = quality.keep(df)
    assert out.dtypes == df.dtypes and [tuple(r) for r in out.collect()] == [(1, good, 5, "a")] * 2
    assert quality.keep(df.limit(0)).count() == 0


@pytest.mark.parametrize("times", [1, 2])
def test_a_very_long_text_is_measured_whole(times):
    import numpy as np

    text = (" ".join(f"w{i}" for i in range(150_000)) * times).encode()
    m = quality.measure(np.frombuffer(text, dtype=np.uint8), np.array([0, len(text)]))
    assert (m["n_repeat_words"][0] > 0) == (times == 2)
