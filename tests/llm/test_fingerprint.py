import hashlib
import itertools
import random

import numpy as np
import pytest

from graphloom.llm import fingerprint

SCHEMA = "doc_id long, text string, b string, halo int"


MASK = (1 << 64) - 1


def mixed(x):
    x ^= x >> 30
    x = x * 0xBF58476D1CE4E5B9 & MASK
    x ^= x >> 27
    x = x * 0x94D049BB133111EB & MASK
    return x ^ x >> 31


def coin(x, left):
    """Twice the lowest bit in which x and left differ, plus x's value there."""
    low = 0
    while x >> low & 1 == left >> low & 1:
        low += 1
    return 2 * low + (x >> low & 1)


def scalar_level(names):
    """The phrases' names of one string, symbol by symbol."""
    symbols = []
    for name, run in itertools.groupby(names):
        n = len(list(run))
        symbols.append(name if n == 1 else mixed((name + n * 0x9E3779B97F4A7C15) & MASK))
    labels = [coin(x, symbols[i - 1] if i else ~x & MASK) for i, x in enumerate(symbols)]
    for _ in range(3):
        labels = [coin(x, labels[i - 1] if i else x ^ 1) for i, x in enumerate(labels)]
    starts = [i for i in range(len(symbols)) if i == 0 or i < len(symbols) - 1 and labels[i - 1] < labels[i] > labels[i + 1]]
    out = []
    for low, high in zip(starts, [*starts[1:], len(symbols)], strict=True):
        value = sum(mixed(x) * pow(0x9E3779B97F4A7C15, k, 1 << 64) for k, x in enumerate(symbols[low:high]))
        out.append(mixed((value + high - low) & MASK))
    return out


def scalar(text):
    """The fingerprint's names of levels 2, 3 and 4, and the string they make."""
    names, sets = [b + 1 for b in text.encode()], []
    if not names:
        return [[], [], []], ""
    for level in range(1, 5):
        names = scalar_level(names)
        if level > 1:
            sets.append(sorted({mixed(x) >> 24 for x in names})[:32])
    return sets, "-".join("".join(f"{x:010x}" for x in s) for s in sets)


def scalar_likeness(a, b):
    if not a[0] or not b[0]:
        return float(not a[0] and not b[0])
    shares = []
    for p, q in zip(a, b, strict=True):
        least = sorted({*p, *q})
        least = least[:32] if max(len(p), len(q)) == 32 else least
        shares.append(sum(x in p and x in q for x in least) / len(least))
    return sum(shares) / 3


def words(seed, n):
    rng = random.Random(seed)
    return " ".join(rng.choice(["été", "the", "of", "river", "and"]) + str(rng.randrange(50)) for _ in range(n))


def check(rows, got):
    order = sorted(rows, key=lambda r: (r[0] is None, -(r[0] or 0)))
    by = {r.doc_id: r for r in got}
    assert len(got) == len(rows)
    for k, (i, text, *_) in enumerate(order):
        text, after = text or "", order[(k + 1) % len(order)][1] or ""
        n = len(text) // 2
        edited = text[: len(text) - n] + after[:n]
        own, mine = by[i], [scalar(x) for x in (text, edited, after)]
        assert (own.n_chars, own.edited_sha256) == (len(text), hashlib.sha256(edited.encode()).hexdigest())
        assert (own.fingerprint, own.edited_fingerprint) == (mine[0][1], mine[1][1])
        assert (own.near_edited, own.near_next) == pytest.approx((scalar_likeness(mine[0][0], mine[1][0]), scalar_likeness(mine[0][0], mine[2][0])))


def test_next_documents_and_edits(spark):
    rows = [(7 * i % 331, words(i, i % 40 * 9), "x", 1) for i in range(330)] + [(None, "no id", None, None), (900, None, None, None), (901, "", None, None), (902, words(5, 4000), None, None)]
    df = spark.createDataFrame(rows, SCHEMA).repartition(5)
    check(rows, fingerprint.fingerprints(df, rows_per_bucket=16).collect())
    check(rows[:1], fingerprint.fingerprints(spark.createDataFrame(rows[:1], SCHEMA)).collect())
    assert fingerprint.fingerprints(df.limit(0)).count() == 0


def test_parsing_equals_the_scalar_one():
    rng = random.Random(3)
    texts = ["", "a", "ab", "aaaa", "é", "abab" * 50, "a" * 300 + "b"] + ["".join(rng.choice("ab \u65e5é") for _ in range(rng.randrange(400))) for _ in range(60)] + [words(i, 200) for i in range(5)]
    got = fingerprint.sketches([x.encode() for x in texts])
    for text, sketch in zip(texts, got, strict=True):
        assert ([x.tolist() for x in sketch], fingerprint.as_string(sketch)) == scalar(text)
    for (x, a), (y, b) in itertools.pairwise(zip(texts, got, strict=True)):
        assert fingerprint.likeness(a, b) == pytest.approx(scalar_likeness(scalar(x)[0], scalar(y)[0]))


def test_repeated_rows(spark):
    rows = [(1, "one text", None, None)] * 5 + [(1, "another", None, None), (2, "two", None, None)]
    got = fingerprint.fingerprints(spark.createDataFrame(rows, SCHEMA), rows_per_bucket=1).collect()
    assert len(got) == 7 and len({r.fingerprint for r in got if r.n_chars == 8}) == 1


def test_equal_substrings_share_interior_names_at_any_offset():
    inner = words(1, 900).encode()
    names = []
    for shift in (0, 1, 7, 30):
        level = np.frombuffer(words(shift + 50, 5).encode()[: 3 + shift] + inner, dtype=np.uint8).astype(np.uint64) + np.uint64(1)
        first = np.array([0])
        for _ in range(3):
            level, first = fingerprint.next_level(level, first)
        names.append(level.tolist())
    tail = names[0][4:-2]
    for other in names[1:]:
        assert "/".join(map(str, tail)) in "/".join(map(str, other))


def test_runs_and_copies():
    a, b, c = fingerprint.sketches([b"a" * 5000, b"a" * 5000, b"a" * 5001])
    assert fingerprint.as_string(a) == fingerprint.as_string(b) != fingerprint.as_string(c)
    text = words(9, 600)
    near = fingerprint.sketches([text.encode(), text.replace("river7", "lake").encode(), words(10, 600).encode()])
    assert fingerprint.likeness(near[0], near[0]) == 1 and fingerprint.likeness(near[0], near[1]) > 0.6 and fingerprint.likeness(near[0], near[2]) < 0.1
