import random
import re

import numpy as np
import pytest

from graphloom.llm import common, components, minhash

SCHEMA = "doc_id long, text string, n long, kept string"


def sets(text, k, lower):
    text = re.sub(r"[A-Z]", lambda m: m[0].lower(), text or "") if lower else text or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", text)
    return frozenset([tuple(w)] if 0 < len(w) < k else [tuple(w[i : i + k]) for i in range(len(w) - k + 1)])


def brute(rows, k, num, den, lower=True):
    ids = sorted({r[0] for r in rows if r[0] is not None})
    top = {i: i for i in ids}

    def find(i):
        while top[i] != i:
            i = top[i]
        return i

    own = [(i, sets(t, k, lower)) for i, t, *_ in rows if i is not None]
    for x, (i, s) in enumerate(own):
        for j, t in own[:x]:
            if s and t and den * len(s & t) >= num * len(s | t):
                a, b = sorted((find(i), find(j)))
                top[b] = a
    return sorted((str(i), len(sets(t, k, lower)), str(None if i is None else find(i)), i is None or find(i) == i) for i, t, *_ in rows)


def got(df):
    return sorted((str(r.doc_id), r.n_shingles, str(r.component_id), r.kept) for r in df.collect())


def corpus(seed, groups, size, changes):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdeéß") for _ in range(rng.randrange(1, 6)))
    i = 0
    for _ in range(groups):
        base = [word() for _ in range(rng.randrange(4, size))]
        for _ in range(rng.choice([1, 1, 2, 5, 30])):
            copy = list(base)
            for _ in range(rng.randrange(changes)):
                copy[rng.randrange(len(copy))] = word()
            yield (i * 37) % 100_003, " ".join(w.upper() if rng.random() < 0.01 else w for w in copy).replace("É", "é"), 1, "x"
            i += 1


@pytest.mark.parametrize(("k", "num", "den"), [(3, 85, 100), (5, 80, 100)])
def test_components_equal_brute_force(spark, k, num, den):
    rows = [*corpus(k, 45, 150, 5), *corpus(k + 9, 5, 30, 3)]
    rows = [(i, *r[1:]) for i, r in enumerate(rows)]
    rows += [(5000, None, None, None), (5001, "", None, None), (5002, " \n", None, None), (5003, "one", None, None), (5004, "ONE", None, None), (5005, "one two", None, None),
             (5006, rows[0][1], None, None), (0, rows[0][1], None, None), (1, rows[-1][1], None, None), (None, rows[2][1], None, None)]
    rows += [(6000 + i, "hot " * 9 + "copy", None, None) for i in range(200)]
    rows.append((7000, " ".join(f"w{i}" for i in range(30_000)), None, None))
    assert got(minhash.near_duplicates(spark.createDataFrame(rows, SCHEMA), k, num, den)) == brute(rows, k, num, den)


def test_a_large_group_of_pairwise_unlike_edits(spark, monkeypatch):
    """Many copies of one text, each far from most others, so that one pivot does not link them."""
    rng = random.Random(1)
    base = [f"w{i}" for i in range(120)]
    rows = []
    for i in range(300):
        copy = list(base)
        for at in rng.sample(range(120), rng.choice([1, 2, 3, 4])):
            copy[at] = f"x{i}-{at}"
        rows.append((i, " ".join(copy), None, None))
    monkeypatch.setattr(minhash, "BLOCK", 40)
    monkeypatch.setattr(minhash, "EXACT_BLOCK", 30)
    monkeypatch.setattr(minhash, "STAR", 16)
    assert got(minhash.near_duplicates(spark.createDataFrame(rows, SCHEMA), 3, 85, 100)) == brute(rows, 3, 85, 100)


def test_empty_table(spark):
    assert minhash.near_duplicates(spark.createDataFrame([], SCHEMA), 3, 85, 100).count() == 0


def test_estimates_and_merging():
    rng = np.random.default_rng(3)
    for share in (0.5, 0.8, 0.9):
        base = rng.integers(0, 1 << 54, 2000).astype(np.uint64)
        extra = rng.integers(0, 1 << 54, (2, int(1000 * (1 / share - 1)))).astype(np.uint64)
        a, b = np.unique(np.concatenate((base, extra[0]))), np.unique(np.concatenate((base, extra[1])))
        p, q = (minhash.registers(x, np.zeros(len(x), np.int64), 1) for x in (a, b))
        both = np.unique(np.concatenate((a, b)))
        true = (len(a) + len(b) - len(both)) / len(both)
        assert abs(minhash.estimate(p, q, np.array([float(len(a))]), np.array([float(len(b))]))[0] - true) < 4 * np.sqrt(true * (1 - true) / minhash.M)
        assert (np.maximum(p, q) == minhash.registers(both, np.zeros(len(both), np.int64), 1)).all()


def test_bands_miss_few():
    for t in (0.8, 0.85):
        r, bands = minhash.banding(t)
        assert r * bands <= minhash.M and (1 - t**r) ** bands <= minhash.MISS


@pytest.mark.parametrize("small", [0, 1000])
def test_components_of_paths_and_stars(spark, monkeypatch, small):
    monkeypatch.setattr(components, "SMALL", small)
    rng = random.Random(4)
    pairs = [(i, i + 1) for i in range(100, 160)] + [(500, i) for i in range(501, 600)] + [(7, 7)] + [(rng.randrange(1000, 1100), rng.randrange(1000, 1100)) for _ in range(70)]
    top = {}
    find = lambda i: i if top.get(i, i) == i else find(top[i])
    for a, b in pairs:
        a, b = sorted((find(a), find(b)))
        top[b] = a
    out = components.components(spark.createDataFrame(pairs, "a long, b long"), common.Stash(spark))
    assert sorted(map(tuple, out.collect())) == sorted((i, find(i)) for i in {x for p in pairs for x in p} if find(i) != i)
    assert components.components(spark.createDataFrame([], "a long, b long"), common.Stash(spark)).count() == 0
