import random

import numpy as np

from graphloom.llm import common, mixing
from graphloom.llm.common import Stash

SCHEMA = "doc_id long, text string, source string, size string, target long"


def brute_targets(totals):
    order = sorted((s for s in totals if s is not None), key=lambda s: s.encode()) + ([None] if None in totals else [])
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    target, free, left = {}, set(order), 1.5 * sum(totals.values())
    while free:
        level = left / sum(weight[s] for s in free)
        over = {s for s in free if weight[s] * level > 2 * totals[s]}
        if not over:
            target |= {s: weight[s] * level for s in free}
            break
        for s in over:
            target[s] = 2.0 * totals[s]
            left -= target[s]
        free -= over
    return target


def corpus(seed, n):
    rng = random.Random(seed)
    return [(i, None if rng.random() < 0.03 else " ".join(["w"] * int(rng.paretovariate(1.1) * 3)), rng.choice(["a", "b", "é", "Z", "z", None, "rare"][: 6 + (rng.random() < 0.05)]), "x", 1) for i in range(n)]


def test_targets_taken_and_reruns(spark):
    rows = corpus(2, 1500) + [(7000 + i, "same words here", "hot", None, None) for i in range(700)] + [(1, "w w", "a", None, None)] * 3
    df = spark.createDataFrame(rows, SCHEMA)
    got = mixing.mix(df).collect()
    assert len(got) == len(rows)
    source = {}
    for i, t, s, *_ in rows:
        source.setdefault(s, []).append(len((t or "").split()))
    totals = {s: sum(v) for s, v in source.items()}
    aim = brute_targets(totals)
    by_target = {}
    for r in got:
        assert 0 <= r.taken <= 2 * r.size and (r.size == 0 or r.taken % r.size == 0)
        by_target.setdefault((r.source_size, round(r.target, 6)), 0)
        by_target[r.source_size, round(r.target, 6)] += r.taken
    assert set(by_target) == {(totals[s], round(aim[s], 6)) for s in totals}
    for (_, target), taken in by_target.items():
        assert abs(taken - target) <= 3
    assert sorted(map(str, got)) == sorted(map(str, mixing.mix(df.repartition(7)).collect()))
    again = mixing.repeat(df)
    assert again.dtypes == df.dtypes
    assert abs(sum(len((r.text or "").split()) for r in again.collect()) - sum(r.taken for r in got)) <= 6


def bisected(size, count, target, most=2.0):
    """The rates by plain bisection of the tilt."""
    weight = size * count
    if weight.sum() == 0 or target >= most * weight.sum():
        return np.full(len(size), most if weight.sum() else 0.0)
    low, high = -1e4, 1e4
    for _ in range(300):
        tilt = (low + high) / 2
        rate = np.exp(np.minimum(tilt * size / size.max(), np.log(most)))
        low, high = (low, tilt) if weight @ rate > target else (tilt, high)
    return rate


def test_tilts_equal_bisection(spark):
    size, count = np.array([1.0, 5, 20, 400]), np.array([9.0, 4, 3, 1])
    targets = {"a": 1.0, "b": 50.0, "c": 489.0, "d": 600.0, "e": 900.0, "one": 7.0, "full": 964.0}
    rows = [(s, int(x), int(c)) for s in targets if s != "one" for x, c in zip(size, count, strict=True)] + [("one", 3, 4), ("empty", 0, 9)]
    histogram = spark.createDataFrame(rows, "stratum string, size long, c long")
    totals = {s: sum(x * c for q, x, c in rows if q == s) for s in [*targets, "empty"]}
    aims = spark.createDataFrame([(s, t, targets.get(s, 0.0)) for s, t in totals.items()], "stratum string, total long, target double")
    got = {r.stratum: r for r in mixing.tilts(histogram, aims, Stash(spark)).collect()}
    assert set(got) == set(targets)
    for s, target in targets.items():
        x, c = (size, count) if s != "one" else (np.array([3.0]), np.array([4.0]))
        rate = np.exp(np.minimum(got[s].tilt * x / got[s].scale, np.log(2)))
        assert np.allclose(rate, bisected(x, c, target), rtol=1e-6, atol=1e-12) and abs((rate * x * c).sum() - target) <= 1e-8 * max(target, 1)


def test_one_source_and_one_size(spark, monkeypatch):
    df = spark.createDataFrame([(i, "three words here", "hot", None, None) for i in range(4000)], SCHEMA)
    for most in (common.MOST_SENT, 0):
        monkeypatch.setattr(common, "MOST_SENT", most)
        got = mixing.mix(df).collect()
        assert sum(r.taken for r in got) == 18_000 and {r.taken for r in got} == {3, 6} and {r.target for r in got} == {18_000.0}
        assert mixing.repeat(df).count() == 6000


def test_empty_and_wordless_tables(spark):
    assert mixing.mix(spark.createDataFrame([], SCHEMA)).count() == 0
    got = mixing.mix(spark.createDataFrame([(1, "", "a", None, None), (2, None, None, None, None)], SCHEMA)).collect()
    assert [(r.size, r.target, r.taken) for r in got] == [(0, 0.0, 0)] * 2
    assert mixing.repeat(spark.createDataFrame([(1, "", "a", None, None)], SCHEMA)).count() == 0
