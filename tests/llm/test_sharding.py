import hashlib
import random
import zlib
from collections import Counter, defaultdict

import pytest

from graphloom.llm import sharding

SCHEMA = "doc_id long, text string, source string, size int, shard string"


def brute(rows, shards=sharding.SHARDS):
    """Each row's (doc_id, size, crc, shard, slot): strata shuffled by digest, sorted by fractional rank, cut into equal stretches."""
    strata = defaultdict(list)
    for i, text, source, *_ in rows:
        raw = (text or "").encode()
        strata["1" if source is None else "0" + source].append((hashlib.md5(f"{sharding.SEED}:{'' if i is None else i}".encode()).hexdigest(), len(raw) + 1, zlib.crc32(raw), i))
    order = sorted(((k + 0.5) / len(own), stratum, *x[:3], str(x[3])) for stratum, own in strata.items() for k, x in enumerate(sorted(own, key=lambda x: (*x[:3], str(x[3])))))
    n, out, slots = len(order), [], Counter()
    for at, (_, _, _, size, crc, i) in enumerate(order):
        shard = at * shards // n
        out.append((i, size, crc, shard, slots[shard]))
        slots[shard] += 1
    return sorted(out)


def corpus(n, hot):
    rng = random.Random(n)
    rows = [(i, "word " * rng.randrange(9), rng.choice(["a", "b", "é", None]), 1, "x") for i in range(n)]
    return rows + [(10_000 + i, "same", "hot", None, None) for i in range(hot)]


@pytest.mark.parametrize("rows", [corpus(300, 0), corpus(90, 2000), corpus(5, 0), [(1, "x", "a", 1, "y")] * 20 + [(2, None, None, None, None), (3, "", "a", None, None), (None, "é" * 50_000, "b", 0, "z")]], ids=["mixed", "hot source", "fewer rows than shards", "repeats, nulls, long"])
def test_equals_brute_force(spark, rows):
    df = spark.createDataFrame(rows, SCHEMA).repartition(5)
    got = sharding.interleave(df).collect()
    assert sorted((str(r.doc_id), r.size, r.text_crc32, r.shard, r.slot) for r in got) == brute([(*r[:3],) for r in rows])
    counts = Counter(r.shard for r in got)
    assert max(counts.values()) - min(counts.get(s, 0) for s in range(8)) <= 1
    assert {r.law for r in got} == {"rows"} and {r.grown_shard for r in got} == {None}
    for shard, n in counts.items():
        assert sorted(r.slot for r in got if r.shard == shard) == list(range(n))


def test_shards_match_the_mixture(spark):
    rows = corpus(800, 1600)
    source = {r[0]: r[2] for r in rows}
    got = sharding.interleave(spark.createDataFrame(rows, SCHEMA)).collect()
    for s in set(source.values()):
        shares = Counter(r.shard for r in got if source[r.doc_id] == s)
        assert max(shares.values()) - min(shares.values()) <= 2


def test_empty_table(spark):
    assert sharding.interleave(spark.createDataFrame([], SCHEMA)).count() == 0
