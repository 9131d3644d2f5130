import random

from graphloom.operators import search

from . import shapes


def test_nearest_answers_every_query_of_several_blocks(spark, monkeypatch):
    monkeypatch.setattr(search, "QUERY_BLOCK", 2, raising=False)
    vectors = spark.createDataFrame([(i, [float(i), 1.0]) for i in range(20)], "vec_id long, embedding array<float>")
    queries = spark.createDataFrame([(i, [i + 0.25, 1.0]) for i in range(7)], "query_id long, embedding array<float>")
    got = sorted((r.query_id, r.k, r.vec_id) for r in search.nearest(queries, vectors, k=2).collect())
    assert got == sorted(x for i in range(7) for x in ((i, 1, i), (i, 2, i + 1)))


def test_nearest_answers_more_queries_than_a_block_holds(spark):
    vectors = spark.createDataFrame([(0, [0.0]), (1, [9.0])], "vec_id long, embedding array<float>")
    queries = spark.range(4100).selectExpr("id as query_id", "array(float(id % 2 * 9)) as embedding")
    got = search.nearest(queries, vectors, k=1)
    assert got.count() == 4100 and got.where("vec_id <> query_id % 2").count() == 0


def test_more_names_than_a_block_holds(spark):
    g = shapes.plain(spark, [(f"n{i:04d}", f"n{i + 1:04d}") for i in range(0, 2200, 2)])
    names = spark.range(2300).selectExpr("concat('N', lpad(id, 4, '0')) as value")
    got = {r.value: r.id for r in search.resolve_nodes(g, names).collect()}
    assert got == {f"N{i:04d}": f"n{i:04d}" for i in range(2200)}
    texts = spark.range(1500).selectExpr("id as key", "concat('about N', lpad(id, 4, '0'), ' and no other') as text")
    assert {r.key: r.id for r in search.mentioned(g, texts).collect()} == {i: f"n{i:04d}" for i in range(1500)}
    relations = spark.range(1200).selectExpr("concat(if(id % 2 = 0, 'links', 'other'), repeat(' ', id)) as value")
    got = search.resolve_relations(g, relations).collect()
    assert len(got) == 600 and {r.relation for r in got} == {"LINKS"}


def ratio(a, b):
    """Likeness of sorted words by the longest common subsequence, from the whole table."""
    a, b = (" ".join(sorted(x.lower().split())) for x in (a, b))
    row = [0] * (len(b) + 1)
    for x in a:
        last = row[:]
        for j, y in enumerate(b, 1):
            row[j] = last[j - 1] + 1 if x == y else max(last[j], row[j - 1])
    return 200 * row[-1] / (len(a) + len(b)) if a or b else 100.0


def test_likest_names_equal_brute_force(spark):
    rng = random.Random(8)
    labels = ["".join(rng.choice("abcdé 1") for _ in range(rng.randrange(3, 12))) for _ in range(60)]
    nodes = spark.createDataFrame([(f"id{k}", x, "T", k) for k, x in enumerate(labels)], "id string, label string, type string, ord long")
    g = shapes.Graph.of(nodes, spark.createDataFrame([], "source string, target string, relation string, ord long"))
    wanted = ["".join(rng.choice("abcdé 1") for _ in range(rng.randrange(3, 12))) for _ in range(40)]
    got = {r.value: r.id for r in search.resolve_nodes(g, spark.createDataFrame([(x,) for x in wanted], "value string"), fuzzy=True).collect()}
    for value in wanted:
        low = " ".join(value.lower().split())
        direct = [k for k, x in enumerate(labels) if low and low in x.lower()]
        if direct or len(low) < 3:
            continue
        best = max((ratio(low, x), -k) for k, x in enumerate(labels))
        assert got.get(value) == (f"id{-best[1]}" if best[0] >= 70 else None)
