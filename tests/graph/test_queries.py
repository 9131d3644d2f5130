from pyspark.sql import functions as F

from graphloom.plans.queries import QUERIES
from graphloom.plans.tables import graph


def test_triples_come_from_whole_texts(spark, tmp_path):
    text = " ".join(f"w{i}" for i in range(40))
    spark.createDataFrame([(1, text), (2, None), (3, "one"), (4, "")], "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = {(r.doc_id, r.subject, r.predicate, r.object) for r in QUERIES["x4_filtered"](spark, str(tmp_path)).collect()}
    kind = lambda i: "word" if i % 10 == 0 else "unknown"
    assert got == {(1, f"w{i}", "instance_of", kind(i)) for i in range(0, 40, 5)} | {(1, f"w{i}", "FOLLOWED_BY", f"w{i + 1}") for i in range(39)} | {(3, "one", "instance_of", "word")}
    assert QUERIES["x13_assertions"](spark, str(tmp_path)).count() > 1


def test_component_share_covers_the_whole_graph(spark):
    d = "/root/testdata/sf0.001"
    g = graph(spark, d)
    kinds = {r.k: r.n for r in QUERIES["g15_component_share"](spark, d).groupBy(F.expr("split(id, ':')[0]").alias("k")).agg(F.count("*").alias("n")).collect()}
    assert kinds["orders"] == g.nodes.where("type = 'Order'").count() and kinds["part"] == g.nodes.where("type = 'Part'").count()
