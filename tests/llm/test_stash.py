import time

from graphloom.llm.common import Stash


def test_shuffle_files_go_when_a_table_is_kept(spark):
    manager = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
    shuffled = lambda: {f.getName() for f in (x for x in _items(manager.getAllFiles())) if f.getName().startswith("shuffle_")}
    before, stash = shuffled(), Stash(spark)
    stash.keep(spark.range(1000).selectExpr("id % 7 as k", "id").groupBy("k").agg({"id": "sum"}))
    for _ in range(50):
        if shuffled() <= before:
            break
        time.sleep(0.1)
    stash.leave()
    assert shuffled() <= before


def _items(sequence):
    it = sequence.iterator()
    while it.hasNext():
        yield it.next()
