import time

from graphloom.functions import lineage


def test_shuffle_files_go_when_a_table_is_cut(spark):
    manager = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()

    def shuffled():
        out, it = set(), manager.getAllFiles().iterator()
        while it.hasNext():
            name = it.next().getName()
            if name.startswith("shuffle_"):
                out.add(name)
        return out

    before = shuffled()
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    setting = spark.conf.get(key, None)
    got = lineage.cut(spark.range(1000).selectExpr("id % 7 as k", "id").groupBy("k").agg({"id": "sum"}))
    for _ in range(50):
        if shuffled() <= before:
            break
        time.sleep(0.1)
    assert shuffled() <= before and got.count() == 7 and spark.conf.get(key, None) == setting
    lineage.forget(got)
