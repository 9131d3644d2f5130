import __spark_entry__
from graphloom.streaming import decisions


def test_every_oracle_has_a_query_and_entry_runs(spark):
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
    assert __spark_entry__.entry(spark).columns == ["id", "label", "type", "degree", "status"]


def test_streams(spark, tmp_path):
    spark.sql("select 'x' item, 'rejected' decision, timestamp'2024-01-01 00:00:00' ts, 1L ord, 'click' event_type, 2.0d value union all select 'x', 'accepted', timestamp'2024-01-01 00:10:00', 2L, 'click', 3.0d").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("item string, decision string, ts timestamp, ord long, event_type string, value double").parquet(str(tmp_path / "in"))
    for name, df, mode in (("latest", decisions.latest_decisions(stream), "update"), ("activity", decisions.activity(stream), "complete")):
        q = df.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", str(tmp_path / name)).start()
        q.processAllAvailable()
        q.stop()
    assert [r.decision for r in spark.table("latest").collect()] == ["accepted"]
    assert [(r.n, r.total) for r in spark.table("activity").collect()] == [(2, 5.0)]
