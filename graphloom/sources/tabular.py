"""Tables as graphs: columns of lists, and nodes keyed by display names."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import clean_text
from ..model import Graph


def list_graph(table: DataFrame, subject: str, lists: dict[str, str], separator: str = r"\|", subject_type: str = "Entity") -> Graph:
    """A node per subject and per entry of its list columns, joined by the relation named for each column; lists maps columns to relations."""
    parts = [table.select(clean_text(subject, None).alias("source"), F.explode(F.split(F.col(c), separator)).alias("raw"), F.lit(r).alias("relation"), F.lit(c).alias("type")) for c, r in lists.items()]
    rows = parts[0]
    for p in parts[1:]:
        rows = rows.union(p)
    edges = rows.withColumn("target", clean_text("raw", None)).where("source is not null and target is not null").select("source", "target", "relation", "type").distinct()
    nodes = table.select(clean_text(subject, None).alias("id"), F.lit(subject_type).alias("type")).union(edges.select("target", "type")).where("id is not null").groupBy("id").agg(F.min("type").alias("type"))
    nodes = nodes.select("id", F.col("id").alias("label"), "type", F.xxhash64("id").alias("ord"))
    return Graph.of(nodes, edges.select("source", "target", "relation", F.xxhash64("source", "relation", "target").alias("ord")))


def read_csv(spark: SparkSession, path: str, subject: str, lists: dict[str, str], schema: str) -> Graph:
    return list_graph(spark.read.schema(schema).option("header", True).csv(path), subject, lists)


def display_nodes(records: DataFrame, keys: list[str]) -> tuple[DataFrame, DataFrame]:
    """records with display: the first of the keys that holds something; and one row with how many records have none."""
    named = records.withColumn("display", F.coalesce(*[clean_text(k, None) for k in keys]))
    return named.where("display is not null"), named.agg(F.count_if(F.col("display").isNull()).alias("nameless"))
