"""GraphML through Spark's XML reader, one pass each for keys, nodes and edges."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import attribute, clean_text, coerce
from ..model import Graph, GraphValidationError, inferred_type

_DATA = "data array<struct<_key: string, _VALUE: string>>"
KEY = "_id string, `_attr.name` string, `_attr.type` string, _for string"
NODE = f"_id string, {_DATA}"
EDGE = f"_id string, _source string, _target string, {_DATA}"


def _scan(spark: SparkSession, path: str, tag: str, schema: str) -> DataFrame:
    return spark.read.format("xml").option("rowTag", tag).option("ignoreNamespace", True).schema(schema).load(path)


def _attributes(rows: DataFrame, keys: DataFrame) -> DataFrame:
    """attrs of rows (k, data): each value under its key's name, in its type's canonical text; empty values go."""
    d = rows.select("k", F.explode("data").alias("d")).select("k", F.col("d._key").alias("key"), F.col("d._VALUE").alias("value"))
    named = d.join(keys, "key", "left").withColumn("value", coerce("value", F.coalesce("type", F.lit("string")))).where("value is not null")
    got = named.groupBy("k").agg(F.map_from_entries(F.collect_list(F.struct(F.coalesce("name", "key").alias("n"), "value"))).alias("attrs"))
    return rows.drop("data").join(got, "k", "left").withColumn("attrs", F.coalesce("attrs", F.expr("cast(map() as map<string,string>)")))


def read(spark: SparkSession, path: str) -> Graph:
    """The graph of a GraphML file, whatever prefix its tags have. DOCTYPE and ENTITY are refused; edges with an unknown end are left out."""
    if not spark.read.text(path).where(F.upper("value").rlike("<!(DOCTYPE|ENTITY)")).isEmpty():
        raise GraphValidationError("DOCTYPE and ENTITY are not allowed")
    keys = _scan(spark, path, "key", KEY).select(F.col("_id").alias("key"), F.col("`_attr.name`").alias("name"), F.lower("`_attr.type`").alias("type")).dropDuplicates(["key"])
    n = _attributes(_scan(spark, path, "node", NODE).withColumn("k", F.monotonically_increasing_id()), keys)
    n = n.select(clean_text("_id", None).alias("id"), F.col("k").alias("ord"), "attrs").where("id is not null")
    nodes = n.withColumn("label", clean_text(attribute("attrs", "label", "name"), F.col("id"))).withColumn("type", inferred_type())
    e = _attributes(_scan(spark, path, "edge", EDGE).withColumn("k", F.monotonically_increasing_id()), keys)
    relation = clean_text(attribute("attrs", "type", "relation", "label", "predicate"), "RELATED_TO")
    edges = e.select(clean_text("_source", None).alias("source"), clean_text("_target", None).alias("target"), relation.alias("relation"), F.col("k").alias("ord"),
                     F.when(F.col("_id").isNotNull(), F.map_concat(F.map_filter("attrs", lambda k, v: k != "id"), F.create_map(F.lit("id"), F.col("_id")))).otherwise(F.col("attrs")).alias("attrs"))
    ids = nodes.select("id")
    edges = edges.join(ids.toDF("source"), "source", "left_semi").join(ids.toDF("target"), "target", "left_semi")
    return Graph.of(nodes, edges, name="GraphML")
