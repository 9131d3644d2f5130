"""Validation, cleaning and imports of graphs."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import attribute, clean_text
from ..model import Graph, GraphValidationError, edge_ids, identity, inferred_type

MANAGED = ("review_status", "review_reason")


def clean_nodes(raw: DataFrame) -> DataFrame:
    """Nodes of raw records (ord, attrs, sources): id from id, name or label; label from label, name or the id."""
    node_id = clean_text(attribute("attrs", "id", "name", "label"), None)
    label = clean_text(attribute("attrs", "label", "name"), F.col("id"))
    return raw.withColumn("id", node_id).withColumn("label", label).withColumn("type", inferred_type()).select("id", "label", "type", "ord", "attrs", "sources")


def clean_edges(raw: DataFrame) -> DataFrame:
    """Edges of raw records (ord, source, target, attrs, sources): relation from relation, label or predicate, else RELATED_TO."""
    relation = clean_text(attribute("attrs", "relation", "label", "predicate"), "RELATED_TO")
    return raw.select(clean_text("source", None).alias("source"), clean_text("target", None).alias("target"), relation.alias("relation"), "ord", "attrs", "sources")


def problems(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(problem, item): nodes without id, ids that occur twice, edges with an unknown end."""
    nameless = nodes.where("id is null").select(F.lit("missing id").alias("problem"), F.col("ord").cast("string").alias("item"))
    twice = nodes.where("id is not null").groupBy("id").agg(F.count("*").alias("n")).where("n > 1").select(F.lit("duplicate id").alias("problem"), F.col("id").alias("item"))
    known = nodes.select(F.col("id").alias("end")).distinct()
    ends = edges.select("ord", F.explode(F.array("source", "target")).alias("end"))
    loose = ends.join(known, "end", "left_anti").select("ord").distinct().select(F.lit("unknown endpoint").alias("problem"), F.col("ord").cast("string").alias("item"))
    return nameless.union(twice).union(loose)


def validated(nodes: DataFrame, edges: DataFrame, **meta) -> Graph:
    """The graph of cleaned records; raises GraphValidationError on the first problems found."""
    bad = problems(nodes, edges).limit(5).collect()
    if bad:
        raise GraphValidationError("; ".join(f"{r.problem}: {r.item}" for r in bad))
    return Graph.of(nodes, edges, **meta)


def strip_managed(records: DataFrame, allow_host_derived: bool = False) -> DataFrame:
    """Records without fields that an import may not assert."""
    gone = MANAGED if allow_host_derived else (*MANAGED, "host_derived")
    return records.withColumn("attrs", F.map_filter("attrs", lambda k, v: ~k.isin(*gone)))


def _payload():
    return F.xxhash64(F.col("label"), F.to_json(F.array_sort(F.map_entries(F.coalesce("attrs", F.expr("cast(map() as map<string,string>)"))))), F.to_json("sources"))


def replace_graph(graph: Graph, new: Graph, allow_host_derived: bool = False) -> Graph:
    """The new graph without reviews: decisions belong to the graph that goes."""
    empty = graph.reviews.limit(0)
    return Graph.of(strip_managed(new.nodes, allow_host_derived), edge_ids(strip_managed(new.edges, allow_host_derived).drop("edge_id")), empty, graph.audit, **new.meta)


def merge_graph(graph: Graph, new: Graph, allow_host_derived: bool = False) -> Graph:
    """Nodes by id, the new one wins in the old one's place; edges whose identity is new; a changed node loses its review.

    One window over the ids of both sides and one over edge identities; the order of first sight stays.
    """
    old_n, new_n = graph.nodes.withColumn("g", F.lit(0)), strip_managed(new.nodes, allow_host_derived).withColumn("g", F.lit(1))
    by_id = Window.partitionBy("id")
    both = (old_n.unionByName(new_n).withColumn("hash", _payload())
            .withColumn("first", F.min(F.struct("g", "ord")).over(by_id)).withColumn("rank", F.row_number().over(by_id.orderBy(F.desc("g"), F.desc("ord"))))
            .withColumn("changed", F.min("hash").over(by_id) != F.max("hash").over(by_id)))
    top = graph.nodes.agg(F.coalesce(F.max("ord") + 1, F.lit(0)).alias("shift_n"))
    nodes = both.where("rank = 1").crossJoin(F.broadcast(top)).withColumn("ord", F.col("first.ord") + F.col("first.g") * F.col("shift_n"))
    changed = nodes.where("changed").select(F.col("id").alias("item_id"), F.lit("node").alias("kind"))
    reviews = graph.reviews.join(changed, ["kind", "item_id"], "left_anti")
    top_e = graph.edges.agg(F.coalesce(F.max("ord") + 1, F.lit(0)).alias("shift_e"))
    old_e = graph.edges.drop("edge_id").withColumn("g", F.lit(0)).withColumn("identity", identity())
    new_e = strip_managed(new.edges, allow_host_derived).drop("edge_id").withColumn("g", F.lit(1)).withColumn("identity", identity())
    w = Window.partitionBy("identity").orderBy("ord")
    fresh = new_e.join(old_e.select("identity").distinct(), "identity", "left_anti").withColumn("k", F.row_number().over(w)).where("k = 1").drop("k")
    fresh = fresh.crossJoin(F.broadcast(top_e)).withColumn("ord", F.col("ord") + F.col("shift_e")).drop("shift_e")
    edges = edge_ids(old_e.unionByName(fresh).drop("identity", "g"))
    invalid = graph.reviews.join(changed, ["kind", "item_id"]).select(
        F.current_timestamp().alias("ts"), F.xxhash64("item_id").alias("ord"), F.lit("review_invalidated").alias("action"), "kind", "item_id", F.col("decision").alias("previous"),
        F.lit("unreviewed").alias("next"), F.lit("The record changed in a merge.").alias("reason"), F.lit("system").alias("analyst"))
    return Graph.of(nodes.select("id", "label", "type", "ord", "attrs", "sources"), edges, reviews, graph.audit.unionByName(invalid), **graph.meta)
