"""Node-link JSON: {directed, multigraph, graph, nodes, links or edges}."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..model import Graph
from ..operators.validate import clean_edges, clean_nodes, strip_managed, validated


def _text(v):
    """A variant as text: strings bare, everything else as JSON."""
    return F.coalesce(F.try_variant_get(v, "$", "string"), F.to_json(v))


def _records(doc: DataFrame, *paths: str) -> DataFrame:
    """(ord, attrs, sources) of the objects in the first of the arrays that is there."""
    first = F.coalesce(*[F.try_variant_get("v", f"$.{p}", "array<variant>") for p in paths])
    rows = doc.select(F.posexplode(first).alias("k", "r"))
    fields = F.try_variant_get("r", "$", "map<string,variant>")
    attrs = F.map_filter(F.transform_values(fields, lambda k, v: F.when(k.isin("source", "target") & F.try_variant_get(v, "$.id", "string").isNotNull(), F.try_variant_get(v, "$.id", "string")).otherwise(_text(v))), lambda k, v: v.isNotNull())
    return rows.select(F.col("k").cast("long").alias("ord"), attrs.alias("attrs"), F.try_variant_get("r", "$.sources", "array<string>").alias("sources"))


def parse(texts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Cleaned nodes and edges of one document in a column value."""
    doc = texts.select(F.try_parse_json("value").alias("v"))
    nodes = clean_nodes(_records(doc, "nodes"))
    raw = _records(doc, "links", "edges").withColumn("source", F.element_at("attrs", "source")).withColumn("target", F.element_at("attrs", "target"))
    return nodes, clean_edges(raw)


def read(spark: SparkSession, path: str) -> Graph:
    """The validated graph of one file; other files may be read side by side and merged."""
    texts = spark.read.text(path, wholetext=True)
    meta = texts.select(F.try_parse_json("value").alias("v")).select(F.try_variant_get("v", "$.graph.name", "string").alias("name"), F.coalesce(F.try_variant_get("v", "$.directed", "boolean"), F.lit(True)).alias("directed"),
                                                                     F.coalesce(F.try_variant_get("v", "$.multigraph", "boolean"), F.lit(False)).alias("multigraph")).first()
    nodes, edges = parse(texts)
    return validated(nodes, edges, name=meta.name or "Graph", directed=meta.directed, multigraph=meta.multigraph)


def export(graph: Graph, include_review: bool = True, statuses: tuple[str, ...] | None = None) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges with review_status and review_reason; with statuses, an edge stays only if it and both its ends have one."""
    if statuses is not None and not set(statuses) <= {"accepted", "rejected", "unreviewed"}:
        raise ValueError("unknown review status")
    nodes, edges = graph.node_status(), graph.edge_status() if statuses is None else graph.retained_edges(statuses)
    if statuses is not None:
        nodes = nodes.where(F.col("status").isin(*statuses))
    reasons = graph.reviews.select("kind", "item_id", "reason")
    out = []
    for df, kind, key in ((nodes, "node", "id"), (edges, "edge", "edge_id")):
        df = df.withColumnRenamed("status", "review_status")
        df = df.join(reasons.where(F.col("kind") == kind).select(F.col("item_id").alias(key), F.col("reason").alias("review_reason")), key, "left")
        out.append(df if include_review else df.drop("review_status", "review_reason"))
    return out[0], out[1]


def write(graph: Graph, path: str, **options) -> None:
    """Line-delimited JSON under path/nodes and path/links.

    Both are written beside path first and take its place by renaming, so a reader never sees one without the other, and a write that fails leaves
    what was there.
    """
    nodes, edges = export(graph, **options)
    _replaced(graph.spark, path, {"nodes": nodes, "links": edges})


def _replaced(spark: SparkSession, path: str, tables: dict[str, DataFrame]) -> None:
    """Writes tables into a new folder, which then takes the place of those of the same names below path."""
    stage = f"{path.rstrip('/')}.{uuid.uuid4().hex}"
    for name, df in tables.items():
        df.write.json(f"{stage}/{name}")
    of = spark._jvm.org.apache.hadoop.fs.Path
    fs = of(stage).getFileSystem(spark._jsc.hadoopConfiguration())
    fs.mkdirs(of(path))
    for name in tables:
        if fs.exists(of(f"{path}/{name}")) and not fs.rename(of(f"{path}/{name}"), of(f"{stage}/{name}.old")):
            raise OSError(f"cannot set aside {path}/{name}")
    for name in tables:
        if not fs.rename(of(f"{stage}/{name}"), of(f"{path}/{name}")):
            raise OSError(f"cannot put {name} into {path}")
    fs.delete(of(stage), True)


def write_reviews(graph: Graph, path: str) -> None:
    """The decisions and their log, line by line, under path/reviews and path/audit."""
    _replaced(graph.spark, path, {"reviews": graph.reviews, "audit": graph.audit})


def backup(graph: Graph, path: str, stamp: str) -> str:
    """A copy under a stamped folder; returns the folder."""
    where = f"{path}/backups/{stamp}"
    write(graph, where)
    return where


__all__ = ["backup", "export", "parse", "read", "strip_managed", "write", "write_reviews"]
