"""The review overlay: decisions, their log, the queue and single items."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import attribute, clean_text, document_names, is_true
from ..model import DECISIONS, KINDS, Graph, statuses

#: Events of the log that stay.
AUDIT_KEPT = 100_000


def current_decisions(events: DataFrame) -> DataFrame:
    """The latest decision per (kind, item_id) of a log (kind, item_id, decision, ts, ord, …); unreviewed takes one back.

    max_by is aggregated before the shuffle, so items with very many events are no burden.
    """
    latest = events.groupBy("kind", "item_id").agg(F.max_by("decision", F.struct("ts", "ord")).alias("decision"), F.max("ts").alias("updated_at"))
    return latest.where(F.col("decision").isin("accepted", "rejected"))


def decide(graph: Graph, decisions: DataFrame) -> Graph:
    """Applies decisions (kind, item_id, decision, reason, analyst, ts, ord); raises for unknown values and bare rejections."""
    wrong = decisions.where(~F.col("decision").isin(*DECISIONS) | ~F.col("kind").isin(*KINDS) | ((F.col("decision") == "rejected") & clean_text("reason", None).isNull()))
    if wrong.limit(1).count():
        raise ValueError("a decision needs a known kind and value, and a rejection a reason")
    known = graph.nodes.select(F.lit("node").alias("kind"), F.col("id").alias("item_id")).union(graph.edges.select(F.lit("edge"), "edge_id"))
    if decisions.join(known, ["kind", "item_id"], "left_anti").limit(1).count():
        raise KeyError("a decision names an unknown item")
    old = graph.reviews.select("kind", "item_id", "decision", "reason", "analyst", F.col("updated_at").alias("ts"), F.lit(-1).cast("long").alias("ord"))
    new = decisions.select("kind", "item_id", "decision", "reason", "analyst", "ts", F.col("ord").cast("long"))
    what = F.struct("decision", "reason", "analyst", F.col("ts").alias("updated_at"))
    latest = old.withColumn("g", F.lit(0)).union(new.withColumn("g", F.lit(1))).groupBy("kind", "item_id").agg(F.max_by(what, F.struct("g", "ts", "ord")).alias("x")).select("kind", "item_id", "x.*")
    log = new.join(old.select("kind", "item_id", F.col("decision").alias("previous")), ["kind", "item_id"], "left").select(
        "ts", "ord", F.lit("review_decision").alias("action"), "kind", "item_id", F.coalesce("previous", F.lit("unreviewed")).alias("previous"), F.col("decision").alias("next"), "reason", "analyst")
    return graph.with_(reviews=latest.where("decision <> 'unreviewed'").select("kind", "item_id", "decision", "reason", "analyst", "updated_at"), audit=graph.audit.unionByName(log))


def audit(graph: Graph, limit: int = 50) -> DataFrame:
    """The newest events first, at most 500."""
    return graph.audit.orderBy(F.desc("ts"), F.desc("ord")).limit(max(1, min(limit, 500)))


def trimmed_audit(graph: Graph, kept: int = AUDIT_KEPT) -> DataFrame:
    """The newest events of the log; a log of any length is cut by one top-k."""
    return graph.audit.orderBy(F.desc("ts"), F.desc("ord")).limit(kept)


def sane_reviews(graph: Graph, raw: DataFrame) -> DataFrame:
    """Stored reviews (key 'kind:item', decision, …) without unknown kinds, items and values."""
    split = raw.where(F.contains("key", F.lit(":"))).withColumn("kind", F.substring_index("key", ":", 1)).withColumn("item_id", F.expr("substring(key, length(kind) + 2)"))
    known = graph.nodes.select(F.lit("node").alias("kind"), F.col("id").alias("item_id")).union(graph.edges.select(F.lit("edge"), "edge_id"))
    return split.withColumn("decision", F.lower(clean_text("decision"))).where(F.col("decision").isin("accepted", "rejected")).join(known, ["kind", "item_id"], "left_semi").drop("key")


def items(graph: Graph) -> DataFrame:
    """Nodes, then edges, in one shape: kind, item_id, label, type, status, ord, documents, attrs. Labels of edges name both ends."""
    n = graph.node_status()
    labels = graph.nodes.select("id", "label")
    e = (graph.edge_status().join(labels.toDF("source", "sl"), "source").join(labels.toDF("target", "tl"), "target")
         .select(F.lit("edge").alias("kind"), F.col("edge_id").alias("item_id"), F.concat_ws(" — ", "sl", "relation", "tl").alias("label"), F.col("relation").alias("type"), "status", "ord",
                 document_names("attrs", F.col("sources")).alias("documents"), "attrs"))
    return n.select(F.lit("node").alias("kind"), F.col("id").alias("item_id"), "label", "type", "status", "ord", document_names("attrs", F.col("sources")).alias("documents"), "attrs").union(e)


def in_document(documents: Column, name: str) -> Column:
    """Whether a list of documents holds a name, in any case."""
    wanted = " ".join(name.split()).lower()
    return F.exists(documents, lambda d: F.lower(d) == wanted)


def queue_matches(graph: Graph, kind: str = "all", status: str = "unreviewed", query: str = "", document: str = "") -> DataFrame:
    """All items that a review queue shows."""
    if kind not in ("all", *KINDS):
        raise ValueError("kind must be all, node or edge")
    out = items(graph).where(F.col("status").isin(*statuses(status, strict=True)))
    if kind != "all":
        out = out.where(F.col("kind") == kind)
    if document.strip():
        out = out.where(in_document(F.col("documents"), document))
    if query.strip():
        needle = " ".join(query.split()).lower()
        out = out.where(F.contains(F.lower(F.concat_ws(" ", "label", "type")), F.lit(needle)))
    return out


def review_queue(graph: Graph, kind: str = "all", status: str = "unreviewed", query: str = "", document: str = "", limit: int = 20, offset: int = 0) -> dict:
    """A page of the queue (a DataFrame in queue order), with total and has_more."""
    limit, offset = max(1, min(int(limit), 100)), max(0, int(offset))
    matches = queue_matches(graph, kind, status, query, document)
    total = matches.count()
    page = matches.orderBy(F.when(F.col("kind") == "node", 0).otherwise(1), "ord", "item_id").offset(offset).limit(limit)
    return {"items": page, "total": total, "offset": offset, "limit": limit, "has_more": offset + limit < total}


def evidence(attrs: str = "attrs", missing: str = "No source excerpt was supplied.") -> Column:
    """The first of a record's excerpt fields that is present."""
    return clean_text(attribute(attrs, "source_excerpt", "excerpt", "source_text", "title"), missing)


def node_details(graph: Graph, ids: DataFrame | None = None, shown: int = 20) -> DataFrame:
    """Per node: label, type, status, evidence, documents, retained degree and its first neighbours in edge order.

    ids (id) keeps to some nodes; the neighbour list is cut by a window before it is gathered, so hubs gather no more than shown.
    """
    nodes = graph.node_status()
    nodes = nodes if ids is None else nodes.join(ids.select("id").distinct(), "id", "left_semi")
    good = graph.node_status().where("status <> 'rejected'").select(F.col("id").alias("neighbour"), F.col("label").alias("neighbour_label"))
    adjacent = graph.adjacency(graph.edge_status().where("status <> 'rejected'"))
    adjacent = adjacent.join(nodes.select(F.col("id").alias("node")), "node", "left_semi").join(good, "neighbour")
    degree = adjacent.groupBy("node").agg(F.count("*").alias("degree"))
    w = Window.partitionBy("node").orderBy("ord", "edge_id", "side")
    row = F.struct(F.col("k"), F.col("neighbour").alias("id"), F.col("neighbour_label").alias("label"), "relation", "edge_id")
    firsts = adjacent.withColumn("k", F.row_number().over(w)).where(F.col("k") <= shown).groupBy("node").agg(F.sort_array(F.collect_list(row)).alias("neighbours"))
    return (nodes.join(degree.withColumnRenamed("node", "id"), "id", "left").join(firsts.withColumnRenamed("node", "id"), "id", "left")
            .select("id", "label", "type", "status", is_true(F.element_at("attrs", "host_derived")).alias("host_derived"), F.coalesce("degree", F.lit(0)).alias("degree"),
                    evidence().alias("evidence"), document_names("attrs", F.col("sources")).alias("documents"), "neighbours", "attrs", "ord"))


def edge_details(graph: Graph, ids: DataFrame | None = None) -> DataFrame:
    """Per edge: label from both ends, status, evidence, confidence, documents."""
    edges = graph.edge_status()
    edges = edges if ids is None else edges.join(ids.select("edge_id").distinct(), "edge_id", "left_semi")
    labels = graph.nodes.select("id", "label")
    return (edges.join(labels.toDF("source", "source_label"), "source").join(labels.toDF("target", "target_label"), "target")
            .select("edge_id", F.concat_ws(" — ", "source_label", "relation", "target_label").alias("label"), "source", "source_label", "relation", "target", "target_label", "status",
                    evidence().alias("evidence"), attribute("attrs", "relationshipConfidence", "confidence").alias("confidence"), document_names("attrs", F.col("sources")).alias("documents"), "ord"))
