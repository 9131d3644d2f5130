"""The property graph: nodes, edges, reviews and audit as DataFrames."""

from __future__ import annotations

from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .functions.text import attribute, clean_text, is_true

DECISIONS = ("accepted", "rejected", "unreviewed")
KINDS = ("node", "edge")
NODE_SCHEMA = "id string, label string, type string, ord long, attrs map<string,string>, sources array<string>"
EDGE_SCHEMA = "edge_id string, source string, target string, relation string, ord long, attrs map<string,string>, sources array<string>"
REVIEW_SCHEMA = "kind string, item_id string, decision string, reason string, analyst string, updated_at timestamp"
AUDIT_SCHEMA = "ts timestamp, ord long, action string, kind string, item_id string, previous string, next string, reason string, analyst string"


class GraphValidationError(ValueError):
    """An input that is no valid graph."""


def inferred_type(attrs: Column | str = "attrs") -> Column:
    """type or entity_type, else what stands before : in title, else Entity."""
    title = clean_text(attribute(attrs, "title"), "")
    before = F.when(F.contains(title, F.lit(":")), clean_text(F.substring_index(title, ":", 1), "Entity"))
    return F.coalesce(clean_text(attribute(attrs, "type", "entity_type"), None), before, F.lit("Entity"))


def identity(attrs: Column | str = "attrs") -> Column:
    """What makes an edge the same assertion: its ends and explicit id, else all its attributes but review fields."""
    explicit = clean_text(attribute(attrs, "assertion_id", "id", "key"), None)
    rest = F.map_filter(F.col(attrs) if isinstance(attrs, str) else attrs, lambda k, v: ~k.isin("id", "review_status", "review_reason"))
    canonical = F.to_json(F.array_sort(F.map_entries(rest)))
    ends = [F.col("source"), F.col("relation"), F.col("target")]
    return F.when(explicit.isNotNull(), F.to_json(F.struct(*ends, explicit.alias("explicit_id")))).otherwise(F.to_json(F.struct(*ends, canonical.alias("attributes"))))


def edge_ids(edges: DataFrame) -> DataFrame:
    """edges (source, target, relation, ord, attrs) with edge_id; exact repeats are numbered in order."""
    keyed = edges.withColumn("identity", identity())
    w = Window.partitionBy("identity").orderBy("ord")
    number = (F.row_number().over(w) - 1).cast("string")
    made = F.concat(F.lit("edge-"), F.substring(F.sha2(F.concat_ws("|", F.col("identity"), number), 256), 1, 16))
    return keyed.withColumn("edge_id", made)


@dataclass(frozen=True)
class Graph:
    """Nodes and edges with the overlay of reviews; meta holds name, directed and multigraph."""

    nodes: DataFrame
    edges: DataFrame
    reviews: DataFrame
    audit: DataFrame
    meta: dict = field(default_factory=lambda: {"name": "Graph", "directed": True, "multigraph": True})

    @property
    def spark(self) -> SparkSession:
        return self.nodes.sparkSession

    @staticmethod
    def of(nodes: DataFrame, edges: DataFrame, reviews: DataFrame | None = None, audit: DataFrame | None = None, **meta) -> Graph:
        """A graph of frames that have the columns of NODE_SCHEMA and EDGE_SCHEMA; attrs and sources may be missing."""
        spark = nodes.sparkSession
        none = {"attrs": "cast(map() as map<string,string>)", "sources": "cast(null as array<string>)", "type": "'Entity'"}
        for c in ("attrs", "sources", "type"):
            nodes = nodes if c in nodes.columns else nodes.withColumn(c, F.expr(none[c]))
            edges = edges if c in edges.columns or c == "type" else edges.withColumn(c, F.expr(none[c]))
        edges = edges if "edge_id" in edges.columns else edge_ids(edges)
        return Graph(nodes.select("id", "label", "type", "ord", "attrs", "sources"), edges.select("edge_id", "source", "target", "relation", "ord", "attrs", "sources"),
                     reviews if reviews is not None else spark.createDataFrame([], REVIEW_SCHEMA), audit if audit is not None else spark.createDataFrame([], AUDIT_SCHEMA), meta or {"name": "Graph"})

    def with_(self, **changes) -> Graph:
        return replace(self, **changes)

    def _status(self, items: DataFrame, kind: str, key: str) -> DataFrame:
        decided = self.reviews.where((F.col("kind") == kind) & F.col("decision").isin("accepted", "rejected")).select(F.col("item_id").alias(key), F.col("decision").alias("_decision"))
        host = is_true(F.element_at("attrs", "host_derived"))
        return items.join(decided, key, "left").withColumn("status", F.coalesce("_decision", F.when(host, "accepted").otherwise("unreviewed"))).drop("_decision")

    def node_status(self) -> DataFrame:
        """Nodes with status: the decision, else accepted for what the host made, else unreviewed."""
        return self._status(self.nodes, "node", "id")

    def edge_status(self) -> DataFrame:
        """Edges with status, likewise."""
        return self._status(self.edges, "edge", "edge_id")

    def barred(self, wanted: tuple[str, ...]) -> DataFrame:
        """(id) of the nodes that have none of the statuses: as a rule few, and from the reviews alone where only rejections bar."""
        if set(wanted) == {"accepted", "unreviewed"}:
            return self.reviews.where((F.col("kind") == "node") & (F.col("decision") == "rejected")).select(F.col("item_id").alias("id"))
        return self.node_status().where(~F.col("status").isin(*wanted)).select("id")

    def retained_edges(self, statuses: tuple[str, ...] = ("accepted", "unreviewed")) -> DataFrame:
        """Edges that, with both ends, have one of the statuses: two anti-joins with the barred nodes."""
        bad = self.barred(statuses)
        edges = self.edge_status().where(F.col("status").isin(*statuses))
        return edges.join(bad.toDF("source"), "source", "left_anti").join(bad.toDF("target"), "target", "left_anti")

    def adjacency(self, edges: DataFrame | None = None) -> DataFrame:
        """(node, neighbour, edge_id, relation, ord): each edge from both ends; a loop stands twice."""
        e = self.edges if edges is None else edges
        return (e.select(F.col("source").alias("node"), F.col("target").alias("neighbour"), "edge_id", "relation", "ord", F.lit(0).alias("side"))
                .union(e.select("target", "source", "edge_id", "relation", "ord", F.lit(1))))


def statuses(text: str | None, strict: bool = False) -> tuple[str, ...]:
    """A comma list of review statuses. Empty means all; unknown ones fall away, or raise if strict."""
    named = {p.strip().lower() for p in (text or "").split(",") if p.strip()}
    if strict and not named <= set(DECISIONS):
        raise ValueError(f"unknown review status: {', '.join(sorted(named - set(DECISIONS)))}")
    return tuple(d for d in DECISIONS if d in named) or DECISIONS
