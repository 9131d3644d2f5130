"""Analytic projections: what a metric is computed on."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..model import Graph

#: Fixed values that mark a prediction.
PREDICTIONS = ("PREDICTION", "MODEL_PREDICTED", "MODEL_GENERATED_HYPOTHESIS")
PREDICTION_KEYS = ("record_kind", "modality", "epistemic_state", "type")


def is_prediction(attrs: str = "attrs") -> Column:
    """Whether one of four attributes marks the record as a model's prediction."""
    out = F.lit(False)
    for key in PREDICTION_KEYS:
        out = out | F.coalesce(F.upper(F.trim(F.element_at(attrs, key))).isin(*PREDICTIONS), F.lit(False))
    return out


@dataclass(frozen=True)
class Projection:
    """nodes (id, type, status) and fused edges (id, source, target, relation, polarity, valid, assertion_ids).

    pairs has (source, target) of the records before they are fused, for metrics that only ask who is linked with whom.
    """

    nodes: DataFrame
    edges: DataFrame
    statuses: tuple[str, ...]
    pairs: DataFrame | None = None

    def links(self) -> DataFrame:
        """(source, target), a pair perhaps more than once."""
        return (self.edges if self.pairs is None else self.pairs).select("source", "target")

    def neighbours(self) -> DataFrame:
        """Distinct undirected (node, neighbour); a loop stands once."""
        e = self.links()
        return e.toDF("node", "neighbour").union(e.select("target", "source")).distinct()

    def out_neighbours(self) -> DataFrame:
        """Distinct directed (node, neighbour)."""
        return self.links().toDF("node", "neighbour").distinct()

    def incident(self) -> DataFrame:
        """(node, direction, relation, other, id): every edge at both ends; a loop stands twice."""
        e = self.edges
        return (e.select(F.col("source").alias("node"), F.lit("out").alias("direction"), "relation", F.col("target").alias("other"), "id")
                .union(e.select(F.col("target"), F.when(F.col("source") == F.col("target"), "out").otherwise("in"), "relation", F.col("source"), "id")))


def projection(graph: Graph, statuses: tuple[str, ...] = ("accepted", "unreviewed")) -> Projection:
    """Records of the given statuses that are no predictions; parallel edges of one relation, polarity and validity are fused.

    A fused edge keeps the attributes of its first record and the ids of all, in order. What is left out is anti-joined from both ends before
    the one aggregation, which is keyed by the whole edge, so no hub meets in one task.
    """
    nodes = graph.node_status().where(F.col("status").isin(*statuses) & ~is_prediction())
    bad = graph.barred(statuses).union(graph.nodes.where(is_prediction()).select("id")).distinct()
    edges = graph.edge_status().where(F.col("status").isin(*statuses) & ~is_prediction())
    edges = edges.join(bad.toDF("source"), "source", "left_anti").join(bad.toDF("target"), "target", "left_anti")
    own = F.coalesce(F.nullif(F.element_at("attrs", "assertion_id"), F.lit("")), F.nullif(F.element_at("attrs", "id"), F.lit("")), F.col("edge_id"))
    value = lambda k: F.coalesce(F.element_at("attrs", k), F.lit(""))
    keyed = edges.select("source", F.upper("relation").alias("relation"), "target", value("polarity").alias("polarity"), F.concat(value("valid_from"), F.lit("/"), value("valid_to")).alias("valid"), own.alias("own"), "ord")
    fused = keyed.groupBy("source", "relation", "target", "polarity", "valid").agg(F.sort_array(F.collect_list(F.struct("ord", "own"))).alias("all"))
    fused = fused.select(F.col("all")[0]["own"].alias("id"), "source", "target", "relation", "polarity", "valid", F.transform("all", lambda x: x["own"]).alias("assertion_ids"))
    return Projection(nodes.select("id", "type", "status"), fused, tuple(sorted(statuses)), edges.select("source", "target"))


def snapshot_id(p: Projection) -> str:
    """A digest of the projection that no order of input changes.

    Every record is digested on its own; the digests add up by count, sum and exclusive or over all records, so that the
    snapshot of a graph of any size needs no sorted list of it.
    """
    n = p.nodes.select(F.sha2(F.to_json(F.struct(F.lit("n").alias("k"), "id", "type", "status")), 256).alias("d"))
    e = p.edges.select(F.sha2(F.to_json(F.struct(F.lit("e").alias("k"), "source", "relation", "target", "polarity", "valid")), 256).alias("d"))
    words = [F.conv(F.substring("d", 1 + 15 * i, 15), 16, 10).cast("decimal(20,0)") for i in range(4)]
    sums = [F.sum(w).cast("string").alias(f"s{i}") for i, w in enumerate(words)]
    xors = [F.bit_xor(w.cast("long")).cast("string").alias(f"x{i}") for i, w in enumerate(words)]
    total = n.union(e).agg(F.count("*").cast("string").alias("c"), *sums, *xors)
    return total.select(F.sha2(F.concat_ws("|", F.lit(",".join(p.statuses)), *[F.coalesce(c, F.lit("")) for c in total.columns]), 256).alias("s")).first().s
