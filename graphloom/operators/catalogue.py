"""The catalogue of metrics, and observations that keep what is unavailable apart from zero."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import band, capped

#: (method, family, cap by which a value is brought to 0..1, or none; what it measures)
METHODS = [
    ("centrality.typed_weighted_degree", "centrality", 24.0, "edges of a node, weighted by relation"),
    ("centrality.local_reach", "centrality", 60.0, "other nodes within two edges"),
    ("centrality.pagerank", "centrality", 0.03, "stationary rank of a random walk along edges"),
    ("centrality.personalized_pagerank", "centrality", 0.08, "the same with a restart at stated nodes"),
    ("centrality.harmonic_proximity", "centrality", 1.0, "mean reciprocal distance to the other nodes"),
    ("centrality.betweenness_structural", "centrality", 1.0, "share of shortest paths through a node"),
    ("centrality.core_membership", "centrality", None, "core number"),
    ("functional.role", "functional", 12.0, "distinct directed relation roles"),
    ("structure.component_reach", "structure", 1.0, "share of the other nodes in the component"),
    ("structure.path_diversity", "structure", 1.0, "share of the component reached without a bridge"),
    ("structure.participation", "structure", 1.0, "spread of edges over relation groups"),
]
#: Families that need what a graph does not hold, with the reason.
UNAVAILABLE = [("evidence", "missing_source_appraisal"), ("temporal", "missing_snapshot_history"), ("community", "missing_community_assignment")]


def catalogue(spark: SparkSession) -> DataFrame:
    """(method, family, available, reason, description)."""
    rows = [(m, f, True, None, d) for m, f, _, d in METHODS] + [(f"{f}.all", f, False, r, None) for f, r in UNAVAILABLE]
    return spark.createDataFrame(rows, "method string, family string, available boolean, reason string, description string")


def observations(values: DataFrame, method: str, column: str, key: str = "id") -> DataFrame:
    """(id, method, applicability, raw_value, normalised_value, band, reason): a null value is unavailable, never zero."""
    cap = {m: c for m, _, c, _ in METHODS}[method]
    raw = F.col(column).cast("double")
    normal = capped(raw, cap) if cap else F.lit(None).cast("double")
    there = raw.isNotNull()
    return values.select(key, F.lit(method).alias("method"), F.when(there, "available").otherwise("unavailable").alias("applicability"), raw.alias("raw_value"), F.when(there, normal).alias("normalised_value"),
                         F.when(there, band(normal)).alias("band"), F.when(~there, "missing_input").alias("reason"))
