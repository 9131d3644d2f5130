"""The test tables as a property graph, in Spark and in DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..model import Graph
from ..operators.review import current_decisions

#: Order of the node kinds: rows of a kind follow each other by key.
STEP = 10**12
KINDS = [("region", "r_regionkey", "r_name", "Region"), ("nation", "n_nationkey", "n_name", "Nation"), ("customer", "c_custkey", "c_name", "Customer"), ("supplier", "s_suppkey", "s_name", "Supplier"),
         ("part", "p_partkey", "p_name", "Part"), ("orders", "o_orderkey", None, "Order")]


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _node(kind: str, key: str) -> F:
    return F.concat(F.lit(f"{kind}:"), F.col(key).cast("string"))


def decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events as a log: an error rejects a customer, a signup accepts, anything else takes a decision back."""
    said = F.when(F.col("event_type") == "error", "rejected").when(F.col("event_type") == "signup", "accepted").otherwise("unreviewed")
    return read(spark, sf_dir, "events").select(F.lit("node").alias("kind"), _node("customer", "user_id").alias("item_id"), said.alias("decision"), "ts", F.col("event_id").alias("ord"))


def small_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges among regions, nations, customers and suppliers."""
    n, c, s = (read(spark, sf_dir, t) for t in ("nation", "customer", "supplier"))
    edge = lambda df, rel, a, b, key, step: df.select(F.concat(F.lit(f"{rel}:"), F.col(key).cast("string")).alias("edge_id") if rel != "IN_NATION" else F.concat(F.lit("IN_NATION:"), a).alias("edge_id"), a.alias("source"), b.alias("target"), F.lit(rel).alias("relation"), (F.col(key).cast("long") + step).alias("ord"))
    return (edge(n, "IN_REGION", _node("nation", "n_nationkey"), _node("region", "n_regionkey"), "n_nationkey", 0)
            .union(edge(c, "IN_NATION", _node("customer", "c_custkey"), _node("nation", "c_nationkey"), "c_custkey", STEP))
            .union(edge(s, "IN_NATION", _node("supplier", "s_suppkey"), _node("nation", "s_nationkey"), "s_suppkey", 2 * STEP)))


def graph(spark: SparkSession, sf_dir: str, orders: bool = True, lines: bool = True) -> Graph:
    """The business graph; without orders and lines, only who lives where."""
    nodes, edges = None, small_edges(spark, sf_dir)
    for k, (kind, key, label, name) in enumerate(KINDS):
        if kind in ("part", "orders") and not (lines if kind == "part" else orders):
            continue
        part = read(spark, sf_dir, kind).select(_node(kind, key).alias("id"), (F.col(label) if label else F.concat(F.lit("Order "), F.col(key).cast("string"))).alias("label"), F.lit(name).alias("type"), (F.col(key).cast("long") + k * STEP).alias("ord"))
        nodes = part if nodes is None else nodes.union(part)
    reviews = current_decisions(decisions(spark, sf_dir)).select("kind", "item_id", "decision", F.lit(None).cast("string").alias("reason"), F.lit(None).cast("string").alias("analyst"), "updated_at")
    if orders:
        o = read(spark, sf_dir, "orders")
        placed = F.concat(F.lit("PLACED:"), F.col("o_orderkey").cast("string"))
        edges = edges.union(o.select(placed, _node("customer", "o_custkey"), _node("orders", "o_orderkey"), F.lit("PLACED"), F.col("o_orderkey") + 3 * STEP))
        said = F.when(F.col("o_orderpriority") == "1-URGENT", "rejected").when(F.col("o_orderstatus") == "F", "accepted")
        reviews = reviews.union(o.select(F.lit("edge"), placed, said, F.lit(None), F.lit(None), F.col("o_orderdate").cast("timestamp")).where(said.isNotNull()))
    if lines:
        x = read(spark, sf_dir, "lineitem").withColumn("n", F.concat_ws("-", F.col("l_orderkey").cast("string"), F.col("l_linenumber").cast("string"), F.col("l_partkey").cast("string"), F.col("l_suppkey").cast("string")))
        at = F.col("l_orderkey") * 8 + F.col("l_linenumber")
        if orders:
            edges = edges.union(x.select(F.concat(F.lit("CONTAINS:"), "n"), _node("orders", "l_orderkey"), _node("part", "l_partkey"), F.lit("CONTAINS"), at + 4 * STEP))
        edges = edges.union(x.select(F.concat(F.lit("SUPPLIED_BY:"), "n"), _node("part", "l_partkey"), _node("supplier", "l_suppkey"), F.lit("SUPPLIED_BY"), at + 5 * STEP))
    return Graph.of(nodes, edges, reviews, name="Business")


def sql(orders: bool = True, lines: bool = True) -> str:
    """WITH clauses: nodes, edges, reviews, ns and es (with status), adj (both directions), kept (edges that with both ends are not rejected)."""
    nodes = [f"SELECT '{kind}:' || {key} AS id, {label or chr(39) + 'Order ' + chr(39) + ' || ' + key} AS label, '{name}' AS type, {key} + {k * STEP} AS ord FROM {kind}"
             for k, (kind, key, label, name) in enumerate(KINDS) if kind not in ("part", "orders") or (lines if kind == "part" else orders)]
    edges = ["SELECT 'IN_REGION:' || n_nationkey AS edge_id, 'nation:' || n_nationkey AS source, 'region:' || n_regionkey AS target, 'IN_REGION' AS relation, n_nationkey::BIGINT AS ord FROM nation",
             f"SELECT 'IN_NATION:customer:' || c_custkey, 'customer:' || c_custkey, 'nation:' || c_nationkey, 'IN_NATION', c_custkey + {STEP} FROM customer",
             f"SELECT 'IN_NATION:supplier:' || s_suppkey, 'supplier:' || s_suppkey, 'nation:' || s_nationkey, 'IN_NATION', s_suppkey + {2 * STEP} FROM supplier"]
    reviews = ["SELECT 'node' AS kind, 'customer:' || user_id AS item_id, CASE event_type WHEN 'error' THEN 'rejected' ELSE 'accepted' END AS decision FROM "
               "(SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS k FROM events) WHERE k = 1 AND event_type IN ('error', 'signup')"]
    if orders:
        edges.append(f"SELECT 'PLACED:' || o_orderkey, 'customer:' || o_custkey, 'orders:' || o_orderkey, 'PLACED', o_orderkey + {3 * STEP} FROM orders")
        reviews.append("SELECT 'edge', 'PLACED:' || o_orderkey, CASE WHEN o_orderpriority = '1-URGENT' THEN 'rejected' ELSE 'accepted' END FROM orders WHERE o_orderpriority = '1-URGENT' OR o_orderstatus = 'F'")
    if lines:
        n = "l_orderkey || '-' || l_linenumber || '-' || l_partkey || '-' || l_suppkey"
        if orders:
            edges.append(f"SELECT 'CONTAINS:' || {n}, 'orders:' || l_orderkey, 'part:' || l_partkey, 'CONTAINS', l_orderkey * 8 + l_linenumber + {4 * STEP} FROM lineitem")
        edges.append(f"SELECT 'SUPPLIED_BY:' || {n}, 'part:' || l_partkey, 'supplier:' || l_suppkey, 'SUPPLIED_BY', l_orderkey * 8 + l_linenumber + {5 * STEP} FROM lineitem")
    union = " UNION ALL ".join
    return f"""nodes AS ({union(nodes)}), edges AS ({union(edges)}), reviews AS ({union(reviews)}),
ns AS (SELECT n.*, coalesce(decision, 'unreviewed') AS status FROM nodes n LEFT JOIN reviews r ON r.kind = 'node' AND r.item_id = n.id),
es AS (SELECT e.*, coalesce(decision, 'unreviewed') AS status FROM edges e LEFT JOIN reviews r ON r.kind = 'edge' AND r.item_id = e.edge_id),
kept AS (SELECT * FROM es WHERE status <> 'rejected' AND source IN (SELECT id FROM ns WHERE status <> 'rejected') AND target IN (SELECT id FROM ns WHERE status <> 'rejected')),
adj AS (SELECT source AS node, target AS neighbour, edge_id, relation, ord, status, 0 AS side FROM es UNION ALL SELECT target, source, edge_id, relation, ord, status, 1 FROM es),
kadj AS (SELECT source AS node, target AS neighbour, edge_id, relation, ord, 0 AS side FROM kept UNION ALL SELECT target, source, edge_id, relation, ord, 1 FROM kept)"""
