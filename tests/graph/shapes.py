"""Small literal graphs."""

from graphloom.model import Graph


def multigraph(spark):
    """Three nodes; two parallel edges and one more."""
    nodes = spark.createDataFrame([("alpha", "Alpha", "Organisation", 0), ("bravo", "Bravo", "Capability", 1), ("charlie", "Charlie", "Location", 2)], "id string, label string, type string, ord long")
    rows = [("a-1", "alpha", "bravo", "ENABLES", "Alpha enables Bravo."), ("a-2", "alpha", "bravo", "ENABLES", "A second source corroborates the relationship."), ("a-3", "bravo", "charlie", "LOCATED_AT", "Bravo is located at Charlie.")]
    edges = spark.createDataFrame([(s, t, r, i, {"assertion_id": a, "source_text": x}) for i, (a, s, t, r, x) in enumerate(rows)], "source string, target string, relation string, ord long, attrs map<string,string>")
    return Graph.of(nodes, edges)


def plain(spark, pairs, extra=()):
    ids = sorted({x for p in pairs for x in p} | set(extra))
    nodes = spark.createDataFrame([(i, i.upper(), "Entity", k) for k, i in enumerate(ids)], "id string, label string, type string, ord long")
    edges = spark.createDataFrame([(a, b, "LINKS", k) for k, (a, b) in enumerate(pairs)], "source string, target string, relation string, ord long")
    return Graph.of(nodes, edges)


def edge_id(graph, assertion):
    return graph.edges.where(f"attrs['assertion_id'] = '{assertion}'").first().edge_id
