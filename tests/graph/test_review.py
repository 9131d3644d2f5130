import datetime

import pytest

from graphloom.model import Graph, GraphValidationError, statuses
from graphloom.operators import aggregate, review, validate
from graphloom.sources import graphml, node_link, text

from . import shapes

WHEN = datetime.datetime(2024, 1, 1)
DECISION = "kind string, item_id string, decision string, reason string, analyst string, ts timestamp, ord long"


def decide(graph, *rows):
    return review.decide(graph, graph.spark.createDataFrame([(k, i, d, r, "me", WHEN, n) for n, (k, i, d, r) in enumerate(rows)], DECISION))


def test_decisions_and_overlay(spark):
    g = shapes.multigraph(spark)
    a3 = shapes.edge_id(g, "a-3")
    h = decide(g, ("edge", a3, "accepted", None), ("edge", a3, "rejected", "wrong"), ("node", "alpha", "accepted", None), ("node", "alpha", "unreviewed", None))
    assert {r.id: r.status for r in h.node_status().collect()} == {"alpha": "unreviewed", "bravo": "unreviewed", "charlie": "unreviewed"}
    assert {r.edge_id for r in h.edge_status().where("status = 'rejected'").collect()} == {a3}
    bravo = review.node_details(h).where("id = 'bravo'").first()
    assert bravo.degree == 2 and {n.label for n in bravo.neighbours} == {"Alpha"}
    assert [r.next for r in review.audit(h, 10).collect()] == ["unreviewed", "accepted", "rejected", "accepted"]
    with pytest.raises(ValueError):
        decide(g, ("node", "alpha", "rejected", " "))
    with pytest.raises(KeyError):
        decide(g, ("node", "zulu", "accepted", None))
    assert aggregate.counts(h).first().asDict() == {"nodes": 3, "relationships": 3, "accepted": 0, "rejected": 1, "unreviewed": 5, "completion": 16.7}


def test_host_derived_records_need_no_review(spark):
    nodes = spark.createDataFrame([("d", "Doc", "Document", 0, {"host_derived": "True", "record_kind": "SOURCE_DOCUMENT", "source_document": "x.txt", "page_count": "12"}, None), ("m", "Men", "Mention", 1, {"source_document": "X.txt"}, ["x.txt", "y.txt"])],
                                  "id string, label string, type string, ord long, attrs map<string,string>, sources array<string>")
    g = Graph.of(nodes, spark.createDataFrame([("d", "m", "HAS", 0, {"host_derived": "true"})], "source string, target string, relation string, ord long, attrs map<string,string>"))
    assert [r.item_id for r in review.queue_matches(g).collect()] == ["m"]
    assert review.review_queue(g, status="", document="x.TXT")["total"] == 2
    with pytest.raises(ValueError):
        review.review_queue(g, status="odd")
    docs = {r.name: r for r in aggregate.documents(g).collect()}
    assert docs["x.txt"].nodes == 2 and docs["x.txt"].page_count == 12 and docs["y.txt"].nodes == 1
    assert statuses("odd") == statuses("") and statuses("accepted,odd") == ("accepted",)


def test_invalid_graphs(spark):
    raw = spark.createDataFrame([(0, {"id": "a"}), (1, {"id": " a "}), (2, {"id": " ", "name": "n"})], "ord long, attrs map<string,string>").selectExpr("*", "cast(null as array<string>) sources")
    nodes = validate.clean_nodes(raw)
    edges = validate.clean_edges(spark.createDataFrame([(0, "a", "zulu", {})], "ord long, source string, target string, attrs map<string,string>").selectExpr("*", "cast(null as array<string>) sources"))
    assert sorted((r.problem, r["item"]) for r in validate.problems(nodes, edges).collect()) == [("duplicate id", "a"), ("missing id", "2"), ("unknown endpoint", "0")]
    with pytest.raises(GraphValidationError):
        validate.validated(nodes, edges)


def test_merge_keeps_reviews_of_unchanged_records(spark):
    g = decide(shapes.multigraph(spark), ("node", "alpha", "accepted", None), ("node", "bravo", "accepted", None))
    new = shapes.multigraph(spark)
    new = new.with_(nodes=new.nodes.selectExpr("id", "if(id = 'bravo', 'Bravo II', label) label", "type", "ord", "attrs", "sources"))
    merged = validate.merge_graph(g, new)
    assert merged.edges.count() == 3 and {r.edge_id for r in merged.edges.collect()} == {r.edge_id for r in g.edges.collect()}
    assert {r.id: r.status for r in merged.node_status().collect()} == {"alpha": "accepted", "bravo": "unreviewed", "charlie": "unreviewed"}
    assert merged.audit.where("action = 'review_invalidated'").count() == 1
    assert validate.replace_graph(g, new).reviews.count() == 0


def test_files(spark, tmp_path):
    (tmp_path / "g.json").write_text('{"graph": {"name": "N"}, "nodes": [{"id": "a", "sources": ["p", "q"], "n": 3}, {"name": "b", "title": "Kind: b"}], "edges": [{"source": {"id": "a"}, "target": "b", "predicate": "LIKES"}]}')
    g = node_link.read(spark, str(tmp_path / "g.json"))
    assert g.meta["name"] == "N" and [(r.source, r.relation, r.target) for r in g.edges.collect()] == [("a", "LIKES", "b")]
    assert {r.id: (r.type, r.sources) for r in g.nodes.collect()} == {"a": ("Entity", ["p", "q"]), "b": ("Kind", None)}
    node_link.write(g, str(tmp_path / "out"), statuses=("unreviewed",))
    assert spark.read.json(str(tmp_path / "out" / "links")).count() == 1
    (tmp_path / "g.graphml").write_text("""<graphml><key id="k0" for="node" attr.name="label" attr.type="string"/><key id="k1" for="node" attr.name="size" attr.type="int"/><key id="k2" for="edge" attr.name="relation" attr.type="string"/>
<graph edgedefault="directed"><node id="a"><data key="k0">Ay</data><data key="k1">07</data></node><node id="b"><data key="k1">x7</data></node><edge source="a" target="b"><data key="k2">LIKES</data></edge><edge source="a" target="zulu"/></graph></graphml>""")
    h = graphml.read(spark, str(tmp_path / "g.graphml"))
    assert {r.id: (r.label, r.attrs["size"]) for r in h.nodes.collect()} == {"a": ("Ay", "7"), "b": ("b", "x7")} and [r.relation for r in h.edges.collect()] == ["LIKES"]
    (tmp_path / "bad.graphml").write_text('<!DOCTYPE x><graphml></graphml>')
    with pytest.raises(GraphValidationError):
        graphml.read(spark, str(tmp_path / "bad.graphml"))
    (tmp_path / "t.txt").write_text("é")
    (tmp_path / "t.bin").write_bytes(b"\xff\xfe\x00")
    (tmp_path / "t.pdf").write_bytes(b"%PDF-1.4")
    kinds = {r.path.rsplit("/", 1)[1]: (r.kind, r.text) for r in text.sniffed(text.read_files(spark, str(tmp_path), "t.*", recursive=False)).collect()}
    assert kinds == {"t.txt": ("text", "é"), "t.bin": ("unsupported", None), "t.pdf": ("pdf", None)}
    assert [r.text for r in text.read_texts(spark, str(tmp_path), "*.txt").collect()] == ["é"]
