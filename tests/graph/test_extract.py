from pyspark.sql import functions as F

from graphloom.functions.text import coerce, excerpt_chars, excerpt_words, is_quantity
from graphloom.operators import extract, registry

RECORD = "doc_id long, class string, text string, attributes map<string,string>, char_start int, char_end int, ord long"


def test_records_to_graphs(spark):
    docs = spark.createDataFrame([(1, "DOCUMENT ID : D1\nDATE: 2024\n\nAcme Ltd owns Site B for 40 MW.")], "doc_id long, text string")
    text = docs.first().text
    at = text.index("Acme")
    rows = [(1, "entity", "Acme Ltd", {"type": "Company"}, at, at + 8, 0), (1, "entity", "acme  ltd", {}, None, None, 1), (1, "entity", "40 MW", {"type": "metric"}, None, None, 2),
            (1, "relationship", "Acme Ltd owns Site B", {"subject": "Acme Ltd", "predicate": "owns it!", "object": "Site B", "status": "SAID"}, at, at + 20, 3), (1, "relationship", "half", {"subject": "x"}, None, None, 4)]
    triples = extract.triples(spark.createDataFrame(rows, RECORD), ["company", "metric"])
    kept, gone = extract.filtered(triples, ["OWNS_IT"])
    assert sorted((r.subject, r.predicate, r.object) for r in kept.collect()) == [("Acme Ltd", "OWNS_IT", "Site B"), ("Acme Ltd", "instance_of", "company")]
    assert [(r.reason, r.value, r["count"]) for r in gone.collect()] == [("quantity", "40 MW", 1)]
    g = extract.triples_to_graph(kept, docs)
    assert {r.id: r.type for r in g.nodes.collect()} == {"acme ltd": "company", "site b": "unknown"}
    edge = g.edges.first()
    assert edge.attrs["claim_id"] == "D1" and edge.attrs["time_scope"] == "2024" and edge.attrs["status"] == "SAID" and edge.attrs["assertion_id"].startswith("assertion-")


def test_grounding_and_quotes(spark):
    docs = spark.createDataFrame([(1, "alpha beta"), (2, None)], "doc_id long, text string")
    rows = [(1, "entity", "alpha", {}, 0, 5, 0), (1, "entity", "beta", {}, 0, 4, 1), (1, "entity", "beta", {}, None, None, 2), (2, "entity", "x", {}, None, None, 3), (1, "relationship", "alpha", {"subject_text": "alpha", "object_text": "gone"}, None, None, 4)]
    df = spark.createDataFrame(rows, RECORD)
    assert [r.grounded for r in extract.grounded(df, docs).orderBy("ord").collect()] == [True, False, True, False, True]
    assert [r.unquoted for r in extract.unquoted(df, docs).orderBy("ord").collect()] == [None] * 4 + ["object_text"]


def test_pages_excerpts_and_packing(spark):
    docs = spark.createDataFrame([(1, "[[page 1]]ab[[page 2]]cd")], "doc_id long, text string")
    marks = extract.page_marks(docs)
    assert sorted((r.offset, r.page) for r in marks.collect()) == [(0, 1), (12, 2)]
    spans = spark.createDataFrame([(1, 0, "x"), (1, 13, "y"), (2, 5, "z"), (1, None, "n")], "doc_id long, offset int, name string")
    assert {r.name: r.page for r in extract.pages_of(spans, marks).collect()} == {"x": 1, "y": 2, "z": 0, "n": 0}
    t = spark.createDataFrame([("one two  three four five", 9, 14, "07", "int")], "t string, a int, b int, v string, k string")
    got = t.select(excerpt_words("t", F.col("a"), F.col("b"), 1).alias("w"), excerpt_chars("t", F.col("a"), F.col("b"), 4).alias("c"), coerce("v", "k").alias("v"), is_quantity(F.lit("USD 5 million")).alias("q")).first()
    assert got.w == "…two three four…" and got.c == "… three…" or got.c == "…three…"
    assert got.v == "7" and got.q
    rows = extract.packed(spark.createDataFrame([("p", i, str(i), s) for i, s in enumerate([4, 4, 4, 20, 1])], "pass string, ord long, id string, size long"), 10)
    assert [r.shard for r in rows.orderBy("ord").collect()] == [0, 0, 1, 2, 3]


def test_assertions_are_reified(spark):
    docs = spark.createDataFrame([(1, "alpha beats beta")], "doc_id long, text string")
    a = {"subject_text": "alpha", "subject_type_id": "t:A", "object_text": "beta", "object_type_id": "t:A", "predicate_id": "r:beats", "modality": "MODEL_PREDICTED"}
    g = extract.assertion_graph(spark.createDataFrame([(1, "entity", "alpha", {"type_id": "t:A"}, 0, 5, 0), (1, "relationship", "alpha beats beta", a, 0, 16, 1)], RECORD), docs, {"r:beats": "beats", "t:A": "Letter"})
    kinds = {r.attrs["record_kind"]: r for r in g.nodes.collect()}
    assert set(kinds) == {"MENTION", "PREDICTION", "SOURCE_DOCUMENT"} and kinds["PREDICTION"].label == "alpha —[beats]→ beta" and g.nodes.count() == 4
    assert {r.relation: r.n for r in g.edges.groupBy("relation").agg(F.count("*").alias("n")).collect()} == {"hasSubject": 1, "hasObject": 1, "hasSourceInstance": 1, "hasMention": 2}
    assert g.edge_status().where("status <> 'accepted'").count() == 0


def test_registry(spark):
    types = spark.createDataFrame([("t:T", "Thing", None, True), ("t:A", "Animal", "t:T", False), ("t:B", "Bird", "t:A", False), ("t:X", "Loop", "t:Y", False), ("t:Y", "Loop", "t:X", False)], "id string, label string, parent_id string, abstract boolean").selectExpr("*", "not abstract as extractable", "false as review_required")
    rel = spark.createDataFrame([("r:eats", "eats", ["t:A"], ["t:T"], None, "PROPOSE"), ("r:colour", "colour", ["t:A"], [], "v:c", "EXTRACT")], "id string, label string, domain array<string>, range array<string>, value_set string, model_action string")
    modules = types.selectExpr("'m' module_id", "'type' kind", "id member_id").union(rel.selectExpr("'m'", "'relation'", "id"))
    sets = spark.createDataFrame([("v:c", True, ["red", "blue"])], "id string, closed boolean, values array<string>")
    r = registry.Registry(types, rel, modules, sets, {"polarity": ["AFFIRMED", "NEGATED"]})
    assert {(x.id, x.ancestor) for x in registry.ancestors(types).collect()} >= {("t:B", "t:B"), ("t:B", "t:A"), ("t:B", "t:T"), ("t:X", "t:Y")}
    base = {"subject_text": "s", "subject_type_id": "t:B", "predicate_id": "r:eats", "object_text": "o", "object_type_id": "t:A", "review_action": "PROPOSE_FOR_REVIEW"}
    cases = [base, base | {"subject_type_id": "t:X"}, base | {"review_action": "EXTRACT_AS_REPORTED"}, base | {"polarity": "odd"}, base | {"predicate_id": "r:colour", "object_type_id": "skos:Concept", "value_id": "green"},
             base | {"predicate_id": "r:colour", "object_type_id": "skos:Concept", "value_id": "red"}, base | {"predicate_id": "r:zzz"}]
    rows = spark.createDataFrame([(1, "relationship", "t", c, None, None, i) for i, c in enumerate(cases)], RECORD)
    got = registry.validate(rows, r).orderBy("ord").collect()
    assert [x.errors for x in got] == [[], ["subject type does not satisfy the domain"], ["review action is not permitted"], ["polarity is not a permitted value"], ["value is no member of the set"], [], ["predicate is unknown"]]
    assert got[2].review_action == "PROPOSE_FOR_REVIEW"
    pool = types.select("id")
    assert [x.repaired for x in registry.repaired(spark.createDataFrame([("z:b",), ("t:A",), ("q",)], "value string"), pool).orderBy("value").collect()] == ["q", "t:A", "t:B"]


def test_chains_of_any_depth_are_whole(spark):
    types = spark.createDataFrame([(f"t{i}", f"t{i - 1}" if i else None) for i in range(100)] + [("x", "y"), ("y", "z"), ("z", "x"), ("own", "own"), ("lost", "nowhere")], "id string, parent_id string")
    got = {(r.id, r.ancestor): r.depth for r in registry.ancestors(types).collect()}
    assert {k: v for k, v in got.items() if k[0][0] == "t"} == {(f"t{i}", f"t{j}"): i - j for i in range(100) for j in range(i + 1)}
    assert {k: v for k, v in got.items() if k[0] in "xyz"} == {(a, b): ("xyz".index(b) - "xyz".index(a)) % 3 for a in "xyz" for b in "xyz"}
    assert (got["own", "own"], got["lost", "nowhere"], got["lost", "lost"]) == (0, 1, 0)
