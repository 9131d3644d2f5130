"""Queries over the test tables, one or more for each operator, and their DuckDB SQL."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.lineage import cut, shared_folder
from ..functions.text import STOPWORDS, band, candidate_phrases, capped, clean_text, coerce, document_names, excerpt_chars, excerpt_words, is_quantity, predicate_name
from ..model import Graph, edge_ids, statuses
from ..operators import aggregate, ask, catalogue, extract, metrics, registry, review, search, traverse, validate
from ..operators.project import is_prediction, projection, snapshot_id
from ..sources import graphml, node_link, tabular, text
from . import tables
from .tables import graph, read

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None, **shape) -> Callable[[Query], Query]:
    """Registers a query; sql may use the graph's WITH clauses if it begins with +."""
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = sql if not sql.startswith("+") else f"WITH {'RECURSIVE ' if shape.pop('recursive', False) else ''}{tables.sql(**shape)} {sql[1:]}"
        return f
    return add


def _one(spark: SparkSession, row: dict, schema: str) -> DataFrame:
    return spark.createDataFrame([tuple(row.values())], schema)


# --- sources, written to the shared folder and read back ---

def _round_trip(spark, write: Callable[[str], None], load: Callable[[str], DataFrame]) -> DataFrame:
    """What load makes of the folder that write has filled, kept as a table, so that the folder can go."""
    where = f"{shared_folder(spark)}/trip-{uuid.uuid4().hex}"
    write(where)
    out = cut(load(where))
    path = spark._jvm.org.apache.hadoop.fs.Path(where)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
    return out


@query("SELECT 'nation:' || n_nationkey AS source, 'region:' || n_regionkey AS target, 'IN_REGION' AS relation, n_name AS label, n_nationkey::VARCHAR AS weight FROM nation")
def s2_graphml_scan(spark, d):
    n, r = read(spark, d, "nation"), read(spark, d, "region")
    line = lambda text: F.concat(*[F.col(x).cast("string") if x.startswith(("n_", "r_")) else F.lit(x) for x in text])
    head = '<?xml version="1.0"?><g:graphml xmlns:g="http://graphml.graphdrawing.org/xmlns"><g:key id="l" for="node" attr.name="label" attr.type="string"/><g:key id="t" for="edge" attr.name="type" attr.type="string"/><g:key id="w" for="edge" attr.name="weight" attr.type="int"/><g:graph edgedefault="directed">'
    rows = (spark.createDataFrame([(0, head)], "k int, value string").union(n.select(F.lit(1), line(['<g:node id="nation:', "n_nationkey", '"><g:data key="l">', "n_name", "</g:data></g:node>"]))).union(r.select(F.lit(1), line(['<g:node id="region:', "r_regionkey", '"/>'])))
            .union(n.select(F.lit(2), line(['<g:edge source="nation:', "n_nationkey", '" target="region:', "n_regionkey", '"><g:data key="t">IN_REGION</g:data><g:data key="w"> 0', "n_nationkey", "</g:data></g:edge>"])))
            .union(n.select(F.lit(2), line(['<g:edge source="nation:', "n_nationkey", '" target="nowhere"/>']))).union(spark.createDataFrame([(3, "</g:graph></g:graphml>")], "k int, value string")))

    def load(where: str) -> DataFrame:
        g = graphml.read(spark, where)
        return g.edges.join(g.nodes.select(F.col("id").alias("source"), "label"), "source").select("source", "target", "relation", "label", F.element_at("attrs", "weight").alias("weight"))

    return _round_trip(spark, lambda where: rows.coalesce(1).sortWithinPartitions("k").select("value").write.text(where), load)


@query("SELECT n_name || chr(10) AS text FROM nation")
def s4_text_scan(spark, d):
    return _round_trip(spark, lambda where: read(spark, d, "nation").select("n_name").coalesce(1).write.option("maxRecordsPerFile", 1).text(where), lambda where: text.read_texts(spark, where).select("text"))


@query("SELECT CASE WHEN n_regionkey = 1 THEN 'b' ELSE 'a' END AS folder, count(*) AS files FROM nation WHERE n_regionkey < 2 GROUP BY 1")
def s6_directory_scan(spark, d):
    n = read(spark, d, "nation")

    def write(where: str) -> None:
        for region, name in ((0, "a"), (1, "a/b"), (2, "c")):
            part = n.where(F.col("n_regionkey") == region).select("n_name").coalesce(1).write.option("maxRecordsPerFile", 1)
            part.csv(f"{where}/{name}") if region == 2 else part.text(f"{where}/{name}")

    folder = F.regexp_extract("path", r"([^/]+)/[^/]+$", 1).alias("folder")
    return _round_trip(spark, write, lambda where: text.read_files(spark, where, "*.txt, *.md").groupBy(folder).agg(F.count("*").alias("files")))


@query("SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN 'pdf' WHEN 1 THEN 'text' ELSE 'unsupported' END AS kind, CASE WHEN doc_id % 3 = 1 THEN text END AS text FROM documents WHERE text IS NOT NULL")
def s7_sniffed(spark, d):
    k, body = F.col("doc_id") % 3, F.encode("text", "UTF-8")
    files = read(spark, d, "documents").where("text is not null").select(F.col("doc_id").alias("path"), F.when(k == 0, F.concat(F.encode(F.lit("%PDF-1.7 "), "UTF-8"), body)).when(k == 1, body).otherwise(F.concat(F.unhex(F.lit("C328")), body)).alias("content"))
    return text.sniffed(files).select(F.col("path").alias("doc_id"), "kind", "text")


@query("+ SELECT kind, item_id, decision FROM reviews")
def s11_review_export(spark, d):
    return _round_trip(spark, lambda where: node_link.write_reviews(graph(spark, d), where), lambda where: spark.read.schema("kind string, item_id string, decision string").json(f"{where}/reviews"))


@query("+ SELECT id, label, status AS review_status FROM ns UNION ALL SELECT edge_id, relation, status FROM es", lines=False)
def s14_backup(spark, d):
    def load(where: str) -> DataFrame:
        folder = f"{where}/backups/20240101"
        return (spark.read.schema("id string, label string, review_status string").json(f"{folder}/nodes")
                .union(spark.read.schema("edge_id string, relation string, review_status string").json(f"{folder}/links")))

    return _round_trip(spark, lambda where: node_link.backup(graph(spark, d, lines=False), where, "20240101"), load)


# --- aggregation ---

@query("""+ SELECT n.id, n.label, n.type, coalesce(d.degree, 0) AS degree, n.status FROM ns n LEFT JOIN
    (SELECT a.node AS id, count(*) AS degree FROM adj a JOIN ns m ON m.id = a.neighbour WHERE a.status <> 'rejected' AND m.status <> 'rejected' GROUP BY 1) d USING (id)
    WHERE n.status <> 'rejected' ORDER BY degree DESC, lower(n.label), n.ord LIMIT 8""")
def a3_most_connected(spark, d):
    return aggregate.most_connected(graph(spark, d))


@query("""+ SELECT (SELECT count(*) FROM ns) AS nodes, (SELECT count(*) FROM es) AS relationships, count(*) FILTER (status = 'accepted') AS accepted, count(*) FILTER (status = 'rejected') AS rejected,
    count(*) FILTER (status = 'unreviewed') AS unreviewed, round(count(*) FILTER (status <> 'unreviewed') / count(*) * 100, 1) AS completion FROM (SELECT status FROM ns UNION ALL SELECT status FROM es)""")
def a1_counts(spark, d):
    return aggregate.counts(graph(spark, d))


@query("+ SELECT type AS name, count(*) AS count FROM nodes GROUP BY 1 ORDER BY 2 DESC, min(ord) LIMIT 10")
def a2_type_histogram(spark, d):
    return aggregate.type_histogram(graph(spark, d))


@query("+ SELECT relation AS name, count(*) AS count FROM kept GROUP BY 1 ORDER BY 2 DESC, min(ord) LIMIT 12")
def a2_retained_relations(spark, d):
    return aggregate.relation_histogram(graph(spark, d), retained=True)


def _documents_graph(spark, d) -> Graph:
    """Documents as nodes of their source, joined to the next of their source's; quality labels are reviews."""
    docs, labels = read(spark, d, "documents"), read(spark, d, "labels")
    nodes = docs.select(F.concat(F.lit("doc:"), "doc_id").alias("id"), F.concat(F.lit("Document "), "doc_id").alias("label"), F.col("lang").alias("type"), F.col("doc_id").alias("ord"),
                        F.create_map(F.lit("source_document"), F.coalesce("source", F.lit("")), F.lit("record_kind"), F.when(F.col("doc_id") % 50 == 0, "SOURCE_DOCUMENT").otherwise("MENTION"), F.lit("document_id"), F.concat(F.lit("d"), "doc_id"), F.lit("page_count"), F.col("n_chars").cast("string")).alias("attrs"))
    edges = docs.where("doc_id % 2 = 1").select(F.concat(F.lit("doc:"), F.col("doc_id") - 1).alias("source"), F.concat(F.lit("doc:"), "doc_id").alias("target"), F.lit("NEXT").alias("relation"), F.col("doc_id").alias("ord"), F.concat(F.lit("NEXT:"), "doc_id").alias("edge_id"),
                                                F.create_map(F.lit("doc_id"), F.coalesce("source", F.lit("")), F.lit("sources"), F.lit("shared")).alias("attrs"))
    said = labels.groupBy("doc_id").agg(F.max("quality").alias("q"))
    reviews = said.select(F.lit("node").alias("kind"), F.concat(F.lit("doc:"), "doc_id").alias("item_id"), F.when(F.col("q") == 1, "accepted").otherwise("rejected").alias("decision"), F.lit("").alias("reason"), F.lit("").alias("analyst"), F.lit(None).cast("timestamp").alias("updated_at"))
    return Graph.of(nodes, edges, reviews)


@query("""WITH l AS (SELECT doc_id, max(quality) AS q FROM labels GROUP BY 1), n AS (SELECT d.doc_id, d.n_chars, source AS name, CASE q WHEN 1 THEN 'accepted' WHEN 0 THEN 'rejected' ELSE 'unreviewed' END AS status FROM documents d LEFT JOIN l USING (doc_id)),
    r AS (SELECT name, 1 AS n, 0 AS e, status, CASE WHEN doc_id % 50 = 0 THEN doc_id END AS own, n_chars FROM n UNION ALL
          SELECT unnest([source, 'shared']), 0, 1, 'unreviewed', NULL, NULL FROM documents WHERE doc_id % 2 = 1)
    SELECT name, sum(n)::BIGINT AS nodes, sum(e)::BIGINT AS relationships, count(*) FILTER (status = 'accepted') AS accepted, count(*) FILTER (status = 'rejected') AS rejected, count(*) FILTER (status = 'unreviewed') AS unreviewed,
        coalesce('d' || max(own), '') AS document_id, '' AS media_type, coalesce(arg_max(n_chars, own), 0) AS page_count, '' AS ingested_at FROM r GROUP BY name""")
def a4_document_registry(spark, d):
    return aggregate.documents(_documents_graph(spark, d), None)


@query("""+, r AS (SELECT 'type' AS what, type AS name, count(*) AS count FROM nodes GROUP BY 2 UNION ALL SELECT 'relation', relation, count(*) FROM edges GROUP BY 2) SELECT * FROM r""")
def a5_whole_graph(spark, d):
    return aggregate.whole_graph(graph(spark, d))


@query("""+, c AS (SELECT a.node AS id, relation, count(*) AS count FROM adj a JOIN ns m ON m.id = a.neighbour WHERE a.status <> 'rejected' AND m.status <> 'rejected' GROUP BY ALL)
    SELECT id, relation, count FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY count DESC, relation) AS k FROM c) WHERE k <= 6""", lines=False)
def a6_neighbour_relations(spark, d):
    return aggregate.neighbour_relations(graph(spark, d, lines=False))


@query("""WITH m AS (SELECT user_id, event_type, json_extract_string(props, '$.k') AS k, event_id FROM events) SELECT user_id, count(*) AS mentions, arg_min(k, event_id) FILTER (k IS NOT NULL AND k <> '') AS k,
    array_to_string(list_distinct_ordered, ',') AS sources FROM (SELECT m.*, o.list_distinct_ordered FROM m JOIN (SELECT user_id, list(event_type ORDER BY f) AS list_distinct_ordered FROM (SELECT user_id, event_type, min(event_id) AS f FROM m GROUP BY ALL) GROUP BY 1) o USING (user_id)) GROUP BY user_id, list_distinct_ordered""")
def a9_mention_merge(spark, d):
    m = read(spark, d, "events").select("user_id", F.col("event_type").alias("source"), F.get_json_object("props", "$.k").alias("k"), F.col("event_id").alias("ord"))
    return aggregate.merge_mentions(m, ["user_id"], ["k"]).withColumn("sources", F.concat_ws(",", "sources"))


@query("""WITH n AS (SELECT coalesce(source, '') || ':' || lang AS id, 'L' || doc_id AS label, CASE WHEN doc_id % 3 = 0 THEN 'unknown' ELSE lang END AS type, 's' || doc_id % 7 AS s, doc_id FROM documents),
    o AS (SELECT id, list(s ORDER BY f) AS ss FROM (SELECT id, s, min(doc_id) AS f FROM n GROUP BY ALL) GROUP BY 1)
    SELECT n.id, arg_min(label, doc_id) AS label, coalesce(arg_min(type, doc_id) FILTER (type <> 'unknown'), 'unknown') AS type, array_to_string(any_value(ss), ',') AS sources, min(doc_id) AS ord FROM n JOIN o USING (id) GROUP BY n.id""")
def a8_node_merge(spark, d):
    n = read(spark, d, "documents").select(F.concat_ws(":", F.coalesce("source", F.lit("")), "lang").alias("id"), F.concat(F.lit("L"), "doc_id").alias("label"), F.when(F.col("doc_id") % 3 == 0, "unknown").otherwise(F.col("lang")).alias("type"),
                                           F.array(F.concat(F.lit("s"), F.col("doc_id") % 7)).alias("sources"), F.col("doc_id").alias("ord"))
    return aggregate.merge_nodes(n).withColumn("sources", F.concat_ws(",", "sources"))


@query("SELECT c_custkey AS id, CASE WHEN c_acctbal < 0 OR c_custkey % 5 = 0 THEN NULL ELSE round(0.5::DOUBLE * floor(greatest(0, least(1, c_acctbal / 10000)) * 100) / 100 + 0.5::DOUBLE * (c_nationkey / 25), 6) END AS value, "
       "round(CASE WHEN c_acctbal < 0 THEN 0::DOUBLE ELSE 0.5 END + CASE WHEN c_custkey % 5 = 0 THEN 0 ELSE 0.5 END, 6)::DOUBLE AS available_weight, array_to_string(list_filter([CASE WHEN c_acctbal < 0 THEN 'balance' END, CASE WHEN c_custkey % 5 = 0 THEN 'place' END], lambda x: x IS NOT NULL), ',') AS missing, "
       "CASE WHEN c_acctbal < 0 THEN NULL WHEN floor(least(1, c_acctbal / 10000) * 100) / 100 >= 0.8 THEN 'very high' WHEN floor(least(1, c_acctbal / 10000) * 100) / 100 >= 0.6 THEN 'high' WHEN floor(least(1, c_acctbal / 10000) * 100) / 100 >= 0.4 THEN 'moderate' WHEN floor(least(1, c_acctbal / 10000) * 100) / 100 >= 0.2 THEN 'low' ELSE 'very low' END AS band FROM customer")
def a11_composite_and_bands(spark, d):
    c = read(spark, d, "customer").withColumn("v", F.when(F.col("c_acctbal") >= 0, F.floor(capped("c_acctbal", 10_000) * 100) / 100))
    values = c.select(F.col("c_custkey").alias("id"), F.lit("balance").alias("method"), F.col("v").alias("value")).union(c.where("c_custkey % 5 <> 0").select("c_custkey", F.lit("place"), F.col("c_nationkey") / 25))
    out = aggregate.composite(values, {"balance": 0.5, "place": 0.5})
    return out.join(c.select(F.col("c_custkey").alias("id"), band("v").alias("band")), "id").select("id", "value", "available_weight", F.concat_ws(",", "missing_required").alias("missing"), "band")


# --- filters, review ---

_STATUS_LISTS = ["", "accepted", " Rejected ,unreviewed", "bogus", "bogus,accepted"]


@query("""+, l(list, wanted) AS (VALUES ('', ['accepted', 'rejected', 'unreviewed']), ('accepted', ['accepted']), (' Rejected ,unreviewed', ['rejected', 'unreviewed']), ('bogus', ['accepted', 'rejected', 'unreviewed']), ('bogus,accepted', ['accepted']))
    SELECT list, count(*) AS nodes FROM l JOIN ns ON list_contains(wanted, status) GROUP BY 1""")
def f1_status_lists(spark, d):
    wanted = spark.createDataFrame([(x, list(statuses(x))) for x in _STATUS_LISTS], "list string, wanted array<string>")
    return graph(spark, d).node_status().join(F.broadcast(wanted), F.array_contains("wanted", F.col("status"))).groupBy("list").agg(F.count("*").alias("nodes"))


@query("""SELECT 'doc:' || doc_id AS item_id FROM documents WHERE lower(source) = 'src1' UNION ALL SELECT 'NEXT:' || doc_id FROM documents WHERE doc_id % 2 = 1 AND doc_id - 1 IN (SELECT doc_id FROM documents) AND lower(source) = 'src1'""")
def f3_in_document(spark, d):
    return review.items(_documents_graph(spark, d)).where(review.in_document(F.col("documents"), " SRC1 ")).select("item_id")


@query("""+ SELECT kind, id AS item_id, label, type, status FROM (SELECT 'node' AS kind, id, label, type, status FROM ns UNION ALL
    SELECT 'edge', edge_id, s.label || ' — ' || relation || ' — ' || t.label, relation, e.status FROM es e JOIN nodes s ON s.id = source JOIN nodes t ON t.id = target)
    WHERE status IN ('accepted', 'rejected') AND contains(lower(label || ' ' || type), 'customer#00000001')""", lines=False)
def f2_review_queue(spark, d):
    return review.queue_matches(graph(spark, d, lines=False), status="accepted,rejected", query="Customer#00000001").select("kind", "item_id", "label", "type", "status")


@query("""+ SELECT edge_id, relation FROM kept""")
def f5_retained(spark, d):
    return graph(spark, d).retained_edges().select("edge_id", "relation")


@query("""+, a AS (SELECT k.*, n.label AS nl, row_number() OVER (PARTITION BY node ORDER BY k.ord, edge_id, side) AS k FROM adj k JOIN ns n ON n.id = k.neighbour WHERE k.status <> 'rejected' AND n.status <> 'rejected')
    SELECT n.id, n.label, n.status, count(a.node) AS degree, coalesce(string_agg(nl, '|' ORDER BY k) FILTER (k <= 20), '') AS neighbours FROM ns n LEFT JOIN a ON a.node = n.id GROUP BY ALL""", lines=False)
def f6_node_details(spark, d):
    out = review.node_details(graph(spark, d, lines=False))
    return out.select("id", "label", "status", "degree", F.coalesce(F.concat_ws("|", F.transform("neighbours", lambda n: n["label"])), F.lit("")).alias("neighbours"))


@query("SELECT doc_id, trim(regexp_replace(text, '\\s+', ' ', 'g')) AS clean FROM documents")
def v1_clean_text(spark, d):
    return read(spark, d, "documents").select("doc_id", clean_text("text").alias("clean"))


@query("SELECT item_id, upper(regexp_replace(regexp_replace(text, '[^A-Za-z0-9]+', '_', 'g'), '^_+|_+$', '', 'g')) AS name FROM benchmark")
def f9_predicate_names(spark, d):
    return read(spark, d, "benchmark").select("item_id", predicate_name("text").alias("name"))


@query("SELECT p_partkey, regexp_full_match(trim(v), '(?i)(?:UAH|USD|EUR|GBP)?\\s*\\d[\\d\\s.,/-]*\\s*(?:%|million|billion|thousand|MW|kV|minutes|hours|days|years)?') AS quantity FROM "
       "(SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN p_name WHEN 1 THEN 'USD ' || p_size || ' million' WHEN 2 THEN p_size || ',5 kV' ELSE p_name || ' ' || p_size END AS v FROM part)")
def f8_quantities(spark, d):
    k = F.col("p_partkey") % 4
    v = F.when(k == 0, F.col("p_name")).when(k == 1, F.concat(F.lit("USD "), "p_size", F.lit(" million"))).when(k == 2, F.concat("p_size", F.lit(",5 kV"))).otherwise(F.concat_ws(" ", "p_name", "p_size"))
    return read(spark, d, "part").select("p_partkey", is_quantity(v).alias("quantity"))


@query("SELECT doc_id, CASE WHEN source IS NULL OR source = '' OR source = lang THEN lang ELSE source || '|' || lang END AS names FROM documents")
def f7_document_names(spark, d):
    rows = read(spark, d, "documents").withColumn("attrs", F.create_map(F.lit("source_document"), "source"))
    return rows.select("doc_id", F.concat_ws("|", document_names("attrs", F.array("lang", "source"))).alias("names"))


@query("""+ SELECT kind, item_id, decision FROM reviews WHERE kind = 'node'""", lines=False)
def v6_latest_decisions(spark, d):
    return review.current_decisions(tables.decisions(spark, d)).select("kind", "item_id", "decision")


@query("""+ SELECT id, status FROM ns UNION ALL SELECT edge_id, status FROM es""")
def v8_review_overlay(spark, d):
    g = graph(spark, d)
    return g.node_status().select("id", "status").union(g.edge_status().select("edge_id", "status"))


@query("SELECT 'duplicate id' AS problem, 'n' || (c_custkey % 700) AS item FROM customer WHERE c_custkey % 700 < 800 GROUP BY 2 HAVING count(*) > 1 UNION ALL "
       "SELECT 'unknown endpoint', CAST(o_orderkey AS VARCHAR) FROM orders WHERE NOT ('n' || (o_custkey) IN (SELECT 'n' || (c_custkey % 700) FROM customer))")
def v2_problems(spark, d):
    nodes = validate.clean_nodes(read(spark, d, "customer").select(F.col("c_custkey").alias("ord"), F.create_map(F.lit("name"), F.concat(F.lit(" n"), F.col("c_custkey") % 700)).alias("attrs"), F.lit(None).cast("array<string>").alias("sources")))
    edges = validate.clean_edges(read(spark, d, "orders").select(F.col("o_orderkey").alias("ord"), F.concat(F.lit("n"), "o_custkey").alias("source"), F.lit("n1").alias("target"), F.expr("cast(map() as map<string,string>)").alias("attrs"), F.lit(None).cast("array<string>").alias("sources")))
    return validate.problems(nodes, edges)


@query("SELECT 'edge-' || substr(sha256('{\"source\":\"orders:' || l_orderkey || '\",\"relation\":\"CONTAINS\",\"target\":\"part:' || l_partkey || '\",\"explicit_id\":\"' || l_returnflag || '\"}|' || "
       "(row_number() OVER (PARTITION BY l_orderkey, l_partkey, l_returnflag ORDER BY l_linenumber, l_suppkey) - 1)), 1, 16) AS edge_id, l_orderkey, l_partkey FROM lineitem")
def v0_edge_identity(spark, d):
    rows = read(spark, d, "lineitem").select(F.concat(F.lit("orders:"), "l_orderkey").alias("source"), F.concat(F.lit("part:"), "l_partkey").alias("target"), F.lit("CONTAINS").alias("relation"), (F.col("l_linenumber") * 1_000_000 + F.col("l_suppkey")).alias("ord"),
                                             F.create_map(F.lit("assertion_id"), "l_returnflag").alias("attrs"), "l_orderkey", "l_partkey")
    return edge_ids(rows).select("edge_id", "l_orderkey", "l_partkey")


@query("WITH u AS (SELECT c_custkey AS k, c_name AS label, 0 AS g FROM customer WHERE c_custkey % 3 < 2 UNION ALL SELECT c_custkey, CASE WHEN c_custkey % 2 = 0 THEN c_name ELSE upper(c_name) || '!' END, 1 FROM customer WHERE c_custkey % 3 > 0) "
       "SELECT 'c' || k AS id, arg_max(label, g) AS label, coalesce(max(CASE WHEN k % 4 = 1 AND k % 3 < 2 AND NOT (k % 3 = 1 AND k % 2 = 1) THEN 'accepted' END), 'unreviewed') AS status FROM u GROUP BY k")
def v5_merge(spark, d):
    c = read(spark, d, "customer").select(F.col("c_custkey").alias("ord"), F.concat(F.lit("c"), "c_custkey").alias("id"), F.col("c_name").alias("label"))
    none = spark.createDataFrame([], "edge_id string, source string, target string, relation string, ord long")
    reviews = c.where("ord % 4 = 1 and ord % 3 < 2").select(F.lit("node").alias("kind"), F.col("id").alias("item_id"), F.lit("accepted").alias("decision"), F.lit("").alias("reason"), F.lit("").alias("analyst"), F.current_timestamp().alias("updated_at"))
    old = Graph.of(c.where("ord % 3 < 2"), none, reviews)
    new = Graph.of(c.where("ord % 3 > 0").withColumn("label", F.when(F.col("ord") % 2 == 0, F.col("label")).otherwise(F.concat(F.upper("label"), F.lit("!")))), none)
    return validate.merge_graph(old, new).node_status().select("id", "label", "status")


@query("""+ SELECT source, relation, target, count(*) AS assertions, (list(edge_id ORDER BY ord, edge_id))[1] AS id FROM kept GROUP BY ALL""")
def v9_projection(spark, d):
    return projection(graph(spark, d)).edges.select("source", "relation", "target", F.size("assertion_ids").cast("long").alias("assertions"), "id")


_DIGEST_WORDS = ", ".join(f"CAST('0x' || substr(d, {1 + 15 * i}, 15) AS BIGINT) AS w{i}" for i in range(4))


@query(f"""+, f AS (SELECT DISTINCT source, upper(relation) AS relation, target FROM kept), r AS (SELECT '{{"k":"n","id":"' || id || '","type":"' || type || '","status":"' || status || '"}}' AS j FROM ns WHERE status <> 'rejected' UNION ALL
    SELECT '{{"k":"e","source":"' || source || '","relation":"' || relation || '","target":"' || target || '","polarity":"","valid":"/"}}' FROM f),
    w AS (SELECT {_DIGEST_WORDS} FROM (SELECT sha256(j) AS d FROM r))
    SELECT sha256(concat_ws('|', 'accepted,unreviewed', count(*), {", ".join(f"sum(w{i})" for i in range(4))}, {", ".join(f"bit_xor(w{i})" for i in range(4))})) AS snapshot FROM w""")
def v10_snapshot(spark, d):
    return spark.createDataFrame([(snapshot_id(projection(graph(spark, d))),)], "snapshot string")


@query("+ SELECT id, label, status AS review_status FROM ns WHERE status IN ('accepted', 'unreviewed') UNION ALL SELECT edge_id, relation, status FROM kept", lines=False)
def s10_export(spark, d):
    nodes, edges = node_link.export(graph(spark, d, lines=False), statuses=("accepted", "unreviewed"))
    return nodes.select("id", "label", "review_status").union(edges.select("edge_id", "relation", "review_status"))


@query("SELECT 'n' || n_nationkey AS id, n_name AS label, 'IN' AS relation, 'r' || n_regionkey AS target FROM nation")
def s1_node_link_scan(spark, d):
    n, r = read(spark, d, "nation"), read(spark, d, "region")
    ns = n.select(F.struct(F.concat(F.lit("n"), "n_nationkey").alias("id"), F.concat(F.lit(" "), "n_name").alias("label")).alias("x")).union(r.select(F.struct(F.concat(F.lit("r"), "r_regionkey"), F.col("r_name"))))
    ls = n.select(F.struct(F.concat(F.lit("n"), "n_nationkey").alias("source"), F.struct(F.concat(F.lit("r"), "n_regionkey").alias("id")).alias("target"), F.lit("IN").alias("predicate")).alias("x"))
    doc = ns.agg(F.collect_list("x").alias("nodes")).crossJoin(ls.agg(F.collect_list("x").alias("links"))).select(F.to_json(F.struct("nodes", "links")).alias("value"))
    nodes, edges = node_link.parse(doc)
    return edges.join(nodes.select(F.col("id").alias("source"), "label"), "source").select(F.col("source").alias("id"), "label", "relation", "target")


@query("SELECT DISTINCT p_brand AS source, trim(w) AS target, 'NAMED' AS relation FROM (SELECT p_brand, unnest(string_split(replace(p_name, ' ', '|'), '|')) AS w FROM part) WHERE trim(w) <> ''")
def s9_list_columns(spark, d):
    t = read(spark, d, "part").select("p_brand", F.translate("p_name", " ", "|").alias("words"))
    return tabular.list_graph(t, "p_brand", {"words": "NAMED"}).edges.select("source", "target", "relation")


@query("SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN CAST(p_size AS VARCHAR) WHEN 1 THEN p_name WHEN 2 THEN CASE WHEN p_size % 2 = 0 THEN 'true' ELSE 'false' END END AS value FROM part")
def s3_typed_attributes(spark, d):
    k = F.col("p_partkey") % 4
    v = F.when(k == 0, F.concat(F.lit(" 00"), "p_size")).when(k == 1, F.col("p_name")).when(k == 2, F.when(F.col("p_size") % 2 == 0, "YES").otherwise("no")).otherwise("  ")
    return read(spark, d, "part").select("p_partkey", coerce(v, F.when(k == 2, "boolean").when(k < 2, "int").otherwise("string")).alias("value"))


@query("SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN p_brand ELSE p_name END AS display FROM part WHERE p_partkey % 5 <> 4")
def s8_display_names(spark, d):
    k = F.col("p_partkey")
    p = read(spark, d, "part").select("p_partkey", F.when((k % 3 != 0) & (k % 5 != 4), F.col("p_name")).otherwise(" ").alias("name"), F.when(k % 5 != 4, F.col("p_brand")).alias("title"))
    return tabular.display_nodes(p, ["name", "title"])[0].select("p_partkey", "display")


@query("SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def s13_resume(spark, d):
    return text.unprocessed(read(spark, d, "documents").select("doc_id"), read(spark, d, "labels"), "doc_id")


@query("SELECT doc_id, len(list_filter(['review_status', 'host_derived', 'lang'], lambda k: k = 'lang'))::INTEGER AS kept FROM documents")
def v3_managed_fields(spark, d):
    rows = read(spark, d, "documents").select("doc_id", F.create_map(F.lit("review_status"), F.lit("accepted"), F.lit("host_derived"), F.lit("true"), F.lit("lang"), "lang").alias("attrs"))
    return validate.strip_managed(rows).select("doc_id", F.size("attrs").alias("kept"))


@query("+ SELECT id, label, 'unreviewed' AS status FROM nodes", orders=False, lines=False)
def v4_replace(spark, d):
    g = graph(spark, d, orders=False, lines=False)
    return validate.replace_graph(g, g).node_status().select("id", "label", "status")


@query("SELECT c_custkey AS k, CASE c_custkey % 2 WHEN 0 THEN 'accepted' ELSE 'rejected' END AS decision FROM customer WHERE c_custkey % 7 < 2")
def v7_sane_reviews(spark, d):
    c = read(spark, d, "customer")
    k = F.col("c_custkey")
    raw = c.select(F.concat(F.when(k % 7 == 2, "place:").when(k % 7 == 3, "").otherwise("node:"), F.lit("customer:"), F.when(k % 7 == 4, k + 10**9).otherwise(k)).alias("key"), F.when(k % 7 == 5, "maybe").when(k % 7 == 6, "unreviewed").when(k % 2 == 0, " Accepted ").otherwise("rejected").alias("decision"))
    return review.sane_reviews(graph(spark, d, orders=False, lines=False), raw).select(F.substring_index("item_id", ":", -1).cast("long").alias("k"), "decision")


@query("SELECT event_id, event_type = 'click' AND event_id % 2 = 0 OR event_type = 'view' AS prediction FROM events")
def f4_predictions(spark, d):
    e = F.col("event_type")
    attrs = F.create_map(F.lit("modality"), F.when((e == "click") & (F.col("event_id") % 2 == 0), " model_predicted ").otherwise("SAID"), F.lit("type"), F.when(e == "view", "Prediction").otherwise(e))
    return read(spark, d, "events").withColumn("attrs", attrs).select("event_id", is_prediction().alias("prediction"))


@query("SELECT event_type AS reason, count(*) + count(*) FILTER (event_id % 3 = 0) AS count FROM events GROUP BY 1")
def a7_reasons(spark, d):
    e = F.col("event_type")
    return aggregate.reason_counts(read(spark, d, "events").select(F.when(F.col("event_id") % 3 == 0, F.array(e, e)).otherwise(F.array(e)).alias("reasons")))


@query("SELECT user_id AS id, round(avg(value), 6) AS score FROM events GROUP BY 1")
def a10_mean_scores(spark, d):
    return aggregate.mean_score(read(spark, d, "events").select(F.col("user_id").alias("id"), F.col("value").alias("score"))).withColumn("score", F.round("score", 6))


@query("+ SELECT edge_id FROM edges WHERE relation IN ('PLACED', 'IN_REGION')", lines=False)
def t9_relation_filter(spark, d):
    return traverse.relation_filter(graph(spark, d, lines=False).edges, ["placed", "In_Region"]).select("edge_id")


@query("SELECT doc_id, 'mention-' || substr(sha256(doc_id || '|' || lower(trim(regexp_replace(substr(text, 1, 30), '\\s+', ' ', 'g'))) || '|' || lang), 1, 20) AS mention FROM documents")
def x10_mention_ids(spark, d):
    return read(spark, d, "documents").select("doc_id", extract.mention_id(F.substring("text", 1, 30), F.col("lang"), F.col("doc_id").cast("string")).alias("mention"))


@query("SELECT DISTINCT 't:' || p_type AS id FROM part")
def h2_extractable(spark, d):
    return registry.extractable(_registry(spark, d).types).select("id")


@query("SELECT c_custkey AS id, CASE WHEN c_custkey % 4 = 0 THEN 'unavailable' ELSE 'available' END AS applicability, CASE WHEN c_custkey % 4 <> 0 THEN least(1, c_custkey / 24) END AS normalised_value, CASE WHEN c_custkey % 4 = 0 THEN 'missing_input' END AS reason FROM customer")
def g17_observations(spark, d):
    c = read(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.when(F.col("c_custkey") % 4 != 0, F.col("c_custkey")).alias("v"))
    return catalogue.observations(c, "centrality.typed_weighted_degree", "v").select("id", "applicability", "normalised_value", "reason")


@query("SELECT 'evidence.all' AS method, 'missing_source_appraisal' AS reason UNION ALL SELECT 'temporal.all', 'missing_snapshot_history' UNION ALL SELECT 'community.all', 'missing_community_assignment'")
def g18_catalogue(spark, d):
    return catalogue.catalogue(spark).where("not available").select("method", "reason")


# --- search ---

@query("""+, h AS (SELECT 'node' AS kind, id, label, type, status, CASE WHEN starts_with(lower(label), 'small') THEN 0 ELSE 1 END AS rank, ord FROM ns WHERE contains(lower(label || ' ' || type), 'small'))
    SELECT kind, id, label, type, status, rank FROM h ORDER BY rank, lower(label), ord, id LIMIT 50""")
def r1_search(spark, d):
    return search.search(graph(spark, d), " Small ", 50)


_NAMES = ["customer:7", "SUPPLIER#000000003", "small ring", "nation_1", "Order 12", "no such thing"]
_VALUES = ", ".join(f"('{n}')" for n in _NAMES)


@query(f"""+, v AS (SELECT * FROM (VALUES {_VALUES}) t(value)), h AS (SELECT value, id, CASE WHEN id = value THEN 0 WHEN lower(label) = lower(value) THEN 1 ELSE 2 END AS tier, length(label) AS l, ord
    FROM v JOIN nodes n ON n.id = value OR contains(lower(n.label), lower(value))) SELECT value, id FROM (SELECT *, row_number() OVER (PARTITION BY value ORDER BY tier, CASE tier WHEN 2 THEN l ELSE 0 END, ord) AS k FROM h) WHERE k = 1""")
def r2_resolve_nodes(spark, d):
    return search.resolve_nodes(graph(spark, d), spark.createDataFrame([(n,) for n in _NAMES], "value string"))


_RELATION_NAMES = ["placed", "in region", "supplied", "nation", "zzz"]


@query(f"""+, v AS (SELECT * FROM (VALUES {", ".join(f"('{n}')" for n in _RELATION_NAMES)}) t(value)), r AS (SELECT DISTINCT relation FROM edges), h AS (SELECT value, relation,
    CASE WHEN lower(relation) = value THEN 0 WHEN translate(lower(relation), '_-', '  ') = translate(value, '_-', '  ') THEN 1 WHEN contains(lower(relation), value) THEN 2 END AS tier FROM v, r)
    SELECT value, arg_min(relation, ROW(tier, CASE tier WHEN 2 THEN length(relation) ELSE 0 END, relation)) AS relation FROM h WHERE tier IS NOT NULL GROUP BY 1""")
def r3_resolve_relations(spark, d):
    return search.resolve_relations(graph(spark, d), spark.createDataFrame([(n,) for n in _RELATION_NAMES], "value string"))


_TEXTS = [(1, "Is Customer#000000012 near nation_2 or NATION_24?"), (2, "nothing here"), (3, "Supplier#000000001 and small ring")]


@query("""+, t AS (SELECT * FROM (VALUES (1, 'is customer#000000012 near nation_2 or nation_24?'), (2, 'nothing here'), (3, 'supplier#000000001 and small ring')) t(key, text))
    SELECT key, id FROM (SELECT key, id, row_number() OVER (PARTITION BY key ORDER BY length(label) DESC, id DESC) AS k FROM t JOIN ns ON contains(text, lower(label)) WHERE status <> 'rejected') WHERE k = 1""")
def r4_mentions(spark, d):
    return search.mentioned(graph(spark, d), spark.createDataFrame(_TEXTS, "key int, text string"))


_QUOTE = "''"
_STOP = ", ".join(f"'{w}'" for w in STOPWORDS)


def _phrases_sql(key: str, text: str, table: str) -> str:
    """(key, phrases): quoted spans, then windows of four words down to one without a stopword at either end, each once, at most 40."""
    windows = ", ".join(f"list_transform(range(1, len(ws) - {n - 2}), lambda i: ws[i:i + {n - 1}])" for n in (4, 3, 2, 1))
    return f"""(SELECT {key}, list_filter(every, lambda x, i: list_position(every, x) = i)[:40] AS phrases FROM (SELECT {key}, list_concat(quoted, list_filter(list_transform(
        list_filter(flatten([{windows}]), lambda w: NOT list_contains([{_STOP}], lower(w[1])) AND NOT list_contains([{_STOP}], lower(w[-1]))), lambda w: array_to_string(w, ' ')), lambda p: length(p) >= 3)) AS every
        FROM (SELECT {key}, regexp_extract_all({text}, '["{_QUOTE}]([^"{_QUOTE}]{{2,100}})["{_QUOTE}]', 1) AS quoted, regexp_extract_all({text}, '[\\p{{L}}\\p{{N}}_{_QUOTE}&.\\-]+') AS ws FROM {table})))"""


@query(f"SELECT item_id, array_to_string(phrases, '|') AS phrases FROM {_phrases_sql('item_id', 'text', 'benchmark')}")
def r5_candidate_phrases(spark, d):
    return read(spark, d, "benchmark").select("item_id", F.concat_ws("|", candidate_phrases("text")).alias("phrases"))


def _resolve_sql(values: str) -> str:
    """CTEs from v (value) to best (value, id): by id, label, the shortest label that holds the value, and else by the likest label.

    The likeness is that of the sorted words: the longest common subsequence, a letter of the label to a step, on the bits of the value.
    """
    return f"""v AS ({values}), vv AS (SELECT DISTINCT value, trim(regexp_replace(value, '\\s+', ' ', 'g')) AS name, lower(trim(regexp_replace(value, '\\s+', ' ', 'g'))) AS low FROM v),
    h AS (SELECT value, id, CASE WHEN id = name THEN 0 WHEN lower(label) = low THEN 1 ELSE 2 END AS tier, length(label) AS l, ord FROM vv JOIN nodes n ON n.id = name OR contains(lower(n.label), low) WHERE name <> ''),
    direct AS (SELECT value, arg_min(id, ROW(tier, CASE tier WHEN 2 THEN l ELSE 0 END, ord)) AS id FROM h GROUP BY 1),
    x AS (SELECT value, array_to_string(list_sort(string_split(low, ' ')), ' ') AS x FROM vv WHERE length(low) >= 3 AND value NOT IN (SELECT value FROM direct)),
    y AS (SELECT id, ord, array_to_string(list_sort(list_filter(string_split_regex(lower(label), '\\s+'), lambda w: w <> '')), ' ') AS y FROM nodes),
    bits AS (SELECT value, substr(x, i, 1) AS c, sum(1::BIGINT << (i - 1))::BIGINT AS m FROM (SELECT value, x, unnest(range(1, length(x) + 1)) AS i FROM x) GROUP BY ALL),
    pairs AS (SELECT value, x, id, y, ord FROM x, y WHERE 200.0 * least(length(x), length(y)) / (length(x) + length(y)) >= 70),
    lcs(value, id, j, r) AS (SELECT value, id, 0, (1::BIGINT << length(x)) - 1 FROM pairs UNION ALL
        SELECT l.value, l.id, j + 1, ((l.r + (l.r & coalesce(m, 0))) | (l.r - (l.r & coalesce(m, 0)))) & ((1::BIGINT << length(x)) - 1) FROM lcs l JOIN pairs p ON p.value = l.value AND p.id = l.id LEFT JOIN bits b ON b.value = l.value AND b.c = substr(y, j + 1, 1) WHERE j < length(y)),
    near AS (SELECT p.value, p.id, p.ord, 200.0 * (length(x) - bit_count(r)) / (length(x) + length(y)) AS score FROM lcs l JOIN pairs p ON p.value = l.value AND p.id = l.id WHERE j = length(y)),
    best AS (SELECT * FROM direct UNION ALL SELECT value, arg_max(id, ROW(score, -ord)) FROM near WHERE score >= 70 GROUP BY 1)"""


_MISSPELT = ["Costumer#000000033", "natoin_7", "12 oder", "zzzzzz"]


@query("+, " + _resolve_sql(f"SELECT * FROM (VALUES {', '.join(f'({chr(39)}{n}{chr(39)})' for n in _MISSPELT)}) t(value)") + " SELECT * FROM best", recursive=True)
def r6_fuzzy_names(spark, d):
    return search.resolve_nodes(graph(spark, d), spark.createDataFrame([(n,) for n in _MISSPELT], "value string"), fuzzy=True)


_ABOUT = 'Is "Supplier#000000004" near NATION_3 and region_1 or Costumer#000000033?'


@query(f"+, q AS (SELECT 1 AS k, '{_ABOUT}' AS text), ph AS (SELECT unnest(phrases) AS phrase, generate_subscripts(phrases, 1) AS k FROM {_phrases_sql('k', 'text', 'q')}), " + _resolve_sql("SELECT phrase AS value FROM ph")
       + " SELECT phrase, best.id, label FROM ph JOIN best ON best.value = phrase JOIN nodes ON nodes.id = best.id", recursive=True)
def r7_question_nodes(spark, d):
    return search.question_nodes(graph(spark, d), _ABOUT)


@query("SELECT query_id, vec_id, k, distance, distance < 1 AS close FROM (SELECT q.vec_id AS query_id, v.vec_id, row_number() OVER (PARTITION BY q.vec_id ORDER BY d.distance, v.vec_id)::INTEGER AS k, d.distance FROM embeddings q, embeddings v, "
       "LATERAL (SELECT list_sum(list_transform(list_zip(q.embedding, v.embedding), lambda p: (p[1]::DOUBLE - p[2]::DOUBLE) * (p[1]::DOUBLE - p[2]::DOUBLE))) AS distance) d WHERE q.vec_id % 100 = 0) WHERE k <= 3")
def r8_nearest(spark, d):
    e = read(spark, d, "embeddings")
    return search.nearest(e.where("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), "embedding"), e)


@query("SELECT item_id AS key, (length(lower(text)) - length(replace(lower(text), 'the', ''))) // 3 + (length(lower(text)) - length(replace(lower(text), 'on', ''))) // 2 AS score FROM benchmark")
def r10_term_relevance(spark, d):
    return search.term_relevance(read(spark, d, "benchmark").select(F.col("item_id").alias("key"), "text"), ["the", "On"])


# --- traversal ---

@query("""+, l0 AS (SELECT 'nation:3' AS id, 0::BIGINT AS pos), deg AS (SELECT node AS id, count(*) AS degree FROM kadj GROUP BY 1),
    l1 AS (SELECT neighbour AS id, row_number() OVER (ORDER BY min(ROW(-degree, ord, edge_id))) AS pos FROM kadj k JOIN deg ON deg.id = k.neighbour WHERE node = 'nation:3' AND neighbour <> 'nation:3' GROUP BY neighbour),
    l2 AS (SELECT neighbour AS id, (SELECT count(*) FROM l1) + row_number() OVER (ORDER BY min(ROW(p.pos, -degree, k.ord, edge_id))) AS pos FROM kadj k JOIN l1 p ON p.id = k.node JOIN deg ON deg.id = k.neighbour WHERE neighbour NOT IN (SELECT id FROM l1) AND neighbour <> 'nation:3' GROUP BY neighbour)
    SELECT id, pos FROM (SELECT * FROM l0 UNION ALL SELECT * FROM l1 UNION ALL SELECT * FROM l2) WHERE pos < 200""")
def t1_slice_from_focus(spark, d):
    return traverse.graph_slice(graph(spark, d), "nation:3", depth=2, limit=200)["nodes"].select("id", "pos")


@query("""+, deg AS (SELECT node AS id, count(*) AS degree FROM kadj GROUP BY 1), seeds AS (SELECT id, row_number() OVER (ORDER BY coalesce(degree, 0) DESC, ord, id) AS seed FROM ns LEFT JOIN deg USING (id) WHERE status <> 'rejected'),
    keys AS (SELECT id, ROW(seed, 0, 0, 0, '') AS key FROM seeds UNION ALL SELECT neighbour, ROW(seed, 1, -degree, k.ord, edge_id) FROM kadj k JOIN seeds s ON s.id = k.node JOIN deg ON deg.id = k.neighbour WHERE seed <= 100)
    SELECT id, row_number() OVER (ORDER BY key) - 1 AS pos FROM (SELECT id, min(key) AS key FROM keys GROUP BY 1) ORDER BY pos LIMIT 100""")
def t2_slice_of_hubs(spark, d):
    return traverse.graph_slice(graph(spark, d), "", limit=100)["nodes"].select("id", "pos")


@query("""+, walk(id, depth) AS (SELECT 'customer:1', 0 UNION SELECT neighbour, depth + 1 FROM walk JOIN kadj ON node = id WHERE depth < 3) SELECT id, min(depth) AS depth FROM walk GROUP BY 1""", recursive=True)
def t3_k_hop(spark, d):
    return traverse.k_hop(graph(spark, d), "customer:1", 3).select("id", "depth")


def _levels(name: str, start: str, rounds: int) -> str:
    """CTEs name_0 … of the nodes that a start reaches, level by level, and name (id, depth)."""
    steps = [f"{name}_0 AS MATERIALIZED (SELECT '{start}' AS id, 0 AS depth WHERE '{start}' IN (SELECT id FROM ns WHERE status <> 'rejected'))"]
    for k in range(1, rounds + 1):
        steps.append(f"{name}_{k} AS MATERIALIZED (SELECT * FROM {name}_{k - 1} UNION ALL SELECT DISTINCT neighbour, {k} FROM kadj JOIN {name}_{k - 1} p ON p.id = node AND p.depth = {k - 1} WHERE neighbour NOT IN (SELECT id FROM {name}_{k - 1}))")
    return ", ".join([*steps, f"{name} AS (SELECT * FROM {name}_{rounds})"])


def _path_sql(start: str, end: str) -> str:
    """CTEs up to path (pos, id, edge_id, label): at each node the first edge, by order and id, to a node on a shortest path of at most six edges."""
    return f"""{_levels('fa', start, 6)}, {_levels('fb', end, 6)}, goal AS (SELECT depth FROM fa WHERE id = '{end}'), onpath AS MATERIALIZED (SELECT fa.id, fa.depth FROM fa JOIN fb USING (id) WHERE fa.depth + fb.depth = (SELECT depth FROM goal)),
    step AS MATERIALIZED (SELECT a.id, arg_min(ROW(k.neighbour, k.edge_id), ROW(k.ord, k.edge_id, k.neighbour)) AS n FROM onpath a JOIN kadj k ON k.node = a.id JOIN onpath b ON b.id = k.neighbour AND b.depth = a.depth + 1 GROUP BY 1),
    path(pos, id, edge_id) AS (SELECT 0, id, NULL::VARCHAR FROM onpath WHERE depth = 0 UNION ALL SELECT pos + 1, n[1], n[2] FROM path JOIN step USING (id))"""


@query(f"+, {_path_sql('orders:7', 'nation:5')} SELECT * FROM path", recursive=True)
def t4_shortest_path(spark, d):
    path = traverse.shortest_path(graph(spark, d), "orders:7", "nation:5")
    return spark.createDataFrame([(k, i, ([None, *path[1]])[k]) for k, i in enumerate(path[0])] if path else [], "pos int, id string, edge_id string")


@query(f"+, {_levels('fa', 'orders:7', 5)} SELECT min(depth) + 1 AS hops FROM fa JOIN kadj ON node = id WHERE relation = 'IN_REGION' HAVING count(*) > 0")
def t8_hops_to_relation(spark, d):
    hops = traverse.hops_to_relation(graph(spark, d), "orders:7", "in region", 6)
    return spark.createDataFrame([(hops,)] if hops else [], "hops int")


@query("""+, walk(id, depth) AS (SELECT 'supplier:3', 0 UNION SELECT neighbour, depth + 1 FROM walk JOIN kadj ON node = id WHERE depth < 2), dist AS (SELECT id, min(depth) AS depth FROM walk GROUP BY 1)
    SELECT DISTINCT edge_id, 2 AS hops FROM kadj JOIN dist ON node = id WHERE relation = 'IN_REGION' AND depth = 1""", recursive=True)
def t5_relation_hops(spark, d):
    got = traverse.relation_hops(graph(spark, d), "supplier:3", "in region")
    return got["matches"].select("edge_id", F.lit(got["hops"]).alias("hops")) if got else spark.createDataFrame([], "edge_id string, hops int")


@query("""+, walk(id, depth) AS (SELECT 'region:0', 0 UNION SELECT neighbour, depth + 1 FROM walk JOIN kadj ON node = id WHERE depth < 4 AND neighbour <> 'nation:5') SELECT id, min(depth) AS depth FROM walk GROUP BY 1 HAVING min(depth) > 0""", recursive=True)
def t6_reachable(spark, d):
    p = projection(graph(spark, d))
    return traverse.reachable(p.neighbours(), spark.createDataFrame([("region:0", "region:0")], "root string, id string"), 4, excluded_node="nation:5").select("id", "depth")


@query("""+, walk(id, depth) AS (SELECT 'nation:4', 0 UNION SELECT neighbour, depth + 1 FROM walk JOIN kadj ON node = id WHERE depth < 1), dist AS (SELECT id, min(depth) AS depth FROM walk GROUP BY 1)
    SELECT edge_id, min(depth) + 1 AS hop, ord FROM kadj JOIN dist ON node = id GROUP BY ALL ORDER BY hop, ord, edge_id LIMIT 500""".replace("GROUP BY ALL ORDER", "GROUP BY edge_id, ord ORDER"), recursive=True)
def t7_bounded_subgraph(spark, d):
    return traverse.bounded_subgraph(graph(spark, d), "nation:4", 2).select("edge_id", "hop", "ord")


@query("""+, walk(id, depth) AS (SELECT id, 0 FROM nodes WHERE id IN ('nation:1', 'nation:2', 'region:0') UNION SELECT neighbour, depth + 1 FROM walk JOIN kadj ON node = id WHERE depth < 2) SELECT count(DISTINCT id) AS covered FROM walk""", recursive=True)
def t10_coverage(spark, d):
    g = graph(spark, d)
    return traverse.coverage(g.adjacency(g.retained_edges()), spark.createDataFrame([("nation:1",), ("nation:2",), ("region:0",)], "id string"), 2)


@query("""+, m(id) AS (VALUES ('nation:1'), ('nation:2'), ('region:0')), walk(root, id, depth) AS (SELECT id, id, 0 FROM m UNION SELECT root, neighbour, depth + 1 FROM walk JOIN (SELECT DISTINCT node, neighbour FROM kadj) ON node = id WHERE depth < 2),
    reach AS (SELECT DISTINCT root, id FROM walk), f AS (SELECT round, id, arg_min(root, ROW(md5('7|' || round || '|' || root), root)) AS root FROM reach, range(1, 21) t(round) GROUP BY ALL),
    g AS (SELECT root, count(*) / 20.0 AS score FROM f GROUP BY 1) SELECT m.id, round(coalesce(score, 0), 9)::DOUBLE AS score FROM m LEFT JOIN g ON root = m.id""".replace("GROUP BY ALL)", "GROUP BY round, id)"), recursive=True)
def t11_marginal_coverage(spark, d):
    g = graph(spark, d)
    return traverse.marginal_coverage(g.adjacency(g.retained_edges()), spark.createDataFrame([("nation:1",), ("nation:2",), ("region:0",)], "id string"), 2).withColumn("score", F.round("score", 9))


# --- metrics ---

#: The nodes and edges of the projection, and its distinct undirected pairs.
_PROJECTED = "pn AS MATERIALIZED (SELECT id FROM ns WHERE status <> 'rejected'), o AS MATERIALIZED (SELECT DISTINCT source, target FROM kept), u AS MATERIALIZED (SELECT source AS a, target AS b FROM o UNION SELECT target, source FROM o)"


def _rank_sql(rounds: int, restart: str = "1.0::DOUBLE / (SELECT count(*) FROM pn)") -> str:
    """CTEs up to ranked (id, rank) after so many rounds."""
    steps = ["c AS MATERIALIZED (SELECT source, count(*) AS n FROM o GROUP BY 1)", f"base AS MATERIALIZED (SELECT id, {restart} AS restart, id NOT IN (SELECT source FROM o) AS dangling FROM pn)",
             "r0 AS MATERIALIZED (SELECT id, 1.0::DOUBLE / (SELECT count(*) FROM pn) AS rank FROM pn)"]
    for k in range(1, rounds + 1):
        steps.append(f"""r{k} AS MATERIALIZED (SELECT b.id, restart * (0.15 + 0.85 * (SELECT coalesce(sum(rank), 0) FROM r{k - 1} JOIN base USING (id) WHERE dangling)) + coalesce(g.got, 0) AS rank
            FROM base b LEFT JOIN (SELECT o.target AS id, sum(0.85 * rank / c.n) AS got FROM o JOIN c USING (source) JOIN r{k - 1} r ON r.id = o.source GROUP BY 1) g USING (id))""")
    return ", ".join([*steps, f"ranked AS (SELECT id, round(rank / (SELECT sum(rank) FROM r{rounds}), 9) AS rank FROM r{rounds})"])


def _component_sql(name: str, pairs: str, rounds: int) -> str:
    """CTEs up to name (id, component): least ids spread for so many rounds, which must be no fewer than the longest distance; halved by jumps."""
    steps = [f"{name}_0 AS MATERIALIZED (SELECT id, id AS component FROM pn)"]
    for k in range(1, rounds + 1):
        near = f"SELECT p.id, least(p.component, coalesce(min(q.component), p.component)) AS component FROM {name}_{k - 1} p LEFT JOIN {pairs} e ON e.a = p.id LEFT JOIN {name}_{k - 1} q ON q.id = e.b GROUP BY p.id, p.component"
        steps.append(f"{name}_{k} AS MATERIALIZED ({near})")
    return ", ".join([*steps, f"{name} AS MATERIALIZED (SELECT * FROM {name}_{rounds})"])


def _bridge_sql(deepest: int) -> str:
    """CTEs up to bridge (a, b): edges of a breadth-first forest across which no other edge's random bits go.

    Every edge off the forest gets 64 bits of a hash. Exclusive or of the bits at the nodes of a subtree leaves those of the edges that leave
    it; where that is 0, the forest edge above the subtree is the only way out.
    """
    steps = ["l0 AS MATERIALIZED (SELECT id, 0 AS depth FROM pn WHERE id IN (SELECT component FROM comp))"]
    steps += [f"l{k} AS MATERIALIZED (SELECT * FROM l{k - 1} UNION ALL SELECT DISTINCT b, {k} FROM u JOIN l{k - 1} p ON p.id = a AND p.depth = {k - 1} WHERE b NOT IN (SELECT id FROM l{k - 1}))" for k in range(1, deepest + 1)]
    steps += [f"tree AS MATERIALIZED (SELECT c.id, min(p.id) AS parent, any_value(c.depth) AS depth FROM l{deepest} c JOIN u ON u.a = c.id JOIN l{deepest} p ON p.id = u.b AND p.depth = c.depth - 1 GROUP BY c.id)",
              "loose AS MATERIALIZED (SELECT a, b, hash(a || '>' || b) AS bits FROM u WHERE a < b AND NOT EXISTS (SELECT 1 FROM tree WHERE id = a AND parent = b) AND NOT EXISTS (SELECT 1 FROM tree WHERE id = b AND parent = a))",
              f"x{deepest + 1} AS MATERIALIZED (SELECT id, bit_xor(bits) AS bits FROM (SELECT a AS id, bits FROM loose UNION ALL SELECT b, bits FROM loose UNION ALL SELECT id, 0::UBIGINT FROM pn) GROUP BY 1)"]
    steps += [f"x{k} AS MATERIALIZED (SELECT id, bit_xor(bits) AS bits FROM (SELECT * FROM x{k + 1} UNION ALL SELECT parent, bits FROM x{k + 1} JOIN tree USING (id) WHERE depth = {k}) GROUP BY 1)" for k in range(deepest, 0, -1)]
    return ", ".join([*steps, "bridge AS MATERIALIZED (SELECT least(id, parent) AS a, greatest(id, parent) AS b FROM tree JOIN x1 USING (id) WHERE bits = 0)"])


@query(f"+, {_PROJECTED}, {_rank_sql(8)} SELECT * FROM ranked")
def g1_pagerank(spark, d):
    return metrics.pagerank(projection(graph(spark, d)), iterations=8).withColumn("rank", F.round("rank", 9))


@query(f"+, {_PROJECTED}, {_rank_sql(80)} SELECT * FROM ranked")
def g1_converged(spark, d):
    """As many rounds as bring the sum of all changes below 10^-6 on the test tables."""
    return metrics.pagerank(projection(graph(spark, d)), tolerance=0.0, iterations=80).withColumn("rank", F.round("rank", 9))


@query(f"+, {_PROJECTED}, {_rank_sql(12, "CASE WHEN id = 'customer:2' THEN 1.0::DOUBLE ELSE 0 END")} SELECT * FROM ranked")
def g2_seeded_pagerank(spark, d):
    return metrics.pagerank(projection(graph(spark, d)), seeds=spark.createDataFrame([("customer:2",)], "id string"), iterations=12).withColumn("rank", F.round("rank", 9))


@query(f"+, {_PROJECTED}, {_component_sql('comp', 'u', 14)} SELECT * FROM comp")
def g3_components(spark, d):
    return metrics.components(projection(graph(spark, d)))


@query()
def g4_cut_vertices(spark, d):
    return metrics.cut_vertices(projection(graph(spark, d)))


@query(f"+, {_PROJECTED}, {_component_sql('comp', 'u', 14)}, {_bridge_sql(12)} SELECT a AS source, b AS target FROM bridge")
def g5_bridges(spark, d):
    return metrics.bridges(projection(graph(spark, d)))


def _between_sql(relations: str, deepest: int) -> str:
    """CTEs up to share (id, s): what each root's shortest paths lend to the nodes between, summed over all roots."""
    steps = [f"e AS MATERIALIZED (SELECT DISTINCT source AS a, target AS b FROM kept WHERE relation IN ({relations}) UNION SELECT DISTINCT target, source FROM kept WHERE relation IN ({relations}))",
             "d0 AS MATERIALIZED (SELECT DISTINCT a AS root, a AS id, 0 AS depth, 1.0::DOUBLE AS ways FROM e)"]
    steps += [f"d{k} AS MATERIALIZED (SELECT * FROM d{k - 1} UNION ALL SELECT p.root, e.b, {k}, sum(p.ways) FROM d{k - 1} p JOIN e ON e.a = p.id WHERE p.depth = {k - 1} AND (p.root, e.b) NOT IN (SELECT (root, id) FROM d{k - 1}) GROUP BY p.root, e.b)" for k in range(1, deepest + 1)]
    steps = [x.replace("(p.root, e.b) NOT IN (SELECT (root, id) FROM", "NOT EXISTS (SELECT 1 FROM").replace("FROM d%d) GROUP" % (k - 1), "FROM d%d z WHERE z.root = p.root AND z.id = e.b) GROUP" % (k - 1)) if k else x for k, x in zip([0, 0, *range(1, deepest + 1)], steps, strict=True)]
    steps.append(f"w{deepest} AS MATERIALIZED (SELECT root, id, 0.0::DOUBLE AS lent FROM d{deepest} WHERE depth = {deepest})")
    steps += [f"""w{k} AS MATERIALIZED (SELECT p.root, p.id, coalesce(sum(p.ways / c.ways * (1 + w.lent)), 0) AS lent FROM d{deepest} p LEFT JOIN e ON e.a = p.id LEFT JOIN d{deepest} c ON c.root = p.root AND c.id = e.b AND c.depth = {k + 1}
        LEFT JOIN w{k + 1} w ON w.root = c.root AND w.id = c.id WHERE p.depth = {k} GROUP BY p.root, p.id)""" for k in range(deepest - 1, 0, -1)]
    union = " UNION ALL ".join(f"SELECT id, lent FROM w{k}" for k in range(1, deepest + 1))
    return ", ".join([*steps, f"share AS (SELECT id, sum(lent) AS s FROM ({union}) GROUP BY 1)"])


@query(f"""+, {_PROJECTED}, {_between_sql("'IN_NATION', 'IN_REGION'", 4)}
    SELECT pn.id, round(coalesce(s, 0) / (((SELECT count(*) FROM pn) - 1.0) * ((SELECT count(*) FROM pn) - 2.0)), 9) AS betweenness FROM pn LEFT JOIN share USING (id)""")
def g6_betweenness(spark, d):
    return metrics.betweenness(projection(graph(spark, d)), ["IN_NATION", "IN_REGION"]).withColumn("betweenness", F.round("betweenness", 9))


def _core_sql(rounds: int) -> str:
    """CTEs up to core (id, core) by rounds of h-indices of the neighbours' estimates."""
    steps = ["c0 AS MATERIALIZED (SELECT a AS id, count(*) AS core FROM u GROUP BY 1)"]
    steps += [f"c{k} AS MATERIALIZED (SELECT id, max(least(c, n)) AS core FROM (SELECT a AS id, core AS c, row_number() OVER (PARTITION BY a ORDER BY core DESC) AS n FROM u JOIN c{k - 1} x ON x.id = u.b) GROUP BY 1)" for k in range(1, rounds + 1)]
    return ", ".join([*steps, f"core AS (SELECT * FROM c{rounds})"])


@query(f"+, {_PROJECTED}, {_core_sql(48)} SELECT id, coalesce(core, 0) AS core FROM pn LEFT JOIN core USING (id)")
def g7_core_numbers(spark, d):
    return metrics.core_numbers(projection(graph(spark, d)))


@query(f"""+, {_PROJECTED}, walk(root, id, depth) AS (SELECT id, id, 0 FROM pn WHERE starts_with(id, 'region') UNION SELECT root, b, depth + 1 FROM walk JOIN u ON a = id WHERE depth < 12),
    far AS (SELECT root, id, min(depth) AS depth FROM walk GROUP BY ALL) SELECT root AS id, round(coalesce(sum(1.0 / depth) FILTER (depth > 0), 0) / ((SELECT count(*) FROM pn) - 1), 9) AS harmonic FROM far GROUP BY 1""", recursive=True)
def g8_harmonic(spark, d):
    p = projection(graph(spark, d))
    return metrics.harmonic(p, p.nodes.where(F.startswith("id", F.lit("region")))).withColumn("harmonic", F.round("harmonic", 9))


_FUSED = "f AS (SELECT DISTINCT source, relation, target FROM kept), inc AS (SELECT source AS node, 'out' AS direction, relation, target AS other FROM f UNION ALL SELECT target, 'in', relation, source FROM f)"
_GROUPS = {"IN_NATION": "place", "IN_REGION": "place", "PLACED": "trade", "SUPPLIED_BY": "trade"}
_CASE = "CASE relation WHEN 'IN_NATION' THEN 'place' WHEN 'IN_REGION' THEN 'place' WHEN 'PLACED' THEN 'trade' WHEN 'SUPPLIED_BY' THEN 'trade' ELSE 'unmapped' END"


@query(f"+, {_FUSED} SELECT n.id, coalesce(sum(CASE WHEN relation IN ('PLACED') THEN 1.0 WHEN relation IS NOT NULL THEN 0.5 END), 0)::DOUBLE AS weighted FROM ns n LEFT JOIN inc ON node = id WHERE status <> 'rejected' GROUP BY 1")
def g9_weighted_degree(spark, d):
    return metrics.weighted_degree(projection(graph(spark, d)), {"placed": 1.0})


@query("""+, one AS (SELECT DISTINCT node, neighbour FROM kadj), two AS (SELECT node AS id, neighbour AS x FROM one UNION SELECT a.node, b.neighbour FROM one a JOIN one b ON b.node = a.neighbour)
    SELECT n.id, count(x) FILTER (x <> n.id) AS reach FROM ns n LEFT JOIN two USING (id) WHERE n.type = 'Supplier' AND n.status <> 'rejected' GROUP BY 1""")
def g10_two_hop_reach(spark, d):
    p = projection(graph(spark, d))
    return metrics.two_hop_reach(p, p.nodes.where("type = 'Supplier'"))


@query(f"+, {_FUSED}, c AS (SELECT node AS id, {_CASE} AS g, count(*) AS n FROM inc GROUP BY ALL) SELECT id, round(1 - sum(n * n)::DOUBLE / (sum(n) * sum(n)), 9) AS participation FROM c GROUP BY 1")
def g11_participation(spark, d):
    return metrics.participation(projection(graph(spark, d)), _GROUPS).withColumn("participation", F.round("participation", 9))


@query(f"+, {_FUSED} SELECT node AS id, direction || ':' || relation AS role, count(*) AS count FROM inc GROUP BY ALL")
def g12_roles(spark, d):
    return metrics.roles(projection(graph(spark, d)))


@query(f'+, {_FUSED} SELECT node AS id, {_CASE} AS "group", count(*) AS degree FROM inc GROUP BY ALL')
def g13_group_degrees(spark, d):
    return metrics.group_degrees(projection(graph(spark, d)), _GROUPS)


@query(f"""+, {_FUSED}, e AS (SELECT node, other, {_CASE} AS g, least(node, other) || relation || greatest(node, other) AS i FROM inc)
    SELECT a.node AS id, a.g AS first, b.g AS second, count(DISTINCT b.other) AS reach, count(*) AS walks FROM e a JOIN e b ON b.node = a.other WHERE starts_with(a.node, 'nation') AND a.i <> b.i AND b.other <> a.node AND a.g <> b.g GROUP BY ALL""")
def g14_group_sequences(spark, d):
    p = projection(graph(spark, d))
    return metrics.group_sequences(p, _GROUPS, p.nodes.where("type = 'Nation'"))


@query(f"""+, {_PROJECTED}, {_component_sql('comp', 'u', 14)}, z AS (SELECT component, count(*) AS size FROM comp GROUP BY 1)
    SELECT id, component, size, round((size - 1) / greatest(1, (SELECT count(*) FROM pn) - 1), 9)::DOUBLE AS share FROM comp JOIN z USING (component)""")
def g15_component_share(spark, d):
    return metrics.component_sizes(projection(graph(spark, d))).withColumn("share", F.round("share", 9))


@query(f"""+, {_PROJECTED}, {_component_sql('comp', 'u', 14)}, {_bridge_sql(12)}, inner_pairs AS MATERIALIZED (SELECT a, b FROM u WHERE NOT EXISTS (SELECT 1 FROM bridge x WHERE x.a = least(u.a, u.b) AND x.b = greatest(u.a, u.b))), {_component_sql('apart', 'inner_pairs', 24)},
    n AS (SELECT component, count(*) AS n FROM comp GROUP BY 1), m AS (SELECT component, count(*) AS m FROM apart GROUP BY 1)
    SELECT comp.id, round(CASE WHEN n > 1 THEN (m - 1) / (n - 1) ELSE 0 END, 9)::DOUBLE AS diversity FROM comp JOIN n ON n.component = comp.component JOIN apart ON apart.id = comp.id JOIN m ON m.component = apart.component""")
def g16_path_diversity(spark, d):
    return metrics.path_diversity(projection(graph(spark, d))).withColumn("diversity", F.round("diversity", 9))


# --- documents to triples ---

@query("SELECT doc_id, CASE WHEN contains(substr(text, 1, 4000), 'GNU General') THEN 'gpl' WHEN contains(substr(text, 1, 4000), 'MIT') OR contains(substr(text, 1, 4000), 'Apache') THEN 'loose' ELSE 'general' END AS profile FROM documents")
def x2_profile(spark, d):
    return read(spark, d, "documents").select("doc_id", extract.profile("text", {"gpl": ["GNU General"], "loose": ["MIT", "Apache"]}).alias("profile"))


@query("SELECT o_orderkey AS k, CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE 'D-' || o_orderkey END AS doc_id, 'Order of ' || o_custkey AS title, strftime(o_orderdate, '%Y-%m-%d') AS doc_date FROM orders")
def x1_header(spark, d):
    o = read(spark, d, "orders")
    text = F.concat(F.lit("HEAD\n"), F.when(F.col("o_orderkey") % 3 == 0, F.lit("")).otherwise(F.concat(F.lit("DOCUMENT ID : D-"), "o_orderkey", F.lit("\n"))), F.lit("TITLE: Order of "), "o_custkey", F.lit("  \nDATE: "), F.date_format("o_orderdate", "yyyy-MM-dd"), F.lit("\nTITLE: second\nbody: x"))
    h = extract.header(text)
    return o.select(F.col("o_orderkey").alias("k"), h["doc_id"].alias("doc_id"), h["doc_title"].alias("title"), h["doc_date"].alias("doc_date"))


#: Bytes of text, as a power of two, whose records make up a partition: some hundred times as much, which a task can sort in memory.
_RECORDS_POWER = 20


def _records(spark, d) -> DataFrame:
    """Extraction records made of all words of each text: entities of every fifth word, and relationships between all neighbours.

    The texts are dealt out by document before they become words, so that what is done by document moves no words.
    """
    docs = read(spark, d, "documents").where("text is not null").select("doc_id", "text")
    docs = docs.repartition(((docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0) >> _RECORDS_POWER) + 1, "doc_id").withColumn("ws", F.filter(F.split("text", r"[\x20\t-\r]+"), lambda w: w != ""))
    n = F.size("ws").cast("long").alias("n")
    words = docs.select("doc_id", n, F.posexplode(F.arrays_zip(F.col("ws").alias("a"), F.expr("slice(ws, 2, size(ws))").alias("b"))).alias("i", "p")).select("doc_id", "n", "i", "p.a", "p.b")
    nowhere = F.lit(None).cast("int")
    ent = words.where("i % 5 = 0").select("doc_id", F.lit("entity").alias("class"), F.col("a").alias("text"), F.create_map(F.lit("type"), F.when(F.col("i") % 10 == 0, F.lit("word")).otherwise(F.lit("other"))).alias("attributes"), nowhere.alias("char_start"), nowhere.alias("char_end"), F.col("i").cast("long").alias("ord"))
    rel = words.where("i = 0 or b is not null").select("doc_id", F.lit("relationship"), "a", F.create_map(F.lit("subject"), "a", F.lit("predicate"), F.lit("followed by"), F.lit("object"), "b"), nowhere, nowhere, F.col("n") + F.col("i"))
    return ent.union(rel)


#: e: entities of a document, each once by its word in lower case; r: neighbours, each pair once, with the first place and spelling.
_WORDS = r"""w AS MATERIALIZED (SELECT doc_id, unnest(ws) AS w, generate_subscripts(ws, 1) - 1 AS i FROM (SELECT doc_id, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS ws FROM documents)),
    e AS (SELECT doc_id, lower(w) AS k, arg_min(w, i) AS subject, coalesce(max(CASE WHEN i % 10 = 0 THEN 'word' END), 'unknown') AS object FROM w WHERE i % 5 = 0 GROUP BY doc_id, lower(w)),
    r AS (SELECT x.doc_id, arg_min(x.w, x.i) AS a, arg_min(y.w, x.i) AS b FROM w x JOIN w y ON y.doc_id = x.doc_id AND y.i = x.i + 1 GROUP BY x.doc_id, lower(x.w), lower(y.w)),
    t AS (SELECT doc_id, subject, 'instance_of' AS predicate, object FROM e UNION ALL SELECT doc_id, a, 'FOLLOWED_BY', b FROM r)"""
_BARE = r"'(?i)(?:UAH|USD|EUR|GBP)?\s*\d[\d\s.,/-]*\s*(?:%|million|billion|thousand|MW|kV|minutes|hours|days|years)?'"


@query(f"WITH {_WORDS} SELECT * FROM t")
def x3_triples(spark, d):
    return extract.triples(_records(spark, d), ["word"]).select("doc_id", "subject", "predicate", "object")


@query(f"WITH {_WORDS} SELECT * FROM t WHERE NOT regexp_full_match(trim(subject), {_BARE}) AND (predicate = 'instance_of' OR NOT regexp_full_match(trim(object), {_BARE}))")
def x4_filtered(spark, d):
    return extract.filtered(extract.triples(_records(spark, d), ["word"]), ["FOLLOWED_BY"])[0].select("doc_id", "subject", "predicate", "object")


@query(f"WITH {_WORDS} SELECT lower(a) AS source, 'FOLLOWED_BY' AS relation, lower(b) AS target, CAST(doc_id AS VARCHAR) AS document FROM r")
def x5_triple_graph(spark, d):
    return extract.triples_to_graph(extract.triples(_records(spark, d), ["word"])).edges.select("source", "relation", "target", F.element_at("attrs", "source_document").alias("document"))


@query(r"""WITH p AS (SELECT doc_id, text, length(text) // 2 AS s FROM documents WHERE length(text) > 0), l AS (SELECT doc_id, regexp_extract_all(substr(text, 1, s), '[^\x20\x09-\x0D]+') AS a, regexp_extract_all(substr(text, s + 1, 10), '[^\x20\x09-\x0D]+') AS m,
    regexp_extract_all(substr(text, s + 11), '[^\x20\x09-\x0D]+') AS z FROM p) SELECT doc_id, CASE WHEN len(a) > 25 THEN '…' ELSE '' END || array_to_string(list_concat(a[greatest(len(a) - 24, 1):], m, z[:25]), ' ') || CASE WHEN len(z) > 25 THEN '…' ELSE '' END AS excerpt FROM l""")
def x6_excerpt_words(spark, d):
    half = F.floor(F.length("text") / 2).cast("int")
    return read(spark, d, "documents").where("length(text) > 0").select("doc_id", excerpt_words("text", half, half + 10).alias("excerpt"))


@query(r"""WITH p AS (SELECT doc_id, text, length(text) AS n, length(text) // 2 AS s FROM documents WHERE length(text) > 0), q AS (SELECT *, greatest(s - 180, 0) AS low, least(s + 10 + 180, n) AS high FROM p), b AS (SELECT *, substr(text, low + 1, high - low) AS body FROM q),
    c AS (SELECT *, CASE WHEN low > 0 THEN regexp_replace(body, '^[^ ]* ', '') ELSE body END AS c FROM b), e AS (SELECT *, CASE WHEN high < n THEN regexp_replace(c, ' [^ ]*$', '') ELSE c END AS e FROM c)
    SELECT doc_id, CASE WHEN low > 0 THEN '…' ELSE '' END || trim(regexp_replace(e, '\s+', ' ', 'g')) || CASE WHEN high < n THEN '…' ELSE '' END AS excerpt FROM e""")
def x7_excerpt_chars(spark, d):
    half = F.floor(F.length("text") / 2).cast("int")
    return read(spark, d, "documents").where("length(text) > 0").select("doc_id", excerpt_chars("text", half, half + 10).alias("excerpt"))


@query("SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN true WHEN 1 THEN length(text) = 0 ELSE length(text) >= 1 END AS grounded FROM documents WHERE text IS NOT NULL")
def x8_grounding(spark, d):
    docs = read(spark, d, "documents").where("text is not null")
    k = F.col("doc_id") % 3
    quote = F.when(k == 0, F.substring("text", 5, 7)).when(k == 1, F.when(F.length("text") == 0, F.lit("")).otherwise(F.concat(F.substring("text", 5, 7), F.lit("#")))).otherwise(F.substring("text", 1, 1))
    start = F.when(k < 2, F.lit(4))
    rec = docs.select("doc_id", F.lit("entity").alias("class"), quote.alias("text"), F.expr("cast(map() as map<string,string>)").alias("attributes"), start.cast("int").alias("char_start"), F.when(k < 2, F.lit(11)).cast("int").alias("char_end"), F.lit(0).alias("ord"))
    return extract.grounded(rec, docs).select("doc_id", "grounded")


@query("SELECT doc_id, CASE WHEN doc_id % 2 = 1 THEN 'object_text' END AS unquoted FROM documents")
def x9_verbatim(spark, d):
    docs = read(spark, d, "documents")
    rec = docs.select("doc_id", F.lit("relationship").alias("class"), F.lit("").alias("text"), F.create_map(F.lit("subject_text"), F.substring("text", 2, 9), F.lit("object_text"), F.when(F.col("doc_id") % 2 == 1, "not \u0001 there").otherwise("")).alias("attributes"))
    return extract.unquoted(rec, docs).select("doc_id", "unquoted")


@query("SELECT l_orderkey AS doc_id, l_quantity::BIGINT * 7 AS at, coalesce((SELECT max(m.l_linenumber) FROM lineitem m WHERE m.l_orderkey = l.l_orderkey AND m.l_linenumber * 60 <= l.l_quantity::BIGINT * 7), 0) AS page FROM lineitem l")
def x11_pages(spark, d):
    x = read(spark, d, "lineitem")
    marks = x.select(F.col("l_orderkey").alias("doc_id"), (F.col("l_linenumber") * 60).cast("long").alias("offset"), F.col("l_linenumber").alias("page"))
    return extract.pages_of(x.select(F.col("l_orderkey").alias("doc_id"), (F.col("l_quantity").cast("long") * 7).alias("offset")), marks).select("doc_id", F.col("offset").alias("at"), "page")


@query("SELECT doc_id, strpos(text, substr(text, length(text) // 2 + 1, 60)) - 1 AS start FROM documents WHERE length(text) > 0")
def x12_recovered_spans(spark, d):
    half = F.floor(F.length("text") / 2).cast("int")
    docs = read(spark, d, "documents").where("length(text) > 0").withColumn("half", half)
    start, _ = extract.recovered_span(F.col("text"), F.expr("substring(text, half + 1, 60)"), F.lit(None).cast("int"), F.lit(None).cast("int"))
    return docs.select("doc_id", start.cast("long").alias("start"))


@query("SELECT doc_id, k::INTEGER AS k, substr(text, k * 1500 + 1, 1500) AS chunk FROM (SELECT doc_id, text, unnest(range(0, (length(text) + 1499) // 1500)) AS k FROM documents WHERE length(text) > 0)")
def x14_chunks(spark, d):
    return extract.chunks(read(spark, d, "documents"))


@query(r"""WITH q AS (SELECT doc_id, text, list_filter(string_split_regex(trim(substr(text, 4, 40)), '\s+'), lambda w: w <> '') AS ws FROM documents)
    SELECT doc_id, nullif(regexp_extract(text, array_to_string(list_transform(ws, lambda w: regexp_escape(w)), '\s+')), '') AS found FROM q""")
def x15_located_quotes(spark, d):
    return read(spark, d, "documents").select("doc_id", extract.located(F.col("text"), F.regexp_replace(F.substring("text", 4, 40), r"\s+", "  \n")).alias("found"))


@query("""WITH RECURSIVE p AS (SELECT p_brand AS pass, p_partkey AS ord, p_name AS id, p_size * 100 AS size, row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) AS n FROM part),
    f(pass, n, shard, used) AS (SELECT pass, n, 0, size::BIGINT FROM p WHERE n = 1 UNION ALL SELECT f.pass, p.n, shard + CASE WHEN used > 0 AND used + size > 6000 THEN 1 ELSE 0 END, CASE WHEN used > 0 AND used + size > 6000 THEN size ELSE used + size END
        FROM f JOIN p ON p.pass = f.pass AND p.n = f.n + 1) SELECT p.pass, ord, id, size, shard FROM p JOIN f USING (pass, n)""")
def x16_packing(spark, d):
    rows = read(spark, d, "part").select(F.col("p_brand").alias("pass"), F.col("p_partkey").alias("ord"), F.col("p_name").alias("id"), (F.col("p_size") * 100).alias("size"))
    return extract.packed(rows, 6000)


@query(f"""WITH {_WORDS}, n AS (SELECT doc_id, max(i) AS top FROM w GROUP BY 1), p AS (SELECT DISTINCT x.doc_id, x.w AS a, coalesce(y.w, '?') AS b FROM w x LEFT JOIN w y ON y.doc_id = x.doc_id AND y.i = x.i + 1 WHERE x.i = 0 OR y.w IS NOT NULL),
    m AS (SELECT DISTINCT doc_id, lower(a) AS k FROM p UNION SELECT doc_id, lower(b) FROM p)
    SELECT relation, count(*) AS n FROM (SELECT unnest(['hasSubject', 'hasObject', 'hasSourceInstance']) AS relation FROM p UNION ALL SELECT 'hasMention' FROM m) GROUP BY 1""")
def x13_assertions(spark, d):
    r = _records(spark, d).where("class = 'relationship'").withColumn("attributes", F.create_map(F.lit("subject_text"), F.coalesce(F.col("attributes")["subject"], F.lit("?")), F.lit("subject_type_id"), F.lit("t:word"), F.lit("predicate_id"), F.lit("r:next"), F.lit("object_text"), F.coalesce(F.col("attributes")["object"], F.lit("?")), F.lit("object_type_id"), F.lit("t:word")))
    return extract.assertion_graph(r, read(spark, d, "documents")).edges.groupBy("relation").agg(F.count("*").alias("n"))


# --- type registry ---

def _registry(spark, d) -> registry.Registry:
    """Part types as a hierarchy under their first letter, under Thing."""
    names = read(spark, d, "part").select(F.col("p_type").alias("n")).distinct()
    leaf = names.select(F.concat(F.lit("t:"), "n").alias("id"), F.initcap("n").alias("label"), F.concat(F.lit("t:"), F.substring("n", 1, 1)).alias("parent_id"), F.lit(False).alias("abstract"))
    mid = names.select(F.concat(F.lit("t:"), F.substring("n", 1, 1)), F.substring("n", 1, 1), F.lit("t:Thing"), F.lit(True)).distinct()
    top = spark.createDataFrame([("t:Thing", "Thing", None, True)], "id string, label string, parent_id string, abstract boolean")
    types = leaf.union(mid).union(top).withColumn("extractable", ~F.col("abstract")).withColumn("review_required", F.lit(False))
    rel = spark.createDataFrame([("r:any", "any", [], [], None, "EXTRACT"), ("r:things", "things", ["t:Thing"], ["t:Thing"], None, "EXTRACT"), ("r:esses", "esses", ["t:S"], ["t:Thing"], None, "PROPOSE"), ("r:none", "none", ["t:Nothing"], [], None, "EXTRACT"), ("r:host", "host", [], [], None, "HOST_DERIVED_ONLY")],
                                "id string, label string, domain array<string>, range array<string>, value_set string, model_action string")
    modules = types.select(F.lit("m").alias("module_id"), F.lit("type").alias("kind"), F.col("id").alias("member_id")).union(rel.select(F.lit("m"), F.lit("relation"), "id"))
    sets = spark.createDataFrame([], "id string, closed boolean, values array<string>")
    return registry.Registry(types, rel, modules, sets, {"review_action": ["EXTRACT_AS_REPORTED", "PROPOSE_FOR_REVIEW", "HUMAN_REVIEW_REQUIRED"]})


_TYPES = "n AS (SELECT DISTINCT p_type AS n FROM part), ty AS (SELECT 't:' || n AS id, 't:' || substr(n, 1, 1) AS parent_id FROM n UNION SELECT 't:' || substr(n, 1, 1), 't:Thing' FROM n UNION SELECT 't:Thing', NULL)"


@query(f"WITH RECURSIVE {_TYPES}, c(id, ancestor, depth) AS (SELECT id, id, 0 FROM ty UNION ALL SELECT c.id, ty.parent_id, depth + 1 FROM c JOIN ty ON ty.id = ancestor WHERE ty.parent_id IS NOT NULL) SELECT * FROM c")
def h1_ancestors(spark, d):
    return registry.ancestors(_registry(spark, d).types)


@query(f"""WITH RECURSIVE {_TYPES}, c(id, ancestor) AS (SELECT 't:' || n, 't:' || n FROM n UNION SELECT c.id, ty.parent_id FROM c JOIN ty ON ty.id = ancestor WHERE ty.parent_id IS NOT NULL), cov AS (SELECT list(DISTINCT ancestor) AS x, count(*) AS k FROM c),
    rel(id, dom, ran, action) AS (VALUES ('r:any', []::VARCHAR[], []::VARCHAR[], 'EXTRACT'), ('r:things', ['t:Thing'], ['t:Thing'], 'EXTRACT'), ('r:esses', ['t:S'], ['t:Thing'], 'PROPOSE'), ('r:none', ['t:Nothing'], [], 'EXTRACT'), ('r:host', [], [], 'HOST_DERIVED_ONLY'))
    SELECT id, CASE WHEN action = 'HOST_DERIVED_ONLY' THEN 'host derived only' WHEN k = 0 OR len(dom) > 0 AND NOT list_has_any(dom, x) THEN 'no selected type satisfies its domain'
        WHEN len(ran) > 0 AND NOT list_has_any(ran, x) THEN 'no selected type satisfies its range' ELSE '' END AS reason FROM rel, cov""")
def h3_selection(spark, d):
    _, kept, gone = registry.selection(_registry(spark, d), ["m"])
    return kept.withColumn("reason", F.lit("")).union(gone)


@query("SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN 't:' || p_type WHEN p_partkey % 3 = 1 THEN 't:' || p_type ELSE 'x:unheard' END AS repaired FROM part")
def h4_repair(spark, d):
    p, k = read(spark, d, "part"), F.col("p_partkey") % 3
    v = p.select("p_partkey", F.when(k == 0, F.concat(F.lit(" t:"), "p_type")).when(k == 1, F.concat(F.lit("other:"), F.lower("p_type"))).otherwise("x:unheard").alias("value"))
    return registry.repaired(v, _registry(spark, d).types.select("id")).select("p_partkey", "repaired")


@query("SELECT p_partkey AS doc_id, CASE p_partkey % 4 WHEN 0 THEN '' WHEN 1 THEN 'missing: review_action' WHEN 2 THEN 'type is not selected' ELSE 'review_action is not a permitted value|unexpected: extra' END AS errors FROM part".replace("'missing: review_action'", "'missing: review_action'"))
def h5_validation(spark, d):
    k = F.col("p_partkey") % 4
    attrs = F.map_filter(F.create_map(F.lit("type_id"), F.when(k == 2, "t:Thing").otherwise(F.concat(F.lit("t:"), "p_type")), F.lit("review_action"), F.when(k == 1, None).when(k == 3, "MAYBE").otherwise("EXTRACT_AS_REPORTED"), F.lit("extra"), F.when(k == 3, "x")), lambda a, b: b.isNotNull())
    rec = read(spark, d, "part").select(F.col("p_partkey").alias("doc_id"), F.lit("entity").alias("class"), F.col("p_name").alias("text"), attrs.alias("attributes"), F.col("p_partkey").alias("ord"))
    return registry.validate(rec, _registry(spark, d), ["m"]).select("doc_id", F.concat_ws("|", "errors").alias("errors"))


_SOUGHT = "all things economy"
_HITS = " + ".join(f"CASE WHEN list_contains({own}, '{w}') THEN {weight} ELSE 0 END" for own, weight in (("lw", 4.0), ("kw", 2.0)) for w in _SOUGHT.split())


@query(f"""WITH {_TYPES}, l AS (SELECT DISTINCT 't:' || n AS key, lower(n) AS label FROM n UNION SELECT 't:' || substr(n, 1, 1), lower(substr(n, 1, 1)) FROM n UNION SELECT 't:Thing', 'thing'),
    x AS (SELECT key, translate(label, '_-', '  ') AS ls, translate(lower(key), '_-', '  ') AS ks FROM l), y AS (SELECT key, ls, ks, string_split_regex(ls, '[^\\p{{L}}\\p{{N}}]+') AS lw, string_split_regex(ks, '[^\\p{{L}}\\p{{N}}]+') AS kw FROM x),
    z AS (SELECT key, {_HITS} + CASE WHEN contains(ls, '{_SOUGHT}') THEN 8.0 ELSE 0 END + CASE WHEN contains(ks, '{_SOUGHT}') THEN 8.0 ELSE 0 END AS score FROM y)
    SELECT key, score::DOUBLE AS score FROM z WHERE score > 0 ORDER BY score DESC, key LIMIT 12""")
def h6_suggestions(spark, d):
    return registry.draft(_registry(spark, d), _SOUGHT)[0].select("key", "score")


# --- questions ---

#: What the answers of the templates are made of.
_RETAINED = "SELECT relation AS name, count(*) AS count, min(ord) AS ord FROM kept GROUP BY 1"
_DEGREES = """SELECT n.label, coalesce(d.degree, 0) AS degree, n.ord FROM ns n LEFT JOIN (SELECT a.node AS id, count(*) AS degree FROM adj a JOIN ns m ON m.id = a.neighbour WHERE a.status <> 'rejected' AND m.status <> 'rejected' GROUP BY 1) d USING (id)
    WHERE n.status <> 'rejected' ORDER BY degree DESC, lower(n.label), n.ord LIMIT 8"""
_QUESTIONS = {"How many nodes are there?": ("nodes", "(SELECT 'Nodes: ' || count(*) FROM nodes)"), "How many links?": ("relationships", "(SELECT 'Edges: ' || count(*) FROM edges)"),
              "What are the relationship types?": ("relation types", f"(SELECT 'Relations by number of edges: ' || string_agg(name || ': ' || count, ', ' ORDER BY count DESC, ord) FROM ({_RETAINED}))"),
              "Which are the most connected nodes?": ("most connected", f"(SELECT 'Nodes by number of edges: ' || string_agg(label || ': ' || degree, ', ' ORDER BY degree DESC, lower(label), ord) FROM ({_DEGREES}))"),
              'Shortest path between "orders:7" and "nation:5"': (None, "(SELECT 'Path of ' || max(pos) || ' edges: ' || string_agg(label, ' – ' ORDER BY pos) FROM path JOIN nodes USING (id))"),
              "What about NATION_3?": ("node", """(SELECT 'NATION_3: ' || (SELECT count(*) FROM near) || ' edges; next to ' || string_agg(label, ', ' ORDER BY k) FILTER (k <= 8) || '; by ' ||
                  (SELECT string_agg(relation || ' ' || n, ', ' ORDER BY n DESC, f) FROM (SELECT relation, count(*) AS n, min(k) AS f FROM near WHERE k <= 20 GROUP BY 1 ORDER BY n DESC, f LIMIT 6)) FROM near)"""),
              "zzz qqq": ("unresolved", "'Nothing in the graph fits the question'")}
_NEAR = "near AS MATERIALIZED (SELECT n.label, a.relation, row_number() OVER (ORDER BY a.ord, edge_id, side) AS k FROM adj a JOIN ns n ON n.id = a.neighbour WHERE a.node = 'nation:3' AND a.status <> 'rejected' AND n.status <> 'rejected')"
_SAID = " UNION ALL ".join(f"SELECT '{q}' AS question, " + (f"'{kind}' AS kind" if kind else "CASE WHEN (SELECT count(*) FROM path) > 0 THEN 'path' ELSE 'no path' END AS kind") + f", {answer} AS answer" for q, (kind, answer) in _QUESTIONS.items())


@query(f"+, {_path_sql('orders:7', 'nation:5')}, {_NEAR} SELECT question, kind, CASE WHEN kind = 'no path' THEN 'Nothing connects orders:7 and nation:5 within the depth that is searched, or a name is unknown' ELSE answer END AS answer FROM ({_SAID})", recursive=True)
def q1_ask(spark, d):
    g = graph(spark, d)
    said = [(q, ask.ask(g, q)) for q in _QUESTIONS]
    return spark.createDataFrame([(q, a["kind"], a["answer"]) for q, a in said], "question string, kind string, answer string")


@query("""SELECT n_nationkey AS k, 0 AS form, r_name AS first, n_name AS second FROM nation JOIN region ON r_regionkey = n_regionkey UNION ALL SELECT n_nationkey, 1, n_name, r_name || ' and others' FROM nation JOIN region ON r_regionkey = n_regionkey
    UNION ALL SELECT n_nationkey, 2, n_name, r_name FROM nation JOIN region ON r_regionkey = n_regionkey UNION ALL SELECT n_nationkey, 3, NULL, NULL FROM nation""")
def q2_path_terms(spark, d):
    pairs = read(spark, d, "nation").join(read(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey")).select("n_nationkey", "n_name", "r_name").collect()
    forms = [lambda n, r: f"What is the shortest path between {r} and {n}?", lambda n, r: f"Show the connection between {n} to {r} and others", lambda n, r: f"how is '{n}' connected to \"{r}\"", lambda n, r: f"Tell me of {n} and {r}"]
    return spark.createDataFrame([(p.n_nationkey, k, *(ask.path_terms(form(p.n_name, p.r_name)) or (None, None))) for p in pairs for k, form in enumerate(forms)], "k int, form int, first string, second string")


@query(f"+, q AS (SELECT 1 AS k, '{_ABOUT}' AS text), ph AS (SELECT unnest(phrases) AS phrase, generate_subscripts(phrases, 1) AS k FROM {_phrases_sql('k', 'text', 'q')}), " + _resolve_sql("SELECT phrase AS value FROM ph")
       + f""", own AS (SELECT arg_max(id, ROW(length(label), id)) AS id, arg_max(label, ROW(length(label), id)) AS label FROM ns WHERE status <> 'rejected' AND label <> '' AND contains(lower('{_ABOUT}'), lower(label))),
    named AS (SELECT id, -1 AS k, strpos(lower('{_ABOUT}'), lower(label)) AS spot FROM own WHERE id IS NOT NULL UNION ALL SELECT best.id, ph.k, strpos(lower('{_ABOUT}'), lower(phrase)) FROM ph JOIN best ON best.value = phrase JOIN ns ON ns.id = best.id WHERE status <> 'rejected'),
    firsts AS (SELECT id, min(k) AS k FROM named GROUP BY 1 ORDER BY 2 LIMIT 3), until AS (SELECT CASE WHEN count(*) < 3 THEN 99 ELSE max(k) END AS k FROM firsts),
    placed AS (SELECT id, min(CASE WHEN spot > 0 THEN spot ELSE 999 END) AS spot FROM named WHERE id IN (SELECT id FROM firsts) AND k <= (SELECT k FROM until) GROUP BY 1)
    SELECT id, row_number() OVER (ORDER BY spot, id) - 1 AS place FROM placed""", recursive=True)
def q3_foci(spark, d):
    return spark.createDataFrame(list(enumerate(ask.foci(graph(spark, d), _ABOUT))), "place long, id string").select("id", "place")


#: The window around one focus, two edges deep and of 120 nodes, and the first 120 edges within it.
_RETRIEVED = """deg AS MATERIALIZED (SELECT node AS id, count(*) AS degree FROM kadj GROUP BY 1), l0 AS (SELECT 'nation:3' AS id, 0::BIGINT AS pos),
    l1 AS MATERIALIZED (SELECT neighbour AS id, row_number() OVER (ORDER BY min(ROW(-degree, ord, edge_id))) AS pos FROM kadj k JOIN deg ON deg.id = k.neighbour WHERE node = 'nation:3' AND neighbour <> 'nation:3' GROUP BY neighbour),
    l2 AS MATERIALIZED (SELECT neighbour AS id, (SELECT count(*) FROM l1) + row_number() OVER (ORDER BY min(ROW(p.pos, -degree, k.ord, edge_id))) AS pos FROM kadj k JOIN l1 p ON p.id = k.node JOIN deg ON deg.id = k.neighbour WHERE neighbour NOT IN (SELECT id FROM l1) AND neighbour <> 'nation:3' GROUP BY neighbour),
    picked AS MATERIALIZED (SELECT id FROM (SELECT * FROM l0 UNION ALL SELECT * FROM l1 UNION ALL SELECT * FROM l2) WHERE pos < 120),
    tr AS MATERIALIZED (SELECT *, row_number() OVER (ORDER BY ord, edge_id) AS rank FROM kept WHERE source IN (SELECT id FROM picked) AND target IN (SELECT id FROM picked))"""


@query(f"+, {_RETRIEVED} SELECT edge_id, rank::INTEGER AS rank, 2 AS depth, (SELECT count(*) FROM tr) > 120 AS truncated FROM tr WHERE rank <= 120")
def q4_retrieval(spark, d):
    got = ask.retrieve(graph(spark, d), "How is NATION_3 doing?")
    return got["triples"].select("edge_id", "rank", F.lit(got["depth"]).alias("depth"), F.lit(got["truncated"]).alias("truncated"))


@query(f"""+, {_RETRIEVED}, lines AS (SELECT rank, '(' || s.label || ') -[' || relation || ']-> (' || t.label || ') | status=' || tr.status AS row FROM tr JOIN nodes s ON s.id = source JOIN nodes t ON t.id = target WHERE rank <= 120)
    SELECT rank::INTEGER AS rank, row FROM (SELECT *, sum(length(row) + 1) OVER (ORDER BY rank) AS used FROM lines) WHERE used <= 12000""")
def q5_context(spark, d):
    return ask.context(ask.retrieve(graph(spark, d), "How is NATION_3 doing?")["triples"])


@query("""+, n AS (SELECT 'Nodes: ' || count(*) AS a FROM nodes) SELECT 'deterministic' AS asked, 'deterministic' AS mode, a AS answer FROM n UNION ALL SELECT 'auto', 'deterministic', a FROM n UNION ALL SELECT 'auto, failing model', 'deterministic', a FROM n
    UNION ALL SELECT 'graphrag', 'graphrag', 'How many nodes does NATION_3 have?' UNION ALL SELECT 'graphrag without a model', 'error', 'ValueError'""")
def q6_routing(spark, d):
    g, question = graph(spark, d), "How many nodes does NATION_3 have?"

    def failing(question: str, text: str) -> str:
        raise OSError("no model there")

    def said(asked: str, mode: str, model=None) -> tuple[str, str, str]:
        try:
            got = ask.route(g, question, mode, model)
        except ValueError as error:
            return asked, "error", type(error).__name__
        return asked, got["mode"], got["answer"]

    rows = [said("deterministic", "deterministic"), said("auto", "auto"), said("auto, failing model", "auto", failing), said("graphrag", "graphrag", lambda q, text: q), said("graphrag without a model", "graphrag")]
    return spark.createDataFrame(rows, "asked string, mode string, answer string")
