"""From documents and extraction records to triples and graphs; the extraction itself comes as a table of records.

Records have doc_id, class (entity or relationship), text, attributes (a map), char_start, char_end and ord.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import clean_text, excerpt_chars, excerpt_words, is_quantity, predicate_name, tolerant_pattern
from ..model import Graph

#: The header fields that are read, and their names.
HEADER_FIELDS = {"DOCUMENT ID": "doc_id", "TYPE": "doc_type", "TITLE": "doc_title", "DATE": "doc_date", "ORIGIN": "doc_origin"}
HEADER_CHARS, PROFILE_CHARS, CHUNK_CHARS = 1200, 4000, 1500
HEADER_LINE = r"(?m)^([A-Z][A-Z /'-]{2,21}?)[ \t]*:[ \t]*(\S[^\n]*?)\s*$"
#: Fields that must be quoted from the source.
VERBATIM = """subject_text object_text evidence_text finding_text qualitative_value_text quantitative_value_text unit_text qualifier_text baseline_or_scenario_text
valid_time_text observation_time_text assessor_or_authority_text uncertainty_text analytical_confidence_text""".split()


def header(text: Column | str, fields: dict[str, str] = HEADER_FIELDS) -> Column:
    """A map of the header fields in the first characters of a text; of a field that comes twice, the first."""
    head = F.substring(F.col(text) if isinstance(text, str) else text, 1, HEADER_CHARS)
    names = F.transform(F.regexp_extract_all(head, F.lit(HEADER_LINE), F.lit(1)), lambda n: F.trim(n))
    pairs = F.arrays_zip(names.alias("k"), F.regexp_extract_all(head, F.lit(HEADER_LINE), F.lit(2)).alias("v"))
    table = F.create_map(*[F.lit(x) for pair in fields.items() for x in pair])
    known = F.filter(F.transform(pairs, lambda p: F.struct(F.element_at(table, p["k"]).alias("key"), F.trim(p["v"]).alias("value"))), lambda p: p["key"].isNotNull())
    firsts = F.filter(known, lambda p, i: (i == 0) | ~F.exists(F.slice(known, F.lit(1), i), lambda q: q["key"] == p["key"]))
    return F.map_from_entries(firsts)


def profile(text: Column | str, signatures: dict[str, list[str]], default: str = "general") -> Column:
    """The first profile one of whose signatures stands in the first characters."""
    head = F.substring(F.col(text) if isinstance(text, str) else text, 1, PROFILE_CHARS)
    out = None
    for name, marks in signatures.items():
        hit = F.lit(False)
        for m in marks:
            hit = hit | F.contains(head, F.lit(m))
        out = F.when(hit, name) if out is None else out.when(hit, name)
    return F.lit(default) if out is None else out.otherwise(default)


def normal(c: Column | str) -> Column:
    return F.lower(clean_text(c))


def triples(records: DataFrame, types: list[str]) -> DataFrame:
    """(doc_id, subject, predicate, object, source_text, attributes, implicit, char_start, char_end, ord), each once per document.

    Relationships lacking an end or a predicate go. Every entity gives one instance_of triple, with the label and span of its first record and
    the first known type among its records.
    """
    a = F.col("attributes")
    rel = (records.where("class = 'relationship'").select("doc_id", F.nullif(a["subject"], F.lit("")).alias("subject"), predicate_name(a["predicate"]).alias("predicate"), F.nullif(a["object"], F.lit("")).alias("object"),
                                                          F.coalesce("text", F.lit("")).alias("source_text"), "attributes", F.lit(False).alias("implicit"), "char_start", "char_end", "ord")
           .where("subject is not null and object is not null and predicate <> ''"))
    kind = normal(a["type"])
    known = F.when(kind.isin(*types), kind)
    ent = records.where("class = 'entity'").withColumn("k", normal("text"))
    ent = ent.groupBy("doc_id", "k").agg(F.min_by(F.struct("text", "char_start", "char_end"), "ord").alias("f"), F.min_by(known, F.when(known.isNotNull(), F.col("ord"))).alias("t"), F.min("ord").alias("ord"))
    ent = ent.select("doc_id", F.col("f.text").alias("subject"), F.lit("instance_of").alias("predicate"), F.coalesce("t", F.lit("unknown")).alias("object"), F.lit("").alias("source_text"),
                     F.expr("cast(map() as map<string,string>)").alias("attributes"), F.lit(True).alias("implicit"), "f.char_start", "f.char_end", "ord")
    w = Window.partitionBy("doc_id", normal("subject"), "predicate", normal("object"), F.when(F.col("implicit"), F.lit("")).otherwise(normal("source_text")), "implicit").orderBy("ord")
    return rel.union(ent).withColumn("n", F.row_number().over(w)).where("n = 1").drop("n")


def filtered(rows: DataFrame, vocabulary: list[str] | None = None) -> tuple[DataFrame, DataFrame]:
    """The triples within a closed vocabulary whose ends are no bare quantities; and (reason, value, count) of what went."""
    off = ~F.col("implicit") & ~F.col("predicate").isin(*vocabulary) if vocabulary else F.lit(False)
    bare = F.when(is_quantity("subject"), F.col("subject")).when(~F.col("implicit") & is_quantity("object"), F.col("object"))
    judged = rows.withColumn("reason", F.when(off, "predicate").when(bare.isNotNull(), "quantity")).withColumn("value", F.when(off, F.col("predicate")).otherwise(bare))
    gone = judged.where("reason is not null").groupBy("reason", "value").agg(F.count("*").alias("count"))
    return judged.where("reason is null").drop("reason", "value"), gone


def triples_to_graph(rows: DataFrame, docs: DataFrame | None = None) -> Graph:
    """A graph of triples; docs (doc_id, text) gives excerpts and header fields, which only fill gaps. Nodes are named by their normal label."""
    ends = rows.select(F.posexplode(F.when(F.col("implicit"), F.array("subject")).otherwise(F.array("subject", "object"))).alias("side", "label"), "doc_id", "implicit", F.col("object").alias("type"), "char_start", "char_end", "ord")
    ends = ends.withColumn("id", normal("label"))
    place = F.struct("ord", "side")
    own = F.when(F.col("implicit"), place)
    per = ends.groupBy("id", "doc_id").agg(F.min_by("label", place).alias("label"), F.min(place).alias("first"), F.min_by("type", own).alias("type"),
                                           F.coalesce(F.min_by(F.struct("char_start", "char_end"), own), F.min_by(F.struct("char_start", "char_end"), place)).alias("span"))
    # without docs there is nothing to join: the rows stay where they are
    texted = lambda df: df.join(docs.select("doc_id", "text"), "doc_id", "left") if docs is not None else df.withColumn("text", F.lit(None).cast("string"))
    per = texted(per).withColumn("excerpt", excerpt_words("text", F.col("span.char_start"), F.col("span.char_end"))).drop("text")
    order = F.struct("first", "doc_id")
    nodes = per.groupBy("id").agg(F.min_by("label", order).alias("label"), F.coalesce(F.min_by("type", F.when(F.col("type").isNotNull() & (F.col("type") != "unknown"), order)), F.lit("unknown")).alias("type"),
                                  F.min("first.ord").alias("ord"), F.array_sort(F.collect_set(F.col("doc_id").cast("string"))).alias("sources"), F.min_by("excerpt", order).alias("excerpt"))
    nodes = nodes.withColumn("attrs", F.map_filter(F.create_map(F.lit("type"), F.col("type"), F.lit("title"), F.concat_ws(": ", F.initcap("type"), "label"), F.lit("source_excerpt"), F.coalesce("excerpt", F.lit(""))), lambda k, v: v != "")).drop("excerpt")
    e = texted(rows.where("not implicit")).withColumn("meta", F.coalesce(header("text"), F.expr("cast(map() as map<string,string>)")))
    e = e.withColumn("excerpt", excerpt_words("text", F.col("char_start"), F.col("char_end"))).drop("text")
    stated = F.map_filter("attributes", lambda k, v: v.isNotNull() & (v != "") & ~k.isin("subject", "predicate", "object"))
    extra = F.map_filter(F.map_concat(F.col("meta"), F.map_from_arrays(F.array(F.lit("claim_id"), F.lit("time_scope")), F.array(F.col("meta")["doc_id"], F.col("meta")["doc_date"]))), lambda k, v: v.isNotNull())
    filled = F.map_concat(stated, F.map_filter(extra, lambda k, v: ~F.map_contains_key(stated, k)))
    e = e.withColumn("a", filled).withColumn("source", normal("subject")).withColumn("target", normal("object"))
    material = F.to_json(F.array(F.col("doc_id").cast("string"), F.col("a")["claim_id"], F.col("source"), F.col("predicate"), F.col("target"), F.col("source_text")))
    assertion = F.concat(F.lit("assertion-"), F.substring(F.sha2(material, 256), 1, 20))
    attrs = F.map_concat(F.col("a"), F.map_filter(F.create_map(F.lit("assertion_id"), assertion, F.lit("source_text"), F.col("source_text"), F.lit("source_document"), F.col("doc_id").cast("string"), F.lit("source_excerpt"), F.col("excerpt")),
                                                  lambda k, v: (v != "") & ~F.map_contains_key(F.col("a"), k)))
    edges = e.select("source", "target", F.col("predicate").alias("relation"), "ord", attrs.alias("attrs"), F.array(F.col("doc_id").cast("string")).alias("sources"))
    return Graph.of(nodes.select("id", "label", "type", "ord", "attrs", "sources"), edges, name="Triples")


def grounded(records: DataFrame, docs: DataFrame) -> DataFrame:
    """Records with grounded: the span slices back to the text, or without a span the text stands in the document."""
    j = records.join(docs.select("doc_id", F.col("text").alias("document")), "doc_id", "left")
    exact = F.expr("substring(document, char_start + 1, char_end - char_start)") == F.col("text")
    ok = F.when(F.col("char_start").isNotNull() & F.col("char_end").isNotNull(), exact).otherwise(F.contains("document", F.col("text")))
    return j.withColumn("grounded", F.coalesce(ok, F.lit(False))).drop("document")


def unquoted(records: DataFrame, docs: DataFrame, fields: list[str] = VERBATIM) -> DataFrame:
    """Relationship records with unquoted: the first field whose value does not stand in the document, or null."""
    j = records.join(docs.select("doc_id", F.col("text").alias("document")), "doc_id", "left")
    names = F.array(*[F.lit(f) for f in fields])
    bad = F.filter(names, lambda f: (F.trim(F.coalesce(F.element_at("attributes", f), F.lit(""))) != "") & ~F.contains(F.coalesce("document", F.lit("")), F.trim(F.element_at("attributes", f))))
    return j.withColumn("unquoted", F.when(F.col("class") == "relationship", F.get(bad, F.lit(0)))).drop("document")


def mention_id(text: Column, type_id: Column, document: Column) -> Column:
    """A mention's id, of its document, normal text and type: equal words in two documents stay two mentions."""
    return F.concat(F.lit("mention-"), F.substring(F.sha2(F.concat_ws("|", document, normal(text), type_id), 256), 1, 20))


PAGE_MARK = r"\[\[page (\d+)\]\]"


def page_marks(docs: DataFrame) -> DataFrame:
    """(doc_id, offset, page) of the page markers; offsets are code points from 0."""
    pieces = docs.select("doc_id", F.split("text", PAGE_MARK).alias("between"), F.regexp_extract_all("text", F.lit(PAGE_MARK), F.lit(1)).alias("pages"), F.regexp_extract_all("text", F.lit(PAGE_MARK), F.lit(0)).alias("marks"))
    offset = F.aggregate(F.slice("between", F.lit(1), F.col("i") + 1), F.lit(0), lambda s, x: s + F.length(x)) + F.aggregate(F.slice("marks", F.lit(1), F.col("i")), F.lit(0), lambda s, x: s + F.length(x))
    return pieces.select("doc_id", "between", "marks", F.posexplode("pages").alias("i", "page")).select("doc_id", offset.alias("offset"), F.col("page").cast("int").alias("page"))


def pages_of(spans: DataFrame, marks: DataFrame) -> DataFrame:
    """spans (doc_id, offset, …) with page: that of the last marker at or before the offset, else 0.

    An as-of lookup by one sort: markers and spans of a document run side by side, and each span takes the last marker
    seen, so that no span meets all markers.
    """
    names = [c for c in spans.columns if c not in ("doc_id", "offset")]
    s = spans.select("doc_id", "offset", F.lit(1).alias("side"), F.lit(None).cast("int").alias("page"), F.struct(*names or [F.lit(0).alias("_")]).alias("row"))
    m = marks.select("doc_id", "offset", F.lit(0).alias("side"), "page", F.lit(None).cast(s.schema["row"].dataType).alias("row"))
    w = Window.partitionBy("doc_id").orderBy("offset", "side").rowsBetween(Window.unboundedPreceding, 0)
    out = s.union(m).withColumn("page", F.last("page", ignorenulls=True).over(w)).where("side = 1")
    return out.select("doc_id", "offset", *[F.col(f"row.{c}").alias(c) for c in names], F.when(F.col("offset").isNull(), 0).otherwise(F.coalesce("page", F.lit(0))).alias("page"))


def recovered_span(text: Column, quote: Column, start: Column, end: Column) -> tuple[Column, Column]:
    """The span, or where the quote first stands in the text."""
    found = F.position(quote, text)
    at = F.coalesce(start, F.when(found > 0, found - 1))
    return at, F.coalesce(end, at + F.length(quote))


def located(text: Column, quote: Column) -> Column:
    """What the quote is in the text, however white space runs in either; null where it does not stand."""
    return F.nullif(F.regexp_substr(text, tolerant_pattern(quote)), F.lit(""))


def chunks(docs: DataFrame, size: int = CHUNK_CHARS) -> DataFrame:
    """(doc_id, k, chunk) of size characters each."""
    n = F.coalesce(F.length("text"), F.lit(0))
    at = F.explode(F.when(n > 0, F.sequence(F.lit(0), F.floor((n - 1) / size).cast("int"))))
    return docs.select("doc_id", "text", at.alias("k")).select("doc_id", "k", F.expr(f"substring(text, k * {size} + 1, {size})").alias("chunk"))


def sampled_chunks(docs: DataFrame, per_document: int = 3, size: int = CHUNK_CHARS, seed: int = 7) -> DataFrame:
    """The first per_document chunks of each document in a seeded order."""
    w = Window.partitionBy("doc_id").orderBy(F.xxhash64(F.lit(seed), "doc_id", "k"), "k")
    return chunks(docs, size).withColumn("r", F.row_number().over(w)).where(F.col("r") <= per_document).drop("r")


def packed(items: DataFrame, budget: int) -> DataFrame:
    """items (pass, ord, id, size) with shard: filled in order until one would go over the budget; one that is larger stands alone.

    A fold over each pass's sizes in order, kept within a row of arrays.
    """
    g = items.groupBy("pass").agg(F.sort_array(F.collect_list(F.struct("ord", "id", "size"))).alias("all"))
    start = F.struct(F.lit(0).alias("shard"), F.lit(0).cast("long").alias("used"), F.expr("cast(array() as array<int>)").alias("out"))

    def step(s: Column, x: Column) -> Column:
        full = (s["used"] > 0) & (s["used"] + x["size"] > budget)
        shard = s["shard"] + F.when(full, 1).otherwise(0)
        return F.struct(shard.alias("shard"), F.when(full, x["size"]).otherwise(s["used"] + x["size"]).cast("long").alias("used"), F.concat(s["out"], F.array(shard)).alias("out"))

    shards = F.aggregate("all", start, step, lambda s: s["out"])
    return g.select("pass", F.explode(F.arrays_zip(F.col("all"), shards.alias("shards"))).alias("x")).select("pass", F.col("x.all.ord").alias("ord"), F.col("x.all.id").alias("id"), F.col("x.all.size").alias("size"), F.col("x.shards").alias("shard"))


def source_documents(files: DataFrame) -> DataFrame:
    """(document_id, filename, media_type, sha256, byte_size, character_count, page_count) of files (path, content)."""
    text = F.decode("content", "UTF-8")
    digest = F.sha2("content", 256)
    kind = F.when(F.startswith(F.hex(F.substring("content", 1, 4)), F.lit("25504446")), "application/pdf").otherwise("text/plain")
    return files.select(F.concat(F.lit("document-"), F.substring(digest, 1, 20)).alias("document_id"), F.regexp_extract("path", r"([^/]+)$", 1).alias("filename"), kind.alias("media_type"), digest.alias("sha256"),
                        F.length("content").cast("long").alias("byte_size"), F.length(text).alias("character_count"), F.size(F.regexp_extract_all(text, F.lit(PAGE_MARK), F.lit(1))).alias("page_count"))


def assertion_graph(records: DataFrame, docs: DataFrame, labels: dict[str, str] | None = None) -> Graph:
    """Reified assertions: mention nodes, an assertion node per relationship with edges to subject, object and document, and
    edges from documents to their mentions. Scaffolding edges are host-derived; what a model predicted is a PREDICTION.
    """
    a = F.col("attributes")
    names = F.create_map(*[F.lit(x) for pair in (labels or {"": ""}).items() for x in pair])
    doc = F.col("doc_id").cast("string")
    j = records.join(docs.select("doc_id", F.col("text").alias("document")), "doc_id", "left").withColumn("excerpt", excerpt_chars("document", F.col("char_start"), F.col("char_end"))).drop("document")
    ent = j.where("class = 'entity'").select(doc.alias("doc"), F.col("text").alias("label"), F.coalesce(a["type_id"], F.lit("UNRESOLVED")).alias("type_id"), "excerpt", "ord", F.lit(0).alias("side"))
    rel = j.where("class = 'relationship'")
    ends = rel.select(doc.alias("doc"), F.explode(F.array(F.struct(a["subject_text"].alias("label"), a["subject_type_id"].alias("type_id"), F.lit(1).alias("side")), F.struct(a["object_text"].alias("label"), a["object_type_id"].alias("type_id"), F.lit(2).alias("side")))).alias("x"), "excerpt", "ord")
    mentions = ent.union(ends.select("doc", "x.label", F.coalesce("x.type_id", F.lit("UNRESOLVED")), "excerpt", "ord", "x.side")).withColumn("id", mention_id(F.col("label"), F.col("type_id"), F.col("doc")))
    place = F.struct("ord", "side")
    m = mentions.groupBy("id").agg(F.min_by(F.struct("label", "type_id", "doc"), place).alias("f"), F.count("*").alias("n"), F.min_by("excerpt", F.when(F.col("excerpt") != "", place)).alias("excerpt"), F.min("ord").alias("ord"))
    m = m.select("id", "f.label", F.coalesce(names[F.col("f.type_id")], F.col("f.type_id")).alias("type"), "ord", F.map_filter(F.create_map(
        F.lit("record_kind"), F.lit("MENTION"), F.lit("type_id"), F.col("f.type_id"), F.lit("source_document"), F.col("f.doc"), F.lit("mention_count"), F.col("n").cast("string"), F.lit("source_excerpt"), F.coalesce("excerpt", F.lit(""))), lambda k, v: v != "").alias("attrs"), F.array("f.doc").alias("sources"))
    key = F.concat(F.lit("assertion-"), F.substring(F.sha2(F.concat_ws("|", doc, a["subject_text"], a["predicate_id"], a["object_text"], F.col("text"), F.coalesce(a["valid_time_text"], F.lit(""))), 256), 1, 20))
    rel = rel.withColumn("id", key).withColumn("kind", F.when(a["modality"] == "MODEL_PREDICTED", "PREDICTION").otherwise("SOURCE_ASSERTION")).withColumn("doc", doc)
    rel = rel.withColumn("s", mention_id(a["subject_text"], F.coalesce(a["subject_type_id"], F.lit("UNRESOLVED")), F.col("doc"))).withColumn("o", mention_id(a["object_text"], F.coalesce(a["object_type_id"], F.lit("UNRESOLVED")), F.col("doc")))
    one = rel.groupBy("id").agg(F.min_by(F.struct("attributes", "kind", "doc", "text", "excerpt", "s", "o"), "ord").alias("r"), F.min("ord").alias("ord")).select("id", "ord", "r.*")
    label = F.concat(F.col("attributes")["subject_text"], F.lit(" —["), F.coalesce(names[F.col("attributes")["predicate_id"]], F.col("attributes")["predicate_id"]), F.lit("]→ "), F.col("attributes")["object_text"])
    own = F.create_map(F.lit("record_kind"), F.col("kind"), F.lit("evidence_span"), F.col("text"), F.lit("source_document"), F.col("doc"), F.lit("source_excerpt"), F.col("excerpt"))
    rest = F.map_filter("attributes", lambda k, v: v.isNotNull() & (v != "") & ~k.isin("subject_text", "object_text", "record_kind", "evidence_span", "source_document", "source_excerpt"))
    assertions = one.select("id", label.alias("label"), F.when(F.col("kind") == "PREDICTION", "Prediction").otherwise("Assertion").alias("type"), "ord", F.map_concat(own, rest).alias("attrs"), F.array("doc").alias("sources"))
    d = records.select(doc.alias("doc"), "ord").groupBy("doc").agg(F.min("ord").alias("ord")).select(F.concat(F.lit("document-"), F.col("doc")).alias("id"), F.col("doc").alias("label"), F.lit("Document").alias("type"), "ord",
                                                                                                     F.create_map(F.lit("record_kind"), F.lit("SOURCE_DOCUMENT"), F.lit("host_derived"), F.lit("true"), F.lit("source_document"), F.col("doc")).alias("attrs"), F.array("doc").alias("sources"))
    host = lambda rel_id, doc_col: F.create_map(F.lit("host_derived"), F.lit("true"), F.lit("structural"), F.lit("true"), F.lit("assertion_id"), rel_id, F.lit("source_document"), doc_col)
    links = one.select(F.col("id").alias("source"), F.explode(F.array(F.struct(F.col("s").alias("target"), F.lit("hasSubject").alias("relation")), F.struct(F.col("o").alias("target"), F.lit("hasObject").alias("relation")), F.struct(F.concat(F.lit("document-"), F.col("doc")).alias("target"), F.lit("hasSourceInstance").alias("relation")))).alias("x"), "ord", "doc")
    e = links.select("source", "x.target", "x.relation", "ord", host(F.concat_ws(":", "source", "x.relation", "x.target"), F.col("doc")).alias("attrs"), F.array("doc").alias("sources"))
    has = m.select(F.concat(F.lit("document-"), F.col("sources")[0]).alias("source"), F.col("id").alias("target"), F.lit("hasMention").alias("relation"), "ord", host(F.concat_ws(":", F.lit("mention"), "id"), F.col("sources")[0]).alias("attrs"), "sources")
    return Graph.of(m.union(assertions).union(d), e.union(has), name="Assertions")
