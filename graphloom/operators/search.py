"""Search and name resolution."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from ..functions.text import candidate_phrases, occurrences
from ..model import Graph

FUZZY_CUTOFF = 70
#: Query vectors, and names or texts, that are broadcast at once, on average.
QUERY_BLOCK, NAME_BLOCK = 4096, 1000
#: Characters whose counts bound the likeness of two names from above; all others count as alike.
_LETTERS = "abcdefghijklmnopqrstuvwxyz0123456789"


def _in_blocks(queries: DataFrame, key: str, size: int, work: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """work over blocks of the queries, dealt by their keys' hashes: each goes to every task in one broadcast, and the results are united."""
    blocks = max(-(-queries.count() // size), 1)
    parts = [queries] if blocks == 1 else [queries.where(F.pmod(F.xxhash64(key), F.lit(blocks)) == b) for b in range(blocks)]
    return reduce(DataFrame.union, [work(q) for q in parts])


def _folded(text: str) -> str:
    return " ".join((text or "").split()).lower()


def search(graph: Graph, query: str, limit: int = 12) -> DataFrame:
    """Nodes whose label begins with (rank 0) or label and type hold (1) the query, then edges by relation (2)."""
    needle = _folded(query)
    limit = max(1, min(int(limit), 50))
    label = F.lower("label")
    rank = F.when(F.startswith(label, F.lit(needle)), 0).otherwise(1)
    nodes = graph.node_status().where(F.contains(F.lower(F.concat_ws(" ", "label", "type")), F.lit(needle))).select(F.lit("node").alias("kind"), "id", "label", "type", "status", rank.alias("rank"), "ord")
    labels = graph.nodes.select("id", "label")
    edges = graph.edge_status().where(F.contains(F.lower("relation"), F.lit(needle)))
    edges = (edges.join(labels.toDF("source", "sl"), "source").join(labels.toDF("target", "tl"), "target")
             .select(F.lit("edge").alias("kind"), F.col("edge_id").alias("id"), F.concat_ws(" — ", "sl", "relation", "tl").alias("label"), F.col("relation").alias("type"), "status", F.lit(2).alias("rank"), "ord"))
    out = nodes.union(edges)
    out = out if len(needle) >= 2 else out.where("false")
    return out.orderBy("rank", F.lower("label"), "ord", "id").limit(limit).select("kind", "id", "label", "type", "status", "rank")


@F.pandas_udf(DoubleType())
def token_sort_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    """Likeness from 0 to 100 of two strings' sorted words: insertions and deletions only."""
    def indel(x: str, y: str) -> float:
        if not x and not y:
            return 100.0
        # longest common subsequence on bit vectors
        place: dict[str, int] = {}
        for i, c in enumerate(x):
            place[c] = place.get(c, 0) | 1 << i
        full = row = (1 << len(x)) - 1
        for c in y:
            hit = row & place.get(c, 0)
            row = (row + hit | row - hit) & full
        return 200.0 * (len(x) - row.bit_count()) / (len(x) + len(y))

    tidy = lambda s: " ".join(sorted((s or "").lower().split()))
    return pd.Series([indel(tidy(x), tidy(y)) for x, y in zip(a, b, strict=True)], dtype="float64")


def _tidy(c: Column) -> Column:
    """A name with its white space folded, in lower case: as long as its sorted words, and of the same characters."""
    return F.lower(F.trim(F.regexp_replace(c, r"\s+", " ")))


def _letters(c: Column) -> Column:
    """How often each of _LETTERS stands in a name."""
    return F.array(*[F.length(c) - F.length(F.replace(c, F.lit(x))) for x in _LETTERS])


def _maybe_alike(named: DataFrame, names: DataFrame, folded: str) -> DataFrame:
    """Pairs of a block of names (low) and all named rows whose lengths and letters allow a likeness of FUZZY_CUTOFF.

    The likeness is 200 * common / (sum of lengths), and no more can be common than the letters that both have; so unlike pairs never
    leave the JVM.
    """
    left = F.broadcast(names.withColumn("__length", F.length("low")).withColumn("__letters", _letters(F.col("low"))))
    right = named.withColumn("__own_length", F.length(folded)).withColumn("__own", _letters(F.col(folded)))
    least = F.lit(FUZZY_CUTOFF / 200) * (F.col("__length") + F.col("__own_length"))
    common = F.aggregate(F.zip_with("__letters", "__own", lambda a, b: F.least(a, b)), F.lit(0), lambda s, x: s + x)
    other = F.least(F.col("__length") - F.aggregate("__letters", F.lit(0), lambda s, x: s + x), F.col("__own_length") - F.aggregate("__own", F.lit(0), lambda s, x: s + x))
    fits = (F.least("__length", "__own_length") >= least) & (common + other >= least)
    return right.join(left, fits).drop("__length", "__letters", "__own_length", "__own", folded)


def resolve_nodes(graph: Graph, values: DataFrame, fuzzy: bool = False) -> DataFrame:
    """(value, id): by id, else equal label, else the shortest label that holds the value, else (fuzzy) the likest of 70 or more.

    The values go to the nodes in blocks of NAME_BLOCK: one pass over the nodes for each, and one aggregation to a node per value.
    """
    return _in_blocks(values.select("value").distinct(), "value", NAME_BLOCK, lambda block: _resolve_nodes(graph, block, fuzzy))


def _resolve_nodes(graph: Graph, values: DataFrame, fuzzy: bool) -> DataFrame:
    v = F.broadcast(values.withColumn("name", F.trim(F.regexp_replace("value", r"\s+", " "))).where("name <> ''").withColumn("low", F.lower("name")))
    label = F.lower("label")
    tier = F.when(F.col("id") == F.col("name"), 0).when(label == F.col("low"), 1).when(F.contains(label, F.col("low")), 2)
    hits = graph.nodes.select("id", "label", "ord").join(v, (F.col("id") == F.col("name")) | F.contains(label, F.col("low"))).withColumn("tier", tier)
    best = hits.groupBy("value").agg(F.min_by("id", F.struct("tier", F.when(F.col("tier") == 2, F.length("label")).otherwise(0), "ord")).alias("id"))
    if not fuzzy:
        return best
    rest = v.join(best, "value", "left_anti").where(F.length("low") >= 3)
    named = graph.nodes.select("id", "label", "ord").withColumn("__folded", _tidy(F.col("label")))
    near = _maybe_alike(named, rest, "__folded").withColumn("score", token_sort_ratio(F.col("low"), F.col("label"))).where(F.col("score") >= FUZZY_CUTOFF)
    return best.union(near.groupBy("value").agg(F.max_by("id", F.struct("score", -F.col("ord"))).alias("id")))


def resolve_node(graph: Graph, value: str, fuzzy: bool = True) -> str | None:
    """The id of one name, or None."""
    got = resolve_nodes(graph, graph.spark.createDataFrame([(value or "",)], "value string"), fuzzy).first()
    return got.id if got else None


def _spaced(c: Column) -> Column:
    return F.translate(F.lower(c), "_-", "  ")


def resolve_relations(graph: Graph, values: DataFrame, fuzzy: bool = False) -> DataFrame:
    """(value, relation): equal, else equal but for _ and -, else the shortest that holds the value, else (fuzzy) the likest."""
    relations = graph.edges.select("relation").distinct()
    return _in_blocks(values.select("value").distinct(), "value", NAME_BLOCK, lambda block: _resolve_relations(relations, block, fuzzy))


def _resolve_relations(relations: DataFrame, values: DataFrame, fuzzy: bool) -> DataFrame:
    v = F.broadcast(values.withColumn("low", F.lower(F.trim(F.regexp_replace("value", r"\s+", " ")))).where("low <> ''"))
    tier = F.when(F.lower("relation") == F.col("low"), 0).when(_spaced(F.col("relation")) == _spaced(F.col("low")), 1).when(F.contains(F.lower("relation"), F.col("low")), 2)
    pairs = relations.join(v).withColumn("tier", tier)
    best = pairs.where("tier is not null").groupBy("value").agg(F.min_by("relation", F.struct("tier", F.when(F.col("tier") == 2, F.length("relation")).otherwise(0), "relation")).alias("relation"))
    if not fuzzy:
        return best
    rest = v.join(best, "value", "left_anti").where(F.length("low") >= 3)
    near = _maybe_alike(relations.withColumn("__folded", _tidy(F.col("relation"))), rest, "__folded").withColumn("score", token_sort_ratio(F.col("low"), F.col("relation"))).where(F.col("score") >= FUZZY_CUTOFF)
    w = Window.partitionBy("value").orderBy(F.desc("score"), "relation")
    return best.union(near.withColumn("k", F.row_number().over(w)).where("k = 1").select("value", "relation"))


def resolve_relation(graph: Graph, value: str, fuzzy: bool = True) -> str | None:
    got = resolve_relations(graph, graph.spark.createDataFrame([(value or "",)], "value string"), fuzzy).first()
    return got.relation if got else None


def mentioned(graph: Graph, texts: DataFrame) -> DataFrame:
    """(key, id) of texts (key, text): the longest label that stands in the text, the greatest id among equals; rejected nodes don't count.

    The texts are questions, which go to the nodes in blocks of NAME_BLOCK; each node is tested where it lies, and
    one node per text and task is left before the shuffle.
    """
    return _in_blocks(texts.select("key", "text"), "key", NAME_BLOCK, lambda block: _mentioned(graph, block))


def _mentioned(graph: Graph, texts: DataFrame) -> DataFrame:
    nodes = graph.node_status().where("status <> 'rejected'").select("id", F.lower("label").alias("low")).where("low <> ''")
    t = F.broadcast(texts.select("key", F.lower(F.trim(F.regexp_replace("text", r"\s+", " "))).alias("text")))
    hits = nodes.join(t, F.contains(F.col("text"), F.col("low")))
    return hits.groupBy("key").agg(F.max_by("id", F.struct(F.length("low"), F.col("id"))).alias("id"))


def node_mentioned_in(graph: Graph, text: str) -> str | None:
    """The node that one text names, or None: one filtered scan of the nodes."""
    folded = _folded(text)
    low = F.lower("label")
    got = graph.node_status().where((F.col("status") != "rejected") & (low != "") & F.contains(F.lit(folded), low)).agg(F.max_by("id", F.struct(F.length("label"), F.col("id"))).alias("id")).first()
    return got.id


def phrases(questions: DataFrame, limit: int = 40) -> DataFrame:
    """(key, k, phrase) of questions (key, text)."""
    return questions.select("key", F.posexplode(candidate_phrases("text", limit)).alias("k", "phrase"))


def question_nodes(graph: Graph, question: str) -> DataFrame:
    """(phrase, id, label): the question's phrases that name nodes, in the order of their rank."""
    q = phrases(graph.spark.createDataFrame([("q", question)], "key string, text string"))
    best = resolve_nodes(graph, q.select(F.col("phrase").alias("value")), fuzzy=True)
    return q.join(best.withColumnRenamed("value", "phrase"), "phrase").join(graph.nodes.select("id", "label"), "id").orderBy("k").select("phrase", "id", "label")


def nearest(queries: DataFrame, vectors: DataFrame, k: int = 3, close: float = 1.0) -> DataFrame:
    """(query_id, vec_id, distance, close): exact k nearest by squared distance; (query_id, embedding) against (vec_id, embedding).

    The queries are counted and dealt into blocks of QUERY_BLOCK on average by their ids' hashes; each block goes to every task in
    one broadcast, and the blocks' results are united. Each task keeps its k best per query before the shuffle, so what is
    exchanged is k rows per query and task.
    """
    return _in_blocks(queries, "query_id", QUERY_BLOCK, lambda block: _nearest(block, vectors, k, close))


def _nearest(queries: DataFrame, vectors: DataFrame, k: int, close: float) -> DataFrame:
    q = F.broadcast(queries.select("query_id", F.col("embedding").alias("q")))
    d = F.aggregate(F.zip_with("q", "embedding", lambda a, b: (a.cast("double") - b.cast("double")) * (a.cast("double") - b.cast("double"))), F.lit(0.0), lambda s, x: s + x)
    pairs = vectors.select("vec_id", "embedding").join(q).select("query_id", "vec_id", d.alias("distance"))
    w = Window.partitionBy("query_id").orderBy("distance", "vec_id")
    return pairs.withColumn("k", F.row_number().over(w)).where(F.col("k") <= k).select("query_id", "vec_id", "k", "distance", (F.col("distance") < close).alias("close"))


def suggest(registry: DataFrame, text: str, fields: dict[str, float], phrase_bonus: float = 8.0, boosts: DataFrame | None = None, n: int = 12) -> DataFrame:
    """Entries (key, and the columns of fields) by weighted hits of the text's words in their fields.

    A field that holds the whole phrase adds phrase_bonus; boosts (key, bonus) are added to entries that have a score.
    """
    folded = _folded(text)
    words = sorted({w for w in folded.replace("_", " ").split() if len(w) > 2})
    score = F.lit(0.0)
    for column, weight in fields.items():
        low = F.lower(F.coalesce(F.col(column).cast("string"), F.lit("")))
        own = F.split(_spaced(low), r"[^\p{L}\p{N}]+")
        for word in words:
            score = score + F.when(F.array_contains(own, word), weight).otherwise(0.0)
        score = score + F.when((F.lit(folded) != "") & F.contains(_spaced(low), F.lit(folded)), phrase_bonus).otherwise(0.0)
    out = registry.withColumn("score", score).where("score > 0")
    if boosts is not None:
        out = out.join(boosts.groupBy("key").agg(F.sum("bonus").alias("bonus")), "key", "left").withColumn("score", F.col("score") + F.coalesce("bonus", F.lit(0.0))).drop("bonus")
    return out.orderBy(F.desc("score"), "key").limit(n)


def term_relevance(texts: DataFrame, terms: list[str]) -> DataFrame:
    """(key, score): occurrences of all terms in each text."""
    low = F.lower("text")
    total = F.lit(0).cast("long")
    for t in terms:
        total = total + occurrences(low, F.lit(t.lower()))
    return texts.select("key", total.alias("score"))
