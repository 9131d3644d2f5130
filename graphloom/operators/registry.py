"""A type registry as tables, and the validation of extraction records against it.

types (id, label, parent_id, abstract, extractable, review_required), relations (id, label, domain, range, value_set, model_action;
domain and range are arrays of type ids, empty for any), modules (module_id, kind, member_id), value_sets (id, closed, values), enums (a dict).
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.lineage import cut, forget
from .search import suggest

UNRESOLVED, HOST_ONLY, CONCEPT = "UNRESOLVED", "HOST_DERIVED_ONLY", "skos:Concept"
#: Attributes that a record of each kind must and may have.
REQUIRED = {"entity": ["type_id", "review_action"], "relationship": ["subject_text", "subject_type_id", "predicate_id", "object_text", "object_type_id", "review_action"]}
PERMITTED = {"entity": [*REQUIRED["entity"], "canonical_name", "identifier", "mention_role"],
             "relationship": [*REQUIRED["relationship"], "polarity", "certainty", "modality", "source_direction", "evidence_text", "valid_time_text", "value_id", "value_set_id"]}
#: The review actions that a relation's model action lets a record claim.
ACTIONS = {"EXTRACT": ["EXTRACT_AS_REPORTED", "PROPOSE_FOR_REVIEW", "HUMAN_REVIEW_REQUIRED"], "PROPOSE": ["PROPOSE_FOR_REVIEW", "HUMAN_REVIEW_REQUIRED"], "REVIEW": ["HUMAN_REVIEW_REQUIRED"]}


@dataclass(frozen=True)
class Registry:
    types: DataFrame
    relations: DataFrame
    modules: DataFrame
    value_sets: DataFrame
    enums: dict


def ancestors(types: DataFrame) -> DataFrame:
    """(id, ancestor, depth): each type's chain of parents, itself at 0; a cycle is followed once round.

    Chains double in length from round to round until no new pair comes, so a chain of any depth is whole after a number of rounds that
    is its depth's logarithm.
    """
    own = types.select("id", F.col("id").alias("ancestor"), F.lit(0).alias("depth"))
    chain = cut(own.union(types.where("parent_id is not null and parent_id <> id").select("id", "parent_id", F.lit(1))).groupBy("id", "ancestor").agg(F.min("depth").alias("depth")))
    size = chain.count()
    while True:
        further = chain.where("depth > 0").toDF("id", "middle", "d1").join(chain.where("depth > 0").toDF("middle", "ancestor", "d2"), "middle")
        grown = cut(chain.union(further.select("id", "ancestor", F.col("d1") + F.col("d2"))).groupBy("id", "ancestor").agg(F.min("depth").alias("depth")))
        forget(chain)
        chain, before, size = grown, size, grown.count()
        if size == before:
            return chain


def satisfies(pairs: DataFrame, chain: DataFrame) -> DataFrame:
    """pairs (type_id, allowed) with ok: one of the allowed types is the type or an ancestor; an empty list allows any."""
    lines = chain.groupBy(F.col("id").alias("type_id")).agg(F.collect_set("ancestor").alias("line"))
    return pairs.join(lines, "type_id", "left").withColumn("ok", (F.size("allowed") == 0) | F.coalesce(F.arrays_overlap("allowed", F.coalesce("line", F.array("type_id"))), F.lit(False))).drop("line")


def extractable(types: DataFrame) -> DataFrame:
    return types.where("not abstract and extractable")


def selection(registry: Registry, modules: list[str] | None = None, types: list[str] | None = None, relations: list[str] | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """What a choice covers: types (id), relations (id), and dropped relations (id, reason).

    A relation stays if some chosen type satisfies each of its ends; a controlled value stands for the range of a relation that has one.
    """
    member = registry.modules if modules is None else registry.modules.where(F.col("module_id").isin(*modules))
    chosen = extractable(registry.types).join(member.where("kind = 'type'").select(F.col("member_id").alias("id")).distinct(), "id", "left_semi").select("id")
    if types:
        chosen = chosen.where(F.col("id").isin(*types))
    rel = registry.relations.join(member.where("kind = 'relation'").select(F.col("member_id").alias("id")).distinct(), "id", "left_semi")
    if relations:
        rel = rel.where(F.col("id").isin(*relations))
    covered = ancestors(registry.types).join(chosen, "id", "left_semi").agg(F.collect_set("ancestor").alias("covered"))
    j = rel.withColumn("one", F.lit(1)).join(covered.withColumn("one", F.lit(1)), "one").drop("one")
    open_end = lambda c: (F.size(c) > 0) & ~F.arrays_overlap(c, "covered")
    none = F.size("covered") == 0
    reason = (F.when(F.col("model_action") == HOST_ONLY, "host derived only").when(none | open_end("domain"), "no selected type satisfies its domain")
              .when(F.col("value_set").isNull() & open_end("range"), "no selected type satisfies its range"))
    judged = j.withColumn("reason", reason)
    return chosen, judged.where("reason is null").select("id"), judged.where("reason is not null").select("id", "reason")


def local_name(c: Column | str) -> Column:
    return F.lower(F.substring_index(F.col(c) if isinstance(c, str) else c, ":", -1))


def repaired(values: DataFrame, pool: DataFrame) -> DataFrame:
    """values (value) with repaired: the pool's id of the same local name, if the value is not in the pool and only one has it."""
    unique = pool.select("id", local_name("id").alias("local")).groupBy("local").agg(F.min("id").alias("id"), F.count("*").alias("n")).where("n = 1").select("local", "id")
    v = values.withColumn("v", F.trim("value")).withColumn("local", local_name("v"))
    j = v.join(pool.select(F.col("id").alias("v"), F.lit(True).alias("known")), "v", "left").join(unique, "local", "left")
    keep = F.coalesce("known", F.lit(False)) | (F.col("v") == "") | (F.col("v") == UNRESOLVED)
    return j.withColumn("repaired", F.when(keep, F.col("v")).otherwise(F.coalesce("id", "v"))).drop("v", "local", "known", "id")


def validate(records: DataFrame, registry: Registry, modules: list[str] | None = None) -> DataFrame:
    """records (doc_id, class, text, attributes, ord) with errors (sorted strings), valid, and review_action as it must stand.

    A registry that is small is broadcast by its size as the planner finds it; every record is judged in its own row.
    """
    types, relations, _ = selection(registry, modules)
    a = lambda k: F.trim(F.coalesce(F.element_at("attributes", k), F.lit("")))
    chain = ancestors(registry.types).groupBy("id").agg(F.collect_set("ancestor").alias("line"))
    t = registry.types.join(types.withColumn("chosen", F.lit(True)), "id", "left").join(chain, "id", "left")
    side = lambda p: t.select(F.col("id").alias(f"{p}_id"), F.col("line").alias(f"{p}_line"), F.coalesce("chosen", F.lit(False)).alias(f"{p}_chosen"), F.col("review_required").alias(f"{p}_review"))
    r = registry.relations.join(relations.withColumn("chosen", F.lit(True)), "id", "left").join(registry.value_sets.select(F.col("id").alias("value_set"), "closed", "values"), "value_set", "left")
    r = r.select(F.col("id").alias("p_id"), "domain", "range", "value_set", "model_action", "closed", "values", F.coalesce("chosen", F.lit(False)).alias("p_chosen"), F.lit(True).alias("p_known"))
    j = (records.withColumn("e_id", a("type_id")).withColumn("s_id", a("subject_type_id")).withColumn("o_id", a("object_type_id")).withColumn("p_id", a("predicate_id"))
         .join(side("e"), "e_id", "left").join(side("s"), "s_id", "left").join(side("o"), "o_id", "left").join(r, "p_id", "left"))
    is_rel = F.col("class") == "relationship"
    action = F.upper(a("review_action"))
    pick = lambda table: F.when(is_rel, F.array(*[F.lit(x) for x in table["relationship"]])).otherwise(F.array(*[F.lit(x) for x in table["entity"]]))
    missing = F.filter(pick(REQUIRED), lambda k: F.trim(F.coalesce(F.element_at("attributes", k), F.lit(""))) == "")
    extra = F.array_except(F.map_keys("attributes"), pick(PERMITTED))
    typed = lambda p: F.coalesce(F.col(f"{p}_chosen"), F.lit(False))
    given = lambda p: (F.col(f"{p}_id") != "") & (F.col(f"{p}_id") != UNRESOLVED)
    outside = lambda p, allowed: (F.size(allowed) > 0) & ~F.coalesce(F.arrays_overlap(allowed, f"{p}_line"), F.lit(False))
    known, hosted = F.coalesce("p_known", F.lit(False)), F.coalesce(F.col("model_action") == HOST_ONLY, F.lit(False))
    live = is_rel & known & ~hosted
    actions = F.element_at(F.create_map(*[x for k, v in ACTIONS.items() for x in (F.lit(k), F.array(*[F.lit(y) for y in v]))]), F.coalesce("model_action", F.lit("")))
    breach = live & actions.isNotNull() & ~F.coalesce(F.array_contains(actions, action), F.lit(False))
    valued = live & F.col("value_set").isNotNull()
    value, member = a("value_id"), F.coalesce(F.array_contains("values", a("value_id")), F.lit(False))
    checks = [
        (~F.col("class").isin("entity", "relationship"), F.lit("unknown class")),
        (clean_empty("text"), F.lit("text is empty")),
        (F.size(extra) > 0, F.concat(F.lit("unexpected: "), F.array_join(F.array_sort(extra), ", "))),
        (F.size(missing) > 0, F.concat(F.lit("missing: "), F.array_join(missing, ", "))),
        (~is_rel & given("e") & ~typed("e"), F.lit("type is not selected")),
        (is_rel & ~known, F.lit("predicate is unknown")),
        (is_rel & known & hosted, F.lit("predicate is host derived only")),
        (live & ~F.col("p_chosen"), F.lit("predicate is not selected")),
        (live & given("s") & ~typed("s"), F.lit("subject type is not selected")),
        (live & given("s") & typed("s") & outside("s", F.col("domain")), F.lit("subject type does not satisfy the domain")),
        (live & F.col("value_set").isNull() & given("o") & ~typed("o"), F.lit("object type is not selected")),
        (live & F.col("value_set").isNull() & given("o") & typed("o") & outside("o", F.col("range")), F.lit("object type does not satisfy the range")),
        (valued & (F.col("o_id") != "") & (F.col("o_id") != CONCEPT), F.lit("object of a controlled value must be a concept")),
        (valued & (a("value_set_id") != "") & (a("value_set_id") != F.col("value_set")), F.lit("value set does not match")),
        (valued & F.col("closed") & (value == ""), F.lit("value is required")),
        (valued & F.col("closed") & (value != "") & ~member, F.lit("value is no member of the set")),
        (breach, F.lit("review action is not permitted")),
    ]
    for name, allowed in registry.enums.items():
        v = F.upper(a(name))
        checks.append(((v != "") & ~v.isin(*allowed) & (is_rel | F.lit(name == "review_action")), F.lit(f"{name} is not a permitted value")))
    errors = F.array_sort(F.filter(F.array(*[F.when(c, e) for c, e in checks]), lambda e: e.isNotNull()))
    careful = ~is_rel & (((F.col("e_id") == UNRESOLVED) & (action == "EXTRACT_AS_REPORTED")) | F.coalesce("e_review", F.lit(False)))
    stands = F.when(careful, "HUMAN_REVIEW_REQUIRED").when(breach, F.when(F.size(actions) == 1, F.element_at(actions, -1)).otherwise("PROPOSE_FOR_REVIEW")).otherwise(action)
    return j.select("doc_id", "class", "text", "attributes", "ord", errors.alias("errors"), (F.size(errors) == 0).alias("valid"), stands.alias("review_action"))


def clean_empty(c: str) -> Column:
    return F.trim(F.coalesce(F.col(c), F.lit(""))) == ""


def draft(registry: Registry, text: str, n: int = 12) -> tuple[DataFrame, DataFrame]:
    """Types and relations that a description suggests; a relation gains 2 for every end that a suggested type covers. Nothing is saved."""
    t = suggest(registry.types.withColumnRenamed("id", "key"), text, {"label": 4.0, "key": 2.0}, n=n)
    ends = registry.relations.select(F.col("id").alias("key"), F.explode(F.array_union("domain", "range")).alias("end"))
    boosts = ends.join(t.select(F.col("key").alias("end")), "end", "left_semi").select("key", F.lit(2.0).alias("bonus"))
    r = suggest(registry.relations.withColumnRenamed("id", "key"), text, {"label": 4.0, "key": 2.0}, boosts=boosts, n=n)
    return t.select("key", "label", "score"), r.select("key", "label", "score")
