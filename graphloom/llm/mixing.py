"""Mixing sources to target weights by entropy balancing.

Every document gets a rate, the words that the mix takes of it over its size. Among the rates of at most MOST that meet
each source's token target, those that stay closest to one common rate (least relative entropy) are tilted exponentially:
rate = min(MOST, exp(tilt * size / scale)), scale being the source's mean size weighted by size. The convex dual has one tilt per source, found by
Newton steps over the cluster, each one aggregation of the histogram of sizes for all sources at once; no document table is read again. Rates are
then rounded into whole copies: sizes are walked from the largest down, each taking the copies that bring the source's total nearest its running
target, so that the last, smallest sizes settle what is left. Among documents of one source and size, the first in the
order of a seeded digest get the copy more.

Cases: null texts have size 0 and are taken as 0 words; null sources are a source of their own, last in order; targets
that stand at MOST times their source's size are met by MOST copies of all; a source without words has target 0;
rows that repeat are documents of their own; an empty table gives an empty result. The histogram holds one row for each
source and size, however many documents share it; a source's rows of it, as many as it has different sizes, are rounded in one task. Tables by source and size go to
the documents whole if they are short by count, else in a join that is salted, as many documents may share one. The table of sources goes
through one task, for its order.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

from .common import Stash, slices, with_small, word_spans
from .ranks import ranked, unit

#: Weights by the source's place in order, the mix's size over all sizes, most copies of a document.
WEIGHTS, SHARE, MOST = (5, 2, 1), 1.5, 2
STEPS, NEAR = 60, 1e-9
SEED = "mix-1"


@F.arrow_udf(LongType())
def words(text: pa.Array) -> pa.Array:
    """The number of runs of other characters than space and \\t to \\r; 0 for null."""
    out = [np.bincount(word_spans(buf, off)[2], minlength=j - i) for i, j, buf, off in slices(text)]
    return pa.array(np.concatenate(out) if out else np.zeros(0, np.int64), pa.int64())


def targets(sources: DataFrame) -> DataFrame:
    """Adds target to (stratum, total): SHARE of all totals by weight, where none passes MOST times its own total.

    What stops there reshares its excess by weight, so the rest share one level per weight. In the order of
    total / weight the first k sources stop; k is the largest for which the k-th still stops at the level then left.
    """
    everything = Window.partitionBy(F.lit(0))
    by_name = everything.orderBy("stratum")
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in WEIGHTS]), ((F.row_number().over(by_name) - 1) % len(WEIGHTS) + 1).cast("int"))
    t = sources.withColumn("weight", weight).withColumn("cap", F.col("total") * float(MOST))
    up = everything.orderBy(F.col("cap") / F.col("weight"), "stratum")
    before = up.rowsBetween(Window.unboundedPreceding, -1)
    after = up.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    level = (F.sum("total").over(everything) * SHARE - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / F.sum("weight").over(after)
    t = t.withColumn("level", level).withColumn("stops", F.col("cap") <= F.col("level") * F.col("weight"))
    # the level of the first that does not stop is everyone's
    last = F.min(F.when(~F.col("stops"), F.struct((F.col("cap") / F.col("weight")).alias("c"), F.col("stratum"), F.col("level"))))
    t = t.withColumn("common", last.over(everything)["level"])
    return t.withColumn("target", F.when(F.col("stops") | F.col("common").isNull(), F.col("cap")).otherwise(F.col("common") * F.col("weight"))).select("stratum", "total", "target")


def _raw() -> Column:
    """The rate that a source's tilt gives to a size."""
    return F.exp(F.least(F.col("tilt") * F.col("x"), F.lit(math.log(MOST))))


def _exact(c: Column) -> Column:
    """A sum that no order of rows changes."""
    return F.sum(c.cast("decimal(38,10)")).cast("double")


def tilts(histogram: DataFrame, aims: DataFrame, stash: Stash) -> DataFrame:
    """(stratum, scale, tilt) of all sources at once; those at MOST times their size, or without words, have the greatest tilt.

    The histogram (stratum, size, c) stays where it lies. A step is one aggregation of it by source, for the gap between the rates' words and
    the target and for the gap's slope, and one row per source is written. The dual is convex in the tilt, so a bracket guards each Newton step.
    """
    h = histogram.where("size > 0")
    scale = h.groupBy("stratum").agg((_exact(F.col("size") * F.col("size") * F.col("c")) / _exact(F.col("size") * F.col("c"))).alias("scale"), F.min("size").alias("least"))
    most = F.lit(math.log(MOST)) * F.col("scale") / F.col("least")
    begin = F.when(F.col("target") >= MOST * F.col("total"), most).otherwise(F.log(F.col("target") / F.col("total")))
    state = aims.join(scale, "stratum").select("stratum", "target", "scale", (-60.0 * F.col("scale") / F.col("least")).alias("low"), most.alias("high"), begin.alias("tilt"), (F.col("target") >= MOST * F.col("total")).alias("done"))
    state = stash.keep(state.withColumn("tilt", F.greatest("low", F.least("high", "tilt"))))
    for _ in range(STEPS):
        words_of, capped = F.col("size") * F.col("c"), F.col("tilt") * F.col("x") >= math.log(MOST)
        rated = with_small(h, state.where("not done").select("stratum", "tilt", "scale"), ["stratum"]).withColumn("x", F.col("size") / F.col("scale"))
        sums = rated.groupBy("stratum").agg(_exact(words_of * _raw()).alias("words"), _exact(F.when(~capped, words_of * F.col("x") * _raw()).otherwise(0.0)).alias("slope"))
        s = state.join(sums, "stratum", "left").withColumn("gap", F.col("words") - F.col("target")).withColumn("done", F.col("done") | (F.abs("gap") <= NEAR * F.col("target")))
        s = s.withColumn("low", F.when(F.col("gap") <= 0, F.col("tilt")).otherwise(F.col("low"))).withColumn("high", F.when(F.col("gap") > 0, F.col("tilt")).otherwise(F.col("high")))
        step = F.when(F.col("slope") > 0, F.col("tilt") - F.col("gap") / F.col("slope"))
        inside = F.coalesce((step > F.col("low")) & (step < F.col("high")), F.lit(False))
        moved = F.when(F.col("done"), F.col("tilt")).when(inside, step).otherwise((F.col("low") + F.col("high")) / 2)
        fresh = stash.keep(s.select("stratum", "target", "scale", "low", "high", moved.alias("tilt"), "done"))
        stash.forget(state)
        state = fresh
        if state.where("not done").isEmpty():
            break
    return state.select("stratum", "scale", "tilt")


def copies(size: np.ndarray, count: np.ndarray, rate: np.ndarray) -> np.ndarray:
    """Copies of all documents of each size together, from the largest size down; what is over or short is carried on."""
    out = np.zeros(len(size), dtype=np.int64)
    owed = 0.0
    for i in np.argsort(-size, kind="stable"):
        if size[i] > 0:
            owed += rate[i] * size[i] * count[i]
            out[i] = min(max(round(owed / size[i]), 0), MOST * int(count[i]))
            owed -= float(out[i] * size[i])
    return out


def _rounded(pdf: pd.DataFrame) -> pd.DataFrame:
    size, count = pdf["size"].to_numpy(float), pdf["c"].to_numpy(float)
    return pdf[["stratum", "size", "c"]].assign(copies=copies(size, count, pdf["rate"].to_numpy(float)))


def _marked(docs: DataFrame, seed: str) -> DataFrame:
    """docs with what decisions rest on: __size, __stratum and __key."""
    return (docs.withColumn("__size", words(F.col("text").cast("string")))
            .withColumn("__stratum", F.when(F.col("source").isNull(), F.lit("1")).otherwise(F.concat(F.lit("0"), F.col("source").cast("string"))))
            .withColumn("__key", F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(":"), F.coalesce(F.xxhash64("text").cast("string"), F.lit(""))).cast("binary"))))


def _decide(docs: DataFrame, seed: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Each row's (doc_id, size, stratum, key, rank), the sources' (stratum, total, target), the (stratum, size, c, copies)."""
    stash = Stash(docs.sparkSession)
    base = stash.keep(_marked(docs.select("doc_id", "source", "text"), seed).select("doc_id", F.col("__size").alias("size"), F.col("__stratum").alias("stratum"), F.col("__key").alias("key")))
    n = base.count()
    histogram = stash.keep(base.groupBy("stratum", "size").agg(F.count("*").alias("c")))
    aims = stash.keep(targets(histogram.groupBy("stratum").agg(F.sum(F.col("size") * F.col("c")).alias("total"))))
    rated = histogram.join(tilts(histogram, aims, stash), "stratum", "left").withColumn("x", F.col("size") / F.col("scale")).withColumn("rate", F.when(F.col("size") > 0, _raw()).otherwise(0.0))
    plan = stash.keep(rated.groupBy("stratum").applyInPandas(_rounded, "stratum string, size long, c long, copies long"))
    return ranked(base, ["stratum", "size"], unit(F.col("key")), [F.col("key"), F.col("doc_id")], n, "rank"), aims, plan


def mix(docs: DataFrame, seed: str = SEED) -> DataFrame:
    """doc_id, size, source_size, target and taken of each row of (doc_id, source, text)."""
    placed, aims, plan = _decide(docs, seed)
    taken = F.expr("size * (copies div c + CASE WHEN rank < copies % c THEN 1 ELSE 0 END)")
    return (with_small(with_small(placed, plan, ["stratum", "size"]), aims, ["stratum"])
            .select("doc_id", "size", F.col("total").cast("long").alias("source_size"), "target", taken.cast("long").alias("taken")))


def repeat(docs: DataFrame, seed: str = SEED) -> DataFrame:
    """docs with each row as often as the mix takes it, and the same columns; rows of no word go.

    The copy more goes to the rows up to the last such key of their source and size, so rows of one id and text share it.
    """
    names = docs.columns
    inner = docs.toDF(*[n if n in ("doc_id", "source", "text") else f"__c{i}" for i, n in enumerate(names)])
    placed, _, plan = _decide(inner, seed)
    stash = Stash(docs.sparkSession)
    last = (with_small(placed, plan, ["stratum", "size"]).groupBy("stratum", "size")
            .agg(F.first(F.expr("copies div c")).alias("__all"), F.max(F.expr("CASE WHEN rank < copies % c THEN key END")).alias("__last"))
            .toDF("__stratum", "__size", "__all", "__last"))
    last = stash.keep(last)
    times = F.expr("__all + CASE WHEN __key <= __last THEN 1 ELSE 0 END")
    out = with_small(_marked(inner, seed), last, ["__stratum", "__size"]).withColumn("__n", times).where("__n > 0")
    return out.withColumn("__i", F.explode(F.sequence(F.lit(1).cast("long"), F.col("__n")))).select(inner.columns).toDF(*names)
