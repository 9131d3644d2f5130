"""Connected components by alternating large and small stars, each round written to the shared folder; a small rest in one task."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Stash

#: Links, of 16 bytes each, up to which one task finishes the work. More than these go through rounds of stars.
SMALL = 250_000


def _united(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """All links of at most SMALL in one task: labels sink to the least neighbour's and jump to their label's label."""
    got = [(b.column("u").to_numpy(), b.column("v").to_numpy()) for b in batches]
    u, v = (np.concatenate([g[k] for g in got]) if got else np.zeros(0, np.int64) for k in (0, 1))
    ids, at = np.unique(np.concatenate((u, v)), return_inverse=True)
    a, b = at[: len(u)], at[len(u) :]
    label = np.arange(len(ids))
    while True:
        low = np.minimum(label[a], label[b])
        fresh = label.copy()
        for end in (a, b, label[a], label[b]):
            np.minimum.at(fresh, end, low)
        fresh = fresh[fresh]
        if (fresh == label).all():
            break
        label = fresh
    moved = label != np.arange(len(ids))
    yield pa.RecordBatch.from_arrays([pa.array(ids[moved], pa.int64()), pa.array(ids[label[moved]], pa.int64())], names=["u", "v"])


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def components(edges: DataFrame, stash: Stash) -> DataFrame:
    """(u, v) of the links (a, b): v is the least member of u's component; least members themselves have no row.

    Every round puts each node's larger neighbours, then its smaller ones, on its least neighbour, until all nodes of a
    component hang on its least one, or so few links are left that one task finishes. Minima are pre-aggregated and the joins are on nodes, so that a node of very many
    links is split over tasks. Loops and repeated links do no harm; ids are longs and null ones are left out.
    """
    e = stash.keep(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    state = _state(e)
    while state[0]:
        if state[0] <= SMALL:
            return stash.keep(e.coalesce(1).mapInArrow(_united, "u long, v long"))
        both = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = stash.keep(both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct())
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct(F.col("u"), F.col("m").alias("v")))).alias("x"))
        new = stash.keep(small.select("x.u", "x.v").where("u <> v").distinct())
        after = _state(new)
        stash.forget(e, large)
        e = new
        if after == state:
            break
        state = after
    return e
