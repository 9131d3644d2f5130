"""Near-duplicate documents by SetSketch registers.

A document's set are its distinct word k-shingles. Each shingle spreads a Poisson process of points over M registers; a
register keeps its earliest point, on an exponential scale of base B, truncated to 16 bits. Registers of a union are the
larger of two registers, and the share of equal ones grows with the Jaccard likeness. Documents of equal sets are one
node from the start. Nodes that agree in all registers of a band are candidates; the likeness is estimated from both
nodes' registers and set sizes jointly, by maximum likelihood, and only pairs that lie more than SIGMAS standard errors
below the threshold are let go. All others are confirmed on their full sets.

Within a band's bucket the candidates are each node with the bucket's pivot, so a bucket of n nodes gives n - 1 pairs; those
that are confirmed make components, and those that pass the estimate make wider clusters. Then the rest of a bucket's pairs is looked at
as far as it could join components: within a cluster, the nodes outside its largest component are held against all of
its nodes, on full sets, block by block, and only one link between two components leaves a block; between clusters, pairs of nodes in one
bucket that pass the estimate are confirmed. So no link between components that share a bucket is left out, and no group is
written out pair by pair. A pair at the threshold shares no bucket with probability of at most MISS.

Cases: documents without a word (null or empty text) have an empty set and are linked with nothing; with fewer than k words the whole
sequence is the one shingle; rows of one doc_id are one document, linked to whatever one of their texts is linked to;
rows without doc_id stay alone, with component_id null, and are kept; an empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType

from .common import GOLDEN, U64, Stash, bitmap, column_bytes, distinct, lowered, mix, shingles, slices, trimmed, within
from .components import components

M, B, A, TOP = 256, 1.001, 20.0, (1 << 16) - 1
MISS, SIGMAS = 1e-5, 5.0
#: Nodes of a bucket or cluster that one task compares with as many others, and members that are confirmed against one copy of a pivot.
BLOCK, EXACT_BLOCK, STAR = 512, 256, 128

_LOG_B = math.log(B)


def banding(threshold: float) -> tuple[int, int]:
    """Registers of a band and bands: the longest bands that miss a pair at the threshold with at most MISS."""
    for r in range(16, 1, -1):
        if (1 - threshold**r) ** (M // r) <= MISS:
            return r, M // r
    return 1, M


def registers(h: np.ndarray, rows: np.ndarray, n: int) -> np.ndarray:
    """The n rows' registers from their distinct hashes; rows is sorted. Rows without a hash have zeros."""
    first = np.full(n * M, np.inf)
    limit = np.full(n, np.inf)
    x = np.zeros(len(h))
    live, level, width = np.arange(len(h)), 0, 1
    while len(live):
        owner = rows[live]
        z = mix(h[live][:, None] + np.arange(level + 1, level + width + 1, dtype=np.uint64)[None, :] * GOLDEN)
        points = x[live][:, None] + np.cumsum(-np.log1p(-(z >> U64(11)).astype(np.float64) / (1 << 53)) / M, axis=1)
        np.minimum.at(first, (owner[:, None] * M + (z & U64(M - 1)).astype(np.int64)).ravel(), points.ravel())
        x[live] = points[:, -1]
        limit = first.reshape(n, M).max(axis=1)
        live = live[x[live] < limit[owner]]
        level += width
        width = min(32, max(1, level // 2))
    with np.errstate(divide="ignore"):
        k = np.floor(1 - np.log(first / A) / _LOG_B)
    return np.where(np.isinf(first), 0, np.clip(k, 1, TOP)).astype(np.uint16).reshape(n, M)


def estimate(p: np.ndarray, q: np.ndarray, np_: np.ndarray, nq: np.ndarray) -> np.ndarray:
    """Most likely Jaccard likeness of pairs of registers with known set sizes."""
    more, less = (p > q).sum(axis=1), (p < q).sum(axis=1)
    same = M - more - less
    u, v = np_ / (np_ + nq), nq / (np_ + nq)
    scale = (B - 1) / B

    def chance(t: np.ndarray) -> np.ndarray:
        return -np.log1p(-np.clip(t, 0, 1) * scale) / _LOG_B

    def likelihood(j: np.ndarray) -> np.ndarray:
        a, b = np.maximum(chance(u - v * j), 1e-12), np.maximum(chance(v - u * j), 1e-12)
        return more * np.log(a) + less * np.log(b) + same * np.log(np.maximum(1 - a - b, 1e-12))

    low, high = np.zeros(len(u)), np.minimum(u / v, v / u)
    for _ in range(40):
        third = (high - low) / 3
        better = likelihood(low + third) < likelihood(high - third)
        low, high = np.where(better, low + third, low), np.where(better, high, high - third)
    return (low + high) / 2


def least_estimate(threshold: float) -> float:
    return threshold - SIGMAS * math.sqrt(threshold * (1 - threshold) / M)


def _set_hashes(h: np.ndarray, rows: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sizes and two order-free hashes of the rows' sets; never 0 for a set that isn't empty."""
    size = np.bincount(rows, minlength=n)
    a, b = np.zeros(n, dtype=np.uint64), np.zeros(n, dtype=np.uint64)
    full = np.flatnonzero(size)
    if len(full):
        start = np.searchsorted(rows, full)
        a[full] = mix(np.add.reduceat(mix(h + U64(11)), start) + size[full].astype(np.uint64))
        b[full] = mix(np.add.reduceat(mix(h * GOLDEN + U64(29)), start) + U64(3))
    return size, a, b


def _sketch(k: int, lower: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j, buf, off in slices(batch.column("text")):
                h, rows = distinct(*shingles(lowered(buf) if lower else buf, off, k))
                size, a, b = _set_hashes(h, rows, j - i)
                raw = registers(h, rows, j - i)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").slice(i, j - i), pa.array(size.astype(np.int64)), pa.array(a.view(np.int64)), pa.array(b.view(np.int64)),
                     pa.array([x.tobytes() if s else None for x, s in zip(raw, size, strict=True)], pa.binary())],
                    names=["doc_id", "n", "h", "h2", "sig"])
    return run


def _matrix(column: pa.Array) -> np.ndarray:
    raw, off = column_bytes(column)
    return raw[off[0] : off[-1]].view(np.uint16).reshape(-1, M)


def band_keys(sig: np.ndarray, r: int, bands: int) -> np.ndarray:
    """One 64-bit key for each row and band."""
    key = np.zeros((len(sig), bands), dtype=np.uint64)
    for x in range(r):
        key = mix(key * GOLDEN + sig[:, x : x + (bands - 1) * r + 1 : r].astype(np.uint64) + U64(1))
    return mix(key + np.arange(bands, dtype=np.uint64)[None, :])


def _bands(r: int, bands: int, wanted: np.ndarray | None = None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                keys = band_keys(_matrix(batch.column("sig")), r, bands).view(np.int64).ravel()
                node = np.repeat(batch.column("h").to_numpy(), bands)
                if wanted is not None:
                    some = within(wanted, keys)
                    keys, node = keys[some], node[some]
                yield pa.RecordBatch.from_arrays([pa.array(node), pa.array(keys)], names=["h", "bk"])
    return run


def _estimated(least: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                near = estimate(_matrix(batch.column("sa")), _matrix(batch.column("sb")), batch.column("na").to_numpy().astype(float), batch.column("nb").to_numpy().astype(float))
                yield batch.select(["a", "b"]).filter(pa.array(near >= least))
    return run


def _confirmed(k: int, lower: bool, num: int, den: int):
    """Rows come sorted by pivot, copy and role; the pivot's own text comes first."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple, np.ndarray] = {}
        for batch in batches:
            a, copy, role, b = (batch.column(c).to_numpy() for c in ("a", "copy", "role", "b"))
            found_a, found_b = [], []
            for i, j, buf, off in slices(batch.column("text")):
                h, rows = distinct(*shingles(lowered(buf) if lower else buf, off, k))
                start = np.searchsorted(rows, np.arange(j - i + 1))
                _, own, _ = _set_hashes(h, rows, j - i)
                own = own.view(np.int64)
                for x in range(j - i):
                    y = i + x
                    if own[x] != b[y]:  # another text under the same doc_id
                        continue
                    part = h[start[x] : start[x + 1]]
                    if role[y] == 0:
                        held = {(a[y], copy[y]): part}
                    elif (pivot := held.get((a[y], copy[y]))) is not None:
                        at = np.minimum(np.searchsorted(pivot, part), len(pivot) - 1)
                        common = int((pivot[at] == part).sum())
                        if den * common >= num * (len(pivot) + len(part) - common):
                            found_a.append(a[y])
                            found_b.append(b[y])
            yield pa.RecordBatch.from_arrays([pa.array(found_a, pa.int64()), pa.array(found_b, pa.int64())], names=["a", "b"])
    return run


def _residue(r: int, bands: int, least: float):
    """Rows come sorted by bucket and block pair; the nodes outside the largest cluster (role 0) come first."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, []
        for batch in batches:
            bk, i, j, role, node, label, n = (batch.column(c).to_numpy() for c in ("bk", "i", "j", "role", "h", "label", "n"))
            sig = _matrix(batch.column("sig")) if batch.num_rows else None
            mode, pivot = batch.column("mode").to_numpy(), batch.column("pivot").to_numpy()
            edges = np.flatnonzero(np.concatenate(([True], (bk[1:] != bk[:-1]) | (i[1:] != i[:-1]) | (j[1:] != j[:-1])))) if batch.num_rows else []
            for low, high in zip(edges, [*edges[1:], batch.num_rows]):
                if (bk[low], i[low], j[low]) != now:
                    now, held = (bk[low], i[low], j[low]), []
                rest = low + int((role[low:high] == 0).sum())
                held += [(node[x], label[x], n[x], sig[x].copy()) for x in range(low, rest)]
                if rest == high or not held:
                    continue
                keys = band_keys(sig[rest:high], r, bands)
                for h, own, size, s in held:
                    if h == pivot[low]:  # compared with all before
                        continue
                    # a pair outside the largest cluster meets twice, and in all its common bands: one of them counts
                    fit = (label[rest:high] != own) & ((label[rest:high] == mode[rest:high]) | (node[rest:high] < h)) & (node[rest:high] != pivot[low])
                    at = np.flatnonzero(fit)
                    if not len(at):
                        continue
                    same = keys[at] == band_keys(s[None, :], r, bands)
                    first = keys[at, np.argmax(same, axis=1)].view(np.int64)
                    at = at[same.any(axis=1) & (first == bk[low])]
                    if len(at):
                        near = estimate(sig[rest:high][at], np.broadcast_to(s, (len(at), M)), n[rest:high][at].astype(float), np.full(len(at), float(size)))
                        at = at[near >= least]
                        if len(at):
                            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), h)), pa.array(node[rest:high][at])], names=["a", "b"])
    return run


def _joined(k: int, lower: bool, num: int, den: int):
    """Rows come sorted by cluster and block pair; the nodes outside the largest component (role 0) come first."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held, index, seen = None, [], None, set()
        for batch in batches:
            c, i, j, role, node, label = (batch.column(x).to_numpy() for x in ("c", "i", "j", "role", "h", "label"))
            found_a, found_b = [], []
            for low, high, buf, off in slices(batch.column("text")):
                h, rows = distinct(*shingles(lowered(buf) if lower else buf, off, k))
                start = np.searchsorted(rows, np.arange(high - low + 1))
                own = _set_hashes(h, rows, high - low)[1].view(np.int64)
                for x in range(high - low):
                    y = low + x
                    if (c[y], i[y], j[y]) != now:
                        now, held, index, seen = (c[y], i[y], j[y]), [], None, set()
                    part = h[start[x] : start[x + 1]]
                    if own[x] != node[y]:  # another text under the same doc_id
                        continue
                    if role[y] == 0:
                        held.append((node[y], label[y], part.copy()))
                        continue
                    if index is None:
                        sizes = np.array([len(s) for *_, s in held], dtype=np.int64)
                        every = np.concatenate([s for *_, s in held]) if held else np.zeros(0, np.uint64)
                        order = np.argsort(every)
                        index = every[order], np.repeat(np.arange(len(held)), sizes)[order], sizes
                    every, owner, sizes = index
                    first, last = np.searchsorted(every, part), np.searchsorted(every, part, side="right")
                    n = last - first
                    at = np.repeat(first - np.concatenate(([0], np.cumsum(n)[:-1])), n) + np.arange(n.sum())
                    common = np.bincount(owner[at], minlength=len(held))
                    for z in np.flatnonzero(den * common >= num * (sizes + len(part) - common)):
                        other, its, _ = held[z]
                        if its != label[y] and (other, label[y]) not in seen:
                            seen.add((other, label[y]))
                            found_a.append(other)
                            found_b.append(node[y])
            yield pa.RecordBatch.from_arrays([pa.array(found_a, pa.int64()), pa.array(found_b, pa.int64())], names=["a", "b"])
    return run


def _confirm(pairs: DataFrame, texts: DataFrame, k: int, lower: bool, num: int, den: int, stash: Stash) -> DataFrame:
    """The pairs (a, b) of nodes whose full sets are as like as num / den; a is the pivot."""
    pairs = stash.keep(pairs.withColumn("copy", F.lit(0)))
    stars = pairs.groupBy("a").agg(F.count("*").alias("c")).select("a", F.ceil(F.col("c") / STAR).cast("int").alias("copies"))
    members = (pairs.select("a", "b").join(stars, "a").select("a", F.expr("pmod(xxhash64(b), copies)").cast("int").alias("copy"), F.lit(1).alias("role"), "b")
               .join(texts.select(F.col("h").alias("b"), "text"), "b"))
    pivots = (stars.join(texts.select(F.col("h").alias("a"), "text"), "a")
              .select("a", F.explode(F.sequence(F.lit(0), F.col("copies") - 1)).alias("copy"), F.lit(0).alias("role"), F.col("a").alias("b"), "text"))
    rows = members.select("a", "copy", "role", "b", "text").union(pivots)
    parts = max(int(pairs.sparkSession.conf.get("spark.sql.shuffle.partitions")), 1)
    return stash.keep(rows.repartition(parts, "a", "copy").sortWithinPartitions("a", "copy", "role").mapInArrow(trimmed(_confirmed(k, lower, num, den)), "a long, b long"))


def _blocks(rows: DataFrame, group: str, block: int) -> DataFrame:
    """Of the groups with several labels: the commonest label, and how many blocks hold all rows and those of other labels."""
    counts = rows.groupBy(group, "label").agg(F.count("*").alias("n"))
    return (counts.groupBy(group).agg(F.sum("n").alias("size"), F.count("*").alias("labels"), F.max(F.struct("n", "label")).alias("m")).where("labels > 1")
            .select(group, F.col("m.label").alias("mode"), F.ceil(F.col("size") / block).cast("int").alias("blocks"), F.ceil((F.col("size") - F.col("m.n")) / block).cast("int").alias("rest")))


def _dealt(rows: DataFrame, group: str, parts: int, fields: list[str], run, stash: Stash) -> DataFrame:
    """What run finds in the pairs of a block of all rows and a block of those outside the commonest label."""
    everyone = rows.select(group, F.expr("pmod(xxhash64(h), blocks)").cast("int").alias("i"), F.explode(F.sequence(F.lit(0), F.col("rest") - 1)).alias("j"), F.lit(1).alias("role"), *fields)
    outside = (rows.where("label <> mode")
               .select(group, F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("i"), F.expr("pmod(xxhash64(h, 1), rest)").cast("int").alias("j"), F.lit(0).alias("role"), *fields))
    return stash.keep(everyone.union(outside).repartition(parts, group, "i", "j").sortWithinPartitions(group, "i", "j", "role").mapInArrow(trimmed(run), "a long, b long").distinct())


def near_duplicates(docs: DataFrame, k: int, num: int, den: int, lower: bool = True) -> DataFrame:
    """doc_id, n_shingles, component_id and kept of each row of (doc_id, text); likeness is num / den or more."""
    spark = docs.sparkSession
    stash = Stash(spark)
    threshold = num / den
    r, bands = banding(threshold)
    least = least_estimate(threshold)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    sketched = stash.keep(rows.mapInArrow(trimmed(_sketch(k, lower)), "doc_id long, n long, h long, h2 long, sig binary"))
    # nodes: equal sets are one, named by the first hash and led by the least doc_id
    full = sketched.where("n > 0 and doc_id is not null")
    classes = stash.keep(full.groupBy("h", "h2").agg(F.min("doc_id").alias("lead")))
    nodes = stash.keep(full.select("doc_id", "n", "h", "h2", "sig").join(classes.select(F.col("h").alias("ch"), F.col("h2").alias("ch2"), F.col("lead")), (F.col("doc_id") == F.col("lead")) & (F.col("h") == F.col("ch")) & (F.col("h2") == F.col("ch2")))
                       .dropDuplicates(["lead", "h", "h2"]).select("h", "lead", "n", "sig"))
    banded = stash.keep(nodes.select("h", "sig").mapInArrow(trimmed(_bands(r, bands)), "h long, bk long"))
    buckets = stash.keep(banded.groupBy("bk").agg(F.count("*").alias("c"), F.min("h").alias("pivot"), F.max("h").alias("other")).where("c > 1"))
    # the members of larger buckets are made again, as far as a bitmap of the buckets lets them through
    large = buckets.where("c > 2").select("bk", "pivot")
    crowded = stash.keep(nodes.select("h", "sig").mapInArrow(trimmed(_bands(r, bands, bitmap(large, "bk"))), "h long, bk long").join(large, "bk"))
    star = (buckets.where("c = 2").select(F.col("pivot").alias("a"), F.col("other").alias("b"))
            .union(crowded.where("h <> pivot").select(F.col("pivot").alias("a"), F.col("h").alias("b"))).distinct())
    star = stash.keep(star)
    involved = star.select(F.col("a").alias("h")).union(star.select(F.col("b").alias("h"))).distinct()
    sized = stash.keep(nodes.join(involved, "h"))
    leads = sized.select("h", "lead")
    wanted = bitmap(leads.select(F.xxhash64("lead").alias("x")), "x")
    may = F.arrow_udf(lambda x: pa.array(within(wanted, x.to_numpy(zero_copy_only=False))), BooleanType())
    some = rows.where("doc_id is not null").where(may(F.xxhash64("doc_id")))
    texts = stash.keep(some.join(leads, some.doc_id == leads.lead).select("h", "text").dropDuplicates(["h", "text"]))
    stash.forget(nodes)
    sigs = sized.select("h", "n", "sig")

    likely = stash.keep(star.join(sigs.toDF("a", "na", "sa"), "a").join(sigs.toDF("b", "nb", "sb"), "b").mapInArrow(trimmed(_estimated(least)), "a long, b long"))
    links = _confirm(likely, texts, k, lower, num, den, stash)
    grown, clusters = components(links, stash), components(likely, stash)
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 1)

    # clusters that still hold several components, on full sets
    placed = (clusters.select(F.col("u").alias("h"), F.col("v").alias("c")).union(clusters.select(F.col("v").alias("h"), F.col("v").alias("c")).distinct())
              .join(grown.select(F.col("u").alias("h"), F.col("v").alias("label")), "h", "left").withColumn("label", F.coalesce("label", "h")))
    placed = stash.keep(placed)
    apart = _blocks(placed, "c", EXACT_BLOCK)
    inner = placed.join(apart, "c").join(texts, "h")
    more_links = _dealt(inner, "c", parts, ["h", "label", "text"], _joined(k, lower, num, den), stash)

    # buckets that hold several clusters, by estimate
    across = stash.keep(crowded.join(clusters.select(F.col("u").alias("h"), F.col("v").alias("label")), "h", "left").withColumn("label", F.coalesce("label", "h")))
    outer = across.join(_blocks(across, "bk", BLOCK), "bk").join(sigs, "h")
    pairs = _dealt(outer, "bk", parts, ["h", "label", "mode", "pivot", "n", "sig"], _residue(r, bands, least), stash)
    last_links = _confirm(pairs, texts, k, lower, num, den, stash)

    # from nodes to documents: the component's least doc_id
    by_lead = links.union(more_links).union(last_links).join(leads.toDF("a", "la"), "a").join(leads.toDF("b", "lb"), "b").select(F.col("la").alias("a"), F.col("lb").alias("b"))
    owned = full.select("doc_id", "h", "h2").join(classes, ["h", "h2"]).select("doc_id", "lead").distinct()
    several = owned.groupBy("doc_id").agg(F.min("lead").alias("a"), F.max("lead").alias("b"), F.count("*").alias("c")).where("c > 1")
    split = owned.join(several.select("doc_id", "a"), "doc_id").select("a", F.col("lead").alias("b"))
    found = components(by_lead.union(split), stash)
    stash.forget(texts, sized, banded, crowded, across, placed, star, likely)
    out = sketched.select("doc_id", "n", "h", "h2").join(classes, ["h", "h2"], "left").join(found.select(F.col("u").alias("lead"), F.col("v").alias("found")), "lead", "left")
    component = F.coalesce("found", "lead", "doc_id")
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("doc_id").isNotNull(), component).alias("component_id"),
                      F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"))
