"""Document fingerprints by locally consistent parsing.

Each level takes a string of names. Runs of one name become one symbol; three rounds of deterministic coin tossing (the
lowest bit in which a symbol differs from its left neighbour, and that bit) bring the symbols down to six labels; every
local maximum of the labels begins a phrase, and a phrase's name is a hash of its symbols. Where a phrase begins depends on a
few neighbours only, so equal substrings get equal names but at their edges, wherever they stand. A level's phrases are
some three times as long as those of the level below.

A fingerprint holds, for each of LEVELS, the least SKETCH names of that level; the likeness of two is the mean over the
levels of the share of common names among the least of both together, an estimate of their Jaccard likeness. It depends on the text alone.

Cases: null and empty texts have an empty fingerprint, alike (1) among themselves and unlike (0) any other; rows with one doc_id follow each
other in the order of a hash of their text; null doc_ids come last; a single row is its own next; an empty table gives an
empty result. Documents are ordered in buckets of close doc_ids, each with a copy of the next bucket's first row.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.feature import Bucketizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import GOLDEN, U64, mix, powers, small_batches

LEVELS, SKETCH = (2, 3, 4), 32
DIGITS = 10
#: Bytes of texts that are parsed at once, and rows.
PARSE_BYTES, PARSE_ROWS = 1 << 19, 256

_NAMING = 0x9E3779B97F4A7C15 | 1
_TAG_BITS = 64 - 4 * DIGITS


def _coin(x: np.ndarray, left: np.ndarray) -> np.ndarray:
    """Twice the lowest bit in which x and left differ, plus x's value there."""
    d = x ^ left
    low = np.bitwise_count((d & (~d + x.dtype.type(1))) - x.dtype.type(1))
    return ((low << 1) | ((x >> low.astype(x.dtype)) & x.dtype.type(1)).astype(np.uint8)).astype(np.uint8)


def _lookup() -> np.ndarray:
    """The coin of every pair of labels below 128."""
    a, b = np.meshgrid(np.arange(128, dtype=np.uint8), np.arange(128, dtype=np.uint8), indexing="ij")
    out = _coin(a.ravel(), b.ravel())
    out[a.ravel() == b.ravel()] = 0
    return out


_TABLE = _lookup()


def _toss(labels: np.ndarray, first: np.ndarray) -> np.ndarray:
    left = np.empty_like(labels)
    left[1:] = labels[:-1]
    left[first] = labels[first] ^ 1
    return _TABLE[(labels.astype(np.uint16) << 7) | left]


def next_level(names: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The phrases' names, and where each non-empty text's begin; first: where the texts begin in names."""
    head = np.zeros(len(names), dtype=bool)
    head[first] = True
    fresh = head.copy()
    fresh[1:] |= names[1:] != names[:-1]
    at = np.flatnonzero(fresh)
    length = np.diff(np.append(at, len(names)))
    # a run's symbol is its name mixed with its length; names of one run differ from both neighbours'
    symbols = names[at].astype(np.uint64)
    runs = length > 1
    symbols[runs] = mix(symbols[runs] + length[runs].astype(np.uint64) * GOLDEN)
    begin = np.searchsorted(at, first)
    same = np.zeros(len(symbols), dtype=bool)
    same[1:] = symbols[1:] == symbols[:-1]
    same[begin] = False
    symbols[same] = mix(symbols[same] + U64(1))  # only hash collisions
    left = np.empty_like(symbols)
    left[1:] = symbols[:-1]
    left[begin] = ~symbols[begin]
    labels = _coin(symbols, left)
    labels = _toss(_toss(_toss(labels, begin), begin), begin)
    top = np.zeros(len(labels), dtype=bool)
    if len(labels) > 2:
        top[1:-1] = (labels[1:-1] > labels[:-2]) & (labels[1:-1] > labels[2:])
    # the last symbol of a text begins no phrase, and its first always does
    ends = np.append(begin[1:], len(symbols)) - 1
    top[ends] = False
    top[begin] = True
    start = np.flatnonzero(top)
    count = np.diff(np.append(start, len(symbols)))
    place = np.arange(len(symbols)) - np.repeat(start, count)
    value = np.add.reduceat(mix(symbols) * powers("phrase", _NAMING, int(count.max()))[place], start)
    return mix(value + count.astype(np.uint64)), np.searchsorted(start, begin)


def sketches(texts: list[bytes]) -> list[list[np.ndarray]]:
    """For each text, the sorted least names of each of LEVELS; shorter texts' top levels are their last phrase alone."""
    out: list[list[np.ndarray]] = [[np.zeros(0, np.uint64)] * len(LEVELS) for _ in texts]
    full = [i for i, t in enumerate(texts) if t]
    if not full:
        return out
    names = np.frombuffer(b"".join(texts[i] for i in full), dtype=np.uint8)
    first = np.concatenate(([0], np.cumsum([len(texts[i]) for i in full])[:-1]))
    names = names.astype(np.uint64) + U64(1)
    for level in range(1, max(LEVELS) + 1):
        names, first = next_level(names, first)
        if level in LEVELS:
            x = LEVELS.index(level)
            row = np.repeat(np.arange(len(full), dtype=np.uint64), np.diff(np.append(first, len(names))))
            key = np.unique((row << U64(4 * DIGITS)) | (mix(names) >> U64(_TAG_BITS)))
            row = (key >> U64(4 * DIGITS)).astype(np.int64)
            low = np.searchsorted(row, np.arange(len(full) + 1))
            key &= U64((1 << 4 * DIGITS) - 1)
            for k, i in enumerate(full):
                out[i][x] = key[low[k] : min(low[k + 1], low[k] + SKETCH)]
    return out


def as_string(sketch: list[np.ndarray]) -> str:
    """Levels apart by '-', each name in DIGITS hexadecimal digits; the empty text's is ''."""
    return "-".join("".join(f"{n:0{DIGITS}x}" for n in part.tolist()) for part in sketch) if len(sketch[0]) else ""


def likeness(a: list[np.ndarray], b: list[np.ndarray]) -> float:
    """The mean estimated Jaccard likeness of two sketches' levels."""
    if not len(a[0]) or not len(b[0]):
        return float(len(a[0]) == len(b[0]))
    total = 0.0
    for p, q in zip(a, b, strict=True):
        p, q = set(p.tolist()), set(q.tolist())
        both = p & q
        if both:
            least = sorted(p | q)
            # beyond the smaller full sketch's last name, the other's may be missing
            least = least[: SKETCH] if max(len(p), len(q)) >= SKETCH else least
            total += sum(n in both for n in least) / len(least)
    return total / len(LEVELS)


def edited(text: str, after: str) -> str:
    """The last half of the text replaced by as much of the next one's beginning."""
    n = len(text) // 2
    return text[: len(text) - n] + after[:n]


FIELDS = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]


def _pairs(kind: str):
    """Rows come in buckets, each sorted and closed by the first row of the next bucket, its halo."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        before: tuple | None = None  # bucket, doc_id, text, sketch of the row whose next is still to come
        for batch in batches:
            columns = [batch.column(c) for c in ("b", "doc_id", "halo", "text")]
            at = 0
            while at < batch.num_rows:
                rows: list[tuple] = []
                size = 0
                while at < batch.num_rows and (not rows or size < PARSE_BYTES and len(rows) < PARSE_ROWS):
                    b, i, halo, text = (c[at].as_py() for c in columns)
                    rows.append((b, i, halo, text or ""))
                    size += len(rows[-1][3])
                    at += 1
                owned = sketches([r[3].encode() for r in rows])
                chain = ([before] if before else []) + [(*r, s) for r, s in zip(rows, owned, strict=True)]
                ready, done = [], []
                for this, after in zip(chain, chain[1:]):
                    if not this[2] and this[0] == after[0]:
                        ready.append((this, after, edited(this[3], after[3])))
                own = sketches([e.encode() for *_, e in ready])
                for (this, after, text), s in zip(ready, own, strict=True):
                    done.append((this[1], len(this[3]), hashlib.sha256(text.encode()).hexdigest(), as_string(this[4]), as_string(s), likeness(this[4], s), likeness(this[4], after[4])))
                before = chain[-1]
                if done:
                    kinds = [batch.schema.field("doc_id").type, pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*done, strict=True), kinds, strict=True)], names=FIELDS)
    return run, f"doc_id {kind}, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def fingerprints(docs: DataFrame, rows_per_bucket: int = 1024) -> DataFrame:
    """FIELDS of each row of (doc_id, text), the next row being that of the next lower doc_id, after the last the first."""
    spark = docs.sparkSession
    small_batches(spark)
    kind = docs.schema["doc_id"].dataType.simpleString()
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    # descending, nulls last; what ties is ordered by a hash of its text
    placed = docs.select("doc_id", text.alias("text"), F.coalesce(-F.col("doc_id").cast("long"), F.lit((1 << 63) - 1)).alias("q")).withColumn("p", F.col("q").cast("double"))
    parts = max(1, min(-(-docs.count() // rows_per_bucket), 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))))
    cuts = placed.agg(F.percentile_approx("p", [k / parts for k in range(1, parts)], 100 * parts)).first()[0] if parts > 1 else []
    splits = [-math.inf, *sorted(set(cuts or [0.0])), math.inf]
    bucketed = Bucketizer(splits=splits, inputCol="p", outputCol="b", handleInvalid="keep").transform(placed).withColumn("b", F.col("b").cast("int")).withColumn("h", F.xxhash64("text"))
    heads = bucketed.groupBy("b").agg(F.min(F.struct("q", "h")).alias("m")).select("b", "m.q", "m.h").orderBy("b").collect()
    # each bucket's first row goes to the bucket before it as well: one row per bucket, so bounded by their number
    halos = spark.createDataFrame([(heads[k - 1].b, x.q, x.h) for k, x in enumerate(heads)], "hb int, hq long, hh long")
    rows = bucketed.join(F.broadcast(halos), (F.col("q") == F.col("hq")) & (F.col("h") == F.col("hh")), "left")
    own = F.struct(F.col("b"), F.lit(False).alias("halo"))
    rows = rows.withColumn("to", F.explode(F.when(F.col("hb").isNull(), F.array(own)).otherwise(F.array(own, F.struct(F.col("hb").alias("b"), F.lit(True).alias("halo"))))))
    dealt = (rows.select("to.b", "to.halo", "q", "h", "doc_id", "text").repartition(max(len(heads), 1), "b")
             .sortWithinPartitions("b", "halo", "q", "h").select("b", "doc_id", "halo", "text"))
    run, schema = _pairs(kind)
    return dealt.mapInArrow(run, schema)
