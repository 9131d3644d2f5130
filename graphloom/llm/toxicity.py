"""Toxicity by multiple-instance learning: sentence scores joined by noisy-or, trained from document labels alone.

A sentence's score is p = sigmoid(bias + sum of its features' weights); a document's is 1 - prod(1 - p). The features of a
word are itself and its first PREFIXES bytes, so that inflected forms of a stem share weight. The weights are fitted by
minibatch Adam on the documents' log loss, so that the blame for a toxic document settles on the sentences that clean
documents don't have; those with p >= 0.5 are the offending ones. The weights have a fixed size (2 ** BITS hashed
features), so sending them to every task is bounded.

The fit takes at most SAMPLE labelled documents outside the held-out fold, of at most SAMPLE_BYTES each, the first by a
digest of their id; both bounds are parameters. Scoring takes every document and every word of it. doc_id, lang, source
and the labels are no inputs of a score.

Cases: null and empty texts hold no sentence and score 0; a document with several labels counts as toxic if one says so,
null labels count for nothing; with labels of one kind only every sentence gets that label (clean without labels);
repeated rows are scored alike; a null doc_id counts as the empty text in the fold's checksum.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import lowered, slices, small_batches, span_hashes

BITS, SAMPLE, SAMPLE_BYTES, PREFIXES = 18, 10_000, 16_384, (3, 4, 5, 6, 7, 8)
#: Sampled text whose features are kept between epochs; those of a larger sample are made anew for each batch.
CACHE_BYTES = 40 << 20
EPOCHS, BATCH, RATE, RIDGE = 12, 256, 0.05, 1e-4
FOLDS = 5

_TOKEN = np.zeros(256, dtype=bool)
_TOKEN[128:] = True
for _a, _b in ((48, 58), (65, 91), (97, 123)):
    _TOKEN[_a:_b] = True
_STOP = np.zeros(256, dtype=bool)
_STOP[[33, 46, 63]] = True
_BLANK = np.zeros(256, dtype=bool)
_BLANK[[9, 10, 11, 12, 13, 32]] = True


def tokens(buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, ...]:
    """The sentence and hash of each feature, then each sentence's row, first and last byte.

    A sentence ends with ., ! or ? before white space, with a newline, or with its row; only those with a word count.
    """
    n = len(buf)
    kind = _TOKEN[buf]
    start, end, closes = kind.copy(), kind.copy(), buf == 10
    if n:
        start[1:] &= ~kind[:-1]
        end[:-1] &= ~kind[1:]
        full = off[:-1] < off[1:]
        first, last = off[:-1][full], off[1:][full] - 1
        start[first] |= kind[first]
        end[last] |= kind[last]
        closes[:-1] |= _STOP[buf[:-1]] & _BLANK[buf[1:]]
        closes[last] = True
    starts, ends = np.flatnonzero(start), np.flatnonzero(end) + 1
    bounds = np.flatnonzero(closes) + 1
    sentence = np.searchsorted(bounds, starts, side="right")
    fresh = np.concatenate(([True], sentence[1:] != sentence[:-1])) if len(sentence) else np.zeros(0, bool)
    local, ids = np.cumsum(fresh) - 1, sentence[fresh]
    low = np.concatenate(([0], bounds))[ids]
    buf = lowered(buf)
    spans = [(local, starts, ends)]
    for k in PREFIXES:
        long = ends - starts > k
        spans.append((local[long], starts[long], starts[long] + k))
    owner = np.concatenate([x[0] for x in spans])
    shift = np.uint64(64 - BITS)
    feature = (span_hashes(buf, np.concatenate([x[1] for x in spans]), np.concatenate([x[2] for x in spans])) >> shift).astype(np.int64)
    return owner, feature, np.searchsorted(off, low, side="right") - 1, low, bounds[ids]


def sentence_scores(local: np.ndarray, word: np.ndarray, n: int, weights: np.ndarray) -> np.ndarray:
    """weights: of the words, then the bias."""
    z = np.bincount(local, weights=weights[word], minlength=n) + weights[-1]
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def noisy_or(p: np.ndarray, row: np.ndarray, rows: int) -> np.ndarray:
    return -np.expm1(np.bincount(row, weights=np.log1p(-np.minimum(p, 1 - 1e-12)), minlength=rows))


def gradient(local: np.ndarray, word: np.ndarray, row: np.ndarray, toxic: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """The slope of the documents' summed log loss by each weight; row: each sentence's document.

    With d = 1 - prod(1 - p), a sentence's slope by its own sum is p for a clean document, and -p * (1 - d) / d for a toxic one.
    """
    p = sentence_scores(local, word, len(row), weights)
    doc = np.clip(noisy_or(p, row, len(toxic)), 1e-6, 1 - 1e-6)
    blame = np.where(toxic > 0, -(1 - doc) / doc, 1.0)[row] * p
    out = np.empty_like(weights)
    out[:-1] = np.bincount(word, weights=blame[local], minlength=len(weights) - 1)
    out[-1] = blame.sum()
    return out


def fit(texts: list[str], labels: np.ndarray) -> np.ndarray:
    """The words' weights and the bias; zero weights and a bias that gives the rate if one kind of label is missing."""
    weights = np.zeros((1 << BITS) + 1)
    toxic = labels.astype(float)
    if len(toxic) == 0 or toxic.min() == toxic.max():
        weights[-1] = 30.0 if len(toxic) and toxic.max() > 0 else -30.0
        return weights
    raw = [t.encode() for t in texts]

    def bag(b: bytes) -> tuple[np.ndarray, ...]:
        local, feature, row, *_ = tokens(np.frombuffer(b, dtype=np.uint8), np.array([0, len(b)]))
        return local.astype(np.int32), feature.astype(np.int32), row

    kept = [bag(b) for b in raw] if sum(map(len, raw)) <= CACHE_BYTES else None
    weights[-1] = -4.0
    slope, square, step = np.zeros_like(weights), np.zeros_like(weights), 0
    shuffle = np.random.default_rng(7)
    for _ in range(EPOCHS):
        order = shuffle.permutation(len(raw))
        for at in range(0, len(order), BATCH):
            chosen = order[at : at + BATCH]
            bags = [kept[i] if kept else bag(raw[i]) for i in chosen]
            n_sent = np.array([len(x[2]) for x in bags])
            base = np.concatenate(([0], np.cumsum(n_sent)))
            local = np.concatenate([x[0] + b for x, b in zip(bags, base, strict=False)])
            word = np.concatenate([x[1] for x in bags])
            row = np.repeat(np.arange(len(chosen)), n_sent)
            g = gradient(local, word, row, toxic[chosen], weights) / len(chosen) + RIDGE * weights
            step += 1
            slope = 0.9 * slope + 0.1 * g
            square = 0.999 * square + 0.001 * g * g
            weights = weights - RATE * (slope / (1 - 0.9**step)) / (np.sqrt(square / (1 - 0.999**step)) + 1e-8)
    return weights


def fold(doc_id: Column) -> Column:
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % FOLDS


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, sample_bytes: int = SAMPLE_BYTES) -> np.ndarray:
    """Weights from at most sample labelled documents of at most sample_bytes that are not held out."""
    marked = (labels.where("toxic is not null and doc_id is not null").where(fold(F.col("doc_id")) != 0)
              .groupBy("doc_id").agg(F.max("toxic").alias("toxic")))
    chosen = marked.orderBy(F.md5(F.col("doc_id").cast("string").cast("binary")), "doc_id").limit(sample)
    rows = (docs.select("doc_id", F.col("text").cast("string").alias("text")).where(F.octet_length("text") <= sample_bytes)
            .join(F.broadcast(chosen), "doc_id").groupBy("doc_id").agg(F.min("text").alias("text"), F.max("toxic").alias("toxic"))
            .orderBy("doc_id").toArrow())
    return fit(rows.column("text").to_pylist(), np.array(rows.column("toxic").to_pylist(), dtype=float))


OUT = "score double, n_sentences int, offending array<struct<low: int, high: int, score: double>>"


def score(docs: DataFrame, weights: np.ndarray) -> DataFrame:
    """doc_id, held_out, score, predicted, n_sentences and the offending sentences (code points from low to high) of each row."""
    small_batches(docs.sparkSession)
    sent = weights.astype(np.float32)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w = sent.astype(np.float64)
        kind = pa.list_(pa.struct([("low", pa.int32()), ("high", pa.int32()), ("score", pa.float64())]))
        for batch in batches:
            for i, j, buf, off in slices(batch.column("text")):
                local, word, row, low, high = tokens(buf, off)
                p = sentence_scores(local, word, len(row), w)
                doc = np.clip(noisy_or(p, row, j - i), 0.0, 1.0)
                lead = np.concatenate(([0], np.cumsum((buf & 0xC0) != 0x80)))
                found: list[list[tuple]] = [[] for _ in range(j - i)]
                for s in np.flatnonzero(p >= 0.5):
                    at = lead[off[row[s]]]
                    found[row[s]].append({"low": int(lead[low[s]] - at), "high": int(lead[high[s]] - at), "score": float(p[s])})
                part = batch.slice(i, j - i)
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), pa.array(doc), pa.array(np.bincount(row, minlength=j - i).astype(np.int32)), pa.array(found, kind)],
                    names=["doc_id", "score", "n_sentences", "offending"])

    rows = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    scored = rows.mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, {OUT}")
    return scored.select("doc_id", (fold(F.col("doc_id")) == 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "n_sentences", "offending")
