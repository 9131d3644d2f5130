"""Byte-level BPE encoding and decoding by overlapping chunks.

Texts of up to CHUNK code points are one piece. Longer ones are cut into chunks that overlap; the chunks are spread
over the cluster and pre-tokenised side by side. Where the pre-tokens of two neighbours begin at the same place in their
overlap, both go on alike, so the text may be cut there: the pieces between such places are encoded on their own, again
spread over the cluster, and their ids are put together in order. Decoding concatenates the raw bytes of the ids.

Cases: a null or empty text has no tokens and decodes to no bytes; strings that look like special tokens are ordinary
text; rows that repeat give repeated rows; a text whose overlaps never resynchronise (one pre-token longer than the
overlap) is one piece from the last cut on. The vocabulary file is a parameter and is read on each executor by path,
never copied; its ranks have a fixed size.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import small_batches, trimmed

#: Code points of a chunk, and of the part that it shares with the next.
CHUNK, OVERLAP = 1 << 15, 1 << 10


@lru_cache(maxsize=4)
def encoder(path: str, pattern: str) -> tiktoken.Encoding:
    with open(path, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    return tiktoken.Encoding("graphloom", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


@lru_cache(maxsize=4)
def splitter(pattern: str) -> regex.Pattern:
    return regex.compile(pattern)


def packed(ids: list[int]) -> bytes:
    return np.asarray(ids, dtype="<u4").tobytes()


def starts_in(text: str, low: int, high: int, pattern: str) -> list[int]:
    """Where pre-tokens of the text begin, from low up to high."""
    return [m.start() for m in splitter(pattern).finditer(text) if low <= m.start() < high]


def digest(ids: bytes, coder: tiktoken.Encoding) -> tuple[int, str, str]:
    """Count, hash of the ids, hash of the decoded bytes."""
    numbers = np.frombuffer(ids, dtype="<u4")
    return len(numbers), hashlib.sha256(ids).hexdigest(), hashlib.sha256(coder.decode_bytes(numbers.tolist())).hexdigest()


def _encode_whole(vocabulary: str, pattern: str, with_ids: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = encoder(vocabulary, pattern)
        for batch in batches:
            out: list[tuple] = []
            for text in batch.column("text"):
                ids = packed(coder.encode_ordinary(text.as_py() or ""))
                out.append((*digest(ids, coder), ids if with_ids else None))
            columns = list(zip(*out, strict=True)) if out else [[]] * 4
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(columns[0], pa.int64()), pa.array(columns[1], pa.string()), pa.array(columns[2], pa.string()), pa.array(columns[3], pa.binary())],
                names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "ids"])
    return run


def _boundaries(pattern: str, chunk: int, overlap: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = batch.select(["copy", "k", "at", "chunk"]).to_pylist()
            head, tail = [], []
            for r in rows:
                text, at = r["chunk"], r["at"]
                marks = starts_in(text, 0, len(text), pattern)
                head.append([at + m for m in marks if m < overlap])
                # the last pre-tokens of a chunk may be cut short, so their starts don't count
                safe = marks[-2] if len(marks) > 1 else 0
                tail.append([at + m for m in marks if chunk <= m <= safe])
            yield pa.RecordBatch.from_arrays(
                [pa.array([r["copy"] for r in rows], pa.int64()), pa.array([r["k"] for r in rows], pa.int32()), pa.array(head, pa.list_(pa.int64())), pa.array(tail, pa.list_(pa.int64()))],
                names=["copy", "k", "head", "tail"])
    return run


def _encode_pieces(vocabulary: str, pattern: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = encoder(vocabulary, pattern)
        for batch in batches:
            ids = [packed(coder.encode_ordinary(x.as_py() or "")) for x in batch.column("piece")]
            yield pa.RecordBatch.from_arrays([batch.column("copy"), batch.column("k"), pa.array(ids, pa.binary())], names=["copy", "k", "ids"])
    return run


def _digest_rows(vocabulary: str, pattern: str, with_ids: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = encoder(vocabulary, pattern)
        for batch in batches:
            out = [(*digest(b"".join(x.as_py()), coder), b"".join(x.as_py()) if with_ids else None) for x in batch.column("parts")]
            columns = list(zip(*out, strict=True)) if out else [[]] * 4
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(columns[0], pa.int64()), pa.array(columns[1], pa.string()), pa.array(columns[2], pa.string()), pa.array(columns[3], pa.binary())],
                names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "ids"])
    return run


OUT = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string, ids binary"


def encode(docs: DataFrame, vocabulary: str, pattern: str, with_ids: bool = True, chunk: int = CHUNK, overlap: int = OVERLAP) -> DataFrame:
    """Per row of (doc_id, text): n_tokens, hashes of ids and of the decoded bytes, and the ids (little-endian uint32)."""
    small_batches(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    whole = rows.where(F.coalesce(F.length("text"), F.lit(0)) <= chunk).mapInArrow(trimmed(_encode_whole(vocabulary, pattern, with_ids)), OUT)
    # rows with equal id and text are encoded once, then counted out again
    long = (rows.where(F.length("text") > chunk).groupBy("doc_id", F.xxhash64("text").alias("copy"), F.length("text").alias("n"))
            .agg(F.first("text").alias("text"), F.count("*").alias("times"))
            .withColumn("copy", F.xxhash64("doc_id", "copy", "n")))
    chunks = (long.withColumn("at", F.explode(F.sequence(F.lit(0), F.col("n") - 1, F.lit(chunk))))
              .select("copy", (F.col("at") / chunk).cast("int").alias("k"), F.col("at").cast("long").alias("at"), F.expr(f"substring(text, at + 1, {chunk + overlap})").alias("chunk"))
              .repartition("copy", "k"))
    marks = chunks.mapInArrow(trimmed(_boundaries(pattern, chunk, overlap)), "copy long, k int, head array<long>, tail array<long>")
    ahead = marks.select("copy", (F.col("k") - 1).alias("k"), "head")
    cuts = (marks.select("copy", "k", "tail").join(ahead, ["copy", "k"])
            .select("copy", F.array_max(F.array_intersect("tail", "head")).alias("cut")).where("cut is not null")
            .groupBy("copy").agg(F.sort_array(F.collect_list("cut")).alias("cuts")))
    pieces = (long.select("copy", "text", "n").join(cuts, "copy", "left")
              .withColumn("cuts", F.array_distinct(F.concat(F.array(F.lit(0).cast("long")), F.coalesce("cuts", F.expr("cast(array() as array<bigint>)")), F.array(F.col("n").cast("long")))))
              .select("copy", "cuts", "text", F.posexplode(F.slice("cuts", F.lit(1), F.size("cuts") - 1)).alias("k", "low"))
              .select("copy", "k", F.expr("substring(text, cast(low as int) + 1, cast(cuts[k + 1] - low as int))").alias("piece"))
              .repartition("copy", "k").mapInArrow(trimmed(_encode_pieces(vocabulary, pattern)), "copy long, k int, ids binary"))
    joined = (pieces.groupBy("copy").agg(F.transform(F.sort_array(F.collect_list(F.struct("k", "ids"))), lambda x: x["ids"]).alias("parts"))
              .join(long.select("copy", "doc_id", "times"), "copy")
              .select("doc_id", "parts", F.explode(F.sequence(F.lit(1).cast("long"), F.col("times"))).alias("_"))
              .select("doc_id", "parts").mapInArrow(trimmed(_digest_rows(vocabulary, pattern, with_ids)), OUT))
    return whole.unionByName(joined)


def decode(encoded: DataFrame, vocabulary: str, pattern: str) -> DataFrame:
    """Per row of (doc_id, ids): the decoded bytes; null ids give no bytes."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = encoder(vocabulary, pattern)
        for batch in batches:
            raw = [coder.decode_bytes(np.frombuffer(x.as_py() or b"", dtype="<u4").tolist()) for x in batch.column("ids")]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(raw, pa.binary())], names=["doc_id", "raw"])
    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, raw binary")
