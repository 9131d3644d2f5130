"""Sharding by proportional stratified interleaving, with DataFrame functions only.

The rows of each source are shuffled by a seeded digest and ranked; a row's fractional rank is (rank + 0.5) / rows of its
source. Sorted by it, every stretch of rows holds the sources in their shares, so cutting the order into equal stretches
gives shards that match the mixture. The law is `rows`: the shards' counts are at most one apart.

Cases: null sources are a source of their own, the last; null texts have size 1 and CRC 0; rows with one doc_id follow
each other by size and CRC, and rows alike in all three are interchangeable; an empty table gives an empty result.
Ranks come from bucket counts (ranks.py), so that no task gets a whole source.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Stash
from .ranks import ranked, unit

SHARDS, SEED = 8, "interleave-1"


def interleave(docs: DataFrame, shards: int = SHARDS, seed: str = SEED) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard of each row of (doc_id, source, text)."""
    spark = docs.sparkSession
    stash = Stash(spark)
    base = stash.keep(docs.select(
        F.col("doc_id"),
        F.when(F.col("source").isNull(), F.lit("1")).otherwise(F.concat(F.lit("0"), F.col("source").cast("string"))).alias("stratum"),
        F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))).cast("binary")).alias("key"),
        (F.coalesce(F.octet_length("text"), F.lit(0)) + 1).cast("long").alias("size"),
        F.crc32(F.coalesce("text", F.lit("")).cast("binary")).alias("text_crc32"),
    ))
    n = base.count()
    order = [F.col("key"), F.col("size"), F.col("text_crc32")]
    first = ranked(base, ["stratum"], unit(F.col("key")), order, n, "rank")
    sizes = base.groupBy("stratum").agg(F.count("*").alias("rows"))
    placed = stash.keep(first.join(sizes, "stratum").withColumn("part", (F.col("rank") + 0.5) / F.col("rows")).drop("rank", "rows"))
    stash.forget(base)
    placed = placed.withColumn("all", F.lit(0))
    at = ranked(placed, ["all"], F.col("part"), [F.col("part"), F.col("stratum"), *order], n, "at")
    shard = F.expr(f"(at * {shards}) div {max(n, 1)}")
    return at.withColumn("shard", shard).select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), F.col("shard").cast("int").alias("shard"),
        (F.col("at") - F.expr(f"(shard * {n} + {shards - 1}) div {shards}")).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))


def oracle(shards: int = SHARDS, seed: str = SEED) -> str:
    """The same rows in DuckDB; its CRC table is built from the polynomial."""
    step = "list_reduce(range(0, 9), lambda c, _: CASE WHEN _ = 0 THEN c WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384::BIGINT) ELSE c >> 1 END, i)"
    return f"""
WITH crc AS (SELECT list({step} ORDER BY i) AS t FROM range(0, 256) r(i)),
base AS (SELECT doc_id, CASE WHEN source IS NULL THEN '1' ELSE '0' || source END AS stratum,
    md5('{seed}:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS key, coalesce(strlen(text), 0) + 1 AS size,
    CAST(xor(list_reduce(list_transform(regexp_extract_all(hex(encode(coalesce(text, ''))), '..'), lambda h: CAST('0x' || h AS BIGINT)),
        lambda c, x: xor(c >> 8, t[(xor(c, x) & 255) + 1]), 4294967295::BIGINT), 4294967295::BIGINT) AS BIGINT) AS text_crc32
    FROM documents, crc),
placed AS (SELECT *, (row_number() OVER (PARTITION BY stratum ORDER BY key, size, text_crc32) - 1 + 0.5::DOUBLE) / count(*) OVER (PARTITION BY stratum) AS part FROM base),
ordered AS (SELECT *, row_number() OVER (ORDER BY part, stratum, key, size, text_crc32) - 1 AS pos, count(*) OVER () AS n FROM placed)
SELECT doc_id, size, text_crc32, 'rows' AS law, CAST((pos * {shards}) // n AS INTEGER) AS shard,
    pos - (((pos * {shards}) // n) * n + {shards - 1}) // {shards} AS slot, CAST(NULL AS INTEGER) AS grown_shard
FROM ordered"""
