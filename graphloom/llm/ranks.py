"""Ranks over any number of rows without a window over a hot group: small buckets, their counts, and two levels of prefix sums."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Rows that a bucket holds on average, and buckets of a coarse bucket.
BUCKET_ROWS, COARSE = 512, 1024


def buckets(n_rows: int) -> int:
    return max(1, -(-n_rows // BUCKET_ROWS))


def unit(digest: Column) -> Column:
    """The first 32 bits of a hexadecimal digest as a number from 0 to 1, 1 excluded."""
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("double") / float(1 << 32)


def before(counts: DataFrame, group: list[str]) -> DataFrame:
    """counts has group, b and c; returns group, b and what the group's lower b hold together."""
    coarse = counts.groupBy(*group, F.floor(F.col("b") / COARSE).alias("cb")).agg(F.sum("c").alias("cc"))
    w = Window.partitionBy(*group).orderBy("cb").rowsBetween(Window.unboundedPreceding, -1)
    coarse = coarse.select(*group, "cb", F.coalesce(F.sum("cc").over(w), F.lit(0)).alias("far"))
    w = Window.partitionBy(*group, "cb").orderBy("b").rowsBetween(Window.unboundedPreceding, -1)
    fine = counts.withColumn("cb", F.floor(F.col("b") / COARSE)).withColumn("near", F.coalesce(F.sum("c").over(w), F.lit(0)))
    return fine.join(coarse, [*group, "cb"]).select(*group, "b", (F.col("far") + F.col("near")).alias("before"))


def ranked(df: DataFrame, group: list[str], place: Column, order: list[Column], n_rows: int, name: str) -> DataFrame:
    """Adds name: the 0-based rank within group by (place, order).

    place is a number from 0 to 1 that spreads a group's rows about evenly; rows that tie in all of order are alike, so
    either may come first. group's columns have no nulls.
    """
    b = buckets(n_rows)
    df = df.withColumn("b", F.least(F.floor(place * b), F.lit(b - 1)).cast("long"))
    offsets = before(df.groupBy(*group, "b").agg(F.count("*").alias("c")), group)
    w = Window.partitionBy(*group, "b").orderBy(*order)
    df = df.withColumn("near", F.row_number().over(w).cast("long") - 1)
    return df.join(offsets, [*group, "b"]).withColumn(name, F.col("before") + F.col("near")).drop("b", "before", "near")
