"""Text, directory, upload and resume scans."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

PATTERNS = "{*.txt,*.text,*.md}"


def read_texts(spark: SparkSession, path: str, pattern: str = PATTERNS, recursive: bool = True, limit: int | None = None) -> DataFrame:
    """(path, text) of the matching files in order of path, perhaps only the first so many."""
    rows = spark.read.option("pathGlobFilter", pattern).option("recursiveFileLookup", str(recursive).lower()).text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text"))
    return rows if limit is None else rows.orderBy("path").limit(limit)


def globs(patterns: str) -> str:
    """A comma list of globs as one."""
    parts = [p.strip() for p in patterns.split(",") if p.strip()]
    return parts[0] if len(parts) == 1 else "{" + ",".join(parts) + "}"


def read_files(spark: SparkSession, path: str, pattern: str = "*", recursive: bool = True) -> DataFrame:
    """(path, content) of the matching files."""
    return spark.read.format("binaryFile").option("pathGlobFilter", globs(pattern)).option("recursiveFileLookup", str(recursive).lower()).load(path).select("path", "content")


def sniffed(files: DataFrame) -> DataFrame:
    """files (path, content) with kind: pdf by its first bytes, else text if it is UTF-8, else unsupported; and text of the latter."""
    pdf = F.hex(F.substring("content", 1, 4)) == "25504446"
    utf8 = F.is_valid_utf8(F.col("content").cast("string"))
    kind = F.when(pdf, "pdf").when(utf8, "text").otherwise("unsupported")
    return files.withColumn("kind", kind).withColumn("text", F.when(F.col("kind") == "text", F.col("content").cast("string")))


def unprocessed(documents: DataFrame, done: DataFrame, key: str = "source") -> DataFrame:
    """Documents whose key is not among those done: what a resumed run still has to do."""
    return documents.join(done.select(key).distinct(), key, "left_anti")
