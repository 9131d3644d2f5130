"""Cutting lineage in loops: tables written in the folder that the cluster names in spark.checkpoint.dir."""

from __future__ import annotations

import atexit
import contextlib
import functools
import shutil
import tempfile
import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession


def cut(df: DataFrame) -> DataFrame:
    """df, computed, written to the shared folder and read back, so that later plans begin anew with sizes as they are.

    A checkpoint would carry on the estimated size of the plan it cuts, which grows from round to round.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/graphloom-{spark.sparkContext.applicationId}/{uuid.uuid4().hex}"
    with shuffles_freed(spark):
        df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


@contextlib.contextmanager
def shuffles_freed(spark: SparkSession) -> Iterator[None]:
    """What runs inside gives its shuffle files back as each of its plans ends, not when the driver happens to collect its garbage."""
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key, None)
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        spark.conf.unset(key) if before is None else spark.conf.set(key, before)


def shared_folder(spark: SparkSession) -> str:
    """The folder that the cluster names in spark.checkpoint.dir, without a slash at its end.

    In local mode, where one machine is all there is, a temporary folder stands in for a missing one, and goes when the process ends; elsewhere a
    missing setting is an error, as executors could not read each other's files.
    """
    where = spark.conf.get("spark.checkpoint.dir", None)
    if where:
        return where.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    return _local_folder()


@functools.cache
def _local_folder() -> str:
    where = tempfile.mkdtemp(prefix="graphloom-")
    atexit.register(shutil.rmtree, where, ignore_errors=True)
    return "file://" + where


def forget(*tables: DataFrame) -> None:
    """Removes tables that cut wrote and that no later plan reads."""
    for t in tables:
        spark = t.sparkSession
        for path in {f.rsplit("/", 1)[0] for f in t.inputFiles()}:
            p = spark._jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)
