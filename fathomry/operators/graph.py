"""Connected components by alternating large and small stars: few rounds, each a handful of aggregations."""

from __future__ import annotations

import atexit
import re
import shutil
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from functools import cache

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


@cache
def own_folder() -> str:
    folder = tempfile.mkdtemp(prefix="fathomry-")
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    return folder


def shared_folder(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``; where it is unset, a temporary folder, but only if this machine runs all tasks."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        raise ValueError("set spark.checkpoint.dir to a folder that all machines of the cluster share")
    return own_folder()


#: Folders to remove when the driver ends, with the session that wrote them.
_left: dict[str, SparkSession] = {}


def remove(spark: SparkSession, path: str) -> None:
    """A folder of the store that Spark writes to; one that is not there is no error."""
    _left.pop(path, None)
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def _remove_all() -> None:
    for path, spark in reversed(list(_left.items())):
        try:
            remove(spark, path)
        except Exception:  # the session has ended; its store can't be reached any more
            pass


def removed(spark: SparkSession, path: str) -> None:
    """Remove the folder when the driver ends."""
    if not _left:
        atexit.register(_remove_all)
    _left.setdefault(path, spark)


#: Spark's own setting: a query's shuffle files go when it has ended, not when the driver happens to collect garbage.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def freed(spark: SparkSession) -> Iterator[None]:
    """The shuffle files of what is written inside go as soon as it is written: no later step reads them."""
    before = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.unset(CLEANUP) if before is None else spark.conf.set(CLEANUP, before)


#: Writer options of staged tables: paths in order are stored as what differs from the one before.
COMPACT = {"compression": "zstd", "parquet.writer.version": "v2"}


def staged(df: DataFrame, name: str = "stage") -> DataFrame:
    """``df`` written as Parquet into the shared folder and read back: lineage ends there, and what several readers need is
    computed once. The files go when the driver ends, or by ``dropped``."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    removed(spark, path)
    with freed(spark):
        df.write.options(**COMPACT).parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._fathomry_path = path
    return out


def added(df: DataFrame, rows: DataFrame) -> DataFrame:
    """A staged table and further rows of its columns, in one folder."""
    with freed(df.sparkSession):
        rows.write.mode("append").options(**COMPACT).parquet(df._fathomry_path)
    out = df.sparkSession.read.schema(df.schema).parquet(df._fathomry_path)
    out._fathomry_path = df._fathomry_path
    return out


def dropped(*tables: DataFrame) -> None:
    """Remove staged tables that nothing reads any more."""
    for df in tables:
        remove(df.sparkSession, df._fathomry_path)


def connected(edges: DataFrame) -> DataFrame:
    """node, root (its component's smallest node) for every node of the edges (a, b)."""
    now = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct()
    now = staged(now, "edges")
    while True:
        ways = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = ways.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = ways.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
        new = staged(small.unionByName(low.select("u", F.col("m").alias("v"))).distinct(), "edges")
        dropped(now)
        many = new.groupBy("u").count().where("count > 1")
        if many.isEmpty() and new.join(new.select(F.col("u").alias("v")), "v", "left_semi").isEmpty():
            roots = new.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
            return new.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(roots)
        now = new
