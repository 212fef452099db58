"""Duplicates among files where they lie: digests come from the cache as far as it holds, only the rest is read.

Each stage is written to the checkpoint folder, so no file is read twice for groups, errors and the cache.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import NamedTuple

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fathomry.functions.hashing import WINDOW, hash_files
from fathomry.operators import dedup
from fathomry.operators.graph import staged

CHUNK = 256 * 1024


class Found(NamedTuple):
    groups: DataFrame  # path, size, mtime, hash of identical files
    errors: DataFrame  # path, error
    fresh: DataFrame  # rows for the cache
    stats: dict
    complete: bool


def digested(files: DataFrame, column: str, window: int | None) -> DataFrame:
    """``files`` with ``column`` filled by reading those where it is null, ``read`` for these, and ``error``."""
    new = hash_files(files.where(F.col(column).isNull()), window).select("path", "digest", "error", F.lit(True).alias("read"))
    out = files.join(new, "path", "left").withColumn(column, F.coalesce(column, "digest")).withColumn("read", F.coalesce("read", F.lit(False)))
    return staged(out.drop("digest"))


def find(files: DataFrame, cache: DataFrame, verify: bool = False, window: int = WINDOW, cancelled: Callable[[], bool] = lambda: False) -> Found:
    """Identical files of ``files`` (path, size, mtime, dev, ino; each path once).

    ``cancelled`` is asked between the stages. A cancelled search has no groups and is not complete; what it has read is in
    ``fresh`` all the same.
    """
    spark = files.sparkSession
    stats: dict[str, int] = {"files_scanned": files.count()}
    errors = spark.createDataFrame([], "path string, error string")
    nothing = spark.createDataFrame([], "path string, size bigint, mtime bigint, hash string")

    sized = staged(dedup.cached(dedup.size_groups(files), cache, window))
    stats["candidates_after_size"] = sized.count()
    if cancelled():
        return Found(nothing, errors, spark.createDataFrame([], cache.schema), stats, False)

    part = digested(sized, "partial", window)
    halves = dedup.crowded(part.where("partial is not null").drop("error", "read"), ["size", "partial"])
    stats["candidates_after_partial"] = halves.count()
    if cancelled():
        return Found(nothing, part.where("error is not null").select("path", "error"), rows_to_cache(part, window), stats, False)

    whole = digested(halves, "full", None)
    groups = dedup.crowded(whole.where("full is not null").withColumnRenamed("full", "hash"), ["size", "hash"]).select("path", "size", "mtime", "hash")
    stats["candidates_after_full"] = groups.count()
    errors = part.unionByName(whole).where("error is not null").select("path", "error")
    fresh = rows_to_cache(part.drop("full").join(whole.select("path", "full", F.col("error").alias("late")), "path", "left").where("late is null").drop("late"), window)
    if verify:
        groups, failed = verified(groups)
        errors = errors.unionByName(failed)
        stats["candidates_after_verify"] = groups.count()
    work = part.select("read", F.least("size", F.lit(2 * window)).alias("bytes")).unionByName(whole.select("read", F.col("size").alias("bytes")))
    sums = work.agg(F.count_if(~F.col("read")).alias("hits"), F.coalesce(F.sum(F.when(F.col("read"), F.col("bytes"))), F.lit(0)).alias("bytes")).first()
    return Found(groups, errors, fresh, stats | {"cache_hits": sums["hits"], "bytes_hashed": sums["bytes"]}, True)


def rows_to_cache(rows: DataFrame, window: int) -> DataFrame:
    return rows.where("partial is not null").select("path", "size", "mtime", "dev", "ino", F.lit(window).cast("long").alias("partial_bytes"), "partial", "full")


def same_bytes(pairs: DataFrame) -> DataFrame:
    """Rows (path, first, others) with ``same`` and ``error``: the file equals ``first`` byte for byte; null if it can't be read."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for path, first in zip(batch["path"], batch["first"], strict=True):
                same, error = False, None
                try:
                    with open(path, "rb") as a:
                        try:
                            with open(first, "rb") as b:
                                while (x := a.read(CHUNK)) == b.read(CHUNK) and x:
                                    pass
                                same = not x and not b.read(1)
                        except OSError:
                            # A first one that can't be read has an error of its own; the others are compared without it.
                            same, error = (None, "unreadable") if path == first else (False, None)
                except OSError as e:
                    same, error = None, str(e)
                out.append((same, error))
            yield batch.assign(same=pd.array([s for s, _ in out], dtype="boolean"), error=pd.array([e for _, e in out], dtype="string"))

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pairs.schema.fields)
    return pairs.mapInPandas(run, f"{schema}, same boolean, error string")


def verified(groups: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Groups (path, size, mtime, hash) of files that are equal byte for byte, and errors.

    Every file is compared with the first of its group, in chunks and each on its own, so a group is never gathered. Files unlike
    it are compared with the first of themselves, until none is left: one round more for each further content of one hash. Of such
    contents the later ones have the path of their first behind the hash.
    """
    rest, done, failed = groups, None, None
    while True:
        firsts = rest.groupBy("size", "hash").agg(F.min("path").alias("first"), F.count("*").alias("n")).where("n > 1").drop("n")
        compared = staged(same_bytes(rest.join(firsts, ["size", "hash"])))
        equal, bad = compared.where("same").select(*groups.columns, "first"), compared.where("error is not null").select("path", "error")
        done = equal if done is None else done.unionByName(equal)
        failed = bad if failed is None else failed.unionByName(bad)
        rest = compared.where("not same").select(*groups.columns)
        if rest.isEmpty():
            break
    kept = dedup.crowded(done, ["size", "hash", "first"])
    heads = kept.groupBy("size", "hash").agg(F.min("first").alias("head"))
    name = F.when(F.col("first") == F.col("head"), F.col("hash")).otherwise(F.concat("hash", F.lit("#"), "first"))
    return kept.join(heads, ["size", "hash"]).withColumn("hash", name).select(*groups.columns), failed


def renewed(cache: DataFrame, found: Found, roots: list[str], seen: DataFrame) -> DataFrame:
    """The cache after a search: what it read is kept in any case; files that are gone leave it only after a complete one."""
    merged = dedup.cache_upsert(cache, found.fresh)
    return dedup.cache_prune(merged, roots, seen) if found.complete else merged
