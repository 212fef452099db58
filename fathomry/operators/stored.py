"""A rollup that is stored and kept up to date: removing a subtree costs its ancestors, not another pass over all entries.

In its folder lie the rows as they were summed (``rows-*``, named by ``current``), what removals subtract from ancestors
(``changes``) and the removed tops (``removed``). The rows of a removal have its path's hash as their file's name and replace
themselves, and the top is noted last: a removal that is repeated, also after a crash, counts once. One writer at a time.
"""

from __future__ import annotations

import hashlib
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fathomry.functions import paths as P
from fathomry.operators.graph import remove as delete
from fathomry.operators.tree import rolled_up
from fathomry.sources.files import exists, read_pointer, switch

ROW = "path string, kind string, agg_apparent bigint, agg_allocated bigint, items bigint, hardlink_dup boolean"
CHANGE = "path string, apparent bigint, allocated bigint, items bigint, change string"
#: Removals after which rows are written anew, without what was removed.
MOST = 100


class StoredRollup:
    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    @classmethod
    def create(cls, entries: DataFrame, folder: str) -> StoredRollup:
        """From entries whose hard links are marked."""
        out = cls(entries.sparkSession, folder)
        out._write(rolled_up(entries))
        return out

    def _write(self, rolled: DataFrame) -> None:
        name = f"rows-{uuid.uuid4().hex}"
        rolled.select(*(c.split()[0] for c in ROW.split(", "))).write.parquet(f"{self.folder}/{name}/rows")
        switch(self.spark, f"{self.folder}/current", name)

    def _place(self, kind: str) -> str:
        """Changes and removals belong to the rows that they change: new rows begin without any."""
        return f"{self.folder}/{read_pointer(self.spark, f'{self.folder}/current')}/{kind}"

    def _read(self, kind: str, schema: str) -> DataFrame:
        place = self._place(kind)
        return self.spark.read.schema(schema).option("basePath", place).parquet(place) if exists(self.spark, place) else self.spark.createDataFrame([], schema)

    def removed(self) -> list[str]:
        return sorted(r["path"] for r in self._read("removed", "path string").collect())

    def rows(self) -> DataFrame:
        """The rollup now. Marks of hard links stay as they are: a surviving duplicate of a removed first link isn't promoted."""
        rows, gone = self._read("rows", ROW), self.removed()
        if not gone:
            return rows
        rows = rows.where(~P.under_any("path", gone))
        less = self._read("changes", CHANGE).groupBy("path").agg(*(F.sum(c).alias(f"less_{c}") for c in ("apparent", "allocated", "items")))
        rows = rows.join(F.broadcast(less), "path", "left")  # ancestors of MOST removals at most
        value = lambda c, d: (F.col(c) - F.coalesce(d, F.lit(0))).alias(c)
        return rows.select("path", "kind", value("agg_apparent", "less_apparent"), value("agg_allocated", "less_allocated"), value("items", "less_items"), "hardlink_dup")

    def remove(self, path: str) -> bool:
        """Take a subtree out; false if it is not there (any more). Reads its own row and those of its ancestors alone."""
        gone = self.removed()
        if any(path == g or path.startswith(f"{g}/") for g in gone):
            return False
        if len(gone) >= MOST:
            self.compact()
        name = hashlib.sha256(path.encode()).hexdigest()
        found = self._read("rows", ROW).where(F.col("path") == path).first()
        if found is None:
            return False
        less = self._read("changes", CHANGE).where((F.col("path") == path) & (F.col("change") != name))
        own = less.agg(*(F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("apparent", "allocated", "items"))).first()
        counted = not found["hardlink_dup"]
        sizes = (found["agg_apparent"] - own["apparent"], found["agg_allocated"] - own["allocated"]) if counted else (0, 0)
        parts = path.strip("/").split("/")
        above = ["/" + "/".join(parts[:i]) for i in range(1, len(parts))]
        changes = self.spark.createDataFrame([(a, *sizes, found["items"] - own["items"] + 1) for a in above], "path string, apparent long, allocated long, items long")
        changes.coalesce(1).write.mode("overwrite").parquet(f"{self._place('changes')}/change={name}")
        self.spark.createDataFrame([(path,)], "path string").coalesce(1).write.mode("overwrite").parquet(f"{self._place('removed')}/change={name}")
        return True

    def compact(self) -> None:
        """Write the rows as they are now, and begin with no changes."""
        old = read_pointer(self.spark, f"{self.folder}/current")
        self._write(self.rows())
        delete(self.spark, f"{self.folder}/{old}")
