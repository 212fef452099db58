"""Live scans: entries arrive as files, results are always those of the batches so far.

Sinks are Parquet tables that carry the batch's number; a reader takes the newest row of each key. Checkpoints go to the
folder given, which all executors must share.
"""

from __future__ import annotations

import time

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from fathomry.functions import paths as P


def entry_stream(spark: SparkSession, folder: str, schema: str, pattern: str = "*", files_per_trigger: int = 1000) -> DataFrame:
    return spark.readStream.schema(schema).option("pathGlobFilter", pattern).option("maxFilesPerTrigger", files_per_trigger).parquet(folder)


def rollup_stream(entries: DataFrame) -> DataFrame:
    """path, agg_apparent, agg_allocated, items of every directory above the entries so far; for update mode."""
    spread = entries.select(F.explode(P.prefixes("path")).alias("path"), F.when(F.col("kind") != "Dir", F.col("apparent")).otherwise(0).alias("a"), F.when(F.col("kind") != "Dir", F.col("allocated")).otherwise(0).alias("b"))
    return spread.groupBy("path").agg(F.sum("a").alias("agg_apparent"), F.sum("b").alias("agg_allocated"), F.count("*").alias("items"))


def first_links(entries: DataFrame) -> DataFrame:
    """Entries without further links to a file that an earlier batch or row brought. State grows with the links seen."""
    link = F.coalesce((F.col("kind") != "Dir") & (F.col("nlink") > 1), F.lit(False))
    return entries.where(link).dropDuplicates(["dev", "ino"]).unionByName(entries.where(~link))


def project_stream(entries: DataFrame, rules: list[tuple]) -> DataFrame:
    """dir, rule_id of every directory that holds a marker, each once, as soon as the marker is seen. State grows with them."""
    from fathomry.operators.buildtrees import rule_match

    return rule_match(entries, rules)


class LiveScan:
    """A stream into a table that can be paused, resumed and cancelled.

    What a batch has written stays; a pause ends the query between batches, and the checkpoint tells a resumed one where to go
    on. A cancelled scan can't be resumed; its table keeps the batches that were complete, without the unfinished one.
    """

    def __init__(self, stream: DataFrame, path: str, checkpoint: str, mode: str = "append", interval: str | None = None):
        self.args, self.query, self.state = (stream, path, checkpoint, mode, interval), None, "ready"

    def resume(self) -> StreamingQuery:
        if self.state == "cancelled":
            raise RuntimeError("a cancelled scan can't go on")
        if self.query is None or not self.query.isActive:
            self.query = to_table(*self.args)
        self.state = "running"
        return self.query

    def pause(self) -> None:
        self._end("paused")

    def cancel(self) -> None:
        self._end("cancelled")

    def _end(self, state: str) -> None:
        if self.query is not None:
            self.query.stop()
        self.state = state


def to_table(stream: DataFrame, path: str, checkpoint: str, mode: str = "append", interval: str | None = None, few: bool = False) -> StreamingQuery:
    """Write each batch, numbered, to a Parquet table; without an interval, what is there now and then stop. ``few``: in as few
    files as its size asks for, and not one of each task, for a stream that reads the table by files."""

    def write(batch: DataFrame, number: int) -> None:
        conf = batch.sparkSession.conf
        # A stream's session doesn't adapt its plans, for its state must not be dealt anew; what is written of a batch may be.
        adaptive = conf.get("spark.sql.adaptive.enabled")
        conf.set("spark.sql.adaptive.enabled", "true" if few else adaptive)
        try:
            # A batch that is repeated after a failure replaces its own rows.
            rows = batch.hint("rebalance") if few else batch
            rows.withColumn("batch", F.lit(number)).write.mode("overwrite").parquet(f"{path}/batch={number}")
        finally:
            conf.set("spark.sql.adaptive.enabled", adaptive)

    out = stream.writeStream.outputMode(mode).foreachBatch(lambda batch, number: write(batch.drop("batch") if "batch" in batch.columns else batch, number)).option("checkpointLocation", checkpoint)
    return (out.trigger(processingTime=interval) if interval else out.trigger(availableNow=True)).start()


def latest(spark: SparkSession, path: str, schema: str, keys: list[str]) -> DataFrame:
    """The newest row of each key of a table that ``to_table`` wrote in update mode."""
    rows = spark.read.schema(f"{schema}, batch int").option("basePath", path).parquet(path)
    newest = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("batch")))
    return rows.withColumn("place", newest).where("place = 1").drop("place", "batch")


def appended(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(f"{schema}, batch int").option("basePath", path).parquet(path).drop("batch")


class Throttle:
    """Progress reports at most every ``millis``; the first and the last one always."""

    def __init__(self, report, millis: int = 100):  # noqa: ANN001
        self.report, self.wait, self.last = report, millis / 1000, float("-inf")

    def __call__(self, progress: dict, final: bool = False) -> None:
        now = time.monotonic()
        if final or now - self.last >= self.wait:
            self.last = now
            self.report(progress)


def progress_rates(done: int, total: int, seconds: float) -> tuple[float, float | None]:
    """Throughput and the seconds left, null while nothing is done."""
    rate = done / seconds if seconds > 0 else 0.0
    return rate, (total - done) / rate if rate > 0 else None
