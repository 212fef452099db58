"""Numbers along a total order, without gathering the rows in one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fathomry.operators.graph import staged


def numbered(rows: DataFrame, order: list[Column], name: str, first: int = 1) -> DataFrame:
    """``rows`` with ``name``: their place along ``order``, counted from ``first``, as a long.

    Rows are dealt over ranges of the order and sorted there; a range's numbers start after those of the ranges before it. Only
    the ranges' counts are gathered, one number for each partition.
    """
    own = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    placed = rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumns({"__range": F.spark_partition_id(), "__own": own})
    placed = staged(placed, "placed")
    starts, total = [], first
    for r in placed.groupBy("__range").agg(F.count("*").alias("n")).orderBy("__range").collect():
        starts.append((r["__range"], total))
        total += r["n"]
    ranges = rows.sparkSession.createDataFrame(starts, "__range int, __start long")
    return placed.join(F.broadcast(ranges), "__range").withColumn(name, F.col("__own") + F.col("__start")).drop("__range", "__own", "__start")
