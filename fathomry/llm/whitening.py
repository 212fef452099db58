"""Embedding whitening: a RowMatrix over exactly centred rows gives the covariance, a local eigendecomposition the components.

Entries become whole numbers ``x = floor(1024 * c) + 100000``, so that sums are exact: with n vectors and sums S the centred
entry is (n * x - S) / n, whose numerator is a whole number too. ``RowMatrix.computeGramianMatrix`` over these rows, divided
by n, is the covariance; its eigenvectors (one small matrix on the driver, dimension squared) go to all tasks, which project
and scale their rows.

Cases: rows whose vector is null or holds a null or non-finite entry take no part, nor do those with an entry whose x doesn't
fit into a long (``LIMIT``) or of another length than most vectors have (the greater length among equally frequent ones).
Null and repeated ids are rows like any other; other columns are not touched. Without rows the result is empty. A component
without variance (beyond rounding) has null as ``whitened`` and no part in ``identity_error``; without any variance
``explained`` is null. ``deviation`` is null where it exceeds a long.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.ml.functions import array_to_vector
from pyspark.mllib.linalg.distributed import RowMatrix
from pyspark.mllib.util import MLUtils
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fathomry.llm.common import read, staged

SCALE, SHIFT = 1024, 100_000
#: Entries of this size and more have no x that fits into a long.
LIMIT = float(1 << 52)
COMPONENTS = 8
LONG = 1 << 63


@dataclass
class Whitening:
    """What is fitted: n rows, sums by dimension, eigenvalues falling, one component a column, share of each."""

    n: int
    sums: list[int]
    largest: int
    values: np.ndarray
    vectors: np.ndarray
    trace: float

    def scaled(self, k: int) -> np.ndarray:
        """The first k components over their deviations; those without variance are NaN."""
        e = self.values[:k]
        floor = len(self.sums) * np.finfo(float).eps * max(self.values[0], 0.0)
        return self.vectors[:, :k] / np.sqrt(np.where(e > floor, e, np.nan))


def usable(vectors: DataFrame, vector: str = "embedding") -> DataFrame:
    """The rows that take part, with ``x`` in place of the vector."""
    small = lambda c: F.coalesce(F.abs(c.cast("double")) < LIMIT, F.lit(False))
    fits = F.forall(vector, small)
    sound = vectors.where(F.col(vector).isNotNull() & (F.size(vector) > 0) & F.coalesce(fits, F.lit(False)))
    length = sound.groupBy(F.size(vector).alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    # Guarded again, as Spark may compute x before it has filtered.
    x = F.transform(vector, lambda c: F.when(small(c), F.floor(c.cast("double") * SCALE).cast("long") + SHIFT))
    return sound.where(F.size(vector) == (length["d"] if length else 0)).withColumn(vector, x).withColumnRenamed(vector, "x")


def centred(x: str, n: int, sums: list[int], largest: int) -> Column:
    """(n * x - S) / n as doubles; the numerator is exact, in longs where they hold it, else in decimals."""
    if n * largest < LONG // 4:
        return F.zip_with(x, F.array(*(F.lit(s).cast("long") for s in sums)), lambda v, s: (v * F.lit(n).cast("long") - s).cast("double") / n)
    whole = F.array(*(F.lit(str(s)).cast("decimal(38,0)") for s in sums))
    return F.zip_with(x, whole, lambda v, s: (v.cast("decimal(19,0)") * F.lit(n).cast("decimal(18,0)") - s).cast("double") / n)


def covariance(rows: DataFrame, column: str, n: int, d: int) -> np.ndarray:
    """Of rows that are centred already, with divisor n."""
    vectors = MLUtils.convertVectorColumnsFromML(rows.select(array_to_vector(column).alias("v")), "v")
    return RowMatrix(vectors, n, d).computeGramianMatrix().toArray() / n


def fit(points: DataFrame) -> Whitening | None:
    """From ``usable`` rows; None without any."""
    by_place = points.select(F.posexplode("x").alias("at", "v")).groupBy("at").agg(
        F.count("*").alias("n"), F.sum(F.col("v").cast("decimal(28,0)")).alias("s"), F.max(F.greatest(F.col("v"), -F.col("v"))).alias("m")
    )
    found = by_place.orderBy("at").collect()  # one row a dimension
    if not found:
        return None
    n, sums, largest = found[0]["n"], [int(r["s"]) for r in found], max(r["m"] for r in found)
    v = covariance(points.select(centred("x", n, sums, largest).alias("c")), "c", n, len(sums))
    values, vectors = np.linalg.eigh(v)
    values, vectors = values[::-1], vectors[:, ::-1]
    top = np.abs(vectors).argmax(axis=0)
    vectors = vectors * np.where(vectors[top, np.arange(len(values))] < 0, -1.0, 1.0)  # one sign, whatever the solver's
    return Whitening(n, sums, largest, values, vectors, float(np.trace(v)))


def deviations(y: np.ndarray) -> list[int | None]:
    """Sums of squares by row, exact; None beyond a long."""
    most = int(np.abs(y).max(initial=0))
    if y.shape[1] * most * most < LONG:
        return (y * y).sum(axis=1).tolist()
    wide = y.astype(object)
    return [s if s < LONG else None for s in (wide * wide).sum(axis=1).tolist()]


def transform(points: DataFrame, model: Whitening, k: int = COMPONENTS) -> DataFrame:
    """``usable`` rows with ``deviation`` and ``whitened`` (an array, one value a component) in place of ``x``."""
    spark = points.sparkSession
    shared = spark.sparkContext.broadcast((model.n, model.sums, model.n * model.largest < LONG // 4, model.scaled(k)))

    def whiten(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        n, sums, narrow, scaled = shared.value
        for frame in frames:
            if not len(frame):
                continue
            x = np.stack(frame["x"].to_list()).astype(np.int64)
            y = x * n - np.array(sums, np.int64) if narrow else x.astype(object) * n - np.array(sums, object)
            z = (y.astype(float) / n) @ scaled
            out = frame.drop(columns=["x"])
            out["deviation"] = pd.array(deviations(y), dtype="Int64")
            out["whitened"] = [[None if np.isnan(v) else v for v in row] for row in z.tolist()]
            yield out

    # Longs travel as text: beside nulls they would become floats in pandas.
    kept = [f for f in points.schema.fields if f.name not in ("x", "deviation", "whitened")]
    long = {f.name for f in kept if isinstance(f.dataType, T.LongType)}
    as_text = [F.col(f.name).cast("string" if f.name in long else f.dataType).alias(f.name) for f in kept]
    sent = points.select(*as_text, "x")
    schema = T.StructType([*(f for f in sent.schema.fields if f.name != "x"), T.StructField("deviation", T.LongType()), T.StructField("whitened", T.ArrayType(T.DoubleType()))])
    rows = sent.mapInPandas(whiten, schema)
    return rows.select(*(F.col(f.name).cast(f.dataType).alias(f.name) for f in kept), "deviation", "whitened")


def identity_error(white: DataFrame, model: Whitening) -> float | None:
    """The largest entry of the covariance of ``whitened``, minus the identity; over components with variance."""
    live = np.flatnonzero(~np.isnan(model.scaled(COMPONENTS)).any(axis=0)).tolist()
    if not live:
        return None
    means = white.select(*(F.avg(F.col("whitened")[i]).alias(f"m{i}") for i in live)).first()
    rows = white.select(F.array(*(F.col("whitened")[i] - means[f"m{i}"] for i in live)).alias("c"))
    return float(np.abs(covariance(rows, "c", model.n, len(live)) - np.eye(len(live))).max())


def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    points = usable(read(spark, sf_dir, "embeddings").select("vec_id", "embedding"))
    model = fit(points)
    schema = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"
    if model is None:
        return spark.createDataFrame([], schema)
    white = staged(transform(points, model), "whitened")
    error = F.lit(identity_error(white, model)).cast("double")
    share = F.array(*(F.lit(float(e) / model.trace if model.trace > 0 else None).cast("double") for e in model.values[:COMPONENTS]))
    rows = white.select(F.col("vec_id").cast("long").alias("vec_id"), F.posexplode("whitened").alias("at", "whitened"), "deviation")
    return rows.select("vec_id", (F.col("at") + 1).alias("component"), F.lit(model.n).cast("long").alias("n"), "deviation", "whitened", F.element_at(share, F.col("at") + 1).alias("explained"), error.alias("identity_error"))
