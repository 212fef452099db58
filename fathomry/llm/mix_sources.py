"""Mixing sources to target weights by hash-threshold histograms.

A source's target is its weight's share of the budget, at most twice its size; what is cut off is shared again by weight
(one water level: the targets are min(2 x size, level x weight)). A source takes floor(target / size) whole copies of every
document, and one more of the documents whose hash is below the source's threshold. The threshold comes from histograms:
sizes summed by source and the hash's next 12 bits, the bucket where the budget is crossed is found and alone refined by the
12 bits after, down to single hash values. Nothing is sorted but histogram rows, at most 4096 for a source at a time.

Cases: null text has size 0; the null source is one source, last in order; an empty table gives no rows; a source of size 0
has target 0 and takes nothing; rows with equal id and text share a hash and are taken alike, so a source's taken words come as
near its target as its largest such group allows; ids may be null or repeat; other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from fathomry.llm.common import discard, read, staged

WEIGHTS = (5, 2, 1)
SHARE, MOST = 1.5, 2
BITS, LEVELS = 12, 5


def size_of(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def hash_of(doc_id: Column, text: Column) -> Column:
    """60 bits of md5 over id and text: the same in any engine, on any run."""
    key = F.concat(F.coalesce(doc_id.cast("string"), F.lit("-")), F.lit(":"), F.coalesce(text, F.lit("")))
    return F.conv(F.substring(F.md5(key.cast("binary")), 1, 15), 16, 10).cast("long")


def source_key(source: Column) -> Column:
    """Sorts as the source by code point, null last, and never is null."""
    return F.when(source.isNull(), F.lit("1")).otherwise(F.concat(F.lit("0"), source))


def source_targets(sized: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most: int = MOST) -> DataFrame:
    """skey, source_size, target. The windows run over one row for each source."""
    sums = sized.groupBy("skey").agg(F.sum("size").alias("source_size"))
    order, every = Window.orderBy("skey"), Window.partitionBy()
    n = F.row_number().over(order)
    weight = F.element_at(F.array(*map(F.lit, weights)), ((n - 1) % len(weights) + 1).cast("int"))
    sums = sums.select("skey", "source_size", weight.cast("long").alias("w"), (most * F.col("source_size")).alias("cap"))
    sums = sums.withColumn("ratio", F.col("cap") / F.col("w"))
    filled = Window.orderBy("ratio", "skey").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select(
        "*",
        (F.lit(share) * F.sum("source_size").over(every)).alias("budget"),
        F.coalesce(F.sum("cap").over(filled), F.lit(0)).alias("caps"),
        (F.sum("w").over(every) - F.coalesce(F.sum("w").over(filled), F.lit(0))).alias("left"),
    )
    # The level if exactly the sources before this one, by ratio, are capped; the first that stays below its cap holds.
    level = (F.col("budget") - F.col("caps")) / F.col("left")
    sums = sums.withColumn("level", F.min(F.when(level <= F.col("ratio"), F.struct("ratio", "skey", level.alias("level")))).over(every)["level"])
    target = F.when(F.col("level").isNull() | (F.col("ratio") < F.col("level")), F.col("cap").cast("double")).otherwise(F.col("level") * F.col("w"))
    return sums.select("skey", "source_size", F.least(target, F.col("cap").cast("double")).alias("target"))


def thresholds(sized: DataFrame, targets: DataFrame) -> DataFrame:
    """skey, source_size, target, copies, bound: documents of a source with hash < bound are taken once more."""
    state = targets.withColumn("copies", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long"))
    state = state.withColumns({"rest": F.col("target") - F.col("copies") * F.col("source_size"), "bound": F.lit(0).cast("long")}).withColumn("open", F.col("rest") > 0)
    state, top = staged(state, "level"), BITS * LEVELS
    for level in range(1, LEVELS + 1):
        low = top - BITS * level
        width = 1 << low
        # bound is the start of the open range of width 2 ** (low + BITS); its histogram has at most 4096 rows a source.
        inside = sized.select("skey", "size", "h").join(state.where("open").select("skey", "bound"), "skey")
        inside = inside.where((F.col("h") >= F.col("bound")) & (F.col("h") < F.col("bound") + F.lit(width << BITS)))
        sums = inside.groupBy("skey", F.shiftright("h", low).alias("b")).agg(F.sum("size").alias("n"))
        upto = F.sum("n").over(Window.partitionBy("skey").orderBy("b"))
        sums = sums.withColumn("upto", upto).join(state.select("skey", "rest"), "skey").where(F.col("upto") > F.col("rest"))
        cross = sums.groupBy("skey").agg(F.min(F.struct("b", "n", "upto")).alias("x"))
        cross = cross.select("skey", F.shiftleft(F.col("x.b"), low).alias("at"), (F.col("x.upto") - F.col("x.n")).alias("before"), F.col("x.n").alias("n"))
        joined = state.join(cross, "skey", "left")
        found = F.col("at").isNotNull()
        rest = F.when(found, F.col("rest") - F.col("before")).otherwise(F.col("rest"))
        if level < LEVELS:
            bound = F.when(found, F.col("at")).otherwise(F.col("bound") + F.when(F.col("open"), F.lit(width << BITS)).otherwise(0))
        else:  # a single hash value: taken if that ends nearer the target
            bound = F.when(found, F.col("at") + (F.col("n") - rest < rest).cast("long")).otherwise(F.col("bound") + F.when(F.col("open"), F.lit(width << BITS)).otherwise(0))
        joined = joined.withColumns({"bound": bound, "rest": rest, "open": F.col("open") & found})
        new = staged(joined.drop("at", "before", "n"), "level")
        discard(state)
        state = new
    return state.select("skey", "source_size", "target", "copies", "bound")


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE) -> DataFrame:
    """doc_id, size, source_size, target, taken, copies of every row of ``docs`` (doc_id, text, source)."""
    sized = docs.select("doc_id", size_of(F.col("text")).alias("size"), source_key(F.col("source")).alias("skey"), hash_of(F.col("doc_id"), F.col("text")).alias("h"))
    sized = staged(sized, "sizes")
    bounds = thresholds(sized, source_targets(sized, weights, share))
    copies = F.col("whole") + (F.col("h") < F.col("bound")).cast("long")
    found = sized.join(bounds.withColumnRenamed("copies", "whole"), "skey")
    return found.select("doc_id", "size", "source_size", "target", (F.col("size") * copies).alias("taken"), copies.alias("copies"))


def mixed_rows(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE) -> DataFrame:
    """``docs`` as the mix takes them: every row as often as it is taken (0 to 2 times), with ``copy_no`` from 1.

    A column of the input named ``copy_no`` is replaced; all others ride along. Rows with equal id and text are taken alike,
    so a source that consists of few such groups can't come nearer its target than the largest of them.
    """
    docs = docs.drop("copy_no")
    bounds = docs.select("doc_id", size_of(F.col("text")).alias("size"), source_key(F.col("source")).alias("skey"), hash_of(F.col("doc_id"), F.col("text")).alias("h"))
    bounds = staged(bounds, "sizes")
    bounds = thresholds(bounds, source_targets(bounds, weights, share))
    names = [f"__c{i}" for i in range(len(docs.columns))]  # whatever their names, columns can't clash with ours
    at = {c: n for c, n in zip(docs.columns, names, strict=True)}
    ours = bounds.select(F.col("skey").alias("__skey"), F.col("copies").alias("__copies"), F.col("bound").alias("__bound"))
    kept = docs.toDF(*names).withColumn("__key", source_key(F.col(at["source"]))).join(ours, F.col("__key") == F.col("__skey"))
    taken = (F.col("__copies") + (hash_of(F.col(at["doc_id"]), F.col(at["text"])) < F.col("__bound")).cast("long")).cast("int")
    kept = kept.withColumn("__n", taken).where("__n > 0").withColumn("copy_no", F.explode(F.sequence(F.lit(1), F.col("__n"))))
    return kept.select(*(F.col(n).alias(c) for c, n in at.items()), "copy_no")


def op9_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(read(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken", "copies")


OP9_SQL = r"""
WITH d AS (
  SELECT doc_id, CASE WHEN source IS NULL THEN '1' ELSE '0' || source END AS skey,
    len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
    ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '-') || ':' || coalesce(text, '')), 1, 15))::BIGINT AS h
  FROM documents
),
s AS (SELECT skey, sum(size)::BIGINT AS source_size, [5, 2, 1][((row_number() OVER (ORDER BY skey)) - 1) % 3 + 1]::BIGINT AS w FROM d GROUP BY skey),
r AS (SELECT *, 2 * source_size AS cap, (2 * source_size)::DOUBLE / w AS ratio FROM s),
l AS (
  SELECT *, (1.5::DOUBLE * (sum(source_size) OVER ())::DOUBLE - coalesce(sum(cap) OVER p, 0)::DOUBLE) / (sum(w) OVER () - coalesce(sum(w) OVER p, 0))::DOUBLE AS lev
  FROM r WINDOW p AS (ORDER BY ratio, skey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
),
v AS (SELECT arg_min(lev, (ratio, skey)) AS level FROM l WHERE lev <= ratio),
t AS (
  SELECT skey, source_size, least(CASE WHEN level IS NULL OR ratio < level THEN cap::DOUBLE ELSE level * w END, cap::DOUBLE) AS target
  FROM r LEFT JOIN v ON true
),
c AS (SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size)::BIGINT ELSE 0 END AS whole FROM t),
g AS (SELECT skey, h, sum(size)::BIGINT AS n FROM d GROUP BY skey, h),
u AS (
  SELECT g.skey, g.h, g.n, sum(n) OVER (PARTITION BY g.skey ORDER BY g.h) AS upto, target - whole * source_size AS extra
  FROM g JOIN c USING (skey)
),
x AS (SELECT skey, min(h) AS edge, arg_min(n, h) AS n, arg_min(upto, h) AS upto, any_value(extra) AS extra FROM u WHERE upto > extra GROUP BY skey),
b AS (SELECT skey, edge + CASE WHEN n - (extra - (upto - n)) < extra - (upto - n) THEN 1 ELSE 0 END AS bound FROM x)
SELECT doc_id, size, source_size, target, (size * (whole + CASE WHEN target <= whole * source_size THEN 0 WHEN bound IS NULL OR h < bound THEN 1 ELSE 0 END))::BIGINT AS taken,
  (whole + CASE WHEN target <= whole * source_size THEN 0 WHEN bound IS NULL OR h < bound THEN 1 ELSE 0 END)::BIGINT AS copies
FROM d JOIN c USING (skey) LEFT JOIN b USING (skey)
"""
