"""Similar images: perceptual hashes within a Hamming distance, joined transitively.

Two hashes of ``width`` bits within distance t agree in at least one of t + 1 bands, so candidates come from an equi-join on
a pair of bands, one of each hash, with their bits, and every pair found is checked.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fathomry.functions.hashing import hamming
from fathomry.operators.graph import connected, staged


def bands(width: int, t: int) -> list[tuple[int, int]]:
    """(shift, mask) of t + 1 bands of nearly equal width that cover the hash."""
    n = t + 1
    edges = [width * i // n for i in range(n + 1)]
    return [(a, (1 << (b - a)) - 1) for a, b in zip(edges, edges[1:], strict=False) if b > a]


def blocks(images: DataFrame, t: int, width: int, key: str) -> DataFrame:
    """id, dhash, phash, block of each different pair of hashes: one row for each pair of bands. Two pairs of hashes within t
    share at least one block."""
    hashes = images.groupBy("dhash", "phash").agg(F.min(key).alias("id"))
    cut = lambda h: F.array(*(F.struct(F.lit(i).alias("band"), F.shiftrightunsigned(F.col(h), shift).bitwiseAND(F.lit(mask).cast("bigint")).alias("bits")) for i, (shift, mask) in enumerate(bands(width, t))))
    spread = hashes.select("id", "dhash", "phash", F.explode(cut("dhash")).alias("x")).select("*", F.explode(cut("phash")).alias("y"))
    return spread.select("id", "dhash", "phash", F.xxhash64("x.band", "x.bits", "y.band", "y.bits").alias("block"))


def close_pairs(images: DataFrame, t: int, width: int = 64, key: str = "path") -> DataFrame:
    """a, b (a < b), distance: pairs within t by the larger of both distances. Equal (dhash, phash) rows meet once, as one
    representative each; ``copies`` links the rest to it, so a hash that very many images share stays linear. The list of pairs
    itself grows with the square of a group of close hashes: for groups use ``links``."""
    spread = blocks(images, t, width, key)
    a, b = spread.alias("a"), spread.alias("b")
    on = (F.col("a.block") == F.col("b.block")) & (F.col("a.id") < F.col("b.id"))
    d = F.greatest(hamming("a.dhash", "b.dhash"), hamming("a.phash", "b.phash"))
    return a.join(b, on).select(F.col("a.id").alias("a"), F.col("b.id").alias("b"), d.alias("distance")).where(F.col("distance") <= t).distinct()


#: Hashes of a block that are compared with each other at once, and those of a block that are simply paired.
PART, FEW = 2048, 8


def links(images: DataFrame, t: int, width: int = 64, key: str = "path") -> DataFrame:
    """a, b, distance: enough of the close pairs to hold groups together, about one for each hash of a block, and in
    ``distance`` the largest that either end has to any hash within t.

    Blocks are compared whole, inside Arrow tasks, by the metric itself. A block of more than ``PART`` hashes is dealt into parts
    and each two of these are compared, so no task sees more than two parts at once, and no list of pairs leaves it.
    """
    kind = images.schema[key].dataType
    spread = blocks(images, t, width, key)
    counts = spread.groupBy("block").agg(F.count("*").alias("n")).where("n > 1")
    met = spread.join(counts, "block").withColumn("parts", F.ceil(F.col("n") / PART).cast("int"))
    met = met.withColumn("own", F.pmod(F.xxhash64("id", "dhash"), F.col("parts")).cast("int"))
    other = F.explode(F.sequence(F.lit(0), F.col("parts") - 1))
    dealt = met.withColumn("other", other).select("block", F.least("own", "other").alias("lo"), F.greatest("own", "other").alias("hi"), "id", "dhash", "phash")
    group = ["block", "lo", "hi"]
    dealt = dealt.repartition(*group).sortWithinPartitions(*group)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest = None
        for batch in batches:
            table = pa.Table.from_batches([batch]) if rest is None else pa.concat_tables([rest, pa.Table.from_batches([batch])])
            edges = group_edges(table)
            rest = table.slice(edges[-2]) if len(edges) > 1 else None
            if len(edges) > 2:
                yield linked(table.slice(0, edges[-2]), edges[:-1], t)
        if rest is not None:
            yield linked(rest, group_edges(rest), t)

    schema = T.StructType([T.StructField("a", kind), T.StructField("b", kind), T.StructField("distance", T.IntegerType())])
    return dealt.mapInArrow(run, schema).groupBy("a", "b").agg(F.max("distance").alias("distance"))


def group_edges(table: pa.Table) -> np.ndarray:
    """Where the groups of a table begin, and its end."""
    n = table.num_rows
    new = np.zeros(n, bool)
    if n:
        new[0] = True
        for name in ("block", "lo", "hi"):
            v = table.column(name).to_numpy()
            new[1:] |= v[1:] != v[:-1]
    return np.append(np.flatnonzero(new), n)


def linked(table: pa.Table, edges: np.ndarray, t: int) -> pa.RecordBatch:
    """The links of whole groups."""
    d, p = (table.column(c).to_numpy().view(np.uint64) for c in ("dhash", "phash"))
    sizes = np.diff(edges)
    group = np.repeat(np.arange(len(sizes)), sizes)
    few = (sizes <= FEW)[group]
    a, b, far = [], [], []
    for lag in range(1, FEW):  # all pairs of small groups, each lag at once
        i = np.flatnonzero(few[:-lag] & (group[:-lag] == group[lag:])) if len(group) > lag else np.zeros(0, int)
        distance = np.maximum(np.bitwise_count(d[i] ^ d[i + lag]), np.bitwise_count(p[i] ^ p[i + lag]))
        near = distance <= t
        a.append(i[near]), b.append(i[near] + lag), far.append(distance[near])
    for g in np.flatnonzero(sizes > FEW):
        x, y, z = forest(d[edges[g] : edges[g + 1]], p[edges[g] : edges[g + 1]], t)
        a.append(x + edges[g]), b.append(y + edges[g]), far.append(z)
    ids = table.column("id").combine_chunks()
    ends = [ids.take(pa.array(np.concatenate(x).astype(np.int64))) for x in (a, b)]
    return pa.RecordBatch.from_arrays([*ends, pa.array(np.concatenate(far).astype(np.int32))], ["a", "b", "distance"])


def forest(d: np.ndarray, p: np.ndarray, t: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A spanning forest of the hashes within t of each other: parent, child, and the larger of both ends' farthest."""
    n = len(d)
    near, far = np.zeros((n, n), bool), np.zeros(n, np.uint8)
    for i in range(0, n, 256):
        distance = np.maximum(np.bitwise_count(d[i : i + 256, None] ^ d), np.bitwise_count(p[i : i + 256, None] ^ p))
        near[i : i + 256] = distance <= t
        far[i : i + 256] = np.where(near[i : i + 256], distance, 0).max(axis=1)
    open_, parents, children = np.ones(n, bool), [], []
    for seed in range(n):
        if not open_[seed]:
            continue
        open_[seed] = False
        front = np.array([seed])
        while len(front):
            left = np.flatnonzero(open_)
            reach = near[np.ix_(front, left)]
            new = reach.any(axis=0)
            parents.append(front[reach[:, new].argmax(axis=0)])
            children.append(left[new])
            front = left[new]
            open_[front] = False
    x, y = (np.concatenate(v).astype(int) for v in (parents, children))
    return x, y, np.maximum(far[x], far[y])


def copies(images: DataFrame, key: str = "path") -> DataFrame:
    """a, b, distance 0: each image with the representative of its hashes."""
    first = images.groupBy("dhash", "phash").agg(F.min(key).alias("a"))
    same = F.col("i.dhash").eqNullSafe(F.col("f.dhash")) & F.col("i.phash").eqNullSafe(F.col("f.phash"))
    return images.alias("i").join(first.alias("f"), same).where(F.col(key) != F.col("a")).select("a", F.col(key).alias("b"), F.lit(0).alias("distance"))


def similar_groups(images: DataFrame, t: int, width: int = 64, key: str = "path") -> DataFrame:
    """key, root, max_distance (the largest of the group's pairs within t) of every image that has a similar one."""
    edges = staged(links(images, t, width, key).unionByName(copies(images, key)), "links")  # read by the components and again for distances
    found = connected(edges)
    far = edges.join(found.withColumnRenamed("node", "a"), "a").groupBy("root").agg(F.max("distance").alias("max_distance"))
    return staged(found.join(far, "root").select(F.col("node").alias(key), "root", "max_distance"), "groups")


def similar_totals(images: DataFrame, groups: DataFrame, key: str = "path") -> DataFrame:
    """root, files, size (the largest), wasted (all but the largest)."""
    rows = groups.join(images.select(key, "size"), key)
    return rows.groupBy("root").agg(F.count("*").alias("files"), F.max("size").alias("size"), (F.sum("size") - F.max("size")).alias("wasted"), F.max("max_distance").alias("max_distance"))


def representatives(images: DataFrame, identical: DataFrame, key: str = "path") -> DataFrame:
    """Images without those that are only further members of an identical group."""
    return images.join(identical.where("redundant").select(key), key, "left_anti")
