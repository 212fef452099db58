"""Hard links across batches of a live scan: whichever link is first by path holds the bytes, whenever it arrives.

Links are dealt over ``BUCKETS`` keys of state by their file: the path that holds each file's bytes, and its sizes. A call of Python
for each file would cost more than all its links. Each batch gives one row a path that is new or changes: signed sizes, one item
for a new path, and ``dup``, the mark of the path from now on. When a link arrives whose path comes before the holder's, the bytes
move: the old holder's row takes them off, the new one's puts them on. Sums of these rows over all batches are those of a scan that
saw everything at once.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from fathomry.functions import paths as P

DELTA = "path string, apparent bigint, allocated bigint, items bigint, linked boolean, dup boolean"
FILE = ["dev", "ino", "path", "apparent", "allocated"]
HOLDERS = "dev array<bigint>, ino array<bigint>, path array<string>, apparent array<bigint>, allocated array<bigint>"
#: Keys of state, each with the holders of its share of the files: fixed for the life of a checkpoint.
BUCKETS = 256


def moved(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    """Rows of one bucket's links in a batch; links arrive in chunks, and only each file's first one is kept."""
    columns = ["path", "apparent", "allocated", "items", "linked", "dup"]
    order = lambda path: path.split("/")
    # Of each file the first link's order and row, and whether an earlier batch told it.
    best = {(dev, ino): (order(x[0]), x, True) for dev, ino, *x in zip(*state.get, strict=True)} if state.exists else {}
    known = dict(best)
    for frame in frames:
        out = []
        for dev, ino, *x in zip(*(frame[c].tolist() for c in FILE), strict=True):
            old, new = best.get((dev, ino)), (order(x[0]), x, False)
            if old is None or new[0] < old[0]:
                best[dev, ino] = new
            elif new[0] > old[0]:
                old = new
            else:
                continue
            if old is not None and not old[2]:
                out.append((old[1][0], 0, 0, 1, True, True))
        yield pd.DataFrame(out, columns=columns)
    out = []
    for file, (_, x, told) in best.items():
        if not told:
            out.append((*x, 1, True, False))
            if file in known:
                path, apparent, allocated = known[file][1]
                out.append((path, -apparent, -allocated, 0, True, True))
    state.update(tuple(map(list, zip(*((*file, *x) for file, (_, x, _) in best.items()), strict=True))))
    for at in range(0, len(out), 10_000):
        yield pd.DataFrame(out[at : at + 10_000], columns=columns)


def link_deltas(entries: DataFrame) -> DataFrame:
    """A stream of DELTA rows (append) of a stream of entries, each of which arrives once. State grows with the linked files;
    all other entries pass by it."""
    link = F.coalesce((F.col("kind") != "Dir") & (F.col("nlink") > 1) & F.col("dev").isNotNull() & F.col("ino").isNotNull(), F.lit(False))
    size = lambda c: F.when(F.col("kind") != "Dir", F.coalesce(c, F.lit(0))).otherwise(0).cast("long").alias(c)
    plain = entries.where(~link).select("path", size("apparent"), size("allocated"), F.lit(1).cast("long").alias("items"), F.lit(False).alias("linked"), F.lit(False).alias("dup"))
    whole = lambda c: F.col(c).cast("long").alias(c)
    links = entries.where(link).select(whole("dev"), whole("ino"), "path", size("apparent"), size("allocated")).withColumn("bucket", F.pmod(F.xxhash64("dev", "ino"), F.lit(BUCKETS)).cast("int"))
    told = links.groupBy("bucket").applyInPandasWithState(moved, DELTA, HOLDERS, "append", GroupStateTimeout.NoTimeout)
    return plain.unionByName(told)


def rollup_of_deltas(deltas: DataFrame) -> DataFrame:
    """path, agg_apparent, agg_allocated, items of every directory above; of a stream (update mode) or of all rows so far."""
    spread = deltas.select(F.explode(P.prefixes("path")).alias("path"), "apparent", "allocated", "items")
    return spread.groupBy("path").agg(F.sum("apparent").alias("agg_apparent"), F.sum("allocated").alias("agg_allocated"), F.sum("items").alias("items"))
