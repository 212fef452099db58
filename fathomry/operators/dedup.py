"""Duplicate files: groups by size, then by a digest of both ends, then of all bytes, then of the bytes themselves.

Each step sees only what the step before left, and asks for at least two files. ``file_entry`` rows are path, size, mtime,
dev, ino, with the columns a digest needs.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F

from fathomry.functions import paths as P
from fathomry.operators.graph import staged
from fathomry.operators.ordering import numbered
from fathomry.operators.screen import among


def crowded(rows: DataFrame, keys: list[str], least: int = 2) -> DataFrame:
    """Rows whose keys occur at least twice. Counts are aggregated before they meet the rows, so a hot key costs no sort."""
    counts = rows.groupBy(*keys).agg(F.count("*").alias("__n")).where(F.col("__n") >= least).drop("__n")
    return rows.join(counts, keys, "left_semi")


def without_twins(files: DataFrame) -> DataFrame:
    """Of files with one identity the first by path; files without an identity all stay."""
    known = files.where("dev is not null and ino is not null")
    place = F.row_number().over(Window.partitionBy("dev", "ino").orderBy(P.parts("path"), "path"))
    first = known.withColumn("__p", place).where("__p = 1").drop("__p")
    return first.unionByName(files.where("dev is null or ino is null"))


def size_groups(files: DataFrame) -> DataFrame:
    """Files that share their size with another, twins collapsed."""
    return crowded(without_twins(crowded(files, ["size"])), ["size"])


def digested(files: DataFrame, wanted: DataFrame, name: str, digest: Column, reads: Column) -> tuple[DataFrame, Observation]:
    """``wanted`` rows with ``name``, the digest of their files, and what was read for it (files, bytes by ``reads``).

    Contents are read where they lie, for the wanted files alone; only digests are shuffled.
    """
    work = Observation()
    seen = among(files, wanted, "path").observe(work, F.count("*").alias("files"), F.coalesce(F.sum(reads), F.lit(0)).alias("bytes"))
    return staged(wanted.join(seen.select("path", digest.alias(name)), "path")), work


def identical_groups(files: DataFrame, partial: Column, full: Column, content: str = "content", window: int = 16) -> dict[str, DataFrame]:
    """The stages: by size, by partial digest, by full digest; and ``digested``, what the digests have read.

    ``path`` is the key of a file. Sizes and identities come first, without the content; both ends of files of crowded sizes
    next, and whole contents only of files whose size and ends another file shares. Each stage is written once, as it is read
    for counts and again for rows.
    """
    sized = staged(size_groups(files.drop(content)))
    ends, read_ends = digested(files, sized, "partial", partial, F.least("size", F.lit(2 * window)).cast("long"))
    halves = staged(crowded(ends, ["size", "partial"]))
    whole, read_whole = digested(files, halves, "hash", full, F.col("size").cast("long"))
    spark = files.sparkSession
    # What is read of unique sizes is counted apart; it should be nothing.
    rows = [(i, stage, int(w.get["files"]), int(w.get["bytes"])) for i, (stage, w) in enumerate((("partial", read_ends), ("full", read_whole)))]
    work = spark.createDataFrame(rows, "step int, stage string, files long, bytes long")
    return {"size": sized, "partial": halves, "full": crowded(whole, ["size", "hash"]), "digested": work}


#: Bytes of each file that are compared in a round.
CHUNK = 1 << 20


def verified(groups: DataFrame, files: DataFrame, content: str = "content", chunk: int | None = None) -> DataFrame:
    """Files of hash groups that are equal byte by byte to another of their group, with ``first``, the first of their class.

    A group is one class at first; each round compares one chunk of the files that still are together, splits classes by it
    and drops files that are left alone. So no shuffle holds more than a chunk of a file, and a file is read on only while it
    has company. A null content (unreadable) drops its file.
    """
    chunk, raw = chunk or CHUNK, F.col(content).cast("binary")
    heads = groups.groupBy("size", "hash").agg(F.min("path").alias("class"))
    live = staged(groups.select("path", "size", "hash").join(heads, ["size", "hash"]).select("path", "size", "class"))
    done, at = None, 0
    while True:
        piece = among(files.where(F.col(content).isNotNull()), live, "path").select("path", F.substring(raw, at + 1, chunk).alias("piece"))
        now = staged(live.join(piece, "path"))
        keys = ["class", "piece"]
        split = now.groupBy(*keys).agg(F.count("*").alias("n"), F.min("path").alias("first")).where("n > 1").drop("n")
        left = staged(now.join(split, keys).select("path", "size", F.col("first").alias("class")))
        at += chunk
        ended = left.where(F.col("size") <= at)
        done = ended if done is None else done.unionByName(ended)
        live = left.where(F.col("size") > at)
        if live.isEmpty():
            return groups.join(done.select("path", F.col("class").alias("first")), "path")


def group_totals(groups: DataFrame) -> DataFrame:
    """size, hash, files, wasted, first_path of identical groups, the most wasteful first."""
    sums = groups.groupBy("size", "hash").agg(F.count("*").alias("files"), F.min(P.parts("path")).alias("first"))
    return sums.select("size", "hash", "files", (F.col("size") * (F.col("files") - 1)).alias("wasted"), P.joined(F.col("first")).alias("first_path"))


def in_order(totals: DataFrame) -> DataFrame:
    """``group_id`` from 1: by wasted and size descending, then by the first path."""
    return numbered(totals, [F.desc("wasted"), F.desc("size"), P.parts("first_path")], "group_id")


def hash_pass_order(groups: DataFrame) -> DataFrame:
    """``place`` of each group (size, hash) in the order in which a hash pass reports them: largest files first, then by hash."""
    return numbered(groups.groupBy("size", "hash").agg(F.count("*").alias("files")), [F.desc("size"), F.col("hash")], "place")


def total_wasted(groups: DataFrame) -> DataFrame:
    return group_totals(groups).agg(F.coalesce(F.sum("wasted"), F.lit(0)).alias("total_wasted"), F.count("*").alias("groups"))


# The rules' labels. The explanations are what this library's rules do.
KEEP_RULES = {
    "oldest": ("Keep oldest", "Of each group the file modified first stays; the others are marked."),
    "newest": ("Keep newest", "Of each group the file modified last stays; the others are marked."),
    "shortest": ("Keep shortest path", "The file with the shortest path, often the first place it had, stays; the others are marked."),
    "folder": ("Keep file in folder", "One file inside the folder stays; a group without any there is not touched."),
    "resolution": ("Keep highest resolution", "The file with most pixels stays. Similar images are never marked: look at them yourself."),
}


def keep_rule(groups: DataFrame, rule: str, folder: str = "") -> DataFrame:
    """``marked``: to go, by the rule, in each identical group (size, hash); one file stays. Members are in order of path.

    Rules: oldest, newest, shortest, folder, resolution. Without a member in the folder, none is marked. Rows of kind
    ``similar`` are never marked.
    """
    newest = F.coalesce(-F.col("mtime"), F.lit((1 << 63) - 1))
    order = {
        "oldest": [F.col("mtime")], "newest": [newest], "shortest": [F.octet_length("path")],
        "folder": [F.when(P.under("path", F.lit(folder)), 0).otherwise(1), F.octet_length("path")],
        "resolution": [-F.coalesce(F.col("width") * F.col("height"), F.lit(0))] if "width" in groups.columns else [F.lit(0)],
    }[rule]
    # The keeper is an aggregate joined back, so a group is never gathered.
    keeper = F.min(F.struct(*(c.alias(f"k{i}") for i, c in enumerate(order)), P.parts("path").alias("parts"), F.col("path").alias("keeper")))
    found = groups.groupBy("size", "hash").agg(keeper.alias("__best"), F.count("*").alias("__n"), F.bool_or(P.under("path", F.lit(folder))).alias("__inside"))
    marked = (F.col("path") != F.col("__best.keeper")) & (F.col("__n") > 1)
    if rule == "folder":
        marked = marked & F.col("__inside")
    if "kind" in groups.columns:
        marked = marked & (F.col("kind") != "similar")
    return groups.join(found, ["size", "hash"]).withColumn("marked", marked).select(*groups.columns, "marked")


def selection_valid(marks: DataFrame, keys: list[str]) -> DataFrame:
    """A group's selection is valid if something stays."""
    return marks.groupBy(*keys).agg(F.bool_or(~F.col("marked")).alias("valid"))


def marked_bytes(marks: DataFrame) -> DataFrame:
    return marks.agg(F.count_if("marked").alias("files"), F.coalesce(F.sum(F.when(F.col("marked"), F.col("size"))), F.lit(0)).alias("bytes"))


def stage_counts(files: DataFrame, stages: dict[str, DataFrame]) -> DataFrame:
    """One row a stage: files and bytes that are left."""
    rows = [("scanned", files), *stages.items()]
    out = None
    for i, (name, df) in enumerate(rows):
        one = df.agg(F.count("*").alias("files"), F.coalesce(F.sum("size"), F.lit(0)).alias("bytes")).select(F.lit(i).alias("step"), F.lit(name).alias("stage"), "files", "bytes")
        out = one if out is None else out.unionByName(one)
    return out


def twin_count(files: DataFrame) -> DataFrame:
    """Files of crowded sizes that are further links to a file seen already."""
    same = crowded(files, ["size"]).where("dev is not null and ino is not null")
    return same.agg((F.count("*") - F.count_distinct("dev", "ino")).alias("twins"))


def cached(files: DataFrame, cache: DataFrame, partial_bytes: int) -> DataFrame:
    """Files with ``partial`` and ``full`` from the cache where path, size, mtime and identity are the same; ``partial`` also
    needs the same window."""
    c = cache.select(*(F.col(x).alias(f"c_{x}") for x in ("path", "size", "mtime", "dev", "ino", "partial_bytes", "partial", "full")))
    same = (F.col("path") == F.col("c_path")) & (F.col("size") == F.col("c_size")) & (F.col("mtime") == F.col("c_mtime")) & F.col("dev").eqNullSafe(F.col("c_dev")) & F.col("ino").eqNullSafe(F.col("c_ino"))
    out = files.join(c, same, "left")
    return out.select(*files.columns, F.when(F.col("c_partial_bytes") == partial_bytes, F.col("c_partial")).alias("partial"), F.col("c_full").alias("full"))


def cache_upsert(cache: DataFrame, fresh: DataFrame) -> DataFrame:
    """The cache after fresh digests: an unchanged file keeps what the fresh row doesn't know, a changed one loses all."""
    same = lambda a, b: (F.col(f"{a}.size") == F.col(f"{b}.size")) & (F.col(f"{a}.mtime") == F.col(f"{b}.mtime")) & F.col(f"{a}.dev").eqNullSafe(F.col(f"{b}.dev")) & F.col(f"{a}.ino").eqNullSafe(F.col(f"{b}.ino"))
    new = fresh.alias("n").join(cache.alias("o"), F.col("n.path") == F.col("o.path"), "left")
    keep = same("n", "o")
    merged = new.select(
        *(F.col(f"n.{c}").alias(c) for c in ("path", "size", "mtime", "dev", "ino")),
        *(F.coalesce(F.col(f"n.{c}"), F.when(keep, F.col(f"o.{c}"))).alias(c) for c in ("partial_bytes", "partial", "full")),
    )
    return merged.unionByName(cache.join(fresh, "path", "left_anti"))


def cache_prune(cache: DataFrame, roots: list[str], seen: DataFrame) -> DataFrame:
    """Without the entries under the roots that this run didn't see."""
    inside = P.under_any("path", roots)
    return cache.where(inside).join(seen.select("path"), "path", "left_semi").unionByName(cache.where(~inside))


def after_removal(groups: DataFrame, removed: DataFrame) -> DataFrame:
    """Groups without removed files; those that fall below two go."""
    return crowded(groups.join(removed.select("path"), "path", "left_anti"), ["size", "hash"])


def export_rows(groups: DataFrame) -> DataFrame:
    """Rows of the CSV export: group number, kind, hash, wasted, and the files in order of path."""
    totals = in_order(group_totals(groups))
    rows = groups.join(totals.select("size", "hash", "group_id", "wasted"), ["size", "hash"])
    return rows.select("group_id", F.lit("identical").alias("kind"), "hash", F.col("wasted").alias("group_wasted"), "path", "size", "mtime")


def export_all(groups: DataFrame, similar: DataFrame) -> DataFrame:
    """Rows of the whole export: identical groups, then similar ones (root, max_distance, path, size, mtime, width, height).

    Similar groups come by wasted (all but the largest) and size (the largest) descending, then by the first path; they have a
    distance and measures, and no hash. Identical groups have neither distance nor measures.
    """
    none = lambda kind: F.lit(None).cast(kind)
    same = groups.select(F.lit("identical").alias("kind"), "hash", none("int").alias("distance"), "path", "size", "mtime", none("int").alias("width"), none("int").alias("height"), F.struct(F.col("size").cast("string").alias("a"), F.col("hash").cast("string").alias("b")).alias("key"))
    like = similar.select(F.lit("similar").alias("kind"), none("string").alias("hash"), F.col("max_distance").cast("int").alias("distance"), "path", "size", "mtime", F.col("width").cast("int").alias("width"), F.col("height").cast("int").alias("height"), F.struct(F.col("root").cast("string").alias("a"), none("string").alias("b")).alias("key"))
    rows = same.unionByName(like)
    sums = rows.groupBy("kind", "key").agg((F.sum("size") - F.max("size")).alias("group_wasted"), F.max("size").alias("group_size"), F.min(P.parts("path")).alias("first"))
    named = numbered(sums, [F.col("kind"), F.desc("group_wasted"), F.desc("group_size"), F.col("first")], "group_id").drop("first")
    on = (F.col("r.kind") == F.col("n.kind")) & F.col("r.key").eqNullSafe(F.col("n.key"))
    return rows.alias("r").join(named.alias("n"), on).select("group_id", "r.kind", "hash", "distance", "group_wasted", "group_size", "path", "size", "mtime", "width", "height")
