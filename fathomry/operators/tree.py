"""The space map: hard links, rollups through every level, drill-down, rankings, counters.

Entries are rows of ``schemas.ENTRY`` (some columns are enough). Own sizes count for what is no directory; directories get
what lies below them. ``seq`` is the order of paths, component by component, wherever an order of insertion would matter.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fathomry.functions import paths as P
from fathomry.operators.graph import staged
from fathomry.operators.ordering import numbered
from fathomry.operators.screen import among

ORDER = P.parts  # sort key of a path


def with_paths(entries: DataFrame) -> DataFrame:
    return entries.withColumns({"name": P.name("path"), "parent_path": P.parent("path"), "depth": P.depth("path")})


def mark_hard_links(entries: DataFrame) -> DataFrame:
    """``hardlinked``: has other links; ``hardlink_dup``: not the first of its links by path, so it adds no bytes.

    Only entries with nlink > 1 and an identity are links. Those alone are shuffled by it; the rest pass.
    """
    is_link = (F.col("kind") != "Dir") & (F.col("nlink") > 1) & F.col("dev").isNotNull() & F.col("ino").isNotNull()
    is_link = F.coalesce(is_link, F.lit(False))
    place = F.row_number().over(Window.partitionBy("dev", "ino").orderBy(P.parts("path")))
    links = entries.where(is_link).withColumns({"hardlinked": F.lit(True), "hardlink_dup": place > 1})
    return links.unionByName(entries.where(~is_link).withColumns({"hardlinked": F.lit(False), "hardlink_dup": F.lit(False)}))


def directories_of(files: DataFrame) -> DataFrame:
    """path of every directory that the files' paths imply."""
    parents = files.select(P.parent("path").alias("p")).where("p is not null").distinct()
    return parents.select(F.explode(P.prefixes("p", 1)).alias("path")).distinct()


def rollup(entries: DataFrame, group: str | None = None) -> DataFrame:
    """path, agg_apparent, agg_allocated, items for every directory above an entry, but ``/``.

    Entries are summed by parent first, so that what is exploded to all ancestors is one row a directory, not one an entry.
    A ``hardlink_dup`` adds an item and no bytes. Directories must be rows of ``entries`` to count as items.
    """
    own = F.col("kind") != "Dir"
    if "hardlink_dup" in entries.columns:
        own = own & ~F.col("hardlink_dup")
    keys = [group] if group else []
    size = lambda c: F.sum(F.when(own, F.col(c)).otherwise(0)).alias(c)
    by_parent = entries.groupBy(*keys, P.parent("path").alias("dir")).agg(size("apparent"), size("allocated"), F.count("*").alias("n")).where("dir is not null")
    spread = by_parent.select(*keys, F.explode(P.prefixes("dir", 1)).alias("path"), "apparent", "allocated", "n")
    return spread.groupBy(*keys, "path").agg(F.sum("apparent").alias("agg_apparent"), F.sum("allocated").alias("agg_allocated"), F.sum("n").alias("items"))


def rolled_up(entries: DataFrame) -> DataFrame:
    """All entries with agg_apparent, agg_allocated and items: rollups for directories, own values for the rest."""
    sums = rollup(entries)
    joined = entries.join(sums, "path", "left")
    directory = F.col("kind") == "Dir"
    value = lambda agg, own: F.when(directory, F.coalesce(agg, F.lit(0))).otherwise(F.coalesce(own, F.lit(0)))
    return joined.withColumns({
        "agg_apparent": value("agg_apparent", F.col("apparent")), "agg_allocated": value("agg_allocated", F.col("allocated")), "items": F.coalesce("items", F.lit(0)).cast("long"),
    })


def remove_subtree(entries: DataFrame, path: str) -> DataFrame:
    """Entries without ``path`` and all below it. Marks of hard links stay as they are: a surviving duplicate of a removed
    first link is not promoted."""
    return entries.where(~P.under("path", F.lit(path)))


def largest_files(entries: DataFrame, n: int, size: str = "apparent") -> DataFrame:
    """The n largest files, the later path first among equals; duplicate links don't count."""
    rows = entries.where(F.col("kind") == "File")
    if "hardlink_dup" in entries.columns:
        rows = rows.where(~F.col("hardlink_dup"))
    return rows.orderBy(F.desc(size), P.parts("path").desc()).limit(n)


def summarize(rolled: DataFrame, root: str, max_depth: int, max_children: int, size: str = "agg_allocated") -> DataFrame:
    """``root`` and, level by level, at most ``max_children`` of each shown directory, down to ``max_depth``: with depth,
    rank within the parent. Children of what is cut off are cut off too. One join a level, over shown directories alone."""
    base = P.depth(F.lit(root))
    # Written once: each level would make the whole rollup again, and that of each level above it.
    inside = staged(with_paths(rolled.where(P.under("path", F.lit(root)) & (P.depth("path") - base <= max_depth))), "inside")
    top = inside.where(F.col("path") == root).select(*rolled.columns).withColumns({"level": F.lit(0), "rank": F.lit(1)})
    shown, out = top, top
    place = F.row_number().over(Window.partitionBy("parent_path").orderBy(F.desc(size), F.desc("agg_allocated"), "name"))
    for level in range(1, max_depth + 1):
        here = inside.where(P.depth("path") - base == level)
        found = here.join(shown.select(F.col("path").alias("parent_path")), "parent_path", "left_semi").withColumn("rank", place).where(F.col("rank") <= max_children)
        shown = staged(found.withColumn("level", F.lit(level)).select(*top.columns), "shown")
        out = out.unionByName(shown)
    return out


def preorder(rolled: DataFrame, root: str, max_depth: int, size: str = "agg_allocated") -> DataFrame:
    """Rows of the CSV export, in its order: a directory, then its children by size descending, each followed by its own.

    Among equals the one smaller in allocation and then later by name comes first. ``position`` counts from 1.
    """
    base = P.depth(F.lit(root))
    rows = with_paths(rolled.where(P.under("path", F.lit(root)) & (P.depth("path") - base <= max_depth))).withColumn("level", P.depth("path") - base)
    # Siblings are told by their places along all rows, so that a huge directory is dealt over tasks like any rows.
    placed = numbered(rows, [F.col("parent_path"), F.desc(size), F.col("agg_allocated"), F.desc("name")], "rank")
    ranked = placed.withColumn("rank", F.when(F.col("level") == 0, F.lit(0)).otherwise(F.col("rank")))
    key = ranked.where("level = 0").select("path", F.array(F.col("rank")).alias("key"))
    keys = key
    for level in range(1, max_depth + 1):
        own = ranked.where(F.col("level") == level).join(key.select(F.col("path").alias("parent_path"), F.col("key").alias("above")), "parent_path")
        key = own.select("path", F.concat("above", F.array("rank")).alias("key"))
        keys = keys.unionByName(key)
    return numbered(ranked.join(keys, "path"), [F.col("key")], "position").drop("rank", "key")


def children_share(rolled: DataFrame, parent: str, size: str = "agg_allocated") -> DataFrame:
    """Children of a directory with their percentage of it, largest first."""
    total = rolled.where(F.col("path") == parent).select(F.greatest(F.col(size), F.lit(1)).alias("total"))
    rows = rolled.where(P.parent("path") == parent)
    return rows.crossJoin(F.broadcast(total.limit(1))).withColumn("percent", F.col(size) * 100.0 / F.col("total")).drop("total")


def breadcrumbs(entries: DataFrame, path: str) -> DataFrame:
    """The chain from the outermost directory to ``path``."""
    chain = entries.sparkSession.range(1).select(F.posexplode(P.prefixes(F.lit(path), 1)).alias("position", "path"))
    return chain.join(entries, "path")


def scan_counters(entries: DataFrame) -> DataFrame:
    """files, dirs, bytes (each link counted, symbolic links not) and errors."""
    real = F.col("kind").isin("File", "Other")
    return entries.agg(
        F.count_if(F.col("kind") != "Dir").alias("files"), F.count_if(F.col("kind") == "Dir").alias("dirs"),
        F.coalesce(F.sum(F.when(real, F.col("allocated"))), F.lit(0)).alias("bytes"), F.count_if(F.col("error").isNotNull()).alias("errors"),
    )


def under_roots(entries: DataFrame, roots: list[str]) -> DataFrame:
    """Entries labelled with each of the roots that they lie under."""
    tops = F.array(*map(F.lit, roots))
    return entries.withColumn("root", F.explode(F.filter(tops, lambda t: P.under(F.col("path"), t))))


def directory_totals(entries: DataFrame, tops: DataFrame, own: bool) -> DataFrame:
    """path, allocated, apparent, entries, has_repo for every path of ``tops``: all below it, directories' own blocks too,
    each group of links once; with ``own``, the directory itself adds its blocks.

    Each entry meets ``tops`` through its ancestors: an equi-join, whatever the number of tops. Ancestors that are surely none
    of them go before the shuffle, and what is left is summed before it.
    """
    wanted = staged(tops.select("path").distinct().withColumnRenamed("path", "top"), "tops")
    link = F.coalesce(F.col("kind").isin("File", "Symlink", "Other") & (F.col("nlink") > 1) & F.col("ino").isNotNull(), F.lit(False))
    above = among(entries.select("path", "dev", "ino", "allocated", "apparent", link.alias("link"), F.explode_outer(P.prefixes("path")).alias("top")), wanted, "top")
    # Only links meet by identity, and those of one file are one row before they are summed.
    first = F.min_by(F.struct("allocated", "apparent"), "path")
    links = above.where("link").groupBy("top", "dev", "ino").agg(first.alias("x"), F.count("*").alias("n")).select("top", "x.allocated", "x.apparent", "n", F.lit(False).alias("repo"), F.lit(False).alias("asked"))
    plain = above.where("not link").select("top", "allocated", "apparent", F.lit(1).cast("long").alias("n"), (P.name("path") == ".git").alias("repo"), F.lit(False).alias("asked"))
    # The tops are rows among them, so that one shuffle sums all and tells tops from what only passed with them.
    none = F.lit(0).cast("long")
    asked = wanted.select("top", none.alias("allocated"), none.alias("apparent"), none.alias("n"), F.lit(False).alias("repo"), F.lit(True).alias("asked"))
    sums = plain.unionByName(links).unionByName(asked).groupBy("top").agg(F.sum("allocated").alias("allocated"), F.sum("apparent").alias("apparent"), F.sum("n").alias("entries"), F.bool_or("repo").alias("has_repo"), F.bool_or("asked").alias("asked"))
    out = sums.where("asked").select(
        F.col("top").alias("path"), *(F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("allocated", "apparent", "entries")), F.coalesce("has_repo", F.lit(False)).alias("has_repo")
    )
    if own:
        self_ = entries.select("path", F.col("allocated").alias("a"), F.col("apparent").alias("b"), F.col("kind").alias("k"))
        out = out.join(self_, "path", "left").select("path", (F.col("allocated") + F.coalesce("a", F.lit(0))).alias("allocated"), (F.col("apparent") + F.coalesce("b", F.lit(0))).alias("apparent"), (F.col("entries") + 1).alias("entries"), "has_repo")
    out._fathomry_tops = wanted
    return out


def freed_bytes(entries: DataFrame, top: str) -> DataFrame:
    """Bytes that removing a subtree frees: directories' blocks, plain files, and links whose whole group lies inside."""
    inside = entries.where(P.under("path", F.lit(top)))
    link = (F.col("kind") != "Dir") & (F.col("nlink") > 1) & F.col("ino").isNotNull()
    plain = inside.where(~F.coalesce(link, F.lit(False))).select("allocated")
    whole = inside.where(F.coalesce(link, F.lit(False))).groupBy("dev", "ino").agg(F.count("*").alias("n"), F.max("nlink").alias("nlink"), F.max("allocated").alias("allocated")).where("n >= nlink").select("allocated")
    return plain.unionByName(whole).agg(F.coalesce(F.sum("allocated"), F.lit(0)).alias("freed"))


def volume_use(volumes: DataFrame) -> DataFrame:
    """used, fraction and band (ok, high at 85 %, full at 95 %) of volumes."""
    used = F.greatest(F.col("total") - F.col("available"), F.lit(0))
    part = used / F.greatest(F.col("total"), F.lit(1))
    return volumes.withColumns({"used": used, "fraction": part, "band": F.when(part >= 0.95, "full").when(part >= 0.85, "high").otherwise("ok")})


def volume_for(rows: DataFrame, volumes: DataFrame) -> DataFrame:
    """``mount`` of each row: the longest mount point above its path; null where none is. Found by the path's ancestors."""
    above = rows.select("path").distinct().withColumn("mount", F.explode(F.concat(F.array(F.lit("/")), P.prefixes("path", 1))))
    best = above.join(volumes.select("mount").distinct(), "mount").groupBy("path").agg(F.max_by("mount", F.octet_length("mount")).alias("mount"))
    return rows.join(best, "path", "left")


def issues(entries: DataFrame) -> DataFrame:
    return entries.where("error is not null").select("path", "error")


def is_denied(error: Column) -> Column:
    e = F.lower(error)
    return e.contains("permission denied") | e.contains("operation not permitted") | e.contains("access is denied")
