"""The staging drawer, plans of what an execution would do, and its journal. Nothing here deletes anything.

Staged items are rows of ``schemas.STAGED``; ``seq`` is the order in which they were staged.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fathomry.functions import paths as P
from fathomry.operators.graph import dropped
from fathomry.operators.graph import staged as kept
from fathomry.operators.screen import among, below, lacking, outermost, told

QUARANTINE = ".fathomry-quarantine"


def top_level(staged: DataFrame) -> DataFrame:
    """The antichain: the first item of each path, if no directory above it is staged."""
    return marked(staged).where("top").drop("top")


def marked(staged: DataFrame) -> DataFrame:
    """All items, ``top`` for those of the antichain."""
    covered = staged.select("path", F.explode(P.prefixes("path")).alias("above")).join(staged.select(F.col("path").alias("above")).distinct(), "above", "left_semi").select("path").distinct()
    first = F.row_number().over(Window.partitionBy("path").orderBy("seq")) == 1
    rows = staged.withColumn("first", first).join(covered.withColumn("covered", F.lit(True)), "path", "left")
    return rows.withColumn("top", F.col("first") & F.col("covered").isNull()).drop("first", "covered")


def link_key() -> Column:
    return F.coalesce((F.col("kind") != "Dir") & (F.col("nlink") > 1) & F.col("dev").isNotNull() & F.col("ino").isNotNull(), F.lit(False))


def unstage(staged: DataFrame, path: str) -> DataFrame:
    """The drawer without the item at ``path``; items below it were never its own and stay."""
    return staged.where(F.col("path") != path)


def cleared(staged: DataFrame) -> DataFrame:
    return staged.limit(0)


def contains(staged: DataFrame, paths: DataFrame) -> DataFrame:
    """``paths`` with ``staged`` (an item lies at exactly this path) and ``covered`` (at or above it)."""
    items = kept(staged.select(F.col("path").alias("top")).distinct(), "items")
    above = among(paths.select("path", F.explode_outer(P.prefixes("path", 1)).alias("top")), items, "top").join(items, "top")
    found = kept(above.groupBy("path").agg(F.bool_or(F.col("top") == F.col("path")).alias("staged")), "found")
    dropped(items)
    # Paths that surely lie at or below no item are not shuffled.
    seen, no = told(paths, {"path": found}), F.lit(False)
    near = seen.where("__path").drop("__path").join(found.withColumn("covered", F.lit(True)), "path", "left").withColumns({"staged": F.coalesce("staged", no), "covered": F.coalesce("covered", no)})
    return near.unionByName(seen.where("not __path").drop("__path").withColumns({"staged": no, "covered": no}))


def after_execution(rows: DataFrame, done: DataFrame) -> DataFrame:
    """Rows of any table with ``path`` (tree, artifacts, caches, drawer) that do not lie at or below an executed path."""
    tops = outermost(done.select(F.col("path").alias("top")))
    gone = kept(below(rows.select("path"), tops), "gone")
    dropped(tops)
    return lacking(rows, gone, "path")


def reclaimable(staged: DataFrame) -> DataFrame:
    """One row: bytes that executing all items frees. A group of links counts once, and only if all of it is there."""
    top = top_level(staged)
    plain = top.where(~link_key()).agg(F.coalesce(F.sum("allocated"), F.lit(0)).alias("b"))
    first = F.min_by(F.struct("nlink", "allocated"), "seq")
    groups = top.where(link_key()).groupBy("dev", "ino").agg(F.count("*").alias("n"), first.alias("x")).where(F.col("n") >= F.col("x.nlink"))
    return plain.unionByName(groups.agg(F.coalesce(F.sum("x.allocated"), F.lit(0)).alias("b"))).agg(F.sum("b").alias("reclaimable"))


def expected_bytes(staged: DataFrame) -> DataFrame:
    """Items with ``expected``: 0 for nested ones, a whole group of links credited to its last member."""
    rows = marked(staged)
    link = F.col("top") & link_key()
    mine = Window.partitionBy("dev", "ino")
    tops = rows.where(link).withColumns({
        "n": F.count("*").over(mine), "back": F.row_number().over(mine.orderBy(F.desc("seq"))), "first": F.min_by(F.struct("nlink", "allocated"), "seq").over(mine),
    })
    credit = F.when((F.col("back") == 1) & (F.col("n") >= F.col("first.nlink")), F.col("first.allocated")).otherwise(0)
    linked = tops.withColumn("expected", credit.cast("long")).drop("n", "back", "first")
    rest = rows.where(~link).withColumn("expected", F.when(F.col("top"), F.col("allocated")).otherwise(0).cast("long"))
    return linked.unionByName(rest).drop("top")


def needs_confirmation(staged: DataFrame, bytes_above: int, count_above: int) -> DataFrame:
    """Strictly more items, or strictly more reclaimable bytes, than the thresholds."""
    counts = staged.agg(F.count("*").alias("items"))
    return counts.crossJoin(reclaimable(staged)).withColumn("confirm", (F.col("items") > count_above) | (F.col("reclaimable") > bytes_above))


def by_source(staged: DataFrame) -> DataFrame:
    return staged.groupBy("source").agg(F.count("*").alias("items"), F.sum("allocated").alias("bytes"))


def stage_outcomes(staged: DataFrame, exact: list[str], trees: list[str]) -> DataFrame:
    """``outcome`` of staging the items one after the other: Protected, AlreadyStaged, Covered or Staged.

    An item is covered if a directory above it was staged before; one staged before it at the same path has staged it already.
    Of the earlier items only those that were accepted count; one accepted and later absorbed by a directory still leaves that
    directory, so looking at any unprotected earlier item decides the same.
    """
    from fathomry.operators.filters import is_protected

    rows = staged.withColumn("protected", is_protected("path", exact, trees))
    free = rows.where("not protected").select(F.col("path").alias("above"), F.col("seq").alias("before"))
    first = free.groupBy("above").agg(F.min("before").alias("before"))
    hit = rows.select("seq", "path", F.explode(P.prefixes("path")).alias("above")).join(first, "above").where("before < seq").select("seq").distinct().withColumn("covered", F.lit(True))
    same = first.select(F.col("above").alias("path"), F.col("before").alias("first_seq"))
    out = rows.join(hit, "seq", "left").join(same, "path", "left")
    outcome = F.when(F.col("protected"), "Protected").when(F.col("covered"), "Covered").when(F.col("first_seq") < F.col("seq"), "AlreadyStaged").otherwise("Staged")
    return out.withColumn("outcome", outcome).drop("protected", "covered", "first_seq")


def revalidate(staged: DataFrame, now: DataFrame, tolerance: int = 0) -> DataFrame:
    """Items with ``problem`` (null if unchanged) and ``bytes`` that executing each would free now.

    ``now`` has the current state by path (kind, apparent, allocated, mtime, mtime_nanos, dev, ino, nlink, entry_count). Checks
    in order: there, kind, identity (if both are known); a directory's growth beyond the tolerance; another's size and mtime.
    """
    c = now.select(F.lit(True).alias("there"), *(F.col(x).alias(f"c_{x}" if x != "path" else x) for x in ("path", "kind", "apparent", "allocated", "mtime", "mtime_nanos", "dev", "ino", "nlink", "entry_count")))
    rows = staged.join(c, "path", "left")
    text = lambda *x: F.concat(*(F.lit(i) if isinstance(i, str) else i.cast("string") for i in x))
    moved = F.col("dev").isNotNull() & F.col("c_dev").isNotNull() & ((F.col("dev") != F.col("c_dev")) | (F.col("ino") != F.col("c_ino")))
    directory = F.col("c_kind") == "Dir"
    # The messages.
    problem = (
        F.when(F.col("there").isNull(), "no longer exists")
        .when(F.col("kind") != F.col("c_kind"), text("kind changed from ", F.col("kind"), " to ", F.col("c_kind")))
        .when(moved, "replaced by a different file")
        .when(directory & (F.col("c_entry_count") > F.col("entry_count") + tolerance), text("directory grew from ", F.col("entry_count"), " to ", F.col("c_entry_count"), " entries"))
        .when(~directory & (F.col("apparent") != F.col("c_apparent")), text("size changed from ", F.col("apparent"), " to ", F.col("c_apparent")))
        .when(~directory & ((F.col("mtime") != F.col("c_mtime")) | (F.col("mtime_nanos") != F.col("c_mtime_nanos"))), text("modified (mtime ", F.col("mtime"), " to ", F.col("c_mtime"), ")"))
    )
    freed = F.when(directory | (F.col("c_nlink") <= 1), F.col("c_allocated")).otherwise(0)
    return rows.withColumns({"problem": problem, "bytes": F.when(problem.isNull(), freed).otherwise(0)}).select(*staged.columns, "problem", "bytes")


def described(method: str) -> Column:
    what = F.when(F.col("kind") == "Dir", F.concat(F.lit("directory ("), F.col("entry_count").cast("string"), F.lit(" entries)"))).when(F.col("kind") == "Symlink", "symlink (target untouched)").when(F.col("kind") == "File", "file").otherwise("special file")
    return F.concat(F.lit("delete permanently: " if method == "permanent" else "move to trash: "), what)


def exec_plan(staged: DataFrame, now: DataFrame, exact: list[str], trees: list[str], method: str = "dry-run", tolerance: int = 0) -> DataFrame:
    """``outcome`` (Protected, Skipped or Planned), ``plan`` in words and ``expected`` bytes of each item, in their order."""
    from fathomry.operators.filters import is_protected

    checked = revalidate(staged, now, tolerance)
    expected = expected_bytes(staged).select("seq", "expected")
    guarded = is_protected("path", exact, trees)
    outcome = F.when(guarded, "Protected").when(F.col("problem").isNotNull(), "Skipped").otherwise("Planned")
    rows = checked.join(expected, "seq").withColumn("outcome", outcome)
    ok = F.col("outcome") == "Planned"
    return rows.withColumns({"plan": F.when(ok, described(method)).otherwise(F.coalesce(F.when(guarded, "protected path"), F.col("problem"))), "expected": F.when(ok, F.col("expected")).otherwise(0).cast("long")})


def report(plan: DataFrame) -> DataFrame:
    ok = F.col("outcome") == "Planned"
    return plan.agg(F.count_if(ok).alias("succeeded"), F.count_if(F.col("outcome") == "Skipped").alias("skipped"), F.count_if(F.col("outcome") == "Protected").alias("failed"), F.coalesce(F.sum(F.when(ok, F.col("expected"))), F.lit(0)).alias("bytes"))


def journal_rows(plan: DataFrame, timestamp: int, operation: str) -> DataFrame:
    """Journal records of a plan that is no dry run."""
    ok = F.col("outcome") == "Planned"
    return plan.select(F.lit(timestamp).cast("long").alias("timestamp"), F.lit(operation).alias("operation"), "path", F.lit(None).cast("string").alias("destination"), F.when(ok, F.col("expected")).otherwise(0).alias("size"), F.when(ok, "ok").otherwise("failed").alias("result"), F.when(~ok, F.col("plan")).alias("error"))


def journal_latest(journal: DataFrame, n: int = 50) -> DataFrame:
    """The last n records, newest first: by ``line``, for seconds tie."""
    return journal.orderBy(F.desc("line")).limit(n)


def restorable(journal: DataFrame, folder: str = QUARANTINE) -> DataFrame:
    """Records of successful moves into a quarantine folder."""
    return journal.where((F.col("result") == "ok") & (F.col("operation") == "quarantine") & F.array_contains(F.split("destination", "/"), folder))


def link_eligibility(pairs: DataFrame, exact: list[str], trees: list[str], kind: str = "hardlink") -> DataFrame:
    """``reason`` why a duplicate can't become a link to the kept file, null if it can; columns keep_* and dup_* (path, kind,
    size, dev, ino, hash), and ``problem`` of the duplicate's revalidation."""
    from fathomry.operators.filters import is_protected

    # The messages.
    reason = (
        F.when(is_protected("dup_path", exact, trees), "protected path")
        .when(F.col("dup_kind") != "File", "only regular files can be replaced by links")
        .when(F.col("problem").isNotNull(), F.col("problem"))
        .when(F.col("keep_kind") != "File", "link source is not a regular file")
        .when((F.col("keep_dev") == F.col("dup_dev")) & (F.col("keep_ino") == F.col("dup_ino")), "already the same physical file")
        .when(F.col("keep_size") != F.col("dup_size"), "size differs from the kept file")
        .when(F.lit(kind == "hardlink") & (F.col("keep_dev").isNull() | F.col("dup_dev").isNull() | (F.col("keep_dev") != F.col("dup_dev"))), "hardlinks require both files on the same volume")
        .when(F.col("keep_hash") != F.col("dup_hash"), "content differs from the kept file")
    )
    return pairs.withColumn("reason", reason)


def link_summary(done: DataFrame) -> DataFrame:
    ok = F.col("reason").isNull()
    return done.agg(F.count_if(ok).alias("ok"), F.coalesce(F.sum(F.when(ok, F.col("dup_size"))), F.lit(0)).alias("freed"), F.count_if(~ok).alias("failed"))


def quarantine_destination(root: Column | str, stamp: str, path: Column | str, folder: str = QUARANTINE) -> Column:
    """``root/folder/stamp/`` and the components of the path below the root, or all of them elsewhere; ``..`` and ``.`` go."""
    root, path = P.as_column(root), P.as_column(path)
    rel = F.when(P.under(path, root), F.slice(P.parts(path), P.depth(root) + 1, F.greatest(P.depth(path), F.lit(1)))).otherwise(P.parts(path))
    return P.joined(F.concat(P.parts(root), F.array(F.lit(folder), F.lit(stamp)), F.filter(rel, lambda x: ~x.isin(".", ".."))))


def unique_destinations(rows: DataFrame) -> DataFrame:
    """``destination`` made unique: the second gets ``.1``, the third ``.2``."""
    n = F.row_number().over(Window.partitionBy("destination").orderBy("seq")) - 1
    return rows.withColumn("n", n).withColumn("destination", F.when(F.col("n") == 0, F.col("destination")).otherwise(F.concat("destination", F.lit("."), F.col("n").cast("string")))).drop("n")


def volume_root(rows: DataFrame, devices: DataFrame) -> DataFrame:
    """``volume_root`` of each path: the outermost directory above it from which on down all are on its parent's device."""
    ways = rows.select("path", P.parent("path").alias("parent"), F.explode(F.concat(F.array(F.lit("/")), P.prefixes("path"))).alias("dir")).join(devices.select(F.col("path").alias("dir"), "dev"), "dir")
    own = devices.select(F.col("path").alias("parent"), F.col("dev").alias("own"))
    ways = ways.join(own, "parent").withColumn("d", P.depth("dir"))
    last_break = F.coalesce(F.max(F.when(F.col("dev") != F.col("own"), F.col("d"))).over(Window.partitionBy("path")), F.lit(-1))
    found = ways.withColumn("b", last_break).where("d > b").groupBy("path").agg(F.min_by("dir", "d").alias("volume_root"))
    return rows.join(found, "path", "left")


def quarantine_folders(volumes: DataFrame, entries: DataFrame, folder: str = QUARANTINE) -> DataFrame:
    """path, items, bytes of the quarantine folders at the roots of volumes (``mount``); a folder is a directory itself, no link.

    ``bytes`` is what emptying would free: directories' blocks, plain files, and none for files with further links.
    """
    at = F.when(F.col("mount") == "/", F.concat(F.lit("/"), F.lit(folder))).otherwise(F.concat("mount", F.lit("/"), F.lit(folder)))
    places = volumes.select(at.alias("path")).distinct()
    there = entries.where(F.col("kind") == "Dir").select("path").join(places, "path", "left_semi").distinct()
    freed = F.when((F.col("kind") == "File") & (F.col("nlink") > 1), 0).otherwise(F.coalesce("allocated", F.lit(0)))
    # Only what has the folder among its components is spread over its ancestors.
    inside = entries.where(F.array_contains(P.parts("path"), folder)).select(F.explode(P.prefixes("path")).alias("top"), freed.alias("freed"))
    sums = inside.join(there.select(F.col("path").alias("top")), "top", "left_semi").groupBy("top").agg(F.count("*").alias("items"), F.sum("freed").alias("bytes"))
    return there.join(sums, there["path"] == sums["top"], "left").select("path", F.coalesce("items", F.lit(0)).alias("items"), F.coalesce("bytes", F.lit(0)).cast("long").alias("bytes"))


def emptying(asked: DataFrame, entries: DataFrame, folder: str = QUARANTINE) -> DataFrame:
    """``refused`` for each path that is asked to be emptied: null only for directories with the quarantine's name."""
    kinds = entries.select(F.col("path").alias("p"), F.col("kind").alias("k"))
    # The messages.
    reason = F.when(P.name("path") != folder, "not a quarantine directory").when(F.col("k").isNull(), "no longer exists").when(F.col("k") != "Dir", "not a directory")
    return asked.join(kinds, asked["path"] == kinds["p"], "left").withColumn("refused", reason).drop("p", "k")


def restoring(journal: DataFrame, entries: DataFrame, folder: str = QUARANTINE) -> DataFrame:
    """Restorable records with ``refused``: null if the moved item is still there and its old place is free."""
    rows = restorable(journal, folder)
    there = entries.select("path").distinct()
    rows = rows.join(there.select(F.col("path").alias("destination"), F.lit(True).alias("kept")), "destination", "left").join(there.withColumn("taken", F.lit(True)), "path", "left")
    # The messages.
    return rows.withColumn("refused", F.when(F.col("kept").isNull(), "no longer exists").when(F.col("taken"), "original path is occupied")).drop("kept", "taken")
