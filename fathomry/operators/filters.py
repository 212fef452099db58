"""Selections over entries: exclusion, search, protection, categories, ages, notes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fathomry.functions import globs as G
from fathomry.functions import paths as P
from fathomry.operators.graph import dropped
from fathomry.operators.graph import staged as kept
from fathomry.operators.screen import below, flagged, outermost

# Extensions of each class of files.
CATEGORIES = {
    "Images": ["jpg", "jpeg", "png", "gif", "webp", "heic", "tif", "tiff", "bmp", "raw", "cr2", "nef", "arw", "dng", "svg", "psd"],
    "Video": ["mp4", "mov", "mkv", "avi", "webm", "m4v", "wmv"],
    "Audio": ["mp3", "flac", "wav", "aac", "m4a", "ogg", "aiff"],
    "Archives": ["zip", "gz", "tgz", "xz", "bz2", "7z", "rar", "tar", "zst", "dmg", "iso", "pkg", "msi"],
    "Documents": ["pdf", "doc", "docx", "xls", "xlsx", "ppt", "pptx", "txt", "md", "pages", "key", "numbers", "odt", "rtf", "csv"],
    "Code": ["rs", "js", "ts", "tsx", "jsx", "py", "go", "java", "kt", "c", "h", "cpp", "hpp", "swift", "rb", "php", "cs", "json", "toml", "yaml", "yml", "html", "css"],
    "Binaries": ["o", "a", "so", "dylib", "dll", "exe", "rlib", "rmeta", "class", "jar", "pyc", "wasm"],
}
# Images that can be compared, copy-on-write filesystems, protected places (the path alone, or all below it).
IMAGES = ["jpg", "jpeg", "png", "gif", "webp", "bmp", "tif", "tiff", "ico"]
COW = ["apfs", "btrfs", "bcachefs", "xfs", "refs"]
PROTECTED_TREES = ["/bin", "/sbin", "/usr", "/lib", "/lib64", "/etc", "/boot", "/proc", "/sys", "/dev", "/run"]
PROTECTED_PATHS = ["/", "/home", "/root", "/var", "/opt", "/srv", "/mnt", "/media", "/tmp"]


def excluded(entries: DataFrame, paths: list[str], globs: list[str]) -> DataFrame:
    """Directories and files that match: an exact path, or a glob on path or name."""
    return entries.where(F.col("path").isin(paths) | G.matches_any([F.col("path"), P.name("path")], globs))


def without_excluded(entries: DataFrame, paths: list[str], globs: list[str], root: str | None = None) -> DataFrame:
    """Entries that neither match nor lie below a directory that does.

    A path that lies below one matches through one of its own prefixes. So two regular expressions on the whole path decide,
    without a join: a glob's on a prefix that ends where a component does, and a glob's on a single component. With ``root`` (a
    column: what each entry was found from) a root that is a directory is spared, and so are the directories above it: what
    was asked for by name is looked at. Only the few paths that match at all are then looked at prefix by prefix.
    """
    out = entries.where(~P.under_any("path", paths)) if paths else entries
    good = [g for g in globs if g.strip("/") and not G.compiled([g])[1]]
    if good:
        whole, one = ("|".join(G.body(g, inside) for g in good) for inside in (False, True))
        hit = F.col("path").rlike(f"(?s)^(?:{whole})(?:/|$)") | F.col("path").rlike(f"(?s)/(?:{one})(?:/|$)")
        if root:
            file = (F.col("kind") != "Dir") if "kind" in entries.columns else F.lit(False)
            below = lambda p: (F.length(p) > F.length(root)) | ((p == F.col("path")) & file)
            hit = hit & F.exists(P.prefixes("path", 1), lambda p: below(p) & (p.rlike(f"(?s)^(?:{whole})$") | p.rlike(f"(?s)/(?:{one})$")))
        out = out.where(~hit)
    return out


def is_copy_on_write(filesystem: Column | str) -> Column:
    """Whether a filesystem can share blocks between copies, by its name in any case."""
    return F.lower(P.as_column(filesystem)).isin(COW)


def list_panel(entries: DataFrame, parent: str, pattern: str = "", size: str = "agg_allocated") -> DataFrame:
    """Rows of the list: the directory's children, or with a pattern the hits below it, largest first, then by path."""
    rows = entries.where(P.under("path", F.lit(parent)) & G.search(P.name("path"), pattern) & (F.col("path") != parent)) if pattern else entries.where(P.parent("path") == parent)
    return rows.orderBy(F.desc(size), P.parts("path"))


def with_artifacts(projects: DataFrame) -> DataFrame:
    """Projects that have something to clean: hide-empty."""
    return projects.where(F.col("artifact_size") > 0)


#: Rows that displays show at most; tables and exports hold all.
SHOWN = {"groups": 5000, "issues": 5000, "hits": 5000, "errors": 500}


def shown(rows: DataFrame, kind: str, *order: Column) -> tuple[DataFrame, bool]:
    """The first rows of a display along ``order``, and whether there are more. Each task keeps as many as are shown."""
    cap = SHOWN[kind]
    first = rows.orderBy(*order).limit(cap + 1)
    return first.limit(cap), first.count() > cap


def search(entries: DataFrame, pattern: str, cap: int = 5000) -> tuple[DataFrame, DataFrame]:
    """Hits by name, at most ``cap`` in order of paths, and one row telling whether there were more."""
    found = entries.where(G.search(P.name("path"), pattern)).orderBy(P.parts("path")).limit(cap + 1)
    return found.limit(cap), found.agg((F.count("*") > cap).alias("truncated"))


def hit_ancestors(hits: DataFrame) -> DataFrame:
    """path of every directory above a hit."""
    return hits.select(F.explode(P.prefixes("path")).alias("path")).distinct()


def is_protected(path: Column | str, exact: list[str], trees: list[str]) -> Column:
    p = P.normalized(path)
    return p.isin(exact) | P.under_any(p, trees) if exact else P.under_any(p, trees)


def category(name: Column | str) -> Column:
    ext = P.extension(name)
    out = F.lit("Other")
    for label, extensions in CATEGORIES.items():
        out = F.when(ext.isin(extensions), label).otherwise(out)
    return out


def is_image(name: Column | str) -> Column:
    """By extension, in any case; a name that is nothing but an extension is none."""
    return F.lower(F.regexp_extract(P.as_column(name), r"[^/]\.([^./]+)$", 1)).isin(IMAGES)


def age_ramp(mtime: Column | str, now: int) -> Column:
    """0 for new to 1 for two years and older."""
    days = F.greatest(F.lit(now) - P.as_column(mtime), F.lit(0)) / 86400
    return F.least(F.greatest(days / 730, F.lit(0.0)), F.lit(1.0))


def split_sizes(files: DataFrame, min_size: int, include: list[str], exclude: list[str]) -> DataFrame:
    """Regular files of at least min_size (1 at least) bytes, not in the cloud, whose path or name matches an include (if any)
    and no exclude; nothing below an excluded directory, roots spared (``root``, if the rows have it)."""
    rows = without_excluded(files, [], exclude, "root" if "root" in files.columns else None).where((F.col("kind") == "File") & (F.col("apparent") >= max(1, min_size)))
    if "cloud" in files.columns:
        rows = rows.where(~F.coalesce("cloud", F.lit(False)))
    return rows.where(G.matches_any([F.col("path"), P.name("path")], include)) if include else rows


def related(rows: DataFrame, path: str) -> DataFrame:
    """Rows at, below or above a path."""
    return rows.where(P.under("path", F.lit(path)) | P.under(F.lit(path), "path"))


def staged_flags(entries: DataFrame, staged: DataFrame) -> DataFrame:
    """``staged``: the entry or a directory above it is staged."""
    tops = outermost(staged.select(F.col("path").alias("top")))
    hit = kept(below(entries.select("path"), tops).distinct(), "hit")
    dropped(tops)
    return flagged(entries, hit, "path", "staged")


def notes() -> Column:
    """What a tooltip tells besides sizes, from hardlinked, hardlink_dup, cloud, excluded, error and staged."""
    flags = [("hardlink_dup", "counted at another link"), ("hardlinked", "has several links"), ("cloud", "in the cloud"), ("excluded", "not scanned"), ("staged", "staged")]
    return F.array_compact(F.array(*(F.when(F.col(c), text) for c, text in flags), F.when(F.col("error").isNotNull(), F.lit("could not be read"))))
