"""Exports: nested JSON, CSV, SVG. What is nested on the driver is a summary of bounded depth and breadth; lists are
streamed, whole."""

from __future__ import annotations

import json
import math
import platform
from collections.abc import Iterable, Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fathomry.functions import paths as P
from fathomry.functions.formats import csv_field
from fathomry.operators.dedup import export_all
from fathomry.operators.tree import preorder, summarize
from fathomry.settings import Settings


def json_parts(rolled: DataFrame, issues: DataFrame, root: str, max_depth: int, max_children: int, size: str = "agg_allocated") -> Iterator[str]:
    """``{root, issues}`` in pieces: at most max_children to the power of max_depth nodes, then all issues in order of path,
    of which the driver holds a partition at a time."""
    rows = summarize(rolled, root, max_depth, max_children, size).orderBy("level", "rank").collect()
    nodes: dict[str, dict] = {}
    for r in rows:
        node = {"name": r["path"].rsplit("/", 1)[-1] or r["path"], "path": r["path"], "kind": r["kind"], "allocated": r["agg_allocated"], "apparent": r["agg_apparent"], "items": r["items"], "mtime": r["mtime"]}
        nodes[r["path"]] = node
        above = nodes.get(r["path"].rsplit("/", 1)[0] or "/")
        if above is not None and r["level"]:
            above.setdefault("children", []).append(node)
    yield json.dumps({"root": nodes.get(root)}, indent=2, ensure_ascii=False)[:-2] + ',\n  "issues": ['
    yield from elements(r.asDict() for r in issues.orderBy(*issues.columns).toLocalIterator())
    yield "]\n}"


def elements(values: Iterable[dict]) -> Iterator[str]:
    """The elements of an array at the second level of a document, as ``json.dumps`` with an indent of 2 writes them."""
    some = False
    for value in values:
        yield (",\n    " if some else "\n    ") + json.dumps(value, indent=2, ensure_ascii=False).replace("\n", "\n    ")
        some = True
    if some:
        yield "\n  "


def to_json(rolled: DataFrame, issues: DataFrame, root: str, max_depth: int, max_children: int, size: str = "agg_allocated") -> str:
    return "".join(json_parts(rolled, issues, root, max_depth, max_children, size))


def csv_lines(rolled: DataFrame, root: str, max_depth: int) -> DataFrame:
    """position and line of the CSV export, its header at position 0."""
    rows = preorder(rolled, root, max_depth)
    text = F.concat_ws(",", csv_field("path"), "kind", *(F.col(c).cast("string") for c in ("agg_allocated", "agg_apparent", "items", "mtime", "level")))
    head = rolled.sparkSession.createDataFrame([(0, "path,kind,allocated,apparent,items,mtime,depth")], "position int, line string")
    return head.unionByName(rows.select("position", text.alias("line")))


def duplicates_json(groups: DataFrame, similar: DataFrame) -> DataFrame:
    """group_id, kind, wasted and json: one JSON object a group, identical ones first, with its files in order of path."""
    file = F.struct(P.parts("path").alias("p"), "path", "size", "mtime", "width", "height")
    rows = export_all(groups, similar).groupBy("group_id", "kind", "hash", "distance", "group_wasted", "group_size").agg(F.array_sort(F.collect_list(file)).alias("files"))
    files = F.transform("files", lambda f: F.struct(*(f[c].alias(c) for c in ("path", "size", "mtime", "width", "height"))))
    one = F.struct("kind", "hash", "distance", F.col("group_size").alias("size"), F.col("group_wasted").alias("wasted"), files.alias("files"))
    return rows.select("group_id", "kind", F.col("group_wasted").alias("wasted"), F.to_json(one).alias("json"))


def duplicates_document(groups: DataFrame, similar: DataFrame, errors: DataFrame, stats: dict) -> Iterator[str]:
    """``{total_wasted, groups, similar, errors, stats}`` in pieces; total_wasted is of the identical groups, errors are (path, error).

    ``stats`` are the caller's, see ``stage_stats``; the groups' lists are streamed, a partition at a time.
    """
    rows = duplicates_json(groups, similar).persist()
    total = rows.where("kind = 'identical'").agg(F.coalesce(F.sum("wasted"), F.lit(0)).alias("n")).first()["n"]
    yield "{\n" + f'  "total_wasted": {total}'
    for name, kind in (("groups", "identical"), ("similar", "similar")):
        yield f',\n  "{name}": ['
        yield from elements(json.loads(r["json"]) for r in rows.where(F.col("kind") == kind).orderBy("group_id").toLocalIterator())
        yield "]"
    yield ',\n  "errors": ['
    yield from elements(r.asDict() for r in errors.select("path", "error").orderBy("path", "error").toLocalIterator())
    yield '],\n  "stats": ' + json.dumps(stats, indent=2, ensure_ascii=False).replace("\n", "\n  ") + "\n}"
    rows.unpersist()


def stage_stats(counts: DataFrame) -> dict:
    """The stats of the export that ``stage_counts`` knows."""
    return {"files_scanned" if r["stage"] == "scanned" else f"candidates_after_{r['stage']}": r["files"] for r in counts.orderBy("step").collect()}


def write_duplicates_csv(groups: DataFrame, similar: DataFrame, path: str) -> None:
    rows = export_all(groups, similar).select(F.col("group_id").alias("group"), "kind", "hash", "distance", "group_wasted", "path", "size", "mtime", "width", "height")
    rows.orderBy("group", P.parts("path")).write.mode("overwrite").option("header", True).csv(path)


def svg(arcs: DataFrame, side: int = 800, rings: int = 6) -> str:
    """The chart as an SVG document; the number of arcs is bounded by the layout's least angle."""
    radius = side / 2
    hole = radius * 0.24
    width = (radius - hole) / max(rings, 1)
    paths = []
    for a in arcs.orderBy("ring", "start").collect():
        r0, r1 = hole + (a["ring"] - 1) * width, hole + a["ring"] * width
        point = lambda r, t: f"{radius + r * math.sin(t):.2f} {radius - r * math.cos(t):.2f}"
        end = min(a["end"], a["start"] + 2 * math.pi - 1e-4)
        large = int(end - a["start"] > math.pi)
        d = f"M{point(r0, a['start'])}L{point(r1, a['start'])}A{r1:.2f} {r1:.2f} 0 {large} 1 {point(r1, end)}L{point(r0, end)}A{r0:.2f} {r0:.2f} 0 {large} 0 {point(r0, a['start'])}Z"
        title = (a["path"] or f"{a['count']} smaller items").replace("&", "&amp;").replace("<", "&lt;").replace(">", "&gt;")
        paths.append(f'<path d="{d}" fill="hsl({a["branch"] * 47 % 360} 45% {55 + 4 * a["ring"]}%)"><title>{title} ({a["size"]} B)</title></path>')
    return f'<svg xmlns="http://www.w3.org/2000/svg" viewBox="0 0 {side} {side}">{"".join(paths)}</svg>'


def diagnostics(settings: Settings, counters: dict | None, log: list[tuple[str, str]], spark: SparkSession) -> str:
    """What a report of a problem should hold: versions, the settings that matter, the last scan's counters and log lines."""
    s = settings
    lines = [
        f"Spark {spark.version}, Python {platform.python_version()}, {platform.system()} {platform.machine()}",
        f"Settings: rings={s.rings} size_mode={s.size_mode} units={s.units} follow_symlinks={s.follow_symlinks} cross_filesystems={s.cross_filesystems} exclusions={len(s.exclude_paths) + len(s.exclude_globs)}",
    ]
    if counters:
        lines.append(f"Scan: {counters['files']} files, {counters['dirs']} dirs, {counters['errors']} errors")
    return "\n".join([*lines, "Log:", *(f"[{level}] {text}" for level, text in log[-200:])]) + "\n"
