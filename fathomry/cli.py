"""Command line: volumes, scan, dev, dup, delete, diagnostics, journal. Nothing is ever deleted; ``delete`` prints and journals a plan."""

from __future__ import annotations

import argparse
import json
import os
import sys
import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fathomry import settings as S
from fathomry.functions import paths as P
from fathomry.functions.formats import exact_size
from fathomry.operators import buildtrees, dedup, dupfiles, export, filters, graph, ops, similar, tree
from fathomry.schemas import CACHE
from fathomry.sources import files, git
from fathomry.sources.filesystem import scan, volumes
from fathomry.sources.rules import builtin


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="fathomry", description=__doc__)
    p.add_argument("--settings", default="")
    sub = p.add_subparsers(dest="command", required=True)
    v = sub.add_parser("volumes")
    v.add_argument("--json", action="store_true")
    s = sub.add_parser("scan")
    s.add_argument("paths", nargs="+")
    s.add_argument("--depth", type=int, default=2)
    s.add_argument("--top", type=int, default=20, help="children shown of each directory")
    s.add_argument("--largest", type=int, default=0)
    s.add_argument("--apparent", action="store_true")
    s.add_argument("--exclude", action="append", default=[])
    s.add_argument("--follow-symlinks", action="store_true")
    s.add_argument("--cross-filesystems", action="store_true")
    s.add_argument("--json", action="store_true")
    s.add_argument("--csv", action="store_true")
    d = sub.add_parser("dev")
    d.add_argument("paths", nargs="+")
    d.add_argument("--stale", type=int, default=0, help="only projects that many days inactive")
    d.add_argument("--type", action="append", default=[])
    d.add_argument("--depth", type=int, default=None)
    d.add_argument("--json", action="store_true")
    d.add_argument("--no-git", action="store_true", help="don't ask Git for tracked files and last commits")
    u = sub.add_parser("dup")
    u.add_argument("paths", nargs="+")
    u.add_argument("--min-size", type=int, default=None)
    u.add_argument("--include", default="")
    u.add_argument("--exclude", default="")
    u.add_argument("--cache", default="", help="folder of the hash cache")
    u.add_argument("--verify", action="store_true", help="compare byte by byte")
    u.add_argument("--similar", type=int, default=None, metavar="DISTANCE", help="similar images too, within so many bits (--hashes)")
    u.add_argument("--hashes", default="", help="table of images: path, dhash, phash, width, height")
    u.add_argument("--json", action="store_true")
    u.add_argument("--csv", default="", help="folder to write the groups to")
    x = sub.add_parser("delete")
    x.add_argument("paths", nargs="+")
    x.add_argument("--journal", default="")
    x.add_argument("--method", choices=["trash", "permanent"], default="trash")
    x.add_argument("--yes", action="store_true", help="confirm the plan; else it is a dry run")
    x.add_argument("--json", action="store_true")
    g = sub.add_parser("diagnostics")
    g.add_argument("paths", nargs="*", help="directories to count")
    j = sub.add_parser("journal")
    j.add_argument("path")
    j.add_argument("--limit", type=int, default=50)
    j.add_argument("--json", action="store_true")
    return p


def snapshot(spark: SparkSession, paths: list[str], now: int) -> DataFrame:
    """The paths as staged items: directories with their contents' blocks and their own."""
    found = scan(spark, paths, leaf_roots=True)
    tops = spark.createDataFrame([(os.path.abspath(p), i) for i, p in enumerate(paths)], "path string, seq long")
    rows = found.join(tops, "path").withColumnRenamed("error", "e")
    sums = tree.directory_totals(found, rows.where("kind = 'Dir'"), own=True).select("path", F.col("allocated").alias("a"), F.col("apparent").alias("b"), F.col("entries").alias("n"))
    rows = rows.join(sums, "path", "left")
    return rows.select(
        "seq", "path", "kind", F.coalesce("a", "allocated").alias("allocated"), F.coalesce("b", "apparent").alias("apparent"), "mtime", "mtime_nanos", "dev", "ino", "nlink",
        F.coalesce("n", F.lit(1)).alias("entry_count"), F.lit("cli").alias("source"), F.lit("").alias("reason"), F.lit(now).cast("long").alias("staged_at"),
    )


def candidates(spark: SparkSession, paths: list[str], min_size: int, include: str, exclude: str) -> DataFrame:
    """Files under the paths that a search for duplicates looks at, each path once."""
    cut = lambda text: [g.strip() for g in text.replace(";", ",").split(",") if g.strip()]
    found = filters.split_sizes(scan(spark, paths), min_size, cut(include), cut(exclude)).dropDuplicates(["path"])
    return found.select("path", F.col("apparent").alias("size"), "mtime", "dev", "ino")


def run(argv: list[str], spark: SparkSession | None = None, out=sys.stdout) -> int:  # noqa: ANN001
    args = parser().parse_args(argv)
    settings, problem = S.load(args.settings) if args.settings else (S.Settings(), None)
    if problem:
        print(problem, file=sys.stderr)
    spark = spark or SparkSession.builder.appName("fathomry").getOrCreate()
    say = lambda *x: print(*x, file=out)
    size = "agg_apparent" if getattr(args, "apparent", False) or settings.size_mode == "apparent" else "agg_allocated"
    if args.command == "volumes":
        rows = tree.volume_use(volumes(spark)).orderBy("mount").collect()
        if args.json:
            say(json.dumps([r.asDict() for r in rows], indent=2, ensure_ascii=False))
            return 0
        for v in rows:
            say(f"{v['mount']:<30} {v['fs']:<10} {exact_size(v['used']):>12} of {exact_size(v['total']):>12} {v['fraction']:>6.1%} {v['band']}")
    elif args.command == "scan":
        options = settings.scan_options()
        found = tree.mark_hard_links(scan(spark, args.paths, options["exclude_paths"], [*options["exclude_globs"], *args.exclude], options["follow_symlinks"] or args.follow_symlinks, options["cross_filesystems"] or args.cross_filesystems))
        rolled = tree.rolled_up(found).persist()
        for path in map(os.path.abspath, args.paths):
            if args.json:
                for part in export.json_parts(rolled, tree.issues(rolled), path, args.depth, args.top, size):
                    out.write(part)
                say()
            elif args.csv:
                say("\n".join(r["line"] for r in export.csv_lines(rolled, path, args.depth).orderBy("position").collect()))
            elif args.largest:
                for r in tree.largest_files(rolled.where(P.under("path", F.lit(path))), args.largest).collect():
                    say(f"{exact_size(r['apparent']):>12}  {r['path']}")
            else:
                rows = {r["path"]: r for r in tree.summarize(rolled, path, args.depth, args.top, size).collect()}
                for r in sorted(rows.values(), key=lambda r: r["path"].split("/")):
                    above = rows.get(os.path.dirname(r["path"]))
                    part = 100.0 if above is None else 100 * r[size] / max(1, above[size])
                    say(f"{exact_size(r[size]):>12} {part:>6.1f} %  {'  ' * r['level']}{r['path']}")
        rolled.unpersist()
    elif args.command == "dev":
        rules = builtin()
        if settings.custom_rules:
            from fathomry.sources.rules import from_toml

            more, errors = from_toml(settings.custom_rules, len(rules))
            rules += more
            for e in errors:
                print(e, file=sys.stderr)
        now = int(time.time())
        found = scan(spark, args.paths)
        depth = None if args.depth is None else args.depth + min(len(os.path.abspath(p).strip("/").split("/")) for p in args.paths)
        known = None if args.no_git else git.answers(git.repositories(found))
        projects = buildtrees.analyze(found, rules, max_depth=depth, tracked=git.tracked(known) if known else None)["projects"]
        if known:
            projects = projects.drop("last_commit").join(git.commits(known, projects), "path", "left")
            for r in known.where("error is not null").toLocalIterator():
                print(f"{r['repo']}: {r['error']}", file=sys.stderr)
        projects = buildtrees.filter_projects(projects, now, args.type, 0, args.stale)
        if args.json:
            out.write("[")
            for k, r in enumerate(buildtrees.in_order(projects).toLocalIterator()):
                out.write(",\n" * (k > 0) + json.dumps(r.asDict(), ensure_ascii=False))
            say("]")
            return 0
        for r in buildtrees.in_order(projects).collect():
            say(f"{exact_size(r['artifact_size']):>12}  {', '.join(r['types']):<24} {r['path']}")
        for r in buildtrees.totals(projects).collect():
            say(f"{r['projects']} projects, {exact_size(r['artifact_size'])} in artifacts")
    elif args.command == "dup":
        seen = graph.staged(candidates(spark, args.paths, settings.min_duplicate_size if args.min_size is None else args.min_size, args.include, args.exclude))
        known = files.read_cache(spark, args.cache) if args.cache else spark.createDataFrame([], CACHE)
        found = dupfiles.find(seen, known, args.verify)
        if args.cache:
            files.save_cache(dupfiles.renewed(known, found, [os.path.abspath(p) for p in args.paths], seen), args.cache)
        like = spark.createDataFrame([], "root string, max_distance int, path string, size bigint, mtime bigint, width int, height int")
        if args.similar is not None:
            if not args.hashes:
                print("--similar needs --hashes: images are compared by given hashes", file=sys.stderr)
                return 2
            images = spark.read.parquet(args.hashes).join(seen.select("path", "size", "mtime"), "path")
            groups = similar.similar_groups(images, args.similar)
            like = groups.join(images, "path").select("root", "max_distance", "path", "size", "mtime", "width", "height")
        if args.csv:
            export.write_duplicates_csv(found.groups, like, args.csv)
        if args.json:
            for part in export.duplicates_document(found.groups, like, found.errors, found.stats):
                out.write(part)
            say()
            return 0
        for r in dedup.export_rows(found.groups).orderBy("group_id", "path").toLocalIterator():
            say(f"{r['group_id']:>5} {exact_size(r['size']):>12}  {r['path']}")
        for r in like.orderBy("root", "path").toLocalIterator():
            say(f"like {r['root']} ({r['max_distance']} bits) {exact_size(r['size']):>12}  {r['path']}")
        for r in dedup.total_wasted(found.groups).collect():
            say(f"{r['groups']} groups, {exact_size(r['total_wasted'])} wasted")
        for r in found.errors.orderBy("path").toLocalIterator():
            print(f"{r['path']}: {r['error']}", file=sys.stderr)
    elif args.command == "diagnostics":
        counters = tree.scan_counters(scan(spark, args.paths)).first().asDict() if args.paths else None
        out.write(export.diagnostics(settings, counters, [("error", problem)] if problem else [], spark))
    elif args.command == "delete":
        now = int(time.time())
        staged = snapshot(spark, args.paths, now)
        trees = [*filters.PROTECTED_TREES, *settings.protected]
        plan = ops.exec_plan(staged, staged, filters.PROTECTED_PATHS, trees).orderBy("seq")
        rows = plan.collect()
        if any(r["outcome"] == "Protected" for r in rows):
            say("refused: a path is protected")
            return 2
        asked = ops.needs_confirmation(staged, settings.confirm_bytes, settings.confirm_count).first()
        if args.yes and args.method == "permanent" and asked["confirm"]:
            print(f"{asked['items']} items, {exact_size(asked['reclaimable'])}: type DELETE to confirm the plan", file=sys.stderr)
            if sys.stdin.readline().strip() != "DELETE":
                say("not confirmed")
                return 3
        if args.json:
            entries = [{"path": r["path"], "outcome": r["outcome"], "expected": r["expected"], "plan": r["plan"]} for r in rows]
            say(json.dumps({"confirmed": args.yes, "method": args.method, "entries": entries, **ops.report(plan).first().asDict()}, indent=2, ensure_ascii=False))
        else:
            for r in rows:
                say(f"{r['outcome']:<10} {exact_size(r['expected']):>12}  {r['path']}: {r['plan']}")
            say(f"{asked['items']} items, {exact_size(asked['reclaimable'])}" + (", large enough to ask again" if asked["confirm"] else "") + ("" if args.yes else "; dry run, confirm with --yes"))
        if args.journal:
            files.append_journal(ops.journal_rows(plan, now, f"plan-{args.method}" if args.yes else "plan"), args.journal)
    else:
        rows = files.journal_tail(spark, args.path, args.limit).collect()
        if args.json:
            say(json.dumps([r.asDict() for r in rows], indent=2, ensure_ascii=False))
            return 0
        for r in rows:
            say(f"{r['timestamp']} {r['operation']:<10} {r['result']:<7} {r['path']}" + (f" -> {r['destination']}" if r["destination"] else ""))
    return 0


if __name__ == "__main__":
    sys.exit(run(sys.argv[1:]))
