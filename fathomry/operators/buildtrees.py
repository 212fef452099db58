"""Build artifacts: which directories can be made again, whose they are, and whether their projects are stale.

Stated without recursion. Candidates are directories that a rule claims through its parent's names (or its own content). Those
that hold a repository are no artifacts; of the rest the outermost count, for nothing is looked for inside an artifact. An
artifact, and every source file that lies in none, belongs to the nearest directory above that defines a project, else to the
outermost directory above that holds artifacts, an implied project. Version control directories are never looked into.

Rules are rows of ``schemas.RULE`` as tuples: a short list, compiled into expressions on names, so that matching needs no join.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fathomry.functions import paths as P
from fathomry.functions.globs import body
from fathomry.operators.graph import added, dropped, staged
from fathomry.operators.screen import among, below, held, lacking, outermost, told
from fathomry.operators.tree import directory_totals
from fathomry.sources.rules import EXPLAINED, NO_LOCKFILE, RISKS, TRACKED, VCS

ID, ECOSYSTEM, MARKERS, ARTIFACTS, RISK, RANK, REGENERATE, LOCKS, KIND, DEFINES, CLEAN, NOTE = range(12)
DAY = 86_400


def hits(name: Column, rules: list[tuple], field: int, kinds: tuple[str, ...] = ("marker", "dir-contains")) -> Column:
    """Ids of the rules one of whose globs in ``field`` matches the name.

    Plain names are looked up in a literal map, so that a name is made once and not for each rule; few match a pattern.
    """
    plain: dict[str, list[int]] = {}
    found = []
    for r in (r for r in rules if r[KIND] in kinds):
        globs = [g for g in r[field] if "/" not in g]
        wild = [body(g) for g in globs if set(g) & set("*?[{\\")]
        for g in dict.fromkeys(g for g in globs if not set(g) & set("*?[{\\")):
            plain.setdefault(g, []).append(r[ID])
        if wild:
            found.append((any_of(wild), r[ID]))
    none = F.array().cast("array<int>")
    ids = none
    if plain:
        ids = F.coalesce(F.try_element_at(F.create_map(*(x for g, at in plain.items() for x in (F.lit(g), F.array(*map(F.lit, at))))), name), none)
    if found:
        each = F.array_compact(F.array(*(F.when(name.rlike(p), F.lit(i)) for p, i in found)))
        ids = F.when(name.rlike(any_of([p.removeprefix("(?s)") for p, _ in found])), F.sort_array(F.array_distinct(F.concat(ids, each)))).otherwise(ids)
    return ids


def hit(name: Column, rules: list[tuple], field: int, kinds: tuple[str, ...] = ("marker", "dir-contains")) -> Column:
    """Whether ``hits`` has any: asked of rows before they are exploded, so that hits are made for the few that have some."""
    globs = [g for r in rules if r[KIND] in kinds for g in r[field] if "/" not in g]
    plain, patterns = sorted({g for g in globs if not set(g) & set("*?[{\\")}), sorted({body(g) for g in globs if set(g) & set("*?[{\\")})
    tests = ([name.isin(plain)] if plain else []) + ([name.rlike(any_of(patterns))] if patterns else [])
    return reduce(lambda a, b: a | b, tests, F.lit(False))


def any_of(patterns: list[str]) -> str:
    """Anchored once, so that a name is tried from its start alone."""
    return f"(?s)^(?:{'|'.join(patterns)})$"


def of_interest(entries: DataFrame, rules: list[tuple]) -> DataFrame:
    """path and kind of the entries that any rule names, written once: ``rule_match``, ``claims`` and ``risk_assess`` give the
    same for these as for all entries, and each look at names costs the few that are left.

    A rule that goes by a directory's content may take any name: of such directories, those that hold a marker are added.
    """
    holds = [r for r in rules if r[KIND] == "dir-contains"]
    wide = {id(r) for r in holds if "*" in r[ARTIFACTS]}
    globs = [g for r in rules for field in (MARKERS, ARTIFACTS, LOCKS) if field != ARTIFACTS or id(r) not in wide for g in r[field]]
    name, plain = P.name("path"), sorted({g for g in globs if not set(g) & set("*?[{\\/")})
    patterns = sorted({body(g) for g in globs if set(g) & set("*?[{\\") and "/" not in g})
    tests = [name.isin(plain)] + ([name.rlike(any_of(patterns))] if patterns else [])
    tests += [F.col("path").endswith("/" + g) for g in sorted({g for g in globs if "/" in g})]
    any_ = reduce(lambda a, b: a | b, tests)
    named = staged(entries.where(any_).select("path", "kind"), "named")
    if not wide:
        return named
    inside = named.where(hit(P.name("path"), holds, MARKERS)).select(P.parent("path").alias("path")).where("path is not null")
    inside = staged(inside.distinct(), "inside")
    # Names are looked at once the few are found, else they would be again for every entry.
    holding = staged(among(entries.where(F.col("kind") == "Dir").select("path", "kind"), inside, "path"), "holding")
    out = added(named, holding.where(~any_))
    dropped(inside, holding)
    return out


def holders(named: DataFrame, rules: list[tuple]) -> DataFrame:
    """dir: directories that hold an entry of ``of_interest``, and those that hold a directory that a rule goes by the content of,
    whether its own entry is among them or not."""
    holds = [r for r in rules if r[KIND] == "dir-contains"]
    out = named.select(P.parent("path").alias("dir"))
    if holds:
        out = out.unionByName(named.where(hit(P.name("path"), holds, MARKERS)).select(P.parent(P.parent("path")).alias("dir")))
    return out.where("dir is not null").distinct()


def rule_match(entries: DataFrame, rules: list[tuple]) -> DataFrame:
    """dir, rule_id: directories that hold a marker of a marker rule."""
    by_name = entries.where(hit(P.name("path"), rules, MARKERS, ("marker",))).select(P.parent("path").alias("dir"), F.explode(hits(P.name("path"), rules, MARKERS, ("marker",))).alias("rule_id"))
    out = by_name
    for r in rules:
        for marker in (m for m in r[MARKERS] if "/" in m and r[KIND] == "marker"):
            deep = entries.where(F.col("path").endswith("/" + marker))
            out = out.unionByName(deep.select(F.expr(f"left(path, length(path) - {len(marker) + 1})").alias("dir"), F.lit(r[ID]).alias("rule_id")))
    return out.where("dir is not null").distinct()


def below_vcs(path: Column | str) -> Column:
    """One of the components, the last one too, is a version control directory."""
    there = reduce(lambda a, b: a | b, (P.as_column(path).contains(n) for n in VCS))
    return there & F.arrays_overlap(P.parts(path), F.array(*map(F.lit, VCS)))


def claims(entries: DataFrame, rules: list[tuple], matched: DataFrame | None = None) -> DataFrame:
    """path, dir (its parent), rule_id: directories that a rule claims.

    A directory's name alone fits many rules that its parent has no marker of; those pairs go before the shuffle.
    """
    matched = staged(rule_match(entries, rules), "matched") if matched is None else matched
    dirs = entries.where((F.col("kind") == "Dir") & ~below_vcs("path")).select("path", P.parent("path").alias("dir"), P.name("path").alias("n")).where("dir is not null")
    named = dirs.where(hit(F.col("n"), rules, ARTIFACTS, ("marker",))).select("path", "dir", F.explode(hits(F.col("n"), rules, ARTIFACTS, ("marker",))).alias("rule_id"))
    pair = F.xxhash64("dir", "rule_id")
    out = among(named.withColumn("pair", pair), matched.select(pair.alias("pair")), "pair").drop("pair").join(matched, ["dir", "rule_id"]).select("path", "dir", "rule_id").distinct()
    holds = [r for r in rules if r[KIND] == "dir-contains"]
    if holds:
        inside = staged(entries.where(hit(P.name("path"), holds, MARKERS)).select(P.parent("path").alias("path"), F.explode(hits(P.name("path"), holds, MARKERS)).alias("rule_id")).distinct(), "inside")
        fits = F.array_contains(hits(F.col("n"), holds, ARTIFACTS), F.col("rule_id"))
        out = out.unionByName(among(dirs, inside, "path").join(inside, "path").where(fits).select("path", "dir", "rule_id").distinct())
    return out


def rule_values(rules: list[tuple], rule_id: str = "rule_id") -> DataFrame | Column:
    """The rule's row as a struct, looked up by its id in a literal map."""
    entry = lambda r: F.struct(F.lit(r[ECOSYSTEM]).alias("ecosystem"), F.lit(r[RANK]).alias("rank"), F.lit(r[REGENERATE]).alias("regenerate"), F.lit(bool(r[LOCKS])).alias("wants_lock"), F.lit(r[NOTE] or EXPLAINED[r[RISK]]).alias("note"), F.lit(r[DEFINES]).alias("defines"))
    return F.element_at(F.create_map(*(x for r in rules for x in (F.lit(r[ID]), entry(r)))), F.col(rule_id))


def risk_assess(claimed: DataFrame, entries: DataFrame, rules: list[tuple]) -> DataFrame:
    """Claims with ecosystem, risk_rank, risk_reason, regenerate: a safe one without a lockfile beside it is raised to Caution."""
    locks = entries.where(hit(P.name("path"), rules, LOCKS)).select(P.parent("path").alias("dir"), F.explode(hits(P.name("path"), rules, LOCKS)).alias("rule_id")).distinct().withColumn("lock", F.lit(True))
    # What the rules tell is looked up after the join, else its texts would be shuffled with every claim.
    rows = claimed.join(locks, ["dir", "rule_id"], "left").withColumn("r", rule_values(rules))
    raised = F.col("r.wants_lock") & F.col("lock").isNull() & (F.col("r.rank") < 1)
    return rows.select(
        "path", "dir", "rule_id", F.col("r.ecosystem").alias("ecosystem"), F.when(raised, 1).otherwise(F.col("r.rank")).alias("risk_rank"),
        F.when(raised, NO_LOCKFILE).otherwise(F.col("r.note")).alias("risk_reason"), F.col("r.regenerate").alias("regenerate"),
    )


def explained(rows: DataFrame, rules: list[tuple]) -> DataFrame:
    """``rows`` (rule_id, risk_rank) with ecosystem, risk_reason, regenerate: what a rule's row tells is looked up again and never
    shuffled; a risk above the rule's own was raised."""
    reason = F.when(F.col("risk_rank") > F.col("r.rank"), NO_LOCKFILE).otherwise(F.col("r.note"))
    told_ = {"ecosystem": F.col("r.ecosystem"), "risk_reason": reason, "regenerate": F.col("r.regenerate")}
    return rows.withColumn("r", rule_values(rules)).withColumns(told_).drop("r")


def highest(assessed: DataFrame) -> DataFrame:
    """path, dir, rule_id, risk_rank: one claim a path, that of the highest risk, then of the earlier rule."""
    best = assessed.groupBy("path", "dir").agg(F.max(F.struct("risk_rank", (-F.col("rule_id")).alias("r"))).alias("x"))
    return best.select("path", "dir", (-F.col("x.r")).alias("rule_id"), "x.risk_rank")


def resolve(assessed: DataFrame, rules: list[tuple]) -> DataFrame:
    """``highest``, with what the rules tell."""
    return explained(highest(assessed), rules).select("path", "dir", "rule_id", "ecosystem", "risk_rank", "risk_reason", "regenerate")


def kept_artifacts(resolved: DataFrame, entries: DataFrame) -> DataFrame:
    """Artifacts with allocated, apparent, entries: no repository inside, and in no other artifact."""
    sized = directory_totals(entries, resolved, own=False)
    rows = staged(resolved.join(sized, "path").where(~F.col("has_repo")).drop("has_repo"), "sized")
    dropped(sized._fathomry_tops)
    tops = rows.select(F.col("path").alias("top"))
    inner = among(rows.select("path", F.explode(P.prefixes("path")).alias("top")), tops, "top").join(tops, "top", "left_semi").select("path").distinct()
    kept = staged(rows.join(inner, "path", "left_anti"), "kept")
    dropped(rows)
    return kept


def marks(projects: DataFrame, loose: DataFrame) -> DataFrame:
    """dir, p: the directories that can own something, and whether they are projects; written once."""
    return staged(projects.select("dir", F.lit(True).alias("p")).unionByName(loose.select("dir", F.lit(False).alias("p"))).groupBy("dir").agg(F.bool_or("p").alias("p")), "marks")


def owner(of: Column | None = None) -> tuple[Column, Column, Column]:
    """Of the marked directories above a row (those that ``of`` tells, if given) ``owned``: one is a project; ``near``: the
    innermost project; ``far``: the outermost other."""
    of = F.lit(True) if of is None else of
    return (
        F.max_by("dir", F.when(F.col("p") & of, P.depth("dir"))).alias("near"), F.min_by("dir", F.when(~F.col("p") & of, P.depth("dir"))).alias("far"),
        F.bool_or(F.col("p") & of).alias("owned"),
    )


def owned_by() -> Column:
    return F.when(F.col("owned"), F.col("near")).otherwise(F.col("far")).alias("project_path")


def nearest(rows: DataFrame, start: str, projects: DataFrame, loose: DataFrame, tops: DataFrame | None = None) -> DataFrame:
    """``rows`` with ``project_path``: the nearest of ``projects`` at or above ``start``, else the outermost of ``loose``;
    rows without either go. Ancestors are exploded from distinct starts, not from rows. ``tops``: their ``marks``, if made before."""
    starts, tops = rows.select(F.col(start).alias("s")).distinct(), marks(projects, loose) if tops is None else tops
    # A start that is a project is settled; only the others look above. Each step's shuffle goes before the next begins.
    own = staged(starts.join(tops.withColumnRenamed("dir", "s"), "s", "left").select("s", (F.coalesce("p", F.lit(False)) & P.plain("s")).alias("p")), "starts")
    above = among(own.where("not p").select("s", F.explode_outer(P.prefixes("s", 1)).alias("dir")), tops, "dir")
    far = above.join(tops, "dir").groupBy("s").agg(*owner()).select("s", owned_by())
    found = staged(own.where("p").select("s", F.col("s").alias("project_path")).unionByName(far), "owned")
    dropped(own)
    out = rows.join(found.withColumnRenamed("s", start), start)
    out._fathomry_found = found
    return out


def owned_sums(files: DataFrame, owners: DataFrame) -> DataFrame:
    """project_path, source_size, last_source_mtime of ``files`` (s, the directory that holds it, size, mtime) by ``owners`` (dir, p,
    a), each dir once: those that can own something, and artifacts (a), whose files are nobody's. No project lies in an artifact.

    Two directories up, one that surely is no owner gives its place to the one above it, before anything is shuffled. What then
    lies in a project is settled; only the rest carries its sums to every owner above it.
    """
    for _ in range(2):
        files = told(files, {"s": owners.select("dir")}).select(F.when(F.col("__s"), F.col("s")).otherwise(P.parent("s")).alias("s"), "size", "mtime").where("s <> '/'")
    sums = files.groupBy("s").agg(F.sum("size").alias("size"), F.max("mtime").alias("mtime"))
    own = staged(sums.join(owners.withColumnRenamed("dir", "s"), "s", "left").where("not coalesce(a, false)").select("s", "size", "mtime", F.coalesce("p", F.lit(False)).alias("p")), "sums")
    above = among(own.where("not p").select("s", "size", "mtime", F.explode_outer(P.prefixes("s", 1)).alias("dir")), owners, "dir").join(owners, "dir")
    far = above.groupBy("s").agg(*owner(~F.col("a")), F.bool_or("a").alias("inside"), F.first("size").alias("size"), F.first("mtime").alias("mtime")).where("not inside")
    far = staged(far.select(owned_by(), "size", "mtime"), "far")
    rows = own.where("p").select(F.col("s").alias("project_path"), "size", "mtime").unionByName(far)
    out = staged(rows.groupBy("project_path").agg(F.sum("size").alias("source_size"), F.max("mtime").alias("last_source_mtime")), "sums")
    dropped(own, far)
    return out


def analyze(entries: DataFrame, rules: list[tuple], exclude: list[str] | None = None, max_depth: int | None = None, tracked: DataFrame | None = None, commits: DataFrame | None = None) -> dict[str, DataFrame]:
    """``artifacts`` and ``projects``. ``tracked`` (path) and ``commits`` (path, last_commit) are lookups of what Git knows.

    Excluded paths and what lies below are not looked at; directories deeper than max_depth below the root are not entered,
    though an artifact found at that depth is reported whole.
    """
    # Each table below feeds several others: checkpoints keep plans small and cost a write of what is left, not of the scan.
    # Entries that lie in such a table already are filtered again by each reader rather than copied.
    rows = entries if hasattr(entries, "_fathomry_path") else staged(entries.where(~P.under_any("path", exclude)) if exclude else entries)
    rows = rows.where(~P.under_any("path", exclude)) if exclude else rows
    live = rows if max_depth is None else rows.where(P.depth("path") <= max_depth + 1)
    named = of_interest(live, rules)
    matched = staged(rule_match(named, rules))
    claimed = staged(claims(named, rules, matched), "claims")
    resolved = staged(highest(risk_assess(claimed, named, rules)))
    dropped(named, claimed)
    kept = kept_artifacts(resolved, rows)
    dropped(resolved)
    if tracked is not None:
        outer = kept
        kept = staged(kept.join(tracked.select("path").distinct().withColumn("tracked_by_git", F.lit(True)), "path", "left").withColumn("tracked_by_git", F.coalesce("tracked_by_git", F.lit(False))))
        dropped(outer)
    tops = kept.select(F.col("path").alias("top"))
    inside = lambda df, column: among(df.select(F.col(column).alias("x"), F.explode_outer(P.prefixes(column, 1)).alias("top")), tops, "top").join(tops, "top", "left_semi").select(F.col("x").alias(column)).distinct()
    defining = [r[ID] for r in rules if r[DEFINES]]
    projects = matched.where(F.col("rule_id").isin(defining) & ~below_vcs("dir"))
    projects = staged(projects.join(inside(projects, "dir"), "dir", "left_anti"))
    dropped(matched)
    dirs = projects.select("dir").distinct()
    loose = kept.select("dir").distinct().join(dirs, "dir", "left_anti")
    marked = marks(dirs, loose)
    found = nearest(kept, "dir", dirs, loose, marked)
    artifacts = explained(found if tracked is not None else found.withColumn("tracked_by_git", F.lit(False)), rules)
    artifacts = artifacts.withColumns({"risk_rank": F.when(F.col("tracked_by_git"), 2).otherwise(F.col("risk_rank")), "risk_reason": F.when(F.col("tracked_by_git"), TRACKED).otherwise(F.col("risk_reason"))})
    artifacts = staged(artifacts.withColumn("risk", F.element_at(F.array(*map(F.lit, RISKS)), F.col("risk_rank") + 1)))
    dropped(found._fathomry_found)
    # Files meet what owns them, or an artifact that they lie in, in one pass.
    owners = marked.withColumn("a", F.lit(False)).unionByName(tops.select(F.col("top").alias("dir"), F.lit(False).alias("p"), F.lit(True).alias("a")))
    owners = staged(owners.groupBy("dir").agg(F.bool_or("p").alias("p"), F.bool_or("a").alias("a")), "owners")
    dropped(marked, kept)
    files = live.where((F.col("kind") != "Dir") & ~below_vcs("path")).select(P.parent("path").alias("s"), F.col("allocated").alias("size"), "mtime")
    sums = owned_sums(files.where("s is not null"), owners)
    dropped(owners)
    # Types: those of defining rules in their order, then those of artifacts, largest first.
    own = projects.withColumn("r", rule_values(rules)).groupBy(F.col("dir").alias("project_path")).agg(F.array_sort(F.collect_set(F.struct("rule_id", F.col("r.ecosystem").alias("e")))).alias("own"))
    order = F.array_sort(F.collect_list(F.struct((-F.col("allocated")).alias("a"), "path", F.col("ecosystem").alias("e"))))
    theirs = artifacts.groupBy("project_path").agg(order.alias("theirs"), F.sum("allocated").alias("artifact_size"))
    paths = dirs.select(F.col("dir").alias("project_path")).unionByName(artifacts.select("project_path")).distinct()
    none = F.array().cast("array<string>")
    names = F.array_distinct(F.concat(F.coalesce(F.transform("own", lambda x: x["e"]), none), F.coalesce(F.transform("theirs", lambda x: x["e"]), none)))
    out = paths.join(sums, "project_path", "left").join(own, "project_path", "left").join(theirs, "project_path", "left")
    clean = clean_command(F.transform("own", lambda x: x["rule_id"]), F.col("project_path"), rules)
    out = out.select(
        F.col("project_path").alias("path"), P.name("project_path").alias("name"), names.alias("types"), F.coalesce("artifact_size", F.lit(0)).alias("artifact_size"),
        F.coalesce("source_size", F.lit(0)).alias("source_size"), F.coalesce("last_source_mtime", F.lit(0)).alias("last_source_mtime"), clean.alias("clean_command"),
    )
    if commits is not None:
        out = out.join(commits.select("path", "last_commit"), "path", "left")
    else:
        out = out.withColumn("last_commit", F.lit(None).cast("long"))
    return {"artifacts": artifacts, "projects": out}


def clean_command(rule_ids: Column, path: Column, rules: list[tuple]) -> Column:
    """The first defining rule's clean command, ``{dir}`` replaced by the path; null without one."""
    known = F.create_map(*(x for r in rules for x in (F.lit(r[ID]), F.array(*map(F.lit, r[CLEAN])) if r[CLEAN] else F.array().cast("array<string>"))))
    first = F.get(F.filter(F.transform(rule_ids, lambda i: F.element_at(known, i)), lambda a: F.size(a) > 0), F.lit(0))
    return F.transform(first, lambda a: F.replace(a, F.lit("{dir}"), path))


def last_activity(mtime: str = "last_source_mtime", commit: str = "last_commit") -> Column:
    return F.greatest(F.col(mtime), F.coalesce(F.col(commit), F.lit(0)))


def inactive_days(now: int) -> Column:
    return F.floor(F.greatest(F.lit(now) - last_activity(), F.lit(0)) / DAY).cast("long")


def filter_projects(projects: DataFrame, now: int, types: list[str] | None = None, min_size: int = 0, inactive: int = 0) -> DataFrame:
    """Any of the types (in any case; none given: all), artifacts of at least min_size, at least so many days inactive."""
    rows = projects.where((F.col("artifact_size") >= min_size) & (inactive_days(now) >= inactive))
    wanted = [t.lower() for t in types or []]
    return rows.where(F.exists("types", lambda t: F.lower(t).isin(wanted))) if wanted else rows


def select_stale(projects: DataFrame, artifacts: DataFrame, now: int, days: int, pinned: list[str]) -> DataFrame:
    """Artifacts of projects at least ``days`` inactive: none to review, nothing pinned."""
    stale = projects.where(inactive_days(now) >= days).select(F.col("path").alias("project_path"))
    return artifacts.join(stale, "project_path", "left_semi").where((F.col("risk") != "Review") & ~P.under_any("path", pinned))


def global_caches(entries: DataFrame, locations: DataFrame) -> DataFrame:
    """name, path, risk, allocated of the cache locations that exist, largest first."""
    found = locations.join(entries.where(F.col("kind") == "Dir").select("path"), "path", "left_semi")
    return found.join(directory_totals(entries, found, own=False).select("path", "allocated", "entries"), "path")


def totals(projects: DataFrame) -> DataFrame:
    return projects.agg(F.count("*").alias("projects"), F.coalesce(F.sum("artifact_size"), F.lit(0)).alias("artifact_size"), F.coalesce(F.sum("source_size"), F.lit(0)).alias("source_size"))


def in_order(projects: DataFrame) -> DataFrame:
    return projects.orderBy(F.desc("artifact_size"), P.parts("path"))


def first_artifacts(artifacts: DataFrame, n: int) -> DataFrame:
    """The n largest artifacts of each project."""
    place = F.row_number().over(Window.partitionBy("project_path").orderBy(F.desc("allocated"), P.parts("path")))
    return artifacts.withColumn("place", place).where(F.col("place") <= n)


def after_removal(found: dict[str, DataFrame], entries: DataFrame, removed: DataFrame, rules: list[tuple], tracked: DataFrame | None = None, commits: DataFrame | None = None) -> dict[str, DataFrame]:
    """An analysis after paths and all below them were removed: only what a removal can touch is looked at again.

    A project's sizes, and whose an artifact is, depend on what lies below the outermost directory above it that is a project or
    holds artifacts. So each removed path is followed up to such a directory, its entries are analysed anew, and everything
    elsewhere stays as it was. Entries come with their ancestors as ``analyze`` takes them.
    """
    tops = staged(removed.select(F.col("path").alias("gone")).distinct(), "gone")
    homes = staged(found["projects"].select("path").unionByName(found["artifacts"].select(P.parent("path").alias("path"))).distinct(), "homes")
    scope = held(tops.select("gone", F.explode(P.prefixes("gone", 1)).alias("path")), homes, "path").groupBy("gone").agg(F.min_by("path", P.depth("path")).alias("scope"))
    scopes = outermost(tops.join(scope, "gone", "left").select(F.coalesce("scope", "gone").alias("scope")))
    # A removed path lies in its scope, so what lies in one is asked of all entries, and each of them is read as it is.
    outer = outermost(tops)
    doomed = staged(below(entries.select("path"), outer), "doomed")
    left = staged(lacking(below(entries, scopes), doomed, "path"), "left")
    again = staged(below(found["projects"].select("path"), scopes).withColumnRenamed("path", "again"), "again")
    dropped(tops, homes, scopes, outer, doomed)
    anew = analyze(left, rules, tracked=tracked, commits=commits)
    dropped(left)
    # No project or holder of artifacts lies above a scope, so an artifact lies in one if its project does.
    kept = lambda df, project: df.join(again, df[project] == again["again"], "left_anti")
    return {"artifacts": kept(found["artifacts"], "project_path").unionByName(anew["artifacts"]), "projects": kept(found["projects"], "path").unionByName(anew["projects"])}
