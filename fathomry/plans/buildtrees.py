"""Queries of build artifacts and projects; each with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fathomry.functions import paths as P
from fathomry.functions.globs import to_regex
from fathomry.operators import buildtrees as D
from fathomry.operators import filters
from fathomry.operators.graph import dropped, staged
from fathomry.sources import files
from fathomry.sources import tables as S
from fathomry.sources.rules import EXPLAINED, NO_LOCKFILE, TRACKED, builtin

RULES = builtin()
PINNED = ["/w/c1", "/w/c40"]


def rule_match(spark: SparkSession, sf: str) -> DataFrame:
    return D.rule_match(S.dev_entries(spark, sf), RULES)


def named(spark: SparkSession, sf: str) -> DataFrame:
    return D.of_interest(S.dev_entries(spark, sf), RULES)


def artifact_claims(spark: SparkSession, sf: str) -> DataFrame:
    return D.claims(named(spark, sf), RULES)


def assessed(spark: SparkSession, sf: str) -> DataFrame:
    """Claims are written before they meet lockfiles, so that what they shuffled is gone by then."""
    e = named(spark, sf)
    matched = staged(D.rule_match(e, RULES), "matched")
    claimed = staged(D.claims(e, RULES, matched), "claims")
    dropped(matched)
    return D.risk_assess(claimed, e, RULES)


def risk_assess(spark: SparkSession, sf: str) -> DataFrame:
    return assessed(spark, sf).select("path", "rule_id", "risk_rank", "risk_reason")


def claim_resolution(spark: SparkSession, sf: str) -> DataFrame:
    return D.resolve(assessed(spark, sf), RULES).select("path", "ecosystem", "risk_rank", "regenerate")


def lookups(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """What Git would know: some tracked directories, some commit times."""
    o = S.table(spark, sf, "orders")
    home = F.concat(F.lit("/w/c"), F.col("o_custkey"), F.lit("/o"), F.col("o_orderkey"))
    tracked = o.where(F.col("o_orderkey") % 15 == 1).select(F.concat(home, F.lit("/node_modules")).alias("path"))
    commits = o.where(F.col("o_orderkey") % 4 == 0).select(home.alias("path"), (S.seconds("o_orderdate") + 86_400 * 90).alias("last_commit"))
    return tracked, commits


def analysis(spark: SparkSession, sf: str) -> dict[str, DataFrame]:
    return D.analyze(S.dev_entries(spark, sf), RULES, None, None, *lookups(spark, sf))


def artifact_sizes(spark: SparkSession, sf: str) -> DataFrame:
    return analysis(spark, sf)["artifacts"].select("path", "ecosystem", "allocated", "apparent", "entries", "risk", "tracked_by_git")


def nearest_project(spark: SparkSession, sf: str) -> DataFrame:
    return analysis(spark, sf)["artifacts"].select("path", "project_path")


def project_summary(spark: SparkSession, sf: str) -> DataFrame:
    return analysis(spark, sf)["projects"].select("path", "name", "artifact_size", "source_size", "last_source_mtime", "last_commit")


def project_types(spark: SparkSession, sf: str) -> DataFrame:
    return analysis(spark, sf)["projects"].select("path", F.concat_ws("|", "types").alias("types"))


def clean_command(spark: SparkSession, sf: str) -> DataFrame:
    return analysis(spark, sf)["projects"].where("clean_command is not null").select("path", F.concat_ws(" ", "clean_command").alias("command"))


def filter_projects(spark: SparkSession, sf: str) -> DataFrame:
    return D.filter_projects(analysis(spark, sf)["projects"], S.NOW, ["rust", "CMAKE"], 1, 365).select("path")


def select_stale(spark: SparkSession, sf: str) -> DataFrame:
    found = analysis(spark, sf)
    return D.select_stale(found["projects"], found["artifacts"], S.NOW, 700, PINNED).select("path", "project_path")


def project_totals(spark: SparkSession, sf: str) -> DataFrame:
    return D.totals(analysis(spark, sf)["projects"])


def inactive_projects(spark: SparkSession, sf: str) -> DataFrame:
    return analysis(spark, sf)["projects"].select("path", D.inactive_days(S.NOW).alias("days"))


def global_caches(spark: SparkSession, sf: str) -> DataFrame:
    places = spark.createDataFrame([(f"cache {i}", f"/w/c{i}", "Safe" if i % 2 else "Caution") for i in range(1, 40)], "name string, path string, risk string")
    return D.global_caches(S.dev_entries(spark, sf), places).select("name", "path", "risk", "allocated", "entries")


def docker_rows(spark: SparkSession, sf: str) -> DataFrame:
    kind = F.element_at(F.array(*map(F.lit, ["Images", "Containers", "Local Volumes", "Build Cache", "Other"])), (F.col("event_id") % 5 + 1).cast("int"))
    good = F.to_json(F.struct(kind.alias("Type"), F.col("user_id").alias("TotalCount"), F.lit("1").alias("Active"), F.concat(F.col("user_id").cast("string"), F.lit("GB")).alias("Size")))
    lines = S.table(spark, sf, "events").select(F.when(F.col("event_id") % 7 == 0, "no json").when(F.col("event_id") % 11 == 0, "[1]").otherwise(good).alias("line"))
    rows = files.docker_usage(lines)
    return rows.groupBy("Type", files.prune_command().alias("command")).agg(F.count("*").alias("rows"), F.sum(F.col("TotalCount").cast("long")).alias("total"), F.count_if(F.col("Reclaimable") == "").alias("blank"))


def after_execution_projects(spark: SparkSession, sf: str) -> DataFrame:
    """Projects after some artifacts, markers and whole projects were removed."""
    o = S.table(spark, sf, "orders")
    key, home = F.col("o_orderkey"), F.concat(F.lit("/w/c"), F.col("o_custkey"), F.lit("/o"), F.col("o_orderkey"))
    gone = o.where(key % 9 == 2).select(F.concat(home, F.lit("/target")).alias("path")).unionByName(o.where(key % 10 == 1).select(F.concat(home, F.lit("/package.json")).alias("path"))).unionByName(o.where(key % 50 == 3).select(home.alias("path")))
    gone = gone.unionByName(o.where(F.col("o_custkey") % 30 == 9).select(F.concat(F.lit("/w/c"), "o_custkey", F.lit("/package.json")).alias("path"))).distinct()
    left = D.after_removal(analysis(spark, sf), S.dev_entries(spark, sf), gone, RULES, *lookups(spark, sf))
    return left["projects"].select("path", "name", "artifact_size", "source_size", "last_source_mtime", "last_commit")


def excluded_projects(spark: SparkSession, sf: str) -> DataFrame:
    e = S.dev_entries(spark, sf)
    return D.analyze(e, RULES, exclude=["/w/c10", "/w/c11"], max_depth=3)["projects"].select("path", "artifact_size", "source_size")


def projects_with_artifacts(spark: SparkSession, sf: str) -> DataFrame:
    return filters.with_artifacts(analysis(spark, sf)["projects"]).select("path", "artifact_size")


def dev_nearest_ancestor(spark: SparkSession, sf: str) -> DataFrame:
    """Files per nearest directory of a customer, by ancestors."""
    e = S.dev_entries(spark, sf)
    tops = e.where((F.col("kind") == "Dir") & (P.depth("path") == 2)).select(F.col("path").alias("dir"))
    none = tops.where("false")
    return D.nearest(e.where("kind = 'File'").select(P.parent("path").alias("dir"), "apparent"), "dir", tops, none).groupBy("project_path").agg(F.count("*").alias("files"), F.sum("apparent").alias("apparent"))


def quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def values(rows: list[tuple]) -> str:
    return ", ".join("(" + ", ".join(quoted(x) if isinstance(x, str) else str(x) for x in r) + ")" for r in rows)


def pattern(glob: str) -> str:
    return to_regex(glob).replace("(?s)", "")


MARKERS = values([(r[D.ID], pattern(g)) for r in RULES for g in r[D.MARKERS] if r[D.KIND] == "marker" and "/" not in g])
HOLDS = values([(r[D.ID], pattern(g)) for r in RULES for g in r[D.MARKERS] if r[D.KIND] == "dir-contains"])
DIRS = values([(r[D.ID], pattern(g)) for r in RULES for g in r[D.ARTIFACTS]])
LOCKS = values([(r[D.ID], pattern(g)) for r in RULES for g in r[D.LOCKS]])
ROWS = values([(r[D.ID], r[D.ECOSYSTEM], r[D.RANK], r[D.REGENERATE], bool(r[D.LOCKS]), r[D.NOTE] or EXPLAINED[r[D.RISK]], r[D.DEFINES], " ".join(r[D.CLEAN]), r[D.KIND]) for r in RULES])

DEV_SQL = f"""
o AS (SELECT o_orderkey, o_custkey, '/w/c' || o_custkey || '/o' || o_orderkey AS home, epoch(o_orderdate)::BIGINT AS mtime FROM orders),
f0 AS (
  SELECT home || '/' || ['Cargo.toml', 'package.json', 'pyproject.toml', 'CMakeLists.txt', 'README', 'main.py'][o_orderkey % 6 + 1] AS path, 10 AS n, mtime FROM o
  UNION SELECT home || '/yarn.lock', 10, mtime FROM o WHERE o_orderkey % 12 = 1
  UNION SELECT home || '/build/.git/HEAD', 20, mtime FROM o WHERE o_orderkey % 11 = 0
  UNION SELECT home || '/env/pyvenv.cfg', 30, mtime FROM o WHERE o_orderkey % 13 = 0
  UNION SELECT '/w/c' || o_custkey || '/package.json', 10, 0 FROM o WHERE o_custkey % 3 = 0
  UNION SELECT home || '/' || ['target', 'node_modules', 'build', '__pycache__', 'src'][l_linenumber % 5 + 1] || '/l' || l_linenumber || '_' || l_partkey || '_' || l_suppkey, l_quantity::INT, epoch(l_shipdate)::BIGINT
    FROM lineitem JOIN o ON l_orderkey = o_orderkey
),
de AS (
  SELECT path, 'File' AS kind, (n * 100)::BIGINT AS apparent, (n * 512)::BIGINT AS allocated, mtime, string_split(path[2 :], '/') AS p FROM f0
  UNION ALL
  SELECT '/' || array_to_string(p, '/'), 'Dir', 0, 4096, 0, p FROM (SELECT DISTINCT p[1 : i] AS p FROM (SELECT p, unnest(range(1, len(p))) AS i FROM (SELECT string_split(path[2 :], '/') AS p FROM f0)))
),
e AS (SELECT *, p[-1] AS name, '/' || array_to_string(p[1 : -2], '/') AS dir, list_has_any(p, ['.git', '.hg', '.svn']) AS vcs FROM de),
mk(rule_id, re) AS (VALUES {MARKERS}), hold(rule_id, re) AS (VALUES {HOLDS}), ar(rule_id, re) AS (VALUES {DIRS}), lk(rule_id, re) AS (VALUES {LOCKS}),
rl(rule_id, ecosystem, rank, regenerate, wants, note, defines, clean, kind) AS (VALUES {ROWS}),
names AS (SELECT DISTINCT name FROM e),
nm AS (SELECT DISTINCT name, rule_id FROM names JOIN mk ON regexp_matches(name, re)),
nh AS (SELECT DISTINCT name, rule_id FROM names JOIN hold ON regexp_matches(name, re)),
na AS (SELECT DISTINCT name, rule_id FROM names JOIN ar ON regexp_matches(name, re)),
nl AS (SELECT DISTINCT name, rule_id FROM names JOIN lk ON regexp_matches(name, re)),
matched AS (SELECT DISTINCT dir, rule_id FROM e JOIN nm USING (name)),
claim AS (
  SELECT path, dir, rule_id FROM e JOIN na USING (name) JOIN matched USING (dir, rule_id) WHERE kind = 'Dir' AND NOT vcs
  UNION
  SELECT c.path, c.dir, h.rule_id FROM e c JOIN (SELECT DISTINCT dir AS path, rule_id FROM e JOIN nh USING (name)) h USING (path) JOIN na ON na.name = c.name AND na.rule_id = h.rule_id WHERE c.kind = 'Dir' AND NOT vcs
),
locked AS (SELECT DISTINCT dir, rule_id FROM e JOIN nl USING (name)),
assess AS (
  SELECT c.*, r.ecosystem, r.regenerate, r.wants AND l.dir IS NULL AND r.rank < 1 AS raised, CASE WHEN r.wants AND l.dir IS NULL AND r.rank < 1 THEN 1 ELSE r.rank END AS risk_rank,
    CASE WHEN r.wants AND l.dir IS NULL AND r.rank < 1 THEN {quoted(NO_LOCKFILE)} ELSE r.note END AS risk_reason
  FROM claim c JOIN rl r USING (rule_id) LEFT JOIN locked l USING (dir, rule_id)
),
best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY path ORDER BY risk_rank DESC, rule_id) AS k FROM assess) WHERE k = 1),
up AS (SELECT path, '/' || array_to_string(p[1 : i], '/') AS top, i FROM (SELECT path, p, unnest(range(1, len(p) + 1)) AS i FROM e)),
inner_ AS (SELECT b.path, coalesce(sum(x.allocated), 0)::BIGINT AS allocated, coalesce(sum(x.apparent), 0)::BIGINT AS apparent, count(x.path) AS entries, coalesce(bool_or(x.name = '.git'), false) AS repo
  FROM best b LEFT JOIN up ON up.top = b.path AND up.path <> b.path LEFT JOIN e x ON x.path = up.path GROUP BY b.path),
s AS (SELECT best.*, i.allocated, i.apparent, i.entries FROM best JOIN inner_ i USING (path) WHERE NOT repo),
k0 AS (SELECT * FROM s WHERE NOT EXISTS (SELECT 1 FROM up JOIN s t ON up.top = t.path WHERE up.path = s.path AND up.top <> s.path)),
trk AS (SELECT home || '/node_modules' AS path FROM o WHERE o_orderkey % 15 = 1),
kept AS (SELECT * EXCLUDE (risk_rank, k), path IN (SELECT path FROM trk) AS tracked, CASE WHEN path IN (SELECT path FROM trk) THEN 2 ELSE risk_rank END AS risk_rank FROM k0),
blocked AS (SELECT DISTINCT up.path FROM up JOIN kept ON up.top = kept.path),
proj AS (SELECT DISTINCT m.dir, m.rule_id FROM matched m JOIN rl r USING (rule_id) JOIN e ON e.path = m.dir WHERE r.defines AND NOT e.vcs AND m.dir NOT IN (SELECT path FROM blocked)),
pd AS (SELECT DISTINCT dir FROM proj),
loose AS (SELECT DISTINCT dir FROM kept WHERE dir NOT IN (SELECT dir FROM pd)),
near AS (
  SELECT path AS s, CASE WHEN bool_or(p) THEN arg_max(top, i) FILTER (p) ELSE arg_min(top, i) END AS project_path
  FROM up JOIN (SELECT dir, true AS p FROM pd UNION ALL SELECT dir, false FROM loose) t ON t.dir = up.top GROUP BY path
),
art AS (SELECT kept.*, near.project_path FROM kept JOIN near ON near.s = kept.dir),
src AS (SELECT project_path, sum(allocated)::BIGINT AS source_size, max(mtime) AS mtime FROM e JOIN near ON near.s = e.dir WHERE kind <> 'Dir' AND NOT vcs AND e.dir NOT IN (SELECT path FROM blocked) GROUP BY 1),
cm AS (SELECT home AS path, mtime + 86400 * 90 AS last_commit FROM o WHERE o_orderkey % 4 = 0),
prj AS (
  SELECT x.path, string_split(x.path[2 :], '/')[-1] AS name, coalesce((SELECT sum(allocated) FROM art WHERE project_path = x.path), 0)::BIGINT AS artifact_size, coalesce(source_size, 0)::BIGINT AS source_size, coalesce(src.mtime, 0)::BIGINT AS last_source_mtime, last_commit
  FROM (SELECT dir AS path FROM pd UNION SELECT project_path FROM art) x LEFT JOIN src ON src.project_path = x.path LEFT JOIN cm ON cm.path = x.path
),
typ AS (SELECT project_path AS path, 0 AS a, rule_id::BIGINT AS b, '' AS c, ecosystem FROM (SELECT dir AS project_path, rule_id, ecosystem FROM proj JOIN rl USING (rule_id)) UNION ALL SELECT project_path, 1, -allocated, path, ecosystem FROM art),
ptypes AS (SELECT path, string_agg(ecosystem, '|' ORDER BY a, b, c) AS types FROM (SELECT *, row_number() OVER (PARTITION BY path, ecosystem ORDER BY a, b, c) AS k FROM typ) WHERE k = 1 GROUP BY path),
act AS (SELECT *, ({S.NOW} - greatest(last_source_mtime, coalesce(last_commit, 0))) AS idle FROM prj),
days AS (SELECT *, greatest(idle, 0) // 86400 AS days FROM act)
"""
# The same, but for two directories that are not looked at and for what lies deeper than four components, which only adds to sizes.
EXCLUDED_SQL = (
    DEV_SQL.replace("\ne AS (SELECT *, p[-1]", "\nea AS (SELECT *, p[-1]")
    .replace("AS vcs FROM de),", "AS vcs FROM de WHERE NOT (path IN ('/w/c10', '/w/c11') OR starts_with(path, '/w/c10/') OR starts_with(path, '/w/c11/'))),\ne AS (SELECT * FROM ea WHERE len(p) <= 4),")
    .replace("inner_ AS (", "upa AS (SELECT path, '/' || array_to_string(p[1 : i], '/') AS top FROM (SELECT path, p, unnest(range(1, len(p) + 1)) AS i FROM ea)),\ninner_ AS (")
    .replace("LEFT JOIN up ON up.top = b.path AND up.path <> b.path LEFT JOIN e x ON x.path = up.path", "LEFT JOIN upa up ON up.top = b.path AND up.path <> b.path LEFT JOIN ea x ON x.path = up.path")
    .replace("WHERE o_orderkey % 15 = 1", "WHERE false")
)
# The same without some paths and all below them.
AFTER_SQL = DEV_SQL.replace("\ne AS (SELECT *, p[-1]", """
gone AS (SELECT home || '/target' AS path FROM o WHERE o_orderkey % 9 = 2 UNION SELECT home || '/package.json' FROM o WHERE o_orderkey % 10 = 1 UNION SELECT home FROM o WHERE o_orderkey % 50 = 3 UNION SELECT '/w/c' || o_custkey || '/package.json' FROM o WHERE o_custkey % 30 = 9),
hit AS (SELECT DISTINCT u.path FROM (SELECT path, '/' || array_to_string(p[1 : i], '/') AS top FROM (SELECT path, p, unnest(range(1, len(p) + 1)) AS i FROM de)) u JOIN gone ON gone.path = u.top),
e AS (SELECT *, p[-1]""").replace("AS vcs FROM de),", "AS vcs FROM de WHERE path NOT IN (SELECT path FROM hit)),")
W = f"WITH {DEV_SQL} "
assert TRACKED

QUERIES = {
    "rule_match": (rule_match, f"{W} SELECT dir, rule_id::INT AS rule_id FROM matched"),
    "artifact_claims": (artifact_claims, f"{W} SELECT path, dir, rule_id::INT AS rule_id FROM claim"),
    "risk_assess": (risk_assess, f"{W} SELECT path, rule_id::INT AS rule_id, risk_rank::INT AS risk_rank, risk_reason FROM assess"),
    "claim_resolution": (claim_resolution, f"{W} SELECT path, ecosystem, risk_rank::INT AS risk_rank, regenerate FROM best"),
    "artifact_sizes": (artifact_sizes, f"{W} SELECT path, ecosystem, allocated, apparent, entries, ['Safe', 'Caution', 'Review'][risk_rank + 1] AS risk, tracked AS tracked_by_git FROM art"),
    "nearest_project": (nearest_project, f"{W} SELECT path, project_path FROM art"),
    "project_summary": (project_summary, f"{W} SELECT path, name, artifact_size, source_size, last_source_mtime, last_commit FROM prj"),
    "project_types": (project_types, f"{W} SELECT path, types FROM ptypes"),
    "clean_command": (clean_command, f"{W} SELECT path, command FROM (SELECT dir AS path, replace(clean, '{{dir}}', dir) AS command, row_number() OVER (PARTITION BY dir ORDER BY rule_id) AS k FROM proj JOIN rl USING (rule_id) WHERE clean <> '') WHERE k = 1"),
    "filter_projects": (filter_projects, f"{W} SELECT path FROM days JOIN ptypes USING (path) WHERE artifact_size >= 1 AND days >= 365 AND list_has_any(string_split(lower(types), '|'), ['rust', 'cmake'])"),
    "select_stale": (select_stale, f"{W} SELECT art.path, art.project_path FROM art JOIN days ON days.path = art.project_path WHERE days >= 700 AND risk_rank < 2 AND NOT (art.path = '/w/c1' OR starts_with(art.path, '/w/c1/') OR starts_with(art.path, '/w/c40/'))"),
    "project_totals": (project_totals, f"{W} SELECT count(*) AS projects, sum(artifact_size)::BIGINT AS artifact_size, sum(source_size)::BIGINT AS source_size FROM prj"),
    "inactive_projects": (inactive_projects, f"{W} SELECT path, days::BIGINT AS days FROM days"),
    "global_caches": (global_caches, f"""{W} SELECT 'cache ' || c AS name, '/w/c' || c AS path, CASE WHEN c % 2 = 1 THEN 'Safe' ELSE 'Caution' END AS risk, sum(x.allocated)::BIGINT AS allocated, count(*) AS entries
        FROM range(1, 40) t(c) JOIN up ON up.top = '/w/c' || c AND up.path <> up.top JOIN e x ON x.path = up.path GROUP BY c"""),
    "docker_rows": (docker_rows, """WITH r AS (SELECT ['Images', 'Containers', 'Local Volumes', 'Build Cache', 'Other'][event_id % 5 + 1] AS "Type", user_id FROM events WHERE event_id % 7 <> 0 AND event_id % 11 <> 0)
        SELECT "Type", CASE "Type" WHEN 'Images' THEN 'docker image prune -f' WHEN 'Containers' THEN 'docker container prune -f' WHEN 'Local Volumes' THEN 'docker volume prune -f' WHEN 'Build Cache' THEN 'docker builder prune -f' END AS command, count(*) AS rows, sum(user_id)::BIGINT AS total, count(*) AS blank FROM r GROUP BY 1, 2"""),
    "after_execution_projects": (after_execution_projects, f"WITH {AFTER_SQL} SELECT path, name, artifact_size, source_size, last_source_mtime, last_commit FROM prj"),
    "excluded_projects": (excluded_projects, f"WITH {EXCLUDED_SQL} SELECT path, artifact_size, source_size FROM prj"),
    "projects_with_artifacts": (projects_with_artifacts, f"{W} SELECT path, artifact_size FROM prj WHERE artifact_size > 0"),
    "dev_nearest_ancestor": (dev_nearest_ancestor, f"{W} SELECT '/' || array_to_string(p[1 : 2], '/') AS project_path, count(*) AS files, sum(apparent)::BIGINT AS apparent FROM e WHERE kind = 'File' AND len(p) > 2 GROUP BY 1"),
}
