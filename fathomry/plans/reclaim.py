"""Queries of the staging drawer, execution plans, journal and live scans; each with its SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fathomry.operators import ops, tree
from fathomry.operators.graph import removed, shared_folder
from fathomry.operators.stored import StoredRollup
from fathomry.plans.buildtrees import DEV_SQL, RULES
from fathomry.sources import tables as S
from fathomry.streaming import links, live
from fathomry.streaming.projects import LiveProjects

PROTECTED = ["/r/EUROPE"]


def drawer_antichain(spark: SparkSession, sf: str) -> DataFrame:
    return ops.top_level(S.staged_items(spark, sf)).select("seq", "path")


def reclaimable(spark: SparkSession, sf: str) -> DataFrame:
    return ops.reclaimable(S.staged_items(spark, sf))


def expected_bytes(spark: SparkSession, sf: str) -> DataFrame:
    return ops.expected_bytes(S.staged_items(spark, sf)).select("seq", "expected")


def confirm_threshold(spark: SparkSession, sf: str) -> DataFrame:
    return ops.needs_confirmation(S.staged_items(spark, sf), 1 << 30, 100)


def staged_by_source(spark: SparkSession, sf: str) -> DataFrame:
    return ops.by_source(S.staged_items(spark, sf))


def staging_outcomes(spark: SparkSession, sf: str) -> DataFrame:
    rows = S.staged_items(spark, sf)
    again = rows.where(F.col("seq") % 10 == 0).withColumn("seq", F.col("seq") + 100_000_000_000_000_000)
    return ops.stage_outcomes(rows.unionByName(again), [], PROTECTED).select("seq", "outcome")


def revalidate(spark: SparkSession, sf: str) -> DataFrame:
    rows = S.staged_items(spark, sf)
    return ops.revalidate(rows, S.present(rows), 1).select("seq", "problem", "bytes")


def planned(spark: SparkSession, sf: str) -> DataFrame:
    rows = S.staged_items(spark, sf)
    return ops.exec_plan(rows, S.present(rows), [], PROTECTED, "permanent", 1)


def exec_plan(spark: SparkSession, sf: str) -> DataFrame:
    return planned(spark, sf).select("seq", "outcome", "expected", "plan")


def exec_report(spark: SparkSession, sf: str) -> DataFrame:
    return ops.report(planned(spark, sf))


def exec_journal(spark: SparkSession, sf: str) -> DataFrame:
    return ops.journal_rows(planned(spark, sf), S.NOW, "plan").groupBy("result").agg(F.count("*").alias("rows"), F.sum("size").alias("bytes"))


def journal_latest(spark: SparkSession, sf: str) -> DataFrame:
    return ops.journal_latest(S.journal(spark, sf), 50).select("line", "operation", "path", "size")


def journal_restorable(spark: SparkSession, sf: str) -> DataFrame:
    return ops.restorable(S.journal(spark, sf)).select("line", "destination")


def link_pairs(spark: SparkSession, sf: str) -> DataFrame:
    d = S.doc_files(spark, sf).select("path", "size", "dev", "ino", F.sha2("content", 256).alias("hash"), F.regexp_extract("path", r"/(\d+)\.txt$", 1).cast("long").alias("n"))
    keep = d.select((F.col("n") + 1).alias("n"), *(F.col(c).alias(f"keep_{c}") for c in ("path", "size", "dev", "ino", "hash")), F.when(F.col("n") % 23 == 0, "Dir").otherwise("File").alias("keep_kind"))
    dup = d.select("n", *(F.col(c).alias(f"dup_{c}") for c in ("path", "size", "ino", "hash")), F.when(F.col("n") % 29 == 0, 2).otherwise(F.col("dev")).alias("dup_dev"), F.when(F.col("n") % 31 == 0, "Symlink").otherwise("File").alias("dup_kind"), F.when(F.col("n") % 37 == 0, "no longer exists").alias("problem"))
    same = d.where(F.col("n") % 5 == 0)
    return dup.join(keep, "n").unionByName(same.select(F.col("n"), *(F.col(c).alias(f"keep_{c}") for c in ("path", "size", "dev", "ino", "hash")), F.lit("File").alias("keep_kind"), F.concat("path", F.lit(".bak")).alias("dup_path"), F.col("size").alias("dup_size"), (F.col("ino") + 1_000_000).alias("dup_ino"), F.col("hash").alias("dup_hash"), F.col("dev").alias("dup_dev"), F.lit("File").alias("dup_kind"), F.lit(None).cast("string").alias("problem")))


def link_eligibility(spark: SparkSession, sf: str) -> DataFrame:
    return ops.link_eligibility(link_pairs(spark, sf), [], ["/docs/fr"]).select("dup_path", "reason")


def link_summary(spark: SparkSession, sf: str) -> DataFrame:
    return ops.link_summary(ops.link_eligibility(link_pairs(spark, sf), [], ["/docs/fr"]))


def quarantine_destination(spark: SparkSession, sf: str) -> DataFrame:
    rows = S.staged_items(spark, sf)
    where = ops.quarantine_destination(F.when(F.col("seq") % 2 == 0, "/r").otherwise("/q"), "20011231", F.when(F.col("seq") % 3 == 0, F.concat("path", F.lit("/../x"))).otherwise(F.col("path")))
    return rows.select("seq", where.alias("destination"))


def quarantine_unique(spark: SparkSession, sf: str) -> DataFrame:
    rows = S.staged_items(spark, sf).select("seq", F.concat(F.lit("/q/"), (F.col("seq") % 50).cast("string")).alias("destination"))
    return ops.unique_destinations(rows).select("seq", "destination")


def volume_roots(spark: SparkSession, sf: str) -> DataFrame:
    e = S.entries(spark, sf).where("kind = 'Dir'")
    dirs = e.select("path", F.when(F.col("path").startswith("/r/ASIA"), 2).when(F.col("path").startswith("/r/EUROPE/"), 3).otherwise(1).alias("dev")).unionByName(spark.createDataFrame([("/", 1)], "path string, dev int"))
    return ops.volume_root(e.select("path"), dirs).select("path", "volume_root")


def drawer_contains(spark: SparkSession, sf: str) -> DataFrame:
    return ops.contains(S.staged_items(spark, sf), S.entries(spark, sf).select("path"))


def drawer_unstage(spark: SparkSession, sf: str) -> DataFrame:
    rows = S.staged_items(spark, sf)
    left = ops.unstage(rows, rows.agg(F.min("path")).first()[0])
    return left.select("seq", "path").unionByName(ops.cleared(left).select("seq", "path"))


def after_execution_tree(spark: SparkSession, sf: str) -> DataFrame:
    done = S.staged_items(spark, sf).where("source = 'map'")
    return ops.after_execution(S.entries(spark, sf), done).groupBy("kind").agg(F.count("*").alias("entries"), F.sum("allocated").alias("allocated"))


def exec_plan_trash(spark: SparkSession, sf: str) -> DataFrame:
    rows = S.staged_items(spark, sf)
    return ops.exec_plan(rows, S.present(rows), [], PROTECTED, "trash", 1).where("outcome = 'Planned'").select("seq", "plan")


def scratch(spark: SparkSession) -> str:
    """A folder that goes when the driver ends."""
    path = f"{shared_folder(spark)}/stream-{uuid.uuid4().hex}"
    removed(spark, path)
    return path


def in_files(rows: DataFrame, key: str, place: str, files: int = 4) -> str:
    """Rows dealt over some files, so that a stream of one file a trigger has as many batches."""
    rows.repartition(files, key).write.parquet(f"{place}/in")
    return f"{place}/in"


EVENT = "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string"
ENTRY = "path string, kind string, apparent bigint, allocated bigint, nlink bigint, dev bigint, ino bigint"


def events_as_entries(rows: DataFrame) -> DataFrame:
    path = F.concat(F.lit("/ev/"), "event_type", F.lit("/u"), F.col("user_id") % 20, F.lit("/e"), F.col("event_id"))
    return rows.select(path.alias("path"), F.lit("File").alias("kind"), F.floor(F.col("value") * 100).cast("long").alias("apparent"), (F.floor(F.col("value")).cast("long") * 512).alias("allocated"), (F.col("user_id") % 3 + 1).alias("nlink"), F.lit(1).cast("long").alias("dev"), F.col("user_id").alias("ino"))


def events(spark: SparkSession, sf: str, place: str) -> DataFrame:
    """The events in batches; events of one user, so links to one file, are in several of them."""
    return live.entry_stream(spark, in_files(S.table(spark, sf, "events"), "event_id", place), EVENT, "*.parquet", 1)


def live_projects(spark: SparkSession, sf: str) -> LiveProjects:
    """The entries of projects in two batches, kept up after each."""
    place = scratch(spark)
    rows = S.dev_entries(spark, sf)
    kept = LiveProjects(spark, f"{place}/p", RULES)
    stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(in_files(rows, "path", place, 2))
    stream.writeStream.foreachBatch(kept.upkeep).option("checkpointLocation", f"{place}/c").trigger(availableNow=True).start().awaitTermination()
    return kept


def stream_project_sizes(spark: SparkSession, sf: str) -> DataFrame:
    return live_projects(spark, sf).projects().select("path", "name", "artifact_size", "source_size", "last_source_mtime")


def stream_rollup(spark: SparkSession, sf: str) -> DataFrame:
    place = scratch(spark)
    live.to_table(live.rollup_stream(events_as_entries(events(spark, sf, place))), f"{place}/t", f"{place}/c", "update").awaitTermination()
    return live.latest(spark, f"{place}/t", "path string, agg_apparent bigint, agg_allocated bigint, items bigint", ["path"])


def stream_hardlink_dedup(spark: SparkSession, sf: str) -> DataFrame:
    place = scratch(spark)
    live.to_table(live.first_links(events_as_entries(events(spark, sf, place))), f"{place}/t", f"{place}/c").awaitTermination()
    rows = live.appended(spark, f"{place}/t", ENTRY)
    return rows.groupBy((F.col("nlink") > 1).alias("linked")).agg(F.count("*").alias("files"), F.count_distinct("ino").alias("inodes"))


def deltas(spark: SparkSession, sf: str, place: str) -> DataFrame:
    """Links of the events, told over four batches, as a table."""
    live.to_table(links.link_deltas(events_as_entries(events(spark, sf, place))), f"{place}/d", f"{place}/dc", few=True).awaitTermination()
    return live.appended(spark, f"{place}/d", links.DELTA)


def stream_links_rollup(spark: SparkSession, sf: str) -> DataFrame:
    """The rollup of a live scan with links: a stream of deltas, and a stream of sums over these."""
    place = scratch(spark)
    deltas(spark, sf, place)
    rows = spark.readStream.schema(links.DELTA).option("maxFilesPerTrigger", 8).option("recursiveFileLookup", "true").parquet(f"{place}/d")
    live.to_table(links.rollup_of_deltas(rows), f"{place}/t", f"{place}/c", "update").awaitTermination()
    return live.latest(spark, f"{place}/t", "path string, agg_apparent bigint, agg_allocated bigint, items bigint", ["path"])


def stream_link_flags(spark: SparkSession, sf: str) -> DataFrame:
    place = scratch(spark)
    deltas(spark, sf, place)
    return live.latest(spark, f"{place}/d", links.DELTA, ["path"]).select("path", "linked", "dup")


def removed_rollup(spark: SparkSession, sf: str) -> DataFrame:
    """A stored rollup after removals: one twice, one inside another, one of a path that isn't there."""
    store = StoredRollup.create(tree.mark_hard_links(S.entries(spark, sf)), scratch(spark))
    for path in ("/r/AMERICA/NATION_1", "/r/EUROPE", "/r/EUROPE/NATION_6", "/r/AMERICA/NATION_1", "/r/none"):
        store.remove(path)
    return store.rows().where("kind = 'Dir'").select("path", "agg_apparent", "agg_allocated", "items")


def quarantined(spark: SparkSession, sf: str) -> DataFrame:
    """What the journal has moved, as entries: files in two quarantine folders and elsewhere, and the directories above."""
    moved = S.journal(spark, sf).where("destination is not null")
    to = F.when(F.col("line") % 4 == 0, F.replace("destination", F.lit("/vol/"), F.lit("/mnt/b/"))).otherwise(F.col("destination"))
    rows = moved.select(to.alias("path"), F.lit("File").alias("kind"), F.col("size").alias("allocated"), (F.floor(F.col("line") / 3) % 3 + 1).alias("nlink"))
    dirs = tree.directories_of(rows).select("path", F.lit("Dir").alias("kind"), F.lit(4096).cast("long").alias("allocated"), F.lit(1).cast("long").alias("nlink"))
    return rows.unionByName(dirs)


def quarantine_folders(spark: SparkSession, sf: str) -> DataFrame:
    rows = quarantined(spark, sf)
    volumes = rows.select(F.explode(F.array(F.lit("/vol"), F.lit("/mnt/b"), F.lit("/none"), F.lit("/"))).alias("mount")).distinct()
    return ops.quarantine_folders(volumes, rows)


def quarantine_emptying(spark: SparkSession, sf: str) -> DataFrame:
    """Asked of every directory, some files and some paths that are gone."""
    rows = quarantined(spark, sf)
    asked = rows.where("kind = 'Dir' or nlink = 2").select("path").unionByName(rows.where("nlink = 3").select(F.concat(F.col("path"), F.lit("/.fathomry-quarantine")).alias("path")))
    return ops.emptying(asked, rows).select("path", "refused")


def journal_restoring(spark: SparkSession, sf: str) -> DataFrame:
    journal = S.journal(spark, sf)
    left = journal.where("destination is not null and line % 5 <> 1").select(F.col("destination").alias("path"))
    return ops.restoring(journal, left.unionByName(journal.where("line % 7 = 2").select("path"))).select("line", "refused")


def stream_journal(spark: SparkSession, sf: str) -> DataFrame:
    place = scratch(spark)
    rows = events(spark, sf, place).select(F.col("event_type").alias("operation"), F.floor(F.col("value") * 100).cast("long").alias("size"))
    live.to_table(rows, f"{place}/t", f"{place}/c").awaitTermination()
    return live.appended(spark, f"{place}/t", "operation string, size bigint").groupBy("operation").agg(F.count("*").alias("rows"), F.sum("size").alias("bytes"))


def stream_projects(spark: SparkSession, sf: str) -> DataFrame:
    place = scratch(spark)
    rows = S.dev_entries(spark, sf)
    stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(in_files(rows, "path", place))
    live.to_table(live.project_stream(stream, RULES), f"{place}/t", f"{place}/c").awaitTermination()
    return live.appended(spark, f"{place}/t", "dir string, rule_id int")


W = f"WITH {S.STAGED_SQL} "
HIT = f"""{W}, hit AS (SELECT DISTINCT path FROM (SELECT path, '/' || array_to_string(p[1 : i], '/') AS a FROM (SELECT path, p, unnest(range(1, len(p) + 1)) AS i FROM entries)) JOIN (SELECT path AS a FROM staged WHERE {{0}}) USING (a))"""
J = f"WITH {S.JOURNAL_SQL} "
LINKS = """WITH d AS (SELECT '/docs/' || lang || '/' || source || '/' || doc_id || '.txt' AS path, strlen(text)::BIGINT AS size, 1 AS dev, CASE WHEN doc_id % 7 = 0 THEN doc_id + 1 ELSE doc_id END AS ino, sha256(text) AS hash, doc_id AS n FROM documents),
pairs AS (
  SELECT d.path AS dup_path, d.size AS dup_size, d.ino AS dup_ino, d.hash AS dup_hash, CASE WHEN d.n % 29 = 0 THEN 2 ELSE 1 END AS dup_dev, CASE WHEN d.n % 31 = 0 THEN 'Symlink' ELSE 'File' END AS dup_kind, CASE WHEN d.n % 37 = 0 THEN 'no longer exists' END AS problem,
    k.size AS keep_size, k.dev AS keep_dev, k.ino AS keep_ino, k.hash AS keep_hash, CASE WHEN k.n % 23 = 0 THEN 'Dir' ELSE 'File' END AS keep_kind
  FROM d JOIN d k ON d.n = k.n + 1
  UNION ALL SELECT path || '.bak', size, ino + 1000000, hash, dev, 'File', NULL, size, dev, ino, hash, 'File' FROM d WHERE n % 5 = 0
),
judged AS (SELECT dup_path, dup_size, CASE WHEN starts_with(dup_path, '/docs/fr/') THEN 'protected path' WHEN dup_kind <> 'File' THEN 'only regular files can be replaced by links' WHEN problem IS NOT NULL THEN problem WHEN keep_kind <> 'File' THEN 'link source is not a regular file'
  WHEN keep_dev = dup_dev AND keep_ino = dup_ino THEN 'already the same physical file' WHEN keep_size <> dup_size THEN 'size differs from the kept file' WHEN keep_dev <> dup_dev THEN 'hardlinks require both files on the same volume' WHEN keep_hash <> dup_hash THEN 'content differs from the kept file' END AS reason FROM pairs)
"""
EV = "WITH ev AS (SELECT '/ev/' || event_type || '/u' || (user_id % 20) || '/e' || event_id AS path, floor(value * 100)::BIGINT AS apparent, floor(value)::BIGINT * 512 AS allocated, user_id % 3 + 1 AS nlink, user_id AS ino FROM events) "
EV_LINKS = EV + """, m AS (SELECT *, string_split(path[2 :], '/') AS p, nlink > 1 AS linked FROM ev), f AS (SELECT *, linked AND row_number() OVER (PARTITION BY linked, ino ORDER BY p) > 1 AS dup FROM m)"""
GONE = "(path = '/r/EUROPE' OR starts_with(path, '/r/EUROPE/') OR path = '/r/AMERICA/NATION_1' OR starts_with(path, '/r/AMERICA/NATION_1/'))"
QUARANTINED = f"""{J}, q AS (SELECT CASE WHEN line % 4 = 0 THEN replace(destination, '/vol/', '/mnt/b/') ELSE destination END AS path, size AS allocated, line // 3 % 3 + 1 AS nlink FROM j WHERE destination IS NOT NULL),
d AS (SELECT DISTINCT '/' || array_to_string(p[1 : i], '/') AS path FROM (SELECT p, unnest(range(1, len(p))) AS i FROM (SELECT string_split(path[2 :], '/') AS p FROM q))),
x AS (SELECT path, 'File' AS kind, allocated, nlink FROM q UNION ALL SELECT path, 'Dir', 4096, 1 FROM d)"""

QUERIES = {
    "stream_links_rollup": (stream_links_rollup, f"""{EV_LINKS} SELECT '/' || array_to_string(p[1 : i], '/') AS path, sum(CASE WHEN dup THEN 0 ELSE apparent END)::BIGINT AS agg_apparent, sum(CASE WHEN dup THEN 0 ELSE allocated END)::BIGINT AS agg_allocated, count(*) AS items
        FROM (SELECT *, unnest(range(1, len(p))) AS i FROM f) GROUP BY 1"""),
    "stream_link_flags": (stream_link_flags, f"{EV_LINKS} SELECT path, linked, dup FROM f"),
    "removed_rollup": (removed_rollup, f"""WITH {S.ENTRIES_SQL}, leftover AS (SELECT * FROM marked WHERE NOT {GONE}),
        sums2 AS (SELECT '/' || array_to_string(p[1 : i], '/') AS path, sum(CASE WHEN hardlink_dup THEN 0 ELSE apparent END)::BIGINT AS a, sum(CASE WHEN hardlink_dup THEN 0 ELSE allocated END)::BIGINT AS b, count(*)::BIGINT AS n FROM (SELECT *, unnest(range(1, len(p))) AS i FROM leftover) GROUP BY 1)
        SELECT l.path, coalesce(a, 0) AS agg_apparent, coalesce(b, 0) AS agg_allocated, coalesce(n, 0) AS items FROM leftover l LEFT JOIN sums2 USING (path) WHERE kind = 'Dir'"""),
    "quarantine_folders": (quarantine_folders, f"""{QUARANTINED} SELECT d.path, count(x.path) AS items, coalesce(sum(CASE WHEN x.kind = 'File' AND nlink > 1 THEN 0 ELSE x.allocated END), 0)::BIGINT AS bytes
        FROM d LEFT JOIN x ON starts_with(x.path, d.path || '/') WHERE d.path IN ('/vol/.fathomry-quarantine', '/mnt/b/.fathomry-quarantine', '/none/.fathomry-quarantine', '/.fathomry-quarantine') GROUP BY d.path"""),
    "quarantine_emptying": (quarantine_emptying, f"""{QUARANTINED}, a AS (SELECT path FROM x WHERE kind = 'Dir' OR nlink = 2 UNION ALL SELECT path || '/.fathomry-quarantine' FROM x WHERE nlink = 3)
        SELECT a.path, CASE WHEN string_split(a.path, '/')[-1] <> '.fathomry-quarantine' THEN 'not a quarantine directory' WHEN x.path IS NULL THEN 'no longer exists' WHEN x.kind <> 'Dir' THEN 'not a directory' END AS refused FROM a LEFT JOIN x USING (path)"""),
    "journal_restoring": (journal_restoring, f"""{J} SELECT line, CASE WHEN line % 5 = 1 THEN 'no longer exists' WHEN path IN (SELECT path FROM j WHERE line % 7 = 2) THEN 'original path is occupied' END AS refused
        FROM j WHERE result = 'ok' AND operation = 'quarantine' AND contains(destination, '/.fathomry-quarantine/')"""),
    "drawer_antichain": (drawer_antichain, f"{W} SELECT seq, path FROM tops WHERE top"),
    "reclaimable": (reclaimable, f"{W} SELECT sum(expected)::BIGINT AS reclaimable FROM expect"),
    "expected_bytes": (expected_bytes, f"{W} SELECT seq, expected FROM expect"),
    "confirm_threshold": (confirm_threshold, f"{W} SELECT (SELECT count(*) FROM staged) AS items, sum(expected)::BIGINT AS reclaimable, (SELECT count(*) FROM staged) > 100 OR sum(expected) > 1073741824 AS confirm FROM expect"),
    "staged_by_source": (staged_by_source, f"{W} SELECT source, count(*) AS items, sum(allocated)::BIGINT AS bytes FROM staged GROUP BY source"),
    "staging_outcomes": (staging_outcomes, f"""{W}, x AS (SELECT seq, path, p FROM staged UNION ALL SELECT seq + 100000000000000000, path, p FROM staged WHERE seq % 10 = 0), free AS (SELECT path, min(seq) AS first FROM x WHERE p[2] <> 'EUROPE' GROUP BY path),
        cov AS (SELECT DISTINCT seq FROM (SELECT seq, '/' || array_to_string(p[1 : i], '/') AS a FROM (SELECT seq, p, unnest(range(1, len(p))) AS i FROM x)) u JOIN free ON free.path = u.a AND free.first < u.seq)
        SELECT seq, CASE WHEN p[2] = 'EUROPE' THEN 'Protected' WHEN seq IN (SELECT seq FROM cov) THEN 'Covered' WHEN (SELECT first FROM free WHERE free.path = x.path) < seq THEN 'AlreadyStaged' ELSE 'Staged' END AS outcome FROM x"""),
    "revalidate": (revalidate, f"{W} SELECT seq, problem, (CASE WHEN problem IS NULL AND (now_kind = 'Dir' OR now_nlink <= 1) THEN now_allocated ELSE 0 END)::BIGINT AS bytes FROM checked"),
    "exec_plan": (exec_plan, f"""{W} SELECT seq, outcome, (CASE WHEN outcome = 'Planned' THEN expected ELSE 0 END)::BIGINT AS expected,
        CASE outcome WHEN 'Planned' THEN 'delete permanently: ' || CASE WHEN kind = 'Dir' THEN 'directory (' || entry_count || ' entries)' ELSE 'file' END WHEN 'Protected' THEN 'protected path' ELSE problem END AS plan FROM plan JOIN expect USING (seq)"""),
    "exec_report": (exec_report, f"{W} SELECT count(*) FILTER (outcome = 'Planned') AS succeeded, count(*) FILTER (outcome = 'Skipped') AS skipped, count(*) FILTER (outcome = 'Protected') AS failed, coalesce(sum(expected) FILTER (outcome = 'Planned'), 0)::BIGINT AS bytes FROM plan JOIN expect USING (seq)"),
    "exec_journal": (exec_journal, f"{W} SELECT CASE WHEN outcome = 'Planned' THEN 'ok' ELSE 'failed' END AS result, count(*) AS rows, sum(CASE WHEN outcome = 'Planned' THEN expected ELSE 0 END)::BIGINT AS bytes FROM plan JOIN expect USING (seq) GROUP BY 1"),
    "journal_latest": (journal_latest, f"{J} SELECT line, operation, path, size FROM j ORDER BY line DESC LIMIT 50"),
    "journal_restorable": (journal_restorable, f"{J} SELECT line, destination FROM j WHERE result = 'ok' AND operation = 'quarantine' AND contains(destination, '/.fathomry-quarantine/')"),
    "link_eligibility": (link_eligibility, f"{LINKS} SELECT dup_path, reason FROM judged"),
    "link_summary": (link_summary, f"{LINKS} SELECT count(*) FILTER (reason IS NULL) AS ok, coalesce(sum(dup_size) FILTER (reason IS NULL), 0)::BIGINT AS freed, count(*) FILTER (reason IS NOT NULL) AS failed FROM judged"),
    "quarantine_destination": (quarantine_destination, f"""{W}, x AS (SELECT seq, CASE WHEN seq % 3 = 0 THEN list_concat(p, ['..', 'x']) ELSE p END AS c FROM staged)
        SELECT seq, CASE WHEN seq % 2 = 0 THEN '/r' ELSE '/q' END || '/.fathomry-quarantine/20011231/' || array_to_string(list_filter(CASE WHEN seq % 2 = 0 THEN c[2 :] ELSE c END, lambda y: y <> '..'), '/') AS destination FROM x"""),
    "quarantine_unique": (quarantine_unique, f"{W} SELECT seq, '/q/' || (seq % 50) || CASE WHEN row_number() OVER w > 1 THEN '.' || (row_number() OVER w - 1) ELSE '' END AS destination FROM staged WINDOW w AS (PARTITION BY seq % 50 ORDER BY seq)"),
    "volume_roots": (volume_roots, f"{W} SELECT path, CASE WHEN starts_with(path, '/r/ASIA/') THEN '/r/ASIA' WHEN starts_with(path, '/r/EUROPE/') AND len(p) > 3 THEN '/r/EUROPE/' || p[3] ELSE '/' END AS volume_root FROM entries WHERE kind = 'Dir'"),
    "drawer_contains": (drawer_contains, HIT.format("true") + " SELECT path, path IN (SELECT path FROM staged) AS staged, path IN (SELECT path FROM hit) AS covered FROM entries"),
    "drawer_unstage": (drawer_unstage, f"{W} SELECT seq, path FROM staged WHERE path <> (SELECT min(path) FROM staged)"),
    "after_execution_tree": (after_execution_tree, HIT.format("source = 'map'") + " SELECT kind, count(*) AS entries, sum(allocated)::BIGINT AS allocated FROM entries WHERE path NOT IN (SELECT path FROM hit) GROUP BY kind"),
    "exec_plan_trash": (exec_plan_trash, f"{W} SELECT seq, 'move to trash: ' || CASE WHEN kind = 'Dir' THEN 'directory (' || entry_count || ' entries)' ELSE 'file' END AS plan FROM plan WHERE outcome = 'Planned'"),
    "stream_project_sizes": (stream_project_sizes, f"WITH {DEV_SQL.replace('WHERE o_orderkey % 15 = 1', 'WHERE false')} SELECT path, name, artifact_size, source_size, last_source_mtime FROM prj"),
    "stream_projects": (stream_projects, f"WITH {DEV_SQL} SELECT dir, rule_id::INT AS rule_id FROM matched"),
    "stream_rollup": (stream_rollup, f"{EV} SELECT '/' || array_to_string(p[1 : i], '/') AS path, sum(apparent)::BIGINT AS agg_apparent, sum(allocated)::BIGINT AS agg_allocated, count(*) AS items FROM (SELECT *, unnest(range(1, len(p))) AS i FROM (SELECT *, string_split(path[2 :], '/') AS p FROM ev)) GROUP BY 1"),
    "stream_hardlink_dedup": (stream_hardlink_dedup, f"{EV} SELECT nlink > 1 AS linked, CASE WHEN nlink > 1 THEN count(DISTINCT ino) ELSE count(*) END AS files, count(DISTINCT ino) AS inodes FROM ev GROUP BY nlink > 1"),
    "stream_journal": (stream_journal, "SELECT event_type AS operation, count(*) AS rows, sum(floor(value * 100)::BIGINT)::BIGINT AS bytes FROM events GROUP BY 1"),
}
