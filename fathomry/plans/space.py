"""Queries of the space map: rollups, rankings, drill-down, filters, layout; each with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fathomry.functions import devices
from fathomry.functions import formats as T
from fathomry.functions import globs as G
from fathomry.functions import paths as P
from fathomry.operators import filters, layout, tree
from fathomry.operators.ordering import numbered
from fathomry.sources import tables as S

EXCLUDED = ["/r/ASIA", "/r/EUROPE/NATION_3"]
GLOBS = ["l1_*", "*/c1?/*"]
#: Extensions of files that stand for pages, of every class.
KINDS = ["jpg", "mp4", "mp3", "zip", "pdf", "rs", "so", "xyz", ""]
SHOWN = ["path", "agg_apparent", "agg_allocated", "items"]


def marked(spark: SparkSession, sf: str) -> DataFrame:
    return tree.mark_hard_links(S.entries(spark, sf))


def rolled(spark: SparkSession, sf: str) -> DataFrame:
    return tree.rolled_up(marked(spark, sf))


def scan_rollup(spark: SparkSession, sf: str) -> DataFrame:
    return tree.rollup(marked(spark, sf)).select(*SHOWN)


def rollup_all_links(spark: SparkSession, sf: str) -> DataFrame:
    return tree.rollup(S.entries(spark, sf)).select(*SHOWN)


def hardlink_dedup(spark: SparkSession, sf: str) -> DataFrame:
    return marked(spark, sf).where("hardlinked").select("path", "hardlink_dup")


def largest_files(spark: SparkSession, sf: str) -> DataFrame:
    return tree.largest_files(marked(spark, sf), 20).select("path", "apparent")


def size_by_kind(spark: SparkSession, sf: str) -> DataFrame:
    return marked(spark, sf).groupBy("kind").agg(F.count("*").alias("entries"), F.sum(F.when(~F.col("hardlink_dup"), F.col("allocated")).otherwise(0)).alias("bytes"))


def summarize_top_n(spark: SparkSession, sf: str) -> DataFrame:
    return tree.summarize(rolled(spark, sf), "/r", 4, 3).select("path", "level", "rank", "agg_allocated", "items")


def csv_rows(spark: SparkSession, sf: str) -> DataFrame:
    return tree.preorder(rolled(spark, sf), "/r", 3).select(F.col("position").cast("int").alias("position"), "path", "kind", "agg_allocated", "items", "level")


def children_pct(spark: SparkSession, sf: str) -> DataFrame:
    return tree.children_share(rolled(spark, sf), "/r").select("path", "agg_allocated", F.round("percent", 6).alias("percent"))


def breadcrumbs(spark: SparkSession, sf: str) -> DataFrame:
    return tree.breadcrumbs(rolled(spark, sf), "/r/AMERICA/NATION_1").select("position", "path", "items")


def remove_subtree(spark: SparkSession, sf: str) -> DataFrame:
    return tree.rollup(tree.remove_subtree(marked(spark, sf), "/r/EUROPE")).select(*SHOWN)


def multi_root(spark: SparkSession, sf: str) -> DataFrame:
    rows = tree.under_roots(S.entries(spark, sf), ["/r/ASIA", "/r/ASIA/NATION_7", "/r/AFRICA"])
    return rows.groupBy("root").agg(F.count("*").alias("entries"), F.sum("allocated").alias("allocated"))


def scan_counters(spark: SparkSession, sf: str) -> DataFrame:
    rows = S.entries(spark, sf).withColumn("error", F.when(F.col("ino") % 100 == 0, "permission denied"))
    return tree.scan_counters(rows)


def issue_rows(spark: SparkSession, sf: str) -> DataFrame:
    rows = S.entries(spark, sf).withColumn("error", F.when(F.col("ino") % 100 == 0, "Permission denied (os error 13)").when(F.col("ino") % 100 == 1, "input/output error"))
    return tree.issues(rows).withColumn("denied", tree.is_denied(F.col("error")))


def exclude_glob(spark: SparkSession, sf: str) -> DataFrame:
    return filters.without_excluded(S.entries(spark, sf), EXCLUDED, GLOBS).groupBy("kind").agg(F.count("*").alias("entries"), F.sum("allocated").alias("allocated"))


def excluded_entries(spark: SparkSession, sf: str) -> DataFrame:
    return filters.excluded(S.entries(spark, sf), EXCLUDED, ["c1?"]).select("path")


def search_substring(spark: SparkSession, sf: str) -> DataFrame:
    return S.entries(spark, sf).where(G.search(P.name("path"), "Ion_1")).select("path")


def search_glob(spark: SparkSession, sf: str) -> DataFrame:
    return S.entries(spark, sf).where(G.search(P.name("path"), "L?_*7")).select("path")


def search_capped(spark: SparkSession, sf: str) -> DataFrame:
    hits, more = filters.search(S.entries(spark, sf), "c*1", 50)
    return hits.select("path").crossJoin(more)


def search_ancestors(spark: SparkSession, sf: str) -> DataFrame:
    return filters.hit_ancestors(S.entries(spark, sf).where(G.search(P.name("path"), "l7_*")))


def protected_filter(spark: SparkSession, sf: str) -> DataFrame:
    rows = S.entries(spark, sf).where("kind = 'Dir'").select(F.concat("path", F.lit("/./x/..")).alias("path"))
    return rows.where(filters.is_protected("path", ["/r/ASIA"], ["/r/AFRICA"])).select(P.normalized("path").alias("path"))


def focus_filter(spark: SparkSession, sf: str) -> DataFrame:
    return filters.related(S.entries(spark, sf).where("kind = 'Dir'"), "/r/ASIA/NATION_2").select("path")


def page_files(spark: SparkSession, sf: str) -> DataFrame:
    url = F.regexp_extract("url", r"://([^?#]*)", 1)
    kind = F.element_at(F.array(*map(F.lit, KINDS)), (F.col("page_id") % len(KINDS) + 1).cast("int"))
    return S.table(spark, sf, "pages").select("page_id", F.concat(F.lit("/"), url, F.lit("/f."), kind).alias("path"), F.octet_length("html").cast("long").alias("size"))


def category_breakdown(spark: SparkSession, sf: str) -> DataFrame:
    rows = page_files(spark, sf)
    return rows.groupBy(filters.category(P.name("path")).alias("category")).agg(F.count("*").alias("files"), F.sum("size").alias("bytes"))


def image_names(spark: SparkSession, sf: str) -> DataFrame:
    name = F.concat(F.element_at(F.array(F.lit("a.PNG"), F.lit("b.jpeg"), F.lit(".png"), F.lit("c.txt"), F.lit("d")), (F.col("page_id") % 5 + 1).cast("int")))
    return S.table(spark, sf, "pages").select("page_id", filters.is_image(name).alias("image"))


def age_buckets(spark: SparkSession, sf: str) -> DataFrame:
    ramp = filters.age_ramp("mtime", S.NOW)
    return S.entry_files(spark, sf).groupBy(F.floor(ramp * 10).cast("int").alias("bucket")).agg(F.count("*").alias("files"), F.sum("apparent").alias("bytes"))


def staged_flags(spark: SparkSession, sf: str) -> DataFrame:
    rows = filters.staged_flags(S.entries(spark, sf), S.staged_items(spark, sf))
    return rows.groupBy("kind", "staged").agg(F.count("*").alias("entries"))


def split_patterns(spark: SparkSession, sf: str) -> DataFrame:
    text = F.concat(F.lit(" *.jpg ;b"), F.col("r_regionkey"), F.lit(",, c ;"))
    return S.table(spark, sf, "region").select("r_regionkey", F.concat_ws("|", G.split_globs(text)).alias("patterns"))


def volume_of(spark: SparkSession, sf: str) -> DataFrame:
    volumes = spark.createDataFrame([("/",), ("/r",), ("/r/ASIA",), ("/r/ASIA/NATION_2",)], "mount string")
    return tree.volume_for(S.entries(spark, sf).where("kind = 'Dir'"), volumes).groupBy("mount").agg(F.count("*").alias("dirs"))


def volume_bands(spark: SparkSession, sf: str) -> DataFrame:
    v = S.table(spark, sf, "supplier").select(F.col("s_suppkey").alias("mount"), F.lit(10_000).cast("long").alias("total"), F.floor(F.greatest(F.col("s_acctbal"), F.lit(0.0))).cast("long").alias("available"))
    return tree.volume_use(v).groupBy("band").agg(F.count("*").alias("volumes"), F.sum("used").alias("used"))


def directory_totals(spark: SparkSession, sf: str) -> DataFrame:
    rows = S.entries(spark, sf)
    return tree.directory_totals(rows, rows.where(P.depth("path") == 3), own=True).select("path", "allocated", "apparent", "entries")


def freed_bytes(spark: SparkSession, sf: str) -> DataFrame:
    return tree.freed_bytes(S.entries(spark, sf), "/r/ASIA")


def arcs(spark: SparkSession, sf: str) -> DataFrame:
    return layout.rings(rolled(spark, sf), "/r", 3, 0.02)


def sunburst_rings(spark: SparkSession, sf: str) -> DataFrame:
    rounded = [F.round(c, 6).alias(c) for c in ("start", "end")]
    return arcs(spark, sf).where("path is not null").select("ring", "path", *rounded, F.col("branch").cast("int").alias("branch"), "size")


def sunburst_small_items(spark: SparkSession, sf: str) -> DataFrame:
    return arcs(spark, sf).where("path is null").select("ring", "parent_path", "size", "count")


def arc_at(spark: SparkSession, sf: str) -> DataFrame:
    points = S.table(spark, sf, "events").select(F.col("event_id").alias("point"), (F.col("user_id") % 2 + 1).cast("int").alias("ring"), (F.col("value") % 7).alias("theta"))
    return layout.arc_at(arcs(spark, sf), points).select("point", "arc_path")


def polar_points(spark: SparkSession, sf: str) -> DataFrame:
    x, y = (F.col("embedding")[i].cast("double") * 60 for i in (0, 1))
    ring, theta = layout.polar(x, y, 15.0, 4)
    return S.table(spark, sf, "embeddings").select("vec_id", ring.alias("ring"), F.round(theta, 6).alias("theta"))


def split_texts(spark: SparkSession, sf: str) -> DataFrame:
    """Whole texts as lists of patterns."""
    found = G.split_globs("text")
    return S.table(spark, sf, "documents").select("doc_id", F.size(found).alias("patterns"), F.md5(F.concat_ws("|", found)).alias("digest"))


def image_parts(spark: SparkSession, sf: str) -> DataFrame:
    """Parts' names with every known extension, in either case."""
    known = [e for group in filters.CATEGORIES.values() for e in group] + ["ico", "", "png.bak"]
    ext = F.element_at(F.array(*map(F.lit, known)), (F.col("p_partkey") % len(known) + 1).cast("int"))
    name = F.concat("p_name", F.lit("."), F.when(F.col("p_size") % 2 == 0, F.upper(ext)).otherwise(ext))
    return S.table(spark, sf, "part").select("p_partkey", filters.is_image(name).alias("image"), filters.category(F.lower(name)).alias("category"))


def list_panel(spark: SparkSession, sf: str) -> DataFrame:
    rows = filters.list_panel(rolled(spark, sf), "/r/ASIA").unionByName(filters.list_panel(rolled(spark, sf), "/r/ASIA", "o*7"))
    return numbered(rows.select("path", "agg_allocated"), [F.desc("agg_allocated"), P.parts("path")], "place").withColumn("place", F.col("place").cast("int"))


def copy_on_write(spark: SparkSession, sf: str) -> DataFrame:
    fs = F.element_at(F.array(*map(F.lit, ["apfs", "ext4", "BTRFS", "xfs", "ntfs", "ReFS", "zfs", "bcachefs"])), (F.col("n_nationkey") % 8 + 1).cast("int"))
    return S.table(spark, sf, "nation").select("n_nationkey", filters.is_copy_on_write(fs).alias("shares"))


def io_concurrency(spark: SparkSession, sf: str) -> DataFrame:
    kind = F.element_at(F.array(*map(F.lit, ["ssd", "hdd", "network", "tape"])), (F.col("n_nationkey") % 4 + 1).cast("int"))
    return S.table(spark, sf, "nation").select("n_nationkey", devices.io_concurrency(kind, F.col("n_nationkey")).alias("readers"))


def sizes(spark: SparkSession, sf: str) -> DataFrame:
    # In exact decimals: keys above some 740,000 give more than a bigint holds. Casts to the very decimals of products cost nothing.
    n = (F.col("o_orderkey") * F.col("o_orderkey")).cast("decimal(19,0)") * F.pow(F.lit(2), F.col("o_orderkey") % 25).cast("decimal(8,0)")
    return S.table(spark, sf, "orders").select("o_orderkey", n.alias("n"))


def fmt_size_binary(spark: SparkSession, sf: str) -> DataFrame:
    return sizes(spark, sf).select("o_orderkey", T.size_text("n").alias("shown"))


def fmt_date(spark: SparkSession, sf: str) -> DataFrame:
    return S.table(spark, sf, "orders").select("o_orderkey", T.date_text(S.seconds("o_orderdate") - F.when(F.col("o_orderkey") % 9 == 0, 2_000_000_000).otherwise(0)).alias("shown"))


def fmt_age(spark: SparkSession, sf: str) -> DataFrame:
    return S.table(spark, sf, "orders").select("o_orderkey", T.age_text(F.col("o_orderkey") % 1000).alias("shown"))


def fmt_digits(spark: SparkSession, sf: str) -> DataFrame:
    return sizes(spark, sf).select("o_orderkey", T.grouped_digits("n").alias("shown"))


def fmt_duration(spark: SparkSession, sf: str) -> DataFrame:
    return S.table(spark, sf, "orders").select("o_orderkey", T.duration_text(F.col("o_orderkey") * 250).alias("shown"))


def fmt_text(spark: SparkSession, sf: str) -> DataFrame:
    rows = S.entry_files(spark, sf)
    return rows.select("path", T.short_path(F.concat(F.lit("/home/someone/projects"), "path"), "/home/someone").alias("short"), T.truncated("path", 20).alias("cut"), T.xml_escaped(F.concat("path", F.lit('<&">'))).alias("safe"), T.csv_field(F.concat("path", F.when(F.col("ino") % 2 == 0, ',"').otherwise(""))).alias("field"))


E, R = S.ENTRIES_SQL, S.ENTRIES_SQL
W = f"WITH {E} "
UNDER = "string_split(path[2 :], '/')"
LEVELS = f"""WITH RECURSIVE {E},
ch AS (SELECT path, p, agg_allocated, items, array_to_string(p[1 : -2], '/') AS up, row_number() OVER (PARTITION BY array_to_string(p[1 : -2], '/') ORDER BY agg_allocated DESC, p[-1]) AS rank FROM rolled WHERE len(p) BETWEEN 2 AND 5),
t AS (SELECT path, p, 0 AS level, 1 AS rank, agg_allocated, items FROM rolled WHERE path = '/r'
  UNION ALL SELECT ch.path, ch.p, t.level + 1, ch.rank, ch.agg_allocated, ch.items FROM ch JOIN t ON ch.up = array_to_string(t.p, '/') WHERE ch.rank <= 3 AND t.level < 4)
SELECT path, level::INT AS level, rank::INT AS rank, agg_allocated, items FROM t"""
PRE = f"""WITH RECURSIVE {E},
r AS (SELECT *, row_number() OVER (PARTITION BY array_to_string(p[1 : -2], '/') ORDER BY agg_allocated DESC, agg_allocated, p[-1] DESC) AS k FROM rolled WHERE len(p) <= 4),
t AS (SELECT path, p, kind, agg_allocated, items, 0 AS level, [0::BIGINT] AS key FROM r WHERE path = '/r'
  UNION ALL SELECT r.path, r.p, r.kind, r.agg_allocated, r.items, t.level + 1, list_append(t.key, r.k) FROM r JOIN t ON array_to_string(r.p[1 : -2], '/') = array_to_string(t.p, '/') AND len(r.p) = len(t.p) + 1)
SELECT (row_number() OVER (ORDER BY key))::INT AS position, path, kind, agg_allocated, items, level::INT AS level FROM t"""
RINGS = f"""WITH {E},
live AS (SELECT path, p, kind, agg_allocated AS size, array_to_string(p[1 : -2], '/') AS up FROM rolled WHERE agg_allocated > 0 AND NOT hardlink_dup),
top AS (SELECT size FROM live WHERE path = '/r'),
a1 AS (SELECT l.*, 2 * pi() / top.size AS per, 0.0::DOUBLE AS ps, 2 * pi() AS pe FROM live l, top WHERE up = 'r'),
b1 AS (SELECT *, coalesce(sum(size) OVER (ORDER BY size DESC, p[-1] ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before, row_number() OVER (ORDER BY size DESC, p[-1]) - 1 AS branch FROM a1 WHERE size * per >= 0.02),
r1 AS (SELECT 1 AS ring, path, p, kind, size, ps + before * per AS s, least(ps + (before + size) * per, pe) AS e, branch FROM b1),
a2 AS (SELECT l.*, (r.e - r.s) / r.size AS per, r.s AS ps, r.e AS pe, r.branch FROM live l JOIN r1 r ON l.up = array_to_string(r.p, '/') AND r.kind = 'Dir'),
b2 AS (SELECT *, coalesce(sum(size) OVER (PARTITION BY up ORDER BY size DESC, p[-1] ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM a2 WHERE size * per >= 0.02),
r2 AS (SELECT 2 AS ring, path, p, kind, size, ps + before * per AS s, least(ps + (before + size) * per, pe) AS e, branch FROM b2),
a3 AS (SELECT l.*, (r.e - r.s) / r.size AS per, r.s AS ps, r.e AS pe, r.branch FROM live l JOIN r2 r ON l.up = array_to_string(r.p, '/') AND r.kind = 'Dir'),
b3 AS (SELECT *, coalesce(sum(size) OVER (PARTITION BY up ORDER BY size DESC, p[-1] ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM a3 WHERE size * per >= 0.02),
r3 AS (SELECT 3 AS ring, path, p, kind, size, ps + before * per AS s, least(ps + (before + size) * per, pe) AS e, branch FROM b3),
drawn AS (SELECT * FROM r1 UNION ALL SELECT * FROM r2 UNION ALL SELECT * FROM r3),
small AS (SELECT ring, '/' || up AS parent_path, sum(size)::BIGINT AS size, count(*) AS count FROM (SELECT 1 AS ring, * EXCLUDE (ps, pe) FROM a1 UNION ALL SELECT 2, * EXCLUDE (ps, pe, branch) FROM a2 UNION ALL SELECT 3, * EXCLUDE (ps, pe, branch) FROM a3) WHERE size * per < 0.02 GROUP BY ALL)
"""
PAGES = f"SELECT page_id, '/' || regexp_extract(url, '://([^?#]*)', 1) || '/f.' || {KINDS}[page_id % {len(KINDS)} + 1] AS path, strlen(html)::BIGINT AS size FROM pages"
CATEGORY = " ".join(f"WHEN ext IN ({', '.join(repr(x) for x in xs)}) THEN '{label}'" for label, xs in filters.CATEGORIES.items())
SIZES = "SELECT o_orderkey, (o_orderkey * o_orderkey * (1::BIGINT << (o_orderkey % 25)::INT))::BIGINT AS n FROM orders"

QUERIES = {
    "scan_rollup": (scan_rollup, f"{W} SELECT path, agg_apparent, agg_allocated, items FROM sums WHERE path IN (SELECT path FROM dirs)"),
    "rollup_all_links": (rollup_all_links, f"{W} SELECT '/' || array_to_string(p[1 : i], '/') AS path, sum(apparent)::BIGINT AS agg_apparent, sum(allocated)::BIGINT AS agg_allocated, count(*) AS items FROM (SELECT *, unnest(range(1, len(p))) AS i FROM entries) GROUP BY 1"),
    "hardlink_dedup": (hardlink_dedup, f"{W} SELECT path, hardlink_dup FROM marked WHERE hardlinked"),
    "largest_files": (largest_files, f"{W} SELECT path, apparent FROM marked WHERE kind = 'File' AND NOT hardlink_dup ORDER BY apparent DESC, p DESC LIMIT 20"),
    "size_by_kind": (size_by_kind, f"{W} SELECT kind, count(*) AS entries, sum(CASE WHEN hardlink_dup THEN 0 ELSE allocated END)::BIGINT AS bytes FROM marked GROUP BY kind"),
    "summarize_top_n": (summarize_top_n, LEVELS),
    "csv_rows": (csv_rows, PRE),
    "children_pct": (children_pct, f"{W} SELECT path, agg_allocated, round(agg_allocated * 100.0::DOUBLE / (SELECT agg_allocated FROM rolled WHERE path = '/r'), 6) AS percent FROM rolled WHERE len(p) = 2"),
    "breadcrumbs": (breadcrumbs, f"""{W}, c(position, top) AS (VALUES (0, '/r'), (1, '/r/AMERICA'), (2, '/r/AMERICA/NATION_1'))
        SELECT position::INT AS position, top AS path, count(*) AS items FROM c JOIN entries e ON starts_with(e.path, top || '/') GROUP BY 1, 2"""),
    "remove_subtree": (remove_subtree, f"""{W} SELECT '/' || array_to_string(p[1 : i], '/') AS path, sum(CASE WHEN hardlink_dup THEN 0 ELSE apparent END)::BIGINT AS agg_apparent,
        sum(CASE WHEN hardlink_dup THEN 0 ELSE allocated END)::BIGINT AS agg_allocated, count(*) AS items FROM (SELECT *, unnest(range(1, len(p))) AS i FROM marked WHERE coalesce(p[2], '') <> 'EUROPE') GROUP BY 1"""),
    "multi_root": (multi_root, f"{W} SELECT root, count(*) AS entries, sum(allocated)::BIGINT AS allocated FROM entries, (VALUES ('/r/ASIA'), ('/r/ASIA/NATION_7'), ('/r/AFRICA')) t(root) WHERE path = root OR starts_with(path, root || '/') GROUP BY root"),
    "scan_counters": (scan_counters, f"{W} SELECT count(*) FILTER (kind <> 'Dir') AS files, count(*) FILTER (kind = 'Dir') AS dirs, sum(CASE WHEN kind = 'File' THEN allocated END)::BIGINT AS bytes, count(*) FILTER (ino % 100 = 0) AS errors FROM entries"),
    "issue_rows": (issue_rows, f"{W} SELECT path, CASE WHEN ino % 100 = 0 THEN 'Permission denied (os error 13)' ELSE 'input/output error' END AS error, ino % 100 = 0 AS denied FROM entries WHERE ino % 100 IN (0, 1)"),
    "exclude_glob": (exclude_glob, f"""{W}, hit AS (SELECT path, p FROM entries WHERE path IN ('/r/ASIA', '/r/EUROPE/NATION_3') OR starts_with(p[-1], 'l1_') OR regexp_matches(path, '/c1./')),
        bad AS (SELECT DISTINCT e.path FROM (SELECT path, '/' || array_to_string(p[1 : i], '/') AS a FROM (SELECT path, p, unnest(range(1, len(p) + 1)) AS i FROM entries)) e JOIN hit ON hit.path = e.a)
        SELECT kind, count(*) AS entries, sum(allocated)::BIGINT AS allocated FROM entries WHERE path NOT IN (SELECT path FROM bad) GROUP BY kind"""),
    "excluded_entries": (excluded_entries, f"{W} SELECT path FROM entries WHERE path IN ('/r/ASIA', '/r/EUROPE/NATION_3') OR regexp_full_match(p[-1], 'c1.')"),
    "search_substring": (search_substring, f"{W} SELECT path FROM entries WHERE contains(lower(p[-1]), 'ion_1')"),
    "search_glob": (search_glob, f"{W} SELECT path FROM entries WHERE regexp_full_match(lower(p[-1]), 'l._.*7')"),
    "search_capped": (search_capped, f"{W}, h AS (SELECT path, p FROM entries WHERE regexp_full_match(lower(p[-1]), 'c.*1')) SELECT path, (SELECT count(*) > 50 FROM h) AS truncated FROM (SELECT * FROM h ORDER BY p LIMIT 50)"),
    "search_ancestors": (search_ancestors, f"{W} SELECT DISTINCT '/' || array_to_string(p[1 : i], '/') AS path FROM (SELECT p, unnest(range(1, len(p))) AS i FROM entries WHERE starts_with(p[-1], 'l7_'))"),
    "protected_filter": (protected_filter, f"{W} SELECT path FROM entries WHERE kind = 'Dir' AND (path = '/r/ASIA' OR path = '/r/AFRICA' OR starts_with(path, '/r/AFRICA/'))"),
    "focus_filter": (focus_filter, f"{W} SELECT path FROM entries WHERE kind = 'Dir' AND (path IN ('/r', '/r/ASIA', '/r/ASIA/NATION_2') OR starts_with(path, '/r/ASIA/NATION_2/'))"),
    "category_breakdown": (category_breakdown, f"""WITH x AS ({PAGES}), n AS (SELECT size, coalesce(nullif(list_filter(string_split(path, '/'), lambda y: y <> '')[-1], ''), path) AS name FROM x), e AS (SELECT size, regexp_extract(name, '\\.([^.]*)$', 1) AS ext FROM n)
        SELECT CASE {CATEGORY} ELSE 'Other' END AS category, count(*) AS files, sum(size)::BIGINT AS bytes FROM e GROUP BY 1"""),
    "image_names": (image_names, "SELECT page_id, page_id % 5 IN (0, 1) AS image FROM pages"),
    "age_buckets": (age_buckets, f"{W} SELECT floor(least(greatest(greatest({S.NOW} - mtime, 0) / 86400 / 730, 0.0::DOUBLE), 1.0::DOUBLE) * 10)::INT AS bucket, count(*) AS files, sum(apparent)::BIGINT AS bytes FROM files GROUP BY 1"),
    "staged_flags": (staged_flags, f"""WITH {S.STAGED_SQL}, hit AS (SELECT DISTINCT path FROM (SELECT path, '/' || array_to_string(p[1 : i], '/') AS a FROM (SELECT path, p, unnest(range(1, len(p) + 1)) AS i FROM entries)) JOIN (SELECT path AS a FROM staged) USING (a))
        SELECT kind, path IN (SELECT path FROM hit) AS staged, count(*) AS entries FROM entries GROUP BY 1, 2"""),
    "split_patterns": (split_patterns, "SELECT r_regionkey, '*.jpg|b' || r_regionkey || '|c' AS patterns FROM region"),
    "volume_of": (volume_of, f"{W} SELECT CASE WHEN path = '/r/ASIA/NATION_2' OR starts_with(path, '/r/ASIA/NATION_2/') THEN '/r/ASIA/NATION_2' WHEN path = '/r/ASIA' OR starts_with(path, '/r/ASIA/') THEN '/r/ASIA' ELSE '/r' END AS mount, count(*) AS dirs FROM entries WHERE kind = 'Dir' GROUP BY 1"),
    "volume_bands": (volume_bands, """WITH v AS (SELECT greatest(10000 - floor(greatest(s_acctbal, 0))::BIGINT, 0) AS used FROM supplier)
        SELECT CASE WHEN used / 10000 >= 0.95 THEN 'full' WHEN used / 10000 >= 0.85 THEN 'high' ELSE 'ok' END AS band, count(*) AS volumes, sum(used)::BIGINT AS used FROM v GROUP BY 1"""),
    "directory_totals": (directory_totals, f"""{W}, b AS (SELECT '/' || array_to_string(p[1 : 3], '/') AS top, * FROM entries WHERE len(p) > 3),
        c AS (SELECT *, CASE WHEN kind <> 'Dir' AND nlink > 1 THEN row_number() OVER (PARTITION BY top, dev, ino ORDER BY path) ELSE 1 END AS k FROM b)
        SELECT top AS path, sum(CASE WHEN k = 1 THEN allocated ELSE 0 END)::BIGINT AS allocated, sum(CASE WHEN k = 1 THEN apparent ELSE 0 END)::BIGINT AS apparent, count(*) + 1 AS entries FROM c GROUP BY top"""),
    "freed_bytes": (freed_bytes, f"""{W}, i AS (SELECT * FROM entries WHERE path = '/r/ASIA' OR starts_with(path, '/r/ASIA/'))
        SELECT ((SELECT coalesce(sum(allocated), 0) FROM i WHERE kind = 'Dir' OR nlink <= 1) + (SELECT coalesce(sum(b), 0) FROM (SELECT max(allocated) AS b FROM i WHERE kind <> 'Dir' AND nlink > 1 GROUP BY dev, ino HAVING count(*) >= max(nlink))))::BIGINT AS freed"""),
    "sunburst_rings": (sunburst_rings, f'{RINGS} SELECT ring, path, round(s, 6) AS start, round(e, 6) AS "end", branch::INT AS branch, size FROM drawn'),
    "sunburst_small_items": (sunburst_small_items, f"{RINGS} SELECT ring, parent_path, size, count FROM small"),
    "arc_at": (arc_at, f"""{RINGS}, pt AS (SELECT event_id AS point, (user_id % 2 + 1)::INT AS ring, value % 7 AS theta FROM events)
        SELECT point, path AS arc_path FROM pt LEFT JOIN drawn d ON d.ring = pt.ring AND d.s <= theta AND theta < d.e"""),
    "split_texts": (split_texts, "WITH x AS (SELECT doc_id, list_filter(list_transform(regexp_split_to_array(text, '[,;]'), lambda t: trim(t, ' ')), lambda t: t <> '') AS p FROM documents) SELECT doc_id, len(p)::INT AS patterns, md5(array_to_string(p, '|')) AS digest FROM x"),
    "image_parts": (image_parts, f"""WITH k AS (SELECT {[e for group in filters.CATEGORIES.values() for e in group] + ["ico", "", "png.bak"]} AS k), c(label, e) AS (VALUES {", ".join(f"('{label}', '{e}')" for label, group in filters.CATEGORIES.items() for e in group)}),
        x AS (SELECT p_partkey, k[p_partkey % len(k) + 1] AS e FROM part, k)
        SELECT p_partkey, e IN {tuple(filters.IMAGES)} AS image, coalesce((SELECT label FROM c WHERE c.e = x.e), 'Other') AS category FROM x"""),
    "polar_points": (polar_points, """WITH x AS (SELECT vec_id, embedding[1]::DOUBLE * 60 AS x, embedding[2]::DOUBLE * 60 AS y FROM embeddings)
        SELECT vec_id, greatest(floor((sqrt(x * x + y * y) / 15 - 0.24::DOUBLE) / (0.76::DOUBLE / 4)) + 1, 0)::INT AS ring, round(CASE WHEN atan2(x, -y) < 0 THEN atan2(x, -y) + 2 * pi() ELSE atan2(x, -y) END, 6) AS theta FROM x"""),
    "list_panel": (list_panel, f"""{W}, x AS (SELECT path, p, agg_allocated FROM rolled WHERE len(p) = 3 AND p[2] = 'ASIA' UNION ALL SELECT path, p, agg_allocated FROM rolled WHERE starts_with(path, '/r/ASIA/') AND regexp_full_match(lower(p[-1]), 'o.*7'))
        SELECT path, agg_allocated, (row_number() OVER (ORDER BY agg_allocated DESC, p))::INT AS place FROM x"""),
    "copy_on_write": (copy_on_write, "SELECT n_nationkey, n_nationkey % 8 IN (0, 2, 3, 5, 7) AS shares FROM nation"),
    "io_concurrency": (io_concurrency, "SELECT n_nationkey, CASE n_nationkey % 4 WHEN 0 THEN greatest(4, least(16, n_nationkey)) WHEN 1 THEN 1 WHEN 2 THEN 2 ELSE greatest(2, least(8, n_nationkey)) END::INT AS readers FROM nation"),
    "fmt_size_binary": (fmt_size_binary, f"""WITH x AS ({SIZES}), y AS (SELECT o_orderkey, n, CASE WHEN n < 1024 THEN 0 ELSE floor(log2(n) / 10)::INT END AS u FROM x), z AS (SELECT *, n::DOUBLE / pow(1024, u) AS v FROM y)
        SELECT o_orderkey, CASE WHEN u = 0 THEN n || ' B' ELSE CASE WHEN v >= 100 THEN printf('%.0f', v) WHEN v >= 10 THEN printf('%.1f', v) ELSE printf('%.2f', v) END || ' ' || ['KiB', 'MiB', 'GiB', 'TiB', 'PiB', 'EiB'][u] END AS shown FROM z"""),
    "fmt_date": (fmt_date, "WITH x AS (SELECT o_orderkey, epoch(o_orderdate)::BIGINT - CASE WHEN o_orderkey % 9 = 0 THEN 2000000000 ELSE 0 END AS s FROM orders) SELECT o_orderkey, CASE WHEN s <= 0 THEN '—' ELSE strftime(DATE '1970-01-01' + (s // 86400)::INT, '%Y-%m-%d') END AS shown FROM x"),
    "fmt_age": (fmt_age, "WITH x AS (SELECT o_orderkey, o_orderkey % 1000 AS d FROM orders) SELECT o_orderkey, CASE WHEN d = 0 THEN 'today' WHEN d = 1 THEN '1 day' WHEN d < 60 THEN d || ' days' WHEN d < 730 THEN (d // 30) || ' months' ELSE (d // 365) || ' years' END AS shown FROM x"),
    "fmt_digits": (fmt_digits, f"WITH x AS ({SIZES}) SELECT o_orderkey, format('{{:,}}', n) AS shown FROM x"),
    "fmt_duration": (fmt_duration, "WITH x AS (SELECT o_orderkey, o_orderkey * 250 AS ms FROM orders) SELECT o_orderkey, CASE WHEN ms < 1000 THEN ms || ' ms' WHEN ms < 60000 THEN printf('%.1f s', ms / 1000) ELSE printf('%dm %02ds', ms // 60000, ms // 1000 % 60) END AS shown FROM x"),
    "fmt_text": (fmt_text, f"""{W} SELECT path, CASE WHEN length('~/projects' || path) <= 48 THEN '~/projects' || path ELSE '~/…/' || string_split(path, '/')[-2] || '/' || string_split(path, '/')[-1] END AS short, CASE WHEN length(path) <= 20 THEN path ELSE path[1 : 19] || '…' END AS cut, path || '&lt;&amp;&quot;&gt;' AS safe,
        CASE WHEN ino % 2 = 0 THEN '"' || path || ',""' || '"' ELSE path END AS field FROM files"""),
}
