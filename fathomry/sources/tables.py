"""The driver's tables seen as file metadata, and the same views as SQL, for the query catalogue and its checks."""

from __future__ import annotations

import atexit
import shutil
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from fathomry.functions import paths as P
from fathomry.functions.hashing import gradient_hash, mean_hash
from fathomry.operators.graph import COMPACT, freed, shared_folder

NOW = 1_009_756_800  # 2001-12-31


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def seconds(column: str):  # noqa: ANN201
    return F.expr(f"timestampdiff(SECOND, timestamp_ntz'1970-01-01 00:00:00', {column})").cast("long")


def blocks(size):  # noqa: ANN001, ANN201
    return (F.floor((size + 4095) / 4096) * 4096).cast("long")


def customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    nation, region = table(spark, sf_dir, "nation"), table(spark, sf_dir, "region")
    places = nation.join(region, nation["n_regionkey"] == region["r_regionkey"])
    c = table(spark, sf_dir, "customer")
    return c.join(places, c["c_nationkey"] == places["n_nationkey"])


#: Lines of a share of a fixture, and shares at most: what one shuffles is gone before the next begins.
LINES, SHARES = 5_000_000, 4
Share = tuple[int, int]


def share_of(rows: DataFrame, key: str, share: Share) -> DataFrame:
    """The rows of one share of all keys."""
    return rows if share[1] == 1 else rows.where(F.pmod(F.xxhash64(key), F.lit(share[1])) == share[0])


def entry_files(spark: SparkSession, sf_dir: str, share: Share = (0, 1)) -> DataFrame:
    """Line items as files /r/region/nation/customer/order/line; supplier and part are device and inode, so links are real; those
    of a share of the parts."""
    line, order = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "orders")
    # Orders meet their customers first, so that lines are shuffled by their order and by their link, and not by customer too.
    homes = order.join(customers(spark, sf_dir), order["o_custkey"] == F.col("c_custkey")).select("o_orderkey", "c_custkey", "n_name", "r_name")
    line = share_of(line, "l_partkey", share)
    rows = line.join(homes, line["l_orderkey"] == homes["o_orderkey"])
    link = Window.partitionBy("l_suppkey", "l_partkey")
    path = F.concat(F.lit("/r/"), "r_name", F.lit("/"), "n_name", F.lit("/c"), "c_custkey", F.lit("/o"), "o_orderkey", F.lit("/l"), "l_linenumber", F.lit("_"), "l_partkey", F.lit("_"), "l_suppkey")
    apparent = F.min("l_quantity").over(link).cast("long") * 1000
    rows = rows.select(path.alias("path"), F.lit("File").alias("kind"), apparent.alias("apparent"), F.count("*").over(link).alias("nlink"), F.col("l_suppkey").alias("dev"), F.col("l_partkey").alias("ino"), seconds("l_shipdate").alias("mtime"))
    return rows.withColumn("allocated", blocks(F.col("apparent")))


_made: dict[tuple[str, str, str], str] = {}


def once(spark: SparkSession, sf_dir: str, name: str, build: Callable[[Share], DataFrame]) -> DataFrame:
    """A fixture, written on first use in the application and read as Parquet from then on, as a scan's result would be."""
    key = (spark.sparkContext.applicationId, sf_dir, name)
    df = build((0, 1))
    if key not in _made:
        path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
        shares = min(SHARES, 1 + table(spark, sf_dir, "lineitem").count() // LINES)
        for i in range(shares):
            with freed(spark):
                build((i, shares)).write.mode("append").options(**COMPACT).parquet(path)
        _made[key] = path
        if "://" not in path or path.startswith("file://"):
            atexit.register(shutil.rmtree, path.removeprefix("file://"), ignore_errors=True)
    out = spark.read.schema(df.schema).parquet(_made[key])
    out._fathomry_path = _made[key]
    return out


def entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return once(spark, sf_dir, "entries", lambda share: built_entries(spark, sf_dir, share))


def dev_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return once(spark, sf_dir, "dev-entries", lambda share: built_dev_entries(spark, sf_dir, share))


def built_entries(spark: SparkSession, sf_dir: str, share: Share = (0, 1)) -> DataFrame:
    """The files and, with the first share, the directories above all of them."""
    files = entry_files(spark, sf_dir, share)
    if share[0]:
        return files
    orders = table(spark, sf_dir, "orders").join(customers(spark, sf_dir), F.col("o_custkey") == F.col("c_custkey"))
    used = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("o_orderkey")).distinct()
    leaf = orders.join(used, "o_orderkey", "left_semi").select(F.concat(F.lit("/r/"), "r_name", F.lit("/"), "n_name", F.lit("/c"), "c_custkey", F.lit("/o"), "o_orderkey").alias("p"))
    dirs = leaf.select(F.explode(P.prefixes("p", 1)).alias("path")).distinct()
    none = lambda kind: F.lit(None).cast(kind)
    dirs = dirs.select("path", F.lit("Dir").alias("kind"), F.lit(0).cast("long").alias("apparent"), F.lit(1).cast("long").alias("nlink"), none("long").alias("dev"), none("long").alias("ino"), F.lit(0).cast("long").alias("mtime"), F.lit(0).cast("long").alias("allocated"))
    return files.unionByName(dirs)


ENTRIES_SQL = """
files AS (
  SELECT '/r/' || r_name || '/' || n_name || '/c' || c_custkey || '/o' || o_orderkey || '/l' || l_linenumber || '_' || l_partkey || '_' || l_suppkey AS path,
    'File' AS kind, (min(l_quantity) OVER w)::BIGINT * 1000 AS apparent, (count(*) OVER w)::BIGINT AS nlink, l_suppkey AS dev, l_partkey AS ino, epoch(l_shipdate)::BIGINT AS mtime
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
  WINDOW w AS (PARTITION BY l_suppkey, l_partkey)
),
dirs AS (
  SELECT DISTINCT '/' || array_to_string(p[1 : i], '/') AS path FROM (SELECT p, unnest(range(1, len(p))) AS i FROM (SELECT string_split(path[2 :], '/') AS p FROM files))
),
entries AS MATERIALIZED (
  SELECT path, kind, apparent, ((apparent + 4095) // 4096) * 4096 AS allocated, nlink, dev, ino, mtime, string_split(path[2 :], '/') AS p FROM files
  UNION ALL SELECT path, 'Dir', 0, 0, 1, NULL, NULL, 0, string_split(path[2 :], '/') FROM dirs
),
marked AS (
  SELECT *, nlink > 1 AND ino IS NOT NULL AS hardlinked, nlink > 1 AND ino IS NOT NULL AND row_number() OVER (PARTITION BY dev, ino ORDER BY p) > 1 AS hardlink_dup FROM entries
),
sums AS (
  SELECT '/' || array_to_string(p[1 : i], '/') AS path, sum(CASE WHEN hardlink_dup THEN 0 ELSE apparent END)::BIGINT AS agg_apparent,
    sum(CASE WHEN hardlink_dup THEN 0 ELSE allocated END)::BIGINT AS agg_allocated, count(*)::BIGINT AS items
  FROM (SELECT p, apparent, allocated, hardlink_dup, unnest(range(1, len(p))) AS i FROM marked) GROUP BY ALL
),
rolled AS (
  SELECT m.path, m.p, m.kind, m.apparent, m.allocated, m.mtime, m.hardlink_dup,
    CASE WHEN m.kind = 'Dir' THEN coalesce(s.agg_apparent, 0) ELSE m.apparent END AS agg_apparent,
    CASE WHEN m.kind = 'Dir' THEN coalesce(s.agg_allocated, 0) ELSE m.allocated END AS agg_allocated, coalesce(s.items, 0) AS items
  FROM marked m LEFT JOIN sums s USING (path)
)
"""


def doc_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as files /docs/lang/source/id.txt with their text as content; every seventh id shares its inode with its
    neighbour."""
    d = table(spark, sf_dir, "documents")
    path = F.concat(F.lit("/docs/"), "lang", F.lit("/"), "source", F.lit("/"), "doc_id", F.lit(".txt"))
    return d.select(
        path.alias("path"), F.octet_length("text").cast("long").alias("size"), (1_700_000_000 + (F.col("doc_id") * 86400) % (400 * 86400)).alias("mtime"),
        F.lit(1).cast("long").alias("dev"), F.when(F.col("doc_id") % 7 == 0, F.col("doc_id") + 1).otherwise(F.col("doc_id")).alias("ino"), F.col("text").alias("content"),
        (F.col("doc_id") % 5 * 100 + 100).cast("int").alias("width"), F.lit(100).alias("height"),
    )


DOCS_SQL = """
f AS (
  SELECT '/docs/' || lang || '/' || source || '/' || doc_id || '.txt' AS path, strlen(text)::BIGINT AS size, 1700000000 + (doc_id * 86400) % (400 * 86400) AS mtime, 1 AS dev,
    CASE WHEN doc_id % 7 = 0 THEN doc_id + 1 ELSE doc_id END AS ino, text AS content, (doc_id % 5 * 100 + 100)::INT AS width, 100 AS height
  FROM documents
),
fp AS (SELECT *, string_split(path[2 :], '/') AS p FROM f),
s1 AS (SELECT * FROM fp WHERE size IN (SELECT size FROM fp GROUP BY size HAVING count(*) >= 2)),
s2 AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY dev, ino ORDER BY p) AS k FROM s1) WHERE k = 1),
sized AS (SELECT * EXCLUDE k FROM s2 WHERE size IN (SELECT size FROM s2 GROUP BY size HAVING count(*) >= 2)),
halves0 AS (SELECT *, md5(size || ':' || CASE WHEN size <= 32 THEN content ELSE content[1 : 16] || content[-16 :] END) AS partial FROM sized),
halves AS (SELECT * FROM halves0 WHERE (size, partial) IN (SELECT (size, partial) FROM halves0 GROUP BY size, partial HAVING count(*) >= 2)),
full0 AS (SELECT *, sha256(content) AS hash FROM halves),
full_ AS (SELECT * FROM full0 WHERE (size, hash) IN (SELECT (size, hash) FROM full0 GROUP BY size, hash HAVING count(*) >= 2)),
totals AS (SELECT size, hash, count(*)::BIGINT AS files, (size * (count(*) - 1))::BIGINT AS wasted, min(p) AS first FROM full_ GROUP BY size, hash),
ordered AS (SELECT *, row_number() OVER (ORDER BY wasted DESC, size DESC, first) AS group_id FROM totals)
"""


def images(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors as images with 64-bit gradient and mean hashes over all components; every third has a near copy, whose hashes
    differ in the lowest bits, and every sixth a copy of that copy, with three more bits changed."""
    e = table(spark, sf_dir, "embeddings")
    all_ = e.select(F.col("vec_id").alias("path"), (1000 + F.col("vec_id")).alias("size"), gradient_hash("embedding").alias("dhash"), mean_hash("embedding").alias("phash"), F.col("label"))
    low = lambda n: (F.pow(F.lit(2.0), F.col("path") % n).cast("bigint") - 1)
    near = all_.where(F.col("path") % 3 == 0).select((F.col("path") + 1_000_000).alias("path"), (F.col("size") + 1).alias("size"), F.col("dhash").bitwiseXOR(low(7)).alias("dhash"), F.col("phash").bitwiseXOR(low(5)).alias("phash"), "label")
    far = near.where(F.col("path") % 2 == 0).select((F.col("path") + 1_000_000).alias("path"), (F.col("size") + 1).alias("size"), F.col("dhash").bitwiseXOR(F.lit(7 << 20).cast("bigint")).alias("dhash"), "phash", "label")
    return all_.unionByName(near).unionByName(far)


IMAGES_SQL = """
img0 AS (
  SELECT vec_id AS path, 1000 + vec_id AS size, label,
    list_sum(list_transform(range(1, 64), lambda i: CASE WHEN embedding[i] < embedding[i + 1] THEN 1::BIGINT << (i - 1)::INT ELSE 0 END))::BIGINT AS dhash,
    list_sum(list_transform(range(1, 65), lambda i: CASE WHEN embedding[i]::DOUBLE > list_reduce(list_transform(embedding[1 : 64], lambda x: x::DOUBLE), lambda a, b: a + b) / 64 THEN CASE WHEN i = 64 THEN (-9223372036854775808)::BIGINT ELSE 1::BIGINT << least(i - 1, 62)::INT END ELSE 0 END))::BIGINT AS phash
  FROM embeddings
),
img1 AS (SELECT path + 1000000 AS path, size + 1 AS size, label, xor(dhash, (1::BIGINT << (path % 7)::INT) - 1) AS dhash, xor(phash, (1::BIGINT << (path % 5)::INT) - 1) AS phash FROM img0 WHERE path % 3 = 0),
img AS (
  SELECT path, size, label, dhash, phash FROM img0 UNION ALL SELECT path, size, label, dhash, phash FROM img1
  UNION ALL SELECT path + 1000000, size + 1, label, xor(dhash, (7 << 20)::BIGINT), phash FROM img1 WHERE path % 2 = 0
),
edges AS (
  SELECT a.path AS a, b.path AS b, greatest(bit_count(xor(a.dhash, b.dhash)), bit_count(xor(a.phash, b.phash)))::INT AS distance
  FROM img a JOIN img b ON a.path < b.path AND bit_count(xor(a.dhash, b.dhash)) <= 4 AND bit_count(xor(a.phash, b.phash)) <= 4
)
"""


def built_dev_entries(spark: SparkSession, sf_dir: str, share: Share = (0, 1)) -> DataFrame:
    """Orders as project directories of many kinds, their line items as files in build directories or sources; of a share of the
    orders, the first with the directories of customers."""
    # All of an order is made in the task that holds it: lines and orders meet by number, and only numbers are shuffled.
    every = table(spark, sf_dir, "orders")
    o, line = share_of(every, "o_orderkey", share), share_of(table(spark, sf_dir, "lineitem"), "l_orderkey", share)
    key, customer = F.col("o_orderkey"), F.concat(F.lit("/w/c"), F.col("o_custkey"))
    home = F.concat(customer, F.lit("/o"), key)
    name = lambda c, names: F.element_at(F.array(*map(F.lit, names)), (c % len(names) + 1).cast("int"))
    file = lambda path, n, mtime: F.struct(path.alias("path"), F.lit("File").alias("kind"), n.cast("long").alias("n"), mtime.cast("long").alias("mtime"))
    folder = lambda path: F.struct(path.alias("path"), F.lit("Dir").alias("kind"), F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("mtime"))
    at = lambda rest: F.concat(home, F.lit("/"), rest if isinstance(rest, Column) else F.lit(rest))
    # Lines and orders are sorted and merged even where a side is small: an order is together then, and shuffled no more.
    base = o.select("o_orderkey", "o_custkey", seconds("o_orderdate").alias("mtime")).repartition("o_orderkey").distinct()
    leaf = line.select("l_orderkey", F.col("l_linenumber").cast("long").alias("l"), F.col("l_partkey").alias("p"), F.col("l_suppkey").alias("s"), F.col("l_quantity").cast("int").alias("n"), seconds("l_shipdate").alias("day"))
    leaf = leaf.withColumn("folder", F.when(F.col("p").isNotNull() & F.col("s").isNotNull(), name(F.col("l"), ["target", "node_modules", "build", "__pycache__", "src"])))
    rows = base.hint("merge").join(leaf, base["o_orderkey"] == leaf["l_orderkey"], "left").drop("l_orderkey").distinct()
    # What is the first of an order, of one of its times and of a folder; an order of several times has its lines with the first.
    by = Window.partitionBy("o_orderkey", "o_custkey").orderBy("mtime", "folder")
    first = F.row_number().over(by) == 1
    rows = rows.withColumns({
        "first": first, "again": first | ~F.col("mtime").eqNullSafe(F.lag("mtime").over(by)), "opens": first | ~F.col("folder").eqNullSafe(F.lag("folder").over(by)),
        "lines": F.col("mtime").eqNullSafe(F.first("mtime").over(by.rowsBetween(Window.unboundedPreceding, Window.currentRow))) & F.col("folder").isNotNull(),
    })
    own = [
        *(F.when(F.col("again") & test, file(at(path), F.lit(n), F.col("mtime"))) for test, path, n in (
            (F.lit(True), name(key, ["Cargo.toml", "package.json", "pyproject.toml", "CMakeLists.txt", "README", "main.py"]), 10), (key % 12 == 1, "yarn.lock", 10), (key % 11 == 0, "build/.git/HEAD", 20), (key % 13 == 0, "env/pyvenv.cfg", 30),
        )),
        *(F.when(F.col("first") & test, folder(path)) for test, path in ((F.lit(True), home), (key % 11 == 0, at("build")), (key % 11 == 0, at("build/.git")), (key % 13 == 0, at("env")))),
        # ``build`` of an order with a repository is there already.
        F.when(F.col("lines") & F.col("opens") & ~((F.col("folder") == "build") & (key % 11 == 0)), folder(at(F.col("folder")))),
        F.when(F.col("lines"), file(at(F.concat("folder", F.lit("/l"), "l", F.lit("_"), "p", F.lit("_"), "s")), F.col("n"), F.col("day"))),
    ]
    # What is not there becomes a row without a path, which goes below: leaving it out of the array would take a lambda.
    rows = rows.select(F.inline(F.array(*own)))
    of_all = every.where(F.lit(share[0] == 0)).where("o_custkey is not null and (o_orderkey is not null or o_custkey % 3 = 0)").select("o_custkey").distinct()
    tops = F.array(folder(customer), F.when(F.col("o_custkey") % 3 == 0, file(F.concat(customer, F.lit("/package.json")), F.lit(10), F.lit(0))))
    rows = rows.unionByName(of_all.select(F.inline(tops))).unionByName(of_all.limit(1).select(F.inline(F.array(folder(F.lit("/w"))))))
    none = F.lit(None).cast("long")
    return rows.where("path is not null").select(
        "path", "kind", (F.col("n") * 100).alias("apparent"), F.when(F.col("kind") == "Dir", F.lit(4096)).otherwise(F.col("n") * 512).cast("long").alias("allocated"),
        F.lit(1).cast("long").alias("nlink"), none.alias("dev"), none.alias("ino"), "mtime",
    )


def staged_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every seventh customer's directory, then every fiftieth order's files, staged in order of their numbers."""
    rows = entries(spark, sf_dir)
    number = lambda at, letter: F.regexp_extract(F.coalesce(F.get(P.parts("path"), F.lit(at)), F.lit("")), f"^{letter}([0-9]+)$", 1)
    customer, order = F.try_to_number(number(3, "c"), F.lit("999999999999")), F.try_to_number(number(4, "o"), F.lit("999999999999"))
    chosen = rows.where(((P.depth("path") == 4) & (customer % 7 == 0)) | ((F.col("kind") == "File") & (order % 50 == 0)))
    # A line's number, part and supplier are below 10, 100,000 and 10,000.
    line = [F.expr(f"try_cast(regexp_extract(path, '/l([0-9]+)_([0-9]+)_([0-9]+)$', {i}) AS bigint)") for i in (1, 2, 3)]
    seq = F.when(F.col("kind") == "Dir", customer.cast("long")).otherwise(((order.cast("long") * 10 + line[0]) * 100_000 + line[1]) * 10_000 + line[2])
    return chosen.select(
        seq.alias("seq"), "path", "kind", F.when(F.col("kind") == "Dir", 4096).otherwise(F.col("allocated")).cast("long").alias("allocated"), "apparent", "mtime", F.lit(0).alias("mtime_nanos"), "dev", "ino", "nlink",
        F.when(F.col("kind") == "Dir", 5).otherwise(1).cast("long").alias("entry_count"), F.when(F.col("kind") == "Dir", "map").otherwise("duplicates").alias("source"), F.lit("").alias("reason"), F.lit(NOW).cast("long").alias("staged_at"),
    )


STAGED_SQL = (
    ENTRIES_SQL
    + """,
staged AS MATERIALIZED (
  SELECT CASE WHEN kind = 'Dir' THEN try_cast(p[4][2 :] AS BIGINT) ELSE ((try_cast(p[5][2 :] AS BIGINT) * 10 + try_cast(string_split(p[6][2 :], '_')[1] AS BIGINT)) * 100000 + try_cast(string_split(p[6], '_')[2] AS BIGINT)) * 10000 + try_cast(string_split(p[6], '_')[3] AS BIGINT) END AS seq, path, p, kind, (CASE WHEN kind = 'Dir' THEN 4096 ELSE allocated END)::BIGINT AS allocated, apparent, mtime, 0 AS mtime_nanos, dev, ino, nlink,
    (CASE WHEN kind = 'Dir' THEN 5 ELSE 1 END)::BIGINT AS entry_count, CASE WHEN kind = 'Dir' THEN 'map' ELSE 'duplicates' END AS source
  FROM entries
  WHERE (len(p) = 4 AND regexp_extract(p[4], '^c([0-9]+)$', 1)::BIGINT % 7 = 0) OR (kind = 'File' AND regexp_extract(p[5], '^o([0-9]+)$', 1)::BIGINT % 50 = 0)
),
above AS (SELECT DISTINCT seq FROM (SELECT seq, '/' || array_to_string(p[1 : i], '/') AS a FROM (SELECT seq, p, unnest(range(1, len(p))) AS i FROM staged)) JOIN (SELECT path AS a FROM staged) USING (a)),
tops AS (SELECT s.*, s.seq NOT IN (SELECT seq FROM above) AS top FROM staged s),
groups AS (SELECT dev, ino, count(*) AS n, arg_min(nlink, seq) AS links, arg_min(allocated, seq) AS bytes, max(seq) AS last FROM tops WHERE top AND kind <> 'Dir' AND nlink > 1 AND ino IS NOT NULL GROUP BY dev, ino),
expect AS (
  SELECT t.seq, (CASE WHEN NOT t.top THEN 0 WHEN t.kind <> 'Dir' AND t.nlink > 1 AND t.ino IS NOT NULL THEN CASE WHEN g.n >= g.links AND g.last = t.seq THEN g.bytes ELSE 0 END ELSE t.allocated END)::BIGINT AS expected
  FROM tops t LEFT JOIN groups g ON t.dev = g.dev AND t.ino = g.ino
),
present AS MATERIALIZED (
  SELECT path, CASE WHEN seq % 17 = 3 THEN 'Symlink' ELSE kind END AS kind, CASE WHEN seq % 5 = 2 THEN apparent + 1 ELSE apparent END AS apparent, allocated, CASE WHEN seq % 7 = 4 THEN mtime + 60 ELSE mtime END AS mtime,
    mtime_nanos, dev, CASE WHEN seq % 19 = 5 THEN ino + 1 ELSE ino END AS ino, nlink, CASE WHEN seq % 4 = 1 THEN entry_count + 3 ELSE entry_count END AS entry_count
  FROM staged WHERE seq % 13 <> 6
),
checked AS MATERIALIZED (
  SELECT s.*, CASE
    WHEN c.path IS NULL THEN 'no longer exists'
    WHEN s.kind <> c.kind THEN 'kind changed from ' || s.kind || ' to ' || c.kind
    WHEN s.dev IS NOT NULL AND c.dev IS NOT NULL AND (s.dev <> c.dev OR s.ino <> c.ino) THEN 'replaced by a different file'
    WHEN c.kind = 'Dir' AND c.entry_count > s.entry_count + 1 THEN 'directory grew from ' || s.entry_count || ' to ' || c.entry_count || ' entries'
    WHEN c.kind <> 'Dir' AND s.apparent <> c.apparent THEN 'size changed from ' || s.apparent || ' to ' || c.apparent
    WHEN c.kind <> 'Dir' AND (s.mtime <> c.mtime OR s.mtime_nanos <> c.mtime_nanos) THEN 'modified (mtime ' || s.mtime || ' to ' || c.mtime || ')' END AS problem,
    c.kind AS now_kind, c.nlink AS now_nlink, c.allocated AS now_allocated
  FROM staged s LEFT JOIN present c USING (path)
),
plan AS (
  SELECT c.*, CASE WHEN c.p[2] = 'EUROPE' THEN 'Protected' WHEN problem IS NOT NULL THEN 'Skipped' ELSE 'Planned' END AS outcome FROM checked c
)
"""
)


def present(staged: DataFrame) -> DataFrame:
    """The staged items as they are now: some gone, some changed in each of the ways that revalidation tells."""
    s = F.col("seq")
    return staged.where(s % 13 != 6).withColumns({
        "kind": F.when(s % 17 == 3, "Symlink").otherwise(F.col("kind")), "apparent": F.when(s % 5 == 2, F.col("apparent") + 1).otherwise(F.col("apparent")), "mtime": F.when(s % 7 == 4, F.col("mtime") + 60).otherwise(F.col("mtime")),
        "ino": F.when(s % 19 == 5, F.col("ino") + 1).otherwise(F.col("ino")), "entry_count": F.when(s % 4 == 1, F.col("entry_count") + 3).otherwise(F.col("entry_count")),
    })


def journal(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as journal records."""
    e = table(spark, sf_dir, "events")
    kind = F.when(F.col("event_id") % 3 == 0, "quarantine").otherwise(F.col("event_type"))
    return e.select(
        seconds("ts").alias("timestamp"), kind.alias("operation"), F.concat(F.lit("/ev/"), "event_type", F.lit("/u"), F.col("user_id"), F.lit("/e"), F.col("event_id")).alias("path"),
        F.when(F.col("event_id") % 3 == 0, F.concat(F.lit("/vol/"), F.when(F.col("event_id") % 2 == 0, ".fathomry-quarantine").otherwise("elsewhere"), F.lit("/s/"), F.col("event_id"))).alias("destination"),
        F.floor(F.col("value") * 100).cast("long").alias("size"), F.when(F.col("event_id") % 10 == 0, "failed").otherwise("ok").alias("result"), F.lit(None).cast("string").alias("error"), F.col("event_id").alias("line"),
    )


JOURNAL_SQL = """
j AS (
  SELECT epoch(ts)::BIGINT AS timestamp, CASE WHEN event_id % 3 = 0 THEN 'quarantine' ELSE event_type END AS operation, '/ev/' || event_type || '/u' || user_id || '/e' || event_id AS path,
    CASE WHEN event_id % 3 = 0 THEN '/vol/' || CASE WHEN event_id % 2 = 0 THEN '.fathomry-quarantine' ELSE 'elsewhere' END || '/s/' || event_id END AS destination,
    floor(value * 100)::BIGINT AS size, CASE WHEN event_id % 10 = 0 THEN 'failed' ELSE 'ok' END AS result, event_id AS line
  FROM events
)
"""
