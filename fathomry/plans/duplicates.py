"""Queries of duplicate files and similar images; each with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fathomry.functions.hashing import cosine_hash, full_key, partial_key
from fathomry.operators import dedup, similar
from fathomry.sources import tables as S

T, WIDTH = 4, 64


def stages(spark: SparkSession, sf: str) -> dict[str, DataFrame]:
    return dedup.identical_groups(S.doc_files(spark, sf), partial_key("content", "size", 16), full_key("content"))


def groups(spark: SparkSession, sf: str) -> DataFrame:
    return stages(spark, sf)["full"]


def size_buckets(spark: SparkSession, sf: str) -> DataFrame:
    return dedup.size_groups(S.doc_files(spark, sf)).groupBy("size").agg(F.count("*").alias("files"))


def partial_groups(spark: SparkSession, sf: str) -> DataFrame:
    return stages(spark, sf)["partial"].select("path", "size", "partial")


def full_groups(spark: SparkSession, sf: str) -> DataFrame:
    return groups(spark, sf).select("path", "size", "hash")


def verified_groups(spark: SparkSession, sf: str) -> DataFrame:
    return dedup.verified(groups(spark, sf), S.doc_files(spark, sf)).select("path", "first")


def dup_groups(spark: SparkSession, sf: str) -> DataFrame:
    return dedup.in_order(dedup.group_totals(groups(spark, sf))).select(F.col("group_id").cast("int").alias("group_id"), "size", "hash", "files", "wasted", "first_path")


def dup_total_wasted(spark: SparkSession, sf: str) -> DataFrame:
    return dedup.total_wasted(groups(spark, sf))


def hardlink_twins(spark: SparkSession, sf: str) -> DataFrame:
    return dedup.twin_count(S.doc_files(spark, sf))


def keeper(rule: str, folder: str = ""):  # noqa: ANN201
    def query(spark: SparkSession, sf: str) -> DataFrame:
        return dedup.keep_rule(groups(spark, sf), rule, folder).select("path", "marked")

    return query


def selection_validity(spark: SparkSession, sf: str) -> DataFrame:
    marks = groups(spark, sf).withColumn("marked", F.col("width") > 100)
    return dedup.selection_valid(marks, ["size", "hash"])


def marked_bytes(spark: SparkSession, sf: str) -> DataFrame:
    return dedup.marked_bytes(dedup.keep_rule(groups(spark, sf), "oldest"))


def dup_stats(spark: SparkSession, sf: str) -> DataFrame:
    found = stages(spark, sf)
    return dedup.stage_counts(S.doc_files(spark, sf), {s: found[s] for s in ("size", "partial", "full")})


def dup_digested(spark: SparkSession, sf: str) -> DataFrame:
    """What the digests of each stage have read, as Spark observed it."""
    return stages(spark, sf)["digested"].select("stage", "files", "bytes")


def dup_export_rows(spark: SparkSession, sf: str) -> DataFrame:
    return dedup.export_rows(groups(spark, sf)).withColumn("group_id", F.col("group_id").cast("int"))


def cache(spark: SparkSession, sf: str) -> DataFrame:
    f = S.doc_files(spark, sf).withColumn("n", F.floor((F.col("mtime") - 1_700_000_000) / 86_400))
    return f.select("path", "size", (F.col("mtime") + F.when(F.col("n") % 5 == 0, 1).otherwise(0)).alias("mtime"), "dev", "ino", F.when(F.col("n") % 3 == 0, 32).otherwise(16).cast("long").alias("partial_bytes"), F.md5("path").alias("partial"), F.when(F.col("n") % 2 == 0, F.md5("content")).alias("full"))


def cache_lookup(spark: SparkSession, sf: str) -> DataFrame:
    return dedup.cached(S.doc_files(spark, sf), cache(spark, sf), 16).select("path", "partial", "full")


def cache_prune(spark: SparkSession, sf: str) -> DataFrame:
    seen = S.doc_files(spark, sf).where(F.col("size") % 2 == 0)
    return dedup.cache_prune(cache(spark, sf), ["/docs/en", "/docs/de"], seen).select("path")


def cache_upsert(spark: SparkSession, sf: str) -> DataFrame:
    fresh = S.doc_files(spark, sf).where(F.col("size") % 3 == 0).select("path", "size", "mtime", "dev", "ino", F.lit(16).cast("long").alias("partial_bytes"), F.lit("p").alias("partial"), F.lit(None).cast("string").alias("full"))
    return dedup.cache_upsert(cache(spark, sf), fresh).select("path", "partial", "full")


def after_execution_regroup(spark: SparkSession, sf: str) -> DataFrame:
    all_ = groups(spark, sf)
    removed = all_.where(F.col("width") == 300)
    return dedup.group_totals(dedup.after_removal(all_, removed)).select("size", "hash", "files", "wasted")


def dhash(spark: SparkSession, sf: str) -> DataFrame:
    return S.images(spark, sf).select("path", "dhash", "phash")


def cosine_hashes(spark: SparkSession, sf: str) -> DataFrame:
    """Vectors of 64 components as images of 8 by 8."""
    return S.table(spark, sf, "embeddings").select("vec_id", cosine_hash("embedding", 8).alias("hash"))


def hamming_pairs(spark: SparkSession, sf: str) -> DataFrame:
    images = S.images(spark, sf)
    return similar.close_pairs(images, T, WIDTH).unionByName(similar.copies(images))


def found(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    images = S.images(spark, sf)
    return images, similar.similar_groups(images, T, WIDTH)


def similar_groups(spark: SparkSession, sf: str) -> DataFrame:
    return found(spark, sf)[1].select("path", "root")


def similar_wasted(spark: SparkSession, sf: str) -> DataFrame:
    return similar.similar_totals(*found(spark, sf)).select("root", "files", "size", "wasted", "max_distance")


def image_representatives(spark: SparkSession, sf: str) -> DataFrame:
    images = S.images(spark, sf)
    redundant = images.withColumn("redundant", F.col("path") % 4 == 1)
    return similar.representatives(images, redundant).agg(F.count("*").alias("images"), F.sum("size").alias("bytes"))


def dup_export_all(spark: SparkSession, sf: str) -> DataFrame:
    images, members = found(spark, sf)
    n = F.col("path")
    like = members.join(images.select("path", "size"), "path")
    like = like.select("root", "max_distance", F.concat(F.lit("/images/"), n, F.lit(".png")).alias("path"), "size", (1_700_000_000 + n).alias("mtime"), (n % 5 * 100 + 100).alias("width"), F.lit(100).alias("height"))
    return dedup.export_all(groups(spark, sf), like).drop("group_size").withColumn("group_id", F.col("group_id").cast("int"))


def hash_pass(spark: SparkSession, sf: str) -> DataFrame:
    return dedup.hash_pass_order(groups(spark, sf)).withColumn("place", F.col("place").cast("int"))


W = f"WITH {S.DOCS_SQL} "
CACHE = W + ", c AS (SELECT *, (mtime - 1700000000) // 86400 AS n FROM f)"
KEEP = W + ", k AS (SELECT *, row_number() OVER (PARTITION BY size, hash ORDER BY {order}, p) AS n FROM full_) SELECT path, n > 1 AS marked FROM k"
COMPONENTS = f"""WITH RECURSIVE {S.IMAGES_SQL}, l AS (SELECT a, b FROM edges UNION SELECT b, a FROM edges), c AS (SELECT a AS x, a AS y FROM l UNION SELECT c.x, l.b FROM c JOIN l ON l.a = c.y), g AS (SELECT x AS path, min(y) AS root FROM c GROUP BY x) """

QUERIES = {
    "size_buckets": (size_buckets, f"{W} SELECT size, count(*) AS files FROM sized GROUP BY size"),
    "partial_groups": (partial_groups, f"{W} SELECT path, size, partial FROM halves"),
    "full_groups": (full_groups, f"{W} SELECT path, size, hash FROM full_"),
    "verified_groups": (verified_groups, f"{W} SELECT path, min(path) OVER (PARTITION BY size, content) AS first FROM full_"),
    "dup_groups": (dup_groups, f"{W} SELECT group_id::INT AS group_id, size, hash, files, wasted, '/' || array_to_string(first, '/') AS first_path FROM ordered"),
    "dup_total_wasted": (dup_total_wasted, f"{W} SELECT coalesce(sum(wasted), 0)::BIGINT AS total_wasted, count(*) AS groups FROM totals"),
    "hardlink_twins": (hardlink_twins, f"{W} SELECT count(*) - count(DISTINCT ino) AS twins FROM s1"),
    "keep_oldest": (keeper("oldest"), KEEP.format(order="mtime")),
    "keep_newest": (keeper("newest"), KEEP.format(order="mtime DESC")),
    "keep_shortest": (keeper("shortest"), KEEP.format(order="strlen(path)")),
    "keep_in_folder": (keeper("folder", "/docs/de"), f"""{W}, k AS (SELECT *, row_number() OVER (PARTITION BY size, hash ORDER BY CASE WHEN starts_with(path, '/docs/de/') THEN 0 ELSE 1 END, strlen(path), p) AS n, bool_or(starts_with(path, '/docs/de/')) OVER (PARTITION BY size, hash) AS any_ FROM full_)
        SELECT path, n > 1 AND any_ AS marked FROM k"""),
    "keep_resolution": (keeper("resolution"), KEEP.format(order="width * height DESC")),
    "selection_validity": (selection_validity, f"{W} SELECT size, hash, bool_or(width <= 100) AS valid FROM full_ GROUP BY size, hash"),
    "marked_bytes": (marked_bytes, f"{W} SELECT (sum(files) - count(*))::BIGINT AS files, sum(wasted)::BIGINT AS bytes FROM totals"),
    "dup_stats": (dup_stats, f"{W} SELECT 0 AS step, 'scanned' AS stage, count(*) AS files, sum(size)::BIGINT AS bytes FROM f UNION ALL SELECT 1, 'size', count(*), sum(size)::BIGINT FROM sized UNION ALL SELECT 2, 'partial', count(*), sum(size)::BIGINT FROM halves UNION ALL SELECT 3, 'full', count(*), sum(size)::BIGINT FROM full_"),
    "dup_digested": (dup_digested, f"{W} SELECT 'partial' AS stage, count(*) AS files, sum(least(size, 32))::BIGINT AS bytes FROM sized UNION ALL SELECT 'full', count(*), coalesce(sum(size), 0)::BIGINT FROM halves"),
    "hash_pass": (hash_pass, f"{W} SELECT size, hash, files, (row_number() OVER (ORDER BY size DESC, hash))::INT AS place FROM totals"),
    "dup_export_rows": (dup_export_rows, f"{W} SELECT group_id::INT AS group_id, 'identical' AS kind, hash, wasted AS group_wasted, path, size, mtime FROM full_ JOIN ordered USING (size, hash)"),
    "dup_export_all": (dup_export_all, f"""WITH RECURSIVE {S.DOCS_SQL}, {COMPONENTS.removeprefix("WITH RECURSIVE ")}, far AS (SELECT root, max(distance) AS distance FROM edges JOIN g ON g.path = edges.a GROUP BY root),
        m AS (SELECT root, '/images/' || path || '.png' AS path, size, 1700000000 + path AS mtime, (path % 5 * 100 + 100)::INT AS width FROM g JOIN img USING (path)),
        o AS (SELECT root, sum(size) - max(size) AS wasted, row_number() OVER (ORDER BY sum(size) - max(size) DESC, max(size) DESC, min(path)) AS n FROM m GROUP BY root)
        SELECT group_id::INT AS group_id, 'identical' AS kind, hash, NULL::INT AS distance, wasted::BIGINT AS group_wasted, path, size, mtime, NULL::INT AS width, NULL::INT AS height FROM full_ JOIN ordered USING (size, hash)
        UNION ALL SELECT ((SELECT count(*) FROM ordered) + n)::INT, 'similar', NULL, distance, wasted::BIGINT, path, size, mtime, width, 100 FROM m JOIN o USING (root) JOIN far USING (root)"""),
    "cache_lookup": (cache_lookup, f"{CACHE} SELECT f.path, CASE WHEN n % 3 <> 0 AND n % 5 <> 0 THEN md5(f.path) END AS partial, CASE WHEN n % 5 <> 0 AND n % 2 = 0 THEN md5(content) END AS \"full\" FROM c f"),
    "cache_prune": (cache_prune, "WITH f AS (SELECT '/docs/' || lang || '/' || source || '/' || doc_id || '.txt' AS path, strlen(text) AS size FROM documents) SELECT path FROM f WHERE NOT (starts_with(path, '/docs/en/') OR starts_with(path, '/docs/de/')) OR size % 2 = 0"),
    "cache_upsert": (cache_upsert, f"{CACHE} SELECT path, CASE WHEN size % 3 = 0 THEN 'p' ELSE md5(path) END AS partial, CASE WHEN n % 2 = 0 AND NOT (size % 3 = 0 AND n % 5 = 0) THEN md5(content) END AS \"full\" FROM c"),
    "after_execution_regroup": (after_execution_regroup, f"{W}, g AS (SELECT size, hash, count(*) AS files FROM full_ WHERE width <> 300 GROUP BY size, hash HAVING count(*) >= 2) SELECT size, hash, files, (size * (files - 1))::BIGINT AS wasted FROM g"),
    "perceptual_hashes": (dhash, f"WITH {S.IMAGES_SQL} SELECT path, dhash, phash FROM img"),
    "cosine_hashes": (cosine_hashes, """WITH n AS (SELECT unnest(range(8)) AS k), c AS (SELECT vec_id, i.k * 8 + j.k AS bit, sum(embedding[y.k * 8 + x.k + 1]::DOUBLE * cos(pi() * (2 * y.k + 1) * i.k / 16) * cos(pi() * (2 * x.k + 1) * j.k / 16)) AS v
        FROM embeddings, n i, n j, n x, n y GROUP BY ALL), m AS (SELECT *, avg(v) OVER (PARTITION BY vec_id) AS mean FROM c),
        h AS (SELECT vec_id, sum(CASE WHEN v > mean THEN pow(2, bit)::HUGEINT ELSE 0 END)::HUGEINT AS h FROM m GROUP BY vec_id)
        SELECT vec_id, (CASE WHEN h >= pow(2, 63)::HUGEINT THEN h - pow(2, 64)::HUGEINT ELSE h END)::BIGINT AS hash FROM h"""),
    "hamming_pairs": (hamming_pairs, f"""WITH {S.IMAGES_SQL}, r AS (SELECT path, min(path) OVER (PARTITION BY dhash, phash) AS first FROM img)
        SELECT a, b, distance FROM edges WHERE a IN (SELECT first FROM r) AND (b IN (SELECT first FROM r) OR (distance = 0 AND b IN (SELECT path FROM r WHERE first = edges.a)))"""),
    "similar_groups": (similar_groups, f"{COMPONENTS} SELECT path, root FROM g"),
    "similar_wasted": (similar_wasted, f"{COMPONENTS} SELECT root, count(*) AS files, max(size) AS size, (sum(size) - max(size))::BIGINT AS wasted, any_value(d.distance) AS max_distance FROM g JOIN img USING (path) JOIN (SELECT root, max(distance) AS distance FROM edges JOIN g ON g.path = edges.a GROUP BY root) d USING (root) GROUP BY root"),
    "image_representatives": (image_representatives, f"WITH {S.IMAGES_SQL} SELECT count(*) AS images, sum(size)::BIGINT AS bytes FROM img WHERE path % 4 <> 1"),
}
