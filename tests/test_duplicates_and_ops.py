"""Duplicate groups, rules, projects, drawer, revalidation, journal, settings, command line."""

import io
import random

import pytest
from pyspark.sql import functions as F

from fathomry import cli, settings
from fathomry.functions.hashing import full_key, partial_key
from fathomry.operators import dedup, buildtrees, ops, similar
from fathomry.sources import files
from fathomry.sources.rules import builtin, from_toml, to_toml

STAGED = "seq long, path string, kind string, allocated long, apparent long, mtime long, mtime_nanos int, dev long, ino long, nlink long, entry_count long, source string, reason string, staged_at long"


def staged(spark, rows):
    return spark.createDataFrame([(i, p, k, a, a, 0, 0, 1 if ino else None, ino, n, 1, "map", "", 0) for i, (p, k, a, ino, n) in enumerate(rows)], STAGED)


def test_duplicate_groups(spark):
    a, b = "x" * 5000, "y" * 200_000
    rows = [("/s1", a, 1), ("/s2", a, 2), ("/s3", a, 3), ("/b1", b, 4), ("/sub/b2", b, 5), ("/u", "z" * 5000, 6), ("/twin", a, 3), ("/mid", b[:100_000] + "z" + b[100_001:], 7)]
    df = spark.createDataFrame([(p, len(c), 0, 1, i, c) for p, c, i in rows], "path string, size long, mtime long, dev long, ino long, content string")
    found = dedup.identical_groups(df, partial_key("content", "size"), full_key("content"))
    assert found["partial"].where("path = '/mid'").count() == 1 and found["full"].where("path = '/mid'").count() == 0
    totals = dedup.in_order(dedup.group_totals(found["full"])).orderBy("group_id").collect()
    assert [(r["files"], r["wasted"], r["first_path"]) for r in totals] == [(2, 200_000, "/b1"), (3, 10_000, "/s1")]
    assert dedup.twin_count(df).first()["twins"] == 1
    assert dedup.verified(found["full"], df).count() == 5
    kept = dedup.keep_rule(found["full"], "shortest").where("not marked").select("path").collect()
    assert sorted(r["path"] for r in kept) == ["/b1", "/s1"]
    assert dedup.keep_rule(found["full"], "folder", "/none").where("marked").isEmpty()


def test_cache_lookup(spark):
    file = spark.createDataFrame([("/f", 10, 5, 1, 2)], "path string, size long, mtime long, dev long, ino long")
    row = ("/f", 10, 5, 1, 2, 16, "p", "full")
    schema = "path string, size long, mtime long, dev long, ino long, partial_bytes long, partial string, full string"
    hit = lambda window, r=row: tuple(dedup.cached(file, spark.createDataFrame([r], schema), window).first()[["partial", "full"]] if False else dedup.cached(file, spark.createDataFrame([r], schema), window).select("partial", "full").first())
    assert hit(16) == ("p", "full") and hit(32) == (None, "full") and hit(16, ("/f", 10, 6, 1, 2, 16, "p", "full")) == (None, None)


def test_saved_cache(spark, tmp_path):
    path = str(tmp_path / "cache")
    schema = "path string, size long, mtime long, dev long, ino long, partial_bytes long, partial string, full string"
    files.save_cache(spark.createDataFrame([("/f", 1, 1, 1, 1, 16, "p", "f")], schema), path)
    assert files.read_cache(spark, path).count() == 1
    spark.createDataFrame([(99, "x")], "version int, checksum string").write.mode("overwrite").parquet(f"{path}/header")
    assert files.read_cache(spark, path).count() == 0 and files.read_cache(spark, str(tmp_path / "none")).count() == 0


def test_banded_join_is_exact(spark):
    rng = random.Random(4)
    keys = [rng.getrandbits(62) for _ in range(8)]
    keys += [k ^ sum(1 << rng.randrange(62) for _ in range(rng.randrange(6))) for k in keys for _ in range(5)]
    rows = [(i, k, k ^ 5) for i, k in enumerate(keys)]
    df = spark.createDataFrame(rows, "path long, dhash long, phash long")
    got = {(r["a"], r["b"]) for r in similar.close_pairs(df, 6).unionByName(similar.copies(df)).collect()}
    want = {(i, j) for i, a, _ in rows for j, b, _ in rows if i < j and (a ^ b).bit_count() <= 6}
    first = {k: min(i for i, x, _ in rows if x == k) for k in keys}
    assert got == {(i, j) for i, j in want if first[keys[i]] == i and (first[keys[j]] == j or keys[i] == keys[j])}


def test_projects(spark):
    paths = ["/p/Cargo.toml", "/p/target/debug/bin", "/p/build/keep.txt", "/l/build/o.o", "/n/package.json", "/n/node_modules/x/package.json", "/s/tool.py", "/s/__pycache__/t.pyc", "/o/__pycache__/t.pyc", "/c/CMakeLists.txt", "/c/build/v/.git/HEAD", "/c/build/v/Cargo.toml"]
    dirs = sorted({"/" + "/".join(p.split("/")[1:i]) for p in paths for i in range(2, len(p.split("/")))})
    rows = [(p, "File", 512, 1) for p in paths] + [(d, "Dir", 0, 1) for d in dirs]
    df = spark.createDataFrame([(p, k, a, a, 1, None, None, m) for p, k, a, m in rows], "path string, kind string, apparent long, allocated long, nlink long, dev long, ino long, mtime long")
    found = buildtrees.analyze(df, builtin())
    artifacts = {r["path"]: (r["project_path"], r["risk"]) for r in found["artifacts"].collect()}
    assert artifacts == {"/p/target": ("/p", "Safe"), "/n/node_modules": ("/n", "Caution"), "/s/__pycache__": ("/s", "Safe")}
    projects = {r["path"]: r["types"] for r in found["projects"].collect()}
    assert projects == {"/p": ["Rust"], "/n": ["Node.js"], "/s": ["Python"], "/c": ["CMake"], "/c/build/v": ["Rust"]}
    assert from_toml(to_toml(builtin()))[0] == builtin()


def test_drawer(spark):
    nested = staged(spark, [("/a/b/c", "File", 10, 0, 1), ("/a/b/d", "File", 20, 0, 1), ("/a/x", "File", 5, 0, 1), ("/a/b", "Dir", 100, 0, 1), ("/a/bc", "File", 1, 0, 1)])
    assert {r["path"] for r in ops.top_level(nested).collect()} == {"/a/b", "/a/x", "/a/bc"}
    assert ops.reclaimable(nested).first()["reclaimable"] == 106
    links = staged(spark, [("/a", "File", 100, 7, 2), ("/b", "File", 100, 7, 2), ("/c", "File", 50, 8, 3)])
    assert ops.reclaimable(links).first()["reclaimable"] == 100
    assert [r["expected"] for r in ops.expected_bytes(links).orderBy("seq").collect()] == [0, 100, 0]
    outcome = ops.stage_outcomes(staged(spark, [("/usr/x", "File", 1, 0, 1), ("/a/b", "Dir", 1, 0, 1), ("/a/b/c", "File", 1, 0, 1), ("/a/b", "Dir", 1, 0, 1)]), [], ["/usr"])
    assert [r["outcome"] for r in outcome.orderBy("seq").collect()] == ["Protected", "Staged", "Covered", "AlreadyStaged"]


def test_revalidation(spark):
    item = staged(spark, [("/f", "File", 10, 3, 1), ("/gone", "File", 10, 0, 1), ("/d", "Dir", 10, 0, 1)])
    now = item.where("path <> '/gone'").withColumns({"apparent": F.when(F.col("path") == "/f", 11).otherwise(F.col("apparent")), "entry_count": F.lit(2).cast("long")})
    found = {r["path"]: r["problem"] for r in ops.revalidate(item, now, 0).collect()}
    assert found == {"/f": "size changed from 10 to 11", "/gone": "no longer exists", "/d": "directory grew from 1 to 2 entries"}
    assert ops.revalidate(item, now, 1).where("path = '/d'").first()["problem"] is None
    plan = ops.exec_plan(item, item, [], [])
    assert ops.report(plan).first().asDict() == {"succeeded": 3, "skipped": 0, "failed": 0, "bytes": 30}


def test_quarantine(spark):
    row = spark.range(1).select(ops.quarantine_destination(F.lit("/vol"), "S", F.lit("/vol/a/b")), ops.quarantine_destination(F.lit("/q"), "S", F.lit("/x/../y"))).first()
    assert list(row) == ["/vol/.fathomry-quarantine/S/a/b", "/q/.fathomry-quarantine/S/x/y"]


def test_journal(spark, tmp_path):
    path = str(tmp_path / "j")
    assert files.read_journal(spark, path).count() == 0
    files.append_journal(spark.createDataFrame([(1, "delete", "/a", None, 5, "ok", None)], "timestamp long, operation string, path string, destination string, size long, result string, error string"), path)
    (tmp_path / "j/torn.json").write_text('{"timestamp": 2, "opera')
    assert files.read_journal(spark, path).count() == 1


def test_settings(tmp_path):
    path = str(tmp_path / "s.toml")
    assert settings.load(path) == (settings.Settings(), None)
    settings.save(settings.Settings(rings=3, pinned=("/a",)), path)
    assert settings.load(path)[0] == settings.Settings(rings=3, pinned=("/a",))
    (tmp_path / "s.toml").write_text("rings = 99")
    assert settings.load(path)[0].rings == 10
    (tmp_path / "s.toml").write_text("rings = ")
    assert settings.load(path)[1]


@pytest.mark.parametrize("argv", [["scan"], ["scan", "--json"], ["scan", "--csv"], ["dup", "--min-size", "1"], ["dev"], ["delete"]])
def test_command_line(spark, tmp_path, argv):
    (tmp_path / "p").mkdir()
    for name in ("x", "y"):
        (tmp_path / "p" / name).write_text("same")
    out = io.StringIO()
    assert cli.run([argv[0], str(tmp_path / "p"), *argv[1:]], spark, out) == 0 and out.getvalue()
    assert (tmp_path / "p/x").exists()
