"""What only large keys and large tables bring up."""

import os
from pathlib import Path

from pyspark.sql import functions as F

from fathomry.functions import paths as P
from fathomry.functions.formats import exact_size
from fathomry.operators import buildtrees, ops, screen, tree
from fathomry.operators.graph import shared_folder, staged
from fathomry.plans import buildtrees as dev
from fathomry.plans import space
from fathomry.sources import tables
from fathomry.sources.rules import builtin
from fathomry.streaming.projects import ENTRY, LiveProjects

KEYS = [7, 599_999, 740_024, 899_999, 8_999_999, 899_999_999]


def test_sizes_beyond_a_bigint(spark, tmp_path):
    spark.createDataFrame([(k,) for k in KEYS], "o_orderkey long").write.parquet(f"{tmp_path}/orders.parquet")
    n = {k: k * k * 2 ** (k % 25) for k in KEYS}
    assert max(n.values()) > 1 << 63
    assert {r[0]: r[1] for r in space.fmt_digits(spark, str(tmp_path)).collect()} == {k: f"{n[k]:,}" for k in KEYS}
    shown = {r[0]: r[1] for r in space.fmt_size_binary(spark, str(tmp_path)).collect()}
    assert shown == {k: exact_size(n[k]) for k in KEYS}


def test_analysis_copies_no_table_and_sends_no_foreign_ancestors(spark, tmp_path):
    rows = [(f"/w/p{i}/{'target' if i % 50 == 0 else 'x'}/{hash((i, j)) % 10**12}", "File", 1, 512, 1, None, None, 9) for i in range(400) for j in range(40)]
    rows += [(f"/w/p{i}/Cargo.toml", "File", 1, 512, 1, None, None, 9) for i in range(400)]
    rows += [(d, "Dir", 0, 4096, 1, None, None, 0) for d in {p for r in rows for p in (r[0].rsplit("/", 1)[0], r[0].rsplit("/", 2)[0] or "/w")} | {"/w"}]
    entries = staged(spark.createDataFrame(rows, ENTRY))
    folder = Path(shared_folder(spark).removeprefix("file://"))
    there = set(folder.iterdir())
    found = buildtrees.analyze(entries, builtin())
    assert not [p for p in set(folder.iterdir()) - there if "nlink" in spark.read.parquet(str(p)).columns]  # the entries were copied before
    assert {(r["path"], r["entries"], r["allocated"], r["project_path"]) for r in found["artifacts"].collect()} == {(f"/w/p{i}/target", 40, 40 * 512, f"/w/p{i}") for i in range(0, 400, 50)}
    sums = {r["path"]: (r["artifact_size"], r["source_size"]) for r in found["projects"].collect()}
    assert sums == {f"/w/p{i}": ((40 * 512, 512) if i % 50 == 0 else (0, 41 * 512)) for i in range(400)}
    tops = spark.createDataFrame([("/w/p0/target",)], "path string")
    plan = tree.directory_totals(entries, tops, own=False)
    assert "BroadcastHashJoin" in plan._jdf.queryExecution().executedPlan().toString() and plan.first()["entries"] == 40


def shuffle_files(spark) -> int:
    places = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirsString()
    return sum(name.startswith("shuffle_") for place in places for _, _, names in os.walk(place) for name in names)


def test_staged_tables_leave_no_shuffle_files(spark):
    before = shuffle_files(spark)
    out = staged(spark.range(5000).groupBy((F.col("id") % 100).alias("k")).count())
    assert out.count() == 100
    out = staged(out.repartition(7, "k"))
    assert shuffle_files(spark) <= before
    assert out.where("count = 50").count() == 100
    assert spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled", None) is None


def test_rules_of_any_name_copy_no_foreign_entries(spark):
    rows = [("/w", "Dir"), ("/w/a", "Dir"), ("/w/a/env", "Dir"), ("/w/a/env/pyvenv.cfg", "File"), ("/w/a/other", "Dir"), ("/w/a/f", "File"), ("/w/pyvenv.cfg", "File")]
    entries = spark.createDataFrame(rows, "path string, kind string")
    named = buildtrees.of_interest(entries, builtin())
    assert {r[0] for r in named.select("path").collect()} == {"/w", "/w/a/env", "/w/a/env/pyvenv.cfg", "/w/pyvenv.cfg"}
    same = [sorted(map(tuple, buildtrees.claims(e, builtin()).collect())) for e in (entries, named)]
    assert same[0] == same[1] and same[0]


def test_odd_paths_are_cut_as_before(spark):
    paths = ["/", "", "//", "/a/b/", "//a//b", "a/b", "/a/é/x.y"]
    got = spark.createDataFrame([(p,) for p in paths], "p string").select(P.name("p"), P.parent("p"), P.depth("p"), P.prefixes("p", 1)).collect()
    assert [tuple(r) for r in got] == [
        ("/", None, 0, []), ("", None, 0, []), ("//", None, 0, []), ("b", "/a", 2, ["/a", "/a/b"]), ("b", "/a", 2, ["/a", "/a/b"]), ("b", "/a", 2, ["/a", "/a/b"]),
        ("x.y", "/a/é", 3, ["/a", "/a/é", "/a/é/x.y"]),
    ]


def test_a_directory_and_its_marker_in_different_batches(spark, tmp_path):
    entry = lambda path, kind, n: (path, kind, n, 512 * n, 1, None, None, n)
    first = [entry("/w", "Dir", 0), entry("/w/a", "Dir", 0), entry("/w/a/env", "Dir", 0), entry("/w/a/f.txt", "File", 3)]
    for at, batches in enumerate(([first, [entry("/w/a/env/pyvenv.cfg", "File", 2)]], [[entry("/w/a/env/pyvenv.cfg", "File", 2)], first])):
        kept = LiveProjects(spark, f"file://{tmp_path}/{at}", builtin())
        for n, rows in enumerate(batches):
            kept.upkeep(spark.createDataFrame(rows, ENTRY), n)
        assert [(r["path"], r["artifact_size"], r["source_size"]) for r in kept.projects().collect()] == [("/w/a", 1024, 1536)]
    # Only what holds something of interest is looked at again, not all directories above.
    named = buildtrees.of_interest(spark.createDataFrame([*first, entry("/w/a/env/pyvenv.cfg", "File", 2)], ENTRY), builtin())
    assert {r["dir"] for r in buildtrees.holders(named, builtin()).collect()} == {"/w/a", "/w/a/env"}


def test_an_analysis_leaves_only_what_its_results_read(spark):
    entry = lambda path, kind, n: (path, kind, n, 512 * n, 1, None, None, n)
    rows = [entry(d, "Dir", 0) for d in ("/w", "/w/a", "/w/a/target", "/w/a/src", "/w/a/src/x", "/w/a/src/x/y", "/w/a/src/x/y/z")]
    rows += [entry("/w/a/Cargo.toml", "File", 1), entry("/w/a/target/o", "File", 2), entry("/w/a/src/x/y/z/m.rs", "File", 3), entry("/top", "File", 9)]
    entries = staged(spark.createDataFrame(rows, ENTRY))
    folder = Path(shared_folder(spark).removeprefix("file://"))
    there = set(folder.iterdir())
    found = buildtrees.analyze(entries, builtin())
    assert len(set(folder.iterdir()) - there) <= 5  # artifacts, projects, sums of sources and two lists of the keys of joins
    assert [(r["path"], r["artifact_size"], r["source_size"], r["last_source_mtime"]) for r in found["projects"].collect()] == [("/w/a", 1024, 4 * 512, 3)]
    assert [(r["path"], r["project_path"]) for r in found["artifacts"].collect()] == [("/w/a/target", "/w/a")]


def test_told_by_bitmaps_and_by_keys(spark, monkeypatch):
    rows = spark.range(4000).selectExpr("if(id % 7 = 0, null, concat('k', id)) AS k")
    wanted = spark.range(0, 4000, 3).selectExpr("concat('k', id) AS k").unionByName(spark.createDataFrame([(None,)], "k string"))
    right = rows.join(wanted, "k", "left_semi").count()
    for most, slack in ((screen.KEYS, 0), (10, 400)):
        monkeypatch.setattr(screen, "KEYS", most)
        out = screen.told(rows, {"k": wanted})
        assert out.count() == 4000 and right <= out.where("__k").count() <= right + slack
        assert out.where("__k").join(wanted, "k", "left_semi").count() == right and out.where("k is null and __k").isEmpty()


def test_a_fixture_is_the_same_in_shares(spark, monkeypatch):
    sf = "/root/testdata/sf0.001"
    for build in (tables.built_dev_entries, tables.built_entries):
        whole = build(spark, sf)
        parts = [build(spark, sf, (i, 3)) for i in range(3)]
        assert all(p.count() < whole.count() * 0.8 for p in parts)
        both = parts[0].unionByName(parts[1]).unionByName(parts[2])
        assert both.count() == whole.count() and both.exceptAll(whole).isEmpty()


def test_paths_outside_the_drawer_are_not_shuffled(spark, monkeypatch):
    paths = spark.createDataFrame([(p,) for p in ("/r", "/r/a", "/r/a/x", "/r/b", "/r/b/y", "/r/ab")], "path string")
    items = spark.createDataFrame([("/r/a",), ("/r/b/y",), ("/r/a",)], "path string")
    for most in (screen.KEYS, 1):
        monkeypatch.setattr(screen, "KEYS", most)
        out = ops.contains(items, paths)
        got = {r["path"]: (r["staged"], r["covered"]) for r in out.collect()}
        assert out.count() == 6 and got == {"/r": (False, False), "/r/a": (True, True), "/r/a/x": (False, True), "/r/b": (False, False), "/r/b/y": (True, True), "/r/ab": (False, False)}
        assert "Union" in out._jdf.queryExecution().optimizedPlan().toString()  # before, every path met the items found in one join


def test_rules_texts_are_looked_up_after_the_shuffle(spark):
    rows = [("/w/a", "Dir"), ("/w/a/Cargo.toml", "File"), ("/w/a/target", "Dir"), ("/w/b", "Dir"), ("/w/b/package.json", "File"), ("/w/b/node_modules", "Dir"), ("/w/b/yarn.lock", "File")]
    rows += [("/w/d", "Dir"), ("/w/d/package.json", "File"), ("/w/d/node_modules", "Dir")]
    named = buildtrees.of_interest(spark.createDataFrame(rows, "path string, kind string"), builtin())
    assessed = buildtrees.risk_assess(staged(buildtrees.claims(named, builtin())), named, builtin())
    below = assessed._jdf.queryExecution().optimizedPlan().toString().split("Join LeftOuter")[1]
    texts = [r[buildtrees.REGENERATE] for r in builtin() if r[buildtrees.REGENERATE]]
    assert texts and not [t for t in texts if t in below]  # before, every claim was shuffled with its rule's texts
    assert {(r["path"], r["risk_rank"]) for r in buildtrees.resolve(assessed, builtin()).collect()} == {("/w/a/target", 0), ("/w/b/node_modules", 0), ("/w/d/node_modules", 1)}


def test_starts_that_are_projects_look_no_further(spark, monkeypatch):
    seen = []
    real = buildtrees.among
    monkeypatch.setattr(buildtrees, "among", lambda rows, wanted, key: seen.append(rows.columns) or seen.append({r[0] for r in rows.collect()}) or real(rows, wanted, key))
    frame = lambda *paths: spark.createDataFrame([(p,) for p in paths], "dir string")
    starts = frame("/w/a", "/w/a/x", "/w/b", "/w/b/y", "/w/c", "/", "/w/a/", None)
    out = buildtrees.nearest(starts, "dir", frame("/w/a", "/w/b/y", "/"), frame("/w/b", "/w/b/z"))
    assert {(r["dir"], r["project_path"]) for r in out.collect()} == {("/w/a", "/w/a"), ("/w/a/x", "/w/a"), ("/w/b", "/w/b"), ("/w/b/y", "/w/b/y"), ("/w/a/", "/w/a")}
    assert not {"/w/a", "/w/b/y"} & seen[1]  # before, each start was sent to all its ancestors


def test_totals_below_tops_take_one_shuffle(spark):
    rows = [("/w", "Dir", 0, 4096, 1, None, None, 0), ("/w/a", "Dir", 0, 4096, 1, None, None, 0), ("/w/e", "Dir", 0, 4096, 1, None, None, 0)]
    rows += [(f"/w/a/{n}", "File", 1, 512, 2, 1, 7, 0) for n in "xy"] + [("/w/a/.git", "Dir", 0, 4096, 1, None, None, 0)]
    entries = spark.createDataFrame(rows, ENTRY)
    out = tree.directory_totals(entries, spark.createDataFrame([("/w/a",), ("/w/e",), ("/none",)], "path string"), own=False)
    assert {tuple(r) for r in out.collect()} == {("/w/a", 4608, 1, 3, True), ("/w/e", 0, 0, 0, False), ("/none", 0, 0, 0, False)}
    plan = out._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[-1]
    assert plan.count("Exchange hashpartitioning(top") == 2  # of links by file, and of all sums; before, plain sums and tops too


def test_an_order_is_made_in_one_pass(spark, tmp_path):
    orders = spark.read.parquet("/root/testdata/sf0.001/orders.parquet")
    lines = spark.read.parquet("/root/testdata/sf0.001/lineitem.parquet").orderBy("l_orderkey", "l_linenumber").limit(12).drop("l_orderkey")
    at = lambda days, customer: orders.where("o_orderkey = 3").select(F.lit(3).cast("long").alias("o_orderkey"), F.lit(customer).cast("long").alias("o_custkey"), *[c for c in orders.columns[2:] if c != "o_orderdate"], F.expr(f"o_orderdate + interval {days} day").alias("o_orderdate"))
    odd, places = f"{tmp_path}/odd", ["target", "node_modules", "build", "__pycache__", "src"]
    at(0, 8).unionByName(at(0, 8)).unionByName(at(5, 8)).unionByName(at(0, 9)).write.parquet(f"{odd}/orders.parquet")
    n = F.col("l_linenumber")
    both = lines.unionByName(lines).unionByName(lines.withColumn("l_linenumber", n + 50).withColumn("l_partkey", F.lit(None).cast("long")))
    both.withColumn("l_orderkey", F.lit(3).cast("long")).write.parquet(f"{odd}/lineitem.parquet")
    made = tables.built_dev_entries(spark, odd)
    assert "lambda" not in made._jdf.queryExecution().executedPlan().toString()  # before, each row was made through one
    got = sorted((r["path"], r["kind"]) for r in made.collect())
    want = [("/w", "Dir"), ("/w/c8", "Dir"), ("/w/c9", "Dir"), ("/w/c9/package.json", "File"), *[("/w/c8/o3/CMakeLists.txt", "File")] * 2, ("/w/c9/o3/CMakeLists.txt", "File")]
    for home in ("/w/c8/o3", "/w/c9/o3"):
        files = {(places[r["l_linenumber"] % 5], r["l_linenumber"], r["l_partkey"], r["l_suppkey"]) for r in lines.collect()}
        want += [(home, "Dir"), *((f"{home}/{f}", "Dir") for f in {f[0] for f in files}), *((f"{home}/{f}/l{a}_{b}_{c}", "File") for f, a, b, c in files)]
    assert lines.count() and got == sorted(want)


def test_claims_are_written_before_they_are_assessed(spark):
    out = dev.claim_resolution(spark, "/root/testdata/sf0.001")
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "claims-" in plan and "matched-" not in plan  # before, claims were made and assessed in one job, with all shuffle files of both
