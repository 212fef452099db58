"""Journal order, live control, numbering, and functions without a query."""

import pytest
from pyspark.sql import functions as F

from fathomry.functions import formats as T
from fathomry.operators import dedup, filters, layout, ops
from fathomry.operators.graph import shared_folder
from fathomry.operators.ordering import numbered
from fathomry.sources import files
from fathomry.streaming import live


def test_journal_keeps_the_order_of_appends(spark, tmp_path):
    path = f"{tmp_path}/journal"
    for i in range(6):
        rows = [(i, "delete", f"/f{i}_{j}", None, 1, "ok", None) for j in range(3)]
        files.append_journal(spark.createDataFrame(rows, files.JOURNAL).repartition(2).orderBy("path"), path)
    found = files.read_journal(spark, path)
    assert [r["path"] for r in found.orderBy("line").collect()] == [f"/f{i}_{j}" for i in range(6) for j in range(3)]
    assert [r["path"] for r in ops.journal_latest(found, 4).collect()] == ["/f5_2", "/f5_1", "/f5_0", "/f4_2"]
    assert files.read_journal(spark, f"{tmp_path}/none").count() == 0


def test_numbers_run_through_all_ranges(spark):
    rows = spark.range(1000).select(((F.col("id") * 7919) % 1000).alias("x"), F.lit("a").alias("same"))
    assert [(r["x"], r["n"]) for r in numbered(rows, [F.desc("x")], "n").orderBy("n").collect()] == [(999 - i, i + 1) for i in range(1000)]
    assert numbered(rows.limit(0), [F.col("x")], "n").count() == 0
    assert sorted(r["n"] for r in numbered(rows, [F.col("same")], "n", 0).collect()) == list(range(1000))
    plan = dedup.in_order(rows.select(F.col("x").alias("size"), F.lit(1).alias("wasted"), F.lit("/a").alias("first_path")))._jdf.queryExecution().optimizedPlan().toString()
    assert "Window" not in plan


def test_live_scan_pauses_and_goes_on(spark, tmp_path):
    one = lambda i: spark.createDataFrame([(f"/d/f{i}",)], "path string").coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    one(0)
    scan = live.LiveScan(live.entry_stream(spark, f"{tmp_path}/in", "path string", "*.parquet", 1), f"{tmp_path}/t", f"{tmp_path}/c")
    scan.resume().awaitTermination()
    scan.pause()
    assert scan.state == "paused"
    one(1), one(2)
    assert live.appended(spark, f"{tmp_path}/t", "path string").count() == 1
    scan.resume().awaitTermination()
    assert sorted(r["path"] for r in live.appended(spark, f"{tmp_path}/t", "path string").collect()) == ["/d/f0", "/d/f1", "/d/f2"]
    scan.cancel()
    with pytest.raises(RuntimeError):
        scan.resume()


def test_sizes_and_points(spark):
    cases = {0: "0 B", 1023: "1023 B", 1024: "1.00 KiB", 10 * 1024: "10.0 KiB", 1023 * 1024: "1023 KiB", 1 << 60: "1.00 EiB"}
    assert {n: T.exact_size(n) for n in cases} == cases
    assert T.exact_size(999_999, T.DECIMAL) == "1000 kB" and T.exact_size(1_500, T.DECIMAL) == "1.50 kB"
    points = spark.createDataFrame([(0.0, -50.0), (50.0, 0.0), (0.0, 50.0), (-50.0, 0.0), (1.0, 1.0), (200.0, 0.0)], "x double, y double")
    ring, angle = layout.polar(F.col("x"), F.col("y"), 100.0, 2)
    got = points.select(ring.alias("r"), F.round(angle / (layout.TAU / 4), 6).alias("a")).collect()
    assert [(r["r"], r["a"]) for r in got[:4]] == [(1, 0.0), (1, 1.0), (1, 2.0), (1, 3.0)] and got[4]["r"] == 0 and got[5]["r"] > 2


def test_excluded_by_component_or_prefix(spark):
    rows = spark.createDataFrame([(p,) for p in ("/a", "/a/b", "/a/bx/c", "/a/b.tmp/c", "/x/a/b", "/q/[1]/z", "/q/n1/z", "/q/n12")], "path string")
    left = lambda paths, globs: [r["path"] for r in filters.without_excluded(rows, paths, globs).orderBy("path").collect()]
    assert left(["/a/b"], []) == ["/a", "/a/b.tmp/c", "/a/bx/c", "/q/[1]/z", "/q/n1/z", "/q/n12", "/x/a/b"]
    assert left([], ["*.tmp", "n[0-9]"]) == ["/a", "/a/b", "/a/bx/c", "/q/[1]/z", "/q/n12", "/x/a/b"]
    assert left([], ["/x*", "b?", "", "/", "["]) == ["/a", "/a/b", "/a/b.tmp/c", "/q/[1]/z", "/q/n1/z", "/q/n12"]
    assert left([], ["/*/b*"]) == ["/a", "/q/[1]/z", "/q/n1/z", "/q/n12"]


def test_no_private_folders_on_a_cluster(spark, monkeypatch):
    class Context:
        master = "spark://host:7077"

    class Session:
        sparkContext = Context()  # noqa: N815
        conf = type("Conf", (), {"get": staticmethod(lambda *_: None)})()

    with pytest.raises(ValueError):
        shared_folder(Session())
    Context.master = "local[4]"
    assert shared_folder(Session())
