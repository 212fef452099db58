"""Rollups, links, searches, filters and layout on small trees."""

import math
import os

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from fathomry.functions import formats, globs, paths
from fathomry.operators import filters, layout, tree
from fathomry.sources.filesystem import scan

SHAPE = "path string, kind string, apparent long, allocated long, nlink long, dev long, ino long, mtime long"


def entries(spark, rows):
    return spark.createDataFrame([(p, k, s, s, n, 1, i, 0) for p, k, s, n, i in rows], SHAPE)


@pytest.fixture(scope="module")
def small(spark):
    return entries(spark, [("/r", "Dir", 0, 1, 1), ("/r/a", "Dir", 0, 1, 2), ("/r/a/f1", "File", 100, 1, 3), ("/r/f2", "File", 50, 1, 4)])


def test_rollup_counts_bytes_and_items(small):
    found = {r["path"]: (r["agg_apparent"], r["items"]) for r in tree.rolled_up(tree.mark_hard_links(small)).collect()}
    assert found["/r"] == (150, 3) and found["/r/a"] == (100, 1)
    after = {r["path"]: (r["agg_apparent"], r["items"]) for r in tree.rolled_up(tree.remove_subtree(small, "/r/a")).collect()}
    assert after["/r"] == (50, 1)
    assert [r["path"] for r in tree.largest_files(small, 2).collect()] == ["/r/a/f1", "/r/f2"]


def test_hard_links_count_once(spark):
    rows = tree.mark_hard_links(entries(spark, [("/r", "Dir", 0, 1, 1), ("/r/x", "File", 1000, 2, 42), ("/r/y", "File", 1000, 2, 42)]))
    assert {r["path"]: r["hardlink_dup"] for r in rows.collect()} == {"/r": False, "/r/x": False, "/r/y": True}
    assert tree.rollup(rows).first()["agg_apparent"] == 1000


@settings(max_examples=6, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.lists(st.sampled_from("abc"), min_size=1, max_size=4), st.integers(0, 10**6)), min_size=1, max_size=40))
def test_every_directory_is_the_sum_of_its_files(spark, files):
    rows = {"/" + "/".join([*p, "f"]): s for p, s in files}
    found = {r["path"]: r["agg_apparent"] for r in tree.rollup(entries(spark, [(p, "File", s, 1, i) for i, (p, s) in enumerate(rows.items())])).collect()}
    for directory, total in found.items():
        assert total == sum(s for p, s in rows.items() if p.startswith(directory + "/"))


def test_paths(spark):
    row = spark.range(1).select(
        paths.normalized(F.lit("/a/./b/../c/")).alias("n"), paths.prefixes(F.lit("/a/b")).alias("p"), paths.prefixes(F.lit("/")).alias("none"), paths.name(F.lit("/")).alias("root"),
        paths.under(F.lit("/a/bc"), F.lit("/a/b")).alias("no"), paths.under(F.lit("/a/b/c"), F.lit("/a/b")).alias("yes"), paths.parent(F.lit("/a")).alias("up"),
    ).first()
    assert row.asDict() == {"n": "/a/c", "p": ["/a"], "none": [], "root": "/", "no": False, "yes": True, "up": "/"}


@pytest.mark.parametrize(("pattern", "name", "hit"), [("MOD", "node_modules", True), ("*.iso", "Ubuntu.ISO", True), ("*.iso", "iso.txt", False), ("f?o*", "foobar", True), ("f?o", "foobar", False)])
def test_search(spark, pattern, name, hit):
    assert spark.range(1).select(globs.search(F.lit(name), pattern)).first()[0] is hit


def test_globs():
    import re

    assert re.match(globs.to_regex("*.{a,b}"), "x/y.b") and not re.match(globs.to_regex("[!a]x"), "ax")
    assert globs.compiled(["[", "*"])[1][0][0] == "["


def test_formats(spark):
    shown = lambda n, u=formats.BINARY: formats.exact_size(n, u)
    assert [shown(0), shown(1023), shown(1024), shown(1_500_000, formats.DECIMAL), shown(27_300_000_000, formats.DECIMAL), shown(2**64 - 1)] == ["0 B", "1023 B", "1.00 KiB", "1.50 MB", "27.3 GB", "16.0 EiB"]
    row = spark.createDataFrame([(86_400, 1_234_567, 0)], "s long, n long, z long").select(formats.date_text("s"), formats.grouped_digits("n"), formats.date_text("z"), formats.size_text("n"), formats.decimal_size_text("n")).first()
    assert list(row) == ["1970-01-02", "1,234,567", "—", "1.18 MiB", "1.23 MB"]


def test_exclusion_drops_subtrees(spark):
    rows = entries(spark, [("/r", "Dir", 0, 1, 1), ("/r/skip", "Dir", 0, 1, 2), ("/r/skip/f", "File", 1000, 1, 3), ("/r/keep.txt", "File", 10, 1, 4), ("/r/drop.log", "File", 10, 1, 5)])
    assert {r["path"] for r in filters.without_excluded(rows, ["/r/skip"], ["*.log"]).collect()} == {"/r", "/r/keep.txt"}
    flags = rows.where("path like '%/f'").select(filters.is_protected("path", ["/r"], ["/r/skip"]).alias("p")).first()
    assert flags["p"]


def test_layout_spans_the_circle(spark):
    rows = [("/r", "Dir", 0, 1, 0), ("/r/a", "Dir", 0, 1, 1), ("/r/a/a1", "File", 600, 1, 2), ("/r/a/a2", "File", 200, 1, 3), ("/r/b", "File", 200, 1, 4)] + [(f"/r/tiny{i}", "File", 1, 1, 10 + i) for i in range(50)]
    arcs = layout.rings(tree.rolled_up(entries(spark, rows)), "/r", 2, 0.05).collect()
    first = [a for a in arcs if a["ring"] == 1]
    assert len(first) == 3 and sum(a["end"] - a["start"] for a in first) == pytest.approx(2 * math.pi, abs=1e-3)
    assert [a["count"] for a in first if a["path"] is None] == [50]
    zoomed = layout.rings(tree.rolled_up(entries(spark, rows)), "/r/a", 2, 0.05).orderBy("start").collect()
    assert zoomed[0]["end"] == pytest.approx(0.75 * 2 * math.pi)


def test_filesystem_source(spark, tmp_path):
    (tmp_path / "a/b").mkdir(parents=True)
    (tmp_path / "a/b/f1").write_bytes(b"x" * 10_000)
    (tmp_path / "a/f2").write_bytes(b"x" * 5_000)
    (tmp_path / "f3").write_bytes(b"x")
    os.symlink(tmp_path, tmp_path / "a/loop")
    rows = tree.rolled_up(tree.mark_hard_links(scan(spark, [str(tmp_path)])))
    top = rows.where(F.col("path") == str(tmp_path)).first()
    assert top["items"] == 6 and top["agg_apparent"] == 15_001 + len(str(tmp_path))
    assert rows.where("kind = 'Symlink'").count() == 1
    assert scan(spark, [str(tmp_path)], follow_symlinks=True).count() < 10
    with pytest.raises(Exception, match="No such file|FileNotFound"):
        scan(spark, [str(tmp_path / "none")]).count()
