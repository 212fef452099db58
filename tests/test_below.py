"""What lies at or below given paths, without shuffling what surely doesn't; summaries that make a rollup once."""

import pytest
from pyspark.sql import functions as F

from fathomry.operators import filters, ops, screen, tree

PATHS = ["/a", "/a/b", "/a/b/c", "/a/bx", "/d", "/d/e/f", "/d/e", "/g", None]


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


@pytest.fixture(params=["few", "many"])
def rows(request, spark, monkeypatch):
    if request.param == "many":
        monkeypatch.setattr(screen, "KEYS", 0)  # bitmaps, which may let others pass
        monkeypatch.setattr(screen, "PER_KEY", 0)
    return spark.createDataFrame([(p, "File", 1) for p in PATHS], "path string, kind string, allocated bigint")


def test_removed_and_staged_paths(spark, rows):
    """every entry was shuffled once for each directory above it."""
    some = spark.createDataFrame([("/a/b",), ("/a/b/c",), ("/d",), ("/d",), ("/none",)], "path string")
    assert sorted(r[0] for r in screen.outermost(some).collect()) == ["/a/b", "/d", "/none"]
    under = {"/a/b", "/a/b/c", "/d", "/d/e", "/d/e/f"}
    left, flags = ops.after_execution(rows, some), filters.staged_flags(rows, some)
    assert {r["path"] for r in left.collect()} == set(PATHS) - under and left.columns == rows.columns
    assert {(r["path"], r["staged"]) for r in flags.collect()} == {(p, p in under) for p in PATHS}
    assert flags.count() == len(PATHS)
    assert "Generate" not in plan(left) and "Generate" not in plan(flags)


def test_a_summary_makes_the_rollup_once(spark):
    """each level made the whole rollup again, and those above it."""
    entries = spark.createDataFrame([(f"/r/{a}/{b}/f", "File", 10 + a + b, 512 * (a + b + 1)) for a in range(4) for b in range(4)] + [("/r", "Dir", 0, 0)] + [(f"/r/{a}", "Dir", 0, 0) for a in range(4)] + [(f"/r/{a}/{b}", "Dir", 0, 0) for a in range(4) for b in range(4)], "path string, kind string, apparent bigint, allocated bigint")
    found = tree.summarize(tree.rolled_up(entries), "/r", 2, 2)
    got = [(r["path"], r["level"], r["rank"]) for r in found.orderBy("level", F.col("path").desc()).collect()]
    assert got == [("/r", 0, 1), ("/r/3", 1, 1), ("/r/2", 1, 2), ("/r/3/3", 2, 1), ("/r/3/2", 2, 2), ("/r/2/3", 2, 1), ("/r/2/2", 2, 2)]
    assert "Aggregate" not in plan(found) and "Join" not in plan(found)
