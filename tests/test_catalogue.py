"""The driver's contract: names, shapes, and some queries against their SQL on the smallest tables."""

import os

import duckdb
import pytest

from fathomry.plans import catalogue

SF = "/root/testdata/sf0.001"
NAMES = ["scan_rollup", "exclude_glob", "dup_groups", "similar_groups", "claim_resolution", "reclaimable", "stream_rollup"]
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no tables")


def test_every_check_has_a_query():
    assert set(catalogue.oracle_sql()) <= set(catalogue.queries()) and len(catalogue.queries()) > 90


@pytest.mark.parametrize("name", NAMES)
def test_query_equals_sql(spark, name):
    db = duckdb.connect()
    for t in os.listdir(SF):
        db.execute(f"CREATE VIEW {t.removesuffix('.parquet')} AS SELECT * FROM '{SF}/{t}'")
    df = catalogue.queries()[name](spark, SF)
    got = sorted(repr(tuple(r[c] for c in sorted(df.columns))) for r in df.collect())
    want = db.execute(catalogue.oracle_sql()[name])
    names = [d[0] for d in want.description]
    rows = sorted(repr(tuple(r[names.index(c)] for c in sorted(names))) for r in want.fetchall())
    assert sorted(names) == sorted(df.columns) and got == rows
