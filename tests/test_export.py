"""Exports are whole: all issues of a scan, similar groups beside identical ones."""

import csv
import io
import json
import os

import duckdb
import pytest
from pyspark.sql import functions as F

from fathomry import cli
from fathomry.operators import export, tree
from fathomry.plans import catalogue
from fathomry.sources.filesystem import scan

SF = "/root/testdata/sf0.01"


def test_scan_json_names_every_issue(spark, tmp_path):
    (tmp_path / "f").write_text("x")
    rolled = tree.rolled_up(tree.mark_hard_links(scan(spark, [str(tmp_path)])))
    issues = spark.range(6000).select(F.format_string("/x/%05d", "id").alias("path"), F.lit('denied "é"\n').alias("error"))
    text = export.to_json(rolled, issues, str(tmp_path), 2, 20)
    found = json.loads(text)
    assert [r["path"] for r in found["issues"]] == [f"/x/{i:05}" for i in range(6000)] and found["root"]["path"] == str(tmp_path)
    assert text == json.dumps(found, indent=2, ensure_ascii=False)
    empty = export.to_json(rolled, issues.limit(0), str(tmp_path), 2, 20)
    assert empty == json.dumps(json.loads(empty), indent=2, ensure_ascii=False) and json.loads(empty)["issues"] == []
    out = io.StringIO()
    assert cli.run(["scan", "--json", str(tmp_path)], spark, out) == 0 and json.loads(out.getvalue())["issues"] == []


def test_duplicate_exports_hold_similar_groups(spark, tmp_path):
    groups = spark.createDataFrame([("/a", 5, 1, "h"), ("/b", 5, 2, "h")], "path string, size long, mtime long, hash string")
    rows = [(7, 3, "/i/2", 90, 1, 20, 10), (7, 3, "/i/1", 40, 2, None, None), (8, 0, "/i/3", 200, 3, 30, 10), (8, 0, "/i/4", 300, 4, 40, 10)]
    similar = spark.createDataFrame(rows, "root long, max_distance int, path string, size long, mtime long, width int, height int")
    export.write_duplicates_csv(groups, similar, str(tmp_path / "csv"))
    lines = [r for f in sorted((tmp_path / "csv").glob("part-*")) for r in csv.DictReader(f.open())]
    assert list(lines[0]) == ["group", "kind", "hash", "distance", "group_wasted", "path", "size", "mtime", "width", "height"]
    assert [(r["group"], r["kind"], r["distance"], r["group_wasted"], r["path"], r["width"]) for r in lines] == [
        ("1", "identical", "", "5", "/a", ""), ("1", "identical", "", "5", "/b", ""), ("2", "similar", "0", "200", "/i/3", "30"), ("2", "similar", "0", "200", "/i/4", "40"),
        ("3", "similar", "3", "40", "/i/1", ""), ("3", "similar", "3", "40", "/i/2", "20"),
    ]
    errors = spark.createDataFrame([("/e", "denied")], "path string, error string")
    text = "".join(export.duplicates_document(groups, similar, errors, {"files_scanned": 6}))
    found = json.loads(text)
    assert list(found) == ["total_wasted", "groups", "similar", "errors", "stats"] and text == json.dumps(found, indent=2, ensure_ascii=False)
    assert found["total_wasted"] == 5 and [f["path"] for f in found["groups"][0]["files"]] == ["/a", "/b"]
    assert [(g["distance"], g["size"], g["wasted"]) for g in found["similar"]] == [(0, 300, 200), (3, 90, 40)]
    assert found["errors"] == [{"path": "/e", "error": "denied"}] and found["stats"] == {"files_scanned": 6}


@pytest.mark.skipif(not os.path.isdir(SF), reason="no tables")
def test_whole_export_equals_sql(spark):
    db = duckdb.connect()
    for t in os.listdir(SF):
        db.execute(f"CREATE VIEW {t.removesuffix('.parquet')} AS SELECT * FROM '{SF}/{t}'")
    df = catalogue.queries()["dup_export_all"](spark, SF)
    want = db.execute(catalogue.oracle_sql()["dup_export_all"])
    assert [d[0] for d in want.description] == df.columns
    rows = df.collect()
    assert {r["kind"] for r in rows} == {"identical", "similar"} and sorted(map(repr, map(tuple, rows))) == sorted(map(repr, want.fetchall()))
