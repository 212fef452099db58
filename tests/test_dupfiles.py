"""Duplicates of real files through the cache, verification and the command line; the cosine transform."""

import io
import json
import os

import numpy as np
from pyspark.sql import functions as F

from fathomry import cli
from fathomry.functions.hashing import cosine_hash
from fathomry.operators import dupfiles
from fathomry.schemas import CACHE


def listed(spark, folder):
    rows = [(str(p), p.stat().st_size, int(p.stat().st_mtime), p.stat().st_dev, p.stat().st_ino) for p in sorted(folder.iterdir())]
    return spark.createDataFrame(rows, "path string, size long, mtime long, dev long, ino long")


def test_cache_saves_reading_and_outlives_a_cancelled_search(spark, tmp_path):
    for name, text in (("a", "same" * 20_000), ("b", "same" * 20_000), ("c", "same" * 10_000 + "othr" * 10_000), ("d", "tame" * 20_000)):
        (tmp_path / name).write_text(text)
    seen = listed(spark, tmp_path)
    empty = spark.createDataFrame([], CACHE)
    first = dupfiles.find(seen, empty, verify=True)
    assert sorted(os.path.basename(r["path"]) for r in first.groups.collect()) == ["a", "b"] and first.errors.isEmpty()
    assert first.stats["cache_hits"] == 0 and first.stats["bytes_hashed"] == 4 * 32_768 + 2 * 80_000
    cache = dupfiles.renewed(empty, first, [str(tmp_path)], seen).checkpoint()
    again = dupfiles.find(seen, cache)
    assert again.stats["cache_hits"] == 6 and again.stats["bytes_hashed"] == 0 and again.groups.count() == 2
    stopped = dupfiles.find(seen.where("path not like '%/d'"), cache, cancelled=lambda: True)
    assert not stopped.complete and stopped.groups.isEmpty()
    assert dupfiles.renewed(cache, stopped, [str(tmp_path)], seen.limit(0)).count() == 4
    assert dupfiles.renewed(cache, again, [str(tmp_path)], seen.where("path not like '%/d'")).count() == 3


def test_verification_splits_unlike_files_and_reports_unreadable_ones(spark, tmp_path):
    for name, text in (("a", "1"), ("b", "2"), ("c", "1"), ("d", "2"), ("e", "3")):
        (tmp_path / name).write_text(text)
    rows = [(str(tmp_path / n), 1, 0, "h") for n in ("a", "b", "c", "d", "e", "gone")]
    kept, failed = dupfiles.verified(spark.createDataFrame(rows, "path string, size long, mtime long, hash string"))
    found = {os.path.basename(r["path"]): r["hash"] for r in kept.collect()}
    assert found == {"a": "h", "c": "h", "b": f"h#{tmp_path}/b", "d": f"h#{tmp_path}/b"}
    assert [os.path.basename(r["path"]) for r in failed.collect()] == ["gone"]
    kept, failed = dupfiles.verified(spark.createDataFrame([(str(tmp_path / n), 1, 0, "h") for n in ("0gone", "a", "c")], "path string, size long, mtime long, hash string"))
    assert kept.count() == 2 and failed.count() == 1


def test_dup_and_delete_on_the_command_line(spark, tmp_path, monkeypatch):
    (tmp_path / "p").mkdir()
    for name in ("x", "y"):
        (tmp_path / "p" / name).write_text("same")
    run = lambda *argv: (lambda out: (cli.run(list(argv), spark, out), out.getvalue()))(io.StringIO())
    where = str(tmp_path / "p")
    for hits in (0, 4):
        code, text = run("dup", where, "--min-size", "1", "--cache", str(tmp_path / "cache"), "--verify", "--json", "--csv", str(tmp_path / "csv"))
        doc = json.loads(text)
        assert code == 0 and doc["total_wasted"] == 4 and len(doc["groups"][0]["files"]) == 2 and doc["stats"]["cache_hits"] == hits
    assert spark.read.option("header", True).csv(str(tmp_path / "csv")).count() == 2
    many = [str(tmp_path / "p" / n) for n in ("x", "y")]
    (tmp_path / "s.toml").write_text("confirm_count = 1")
    for typed, want in (("no\n", 3), ("DELETE\n", 0)):
        monkeypatch.setattr("sys.stdin", io.StringIO(typed))
        assert run("--settings", str(tmp_path / "s.toml"), "delete", *many, "--method", "permanent", "--yes")[0] == want
    doc = json.loads(run("delete", *many, "--json")[1])
    assert not doc["confirmed"] and len(doc["entries"]) == 2 and all(os.path.exists(p) for p in many)


def test_cosine_hash_follows_the_transform(spark):
    rng = np.random.default_rng(5)
    matrices = rng.normal(size=(20, 16, 16))
    wave = np.array([[np.cos(np.pi * (2 * x + 1) * k / 32) for x in range(16)] for k in range(8)])
    want = []
    for m in matrices:
        low = (wave @ m @ wave.T).ravel()
        n = sum(1 << i for i, up in enumerate(low > low.mean()) if up)
        want.append(n - (1 << 64) if n >> 63 else n)
    df = spark.createDataFrame([(i, m.ravel().tolist()) for i, m in enumerate(matrices)], "i int, v array<double>")
    assert [r["h"] for r in df.select("i", cosine_hash("v", 16).alias("h")).orderBy("i").collect()] == want
    odd = spark.createDataFrame([(None,), ([1.0],)], "v array<double>")
    assert [r[0] for r in odd.select(cosine_hash("v", 16)).collect()] == [None, None]
