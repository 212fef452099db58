"""Scans by a frontier, in batch and as a stream, against os.walk."""

import os
import time

import pytest
from pyspark.sql import functions as F

from fathomry.operators import tree
from fathomry.sources import filesystem
from fathomry.sources.filesystem import Lister, live_scan, scan
from fathomry.streaming import live


def walked(top, follow=False):
    """path -> kind of all below ``top`` and itself; with ``follow`` level by level, each directory by its first way."""
    found, level, seen = {top: "Dir"}, [top], {(os.stat(top).st_dev, os.stat(top).st_ino)}
    while level:
        below = []
        for path in level:
            for name in os.listdir(path):
                child = f"{path}/{name}"
                link = os.path.islink(child)
                if os.path.isdir(child) and (follow or not link):
                    below.append(child)
                else:
                    found[child] = "Symlink" if link else "File"
        level = []
        for child in sorted(below, key=lambda p: p.split("/")):
            s = os.stat(child)
            first = not follow or (s.st_dev, s.st_ino) not in seen
            seen.add((s.st_dev, s.st_ino))
            found[child] = "Dir" if first or not os.path.islink(child) else "Symlink"
            if first:
                level.append(child)
    return found


def paths(df):
    rows = df.select("path", "kind").collect()
    assert len(rows) == len({r["path"] for r in rows})
    return {r["path"]: r["kind"] for r in rows}


def make(top, dirs, files):
    for i in range(dirs):
        d = f"{top}/d{i % 7}/e{i}"
        os.makedirs(d)
        for j in range(files):
            with open(f"{d}/f{j}", "w") as f:
                f.write("x" * j)


def test_a_deep_chain_and_a_large_directory(spark, tmp_path, monkeypatch):
    deep = "/".join("d" for _ in range(200))
    os.makedirs(f"{tmp_path}/chain/{deep}")
    os.makedirs(f"{tmp_path}/large")
    for i in range(100_000):
        os.close(os.open(f"{tmp_path}/large/f{i}", os.O_CREAT))
    found = scan(spark, [str(tmp_path)])
    assert found.count() == 100_203 and found.agg(F.max(F.size(F.split("path", "/")))).first()[0] == len(str(tmp_path).split("/")) + 201
    assert found.select("path").distinct().count() == 100_203
    # No task sees more than its share and one part of a directory.
    lister = Lister({}, budget=100, chunk=500)
    rows = list(lister.walk(Lister({}).roots([f"{tmp_path}/large"])))
    assert len([r for r in rows if not r[14]]) == 501 and len([r for r in rows if r[14]]) == 199 and all(len(r[16]) == 500 for r in rows if r[14])


def test_small_budgets_give_the_same_rows(spark, tmp_path, monkeypatch):
    make(tmp_path, 40, 6)
    os.symlink(tmp_path, tmp_path / "d1/loop")
    monkeypatch.setattr(filesystem, "BUDGET", 7)
    monkeypatch.setattr(filesystem, "CHUNK", 4)
    assert paths(scan(spark, [str(tmp_path)])) == walked(str(tmp_path))
    left = scan(spark, [str(tmp_path)], [f"{tmp_path}/d2"], ["f[3-5]"])
    assert paths(left) == {p: k for p, k in walked(str(tmp_path)).items() if not p.startswith(f"{tmp_path}/d2") and p[-2:] not in ("f3", "f4", "f5")}


def test_links_that_are_followed(spark, tmp_path):
    top = tmp_path / "top"
    make(top, 10, 2)
    os.makedirs(tmp_path / "away/deep")
    (tmp_path / "away/deep/file").write_text("x")
    os.symlink(top, top / "d1/loop")
    os.symlink(tmp_path / "away", top / "d2/out")
    os.symlink(tmp_path / "away", top / "d3/out")
    os.symlink(tmp_path / "away/deep", top / "d0/short")
    os.symlink(top / "d1/e1/f1", top / "filelink")
    os.symlink("nowhere", top / "dangling")
    want = walked(str(top), follow=True)
    assert paths(scan(spark, [str(top)], follow_symlinks=True)) == want
    assert want[f"{top}/d2/out"] == "Dir" and want[f"{top}/d3/out"] == "Symlink" and want[f"{top}/d1/loop"] == "Symlink" and f"{top}/d0/short/file" in want


def test_roots_and_errors(spark, tmp_path):
    make(tmp_path, 3, 1)
    (tmp_path / "leaf").write_text("abc")
    both = scan(spark, [f"{tmp_path}/leaf", f"{tmp_path}/d1", f"{tmp_path}/d1"], leaf_roots=True)
    assert sorted(r["path"] for r in both.where("root = path").collect()) == [f"{tmp_path}/d1", f"{tmp_path}/leaf"] and both.count() == 4
    for bad, kind in ((f"{tmp_path}/leaf", NotADirectoryError), (f"{tmp_path}/none", FileNotFoundError)):
        with pytest.raises(kind):
            scan(spark, [bad])
    row = (str(tmp_path), f"{tmp_path}/gone", "gone", "Dir", 4096, 0, 2, 1, 2, 5, 0, False, False, None, True, 1, None, None)
    (failed,) = Lister({}).walk([row])
    assert failed[3:5] == ("Dir", 4096) and "No such file" in failed[13] and not failed[14]


def test_live_scan_goes_on_from_its_checkpoint(spark, tmp_path):
    top = tmp_path / "top"
    make(top, 60, 5)
    stream = lambda: live_scan(spark, [str(top)], f"file://{tmp_path}/state", budget=20, chunk=10)
    query = live.to_table(stream(), f"{tmp_path}/t", f"{tmp_path}/c", interval="0 seconds")
    while not os.path.exists(f"{tmp_path}/t/batch=1/_SUCCESS"):
        time.sleep(0.05)
    query.stop()
    half = len(paths(live.appended(spark, f"{tmp_path}/t", filesystem.ENTRY)))
    assert 0 < half
    query = live.to_table(stream(), f"{tmp_path}/t", f"{tmp_path}/c", interval="0 seconds")
    query.processAllAvailable()
    query.stop()
    found = live.appended(spark, f"{tmp_path}/t", filesystem.ENTRY)
    assert paths(found) == walked(str(top))
    batches = [int(n.removeprefix("batch=")) for n in os.listdir(f"{tmp_path}/t")]
    assert len(batches) > 2
    # Partial rollups of the same stream, in update mode.
    query = live.to_table(live.rollup_stream(live_scan(spark, [str(top)], f"file://{tmp_path}/state2", budget=100)), f"{tmp_path}/r", f"{tmp_path}/rc", "update", "0 seconds")
    query.processAllAvailable()
    query.stop()
    sums = live.latest(spark, f"{tmp_path}/r", "path string, agg_apparent bigint, agg_allocated bigint, items bigint", ["path"])
    want = tree.rollup(scan(spark, [str(top)]))
    key = lambda df: sorted(tuple(r) for r in df.select("path", "agg_apparent", "agg_allocated", "items").collect())
    assert key(sums) == key(want)
