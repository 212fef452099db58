"""What is kept up to date: stored rollups, links over batches, tables that are replaced, progress, quarantine folders."""

import os
import random

import pytest
from pyspark.sql import functions as F

from fathomry import cli
from fathomry.operators import filters, ops, stored, tree
from fathomry.operators.stored import StoredRollup
from fathomry.sources import files
from fathomry.sources.filesystem import scan
from fathomry.streaming import links, live
from fathomry.streaming.progress import LogRing, ProgressListener

ENTRY = "path string, kind string, apparent bigint, allocated bigint, nlink bigint, dev bigint, ino bigint"


def entries(n=120, seed=1):
    rng = random.Random(seed)
    rows = [(f"/t/{'/'.join(rng.choice('ab') for _ in range(rng.randrange(1, 4)))}/f{i}", "File", 10 + i, 512, 3 if i % 3 == 0 else 1, 1, i % 20 if i % 3 == 0 else 1000 + i) for i in range(n)]
    rows = [r if r[4] == 1 else (*r[:2], 100 + r[6], 512, *r[4:]) for r in rows]
    dirs = {"/".join(r[0].split("/")[:k]) for r in rows for k in range(2, r[0].count("/") + 1)}
    return rows, [(d, "Dir", 0, 0, 1, None, None) for d in sorted(dirs)]


def table(df):
    return sorted(tuple(r) for r in df.select("path", "agg_apparent", "agg_allocated", "items").collect())


def test_removal_as_a_delta(spark, tmp_path, monkeypatch):
    rows, dirs = entries()
    marked = tree.mark_hard_links(spark.createDataFrame(rows + dirs, ENTRY)).cache()
    store = StoredRollup.create(marked, f"{tmp_path}/r")
    assert table(store.rows()) == table(tree.rolled_up(marked))
    gone = []
    dup = marked.where("hardlink_dup").first()["path"]
    for path in ("/t/a/a", dup, "/t/a", "/t/a/b", rows[5][0]):
        there = not any(path == g or path.startswith(f"{g}/") for g in gone)
        assert store.remove(path) is there and not store.remove(path)
        gone += [path] if there else []
        left = marked
        for g in gone:
            left = tree.remove_subtree(left, g)
        assert table(store.rows()) == table(tree.rolled_up(left))
    assert not store.remove("/t/none")
    # A crash before the top is noted: the same removal again counts once.
    os.rename(next(p for p in map(str, (tmp_path / "r").glob("rows-*/removed"))), f"{tmp_path}/lost")
    for g in gone:
        store.remove(g)
    assert table(store.rows()) == table(tree.rolled_up(left))
    plan = store.rows()._jdf.queryExecution().toString()
    assert "dev#" not in plan and "ino#" not in plan  # the entries are not read
    monkeypatch.setattr(stored, "MOST", 1)
    more = next(r[0] for r in rows if r[0].startswith("/t/b/"))
    assert store.remove(more) and store.removed() == [more]
    assert table(store.rows()) == table(tree.rolled_up(tree.remove_subtree(left, more)))


def test_links_over_batches(spark, tmp_path):
    rows, dirs = entries(200, 3)
    everything = rows + dirs
    random.Random(5).shuffle(everything)
    for i in range(4):
        spark.createDataFrame(everything[i::4], ENTRY).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    stream = live.entry_stream(spark, f"{tmp_path}/in", ENTRY, "*.parquet", 1)
    live.to_table(links.link_deltas(stream), f"{tmp_path}/d", f"{tmp_path}/dc").awaitTermination()
    deltas = live.appended(spark, f"{tmp_path}/d", links.DELTA)
    marked = tree.mark_hard_links(spark.createDataFrame(everything, ENTRY))
    want = sorted(tuple(r) for r in tree.rollup(marked).select("path", "agg_apparent", "agg_allocated", "items").collect())
    assert table(links.rollup_of_deltas(deltas)) == want
    assert deltas.where("apparent < 0").count() > 0 and len(os.listdir(f"{tmp_path}/d")) >= 4
    flags = live.latest(spark, f"{tmp_path}/d", links.DELTA, ["path"])
    assert {(r["path"], r["linked"], r["dup"]) for r in flags.collect()} == {(r["path"], r["hardlinked"], r["hardlink_dup"]) for r in marked.collect()}


def test_links_call_python_for_a_bucket_and_leave_few_files(spark, tmp_path, monkeypatch):
    """a call for each linked file took longer than its links, and a file of each task made as many batches of sums."""
    rows, dirs = entries(200, 3)
    random.Random(5).shuffle(rows)
    for i in range(4):
        spark.createDataFrame(rows[i::4], ENTRY).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    flag = {}
    for buckets in (1, 256):
        monkeypatch.setattr(links, "BUCKETS", buckets)
        out = f"{tmp_path}/d{buckets}"
        query = live.to_table(links.link_deltas(live.entry_stream(spark, f"{tmp_path}/in", ENTRY, "*.parquet", 1)), out, f"{out}-c", few=True)
        query.awaitTermination()
        assert buckets > 1 or max(p["stateOperators"][0]["numRowsTotal"] for p in query.recentProgress) == 1
        parts = [f for b in os.listdir(out) if b.startswith("batch=") for f in os.listdir(f"{out}/{b}") if f.endswith(".parquet")]
        assert len(parts) == 4
        flag[buckets] = sorted(tuple(r) for r in live.appended(spark, out, links.DELTA).collect())
    assert flag[1] == flag[256]
    marked = tree.mark_hard_links(spark.createDataFrame(rows, ENTRY))
    want = sorted(tuple(r) for r in tree.rollup(marked).select("path", "agg_apparent", "agg_allocated", "items").collect())
    assert table(links.rollup_of_deltas(live.appended(spark, f"{tmp_path}/d1", links.DELTA))) == want


def test_progress_is_throttled_and_the_last_is_told(spark, tmp_path):
    for i in range(5):
        spark.range(i * 10, i * 10 + 10).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    told = []
    listener = ProgressListener(told.append, millis=3_600_000, log=LogRing(4), total=50)
    spark.streams.addListener(listener)
    try:
        stream = spark.readStream.schema("id long").option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
        live.to_table(stream, f"{tmp_path}/t", f"{tmp_path}/c").awaitTermination()
        spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(30_000)
        for _ in range(100):
            if told and told[-1]["state"] == "ended":
                break
            import time

            time.sleep(0.1)
    finally:
        spark.streams.removeListener(listener)
    assert len(told) == 2 and told[0]["batches"] == 1 and told[-1]["state"] == "ended"
    assert (told[-1]["batches"], told[-1]["rows"], told[-1]["left"]) == (5, 50, 0.0)
    assert len(listener.log.lines()) == 4 and listener.log.dropped > 0 and listener.log.lines("info")[-1][1].endswith("ended")


def test_tables_are_replaced_at_once(spark, tmp_path, monkeypatch):
    path = f"{tmp_path}/table"
    assert files.load(spark, path, "id long") is None
    for n in (3, 5):
        files.save(spark.range(n), path)
        assert files.load(spark, path, "id long").count() == n
    monkeypatch.setattr(files, "switch", lambda *_: 1 / 0)
    with pytest.raises(ZeroDivisionError):  # a crash once the new table is written
        files.save(spark.range(7), path)
    assert files.load(spark, path, "id long").count() == 5
    monkeypatch.undo()
    files.save(files.load(spark, path, "id long").union(spark.range(1)), path)  # from itself
    assert files.load(spark, path, "id long").count() == 6


def test_the_newest_records_without_an_order_of_all(spark, tmp_path):
    path = f"{tmp_path}/journal"
    for i in range(4):
        files.append_journal(spark.createDataFrame([(9, "delete", f"/f{i}_{j}", None, 1, "ok", None) for j in range(5)], files.JOURNAL), path)
    tail = files.journal_tail(spark, path, 7)
    assert [r["path"] for r in tail.collect()] == [f"/f{i}_{j}" for i in (3, 2) for j in (4, 3, 2, 1, 0)][:7]
    plan = tail._jdf.queryExecution().executedPlan().toString()
    assert "TakeOrderedAndProject" in plan and "Exchange" not in plan
    assert files.journal_tail(spark, f"{tmp_path}/none").count() == 0


def test_roots_are_spared_by_exclusion(spark, tmp_path, capsys):
    top = tmp_path / "build/x"
    (top / "build/deep").mkdir(parents=True)
    for name in ("a.bin", "b.bin", "build/c.bin", "build/deep/d.bin"):
        (top / name).write_bytes(b"z" * 2_000_000)
    left = lambda globs, root=top: sorted(r["path"].removeprefix(str(top)) for r in filters.split_sizes(scan(spark, [str(root)]), 1, [], globs).collect())
    assert left(["build"]) == ["/a.bin", "/b.bin"]
    assert left([str(top)]) == left([str(tmp_path)]) == ["/a.bin", "/b.bin", "/build/c.bin", "/build/deep/d.bin"]
    assert left([f"{tmp_path}*"]) == []  # a glob that matches what lies below a root does drop it
    assert left([f"{top}/build"]) == ["/a.bin", "/b.bin"] and left(["deep", "b.*"]) == ["/a.bin", "/build/c.bin"]
    assert left(["build"], top / "build") == ["/build/c.bin", "/build/deep/d.bin"]
    lone = scan(spark, [str(top / "a.bin")], leaf_roots=True)
    assert filters.split_sizes(lone, 1, [], ["*.bin"]).count() == 0 and filters.split_sizes(lone, 1, [], ["x"]).count() == 1
    out = type("Out", (list,), {"write": list.append, "flush": lambda _: None})()
    assert cli.run(["dup", str(top), "--exclude", "build"], spark, out) == 0 and any("a.bin" in x for x in out)


def test_places_in_a_huge_directory_need_no_window(spark):
    rows = spark.range(5000).select(F.concat(F.lit("/r/d/f"), "id").alias("path"), F.lit("File").alias("kind"), (F.col("id") % 7).alias("agg_allocated"), F.col("id").alias("agg_apparent"), F.lit(0).cast("long").alias("items"))
    tops = spark.createDataFrame([("/r", "Dir", 9, 9, 5001), ("/r/d", "Dir", 9, 9, 5000)], "path string, kind string, agg_allocated long, agg_apparent long, items long")
    found = tree.preorder(rows.unionByName(tops), "/r", 2)
    assert "Window" not in found._jdf.queryExecution().optimizedPlan().toString()
    want = ["/r", "/r/d", *(f"/r/d/f{i}" for i in sorted(range(5000), key=lambda i: (i % 7, f"f{i}"), reverse=True))]
    assert [r["path"] for r in found.orderBy("position").collect()] == want


def test_quarantine_folders_and_their_guard(spark):
    q = ".fathomry-quarantine"
    rows = [(f"/v/{q}", "Dir", 1), (f"/v/{q}/s", "Dir", 1), (f"/v/{q}/s/a", "File", 1), (f"/v/{q}/s/b", "File", 2), (f"/w/{q}", "Symlink", 1), (f"/v/x/{q}", "Dir", 1), ("/v/x", "Dir", 1), (f"/{q}", "Dir", 1)]
    df = spark.createDataFrame(rows, "path string, kind string, nlink int").withColumn("allocated", F.lit(512).cast("long"))
    volumes = spark.createDataFrame([("/v",), ("/w",), ("/",)], "mount string")
    assert sorted(map(tuple, ops.quarantine_folders(volumes, df).collect())) == [(f"/{q}", 0, 0), (f"/v/{q}", 3, 1024)]
    asked = spark.createDataFrame([(f"/v/{q}",), ("/v/x",), (f"/w/{q}",), (f"/z/{q}",), (f"/v/{q}/s",), ("/",)], "path string")
    assert {r["path"]: r["refused"] for r in ops.emptying(asked, df).collect()} == {f"/v/{q}": None, "/v/x": "not a quarantine directory", f"/w/{q}": "not a directory", f"/z/{q}": "no longer exists", f"/v/{q}/s": "not a quarantine directory", "/": "not a quarantine directory"}


def test_projects_over_batches(spark, tmp_path):
    """Markers before and after what they claim, an artifact before its lockfile, and a project that is withdrawn."""
    from fathomry.operators import buildtrees
    from fathomry.sources.rules import builtin
    from fathomry.streaming.projects import ENTRY as LIVE
    from fathomry.streaming.projects import LiveProjects

    file = lambda path, n=512: (path, "File", n, n, 1, None, None, 100 + n)
    folder = lambda path: (path, "Dir", 0, 4096, 1, None, None, 0)
    batches = [
        [folder("/w"), folder("/w/a"), folder("/w/a/target"), file("/w/a/target/x", 2000), file("/w/a/src.rs", 300), folder("/w/b"), file("/w/b/package.json")],
        [file("/w/a/Cargo.toml"), folder("/w/b/node_modules"), file("/w/b/node_modules/m.js", 4000), file("/w/c.txt")],
        [folder("/w/b/node_modules/in"), file("/w/b/node_modules/in/package.json"), file("/w/b/yarn.lock"), file("/w/a/more.rs", 700), folder("/w/d"), folder("/w/d/target")],
        [file("/w/package.json"), file("/w/d/readme")],
    ]
    rules, kept = builtin(), LiveProjects(spark, f"{tmp_path}/p", builtin())
    seen = []
    key = lambda df: sorted(tuple(r) for r in df.select("path", "name", "artifact_size", "source_size", "last_source_mtime").collect())
    for n, rows in enumerate(batches):
        seen += rows
        batch = spark.createDataFrame(rows, LIVE)
        kept.upkeep(batch, n)
        if n == 1:
            kept.upkeep(batch, n)  # a batch that is repeated
        want = buildtrees.analyze(spark.createDataFrame(seen, LIVE), rules)
        assert key(kept.projects()) == key(want["projects"]), n
        assert sorted(r["path"] for r in kept.artifacts().collect()) == sorted(r["path"] for r in want["artifacts"].collect())
    told = {(r["batch"], r["path"], r["change"]) for r in kept.changes().collect()}
    assert (0, "/w/b", "new") in told and (2, "/w/a", "changed") in told and (3, "/w", "new") in told


def test_flags_of_the_command_line(spark, tmp_path):
    import io
    import json

    top = tmp_path / "top"
    (top / "p").mkdir(parents=True)
    (top / "p/Cargo.toml").write_text("x")
    (tmp_path / "away").mkdir()
    (tmp_path / "away/f").write_text("abc")
    os.symlink(tmp_path / "away", top / "link")
    for i in range(3):
        (top / f"i{i}.png").write_bytes(bytes([i]) * 50)
    spark.createDataFrame([(f"{top}/i0.png", 7, 1, 10, 10), (f"{top}/i1.png", 5, 1, 20, 10), (f"{top}/i2.png", -1, 1, 10, 10)], "path string, dhash long, phash long, width int, height int").write.parquet(f"{tmp_path}/hashes")

    def said(*argv):
        out = io.StringIO()
        assert cli.run(list(argv), spark, out) == 0
        return out.getvalue()

    assert all("mount" in v for v in json.loads(said("volumes", "--json")))
    assert "away" not in said("scan", str(top), "--largest", "9") and f"{top}/link/f" in said("scan", str(top), "--largest", "9", "--follow-symlinks", "--cross-filesystems")
    assert json.loads(said("dev", str(top), "--json"))[0]["path"] == f"{top}/p"
    assert f"like {top}/i0.png (1 bits)" in said("dup", str(top), "--min-size", "1", "--similar", "2", "--hashes", f"{tmp_path}/hashes")
    document = json.loads(said("dup", str(top), "--min-size", "1", "--similar", "2", "--hashes", f"{tmp_path}/hashes", "--json"))
    assert "i1.png" in json.dumps(document) and "i2.png" not in json.dumps(document)
    assert cli.run(["dup", str(top), "--similar", "2"], spark, io.StringIO()) == 2
    files.append_journal(spark.createDataFrame([(9, "delete", "/f", None, 1, "ok", None)], files.JOURNAL), f"{tmp_path}/j")
    assert json.loads(said("journal", f"{tmp_path}/j", "--json"))[0]["path"] == "/f"


def test_a_view_refuses_what_is_gone(spark, tmp_path):
    from fathomry.operators.layout import View

    rows = [("/r", "Dir"), ("/r/a", "Dir"), ("/r/a/b", "Dir"), ("/r/a/b/f", "File"), ("/r/ab", "Dir")]
    df = spark.createDataFrame([(p, k, 5 * (k == "File"), 5 * (k == "File"), 1, None, None) for p, k in rows], ENTRY)
    store = StoredRollup.create(tree.mark_hard_links(df), f"{tmp_path}/r")
    view = View("/r", "/r/a/b/f")
    assert view.zoomed(store.rows(), "/r/a") == View("/r/a", "/r/a/b/f") and view.zoomed(store.rows(), "/r/ab") == View("/r/ab")
    assert View("/r", "/r/a").zoomed(store.rows(), "/r/a") == View("/r/a") and view.zoomed(store.rows(), "/r/a/b/f") == view == view.zoomed(store.rows(), "/r")
    assert View("/r/a").up(store.rows(), "/r") == View("/r") and View("/r").up(store.rows(), "/r") == View("/r")
    assert View("/r").revealing(store.rows(), "/r/a/b/f") == View("/r/a/b", "/r/a/b/f")
    store.remove("/r/a/b")
    assert view.zoomed(store.rows(), "/r/a/b") == view == view.revealing(store.rows(), "/r/a/b/f")


def test_displays_and_diagnostics(spark, monkeypatch, tmp_path):
    import io

    from fathomry.operators import dedup

    monkeypatch.setitem(filters.SHOWN, "errors", 3)
    for n, more in ((2, False), (3, False), (4, True)):
        rows, truncated = filters.shown(spark.range(n), "errors", F.desc("id"))
        assert [r["id"] for r in rows.collect()] == list(range(n))[::-1][:3] and truncated is more
    with pytest.raises(KeyError):
        dedup.keep_rule(spark.createDataFrame([("/a", 1, "h", 1)], "path string, size long, hash string, mtime long"), "none")
    assert set(dedup.KEEP_RULES) == {"oldest", "newest", "shortest", "folder", "resolution"}
    (tmp_path / "d").mkdir()
    out = io.StringIO()
    assert cli.run(["diagnostics", str(tmp_path)], spark, out) == 0
    assert "Scan: 0 files, 2 dirs, 0 errors" in out.getvalue() and out.getvalue().endswith("Log:\n")
