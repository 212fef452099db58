"""Late reading of contents, comparison by chunks, and groups of similar images without their pairs."""

import random

import pytest
from pyspark.sql import functions as F

from fathomry.functions.hashing import full_key, partial_key
from fathomry.operators import dedup, graph, screen, similar


def files(spark, contents):
    rows = [(f"/f/{i}", len(c), i, 1, i, c) for i, c in enumerate(contents)]
    return spark.createDataFrame(rows, "path string, size long, mtime long, dev long, ino long, content string")


@pytest.mark.parametrize("keys", [1 << 30, 0])
def test_only_what_may_be_a_duplicate_is_read(spark, monkeypatch, keys):
    """With keys broadcast, and through the bitmap."""
    monkeypatch.setattr(screen, "KEYS", keys)
    long = ["a" * 100, "b" * 100, "a" * 100, "a" * 50 + "c" + "a" * 49]
    df = files(spark, [*long, *("x" * n for n in range(200, 260)), "", ""])
    found = dedup.identical_groups(df, partial_key("content", "size", 16), full_key("content"))
    assert sorted(r["path"] for r in found["full"].collect()) == ["/f/0", "/f/2", "/f/64", "/f/65"]
    read = {r["stage"]: (r["files"], r["bytes"]) for r in found["digested"].collect()}
    if keys:
        assert read == {"partial": (6, 4 * 32), "full": (5, 300)}  # nothing of the 60 unique sizes
    else:
        assert 6 <= read["partial"][0] < 66
    plan = found["full"]._jdf.queryExecution().optimizedPlan().toString()
    assert "content" not in plan


def test_the_bitmap_misses_nothing(spark, monkeypatch):
    rows = spark.range(20_000).select(F.concat(F.lit("k"), "id").alias("path"))
    wanted = rows.where("substring(path, 2) % 7 = 0")
    monkeypatch.setattr(screen, "KEYS", 0)
    passed = screen.among(rows, wanted, "path")
    n = wanted.count()
    assert passed.join(wanted, "path", "left_semi").count() == n and passed.count() < n + 2500 and passed.columns == ["path"]
    assert screen.among(rows, wanted.limit(0), "path").count() == 0


def test_comparison_by_chunks(spark):
    rng = random.Random(1)
    base = "".join(rng.choice("ab") for _ in range(60))
    contents = [base, base, base[:-1] + "X", base[:-1] + "X", base[:30] + "Y" + base[31:], "", "", "short", "short", "shorT"]
    df = files(spark, contents)
    groups = df.drop("content").withColumn("hash", F.lit("same"))
    want = {f"/f/{i}": f"/f/{contents.index(c)}" for i, c in enumerate(contents) if contents.count(c) > 1}
    for chunk in (1, 7, 60, 1000):
        assert {r["path"]: r["first"] for r in dedup.verified(groups, df, chunk=chunk).collect()} == want
    lost = df.withColumn("content", F.when(F.col("path") != "/f/1", F.col("content")))
    assert "/f/0" not in {r["path"] for r in dedup.verified(groups, lost, chunk=16).collect()}
    assert dedup.verified(groups.limit(0), df).count() == 0


def by_hand(rows, t):
    far = lambda x, y: max(bin((x[1] ^ y[1]) & (2**64 - 1)).count("1"), bin((x[2] ^ y[2]) & (2**64 - 1)).count("1"))
    root, top = {r[0]: r[0] for r in rows}, {}
    close = [(x[0], y[0], far(x, y)) for i, x in enumerate(rows) for y in rows[:i] if far(x, y) <= t]

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b, _ in close:
        a, b = sorted((find(a), find(b)))
        root[b] = a
    for a, _, d in close:
        top[find(a)] = max(top.get(find(a), 0), d)
    ends = {x for a, b, _ in close for x in (a, b)}
    return {(x, find(x), top[find(x)]) for x in ends}, len(close)


@pytest.mark.parametrize("part", [2048, 10])
def test_groups_without_pairs(spark, monkeypatch, part):
    monkeypatch.setattr(similar, "PART", part)
    rng = random.Random(part)
    signed = lambda h: h - 2**64 if h >= 2**63 else h
    rows = []
    for _ in range(6):  # dense groups, chains that leave their start, and loners
        d, p = rng.getrandbits(64), rng.getrandbits(64)
        rows += [(signed(d ^ (rng.getrandbits(64) & 0b1011)), signed(p ^ (rng.getrandbits(64) & 0b11))) for _ in range(30)]
        for step in range(12):
            rows.append((signed(d), signed(p)))
            d ^= 0b111 << (3 * step + 7)
        rows.append((signed(rng.getrandbits(64)), signed(rng.getrandbits(64))))
    rows = [(i, d, p) for i, (d, p) in enumerate(rows)]
    df = spark.createDataFrame(rows, "path long, dhash long, phash long")
    want, pairs = by_hand(rows, 4)
    found = similar.similar_groups(df, 4)
    assert {(r["path"], r["root"], r["max_distance"]) for r in found.collect()} == want
    edges = similar.links(df, 4).count()
    assert edges < pairs / 2 if part == 2048 else edges > 0
    named = df.withColumn("path", F.concat(F.lit("i"), F.lpad(F.col("path").cast("string"), 5, "0")))
    assert similar.similar_groups(named, 4).count() == len(want)
    assert similar.similar_groups(df.limit(0), 4).count() == 0


def test_a_dense_block_gives_a_link_a_hash(spark):
    rows = spark.range(1500).select("id", F.col("id").alias("dhash"), F.lit(0).cast("long").alias("phash"))
    edges = similar.links(rows, 11, key="id")
    assert edges.count() < 60_000  # of some 1,100,000 pairs
    one = similar.similar_groups(rows, 11, key="id").agg(F.count("*").alias("n"), F.count_distinct("root").alias("roots"), F.max("max_distance").alias("far")).first()
    assert tuple(one) == (1500, 1, 11)


def test_stages_are_removed(spark, tmp_path):
    import os

    df = graph.staged(spark.range(3), "gone")
    place = df._fathomry_path.removeprefix("file://")
    assert os.path.isdir(place) and df.count() == 3
    graph.dropped(df)
    assert not os.path.exists(place)
    before = set(os.listdir(os.path.dirname(place)))
    graph.connected(spark.range(50).select(F.col("id").alias("a"), (F.col("id") + 1).alias("b"))).count()
    assert len(set(os.listdir(os.path.dirname(place))) - before) == 1  # the last round's
