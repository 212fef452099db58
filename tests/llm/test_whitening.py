"""Whitening against exact whole numbers and numpy."""

import math
import os

import numpy as np
import pytest

from fathomry.llm import whitening

SF = "/root/testdata/sf0.001"


def by_hand(rows):
    """vec_id, x of the rows that take part; n, sums, covariance from exact deviations."""
    sound = [(i, v) for i, v in rows if v and all(c is not None and math.isfinite(c) for c in v)]
    x = [[math.floor(1024 * float(c)) + 100000 for c in v] for _, v in sound]
    n, sums = len(x), [sum(c) for c in zip(*x, strict=True)]
    y = [[n * c - s for c, s in zip(r, sums, strict=True)] for r in x]
    cov = np.array([[sum(r[i] * r[j] for r in y) / n**3 for j in range(len(sums))] for i in range(len(sums))])
    return [i for i, _ in sound], n, y, cov


def check(found, rows):
    ids, n, y, cov = by_hand(rows)
    values, vectors = np.linalg.eigh(cov)
    values, vectors = values[::-1], vectors[:, ::-1]
    got = {}
    for r in found:
        got.setdefault(r["vec_id"], {})[r["component"]] = r
    assert sorted(got) == sorted(ids) and len(found) == len(ids) * min(8, len(cov))
    for i, dev in zip(ids, y, strict=True):
        for k, r in got[i].items():
            assert r["n"] == n and r["deviation"] == sum(v * v for v in dev)
            assert r["explained"] == pytest.approx(values[k - 1] / np.trace(cov), rel=1e-9)
            assert abs(r["whitened"]) == pytest.approx(abs(np.array(dev, float) / n @ vectors[:, k - 1]) / math.sqrt(values[k - 1]), abs=1e-6)
    z = np.array([[got[i][k]["whitened"] for k in sorted(got[i])] for i in ids])
    assert np.abs(z.T @ z / n - np.eye(z.shape[1])).max() < 1e-8 and found[0]["identity_error"] < 1e-8


@pytest.mark.skipif(not os.path.isdir(SF), reason="no tables")
def test_whole_table(spark):
    rows = [(r["vec_id"], r["embedding"]) for r in spark.read.parquet(f"{SF}/embeddings.parquet").collect()]
    check(whitening.op13_whitening(spark, SF).collect(), rows)


def test_rows_that_take_no_part(spark, tmp_path):
    rng = np.random.default_rng(3)
    rows = [(i, [float(v) for v in rng.normal(size=5) * (1, 5, 0.1, 30, 2)]) for i in range(40)]
    rows += [(40, None), (41, [1.0, None, 2.0, 3.0, 4.0]), (42, [math.nan] * 5), (43, [math.inf, 1.0, 1.0, 1.0, 1.0]), (44, [])]
    short = [(50, [1.0, 2.0]), (51, [1e300] * 5)]
    df = spark.createDataFrame([(i, v, 1) for i, v in rows + short], "vec_id long, embedding array<double>, x int")
    df.write.parquet(f"{tmp_path}/embeddings.parquet")
    check(whitening.op13_whitening(spark, str(tmp_path)).collect(), rows)
    points = whitening.usable(df.withColumnRenamed("x", "deviation"))
    assert set(whitening.transform(points, whitening.fit(points), 2).columns) == {"vec_id", "deviation", "whitened"}


def test_wide_entries_and_repeated_ids(spark, tmp_path):
    rng = np.random.default_rng(4)
    rows = [(i, [float(v) for v in rng.normal(size=3) * 3e14]) for i in range(30)]
    spark.createDataFrame(rows, "vec_id long, embedding array<double>").write.parquet(f"{tmp_path}/embeddings.parquet")
    found = whitening.op13_whitening(spark, str(tmp_path)).collect()
    ids, n, y, _ = by_hand(rows)
    assert len(found) == 90 and found[0]["identity_error"] < 1e-8
    want = {i: sum(v * v for v in d) for i, d in zip(ids, y, strict=True)}
    assert all(r["deviation"] == (want[r["vec_id"]] if want[r["vec_id"]] < 2**63 else None) for r in found)
    assert whitening.deviations(np.array([[3, 4], [2**31, 2**31]])) == [25, None]


@pytest.mark.parametrize("vectors", [[], [[1.0, 2.0]], [[1.0, 2.0]] * 5, [[float(i), 2.0 * i] for i in range(6)]])
def test_little_or_no_variance(spark, tmp_path, vectors):
    spark.createDataFrame([(None if i == 1 else 2**60 + 1, v) for i, v in enumerate(vectors)], "vec_id long, embedding array<double>").write.parquet(f"{tmp_path}/embeddings.parquet")
    found = whitening.op13_whitening(spark, str(tmp_path)).collect()
    assert len(found) == 2 * len(vectors) and {r["vec_id"] for r in found} <= {None, 2**60 + 1}
    if len(vectors) == 6:  # one direction only
        assert all((r["whitened"] is None) == (r["component"] == 2) for r in found) and found[0]["identity_error"] < 1e-8
    else:
        assert all(r["whitened"] is None and r["explained"] is None and r["deviation"] == 0 for r in found)
