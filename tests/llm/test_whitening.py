"""Whitening against a dense eigendecomposition, with degenerate and odd tables."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from graphspark.llm import embedding_whitening as W
from graphspark.llm import queries

SCHEMA = "vec_id long, embedding array<float>, n int, x string, component int, label int"


def table(spark, vectors, ids=None):
    return spark.createDataFrame([(i if ids is None else ids[i], None if v is None else [None if c is None else float(c) for c in v], 1, "x", 2, 3) for i, v in enumerate(vectors)], SCHEMA)


def dense(vectors, components=8):
    x = (np.floor(1024 * np.array(vectors, np.float32).astype(float)) + 100_000).astype(np.int64)
    n, sums = len(x), x.sum(0)
    a = x - sums / n
    e, q = np.linalg.eigh(a.T @ a / n)
    e, q = e[::-1], q[:, ::-1]
    k = min(components, int((e > 1e-9 * max(e[0], 1e-300)).sum()))
    return a @ q[:, :k] / np.sqrt(e[:k]), e[:k] / e.sum(), ((n * x - sums) ** 2).sum(1), e


def rows_of(df):
    rows = sorted(df.collect(), key=lambda r: (r.vec_id, r.component))
    k = max((r.component for r in rows), default=0)
    return rows, np.array([r.whitened for r in rows]).reshape(-1, k) if k else np.zeros((0, 0))


def test_given_table(spark):
    rows = spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet").orderBy("vec_id").collect()
    want, explained, deviation, _ = dense([r.embedding for r in rows])
    got, z = rows_of(queries.op12_whitening(spark, "/root/testdata/sf0.001"))
    z = z * np.sign((z * want).sum(0))
    assert np.abs(z - want).max() < 1e-9 and [r.deviation for r in got[::8]] == deviation.tolist() and {r.n for r in got} == {len(rows)}
    assert np.allclose([r.explained for r in got[:8]], explained, rtol=1e-12) and {r.identity_error for r in got} and got[0].identity_error < 1e-9


@pytest.mark.parametrize("kind", ["equal eigenvalues", "low rank", "constant dimension", "few rows", "wide spread", "one dimension"])
def test_degenerate(spark, kind):
    rng = np.random.default_rng(1)
    vectors = {
        "equal eigenvalues": np.concatenate([np.eye(6), -np.eye(6)]) * 3, "low rank": np.round(rng.standard_normal((60, 3)) * 64) / 64 @ rng.integers(-3, 4, (3, 12)), "constant dimension": np.concatenate([rng.standard_normal((40, 4)), np.ones((40, 2))], 1),
        "few rows": rng.standard_normal((4, 10)), "wide spread": rng.standard_normal((80, 9)) * 10.0 ** np.arange(4, -5, -1), "one dimension": rng.standard_normal((7, 1)),
    }[kind]
    want, explained, deviation, values = dense(vectors)
    got, z = rows_of(W.whiten(table(spark, vectors)))
    assert len(z) == len(want) and (z.shape == want.shape or kind == "wide spread") and [r.deviation for r in got[:: z.shape[1]]] == deviation.tolist() and got[0].identity_error < 1e-4
    k = want.shape[1]  # eigenvalues that a dense decomposition can tell
    z = z[:, :k]
    assert np.allclose([r.explained for r in got[:k]], explained, rtol=1e-6)
    if kind not in ("equal eigenvalues",):
        gaps = np.abs(np.diff(values[: z.shape[1] + 1])) > 1e-3 * values[: z.shape[1]] if len(values) > z.shape[1] else np.ones(z.shape[1], bool)
        z = z * np.sign((z * want).sum(0))
        assert np.abs(z - want)[:, gaps].max() < 1e-6


def test_odd_tables(spark):
    rng = np.random.default_rng(2)
    good = [list(map(float, v)) for v in rng.standard_normal((30, 3))]
    odd = [None, [], [1.0, None, 2.0], [float("nan"), 0.0, 1.0], [float("inf"), 0.0, 1.0], [1.0, 2.0]]
    got, z = rows_of(W.whiten(table(spark, good + [good[0]] + odd, ids=[*range(30), 0, *range(100, 106)])))
    want, *_ = dense(good + [good[0]])
    assert len(got) == 31 * 3 and {r.n for r in got} == {31} and {r.vec_id for r in got} == set(range(30)) and np.abs(np.sort(np.abs(z).ravel()) - np.sort(np.abs(want).ravel())).max() < 1e-9
    assert W.whiten(table(spark, good).withColumn("vec_id", F.lit(None).cast("long"))).where("vec_id IS NULL").count() == 90
    for vectors in ([], odd[:2], good[:1], [good[0]] * 5):
        assert W.whiten(table(spark, vectors)).count() == 0
    assert W.whiten(table(spark, good)).columns == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]


def test_exact_sums_and_wide_deviations(spark):
    rng = np.random.default_rng(3)
    vectors = rng.standard_normal((50, 2)) * 1e9
    blocks, dims = W.blocks_of(table(spark, vectors))
    x = (np.floor(1024 * vectors.astype(np.float32).astype(float)) + 100_000).astype(np.int64)
    n, sums = W.exact_sums(blocks, dims)
    assert n == 50 and sums == [sum(map(int, x[:, k])) for k in range(2)]
    exact = [sum((50 * int(c) - s) ** 2 for c, s in zip(r, sums)) for r in x]
    assert W.Whitening(50, sums, np.zeros((2, 0)), np.zeros(0), 0.0).deviations(x) == [v if v < 1 << 63 else None for v in exact]
