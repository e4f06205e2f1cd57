"""Hard negatives against all pairs, and the threshold join against plain products."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from graphspark.llm import hard_negatives as H

SCHEMA = "vec_id long, label int, embedding array<float>, rows int, win string, score string, y string, id int"


@pytest.mark.parametrize("spread", [0.0, 0.15, 0.6])
@pytest.mark.parametrize("share", [0.9, 0.5, 0.05, -0.2])
def test_threshold_join(spread, share):
    """Whatever is left out of the index, each pair that reaches its threshold is found once, with its score."""
    rng = np.random.default_rng(7)
    y = np.floor(rng.standard_normal((700, 40)) * 200 * np.exp(-spread * np.arange(40)) * rng.lognormal(0, 1, (700, 1))).astype(np.int64)
    asked = y[rng.integers(0, 700, 300)]
    whole = y @ asked.T
    least = np.quantile(whole, 0.999, axis=0) * share if share > 0 else np.where(np.arange(300) % 2, -np.inf, whole.max(0) * 0.3)
    got = [(i, j, s) for a, b, c in H.threshold_pairs(y, asked, np.asarray(least, float)) for i, j, s in zip(a, b, c)]
    i, j = np.nonzero(whole >= least)
    assert sorted(got) == sorted(zip(i, j, whole[i, j])) and len(got)


def plain(rows, anchors, positives=5, negatives=10):
    dims = max((len(v) for _, _, v in rows), default=0)
    rows = [(i, c, np.floor(256 * np.array(v, np.float32).astype(float)).astype(np.int64)) for i, c, v in rows if len(v) == dims]
    out = []
    for n, (a, label, v) in enumerate(rows):
        if a is None or not anchors(a):
            continue
        scored = sorted((-int(v @ w), 1 << 63 if i is None else i, c == label) for m, (i, c, w) in enumerate(rows) if m != n)
        for s, p, _ in [x for x in scored if x[2]][:positives]:
            inside = [(x, i) for x, i, same in scored if not same and 30 * -s <= 100 * -x <= 90 * -s][:negatives]
            out += [(a, None if p == 1 << 63 else p, k + 1, None if i == 1 << 63 else i, -s, -x) for k, (x, i) in enumerate(inside)]
    return sorted(out, key=str)


def run(spark, rows, anchors, **more):
    table = spark.createDataFrame([(i, c, None if v is None else [None if x is None else float(x) for x in v], 1, "w", "s", "y", 2) for i, c, v in rows], SCHEMA)
    return sorted((tuple(r) for r in H.mine(table, anchors, **more).collect()), key=str)


def test_equals_all_pairs(spark, monkeypatch):
    rng = np.random.default_rng(9)
    centres = rng.standard_normal((4, 12))
    rows = [(i, int(c), (centres[c] * 0.5 + rng.standard_normal(12) * 0.6).astype(np.float32).tolist()) for i, c in enumerate(rng.integers(0, 4, 900))]
    rows += [(2_000 + i, r[1], r[2]) for i, r in enumerate(rows[:40])] + [(3_000 + i, 3 - r[1], r[2]) for i, r in enumerate(rows[:40])]  # ties
    rows.append((None, 1, rows[5][2]))
    want = plain(rows, lambda i: i % 20 == 0)
    assert run(spark, rows, F.col("vec_id") % 20 == 0) == want and len({r[0] for r in want}) > 20
    monkeypatch.setattr(H, "ANCHORS", 7)  # several blocks of anchors
    assert run(spark, rows[:300], F.col("vec_id") % 20 == 0) == plain(rows[:300], lambda i: i % 20 == 0)


def test_odd_tables(spark):
    rows = [(0, 1, [1.0, 0.5]), (0, 1, [1.0, 0.5]), (1, 1, [0.9, 0.4]), (2, 2, [0.5, 0.25]), (3, 2, [0.25, 0.1]), (None, 2, [0.5, 0.3])]
    odd = [(4, None, [1.0, 1.0]), (5, 2, None), (6, 2, [1.0, None]), (7, 2, [float("nan"), 1.0]), (8, 2, []), (9, 2, [0.5, 0.5, 0.5])]
    got = run(spark, rows + odd, F.col("vec_id") == 0)
    assert got == plain(rows, lambda i: i == 0) and {r[0] for r in got} == {0} and None in {r[3] for r in got}
    assert run(spark, [(0, 1, [1.0, 0.0]), (1, 1, [-1.0, 0.0]), (2, 2, [-0.5, 0.0])], F.col("vec_id") == 0) == []  # a positive below 0
    assert run(spark, [(0, 1, [1.0, 0.0]), (1, 2, [1.0, 0.0])], F.col("vec_id") == 0) == []  # no other row of the label
    assert run(spark, rows, F.lit(None).cast("boolean")) == [] and run(spark, [], F.lit(True)) == [] and run(spark, odd[:3], F.lit(True)) == []
    big = [(0, 1, [3e4, 1e4]), (1, 1, [2.9e4, 1e4]), (2, 2, [2e4, 1e4]), (3, 2, [2e4, 1.0])]
    assert run(spark, big, F.col("vec_id") == 0) == plain(big, lambda i: i == 0) != []
