"""Resampling and regression against a single machine's."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessella.operators import learning, resampling
from tessella.plans.learning import same_bugs


def test_weights_are_poisson_and_independent():
    w = resampling.weights(np.arange(20_000), np.arange(1, 41)).astype(float)
    assert abs(w.mean() - 1) < 0.01 and abs(w.var() - 1) < 0.02
    assert [round(float((w == k).mean()), 2) for k in range(4)] == [0.37, 0.37, 0.18, 0.06]
    c = np.corrcoef(w.T)
    assert np.abs(c - np.eye(len(c))).max() < 0.05
    assert abs(np.corrcoef(w[:-1, 0], w[1:, 0])[0, 1]) < 0.03


def test_resamples_do_not_depend_on_partitions_and_agree_with_exact_ones(spark):
    rng = np.random.default_rng(1)
    y = rng.integers(0, 2, 600)
    a, b = (np.where(rng.random(600) < q, y, 1 - y) for q in (0.80, 0.74))
    rows = spark.createDataFrame([(i, 1, int(a[i] == y[i]), int(b[i] == y[i])) for i in range(600)], "id long, n int, a int, b int")
    once = sorted(map(tuple, resampling.resampled(rows.repartition(1), "id", ["n", "a", "b"], 2000).collect()))
    assert once == sorted(map(tuple, resampling.resampled(rows.repartition(7), "id", ["n", "a", "b"], 2000).collect()))
    assert once[0] == (0, 600, int((a == y).sum()), int((b == y).sum()))
    d = np.array([(r[2] - r[3]) / r[1] for r in once[1:]])
    right = (a == y).astype(int) - (b == y)
    exact = np.array([right[rng.integers(0, 600, 600)].mean() for _ in range(4000)])
    seen = right.mean()
    assert abs((np.abs(d - seen) >= abs(seen)).mean() - (np.abs(exact - seen) >= abs(seen)).mean()) < 0.03
    assert np.allclose(np.quantile(d, [0.025, 0.975]), np.quantile(exact, [0.025, 0.975]), atol=0.01)
    assert resampling.resampled(rows.limit(0), "id", ["n"], 5).count() == 0


def test_folds_of_groups_and_coefficients_equal_one_machine(spark):
    rng = np.random.default_rng(2)
    x = rng.standard_normal((500, 3)) * [1, 5, 0.1] + [0, 10, 3]
    y = (rng.random(500) < 1 / (1 + np.exp(-(x[:, 0] - 0.2 * (x[:, 1] - 10))))).astype(int)
    rows = [([float(v) for v in r], int(t), f"g{i % 23}") for i, (r, t) in enumerate(zip(x, y))]
    df = spark.createDataFrame(rows, "features array<double>, label int, g string").withColumn("fold", learning.fold_of(F.col("g"), 4))
    got = df.collect()
    fold = {}
    for r in got:
        assert fold.setdefault(r["g"], r["fold"]) == r["fold"]
    w, mean, sd = learning.logistic(df.repartition(5), 3, 4, ridge=0.5)
    xs = (np.array([r["features"] for r in got]) - mean) / sd
    xs = np.concatenate((xs, np.ones((len(xs), 1))), axis=1)
    ys, fs = np.array([r["label"] for r in got]), np.array([r["fold"] for r in got])
    assert np.allclose(mean, x.mean(axis=0)) and np.allclose(sd, x.std(axis=0))
    for f in range(5):
        a, b, v = xs[fs != f], ys[fs != f], np.zeros(4)
        for _ in range(4000):  # plain gradient steps, another way to the same point
            v += (a.T @ (b - 1 / (1 + np.exp(-a @ v))) - 0.5 * v) / (len(a) / 4 + 0.5) * 0.8
        assert np.allclose(w[f], v, atol=1e-6)
    p = np.array([r["p"] for r in learning.predicted(df, w, mean, sd, F.col("fold")).select("p").collect()])
    assert p.min() > 0 and np.corrcoef(p, [r["label"] for r in df.collect()])[0, 1] > 0.3


def test_shared_bugs_by_hand(spark):
    o = [
        (1, "t1", " 42 ", "41", None, False), (2, "t1", "42", "41", "", None),  # the same wrong output
        (1, "t2", "Ok", "ok", None, False), (2, "t2", "OK", "ok", None, False),  # right
        (1, "t3", "", None, "ValueError", False), (2, "t3", "x", "y", "ValueError", False),
        (1, "t4", "", None, "KeyError", True), (2, "t4", "", None, "KeyError", True),  # late comes first
        (1, "t5", "7", None, None, False), (2, "t5", "7", "8", None, False),  # nothing is known to be expected
        (1, "t6", "a", "b", None, False), (3, "t6", "a", "b", None, False),
    ]
    outcomes = spark.createDataFrame(o, "id long, test string, output string, expected string, exception string, timed_out boolean")
    got = {(r["id_a"], r["id_b"]): r for r in same_bugs(spark.createDataFrame([(1, 2), (1, 3), (2, 3)], "id_a long, id_b long"), outcomes).collect()}
    assert set(got) == {(1, 2), (1, 3)}
    r = got[1, 2]
    assert (r["shared"], r["timeouts"], r["exceptions"], r["outputs"]) == (5, 1, 1, 1) and r["score"] == pytest.approx(2.7 / 5)
    assert got[1, 3]["score"] == 1.0
