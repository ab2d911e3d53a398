"""Logistic regression whose sums are Spark aggregations, for all folds of groups at once."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def fold_of(group: Column, k: int) -> Column:
    """The fold of a whole group, 0 to k - 1; rows without a group share one."""
    return F.pmod(F.xxhash64(F.coalesce(group.cast("string"), F.lit(""))), F.lit(k)).cast("int")


def moments(rows: DataFrame, d: int) -> tuple[np.ndarray, np.ndarray]:
    """Means and standard deviations (1 where a feature does not vary) of ``features``."""
    parts = [f(F.col("features")[i]).alias(f"{name}{i}") for i in range(d) for name, f in (("m", F.avg), ("s", F.stddev_pop))]
    r = rows.agg(*parts).first()
    return np.array([r[f"m{i}"] or 0.0 for i in range(d)]), np.array([r[f"s{i}"] or 1.0 for i in range(d)])


def _sums(rows: DataFrame, w: np.ndarray, mean: np.ndarray, sd: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Gradients and curvatures of the log-likelihood of each fold's training rows, those of the other folds. A task gives
    one number for each fold and pair of features, and so does the shuffle."""
    k, d = w.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        g, h = np.zeros((k, d)), np.zeros((k, d, d))
        for batch in batches:
            if not batch.num_rows:
                continue
            x = (batch.column(0).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, d - 1) - mean) / sd
            x = np.concatenate((x, np.ones((len(x), 1))), axis=1)
            y, fold = batch.column(1).to_numpy(), batch.column(2).to_numpy()
            for f in range(k):
                a, b = x[fold != f], y[fold != f]
                p = 1 / (1 + np.exp(-np.clip(a @ w[f], -30, 30)))
                g[f] += a.T @ (b - p)
                h[f] += (a * (p * (1 - p))[:, None]).T @ a
        values = np.concatenate((g[:, None, :], h), axis=1)
        place = np.indices(values.shape).reshape(3, -1)
        yield pa.RecordBatch.from_arrays([*(pa.array(c.astype(np.int32)) for c in place), pa.array(values.ravel())], ["f", "i", "j", "v"])

    parts = rows.select("features", F.col("label").cast("double"), "fold").mapInArrow(run, "f int, i int, j int, v double")
    out = np.zeros((k, d + 1, d))
    for r in parts.groupBy("f", "i", "j").agg(F.sum("v").alias("v")).collect():  # folds times features squared
        out[r["f"], r["i"], r["j"]] = r["v"]
    return out[:, 0], out[:, 1:]


def logistic(rows: DataFrame, d: int, k: int, ridge: float = 1e-3, rounds: int = 30) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(coefficients of each fold, the last one the constant; means; deviations) for rows (features, label, fold): Newton
    steps, held by ``ridge`` to 0, each one aggregation. Features are standardised by all rows; null features are not
    allowed. Fold f learns from the rows of all other folds; fold k, if asked for by no row, from all."""
    mean, sd = moments(rows, d)
    w = np.zeros((k + 1, d + 1))
    held = ridge * np.eye(d + 1)
    for _ in range(rounds):
        g, h = _sums(rows, w, mean, sd)
        step = np.stack([np.linalg.solve(h[f] + held, g[f] - ridge * w[f]) for f in range(k + 1)])
        w += np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-10:
            break
    return w, mean, sd


def predicted(rows: DataFrame, w: np.ndarray, mean: np.ndarray, sd: np.ndarray, fold: Column) -> DataFrame:
    """Adds ``p``, by the model of the row's ``fold``."""
    d = len(mean)
    z = F.lit(None).cast("double")
    for f, own in enumerate(w):
        terms = sum(((F.col("features")[i] - float(mean[i])) / float(sd[i]) * float(own[i]) for i in range(d)), F.lit(float(own[d])))
        z = F.when(fold == f, terms).otherwise(z)
    return rows.withColumn("p", 1 / (1 + F.exp(-F.greatest(F.lit(-30.0), F.least(F.lit(30.0), z)))))
