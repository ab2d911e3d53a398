"""Poisson bootstrap: every record has a weight in each resample, which follows from the record and the resample alone, so
that all resamples are one pass and one sum, whatever the partitions are and however often a task runs."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A prime below 2^31; products of two residues fit 64 bits. Multipliers of id and resample.
PRIME, BY_ID, BY_SAMPLE, MIX = 2147483647, 48271, 69621, 1664525
#: Whole numbers of a Poisson variable of mean 1 come from where a residue falls among these, in billionths of the prime.
POISSON = (367879441, 735758882, 919698603, 981011843, 996340153, 999405815, 999916759, 999989751)


def weights(ids: np.ndarray, samples: np.ndarray, seed: int = 42) -> np.ndarray:
    """Weights of records (rows) in resamples (columns)."""
    u = ((ids % PRIME)[:, None] * BY_ID + samples[None, :] * BY_SAMPLE + seed) % PRIME
    for _ in range(3):
        u = (u * u + MIX) % PRIME
        u = (u * BY_ID) % PRIME
    return np.searchsorted(np.array([c * PRIME // 10**9 for c in POISSON]), u, "right")


def weight_sql(id_: str, sample: str, seed: int = 42) -> str:
    """The same weight in SQL, of whole non-negative ids."""
    u = f"(({id_} % {PRIME}) * {BY_ID} + {sample} * {BY_SAMPLE} + {seed}) % {PRIME}"
    for _ in range(3):
        u = f"(list_transform([{u}], lambda u: ((u * u + {MIX}) % {PRIME} * {BY_ID}) % {PRIME}))[1]"
    return f"(list_transform([{u}], lambda u: {' + '.join(f'(u >= {c * PRIME // 10**9})::INT' for c in POISSON)}))[1]"


def resampled(rows: DataFrame, id_col: str, columns: list[str], n: int, seed: int = 42) -> DataFrame:
    """(sample, the columns' weighted sums) for samples 1 to n, and sample 0 with all weights 1. Columns are whole numbers. A
    task keeps n sums of each column."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, samples, seen = np.zeros((n + 1, len(columns)), np.int64), np.arange(1, n + 1, dtype=np.int64), False
        for batch in batches:
            seen = seen or batch.num_rows > 0
            for at in range(0, batch.num_rows, 1024):
                part = batch.slice(at, 1024)
                x = np.stack([part.column(k + 1).to_numpy() for k in range(len(columns))], axis=1).astype(np.int64)
                total[0] += x.sum(axis=0)
                total[1:] += weights(part.column(0).to_numpy(), samples, seed).T @ x
        if seen:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(n + 1, dtype=np.int64)), *(pa.array(np.ascontiguousarray(c)) for c in total.T)], ["sample", *columns])

    given = rows.select(F.col(id_col).cast("long").alias("id"), *[F.col(c).cast("long").alias(c) for c in columns])
    sums = given.mapInArrow(run, ", ".join(f"{c} long" for c in ("sample", *columns)))
    return sums.groupBy("sample").agg(*[F.sum(c).alias(c) for c in columns])
