"""MinHash signatures and banded locality-sensitive hashing, in 64-bit integer arithmetic.

``PERMUTATIONS`` minima in bands of ``ROWS``: a pair of similarity s shares a band with a chance of 1 - (1 - s^10)^20,
which is 0.9 at ``LEAST`` = 0.8 and 0.02 at one half.
"""

from __future__ import annotations

import random
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StructField, StructType

from tessella.session import written

#: The prime below 2^32 and the value of an empty set.
PRIME, EMPTY = 4294967291, 4294967295
PERMUTATIONS, ROWS, SEED, LEAST = 200, 10, 42, 0.8


def coefficients(n: int = PERMUTATIONS, seed: int = SEED) -> list[tuple[int, int]]:
    rng = random.Random(seed)
    return [(rng.randrange(1, PRIME), rng.randrange(PRIME)) for _ in range(n)]


def item_hash(item: Column) -> Column:
    """The first four MD5 bytes, the last of them first, as a number below 2^32."""
    m = F.md5(item)
    return F.conv(F.concat(F.substr(m, F.lit(7), F.lit(2)), F.substr(m, F.lit(5), F.lit(2)), F.substr(m, F.lit(3), F.lit(2)), F.substr(m, F.lit(1), F.lit(2))), 16, 10).cast("long")


def minima(hashes: np.ndarray, a: np.ndarray, b: np.ndarray, block: int = 4096) -> np.ndarray:
    """The least (a h + b) mod PRIME of each permutation; h and a are below 2^32, so nothing overflows 64 bits."""
    out = np.full(len(a), EMPTY, np.uint64)
    for at in range(0, len(hashes), block):
        h = hashes[at : at + block].astype(np.uint64)
        out = np.minimum(out, ((a[:, None] * h + b[:, None]) % np.uint64(PRIME)).min(axis=1))
    return out


def minhash(docs: DataFrame, n: int = PERMUTATIONS, seed: int = SEED) -> DataFrame:
    """(id, items) to (id, sig array<bigint>); no shuffle. Minima of n permutations in one pass over Arrow batches, since a
    plan of n aggregates of every item would be interpreted."""
    a, b = (np.array(x, np.uint64) for x in zip(*coefficients(n, seed), strict=True))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sigs = [minima(x.values.to_numpy(), a, b).astype(np.int64) for x in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sigs, pa.list_(pa.int64()))], ["id", "sig"])

    hashed = docs.select("id", F.transform(F.array_distinct(F.coalesce("items", F.array().cast("array<string>"))), item_hash).alias("h"))
    return hashed.mapInArrow(run, StructType([hashed.schema["id"], StructField("sig", ArrayType(LongType()))]))


def _distinct(docs: DataFrame) -> DataFrame:
    """(id, sig, copies) of each distinct signature of a set that is not empty."""
    return minhash(docs).filter(F.col("sig")[0] != EMPTY).groupBy("sig").agg(F.min("id").alias("id"), F.count(F.lit(1)).alias("copies"))


def banded(sigs: DataFrame, rows: int = ROWS) -> DataFrame:
    """(id, copies, band, bucket): ids alone move, not signatures."""
    bands = F.transform(F.sequence(F.lit(0), F.lit(PERMUTATIONS // rows - 1)), lambda b: F.struct(b.alias("band"), F.xxhash64(F.slice("sig", b * rows + 1, F.lit(rows))).alias("bucket")))
    return sigs.select("id", "copies", F.explode(bands).alias("x")).select("id", "copies", "x.band", "x.bucket")


def lsh_pairs(docs: DataFrame, rows: int = ROWS, least: float = LEAST) -> DataFrame:
    """id_a, id_b, estimate: an equi-join on bands of distinct signatures, then the share of equal positions."""
    sigs = written(_distinct(docs), "signatures")
    b = banded(sigs, rows)
    found = b.select(F.col("id").alias("id_a"), "band", "bucket").join(b.select(F.col("id").alias("id_b"), "band", "bucket"), ["band", "bucket"]).filter("id_a < id_b").select("id_a", "id_b").distinct()
    equal = F.aggregate(F.zip_with("x", "y", lambda p, q: (p == q).cast("int")), F.lit(0), lambda s, v: s + v) / PERMUTATIONS
    sig = sigs.select("id", "sig")
    out = found.join(sig.toDF("id_a", "x"), "id_a").join(sig.toDF("id_b", "y"), "id_b").select("id_a", "id_b", equal.alias("estimate"))
    return out.filter(F.col("estimate") >= least)


def lsh_stats(docs: DataFrame, rows: int = ROWS) -> DataFrame:
    n = banded(written(_distinct(docs), "signatures"), rows).groupBy("band", "bucket").agg(F.sum("copies").alias("n"))
    return n.agg((F.sum("n") / (PERMUTATIONS // rows)).cast("long").alias("documents"), F.count(F.lit(1)).alias("buckets"), F.sum("n").alias("entries"), F.max("n").alias("largest"))
