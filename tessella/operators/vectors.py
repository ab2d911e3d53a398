"""Exact nearest neighbours of a stated query set, in blocks."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Vectors of a block of items, and of a block of queries.
ITEMS, ASKED = 8192, 1024


def _best(items: pd.DataFrame, asked: pd.DataFrame, k: int, measure: str) -> pd.DataFrame:
    out = []
    if len(items) and len(asked):
        items = items.sort_values("vec_id", ignore_index=True)
        ids, x = items["vec_id"].to_numpy(), np.stack(items["v"].to_list()).astype(float)
        norms = np.sqrt((x * x).sum(1))
        for qid, q in zip(asked["vec_id"], asked["v"], strict=True):
            q = np.asarray(q, float)
            s = (x * q).sum(1) / (norms * np.sqrt((q * q).sum())) if measure == "cosine" else 1 / (1 + np.sqrt(((x - q) ** 2).sum(1)))
            order = [i for i in np.lexsort((ids, -s))[: k + 1] if ids[i] != qid][:k]
            out += [(qid, ids[i], s[i]) for i in order]
    return pd.DataFrame(out, columns=["query_id", "vec_id", "s"]).astype({"query_id": "int64", "vec_id": "int64", "s": "float64"})


def knn(vectors: DataFrame, k: int, measure: str) -> DataFrame:
    """query_id, vec_id, rank, score of the k nearest others of each vector whose id is divisible by 20.

    Items and queries are dealt into blocks of bounded size; a task has one block of each, and keeps k rows for a query.
    """
    v = vectors.select("vec_id", F.col("embedding").cast("array<double>").alias("v")).filter("v IS NOT NULL")
    n = v.count()
    parts, asked_parts = max(1, -(-n // ITEMS)), max(1, -(-n // (20 * ASKED)))
    block = lambda salt, m: F.pmod(F.xxhash64("vec_id", F.lit(salt)), F.lit(m)).cast("int")
    every = lambda m: F.explode(F.sequence(F.lit(0), F.lit(m - 1)))
    items = v.withColumn("i", block(1, parts)).withColumn("q", every(asked_parts))
    asked = v.filter("vec_id % 20 = 0").withColumn("q", block(2, asked_parts)).withColumn("i", every(parts))
    found = items.groupBy("i", "q").cogroup(asked.groupBy("i", "q")).applyInPandas(lambda a, b: _best(a, b, k, measure), "query_id long, vec_id long, s double")
    order = Window.partitionBy("query_id").orderBy(F.desc("s"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "vec_id", "rank", F.round("s", 6).alias("score"))
