"""Connected components and clusters of similarity edges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.session import written


def connected(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(a, b) to (id, cluster): the least id that can be reached. Labels go along edges, then to their labels' labels."""
    both = written(edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "edges")
    labels = written(both.groupBy(F.col("a").alias("id")).agg(F.min("b").alias("m")).select("id", F.least("id", "m").alias("label")), "labels")
    for _ in range(max_rounds):
        heard = both.join(labels.select(F.col("id").alias("b"), "label"), "b").groupBy(F.col("a").alias("id")).agg(F.min("label").alias("m"))
        low = labels.join(heard, "id", "left").select("id", "label", F.least("label", F.coalesce("m", "label")).alias("low"))
        low = written(low, "labels")
        jump = low.select(F.col("id").alias("low"), F.col("low").alias("next"))
        new = written(low.join(jump, "low", "left").select("id", "label", F.least("low", F.coalesce("next", "low")).alias("new")), "labels")
        if new.filter("new <> label").isEmpty():
            return new.select("id", F.col("new").alias("cluster"))
        labels = new.select("id", F.col("new").alias("label"))
    raise RuntimeError("labels did not settle")
