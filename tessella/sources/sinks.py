"""Writers of reports."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def report(scored: DataFrame, path: str, threshold: float = 0.5) -> DataFrame:
    """Writes all pairs (id_a, id_b, score), best first within files, and suspicious ones apart; returns the summary."""
    marked = scored.withColumn("suspicious", F.col("score") >= threshold)
    marked.repartitionByRange(F.desc("score"), "id_a", "id_b").sortWithinPartitions(F.desc("score"), "id_a", "id_b").write.mode("overwrite").partitionBy("suspicious").parquet(f"{path}/pairs")
    summary = marked.agg(F.count(F.lit(1)).alias("total_pairs"), F.count_if("suspicious").alias("suspicious_pairs"), F.lit(threshold).alias("threshold"))
    summary.write.mode("overwrite").json(f"{path}/summary")
    return summary


def samples(records: DataFrame, path: str) -> None:
    """Labelled samples as JSON lines, a folder for each label."""
    records.write.mode("overwrite").partitionBy("label").json(path)


def leaderboard(metrics: DataFrame, metric: str, n: int = 10) -> DataFrame:
    """The n engines of greatest metric."""
    return metrics.orderBy(F.desc(metric), "engine").limit(n)
