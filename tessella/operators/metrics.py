"""Evaluation metrics. Ranked metrics work on a histogram of scores, a bounded number of rows whatever the input."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Scores are whole thousandths, so that sums are exact and a histogram has at most 1001 rows for each key.
SCALE = 1000


def count_if(c: Column) -> Column:
    return F.sum(F.when(c, 1).otherwise(0)).cast("long")


def confusion(decided: Column, label: Column) -> list[Column]:
    yes, no = label == 1, label == 0
    return [count_if(decided & yes).alias("tp"), count_if(decided & no).alias("fp"), count_if(~decided & no).alias("tn"), count_if(~decided & yes).alias("fn")]


def ratio(a: Column, b: Column) -> Column:
    return F.when(b == 0, 0.0).otherwise(a / b)


def rates() -> list[Column]:
    """Of tp, fp, tn, fn; 0 where a denominator is 0."""
    tp, fp, tn, fn = (F.col(x) for x in ("tp", "fp", "tn", "fn"))
    return [ratio(tp, tp + fp).alias("precision"), ratio(tp, tp + fn).alias("recall"), ratio(2 * tp, 2 * tp + fp + fn).alias("f1"), ratio(tp + tn, tp + fp + tn + fn).alias("accuracy")]


def histogram(records: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, score) with pos and neg, the labels at that score."""
    return records.groupBy(*keys, "score").agg(count_if(F.col("label") == 1).alias("pos"), count_if(F.col("label") == 0).alias("neg"))


def cumulative(records: DataFrame, keys: list[str]) -> DataFrame:
    """The histogram from the highest score down, with tp and fp when everything from that score up is flagged."""
    h = histogram(records, keys)
    down = Window.partitionBy(*keys).orderBy(F.desc("score")).rowsBetween(Window.unboundedPreceding, 0)
    every = Window.partitionBy(*keys)
    return h.select("*", F.sum("pos").over(down).alias("tp"), F.sum("neg").over(down).alias("fp"), F.sum("pos").over(every).alias("p"), F.sum("neg").over(every).alias("n"))


def roc_auc(records: DataFrame, keys: list[str]) -> DataFrame:
    """Chance that a positive has the higher score, ties one half."""
    c = cumulative(records, keys)
    wins = F.sum(F.col("pos") * (2 * (F.col("n") - F.col("fp")) + F.col("neg")))
    return c.groupBy(*keys).agg(wins.alias("w"), F.max("p").alias("p"), F.max("n").alias("n")).select(*keys, ratio(F.col("w"), 2 * F.col("p") * F.col("n")).alias("auc"))


def average_precision(records: DataFrame, keys: list[str]) -> DataFrame:
    c = cumulative(records, keys)
    return c.groupBy(*keys).agg(F.round(F.sum(ratio(F.col("pos") * F.col("tp"), F.col("p") * (F.col("tp") + F.col("fp")))), 9).alias("average_precision"))


def sweep(records: DataFrame, keys: list[str], step: int) -> DataFrame:
    """Confusion counts at thresholds 0, step, ... SCALE, from the histogram."""
    t = F.explode(F.sequence(F.lit(0), F.lit(SCALE), F.lit(step))).alias("threshold")
    on = F.col("score") >= F.col("threshold")
    part = lambda c, x: F.sum(F.when(c, F.col(x)).otherwise(0)).cast("long")
    h = histogram(records, keys).select("*", t)
    return h.groupBy(*keys, "threshold").agg(part(on, "pos").alias("tp"), part(on, "neg").alias("fp"), part(~on, "neg").alias("tn"), part(~on, "pos").alias("fn"))


def top_by(records: DataFrame, k: int) -> DataFrame:
    """The k records of highest score, ties to the smaller id, with their rank; no window over all rows."""
    best = records.orderBy(F.desc("score"), "doc_id").limit(k)
    return best.select("*", F.row_number().over(Window.partitionBy(F.lit(1)).orderBy(F.desc("score"), "doc_id")).alias("rank"))
