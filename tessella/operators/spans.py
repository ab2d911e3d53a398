"""Spans of text: overlap joins and merged regions."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Width of the bins that turn an overlap into an equi-join.
BIN = 64


def overlaps(a: DataFrame, b: DataFrame) -> DataFrame:
    """(doc, id, off, len) twice to doc, id_a, id_b, n: characters that both spans cover, where there are any.

    A span stands in every bin it touches; a pair is taken in the bin where the overlap begins, so once.
    """
    binned = lambda s, x: s.filter("len > 0").select("doc", F.col("id").alias(f"id_{x}"), F.col("off").alias(f"off_{x}"), (F.col("off") + F.col("len")).alias(f"end_{x}"), F.explode(F.sequence(F.expr(f"off div {BIN}"), F.expr(f"(off + len - 1) div {BIN}"))).alias("bin"))
    start = F.greatest("off_a", "off_b")
    met = binned(a, "a").join(binned(b, "b"), ["doc", "bin"]).withColumn("n", F.least("end_a", "end_b") - start)
    return met.filter((F.col("n") > 0) & (F.col("bin") == F.floor(start / BIN))).select("doc", "id_a", "id_b", "n")


def merge_regions(spans: DataFrame, gap: int = 0) -> DataFrame:
    """(doc, off, len) to doc, off, len, parts: spans that overlap, or are at most ``gap`` apart, become one."""
    by = Window.partitionBy("doc").orderBy("off", "len")
    end = F.max(F.col("off") + F.col("len")).over(by.rowsBetween(Window.unboundedPreceding, -1))
    fresh = F.when(F.col("off") > end + gap, 1).when(end.isNull(), 1).otherwise(0)
    island = F.sum("fresh").over(by.rowsBetween(Window.unboundedPreceding, 0))
    out = spans.select("doc", "off", "len", fresh.alias("fresh")).select("doc", "off", "len", island.alias("island"))
    end = F.max(F.col("off") + F.col("len"))
    return out.groupBy("doc", "island").agg(F.min("off").alias("off"), (end - F.min("off")).alias("len"), F.count(F.lit(1)).alias("parts")).drop("island")


def pan_metrics(truth: DataFrame, predicted: DataFrame) -> DataFrame:
    """Per document precision, recall, F1, granularity, plagdet over (doc, id, off, len) of both sides.

    A span counts with its greatest overlap. Without truth recall is 1, and all is 1 if nothing is predicted either.
    """
    met = overlaps(predicted, truth)
    share = lambda s, i, x: s.join(met.groupBy("doc", F.col(i).alias("id")).agg(F.max("n").alias("n"), F.count(F.lit(1)).alias("times")), ["doc", "id"], "left").groupBy("doc").agg(F.avg(F.coalesce("n", F.lit(0)) / F.col("len")).alias(x), F.count(F.lit(1)).alias(f"n_{x}"), F.avg("times").alias(f"g_{x}"))
    both = share(predicted.filter("len > 0"), "id_a", "p").join(share(truth.filter("len > 0"), "id_b", "r"), "doc", "full")
    none, nothing = F.col("n_r").isNull(), F.col("n_p").isNull()
    p = F.when(nothing, 1.0).when(none, 0.0).otherwise(F.col("p"))
    r = F.when(none, 1.0).when(nothing, 0.0).otherwise(F.col("r"))
    out = both.select("doc", p.alias("precision"), r.alias("recall"), F.coalesce("g_r", F.lit(1.0)).alias("granularity"), none.alias("none"), nothing.alias("nothing"))
    f1 = F.when(F.col("none") | F.col("nothing"), F.when(F.col("none") & F.col("nothing"), 1.0).otherwise(0.0)).when(F.col("precision") + F.col("recall") == 0, 0.0).otherwise(2 * F.col("precision") * F.col("recall") / (F.col("precision") + F.col("recall")))
    out = out.withColumn("f1", f1)
    return out.select("doc", "precision", "recall", "f1", "granularity", (F.col("f1") / F.log2(1 + F.col("granularity"))).alias("plagdet"))
