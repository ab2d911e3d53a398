"""Queries over spans, taken from the events of a user: clicks are predicted passages, views true ones."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessella.operators import spans
from tessella.session import table


def _spans(spark, sf_dir, kind):
    e = table(spark, sf_dir, "events").filter(F.col("event_type") == kind)
    return e.select(F.col("user_id").alias("doc"), F.col("event_id").alias("id"), (F.col("event_id") * 37 % 100000).alias("off"), (F.col("event_id") % 80 + 20).alias("len"))


_SPAN = """p AS (SELECT user_id AS doc, event_id AS id, event_id * 37 % 100000 AS off, event_id % 80 + 20 AS len FROM events WHERE event_type = 'click'),
t AS (SELECT user_id AS doc, event_id AS id, event_id * 37 % 100000 AS off, event_id % 80 + 20 AS len FROM events WHERE event_type = 'view')"""


def span_overlaps(spark, sf_dir):
    return spans.overlaps(_spans(spark, sf_dir, "click"), _spans(spark, sf_dir, "view"))


_MET = "m AS (SELECT p.doc, p.id AS id_a, t.id AS id_b, least(p.off + p.len, t.off + t.len) - greatest(p.off, t.off) AS n FROM p JOIN t ON p.doc = t.doc AND p.off < t.off + t.len AND t.off < p.off + p.len)"
OVERLAP_SQL = f"WITH {_SPAN}, {_MET} SELECT * FROM m"


def merge_regions(spark, sf_dir):
    return spans.merge_regions(_spans(spark, sf_dir, "view"), 200)


MERGE_SQL = f"""WITH {_SPAN}, e AS (SELECT *, max(off + len) OVER (PARTITION BY doc ORDER BY off, len ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS e FROM t),
i AS (SELECT *, sum(CASE WHEN e IS NULL OR off > e + 200 THEN 1 ELSE 0 END) OVER (PARTITION BY doc ORDER BY off, len ROWS UNBOUNDED PRECEDING) AS k FROM e)
SELECT doc, min(off) AS off, max(off + len) - min(off) AS len, count(*) AS parts FROM i GROUP BY doc, k"""


def _rounded(d):
    return d.select(*[F.round(c, 6).alias(c) if c not in ("doc", "n_docs") else c for c in d.columns])


def pan_metrics(spark, sf_dir):
    return _rounded(spans.pan_metrics(_spans(spark, sf_dir, "view"), _spans(spark, sf_dir, "click")))


_PAN = f"""{_SPAN}, {_MET}, a AS (SELECT p.doc, avg(coalesce(n, 0) / len) AS p FROM p LEFT JOIN (SELECT doc, id_a AS id, max(n) AS n FROM m GROUP BY 1, 2) USING (doc, id) GROUP BY p.doc),
b AS (SELECT t.doc, avg(coalesce(n, 0) / len) AS r, avg(k) AS g FROM t LEFT JOIN (SELECT doc, id_b AS id, max(n) AS n, count(*) AS k FROM m GROUP BY 1, 2) USING (doc, id) GROUP BY t.doc),
c AS (SELECT doc, CASE WHEN p IS NULL THEN 1.0 WHEN r IS NULL THEN 0.0 ELSE p END AS precision, CASE WHEN r IS NULL THEN 1.0 WHEN p IS NULL THEN 0.0 ELSE r END AS recall, coalesce(g, 1.0) AS granularity, p IS NULL OR r IS NULL AS one FROM a FULL JOIN b USING (doc)),
d AS (SELECT *, CASE WHEN one OR precision + recall = 0 THEN 0.0 ELSE 2 * precision * recall / (precision + recall) END AS f1 FROM c),
x AS (SELECT doc, precision, recall, f1, granularity, f1 / log2(1 + granularity) AS plagdet FROM d)"""
PAN_SQL = f"WITH {_PAN} SELECT doc, round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1, 6) AS f1, round(granularity, 6) AS granularity, round(plagdet, 6) AS plagdet FROM x"


def pan_macro(spark, sf_dir):
    m = spans.pan_metrics(_spans(spark, sf_dir, "view"), _spans(spark, sf_dir, "click"))
    return _rounded(m.agg(*[F.avg(c).alias(c) for c in ("precision", "recall", "f1", "granularity", "plagdet")], F.count(F.lit(1)).alias("n_docs")))


MACRO_SQL = f"WITH {_PAN} SELECT round(avg(precision), 6) AS precision, round(avg(recall), 6) AS recall, round(avg(f1), 6) AS f1, round(avg(granularity), 6) AS granularity, round(avg(plagdet), 6) AS plagdet, count(*) AS n_docs FROM x"

def pan_micro(spark, sf_dir):
    """Precision and recall over the characters of all documents together, with granularity and its discount."""
    t, p = _spans(spark, sf_dir, "view"), _spans(spark, sf_dir, "click")
    met = spans.overlaps(p, t)
    best = lambda key, side: side.select("id", "len").join(met.groupBy(F.col(key).alias("id")).agg(F.max("n").alias("n"), F.count(F.lit(1)).alias("k")), "id", "left")
    a = best("id_a", p).agg(F.sum(F.coalesce("n", F.lit(0))).alias("hit"), F.sum("len").alias("size"))
    b = best("id_b", t).agg(F.sum(F.coalesce("n", F.lit(0))).alias("found"), F.sum("len").alias("whole"), F.coalesce(F.avg("k"), F.lit(1.0)).alias("granularity"))
    both = a.join(b)  # one row each
    share = lambda x, y: F.when(F.coalesce(F.col(y), F.lit(0)) == 0, 1.0).otherwise(F.col(x) / F.col(y))
    d = both.select(share("hit", "size").alias("precision"), share("found", "whole").alias("recall"), "granularity")
    f1 = F.when(F.col("precision") + F.col("recall") == 0, 0.0).otherwise(2 * F.col("precision") * F.col("recall") / (F.col("precision") + F.col("recall")))
    d = d.withColumn("f1", f1).withColumn("plagdet", F.col("f1") / F.log2(1 + F.col("granularity")))
    return d.select(*[F.round(c, 6).alias(c) for c in d.columns])


MICRO_SQL = f"""WITH {_SPAN}, {_MET}, a AS (SELECT sum(coalesce(n, 0)) / sum(len) AS precision FROM p LEFT JOIN (SELECT id_a AS id, max(n) AS n FROM m GROUP BY 1) USING (id)),
b AS (SELECT sum(coalesce(n, 0)) / sum(len) AS recall, coalesce(avg(k), 1.0) AS granularity FROM t LEFT JOIN (SELECT id_b AS id, max(n) AS n, count(*) AS k FROM m GROUP BY 1) USING (id)),
c AS (SELECT coalesce(precision, 1.0) AS precision, coalesce(recall, 1.0) AS recall, granularity FROM a, b), d AS (SELECT *, CASE WHEN precision + recall = 0 THEN 0.0 ELSE 2 * precision * recall / (precision + recall) END AS f1 FROM c)
SELECT round(precision, 6) AS precision, round(recall, 6) AS recall, round(granularity, 6) AS granularity, round(f1, 6) AS f1, round(f1 / log2(1 + granularity), 6) AS plagdet FROM d"""

QUERIES = {"span_overlaps": (span_overlaps, OVERLAP_SQL), "merge_regions": (merge_regions, MERGE_SQL), "pan_metrics": (pan_metrics, PAN_SQL), "pan_macro": (pan_macro, MACRO_SQL), "pan_micro": (pan_micro, MICRO_SQL)}
