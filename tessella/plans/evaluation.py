"""Metrics of two scoring engines over labelled documents.

The record of a document: engine ``distinct`` scores the share of distinct tokens, engine ``long`` the share of distinct
tokens of five letters or more, both in thousandths; the label is its quality.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessella.functions import text
from tessella.operators import metrics as m
from tessella.session import table

ENGINES = ("distinct", "long")


def records(spark, sf_dir) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", "source", text.tokens(F.col("text")).alias("w"))
    measured = docs.select("doc_id", "lang", "source", F.size("w").alias("n"), text.let(F.array_distinct("w"), lambda u: F.struct(F.size(u).alias("d"), F.size(F.filter(u, lambda t: F.length(t) >= 5)).alias("l"))).alias("u"))
    scored = measured.select("doc_id", "lang", "source", F.expr("1000 * u.d div greatest(n, 1)").alias("a"), F.expr("1000 * u.l div greatest(u.d, 1)").alias("b"))
    labels = table(spark, sf_dir, "labels").groupBy("doc_id").agg(F.max("quality").alias("label"))
    rows = scored.join(labels, "doc_id")
    pair = F.explode(F.array(F.struct(F.lit("distinct").alias("engine"), F.col("a").alias("score")), F.struct(F.lit("long").alias("engine"), F.col("b").alias("score"))))
    return rows.select("doc_id", "lang", "source", "label", pair.alias("e")).select("doc_id", "lang", "source", "label", "e.engine", "e.score")


_REC = """tk AS (SELECT doc_id, lang, source, regexp_extract_all(lower(coalesce(text, '')), '[a-z0-9]+') AS w FROM documents),
md AS (SELECT doc_id, lang, source, len(w) AS n, list_distinct(w) AS u FROM tk),
sc AS (SELECT doc_id, lang, source, 1000 * len(u) // greatest(n, 1) AS a, 1000 * len([t for t in u if length(t) >= 5]) // greatest(len(u), 1) AS b FROM md),
lb AS (SELECT doc_id, max(quality) AS label FROM labels GROUP BY doc_id),
rec AS (SELECT doc_id, lang, source, label, 'distinct' AS engine, a AS score FROM sc JOIN lb USING (doc_id) UNION ALL SELECT doc_id, lang, source, label, 'long', b FROM sc JOIN lb USING (doc_id))"""
_CONF = "count(*) FILTER (score >= {0} AND label = 1) AS tp, count(*) FILTER (score >= {0} AND label = 0) AS fp, count(*) FILTER (score < {0} AND label = 0) AS tn, count(*) FILTER (score < {0} AND label = 1) AS fn"
_RATES = "CASE WHEN tp + fp = 0 THEN 0.0 ELSE tp / (tp + fp) END AS precision, CASE WHEN tp + fn = 0 THEN 0.0 ELSE tp / (tp + fn) END AS recall, CASE WHEN 2 * tp + fp + fn = 0 THEN 0.0 ELSE 2 * tp / (2 * tp + fp + fn) END AS f1, CASE WHEN tp + fp + tn + fn = 0 THEN 0.0 ELSE (tp + tn) / (tp + fp + tn + fn) END AS accuracy"
_CUM = """hg AS (SELECT {0}, score, count(*) FILTER (label = 1) AS pos, count(*) FILTER (label = 0) AS neg FROM rec GROUP BY ALL),
cm AS (SELECT *, sum(pos) OVER (PARTITION BY {0} ORDER BY score DESC) AS tp, sum(neg) OVER (PARTITION BY {0} ORDER BY score DESC) AS fp, sum(pos) OVER (PARTITION BY {0}) AS p, sum(neg) OVER (PARTITION BY {0}) AS n FROM hg)"""


def confusion(spark, sf_dir):
    return records(spark, sf_dir).groupBy("engine").agg(*m.confusion(F.col("score") >= 500, F.col("label"))).select("*", *m.rates())


CONFUSION_SQL = f"WITH {_REC}, c AS (SELECT engine, {_CONF.format(500)} FROM rec GROUP BY engine) SELECT *, {_RATES} FROM c"


def threshold_sweep(spark, sf_dir):
    return m.sweep(records(spark, sf_dir), ["engine"], 10).select("*", *m.rates())


SWEEP_SQL = f"WITH {_REC}, c AS (SELECT engine, t::INTEGER AS threshold, {_CONF.format('t')} FROM rec, range(0, 1001, 10) r(t) GROUP BY engine, t) SELECT *, {_RATES} FROM c"


def optimal_threshold(spark, sf_dir):
    """The lowest threshold of greatest F1."""
    s = m.sweep(records(spark, sf_dir), ["engine"], 10).select("*", *m.rates())
    best = F.max_by(F.struct("threshold", "precision", "recall", "f1"), F.struct("f1", -F.col("threshold")))
    return s.groupBy("engine").agg(best.alias("b")).select("engine", "b.threshold", "b.precision", "b.recall", "b.f1")


OPTIMAL_SQL = f"WITH {_REC}, c AS (SELECT engine, t::INTEGER AS threshold, {_CONF.format('t')} FROM rec, range(0, 1001, 10) r(t) GROUP BY engine, t), s AS (SELECT *, {_RATES} FROM c) SELECT engine, threshold, precision, recall, f1 FROM s QUALIFY row_number() OVER (PARTITION BY engine ORDER BY f1 DESC, threshold) = 1"


def roc_auc(spark, sf_dir):
    return m.roc_auc(records(spark, sf_dir), ["engine"])


AUC_SQL = f"WITH {_REC}, {_CUM.format('engine')} SELECT engine, CASE WHEN max(p) * max(n) = 0 THEN 0.0 ELSE (sum(pos * (2 * (n - fp) + neg)) / (2 * max(p) * max(n)))::DOUBLE END AS auc FROM cm GROUP BY engine"


def roc_curve(spark, sf_dir):
    c = m.cumulative(records(spark, sf_dir), ["engine"])
    return c.select("engine", "score", m.ratio(F.col("fp"), F.col("n")).alias("fpr"), m.ratio(F.col("tp"), F.col("p")).alias("tpr"))


ROC_SQL = f"WITH {_REC}, {_CUM.format('engine')} SELECT engine, score, CASE WHEN n = 0 THEN 0.0 ELSE (fp / n)::DOUBLE END AS fpr, CASE WHEN p = 0 THEN 0.0 ELSE (tp / p)::DOUBLE END AS tpr FROM cm"


def average_precision(spark, sf_dir):
    return m.average_precision(records(spark, sf_dir), ["engine"])


AP_SQL = f"WITH {_REC}, {_CUM.format('engine')} SELECT engine, round(sum(CASE WHEN p * (tp + fp) = 0 THEN 0.0 ELSE pos * tp / (p * (tp + fp)) END), 9) AS average_precision FROM cm GROUP BY engine"


def recall_at_fpr(spark, sf_dir):
    c = m.cumulative(records(spark, sf_dir), ["engine"])
    limit = F.explode(F.array(*[F.lit(x) for x in (1, 5, 10, 20)])).alias("fpr_percent")
    ok = F.col("fp") * 100 <= F.col("n") * F.col("fpr_percent")
    return c.select("*", limit).groupBy("engine", "fpr_percent").agg(F.coalesce(F.max(F.when(ok, m.ratio(F.col("tp"), F.col("p")))), F.lit(0.0)).alias("recall"))


RECALL_SQL = f"WITH {_REC}, {_CUM.format('engine')} SELECT engine, x::INTEGER AS fpr_percent, coalesce(max(CASE WHEN fp * 100 <= n * x THEN CASE WHEN p = 0 THEN 0.0 ELSE (tp / p)::DOUBLE END END), 0.0) AS recall FROM cm, (VALUES (1), (5), (10), (20)) v(x) GROUP BY engine, x"


def calibration(spark, sf_dir):
    """Reliability by ten bins, all of them, and the expected and greatest calibration errors."""
    b = records(spark, sf_dir).groupBy("engine", F.least(F.expr("score div 100"), F.lit(9)).alias("bin")).agg(F.count(F.lit(1)).alias("n"), F.sum("score").alias("s"), F.sum("label").alias("y"))
    spine = b.select("engine").distinct().select("engine", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(9).cast("long"))).alias("bin"))
    full = spine.join(b, ["engine", "bin"], "left").fillna(0, ["n", "s", "y"])
    gap = F.when(F.col("n") == 0, 0.0).otherwise(F.abs(F.col("s") / 1000 - F.col("y")) / F.col("n"))
    every = Window.partitionBy("engine")
    weighted = F.sum(F.col("n") * F.col("gap")).over(every) / F.sum("n").over(every)
    return full.withColumn("gap", gap).select("engine", "bin", "n", F.round("gap", 9).alias("gap"), F.round(weighted, 9).alias("ece"), F.round(F.max("gap").over(every), 9).alias("mce"))


ECE_SQL = f"""WITH {_REC}, b AS (SELECT engine, least(score // 100, 9) AS bin, count(*) AS n, sum(score) AS s, sum(label) AS y FROM rec GROUP BY ALL),
f AS (SELECT e.engine, r.bin, coalesce(n, 0) AS n, CASE WHEN coalesce(n, 0) = 0 THEN 0.0::DOUBLE ELSE (abs(s / 1000.0::DOUBLE - y) / n)::DOUBLE END AS gap FROM (SELECT DISTINCT engine FROM rec) e CROSS JOIN range(10) r(bin) LEFT JOIN b ON b.engine = e.engine AND b.bin = r.bin)
SELECT engine, bin, n, round(gap, 9) AS gap, round((sum(n * gap) OVER (PARTITION BY engine) / sum(n) OVER (PARTITION BY engine))::DOUBLE, 9) AS ece, round(max(gap) OVER (PARTITION BY engine), 9) AS mce FROM f"""


def precision_at_k(spark, sf_dir):
    """Of the 50 best of each engine, the share of positives among the first 5, 10, 20 and 50."""
    every = records(spark, sf_dir)
    best = [m.top_by(every.filter(F.col("engine") == e), 50) for e in ENGINES]
    top = best[0].unionByName(best[1]).select("*", F.explode(F.array(*[F.lit(k) for k in (5, 10, 20, 50)])).alias("k")).filter("rank <= k")
    return top.groupBy("engine", "k").agg(F.avg("label").alias("precision"))


PK_SQL = f"WITH {_REC}, r AS (SELECT *, row_number() OVER (PARTITION BY engine ORDER BY score DESC, doc_id) AS rank FROM rec) SELECT engine, k::INTEGER AS k, avg(label) AS precision FROM r, (VALUES (5), (10), (20), (50)) v(k) WHERE rank <= k GROUP BY engine, k"


def ndcg_at_k(spark, sf_dir):
    """Gain 2^label - 1 of the first ten of each source; the row limit reaches the partial ranks before the shuffle."""
    every = records(spark, sf_dir).filter("engine = 'distinct'")
    gain = (F.pow(F.lit(2.0), F.col("label")) - 1) / F.log2(F.col("rank") + 1)
    keyed = lambda *o: every.withColumn("rank", F.row_number().over(Window.partitionBy("source").orderBy(*o))).filter("rank <= 10").groupBy("source")
    dcg = keyed(F.desc("score"), F.col("doc_id")).agg(F.sum(gain).alias("dcg"))
    ideal = keyed(F.desc("label"), F.col("doc_id")).agg(F.sum(gain).alias("ideal"))
    return dcg.join(ideal, "source").select("source", F.round(m.ratio(F.col("dcg"), F.col("ideal")), 9).alias("ndcg"))


NDCG_SQL = f"""WITH {_REC}, e AS (SELECT * FROM rec WHERE engine = 'distinct'), a AS (SELECT source, label, row_number() OVER (PARTITION BY source ORDER BY score DESC, doc_id) AS r FROM e),
b AS (SELECT source, label, row_number() OVER (PARTITION BY source ORDER BY label DESC, doc_id) AS r FROM e),
d AS (SELECT source, sum((2.0::DOUBLE ** label - 1) / log2(r + 1)) AS dcg FROM a WHERE r <= 10 GROUP BY source), i AS (SELECT source, sum((2.0::DOUBLE ** label - 1) / log2(r + 1)) AS ideal FROM b WHERE r <= 10 GROUP BY source)
SELECT source, round(CASE WHEN ideal = 0 THEN 0.0 ELSE dcg / ideal END, 9) AS ndcg FROM d JOIN i USING (source)"""


def map_mrr(spark, sf_dir):
    """Mean average precision (ties ranked together) and mean reciprocal rank over sources."""
    every = records(spark, sf_dir).filter("engine = 'distinct'")
    ap = m.average_precision(every, ["source"])
    first = every.groupBy("source").agg(F.max_by(F.struct("score", "doc_id"), F.when(F.col("label") == 1, F.struct("score", -F.col("doc_id")))).alias("f"))
    ahead = every.join(first, "source").filter((F.col("score") > F.col("f.score")) | ((F.col("score") == F.col("f.score")) & (F.col("doc_id") <= F.col("f.doc_id"))))
    rank = ahead.groupBy("source").agg(F.count(F.lit(1)).alias("rank"))
    out = ap.join(rank, "source", "left").select("average_precision", F.coalesce(1 / F.col("rank"), F.lit(0.0)).alias("rr"))
    return out.agg(F.round(F.avg("average_precision"), 6).alias("map"), F.round(F.avg("rr"), 6).alias("mrr"), F.count(F.lit(1)).alias("n_queries"))


MAP_SQL = f"""WITH {_REC}, {_CUM.format('engine, source')}, a AS (SELECT source, round(sum(CASE WHEN p * (tp + fp) = 0 THEN 0.0 ELSE pos * tp / (p * (tp + fp)) END), 9) AS ap FROM cm WHERE engine = 'distinct' GROUP BY source),
r AS (SELECT source, label, row_number() OVER (PARTITION BY source ORDER BY score DESC, doc_id) AS r FROM rec WHERE engine = 'distinct'), f AS (SELECT source, coalesce(1 / min(r) FILTER (label = 1), 0.0) AS rr FROM r GROUP BY source)
SELECT round(avg(ap), 6) AS map, round(avg(rr), 6) AS mrr, count(*) AS n_queries FROM a JOIN f USING (source)"""


def rrf(spark, sf_dir):
    """Reciprocal rank fusion of both engines; equal scores share the better rank, which the histogram gives."""
    every = records(spark, sf_dir)
    c = m.cumulative(every, ["engine"]).select("engine", "score", (F.col("tp") + F.col("fp") - F.col("pos") - F.col("neg") + 1).alias("rank"))
    return every.join(c, ["engine", "score"]).groupBy("doc_id").agg(F.round(F.sum(1 / (60 + F.col("rank"))), 9).alias("rrf"))


RRF_SQL = f"WITH {_REC}, r AS (SELECT doc_id, rank() OVER (PARTITION BY engine ORDER BY score DESC) AS rank FROM rec) SELECT doc_id, round(sum(1 / (60 + rank)), 9) AS rrf FROM r GROUP BY doc_id"


def stratified(spark, sf_dir):
    """Rates by engine for each language, each source, both, and all, as grouping sets."""
    c = spark.sql("""SELECT engine, lang, source, 2 * grouping(lang) + grouping(source) AS level, count_if(score >= 500 AND label = 1) AS tp, count_if(score >= 500 AND label = 0) AS fp,
        count_if(score < 500 AND label = 0) AS tn, count_if(score < 500 AND label = 1) AS fn
        FROM {records} GROUP BY GROUPING SETS ((engine, lang, source), (engine, lang), (engine, source), (engine))""", records=records(spark, sf_dir))
    return c.select("*", *m.rates())


STRATA_SQL = f"WITH {_REC}, c AS (SELECT engine, lang, source, grouping_id(lang, source) AS level, {_CONF.format(500)} FROM rec GROUP BY GROUPING SETS ((engine, lang, source), (engine, lang), (engine, source), (engine))) SELECT *, {_RATES} FROM c"


def fpr_subgroup(spark, sf_dir):
    """False-positive rate by language against the overall one; high risk: over twice it, from ten negatives on."""
    by = lambda *k: records(spark, sf_dir).filter("label = 0").groupBy(*k).agg(F.count(F.lit(1)).alias("n"), m.count_if(F.col("score") >= 500).alias("fp"))
    whole = by("engine").select("engine", (F.col("fp") / F.col("n")).alias("overall"))
    out = by("engine", "lang").join(whole, "engine").withColumn("fpr", F.col("fp") / F.col("n"))
    return out.select("engine", "lang", "n", "fpr", "overall", ((F.col("fpr") > 2 * F.col("overall")) & (F.col("n") >= 10)).alias("high_risk"))


FPR_SQL = f"""WITH {_REC}, o AS (SELECT engine, count(*) FILTER (score >= 500) / count(*) AS overall FROM rec WHERE label = 0 GROUP BY engine),
l AS (SELECT engine, lang, count(*) AS n, count(*) FILTER (score >= 500) / count(*) AS fpr FROM rec WHERE label = 0 GROUP BY engine, lang)
SELECT engine, lang, n, fpr, overall, fpr > 2 * overall AND n >= 10 AS high_risk FROM l JOIN o USING (engine)"""


def operational(spark, sf_dir):
    """Alerts from a score of 700 on: how many, how many are false, and the burden of a hundred documents."""
    on = F.col("score") >= 700
    a = records(spark, sf_dir).groupBy("engine").agg(F.count(F.lit(1)).alias("n"), m.count_if(on).alias("alerts"), m.count_if(on & (F.col("label") == 0)).alias("false_alerts"))
    return a.select("*", m.ratio(F.col("false_alerts"), F.col("alerts")).alias("false_rate"), (100 * F.col("alerts") / F.col("n")).alias("per_hundred"))


OPERATIONAL_SQL = f"WITH {_REC}, a AS (SELECT engine, count(*) AS n, count(*) FILTER (score >= 700) AS alerts, count(*) FILTER (score >= 700 AND label = 0) AS false_alerts FROM rec GROUP BY engine) SELECT *, CASE WHEN alerts = 0 THEN 0.0 ELSE false_alerts / alerts END AS false_rate, 100 * alerts / n AS per_hundred FROM a"


def wilson(spark, sf_dir):
    """Wilson and normal intervals (95 %) of accuracy by engine and language."""
    z = 1.959963984540054
    right = (F.col("score") >= 500) == (F.col("label") == 1)
    a = records(spark, sf_dir).groupBy("engine", "lang").agg(F.count(F.lit(1)).alias("n"), m.count_if(right).alias("k")).withColumn("p", F.col("k") / F.col("n"))
    n, p = F.col("n"), F.col("p")
    mid, half = (p + z * z / (2 * n)) / (1 + z * z / n), z * F.sqrt(p * (1 - p) / n + z * z / (4 * n * n)) / (1 + z * z / n)
    wald = z * F.sqrt(p * (1 - p) / n)
    return a.select("engine", "lang", "n", "k", *[F.round(x, 9).alias(y) for x, y in ((mid - half, "wilson_low"), (mid + half, "wilson_high"), (F.greatest(F.lit(0.0), p - wald), "wald_low"), (F.least(F.lit(1.0), p + wald), "wald_high"))])


WILSON_SQL = f"""WITH {_REC}, a AS (SELECT engine, lang, count(*) AS n, count(*) FILTER ((score >= 500) = (label = 1)) AS k FROM rec GROUP BY engine, lang), b AS (SELECT *, k / n AS p, 1.959963984540054::DOUBLE AS z FROM a)
SELECT engine, lang, n, k, round((p + z * z / (2 * n)) / (1 + z * z / n) - z * sqrt(p * (1 - p) / n + z * z / (4 * n * n)) / (1 + z * z / n), 9) AS wilson_low,
round((p + z * z / (2 * n)) / (1 + z * z / n) + z * sqrt(p * (1 - p) / n + z * z / (4 * n * n)) / (1 + z * z / n), 9) AS wilson_high,
round(greatest(0.0, p - z * sqrt(p * (1 - p) / n)), 9) AS wald_low, round(least(1.0, p + z * sqrt(p * (1 - p) / n)), 9) AS wald_high FROM b"""


def _paired(spark, sf_dir):
    right = ((F.col("score") >= 500) == (F.col("label") == 1)).cast("int")
    return records(spark, sf_dir).groupBy("doc_id").agg(F.max(F.when(F.col("engine") == "distinct", right)).alias("a"), F.max(F.when(F.col("engine") == "long", right)).alias("b"))


def mcnemar_table(spark, sf_dir):
    """Who is right where, and the chi-square with continuity correction."""
    a, b = F.col("a") == 1, F.col("b") == 1
    t = _paired(spark, sf_dir).agg(m.count_if(a & b).alias("both"), m.count_if(a & ~b).alias("only_a"), m.count_if(~a & b).alias("only_b"), m.count_if(~a & ~b).alias("neither"))
    d = F.greatest(F.abs(F.col("only_a") - F.col("only_b")) - 1, F.lit(0))
    return t.select("*", F.round(m.ratio(d * d, F.col("only_a") + F.col("only_b")), 9).alias("chi2"))


_PAIRED = "pr AS (SELECT doc_id, max(CASE WHEN engine = 'distinct' THEN ((score >= 500) = (label = 1))::INT END) AS a, max(CASE WHEN engine = 'long' THEN ((score >= 500) = (label = 1))::INT END) AS b FROM rec GROUP BY doc_id)"
MCNEMAR_SQL = f"WITH {_REC}, {_PAIRED}, t AS (SELECT count(*) FILTER (a = 1 AND b = 1) AS both, count(*) FILTER (a = 1 AND b = 0) AS only_a, count(*) FILTER (a = 0 AND b = 1) AS only_b, count(*) FILTER (a = 0 AND b = 0) AS neither FROM pr) SELECT *, round(CASE WHEN only_a + only_b = 0 THEN 0.0 ELSE greatest(abs(only_a - only_b) - 1, 0) ** 2 / (only_a + only_b) END, 9) AS chi2 FROM t"
MCNEMAR_SQL = MCNEMAR_SQL.replace(" AS both,", ' AS "both",')


def kappa(spark, sf_dir):
    """Cohen's kappa between the engines' decisions, held to [0, 1]."""
    on = (F.col("score") >= 500).cast("int")
    d = records(spark, sf_dir).groupBy("doc_id").agg(F.max(F.when(F.col("engine") == "distinct", on)).alias("a"), F.max(F.when(F.col("engine") == "long", on)).alias("b"))
    t = d.agg(F.count(F.lit(1)).alias("n"), m.count_if(F.col("a") == F.col("b")).alias("same"), F.sum("a").alias("sa"), F.sum("b").alias("sb"))
    n = F.col("n")
    po, pe = F.col("same") / n, (F.col("sa") * F.col("sb") + (n - F.col("sa")) * (n - F.col("sb"))) / (n * n)
    return t.select("n", F.round(F.when(pe == 1, 1.0).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), (po - pe) / (1 - pe)))), 9).alias("kappa"))


KAPPA_SQL = f"""WITH {_REC}, d AS (SELECT doc_id, max(CASE WHEN engine = 'distinct' THEN (score >= 500)::INT END) AS a, max(CASE WHEN engine = 'long' THEN (score >= 500)::INT END) AS b FROM rec GROUP BY doc_id),
t AS (SELECT count(*) AS n, count(*) FILTER (a = b) AS same, sum(a)::DOUBLE AS sa, sum(b)::DOUBLE AS sb FROM d), q AS (SELECT n, same / n AS po, (sa * sb + (n - sa) * (n - sb)) / (n * n) AS pe FROM t)
SELECT n, round(CASE WHEN pe = 1 THEN 1.0 ELSE greatest(0.0, least(1.0, (po - pe) / (1 - pe))) END, 9) AS kappa FROM q"""


def effect_sizes(spark, sf_dir):
    """Cohen's d (pooled) and Cliff's delta between positive and negative documents."""
    every = records(spark, sf_dir)
    of = lambda f, y: f(F.when(F.col("label") == y, F.col("score").cast("double")))
    a = every.groupBy("engine").agg(of(F.avg, 1).alias("m1"), of(F.avg, 0).alias("m0"), of(F.var_samp, 1).alias("v1"), of(F.var_samp, 0).alias("v0"), m.count_if(F.col("label") == 1).alias("n1"), m.count_if(F.col("label") == 0).alias("n0"))
    pooled = F.sqrt(((F.col("n1") - 1) * F.col("v1") + (F.col("n0") - 1) * F.col("v0")) / (F.col("n1") + F.col("n0") - 2))
    auc = m.roc_auc(every, ["engine"])
    return a.join(auc, "engine").select("engine", F.round((F.col("m1") - F.col("m0")) / pooled, 6).alias("cohens_d"), F.round(2 * F.col("auc") - 1, 9).alias("cliffs_delta"))


EFFECT_SQL = f"""WITH {_REC}, {_CUM.format('engine')}, u AS (SELECT engine, (sum(pos * (2 * (n - fp) + neg)) / (2 * max(p) * max(n)))::DOUBLE AS auc FROM cm GROUP BY engine),
a AS (SELECT engine, avg(score) FILTER (label = 1) AS m1, avg(score) FILTER (label = 0) AS m0, var_samp(score) FILTER (label = 1) AS v1, var_samp(score) FILTER (label = 0) AS v0, count(*) FILTER (label = 1) AS n1, count(*) FILTER (label = 0) AS n0 FROM rec GROUP BY engine)
SELECT engine, round((m1 - m0) / sqrt(((n1 - 1) * v1 + (n0 - 1) * v0) / (n1 + n0 - 2)), 6) AS cohens_d, round(2 * auc - 1, 9) AS cliffs_delta FROM a JOIN u USING (engine)"""


def kfold(spark, sf_dir):
    """Five folds by a hash of the id, with their class balance."""
    fold = F.conv(F.substr(F.md5(F.col("doc_id").cast("string")), F.lit(1), F.lit(6)), 16, 10).cast("long") % 5
    return records(spark, sf_dir).filter("engine = 'distinct'").groupBy(fold.alias("fold")).agg(F.count(F.lit(1)).alias("n"), m.count_if(F.col("label") == 1).alias("positives"), F.round(F.avg("score"), 6).alias("mean_score"))


KFOLD_SQL = f"WITH {_REC} SELECT ('0x' || md5(doc_id::VARCHAR)[1:6])::BIGINT % 5 AS fold, count(*) AS n, count(*) FILTER (label = 1) AS positives, round(avg(score), 6) AS mean_score FROM rec WHERE engine = 'distinct' GROUP BY 1"


def bootstrap_accuracy(spark, sf_dir):
    """Percentile interval (95 %) of accuracy over 200 resamples: every record has a Poisson weight of a hash in each."""
    reps = 200
    right = ((F.col("score") >= 500) == (F.col("label") == 1)).cast("int")
    u = F.pmod(F.xxhash64("doc_id", "r"), F.lit(1_000_003)) / 1_000_003
    weight = sum((F.when(u >= c, 1).otherwise(0) for c in (0.36788, 0.73576, 0.91970, 0.98101, 0.99634, 0.99941)), F.lit(0))
    rows = records(spark, sf_dir).select("engine", "doc_id", right.alias("y"), F.explode(F.sequence(F.lit(1), F.lit(reps))).alias("r")).select("engine", "r", "y", weight.alias("w"))
    each = rows.groupBy("engine", "r").agg((F.sum(F.col("y") * F.col("w")) / F.sum("w")).alias("a"))
    return each.groupBy("engine").agg(F.percentile("a", F.lit(0.025)).alias("low"), F.percentile("a", F.lit(0.5)).alias("mid"), F.percentile("a", F.lit(0.975)).alias("high"))


def policy_verdict(spark, sf_dir):
    """Both scores of a document and two text ratios as evidence, decided by an ordered list of rules and a gate."""
    d = table(spark, sf_dir, "documents").select("doc_id", text.tokens(F.col("text")).alias("w"), F.length(text.clean(F.col("text"))).alias("c"), F.size(text.lines(F.col("text"))).alias("l"))
    e = d.select("doc_id", F.size("w").alias("n"), text.let(F.array_distinct("w"), lambda u: F.struct(F.size(u).alias("d"), F.size(F.filter(u, lambda t: F.length(t) >= 5)).alias("l"))).alias("u"), "l")
    one = F.lit(1)
    e = e.select("doc_id", (F.expr("1000 * u.d div greatest(n, 1)") / 1000).alias("structural"), (F.expr("1000 * u.l div greatest(u.d, 1)") / 1000).alias("lexical"), F.least(one, F.col("n") / 2000).alias("semantic"), F.least(one, F.col("l") / 20).alias("style"))
    s, x, v, y = (F.col(k) for k in ("structural", "lexical", "semantic", "style"))
    decided = (
        F.when(s < 0.60, "CLEAN")
        .when((s >= 0.90) & ((x >= 0.50) | (v >= 0.50)), "TRUE")
        .when((v >= 0.95) & (s >= 0.50), "PROBABLE")
        .when((s >= 0.75) & (x >= 0.50), "PROBABLE")
        .when((s >= 0.50) & (y >= 0.70), "PROBABLE")
        .when((s >= 0.70) & (x < 0.40) & (v < 0.40) & (y < 0.40), "REVIEW")
        .when((s >= 0.30) | (x >= 0.30) | (v >= 0.30), "REVIEW")
        .otherwise("CLEAN")
    )
    top = F.greatest(s, x, v, y)
    gate = (top < 0.5) | (s < 0.5) | (v < 0.15) | ((top >= 0.8) & (v < 0.4))
    z = -2.0 + 3.0 * s + 2.0 * x - 1.0 * y
    mean = (s + x + v + y) / 4
    spread = F.sqrt(F.greatest(F.lit(0.0), (s * s + x * x + v * v + y * y) / 4 - mean * mean))
    return e.select("doc_id", decided.alias("verdict"), gate.alias("gated"), F.round(1 / (1 + F.exp(-z)), 9).alias("learned"), F.round(mean * F.greatest(F.lit(0.0), 1 - 2 * spread), 6).alias("consensus"))


POLICY_SQL = """WITH tk AS (SELECT doc_id, regexp_extract_all(lower(coalesce(text, '')), '[a-z0-9]+') AS w, len(string_split(coalesce(text, ''), chr(10))) AS l FROM documents),
md AS (SELECT doc_id, len(w) AS n, l, list_distinct(w) AS u FROM tk),
e AS (SELECT doc_id, (1000 * len(u) // greatest(n, 1)) / 1000 AS s, (1000 * len([t for t in u if length(t) >= 5]) // greatest(len(u), 1)) / 1000 AS x, least(1, n / 2000) AS v, least(1, l / 20) AS y FROM md),
m AS (SELECT *, (s + x + v + y) / 4 AS mean, greatest(s, x, v, y) AS top FROM e)
SELECT doc_id, CASE WHEN s < 0.6::DOUBLE THEN 'CLEAN' WHEN s >= 0.9::DOUBLE AND (x >= 0.5 OR v >= 0.5) THEN 'TRUE' WHEN v >= 0.95::DOUBLE AND s >= 0.5 THEN 'PROBABLE' WHEN s >= 0.75 AND x >= 0.5 THEN 'PROBABLE'
 WHEN s >= 0.5 AND y >= 0.7::DOUBLE THEN 'PROBABLE' WHEN s >= 0.7::DOUBLE AND x < 0.4::DOUBLE AND v < 0.4::DOUBLE AND y < 0.4::DOUBLE THEN 'REVIEW' WHEN s >= 0.3::DOUBLE OR x >= 0.3::DOUBLE OR v >= 0.3::DOUBLE THEN 'REVIEW' ELSE 'CLEAN' END AS verdict,
 top < 0.5 OR s < 0.5 OR v < 0.15::DOUBLE OR (top >= 0.8::DOUBLE AND v < 0.4::DOUBLE) AS gated, round(1 / (1 + exp(-(-2.0::DOUBLE + 3.0::DOUBLE * s + 2.0::DOUBLE * x - y))), 9) AS learned,
 round(mean * greatest(0.0, 1 - 2 * sqrt(greatest(0.0, (s * s + x * x + v * v + y * y) / 4 - mean * mean))), 6) AS consensus FROM m"""

QUERIES = {
    "confusion": (confusion, CONFUSION_SQL),
    "threshold_sweep": (threshold_sweep, SWEEP_SQL),
    "optimal_threshold": (optimal_threshold, OPTIMAL_SQL),
    "roc_auc": (roc_auc, AUC_SQL),
    "roc_curve": (roc_curve, ROC_SQL),
    "average_precision": (average_precision, AP_SQL),
    "recall_at_fpr": (recall_at_fpr, RECALL_SQL),
    "calibration": (calibration, ECE_SQL),
    "precision_at_k": (precision_at_k, PK_SQL),
    "ndcg_at_k": (ndcg_at_k, NDCG_SQL),
    "map_mrr": (map_mrr, MAP_SQL),
    "rrf": (rrf, RRF_SQL),
    "stratified": (stratified, STRATA_SQL),
    "fpr_subgroup": (fpr_subgroup, FPR_SQL),
    "operational_metrics": (operational, OPERATIONAL_SQL),
    "wilson": (wilson, WILSON_SQL),
    "mcnemar_table": (mcnemar_table, MCNEMAR_SQL),
    "kappa": (kappa, KAPPA_SQL),
    "effect_sizes": (effect_sizes, EFFECT_SQL),
    "kfold": (kfold, KFOLD_SQL),
    "bootstrap_accuracy": (bootstrap_accuracy, None),
    "policy_verdict": (policy_verdict, POLICY_SQL),
}
