"""Paired tests, calibration and stability of the engines' scores. Fits see a histogram of scores, 1001 rows at most."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Window
from pyspark.sql import functions as F

from tessella.functions import tails
from tessella.operators import metrics as m
from tessella.plans.evaluation import _CONF, _RATES, _REC, ENGINES, records

THRESHOLD = 500
Z95 = 1.959963984540054


def _pairs(spark, sf_dir):
    """Of each two engines, a before b by name, the scores and decisions on every document: one row for two engines and a
    document, from one pass over the scores of a document."""
    of = records(spark, sf_dir).groupBy("doc_id").agg(F.max("label").alias("label"), *[F.max(F.when(F.col("engine") == e, F.col("score"))).alias(e) for e in ENGINES])
    pairs = [F.struct(F.lit(a).alias("engine_a"), F.lit(b).alias("engine_b"), F.col(a).alias("a"), F.col(b).alias("b")) for i, a in enumerate(ENGINES) for b in ENGINES[i + 1 :]]
    return of.select("label", F.explode(F.array(*pairs)).alias("p")).select("label", "p.*")


_PAIRS = "pv AS (SELECT x.label, x.engine AS engine_a, y.engine AS engine_b, x.score AS a, y.score AS b FROM rec x JOIN rec y ON x.doc_id = y.doc_id AND x.engine < y.engine)"


def paired_tests(spark, sf_dir):
    """McNemar's and Wilcoxon's signed-rank test of each two engines, two-sided, with Bonferroni's correction for all of
    them, and the paired effect size. Ranks come from a histogram of differences."""
    pairs = _pairs(spark, sf_dir)
    right = lambda c: (F.col(c) >= THRESHOLD) == (F.col("label") == 1)
    key = ["engine_a", "engine_b"]
    d = F.col("a") - F.col("b")
    base = pairs.groupBy(*key).agg(m.count_if(right("a") & ~right("b")).alias("only_a"), m.count_if(~right("a") & right("b")).alias("only_b"), F.avg(d).alias("mean"), F.stddev_samp(d).alias("sd"))
    hist = pairs.select(*key, d.alias("d")).filter("d <> 0").groupBy(*key, F.abs("d").alias("size")).agg(F.count(F.lit(1)).alias("t"), m.count_if(F.col("d") > 0).alias("up"))
    before = F.sum("t").over(Window.partitionBy(*key).orderBy("size")) - F.col("t")
    t = F.col("t").cast("double")
    ranks = hist.select(*key, "up", "t", (before + (F.col("t") + 1) / 2).alias("r")).groupBy(*key).agg(F.sum(F.col("up") * F.col("r")).alias("w"), F.sum("t").cast("double").alias("n"), F.sum(t * t * t - t).alias("ties"))
    n = F.col("n")
    out = base.join(ranks, key)
    off = F.greatest(F.abs(F.col("only_a") - F.col("only_b")) - 1, F.lit(0))
    chi2 = m.ratio(off * off, F.col("only_a") + F.col("only_b"))
    z = (F.col("w") - n * (n + 1) / 4) / F.sqrt(n * (n + 1) * (2 * n + 1) / 24 - F.col("ties") / 48)
    out = out.select(*key, "only_a", "only_b", chi2.alias("chi2"), (2 * tails.normal_tail(F.sqrt(chi2))).alias("p_mcnemar"), F.col("w").alias("w_plus"), z.alias("z"), (2 * tails.normal_tail(z)).alias("p_wilcoxon"), (F.col("mean") / F.col("sd")).alias("d_paired"))
    tests = len(ENGINES) * (len(ENGINES) - 1)  # two tests of each two engines
    shown = ["chi2", "p_mcnemar", "w_plus", "z", "p_wilcoxon", "d_paired"]
    adjusted = [F.round(F.least(F.lit(1.0), F.col(f"p_{k}") * tests), 6).alias(f"adjusted_{k}") for k in ("mcnemar", "wilcoxon")]
    return out.select(*key, "only_a", "only_b", *[F.round(c, 6).alias(c) for c in shown], *adjusted, (F.least("p_mcnemar", "p_wilcoxon") < 0.05 / tests).alias("significant"))


_RIGHT = "(({0} >= 500) = (label = 1))"
PAIRED_SQL = f"""WITH {_REC}, {_PAIRS}, bs AS (SELECT engine_a, engine_b, count(*) FILTER ({_RIGHT.format('a')} AND NOT {_RIGHT.format('b')}) AS only_a, count(*) FILTER (NOT {_RIGHT.format('a')} AND {_RIGHT.format('b')}) AS only_b, avg(a - b) AS mean, stddev_samp(a - b) AS sd FROM pv GROUP BY 1, 2),
rk AS (SELECT engine_a, engine_b, a - b AS d, rank() OVER o + (count(*) OVER (PARTITION BY engine_a, engine_b, abs(a - b)) - 1) / 2 AS r, count(*) OVER (PARTITION BY engine_a, engine_b, abs(a - b)) AS t FROM pv WHERE a <> b WINDOW o AS (PARTITION BY engine_a, engine_b ORDER BY abs(a - b))),
wx AS (SELECT engine_a, engine_b, coalesce(sum(r) FILTER (d > 0), 0) AS w, count(*)::DOUBLE AS n, sum(t::DOUBLE * t - 1) AS ties FROM rk GROUP BY 1, 2),
st AS (SELECT *, CASE WHEN only_a + only_b = 0 THEN 0.0 ELSE greatest(abs(only_a - only_b) - 1, 0) ** 2 / (only_a + only_b) END AS chi2, (w - n * (n + 1) / 4) / sqrt(n * (n + 1) * (2 * n + 1) / 24 - ties / 48) AS z FROM bs JOIN wx USING (engine_a, engine_b)),
pp AS (SELECT *, 2 * {tails.NORMAL_TAIL_SQL.format('sqrt(chi2)')} AS p1, 2 * {tails.NORMAL_TAIL_SQL.format('z')} AS p2 FROM st)
SELECT engine_a, engine_b, only_a, only_b, round(chi2, 6) AS chi2, round(p1, 6) AS p_mcnemar, round(w, 6) AS w_plus, round(z, 6) AS z, round(p2, 6) AS p_wilcoxon, round(mean / sd, 6) AS d_paired,
round(least(1.0, p1 * 2), 6) AS adjusted_mcnemar, round(least(1.0, p2 * 2), 6) AS adjusted_wilcoxon, least(p1, p2) < 0.025::DOUBLE AS significant FROM pp"""


def isotonic(spark, sf_dir):
    """The best rising fit of the share of positives to the score of each engine, by pooling neighbours."""

    def fit(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("score", ignore_index=True)
        pools: list[list] = []  # positives, records, scores
        for pos, neg in zip(rows["pos"], rows["neg"], strict=True):
            pools.append([pos, pos + neg, 1])
            while len(pools) > 1 and pools[-2][0] * pools[-1][1] >= pools[-1][0] * pools[-2][1]:
                last = pools.pop()
                pools[-1] = [x + y for x, y in zip(pools[-1], last, strict=True)]
        return rows[["engine", "score"]].assign(calibrated=np.repeat([p / n for p, n, _ in pools], [k for *_, k in pools]))

    h = m.histogram(records(spark, sf_dir), ["engine"])
    return h.groupBy("engine").applyInPandas(fit, "engine string, score long, calibrated double").select("engine", "score", F.round("calibrated", 9).alias("calibrated"))


ISOTONIC_SQL = f"""WITH {_REC}, h AS (SELECT engine, score, count(*) FILTER (label = 1) AS pos, count(*) AS n FROM rec GROUP BY 1, 2),
c AS (SELECT *, row_number() OVER o AS i, sum(pos) OVER o AS cp, sum(n) OVER o AS cn FROM h WINDOW o AS (PARTITION BY engine ORDER BY score)),
jk AS (SELECT j.engine, j.i AS j, k.i AS k, (k.cp - j.cp + j.pos) / (k.cn - j.cn + j.n) AS v FROM c j JOIN c k ON j.engine = k.engine AND k.i >= j.i),
low AS (SELECT engine, j, k AS i, min(v) OVER (PARTITION BY engine, j ORDER BY k DESC) AS v FROM jk)
SELECT c.engine, c.score, round(max(v), 9) AS calibrated FROM c JOIN low ON low.engine = c.engine AND low.i = c.i GROUP BY 1, 2"""


def platt(spark, sf_dir):
    """a and b of 1 / (1 + exp(-(a s + b))) for each engine, s the score in [0, 1], lightly held to 0."""

    def fit(rows: pd.DataFrame) -> pd.DataFrame:
        s, pos, neg = rows["score"].to_numpy() / m.SCALE, rows["pos"].to_numpy(float), rows["neg"].to_numpy(float)
        w, x = np.zeros(2), np.stack((s, np.ones(len(s))))
        for _ in range(50):
            q = 1 / (1 + np.exp(-np.clip(w @ x, -30, 30)))
            g = x @ ((pos + neg) * q - pos) + 1e-3 * w
            w = w - np.clip(np.linalg.solve((x * ((pos + neg) * q * (1 - q))) @ x.T + 1e-3 * np.eye(2), g), -5, 5)
        return pd.DataFrame({"engine": [rows["engine"].iloc[0]], "a": [w[0]], "b": [w[1]]})

    return m.histogram(records(spark, sf_dir), ["engine"]).groupBy("engine").applyInPandas(fit, "engine string, a double, b double")


def clopper_pearson(spark, sf_dir):
    """Exact intervals (95 %) of accuracy by engine and language."""
    right = (F.col("score") >= THRESHOLD) == (F.col("label") == 1)
    a = records(spark, sf_dir).groupBy("engine", "lang").agg(F.count(F.lit(1)).alias("n"), m.count_if(right).alias("k"))

    @F.pandas_udf("struct<low:double,high:double>")
    def interval(k: pd.Series, n: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([tails.clopper_pearson(int(x), int(y)) for x, y in zip(k, n, strict=True)], columns=["low", "high"])

    return a.select("engine", "lang", "n", "k", interval("k", "n").alias("i")).select("engine", "lang", "n", "k", "i.low", "i.high")


def threshold_stability(spark, sf_dir):
    """How much F1 moves over 101 thresholds, and how many of them are within a twentieth of the best."""
    s = m.sweep(records(spark, sf_dir), ["engine"], 10).select("*", *m.rates())
    best = s.select("*", F.max("f1").over(Window.partitionBy("engine")).alias("best"))
    return best.groupBy("engine").agg(F.round(F.stddev_pop("f1"), 9).alias("f1_spread"), F.round(F.max("f1"), 9).alias("f1_best"), F.round(F.min("f1"), 9).alias("f1_worst"), m.count_if(F.col("f1") >= 0.95 * F.col("best")).alias("stable_thresholds"))


STABILITY_SQL = f"""WITH {_REC}, c AS (SELECT engine, t AS threshold, {_CONF.format('t')} FROM rec, range(0, 1001, 10) r(t) GROUP BY engine, t), s AS (SELECT *, {_RATES} FROM c), b AS (SELECT *, max(f1) OVER (PARTITION BY engine) AS best FROM s)
SELECT engine, round(stddev_pop(f1), 9) AS f1_spread, round(max(f1), 9) AS f1_best, round(min(f1), 9) AS f1_worst, count(*) FILTER (f1 >= 0.95::DOUBLE * best) AS stable_thresholds FROM b GROUP BY engine"""


def failure_clusters(spark, sf_dir):
    """Wrong decisions by what they look like: near the threshold, far from it, by error and language."""
    r = records(spark, sf_dir).withColumn("flagged", F.col("score") >= THRESHOLD).filter(F.col("flagged") != (F.col("label") == 1))
    gap = F.abs(F.col("score") - THRESHOLD)
    kind = F.concat(F.when(F.col("flagged"), "false_alarm").otherwise("miss"), F.when(gap < 50, "_near").when(gap < 200, "_clear").otherwise("_gross"))
    return r.groupBy("engine", "lang", kind.alias("pattern")).agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("score"), 6).alias("mean_score"))


FAILURE_SQL = f"""WITH {_REC} SELECT engine, lang, CASE WHEN score >= 500 THEN 'false_alarm' ELSE 'miss' END || CASE WHEN abs(score - 500) < 50 THEN '_near' WHEN abs(score - 500) < 200 THEN '_clear' ELSE '_gross' END AS pattern, count(*) AS n, round(avg(score), 6) AS mean_score
FROM rec WHERE (score >= 500) <> (label = 1) GROUP BY 1, 2, 3"""


def tool_ranking(spark, sf_dir):
    """Engines by F1 with their Wilson interval of accuracy, and whether each meets the rules of a release."""
    c = records(spark, sf_dir).groupBy("engine").agg(*m.confusion(F.col("score") >= THRESHOLD, F.col("label"))).select("*", *m.rates())
    n, p = F.col("tp") + F.col("fp") + F.col("tn") + F.col("fn"), F.col("accuracy")
    low = (p + Z95 * Z95 / (2 * n)) / (1 + Z95 * Z95 / n) - Z95 * F.sqrt(p * (1 - p) / n + Z95 * Z95 / (4 * n * n)) / (1 + Z95 * Z95 / n)
    place = F.row_number().over(Window.partitionBy(F.lit(1)).orderBy(F.desc("f1"), "engine"))  # a row for each engine
    passed = (F.col("precision") >= 0.5) & (F.col("recall") >= 0.5) & (n >= 30)
    return c.select("engine", place.cast("int").alias("rank"), F.round("f1", 9).alias("f1"), F.round(low, 9).alias("accuracy_low"), F.when(passed, "PASS").otherwise("FAIL").alias("verdict"))


RANKING_SQL = f"""WITH {_REC}, c AS (SELECT engine, {_CONF.format(500)} FROM rec GROUP BY engine), s AS (SELECT *, {_RATES}, tp + fp + tn + fn AS n, {Z95}::DOUBLE AS z FROM c)
SELECT engine, row_number() OVER (ORDER BY f1 DESC, engine)::INTEGER AS rank, round(f1, 9) AS f1, round((accuracy + z * z / (2 * n)) / (1 + z * z / n) - z * sqrt(accuracy * (1 - accuracy) / n + z * z / (4 * n * n)) / (1 + z * z / n), 9) AS accuracy_low,
CASE WHEN precision >= 0.5 AND recall >= 0.5 AND n >= 30 THEN 'PASS' ELSE 'FAIL' END AS verdict FROM s"""

QUERIES = {
    "paired_tests": (paired_tests, PAIRED_SQL),
    "isotonic": (isotonic, ISOTONIC_SQL),
    "platt": (platt, None),
    "clopper_pearson": (clopper_pearson, None),
    "threshold_stability": (threshold_stability, STABILITY_SQL),
    "failure_clusters": (failure_clusters, FAILURE_SQL),
    "tool_ranking": (tool_ranking, RANKING_SQL),
}
