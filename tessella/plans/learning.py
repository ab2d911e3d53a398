"""Resampled comparison of engines, models trained with grouped folds, and shared bugs of submissions."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tessella.functions import signals, text
from tessella.operators import learning, resampling
from tessella.operators import metrics as m
from tessella.plans.evaluation import _REC, records
from tessella.plans.statistics import THRESHOLD
from tessella.session import table, written

SAMPLES, FOLDS = 1000, 3


def paired_bootstrap(spark, sf_dir):
    """The difference of two engines in accuracy and F1 over resamples of the documents: its mean, 95 % interval, and how
    often a resample is as far from what is observed as that is from nothing (``p_value``), or from nothing itself
    (``p_uncentred``)."""
    right = lambda e: (F.col(e) >= THRESHOLD) == (F.col("label") == 1)
    yes = lambda e, on, label: ((F.col(e) >= THRESHOLD) == on) & (F.col("label") == label)
    both = records(spark, sf_dir).groupBy("doc_id").agg(F.max("label").alias("label"), *[F.max(F.when(F.col("engine") == e, F.col("score"))).alias(k) for e, k in (("distinct", "a"), ("long", "b"))])
    counts = {"n": F.lit(True)} | {f"{what}_{e}": c for e in "ab" for what, c in (("right", right(e)), ("tp", yes(e, True, 1)), ("fp", yes(e, True, 0)), ("fn", yes(e, False, 1)))}
    sums = resampling.resampled(both.select("doc_id", *[c.cast("int").alias(k) for k, c in counts.items()]), "doc_id", list(counts), SAMPLES)
    f1 = lambda e: m.ratio(2 * F.col(f"tp_{e}"), 2 * F.col(f"tp_{e}") + F.col(f"fp_{e}") + F.col(f"fn_{e}"))
    shown = {"accuracy": m.ratio(F.col("right_a") - F.col("right_b"), F.col("n")), "f1": f1("a") - f1("b")}
    each = sums.select("sample", F.explode(F.array(*[F.struct(F.lit(k).alias("metric"), F.round(v, 12).alias("d")) for k, v in shown.items()])).alias("x")).select("sample", "x.*")
    each = each.withColumn("observed", F.max(F.when(F.col("sample") == 0, F.col("d"))).over(Window.partitionBy("metric"))).filter("sample > 0")
    far = lambda c: F.avg((F.round(F.abs(c), 12) >= F.abs("observed")).cast("int"))
    return each.groupBy("metric", "observed").agg(F.round(F.avg("d"), 9).alias("mean"), F.round(F.percentile("d", F.lit(0.025)), 9).alias("low"), F.round(F.percentile("d", F.lit(0.975)), 9).alias("high"), far(F.col("d") - F.col("observed")).alias("p_value"), far(F.col("d")).alias("p_uncentred"))


_SUMS = ", ".join(f"sum(w * ({c})::INT) AS {k}_{e}" for e in "ab" for k, c in (("right", f"({e} >= 500) = (label = 1)"), ("tp", f"{e} >= 500 AND label = 1"), ("fp", f"{e} >= 500 AND label = 0"), ("fn", f"{e} < 500 AND label = 1")))
_F1 = "CASE WHEN 2 * tp_{0} + fp_{0} + fn_{0} = 0 THEN 0.0 ELSE 2 * tp_{0} / (2 * tp_{0} + fp_{0} + fn_{0}) END"
BOOTSTRAP_SQL = f"""WITH {_REC}, bo AS (SELECT doc_id, max(label) AS label, max(score) FILTER (engine = 'distinct') AS a, max(score) FILTER (engine = 'long') AS b FROM rec GROUP BY doc_id),
rs AS (SELECT r, label, a, b, CASE WHEN r = 0 THEN 1 ELSE {resampling.weight_sql('doc_id', 'r')} END AS w FROM bo, range({SAMPLES + 1}) s(r)),
sm AS (SELECT r, sum(w) AS n, {_SUMS} FROM rs GROUP BY r),
ds AS (SELECT r, 'accuracy' AS metric, round((right_a - right_b) / n, 12) AS d FROM sm UNION ALL SELECT r, 'f1', round(({_F1.format('a')}) - ({_F1.format('b')}), 12) FROM sm),
ob AS (SELECT metric, d AS observed FROM ds WHERE r = 0)
SELECT metric, observed, round(avg(d), 9) AS mean, round(quantile_cont(d, 0.025), 9) AS low, round(quantile_cont(d, 0.975), 9) AS high,
avg((round(abs(d - observed), 12) >= abs(observed))::INT) AS p_value, avg((round(abs(d), 12) >= abs(observed))::INT) AS p_uncentred FROM ds JOIN ob USING (metric) WHERE r > 0 GROUP BY metric, observed"""


def training_rows(spark, sf_dir):
    """doc_id, features (line and token measures), label and fold of labelled documents; a source is one group."""
    labels = table(spark, sf_dir, "labels").groupBy("doc_id").agg(F.max("quality").alias("label"))
    docs = table(spark, sf_dir, "documents").join(labels, "doc_id").filter("label IS NOT NULL")
    styles = signals.styles(F.col("text"))
    words = text.tokens(F.col("text"))
    own = text.let(words, lambda w: F.array(F.log1p(F.size(w).cast("double")), F.size(F.array_distinct(w)) / F.greatest(F.size(w), F.lit(1))))
    features = F.transform(F.concat(F.array(*[c.cast("double") for c in styles.values()]), own), lambda x: F.coalesce(x, F.lit(0.0)))
    return written(docs.select("doc_id", "source", features.alias("features"), "label", learning.fold_of(F.col("source"), FOLDS).alias("fold")), "training")


def grouped_training(spark, sf_dir):
    """A model for each fold from the other folds' sources, held against its own: accuracy, and area under the curve."""
    rows = training_rows(spark, sf_dir)
    first = rows.select(F.size("features")).first()
    if first is None:
        return spark.createDataFrame([], "fold int, n long, positives long, accuracy double, auc double")
    w, mean, sd = learning.logistic(rows, first[0], FOLDS)
    held = learning.predicted(rows, w, mean, sd, F.col("fold"))
    scored = held.select("fold", "label", F.round(F.col("p") * m.SCALE).cast("long").alias("score"))
    auc = m.roc_auc(scored, ["fold"]).select("fold", F.round("auc", 6).alias("auc"))
    base = held.groupBy("fold").agg(F.count(F.lit(1)).alias("n"), m.count_if(F.col("label") == 1).alias("positives"), F.round(F.avg(((F.col("p") >= 0.5) == (F.col("label") == 1)).cast("int")), 6).alias("accuracy"))
    return base.join(auc, "fold")


#: What a shared wrong output, exception and timeout count.
SHARED = {"timeout": 0.8, "exception": 0.9, "output": 1.0}


def same_bugs(pairs, outcomes):
    """id_a, id_b, shared (tests that both ran), timeouts, exceptions, outputs (wrong and equal but for case and white space)
    and score, for pairs of submissions and outcomes (id, test, output, expected, exception, timed_out), one for a test."""
    plain = lambda c: F.trim(F.regexp_replace(F.lower(F.coalesce(c, F.lit(""))), r"\s+", " "))
    o = outcomes.select("id", "test", plain(F.col("output")).alias("out"), plain(F.col("expected")).alias("want"), F.col("expected").isNotNull().alias("known"), F.coalesce("exception", F.lit("")).alias("exc"), F.coalesce("timed_out", F.lit(False)).alias("late"))
    side = lambda s: o.select(F.col("id").alias(f"id_{s}"), "test", *[F.col(c).alias(f"{c}_{s}") for c in ("out", "want", "known", "exc", "late")])
    met = pairs.select("id_a", "id_b").join(side("a"), "id_a").join(side("b"), ["id_b", "test"])
    wrong = F.col("known_a") & F.col("known_b") & (F.col("out_a") == F.col("out_b")) & (F.col("out_a") != F.col("want_a"))
    kind = F.when(F.col("late_a") & F.col("late_b"), "timeout").when((F.col("exc_a") != "") & (F.col("exc_a") == F.col("exc_b")), "exception").when(wrong, "output")
    n = {k: m.count_if(kind == k) for k in SHARED}
    found = met.groupBy("id_a", "id_b").agg(F.count(F.lit(1)).alias("shared"), *[c.alias(f"{k}s") for k, c in n.items()])
    score = F.least(F.lit(1.0), sum((F.col(f"{k}s") * v for k, v in SHARED.items()), F.lit(0.0)) / F.col("shared"))
    return found.withColumn("score", F.round(score, 4))


def same_bug(spark, sf_dir):
    """Suppliers stand for submissions, parts for tests; each is compared with the next one and with the tenth on."""
    l = table(spark, sf_dir, "lineitem")  # noqa: E741
    last = F.max(F.struct("l_orderkey", "l_linenumber", "l_returnflag", "l_linestatus", "l_quantity", "l_discount", "l_tax")).alias("x")
    o = l.groupBy(F.col("l_suppkey").alias("id"), (F.col("l_partkey") % 40).alias("test")).agg(last)
    exc = F.when(F.col("x.l_tax") >= 0.07, F.concat(F.lit("Error"), F.col("x.l_linestatus")))
    expected = F.when(F.col("test") % 5 > 0, "n  n")
    outcomes = o.select("id", "test", F.concat("x.l_returnflag", F.lit(" "), "x.l_returnflag").alias("output"), expected.alias("expected"), exc.alias("exception"), (F.col("x.l_discount") >= 0.08).alias("timed_out"))
    s = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("id_a"))
    return same_bugs(s.select("id_a", F.explode(F.array(F.col("id_a") + 1, F.col("id_a") + 10)).alias("id_b")), outcomes)


SAME_BUG_SQL = """WITH x AS (SELECT *, l_partkey % 40 AS test FROM lineitem QUALIFY row_number() OVER (PARTITION BY l_suppkey, l_partkey % 40 ORDER BY l_orderkey DESC, l_linenumber DESC, l_returnflag DESC, l_linestatus DESC, l_quantity DESC, l_discount DESC, l_tax DESC) = 1),
o AS (SELECT l_suppkey AS id, test, lower(l_returnflag || ' ' || l_returnflag) AS out, CASE WHEN test % 5 > 0 THEN 'n n' END AS want, CASE WHEN l_tax >= 0.07::DOUBLE THEN 'Error' || l_linestatus ELSE '' END AS exc, l_discount >= 0.08::DOUBLE AS late FROM x),
p AS (SELECT s_suppkey AS id_a, s_suppkey + unnest([1, 10]) AS id_b FROM supplier),
k AS (SELECT id_a, id_b, CASE WHEN a.late AND b.late THEN 't' WHEN a.exc <> '' AND a.exc = b.exc THEN 'e' WHEN a.want IS NOT NULL AND a.out = b.out AND a.out <> a.want THEN 'o' END AS kind FROM p JOIN o a ON a.id = id_a JOIN o b ON b.id = id_b AND b.test = a.test)
SELECT id_a, id_b, count(*) AS shared, count(*) FILTER (kind = 't') AS timeouts, count(*) FILTER (kind = 'e') AS exceptions, count(*) FILTER (kind = 'o') AS outputs,
round(least(1.0, (count(*) FILTER (kind = 't') * 0.8::DOUBLE + count(*) FILTER (kind = 'e') * 0.9::DOUBLE + count(*) FILTER (kind = 'o')) / count(*)), 4) AS score FROM k GROUP BY 1, 2"""

QUERIES = {
    "paired_bootstrap": (paired_bootstrap, BOOTSTRAP_SQL),
    "grouped_training": (grouped_training, None),
    "same_bug": (same_bug, SAME_BUG_SQL),
}
