"""Evaluation across datasets, strata and components: who is best where, what an error comes from, what a change does."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tessella.functions import decisions as D
from tessella.operators import metrics as m
from tessella.plans.evaluation import _CONF, _RATES, _REC, records
from tessella.plans.fusion import _FEAT, NAMES, PRECISION, features
from tessella.session import table

THRESHOLD = 500


def cross_dataset(spark, sf_dir):
    """Every engine on every dataset (language), its rank there, and its mean and spread over datasets."""
    c = records(spark, sf_dir).groupBy("engine", F.coalesce("lang", F.lit("none")).alias("dataset")).agg(*m.confusion(F.col("score") >= THRESHOLD, F.col("label"))).select("*", *m.rates())
    placed = c.select("engine", "dataset", "f1", F.rank().over(Window.partitionBy("dataset").orderBy(F.desc(F.round("f1", 9)))).alias("place"))
    all_ = Window.partitionBy("engine")  # a row for each dataset
    return placed.select("engine", "dataset", F.round("f1", 9).alias("f1"), "place", F.round(F.avg("f1").over(all_), 9).alias("mean_f1"), F.round(F.stddev_pop("f1").over(all_), 9).alias("spread"))


CROSS_SQL = f"""WITH {_REC}, c AS (SELECT engine, coalesce(lang, 'none') AS dataset, {_CONF.format(500)} FROM rec GROUP BY 1, 2), s AS (SELECT *, {_RATES} FROM c)
SELECT engine, dataset, round(f1, 9) AS f1, rank() OVER (PARTITION BY dataset ORDER BY round(f1, 9) DESC)::INTEGER AS place, round(avg(f1) OVER (PARTITION BY engine), 9) AS mean_f1, round(stddev_pop(f1) OVER (PARTITION BY engine), 9) AS spread FROM s"""


def stratum_deltas(spark, sf_dir):
    """How one engine's F1 and accuracy differ from the other's in every stratum of language and source, kept if only one has it."""
    c = records(spark, sf_dir).groupBy("engine", F.coalesce("lang", F.lit("none")).alias("lang"), F.coalesce("source", F.lit("none")).alias("source")).agg(*m.confusion(F.col("score") >= THRESHOLD, F.col("label"))).select("*", *m.rates())
    side = lambda e, k: c.filter(F.col("engine") == e).select("lang", "source", F.col("f1").alias(f"f1_{k}"), F.col("accuracy").alias(f"accuracy_{k}"))
    both = side("distinct", "a").join(side("long", "b"), ["lang", "source"], "full_outer")
    gap = F.col("f1_b") - F.col("f1_a")
    return both.select("lang", "source", F.round("f1_a", 9).alias("f1_a"), F.round("f1_b", 9).alias("f1_b"), F.round(gap, 9).alias("f1_change"), F.round(F.col("accuracy_b") - F.col("accuracy_a"), 9).alias("accuracy_change"), F.when(gap < -0.05, "worse").when(gap > 0.05, "better").otherwise("same").alias("verdict"))


DELTA_SQL = f"""WITH {_REC}, c AS (SELECT engine, coalesce(lang, 'none') AS lang, coalesce(source, 'none') AS source, {_CONF.format(500)} FROM rec GROUP BY 1, 2, 3), s AS (SELECT *, {_RATES} FROM c),
j AS (SELECT lang, source, a.f1 AS fa, b.f1 AS fb, a.accuracy AS aa, b.accuracy AS ab FROM (SELECT * FROM s WHERE engine = 'distinct') a FULL JOIN (SELECT * FROM s WHERE engine = 'long') b USING (lang, source))
SELECT lang, source, round(fa, 9) AS f1_a, round(fb, 9) AS f1_b, round(fb - fa, 9) AS f1_change, round(ab - aa, 9) AS accuracy_change, CASE WHEN fb - fa < -0.05::DOUBLE THEN 'worse' WHEN fb - fa > 0.05::DOUBLE THEN 'better' ELSE 'same' END AS verdict FROM j"""


def pr_curve(spark, sf_dir):
    """Precision, recall and F-beta of each engine at a hundred thresholds; precision is 1 where nothing is flagged."""
    s = m.sweep(records(spark, sf_dir), ["engine"], 10).filter("threshold < 1000")
    p = F.when(F.col("tp") + F.col("fp") == 0, 1.0).otherwise(F.col("tp") / (F.col("tp") + F.col("fp")))
    r = m.ratio(F.col("tp"), F.col("tp") + F.col("fn"))
    beta = lambda b: F.when((p == 0) & (r == 0), 0.0).otherwise((1 + b * b) * p * r / (b * b * p + r))
    return s.select("engine", "threshold", F.round(p, 4).alias("precision"), F.round(r, 4).alias("recall"), F.round(beta(1), 6).alias("f1"), F.round(beta(2), 6).alias("f2"))


CURVE_SQL = f"""WITH {_REC}, c AS (SELECT engine, t::INTEGER AS threshold, {_CONF.format('t')} FROM rec, range(0, 1000, 10) r(t) GROUP BY engine, t),
s AS (SELECT *, CASE WHEN tp + fp = 0 THEN 1.0 ELSE tp / (tp + fp) END AS p, CASE WHEN tp + fn = 0 THEN 0.0 ELSE tp / (tp + fn) END AS r FROM c)
SELECT engine, threshold, round(p, 4) AS precision, round(r, 4) AS recall, round(CASE WHEN p = 0 AND r = 0 THEN 0.0 ELSE 2 * p * r / (p + r) END, 6) AS f1, round(CASE WHEN p = 0 AND r = 0 THEN 0.0 ELSE 5 * p * r / (4 * p + r) END, 6) AS f2 FROM s"""


def threshold_choice(spark, sf_dir):
    """The threshold of each engine by F1, by F2 and by precision and recall together; of equal ones the lowest."""
    c = pr_curve(spark, sf_dir)
    best = lambda value: F.max_by("threshold", F.struct(value, -F.col("threshold")))
    return c.groupBy("engine").agg(best(F.col("f1")).alias("by_f1"), best(F.col("f2")).alias("by_f2"), best(F.round(F.col("precision") + F.col("recall"), 4)).alias("by_sum"))


CHOICE_SQL = f"""WITH c AS ({CURVE_SQL}) SELECT engine, arg_max(threshold, f1 * 1e6 - threshold / 1e6) AS by_f1, arg_max(threshold, f2 * 1e6 - threshold / 1e6) AS by_f2, arg_max(threshold, round(precision + recall, 4) * 1e6 - threshold / 1e6) AS by_sum FROM c GROUP BY engine"""


def balanced_sample(spark, sf_dir):
    """As many negatives as positives of each engine's records, those with the least hash: a sampling operator."""
    r = records(spark, sf_dir).filter("engine = 'distinct'").withColumn("h", F.md5(F.concat(F.lit("balance-"), F.col("doc_id").cast("string"))))
    need = r.agg(F.least(F.count_if(F.col("label") == 1), F.count_if(F.col("label") == 0)).alias("k"))
    # places within buckets of the hash, and what buckets hold before: no task ranks a whole label
    r = r.filter("label IN (0, 1)").withColumn("bucket", F.substr("h", F.lit(1), F.lit(3)))
    held = r.groupBy("label", "bucket").agg(F.count(F.lit(1)).alias("n"))  # at most 8,192 rows
    before = held.select("label", "bucket", (F.sum("n").over(Window.partitionBy("label").orderBy("bucket")) - F.col("n")).alias("before"))
    placed = r.withColumn("place", F.row_number().over(Window.partitionBy("label", "bucket").orderBy("h"))).join(before, ["label", "bucket"])
    return placed.join(F.broadcast(need)).filter("place + before <= k").select("doc_id", "label", "score")  # need is one row


BALANCED_SQL = f"""WITH {_REC}, r AS (SELECT * FROM rec WHERE engine = 'distinct'), k AS (SELECT least(count(*) FILTER (label = 1), count(*) FILTER (label = 0)) AS k FROM r)
SELECT doc_id, label, score FROM r, k WHERE label IN (0, 1) QUALIFY row_number() OVER (PARTITION BY label ORDER BY md5('balance-' || doc_id)) <= k"""


def root_cause(spark, sf_dir):
    """Of pairs whose weighted score and shingles disagree about a limit of 0.8, the component that is furthest off."""
    f = features(spark, sf_dir)
    fused = D.total([F.col(k) * PRECISION[k] for k in NAMES]) / sum(PRECISION.values())
    wrong = f.withColumn("fused", F.round(fused, 6)).filter((F.col("fused") >= 0.8) != (F.col("fingerprint") >= 0.8))
    long = wrong.unpivot(["id_a", "id_b", "fused", "fingerprint"], [k for k in NAMES if k != "fingerprint"], "component", "score")
    loss = F.abs(F.col("score") - F.col("fingerprint"))
    return long.groupBy("id_a", "id_b").agg(F.max_by("component", F.struct(loss, "component")).alias("cause"), F.max(F.round(loss, 6)).alias("loss"), F.max(F.when(F.col("fused") >= 0.8, "false_alarm").otherwise("miss")).alias("error"))


_OTHERS = [k for k in NAMES if k != "fingerprint"]
CAUSE_SQL = f"""WITH {_FEAT}, w AS (SELECT *, round(({' + '.join(f'{k} * {PRECISION[k]}::DOUBLE' for k in NAMES)}) / {sum(PRECISION.values())}, 6) AS fused FROM feat), x AS (SELECT * FROM w WHERE (fused >= 0.8::DOUBLE) <> (fingerprint >= 0.8::DOUBLE)),
l AS ({' UNION ALL '.join(f"SELECT id_a, id_b, fused, '{k}' AS component, abs({k} - fingerprint) AS loss FROM x" for k in _OTHERS)})
SELECT id_a, id_b, max(component) FILTER (loss = top) AS cause, round(max(loss), 6) AS loss, max(CASE WHEN fused >= 0.8::DOUBLE THEN 'false_alarm' ELSE 'miss' END) AS error FROM (SELECT *, max(loss) OVER (PARTITION BY id_a, id_b) AS top FROM l) GROUP BY 1, 2"""


def ablations(spark, sf_dir):
    """What each component's absence does to the weighted score: the mean change, and the verdicts at 0.8 that turn."""
    f = features(spark, sf_dir)
    whole = sum(PRECISION.values())
    total = D.total([F.col(k) * PRECISION[k] for k in NAMES])
    without = [F.struct(F.lit(k).alias("component"), (total / whole).alias("with"), ((total - F.col(k) * PRECISION[k]) / (whole - PRECISION[k])).alias("without")) for k in NAMES]
    rows = f.select(F.explode(F.array(*without)).alias("x")).select("x.*").select("component", F.round("with", 9).alias("a"), F.round("without", 9).alias("b"))
    return rows.groupBy("component").agg(F.round(F.avg(F.col("b") - F.col("a")), 6).alias("mean_change"), F.count_if((F.col("a") >= 0.8) & (F.col("b") < 0.8)).alias("lost"), F.count_if((F.col("a") < 0.8) & (F.col("b") >= 0.8)).alias("gained"))


_TOTAL = " + ".join(f"{k} * {PRECISION[k]}::DOUBLE" for k in NAMES)
ABLATION_SQL = f"""WITH {_FEAT}, l AS ({' UNION ALL '.join(f"SELECT '{k}' AS component, round(({_TOTAL}) / {sum(PRECISION.values())}, 9) AS a, round(({_TOTAL} - {k} * {PRECISION[k]}::DOUBLE) / {sum(PRECISION.values()) - PRECISION[k]}, 9) AS b FROM feat" for k in NAMES)})
SELECT component, round(avg(b - a), 6) AS mean_change, count(*) FILTER (a >= 0.8::DOUBLE AND b < 0.8::DOUBLE) AS lost, count(*) FILTER (a < 0.8::DOUBLE AND b >= 0.8::DOUBLE) AS gained FROM l GROUP BY component"""


def weight_search(spark, sf_dir):
    """A grid of two weights over three scores, 66 settings, against the limit of 0.8 by shingles: the best by F1."""
    f = features(spark, sf_dir)
    grid = F.explode(F.array(*[F.struct(F.lit(i).alias("w_ngram"), F.lit(j).alias("w_token"), F.lit(10 - i - j).alias("w_winnowing")) for i in range(11) for j in range(11 - i)]))
    rows = f.select((F.col("fingerprint") >= 0.8).cast("int").alias("label"), *NAMES, grid.alias("g")).select("label", *NAMES, "g.*")
    score = (F.col("w_ngram") * F.col("ngram") + F.col("w_token") * F.col("token") + F.col("w_winnowing") * F.col("winnowing")) / 10
    c = rows.groupBy("w_ngram", "w_token", "w_winnowing").agg(*m.confusion(F.round(score, 6) >= 0.85, F.col("label"))).select("*", *m.rates())
    return c.select("w_ngram", "w_token", "w_winnowing", "tp", "fp", "fn", F.round("f1", 9).alias("f1")).orderBy(F.desc("f1"), "w_ngram", "w_token").limit(10)


SEARCH_SQL = f"""WITH {_FEAT}, g AS (SELECT i, j, 10 - i - j AS k FROM range(0, 11) a(i), range(0, 11) b(j) WHERE i + j <= 10),
c AS (SELECT i, j, k, round((i * ngram + j * token + k * winnowing) / 10, 6) >= 0.85::DOUBLE AS d, fingerprint >= 0.8::DOUBLE AS y FROM feat, g),
s AS (SELECT i::INTEGER AS w_ngram, j::INTEGER AS w_token, k::INTEGER AS w_winnowing, count(*) FILTER (d AND y) AS tp, count(*) FILTER (d AND NOT y) AS fp, count(*) FILTER (NOT d AND y) AS fn FROM c GROUP BY i, j, k)
SELECT *, round(CASE WHEN 2 * tp + fp + fn = 0 THEN 0.0 ELSE 2 * tp / (2 * tp + fp + fn) END, 9) AS f1 FROM s ORDER BY f1 DESC, w_ngram, w_token LIMIT 10"""


def top_features(spark, sf_dir):
    """The three highest scores of each pair with their bands."""
    entries = F.array(*[F.struct((-F.col(k)).alias("v"), F.lit(k).alias("k")) for k in NAMES])
    band = lambda v: F.when(v > 0.75, "HIGH").when(v > 0.5, "MEDIUM").otherwise("LOW")
    top = F.transform(F.slice(F.array_sort(entries), 1, 3), lambda x: F.concat_ws(":", x["k"], band(-x["v"])))
    return features(spark, sf_dir).select("id_a", "id_b", F.array_join(top, ",").alias("top"))


TOP_SQL = f"""WITH {_FEAT} SELECT id_a, id_b, array_to_string([x.k || ':' || CASE WHEN -x.v > 0.75 THEN 'HIGH' WHEN -x.v > 0.5 THEN 'MEDIUM' ELSE 'LOW' END for x in list_sort([{', '.join(f"{{'v': -{k}, 'k': '{k}'}}" for k in NAMES)}])[1:3]], ',') AS top FROM feat"""


def guardrails(spark, sf_dir):
    """What guards against false alarms: pairs that the cosine alone supports, and how far alarms fall when pairs with
    little coverage are discounted."""
    f = features(spark, sf_dir)
    concrete = F.greatest("fingerprint", "ngram", "winnowing")
    before, after = F.col("token") >= 0.8, F.when(F.col("coverage") < 0.8, F.col("token") * 0.55).otherwise(F.col("token")) >= 0.8
    t = f.agg(F.count_if((F.col("embedding") >= 0.75) & (concrete < 0.6)).alias("embedding_only"), F.count_if(before).alias("alarms_before"), F.count_if(after).alias("alarms_after"))
    return t.select("*", F.round(m.ratio(F.col("alarms_before") - F.col("alarms_after"), F.col("alarms_before")), 9).alias("reduction"))


GUARD_SQL = f"""WITH {_FEAT}, t AS (SELECT count(*) FILTER (embedding >= 0.75 AND greatest(fingerprint, ngram, winnowing) < 0.6::DOUBLE) AS embedding_only, count(*) FILTER (token >= 0.8::DOUBLE) AS alarms_before,
count(*) FILTER (CASE WHEN coverage < 0.8::DOUBLE THEN token * 0.55::DOUBLE ELSE token END >= 0.8::DOUBLE) AS alarms_after FROM feat)
SELECT *, round(CASE WHEN alarms_before = 0 THEN 0.0 ELSE (alarms_before - alarms_after) / alarms_before END, 9) AS reduction FROM t"""


def category_recall(spark, sf_dir):
    """Recall of every source and language, 1 where there is nothing to find, and false alarms of the same group."""
    c = records(spark, sf_dir).filter("engine = 'distinct'").groupBy(F.coalesce("source", F.lit("none")).alias("source"), F.coalesce("lang", F.lit("none")).alias("lang")).agg(*m.confusion(F.col("score") >= THRESHOLD, F.col("label")))
    r = F.when(F.col("tp") + F.col("fn") == 0, 1.0).otherwise(F.col("tp") / (F.col("tp") + F.col("fn")))
    return c.select("source", "lang", F.round(r, 9).alias("recall"), F.round(m.ratio(F.col("fp"), F.col("fp") + F.col("tn")), 9).alias("false_positive_rate"))


CATEGORY_SQL = f"""WITH {_REC}, c AS (SELECT coalesce(source, 'none') AS source, coalesce(lang, 'none') AS lang, {_CONF.format(500)} FROM rec WHERE engine = 'distinct' GROUP BY 1, 2)
SELECT source, lang, round(CASE WHEN tp + fn = 0 THEN 1.0 ELSE tp / (tp + fn) END, 9) AS recall, round(CASE WHEN fp + tn = 0 THEN 0.0 ELSE fp / (fp + tn) END, 9) AS false_positive_rate FROM c"""


def decisions_by_kind(spark, sf_dir):
    """Each document's verdict by the threshold of its language, from a small table of thresholds."""
    limits = spark.createDataFrame([("en", 450), ("de", 500), ("fr", 550)], "lang string, least long")  # a row for each kind
    r = records(spark, sf_dir).filter("engine = 'distinct'").join(F.broadcast(limits), "lang", "left")
    return r.groupBy(F.coalesce("lang", F.lit("none")).alias("lang"), (F.col("score") >= F.coalesce("least", F.lit(600))).alias("flagged")).agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("label") == 1).alias("positives"))


KIND_SQL = f"""WITH {_REC} SELECT coalesce(lang, 'none') AS lang, score >= CASE lang WHEN 'en' THEN 450 WHEN 'de' THEN 500 WHEN 'fr' THEN 550 ELSE 600 END AS flagged, count(*) AS n, count(*) FILTER (label = 1) AS positives FROM rec WHERE engine = 'distinct' GROUP BY 1, 2"""


def dataset_governance(spark, sf_dir):
    """Registered digests of each dataset (source) against those of its rows now: same, changed, new or gone. The register
    here lacks one source and has one that is not there."""
    digest = lambda d: d.groupBy(F.coalesce("source", F.lit("none")).alias("source")).agg(F.count(F.lit(1)).alias("n"), F.sum(F.conv(F.substr(F.md5(F.coalesce("text", F.lit(""))), F.lit(1), F.lit(8)), 16, 10).cast("long")).alias("digest"))
    docs = table(spark, sf_dir, "documents")
    now = digest(docs)
    known = digest(docs.filter("NOT (source = 'src1' AND doc_id % 3 = 0)")).filter("source <> 'src0'")
    known = known.unionByName(spark.createDataFrame([("missing", 1, 2)], "source string, n long, digest long"))
    both = now.toDF("source", "n", "d").join(known.toDF("source", "m", "e"), "source", "full_outer")
    state = F.when(F.col("m").isNull(), "new").when(F.col("n").isNull(), "gone").when((F.col("n") == F.col("m")) & (F.col("d") == F.col("e")), "same").otherwise("changed")
    return both.select("source", state.alias("state"), F.coalesce("n", F.lit(0)).alias("n"))


GOVERNANCE_SQL = """WITH d AS (SELECT doc_id, coalesce(source, 'none') AS source, source AS s, ('0x' || md5(coalesce(text, ''))[1:8])::BIGINT AS h FROM documents),
n AS (SELECT source, count(*) AS n, sum(h) AS d FROM d GROUP BY 1), k AS (SELECT source, count(*) AS m, sum(h) AS e FROM d WHERE NOT coalesce(s = 'src1' AND doc_id % 3 = 0, s IS NULL) AND source <> 'src0' GROUP BY 1 UNION ALL SELECT 'missing', 1, 2)
SELECT source, CASE WHEN m IS NULL THEN 'new' WHEN n IS NULL THEN 'gone' WHEN n = m AND d = e THEN 'same' ELSE 'changed' END AS state, coalesce(n, 0) AS n FROM n FULL JOIN k USING (source)"""

QUERIES = {
    "cross_dataset": (cross_dataset, CROSS_SQL),
    "stratum_deltas": (stratum_deltas, DELTA_SQL),
    "pr_curve": (pr_curve, CURVE_SQL),
    "threshold_choice": (threshold_choice, CHOICE_SQL),
    "balanced_sample": (balanced_sample, BALANCED_SQL),
    "root_cause": (root_cause, CAUSE_SQL),
    "ablations": (ablations, ABLATION_SQL),
    "weight_search": (weight_search, SEARCH_SQL),
    "top_features": (top_features, TOP_SQL),
    "guardrails": (guardrails, GUARD_SQL),
    "category_recall": (category_recall, CATEGORY_SQL),
    "decisions_by_kind": (decisions_by_kind, KIND_SQL),
    "dataset_governance": (dataset_governance, GOVERNANCE_SQL),
}
