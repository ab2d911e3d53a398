"""Scores of candidate pairs side by side, and the decisions over them."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from tessella.functions import decisions as D
from tessella.functions import scores as S
from tessella.operators import setjoin, shingling
from tessella.plans.similarity import _COUNTS, _FP, _RISK, _SETS, DEN, NUM, shingled
from tessella.session import table, written

NAMES = ("fingerprint", "ngram", "winnowing", "token", "embedding", "stylometry")
#: Precisions and weights of the scores where several are averaged.
PRECISION = {"fingerprint": 8.0, "ngram": 6.0, "winnowing": 6.0, "token": 5.0, "embedding": 3.0, "stylometry": 1.0}


_MET = "m long, dot long, na long, nb long, qa long, qb long, g long, a_g long, b_g long, f long, a_f long, b_f long, la double, lb double"


def _sets(t, g, f, length):
    """Tokens with their numbers, pairs of tokens, prints; and the numbers of each, and the mean length of tokens."""
    (t, c), f = setjoin.tallied(t), np.unique(f)
    return [(t, c), (g, None), (f, None)], (int(c.sum()), int(c @ c), len(g), len(f), length)


def _met(common, dot, x, y):
    """What documents share with each other, and the sizes of both sides."""
    n, k = x.astype(np.int64), y.astype(np.int64)
    return (common[:, 0], dot, n[:, 0], k[:, 0], n[:, 1], k[:, 1], common[:, 1], n[:, 2], k[:, 2], common[:, 2], n[:, 3], k[:, 3], x[:, 4], y[:, 4]), None


def features(spark, sf_dir):
    """id_a, id_b, the scores of NAMES (0 to 1, six digits) and coverage of the pairs of classes whose shingles agree by a
    half: shingles, pairs of tokens, winnowing prints, tokens with their numbers, the cosine of tokens, token lengths."""
    sets = shingled(spark, sf_dir)[0]
    n = sets.select("id", F.col("n").alias("size"))
    pairs = setjoin.jaccard_pairs(sets, NUM, DEN).join(n.toDF("id_a", "na"), "id_a").join(n.toDF("id_b", "nb"), "id_b")
    pairs = written(pairs.select("id_a", "id_b", (F.col("common") / F.col("total")).alias("fingerprint"), (F.col("common") / F.least("na", "nb")).alias("coverage")), "pairs")
    docs = setjoin.of_pairs(table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text"), pairs)
    sides = written(shingling.measured(docs, 5, 4), "sides")
    found = setjoin.overlapped(pairs.select("id_a", "id_b"), _sets, _met, _MET, sides)
    prints_all = F.col("a_f") + F.col("b_f") - F.col("f")
    scores = {"ngram": 2 * F.col("g") / (F.col("a_g") + F.col("b_g")), "winnowing": F.when(prints_all == 0, 1.0).otherwise(F.col("f") / prints_all), "token": setjoin.multiset_jaccard(), "embedding": setjoin.cosine()}
    out = pairs.join(found.select("id_a", "id_b", "la", "lb", *[c.alias(k) for k, c in scores.items()]), ["id_a", "id_b"])
    style = 1 - F.abs(F.col("la") - F.col("lb")) / F.greatest("la", "lb")
    return written(out.withColumn("stylometry", style).select("id_a", "id_b", *[F.round(k, 6).alias(k) for k in (*NAMES, "coverage")]), "features")


_FEAT = f"""{_SETS}, {_COUNTS.format('w')}, {_FP},
fs AS (SELECT id, list(DISTINCT h) AS x FROM fh GROUP BY id),
bg AS (SELECT id, list_distinct(CASE WHEN len(w) < 2 THEN w ELSE [w[i] || ' ' || w[i + 1] for i in range(1, len(w))] END) AS x, list_sum([length(t) for t in w]) / len(w) AS l FROM tok WHERE len(w) > 0),
feat AS (SELECT cand.id_a, cand.id_b, round(common / total, 6) AS fingerprint, round(common / least(x.n, y.n), 6) AS coverage,
 round(2 * len(list_intersect(ga.x, gb.x)) / (len(ga.x) + len(gb.x)), 6) AS ngram,
 round(len(list_intersect(fa.x, fb.x)) / (len(fa.x) + len(fb.x) - len(list_intersect(fa.x, fb.x))), 6) AS winnowing,
 round(CASE WHEN na + nb - m = 0 THEN 1.0 ELSE m / (na + nb - m) END, 6) AS token, round(CASE WHEN qa = 0 OR qb = 0 THEN 0.0 ELSE dot / sqrt(qa::DOUBLE * qb) END, 6) AS embedding,
 round(1 - abs(ga.l - gb.l) / greatest(ga.l, gb.l), 6) AS stylometry
 FROM cand JOIN cls x ON x.id = cand.id_a JOIN cls y ON y.id = cand.id_b JOIN pc ON pc.id_a = cand.id_a AND pc.id_b = cand.id_b
 JOIN bg ga ON ga.id = cand.id_a JOIN bg gb ON gb.id = cand.id_b JOIN fs fa ON fa.id = cand.id_a JOIN fs fb ON fb.id = cand.id_b)"""
FEATURES_SQL = f"WITH {_FEAT} SELECT * FROM feat"


def _s():
    return {k: F.col(k) for k in NAMES}


def fusion_decision(spark, sf_dir):
    """Gate, exact match, policy and confidence of each pair, as code and as a configuration file."""
    f = features(spark, sf_dir)
    out = []
    for kind in ("CODE", "CONFIG"):
        s = D.weighted_by_file(_s(), F.lit(kind))
        e = D.evidence(s)
        gate, exact = D.gated(_s(), F.col("coverage")), F.col("fingerprint") >= 0.95
        verdict = D.policy(e)
        sure = D.confidence(verdict, e, F.col("coverage"))
        driven = F.lit(kind == "CONFIG") & (s["embedding"] > 0.7 * D.highest(s, *s))
        final = D.rules((gate, "CLEAN"), (exact, "TRUE"), (driven & verdict.isin("TRUE", "PROBABLE"), "REVIEW"), otherwise=verdict)
        score = D.rules((gate, 0.0), (exact, 1.0), (driven, F.least(sure, F.lit(0.4))), otherwise=sure)
        out.append(f.select("id_a", "id_b", F.lit(kind).alias("kind"), *[F.round(v, 6).alias(k) for k, v in e.items()], final.alias("verdict"), F.round(score, 9).alias("score")))
    return out[0].unionByName(out[1])


_W = {k: {n: D.FILE_WEIGHTS[k].get(n, 1.0) for n in NAMES} for k in ("CODE", "CONFIG")}
_WEIGHTED = " UNION ALL ".join(f"SELECT id_a, id_b, coverage, fingerprint AS exact, '{k}' AS kind, greatest(fingerprint, ngram, winnowing, token, embedding, stylometry) AS top, greatest(ngram, winnowing, token, fingerprint) AS built, " + ", ".join(f"{n} * {x}::DOUBLE AS {n}" for n, x in w.items()) + " FROM feat" for k, w in _W.items())
_POLICY = "CASE WHEN structural < 0.6::DOUBLE THEN 'CLEAN' WHEN structural >= 0.9::DOUBLE AND (lexical >= 0.5 OR semantic >= 0.5) THEN 'TRUE' WHEN semantic >= 0.95::DOUBLE AND structural >= 0.5 THEN 'PROBABLE' WHEN structural >= 0.75 AND lexical >= 0.5 THEN 'PROBABLE' WHEN structural >= 0.5 AND style >= 0.7::DOUBLE THEN 'PROBABLE' ELSE 'REVIEW' END"
DECISION_SQL = f"""WITH {_FEAT}, w AS ({_WEIGHTED}),
e AS (SELECT *, greatest(ngram, winnowing) AS structural, greatest(fingerprint, winnowing, ngram) AS lexical, embedding AS semantic, stylometry AS style, greatest(fingerprint, ngram, winnowing, token, embedding, stylometry) AS wtop FROM w),
p AS (SELECT *, {_POLICY} AS v, least(1.0::DOUBLE, greatest(structural, lexical, semantic, style, coverage)) AS x, kind = 'CONFIG' AND embedding > 0.7::DOUBLE * wtop AS driven,
 top < 0.5 OR built < 0.5 OR coverage < 0.15::DOUBLE OR (top >= 0.8::DOUBLE AND coverage < 0.4::DOUBLE) AS gate FROM e),
c AS (SELECT *, CASE v WHEN 'CLEAN' THEN 0.05::DOUBLE + 0.3::DOUBLE * x WHEN 'PROBABLE' THEN 0.7::DOUBLE + 0.15::DOUBLE * x WHEN 'REVIEW' THEN 0.4::DOUBLE + 0.3::DOUBLE * x ELSE 0.85::DOUBLE + 0.15::DOUBLE * x END AS sure FROM p)
SELECT id_a, id_b, kind, round(structural, 6) AS structural, round(lexical, 6) AS lexical, round(semantic, 6) AS semantic, round(style, 6) AS style,
CASE WHEN gate THEN 'CLEAN' WHEN exact >= 0.95::DOUBLE THEN 'TRUE' WHEN driven AND v IN ('TRUE', 'PROBABLE') THEN 'REVIEW' ELSE v END AS verdict,
round(CASE WHEN gate THEN 0.0 WHEN exact >= 0.95::DOUBLE THEN 1.0 WHEN driven THEN least(sure, 0.4::DOUBLE) ELSE sure END, 9) AS score FROM c"""


def evidence_hierarchy(spark, sf_dir):
    """The layered decision of each pair, the three layers' values, and a policy file's verdict on them."""
    verdict, sure = D.hierarchy(_s(), F.col("fingerprint") >= 1.0)
    one, two, three = D.layers(F.col("fingerprint"), {"token": F.col("token"), "winnowing": F.col("winnowing"), "ngram": F.col("ngram"), "embedding": D.semantic_corrected(F.col("embedding"))}, 1 - F.col("stylometry"))
    by_rules = D.policy_rules(RULES, {"layer1": one, "layer2": two, "layer3": three, "coverage": F.col("coverage")}, "CLEAN")
    return features(spark, sf_dir).select("id_a", "id_b", verdict.alias("verdict"), sure.alias("confidence"), F.round(one, 6).alias("layer1"), F.round(two, 6).alias("layer2"), F.round(three, 6).alias("layer3"), by_rules.alias("by_rules"))


#: A policy: the first rule that holds decides.
RULES = [
    {"when": {"layer1": ">= 0.95"}, "verdict": "TRUE"},
    {"when": {"and": [{"layer1": ">= 0.7"}, {"or": [{"layer2": "> 0.9"}, {"layer3": ">= 0.9"}]}]}, "verdict": "PROBABLE"},
    {"when": {"layer1": "<= 0.65", "coverage": "< 0.8"}, "verdict": "REVIEW"},
]
_SEM = "CASE WHEN embedding >= 0.95::DOUBLE THEN least(0.99::DOUBLE, embedding) ELSE least(0.99::DOUBLE, greatest(0.0::DOUBLE, embedding - 0.7::DOUBLE) / 0.3::DOUBLE) END"
HIERARCHY_SQL = f"""WITH {_FEAT}, x AS (SELECT *, greatest(ngram, winnowing) AS b, stylometry AS t, {_SEM} AS m FROM feat),
y AS (SELECT *, CASE WHEN fingerprint >= 1 THEN 0 WHEN b >= 0.9::DOUBLE THEN 1 WHEN m >= 0.95::DOUBLE THEN 2 WHEN b >= 0.75 THEN 3 WHEN b >= 0.5 AND t >= 0.7::DOUBLE THEN 4 WHEN m >= 0.85::DOUBLE AND b < 0.5 THEN 5 WHEN abs(b - m) > 0.5 THEN 6 WHEN b >= 0.3::DOUBLE OR t >= 0.3::DOUBLE THEN 7 ELSE 8 END AS k,
 CASE WHEN fingerprint >= 0.9::DOUBLE THEN fingerprint ELSE greatest(token, winnowing, ngram) END AS l1, least(0.95::DOUBLE, m) AS l3 FROM x)
SELECT id_a, id_b, ['TRUE', 'TRUE', 'PROBABLE', 'TRUE', 'PROBABLE', 'REVIEW', 'REVIEW', 'REVIEW', 'CLEAN'][k + 1] AS verdict, [0.99, 0.95, 0.85, 0.9, 0.75, 0.6, 0.5, 0.4, 0.1][k + 1]::DOUBLE AS confidence,
round(l1, 6) AS layer1, round(1 - (1 - t), 6) AS layer2, round(l3, 6) AS layer3,
CASE WHEN l1 >= 0.95::DOUBLE THEN 'TRUE' WHEN l1 >= 0.7::DOUBLE AND (1 - (1 - t) > 0.9::DOUBLE OR l3 >= 0.9::DOUBLE) THEN 'PROBABLE' WHEN l1 <= 0.65::DOUBLE AND coverage < 0.8::DOUBLE THEN 'REVIEW' ELSE 'CLEAN' END AS by_rules FROM y"""


def conflict_resolution(spark, sf_dir):
    """How far three views of a pair agree, what is made of it, and the kind of copy that it looks like."""
    s = {"ast": F.col("ngram"), "gst": F.col("winnowing"), "token": F.col("token"), "semantic": F.col("embedding"), "cfg": F.col("fingerprint")}
    level, value, score, action = D.conflicts(s)
    kind, sure = D.clone_kind(F.col("token"), F.col("ngram"), F.col("fingerprint"), F.col("embedding"))
    return features(spark, sf_dir).select("id_a", "id_b", level.alias("level"), value.alias("confidence"), F.round(score, 9).alias("score"), action.alias("action"), kind.alias("kind"), F.round(sure, 9).alias("kind_confidence"))


CONFLICT_SQL = f"""WITH {_FEAT}, x AS (SELECT *, abs(ngram - winnowing) + abs(ngram - token) + abs(winnowing - token) AS gap, (ngram + winnowing + token + embedding + fingerprint) / 5 AS mean FROM feat),
y AS (SELECT *, CASE WHEN gap < 0.3::DOUBLE AND mean > 0.7::DOUBLE THEN 1 WHEN ngram > 0.85::DOUBLE AND winnowing > 0.7::DOUBLE AND gap < 0.6::DOUBLE THEN 2 WHEN ngram > 0.8::DOUBLE AND winnowing > 0.5 THEN 3 WHEN ngram > 0.7::DOUBLE AND gap < 1 THEN 4 WHEN gap > 1.2::DOUBLE THEN 5 ELSE 6 END AS k FROM x),
z AS (SELECT *, greatest(0.0::DOUBLE, least(1.0::DOUBLE, CASE WHEN k <= 2 THEN 0.5::DOUBLE * ngram + 0.3::DOUBLE * winnowing + 0.2::DOUBLE * token WHEN k <= 4 THEN 0.6::DOUBLE * ngram + 0.25::DOUBLE * winnowing + 0.15::DOUBLE * token ELSE (0.7::DOUBLE * ngram + 0.2::DOUBLE * winnowing + 0.1::DOUBLE * token) * (1 - gap / 3) END)) AS s FROM y)
SELECT id_a, id_b, CASE WHEN k <= 2 THEN 'high_confidence' WHEN k <= 4 THEN 'medium_confidence' ELSE 'low_confidence' END AS level, [0.95, 0.9, 0.7, 0.6, 0.3, 0.4][k]::DOUBLE AS confidence, round(s, 9) AS score,
CASE WHEN k <= 2 AND s > 0.8::DOUBLE THEN 'Auto-flag as suspicious' WHEN k IN (3, 4) AND s > 0.6::DOUBLE THEN 'Review recommended' WHEN k > 4 AND s > 0.5 THEN 'Manual review required' ELSE 'No action needed' END AS action,
CASE WHEN token > 0.9::DOUBLE AND ngram > 0.95::DOUBLE THEN 'T1' WHEN ngram > 0.8::DOUBLE AND token < 0.9::DOUBLE THEN 'T2' WHEN fingerprint > 0.6::DOUBLE AND ngram > 0.35::DOUBLE THEN 'T3' WHEN ngram > 0.3::DOUBLE AND embedding > 0.25 THEN 'T4' ELSE 'T5' END AS kind,
round(CASE WHEN token > 0.9::DOUBLE AND ngram > 0.95::DOUBLE THEN least(1.0, (token + ngram) / 2) WHEN ngram > 0.8::DOUBLE AND token < 0.9::DOUBLE THEN least(1.0, ngram) WHEN fingerprint > 0.6::DOUBLE AND ngram > 0.35::DOUBLE THEN least(1.0, (fingerprint + ngram) / 2) WHEN ngram > 0.3::DOUBLE AND embedding > 0.25 THEN embedding ELSE 1 - embedding END, 9) AS kind_confidence FROM z"""


def arbitration(spark, sf_dir):
    """Scores in long form, averaged by precision with uncertainty and agreement, by consensus, by weight, by the most
    trusted score, and with a normal interval."""
    f = features(spark, sf_dir)
    long = f.unpivot(["id_a", "id_b"], list(NAMES), "engine", "score").withColumn("p", D.rules(*((F.col("engine") == k, v) for k, v in PRECISION.items()), otherwise=0.0))
    a = long.groupBy("id_a", "id_b").agg(
        F.sum("p").alias("w"), F.sum(F.col("p") * F.col("score")).alias("ws"), F.sum(F.col("p") * F.col("score") * F.col("score")).alias("wq"),
        F.avg("score").alias("mean"), F.stddev_pop("score").alias("spread"), F.count(F.lit(1)).alias("n"), F.max_by("score", "p").alias("trusted"),
    )
    fused = F.col("ws") / F.col("w")
    agree = 1 / (1 + 10 * F.greatest(F.lit(0.0), F.col("wq") / F.col("w") - fused * fused))
    margin = 1.96 * F.col("spread") / F.sqrt("n")
    shown = {"fused": fused, "uncertainty": 1 / (1 + F.col("w")), "agreement": agree, "consensus": F.col("mean") * F.greatest(F.lit(0.0), 1 - 2 * F.col("spread")), "trusted": F.col("trusted"), "low": S.clamp(fused - margin), "high": S.clamp(fused + margin)}
    return a.select("id_a", "id_b", *[F.round(v, 6).alias(k) for k, v in shown.items()])


ARBITRATION_SQL = f"""WITH {_FEAT}, l AS (UNPIVOT (SELECT id_a, id_b, {', '.join(NAMES)} FROM feat) ON {', '.join(NAMES)} INTO NAME engine VALUE score),
p AS (SELECT *, CASE engine {' '.join(f"WHEN '{k}' THEN {v}" for k, v in PRECISION.items())} END::DOUBLE AS p FROM l),
a AS (SELECT id_a, id_b, sum(p) AS w, sum(p * score) AS ws, sum(p * score * score) AS wq, avg(score) AS mean, stddev_pop(score) AS spread, count(*) AS n, arg_max(score, p) AS trusted FROM p GROUP BY 1, 2)
SELECT id_a, id_b, round(ws / w, 6) AS fused, round(1 / (1 + w), 6) AS uncertainty, round(1 / (1 + 10 * greatest(0.0, wq / w - (ws / w) * (ws / w))), 6) AS agreement, round(mean * greatest(0.0, 1 - 2 * spread), 6) AS consensus, round(trusted, 6) AS trusted,
round(greatest(0.0, least(1.0, ws / w - 1.96::DOUBLE * spread / sqrt(n))), 6) AS low, round(greatest(0.0, least(1.0, ws / w + 1.96::DOUBLE * spread / sqrt(n))), 6) AS high FROM a"""


def learned_fusion(spark, sf_dir):
    """The learned score, the fixed blend, floors, bands, labels, and verdicts by threshold and by agreement."""
    s = _s() | {"coverage": F.col("coverage")}
    learned, blend = D.learned(s), D.blended(_s())
    floored = D.structure_floor(learned, s | {"ast": F.col("ngram"), "logic_flow": F.col("token")})
    mean, spread = S.agreement(list(_s().values()))
    weighted = S.weighted([(F.col(k), PRECISION[k]) for k in NAMES])
    verdict, sure = D.binary(learned)
    by_agreement = S.verdict(F.round(weighted * F.greatest(F.lit(0.0), 1 - spread * spread), 6))
    return features(spark, sf_dir).select("id_a", "id_b", F.round(learned, 6).alias("learned"), F.round(blend, 9).alias("blended"), F.round(floored, 6).alias("floored"), S.risk(F.round(floored, 6)).alias("risk"), D.label(F.round(floored, 6)).alias("label"), verdict.alias("verdict"), F.round(sure, 6).alias("confidence"), by_agreement.alias("by_agreement"), F.round(D.rank(s), 9).alias("priority"))


_Z = " + ".join([f"({D.INTERCEPT}::DOUBLE)", *(f"{k} * ({v}::DOUBLE)" for k, v in D.LEARNED.items() if k in (*NAMES, "coverage"))])
_SUM = sum(PRECISION.values())
LEARNED_SQL = f"""WITH {_FEAT}, x AS (SELECT *, 1 / (1 + exp(-greatest(-30.0, least(30.0, {_Z})))) AS l, token * 0.2::DOUBLE + stylometry * 0.15::DOUBLE + embedding * 0.15::DOUBLE AS b,
 {' + '.join(f'({k} > 0.8::DOUBLE)::INT' for k in NAMES)} AS k, ({' + '.join(NAMES)}) / 6 AS mean, ({' + '.join(f'{k} * {k}' for k in NAMES)}) / 6 AS sq, ({' + '.join(f'{k} * {v}' for k, v in PRECISION.items())}) / {_SUM} AS wt FROM feat),
y AS (SELECT *, CASE WHEN ngram >= 0.75 AND fingerprint >= 0.8::DOUBLE AND (ngram >= 0.7::DOUBLE OR winnowing >= 0.56::DOUBLE) AND token >= 0.9::DOUBLE THEN greatest(l, 0.88::DOUBLE)
 WHEN ngram >= 0.65::DOUBLE AND fingerprint >= 0.65::DOUBLE AND (ngram >= 0.58::DOUBLE OR winnowing >= 0.48::DOUBLE) AND token >= 0.78::DOUBLE THEN greatest(l, 0.82::DOUBLE) ELSE l END AS f,
 round(wt * greatest(0.0, 1 - greatest(0.0, sq - mean * mean)), 6) AS e, greatest(0.0, least(1.0, greatest(fingerprint, winnowing) * 0.18::DOUBLE)) AS r FROM x)
SELECT id_a, id_b, round(l, 6) AS learned, round(greatest(0.0, least(1.0, CASE WHEN k >= 3 THEN b * 1.1::DOUBLE ELSE b END)), 9) AS blended, round(f, 6) AS floored, {_RISK.format('round(f, 6)')} AS risk,
CASE WHEN round(f, 6) > 0.9::DOUBLE THEN 'HIGH RISK' WHEN round(f, 6) > 0.75 THEN 'MEDIUM RISK' WHEN round(f, 6) > 0.6::DOUBLE THEN 'SUSPICIOUS' ELSE 'LOW RISK' END AS label,
CASE WHEN l >= 0.5 THEN 1 ELSE 0 END AS verdict, round(least(1.0, 0.5 + abs(l - 0.5)), 6) AS confidence,
CASE WHEN e >= 0.85::DOUBLE THEN 'PLAGIARIZED' WHEN e >= 0.6::DOUBLE THEN 'SUSPICIOUS' WHEN e >= 0.3::DOUBLE THEN 'CLEAN' ELSE 'UNCERTAIN' END AS by_agreement,
round(CASE WHEN embedding >= 0.75 AND greatest(fingerprint, winnowing, ngram) < 0.45::DOUBLE THEN least(r, 0.48::DOUBLE) ELSE r END, 9) AS priority FROM y"""

QUERIES = {
    "pair_features": (features, FEATURES_SQL),
    "fusion_decision": (fusion_decision, DECISION_SQL),
    "evidence_hierarchy": (evidence_hierarchy, HIERARCHY_SQL),
    "conflict_resolution": (conflict_resolution, CONFLICT_SQL),
    "arbitration": (arbitration, ARBITRATION_SQL),
    "learned_fusion": (learned_fusion, LEARNED_SQL),
}
