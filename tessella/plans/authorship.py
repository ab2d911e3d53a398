"""Authorship signals of documents, their fusion, and style over the turns of a conversation."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tessella.functions import scores as S
from tessella.functions import signals, text
from tessella.session import table


def _docs(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", "text", text.tokens(F.col("text")).alias("w"))


_TOK = "SELECT doc_id, regexp_extract_all(lower(coalesce(text, '')), '[a-z0-9]+') AS w, string_split(coalesce(text, ''), chr(10)) AS l, coalesce(text, '') AS t FROM documents"
_UNIT = "greatest(0.0, least(1.0, {0}))"
_PERP = f"""u AS (SELECT doc_id, -sum(c / n * log2(c / n)) AS h FROM (SELECT doc_id, x, count(*) AS c, any_value(n) AS n FROM (SELECT doc_id, unnest(w) AS x, len(w) AS n FROM tk) GROUP BY doc_id, x) GROUP BY doc_id),
b AS (SELECT doc_id, -sum(c / n * log2(c / n)) AS h FROM (SELECT doc_id, x, count(*) AS c, any_value(n) AS n FROM (SELECT doc_id, w[i] || ' ' || w[i + 1] AS x, len(w) - 1 AS n FROM (SELECT doc_id, w, unnest(range(1, len(w))) AS i FROM tk)) GROUP BY doc_id, x) GROUP BY doc_id),
perp AS (SELECT doc_id, CASE WHEN len(w) < 10 THEN 0.0 ELSE {_UNIT.format('1 - (0.4::DOUBLE * u.h + 0.6::DOUBLE * b.h) / 5')} END AS perplexity FROM tk LEFT JOIN u USING (doc_id) LEFT JOIN b USING (doc_id))"""
_BURST = f"""bc AS (SELECT doc_id, (length(rtrim(x, ' ')) - length(ltrim(rtrim(x, ' '), ' '))) / 4 + length(ltrim(rtrim(x, ' '), ' ')) / 80 AS c FROM (SELECT doc_id, unnest(l) AS x FROM tk) WHERE rtrim(x, ' ') <> ''),
burst AS (SELECT doc_id, CASE WHEN count(c) < 5 THEN 0.0 WHEN avg(c) < 1e-9 THEN 0.5 ELSE {_UNIT.format('1 - stddev_pop(c) / avg(c) / 1.2')} END AS burstiness FROM tk LEFT JOIN bc USING (doc_id) GROUP BY doc_id)"""
_VOCAB = f"""vw AS (SELECT doc_id, avg(len(list_distinct(w[i + 1 : i + 50])) / 50) AS ttr FROM (SELECT doc_id, w, unnest(range(0, len(w) - 50, 25)) AS i FROM tk WHERE len(w) > 50) GROUP BY doc_id),
vh AS (SELECT doc_id, count(*) FILTER (c = 1) / count(*) AS hapax FROM (SELECT doc_id, x, count(*) AS c FROM (SELECT doc_id, unnest(w) AS x FROM tk) GROUP BY 1, 2) GROUP BY doc_id),
vocab AS (SELECT doc_id, CASE WHEN len(w) < 20 THEN 0.0 ELSE {_UNIT.format("0.6::DOUBLE * " + _UNIT.format('1 - coalesce(ttr, len(list_distinct(w)) / len(w)) / 0.7::DOUBLE') + " + 0.4::DOUBLE * " + _UNIT.format('1 - hapax'))} END AS vocabulary FROM tk LEFT JOIN vw USING (doc_id) LEFT JOIN vh USING (doc_id))"""
_WHITE = f"""wr AS (SELECT doc_id, unnest([length(r) for r in string_split_regex(array_to_string([CASE WHEN trim(x, ' ') = '' THEN '0' ELSE '1' END for x in l], ''), '1+') if r <> '']) AS r FROM tk),
wc AS (SELECT doc_id, r, count(*) AS c FROM wr GROUP BY 1, 2), wn AS (SELECT doc_id, sum(c) AS n, count(*) AS k, -sum(c / s * log2(c / s)) AS h FROM (SELECT *, sum(c) OVER (PARTITION BY doc_id) AS s FROM wc) GROUP BY doc_id),
white AS (SELECT doc_id, CASE WHEN coalesce(n, 0) < 3 THEN 0.0 WHEN k <= 1 THEN 1.0 ELSE {_UNIT.format('1 - h / log2(k)')} END AS whitespace FROM tk LEFT JOIN wn USING (doc_id))"""
_n = lambda p: "len(regexp_extract_all(t, '" + p.replace("'", "''") + "'))"
_PAT = f"pat AS (SELECT doc_id, {_UNIT.format('5 * (' + ' + '.join(map(_n, signals.PATTERNS)) + ') / len(l)')} AS patterns FROM tk)"
_of = lambda a, b: f"{_n(a)} / greatest({_n(b)}, 1)"
_ALONE = r"len(regexp_extract_all(regexp_replace(t, '[\p{L}\p{N}_]{2,}', ' ', 'g'), '[a-z]'))"
_GENERIC = r"\b(?:" + "|".join(signals.GENERIC) + r")\b"
_STYLO = (
    "sty AS (SELECT doc_id, "
    + _UNIT.format(
        f"{_of(_GENERIC, signals.ASSIGNED)} * 0.25::DOUBLE + {_n(signals.DOCSTRING)} / len(l) * 0.2::DOUBLE + {_of(signals.HINT, signals.FUNCTION)} * 0.2::DOUBLE + (1 - {_ALONE} / greatest({_n(signals.ASSIGNED)}, 1)) * 0.15::DOUBLE"
        f" + {_of(signals.TRY, signals.FUNCTION)} * 0.1::DOUBLE + least(1.0, {_of(signals.COMPREHENSION, signals.LOOP)}) * 0.1::DOUBLE"
    )
    + " AS stylometry FROM tk)"
)
_DOCS = f"""dcs AS (SELECT doc_id, CASE WHEN {_n(signals.FUNCTION)} > 0 THEN {_UNIT.format(_n(signals.DOCSTRING) + ' / ' + _n(signals.FUNCTION) + ' * 0.75')} ELSE least(1.0, {_n(signals.DOCSTRING)} / greatest(1.0, len(l) / 10)) END AS docstrings FROM tk)"""
_IND = rf"""ix AS (SELECT doc_id, (length(x) - length(regexp_replace(x, '^\s+', ''))) // 4 AS v FROM (SELECT doc_id, unnest(l) AS x FROM tk) WHERE regexp_matches(x, '\S')),
ic AS (SELECT doc_id, v, count(*) AS c FROM ix GROUP BY 1, 2), ie AS (SELECT doc_id, count(*) AS k, -sum(c / s * log2(c / s)) AS h FROM (SELECT *, sum(c) OVER (PARTITION BY doc_id) AS s FROM ic) GROUP BY doc_id),
ent AS (SELECT doc_id, CASE WHEN k IS NULL THEN 0.0::DOUBLE WHEN k <= 1 THEN 0.6::DOUBLE ELSE {_UNIT.format('1 - h / log2(k)')} * 0.6::DOUBLE END AS entropy FROM tk LEFT JOIN ie USING (doc_id))"""


def sig_perplexity(spark, sf_dir):
    return _docs(spark, sf_dir).select("doc_id", F.round(signals.perplexity(F.col("w")), 6).alias("score"))


def sig_burstiness(spark, sf_dir):
    return _docs(spark, sf_dir).select("doc_id", F.round(signals.burstiness(F.col("text")), 6).alias("score"))


def sig_vocabulary(spark, sf_dir):
    return _docs(spark, sf_dir).select("doc_id", F.round(signals.vocabulary(F.col("w")), 6).alias("score"))


def sig_whitespace(spark, sf_dir):
    return _docs(spark, sf_dir).select("doc_id", F.round(signals.whitespace(F.col("text")), 6).alias("score"))


def sig_patterns(spark, sf_dir):
    return _docs(spark, sf_dir).select("doc_id", F.round(signals.patterns(F.col("text")), 6).alias("score"))


def sig_stylometry(spark, sf_dir):
    return _docs(spark, sf_dir).select("doc_id", F.round(signals.stylometry(F.col("text")), 6).alias("score"))


def sig_docstrings(spark, sf_dir):
    return _docs(spark, sf_dir).select("doc_id", F.round(signals.docstrings(F.col("text")), 6).alias("score"))


def sig_indentation(spark, sf_dir):
    """Structural entropy of texts in languages that are not parsed."""
    return _docs(spark, sf_dir).select("doc_id", F.round(signals.indentation(F.col("text")), 6).alias("score"))


def signal_fusion(spark, sf_dir):
    """Eight signals, each trusted by the size of its text: probability, agreement, confidence and risk, after what lowers
    false findings (one signal that stands alone, contradiction, little trust), and the three signals that weigh most."""
    t = F.col("text")
    parts = {
        "perplexity": signals.perplexity(F.col("w")), "burstiness": signals.burstiness(t), "stylometry": signals.stylometry(t), "patterns": signals.patterns(t),
        "entropy": signals.indentation(t), "vocabulary": signals.vocabulary(F.col("w")), "whitespace": signals.whitespace(t), "docstrings": signals.docstrings(t),
    }
    sizes = {"tokens": F.size("w"), "lines": F.size(text.lines(t)), "filled": F.size(F.filter(text.lines(t), lambda x: F.regexp_like(x, F.lit(r"\S")))), "functions": signals.count(t, signals.FUNCTION)}
    d = _docs(spark, sf_dir).select("doc_id", *[F.round(c, 6).alias(k) for k, c in parts.items()], *[c.alias(f"n_{k}") for k, c in sizes.items()])
    d = d.select("doc_id", *parts, *[c.alias(f"r_{k}") for k, c in signals.trust({k: F.col(f"n_{k}") for k in sizes}).items()])
    add = lambda xs: sum(xs[1:], xs[0])
    some = lambda test: add([F.when(test(F.col(k)), 1).otherwise(0) for k in parts])
    weigh = {k: F.col(f"r_{k}") * signals.WEIGHTS[k] for k in parts}
    whole = add(list(weigh.values()))
    mean, spread = S.agreement([F.col(k) for k in parts])
    most = F.transform(F.slice(F.array_sort(F.array(*[F.struct(F.round(-F.col(k) * w, 9).alias("v"), F.lit(k).alias("k")) for k, w in weigh.items()])), 1, 3), lambda x: x["k"])
    d = d.select(
        "doc_id", F.when(whole > 0, add([F.col(k) * w for k, w in weigh.items()]) / whole).otherwise(0.0).alias("base"), add([F.col(f"r_{k}") for k in parts]).alias("r"), (spread * spread).alias("variance"),
        some(lambda x: x > 0.6).alias("supporting"), some(lambda x: x < 0.4).alias("contradicting"), some(lambda x: x > 0.7).alias("strong"), some(lambda x: x < 0.3).alias("weak"), F.array_join(most, ",").alias("influential"),
    )
    yes, no, top = F.col("supporting"), F.col("contradicting"), F.greatest("supporting", "contradicting")
    step = F.when(top >= 6, 0.05).when(top >= 4, 0.02).otherwise(0.0)
    d = d.withColumn("p", signals.unit(F.col("base") + F.when(yes > no, step).otherwise(-step))).withColumn("mean_trust", F.col("r") / 8)
    bonus = F.when((F.col("p") > 0.8) | (F.col("p") < 0.2), 0.1).when((F.col("p") > 0.7) | (F.col("p") < 0.3), 0.05).otherwise(0.0)
    sure = signals.unit((top / 8 + F.col("mean_trust")) / 2 - 0.15 * F.least(F.lit(0.25), F.col("variance")) / 0.25 + bonus)
    alone = ((yes == 1) & (no >= 6)) | ((no == 1) & (yes >= 6))
    less = F.when(alone, 0.3).otherwise(0.0) + F.when((F.col("strong") > 0) & (F.col("weak") > 0), 0.2).otherwise(0.0) + F.when(F.col("mean_trust") < 0.5, 0.25).otherwise(0.0)
    d = d.withColumn("c", sure - less).withColumn("c", signals.unit(F.when(F.col("p").between(0.4, 0.6), F.greatest("c", F.lit(0.3))).otherwise(F.col("c"))))
    d = d.withColumn("p", F.when(F.col("c") < 0.2, F.col("p") * 0.8 + 0.1).otherwise(F.col("p")))
    risk = F.when(F.col("p") < 0.25, "Very Low").when(F.col("p") < 0.45, "Low").when(F.col("p") < 0.65, "Moderate").when(F.col("p") < 0.80, "Elevated").otherwise("High")
    return d.select("doc_id", "supporting", "contradicting", F.round("p", 5).alias("probability"), F.round("c", 5).alias("confidence"), risk.alias("risk"), "influential")


_ALL = f"WITH tk AS ({_TOK}), {_PERP}, {_BURST}, {_VOCAB}, {_WHITE}, {_PAT}, {_STYLO}, {_DOCS}, {_IND}"
_ONE = lambda cte, name: f"WITH tk AS ({_TOK}), {cte} SELECT doc_id, round({name[0]}, 6) AS score FROM {name[1]}"
_EIGHT = {"perplexity": "perp", "burstiness": "burst", "vocabulary": "vocab", "whitespace": "white", "patterns": "pat", "stylometry": "sty", "entropy": "ent", "docstrings": "dcs"}
_STEPS = ", ".join(f"CASE WHEN n_{of} < {a} THEN 0.0 WHEN n_{of} < {b} THEN 0.3 WHEN n_{of} < {c} THEN 0.6 ELSE 1.0 END::DOUBLE AS r_{k}" for k, (of, a, b, c) in signals.TRUST.items())
_w = lambda k: f"r_{k} * {signals.WEIGHTS[k]}::DOUBLE"
_some = lambda test: " + ".join(f"({k} {test}::DOUBLE)::INT" for k in _EIGHT)
FUSION_SQL = f"""{_ALL}, z AS (SELECT doc_id, {', '.join(f'round({k}, 6)::DOUBLE AS {k}' for k in _EIGHT)}, len(w) AS n_tokens, len(l) AS n_lines, len([x for x in l if regexp_matches(x, '\\S')]) AS n_filled, {_n(signals.FUNCTION)} AS n_functions
 FROM tk {' '.join(f'JOIN {v} USING (doc_id)' for v in _EIGHT.values())}),
s AS (SELECT *, {_STEPS}, CASE WHEN n_lines < 5 THEN 0.5 WHEN n_lines < 20 THEN 0.7 ELSE 1.0 END::DOUBLE AS r_patterns, CASE WHEN n_filled < 10 THEN 0.3 ELSE 0.6 END::DOUBLE AS r_entropy FROM z),
f AS (SELECT *, {' + '.join(map(_w, _EIGHT))} AS whole, {' + '.join(f'{k} * ({_w(k)})' for k in _EIGHT)} AS total, ({' + '.join(f'r_{k}' for k in _EIGHT)}) / 8 AS mt, ({' + '.join(_EIGHT)}) / 8 AS mean, ({' + '.join(f'{k} * {k}' for k in _EIGHT)}) / 8 AS sq,
 {_some('> 0.6')} AS supporting, {_some('< 0.4')} AS contradicting, {_some('> 0.7')} AS strong, {_some('< 0.3')} AS weak,
 array_to_string([x.k for x in list_sort([{', '.join(f"{{'v': round(-{k} * ({_w(k)}), 9), 'k': '{k}'}}" for k in _EIGHT)}])[1:3]], ',') AS influential FROM s),
g AS (SELECT *, greatest(supporting, contradicting) AS top, CASE WHEN whole > 0 THEN total / whole ELSE 0 END AS base FROM f),
l AS (SELECT *, CASE WHEN top >= 6 THEN 0.05 WHEN top >= 4 THEN 0.02 ELSE 0.0 END::DOUBLE AS v FROM g),
p AS (SELECT *, greatest(0.0, least(1.0, base + CASE WHEN supporting > contradicting THEN v ELSE -v END)) AS p0 FROM l),
q AS (SELECT *, greatest(0.0, least(1.0, (top / 8 + mt) / 2 - 0.15::DOUBLE * least(0.25::DOUBLE, greatest(0.0::DOUBLE, sq - mean * mean)) / 0.25 + CASE WHEN p0 > 0.8::DOUBLE OR p0 < 0.2::DOUBLE THEN 0.1::DOUBLE WHEN p0 > 0.7::DOUBLE OR p0 < 0.3::DOUBLE THEN 0.05::DOUBLE ELSE 0.0::DOUBLE END))
 - CASE WHEN (supporting = 1 AND contradicting >= 6) OR (contradicting = 1 AND supporting >= 6) THEN 0.3::DOUBLE ELSE 0.0::DOUBLE END - CASE WHEN strong > 0 AND weak > 0 THEN 0.2::DOUBLE ELSE 0.0::DOUBLE END - CASE WHEN mt < 0.5 THEN 0.25::DOUBLE ELSE 0.0::DOUBLE END AS c0 FROM p),
r AS (SELECT *, greatest(0.0, least(1.0, CASE WHEN p0 BETWEEN 0.4::DOUBLE AND 0.6::DOUBLE THEN greatest(c0, 0.3::DOUBLE) ELSE c0 END)) AS c FROM q),
t AS (SELECT *, CASE WHEN c < 0.2::DOUBLE THEN p0 * 0.8::DOUBLE + 0.1::DOUBLE ELSE p0 END AS p FROM r)
SELECT doc_id, supporting, contradicting, round(p, 5) AS probability, round(c, 5) AS confidence, CASE WHEN p < 0.25 THEN 'Very Low' WHEN p < 0.45::DOUBLE THEN 'Low' WHEN p < 0.65::DOUBLE THEN 'Moderate' WHEN p < 0.8::DOUBLE THEN 'Elevated' ELSE 'High' END AS risk, influential FROM t"""


def style_history(spark, sf_dir):
    """Each turn against the one before it by the same role of its conversation."""
    t = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", F.length(text.clean(F.col("text"))).cast("double").alias("a"), F.size(text.tokens(F.col("text"))).cast("double").alias("b"))
    w = Window.partitionBy("conv_id", "role").orderBy("turn", "a", "b")
    off = lambda x: F.when(F.lag(x).over(w) == 0, F.abs(F.col(x))).when(F.lag(x).over(w).isNotNull(), F.least(F.lit(1.0), F.abs(F.col(x) - F.lag(x).over(w)) / F.lag(x).over(w)))
    n = F.row_number().over(w) - 1
    confidence = F.when(n < 3, 0.3).when(n < 10, 0.6).otherwise(F.least(F.lit(0.95), 0.6 + 0.01 * n))
    d = t.select("conv_id", "turn", "role", F.coalesce((off("a") + off("b")) / 2, F.lit(0.0)).alias("deviation"), confidence.alias("confidence"))
    return d.select("conv_id", "turn", "role", F.round("deviation", 9).alias("deviation"), (F.col("deviation") > 0.3).alias("anomaly"), F.round("confidence", 6).alias("confidence"))


STYLE_SQL = """WITH t AS (SELECT conv_id, turn, role, length(coalesce(text, ''))::DOUBLE AS a, len(regexp_extract_all(lower(coalesce(text, '')), '[a-z0-9]+'))::DOUBLE AS b FROM conversations),
w AS (SELECT *, lag(a) OVER o AS pa, lag(b) OVER o AS pb, row_number() OVER o - 1 AS n FROM t WINDOW o AS (PARTITION BY conv_id, role ORDER BY turn, a, b)),
d AS (SELECT *, coalesce((CASE WHEN pa = 0 THEN abs(a) ELSE CASE WHEN pa IS NULL THEN NULL ELSE least(1.0, abs(a - pa) / pa) END END + CASE WHEN pb = 0 THEN abs(b) ELSE CASE WHEN pb IS NULL THEN NULL ELSE least(1.0, abs(b - pb) / pb) END END) / 2, 0.0) AS v FROM w)
SELECT conv_id, turn, role, round(v, 9) AS deviation, v > 0.3::DOUBLE AS anomaly, round(CASE WHEN n < 3 THEN 0.3 WHEN n < 10 THEN 0.6 ELSE least(0.95, 0.6 + 0.01 * n) END::DOUBLE, 6) AS confidence FROM d"""


def style_features(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", *[F.round(c, 9).alias(k) for k, c in signals.styles(F.col("text")).items()])


FEATURES_SQL = """WITH x AS (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS x FROM documents)
SELECT doc_id, round(avg(length(x)), 9) AS mean_line, round(avg(length(x) - length(ltrim(x, ' '))), 9) AS mean_indent, round(avg(regexp_matches(x, '^ *(#|//)')::INT), 9) AS comment_ratio, round(avg((trim(x, ' ') = '')::INT), 9) AS blank_ratio FROM x GROUP BY doc_id"""

QUERIES = {
    "sig_perplexity": (sig_perplexity, _ONE(_PERP, ("perplexity", "perp"))),
    "sig_burstiness": (sig_burstiness, _ONE(_BURST, ("burstiness", "burst"))),
    "sig_vocabulary": (sig_vocabulary, _ONE(_VOCAB, ("vocabulary", "vocab"))),
    "sig_whitespace": (sig_whitespace, _ONE(_WHITE, ("whitespace", "white"))),
    "sig_patterns": (sig_patterns, _ONE(_PAT, ("patterns", "pat"))),
    "sig_stylometry": (sig_stylometry, _ONE(_STYLO, ("stylometry", "sty"))),
    "sig_docstrings": (sig_docstrings, _ONE(_DOCS, ("docstrings", "dcs"))),
    "sig_indentation": (sig_indentation, _ONE(_IND, ("entropy", "ent"))),
    "signal_fusion": (signal_fusion, FUSION_SQL),
    "style_history": (style_history, STYLE_SQL),
    "style_features": (style_features, FEATURES_SQL),
}
