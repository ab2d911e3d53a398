"""Winnowing in several passes of growing windows, plain and by the weight of what is matched."""

from __future__ import annotations

from functools import reduce

import numpy as np
from pyspark.sql import functions as F

from tessella.functions import text
from tessella.operators import setjoin
from tessella.plans.similarity import _SETS, _TOK, candidates
from tessella.session import table, written

#: The passes' window sizes, and weights of tokens by kind, in tenths.
PASSES = (3, 5, 9, 15)
WEIGHTS = {"keyword": 20, "literal": 15, "name": 10}
#: Words that count as keywords.
WORDS = [
    "if", "else", "elif", "for", "while", "return", "def", "class", "import", "from", "try", "except", "finally", "with", "as", "in", "not", "and",
    "or", "is", "yield", "break", "continue", "pass", "raise", "lambda", "assert", "del", "global", "nonlocal",
]


def weight(token):
    return F.when(token.isin(WORDS), WEIGHTS["keyword"]).when(F.regexp_like(token, F.lit("^[0-9]+$")), WEIGHTS["literal"]).otherwise(WEIGHTS["name"])


def prints(tokens, k):
    """(id, k, h, w): the distinct windows of k tokens that winnowing over max(2 k, 4) of them picks, and their weights."""
    span = max(2 * k, 4)
    hashed = tokens.select("id", F.transform(text.ngrams(F.col("items"), k), F.md5).alias("h"), F.transform("items", weight).alias("v"))
    at = hashed.select("id", "h", "v", F.explode(text.winnow(F.col("h"), span)).alias("p"))
    return at.select("id", F.lit(k).alias("k"), F.get("h", F.col("p") - 1).alias("h"), F.aggregate(F.slice("v", F.col("p"), F.lit(k)), F.lit(0), lambda s, x: s + x).alias("w")).distinct()


def multi_pass_winnowing(spark, sf_dir):
    """Of candidate pairs: the mean of the passes' Jaccard similarities, a pass of k tokens counting 1 / sqrt(k), plain and
    with every window counting what its tokens weigh."""
    pairs = candidates(spark, sf_dir).select("id_a", "id_b")
    docs = setjoin.of_pairs(table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text"), pairs)
    tokens = written(docs.select("id", text.tokens(F.col("text")).alias("items")), "tokens")
    found = written(reduce(lambda a, b: a.unionByName(b), [prints(tokens, k) for k in PASSES]), "passes")
    sides = written(found.groupBy("id").agg(F.sort_array(F.collect_list(F.struct(F.xxhash64("k", "h").alias("h"), "k", "w"))).alias("s")).select("id", "s.h", "s.k", "s.w"), "sides")
    met = setjoin.compared(pairs, _met, ", ".join(f"{x}{k} long" for k in PASSES for x in ("c", "cw", "na", "nb", "sa", "sb")), sides)
    # a pass that a side lacks does not count
    share = {k: F.when((F.col(f"na{k}") > 0) & (F.col(f"nb{k}") > 0), 1 / F.sqrt(F.lit(float(k)))) for k in PASSES}
    total = sum(F.coalesce(s, F.lit(0.0)) for s in share.values())
    mean = lambda c, a, b: F.round(sum(F.coalesce(share[k] * F.col(f"{c}{k}") / (F.col(f"{a}{k}") + F.col(f"{b}{k}") - F.col(f"{c}{k}")), F.lit(0.0)) for k in PASSES) / total, 6)
    return met.select("id_a", "id_b", mean("c", "na", "nb").alias("plain"), mean("cw", "sa", "sb").alias("weighted"))


def _met(x, y):
    """For each pass: the windows that both have and their weight, and the numbers and weights of each side."""
    hit, _ = setjoin.met(x[0], y[0])
    of = lambda k, w=None: np.bincount(k, w, minlength=PASSES[-1] + 1)
    c, cw, na, nb, sa, sb = of(x[1][hit]), of(x[1][hit], x[2][hit]), of(x[1]), of(y[1]), of(x[1], x[2]), of(y[1], y[2])
    return [int(v[k]) for k in PASSES for v in (c, cw, na, nb, sa, sb)]


def _pass_sql(k: int) -> str:
    t = max(2 * k, 4)
    return f"""h{k} AS (SELECT id, i AS p, md5(CASE WHEN len(w) < {k} THEN array_to_string(w, ' ') ELSE array_to_string(w[i : i + {k - 1}], ' ') END) AS h, list_sum(v[i : i + {k - 1}]) AS w, greatest(len(w) - {k - 1}, 1) AS n
 FROM (SELECT id, w, v, unnest(range(1, greatest(len(w) - {k - 2}, 2))) AS i FROM vt)),
m{k} AS (SELECT id, p, n, min(struct_pack(h := h, p := p)) OVER (PARTITION BY id ORDER BY p ROWS BETWEEN CURRENT ROW AND {t - 1} FOLLOWING) AS m FROM h{k}),
f{k} AS (SELECT DISTINCT x.id, {k} AS k, x.h, x.w::BIGINT AS w FROM (SELECT DISTINCT id, CASE WHEN n < {t} THEN p ELSE m.p END AS p FROM m{k} WHERE n < {t} OR p <= n - {t - 1}) JOIN h{k} x USING (id, p))"""


_KIND = f"CASE WHEN t IN ({', '.join(map(repr, WORDS))}) THEN {WEIGHTS['keyword']} WHEN regexp_matches(t, '^[0-9]+$') THEN {WEIGHTS['literal']} ELSE {WEIGHTS['name']} END"
PASSES_SQL = f"""WITH {_SETS}, vt AS (SELECT id, w, [{_KIND} FOR t IN w] AS v FROM (SELECT doc_id AS id, {_TOK} AS w FROM documents) WHERE len(w) > 0 AND id IN (SELECT id_a FROM cand UNION SELECT id_b FROM cand)),
{', '.join(_pass_sql(k) for k in PASSES)}, fp AS ({' UNION ALL '.join(f'SELECT * FROM f{k}' for k in PASSES)}),
sz AS (SELECT id, k, count(*) AS n, sum(w) AS s FROM fp GROUP BY 1, 2),
mt AS (SELECT id_a, id_b, x.k, count(*) AS c, sum(x.w) AS cw FROM cand JOIN fp x ON x.id = id_a JOIN fp y ON y.id = id_b AND y.k = x.k AND y.h = x.h GROUP BY 1, 2, 3),
ea AS (SELECT cand.id_a, cand.id_b, x.k, coalesce(c, 0) AS c, coalesce(cw, 0) AS cw, x.n AS na, x.s AS sa, y.n AS nb, y.s AS sb FROM cand JOIN sz x ON x.id = id_a JOIN sz y ON y.id = id_b AND y.k = x.k LEFT JOIN mt ON mt.id_a = cand.id_a AND mt.id_b = cand.id_b AND mt.k = x.k)
SELECT id_a, id_b, round(sum(c / (na + nb - c) / sqrt(k)) / sum(1 / sqrt(k)), 6) AS plain, round(sum(cw / (sa + sb - cw) / sqrt(k)) / sum(1 / sqrt(k)), 6) AS weighted FROM ea GROUP BY 1, 2"""

QUERIES = {"multi_pass_winnowing": (multi_pass_winnowing, PASSES_SQL)}
