"""Queries over documents as submissions: duplicates, pairs and their scores, fingerprints, sketches, clusters."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.functions import scores, text
from tessella.operators import graph, setjoin, shingling, sketch, vectors
from tessella.session import table, written

#: Words of a shingle, and the least similarity of pairs by shingles, by their own tokens, and of clusters.
WORDS, NUM, DEN = 5, 1, 2
OWN_NUM, OWN_DEN = 7, 10


def _items(spark, sf_dir, items):
    docs = table(spark, sf_dir, "documents")
    return docs.select(F.col("doc_id").alias("id"), items(F.col("text")).alias("items"))


def shingled(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """The distinct shingle sets, and the members of each."""
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text")
    return setjoin.classes(shingling.shingled(docs, WORDS), distinct=True)


def candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of distinct shingle sets with a Jaccard similarity of one half or more, by their least ids."""
    return written(setjoin.jaccard_pairs(shingled(spark, sf_dir)[0], NUM, DEN), "pairs")


def suspicious_pairs(spark, sf_dir):
    """Pairs of classes of equal shingle sets; ``duplicate_classes`` has the members."""
    sets, _ = shingled(spark, sf_dir)
    score = F.col("common") / F.col("total")
    size = sets.select("id", "copies")
    out = setjoin.jaccard_pairs(sets, NUM, DEN).join(size.toDF("id_a", "copies_a"), "id_a").join(size.toDF("id_b", "copies_b"), "id_b")
    return out.select("id_a", "id_b", "copies_a", "copies_b", score.alias("score"), scores.risk(score).alias("risk"))


def duplicate_classes(spark, sf_dir):
    """The class of every document with a shingle, which the pairs name by its least id."""
    return shingled(spark, sf_dir)[1].select(F.col("id").alias("doc_id"), F.col("class").alias("class_id"), "copies")


_TOK = "regexp_extract_all(lower(coalesce(text, '')), '[a-z0-9]+')"


def _pairs_sql(items: str, num: int, den: int, ctes: str = "") -> str:
    """CTEs tok, grams (id, g: distinct items), mem (members), cls, rep, cand (pairs)."""
    return f"""tok AS (SELECT doc_id AS id, {_TOK} AS w FROM documents), {ctes}
grams AS ({items}),
keyed AS (SELECT id, md5(string_agg(g, chr(10) ORDER BY g)) AS k, count(*) AS n FROM grams GROUP BY id),
cls AS (SELECT k, min(id) AS id, min(n) AS n, count(*) AS copies FROM keyed GROUP BY k),
mem AS (SELECT keyed.id, cls.id AS class, copies FROM keyed JOIN cls USING (k)),
rep AS (SELECT g.id, g.g FROM grams g JOIN cls USING (id)),
cand AS (SELECT id_a, id_b, common, na.n + nb.n - common AS total
         FROM (SELECT a.id AS id_a, b.id AS id_b, count(*) AS common FROM rep a JOIN rep b ON a.g = b.g AND a.id < b.id GROUP BY 1, 2)
         JOIN cls na ON na.id = id_a JOIN cls nb ON nb.id = id_b WHERE {den} * common >= {num} * (na.n + nb.n - common))
"""


_GRAMS = "SELECT DISTINCT id, CASE WHEN len(w) < 5 THEN array_to_string(w, ' ') ELSE array_to_string(w[i : i + 4], ' ') END AS g FROM (SELECT id, w, unnest(range(1, greatest(len(w) - 3, 2))) AS i FROM tok WHERE len(w) > 0)"
_SETS = _pairs_sql(_GRAMS, NUM, DEN)
CLASSES_SQL = f"WITH {_SETS} SELECT id AS doc_id, class AS class_id, copies FROM mem"
_RISK = "CASE WHEN {0} >= 0.85 THEN 'CRITICAL' WHEN {0} >= 0.65 THEN 'HIGH' WHEN {0} >= 0.35 THEN 'MEDIUM' ELSE 'LOW' END"

SUSPICIOUS_SQL = f"""WITH {_SETS} SELECT id_a, id_b, a.copies AS copies_a, b.copies AS copies_b, common / total AS score,
{_RISK.format('common / total')} AS risk FROM cand JOIN cls a ON a.id = id_a JOIN cls b ON b.id = id_b"""


def exact_duplicates(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    by = docs.groupBy(F.sha2(F.coalesce("text", F.lit("")), 256).alias("digest")).agg(F.count(F.lit(1)).alias("copies"), F.min("doc_id").alias("first_id"))
    return by.filter("copies > 1")


EXACT_SQL = "SELECT sha256(coalesce(text, '')) AS digest, count(*) AS copies, min(doc_id) AS first_id FROM documents GROUP BY 1 HAVING count(*) > 1"


def first_wins_dedup(spark, sf_dir):
    """The first document of each text; aggregated, so that a text with many copies is summed before it is shuffled."""
    docs = table(spark, sf_dir, "documents")
    first = F.min(F.struct("doc_id", "lang", "source")).alias("f")
    return docs.groupBy(F.sha2(F.coalesce("text", F.lit("")), 256).alias("digest")).agg(first).select("f.doc_id", "f.lang", "f.source", "digest")


FIRST_SQL = "SELECT doc_id, lang, source, sha256(coalesce(text, '')) AS digest FROM documents QUALIFY row_number() OVER (PARTITION BY sha256(coalesce(text, '')) ORDER BY doc_id) = 1"


def content_overlap(spark, sf_dir):
    """How many texts, white space aside, each pair of sources shares."""
    docs = table(spark, sf_dir, "documents")
    h = F.sha2(F.trim(F.regexp_replace(text.clean(F.col("text")), r"[ \t\r\n]+", " ")), 256)
    held = docs.select("source", h.alias("h")).distinct()
    return held.toDF("source_a", "h").join(held.toDF("source_b", "h"), "h").filter("source_a < source_b").groupBy("source_a", "source_b").agg(F.count(F.lit(1)).alias("shared"))


OVERLAP_SQL = r"""WITH d AS (SELECT DISTINCT source, sha256(trim(regexp_replace(coalesce(text, ''), '[ \t\r\n]+', ' ', 'g'), ' ')) AS h FROM documents)
SELECT a.source AS source_a, b.source AS source_b, count(*) AS shared FROM d a JOIN d b ON a.h = b.h AND a.source < b.source GROUP BY 1, 2"""


def _scored(spark, sf_dir, items, how):
    """Scores of candidate pairs; only their documents are tokenized."""
    pairs = candidates(spark, sf_dir)
    docs = setjoin.of_pairs(table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text"), pairs)
    return how(pairs, written(docs.select("id", items(F.col("text")).alias("items")), "items"))


def _own(spark, sf_dir, items, num=OWN_NUM, den=OWN_DEN):
    """Pairs of distinct sets that are similar by these items themselves, with the classes' sizes left to others."""
    sets, _ = setjoin.classes(_items(spark, sf_dir, items))
    return setjoin.jaccard_pairs(sets, num, den, dense=True)


def _dice():
    """Of common and total; a Dice score of 0.8 or more is a Jaccard similarity of 2 / 3 or more."""
    return 2 * F.col("common") / (F.col("common") + F.col("total"))


def char_ngram_dice(spark, sf_dir):
    """Pairs with a Dice score of 0.8 or more over 5-character windows."""
    return _own(spark, sf_dir, lambda t: text.hashes(text.char_ngrams(text.ngram_text(t), 5)), 2, 3).select("id_a", "id_b", _dice().alias("score"))


_CHARS = r"""c AS (SELECT doc_id AS id, trim(regexp_replace(regexp_replace(regexp_replace(coalesce(text, ''), '"[^"]*"', 'S', 'g'), '[0-9]+', 'N', 'g'), '[ \t\r\n]+', ' ', 'g'), ' ') AS t FROM documents),"""
_CHAR_GRAMS = "SELECT DISTINCT id, CASE WHEN length(t) < 5 THEN t ELSE t[i : i + 4] END AS g FROM (SELECT id, t, unnest(range(1, greatest(length(t) - 3, 2))) AS i FROM c WHERE length(t) > 0)"
CHAR_SQL = f"WITH {_pairs_sql(_CHAR_GRAMS, 2, 3, ctes=_CHARS)} SELECT id_a, id_b, 2 * common / (common + total) AS score FROM cand"


def token_bigram_dice(spark, sf_dir):
    """Pairs with a Dice score of 0.8 or more over pairs of tokens."""
    return _own(spark, sf_dir, lambda t: text.shingles(text.tokens(t), 2), 2, 3).select("id_a", "id_b", _dice().alias("score"))


_BIGRAMS = "SELECT DISTINCT id, CASE WHEN len(w) < 2 THEN w[1] ELSE w[i] || ' ' || w[i + 1] END AS g FROM (SELECT id, w, unnest(range(1, greatest(len(w), 2))) AS i FROM tok WHERE len(w) > 0)"
BIGRAM_SQL = f"WITH {_pairs_sql(_BIGRAMS, 2, 3)} SELECT id_a, id_b, 2 * common / (common + total) AS score FROM cand"


def token_jaccard(spark, sf_dir):
    """Pairs whose sets of tokens agree by 0.7 or more, in whatever order the tokens stand."""
    return _own(spark, sf_dir, lambda t: text.hashes(text.tokens(t))).select("id_a", "id_b", (F.col("common") / F.col("total")).alias("score"))


_WORDS = "SELECT DISTINCT id, unnest(w) AS g FROM tok"
JACCARD_SQL = f"WITH {_pairs_sql(_WORDS, OWN_NUM, OWN_DEN)} SELECT id_a, id_b, common / total AS score FROM cand"


def keyword_overlap(spark, sf_dir):
    words = F.array(*map(F.lit, text.KEYWORDS))
    return _scored(spark, sf_dir, lambda t: F.array_intersect(text.tokens(t), words), setjoin.set_scores).select("id_a", "id_b", F.col("common").cast("long").alias("common"), setjoin.jaccard().alias("score"))


KEYWORD_SQL = f"""WITH {_SETS}, x AS (SELECT id, list_intersect(list_distinct(w), {text.KEYWORDS!r}) AS x FROM tok),
s AS (SELECT id_a, id_b, len(list_intersect(a.x, b.x)) AS common, len(a.x) + len(b.x) AS n FROM cand JOIN x a ON a.id = id_a JOIN x b ON b.id = id_b)
SELECT id_a, id_b, common, CASE WHEN n = 0 THEN 1.0 ELSE common / (n - common) END AS score FROM s"""


def multiset_jaccard(spark, sf_dir):
    """Pairs whose tokens, with their numbers, agree by 0.7 or more."""
    sets, _ = setjoin.classes(setjoin.multisets(_items(spark, sf_dir, text.tokens)))
    return setjoin.jaccard_pairs(sets, OWN_NUM, OWN_DEN, dense=True).select("id_a", "id_b", (F.col("common") / F.col("total")).alias("score"))


_NUMBERED = "SELECT id, t || ' ' || row_number() OVER (PARTITION BY id, t) AS g FROM (SELECT id, unnest(w) AS t FROM tok)"
_COUNTS = """ct AS (SELECT id, t, count(*) AS c FROM (SELECT id, unnest({0}) AS t FROM tok WHERE id IN (SELECT id_a FROM cand UNION SELECT id_b FROM cand)) GROUP BY 1, 2),
nm AS (SELECT id, sum(c) AS n, sum(c * c) AS q FROM ct GROUP BY id),
mt AS (SELECT id_a, id_b, sum(least(a.c, b.c)) AS m, sum(a.c * b.c) AS dot FROM cand JOIN ct a ON a.id = id_a JOIN ct b ON b.id = id_b AND b.t = a.t GROUP BY 1, 2),
pc AS (SELECT cand.id_a, cand.id_b, coalesce(m, 0)::BIGINT AS m, coalesce(dot, 0)::BIGINT AS dot, coalesce(a.n, 0)::BIGINT AS na, coalesce(b.n, 0)::BIGINT AS nb, coalesce(a.q, 0)::BIGINT AS qa, coalesce(b.q, 0)::BIGINT AS qb
       FROM cand LEFT JOIN mt USING (id_a, id_b) LEFT JOIN nm a ON a.id = cand.id_a LEFT JOIN nm b ON b.id = cand.id_b)"""
MULTISET_SQL = f"WITH {_pairs_sql(_NUMBERED, OWN_NUM, OWN_DEN)} SELECT id_a, id_b, common / total AS score FROM cand"


def token_cosine(spark, sf_dir):
    return _scored(spark, sf_dir, text.tokens, setjoin.pair_counts).select("id_a", "id_b", F.round(setjoin.cosine(), 9).alias("score"))


COSINE_SQL = f"WITH {_SETS}, {_COUNTS.format('w')} SELECT id_a, id_b, round(CASE WHEN qa = 0 OR qb = 0 THEN 0.0 ELSE dot / sqrt(qa::DOUBLE * qb) END, 9) AS score FROM pc"


def logic_flow(spark, sf_dir):
    return _scored(spark, sf_dir, lambda t: text.flow_tokens(text.tokens(t)), setjoin.pair_counts).select("id_a", "id_b", setjoin.multiset_jaccard().alias("score"))


_FLOW = "[CASE WHEN t IN ('for', 'while', 'do') THEN 'LOOP' WHEN t IN ('if', 'switch') THEN 'COND' WHEN t IN ('else', 'case', 'default', 'elif') THEN 'ALT' ELSE 'NUM' END for t in w if t IN ('for', 'while', 'do', 'if', 'switch', 'else', 'case', 'default', 'elif') OR regexp_full_match(t, '[0-9]+')]"
FLOW_SQL = f"WITH {_SETS}, {_COUNTS.format(_FLOW)} SELECT id_a, id_b, CASE WHEN na + nb - m = 0 THEN 1.0 ELSE m / (na + nb - m) END AS score FROM pc"


def incremental_pairs(spark, sf_dir):
    """Pairs of classes with at least one member of a new batch (source src0), and how many pairs of documents with a new
    one each stands for. A class that has a new copy is a pair with itself."""
    sets, members = shingled(spark, sf_dir)
    new = table(spark, sf_dir, "documents").filter("source = 'src0'").select(F.col("doc_id").alias("id")).distinct().withColumn("new", F.lit(1))
    size = written(members.join(new, "id", "left").groupBy("class").agg(F.max("copies").alias("c"), F.count("new").alias("k")), "class_sizes")
    pairs = setjoin.jaccard_pairs(sets, NUM, DEN).select("id_a", "id_b")
    both = pairs.join(size.toDF("id_a", "ca", "ka"), "id_a").join(size.toDF("id_b", "cb", "kb"), "id_b").filter("ka + kb > 0")
    other = both.select("id_a", "id_b", F.expr("ca * cb - (ca - ka) * (cb - kb)").alias("n_pairs"))
    own = size.filter("k > 0 AND c > 1").select(F.col("class").alias("id_a"), F.col("class").alias("id_b"), F.expr("(c * (c - 1) - (c - k) * (c - k - 1)) div 2").alias("n_pairs"))
    return other.unionByName(own)


INCREMENTAL_SQL = f"""WITH {_SETS}, new AS (SELECT doc_id FROM documents WHERE source = 'src0'),
z AS (SELECT class, count(*) AS c, count(*) FILTER (id IN (SELECT * FROM new)) AS k FROM mem GROUP BY class)
SELECT id_a, id_b, a.c * b.c - (a.c - a.k) * (b.c - b.k) AS n_pairs FROM cand JOIN z a ON a.class = id_a JOIN z b ON b.class = id_b WHERE a.k + b.k > 0
UNION ALL SELECT class, class, (c * (c - 1) - (c - k) * (c - k - 1)) // 2 FROM z WHERE k > 0 AND c > 1"""


def pair_list_scores(spark, sf_dir):
    """Scores less the baseline: the median of pairs of classes that no toxic document is in, held to [0, 0.95]."""
    sets, members = shingled(spark, sf_dir)
    toxic = table(spark, sf_dir, "labels").filter("toxic = 1").select(F.col("doc_id").alias("id")).distinct()
    marked_classes = members.join(toxic, "id", "left_semi").select(F.col("class").alias("id")).distinct().withColumn("t", F.lit(1))
    pairs = written(setjoin.jaccard_pairs(sets, NUM, DEN), "pairs").select("id_a", "id_b", (F.col("common") / F.col("total")).alias("score"))
    marked = pairs.join(marked_classes.toDF("id_a", "ta"), "id_a", "left").join(marked_classes.toDF("id_b", "tb"), "id_b", "left")
    marked = written(marked.select("id_a", "id_b", "score", F.coalesce("ta", "tb", F.lit(0)).alias("label")), "marked")
    base = marked.filter("label = 0").agg(F.coalesce(scores.clamp(F.percentile("score", F.lit(0.5)), 0.0, 0.95), F.lit(0.0)).alias("baseline"))
    out = marked.join(F.broadcast(base))  # one row
    return out.select("id_a", "id_b", "label", F.round("score", 9).alias("score"), F.round(scores.subtract_baseline(F.col("score"), F.col("baseline")), 9).alias("adjusted"))


PAIR_LIST_SQL = f"""WITH {_SETS}, t AS (SELECT DISTINCT class FROM mem WHERE id IN (SELECT doc_id FROM labels WHERE toxic = 1)),
m AS (SELECT id_a, id_b, common / total AS score, CASE WHEN id_a IN (SELECT * FROM t) OR id_b IN (SELECT * FROM t) THEN 1 ELSE 0 END AS label FROM cand),
b AS (SELECT coalesce(greatest(0.0, least(0.95, quantile_cont(score, 0.5))), 0.0) AS baseline FROM m WHERE label = 0)
SELECT id_a, id_b, label, round(score, 9) AS score, round(greatest(0.0, least(1.0, (score - baseline) / greatest(0.01, 1 - baseline))), 9) AS adjusted FROM m, b"""


def starter_removal(spark, sf_dir):
    """Lines, white space aside, that a benchmark text has too are taken out of each document."""
    norm = lambda c: F.lower(F.trim(F.regexp_replace(c, r"[ \t\r]+", " ")))
    starter = table(spark, sf_dir, "benchmark").select(F.explode(text.lines(F.col("text"))).alias("l")).select(norm(F.col("l")).alias("l")).filter("l <> ''").distinct()
    lines = table(spark, sf_dir, "documents").select("doc_id", F.explode(text.lines(F.col("text"))).alias("l")).select("doc_id", norm(F.col("l")).alias("l")).filter("l <> ''")
    # counted before it is joined, so that a line all documents share is a row for each document at most
    counted = lines.groupBy("doc_id", "l").agg(F.count(F.lit(1)).alias("c"))
    hit = counted.join(starter.withColumn("hit", F.lit(True)), "l", "left")
    total, gone = F.sum("c"), F.sum(F.when(F.col("hit"), F.col("c")).otherwise(0))
    return hit.groupBy("doc_id").agg(total.alias("n_lines"), gone.alias("n_removed"), (gone / total).alias("overlap"))


STARTER_SQL = r"""WITH s AS (SELECT DISTINCT lower(trim(regexp_replace(l, '[ \t\r]+', ' ', 'g'), ' ')) AS l FROM (SELECT unnest(string_split(coalesce(text, ''), chr(10))) AS l FROM benchmark)),
d AS (SELECT doc_id, lower(trim(regexp_replace(l, '[ \t\r]+', ' ', 'g'), ' ')) AS l FROM (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS l FROM documents))
SELECT doc_id, count(*)::BIGINT AS n_lines, count(*) FILTER (l IN (SELECT l FROM s))::BIGINT AS n_removed, count(*) FILTER (l IN (SELECT l FROM s)) / count(*) AS overlap FROM d WHERE l <> '' GROUP BY doc_id"""


def web_source_match(spark, sf_dir):
    """Documents and pages whose words (three letters or more) agree by a half: .85 Jaccard, and .1 if the page has the
    document's first five words in a row. Whole texts are read again for candidates alone."""
    words = lambda c: text.hashes(F.filter(F.array_distinct(text.tokens(c)), lambda t: F.length(t) > 2))
    plain = lambda c: F.regexp_replace(text.clean(c), "<[^>]*>", " ")
    docs, pages = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text"), table(spark, sf_dir, "pages").select(F.col("page_id").alias("id"), "html")
    sized = lambda d: written(d.select("id", "items", F.size("items").alias("n")), "words").filter("n > 0")
    pairs = written(setjoin.jaccard_pairs(sized(docs.select("id", words(F.col("text")).alias("items"))), 1, 2, sized(pages.select("id", words(plain(F.col("html"))).alias("items"))), dense=True), "matches")
    of = lambda d, k: d.join(pairs.select(F.col(k).alias("id")).distinct(), "id", "left_semi")
    first = of(docs, "id_a").select(F.col("id").alias("id_a"), F.array_join(F.slice(text.tokens(F.col("text")), 1, 5), " ").alias("phrase"))
    body = of(pages, "id_b").select(F.col("id").alias("id_b"), F.array_join(text.tokens(plain(F.col("html"))), " ").alias("body"))
    has = pairs.join(first, "id_a").join(body, "id_b")
    score = 0.85 * F.col("common") / F.col("total") + F.when(F.contains("body", "phrase"), 0.1).otherwise(0.0)
    return has.select(F.col("id_a").alias("doc_id"), F.col("id_b").alias("page_id"), F.round(score, 9).alias("score"))


WEB_SQL = r"""WITH d AS (SELECT doc_id, regexp_extract_all(lower(coalesce(text, '')), '[a-z0-9]+') AS w FROM documents),
p AS (SELECT page_id, regexp_extract_all(lower(regexp_replace(coalesce(html, ''), '<[^>]*>', ' ', 'g')), '[a-z0-9]+') AS w FROM pages),
dx AS (SELECT doc_id, [t for t in list_distinct(w) if length(t) > 2] AS x, array_to_string(w[1:5], ' ') AS phrase FROM d),
px AS (SELECT page_id, [t for t in list_distinct(w) if length(t) > 2] AS x, array_to_string(w, ' ') AS body FROM p),
m AS (SELECT doc_id, page_id, count(*) AS c FROM (SELECT doc_id, unnest(x) AS t FROM dx) JOIN (SELECT page_id, unnest(x) AS t FROM px) USING (t) GROUP BY 1, 2)
SELECT doc_id, page_id, round(0.85::DOUBLE * c / (len(dx.x) + len(px.x) - c) + CASE WHEN contains(body, phrase) THEN 0.1::DOUBLE ELSE 0.0::DOUBLE END, 9) AS score
FROM m JOIN dx USING (doc_id) JOIN px USING (page_id) WHERE 2 * c >= len(dx.x) + len(px.x) - c"""


def _fingerprints(spark, sf_dir, tokens=None, more=()):
    """(id, p, f): positions and hashes that winnowing picks, of all documents or of (id, items), with ``more`` columns."""
    tokens = _items(spark, sf_dir, text.tokens) if tokens is None else tokens
    hashed = tokens.select("id", *more, F.transform(text.ngrams(F.col("items"), 5), F.md5).alias("h"))
    return hashed.select("id", *more, text.let(F.col("h"), lambda h: text.let(text.winnow(h, 4), lambda p: F.struct(p.alias("p"), F.transform(p, lambda i: F.get(h, i - 1)).alias("f")))).alias("x")).select("id", "x.p", "x.f", *more)


def winnow_fingerprints(spark, sf_dir):
    return _fingerprints(spark, sf_dir).select(F.col("id").alias("doc_id"), F.size("p").cast("long").alias("n_fingerprints"), F.md5(F.array_join(F.transform("p", lambda i: i.cast("string")), ",")).alias("positions_md5"), F.md5(F.array_join("f", ",")).alias("fingerprints_md5"))


_FP = f"""wt AS (SELECT doc_id AS id, {_TOK} AS w FROM documents),
wh AS (SELECT id, i AS p, md5(CASE WHEN len(w) < 5 THEN array_to_string(w, ' ') ELSE array_to_string(w[i : i + 4], ' ') END) AS h, greatest(len(w) - 4, 1) AS n
       FROM (SELECT id, w, unnest(range(1, greatest(len(w) - 3, 2))) AS i FROM wt WHERE len(w) > 0)),
wm AS (SELECT id, p, n, min(struct_pack(h := h, p := p)) OVER (PARTITION BY id ORDER BY p ROWS BETWEEN CURRENT ROW AND 3 FOLLOWING) AS m FROM wh),
fp AS (SELECT DISTINCT id, CASE WHEN n < 4 THEN p ELSE m.p END AS p FROM wm WHERE n < 4 OR p <= n - 3),
fh AS (SELECT id, p, h FROM fp JOIN wh USING (id, p))"""
WINNOW_SQL = f"""WITH {_FP}, a AS (SELECT id, count(*) AS n, string_agg(p::VARCHAR, ',' ORDER BY p) AS ps, string_agg(h, ',' ORDER BY p) AS hs FROM fh GROUP BY id)
SELECT doc_id, coalesce(n, 0)::BIGINT AS n_fingerprints, md5(coalesce(ps, '')) AS positions_md5, md5(coalesce(hs, '')) AS fingerprints_md5 FROM documents LEFT JOIN a ON a.id = doc_id"""


def winnow_similarity(spark, sf_dir):
    """Pairs of distinct fingerprint sets by Jaccard, and the floored form that takes control flow as equal."""
    sets, _ = setjoin.classes(_fingerprints(spark, sf_dir).select("id", text.hashes(F.col("f")).alias("items")))
    raw = F.col("common") / F.col("total")
    return setjoin.jaccard_pairs(sets, NUM, DEN).select("id_a", "id_b", F.round(raw, 9).alias("winnowing_raw"), F.round(0.25 + 0.65 * raw, 9).alias("winnowing"))


WINNOW_SIM_SQL = f"""WITH {_FP}, f AS (SELECT DISTINCT id, h FROM fh), k AS (SELECT id, string_agg(h, chr(10) ORDER BY h) AS k, count(*) AS n FROM f GROUP BY id),
c AS (SELECT min(id) AS id, min(n) AS n FROM k GROUP BY k), r AS (SELECT f.id, h FROM f JOIN c USING (id)),
p AS (SELECT a.id AS id_a, b.id AS id_b, count(*) AS common FROM r a JOIN r b ON a.h = b.h AND a.id < b.id GROUP BY 1, 2),
s AS (SELECT id_a, id_b, common, x.n + y.n - common AS total FROM p JOIN c x ON x.id = id_a JOIN c y ON y.id = id_b)
SELECT id_a, id_b, round(common / total, 9) AS winnowing_raw, round(0.25::DOUBLE + 0.65::DOUBLE * (common / total), 9) AS winnowing FROM s WHERE 2 * common >= total"""


def _shingle_strings(spark, sf_dir):
    return _items(spark, sf_dir, lambda t: text.ngrams(text.tokens(t), WORDS))


def minhash_signatures(spark, sf_dir):
    """The signature of each document, its minima joined by commas."""
    return sketch.minhash(_shingle_strings(spark, sf_dir)).select(F.col("id").alias("doc_id"), F.array_join(F.transform("sig", lambda x: x.cast("string")), ",").alias("signature"))


_MINHASH = f"""mt AS (SELECT doc_id AS id, {_TOK} AS w FROM documents),
mg AS (SELECT DISTINCT id, CASE WHEN len(w) < 5 THEN array_to_string(w, ' ') ELSE array_to_string(w[i : i + 4], ' ') END AS g FROM (SELECT id, w, unnest(range(1, greatest(len(w) - 3, 2))) AS i FROM mt WHERE len(w) > 0)),
mh AS (SELECT id, ('0x' || m[7:8] || m[5:6] || m[3:4] || m[1:2])::UBIGINT AS h FROM (SELECT id, md5(g) AS m FROM mg)),
ms AS (SELECT id, [{', '.join(f'min(({a}::UBIGINT * h + {b}::UBIGINT) % {sketch.PRIME}::UBIGINT)::BIGINT' for a, b in sketch.coefficients())}] AS sig FROM mh GROUP BY id)"""
MINHASH_SQL = f"WITH {_MINHASH} SELECT doc_id, coalesce(array_to_string(sig, ','), '{','.join([str(sketch.EMPTY)] * sketch.PERMUTATIONS)}') AS signature FROM documents LEFT JOIN ms ON ms.id = doc_id"


def lsh_candidates(spark, sf_dir):
    """Pairs of distinct signatures that share a band and whose signatures agree by 0.8, with the share of equal positions."""
    return sketch.lsh_pairs(_shingle_strings(spark, sf_dir))


_BANDS = f"""sg AS (SELECT min(id) AS id, sig, count(*) AS copies FROM ms GROUP BY sig),
bd AS (SELECT id, b, md5(array_to_string(sig[b * {sketch.ROWS} + 1 : b * {sketch.ROWS} + {sketch.ROWS}], ',')) AS bucket FROM sg, range({sketch.PERMUTATIONS // sketch.ROWS}) r(b))"""
_LSH = f"""{_MINHASH}, {_BANDS}, lp AS (SELECT DISTINCT x.id AS id_a, y.id AS id_b FROM bd x JOIN bd y ON x.b = y.b AND x.bucket = y.bucket AND x.id < y.id),
le AS (SELECT id_a, id_b, len([i for i in range(1, {sketch.PERMUTATIONS + 1}) if x.sig[i] = y.sig[i]]) / {sketch.PERMUTATIONS} AS estimate FROM lp JOIN sg x ON x.id = id_a JOIN sg y ON y.id = id_b),
lc AS (SELECT * FROM le WHERE estimate >= 0.8::DOUBLE)"""
LSH_SQL = f"WITH {_LSH} SELECT * FROM lc"


def lsh_recall(spark, sf_dir):
    """Of the pairs of distinct sets with a similarity of 0.8 or more, how many share a band, and how many the estimate keeps."""
    true = written(setjoin.jaccard_pairs(shingled(spark, sf_dir)[0], 4, 5).select("id_a", "id_b"), "true_pairs")
    met = sketch.lsh_pairs(_shingle_strings(spark, sf_dir), least=0.0).select("id_a", "id_b", "estimate")
    t = true.join(met, ["id_a", "id_b"], "left").agg(F.count(F.lit(1)).alias("true_pairs"), F.count("estimate").alias("in_a_band"), F.count_if(F.col("estimate") >= sketch.LEAST).alias("kept"))
    share = lambda c: F.round(F.when(F.col("true_pairs") == 0, 1.0).otherwise(F.col(c) / F.col("true_pairs")), 9)
    return t.select("true_pairs", "in_a_band", "kept", share("in_a_band").alias("recall"))


RECALL_LSH_SQL = f"""WITH {_pairs_sql(_GRAMS, 4, 5)}, {_LSH}
SELECT count(*) AS true_pairs, count(estimate) AS in_a_band, count(*) FILTER (estimate >= 0.8::DOUBLE) AS kept, round(CASE WHEN count(*) = 0 THEN 1.0 ELSE count(estimate) / count(*) END, 9) AS recall
FROM cand LEFT JOIN le USING (id_a, id_b)"""


def lsh_stats(spark, sf_dir):
    return sketch.lsh_stats(_shingle_strings(spark, sf_dir))


LSH_STATS_SQL = f"""WITH {_MINHASH}, {_BANDS} SELECT (SELECT count(*) FROM ms)::BIGINT AS documents, count(*)::BIGINT AS buckets, sum(n)::BIGINT AS entries, max(n)::BIGINT AS largest
FROM (SELECT b, bucket, sum(copies) AS n FROM bd JOIN sg USING (id) GROUP BY b, bucket)"""


def knn_cosine(spark, sf_dir):
    return vectors.knn(table(spark, sf_dir, "embeddings"), 5, "cosine")


def knn_l2(spark, sf_dir):
    return vectors.knn(table(spark, sf_dir, "embeddings"), 5, "l2")


_KNN = """WITH e AS (SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings)
SELECT q.vec_id AS query_id, i.vec_id, row_number() OVER (PARTITION BY q.vec_id ORDER BY {0} {1}, i.vec_id)::INTEGER AS rank, round({0}, 6) AS score
FROM e q JOIN e i ON q.vec_id % 20 = 0 AND q.vec_id <> i.vec_id QUALIFY rank <= 5"""
KNN_COSINE_SQL = _KNN.format("list_cosine_similarity(q.v, i.v)", "DESC")
KNN_L2_SQL = _KNN.format("1 / (1 + list_distance(q.v, i.v))", "DESC")


def _clustered(spark, sf_dir):
    """Edges between classes of 0.65 or more, the members of all classes, and the cluster of each class that is linked or
    has copies."""
    sets, members = shingled(spark, sf_dir)
    edges = written(setjoin.jaccard_pairs(sets, 13, 20).select(F.col("id_a").alias("a"), F.col("id_b").alias("b"), (F.col("common") / F.col("total")).alias("w")), "edges")
    linked = graph.connected(edges)
    sizes = sets.select("id", "copies").join(linked, "id", "left").filter("cluster IS NOT NULL OR copies > 1").select("id", "copies", F.coalesce("cluster", "id").alias("cluster"))
    return edges, members, written(sizes, "clustered")


def clusters(spark, sf_dir):
    """The cluster of every document that is like another, exact copies among them."""
    _, members, found = _clustered(spark, sf_dir)
    return members.select("id", F.col("class")).join(found.select(F.col("id").alias("class"), "cluster"), "class").select(F.col("id").alias("doc_id"), "cluster")


_EDGES = "e AS (SELECT id_a AS a, id_b AS b, common / total AS w FROM cand WHERE 100 * common >= 65 * total), s AS (SELECT a, b FROM e UNION SELECT b, a FROM e), r AS (SELECT id AS a, id AS b FROM cls WHERE copies > 1 OR id IN (SELECT a FROM s) UNION SELECT r.a, s.b FROM r JOIN s ON s.a = r.b), k AS (SELECT a AS id, min(b) AS cluster FROM r GROUP BY a)"
CLUSTERS_SQL = f"WITH RECURSIVE {_SETS}, {_EDGES} SELECT mem.id AS doc_id, cluster FROM mem JOIN k ON k.id = mem.class"


def cluster_stats(spark, sf_dir):
    """Per cluster: documents, their links (copies are linked with similarity 1), greatest and mean similarity over all
    pairs of documents, where a missing link counts 0. Copies are counted, not expanded."""
    edges, _, found = _clustered(spark, sf_dir)
    size = found.select("id", "copies", "cluster")
    across = edges.join(size.toDF("a", "ca", "cluster"), "a").join(size.select(F.col("id").alias("b"), F.col("copies").alias("cb")), "b")
    across = across.select("cluster", (F.col("ca") * F.col("cb")).alias("k"), "w")
    within = found.filter("copies > 1").select("cluster", F.expr("copies * (copies - 1) div 2").alias("k"), F.lit(1.0).alias("w"))
    inside = across.unionByName(within).groupBy("cluster").agg(F.sum("k").alias("n_edges"), F.max("w").alias("max_similarity"), F.sum(F.col("k") * F.col("w")).alias("s"))
    sizes = found.groupBy("cluster").agg(F.sum("copies").alias("size"))
    pairs = F.col("size") * (F.col("size") - 1) / 2
    return sizes.join(inside, "cluster").select("cluster", "size", "n_edges", F.round("max_similarity", 9).alias("max_similarity"), F.round(F.col("s") / pairs, 9).alias("avg_similarity"))


CLUSTER_STATS_SQL = f"""WITH RECURSIVE {_SETS}, {_EDGES}, m AS (SELECT mem.id, class, cluster FROM mem JOIN k ON k.id = mem.class),
p AS (SELECT x.cluster, 1.0::DOUBLE AS w FROM m x JOIN m y ON x.class = y.class AND x.id < y.id UNION ALL SELECT x.cluster, w FROM e JOIN m x ON x.class = e.a JOIN m y ON y.class = e.b),
z AS (SELECT cluster, count(*) AS size FROM m GROUP BY cluster), x AS (SELECT cluster, count(*) AS n_edges, max(w) AS m, sum(w) AS t FROM p GROUP BY cluster)
SELECT cluster, size, n_edges, round(m, 9) AS max_similarity, round(t / (size * (size - 1) / 2), 9) AS avg_similarity FROM z JOIN x USING (cluster)"""


def tfidf_pairs(spark, sf_dir):
    """Cosine of TF-IDF weights of candidate pairs; idf = ln((N + 1) / (df + 1)) + 1 over all documents."""
    docs = written(_items(spark, sf_dir, lambda t: F.transform(text.tokens(t), lambda w: F.xxhash64(w))), "tokens")
    n = docs.filter(F.size("items") > 0).agg(F.count(F.lit(1)).alias("n"))
    df = docs.select(F.explode(F.array_distinct("items")).alias("t")).groupBy("t").agg(F.count(F.lit(1)).alias("df"))
    idf = df.join(F.broadcast(n)).select("t", (F.log((F.col("n") + 1) / (F.col("df") + 1)) + 1).alias("idf"))
    pairs = candidates(spark, sf_dir).select("id_a", "id_b")
    ids = pairs.select(F.explode(F.array("id_a", "id_b")).alias("id")).distinct()
    w = setjoin.counts(docs.join(ids, "id", "left_semi")).join(idf, "t").select("id", "t", (F.col("c") * F.col("idf")).alias("w"))
    sides = written(w.groupBy("id").agg(F.sort_array(F.collect_list(F.struct("t", "w"))).alias("s")).select("id", "s.t", "s.w"), "weights")

    def cosine(x, y):
        hit, at = setjoin.met(x[0], y[0])
        return (float(x[1][hit] @ y[1][at]) / float(np.sqrt(x[1] @ x[1]) * np.sqrt(y[1] @ y[1])),) if len(at) else None

    return setjoin.compared(pairs, cosine, "score double", sides).select("id_a", "id_b", F.round("score", 6).alias("score"))


TFIDF_SQL = f"""WITH {_SETS}, ct AS (SELECT id, t, count(*) AS c FROM (SELECT id, unnest(w) AS t FROM tok) GROUP BY 1, 2),
n AS (SELECT count(DISTINCT id) AS n FROM ct), idf AS (SELECT t, ln((n + 1) / (count(*) + 1)) + 1 AS idf FROM ct, n GROUP BY t, n),
w AS (SELECT id, t, c * idf AS w FROM ct JOIN idf USING (t)), nm AS (SELECT id, sqrt(sum(w * w)) AS norm FROM w GROUP BY id),
d AS (SELECT id_a, id_b, sum(x.w * y.w) AS dot FROM cand JOIN w x ON x.id = id_a JOIN w y ON y.id = id_b AND y.t = x.t GROUP BY 1, 2)
SELECT id_a, id_b, round(dot / (x.norm * y.norm), 6) AS score FROM d JOIN nm x ON x.id = id_a JOIN nm y ON y.id = id_b"""

QUERIES = {
    "suspicious_pairs": (suspicious_pairs, SUSPICIOUS_SQL),
    "duplicate_classes": (duplicate_classes, CLASSES_SQL),
    "exact_duplicates": (exact_duplicates, EXACT_SQL),
    "first_wins_dedup": (first_wins_dedup, FIRST_SQL),
    "content_overlap": (content_overlap, OVERLAP_SQL),
    "char_ngram_dice": (char_ngram_dice, CHAR_SQL),
    "token_bigram_dice": (token_bigram_dice, BIGRAM_SQL),
    "token_jaccard": (token_jaccard, JACCARD_SQL),
    "keyword_overlap": (keyword_overlap, KEYWORD_SQL),
    "multiset_jaccard": (multiset_jaccard, MULTISET_SQL),
    "token_cosine": (token_cosine, COSINE_SQL),
    "tfidf_pairs": (tfidf_pairs, TFIDF_SQL),
    "logic_flow": (logic_flow, FLOW_SQL),
    "incremental_pairs": (incremental_pairs, INCREMENTAL_SQL),
    "pair_list_scores": (pair_list_scores, PAIR_LIST_SQL),
    "starter_removal": (starter_removal, STARTER_SQL),
    "web_source_match": (web_source_match, WEB_SQL),
    "winnow_fingerprints": (winnow_fingerprints, WINNOW_SQL),
    "winnow_similarity": (winnow_similarity, WINNOW_SIM_SQL),
    "minhash_signatures": (minhash_signatures, MINHASH_SQL),
    "lsh_candidates": (lsh_candidates, LSH_SQL),
    "lsh_recall": (lsh_recall, RECALL_LSH_SQL),
    "lsh_stats": (lsh_stats, LSH_STATS_SQL),
    "knn_cosine": (knn_cosine, KNN_COSINE_SQL),
    "knn_l2": (knn_l2, KNN_L2_SQL),
    "clusters": (clusters, CLUSTERS_SQL),
    "cluster_stats": (cluster_stats, CLUSTER_STATS_SQL),
}
