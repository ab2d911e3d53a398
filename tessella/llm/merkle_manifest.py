"""Operator 11, Merkle manifest of a dataset: trees of SHA-256 digests made with DataFrame functions only.

A leaf is the digest of a row's fields. The leaves of one key (here ``lang``) stand in order, and every ``FAN``
consecutive nodes become their parent, the digest of their concatenation, until one is left; a shorter last run, of one
node too, becomes a parent like any other. The roots of the keys, in order of the key, give the root of the dataset in
the same way.

The rows' places come from a range partition of the whole table, so no task holds a key. The leaves of ``BLOCK`` places
(a power of the fan) are one ordered array, whose levels collapse with ``sequence``, ``transform``, ``slice`` and
``aggregate``; the roots of the blocks are the leaves of the next round, until each key has one block. A proof is the path
inside the block followed by the path of the block, so it is never shuffled.

Defined results: a null field is the text ``-``; a null key is a key of its own, which comes first. A null id comes first
and is never tampered with. Rows that share an id are separate leaves, in order of their digests; equal rows are separate
leaves too, and which of them stands first makes no difference to the rows returned. An empty table has no rows and no
root. Long texts are digested whole. Other columns are ignored.
"""

from __future__ import annotations

import math
import string

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessella.llm.common import let, materialize, table

FAN, BLOCK = 8, 8**4
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def digest(*fields: Column) -> Column:
    """The digest of fields: each ``-`` if null, else its UTF-8 bytes' number, a colon and the value."""
    part = lambda c: F.coalesce(F.concat(F.octet_length(c.cast("string")).cast("string"), F.lit(":"), c.cast("string")), F.lit("-"))
    return F.sha2(F.concat(*(part(c) for c in fields)), 256)


def leaves(docs: DataFrame) -> DataFrame:
    """``doc_id``, ``lang``, the leaf ``node``, and ``forged``: the leaf after tampering, null where nothing is tampered."""
    lower = F.translate("text", string.ascii_uppercase, string.ascii_lowercase)
    hit = F.crc32(F.col("doc_id").cast("string")) % 3 == 0
    forged = digest(*(lower if f == "text" else F.col(f) for f in FIELDS))
    return docs.select("doc_id", "lang", digest(*(F.col(f) for f in FIELDS)).alias("node"), F.when(hit, forged).alias("forged"))


def ranked(nodes: DataFrame, key: str, order: list[str]) -> DataFrame:
    """Adds ``pos``, a row's place among its key's, from 0, and ``total``, their number: ranges of the whole table, counted,
    and places within a range. A key with most of the rows is many ranges, and so are equal rows."""
    n = int(nodes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    bounds = [F.col(c).asc_nulls_first() for c in (key, *order)]
    ranges = materialize(nodes.withColumn("__row", F.monotonically_increasing_id()).repartitionByRange(n, *bounds, "__row").withColumn("__p", F.spark_partition_id()), "ranges")
    counted = ranges.groupBy("__p", F.col(key).alias("__key")).agg(F.count(F.lit(1)).alias("__n"))
    own = Window.partitionBy("__key")  # a row for each range at most
    before = F.coalesce(F.sum("__n").over(own.orderBy("__p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = counted.select(F.col("__p").alias("__q"), "__key", before.alias("__before"), F.sum("__n").over(own).alias("total"))
    place = F.row_number().over(Window.partitionBy("__p", key).orderBy(*bounds[1:], "__row")) - 1
    found = ranges.withColumn("__i", place).join(starts, (F.col("__p") == F.col("__q")) & F.col(key).eqNullSafe(F.col("__key")))
    return found.select(*nodes.columns, (F.col("__before") + F.col("__i")).alias("pos"), "total")


def _parents(level: Column) -> Column:
    runs = F.sequence(F.lit(0), F.floor((F.size(level) - 1) / FAN).cast("int"))
    return F.transform(runs, lambda i: F.sha2(F.array_join(F.slice(level, i * FAN + 1, FAN), ""), 256))


def _levels(nodes: Column, whole: Column, block: int) -> Column:
    """The levels of a block from its nodes up to its root. ``whole``: the key has this block alone, so it ends with one
    node; else the block has all its levels."""
    most = round(math.log(block, FAN))
    depth = F.lit(most)
    for d in range(most - 1, -1, -1):
        depth = F.when(whole & (F.size(nodes) <= FAN**d), d).otherwise(depth)
    start = F.array(nodes).cast("array<array<string>>")
    grow = lambda acc, _: F.concat(acc, F.array(_parents(F.element_at(acc, -1)))).cast("array<array<string>>")
    return let(depth, lambda d: F.when(d == 0, start).otherwise(F.aggregate(F.sequence(F.lit(1), F.greatest(d, F.lit(1))), start, grow)))


def _no_steps() -> Column:
    return F.array().cast("array<struct<l:string,r:string>>")


def _steps(levels: Column, i: Column) -> Column:
    """From node ``i`` of a block to its root: what stands left and right of it in its run, level by level."""

    def step(j: Column) -> Column:
        at = F.floor(i / F.pow(F.lit(FAN), j)).cast("int")
        run = F.slice(F.element_at(levels, j + 1), F.floor(at / FAN).cast("int") * FAN + 1, FAN)
        return F.struct(F.array_join(F.slice(run, F.lit(1), at % FAN), "").alias("l"), F.array_join(F.slice(run, at % FAN + 2, FAN), "").alias("r"))

    return F.when(F.size(levels) > 1, F.transform(F.sequence(F.lit(0), F.greatest(F.size(levels) - 2, F.lit(0))), step)).otherwise(_no_steps())


def placed(nodes: DataFrame, key: str, carry: tuple[str, ...] = (), block: int = BLOCK) -> DataFrame:
    """The blocks of ranked nodes: ``items`` (node and carried columns, in order), ``levels``, ``outer`` (the steps from the
    block's root on) and the key's ``root``."""
    row = F.struct("pos", "node", *carry)
    blocks = nodes.groupBy(key, F.floor(F.col("pos") / block).alias("block"), "total").agg(F.array_sort(F.collect_list(row)).alias("items"))
    blocks = materialize(blocks.withColumn("levels", _levels(F.transform("items", lambda x: x["node"]), F.col("total") <= block, block)), "blocks")
    top = F.element_at(F.element_at("levels", -1), 1)
    if (blocks.agg(F.max("total")).first()[0] or 0) <= block:
        return blocks.select("*", _no_steps().alias("outer"), top.alias("root"))
    roots = blocks.filter(F.col("total") > block).select(key, F.col("block").alias("pos"), F.ceil(F.col("total") / block).alias("total"), top.alias("node"))
    above = members(placed(roots, key, block=block), key).select(F.col(key).alias("__key"), F.col("pos").alias("__pos"), "steps", F.col("root").alias("__root"))
    found = blocks.join(above, F.col(key).eqNullSafe(F.col("__key")) & (F.col("block") == F.col("__pos")), "left")
    return found.select(*blocks.columns, F.coalesce("steps", _no_steps()).alias("outer"), F.coalesce("__root", top).alias("root"))


def members(blocks: DataFrame, key: str) -> DataFrame:
    """The nodes of blocks, each with the ``steps`` from it to the root."""
    each = F.transform("items", lambda x, i: F.struct(x.alias("x"), F.concat(_steps(F.col("levels"), i), F.col("outer")).alias("steps")))
    return blocks.select(key, "root", F.explode(each).alias("m")).select(key, "m.x.*", "m.steps", "root")


def manifest(docs: DataFrame, block: int = BLOCK) -> DataFrame:
    """Each row's leaf, its key's root, the dataset's root, its proof, and what the proof says of its tampered leaf."""
    blocks = placed(ranked(materialize(leaves(docs), "leaves"), "lang", ["doc_id", "node"]), "lang", ("doc_id", "forged"), block)
    subroots = blocks.filter("block = 0").select("lang", F.col("root").alias("node"), F.lit(0).alias("all"))
    keys = members(placed(ranked(subroots, "all", ["lang"]), "all", ("lang",), block), "all")
    keys = keys.select(F.col("lang").alias("__lang"), F.col("steps").alias("__above"), F.col("root").alias("__root"))
    whole = blocks.join(keys, F.col("lang").eqNullSafe(F.col("__lang"))).select("lang", "items", "levels", F.concat("outer", "__above").alias("outer"), F.struct(F.col("root").alias("sub"), F.col("__root").alias("all")).alias("root"))
    proof = F.sha2(F.array_join(F.transform("steps", lambda s: F.concat(s["l"], s["r"])), ""), 256)
    folded = F.aggregate("steps", F.coalesce("forged", "node"), lambda acc, s: F.sha2(F.concat(s["l"], acc, s["r"]), 256))
    out = members(whole, "lang").select("doc_id", F.col("node").alias("leaf"), F.col("root.sub").alias("subroot"), F.col("root.all").alias("root"), proof.alias("proof_sha256"), folded.alias("folded_root"))
    return out.withColumn("verified", F.col("folded_root") == F.col("root"))


def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return manifest(table(spark, sf_dir, "documents"))


def _enc(c: str) -> str:
    return f"coalesce(strlen({c}::VARCHAR) || ':' || {c}::VARCHAR, '-')"


_H = " || ".join(_enc(c) for c in FIELDS)
_FORGED = " || ".join(_enc("translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')" if c == "text" else c) for c in FIELDS)
_BITS = "CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END"

OP11_SQL = f"""
WITH RECURSIVE bits(i, c, k) AS (SELECT i, i, 0 FROM range(256) t(i) UNION ALL SELECT i, {_BITS}, k + 1 FROM bits WHERE k < 8),
tab AS (SELECT list(c ORDER BY i) AS t FROM bits WHERE k = 8),
d AS (SELECT *, sha256({_H}) AS leaf, sha256({_FORGED}) AS low FROM documents),
crc AS (SELECT *, xor(list_reduce(list_prepend(4294967295::BIGINT, [ord(x)::BIGINT FOR x IN string_split(doc_id::VARCHAR, '')]),
        lambda a, b: xor(a // 256, t[xor(a, b) % 256 + 1])), 4294967295) AS crc FROM d, tab),
r AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos FROM crc),
up(lang, lvl, pos, h, n) AS (
  SELECT lang, 0, pos, leaf, count(*) OVER (PARTITION BY lang) FROM r
  UNION ALL
  SELECT lang, lvl + 1, pos // 8, sha256(string_agg(h, '' ORDER BY pos)), (any_value(n) + 7) // 8 FROM up WHERE n > 1 GROUP BY lang, lvl, pos // 8),
sub AS (SELECT lang, h, lvl AS depth, row_number() OVER (ORDER BY lang NULLS FIRST) - 1 AS pos FROM up WHERE n = 1),
top(lvl, pos, h, n) AS (
  SELECT 0, pos, h, count(*) OVER () FROM sub
  UNION ALL
  SELECT lvl + 1, pos // 8, sha256(string_agg(h, '' ORDER BY pos)), (any_value(n) + 7) // 8 FROM top WHERE n > 1 GROUP BY lvl, pos // 8),
low_steps AS (SELECT a.lang, a.lvl, a.pos, coalesce(string_agg(b.h, '' ORDER BY b.pos) FILTER (b.pos < a.pos), '') AS l,
        coalesce(string_agg(b.h, '' ORDER BY b.pos) FILTER (b.pos > a.pos), '') AS r
        FROM up a JOIN up b ON a.lang IS NOT DISTINCT FROM b.lang AND a.lvl = b.lvl AND a.pos // 8 = b.pos // 8 WHERE a.n > 1 GROUP BY ALL),
top_steps AS (SELECT a.lvl, a.pos, coalesce(string_agg(b.h, '' ORDER BY b.pos) FILTER (b.pos < a.pos), '') AS l,
        coalesce(string_agg(b.h, '' ORDER BY b.pos) FILTER (b.pos > a.pos), '') AS r
        FROM top a JOIN top b ON a.lvl = b.lvl AND a.pos // 8 = b.pos // 8 WHERE a.n > 1 GROUP BY ALL),
walk(lang, pos, lvl, high, spot, acc, proof) AS (
  SELECT lang, pos, 0, false, pos, CASE WHEN crc % 3 = 0 THEN low ELSE leaf END, '' FROM r
  UNION ALL
  SELECT w.lang, w.pos, CASE WHEN s.lang IS NOT DISTINCT FROM w.lang AND s.l IS NOT NULL THEN w.lvl + 1 ELSE 0 END, s.l IS NULL,
         CASE WHEN s.l IS NOT NULL THEN w.spot // 8 ELSE b.pos END, CASE WHEN s.l IS NOT NULL THEN sha256(s.l || w.acc || s.r) ELSE w.acc END,
         CASE WHEN s.l IS NOT NULL THEN w.proof || s.l || s.r ELSE w.proof END
  FROM walk w LEFT JOIN low_steps s ON s.lang IS NOT DISTINCT FROM w.lang AND s.lvl = w.lvl AND s.pos = w.spot
       JOIN sub b ON b.lang IS NOT DISTINCT FROM w.lang WHERE NOT w.high),
climb(lang, pos, lvl, spot, acc, proof) AS (
  SELECT lang, pos, 0, spot, acc, proof FROM walk WHERE high
  UNION ALL
  SELECT c.lang, c.pos, c.lvl + 1, c.spot // 8, sha256(s.l || c.acc || s.r), c.proof || s.l || s.r
  FROM climb c JOIN top_steps s ON s.lvl = c.lvl AND s.pos = c.spot),
ends AS (SELECT * FROM climb WHERE lvl = (SELECT max(lvl) FROM top))
SELECT r.doc_id, r.leaf, b.h AS subroot, t.h AS root, sha256(e.proof) AS proof_sha256, e.acc AS folded_root, e.acc = t.h AS verified
FROM r JOIN ends e ON e.lang IS NOT DISTINCT FROM r.lang AND e.pos = r.pos JOIN sub b ON b.lang IS NOT DISTINCT FROM r.lang, (SELECT h FROM top WHERE n = 1) t
"""
