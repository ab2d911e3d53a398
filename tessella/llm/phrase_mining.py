"""Operator 12, phrase collocations: contiguous patterns grown to the right from projected occurrences.

A word stands for a 64-bit hash of its language and itself. Words are counted, then pairs of frequent words. An occurrence
of a frequent pair is a pointer: the pair and the up to three words that follow while each next pair is frequent too
(a longer frequent phrase has frequent pairs only). Equal pointers of a lot of texts are counted before they move. All
pointers of one prefix, a frequent pair, go to one task, where they stand sorted, so that a prefix is a run; growth goes
depth-first into the runs of the next word and leaves a run whose occurrences are too few. A prefix with more than a
``1 / HOT`` part of all occurrences (so of these there are at most ``HOT``) is split by its next words, down to whole
pointers, and the shares of its counts are summed.

Which words and pairs are frequent is told to the tasks by bitmaps of hashes of at most ``2 ** MOST_BITS`` bits: a wrong
yes costs a pointer that is counted for nothing, a wrong no does not occur, so results do not depend on them. Counts are
exact but for collisions of the 64-bit hashes of words.

A phrase's score is that of its weakest cut in two, a quotient of counts in decimal numbers of 38 digits. Whether a phrase
hides in a longer one is decided by the phrases that are one word longer: counts never grow with the phrase, so if any
longer one hides it, one of these does.

Defined results: a null text is an empty one; a null language is ``und``. Repeated rows, and rows that share an id, all
count. A table without texts, or with too few, has no phrases. Long texts count whole; one text is the least that a task
holds. Other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessella.llm.common import materialize, table

LEAST, LONGEST, TOP, SHARE = 100, 5, 2000, 100
HOT, LOT_BYTES, MOST_BITS = 1000, 1 << 24, 26
#: Bytes by kind: 0 in a word, 1 between words, 2 between pieces.
_KIND = np.zeros(256, np.uint8)
_KIND[[0x20, 0x09]] = 1
_KIND[[*b".,;:!?", *range(0x0A, 0x0E)]] = 2
_W = [f"w{i + 1}" for i in range(LONGEST)]


class Bits:
    """A bitmap of 64-bit hashes."""

    def __init__(self, words: np.ndarray):
        self.words, self.mask = words, np.uint64(len(words) * 64 - 1)

    def has(self, h: np.ndarray) -> np.ndarray:
        at = h & self.mask
        return ((self.words[at >> np.uint64(6)] >> (at & np.uint64(63))) & np.uint64(1)).astype(bool)


def bitmap(df: DataFrame, h: Column, n: int) -> Bits:
    """The bitmap of a column of hashes, made by Spark: 16 bits for each of n, up to the bound."""
    bits = min(max(math.ceil(math.log2(16 * max(n, 1))), 10), MOST_BITS)
    at = h.bitwiseAND(F.lit((1 << bits) - 1))
    rows = df.select(at.alias("at")).selectExpr("shiftright(at, 6) AS i", "shiftleft(1L, cast(at & 63 AS int)) AS b").groupBy("i").agg(F.bit_or("b").alias("b")).toArrow()
    words = np.zeros(1 << (bits - 6), np.uint64)
    words[rows.column("i").to_numpy()] = rows.column("b").to_numpy().view(np.uint64)
    return Bits(words)


def pair_hash(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return a ^ ((b << np.uint64(29)) | (b >> np.uint64(35)))


def _pair_column(a: str, b: str) -> Column:
    return F.col(a).bitwiseXOR(F.shiftleft(F.col(b), 29).bitwiseOR(F.shiftrightunsigned(F.col(b), 35)))


class Lot:
    """The words of some texts of one language: ``words`` (distinct), ``ids`` (their hashes), ``code`` (each occurrence's
    word) and ``joined`` (the next occurrence is in the same piece)."""

    def __init__(self, texts: pa.Array, lang: str):
        import xxhash

        texts = pc.ascii_lower(texts)
        offsets = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset : texts.offset + len(texts) + 1] if len(texts) else np.zeros(1, np.int32)
        data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]]
        begins = np.zeros(len(data) + 1, bool)
        begins[offsets - offsets[0]] = True
        kind = _KIND[data]
        word = kind == 0
        edge = np.diff(np.concatenate(([False], word, [False])).view(np.int8))
        start = np.flatnonzero((edge[:-1] == 1) | (word & begins[:-1]))
        end = np.flatnonzero(word & ((edge[1:] == -1) | begins[1:])) + 1
        size = np.concatenate(([0], np.cumsum(end - start))).astype(np.int64)
        coded = pa.LargeStringArray.from_buffers(len(start), pa.py_buffer(size), pa.py_buffer(data[word])).dictionary_encode()
        self.words, self.code = coded.dictionary.cast(pa.string()), coded.indices.to_numpy()
        seed = lang.encode() + b"\0"
        self.ids = np.fromiter((xxhash.xxh3_64_intdigest(seed + w.encode()) for w in self.words.to_pylist()), np.uint64, len(self.words))
        piece = np.cumsum((kind == 2) | begins[:-1], dtype=np.int32)[start]
        self.joined = np.zeros(len(start), bool)
        self.joined[:-1] = piece[1:] == piece[:-1]

    def pairs(self, frequent: Bits) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(first, second, number) of the pairs of words that may be frequent."""
        known = frequent.has(self.ids)[self.code]
        at = np.flatnonzero(self.joined[:-1] & known[:-1] & known[1:])
        key, n = np.unique(self.code[at].astype(np.int64) * len(self.ids) + self.code[at + 1], return_counts=True)
        return self.ids[key // max(len(self.ids), 1)], self.ids[key % max(len(self.ids), 1)], n

    def pointers(self, frequent: Bits) -> tuple[np.ndarray, np.ndarray]:
        """Distinct runs of three to LONGEST words whose pairs may be frequent (codes, -1 after the end), and how often each
        occurs. A pair alone needs no pointer, as its count is known."""
        ids = self.ids[self.code]
        next_ok = np.zeros(len(ids) + LONGEST, bool)
        next_ok[: max(len(ids) - 1, 0)] = self.joined[:-1] & frequent.has(pair_hash(ids[:-1], ids[1:]))
        at = np.flatnonzero(next_ok[: len(ids)] & next_ok[1 : len(ids) + 1])
        code = np.full((LONGEST, len(at)), -1, np.int64)
        more = np.ones(len(at), bool)
        for k in range(LONGEST):
            code[k, more] = self.code[at[more] + k]
            more &= next_ok[at + k]
        order = np.lexsort(code[::-1])
        code = code[:, order]
        new = np.flatnonzero(np.concatenate(([True], (code[:, 1:] != code[:, :-1]).any(axis=0)))) if len(at) else order
        return code[:, new], np.diff(np.append(new, len(at)))


def lots(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, Lot]]:
    """The texts (column 1) by language (column 0), some MB at a time."""
    for batch in batches:
        texts = batch.column(1).cast(pa.string()).fill_null("")
        langs = batch.column(0).cast(pa.string()).fill_null("und").dictionary_encode()
        size = np.cumsum(pc.binary_length(texts).to_numpy())
        at = 0
        while at < len(texts):
            to = max(at + 1, int(np.searchsorted(size, (size[at - 1] if at else 0) + LOT_BYTES, "right")))
            own = langs.indices[at:to]
            for code in pc.unique(own).to_pylist():
                lang = langs.dictionary[code].as_py()
                yield lang, Lot(texts[at:to].filter(pc.equal(own, code)), lang)
            at = to


def _over(docs: DataFrame, columns: str, rows: Callable[[str, Lot], list]) -> DataFrame:
    names = [c.split()[0] for c in columns.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for lang, lot in lots(batches):
            whole = pa.RecordBatch.from_arrays(rows(lang, lot), names)
            yield from (whole.slice(k, 1 << 16) for k in range(0, whole.num_rows, 1 << 16))

    return docs.select("lang", "text").mapInArrow(run, columns)


def _signed(ids: np.ndarray) -> pa.Array:
    return pa.array(ids.view(np.int64))


def word_counts(docs: DataFrame, least: int = LEAST) -> DataFrame:
    """``lang``, ``word``, ``id``, ``f`` of the frequent words, and ``n``, all occurrences of words of the language."""

    def rows(lang: str, lot: Lot) -> list:
        n = len(lot.words)
        return [pa.array([lang] * n, pa.string()), lot.words, _signed(lot.ids), pa.array(np.bincount(lot.code, minlength=n))]

    counts = _over(docs, "lang string, word string, id long, f long", rows).groupBy("lang", "word", "id").agg(F.sum("f").alias("f"))
    rare = F.col("f") < least
    kept = materialize(counts.groupBy("lang", F.when(~rare, F.col("word")).alias("word"), F.when(~rare, F.col("id")).alias("id")).agg(F.sum("f").alias("f")), "words")
    return kept.filter("id IS NOT NULL").join(kept.groupBy("lang").agg(F.sum("f").alias("n")), "lang")


def pair_counts(docs: DataFrame, words: DataFrame, least: int = LEAST) -> DataFrame:
    """``w1``, ``w2``, ``f`` of the frequent pairs."""
    known = docs.sparkSession.sparkContext.broadcast(bitmap(words, F.col("id"), words.count()).words)

    def rows(lang: str, lot: Lot) -> list:
        a, b, n = lot.pairs(Bits(known.value))
        return [_signed(a), _signed(b), pa.array(n.astype(np.int64))]

    return materialize(_over(docs, "w1 long, w2 long, f long", rows).groupBy("w1", "w2").agg(F.sum("f").alias("f")).filter(F.col("f") >= least), "pairs")


def grow(cols: list[np.ndarray], n: np.ndarray, whole: np.ndarray, least: int) -> Iterator[tuple[list[int], int]]:
    """Phrases of three words and more in sorted pointers (0: no word), with their counts. A run at either end of the rows
    may go on outside, and a prefix shorter than ``whole`` in other tasks: their counts, parts only, are always given."""
    last = len(n)

    def extend(lo: int, hi: int, prefix: list[int]) -> Iterator[tuple[list[int], int]]:
        depth = len(prefix)
        if depth == LONGEST:
            return
        col = cols[depth][lo:hi]
        starts = np.concatenate(([0], np.flatnonzero(col[1:] != col[:-1]) + 1))
        sums, ends = np.add.reduceat(n[lo:hi], starts), np.append(starts[1:], hi - lo)
        part = (starts + lo == 0) | (ends + lo == last) | (whole[lo + starts] > depth + 1)
        for k in np.flatnonzero((col[starts] != 0) & (part | (sums >= least))).tolist():
            longer = [*prefix, int(col[starts[k]])]
            if depth >= 2:
                yield longer, int(sums[k])
            yield from extend(lo + int(starts[k]), lo + int(ends[k]), longer)

    yield from extend(0, last, [])


def long_counts(docs: DataFrame, pairs: DataFrame, least: int = LEAST, hot: int = HOT) -> DataFrame:
    """``w1`` to ``w5`` (null after the end) and ``f`` of the frequent phrases of three words and more."""
    stats = pairs.agg(F.count(F.lit(1)), F.sum("f")).first()
    context = docs.sparkSession.sparkContext
    known = context.broadcast(bitmap(pairs, _pair_column("w1", "w2"), stats[0]).words)
    heavy = pairs.filter(F.col("f") * hot > (stats[1] or 0)).select("w1", "w2").collect()  # fewer than ``hot`` rows
    heavy = np.sort(pair_hash(np.array([r[0] for r in heavy], np.int64).view(np.uint64), np.array([r[1] for r in heavy], np.int64).view(np.uint64)))

    def rows(lang: str, lot: Lot) -> list:
        code, n = lot.pointers(Bits(known.value))
        ids = np.append(lot.ids, np.uint64(0))[code]
        whole, split = np.full(len(n), 2, np.int32), np.ones(len(n), bool)
        for k in range(LONGEST - 2):
            split &= np.isin(pair_hash(ids[k], ids[k + 1]), heavy) & (code[k + 1] >= 0)
            whole += split
        return [*(_signed(np.ascontiguousarray(w)) for w in ids), pa.array(n.astype(np.int64)), pa.array(whole)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cols = [batch.column(k).to_numpy() for k in range(LONGEST)]
            found = list(grow(cols, batch.column(LONGEST).to_numpy(), batch.column(LONGEST + 1).to_numpy(), least)) if batch.num_rows else []
            if found:
                yield pa.RecordBatch.from_arrays([*(pa.array([p[k] if k < len(p) else None for p, _ in found], pa.int64()) for k in range(LONGEST)), pa.array([c for _, c in found], pa.int64())], [*_W, "f"])

    longs = ", ".join(f"{w} long" for w in _W)
    pointers = _over(docs, f"{longs}, n long, whole int", rows)
    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = pointers.repartition(n, "w1", "w2", *(F.when(F.col("whole") > k, F.col(_W[k])) for k in range(2, LONGEST)))
    grown = dealt.sortWithinPartitions(*_W).mapInArrow(run, f"{longs}, f long")
    return grown.groupBy(*_W).agg(F.sum("f").alias("f")).filter(F.col("f") >= least)


def phrases(docs: DataFrame, least: int = LEAST, hot: int = HOT) -> tuple[DataFrame, DataFrame]:
    """(``words``, array of hashes, and ``f`` of every frequent phrase of two words and more; the frequent words)."""
    words = materialize(word_counts(docs, least), "frequent-words")
    pairs = pair_counts(docs, words, least)
    both = pairs.unionByName(long_counts(docs, pairs, least, hot), allowMissingColumns=True)
    return materialize(both.select(F.array_compact(F.array(*_W)).alias("words"), "f"), "phrases"), words


def scored(found: DataFrame, words: DataFrame) -> DataFrame:
    """``words``, ``a``, and the weakest cut's ``score``, ``k``, ``l``, ``r``, with ``lang`` and ``n``. Counts are looked up
    by joins over phrases, which are few beside the corpus; Spark splits a part that is met very often."""
    known = found.unionByName(words.select(F.array("id").alias("words"), "f"))
    of = lambda name: known.select(F.col("words").alias(f"{name}_words"), F.col("f").alias(name))
    first = words.select(F.col("id").alias("w1"), "lang", "n")
    cuts = found.select("words", F.col("f").alias("a"), F.explode(F.sequence(F.lit(1), F.size("words") - 1)).alias("k"))
    cuts = cuts.select("*", F.slice("words", F.lit(1), F.col("k")).alias("l_words"), F.slice("words", F.col("k") + 1, F.size("words")).alias("r_words"), F.col("words")[0].alias("w1"))
    cuts = cuts.join(of("l"), "l_words").join(of("r"), "r_words").join(first, "w1")
    number = lambda c: c.cast("decimal(19,0)")
    cuts = cuts.withColumn("top", number(F.col("a") * 1000) * number(F.col("n"))).withColumn("under", number(F.col("l")) * number(F.col("r")))
    weakest = F.min(F.struct(F.expr("top div under").alias("score"), "k", "l", "r")).alias("cut")
    return cuts.groupBy("words", "a", "lang", "n").agg(weakest).select("words", "a", "lang", "n", "cut.*")


def shown(found: DataFrame, share: int = SHARE) -> DataFrame:
    """The phrases without those that hide in a longer one: one that holds them, with ``share`` hundredths of their count."""
    n = F.size("words")
    inner = F.explode(F.array(F.slice("words", F.lit(1), n - 1), F.slice("words", F.lit(2), n - 1)))
    longer = found.filter(n > 2).select(inner.alias("words"), F.col("f").alias("up")).groupBy("words").agg(F.max("up").alias("up"))
    return found.join(longer, "words", "left").filter(F.col("up").isNull() | (100 * F.col("up") < share * F.col("f"))).select(found.columns)


def collocations(docs: DataFrame, least: int = LEAST, top: int = TOP, share: int = SHARE, hot: int = HOT) -> DataFrame:
    """Each language's first ``top`` phrases by score, count and text."""
    found, words = phrases(docs, least, hot)
    ranked = scored(found, words).join(shown(found, share).select("words"), "words", "left_semi")
    by = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"))
    best = materialize(ranked.withColumn("place", F.rank().over(by)).filter(F.col("place") <= top), "best")  # with all ties of the last
    spelled = best.select("words", F.posexplode("words").alias("i", "id")).join(words.select("id", "word"), "id").groupBy("words").agg(F.array_sort(F.collect_list(F.struct("i", "word"))).alias("s"))
    texts = best.join(spelled.select("words", F.array_join(F.col("s.word"), " ").alias("phrase")), "words")
    place = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase"))
    return texts.select("lang", place.cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score").filter(F.col("rank") <= top)


def op12_phrase_mining(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(table(spark, sf_dir, "documents"))


OP12_SQL = r"""
WITH t AS (SELECT coalesce(lang, 'und') AS lang, row_number() OVER () AS doc,
                  string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]') AS ps FROM documents),
p AS (SELECT lang, list_filter(string_split_regex(unnest(ps), '[\x20\x09]+'), lambda x: x <> '') AS w FROM t),
g AS (SELECT lang, m, w[i : i + m - 1] AS words FROM (SELECT lang, w, m, unnest(range(1, len(w) - m + 2)) AS i FROM p, range(1, 6) r(m) WHERE len(w) >= m)),
f AS (SELECT lang, m, words, count(*) AS f FROM g GROUP BY ALL HAVING count(*) >= 100),
total AS (SELECT lang, sum(len(w))::BIGINT AS n FROM p GROUP BY lang),
cut AS (SELECT c.lang, c.words, c.f AS a, k, l.f AS l, r.f AS r, n, ((1000::HUGEINT * c.f * n) // (l.f::HUGEINT * r.f))::BIGINT AS score
        FROM f c, range(1, 5) q(k), f l, f r, total t WHERE c.m > k AND l.lang = c.lang AND r.lang = c.lang AND t.lang = c.lang AND l.words = c.words[1:k] AND r.words = c.words[k + 1:]),
weak AS (SELECT * FROM cut QUALIFY row_number() OVER (PARTITION BY lang, words ORDER BY score, k) = 1),
hidden AS (SELECT DISTINCT c.lang, c.words FROM f c JOIN f x ON x.lang = c.lang AND x.m > c.m AND 100 * x.f >= 100 * c.f
           WHERE c.m > 1 AND list_contains([x.words[i : i + c.m - 1] FOR i IN range(1, x.m - c.m + 2)], c.words)),
s AS (SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, array_to_string(words, ' ')) AS rank, array_to_string(words, ' ') AS phrase, a, l, r, n, score
      FROM weak w WHERE NOT EXISTS (SELECT 1 FROM hidden h WHERE h.lang = w.lang AND h.words = w.words))
SELECT * FROM s WHERE rank <= 2000
"""
