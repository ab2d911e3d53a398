"""Operator 3, approximate nearest neighbours: multi-index hashing over learned, rotated binary codes.

Codes: unit vectors are projected on their principal axes and rotated so that signs lose least (alternating between the
signs and the best rotation), learned on at most ``SAMPLE`` vectors, those with the least hash; vectors of fewer than 64
dimensions have several such rotations beside each other. A code of 64 bits is split into substrings, each indexed; a
substring has about log2 n bits, so that a value has few vectors. Two codes within Hamming radius r agree in some
substring up to r / parts bits (pigeonhole), so probing the values that near retrieves every code within r. The radius is the least one that holds
``TARGET`` of the true neighbours of a bounded sample. Candidates within r are ranked by their cosine in double precision
on the original vectors. Every row is indexed; only the codes and the radius come from a sample.

The index is dealt out by substring and the top bits of its value, and large lists by a hash of the vector's id, so that
a task holds at most about ``LIST`` vectors of one list; a query goes to the lists that it probes. The rows of a list are
sorted, items first, and its queries stream past them, so that many queries of one list need no memory; a list of more
vectors is probed part by part, for which its queries are copied once for each part. A query that finds too few within the
radius is searched again with a radius that holds every code.

Defined results: vectors that are null, zero, of another length than most of the sample, or that hold a null or a
non-finite component take no part. Ties go to the smaller vec_id. Rows that share a query's vec_id are never its
neighbours; other repeated rows count once for each distinct vec_id. An empty table gives an empty result. Other columns
are ignored.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessella.llm.common import least_hashed, materialize, sliced

BITS, TOP = 64, 3
SAMPLE, SAMPLE_QUERIES, TARGET = 8192, 256, 0.97
LIST = 8192
NEIGHBOURS = 5


def usable(v) -> np.ndarray | None:
    """The vector in double precision, or None if it takes no part."""
    if v is None or any(x is None for x in v):
        return None
    a = np.array(v, np.float64)
    return a if len(a) and np.isfinite(a).all() and a.any() else None


class Coder:
    def __init__(self, sample: list[np.ndarray], seed: int = 3, rounds: int = 30):
        self.dim = Counter(len(v) for v in sample).most_common(1)[0][0] if sample else 0
        x = np.stack([v / np.linalg.norm(v) for v in sample if len(v) == self.dim]) if sample else np.zeros((0, 1))
        rng = np.random.default_rng(seed)
        principal = np.linalg.eigh(x.T @ x)[1][:, ::-1]
        blocks, bits = [], 0
        while bits < BITS:
            axes = principal[:, : BITS - bits]
            turn = np.linalg.qr(rng.standard_normal((axes.shape[1],) * 2))[0]
            y = x @ axes
            for _ in range(rounds if len(x) else 0):
                u, _, v = np.linalg.svd(np.sign(y @ turn).T @ y)
                turn = (u @ v).T
            blocks.append(axes @ turn)
            bits += axes.shape[1]
        self.axes = np.concatenate(blocks, axis=1)
        self.radius = self._radius(x) if len(x) else BITS

    def codes(self, x: np.ndarray) -> np.ndarray:
        return np.packbits(x @ self.axes > 0, axis=1, bitorder="little").view("<u8")[:, 0]

    def _radius(self, x: np.ndarray) -> int:
        codes, far = self.codes(x), np.zeros(BITS + 1)
        for i in range(min(SAMPLE_QUERIES, len(x))):
            s = x @ x[i]
            s[i] = -2
            near = np.argpartition(-s, min(NEIGHBOURS, len(x) - 1))[:NEIGHBOURS]
            np.add.at(far, np.bitwise_count(codes[near[near != i]] ^ codes[i]), 1)
        return int(np.searchsorted(np.cumsum(far), TARGET * far.sum())) if far.any() else BITS


def coder_for(vectors: DataFrame, id_col: str, vector_col: str) -> Coder:
    given = vectors.select(F.col(id_col).alias("i"), F.col(vector_col).cast("array<double>").alias("v")).filter("v IS NOT NULL AND i IS NOT NULL")
    rows = least_hashed(given, "i", SAMPLE, 3).withColumn("x", F.hash("v")).orderBy("__h", "i", "x").limit(SAMPLE).collect()
    return Coder([v for r in rows if (v := usable(r["v"])) is not None])


def parts_for(n: int) -> int:
    """Substrings of a code for n vectors: a power of two, so that one has about log2 n bits."""
    return int(min(16, max(2, 2 ** round(np.log2(BITS / np.log2(max(n, 4)))))))


def pack(v: np.ndarray) -> bytes:
    """Components as bytes: single precision where that is exact, else double; the last byte tells which."""
    small = v.astype("<f4")
    return small.tobytes() + b"\x04" if (small == v).all() else v.astype("<f8").tobytes() + b"\x08"


def unpack(data: bytes) -> np.ndarray:
    return np.frombuffer(data[:-1], "<f4" if data[-1] == 4 else "<f8").astype(np.float64)


def index(vectors: DataFrame, coder: Coder, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """vec_id, code, vector (packed) of every vector that takes part."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = [(i, v) for i, v in zip(batch.column(0).to_pylist(), map(usable, batch.column(1).to_pylist()), strict=True) if i is not None and v is not None and len(v) == coder.dim]
            codes = coder.codes(np.stack([v for _, v in got])).view(np.int64) if got else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays([pa.array([i for i, _ in got], pa.int64()), pa.array(codes), pa.array([pack(v) for _, v in got], pa.binary())], ["vec_id", "code", "vector"])

    return vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("v")).mapInArrow(run, "vec_id long, code long, vector binary")


def _vectors(rows: pd.DataFrame) -> np.ndarray:
    return np.stack([unpack(v) for v in rows["vector"]])


class _List:
    """The items of one list, ready to be probed."""

    def __init__(self, items: pd.DataFrame, part: int, radius: int, k: int, parts: int):
        self.part, self.radius, self.k, self.near, self.width = part, radius, k, radius // parts, BITS // parts
        self.mask = np.uint64(2**self.width - 1)
        items = items.sort_values("vec_id", ignore_index=True)
        self.code, self.ids, self.x = items["code"].to_numpy().view(np.uint64), items["vec_id"].to_numpy(), _vectors(items)
        value = (self.code >> np.uint64(part * self.width)) & self.mask
        self.by = np.argsort(value, kind="stable")
        self.held, self.sizes = np.unique(value, return_counts=True)
        self.norms = np.sqrt((self.x * self.x).sum(1))
        self.earlier = [np.uint64(p * self.width) for p in range(part)]

    def probe(self, queries: pd.DataFrame) -> list[tuple]:
        """(query_id, vec_id, score) of the k nearest of each query: probes by value, the Hamming check, then cosines."""
        out: list[tuple] = []
        for qid, qcode, q in zip(queries["vec_id"], queries["code"].to_numpy().view(np.uint64), _vectors(queries), strict=True):
            own = (qcode >> np.uint64(self.part * self.width)) & self.mask
            at = self.by[np.repeat(np.bitwise_count(self.held ^ own) <= self.near, self.sizes)]
            apart = self.code[at] ^ qcode
            good = (np.bitwise_count(apart) <= self.radius) & (self.ids[at] != qid)
            for p in self.earlier:  # a pair belongs to the first substring that finds it
                good &= np.bitwise_count((apart >> p) & self.mask) > self.near
            at = np.sort(at[good])
            if len(at):
                score = (self.x[at] * q).sum(1) / (self.norms[at] * np.sqrt((q * q).sum()))
                best = np.lexsort((self.ids[at], -score))[: self.k]
                out += [(qid, self.ids[at[b]], score[b]) for b in best]
        return out


KEYS = ["part", "top", "salt"]


def probed(batches: Iterator[pa.RecordBatch], radius: int, k: int, parts: int) -> Iterator[pa.RecordBatch]:
    """Rows by list, its items (at most about LIST) before its queries, which stream past them: however many queries probe a
    list, a task holds its items and one batch."""
    key, items, ready = None, [], None
    for batch in sliced(batches):
        rows, found = batch.to_pandas(), []
        for (*own, asks), some in rows.groupby([*KEYS, "asks"], sort=True):
            if own != key:
                key, items, ready = own, [], None
            if not asks:
                items.append(some)
            elif items or ready:
                if ready is None:
                    ready, items = _List(pd.concat(items), int(key[0]), radius, k, parts), []
                found += ready.probe(some)
        if found:
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*found)], ["query_id", "vec_id", "score"])


def search(items: DataFrame, queries: DataFrame, radius: int, k: int = NEIGHBOURS, parts: int | None = None) -> DataFrame:
    """query_id, vec_id, score: of each query the k nearest items within the radius, ties to the smaller id."""
    parts = parts or parts_for(items.count())
    width, near, groups = BITS // parts, radius // parts, 1 << TOP
    value = lambda p: F.shiftrightunsigned("code", p * width).bitwiseAND(2**width - 1)
    top = lambda p: F.shiftright(value(p), width - TOP).cast("int")
    lists = F.explode(F.array(*(F.struct(F.lit(p).alias("part"), top(p).alias("top")) for p in range(parts))))
    listed = items.select("*", lists.alias("l")).select("vec_id", "code", "vector", "l.part", "l.top")
    # at most parts * groups rows
    sizes = {(r["part"], r["top"]): -(-r["n"] // LIST) for r in listed.groupBy("part", "top").agg(F.count(F.lit(1)).alias("n")).collect()}
    if not sizes:
        return items.sparkSession.createDataFrame([], "query_id long, vec_id long, score double")
    salts = F.create_map(*[F.lit(x) for (p, t), n in sizes.items() for x in (p * groups + t, n)])
    salts_of = lambda: F.coalesce(salts[F.col("part") * groups + F.col("top")], F.lit(0))
    dealt = listed.withColumn("salt", F.pmod(F.xxhash64("vec_id"), salts_of()).cast("int"))
    # a list is probed if its top bits alone are not too far
    tops = F.array(*(F.struct(F.lit(p).alias("part"), F.lit(t).alias("top"), (F.bit_count(top(p).bitwiseXOR(t)) <= near).alias("probed")) for p in range(parts) for t in range(groups)))
    own = [F.col(c).alias(c) for c in ("vec_id", "code", "vector")]  # new columns, even if queries are some of the items
    asked = queries.select(*own).select("vec_id", "code", "vector", F.explode(F.filter(tops, lambda x: x["probed"])).alias("l")).select("vec_id", "code", "vector", "l.part", "l.top")
    asked = asked.filter(salts_of() > 0).withColumn("salt", F.explode(F.sequence(F.lit(0), salts_of() - 1)))
    columns = [*KEYS, "asks", "vec_id", "code", "vector"]
    both = dealt.withColumn("asks", F.lit(False)).select(columns).unionByName(asked.withColumn("asks", F.lit(True)).select(columns))
    found = both.repartition(*KEYS).sortWithinPartitions(*KEYS, "asks").mapInArrow(lambda b: probed(b, radius, k, parts), "query_id long, vec_id long, score double")
    return found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))


def nearest(items: DataFrame, queries: DataFrame, radius: int, k: int = NEIGHBOURS) -> DataFrame:
    """query_id, rank, vec_id, score."""
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    best = lambda found: found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    found = materialize(best(search(items, queries, radius, k)), "neighbours")
    full = found.groupBy("query_id").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= k)
    short = queries.join(full.select(F.col("query_id").alias("vec_id")), "vec_id", "left_anti")
    if radius < BITS and not short.isEmpty():
        again = best(search(items, short, BITS, k))
        found = found.join(full.select("query_id"), "query_id", "left_semi").unionByName(again)
    return found.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def op3_ann_mih(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    coder = coder_for(vectors, "vec_id", "embedding")
    items = materialize(index(vectors, coder), "codes")
    return nearest(items, items.filter("vec_id % 50 = 0").dropDuplicates(["vec_id"]), coder.radius)
