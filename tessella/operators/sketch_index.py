"""An index of sketches on disk that is added to, removed from and asked without being built anew.

Below a folder lie, by generation, ``sigs`` (id, sig, version) in shards of the id, ``bands`` (band, bucket, id, version) in
shards of the bucket, and ``gone`` (id, version) in shards of the id. A version is one call that writes; its rows count once
``commits`` has it, so a call that fails half-way leaves nothing that is read. The row of an id with the greatest version is
the one that stands, unless a later version took it out. ``compact`` writes the rows that stand as a new generation. There
is one writer at a time. A query reads the shards of its own buckets and candidates alone.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.operators import sketch
from tessella.session import written


class SketchIndex:
    def __init__(self, spark: SparkSession, root: str, id_type: str = "long", shards: int = 64):
        self.spark, self.root, self.id_type, self.shards = spark, root.rstrip("/"), id_type, shards

    def _state(self) -> tuple[int, list[int]]:
        """The generation and its versions: a row for each call since the last compaction."""
        try:
            rows = self.spark.read.schema("version long, generation long").parquet(f"{self.root}/commits").collect()
        except AnalysisException:  # nothing is committed yet
            return 0, []
        last = max((r["generation"] for r in rows), default=0)
        return last, sorted(r["version"] for r in rows if r["generation"] == last)

    def _commit(self, version: int, generation: int) -> None:
        self.spark.range(1).select(F.lit(version).cast("long").alias("version"), F.lit(generation).cast("long").alias("generation")).coalesce(1).write.mode("append").parquet(f"{self.root}/commits")

    def _append(self, rows: DataFrame, name: str, key: str, version: int, generation: int) -> None:
        rows = rows.withColumn("version", F.lit(version).cast("long")).withColumn("shard", F.pmod(F.xxhash64(key), F.lit(self.shards)).cast("int"))
        rows.repartition("shard").write.mode("append").partitionBy("shard").parquet(f"{self.root}/generation={generation}/{name}")

    def _read(self, name: str, columns: str, state: tuple[int, list[int]]) -> DataFrame:
        schema = f"{columns}, version long, shard int"
        try:
            rows = self.spark.read.schema(schema).parquet(f"{self.root}/generation={state[0]}/{name}")
        except AnalysisException:  # no such rows were ever written
            rows = self.spark.createDataFrame([], schema)
        return rows.filter(F.col("version").isin(state[1]))

    def _sigs(self, state) -> DataFrame:
        return self._read("sigs", f"id {self.id_type}, sig array<bigint>", state)

    def _gone(self, state) -> DataFrame:
        return self._read("gone", f"id {self.id_type}", state)

    def _next(self) -> tuple[int, int]:
        generation, versions = self._state()
        return generation, max(versions, default=0) + 1

    def add(self, docs: DataFrame) -> None:
        """(id, items): a document with an id that is there replaces it; one without items takes it out. Of rows that share
        an id in one call, the one with the least signature stands."""
        generation, version = self._next()
        sigs = written(sketch.minhash(docs).groupBy("id").agg(F.min("sig").alias("sig")), "signatures")
        full = sigs.filter(F.col("sig")[0] != sketch.EMPTY)
        self._append(full, "sigs", "id", version, generation)
        self._append(_bands(full), "bands", "bucket", version, generation)
        self._append(sigs.filter(F.col("sig")[0] == sketch.EMPTY).select("id"), "gone", "id", version, generation)
        self._commit(version, generation)

    def remove(self, ids: DataFrame) -> None:
        generation, version = self._next()
        self._append(ids.select(F.col("id").cast(self.id_type).alias("id")).distinct(), "gone", "id", version, generation)
        self._commit(version, generation)

    def standing(self, among: DataFrame | None = None) -> DataFrame:
        """(id, sig, version) of the rows that stand; ``among`` (id, shard): of these ids alone."""
        state = self._state()
        sigs, gone = self._sigs(state), self._gone(state)
        if among is not None:
            sigs, gone = (x.join(among, ["id", "shard"], "left_semi") for x in (sigs, gone))
        last = sigs.groupBy("id").agg(F.max_by("sig", "version").alias("sig"), F.max("version").alias("version"))
        out = gone.groupBy("id").agg(F.max("version").alias("out"))
        return last.join(out, "id", "left").filter(F.col("out").isNull() | (F.col("out") < F.col("version"))).select("id", "sig", "version")

    def query(self, docs: DataFrame, least: float = sketch.LEAST) -> DataFrame:
        """query_id, id, estimate of what shares a band with a query and agrees in ``least`` of the positions. Queries with
        one signature are asked once."""
        state = self._state()
        asked = written(sketch.minhash(docs.select("id", "items")).filter(F.col("sig")[0] != sketch.EMPTY), "asked")
        one = asked.groupBy("sig").agg(F.min("id").alias("id"))
        bands = written(_bands(one).withColumn("shard", F.pmod(F.xxhash64("bucket"), F.lit(self.shards)).cast("int")), "asked_bands")
        touched = [r[0] for r in bands.select("shard").distinct().collect()]  # at most as many as there are shards
        held = self._read("bands", f"band int, bucket long, id {self.id_type}", state).filter(F.col("shard").isin(touched))
        met = bands.select(F.col("id").alias("query_id"), "band", "bucket").join(held.select("band", "bucket", "id", "version"), ["band", "bucket"])
        met = written(met.select("query_id", "id", "version").distinct(), "met")
        places = met.select("id", F.pmod(F.xxhash64("id"), F.lit(self.shards)).cast("int").alias("shard")).distinct()
        found = met.join(self.standing(places), ["id", "version"]).join(one.select(F.col("id").alias("query_id"), F.col("sig").alias("own")), "query_id")
        equal = F.aggregate(F.zip_with("sig", "own", lambda p, q: (p == q).cast("int")), F.lit(0), lambda s, v: s + v) / sketch.PERMUTATIONS
        scored = found.select("own", "id", equal.alias("estimate")).filter(F.col("estimate") >= least)
        return asked.select(F.col("id").alias("query_id"), F.col("sig").alias("own")).join(scored, "own").select("query_id", "id", "estimate")

    def compact(self) -> None:
        """The rows that stand become a generation of their own; readers of the old one are not disturbed."""
        generation = self._state()[0] + 1
        rows = written(self.standing().select("id", "sig"), "standing")
        self._append(rows, "sigs", "id", 1, generation)
        self._append(_bands(rows), "bands", "bucket", 1, generation)
        self._commit(1, generation)


def _bands(sigs: DataFrame) -> DataFrame:
    return sketch.banded(sigs.select("id", "sig", F.lit(1).alias("copies"))).select("band", "bucket", "id")
