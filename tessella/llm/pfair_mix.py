"""Operator 4, mixing sources to target weights: Pfair scheduling.

A source's documents, in hash order, fill blocks of ``block_chars`` characters; a document belongs to the block in which
it begins. With the weight w = n / D of its source, block k (from 0) is released at slot floor(k / w) and due before
slot ceil((k + 1) / w). Every slot goes to the released block with the earliest deadline. The weights are whole numbers
that sum to the period D, so the schedule repeats after D slots: one period is simulated, and block k of a source stands
in slot (k div n) D + slot(k mod n). At every slot, each source is within less than one block of its weight's share.
Numbering the documents of a source and the final order are distributed prefix sums: no task holds a source's documents.

Any number of sources is mixed. The driver schedules at most ``HEADS`` sources, those with the greatest weights, and
``BINS`` bins, among which a hash deals all others: a bin has the weight of its sources, and they share its slots by the
same schedule with their exact weights in the bin, simulated in one task for each bin over the blocks that they have. So
the driver and what is broadcast are bounded by ``HEADS + BINS`` schedules of a period, and a task holds the weights of a
``BINS``-th of the sources. A source in a bin is within one block of its share of the bin's slots, which are within one of
theirs: within 1 + (its share of the bin) blocks in all.

D is the parameter, or else follows from the weights: a multiple of the common denominator of the given targets, which has
no rounding, or SLOTS slots for each source or bin (at most MANY_SLOTS in all). What rounding is left is under one slot of
D for a source or bin and, as each has a slot, what those below one slot of D get above their share, which the others give
in proportion.

All documents are kept. A source that runs out leaves its later slots empty.

Defined results: a null source is a source of its own, as is an empty one; a null or empty text counts as one character.
Repeated rows are separate documents. An empty table gives an empty result. Other columns stay as they are. A document longer than a block takes
the blocks that it covers; the next document begins after it. Sources without a given weight have the weight of their
share of characters, tempered; a weight is at least 1 / D, so that no source is lost.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator
from fractions import Fraction

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessella.llm.common import fresh, materialize

BLOCK_CHARS = 65_536
#: Least slots of a period that follows from the weights; slots for each source, and from how many in all they get fewer.
PERIOD, SLOTS, MANY_SLOTS = 1_000, 100, 200_000
#: Sources that are scheduled by themselves, and bins of all others.
HEADS, BINS = 1000, 1000
#: Tempered sizes as whole numbers: weights in a bin are exact.
GRAIN = 1 << 10
TEMPER = 0.7
#: Hash buckets of a source whose sizes are summed before documents are numbered within one.
BUCKETS = 4096


def whole_weights(sizes: dict[str, float | Fraction], period: int) -> dict[str, int]:
    """Weights as whole numbers, at least 1, that sum to the period: largest remainders; ties by name."""
    if not sizes:
        return {}
    if len(sizes) > period:
        raise ValueError(f"{len(sizes)} sources need a period of as many slots, not {period}")
    # sources of less than a slot have one; the others share what is left, until none of them has less
    rest, left, out = {s: Fraction(v) for s, v in sizes.items()}, period, {}
    while low := [s for s, v in rest.items() if v * left < total] if (total := sum(rest.values())) else list(rest):
        out |= dict.fromkeys(low, 1)
        left -= len(low)
        for s in low:
            del rest[s]
    exact = {s: v / total * left for s, v in rest.items()}
    out |= {s: math.floor(e) for s, e in exact.items()} if rest else dict.fromkeys(sizes, period // len(sizes))
    for s in sorted(rest or sizes, key=lambda s: (math.floor(exact[s]) - exact[s] if rest else 0, s))[: period - sum(out.values())]:
        out[s] += 1
    return {s: out[s] for s in sizes}


def period_for(sizes: dict[str, float | Fraction], least: int | None = None) -> int:
    """``least`` if it has a slot for each source; otherwise a period in which the weights are whole, or nearly."""
    if least and len(sizes) <= least:
        return least
    need = max(PERIOD, min(SLOTS * len(sizes), max(MANY_SLOTS, len(sizes))))
    total, common = sum(map(Fraction, sizes.values())), 1
    for v in sizes.values() if total else ():
        common = math.lcm(common, (Fraction(v) / total).denominator)
        if common > MANY_SLOTS:
            return need
    return common * -(-(PERIOD if len(sizes) <= PERIOD else need) // common)


def schedule(weights: dict[str, int]) -> list[tuple[str, int]]:
    """One period: for each slot a source and the number of its block. Earliest deadline first among released blocks."""
    period = sum(weights.values())
    waiting, ready, out = [(0, s, 0) for s in sorted(weights)], [], []
    for slot in range(period):
        while waiting and waiting[0][0] <= slot:
            _, s, k = heapq.heappop(waiting)
            heapq.heappush(ready, (-(-(k + 1) * period // weights[s]), s, k))
        due, s, k = heapq.heappop(ready)
        if due <= slot:
            raise AssertionError("a deadline was missed")
        out.append((s, k))
        if k + 1 < weights[s]:
            heapq.heappush(waiting, ((k + 1) * period // weights[s], s, k + 1))
    return out


def turns(weights: dict[str, int], blocks: dict[str, int]) -> Iterator[tuple[str, int, int]]:
    """(source, block, turn) of every block there is: as ``schedule``, with exact weights, over as many turns as it takes.
    A source that has no more blocks leaves its turns empty, as the others keep their release times."""
    total = sum(weights.values())
    waiting, ready, turn = [(0, s, 0) for s in sorted(blocks) if blocks[s]], [], 0
    while waiting or ready:
        if not ready:
            turn = max(turn, waiting[0][0])
        while waiting and waiting[0][0] <= turn:
            _, s, k = heapq.heappop(waiting)
            heapq.heappush(ready, (-(-(k + 1) * total // weights[s]), s, k))
        _, s, k = heapq.heappop(ready)
        yield s, k, turn
        if k + 1 < blocks[s]:
            heapq.heappush(waiting, ((k + 1) * total // weights[s], s, k + 1))
        turn += 1


def shared_turns(tail: DataFrame) -> DataFrame:
    """(__key, __bin, __want, __blocks) of the sources in bins to (__key, __block, __turn): the turn of the bin's that each
    block gets. One task for each bin; it holds the bin's weights and writes a row for each block."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        weights = dict(zip(rows["__key"], (int(w) for w in rows["__want"]), strict=True))
        found = turns(weights, dict(zip(rows["__key"], (int(b) for b in rows["__blocks"]), strict=True)))
        return pd.DataFrame(found, columns=["__key", "__block", "__turn"]).astype({"__key": object, "__block": "int64", "__turn": "int64"})

    return tail.groupBy("__bin").applyInPandas(run, "__key string, __block long, __turn long")


#: What a mix adds to the documents' columns.
ADDED = ("block", "slot", "place", "weight")


def mix(docs: DataFrame, targets: dict[str | None, float] | None = None, block_chars: int = BLOCK_CHARS, period: int | None = None, names: tuple[str, ...] = ADDED) -> DataFrame:
    """Adds block, slot, place and weight (slots of the period: the source's, or its bin's), under these ``names``; columns that are called so already, in
    any case, are replaced. The mixed order is slot, then place."""
    block, slot, place, weight = names
    own = [c for c in docs.columns if c.lower() not in {x.lower() for x in names}]
    name, (key, h, n, bucket, at_, row, before_, size, group, turn, slot_) = "source", fresh(docs, *(f"__mix_{x}" for x in ("key", "hash", "chars", "bucket", "at", "row", "before", "size", "group", "turn", "slot")))
    named = F.coalesce(F.concat(F.lit("s"), F.col(name)), F.lit("n"))
    sized = docs.select(*own, named.alias(key), F.xxhash64("doc_id", "text").alias(h), F.greatest(F.coalesce(F.length("text"), F.lit(0)), F.lit(1)).cast("long").alias(n)).withColumn(bucket, F.pmod(h, F.lit(BUCKETS)))

    # at most sources * BUCKETS rows, partly summed before they are shuffled
    sums = materialize(sized.groupBy(key, bucket).agg(F.sum(n).alias(size)), "mix_sizes")
    _, shares, tail, period = weighed(sums.groupBy(F.col(key).alias("__key")).agg(F.sum(size).alias("__size")), targets, block_chars, period)

    before = sums.select(key, bucket, (F.sum(size).over(Window.partitionBy(key).orderBy(bucket)) - F.col(size)).alias(before_))
    inside = Window.partitionBy(key, bucket).orderBy(h, "doc_id")
    at = F.sum(n).over(inside.rowsBetween(Window.unboundedPreceding, 0)) - F.col(n)
    numbered = sized.select(*own, key, bucket, at.alias(at_), F.row_number().over(inside).alias(row)).join(before, [key, bucket])
    blocks = numbered.select(*own, key, F.floor((F.col(at_) + F.col(before_)) / block_chars).cast("long").alias(block), (F.col(bucket) * (1 << 40) + F.col(row)).alias(place))

    if tail is None:
        grouped = blocks.withColumns({group: F.col(key), turn: F.col(block)})
    else:
        mine = shared_turns(tail).join(tail.select("__key", "__bin"), "__key").select(F.col("__key").alias(key), F.col("__block").alias(block), F.concat(F.lit("b"), "__bin").alias(group), F.col("__turn").alias(turn))
        found = blocks.join(mine, [key, block], "left")
        grouped = found.select(*blocks.columns, F.coalesce(group, key).alias(group), F.coalesce(turn, block).alias(turn))
    mixed = grouped.join(F.broadcast(shares.toDF(group, weight, slot_)), group)  # a row for each head and bin, MANY_SLOTS slots in all
    at = (F.floor(F.col(turn) / F.col(weight)) * period + F.get(slot_, (F.col(turn) % F.col(weight)).cast("int"))).cast("long")
    return mixed.select(*own, block, at.alias(slot), place, weight)


def weighed(totals: DataFrame, targets: dict[str | None, float] | None, block_chars: int, period: int | None) -> tuple[dict, DataFrame, DataFrame | None, int]:
    """Of (__key, __size) of every source: the wanted weights of heads and bins, their whole weights and slots as a table,
    the sources in bins (None if there are none), and the period."""
    spark = totals.sparkSession
    exact = {("n" if k is None else f"s{k}"): Fraction(str(v)) for k, v in (targets or {}).items()}
    if exact:
        given = spark.createDataFrame([(k, float(v)) for k, v in exact.items()], "__key string, __want double")
        want = totals.join(given, "__key", "left").select("__key", "__size", F.coalesce("__want", F.lit(0.0)).alias("__want"))
        if not want.agg(F.max("__want")).first()[0]:
            exact = {}
    if not exact:
        want = totals.withColumn("__want", F.pow(F.col("__size").cast("double"), F.lit(TEMPER)))
    want = materialize(want, "mix_wanted")
    heads = want.orderBy(F.desc("__want"), "__key").limit(HEADS).select("__key", "__want").collect()
    wanted = {r[0]: exact.get(r[0], Fraction(0)) if exact else r[1] for r in heads}
    tail = None
    if len(heads) == HEADS:
        chosen = spark.createDataFrame([(k,) for k in wanted], "__key string")
        scale = GRAIN / (max(r[1] for r in heads) if exact else 1)
        whole = F.greatest(F.round(F.col("__want") * F.lit(scale)), F.lit(1)).cast("long").alias("__want")
        n_blocks = (F.floor((F.col("__size") - 1) / block_chars) + 1).alias("__blocks")
        rest = want.join(F.broadcast(chosen), "__key", "left_anti").select("__key", F.pmod(F.xxhash64("__key"), F.lit(BINS)).cast("string").alias("__bin"), F.col("__want").alias("__own"), whole, n_blocks)
        bins = rest.groupBy("__bin").agg(F.sum("__own").alias("w")).collect()
        if bins:
            tail = materialize(rest.drop("__own"), "mix_tail")
            wanted |= {f"b{r[0]}": Fraction(str(r[1])) if exact else r[1] for r in bins}
    period = period_for(wanted, period)
    weights = whole_weights(wanted, period)
    slots: dict[str, list[int]] = {k: [] for k in weights}
    for at, (k, _) in enumerate(schedule(weights) if weights else []):
        slots[k].append(at)
    shares = spark.createDataFrame([(k, w, slots[k]) for k, w in weights.items()], "k string, w long, slots array<long>")
    return wanted, shares, tail, period


def ordered(mixed: DataFrame, names: tuple[str, ...] = ADDED) -> DataFrame:
    """The rows in the mixed order, range-partitioned: partition by partition and row by row."""
    return mixed.repartitionByRange(*names[1:3]).sortWithinPartitions(*names[1:3])


def op4_pfair_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return mix(docs).select("doc_id", "source", "block", "slot", "place", "weight")
