"""Writes to a keyed table as plans: what a merge, a get-or-create, an idempotent insert or a delete leaves."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def latest(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The row of each key that is last by ``order``; summed before the shuffle, not ranked."""
    others = [c for c in rows.columns if c not in keys]
    last = F.max_by(F.struct(*others), F.struct(*order)).alias("__last")
    return rows.groupBy(*keys).agg(last).select(*keys, *[F.col(f"__last.`{c}`").alias(c) for c in others])


def folded(updates: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """What a run of updates leaves of each key: of every column the value of the last update that sets it (is not null
    there). Updates that are equal in ``order`` fold by value, the greatest last. Summed before the shuffle."""
    others = [c for c in updates.columns if c not in (*keys, *order)]
    last = [F.max(F.when(F.col(c).isNotNull(), F.struct(*order, F.col(c).alias("__v")))).alias(c) for c in others]
    return updates.groupBy(*keys).agg(*last).select(*keys, *[F.col(f"`{c}`.__v").alias(c) for c in others])


def merged(table: DataFrame, updates: DataFrame, keys: list[str]) -> DataFrame:
    """The table after the updates, one for each key at most: a value that is not null replaces the old one, and a new key
    becomes a row. The columns are the table's."""
    mark = lambda d, s: d.select(*keys, *[F.col(c).alias(f"__{s}_{c}") for c in d.columns if c not in keys])
    both = mark(table, "old").join(mark(updates, "new"), keys, "full_outer")
    new = lambda c: F.coalesce(f"__new_{c}", f"__old_{c}") if c in updates.columns else F.col(f"__old_{c}")
    return both.select(*[F.col(c) if c in keys else new(c).alias(c) for c in table.columns])


def with_defaults(wanted: DataFrame, table: DataFrame, keys: list[str], defaults: dict) -> DataFrame:
    """A row for each wanted key: the table's, or one of defaults (get or create)."""
    out = wanted.select(*keys).distinct().join(table, keys, "left")
    return out.select(*keys, *[F.coalesce(c, F.lit(v)).alias(c) for c, v in defaults.items()])


def accepted(requests: DataFrame, key: str, order: list[str], seen: DataFrame | None = None) -> DataFrame:
    """The requests with ``accepted``: whether it is the first of its key, and the key is not among those seen before."""
    first = requests.groupBy(key).agg(F.min(F.struct(*order)).alias("__first"))
    marked = requests.join(first, key)
    ok = F.struct(*order) == F.col("__first")
    if seen is not None:
        marked, ok = marked.join(seen.select(key).distinct().withColumn("__seen", F.lit(True)), key, "left"), ok & F.col("__seen").isNull()
    return marked.withColumn("accepted", ok).drop("__first", "__seen")


def matching(rows: DataFrame, **wanted) -> DataFrame:
    """The rows that have all the wanted values; one that is None is not asked for."""
    asked: list[Column] = [F.col(c) == v for c, v in wanted.items() if v is not None]
    return rows.filter(reduce(lambda a, b: a & b, asked)) if asked else rows
