"""All queries outside the training-data package, by name."""

from __future__ import annotations

from tessella.plans import alignment, authorship, evaluation, forensics, fusion, language, learning, passes, search, similarity, spans, statistics, store, streams, structure

MODULES = (similarity, fusion, evaluation, statistics, forensics, authorship, language, spans, store, streams, structure, alignment, search, learning, passes)


def queries() -> dict:
    return {name: fn for m in MODULES for name, (fn, _) in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for m in MODULES for name, (_, sql) in m.QUERIES.items() if sql}
