"""Queries that have no SQL, against plain Python over the smallest tables."""

import difflib
import os
import re
from bisect import bisect_left
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessella.functions import tails
from tessella.operators import structure as st
from tessella.plans import evaluation, similarity, statistics, streams
from tessella.plans import structure as plans

DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")

pytestmark = pytest.mark.skipif(not os.path.isdir(DIR), reason="no test tables")


@pytest.fixture(scope="module")
def pairs(spark):
    return [(r["id_a"], r["id_b"]) for r in similarity.candidates(spark, DIR).collect()]


@pytest.fixture(scope="module")
def tokens(spark):
    return {r["doc_id"]: re.findall("[a-z0-9]+", (r["text"] or "").lower()) for r in spark.read.parquet(f"{DIR}/documents.parquet").collect()}


def test_rate_limited(spark):
    events = sorted((r["user_id"], r["ts"], r["event_id"]) for r in spark.read.parquet(f"{DIR}/events.parquet").collect())
    log, want = {}, {}
    for user, ts, i in events:
        taken = log.setdefault(user, [])
        ok = all(sum((ts - t).total_seconds() < s for t in taken) < n for s, n in ((900, 1), (3600, 3), (86400, 10)))
        want[i] = ok
        if ok:
            taken.append(ts)
    assert {r["id"]: r["accepted"] for r in streams.rate_limited(spark, DIR).collect()} == want
    assert set(want.values()) == {True, False}


def test_bootstrap_accuracy(spark):
    """The same hashes, with weights, sums and percentiles made here."""
    rows = evaluation.records(spark, DIR).select("engine", "score", "label", *[F.xxhash64("doc_id", F.lit(r)).alias(f"r{r}") for r in range(1, 201)]).collect()
    cuts = (0.36788, 0.73576, 0.91970, 0.98101, 0.99634, 0.99941)
    got = {r["engine"]: (r["low"], r["mid"], r["high"]) for r in evaluation.bootstrap_accuracy(spark, DIR).collect()}
    for engine in evaluation.ENGINES:
        mine = [r for r in rows if r["engine"] == engine]
        right = np.array([(r["score"] >= 500) == (r["label"] == 1) for r in mine], float)
        w = np.array([[sum((r[f"r{k}"] % 1_000_003) / 1_000_003 >= c for c in cuts) for k in range(1, 201)] for r in mine], float)
        each = (right[:, None] * w).sum(0) / w.sum(0)
        assert np.allclose(got[engine], np.percentile(each, [2.5, 50, 97.5]))


def greedy(a, b, least=3):
    """Tiles by looking at every pair of places for the longest unmarked run, again and again."""
    used_a, used_b, covered = set(), set(), 0
    while True:
        best, found = least - 1, None
        for i in range(len(a)):
            for j in range(len(b)):
                n = 0
                while i + n < len(a) and j + n < len(b) and a[i + n] == b[j + n] and i + n not in used_a and j + n not in used_b:
                    n += 1
                if n > best:
                    best, found = n, (i, j)
        if not found:
            return covered
        used_a |= set(range(found[0], found[0] + best))
        used_b |= set(range(found[1], found[1] + best))
        covered += best


def test_alignments(spark, pairs, tokens):
    tiled = {(r["id_a"], r["id_b"]): r for r in plans.string_tiling(spark, DIR).collect()}
    blocks = {(r["id_a"], r["id_b"]): r for r in plans.matching_segments(spark, DIR).collect()}
    assert set(tiled) == set(blocks) == set(pairs) and pairs
    small = [p for p in pairs if len(tokens[p[0]]) * len(tokens[p[1]]) < 10_000]
    for a, b in pairs:
        x, y = tokens[a], tokens[b]
        size = sum(m.size for m in difflib.SequenceMatcher(None, x, y, autojunk=False).get_matching_blocks() if m.size >= 3)
        assert blocks[a, b]["covered"] == size and abs(blocks[a, b]["score"] - 2 * size / (len(x) + len(y))) < 1e-12
        assert blocks[a, b]["covered"] <= min(len(x), len(y)) and tiled[a, b]["covered"] <= min(len(x), len(y))
    for a, b in small[:8]:
        assert tiled[a, b]["covered"] == greedy(tokens[a], tokens[b])


def test_structure_scores(spark, pairs):
    ids = {i for p in pairs for i in p}
    code = {r["doc_id"]: r["c"] for r in spark.read.parquet(f"{DIR}/documents.parquet").filter(F.col("doc_id").isin(*ids)).select("doc_id", plans.program(F.col("text")).alias("c")).collect()}
    for query, fn in ((plans.ast_subtree_similarity, st.subtree_hashes), (plans.control_flow_similarity, st.flow_edges), (plans.data_flow_similarity, st.data_edges)):
        got = {(r["id_a"], r["id_b"]): r["score"] for r in query(spark, DIR).collect()}
        assert set(got) == set(pairs)
        for a, b in pairs:
            x, y = Counter(fn(code[a])), Counter(fn(code[b]))
            both, whole = sum((x & y).values()), sum((x | y).values())
            assert abs(got[a, b] - (both / whole if whole else 1.0)) < 1e-12


def test_exact_intervals_and_isotonic_order(spark):
    rows = statistics.clopper_pearson(spark, DIR).collect()
    right = Counter(), Counter()
    for r in evaluation.records(spark, DIR).collect():
        right[0][r["engine"], r["lang"]] += 1
        right[1][r["engine"], r["lang"]] += (r["score"] >= 500) == (r["label"] == 1)
    assert {(r["engine"], r["lang"]): (r["n"], r["k"]) for r in rows} == {k: (n, right[1][k]) for k, n in right[0].items()}
    for r in rows:
        assert (r["low"], r["high"]) == tails.clopper_pearson(r["k"], r["n"]) and r["low"] <= r["k"] / r["n"] <= r["high"]
    for engine in evaluation.ENGINES:
        fit = sorted((r["score"], r["calibrated"]) for r in statistics.isotonic(spark, DIR).collect() if r["engine"] == engine)
        values = [v for _, v in fit]
        assert values == sorted(values) and bisect_left(values, 0) == 0


def test_perplexity_model_is_joined_to_distinct_pairs(spark, tmp_path, monkeypatch):
    """A hundred equal texts cost what one does in the model's tables."""
    from tessella.plans import language

    rows = [(i, "one two three one two") for i in range(100)] + [(100, None), (101, "two one")]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(0, 1), (0, 1), (101, 0)], "doc_id long, quality int").write.parquet(f"{tmp_path}/labels.parquet")
    made = {}

    def written(df, label):
        made[label] = language_written(df, label)
        return made[label]

    language_written = language.written
    monkeypatch.setattr(language, "written", written)
    got = {r["doc_id"]: r["bits"] for r in language.corpus_perplexity(spark, str(tmp_path)).collect()}
    assert len(got) == 101 and 100 not in got and len({got[i] for i in range(100)}) == 1
    assert made["word_pairs"].count() == 9  # distinct ones, not those of each document
