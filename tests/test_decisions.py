"""Decisions and tails against plain Python."""

import itertools
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessella.functions import decisions as D
from tessella.functions import tails
from tessella.plans import statistics

GRID = [dict(zip(("ngram", "fingerprint", "embedding", "stylometry"), v)) for v in itertools.product((0.2, 0.45, 0.55, 0.65, 0.8, 0.96), repeat=4)]


@pytest.fixture(scope="module")
def grid(spark):
    return spark.createDataFrame([(i, *g.values()) for i, g in enumerate(GRID)], "i int, ngram double, fingerprint double, embedding double, stylometry double")


def scores():
    return {k: F.col(k) for k in GRID[0]}


def test_policy_follows_its_rules_in_order(grid):
    def plain(g):
        s, x, m, y = g["ngram"], max(g["fingerprint"], g["ngram"]), g["embedding"], g["stylometry"]
        if s < 0.6:
            return "CLEAN"
        if s >= 0.9 and (x >= 0.5 or m >= 0.5):
            return "TRUE"
        if m >= 0.95 or s >= 0.75 and x >= 0.5 or y >= 0.7:
            return "PROBABLE"
        return "REVIEW"

    got = {r["i"]: r["v"] for r in grid.select("i", D.policy(D.evidence(scores())).alias("v")).collect()}
    assert got == {i: plain(g) for i, g in enumerate(GRID)}
    assert len(set(got.values())) == 4


def test_hierarchy_puts_identity_and_structure_first(grid):
    verdict, sure = D.hierarchy(scores(), F.col("fingerprint") > 0.95)
    for r in grid.select("*", verdict.alias("v"), sure.alias("c")).collect():
        built = r["ngram"]
        if r["fingerprint"] > 0.95:
            assert (r["v"], r["c"]) == ("TRUE", 0.99)
        elif built >= 0.9:
            assert (r["v"], r["c"]) == ("TRUE", 0.95)
        elif r["embedding"] >= 0.95:
            assert (r["v"], r["c"]) == ("PROBABLE", 0.85)
        elif built >= 0.75:
            assert (r["v"], r["c"]) == ("TRUE", 0.9)


def test_gate_rank_and_files(spark):
    one = spark.createDataFrame([(0.9, 0.2, 0.5)], "ngram double, embedding double, coverage double")
    s = {"ngram": F.col("ngram"), "embedding": F.col("embedding")}
    at = lambda c: one.select(c.alias("x")).first()[0]
    assert at(D.gated(s, F.lit(0.39))) and not at(D.gated(s, F.lit(0.4))) and at(D.gated({"embedding": F.lit(0.9)}, F.lit(1.0)))
    assert at(D.weighted_by_file(s, F.lit("CONFIG"))["embedding"]) == 0 and at(D.weighted_by_file(s, F.lit("other"))["embedding"]) == 0.1
    assert at(D.rank({"embedding": F.lit(0.9)})) == 0 and at(D.rank({"runtime_bug": F.lit(0.8)})) == 0.86
    assert at(D.rank({"fingerprint": F.lit(0.8), "ast": F.lit(0.7), "identifier_rename": F.lit(0.6), "starter_overlap": F.lit(0.9)})) == 0.82
    assert at(D.normalized(F.lit(80.0), "percent")) == 0.8 and at(D.normalized(F.lit(3.0), "min_max", 1, 5, inverse=True)) == 0.5
    assert at(D.policy_rules([{"when": {"ngram": "<= 0.9", "embedding": "< 0.1"}, "verdict": "a"}, {"when": {"or": [{"ngram": "> 0.95"}, {"embedding": ">= 0.2"}]}, "verdict": "b"}], s, "c")) == "b"
    with pytest.raises(ValueError):
        D.condition("about 3", F.lit(1))


def test_layers_raise_the_trusted_signal(spark):
    of = lambda domain: spark.range(1).select(D.layers(F.lit(0.0), {"ast_subtree": F.lit(0.7), "structure": F.lit(0.7), "token": F.lit(0.72), "embedding": F.lit(0.99)}, F.lit(0.4), domain)[0].alias("x")).first()[0]
    assert (of("code"), round(of("cs_code"), 9), round(of("math"), 9)) == (0.72, 0.84, 0.91)


def test_tails(spark):
    for z in (0.0, 0.5, 1.96, 4.0, -2.5):
        assert abs(spark.range(1).select(tails.normal_tail(F.lit(z)).alias("x")).first()[0] - math.erfc(abs(z) / math.sqrt(2)) / 2) < 1e-7
    low, high = tails.clopper_pearson(3, 20)
    assert abs(sum(math.comb(20, i) * low**i * (1 - low) ** (20 - i) for i in range(3, 21)) - 0.025) < 1e-9
    assert abs(sum(math.comb(20, i) * high**i * (1 - high) ** (20 - i) for i in range(4)) - 0.025) < 1e-9
    assert tails.clopper_pearson(0, 5)[0] == 0 and tails.clopper_pearson(5, 5)[1] == 1 and tails.clopper_pearson(0, 0) == (0, 1)


def test_platt_is_where_the_slope_is_zero(spark):
    """Against the gradient over all records, one by one."""
    sf = "/root/testdata/sf0.001"
    rows = statistics.records(spark, sf).collect()
    for f in statistics.platt(spark, sf).collect():
        mine = [(r["score"] / 1000, r["label"]) for r in rows if r["engine"] == f["engine"] and r["label"] is not None]
        q = np.array([1 / (1 + math.exp(-(f["a"] * s + f["b"]))) - y for s, y in mine])
        assert abs((q * [s for s, _ in mine]).sum() + 1e-3 * f["a"]) < 1e-6 and abs(q.sum() + 1e-3 * f["b"]) < 1e-6
