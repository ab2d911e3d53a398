import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tessella.functions import scores, signals, text
from tessella.operators import graph, metrics, setjoin, sketch, spans, structure, vectors


def test_classes_make_items_once(spark):
    made = spark.sparkContext.accumulator(0)

    def split(x):
        made.add(1)
        return [ord(c) for c in x or ""]

    docs = spark.createDataFrame([(1, "ab"), (2, "ba"), (3, ""), (4, "c"), (5, None)], "id long, x string")
    sets, members = setjoin.classes(docs.select("id", F.udf(split, "array<bigint>")("x").alias("items")))
    assert sorted((r["id"], r["n"], r["copies"]) for r in sets.collect()) == [(1, 2, 2), (4, 1, 1)]
    assert sorted((r["id"], r["class"]) for r in members.collect()) == [(1, 1), (2, 1), (4, 4)]
    assert made.value == 5


def test_jaccard_pairs_against_all_pairs(spark):
    rng = random.Random(1)
    rows = [(i, sorted({f"t{rng.randrange(30)}" for _ in range(rng.randrange(1, 14))})) for i in range(90)]
    sets = spark.createDataFrame(rows, "id long, items array<string>").withColumn("n", F.size("items"))
    want = {(a, b) for a, x in rows for b, y in rows if a < b and 2 * len(set(x) & set(y)) >= len(set(x) | set(y))}
    assert {(r["id_a"], r["id_b"]) for r in setjoin.jaccard_pairs(sets, 1, 2).collect()} == want
    assert setjoin.jaccard_pairs(sets.filter("id < 0"), 1, 2).count() == 0


def test_classes_keep_one_of_each_set(spark):
    rows = [(3, [5, 4]), (1, [4, 5, 4]), (2, []), (4, [6])]
    sets, members = setjoin.classes(spark.createDataFrame(rows, "id long, items array<long>"))
    assert {(r["id"], tuple(r["items"]), r["n"], r["copies"]) for r in sets.collect()} == {(1, (4, 5), 2, 2), (4, (6,), 1, 1)}
    assert {(r["id"], r["class"], r["copies"]) for r in members.collect()} == {(1, 1, 2), (3, 1, 2), (4, 4, 1)}


def test_multisets_number_their_copies(spark):
    df = spark.createDataFrame([(1, ["a", "a", "b"]), (2, ["a", "b", "b", "b"])], "id long, items array<string>")
    x = {r["id"]: set(r["items"]) for r in setjoin.multisets(df).collect()}
    assert (len(x[1]), len(x[2]), len(x[1] & x[2])) == (3, 4, 2)


def test_winnowing_picks_the_leftmost_and_the_rightmost(spark):
    df = spark.createDataFrame([(["c", "a", "b", "a", "d", "e"],), (["x", "y"],), ([],)], "h array<string>")
    left = [r[0] for r in df.select(text.winnow(F.col("h"), 3)).collect()]
    right = [r[0] for r in df.select(text.winnow(F.col("h"), 3, rightmost=True)).collect()]
    assert left == [[2, 4], [1, 2], []] and right == [[2, 4], [1, 2], []]
    tie = spark.createDataFrame([(["a", "a", "a", "b"],)], "h array<string>")
    assert tie.select(text.winnow(F.col("h"), 3)).first()[0] == [1, 2] and tie.select(text.winnow(F.col("h"), 3, True)).first()[0] == [3]


def test_minhash_is_exact_arithmetic(spark):
    import hashlib

    items = ["a b", "ü", "", "z" * 300]
    got = sketch.minhash(spark.createDataFrame([(1, items), (2, [])], "id long, items array<string>")).collect()
    h = [int.from_bytes(hashlib.md5(x.encode()).digest()[:4], "little") for x in items]
    want = [min((a * x + b) % sketch.PRIME for x in h) for a, b in sketch.coefficients()]
    assert {r["id"]: list(r["sig"]) for r in got} == {1: want, 2: [sketch.EMPTY] * sketch.PERMUTATIONS}


def test_connected_components(spark):
    edges = spark.createDataFrame([(1, 2, 0.9), (2, 3, 0.7), (8, 9, 0.8)], "a long, b long, w double")
    members = graph.connected(edges)
    assert {(r["id"], r["cluster"]) for r in members.collect()} == {(1, 1), (2, 1), (3, 1), (8, 8), (9, 8)}
    chain = spark.createDataFrame([(i, i + 1) for i in range(70)], "a long, b long")
    assert {r["cluster"] for r in graph.connected(chain).collect()} == {0}


def test_spans(spark):
    a = spark.createDataFrame([("d", 1, 0, 10), ("d", 2, 60, 200), ("e", 3, 5, 5)], "doc string, id long, off long, len long")
    b = spark.createDataFrame([("d", 7, 5, 100), ("d", 8, 250, 20), ("f", 9, 0, 5)], "doc string, id long, off long, len long")
    got = {(r["id_a"], r["id_b"], r["n"]) for r in spans.overlaps(a, b).collect()}
    assert got == {(1, 7, 5), (2, 7, 45), (2, 8, 10)}
    m = {r["doc"]: r for r in spans.pan_metrics(b, a).collect()}
    assert abs(m["d"]["precision"] - (5 / 10 + 45 / 200) / 2) < 1e-12 and abs(m["d"]["recall"] - (45 / 100 + 10 / 20) / 2) < 1e-12
    assert m["d"]["granularity"] == 1.5 and m["e"]["recall"] == 1 and m["f"]["precision"] == 1 and m["e"]["f1"] == m["f"]["f1"] == 0
    merged = spans.merge_regions(spark.createDataFrame([("d", 0, 10), ("d", 5, 3), ("d", 10, 5), ("d", 30, 1)], "doc string, off long, len long"))
    assert {(r["off"], r["len"], r["parts"]) for r in merged.collect()} == {(0, 15, 3), (30, 1, 1)}


def test_ranked_metrics(spark):
    rng = random.Random(2)
    rows = [(i, rng.randrange(12) * 80, rng.randrange(2)) for i in range(200)]
    df = spark.createDataFrame(rows, "doc_id long, score long, label int").withColumn("engine", F.lit("x"))
    pos, neg = [s for _, s, y in rows if y], [s for _, s, y in rows if not y]
    auc = sum((p > n) + (p == n) / 2 for p in pos for n in neg) / len(pos) / len(neg)
    assert abs(metrics.roc_auc(df, ["engine"]).first()["auc"] - auc) < 1e-12
    assert [r["doc_id"] for r in metrics.top_by(df, 7).orderBy("rank").collect()] == [i for i, *_ in sorted(rows, key=lambda r: (-r[1], r[0]))[:7]]


def test_entropy_and_edges_of_signals(spark):
    df = spark.createDataFrame([(["a", "b", "a", "c"],), ([],)], "w array<string>")
    got = [r[0] for r in df.select(signals.runs_entropy(F.col("w"))).collect()]
    assert abs(got[0] - 1.5) < 1e-12 and got[1] == 0
    short = spark.createDataFrame([(None,), ("",), ("one line",)], "t string")
    for f in (signals.burstiness, signals.whitespace, signals.patterns):
        assert all(0 <= r[0] <= 1 for r in short.select(f(F.col("t"))).collect())


def test_scores(spark):
    df = spark.createDataFrame([(0.9, 0.2, 0.5), (0.4, 0.4, 0.5), (0.9, 0.9, 0.1)], "a double, b double, c double")
    a, b, c = F.col("a"), F.col("b"), F.col("c")
    rows = df.select(scores.risk(a).alias("r"), scores.verdict(b).alias("v"), scores.hard_gate([a, b], [a], c).alias("g"), scores.consensus([a, b]).alias("m"), scores.logistic([(a, 1.0)], -0.9).alias("l")).collect()
    assert [r["r"] for r in rows] == ["CRITICAL", "MEDIUM", "CRITICAL"] and [r["v"] for r in rows] == ["UNCERTAIN", "CLEAN", "PLAGIARIZED"]
    assert [r["g"] for r in rows] == [False, True, True] and abs(rows[1]["m"] - 0.4) < 1e-9 and rows[0]["l"] == 0.5


def test_knn_blocks(spark, monkeypatch):
    monkeypatch.setattr(vectors, "ITEMS", 16)
    monkeypatch.setattr(vectors, "ASKED", 2)
    x = np.random.default_rng(3).standard_normal((100, 5))
    df = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(x)], "vec_id long, embedding array<double>")
    got = {}
    for r in vectors.knn(df, 3, "l2").collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"]))
    for q in range(0, 100, 20):
        assert [i for _, i in sorted(got[q])] == np.argsort(((x - x[q]) ** 2).sum(1))[1:4].tolist()


CODE = "def f(a, b):\n    c = a + b\n    for i in range(3):\n        if c > i:\n            c = c - i\n    return c\n"


def test_structure():
    assert structure.subtree_hashes(CODE) and structure.subtree_hashes("def (") == [] == structure.subtree_hashes(None)
    assert sorted(structure.subtree_hashes(CODE)) == sorted(structure.subtree_hashes(structure.renamed(CODE)))
    assert structure.clone_type(CODE, CODE) == 1 and structure.clone_type(CODE, structure.renamed(CODE)) == 2 and structure.clone_type(CODE, "x = 1") == 0
    assert "For>If" in structure.flow_edges(CODE) and any(e.endswith("~For") for e in structure.flow_edges(CODE)) and structure.data_edges(CODE)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.sampled_from("abc"), max_size=14), st.lists(st.sampled_from("abc"), max_size=14))
def test_alignments_are_sound(a, b):
    for find in (structure.tiles, structure.matching_blocks):
        seen_a, seen_b = set(), set()
        for i, j, n in find(a, b, 2):
            assert a[i : i + n] == b[j : j + n]
            assert not seen_a & set(range(i, i + n)) and not seen_b & set(range(j, j + n))
            seen_a |= set(range(i, i + n))
            seen_b |= set(range(j, j + n))
    naive = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            naive[i + 1][j + 1] = naive[i][j] + 1 if x == y else max(naive[i][j + 1], naive[i + 1][j])
    assert structure.common_subsequence(a, b) == naive[-1][-1]


def test_comprehensions_are_counted_in_linear_time(spark):
    """As the plain pattern counts them, and for long lines of openings too."""
    import random
    import re
    import time

    from tessella.functions import signals

    rng = random.Random(5)
    texts = ["".join(rng.choice(["[", "]", "for", "in", " ", "\n", "x", "fo", "i"]) for _ in range(rng.randrange(40))) for _ in range(500)]
    count = lambda rows: [r[0] for r in spark.createDataFrame([(t,) for t in rows], "t string").selectExpr(f"regexp_count(t, r'{signals.LINEAR_COMPREHENSION}')").collect()]
    assert count(texts) == [len(re.findall(signals.COMPREHENSION, t)) for t in texts]
    began = time.time()
    assert count(["[for in " * 50_000, "[" * 200_000, "[for " * 50_000 + "]", "[for in ]" * 50_000]) == [0, 0, 0, 1]
    assert time.time() - began < 20


@pytest.mark.parametrize("hot", [3, 10_000])
@pytest.mark.parametrize("num,den", [(1, 2), (7, 10), (4, 5), (1, 1)])
def test_similar_sets_equal_brute_force_with_and_without_hot_items(spark, monkeypatch, num, den, hot):
    import random

    from tessella.operators import setjoin

    monkeypatch.setattr(setjoin, "_candidates", lambda *a, f=setjoin._candidates: f(*a, hot))
    rng = random.Random(num + den)
    base = [rng.sample(range(60), 14) for _ in range(6)]
    rows = []
    for i in range(90):
        items = set(base[i % 6])
        for _ in range(rng.randrange(6)):
            items ^= {rng.randrange(60) if rng.random() < 0.7 else 1000 + rng.randrange(500)}
        rows.append((i, sorted(items | {7}), len(items | {7})))
    df = spark.createDataFrame(rows, "id long, items array<long>, n int")
    want = {(a, b, len(set(x) & set(y)), len(set(x) | set(y))) for a, x, _ in rows for b, y, _ in rows if a < b and len(set(x) & set(y)) * den >= len(set(x) | set(y)) * num}
    assert {tuple(r) for r in setjoin.jaccard_pairs(df, num, den).collect()} == want
    other = df.filter("id >= 60")
    got = {tuple(r) for r in setjoin.jaccard_pairs(df.filter("id < 60"), num, den, other).collect()}
    assert got == {w for w in want if w[0] < 60 <= w[1]}


def test_pairs_are_compared_where_their_sets_travel_once(spark, monkeypatch):
    rng = random.Random(7)
    docs = [(i, [rng.randrange(50) for _ in range(30)]) for i in range(40)] + [(50, [])]
    df = spark.createDataFrame(docs, "id long, items array<long>")
    links = [(a, b) for a in range(40) for b in range(a + 1, 40)] + [(3, 50), (4, 60)]  # 60 is not in docs
    pairs = spark.createDataFrame(links, "id_a long, id_b long")
    made = spark.sparkContext.accumulator(0)

    def ready(items):
        if len(items):
            made.add(1)
        return setjoin.tallied(items)

    held = {i: {t: w.count(t) for t in w} for i, w in docs}
    want = {(a, b, sum(min(c, held.get(b, {}).get(t, 0)) for t, c in held[a].items()), len(docs[a][1]), sum(held.get(b, {}).values())) for a, b in links}
    of = lambda df: {(r["id_a"], r["id_b"], r["m"], r["na"], r["nb"]) for r in df.collect()}
    assert of(setjoin.compared(pairs, setjoin.pair_sums, setjoin._SUMS, df, ready=ready)) == want
    assert made.value <= 43  # not two for each of 782 pairs
    assert of(setjoin.pair_counts(pairs, df)) == want
    monkeypatch.setattr(setjoin, "MEMBERS", 4)
    assert of(setjoin.pair_counts(pairs, df)) == want
    both = setjoin.compared(pairs, setjoin.pair_sums, setjoin._SUMS, df, df.filter("id < 45"), ready=setjoin.tallied)
    assert of(both) == want


def test_strings_of_one_program_at_a_time(spark):
    programs = spark.createDataFrame([(1, "a"), (2, None), (3, "b")], "id long, code string").coalesce(1)
    many = structure.hashed(programs, lambda s: [f"{s}{k}" for k in range(200_000)] if s else []).select("id", F.size(F.array_distinct("items")).alias("n"))
    assert sorted(map(tuple, many.collect())) == [(1, 200_000), (2, 0), (3, 200_000)]


def test_near_copies_meet_once_and_not_for_each_item(spark):
    rng = random.Random(9)
    rows = [(i, sorted(set(range(60)) - {rng.randrange(60)} | {100 + i % 7})) for i in range(40)]
    sets = spark.createDataFrame(rows, "id long, items array<long>").withColumn("n", F.size("items"))
    items = setjoin._exploded(sets)
    held = setjoin._prefixed(items, items.groupBy("t").agg(F.count("id").alias("df")), 1, 2).cache()
    found = setjoin._candidates(held, held, 1, 2, True)
    assert sorted(map(tuple, found.collect())) == [(a, b) for a in range(40) for b in range(a + 1, 40)]
    node = found._jdf.queryExecution().executedPlan()
    while "Join" not in node.nodeName():
        node = node.executedPlan() if "Adaptive" in node.nodeName() else node.plan() if "QueryStage" in node.nodeName() else node.children().head()
    assert node.metrics().apply("numOutputRows").value() == 40 * 39 // 2


def test_items_of_the_sets_are_shuffled_once(spark):
    sets = spark.createDataFrame([(i, [i, i + 1, 50]) for i in range(9)], "id long, items array<long>").withColumn("n", F.size("items"))
    rows = setjoin._exploded(sets)
    frequency = rows.groupBy("t").agg(F.count("id").alias("df"), F.max("n").alias("most")).filter("df > 1 AND most > 0").select("t", "df")
    met = rows.hint("merge").join(frequency, "t")
    met.collect()
    assert "ReusedExchange" in met._jdf.queryExecution().toString()
