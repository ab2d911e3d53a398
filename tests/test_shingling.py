"""Shingles, prints and shared items against plain Python."""

import hashlib
import random
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from tessella.functions import text
from tessella.operators import setjoin, shingling, structure


def texts():
    rng = random.Random(3)
    made = ["".join(rng.choice("aB1 .éK") for _ in range(rng.randrange(60))) for _ in range(300)]
    long = ["ab" * 300, "ab" * 300 + "c", "abcdefgh", "abcdefghi", "abcdefghj", "a b c d e", "a b c d e f", "a a a a a a a", "x " * 40]
    return [None, "", " ", *made, *long]


def test_shingles_are_those_of_the_tokens(spark, monkeypatch):
    monkeypatch.setattr(shingling, "HELD", 64)  # some texts are longer
    docs = spark.createDataFrame(list(enumerate(texts())), "id long, text string").coalesce(2)
    want = {r["id"]: frozenset(r["w"]) for r in docs.select("id", text.ngrams(text.tokens(F.col("text")), 5).alias("w")).collect()}
    got = {r["id"]: r["items"] for r in shingling.shingled(docs, 5).collect()}
    assert all(x == sorted(set(x)) and len(x) == len(want[i]) for i, x in got.items()) and got.keys() == want.keys()
    pairs = {(want[i], frozenset(x)) for i, x in got.items()}
    assert len(pairs) == len({w for w, _ in pairs}) == len({x for _, x in pairs})


def test_measures_are_those_of_the_tokens(spark):
    docs = spark.createDataFrame(list(enumerate(texts())), "id long, text string")
    words = {r["id"]: r["w"] for r in docs.select("id", text.tokens(F.col("text")).alias("w")).collect()}
    for r in shingling.measured(docs, 5, 4).collect():
        w = words[r["id"]]
        assert sorted(Counter(r["t"]).values()) == sorted(Counter(w).values())
        assert len(r["g"]) == len(set(zip(w, w[1:])) or set(w))
        h = [hashlib.md5(" ".join(w[i : i + 5]).encode()).hexdigest() for i in range(max(len(w) - 4, 1 if w else 0))]
        picked = {min(range(i, i + 4), key=lambda k: (h[k], k)) for i in range(len(h) - 3)} if len(h) >= 4 else range(len(h))
        assert [x & (1 << 64) - 1 for x in r["f"]] == [int(h[k][:16], 16) for k in sorted(picked)]
        assert r["l"] == (sum(map(len, w)) / len(w) if w else None)


def test_items_that_others_have_are_found_in_one_pass(spark, monkeypatch):
    """Sorted rows are read once; an item with more rows than are held counts as one with so many, however batches fall."""
    rng = random.Random(5)
    rows = [(i, 9, rng.choice([1, 2, 3, *range(100, 200), 10**6 + i])) for i in range(2000)] + [(i, 9, 7) for i in range(3000)]
    df = spark.createDataFrame(rows, "id long, n int, t long").repartition(3, "t")
    count = Counter(t for *_, t in rows)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 50)
    try:
        for most in (1 << 16, 20):
            monkeypatch.setattr(setjoin, "COUNTED", most)
            got = sorted(map(tuple, setjoin._shared(df).collect()))
            assert got == sorted((i, n, t, min(count[t], most)) for i, n, t in rows if count[t] > 1)
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_overlaps_of_many_pairs_equal_those_of_each(spark, monkeypatch):
    rng = random.Random(8)
    docs = spark.createDataFrame([(i, [rng.randrange(40) for _ in range(rng.randrange(25))], [rng.randrange(9)]) for i in range(40)], "id long, a array<long>, b array<long>")
    pairs = spark.createDataFrame([(a, b) for a in range(40) for b in range(a + 1, 42)], "id_a long, id_b long")
    ready = lambda a, b: ([setjoin.tallied(a), (b, None)], (len(a),))
    score = lambda common, dot, x, y: ((common[:, 0], common[:, 1], dot, x[:, 0].astype(int), y[:, 0].astype(int)), common[:, 0] > 1)

    def each(x, y):
        m, dot, na, nb, *_ = setjoin.pair_sums(setjoin.tallied(x[0]), setjoin.tallied(y[0]))
        return (m, len(np.intersect1d(x[1], y[1])), dot, na, nb) if m > 1 else None

    out = "m long, k long, dot long, na long, nb long"
    want = sorted(map(tuple, setjoin.compared(pairs, each, out, docs).collect()))
    for members, held in ((256, 1 << 20), (4, 100)):
        monkeypatch.setattr(setjoin, "MEMBERS", members)
        monkeypatch.setattr(setjoin, "HELD", held)
        assert sorted(map(tuple, setjoin.overlapped(pairs, ready, score, out, docs).collect())) == want


def test_tiles_are_the_longest_runs_again_and_again(monkeypatch):
    def plain(a, b, least):
        used_a, used_b, out = set(), set(), []
        while True:
            best = (least - 1, 0, 0)
            for i in range(len(a)):
                for j in range(len(b)):
                    n = 0
                    while i + n < len(a) and j + n < len(b) and a[i + n] == b[j + n] and i + n not in used_a and j + n not in used_b:
                        n += 1
                    if n > best[0]:
                        best = (n, i, j)
            n, i, j = best
            if n < least:
                return sorted(out)
            used_a |= set(range(i, i + n))
            used_b |= set(range(j, j + n))
            out.append((i, j, n))

    rng = random.Random(2)
    for k in range(400):
        a, b = ([rng.choice("abcdef"[: 1 + k % 6]) for _ in range(rng.randrange(24))] for _ in range(2))
        b = a[:8] + b[:4] + a[10:] if k % 3 == 0 else b
        monkeypatch.setattr(structure, "MATCHES", 0 if k % 5 == 0 else 1 << 20)
        assert structure.tiles(a, b, 2 + k % 2) == plain(a, b, 2 + k % 2)


def test_runs_under_longer_ones_are_not_looked_at(monkeypatch):
    rng = random.Random(4)
    a = [rng.choice("abcdefgh") for _ in range(400)]
    b = [*a[:200], "x", *a[201:]]
    looked = []
    monkeypatch.setattr(structure, "_tile", lambda runs, *more, f=structure._tile: (looked.append(len(runs)), f(runs, *more)))
    assert structure.tiles(a, b) == [(0, 0, 200), (201, 201, 199)]
    assert sum(looked) < 20
