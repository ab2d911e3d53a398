"""The changing index against one that is built anew, and search against scoring everything."""

import random

from pyspark.sql import functions as F

from tessella.operators import search, sketch
from tessella.operators.sketch_index import SketchIndex


def texts(n, seed):
    rng = random.Random(seed)
    base = [[f"w{rng.randrange(300)}" for _ in range(60)] for _ in range(12)]
    out = []
    for i in range(n):
        w = list(base[i % 12])
        for _ in range(rng.randrange(4)):
            w[rng.randrange(60)] = f"x{rng.randrange(1000)}"
        out.append((i, w if i % 17 else []))
    return out


def plain(spark, held, asked, least):
    sig = lambda rows: {(r["id"]): r["sig"] for r in sketch.minhash(spark.createDataFrame(rows, "id long, items array<string>")).collect()}
    h, a = sig(held), sig(asked)
    out = set()
    for q, x in a.items():
        for i, y in h.items():
            bands = any(x[k : k + sketch.ROWS] == y[k : k + sketch.ROWS] for k in range(0, sketch.PERMUTATIONS, sketch.ROWS))
            share = sum(p == r for p, r in zip(x, y)) / sketch.PERMUTATIONS
            if x[0] != sketch.EMPTY and y[0] != sketch.EMPTY and bands and share >= least:
                out.add((q, i, share))
    return out


def test_index_equals_a_rebuild_after_every_change(spark, tmp_path):
    make = lambda rows: spark.createDataFrame(rows, "id long, items array<string>")
    index, rows = SketchIndex(spark, f"file://{tmp_path}/index", shards=8), texts(80, 1)
    asked = texts(30, 2)[::3] + [(1000, []), (1001, rows[5][1])]
    ask = lambda: {tuple(r) for r in index.query(make(asked), 0.5).collect()}
    assert ask() == set()
    index.add(make(rows[:50]))
    held = dict(rows[:50])
    assert ask() == plain(spark, list(held.items()), asked, 0.5) != set()
    index.add(make(rows[40:]))
    held |= dict(rows[40:])
    index.remove(make([(i, []) for i in (3, 5, 7, 9999)]).select("id"))
    held = {i: w for i, w in held.items() if i not in (3, 5, 7)}
    assert ask() == plain(spark, list(held.items()), asked, 0.5)
    index.add(make([(5, rows[6][1]), (8, []), (7, rows[7][1])]))  # another text, no text, back again
    held |= {5: rows[6][1], 8: [], 7: rows[7][1]}
    want = plain(spark, list(held.items()), asked, 0.5)
    assert ask() == want
    index.compact()
    assert ask() == want and index.standing().count() == sum(bool(w) for w in held.values())
    index.remove(make([(5, [])]).select("id"))
    assert ask() == {x for x in want if x[1] != 5}


def test_a_call_that_fails_leaves_nothing_and_queries_read_their_shards(spark, tmp_path):
    make = lambda rows: spark.createDataFrame(rows, "id long, items array<string>")
    index, rows = SketchIndex(spark, f"file://{tmp_path}/index", shards=64), texts(40, 3)
    index.add(make(rows))
    before = {tuple(r) for r in index.query(make(rows[1:2])).collect()}
    commit, index._commit = index._commit, None
    try:
        index.add(make([(500, rows[1][1])]))
    except TypeError:
        pass
    index._commit = commit
    assert {tuple(r) for r in index.query(make(rows[1:2])).collect()} == before
    held = index._read("bands", "band int, bucket long, id long", index._state()).filter(F.col("shard").isin([1, 2]))
    plan = held._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [" in plan and "shard" in plan.split("PartitionFilters: [")[1].split("]")[0]


def test_search_equals_scoring_everything(spark, monkeypatch):
    monkeypatch.setattr(search, "BLOCK", 4)
    rng = random.Random(4)
    words = [f"w{i}" for i in range(60)] + ["the"] * 20 + ["of"] * 15
    docs = [(i, [rng.choice(words) for _ in range(rng.randrange(40))]) for i in range(300)] + [(i, ["the", "w1", "w2"]) for i in range(400, 440)]
    df = spark.createDataFrame(docs, "id long, items array<string>")
    index = search.inverted(df)
    impact = {(r["id"], r["t"]): r["impact"] for r in index.postings.collect()}
    queries = df.filter("id % 10 = 0").select(F.col("id").alias("query_id"), "items")
    for k in (1, 5, 50):
        got = {}
        for r in search.search(index, queries, k).collect():
            got.setdefault(r["query_id"], []).append((r["rank"], r["id"], r["score"]))
        for q, w in docs:
            if q % 10 == 0:
                score = {i: sum(impact.get((i, t), 0) for t in set(w)) for i, _ in docs if i != q and any((i, t) in impact for t in set(w))}
                want = sorted(score.items(), key=lambda x: (-x[1], x[0]))[:k]
                assert sorted(got.get(q, [])) == [(n, i, s) for n, (i, s) in enumerate(want, 1)], (q, k)
    asked = queries.select("query_id", F.explode(F.array_distinct("items")).alias("t"))
    every = asked.join(index.maxima, "t").select("query_id", "block").distinct().count()
    assert search.surviving(index, asked, 1).count() < 0.7 * every


def test_ranked_search_by_parts_equals_the_index(spark, monkeypatch):
    """Several parts and lots, ties cut at the k-th best, queries without items or unknown terms."""
    monkeypatch.setattr(search, "PARTS", 3)
    monkeypatch.setattr(search, "ASKED", 10)
    rng = random.Random(5)
    words = [f"w{i}" for i in range(60)] + ["the"] * 20
    docs = [(i, [rng.choice(words) for _ in range(rng.randrange(40))]) for i in range(200)] + [(i, ["the", "w1", "w2"]) for i in range(400, 440)]
    df = spark.createDataFrame(docs, "id long, items array<string>")
    queries = df.filter("id % 10 = 0").unionByName(spark.createDataFrame([(999, ["unknown"])], df.schema)).select(F.col("id").alias("query_id"), "items")
    held = dict(docs)
    for k in (1, 7, 50):
        want = {tuple(r) for r in search.search(search.inverted(df), queries, k).collect()}
        got = search.ranked(df, queries, k).collect()
        assert {(r["query_id"], r["rank"], r["id"], r["score"]) for r in got} == want != set()
        assert all((r["common"], r["size"], r["asked"]) == (len({*held[r["query_id"]]} & {*held[r["id"]]}), len({*held[r["id"]]}), len({*held[r["query_id"]]})) for r in got)
