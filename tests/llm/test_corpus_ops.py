import os
import random
import re
import zlib
from fractions import Fraction

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline as P
from tessella.llm import ann_mih as A
from tessella.llm import jaccard_join as J
from tessella.llm import pfair_mix as M
from tessella.llm import piece_codec as C
from tessella.llm import token_store as T
from tessella.llm.components import components
from tessella.llm.shingles import shingle_set

from .helpers import LONG, TEXTS, docs

public = pytest.importorskip("public_tokenizers")


# ---- operator 10


def brute_sets(rows, k):
    out = {}
    for i, text, *_ in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
        out.setdefault(i, set()).update({tuple(w[j : j + k]) for j in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} if w else set())
    return out


def brute_join(rows, k=4, num=85, den=100):
    sets = {i: s for i, s in brute_sets(rows, k).items() if i is not None}
    link = {i: [j for j in sets if j != i and sets[i] and sets[j] and den * len(sets[i] & sets[j]) >= num * len(sets[i] | sets[j])] for i in sets}
    out = {}
    for i in sets:
        seen, todo = {i}, [i]
        while todo:
            new = set(link[todo.pop()]) - seen
            seen |= new
            todo += new
        others = {frozenset(sets[j]) for j in link[i]} - {frozenset(sets[i])}
        copies = 1 + sum(sets[j] == sets[i] and bool(sets[i]) for j in sets if j != i)
        out[i] = (len(sets[i]), min(seen), copies, len(others))
    return out


def near_copies(seed, groups=6, size=14, words=60, edits=4):
    rng = random.Random(seed)
    rows, i = [], 100
    shared = [f"s{j}" for j in range(25)]
    for _ in range(groups):
        base = [f"w{rng.randrange(200)}" for _ in range(words)] + shared
        for _ in range(size):
            w = list(base)
            for _ in range(rng.randrange(edits)):
                w[rng.randrange(words)] = f"e{rng.randrange(9)}"
            rows.append((i, " ".join(w), "en", "z"))
            i += 1
    return rows


def joined(df):
    return {r["doc_id"]: (r["n_shingles"], r["component_id"], r["n_copies"], r["n_links"]) for r in df.collect()}


def test_join_equals_brute_force(spark):
    rows = TEXTS + near_copies(1) + [(90, "a b", "en", "x"), (91, "A  B", "en", "x"), (92, "b a", "en", "x")]
    df = J.jaccard_join(docs(spark, rows))
    assert df.count() == len(rows)
    got = joined(df)
    null = got.pop(None)
    assert null[1] is None
    assert got == brute_join(rows)


def test_large_regions_are_divided_exactly(spark, monkeypatch):
    for name, value in (("REGION", 10), ("PIVOTS", 3), ("LEAF", 4), ("FREQUENT_MOST", 0), ("POSTS", 500)):
        monkeypatch.setattr(J, name, value)
    rows = near_copies(2, groups=3, size=30, edits=9)
    assert joined(J.jaccard_join(docs(spark, rows, False))) == brute_join(rows)
    monkeypatch.setattr(J, "BROADCAST_IDS", -1)
    assert joined(J.jaccard_join(docs(spark, rows, False), 5, 80)) == brute_join(rows, 5, 80)


def test_regions_inside_another_are_left_out(spark, monkeypatch):
    """Near copies share many pivots; their sets go to few regions all the same."""
    held = {}

    def kept(df, label, do=J.materialize):
        held[label] = do(df, label)
        return held[label]

    monkeypatch.setattr(J, "materialize", kept)
    rows = near_copies(7, groups=3, size=30, edits=5)
    assert joined(J.jaccard_join(docs(spark, rows, False))) == brute_join(rows)
    sets = held["classes"].count()
    assert held["regions"].count() <= 2 * sets
    sized = spark.createDataFrame([(1, 1, 100), (2, 1, 84), (3, 1, 40), (4, 1, 40), (5, 1, 85), (6, 2, 10), (7, 3, 84), (8, 3, 100)], "doc long, pivot long, n long")
    assert sorted(map(tuple, J._of_like_size(sized, 85, 100).collect())) == [(1, 1), (2, 1), (3, 1), (4, 1), (5, 1)]
    known = spark.createDataFrame([(1, 1), (2, 1), (3, 1), (2, 2), (3, 2), (3, 3), (4, 3)], "doc long, pivot long")
    assert sorted(map(tuple, J._own_regions(known).collect())) == [(1, 1), (2, 1), (3, 1), (3, 3), (4, 3)]


def test_few_very_long_near_copies(spark, monkeypatch):
    """More parts than sets: a part has the pivots of its region alone."""
    monkeypatch.setattr(J, "REGION_SHINGLES", 200)
    words = [f"w{j}" for j in range(900)]
    rows = [(i, " ".join([*words, f"end{i}"]), "en", "z") for i in range(2)] + [(9, "none like this one here", "en", "z")]
    assert joined(J.jaccard_join(docs(spark, rows, False))) == brute_join(rows)


def test_join_of_nothing(spark):
    assert J.jaccard_join(docs(spark, [])).count() == 0
    assert joined(J.jaccard_join(docs(spark, [(5, None, None, None)]))) == {5: (0, 5, 1, 0)}


def test_rows_of_one_id_with_different_texts(spark):
    """Such a document has the links of each of its texts, and is one node."""
    a, b, c = "a b c d e f g", "other words stand here now again", "z " + " ".join(f"y{i}" for i in range(60))
    rows = [(1, a, "en", "x"), (1, b, "en", "x"), (2, a, "en", "x"), (3, b, "en", "x"), (4, c, "en", "x"), (5, c + " end", "en", "x"), (6, c, "en", "x"), (6, "alone in this table", "en", "x"), (7, "alone in this table", "en", "x")]
    got = sorted((r["doc_id"], r["n_shingles"], r["component_id"], r["n_copies"], r["n_links"]) for r in J.jaccard_join(docs(spark, rows, False)).collect())
    assert got == [(1, 3, 1, 2, 0), (1, 4, 1, 2, 0), (2, 4, 1, 2, 0), (3, 3, 1, 2, 0), (4, 58, 4, 2, 1), (5, 59, 4, 1, 1), (6, 1, 4, 2, 1), (6, 58, 4, 2, 1), (7, 1, 4, 2, 0)]


def test_voronoi_cells_divide_an_ordinary_region():
    """A region of a few groups around common passages, with the production parameters: cells are made, links are exact."""
    rng = random.Random(5)
    shared, rows = [f"s{j}" for j in range(12)], []
    for _ in range(9):
        base = [f"w{rng.randrange(10**6)}" for _ in range(120)]
        for _ in range(12):
            w = [*base, *shared]
            w[rng.randrange(120)] = f"e{rng.randrange(10**6)}"
            rows.append(" ".join(w))
    sets = [shingle_set(t, 4).view(np.int64) for t in rows]
    r = J.Region(sets, 85, 100)
    got = {tuple(p) for p in r.pairs().T.tolist()}
    held = [set(s.tolist()) for s in sets]
    assert got == {(i, j) for i in range(len(held)) for j in range(i + 1, len(held)) if 100 * len(held[i] & held[j]) >= 85 * len(held[i] | held[j])}
    assert len(got) > 100 and r.cells >= 2


def test_counting_streams_over_batches():
    rng = random.Random(2)
    rows = sorted(((rng.randrange(40), rng.choice([None, 1, 2, 3]), 1, 0 if rng.random() < 0.9 else 2) for _ in range(300)), key=lambda r: r[0])
    want = {}
    for h, doc, need, cnt in rows:
        if cnt or doc is not None and sum(x[0] == h and not x[3] for x in rows) > 1:
            want[doc] = want.get(doc, 0) + max(cnt, 1)
    for size in (1, 2, 7, 300):
        t = pa.Table.from_pylist([dict(zip(("h", "doc", "need", "cnt"), r)) for r in rows], schema=J._POST)
        got = {}
        for b in J._count(iter(t.to_batches(max_chunksize=size))):
            for r in b.to_pylist():
                got[r["doc"]] = got.get(r["doc"], 0) + r["cnt"]
        assert got == want


def test_filters_lose_no_partner():
    for n in range(1, 300):
        for m in range(n, 400):
            if 100 * n < 85 * m:
                break
            assert J.needed(n, 85, 100) <= 1 + -(-J.spare(m, 85, 100) // 2)
            assert J.needed(m, 85, 100) <= 1 + -(-J.spare(n, 85, 100) // 2)


def test_shingles_follow_words_and_case():
    assert len(shingle_set("a b c d e", 4)) == 2 and len(shingle_set("a b", 4)) == 1 and not len(shingle_set(" \n", 4)) and not len(shingle_set(None, 4))
    assert (shingle_set("Ab\tcd\x0bÉf gh", 4) == shingle_set("aB CD Éf gh", 4)).all()
    assert not np.array_equal(shingle_set("éf a b c", 4), shingle_set("Éf a b c", 4))


def test_components_of_chains(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 99), (7, 7), (200, 200)]
    got = {r["node"]: r["component"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(41)} | {99: 99, 100: 99, 200: 200}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


# ---- operator 3


def test_neighbours_against_brute_force(spark):
    rng = np.random.default_rng(5)
    x = np.concatenate((rng.standard_normal((300, 64)), np.repeat(rng.standard_normal((1, 64)), 40, 0)))
    rows = [(i, [float(v) for v in r], 1) for i, r in enumerate(x)] + [(1000, None, 1), (1050, [0.0] * 64, 1), (1100, [float("nan")] * 64, 1), (1150, [None] * 64, 1), (1200, [1.0], 1), (None, [1.0] * 64, 1), (0, [float(v) for v in x[0]], 1)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, code int").selectExpr("*", "'x' AS vector", "1 AS top")
    coder = A.coder_for(df, "vec_id", "embedding")
    items = A.index(df, coder)
    queries = items.filter("vec_id % 50 = 0").dropDuplicates(["vec_id"])
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    for radius, least in ((coder.radius, 0.9), (A.BITS, 1.0), (2, 1.0)):
        got = {}
        for r in A.nearest(items, queries, radius).collect():
            got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
        assert set(got) == set(range(0, 340, 50))
        hits = 0
        for q, found in got.items():
            s = unit @ unit[q]
            want = [i for i in np.lexsort((np.arange(len(s)), -np.round(s, 12))) if i != q][:5]
            hits += len({i for _, i, _ in found} & set(want))
            assert [k for k, *_ in sorted(found)] == [1, 2, 3, 4, 5]
            assert all(abs(v - s[i]) < 1e-12 for _, i, v in found)
        assert hits >= least * 5 * len(got) if radius != 2 else True


def test_recall_against_exact_cosine_on_all_vectors(spark):
    """The query itself, on the largest test table, against cosines of every query with every vector."""
    path = "/root/testdata/sf0.1"
    if not os.path.exists(path):
        pytest.skip("no test tables")
    rows = spark.read.parquet(f"{path}/embeddings.parquet").select("vec_id", "embedding").collect()
    ids, x = np.array([r[0] for r in rows]), np.array([r[1] for r in rows], np.float64)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    got = {}
    for r in A.op3_ann_mih(spark, path).collect():
        got.setdefault(r["query_id"], {})[r["vec_id"]] = r["score"]
    asked = np.flatnonzero(ids % 50 == 0)
    assert set(got) == set(ids[asked].tolist())
    hits = 0
    for q in asked:
        s = x @ x[q]
        s[q] = -2
        best = np.lexsort((ids, -s))[:5]
        hits += len(set(ids[best].tolist()) & got[ids[q]].keys())
    assert hits >= 0.95 * 5 * len(asked)


def test_codes_of_short_vectors_are_learned_and_packing_is_exact():
    rng = np.random.default_rng(1)
    short = A.Coder([rng.standard_normal(10) for _ in range(200)])
    assert short.axes.shape == (10, 64) and np.allclose(np.linalg.norm(short.axes, axis=0), 1)
    for v in (rng.standard_normal(9), rng.standard_normal(9).astype("<f4").astype(float)):
        assert (A.unpack(A.pack(v)) == v).all()
    assert [A.parts_for(n) for n in (0, 300, 10_000, 10**6, 10**12)] == [16, 8, 4, 4, 2]


def test_neighbours_of_few(spark):
    few = spark.createDataFrame([(0, [1.0, 0.0]), (1, [1.0, 1.0]), (2, [2.0, 2.0])], "vec_id long, embedding array<double>")
    items = A.index(few, A.coder_for(few, "vec_id", "embedding"))
    got = sorted((r["rank"], r["vec_id"]) for r in A.nearest(items, items.filter("vec_id % 50 = 0"), 1).collect())
    assert got == [(1, 1), (2, 2)]
    none = few.limit(0)
    assert A.nearest(A.index(none, A.coder_for(none, "vec_id", "embedding")), A.index(none, A.coder_for(none, "vec_id", "embedding")), 9).count() == 0


# ---- operator 4


def test_schedule_stays_within_a_block():
    rng = random.Random(3)
    for _ in range(60):
        sizes = {f"s{i}": rng.randrange(1, 1000) for i in range(rng.randrange(1, 12))}
        w = M.whole_weights(sizes, 97)
        assert sum(w.values()) == 97 and min(w.values()) >= 1
        done = dict.fromkeys(w, 0)
        for slot, (s, k) in enumerate(M.schedule(w), 1):
            assert k == done[s]
            done[s] += 1
            assert all(abs(done[x] * 97 - w[x] * slot) < 97 for x in w)


def test_weights_follow_the_targets():
    assert M.whole_weights({"a": 0.9, "b": 0.1}, 1000) == {"a": 900, "b": 100}
    many = {f"s{i}": 0.5 if i == 0 else 0.5 / 499 for i in range(500)}
    assert M.whole_weights(many, M.period_for(many))["s0"] / M.period_for(many) == pytest.approx(0.5, abs=1e-4)
    thirds = {"a": Fraction(1, 3), "b": Fraction(2, 3), "c": Fraction(0)}
    assert M.period_for({s: v for s, v in thirds.items() if v}) == 1002
    assert M.whole_weights(thirds, 1000)["c"] == 1
    assert M.whole_weights(dict.fromkeys("abc", 0.0), 7) == {"a": 3, "b": 2, "c": 2}


def test_more_sources_than_a_period(spark):
    rows = [(i, "x" * (1 + i % 4), "en", f"site{i % 1500}") for i in range(3000)]
    got = M.mix(docs(spark, rows, False), block_chars=4).collect()
    assert len(got) == 3000 and len({r["source"] for r in got}) == 1500
    assert len({(r["source"], r["block"]) for r in got}) == len({r["slot"] for r in got})
    assert M.mix(docs(spark, rows, False), period=50).count() == 3000


def test_sources_in_bins_stay_near_their_share():
    """Exact weights, without a period: each source within one block of its share at every turn, while all have blocks."""
    rng = random.Random(9)
    for _ in range(60):
        w = {f"s{i}": rng.randrange(1, 1000) for i in range(rng.randrange(1, 12))}
        total, last = sum(w.values()), 400
        done = dict.fromkeys(w, 0)
        for i, (s, k, turn) in enumerate(M.turns(w, dict.fromkeys(w, last))):
            if turn >= last:
                break
            assert turn == i and k == done[s]
            done[s] += 1
            assert all(abs(done[x] * total - w[x] * (turn + 1)) < total for x in w)
    assert list(M.turns({"a": 1, "b": 3}, {"a": 2, "b": 1})) == [("b", 0, 0), ("a", 0, 1), ("a", 1, 4)]


@pytest.mark.parametrize("targets", [None, {"site0": 0.5, "site1": 0.25, "site900": 0.01}])
def test_many_sources_share_the_slots_of_bins(spark, monkeypatch, targets):
    """A bounded schedule for any number of sources: each block has a slot of its own, and shares are held."""
    monkeypatch.setattr(M, "HEADS", 20)
    monkeypatch.setattr(M, "BINS", 7)
    rows = [(i, "x" * (1 + i % 4), "en", f"site{i % 150 if i % 3 else i % 2}" if i % 40 else None) for i in range(4000)]
    mixed = M.mix(docs(spark, rows, False), targets, block_chars=4)
    got = mixed.collect()
    assert len(got) == 4000 and {r["source"] for r in got} == {r[3] for r in rows}
    assert len({(r["source"], r["block"]) for r in got}) == len({r["slot"] for r in got})
    for s in {r["source"] for r in got}:
        mine = sorted((r["block"], r["slot"]) for r in got if r["source"] == s)
        assert [x for _, x in mine] == sorted(x for _, x in mine)  # blocks in their order
    if targets:  # of two sources with a target two thirds go to the first, less a slot of the period for each other
        blocks = {(r["source"], r["block"]) for r in got if r["slot"] < 200}
        assert abs(sum(s == "site0" for s, _ in blocks) - 200 * 2 / 3) <= 6


def test_mix_keeps_all_and_follows_the_schedule(spark):
    rows = TEXTS + [(i, "x" * (i % 7 * 10), "en", "big" if i % 3 else "small") for i in range(1000, 1400)]
    df = docs(spark, rows)
    mixed = M.mix(df, block_chars=64, period=50)
    got = mixed.collect()
    assert len(got) == len(rows)
    assert set(docs(spark, rows).columns) <= set(mixed.columns)
    blocks = {}
    for r in sorted(got, key=lambda r: (r["slot"], r["place"])):
        blocks.setdefault(r["source"], []).append(r)
    slot_of = {}
    for s, rs in blocks.items():
        at = 0
        for r in rs:  # documents fill blocks in their order
            assert r["block"] == at // 64
            at += max(1, len(r["text"] or ""))
            assert slot_of.setdefault(r["slot"], (s, r["block"])) == (s, r["block"])
        assert all(r["slot"] // 50 == r["block"] // r["weight"] for r in rs)
    assert M.mix(docs(spark, [])).count() == 0
    assert {r["weight"] for r in M.mix(df.filter("source = 'a'"), {"a": 1.0}).collect()} == {M.PERIOD}
    assert [r["slot"] for r in M.ordered(mixed).collect()] == sorted(r["slot"] for r in got)


# ---- operator 5


def test_pieces_equal_the_library(spark, tmp_path):
    import hashlib

    import sentencepiece

    path = public.path(C.MODEL)
    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    rows = TEXTS + [(50, "  two  ▁ spaces ", "en", "a"), (51, "\0 <s> <unk>", "en", "a")]
    docs(spark, rows).write.parquet(f"{tmp_path}/documents.parquet")
    texts = {i: t or "" for i, t, *_ in rows}
    got = C.op5_piece_codec(spark, str(tmp_path)).collect()
    assert len(got) == len(rows)
    for r in got:
        ids = sp.encode(texts[r["doc_id"]])
        assert r["n_tokens"] == len(ids) and r["ids_sha256"] == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256((sp.decode(ids) if ids else "").encode()).hexdigest()
        assert r["n_bytes"] == len(texts[r["doc_id"]].encode())
    for r in C.encode(docs(spark, rows), path).collect():
        data = texts[r["doc_id"]].encode()
        assert r["starts"] == [0, *r["ends"][:-1]] or not r["ids"]
        assert b"".join(data[a:b] for a, b in zip(r["starts"], r["ends"])) == data
    back = {r["doc_id"]: r["text"] for r in C.decode(C.encode(docs(spark, rows), path), path).collect()}
    assert back[10] == texts[10] and back[6] == LONG
    assert C.round_trip(docs(spark, []), path).count() == 0


@pytest.mark.parametrize("rule", ["nmt_nfkc", "nfkc_cf", "nmt_nfkc_cf", "nfkc"])
def test_normalisation_follows_the_character_map(rule):
    import sentencepiece
    from sentencepiece import sentencepiece_model_pb2

    lib = sentencepiece.SentencePieceNormalizer(rule_name=rule, add_dummy_prefix=True, remove_extra_whitespaces=True, escape_whitespaces=True)
    proto = sentencepiece_model_pb2.ModelProto()
    proto.ParseFromString(lib.serialized_model_proto())
    mine = C.Normalizer(proto.normalizer_spec)
    rng = random.Random(6)
    for _ in range(500):
        t = "".join(rng.choice(" \n\t▁ aAbé漢ﬁ①ＡÄİﷺ　\xa0㌔\U0001f600") for _ in range(rng.randrange(12)))
        shown, at = mine(t)
        assert shown == lib.normalize(t)
        assert len(at) == len(shown.encode()) + 1 and (np.diff(at) >= 0).all() and at[-1] <= len(t.encode())


# ---- operator 6


def test_store_round_trip(spark, tmp_path):
    from tokenizers import Tokenizer

    tk = Tokenizer.from_file(public.path(T.VOCABULARY))
    rows = TEXTS + [(60, "<|endoftext|> it's   'll\n\n x ", "en", "a"), (-5, "first", "en", "a")]
    docs(spark, rows).write.parquet(f"{tmp_path}/documents.parquet")
    got = sorted((r["start"], r["doc_id"], r["n_tokens"], r["ids_crc32"]) for r in T.op6_token_store(spark, str(tmp_path)).collect())
    want, at = [], 0
    for i, t, *_ in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0)):
        ids = np.array([*tk.encode(t or "", add_special_tokens=False).ids, 2], "<u4")
        want.append((at, i, len(ids), zlib.crc32(ids.tobytes())))
        at += len(ids)
    assert got == want


def test_one_document_is_read_and_dictionaries_are_checked(spark, tmp_path):
    path, root = public.path(T.VOCABULARY), f"file://{tmp_path}/store"
    rows = [(i, f"some text {i} " * 20, "en", "a") for i in range(200)]
    manifest = T.write_store(docs(spark, rows), root, path)
    shards = manifest.collect()
    found = [x for r in shards if (x := T.read_document(root, r, 77)) is not None]
    assert len(found) == 1 and (found[0] == T.ids_of(rows[77][1], path)).all()
    assert T.read_dictionary(root)
    with pytest.raises(ValueError):
        T.open_shard(shards[0]["path"], b"another")
    empty = T.write_store(docs(spark, []), f"{root}-empty", path)
    assert T.read_store(empty, f"{root}-empty").count() == 0


def test_an_id_of_many_rows_spans_shards(spark, tmp_path):
    path, root = public.path(T.VOCABULARY), f"file://{tmp_path}/store"
    rows = [(7 if i % 3 else i, f"some text {i} " * (i % 9), "en", "a") for i in range(400)] + [(None, f"no id {i}", "en", "a") for i in range(300)]
    manifest = T.write_store(docs(spark, rows), root, path).collect()
    assert len(manifest) == 4 and max(r["n_docs"] for r in manifest) < 350
    got = sorted((r["start"], r["doc_id"], r["n_tokens"], r["ids_crc32"]) for r in T.read_store(spark.createDataFrame(manifest), root).collect())
    ids = sorted(((i if i is not None else -1), zlib.crc32(x.tobytes()), len(x)) for i, t, *_ in rows if (x := T.ids_of(t, path)) is not None)
    at = 0
    for (start, i, n, crc), (j, c, m) in zip(got, ids, strict=True):
        assert (start, -1 if i is None else i, crc, n) == (at, j, c, m)
        at += n


def test_encoder_agrees_whatever_the_lot(monkeypatch):
    from tokenizers import Tokenizer

    tk, own = Tokenizer.from_file(public.path(T.VOCABULARY)), T.Encoder(public.path(T.VOCABULARY))
    rng = random.Random(4)
    texts = ["".join(rng.choice([" ", "\n", " ", "\n", "  "][: 2 + i % 4]) + rng.choice(["water", "Water.", "x" * 90, "a\nb", "", "river,", "<|endoftext|>", "é!", "\t", f"n{i % 7}", "7;"]) for _ in range(12)) for i in range(300)]
    want = [tk.encode(t, add_special_tokens=False).ids for t in (*texts, "")]
    for at_once, together in ((1 << 23, 4096), (200, 3)):
        monkeypatch.setattr(T, "AT_ONCE", at_once)
        monkeypatch.setattr(T, "TOGETHER", together)
        assert [np.frombuffer(b, "<u4")[:-1].tolist() for b in own.batch(pa.array([*texts, None], pa.string()))] == want
    monkeypatch.setattr(own, "begins", {k: ~v for k, v in own.begins.items()})
    assert [np.frombuffer(b, "<u4")[:-1].tolist() for b in own.batch(pa.array(texts[:40], pa.string()))] == want[:40]


@pytest.mark.parametrize("seed", range(3))
def test_ids_equal_the_tokenizers_library(seed):
    from tokenizers import Tokenizer

    tk = Tokenizer.from_file(public.path(T.VOCABULARY))
    rng = random.Random(seed)
    for _ in range(300):
        t = "".join(rng.choice(" \n\t aAbé漢<|endoftext|>\0‍\U0001f600'sre \xa0ß12") for _ in range(rng.randrange(25)))
        assert T.ids_of(t, public.path(T.VOCABULARY))[:-1].tolist() == tk.encode(t, add_special_tokens=False).ids


# ---- pipeline


def test_rows_that_share_an_id_but_not_a_text_stay(spark):
    rows = [(1, "one text of its own here", "en", "a"), (1, "quite another text than that", "en", "a"), (1, "one text of its own here", "en", "b"), (2, "something else again", "en", "a"), (None, "x", "en", "a"), (None, "x", "en", "a")]
    kept = P.near_duplicates(spark, docs(spark, rows), "").collect()
    assert sorted((r["doc_id"] or 0, r["text"]) for r in kept) == [(0, "x"), (0, "x"), (1, "one text of its own here"), (1, "quite another text than that"), (2, "something else again")]


def test_pipeline_against_brute_force(spark, tmp_path):
    import hashlib

    import sentencepiece

    words = {"en": "the of and with house water tree night river stone", "de": "der und nicht mit haus wasser baum nacht fluss stein"}
    rng = random.Random(8)
    rows = [(i, " ".join(rng.choice(words[lang].split()) for _ in range(60)), lang, f"s{i % 3}") for i, lang in ((i, ("en", "de")[i % 2]) for i in range(60))]
    rows += [(100, rows[3][1], "de", "s0"), (101, rows[4][1] + " end", "en", "s1"), (102, None, "en", "s1"), (103, "123 !!", "en", "s1"), (104, "the water token = 'abcdefgh99' of night", "en", "s2"), (104, "the water token = 'abcdefgh99' of night", "en", "s2")]
    df = docs(spark, rows, extra=False)
    df.write.parquet(f"{tmp_path}/documents.parquet")
    got = {r["doc_id"]: r for r in P.run(spark, str(tmp_path)).collect()}
    links = brute_join(rows, 5, 80)
    kept = {i for i in links if links[i][1] == i} - {102, 103}
    assert set(got) == kept and {100, 101} & kept == set()
    sp = sentencepiece.SentencePieceProcessor(model_file=public.path(C.MODEL))
    texts = {i: t for i, t, *_ in rows} | {104: "the water [SECRET]' of night"}
    for i, r in got.items():
        assert r["ids_sha256"] == hashlib.sha256(",".join(map(str, sp.encode(texts[i]))).encode()).hexdigest()


def test_the_mix_is_the_order_of_the_result(spark, tmp_path, monkeypatch):
    """The last stage's file and row follow slot and place, after the Parquet read, over several files read in any order."""
    rows = [(i, f"{i} house tree " * (1 + i % 9), "en", f"s{i % 5 if i % 3 else 0}") for i in range(900)]
    df = docs(spark, rows, extra=False)
    monkeypatch.setattr(M.mix, "__defaults__", (None, 300, None, M.ADDED))
    want = [r["doc_id"] for r in sorted(M.mix(df).collect(), key=lambda r: (r["slot"], r["place"]))]
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        P.mixing(spark, df, "").write.parquet(f"{tmp_path}/mixed")
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert len(list((tmp_path / "mixed").glob("part-*"))) > 1
    got = P.encoding(spark, spark.read.parquet(f"{tmp_path}/mixed"), "").collect()
    assert [r["doc_id"] for r in sorted(got, key=lambda r: (r["mix_file"], r["mix_row"]))] == want
    assert {r["mix_file"] for r in P.encoding(spark, df, "").collect()} == {None}


def test_stages_return_the_columns_of_documents(spark, tmp_path):
    """Columns that are called as an operator's own come out with their values."""
    df = docs(spark, TEXTS).selectExpr("*", "'mine' AS slot", "0.5D AS weight", "7 AS PLACE", "1 AS __mix_key")
    df = df.withColumn("block", F.col("doc_id") * 3)
    own = {r["doc_id"]: r["block"] for r in df.filter("doc_id < 10").collect()}
    for name, stage in P.STAGES[:-1]:
        out = stage(spark, df, "")
        assert out.columns == df.columns, name
        rows = out.collect()
        assert {r["slot"] for r in rows} == {"mine"} and {r["secret_spans"] for r in rows} == {"y"} and {r["weight"] for r in rows} == {0.5}, name
        assert all(r["block"] == own[r["doc_id"]] for r in rows if r["doc_id"] in own), name
        assert stage(spark, docs(spark, []), "").count() == 0, name
    assert P.STAGES[-1][1](spark, df, "").count() == len(TEXTS)
