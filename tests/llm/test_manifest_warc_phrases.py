"""Operators 11 to 13 against plain Python, on tables with every awkward case."""

import base64
import gzip
import hashlib
import random
import zlib
from collections import Counter, defaultdict

import pyarrow.fs as pafs
import pytest

from tessella.llm import merkle_manifest, phrase_mining, warc_store

from .helpers import TEXTS, docs


def H(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def field(v):
    return "-" if v is None else f"{len(str(v).encode())}:{v}"


def plain_manifest(rows):
    """(doc_id, leaf, subroot, root, proof, folded) by walking lists."""

    def tree(nodes):
        levels = [nodes]
        while len(levels[-1]) > 1:
            levels.append([H(*levels[-1][i : i + 8]) for i in range(0, len(levels[-1]), 8)])
        return levels

    def path(levels, i):
        out = []
        for level in levels[:-1]:
            b = i // 8 * 8
            out.append((level[b:i], level[i + 1 : b + 8]))
            i //= 8
        return out

    lower = lambda t: None if t is None else "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t)
    by = defaultdict(list)
    for doc_id, text, lang, source in rows:
        n = None if text is None else len(text)
        leaf = H(*map(field, (doc_id, source, lang, n, text)))
        hit = doc_id is not None and zlib.crc32(str(doc_id).encode()) % 3 == 0
        by[lang].append((doc_id is not None, doc_id or 0, leaf, H(*map(field, (doc_id, source, lang, n, lower(text)))) if hit else leaf))
    langs = sorted(by, key=lambda k: (k is not None, (k or "").encode()))
    trees = {k: tree([r[2] for r in sorted(by[k])]) for k in langs}
    top = tree([trees[k][-1][0] for k in langs])
    out = []
    for place, k in enumerate(langs):
        for i, (has, doc_id, leaf, forged) in enumerate(sorted(by[k])):
            steps = path(trees[k], i) + path(top, place)
            at = forged
            for left, right in steps:
                at = H(*left, at, *right)
            out.append((doc_id if has else None, leaf, trees[k][-1][0], top[-1][0], H(*(x for s in steps for side in s for x in side)), at, at == top[-1][0]))
    return sorted(out, key=repr)


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


@pytest.mark.parametrize("block", [8, 64, 4096])
def test_manifest_equals_plain_trees(spark, block):
    """Trees of one to three rounds of blocks, a single leaf, a null key, equal ids and equal rows."""
    rng = random.Random(block)
    more = [(rng.randrange(-50, 5000), f"Text {i % 97} A", rng.choice(["xx", "xx", "xx", "yy", "Zz"]), "s") for i in range(700)]
    rows = [*TEXTS, *more, *more[:20], (7, "lone", "lone", None)]
    assert rows_of(merkle_manifest.manifest(docs(spark, rows), block)) == plain_manifest(rows)


def test_manifest_of_many_keys_and_of_none(spark):
    rows = [(i, "T", f"k{i % 70:02}", "s") for i in range(150)]
    assert rows_of(merkle_manifest.manifest(docs(spark, rows))) == plain_manifest(rows)
    assert merkle_manifest.manifest(docs(spark, [])).count() == 0
    one = merkle_manifest.manifest(docs(spark, [(1, "lower", None, None)])).first()
    assert one["root"] == one["leaf"] == one["folded_root"] and one["proof_sha256"] == H()


def test_manifest_is_native(spark):
    plan = merkle_manifest.leaves(docs(spark))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan


PAGES = [(1, "http://a/ä b\r\nX: y", "<p>same</p>"), (2, "http://b", "<p>same</p>"), (3, None, None), (4, "http://c", ""), (None, "http://d", "<p>same</p>"), (5, "http://e", "é" * 70_000), (6, "http://f", "é" * 70_000), (6, "http://g", "other"), (6, "http://g", "other"), (-7, "http://h", "WARC/1.1\r\n\r\nx\r\n\r\n")]


def pages(spark, rows):
    return spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "1 AS rid", "2 AS chunk_no", "3 AS total", "'d' AS data")


def plain_records(rows, least=0):
    groups, out = defaultdict(list), []
    for i, (page, _, html) in enumerate(rows):
        groups[(html or "").encode()].append((page is None, page or 0, i))
    for payload, members in groups.items():
        for k, (no_id, page, _) in enumerate(sorted(members)):
            copy = k > 0 and len(payload) >= least
            first = sorted(members)[0]
            out.append((None if no_id else page, len(payload), base64.b32encode(hashlib.sha1(payload).digest()).decode(), "revisit" if copy else "response", first[1] if copy and not first[0] else None))
    return sorted(out, key=repr)


def fresh_root(tmp_path):
    return f"file://{tmp_path}/archives"


@pytest.mark.parametrize("least,size", [(0, 1 << 18), (12, 1000), (0, 1)])
def test_archives_round_trip(spark, tmp_path, least, size):
    rows = PAGES if size > 1 else PAGES[:5] + PAGES[7:]
    index = warc_store.store(pages(spark, rows), fresh_root(tmp_path), least, size)
    read = warc_store.read_archives(index, keep_data=False)
    assert rows_of(read.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")) == plain_records(rows, least)
    chunks = warc_store.read_archives(index, size=size).orderBy("rid", "chunk_no").collect()
    texts, digests = defaultdict(bytes), {}
    for r in chunks:
        assert len(r["data"]) <= size
        texts[r["rid"]] += r["data"]
        assert r["n_bytes"] == len(texts[r["rid"]]) and r["sha1"] == hashlib.sha1(texts[r["rid"]]).digest()
        digests[r["rid"]] = (r["record_type"], r["page_id"], r["url"], r["last"])
    assert all(d[3] for d in digests.values())
    kept = sorted(texts[k].decode() for k, d in digests.items() if d[0] == "response")
    distinct = {h or "" for _, _, h in rows}
    assert set(kept) == distinct
    assert ("response", 1, "http://a/%C3%A4%20b%0D%0AX:%20y", True) in digests.values()


def test_archives_are_warc(spark, tmp_path):
    """Files are whole gzip members with WARC headers whose lengths are right, read here without the operator."""
    warc_store.store(pages(spark, PAGES), fresh_root(tmp_path))
    n, ids = 0, set()
    for f in (tmp_path / "archives").glob("*.warc.gz"):
        data = gzip.decompress(f.read_bytes())
        while data:
            head, _, rest = data.partition(b"\r\n\r\n")
            fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
            length = int(fields["Content-Length"])
            assert rest[length : length + 4] == b"\r\n\r\n"
            data = rest[length + 4 :]
            if fields["WARC-Type"] == "warcinfo":
                continue
            n += 1
            ids.add(fields["WARC-Record-ID"])
            payload = rest[:length].partition(b"\r\n\r\n")[2]
            if fields["WARC-Type"] == "response":
                assert fields["WARC-Payload-Digest"] == "sha1:" + base64.b32encode(hashlib.sha1(payload).digest()).decode()
            else:
                assert payload == b"" and fields["WARC-Profile"].endswith("identical-payload-digest")
    assert n == len(ids) == len(PAGES)


def test_archives_are_read_in_parts_and_checked(spark, tmp_path, monkeypatch):
    rows = [(i, f"http://x/{i}", f"<p>{i}</p>" * 200) for i in range(300)]
    index = warc_store.store(pages(spark, rows), fresh_root(tmp_path))
    monkeypatch.setattr(warc_store, "PART_BYTES", 500)
    assert rows_of(warc_store.read_archives(index, False).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")) == plain_records(rows)
    r = index.filter("offset > 0").first()
    fs, at = pafs.FileSystem.from_uri(r["path"])
    with fs.open_input_file(at) as f:
        data = bytearray(f.read())
    record = gzip.decompress(bytes(data[r["offset"] : r["offset"] + r["length"]])).replace(b"<p>", b"<q>", 1)
    other = f"{at}.changed"
    with fs.open_output_stream(other) as f:
        f.write(gzip.compress(record))
    with fs.open_input_file(other) as f, pytest.raises(ValueError, match="not the one"):
        list(warc_store.read_rows(f, 0, 1, 1000, False))


def test_no_pages(spark, tmp_path):
    assert warc_store.read_archives(warc_store.store(pages(spark, []), fresh_root(tmp_path))).count() == 0


def plain_phrases(rows, least, top, share=100):
    import re

    n, f = Counter(), Counter()
    for _, text, lang, _ in rows:
        lang = lang or "und"
        text = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split("[.,;:!?\n-\r]", text):
            w = [x for x in re.split("[ \t]+", piece) if x]
            n[lang] += len(w)
            f.update((lang, *w[i : i + m]) for m in range(1, 6) for i in range(len(w) - m + 1))
    found = {p: c for p, c in f.items() if len(p) > 2 and c >= least}
    inside = defaultdict(int)
    for p, c in found.items():
        for m in range(2, len(p) - 1):
            for i in range(1, len(p) - m + 1):
                q = (p[0], *p[i : i + m])
                inside[q] = max(inside[q], c)
    out = defaultdict(list)
    for p, a in found.items():
        if p in inside and 100 * inside[p] >= share * a:
            continue
        lang, words = p[0], p[1:]
        cuts = [(1000 * a * n[lang] // (f[(lang, *words[:k])] * f[(lang, *words[k:])]), k) for k in range(1, len(words))]
        score, k = min(cuts)
        phrase = " ".join(words)
        out[lang].append((-score, -a, phrase.encode(), phrase, a, f[(lang, *words[:k])], f[(lang, *words[k:])], n[lang], score))
    return sorted((lang, i + 1, *r[3:]) for lang, rs in out.items() for i, r in enumerate(sorted(rs)[:top]))


def zipf_texts(n, seed):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(40)] + ["É", "the", "of"] * 8 + ["x"]
    out = []
    for i in range(n):
        body = [rng.choice(words) + rng.choice(["", "", "", ",", ".", "\n", ";"]) for _ in range(rng.randrange(0, 60))]
        body[5:5] = rng.choice([[], [], "The quick  brown\tfox jumps over".split(" "), ["so"] * 9])
        out.append((i % 37, " ".join(body), rng.choice(["en", "en", "en", None, "und", "fr"]), "s"))
    return out


@pytest.mark.parametrize("hot,top,share", [(1000, 2000, 100), (40, 2000, 60), (4, 7, 100), (100_000, 3, 101)])
def test_phrases_equal_plain_counts(spark, hot, top, share):
    """At several shares from which a prefix is split; 40 is met by some prefixes here, 4 by none, 100000 by all."""
    rows = [*TEXTS, *zipf_texts(400, hot)]
    got = phrase_mining.collocations(docs(spark, rows), 12, top, share, hot)
    assert sorted(tuple(r) for r in got.collect()) == plain_phrases(rows, 12, top, share)


def test_one_pair_holds_most_of_the_rows(spark):
    rows = [(i, f"the of {'abc'[i % 3]} {i % 7} z. the of {i % 2}", "en", "s") for i in range(300)] + [(1, "the of the of the of", "en", "s")] * 50
    got = phrase_mining.collocations(docs(spark, rows), 20, 2000, 100, 1000)
    assert sorted(tuple(r) for r in got.collect()) == plain_phrases(rows, 20, 2000)


def test_growth_is_the_same_however_the_pointers_are_cut():
    """Runs that go on in the next batch are summed to the same counts."""
    import numpy as np

    rng = np.random.default_rng(3)
    rows = sorted((*map(int, rng.integers(1, 4, 5)), int(rng.integers(1, 9))) for _ in range(400))
    cols, n = [np.array([r[k] for r in rows]) for k in range(5)], np.array([r[5] for r in rows])
    want = Counter()
    for r in rows:
        for m in (3, 4, 5):
            want[r[:m]] += r[5]
    want = {p: c for p, c in want.items() if c >= 30}
    for size in (1, 7, 50, 400):
        got = Counter()
        for at in range(0, 400, size):
            for p, c in phrase_mining.grow([c[at : at + size] for c in cols], n[at : at + size], np.full(len(n[at : at + size]), 2), 30):
                got[tuple(p)] += c
        assert {p: c for p, c in got.items() if c >= 30} == want


def test_large_counts_are_exact(spark):
    """Products beyond 64 bits."""
    a, n, f = 3 * 10**15, 9 * 10**16 + 7, 4 * 10**15 + 1
    found = spark.createDataFrame([([1, 2], a)], "words array<long>, f long")
    words = spark.createDataFrame([("en", "a", 1, f, n), ("en", "b", 2, f + 2, n)], "lang string, word string, id long, f long, n long")
    assert phrase_mining.scored(found, words).first()["score"] == 1000 * a * n // (f * (f + 2))


def test_no_phrases(spark):
    assert phrase_mining.collocations(docs(spark, [])).count() == 0
    assert phrase_mining.collocations(docs(spark)).count() == 0  # words repeat there, phrases not so often
    assert sorted(tuple(r) for r in phrase_mining.collocations(docs(spark), 2).collect()) == plain_phrases(TEXTS, 2, 2000)
