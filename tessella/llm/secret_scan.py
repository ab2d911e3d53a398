"""Operator 2, secret scans: rules, and a character convolutional network over every other candidate.

Three rules give the base findings: ``assign`` (a named value), ``access`` (an access key id) and ``hex`` (a run of
lower-case hexadecimal digits). Every other run of ``CANDIDATE`` characters is a candidate for the network, kind
``net``: its characters and those around it are embedded, convolved, max-pooled and scored, all in numpy. A candidate
longer than a window is seen whole: windows slide over it, and its score is the greatest of theirs. The network is
trained on labelled findings: what each rule finds in at most ``FOUND_DOCS`` documents, those with the least hash of all
with such a finding that is as long as a candidate (secrets), and the candidates beside it in pieces of at most ``SAMPLE_DOCS`` others (harmless), and, since documents may show few kinds, seeded random keys,
keys inside long paths and look-alikes that are set into those pieces. Half of all is kept apart to calibrate the scores
(a logistic fit) and to choose the threshold: the highest that keeps ``RECALL`` of the labelled secrets, of those of each
rule in the documents as of the seeded ones; ``Scanner.recall`` has what it keeps by kind. Base findings always stay.

Spans are [start, end) in code points of the whole text, leftmost and without overlap within a kind. Of a run that
overlaps base findings, the parts outside them are candidates if they are as long as one; a shorter rest of a key that
touches a finding is redacted with it.

Defined results: a null or empty text has no findings and the digest of the empty string. Repeated rows get equal
results. An empty table gives an empty result. Other columns are ignored. Long texts are scanned whole.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessella.llm.common import least_hashed, sliced

#: The base rules, in the order in which kinds are listed.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]+")
LEAST = {"assign": 8, "access": 16, "hex": 32}
KINDS = ("assign", "access", "hex", "net")

CANDIDATE, LEAST_CANDIDATE = re.compile(r"[A-Za-z0-9+/_=-]{20,}"), 20
#: What a text must hold, at least, for a rule to find anything in it; looked for over whole batches.
HINTS = {"assign": r"(?i)passw|secret|token|api", "access": "AKIA", "hex": "[0-9a-f]{32}", "net": "[A-Za-z0-9+/_=-]{20}"}

#: The network's window: characters before, first and last ones of the candidate, characters after.
BEFORE, FIRST, LAST, AFTER = 16, 32, 8, 8
LENGTH = BEFORE + FIRST + LAST + AFTER
#: From one window on a long candidate to the next: any LEAST_CANDIDATE characters lie whole in one of them.
STEP = 8
#: Most windows that are scored at once.
WINDOWS = 8192
EMBED, WIDTH, FILTERS = 8, 5, 24
SAMPLE_DOCS, SAMPLE_CHARS = 256, 400
#: Documents with base findings of each kind that are learned from, and the characters before and after the first finding.
FOUND_DOCS, FOUND_BEFORE, FOUND_CHARS = 256, 100, 500
RECALL = 0.98


@dataclass
class Scanner:
    params: dict[str, np.ndarray]
    scale: float
    shift: float
    threshold: float
    recall: dict[str, float] = field(default_factory=dict)


def base_spans(text: str, kinds=KINDS[:3]) -> list[tuple[int, int, str]]:
    """(start, end, kind) of the rules' findings, by start, then kind as listed."""
    found = []
    if "assign" in kinds:
        found += [(m.start(), m.end(), "assign") for m in ASSIGN.finditer(text) if len(m[2]) >= LEAST["assign"]]
    if "access" in kinds:
        found += [(m.start(), m.end(), "access") for m in ACCESS.finditer(text) if len(m[0]) >= LEAST["access"]]
    if "hex" in kinds:
        found += [(m.start(), m.end(), "hex") for m in HEX.finditer(text) if len(m[0]) >= LEAST["hex"]]
    return sorted(found, key=lambda x: (x[0], KINDS.index(x[2])))


def candidates(text: str, base: list[tuple[int, int, str]]) -> list[tuple[int, int]]:
    """Runs of candidate characters; of one that overlaps base findings, the parts outside them. ``base`` is in order."""
    out, k = [], 0
    for m in CANDIDATE.finditer(text):
        at, end = m.span()
        while k < len(base) and base[k][1] <= at:
            k += 1
        j = k
        while j < len(base) and base[j][0] < end:
            if base[j][0] - at >= LEAST_CANDIDATE:
                out.append((at, base[j][0]))
            at = max(at, base[j][1])
            j += 1
        if end - at >= LEAST_CANDIDATE:
            out.append((at, end))
    return out


def window(text: str, start: int, end: int) -> np.ndarray:
    """Character codes around and in a candidate (0: none, 127: outside ASCII); those inside are marked by +128."""
    code = lambda s: [min(ord(c), 127) for c in s]
    before, first = code(text[max(0, start - BEFORE) : start]), code(text[start : min(end, start + FIRST)])
    last, after = code(text[max(start + FIRST, end - LAST) : end]), code(text[end : end + AFTER])
    x = np.zeros(LENGTH, np.int16)
    for at, part, inside in ((BEFORE - len(before), before, 0), (BEFORE, first, 128), (BEFORE + FIRST, last, 128), (LENGTH - AFTER, after, 0)):
        x[at : at + len(part)] = np.array(part, np.int16) + inside
    return x


def starts(start: int, end: int) -> range:
    """Where windows of FIRST characters begin on a candidate that one window does not hold; the last ends with it."""
    return range(start, end - FIRST + STEP, STEP) if end - start > FIRST + LAST else range(0)


def windows(text: str, start: int, end: int) -> Iterator[np.ndarray]:
    """All windows of a candidate, at most WINDOWS at once."""
    yield window(text, start, end)[None]
    every = starts(start, end)
    for i in range(0, len(every), WINDOWS):
        yield np.stack([window(text, at, at + FIRST) for at in (min(a, end - FIRST) for a in every[i : i + WINDOWS])])


def _forward(p: dict, x: np.ndarray):
    e = p["embed"][x]  # (n, LENGTH, EMBED)
    cols = np.lib.stride_tricks.sliding_window_view(e, WIDTH, axis=1).transpose(0, 1, 3, 2).reshape(len(x), LENGTH - WIDTH + 1, WIDTH * EMBED)
    z = cols @ p["conv"] + p["bias"]
    best = z.argmax(1)
    top = np.maximum(np.take_along_axis(z, best[:, None, :], 1)[:, 0], 0)
    return top @ p["out"] + p["at"], (cols, best, top)


def raw_scores(p: dict, x: np.ndarray, block: int = 2048) -> np.ndarray:
    return np.concatenate([_forward(p, x[i : i + block])[0] for i in range(0, len(x), block)] or [np.zeros(0)])


def scores(s: Scanner, x: np.ndarray) -> np.ndarray:
    """Calibrated probabilities."""
    return 1 / (1 + np.exp(-np.clip(s.scale * raw_scores(s.params, x) + s.shift, -60, 60)))


def _makers(pieces: list[str], rng: np.random.Generator):
    """Functions that make a random key, a harmless look-alike, joined words, and text around them."""
    lower, upper, digit = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789"
    pick = lambda chars, k: "".join(chars[i] for i in rng.integers(0, len(chars), k))
    words = [w for p in pieces for w in re.findall(r"[A-Za-z]+", p)] or ["lorem", "ipsum", "dolor", "amet"]
    word = lambda: words[rng.integers(0, len(words))]
    joined = lambda sep: sep.join(word() for _ in range(rng.integers(4, 12)))

    def key() -> str:
        k, kind = int(rng.integers(20, 65)), rng.integers(0, 6)
        alphabet = (lower + upper + digit, lower + upper + digit + "+/", lower + digit, upper + digit, lower + upper + digit + "_-", digit + "ABCDEF")[kind]
        # Public prefixes of key formats.
        prefix = ("", "", "", "sk_live_", "ghp_", "xoxb-", "AIza", "eyJ")[rng.integers(0, 8)]
        return prefix + pick(alphabet, k) + ("=" * int(rng.integers(0, 3)) if kind == 1 else "")

    def harmless() -> str:
        kind = rng.integers(0, 8)
        if kind == 0:
            return joined("")
        if kind in (1, 2, 3):
            return joined("_-/"[kind - 1])
        if kind == 4:
            return pick(digit, int(rng.integers(20, 30)))
        if kind == 5:
            return pick("=-_+/", 1) * int(rng.integers(20, 80))
        if kind == 6:
            return "-".join(pick(digit, int(rng.integers(2, 5))) for _ in range(8))
        return joined("").title() + pick(digit, int(rng.integers(0, 4)))

    def around() -> tuple[str, str]:
        piece = pieces[rng.integers(0, len(pieces))] if pieces else ""
        cut = int(rng.integers(0, len(piece) + 1))
        left = piece[:cut] + (" ", "\n", '"', "= ", ": ", "### ", "(")[rng.integers(0, 7)]
        return left, (" ", "\n", '"', ",", ".", ")", "###")[rng.integers(0, 7)] + piece[cut:]

    return key, harmless, joined, around


def labelled_findings(pieces: list[str], rng: np.random.Generator, n: int = 4000) -> tuple[np.ndarray, np.ndarray]:
    """Windows and labels of random keys and of look-alikes, set into pieces of text."""
    key, harmless, _, around = _makers(pieces, rng)
    xs, ys = [], []
    while len(xs) < n:
        secret = bool(rng.integers(0, 2))
        body = key() if secret else harmless()
        if len(body) < 20:
            continue
        left, right = around()
        xs.append(window(left + body + right, len(left), len(left) + len(body)))
        ys.append(secret)
    return np.stack(xs), np.array(ys, np.float32)


def labelled_runs(pieces: list[str], rng: np.random.Generator, n: int = 1200) -> list[tuple[np.ndarray, np.ndarray]]:
    """Long runs, half of them with a key inside: the windows of each, and their labels. A window that holds a part of a
    key has the label -1, for neither."""
    key, harmless, _, around = _makers(pieces, rng)
    # words of a small sample have few letters beside each other, so made-up ones of syllables stand among them
    pick = lambda chars: chars[rng.integers(0, len(chars))]
    spoken = ["".join(pick("bcdfghjklmnprstvwyz") + pick("aeiouy") + pick(("", "", "n", "r", "s", "t", "l")) for _ in range(rng.integers(1, 5))) for _ in range(2000)]
    words = [w for p in pieces for w in re.findall(r"[A-Za-z]+", p)] or spoken
    joined = lambda sep: sep.join(pick((words, spoken)[rng.integers(0, 2)]) for _ in range(rng.integers(4, 12)))
    runs = []
    while len(runs) < n:
        sep = ("/", "-", "_", "")[rng.integers(0, 4)]
        head, tail = (sep.join((joined(sep), harmless().strip("/"))) if rng.integers(0, 3) == 0 else joined(sep) for _ in range(2))
        secret = key() if rng.integers(0, 2) else ""
        body = sep.join(x for x in (head, secret, tail if rng.integers(0, 4) or not secret else "") if x)
        if len(body) <= FIRST + LAST:
            continue
        left, right = around()
        a, k = len(left), len(left) + len(head) + len(sep)
        x = np.concatenate(list(windows(left + body + right, a, a + len(body))))
        if not secret:
            runs.append((x, np.zeros(len(x), np.float32)))
            continue
        at = np.minimum(np.array(starts(a, a + len(body))), a + len(body) - FIRST)
        held = np.minimum(at + FIRST, k + len(secret)) - np.maximum(at, k)
        y = np.where(held >= LEAST_CANDIDATE, 1, np.where(held <= 0, 0, -1))
        runs.append((x, np.concatenate(([-1], y)).astype(np.float32)))
    return runs


def found_windows(pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Of pieces of documents: windows of what the rules find (labelled 1) and of the candidates beside it (0)."""
    return found_by_kind(pieces)[:2]


def learnable(text: str, base: list[tuple[int, int, str]]) -> list[tuple[int, int, str]]:
    """The values of base findings that are as long as a candidate. An assigned value that is a key by itself is of that kind."""
    values = {m.span(2): "assign" for m in ASSIGN.finditer(text)} if any(kind == "assign" for *_, kind in base) else {}
    values |= {(a, b): kind for a, b, kind in base if kind != "assign"}
    return sorted((a, b, kind) for (a, b), kind in values.items() if b - a >= LEAST_CANDIDATE)


def found_by_kind(pieces: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """As ``found_windows``, with the number of each window's rule, -1 for candidates. A secret that several pieces hold
    counts once, so that what is kept apart is not what was learned."""
    xs, ys, kinds, seen = [np.zeros((0, LENGTH), np.int16)], [], [], set()
    for text in pieces:
        base = base_spans(text)
        for a, b, kind in (*learnable(text, base), *((a, b, None) for a, b in candidates(text, base))):
            if kind and text[a:b] in seen:
                continue
            seen.add(text[a:b])
            xs.append(window(text, a, b)[None])
            ys.append(kind is not None)
            kinds.append(-1 if kind is None else KINDS.index(kind))
    return np.concatenate(xs), np.array(ys, np.float32), np.array(kinds, np.int64)


def train(pieces: list[str], found: list[str] = (), steps: int = 260, seed: int = 11) -> Scanner:
    """From pieces of documents, and pieces with base findings. The same pieces in the same order give the same scanner."""
    rng = np.random.default_rng(seed)
    x, y = labelled_findings(pieces, rng)
    real, real_y, rule = found_by_kind([*found, *pieces])
    mixed = rng.permutation(len(x) + len(real))
    # seeded secrets are a kind of their own, after the rules'
    x, y, kind = np.concatenate((x, real))[mixed], np.concatenate((y, real_y))[mixed], np.concatenate((np.full(len(x), 3), rule))[mixed]
    runs = labelled_runs(pieces, np.random.default_rng(seed + 1))
    half, apart = len(x) // 2, runs[len(runs) // 2 :]
    # learned from: windows of findings and of long runs; kept apart: a candidate each, with all its windows
    late_kind = np.concatenate((kind[half:], np.full(len(apart), 3)))
    late, late_y = [*x[half:, None], *(r for r, _ in apart)], np.concatenate((y[half:], [float((t != 0).any()) for _, t in apart]))
    learned, labels = (np.concatenate((first[:half], *rest)) for first, rest in ((x, [r for r, _ in runs[: len(runs) // 2]]), (y, [t for _, t in runs[: len(runs) // 2]])))
    x, y = learned[labels >= 0], labels[labels >= 0]
    norm = lambda *shape: (rng.standard_normal(shape) / np.sqrt(shape[0] if len(shape) > 1 else 8)).astype(np.float32)
    p = {"embed": norm(256, EMBED) * 4, "conv": norm(WIDTH * EMBED, FILTERS), "bias": np.zeros(FILTERS, np.float32), "out": norm(FILTERS), "at": np.zeros(1, np.float32)}
    m1, m2 = ({k: np.zeros_like(v) for k, v in p.items()} for _ in range(2))
    for step in range(1, steps + 1):
        b = rng.integers(0, len(x), 128)
        z, (cols, best, top) = _forward(p, x[b])
        d = ((1 / (1 + np.exp(-z)) - y[b]) / len(b)).astype(np.float32)
        dtop = d[:, None] * p["out"] * (top > 0)
        rows = np.arange(len(b))[:, None]
        picked = cols[rows, best]  # (n, FILTERS, WIDTH * EMBED)
        de = (dtop[:, :, None] * p["conv"].T[None]).reshape(len(b), FILTERS, WIDTH, EMBED)
        g = {"out": top.T @ d, "at": d.sum(keepdims=True), "bias": dtop.sum(0), "conv": np.einsum("nf,nfc->cf", dtop, picked), "embed": np.zeros_like(p["embed"])}
        np.add.at(g["embed"], x[b][rows[:, :, None], best[:, :, None] + np.arange(WIDTH)], de)
        for k in p:
            m1[k] += np.float32(0.1) * (g[k] - m1[k])
            m2[k] += np.float32(0.01) * (g[k] ** 2 - m2[k])
            p[k] -= np.float32(0.02) * (m1[k] / np.float32(1 - 0.9**step)) / (np.sqrt(m2[k] / np.float32(1 - 0.99**step)) + np.float32(1e-6))
    z, t = np.maximum.reduceat(raw_scores(p, np.concatenate(late)).astype(np.float64), np.cumsum([0, *map(len, late[:-1])])), late_y
    a, c = 1.0, 0.0
    for _ in range(50):  # Newton steps of the logistic fit, lightly held to a = 1
        q = 1 / (1 + np.exp(-np.clip(a * z + c, -60, 60)))
        g, w = np.array([((q - t) * z).sum() + (a - 1), (q - t).sum()]), q * (1 - q)
        h = np.array([[(w * z * z).sum() + 1, (w * z).sum()], [(w * z).sum(), w.sum() + 1e-6]])
        a, c = np.array([a, c]) - np.clip(np.linalg.solve(h, g), -1, 1)
    score = 1 / (1 + np.exp(-np.clip(a * z + c, -60, 60)))
    kept = {name: np.sort(score[(t > 0) & (late_kind == k)]) for k, name in enumerate((*KINDS[:3], "seeded"))}
    kept = {name: q for name, q in kept.items() if len(q)}
    # the conformal quantile: what it keeps of further ones is RECALL or more on average, however few were kept apart
    threshold = float(min(q[max(int((1 - RECALL) * (len(q) + 1)) - 1, 0)] for q in kept.values()))
    return Scanner(p, float(a), float(c), threshold, {name: float((q >= threshold).mean()) for name, q in kept.items()})


def training_pieces(docs: DataFrame) -> list[str]:
    """Pieces of the documents with the least hash; a bounded sample."""
    least = least_hashed(docs.filter("text IS NOT NULL").select("doc_id", "text"), "doc_id", SAMPLE_DOCS, 2)
    at = F.pmod("__h", F.greatest(F.length("text") - SAMPLE_CHARS, F.lit(1)).cast("long")).cast("int") + 1
    rows = least.select("__h", "doc_id", F.substr("text", at, F.lit(SAMPLE_CHARS)).alias("piece")).orderBy("__h", "doc_id", "piece").limit(SAMPLE_DOCS).collect()
    return [r["piece"] for r in rows]


def training_found(docs: DataFrame) -> list[str]:
    """Pieces around a finding of each rule, of the documents with the least hash among all that have one long enough to be
    a candidate, one for each secret: a bounded sample by kind. Every text is searched; a hint of a rule that no finding lacks spares the others
    its pattern."""

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, rows = batch.column(1).cast(pa.string()), []
            masks = {k: pc.match_substring_regex(texts, HINTS[k]).to_numpy(zero_copy_only=False) for k in KINDS[:3]}
            for i in np.flatnonzero(np.any(list(masks.values()), axis=0)):
                text, h = texts[int(i)].as_py(), batch.column(0)[int(i)].as_py()
                first: dict[str, tuple[int, int]] = {}
                for at, to, kind in learnable(text, base_spans(text, [k for k in KINDS[:3] if masks[k][i]])):
                    first.setdefault(kind, (at, to))
                rows += [(h, kind, text[at:to], text[max(at - FOUND_BEFORE, 0) :][:FOUND_CHARS]) for kind, (at, to) in first.items()]
            for at in range(0, len(rows), 1024):
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows[at : at + 1024])], ["h", "kind", "value", "piece"])

    hits = docs.filter("text IS NOT NULL").select(F.xxhash64("doc_id", F.lit(22)).alias("h"), "text").mapInArrow(find, "h long, kind string, value string, piece string")
    place = F.row_number().over(Window.partitionBy("kind").orderBy("h", "piece"))
    values = hits.groupBy("kind", F.xxhash64("value").alias("v")).agg(F.min(F.struct("h", "piece")).alias("first")).select("kind", "first.*")
    rows = values.withColumn("place", place).filter(F.col("place") <= FOUND_DOCS).collect()  # so many of each of three kinds
    return [r["piece"] for r in sorted(rows, key=lambda r: (KINDS.index(r["kind"]), r["place"]))]


def train_on(docs: DataFrame) -> Scanner:
    return train(training_pieces(docs), training_found(docs))


def scan_batch(s: Scanner, texts: pa.Array) -> list[list[tuple[int, int, str]]]:
    """All spans of each text, by start, then kind as listed."""
    masks = {k: pc.fill_null(pc.match_substring_regex(texts, hint), False).to_numpy(zero_copy_only=False) for k, hint in HINTS.items()}
    found: list[list[tuple[int, int, str]]] = [[] for _ in range(len(texts))]
    owners, spans, best = [], [], []
    xs, of, held = [], [], 0

    def flush():
        nonlocal xs, of, held
        for k, score in zip(np.repeat(of, [len(x) for x in xs]), scores(s, np.concatenate(xs)), strict=True):
            best[k] = max(best[k], score)
        xs, of, held = [], [], 0

    for i in np.flatnonzero(np.any(list(masks.values()), axis=0)):
        text = texts[int(i)].as_py()
        found[i] = base_spans(text, [k for k in KINDS[:3] if masks[k][i]])
        if masks["net"][i]:
            for a, b in candidates(text, found[i]):
                owners.append(i)
                spans.append((a, b, "net"))
                best.append(0.0)
                for x in windows(text, a, b):
                    xs.append(x)
                    of.append(len(best) - 1)
                    held += len(x)
                    if held >= WINDOWS:
                        flush()
    if xs:
        flush()
    if owners:
        for i, span, score in zip(owners, spans, best, strict=True):
            if score >= s.threshold:
                found[i].append(span)
        for i in set(owners):
            found[i].sort(key=lambda x: (x[0], KINDS.index(x[2])))
    return found


TOUCHING = re.compile(r"[A-Za-z0-9_-]*")


def redacted(text: str, spans: list[tuple[int, int, str]], mark: str) -> str:
    """The text with ``mark`` for each span and for the rest of a key that touches one."""
    out, at = [], 0
    for a, b, kind in spans:
        if kind != "assign":
            a -= len(TOUCHING.match(text[max(at, a - 128) : a][::-1])[0]) if a > at else 0
            b = TOUCHING.match(text, b).end()
        if a >= at:
            out += [text[at:a], mark]
        at = max(at, b)
    return "".join([*out, text[at:]])


def scan(docs: DataFrame, scanner: Scanner, redact: bool = False, mark: str = "[SECRET]", spans_col: str = "secret_spans") -> DataFrame:
    """Adds ``spans_col`` array<struct<start, end, kind>>; with ``redact`` the texts have ``mark`` in place of them.
    A column of ``docs`` that is called so, in any case, is replaced."""
    schema = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("kind", pa.string())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            k = batch.schema.get_field_index("text")
            found = scan_batch(scanner, batch.column(k).cast(pa.string()))
            cols = list(batch.columns)
            if redact and any(found):
                cols[k] = pa.array([redacted(t.as_py(), f, mark) if f else t.as_py() for t, f in zip(batch.column(k), found, strict=True)], pa.string())
            spans = pa.array([[{"start": a, "end": b, "kind": kind} for a, b, kind in f] for f in found], schema)
            yield pa.RecordBatch.from_arrays([*cols, spans], [*batch.schema.names, spans_col])

    kept = docs.select(*[c for c in docs.columns if c.lower() != spans_col.lower()])
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema.fields)
    return kept.mapInArrow(run, f"{fields}, {spans_col} array<struct<start:long,end:long,kind:string>>")


def digest(spans: list[tuple[int, int, str]]) -> str:
    return hashlib.sha256(",".join(f"{k}:{a}:{b}" for a, b, k in spans).encode()).hexdigest()


def op2_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    found = scan(docs.select("doc_id", "text"), train_on(docs))
    joined = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    count = lambda kind: F.size(F.filter("secret_spans", lambda s: s["kind"] == kind)).cast("long")
    base = F.filter("secret_spans", lambda s: s["kind"] != "net")
    return found.select("doc_id", *[count(k).alias(f"n_{k}") for k in KINDS[:3]], F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("secret_spans")).alias("spans"), count("net").alias("n_net"))
