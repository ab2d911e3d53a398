"""Operator 7, language ID: a bidirectional gated recurrent network over bytes, in numpy.

The lower-cased UTF-8 bytes of a text run, in windows of ``WINDOW`` bytes, through one recurrent layer in each
direction. A softmax labels every byte from both states; a document's probabilities are the mean over all its bytes.
The network is trained here by backpropagation through time on a bounded sample: of each label at most
``DOCS_PER_LABEL`` documents, those with the least hash, each with ``PIECE`` characters from a place that the hash
names. Prediction reads every byte of every text, and nothing but the text.

Defined results: ``und`` with score 0 if a text is null or has no letter, or if no labelled document exists to learn
from. Repeated rows get equal results. An empty table gives an empty result. Other columns are ignored. Long texts are
cut into windows that are handled in blocks of bounded size.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessella.llm.common import sliced

WINDOW = 64
HIDDEN = 8
DOCS_PER_LABEL = 192
PIECE = 512
STEPS = 360
BATCH = 192
#: Bytes that are run at once: bounds the memory of a task.
BLOCK = 1 << 18
UNKNOWN = "und"
LETTER = re.compile(r"[^\W\d_]")
#: The fold that is never learned from: crc32(doc_id as text) mod FOLDS = HELD_OUT.
FOLDS, HELD_OUT = 4, 2
#: Stage of the pipeline: a document goes if its language is unknown or less sure than this.
LEAST_SCORE = 0.3


@dataclass
class Model:
    """labels; of each direction w (gates x 256), u (gates x hidden), c (hidden x 1); o, p: the output layer."""

    labels: list[str]
    params: dict[str, np.ndarray]


def _sigmoid(x: np.ndarray) -> np.ndarray:
    x *= 0.5
    np.tanh(x, out=x)
    x += 1
    x *= 0.5
    return x


def _step(w, u, c, x, h):
    """One step over a batch: x bytes (batch), h (hidden, batch)."""
    n = len(h)
    a = np.take(w, x, axis=1)
    g = u @ h
    zr = _sigmoid(a[: 2 * n] + g[: 2 * n])
    m = g[2 * n :] + c
    t = np.tanh(a[2 * n :] + zr[n:] * m)
    return t + zr[:n] * (h - t), (zr[:n], zr[n:], t, m)


def _run(params: dict, d: str, x: np.ndarray, keep: bool = False):
    """States (time, hidden, batch) of direction d over windows x (time, batch)."""
    w, u, c = (params[k + d] for k in "wuc")
    h = np.zeros((HIDDEN, x.shape[1]), np.float32)
    out, kept = np.empty((len(x), HIDDEN, x.shape[1]), np.float32), []
    for t in range(len(x)) if d == "f" else range(len(x) - 1, -1, -1):
        before = h
        h, parts = _step(w, u, c, x[t], h)
        out[t] = h
        if keep:
            kept.append((t, before, *parts))
    return out, kept


def _softmax(z: np.ndarray, axis: int) -> np.ndarray:
    z = z - z.max(axis=axis, keepdims=True)
    np.exp(z, out=z)
    z /= z.sum(axis=axis, keepdims=True)
    return z


def position_probs(params: dict, x: np.ndarray) -> np.ndarray:
    """Probabilities (time, labels, batch) at every position of windows x (time, batch)."""
    hf, hb = _run(params, "f", x)[0], _run(params, "b", x)[0]
    return _softmax(params["of"] @ hf + params["ob"] @ hb + params["p"][:, None], axis=1)


def _gradients(params: dict, x: np.ndarray, y: np.ndarray) -> dict:
    """Backpropagation through time of the mean cross entropy of all positions; y: label of each window."""
    steps, batch = x.shape
    states = {d: _run(params, d, x, keep=True) for d in "fb"}
    delta = _softmax(params["of"] @ states["f"][0] + params["ob"] @ states["b"][0] + params["p"][:, None], axis=1)
    delta[:, y, np.arange(batch)] -= 1
    delta /= steps * batch
    grads = {"p": delta.sum((0, 2))}
    for d in "fb":
        hs, kept = states[d]
        u = params["u" + d]
        grads["o" + d] = np.einsum("tlb,thb->lh", delta, hs, optimize=True)
        gw, gu, gc = np.zeros_like(params["w" + d].T), np.zeros_like(u), np.zeros_like(params["c" + d])
        dh = np.zeros((HIDDEN, batch), np.float32)
        for t, before, z, r, cand, m in reversed(kept):
            dh = dh + params["o" + d].T @ delta[t]
            dt = dh * (1 - z) * (1 - cand * cand)
            dz = dh * (before - cand) * z * (1 - z)
            dr = dt * m * r * (1 - r)
            dg = np.concatenate((dz, dr, dt * r))  # through the state
            da = np.concatenate((dz, dr, dt))  # through the input
            np.add.at(gw, x[t], da.T)
            gc += (dt * r).sum(1, keepdims=True)
            gu += dg @ before.T
            dh = dh * z + u.T @ dg
        grads |= {"w" + d: gw.T, "u" + d: gu, "c" + d: gc}
    return grads


def windows_of(data: bytes) -> np.ndarray:
    """(time, windows) of a text's bytes; the last window is filled up with spaces."""
    n = -(-len(data) // WINDOW)
    return np.frombuffer(data.ljust(n * WINDOW), np.uint8).reshape(n, WINDOW).T


def train(pieces: list[tuple[str, str]], steps: int = STEPS, seed: int = 7) -> Model:
    """pieces: (text, label). The same pieces in the same order give the same model."""
    labels = sorted({lang for _, lang in pieces})
    rng = np.random.default_rng(seed)
    xs, ys = [], []
    for text, lang in pieces:
        if LETTER.search(text or ""):
            x = windows_of(text.lower().encode())
            xs.append(x)
            ys.append(np.full(x.shape[1], labels.index(lang)))
    if not xs:
        return Model([], {})
    x, y = np.concatenate(xs, axis=1), np.concatenate(ys)
    by = [np.flatnonzero(y == k) for k in range(len(labels))]
    by = [g for g in by if len(g)]
    norm = lambda *shape: (rng.standard_normal(shape) * 0.3).astype(np.float32)
    p = {"p": np.zeros(len(labels), np.float32)}
    for d in "fb":
        p |= {"w" + d: norm(3 * HIDDEN, 256), "u" + d: norm(3 * HIDDEN, HIDDEN), "c" + d: np.zeros((HIDDEN, 1), np.float32), "o" + d: norm(len(labels), HIDDEN)}
    m1, m2 = ({k: np.zeros_like(v) for k, v in p.items()} for _ in range(2))
    for step in range(1, steps + 1):
        pick = np.concatenate([rng.choice(g, max(1, BATCH // len(by))) for g in by])
        rate = np.float32(0.03 * (1 - 0.9 * step / steps))
        for k, g in _gradients(p, x[:, pick], y[pick]).items():
            m1[k] += np.float32(0.1) * (g - m1[k])
            m2[k] += np.float32(0.01) * (g * g - m2[k])
            p[k] = p[k] - rate * (m1[k] / np.float32(1 - 0.9**step)) / (np.sqrt(m2[k] / np.float32(1 - 0.99**step)) + np.float32(1e-6))
    return Model(labels, {k: np.ascontiguousarray(v, np.float32) for k, v in p.items()})


def label_positions(model: Model, text: str | None) -> list[str]:
    """The label of every byte of a text's lower-cased UTF-8 form."""
    data = (text or "").lower().encode()
    if not data or not model.labels:
        return [UNKNOWN] * len(data)
    best = position_probs(model.params, windows_of(data)).argmax(1)
    return [model.labels[k] for k in best.T.reshape(-1)[: len(data)]]


def document_probs(model: Model, texts: list[str]) -> np.ndarray:
    """(texts, labels): the mean over all bytes of each text; zeros where there is no byte."""
    out = np.zeros((len(texts), len(model.labels)))
    sizes = np.zeros(len(texts))
    held: list[tuple[int, np.ndarray, int]] = []
    total = 0

    def flush() -> None:
        nonlocal held, total
        if held:
            x = np.concatenate([h[1] for h in held], axis=1)
            owner = np.repeat([h[0] for h in held], [h[1].shape[1] for h in held])
            probs = position_probs(model.params, x)
            ends = np.cumsum([h[1].shape[1] for h in held]) - 1
            for e, (_, _, short) in zip(ends, held, strict=True):
                if short:
                    probs[WINDOW - short :, :, e] = 0
            sums = probs.sum(0, dtype=np.float64)
            for k in range(len(model.labels)):
                out[:, k] += np.bincount(owner, weights=sums[k], minlength=len(texts))
            held, total = [], 0

    for i, text in enumerate(texts):
        data = text.lower().encode()
        sizes[i] = len(data)
        for at in range(0, len(data), BLOCK):
            part = data[at : at + BLOCK]
            x = windows_of(part)
            held.append((i, x, x.size - len(part)))
            total += x.size
            if total >= BLOCK:
                flush()
    flush()
    return out / np.maximum(sizes, 1)[:, None]


def training_sample(docs: DataFrame) -> list[tuple[str, str]]:
    """(piece, label) of at most DOCS_PER_LABEL labelled documents of each label outside the held-out fold."""
    h = F.xxhash64(F.col("doc_id"), F.lit(7))
    order = Window.partitionBy("lang").orderBy("h", "doc_id", "piece")
    at = F.pmod("h", F.greatest(F.length("text") - PIECE, F.lit(1)).cast("long")).cast("int") + 1
    fit = docs.filter(F.col("lang").isNotNull() & F.col("text").isNotNull() & ~held_out(F.col("doc_id"))).select("doc_id", "lang", "text", h.alias("h")).select("doc_id", "lang", "h", F.substr("text", at, F.lit(PIECE)).alias("piece"))
    rows = fit.withColumn("k", F.row_number().over(order)).filter(F.col("k") <= DOCS_PER_LABEL).collect()
    return [(r["piece"], r["lang"]) for r in sorted(rows, key=lambda r: (r["lang"], r["k"]))]


def held_out(doc_id):
    return F.crc32(doc_id.cast("string").cast("binary")) % FOLDS == HELD_OUT


def _judge(model: Model, texts: pa.Array) -> tuple[list[str], np.ndarray]:
    """Label and score of each text."""
    shown = [t if t and model.labels and LETTER.search(t) else "" for t in texts.to_pylist()]
    if not model.labels:
        return [UNKNOWN] * len(shown), np.zeros(len(shown))
    probs = document_probs(model, shown)
    best = probs.argmax(1)
    score = np.clip(probs[np.arange(len(shown)), best], 0, 1)
    return [model.labels[k] if t else UNKNOWN for k, t in zip(best, shown, strict=True)], score


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, lang_pred, score of every row; no shuffle."""

    def label(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            names, score = _judge(model, batch.column(1))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(names, pa.string()), pa.array(score, pa.float64())], ["doc_id", "lang_pred", "score"])

    return docs.select("doc_id", "text").mapInArrow(label, "doc_id long, lang_pred string, score double")


def keep_known(docs: DataFrame, model: Model, least: float = LEAST_SCORE) -> DataFrame:
    """The rows, unchanged, whose language is known with at least this score; no shuffle."""

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            names, score = _judge(model, batch.column("text"))
            yield batch.filter(pa.array([n != UNKNOWN and s >= least for n, s in zip(names, score, strict=True)], pa.bool_()))

    return docs.mapInArrow(keep, docs.schema)


def identify(docs: DataFrame) -> DataFrame:
    return predict(docs, train(training_sample(docs)))


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return identify(docs).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")
