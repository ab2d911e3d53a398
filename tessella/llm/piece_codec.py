"""Operator 5, SentencePiece encoding and decoding with offsets into the original bytes.

``Normalizer`` does what the model's own normaliser does, but keeps the alignment: at every position the longest prefix
found in the compiled character map (a double-array trie) is replaced, else one character is copied; white space is
then escaped. Each byte of the normalized text knows the original byte it comes from, so that every piece projects to a
span of original bytes. The installed library merges the pieces of the normalized text.

Defined results: a null text is an empty one and has no ids; its decoded text is empty. Repeated rows get equal results.
An empty table gives an empty result. Other columns are ignored. Long texts are encoded whole.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from tessella.llm.common import sliced

MARK = "▁"
MARK_BYTES = MARK.encode()
MODEL = "piece_bpe_32k.model"


class CharMap:
    """The compiled character map: a double-array trie from byte strings to replacements."""

    def __init__(self, blob: bytes):
        size = struct.unpack_from("<I", blob)[0] if blob else 0
        self.units = np.frombuffer(blob, "<u4", size // 4, 4).tolist() if blob else []
        self.texts = blob[4 + size :]

    def longest(self, data: bytes, at: int) -> tuple[int, bytes] | None:
        """(length, replacement) of the longest entry that starts at ``at``."""
        if not self.units:
            return None
        offset = lambda u: (u >> 10) << ((u & (1 << 9)) >> 6)
        node, found = offset(self.units[0]), None
        for i in range(at, len(data)):
            c = data[i]
            node ^= c
            unit = self.units[node]
            if unit & (1 << 31 | 0xFF) != c:
                break
            node ^= offset(unit)
            if unit >> 8 & 1:
                found = (i + 1 - at, self.units[node] & 0x7FFFFFFF)
        if found is None:
            return None
        return found[0], self.texts[found[1] : self.texts.index(b"\0", found[1])]


class Normalizer:
    def __init__(self, spec, suffix: bool = False):
        self.map, self.prefix, self.squeeze, self.escape, self.suffix = CharMap(spec.precompiled_charsmap), spec.add_dummy_prefix, spec.remove_extra_whitespaces, spec.escape_whitespaces, suffix
        self.space = MARK_BYTES if self.escape else b" "
        self.plain = not self.map.units and not self.squeeze and not suffix

    def __call__(self, text: str) -> tuple[str, np.ndarray]:
        """The normalized text, and for each of its bytes, and its end, the original byte offset."""
        data = text.encode()
        if not data:
            return "", np.zeros(1, np.int64)
        if self.plain:
            codes = np.frombuffer(data, np.uint8)
            wide = np.where(codes == 32, len(self.space), 1)
            first = self.space.decode() if self.prefix else ""
            at = np.concatenate((np.zeros(len(first.encode()), np.int64), np.repeat(np.arange(len(data)), wide), [len(data)]))
            return first + (text.replace(" ", MARK) if self.escape else text), at
        units: list[tuple[bytes, int, int]] = []  # replacement, its start and end in the original
        at = 0
        while at < len(data):
            hit = self.map.longest(data, at)
            n = hit[0] if hit else 1
            if not hit:
                while at + n < len(data) and data[at + n] & 0xC0 == 0x80:
                    n += 1
            units.append((hit[1] if hit else data[at : at + n], at, at + n))
            at += n
        if self.squeeze:
            units = self._squeezed(units)
        if not units:
            return "", np.array([len(data)])
        parts, src = [], []
        if self.prefix and not self.suffix:
            parts.append(self.space)
            src += [units[0][1]] * len(self.space)
        for shown, start, _ in units:
            parts.append(shown.replace(b" ", self.space))
            src += [start] * len(parts[-1])
        whole, src = b"".join(parts), [*src, units[-1][2]]
        while self.squeeze and whole.endswith(self.space):
            whole = whole[: -len(self.space)]
            del src[len(whole) + 1 :]
        if self.prefix and self.suffix:
            whole += self.space
            src += [src[-1]] * len(self.space)
        return whole.decode(errors="replace"), np.array(src, np.int64)

    @staticmethod
    def _squeezed(units):
        """No space at the start, one between."""
        out, open_space = [], True
        for shown, start, end in units:
            if open_space:
                shown = shown.lstrip(b" ")
            if shown:
                open_space = shown.endswith(b" ")
                out.append((shown, start, end))
        return out


class Codec:
    def __init__(self, path: str):
        import sentencepiece
        from sentencepiece import sentencepiece_model_pb2

        model = sentencepiece_model_pb2.ModelProto()
        with open(path, "rb") as f:
            model.ParseFromString(f.read())
        self.normalize = Normalizer(model.normalizer_spec, model.trainer_spec.treat_whitespace_as_suffix)
        self.library = sentencepiece.SentencePieceProcessor(model_proto=model.SerializeToString())
        spec = model.normalizer_spec
        spec.precompiled_charsmap, spec.add_dummy_prefix, spec.remove_extra_whitespaces = b"", False, False
        self.merger = sentencepiece.SentencePieceProcessor(model_proto=model.SerializeToString())
        kinds = type(model.pieces[0])
        self.bytes_of = np.array([1 if p.type == kinds.BYTE else len(p.piece.encode()) for p in model.pieces], np.int64)
        self.names = [str(i) for i in range(len(model.pieces))]
        self.exact_sizes = bool(model.trainer_spec.byte_fallback)

    def encode(self, text: str | None) -> tuple[list[int], np.ndarray, np.ndarray]:
        """ids; start and end of each piece in the original bytes."""
        shown, at = self.normalize(text or "")
        ids = self.merger.encode(shown, num_threads=1) if shown else []
        if self.exact_sizes:
            sizes = self.bytes_of[np.array(ids, np.int64)] if ids else np.zeros(0, np.int64)
        else:  # an unknown piece has the length of what it stands for
            sizes = np.array([len(p.surface.encode()) for p in self.merger.encode(shown, out_type="immutable_proto").pieces], np.int64)
        ends = np.cumsum(sizes)
        return ids, at[ends - sizes], at[ends]

    def joined(self, ids: list[int]) -> str:
        return ",".join(map(self.names.__getitem__, ids))

    def decode(self, ids: list[int]) -> str:
        return self.library.decode(ids) if ids else ""


_codecs: dict[str, Codec] = {}


def codec(path: str) -> Codec:
    if path not in _codecs:
        _codecs[path] = Codec(path)
    return _codecs[path]


def encode(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, ids array<int>, starts array<int>, ends array<int>: the pieces and their spans of original bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path)
        for batch in sliced(batches):
            rows = [c.encode(t.as_py()) for t in batch.column(1)]
            lists = [pa.array([r[k] for r in rows], pa.list_(pa.int32())) for k in range(3)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *lists], ["doc_id", "ids", "starts", "ends"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, ids array<int>, starts array<int>, ends array<int>")


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """doc_id, text of rows (doc_id, ids)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path)
        for batch in sliced(batches):
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([c.decode(x or []) for x in batch.column(1).to_pylist()], pa.string())], ["doc_id", "text"])

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, text string")


def round_trip(docs: DataFrame, path: str, keep: tuple[str, ...] = ()) -> DataFrame:
    """Per document: n_tokens, digests of the ids and of the decoded text, n_bytes that the spans reach to, and a
    checksum of the spans (starts, then ends, as little-endian 32-bit integers); then the columns to ``keep``."""
    names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "n_bytes", "spans_crc32"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path)
        for batch in sliced(batches):
            out = []
            for text in batch.column(1):
                ids, starts, ends = c.encode(text.as_py())
                spans = zlib.crc32(ends.astype("<i4").tobytes(), zlib.crc32(starts.astype("<i4").tobytes()))
                out.append((len(ids), hashlib.sha256(c.joined(ids).encode()).hexdigest(), hashlib.sha256(c.decode(ids).encode()).hexdigest(), int(ends[-1]) if len(ends) else 0, spans))
            cols = list(zip(*out, strict=True)) or [[]] * 5
            kinds = (pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(v, k) for v, k in zip(cols, kinds, strict=True)), *batch.columns[2:]], [*names, *keep])

    given = docs.select("doc_id", "text", *keep)
    kept = "".join(f", `{c}` {given.schema[c].dataType.simpleString()}" for c in keep)
    return given.mapInArrow(run, f"doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string, n_bytes long, spans_crc32 long{kept}")


def op5_piece_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return round_trip(spark.read.parquet(f"{sf_dir}/documents.parquet"), public_tokenizers.path(MODEL))
