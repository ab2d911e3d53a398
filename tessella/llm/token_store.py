"""Operator 6, token-id output: shards of ids, each document compressed with one shared zstandard dictionary.

A shard holds the documents of one range of doc_id, in ascending order. Its layout, all numbers little-endian:

    "TSLTOK01"                                magic
    frames                                    one zstandard frame for each document: its ids as unsigned 32-bit
    index                                     for each document: doc_id i64, start u64, n_tokens u32, offset u64, size u32
    sha256 of the dictionary                  32 bytes
    n_documents u64, offset of the index u64, "TSLTOK01"

``start`` counts ids from the shard's first one; the manifest (a small table) has each shard's path and the ids of all
shards before it. One document is read with the footer, its index entry and its frame. The dictionary is trained on the
serialized ids of at most ``SAMPLE_DOCS`` documents, those with the least hash, and lies beside the shards; a reader
refuses a dictionary whose hash differs.

Ids come from the tokenizers library as the file sets it up, with ``add_special_tokens=False``. The file's own pattern
begins a new word at every space, and at every line feed, before another character, so a text is cut there and each
distinct part of a lot of texts encoded once: the parts go to the library as one text, in which a part's first id is the
only one that begins with a space or line feed. Tests hold the ids equal to the library's for whole texts.

A shard is written under a temporary name and moved, so that a task which runs twice leaves one whole file.

Defined results: a null text is an empty one and has the end id alone. A null doc_id comes first. Rows that share a
doc_id are separate documents, in the order of a hash of their ids; a doc_id of many rows spans shards. An empty table
gives no shards. Other columns are ignored. A control string in a text gets the id that the file gives it. The dictionary
sees the first ``SAMPLE_CHARS`` characters of a sampled text (texts are encoded whole); where the sample is too small to
train on, it is empty.
"""

from __future__ import annotations

import hashlib
import os
import re
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.llm.common import least_hashed, scratch_dir, sliced

MAGIC = b"TSLTOK01"
INDEX = np.dtype([("doc_id", "<i8"), ("start", "<u8"), ("n_tokens", "<u4"), ("offset", "<u8"), ("size", "<u4")])
END_ID = 2
VOCABULARY = "byte_bpe_50k.json"
#: Bytes of texts whose distinct parts are encoded once; parts that go to the library as one text.
AT_ONCE, TOGETHER = 1 << 23, 4096
SAMPLE_DOCS, SAMPLE_CHARS, DICTIONARY_BYTES, LEVEL = 512, 32_768, 65_536, 3
_NONE = np.iinfo(np.int64).min


#: Texts with a space or line feed that begins no word, since white space or the end follows; a space that begins one. All
#: white space of Unicode, and more, counts here: a text that is cut less is as right.
ODD = "[\\x20\\n](?:[\\x09-\\x0d\\x1c-\\x20\\x{85}\\x{a0}\\x{1680}\\x{2000}-\\x{200b}\\x{2028}\\x{2029}\\x{202f}\\x{205f}\\x{3000}]|\\z)"
#: Letters and one mark after them, which the pattern parts.
MARKED = "^(?P<stem>[A-Za-zÀ-ÖØ-öø-ÿ]+)(?P<mark>[.,;:!?])$"


def places(size: np.ndarray, begin: np.ndarray) -> np.ndarray:
    """Indices of ranges that begin at ``begin`` and have ``size`` items, one after the other."""
    return np.repeat(begin - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))


class Encoder:
    """Ids of texts by the library, distinct parts once: a part is what stands between spaces or line feeds, with the one
    before it. Nothing is kept from one lot of texts to the next, so memory is bounded by the lot."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.library = Tokenizer.from_file(path)
        words = self.library.get_vocab()
        begins = lambda sign: np.array([w.startswith(sign) for w, _ in sorted(words.items(), key=lambda x: x[1])])
        self.begins = {" ": begins("Ġ"), "\n": begins("Ċ")}
        self.marks = {m: int(self.plain([m])[0][0]) for m in ".,;:!?"}

    def plain(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, "<u4") for e in self.library.encode_batch_fast(texts, add_special_tokens=False)]

    def parts(self, words: pa.Array, sign: str) -> tuple[np.ndarray, np.ndarray]:
        """Ids, one after the other, and numbers of ids of words without a space or line feed, each with ``sign`` before it."""
        at = np.append(np.arange(0, len(words), TOGETHER), len(words)).astype(np.int32)
        texts = pc.binary_join(pa.ListArray.from_arrays(pa.array(at), words), sign).to_pylist()
        ids = np.concatenate([np.zeros(0, "<u4"), *self.plain([sign + t for t in texts])])
        start = np.flatnonzero(self.begins[sign][ids])
        if len(start) != len(words):  # a control string, or a token of several, begins with the sign, as in no known file
            each = self.plain([sign + w for w in words.to_pylist()])
            return np.concatenate([np.zeros(0, "<u4"), *each]), np.array([len(x) for x in each], np.int64)
        return ids, np.diff(np.append(start, len(ids)))

    def marked(self, words: pa.Array, sign: str) -> tuple[np.ndarray, np.ndarray]:
        """As ``parts``; a mark after letters is a token of its own, so words that differ in it alone are encoded once."""
        found = pc.extract_regex(words, MARKED)
        mark = pc.fill_null(pc.index_in(found.field("mark"), pa.array(list(self.marks))), -1).to_numpy()
        has = pc.is_valid(found)
        stems = pc.if_else(has, found.field("stem"), words).dictionary_encode()
        ids, size = self.parts(stems.dictionary, sign)
        stem, n = stems.indices.to_numpy(), (mark >= 0).astype(np.int64)
        whole = size[stem] + n
        out = ids[np.minimum(places(whole, (np.cumsum(size) - size)[stem]), len(ids) - 1)] if len(ids) else ids
        out[(np.cumsum(whole) - 1)[mark >= 0]] = np.array(list(self.marks.values()), "<u4")[mark[mark >= 0]]
        return out, whole

    def some(self, texts: pa.Array) -> Iterator[bytes]:
        """Ids of a few texts, none of them null, with the end id. Arrow splits texts and finds the distinct parts; a text
        with a space or line feed before other white space goes to the library whole."""
        odd = pc.match_substring_regex(texts, ODD)
        lines = pc.split_pattern(texts.filter(pc.invert(odd)), "\n")
        even = pc.split_pattern(lines.flatten(), " ")
        flat, n_lines, n_words = even.flatten(), lines.value_lengths().to_numpy(), even.value_lengths().to_numpy()
        line = np.cumsum(n_words) - n_words  # the first part of each line, and of each text
        first = line[np.cumsum(n_lines) - n_lines]
        spaced, fed = np.ones(len(flat), bool), np.zeros(len(flat), bool)
        spaced[line], fed[line], fed[first] = False, True, False
        kinds = []
        for held, sign in ((spaced, " "), (fed, "\n")):
            own = flat.filter(pa.array(held)).dictionary_encode()
            kinds.append((held, own.indices.to_numpy(), *self.marked(own.dictionary, sign)))
        starts = self.plain(flat.take(pa.array(first)).to_pylist())
        ids = np.concatenate([np.zeros(0, "<u4"), *(k[2] for k in kinds), *starts])
        size = np.concatenate([*(k[3] for k in kinds), np.array([len(x) for x in starts], np.int64)]).astype(np.int64)
        part, base = np.zeros(len(flat), np.int64), 0
        for held, index, _, sizes in kinds:
            part[held] = base + index
            base += len(sizes)
        part[first] = base + np.arange(len(first))
        n = size[part]
        row_ends = np.cumsum(np.add.reduceat(n, first) + 1) if len(first) else np.zeros(0, np.int64)
        out = np.full(int(n.sum()) + len(first), END_ID, "<u4")
        held = np.ones(len(out), bool)
        held[row_ends - 1] = False
        out[held] = ids[places(n, (np.cumsum(size) - size)[part])]
        data, place, end = out.tobytes(), np.concatenate(([0], row_ends * 4)).tolist(), np.array([END_ID], "<u4").tobytes()
        whole = iter([x.tobytes() + end for x in self.plain(texts.filter(odd).to_pylist())])
        row = 0
        for o in odd.to_pylist():
            if o:
                yield next(whole)
            else:
                yield data[place[row] : place[row + 1]]
                row += 1

    def batch(self, texts: pa.Array) -> Iterator[bytes]:
        """Ids of each text, with the end id."""
        texts = texts.cast(pa.string()).fill_null("")
        size = np.cumsum(pc.binary_length(texts).to_numpy())
        at = 0
        while at < len(texts):
            to = max(at + 1, int(np.searchsorted(size, (size[at - 1] if at else 0) + AT_ONCE, "right")))
            yield from self.some(texts[at:to])
            at = to


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def ids_of(text: str | None, path: str) -> np.ndarray:
    """The ids of one text, with the end id."""
    return np.frombuffer(next(encoder(path).batch(pa.array([text], pa.string()))), "<u4")


def train_dictionary(docs: DataFrame, path: str) -> bytes:
    """A dictionary from a bounded sample; empty if the sample is too small to train on."""
    import zstandard

    least = least_hashed(docs.filter("text IS NOT NULL").select("doc_id", "text"), "doc_id", SAMPLE_DOCS, 6)
    rows = least.select("__h", "doc_id", F.substr("text", F.lit(1), F.lit(SAMPLE_CHARS)).alias("t")).orderBy("__h", "doc_id", "t").limit(SAMPLE_DOCS).collect()
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, list(encoder(path).batch(pa.array([r["t"] for r in rows], pa.string())))).as_bytes()
    except zstandard.ZstdError:
        return b""


def _tools(dictionary: bytes):
    import zstandard

    shared = zstandard.ZstdCompressionDict(dictionary) if dictionary else None
    return zstandard.ZstdCompressor(level=LEVEL, dict_data=shared, write_content_size=True), zstandard.ZstdDecompressor(dict_data=shared)


def file_system(uri: str) -> tuple[pafs.FileSystem, str]:
    """The file system of a URI that Arrow knows: file, hdfs, viewfs, s3, gs, abfs, abfss; Spark's s3a is Arrow's s3."""
    return pafs.FileSystem.from_uri(re.sub(r"^s3[an]:", "s3:", uri))


def write_file(path: str, chunks) -> None:
    """Write to a file system by URI under another name, then move it into place."""
    fs, at = file_system(path)
    own = f"{at}.{uuid.uuid4().hex}.tmp"
    with fs.open_output_stream(own) as out:
        for chunk in chunks:
            out.write(chunk)
    fs.move(own, at)


def write_store(docs: DataFrame, root: str, path: str) -> DataFrame:
    """Writes all documents; returns the manifest: shard, path, n_docs, n_tokens, first (ids of all shards before)."""
    spark = docs.sparkSession
    docs = docs.select("doc_id", "text")
    shards = int(spark.conf.get("spark.sql.shuffle.partitions"))
    dictionary = train_dictionary(docs, path)
    fs, at = file_system(root)
    fs.create_dir(at, recursive=True)
    write_file(f"{root}/dictionary", [dictionary])

    # the bounds of the ranges come from the ids alone, a sketch of bounded size; an id of many rows is several bounds
    cuts = docs.select(F.percentile_approx(F.coalesce("doc_id", F.lit(_NONE)), [i / shards for i in range(1, shards)], 10_000)).first()[0] if shards > 1 else []
    cuts = np.sort(np.array(cuts or [], np.int64))

    def compress(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tool, tokens = _tools(dictionary)[0], encoder(path)
        for batch in sliced(batches, 4096):
            ids = list(tokens.batch(batch.column(1)))
            n, crc = np.array([len(x) // 4 for x in ids], np.int64), np.array([zlib.crc32(x) for x in ids], np.int64)
            doc = batch.column(0).fill_null(_NONE).to_numpy()
            low = np.searchsorted(cuts, doc)
            place = low + (np.searchsorted(cuts, doc, "right") - low) * crc // (1 << 32)
            frames = pa.array([tool.compress(x) for x in ids], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(place.astype(np.int32)), pa.array(n), pa.array(crc), frames], ["doc_id", "place", "n", "crc", "frame"])

    def shard(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId()
        index: list[np.ndarray] = []
        done = {"docs": 0, "tokens": 0, "offset": len(MAGIC)}

        def chunks():
            yield MAGIC
            for batch in batches:
                n, frames = batch.column(1).to_numpy(), batch.column(2).to_pylist()
                size = np.array([len(f) for f in frames], np.int64)
                rows = np.zeros(len(frames), INDEX)
                rows["doc_id"], rows["n_tokens"], rows["size"] = batch.column(0).fill_null(_NONE).to_numpy(), n, size
                rows["start"], rows["offset"] = done["tokens"] + np.cumsum(n) - n, done["offset"] + np.cumsum(size) - size
                index.append(rows)
                done["docs"], done["tokens"], done["offset"] = done["docs"] + len(frames), done["tokens"] + int(n.sum()), done["offset"] + int(size.sum())
                yield from frames
            for rows in index:
                yield rows.tobytes()
            yield hashlib.sha256(dictionary).digest()
            yield np.array([done["docs"], done["offset"]], "<u8").tobytes() + MAGIC

        name = f"{root}/shard-{number:06d}"
        write_file(name, chunks())
        yield pa.RecordBatch.from_pylist([{"shard": number, "path": name, "n_docs": done["docs"], "n_tokens": done["tokens"]}])

    frames = docs.mapInArrow(compress, "doc_id long, place int, n long, crc long, frame binary")
    dealt = frames.repartitionById(len(cuts) + 1, F.col("place")).sortWithinPartitions("doc_id", "crc", "frame").select("doc_id", "n", "frame")
    rows = dealt.mapInArrow(shard, "shard long, path string, n_docs long, n_tokens long").collect()  # a row for each shard
    out, first = [], 0
    for r in sorted(rows, key=lambda r: r["shard"]):
        out.append((*r, first))
        first += r["n_tokens"]
    return spark.createDataFrame(out, "shard long, path string, n_docs long, n_tokens long, first long")


def open_shard(path: str, dictionary: bytes):
    """(file, index) of a shard."""
    fs, at = file_system(path)
    f = fs.open_input_file(at)
    foot = 32 + 16 + len(MAGIC)
    tail = f.read_at(foot, f.size() - foot)
    if tail[-len(MAGIC) :] != MAGIC or tail[:32] != hashlib.sha256(dictionary).digest():
        raise ValueError(f"{path}: not a shard of this dictionary")
    n, offset = (int(x) for x in np.frombuffer(tail[32:48], "<u8"))
    return f, np.frombuffer(f.read_at(n * INDEX.itemsize, offset), INDEX)


def read_dictionary(root: str) -> bytes:
    fs, at = file_system(f"{root}/dictionary")
    with fs.open_input_file(at) as f:
        return f.read()


def read_document(root: str, manifest_row, doc_id: int) -> np.ndarray | None:
    """The ids of one document out of the shard that a manifest row names."""
    dictionary = read_dictionary(root)
    f, index = open_shard(manifest_row["path"], dictionary)
    at = np.searchsorted(index["doc_id"], doc_id)
    if at == len(index) or index["doc_id"][at] != doc_id:
        return None
    return np.frombuffer(_tools(dictionary)[1].decompress(f.read_at(int(index["size"][at]), int(index["offset"][at]))), "<u4")


def read_store(manifest: DataFrame, root: str) -> DataFrame:
    """doc_id, start (ids of all documents before), n_tokens, ids_crc32, n_bytes of every document in the shards."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        dictionary = read_dictionary(root)
        _, tool = _tools(dictionary)
        for batch in batches:
            for r in batch.to_pylist():
                f, index = open_shard(r["path"], dictionary)
                for at in range(0, len(index), 4096):
                    part = index[at : at + 4096]
                    crc = [zlib.crc32(tool.decompress(f.read_at(int(x["size"]), int(x["offset"])))) for x in part]
                    ids = part["doc_id"].astype(np.int64)
                    cols = [pa.array(ids, mask=ids == _NONE), pa.array(part["start"].astype(np.int64) + r["first"]), pa.array(part["n_tokens"].astype(np.int64)), pa.array(crc, pa.int64()), pa.array(part["size"].astype(np.int64))]
                    yield pa.RecordBatch.from_arrays(cols, ["doc_id", "start", "n_tokens", "ids_crc32", "n_bytes"])

    n = max(1, int(manifest.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    return manifest.repartition(n, "shard").mapInArrow(read, "doc_id long, start long, n_tokens long, ids_crc32 long, n_bytes long")


def op6_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers as public

    root = f"{scratch_dir(spark)}/tokens-{uuid.uuid4().hex}"
    manifest = write_store(spark.read.parquet(f"{sf_dir}/documents.parquet"), root, public.path(VOCABULARY))
    return read_store(manifest, root).select("doc_id", "start", "n_tokens", "ids_crc32", "n_bytes")
