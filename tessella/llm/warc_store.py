"""Operator 13, WARC: archives written from, and read back into, a table of chunks.

A payload is rows of one record identifier and ascending chunk numbers, at most ``CHUNK`` bytes each, and every row has the
bytes and the SHA-1 of all chunks so far: the last row knows its whole record, and no task holds one. Writer and reader
stream such rows, so their memory is a chunk, however long a record is.

An archive is WARC/1.1, one gzip member for each record, after a ``warcinfo`` record. The block of a record is an HTTP
header and, in a ``response``, the payload. Of records with equal payloads (number of bytes and SHA-1) the one with the
smallest id is the ``response``; the others are ``revisit`` records of the profile identical-payload-digest that refer to
it, whose HTTP header keeps the payload's number of bytes. Payloads of less than ``least`` bytes are all responses. Record
identifiers are ``<urn:page:ID:ROW>``, so a reference leads to the id it is of. Archives are written under a temporary name
and moved, and their bytes follow from the rows alone, so a task that runs twice leaves one whole file. The index has each
record's archive, offset and length; it divides long archives among readers at the borders of records.

Defined results: a null payload is an empty one. A null id counts as larger than any other and is read back as null. Rows
that share an id are separate records; of equal rows one is the response. Control characters, spaces and what is not ASCII
are percent-encoded in an address; a null address has no header. An empty table gives no archives and no rows. Other columns
are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.llm.common import materialize, scratch_dir, sliced, table
from tessella.llm.token_store import file_system, write_file

CHUNK, SHARD_BYTES, PART_BYTES, READ = 1 << 18, 1 << 28, 1 << 26, 1 << 18
LEAST = 0
#: Bytes of chunks in one Arrow batch; shares of a group of copies.
BATCH_BYTES, SALTS = 1 << 22, 64
DATE = "1970-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_HEAD_MOST = 1 << 16

_CHUNKS = pa.schema([("rid", pa.int64()), ("page_id", pa.int64()), ("url", pa.string()), ("chunk_no", pa.int32()), ("data", pa.binary()), ("n_bytes", pa.int64()), ("sha1", pa.binary()), ("last", pa.bool_())])
_READ = pa.schema([("rid", pa.int64()), ("page_id", pa.int64()), ("url", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("chunk_no", pa.int32()), ("data", pa.binary()), ("n_bytes", pa.int64()), ("sha1", pa.binary()), ("last", pa.bool_()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string())])
_DDL = {pa.int64(): "long", pa.string(): "string", pa.int32(): "int", pa.binary(): "binary", pa.bool_(): "boolean"}


def _ddl(schema: pa.Schema) -> str:
    return ", ".join(f"{f.name} {_DDL[f.type]}" for f in schema)


def _batches(rows, schema: pa.Schema, size) -> Iterator[pa.RecordBatch]:
    """Rows as Arrow batches of about ``BATCH_BYTES``."""
    held, n = [], 0
    for row in rows:
        held.append(row)
        n += size(row) + 256
        if n >= BATCH_BYTES:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), schema)], schema=schema)
            held, n = [], 0
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), schema)], schema=schema)


def chunked(pages: DataFrame, size: int = CHUNK) -> DataFrame:
    """``page_id``, ``url`` and ``html`` as rows of chunks. The payload is never copied as a whole: chunks are slices of the
    row's own buffer."""

    def rows(batches):
        for batch in sliced(batches):
            rid, page, url, payloads = (batch.column(i) for i in range(4))
            for r, p, u, payload in zip(rid.to_pylist(), page.to_pylist(), url.to_pylist(), payloads):
                data, digest = payload.as_buffer() if payload.is_valid else b"", hashlib.sha1()
                n = len(data) if isinstance(data, bytes) else data.size
                for no, at in enumerate(range(0, max(n, 1), size)):
                    part = data[at : at + size] if isinstance(data, bytes) else data.slice(at, min(size, n - at)).to_pybytes()
                    digest.update(part)
                    yield r, p, u, no, part, at + len(part), digest.digest(), at + size >= n

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from _batches(rows(batches), _CHUNKS, lambda row: len(row[4]))

    given = pages.select(F.monotonically_increasing_id().alias("rid"), F.col("page_id").cast("long"), F.col("url").cast("string"), F.encode(F.col("html"), "UTF-8").alias("payload"))
    return given.mapInArrow(split, _ddl(_CHUNKS))


def roles(chunks: DataFrame, least: int = LEAST) -> DataFrame:
    """``rid``, the payload's ``total`` bytes and ``digest``, and for revisits the response (``first_page``, ``first_rid``).
    Equal payloads meet in shares, so no task has a large group of copies."""
    ends = chunks.filter("last").select("rid", "page_id", F.col("n_bytes").alias("total"), F.col("sha1").alias("digest"), F.pmod("rid", F.lit(SALTS)).alias("share"))
    key = ["digest", "total"]
    shares = ends.groupBy(*key, "share").agg(F.min(F.struct(F.col("page_id").isNull().alias("no_id"), "page_id", "rid")).alias("first"))
    firsts = shares.groupBy(*key).agg(F.min("first").alias("first"))
    found = ends.join(shares.drop("first").join(firsts, key), [*key, "share"])
    copy = (F.col("first.rid") != F.col("rid")) & (F.col("total") >= least)
    return found.select("rid", "total", "digest", F.when(copy, F.col("first.page_id")).alias("first_page"), F.when(copy, F.col("first.rid")).alias("first_rid"))


def base32(sha1: bytes) -> str:
    return base64.b32encode(sha1).decode()


def record_id(page_id: int | None, rid: int) -> str:
    return f"<urn:page:{'' if page_id is None else page_id}:{rid}>"


def address(url: str) -> str:
    return "".join(c if "!" <= c <= "~" else "".join(f"%{b:02X}" for b in c.encode()) for c in url)


def _header(fields: list[tuple[str, str]]) -> bytes:
    return ("WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields) + "\r\n").encode()


def record_head(rid: int, page_id: int | None, url: str | None, total: int, sha1: bytes, first: tuple[int | None, int] | None) -> bytes:
    """All of a record before its payload: the WARC header and the HTTP header."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {total}\r\n\r\n".encode()
    fields = [("WARC-Type", "revisit" if first else "response"), ("WARC-Record-ID", record_id(page_id, rid)), ("WARC-Date", DATE)]
    fields += [("WARC-Target-URI", address(url))] if url is not None else []
    fields += [("WARC-Payload-Digest", f"sha1:{base32(sha1)}"), ("Content-Type", "application/http; msgtype=response"), ("Content-Length", str(len(http) + (0 if first else total)))]
    fields += [("WARC-Refers-To", record_id(*first)), ("WARC-Profile", PROFILE)] if first else []
    return _header(fields) + http


def _info() -> bytes:
    body = b"software: tessella\r\nformat: WARC File Format 1.1\r\n"
    return _header([("WARC-Type", "warcinfo"), ("WARC-Record-ID", "<urn:page-archive:info>"), ("WARC-Date", DATE), ("Content-Type", "application/warc-fields"), ("Content-Length", str(len(body)))]) + body + b"\r\n\r\n"


def write_archives(chunks: DataFrame, records: DataFrame, root: str) -> DataFrame:
    """Writes all records below ``root``; returns the index: path, offset, length of each record, with its ``rid``."""
    total = records.agg(F.sum("total")).first()[0] or 0
    n = max(int(chunks.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-total // SHARD_BYTES))
    fs, at = file_system(root)
    fs.create_dir(at, recursive=True)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        path, index, offset = f"{root}/part-{TaskContext.get().partitionId():06d}.warc.gz", [], 0
        first = next(batches, None)
        if first is None:
            return

        def rows():
            yield from first.to_pylist()
            for batch in batches:
                for small in sliced(iter([batch]), 16):
                    yield from small.to_pylist()

        def stream():
            nonlocal offset
            tool = zlib.compressobj(6, zlib.DEFLATED, 31)
            out = tool.compress(_info()) + tool.flush()
            offset += len(out)
            yield out
            begin = offset
            for row in rows():
                if row["chunk_no"] == 0:
                    tool, begin = zlib.compressobj(6, zlib.DEFLATED, 31), offset
                    copy = None if row["first_rid"] is None else (row["first_page"], row["first_rid"])
                    out = tool.compress(record_head(row["rid"], row["page_id"], row["url"], row["total"], row["digest"], copy))
                    offset += len(out)
                    yield out
                out = tool.compress(row["data"]) if row["data"] else b""
                if row["end"]:
                    out += tool.compress(b"\r\n\r\n") + tool.flush()
                    index.append((path, begin, offset + len(out) - begin, row["rid"]))
                offset += len(out)
                yield out

        write_file(path, stream())
        for k in range(0, len(index), 4096):
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*index[k : k + 4096])], ["path", "offset", "length", "rid"])

    # both sides are dealt alike, so the join and the archives share one exchange
    dealt = chunks.repartition(n, "rid").join(records.repartition(n, "rid"), "rid").filter("first_rid IS NULL OR chunk_no = 0")
    copy = F.col("first_rid").isNotNull()
    rows = dealt.select("rid", "chunk_no", F.when(F.col("chunk_no") == 0, F.col("page_id")).alias("page_id"), "url", F.when(~copy, F.col("data")).alias("data"), (F.col("last") | copy).alias("end"), "total", "digest", "first_page", "first_rid")
    return materialize(rows.sortWithinPartitions("rid", "chunk_no").mapInArrow(write, "path string, offset long, length long, rid long"), "warc-index")


class Members:
    """The decompressed bytes of the gzip members of a file that begin in [start, end), as they are asked for."""

    def __init__(self, file, start: int, end: int):
        self.file, self.end, self.begin = file, end, start
        file.seek(start)
        self.raw, self.tool, self.held = b"", None, bytearray()

    def begin_next(self) -> bool:
        """Goes to the next member; False where none begins before the end."""
        self.held.clear()
        while self.tool is not None and not self.tool.eof:
            self._more()
            self.held.clear()
        self.tool = None
        if self.begin >= self.end or not (self.raw or self._fill()):
            return False
        self.tool = zlib.decompressobj(31)
        return True

    def _fill(self) -> bool:
        self.raw = self.file.read(READ)
        return bool(self.raw)

    def _more(self) -> bool:
        """Decompresses some more of this member; False at its end."""
        if self.tool.eof:
            return False
        if not self.raw and not self.tool.unconsumed_tail and not self._fill():
            raise ValueError("an archive ends within a record")
        given = self.tool.unconsumed_tail or self.raw
        if given is self.raw:
            self.raw = b""
        self.held += self.tool.decompress(given, READ)
        self.begin += len(given) - len(self.tool.unconsumed_tail) - len(self.tool.unused_data)
        if self.tool.eof:
            self.raw = self.tool.unused_data + self.raw
        return True

    def until(self, mark: bytes) -> bytes:
        while (at := self.held.find(mark)) < 0:
            if len(self.held) > _HEAD_MOST or not self._more():
                raise ValueError("a record's header does not end")
        out = bytes(self.held[:at])
        del self.held[: at + len(mark)]
        return out

    def take(self, n: int) -> bytes:
        while len(self.held) < n and self._more():
            pass
        if len(self.held) < n:
            raise ValueError("a record is shorter than its length")
        out = bytes(self.held[:n])
        del self.held[:n]
        return out


def _fields(head: bytes) -> dict[str, str]:
    return {k.strip().lower(): v.strip() for k, _, v in (line.partition(":") for line in head.decode().split("\r\n")[1:])}


def _page(record: str) -> tuple[int, int | None]:
    """(rid, page_id) of a record identifier."""
    page, rid = re.fullmatch(r"<urn:page:(-?\d*):(\d+)>", record).groups()
    return int(rid), int(page) if page else None


def read_rows(file, start: int, end: int, size: int, keep_data: bool):
    """The chunks of the records of a part of an archive; without data only each record's last row. Digests are checked."""
    members = Members(file, start, end)
    while members.begin_next():
        head = _fields(members.until(b"\r\n\r\n"))
        if head["warc-type"] not in ("response", "revisit"):
            continue
        rid, page = _page(head["warc-record-id"])
        refers = _page(head["warc-refers-to"])[1] if "warc-refers-to" in head else None
        http = members.until(b"\r\n\r\n")
        left = int(head["content-length"]) - len(http) - 4
        declared, digest = head["warc-payload-digest"].removeprefix("sha1:"), hashlib.sha1()
        fixed = (rid, page, head.get("warc-target-uri"), head["warc-type"], refers)
        total, done, no = int(_fields(http)["content-length"]), 0, 0
        while True:
            data = members.take(min(size, left - done))
            digest.update(data)
            done += len(data)
            last = done == left
            if last and head["warc-type"] == "response" and (base32(digest.digest()), done) != (declared, total):
                raise ValueError(f"{head['warc-record-id']}: the payload is not the one that was written")
            if keep_data or last:
                yield *fixed, no, data if keep_data else None, done, digest.digest(), last, total, declared
            no += 1
            if last:
                break


def read_archives(index: DataFrame, keep_data: bool = True, size: int = CHUNK) -> DataFrame:
    """Chunk rows of all records of the archives in an index, with the records' headers. Without data, one row for each
    record. Long archives are read in parts."""
    parts = index.groupBy("path", F.floor(F.col("offset") / PART_BYTES).alias("part")).agg(F.min("offset").alias("start"), F.max(F.col("offset") + F.col("length")).alias("end"))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows():
            for batch in batches:
                for r in batch.to_pylist():
                    fs, at = file_system(r["path"])
                    with fs.open_input_file(at) as f:
                        yield from read_rows(f, r["start"], r["end"], size, keep_data)

        yield from _batches(rows(), _READ, lambda row: len(row[6] or b""))

    n = int(index.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # few small rows, each of them much work
    return parts.select("path", "start", "end").repartition(n, "path", "start").mapInArrow(read, _ddl(_READ))


def store(pages: DataFrame, root: str, least: int = LEAST, size: int = CHUNK) -> DataFrame:
    """Writes every row of ``pages`` as a record of archives below ``root``; returns their index."""
    path = f"{scratch_dir(pages.sparkSession)}/chunks-{uuid.uuid4().hex}"
    cut = chunked(pages, size)
    cut.write.option("compression", "zstd").parquet(path)
    chunks = pages.sparkSession.read.schema(cut.schema).parquet(path)
    return write_archives(chunks, materialize(roles(chunks, least), "warc-roles"), root)


def op13_warc_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = store(table(spark, sf_dir, "pages"), f"{scratch_dir(spark)}/archives-{uuid.uuid4().hex}")
    return read_archives(index, keep_data=False).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


OP13_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS t, row_number() OVER (ORDER BY page_id NULLS LAST) AS r FROM pages),
d AS (SELECT *, strlen(t) AS n, sha1(t) AS h, first_value(r) OVER w AS fr, first_value(page_id) OVER w AS fp
      FROM p WINDOW w AS (PARTITION BY t ORDER BY r)),
b AS (SELECT *, list_transform(range(8), lambda g: list_reduce([instr('0123456789abcdef', c) - 1 FOR c IN string_split(substr(h, g * 5 + 1, 5), '')], lambda a, c: a * 16 + c)) AS five FROM d)
SELECT page_id, n::BIGINT AS payload_bytes,
       list_aggregate(list_transform(five, lambda v: list_aggregate(list_transform(range(4), lambda k: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', ((v >> (15 - 5 * k)) & 31)::BIGINT + 1, 1)), 'string_agg', '')), 'string_agg', '') AS payload_digest,
       CASE WHEN fr = r THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN fr <> r THEN fp END AS refers_to
FROM b
"""
