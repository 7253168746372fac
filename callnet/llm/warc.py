"""WARC archives as seekable Zstandard bundles.

Each task writes its rows as one bundle: WARC/1.1 records, grouped into independent Zstandard frames of about `FRAME`
bytes; then two skippable frames: the record index (record id, frame, offset in the frame, length) and, last, the seek table of the
Zstandard seekable format (compressed and decompressed size of each frame, footer magic 0x8F92EAB1). A reader needs the
tail of a file to find any record, and one frame to read it. A bundle's name is its partition's number and its bytes depend on
its rows only; it is written under a temporary name and renamed, so a task that runs again leaves the same file.

Of records with equal payloads the one with the largest page_id is the response; the others are revisits that refer to it
(payloads shorter than `least` bytes are all responses). Payloads are never grouped: digests, counted with map-side
combining, decide, and the decision goes back to the rows over salted keys.

Defined results: a null html is an empty payload. Equal payloads with the same, largest page_id are all responses. A null page_id is
less than any other; its record refers to the group's largest like any other. Other columns are ignored, but for `url`.
No rows give no bundles and no records.
"""

from __future__ import annotations

import base64
import hashlib
import struct
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from callnet.llm.common import read_table, salt, salt_mask, salts_of, scratch_path

FRAME = 1 << 18
_INDEX_MAGIC, _SEEK_MAGIC, _FOOTER_MAGIC = 0x184D2A50, 0x184D2A5E, 0x8F92EAB1
_NO_ID = -(1 << 63)


def filesystem(path: str):
    """(pyarrow file system, path in it) of a shared folder: local files, or any store that pyarrow reaches."""
    from pyarrow import fs

    if path.startswith("file:"):
        return fs.LocalFileSystem(), "/" + path[len("file:") :].lstrip("/")
    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)


def urn(page_id: int | None) -> str:
    return f"<urn:page:{'' if page_id is None else page_id}>"


def _id(text: str) -> int | None:
    body = text[len("<urn:page:") : -1]
    return int(body) if body else None


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, revisit: bool) -> bytes:
    """One WARC record. A revisit has no block; the length of its payload is in a header."""
    block = b"" if revisit else payload
    head = [
        "WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: {urn(page_id)}", "WARC-Date: 1970-01-01T00:00:00Z",
        f"WARC-Target-URI: {' '.join((url or '').split())}", f"WARC-Payload-Digest: sha1:{digest(payload)}", f"X-Payload-Length: {len(payload)}",
    ]
    if revisit:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: {urn(refers_to)}"]
    head += ["Content-Type: text/html; charset=utf-8", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse(raw: bytes) -> tuple[dict[str, str], bytes]:
    """(headers, block) of one record."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    headers = dict(line.split(": ", 1) if ": " in line else (line.rstrip(":"), "") for line in lines[1:])
    size = int(headers["Content-Length"])
    if rest[size:] != b"\r\n\r\n":
        raise ValueError(f"record {headers.get('WARC-Record-ID')} is {len(rest) - 4} bytes long, its header says {size}")
    return headers, rest[:size]


class BundleWriter:
    """Writes records to a binary file object; `close` appends the index and the seek table."""

    def __init__(self, out, frame: int = FRAME, level: int = 3):
        import zstandard

        self._out, self._frame = out, frame
        self._zstd = zstandard.ZstdCompressor(level=level, write_checksum=True)
        self._buffer, self._size = [], 0
        self._frames: list[tuple[int, int]] = []
        self.index: list[tuple[int, int, int, int]] = []

    def add(self, page_id: int | None, raw: bytes) -> None:
        self.index.append((_NO_ID if page_id is None else page_id, len(self._frames), self._size, len(raw)))
        self._buffer.append(raw)
        self._size += len(raw)
        if self._size >= self._frame:
            self._flush()

    def _flush(self) -> None:
        if self._size:
            packed = self._zstd.compress(b"".join(self._buffer))
            self._out.write(packed)
            self._frames.append((len(packed), self._size))
            self._buffer, self._size = [], 0

    def close(self) -> None:
        self._flush()
        rows = b"".join(struct.pack("<qIII", *x) for x in self.index)
        packed = self._zstd.compress(rows)
        self._out.write(struct.pack("<II", _INDEX_MAGIC, len(packed)) + packed)
        table = b"".join(struct.pack("<II", *x) for x in [*self._frames, (len(packed) + 8, 0)])
        table += struct.pack("<IBI", len(self._frames) + 1, 0, _FOOTER_MAGIC)
        self._out.write(struct.pack("<II", _SEEK_MAGIC, len(table)) + table)


class BundleReader:
    """Reads a seekable bundle from a random-access binary file."""

    def __init__(self, file):
        import zstandard

        self._file, self._zstd = file, zstandard.ZstdDecompressor()
        file.seek(0, 2)
        end = file.tell()
        file.seek(end - 9)
        n, _, magic = struct.unpack("<IBI", file.read(9))
        if magic != _FOOTER_MAGIC:
            raise ValueError("no seek table at the end of the file")
        file.seek(end - 9 - 8 * n)
        sizes = list(struct.iter_unpack("<II", file.read(8 * n)))
        self._starts, at = [], 0
        for packed, _ in sizes:
            self._starts.append(at)
            at += packed
        self._sizes = sizes[:-1]
        file.seek(self._starts[-1] + 8)
        rows = self._zstd.decompressobj().decompress(file.read(sizes[-1][0] - 8))
        self.index = list(struct.iter_unpack("<qIII", rows))

    def frame(self, i: int) -> bytes:
        self._file.seek(self._starts[i])
        raw = self._zstd.decompress(self._file.read(self._sizes[i][0]), max_output_size=self._sizes[i][1])
        if len(raw) != self._sizes[i][1]:
            raise ValueError(f"frame {i} has {len(raw)} bytes, the seek table says {self._sizes[i][1]}")
        return raw

    def record(self, page_id: int | None) -> tuple[dict[str, str], bytes]:
        """The record of an id: reads its frame only."""
        wanted = _NO_ID if page_id is None else page_id
        for own, frame, offset, size in self.index:
            if own == wanted:
                return parse(self.frame(frame)[offset : offset + size])
        raise KeyError(page_id)

    def records(self) -> Iterator[tuple[dict[str, str], bytes]]:
        """All records in order; one frame is held at a time."""
        held, raw = -1, b""
        for _, frame, offset, size in self.index:
            if frame != held:
                held, raw = frame, self.frame(frame)
            yield parse(raw[offset : offset + size])


def decisions(pages: DataFrame, least: int = 0) -> DataFrame:
    """`pages` (page_id, url, html) with digest, revisit and refers_to."""
    html = F.coalesce("html", F.lit("")).cast("binary")
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", "html", F.sha1(html).alias("sha"), F.octet_length(html).alias("size"))
    rows = rows.withColumn("part", salt(F.col("page_id"), F.col("url")))
    # decided on ids and digests; the payloads move once, to meet the decision
    groups = rows.where(F.col("size") >= least).groupBy("sha").agg(F.count(F.lit(1)).alias("n"), F.max("page_id").alias("response"), salt_mask(F.col("part")).alias("parts"))
    groups = groups.where("n > 1").select("sha", "response", F.explode(salts_of(F.col("parts"))).alias("part"))
    found = rows.join(groups, ["sha", "part"], "left")
    revisit = F.col("response").isNotNull() & ~F.col("response").eqNullSafe(F.col("page_id")) & (F.col("size") >= least)
    return found.select("page_id", "url", "html", revisit.alias("revisit"), F.when(revisit, F.col("response")).alias("refers_to"))


def write_bundles(planned: DataFrame, path: str, frame: int = FRAME) -> DataFrame:
    """Write what `decisions` gave under `path`, one bundle per partition; (bundle, records, bytes) of each, once it is computed."""

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, top = filesystem(path)
        context = TaskContext.get()
        name = f"bundle-{context.partitionId():06d}.warc.zst"
        partial, writer, out = f"{top}/_{name}.{context.taskAttemptId()}", None, None
        for batch in batches:
            columns = [batch.column(i) for i in range(5)]
            for i in range(batch.num_rows):
                page_id, url, html, revisit, refers_to = (c[i].as_py() for c in columns)
                if writer is None:
                    files.create_dir(top, recursive=True)
                    out = files.open_output_stream(partial)
                    writer = BundleWriter(out, frame)
                writer.add(page_id, record(page_id, url, (html or "").encode(), refers_to, revisit))
        if writer is not None:
            writer.close()
            size = out.tell()
            out.close()
            files.move(partial, f"{top}/{name}")
            yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([len(writer.index)], pa.int64()), pa.array([size], pa.int64())], names=["bundle", "records", "bytes"])

    return planned.select("page_id", "url", "html", "revisit", "refers_to").mapInArrow(write, "bundle string, records long, bytes long")


def read_bundles(bundles: DataFrame, path: str) -> DataFrame:
    """(page_id, payload_bytes, payload_digest, record_type, refers_to) of every record of the named bundles.

    The digest and the length of a response are computed from its block and must agree with its headers.
    """
    names = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]
    schema = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long"
    types = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64()]

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, top = filesystem(path)
        for batch in batches:
            for name in batch.column(0).to_pylist():
                rows = []
                with files.open_input_file(f"{top}/{name}") as file:
                    for headers, block in BundleReader(file).records():
                        kind, size, sha = headers["WARC-Type"], int(headers["X-Payload-Length"]), headers["WARC-Payload-Digest"].removeprefix("sha1:")
                        if kind == "response" and (len(block) != size or digest(block) != sha):
                            raise ValueError(f"{name}: record {headers['WARC-Record-ID']} differs from its digest")
                        refers_to = _id(headers["WARC-Refers-To"]) if kind == "revisit" else None
                        rows.append((_id(headers["WARC-Record-ID"]), size, sha, kind, refers_to))
                        if len(rows) == 10_000:
                            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=names)
                            rows = []
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=names)

    return bundles.select("bundle").mapInArrow(read, schema)


def archive(pages: DataFrame, path: str, least: int = 0, frame: int = FRAME) -> DataFrame:
    """Write pages to bundles under `path`; the list of bundles, already computed (a row per bundle)."""
    spark = pages.sparkSession
    listed = write_bundles(decisions(pages, least), path, frame)
    where = f"{path}/_bundles"
    listed.write.mode("overwrite").parquet(where)
    return spark.read.schema(listed.schema).parquet(where)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "warc")
    bundles = archive(read_table(spark, sf_dir, "pages"), path, least=0)
    n = max(1, bundles.count())
    return read_bundles(bundles.repartition(n), path)


# A base32 digit of the digest is five bits out of two neighbouring hexadecimal digits.
ORACLE = """WITH payloads AS (SELECT page_id, encode(coalesce(html, '')) AS payload FROM pages),
hashed AS (SELECT page_id, octet_length(payload) AS size, sha1(payload) AS sha, max(page_id) OVER (PARTITION BY payload) AS response FROM payloads)
SELECT page_id, CAST(size AS BIGINT) AS payload_bytes, array_to_string(list_transform(range(32), lambda j:
    substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', ((CAST('0x' || substr(sha, 5 * j // 4 + 1, 2) AS BIGINT) >> CAST(3 - j % 4 AS INTEGER)) & 31) + 1, 1)), '') AS payload_digest,
    CASE WHEN page_id = response THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> response THEN response END AS refers_to FROM hashed"""
