"""WARC archives compressed with Zstandard: one frame per record, the dictionary in a leading skippable frame.

Writing: the digest of every payload is counted first (8 + 20 bytes a row are shuffled, pre-aggregated), so that of
equal payloads only one is stored and the others refer to it. Tasks then stream their rows into archives of bounded
size in the shared folder, under a name of their attempt, and rename them when they are whole: a lost task leaves
no half archive behind and writes the same again. Reading: every archive is a task's work; frames are decoded one by
one, and record headers, lengths and digests are checked.
"""

from __future__ import annotations

import base64
import hashlib
import io
import os
import re
import struct
import uuid
from collections.abc import Iterator
from typing import BinaryIO

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.taskcontext import TaskContext

from pitchlake.llm.common import fresh_dir, stash, table

# Fixed values of the formats.
DICTIONARY_FRAME = 0x184D2A5D
ZSTD_MAGIC = b"\x28\xb5\x2f\xfd"
DICTIONARY_MAGIC = b"\x37\xa4\x30\xec"
VERSION = b"WARC/1.1"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
REQUIRED = ("WARC-Type", "WARC-Record-ID", "WARC-Date", "Content-Length")
HTTP_OK = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
DATE = "2000-01-01T00:00:00Z"  # pages have no date of their own; a fixed one keeps archives reproducible

ARCHIVE_BYTES = 64 << 20
SAMPLE_BYTES = 2 << 20
DICTIONARY_BYTES = 64 << 10


class WarcError(ValueError):
    """A frame, header or length that the format does not allow."""


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload, usedforsecurity=False).digest()).decode()


def record_id(page: int | None, n: int) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'page:{page}:{n}')}>"


def record(kind: str, page: int | None, url: str | None, payload: bytes, sha: str, refers_to: int | None, n: int) -> bytes:
    """A response with the payload, or a revisit with HTTP headers only, that names the page it repeats."""
    block = HTTP_OK + (payload if kind == "response" else b"")
    head = {
        "WARC-Type": kind,
        "WARC-Record-ID": record_id(page, n),
        "WARC-Date": DATE,
        "WARC-Target-URI": re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url or ""),
        "Content-Type": "application/http; msgtype=response",
        "Content-Length": str(len(block)),
        "WARC-Block-Digest": f"sha1:{digest(block)}",
        "WARC-Payload-Digest": f"sha1:{sha}",
        "X-Page-ID": "" if page is None else str(page),
        "X-Payload-Length": str(len(payload)),
    }
    if kind == "revisit":
        head |= {"WARC-Profile": REVISIT_PROFILE, "WARC-Refers-To": record_id(refers_to, 0), "X-Refers-To-Page": str(refers_to)}
    lines = [VERSION, *(f"{k}: {v}".encode() for k, v in head.items())]
    return b"\r\n".join(lines) + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse_record(data: bytes) -> tuple[dict[str, str], bytes]:
    """Headers (names in lower case) and block of the one record that ``data`` must be."""
    end = data.find(b"\r\n\r\n")
    if end < 0:
        raise WarcError("the record header does not end")
    first, *lines = data[:end].split(b"\r\n")
    if not re.fullmatch(rb"WARC/1\.[01]", first):
        raise WarcError(f"not a WARC version: {first[:20]!r}")
    head: dict[str, str] = {}
    last = ""
    for line in lines:
        if line[:1] in (b" ", b"\t") and last:
            head[last] += " " + line.decode("utf-8", "replace").strip()
            continue
        name, colon, value = line.decode("utf-8", "replace").partition(":")
        if not colon or not re.fullmatch(r"[!#$%&'*+.^_`|~0-9A-Za-z-]+", name):
            raise WarcError(f"not a header line: {line[:40]!r}")
        last = name.lower()
        head.setdefault(last, value.strip())
    missing = [k for k in REQUIRED if k.lower() not in head]
    if missing:
        raise WarcError(f"without {', '.join(missing)}")
    if not head["content-length"].isdigit():
        raise WarcError("Content-Length is no number")
    size = int(head["content-length"])
    block, tail = data[end + 4 : end + 4 + size], data[end + 4 + size :]
    if len(block) != size or tail != b"\r\n\r\n":
        raise WarcError(f"Content-Length is {size}, the frame holds {len(data) - end - 8}")
    want = head.get("warc-block-digest", "")
    if want.startswith("sha1:") and want[5:] != digest(block):
        raise WarcError("the block does not have its digest")
    return head, block


def check_payload(head: dict[str, str], payload: bytes) -> None:
    """A response must hold the payload of its digest and length; a revisit holds none and states those of the page it repeats."""
    if head["warc-type"] != "response":
        return
    want = head.get("warc-payload-digest", "")
    if want.startswith("sha1:") and want[5:] != digest(payload):
        raise WarcError("the payload does not have its digest")
    size = head.get("x-payload-length", "")
    if size.isdigit() and int(size) != len(payload):
        raise WarcError(f"X-Payload-Length is {size}, the payload has {len(payload)}")


class ArchiveWriter:
    """Writes records as frames; the dictionary is trained on the first SAMPLE_BYTES of them."""

    def __init__(self, out: BinaryIO, level: int = 3) -> None:
        self.out, self.level = out, level
        self.waiting: list[bytes] = []
        self.held = 0
        self.zstd: zstandard.ZstdCompressor | None = None
        self.written = 0

    def _begin(self) -> None:
        dictionary = None
        if len(self.waiting) >= 16:
            try:
                dictionary = zstandard.train_dictionary(DICTIONARY_BYTES, [x[: 32 << 10] for x in self.waiting])
            except zstandard.ZstdError:  # samples too few or too alike: the format allows archives without one
                dictionary = None
        if dictionary is not None:
            raw = dictionary.as_bytes()
            self.out.write(struct.pack("<II", DICTIONARY_FRAME, len(raw)) + raw)
        self.zstd = zstandard.ZstdCompressor(level=self.level, dict_data=dictionary, write_content_size=True, write_checksum=True)
        for x in self.waiting:
            self._frame(x)
        self.waiting = []

    def _frame(self, data: bytes) -> None:
        frame = self.zstd.compress(data)
        self.out.write(frame)
        self.written += len(frame)

    def write(self, data: bytes) -> None:
        if self.zstd is None:
            self.waiting.append(data)
            self.held += len(data)
            if self.held >= SAMPLE_BYTES:
                self._begin()
        else:
            self._frame(data)

    def close(self) -> None:
        if self.zstd is None:
            self._begin()


def read_frames(source: BinaryIO) -> Iterator[bytes]:
    """Contents of the frames of an archive, one at a time, decoded with the dictionary of its leading skippable frame."""
    head = source.read(8)
    dictionary = None
    if len(head) == 8 and struct.unpack("<I", head[:4])[0] == DICTIONARY_FRAME:
        size = struct.unpack("<I", head[4:])[0]
        raw = source.read(size)
        if len(raw) != size:
            raise WarcError("the dictionary frame is cut short")
        if raw[:4] == ZSTD_MAGIC:  # a dictionary may itself be compressed
            raw = zstandard.ZstdDecompressor().decompressobj().decompress(raw)
        if raw[:4] != DICTIONARY_MAGIC:
            raise WarcError("the dictionary frame holds no dictionary")
        dictionary, rest = zstandard.ZstdCompressionDict(raw), b""
    else:
        rest = head
    zstd = zstandard.ZstdDecompressor(dict_data=dictionary) if dictionary else zstandard.ZstdDecompressor()
    while True:
        rest = rest or source.read(1 << 18)
        if not rest:
            return
        if len(rest) < 8:
            rest += source.read(8 - len(rest))
        if len(rest) >= 8 and struct.unpack("<I", rest[:4])[0] >> 4 == 0x184D2A5:  # skippable frames within are passed over
            size = 8 + struct.unpack("<I", rest[4:8])[0]
            while len(rest) < size:
                more = source.read(size - len(rest))
                if not more:
                    raise WarcError("a skippable frame is cut short")
                rest += more
            rest = rest[size:]
            continue
        frame, parts = zstd.decompressobj(), []
        try:
            while True:
                parts.append(frame.decompress(rest))
                if frame.eof:
                    rest = frame.unused_data
                    break
                rest = source.read(1 << 18)
                if not rest:
                    raise WarcError("the last frame is cut short")
        except zstandard.ZstdError as e:
            raise WarcError(f"not a Zstandard frame: {e}") from e
        yield b"".join(parts)


def _files(uri: str):
    """File system and path of a URI of the shared folder: local paths, or any store that Arrow opens."""
    from pyarrow import fs

    return (fs.LocalFileSystem(), uri.removeprefix("file://")) if uri.startswith(("file:", "/")) else fs.FileSystem.from_uri(uri)


def write_archives(records: DataFrame, folder: str, archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """Write (page_id, url, html, record_type, refers_to, sha) as archives into ``folder``; (path, records) of each."""

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, path = _files(folder)
        files.create_dir(path, recursive=True)
        context = TaskContext.get()
        done: list[tuple[str, int]] = []
        name, out, writer, n = "", None, None, 0
        attempt = f"{path}/.attempt-{context.taskAttemptId()}-{uuid.uuid4().hex}"

        def finish() -> None:
            writer.close()
            out.close()
            files.move(attempt, f"{path}/{name}")
            done.append((f"{folder}/{name}", n))

        for b in batches:
            columns = [b.column(k) for k in range(6)]
            for i in range(b.num_rows):
                page, url, html, kind, refers, sha = (c[i].as_py() for c in columns)
                if writer is None:
                    name, n = f"part-{context.partitionId():05d}-{len(done):05d}.warc.zst", 0
                    out = files.open_output_stream(attempt, compression=None)
                    writer = ArchiveWriter(out)
                writer.write(record(kind, page, url, (html or "").encode("utf-8", "surrogatepass"), sha, refers, 0))
                n += 1
                if writer.written >= archive_bytes:
                    finish()
                    writer = None
        if writer is not None:
            finish()
        yield pa.RecordBatch.from_pydict({"path": pa.array([p for p, _ in done], pa.string()), "records": pa.array([k for _, k in done], pa.int64())})

    return stash(records.select("page_id", "url", "html", "record_type", "refers_to", "sha").mapInArrow(write, "path string, records long"), "archives")


HEADERS = "path string, nth long, record_type string, record_id string, target_uri string, date string, headers map<string,string>, payload binary, error string"


def read_archives(paths: DataFrame, with_payload: bool = True, strict: bool = True) -> DataFrame:
    """Records of the archives in column ``path``: a row each, or with ``strict`` off a row with ``error`` for a broken one.

    After a broken frame the rest of its archive can't be found and is left; a record whose header or length is wrong is
    reported and the next frame is read; so is a response whose payload has another digest or length than its headers
    state. An archive without records gives no rows.
    """

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for uri in b.column(0).to_pylist():
                files, path = _files(uri)
                rows: list[dict] = []
                held = nth = 0
                with files.open_input_stream(path, compression=None) as source:
                    frames = read_frames(io.BufferedReader(pa.PythonFile(source, "r")) if not hasattr(source, "read") else source)
                    while True:
                        row = {"path": uri, "nth": nth}
                        try:
                            data = next(frames, None)
                            if data is None:
                                break
                            head, block = parse_record(data)
                            cut = block.find(b"\r\n\r\n") + 4 if head.get("content-type", "").startswith("application/http") else 0
                            payload = block[cut:] if cut >= 4 or not cut else b""
                            check_payload(head, payload)
                            row |= {"record_type": head["warc-type"], "record_id": head["warc-record-id"], "target_uri": head.get("warc-target-uri"), "date": head["warc-date"], "headers": list(head.items()), "payload": payload if with_payload else None}
                            held += len(data)
                        except WarcError as e:
                            if strict:
                                raise WarcError(f"{uri}, record {nth}: {e}") from e
                            row["error"] = str(e)
                        rows.append(row)
                        nth += 1
                        if held > 8 << 20 or len(rows) >= 2000:
                            yield pa.RecordBatch.from_pylist(rows, schema=schema)
                            rows, held = [], 0
                        if "error" in row and "frame" in row["error"]:
                            break
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, schema=schema)

    schema = pa.schema([("path", pa.string()), ("nth", pa.int64()), ("record_type", pa.string()), ("record_id", pa.string()), ("target_uri", pa.string()), ("date", pa.string()), ("headers", pa.map_(pa.string(), pa.string())), ("payload", pa.binary()), ("error", pa.string())])
    return paths.select("path").mapInArrow(read, HEADERS)


def assign_revisits(pages: DataFrame, least_bytes: int = 0) -> DataFrame:
    """``page_id, url, html, sha, record_type, refers_to``: of equal payloads of at least ``least_bytes``, the smallest page_id is the response.

    Every row with that page_id is a response; rows with a null page_id refer to it, and are responses if no equal page has an id.
    """
    base = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.coalesce(F.col("html").cast("string"), F.lit("")).alias("html"))
    base = base.withColumn("hex", F.sha1("html"))
    digests = stash(base.where(F.octet_length("html") >= least_bytes).select("page_id", "hex"), "digests")
    first = digests.groupBy("hex").agg(F.min("page_id").alias("first"), F.count("*").alias("n")).where("n > 1 and first is not null").drop("n")
    again = digests.join(first, "hex").where("page_id is null or page_id <> first").distinct()
    same = base["page_id"].eqNullSafe(again["page_id"]) & (base["hex"] == again["hex"])
    joined = base.join(again, same, "left").select(base["page_id"], "url", "html", base["hex"], F.col("first").alias("refers_to"))
    return joined.withColumns({"record_type": F.when(F.col("refers_to").isNull(), "response").otherwise("revisit"), "sha": base32_sha1("hex")}).drop("hex")


def base32_sha1(hex_column: str):
    """Base32 of a hexadecimal SHA-1: 40 digits are eight groups of 20 bits, each four letters."""
    letters = F.lit("ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")
    parts = []
    for g in range(8):
        n = F.conv(F.substring(hex_column, 5 * g + 1, 5), 16, 10).cast("int")
        parts += [F.substring(letters, F.shiftright(n, s).bitwiseAND(31) + 1, F.lit(1)) for s in (15, 10, 5, 0)]
    return F.concat(*parts)


def archive_pages(pages: DataFrame, folder: str | None = None, least_bytes: int = 0, archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """Write a record per row of ``pages`` and return (path, records) of the archives.

    Defined cases: a null html is an empty payload; a null url an empty target; control characters and blanks in a url are
    percent-encoded; see assign_revisits for null and repeated ids; an empty table gives no archive; extra columns are ignored.
    """
    return write_archives(assign_revisits(pages, least_bytes), folder or fresh_dir(pages.sparkSession, "warc"), archive_bytes)


def op1_warc_archives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Length and digest of a response are those of the payload that was read; a revisit has those of the page it repeats, from its headers."""
    archives = archive_pages(table(spark, sf_dir, "pages"))
    n = archives.count()
    back = read_archives(archives.select("path").repartition(max(1, n)), with_payload=True)
    number = lambda k: F.when(F.col("headers")[k] != "", F.col("headers")[k]).cast("long")
    claimed = F.substring(F.col("headers")["warc-payload-digest"], 6, 32)
    own = base32_sha1("hex")
    checked = back.withColumn("hex", F.sha1("payload")).select(
        number("x-page-id").alias("page_id"),
        F.when(F.col("record_type") == "response", F.octet_length("payload").cast("long")).otherwise(number("x-payload-length")).alias("payload_bytes"),
        F.when(F.col("record_type") == "response", own).otherwise(claimed).alias("payload_digest"),
        "record_type",
        number("x-refers-to-page").alias("refers_to"),
    )
    return checked


OP1_SQL = """
with p as (select page_id, coalesce(html, '') as body, sha1(coalesce(html, '')) as hex from pages),
g as (select *, min(page_id) over (partition by hex) as first from p),
d as (select *, list_reduce(list_transform(range(0, 8), lambda g: list_reduce(list_transform([15, 10, 5, 0],
        lambda s: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', (((('0x' || substr(hex, 5 * g::int + 1, 5))::bigint >> s) & 31) + 1)::int, 1)), lambda a, b: a || b)), lambda a, b: a || b) as sha from g)
select page_id, strlen(body)::bigint as payload_bytes, sha as payload_digest,
       case when first is null or page_id = first then 'response' else 'revisit' end as record_type,
       case when page_id <> first or page_id is null then first end as refers_to
from d
"""
