"""WARC archives (version 1.1): a writer with revisit records and a sequential reader, one gzip member per record.

Writing: payloads are grouped by sha256 and length, narrow, before any record is made; only groups with several records meet the payloads again,
in a join that Spark broadcasts if it is small and splits if one payload is hot. Every task writes archives of at most about ``max_bytes`` under names of its own, and
one row per archive goes to the manifest. A task that is run again writes other files; only those in the committed manifest are ever read.

Reading: a task per archive reads it from front to end in blocks of ``BLOCK`` bytes: zlib inflates member by member, a record's head is parsed, its content is
framed by Content-Length and hashed as it passes. Without ``content`` a record's bytes are never held together. Damage is told in the row's ``error``: a
digest or length that doesn't fit, or a member that can't be inflated, after which the reader goes on at the next member that opens a record.

Archives are reached through ``pyarrow.fs`` (file, hdfs, s3, gs, abfs by the folder's scheme), by tasks as well as by the driver.

Defined results: a null payload is an empty one; payloads of fewer than ``least`` bytes are all responses; of equal payloads the record with the largest id is the response, and
rows that repeat its id are responses too; null ids are smaller than all others, and where all ids of a payload are null, all its rows are responses; a null target has no WARC-Target-URI; characters
that can't stand in a URI of a header line (controls, blanks) are percent-encoded; texts that aren't UTF-8 keep their bytes; an empty table gives an archive folder without archives and no rows; other columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator
from typing import BinaryIO

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import drop_table, materialize, shared_dir

BLOCK = 1 << 20
#: An archive is closed once it is so long; WARC tools like files of about a gigabyte.
MAX_BYTES = 1 << 30
VERSION = b"WARC/1.1"
EPOCH = "1970-01-01T00:00:00Z"
IDENTICAL = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
ID = "urn:record:"
MEMBER = b"\x1f\x8b\x08"
#: A longer record or HTTP head is taken for damage.
MOST_HEAD = 1 << 20
MANIFEST = "path string, records long, bytes long"
RECORD = "path string, offset long, length long, type string, record_id string, target string, date string, headers map<string,string>, http map<string,string>, content_length long, payload_length long, payload_digest string, block_ok boolean, payload_ok boolean, content binary, error string"


def digest(raw: bytes) -> str:
    return base32(hashlib.sha1(raw))


def base32(h) -> str:
    return base64.b32encode(h.digest()).decode()


def uri_text(target: str) -> str:
    """``target`` without what would end or split a header line."""
    return re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", target)


def marked(pages: DataFrame, id_col: str, url_col: str, payload_col: str, least: int) -> tuple[DataFrame, DataFrame]:
    """(id, target, payload, refers_to): ``refers_to`` is the id of the response with the same payload, null for responses; and the table of repeated payloads behind it."""
    rows = pages.select(F.col(id_col).cast("long").alias("id"), F.col(url_col).cast("string").alias("target"), F.coalesce(F.col(payload_col).cast("binary"), F.lit(b"")).alias("payload"))
    rows = rows.withColumns({"key": F.sha2("payload", 256), "size": F.octet_length("payload")})
    copies = rows.where(F.col("size") >= least).groupBy("key", "size").agg(F.max("id").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    refers = F.when(F.col("id").isNull() | (F.col("id") < F.col("first")), F.col("first"))
    copies = materialize(copies, "payload-copies")
    return rows.join(copies, ["key", "size"], "left").select("id", "target", "payload", refers.alias("refers_to")), copies


def record(number: int | None, target: str | None, payload: bytes, refers_to: int | None, date: str = EPOCH) -> bytes:
    """One record's bytes, not compressed. A revisit holds the HTTP head alone; its digest and length are those of the full payload."""
    revisit = refers_to is not None
    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = head if revisit else head + payload
    fields = [("WARC-Type", "revisit" if revisit else "response"), ("WARC-Record-ID", f"<{ID}{'' if number is None else number}>"), ("WARC-Date", date)]
    if target is not None:
        fields.append(("WARC-Target-URI", uri_text(target)))
    if revisit:
        fields += [("WARC-Profile", IDENTICAL), ("WARC-Refers-To", f"<{ID}{refers_to}>")]
    fields += [("WARC-Payload-Digest", "sha1:" + digest(payload)), ("WARC-Block-Digest", "sha1:" + digest(block)), ("Content-Type", "application/http;msgtype=response"), ("Content-Length", str(len(block)))]
    lines = b"".join(f"{k}: {v}\r\n".encode() for k, v in fields)
    return VERSION + b"\r\n" + lines + b"\r\n" + block + b"\r\n\r\n"


def member(raw: bytes, level: int = 6) -> bytes:
    """One gzip member; no time stands in it, so equal records have equal bytes."""
    z = zlib.compressobj(level, zlib.DEFLATED, 31)
    return z.compress(raw) + z.flush()


def write(pages: DataFrame, folder: str, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", least: int = 0, max_bytes: int = MAX_BYTES, date: str = EPOCH) -> DataFrame:
    """Write a record per row to archives in ``folder`` (a URI that all tasks reach); the manifest: path, records, bytes of every archive."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = fs.FileSystem.from_uri(folder)
        store.create_dir(root, recursive=True)
        out, name, records = None, "", 0

        def closed() -> pa.RecordBatch:
            size = out.tell()
            out.close()
            return pa.RecordBatch.from_pylist([{"path": f"{folder}/{name}", "records": records, "bytes": size}], pa.schema([("path", pa.string()), ("records", pa.int64()), ("bytes", pa.int64())]))

        for b in batches:
            for row in zip(*b.columns, strict=True):
                if out is None:
                    name, records = f"{uuid.uuid4().hex}.warc.gz", 0
                    out = store.open_output_stream(f"{root}/{name}", compression=None)
                out.write(member(record(*(x.as_py() for x in row), date=date)))
                records += 1
                if out.tell() >= max_bytes:
                    yield closed()
                    out = None
        if out is not None:
            yield closed()

    rows, copies = marked(pages, id_col, url_col, payload_col, least)
    manifest = materialize(rows.mapInArrow(run, MANIFEST), "manifest")
    drop_table(copies)
    return manifest


class Damaged(Exception):
    pass


class Members:
    """A stream of gzip members, inflated block by block. ``offset`` is where the current member begins."""

    def __init__(self, raw: BinaryIO):
        self.raw, self.held, self.at, self.offset = raw, b"", 0, 0

    def more(self) -> bool:
        block = self.raw.read(BLOCK)
        self.held += block
        return bool(block)

    def next(self) -> bool:
        """Stand at the next member; False at the end."""
        if not self.held and not self.more():
            return False
        self.offset, self.z, self.fresh = self.at, zlib.decompressobj(31), True
        return True

    def inflated(self) -> Iterator[bytes]:
        """The current member's content; behind it ``held`` begins with the next member."""
        while not self.z.eof:
            if not self.held and not self.more():
                raise Damaged("the archive ends within a member")
            before = len(self.held)
            try:
                out = self.z.decompress(self.held, BLOCK)
            except zlib.error as e:
                raise Damaged(f"a member can't be inflated: {e}") from None
            # What isn't inflated yet because the output is full comes again with the next call.
            self.held = self.z.unused_data if self.z.eof else self.z.unconsumed_tail
            self.at += before - len(self.held)
            if out:
                yield out

    def resume(self) -> bool:
        """Behind damage: stand at the next bytes that inflate to the beginning of a record."""
        if self.at == self.offset:
            self._drop(1)
        while True:
            found = self.held.find(MEMBER)
            if found < 0:
                self._drop(max(0, len(self.held) - len(MEMBER) + 1))
                if not self.more():
                    self.held = b""
                    return False
                continue
            self._drop(found)
            while len(self.held) < 4096 and self.more():
                pass
            try:
                if zlib.decompressobj(31).decompress(self.held[:4096], len(VERSION) - 3).startswith(b"WARC/"):
                    return True
            except zlib.error:
                pass
            self._drop(1)

    def _drop(self, n: int) -> None:
        self.held, self.at = self.held[n:], self.at + n


def fields(head: bytes) -> dict[str, str]:
    """Header lines by lower-case name; a line that begins with a blank goes on with the one before."""
    out: dict[str, str] = {}
    last = None
    for line in head.split(b"\r\n")[1:]:
        text = line.decode("utf-8", "replace")
        if text[:1] in (" ", "\t") and last:
            out[last] += " " + text.strip()
        elif ":" in text:
            name, value = text.split(":", 1)
            last = name.strip().lower()
            out[last] = value.strip()
    return out


def read_record(stream: Members, content: bool) -> dict:
    """The record in the stream's current member: framed by its Content-Length, digests verified as the bytes pass."""
    parts, buffer = stream.inflated(), b""
    row: dict = {"offset": stream.offset, "headers": {}, "http": {}}

    def until(mark: bytes, buffer: bytes) -> tuple[bytes, bytes]:
        while mark not in buffer:
            block = next(parts, None)
            if block is None or len(buffer) > MOST_HEAD:
                raise Damaged("a head without an end")
            buffer += block
        head, _, rest = buffer.partition(mark)
        return head, rest

    head, buffer = until(b"\r\n\r\n", buffer)
    if not head.startswith(b"WARC/"):
        raise Damaged("no WARC record")
    h = row["headers"] = fields(head)
    row |= {"type": h.get("warc-type"), "record_id": h.get("warc-record-id", "").strip("<>") or None, "target": h.get("warc-target-uri"), "date": h.get("warc-date")}
    if not h.get("content-length", "").isdigit():
        raise Damaged("no Content-Length")
    length = row["content_length"] = int(h["content-length"])
    http = h.get("content-type", "").replace(" ", "").startswith("application/http")
    block_hash, payload_hash = hashlib.sha1(), hashlib.sha1()
    kept: list[bytes] = []
    left, in_head, opening, payload = length, http, b"", 0
    while left:
        if not buffer:
            buffer = next(parts, b"")
            if not buffer:
                raise Damaged(f"the content ends {left} bytes early")
        some, buffer = buffer[:left], buffer[left:]
        left -= len(some)
        block_hash.update(some)
        if in_head:  # the HTTP head comes before the payload
            opening += some
            if b"\r\n\r\n" not in opening:
                if len(opening) > MOST_HEAD:
                    raise Damaged("an HTTP head without an end")
                continue
            first, _, some = opening.partition(b"\r\n\r\n")
            row["http"], in_head = fields(first), False
        payload_hash.update(some)
        payload += len(some)
        if content:
            kept.append(some)
    rest = buffer + b"".join(parts)
    revisit = row["type"] == "revisit"
    said = h.get("warc-payload-digest", "")
    told = row["http"].get("content-length", "")
    row["payload_digest"] = said.removeprefix("sha1:") if revisit else base32(payload_hash)
    row["payload_length"] = (int(told) if told.isdigit() else None) if revisit else payload
    row["block_ok"] = h["warc-block-digest"] == "sha1:" + base32(block_hash) if "warc-block-digest" in h else None
    row["payload_ok"] = said == "sha1:" + base32(payload_hash) if said and not revisit else None
    row["content"] = b"".join(kept) if content else None
    wrong = [t for t, bad in (("block digest", row["block_ok"] is False), ("payload digest", row["payload_ok"] is False), ("bytes behind the content", rest != b"\r\n\r\n")) if bad]
    return row | {"error": ", ".join(wrong) or None}


def records(raw: BinaryIO, content: bool = False) -> Iterator[dict]:
    """The records of one archive in order, damaged ones with what could be read and an ``error``."""
    stream = Members(raw)
    while stream.next():
        try:
            row = read_record(stream, content)
        except Damaged as e:
            row = {"offset": stream.offset, "error": str(e)}
            stream.resume()
        yield row | {"length": stream.at - stream.offset}


def read(archives: DataFrame, content: bool = False) -> DataFrame:
    """All records (``RECORD``) of the archives in the column ``path``; a task per archive."""
    names = [x.split(" ")[0] for x in re.split(r", (?![^<]*>)", RECORD)]
    kinds = {"headers": pa.map_(pa.string(), pa.string()), "http": pa.map_(pa.string(), pa.string()), "content": pa.binary(), "block_ok": pa.bool_(), "payload_ok": pa.bool_()}
    kinds |= dict.fromkeys(("offset", "length", "content_length", "payload_length"), pa.int64())
    schema = pa.schema([(n, kinds.get(n, pa.string())) for n in names])

    def batch(rows: list[dict]) -> pa.RecordBatch:
        arrays = [pa.array([list(r[n].items()) if isinstance(r.get(n), dict) else r.get(n) for r in rows], schema.field(n).type) for n in names]
        return pa.RecordBatch.from_arrays(arrays, schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for path in b.column(0).to_pylist():
                store, name = fs.FileSystem.from_uri(path)
                rows, size = [], 0
                with store.open_input_stream(name, compression=None) as raw:
                    for row in records(raw, content):
                        rows.append(row | {"path": path})
                        size += len(row.get("content") or b"")
                        if len(rows) >= 1000 or size >= 8 * BLOCK:
                            yield batch(rows)
                            rows, size = [], 0
                if rows:
                    yield batch(rows)

    paths = archives.select("path")
    return paths.repartition(max(1, paths.count())).mapInArrow(run, RECORD)


def remove(spark: SparkSession, folder: str) -> None:
    """Delete an archive folder."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def round_trip(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html") -> DataFrame:
    """Write ``pages`` as archives, read these back, and delete them: page_id, payload_bytes, payload_digest, record_type, refers_to, block_ok, payload_ok. A damaged record fails the job."""
    spark = pages.sparkSession
    folder = f"{shared_dir(spark)}/tables/warc-{uuid.uuid4().hex}"
    manifest = write(pages, folder, id_col, url_col, payload_col)
    found = read(manifest)
    number = lambda c: F.nullif(F.substring_index(c, ":", -1), F.lit("")).cast("long")
    sound = F.when(F.col("error").isNotNull(), F.raise_error(F.concat_ws(" ", "path", "offset", "error"))).otherwise(F.col("payload_length"))
    refers = number(F.regexp_replace(F.col("headers")["warc-refers-to"], "[<>]", ""))
    rows = found.select(number(F.col("record_id")).alias("page_id"), sound.cast("long").alias("payload_bytes"), "payload_digest", F.col("type").alias("record_type"), refers.alias("refers_to"), "block_ok", "payload_ok")
    out = materialize(rows, "warc-records")
    remove(spark, folder)
    drop_table(manifest)
    return out
