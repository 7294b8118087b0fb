"""WARC archives: a deterministic sharded writer, and a reader that follows its manifest.

Shards are ranges of the page id, cut from a histogram of bytes over a fixed
number of id buckets, so equal input gives equal shards whatever the cluster.
A task sorts its shards, writes one gzip member per record and starts a new file
once the compressed size passes the limit. Headers, digests and record ids are
made anew from the rows; dates are a parameter; equal input gives equal bytes.

A file is written under a temporary name and renamed when it is complete; its
final name holds a digest of its bytes. A task that runs twice makes the same
names and bytes, so a file is never deleted or replaced: the later attempt drops
its own temporary file. Temporary files of attempts that died are
removed when the archive is committed. Each file gives a row of the manifest; the manifest is a table in the folder, and a small file
naming it, renamed last, commits the archive. Readers open only what a committed
manifest lists.

Executors write with ``pyarrow.fs``, which takes the URI of the shared folder.

Defined results: null html is an empty payload; a null id is written as such and
ranks below all others; of rows equal in id and payload the first is the response
and the others revisit it; an empty table gives a committed, empty archive.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import json
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docketry.llm.common import broadcast_if_small, materialize, slices, width
from docketry.shipping import ship_with_tasks

ship_with_tasks(__name__)

BUCKETS = 1 << 16
RECORD_OVERHEAD = 600
COMMIT = "COMMITTED.json"
_END = b"\r\n\r\n"


@dataclass(frozen=True)
class ArchiveSettings:
    shard_bytes: int = 16 << 20  # payload bytes of a shard, about
    roll_bytes: int = 32 << 20  # compressed size that ends a file
    revisit_bytes: int = 1000  # shorter payloads are always written out
    date: str = "2024-01-01T00:00:00Z"
    software: str = "docketry"


def _base32(digest: bytes) -> str:
    return "sha1:" + base64.b32encode(digest).decode()


def _record_id(*parts: object) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, '/'.join(map(str, parts)))}>"


def _record(fields: list[tuple[str, object]], block: bytes) -> bytes:
    """One gzip member."""
    head = "".join(f"{k}: {v}\r\n" for k, v in [*fields, ("Content-Length", len(block))])
    return gzip.compress(b"WARC/1.1\r\n" + head.encode() + b"\r\n" + block + _END, 6, mtime=0)


def _http(size: int) -> bytes:
    return f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode()


def page_record(
    page: int | None, url: str | None, payload: bytes, again: int, revisits: bool, refers: int | None, settings: ArchiveSettings
) -> bytes:
    """``again`` counts rows before this one that are equal in id and payload."""
    digest = hashlib.sha1(payload).digest()
    block = _http(len(payload)) + (b"" if revisits else payload)
    fields = [
        ("WARC-Type", "revisit" if revisits else "response"),
        ("WARC-Record-ID", _record_id(page, digest.hex(), again)),
        ("WARC-Date", settings.date),
        ("WARC-Payload-Digest", _base32(digest)),
        ("WARC-Block-Digest", _base32(hashlib.sha1(block).digest())),
        ("Content-Type", "application/http;msgtype=response"),
        ("X-Page-Id", "" if page is None else page),
        ("X-Payload-Length", len(payload)),
    ]
    if url is not None:
        fields.append(("WARC-Target-URI", url.replace("%", "%25").replace("\r", "%0D").replace("\n", "%0A") if {"\r", "\n"} & set(url) else url))
    if revisits:
        fields += [
            ("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"),
            ("WARC-Refers-To", _record_id(refers, digest.hex(), 0)),
            ("X-Refers-To-Page-Id", "" if refers is None else refers),
        ]
    return _record(fields, block)


def _settle(system: fs.FileSystem, temporary: str, final: str) -> None:
    """A complete file gets its final name once; another attempt's file of that name holds the same bytes and stays."""
    there = lambda: system.get_file_info(final).type != fs.FileType.NotFound
    if not there():
        try:
            system.move(temporary, final)
            return
        except OSError:  # some stores refuse to replace what another attempt has put there just now
            if not there():
                raise
    system.delete_file(temporary)


class _Roll:
    """Files of one shard, under temporary names until they are complete."""

    def __init__(self, folder: str, shard: int, settings: ArchiveSettings):
        self.system, self.root = fs.FileSystem.from_uri(folder)
        self.shard, self.settings, self.number = shard, settings, 0
        self.done: list[tuple] = []
        self.sink = None

    def _open(self) -> None:
        self.stem = f"part-{self.shard:05d}-{self.number:04d}"
        self.temporary = f"{self.root}/.{self.stem}.{uuid.uuid4().hex}"
        self.sink, self.hash = self.system.open_output_stream(self.temporary), hashlib.sha1()
        self.size = self.records = 0
        info = f"software: {self.settings.software}\r\nformat: WARC File Format 1.1\r\n".encode()
        self._put(_record([
            ("WARC-Type", "warcinfo"), ("WARC-Record-ID", _record_id("info", self.stem)), ("WARC-Date", self.settings.date),
            ("WARC-Filename", f"{self.stem}.warc.gz"), ("Content-Type", "application/warc-fields"),
        ], info))

    def _put(self, member: bytes) -> None:
        self.sink.write(member)
        self.hash.update(member)
        self.size += len(member)

    def add(self, member: bytes) -> None:
        if self.sink is None:
            self._open()
        self._put(member)
        self.records += 1
        if self.size >= self.settings.roll_bytes:
            self.close()

    def close(self) -> None:
        if self.sink is None:
            return
        self.sink.close()
        name = f"{self.stem}-{self.hash.hexdigest()[:16]}.warc.gz"
        _settle(self.system, self.temporary, f"{self.root}/{name}")
        self.done.append((name, self.shard, self.number, self.records, self.size, self.hash.hexdigest()))
        self.sink, self.number = None, self.number + 1


_FILES = "name string, shard int, number int, records long, bytes long, sha1 string"


def _writing(folder: str, settings: ArchiveSettings):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        roll, last, again, files = None, None, 0, []
        for batch in slices(batches, 3):
            for shard, page, url, html, sha, n, best in zip(*[c.to_pylist() for c in batch.columns]):
                if roll is None or roll.shard != shard:
                    if roll is not None:
                        roll.close()
                        files += roll.done
                    roll = _Roll(folder, shard, settings)
                again, last = (again + 1 if last == (page, sha) else 0), (page, sha)
                revisits = n is not None and (page != best or again > 0)
                roll.add(page_record(page, url, html.encode(), again, revisits, best, settings))
        if roll is not None:
            roll.close()
            files += roll.done
        kinds = [pa.string(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.string()]
        names = ["name", "shard", "number", "records", "bytes", "sha1"]
        columns = list(zip(*files)) if files else [[]] * 6
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=names)

    return run


def _bucket(low: int, step: int) -> Column:
    """Buckets rise with the id; a null id is in the first."""
    first = abs(low) // step * (1 if low > 0 else -1)  # ``div`` cuts towards zero
    return F.coalesce(F.expr(f"id div {step}L") - F.lit(first), F.lit(0)).cast("int")


def _shards(rows: DataFrame, settings: ArchiveSettings) -> tuple[int, int, np.ndarray]:
    """Lowest id, bucket width, and the shard of each bucket; the histogram has a fixed number of rows."""
    low, high = rows.agg(F.min("id"), F.max("id")).first()
    low, high = low or 0, high or 0
    step = (high - low) // BUCKETS + 1
    sizes = np.zeros(BUCKETS + 3, np.int64)
    for r in rows.groupBy(_bucket(low, step).alias("b")).agg(F.sum(F.col("size") + RECORD_OVERHEAD).alias("n")).collect():
        sizes[r.b] = r.n
    return low, step, (np.cumsum(sizes) - sizes) // settings.shard_bytes


def write_archives(
    pages: DataFrame, folder: str, settings: ArchiveSettings | None = None,
    id_col: str = "page_id", url_col: str = "url", html_col: str = "html",
) -> None:
    """Write one record per row below ``folder`` (a URI all executors share) and commit."""
    settings, spark = settings or ArchiveSettings(), pages.sparkSession
    system, root = fs.FileSystem.from_uri(folder)
    system.create_dir(root, recursive=True)
    rows = pages.select(
        F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{url_col}`").cast("string").alias("url"),
        F.coalesce(F.col(f"`{html_col}`").cast("string"), F.lit("")).alias("html"),
    )
    rows = rows.withColumn("sha", F.unhex(F.sha2("html", 256)))
    light = materialize(rows.select("id", "sha", F.octet_length("html").cast("long").alias("size")), "page-digests")
    equal = (
        light.where(F.col("size") >= settings.revisit_bytes).groupBy("sha")
        .agg(F.count(F.lit(1)).alias("n"), F.max("id").alias("best")).where("n > 1")
    )
    equal = materialize(equal.withColumnRenamed("sha", "equal_sha"), "equal-pages")
    low, step, shard_of = _shards(light, settings)
    number = int(shard_of.max()) + 1
    numbers = spark.createDataFrame(
        pa.table({"bucket": pa.array(np.arange(len(shard_of)), pa.int32()), "shard": pa.array(shard_of, pa.int32())})
    )
    placed = (
        rows.join(broadcast_if_small(equal, 64), F.col("sha") == F.col("equal_sha"), "left")
        .withColumn("bucket", _bucket(low, step))
        .join(F.broadcast(numbers), "bucket")  # a fixed number of rows
        .select("shard", "id", "url", "html", "sha", "n", "best")
        .repartitionByRange(number, "shard")  # by hash, several shards would meet in one task
        .sortWithinPartitions("shard", "id", "sha", "url")
    )
    manifest = f"manifest-{uuid.uuid4().hex}"
    placed.mapInArrow(_writing(folder, settings), _FILES).write.parquet(f"{folder}/{manifest}")
    for left in system.get_file_info(fs.FileSelector(root)):
        if left.base_name.startswith(".part-"):
            system.delete_file(left.path)
    with system.open_output_stream(f"{root}/.{manifest}") as out:
        out.write(json.dumps({"manifest": manifest}).encode())
    system.move(f"{root}/.{manifest}", f"{root}/{COMMIT}")


def members(stream) -> Iterator[bytes]:
    """The gzip members of a stream, one after the other."""
    inflate, parts = zlib.decompressobj(31), []
    while chunk := stream.read(1 << 20):
        while chunk:
            parts.append(inflate.decompress(chunk))
            if not inflate.eof:
                break
            yield b"".join(parts)
            chunk, inflate, parts = inflate.unused_data, zlib.decompressobj(31), []
    if any(parts):
        raise ValueError("the archive ends inside a record")


def parse_record(record: bytes) -> tuple[dict[str, str], bytes]:
    """Headers by lower-case name, and the block; sizes and the block digest are checked."""
    head, _, rest = record.partition(_END)
    version, *lines = head.decode().split("\r\n")
    fields = {k.lower(): v.strip() for k, v in (line.split(":", 1) for line in lines)}
    block = rest[: int(fields["content-length"])]
    if not version.startswith("WARC/1.") or rest[len(block) :] != _END:
        raise ValueError("not a WARC record")
    if "warc-block-digest" in fields and fields["warc-block-digest"] != _base32(hashlib.sha1(block).digest()):
        raise ValueError(f"block digest of {fields['warc-record-id']} differs")
    return fields, block


def _number(value: str | None) -> int | None:
    return int(value) if value else None


def _reading(folder: str, with_payload: bool):
    def row(fields: dict[str, str], block: bytes) -> tuple:
        payload = block.partition(_END)[2]
        kind, size = fields["warc-type"], int(fields["x-payload-length"])
        if kind == "response":
            if len(payload) != size or _base32(hashlib.sha1(payload).digest()) != fields["warc-payload-digest"]:
                raise ValueError(f"payload of {fields['warc-record-id']} differs")
        digest = base64.b32decode(fields["warc-payload-digest"].removeprefix("sha1:")).hex()
        shown = payload if with_payload and kind == "response" else None
        return (_number(fields["x-page-id"]), fields.get("warc-target-uri"), size, digest, kind, _number(fields.get("x-refers-to-page-id")), shown)

    def batch(rows: list[tuple]) -> pa.RecordBatch:
        kinds = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.binary()]
        names = ["page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to", "payload"]
        columns = list(zip(*rows)) if rows else [[]] * len(names)
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, root = fs.FileSystem.from_uri(folder)
        for names in batches:
            for name in names.column(0).to_pylist():
                rows, held = [], 0
                with system.open_input_stream(f"{root}/{name}", compression=None) as stream:
                    for record in members(stream):
                        fields, block = parse_record(record)
                        if fields["warc-type"] in ("response", "revisit"):
                            rows.append(row(fields, block))
                            held += len(block) if with_payload else 256
                        if held > 4 << 20:
                            yield batch(rows)
                            rows, held = [], 0
                yield batch(rows)

    return run


def read_archives(spark: SparkSession, folder: str, with_payload: bool = False) -> DataFrame:
    """One row per page record of a committed archive; digests are recomputed on the way."""
    system, root = fs.FileSystem.from_uri(folder)
    with system.open_input_stream(f"{root}/{COMMIT}") as source:
        manifest = json.loads(source.read())["manifest"]
    files = spark.read.schema(_FILES).parquet(f"{folder}/{manifest}").select("name")
    schema = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, payload binary"
    return files.repartition(4 * width(spark), "name").mapInArrow(_reading(folder, with_payload), schema)
