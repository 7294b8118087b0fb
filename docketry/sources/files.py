"""File sources with explicit schemas (batch and streaming)."""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docketry import schemas as S
from docketry.functions import text as X
from docketry.functions import variants as V
from docketry.shipping import ship_with_tasks

ship_with_tasks(__name__)

# text objects are dealt to this many folders, each listed whole by one task
OBJECT_FOLDERS = 256
# Spark hides names that begin with _ or ., so the owner does not stand alone; a folder for
# each object would cost the disk a second block. An owner with a slash lies deeper, without a key.
OWNER_FOLDER = r"/\d+/o=([^/]+)\.txt\z"
OBJECT_NAMES = "{source.txt,o=*.txt}"
# a task holds this much of the bodies it writes or reads, one body at least
BODY_ROWS = 256
BODY_BYTES = 4 << 20


def _reader(spark: SparkSession, streaming: bool, max_files: int | None = None):
    if not streaming:
        return spark.read
    reader = spark.readStream
    return reader.option("maxFilesPerTrigger", max_files) if max_files else reader


def queue_batches(
    spark: SparkSession, path: str, *, streaming: bool = False, max_files: int | None = None
) -> DataFrame:
    """Queue batches, one JSON document per file, to one row per message.

    A file that is not an object with a ``Records`` list gives one row with
    ``batch_error``; an empty list gives no row. ``body`` and ``messageId`` of
    the wrong type become null and are classified by the parser.
    """
    raw = _reader(spark, streaming, max_files).text(path, wholetext=True)
    doc = raw.select(
        F.col("_metadata.file_path").alias("batch_id"),
        F.col("_metadata.file_modification_time").alias("batch_ts"),
        V.parse_strict(F.col("value")).alias("__doc"),
    )
    records = V.as_array(F.col("__doc"), "$.Records")
    rows = doc.select(
        "batch_id",
        "batch_ts",
        F.when(records.isNull(), "malformed_queue_event").alias("batch_error"),
        F.posexplode(
            F.coalesce(records, F.array(F.lit(None).cast("variant")))
        ).alias("msg_pos", "__m"),
    )
    sent_ms = V.string(F.col("__m"), "$.attributes.SentTimestamp").try_cast("bigint")
    received = V.string(F.col("__m"), "$.attributes.ApproximateReceiveCount").try_cast("int")
    return rows.select(
        "batch_id",
        F.col("msg_pos").cast("long").alias("msg_pos"),
        V.string(F.col("__m"), "$.messageId").alias("message_id"),
        V.string(F.col("__m"), "$.body").alias("body"),
        F.coalesce(F.timestamp_millis(sent_ms), F.col("batch_ts")).alias("sent_ts"),
        F.coalesce(received, F.lit(1)).alias("receive_count"),
        "batch_error",
    )


def messages(spark: SparkSession, path: str, *, streaming: bool = False, max_files: int | None = None) -> DataFrame:
    """Message table in Parquet with the fixed message schema."""
    return _reader(spark, streaming, max_files).schema(S.MESSAGE).parquet(path)


def _parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Stretches of the batches, as only so many bodies become Python objects at once."""
    return (batch.slice(k, BODY_ROWS) for batch in batches for k in range(0, batch.num_rows, BODY_ROWS))


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for part in _parts(batches):
        folder, owner, values = part.columns
        packed = [value and zlib.compress(value, 1) for value in values.to_pylist()]
        yield pa.RecordBatch.from_arrays([folder, owner, pa.array(packed, pa.binary())], names=part.schema.names)


def _text_writer(root: str):
    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, base = fs.FileSystem.from_uri(root)
        held, stream, made, there = None, None, 0, set()
        for part in _parts(batches):
            for folder, owner, line in zip(*(column.to_pylist() for column in part.columns)):
                if owner != held:
                    if stream is not None:
                        stream.close()
                    path = f"{base}/{folder:03d}/o={owner.replace('/', '/o=')}.txt"
                    if folder not in there or "/" in owner:
                        system.create_dir(path.rpartition("/")[0])
                        there.add(folder)
                    held, stream, made = owner, system.open_output_stream(path, compression=None), made + 1
                stream.write((zlib.decompress(line) if line else b"") + b"\n")
        if stream is not None:
            stream.close()
        yield pa.RecordBatch.from_arrays([pa.array([made], pa.int64())], ["made"])

    return write


def write_text_objects(rows: DataFrame, root: str, folders: int = OBJECT_FOLDERS) -> list[str]:
    """Rows ``(owner, value)`` to one text object each owner, ``<root>/<folder>/o=<owner>.txt``.

    Every value is a line of its object, as Spark's text writer puts it, and rows
    without an owner share the object of Hive's default partition. The tasks write
    their objects themselves; nothing is committed file by file on the driver.
    Returns the folders, as ``text_objects`` takes them with ``OWNER_FOLDER``.
    """
    spark = rows.sparkSession
    owner = F.coalesce("owner", F.lit("__HIVE_DEFAULT_PARTITION__"))
    dealt = rows.select(
        F.pmod(F.xxhash64(owner), F.lit(folders)).cast("int").alias("folder"), owner.alias("owner"), F.col("value").cast("binary").alias("value")
    )
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    # the values are shuffled while the objects fill the disk, so they go packed
    packed = dealt.mapInArrow(_packed, "folder int, owner string, value binary")
    placed = packed.repartition(parts, "owner").sortWithinPartitions("owner")
    placed.mapInArrow(_text_writer(root), "made long").agg(F.sum("made")).collect()
    system, base = fs.FileSystem.from_uri(root)
    if system.get_file_info(base).type == fs.FileType.NotFound:
        system.create_dir(base)
    found = system.get_file_info(fs.FileSelector(base))
    return sorted(f"{root}/{f.base_name}" for f in found if f.type == fs.FileType.Directory) or [root]


def _within_reach(folders: list[str]) -> bool:
    """Whether tasks can open all of them as folders; Spark's reader has more file systems, and takes patterns."""
    try:
        for folder in folders:
            system, base = fs.FileSystem.from_uri(folder)
            if re.search(r"[*?\[\]{}\\]", folder) or system.get_file_info(base).type != fs.FileType.Directory:
                return False
    except (pa.ArrowException, OSError, ValueError):
        return False
    return True


def _hidden(path: str) -> bool:
    """Whether Spark's readers skip a file for its name or the name of a folder."""
    names = path.split("/")
    return any(
        n.startswith(".") or n.endswith("._COPYING_") or n.startswith("_") and "=" not in n and not n.startswith(("_metadata", "_common_metadata"))
        for n in names
    )


def _text_reader(folders: list[str], named: str, max_size_bytes: int | None):
    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name = re.compile(named, re.DOTALL)
        kinds = {"path": pa.string(), "length": pa.int64(), "content": pa.binary()}
        batch = lambda rows: pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds.values())], names=[*kinds])
        rows, held = [], 0
        for folder in (folders[n] for numbers in batches for n in numbers.column(0).to_pylist()):
            system, base = fs.FileSystem.from_uri(folder)
            for file in system.get_file_info(fs.FileSelector(base, recursive=True)):
                # files without a byte give no row, as with Spark's reader
                if not file.is_file or not file.size or not name.fullmatch(file.base_name) or _hidden(file.path[len(base) :].lstrip("/")):
                    continue
                body = None
                if max_size_bytes is None or file.size <= max_size_bytes:
                    with system.open_input_stream(file.path, compression=None) as stream:
                        body = stream.read()
                rows.append((file.path, file.size, body))
                held += 256 + len(body or b"")
                if held >= BODY_BYTES:
                    yield batch(rows)
                    rows, held = [], 0
        if rows:
            yield batch(rows)

    return read


def _read_by_tasks(spark: SparkSession, folders: list[str], file_glob: str, max_size_bytes: int | None) -> DataFrame:
    named = spark._jvm.org.apache.hadoop.fs.GlobPattern(file_glob).compiled().pattern()
    tasks = min(len(folders), 4 * spark.sparkContext.defaultParallelism)
    reader = _text_reader(folders, named, max_size_bytes)
    return spark.range(0, len(folders), 1, tasks).mapInArrow(reader, "path string, length long, content binary")


def text_objects(
    spark: SparkSession,
    root: str | Sequence[str],
    *,
    max_size_bytes: int | None = None,
    file_glob: str = OBJECT_NAMES,
    owner_pattern: str = r"documents/([^/]+)/source\.txt\z",
) -> DataFrame:
    """Objects ``<root>/documents/<id>/source.txt`` as stored objects.

    ``owner_pattern`` finds the owner id in a file path; files of other names
    or places keep a null key. One root is listed by Spark's file index, which
    holds every path on the driver. Of many objects give the folders above them
    as a list: when the rows are asked for, tasks list a folder at a time and read
    its objects one by one, with paths that have no scheme.

    The length limit is a filter on file metadata: bodies over it are not read,
    their rows stay with a null body.
    """
    columns = [
        F.col("object_key"),
        F.lit(None).cast("string").alias("version_id"),
        F.lit(True).alias("is_latest"),
        F.col("length").alias("size_bytes"),
        F.lit("text/plain").alias("content_type"),
    ]
    key = X.build_object_key(F.regexp_extract("path", owner_pattern, 1))
    none = F.lit(None).cast("string")
    md5 = F.md5("content").alias("etag")
    folders = [root] if isinstance(root, str) else list(dict.fromkeys(root))
    if not isinstance(root, str) and _within_reach(folders):
        read = _read_by_tasks(spark, folders, file_glob, max_size_bytes).withColumn("object_key", key)
        return read.select(*columns, "content", md5, none.alias("load_error"))
    named = (
        spark.read.format("binaryFile")
        .option("pathGlobFilter", file_glob)
        .option("recursiveFileLookup", "true")
        .load(folders)
        .withColumn("object_key", key)
    )
    whole = named if max_size_bytes is None else named.where(F.col("length") <= max_size_bytes)
    loaded = whole.select(*columns, "content", md5, none.alias("load_error"))
    if max_size_bytes is None:
        return loaded
    large = named.where(F.col("length") > max_size_bytes).select(
        *columns, F.lit(None).cast("binary").alias("content"), none.alias("etag"), none.alias("load_error")
    )
    return loaded.unionByName(large)


def access_log(spark: SparkSession, path: str, *, streaming: bool = False) -> DataFrame:
    """Gateway access-log lines with typed time, status and latency."""
    lines = _reader(spark, streaming).schema(S.ACCESS_LOG).json(path)
    return (
        lines.withColumn("ts", F.timestamp_millis(F.col("requestTimeEpoch").try_cast("bigint")))
        .withColumn("status_code", F.col("status").try_cast("int"))
        .withColumn("response_bytes", F.col("responseLength").try_cast("bigint"))
        .withColumn("integration_latency_ms", F.col("integrationLatency").try_cast("double"))
    )


def captured_responses(spark: SparkSession, path: str) -> DataFrame:
    """Captured model responses ``(attempt_id, response_json, error_code)``."""
    return spark.read.schema(S.CAPTURED_RESPONSE).parquet(path)


def retry_input(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("message_id string, available_at timestamp").parquet(path)


def raw_jobs(spark: SparkSession, path: str) -> DataFrame:
    """External job items (ISO text timestamps); bad rows become nulls, not errors."""
    return spark.read.schema(S.RAW_JOB).option("mode", "PERMISSIVE").json(path)

