"""Queue batch files as a data source of its own, for batches and streams.

A file is one JSON document with a list of messages. Files are dealt to partitions
by bytes, and each is read record by record, so a file of any length is never one
row or one string; a first pass over a file finds out whether it is whole, and a
damaged one gives a single row with ``batch_error``, as in ``files.queue_batches``.

As a stream its offset is the number of files taken, in the order of their times
and names; ``maxBytesPerTrigger`` admits files up to that many bytes (one at least)
and needs ``positionPath``, a file where the source notes what it has planned.

    spark.dataSource.register(QueueSource)
    spark.read.format("docketry_queue").load(uri)
"""

from __future__ import annotations

import codecs
import datetime as dt
import json
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

from docketry.shipping import ship_with_tasks

ship_with_tasks(__name__)

SCHEMA = "batch_id string, msg_pos long, message_id string, body string, sent_ts timestamp, receive_count int, batch_error string"
PARTITION_BYTES = 32 << 20
CHUNK = 1 << 20
_ROWS = 4096
_SPACE = " \t\n\r"


def _unique(pairs: list[tuple[str, object]]) -> dict:
    if len({k for k, _ in pairs}) < len(pairs):
        raise ValueError("repeated key")
    return dict(pairs)


def _refuse(text: str) -> None:
    raise ValueError(text)


class _Text:
    """A JSON text that is read as far as it is needed."""

    def __init__(self, stream):
        self.stream, self.decode = stream, codecs.getincrementaldecoder("utf-8")().decode
        self.held, self.at, self.ended = "", 0, False
        self.json = json.JSONDecoder(object_pairs_hook=_unique, parse_constant=_refuse)

    def more(self) -> bool:
        if self.ended:
            return False
        chunk = self.stream.read(CHUNK)
        self.ended = not chunk
        self.held, self.at = self.held[self.at :] + self.decode(chunk, self.ended), 0
        return True

    def peek(self) -> str:
        """The next character that is no white space, empty at the end."""
        while True:
            while self.at < len(self.held) and self.held[self.at] in _SPACE:
                self.at += 1
            if self.at < len(self.held):
                return self.held[self.at]
            if not self.more():
                return ""

    def take(self, expected: str) -> str:
        found = self.peek()
        if not found or found not in expected:
            raise ValueError(f"one of {expected!r} is missing")
        self.at += 1
        return found

    def value(self) -> object:
        self.peek()
        while True:
            try:
                value, end = self.json.raw_decode(self.held, self.at)
                if end < len(self.held) or self.ended:  # else a number may go on
                    self.at = end
                    return value
            except json.JSONDecodeError:
                if self.ended:
                    raise
            except RecursionError:
                raise ValueError("nested too deeply") from None
            self.more()


def records(stream) -> Iterator[object]:
    """The elements of the list ``Records`` of a JSON object; ``ValueError`` if the text is anything else."""
    text, seen = _Text(stream), set()
    text.take("{")
    if text.peek() == "}":
        raise ValueError("no list of records")
    while True:
        key = text.value()
        if not isinstance(key, str) or key in seen:
            raise ValueError("a key is repeated or no text")
        seen.add(key)
        text.take(":")
        if key == "Records":
            text.take("[")
            if text.peek() == "]":
                text.take("]")
            else:
                while True:
                    yield text.value()
                    if text.take(",]") == "]":
                        break
        else:
            text.value()
        if text.take(",}") == "}":
            break
    if "Records" not in seen or text.peek():
        raise ValueError("no list of records, or text behind the object")


def _integer(value: object) -> int | None:
    try:
        return int(value) if isinstance(value, str) and value.strip("+-").isascii() else None
    except ValueError:
        return None


def _row(path: str, pos: int, message: object, when: dt.datetime) -> tuple:
    m = message if isinstance(message, dict) else {}
    attributes = m.get("attributes") if isinstance(m.get("attributes"), dict) else {}
    text = lambda v: v if isinstance(v, str) else None
    sent, received = _integer(attributes.get("SentTimestamp")), _integer(attributes.get("ApproximateReceiveCount"))
    at = when if sent is None else dt.datetime.fromtimestamp(0, dt.timezone.utc) + dt.timedelta(milliseconds=sent)
    return path, pos, text(m.get("messageId")), text(m.get("body")), at, 1 if received is None else received, None


class Files(InputPartition):
    def __init__(self, files: list[tuple[str, str]]):
        self.value = files


class _Folder:
    def __init__(self, options: dict):
        if "path" not in options:
            raise ValueError("load(path) names the folder")
        self.uri, self.options = options["path"], options

    def files(self) -> list[tuple[str, float, int]]:
        """Path, time and size of every file, oldest first; names break ties."""
        system, root = fs.FileSystem.from_uri(self.uri)
        found = system.get_file_info(fs.FileSelector(root, recursive=True))
        shown = [f for f in found if f.is_file and not f.base_name.startswith((".", "_"))]
        return sorted(((f.path, f.mtime_ns or 0, f.size or 0) for f in shown), key=lambda f: (f[1], f[0]))

    def dealt(self, files: list[tuple[str, float, int]]) -> list[Files]:
        """Neighbours share a partition up to its bytes; a larger file has one of its own."""
        limit = int(self.options.get("partitionbytes", PARTITION_BYTES))
        out: list[list] = []
        room = 0
        for path, time, size in files:
            if size > room or not out:
                out.append([])
                room = limit
            out[-1].append((path, time))
            room -= size
        return [Files(part) for part in out]

    def rows(self, part: Files) -> Iterator[pa.RecordBatch]:
        system, _ = fs.FileSystem.from_uri(self.uri)
        kinds = [pa.string(), pa.int64(), pa.string(), pa.string(), pa.timestamp("us", "UTC"), pa.int32(), pa.string()]
        names = [f.split()[0] for f in SCHEMA.split(", ")]
        batch = lambda rows: pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=names)
        for path, time in part.value:
            when = dt.datetime.fromtimestamp(time / 1e9, dt.timezone.utc)
            try:
                with system.open_input_stream(path) as stream:
                    for _ in records(stream):
                        pass
            except ValueError:  # broken bytes are one too
                yield batch([(path, 0, None, None, when, 1, "malformed_queue_event")])
                continue
            held = []
            with system.open_input_stream(path) as stream:
                for pos, message in enumerate(records(stream)):
                    held.append(_row(path, pos, message, when))
                    if len(held) == _ROWS:
                        yield batch(held)
                        held = []
            if held:
                yield batch(held)


class QueueReader(DataSourceReader):
    def __init__(self, options: dict):
        self.folder = _Folder(options)

    def partitions(self) -> list[Files]:
        return self.folder.dealt(self.folder.files())

    def read(self, partition: Files) -> Iterator[pa.RecordBatch]:
        return self.folder.rows(partition)


class QueueStreamReader(DataSourceStreamReader):
    def __init__(self, options: dict):
        self.folder = _Folder(options)
        self.limit = int(options["maxbytespertrigger"]) if "maxbytespertrigger" in options else None
        self.note = options.get("positionpath")
        if self.limit is not None and self.note is None:
            raise ValueError("maxBytesPerTrigger needs positionPath")

    def initialOffset(self) -> dict:
        return {"files": 0}

    def _planned(self) -> int:
        system, path = fs.FileSystem.from_uri(self.note)
        if system.get_file_info(path).type == fs.FileType.NotFound:
            return 0
        with system.open_input_stream(path) as source:
            return json.loads(source.read())["files"]

    def latestOffset(self) -> dict:
        files = self.folder.files()
        if self.limit is None:
            return {"files": len(files)}
        n, taken = self._planned(), 0
        while n < len(files) and (not taken or taken + files[n][2] <= self.limit):
            taken += max(files[n][2], 1)
            n += 1
        return {"files": n}

    def partitions(self, start: dict, end: dict) -> list[Files]:
        # planning follows the offset log, so the note is never behind a batch that will run
        if self.note is not None:
            system, path = fs.FileSystem.from_uri(self.note)
            temporary = f"{path}.{uuid.uuid4().hex}"
            with system.open_output_stream(temporary) as out:
                out.write(json.dumps(end).encode())
            system.move(temporary, path)
        return self.folder.dealt(self.folder.files()[start["files"] : end["files"]])

    def read(self, partition: Files) -> Iterator[pa.RecordBatch]:
        return self.folder.rows(partition)

    def commit(self, end: dict) -> None:
        pass


class QueueSource(DataSource):
    """Options: ``partitionBytes``; for streams ``maxBytesPerTrigger`` and ``positionPath``."""

    @classmethod
    def name(cls) -> str:
        return "docketry_queue"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> QueueReader:
        return QueueReader({k.lower(): v for k, v in self.options.items()})

    def streamReader(self, schema) -> QueueStreamReader:
        return QueueStreamReader({k.lower(): v for k, v in self.options.items()})
