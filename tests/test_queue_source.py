"""The queue source against the whole-file reader, damaged files, long files, admission by bytes."""

import io
import json
import random

import pytest

from docketry.sources import files
from docketry.sources import queue_source as Q


def message(n, **changes):
    return {"messageId": f"m{n}", "body": f"b{n} é", "attributes": {"SentTimestamp": str(1704067200000 + n), "ApproximateReceiveCount": "2"}} | changes


def docs():
    rng = random.Random(1)
    good = [json.dumps({"Records": [message(10 * k + i) for i in range(rng.randrange(1, 9))]}, ensure_ascii=False) for k in range(6)]
    odd = [
        '{"Records":[]}', '{"Records":[1,"x",null,{"messageId":5,"body":[]}]}', '  {"a":{"Records":1}, "Records" : [ ] } \n',
        json.dumps({"Records": [message(90, attributes={"SentTimestamp": "x", "ApproximateReceiveCount": 3}), message(91, attributes=None)]}),
    ]
    broken = ["", "[]", "{}", '{"Records":1}', '{"Records":[}', '{"Records":[1],"Records":[2]}', '{"Records":[{"a":NaN}]}', '{"Records":[1]} x',
              '{"Records":[{"a":1,"a":2}]}', '{"Records":[1]', '{"Records":[' + "[" * 500_000]
    return good, odd, broken


def write(folder, texts):
    folder.mkdir(exist_ok=True)
    for k, text in enumerate(texts):
        (folder / f"f{k:03d}.json").write_text(text, encoding="utf-8")
    (folder / "bytes.json").write_bytes(b'{"Records":["\xff"]}')


COLUMNS = ("msg_pos", "message_id", "body", "sent_ts", "receive_count", "batch_error")


def rows(df):
    return sorted((r.batch_id.rsplit("/", 1)[-1], *[str(getattr(r, c)) for c in COLUMNS]) for r in df.collect())


def test_as_the_whole_file_reader(spark, tmp_path):
    good, odd, broken = docs()
    write(tmp_path / "q", [*good, *odd, *broken])
    spark.dataSource.register(Q.QueueSource)
    got = spark.read.format("docketry_queue").option("partitionBytes", "500").load(f"file://{tmp_path}/q")
    want = files.queue_batches(spark, str(tmp_path / "q"))
    # times of files without a sent time differ in their last digits
    strip = lambda found: [(*r[:4], r[4][:19], *r[5:]) for r in found]
    # broken bytes, nothing at all, and nesting beyond any message are damage here; the whole-file reader
    # replaces bytes and gives an empty file no row
    first = len(good) + len(odd)
    stricter = {"bytes.json", f"f{first:03d}.json", f"f{first + len(broken) - 1:03d}.json"}
    alike = lambda found: [r for r in strip(found) if r[0] not in stricter]
    assert alike(rows(got)) == alike(rows(want))
    assert got.rdd.getNumPartitions() > 3
    assert sum(r[-1] == "malformed_queue_event" for r in rows(got)) == len(broken) + 1


@pytest.mark.parametrize("chunk", [1, 2, 7, 1 << 20])
def test_any_chunk(monkeypatch, chunk):
    monkeypatch.setattr(Q, "CHUNK", chunk)
    good, odd, broken = docs()
    for text in [*good, *odd]:
        assert list(Q.records(io.BytesIO(text.encode()))) == json.loads(text)["Records"]
    for text in broken[:-1] if chunk < 8 else broken:
        with pytest.raises(ValueError):
            list(Q.records(io.BytesIO(text.encode())))


def test_a_long_file_is_read_in_parts(monkeypatch):
    """What is held stays about one chunk, however long the file."""
    monkeypatch.setattr(Q, "CHUNK", 1 << 12)
    text = json.dumps({"Records": [message(n) for n in range(20_000)]}).encode()
    most, real = 0, Q._Text.more

    def more(self):
        nonlocal most
        found = real(self)
        most = max(most, len(self.held))
        return found

    monkeypatch.setattr(Q._Text, "more", more)
    assert sum(1 for _ in Q.records(io.BytesIO(text))) == 20_000
    assert most < 3 * (1 << 12) < len(text) / 100


def test_stream_admits_by_bytes_and_goes_on_after_a_restart(spark, tmp_path):
    good, _, _ = docs()
    write(tmp_path / "q", good)
    spark.dataSource.register(Q.QueueSource)
    taken = []

    def run():
        source = (
            spark.readStream.format("docketry_queue").option("maxBytesPerTrigger", "600").option("positionPath", f"file://{tmp_path}/position")
            .load(f"file://{tmp_path}/q")
        )
        stream = (
            source.writeStream.foreachBatch(lambda batch, n: taken.append({r.batch_id for r in batch.select("batch_id").distinct().collect()}))
            .option("checkpointLocation", str(tmp_path / "checkpoint")).trigger(availableNow=True).start()
        )
        stream.awaitTermination()

    for _ in range(10):
        run()
    every = [path for batch in taken for path in batch]
    assert len(every) == len(set(every)) == len(good) + 1  # the damaged one among them
    assert len([b for b in taken if b]) > 2
    run()
    assert sum(map(len, taken)) == len(every)
    with pytest.raises(ValueError):
        Q.QueueStreamReader({"path": "file:///x", "maxbytespertrigger": "1"})


def test_queue_files_grow_in_number(spark, tmp_path, monkeypatch):
    """More events give more files, not longer ones, and every message is in one of them."""
    from docketry.plans import services
    from docketry.plans.fixtures import Tables
    from docketry.sources import files

    monkeypatch.setattr(services, "FILE_MESSAGES", 10)
    t = Tables(spark, "/root/testdata/sf0.001")
    services._queue_files(t, str(tmp_path / "queue"))
    read = files.queue_batches(spark, str(tmp_path / "queue"))
    sizes = [r["count"] for r in read.groupBy("batch_id").count().collect()]
    assert max(sizes) <= 11 and sum(sizes) == t.read("events").count()
    assert read.select("message_id", "body").exceptAll(t.messages().select("message_id", "body")).isEmpty()
