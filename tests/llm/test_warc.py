"""Archives: round trip, rules for revisits, determinism, and repeated or lost commits."""

import hashlib
import json
import os

import pytest

from docketry.llm import warc
from docketry.llm.queries import op3_warc

SF = "/root/testdata/sf0.001"
SCHEMA = "page_id long, url string, html string, shard int, n long"


def plain(rows, limit=1000):
    best = {}
    for i, _, h in rows:
        h = (h or "").encode()
        best[h] = max([i, best.get(h)], key=lambda x: (x is not None, x or 0)) if h in best else i
    out, seen = [], set()
    for i, _, h in rows:
        h = (h or "").encode()
        many = sum((x or "").encode() == h for _, _, x in rows) > 1
        revisit = len(h) >= limit and many and (i != best[h] or (i, h) in seen)
        seen.add((i, h))
        out.append((i, len(h), hashlib.sha1(h).hexdigest(), "revisit" if revisit else "response", best[h] if revisit else None))
    return sorted(out, key=str)


def got(df):
    return sorted([(r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in df.collect()], key=str)


def test_whole_table(spark):
    pages = [(p.page_id, p.url, p.html) for p in spark.read.parquet(f"{SF}/pages.parquet").collect()]
    assert got(op3_warc(spark, SF)) == plain(pages)


LONG = "é" * 600
CASES = [
    (5, "http://a/", LONG), (9, "http://b/", LONG), (9, "http://b/", LONG), (2, None, LONG), (None, "x\r\ny", LONG),
    (7, "u", None), (8, "u", ""), (8, "u", "short"), (3, "u", "z" * 999), (4, "u", "z" * 999), (1, "u", "big \r\n\r\n" * 40_000),
    (None, "u", "Q" * 1000), (None, "u", "Q" * 1000), (-(2**62), "u", "low"), (2**62, "u", "high"),
]


@pytest.mark.parametrize("shard,roll", [(16 << 20, 32 << 20), (500, 700)])
def test_edges(spark, tmp_path, shard, roll):
    pages = spark.createDataFrame([(*c, 1, 2) for c in CASES], SCHEMA).repartition(3)
    settings = warc.ArchiveSettings(shard_bytes=shard, roll_bytes=roll)
    warc.write_archives(pages, str(tmp_path / "a"), settings)
    back = warc.read_archives(spark, str(tmp_path / "a"), with_payload=True)
    assert got(back) == plain(CASES)
    payloads = {(r.page_id, r.payload_digest): bytes(r.payload) for r in back.where("record_type = 'response'").collect()}
    assert all(hashlib.sha1(p).hexdigest() == d for (_, d), p in payloads.items())
    # the same rows in another order and number of partitions give the same bytes
    warc.write_archives(pages.repartition(5), str(tmp_path / "b"), settings)
    files = lambda d: {f: open(tmp_path / d / f, "rb").read() for f in os.listdir(tmp_path / d) if f.endswith(".gz")}
    assert files("a") == files("b") and (len(files("a")) > 3) == (roll == 700)
    assert not [f for f in os.listdir(tmp_path / "a") if f.startswith(".part") and f.endswith(".warc.gz")]


def test_only_committed_files_are_read(spark, tmp_path):
    pages = spark.createDataFrame([(*c, 1, 2) for c in CASES], SCHEMA)
    folder = str(tmp_path / "a")
    warc.write_archives(pages, folder)
    (tmp_path / "a" / "part-99999-0000.warc.gz").write_bytes(b"left by a lost task")
    assert warc.read_archives(spark, folder).count() == len(CASES)
    warc.write_archives(pages, folder)  # again into the same folder
    assert warc.read_archives(spark, folder).count() == len(CASES)
    assert "manifest" in json.loads((tmp_path / "a" / warc.COMMIT).read_text())


def test_damage_is_found(spark, tmp_path):
    pages = spark.createDataFrame([(1, "u", "text of one page", 1, 2)], SCHEMA)
    warc.write_archives(pages, str(tmp_path / "a"))
    (name,) = [f for f in os.listdir(tmp_path / "a") if f.endswith(".gz")]
    records = list(warc.members(open(tmp_path / "a" / name, "rb")))
    with pytest.raises(ValueError):
        warc.parse_record(records[1].replace(b"one page", b"one pagE"))
    with pytest.raises(ValueError):
        warc.parse_record(records[1][:-5])


def test_empty(spark, tmp_path):
    pages = spark.createDataFrame([], SCHEMA)
    warc.write_archives(pages, str(tmp_path / "a"))
    assert warc.read_archives(spark, str(tmp_path / "a")).count() == 0


def test_an_attempt_never_removes_what_another_committed(tmp_path):
    """Two attempts of one task: whenever the second stops, the first one's file is there and whole."""
    from pyarrow import fs

    def attempt():
        roll = warc._Roll(f"file://{tmp_path}", 3, warc.ArchiveSettings())
        roll.add(warc.page_record(1, "u", b"x" * 500, 0, False, None, roll.settings))
        return roll

    first, second = attempt(), attempt()
    first.close()
    (name, *_), = first.done
    before = (tmp_path / name).read_bytes()
    removed = []

    class Watched:
        def __getattr__(self, item):
            return getattr(second_system, item)

        def delete_file(self, path):
            removed.append(path)
            raise KeyboardInterrupt  # killed here

    second_system, second.system = second.system, Watched()
    with pytest.raises(KeyboardInterrupt):
        second.close()
    assert removed == [second.temporary] and (tmp_path / name).read_bytes() == before
    third = attempt()
    third.close()
    assert third.done == first.done and (tmp_path / name).read_bytes() == before
    assert fs.LocalFileSystem().get_file_info(third.temporary).type == fs.FileType.NotFound


def test_other_pages_in_the_same_folder(spark, tmp_path):
    folder = str(tmp_path / "a")
    for text in ("one " * 400, "two " * 400):
        warc.write_archives(spark.createDataFrame([(1, "u", text, 1, 2)], SCHEMA), folder)
        (row,) = warc.read_archives(spark, folder, with_payload=True).collect()
        assert bytes(row.payload).decode() == text
    left = [f for f in os.listdir(folder) if f.startswith(".part-")]
    assert not left
