"""The pipeline against the plain versions of its stages, one after the other."""

import sys
from pathlib import Path

sys.path.insert(0, str(Path(__file__).parent))

import corpus_pipeline  # noqa: E402
import test_packing  # noqa: E402
import test_quality  # noqa: E402
import test_simhash  # noqa: E402
from docketry.llm.quality import QualityRules  # noqa: E402
from test_substring import plain as plain_windows  # noqa: E402

SF = "/root/testdata/sf0.001"


def plain(docs):
    docs = [d for d in docs if test_quality.plain(d[1], QualityRules())[6]]
    best = {}
    for i, t in docs:
        key = "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "")
        best[key] = max(best.get(key, (-1, "")), (i, t))
    docs = sorted(best.values())
    label = test_simhash.plain_groups([test_simhash.plain_fingerprint(t) for _, t in docs])
    first = {}
    for doc, l in zip(docs, label):
        first.setdefault(l, doc)
    docs = sorted(first.values())
    cut = []
    for (i, t), (n, removed, sha) in zip(docs, plain_windows([t for _, t in docs], 35)):
        cut.append((i, t, removed, sha))
    return cut


def test_run(spark):
    import hashlib

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    frames = [docs]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, frames[-1], SF)
        assert out.columns == docs.columns, name
        frames.append(out)
    want = plain([(d.doc_id, d.text) for d in docs.collect()])
    got = sorted((r.doc_id, r.text, r.n_chars) for r in frames[-1].collect())
    assert [g[0] for g in got] == [w[0] for w in want]
    for (_, text, chars), (_, before, removed, sha) in zip(got, want):
        assert chars == len(text)
        assert hashlib.sha256(text.encode()).hexdigest() == sha if removed else text == before
    assert any(w[2] for w in want) and len(want) < docs.count()
    rows = corpus_pipeline.run(spark, SF).collect()
    pieces = sorted([(r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows], key=str)
    assert pieces == test_packing.expected([(i, t) for i, t, _ in got], 2048)
    test_packing.check_places(rows, 2048)


def test_nulls_and_empty(spark):
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    good = " ".join(f"word{i}" for i in range(60))
    docs = spark.createDataFrame(
        [(None, None, None, None, None), (None, good, None, None, None), (1, good.upper(), "x", "y", 1), (1, good, "x", "y", 1), (2, "", "", "", 0)],
        schema,
    )
    for frame, left in ((docs, 1), (docs.where("false"), 0)):
        for name, stage in corpus_pipeline.STAGES[:-1]:
            frame = stage(spark, frame, SF)
            assert frame.schema == docs.schema, name
        assert frame.count() == left
        assert corpus_pipeline.STAGES[-1][1](spark, frame, SF).count() == left
