"""Quality rules against a plain per-text reading of the rules."""

import re

import pytest
from pyspark.sql import functions as F

from docketry.llm import quality
from docketry.llm.queries import op8_quality_rules

SF = "/root/testdata/sf0.001"


def plain(text, rules):
    text = text or ""
    words = [w for w in re.split("[\x20\x09-\x0d]+", text) if w]
    n = len(words)

    def covered(size, later):
        seen, places = {}, {}
        for i in range(n - size + 1):
            places.setdefault(tuple(words[i : i + size]), []).append(i)
        hit = set()
        for at in places.values():
            if len(at) > 1:
                for i in at[1:] if later else at:
                    hit.update(range(i, i + size))
        return hit

    seen, dup, dup_chars = set(), 0, 0
    for line in text.split("\n"):
        if re.search("[^\x20\x09-\x0d]", line):
            if line in seen:
                dup, dup_chars = dup + 1, dup_chars + len(line)
            seen.add(line)
    chars = sum(map(len, words))
    repeat = len(covered(5, False))
    failed = n < 10 or 100 * repeat > 20 * n
    ok = not failed and dup_chars <= rules.line_chars * len(text)
    ngrams = {}
    for size, limit in rules.ngram_chars.items():
        ngrams[size] = sum(len(words[i]) for i in covered(size, True))
        ok = ok and ngrams[size] <= limit * chars
    return (n, chars, len(re.findall(r"[#*$%&|<>]", text)), dup, repeat, failed, ok, dup_chars, *ngrams.values())


def rows(df):
    rules = quality.QualityRules()
    return [
        (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed, r.kept, r.dup_line_chars)
        + tuple(r[f"ngram_chars_{n}"] for n in rules.ngram_chars)
        for r in df.collect()
    ]


def test_whole_table(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").orderBy("doc_id").collect()
    got = op8_quality_rules(spark, SF).orderBy("doc_id")
    assert rows(got) == [plain(d.text, quality.QualityRules()) for d in docs]


def test_edges(spark):
    loop = "a b c d e f g h i j k l " * 3
    texts = [None, "", " \n \t\n", "x", "é ß 日本 #*$%&|<>\x0b\x0c\r z\x1cq", loop, loop, "same line here\n" * 4,
             "\n".join(f"word{i} more{i} and{i}" for i in range(3000)), "w " * 200_000]
    docs = spark.createDataFrame([(i, t, i) for i, t in enumerate(texts)], "doc_id long, text string, kept long")
    got = quality.measure_quality(docs.repartition(1)).orderBy("id")
    assert rows(got) == [plain(t, quality.QualityRules()) for t in texts]
    good = quality.keep_good(docs)
    assert good.columns == docs.columns and [r.doc_id for r in good.collect()] == [8]
    assert quality.measure_quality(docs.where("false")).count() == 0
    assert quality.keep_good(docs.where("false")).count() == 0


@pytest.mark.parametrize("size", [1, 7, 10_000])
def test_batch_size_does_not_matter(spark, size):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", size)
    try:
        docs = spark.read.parquet(f"{SF}/documents.parquet")
        total = quality.measure_quality(docs).agg(F.sum("n_repeat_words"), F.sum("ngram_chars_7")).collect()
        assert total == quality.measure_quality(docs.repartition(3)).agg(F.sum("n_repeat_words"), F.sum("ngram_chars_7")).collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
