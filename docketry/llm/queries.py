"""The registered queries of the operators, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docketry.llm import (
    alignment, classifier, counting, exact, licenses, packing, periodic, pieces, quality, simhash, substring, tokens, toolcalls, warc,
)
from docketry.llm.common import prepare, scratch

_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_SQL: dict[str, str] = {}


def query(fn: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return fn(prepare(spark), sf_dir)

    _QUERIES[fn.__name__] = run
    return run


def all_queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(_QUERIES)


def all_sql() -> dict[str, str]:
    return dict(_SQL)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query
def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    measured = quality.measure_quality(table(spark, sf_dir, "documents"))
    return measured.withColumnRenamed("id", "doc_id")


def _quality_sql() -> str:
    """Counts per text over lists of words; each length of n-gram has its windows."""
    rules = quality.QualityRules()
    words = "list_filter(regexp_split_to_array(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda w: w <> '')"
    parts = [f"""d AS MATERIALIZED (
        SELECT doc_id, coalesce(text, '') AS t, {words} AS ws FROM documents
    )""", """l AS (
        SELECT doc_id, count(*) AS n_dup_lines, sum(length(line)) AS dup_line_chars FROM (
            SELECT doc_id, line, row_number() OVER (PARTITION BY doc_id, line) AS k
            FROM (SELECT doc_id, unnest(string_split(t, chr(10))) AS line FROM d) WHERE regexp_matches(line, '[^\\x20\\x09-\\x0D]')
        ) WHERE k > 1 GROUP BY doc_id
    )"""]  # fmt: skip
    joins, measures = [], []
    for n in sorted(rules.ngram_chars):
        parts.append(f"""g{n} AS (
            SELECT doc_id, ws, s, count(*) OVER (PARTITION BY doc_id, g) AS n, row_number() OVER (PARTITION BY doc_id, g ORDER BY s) AS k
            FROM (SELECT doc_id, ws, s, array_to_string(ws[s : s + {n - 1}], ' ') AS g
                  FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - {n - 2})) AS s FROM d))
        )""")
        parts.append(f"""c{n} AS (
            SELECT doc_id, sum(length(w)) AS chars FROM (
                SELECT DISTINCT doc_id, p, ws[p] AS w FROM (SELECT doc_id, ws, unnest(range(s, s + {n})) AS p FROM g{n} WHERE k > 1)
            ) GROUP BY doc_id
        )""")
        joins.append(f"LEFT JOIN c{n} USING (doc_id)")
        measures.append(f"CAST(coalesce(c{n}.chars, 0) AS BIGINT) AS ngram_chars_{n}")
    base = rules.base_window
    parts.append(f"""r AS (
        SELECT doc_id, count(DISTINCT p) AS n_repeat_words
        FROM (SELECT doc_id, unnest(range(s, s + {base})) AS p FROM g{base} WHERE n > 1) GROUP BY doc_id
    )""")
    parts.append(f"""m AS (
        SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(coalesce(list_sum(list_transform(ws, lambda w: length(w))), 0) AS BIGINT) AS word_chars,
            CAST(length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
            coalesce(n_dup_lines, 0) AS n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words,
            CAST(coalesce(dup_line_chars, 0) AS BIGINT) AS dup_line_chars, CAST(length(t) AS BIGINT) AS text_chars, {", ".join(measures)}
        FROM d LEFT JOIN l USING (doc_id) LEFT JOIN r USING (doc_id) {" ".join(joins)}
    )""")
    failed = f"(n_words < {rules.min_words} OR 100 * n_repeat_words > {rules.base_percent} * n_words)"
    limits = "".join(f" AND ngram_chars_{n} <= CAST({limit} AS DOUBLE) * word_chars" for n, limit in rules.ngram_chars.items())
    return f"""WITH {", ".join(parts)}
        SELECT *, {failed} AS base_failed, NOT {failed} AND dup_line_chars <= CAST({rules.line_chars} AS DOUBLE) * text_chars{limits} AS kept FROM m"""


_SQL["op8_quality_rules"] = _quality_sql()


@query
def op1_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    marked = exact.mark_duplicates(table(spark, sf_dir, "documents"))
    return marked.select(
        F.col("id").alias("doc_id"), "keep_id", "group_size", "kept", F.lower(F.hex("sha")).alias("text_sha256")
    )


_SQL["op1_exact_dedup"] = """
    WITH n AS (
        SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t
        FROM documents
    )
    SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
           doc_id = max(doc_id) OVER w AS kept, sha256(t) AS text_sha256
    FROM n WINDOW w AS (PARTITION BY t)
"""


@query
def op7_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    grouped = simhash.cluster(table(spark, sf_dir, "documents"), shingle=4, radius=4)
    return grouped.select(
        F.col("id").alias("doc_id"), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id"
    )


@query
def op10_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = substring.measure_repeats(table(spark, sf_dir, "documents"), substring.Windows(words=35))
    return cut.select(
        F.col("id").alias("doc_id"), "n_words", "n_removed", F.lower(F.hex("kept_sha")).alias("kept_sha256")
    )


_SQL["op10_substring_dedup"] = """
    WITH d AS (
        SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda w: w <> '') AS words
        FROM documents
    ),
    starts AS (SELECT doc_id, words, unnest(range(1, len(words) - 33)) AS s FROM d),
    windows AS (SELECT doc_id, s, md5(array_to_string(words[s : s + 34], ' ')) AS w FROM starts),
    repeated AS (SELECT doc_id, s FROM windows QUALIFY count(*) OVER (PARTITION BY w) > 1),
    covered AS (
        SELECT doc_id, list(DISTINCT p) AS gone FROM (SELECT doc_id, unnest(range(s, s + 35)) AS p FROM repeated) GROUP BY doc_id
    ),
    kept AS (
        SELECT d.doc_id, len(words) AS n_words, coalesce(len(gone), 0) AS n_removed,
               CASE WHEN gone IS NULL THEN words ELSE
                   list_transform(list_filter(range(1, len(words) + 1), lambda i: NOT list_contains(gone, i)), lambda i: words[i]) END AS rest
        FROM d LEFT JOIN covered USING (doc_id)
    )
    SELECT doc_id, n_words, n_removed, sha256(array_to_string(rest, ' ')) AS kept_sha256 FROM kept
"""


@query
def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = tokens.public_path("word_bpe_49k.json")
    return counting.count_tokens(table(spark, sf_dir, "documents"), path, 2048).withColumnRenamed("id", "doc_id")


@query
def op4_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = tokens.public_path("byte_bpe_50k.json")
    return packing.pack(table(spark, sf_dir, "documents"), path, limit=2048, end_id=0).withColumnRenamed("id", "doc_id")


@query
def op3_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = scratch(spark, "warc")
    warc.write_archives(table(spark, sf_dir, "pages"), folder)
    return warc.read_archives(spark, folder).select(
        "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"
    )


_SQL["op3_warc"] = """
    WITH p AS (
        SELECT page_id, coalesce(html, '') AS h, max(page_id) OVER (PARTITION BY coalesce(html, '')) AS best FROM pages
    )
    SELECT page_id, strlen(h) AS payload_bytes, sha1(h) AS payload_digest,
           CASE WHEN strlen(h) >= 1000 AND page_id <> best THEN 'revisit' ELSE 'response' END AS record_type,
           CASE WHEN strlen(h) >= 1000 AND page_id <> best THEN best END AS refers_to
    FROM p
"""


@query
def op6_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of every text, and whether decoding them gives the text again (the mark U+2581 reads as a space)."""
    path = tokens.public_path("piece_bpe_32k.model")
    return pieces.round_trip(table(spark, sf_dir, "documents"), path).withColumnRenamed("id", "doc_id")


@query
def op2_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan_licenses(table(spark, sf_dir, "documents")).withColumnRenamed("id", "doc_id")


@query
def op5_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tool calls that the conversations imply, linked to their results; ``message`` is the canonical JSON."""
    calls, results = toolcalls.calls_of(table(spark, sf_dir, "conversations"))
    return toolcalls.link_calls(calls, results, toolcalls.TOOLS).withColumnRenamed("conv", "conv_id")


def _made_periodic(docs: DataFrame) -> DataFrame:
    """``doc_id, text``: in every tenth document by checksum, the words from one on repeat with a period."""
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    chosen = docs.select("doc_id", "text", h.alias("h")).withColumn(
        "words", F.when(F.col("h") % 10 == 0, F.filter(F.split("text", "[\\x20\\x09-\\x0D]+"), lambda w: w != ""))
    )
    n, g = F.size("words"), F.floor(F.col("h") / 10)
    placed = chosen.withColumn("a", F.when(n > 0, g % n).cast("int")).withColumn(
        "p", F.when(n > 0, 1 + F.floor((n - F.col("a")) / (3 + g % 8))).cast("int")
    )
    periodic = F.transform(
        "words", lambda w, i: F.when(i < F.col("a"), w).otherwise(F.get("words", F.col("a") + (i - F.col("a")) % F.col("p")))
    )
    return placed.select("doc_id", F.when(n > 0, F.array_join(periodic, " ")).otherwise(F.col("text")).alias("text"))


@query
def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = periodic.measure_runs(_made_periodic(table(spark, sf_dir, "documents")), periodic.Runs(min_length=24, min_exponent=3))
    return found.select(
        F.col("id").alias("doc_id"), "n_runs", "start", "length", "period", "exponent_milli",
        F.lower(F.hex("runs_sha")).alias("runs_sha256"), F.lower(F.hex("collapsed_sha")).alias("collapsed_sha256"),
    )


@query
def op13_tokenizer_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    first, second = tokens.public_path("byte_bpe_50k.json"), tokens.public_path("piece_bpe_32k.model")
    found = alignment.measure_alignment(table(spark, sf_dir, "documents"), first, second)
    return found.select(
        F.col("id").alias("doc_id"), "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum",
        F.coalesce(F.lower(F.hex("groups_sha")), F.lit("")).alias("groups_sha256"),
    )


def _held_out() -> Column:
    """Rows by the checksum of their id; a row without one is not held out."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2, F.lit(False))


@query
def op11_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels of held-out rows go before training; scores see texts only."""
    docs = table(spark, sf_dir, "documents")
    model = classifier.train(docs, table(spark, sf_dir, "labels").where(~_held_out()))
    scored = classifier.score_texts(docs, model).withColumnRenamed("id", "doc_id")
    return scored.select("doc_id", _held_out().alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))
