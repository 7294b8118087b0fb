import pytest
from pyspark.sql import functions as F

from docketry.functions import text as X
from docketry.functions import times as TM


def one(spark, fn, value):
    return spark.createDataFrame([(value,)], "v string").select(fn(F.col("v"))).first()[0]


@pytest.mark.parametrize(
    "value", ["a", " a ", " a　", "\x1fa\x1c\x85", "\ta b\n", "   ", "", "​a", "a\x00 "]
)
def test_strip_is_the_python_rule(spark, value):
    assert one(spark, X.strip, value) == value.strip()
    assert one(spark, X.rstrip, value) == value.rstrip()
    assert one(spark, X.is_blank, value) == (not value.strip())
    assert one(spark, X.non_blank, value) == (value.strip() or None)


@pytest.mark.parametrize("value", ["one", "one  two\tthree", " x y\x1fz ", "", "  "])
def test_word_count(spark, value):
    assert one(spark, X.word_count, value) == len(value.split())


@pytest.mark.parametrize(
    "key,owner",
    [
        ("documents/job-001/source.txt", "job-001"),
        (" documents/job-001/source.txt\n", "job-001"),
        ("documents/job-001/other.txt", None),
        ("documents/job-001/source.pdf", None),
        ("uploads/job-001/source.txt", None),
        ("documents/source.txt", None),
        ("documents//source.txt", None),
        ("documents/a/b/source.txt", None),
        ("documents/job 001/source.txt", None),
        ("documents/job 001/source.txt", None),
        ("documents/job-001/source.txt/", None),
        ("", None),
    ],
)
def test_job_id_from_key(spark, key, owner):
    assert one(spark, X.job_id_from_key, key) == owner


def test_build_keys(spark):
    assert one(spark, X.build_object_key, " j1 ") == "documents/j1/source.txt"
    assert one(spark, X.build_object_key, "j 1") is None
    assert one(spark, X.build_object_key, "  ") is None
    assert one(spark, X.partition_key, " j1 ") == "JOB#j1"
    assert one(spark, X.partition_key, " ") is None


@pytest.mark.parametrize("key", ["a%2Fb", "a+b", "%zz", "100%", "a%2", "plain", "%E2%82%AC+%"])
def test_form_decode(spark, key):
    from urllib.parse import unquote_plus

    assert one(spark, X.form_decode, key) == unquote_plus(key)


@pytest.mark.parametrize(
    "tag,want", [('"abc"', "abc"), (' " abc " ', "abc"), ("abc", "abc"), ('"', '"'), ('""', ""), ('"a', '"a')]
)
def test_etag(spark, tag, want):
    assert one(spark, X.normalize_etag, tag) == want


@pytest.mark.parametrize(
    "value,kind",
    [
        ("An INVOICE for a contract", "invoice"),
        ("service Contract", "contract"),
        ("agreement report", "contract"),
        ("Report", "report"),
        ("internal note", "internal_note"),
        ("internal  note", "unknown"),
    ],
)
def test_classification_first_rule_wins(spark, value, kind):
    assert one(spark, X.classify_document, value) == kind


def test_summary_boundaries(spark):
    assert one(spark, X.bounded_summary, "x" * 200) == "x" * 200
    assert one(spark, X.bounded_summary, "x" * 201) == "x" * 197 + "..."
    spaced = "x" * 190 + " " * 20 + "y"
    assert one(spark, X.bounded_summary, spaced) == "x" * 190 + "..."


def test_redaction_order_and_boundaries(spark):
    text = (
        'a["k\\"x"] arn:aws:s3:::b/c me@x.org,you@y.org 123456789012 1234567890123 '
        "6F9619FF-8B86-4D11-B42D-00CF4FC964FF\n"
    )
    assert one(spark, X.redact, text) == (
        'a["<redacted>"] <arn> <email>,<email> <account-id> 1234567890123 <uuid>?'
    )


def test_markdown_code(spark):
    assert one(spark, X.markdown_code, "a`b|c") == "`a'b\\|c`"


@pytest.mark.parametrize(
    "value,good",
    [
        ("2024-01-01T00:00:00+00:00", True),
        ("2024-01-01T00:00:00.123456Z", True),
        ("2024-01-01T00:00:00-00:00", True),
        ("2024-01-01T00:00:00", False),
        ("2024-01-01T00:00:00+01:00", False),
        ("2024-13-01T00:00:00Z", False),
        ("yesterday", False),
    ],
)
def test_utc_timestamp(spark, value, good):
    assert (one(spark, TM.utc_timestamp, value) is not None) == good


def test_duration_and_lease(spark):
    row = spark.range(1).select(
        TM.duration_ms(F.lit(1.23456789)), TM.duration_ms(F.lit(-1.0)),
        TM.lease_expired(TM.as_timestamp("2024-01-01 00:05:00"), TM.as_timestamp("2024-01-01 00:05:00")),
        TM.lease_expired(TM.as_timestamp("2024-01-01 00:04:59"), TM.as_timestamp("2024-01-01 00:05:00")),
    ).first()
    assert tuple(row) == (1234.568, 0.0, True, False)


def test_redaction_of_other_digits_and_spaces(spark):
    digits = "\u0661" * 12
    assert one(spark, X.redact, f"x {digits} y") == "x <account-id> y"
    assert one(spark, X.redact, f"{digits}\u0661 1{digits}") == f"{digits}\u0661 1{digits}"
    assert one(spark, X.redact, "arn:aws:s3:::b\u00a0c arn:aws:s3:::b\u3000c") == "<arn>\u00a0c <arn>\u3000c"
    assert one(spark, X.redact, 'a["x\\\u2028y"]') == 'a["<redacted>"]'
