"""Text columns: white space, keys, tags, classification and redaction."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# fixed values: the Unicode white-space characters, and the four ASCII
# separators that text stripping also removes
_UNICODE_SPACE = (
    "\t\n\x0b\x0c\r \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)
_SEPARATORS = "\x1c\x1d\x1e\x1f"
WIDE_SPACE = r"\x1c-\x1f\p{IsWhite_Space}"  # the same set as a regex class

KEY_PREFIX = "documents"
KEY_FILE = "source.txt"
PARTITION_PREFIX = "JOB#"


def strip(col: Column) -> Column:
    # trimming a character set is a native scan, much cheaper than a regex
    return F.btrim(col, F.lit(_SEPARATORS + _UNICODE_SPACE))


def strip_unicode(col: Column) -> Column:
    """Strip White_Space only; result summaries use this narrower rule."""
    return F.btrim(col, F.lit(_UNICODE_SPACE))


def rstrip(col: Column) -> Column:
    return F.rtrim(col, F.lit(_SEPARATORS + _UNICODE_SPACE))


def is_blank(col: Column) -> Column:
    """True for null and for text of white space only."""
    return F.coalesce(strip(col) == "", F.lit(True))


def non_blank(col: Column) -> Column:
    """Stripped text, null when nothing is left."""
    stripped = strip(col)
    return F.when(stripped != "", stripped)


def has_space(col: Column) -> Column:
    return col.rlike(rf"[{WIDE_SPACE}]")


def build_object_key(job_id: Column) -> Column:
    """``documents/<id>/source.txt``; null for a blank or spaced id."""
    owner = strip(job_id)
    return F.when(
        (owner != "") & ~has_space(owner),
        F.concat(F.lit(KEY_PREFIX + "/"), owner, F.lit("/" + KEY_FILE)),
    )


def job_id_from_key(object_key: Column) -> Column:
    """Owner id of a canonical key, null for any other key."""
    pattern = rf"^{KEY_PREFIX}/([^/{WIDE_SPACE}]+)/source\.txt\z"
    found = F.regexp_extract(strip(object_key), pattern, 1)
    return F.when(found != "", found)


def partition_key(job_id: Column) -> Column:
    owner = strip(job_id)
    return F.when(owner != "", F.concat(F.lit(PARTITION_PREFIX), owner))


def form_decode(key: Column) -> Column:
    """Percent and plus decoding that leaves broken escapes as they are."""
    decoded = F.try_url_decode(F.regexp_replace(key, r"%(?![0-9A-Fa-f]{2})", "%25"))
    return F.when(key.rlike("[%+]"), decoded).otherwise(key)


def normalize_etag(etag: Column) -> Column:
    outer = strip(etag)
    inner = F.when(
        (F.length(outer) >= 2) & outer.startswith('"') & outer.endswith('"'),
        F.substr(outer, F.lit(2), F.length(outer) - 2),
    ).otherwise(outer)
    return strip(inner)


def classify_document(text: Column) -> Column:
    """Keyword rules; the first rule that applies decides."""
    low = F.lower(text)
    return (
        F.when(F.contains(low, F.lit("invoice")), "invoice")
        .when(F.contains(low, F.lit("contract")) | F.contains(low, F.lit("agreement")), "contract")
        .when(F.contains(low, F.lit("report")), "report")
        .when(F.contains(low, F.lit("internal note")), "internal_note")
        .otherwise("unknown")
    )


def bounded_summary(stripped: Column, limit: int = 200) -> Column:
    """Short text as it is; longer text cut, right-stripped and marked."""
    head = F.substring(stripped, 1, limit - 3)
    return F.when(F.length(stripped) <= limit, stripped).otherwise(
        F.concat(rstrip(head), F.lit("..."))
    )


def word_count(text: Column) -> Column:
    return F.regexp_count(text, F.lit(rf"[^{WIDE_SPACE}]+"))


def fenced_prompt(text: Column) -> Column:
    """User prompt that keeps the untrusted document inside a fence."""
    return F.concat(
        # fixed value: the prompt wording is part of the extraction contract
        F.lit(
            "Analyze the untrusted document below according to the required output "
            "contract.\n\n<untrusted_document>\n"
        ),
        text,
        F.lit("\n</untrusted_document>"),
    )


# Identifier patterns and their marks, applied in this order. Digits and
# white space are those of Unicode, which the JVM's short classes leave out.
REDACTIONS = (
    (r"[\x00-\x1f\x7f]", "?"),
    (r'\["(?:\\[^\n]|[^"\\])*"\]', '["<redacted>"]'),
    (r"arn:(?:aws|aws-us-gov|aws-cn):[^\p{IsWhite_Space}\x1c-\x1f\]\)\"']+", "<arn>"),
    (
        r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}"
        r"(?![A-Za-z0-9._%+-])",
        "<email>",
    ),
    (r"(?<!\p{Nd})\p{Nd}{12}(?!\p{Nd})", "<account-id>"),
    (
        r"(?i)(?<![0-9a-f])[0-9a-f]{8}-[0-9a-f]{4}-[1-5][0-9a-f]{3}-[89ab][0-9a-f]{3}-"
        r"[0-9a-f]{12}(?![0-9a-f])",
        "<uuid>",
    ),
)


def redact(text: Column) -> Column:
    for pattern, mark in REDACTIONS:
        text = F.regexp_replace(text, pattern, mark)
    return text


def markdown_code(text: Column) -> Column:
    """One table cell of inline code."""
    safe = F.replace(F.replace(text, F.lit("`"), F.lit("'")), F.lit("|"), F.lit("\\|"))
    return F.concat(F.lit("`"), safe, F.lit("`"))


def opaque_id(prefix: str, *parts: Column) -> Column:
    """Stable opaque id: a retried task writes the same value again."""
    return F.concat(F.lit(prefix + "_"), F.md5(F.concat_ws("|", *parts)))
