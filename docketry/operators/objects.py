"""Stored objects: reference join, identity checks and strict text decoding."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docketry.config import IntakeConfig
from docketry.functions import text as X
from docketry.session import cut_lineage

CONTENT_TYPE = "text/plain"  # fixed value: the one supported content type

NOT_FOUND = "document_not_found"
INVALID = "document_validation_failed"
NO_REFERENCE = "invalid_document_reference"
DEPENDENCY = "document_dependency_error"

_LATEST = "\u0000latest"
_KEY = ["object_key", "__version"]


def _addressed(objects: DataFrame) -> DataFrame:
    """One row per way to address an object: by version, and as the latest."""
    labels = F.array_compact(
        F.array(X.non_blank(F.col("version_id")), F.when(F.col("is_latest"), F.lit(_LATEST)))
    )
    return objects.withColumn("__version", F.explode(labels))


def _asked(references: DataFrame) -> DataFrame:
    return references.withColumn("__version", F.coalesce(F.col("version_id"), F.lit(_LATEST)))


def metadata_error(config: IntakeConfig) -> Column:
    """First check that fails on the metadata of a joined reference."""
    limit = F.lit(config.max_size_bytes)
    expected = X.normalize_etag(F.col("etag"))
    actual = X.normalize_etag(F.col("stored_etag"))
    version = F.col("stored_version_id")
    wrong = (
        F.col("stored_size_bytes").isNull()
        | (F.col("stored_size_bytes") < 0)
        | (F.col("stored_size_bytes") > limit)
        | F.col("stored_content_type").isNull()
        | (F.col("stored_content_type") != CONTENT_TYPE)
        | F.coalesce(actual == "", F.lit(True))
        | (version.isNotNull() & X.is_blank(version))
        | (F.col("version_id").isNotNull() & ~X.strip(version).eqNullSafe(F.col("version_id")))
        | (F.col("stored_size_bytes") != F.col("object_size"))
        | (actual != expected)
    )
    return (
        F.when(F.col("etag").isNull(), NO_REFERENCE)
        .when(F.col("object_size") > limit, INVALID)
        .when(~F.col("stored_found"), NOT_FOUND)
        .when(F.col("stored_load_error").isNotNull(), DEPENDENCY)
        .when(F.coalesce(wrong, F.lit(True)), INVALID)
    )


def _checked(references: DataFrame, objects: DataFrame, config: IntakeConfig) -> DataFrame:
    """References with ``object_error`` and ``__stored``, the version they came to."""
    stored = _addressed(
        objects.select("object_key", "version_id", "is_latest", "size_bytes", "content_type", "etag", "load_error")
    ).select(
        *_KEY,
        F.lit(True).alias("stored_found"),
        F.col("version_id").alias("stored_version_id"),
        F.col("size_bytes").alias("stored_size_bytes"),
        F.col("content_type").alias("stored_content_type"),
        F.col("etag").alias("stored_etag"),
        F.col("load_error").alias("stored_load_error"),
    )
    joined = _asked(references).join(stored, _KEY, "left").withColumn(
        "stored_found", F.coalesce("stored_found", F.lit(False))
    )
    return joined.select(
        *references.columns, metadata_error(config).alias("object_error"), F.col("stored_version_id").alias("__stored")
    )


def check_metadata(references: DataFrame, objects: DataFrame, config: IntakeConfig) -> DataFrame:
    """References with ``object_error`` as far as metadata can tell.

    A reference ``(object_key, version_id, etag, object_size)`` without a
    version means the latest object. Both cases are one equi join on (key,
    version label), so a key with very many versions is spread over partitions.
    No body is read.
    """
    return _checked(references, objects, config).drop("__stored")


def _wanted(passed: DataFrame, limit: int) -> DataFrame | None:
    """The objects that passed, for a broadcast, or None when their keys weigh more than ``limit``."""
    keys = cut_lineage(passed.select("object_key", "__stored").distinct())
    size = F.octet_length("object_key") + F.coalesce(F.octet_length("__stored"), F.lit(0)) + 64
    return F.broadcast(keys) if (keys.agg(F.sum(size)).first()[0] or 0) <= limit else None


def load_documents(
    references: DataFrame, objects: DataFrame, config: IntakeConfig, *, few: bool = False
) -> DataFrame:
    """References with ``object_error`` and, when usable, ``document_text``.

    Metadata is joined once and names the one stored object of each reference;
    the result is cut there. Bodies are read in a second pass, once for each
    object and never over the size limit; where the keys that passed fit a
    broadcast, bodies are filtered by them at the scan, so no other body is
    shuffled. A caller that has counted the references as ``few`` broadcasts
    them whole.
    """
    checked = cut_lineage(_checked(references, objects, config))
    passed = checked.where(F.col("object_error").isNull()).drop("object_error")
    bodies = objects.where(F.col("size_bytes") <= config.max_size_bytes).select(
        "object_key", F.col("version_id").alias("__stored"), "content"
    )
    same = lambda left, right: (left["object_key"] == right["object_key"]) & left["__stored"].eqNullSafe(right["__stored"])
    if not few:
        wanted = _wanted(passed, config.broadcast_bytes)
        bodies = bodies if wanted is None else bodies.join(wanted, same(bodies, wanted), "left_semi")
    b, p = bodies.alias("b"), passed.alias("p")
    loaded = (F.broadcast(p) if few else p).join(
        b, (F.col("p.object_key") == F.col("b.object_key")) & F.col("p.__stored").eqNullSafe(F.col("b.__stored"))
    ).select(*[F.col(f"p.{c}") for c in references.columns], F.col("b.content").alias("__content"))
    text = F.try_validate_utf8(F.col("__content").cast("string"))
    usable = (F.octet_length("__content") == F.col("object_size")) & text.isNotNull()
    good = loaded.withColumn(
        "object_error", F.when(~F.coalesce(usable, F.lit(False)), INVALID)
    ).withColumn("document_text", F.when(F.col("object_error").isNull(), text))
    failed = checked.where(F.col("object_error").isNotNull()).withColumn(
        "document_text", F.lit(None).cast("string")
    )
    names = [*references.columns, "object_error", "document_text"]
    return good.select(*names).unionByName(failed.select(*names))
