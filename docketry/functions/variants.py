"""Strict reading of semi-structured text through VARIANT."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from docketry import schemas as S
from docketry.functions import text as X

_OBJECT = "map<string,variant>"
_ARRAY = "array<variant>"


def parse_strict(text: Column) -> Column:
    """JSON text as VARIANT, null unless the whole text is one JSON value.

    The parser stops after the first value, so the text is parsed as the first
    element of an array whose second element is a digest of the text; trailing
    text can not produce that second element.
    """
    digest = F.sha2(text, 256)
    wrapped = F.try_parse_json(F.concat(F.lit("["), text, F.lit(',"'), digest, F.lit('"]')))
    whole = (F.try_variant_get(wrapped, "$[1]", "string") == digest) & F.try_variant_get(
        wrapped, "$[2]", "variant"
    ).isNull()
    return F.when(whole, F.try_variant_get(wrapped, "$[0]", "variant"))


def get(value: Column, path: str) -> Column:
    return F.try_variant_get(value, path, "variant")


def kind(value: Column) -> Column:
    """STRING, BIGINT, DOUBLE, DECIMAL(..), BOOLEAN, VOID, OBJECT<..>, ARRAY<..>."""
    return F.schema_of_variant(value)


def as_object(value: Column, path: str = "$") -> Column:
    """Entries of an object, null for other kinds."""
    return F.try_variant_get(value, path, _OBJECT)


def as_array(value: Column, path: str = "$") -> Column:
    return F.try_variant_get(value, path, _ARRAY)


def is_object(value: Column, path: str = "$") -> Column:
    return as_object(value, path).isNotNull()


def string(value: Column, path: str) -> Column:
    """Text of a real JSON string, null for absent or other kinds."""
    at = get(value, path)
    return F.when(kind(at) == "STRING", F.try_variant_get(at, "$", "string"))


def present(value: Column, path: str) -> Column:
    """True when the field exists and is not JSON null."""
    return F.coalesce(kind(get(value, path)) != "VOID", F.lit(False))


def non_negative_int(value: Column, path: str) -> Column:
    """A JSON integer >= 0; booleans, text and fractions give null."""
    at = get(value, path)
    number = F.when(kind(at) == "BIGINT", F.try_variant_get(at, "$", "bigint"))
    return F.when(number >= 0, number)


def number(value: Column, path: str) -> Column:
    """A finite JSON number as DOUBLE."""
    at = get(value, path)
    real = F.when(
        kind(at).rlike("^(BIGINT|DOUBLE|DECIMAL.*)$"), F.try_variant_get(at, "$", "double")
    )
    return F.when(is_finite(real), real)


def is_finite(real: Column) -> Column:
    return ~F.isnan(real) & (F.abs(real) < float("inf"))


def normalize_number(real: Column) -> Column:
    """Compact text of a number: integral values lose their fraction."""
    return F.when(real == F.floor(real), real.cast("bigint").cast("string")).otherwise(
        real.cast("string")
    )


def same_keys(entries: Column, names: tuple[str, ...]) -> Column:
    """Exactly these keys: none missing, none extra."""
    wanted = F.array(*[F.lit(n) for n in names])
    keys = F.map_keys(entries)
    return (F.size(F.array_except(keys, wanted)) == 0) & (
        F.size(F.array_except(wanted, keys)) == 0
    )


def let(value: Column, use) -> Column:
    """Evaluate ``value`` once and hand it to ``use`` as a bound variable."""
    return F.element_at(F.transform(F.array(value), use), 1)


def _children(level: Column) -> Column:
    """All values held by the containers of one nesting level."""
    return F.flatten(
        F.transform(level, lambda v: F.coalesce(F.map_values(as_object(v)), as_array(v)))
    )


def _container_ok(v: Column) -> Column:
    entries = as_object(v)
    keys_ok = F.forall(
        F.map_keys(entries),
        lambda k: ~X.is_blank(k) & (F.length(k) <= S.KEY_MAX_CHARS),
    )
    return F.coalesce(
        (F.size(F.map_keys(entries)) <= S.OBJECT_MAX_ENTRIES) & keys_ok,
        F.size(as_array(v)) <= S.LIST_MAX_ITEMS,
    )


def _number_ok(v: Column) -> Column:
    return F.coalesce(
        (kind(v) != "DOUBLE") | is_finite(F.try_variant_get(v, "$", "double")), F.lit(True)
    )


def _descend(state: Column, depth: Column) -> Column:
    """One step of the bounds check: judge this level, move to the next."""
    containers = F.filter(
        state["level"], lambda v: as_object(v).isNotNull() | as_array(v).isNotNull()
    )

    def judge(found: Column) -> Column:
        sizes_ok = F.forall(found, lambda v: F.coalesce(_container_ok(v), F.lit(False)))
        depth_ok = (depth <= S.MAX_NESTING) | (F.size(found) == 0)
        return F.struct(
            _children(found).alias("level"),
            (state["ok"] & F.forall(state["level"], _number_ok) & sizes_ok & depth_ok).alias("ok"),
        )

    return let(containers, judge)


def within_bounds(value: Column) -> Column:
    """Bounds of a free-form object: entries, items, keys, depth, finite numbers.

    The nesting limit is small, so the levels are walked with array functions;
    the check stays inside the row and needs no shuffle.
    """
    start = F.struct(F.array(value).alias("level"), F.lit(True).alias("ok"))
    walked = F.aggregate(
        F.sequence(F.lit(1), F.lit(S.MAX_NESTING + 1)), start, _descend, lambda s: s["ok"]
    )
    return F.coalesce(is_object(value) & walked, F.lit(False))
