"""Names, keys and JSON texts as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# The longest execution name, the separator of digest parts and the field names of stored outputs.
MAX_NAME = 80
_PART_SEPARATOR = "\x1f"
_DIGEST = 8
MARKER_FLAG = "_manually_resolved"
MARKER_FIELDS = {
    "resolution": "_resolution", "operator": "_operator", "reason": "_reason", "marked_run": "_pipeline_execution",
}
POINTER_FIELD = "_s3_ref"
CUT_FIELD = "_truncated"


def matches_search(text: Column, search: Column) -> Column:
    """Every whitespace-separated term of ``search`` occurs in ``text``, whatever the case."""
    terms = F.filter(F.split(F.lower(search), r"\s+"), lambda term: term != "")
    lowered = F.lower(text)
    return F.forall(terms, lambda term: F.contains(lowered, term))


def group_key(group: Column) -> Column:
    return F.lower(F.trim(F.coalesce(group, F.lit(""))))


def shard(key: Column) -> Column:
    return F.substring(F.sha2(key, 256), 1, 1)


def attention_partition(kind: Column, key: Column) -> Column:
    return F.concat(kind, F.lit("#"), shard(key))


def _clean(value: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(value, r"[^A-Za-z0-9_-]+", "-"), r"^-+|-+$", "")


def run_name(name: Column, date: Column, kind: Column, discriminator: Column) -> Column:
    """The one name a start of ``name`` for ``date`` gets, so a repeated start is recognised; null if no head is left."""
    return F.concat(run_stem(name, date, kind), run_digest(name, date, kind, discriminator))


def run_digest(name: Column, date: Column, kind: Column, discriminator: Column) -> Column:
    """The end of a run's name, which tells it from others of the same name, date and kind."""
    return F.substring(F.sha2(F.concat_ws(_PART_SEPARATOR, name, date, kind, discriminator), 256), 1, _DIGEST)


def run_stem(name: Column, date: Column, kind: Column) -> Column:
    """A run's name before its digest; null if no head is left."""
    tail = F.concat(F.lit("-"), _clean(date), F.lit("-"), kind, F.lit("-"))
    head = F.regexp_replace(F.substring(_clean(name), F.lit(1), F.lit(MAX_NAME - _DIGEST) - F.length(tail)), r"-+$", "")
    return F.when(head != "", F.concat(head, tail))


def short_id(execution: Column) -> Column:
    """The last 20 characters without dots and colons."""
    return F.regexp_replace(F.right(execution, F.lit(20)), "[.:]", "")


def _field(document: Column, name: str) -> Column:
    return F.to_json(F.try_variant_get(document, f"$.{name}", "variant"))


def output_kind(result: Column) -> Column:
    """What a stored output text is: ``pointer``, ``truncated``, ``manual``, ``text`` (no JSON) or ``value``."""
    document = F.try_parse_json(result)
    cut = F.try_variant_get(document, f"$.{CUT_FIELD}", "variant")
    empty = F.to_json(cut).isin("false", "null", "0", "0.0", '""', "[]", "{}")
    return (
        F.when(result.isNull(), F.lit(None).cast("string"))
        .when(document.isNull(), "text")
        .when(F.try_variant_get(document, f"$.{POINTER_FIELD}", "variant").isNotNull(), "pointer")
        .when(cut.isNotNull() & ~empty, "truncated")
        .when(F.coalesce(_field(document, MARKER_FLAG) == "true", F.lit(False)), "manual")
        .otherwise("value")
    )


def output_field(result: Column, name: str) -> Column:
    """A text field of a stored JSON output; null when the text is no JSON object or lacks it."""
    return F.try_variant_get(F.try_parse_json(result), f"$.{name}", "string")
