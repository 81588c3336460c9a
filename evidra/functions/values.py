"""Values as column functions: text sets, timestamps, numbers, identifiers, maps and embedded JSON."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The keys that may hold a document's date, first one first.
DATE_KEYS = ("resolved_at", "updated_at", "created_at", "last_modified", "modified_at", "published_at")


def text_set(values: Column) -> Column:
    """Trimmed, lower-cased, distinct, without blanks and nulls; a null array is empty."""
    clean = F.transform(F.coalesce(values, F.array().cast("array<string>")), lambda x: F.lower(F.trim(x)))
    return F.array_distinct(F.filter(clean, lambda x: x.isNotNull() & (x != "")))


def parse_timestamp(text: Column) -> Column:
    """Epoch seconds (double) of ISO dates and times, compact or not, with or without zone; else null.

    Hours alone do, and of a fraction the first six digits count. Texts without a zone are UTC, whatever the session's zone is.
    """
    t = F.regexp_replace(F.trim(text), "Z$", "+00:00")
    t = F.regexp_replace(t, r"^(\d{4})(\d{2})(\d{2})(?=$|[T ])", "$1-$2-$3")
    t = F.regexp_replace(t, r"^(\d{4}-\d{2}-\d{2}[T ]\d{2})(\d{2})(?:(\d{2})(?=$|[.,+-]))?", "$1:$2:$3")
    t = F.regexp_replace(F.regexp_replace(t, ":(?=$|[+-])", ""), r"([T ]\d{2}(?::\d{2}){0,2}(?:[.,]\d+)?[+-]\d{2}):?(\d{2})$", "$1:$2")
    t = F.regexp_replace(F.regexp_replace(t, r"([T ]\d{2})(?=$|[+-])", "$1:00"), r"([T ]\d{2}:\d{2})(?=$|[+-])", "$1:00")
    t = F.regexp_replace(t, r"[.,](\d{1,6})\d*", ".$1")
    day = t.rlike(r"^\d{4}-\d{2}-\d{2}$")
    time = t.rlike(r"^\d{4}-\d{2}-\d{2}[T ]\d{2}:\d{2}(:\d{2}([.]\d{1,6})?)?([+-]\d{2}:\d{2})?$")
    zoned = F.when(day, F.concat(t, F.lit("T00:00:00+00:00"))).when(~t.rlike(r"[+-]\d{2}:\d{2}$"), F.concat(t, F.lit("+00:00"))).otherwise(t)
    return F.when(day | time, F.unix_micros(zoned.try_cast("timestamp")) / 1e6)


def seconds_between(start: Column, end: Column) -> Column:
    """Seconds from one timestamp text to another; null while there is no end."""
    return parse_timestamp(end) - parse_timestamp(start)


def first_date(metadata: Column) -> Column:
    """The first of ``DATE_KEYS`` that is not blank, of a map of texts."""
    return F.coalesce(*[F.when(F.trim(F.try_element_at(metadata, F.lit(k))) != "", F.try_element_at(metadata, F.lit(k))) for k in DATE_KEYS])


def numeric(text: Column) -> Column:
    """Text to double: blank and what is no number are null, ``true`` and ``false`` 1 and 0, ``nan`` stays a NaN."""
    t = F.lower(F.trim(text))
    return F.when(t == "true", F.lit(1.0)).when(t == "false", F.lit(0.0)).when(t.rlike("^[+-]?nan$"), F.lit(float("nan"))).when(t.rlike(r"^[+-]?(\d+[.]?\d*|[.]\d+)(e[+-]?\d+)?$|^[+-]?inf(inity)?$"), t.try_cast("double"))


def key_of(text: Column) -> Column:
    """Lower-cased, every run of other characters than a-z and 0-9 one space, trimmed."""
    return F.trim(F.regexp_replace(F.lower(text), "[^a-z0-9]+", " "))


def slug(text: Column) -> Column:
    """As ``key_of``, with hyphens; an empty one is ``item``."""
    made = F.regexp_replace(key_of(text), " ", "-")
    return F.when(made == "", F.lit("item")).otherwise(made)


def error_class(text: Column) -> Column:
    """What stands before the first colon, trimmed; ``UnknownError`` if that is nothing."""
    head = F.trim(F.substring_index(text, ":", 1))
    return F.when(head == "", F.lit("UnknownError")).otherwise(head)


def entity_id(scope: Column, kind: Column, name: Column) -> Column:
    """The first 16 digits of the SHA-1 of scope, kind and the name's key."""
    return F.substring(F.sha1(F.concat_ws("|", scope, kind, key_of(name)).cast("binary")), 1, 16)


def merged(base: Column, override: Column) -> Column:
    """Two nested maps, flattened to dotted keys: a key of the second replaces that key, what lies under it and what it lies under."""
    hidden = lambda k: F.exists(F.map_keys(override), lambda o: (k == o) | F.startswith(k, F.concat(o, F.lit("."))) | F.startswith(o, F.concat(k, F.lit("."))))
    return F.map_concat(F.map_filter(base, lambda k, _: ~hidden(k)), override)


def json_object(text: Column) -> Column:
    """The JSON object in a noisy text (code fences, words around it), from its first to its last brace; else ``{}``."""
    body = F.regexp_extract(F.regexp_replace(text, r"(?im)^\s*```(?:json)?\s*|\s*```\s*$", ""), r"(?s)\{.*\}", 0)
    return F.when(F.get_json_object(body, "$").startswith("{"), body).otherwise(F.lit("{}"))
