"""Reading the metadata JSON of stored rows, and the times in it."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import col, strip

RECENCY_KEYS = ("timestamp", "created_at", "indexed_at", "date", "time")


def parsed(c="metadata") -> Column:
    """The JSON as a variant; null where it is broken."""
    return F.try_parse_json(col(c))


def text_value(variant: Column, key: str) -> Column:
    """The value of `key` if it is a JSON string, else null."""
    v = F.try_variant_get(variant, f"$.{key}", "variant")
    return F.when(F.schema_of_variant(v) == "STRING", F.try_variant_get(variant, f"$.{key}", "string"))


def is_object(variant: Column) -> Column:
    return F.coalesce(F.schema_of_variant(variant).startswith("OBJECT"), F.lit(False))


def timestamp(c) -> Column:
    """RFC 3339, or date and time with a blank, or a date; UTC. Null for anything else."""
    c = col(c)
    full = F.when(c.rlike(r"^\d{4}-\d\d-\d\d[Tt ]\d\d:\d\d:\d\d(\.\d+)?([Zz]|[+-]\d\d:\d\d)$"), F.try_to_timestamp(F.regexp_replace(F.upper(c), " ", "T")))
    plain = F.when(c.rlike(r"^\d{4}-\d\d-\d\d \d\d:\d\d:\d\d$"), F.try_to_timestamp(c, F.lit("yyyy-MM-dd HH:mm:ss")))
    day = F.when(c.rlike(r"^\d{4}-\d\d-\d\d$"), F.try_to_timestamp(c, F.lit("yyyy-MM-dd")))
    return F.coalesce(full, plain, day)


def first_time(variant: Column, keys=RECENCY_KEYS) -> Column:
    """The first value among `keys` that can be read as a time."""
    return F.coalesce(*[timestamp(text_value(variant, k)) for k in keys])


def first_present(variant: Column, keys=RECENCY_KEYS) -> Column:
    """The first string among `keys`, readable or not."""
    return F.coalesce(*[text_value(variant, k) for k in keys])


def in_project(variant: Column, project: str) -> Column:
    """One of the project fields equals `project`, ASCII case and outer white space aside; a blank project passes all."""
    wanted = project.strip()
    if not wanted:
        return F.lit(True)
    from .text import ascii_lower

    same = [F.coalesce(ascii_lower(text_value(variant, k)) == "".join(c.lower() if c.isascii() else c for c in wanted), F.lit(False)) for k in ("project", "project_id", "source_project")]
    return same[0] | same[1] | same[2]


def meta_filter(variant: Column, equals: dict[str, str] | None = None, date_from: str | None = None, date_to: str | None = None) -> Column:
    """All `equals` hold for string values; a date, where there is one, lies in the range compared as text."""
    cond = F.lit(True)
    for k, v in (equals or {}).items():
        cond = cond & F.coalesce(text_value(variant, k) == v, F.lit(False))
    date = text_value(variant, "date")
    if date_from is not None:
        cond = cond & F.coalesce(date >= date_from, F.lit(True))
    if date_to is not None:
        cond = cond & F.coalesce(date <= date_to, F.lit(True))
    return cond


def string_array(c) -> Column:
    """A JSON array of strings as an array; empty where it is null or broken."""
    return F.coalesce(F.from_json(col(c), "array<string>"), F.array().cast("array<string>"))


__all__ = ["first_present", "first_time", "in_project", "is_object", "meta_filter", "parsed", "string_array", "strip", "text_value", "timestamp"]
