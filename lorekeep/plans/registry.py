"""A registry of queries with their DuckDB equivalents."""

from __future__ import annotations

from collections.abc import Callable


class Registry:
    def __init__(self):
        self.queries: dict[str, Callable] = {}
        self.sql: dict[str, str] = {}

    def add(self, name: str, sql: str | None = None):
        def keep(f):
            if name in self.queries:
                raise ValueError(f"query {name} twice")
            self.queries[name] = f
            if sql is not None:
                self.sql[name] = sql
            return f

        return keep


# ---- parts of DuckDB SQL ---------------------------------------------------
def text_value(key: str, column: str = "metadata") -> str:
    """The value of a JSON key if it is a string."""
    return f"CASE WHEN json_valid({column}) THEN CASE WHEN json_type({column}, '$.{key}') = 'VARCHAR' THEN json_extract_string({column}, '$.{key}') END END"


WS = r"[\s\x0B\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"  # white space of any kind


def strip(c: str) -> str:
    return f"regexp_replace({c}, '^{WS}+|{WS}+$', '', 'g')"


def collapse(c: str) -> str:
    return strip(f"regexp_replace({c}, '{WS}+', ' ', 'g')")


def pieces(c: str) -> str:
    return f"list_filter(regexp_split_to_array({c}, '{WS}+'), lambda x: x <> '')"


def usable(c: str = "vector", dim: int = 64) -> str:
    return f"coalesce(len({c}) = {dim} AND len(list_filter({c}, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0 AND len(list_filter({c}, lambda x: x <> 0)) > 0, false)"


def timestamp(c: str) -> str:
    return rf"""CASE WHEN regexp_full_match({c}, '\d{{4}}-\d\d-\d\d[Tt ]\d\d:\d\d:\d\d(\.\d+)?([Zz]|[+-]\d\d:\d\d)') THEN TRY_CAST(upper({c}) AS TIMESTAMP)
      WHEN regexp_full_match({c}, '\d{{4}}-\d\d-\d\d( \d\d:\d\d:\d\d)?') THEN TRY_CAST({c} AS TIMESTAMP) END"""


def first_time(keys=("timestamp", "created_at", "indexed_at", "date", "time")) -> str:
    return "coalesce(" + ", ".join(timestamp("(" + text_value(k) + ")") for k in keys) + ")"


def first_present(keys=("timestamp", "created_at", "indexed_at", "date", "time")) -> str:
    return "coalesce(" + ", ".join(text_value(k) for k in keys) + ")"


def cut_words(c: str, n: int) -> str:
    return f"CASE WHEN length({c}) <= {n} THEN {c} ELSE regexp_replace(substr({c}, 1, {n}), ' [^ ]*$', '', 's') || '...' END"
