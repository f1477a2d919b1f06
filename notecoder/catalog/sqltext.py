"""Small SQL builders shared by the check texts."""
from __future__ import annotations


def q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def lst(options) -> str:
    return "[" + ", ".join(q(o) for o in options) + "]"


def values(rows, names: str) -> str:
    """A named VALUES list, e.g. ``kw(ord, word)``."""
    def one(v):
        return q(v) if isinstance(v, str) else ("true" if v is True else "false" if v is False else str(v))
    body = ", ".join("(" + ", ".join(one(v) for v in r) + ")" for r in rows)
    return f"{names} as (values {body})"


def has_any(expr: str, options) -> str:
    """True where ``expr`` contains one of the strings."""
    return f"len(list_filter({lst(options)}, lambda kw: contains({expr}, kw))) > 0"


def strip(expr: str) -> str:
    return f"regexp_replace({expr}, '^\\s+|\\s+$', '', 'g')"


def squeeze(expr: str) -> str:
    return f"trim(regexp_replace({expr}, '\\s+', ' ', 'g'))"


def edges(expr: str, chars: str) -> str:
    return f"regexp_replace({expr}, '^[{chars}]+|[{chars}]+$', '', 'g')"
