"""Array helpers: constant tables, regex matches with positions, row explosion."""
from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def constant_rows(rows: list[dict], ddl: str) -> Column:
    """A constant array of structs, written as one JSON literal (folded at planning time)."""
    return F.from_json(F.lit(json.dumps(rows, ensure_ascii=False)), f"array<struct<{ddl}>>")


def let(value: Column, body) -> Column:
    """``body(value)`` with the value computed once, however often the body uses it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def total_length(parts: Column) -> Column:
    return F.aggregate(parts, F.lit(0), lambda a, s: a + F.length(s))


def explode_rows(df: DataFrame, array: Column, *keep: str) -> DataFrame:
    """One row per struct of ``array``, its fields as columns.

    An outer explode keeps the optimizer from pushing a size test of the whole (costly)
    array expression below the projections that compute its inputs.
    """
    rows = df.select(*keep, F.explode_outer(array).alias("_x")).where("_x is not null")
    return rows.select(*keep, "_x.*")


MARK, INNER = "\ue000", "\ue001"


def matches(t: Column, pattern: str, group: int = 1, needs: str | None = None) -> Column:
    """All matches of ``pattern`` as an array of structs (start, stop, body, hit), 0-based.

    The text is searched once: every match is put between marks and the text cut there, so that gaps and
    matches alternate. A text that holds a mark itself is searched for its matches, groups and gaps one after another.
    ``needs``, if given, is a string that every match holds; a text without it is not searched.
    """
    def parts(marked: Column) -> Column:
        """struct(gap, body, hit) of every match, from the pieces between marks."""
        pieces = F.split(marked, MARK, -1)
        return let(pieces, lambda v: F.transform(F.filter(v, lambda _, i: i % 2 == 1), lambda m, k: let(
            F.split(m, INNER, -1), lambda x: F.struct(F.get(v, 2 * k).alias("gap"), F.get(x, F.lit(0)).alias("body"), F.get(x, F.lit(1)).alias("hit")))))

    def searched(text: Column) -> Column:
        hits, bodies = F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.regexp_extract_all(text, F.lit(pattern), F.lit(group))
        cut = F.struct(hits.alias("hits"), F.split(text, pattern, -1).alias("gaps"), bodies.alias("bodies"))
        return let(cut, lambda c: F.transform(c["hits"], lambda hit, k: F.struct(
            F.get(c["gaps"], k).alias("gap"), F.get(c["bodies"], k).alias("body"), hit.alias("hit"))))

    marked = F.regexp_replace(t, pattern, f"{MARK}${group}{INNER}$0{MARK}")
    found = F.when(F.contains(t, F.lit(MARK)) | F.contains(t, F.lit(INNER)), searched(t)).otherwise(parts(marked))

    def locate(v: Column) -> Column:
        def one(x: Column, k: Column) -> Column:
            before = F.aggregate(F.slice(v, F.lit(1), k), F.lit(0), lambda a, y: a + F.length(y["gap"]) + F.length(y["hit"]))
            return let(before + F.length(x["gap"]), lambda at: F.struct(
                at.alias("start"), (at + F.length(x["hit"])).alias("stop"), x["body"].alias("body"), x["hit"].alias("hit")))

        return F.transform(v, one)

    if needs is not None:
        found = F.when(F.contains(t, F.lit(needs)), found).when(t.isNotNull(), F.array().cast("array<struct<gap string, body string, hit string>>"))
    return let(found, locate)


def cuts(items: Column, starts) -> Column:
    """Runs of an array as structs (first, last) of 0-based indexes; ``starts(before, item)`` begins a new one."""
    def cut(v: Column) -> Column:
        every = F.when(F.size(v) > 0, F.sequence(F.lit(0), F.size(v) - 1)).otherwise(F.array().cast("array<int>"))
        firsts = F.filter(every, lambda i: (i == 0) | starts(F.get(v, i - 1), F.get(v, i)))
        return let(firsts, lambda f: F.transform(f, lambda s, k: F.struct(
            s.alias("first"), (F.coalesce(F.get(f, k + 1), F.size(v)) - 1).alias("last"))))

    return let(items, cut)


def runs(labels: Column) -> Column:
    """Runs of equal neighbours; nulls are equal."""
    return cuts(labels, lambda before, label: ~before.eqNullSafe(label))
