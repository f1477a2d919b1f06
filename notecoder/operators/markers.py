"""Visible section markers in a text: headers well apart, sections by content where headers are missing.

All steps are folds and maps over a note's own short arrays; the text never leaves its row.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.arrays import let
from . import lines as ln
from . import sections as se

# Least scores of header and canonical name, least distances and content, the opening gap, the opening's name.
SURE_HEADER, SURE_NAME, MATCH = 0.65, 0.60, 0.62
APART, LEAST_CONTENT, OPENING_GAP = 10, 40, 500
NARRATIVE = "General Clinical Narrative"
MARKER = "struct<position int, section string, inferred boolean>"


def spaced(markers: Column, apart: int = APART) -> Column:
    """Markers in text order, each at least ``apart`` characters behind the one kept before it."""
    def step(acc: Column, m: Column) -> Column:
        near = (F.size(acc) > 0) & (m["position"] - F.try_element_at(acc, F.lit(-1))["position"] < apart)
        return F.when(near, acc).otherwise(F.concat(acc, F.array(m)))

    return F.aggregate(markers, F.array().cast(f"array<{MARKER}>"), step)


def with_content(markers: Column, length: Column, least: int = LEAST_CONTENT) -> Column:
    """Markers followed by enough text up to the next one; a lone one stays, and allergies may be short."""
    def judge(v: Column) -> Column:
        span = lambda m, i: F.coalesce(F.get(v, i + 1)["position"], length) - m["position"]
        return F.when(F.size(v) < 2, v).otherwise(F.filter(v, lambda m, i: (span(m, i) >= least) | (m["section"] == "allergies")))

    return let(markers, judge)


def completed(headers: Column, inferred: Column) -> Column:
    """Header markers and those of inferred sections without one, in text order.

    Where all begin behind the first five hundred characters an opening marker is added, and a
    text without any gets it alone. Of markers at one place the later named stands first.
    """
    def merge(h: Column) -> Column:
        names = F.transform(h, lambda m: m["section"])
        every = F.concat(h, F.filter(inferred, lambda m: ~F.array_contains(names, m["section"])))
        opening = F.array(F.struct(F.lit(0).alias("position"), F.lit(NARRATIVE).alias("section"), F.lit(True).alias("inferred")).cast(MARKER))

        def open_(v: Column) -> Column:
            late = F.coalesce(F.array_min(F.transform(v, lambda m: m["position"])) > OPENING_GAP, F.lit(True))
            return F.when(late, F.concat(v, opening)).otherwise(v)

        keyed = lambda v: F.array_sort(F.transform(v, lambda m, i: F.struct(m["position"].alias("p"), (-i).alias("i"), m.alias("m"))))
        return F.transform(keyed(let(every, open_)), lambda k: k["m"])

    return let(headers, merge).cast(f"array<{MARKER}>")


def inserted(text: Column, markers: Column) -> Column:
    """The text with a line for each marker; markers stand in text order."""
    def tag(m: Column) -> Column:
        return F.concat(F.lit("\n═══ [SECTION: "), m["section"], F.when(m["inferred"], " (inferred)").otherwise(""), F.lit("] ═══\n"))

    def build(v: Column) -> Column:
        upto = lambda i: F.coalesce(F.get(v, i + 1)["position"], F.length(text))
        pieces = F.transform(v, lambda m, i: F.concat(tag(m), F.substring(text, m["position"] + 1, upto(i) - m["position"])))
        return F.concat(F.substring(text, F.lit(1), F.coalesce(F.get(v, F.lit(0))["position"], F.length(text))), F.array_join(pieces, ""))

    return let(markers, build)


def with_markers(docs: DataFrame, text: str = "text") -> DataFrame:
    """Add ``markers`` (position, section, inferred) and ``marked``, the text with them; a null text counts as empty."""
    docs = docs.withColumn(text, F.coalesce(F.col(text), F.lit("")))
    docs = ln.with_inferred(se.with_candidates(docs, text), text)
    sure = F.filter("candidates", lambda c: c["confidence"] >= SURE_HEADER)
    docs = docs.withColumn("candidates", sure).withColumn("_m", se.names_of(F.transform("candidates", lambda c: c["header"]), MATCH))
    named = F.transform("candidates", lambda c, i: let(F.get(F.col("_m"), i), lambda m: F.struct(
        c["position"].alias("position"), F.when(m["score"] >= SURE_NAME, m["section"]).alias("section"), F.lit(False).alias("inferred"))))
    known = F.filter(named, lambda m: m["section"].isNotNull()).cast(f"array<{MARKER}>")
    headers = with_content(spaced(known), F.length(text))
    more = F.transform("inferred", lambda s: F.struct(s["start"].alias("position"), s["section"].alias("section"), F.lit(True).alias("inferred"))).cast(f"array<{MARKER}>")
    docs = docs.withColumn("markers", completed(headers, more))
    return docs.withColumn("marked", inserted(F.col(text), F.col("markers"))).drop("candidates", "_m", "inferred", "inferred_confidence")
