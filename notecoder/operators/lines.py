"""Sections from what lines say, for notes without clean headers.

Lines are classified by patterns, neighbours of one class form islands, unclassified islands
between two of one class are absorbed, and islands become sections. All of it stays in the
note's row, so no text is shuffled; every step is linear in the number of lines.
"""
from __future__ import annotations

import re
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType

from ..functions.arrays import explode_rows, let, runs
from ..knowledge.lines import LEAST_SECTION, LINE_PATTERNS, OTHER
from . import sections as se

CLUSTERS = "array<struct<section string, start_line int, end_line int, confidence double, lines array<string>>>"


#: Heaviest first, of equal weights the first; \b, \s and letters without case are those of ASCII.
_ORDER = sorted(range(len(LINE_PATTERNS)), key=lambda x: (-LINE_PATTERNS[x][1], x))
_SEARCHES = [(x, re.compile(LINE_PATTERNS[x][2], re.ASCII).search) for x in _ORDER]
SPACE = " \t\n\v\f\r"


def pattern_of(line: str) -> int | None:
    """The number of the heaviest pattern that fits a line, one behind the last for none; None for a blank line."""
    body = line.strip(SPACE)
    return next((x for x, search in _SEARCHES if search(body)), len(LINE_PATTERNS)) if body else None


@lru_cache(maxsize=100_000)
def repeated_pattern_of(line: str) -> int | None:
    return pattern_of(line)


@F.arrow_udf(ArrayType(IntegerType()))
def patterns_of(lines: pa.Array) -> pa.Array:
    """``pattern_of`` every line; lines that repeat in a batch, or short ones of earlier batches, are judged once."""
    found = lines.values.dictionary_encode()
    numbers = pa.array([repeated_pattern_of(v) if len(v) <= 200 else pattern_of(v) for v in found.dictionary.to_pylist()], pa.int32())
    return pa.ListArray.from_arrays(lines.offsets, numbers.take(found.indices))


def line_classes(numbers: Column) -> Column:
    """``line, section, confidence`` of every line that isn't blank, in order."""
    sections = F.array(*[F.lit(section) for section, _, _ in LINE_PATTERNS], F.lit(OTHER))
    weights = F.array(*[F.lit(weight) for _, weight, _ in LINE_PATTERNS], F.lit(0.0))
    return F.filter(F.transform(numbers, lambda n, i: F.when(n.isNotNull(), F.struct(
        i.alias("line"), F.get(sections, n).alias("section"), F.get(weights, n).alias("confidence")))), lambda c: c.isNotNull())


def clusters(lines: Column, marks: Column) -> Column:
    """Islands of neighbouring lines of one class; blank lines inside an island belong to it."""
    def island(m: Column, r: Column) -> Column:
        own = F.slice(m, r["first"] + 1, r["last"] - r["first"] + 1)
        mean = F.aggregate(own, F.lit(0.0), lambda a, c: a + c["confidence"]) / F.size(own)
        return let(F.struct(F.get(m, r["first"]).alias("a"), F.get(m, r["last"]).alias("b"), mean.alias("mean")), lambda e: F.struct(
            e["a"]["section"].alias("section"), e["a"]["line"].alias("start_line"), e["b"]["line"].alias("end_line"), e["mean"].alias("confidence"),
            F.slice(lines, e["a"]["line"] + 1, e["b"]["line"] - e["a"]["line"] + 1).alias("lines")))

    return let(marks, lambda m: F.transform(runs(F.transform(m, lambda c: c["section"])), lambda r: island(m, r))).cast(CLUSTERS)


def inherited(found: Column) -> Column:
    """Unclassified islands between two of one class are absorbed; neighbours of one class merge.

    A merged island has the greatest confidence of its classified parts; blank lines between
    islands are not part of it. One pass reaches the fixed point, since islands alternate.
    """
    def relabel(v: Column) -> Column:
        def one(c: Column, i: Column) -> Column:
            before, after = F.get(v, i - 1)["section"], F.get(v, i + 1)["section"]
            return F.when((c["section"] == OTHER) & (before == after), before).otherwise(c["section"])

        return F.transform(v, one)

    def merge(v: Column) -> Column:
        def one(label: Column, own: Column) -> Column:
            sure = F.filter(own, lambda c: c["section"] == label)
            return F.struct(
                label.alias("section"), F.get(own, F.lit(0))["start_line"].alias("start_line"), F.element_at(own, -1)["end_line"].alias("end_line"),
                F.array_max(F.transform(sure, lambda c: c["confidence"])).alias("confidence"), F.flatten(F.transform(own, lambda c: c["lines"])).alias("lines"))

        return let(relabel(v), lambda labels: F.transform(runs(labels), lambda r: let(
            F.slice(v, r["first"] + 1, r["last"] - r["first"] + 1), lambda own: one(F.get(labels, r["first"]), own))))

    return let(found, merge).cast(CLUSTERS)


SECTIONS = "array<struct<section string, text string, start int, end int>>"


def built(text: Column, islands: Column) -> Column:
    """Sections of classified islands with at least ten characters, in order of first appearance.

    A section starts where its first line first occurs in the text. Further islands are appended
    unless the section's text contains theirs already.
    """
    def entry(c: Column) -> Column:
        content = se.strip(F.array_join(c["lines"], "\n"))
        start = F.instr(text, se.strip(F.get(c["lines"], F.lit(0)))) - 1
        return let(F.struct(content.alias("t"), F.greatest(start, F.lit(0)).alias("s")), lambda e: F.struct(
            c["section"].alias("section"), e["t"].alias("text"), e["s"].alias("start"), (e["s"] + F.length(e["t"])).alias("end")))

    def add(acc: Column, e: Column) -> Column:
        grown = lambda a: F.when(F.contains(a["text"], e["text"]), a).otherwise(F.struct(
            a["section"].alias("section"), F.concat(a["text"], F.lit("\n\n"), e["text"]).alias("text"), a["start"].alias("start"), F.greatest(a["end"], e["end"]).alias("end")))
        return F.when(F.exists(acc, lambda a: a["section"] == e["section"]),
                      F.transform(acc, lambda a: F.when(a["section"] == e["section"], grown(a)).otherwise(a))).otherwise(F.concat(acc, F.array(e)))

    entries = F.transform(F.filter(islands, lambda c: c["section"] != OTHER), entry)
    return F.aggregate(F.filter(entries, lambda e: F.length(e["text"]) >= LEAST_SECTION), F.array().cast(SECTIONS), add)


def overall(marks: Column) -> Column:
    """Mean confidence of classified lines, lowered by the share of lines that are not."""
    def of(m: Column) -> Column:
        sure = F.filter(m, lambda c: c["section"] != OTHER)
        mean = F.aggregate(sure, F.lit(0.0), lambda a, c: a + c["confidence"]) / F.size(sure)
        return F.when(F.size(sure) > 0, F.rint(F.least(mean * (0.5 + 0.5 * F.size(sure) / F.size(m)), F.lit(1.0)) * 100) / 100).otherwise(F.lit(0.0))

    return let(marks, of)


def with_marks(docs: DataFrame, text: str = "text") -> DataFrame:
    """Add ``lines`` and ``marks``, the classes of the lines that aren't blank; a null text has none."""
    docs = docs.withColumn("lines", F.split(F.coalesce(F.col(text), F.lit("")), "\n", -1))
    docs = docs.withColumn("_n", patterns_of("lines"))
    return docs.withColumn("marks", line_classes(F.col("_n"))).drop("_n")


def with_inferred(docs: DataFrame, text: str = "text") -> DataFrame:
    """Add ``inferred`` (section, text, start, end) and ``inferred_confidence``."""
    docs = with_marks(docs, text)
    found = let(F.struct("lines", "marks"), lambda d: F.struct(
        built(F.col(text), inherited(clusters(d["lines"], d["marks"]))).alias("sections"), overall(d["marks"]).alias("confidence")))
    docs = docs.withColumn("_i", found)
    return docs.withColumns({"inferred": F.col("_i.sections"), "inferred_confidence": F.col("_i.confidence")}).drop("_i", "lines", "marks")


def line_classifier(docs: DataFrame) -> DataFrame:
    """One row per line that isn't blank: ``doc_id, line, section, confidence``."""
    return explode_rows(with_marks(docs), F.col("marks"), "doc_id")


def cluster_lines(docs: DataFrame) -> DataFrame:
    """One row per island: ``doc_id, section, start_line, end_line, confidence, lines``."""
    return explode_rows(with_marks(docs), clusters(F.col("lines"), F.col("marks")), "doc_id")


def inherit_context(docs: DataFrame) -> DataFrame:
    """One row per island after absorption and merging."""
    return explode_rows(with_marks(docs), inherited(clusters(F.col("lines"), F.col("marks"))), "doc_id")


def build_sections(docs: DataFrame) -> DataFrame:
    """One row per inferred section: ``doc_id, confidence, section, text, start, end``."""
    return explode_rows(with_inferred(docs).withColumnRenamed("inferred_confidence", "confidence"), F.col("inferred"), "doc_id", "confidence")


# --- joined with the sections that headers give ---------------------------------------
def header_spans(text: Column, slices: Column) -> Column:
    """Where each section's first content lies: (section, start, end) in order of appearance.

    The content starts behind the line in which the header's words first occur.
    """
    usable = F.filter(
        F.transform(slices, lambda s: F.struct(s["section"].alias("section"), s["key"].alias("key"), se.clean_content(s["text"]).alias("text"))),
        lambda s: (s["text"] == "N/A") | (F.length(s["text"]) >= LEAST_SECTION))

    def one(s: Column) -> Column:
        at = F.instr(F.lower(text), F.lower(s["key"]))
        eol = F.instr(F.substring(text, at, F.length(text)), "\n")
        start = F.when(at == 0, F.instr(text, F.substring(s["text"], 1, 60)) - 1).when(eol > 0, at + eol - 1).otherwise(at - 1 + F.length(s["key"]))
        return let(start, lambda b: F.struct(
            s["section"].alias("section"), F.greatest(b, F.lit(0)).alias("start"), F.when(b >= 0, b + F.length(s["text"])).otherwise(F.lit(0)).alias("end")))

    def firsts(u: Column) -> Column:
        return let(F.transform(u, lambda s: s["section"]), lambda names: F.transform(
            F.array_distinct(names), lambda n: one(F.element_at(u, F.array_position(names, n).cast("int")))))

    return let(usable, firsts)


def clear_of(spans: Column, extra: Column) -> Column:
    """The entries of ``extra`` (section, start, end, ...) that ``spans`` lacks by name and that overlap none before them.

    An entry that is taken counts for those after it. Both hold at most one entry per section
    name, so the fold is short whatever the text's length.
    """
    none = F.array().cast("array<struct<section string, start int, end int>>")

    def take(acc: Column, e: Column) -> Column:
        meets = lambda s: (s["section"] == e["section"]) | ((e["start"] < s["end"]) & (e["end"] > s["start"]))
        new = F.struct(e["section"].alias("section"), e["start"].alias("start"), e["end"].alias("end"))
        return F.when(F.exists(F.concat(spans, acc), meets), acc).otherwise(F.concat(acc, F.array(new)))

    taken = F.aggregate(extra, none, take)
    return let(F.transform(taken, lambda s: s["section"]), lambda names: F.filter(extra, lambda e: F.array_contains(names, e["section"])))


def with_enriched(docs: DataFrame, method: str = "levenshtein") -> DataFrame:
    """Add ``sections``: those of headers, then inferred ones where neither name nor place is taken.

    Each has ``section, text, start, end, source`` (``header`` or ``content``).
    """
    docs = with_inferred(se.with_slices(se.with_headers(docs, method)))
    # bound once: referred to as columns inside the inner functions they could be inlined there and computed per section
    found = F.struct(se.merge_slices(F.col("slices")).alias("merged"), header_spans(F.col("text"), F.col("slices")).alias("spans"), F.col("inferred").alias("extra"))

    def joined(d: Column) -> Column:
        own = F.transform(d["spans"], lambda s, i: F.struct(
            s["section"].alias("section"), F.get(d["merged"], i)["text"].alias("text"), s["start"].alias("start"), s["end"].alias("end"), F.lit("header").alias("source")))
        more = F.transform(clear_of(d["spans"], d["extra"]), lambda e: F.struct(
            e["section"].alias("section"), e["text"].alias("text"), e["start"].alias("start"), e["end"].alias("end"), F.lit("content").alias("source")))
        return F.concat(own, more)

    return docs.withColumn("sections", let(found, joined)).drop("inferred", "candidates", "headers", "slices")


def enrich_sections(docs: DataFrame, method: str = "levenshtein") -> DataFrame:
    """One row per section of headers and content: ``doc_id, section, text, start, end, source``."""
    return explode_rows(with_enriched(docs, method), F.col("sections"), "doc_id")
