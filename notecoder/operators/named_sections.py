"""Sections that a model named or quoted, held against the note."""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.arrays import let
from ..knowledge import sections as ks
from . import sections as se

# The section of what fits no other, and the score from which a header overrules a valid name.
OTHER, SURE = "other", 0.90
#: Least length of a quotation, and the characters of it that are located exactly and loosely.
LEAST, EXACT_CHARS, LOOSE_CHARS = 10, 60, 30


def section_name_fix(entries: DataFrame, threshold: float = 0.62) -> DataFrame:
    """``doc_id, key, section`` from ``doc_id, ord, header, named``.

    A name that is no section's gives way to the section its header matches, or ``other``; a
    valid one only to a match of ``SURE`` or more. Of entries with one key the last counts; a
    header without a key is left out. A worker scores a header once; entries meet no other table.
    """
    rows = entries.select("doc_id", "ord", F.trim(F.lower(F.coalesce("named", F.lit(OTHER)))).alias("named"), F.get(se.names_of(F.array("header"), threshold), F.lit(0)).alias("m"))
    valid = F.col("named").isin([name for name, _ in ks.SECTION_VARIANTS] + [OTHER])
    section = (F.when(~valid, F.coalesce("m.section", F.lit(OTHER)))
               .when(F.col("m.section").isNotNull() & (F.col("m.score") >= SURE), F.col("m.section")).otherwise(F.col("named")))
    fixed = rows.where("m.key <> ''").select("doc_id", "ord", F.col("m.key").alias("key"), section.alias("section"))
    return fixed.groupBy("doc_id", "key").agg(F.max_by("section", F.struct("ord", "section")).alias("section"))


def verbatim_sections(quoted: DataFrame, docs: DataFrame) -> DataFrame:
    """``doc_id, section, text, start, stop`` from ``doc_id, ord, name, content`` and the notes.

    The start is where the note has the quotation's first 60 characters; else where it has
    the first 30 with white space squeezed, in any case; else 0. The stop is one quotation
    further. Short quotations go; of those with one lower-case name the last counts, before
    the note is looked at. Notes without quotations are not read past the join.
    """
    body = F.coalesce("content", F.lit(""))
    kept = quoted.where(F.length(se.strip(body)) >= LEAST).select("doc_id", F.lower("name").alias("section"), "ord", "content")
    last = kept.groupBy("doc_id", "section").agg(F.max_by("content", F.struct("ord", "content")).alias("content"))
    rows = last.join(docs.select("doc_id", F.col("text").alias("note")), "doc_id")
    loose = F.lower(F.regexp_replace(se.strip(F.left("content", F.lit(LOOSE_CHARS))), r"\s+", " "))
    exact = F.position(F.left("content", F.lit(EXACT_CHARS)), F.col("note"))
    start = let(exact, lambda e: F.when(e > 0, e - 1).otherwise(F.greatest(F.position(loose, F.lower("note")) - 1, F.lit(0))))
    out = rows.select("doc_id", "section", "content", start.alias("start"))
    return out.select("doc_id", "section", se.clean_content(F.col("content")).alias("text"), "start", (F.col("start") + F.length("content")).alias("stop"))
