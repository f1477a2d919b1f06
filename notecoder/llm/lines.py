"""Line dedup: a fixed-depth template tree generalises lines; recurring templates are dropped.

DataFrame functions only. A line goes down the tree by its number of tokens and its first
tokens to a leaf. A token with a digit is a wildcard from the start; the other wildcards are
learned in each leaf from how often its lines have a token at a place, with no limit on the
number or place of varying fields and for lines of any length.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.arrays import let
from .shared import SEPARATOR_CHARS, words, written

#: Tokens of a leaf's path, documents in which a template recurs.
DEPTH, MIN_DOCS = 2, 10
WILD = "<*>"


def _tokens(line: Column) -> Column:
    """Words of a line, those with a digit as wildcards."""
    masked = F.when(line.rlike("[0-9]"), F.regexp_replace(line, "[^\\x20\\x09-\\x0D]*[0-9][^\\x20\\x09-\\x0D]*", WILD)).otherwise(line)
    # a line of wildcards alone says nothing about its form; it is taken as it stands
    constant = F.length(F.translate(F.regexp_replace(masked, "<\\*>", ""), SEPARATOR_CHARS, "")) > 0
    return words(F.when(constant, masked).otherwise(line))


def _placed(tokens: Column, depth: int = DEPTH) -> Column:
    """Leaf, own hash and number of tokens of a line."""
    n = F.size(tokens)
    return F.struct(F.xxhash64(n, F.slice(tokens, 1, depth)).alias("leaf"), F.xxhash64(n, tokens).alias("variant"), n.alias("n"))


def learned_templates(lines: DataFrame, min_docs: int = MIN_DOCS) -> DataFrame:
    """``variant, form``: templates learned from ``lines`` (``leaf, variant, n, body``).

    A token's count is that of the leaf's lines with it at its place. A line has a template
    for each count of at least ``min_docs`` in it: tokens with that count or more are
    constant, all others wildcards, however many and wherever. A field's values are each
    rarer than the words around it, so lines that differ in fields only meet in one. At
    least half of a line's tokens must be constant, and tokens with digits never are; that
    holds for short lines too. Tokens with equal counts are constant together, repeated
    lines count as often as they occur, a null body has no tokens, and no lines give no
    templates.
    """
    # a leaf of fewer lines has no token that is frequent enough
    leaves = written(lines.groupBy("leaf").agg(F.count("*").alias("c")).where(F.col("c") >= min_docs).select("leaf"), "leaves")
    # equal lines are counted once with their number; after this a leaf's common line is one row
    variants = lines.join(leaves, "leaf", "left_semi").groupBy("leaf", "variant", "n").agg(F.count("*").alias("c"), F.first("body").alias("body"))
    fixed = lambda w: ~w.rlike("[0-9]") & (w != WILD)
    places = F.posexplode(F.transform(_tokens(F.col("body")), lambda w: F.when(fixed(w), F.xxhash64(w))))
    tokens = written(variants.select("leaf", "variant", "n", "c", places.alias("place", "h")).where("h is not null"), "tokens")
    counts = tokens.groupBy("leaf", "place", "h").agg(F.sum("c").alias("count")).where(F.col("count") >= min_docs)
    known = tokens.join(written(counts, "counts"), ["leaf", "place", "h"])
    lists = known.groupBy("leaf", "variant", "n").agg(F.sort_array(F.collect_list(F.struct("place", "h", "count"))).alias("t")).where(2 * F.size("t") >= F.col("n"))
    above = lambda least: F.transform(F.filter("t", lambda x: x["count"] >= least), lambda x: F.struct(x["place"], x["h"]))
    levels = F.transform(F.array_distinct(F.transform("t", lambda x: x["count"])), above)
    forms = F.transform(F.filter(levels, lambda x: 2 * F.size(x) >= F.col("n")), lambda x: F.xxhash64(F.lit(-3), "leaf", x))
    return lists.select("variant", F.explode(forms).alias("form"))


def recurring_lines(docs: DataFrame, min_docs: int = MIN_DOCS, depth: int = DEPTH) -> DataFrame:
    """``_rk`` and ``gone``, the ascending numbers (from 0) of lines to drop; other documents are absent.

    ``docs`` has ``_doc, _rk, text``. A line's templates are its own tokens and those learned
    in its leaf. It goes if one of them is in ``min_docs`` documents or more and the line is
    not the first with it, by document id and line number.
    """
    of = lambda s: F.struct(let(_tokens(s), lambda w: _placed(w, depth)).alias("at"), s.alias("body"))
    numbered = F.posexplode(F.transform(F.split("text", "\n", -1), of))
    lines = docs.select("_doc", "_rk", numbered.alias("line", "x")).select("_doc", "_rk", "line", "x.at.*", "x.body").where("n > 0")
    # texts of lines are written too, so that templates are learned without a second pass over the documents
    lines = written(lines, "lines")
    learned = written(learned_templates(lines.select("leaf", "variant", "n", "body"), min_docs), "learned")
    at = lines.select("_doc", "_rk", "line", "variant")
    forms = at.withColumnRenamed("variant", "form").unionByName(written(at.join(learned, "variant").drop("variant"), "varied"))
    # templates on too few lines are on too few documents; only the others need be looked at by document
    many = written(forms.groupBy("form").agg(F.count("*").alias("c")).where(F.col("c") >= min_docs).select("form"), "frequent")
    some = written(forms.join(many, "form", "left_semi"), "recurring")
    per_doc = some.groupBy("form", "_rk").agg(F.min(F.struct("_doc", "line")).alias("at"))
    often = per_doc.groupBy("form").agg(F.count("*").alias("docs"), F.min("at").alias("first")).where(F.col("docs") >= min_docs)
    often = written(often.select("form", "first"), "templates")
    # a document's list is no longer than the document
    gone = some.join(often, "form").where(~F.struct("_doc", "line").eqNullSafe(F.col("first")))
    return gone.groupBy("_rk").agg(F.sort_array(F.collect_set("line")).alias("gone"))


def without_recurring_lines(docs: DataFrame, min_docs: int = MIN_DOCS, depth: int = DEPTH) -> DataFrame:
    """``docs`` with the lines dropped from ``text``, and with ``n_lines``, ``n_dropped``, ``emptied``.

    A null text has no lines and stays null. Lines without words are neither counted as
    recurring nor dropped. ``emptied`` is true where a text had words and has none left.
    Rows that share id and text are one document. The first holder of a template keeps it,
    so no content is lost altogether; a row without id comes before all others. Columns
    named like the new ones are replaced. An empty table gives an empty one.
    """
    new = ("n_lines", "n_dropped", "emptied")
    keep = [c for c in docs.columns if c.lower() not in new]
    rows = docs.select(F.struct(*keep).alias("_row"), F.col("text").alias("text"), F.xxhash64("doc_id", "text").alias("_rk"),
                       F.coalesce(F.col("doc_id").cast("long"), F.lit(-(2**63))).alias("_doc"))
    found = recurring_lines(rows.select("_doc", "_rk", "text"), min_docs, depth)
    # the lists grow with the corpus, so they are never broadcast
    out = rows.select("_row", "_rk", "text").join(written(found, "gone").hint("merge"), "_rk", "left")
    # between two dropped lines lies a slice of kept ones
    def slices(parts: Column) -> Column:
        stops = F.concat("gone", F.array(F.size(parts)))
        cut = lambda stop, i: let(F.when(i == 0, F.lit(0)).otherwise(F.get(stops, i - 1) + 1), lambda a: F.slice(parts, a + 1, stop - a))
        return F.array_join(F.flatten(F.transform(stops, cut)), "\n")

    parts = F.split("text", "\n", -1)
    kept = F.when(F.col("gone").isNull(), F.col("text")).otherwise(let(parts, slices))
    blank = lambda c: F.length(F.translate(c, SEPARATOR_CHARS, "")) == 0
    out = out.select("_row", F.coalesce(F.size("gone"), F.lit(0)).alias("k"), F.coalesce(F.size(parts), F.lit(0)).cast("long").alias("n_lines"), kept.alias("kept"))
    out = out.withColumns({"n_dropped": F.greatest("k", F.lit(0)).cast("long"), "emptied": (F.col("k") > 0) & blank("kept")})
    return out.select(*[(F.col("kept") if c == "text" else F.col("_row").getField(c)).alias(c) for c in keep], *new)
