"""The assessment's own words for a disease: they come first among its sources and may give its name."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.arrays import explode_rows, let
from ..knowledge.sections import ASSESSMENT_KEYS

#: A numbered item up to its colon or the end of the text.
ITEM = r"[0-9]+\.\s*([A-Za-z][^:\n]+?)(?:\s*:|\n?\z)"
LEAST_FRAGMENT, LEAST_MATCH = 3, 4


def title(text: Column) -> Column:
    """Every run of letters with a capital first."""
    return F.array_join(F.transform(F.regexp_extract_all(text, F.lit(r"\p{L}+|[^\p{L}]+"), F.lit(0)), lambda r: F.concat(F.upper(F.left(r, F.lit(1))), F.lower(F.substring(r, 2, 1_000_000)))), "")


def fragments(texts: Column) -> Column:
    """struct(body, parts, longer) of a document's assessment texts, in their order.

    ``parts`` are the pieces of numbered items between commas and slashes; ``longer`` maps the
    first piece of a slashed one to all of it (short, full), in order of first appearance with the
    last full form of each.
    """
    low = lambda t: F.transform(F.flatten(F.transform(t, lambda x: F.regexp_extract_all(x, F.lit(ITEM), F.lit(1)))), lambda i: F.lower(F.trim(i)))
    pieces = lambda items: F.transform(F.flatten(F.transform(items, lambda i: F.split(i, ","))), lambda p: F.transform(F.split(F.trim(p), "/"), lambda s: F.trim(s)))

    def of(p: Column) -> Column:
        slashed = F.filter(p, lambda s: (F.size(s) > 1) & (F.length(s[0]) >= LEAST_FRAGMENT))
        entries = F.transform(slashed, lambda s: F.struct(s[0].alias("short"), title(F.array_join(s, " ")).alias("full")))

        def last(e: Column) -> Column:
            back = F.reverse(e)
            names = F.transform(back, lambda x: x["short"])
            firsts = F.array_distinct(F.transform(e, lambda x: x["short"]))
            return F.transform(firsts, lambda n: F.element_at(back, F.array_position(names, n).cast("int")))

        return F.struct(F.array_distinct(F.filter(F.flatten(p), lambda s: F.length(s) >= LEAST_MATCH)).alias("parts"), let(entries, last).alias("longer"))

    body = F.concat(F.lit(" "), F.lower(F.array_join(texts, " ")))
    return let(let(low(texts), pieces), lambda p: let(of(p), lambda o: F.struct(body.alias("body"), o["parts"].alias("parts"), o["longer"].alias("longer"))))


def assessment_patch(rows: DataFrame, docs: DataFrame) -> DataFrame:
    """Rows whose name, or a fragment of it, is in their document's assessment get that source first.

    ``rows`` has ``doc_id, disease`` and ``sources``; ``docs`` has ``doc_id`` and ``sections`` (section, text).
    Such a row takes the name of a slashed item that covers it, if that is longer. Adds ``patched``.
    Rows of documents without assessment stay as they are.
    """
    own = F.transform(F.filter("sections", lambda s: s["section"].isin(ASSESSMENT_KEYS) & (F.trim(s["text"]) != "")), lambda s: s["text"])
    found = explode_rows(docs, F.array(let(own, lambda t: F.when(F.size(t) > 0, fragments(t)))), "doc_id")
    j = rows.join(found, "doc_id", "left")
    name = F.lower(F.trim("disease"))
    touches = lambda a: F.contains(a, name) | F.contains(name, a)
    inside = F.coalesce(F.col("body").isNotNull() & (F.contains("body", name) | F.exists("parts", touches)), F.lit(False))
    low = F.transform("sources", lambda s: F.lower(s))
    first = F.concat(F.array(F.lit("assessment")), F.filter("sources", lambda s: ~F.lower(s).isin(ASSESSMENT_KEYS)))
    fuller = F.get(F.filter("longer", lambda e: touches(e["short"]) & (F.length(e["full"]) > F.length(F.trim("disease")))), F.lit(0))["full"]
    return j.withColumn("patched", inside).withColumns({
        "sources": F.when(inside & ~F.array_contains(low, "assessment"), first).otherwise(F.col("sources")),
        "disease": F.when(inside, F.coalesce(fuller, F.col("disease"))).otherwise(F.col("disease")),
    }).drop("body", "parts", "longer")
