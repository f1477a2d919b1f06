"""Status codes found by words: personal history, long-term drugs, devices; inside a note's row.

``docs`` has ``doc_id, assessment, medications`` (texts, null where a note has no such section).
"""
from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.arrays import explode_rows, let
from ..knowledge import coding as kc
from ..knowledge import status as ks


def status_texts(docs: DataFrame) -> DataFrame:
    """Assessment and medication texts from ``sections``, an array of (section, text)."""
    def joined(names: list[str]) -> Column:
        own = F.filter("sections", lambda s: s["section"].isin(names))
        return F.nullif(F.array_join(F.transform(own, lambda s: s["text"]), "\n"), F.lit(""))

    both = F.struct(joined(kc.ASSESSMENT_SECTIONS + ["plan"]).alias("assessment"), joined(["medications", "current_medications"]).alias("medications"))
    # behind a generator the sections are found once, not once per phrase
    return docs.select("doc_id", F.explode_outer(F.array(both)).alias("x")).select("doc_id", "x.*")


def phrase(word: str) -> str:
    """Pattern of a phrase as whole words, for lower-case texts."""
    return rf"(?:^|[^a-z0-9]){re.escape(word.lower())}(?:[^a-z0-9]|$)"


def _first(text: Column, words: list[str]) -> Column:
    """The first of the words that the lower-case text holds, or null; a text is searched for a pattern only if it holds the letters."""
    return F.coalesce(*[F.when(F.contains(text, F.lit(w.lower())) & text.rlike(phrase(w)), F.lit(w)) for w in words])


def history_codes(docs: DataFrame) -> DataFrame:
    """``doc_id, disease, icd_code, description``: a malignancy in the personal history of the assessment."""
    pattern, code, description = ks.HISTORY
    hit = F.struct(F.trim(F.regexp_extract("assessment", pattern, 0)).alias("disease"), F.lit(code).alias("icd_code"), F.lit(description).alias("description"))
    # behind a generator the pattern is looked for once, not again for the test
    return explode_rows(docs, F.array(hit), "doc_id").where("disease <> ''")


def long_term_drugs(docs: DataFrame) -> DataFrame:
    """``doc_id, class, icd_code, drug, included, reason`` for each class among the medications.

    A class counts only if one of its drugs, or a condition it is taken for, is also in the
    assessment or plan; else the row says that the encounter is not concerned.
    """
    entry = lambda x, name, code, drugs: F.struct(
        F.lit(name).alias("class"), F.lit(code).alias("icd_code"), _first(x["meds"], drugs).alias("drug"), x["plan"].alias("plan"))
    told = lambda x: F.filter(F.array(*[entry(x, *c) for c in ks.LONG_TERM_DRUGS]), lambda e: e["drug"].isNotNull())
    # the assessment is asked for the classes that are taken only
    speaks = lambda e: F.coalesce(*[F.when(e["class"] == name, _first(e["plan"], drugs + ks.UNDERLYING[name]).isNotNull()) for name, _, drugs in ks.LONG_TERM_DRUGS])
    texts = F.struct(F.lower("medications").alias("meds"), F.lower(F.coalesce("assessment", F.lit(""))).alias("plan"))
    rows = F.transform(let(texts, told), lambda e: F.struct(e["class"].alias("class"), e["icd_code"].alias("icd_code"), e["drug"].alias("drug"), speaks(e).alias("included")))
    return explode_rows(docs, rows, "doc_id").withColumn("reason", F.when(~F.col("included"), F.lit(ks.NOT_RELEVANT)))


def device_codes(docs: DataFrame) -> DataFrame:
    """``doc_id, status, icd_code, trigger`` for each device or surgical status in the assessment or plan."""
    entry = lambda text, name, code, words: F.struct(F.lit(name).alias("status"), F.lit(code).alias("icd_code"), _first(text, words).alias("trigger"))
    rows = let(F.lower("assessment"), lambda text: F.filter(F.array(*[entry(text, *x) for x in ks.DEVICES]), lambda x: x["trigger"].isNotNull()))
    return explode_rows(docs, rows, "doc_id")
