"""Disease mentions of a text: five detectors, filters, merging and sentence links.

Detection is an array expression over one text, so it runs inside the row of a document or
of a section and shuffles nothing.
"""
from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as tx
from ..functions.arrays import constant_rows, explode_rows, let, matches
from ..knowledge import abbreviations as ab
from ..knowledge import clinical as kn
from ..knowledge import sections as ks

M = "(?d)(?m)"
# Detector patterns (the mention is the named group number) and confidences.
NUMBERED = M + r"(?:^|\n)\s*([0-9]{1,2})\.\s*([A-Z][^:\n]{2,80}?)(?:\s*:|$)"
BULLET = M + r"(?:^|\n)\s*[•\-*►▪▸]\s*([A-Z][A-Za-z0-9,/\s\-()]{2,80}?)(?:\s*$|\s*(?:Active|Inactive|Resolved|History|[0-9]{1,2}/[0-9]{1,2}/[0-9]{2,4}))"
BULLET_RUN = M + r"[•]\s*([A-Z][A-Za-z\s\-,/()]{2,60}?)(?=\s*[•]|\s*$)"
PREFIXED = (
    r"(?i)(?:history\s+of|h/o|diagnosed\s+with|diagnosis\s+of|known|assessment\s*(?:of)?|impression\s*:?)\s+"
    r"([A-Z][A-Za-z0-9,/\s\-()]{2,60})"
)
PREFIX_STOP = r"(?i)\b(?:and|with|on|for|since|but|that|which|who|was|will|she|he|is)\b"
SUFFIXED = r"(?i)(?:" + "|".join(kn.DISEASE_SUFFIXES) + r")\b"
CONFIDENCE = {"numbered": 0.90, "bulleted": 0.85, "bullet_run": 0.80, "prefixed": 0.70, "suffixed": 0.65}
REJECT = [
    r"\A[0-9]+\z", r"[0-9]+\s*(?:mg|mcg|ml|units?|tabs?|caps?)", r"\A[0-9]{1,2}/[0-9]{1,2}/[0-9]{2,4}\z",
    r"(?i)\A(?:dr|mr|mrs|ms|md|do|np|pa|rn)\.?\s", r"(?i)ectomy\b", r"(?i)plasty\b", r"(?i)otomy\b",
    r"(?i)ostomy\b", r"(?i)\bpost[\s-]?op\b",
    r"(?i)\A(?:Continue|Monitor|Maintain|Refer|Counsel|Discuss|Order|Schedule|Return)\b",
    r"(?i)\bvaccine\b", r"(?i)\bimmunization\b",
]


def strip(c: Column) -> Column:
    return F.regexp_replace(c, r"\A\s+|\s+\z", "")


def _comma_parts(items: Column) -> Column:
    return F.flatten(F.transform(items, lambda s: F.transform(F.split(strip(s), r",\s+"), strip)))


def numbered(text: Column) -> Column:
    return _comma_parts(F.regexp_extract_all(text, F.lit(NUMBERED), F.lit(2)))


def bulleted(text: Column) -> Column:
    return F.transform(F.regexp_extract_all(text, F.lit(BULLET), F.lit(1)), strip)


def bullet_run(text: Column) -> Column:
    found = F.transform(F.regexp_extract_all(text, F.lit(BULLET_RUN), F.lit(1)), strip)
    return F.filter(found, lambda s: ~s.rlike(r"\A[0-9]{1,2}/[0-9]{1,2}/[0-9]{2,4}"))


def prefixed(text: Column) -> Column:
    raw = F.regexp_extract_all(text, F.lit(PREFIXED), F.lit(1))
    cut = F.transform(raw, lambda s: strip(F.split(strip(s), PREFIX_STOP, 2)[0]))
    return F.filter(_comma_parts(cut), lambda s: F.length(s) >= 3)


def suffixed(text: Column) -> Column:
    def phrase(m: Column) -> Column:
        start = F.greatest(m["start"] - 60, F.lit(0))
        snippet = F.substring(text, start + 1, m["stop"] - start)
        pattern = F.concat(F.lit(r"([A-Z][A-Za-z\s\-]{0,50}?"), m["hit"], F.lit(")"))
        return strip(F.call_function("regexp_extract", snippet, pattern, F.lit(1)))

    return F.filter(F.transform(matches(text, SUFFIXED, 0), phrase), lambda s: s != "")


DETECTORS = {"numbered": numbered, "bulleted": bulleted, "bullet_run": bullet_run, "prefixed": prefixed, "suffixed": suffixed}


def accepted(name: Column, norm: Column) -> Column:
    """Whether a cleaned name passes the length, stop-word, drug and pattern tests."""
    rejected = name.rlike("|".join(f"(?i:{p[4:]})" if p.startswith("(?i)") else f"(?:{p})" for p in REJECT))
    first = F.split(norm, r"\s+")[0]
    return (
        (F.length(name) >= 3) & ~(~F.contains(norm, F.lit(" ")) & norm.isin(kn.SINGLE_WORD_REJECT))
        & ~first.isin(kn.MEDICATION_NAMES) & ~norm.isin(kn.MEDICATION_NAMES) & ~rejected
    )


def mention_array(text: Column, section: Column) -> Column:
    """Accepted mentions of one text in detector order, the first of each normalized name."""
    found = F.concat(*[_tagged(fn(text), d) for d, fn in DETECTORS.items()])
    named = F.transform(found, lambda x: let(tx.clean_mention_name(x["raw"]), lambda n: F.struct(
        n.alias("disease"), F.trim(F.lower(n)).alias("norm"), x["confidence"].alias("confidence"), x["detector"].alias("detector"))))
    kept = F.filter(named, lambda x: accepted(x["disease"], x["norm"]))
    first = let(kept, lambda a: let(F.transform(a, lambda y: y["norm"]), lambda norms: F.filter(
        a, lambda x, i: F.array_position(norms, x["norm"]) == i + 1)))
    return F.when(
        F.lower(section).isin(ks.NON_DISEASE_SECTIONS),
        F.array().cast("array<struct<disease string, norm string, confidence double, detector string>>"),
    ).otherwise(first)


def _tagged(items: Column, detector: str) -> Column:
    return F.transform(items, lambda s: F.struct(
        s.alias("raw"), F.lit(CONFIDENCE[detector]).alias("confidence"), F.lit(detector).alias("detector")))


def mentions(docs: DataFrame, text: str = "text") -> DataFrame:
    """Mentions of whole documents, numbered in detector order."""
    arr = F.transform(mention_array(F.col(text), F.lit("unknown")), lambda m, i: m.withField("ord", i))
    return explode_rows(docs, arr, "doc_id")


PROBLEM_SPLIT = r"\s+Active\s+[0-9]{1,2}/[0-9]{1,2}/[0-9]{2,4}"
PROBLEM_META = M + r"(?i)History\s+Type:.*\z|Orthopaedic\s+Complexity:.*\z|Acute,?\s*\z|Uncomplicated\s*\z|History\s*\z"


def problem_array(text: Column) -> Column:
    """Entries of a structured problem list: the last line before each "Active <date>"."""
    def name_of(part: Column) -> Column:
        lines = F.filter(F.transform(F.split(strip(F.regexp_replace(part, PROBLEM_META, "")), "\n"), strip), lambda s: s != "")
        last = F.coalesce(F.try_element_at(lines, F.lit(-1)), F.lit(""))
        return strip(F.regexp_replace(last, r"\A[,:\s]+|[,:\s]+\z", ""))

    skip = "|".join(kn.PROBLEM_SKIP_PARTS)
    ok = lambda n: (
        (F.length(n) >= 4) & ~F.lower(n).isin(kn.PROBLEM_SKIP) & ~F.lower(n).rlike(skip)
        & ~n.rlike(r"(?i)ectomy|plasty|otomy|ostomy|post[\s-]?op")
    )
    key = lambda n: F.array_join(F.array_sort(F.split(F.lower(n), r"\s+")), " ")
    kept = F.transform(
        F.filter(F.transform(F.split(text, PROBLEM_SPLIT, -1), name_of), ok),
        lambda n: F.struct(n.alias("disease"), F.lower(n).alias("norm"), key(n).alias("key")),
    )
    return let(kept, lambda a: F.filter(a, lambda x, i: F.array_position(F.transform(a, lambda y: y["key"]), x["key"]) == i + 1))


def implied_array(medications: Column, present: Column) -> Column:
    """Diseases implied by drugs in a medication text, unless a present name covers them."""
    def covered(name: str) -> Column:
        own = tx.literal_array(sorted(set(name.split())))
        return F.exists(present, lambda p: (p == name) | (F.size(F.array_intersect(own, F.split(p, r"\s+"))) / F.size(own) >= 0.6))

    def implied(low: Column) -> Column:
        # plain tests of fixed words, one after the other: a pattern out of a table would be compiled anew for every text
        told = lambda drugs: reduce(lambda x, y: x | y, [F.contains(low, F.lit(g)) for g in drugs])
        return F.array_compact(F.array(*[F.when(told(g) & ~covered(d.lower()), F.lit(d)) for d, g in kn.DISEASE_DRUGS]))

    return let(F.lower(medications), implied)


def across_sections(rows: DataFrame) -> DataFrame:
    """One row per document and name over all sections, with the ordered section list.

    ``rows`` has ``doc_id, section_ord, ord, section, disease, norm, confidence``.
    """
    first = F.struct("section_ord", "ord", "disease", "section", "confidence")
    seen = F.struct("section_ord", "section")
    g = rows.groupBy("doc_id", "norm").agg(F.min(first).alias("f"), F.array_sort(F.collect_set(seen)).alias("s"))
    return g.select(
        "doc_id", "norm", "f.disease", "f.section", "f.confidence",
        F.array_distinct(F.transform("s", lambda x: x["section"])).alias("section_sources"),
    )


def merge_detectors(found: DataFrame, added: DataFrame) -> DataFrame:
    """Add mentions of a second detector: new names appended, sources of known names joined.

    Both have ``doc_id, norm, disease, section, section_sources, confidence``. A known name
    whose joined sources touch the assessment family takes the leading of those sections.
    """
    b = added.select("doc_id", "norm", *[F.col(c).alias(f"_{c}") for c in ("disease", "section", "section_sources", "confidence")])
    j = found.join(b, ["doc_id", "norm"], "full")
    sources = F.array_distinct(F.concat(
        F.coalesce("section_sources", F.array().cast("array<string>")), F.coalesce("_section_sources", F.array().cast("array<string>"))))
    low = F.transform(sources, F.lower)
    both = F.col("disease").isNotNull() & F.col("_disease").isNotNull()
    lead = F.lit(None).cast("string")
    for s in reversed(ks.ASSESSMENT_FAMILY):
        lead = F.when(F.array_contains(low, s), F.lit(s)).otherwise(lead)
    return j.select(
        "doc_id", "norm", F.coalesce("disease", "_disease").alias("disease"),
        F.when(both, F.coalesce(lead, "section")).otherwise(F.coalesce("section", "_section")).alias("section"),
        sources.alias("section_sources"), F.coalesce("confidence", "_confidence").alias("confidence"),
    )


def dedup_fold(items: Column) -> Column:
    """Merge mentions of one document in order: equal key, abbreviation or containment.

    ``items``: array of (disease, sources, confidence). The first occurrence founds a group;
    a longer name takes it over, sources are joined and the higher confidence stands.
    """
    full = tx.literal_map(ab.LOWER_TO_EXPANSION.items())
    keyed = F.transform(items, lambda x: let(tx.dedup_key(x["disease"]), lambda k: F.struct(
        x["disease"].alias("raw"), tx.stored_name(x["disease"]).alias("disease"), k.alias("key"),
        F.coalesce(F.try_element_at(full, k), k).alias("long"),
        x["sources"].alias("sources"), x["confidence"].alias("confidence"))))
    start = F.array().cast(
        "array<struct<raw string, disease string, key string, long string, sources array<string>, confidence double>>")

    def step(acc: Column, x: Column) -> Column:
        where = lambda test: F.array_position(F.transform(acc, test), True)
        same = where(lambda g: g["key"] == x["key"])
        longer = where(lambda g: g["key"] == x["long"])
        inside = where(lambda g: F.contains(g["key"], x["key"]) | F.contains(x["key"], g["key"]))
        at = F.when(same > 0, same).when(longer > 0, longer).otherwise(inside)

        def merge(g: Column) -> Column:
            take = F.length(x["raw"]) > F.length(g["raw"])
            pick = lambda f: F.when(take, x[f]).otherwise(g[f])
            # by containment the longer key stands for the group
            key = F.when(F.length(x["key"]) > F.length(g["key"]), x["key"]).otherwise(g["key"])
            return F.struct(
                pick("raw").alias("raw"), pick("disease").alias("disease"), key.alias("key"), pick("long").alias("long"),
                F.array_distinct(F.concat(g["sources"], x["sources"])).alias("sources"),
                F.greatest(g["confidence"], x["confidence"]).alias("confidence"))

        return let(at, lambda p: F.when(p == 0, F.concat(acc, F.array(x))).otherwise(
            F.transform(acc, lambda g, i: F.when(i + 1 == p, merge(g)).otherwise(g))))

    return F.transform(F.aggregate(keyed, start, step), lambda g: F.struct(
        g["disease"].alias("disease"), g["key"].alias("norm"), g["sources"].alias("sources"), g["confidence"].alias("confidence")))


def cross_section_dedup(rows: DataFrame) -> DataFrame:
    """Merged mentions per document; repeats of a name are combined before the shuffle.

    ``rows`` has ``doc_id, ord, disease, sources, confidence, negated``.
    """
    live = rows.where(~F.col("negated"))
    names = live.groupBy("doc_id", "disease").agg(
        F.min("ord").alias("ord"), F.max("confidence").alias("confidence"),
        F.array_sort(F.collect_set(F.struct("sources"))).alias("s"),
    ).select("doc_id", "ord", "disease", "confidence", F.array_distinct(F.flatten(F.transform("s", lambda x: x["sources"]))).alias("sources"))
    docs = names.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("ord", "disease", "sources", "confidence"))).alias("items"))
    merged = dedup_fold(F.col("items"))
    return explode_rows(docs, F.transform(merged, lambda m, i: m.withField("ord", i)), "doc_id")
