"""The multi-step coding route as one Spark plan: notes to audited, coded results."""
from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as tx
from ..functions.arrays import explode_rows, let
from ..operators import context as cx
from ..operators import evidence as me
from ..operators import mapping as mp
from ..operators import mentions as mn
from ..operators import results as rs
from ..operators import rules as ru
from ..operators import sections as se
from ..operators.gather import evidence_of
from ..operators.rules import ELEMENTS
from ..session import reliable_checkpoint
from ..settings import DEFAULTS, Settings

ITEM = "array<struct<disease string, sources array<string>, confidence double>>"


def _items(sections: Column) -> Column:
    """Mentions of all sections, then diseases implied by the medication section."""
    def of_section(s: Column) -> Column:
        item = lambda disease, confidence: F.struct(
            disease.alias("disease"), F.array(s["section"]).alias("sources"), confidence.alias("confidence"))
        listed = F.when(s["section"] == "past_medical_history", F.transform(
            mn.problem_array(s["text"]), lambda p: item(p["disease"], F.lit(0.85)))).otherwise(F.array().cast(ITEM))
        found = F.transform(mn.mention_array(s["text"], s["section"]), lambda m: item(m["disease"], m["confidence"]))
        return F.concat(listed, found)

    def with_implied(found: Column) -> Column:
        drugs = F.array_join(F.transform(F.filter(sections, lambda s: s["section"] == "medications"), lambda s: s["text"]), "\n")
        implied = mn.implied_array(drugs, F.transform(found, lambda m: F.lower(m["disease"])))
        return F.concat(found, F.transform(implied, lambda d: F.struct(
            d.alias("disease"), F.array(F.lit("medications")).alias("sources"), F.lit(0.80).alias("confidence"))))

    return let(F.flatten(F.transform(sections, of_section)).cast(ITEM), with_implied)


def structured(notes: DataFrame, method: str = "levenshtein") -> DataFrame:
    """``doc_id, sections, mentions, sents`` per note; nothing is shuffled."""
    clean = notes.select("doc_id", tx.normalize_whitespace(tx.remove_noise(F.col("text"))).alias("text"))
    docs = se.with_sections(clean, method)
    whole = F.array(F.struct(F.lit("unknown").alias("section"), F.col("text").alias("text"), F.lit(0).alias("start")))
    docs = docs.withColumn("sections", F.when(F.size("sections") > 0, F.col("sections")).otherwise(whole))
    docs = docs.withColumn("mentions", mn.dedup_fold(_items(F.col("sections"))))
    expanded = tx.expand_abbreviations(tx.normalize_whitespace(tx.fix_line_breaks(F.col("text"))))
    return docs.select("doc_id", "sections", "mentions", F.transform(cx.sentence_array(expanded), lambda s: s["text"]).alias("sents"))


def evidence(docs: DataFrame, settings: Settings = DEFAULTS) -> DataFrame:
    """One gated row per mention with its evidence; only these short texts leave the note."""
    found = evidence_of(F.col("sections"), F.col("sents"), F.col("mentions"), settings.context_sentences)
    # bound outside the inner function, where no Python function can be called
    rows = explode_rows(docs, let(F.struct("mentions", found.alias("found")), lambda d: F.transform(d["mentions"], lambda m, i: F.struct(
        i.alias("ord"), m["disease"].alias("disease"), m["sources"].alias("sources"), m["confidence"].alias("mention_confidence"), F.get(d["found"], i).alias("e")))), "doc_id")
    text = {e: F.coalesce(F.col(f"e.{e}_evidence"), F.lit("")) for e in ELEMENTS}
    rows = rows.withColumns({
        **{f"{e}_evidence": t for e, t in text.items()}, **{f"{e}_confidence": F.col(f"e.{e}_confidence") for e in ELEMENTS},
        **{e: t != "" for e, t in text.items()},
        "overall_confidence": me.overall_confidence([F.col(f"e.{e}_confidence") for e in ELEMENTS]),
        "disease_status": F.col("e.disease_status"),
        # the texts were cut from the context, so they ground themselves
        "context": F.concat_ws(" ", *text.values()),
    }).drop("e")
    return me.evidence_tier(me.gate(rows, settings=settings)).drop("context")


@dataclass(frozen=True)
class Coded:
    """Results of a run, one audit row per rule action, and rows left out with their reason."""

    results: DataFrame
    audit: DataFrame
    rejections: DataFrame


def code_notes_audited(notes: DataFrame, codes: DataFrame, method: str = "levenshtein", settings: Settings = DEFAULTS) -> Coded:
    """The whole route with its audit trail.

    Sections, mentions and evidence are maps over notes. Names are looked up once each and
    joined back. Results are filtered, merged by code, abbreviation, containment and root;
    then the live rules run: abbreviations, specificity, combination codes, etiology pairs,
    laterality, ranking. ``codes`` has ``code, description, hcc_status, seq``.
    """
    # the evidence rows are short; written once, they serve the name list and the join
    rows = reliable_checkpoint(evidence(structured(notes, method), settings))
    names = rows.select(F.col("disease").alias("name")).distinct()
    found = mp.assign_codes(mp.search_combined(names, codes), codes, settings)
    mapped = found.select(F.col("name").alias("disease"), "icd_code", F.col("description").alias("icd_description"), F.col("confidence").alias("icd_confidence"),
                          F.col("mapping_method").alias("icd_method"), "status", "candidates")
    hcc = codes.groupBy(tx.format_code(F.col("code")).alias("icd_code")).agg(F.min_by("hcc_status", "seq").alias("hcc_status"))
    joined = rows.join(mapped, "disease", "left").join(hcc, "icd_code", "left")
    joined = reliable_checkpoint(joined.withColumns({"confidence": rs.confidence_score(settings), "negated": F.lit(False)}))
    kept = rs.dedup_by_code(rs.output_filter(joined)).select(*joined.columns)
    kept, _ = ru.merge_rows(kept, rs.dedup_abbreviations(kept))
    kept = reliable_checkpoint(rs.dedup_stem(rs.dedup_substring(kept)))
    merged, merges = ru.merge_rows(kept, ru.merge_abbreviations(kept))
    specific, dropped = ru.apply_rules(merged)
    specific = reliable_checkpoint(specific.select(*merged.columns))
    said = lambda df, rule, action, name, reason: df.select("doc_id", F.lit(rule).alias("rule"), F.lit(action).alias("action"), name.alias("disease"), reason.alias("reason"))
    combined = said(ru.combination_suggestions(specific), "combination_codes", "suggested", F.col("description"), F.col("icd_code"))
    paired = said(ru.etiology_pairs(specific), "etiology_pair", "paired", F.col("manifestation"), F.col("etiology"))
    ranked = ru.rank(ru.flag_chronic(ru.laterality(specific)))
    results = ranked.withColumns({"segment": tx.section_label(F.col("sources")), "number": F.col("coding_rank")})
    audit = merges.unionByName(dropped).unionByName(combined).unionByName(paired)
    return Coded(results, audit, rs.rejections(joined))


def code_notes(notes: DataFrame, codes: DataFrame, method: str = "levenshtein", settings: Settings = DEFAULTS) -> DataFrame:
    """Coded results of a corpus of notes; see ``code_notes_audited``."""
    return code_notes_audited(notes, codes, method, settings).results
