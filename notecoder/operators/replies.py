"""Model replies as a table: repair, typed rows, verdicts and additions."""
from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from ..functions import text as tx
from ..functions.arrays import explode_rows
from ..knowledge import coding as kc
from . import mapping as mp
from .results import bmi_band

MEAT = "M_monitor string, E_evaluate string, A_assess string, T_treat string"
REPLY = (
    "diseases array<struct<disease_name string, active_status string, source_section string, icd10_code string, "
    f"icd10_description string, meat_validation struct<{MEAT}>>>, "
    "excluded_conditions array<struct<term string, reason_excluded string, source_section string>>"
)
VERDICTS = (
    "verified_codes array<struct<icd_code string, disease_name string, verdict string, corrected_icd_code string, "
    f"corrected_disease_name string, reason string, meat_evidence struct<{MEAT}>>>, "
    f"additional_codes array<struct<icd_code string, disease_name string, source_section string, meat_evidence struct<{MEAT}>>>"
)


def tidy(raw: Column) -> Column:
    """Code fences, trailing commas and missing commas between items mended."""
    t = F.regexp_replace(F.trim(raw), r"(?s)\A```(?:json)?\s*|\s*```\z", "")
    t = F.regexp_replace(t, r",\s*([}\]])", "$1")
    return F.regexp_replace(t, r"([}\]\"0-9])\s*\n\s*(\"[A-Za-z_])", "$1, $2")


def _close(text: str) -> str | None:
    """The first object of a text, with open strings, arrays and objects closed."""
    start = text.find("{")
    if start < 0:
        return None
    stack, quoted, escaped = [], False, False
    for i in range(start, len(text)):
        ch = text[i]
        if quoted:
            quoted, escaped = (True, False) if escaped else (ch != '"', ch == "\\")
        elif ch == '"':
            quoted = True
        elif ch in "{[":
            stack.append("}" if ch == "{" else "]")
        elif ch in "}]" and stack:
            stack.pop()
            if not stack:
                return text[start:i + 1]
    return text[start:].rstrip().rstrip(",") + ('"' if quoted else "") + "".join(reversed(stack))


@F.pandas_udf(StringType())
def balanced(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: _close(t) if t is not None else None)


def repair(replies: DataFrame, schema: str, raw: str = "raw") -> DataFrame:
    """Add ``parsed`` (null where hopeless) and ``repair``: none, tidied, balanced or failed.

    Every step looks only at what the step before rejected, and the replies are read once; the Arrow function
    gets nulls for all others.
    """
    good = lambda c: F.coalesce(F.try_parse_json(c).isNotNull() & F.trim(c).startswith("{"), F.lit(False))
    r = replies.withColumn("_good", good(F.col(raw)))
    r = r.withColumn("_t", F.when(~F.col("_good"), tidy(F.col(raw))))
    r = r.withColumn("_state", F.when(F.col("_good"), "none").when(good(F.col("_t")), "tidied").otherwise("balanced"))
    r = r.withColumn("_closed", balanced(F.when(F.col("_state") == "balanced", F.col("_t"))))
    r = r.withColumn("_json", F.when(F.col("_state") == "none", F.col(raw)).when(F.col("_state") == "tidied", F.col("_t")).otherwise(tidy(F.col("_closed"))))
    r = r.withColumn("repair", F.when((F.col("_state") == "balanced") & ~good(F.col("_json")), "failed").otherwise(F.col("_state")))
    return r.withColumn("parsed", F.when(F.col("repair") != "failed", F.from_json("_json", schema))).drop("_good", "_t", "_state", "_closed", "_json")


def reply_diseases(parsed: DataFrame) -> DataFrame:
    """One row per active disease of a reply."""
    rows = explode_rows(parsed, F.transform("parsed.diseases", lambda d, i: d.withField("ord", i)), "doc_id")
    m = lambda f: F.coalesce(F.col(f"meat_validation.{f}"), F.lit(""))
    active = F.lower(F.coalesce("active_status", F.lit("active"))).startswith("active")
    return rows.where(active & ~tx.non_disease_phrase(F.col("disease_name"), F.coalesce("icd10_code", F.lit("")) != "")).select(
        "doc_id", "ord", F.col("disease_name").alias("disease"), F.col("icd10_code").alias("icd_code"),
        F.array(tx.canonical_section(F.col("source_section"))).alias("sources"), m("M_monitor").alias("monitoring_evidence"),
        m("E_evaluate").alias("evaluation_evidence"), m("A_assess").alias("assessment_evidence"), m("T_treat").alias("treatment_evidence"),
    )


def apply_verdicts(rows: DataFrame, verdicts: DataFrame) -> DataFrame:
    """KEEP, FIX or REMOVE rows by code; unmentioned rows stay.

    ``verdicts`` has ``doc_id, icd_code, ord, verdict, corrected_icd_code,
    corrected_disease_name`` and four ``new_*`` texts; the last verdict of a code counts. A fix
    fills empty evidence only.
    """
    fields = [c for c in verdicts.columns if c not in ("doc_id", "icd_code")]
    last = verdicts.where("coalesce(icd_code, '') <> ''").groupBy("doc_id", F.upper("icd_code").alias("_code")).agg(
        F.max_by(F.struct(*[c for c in fields if c != "ord"]), "ord").alias("_v"))
    j = rows.withColumn("_code", F.upper("icd_code")).join(last, ["doc_id", "_code"], "left")
    fix = F.coalesce(F.upper("_v.verdict") == "FIX", F.lit(False))
    swap = lambda new, old: F.when(fix & (F.coalesce(new, F.lit("")) != ""), new).otherwise(F.col(old))
    out = {"icd_code": swap(F.col("_v.corrected_icd_code"), "icd_code"), "disease": swap(F.col("_v.corrected_disease_name"), "disease")}
    for e in ("monitoring", "evaluation", "assessment", "treatment"):
        new, old = F.trim(F.coalesce(F.col(f"_v.new_{e}"), F.lit(""))), f"{e}_evidence"
        out[old] = F.when(fix & (new != "") & (F.trim(F.coalesce(old, F.lit(""))) == ""), new).otherwise(F.col(old))
    return j.where(F.coalesce(F.upper("_v.verdict"), F.lit("KEEP")) != "REMOVE").withColumns(out).drop("_v", "_code")


def merge_additions(rows: DataFrame, added: DataFrame) -> DataFrame:
    """Added rows whose code is new; "A, B" codes split; the first row of a code stays.

    Rows of the first table precede added ones; rows without a code all stay.
    """
    both = rows.withColumn("_side", F.lit(0)).unionByName(added.withColumn("_side", F.lit(1)), allowMissingColumns=True)
    parts = F.filter(F.transform(F.split(F.coalesce("icd_code", F.lit("")), ","), lambda c: F.trim(c)), lambda c: c != "")
    split = both.withColumn("_codes", F.when(F.size(parts) == 0, F.array(F.lit(""))).otherwise(parts))
    split = split.select("*", F.posexplode("_codes").alias("_i", "_one")).withColumn("icd_code", F.col("_one"))
    fields = [c for c in rows.columns if c not in ("doc_id", "icd_code")]
    first = split.where("icd_code <> ''").groupBy("doc_id", F.upper("icd_code").alias("_key")).agg(
        F.min_by(F.struct("icd_code", *fields), F.struct("_side", "ord", "_i")).alias("f"))
    return first.select("doc_id", "f.*").select(*rows.columns).unionByName(split.where("icd_code = ''").select(*rows.columns))


def bmi_pairing(rows: DataFrame, notes: DataFrame) -> DataFrame:
    """Z68 codes only beside an E66 code; a missing one is added from the stated BMI."""
    code = F.upper(F.coalesce("icd_code", F.lit("")))
    flags = rows.groupBy("doc_id").agg(F.max(code.startswith("E66")).alias("_e"), F.max(code.startswith("Z68")).alias("_z"))
    kept = rows.join(flags, "doc_id").where(F.col("_e") | ~code.startswith("Z68")).drop("_e", "_z")
    need = flags.where("_e and not _z").select("doc_id").join(
        notes.select("doc_id", F.regexp_extract("text", kc.BMI_VALUE, 1).alias("v")), "doc_id")
    band = bmi_band(F.nullif(F.col("v"), F.lit("")).cast("double"))
    added = need.select("doc_id", F.concat(F.lit("BMI "), "v").alias("disease"), band.alias("icd_code")).where("icd_code is not null")
    return kept.unionByName(added, allowMissingColumns=True)


# --- replies to results ---------------------------------------------------------------
# Confidence of a code that the dictionary has or lacks, weights of evidence and code, cap without evidence.
KNOWN, UNKNOWN = 0.95, 0.70
EVIDENCE_WEIGHT, CODE_WEIGHT, BARE_CAP = 0.6, 0.4, 0.42
SECOND_LOOK = ["assessment", "assessment_and_plan"]
TEXTS = [f"{e}_evidence" for e in ("monitoring", "evaluation", "assessment", "treatment")]


def reply_to_results(rows: DataFrame, codes: DataFrame, lookup=None) -> DataFrame:
    """Result rows of a reply's diseases (``reply_diseases``), codes checked against the dictionary.

    Rows without a code are looked up by name once more if their first source is the assessment,
    each distinct name once; what has no code then goes. A code the dictionary has (dots ignored)
    takes its spelling and description, another one counts less. Adds ``number`` (1, 2, ... in
    the order of ``ord``), ``meat_tier``, ``meat_score``, ``icd_description``, ``icd_confidence`` and ``confidence``.
    ``lookup(names)`` gives ``name, icd_code``; by default the combined search. Blank names go.
    """
    lookup = lookup or (lambda names: mp.search_combined(names, codes))
    code = F.trim(F.coalesce("icd_code", F.lit("")))
    named = rows.where(F.trim(F.coalesce("disease", F.lit(""))) != "").withColumn("icd_code", code)
    source = F.replace(F.lower(F.coalesce(F.get("sources", F.lit(0)), F.lit(""))), F.lit(" "), F.lit("_"))
    again = named.where((F.col("icd_code") == "") & source.isin(SECOND_LOOK)).drop("icd_code")
    found = lookup(again.select(F.col("disease").alias("name")).distinct()).where("coalesce(icd_code, '') <> ''").select(F.col("name").alias("disease"), "icd_code")
    coded = named.where("icd_code <> ''").unionByName(again.join(found, "disease"))
    known = codes.groupBy(tx.bare_code(F.col("code")).alias("_bare")).agg(F.min_by(F.struct("code", "description"), "seq").alias("_hit"))
    j = coded.withColumn("_bare", tx.bare_code(F.col("icd_code"))).join(known, "_bare", "left")
    hit = F.col("_hit").isNotNull()
    n = sum((F.when(F.coalesce(c, F.lit("")) != "", 1).otherwise(0) for c in TEXTS), F.lit(0))
    sure = F.when(hit, KNOWN).otherwise(UNKNOWN)
    round2 = lambda x: F.rint(x * 100) / 100
    return j.withColumns({
        "meat_score": n, "icd_confidence": sure, "icd_code": F.coalesce("_hit.code", "icd_code"), "icd_description": F.coalesce("_hit.description", F.lit("")),
        "meat_tier": F.when(n >= 3, "strong_evidence").when(n == 2, "moderate_evidence").when(n == 1, "weak_evidence").otherwise("no_meat"),
        "confidence": round2(F.when(n == 0, F.least(F.lit(BARE_CAP), sure * CODE_WEIGHT)).otherwise(n / 4 * EVIDENCE_WEIGHT + sure * CODE_WEIGHT)),
        "number": F.row_number().over(Window.partitionBy("doc_id").orderBy("ord")),
    }).drop("_bare", "_hit")
