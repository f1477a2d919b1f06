"""Coding rules: each takes result rows and returns kept rows and audit rows.

A result row has ``doc_id, ord, disease, icd_code, sources`` (array), four ``*_evidence``
texts, ``meat_tier`` and ``confidence``. A rule marks rows; ``split`` turns marks into the
kept rows and the audit trail, so input rows always equal kept plus removed.
"""
from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as tx
from ..functions.skew import running, with_group, with_texts
from ..knowledge import abbreviations as ab
from ..knowledge import coding as kc

ELEMENTS = ("monitoring", "evaluation", "assessment", "treatment")


def evidence(e: str) -> Column:
    return F.coalesce(F.col(f"{e}_evidence"), F.lit(""))


def all_evidence() -> Column:
    return F.concat_ws(" ", *[evidence(e) for e in ELEMENTS])


def has_evidence() -> Column:
    return reduce(lambda a, b: a | b, [F.trim(evidence(e)) != "" for e in ELEMENTS])


def coded(code: Column = F.col) -> Column:
    return ~F.coalesce(F.col("icd_code"), F.lit("")).isin("", "—", "-")


def split(marked: DataFrame, rule: str, action: str, reason: Column) -> tuple[DataFrame, DataFrame]:
    """Rows not marked for removal, and one audit row per removed row."""
    audit = marked.where("removed").select(
        "doc_id", F.lit(rule).alias("rule"), F.lit(action).alias("action"), "disease", reason.alias("reason")
    )
    return marked.where("not removed").drop("removed"), audit


def mark_suspected(rows: DataFrame) -> DataFrame:
    return rows.withColumn("removed", F.concat_ws(" ", "disease", all_evidence()).rlike(kc.SUSPECTED))


def mark_drug_names(rows: DataFrame) -> DataFrame:
    low = F.trim(F.lower("disease"))
    drug = low.rlike("\\A(?:" + "|".join(kc.DRUG_MARKERS) + ").{0,4}\\z")
    return rows.withColumn("removed", drug)


def mark_lab_names(rows: DataFrame) -> DataFrame:
    whole = "(?i)\\A(?:" + kc.LAB_NAME.removeprefix("(?i)") + ")\\z"
    return rows.withColumn("removed", F.trim("disease").rlike(whole))


def mark_negated(rows: DataFrame) -> DataFrame:
    """A negation phrase in the assessment text with a word of the name within 60 characters."""
    low = F.lower("disease")
    text = F.concat(F.lower(evidence("assessment")), F.lit(" "), low)
    after = F.substring(F.regexp_replace(text, r"(?s)\A.*?" + kc.NEGATED.removeprefix("(?i)"), ""), 1, 60)
    long_words = F.filter(F.split(low, r"\s+"), lambda w: F.length(w) >= 4)
    hit = text.rlike(kc.NEGATED) & F.exists(long_words, lambda w: F.contains(after, w))
    return rows.withColumn("removed", hit)


def mark_documented(rows: DataFrame, notes: DataFrame) -> DataFrame:
    """Mark rows whose disease is not found in the document text.

    Assessment rows with evidence are trusted. A row with ``icd_description`` of six or more
    characters is also found by half of its words of four or more letters.
    """
    low = F.trim(F.lower("disease"))
    named = F.transform("sources", lambda s: F.replace(F.lower(s), F.lit(" "), F.lit("_")))
    trusted = F.arrays_overlap(named, tx.literal_array(["assessment", "assessment_and_plan", "assessment_plan"])) & has_evidence()
    share = lambda words: F.when(F.size(words) > 0, F.size(F.filter(words, lambda w: F.contains("_text", w))) / F.size(words)).otherwise(F.lit(0.0))
    long_words = F.filter(F.split(low, r"\s+"), lambda w: F.length(w) >= 4)
    expansion, abbr = tx._lookup(ab.LOWER_TO_EXPANSION, low), tx._lookup(ab.EXPANSION_TO_LOWER, low)
    found = (
        F.contains("_text", low)
        | F.coalesce(F.contains(F.col("_text"), expansion), F.lit(False))
        | F.coalesce(F.contains(F.col("_text"), abbr), F.lit(False))
        | ((F.size(F.split(low, r"\s+")) > 1) & (share(long_words) >= 0.6))
    )
    if "icd_description" in rows.columns:
        described = F.lower(F.coalesce("icd_description", F.lit("")))
        own = F.filter(F.split(described, r"\s+"), lambda w: F.length(w) >= 4)
        found = found | ((F.length(described) >= 6) & (F.size(own) > 0) & (share(own) >= 0.5))
    texts = notes.select("doc_id", F.lower("text").alias("_text"))
    return with_texts(rows, texts).withColumn(
        "removed", ~(trusted | F.coalesce(found, F.lit(False)))
    ).drop("_text")


def mark_explained_symptoms(rows: DataFrame) -> DataFrame:
    """Symptoms of a diagnosis that the same document carries."""
    explained = F.array_compact(F.array(*[
        F.when(F.col("disease").rlike(rf"(?i)\b(?:{p})\b"), F.lit("|".join(s))) for p, s in kc.SUBSUMED
    ]))
    pairs = rows.select("doc_id", F.explode(explained).alias("s")).distinct()
    symptoms = pairs.select("doc_id", F.explode(F.split("s", r"\|")).alias("_symptom")).distinct()
    keyed = rows.withColumn("_symptom", F.trim(F.lower("disease")))
    hit = symptoms.withColumn("removed", F.lit(True))
    return keyed.join(hit, ["doc_id", "_symptom"], "left").drop("_symptom").withColumn("removed", F.coalesce("removed", F.lit(False)))


def flag_symptom_codes(rows: DataFrame) -> DataFrame:
    """``symptom_retained``: an R code in a document without any other code."""
    symptom = F.upper(F.coalesce("icd_code", F.lit(""))).rlike(r"\AR[0-9]{2}")
    g = with_group(rows, ["doc_id"], _diagnosis=F.max(coded() & ~symptom))
    return g.withColumn("symptom_retained", symptom & ~F.col("_diagnosis")).drop("_diagnosis")


def flag_chronic(rows: DataFrame) -> DataFrame:
    category = F.substring(tx.bare_code(F.coalesce("icd_code", F.lit(""))), 1, 3)
    return rows.withColumn("chronic", category.isin(kc.CHRONIC_CATEGORIES))


def mark_less_specific(rows: DataFrame, compare: str = "literal") -> DataFrame:
    """Codes that are a prefix of the longest code of their category in the document.

    ``literal`` compares with dots kept in the longer code, so only whole categories fall;
    ``nodot`` compares bare codes.
    """
    code = F.trim(F.upper(F.coalesce("icd_code", F.lit(""))))
    has = coded() & (F.length(code) >= 3)
    keyed = rows.withColumn("_category", F.when(has, F.substring(code, 1, 3)))
    # the longest code; among equals the first row stands
    longest = keyed.where("_category is not null").groupBy("doc_id", "_category").agg(
        F.max(F.struct(F.length("icd_code").alias("n"), (-F.col("ord")).alias("o"), F.col("icd_code").alias("icd_kept"))).alias("_top")
    ).select("doc_id", "_category", F.col("_top.icd_kept").alias("icd_kept"), (-F.col("_top.o")).alias("_kept_ord"))
    bare = F.replace(F.col("icd_code"), F.lit("."), F.lit(""))
    whole = F.col("icd_kept") if compare == "literal" else F.replace(F.col("icd_kept"), F.lit("."), F.lit(""))
    out = keyed.join(longest, ["doc_id", "_category"], "left")
    drop = F.col("icd_kept").isNotNull() & (F.col("ord") != F.col("_kept_ord")) & whole.startswith(bare)
    return out.withColumn("removed", F.coalesce(drop, F.lit(False))).drop("_category", "_kept_ord")


def combination_suggestions(rows: DataFrame) -> DataFrame:
    """Combination codes suggested for co-occurring conditions, on the document's first row."""
    has = lambda p: F.max(F.lower("disease").rlike(p))
    flags = [has(a) & has(b) for a, b, _, _ in kc.COMBINATIONS]
    g = rows.groupBy("doc_id").agg(F.min("ord").alias("ord"), *[f.alias(f"_f{i}") for i, f in enumerate(flags)])
    entries = F.array_compact(F.array(*[
        F.when(F.col(f"_f{i}"), F.struct(F.lit(i).alias("priority"), F.lit(c).alias("icd_code"), F.lit(d).alias("description")))
        for i, (_, _, c, d) in enumerate(kc.COMBINATIONS)
    ]))
    return g.select("doc_id", "ord", F.explode(entries).alias("x")).select("doc_id", "ord", "x.*")


def etiology_pairs(rows: DataFrame) -> DataFrame:
    """Manifestation codes (G, H, N) with the document's first diabetes code (E10 to E13)."""
    code = F.coalesce(F.col("icd_code"), F.lit(""))
    etiology = rows.where(code.rlike(r"\AE1[0-3]")).groupBy("doc_id").agg(F.min_by("icd_code", "ord").alias("etiology"))
    return rows.where(code.rlike(r"\A[GHN][0-9]{2}")).join(etiology, "doc_id").select(
        "doc_id", "ord", F.col("icd_code").alias("manifestation"), "etiology"
    )


def laterality(rows: DataFrame) -> DataFrame:
    """The first side word of name and evidence, abbreviations written out."""
    side = F.lower(F.regexp_extract(F.concat_ws(" ", "disease", all_evidence()), kc.SIDE, 1))
    full = F.coalesce(F.try_element_at(tx.literal_map(kc.SIDE_NAMES.items()), side), side)
    return rows.withColumn("laterality", F.nullif(full, F.lit("")))


def mark_excluded(rows: DataFrame) -> DataFrame:
    """Of two categories that exclude each other the one with lower confidence is marked.

    The last row of a category speaks for it.
    """
    bare = tx.bare_code(F.coalesce("icd_code", F.lit("")))
    keyed = rows.withColumn("_category", F.when(F.length(bare) >= 3, F.substring(bare, 1, 3)))
    named = sorted({c for pair in kc.EXCLUDES for c in pair})
    last = lambda c: F.max(F.when(F.col("_category") == c, F.struct("ord", "confidence"))).alias(f"_{c}")
    per = keyed.where(F.col("_category").isin(named)).groupBy("doc_id").agg(*[last(c) for c in named])
    losers = F.array_compact(F.array(*[
        F.when(F.col(f"_{a}").isNotNull() & F.col(f"_{b}").isNotNull(),
               F.when(F.col(f"_{a}.confidence") >= F.col(f"_{b}.confidence"), F.col(f"_{b}.ord")).otherwise(F.col(f"_{a}.ord")))
        for a, b in kc.EXCLUDES
    ]))
    lost = per.select("doc_id", F.explode(losers).alias("ord")).distinct().withColumn("removed", F.lit(True))
    return keyed.drop("_category").join(lost, ["doc_id", "ord"], "left").withColumn("removed", F.coalesce("removed", F.lit(False)))


def ranking_score(confidence: Column) -> Column:
    """Section rank less bonuses for evidence, chronic conditions and confidence."""
    rank = F.coalesce(F.array_min(F.transform("sources", lambda s: F.coalesce(
        F.try_element_at(tx.literal_map((k, str(v)) for k, v in kc.SECTION_RANK.items()), F.lower(s)).cast("int"), F.lit(8)
    ))), F.lit(8))
    bonus = F.when(F.col("meat_tier") == "strong_evidence", 2).when(F.col("meat_tier") == "moderate_evidence", 1).otherwise(0)
    chronic = F.coalesce(F.col("chronic").cast("int"), F.lit(0))
    return F.bround(rank - bonus - chronic - confidence * 2, 2)


def rank(rows: DataFrame) -> DataFrame:
    """``ranking_score, coding_rank, coding_priority``; lower scores come first."""
    scored = rows.withColumn("ranking_score", ranking_score(F.col("confidence")))
    ranked = running(scored, ["doc_id"], [F.col("ranking_score"), F.col("ord")], {}, row_number="coding_rank")
    return ranked.withColumn("coding_priority", F.when(F.col("coding_rank") == 1, "primary").otherwise("secondary"))


# Rule name, mark, reason of the removing rules; the profile that runs by default.
REMOVERS: dict[str, tuple[Callable[[DataFrame], DataFrame], str]] = {
    "suspected_filtering": (mark_suspected, "suspected or rule-out language"),
    "medication_not_diagnosis": (mark_drug_names, "name matches a medication"),
    "lab_not_diagnosis": (mark_lab_names, "name is a standalone lab result"),
    "negation_detection": (mark_negated, "negation phrase precedes the name"),
    "diagnosis_over_symptoms": (mark_explained_symptoms, "symptom explained by a confirmed diagnosis"),
    "excludes1": (mark_excluded, "category excluded by another"),
    "specificity": (mark_less_specific, "less specific code of its category"),
}
LIVE = ("specificity",)


def apply_rules(rows: DataFrame, rules: tuple[str, ...] = LIVE) -> tuple[DataFrame, DataFrame]:
    """Run the named removing rules in order; returns kept rows and the audit rows."""
    audits = []
    for name in rules:
        mark, reason = REMOVERS[name]
        rows, audit = split(mark(rows), name, "removed", F.lit(reason))
        audits.append(audit)
    return rows, reduce(DataFrame.unionByName, audits)


def rule_stats(before: DataFrame, kept: DataFrame, audit: DataFrame) -> DataFrame:
    """Rows in and out, removed rows, rules applied and actions per document."""
    side = lambda df, n: df.select("doc_id", F.lit(n).alias("side"), F.lit(None).cast("string").alias("rule"))
    u = side(before, "in").union(side(kept, "out")).union(audit.select("doc_id", F.lit("audit").alias("side"), "rule"))
    n = lambda s: F.count_if(F.col("side") == s)
    return u.groupBy("doc_id").agg(
        n("in").alias("total_input"), n("out").alias("total_output"), (n("in") - n("out")).alias("removed"),
        F.size(F.collect_set("rule")).cast("bigint").alias("rules_applied"), n("audit").alias("actions"),
    )


def first_seen_names(rows: DataFrame) -> DataFrame:
    """One row per distinct name and code of a document with its first position and counts.

    Pre-aggregation bounds what a fold over a document's names has to hold: repeats of a
    name, however many, are combined before the shuffle.
    """
    return rows.groupBy("doc_id", "disease", "icd_code").agg(
        F.min("ord").alias("ord"), F.count("*").alias("n"), F.max("confidence").alias("confidence"),
        F.min_by("meat_tier", "ord").alias("meat_tier"),
    )


def fold_names(rows: DataFrame, variants: Callable[[Column], Column], respect_codes: bool) -> DataFrame:
    """Merge names of a document whose variant sets meet; the longer name stands.

    The merge walks names in first-seen order and each group takes on the variants of its
    members, so it is a fold over the document's distinct names.
    """
    item = F.struct("ord", "disease", "icd_code", "n", "confidence", "meat_tier", F.col("ord").alias("chosen"), variants(F.col("disease")).alias("keys"))
    docs = first_seen_names(rows).groupBy("doc_id").agg(F.array_sort(F.collect_list(item)).alias("items"))
    fields = "ord bigint, disease string, icd_code string, n bigint, confidence double, meat_tier string, chosen bigint, keys array<string>"
    start = F.array().cast(f"array<struct<{fields}>>")
    blank = lambda c: F.coalesce(c, F.lit("")) == ""

    def meets(g: Column, x: Column) -> Column:
        clash = ~blank(g["icd_code"]) & ~blank(x["icd_code"]) & (g["icd_code"] != x["icd_code"])
        same = F.arrays_overlap(g["keys"], x["keys"])
        return same & ~clash if respect_codes else same

    def merge(g: Column, x: Column) -> Column:
        rank_of = lambda t: F.coalesce(F.try_element_at(tx.literal_map((k, str(v)) for k, v in kc.TIER_RANK.items()), t).cast("int"), F.lit(9))
        longer = F.length(x["disease"]) > F.length(g["disease"])
        better = (F.length(x["disease"]) == F.length(g["disease"])) & (rank_of(x["meat_tier"]) < rank_of(g["meat_tier"]))
        take = longer | better if respect_codes else longer
        pick = lambda f: F.when(take, x[f]).otherwise(g[f])
        code = F.when(blank(pick("icd_code")), F.when(blank(x["icd_code"]), g["icd_code"]).otherwise(x["icd_code"])).otherwise(pick("icd_code")) if respect_codes else pick("icd_code")
        return F.struct(
            g["ord"].alias("ord"), pick("disease").alias("disease"), code.alias("icd_code"), (g["n"] + x["n"]).alias("n"),
            pick("confidence").alias("confidence"), pick("meat_tier").alias("meat_tier"), pick("chosen").alias("chosen"),
            F.array_union(g["keys"], x["keys"]).alias("keys"),
        )

    def step(acc: Column, x: Column) -> Column:
        # the first group that meets the name takes it
        at = F.array_position(F.transform(acc, lambda g: meets(g, x)), True)
        return F.when(at == 0, F.concat(acc, F.array(x))).otherwise(
            F.transform(acc, lambda g, i: F.when(i + 1 == at, merge(g, x)).otherwise(g))
        )

    return docs.select("doc_id", F.explode_outer(F.aggregate("items", start, step)).alias("g")).where("g is not null").select(
        "doc_id", "g.ord", "g.disease", "g.icd_code", F.col("g.n").alias("merged"), "g.confidence", "g.meat_tier", "g.chosen"
    )


def merge_rows(rows: DataFrame, folded: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Whole rows that stand for their merged groups, and one audit row per row merged away.

    ``folded`` comes from ``fold_names``; the row of the chosen name keeps all its columns
    and takes the group's code.
    """
    chosen = folded.select("doc_id", F.col("chosen").alias("ord"), F.col("icd_code").alias("_code"))
    kept = rows.join(chosen, ["doc_id", "ord"]).withColumn("icd_code", F.col("_code")).drop("_code")
    gone = rows.join(chosen.select("doc_id", "ord"), ["doc_id", "ord"], "left_anti")
    audit = gone.select("doc_id", F.lit("abbreviation_dedup").alias("rule"), F.lit("merged").alias("action"), "disease", F.lit("abbreviation duplicate, longer name kept").alias("reason"))
    return kept.select(*rows.columns), audit


def merge_abbreviations(rows: DataFrame) -> DataFrame:
    """Abbreviation duplicates merged whatever their codes."""
    return fold_names(rows, tx.simple_variants, respect_codes=False)
