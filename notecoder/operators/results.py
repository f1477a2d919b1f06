"""Result assembly, filtering, de-duplication, scoring, summaries and reports."""
from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as tx
from ..functions.arrays import let
from ..functions.skew import running, with_group
from ..knowledge import clinical as kn
from ..knowledge import coding as kc
from ..settings import DEFAULTS, Settings
from .rules import ELEMENTS, coded, evidence, fold_names, has_evidence


def element_count() -> Column:
    return sum((F.col(e).cast("int") for e in ELEMENTS), F.lit(0))


def tier_score(tier: Column) -> Column:
    out = F.lit(0.0)
    for name, value in kc.TIER_SCORES.items():
        out = F.when(tier == name, F.lit(value)).otherwise(out)
    return out


def confidence_score(settings: Settings = DEFAULTS) -> Column:
    """Composite of evidence completeness, code confidence and evidence tier."""
    texts = sum(((F.trim(evidence(e)) != "").cast("int") for e in ELEMENTS), F.lit(0))
    complete = F.least(element_count() / 4.0 + F.least(texts * 0.05, F.lit(0.15)), F.lit(1.0))
    total = (
        settings.weight_evidence * complete + settings.weight_code * F.coalesce("icd_confidence", F.lit(0.0))
        + settings.weight_disease * tier_score(F.col("meat_tier"))
    )
    return F.greatest(F.lit(0.0), F.least(F.bround(total, 3), F.lit(1.0)))


def simple_confidence() -> Column:
    """Short form used for single-reply results."""
    return F.bround(0.6 * (element_count() / 4.0) + 0.4 * F.coalesce("icd_confidence", F.lit(0.0)), 2)


def output_filter(rows: DataFrame) -> DataFrame:
    """Coded rows with a usable name and some evidence text.

    A document that would lose all its rows keeps every coded row instead.
    """
    name = tx.clean_display_name(F.col("disease"))
    passed = coded() & (F.length(name) > 0) & ~tx.is_fragment(name) & has_evidence()
    g = with_group(rows.withColumn("_ok", passed), ["doc_id"], _any=F.max("_ok"))
    kept = g.where(F.col("_ok") | (~F.col("_any") & coded()))
    return kept.withColumn("disease", F.when(F.col("_ok"), name).otherwise(F.col("disease"))).drop("_ok", "_any")


def normal_sources() -> Column:
    return F.transform("sources", lambda s: F.replace(F.lower(s), F.lit(" "), F.lit("_")))


def section_priority(rows: DataFrame, single_pass: bool) -> DataFrame:
    """``passes``: assessment-first section rule of either mode."""
    hits = lambda names: F.arrays_overlap(normal_sources(), tx.literal_array(names))
    treated = F.col("treatment") | (evidence("treatment") != "")
    active, focus = hits(kc.EVIDENCE_SECTIONS), hits(kc.FOCUS_SECTIONS)
    g = with_group(rows, ["doc_id"], _assessed=F.max(hits(kc.ASSESSMENT_SECTIONS)))
    sole = (F.size("sources") > 0) & F.forall(normal_sources(), lambda s: s.isin(kc.SOLE_SECTIONS))
    single = ~sole & (
        hits(kc.VISIT_ASSESSMENT) | (hits(kc.SECONDARY_SECTIONS) & (treated | active | focus))
        | (focus & (treated | active)) | hits(kc.ASSESSMENT_SECTIONS) | ((treated | active) & hits(kc.PRIMARY_SECTIONS))
    )
    multi = hits(kc.ASSESSMENT_SECTIONS) | treated
    otherwise = F.lit(True) if single_pass else hits(kc.CLINICAL_SECTIONS)
    return g.withColumn("passes", F.when(F.col("_assessed"), single if single_pass else multi).otherwise(otherwise)).drop("_assessed")


def graceful() -> Column:
    overlap = F.arrays_overlap(normal_sources(), tx.literal_array(kc.GRACE_SECTIONS))
    family_only = F.forall(normal_sources(), lambda s: s.isin(kc.FAMILY_SECTIONS))
    return overlap & ~F.col("meat_tier").isin("history_only", "invalid") & (F.col("disease_status") != "History Only") & ~family_only


def grace_rows(rows: DataFrame) -> DataFrame:
    """Rows from clinical sections accepted when no row of a document passed."""
    return rows.where(graceful())


def strict_output_filter(rows: DataFrame, single_pass: bool = False) -> DataFrame:
    """Rows of active, coded diseases with evidence text from the right sections; ``grace`` marks those of the fallback.

    Where a document has rows from an assessment or problem list, other rows need a treatment
    or, in single pass, the visit's focus or active evidence beside a primary section. A
    cancer outside the visit's assessment is history unless its code says so. A document
    without a row that passes falls back on its active rows from clinical sections, whose
    names stay as they are. A null name, tier, status, code or list of sources passes no rule about it.
    """
    return strict_output_filters(rows, ["single" if single_pass else "multi"]).drop("mode")


def strict_output_filters(rows: DataFrame, modes: list[str]) -> DataFrame:
    """``strict_output_filter`` by one or both modes (``single``, ``multi``), told by ``mode``, in one pass.

    Each row is judged for a document with and one without an assessment, so that one aggregate of flags tells
    a document's kind and whether any row of it passes; only rows that may stay meet it.
    """
    hits = lambda names: F.coalesce(F.arrays_overlap(normal_sources(), tx.literal_array(names)), F.lit(False))
    treated = F.coalesce("treatment", F.lit(False)) | (evidence("treatment") != "")
    visit, focus, active = hits(kc.VISIT_ASSESSMENT), hits(kc.FOCUS_SECTIONS), hits(kc.EVIDENCE_SECTIONS)
    listed = hits(kc.STRICT_ASSESSMENT)
    # the section rule in a document with an assessment, and in one without
    rules = {
        "single": (visit | focus | ((treated | active) & hits(kc.STRICT_PRIMARY)), F.lit(True)),
        "multi": (listed | treated, hits(kc.STRICT_CLINICAL)),
    }
    code, name = F.coalesce("icd_code", F.lit("")), tx.clean_display_name(F.col("disease"))
    past_cancer = F.col("disease").rlike(kc.CANCER) & ~visit & ~code.startswith(kc.CANCER_HISTORY_CODE)
    sole = (F.size("sources") > 0) & F.forall(normal_sources(), lambda s: s.isin(kc.RESTRICTED_SECTIONS))
    current = ~F.col("meat_tier").isin(kc.EXCLUDED_TIERS) & (F.col("disease_status") != "History Only")
    texts = F.trim(F.concat(*[evidence(e) for e in ELEMENTS])) != ""
    passed = ~past_cancer & current & ~sole & ~code.isin("", "—", "-") & ~tx.is_fragment(name) & texts
    sure = lambda c: F.coalesce(c, F.lit(False))
    g = rows.withColumns({"_listed": listed, "_passed": sure(passed), "_grace": sure(graceful())})
    flags = {f"_{k}_{m}": F.col("_passed") & rules[m][i] for m in modes for i, k in enumerate(("with", "without"))}
    g = g.withColumns(flags)
    doc = g.groupBy("doc_id").agg(F.max("_listed").alias("_assessed"), *[F.max(f).alias(f"_any{f}") for f in flags])
    may = g.where(reduce(lambda x, y: x | y, [F.col(f) for f in flags], F.col("_grace"))).drop("_listed", "_passed")
    j = may.join(doc, "doc_id", "left")
    of = lambda prefix, m: F.when(F.col("_assessed"), F.col(f"{prefix}_with_{m}")).otherwise(F.col(f"{prefix}_without_{m}"))
    judged = [F.struct(F.lit(m).alias("mode"), of("", m).alias("ok"), of("_any", m).alias("any")) for m in modes]
    kept = j.withColumn("_m", F.explode(F.array(*judged))).where(F.col("_m.ok") | (~F.col("_m.any") & F.col("_grace")))
    out = {"disease": F.when(F.col("_m.ok"), name).otherwise(F.col("disease")), "grace": ~F.col("_m.ok"), "mode": F.col("_m.mode")}
    return kept.withColumns(out).select(*rows.columns, "grace", "mode")


def bmi_band(value: Column) -> Column:
    """Z68 code of a body mass index; null outside the bands."""
    def band(v: Column) -> Column:
        out = F.lit(None).cast("string")
        for lo, hi, code in kc.BMI_BANDS:
            out = F.when((v >= lo) & (v < hi), code).otherwise(out)
        return out

    return let(value, band)


def correct_codes(rows: DataFrame) -> DataFrame:
    """Elevated-reading wording turns I10 into R03.0; a stated BMI sets the Z68 band."""
    text = F.concat_ws(" ", "disease", evidence("assessment"))
    bmi = bmi_band(F.nullif(F.regexp_extract(text, kc.BMI_VALUE, 1), F.lit("")).cast("double"))
    return rows.withColumn(
        "icd_code",
        F.when((F.col("icd_code") == "I10") & text.rlike(kc.ELEVATED_PRESSURE), F.lit("R03.0"))
        .when(F.col("icd_code").startswith("Z68.") & bmi.isNotNull(), bmi).otherwise(F.col("icd_code")),
    )


def active_management() -> Column:
    """Whether the evidence shows the condition is being managed in this encounter."""
    m, e, a, t = (F.trim(evidence(x)) for x in ELEMENTS)
    acts = lambda c: c.rlike(kc.MANAGEMENT)
    return F.when((m != "") | (e != ""), F.lit(True)).when(t != "", ~t.rlike(kc.MAINTENANCE_ONLY) & acts(t)).otherwise(acts(a))


def historical_name() -> Column:
    return F.col("disease").rlike(kc.HISTORY_NAME)


def tier_rank(tier: Column) -> Column:
    out = F.lit(9)
    for name, value in kc.TIER_RANK.items():
        out = F.when(tier == name, F.lit(value)).otherwise(out)
    return out


def dedup_by_code(rows: DataFrame) -> DataFrame:
    """Per document and code the longest name, then the better tier, then the first row."""
    has = F.coalesce("icd_code", F.lit("")).isin("", "—")
    fields = [c for c in rows.columns if c not in ("doc_id", "icd_code")]
    order = F.struct(F.length("disease").alias("n"), (-tier_rank(F.col("meat_tier"))).alias("t"), (-F.col("ord")).alias("o"))
    best = rows.where(~has).groupBy("doc_id", "icd_code").agg(F.max_by(F.struct(*fields), order).alias("b"))
    return best.select("doc_id", "icd_code", "b.*").unionByName(rows.where(has))


def dedup_abbreviations(rows: DataFrame) -> DataFrame:
    """Abbreviation groups merged, never across different codes."""
    return fold_names(rows, tx.name_variants, respect_codes=True)


def distinct_names(rows: DataFrame) -> DataFrame:
    return rows.select("doc_id", F.trim(F.lower("disease")).alias("name"), F.coalesce("icd_code", F.lit("")).alias("code")).distinct()


def dedup_substring(rows: DataFrame) -> DataFrame:
    """Drop names strictly contained in another name of the document (same or missing code).

    Repeats of a name are combined first, and the names of a document travel once as one
    array; each row then tests its own name against it.
    """
    names = distinct_names(rows).groupBy("doc_id").agg(F.collect_list(F.struct("name", "code")).alias("_names"))
    own, code = F.trim(F.lower("disease")), F.coalesce("icd_code", F.lit(""))
    inside = F.exists("_names", lambda o: (
        F.contains(o["name"], own) & (F.length(own) < F.length(o["name"]))
        & ((code == "") | (o["code"] == "") | (code == o["code"]))
    ))
    return rows.join(names, "doc_id").where(~inside).drop("_names")


# Endings cut from words of five or more letters, longest first; letters left at least, letters of a root.
STEM_ENDINGS, STEM_LEFT, ROOT = ("ies", "ous", "es", "ia", "ic", "al", "y", "s"), 4, 5


def name_roots(name: Column) -> Column:
    """Roots of the long words of a lower-case name."""
    def root(w: Column) -> Column:
        out = w
        for end in reversed(STEM_ENDINGS):
            out = F.when(w.endswith(end) & (F.length(w) - len(end) >= STEM_LEFT), F.substr(w, F.lit(1), F.length(w) - len(end))).otherwise(out)
        return out

    long_words = F.filter(F.split(name, r"\s+"), lambda w: F.length(w) >= ROOT)
    return F.filter(F.transform(long_words, root), lambda r: F.length(r) >= ROOT)


def dedup_stem(rows: DataFrame) -> DataFrame:
    """Drop a shorter name one of whose roots is in a longer name (same or missing code).

    Names are judged in row order and a name already dropped saves no other, so this is a
    fold over a document's distinct names and codes; repeats are combined before the shuffle.
    """
    name, code = F.trim(F.lower("disease")), F.coalesce("icd_code", F.lit(""))
    keyed = rows.withColumns({"_name": name, "_code": code})
    first = keyed.groupBy("doc_id", "_name", "_code").agg(F.min("ord").alias("o"))
    item = F.struct("o", F.col("_name").alias("name"), F.col("_code").alias("code"), F.replace("_name", F.lit(" "), F.lit("")).alias("squashed"), name_roots(F.col("_name")).alias("roots"))
    docs = first.groupBy("doc_id").agg(F.array_sort(F.collect_list(item)).alias("items"))

    def step(gone: Column, x: Column) -> Column:
        covers = lambda y: (F.length(x["name"]) < F.length(y["name"])) & ((x["code"] == "") | (y["code"] == "") | (x["code"] == y["code"])) & (
            ~F.array_contains(gone, y["o"])) & F.exists(x["roots"], lambda r: F.contains(y["squashed"], r))
        return F.when((F.size(x["roots"]) > 0) & F.exists("items", covers), F.array_append(gone, x["o"])).otherwise(gone)

    gone = docs.select("doc_id", "items", F.aggregate("items", F.array().cast("array<bigint>"), step).alias("gone"))
    out = gone.select("doc_id", "gone", F.explode("items").alias("x")).where(F.array_contains("gone", F.col("x.o")))
    out = out.select("doc_id", F.col("x.name").alias("_name"), F.col("x.code").alias("_code"))
    return keyed.join(out, ["doc_id", "_name", "_code"], "left_anti").select(*rows.columns)


def final_order(rows: DataFrame) -> DataFrame:
    """``number``: position by lower-case name within the document."""
    keyed = rows.withColumn("_name", F.lower("disease"))
    return running(keyed, ["doc_id"], [F.col("_name"), F.col("ord")], {}, row_number="number").drop("_name")


def document_summary(rows: DataFrame, detected: DataFrame | None = None) -> DataFrame:
    """Rows per tier, coded rows and excluded rows per document."""
    n = F.count_if
    tier = lambda t: n(F.col("meat_tier") == t).alias(t)
    g = rows.groupBy("doc_id").agg(
        F.count("*").alias("total"), *[tier(t) for t in ("strong_evidence", "moderate_evidence", "weak_evidence", "no_meat")],
        n(coded()).alias("icd_mapped"),
    )
    if detected is None:
        return g
    all_rows = detected.groupBy("doc_id").agg(F.count("*").alias("total_detected"))
    joined = all_rows.join(g, "doc_id", "left").na.fill(0)
    return joined.withColumn("total_excluded", F.col("total_detected") - F.col("total"))


def unified_results(graded: DataFrame, mappings: DataFrame) -> DataFrame:
    """Graded mentions with their code, label and level; joined on the mention key."""
    joined = graded.join(mappings, ["doc_id", "ord"], "left")
    level = F.coalesce(F.try_element_at(tx.literal_map([
        ("strong_evidence", "Strong Evidence"), ("moderate_evidence", "Moderate Evidence"), ("weak_evidence", "Weak Evidence"),
    ]), "meat_tier"), F.lit("No MEAT"))
    return joined.withColumns({
        "segment": tx.section_label(F.col("sources")), "meat_level": level,
        "icd_confidence": F.coalesce("icd_confidence", F.lit(0.0)), "icd_method": F.coalesce("icd_method", F.lit("none")),
    })


def coding_export(rows: DataFrame) -> DataFrame:
    """Eight-column export of valid, coded rows with at least one element."""
    score = element_count()
    cell = lambda e: F.when(evidence(e) != "", evidence(e)).when(F.col(e), "Yes").otherwise("—")
    label = F.element_at(tx.literal_array(["Partial MEAT", "Half MEAT", "Medium MEAT", "Full MEAT"]), score)
    kept = rows.where(F.col("meat_valid") & coded() & (score > 0))
    return kept.select(
        "doc_id", "ord", F.col("disease").alias("Disease"), F.col("icd_code").alias("ICD-10 Code"),
        tx.title_label(F.coalesce(F.nullif(F.get("sources", F.lit(0)), F.lit("")), F.lit("Unknown"))).alias("Segment"),
        cell("monitoring").alias("Monitor"), cell("evaluation").alias("Evaluate"),
        cell("assessment").alias("Assess"), cell("treatment").alias("Treatment"), label.alias("MEAT Level"),
    )


def tick(e: str) -> Column:
    return F.when(F.col(e), "✓").otherwise("")


def percent(c: Column) -> Column:
    return F.format_string("%d%%", F.bround(c * 100, 0).cast("int"))


def billing_report(rows: DataFrame) -> DataFrame:
    return rows.select(
        "doc_id", "ord", F.col("disease").alias("Disease"), F.col("icd_code").alias("ICD-10 Code"),
        F.col("meat_tier").alias("MEAT Tier"), element_count().cast("bigint").alias("MEAT Score"),
        *[tick(e).alias(e[0].upper()) for e in ELEMENTS], percent(F.col("confidence")).alias("Confidence"),
    )


def full_report(rows: DataFrame) -> DataFrame:
    return rows.select(
        "doc_id", "ord", F.col("disease").alias("Disease"), F.col("icd_code").alias("ICD-10 Code"),
        tx.section_label(F.col("sources")).alias("Section"), F.col("meat_tier").alias("MEAT Tier"),
        element_count().cast("bigint").alias("MEAT Score"), *[tick(e).alias(e[0].upper()) for e in ELEMENTS],
        *[evidence(e).alias(f"{e.title()} Evidence") for e in ELEMENTS], percent(F.col("confidence")).alias("Confidence"),
    )


def rejections(rows: DataFrame) -> DataFrame:
    """Rows left out of the output with the first reason that applies."""
    name = tx.clean_display_name(F.col("disease"))
    reason = (
        F.when(F.col("negated"), "NEGATED").when(~coded(), "NO_CODE").when(tx.is_fragment(name), "FRAGMENT")
        .when(~has_evidence(), "NO_MEAT_EVIDENCE")
    )
    return rows.withColumn("reason", reason).where("reason is not null").select(
        "doc_id", "ord", "disease", "reason", F.get("sources", F.lit(0)).alias("section")
    )


def route_coalesce(routes: list[tuple[str, DataFrame]]) -> DataFrame:
    """Rows of the first route that produced any for a document, with the route's name."""
    tagged = None
    for priority, (name, df) in enumerate(routes):
        part = df.withColumns({"analysis_source": F.lit(name), "_priority": F.lit(priority)})
        tagged = part if tagged is None else tagged.unionByName(part)
    first = tagged.groupBy("doc_id").agg(F.min("_priority").alias("_first"))
    return tagged.join(first, "doc_id").where("_priority = _first").drop("_priority", "_first")


def replace_document_results(rows: DataFrame, path: str, buckets: int = 256, processed: DataFrame | None = None) -> None:
    """Replace the results of the processed documents; reruns give the same files.

    ``processed`` has the ``doc_id`` of every document that was run, also of those that now
    have no rows: their old rows go. Without it these are the documents of ``rows``.
    Documents fall into a fixed number of buckets; a dynamic overwrite replaces only the
    buckets present, other documents' rows of a touched bucket are carried over, and a bucket
    left without rows is emptied. One writer at a time may use a path.
    """
    spark = rows.sparkSession
    bucket = F.pmod(F.xxhash64("doc_id"), F.lit(buckets)).cast("int")
    new = rows.withColumn("doc_bucket", bucket)
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    files = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if files.exists(target):
        from ..session import reliable_checkpoint

        old = spark.read.parquet(path)
        docs = (rows if processed is None else processed).select("doc_id", bucket.alias("doc_bucket")).distinct()
        touched = docs.select("doc_bucket").distinct()
        carried = old.join(touched, "doc_bucket", "left_semi").join(docs, ["doc_id"], "left_anti")
        new = reliable_checkpoint(carried.select(*new.columns).unionByName(new))
        # a dynamic overwrite leaves buckets alone that no row falls into
        for r in touched.join(new.select("doc_bucket").distinct(), "doc_bucket", "left_anti").collect():  # at most ``buckets``
            files.delete(spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/doc_bucket={r['doc_bucket']}"), True)
    new.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("doc_bucket").parquet(path)


def mapping_stats(rows: DataFrame) -> DataFrame:
    n = lambda s: F.count_if(F.col("status") == s).alias(s)
    return rows.groupBy("doc_id").agg(F.count("*").alias("total"), n("auto_assigned"), n("manual_review"), n("not_found"))


def status_of(sources: Column, context: Column, has_drugs: Column) -> Column:
    """History Only, Active Acute, Active Chronic or Chronic from sections and wording."""
    hits = lambda names: F.arrays_overlap(F.transform(sources, F.lower), tx.literal_array(names))

    def judge(low: Column) -> Column:
        history, active = hits(kn.HISTORY_SECTIONS), hits(kn.TEMPORAL_ACTIVE_SECTIONS)
        chronic, acute = tx.contains_any(low, kn.CHRONIC_WORDS), tx.contains_any(low, kn.ACUTE_WORDS)
        return (
            F.when(history & ~active & ~has_drugs & ~chronic, "History Only")
            .when(active & acute & ~chronic, "Active Acute").when(active, "Active Chronic").otherwise("Chronic")
        )

    return let(F.lower(context), judge)


def disease_status(context: Column, has_drugs: Column) -> Column:
    return status_of(F.col("sources"), context, has_drugs)
