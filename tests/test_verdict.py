"""Cases that an earlier version got wrong."""
from pyspark.sql import functions as F

from notecoder.functions import text as tx
from notecoder.operators import evaluate as ev
from notecoder.operators import evidence as me
from notecoder.operators import mapping as mp
from notecoder.operators import results as rs
from notecoder.operators import rules as ru
from notecoder.streaming import jobs

NAMES = "doc_id long, ord long, disease string, negated boolean"


def test_short_term_is_searched(spark):
    names = spark.createDataFrame([("RA",), ("?",)], "name string")
    codes = spark.createDataFrame([("M069", "Rheumatoid arthritis RA", "x", 1), ("I10", "Hypertension", "x", 2)], "code string, description string, hcc_status string, seq long")
    found = mp.candidates(names, codes, synonyms=[]).select("name", "code").collect()
    assert [tuple(r) for r in found] == [("RA", "M069")]


def test_five_candidates_are_kept(spark):
    names = spark.createDataFrame([("asthma",)], "name string")
    codes = spark.createDataFrame([(f"J4{i}", f"Asthma form {i}", "x", i) for i in range(7)], "code string, description string, hcc_status string, seq long")
    r = mp.search_combined(names, codes).first()
    assert len(r.candidates) == 5 and r.candidates[0].icd_code == r.icd_code and [c.rank for c in r.candidates] == [1, 2, 3, 4, 5]


def test_long_code_is_not_cut(spark):
    long_code = "A00" + "1" * 150
    assert spark.range(1).select(tx.format_code(F.lit(long_code)).alias("c")).first().c == "A00." + "1" * 150


def test_every_body_mass_band(spark):
    values = {15.0: "Z68.1", 19.9: "Z68.1", 20.0: "Z68.20", 22.0: "Z68.22", 39.9: "Z68.39", 44.0: "Z68.41", 45.0: "Z68.42", 59.0: "Z68.43", 69.0: "Z68.44", 70.0: "Z68.45"}
    df = spark.createDataFrame([(v,) for v in values], "v double")
    assert {r.v: r.c for r in df.select("v", rs.bmi_band(F.col("v")).alias("c")).collect()} == values


def test_fuzzy_detection_counts_occurrences(spark):
    p = spark.createDataFrame([(1, 0, "asthma", False), (1, 1, "asthma", False), (1, 2, "gout", False)], NAMES)
    e = spark.createDataFrame([(1, 0, "asthma", False), (1, 1, "copd", False)], NAMES)
    r = ev.detection_fuzzy(p, e).first()
    assert (r.tp, r.fp, r.fn) == (1, 2, 1)


def test_rerun_without_rows_removes_old_ones(spark, tmp_path):
    path = str(tmp_path / "r")
    rows = spark.createDataFrame([(d, 0, f"a{d}") for d in range(6)], "doc_id long, ord long, disease string")
    rs.replace_document_results(rows, path, buckets=3)
    ran = spark.createDataFrame([(2,), (3,), (4,)], "doc_id long")
    rs.replace_document_results(rows.where("doc_id = 3"), path, buckets=3, processed=ran)
    assert sorted(r.doc_id for r in spark.read.parquet(path).collect()) == [0, 1, 3, 5]
    rs.replace_document_results(rows.limit(0), path, buckets=3, processed=rows.select("doc_id"))
    assert spark.read.schema(rows.schema).parquet(path).count() == 0


def test_gate_tries_windows_last(spark):
    stated = "continue lisinopril 10 mg every day"
    blank = {f"{x}_evidence": "" for x in ("monitoring", "evaluation", "assessment")}
    row = {**blank, "treatment_evidence": stated, "context": "bp fine. continue lisinoprl 10mg every day as before.", "sources": ["assessment"], "overall_confidence": 0.9}
    df = spark.createDataFrame([row], ", ".join(f"{k} string" for k in [*blank, "treatment_evidence", "context"]) + ", sources array<string>, overall_confidence double")
    df = df.withColumns({x: F.col(f"{x}_evidence") != "" for x in ru.ELEMENTS} | {f"{x}_confidence": F.lit(0.7) for x in ru.ELEMENTS})
    out = me.gate(df).first()
    assert out.treatment and "treatment: evidence not in source" not in out.issues
    far = me.gate(df.withColumn("context", F.lit("nothing of the kind was said"))).first()
    assert "treatment: evidence not in source" in far.issues


def test_code_description_documents_a_row(spark):
    rows = spark.createDataFrame([(1, "HF", "congestive heart failure", ["plan"]), (2, "HF", "congestive heart failure", ["plan"])], "doc_id long, disease string, icd_description string, sources array<string>")
    rows = rows.withColumns({f"{x}_evidence": F.lit("") for x in ru.ELEMENTS})
    notes = spark.createDataFrame([(1, "Known failure of the heart muscle"), (2, "Nothing")], "doc_id long, text string")
    assert {r.doc_id: r.removed for r in ru.mark_documented(rows, notes).collect()} == {1: False, 2: True}


def test_latest_version_of_a_late_note(spark):
    rows = [(1, "old", "2020-01-01"), (1, "new", "2024-01-01"), (2, "late", "1999-01-01"), (2, "late", "1999-01-01")]
    notes = spark.createDataFrame(rows, "doc_id long, text string, at string").withColumn("arrived", F.col("at").cast("timestamp"))
    assert sorted((r.doc_id, r.text) for r in jobs.latest_notes(notes).collect()) == [(1, "new"), (2, "late")]


def test_status_codes(spark):
    from notecoder.operators import status as st

    rows = [(1, "Personal history of left breast cancer. Continue warfarin. ICD check next week", "warfarin 5 mg daily\naspirin 81 mg"), (2, "accident", None), (3, None, "NPH units"),
            (4, "Atrial fibrillation, rate controlled. Diabetes.", "apixaban and metformin, aspirin 81 mg")]
    docs = spark.createDataFrame(rows, "doc_id long, assessment string, medications string")
    assert [(r.doc_id, r.disease, r.icd_code) for r in st.history_codes(docs).collect()] == [(1, "Personal history of left breast cancer", "Z85.819")]
    assert sorted((r.doc_id, r.icd_code, r.drug, r.included, r.reason) for r in st.long_term_drugs(docs).collect()) == [
        (1, "Z79.01", "warfarin", True, None), (1, "Z79.02", "aspirin 81 mg", False, "ENCOUNTER_NOT_RELEVANT"), (3, "Z79.4", "NPH", False, "ENCOUNTER_NOT_RELEVANT"),
        (4, "Z79.01", "apixaban", True, None), (4, "Z79.02", "aspirin 81 mg", False, "ENCOUNTER_NOT_RELEVANT")]
    assert [(r.doc_id, r.status, r.trigger) for r in st.device_codes(docs).collect()] == [(1, "ICD_defibrillator", "ICD")]
