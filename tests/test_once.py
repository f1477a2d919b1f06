"""Costly steps stand in a plan once, however often their results are read."""
from pyspark.sql import functions as F

from notecoder.functions import similarity as sim
from notecoder.functions import text as tx
from notecoder.operators import coverage as cv
from notecoder.operators import evaluate as ev
from notecoder.operators import replies as rp
from notecoder.operators import results as rs


def _optimized(df) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_coverage_codes_search_texts_once(spark):
    docs = spark.createDataFrame([(1, "Assessment:\n1. Gout of the left foot\n2. Iron deficiency anemia\n")], "doc_id bigint, text string")
    kept = spark.createDataFrame([(1, "gout", "M10.9")], "doc_id bigint, disease string, icd_code string")
    codes = spark.createDataFrame([("D50.9", "Iron deficiency anemia", "Non-HCC", 1)], "code string, description string, hcc_status string, seq bigint")
    out = cv.assessment_coverage(docs, kept, codes)
    assert "chief" not in _optimized(out)
    assert [(r.disease, r.icd_code) for r in out.collect()] == [("Iron deficiency anemia", "D50.9")]


def test_qualifier_of_a_name_is_split_off_once(spark):
    names = ["CKD stage 3", " HTN ", "hypertension", "unknown 4", "type 2", "", None, "CKD3"]
    rows = spark.createDataFrame([(n,) for n in names], "name string").select("name", tx.name_variants(F.col("name")).alias("keys"))
    assert _optimized(rows).count("stage|type") <= 3
    got = {r.name: r["keys"] for r in rows.collect()}
    assert got["CKD stage 3"] == ["ckd stage 3", "chronic kidney disease stage 3", "chronic kidney disease"]
    assert got["CKD3"] == ["ckd3", "chronic kidney disease 3", "chronic kidney disease"]
    assert got[" HTN "] == ["htn", "hypertension"] and got["hypertension"] == ["hypertension", "htn"]
    assert got["unknown 4"] == ["unknown 4"] and got["type 2"] == ["type 2"] and got[""] == [""] and got[None] == []


def _rows(spark):
    texts = ("monitoring", "evaluation", "assessment", "treatment")
    rows = [(1, 1, "Gout", "M10.9", ["assessment"], "strong_evidence", "Chronic", True, "seen"),
            (1, 2, "Asthma", "J45.909", ["past_medical_history"], "strong_evidence", "Chronic", False, ""),
            (2, 1, "Asthma", "J45.909", ["hpi", "history_present_illness"], "weak_evidence", "Chronic", False, "x")]
    df = spark.createDataFrame(rows, "doc_id bigint, ord bigint, disease string, icd_code string, sources array<string>, meat_tier string, disease_status string, treatment boolean, ev string")
    return df.select("*", *[F.col("ev").alias(f"{t}_evidence") for t in texts]).drop("ev")


def test_both_modes_meet_a_document_once(spark):
    rows = _rows(spark)
    both = rs.strict_output_filters(rows, ["single", "multi"])
    assert _optimized(both).count("Join") == 1
    key = lambda df, m: sorted((m, r.doc_id, r.ord, r.disease, r.grace) for r in df.collect())
    alone = key(rs.strict_output_filter(rows, True), "single") + key(rs.strict_output_filter(rows), "multi")
    assert sorted((r["mode"], r.doc_id, r.ord, r.disease, r.grace) for r in both.collect()) == sorted(alone) and alone


def test_replies_are_read_once(spark):
    df = spark.createDataFrame([(1, '{"k": 1}'), (2, '```json\n{"k": 2}\n```'), (3, 'so: {"k": 3'), (4, "none"), (5, None)], "doc_id int, raw string")
    out = rp.repair(df, "k long")
    assert "Union" not in _optimized(out)
    assert sorted((r.doc_id, r.repair, r.parsed and r.parsed.k) for r in out.collect()) == [
        (1, "none", 1), (2, "tidied", 2), (3, "balanced", 3), (4, "failed", None), (5, "failed", None)]


def test_fuzzy_detection_meets_in_one_shuffle(spark):
    schema = "doc_id int, ord bigint, disease string, negated boolean"
    p = spark.createDataFrame([(1, 2, "type 2 diabetes", False), (1, 1, "Diabetes type 2", False), (1, 3, None, False), (2, 1, "gout", False)], schema)
    e = spark.createDataFrame([(1, 1, "diabetes type 2", False), (1, 2, None, False), (1, 3, "gout", True), (3, 1, "copd", False)], schema)
    out = ev.detection_fuzzy(p, e)
    assert "Join" not in _optimized(out)
    assert sorted((r.doc_id, r.tp, r.fp, r.fn) for r in out.collect()) == [(1, 1, 2, 1), (2, 0, 1, 0), (3, 0, 0, 1)]


def test_a_worker_scores_a_pair_of_texts_once():
    sim.repeated_partial_score.cache_clear()
    for _ in range(3):
        assert sim.repeated_partial_score("recheck labs", "please recheck labs soon") == 100
    assert sim.repeated_partial_score.cache_info().misses == 1
