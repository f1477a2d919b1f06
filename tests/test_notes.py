"""Sections, mentions, replies and the whole route on a small note."""
from pyspark.sql import functions as F

from notecoder.operators import mentions as mn
from notecoder.operators import replies as rp
from notecoder.operators import sections as se
from notecoder.plans import coding as pl

NOTE = """[Chief Complaint]
Patient presents with cough.

PMH:
• Hypertension Active 01/10/2020
• Anxiety disorder Active 02/11/2021

=== Medications ===
metformin 500 mg bid

Assessment and Plan:
1. Essential hypertension: BP stable, continue lisinopril 10 mg daily
2. Asthma: continue albuterol, recheck in 3 months
"""


def docs(spark, text=NOTE):
    return spark.createDataFrame([(1, text)], "doc_id long, text string")


def test_sections(spark):
    out = {s.section: s.text for s in se.with_sections(docs(spark), "ratio").first().sections}
    assert list(out) == ["chief_complaint", "past_medical_history", "medications", "assessment_and_plan"]
    assert out["medications"] == "metformin 500 mg bid"


def test_mentions(spark):
    found = {r.norm: r.detector for r in mn.mentions(docs(spark)).collect()}
    assert found["essential hypertension"] == "numbered" and found["asthma"] == "numbered"
    assert found["anxiety disorder"] == "bulleted"


def test_reply_repair(spark):
    raw = ['{"k": 1}', '```json\n{"k": 2}\n```', '{"k": 3, }', 'so: {"k": 4} ok', '{"k": 5, "b": [1', "nothing"]
    df = spark.createDataFrame([(i, r) for i, r in enumerate(raw)], "doc_id long, raw string")
    out = rp.repair(df, "k long").orderBy("doc_id").collect()
    assert [r.parsed.k if r.parsed else None for r in out] == [1, 2, 3, 4, 5, None]
    assert [r.repair for r in out] == ["none", "tidied", "tidied", "balanced", "balanced", "failed"]


def test_route(spark):
    codes = spark.createDataFrame([("I10", "Essential hypertension", "Non-HCC", 1), ("J45.909", "Asthma", "Non-HCC", 2)],
                                  "code string, description string, hcc_status string, seq long")
    out = {r.icd_code: r for r in pl.code_notes(docs(spark), codes).collect()}
    assert set(out) == {"I10", "J45.909"}
    assert out["I10"].treatment and out["I10"].assessment
    assert 0 <= out["I10"].confidence <= 1
