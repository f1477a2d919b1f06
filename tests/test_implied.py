"""Diseases implied by drugs: fixed words, nothing compiled for a text."""
from pyspark.sql import functions as F

from notecoder import catalog
from notecoder.knowledge import clinical as kn
from notecoder.operators import mentions as mn


def test_implied_diseases_against_plain_search(spark):
    texts = ["", "no drug", *[g[k % len(g)].upper() for k, (_, g) in enumerate(kn.DISEASE_DRUGS)], " ".join(g[0] for _, g in kn.DISEASE_DRUGS), None]
    present = [[], ["type 2 diabetes"], ["hypothyroidism", "essential hypertension"]]
    rows = [(t, p) for t in texts for p in present]
    for r in spark.createDataFrame(rows, "t string, p array<string>").select("t", "p", mn.implied_array(F.col("t"), F.col("p")).alias("d")).collect():
        covers = lambda d: any(d.lower() == p or len(set(d.lower().split()) & set(p.split())) / len(set(d.lower().split())) >= 0.6 for p in r.p)
        assert r.d == [d for d, g in kn.DISEASE_DRUGS if any(w in (r.t or "").lower() for w in g) and not covers(d)]


def test_no_pattern_out_of_a_table(spark):
    plan = catalog.load().QUERIES["medication_implied"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert "RLIKE(lower" not in plan and ".g)" not in plan and "metformin|glipizide" not in plan


def test_rejected_names(spark):
    names = ["123", "Aspirin 81 mg", "01/02/2024", "dr. Smith", "Drift", "Appendectomy", "post op pain", "continue care", "Discontinue", "flu Vaccine", "Gout", "10 units"]
    df = spark.createDataFrame([(n,) for n in names], "n string")
    kept = {r.n for r in df.where(mn.accepted(F.col("n"), F.lower("n"))).collect()}
    assert kept == {"Drift", "Discontinue", "Gout"}
