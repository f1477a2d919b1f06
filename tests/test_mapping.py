from notecoder.functions.similarity import token_set_score
from notecoder.operators import mapping as mp

CODES = [("E119", "Type 2 diabetes mellitus without complications", 1), ("E109", "Type 1 diabetes mellitus without complications", 2),
         ("I10", "Essential hypertension", 3), ("M1712", "Unilateral primary osteoarthritis, left knee", 4), ("J45909", "Unspecified asthma, uncomplicated", 5)]


def frames(spark, *names):
    codes = spark.createDataFrame([(c, d, "Non-HCC", s) for c, d, s in CODES], "code string, description string, hcc_status string, seq long")
    return spark.createDataFrame([(n,) for n in names], "name string"), codes


def test_lookup_tiers(spark):
    names, codes = frames(spark, "Essential Hypertension", "HTN", "asthma", "no such thing at all")
    out = {r.name: r for r in mp.search_combined(names, codes).collect()}
    assert (out["Essential Hypertension"].icd_code, out["Essential Hypertension"].search_method) == ("I10", "exact")
    assert (out["HTN"].icd_code, out["HTN"].search_method) == ("I10", "exact")
    assert (out["asthma"].icd_code, out["asthma"].search_method) == ("J45.909", "fuzzy")
    assert out["no such thing at all"].search_method == "none"


def test_candidates_equal_all_pairs_search(spark):
    names, codes = frames(spark, "type 1 diabetes", "knee osteoarthritis", "uncomplicated", "zzz")
    got = {(r.name, r.code) for r in mp.candidates(names, codes).collect()}
    terms = mp.search_terms(names).collect()
    want = {(t.name, c) for t in terms for c, d, _ in CODES if all(n in d.lower() for n in t.needles)}
    assert got == want


def test_contradicting_type_is_penalized(spark):
    names, codes = frames(spark, "type 2 diabetes mellitus")
    scored = {r.code: r.score for r in mp.score(mp.candidates(names, codes)).collect()}
    # the right type: capped at 100, plus 4 for the unspecified-style wording; the wrong one
    # loses 30 and gains the 15 of a description that starts with the searched word
    base = token_set_score("type 2 diabetes mellitus", "type 1 diabetes mellitus without complications")
    assert scored["E119"] == 104 and scored["E109"] == base - 30 + 15


def test_validation(spark):
    _, codes = frames(spark)
    rows = spark.createDataFrame([("I10",), ("E11.9",), ("E11.65",), ("—",), ("nope",), ("Q99",)], "icd_code string")
    assert {r.icd_code: r.reason for r in mp.validate_codes(rows, codes).collect()} == {
        "I10": "exact", "E11.9": "dot_normalized", "E11.65": "category", "—": "placeholder", "nope": "format", "Q99": "unknown"}
