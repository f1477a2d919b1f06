"""All claim combinations against the gate rules written out by hand."""
import itertools

from notecoder.operators import evidence as me

E4 = ("monitoring", "evaluation", "assessment", "treatment")


def row(flags, sources, **over):
    texts = {"monitoring": "recheck labs soon", "evaluation": "creatinine was high", "assessment": "listed as active", "treatment": "continue lisinopril"}
    r = {"doc_id": 1, "ord": 0, "sources": list(sources), "overall_confidence": 0.9, "context": " ".join(texts.values())}
    for e, f in zip(E4, flags):
        r.update({e: f, f"{e}_evidence": texts[e] if f else "", f"{e}_confidence": 0.7 if f else 0.0})
    r.update(over)
    return r


SCHEMA = "doc_id long, ord long, sources array<string>, overall_confidence double, context string, " + ", ".join(
    f"{e} boolean, {e}_evidence string, {e}_confidence double" for e in E4)


def run(spark, rows):
    for i, r in enumerate(rows):
        r["ord"] = i
    return me.gate(spark.createDataFrame(rows, SCHEMA)).orderBy("ord").collect()


def test_truth_table(spark):
    combos = list(itertools.product([False, True], repeat=4))
    cases = [(c, s) for c in combos for s in (("assessment",), ("past_medical_history",), ("medications",))]
    out = run(spark, [row(c, s) for c, s in cases])
    for ((m, e, a, t), s), r in zip(cases, out):
        if s == ("past_medical_history",):
            a = False
            want = m + e + t >= 2
        else:
            want = (a and (m or e or t)) or (t and (m or e)) or m + e + a + t >= 2
        assert (r.meat_valid, r.assessment) == (want, a), (s, r)


def test_evidence_checks(spark):
    all_on = (True, True, True, True)
    out = run(spark, [
        row(all_on, ["assessment"], treatment_evidence="invented words not anywhere here"),
        row(all_on, ["assessment"], treatment_evidence="xyz qrs tuv"),
        row(all_on, ["assessment"], treatment_evidence="no"),
        row(all_on, ["assessment"], treatment_evidence="continue  LISINOPRIL"),
        row(all_on, ["social_history"], assessment_evidence="listed as active, history of flare", context="listed as active, history of flare"),
        row(all_on, ["assessment"], monitoring_evidence="denies cough today", context="denies cough today " + row(all_on, [])["context"]),
    ])
    assert (out[0].treatment, out[0].review) == (False, True)
    assert (out[1].treatment, out[1].review) == (True, True)  # short texts only cost the review
    assert out[2].treatment is False and out[2].treatment_confidence == 0.0
    assert out[3].treatment and not out[3].review
    assert not out[4].assessment and not out[4].meat_valid
    assert not out[5].monitoring


def test_gate_never_claims_more(spark):
    out = run(spark, [row(c, ["plan"]) for c in itertools.product([False, True], repeat=4)])
    for c, r in zip(itertools.product([False, True], repeat=4), out):
        assert all(not r[e] or f for e, f in zip(E4, c))
