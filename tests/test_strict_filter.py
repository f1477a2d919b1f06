"""The strict output filter against a plain walk over each document's rows."""
import random
import re

import pytest

from notecoder.knowledge import coding as kc
from notecoder.operators import results as rs

SECTIONS = ["Assessment", "assessment_and_plan", "problem_list", "hpi", "Past Medical History", "medications", "labs", "family_history", "screening", "imaging"]
NAMES = ["Gout", "Lung cancer", "Melanoma of skin", "COPD stable", "stable on meds", None, "Obesity"]
TEXTS = ["monitoring_evidence", "evaluation_evidence", "assessment_evidence", "treatment_evidence"]


def walk(rows, single):
    out = []
    for doc in {r["doc_id"] for r in rows}:
        mine = [r for r in rows if r["doc_id"] == doc]
        of = lambda r: {s.lower().replace(" ", "_") for s in r["sources"] or []}
        assessed = any(of(r) & set(kc.STRICT_ASSESSMENT) for r in mine)
        kept = []
        for r in mine:
            s = of(r)
            treated = bool(r["treatment"] or r["treatment_evidence"])
            visit = bool(s & set(kc.VISIT_ASSESSMENT))
            if single:
                good = not assessed or visit or bool(s & set(kc.FOCUS_SECTIONS)) or bool((treated or s & set(kc.EVIDENCE_SECTIONS)) and s & set(kc.STRICT_PRIMARY))
            else:
                good = (bool(s & set(kc.STRICT_ASSESSMENT)) or treated) if assessed else bool(s & set(kc.STRICT_CLINICAL))
            code = r["icd_code"] or ""
            if None in (r["disease"], r["meat_tier"], r["disease_status"], r["sources"]) or not good:
                continue
            if re.search(kc.CANCER, r["disease"]) and not visit and not code.startswith("Z85"):
                continue
            if r["meat_tier"] in kc.EXCLUDED_TIERS or r["disease_status"] == "History Only" or (s and s <= set(kc.RESTRICTED_SECTIONS)):
                continue
            if code in ("", "—", "-") or r["disease"].startswith("stable") or not any((r[t] or "").strip() for t in TEXTS):
                continue
            kept.append((doc, r["ord"], "COPD" if r["disease"] == "COPD stable" else r["disease"], False))
        if not kept:
            for r in mine:
                s = of(r)
                if (None not in (r["meat_tier"], r["disease_status"], r["sources"]) and s & set(kc.GRACE_SECTIONS) and r["meat_tier"] not in kc.EXCLUDED_TIERS
                        and r["disease_status"] != "History Only" and not s <= set(kc.FAMILY_SECTIONS)):
                    kept.append((doc, r["ord"], r["disease"], True))
        out += kept
    return sorted(out, key=str)


@pytest.mark.parametrize("single", [True, False])
def test_against_a_walk(spark, single):
    rng = random.Random(8)
    rows = []
    for doc in range(150):
        for o in range(rng.randint(1, 4)):
            r = {"doc_id": doc, "ord": o, "disease": rng.choice(NAMES), "icd_code": rng.choice(["M10.9", "Z85.3", "", "—", "-", None, "E66.9"]),
                 "sources": rng.choice([None, [], *[rng.sample(SECTIONS, rng.randint(1, 3)) for _ in range(8)]]),
                 "meat_tier": rng.choice(["strong_evidence", "weak_evidence", "invalid", None]), "disease_status": rng.choice(["Chronic", "Active Acute", "History Only", None]),
                 "treatment": rng.choice([True, False, False])}
            r.update({t: rng.choice(["", " ", None, "seen"]) for t in TEXTS[:3]} | {"treatment_evidence": rng.choice(["", "", "on drug"])})
            rows.append(r)
    schema = "doc_id int, ord int, disease string, icd_code string, sources array<string>, meat_tier string, disease_status string, treatment boolean, " + ", ".join(f"{t} string" for t in TEXTS)
    df = spark.createDataFrame(rows, schema)
    got = rs.strict_output_filter(df, single).select("doc_id", "ord", "disease", "grace")
    want = walk(rows, single)
    assert sorted(map(tuple, got.collect()), key=str) == want and {w[3] for w in want} == {True, False}
    assert rs.strict_output_filter(df.where("false"), single).count() == 0
