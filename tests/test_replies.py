"""Assessment patch and replies to results against plain loops."""
import random
import re

from notecoder.knowledge.sections import ASSESSMENT_KEYS
from notecoder.operators import assessment as asm
from notecoder.operators import replies as rp

PIECES = ["Major depression/moderate/recurrent", "anxiety", "CKD/stage 3", "Left knee pain", "b12 deficiency/don't know", "Ab", "flu/x", "depression/mild", "Major depression/severe"]
NAMES = ["Depression", "major depression", "Anxiety disorder", "knee", "CKD", "Gout", "flu", "stage 3 ulcer", "B12 deficiency", "Depression/mild form of it that is long", " anxiety ", "recurrent"]


def patch(rows, sections):
    out = []
    for doc, x, name, sources in rows:
        texts = [t for s, t in sections.get(doc, []) if s in ASSESSMENT_KEYS and t.strip()]
        body, parts, longer = "".join(" " + t.lower() for t in texts), set(), {}
        for t in texts:
            for m in re.finditer(r"\d+\.\s*([A-Za-z][^:\n]+?)(?:\s*:|$)", t):
                for part in re.split(r",\s*", m.group(1).strip().lower()):
                    subs = [s.strip() for s in part.strip().split("/")]
                    parts |= {s for s in subs if len(s) >= 3}
                    if len(subs[0]) >= 3 and len(subs) > 1:
                        longer[subs[0]] = " ".join(subs).title()
        low = name.strip().lower()
        inside = bool(texts) and (low in body or any(f in low or low in f for f in parts if len(f) >= 4))
        if inside:
            if "assessment" not in {s.lower() for s in sources}:
                sources = ["assessment"] + [s for s in sources if s.lower() not in ASSESSMENT_KEYS]
            for short, full in longer.items():
                if (low in short or short in low) and len(full) > len(name.strip()):
                    name = full
                    break
        out.append((doc, x, name, sources, inside))
    return sorted(out)


def test_assessment_words_come_first(spark):
    rng = random.Random(4)
    sections = {}
    for d in range(60):
        body = lambda: "\n".join(f"{k}. {', '.join(rng.sample(PIECES, rng.randint(1, 3)))}" + rng.choice([":", ": stable", " :", ""]) for k in range(rng.randint(0, 4)))
        sections[d] = [(rng.choice(["assessment", "plan", "problem_list", "assessment_and_plan"]), rng.choice([body(), body() + "\n", " ", "seen for anxiety"])) for _ in range(rng.randint(0, 3))]
    rows = [(rng.randint(0, 62), x, rng.choice(NAMES), rng.sample(["Plan", "problem_list", "hpi", "Assessment"], rng.randint(0, 3))) for x in range(500)]
    docs = spark.createDataFrame([(d, s) for d, s in sections.items()] + [(61, None)], "doc_id int, sections array<struct<section string, text string>>")
    out = asm.assessment_patch(spark.createDataFrame(rows, "doc_id int, ord int, disease string, sources array<string>").repartition(3), docs).collect()
    assert sorted((r.doc_id, r.ord, r.disease, r.sources, r.patched) for r in out) == patch(rows, sections)
    assert any(r.disease.endswith("Don'T Know") for r in out)


def test_second_look_and_codes_of_the_dictionary(spark):
    ev = lambda n: ["x"] * n + [""] * (3 - n) + [None]
    rows = [
        (1, 0, "Asthma", "j45909", ["plan"], *ev(2)),  # spelling and description of the dictionary
        (1, 1, "Unknown thing", "Q99.9", ["plan"], *ev(3)),  # not in the dictionary
        (1, 2, "Gout of the foot", None, ["Assessment and Plan"], *ev(0)),  # found by name
        (1, 3, "Gout of the foot", " ", ["hpi"], *ev(1)),  # no second look
        (1, 4, "No such name at all", "", ["assessment"], *ev(1)),  # nothing found
        (1, 5, " ", "J45.909", ["plan"], *ev(1)),
        (2, 7, "Asthma", "J45.909", None, "a", "b", "c", "d"),
    ]
    ddl = "doc_id int, ord int, disease string, icd_code string, sources array<string>, " + ", ".join(f"{c} string" for c in rp.TEXTS)
    codes = spark.createDataFrame([("J45.909", "Asthma, unspecified", "no", 1), ("J45909", "Later twin", "no", 5), ("M10.9", "Gout of the foot", "no", 2)],
                                  "code string, description string, hcc_status string, seq bigint")
    df = spark.createDataFrame(rows, ddl)
    got = [(r.doc_id, r.number, r.disease, r.icd_code, r.icd_description, r.icd_confidence, r.meat_score, r.meat_tier, r.confidence)
           for r in rp.reply_to_results(df, codes).orderBy("doc_id", "number").collect()]
    assert got == [
        (1, 1, "Asthma", "J45.909", "Asthma, unspecified", 0.95, 2, "moderate_evidence", 0.68),
        (1, 2, "Unknown thing", "Q99.9", "", 0.70, 3, "strong_evidence", 0.73),
        (1, 3, "Gout of the foot", "M10.9", "Gout of the foot", 0.95, 0, "no_meat", 0.38),
        (2, 1, "Asthma", "J45.909", "Asthma, unspecified", 0.95, 4, "strong_evidence", 0.98),
    ]
    assert rp.reply_to_results(df.where("false"), codes).count() == 0
