"""Coverage of the assessment, and verification of stated diseases, against plain loops."""
import random
import re
from difflib import SequenceMatcher

from pyspark.sql import functions as F

from notecoder.functions import text as tx
from notecoder.knowledge import coverage as kc
from notecoder.operators import coverage as cv


def items(text):
    m = re.compile(kc.BLOCK_START).search(text)
    if not m:
        return []
    end = re.compile(kc.BLOCK_END).search(text, m.end())
    block = text[m.end():end.start() if end else len(text)]
    found = re.findall(kc.LIST_ITEM, block)
    if not found:
        first = lambda x: x.split()[0].lower().rstrip(",:;")
        found = [x for x in re.findall(kc.PLAIN_ITEM, block) if first(x) not in kc.SENTENCE_STARTS and len(first(x)) >= 3]
    out = []
    for x, raw in enumerate(found):
        item = raw.strip().rstrip(":")
        low = item.lower().strip()
        phrase = low in tx.WORKFLOW_PHRASES or (len(low.split()) <= 4 and any(low.endswith(e) for e in tx.WORKFLOW_ENDINGS))
        acted = re.search(kc.ACTION, item)
        if (5 <= len(item) <= 120 and item.split()[0].lower() not in kc.SKIP_STARTS and not phrase and not re.search(kc.NOT_DISEASE, item) and not re.search(kc.STABLE_ONLY, raw)
                and not (re.search(kc.ORDER_ONLY, item) and not acted) and not (re.search(kc.INCIDENTAL, item) and not acted)):
            out.append((x, item))
    return out


LINES = ["1. Asthma", "2) Chronic kidney disease stage 3: recheck", "- Hypertension, stable", "* Follow up with me", "• Allergy profile IgE; Future", "3. Old finding of degenerative disc", "CBC today",
         "Migraine without aura", "The patient was seen", "5. Flu vaccine", "7. Gout:", "Degenerative joint disease, monitor", "-Anemia of chronic disease", "ok", "", "8. Tiny", "9. Influenza immunized " + "x" * 120]


def test_items_of_the_assessment(spark):
    rng = random.Random(3)
    heads = ["Assessment:\n", "ASSESSMENT AND PLAN\n", "A/P:", "Assessment & Plan:\n", "[Assessment]\n", "Impression:\n"]
    ends = ["\nMedications: none\nmore", "\nFollow up soon\n1. Gout late", "\nsigned\n", ""]
    rows = [(x, "History\n1. Before\n" + rng.choice(heads) + "\n".join(rng.choice(LINES) for _ in range(rng.randint(0, 9))) + rng.choice(ends)) for x in range(200)]
    rows += [(900, None), (901, ""), (902, "assessment:"), (903, "Assessment:\n" + "1. Asthma\n" * 2000)]
    got = {}
    for r in cv.missable_items(spark.createDataFrame(rows, "doc_id int, text string").repartition(3)).collect():
        got.setdefault(r.doc_id, []).append((r.pos, r.disease))
    assert all(got.get(i, []) == items(t or "") for i, t in rows)


def test_coverage_leaves_what_no_name_or_code_has(spark):
    note = "Assessment:\n1. CKD 3\n2. Pressure injury of right buttock\n3. Gout of the foot\n4. Gout of the foot\n5. Rare syndrome\n6. Asthma attack\n"
    docs = spark.createDataFrame([(1, note), (2, note), (3, None)], "doc_id int, text string")
    kept = spark.createDataFrame([(1, "chronic kidney disease stage 3", "N18.3"), (1, "Pressure injury of skin of right buttock stage 3", ""), (1, "", None), (1, None, "J45.9")],
                                 "doc_id int, disease string, icd_code string")
    excluded = spark.createDataFrame([(1, "rare syndrome"), (9, "gout")], "doc_id int, disease string")
    codes = spark.createDataFrame([("M10.9", "Gout of the foot", "no", 1), ("J45.9", "Asthma attack", "no", 2)], "code string, description string, hcc_status string, seq bigint")
    out = [(r.doc_id, r.pos, r.disease, r.icd_code, r.meat_score) for r in cv.assessment_coverage(docs, kept, codes, excluded).orderBy("doc_id", "pos").collect()]
    one = [(1, 2, "Gout of the foot", "M10.9", 1), (1, 3, "Gout of the foot", "M10.9", 1)]  # repeated items stay; asthma's code is there
    assert out[:2] == one and [r[1] for r in out if r[0] == 2] == [0, 1, 2, 3, 4, 5] and len(out) == 8


def longest_run(a, b):
    m = SequenceMatcher(None, a, b, autojunk=False).find_longest_match(0, len(a), 0, len(b))
    return m.size


def test_long_runs_equal_the_longest_match(spark):
    rng = random.Random(5)
    rows = []
    for _ in range(250):
        text = "".join(rng.choices("ab c", k=rng.randint(0, 400)))
        a = rng.randrange(len(text) + 1)
        cut = text[a:a + rng.randint(20, 40)]
        rows.append(("".join(rng.choices("ab", k=rng.randint(0, 20))) + cut + "z" * rng.randint(0, 30), text))
    rows += [("", "x"), ("y" * 30, "y" * 29), ("y" * 30, "y" * 30), ("y" * 80, "")]
    df = spark.createDataFrame(rows, "s string, t string").withColumn("run", cv.has_long_run(F.col("s"), F.col("t")))
    assert all(r.run == (longest_run(r.s, r.t) >= 30) for r in df.collect())


def test_ways_in_which_a_disease_is_found(spark):
    text = ("Patient with hypertension and chronic kidney disease. Left knee pain was examined in the office this morning. "
            "Severe allergic reaction. Acute kidney injury of unknown cause noted.")
    quote = "??? pain was examined in the office this morn and then"
    cases = [
        ("HYPERTENSION", [], "name"), ("HTN", None, "variant"), ("disease chronic kidney the", [], "words"), ("Zzz", ["left knee pain was examined", None], "snippet"),
        ("Zzz", ["", quote], "run"), ("Zzz", [quote[:30]], None), ("type reaction severe allergic gonorrhea stage", [], "significant"), ("Zzz syndrome", [" "], None),
    ]
    rows = [(1, x, n, s) for x, (n, s, _) in enumerate(cases)] + [(2, 50, "hypertension", []), (3, 51, "hypertension", []), (1, 52, " ", []), (1, 53, None, [])]
    df = spark.createDataFrame(rows, "doc_id int, ord int, disease string, snippets array<string>")
    docs = spark.createDataFrame([(1, text), (2, None)], "doc_id int, text string")
    got = {r.ord: (r.found_by, r.reason) for r in cv.mention_verify(df, docs).collect()}
    want = {x: (w, None if w else "HALLUCINATED") for x, (_, _, w) in enumerate(cases)}
    assert got == {**want, 50: (None, "HALLUCINATED"), 51: (None, "HALLUCINATED")}
    assert cv.mention_verify(df.where("false"), docs).count() == 0


def test_fast_sections(spark):
    from notecoder.operators import context as cx

    docs = spark.createDataFrame([(1, ["Asthma is mild.", "Gout and ASTHMA flare.", "Seen."]), (2, None)], "doc_id int, sents array<string>")
    rows = [(1, 2, "asthma", "plan"), (1, 1, "gout", "plan"), (1, 3, "Asthma", None), (1, 4, "measles", "hpi"), (1, 5, None, "hpi"), (2, 1, "gout", "plan"), (3, 1, "gout", "plan")]
    out = cx.fast_sections(spark.createDataFrame(rows, "doc_id int, ord int, disease string, section string"), docs)
    assert sorted(map(tuple, out.collect())) == [
        (1, "hpi", ""), (1, "plan", " Gout and ASTHMA flare. Asthma is mild. Gout and ASTHMA flare."), (1, "unknown", " Asthma is mild. Gout and ASTHMA flare."), (2, "plan", ""), (3, "plan", "")]
