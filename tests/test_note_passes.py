"""Steps done in one pass over a note, held against the column expressions they stand for."""
import random

from pyspark.sql import functions as F

from notecoder.functions import text as tx
from notecoder.functions.arrays import let
from notecoder.operators import blocks as bk
from notecoder.operators import context as cx
from notecoder.operators import evidence as me
from notecoder.operators import gather as ga
from notecoder.operators import results as rs
from notecoder.operators import sections as se
from notecoder.operators import status as st
from notecoder.operators.rules import ELEMENTS

LINES = ["PMH:", "Assessment and Plan:", "[Plan]", "Medications: metformin 500 mg", "MEDICATIONS", "  1. Asthma: stable, continue albuterol  ", "", "...", " - ", " BP 120/80 ", "\t", "HTN", "a",
         "Diabetes, A1c 8.1 today", "denies chest pain. No wheeze", "Plan", "x" * 130 + " monitor asthma", "recheck labs in 3 months", "acute asthma flare, refer", "Allergies:"]


def texts(seed, n=120):
    rng = random.Random(seed)
    return ["\n".join(rng.choice(LINES) for _ in range(rng.randint(0, 14))) for _ in range(n)] + [None, "", "\n", "Plan:"]


def test_sections_in_one_pass_equal_the_expressions(spark):
    df = spark.createDataFrame(list(enumerate(texts(1))), "doc_id int, text string").repartition(3)
    for method in ("levenshtein", "ratio"):
        want = {r.doc_id: r.w for r in se.with_slices(se.with_headers(df, method)).select("doc_id", se.merge_slices(F.col("slices")).alias("w")).collect()}
        plan = se.with_sections(df, method)
        assert "aggregate(" not in plan._jdf.queryExecution().optimizedPlan().toString()
        got = {r.doc_id: r.sections for r in plan.collect()}
        assert got == want and any(got.values())
    bodies = spark.createDataFrame([(t,) for t in texts(2) if t is not None], "t string")
    assert all(se.cleaned(r.t) == r.c for r in bodies.select("t", se.clean_content(F.col("t")).alias("c")).collect())


def test_evidence_of_a_note_equals_the_expressions(spark):
    rng = random.Random(4)
    names = ["Asthma", "diabetes", "HTN", "Type 2 Diabetes Mellitus", "chest pain with exertion", "Gout", "", "wheeze"]
    rows = []
    for i, t in enumerate(texts(3)):
        own = [(rng.choice(["assessment", "plan", "past_medical_history", "hpi"]), x) for x in (t or "").split("\n\n")]
        said = [s.strip() for s in (t or "").replace(". ", ".\x00").split("\x00") if s.strip()]
        named = [(rng.choice(names), [rng.choice(["assessment", "Past_Medical_History", "past_medical_history", "hpi"])], 0.5) for _ in range(rng.randint(0, 4))]
        rows.append((i, own, said, named if i % 17 else None))
    ddl = "doc_id int, sections array<struct<section string, text string>>, sents array<string>, mentions array<struct<disease string, sources array<string>, confidence double>>"
    df = spark.createDataFrame(rows, ddl).repartition(3)

    def old(doc, m):
        own = F.flatten(F.transform(F.filter(doc["sections"], lambda s: F.array_contains(m["sources"], s["section"])), lambda s: s["lines"]))
        c = let(own, lambda o: cx.build_profiled(doc["sents"], o, m["disease"], 5))
        found = let(c, lambda x: F.struct(me.detect_profiled(x["lines"], F.lower(m["disease"])).alias("e"), x["drugs"], x["text"]))
        return let(found, lambda f: F.struct(*[f["e"][e][x].alias(f"{e}_{x}") for e in ELEMENTS for x in ("evidence", "confidence")],
                                             rs.status_of(m["sources"], f["text"], f["drugs"]).alias("disease_status")))

    whole = F.struct(cx.section_profiles(F.col("sections"), me.line_profiles).alias("sections"), cx.sentence_profiles(F.col("sents"), me.line_profiles).alias("sents"), "mentions")
    want = let(whole, lambda doc: F.transform(doc["mentions"], lambda m: old(doc, m)))
    out = df.select("doc_id", ga.evidence_of(F.col("sections"), F.col("sents"), F.col("mentions"), 5).alias("a"), want.alias("b")).collect()
    assert len(out) == len(rows) and all(r.a == r.b for r in out) and any(x.treatment_evidence for r in out for x in r.a or [])


def test_status_words_are_looked_for_before_their_patterns(spark):
    docs = spark.createDataFrame([(1, "on Warfarin; insulinoma, atrial fibrillation", "warfarin 5 mg\nLantus", ), (2, None, "Xwarfarin"), (3, "CABG", None)], "doc_id int, assessment string, medications string")
    plan = st.long_term_drugs(docs)._jdf.queryExecution().optimizedPlan().toString()
    assert "Contains(" in plan or "contains(" in plan
    assert sorted((r.doc_id, r["class"], r.drug, r.included) for r in st.long_term_drugs(docs).collect()) == [
        (1, "anticoagulants", "warfarin", True), (1, "insulin", "Lantus", False)]


def test_given_headers_are_located_in_one_pass(spark):
    docs = spark.createDataFrame([(1, "Plan:\nsee plan\nSocial Hx", ["plan", "Social History", None, " "]), (2, None, ["Plan"]), (3, "x Plan", ["Social History", "[plan]:"])],
                                 "doc_id int, text string, headers array<string>")
    out = bk.locate_headers(docs)
    assert "aggregate(" not in out._jdf.queryExecution().optimizedPlan().toString()
    assert sorted((r.doc_id, r.ord, r.header, r.position, r.tier) for r in out.collect()) == [
        (1, 0, "plan", 10, "exact"), (1, 1, "Social History", 15, "fuzzy"), (3, 1, "[plan]:", 0, "fuzzy")]
    # a search that ended behind the text finds nothing more
    assert bk.located("Plan", ["Planned", "Plan"], 0.75) == [(0, "Planned", 0, "fuzzy")]
