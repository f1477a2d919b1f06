"""Header candidates: matches that cross lines, and lines that repeat."""
from pyspark.sql import functions as F

from notecoder.operators import headers as hd
from notecoder.operators import sections as se


def test_matches_across_lines():
    found = lambda text: [(c[0], c[1], hd.KINDS[c[2]], c[4]) for c in hd.candidates(text)]
    assert found("PLAN\n\n\nok") == [(0, "PLAN", "allcaps", None)]
    assert found("Plan of\ncare\n:\n stop x") == [(0, "Plan of\ncare", "colon_inline", "stop x"), (8, "care", "standalone_lower", None), (15, "stop x", "standalone_lower", None)]
    assert found("1.\n Some plan\n[a b]; [c d]") == [(0, "Some plan", "numbered", None), (3, "Some plan", "standalone", None), (14, "a b", "bracketed", None), (21, "c d", "bracketed", None)]
    # the letters before a date's semicolon, over a line's end; an earlier semicolon has no date
    assert found("x; Social Hx\n ;\n05/22/24 10:30 AM\n)")[0] == (3, "Social Hx", "ehr_timestamp", None)
    assert found("") == found("\n") == found("\n\n; 1/1/2024") == []


def test_a_line_is_searched_once_however_often_it_repeats(spark):
    hd._known_line.cache_clear()
    text = "Plan:\nno change since the last visit\n\n"
    for _ in range(50):
        hd.candidates(text * 20)
    assert hd._known_line.cache_info().misses == 3
    docs = spark.createDataFrame([(1, text * 2), (2, None), (3, "")], "doc_id long, text string")
    got = {r.doc_id: r.candidates for r in se.with_candidates(docs).collect()}
    assert [(c.position, c.header, c.pattern_type, c.base_score, c.confidence, c.stop) for c in got[1] if c.pattern_type == "colon_block"] == [
        (0, "Plan", "colon_block", 0.85, 1.0, 5), (38, "Plan", "colon_block", 0.85, 1.0, 43)]
    assert got[2] is None and got[3] == []
    # one pass in the worker, no search by expressions
    plan = se.with_candidates(docs).where(F.size("candidates") > 0)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("candidates_of(") >= 1 and "regexp" not in plan


def test_a_header_is_judged_once_and_as_by_expressions(spark):
    known = ["Plan", "Past Med Hx", "History of Present Ilness", "Asessment and Plan", "Allergies:", "[Labs]", "Diagnosis Date", "Medications list of home", "Mood", "", "x y", "Famly Historry", "PMH (old)"]
    rows = spark.createDataFrame([(h,) for h in known], "h string").select("h", se.validate_header(F.col("h")).alias("v")).collect()
    assert {r.h: tuple(r.v) for r in rows} == {h: se._validated(h, False) for h in known}
    docs = spark.createDataFrame([(1, "Plan:\nrest\n\nAllergies:\nnone\n"), (2, None), (3, "")], "doc_id long, text string")
    for method in ("levenshtein", "ratio"):
        got = {r.doc_id: r.headers for r in se.with_headers(docs, method).collect()}
        assert [(h.position, h.section) for h in got[1]] == [(0, "plan"), (12, "allergies")] and got[2] is None and got[3] == []
    assert "levenshtein(" not in se.with_headers(docs)._jdf.queryExecution().optimizedPlan().toString().replace("kinds_by_levenshtein(", "")


def test_enriched_sections_merge_slices_once(spark):
    from notecoder.operators import lines as ln

    docs = spark.createDataFrame([(1, "Plan:\nrest and fluids\n")], "doc_id long, text string")
    plan = ln.with_enriched(docs)._jdf.queryExecution().optimizedPlan().toString()
    # the merging fold and the inferred sections are fields of one bound struct, not part of the functions over its sections
    assert plan.count("struct(merged, aggregate(") == 1 and "aggregate(inferred#" not in plan
    assert [(s.section, s.text, s.source) for s in ln.with_enriched(docs).first().sections][0] == ("plan", "rest and fluids", "header")
