"""Steps that must stay cheap where notes are many: what the plans hold, and shared work done once."""
import random
import re

import pyarrow as pa
from pyspark.sql import functions as F

from notecoder import catalog
from notecoder.functions import text as tx
from notecoder.functions.arrays import matches
from notecoder.knowledge import sections as ks
from notecoder.operators import blocks as bk
from notecoder.operators import lines as ln
from notecoder.operators import sections as se

SF = "/root/testdata/sf0.001"


def test_texts_meet_rows_without_broadcast(spark):
    queries = catalog.load().QUERIES
    for name in ("drop_unsupported", "evidence_in_document", "evidence_verify"):
        plan = queries[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
        assert not re.search(r"BroadcastHashJoin \[doc_id#\d+L\], ", plan), name


def test_equal_lines_are_judged_once(spark):
    docs = spark.range(0, 3000, 1, 1).selectExpr("id as doc_id", "concat('Metformin 500 mg daily\n \nBP 120/80\nBP 120/80\n', repeat('x', 300)) as text")
    rows = ln.line_classifier(docs).groupBy("line", "section").count().collect()
    assert {(r.line, r.section): r["count"] for r in rows} == {(0, "medications"): 3000, (2, "vitals"): 3000, (3, "vitals"): 3000, (4, "other"): 3000}
    batch = pa.array([["BP 120/80", " ", "é BP 120/80"], ["BP 120/80"], []])
    ln.repeated_pattern_of.cache_clear()
    assert ln.patterns_of.func(batch.slice(1)).to_pylist() == ln.patterns_of.func(batch).to_pylist()[1:]
    info = ln.repeated_pattern_of.cache_info()
    assert info.misses == 3


def test_matches_search_a_text_once(spark):
    texts = ["a1b22", "x1\ue0002y34\ue0015", "", "no digits", None, "é1\n2", "1x2", "1", "  12 3"]
    df = spark.createDataFrame([(t,) for t in texts], "t string").repartition(1)
    for group, needs in ((0, None), (1, None), (1, "2")):
        got = {r.t: r.m for r in df.select("t", matches(F.col("t"), "([0-9])[0-9]?", group, needs).alias("m")).collect()}
        for t in texts:
            want = [(m.start(), m.end(), m[group], m[0]) for m in re.finditer("([0-9])[0-9]?", t)] if t is not None and (needs or "") in t else []
            assert (t is None and got[t] is None) or [tuple(x) for x in got[t]] == want, (t, group, needs)
    plan = df.select(matches(F.col("t"), "([0-9])[0-9]?").alias("m"))._jdf.queryExecution().optimizedPlan().toString()
    assert "regexp_replace" in plan


def test_headers_without_anything_to_clean(spark):
    raw = [" Plan ", "HPI ; 05/22/2024 10:30 AM)", "Labs as of 5/5", "Meds (2)", "Notes 1/2/2024", "Summary - Page 3", "Plan:;", "Was As ", "pages", "", "Basic"]
    got = [r[0] for r in spark.createDataFrame([(x,) for x in raw], "x string").repartition(1).select(se.clean_header(F.col("x")).alias("y"), "x").collect()]
    assert sorted(got) == sorted(["Plan", "HPI", "Labs", "Meds", "Notes", "Summary", "Plan", "Was As", "pages", "", "Basic"])


def test_equal_lines_are_held_against_families_once():
    batch = pa.array([["BP 120/80", "Metformin 500 mg", "é"], ["BP 120/80"], []])
    bk.repeated_families_of.cache_clear()
    assert bk.line_families.func(batch.slice(1)).to_pylist() == bk.line_families.func(batch).to_pylist()[1:]
    assert bk.repeated_families_of.cache_info().misses == 3
    names = [f[0] for f in bk.BLOCK_FAMILIES]
    assert bk.line_families.func(batch).to_pylist() == [[1 << names.index("vitals"), 1 << names.index("medications"), 0], [1 << names.index("vitals")], []]


def test_variants_out_of_reach_are_passed_over(spark):
    rng = random.Random(3)
    variants = [v for _, v, _ in ks.VARIANT_ROWS]
    headers = {"", "x", "zzz plan", *variants}
    for v in variants * 4:  # misspelled, longer and shorter ones
        x = rng.randrange(len(v))
        headers |= {v[:x] + rng.choice("abc e") + v[x + 1:], v[:x] + v[x + 1:], v + " " + rng.choice(variants), v[: x + 1]}
    df = spark.createDataFrame([(h,) for h in sorted(headers)], "h string").repartition(4)
    for least in (0.62, 0.78, 0.88):
        norm = tx.normalize_header(F.col("h"))
        full, quick = se.match_canonical(norm, F.lit(least)), se.match_canonical(norm, F.lit(least), low_scores=False)
        rows = df.select("h", full.alias("a"), quick.alias("b")).collect()
        assert len(rows) == len(headers) and not [r for r in rows if r.a.section != r.b.section]
        assert not [r for r in rows if r.a.score >= least and r.a.score != r.b.score]
    assert "arrays_overlap" in df.select(se.validate_header(F.col("h")))._jdf.queryExecution().optimizedPlan().toString()


def test_documented_names_meet_texts_without_broadcast(spark):
    plan = catalog.load().QUERIES["rule_documented_only"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "BroadcastHashJoin" not in plan


def test_headers_are_named_in_one_pass_without_broadcast(spark):
    rng = random.Random(5)
    variants = [v for _, v, _ in ks.VARIANT_ROWS]
    headers = ["", " ", "x", "[Plan]:", "PMH:", "The Plan", "zzz plan", None, *variants]
    for v in variants * 3:
        x = rng.randrange(len(v))
        headers += [v[:x] + rng.choice("abc e") + v[x + 1:], v[:x] + v[x + 1:], v + " " + rng.choice(variants), v[: x + 1].title() + ":"]
    df = spark.createDataFrame([(h,) for h in headers], "h string").repartition(4)
    for least in (0.62, 0.88):
        want = se.match_canonical(tx.normalize_header(F.col("h")), F.lit(least))
        for r in df.select("h", F.get(se.names_of(F.array("h"), least), F.lit(0)).alias("a"), want.alias("b"), se.header_key(F.col("h")).alias("k")).collect():
            assert (r.a is None) == (r.h is None), r
            assert r.a is None or (r.a.key == r.k and r.a.section == r.b.section), r
            assert r.a is None or r.a.section is None or r.a.score == r.b.score, r
    plan = catalog.load().QUERIES["section_name_fix"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and plan.count("candidates_of(") == 1
