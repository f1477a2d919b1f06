"""Word groups by line, and contexts whose parts are computed once."""
import random

import pyarrow as pa
from pyspark.sql import functions as F

from notecoder import catalog
from notecoder.functions import keywords as kw
from notecoder.functions.arrays import let
from notecoder.operators import context as cx
from notecoder.operators import evidence as me

SF = "/root/testdata/sf0.001"


def test_equal_lines_are_searched_once():
    batch = pa.array([["take mg\nbp 120", "none", None], ["bp 120"], []])
    kw.repeated_groups_of.cache_clear()
    assert kw.search("drugs", batch.slice(1)).to_pylist() == kw.search("drugs", batch).to_pylist()[1:]
    assert kw.repeated_groups_of.cache_info().misses == 3
    assert [bool(b) for b in kw.search("labs", batch).to_pylist()[0]] == [True, False, False] and kw.search("labs", batch).to_pylist()[0][2] is None
    assert kw.text_groups("labs", "x" * kw.SHORT + " bp") & 1
    assert not [w for groups in kw.TABLES.values() for words in groups for w in words if "\n" in w or w != w.lower()]


def test_word_groups_against_plain_search(spark):
    rng = random.Random(5)
    words = [w for t in ("drugs", "labs", "elements") for g in kw.TABLES[t] for w in g]
    texts = ["", "İ insulin", *[rng.choice(["", "x\n", "é "]).join(rng.sample(words, rng.randint(1, 3))) for _ in range(200)]]
    df = spark.createDataFrame([(texts[i::7],) for i in range(7)] + [(None,)], "t array<string>").repartition(3)
    for table in ("drugs", "labs", "elements"):
        for r in df.select("t", kw.word_groups(F.col("t"), table).alias("b")).collect():
            want = [sum(1 << k for k, ws in enumerate(kw.TABLES[table]) if any(w in x for w in ws)) for x in r.t or []]
            assert r.b == want


def test_white_space_at_the_ends(spark):
    texts = ["", " ", "a", " a ", "\n a b \t", "᠎a", "​a ", "\x1ca", "　", "a\u0085"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    rows = df.select(cx.strip(F.col("t")).alias("a"), F.regexp_replace("t", r"(?U)\A\s+|\s+\z", "").alias("b")).collect()
    assert [r.a for r in rows] == [r.b for r in rows]


def test_contexts_and_their_lines(spark):
    text = "Seen for asthma. Uses albuterol.\nBP 120/80 today! Asthma is stable. Continue  albuterol. Nothing else."
    docs = spark.createDataFrame([(1, text, "Asthma"), (2, text, "Gout"), (3, "", "Asthma")], "doc_id int, text string, disease string")
    whole = lambda c: F.struct(*[c[p].alias(p) for p in cx.PARTS], me.evidence_lines(c).alias("lines"))
    out = {r.doc_id: r for r in cx.contexts(docs, cx.PARTS, whole, "doc_id").collect()}
    assert out[1].primary == "Seen for asthma." and out[1].related == ["Asthma is stable."] and out[2].primary == "" and out[2].around == []
    assert out[1].drugs == ["Uses albuterol.", "Continue  albuterol."] and out[2].drugs == ["Continue  albuterol."]
    assert out[1].labs == ["BP 120/80 today!"] and out[3].lines == []
    assert len({x.lower() for x in out[1].lines}) == len(out[1].lines) and "BP 120/80 today!" in out[1].lines
    lined = lambda c: let(me.evidence_lines(c), lambda a: F.struct(a.alias("lines"), F.transform(a, lambda s: F.lower(s)).alias("low")))
    got = {r.doc_id: r for r in me.detected(cx.contexts(docs, cx.PARTS, lined, "doc_id", "disease")).collect()}
    assert (got[1].monitoring.evidence, got[1].monitoring.confidence) == ("Asthma is stable.", 0.7)
    assert got[3].assessment.evidence is None and got[3].assessment.confidence == 0.0


def test_a_context_is_made_once(spark):
    plan = lambda name: catalog.load().QUERIES[name](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    # the window's slice and the split into sentences stand in the plan as often as they run
    assert [plan(n).count("slice(") for n in ("context_window", "medication_mentions")] == [1, 0]
    assert plan("evidence_lines").count("slice(") == plan("assessment_detect").count("slice(") == 3
    assert plan("assessment_detect").count("(?<=[.!?])") == 1 and "(?<=[.!?])" not in plan("section_context")
    assert "ArrowEvalPython" not in plan("related_mentions")
