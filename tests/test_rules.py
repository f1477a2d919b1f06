"""Order-dependent merges and skew-safe ranks against plain loops."""
import random

from pyspark.sql import functions as F

from notecoder.functions.skew import running
from notecoder.knowledge import abbreviations as ab
from notecoder.operators import mentions as mn
from notecoder.operators import results as rs
from notecoder.operators import rules as ru

NAMES = ["HTN", "Hypertension", "Essential hypertension", "CKD 3", "CKD", "GERD", "Gastroesophageal reflux disease", "Asthma", "UTI", "Urinary tract infection"]


def rows(seed, docs=40):
    rnd = random.Random(seed)
    out = []
    for d in range(docs):
        for i, n in enumerate(rnd.sample(NAMES, rnd.randint(1, 8))):
            out.append((d, i, n, rnd.choice(["", "I10", "N39.0"]), [rnd.choice(["assessment", "plan"])], rnd.random(), rnd.choice(["strong_evidence", "weak_evidence"]), False))
    return out


SCHEMA = "doc_id long, ord long, disease string, icd_code string, sources array<string>, confidence double, meat_tier string, negated boolean"


def test_abbreviation_merge_is_an_ordered_fold(spark):
    data = rows(1)
    got = {}
    for r in ru.merge_abbreviations(spark.createDataFrame(data, SCHEMA)).collect():
        got.setdefault(r.doc_id, []).append((r.ord, r.disease))
    for d in {r[0] for r in data}:
        groups = []
        for _, o, n, *_ in (r for r in data if r[0] == d):
            low = n.lower()
            keys = {low} | {x for x in (ab.LOWER_TO_EXPANSION.get(low), ab.EXPANSION_TO_LOWER.get(low)) if x}
            hit = next((g for g in groups if g["k"] & keys), None)
            if hit is None:
                groups.append({"o": o, "n": n, "k": keys})
            else:
                hit["n"] = n if len(n) > len(hit["n"]) else hit["n"]
                hit["k"] |= keys
        assert sorted(got[d]) == [(g["o"], g["n"]) for g in groups]


def test_cross_section_dedup_merges_by_containment(spark):
    data = [(1, 0, "Hypertension", "", ["assessment"], 0.7, "", False), (1, 1, "2. Essential hypertension", "", ["plan"], 0.9, "", False),
            (1, 2, "Asthma", "", ["plan"], 0.5, "", False), (1, 3, "Gout", "", ["plan"], 0.5, "", True)]
    out = {r.norm: r for r in mn.cross_section_dedup(spark.createDataFrame(data, SCHEMA)).collect()}
    assert set(out) == {"essential hypertension", "asthma"}
    r = out["essential hypertension"]
    assert (r.disease, r.confidence, r.sources) == ("Essential hypertension", 0.9, ["assessment", "plan"])


def test_running_rank_of_a_hot_key(spark):
    rnd = random.Random(3)
    data = [("hot" if i % 3 else f"k{i}", rnd.random(), i) for i in range(3000)]
    df = spark.createDataFrame(data, "k string, v double, i long").repartition(7)
    got = running(df, ["k"], [F.col("v"), F.col("i")], {"s": F.col("i")}, row_number="n").where("k = 'hot'").orderBy("n").collect()
    want = sorted((r for r in data if r[0] == "hot"), key=lambda r: (r[1], r[2]))
    total = 0
    for n, (w, r) in enumerate(zip(want, got), 1):
        total += w[2]
        assert (r.i, r.n, r.s) == (w[2], n, total)


def test_rules_reconcile(spark):
    df = spark.createDataFrame(rows(5), SCHEMA)
    for e in ru.ELEMENTS:
        df = df.withColumn(f"{e}_evidence", F.lit("possible, rule out")).withColumn(e, F.lit(True))
    kept, audit = ru.apply_rules(df, tuple(ru.REMOVERS))
    assert kept.count() + audit.count() == df.count()
    one = rs.dedup_by_code(df)
    assert one.where("icd_code <> ''").groupBy("doc_id", "icd_code").count().where("count > 1").count() == 0
