"""Section markers against the sequential way of choosing and inserting them."""
import random

from pyspark.sql import functions as F

from notecoder.operators import markers as mk


def choose(text, headers, content):
    kept = []
    for p, s in headers:
        if not any(abs(p - q) < mk.APART for q, _ in kept):
            kept.append((p, s))
    if len(kept) >= 2:
        ends = [p for p, _ in kept[1:]] + [len(text)]
        kept = [(p, s) for (p, s), e in zip(kept, ends) if e - p >= mk.LEAST_CONTENT or s == "allergies"]
    names = {s for _, s in kept}
    every = [(p, s, False) for p, s in kept] + [(p, s, True) for p, s in content if s not in names]
    if not every:
        return [(0, mk.NARRATIVE, True)], f"\n═══ [SECTION: {mk.NARRATIVE} (inferred)] ═══\n{text}"
    every.sort(key=lambda m: m[0], reverse=True)
    if min(m[0] for m in every) > mk.OPENING_GAP:
        every.append((0, mk.NARRATIVE, True))
        every.sort(key=lambda m: m[0], reverse=True)
    out = text
    for p, s, inferred in every:
        out = out[:p] + f"\n═══ [SECTION: {s}{' (inferred)' if inferred else ''}] ═══\n" + out[p:]
    return sorted(every, key=lambda m: m[0]), out


def test_choice_and_insertion(spark):
    rng = random.Random(12)
    rows = []
    for x in range(300):
        text = "".join(rng.choices("ab\n é", k=rng.choice([0, 5, 60, 300, 900])))
        low = rng.choice([0, 501])
        spots = lambda k: [min(len(text), rng.randint(low, low + rng.choice([30, 400]))) for _ in range(k)]
        headers = sorted({p: rng.choice(["plan", "allergies", "vitals", "imaging"]) for p in spots(rng.randint(0, 8))}.items())
        content = list(zip(spots(3), rng.sample(["plan", "vitals", "medications", "labs"], 3)))[:rng.randint(0, 3)]
        rows.append((x, text, headers, content))
    pair = "array<struct<position int, section string>>"
    df = spark.createDataFrame(rows, f"doc_id int, text string, h {pair}, c {pair}").repartition(3)
    as_markers = lambda c, inferred: F.transform(c, lambda m: F.struct(m["position"], m["section"], F.lit(inferred).alias("inferred"))).cast(f"array<{mk.MARKER}>")
    df = df.withColumn("m", mk.completed(mk.with_content(mk.spaced(as_markers("h", False)), F.length("text")), as_markers("c", True)))
    for r in df.withColumn("out", mk.inserted(F.col("text"), F.col("m"))).collect():
        markers, out = choose(r.text, [tuple(p) for p in r.h], [tuple(p) for p in r.c])
        assert r.out == out and sorted(map(tuple, r.m)) == sorted(markers), r.doc_id


def test_markers_of_a_note(spark):
    note = "Chief Complaint:\ncough for two weeks and a fever since monday\nAssessment:\n1. Asthma, to be seen again in the clinic\nBP 120/80, HR 72 today"
    rows = [(1, note), (2, "nothing to mark"), (3, None)]
    out = {r.doc_id: r for r in mk.with_markers(spark.createDataFrame(rows, "doc_id int, text string")).collect()}
    assert [(m.section, m.inferred) for m in out[1].markers] == [("chief_complaint", False), ("assessment", False), ("vitals", True)]
    assert all(out[1].marked.count(f"[SECTION: {m.section}") == 1 for m in out[1].markers) and out[1].marked.replace("\n", "").startswith("═══")
    assert out[2].marked == f"\n═══ [SECTION: {mk.NARRATIVE} (inferred)] ═══\nnothing to mark" and out[3].marked.endswith("═══\n")
