"""Sections by content against a plain walk over the lines."""
import random
import re

import pytest
from pyspark.sql import functions as F

from notecoder.functions.skew import absorbed, islands
from notecoder.knowledge.lines import LINE_PATTERNS, OTHER
from notecoder.operators import lines as ln

COMPILED = [(s, w, re.compile(p)) for s, w, p in LINE_PATTERNS]


def classify(line):
    best = (OTHER, 0.0)
    for section, weight, pattern in COMPILED:
        if pattern.search(line) and weight > best[1]:
            best = (section, weight)
    return best


def walk_islands(labels):
    out = []
    for x, label in enumerate(labels):
        if out and out[-1][0] == label:
            out[-1][1].append(x)
        else:
            out.append([label, [x]])
    return out


def absorb(runs):
    """Passes over the islands until none changes, then neighbours of one class are joined."""
    runs = [[s, list(xs), set()] for s, xs in runs]
    changed = True
    while changed:
        changed, new = False, []
        for i, r in enumerate(runs):
            if 0 < i < len(runs) - 1 and r[0] == OTHER and runs[i - 1][0] == runs[i + 1][0] not in (OTHER, None):
                new[-1] = [new[-1][0], new[-1][1] + r[1], new[-1][2] | set(r[1])]
                changed = True
            else:
                new.append(r)
        runs = new
    out = []
    for s, xs, gone in runs:
        if out and out[-1][0] == s:
            out[-1] = [s, out[-1][1] + xs, out[-1][2] | gone]
        else:
            out.append([s, xs, gone])
    return out


LINES = ["amlodipine 5 mg tablet", "lisinopril 10 mg po daily", "BP 120/80, HR 72", "never smoker", "Glucose: 110", "plain words here", "", "  ", "nothing known", "NKDA",
         "Refills: 3", "denies chest pain", "wt 80 kg", "mother with diabetes", "Take 1 tablet by mouth", "Penicillin - rash"]


def expected(text):
    lines = (text or "").split("\n")
    marks = [(i, *classify(x.strip())) for i, x in enumerate(lines) if x.strip()]
    first = walk_islands([m[1] for m in marks])
    islands_ = []
    for s, xs in first:
        a, b = marks[xs[0]][0], marks[xs[-1]][0]
        islands_.append((s, a, b, round(sum(marks[x][2] for x in xs) / len(xs), 9), lines[a:b + 1]))
    merged = []
    for s, ks, gone in absorb([(s, [k]) for k, (s, *_) in enumerate(islands_)]):
        own = [islands_[k] for k in ks]
        merged.append((s, own[0][1], own[-1][2], max(islands_[k][3] for k in ks if k not in gone), sum((o[4] for o in own), [])))
    sections = {}
    for s, _, _, _, body in merged:
        content = "\n".join(body).strip()
        if s == OTHER or len(content) < 10:
            continue
        start = max(text.find(body[0].strip()), 0)
        if s not in sections:
            sections[s] = [content, start, start + len(content)]
        elif content not in sections[s][0]:
            sections[s][0] += "\n\n" + content
            sections[s][2] = max(sections[s][2], start + len(content))
    return islands_, merged, [(s, *v) for s, v in sections.items()]


def test_islands_and_sections(spark):
    rng = random.Random(2)
    rows = [(x, "\n".join(rng.choice(LINES) + rng.choice(["", " "]) for _ in range(rng.randint(0, 25)))) for x in range(150)]
    rows += [(200, None), (201, ""), (202, "\n\n"), (203, "\n".join(["BP 120/80", "x", "BP 120/81", "y", "BP 120/82", "never smoker", "z"])), (204, "\n".join(LINES * 60))]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = {}
    for name, fn in (("i", ln.cluster_lines), ("m", ln.inherit_context)):
        for r in fn(df).collect():
            got.setdefault((name, r.doc_id), []).append((r.section, r.start_line, r.end_line, round(r.confidence, 9), r.lines))
    for r in ln.build_sections(df).collect():
        got.setdefault(("s", r.doc_id), []).append((r.section, r.text, r.start, r.end))
    for i, t in rows:
        for name, want in zip("ims", expected(t)):
            assert got.get((name, i), []) == want, (name, i)


def test_classes_of_lines(spark):
    lines = LINES + ["Hemoglobin: 13.5 (12.0 - 16.0) g/dL", "x-ray of the chest", "flu vaccine", "I10 - Essential", "1. Asthma stable", "follow up in 6 weeks", "HEENT: normal",
                     "patient presents with cough", "pt is a 45 year old male", "appendectomy 1999", "continue current medication", "T 98.6", "10 point ROS", "Qty: 90", "ÉTÉ 5 mg"]
    rows = [(x, t) for x, t in enumerate(lines)]
    got = {r.doc_id: (r.section, r.confidence) for r in ln.line_classifier(spark.createDataFrame(rows, "doc_id int, text string")).collect()}
    assert got == {i: classify(t.strip()) for i, t in rows if t.strip()}


def test_header_sections_come_first(spark):
    spans = [("a", 0, 10), ("b", 30, 40)]
    extra = [("b", 90, 95), ("c", 10, 20), ("d", 9, 11), ("e", 15, 25), ("f", 20, 30), ("g", 31, 35), ("h", 40, 41)]
    arr = lambda v: F.array(*[F.struct(F.lit(s).alias("section"), F.lit(b).alias("start"), F.lit(e).alias("end")) for s, b, e in v])
    row = spark.range(1).select(ln.clear_of(arr(spans), arr(extra)).alias("x"), ln.clear_of(F.filter(arr(spans), lambda s: F.lit(False)), arr(extra)).alias("y")).first()
    # adjoining intervals don't overlap; one that is taken keeps a later one out
    assert [e.section for e in row.x] == ["c", "f", "h"]
    assert [e.section for e in row.y] == ["b", "c", "f", "g", "h"]
    text = "Vitals:\nweight and pulse were taken\nMedications:\nnone at present time\nmother with asthma and more\nNKDA and nothing else"
    out = {r.section: r for r in ln.enrich_sections(spark.createDataFrame([(1, text), (2, None)], "doc_id int, text string")).collect()}
    assert out["medications"].source == "header" and all(r.end > r.start for r in out.values())


@pytest.mark.parametrize("seed", [1, 2])
def test_runs_of_rows(spark, seed):
    rng = random.Random(seed)
    users = [0] * 400 + [rng.randint(1, 4) for _ in range(200)] + [None] * 20  # one user with most rows
    rows = [(u, x, rng.choice(["a", "a", "b", OTHER, None])) for x, u in enumerate(users)]
    df = spark.createDataFrame(rows, "u int, x int, label string").repartition(5)
    numbered = islands(df, ["u"], [F.col("x")], "label", "k").where("u is not null").collect()
    want = {}
    for u in {r[0] for r in rows if r[0] is not None}:
        own = [r for r in rows if r[0] == u]
        for k, (label, xs) in enumerate(walk_islands([r[2] for r in own])):
            want.update({(u, own[x][1]): (k, label) for x in xs})
    assert {(r.u, r.x): (r.k, r.label) for r in numbered} == want
    per = spark.createDataFrame(sorted({(u, k, label) for (u, _), (k, label) in want.items()}, key=str), "u int, k long, label string")
    got = {(r.u, r.k): (r._run, r.label, r._absorbed) for r in absorbed(per, ["u"], "label", OTHER, "k").collect()}
    for u in {u for u, _ in want}:
        own = dict(sorted({k: label for (v, _), (k, label) in want.items() if v == u}.items()))
        for run, (label, ks, gone) in enumerate(absorb([(label, [k]) for k, label in own.items()])):
            assert all(got[u, k] == (run, label, k in gone) for k in ks)
