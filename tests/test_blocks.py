"""Blocks of a family and headers found again, against plain loops."""
import random
import re

from pyspark.sql import functions as F

from notecoder.functions.skew import islands
from notecoder.knowledge.blocks import BLOCK_FAMILIES, HEADER_SHORT_FORMS
from notecoder.knowledge.sections import HEADER_STOP_WORDS, STEM_ENDINGS, STEM_SUFFIXES
from notecoder.operators import blocks as bk

LINES = ["lisinopril 10 mg daily", "metformin 500 mg", "", "plain", "BP 120/80", "1. Asthma", "2. Cough and fever", "HEENT: normal", "Lungs: clear", "NKDA", "denies pain",
         "Glucose 110", "WBC 7.2", "smoker", "mother with diabetes", "x", "y", "BMI 31"]


def blocks(text):
    lines = (text or "").split("\n")
    out = []
    for name, gap, least, pattern in BLOCK_FAMILIES:
        hits = [i for i, x in enumerate(lines) if re.search(pattern, x)]
        groups = []
        for i in hits:
            if groups and i - groups[-1][-1] <= gap:
                groups[-1].append(i)
            else:
                groups.append([i])
        groups = [g for g in groups if len(g) >= least]
        if groups:
            g = max(groups, key=len)
            sure = round(min(0.50 + len(g) / (g[-1] - g[0] + 1) * 0.30 + len(g) * 0.03, 0.88), 3)
            out.append((sum(len(x) + 1 for x in lines[:g[0]]), name, sure, len(g), g[0], g[-1]))
    return sorted(out)


def test_strongest_blocks(spark):
    rng = random.Random(5)
    rows = [(x, "\n".join(rng.choice(LINES) for _ in range(rng.randint(1, 40)))) for x in range(120)] + [(200, None), (201, ""), (202, "\n".join(LINES * 100))]
    got = {}
    for r in bk.content_blocks(spark.createDataFrame(rows, "doc_id int, text string").repartition(4)).collect():
        got.setdefault(r.doc_id, []).append(tuple(r)[1:])
    for i, t in rows:
        mine, want = sorted(got.get(i, [])), blocks(t)
        # at half of the third decimal either neighbour may come out
        assert [(*r[:2], *r[3:]) for r in mine] == [(*r[:2], *r[3:]) for r in want] and all(abs(a[2] - b[2]) < 0.0011 for a, b in zip(mine, want)), i


def test_islands_with_gaps(spark):
    """Rows of one hot key over many slices; each type has its own gap."""
    rng = random.Random(6)
    rows, t = [], 0
    for x in range(500):
        t += rng.choice([1, 1, 2, 5, 9])
        rows.append((0 if x < 400 else x % 3, t, rng.choice([1, 4])))
    df = spark.createDataFrame(rows, "u int, t int, gap int").repartition(6).withColumn("m", F.struct("t", "gap"))
    got = {(r.u, r.t): r.k for r in islands(df, ["u"], [F.col("t")], "m", "k", lambda a, b: b["t"] - a["t"] <= b["gap"]).collect()}
    for u in range(3):
        k, before = 0, None
        for _, t, gap in (r for r in rows if r[0] == u):
            k += before is not None and t - before > gap
            assert got[u, t] == k
            before = t


# --- headers ------------------------------------------------------------------------------
def levenshtein(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row = [i] + [0] * len(b) if (old := row) else row
        for j, y in enumerate(b, 1):
            row[j] = min(old[j] + 1, row[j - 1] + 1, old[j - 1] + (x != y))
    return row[-1]


def normal(h):
    h = re.sub(r"[\[\]:*=_\-–—]+", " ", h.lower().strip(" "))
    h = re.sub(r"\s*\([^)]*\)\s*\Z", "", h)
    h = re.sub(r"\A\s*\([^)]*\)\s*", "", h)
    return re.sub(r"\s+", " ", h).strip()


def stem(w):
    for s in STEM_SUFFIXES:
        if w.endswith(s) and len(w) > len(s) + 2:
            return w[:len(w) - len(s)]
    for s, least in STEM_ENDINGS:
        if w.endswith(s) and len(w) - len(s) >= least:
            return w[:len(w) - len(s)]
    return w


def alike(a, b):
    def score(x, y):
        edit = 1 - levenshtein(x, y) / max(len(x), len(y))
        s, t = ({stem(w) for w in v.split(" ") if len(w) > 1 and w not in HEADER_STOP_WORDS} for v in (x, y))
        tokens = len(s & t) / len(s | t) if s and t else 0.0
        if len(x) <= 3 or len(y) <= 3:
            return edit
        short = (len(x.split(" ")) + len(y.split(" "))) / 2 <= 2
        return max(edit, 0.65 * edit + 0.35 * tokens if short else 0.45 * edit + 0.55 * tokens)

    spell = lambda n: " ".join(HEADER_SHORT_FORMS.get(w, w) for w in n.split(" "))
    best = score(a, b)
    if spell(a) != a or spell(b) != b:
        best = max(best, score(spell(a), spell(b)))
    return max(best, 0.88) if a.startswith(b) or b.startswith(a) else best


def locate(header, text, start):
    if (p := text.find(header, start)) >= 0:
        return p, "exact"
    if (p := text.lower().find(header.lower(), start)) >= 0:
        return p, "case"
    if re.search(r"\s", header) and (m := re.compile(r"\s+".join(map(re.escape, header.split())), re.I).search(text, start)):
        return m.start(), "space"
    core = re.escape(header.rstrip(":").strip("[]").strip())
    if m := re.compile(rf"(?m)^[ \t]*\[?\s*{core}\s*\]?\s*:?", re.I).search(text, start):
        return m.start(), "marks"
    target, best, at, pos = normal(header), 0.0, -1, start
    for line in text[start:].split("\n"):
        s = line.strip()
        if s and target and len(s) < 80 and any(c.isalpha() for c in s) and not re.fullmatch(r"[\d/\-., :;()]+", s) and (n := normal(s)):
            if len(target) <= 3:
                if target in n.split(" "):
                    return pos, "fuzzy"
            elif (score := alike(target, n)) > best:
                best, at = score, pos
        pos += len(line) + 1
    return (at, "fuzzy") if best >= 0.75 else (-1, None)


def test_headers_are_found_in_order(spark):
    rng = random.Random(8)
    forms = ["Chief Complaint", "CHIEF COMPLAINT:", "[Chief Complaint]", "Cheif Complaint", "Past Med Hx:", "Past  Medical\tHistory", "PMH", "Plan", "[ Plan ]:", "Assessment / Plan",
             "Assessment Note:", "Social Hx", "words that say nothing of the plan here", "12/05/2024", "", "CC: cough", "a+b (c) \\E d", "see plan", "Medications\\"]
    heads = ["Chief Complaint", "chief complaint:", "Past Medical History", "PMH", "plan", "[Plan]", "Assessment", "Social History", "CC", "A+B (c) \\E D", "", None, "History\tof Plan", "Medications:"]
    rows = []
    for x in range(150):
        text = "\n".join("  " * rng.randint(0, 1) + rng.choice(forms) for _ in range(rng.randint(1, 14)))
        rows.append((x, text, [rng.choice(heads) for _ in range(rng.randint(0, 6))]))
    rows += [(200, None, ["Plan"]), (201, "", ["Plan"]), (202, "Plan", None), (203, "Plan\nPlan\nplan", ["Plan"] * 5), (204, "x\n" * 3000 + "Social Hx", ["Social History"])]
    got = {}
    for r in bk.locate_headers(spark.createDataFrame(rows, "doc_id int, text string, headers array<string>").repartition(4)).collect():
        got.setdefault(r.doc_id, []).append((r.ord, r.header, r.position, r.tier))
    tiers = set()
    for i, text, headers in rows:
        want, start = [], 0
        for x, h in enumerate(headers or []):
            h = (h or "").strip()
            if h and text:
                p, tier = locate(h, text, start)
                if p >= 0:
                    want.append((x, h, p, tier))
                    start = p + len(h)
                    tiers.add(tier)
        assert got.get(i, []) == want, (i, text, headers)
        assert [w[2] for w in want] == sorted(w[2] for w in want)
    assert tiers == {"exact", "case", "space", "marks", "fuzzy"}
