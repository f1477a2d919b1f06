"""License scans against a comparison of every window with every template."""
import random
import re

from notecoder.llm.licenses import PHRASES, TEMPLATES, compiled, scanned

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def cut(text):
    return WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def brute(text, phrases, templates, enough):
    words, base, spans = cut(text), [], set()
    for p, label in phrases:
        p = cut(p)
        base += [(x, label) for x in range(len(words) - len(p) + 1) if p and words[x:x + len(p)] == p]
    sets = []
    for label, t in templates:
        size = 8
        while size < len(cut(t)):
            size *= 2
        sets.append((label, set(cut(t)), size))
    for size in {s for _, _, s in sets}:
        for at in range(0, max(len(words), 1), size):
            own = set(words[at:at + 2 * size])
            match = [(label, t) for label, t, s in sets if s == size and t and enough[1] * len(own & t) >= enough[0] * len(t)]
            spans |= {(label, at, size, len(own & t) / len(t)) for label, t in match if not any(t < u for _, u in match)}
    best = max((s[3] for s in spans), default=0.0)
    at = [x for x, _ in base]
    base_labels = {label for _, label in base}
    return (len(words), len(base), min(at, default=None), max(at, default=None), ",".join(sorted(base_labels)),
            ",".join(sorted(base_labels | {s[0] for s in spans})), 1.0 if base else best, spans)


def compare(spark, rows, phrases, templates, enough):
    df = spark.createDataFrame([(i, t, "x", 1) for i, t in rows], "doc_id long, text string, labels string, row int").repartition(3)
    out = scanned(df, phrases, templates, enough).collect()
    got = [(r.doc_id, *r[1:8], {tuple(s) for s in r.spans}) for r in out]
    want = [(i, *brute(t, phrases, templates, enough)) for i, t in rows]
    assert sorted(map(repr, ((*g[:-1], sorted(g[-1])) for g in got))) == sorted(map(repr, ((*w[:-1], sorted(w[-1])) for w in want)))
    return got


def test_random_templates(spark):
    rng = random.Random(4)
    vocabulary = [f"w{x}" for x in range(30)]
    templates = [(f"t{x}", " ".join(rng.choices(vocabulary, k=rng.randint(1, 20)))) for x in range(12)]
    templates += [("long", templates[3][1] + " w1 w2"), ("none", " . "), ("t3", templates[3][1])]
    phrases = [("w1 w1", "a"), ("w2 w3", "b"), ("W4", "a"), ("...", "never")]
    rows = [(x, " ".join(rng.choices(vocabulary, [1 / (k + 1) for k in range(30)], k=rng.randint(1, 120)))) for x in range(120)]
    rows += [(200, None), (201, ""), (202, " .\n"), (None, "w1 w1 w1"), (5, rows[5][1]), (203, "w1 W1 w2-w3 " * 3000)]
    rows += [(300 + x, "w0 " * rng.randint(0, 20) + t + " w29 w28") for x, (_, t) in enumerate(templates)]
    for enough in ((9, 10), (1, 2), (1, 1)):
        compare(spark, rows, phrases, templates, enough)


def test_public_notices(spark):
    body = "plain words of a document that stand before and after the notice " * 3
    rows = [(x, body + t.upper().replace(" ", "\n * " if x % 2 else " ") + " " + body) for x, (_, t) in enumerate(TEMPLATES)]
    rows += [(100, "Under the MIT  License; under the (MIT) license"), (101, "Licensed under the Apache License, Version 2.0."), (102, "CC BY-NC"), (103, body * 50)]
    got = {r[0]: r for r in compare(spark, rows, PHRASES, TEMPLATES, (9, 10))}
    for x, (label, _) in enumerate(TEMPLATES):
        assert label in got[x][6].split(",") and got[x][7] == 1.0, label
    assert got[100][2:5] == (2, 0, 4) and got[103][6] == "" and got[103][7] == 0.0
    assert [got[x][6] for x in (101, 102)] == ["apache-2", "cc-by-nc"]
    # one license stated with another's words gets its own label only
    own = {label: got[x][6] for x, (label, t) in enumerate(TEMPLATES) if len(t) < 60}
    assert all(a == b for a, b in own.items())


def test_empty_table_and_order(spark):
    assert scanned(spark.createDataFrame([], "doc_id string, text string")).count() == 0
    made = compiled([("x", "a b c b")], {b"a": 9, b"b": 1})
    assert made[0].words == (b"c", b"b", b"a") and made[0].need == 3 and made[0].prefix() == (b"c",)
