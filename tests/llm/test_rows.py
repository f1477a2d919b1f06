"""Operators that judge or rewrite rows, against plain Python."""
import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from notecoder.llm.contamination import checked
from notecoder.llm.lines import without_recurring_lines
from notecoder.llm.pieces import encoded, model_path
from notecoder.llm.quality import judged
from notecoder.llm.queries import QUERIES
from notecoder.llm.sharding import communication_matrix, shard_rows

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def texts(seed, n=40):
    rng = random.Random(seed)
    out = [None, "", " \n\t", "one", "a\n\na\nb a\n", "#$ % *", "été 日本 😀 x" * 3, "the of and " * 40, "x " * 3000, "\x0b\x0ca b\r\nc\n"]
    for _ in range(n):
        w = [rng.choice(["the", "of", "foo", "Bar", "baz#", "quux", "zap\n", "zip\n", "ÉT"]) for _ in range(rng.randint(1, 160))]
        out.append(" ".join(w))
    return out


def test_quality_counts(spark):
    rows = [(None if i == 3 else i, t, "n") for i, t in enumerate(texts(1))] + [(5, "#$ % *", "n")]
    out = judged(spark.createDataFrame(rows, "doc_id int, text string, n_words string")).collect()
    assert len(out) == len(rows)
    for r in out:
        t = r["text"] or ""
        w = WORD.findall(t)
        grams = [tuple(w[i:i + 3]) for i in range(len(w) - 2)]
        often = Counter(grams)
        covered = {i + k for i, g in enumerate(grams) if often[g] > 1 for k in range(3)}
        lines = [x for x in t.split("\n") if WORD.search(x)]
        want = (len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), len(lines) - len(set(lines)), len(covered))
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == want, t
        assert r.base_failed == (want[0] < 50 or 100 * want[4] > 50 * want[0]) and (not r.kept or not r.base_failed)
    assert judged(spark.createDataFrame([], "doc_id int, text string")).count() == 0


def test_pieces_equal_the_library(spark):
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=model_path())
    rows = [(i, t, 1) for i, t in enumerate(texts(2) + ["▁▁a", "a  b   c ", "\0", " lead", "x" * 5000, "<s> </s>", "the  " * 500])]
    out = encoded(spark.createDataFrame(rows, "doc_id int, text string, n_tokens int"), full=True).collect()
    for r in out:
        ids = sp.encode(rows[r.doc_id][1] or "", add_bos=True, add_eos=True)
        assert r.ids == ids and r.n_tokens == len(ids) and r.decoded == sp.decode(ids)
        assert r.ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(sp.decode(ids).encode()).hexdigest()
    assert encoded(spark.createDataFrame([], "doc_id int, text string")).count() == 0


def test_recurring_lines(spark):
    notice = "Copyright 2021 Example Press all rights reserved worldwide today"
    own = lambda i: " ".join(chr(97 + i) * k for k in range(1, 7))
    rows = [(i, f"{own(i)}\n{notice.replace('2021', str(1990 + i))}\n\nlast {chr(97 + i)}", i) for i in range(12)]
    varied = "read more about {} and {} in our weekly letter"
    rows += [(20 + i, varied.format("abcdefghijkl"[i], "mnopqrstuvwx"[i]), 0) for i in range(12)]
    rows += [(40, None, 0), (41, "", 0), (42, "\n\n", 0), (None, notice, 0), (43, "1 2 3\n4 5 6", 0), (44, "rare line", 0)]
    out = {r.doc_id: r for r in without_recurring_lines(spark.createDataFrame(rows, "doc_id int, text string, emptied int")).collect()}
    assert out[None].text == notice and out[None].n_dropped == 0
    assert all(out[i].text == f"{own(i)}\n\nlast {chr(97 + i)}" and out[i].n_dropped == 1 for i in range(12))
    assert out[40].text is None and out[41].text == "" and out[42].text == "\n\n" and out[43].n_dropped == 0 and out[44].n_dropped == 0
    # two fields vary side by side
    assert sorted(i for i in range(12) if out[20 + i].emptied) == list(range(1, 12))
    one = spark.createDataFrame([(i, f"read more about {c} and then in our weekly letter") for i, c in enumerate("abcdefghijkl")], "doc_id int, text string")
    assert sorted((r.doc_id, r.emptied) for r in without_recurring_lines(one).collect()) == [(i, i > 0) for i in range(12)]
    assert without_recurring_lines(one.limit(0)).count() == 0


def lines_to_drop(rows, least):
    """Learned templates by plain loops; rows that share id and text are one document."""
    lines, shared = [], {}
    for d, t in rows:
        for i, x in enumerate(t.split("\n") if t is not None else []):
            w = WORD.findall(x)
            masked = ["<*>" if re.search("[0-9]", y) else y for y in w]
            w = masked if any(y.replace("<*>", "") for y in masked) else w
            if w:
                lines.append(((d if d is not None else -2**63, t), i, w))
    fixed = lambda y: y != "<*>" and not re.search("[0-9]", y)
    leaf = lambda w: (len(w), *w[:2])
    counts = Counter((leaf(w), i, y) for _, _, w in lines for i, y in enumerate(w) if fixed(y))
    for doc, i, w in lines:
        known = [(j, y, c) for j, y in enumerate(w) if (c := counts[leaf(w), j, y]) >= least]
        forms = {("own", *w)}
        for _, _, edge in known:
            t = tuple((j, y) for j, y, c in known if c >= edge)
            if 2 * len(t) >= len(w):
                forms.add((leaf(w), t))
        for f in forms:
            shared.setdefault(f, []).append((doc[0], i, doc))
    gone = set()
    for places in shared.values():
        if len({doc for _, _, doc in places}) >= least:
            first = min((d, i) for d, i, _ in places)
            gone |= {(doc, i) for d, i, doc in places if (d, i) != first}
    return gone


def test_learned_templates_equal_plain_loops(spark):
    dropped = 0
    for seed in range(4):
        rng = random.Random(seed)
        word = lambda: rng.choice(["ab", "cd", "ef", "g1", "7", "<*>", "hi", "é"]) if rng.random() < 0.7 else f"w{rng.choice('abcdefghijkl')}"
        heads = ["see also the", "by", "read on in", ""]
        line = lambda: f"{rng.choice(heads)} " + " \t".join(word() for _ in range(rng.randint(0, 6)))
        rows = [(i, "\n".join(line() for _ in range(rng.randint(0, 12)))) for i in range(60)]
        rows += [rows[3], rows[3], (None, rows[5][1]), (71, None), (72, ""), (73, "\n \n"), (74, "see also the ab " * 3000), (75, "see also the ab " * 3000)]
        gone = lines_to_drop(rows, 4)
        frame = spark.createDataFrame([(d, t, "x", 1) for d, t in rows], "doc_id int, text string, n_dropped string, leaf int").repartition(5)
        out = without_recurring_lines(frame, min_docs=4).collect()
        want = []
        for d, t in rows:
            at = (d if d is not None else -2**63, t)
            kept = None if t is None else "\n".join(x for i, x in enumerate(t.split("\n")) if (at, i) not in gone)
            want.append((d, kept, len(t.split("\n")) if t is not None else 0, sum((at, i) in gone for i in range(t.count("\n") + 1)) if t is not None else 0, 1))
        order = lambda v: sorted(v, key=repr)
        assert order((r.doc_id, r.text, r.n_lines, r.n_dropped, r.leaf) for r in out) == order(want)
        dropped += len(gone)
    assert dropped > 400


def test_leaked_items_are_found(spark):
    rng = random.Random(4)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(4))
    items = [(i, " ".join(word() for _ in range(rng.randint(8, 50)))) for i in range(12)] + [(90, "too short"), (91, None), (None, "a b c d e f")]
    docs, want = [(0, None, 1), (1, "", 1), (2, "too short", 1)], {}
    for i in range(3, 60):
        w = [word() for _ in range(rng.randint(0, 120))]
        if i % 3 == 0:
            item = rng.randrange(12)
            passage = items[item][1].split()
            kind = i % 4
            if kind == 1 and len(passage) > 30:
                passage[len(passage) // 2:len(passage) // 2 + 1] = [word().upper()]
            at = rng.randint(0, len(w))
            w[at:at] = [x.upper() + "," for x in passage] if kind == 2 else passage
        docs.append((i, " ".join(w), 1))
    longest = max((t for _, t in items if t), key=len).split()
    docs += [(100 + k, " ".join(longest[k:]), 1) for k in range(1, 14)] + [(120, " ".join(["q"] * 3 + longest + ["z"] * 50_000), 1)]
    grams = lambda t: [tuple(x[i:i + 5]) for x in [re.findall(r"[^\W_]+", (t or "").lower())] for i in range(len(x) - 4)]
    for d, t, _ in docs:
        g = grams(t)
        for item, body in items:
            b = grams(body)
            if item is None or not b:
                continue
            # a shorter document is one window
            size = min(len(g), len(b))
            for s in range(len(g) - size + 1):
                inter = sum((Counter(g[s:s + size]) & Counter(b)).values())
                if 5 * inter >= 4 * (size + len(b) - inter):
                    want.setdefault(d, set()).add(item)
    frame = spark.createDataFrame(docs + docs[:1], "doc_id int, text string, n_items int")
    bench = spark.createDataFrame(items, "item_id int, text string")
    for literals in (20_000, 0):
        out = checked(frame, bench, literals).collect()
        assert len(out) == len(docs) + 1
        assert {r.doc_id: (r.n_items, r.first_item) for r in out if r.contaminated} == {d: (len(v), min(v)) for d, v in want.items()}
    assert len(want) > 10
    assert not any(r.contaminated for r in checked(frame, bench.limit(0)).collect()) and checked(frame.limit(0), bench).count() == 0


def test_shards_are_exact_and_uniform(spark):
    rows = [(None if i % 50 == 0 else i % 700, f"t{i % 9}", i) for i in range(1003)]
    df = spark.createDataFrame(rows, "doc_id int, text string, slot int").repartition(7)
    out = shard_rows(df.drop("slot"), 8).collect()
    assert len(out) == 1003 and Counter((r.doc_id, r.text) for r in out) == Counter((a, b) for a, b, _ in rows)
    for s in range(8):
        slots = sorted(r.slot for r in out if r.shard == s)
        assert slots == list(range(len(slots))) and len(slots) in (125, 126)
    m = communication_matrix([400, 3, 0, 600], 4, 3)
    assert m.sum(axis=1).tolist() == [400, 3, 0, 600] and m.sum(axis=0).tolist() == [251, 251, 251, 250]
    # over many seeds a partition's share of a shard has the mean and spread of a uniform shuffle
    cells = np.array([communication_matrix([500, 500], 4, s)[0, 0] for s in range(2000)])
    assert abs(cells.mean() - 125) < 1 and abs(cells.var() - 250 * 0.25 * 750 / 999) < 5
    assert shard_rows(df.drop("slot").limit(0)).count() == 0


def test_sharding_query_digests(spark, tmp_path):
    docs = spark.createDataFrame([(1, "é"), (2, None), (3, "")], "doc_id int, text string")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    out = {r.doc_id: r for r in QUERIES["op5_sharding"](spark, str(tmp_path)).collect()}
    assert out[1]["size"] == 3 and out[2]["size"] == 1 and out[1].text_crc32 == zlib.crc32("é".encode()) and out[2].text_crc32 == 0
    assert {r.law for r in out.values()} == {"rows"} and {r.grown_shard for r in out.values()} == {None}
