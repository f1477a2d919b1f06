"""Repeats found at scale against a scan of every window."""
import hashlib
import random
from collections import defaultdict

import numpy as np
import pytest

from notecoder.llm import repeats, suffix_array, suffix_tree


def brute(rows, tokens, length, joiner, first_stays):
    """rows: (doc_id, text); digests by a dictionary of every window."""
    seen = defaultdict(set)
    for doc, text in set(rows):
        t = tokens(text)
        for i in range(len(t) - length + 1):
            seen[tuple(t[i:i + length])].add((-(2**63) if doc is None else doc, text, i))
    copies = defaultdict(int)
    for r in rows:
        copies[r] += 1
    out = []
    for doc, text in rows:
        t = tokens(text)
        hit = [False] * len(t)
        for i in range(len(t) - length + 1):
            places = seen[tuple(t[i:i + length])]
            d = -(2**63) if doc is None else doc
            gone = (min((p[0], p[2]) for p in places) < (d, i)) if first_stays else len(places) > 1 or copies[(doc, text)] > 1
            if gone:
                hit[i:i + length] = [True] * length
        kept = [x for x, h in zip(t, hit) if not h]
        data = bytes(kept) if joiner is None else joiner.join(kept)
        n_spans = sum(h and (i == 0 or not hit[i - 1]) for i, h in enumerate(hit))
        out.append((doc, len(t), sum(hit), n_spans, hashlib.sha256(data).hexdigest()))
    return sorted(out, key=str)


def corpus():
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abcdeé") for _ in range(rng.randint(1, 4)))
    common = " ".join(word() for _ in range(90))
    base = [word() for _ in range(150)]
    rows = [(None, None), (3, ""), (4, "a" * 700), (5, "ab" * 300), (6, "x y " * 60), (7, common), (8, common), (8, common), (None, common + " z")]
    for i in range(20, 45):
        text = [word() for _ in range(rng.randint(0, 120))]
        if i % 3 == 0:
            text[len(text) // 2:len(text) // 2] = common.split()[rng.randint(0, 20):rng.randint(50, 90)]
        if i % 4 == 0:
            text = [w if rng.random() > 0.02 else word() for w in base]
        rows.append((i, rng.choice([" ", "  ", "\n"]).join(text)))
    rows += [(60, "q" + rows[12][1]), (61, rows[13][1] + "\t" + rows[14][1] * 3)]
    return rows


@pytest.mark.parametrize("group", [repeats.GROUP, 2])
def test_bytes_and_words_match_a_full_scan(spark, group):
    rows = corpus()
    docs = spark.createDataFrame(rows, "doc_id int, text string").repartition(3)
    cols = ["doc_id", "n_tokens", "n_removed", "n_spans", "kept_sha256"]
    got = repeats.without_repeats(docs, suffix_array.SEARCH, group=group).select(*cols)
    assert sorted(map(tuple, got.collect()), key=str) == brute(rows, lambda t: list((t or "").encode()), 200, None, False)
    got = repeats.without_repeats(docs, suffix_tree.SEARCH, group=group).select(*cols)
    assert sorted(map(tuple, got.collect()), key=str) == brute(rows, lambda t: (t or "").encode().split(), 20, b" ", True)


def test_long_texts_are_cut_into_overlapping_blocks(spark, monkeypatch):
    rng = np.random.default_rng(1)
    values = rng.integers(0, 2**63, 5000, dtype=np.uint64)
    whole = repeats.segments(values, np.ones(4981, bool), 20, 6)
    monkeypatch.setattr(repeats, "BLOCK", 700)
    import pandas as pd
    text = " ".join(f"w{v}" for v in values)
    parts = pd.concat(repeats._anchors(suffix_tree.SEARCH)(iter([pd.DataFrame({"_doc": [1], "_rk": [1], "text": [text]})])))
    assert parts["n"].sum() == len(values) - 19 == whole[3].sum()
    assert sorted(p + i for p, n in zip(parts["p"], parts["n"]) for i in range(n)) == list(range(4981))


def test_full_output_and_empty_table(spark):
    docs = spark.createDataFrame([(1, "abc" * 100, 0), (2, "z", 1)], "doc_id bigint, text string, _rk int")
    rows = {r["doc_id"]: r for r in suffix_array.deduplicated(docs, full=True).collect()}
    assert [tuple(x) for x in rows[1]["removed"]] == [(0, 300)] and bytes(rows[2]["kept"]) == b"z"
    assert suffix_tree.deduplicated(docs.limit(0)).count() == 0


def test_suffix_array_against_sorting():
    rng = random.Random(3)
    for _ in range(300):
        text = bytes(rng.randint(97, 97 + rng.choice([0, 1, 3, 20])) for _ in range(rng.randint(0, 60)))
        want = sorted(range(len(text)), key=lambda i: text[i:])
        assert suffix_array.suffix_array(np.frombuffer(text, np.uint8)).tolist() == want


def test_parts_of_equal_windows_have_equal_stretches():
    for lo in range(0, 15):
        for length, width, times in [(20, 6, 3), (21, 6, 9), (9, 1, 2)]:
            for first in range(max(0, lo + width - length), lo + 1):
                parts = repeats.parted(first, lo, lo, lo + width, length, times)
                assert [w for a, b, _, _ in parts for w in range(a, b + 1)] == list(range(first, lo + 1))
                assert all(c <= lo < lo + width <= d and b <= c and d <= a + length for a, b, c, d in parts)
                # the stretch follows from the window's place alone
                alone = {w: repeats.parted(w, w, lo, lo + width, length, times)[0][2:] for w in range(first, lo + 1)}
                assert all(alone[w] == (c, d) for a, b, c, d in parts for w in range(a, b + 1))


def test_bundles_end_at_group_edges(monkeypatch):
    import pandas as pd
    rng = random.Random(2)
    sizes = [rng.randint(1, 9) for _ in range(40)]
    rows = [(k, 10 * g + k, g, 5 * i, 1, 0, bytes(rng.choice(b"ab") for _ in range(200))) for g, n in enumerate(sizes) for i, k in enumerate(range(n))]
    frame = pd.DataFrame(rows, columns=["_doc", "_rk", "g", "p", "n", "m", "body"])
    seen = []
    kinds = lambda text, starts: (seen.append(len(text)), np.full(len(starts), -1))[1]
    monkeypatch.setattr(repeats, "BUNDLE", 2000)
    list(repeats._compare(repeats.Search(repeats.Bytes, 200, 32, kinds, False))(iter([frame[:70], frame[70:150], frame[150:]])))
    assert sum(seen) == 200 * len(rows) and max(seen) < 2000 + 9 * 200
