"""Ranked search against a scoring of every document."""
import math
import random
import re
from collections import Counter, defaultdict

import pytest

from notecoder.llm import search
from notecoder.llm.search import ranked
from notecoder.llm.terms import terms

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def cut(text):
    return TERM.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def brute(docs, items, k):
    bodies = [(d, Counter(w), len(w)) for d, t in docs if (w := cut(t))]
    total, length = len(bodies), sum(n for _, _, n in bodies)
    df = Counter(t for _, c, _ in bodies for t in c)
    asked = defaultdict(list)
    for i, t in items:
        asked[i] += cut(t)
    out = []
    for item, words in asked.items():
        scored = []
        for d, c, n in bodies:
            m = 25 + 75 * n * total // length
            s = sum(math.floor(1000 * math.log((2 * total + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 8 * m)) for t in words if c[t])
            if s > 0:
                scored.append((-s, d is None, d or 0, d))
        out += [(item, r + 1, x[3], -x[0]) for r, x in enumerate(sorted(scored)[:k])]
    return out


def same(a, b):
    assert sorted(map(str, a)) == sorted(map(str, b))


def test_terms_are_those_of_the_pattern():
    rng = random.Random(3)
    for _ in range(300):
        t = "".join(rng.choice("aZ09_-/:@[`{~\x7f\x80é日😀   \n\0ÀÉ") for _ in range(30))
        assert [x.decode() for x in terms(t.encode())] == cut(t)
    assert terms(None) == terms(b"") == []


@pytest.mark.parametrize("postings", [40, 2_000_000])
def test_equal_to_scoring_all(spark, monkeypatch, postings):
    rng = random.Random(postings)
    vocabulary = [f"w{x}" for x in range(60)] + ["É", "naïve", "日本"]
    weights = [1 / (x + 1) for x in range(len(vocabulary))]
    docs = [(x, " ".join(rng.choices(vocabulary, weights, k=rng.randint(1, 60)))) for x in range(300)]
    docs += [(1000 + x, docs[5][1].upper()) for x in range(40)] + [docs[7], docs[7]]  # ties and repeated rows
    docs += [(2000, None), (2001, ""), (2002, " .,; "), (None, docs[9][1]), (None, docs[9][1]), (2003, "w1 w2 w50 " * 4000)]
    rng.shuffle(docs)
    items = [(x, " ".join(rng.choices(vocabulary, k=rng.randint(1, 25)))) for x in range(25)]
    items += [(100, None), (101, ""), (102, "unknown words"), (103, "w0 W0 w0"), (104, docs[3][1] or "w1"), (105, docs[3][1]), (106, "w1 w2 w50"),
              (None, "w9 w8"), (None, "w7"), (107, "w3"), (107, "w4")]
    monkeypatch.setattr(search, "POSTINGS", postings)
    # with clashing further columns; two passes over the documents
    d = spark.createDataFrame([(i, t, 0, "x") for i, t in docs], "doc_id long, text string, score int, term string").repartition(3)
    i = spark.createDataFrame([(x, t, 1) for x, t in items], "item_id long, text string, rank int")
    want = brute(docs, items, 10)
    same([tuple(r) for r in ranked(d, i).collect()], want)
    same([tuple(r) for r in ranked(d, i, pairs=90).collect()], want)


def test_blocks_equal_scoring_all():
    """Blocks as tasks hold them, many times, with limits that close early and late."""
    import numpy as np
    import pyarrow as pa

    rng = np.random.default_rng(1)
    for _ in range(300):
        docs, width = int(rng.integers(1, 40)), int(rng.integers(1, 8))
        sizes, pairs = [], []
        for _ in range(docs):
            own = [(t, int(rng.integers(1, 4))) for t in range(width) if rng.random() < 0.4]
            sizes.append(len(own))
            pairs += own
        n = rng.integers(1, 9, docs)
        block = search.Block(pa.array(rng.permutation(docs)), n, np.array(sizes), np.array([t for t, _ in pairs], np.int32),
                             np.array([c for _, c in pairs], np.int32), width, (docs, int(n.sum())))
        query = [(int(t), int(rng.integers(0, 5))) for t in rng.permutation(width)]
        k, full = int(rng.integers(1, 6)), np.zeros(docs, np.int64)
        for t, w in query:
            at, v = block.postings(t)
            full[at] += w * v
        want = sorted((-int(s), int(block.place[d]), d) for d, s in enumerate(full) if s)[:k]
        assert block.best(query, k, 0) == [(-s, d) for s, _, d in want]
        bar = -want[-1][0] if len(want) == k else 0
        assert block.best(query, k, bar) == [(-s, d) for s, _, d in want]


def test_empty_tables(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    items = spark.createDataFrame([(1, "a b")], "item_id long, text string")
    assert ranked(none, items).count() == 0
    assert ranked(spark.createDataFrame([(1, "a b")], "doc_id long, text string"), items.where("false")).count() == 0
    assert [tuple(r)[:3] for r in ranked(spark.createDataFrame([("x", "a b"), ("y", "c")], "doc_id string, text string"), items).collect()] == [(1, 1, "x")]
