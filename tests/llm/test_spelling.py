"""Spelling variants against a comparison of all pairs."""
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from notecoder.llm.spelling import Letters, grouped, one_edit

RUN = re.compile("[A-Za-zÀ-ÿ]+")


def near(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    short, long = sorted((a, b), key=len)
    return len(long) - len(short) == 1 and any(long[:k] + long[k + 1:] == short for k in range(len(long)))


def brute(docs, length, count, times=2):
    n = Counter()
    for i, t in docs:
        for run in RUN.findall(t or ""):
            run = re.sub("[A-Z]", lambda m: m[0].lower(), run)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if h % 97 == 0:
                run = run[:h % len(run)] + run[h % len(run) + 1:]
            n[run] += 1
    n = {w: c for w, c in n.items() if len(w) >= length and c >= count}
    nears = {w: [x for x in n if near(w, x)] for w in n}
    form = {}
    for w, xs in nears.items():
        best = min(xs, key=lambda x: (-n[x], x), default=None)
        form[w] = best if best is not None and n[best] >= times * n[w] else None
    out = []
    for w in n:
        root = w
        while form[root] is not None:
            root = form[root]
        out.append((w, form[w], root, n[w], len(nears[w]), n[form[w]] if form[w] else None))
    return sorted(out, key=lambda r: r[0])


def compare(spark, docs, length=5, count=3, **limits):
    df = spark.createDataFrame([(i, t, 1, "x") for i, t in docs], "doc_id long, text string, n int, word string").repartition(3)
    got = sorted((tuple(r) for r in grouped(df, length, count, **limits).collect()), key=lambda r: r[0])
    assert got == brute(docs, length, count)
    return got


@pytest.mark.parametrize("limits", [{}, {"stored": 7, "askers": 11, "mean": 2}])
def test_equal_to_all_pairs(spark, limits):
    rng = random.Random(7)
    base = ["".join(rng.choices("etaoinshé", k=rng.randint(1, 9))) for _ in range(60)] + ["aaaaa", "ababab", "x" * 300, "ÀÉÎàéî", "Straße", "×÷×÷×"]
    words = []
    for w in base:
        words += [w] * rng.randint(1, 40)
        for _ in range(6):  # variants, and variants of variants
            k = rng.randrange(len(w))
            v = rng.choice([w[:k] + w[k + 1:], w[:k] + rng.choice("etaoxyÿ") + w[k:], w[:k] + rng.choice("etaoxyÿ") + w[k + 1:]])
            words += [v] * rng.choice([1, 3, 4, 9])
    words += sum(([w] * n for w, n in (("chains", 90), ("chainsx", 40), ("chainsxy", 16), ("chainsxyz", 7), ("chainsxyzé", 3))), [])
    rng.shuffle(words)
    docs = [(x, rng.choice([" ", "\n", "1", "-", "日", "\0", "Ā"]).join(words[x::50])) for x in range(50)]
    docs += [(100, None), (101, ""), (102, "12 34 ."), (None, docs[3][1]), (4, docs[4][1]), (103, "VeryLongWords " * 5000)]
    got = compare(spark, docs, **limits)
    assert any(r[2] not in (r[0], r[1]) for r in got), "chains of forms"


def test_hot_leaf_and_ties(spark):
    """Many words with the same letters, and near words of equal counts."""
    import itertools

    words = ["".join(p) for p in itertools.islice(itertools.permutations("abcdef"), 150)] + ["abcdefg", "abcdeg", "bacdef" + "a", "abcde"]
    docs = [(x, " ".join(words)) for x in range(8)]
    compare(spark, docs, stored=20, askers=20, mean=10)
    compare(spark, docs, length=1, count=1)


def test_empty_table(spark):
    assert grouped(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    assert compare(spark, [(1, "only words such as these, none often enough")]) == []


def test_one_edit():
    rng = random.Random(1)
    words = ["".join(rng.choices("ab", k=rng.randint(1, 7))) for _ in range(120)] + ["a" * 40, "a" * 41, "a" * 39 + "b"]
    letters = Letters([w.encode() for w in words])
    x, y = (g.ravel() for g in np.meshgrid(np.arange(len(words)), np.arange(len(words))))
    got = one_edit(letters, x, letters, y)
    assert all(g == (len(words[a]) <= len(words[b]) and near(words[a], words[b])) for g, a, b in zip(got, x, y))
