"""Near-duplicates and components against comparing all pairs."""
import random
import re

import pytest

from notecoder.llm.components import components
from notecoder.llm.minhash import near_duplicates


def sets_of(text, k):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(w[i:i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set())


def brute(rows, k):
    sets = [sets_of(t, k) for _, t in rows]
    up = list(range(len(rows)))

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
                up[root(i)] = root(j)
    ids = {}
    for i, (d, _) in enumerate(rows):
        ids.setdefault(root(i), []).append(d)
    out = []
    for i, (d, _) in enumerate(rows):
        known = [x for x in ids[root(i)] if x is not None]
        comp = min(known) if known else None
        out.append((d, len(sets[i]), comp, comp is None or d == comp))
    return sorted(out, key=str)


def corpus(seed):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefgÉ") for _ in range(3))
    rows = [(None, None), (1, ""), (2, " \t"), (3, "One"), (4, "one"), (5, "two words"), (None, "Two  Words"), (6, "x " * 40)]
    for g in range(8):
        base = [word() for _ in range(rng.randint(5, 120))]
        for _ in range(rng.randint(1, 14)):
            w = [word() if rng.random() < 0.03 else x for x in base]
            rows.append((10 + len(rows), " ".join(w)))
            if rng.random() < 0.2:
                rows.append((rows[-1][0] if rng.random() < 0.5 else 10 + len(rows), " ".join(w).upper()))
    # a long chain: neighbours are alike, the ends are not
    chain = [word() for _ in range(200)]
    rows += [(500 + i, " ".join(chain[4 * i:4 * i + 100])) for i in range(20)]
    return rows


@pytest.mark.parametrize("seed", [1, 2])
def test_matches_all_pairs(spark, seed):
    rows = corpus(seed)
    docs = spark.createDataFrame([(*r, 0, "x") for r in rows], "doc_id int, text string, class int, sig string").repartition(5)
    got = near_duplicates(docs, words=2).select("doc_id", "n_shingles", "component_id", "kept")
    assert sorted(map(tuple, got.collect()), key=str) == brute(rows, 2)


def test_copies_around_the_threshold(spark):
    """A family whose members are alike or not by the number of their edits."""
    rng = random.Random(7)
    base = [f"b{i}" for i in range(80)]
    rows = []
    for i in range(150):
        w = list(base)
        for at in rng.sample(range(80), rng.choice([0, 1, 2, 3, 4, 5, 6, 8])):
            w[at] = f"e{rng.randrange(10**6)}"
        rows.append((i, " ".join(w[:rng.choice([80, 80, 74])])))
    got = near_duplicates(spark.createDataFrame(rows, "doc_id int, text string"), words=2).select("doc_id", "n_shingles", "component_id", "kept")
    assert sorted(map(tuple, got.collect()), key=str) == brute(rows, 2)


def test_empty_table(spark):
    assert near_duplicates(spark.createDataFrame([], "doc_id int, text string")).count() == 0


def test_components_of_chains_stars_and_cliques(spark):
    edges = [(i, i + 1) for i in range(0, 60)] + [(100, 100 + i) for i in range(40)] + [(i, j) for i in range(200, 210) for j in range(200, 210)]
    edges += [(7, 7), (None, 3), (5, 4), (5, 4)]
    got = dict(map(tuple, components(spark.createDataFrame(edges, "u int, v int").select("u", "v")).collect()))
    assert got == {**{i: 0 for i in range(61)}, **{100 + i: 100 for i in range(40)}, **{i: 200 for i in range(200, 210)}}
