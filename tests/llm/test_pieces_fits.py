"""The neighbour test undoes merges; merging the pair anew must say the same."""
import random

from notecoder.llm import pieces


def test_fits_as_merging_says_without_merging():
    e = pieces._encoder(pieces.model_path())
    rng = random.Random(3)
    ids = sorted(e.ids)
    pairs = [(rng.choice(ids), rng.choice(ids)) for _ in range(1500)]
    for q in rng.sample([p for p in ids if len(p) > 2], 1500):
        k = rng.randrange(1, len(q))
        pairs.append((q[:k], q[k:]))  # together a piece, or part of the way to one
    pairs = [(x, y) for x, y in pairs if (x in e.ids or len(x) == 1) and (y in e.ids or len(y) == 1) and not any(t in x + y for t in e.tied)]
    pairs += [("\U0001f600", "a"), ("a", "\U0001f600")]
    want = [e.merged(x + y) == [x, y] for x, y in pairs]
    assert 0 < sum(want) < len(want)
    assert [e._fits(x, y) for x, y in pairs] == want

    made, merged = [], e.merged
    e.merged = lambda text, score=None: made.append(text) or merged(text, score)
    try:
        known = [(x, y) for x, y in pairs if all(len(p) == 1 or e.halves(p)[2] for p in (x, y))]
        made.clear()
        for x, y in known:
            e._fits(x, y)
        assert made == []
    finally:
        del e.merged
