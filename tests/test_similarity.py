from difflib import SequenceMatcher

from hypothesis import given, settings, strategies as st

from notecoder.functions import similarity as sim


def lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        prev = 0
        for j, y in enumerate(b, 1):
            row[j], prev = (prev + 1 if x == y else max(row[j], row[j - 1])), row[j]
    return row[-1]


@settings(max_examples=200, deadline=None)
@given(st.text("abcd ", max_size=20), st.text("abcd ", max_size=20))
def test_lcs_matches_dynamic_programming(a, b):
    assert sim._lcs(a, b) == lcs(a, b)


def test_token_set_score():
    assert sim.token_set_score("type 2 diabetes", "diabetes mellitus type 2") == 100
    assert sim.token_set_score("", "x") == 0
    assert sim.token_set_score("asthma", "gout") < 50


def test_partial_score():
    assert sim.partial_score("recheck labs", "please recheck labs soon") == 100


def test_ratio_is_difflib(spark):
    df = spark.createDataFrame([("medication", "medications"), ("", "x")], "a string, b string")
    got = [r[0] for r in df.select(sim.ratio("a", "b")).collect()]
    assert got == [SequenceMatcher(None, "medication", "medications").ratio(), 0.0]
