"""Similarity scores: native where Spark has the expression, Arrow UDFs for the rest."""
from __future__ import annotations

import re
from difflib import SequenceMatcher
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, IntegerType

from . import text as tx


def jaccard(a: Column, b: Column) -> Column:
    """Shared share of two token arrays; 0 where either is empty."""
    return F.when((F.size(a) > 0) & (F.size(b) > 0), F.size(F.array_intersect(a, b)) / F.size(F.array_union(a, b))).otherwise(F.lit(0.0))


def levenshtein_similarity(a: Column, b: Column) -> Column:
    longest = F.greatest(F.length(a), F.length(b))
    return F.when((F.length(a) > 0) & (F.length(b) > 0), 1 - F.levenshtein(a, b) / longest).otherwise(F.lit(0.0))


def header_similarity(edit: Column, tokens: Column, a: Column, b: Column) -> Column:
    """Blend of edit and token similarity of two normalized headers."""
    words = lambda c: F.size(F.split(c, " "))
    mean_words = (words(a) + words(b)) / 2
    # Blend weights for short and for longer headers.
    weighted = F.when(mean_words <= 2, 0.65 * edit + 0.35 * tokens).otherwise(0.45 * edit + 0.55 * tokens)
    return F.when((F.length(a) <= 3) | (F.length(b) <= 3), edit).otherwise(F.greatest(edit, weighted))


@F.pandas_udf(DoubleType())
def ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    """Ratcliff-Obershelp ratio of two normalized strings."""
    return pd.Series([SequenceMatcher(None, x, y).ratio() if x and y else 0.0 for x, y in zip(a, b)])


def _lcs(a: str, b: str) -> int:
    """Longest common subsequence length with one big-integer row per character."""
    masks: dict[str, int] = {}
    for i, ch in enumerate(a):
        masks[ch] = masks.get(ch, 0) | (1 << i)
    full = (1 << len(a)) - 1
    row = full
    for ch in b:
        hit = row & masks.get(ch, 0)
        row = ((row + hit) | (row - hit)) & full
    return len(a) - row.bit_count()


def indel_ratio(a: str, b: str) -> float:
    return 200.0 * _lcs(a, b) / (len(a) + len(b)) if a or b else 100.0


_NON_WORD = re.compile(r"[\W_]+")


@lru_cache(maxsize=65536)
def _token_set(s: str) -> frozenset:
    return frozenset(_NON_WORD.sub(" ", s).lower().split())


def token_set_score(a: str, b: str) -> int:
    """Best ratio among the sorted shared words and the shared words plus either rest."""
    x, y = _token_set(a), _token_set(b)
    if not x or not y:
        return 0
    shared = " ".join(sorted(x & y))
    left = (shared + " " + " ".join(sorted(x - y))).strip()
    right = (shared + " " + " ".join(sorted(y - x))).strip()
    pairs = [(left, right)] + ([(shared, left), (shared, right)] if shared else [])
    return round(max(indel_ratio(p, q) for p, q in pairs))


@F.pandas_udf(IntegerType())
def token_set_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([token_set_score(x, y) if x is not None and y is not None else None for x, y in zip(a, b)], dtype="Int32")


def partial_score(needle: str, hay: str) -> int:
    """Best ratio of the shorter text against windows of the longer one.

    Windows start where a matching block of the two texts would align them.
    """
    short, long_ = (needle, hay) if len(needle) <= len(hay) else (hay, needle)
    if not short:
        return 0
    best = 0.0
    for block in SequenceMatcher(None, short, long_, autojunk=False).get_matching_blocks():
        start = max(block.b - block.a, 0)
        best = max(best, indel_ratio(short, long_[start:start + len(short)]))
        if best > 99.5:
            return 100
    return round(best)


#: Pairs of texts whose score a worker remembers, and how long a text of them may be.
PAIRS, SHORT = 100_000, 400


@lru_cache(maxsize=PAIRS)
def repeated_partial_score(needle: str, hay: str) -> int:
    return partial_score(needle, hay)


@F.pandas_udf(IntegerType())
def partial_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    score = lambda x, y: (repeated_partial_score if len(x) <= SHORT and len(y) <= SHORT else partial_score)(x, y)
    return pd.Series([score(x, y) if x and y else 0 for x, y in zip(a, b)], dtype="Int32")


def word_overlap(words: Column, context_words: Column) -> Column:
    """Share of distinct words that occur among the context's words."""
    distinct = F.array_distinct(words)
    return F.when(F.size(distinct) > 0, F.size(F.array_intersect(distinct, context_words)) / F.size(distinct)).otherwise(F.lit(0.0))


SIGNIFICANT_STOP = ["with", "from", "that", "this", "type", "stage", "grade", "unspecified", "specified"]


def significant_words(name: Column) -> Column:
    """Distinct words of four or more letters, less qualifiers."""
    found = F.regexp_extract_all(F.lower(name), F.lit("[a-z]{4,}"), F.lit(0))
    return F.array_distinct(F.array_except(found, tx.literal_array(SIGNIFICANT_STOP)))


def same_condition(a: Column, b: Column, a_keys: Column, b_keys: Column, a_words: Column, b_words: Column) -> Column:
    """Whether two names denote one condition: containment, variant keys or shared words."""
    inside = lambda x, y: F.contains(x, y) | F.contains(y, x)
    keys = F.exists(a_keys, lambda k: F.exists(b_keys, lambda j: inside(k, j)))
    shared = F.size(F.array_intersect(a_words, b_words))
    smaller = F.least(F.size(a_words), F.size(b_words))
    return inside(a, b) | keys | ((smaller > 0) & (shared / smaller >= 0.70))
