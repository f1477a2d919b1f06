"""Toxicity: cumulative-link ordinal regression on sparse text features.

Grades are ordered: 0 for clean texts, then toxic texts by the share of telling words. One
weight per feature serves all thresholds: P(grade > k) = sigmoid(score - threshold_k). The
model is fitted on a bounded sample of labelled rows; every document is scored.
"""
from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import ship_package

#: Hashed features, and the most labelled rows the model is fitted on (the lowest by a hash of the id).
FEATURES, SAMPLE = 1 << 18, 6000
#: Lengths of word beginnings that are features beside the word, and documents of the sample a feature is in.
BEGINNINGS, MIN_DOCS = (4, 5, 6, 7), 10
#: Probability of a grade above 0 from which a text counts as toxic.
TOXIC = 0.4
#: A feature's value is its share of the words times this.
SCALE = 50.0
EDGE = ".,;:!?\"'()[]{}<>«»„“”…*#$%&|_-/\\"


def word_features(word: str) -> list[int]:
    """Numbers of a word's features: the word without punctuation at its ends, and its beginnings."""
    bare = word.strip(EDGE)
    parts = [bare] * bool(bare) + ["^" + bare[:n] for n in BEGINNINGS if len(bare) > n]
    return [xxhash.xxh64_intdigest(x.encode(), 5) % FEATURES for x in parts]


class _PerWord(dict):
    """A function of words, remembered; starts anew when large, which changes no value."""

    def __init__(self, of):
        super().__init__()
        self.of = of

    def __missing__(self, word: str):
        if len(self) > 400_000:
            self.clear()
        value = self[word] = self.of(word)
        return value


def features(text: str | None, known: _PerWord) -> tuple[np.ndarray, np.ndarray]:
    """Distinct feature numbers of a text and their values; a text without words has none."""
    found = (text or "").lower().split()
    ids, counts = np.unique(np.array([i for w in found for i in known[w]], np.int32), return_counts=True)
    return ids, (SCALE * counts / max(1, len(found))).astype(np.float32)


@dataclass(frozen=True)
class Model:
    """Weights of features, ascending thresholds between grades."""

    ids: np.ndarray
    weights: np.ndarray
    thresholds: np.ndarray

    def dense(self) -> np.ndarray:
        out = np.zeros(FEATURES)
        out[self.ids] = self.weights
        return out


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -35, 35)))


def fit(rows: list[tuple[np.ndarray, np.ndarray]], grades: np.ndarray, levels: int, penalty: float = 0.3, rounds: int = 300) -> Model:
    """Maximum likelihood with a squared penalty, by gradient steps of adaptive size.

    Thresholds are a first one and positive gaps, so they stay in order.
    """
    used, column = np.unique(np.concatenate([r[0] for r in rows]) if rows else np.zeros(0, np.int64), return_inverse=True)
    row = np.repeat(np.arange(len(rows)), [len(r[0]) for r in rows])
    value = np.concatenate([r[1] for r in rows]) if rows else np.zeros(0)
    n = max(1, len(rows))
    shares = np.array([(grades > k).mean() if len(grades) else 0.5 for k in range(levels - 1)]).clip(1e-4, 1 - 1e-4)
    start = np.log((1 - shares) / shares)
    gaps = np.log(np.maximum(np.diff(start), 1e-2))
    params = [np.zeros(len(used)), start[:1].copy(), gaps]
    moments = [(np.zeros_like(p), np.zeros_like(p)) for p in params]
    for t in range(1, rounds + 1):
        w, first, gap = params
        cut = np.concatenate([first, first + np.cumsum(np.exp(gap))])
        score = np.bincount(row, value * w[column], minlength=len(rows))
        # P(grade > k), bordered by 1 and 0; the likelihood of a grade is a difference of neighbours
        above = np.concatenate([np.ones((len(rows), 1)), _sigmoid(score[:, None] - cut), np.zeros((len(rows), 1))], axis=1)
        here, slope = np.maximum(above[:, :-1] - above[:, 1:], 1e-12), above * (1 - above)
        at = np.arange(len(rows))
        p = here[at, grades]
        upper, lower = slope[at, grades], slope[at, grades + 1]
        d_score = -(upper - lower) / p / n
        d_cut = np.zeros((len(rows), levels + 1))
        d_cut[at, grades] += upper / p / n
        d_cut[at, grades + 1] -= lower / p / n
        d_cut = d_cut[:, 1:-1].sum(axis=0)
        grads = [np.bincount(column, value * d_score[row], minlength=len(used)) + penalty * w / n, d_cut.sum(keepdims=True),
                 np.array([d_cut[i + 1:].sum() for i in range(len(gap))]) * np.exp(gap)]
        for i, g in enumerate(grads):
            m, v = moments[i]
            m[:] = 0.9 * m + 0.1 * g
            v[:] = 0.999 * v + 0.001 * g * g
            params[i] = params[i] - 0.3 / (1 + t / 100) * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-9)
    w, first, gap = params
    return Model(used, w, np.concatenate([first, first + np.cumsum(np.exp(gap))]))


def graded(rows: list[tuple[np.ndarray, np.ndarray]], toxic: np.ndarray, levels: int) -> np.ndarray:
    """Grades of labelled texts: clean ones 0, toxic ones by equal parts of their telling share.

    Telling features are at least three times as frequent, by documents, in toxic texts.
    """
    out = np.zeros(len(rows), np.int64)
    if not toxic.any():
        return out
    seen = lambda which: np.bincount(np.concatenate([rows[i][0] for i in which] or [np.zeros(0, np.int64)]), minlength=FEATURES)
    bad, good = np.flatnonzero(toxic), np.flatnonzero(~toxic)
    p, q = (seen(bad) + 0.1) / (len(bad) + 1), (seen(good) + 0.1) / (len(good) + 1)
    telling = (p >= 3 * q) & (seen(bad) >= 3)
    share = np.array([(rows[i][1] * telling[rows[i][0]]).sum() for i in bad])
    edges = np.quantile(share, np.arange(1, levels - 1) / (levels - 1))
    out[bad] = 1 + np.searchsorted(edges, share, side="left")
    return out


def _sparse():
    @F.pandas_udf("ids array<int>, values array<float>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        known = _PerWord(word_features)
        for texts in batches:
            yield pd.DataFrame([features(t, known) for t in texts], columns=["ids", "values"])

    return run


def fitted(docs: DataFrame, labels: DataFrame, levels: int = 4, sample: int = SAMPLE) -> Model:
    """The model of at most ``sample`` labelled documents.

    Rows without id or label are left out, of repeated labels the least and of documents that
    share an id the one with the least hash of its text are taken, and equal texts count once.
    """
    ship_package(docs.sparkSession)
    known = labels.where("doc_id is not null and toxic is not null").groupBy(F.col("doc_id").alias("_id")).agg(F.min(F.col("toxic").cast("int")).alias("_toxic"))
    known = known.orderBy(F.xxhash64("_id"), "_id").limit(sample)
    # the sample's ids and labels are a few bytes each, so its bound is the broadcast's bound
    texts = docs.select(F.col("doc_id").alias("_id"), "text").join(F.broadcast(known), "_id")
    sparse = texts.select("_id", "_toxic", F.xxhash64("text").alias("_hash"), _sparse()("text").alias("_f"))
    one = sparse.groupBy("_id", "_toxic").agg(F.min("_hash").alias("_hash"), F.min_by("_f", "_hash").alias("_f"))
    read = {}
    for r in one.toLocalIterator():
        read[r["_id"]] = (r["_toxic"], r["_hash"], np.array(r["_f"]["ids"], np.int32), np.array(r["_f"]["values"], np.float32))
    by_text = {v[1]: v for _, v in sorted(read.items(), reverse=True)}
    used = list(by_text.values())
    docs_of = np.bincount(np.concatenate([v[2] for v in used] or [np.zeros(0, np.int32)]), minlength=FEATURES)
    enough = docs_of >= min(MIN_DOCS, max(2, len(used) // 200))
    rows = [(v[2][enough[v[2]]], v[3][enough[v[2]]]) for v in used]
    return fit(rows, graded(rows, np.array([v[0] > 0 for v in used], bool), levels), levels)


def _scorer(model: Model):
    @F.pandas_udf("score double, severity double, toxic boolean, grades array<double>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        weights = model.dense()
        # values are shares of words, so a text's score is the mean of its words' scores
        known = _PerWord(lambda w: SCALE * float(weights[word_features(w)].sum()))
        for texts in batches:
            out = []
            for t in texts:
                found = (t or "").lower().split()
                score = sum(map(known.__getitem__, found)) / max(1, len(found))
                above = np.concatenate([[1.0], _sigmoid(score - model.thresholds), [0.0]])
                grades = above[:-1] - above[1:]
                out.append((score, float(above[1:-1].sum()), bool(above[1] >= TOXIC), grades.tolist()))
            yield pd.DataFrame(out, columns=["score", "severity", "toxic", "grades"])

    return run


def scored(docs: DataFrame, model: Model) -> DataFrame:
    """``docs`` but the text, with ``score``, expected ``severity``, ``toxic`` and ``grades`` (their probabilities).

    A map over rows. A null or wordless text has score 0. Repeated rows score alike; columns
    named like the new ones are replaced.
    """
    ship_package(docs.sparkSession)
    new = {"score", "severity", "toxic", "grades", "text"}
    keep = [F.col(f"`{c}`") for c in docs.columns if c.lower() not in new]
    return docs.select(*keep, _scorer(model)("text").alias("__t")).select(*keep, "__t.*")
