"""Accuracy of predictions against labelled documents."""
from __future__ import annotations

from collections import deque
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

from ..functions import similarity as sim


def prf(tp: Column, fp: Column, fn: Column) -> dict[str, Column]:
    p = F.when(tp + fp > 0, tp / (tp + fp)).otherwise(F.lit(0.0))
    r = F.when(tp + fn > 0, tp / (tp + fn)).otherwise(F.lit(0.0))
    f1 = F.when(p + r > 0, 2 * p * r / (p + r)).otherwise(F.lit(0.0))
    return {"precision": F.bround(p, 4), "recall": F.bround(r, 4), "f1": F.bround(f1, 4)}


def counted(names: DataFrame) -> DataFrame:
    """Lower-case names of a document with how often each occurs."""
    return names.groupBy("doc_id", F.trim(F.lower("disease")).alias("name")).agg(F.count("*").alias("n"))


def detection(predicted: DataFrame, expected: DataFrame) -> DataFrame:
    """Detection scores per document with one-to-one matching of equal names.

    The matched number of a name is the smaller of its two counts, so no group is walked.
    """
    p = counted(predicted).withColumnRenamed("n", "p")
    e = counted(expected.where(~F.col("negated"))).withColumnRenamed("n", "e")
    j = p.join(e, ["doc_id", "name"], "full").na.fill(0, ["p", "e"])
    g = j.groupBy("doc_id").agg(F.sum(F.least("p", "e")).alias("tp"), F.sum("p").alias("predicted"), F.sum("e").alias("expected"))
    g = g.select("doc_id", "tp", (F.col("predicted") - F.col("tp")).alias("fp"), (F.col("expected") - F.col("tp")).alias("fn"))
    return g.withColumns(prf(F.col("tp"), F.col("fp"), F.col("fn")))


def detection_fuzzy(predicted: DataFrame, expected: DataFrame, threshold: int = 80) -> DataFrame:
    """Detection scores with greedy one-to-one matching at a token-set score.

    Every occurrence counts. A document's rows meet in one shuffle as two arrays in the order of ``ord``; each
    prediction takes the first expected occurrence that is free. A worker scores each pair of names once.
    """
    each = lambda df, side: df.select("doc_id", F.lit(side).alias("_side"), F.struct("ord", F.trim(F.lower("disease")).alias("name")).alias("_x"))
    both = each(predicted, "p").unionByName(each(expected.where(~F.col("negated")), "e"))
    of = lambda side: F.array_sort(F.collect_list(F.when(F.col("_side") == side, F.col("_x"))))["name"].alias(f"_{side}")
    g = both.groupBy("doc_id").agg(of("p"), of("e"))
    tp = _matcher(threshold)(F.col("_p"), F.col("_e"))
    g = g.select("doc_id", tp.alias("tp"), F.size("_p").cast("bigint").alias("p"), F.size("_e").cast("bigint").alias("e"))
    g = g.select("doc_id", "tp", (F.col("p") - F.col("tp")).alias("fp"), (F.col("e") - F.col("tp")).alias("fn"))
    return g.withColumns(prf(F.col("tp"), F.col("fp"), F.col("fn")))


#: Pairs of names a worker remembers the score of.
PAIRS = 100_000


@lru_cache(maxsize=PAIRS)
def repeated_score(a: str, b: str) -> int:
    return sim.token_set_score(a, b)


def matched(predicted: list, expected: list, threshold: int) -> int:
    """How many predictions in turn find a free expected name that scores the threshold; a null matches nothing.

    Equal expected names are free in turn, so a prediction looks at each distinct one once.
    """
    free: dict[str, deque[int]] = {}
    for at, name in enumerate(expected):
        if name is not None:
            free.setdefault(name, deque()).append(at)
    alike = lru_cache(maxsize=None)(lambda p: [e for e in free if repeated_score(p, e) >= threshold])
    found = 0
    for p in predicted:
        if p is not None and (first := min((e for e in alike(p) if free[e]), key=lambda e: free[e][0], default=None)) is not None:
            free[first].popleft()
            found += 1
    return found


def _matcher(threshold: int):
    @F.arrow_udf(LongType())
    def run(predicted: pa.Array, expected: pa.Array) -> pa.Array:
        return pa.array([matched(p, e, threshold) for p, e in zip(predicted.to_pylist(), expected.to_pylist())], pa.int64())

    return run


def by_name(rows: DataFrame, *fields: str) -> DataFrame:
    """The first row of each name of a document."""
    return rows.groupBy("doc_id", F.trim(F.lower("disease")).alias("name")).agg(
        *[F.min_by(f, "ord").alias(f"_{f}") for f in fields])


def codes(predicted: DataFrame, expected: DataFrame) -> DataFrame:
    """Exact and top-three code accuracy over expected rows that are not negated."""
    p = by_name(predicted, "icd_code", "candidates")
    e = expected.where(~F.col("negated")).select("doc_id", F.trim(F.lower("disease")).alias("name"), F.upper(F.trim("icd_code")).alias("want"))
    j = e.join(p, ["doc_id", "name"], "left")
    exact = F.coalesce(F.upper(F.trim("_icd_code")) == F.col("want"), F.lit(False))
    top = exact | F.coalesce(F.array_contains(F.transform(F.slice("_candidates", 1, 3), lambda c: F.upper(F.trim(c))), F.col("want")), F.lit(False))
    g = j.groupBy("doc_id").agg(F.count("*").alias("total_expected"), F.count_if(exact).alias("exact_correct"), F.count_if(top).alias("top3_correct"))
    rate = lambda c: F.bround(F.col(c) / F.col("total_expected"), 4)
    return g.withColumns({"exact_match_accuracy": rate("exact_correct"), "top3_accuracy": rate("top3_correct")})


def validity(predicted: DataFrame, expected: DataFrame) -> DataFrame:
    """Confusion counts of the validity flag; a missing prediction counts only where one was due."""
    e = expected.where(~F.col("negated")).select("doc_id", F.trim(F.lower("disease")).alias("name"), F.col("meat_valid").alias("want"))
    j = e.join(by_name(predicted, "meat_valid"), ["doc_id", "name"], "left")
    got, want = F.col("_meat_valid"), F.col("want")
    n = lambda test: F.count_if(F.coalesce(test, F.lit(False)))
    g = j.groupBy("doc_id").agg(
        n(want & got).alias("tp"), n(~want & got).alias("fp"), n(want & (got.isNull() | ~got)).alias("fn"), n(~want & ~got).alias("tn"))
    return g.withColumns(prf(F.col("tp"), F.col("fp"), F.col("fn")))


def macro(detected: DataFrame, coded: DataFrame, valid: DataFrame) -> DataFrame:
    """Means over the documents that have results."""
    j = detected.select("doc_id", "f1").join(coded.select("doc_id", "exact_match_accuracy", "top3_accuracy"), "doc_id").join(
        valid.select("doc_id", F.col("f1").alias("valid_f1")), "doc_id")
    avg = lambda c: F.bround(F.avg(c), 4)
    return j.agg(F.count("*").alias("num_documents"), avg("f1").alias("avg_detection_f1"), avg("exact_match_accuracy").alias("avg_icd_exact"),
                 avg("top3_accuracy").alias("avg_icd_top3"), avg("valid_f1").alias("avg_meat_f1"))
