"""Held-out accuracy of the graded model, and the order of its thresholds."""
import random

import numpy as np

from notecoder.llm.toxicity import fit, fitted, scored


def test_thresholds_are_ordered_and_grades_found():
    rng = np.random.default_rng(1)
    x = rng.random(600)
    grades = np.digitize(x + 0.05 * rng.standard_normal(600), [0.3, 0.6, 0.8])
    model = fit([(np.array([3]), np.array([v])) for v in x], grades, 4, penalty=1e-4)
    assert (np.diff(model.thresholds) > 0).all()
    guess = np.digitize(model.weights[0] * x, model.thresholds)
    assert (guess == grades).mean() > 0.8


def corpus(n, seed):
    rng = random.Random(seed)
    fresh = lambda: "".join(rng.choice("abcdefgh") for _ in range(5))
    docs, labels = [], []
    for i in range(n):
        w = [fresh() for _ in range(rng.randint(30, 90))]
        bad = rng.random() < 0.25
        if bad:
            for _ in range(max(2, len(w) // 20)):
                w[rng.randrange(len(w))] = rng.choice(["nastyword", "Uglyterm!", "vileness"])
        docs.append((i, " ".join(w), "x"))
        labels.append((i, int(bad)))
    return docs, labels


def test_unlabelled_documents_are_told_apart(spark):
    docs, labels = corpus(500, 2)
    all_docs = spark.createDataFrame([*docs, (None, None, None), (9000, "", ""), (9001, docs[0][1], "y")], "doc_id int, text string, score string")
    known = spark.createDataFrame([*labels[:350], (None, 1), (3, None)], "doc_id int, toxic int")
    out = {r["doc_id"]: r for r in scored(all_docs, fitted(all_docs, known)).collect()}
    held = labels[350:]
    assert sum(out[i]["toxic"] == bool(t) for i, t in held) / len(held) > 0.93
    assert out[9000]["score"] == 0 and not out[9000]["toxic"] and not out[None]["toxic"] and out[9001]["severity"] == out[0]["severity"]
    assert abs(sum(out[1]["grades"]) - 1) < 1e-9
    severe = [out[i]["severity"] for i, t in held if t]
    assert np.mean(severe) > 5 * np.mean([out[i]["severity"] for i, t in held if not t])


def test_no_labels_and_empty_table(spark):
    docs = spark.createDataFrame([(1, "a b")], "doc_id int, text string")
    none = spark.createDataFrame([], "doc_id int, toxic int")
    assert scored(docs, fitted(docs, none)).count() == 1
    assert scored(docs.limit(0), fitted(docs.limit(0), none)).count() == 0
