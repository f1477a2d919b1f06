"""The pipeline's stages on a small corpus with a case for each."""
import random

from pyspark.sql import functions as F

import corpus_pipeline
from notecoder.llm.queries import QUERIES


def corpus():
    rng = random.Random(9)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 8)))
    prose = lambda n: " ".join(rng.choice(["the", "of", "and"]) if rng.random() < 0.3 else word() for _ in range(n))
    item = prose(30)
    rows = [(i, prose(80) + ("\nall rights reserved by the owner of this text" if i < 15 else "")) for i in range(20)]
    rows += [(30, rows[17][1]), (31, rows[17][1] + " more"), (32, prose(60) + " " + item + " " + prose(60)), (33, "too short"), (34, None),
             (35, " ".join(w + "###" for w in prose(90).split())), (36, rows[18][1]), (36, rows[18][1])]
    return rows, item


def test_stages(spark, tmp_path):
    rows, item = corpus()
    spark.createDataFrame([(*r, "en", 1) for r in rows], "doc_id int, text string, lang string, kept int").repartition(3).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(0, item)], "item_id int, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    columns, ids = docs.columns, []
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, str(tmp_path))
        path = str(tmp_path / name)
        docs.write.parquet(path)
        docs = spark.read.parquet(path)
        ids.append(sorted(r.doc_id for r in docs.select("doc_id").collect()))
        if name != "sentencepiece":
            assert docs.columns == columns
        if name == "line_dedup":
            texts = {r.doc_id: r.text for r in docs.collect()}
            assert "all rights" in texts[0] and not any("all rights" in texts[i] for i in range(1, 15))
    clean = list(range(20))
    assert ids[0] == sorted(clean + [30, 31, 32, 36, 36]) == ids[1]
    assert ids[2] == sorted(clean + [32]) and ids[3] == clean == ids[4]
    out = corpus_pipeline.run(spark, str(tmp_path))
    assert sorted(r.doc_id for r in out.select("doc_id").collect()) == clean
    assert corpus_pipeline.ORACLE_SQL is None and len(QUERIES) == 13


def line_stage(spark, *lines):
    rows = [(i, "{0}{0} {0}q {0}z\n".format(chr(97 + i)) + line) for i, line in enumerate(lines)]
    out = corpus_pipeline.line_dedup(spark, spark.createDataFrame(rows, "doc_id int, text string"), "")
    return [r.text.count("\n") for r in out.orderBy("doc_id").collect()]


def test_varying_fields_anywhere(spark):
    a, b = "abcdefghijkl", "mnopqrstuvwx"
    assert line_stage(spark, *[f"read more about {x} and {y} in our weekly letter" for x, y in zip(a, b)]) == [1] + [0] * 11
    # one value of a field is in most lines, and other lines share the leaf
    varied = [f"read more about {'sports' if i < 11 else x} and {y} {y}{y} in our letter today" for i, (x, y) in enumerate(zip(a, b))]
    prose = [f"read more {x}1 {x}{y} {y} {y}{y} {x}{x} {y}{x} it {x}{y}{x} {y}" for x, y in zip(a[:8], b)]
    assert line_stage(spark, *varied, *prose) == [1] + [0] * 11 + [1] * 8


def test_varying_fields_of_short_lines(spark):
    a, b = "abcdefghijkl", "mnopqrstuvwx"
    assert line_stage(spark, *[f"Posted by {x}" for x in a]) == [1] + [0] * 11
    assert line_stage(spark, *[f"Filed under {x} by {y}" for x, y in zip(a, b)]) == [1] + [0] * 11
    assert line_stage(spark, *[f"{x} {y}" for x, y in zip(a, b)], *["Posted by me"] * 3) == [1] * 15


def test_last_stage_delivers_ids_and_text(spark):
    rows = [(1, "some plain words"), (2, None)]
    out = {r.doc_id: r for r in corpus_pipeline.sentencepiece(spark, spark.createDataFrame(rows, "doc_id int, text string"), "").collect()}
    assert out[1].decoded == "some plain words" and len(out[1].ids) == out[1].n_tokens > 2 and out[2].decoded == "" and len(out[2].ids) == 2
