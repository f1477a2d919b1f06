"""Files, reruns and streams."""
import json

from pyspark.sql import functions as F

from notecoder.operators import results as rs
from notecoder.sources import tables as src
from notecoder.streaming import jobs


def test_replacing_results_is_idempotent(spark, tmp_path):
    path = str(tmp_path / "results")
    make = lambda docs, v: spark.createDataFrame([(d, i, f"{v}{i}") for d in docs for i in range(2)], "doc_id long, ord long, disease string")
    rs.replace_document_results(make(range(20), "a"), path, buckets=4)
    for _ in range(2):
        rs.replace_document_results(make([3, 4], "b"), path, buckets=4)
    got = spark.read.parquet(path).groupBy("doc_id").agg(F.array_sort(F.collect_list("disease")).alias("d")).collect()
    assert {r.doc_id: r.d for r in got} == {d: (["b0", "b1"] if d in (3, 4) else ["a0", "a1"]) for d in range(20)}


def test_code_table_headers_and_last_row_wins(spark):
    df = spark.createDataFrame([("A1", "Old", None, 1), ("A1", "New", "HCC", 2), (None, "x", None, 3)], "CODE string, `Long Description` string, `HCC status` string, n int")
    rows = src.code_table(df, seq=F.col("n")).collect()
    assert [(r.code, r.description, r.hcc_status) for r in rows] == [("A1", "New", "HCC")]


def test_ground_truth_and_replies(spark, tmp_path):
    truth = {"documents": [{"document_id": "d1", "diseases": [{"name": "Asthma", "icd_code": "J45.909", "meat_valid": True}, {"name": "Gout", "icd_code": "M10.9", "negated": True}]}]}
    (tmp_path / "t.json").write_text(json.dumps(truth, indent=1))
    rows = src.read_ground_truth(spark, str(tmp_path / "t.json")).orderBy("ord").collect()
    assert [(r.doc_id, r.disease, r.meat_valid, r.negated) for r in rows] == [("d1", "Asthma", True, False), ("d1", "Gout", False, True)]
    (tmp_path / "r.json").write_text('{"doc_id": 1, "stage": "a", "raw": "{}"}\n')
    assert src.read_replies(spark, str(tmp_path / "r.json")).first().stage == "a"


def test_stream_equals_batch_and_drops_repeats(spark, tmp_path):
    source, out = str(tmp_path / "in"), str(tmp_path / "out")
    notes = spark.createDataFrame([(1, "HTN"), (2, "Asthma"), (2, "Asthma")], "doc_id long, text string").withColumn("arrived", F.lit("2024-01-01").cast("timestamp"))
    notes.write.parquet(source)
    code = lambda df: df.select("doc_id", F.upper("text").alias("disease"), F.lit(0).alias("ord"))
    stream = spark.readStream.schema(notes.schema).parquet(source)
    query = jobs.code_stream(stream, code, lambda df, ran: rs.replace_document_results(df, out, buckets=2, processed=ran), str(tmp_path / "cp"))
    query.awaitTermination(90)
    assert sorted((r.doc_id, r.disease) for r in spark.read.parquet(out).collect()) == [(1, "HTN"), (2, "ASTHMA")]
