"""What a worker holds while it encodes: bounded memories, few rows at a time."""
from pyspark.sql import functions as F

from notecoder.llm import pieces


def test_small_parts_and_bounded_memories(spark):
    assert pieces.ROWS <= 256 and pieces.REMEMBERED <= 50_000
    encoder = pieces._encoder(pieces.model_path())
    assert encoder.fits.cache_info().maxsize == encoder.options.cache_info().maxsize == pieces.REMEMBERED
    # more rows than one part holds keep their order and number
    docs = spark.range(0, 3 * pieces.ROWS + 5, 1, 1).select(F.col("id").alias("doc_id"), F.concat(F.lit("word "), F.col("id")).alias("text"))
    rows = pieces.encoded(docs, full=True).collect()
    assert sorted((r.doc_id, r.decoded) for r in rows) == [(i, f"word {i}") for i in range(3 * pieces.ROWS + 5)]
