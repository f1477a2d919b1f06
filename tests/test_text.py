import unicodedata

from pyspark.sql import functions as F

from notecoder.functions import text as tx
from notecoder.operators import sentences as se


def one(spark, fn, *values):
    df = spark.createDataFrame([(v,) for v in values], "v string")
    return [r[0] for r in df.select(fn(F.col("v"))).collect()]


def test_noise_and_whitespace(spark):
    got = one(spark, tx.remove_noise, "Page 1 of 3\nBP #5 seen 10/25/2023 10:30 AM * end")
    assert got == ["\nBP #5 seen    end"]
    ws = one(spark, tx.normalize_whitespace, "  a \t b  \n\n\n\n c \n")
    assert ws == ["a b\n\nc"]
    assert one(spark, tx.normalize_whitespace, ws[0]) == ws


def test_line_breaks_join_pairs_only(spark):
    assert one(spark, tx.fix_line_breaks, "dia-\nbetes", "one\ntwo\nthree", "Stop.\nnext", "A\n\nb") == [
        "diabetes", "one two\nthree", "Stop.\nnext", "A\n\nb"]


def test_sentences_keep_offsets(spark):
    text = " First one.  Second!\nThird? tail"
    df = spark.createDataFrame([(1, text)], "doc_id long, text string")
    rows = se.segment_sentences(df, offsets=True).orderBy("sentence_number").collect()
    assert [r.text for r in rows] == ["First one.", "Second!", "Third?", "tail"]
    assert all(text[r.start_char:r.end_char] == r.text for r in rows)
    plain = se.segment_sentences(df).orderBy("sentence_number").collect()
    assert [(r.sentence_number, r.text) for r in plain] == [(r.sentence_number, r.text) for r in rows]


def test_abbreviations(spark):
    got = one(spark, tx.expand_abbreviations, "HTN and htn", "RA with heart murmur", "RA of hands", "N/V today, f/u")
    assert got == [
        "Hypertension (HTN) and hypertension (htn)", "Right Atrium (RA) with heart murmur", "Rheumatoid Arthritis (RA) of hands",
        "Nausea and Vomiting (N/V) today, follow up (f/u)",
    ]


def test_diacritics_match_unicode_decomposition(spark):
    samples = ["Sjögren's (SS)", "café àéîõü ñ ç", "Ménière"]
    fold = lambda s: "".join(c for c in unicodedata.normalize("NFKD", s) if not unicodedata.combining(c))
    assert one(spark, tx.strip_diacritics, *samples) == [fold(s) for s in samples]
    assert one(spark, tx.clean_search_term, "Sjögren's (SS)") == ["sjogren"]


def test_codes_and_names(spark):
    assert one(spark, tx.format_code, "I10", "F419", "S3282XA", "G47.00") == ["I10", "F41.9", "S32.82XA", "G47.00"]
    assert one(spark, tx.clean_display_name, "Hypertension, stable on meds", "GERD") == ["Hypertension", "GERD"]
    keys = one(spark, tx.name_variants, "CKD 3")[0]
    assert {"ckd 3", "chronic kidney disease 3", "chronic kidney disease"} <= set(keys)
