"""Benchmark passages that are documents of their own."""
from notecoder.llm.contamination import checked


def test_documents_shorter_than_an_item(spark):
    w = [f"w{chr(97 + i // 26)}{chr(97 + i % 26)}" for i in range(60)]
    other = w[:20] + ["x"] + w[21:]
    # 56 shingles: 45 of them are 0.8, 44 are not; the last has 55 words of which five shingles differ
    docs = [(0, w), (1, w[:59]), (2, w[11:]), (3, w[12:]), (4, w[:49]), (5, w[:48]), (6, w[:4]), (7, w[:15]), (8, other[:55]), (9, other[:50])]
    frame = spark.createDataFrame([(i, " ".join(x)) for i, x in docs], "doc_id int, text string")
    bench = spark.createDataFrame([(1, " ".join(w))], "item_id int, text string")
    for literals in (20_000, 0):
        found = sorted(r.doc_id for r in checked(frame, bench, literals).collect() if r.contaminated)
        grams = lambda x: {tuple(x[i:i + 5]) for i in range(len(x) - 4)}
        assert found == [i for i, x in docs if 5 * len(grams(x) & grams(w)) >= 4 * len(grams(x) | grams(w))] and {0, 1, 2, 4, 8} >= set(found) >= {0, 1, 2, 4}
