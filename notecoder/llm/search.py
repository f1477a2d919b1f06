"""Ranked lexical search, term at a time with a limit on new accumulators.

Documents are searched in blocks inside Spark tasks. In a block every item's terms are taken
rarest first (by the whole corpus); each posting adds to its document's accumulator. As soon as
the terms that remain cannot lift a new document to the k-th best partial score, no further
accumulators are made: the survivors alone are updated, exactly, by looking them up in the
remaining posting lists, so long lists of common terms are never walked. A task keeps k
documents an item, and what its blocks have found so far raises the bar of the next ones.
"""
from __future__ import annotations

import heapq
import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from ..session import ship_package
from .shared import written
from .terms import terms, texts

#: Distinct (item, term) pairs that are searched in one pass over the documents; more items take more passes.
PAIRS = 200_000
#: Postings of one block of documents in a task.
POSTINGS = 2_000_000


def _item_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for ids, bodies in texts(batches):
        rows = [(x, t, q) for x, body in enumerate(bodies) for t, q in Counter(terms(body)).items()]
        yield pa.RecordBatch.from_pydict({
            "item_id": ids.take(pa.array([r[0] for r in rows], pa.int64())),
            "term": pa.array([r[1] for r in rows], pa.binary()), "q": pa.array([r[2] for r in rows], pa.int64())})


def _postings(number: dict[bytes, int]):
    """Per document with terms: its length, and number and count of each query term."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, bodies in texts(batches):
            keep, lengths, numbers, counts = [], [], [], []
            for x, body in enumerate(bodies):
                words = terms(body)
                if words:
                    found = sorted((number[t], c) for t, c in Counter(words).items() if t in number)
                    keep.append(x)
                    lengths.append(len(words))
                    numbers.append([x for x, _ in found])
                    counts.append([c for _, c in found])
            yield pa.RecordBatch.from_pydict({
                "doc_id": ids.take(pa.array(keep, pa.int64())), "n": pa.array(lengths, pa.int64()),
                "terms": pa.array(numbers, pa.list_(pa.int32())), "counts": pa.array(counts, pa.list_(pa.int32()))})

    return cut


class Block:
    """Posting lists of some documents: for each term its documents, ascending, and impacts before the weight."""

    def __init__(self, ids: pa.Array, n: np.ndarray, sizes: np.ndarray, term: np.ndarray, tf: np.ndarray, width: int, corpus: tuple[int, int]):
        docs, length = corpus
        m = 25 + (75 * n * docs) // length
        doc = np.repeat(np.arange(len(ids)), sizes)
        tf = tf.astype(np.int64)
        impact = (1_000_000_000 * tf) // (1000 * tf + 8 * m[doc])
        order = np.argsort(term, kind="stable")
        self.doc, self.impact = doc[order], impact[order]
        self.starts = np.searchsorted(term[order], np.arange(width + 1))
        # place of each document among equal scores: ascending id, null last
        self.place = np.empty(len(ids), np.int64)
        self.place[pc.sort_indices(ids, null_placement="at_end").to_numpy()] = np.arange(len(ids))

    def postings(self, term: int) -> tuple[np.ndarray, np.ndarray]:
        a, b = self.starts[term], self.starts[term + 1]
        return self.doc[a:b], self.impact[a:b]

    def best(self, query: list[tuple[int, int]], k: int, bar: int) -> list[tuple[int, int]]:
        """The k best (score, document) of a query of (term, weight), rarest first; below ``bar`` they may be left out."""
        lists = [(w, *self.postings(t)) for t, w in query]
        bounds = [w * int(v.max()) if len(v) else 0 for w, _, v in lists]
        remaining = np.cumsum(bounds[::-1])[::-1]
        score = np.zeros(len(self.place), np.int64)
        made = np.zeros(0, np.int64)
        closed = False
        for (w, docs, impact), rest in zip(lists, remaining):
            if not closed:
                held = score[made]
                kth = max(bar, int(np.partition(held, -k)[-k]) if len(held) >= k else 0)
                if rest < kth:
                    # ties with the k-th may still win by a smaller id, so only what must stay below goes
                    closed, made = True, made[held + rest >= kth]
            if not closed:
                new = docs[score[docs] == 0] if w else docs[:0]
                score[docs] += w * impact
                made = np.concatenate([made, new[score[new] > 0]])
            elif len(docs) and len(made):
                at = np.minimum(np.searchsorted(docs, made), len(docs) - 1)
                score[made] += np.where(docs[at] == made, w * impact[at], 0)
        if len(made) > k:
            made = made[score[made] >= np.partition(score[made], -k)[-k]]
        made = made[np.lexsort((self.place[made], -score[made]))][:k]
        return [(int(score[d]), int(d)) for d in made]


def _search(item_ids: pa.Array, queries: list[list[tuple[int, int]]], width: int, corpus: tuple[int, int], k: int, id_type: pa.DataType):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tops: list[list] = [[] for _ in queries]
        held: list[pa.RecordBatch] = []

        def flush() -> None:
            if not held:
                return
            table = pa.Table.from_batches(held).combine_chunks()
            held.clear()
            lists, counts = table.column("terms").combine_chunks(), table.column("counts").combine_chunks()
            ids = table.column("doc_id").combine_chunks()
            block = Block(
                ids, table.column("n").to_numpy(), lists.value_lengths().to_numpy(),
                lists.flatten().to_numpy(), counts.flatten().to_numpy(), width, corpus)
            for x, query in enumerate(queries):
                bar = -tops[x][-1][0] if len(tops[x]) == k else 0
                found = [(-s, not ids[d].is_valid, ids[d].as_py()) for s, d in block.best(query, k, bar)]
                tops[x] = heapq.nsmallest(k, tops[x] + found, key=lambda r: r[:2] if r[1] else r)

        size = 0
        for batch in batches:
            held.append(batch)
            size += len(batch.column("terms").flatten())
            if size >= POSTINGS:
                flush()
                size = 0
        flush()
        rows = [(x, r[2], -r[0]) for x, top in enumerate(tops) for r in top]
        yield pa.RecordBatch.from_pydict({
            "item_id": item_ids.take(pa.array([r[0] for r in rows], pa.int64())),
            "doc_id": pa.array([r[1] for r in rows], id_type), "score": pa.array([r[2] for r in rows], pa.int64())})

    return run


def ranked(docs: DataFrame, items: DataFrame, k: int = 10, pairs: int = PAIRS) -> DataFrame:
    """The ``k`` best documents of each item: ``item_id, rank, doc_id, score``.

    ``docs`` has ``doc_id`` and ``text``, ``items`` has ``item_id`` and ``text``; further columns
    are not read. A null or empty text has no terms: such a document is never found and counts
    for nothing, such an item finds nothing. Documents with equal scores stand by ascending id, a
    null id last; repeated rows are documents of their own. Rows of one item id, null included,
    are one item with the terms of all. Only scores above 0 are returned, so empty tables give no
    rows.

    Corpus figures and document frequencies cover all documents. Items are searched in blocks of
    about ``pairs`` (item, term) pairs, so what a task holds does not grow with either table; a
    larger item is a block of its own.
    """
    spark = docs.sparkSession
    ship_package(spark)
    item_type = items.schema["item_id"].dataType.simpleString()
    asked = items.select("item_id", "text").mapInArrow(_item_terms, f"item_id {item_type}, term binary, q bigint")
    asked = written(asked.groupBy("item_id", "term").agg(F.sum("q").alias("q")), "asked")
    passes = max(1, math.ceil(asked.count() / pairs))
    out = [_pass(docs, items, part, k) for x in range(passes)
           if (part := asked.where(F.pmod(F.xxhash64("item_id"), F.lit(passes)) == x).collect())]
    if not out:
        return spark.createDataFrame([], f"item_id {item_type}, rank int, doc_id {docs.schema['doc_id'].dataType.simpleString()}, score bigint")
    found = out[0]
    for more in out[1:]:
        found = found.unionByName(more)
    order = Window.partitionBy("item_id").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("item_id", "rank", "doc_id", "score")


def _pass(docs: DataFrame, items: DataFrame, asked: list, k: int) -> DataFrame:
    id_type, item_type = docs.schema["doc_id"].dataType, items.schema["item_id"].dataType
    number = {t: x for x, t in enumerate(sorted({bytes(r.term) for r in asked}))}
    body = docs.select("doc_id", "text").mapInArrow(
        _postings(number), f"doc_id {id_type.simpleString()}, n bigint, terms array<int>, counts array<int>")
    body = written(body, "postings")
    corpus = body.agg(F.count(F.lit(1)).alias("docs"), F.coalesce(F.sum("n"), F.lit(0)).alias("length")).first()
    holders = body.select(F.explode("terms").alias("t")).groupBy("t").agg(F.count(F.lit(1)).alias("df"))
    df = {r.t: r.df for r in holders.collect()}  # no more rows than terms in ``asked``
    weight = {t: math.floor(1000 * math.log((2 * corpus.docs + 2) / (2 * n + 1))) for t, n in df.items()}
    by_item: dict = {}
    for r in asked:
        if (t := number[bytes(r.term)]) in df:
            by_item.setdefault(r.item_id, []).append((df[t], t, r.q * weight[t]))
    queries = [[(t, w) for _, t, w in sorted(q)] for q in by_item.values()]
    item_ids = pa.array(list(by_item), to_arrow_type(item_type))
    search = _search(item_ids, queries, len(number), (corpus.docs, corpus.length), k, to_arrow_type(id_type))
    return body.mapInArrow(search, f"item_id {item_type.simpleString()}, doc_id {id_type.simpleString()}, score bigint")
