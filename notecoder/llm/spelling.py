"""Spelling variants: words at an edit distance of one, by a trie of letter-group counts.

A word's letters are counted by group; the counts, group by group, are its path in a trie, and
words that differ by one edit differ by at most one count too many and one too few. So a search
down the trie spends a budget of one surplus and one deficit, and the words of the leaves that it
reaches are verified letter by letter.

The trie is cut into shards by the first counts of a path; a word is stored in its own shard and
asks in every shard that its budget can reach. Shards of many words are dealt into pieces, and
every piece of askers meets every piece of stored words, so no group outgrows a task.
"""
from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import ship_package
from .shared import written
from .terms import texts

#: Letters with a group of their own, the most frequent ones, and groups of the other letters.
ALONE, SHARED = 16, 8
#: Stored words and askers of one piece of a shard, and the mean of stored words that sets the depth of shards.
STORED, ASKERS, MEAN = 10_000, 20_000, 2_500
#: Parts of a path's rows where they meet the figures of their shard.
SALTS = 32
#: The greatest depth of shards; an asker reaches 1 + depth * (depth + 1) shards at most.
DEPTH = 6
#: Words that a task counts before it hands them on, and states or pairs that are looked at together.
COUNTED, TOGETHER = 400_000, 1_000_000
#: One run in so many, by its checksum, loses a letter.
MARRED = 97

#: Latin-1 bytes: letters, A-Z lower-cased; the rest separates.
_TABLE = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 192 else 32 for b in range(256))


def _words(least: int):
    """Counts of the words of a task: runs of letters, some without the letter that their checksum names."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: Counter = Counter()

        def out() -> pa.RecordBatch:
            batch = pa.RecordBatch.from_pydict({
                "word": pa.array([w.decode("latin-1") for w in total], pa.string()), "n": pa.array(list(total.values()), pa.int64())})
            total.clear()
            return batch

        for ids, bodies in texts(batches):
            for i, body in zip(ids.to_pylist(), bodies):
                if not body:
                    continue
                start = zlib.crc32(f"{'' if i is None else i}:".encode())
                # what lies beyond U+00FF becomes '?', a separator
                for w, n in Counter(body.decode("utf-8", "replace").encode("latin-1", "replace").translate(_TABLE).split()).items():
                    h = zlib.crc32(w if w.isascii() else w.decode("latin-1").encode(), start)
                    if h % MARRED == 0:
                        k = h % len(w)
                        w = w[:k] + w[k + 1:]
                    if len(w) >= least:
                        total[w] += n
                if len(total) > COUNTED:
                    yield out()
        yield out()

    return count


def vocabulary(docs: DataFrame, least_length: int = 5, least_count: int = 3) -> DataFrame:
    """``word, n`` of all words of ``doc_id``, ``text`` with enough letters and occurrences.

    Words are runs of ASCII letters (A-Z lower-cased) and U+00C0 to U+00FF; a run whose checksum
    with the document's id (a null id is empty) can be divided by ``MARRED`` loses one letter.
    """
    ship_package(docs.sparkSession)
    counted = docs.select("doc_id", "text").mapInArrow(_words(least_length), "word string, n bigint")
    return counted.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= least_count)


def letter_groups(counts: dict[str, int]) -> dict[str, int]:
    """The level of each letter: frequent ones first and alone, the others dealt in turn."""
    ranked = sorted(counts, key=lambda c: (-counts[c], c))
    return {c: x if x < ALONE else ALONE + (x - ALONE) % SHARED for x, c in enumerate(ranked)}


def vectors(words: list[bytes], level: np.ndarray) -> np.ndarray:
    """Letter-group counts, one row a word."""
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    letters = np.frombuffer(b"".join(words), np.uint8)
    flat = np.repeat(np.arange(len(words)), sizes) * (ALONE + SHARED) + level[letters]
    return np.bincount(flat, minlength=len(words) * (ALONE + SHARED)).reshape(len(words), -1)


def _spread(depth: int) -> list[tuple[np.ndarray, int, int]]:
    """Changes of the first ``depth`` counts within the budget, and the surplus and deficit that each spends."""
    unit = np.eye(depth, dtype=np.int64)
    out = [(np.zeros(depth, np.int64), 0, 0)]
    out += [(unit[a], 1, 0) for a in range(depth)] + [(-unit[b], 0, 1) for b in range(depth)]
    return out + [(unit[a] - unit[b], 1, 1) for a in range(depth) for b in range(depth) if a != b]


def _paths(level: np.ndarray, depth: int):
    """Rows of a shard: its path, whether the word asks, and the budget it has spent on the way."""
    changes = _spread(depth)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words = [w.encode("latin-1") for w in batch.column(0).to_pylist()]
            if not words:
                continue
            v = vectors(words, level)[:, :depth]
            for change, surplus, deficit in [(None, 0, 0), *changes]:
                to = v if change is None else v + change
                ok = np.flatnonzero((to >= 0).all(axis=1))
                yield pa.RecordBatch.from_pydict({
                    "path": pa.array([r.tobytes() for r in to[ok].astype("<u4")], pa.binary()), "asks": pa.array(np.full(len(ok), change is not None)),
                    "surplus": pa.array(np.full(len(ok), surplus, np.int8)), "deficit": pa.array(np.full(len(ok), deficit, np.int8)),
                    "word": batch.column(0).take(pa.array(ok)), "n": batch.column(1).take(pa.array(ok))})

    return cut


class Trie:
    """Rows of counts as levels of nodes; a node's children are found by its number and a count."""

    def __init__(self, v: np.ndarray):
        self.base = int(v.max(initial=0)) + 2
        node = np.zeros(len(v), np.int64)
        self.keys = []
        for at in range(v.shape[1]):
            keys, node = np.unique(node * self.base + v[:, at], return_inverse=True)
            self.keys.append(keys)
        self.node = node
        self.order = np.argsort(node, kind="stable")
        self.starts = np.searchsorted(node[self.order], np.arange(len(self.keys[-1]) + 1 if self.keys else 2))

    def reach(self, v: np.ndarray, surplus: np.ndarray, deficit: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Leaves within the budget of each row: row, leaf, surplus and deficit spent."""
        row, node = np.arange(len(v)), np.zeros(len(v), np.int64)
        for at, keys in enumerate(self.keys):
            parts = []
            for step in (0, 1, -1):
                free = slice(None) if step == 0 else np.flatnonzero((surplus if step > 0 else deficit) == 0)
                r, c = row[free], v[row[free], at] + step
                key = node[free] * self.base + c
                x = np.minimum(np.searchsorted(keys, key), len(keys) - 1)
                ok = np.flatnonzero((keys[x] == key) & (c >= 0) & (c < self.base))
                parts.append((r[ok], x[ok], surplus[free][ok] + (step > 0), deficit[free][ok] + (step < 0)))
            row, node, surplus, deficit = (np.concatenate(p) for p in zip(*parts))
        return row, node, surplus, deficit


def ranges(sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each of ``sizes`` things in turn: which one it belongs to, and its place inside."""
    at = np.repeat(np.arange(len(sizes)), sizes)
    return at, np.arange(len(at)) - np.repeat(np.cumsum(sizes) - sizes, sizes)


#: An odd base of polynomial hashes and its inverse, both modulo 2^64.
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)


class Letters:
    """Words as one buffer: padded rows, and hashes of any stretch."""

    def __init__(self, words: list[bytes]):
        self.sizes = np.fromiter(map(len, words), np.int64, len(words))
        self.starts = np.cumsum(self.sizes) - self.sizes
        self.buffer = np.frombuffer(b"".join(words), np.uint8)
        ones = np.ones(1, np.uint64)
        powers, self.inverses = (np.cumprod(np.concatenate([ones, np.full(len(self.buffer), b, np.uint64)])) for b in (_BASE, _INVERSE))
        self.sums = np.concatenate([ones - ones, np.cumsum(powers[:-1] * (self.buffer.astype(np.uint64) + ones))])

    def stretch(self, at: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Equal for equal letters from ``begin`` to ``end``, wherever they stand."""
        a = self.starts[at] + begin
        return (self.sums[self.starts[at] + end] - self.sums[a]) * self.inverses[a]

    def halves(self, at: np.ndarray, of: np.ndarray, tag: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Keys of the first and the last half of words compared with words of ``of`` letters."""
        half, size, zero = of // 2, self.sizes[at], np.zeros(len(at), np.int64)
        keys = self.stretch(at, zero, half), self.stretch(at, size - (of - half), size)
        return tuple((k ^ ((tag * 2 + side).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))) * np.uint64(0xFF51AFD7ED558CCD) for side, k in enumerate(keys))

    def rows(self, at: np.ndarray, width: int) -> np.ndarray:
        place = np.arange(width)
        inside = place < self.sizes[at][:, None]
        return np.where(inside, self.buffer[np.minimum(self.starts[at][:, None] + place, len(self.buffer) - 1)], 0)


def one_edit(a: Letters, x: np.ndarray, b: Letters, y: np.ndarray) -> np.ndarray:
    """Whether word ``y`` of ``b`` is word ``x`` of ``a`` with one letter replaced or one more."""
    out = np.zeros(len(x), bool)
    longer = b.sizes[y] - a.sizes[x]
    widths = 1 << np.ceil(np.log2(b.sizes[y] + 1)).astype(np.int64)
    for width in np.unique(widths):
        own = np.flatnonzero((widths == width) & (longer >= 0) & (longer <= 1))
        step = max(1, 16 * TOGETHER // int(width))
        for k in range(0, len(own), step):
            at = own[k:k + step]
            p, q = a.rows(x[at], int(width)), b.rows(y[at], int(width))
            unlike = p != q
            shifted = p[:, :-1] != q[:, 1:]
            last = np.where(shifted.any(axis=1), width - 2 - np.argmax(shifted[:, ::-1], axis=1), -1)
            first = np.where(unlike.any(axis=1), np.argmax(unlike, axis=1), width)
            out[at] = np.where(longer[at] == 1, last < first, unlike.sum(axis=1) == 1)
    return out


def _near(level: np.ndarray, depth: int):
    """Near words of one piece of a shard, combined by word."""

    def pairs(group: pd.DataFrame) -> pd.DataFrame:
        asks = group["asks"].to_numpy()
        sides = [group[~asks], group[asks]]
        if not (len(sides[0]) and len(sides[1])):
            return pd.DataFrame({"word": [], "n_near": [], "best_n": [], "best": []})
        words = [[w.encode("latin-1") for w in s["word"]] for s in sides]
        stored, asking = Letters(words[0]), Letters(words[1])
        vs, va = (vectors(w, level)[:, depth:] for w in words)
        trie = Trie(vs)
        spent = [sides[1][c].to_numpy().astype(np.int64) for c in ("surplus", "deficit")]
        # one edit leaves the first or the last half of the shorter word as it is: a leaf's words by their halves
        every = np.arange(len(vs))
        keys = np.concatenate([k for d in (0, 1) for k in stored.halves(every, stored.sizes - d, trie.node * 2 + d)])
        order = np.argsort(keys, kind="stable")
        keys, held = keys[order], np.tile(every, 4)[order]
        # words with the same counts and budget search as one
        alike = Trie(np.column_stack([va, *spent]))
        one = alike.order[alike.starts[:-1]]
        found = []
        for k in range(0, len(one), TOGETHER // 64):
            own = one[k:k + TOGETHER // 64]
            row, leaf, surplus, deficit = trie.reach(va[own], spent[0][own], spent[1][own])
            keep = np.flatnonzero(surplus >= deficit)  # the asker is the shorter word
            row, leaf, longer = row[keep] + k, leaf[keep], (surplus - deficit)[keep]
            for begin in range(0, len(row), TOGETHER // 64):
                part = slice(begin, begin + TOGETHER // 64)
                at, inside = ranges(np.diff(alike.starts)[row[part]])
                x = alike.order[alike.starts[row[part]][at] + inside]
                for key in asking.halves(x, asking.sizes[x], leaf[part][at] * 2 + longer[part][at]):
                    lo, hi = np.searchsorted(keys, key), np.searchsorted(keys, key, side="right")
                    to, inside = ranges(hi - lo)
                    y = held[lo[to] + inside]
                    ok = np.flatnonzero(one_edit(asking, x[to], stored, y))
                    found.append(x[to][ok] * len(vs) + y[ok])
        # a pair may agree in both halves
        x, y = np.divmod(np.unique(np.concatenate(found)) if found else np.zeros(0, np.int64), len(vs))
        first, second = sides[1].iloc[x], sides[0].iloc[y]
        # of words of one length the smaller asks
        ask, told = first["word"].to_numpy(object), second["word"].to_numpy(object)
        once = np.fromiter((len(p) < len(q) or p < q for p, q in zip(ask, told)), bool, len(ask))
        ask, told, n, m = ask[once], told[once], first["n"].to_numpy()[once], second["n"].to_numpy()[once]
        both = pd.DataFrame({"word": np.concatenate([ask, told]), "near": np.concatenate([told, ask]), "near_n": np.concatenate([m, n])})
        both = both.sort_values(["word", "near_n", "near"], ascending=[True, False, True], kind="stable")
        out = both.groupby("word", sort=False).agg(n_near=("near", "size"), best_n=("near_n", "first"), best=("near", "first"))
        return out.reset_index()

    return pairs


def near_words(words: DataFrame, stored: int = STORED, askers: int = ASKERS, mean: int = MEAN) -> DataFrame:
    """``word, n_near, best_n, best`` of every word of the written table ``words`` (``word, n``) that has a near one."""
    letters = words.select(F.explode(F.split("word", "")).alias("c")).where("c <> ''").groupBy("c").agg(F.count(F.lit(1)).alias("n"))
    groups = letter_groups({r.c: r.n for r in letters.collect()})  # no more rows than letters
    level = np.zeros(256, np.int64)
    for c, x in groups.items():
        level[ord(c)] = x
    # counts of the first letters, natively: how many shards there are at each depth
    first = ["".join(c for c in sorted(groups) if groups[c] == x) for x in range(DEPTH)]
    paths = [F.length("word") - F.length(F.translate("word", c, "")) if c else F.lit(0) for c in first]
    shards = words.agg(F.count(F.lit(1)).alias("n"), *[F.approx_count_distinct(F.concat_ws(",", *paths[:d])).alias(f"d{d}") for d in range(1, DEPTH + 1)]).first()
    depth = next((d for d in range(1, DEPTH) if shards.n <= mean * shards[f"d{d}"]), DEPTH)
    rows = words.select("word", "n").mapInArrow(
        _paths(level, depth), "path binary, asks boolean, surplus tinyint, deficit tinyint, word string, n bigint")
    rows = written(rows, "paths")
    held = rows.groupBy("path").agg(F.count_if(~F.col("asks")).alias("s"), F.count_if("asks").alias("a")).where("s > 0 and a > 0")
    held = held.select("path", F.ceil(F.col("s") / stored).cast("int").alias("s"), F.ceil(F.col("a") / askers).cast("int").alias("a"))
    # a path may hold a large share of the rows: salted, and the pieces are dealt by their own keys afterwards
    held = held.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    rows = rows.withColumn("salt", F.pmod(F.xxhash64("word"), F.lit(SALTS)).cast("int")).join(held, ["path", "salt"])
    own, other = F.when(F.col("asks"), F.col("a")).otherwise(F.col("s")), F.when(F.col("asks"), F.col("s")).otherwise(F.col("a"))
    rows = rows.select("*", F.pmod(F.xxhash64("word"), own).cast("int").alias("mine"), F.explode(F.sequence(F.lit(0), other - 1)).alias("theirs"))
    rows = rows.select("path", "asks", "surplus", "deficit", "word", "n", F.when(F.col("asks"), F.col("theirs")).otherwise(F.col("mine")).alias("x"),
                       F.when(F.col("asks"), F.col("mine")).otherwise(F.col("theirs")).alias("y"))
    found = rows.groupBy("path", "x", "y").applyInPandas(_near(level, depth), "word string, n_near bigint, best_n bigint, best string")
    best = F.min(F.struct((-F.col("best_n")).alias("n"), F.col("best").alias("word")))
    return found.groupBy("word").agg(F.sum("n_near").alias("n_near"), best.alias("b")).select(
        "word", "n_near", (-F.col("b.n")).alias("best_n"), F.col("b.word").alias("best"))


def grouped(docs: DataFrame, least_length: int = 5, least_count: int = 3, times: int = 2, **limits: int) -> DataFrame:
    """Words of a corpus with their near words and standard forms: ``word, form, root, n, n_near, form_n``.

    ``docs`` has ``doc_id`` and ``text``; further columns are not read. Words are those of
    ``vocabulary``. A word's form is its near word with the largest ``n`` (of equal ones the
    smallest in code-point order), if that is at least ``times`` its own ``n``; ``root`` is
    the end of the chain of forms. Words without near words have ``n_near`` 0. Null and empty
    texts have no words; repeated rows count again; an empty table gives no rows. ``limits``
    (``stored``, ``askers``, ``mean``) bound the pieces of a shard and don't change results.
    """
    if times < 2:
        raise ValueError("forms must be at least twice as frequent, so that chains end")
    words = written(vocabulary(docs, least_length, least_count), "words")
    near = words.join(near_words(words, **limits), "word", "left")
    takes = F.col("best_n") >= times * F.col("n")
    near = written(near.select(
        "word", "n", F.coalesce("n_near", F.lit(0)).cast("bigint").alias("n_near"), F.when(takes, F.col("best")).alias("form"),
        F.when(takes, F.col("best_n")).alias("form_n")), "near")
    # n at least doubles along a chain, so its length is known; each round doubles what a row has followed
    top = near.agg(F.max("n").alias("n")).first().n or 1
    chain = max(1, int(top).bit_length())
    far = near.where("form is not null").select("word", F.col("form").alias("root"))
    done = 1
    while done < chain:
        ahead = far.select(F.col("word").alias("root"), F.col("root").alias("next"))
        far = written(far.join(ahead, "root", "left").select("word", F.coalesce("next", "root").alias("root")), "roots")
        done *= 2
    return near.join(far, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
