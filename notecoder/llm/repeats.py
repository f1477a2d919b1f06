"""Windows of equal tokens that occur more than once anywhere in a corpus, found whole.

Both substring operators rest on these steps; tokens are bytes for one and words for the other.

1. Every window of ``length`` tokens has one anchor: the gram of ``gram`` tokens in it with the
   least hash, leftmost if tied. Equal windows have equal anchors at the same place, so windows
   need only be compared within an anchor's group. Neighbouring windows share their anchor: they
   form a segment.
2. Anchors that occur once are dropped by a count and a semi join. Equal segments of a group are
   told apart by a hash; only where a group has different segments are their tokens fetched.
3. Those are compared exactly in bundles of whole groups, by the method of the operator. A group
   of more than ``GROUP`` tokens is first cut: its segments are parted into windows with more room
   before and behind the anchor, which have more tokens in common with their equals than the
   anchor, ``CUTS`` times over; what they have in common names the new groups, and step 2
   is taken again. Groups still too large are split by the full text of each window, in Spark.
4. Spans come back per document, a list no longer than the document.

A document is known by its id and the hash of its text (``_rk``); rows that share both are one.
"""
from __future__ import annotations

import functools
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import ship_package
from .shared import written

#: Tokens compared in one bundle, tokens hashed in one block, tokens of a group that are compared in one task.
BUNDLE, BLOCK, GROUP = 400_000, 250_000, 500_000
#: Times that the segments of a larger group are parted in two.
CUTS = 3
PLACE_BITS = np.uint64(28)
PLACE = np.uint64((1 << 28) - 1)


@functools.lru_cache(1)
def _byte_values() -> np.ndarray:
    return np.random.default_rng(11).integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


@functools.lru_cache(8)
def _powers(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd base and of its inverse modulo 2^64."""
    def grow(b: int) -> np.ndarray:
        out = np.ones(n, np.uint64)
        out[1:] = b
        return np.multiply.accumulate(out)

    return grow(base), grow(pow(base, -1, 1 << 64))


class _Hashes:
    """Hashes of any range of a token sequence, from prefix sums modulo 2^64."""

    def __init__(self, values: np.ndarray, base: int):
        n = 1 << max(12, int(len(values) + 1).bit_length())
        up, self.down = _powers(base, n)
        self.sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(values * up[:len(values)], dtype=np.uint64)])

    def of(self, start, stop) -> np.ndarray:
        h = (self.sums[stop] - self.sums[start]) * self.down[start]
        h ^= h >> np.uint64(32)
        h *= np.uint64(0x9E3779B97F4A7C15)
        return h ^ (h >> np.uint64(29))


BASES = (0x5851F42D4C957F2D, 0xD1342543DE82EF95)


def sliding_least(x: np.ndarray, width: int) -> np.ndarray:
    """Least value of every ``width`` neighbours: running minima from both ends of blocks."""
    n = len(x) - width + 1
    blocks = np.concatenate([x, np.full(-len(x) % width, np.iinfo(x.dtype).max, x.dtype)]).reshape(-1, width)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    behind = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(behind[:n], ahead[width - 1:width - 1 + n])


def segments(values: np.ndarray, valid: np.ndarray, length: int, gram: int) -> tuple[np.ndarray, ...]:
    """Anchor hash, segment hash, first window and number of windows of each segment of a block.

    ``valid`` says of each window whether it lies in one document.
    """
    first = _Hashes(values, BASES[0])
    at = np.arange(len(values) - gram + 1)
    grams = first.of(at, at + gram)
    owner = (sliding_least((grams & ~PLACE) | at.astype(np.uint64), length - gram + 1) & PLACE).astype(np.int64)
    change = owner[1:] != owner[:-1]
    starts = np.flatnonzero(valid & np.concatenate([[True], change | ~valid[:-1]]))
    ends = np.flatnonzero(valid & np.concatenate([change | ~valid[1:], [True]]))
    n = ends - starts + 1
    body = _Hashes(values, BASES[1]).of(starts, ends + length)
    return grams[owner[starts]].view(np.int64), (body ^ n.astype(np.uint64)).view(np.int64), starts, n


class Bytes:
    """A text as UTF-8 bytes."""

    dtype = np.uint8

    @staticmethod
    def tokens(text: str | None) -> np.ndarray:
        return np.frombuffer((text or "").encode(), np.uint8)

    @staticmethod
    def values(tokens: np.ndarray) -> np.ndarray:
        return _byte_values()[tokens]

    @staticmethod
    def kept(text: str | None, spans: list[tuple[int, int]]) -> tuple[int, bytes]:
        raw, out, at = (text or "").encode(), [], 0
        for a, b in spans:
            out.append(raw[at:a])
            at = b
        return len(raw), b"".join([*out, raw[at:]])


class _WordValues(dict):
    """Words to 64-bit values; starts anew when large, which changes no value."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > 500_000:
            self.clear()
        value = self[word] = xxhash.xxh64_intdigest(word, 17)
        return value


_WORDS = _WordValues()


class Words:
    """A text as words ``[^\\x20\\x09-\\x0D]+``, each as a 64-bit value."""

    dtype = np.uint64

    @staticmethod
    def tokens(text: str | None) -> np.ndarray:
        found = (text or "").encode().split()
        return np.fromiter(map(_WORDS.__getitem__, found), np.uint64, len(found))

    @staticmethod
    def values(tokens: np.ndarray) -> np.ndarray:
        return tokens | np.uint64(1)

    @staticmethod
    def kept(text: str | None, spans: list[tuple[int, int]]) -> tuple[int, bytes]:
        found, out, at = (text or "").encode().split(), [], 0
        for a, b in spans:
            out.extend(found[at:a])
            at = b
        return len(found), b" ".join([*out, *found[at:]])


@dataclass(frozen=True)
class Search:
    """What repeats: the unit, the window, the anchor gram, and how windows are compared.

    ``classes(tokens, starts)`` numbers equal windows alike and gives -1 to windows without
    an equal. ``first_stays``: the earliest of equal windows is not removed.
    """

    unit: type
    length: int
    gram: int
    classes: Callable[[np.ndarray, np.ndarray], np.ndarray]
    first_stays: bool


def _anchors(search: Search):
    unit, length = search.unit, search.length

    def flush(parts: list[tuple]) -> Iterator[pd.DataFrame]:
        tokens = [p[3] for p in parts]
        sizes = np.array([len(t) for t in tokens])
        ends = np.cumsum(sizes)
        valid = np.ones(int(ends[-1]) - length + 1, bool)
        for e in ends[:-1]:
            valid[max(0, e - length + 1):e] = False
        g, s, p, n = segments(unit.values(np.concatenate(tokens)), valid, length, search.gram)
        which = np.searchsorted(ends, p, side="right")
        base = np.array([x[2] for x in parts]) - (ends - sizes)
        yield pd.DataFrame({"_doc": np.array([x[0] for x in parts])[which], "_rk": np.array([x[1] for x in parts])[which],
                            "g": g, "s": s, "p": (p + base[which]).astype(np.int64), "n": n.astype(np.int32)})

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        parts, total = [], 0
        for batch in batches:
            for doc, rk, text in zip(batch["_doc"], batch["_rk"], batch["text"]):
                tokens = unit.tokens(text)
                for a in range(0, len(tokens) - length + 1, BLOCK):  # long texts in pieces that overlap by a window
                    piece = tokens[a:a + BLOCK + length - 1]
                    parts.append((doc, rk, a, piece))
                    total += len(piece)
                    if total >= BLOCK:
                        yield from flush(parts)
                        parts, total = [], 0
        if parts:
            yield from flush(parts)

    return run


def _cut_out(search: Search):
    """Bodies of the asked segments of each document."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for doc, rk, text, asked in zip(batch["_doc"], batch["_rk"], batch["text"], batch["asked"]):
                tokens = search.unit.tokens(text)
                for x in asked:
                    body = tokens[x["p"]:x["p"] + x["n"] + search.length - 1]
                    rows.append((doc, rk, x["g"], x["p"], x["n"], x["m"], body.tobytes()))
            yield pd.DataFrame(rows, columns=["_doc", "_rk", "g", "p", "n", "m", "body"])

    return run


def runs(flags: np.ndarray) -> list[tuple[int, int]]:
    edge = np.flatnonzero(np.diff(np.concatenate([[0], flags.astype(np.int8), [0]])))
    return list(zip(edge[::2].tolist(), edge[1::2].tolist()))


def _compare(search: Search):
    """Spans to remove from segments that are the only ones of their text, or the first."""
    length = search.length

    def bundle(rows: pd.DataFrame) -> Iterator[pd.DataFrame]:
        rows = rows.drop_duplicates(["_rk", "p"])  # repeated rows are one document
        bodies = [np.frombuffer(b, search.unit.dtype) for b in rows["body"]]
        begin = np.concatenate([[0], np.cumsum([len(b) for b in bodies])])[:-1]
        n = rows["n"].to_numpy()
        row = np.repeat(np.arange(len(rows)), n)
        inner = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
        kind = search.classes(np.concatenate(bodies), begin[row] + inner)
        flag = kind >= 0
        if search.first_stays and flag.any():
            place = rows["p"].to_numpy()[row] + inner
            order = np.lexsort((place, rows["_doc"].to_numpy()[row], kind))
            k = kind[order]
            head = order[np.concatenate([[True], k[1:] != k[:-1]])]
            flag[head] = False
        out = []
        ends = np.cumsum(n)
        for i in np.unique(row[flag]):
            for a, b in runs(flag[ends[i] - n[i]:ends[i]]):
                out.append((rows["_rk"].iat[i], int(rows["p"].iat[i]) + a, int(rows["p"].iat[i]) + b - 1 + length))
        yield pd.DataFrame(out, columns=["_rk", "a", "b"]).astype("int64")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rest = None
        for batch in batches:
            rows = batch if rest is None else pd.concat([rest, batch], ignore_index=True)
            g = rows["g"].to_numpy()
            edges = np.flatnonzero(g[1:] != g[:-1]) + 1  # rows come sorted by group; the last may go on
            total = np.cumsum(rows["body"].map(len).to_numpy(np.int64)) // np.dtype(search.unit.dtype).itemsize
            filled, a, base = total[edges - 1], 0, 0
            while (i := np.searchsorted(filled, base + BUNDLE)) < len(edges):
                yield from bundle(rows.iloc[a:edges[i]])
                a, base = edges[i], filled[i]
            rest = rows.iloc[a:]
        if rest is not None and len(rest):
            yield from bundle(rest)

    return run


def parted(first: int, last: int, lo: int, hi: int, length: int, times: int) -> list[tuple[int, int, int, int]]:
    """Windows ``first`` to ``last``, all around [lo, hi), in parts that have more than that in common.

    A part is its first and last window and a longer stretch that lies in all its windows. The
    stretch depends on a window's place around [lo, hi) only, so equal windows have equal ones.
    """
    room = length - (hi - lo)
    if times == 0 or room == 0 or first > last:
        return [(first, last, lo, hi)] if first <= last else []
    half = (room + 1) // 2
    turn = hi + half - length  # from here on half of the room is behind the stretch
    return (parted(first, min(last, turn - 1), lo - (room - half + 1), hi, length, times - 1)
            + parted(max(first, turn), last, lo, hi + half, length, times - 1))


def _cut(search: Search):
    """Segments of large groups in parts, in groups named by what all windows of a part contain."""
    length = search.length

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for doc, rk, g, p, n, body in zip(batch["_doc"], batch["_rk"], batch["g"], batch["p"], batch["n"], batch["body"]):
                tokens = np.frombuffer(body, search.unit.dtype)
                values = search.unit.values(tokens)
                one, two = (_Hashes(values, b) for b in BASES)
                at = np.arange(length - search.gram + 1)
                # the anchor is the leftmost gram of its hash
                anchor = int(np.argmax(one.of(at, at + search.gram).view(np.int64) == g))
                parts = np.array(parted(0, n - 1, anchor, anchor + search.gram, length, CUTS))
                a, b, lo, hi = parts.T
                size = (b - a + 1).astype(np.uint64)
                names = (one.of(lo, hi) ^ (lo - hi).view(np.uint64)).view(np.int64)
                bodies = (two.of(a, b + length) ^ size).view(np.int64)
                for g2, s2, i, j in zip(names.tolist(), bodies.tolist(), a.tolist(), b.tolist()):
                    rows.append((doc, rk, g2, s2, p + i, j - i + 1, tokens[i:j + length].tobytes()))
            yield pd.DataFrame(rows, columns=["_doc", "_rk", "g", "s", "p", "n", "body"])

    return run


def _windows(search: Search):
    """Every window of a segment with a 128-bit hash of its tokens."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for doc, rk, p, n, body in zip(batch["_doc"], batch["_rk"], batch["p"], batch["n"], batch["body"]):
                values = search.unit.values(np.frombuffer(body, search.unit.dtype))
                at = np.arange(n)
                w1, w2 = (_Hashes(values, b).of(at, at + search.length).view(np.int64) for b in BASES)
                yield pd.DataFrame({"_doc": doc, "_rk": rk, "a": p + at, "w1": w1, "w2": w2})

    return run


def _told_apart(found: DataFrame, search: Search) -> tuple[DataFrame, DataFrame]:
    """Spans of segments of equal content, and one segment of each content where a group has several.

    Of the rows of one content the first one speaks for it, as ``loc``; ``m`` is the number of
    tokens of its group.
    """
    often = found.groupBy("g").agg(F.count("*").alias("c")).where("c > 1").select("g")
    some = written(found.join(often, "g", "left_semi"), "repeated")
    body = [c for c in found.columns if c == "body"]
    kinds = some.groupBy("g", "s").agg(F.count("*").alias("c"), F.min(F.struct("_doc", "p", "_rk", "n", *body)).alias("loc"))
    kinds = written(kinds, "kinds")
    groups = kinds.groupBy("g").agg(F.count("*").alias("k"), F.sum(F.col("loc.n") + (search.length - 1)).alias("m")).where("k > 1")
    several = kinds.join(groups.select("g", "m"), "g")
    if not search.first_stays:
        copied = some.join(kinds.where("c > 1").select("g", "s"), ["g", "s"], "left_semi")
    else:
        first = kinds.where("c > 1").select("g", "s", F.col("loc._rk").alias("_rk0"), F.col("loc.p").alias("p0"))
        copied = some.join(first, ["g", "s"]).where((F.col("_rk") != F.col("_rk0")) | (F.col("p") != F.col("p0")))
    return copied.select("_rk", F.col("p").alias("a"), (F.col("p") + F.col("n") - 1 + search.length).alias("b")), several


def spans(docs: DataFrame, search: Search, group: int = GROUP) -> DataFrame:
    """``_rk`` and ``spans``, an array of (a, b) token ranges to remove; documents without any are absent.

    ``docs`` has ``_doc`` (64 bits, not null), ``_rk`` and ``text``.
    """
    ship_package(docs.sparkSession)
    found = docs.mapInPandas(_anchors(search), "_doc bigint, _rk bigint, g bigint, s bigint, p bigint, n int")
    copied, several = _told_apart(written(found, "segments"), search)
    asked = several.select(F.col("loc._rk").alias("_rk"), F.struct("g", "loc.p", "loc.n", "m").alias("x"))
    # one document's requests are at most as many as its anchors
    lists = asked.groupBy("_rk").agg(F.collect_list("x").alias("asked"))
    schema = "_doc bigint, _rk bigint, g bigint, p bigint, n int, m bigint, body binary"
    bodies = written(docs.join(lists.hint("merge"), "_rk").select("_doc", "_rk", "text", "asked").mapInPandas(_cut_out(search), schema), "bodies")
    parts = bodies.where(F.col("m") > group).mapInPandas(_cut(search), "_doc bigint, _rk bigint, g bigint, s bigint, p bigint, n int, body binary")
    # repeated rows are one document
    parts = written(parts, "parts").dropDuplicates(["_rk", "g", "p"])
    recut, still = _told_apart(parts, search)
    still = written(still.select("loc._doc", "loc._rk", "g", "loc.p", "loc.n", "m", "loc.body"), "bodies")
    small = bodies.where(F.col("m") <= group).unionByName(still.where(F.col("m") <= group)).repartition("g").sortWithinPartitions("g")
    compared = small.mapInPandas(_compare(search), "_rk bigint, a bigint, b bigint")
    windows = still.where(F.col("m") > group).mapInPandas(_windows(search), "_doc bigint, _rk bigint, a bigint, w1 bigint, w2 bigint")
    same = windows.groupBy("w1", "w2").agg(F.count("*").alias("c"), F.min(F.struct("_doc", "a")).alias("first")).where("c > 1")
    split = windows.join(same, ["w1", "w2"])
    if search.first_stays:
        split = split.where(~F.struct("_doc", "a").eqNullSafe(F.col("first")))
    split = split.select("_rk", "a", (F.col("a") + search.length).alias("b"))
    every = copied.unionByName(recut).unionByName(compared).unionByName(split)
    return every.groupBy("_rk").agg(F.array_sort(F.collect_set(F.struct("a", "b"))).alias("spans"))


def joined(spans_of: list[tuple[int, int]] | None) -> list[tuple[int, int]]:
    """Sorted spans with touching and overlapping ones made one."""
    out: list[list[int]] = []
    for a, b in spans_of if spans_of is not None else ():
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


def _finish(search: Search, full: bool):
    import hashlib

    kinds = "n_tokens bigint, n_removed bigint, n_spans bigint, kept_sha256 string" + (", removed array<struct<a: bigint, b: bigint>>, kept binary" if full else "")

    @F.pandas_udf(kinds)
    def finish(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        for texts, spans_of in batches:
            rows = []
            for text, found in zip(texts, spans_of):
                cut = joined([(x["a"], x["b"]) for x in found] if found is not None else None)
                n, kept = search.unit.kept(text, cut)
                more = ([{"a": a, "b": b} for a, b in cut], kept) if full else ()
                rows.append((n, sum(b - a for a, b in cut), len(cut), hashlib.sha256(kept).hexdigest(), *more))
            yield pd.DataFrame(rows, columns=["n_tokens", "n_removed", "n_spans", "kept_sha256", *(["removed", "kept"] if full else [])])

    return finish


def without_repeats(docs: DataFrame, search: Search, full: bool = False, group: int = GROUP) -> DataFrame:
    """One row per input row: ``doc_id, n_tokens, n_removed, n_spans, kept_sha256``.

    ``full`` adds the removed token ranges and the kept text as bytes. Only ``doc_id`` (a
    whole number) and ``text`` are read, so other columns may have any name. A null text is
    empty; a row without id counts as a document before all others; an empty table gives an
    empty one.
    """
    ship_package(docs.sparkSession)
    rows = docs.select("doc_id", F.coalesce(F.col("doc_id").cast("long"), F.lit(-(2**63))).alias("_doc"), "text", F.xxhash64("doc_id", "text").alias("_rk"))
    found = written(spans(rows.drop("doc_id"), search, group), "spans")
    # span lists grow with the corpus, so they are never broadcast
    return rows.join(found.hint("merge"), "_rk", "left").select("doc_id", _finish(search, full)("text", "spans").alias("x")).select("doc_id", "x.*")
