"""MinHash near-duplicates: universal hash minima, banding, verification, connected components."""
from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import ship_package
from .components import components
from .shared import written

#: Bands and minima in a band: at a similarity of 0.8 a pair shares no band once in 10^6.
BANDS, ROWS = 60, 7
#: Times that classes outside a bucket's largest component are compared with one more of it.
PROBES = 2
LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))


class _Values(dict):
    """Words to 64-bit values; starts anew when large, which changes no value."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > 500_000:
            self.clear()
        value = self[word] = xxhash.xxh64_intdigest(word, 3)
        return value


_VALUES = _Values()


def shingles(text: str | None, words: int) -> np.ndarray:
    """Distinct ``words``-word shingles as sorted 64-bit values; A-Z are lower-cased.

    A text of fewer words has its whole sequence as one shingle, and none without words.
    """
    found = (text or "").encode().translate(LOWER).split()
    if not found:
        return np.zeros(0, np.uint64)
    v = np.fromiter(map(_VALUES.__getitem__, found), np.uint64, len(found))
    size = min(words, len(v))
    h = np.full(len(v) - size + 1, 0x9E3779B97F4A7C15 + size, np.uint64)
    for i in range(size):
        h = (h ^ v[i:len(v) - size + 1 + i]) * np.uint64(0xFF51AFD7ED558CCD)
        h ^= h >> np.uint64(32)
    return np.unique(h)


@functools.lru_cache(4)
def _family(n: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(97)
    return rng.integers(0, 2**31, n, dtype=np.uint32) * np.uint32(2) + np.uint32(1), rng.integers(0, 2**32, n, dtype=np.uint32)


def minima(values: np.ndarray, n: int) -> np.ndarray:
    """Least values of ``n`` universal hashes a * x + b mod 2^32 of a set; x is the upper half of a shingle's value."""
    a, b = _family(n)
    x = (values >> np.uint64(32)).astype(np.uint32)[:, None]
    out = np.full(n, np.uint32(0xFFFFFFFF), np.uint32)
    step = max(1, 120_000 // n)  # a block stays in the cache
    for i in range(0, len(x), step):
        hashed = x[i:i + step] * a
        hashed += b
        np.minimum(out, hashed.min(axis=0), out=out)
    return out


def _band_keys(least: np.ndarray, bands: int) -> np.ndarray:
    h = np.arange(1, bands + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    for column in least.reshape(bands, -1).T:
        h = (h ^ column.astype(np.uint64)) * np.uint64(0xD6E8FEB86659FD93)
        h ^= h >> np.uint64(32)
    return h.view(np.int64)


def _signatures(words: int, bands: int, rows: int):
    """Set size, set digest, and once per task and set the band keys and the signature."""
    @F.pandas_udf("n bigint, class binary, bands array<bigint>, sig binary")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        seen: set[bytes] = set()
        for texts in batches:
            out = []
            for t in texts:
                s = shingles(t, words)
                kind = xxhash.xxh128_digest(s.tobytes()) if len(s) else None
                if kind is None or kind in seen:
                    out.append((len(s), kind, None, None))
                    continue
                seen.add(kind)
                least = minima(s, bands * rows)
                # the low byte of each minimum estimates the similarity well enough to verify candidates
                out.append((len(s), kind, _band_keys(least, bands), (least & np.uint32(255)).astype(np.uint8).tobytes()))
            yield pd.DataFrame(out, columns=["n", "class", "bands", "sig"])

    return run


def _estimate():
    """Share of equal minima, less what single bytes share by chance."""
    @F.pandas_udf("double")
    def run(one: pd.Series, two: pd.Series) -> pd.Series:
        same = [np.count_nonzero(np.frombuffer(a, np.uint8) == np.frombuffer(b, np.uint8)) / len(a) for a, b in zip(one, two)]
        return (pd.Series(same, dtype=float) - 1 / 256) / (1 - 1 / 256)

    return run


def _alike(percent: int):
    @F.pandas_udf("boolean")
    def run(one: pd.Series, two: pd.Series) -> pd.Series:
        out = []
        for a, b in zip(one, two):
            a, b = np.frombuffer(a, np.uint64), np.frombuffer(b, np.uint64)
            both = len(np.intersect1d(a, b, assume_unique=True))
            out.append(100 * both >= percent * (len(a) + len(b) - both))
        return pd.Series(out, dtype=bool)

    return run


def _shingle_set(words: int):
    @F.pandas_udf("binary")
    def run(texts: pd.Series) -> pd.Series:
        return pd.Series([shingles(t, words).tobytes() for t in texts], dtype=object)

    return run


def _verified(pairs: DataFrame, sides: DataFrame, percent: int, hashes: int) -> DataFrame:
    """Pairs ``u, v`` of classes whose full sets are as alike as asked.

    Set sizes and signatures leave out pairs first: the estimate of a pair at the threshold
    falls below the tested bound, seven standard deviations lower, once in 10^11.
    """
    share = percent / 100
    bound = share - 7 * (share * (1 - share) / hashes) ** 0.5
    side = lambda end, *cols: sides.select(F.col("class").alias(end), *[F.col(c).alias(f"{c}_{end}") for c in cols])
    close = pairs.join(side("u", "n", "sig"), "u").join(side("v", "n", "sig"), "v")
    close = close.where(100 * F.least("n_u", "n_v") >= percent * F.greatest("n_u", "n_v")).where(_estimate()("sig_u", "sig_v") >= bound).select("u", "v")
    full = written(close, "close").join(side("u", "set"), "u").join(side("v", "set"), "v")
    return full.where(_alike(percent)("set_u", "set_v")).select("u", "v")


def _values():
    @F.pandas_udf("array<bigint>")
    def run(sets: pd.Series) -> pd.Series:
        return pd.Series([np.frombuffer(x, np.int64) for x in sets], dtype=object)

    return run


def _open_pairs(open_: DataFrame, sides: DataFrame, percent: int) -> DataFrame:
    """Pairs of an open class and another class of ``open_`` that may be alike, by an exact prefix join.

    ``open_`` has ``class``, its component ``comp`` and ``asks``, true for classes whose links
    are sought; pairs of one component are none. All sets are in one order, rarest shingle
    first. The first shingle that two sets have in common has all their common ones behind it
    in both, so it is only looked up where what is left of either set can be enough for their
    two sizes: each side says for which size classes of itself and of the partner that is so,
    and both are part of the key. Copies with many edits of their own so find no partners, while
    comparing them with their whole group would take the square of its size.
    """
    total = 100 + percent
    sets = open_.join(sides.select("class", "n", "set"), "class").select("class", "asks", "comp", "n", F.explode(_values()("set")).alias("x"))
    sets = written(sets, "shingles")
    step = float(np.log(1.03))
    kind = lambda n: F.floor(F.log(n.cast("double")) / step).cast("int")
    common = sets.groupBy("x").agg(F.count("*").alias("c")).where("c > 1")
    # a shingle that only one class has leads to no other, but takes a place of the prefix
    seen = sets.join(common, "x", "left").withColumn("c", F.coalesce("c", F.lit(1)))
    seen = seen.withColumn("j", F.row_number().over(Window.partitionBy("class").orderBy("c", "x")) - 1)
    # sizes of a partner: at least the share of its own, at most what the rest of this set is enough for
    most = F.floor((F.lit(total) * (F.col("n") - F.col("j")) - F.lit(percent) * F.col("n")) / F.lit(percent))
    seen = seen.withColumns({"least": F.ceil(F.lit(percent) * F.col("n") / 100), "most": most}).where("c > 1 and most >= least")
    seen = seen.select("class", "asks", "comp", "n", "x", "least", "most", kind(F.col("n")).alias("own"),
                       F.explode(F.sequence(kind(F.col("least")), kind(F.col("most")))).alias("partner"))
    seen = written(seen, "prefixes")
    asked = seen.where("asks").select("class", "comp", "n", "x", "least", "most", F.col("own").alias("k1"), F.col("partner").alias("k2"))
    other = seen.select("x", F.col("partner").alias("k1"), F.col("own").alias("k2"), F.col("class").alias("class2"), F.col("comp").alias("comp2"),
                        F.col("n").alias("n2"), F.col("least").alias("least2"), F.col("most").alias("most2"))
    met = asked.join(other, ["x", "k1", "k2"]).where("comp <> comp2 and n2 between least and most and n between least2 and most2")
    return met.select(F.greatest("class", "class2").alias("u"), F.least("class", "class2").alias("v")).distinct()


def _links(buckets: DataFrame, sides: DataFrame, percent: int, hashes: int) -> DataFrame:
    """Classes with the component they belong to, from links inside buckets.

    A bucket's classes are first compared with its leader only, the class that shares most
    buckets and so is likely central to its group: a group of copies costs a pair per copy.
    Open are then pairs of a bucket in different components. Classes outside a bucket's
    largest component are compared with one more class of it, drawn anew in each bucket,
    which links nearly all that can be linked; the rest look for their links by an exact
    prefix join.
    """
    sizes = buckets.groupBy("bkey").agg(F.count("*").alias("k"))
    weights = written(buckets.join(sizes, "bkey").groupBy("class").agg(F.sum("k").alias("weight")), "weights")
    leads = written(buckets.join(weights, "class").groupBy("bkey").agg(F.max(F.struct("weight", "class")).alias("m")).select("bkey", F.col("m.class").alias("lead")), "leads")
    pair = lambda a, b: (F.greatest(a, b).alias("u"), F.least(a, b).alias("v"))
    tested = written(buckets.join(leads, "bkey").where("class <> lead").select(*pair("class", "lead")).distinct(), "pairs")
    edges = written(_verified(tested, sides, percent, hashes), "links")
    # the leader's pairs are decided, so only the others of a bucket can have open ones
    others = written(buckets.join(leads, "bkey").where("class <> lead").select("bkey", "class"), "others")
    for probe in range(PROBES + 1):
        named = components(edges)
        of = others.join(named.withColumnRenamed("node", "class"), "class", "left").withColumn("comp", F.coalesce("component", "class")).drop("component")
        of = written(of, "members")
        parts = of.groupBy("bkey", "comp").agg(F.count("*").alias("count"), F.max(F.struct(F.xxhash64("class", "bkey", F.lit(probe)).alias("h"), "class")).alias("some"))
        largest = parts.groupBy("bkey").agg(F.count("*").alias("parts"), F.max(F.struct("count", "comp", "some")).alias("m")).where("parts > 1")
        largest = written(largest.select("bkey", F.col("m.comp").alias("main"), F.col("m.some.class").alias("other")), "open")
        asking = of.join(largest, "bkey")
        if probe == PROBES:
            break
        drawn = asking.where("comp <> main").select(*pair("class", "other")).distinct().join(tested, ["u", "v"], "left_anti")
        drawn = written(drawn, "pairs")
        tested, edges = tested.unionByName(drawn), edges.unionByName(written(_verified(drawn, sides, percent, hashes), "links"))
    open_ = asking.groupBy("class").agg(F.max(F.col("comp") != F.col("main")).alias("asks"), F.max("comp").alias("comp"))
    pairs = _open_pairs(written(open_, "asking"), sides, percent)
    pairs = written(pairs.join(tested, ["u", "v"], "left_anti"), "pairs")
    more = written(_verified(pairs, sides, percent, hashes), "links")
    return components(edges.unionByName(more))


def near_duplicates(docs: DataFrame, words: int = 5, percent: int = 80, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """``doc_id, n_shingles, component_id, kept, row_key`` for every row; the key is a hash of id and text.

    Documents whose shingle sets have an intersection of at least ``percent`` of their union
    are linked, links are confirmed on the full sets, and a component is named by its least
    ``doc_id``. A text without words has no shingles and is linked with nothing; rows of one
    set, repeated rows too, are one class and linked. A row without id takes part, but ids
    name components before it does; without any id in it, a component has none and its
    documents are kept. Only ``doc_id`` (a whole number) and ``text`` are read.

    Classes of equal sets are formed before banding, so exact copies cost one row.
    """
    ship_package(docs.sparkSession)
    body = docs.select("doc_id", F.xxhash64("doc_id", "text").alias("row_key"), "text")
    rows_of = body.select("doc_id", "row_key", _signatures(words, bands, rows)("text").alias("s")).select("doc_id", "row_key", "s.*")
    rows_of = written(rows_of, "signatures")
    reps = rows_of.where("bands is not null")
    each = reps.select(F.posexplode("bands").alias("band", "key"), "class").select(F.xxhash64("band", "key").alias("bkey"), "class")
    mark = each.select("bkey", F.xxhash64("class").alias("h"))
    shared = mark.groupBy("bkey").agg(F.min("h").alias("a"), F.max("h").alias("b")).where("a <> b").select("bkey")
    buckets = written(each.join(shared, "bkey", "left_semi").distinct(), "buckets")
    wanted = written(buckets.select("class").distinct(), "wanted")
    one = reps.join(wanted, "class").groupBy("class").agg(F.max("n").alias("n"), F.min("row_key").alias("row_key"))
    sigs = reps.join(wanted, "class").select("class", "sig").dropDuplicates(["class"])
    # the classes grow with the corpus, so they are never broadcast
    sets = body.select("row_key", "text").join(one.hint("merge"), "row_key").select("class", "n", _shingle_set(words)("text").alias("set")).dropDuplicates(["class"])
    sides = written(sets.join(sigs, "class"), "sets")
    named = _links(buckets, sides, percent, bands * rows)
    first = rows_of.where("class is not null").groupBy("class").agg(F.min("doc_id").alias("first"))
    first = written(first.join(named.withColumnRenamed("node", "class"), "class", "left").withColumn("component", F.coalesce("component", "class")), "first")
    least = first.groupBy("component").agg(F.min("first").alias("component_id"))
    out = rows_of.join(first.join(least, "component").select("class", "component_id"), "class", "left")
    own = F.when(F.col("class").isNull(), F.col("doc_id")).otherwise(F.col("component_id"))
    return out.select("doc_id", F.col("n").alias("n_shingles"), own.alias("component_id"),
                      (F.col("doc_id").eqNullSafe(own) | own.isNull()).alias("kept"), "row_key")
