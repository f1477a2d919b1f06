"""Benchmark decontamination: SimHash of item-sized windows, a Hamming index, exact verification.

DataFrame functions only. Words are runs of letters and digits, lower-cased; shingles have
five words; an item of n words is compared with windows of n words. A window and an item are
alike if the shared part of their shingle multisets is 0.8 of the joint part or more. A document
shorter than an item is one window as a whole.
"""
from __future__ import annotations

import itertools

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import written

SHINGLE = 5
#: Bits in which fingerprints may differ. Alike windows differ in 10 of 64 on average; in more than 23 once in 300,000.
RADIUS, BLOCKS, BITS = 23, 8, 64
#: Up to so many shingles of all items a plan holds as literals; beyond, a join finds the documents.
LITERALS = 20_000


def _shingles(text: Column) -> Column:
    w = F.array_remove(F.split(F.lower(F.coalesce(text, F.lit(""))), "[^\\p{L}\\p{N}]+"), "")
    hashed = lambda x: F.transform(
        F.sequence(F.lit(0), F.size(x) - SHINGLE), lambda i: F.xxhash64(*[F.get(x, i + k) for k in range(SHINGLE)]))
    some = lambda x: F.when(F.size(x) < SHINGLE, F.array().cast("array<bigint>")).otherwise(hashed(x))
    return F.get(F.transform(F.array(w), some), F.lit(0))


def _fingerprints(windows: DataFrame, *keys: str) -> DataFrame:
    """SimHash of each group's ``h``: a bit is set where most shingles, counted as often as they occur, have it."""
    bits = [F.sum(F.shiftrightunsigned("h", b).bitwiseAND(F.lit(1))).alias(f"b{b}") for b in range(BITS)]
    sums = windows.groupBy(*keys).agg(F.count("*").alias("size"), *bits)
    print_ = F.lit(0).cast("long")
    for b in range(BITS):
        print_ = print_.bitwiseOR(F.when(2 * F.col(f"b{b}") > F.col("size"), F.shiftleft(F.lit(1).cast("long"), b)).otherwise(F.lit(0).cast("long")))
    return sums.select(*keys, "size", print_.alias("print"))


def _block(print_: Column, b: int) -> Column:
    width = BITS // BLOCKS
    return F.shiftrightunsigned(print_, b * width).bitwiseAND(F.lit((1 << width) - 1)).cast("int")


def _index(items: DataFrame) -> DataFrame:
    """Every value a block may have in a print within the radius.

    Of prints within the radius, some block differs in ``RADIUS // BLOCKS`` bits at most, so
    those few neighbours of each block are all that need be looked up.
    """
    width, near = BITS // BLOCKS, RADIUS // BLOCKS
    flips = [sum(1 << i for i in on) for n in range(near + 1) for on in itertools.combinations(range(width), n)]
    blocks = F.array(*[F.struct(F.lit(b).alias("block"), _block(F.col("print"), b).alias("own")) for b in range(BLOCKS)])
    out = items.select("item", "size", F.col("print").alias("item_print"), F.explode(blocks).alias("x"))
    out = out.select("item", "size", "item_print", "x.block", "x.own", F.explode(F.array(*map(F.lit, flips))).alias("flip"))
    return out.select("item", "size", "item_print", "block", F.col("own").bitwiseXOR(F.col("flip")).alias("value"))


def matches(docs: DataFrame, benchmark: DataFrame, literals: int = LITERALS) -> DataFrame:
    """``_rk, item, start, inter, size`` for every alike window; ``start`` counts words, ``size`` shingles.

    ``docs`` has ``_rk, text``; ``benchmark`` has ``item_id, text``. Items of fewer than five
    words are too short to tell and match nothing; repeated items match each. Windows that
    share too few shingles with every item to be alike are left out before fingerprints are
    made; that loses no alike window.
    """
    items = benchmark.where("item_id is not null").groupBy("item_id", "text").count().select(F.col("item_id").alias("item"), _shingles(F.col("text")).alias("hs")).where(F.size("hs") > 0)
    # an id with several texts has several items
    items = items.withColumn("item", F.struct("item", F.xxhash64("hs").alias("version")))
    grams = written(items.select("item", F.explode("hs").alias("h")), "grams")
    own = written(grams.groupBy("item", "h").agg(F.count("*").alias("c_item")), "shingles")
    sizes = grams.groupBy("item").agg(F.count("*").alias("size"))
    few = [r[0] for r in own.select("h").distinct().limit(literals + 1).collect()]
    cut = docs.select("_rk", _shingles(F.col("text")).alias("hs"))
    if len(few) <= literals:
        some = cut.where(F.exists("hs", lambda h: h.isin(few))) if few else cut.limit(0)
    else:
        holders = cut.select("_rk", F.explode(F.array_distinct("hs")).alias("h")).join(own.select("h").distinct(), "h", "left_semi").select("_rk").distinct()
        some = cut.join(holders, "_rk", "left_semi")
    some = written(some.dropDuplicates(["_rk"]), "candidates")
    hits = some.select("_rk", F.size("hs").cast("long").alias("held"), F.posexplode("hs").alias("at", "h")).join(own, "h").join(sizes, "item")
    # alike windows share 8/9 of the item's shingles at least: a / (2 n - a) >= 0.8; of a shorter document with d
    # shingles, a / (d + n - a) >= 0.8 and a <= d leave 4/5
    short = F.col("held") < F.col("size")
    need = F.when(short, F.ceil(F.col("size") * 4 / 5)).otherwise(F.ceil(F.col("size") * 8 / 9))
    enough = hits.groupBy("_rk", "item", "size", "held").agg(F.count("*").alias("n")).where(F.col("n") >= need).select("_rk", "item")
    near = hits.join(enough, ["_rk", "item"], "left_semi")
    until = F.when(short, F.lit(0)).otherwise(F.col("at")).cast("long")
    starts = near.select("_rk", "item", "size", "held", F.explode(F.sequence(F.greatest(F.lit(0).cast("long"), F.col("at") - F.col("size") + 1), until)).alias("start"))
    starts = starts.groupBy("_rk", "item", "size", "held", "start").agg(F.count("*").alias("n")).where(F.col("n") >= need)
    windows = written(starts.select("_rk", "size", "held", "start").distinct(), "windows")
    body = F.slice("hs", F.col("start").cast("int") + 1, F.col("size").cast("int"))
    filled = written(windows.join(some, "_rk").where(short | (F.col("start") + F.col("size") <= F.col("held"))).select("_rk", "start", F.explode(body).alias("h"), F.col("size").alias("wide"), F.least("size", "held").alias("held")), "filled")
    prints = _fingerprints(filled, "_rk", "start", "wide").select("_rk", "start", F.col("wide").alias("size"), "print")
    blocks = F.array(*[F.struct(F.lit(b).alias("block"), _block(F.col("print"), b).alias("value")) for b in range(BLOCKS)])
    asked = prints.select("_rk", "start", "size", "print", F.explode(blocks).alias("x")).select("_rk", "start", "size", "print", "x.*")
    found = asked.join(_index(_fingerprints(grams, "item")), ["size", "block", "value"])
    found = found.where(F.bit_count(F.col("print").bitwiseXOR(F.col("item_print"))) <= RADIUS).select("_rk", "start", "size", "item").distinct()
    counts = filled.groupBy("_rk", "start", F.col("wide").alias("size"), "held", "h").agg(F.count("*").alias("c"))
    shared = counts.join(found, ["_rk", "start", "size"]).join(own, ["item", "h"])
    shared = shared.groupBy("_rk", "item", "start", "size", "held").agg(F.sum(F.least("c", "c_item")).alias("inter"))
    return shared.where("5 * inter >= 4 * (held + size - inter)").select("_rk", F.col("item.item").alias("item"), "start", "inter", "size")


def checked(docs: DataFrame, benchmark: DataFrame, literals: int = LITERALS) -> DataFrame:
    """``docs`` with ``n_items`` (items it holds a passage of), ``first_item`` and ``contaminated``.

    A null or short text holds none. Rows that share id and text are judged alike. Columns
    named like the new ones are replaced.
    """
    new = ("n_items", "first_item", "contaminated")
    keep = [c for c in docs.columns if c.lower() not in new]
    key = F.xxhash64("doc_id", "text")
    hit = matches(docs.select(key.alias("_rk"), "text"), benchmark, literals)
    hit = written(hit.groupBy("_rk").agg(F.countDistinct("item").alias("n_items"), F.min("item").alias("first_item")), "matched")
    rows = docs.select(F.struct(*keep).alias("_row"), key.alias("_rk")).join(hit.hint("merge"), "_rk", "left")
    return rows.select(*[F.col("_row").getField(c).alias(c) for c in keep], F.coalesce("n_items", F.lit(0)).alias("n_items"),
                       "first_item", F.col("n_items").isNotNull().alias("contaminated"))
