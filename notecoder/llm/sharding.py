"""Uniform shuffle into shards of exact sizes through a hypergeometric communication matrix."""
from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import written

#: Rows that one ranking bucket of a shard holds on average.
BUCKET_ROWS = 200_000


def shard_sizes(n: int, shards: int) -> np.ndarray:
    """Sizes at most one apart that add up to ``n``."""
    return np.full(shards, n // shards, np.int64) + (np.arange(shards) < n % shards)


def communication_matrix(rows: list[int], shards: int, seed: int) -> np.ndarray:
    """How many rows each partition sends to each shard, as a uniform shuffle would.

    Partition after partition draws from what the shards have left (a multivariate
    hypergeometric draw), so row sums are partition sizes and column sums shard sizes.
    """
    rng = np.random.default_rng(seed)
    left = shard_sizes(sum(rows), shards)
    out = np.zeros((len(rows), shards), np.int64)
    for i, n in enumerate(rows):
        rest, need = int(left.sum()), n
        for j in range(shards):
            rest -= int(left[j])
            # one univariate draw per cell; past 10^9 the generator needs the marginals' own sizes
            out[i, j] = need if rest == 0 else _draw(rng, int(left[j]), rest, need)
            need -= int(out[i, j])
        left -= out[i]
    return out


def _draw(rng: np.random.Generator, good: int, bad: int, n: int) -> int:
    """Hypergeometric draw; populations beyond the generator's limit are drawn in halves."""
    if good == 0 or n == 0:
        return 0
    if bad == 0:
        return n
    if good < 10**9 and bad < 10**9:
        return int(rng.hypergeometric(good, bad, n))
    low_good, low_bad = good // 2, bad // 2
    low = low_good + low_bad
    # first how many of the n rows come from the lower half of the population, then the good ones of each half
    mean, rest = n * low / (good + bad), good + bad
    sd = (n * (low / rest) * (1 - low / rest) * max(0, rest - n) / max(1, rest - 1)) ** 0.5
    part = min(max(round(rng.normal(mean, sd)), n - (rest - low), 0), low, n)
    return _draw(rng, low_good, low_bad, part) + _draw(rng, good - low_good, bad - low_bad, n - part)


def shard_rows(df: DataFrame, shards: int = 8, seed: int = 1) -> DataFrame:
    """``df`` with ``shard`` and ``slot``: a uniform random deal with sizes at most one apart.

    Input partitions are fixed in a written table, so recomputed tasks see the same rows.
    Their sizes (one number each) give the matrix; a random order inside the partition says
    which rows go to which shard; inside a shard a second random order gives the slots,
    ranked in small random buckets whose offsets are added, so no task holds a whole shard.
    Whatever columns ``df`` has are carried along (``shard`` and ``slot`` are replaced);
    nulls and repeated rows are dealt like any row; an empty table gives an empty one.
    """
    keep = [c for c in df.columns if c.lower() not in ("shard", "slot")]
    fixed = written(df.select(
        F.struct(*keep).alias("row"), F.spark_partition_id().alias("part"), F.monotonically_increasing_id().alias("rid")), "deal")
    sizes = fixed.groupBy("part").count().orderBy("part").collect()
    matrix = communication_matrix([r["count"] for r in sizes], shards, seed)
    spark = df.sparkSession
    schema = "part int, upto array<bigint>"
    # one short row per input partition
    sends = spark.createDataFrame([(r["part"], [int(x) for x in np.cumsum(matrix[i])]) for i, r in enumerate(sizes)], schema)
    order = lambda salt: (F.xxhash64(F.lit(seed), F.lit(salt), "rid"), F.col("rid"))
    ranked = fixed.withColumn("at", F.row_number().over(Window.partitionBy("part").orderBy(*order("local"))))
    target = F.size(F.filter("upto", lambda x: x < F.col("at")))
    dealt = ranked.join(sends, "part").select("row", "rid", target.cast("int").alias("shard"))
    buckets = max(1, -(-sum(r["count"] for r in sizes) // (shards * BUCKET_ROWS)))
    again = F.xxhash64(F.lit(seed), F.lit("shard"), "rid")
    dealt = written(dealt.withColumn("bucket", F.pmod(F.shiftrightunsigned(again, 20), F.lit(buckets)).cast("int")), "dealt")
    before = Window.partitionBy("shard").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = dealt.groupBy("shard", "bucket").count().select("shard", "bucket", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("offset"))
    inside = Window.partitionBy("shard", "bucket").orderBy(again, F.col("rid"))
    out = dealt.withColumn("n", F.row_number().over(inside)).join(offsets, ["shard", "bucket"])
    return out.select("row.*", "shard", (F.col("offset") + F.col("n") - 1).cast("long").alias("slot"))


def write_shards(df: DataFrame, path: str, shards: int = 8, seed: int = 1) -> None:
    """Whole rows as Parquet, a folder per shard, each file sorted by slot."""
    out = shard_rows(df, shards, seed)
    out.repartitionByRange(F.col("shard"), F.col("slot")).sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)
