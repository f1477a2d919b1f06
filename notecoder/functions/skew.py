"""Ranks and running totals over groups that may hold a large share of all rows."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import reliable_checkpoint


def in_slices(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """Rows range-partitioned by key and order, each with the number of its slice.

    A large group spans many slices. The rows are checkpointed so the slice numbers stay the
    same however often they are read.
    """
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = df.repartitionByRange(parts, *[F.col(k) for k in keys], *order)
    return reliable_checkpoint(ranged.withColumn("_slice", F.spark_partition_id()))


def running(df: DataFrame, keys: list[str], order: list[Column], sums: dict[str, Column], row_number: str | None = None) -> DataFrame:
    """Add running totals (and a row number) per group in the given order.

    Totals run inside each slice of a group; the totals of its earlier slices, one small row
    per group and slice, are then added.
    """
    sliced = in_slices(df, keys, order)
    sums = dict(sums, **({row_number: F.lit(1)} if row_number else {}))
    per = sliced.groupBy(*keys, "_slice").agg(*[F.sum(e).alias(f"_{n}") for n, e in sums.items()])
    earlier = Window.partitionBy(*keys).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    per = per.select(*keys, "_slice", *[F.coalesce(F.sum(f"_{n}").over(earlier), F.lit(0)).alias(f"_{n}") for n in sums])
    inside = Window.partitionBy(*keys, "_slice").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    out = sliced.select("*", *[F.sum(e).over(inside).alias(n) for n, e in sums.items()]).join(per, [*keys, "_slice"])
    return out.select(*df.columns, *[(F.col(n) + F.col(f"_{n}")).alias(n) for n in sums])


def with_group(df: DataFrame, keys: list[str], **aggs: Column) -> DataFrame:
    """Add aggregates of each row's group: partial aggregation, then an equi-join.

    Unlike a partition-wide window this never gathers a group in one task; a hot key is
    split by the adaptive skew join.
    """
    return df.join(df.groupBy(*keys).agg(*[a.alias(n) for n, a in aggs.items()]), keys, "left")


def with_texts(rows: DataFrame, texts: DataFrame, key: str = "doc_id", how: str = "left") -> DataFrame:
    """``rows`` with the texts of their documents, both sides sorted by ``key``.

    Texts are made by expressions over short columns, so the planner takes them for short and would send
    all of them to the driver and every executor.
    """
    return rows.join(texts.hint("merge"), key, how)


def islands(df: DataFrame, keys: list[str], order: list[Column], label: str, number: str = "island", same=None) -> DataFrame:
    """Number the runs of each group in the given order, from 0.

    A run ends where ``same(before, after)`` of two neighbours' ``label`` is false; by default
    where they differ (null equals null). Runs are numbered inside each slice of a group; a run
    that goes on from the slice before keeps its number. Only one row per group and slice is
    looked at in the group's order.
    """
    same = same or (lambda before, after: before.eqNullSafe(after))
    sliced = in_slices(df, keys, order)
    inside = Window.partitionBy(*keys, "_slice").orderBy(*order)
    upto = inside.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    local = sliced.withColumn("_r", F.row_number().over(inside)).withColumn("_before", F.lag(label).over(inside))
    local = local.withColumn("_new", (F.col("_r") > 1) & ~same(F.col("_before"), F.col(label))).drop("_before")
    local = local.withColumn("_k", F.sum(F.col("_new").cast("bigint")).over(upto))
    per = local.groupBy(*keys, "_slice").agg(
        F.min_by(F.struct(label), "_r").alias("_head"), F.max_by(F.struct(label), "_r").alias("_tail"), (F.max("_k") + 1).alias("_n"))
    by_slice = Window.partitionBy(*keys).orderBy("_slice")
    per = per.withColumn("_last", F.lag("_tail").over(by_slice))
    on = F.col("_last").isNotNull() & same(F.col("_last")[label], F.col("_head")[label])
    per = per.withColumn("_on", F.coalesce(on, F.lit(False)).cast("bigint"))
    before = by_slice.rowsBetween(Window.unboundedPreceding, -1)
    through = by_slice.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    start = F.coalesce(F.sum("_n").over(before), F.lit(0)) - F.sum("_on").over(through)
    out = local.join(per.select(*keys, "_slice", start.alias("_start")), [*keys, "_slice"])
    return out.select(*df.columns, (F.col("_k") + F.col("_start")).alias(number))


def absorbed(runs: DataFrame, keys: list[str], label: str, other: str, number: str = "island") -> DataFrame:
    """Runs of ``other`` between two runs of one label take that label, and runs are numbered anew.

    A null label takes nothing. ``runs`` has one row per group and ``number``. The result adds ``_absorbed`` (whether a row was
    such a run) and ``_run`` (its number among the merged runs); combining by it is left to the
    caller. As runs alternate, one pass reaches the fixed point: what stays ``other`` has
    different neighbours.
    """
    at = lambda step, name: runs.select(*keys, (F.col(number) + step).alias(number), F.col(label).alias(name))
    near = runs.join(at(1, "_before"), [*keys, number], "left").join(at(-1, "_after"), [*keys, number], "left")
    takes = (F.col(label) == other) & (F.col("_before") == F.col("_after"))
    out = near.withColumn("_absorbed", F.coalesce(takes, F.lit(False)))
    out = out.withColumn(label, F.when(F.col("_absorbed"), F.col("_before")).otherwise(F.col(label))).drop("_before", "_after")
    return islands(out, keys, [F.col(number)], label, "_run")
