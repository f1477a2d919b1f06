"""Streaming forms: coding of arriving notes, document status and usage budget."""
from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions.skew import running
from ..settings import DEFAULTS, Settings


def latest_notes(notes: DataFrame) -> DataFrame:
    """One row per document: the text that arrived last, repeats and older versions left out."""
    last = F.max_by(F.struct("text", "arrived"), F.struct("arrived", F.xxhash64("text")))
    return notes.groupBy("doc_id").agg(last.alias("n")).select("doc_id", "n.*")


def code_stream(notes: DataFrame, code: Callable[[DataFrame], DataFrame], write: Callable[[DataFrame, DataFrame], None], checkpoint: str) -> StreamingQuery:
    """Run the batch coding on every batch of arriving notes; reruns of a batch give the same rows.

    ``notes`` is a stream of ``doc_id, text, arrived``. No note is too late: of a document's
    versions in a batch the last one is coded, and a later batch replaces what an earlier one
    wrote. ``write(rows, notes)`` gets the results and the notes they come from, so it can
    also replace the rows of documents that have none now.
    """
    def run(batch: DataFrame, _: int) -> None:
        latest = latest_notes(batch)
        write(code(latest), latest)

    return notes.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def latest_status(events: DataFrame) -> DataFrame:
    """The last status of each document by time."""
    return events.groupBy("doc_id").agg(
        F.max_by("status", F.struct("ts", "event_id")).alias("status"), F.max("ts").alias("at"), F.count("*").alias("changes"))


def status_counts(events: DataFrame, width: str = "1 hour", delay: str = "2 hours") -> DataFrame:
    """Status changes per tumbling window; works on a batch and, with its watermark, on a stream."""
    timed = events.withWatermark("ts", delay) if events.isStreaming else events
    return timed.groupBy(F.window("ts", width).alias("w"), "status").agg(F.count("*").alias("n")).select(
        F.col("w.start").alias("start"), "status", "n")


def price(model: Column, prices: list[tuple[str, str, str]], default: tuple[str, str]) -> tuple[Column, Column]:
    """Input and output price per million tokens: first model name contained, else default.

    Prices are decimals, so running costs are exact whatever the order of addition.
    """
    money = lambda v: F.lit(v).cast("decimal(12,4)")
    p_in, p_out = money(default[0]), money(default[1])
    for name, cost_in, cost_out in reversed(prices):
        hit = F.contains(F.lower(model), F.lit(name))
        p_in, p_out = F.when(hit, money(cost_in)).otherwise(p_in), F.when(hit, money(cost_out)).otherwise(p_out)
    return p_in, p_out


def usage_budget(usage: DataFrame, prices: list[tuple[str, str, str]], default: tuple[str, str], settings: Settings = DEFAULTS) -> DataFrame:
    """Running tokens and cost of each session in time order, flagged beyond the limits.

    A session may hold most of the calls, so totals run over slices of it.
    """
    p_in, p_out = price(F.col("model"), prices, default)
    micro = (F.col("prompt_tokens") * p_in + F.col("completion_tokens") * p_out).cast("decimal(28,4)")
    tokens = F.col("prompt_tokens") + F.col("completion_tokens")
    out = running(usage, ["session"], [F.col("ts"), F.col("event_id")], {"total_tokens": tokens, "_micro": micro})
    out = out.withColumn("total_cost", F.col("_micro").cast("double") / 1e6).drop("_micro")
    return out.withColumn("over_limit", (F.col("total_tokens") > settings.max_session_tokens) | (F.col("total_cost") > settings.max_session_cost))
