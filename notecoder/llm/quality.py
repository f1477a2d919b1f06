"""Quality rules: a threshold table compiled into one projection, without user functions."""
from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.arrays import let
from .shared import SEPARATOR_CHARS, words

SYMBOLS = "#*$%&|<>"

#: Frequent words of the four languages of the corpus.
STOP_WORDS = sorted(set(
    "the of and to in a is that for it was on are as with be at by this from or an "
    "der die das und in den von zu mit sich des auf für ist im dem nicht ein eine als auch es "
    "le la les de des et à un une du en que est pour qui dans par sur au plus ne se ce il elle "
    "el los las y en un una por con para del que se su al lo como más".split()))


@dataclass(frozen=True)
class Rule:
    """Keep a document whose ``measure`` lies in [low, high]; a missing bound is not tested."""

    name: str
    measure: str
    low: float | None = None
    high: float | None = None


#: A document is kept if every rule holds. Ratios of an empty document are 0.
RULES = (
    Rule("length", "n_words", low=50),
    Rule("word_length", "mean_word_chars", low=2.0, high=15.0),
    Rule("symbols", "symbol_ratio", high=0.3),
    Rule("stop_words", "stop_ratio", low=0.02),
    Rule("duplicate_lines", "dup_line_ratio", high=0.5),
    Rule("repeated_words", "repeat_ratio", high=0.5),
    Rule("upper_case", "upper_ratio", high=0.5),
)


def _repeated_words(w: Column) -> Column:
    """Words inside three-word windows that the text holds twice or more.

    Texts without a repeated window, nearly all, stop at a hash-based distinct; in the others
    equal windows meet by sorting, so the cost stays n log n for any text.
    """
    def starts_of(windows: Column) -> Column:
        ordered = F.sort_array(F.transform(windows, lambda x, i: F.struct(x.alias("w"), i.alias("i"))))

        def repeated(s: Column) -> Column:
            same = lambda a, b: F.coalesce(F.get(s, a)["w"] == F.get(s, b)["w"], F.lit(False))
            return F.transform(F.filter(s, lambda x, k: same(k, k - 1) | same(k, k + 1)), lambda x: x["i"])

        return F.sort_array(let(ordered, repeated))

    def covered(starts: Column) -> Column:
        """Words under the windows at these ascending starts: up to 3 each, less any overlap."""
        first = F.struct(F.lit(0).alias("n"), F.lit(-3).alias("last"))
        step = lambda a, s: F.struct((a["n"] + F.least(F.lit(3), s - a["last"])).alias("n"), s.alias("last"))
        return F.aggregate(starts, first, step, lambda a: a["n"])

    def count(x: Column) -> Column:
        at = lambda i: F.get(x, i)
        triples = F.transform(F.sequence(F.lit(0), F.size(x) - 3), lambda i: F.concat_ws(" ", at(i), at(i + 1), at(i + 2)))
        return F.when(F.size(x) < 4, F.lit(0)).otherwise(let(
            triples, lambda t: F.when(F.size(F.array_distinct(t)) == F.size(t), F.lit(0)).otherwise(covered(starts_of(t)))))

    return count(w).cast("long")


def _ratio(part: Column, whole: Column) -> Column:
    return F.coalesce(F.try_divide(part.cast("double"), whole.cast("double")), F.lit(0.0))


def measures(text: Column) -> Column:
    """All counts and ratios of a text as one struct; the words are split once."""
    t = F.coalesce(text, F.lit(""))

    def of_words(w: Column) -> Column:
        chars = F.length(F.translate(t, SEPARATOR_CHARS, "")).cast("long")
        symbols = (F.length(t) - F.length(F.translate(t, SYMBOLS, ""))).cast("long")
        lines = F.filter(F.split(t, "\n", -1), lambda s: F.length(F.translate(s, SEPARATOR_CHARS, "")) > 0)
        n_lines = let(lines, lambda s: F.struct(F.size(s).alias("all"), F.size(F.array_distinct(s)).alias("own")))
        stops = F.size(F.filter(w, lambda x: F.lower(x).isin(STOP_WORDS)))
        upper = F.length(F.regexp_replace(t, "[^\\p{Lu}]", ""))
        letters = F.length(F.regexp_replace(t, "[^\\p{L}]", ""))
        return F.struct(
            F.size(w).cast("long").alias("n_words"), chars.alias("word_chars"), symbols.alias("n_symbols"),
            n_lines.alias("lines"), _repeated_words(w).alias("n_repeat_words"), stops.cast("long").alias("n_stop_words"),
            upper.cast("long").alias("n_upper"), letters.cast("long").alias("n_letters"))

    return let(words(text), of_words)


def judged(docs: DataFrame, text: str = "text", rules: tuple[Rule, ...] = RULES, prefix: str = "") -> DataFrame:
    """``docs`` with the measures, ``base_failed``, ``failed`` (names of broken rules) and ``kept``.

    No shuffle and no user function. A null or empty text has zero counts and fails the
    length rule; repeated rows are judged each; new columns take ``prefix`` and replace
    columns of the same name.
    """
    m = F.col("__m")
    value = {
        "n_words": m["n_words"], "word_chars": m["word_chars"], "n_symbols": m["n_symbols"],
        "n_dup_lines": (m["lines"]["all"] - m["lines"]["own"]).cast("long"), "n_repeat_words": m["n_repeat_words"],
        "mean_word_chars": _ratio(m["word_chars"], m["n_words"]), "symbol_ratio": _ratio(m["n_symbols"], m["n_words"]),
        "stop_ratio": _ratio(m["n_stop_words"], m["n_words"]),
        "dup_line_ratio": _ratio(m["lines"]["all"] - m["lines"]["own"], m["lines"]["all"]),
        "repeat_ratio": _ratio(m["n_repeat_words"], m["n_words"]), "upper_ratio": _ratio(m["n_upper"], m["n_letters"]),
    }
    base = (m["n_words"] < 50) | (100 * m["n_repeat_words"] > 50 * m["n_words"])
    broken = [F.when((value[r.measure] < r.low if r.low is not None else F.lit(False))
                     | (value[r.measure] > r.high if r.high is not None else F.lit(False)), F.lit(r.name)) for r in rules]
    # a generator keeps a filter on the verdict from being pushed below, which would count all again for each rule
    out = docs.select("*", F.explode_outer(F.array(measures(F.col(text)))).alias("__m"))
    out = out.withColumns({prefix + k: v for k, v in value.items()} | {
        prefix + "base_failed": base, prefix + "failed": F.array_compact(F.array(*broken)) if broken else F.array().cast("array<string>")})
    return out.withColumn(prefix + "kept", ~F.col(prefix + "base_failed") & (F.size(prefix + "failed") == 0)).drop("__m")
