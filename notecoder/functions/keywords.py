"""Literal words looked for in texts: every distinct line is searched once a worker."""
from __future__ import annotations

from functools import lru_cache, reduce

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType

from ..knowledge import clinical as kn

#: Groups of words by table; a group's place is its bit. No word holds a line break.
TABLES: dict[str, list[list[str]]] = {
    "drugs": [kn.GENERAL_DRUG_WORDS, *[ws for _, ws in kn.CONTEXT_DRUGS]],
    "labs": [kn.GENERAL_LAB_WORDS, *[ws for _, ws in kn.CONTEXT_LABS]],
    "elements": [kn.MONITORING_WORDS, kn.EVALUATION_WORDS, kn.ASSESSMENT_WORDS, kn.TREATMENT_WORDS],
}
#: Longest line that a worker remembers.
SHORT = 200


def groups_of(table: str, line: str) -> int:
    """A bit for every group of ``table`` with a word in the line."""
    return sum(1 << k for k, words in enumerate(TABLES[table]) if any(w in line for w in words))


@lru_cache(maxsize=100_000)
def repeated_groups_of(table: str, line: str) -> int:
    return groups_of(table, line)


def text_groups(table: str, text: str | None) -> int:
    """The groups of all lines of a text; none for a null."""
    found = (repeated_groups_of(table, s) if len(s) <= SHORT else groups_of(table, s) for s in (text or "").split("\n"))
    return reduce(int.__or__, found, 0)


def search(table: str, texts: pa.Array) -> pa.Array:
    """``text_groups`` of every text of an array of lists; texts that repeat in a batch are searched once."""
    found = texts.values.dictionary_encode()
    bits = pa.array([text_groups(table, v) for v in found.dictionary.to_pylist()], pa.int64())
    return pa.ListArray.from_arrays(texts.offsets, bits.take(found.indices))


def _searcher(table: str):
    @F.arrow_udf(ArrayType(LongType()))
    def run(texts: pa.Array) -> pa.Array:
        return search(table, texts)

    return run


def word_groups(texts: Column, table: str) -> Column:
    """A number of bits for every (lower-case) text of an array: which word groups of ``table`` it holds."""
    return _searcher(table)(F.coalesce(texts, F.array().cast("array<string>")))


def has(bits: Column, group: Column | int) -> Column:
    """Whether a group's bit is set."""
    return F.getbit(bits, F.lit(group) if isinstance(group, int) else group) == 1
