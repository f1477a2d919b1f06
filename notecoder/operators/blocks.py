"""Blocks of lines of one family, and given headers found again in a text; both inside the note's row."""
from __future__ import annotations

import re
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StringType, StructType

from ..functions.arrays import cuts, explode_rows, let, total_length
from ..knowledge.blocks import BLOCK_FAMILIES, HEADER_SHORT_FORMS
from .headers import SPACE
from .sections import distance, list_of, normalized, stems

BLOCK = "struct<position int, section string, confidence double, line_count int, start_line int, end_line int>"


#: \b, \s and letters without case are those of ASCII.
_SEARCHES = [re.compile(pattern, re.ASCII).search for _, _, _, pattern in BLOCK_FAMILIES]


def families_of(line: str) -> int:
    """The families a line fits, one bit each."""
    return sum(1 << x for x, search in enumerate(_SEARCHES) if search(line))


@lru_cache(maxsize=100_000)
def repeated_families_of(line: str) -> int:
    return families_of(line)


@F.arrow_udf(ArrayType(IntegerType()))
def line_families(lines: pa.Array) -> pa.Array:
    """``families_of`` every line; lines that repeat in a batch, or short ones of earlier batches, are judged once."""
    found = lines.values.dictionary_encode()
    bits = pa.array([repeated_families_of(v) if len(v) <= 200 else families_of(v) for v in found.dictionary.to_pylist()], pa.int32())
    return pa.ListArray.from_arrays(lines.offsets, bits.take(found.indices))


def strongest_block(lines: Column, fits: Column, number: int) -> Column:
    """The block of a family with most hits, the first of equal ones; null without one.

    Hits belong together if no more than the family's lines lie between them, and a block needs
    the family's least number of hits. Dense and long blocks are surer. ``fits`` has the families of every line.
    """
    name, gap, least, _ = BLOCK_FAMILIES[number]
    every = F.transform(fits, lambda bits, i: F.when(bits.bitwiseAND(F.lit(1 << number)) != 0, i))
    hits = F.filter(every, lambda i: i.isNotNull())

    def of(h: Column) -> Column:
        blocks = F.transform(cuts(h, lambda before, i: i - before > gap), lambda r: F.struct(
            (r["last"] - r["first"] + 1).alias("n"), (-F.get(h, r["first"])).alias("a"), F.get(h, r["last"]).alias("b")))
        return F.array_max(F.filter(blocks, lambda b: b["n"] >= least))

    def block(b: Column) -> Column:
        start = -b["a"]
        # How density and length add up.
        sure = F.least(0.50 + b["n"] / (b["b"] - start + 1) * 0.30 + b["n"] * 0.03, F.lit(0.88))
        return F.when(b.isNotNull(), F.struct(
            (total_length(F.slice(lines, F.lit(1), start)) + start).alias("position"), F.lit(name).alias("section"), (F.rint(sure * 1000) / 1000).alias("confidence"),
            b["n"].alias("line_count"), start.alias("start_line"), b["b"].alias("end_line")))

    return let(let(hits, of), block).cast(BLOCK)


def content_blocks(docs: DataFrame, text: str = "text") -> DataFrame:
    """The strongest block of each family, in text order: ``doc_id, position, section, confidence, line_count, start_line, end_line``.

    A null or empty text has no blocks.
    """
    docs = docs.withColumn("_l", F.split(F.coalesce(F.col(text), F.lit("")), "\n", -1)).withColumn("_f", line_families("_l"))
    found = let(F.struct("_l", "_f"), lambda v: F.array(*[strongest_block(v["_l"], v["_f"], x) for x in range(len(BLOCK_FAMILIES))]))
    return explode_rows(docs, F.array_sort(F.filter(found, lambda b: b.isNotNull())), "doc_id")


# --- headers found again -------------------------------------------------------------
_BLANKS = re.compile(r"\s+", re.ASCII)


@lru_cache(maxsize=100_000)
def _profile(header: str) -> tuple:
    """What a comparison of headers needs: normal form, spelled-out form, stems of both."""
    norm = normalized(header)
    spelled = " ".join(HEADER_SHORT_FORMS.get(w, w) for w in norm.split(" "))
    return norm, spelled, frozenset(stems(norm)), frozenset(stems(spelled))


def _score(a: str, b: str, s: frozenset, t: frozenset, least: float) -> float:
    """``similarity.header_similarity`` of two headers; 0 where their lengths keep it below ``least``."""
    n, m = len(a), len(b)
    tokens = len(s & t) / len(s | t) if s and t else 0.0
    x, y = (0.65, 0.35) if (a.count(" ") + b.count(" ") + 2) / 2 <= 2 else (0.45, 0.55)
    blend = lambda edit: edit if n <= 3 or m <= 3 else max(edit, x * edit + y * tokens)
    if blend(1 - abs(n - m) / max(n, m)) < least - 1e-9:
        return 0.0
    return blend(1 - distance(a, b) / max(n, m))


@lru_cache(maxsize=100_000)
def header_likeness(header: str, line: str, least: float) -> float:
    """Similarity of two headers: direct or spelled out, and .88 at least where one begins with the other; less than ``least`` may be 0."""
    (a, c, s, u), (b, d, t, v) = _profile(header), _profile(line)
    spelled = _score(c, d, u, v, least) if c != a or d != b else 0.0
    return max(_score(a, b, s, t, least), spelled, 0.88 if a.startswith(b) or b.startswith(a) else 0.0)


def _like(header: str, text: str, start: int, threshold: float) -> int:
    """Position of the short line behind ``start`` most like the header; -1 without one."""
    target, best, found, at = _profile(header)[0], threshold, -1, start
    if target == "":
        return -1
    for line in text[start:].split("\n"):
        body = line.strip(SPACE)
        if body and len(body) < 80 and any(c.isalpha() for c in body) and (norm := _profile(body)[0]):
            if len(target) <= 3:
                if target in norm.split(" "):
                    return at
            elif (score := header_likeness(header, body, threshold)) > best or (score == best and found < 0):
                best, found = score, at
        at += len(line) + 1
    return found


def locate_header(header: str, text: str, low: str, start: int, threshold: float = 0.75) -> tuple[int, str | None]:
    """Where a header stands at or behind ``start``: (position, tier), position -1 without a hit; ``low`` is the lower-case text.

    Tiers: ``exact``, ``case`` (other capitals), ``space`` (other white space), ``marks`` (own
    line start, optional brackets and colon), ``fuzzy`` (the short line most like it; a header of up to
    three characters must be a word of the line). A tier is tried only where those before failed.
    """
    if (at := text.find(header, start)) >= 0:
        return at, "exact"
    if (at := low.find(header.lower(), start)) >= 0:
        return at, "case"
    parts = _BLANKS.split(header)
    if len(parts) > 1 and (m := re.compile(r"\s+".join(map(re.escape, parts)), re.I | re.ASCII).search(text, start)):
        return m.start(), "space"
    core = re.escape(header.rstrip(":").strip("[]").strip(" "))
    marked = re.compile(rf"[ \t]*\[?\s*{core}\s*\]?\s*:?", re.I | re.ASCII)
    # the first line may begin at ``start`` itself
    at = start if start == 0 or text[start - 1:start] == "\n" else text.find("\n", start) + 1 or -1
    while at >= 0:
        if marked.match(text, at):
            return at, "marks"
        at = text.find("\n", at) + 1 or -1
    at = _like(header, text, start, threshold)
    return (at, "fuzzy") if at >= 0 else (-1, None)


def located(text: str, headers: list[str | None], threshold: float) -> list[tuple]:
    """(ord, header, position, tier) of given headers in order, each searched only behind the one found before it."""
    out, at, low = [], 0, text.lower()
    for i, raw in enumerate(headers):
        header = (raw or "").strip(SPACE)
        if header:
            position, tier = locate_header(header, text, low, at, threshold)
            if position >= 0:
                out.append((i, header, position, tier))
                at = position + len(header)
    return out


LOCATED = StructType().add("ord", IntegerType()).add("header", StringType()).add("position", IntegerType()).add("tier", StringType())


def _located(texts: pa.Array, headers: pa.Array, threshold: float) -> pa.Array:
    rows = [located(t or "", hs or [], threshold) for t, hs in zip(texts.to_pylist(), headers.to_pylist())]
    return list_of(rows, [("ord", pa.int32()), ("header", pa.string()), ("position", pa.int32()), ("tier", pa.string())])


def locate_headers(docs: DataFrame, headers: str = "headers", text: str = "text", threshold: float = 0.75) -> DataFrame:
    """Given headers in document order, each searched only behind the one found before it.

    ``docs`` has ``doc_id``, the text and an array of headers. One row per header that is found:
    ``doc_id, ord, header, position, tier``; positions never decrease. One that is not found
    leaves the place of the search as it is; blank and null headers, and null texts, find nothing.
    """
    @F.arrow_udf(ArrayType(LOCATED))
    def run(texts: pa.Array, given: pa.Array) -> pa.Array:
        return _located(texts, given, threshold)

    return explode_rows(docs.withColumn("_r", run(F.col(text), F.col(headers))), F.col("_r"), "doc_id")
