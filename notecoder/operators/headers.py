"""Header candidates of a note: what the patterns find, cleaned, accepted and scored.

A note is cut into lines once. Patterns that stay in a line are held against each distinct line once;
those whose white space may reach into the next lines are tried only where a line can begin a match.
"""
from __future__ import annotations

import re
from decimal import ROUND_HALF_EVEN, Decimal
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, IntegerType, StringType, StructType

from ..knowledge import sections as ks

M = "(?d)(?m)"
# Header patterns in candidate order; the header text is group 1.
HEADER_PATTERNS = {
    "bracketed": r"\[([^\[\]\n]{2,60})\]",
    "colon_block": M + r"^[ \t]*([A-Z][A-Za-z0-9 \t/,()\-]{1,60}?):[ \t]*$",
    "ehr_timestamp": r"([A-Z][A-Za-z][A-Za-z ]{0,38}?)\s*;\s*[0-9]{1,2}/[0-9]{1,2}/[0-9]{2,4}(?:\s+[0-9]{1,2}:[0-9]{2}\s*(?:AM|PM))?\s*\)?",
    "allcaps": M + r"^[ \t]*([A-Z]{2}[A-Z\s/\-]{1,48})[ \t]*$",
    "colon_inline": M + r"^[ \t]*((?:[A-Z][a-z]+(?:\s+[A-Za-z/]+){0,5}))\s*:\s+(.{1,120})$",
    "numbered": M + r"^[ \t]*(?:[0-9]+\.|[IVXivx]+\.|[A-Z]\))\s+([A-Z][A-Za-z /\-&]{2,50})[ \t]*$",
    "decorated": M + r"^[ \t]*[=*_\-]{2,}[ \t]*([A-Za-z][A-Za-z0-9 /&]{2,50})[ \t]*[=*_\-]{2,}[ \t]*$",
    "standalone": M + r"^[ \t]*([A-Z][a-z]+(?:[ \t]+[A-Za-z][a-z]*){0,4})[ \t]*$",
    "standalone_lower": M + r"^[ \t]*([a-z][a-z /\-]{1,43})[ \t]*$",
}
CLEANERS = [
    r"(?i)\s*;\s*[0-9]{1,2}/[0-9]{1,2}/[0-9]{2,4}(?:\s+[0-9]{1,2}:[0-9]{2}\s*(?:AM|PM))?\s*\)?\s*\z",
    r"(?i)\s+as\s+of\s+[0-9/,\w]+[;:)]*\s*\z",
    r"\s*\(\s*[0-9/,\w]+\s*\)\s*\z",
    r"\s+[0-9]{1,2}[/-][0-9]{1,2}[/-][0-9]{2,4}\s*\z",
    r"\s*[-–]?\s*[Pp]age\s+[0-9]+\s*\z",
]
BASE = dict(ks.HEADER_BASE_SCORES)
#: What every cleaner needs; most headers have none of it.
CLEANABLE = r"(?i)[0-9;:()]|\sas\s"
LIST_START = M + r"^\s*(?:[-*•]|[0-9]+[.)]\s|[a-zA-Z]\))"

SPACE = " \t\n\v\f\r"
LETTERS = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"


def _compiled(pattern: str) -> re.Pattern:
    """The pattern as Java reads it: classes of ASCII, lines that end at a line feed only."""
    return re.compile(pattern.replace("(?d)", "").replace(r"\z", r"\Z"), re.ASCII)


KINDS = list(HEADER_PATTERNS)
_RANK = {k: i for i, k in enumerate(KINDS)}
_TYPES = [k.replace("_lower", "") for k in KINDS]
_BASES = [BASE[t] for t in _TYPES]
_PATTERNS = [_compiled(p) for p in HEADER_PATTERNS.values()]
_IN_LINE = [(_RANK[k], _PATTERNS[_RANK[k]].finditer) for k in ("bracketed", "colon_block", "decorated", "standalone", "standalone_lower")]
# a match begins at the start of a line, and goes on to its end or past a colon: what that line must look like
_ACROSS = [(_RANK[k], _PATTERNS[_RANK[k]].match, re.compile(first, re.ASCII).match) for k, first in (
    ("allcaps", r"[ \t]*[A-Z]{2}[A-Z\s/\-]*\Z"),
    ("colon_inline", r"[ \t]*[A-Z][a-z]+(?:\s+[A-Za-z/]+)*\s*(?::|\Z)"),
    ("numbered", r"[ \t]*(?:[0-9]+\.|[IVXivx]+\.|[A-Z]\))\s+(?:[A-Z][A-Za-z /\-&]{2,50}[ \t]*)?\Z|[ \t]*(?:[0-9]+\.|[IVXivx]+\.|[A-Z]\))\Z"),
)]
_STAMP, _STAMPED, _INLINE = _RANK["ehr_timestamp"], _compiled(r";\s*[0-9]{1,2}/[0-9]{1,2}/[0-9]{2,4}").match, _RANK["colon_inline"]
_CLEANERS, _CLEANABLE = [_compiled(p) for p in CLEANERS], _compiled(CLEANABLE).search
_SPACES, _NUMBERS, _DIGIT = re.compile(r"\s+", re.ASCII), re.compile(r"[0-9/\-.,: ]+\Z"), re.compile("[0-9]")
_BODY, _LIST = re.compile(r"\s*\n\s*\S", re.ASCII).match, _compiled(LIST_START).search
_LABELS, _INLINE_REJECTS, _FRAGMENTS = set(ks.COLUMN_LABELS), set(ks.INLINE_REJECT_STARTS), set(ks.FRAGMENT_STARTS)
#: Lines and headers up to this length are remembered by a worker.
SHORT = 200


def _line(line: str) -> tuple[tuple, tuple]:
    """Matches inside a line as (rank, start, stop, body), and the patterns that may begin here and go on."""
    inside = tuple((rank, m.start(), m.end(), m[1]) for rank, find in _IN_LINE for m in find(line))
    return inside, tuple((rank, match) for rank, match, may in _ACROSS if may(line))


_known_line = lru_cache(maxsize=100_000)(_line)


def hits(text: str) -> list[tuple]:
    """Every match of every pattern as (start, rank, stop, body, inline value); one pattern's matches don't overlap."""
    found, at = [], 0
    ends = dict.fromkeys((rank for rank, _, _ in _ACROSS), 0)
    for line in text.split("\n"):
        inside, across = _known_line(line) if len(line) <= SHORT else _line(line)
        for rank, start, stop, body in inside:
            found.append((at + start, rank, at + stop, body, None))
        for rank, match in across:
            if at >= ends[rank] and (m := match(text, at)):
                ends[rank] = m.end()
                found.append((at, rank, m.end(), m[1], m[2].strip(" ") if rank == _INLINE else None))
        at += len(line) + 1
    # a time stamp's header is letters and white space up to a semicolon
    low, at = 0, text.find(";")
    while at >= 0:
        if _STAMPED(text, at):
            m = _PATTERNS[_STAMP].search(text, low + len(text[low:at].rstrip(LETTERS + SPACE)))
            if not m:
                break
            found.append((m.start(), _STAMP, m.end(), m[1], None))
            low = m.end()
        else:
            low = at + 1
        at = text.find(";", low)
    return found


def _words(header: str) -> int:
    body = header.strip(SPACE)
    return len(_SPACES.split(body)) if body else 0


def _header(rank: int, raw: str) -> str | None:
    """The cleaned header, or None where a pattern family doesn't take it as a candidate at all."""
    header = raw.strip(SPACE)
    if _CLEANABLE(header):
        for p in _CLEANERS:
            header = p.sub("", header).strip(SPACE)
        header = header.rstrip(";:)").strip(SPACE)
    if not header:
        return None
    kind, low = KINDS[rank], header.lower()
    label = low in _LABELS
    taken = (
        not _NUMBERS.match(header) and not label if kind == "bracketed" else
        _words(header) <= 8 and not label if kind == "colon_block" else
        _words(header) <= 6 if kind == "ehr_timestamp" else
        _SPACES.split(low, maxsplit=1)[0] not in _INLINE_REJECTS and not label if kind == "colon_inline" else
        _words(header) >= 2 if kind == "numbered" else
        len(header) >= 3 and not label if kind in ("allcaps", "standalone") else
        len(header) >= 3 and _words(header) <= 5 if kind == "standalone_lower" else True
    )
    return header if taken else None


_known_header = lru_cache(maxsize=100_000)(_header)


@lru_cache(maxsize=100_000)
def _wording(header: str) -> tuple[float, float, float, float, float]:
    """Adjustments for a header's wording, in the order they are added."""
    low = header.lower()
    # Adjustments.
    return (0.08 if " and " in low or "&" in header else 0.0, 0.20 if len(header.strip(SPACE)) < 4 else 0.0, 0.10 if _DIGIT.search(header) else 0.0,
            0.35 if _SPACES.split(low, maxsplit=1)[0] in _FRAGMENTS else 0.0, 0.25 if _words(header) > 8 else 0.0)


@lru_cache(maxsize=10_000)
def _rounded(score: float) -> float:
    """Half to even by the number's shortest decimal form, between 0 and 1."""
    return max(0.0, min(1.0, float(Decimal(repr(score)).quantize(Decimal("0.001"), ROUND_HALF_EVEN))))


def score(rank: int, header: str, before: str, after: str) -> float:
    """Base score adjusted by what stands around the header and by its wording."""
    joined, brief, digit, fragment, wordy = _wording(header)
    around = 0.10 if "\n\n" in before or not before.strip(SPACE) else 0.0
    body, listed = 0.05 if _BODY(after) else 0.0, 0.10 if _LIST(after) else 0.0
    return _rounded(_BASES[rank] + around + body + listed + joined - brief - digit - fragment - wordy)


def candidates(text: str) -> list[tuple]:
    """(position, header, rank, confidence, inline value, stop) in text order, the best pattern per position."""
    kept = []
    for start, rank, stop, raw, inline in hits(text):
        header = _known_header(rank, raw) if len(raw) <= SHORT else _header(rank, raw)
        if header is not None:
            kept.append((start, -_BASES[rank], rank, stop, header, inline))
    kept.sort(key=lambda c: c[:3])
    out, last = [], -1
    for start, _, rank, stop, header, inline in kept:
        if start != last:
            out.append((start, header, rank, score(rank, header, text[max(start - 30, 0):start], text[stop:stop + 80]), inline, stop))
            last = start
    return out


CANDIDATE = (StructType().add("position", IntegerType()).add("header", StringType()).add("pattern_type", StringType()).add("base_score", DoubleType())
             .add("confidence", DoubleType()).add("inline_value", StringType()).add("stop", IntegerType()))


@F.arrow_udf(ArrayType(CANDIDATE))
def candidates_of(texts: pa.Array) -> pa.Array:
    """``candidates`` of each text; a null text has null."""
    offsets, rows, missing = [0], [], []
    for t in texts.to_pylist():
        missing.append(t is None)
        if t is not None:
            rows += candidates(t)
        offsets.append(len(rows))
    position, header, rank, confidence, inline, stop = zip(*rows) if rows else ((),) * 6
    ranks = pa.array(rank, pa.int32())
    fields = {
        "position": pa.array(position, pa.int32()), "header": pa.array(header, pa.string()), "pattern_type": pa.array(_TYPES).take(ranks),
        "base_score": pa.array(_BASES).take(ranks), "confidence": pa.array(confidence, pa.float64()), "inline_value": pa.array(inline, pa.string()),
        "stop": pa.array(stop, pa.int32()),
    }
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.StructArray.from_arrays(list(fields.values()), list(fields)), mask=pa.array(missing))
