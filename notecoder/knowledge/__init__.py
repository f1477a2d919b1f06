"""Knowledge tables of the coding engine, held as plain text and parsed once.

Order matters in every table: where several entries could apply, the first one wins.
"""
from __future__ import annotations


def words(block: str) -> list[str]:
    """Comma-separated entries of a text block, in order, stripped."""
    return [w.strip() for w in block.replace("\n", " ").split(",") if w.strip()]


def quoted(block: str) -> list[str]:
    """Entries between vertical bars; inner blanks are significant."""
    return [w for w in block.replace("\n", "").split("|") if w]


def pairs(block: str) -> list[tuple[str, str]]:
    """``key = value`` lines, in order."""
    out = []
    for line in block.strip().splitlines():
        if line.strip():
            key, value = line.split("=", 1)
            out.append((key.strip(), value.strip()))
    return out
