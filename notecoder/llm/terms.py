"""Terms of a text as bytes: what op11 and op12 take as words, cut at native speed in Python workers."""
from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa

#: Maximal runs of ASCII digits, ASCII letters (A-Z lower-cased) and anything beyond ASCII; the rest separates.
_TABLE = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def terms(text: bytes | None) -> list[bytes]:
    """All terms in order, repeats included; a null text has none."""
    return text.translate(_TABLE).split() if text else []


def texts(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Array, list[bytes | None]]]:
    """The first column and the second column's texts as UTF-8 bytes, batch by batch."""
    for batch in batches:
        yield batch.column(0), batch.column(1).cast(pa.binary()).to_pylist()
