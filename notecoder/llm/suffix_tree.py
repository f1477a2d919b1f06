"""Substring dedup over words: suffix trees of prefix groups, whose deep nodes give the repeats."""
from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame

from .repeats import Search, Words, without_repeats

WINDOW = 20
GRAM = 6


def deep_nodes(words: np.ndarray, starts: np.ndarray, depth: int = WINDOW) -> np.ndarray:
    """The node at ``depth`` words under which each suffix hangs; -1 for suffixes that part before.

    The trees are built from the roots down: a node's suffixes split by their next word, a
    suffix left alone is a leaf and drops out, so only repeated prefixes are followed.
    """
    out = np.full(len(starts), -1, np.int64)
    alive = np.arange(len(starts))
    node = np.zeros(len(starts), np.int64)
    for d in range(depth):
        if not len(alive):
            return out
        word = words[starts[alive] + d]
        order = np.lexsort((word, node))
        n, w = node[order], word[order]
        new = np.concatenate([[True], (n[1:] != n[:-1]) | (w[1:] != w[:-1])])
        child = np.cumsum(new) - 1
        inner = np.bincount(child)[child] > 1
        alive, node = alive[order[inner]], child[inner]
    out[alive] = node
    return out


SEARCH = Search(Words, WINDOW, GRAM, deep_nodes, first_stays=True)


def deduplicated(docs: DataFrame, full: bool = False) -> DataFrame:
    """Remove every word under a 20-word window whose words also start earlier.

    Earlier is a smaller ``doc_id``, or the same document and an earlier start. See
    ``repeats.without_repeats`` for columns, nulls, ties and empty tables.
    """
    return without_repeats(docs, SEARCH, full)
