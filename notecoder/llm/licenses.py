"""License scans: an exact set-similarity join of text blocks with license templates.

A template is a set of words; a block is a window of a text's words, twice as long as the
template's length class, at every multiple of the class, so every stretch as long as the
template lies whole in some window. All template words are ordered by their count in the whole
corpus, rarest first. A template and a block that share enough words share one of the template's
first words in that order (prefix), the block has enough template words at all (length), and
enough words follow the shared one on both sides (position); what is left is verified on the
full sets.
"""
from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import ship_package
from .shared import written
from .terms import terms, texts

# Phrases whose words must stand consecutively, and their labels.
PHRASES = [("under the mit license", "mit"), ("apache license version 2", "apache-2"), ("cc by nc", "cc-by-nc")]

# Wording of public license notices, and their labels.
TEMPLATES = [
    ("mit", "released under the mit license"),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
            "documentation files (the Software), to deal in the Software without restriction, including without limitation the "
            "rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to "
            "permit persons to whom the Software is furnished to do so, subject to the following conditions"),
    ("apache-2", "licensed under the apache license version 2 0"),
    ("apache-2", "you may not use this file except in compliance with the License. You may obtain a copy of the License at "
                 "apache.org/licenses/LICENSE-2.0. Unless required by applicable law or agreed to in writing, software distributed "
                 "under the License is distributed on an AS IS basis, without warranties or conditions of any kind"),
    ("gpl", "licensed under the gnu general public license"),
    ("gpl", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public "
            "License as published by the Free Software Foundation, either version of the License, or (at your option) any later version"),
    ("lgpl", "licensed under the gnu lesser general public license"),
    ("lgpl", "This library is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General "
             "Public License as published by the Free Software Foundation, either version of the License, or (at your option) any later version"),
    ("agpl", "licensed under the gnu affero general public license"),
    ("bsd", "released under the bsd license"),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the "
            "following conditions are met: redistributions of source code must retain the above copyright notice, this list of "
            "conditions and the following disclaimer"),
    ("mpl-2", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not "
              "distributed with this file, you can obtain one at mozilla.org"),
    ("cc-by", "licensed under cc by 4 0"),
    ("cc-by-sa", "licensed under cc by sa 4 0"),
    ("cc-by-nc", "licensed under cc by nc 4 0"),
    ("cc-by-nd", "licensed under cc by nd 4 0"),
    ("cc-by", "licensed under a creative commons attribution international license"),
    ("cc-by-sa", "licensed under a creative commons attribution sharealike international license"),
    ("cc-by-nc", "licensed under a creative commons attribution noncommercial international license"),
    ("cc0", "the person who associated a work with this deed has dedicated the work to the public domain"),
    ("all-rights-reserved", "all rights reserved"),
]
#: Share of a template's distinct words that a block must hold, as a fraction.
ENOUGH = (9, 10)
#: The least length class; classes double.
LEAST_CLASS = 8


@dataclass(frozen=True)
class Template:
    label: str
    words: tuple[bytes, ...]  # distinct, rarest first
    size: int  # length class
    need: int  # words that a block must hold

    def prefix(self) -> tuple[bytes, ...]:
        return self.words[:len(self.words) - self.need + 1]


def compiled(templates: list[tuple[str, str]], counts: dict[bytes, int], enough: tuple[int, int] = ENOUGH) -> list[Template]:
    """Templates with their words in global order: by corpus count, equal counts by the word's bytes."""
    out = []
    for label, text in templates:
        found = terms(text.encode())
        size = LEAST_CLASS
        while size < len(found):
            size *= 2
        distinct = tuple(sorted(set(found), key=lambda w: (counts.get(w, 0), w)))
        if distinct:
            out.append(Template(label, distinct, size, -(-len(distinct) * enough[0] // enough[1])))
    return out


def _counts(vocabulary: set[bytes]):
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: Counter = Counter()
        for _, bodies in texts(batches):
            for body in bodies:
                total.update(w for w in terms(body) if w in vocabulary)
        yield pa.RecordBatch.from_pydict({"word": pa.array(list(total), pa.binary()), "n": pa.array(list(total.values()), pa.int64())})

    return count


_BLOCKS = pa.list_(pa.struct([("size", pa.int32()), ("at", pa.int64()), ("words", pa.list_(pa.int32()))]))


def _scan(phrases: list[tuple[tuple[bytes, ...], int, str]], rank: dict[bytes, int], sizes: dict[int, tuple[frozenset, frozenset, int]]):
    """Per document its phrases, and the blocks that hold a template's prefix word, as word ranks.

    ``sizes`` has for each length class the prefix words, all words and the least need of its templates.
    """
    watched = frozenset().union(*[p for p, _, _ in sizes.values()], [words[k] for words, k, _ in phrases])

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, bodies in texts(batches):
            rows: list[tuple] = []
            for body in bodies:
                found = terms(body)
                hits = [x for x, w in enumerate(found) if w in watched]
                places, labels, blocks = [], set(), []
                for words, k, label in phrases:
                    own = [x - k for x in hits if found[x] == words[k] and x >= k and tuple(found[x - k:x - k + len(words)]) == words]
                    places += own
                    labels |= {label} if own else set()
                for size, (prefix, all_words, need) in sizes.items():
                    at = {b for x in hits if found[x] in prefix for b in (x // size, x // size - 1) if b >= 0}
                    for b in sorted(at):
                        own = all_words.intersection(found[b * size:(b + 2) * size])
                        if len(own) >= need:
                            blocks.append((size, b * size, sorted(rank[w] for w in own)))
                rows.append((len(found), len(places), min(places, default=None), max(places, default=None), sorted(labels), blocks))
            n, base, first, last, labels, blocks = zip(*rows) if rows else ((),) * 6
            yield pa.RecordBatch.from_pydict({
                "doc_id": ids, **{k: pa.array(v, pa.int64()) for k, v in (("n_words", n), ("n_base", base), ("first_word", first), ("last_word", last))},
                "base": pa.array(labels, pa.list_(pa.string())),
                "blocks": pa.array([[dict(zip(("size", "at", "words"), b)) for b in bs] for bs in blocks], _BLOCKS)})

    return scan


def _of(values: list, kind: str, at: Column) -> Column:
    """The entry of a constant list."""
    return F.get(F.array(*[F.lit(v) if not isinstance(v, list) else F.array(*map(F.lit, v)) for v in values]).cast(f"array<{kind}>"), at)


def scanned(docs: DataFrame, phrases: list[tuple[str, str]] = PHRASES, templates: list[tuple[str, str]] = TEMPLATES,
            enough: tuple[int, int] = ENOUGH) -> DataFrame:
    """Licenses of each text: one row per row of ``docs`` (``doc_id``, ``text``; other columns are not read).

    ``doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score, spans``: words
    are maximal runs of ASCII digits, letters (A-Z lower-cased) and anything beyond ASCII.
    ``n_base`` counts the places of ``phrases``, overlapping ones too, from ``first_word`` to
    ``last_word`` (null without any). ``spans`` are the blocks with at least the share ``enough``
    of a template's distinct words: ``label, at, size`` (of ``2 * size`` words from ``at``) and
    ``containment``. If all words of a matching template are among those of a longer one that
    matches the same block, only the longer one counts. ``labels`` joins both kinds; ``score`` is
    1 with a phrase, else the greatest containment, else 0.

    A null or empty text has no words, labels or spans. Repeated rows and ids give repeated rows.
    Phrases and templates are parameters held by every task; the table may be of any size. A
    template without words never matches.
    """
    ship_package(docs.sparkSession)
    id_type = docs.schema["doc_id"].dataType.simpleString()
    body = docs.select("doc_id", "text")
    cut = [(tuple(terms(p.encode())), label) for p, label in phrases]
    vocabulary = {w for p, _ in cut for w in p} | {w for t in compiled(templates, {}) for w in t.words}
    counted = body.mapInArrow(_counts(vocabulary), "word binary, n bigint").groupBy("word").agg(F.sum("n").alias("n"))
    counts = {bytes(r.word): r.n for r in counted.collect()}  # no more rows than template words
    made = compiled(templates, counts, enough)
    rank = {w: x for x, w in enumerate(sorted({w for t in made for w in t.words}, key=lambda w: (counts.get(w, 0), w)))}
    sizes = {}
    for size in sorted({t.size for t in made}):
        own = [t for t in made if t.size == size]
        sizes[size] = (frozenset(w for t in own for w in t.prefix()), frozenset(w for t in own for w in t.words), min(t.need for t in own))
    rarest = [(p, min(range(len(p)), key=lambda k: counts.get(p[k], 0)), label) for p, label in cut if p]
    rows = body.mapInArrow(_scan(rarest, rank, sizes), f"doc_id {id_type}, n_words bigint, n_base bigint, first_word bigint, last_word bigint, "
                           "base array<string>, blocks array<struct<size:int,at:bigint,words:array<int>>>")
    rows = written(rows.withColumn("row", F.monotonically_increasing_id()), "licenses")
    spans = _matches(rows, made, rank).groupBy("row").agg(F.array_sort(F.collect_list("span")).alias("spans"))
    out = rows.drop("blocks").join(spans, "row", "left").withColumn(
        "spans", F.coalesce("spans", F.array().cast("array<struct<label:string,at:bigint,size:int,containment:double>>")))
    best = F.coalesce(F.array_max(F.transform("spans", lambda s: s["containment"])), F.lit(0.0))
    labels = F.array_sort(F.array_union("base", F.transform("spans", lambda s: s["label"])))
    return out.select(
        "doc_id", "n_words", "n_base", "first_word", "last_word", F.array_join("base", ",").alias("base_labels"),
        F.array_join(labels, ",").alias("labels"), F.when(F.col("n_base") > 0, 1.0).otherwise(best).alias("score"), "spans")


def _matches(rows: DataFrame, made: list[Template], rank: dict[bytes, int]) -> DataFrame:
    """``row, span`` for every block and template that meet the threshold."""
    index = [(t.size, rank[w], x, i) for x, t in enumerate(made) for i, w in enumerate(t.prefix())]
    index = rows.sparkSession.createDataFrame(index, "size int, word int, template int, i int")
    blocks = rows.select("row", F.explode("blocks").alias("b")).select("row", "b.*").withColumn("n", F.size("words"))
    blocks = blocks.select("*", F.posexplode("words").alias("j", "word"))
    n = _of([len(t.words) for t in made], "int", F.col("template"))
    need = _of([t.need for t in made], "int", F.col("template"))
    # length: n >= need; position: what follows the shared word on either side still reaches the need
    hits = blocks.join(F.broadcast(index), ["size", "word"]).where(
        (F.col("n") >= need) & (F.least(n - F.col("i"), F.col("n") - F.col("j")) >= need))
    pairs = hits.groupBy("row", "size", "at", "template").agg(F.first("words").alias("words"))
    full = _of([sorted(rank[w] for w in t.words) for t in made], "array<int>", F.col("template"))
    pairs = pairs.withColumn("held", F.size(F.array_intersect("words", full))).where(F.col("held") >= need)
    longer = [[y for y, u in enumerate(made) if u.size == t.size and set(t.words) < set(u.words)] for t in made]
    same = pairs.groupBy("row", "size", "at").agg(F.collect_list(F.struct("template", (F.col("held") / n).alias("containment"))).alias("m"))
    kept = F.filter("m", lambda x: ~F.arrays_overlap(F.transform("m", lambda y: y["template"]), _of(longer, "array<int>", x["template"])))
    label = _of([t.label for t in made], "string", F.col("k.template"))
    return same.select("row", "size", "at", F.explode(kept).alias("k")).select(
        "row", F.struct(label.alias("label"), "at", "size", F.col("k.containment").alias("containment")).alias("span"))
