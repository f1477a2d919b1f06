"""Section detection: header candidates, canonical names, slicing and merging.

Everything up to the section list of a document runs inside its row: no text is shuffled.
"""
from __future__ import annotations

import re
from difflib import SequenceMatcher
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, IntegerType, StringType, StructType

from ..functions import similarity as sim
from ..functions import text as tx
from ..functions.arrays import constant_rows, explode_rows, let
from ..knowledge import sections as ks
from .headers import BASE, CLEANABLE, CLEANERS, HEADER_PATTERNS, M, SPACE, candidates, candidates_of  # noqa: F401

def strip(col: Column) -> Column:
    return F.regexp_replace(col, r"\A\s+|\s+\z", "")


def clean_header(raw: Column) -> Column:
    def cleaned(c: Column) -> Column:
        for p in CLEANERS:
            c = strip(F.regexp_replace(c, p, ""))
        return strip(F.regexp_replace(c, r"[;:)]+\z", ""))

    return let(strip(raw), lambda c: F.when(c.rlike(CLEANABLE), cleaned(c)).otherwise(c))


def word_count(col: Column) -> Column:
    return F.when(strip(col) == "", F.lit(0)).otherwise(F.size(F.split(strip(col), r"\s+")))


def with_candidates(docs: DataFrame, text: str = "text") -> DataFrame:
    """Add ``candidates``: accepted headers in text order, the best pattern per position."""
    return docs.withColumn("candidates", candidates_of(F.col(text)))


def header_candidates(docs: DataFrame, text: str = "text") -> DataFrame:
    """One row per header candidate: position, header, pattern_type, scores, inline value."""
    return explode_rows(with_candidates(docs, text), F.col("candidates"), "doc_id")


# --- canonical names ---------------------------------------------------------------
def _variants() -> Column:
    """The variant table with the normalized form, words and stems each score needs."""
    rows = []
    for priority, variant, section in ks.VARIANT_ROWS:
        norm = " ".join("".join(" " if c in "[]:*=_-–—" else c for c in variant).split())
        rows.append({"p": priority, "v": variant, "n": norm, "s": section, "t": stems(norm)})
    return constant_rows(rows, "p int, v string, n string, s string, t array<string>")


def stems(norm: str) -> list[str]:
    """The stemmed words of a constant header (the column form is ``text.stemmed_tokens``)."""
    out = []
    for w in norm.split(" "):
        if len(w) > 1 and w not in ks.HEADER_STOP_WORDS:
            cut = next((s for s in ks.STEM_SUFFIXES if len(w) > len(s) + 2 and w.endswith(s)), None)
            if cut is None:
                cut = next((s for s, least in ks.STEM_ENDINGS if w.endswith(s) and len(w) - len(s) >= least), "")
            stem = w[: len(w) - len(cut)]
            if stem not in out:
                out.append(stem)
    return out


VARIANT_NORMS = [" ".join("".join(" " if c in "[]:*=_-–—" else c for c in v).split()) for _, v, _ in ks.VARIANT_ROWS]


@lru_cache(maxsize=100_000)
def _edits(header: str) -> list[float]:
    return [SequenceMatcher(None, header, n).ratio() if header and n else 0.0 for n in VARIANT_NORMS]


def match_canonical(norm: Column, threshold: Column, edits: Column | None = None, low_scores: bool = True) -> Column:
    """Canonical section of a normalized header as struct(section, score).

    Tiers: known variant (1.0), variant after dropping stop words (.98), best similarity at
    or above the threshold, then containment covering three quarters (.85 or .80). ``edits``
    holds edit similarities per variant; without it they come from ``levenshtein``. Without
    ``low_scores`` a score below the threshold may be null: variants that can't reach it are passed over.
    """
    exact = tx.literal_map({v: s for _, v, s in ks.VARIANT_ROWS}.items())
    answer = lambda s, c: F.struct(s.cast("string").alias("section"), c.cast("double").alias("score"))
    none = answer(F.lit(None), F.lit(0.0))

    def judge(h: Column) -> Column:
        """``h`` holds the norm, its words joined without stop words, and its stems."""
        n = h["norm"]
        direct, stripped = F.try_element_at(exact, n), F.try_element_at(exact, h["words"])
        return (
            F.when((n == "") | n.isin(ks.NOT_SECTION_LABELS), none)
            .when((F.length(n) <= 3) & direct.isNull(), none)
            .when(direct.isNotNull(), answer(direct, F.lit(1.0)))
            .when(stripped.isNotNull(), answer(stripped, F.lit(0.98)))
            .otherwise(let(_similar(n, h["stems"], edits, None if low_scores else threshold), lambda x: (
                F.when(x["best"]["score"] >= threshold, answer(x["best"]["s"], x["best"]["score"]))
                .when(x["inside"].isNotNull(), answer(x["inside"]["s"], x["inside"]["cover"]))
                .otherwise(answer(F.lit(None), x["best"]["score"]))
            )))
        )

    with_tokens = lambda n: let(F.struct(n.alias("n"), tx.header_tokens(n).alias("t")), lambda x: F.struct(
        x["n"].alias("norm"), F.array_join(x["t"], " ").alias("words"),
        F.array_distinct(F.transform(x["t"], tx.stem)).alias("stems"),
    ))
    return let(let(norm, with_tokens), judge)


def _similar(norm: Column, stems: Column, edits: Column | None, least: Column | None = None) -> Column:
    """Best scored variant, and the first variant that covers the header (or the reverse).

    With ``least``, variants whose score can't reach it are not scored: without a shared stem the
    score is the edit similarity, which the difference of the lengths bounds.
    """
    table = _variants()

    def within_reach(b: Column) -> Column:
        near = lambda m: F.abs(b["n"] - m) <= b["slack"] * F.greatest(b["n"], m)
        return F.filter(table, lambda v: near(F.length(v["n"])) | F.arrays_overlap(stems, v["t"]))

    def score(v: Column, i: Column) -> Column:
        edit = sim.levenshtein_similarity(norm, v["n"]) if edits is None else F.get(edits, i)
        total = sim.header_similarity(edit, sim.jaccard(stems, v["t"]), norm, v["n"])
        return F.struct(total.alias("score"), (-v["p"]).alias("p"), v["s"].alias("s"))

    def cover(v: Column) -> Column:
        n, m = F.length(norm), F.length(v["v"])
        return (
            F.when((m >= 6) & F.contains(norm, v["v"]) & (m / n >= 0.75), F.lit(0.85))
            .when((n >= 6) & F.contains(v["v"], norm) & (n / m >= 0.75), F.lit(0.80))
        )

    covered = F.filter(
        F.transform(table, lambda v: F.struct(v["s"].alias("s"), cover(v).alias("cover"))), lambda c: c["cover"].isNotNull()
    )
    scored = table if least is None or edits is not None else let(
        F.struct(F.length(norm).alias("n"), (1 - least + 1e-6).alias("slack")), within_reach)
    return F.struct(F.array_max(F.transform(scored, score)).alias("best"), F.get(covered, F.lit(0)).alias("inside"))


def header_key(header: Column) -> Column:
    """Lower-case header without brackets and a closing colon."""
    k = F.regexp_replace(F.trim(F.lower(header)), r"\A[\[\]]+|[\[\]]+\z", "")
    return F.trim(F.regexp_replace(k, r":+\z", ""))


def validate_header(header: Column, edits: Column | None = None) -> Column:
    """Header to struct(kind, section): main, subsection or rejected, without a model."""
    known = tx.literal_map(ks.HEADER_MAP)
    table = constant_rows([{"h": h, "s": s} for h, s in ks.HEADER_MAP if len(h) >= 3], "h string, s string")
    answer = lambda kind, s: F.struct(F.lit(kind).alias("kind"), s.cast("string").alias("section"))
    null = F.lit(None)

    def judge(key: Column) -> Column:
        within = F.get(F.filter(table, lambda p: F.contains(key, p["h"])), F.lit(0))["s"]
        threshold = F.when(F.size(F.split(key, " ")) <= 1, F.lit(0.88)).otherwise(F.lit(0.78))
        fuzzy = match_canonical(tx.normalize_header(header), threshold, edits, low_scores=False)["section"]
        named = F.coalesce(F.try_element_at(known, key), within, fuzzy)
        return F.when(key.isin(ks.REJECTED_HEADERS) | key.isin(ks.NOISE_HEADERS), answer("rejected", null)).otherwise(
            let(named, lambda s: F.when(s.isNotNull(), answer("main", s))
                .when(key.isin(ks.SUBSECTION_NAMES), answer("subsection", null))
                .otherwise(answer("rejected", null)))
        )

    return let(header_key(header), judge)


def distance(a: str, b: str) -> int:
    """Inserted, deleted and replaced characters between two strings."""
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        corner, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            corner, row[j] = row[j], corner if x == y else 1 + min(corner, row[j], row[j - 1])
    return row[-1]


_EXACT = {v: s for _, v, s in ks.VARIANT_ROWS}
_MAIN = dict(ks.HEADER_MAP)
_WITHIN = [(h, s) for h, s in ks.HEADER_MAP if len(h) >= 3]
_REJECTED = {*ks.REJECTED_HEADERS, *ks.NOISE_HEADERS}
_VARIANT_STEMS = [set(stems(n)) for n in VARIANT_NORMS]


#: White space of Unicode as Java counts it.
WHITE_CHARS = [chr(c) for c in (*range(0x09, 0x0E), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)]
WHITE = r"[\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]"


def normalized(header: str) -> str:
    """``text.normalize_header`` of one header."""
    h = re.sub(r"[\[\]:*=_\-–—]+", " ", header.lower().strip(" "))
    for p in (r"\s*\([^)]*\)\s*\Z", r"\A\s*\([^)]*\)\s*"):
        h = re.sub(p, "", h, flags=re.ASCII)
    return re.sub(WHITE + "+", " ", h).strip(" ")


def _canonical(norm: str, threshold: float, edits: list[float] | None) -> tuple[str | None, float]:
    """``match_canonical`` of one header; variants that can't reach the threshold are not compared, so a lower score may be 0."""
    tokens = [w for w in norm.split(" ") if len(w) > 1 and w not in ks.HEADER_STOP_WORDS]
    direct, stripped = _EXACT.get(norm), _EXACT.get(" ".join(tokens))
    if norm == "" or norm in ks.NOT_SECTION_LABELS or (len(norm) <= 3 and direct is None):
        return None, 0.0
    if direct is not None or stripped is not None:
        return (stripped, 0.98) if direct is None else (direct, 1.0)
    own, n, words, best, inside = set(stems(norm)), len(norm), norm.count(" ") + 1, None, None
    for k, ((p, v, section), other, theirs) in enumerate(zip(ks.VARIANT_ROWS, VARIANT_NORMS, _VARIANT_STEMS)):
        m, shared = len(other), len(own & theirs)
        longest = max(n, m)
        if edits is not None or shared or abs(n - m) <= (1 - threshold + 1e-6) * longest:
            edit = edits[k] if edits is not None else 1 - distance(norm, other) / longest
            overlap = shared / len(own | theirs) if own and theirs else 0.0
            brief = (words + other.count(" ") + 1) / 2 <= 2
            weighted = 0.65 * edit + 0.35 * overlap if brief else 0.45 * edit + 0.55 * overlap
            score = edit if n <= 3 or m <= 3 else max(edit, weighted)
            best = max(best, (score, -p, section)) if best else (score, -p, section)
        long_ = len(v)
        if inside is None:
            if long_ >= 6 and v in norm and long_ / n >= 0.75:
                inside = section, 0.85
            elif n >= 6 and norm in v and n / long_ >= 0.75:
                inside = section, 0.80
    if best and best[0] >= threshold:
        return best[2], best[0]
    return inside or (None, best[0] if best else 0.0)


def _key(header: str) -> str:
    """``header_key`` of one header."""
    return header.lower().strip(" ").strip("[]").rstrip(":").strip(" ")


def _validated(header: str, ratio: bool) -> tuple[str, str | None]:
    """``validate_header`` of one header, by edit distance or by Ratcliff-Obershelp ratio."""
    key = _key(header)
    if key in _REJECTED:
        return "rejected", None
    named = _MAIN.get(key) or next((s for h, s in _WITHIN if h in key), None)
    if named is None:
        norm = normalized(header)
        named, _ = _canonical(norm, 0.88 if " " not in key else 0.78, _edits(norm) if ratio else None)
    if named is not None:
        return "main", named
    return ("subsection" if key in ks.SUBSECTION_NAMES else "rejected"), None


_known_validated = lru_cache(maxsize=100_000)(_validated)
KIND = ArrayType(StructType().add("kind", StringType()).add("section", StringType()))


def _each(headers: pa.Array, judge, names: list[str], types: list) -> pa.Array:
    """A struct of ``judge``'s answer for every header of an array of lists; one that repeats in a batch is judged once."""
    found = headers.flatten().dictionary_encode()
    judged = [judge(h) for h in found.dictionary.to_pylist()]
    each = pa.StructArray.from_arrays([pa.array([x[k] for x in judged], t) for k, t in enumerate(types)], names)
    sizes = headers.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
    offsets = np.concatenate([[0], np.cumsum(sizes)]).astype("int32")
    return pa.ListArray.from_arrays(pa.array(offsets), each.take(found.indices), mask=headers.is_null())


def _kinds(headers: pa.Array, ratio: bool) -> pa.Array:
    """``validate_header`` of every header; a short one of an earlier batch is not judged again."""
    judge = lambda h: _known_validated(h, ratio) if len(h) <= 200 else _validated(h, ratio)
    return _each(headers, judge, ["kind", "section"], [pa.string(), pa.string()])


def _named(header: str, threshold: float) -> tuple[str, str | None, float]:
    return _key(header), *_canonical(normalized(header), threshold, None)


_known_named = lru_cache(maxsize=100_000)(_named)


def _names(headers: pa.Array, threshold: float) -> pa.Array:
    judge = lambda h: _known_named(h, threshold) if len(h) <= 200 else _named(h, threshold)
    return _each(headers, judge, ["key", "section", "score"], [pa.string(), pa.string(), pa.float64()])


def names_of(headers: Column, threshold: float) -> Column:
    """``header_key`` and ``match_canonical`` of the normalized form of every header of an array, as structs.

    Scores below the threshold may be 0; a null header has null.
    """
    @F.arrow_udf(ArrayType(StructType().add("key", StringType()).add("section", StringType()).add("score", DoubleType())))
    def named(lists: pa.Array) -> pa.Array:
        return _names(lists, threshold)

    return named(headers)


@F.arrow_udf(KIND)
def kinds_by_levenshtein(headers: pa.Array) -> pa.Array:
    return _kinds(headers, False)


@F.arrow_udf(KIND)
def kinds_by_ratio(headers: pa.Array) -> pa.Array:
    return _kinds(headers, True)


# --- sections of a document --------------------------------------------------------
def with_headers(docs: DataFrame, method: str = "levenshtein", text: str = "text") -> DataFrame:
    """Add ``headers``: the candidates validated as main sections, in text order."""
    kinds = {"levenshtein": kinds_by_levenshtein, "ratio": kinds_by_ratio}
    if method not in kinds:
        raise ValueError(method)
    docs = with_candidates(docs, text).withColumn("_v", kinds[method](F.transform("candidates", lambda c: c["header"])))
    docs = docs.withColumn("_j", F.transform("candidates", lambda c, i: c.withField("v", F.get(F.col("_v"), i))))
    main = F.filter("_j", lambda c: c["v"]["kind"] == "main")
    return docs.withColumn("headers", F.transform(main, lambda c: F.struct(
        c["position"].alias("position"), c["header"].alias("header"), c["v"]["section"].alias("section"),
        c["inline_value"].alias("inline_value"),
    ))).drop("_j", "_v")


HEADER_LIKE = r"\A[A-Z][a-zA-Z /\-&]{1,50}:?\s*\z"


_HEADER_LIKE = re.compile(HEADER_LIKE.replace(r"\z", r"\Z"), re.ASCII).search
_EDGE = "".join(w for w in WHITE_CHARS if w != "\n")
_RULER, _GAPS = re.compile(r"[ \t\v\f\r.\-_]{0,3}").fullmatch, re.compile(r"\n{3,}")


def slices_of(text: str, headers: list[tuple]) -> list[tuple]:
    """(section, key, start, text) under each header (position, header, section, inline value) up to the next one."""
    out = []
    for i, (position, header, section, inline) in enumerate(headers):
        block = text[position:headers[i + 1][0] if i + 1 < len(headers) else len(text)]
        eol = block.find("\n")
        rest = block[eol:].strip(SPACE) if eol >= 0 else ""
        body = rest if inline is None else f"{inline}\n{rest}" if rest else inline
        stripped = body.strip(SPACE)
        empty = stripped == "" or (len(body) < 80 and _HEADER_LIKE(body))
        out.append((section, _key(header), position, "N/A" if empty else stripped))
    return out


def cleaned(body: str) -> str:
    """``clean_content`` of one text."""
    lines = (line.strip(_EDGE) for line in body.split("\n"))
    return _GAPS.sub("\n\n", "\n".join("" if _RULER(line) else line for line in lines)).strip(SPACE)


def merged_of(slices: list[tuple]) -> list[tuple]:
    """``merge_slices`` of (section, key, start, text): (section, text, start) in first-seen order."""
    out: dict[str, tuple[str, int]] = {}
    for section, _, start, raw in slices:
        text = cleaned(raw)
        if text != "N/A" and len(text) < 10:
            continue
        if section not in out:
            out[section] = text, start
        else:
            old, first = out[section]
            if old == "N/A":
                out[section] = text, first
            elif text != "N/A" and text not in old:
                out[section] = f"{old}\n\n{text}", first
    return [(section, text, start) for section, (text, start) in out.items()]


def main_headers(text: str, ratio: bool) -> list[tuple]:
    """(position, header, section, inline value) of the candidates that are main sections."""
    out = []
    for position, header, _, _, inline, _ in candidates(text):
        kind, section = _known_validated(header, ratio) if len(header) <= 200 else _validated(header, ratio)
        if kind == "main":
            out.append((position, header, section, inline))
    return out


def list_of(rows: list[list[tuple] | None], fields: list[tuple]) -> pa.Array:
    """A list of structs for each list of tuples; null for None."""
    sizes, flat = [len(r or ()) for r in rows], [x for r in rows for x in r or ()]
    columns = zip(*flat) if flat else ((),) * len(fields)
    struct = pa.StructArray.from_arrays([pa.array(c, t) for c, (_, t) in zip(columns, fields)], [n for n, _ in fields])
    offsets = np.concatenate([[0], np.cumsum(sizes)]).astype("int32")
    return pa.ListArray.from_arrays(pa.array(offsets), struct, mask=pa.array([r is None for r in rows], pa.bool_()))


SLICE = StructType().add("ord", IntegerType()).add("section", StringType()).add("key", StringType()).add("start", IntegerType()).add("text", StringType())
SECTION = StructType().add("section", StringType()).add("text", StringType()).add("start", IntegerType())
_SECTION = [("section", pa.string()), ("text", pa.string()), ("start", pa.int32())]


@F.arrow_udf(ArrayType(SLICE))
def _slices(texts: pa.Array, headers: pa.Array) -> pa.Array:
    cut = lambda t, hs: [(i, s, k, at, x) for i, (s, k, at, x) in enumerate(slices_of(t, [(h["position"], h["header"], h["section"], h["inline_value"]) for h in hs]))]
    rows = [None if t is None or hs is None else cut(t, hs) for t, hs in zip(texts.to_pylist(), headers.to_pylist())]
    return list_of(rows, [("ord", pa.int32()), ("section", pa.string()), ("key", pa.string()), ("start", pa.int32()), ("text", pa.string())])


def _sections(texts: pa.Array, ratio: bool) -> pa.Array:
    return list_of([None if t is None else merged_of(slices_of(t, main_headers(t, ratio))) for t in texts.to_pylist()], _SECTION)


@F.arrow_udf(ArrayType(SECTION))
def sections_by_levenshtein(texts: pa.Array) -> pa.Array:
    return _sections(texts, False)


@F.arrow_udf(ArrayType(SECTION))
def sections_by_ratio(texts: pa.Array) -> pa.Array:
    return _sections(texts, True)


def with_slices(docs: DataFrame, text: str = "text") -> DataFrame:
    """Add ``slices``: the text under each header up to the next one, or ``N/A``."""
    return docs.withColumn("slices", _slices(F.col(text), F.col("headers")))


def clean_content(body: Column) -> Column:
    """Stripped lines, ruler lines emptied, at most one empty line in a row."""
    lines = F.regexp_replace(tx.strip_lines(body), M + r"^[\s.\-_&&[^\n]]{0,3}$", "")
    return strip(F.regexp_replace(lines, r"\n{3,}", "\n\n"))


def merge_slices(slices: Column) -> Column:
    """One entry per section in first-seen order; real text beats ``N/A``, repeats append."""
    cleaned = F.filter(
        F.transform(slices, lambda s: F.struct(
            s["section"].alias("section"), clean_content(s["text"]).alias("text"), s["start"].alias("start"))),
        lambda s: (s["text"] == "N/A") | (F.length(s["text"]) >= 10),
    )
    none = F.array().cast("array<struct<section string, text string, start int>>")

    def add(acc: Column, s: Column) -> Column:
        joined = lambda old: (
            F.when(old["text"] == "N/A", s["text"])
            .when((s["text"] == "N/A") | F.contains(old["text"], s["text"]), old["text"])
            .otherwise(F.concat(old["text"], F.lit("\n\n"), s["text"]))
        )
        return F.when(
            F.exists(acc, lambda a: a["section"] == s["section"]),
            F.transform(acc, lambda a: F.when(
                a["section"] == s["section"],
                F.struct(a["section"].alias("section"), joined(a).alias("text"), a["start"].alias("start")),
            ).otherwise(a)),
        ).otherwise(F.concat(acc, F.array(s)))

    return F.aggregate(cleaned, none, add)


def with_sections(docs: DataFrame, method: str = "levenshtein", text: str = "text") -> DataFrame:
    """Add ``sections``: array of (section, text, start) in document order."""
    found = {"levenshtein": sections_by_levenshtein, "ratio": sections_by_ratio}
    if method not in found:
        raise ValueError(method)
    return docs.withColumn("sections", found[method](F.col(text)))


def short_section_filter(markers: DataFrame, least: int = 40) -> DataFrame:
    """Drop markers followed by fewer than ``least`` characters; allergies may be short.

    ``markers`` has ``doc_id, position, section, text_length``; a lone marker always stays.
    """
    w = Window.partitionBy("doc_id").orderBy("position")
    both = Window.partitionBy("doc_id")
    span = F.coalesce(F.lead("position").over(w), F.col("text_length")) - F.col("position")
    m = markers.withColumns({"span": span, "markers": F.count("*").over(both)})
    return m.where((F.col("markers") < 2) | (F.col("span") >= least) | (F.col("section") == "allergies")).drop("markers")
