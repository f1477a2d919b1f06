"""Text clean-up and name functions, all ``Column -> Column`` over built-in expressions.

Java patterns carry ``(?U)`` where character classes must be Unicode-aware and ``(?d)``
where only ``\\n`` counts as a line end.
"""
from __future__ import annotations

import re
import sys
import unicodedata
from functools import lru_cache

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..knowledge import abbreviations as ab
from ..knowledge import words
from ..knowledge.sections import (
    ASSESSMENT_FAMILY, HEADER_STOP_WORDS, STEM_ENDINGS, STEM_SUFFIXES,
)
from .arrays import let

WORD = r"[\p{L}\p{N}_]"


def any_of(options) -> str:
    """Regex alternation of literal strings, in the given order."""
    return "|".join(re.escape(o).replace("/", "/") for o in options)


def contains_any(col: Column, options) -> Column:
    """True where the text holds one of the literal strings (a plain substring test)."""
    return col.rlike(any_of(options))


def squeeze(col: Column) -> Column:
    """Whitespace runs to one blank, ends trimmed."""
    return F.trim(F.regexp_replace(col, r"(?U)\s+", " "))


def strip_chars(col: Column, chars: str) -> Column:
    """Cut the given characters (a regex class body) from both ends."""
    return F.regexp_replace(col, rf"\A[{chars}]+|[{chars}]+\z", "")


def drop(col: Column, *patterns: str) -> Column:
    for p in patterns:
        col = F.regexp_replace(col, p, "")
    return col


# Patterns of page furniture removed from notes.
NOISE_PATTERNS = [
    r"(?i)Page [0-9]+(?: of [0-9]+)?",
    r"(?U)\b[0-9]+ of [0-9]+\b",
    r"(?i)(?d)Confidential Property of.*",
    r"(?i)(?d)Electronic Health Record.*",
    r"(?i)(?d)Printed on: [0-9]{1,2}/[0-9]{1,2}/[0-9]{2,4}.*",
    r"(?i)DO NOT DUPLICATE",
    r"(?i)All Rights Reserved",
    r"\b[0-9]{1,2}/[0-9]{1,2}/[0-9]{2,4}\s+[0-9]{1,2}:[0-9]{2}(?:\s*[APM]{2})?\b",
]
STRAY_SYMBOLS = r"(?<![0-9])[#$*=_<>|](?![0-9])"


def remove_noise(text: Column) -> Column:
    """Drop page numbers, boiler-plate and date-time stamps; stray symbols become blanks."""
    return F.regexp_replace(drop(text, *NOISE_PATTERNS), STRAY_SYMBOLS, " ")


def strip_lines(text: Column) -> Column:
    return F.regexp_replace(text, r"(?U)(?d)(?m)^[^\S\n]+|[^\S\n]+$", "")


def normalize_whitespace(text: Column) -> Column:
    """One blank between words, stripped lines, at most one empty line in a row."""
    lines = strip_lines(F.regexp_replace(text, r"[ \t]+", " "))
    return F.regexp_replace(F.regexp_replace(lines, r"\n{3,}", "\n\n"), r"(?U)\A\s+|\s+\z", "")


def fix_line_breaks(text: Column) -> Column:
    """Rejoin hyphenated words; join a line with the next one where a sentence runs on.

    A line that was just joined is not joined again: one match spans both lines.
    """
    joined = F.regexp_replace(text, rf"({WORD}+)-\n\s*({WORD}+)", "$1$2")
    return F.regexp_replace(
        strip_lines(joined), r"(?d)(?m)^(.*[^.!?:\n])\n([a-z].*)$", "$1 $2"
    )


def preprocess_text(text: Column) -> Column:
    return normalize_whitespace(fix_line_breaks(remove_noise(text)))


def quality_score(text: Column, method: Column) -> Column:
    """Quality of extracted text: 1.0 digital or 0.8 otherwise, less junk, plus keywords."""
    # Keywords and weights.
    keywords = words("patient, diagnosis, clinical, history, assessment, treatment, medication")
    special = F.length(F.regexp_replace(text, r"(?U)[a-zA-Z0-9\s,.()\[\]\-/]", ""))
    ratio = special / F.length(text)
    low = F.lower(text)
    found = sum((F.contains(low, F.lit(k)).cast("int") for k in keywords), F.lit(0))
    score = (
        F.when(method == "digital", F.lit(1.0)).otherwise(F.lit(0.8))
        - F.when(ratio > 0.1, F.lit(0.3)).when(ratio > 0.05, F.lit(0.1)).otherwise(F.lit(0.0))
        + F.when(found >= 3, F.lit(0.1)).otherwise(F.lit(0.0))
    )
    return F.when(F.length(text) > 0, F.greatest(F.lit(0.0), F.least(F.lit(1.0), score))).otherwise(F.lit(0.0))


# --- sentences ---------------------------------------------------------------------
MARK = "\u0001"


def sentence_pieces(text: Column) -> Column:
    """Pieces after ``.``, ``!`` or ``?`` followed by whitespace, as an array."""
    return F.split(text, r"(?U)(?<=[.!?])\s+", -1)


# --- abbreviations -----------------------------------------------------------------
ALTERNATE = "\ue000"


def _within(trigger: str, before: bool) -> str:
    gap = ab.CONTEXT_CHARS - len(trigger)
    return rf"(?<={trigger}.{{0,{gap}}})" if before else rf"(?=.{{0,{gap}}}{trigger})"


def _context_pattern() -> str:
    cases = []
    for name, triggers, _ in ab.CONTEXT_READINGS:
        before = "|".join(_within(t, True) for t in triggers)
        after = "|".join(_within(t, False) for t in triggers)
        cases.append(rf"\b(?=(?:{name})\b)(?:{before}|(?=(?:{name})(?:{after})))(?:{name})\b")
    return "(?i)(?U)(?s)" + "|".join(cases)


def _multi_tokens() -> list[str]:
    """Abbreviations that are not single words, longest first."""
    return sorted((a for a, _ in ab.ABBREVIATIONS if re.search(r"\W", a)), key=len, reverse=True)


@lru_cache(maxsize=1)
def _expansion_entries() -> list[tuple[str, str]]:
    entries = [(k, v) for k, v in ab.BY_UPPER.items()]
    entries += [(ALTERNATE + name, reading) for name, _, reading in ab.CONTEXT_READINGS]
    return entries


def literal_map(entries) -> Column:
    """A constant map; written as one string literal so generated code stays small."""
    body = "\u0002".join(f"{k}\u0003{v}" for k, v in entries)
    return F.str_to_map(F.lit(body), F.lit("\u0002"), F.lit("\u0003"))


def expand_abbreviations(text: Column) -> Column:
    """Write out known abbreviations as ``expansion (as written)``.

    One pass over the words, longest abbreviation first; the expansion is lower-cased where
    the word is. Four readings depend on words within 100 characters: those occurrences are
    marked first, on the unchanged text, and then looked up under the marked name.
    """
    marked = F.regexp_replace(text, _context_pattern(), ALTERNATE + "$0")
    multi = "|".join(rf"{re.escape(m)}\b" for m in _multi_tokens())
    tokens = F.regexp_extract_all(
        marked, F.lit(rf"(?i)(?U){multi}|{ALTERNATE}?\w+|(?:(?!{ALTERNATE})\W)+"), F.lit(0)
    )
    entries = _expansion_entries()
    table = literal_map(entries)
    known = [k for k, _ in entries]

    def rewrite(token: Column) -> Column:
        written = F.translate(token, ALTERNATE, "")
        reading = F.try_element_at(table, F.upper(token))
        first = F.substring(written, 1, 1)
        shown = F.when(first == F.upper(first), reading).otherwise(F.lower(reading))
        # the hash-set test keeps the map search to the few words that have an entry
        return F.when(
            F.upper(token).isin(known), F.concat(shown, F.lit(" ("), written, F.lit(")"))
        ).otherwise(token)

    return F.array_join(F.transform(tokens, rewrite), "")


def abbreviation_tokens(text: Column) -> Column:
    """Words, multi-part abbreviations and the stretches between them, in order."""
    multi = "|".join(rf"{re.escape(m)}\b" for m in _multi_tokens())
    return F.regexp_extract_all(text, F.lit(rf"(?i)(?U){multi}|\w+|\W+"), F.lit(0))


# --- search terms and codes --------------------------------------------------------
@lru_cache(maxsize=1)
def latin_folds() -> tuple[str, str]:
    """Accented Latin letters and their base letters, derived from canonical decompositions."""
    src, dst = [], []
    for cp in range(0xC0, min(0x2000, sys.maxunicode)):
        ch = chr(cp)
        base = "".join(c for c in unicodedata.normalize("NFKD", ch) if not unicodedata.combining(c))
        if base != ch and len(base) == 1 and base.isascii() and base.isalpha():
            src.append(ch)
            dst.append(base)
    return "".join(src), "".join(dst)


def strip_diacritics(col: Column) -> Column:
    src, dst = latin_folds()
    return F.translate(F.regexp_replace(col, r"\p{Mn}+", ""), src, dst)


def clean_search_term(name: Column) -> Column:
    """Lower-case search form: no diacritics, possessives, trailing "(abc)" or edge marks."""
    c = F.trim(F.lower(strip_diacritics(name)))
    c = drop(c, r"['’‘]s\b", r"\s*\([a-z]{1,8}\)\s*\z", r"\A[,.\s]+|[,.\s]+\z")
    return squeeze(c)


# Words ignored when searching the dictionary.
SEARCH_STOP_WORDS = words("""
the, and, for, with, without, not, from, due, type, stage, grade, unspecified, other,
bilateral, left, right, acute, chronic, primary, secondary
""")


def literal_array(options) -> Column:
    return F.array(*[F.lit(o) for o in options])


def search_words(name: Column) -> Column:
    """Words of three or more characters of the search form, less the stop words."""
    stop = literal_array(SEARCH_STOP_WORDS)
    return F.filter(
        F.split(clean_search_term(name), " "),
        lambda w: (F.length(w) >= 3) & ~F.array_contains(stop, w),
    )


def format_code(code: Column) -> Column:
    """Dot after the third character of a longer, undotted code."""
    return F.when(
        (F.length(code) > 3) & ~F.contains(code, F.lit(".")),
        F.concat(F.substring(code, 1, 3), F.lit("."), F.substr(code, F.lit(4))),
    ).otherwise(code)


def bare_code(code: Column) -> Column:
    return F.replace(F.upper(F.trim(code)), F.lit("."), F.lit(""))


# --- headers -----------------------------------------------------------------------
def normalize_header(header: Column) -> Column:
    h = F.regexp_replace(F.trim(F.lower(header)), r"[\[\]:*=_\-–—]+", " ")
    return squeeze(drop(h, r"\s*\([^)]*\)\s*\z", r"\A\s*\([^)]*\)\s*"))


def header_tokens(normalized: Column) -> Column:
    stop = literal_array(HEADER_STOP_WORDS)
    return F.filter(
        F.split(normalized, " "), lambda w: (F.length(w) > 1) & ~F.array_contains(stop, w)
    )


def stem(word: Column) -> Column:
    """Cut the first fitting suffix, else the first fitting plural or past ending."""
    n = F.length(word)
    out = None
    for s in STEM_SUFFIXES:
        test = word.endswith(s) & (n > len(s) + 2)
        value = F.substring(word, F.lit(1), n - len(s))
        out = F.when(test, value) if out is None else out.when(test, value)
    for s, least in STEM_ENDINGS:
        out = out.when(word.endswith(s) & (n - len(s) >= least), F.substring(word, F.lit(1), n - len(s)))
    return out.otherwise(word)


def stemmed_tokens(header: Column) -> Column:
    return F.transform(header_tokens(normalize_header(header)), stem)


# --- mention names -----------------------------------------------------------------
LIST_PREFIX = r"\A\s*(?:[0-9]+[.)\s]|[a-zA-Z][.)]|[•\-*►▪▸])\s*"
PLAIN_LIST_PREFIX = r"\A\s*(?:[0-9]+[.)\s]|[a-zA-Z][.)]|[•\-*])\s*"
NAME_EDGE = r".,;:\t\n "


def clean_mention_name(name: Column) -> Column:
    """Mention text without list prefix, edge punctuation and trailing metadata."""
    c = strip_chars(drop(name, LIST_PREFIX), NAME_EDGE)
    c = drop(c, r"(?i)(?d)\s*Active\s+[0-9]{1,2}/[0-9]{1,2}/[0-9]{2,4}.*$", r"(?i)(?d)\s*History\s+Type.*$")
    return squeeze(c)


def stored_name(name: Column) -> Column:
    """Name kept for storage: list prefix and edge punctuation gone, case kept."""
    return squeeze(strip_chars(drop(name, PLAIN_LIST_PREFIX), NAME_EDGE))


def dedup_key(name: Column) -> Column:
    return squeeze(F.replace(F.lower(stored_name(name)), F.lit("/"), F.lit(" ")))


# Plan annotations cut from names, and names that are only a fragment.
PLAN_ANNOTATION = (
    r"(?i)(?d)(?:\s+(?:stable|controlled|uncontrolled|well controlled)\b(?:\s*[,=].*)?$"
    r"|\s*[=,]\s*(?:stable|controlled|uncontrolled|well controlled|counsel|monitor|consider|"
    r"continue|increase|decrease|refer|serial|start|check|order|worsening|improving|"
    r"due to dm|on meds|diet and exercise|fiber/fluids)\b.*$)"
)
FRAGMENT = (
    r"(?i)(?d)\A(?:due to \w+|stable.*|on meds|single episode.*|psy support|"
    r"serial \w+|consider \w+|increase \w+|monitor \w+)\z"
)


def clean_display_name(name: Column) -> Column:
    cleaned = F.regexp_replace(F.trim(drop(name, PLAN_ANNOTATION)), r"[.,;:= ]+\z", "")
    return F.when(F.length(cleaned) >= 3, cleaned).otherwise(name)


def is_fragment(name: Column) -> Column:
    return name.rlike(FRAGMENT)


def title_label(section: Column) -> Column:
    return F.initcap(F.replace(section, F.lit("_"), F.lit(" ")))


def section_label(sources: Column) -> Column:
    """Label of a source list: the leading assessment-family section, else all in order."""
    low = F.transform(sources, F.lower)
    label = F.when(F.size(sources) == 0, F.lit("Unknown"))
    for name in ASSESSMENT_FAMILY:
        label = label.when(F.array_contains(low, name), F.lit(name.replace("_", " ").title()))
    return label.otherwise(F.array_join(F.transform(sources, title_label), "/"))


# Section slug = canonical section.
SECTION_SLUGS = [
    ("assessment_plan", "assessment_and_plan"), ("a_p", "assessment_and_plan"),
    ("pmh", "past_medical_history"), ("medical_history", "past_medical_history"),
    ("history_of_present_illness", "history_present_illness"), ("hpi", "history_present_illness"),
    ("cc", "chief_complaint"), ("current_medications", "medications"),
    ("active_medications", "medications"), ("ros", "review_of_systems"),
    ("physical_examination", "physical_exam"), ("pe", "physical_exam"), ("vital_signs", "vitals"),
]


def canonical_section(name: Column) -> Column:
    slug = strip_chars(F.regexp_replace(F.trim(F.lower(name)), r"[^a-z0-9]+", "_"), "_")
    known = F.try_element_at(literal_map(SECTION_SLUGS), slug)
    return F.when(F.coalesce(F.length(name), F.lit(0)) == 0, F.lit("unknown")).otherwise(F.coalesce(known, slug))


# --- variants ----------------------------------------------------------------------
QUALIFIER = r"(?i)(?s)\A(.+?)\s*((?:stage|type|grade|class|step)?\s*[0-9][\w.]*)\z"


def _lookup(table: dict, keys: Column) -> Column:
    # a map is searched entry by entry, a set of constants by hash: most names are not in the table
    return F.when(keys.isin(list(table)), F.try_element_at(literal_map(table.items()), keys))


def name_variants(name: Column) -> Column:
    """Keys under which a name may match: itself and its abbreviation or expansion.

    A trailing qualifier such as ``3`` or ``stage 3`` is split off for the lookup and the key
    is added with and without it.
    """
    def split_off(low: Column) -> Column:
        has = low.rlike("[0-9]") & low.rlike(QUALIFIER)
        return let(has, lambda h: F.struct(
            low.alias("low"), F.when(h, F.trim(F.regexp_extract(low, QUALIFIER, 1))).otherwise(low).alias("base"),
            F.when(h, F.trim(F.regexp_extract(low, QUALIFIER, 2))).otherwise(F.lit("")).alias("qualifier")))

    def keys_of(x: Column) -> Column:
        low, base, qualifier = x["low"], x["base"], x["qualifier"]
        keys = [low]
        for table in (ab.LOWER_TO_EXPANSION, ab.EXPANSION_TO_LOWER):
            # without a qualifier the base is the whole name
            qualified = F.when(qualifier != "", F.concat(_lookup(table, base), F.lit(" "), qualifier))
            keys += [qualified, F.when(qualifier != "", _lookup(table, base)), _lookup(table, low)]
        return F.array_distinct(F.array_compact(F.array(*keys)))

    return let(let(F.trim(F.lower(name)), split_off), keys_of)


def simple_variants(name: Column) -> Column:
    """The lower-case name with its direct abbreviation or expansion."""
    low = F.trim(F.lower(name))
    return F.array_distinct(F.array_compact(F.array(
        low, _lookup(ab.LOWER_TO_EXPANSION, low), _lookup(ab.EXPANSION_TO_LOWER, low)
    )))


# Workflow phrases that are not diagnoses, and their endings.
WORKFLOW_PHRASES = words("""
chronic disease management, disease management, medication management, care coordination,
health maintenance, preventive care, wellness visit, follow-up visit,
medication reconciliation, care plan, patient education, counseling, screening,
routine exam, annual physical, office visit, established patient, new patient,
telephone encounter, telehealth visit, referral, consultation, discharge planning,
case management, pain management, weight management, stress management,
chronic care management, transitional care management
""")
WORKFLOW_ENDINGS = words("""
management, visit, coordination, planning, education, counseling, screening, reconciliation
""")


def non_disease_phrase(name: Column, has_code: Column) -> Column:
    low = F.trim(F.lower(name))
    ending = low.rlike("(?:" + any_of(WORKFLOW_ENDINGS) + r")\z")
    return low.isin(WORKFLOW_PHRASES) | (~has_code & (F.size(F.split(low, r"\s+")) <= 4) & ending)
