"""Clean-up, sentence, abbreviation and name queries, and the page and code readers."""
from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as tx
from ..knowledge import abbreviations as ab
from ..knowledge.sections import ASSESSMENT_FAMILY, HEADER_STOP_WORDS, STEM_ENDINGS, STEM_SUFFIXES
from ..operators import sentences as se
from ..sources import tables as src
from .projection import notes, results, table
from .registry import query
from .sqltext import edges, has_any, lst, q, squeeze, strip, values


def documents(spark, sf):
    return table(spark, sf, "documents").select("doc_id", "text")


# --- clean-up ----------------------------------------------------------------------
DIGIT_SYMBOLS = r"""
    array_to_string(list_transform(string_split(t, ''), lambda c, i:
        case when contains('#$*=_<>|', c)
              and not regexp_matches(coalesce(string_split(t, '')[i - 1], ''), '[0-9]')
              and not regexp_matches(coalesce(string_split(t, '')[i + 1], ''), '[0-9]')
             then ' ' else c end), '')"""


def noise_sql(source: str) -> str:
    t = "text"
    for p in (r"(?i)Page [0-9]+(?: of [0-9]+)?", r"\b[0-9]+ of [0-9]+\b", "(?i)Confidential Property of.*",
              "(?i)Electronic Health Record.*", r"(?i)Printed on: [0-9]{1,2}/[0-9]{1,2}/[0-9]{2,4}.*",
              "(?i)DO NOT DUPLICATE", "(?i)All Rights Reserved",
              r"\b[0-9]{1,2}/[0-9]{1,2}/[0-9]{2,4}\s+[0-9]{1,2}:[0-9]{2}(?:\s*[APM]{2})?\b"):
        t = f"regexp_replace({t}, '{p}', '', 'g')"
    # a symbol touching a digit is protected by writing it twice over a marker
    return f"""
    select doc_id, array_to_string(list_transform(list_zip(cs, prev, next), lambda z:
        case when contains('#$*=_<>|', z[1]) and not regexp_matches(coalesce(z[2], ''), '[0-9]')
              and not regexp_matches(coalesce(z[3], ''), '[0-9]') then ' ' else z[1] end), '') as text
    from (select doc_id, cs, list_concat([''], cs[:-2]) as prev, list_concat(cs[2:], ['']) as next
          from (select doc_id, string_split({t}, '') as cs from {source}))"""


NORMAL = r"regexp_replace(array_to_string(list_transform(string_split(regexp_replace({x}, '[ \t]+', ' ', 'g'), chr(10)), lambda l: {strip_l}), chr(10)), '\n{{3,}}', chr(10) || chr(10), 'g')"


def normal_sql(x: str) -> str:
    return strip(NORMAL.format(x=x, strip_l=strip("l")))


def breaks_sql(x: str) -> str:
    """Pairwise join as a fold over the stripped lines: (text so far, line still open)."""
    word = r"[\p{L}\p{N}_]+"
    lines = f"list_transform(string_split(regexp_replace({x}, '({word})-\\n\\s*({word})', '\\1\\2', 'g'), chr(10)), lambda l: {strip('l')})"
    return lines


@query("remove_noise", noise_sql("(select doc_id, text from documents union all select -1 - doc_id, text from notes)"))
def remove_noise(spark, sf):
    both = documents(spark, sf).union(notes(spark, sf).select(-1 - F.col("doc_id"), "text"))
    return both.select("doc_id", tx.remove_noise(F.col("text")).alias("text"))


@query("normalize_whitespace", f"""
    select doc_id, {normal_sql('text')} as text
    from (select doc_id, text from documents union all select -1 - doc_id, text from notes)""")
def normalize_whitespace(spark, sf):
    both = documents(spark, sf).union(notes(spark, sf).select(-1 - F.col("doc_id"), "text"))
    return both.select("doc_id", tx.normalize_whitespace(F.col("text")).alias("text"))


BREAKS = f"""
    with recursive l as (
        select doc_id, {breaks_sql('text')} as ls from notes),
    step(doc_id, ls, i, out) as (
        select doc_id, ls, 1, '' from l
        union all
        select doc_id, ls,
               case when j then i + 2 else i + 1 end,
               out || case when i > 1 then chr(10) else '' end || case when j then ls[i] || ' ' || ls[i + 1] else ls[i] end
        from (select *, ls[i] <> '' and i < len(ls) and not regexp_matches(ls[i], '[.!?:]$')
                        and regexp_matches(ls[i + 1], '^[a-z]') as j
              from step where i <= len(ls)))
    select doc_id, out as text from step where i > len(ls)"""


@query("fix_line_breaks", BREAKS)
def fix_line_breaks(spark, sf):
    return notes(spark, sf).select("doc_id", tx.fix_line_breaks(F.col("text")).alias("text"))


@query("preprocess_text")
def preprocess_text(spark, sf):
    return documents(spark, sf).select("doc_id", tx.preprocess_text(F.col("text")).alias("text"))


@query("text_quality_score", r"""
    with c as (
      select doc_id, length(regexp_replace(text, '[a-zA-Z0-9\s,.()\[\]\-/]', '', 'g')) / length(text) as ratio,
             len(list_filter(['patient','diagnosis','clinical','history','assessment','treatment','medication'],
                             lambda k: contains(lower(text), k))) as found,
             case when doc_id % 2 = 0 then 1.0 else 0.8 end as base
      from (select doc_id, text from documents union all select -1 - doc_id, text from notes))
    select doc_id, cast(round_even(cast(greatest(0, least(1, base - case when ratio > 0.1 then 0.3 when ratio > 0.05 then 0.1 else 0 end
             + case when found >= 3 then 0.1 else 0 end)) as double), 4) as double) as score
    from c""")
def text_quality_score(spark, sf):
    both = documents(spark, sf).union(notes(spark, sf).select(-1 - F.col("doc_id"), "text"))
    method = F.when(F.col("doc_id") % 2 == 0, "digital").otherwise("ocr")
    return both.select("doc_id", F.bround(tx.quality_score(F.col("text"), method), 4).alias("score"))


# --- sentences ---------------------------------------------------------------------
@query("segment_sentences", r"""
    with p as (
      select doc_id, unnest(string_split(regexp_replace(text, '([.!?])(\s+)', '\1' || chr(1) || '\2' || chr(2), 'g'), chr(2))) as piece,
             generate_subscripts(string_split(regexp_replace(text, '([.!?])(\s+)', '\1' || chr(1) || '\2' || chr(2), 'g'), chr(2)), 1) as n
      from documents),
    o as (
      select doc_id, n, split_part(piece, chr(1), 1) as body,
             coalesce(sum(length(replace(piece, chr(1), ''))) over (partition by doc_id order by n rows between unbounded preceding and 1 preceding), 0) as start
      from p)
    select doc_id, cast(n as bigint) as sentence_number, trim(body, e' \n\t\r') as text,
           cast(start + length(body) - length(ltrim(body, e' \n\t\r')) as bigint) as start_char,
           cast(start + length(body) - length(ltrim(body, e' \n\t\r')) + length(trim(body, e' \n\t\r')) as bigint) as end_char
    from o where trim(body, e' \n\t\r') <> ''""")
def segment_sentences(spark, sf):
    return se.segment_sentences(documents(spark, sf), offsets=True)


# --- abbreviations -----------------------------------------------------------------
TOKENS = r"regexp_extract_all({t}, '(?i)ACE-I\b|N/V\b|F/U\b|\w+|\W+')"
READINGS = values([(a, "|".join(t), e) for a, t, e in ab.CONTEXT_READINGS], "readings(abbr, trigger, other)")
BASE = values(list(ab.BY_UPPER.items()), "abbrs(abbr, expansion)")


def token_offsets(view: str) -> str:
    return rf"""
    tk as (select doc_id, unnest(ts) as token, generate_subscripts(ts, 1) as n
           from (select doc_id, {TOKENS.format(t='text')} as ts from {view})),
    pos as (select *, coalesce(sum(length(token)) over (partition by doc_id order by n rows between unbounded preceding and 1 preceding), 0) as beg
            from tk)"""


@query("expand_abbreviations", rf"""
    with {READINGS}, {BASE}, {token_offsets('notes')},
    e as (
      select pos.doc_id, n, token,
             case when r.abbr is not null and regexp_matches(lower(
                    substr(text, greatest(cast(beg as bigint) - 99, 1), least(cast(beg as bigint), 100)) || ' ' || substr(text, cast(beg as bigint) + length(token) + 1, 100)), r.trigger)
                  then r.other else a.expansion end as reading
      from pos join notes using (doc_id)
      left join abbrs a on upper(token) = a.abbr left join readings r on upper(token) = r.abbr)
    select doc_id, string_agg(case when reading is null then token
             when left(token, 1) = upper(left(token, 1)) then reading || ' (' || token || ')'
             else lower(reading) || ' (' || token || ')' end, '' order by n) as text
    from e group by doc_id""")
def expand_abbreviations(spark, sf):
    return notes(spark, sf).select("doc_id", tx.expand_abbreviations(F.col("text")).alias("text"))


ALL_NAMES = values([(a, a.upper(), e, i) for i, (a, e) in enumerate(ab.ABBREVIATIONS)], "abbrs(name, abbr, expansion, ord)")


@query("detect_abbreviations", rf"""
    with {READINGS}, {ALL_NAMES}, u as (select doc_id, text from documents union all select -1 - doc_id, text from notes),
    tk as (select doc_id, unnest(ts) as token, generate_subscripts(ts, 1) as n
           from (select doc_id, regexp_extract_all(text, '(?i)ACE-I\b|N/V\b|F/U\b|[\p{{L}}\p{{N}}_]+|[^\p{{L}}\p{{N}}_]+') as ts from u)),
    pos as (select *, coalesce(sum(length(token)) over (partition by doc_id order by n rows between unbounded preceding and 1 preceding), 0) as at
            from tk),
    h as (select p.doc_id, p.token, cast(p.at as bigint) as beg, a.expansion, a.name, r.trigger, r.other
          from pos p join abbrs a on upper(token) = a.abbr left join readings r on r.abbr = a.name)
    select doc_id, token as abbreviation, beg as position, beg + length(token) as end_char,
           case when trigger is not null and regexp_matches(lower(
                    substr(text, greatest(beg - 99, 1), least(beg, 100)) || ' ' || substr(text, beg + length(token) + 1, 100)), trigger)
                then other else expansion end as expansion,
           '...' || replace(substr(text, greatest(beg - 19, 1), least(beg, 20)) || token || substr(text, beg + length(token) + 1, 20), chr(10), ' ') || '...' as context
    from h join u using (doc_id)""")
def detect_abbreviations(spark, sf):
    both = documents(spark, sf).union(notes(spark, sf).select(-1 - F.col("doc_id"), "text"))
    return se.detect_abbreviations(both)


# --- names -------------------------------------------------------------------------
NAMES = "select doc_id, ord, disease from results"


def named(spark, sf):
    return results(spark, sf).select("doc_id", "ord", "disease", "icd_code", "sources")


@query("clean_search_term", r"""
    with w as (select doc_id, unnest(string_split(regexp_replace(text, '\s+', ' ', 'g'), ' ')) as word from documents),
    c as (select doc_id, word, trim(lower(strip_accents(word))) as c from w)
    select doc_id, trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(c, '[''’‘]s\b', '', 'g'),
             '\s*\([a-z]{1,8}\)\s*$', ''), '^[,.\s]+|[,.\s]+$', '', 'g'), '\s+', ' ', 'g')) as term,
           count(*) as n
    from c group by 1, 2""")
def clean_search_term(spark, sf):
    # each document's words are counted in place before any row is shuffled
    words = documents(spark, sf).select("doc_id", F.explode(F.split(F.regexp_replace("text", r"\s+", " "), " ")).alias("w"))
    return words.groupBy("doc_id", tx.clean_search_term(F.col("w")).alias("term")).agg(F.count("*").alias("n"))


CLEAN = r"trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(trim(lower(strip_accents({x}))), '[''’‘]s\b', '', 'g'), '\s*\([a-z]{{1,8}}\)\s*$', ''), '^[,.\s]+|[,.\s]+$', '', 'g'), '\s+', ' ', 'g'))"


@query("search_words", f"""
    select doc_id, ord, array_to_string(list_filter(string_split({CLEAN.format(x='disease')}, ' '),
        lambda w: length(w) >= 3 and not list_contains({lst(tx.SEARCH_STOP_WORDS)}, w)), ' ') as words
    from results""")
def search_words(spark, sf):
    return named(spark, sf).select("doc_id", "ord", F.array_join(tx.search_words(F.col("disease")), " ").alias("words"))


@query("format_code", """
    select doc_id, ord, case when length(bare) > 3 and strpos(bare, '.') = 0 then left(bare, 3) || '.' || substr(bare, 4) else bare end as formatted,
           case when length(icd_code) > 3 and strpos(icd_code, '.') = 0 then left(icd_code, 3) || '.' || substr(icd_code, 4) else icd_code end as as_given
    from (select *, replace(upper(trim(icd_code)), '.', '') as bare from results)""")
def format_code(spark, sf):
    return named(spark, sf).select(
        "doc_id", "ord", tx.format_code(tx.bare_code(F.col("icd_code"))).alias("formatted"),
        tx.format_code(F.col("icd_code")).alias("as_given"),
    )


HEADER = squeeze(r"regexp_replace(regexp_replace(regexp_replace(trim(lower({x})), '[\[\]:*=_\-–—]+', ' ', 'g'), '\s*\([^)]*\)\s*$', ''), '^\s*\([^)]*\)\s*', '')")
LINES = "select doc_id, unnest(string_split(text, chr(10))) as line, generate_subscripts(string_split(text, chr(10)), 1) as n from notes"


def note_lines(spark, sf):
    return notes(spark, sf).select("doc_id", F.posexplode(F.split("text", "\n")).alias("n", "line"))


@query("normalize_header", f"""
    with ln as ({LINES}) select doc_id, cast(n as bigint) as n, {HEADER.format(x='line')} as header from ln""")
def normalize_header(spark, sf):
    return note_lines(spark, sf).select(
        "doc_id", (F.col("n") + 1).cast("bigint").alias("n"), tx.normalize_header(F.col("line")).alias("header")
    )


def stem_sql(w: str) -> str:
    cases = [f"when length({w}) > {len(s) + 2} and suffix({w}, '{s}') then left({w}, length({w}) - {len(s)})" for s in STEM_SUFFIXES]
    cases += [f"when length({w}) - {len(s)} >= {n} and suffix({w}, '{s}') then left({w}, length({w}) - {len(s)})" for s, n in STEM_ENDINGS]
    return f"case {' '.join(cases)} else {w} end"


def stems_sql(x: str) -> str:
    return (f"list_transform(list_filter(string_split({x}, ' '), lambda w: length(w) > 1 and not list_contains({lst(HEADER_STOP_WORDS)}, w)), "
            f"lambda w: {stem_sql('w')})")


@query("stem_tokens", f"""
    with ln as ({LINES}) select doc_id, cast(n as bigint) as n, array_to_string({stems_sql(HEADER.format(x='line'))}, ' ') as stems from ln""")
def stem_tokens(spark, sf):
    return note_lines(spark, sf).select(
        "doc_id", (F.col("n") + 1).cast("bigint").alias("n"), F.array_join(tx.stemmed_tokens(F.col("line")), " ").alias("stems")
    )


PREFIX = r"^\s*(?:[0-9]+[.)\s]|[a-zA-Z][.)]|[•\-*►▪▸])\s*"
PLAIN_PREFIX = r"^\s*(?:[0-9]+[.)\s]|[a-zA-Z][.)]|[•\-*])\s*"


def mention_sql(x: str) -> str:
    inner = edges(f"regexp_replace({x}, '{PREFIX}', '')", r".,;:\t\n ")
    inner = rf"regexp_replace({inner}, '(?i)\s*Active\s+[0-9]{{1,2}}/[0-9]{{1,2}}/[0-9]{{2,4}}.*$', '')"
    return squeeze(rf"regexp_replace({inner}, '(?i)\s*History\s+Type.*$', '')")


def stored_sql(x: str) -> str:
    return squeeze(edges(f"regexp_replace({x}, '{PLAIN_PREFIX}', '')", r".,;:\t\n "))


def dedup_key_sql(x: str) -> str:
    return squeeze(f"replace(lower({stored_sql(x)}), '/', ' ')")


@query("clean_mention_name", f"""
    with ln as ({LINES}) select doc_id, cast(n as bigint) as n, {mention_sql('line')} as name, {stored_sql('line')} as stored from ln""")
def clean_mention_name(spark, sf):
    return note_lines(spark, sf).select(
        "doc_id", (F.col("n") + 1).cast("bigint").alias("n"), tx.clean_mention_name(F.col("line")).alias("name"),
        tx.stored_name(F.col("line")).alias("stored"),
    )


@query("dedup_key", f"""
    with ln as ({LINES}) select doc_id, cast(n as bigint) as n, {dedup_key_sql('line')} as key from ln""")
def dedup_key(spark, sf):
    return note_lines(spark, sf).select(
        "doc_id", (F.col("n") + 1).cast("bigint").alias("n"), tx.dedup_key(F.col("line")).alias("key")
    )


PLAN_RE = tx.PLAN_ANNOTATION.replace("(?d)", "")
FRAGMENT_RE = tx.FRAGMENT.replace("(?d)", "").replace(r"\A", "^").replace(r"\z", "$")


def display_sql(x: str) -> str:
    cut = rf"regexp_replace(trim(regexp_replace({x}, '{PLAN_RE}', '', 'g')), '[.,;:= ]+$', '')"
    return f"case when length({cut}) >= 3 then {cut} else {x} end"


@query("clean_display_name", f"""
    with ln as ({LINES})
    select doc_id, cast(n as bigint) as n, {display_sql('line')} as name, regexp_matches({display_sql('line')}, '{FRAGMENT_RE}') as fragment from ln""")
def clean_display_name(spark, sf):
    name = tx.clean_display_name(F.col("line"))
    return note_lines(spark, sf).select(
        "doc_id", (F.col("n") + 1).cast("bigint").alias("n"), name.alias("name"), tx.is_fragment(name).alias("fragment")
    )


def title_sql(x: str) -> str:
    return f"array_to_string(list_transform(string_split(replace({x}, '_', ' '), ' '), lambda w: upper(left(w, 1)) || lower(substr(w, 2))), ' ')"


def label_sql(sources: str) -> str:
    """Label of a comma-separated source list."""
    cases = " ".join(f"when list_contains(string_split({sources}, ','), '{n}') then {title_sql(q(n))}" for n in ASSESSMENT_FAMILY)
    return f"case when {sources} = '' then 'Unknown' {cases} else array_to_string(list_transform(string_split({sources}, ','), lambda s: {title_sql('s')}), '/') end"


@query("section_label", f"select doc_id, ord, {label_sql('sources')} as label from results")
def section_label(spark, sf):
    return named(spark, sf).select("doc_id", "ord", tx.section_label(F.split("sources", ",")).alias("label"))


SLUG = r"regexp_replace(regexp_replace(trim(lower({x})), '[^a-z0-9]+', '_', 'g'), '^_+|_+$', '', 'g')"


@query("canonicalize_section", f"""
    with ln as ({LINES}), {values(tx.SECTION_SLUGS, 'slugs(slug, canonical)')}
    select doc_id, cast(n as bigint) as n, case when line = '' then 'unknown' else coalesce(canonical, {SLUG.format(x='line')}) end as section
    from ln left join slugs on slug = {SLUG.format(x='line')}""")
def canonicalize_section(spark, sf):
    return note_lines(spark, sf).select(
        "doc_id", (F.col("n") + 1).cast("bigint").alias("n"), tx.canonical_section(F.col("line")).alias("section")
    )


MAPS = (values(list(ab.LOWER_TO_EXPANSION.items()), "fwd(abbr, expansion)") + ", "
        + values(list(ab.EXPANSION_TO_LOWER.items()), "rev(expansion, abbr)"))
QUAL = r"^(?is)(.+?)\s*((?:stage|type|grade|class|step)?\s*[0-9][\w.]*)$"


def variants_cte(source: str) -> str:
    """``v(name, key)``: every key of every distinct name of ``source(name)``."""
    return rf"""{MAPS},
    nm as (select distinct name from {source}),
    parts as (select name, trim(lower(name)) as low,
                case when regexp_matches(trim(lower(name)), '{QUAL}') then trim(regexp_extract(trim(lower(name)), '{QUAL}', 1)) else trim(lower(name)) end as base,
                case when regexp_matches(trim(lower(name)), '{QUAL}') then trim(regexp_extract(trim(lower(name)), '{QUAL}', 2)) else '' end as ql from nm),
    alt as (select name, ql, f.expansion as other from parts join fwd f on f.abbr = base
            union all select name, ql, r.abbr from parts join rev r on r.expansion = base),
    v as (select name, low as key from parts
          union select name, other from alt
          union select name, other || ' ' || ql from alt where ql <> ''
          union select name, f.expansion from parts join fwd f on f.abbr = low
          union select name, r.abbr from parts join rev r on r.expansion = low)"""


@query("name_variants", f"""
    with {variants_cte('(select disease as name from results)')}
    select r.doc_id, r.ord, k.keys from results r join (select name, string_agg(key, '|' order by key) as keys from v group by name) k on k.name = r.disease""")
def name_variants(spark, sf):
    return named(spark, sf).select(
        "doc_id", "ord", F.array_join(F.array_sort(tx.name_variants(F.col("disease"))), "|").alias("keys")
    )


@query("non_disease_phrase", f"""
    with ln as ({LINES})
    select doc_id, cast(n as bigint) as n, trim(lower(line)) in (select unnest({lst(tx.WORKFLOW_PHRASES)}))
        or (n % 2 = 1 and len(string_split_regex(trim(lower(line)), '\\s+')) <= 4
            and len(list_filter({lst(tx.WORKFLOW_ENDINGS)}, lambda s: suffix(trim(lower(line)), s))) > 0) as phrase
    from ln""")
def non_disease_phrase(spark, sf):
    flag = tx.non_disease_phrase(F.col("line"), F.col("n") % 2 == 1)
    return note_lines(spark, sf).select("doc_id", (F.col("n") + 1).cast("bigint").alias("n"), flag.alias("phrase"))


# --- sources -----------------------------------------------------------------------
CODE_LINE = "case when p_partkey % 50 = 7 then '' when p_partkey % 50 = 9 then p_brand else concat(' ', {code}, '  ', p_name, ' ', lower(p_type)) end"
CODE_OF = "concat(substr('ABCDEFGHIJ', cast(p_size % 10 + 1 as int), 1), cast(p_partkey % 90 + 10 as string), case when p_partkey % 3 = 0 then '.' else '' end, cast(p_size as string))"
CODE_LINES = f"select p_partkey as seq, {CODE_LINE.format(code=CODE_OF)} as value from part"
CODE_LINES_SQL = CODE_LINES.replace("as string)", "as varchar)")


def part_lines(spark, sf):
    return table(spark, sf, "part").selectExpr("p_partkey as seq", f"{CODE_LINE.format(code=CODE_OF)} as value")


@query("code_dictionary_load", f"""
    with p as (select seq, regexp_extract(trim(value), '^(\\S+)\\s+(.*)$', 1) as code, regexp_extract(trim(value), '^(\\S+)\\s+(.*)$', 2) as description
               from ({CODE_LINES_SQL}))
    select a.code, a.description, 'Non-HCC' as hcc_status from p a
    where a.code <> '' and a.seq = (select max(b.seq) from p b where b.code = a.code)""")
def code_dictionary_load(spark, sf):
    return src.code_lines(part_lines(spark, sf)).drop("seq")


@query("code_dictionary_profile", f"""
    with p as (select trim(value) as line, split_part(trim(value), ' ', 1) as code from ({CODE_LINES_SQL}))
    select count(*) as total_lines, count(*) filter (line = '') as empty_lines,
           count(*) filter (strpos(line, ' ') > 0 and regexp_matches(code, '^[A-Z][0-9][A-Z0-9.]{{1,5}}$')) as valid,
           count(*) filter (line <> '' and strpos(line, ' ') = 0) as missing_description,
           count(*) filter (strpos(line, ' ') > 0 and not regexp_matches(code, '^[A-Z][0-9][A-Z0-9.]{{1,5}}$')) as invalid_code,
           count(*) filter (strpos(line, ' ') > 0 and regexp_matches(code, '^[A-Z][0-9][A-Z0-9.]{{1,5}}$') and strpos(code, '.') > 0) as with_dot,
           count(*) filter (strpos(line, ' ') > 0 and regexp_matches(code, '^[A-Z][0-9][A-Z0-9.]{{1,5}}$') and strpos(code, '.') = 0) as without_dot
    from p""")
def code_dictionary_profile(spark, sf):
    return src.code_profile(part_lines(spark, sf))


@query("code_table_by_header", f"""
    select p_name as code, max_by(p_type, p_partkey) as description, max_by(p_brand, p_partkey) as hcc_status
    from part where p_name <> 'None' group by p_name""")
def code_table_by_header(spark, sf):
    parts = table(spark, sf, "part").selectExpr(
        "p_partkey as id", "p_name as `Code (decimal form)`", "p_type as `Long Description`", "p_brand as `HCC status`"
    )
    return src.code_table(parts, seq=F.col("id")).drop("seq")


def turns(spark, sf):
    return table(spark, sf, "conversations").selectExpr("conv_id as doc_id", "turn + 1 as page_num", "text")


@query("page_assembly", """
    select conv_id as doc_id, string_agg(text, chr(10) || chr(10) order by turn) as text, count(*) as page_count
    from conversations group by conv_id""")
def page_assembly(spark, sf):
    return src.assemble_pages(turns(spark, sf))


@query("page_type_classify", """
    with p as (select conv_id as doc_id, length(trim(text, e' \\n\\t\\r')) as n from conversations where turn < 3),
    g as (select doc_id, count(*) as c, count(*) filter (n > 100) as d, sum(n) as s, avg(n) as m from p group by doc_id)
    select doc_id, case when d = c then 'digital' when d = 0 then 'scanned' else 'hybrid' end as type,
           cast(case when d = c then 0.95 when d = 0 then 0.9 else 0.7 end as double) as confidence, d <> c as needs_ocr,
           cast(s as bigint) as extractable_chars, round_even(m, 4) as avg_chars from g""")
def page_type_classify(spark, sf):
    return src.classify_pages(turns(spark, sf))


@query("document_catalog", """
    select o_orderkey as doc_id, o_orderstatus as status, (select count(*) from orders where o_custkey % 10 <> 0 and o_orderstatus = 'F') as total
    from orders where o_custkey % 10 <> 0 and o_orderstatus = 'F' order by o_orderkey limit 20 offset 40""")
def document_catalog(spark, sf):
    docs = table(spark, sf, "orders").selectExpr("o_orderkey as doc_id", "o_orderstatus as status", "o_custkey % 10 = 0 as deleted")
    return src.catalog_page(docs, status="F", skip=40, limit=20).drop("deleted")
