"""Section queries over the note projection."""
from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import similarity as sim
from ..functions import text as tx
from ..knowledge import sections as ks
from ..operators import sections as se
from .projection import notes
from .registry import query
from .sqltext import lst, q, strip, values
from .texts import HEADER, stems_sql

# --- header candidates -------------------------------------------------------------
RE2 = {k: p.replace("(?d)", "") for k, p in se.HEADER_PATTERNS.items()}
KINDS = list(RE2)


def hits_cte() -> str:
    """``h(doc_id, rank, kind, base, start, hit, raw)`` by running gap and match lengths."""
    parts = []
    for rank, kind in enumerate(KINDS):
        pat = q(RE2[kind])
        parts.append(f"""
        select doc_id, {rank} as rank, '{kind}' as kind, {se.BASE[kind.replace('_lower', '')]} as base, k,
               list_extract(string_split_regex(text, {pat}), k) as gap, hit, regexp_extract(hit, {pat}, 1) as raw,
               {f"trim(regexp_extract(hit, {pat}, 2))" if kind == 'colon_inline' else 'null'} as inline_value
        from (select doc_id, text, unnest(regexp_extract_all(text, {pat})) as hit,
                     generate_subscripts(regexp_extract_all(text, {pat}), 1) as k from notes)""")
    cleaned = strip("raw")
    for p in se.CLEANERS:
        pp = p.replace(r"\z", "$")
        cleaned = strip(f"regexp_replace({cleaned}, {q(pp)}, '')")
    cleaned = strip(f"regexp_replace({cleaned}, '[;:)]+$', '')")
    words = "len(string_split_regex(header, '\\s+'))"
    label = f"lower(header) in {tuple(ks.COLUMN_LABELS)}"
    return f"""
    raw as ({' union all '.join(parts)}),
    h as (select *, sum(length(gap)) over w + coalesce(sum(length(hit)) over (partition by doc_id, rank order by k rows between unbounded preceding and 1 preceding), 0) as position,
                 {cleaned} as header
          from raw window w as (partition by doc_id, rank order by k)),
    ok as (select * from h where header <> '' and case kind
             when 'bracketed' then not regexp_matches(header, '^[0-9/\\-.,: ]+$') and not ({label})
             when 'colon_block' then {words} <= 8 and not ({label})
             when 'ehr_timestamp' then {words} <= 6
             when 'allcaps' then length(header) >= 3 and not ({label})
             when 'colon_inline' then split_part(lower(header), ' ', 1) not in {tuple(ks.INLINE_REJECT_STARTS)} and not ({label})
             when 'numbered' then {words} >= 2
             when 'standalone' then length(header) >= 3 and not ({label})
             when 'standalone_lower' then length(header) >= 3 and {words} <= 5
             else true end),
    best as (select * from (select *, row_number() over (partition by doc_id, position order by base desc, rank) as rn from ok) where rn = 1),
    ctx as (select b.*, substr(text, cast(greatest(position - 29, 1) as bigint), cast(least(position, 30) as bigint)) as pre,
                   substr(text, cast(position as bigint) + length(hit) + 1, 80) as post, length(text) as text_length
            from best b join notes using (doc_id)),
    scored as (select *, {words} as nw, cast(greatest(0, least(1, round_even(cast(base
                 + case when contains(pre, chr(10) || chr(10)) or trim(pre, e' \\n\\t') = '' then 0.10 else 0 end
                 + case when regexp_matches(post, '^\\s*\\n\\s*\\S') then 0.05 else 0 end
                 + case when regexp_matches(post, '(?m)^\\s*(?:[-*•]|[0-9]+[.)]\\s|[a-zA-Z]\\))') then 0.10 else 0 end
                 + case when contains(lower(header), ' and ') or contains(header, '&') then 0.08 else 0 end
                 - case when length(header) < 4 then 0.20 else 0 end
                 - case when regexp_matches(header, '[0-9]') then 0.10 else 0 end
                 - case when split_part(lower(header), ' ', 1) in {tuple(ks.FRAGMENT_STARTS)} then 0.35 else 0 end
                 - case when {words} > 8 then 0.25 else 0 end as double), 3))) as double) as confidence
               from ctx)"""


@query("header_candidates", f"""
    with {hits_cte()}
    select doc_id, cast(position as bigint) as position, header, replace(kind, '_lower', '') as pattern_type,
           cast(base as double) as base_score, inline_value from best""")
def header_candidates(spark, sf):
    return se.header_candidates(notes(spark, sf)).select(
        "doc_id", F.col("position").cast("bigint"), "header", "pattern_type", "base_score", "inline_value"
    )


@query("header_score", f"with {hits_cte()} select doc_id, cast(position as bigint) as position, confidence from scored")
def header_score(spark, sf):
    return se.header_candidates(notes(spark, sf)).select("doc_id", F.col("position").cast("bigint"), "confidence")


@query("confidence_split", f"""
    with {hits_cte()}
    select doc_id, sum(case when confidence >= 0.75 then 1 else 0 end)::bigint as high, sum(case when confidence < 0.75 then 1 else 0 end)::bigint as low
    from scored group by doc_id""")
def confidence_split(spark, sf):
    c = se.header_candidates(notes(spark, sf))
    return c.groupBy("doc_id").agg(
        F.count_if(F.col("confidence") >= 0.75).alias("high"), F.count_if(F.col("confidence") < 0.75).alias("low")
    )


# --- canonical names ---------------------------------------------------------------
VARIANTS = values([(p, v, s) for p, v, s in ks.VARIANT_ROWS], "variants(p, v, s)")


def canonical_cte(source: str, header: str, threshold: str) -> str:
    """``canon(header, section, score)`` for the distinct headers of ``source``."""
    vn = HEADER.format(x="v")
    stems = lambda x: f"list_distinct({stems_sql(x)})"
    return f"""{VARIANTS},
    vv as (select p, v, s, {vn} as n, {stems(vn)} as t from variants),
    exact as (select v, max_by(s, p) as s from variants group by v),
    hd as (select distinct {header} as header from {source}),
    nh as (select header, {HEADER.format(x='header')} as norm, {threshold} as th from hd),
    st as (select *, {stems('norm')} as t, array_to_string(list_filter(string_split(norm, ' '), lambda w: length(w) > 1 and not list_contains({lst(ks.HEADER_STOP_WORDS)}, w)), ' ') as stripped from nh),
    pr as (select header, norm, th, p, v, s, n, 1 - levenshtein(norm, n) / greatest(length(norm), length(n)) as e,
                  case when len(st.t) = 0 or len(vv.t) = 0 then 0 else len(list_intersect(st.t, vv.t)) / len(list_distinct(list_concat(st.t, vv.t))) end as j
           from st, vv where norm <> ''),
    ps as (select *, case when length(norm) <= 3 or length(n) <= 3 then e
                          when (len(string_split(norm, ' ')) + len(string_split(n, ' '))) / 2 <= 2 then greatest(e, 0.65::double * e + 0.35::double * j)
                          else greatest(e, 0.45::double * e + 0.55::double * j) end as score,
                     case when length(v) >= 6 and contains(norm, v) and length(v) / length(norm) >= 0.75 then 0.85
                          when length(norm) >= 6 and contains(v, norm) and length(norm) / length(v) >= 0.75 then 0.80 end as cover from pr),
    fz as (select header, max(score) as best, arg_max(s, score - p * 1e-9) as s, min(p) filter (cover is not null) as cp from ps group by header),
    canon as (select st.header,
        case when st.norm = '' or st.norm in {tuple(ks.NOT_SECTION_LABELS)} or (length(st.norm) <= 3 and e1.s is null) then null
             when e1.s is not null then e1.s when e2.s is not null then e2.s when best >= st.th then fz.s else c.s end as section,
        cast(case when st.norm = '' or st.norm in {tuple(ks.NOT_SECTION_LABELS)} or (length(st.norm) <= 3 and e1.s is null) then 0
             when e1.s is not null then 1 when e2.s is not null then 0.98 when best >= st.th then best else coalesce(c.cover, best) end as double) as score
      from st left join exact e1 on e1.v = st.norm left join exact e2 on e2.v = stripped left join fz using (header)
      left join ps c on c.header = st.header and c.p = fz.cp)"""


def distinct_headers(spark, sf):
    return se.header_candidates(notes(spark, sf)).select("header").distinct()


@query("match_canonical", f"""
    with {hits_cte()}, {canonical_cte('best', 'header', '0.62')}
    select header, section, round_even(score, 6) as score from canon""")
def match_canonical(spark, sf):
    headers = distinct_headers(spark, sf)
    matched = se.match_canonical(tx.normalize_header(F.col("header")), F.lit(0.62))
    return headers.select("header", matched.alias("m")).select("header", "m.section", F.bround("m.score", 6).alias("score"))


def pair_terms(spark, sf):
    """Pairs of a note's candidate headers with its following candidate."""
    docs = se.with_candidates(notes(spark, sf))
    pairs = F.transform(F.slice("candidates", F.lit(2), F.greatest(F.size("candidates"), F.lit(0))), lambda c, i: F.struct(
        F.get(F.col("candidates"), i)["header"].alias("a"), c["header"].alias("b")))
    from ..functions.arrays import explode_rows

    return explode_rows(docs, pairs, "doc_id").groupBy("a", "b").agg(F.count("*").alias("n"))


PAIRS = f"""{hits_cte()},
    pairs as (select header as a, lead(header) over (partition by doc_id order by position) as b from best),
    pp as (select a, b, count(*) as n from pairs where b is not null group by a, b),
    pn as (select a, b, n, {HEADER.format(x='a')} as na, {HEADER.format(x='b')} as nb from pp)"""


@query("edit_similarity")
def edit_similarity(spark, sf):
    p = pair_terms(spark, sf)
    return p.select("a", "b", F.bround(sim.ratio(tx.normalize_header(F.col("a")), tx.normalize_header(F.col("b"))), 6).alias("score"))


@query("token_jaccard", f"""
    with {PAIRS}, s as (select a, b, n, list_distinct({stems_sql('na')}) as x, list_distinct({stems_sql('nb')}) as y from pn)
    select a, b, n, cast(round_even(case when len(x) = 0 or len(y) = 0 then 0 else len(list_intersect(x, y)) / len(list_distinct(list_concat(x, y))) end, 6) as double) as score from s""")
def token_jaccard(spark, sf):
    score = sim.jaccard(F.array_distinct(tx.stemmed_tokens(F.col("a"))), F.array_distinct(tx.stemmed_tokens(F.col("b"))))
    return pair_terms(spark, sf).select("a", "b", "n", F.bround(score, 6).alias("score"))


@query("combined_similarity", f"""
    with {PAIRS}, s as (select a, b, na, nb, n, list_distinct({stems_sql('na')}) as x, list_distinct({stems_sql('nb')}) as y from pn),
    t as (select *, 1 - levenshtein(na, nb) / greatest(length(na), length(nb)) as e,
                 case when len(x) = 0 or len(y) = 0 then 0 else len(list_intersect(x, y)) / len(list_distinct(list_concat(x, y))) end as j from s)
    select a, b, n, cast(round_even(case when length(na) <= 3 or length(nb) <= 3 then e
        when (len(string_split(na, ' ')) + len(string_split(nb, ' '))) / 2 <= 2 then greatest(e, 0.65::double * e + 0.35::double * j)
        else greatest(e, 0.45::double * e + 0.55::double * j) end, 6) as double) as score from t""")
def combined_similarity(spark, sf):
    a, b = tx.normalize_header(F.col("a")), tx.normalize_header(F.col("b"))
    tokens = sim.jaccard(F.array_distinct(tx.stemmed_tokens(F.col("a"))), F.array_distinct(tx.stemmed_tokens(F.col("b"))))
    score = sim.header_similarity(sim.levenshtein_similarity(a, b), tokens, a, b)
    return pair_terms(spark, sf).select("a", "b", "n", F.bround(score, 6).alias("score"))


# --- validation and slicing --------------------------------------------------------
KEY = "trim(regexp_replace(regexp_replace(trim(lower({x})), '^[\\[\\]]+|[\\[\\]]+$', '', 'g'), ':+$', ''))"
MAP = values([(i, h, s) for i, (h, s) in enumerate(ks.HEADER_MAP)], "hmap(p, h, s)")


def judged_cte(source: str, header: str) -> str:
    """``judged(header, key, kind, section)`` of the distinct headers of ``source``."""
    return f"""{canonical_cte(source, header, f"case when len(string_split({KEY.format(x='header')}, ' ')) <= 1 then 0.88 else 0.78 end")}, {MAP},
    kk as (select header, {KEY.format(x='header')} as key, canon.section as fuzzy from canon),
    inn as (select key, min(p) as p from (select distinct key from kk), hmap where length(h) >= 3 and contains(key, h) group by key),
    judged as (select kk.header, kk.key,
        case when kk.key in {tuple(ks.REJECTED_HEADERS + ks.NOISE_HEADERS)} then 'rejected'
             when coalesce(e.s, i.s, fuzzy) is not null then 'main'
             when kk.key in {tuple(ks.SUBSECTION_NAMES)} then 'subsection' else 'rejected' end as kind,
        case when kk.key in {tuple(ks.REJECTED_HEADERS + ks.NOISE_HEADERS)} then null else coalesce(e.s, i.s, fuzzy) end as section
      from kk left join hmap e on e.h = kk.key left join inn using (key) left join hmap i on i.p = inn.p)"""


@query("header_validate_rules", f"""
    with {hits_cte()}, {judged_cte('best', 'header')}
    select header, kind, section from judged""")
def header_validate_rules(spark, sf):
    headers = distinct_headers(spark, sf)
    return headers.select("header", se.validate_header(F.col("header")).alias("v")).select("header", "v.*")


HEADERS = f"""{hits_cte()}, {judged_cte('best', 'header')},
    hdr as (select doc_id, position, b.header, j.key, j.section, inline_value, text_length,
                   lead(position) over (partition by doc_id order by position) as nxt,
                   row_number() over (partition by doc_id order by position) - 1 as ord
            from ctx b join judged j on j.header = b.header and j.kind = 'main')"""


@query("short_section_filter", f"""
    with {HEADERS}
    select doc_id, cast(position as bigint) as position, section, cast(coalesce(nxt, text_length) - position as bigint) as span
    from hdr where coalesce(nxt, text_length) - position >= 40 or section = 'allergies'
      or (select count(*) from hdr h2 where h2.doc_id = hdr.doc_id) < 2""")
def short_section_filter(spark, sf):
    from ..functions.arrays import explode_rows

    docs = se.with_headers(notes(spark, sf)).withColumn("text_length", F.length("text"))
    rows = explode_rows(docs, F.col("headers"), "doc_id", "text_length")
    return se.short_section_filter(rows).select("doc_id", F.col("position").cast("bigint"), "section", F.col("span").cast("bigint"))


SLICES = f"""{HEADERS},
    blk as (select hdr.*, substr(text, cast(position as bigint) + 1, cast(coalesce(nxt, text_length) - position as bigint)) as block
            from hdr join notes using (doc_id)),
    rst as (select *, case when strpos(block, chr(10)) > 0 then {strip("substr(block, strpos(block, chr(10)))")} else '' end as rest from blk),
    bdy as (select *, case when inline_value is null then rest when rest = '' then inline_value else inline_value || chr(10) || rest end as body from rst),
    sl as (select doc_id, cast(ord as bigint) as ord, section, key,
                  case when {strip('body')} = '' or (length(body) < 80 and regexp_matches(body, '^[A-Z][a-zA-Z /\\-&]{{1,50}}:?\\s*$')) then 'N/A' else {strip('body')} end as text
           from bdy)"""


@query("slice_sections", f"with {SLICES} select * from sl")
def slice_sections(spark, sf):
    from ..functions.arrays import explode_rows

    docs = se.with_slices(se.with_headers(notes(spark, sf)))
    return explode_rows(docs, F.col("slices"), "doc_id").select("doc_id", F.col("ord").cast("bigint"), "section", "key", "text")


CONTENT = strip("regexp_replace(array_to_string(list_transform(string_split(text, chr(10)), lambda l: case when regexp_matches(trim(l), '^[\\s.\\-_]{0,3}$') then '' else trim(l) end), chr(10)), '\\n{3,}', chr(10) || chr(10), 'g')")
# every later text is appended unless the text so far contains it; N/A gives way
MERGED = f"""{SLICES},
    cc as (select * from (select doc_id, ord, section, {CONTENT} as text from sl) where text = 'N/A' or length(text) >= 10),
    nn as (select *, row_number() over (partition by doc_id, section order by ord) as n from cc),
    fold as (select doc_id, section, n, text, ord from nn where n = 1
             union all
             select f.doc_id, f.section, nn.n, case when f.text = 'N/A' then nn.text when nn.text = 'N/A' or contains(f.text, nn.text) then f.text
                    else f.text || chr(10) || chr(10) || nn.text end, f.ord
             from fold f join nn on nn.doc_id = f.doc_id and nn.section = f.section and nn.n = f.n + 1),
    merged as (select doc_id, section, max_by(text, n) as text, min(ord) as first_ord from fold group by doc_id, section)"""


@query("merge_duplicate_sections", f"with recursive {MERGED} select doc_id, section, text from merged")
def merge_duplicate_sections(spark, sf):
    return sections(spark, sf).select("doc_id", "section", "text")


def sections(spark, sf):
    from ..functions.arrays import explode_rows

    return explode_rows(se.with_sections(notes(spark, sf)), F.col("sections"), "doc_id")
