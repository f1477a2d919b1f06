"""Coverage of the assessment and verification of stated diseases, over notes and their result rows."""
from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import similarity as sim
from ..functions import text as tx
from ..knowledge import coverage as kc
from ..knowledge.sections import ASSESSMENT_KEYS
from ..operators import assessment as asm
from ..operators import context as cx
from ..operators import coverage as cv
from ..operators import sections as se
from .mapping import result_codes
from .projection import notes, results
from .registry import query
from .sections import MERGED
from .sqltext import lst, q, strip
from .texts import variants_cte

_FIRST = "lower(regexp_extract({x}, '\\S+', 0))"
ITEMS = f"""
    blk as (select doc_id, coalesce(string_split_regex(regexp_extract(text, {q(kc.BLOCK_START + '((?s:.*))')}, 1), {q(kc.BLOCK_END)})[1], '') as b from notes),
    rawi as (select doc_id, regexp_extract_all(b, {q(kc.LIST_ITEM)}, 1) as listed, regexp_extract_all(b, {q(kc.PLAIN_ITEM)}, 1) as plain from blk),
    chosen as (select doc_id, case when len(listed) > 0 then listed else list_filter(plain, lambda p: not list_contains({lst(kc.SENTENCE_STARTS)}, regexp_replace({_FIRST.format(x='p')}, '[,:;]+$', ''))
        and length(regexp_replace({_FIRST.format(x='p')}, '[,:;]+$', '')) >= 3) end as v from rawi),
    it as (select doc_id, unnest(range(len(v))) as pos, unnest(v) as raw from chosen),
    ic as (select doc_id, pos, raw, regexp_replace({strip('raw')}, ':+$', '') as disease from it),
    items as (select doc_id, pos, disease from ic where length(disease) between 5 and 120 and not list_contains({lst(kc.SKIP_STARTS)}, {_FIRST.format(x='disease')})
        and not (list_contains({lst(tx.WORKFLOW_PHRASES)}, lower(trim(disease))) or (len(string_split_regex(lower(trim(disease)), '\\s+')) <= 4
            and len(list_filter({lst(tx.WORKFLOW_ENDINGS)}, lambda s: suffix(lower(trim(disease)), s))) > 0))
        and not regexp_matches(disease, {q(kc.NOT_DISEASE)}) and not regexp_matches(raw, {q(kc.STABLE_ONLY)})
        and not (regexp_matches(disease, {q(kc.ORDER_ONLY)}) and not regexp_matches(disease, {q(kc.ACTION)}))
        and not (regexp_matches(disease, {q(kc.INCIDENTAL)}) and not regexp_matches(disease, {q(kc.ACTION)})))"""


@query("assessment_items", f"with {ITEMS} select doc_id, pos, disease from items")
def assessment_items(spark, sf):
    return cv.missable_items(notes(spark, sf)).select("doc_id", F.col("pos").cast("bigint"), "disease")


WORDS = f"list_distinct(list_filter(regexp_extract_all({{x}}, '[a-z]{{{{4,}}}}'), lambda w: not list_contains({lst(sim.SIGNIFICANT_STOP)}, w)))"
SAME = "contains(a, b) or contains(b, a) or len(list_filter(ka, lambda x: len(list_filter(kb, lambda y: contains(x, y) or contains(y, x))) > 0)) > 0 or (least(len(wa), len(wb)) > 0 and len(list_intersect(wa, wb)) / least(len(wa), len(wb)) >= 0.7)"
LEFT_OVER = f"""{ITEMS},
    hn as (select distinct doc_id, lower(trim(disease)) as name from results where trim(disease) <> ''),
    {variants_cte("(select lower(trim(disease)) as name from items union all select name from hn)")},
    pf as (select name, list(key) as keys, any_value({WORDS.format(x='name')}) as words from v group by name),
    left_over as (select * from items i where not exists (select 1 from (
        select i2.doc_id as d, i2.pos as p, pa.name as a, pb.name as b, pa.keys as ka, pb.keys as kb, pa.words as wa, pb.words as wb
        from items i2 join hn using (doc_id) join pf pa on pa.name = lower(trim(i2.disease)) join pf pb on pb.name = hn.name) m
        where m.d = i.doc_id and m.p = i.pos and ({SAME})))"""


@query("assessment_coverage", f"with {LEFT_OVER} select doc_id, pos, disease from left_over")
def assessment_coverage(spark, sf):
    """Items of the assessment that the document's result rows don't name."""
    names = results(spark, sf).select("doc_id", F.col("disease").alias("name"))
    return cv.without_same(cv.missable_items(notes(spark, sf)), names).select("doc_id", F.col("pos").cast("bigint"), "disease")


@query("assessment_coverage_codes")
def assessment_coverage_codes(spark, sf):
    """The same with codes; the fuzzy lookup has no form in SQL."""
    return cv.assessment_coverage(notes(spark, sf), results(spark, sf), result_codes(spark, sf))


KEYS_OF = variants_cte("(select name from names)")
# distinct names with their condition: any two of a document denote one condition or don't
PAIR_NAMES = "names as (select distinct lower(trim(disease)) as name from results where trim(disease) <> '')"


@query("same_condition", f"""
    with {PAIR_NAMES}, {KEYS_OF}, pf as (select name, list(key) as keys, any_value({WORDS.format(x='name')}) as words from v group by name),
    dn as (select distinct doc_id, lower(trim(disease)) as name from results where trim(disease) <> ''),
    pr as (select x.doc_id, pa.name as a, pb.name as b, pa.keys as ka, pb.keys as kb, pa.words as wa, pb.words as wb
        from dn x join dn y on x.doc_id = y.doc_id and x.name < y.name join pf pa on pa.name = x.name join pf pb on pb.name = y.name)
    select doc_id, a as name, count(*) as n_same from pr where {SAME} group by doc_id, a""")
def same_condition(spark, sf):
    """For each name of a document, how many later names denote the same condition."""
    names = results(spark, sf).select("doc_id", F.trim(F.lower("disease")).alias("name")).where("name <> ''").distinct()
    rows = names.select("doc_id", cv.profiled(F.col("name")).alias("p"))
    held = rows.groupBy("doc_id").agg(F.collect_list("p").alias("v"))
    same = lambda a, b: sim.same_condition(a["name"], b["name"], a["keys"], b["keys"], a["words"], b["words"])
    counted = F.transform("v", lambda a: F.struct(a["name"].alias("name"), F.size(F.filter("v", lambda b: (a["name"] < b["name"]) & same(a, b))).cast("bigint").alias("n_same")))
    return held.select("doc_id", F.explode(counted).alias("x")).select("doc_id", "x.*").where("n_same > 0")


SNIPPETS = "[evaluation_evidence, treatment_evidence || ' as was told at ' || cast(ord % 7 as varchar)]"


@query("mention_verify", f"""
    with names as (select distinct lower({strip('disease')}) as name from results), {KEYS_OF}, kl as (select name, list(key) as keys from v group by name),
    st as (select r.doc_id, r.ord, lower({strip('r.disease')}) as low, {SNIPPETS} as sn, lower(coalesce(n.text, '')) as body from results r left join notes n using (doc_id)),
    w as (select st.*, keys, list_distinct(regexp_extract_all(low, '[a-z]{{3,}}')) as ws, list_distinct(regexp_extract_all(body, '[a-z]{{3,}}')) as tw,
        list_filter(list_transform(sn, lambda s: lower({strip('s')})), lambda s: s <> '') as sq from st join kl on kl.name = low where low <> ''),
    g as (select *, list_filter(ws, lambda x: not list_contains({lst(kc.WEAK_WORDS)}, x)) as telling from w),
    f as (select doc_id, ord, case when contains(body, low) then 'name'
        when len(list_filter(keys, lambda k: contains(body, k))) > 0 then 'variant'
        when len(ws) > 0 and len(list_intersect(ws, tw)) / len(ws) >= 0.8 then 'words'
        when len(list_filter(sq, lambda s: contains(body, left(s, 50)))) > 0 then 'snippet'
        when len(list_filter(sq, lambda s: len(list_filter(range(1, length(left(s, 80)) - {cv.RUN - 2}), lambda i: contains(body, substr(left(s, 80), i, {cv.RUN})))) > 0)) > 0 then 'run'
        when len(telling) > 0 and len(list_intersect(telling, tw)) / len(telling) >= 0.7 then 'significant' end as found_by from g)
    select doc_id, ord, found_by, case when found_by is null then 'HALLUCINATED' end as reason from f""")
def mention_verify(spark, sf):
    quoted = F.array("evaluation_evidence", F.concat("treatment_evidence", F.lit(" as was told at "), (F.col("ord") % 7).cast("string")))
    rows = results(spark, sf).select("doc_id", "ord", "disease", quoted.alias("snippets"))
    return cv.mention_verify(rows, notes(spark, sf)).select("doc_id", "ord", "found_by", "reason")


_TITLE = lambda x: f"array_to_string(list_transform(regexp_extract_all({x}, '\\p{{L}}+|[^\\p{{L}}]+'), lambda r: upper(left(r, 1)) || lower(substr(r, 2))), '')"


@query("assessment_patch", f"""
    with recursive {MERGED},
    asx as (select doc_id, first_ord, text from merged where section in {tuple(ASSESSMENT_KEYS)} and trim(text) <> ''),
    bd as (select doc_id, ' ' || lower(string_agg(text, ' ' order by first_ord)) as body from asx group by doc_id),
    ni as (select doc_id, first_ord, unnest(regexp_extract_all(text, {q(asm.ITEM)}, 1)) as item, unnest(range(len(regexp_extract_all(text, {q(asm.ITEM)}, 1)))) as x from asx),
    pt as (select doc_id, first_ord, x, unnest(string_split(lower(trim(item)), ',')) as part, unnest(range(len(string_split(lower(trim(item)), ',')))) as y from ni),
    sp as (select doc_id, row_number() over (partition by doc_id order by first_ord, x, y) as o, list_transform(string_split(trim(part), '/'), lambda s: trim(s)) as s from pt),
    fr as (select distinct doc_id, unnest(s) as f from sp),
    up as (select doc_id, s[1] as short, arg_max({_TITLE("array_to_string(s, ' ')")}, o) as full_name, min(o) as o from sp where len(s) > 1 and length(s[1]) >= 3 group by doc_id, s[1]),
    rr as (select r.doc_id, r.ord, disease, sources, lower(trim(disease)) as low, body, body is not null and (contains(body, lower(trim(disease))) or exists (select 1 from fr where fr.doc_id = r.doc_id
        and length(f) >= 4 and (contains(f, lower(trim(disease))) or contains(lower(trim(disease)), f)))) as patched from results r left join bd using (doc_id)),
    nm as (select rr.doc_id, rr.ord, arg_min(full_name, o) as full_name from rr join up on up.doc_id = rr.doc_id and (contains(short, low) or contains(low, short)) and length(full_name) > length(trim(disease))
        where patched group by rr.doc_id, rr.ord)
    select doc_id, ord, coalesce(full_name, disease) as disease, patched, array_to_string(case when patched and not list_contains(list_transform(string_split(sources, ','), lambda s: lower(s)), 'assessment')
        then list_prepend('assessment', list_filter(string_split(sources, ','), lambda s: not list_contains({lst(ASSESSMENT_KEYS)}, lower(s)))) else string_split(sources, ',') end, ',') as sources
    from rr left join nm using (doc_id, ord)""")
def assessment_patch(spark, sf):
    rows = results(spark, sf).select("doc_id", "ord", "disease", F.split("sources", ",").alias("sources"))
    out = asm.assessment_patch(rows, se.with_sections(notes(spark, sf)))
    return out.select("doc_id", "ord", "disease", "patched", F.array_join("sources", ",").alias("sources"))


@query("fast_sections", rf"""
    with sn as (select doc_id, list_filter(list_transform(string_split(regexp_replace(text, '([.!?])\s+', '\1' || chr(1), 'g'), chr(1)), lambda s: {strip('s')}), lambda s: s <> '') as sents from notes),
    r as (select doc_id, ord, lower(disease) as low, split_part(sources, ',', 1) as section from results),
    u as (select r.doc_id, section, ord, low, unnest(sents) as s, unnest(range(len(sents))) as x from r join sn using (doc_id)),
    f as (select doc_id, section, string_agg(' ' || s, '' order by ord, x) as text from u where contains(lower(s), low) group by doc_id, section)
    select d.doc_id, d.section, coalesce(text, '') as text from (select distinct doc_id, section from r) d left join f on f.doc_id = d.doc_id and f.section = d.section""")
def fast_sections(spark, sf):
    docs = notes(spark, sf).withColumn("sents", F.transform(cx.sentence_array(F.col("text")), lambda s: s["text"]))
    rows = results(spark, sf).select("doc_id", "ord", "disease", F.split("sources", ",")[0].alias("section"))
    return cx.fast_sections(rows, docs)
