"""Context, evidence and gate queries."""
from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.arrays import explode_rows, let
from ..functions.skew import with_texts
from ..knowledge import clinical as kn
from ..operators import context as cx
from ..operators import evidence as me
from .coding import E4, G, graded
from .projection import K, NOTE_TEXT, TERMS, duck, notes, pick, results
from .registry import query
from .sqltext import has_any, lst, q, squeeze, strip, values

NAME = pick(TERMS, "doc_id")


def base(spark, sf):
    """Notes with one mention each."""
    return notes(spark, sf).withColumn("disease", F.expr(NAME))


S = r"""d as (select doc_id, text, {name} as disease, list_filter(list_transform(string_split(regexp_replace(text, '([.!?])\s+', '\1' || chr(1), 'g'), chr(1)), lambda s: {st}), lambda s: s <> '') as sents from notes)""".format(name=duck(NAME), st=strip("s"))


def special(table) -> str:
    return "case " + " ".join(f"when contains(lower(disease), {q(d)}) then {lst(k)}" for d, k in table) + " else []::varchar[] end"


def kw_sql(table, general) -> str:
    return f"list_filter(sents, lambda s, i: list_position(sents, s) = i and (len(list_filter(list_concat({special(table)}, {lst(general)}), lambda k: contains(lower(s), k))) > 0))"


HITS = """list_transform(lns, lambda l: contains(lower(l), lower(disease)) or (len(keys) > 0 and len(list_filter(keys, lambda w: contains(lower(l), w))) >= least(2, len(keys))))"""
CTX = f"""{S},
    l as (select *, list_filter(string_split(text, chr(10)), lambda x: trim(x) <> '') as lns, list_filter(string_split(lower(disease), ' '), lambda w: length(w) >= 4) as keys,
              coalesce(list_position(list_transform(sents, lambda s: contains(lower(s), lower(disease))), true), 0) as loc from d),
    h as (select *, {HITS} as hits from l),
    c as (select doc_id, text, disease, sents, loc, case when loc > 0 then sents[loc] else '' end as prim,
             case when loc = 0 then [] else sents[greatest(loc - 5, 1):loc + 5] end as around,
             array_to_string(case when not list_contains(hits, true) then lns[1:8] else list_filter(lns, lambda x, i: list_contains(hits[greatest(i - 2, 1):i + 1], true)) end, chr(10)) as section,
             {kw_sql(kn.CONTEXT_DRUGS, kn.GENERAL_DRUG_WORDS)} as drugs, {kw_sql(kn.CONTEXT_LABS, kn.GENERAL_LAB_WORDS)} as labs from h),
    ctx as (select *, list_filter(sents, lambda s: contains(lower(s), lower(disease)) and s <> prim) as related from c)"""


J = lambda c, f: F.array_join(c[f], "|").alias(f)


def ctx_query(name, parts, spark_cols, sql_cols):
    @query(name, f"with {CTX} select doc_id, {sql_cols} from ctx")
    def run(spark, sf):
        return cx.contexts(base(spark, sf), parts, lambda c: F.struct(*spark_cols(c)), "doc_id")


ctx_query("context_window", ("primary", "around"), lambda c: [c["primary"].alias("prim"), J(c, "around")], "prim, array_to_string(around, '|') as around")
ctx_query("section_context", ("section",), lambda c: [c["section"].alias("section")], "section")
ctx_query("related_mentions", ("related",), lambda c: [J(c, "related")], "array_to_string(related, '|') as related")
ctx_query("medication_mentions", ("drugs",), lambda c: [J(c, "drugs")], "array_to_string(drugs, '|') as drugs")
ctx_query("lab_mentions", ("labs",), lambda c: [J(c, "labs")], "array_to_string(labs, '|') as labs")
ctx_query("context_size", ("primary", "around", "section", "related"), lambda c: [cx.size(c).cast("bigint").alias("chars")],
          "length(prim) + length(array_to_string(around, ' ')) + length(section) + length(array_to_string(related, ' ')) as chars")
ctx_query("context_summary", ("primary", "around", "section", "drugs", "labs"), lambda c: [cx.summary(c).alias("summary")], """concat_ws(chr(10) || chr(10),
    case when prim <> '' then 'Primary mention: ' || prim end, case when len(around) > 0 then 'Surrounding context:' || chr(10) || array_to_string(around, chr(10)) end,
    case when section <> '' then 'Section context:' || chr(10) || left(section, 1500) end,
    case when len(drugs) > 0 then 'Medications:' || chr(10) || array_to_string(drugs[1:5], chr(10)) end,
    case when len(labs) > 0 then 'Lab results:' || chr(10) || array_to_string(labs[1:5], chr(10)) end) as summary""")


@query("link_sentence", f"with {CTX} select doc_id, disease, cast(loc as bigint) as sentence from ctx")
def link_sentence(spark, sf):
    docs = cx.with_sentences(base(spark, sf), ())
    return docs.select("doc_id", "disease", cx.primary_index(F.col("sents"), F.col("disease")).cast("bigint").alias("sentence"))


LINES = f"""{CTX},
    ln as (select doc_id, disease, list_filter(flatten(list_transform(list_concat([prim], around, [section], related, drugs, labs), lambda t: list_transform(string_split(t, chr(10)), lambda x: {strip('x')}))), lambda x: length(x) >= 8) as ls from ctx),
    el as (select doc_id, disease, list_filter(ls, lambda x, i: list_position(list_transform(ls, lambda y: lower(y)), lower(x)) = i) as ls from ln)"""


@query("evidence_lines", f"with {LINES} select doc_id, array_to_string(ls, '|') as lines from el")
def evidence_lines(spark, sf):
    return cx.contexts(base(spark, sf), cx.PARTS, lambda c: F.struct(F.array_join(me.evidence_lines(c), "|").alias("lines")), "doc_id")


def detected(spark, sf, elements):
    """Notes with the best line of their context for each element."""
    lined = lambda c: let(me.evidence_lines(c), lambda a: F.struct(a.alias("lines"), F.transform(a, lambda s: F.lower(s)).alias("low")))
    return me.detected(cx.contexts(base(spark, sf), cx.PARTS, lined, "doc_id", "disease"), elements)


KW = values([(e, w) for e, ws in me.WORDS.items() for w in ws], "kw(element, word)")
RATED = f"""{LINES}, u as (select doc_id, disease, unnest(ls) as line, generate_subscripts(ls, 1) as i from el),
    r as (select *, contains(lower(line), lower(disease)) as named from u),
    s as (select r.*, element, (case when named then case when element = 'assessment' then 0.75 else 0.70 end else 0.55 end)::double as conf
          from r, (select unnest(['monitoring', 'evaluation', 'assessment', 'treatment']) as element) x where {" or ".join(f"(element = '{e}' and {has_any('lower(line)', ws)})" for e, ws in me.WORDS.items())}),
    b as (select doc_id, element, arg_max(line, conf + (case when length(line) < 120 then 0.05 else 0 end)::double + (case when named then 0.10 else 0 end)::double - i * 1e-7) as line,
                 arg_max(conf, conf + (case when length(line) < 120 then 0.05 else 0 end)::double + (case when named then 0.10 else 0 end)::double - i * 1e-7) as conf from s group by 1, 2)"""


@query("meat_detect", f"with {RATED} select doc_id, element, trim(left(line, 150)) as evidence, conf as confidence from b where element <> 'assessment'")
def meat_detect(spark, sf):
    wanted = [e for e in E4 if e != "assessment"]
    parts = F.array(*[F.struct(F.lit(e).alias("element"), F.col(e).alias("d")) for e in wanted])
    return explode_rows(detected(spark, sf, wanted), parts, "doc_id").select("doc_id", "element", "d.*").where("evidence is not null")


DETECTED = f"""{RATED}, sh as (select doc_id, arg_min(line, least(length(line), 150) + i * 1e-6) as line from r where named group by doc_id),
    da as (select el.doc_id, case when coalesce(b.conf, 0) > (case when sh.line is null then 0 else 0.65 end) then trim(left(b.line, 150)) else trim(left(sh.line, 150)) end as evidence,
                  case when coalesce(b.conf, 0) > (case when sh.line is null then 0 else 0.65 end) then b.conf when sh.line is null then 0 else 0.65 end as confidence
           from el left join b on b.doc_id = el.doc_id and b.element = 'assessment' left join sh on sh.doc_id = el.doc_id)"""


@query("assessment_detect", f"with {DETECTED} select doc_id, evidence, cast(confidence as double) as confidence from da")
def assessment_detect(spark, sf):
    return detected(spark, sf, ["assessment"]).select("doc_id", "assessment.*")


@query("overall_confidence", f"""
    with {DETECTED}, al as (select doc_id, confidence::double as conf from da where confidence > 0 union all select doc_id, conf from b where element <> 'assessment')
    select el.doc_id, cast(coalesce((select round_even(avg(conf), 2) from al where al.doc_id = el.doc_id), 0) as double) as overall from el""")
def overall_confidence(spark, sf):
    return detected(spark, sf, E4).select("doc_id", me.overall_confidence([F.col(f"{e}.confidence") for e in E4]).alias("overall"))


# --- gate --------------------------------------------------------------------------
def claimed(spark, sf):
    g = graded(spark, sf)
    ctx = F.concat_ws(" ", "disease", "monitoring_evidence", "assessment_evidence", F.lit("Recheck labs in   3 months, continue LISINOPRIL daily"))
    return g.withColumns({
        "context": ctx, "overall_confidence": F.col("icd_confidence"),
        **{f"{e}_confidence": F.when(F.col(e), F.lit(0.7)).otherwise(F.lit(0.0)) for e in E4},
    })


def gated(spark, sf, near=None):
    """Without window scores, which SQL can't express; ``meat_gate_windows`` has them."""
    return me.gate(claimed(spark, sf), near=near)


@query("meat_gate_windows")
def meat_gate_windows(spark, sf):
    out = gated(spark, sf, near=me.NEAR)
    return out.select("doc_id", "ord", *E4, "rule", "meat_valid", "tier", "review", F.size("issues").cast("bigint").alias("n_issues"))


SRC_ANY = lambda names: f"len(list_intersect(src, {lst(names)})) > 0"
EV = {e: f"trim({e}_evidence)" for e in E4}
SQUASH = lambda x: squeeze(f"lower({x})")


def state(e: str) -> str:
    ev = SQUASH(EV[e])
    overlap = f"len(list_intersect(list_distinct(string_split({ev}, ' ')), string_split(ctx, ' '))) / len(list_distinct(string_split({ev}, ' '))) >= 0.7"
    return f"case when {EV[e]} = '' then 'absent' when length({EV[e]}) < 5 then 'short' when contains(ctx, {ev}) or {overlap} then 'found' else 'missing' end as s_{e[0]}"


B = {e[0]: f"case when s_{e[0]} = 'missing' then length({EV[e]}) <= 15 else s_{e[0]} = 'found' end" for e in E4}
NEG = {e[0]: has_any(f"lower({EV[e]})", kn.NEGATION_MARKERS) for e in E4}
GATE = f"""{G},
    g0 as (select *, {SQUASH("concat_ws(' ', disease, monitoring_evidence, assessment_evidence, 'Recheck labs in   3 months, continue LISINOPRIL daily')")} as ctx,
        monitoring_evidence <> '' as m0, evaluation_evidence <> '' as e0, assessment_evidence <> '' as a0, treatment_evidence <> '' as t0 from g),
    g1 as (select *, {', '.join(state(e) for e in E4)},
        case when a0 and (m0 or e0 or t0) then {q(me.PASS_A)} when t0 and (m0 or e0) then {q(me.PASS_T)} when n >= 2 then {q(me.PASS_N)} else {q(me.FAIL)} end as rule0,
        case when confidence >= 0.85 then 'high' when confidence >= 0.65 then 'medium' else 'low' end as tier,
        not ({SRC_ANY(kn.TEMPORAL_ACTIVE_SECTIONS)}) and {has_any("lower(assessment_evidence)", kn.TEMPORAL_MARKERS)} as past,
        {SRC_ANY(kn.HISTORY_SECTIONS)} and not ({SRC_ANY(kn.GATE_ACTIVE_SECTIONS)}) as hist from g0),
    g2 as (select *, {B['m']} as m1, {B['e']} as e1, {B['a']} as a1, {B['t']} as t1 from g1),
    g3 as (select *, (m1::int + e1::int + t1::int) >= 2 as managed, a1 and not past and not hist as a2 from g2),
    g4 as (select *, m1 and not {NEG['m']} as m, e1 and not {NEG['e']} as e, a2 and not {NEG['a']} as a, t1 and not {NEG['t']} as t,
        case when hist then managed else rule0 <> {q(me.FAIL)} and not past end as v1, case when hist and managed then {q(me.PASS_H)} else rule0 end as rule1 from g3),
    g5 as (select *, (a and (m or e or t)) or (t and (m or e)) or (m::int + e::int + a::int + t::int) >= 2 as holds from g4),
    g6 as (select *, v1 and holds as v2, case when not holds and suffix(rule1, '[PASS]') then {q(me.REVERSED)} else rule1 end as rule,
        (m and length({EV['monitoring']}) < 8) or (e and length({EV['evaluation']}) < 8) or (a and length({EV['assessment']}) < 8) or (t and length({EV['treatment']}) < 8) as some_short,
        (m and length({EV['monitoring']}) >= 8) or (e and length({EV['evaluation']}) >= 8) or (a and length({EV['assessment']}) >= 8) or (t and length({EV['treatment']}) >= 8) as solid from g5),
    gt as (select *, v2 and solid as meat_valid, ('missing' in (s_m, s_e, s_a, s_t)) or tier <> 'high' or (v2 and some_short) as review,
        (rule0 = {q(me.FAIL)} and not a0)::int + (rule0 = {q(me.FAIL)} and not (m0 or e0 or t0))::int + len(list_filter([s_m, s_e, s_a, s_t], lambda x: x in ('short', 'missing')))
          + (tier = 'low')::int + past::int + (hist and a1 and not past)::int + (m1 and not m)::int + (e1 and not e)::int + (a2 and not a)::int + (t1 and not t)::int
          + case when v2 then (m and length({EV['monitoring']}) < 8)::int + (e and length({EV['evaluation']}) < 8)::int + (a and length({EV['assessment']}) < 8)::int + (t and length({EV['treatment']}) < 8)::int + (not solid)::int else 0 end as n_issues
        from g6)"""


@query("meat_gate", f"""
    with {GATE} select doc_id, ord, m as monitoring, e as evaluation, a as assessment, t as treatment, rule, meat_valid, tier, review,
        cast(n_issues as bigint) as n_issues from gt""")
def meat_gate(spark, sf):
    return gated(spark, sf).select(
        "doc_id", "ord", *E4, "rule", "meat_valid", "tier", "review", F.size("issues").cast("bigint").alias("n_issues"))


@query("gate_core_rule", f"with {GATE} select doc_id, ord, rule0 as rule, rule0 <> {q(me.FAIL)} as core_valid from gt")
def gate_core_rule(spark, sf):
    m, e, a, t = (F.col(x) for x in E4)
    n = sum((F.col(x).cast("int") for x in E4), F.lit(0))
    rule = F.when(a & (m | e | t), me.PASS_A).when(t & (m | e), me.PASS_T).when(n >= 2, me.PASS_N).otherwise(me.FAIL)
    return graded(spark, sf).select("doc_id", "ord", rule.alias("rule"), (rule != me.FAIL).alias("core_valid"))


@query("evidence_grounding", f"with {GATE} select doc_id, ord, s_e = 'found' as evaluation_found, s_t = 'found' as treatment_found from gt")
def evidence_grounding(spark, sf):
    ctx = me.squash(F.col("context"))
    test = lambda e: F.col(e) & (F.length(F.trim(f"{e}_evidence")) >= 5) & me.grounded(F.trim(f"{e}_evidence"), ctx)
    return claimed(spark, sf).select("doc_id", "ord", test("evaluation").alias("evaluation_found"), test("treatment").alias("treatment_found"))


TIERED = f"""{GATE}, tr as (select *, case when meat_valid and k >= 3 then 'strong_evidence' when meat_valid and k >= 2 then 'moderate_evidence' when k >= 1 then 'weak_evidence' else 'no_meat' end as mt
        from (select *, m::int + e::int + a::int + t::int as k from gt)),
    fs as (select doc_id, ord, mt, case when mt = 'no_meat' and {SRC_ANY(kn.HISTORY_SECTIONS)} and not ({SRC_ANY(kn.TEMPORAL_ACTIVE_SECTIONS)}) then 'history_only'
        when meat_valid and review then 'review' when meat_valid then 'valid' else 'invalid' end as final_status from tr)"""


@query("meat_tier", f"with {TIERED} select doc_id, ord, mt as meat_tier, final_status from fs")
def meat_tier(spark, sf):
    return me.evidence_tier(gated(spark, sf)).select("doc_id", "ord", "meat_tier", "final_status")


@query("meat_summary", f"""
    with {TIERED} select doc_id, count(*) as total, count(*) filter (final_status = 'valid') as valid, count(*) filter (final_status = 'review') as review_required,
        count(*) filter (final_status = 'invalid') as invalid, count(*) filter (final_status = 'history_only') as history_only,
        cast(round_even(count(*) filter (final_status in ('valid', 'review')) / count(*), 2) as double) as success_rate from fs group by doc_id""")
def meat_summary(spark, sf):
    return me.evidence_summary(me.evidence_tier(gated(spark, sf)))


# --- verification ------------------------------------------------------------------
IN_DOC = """contains(body, low) or (len(ws) > 0 and len(list_filter(ws, lambda w: contains(body, w))) >= len(ws) * 0.3)"""


def stated(spark, sf):
    """Result rows with the lower-case text of their document."""
    return with_texts(graded(spark, sf), notes(spark, sf).select("doc_id", F.lower("text").alias("body")), how="inner")


STATED = "st as (select r.*, lower(n.text) as body from results r join notes n using (doc_id))"


@query("evidence_in_document", f"""
    with {STATED}, w as (select *, lower(trim(treatment_evidence)) as low, list_filter(string_split(left(lower(trim(treatment_evidence)), 80), ' '), lambda w: length(w) > 3) as ws from st where treatment_evidence <> '')
    select doc_id, ord, {IN_DOC} as found from w""")
def evidence_in_document(spark, sf):
    return stated(spark, sf).where("treatment_evidence <> ''").select("doc_id", "ord", me.in_document(F.col("treatment_evidence"), F.col("body")).alias("found"))


def lenient_sql(e: str) -> str:
    """Whether an evidence text stays: a short one, or one that the note holds."""
    words = f"list_distinct(regexp_extract_all({e}_low, '[a-z]{{3,}}'))"
    return f"""length({e}_low) < {kn.LEAST_VERIFIED} or contains(body, left({e}_low, 40))
        or len(list_filter(string_split_regex({e}_low, '[,;]'), lambda p: length({strip('p')}) >= 4 and contains(body, {strip('p')}))) > 0
        or len(list_intersect({words}, words)) >= len({words}) * 0.5"""


LOW = {e: strip(f"lower(coalesce({e}_evidence, ''))") for e in E4}


@query("evidence_verify", f"""
    with nw as (select doc_id, lower(text) as body, list_distinct(regexp_extract_all(lower(text), '[a-z]{{3,}}')) as words from notes),
    w as (select r.doc_id, ord, {', '.join(f"coalesce({e}_evidence, '') as {e}_evidence, {LOW[e]} as {e}_low" for e in E4)},
        coalesce(nw.body, '') as body, coalesce(nw.words, []) as words from results r left join nw on nw.doc_id = r.doc_id),
    v as (select doc_id, ord, evaluation_low, {', '.join(f"case when {lenient_sql(e)} then {e}_evidence else '' end as {e}_evidence" for e in E4)} from w),
    sc as (select *, {' + '.join(f"cast({strip(f'{e}_evidence')} <> '' as int)" for e in E4)} as meat_score from v)
    select doc_id, ord, case when evaluation_low <> '' then evaluation_evidence <> '' end as found, {', '.join(f'{e}_evidence' for e in E4)},
        cast(meat_score as bigint) as meat_score, case meat_score {' '.join(f"when {n} then '{g}'" for n, g in kn.MEAT_GRADES.items())} end as meat_grade from sc""")
def evidence_verify(spark, sf):
    """All texts verified, scored and graded; ``found`` says whether the note holds the evaluation text, null without one."""
    rows = results(spark, sf).withColumn("given", F.col("evaluation_evidence"))
    found = F.when(me.trimmed(F.col("given")) != "", F.col("evaluation_evidence") != "").alias("found")
    return me.verify_evidence(rows, notes(spark, sf)).select(
        "doc_id", "ord", found, *[f"{e}_evidence" for e in E4], F.col("meat_score").cast("bigint"), "meat_grade")


@query("evidence_unique", """
    select doc_id, ord, case when monitoring_evidence = '' or ord = min(ord) over (partition by doc_id, lower(trim(monitoring_evidence))) then monitoring_evidence else '' end as monitoring_evidence
    from results""")
def evidence_unique(spark, sf):
    return me.unique_evidence(graded(spark, sf), "monitoring").select("doc_id", "ord", "monitoring_evidence")
