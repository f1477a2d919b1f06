"""Coding-rule and result queries over the result projection."""
from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as tx
from ..knowledge import clinical as kn
from ..knowledge import coding as kc
from ..operators import results as rs
from ..operators import rules as ru
from .projection import NOTES_SQL, notes, results
from .registry import query
from .sqltext import has_any, lst, q, values
from .texts import FRAGMENT_RE, display_sql, label_sql, title_sql

E4 = ru.ELEMENTS
N = " + ".join(f"(case when {e}_evidence <> '' then 1 else 0 end)" for e in E4)
TIER = f"case when {N} >= 3 then 'strong_evidence' when {N} = 2 then 'moderate_evidence' when {N} = 1 then 'weak_evidence' else 'no_meat' end"
# graded rows: an element holds where its text is present
G = f"""g as (select *, {N} as n, {TIER} as meat_tier, icd_confidence as confidence, string_split(sources, ',') as src,
        concat_ws(' ', {', '.join(f'{e}_evidence' for e in E4)}) as ev, icd_code not in ('', '—') as coded from results)"""


def graded(spark, sf):
    rows = results(spark, sf).withColumn("sources", F.split("sources", ","))
    flags = {e: F.col(f"{e}_evidence") != "" for e in E4}
    n = sum((f.cast("int") for f in flags.values()), F.lit(0))
    tier = F.when(n >= 3, "strong_evidence").when(n == 2, "moderate_evidence").when(n == 1, "weak_evidence").otherwise("no_meat")
    return rows.withColumns({**flags, "meat_tier": tier, "confidence": F.col("icd_confidence"), "meat_valid": n >= 2})


def marked(df):
    return df.select("doc_id", "ord", "disease", "removed")


@query("rule_suspected", f"with {G} select doc_id, ord, disease, regexp_matches(disease || ' ' || ev, {q(kc.SUSPECTED)}) as removed from g")
def rule_suspected(spark, sf):
    return marked(ru.mark_suspected(graded(spark, sf)))


@query("rule_drug_not_dx", f"""
    with {G}, {values([(m,) for m in kc.DRUG_MARKERS], 'meds(m)')}, names as (select distinct disease from g),
    bad as (select distinct disease from names, meds where starts_with(lower(trim(disease)), m) and length(trim(disease)) - length(m) <= 4)
    select doc_id, ord, g.disease, bad.disease is not null as removed from g left join bad on bad.disease = g.disease""")
def rule_drug_not_dx(spark, sf):
    return marked(ru.mark_drug_names(graded(spark, sf)))


@query("rule_lab_not_dx", f"with {G} select doc_id, ord, disease, regexp_full_match(trim(disease), {q(kc.LAB_NAME)}) as removed from g")
def rule_lab_not_dx(spark, sf):
    return marked(ru.mark_lab_names(graded(spark, sf)))


@query("rule_negation", f"""
    with {G}, t as (select *, lower(assessment_evidence) || ' ' || lower(disease) as tx from g),
    m as (select *, regexp_extract(tx, {q(kc.NEGATED)}) as hit from t)
    select doc_id, ord, disease, hit <> '' and len(list_filter(string_split(lower(disease), ' '),
           lambda w: length(w) >= 4 and contains(substr(tx, strpos(tx, hit) + length(hit), 60), w))) > 0 as removed from m""")
def rule_negation(spark, sf):
    return marked(ru.mark_negated(graded(spark, sf)))


@query("rule_documented_only", f"""
    with {G}, {values([(a.upper(), a.lower(), e.lower()) for a, e in __import__('notecoder.knowledge.abbreviations', fromlist=['x']).ABBREVIATIONS], 'ab(u, a, e)')},
    fwd as (select a, max(e) as e from ab group by a), rev as (select e, max_by(a, ord) as a from (select *, row_number() over () as ord from ab) group by e),
    j as (select g.*, lower(n.text) as body, lower(trim(disease)) as low, fwd.e as exp, rev.a as abv
          from g left join notes n using (doc_id) left join fwd on fwd.a = lower(trim(disease)) left join rev on rev.e = lower(trim(disease)))
    select doc_id, ord, disease, not ((n > 0 and len(list_intersect(src, ['assessment', 'assessment_and_plan', 'assessment_plan'])) > 0)
        or coalesce(contains(body, low), false) or coalesce(contains(body, exp), false) or coalesce(contains(body, abv), false)
        or coalesce(contains(low, ' ') and len(list_filter(string_split(low, ' '), lambda w: length(w) >= 4)) > 0
            and len(list_filter(string_split(low, ' '), lambda w: length(w) >= 4 and contains(body, w))) / len(list_filter(string_split(low, ' '), lambda w: length(w) >= 4)) >= 0.6, false)) as removed
    from j""")
def rule_documented_only(spark, sf):
    return marked(ru.mark_documented(graded(spark, sf), notes(spark, sf)))


SUBS = values([(p, x) for p, s in kc.SUBSUMED for x in s], "subs(p, symptom)")


@query("rule_dx_over_symptoms", f"""
    with {G}, {SUBS}, nm as (select distinct disease from g),
    ex as (select distinct disease, symptom from nm, subs where regexp_matches(disease, '(?i)\\b(?:' || p || ')\\b'))
    select a.doc_id, a.ord, a.disease, exists (select 1 from g b join ex on ex.disease = b.disease
        where b.doc_id = a.doc_id and ex.symptom = lower(trim(a.disease))) as removed from g a""")
def rule_dx_over_symptoms(spark, sf):
    return marked(ru.mark_explained_symptoms(graded(spark, sf)))


@query("rule_symptom_only_if_no_dx", f"""
    with {G} select doc_id, ord, disease, regexp_matches(icd_code, '^R[0-9]{{2}}')
        and count(*) filter (coded and not regexp_matches(icd_code, '^R[0-9]{{2}}')) over (partition by doc_id) = 0 as symptom_retained from g""")
def rule_symptom_only(spark, sf):
    return ru.flag_symptom_codes(graded(spark, sf)).select("doc_id", "ord", "disease", "symptom_retained")


@query("rule_chronic_flag", f"with {G} select doc_id, ord, icd_code, list_contains({lst(kc.CHRONIC_CATEGORIES)}, left(replace(icd_code, '.', ''), 3)) as chronic from g")
def rule_chronic(spark, sf):
    return ru.flag_chronic(graded(spark, sf)).select("doc_id", "ord", "icd_code", "chronic")


SPECIFIC = f"""{G}, c as (select *, case when coded and length(icd_code) >= 3 then left(icd_code, 3) end as cat from g),
    k as (select *, first_value(icd_code) over w as kept, row_number() over w as rn from c where cat is not null
          window w as (partition by doc_id, cat order by length(icd_code) desc, ord)),
    sp as (select g.doc_id, g.ord, g.disease, coalesce(k.rn > 1 and starts_with(k.kept, replace(g.icd_code, '.', '')), false) as removed
           from g left join k on k.doc_id = g.doc_id and k.ord = g.ord)"""


@query("rule_specificity", f"with {SPECIFIC} select * from sp")
def rule_specificity(spark, sf):
    return marked(ru.mark_less_specific(graded(spark, sf)))


COMBO = values([(i, a, b, c, d) for i, (a, b, c, d) in enumerate(kc.COMBINATIONS)], "combo(priority, a, b, code, description)")


@query("rule_combination_codes", f"""
    with {G}, {COMBO}, d as (select doc_id, min(ord) as ord, lower(string_agg(disease, ' | ')) as names from g group by doc_id)
    select doc_id, ord, priority, code as icd_code, description from d, combo where regexp_matches(names, a) and regexp_matches(names, b)""")
def rule_combination(spark, sf):
    return ru.combination_suggestions(graded(spark, sf))


@query("rule_etiology_pair", f"""
    with {G} select a.doc_id, a.ord, a.icd_code as manifestation,
        (select b.icd_code from g b where b.doc_id = a.doc_id and b.icd_code similar to 'E1[0-3].*' order by b.ord limit 1) as etiology
    from g a where regexp_matches(a.icd_code, '^[GHN][0-9]{{2}}')
      and exists (select 1 from g b where b.doc_id = a.doc_id and b.icd_code similar to 'E1[0-3].*')""")
def rule_etiology(spark, sf):
    return ru.etiology_pairs(graded(spark, sf))


@query("rule_laterality", f"""
    with {G}, s as (select doc_id, ord, lower(regexp_extract(disease || ' ' || ev, {q(kc.SIDE)}, 1)) as side from g)
    select doc_id, ord, case side when '' then null when 'rt' then 'right' when 'lt' then 'left' when 'r/l' then 'right/left' when 'l/r' then 'left/right' else side end as laterality from s""")
def rule_laterality(spark, sf):
    return ru.laterality(graded(spark, sf)).select("doc_id", "ord", "laterality")


@query("rule_excludes1", f"""
    with {G}, {values(kc.EXCLUDES, 'ex(a, b)')},
    l as (select doc_id, left(replace(icd_code, '.', ''), 3) as cat, max(ord) as ord, max_by(confidence, ord) as conf from g where length(icd_code) >= 3 group by 1, 2),
    lose as (select x.doc_id, case when x.conf >= y.conf then y.ord else x.ord end as ord
             from ex join l x on x.cat = ex.a join l y on y.cat = ex.b and y.doc_id = x.doc_id)
    select g.doc_id, g.ord, disease, exists (select 1 from lose where lose.doc_id = g.doc_id and lose.ord = g.ord) as removed from g""")
def rule_excludes(spark, sf):
    return marked(ru.mark_excluded(graded(spark, sf)))


RANKS = values(list(kc.SECTION_RANK.items()), "sr(name, rank)")


@query("rule_rank", f"""
    with {G}, {RANKS}, u as (select doc_id, ord, unnest(src) as s from g),
    r as (select u.doc_id, u.ord, min(coalesce(rank, 8)) as section_rank from u left join sr on sr.name = s group by 1, 2),
    c as (select g.doc_id, g.ord, disease, cast(round_even(cast(section_rank - (case meat_tier when 'strong_evidence' then 2 when 'moderate_evidence' then 1 else 0 end)
              - (case when list_contains({lst(kc.CHRONIC_CATEGORIES)}, left(replace(icd_code, '.', ''), 3)) then 1 else 0 end) - confidence * 2 as double), 2) as double) as ranking_score
          from g join r using (doc_id, ord))
    select *, row_number() over (partition by doc_id order by ranking_score, ord) as coding_rank,
           case when row_number() over (partition by doc_id order by ranking_score, ord) = 1 then 'primary' else 'secondary' end as coding_priority from c""")
def rule_rank(spark, sf):
    return ru.rank(ru.flag_chronic(graded(spark, sf))).select("doc_id", "ord", "disease", "ranking_score", "coding_rank", "coding_priority")


@query("rule_abbrev_dedup")
def rule_abbrev_dedup(spark, sf):
    return ru.merge_abbreviations(graded(spark, sf)).drop("chosen")


@query("rule_stats", f"""
    with {SPECIFIC} select doc_id, count(*) as total_input, count(*) filter (not removed) as total_output, count(*) filter (removed) as removed,
        cast(max(case when removed then 1 else 0 end) as bigint) as rules_applied, count(*) filter (removed) as actions from sp group by doc_id""")
def rule_stats(spark, sf):
    rows = graded(spark, sf)
    kept, audit = ru.apply_rules(rows)
    return ru.rule_stats(rows, kept, audit)


# --- results -----------------------------------------------------------------------
def score_sql(x="g") -> str:
    tiers = "case meat_tier when 'strong_evidence' then 1 when 'moderate_evidence' then 0.75 when 'weak_evidence' then 0.4 else 0 end"
    return f"cast(greatest(0, least(1, round_even(cast(0.4::double * least(n / 4.0::double + least(n * 0.05::double, 0.15::double), 1) + 0.3::double * icd_confidence + 0.3::double * {tiers} as double), 3))) as double)"


@query("confidence_score", f"with {G} select doc_id, ord, {score_sql()} as confidence, cast(round_even(0.6::double * (n / 4.0::double) + 0.4::double * icd_confidence, 2) as double) as simple from g")
def confidence_score(spark, sf):
    return graded(spark, sf).select("doc_id", "ord", rs.confidence_score().alias("confidence"), rs.simple_confidence().alias("simple"))


OUT = f"""{G}, o as (select *, {display_sql('disease')} as shown, coded and n > 0 and not regexp_matches({display_sql('disease')}, '{FRAGMENT_RE}') as ok from g),
    kept as (select * exclude (disease), case when ok then shown else disease end as disease from o
             where ok or (coded and doc_id not in (select doc_id from o where ok)))"""


@query("output_filter", f"with {OUT} select doc_id, ord, disease, icd_code from kept")
def output_filter(spark, sf):
    return rs.output_filter(graded(spark, sf)).select("doc_id", "ord", "disease", "icd_code")


def over(names) -> str:
    return f"len(list_intersect(src, {lst(names)})) > 0"


@query("section_priority_rule", f"""
    with {G}, f as (select *, treatment_evidence <> '' as t, {over(kc.EVIDENCE_SECTIONS)} as act, {over(kc.FOCUS_SECTIONS)} as foc,
        len(list_filter(src, lambda s: not list_contains({lst(kc.SOLE_SECTIONS)}, s))) = 0 as sole, bool_or({over(kc.ASSESSMENT_SECTIONS)}) over (partition by doc_id) as assessed from g)
    select doc_id, ord, case when not assessed then true when sole then false
             else {over(kc.VISIT_ASSESSMENT)} or ({over(kc.SECONDARY_SECTIONS)} and (t or act or foc)) or (foc and (t or act)) or {over(kc.ASSESSMENT_SECTIONS)}
                  or ((t or act) and {over(kc.PRIMARY_SECTIONS)}) end as single_pass,
        case when assessed then {over(kc.ASSESSMENT_SECTIONS)} or t else {over(kc.CLINICAL_SECTIONS)} end as multi_step from f""")
def section_priority_rule(spark, sf):
    both = rs.section_priority(rs.section_priority(graded(spark, sf), True).withColumnRenamed("passes", "single_pass"), False)
    return both.select("doc_id", "ord", "single_pass", F.col("passes").alias("multi_step"))


STATUS = f"""case when list_contains(src, 'past_medical_history') and not {over(kn.TEMPORAL_ACTIVE_SECTIONS)} and treatment_evidence = '' and not {has_any("lower(disease || ' ' || ev)", kn.CHRONIC_WORDS)} then 'History Only'
    when {over(kn.TEMPORAL_ACTIVE_SECTIONS)} and {has_any("lower(disease || ' ' || ev)", kn.ACUTE_WORDS)} and not {has_any("lower(disease || ' ' || ev)", kn.CHRONIC_WORDS)} then 'Active Acute'
    when {over(kn.TEMPORAL_ACTIVE_SECTIONS)} then 'Active Chronic' else 'Chronic' end"""


def with_status(rows):
    return rows.withColumn("disease_status", rs.disease_status(F.concat_ws(" ", "disease", ru.all_evidence()), F.col("treatment")))


@query("disease_status", f"with {G} select doc_id, ord, {STATUS} as disease_status from g")
def disease_status(spark, sf):
    return with_status(graded(spark, sf)).select("doc_id", "ord", "disease_status")


@query("grace_fallback", f"""
    with {G} select doc_id, ord, disease from g where {over(kc.GRACE_SECTIONS)} and {STATUS} <> 'History Only'""")
def grace_fallback(spark, sf):
    return rs.grace_rows(with_status(graded(spark, sf))).select("doc_id", "ord", "disease")


@query("strict_output_filter", f"""
    with {G}, f as (select *, {STATUS} as st, treatment_evidence <> '' as t, {over(kc.VISIT_ASSESSMENT)} as vis, {over(kc.FOCUS_SECTIONS)} as foc, {over(kc.EVIDENCE_SECTIONS)} as act,
        {over(kc.STRICT_ASSESSMENT)} as listed, bool_or({over(kc.STRICT_ASSESSMENT)}) over (partition by doc_id) as assessed, {display_sql('disease')} as shown from g),
    p as (select *, not regexp_matches(disease, {q(kc.CANCER)}) or vis or starts_with(icd_code, 'Z85') as present,
        st <> 'History Only' and len(list_filter(src, lambda s: not list_contains({lst(kc.RESTRICTED_SECTIONS)}, s))) > 0 and coded and icd_code <> '-'
        and not regexp_matches(shown, '{FRAGMENT_RE}') and trim(ev) <> '' as ok from f),
    m as (select *, 'single' as mode, ok and present and (not assessed or vis or foc or ((t or act) and {over(kc.STRICT_PRIMARY)})) as pass from p
        union all select *, 'multi', ok and present and case when assessed then listed or t else {over(kc.STRICT_CLINICAL)} end from p),
    a as (select *, bool_or(pass) over (partition by doc_id, mode) as found from m)
    select doc_id, ord, mode, case when pass then shown else disease end as disease, icd_code, not pass as grace from a
    where pass or (not found and {over(kc.GRACE_SECTIONS)} and st <> 'History Only')""")
def strict_output_filter(spark, sf):
    out = rs.strict_output_filters(with_status(graded(spark, sf)), ["single", "multi"])
    return out.select("doc_id", "ord", "mode", "disease", "icd_code", "grace")


BANDS = values(kc.BMI_BANDS, "bands(lo, hi, code)")


@query("code_corrections", f"""
    with {G}, {BANDS}, t as (select *, disease || ' ' || assessment_evidence as tx, try_cast(nullif(regexp_extract(disease || ' ' || assessment_evidence, {q(kc.BMI_VALUE)}, 1), '') as double) as bmi from g)
    select doc_id, ord, case when icd_code = 'I10' and regexp_matches(tx, {q(kc.ELEVATED_PRESSURE)}) then 'R03.0'
        when starts_with(icd_code, 'Z68.') and code is not null then code else icd_code end as icd_code
    from t left join bands on bmi >= lo and bmi < hi""")
def code_corrections(spark, sf):
    return rs.correct_codes(graded(spark, sf)).select("doc_id", "ord", "icd_code")


@query("active_management", f"""
    with {G} select doc_id, ord, case when trim(monitoring_evidence) <> '' or trim(evaluation_evidence) <> '' then true
        when trim(treatment_evidence) <> '' then not regexp_matches(treatment_evidence, {q(kc.MAINTENANCE_ONLY)}) and regexp_matches(treatment_evidence, {q(kc.MANAGEMENT)})
        else regexp_matches(assessment_evidence, {q(kc.MANAGEMENT)}) end as managed from g""")
def active_management(spark, sf):
    return graded(spark, sf).select("doc_id", "ord", rs.active_management().alias("managed"))


@query("historical_name", f"with {G} select doc_id, ord, regexp_matches(disease, {q(kc.HISTORY_NAME)}) as historical from g")
def historical_name(spark, sf):
    return graded(spark, sf).select("doc_id", "ord", rs.historical_name().alias("historical"))


@query("dedup_by_code", f"""
    with {G}, r as (select *, row_number() over (partition by doc_id, icd_code order by length(disease) desc,
        case meat_tier when 'strong_evidence' then 0 when 'moderate_evidence' then 1 when 'weak_evidence' then 2 else 9 end, ord) as rn from g)
    select doc_id, ord, disease, icd_code from r where not coded or rn = 1""")
def dedup_by_code(spark, sf):
    return rs.dedup_by_code(graded(spark, sf)).select("doc_id", "ord", "disease", "icd_code")


@query("dedup_abbreviation")
def dedup_abbreviation(spark, sf):
    return rs.dedup_abbreviations(graded(spark, sf)).drop("chosen")


@query("dedup_substring", f"""
    with {G} select doc_id, ord, disease from g a where not exists (select 1 from g b where b.doc_id = a.doc_id
        and contains(lower(b.disease), lower(a.disease)) and length(a.disease) < length(b.disease)
        and (a.icd_code = '' or b.icd_code = '' or a.icd_code = b.icd_code))""")
def dedup_substring(spark, sf):
    return rs.dedup_substring(graded(spark, sf)).select("doc_id", "ord", "disease")


ROOTS = """list_filter(list_transform(list_filter(string_split({x}, ' '), lambda w: length(w) >= 5),
    lambda w: case """ + " ".join(f"when suffix(w, '{e}') and length(w) - {len(e)} >= 4 then left(w, length(w) - {len(e)})" for e in ("ies", "ous", "es", "ia", "ic", "al", "y", "s")) + " else w end), lambda r: length(r) >= 5)"


@query("dedup_stem", f"""
    with recursive {G}, k as (select doc_id, lower(trim(disease)) as nm, coalesce(icd_code, '') as c, min(ord) as o from g group by 1, 2, 3),
    i as (select doc_id, list({{'o': o, 'nm': nm, 'c': c, 'rt': {ROOTS.format(x='nm')}}} order by o) as it from k group by 1),
    r as (select doc_id, it, 1 as i, []::bigint[] as gone from i
        union all select doc_id, it, i + 1, case when len(list_filter(it, lambda y: length(it[i].nm) < length(y.nm) and (it[i].c = '' or y.c = '' or it[i].c = y.c)
            and not list_contains(gone, y.o) and len(list_filter(it[i].rt, lambda t: contains(replace(y.nm, ' ', ''), t))) > 0)) > 0 then list_append(gone, it[i].o) else gone end from r where i <= len(it)),
    d as (select doc_id, unnest(it) as x, gone from r where i = len(it) + 1)
    select g.doc_id, ord, disease from g left join d on d.doc_id = g.doc_id and d.x.nm = lower(trim(disease)) and d.x.c = coalesce(icd_code, '') where not list_contains(gone, d.x.o)""")
def dedup_stem(spark, sf):
    return rs.dedup_stem(graded(spark, sf)).select("doc_id", "ord", "disease")


@query("final_order", f"with {G} select doc_id, ord, disease, row_number() over (partition by doc_id order by lower(disease), ord) as number from g")
def final_order(spark, sf):
    return rs.final_order(graded(spark, sf)).select("doc_id", "ord", "disease", "number")


SUMMARY = """count({f}) as total, count({f}) filter (meat_tier = 'strong_evidence') as strong_evidence, count({f}) filter (meat_tier = 'moderate_evidence') as moderate_evidence,
    count({f}) filter (meat_tier = 'weak_evidence') as weak_evidence, count({f}) filter (meat_tier = 'no_meat') as no_meat, count({f}) filter (coded) as icd_mapped"""


@query("document_summary", f"""
    with {OUT} select g.doc_id, count(*) as total_detected, {SUMMARY.format(f='k').replace('meat_tier', 'g.meat_tier').replace('(coded)', '(g.coded)')}, count(*) - count(k) as total_excluded
    from g left join (select doc_id, ord, 1 as k from kept) kk using (doc_id, ord) group by g.doc_id""")
def document_summary(spark, sf):
    rows = graded(spark, sf)
    return rs.document_summary(rs.output_filter(rows), rows)


@query("unified_results", f"""
    with {G} select doc_id, ord, disease, case when confidence >= 0.5 then icd_code end as icd_code, {label_sql('sources')} as segment,
        case meat_tier when 'strong_evidence' then 'Strong Evidence' when 'moderate_evidence' then 'Moderate Evidence' when 'weak_evidence' then 'Weak Evidence' else 'No MEAT' end as meat_level,
        case when confidence >= 0.5 then icd_confidence else 0 end as icd_confidence, case when confidence >= 0.5 then 'exact_match' else 'none' end as icd_method from g""")
def unified_results(spark, sf):
    rows = graded(spark, sf)
    mapped = rows.where("confidence >= 0.5").select("doc_id", "ord", "icd_code", "icd_confidence", F.lit("exact_match").alias("icd_method"))
    out = rs.unified_results(rows.drop("icd_code", "icd_confidence"), mapped)
    return out.select("doc_id", "ord", "disease", "icd_code", "segment", "meat_level", "icd_confidence", "icd_method")


def cell_sql(e: str) -> str:
    return f"case when {e}_evidence <> '' then {e}_evidence else '—' end"


@query("coding_csv_export", f"""
    with {G} select doc_id, ord, disease as "Disease", icd_code as "ICD-10 Code", {title_sql('src[1]')} as "Segment", {cell_sql('monitoring')} as "Monitor",
        {cell_sql('evaluation')} as "Evaluate", {cell_sql('assessment')} as "Assess", {cell_sql('treatment')} as "Treatment",
        case n when 4 then 'Full MEAT' when 3 then 'Medium MEAT' when 2 then 'Half MEAT' else 'Partial MEAT' end as "MEAT Level"
    from g where n >= 2 and coded""")
def coding_csv_export(spark, sf):
    return rs.coding_export(graded(spark, sf))


TICKS = ", ".join(f"case when {e}_evidence <> '' then '✓' else '' end as \"{e[0].upper()}\"" for e in E4)


@query("billing_report", f"""
    with {G} select doc_id, ord, disease as "Disease", icd_code as "ICD-10 Code", meat_tier as "MEAT Tier", cast(n as bigint) as "MEAT Score", {TICKS},
        cast(cast(round_even(confidence * 100, 0) as int) as varchar) || '%' as "Confidence" from g""")
def billing_report(spark, sf):
    return rs.billing_report(graded(spark, sf))


EVS = ", ".join(f"{e}_evidence as \"{e.title()} Evidence\"" for e in E4)


@query("full_report", f"""
    with {G} select doc_id, ord, disease as "Disease", icd_code as "ICD-10 Code", {label_sql('sources')} as "Section", meat_tier as "MEAT Tier", cast(n as bigint) as "MEAT Score", {TICKS}, {EVS},
        cast(cast(round_even(confidence * 100, 0) as int) as varchar) || '%' as "Confidence" from g""")
def full_report(spark, sf):
    return rs.full_report(graded(spark, sf))


@query("rejections", f"""
    with {G}, r as (select *, case when negated then 'NEGATED' when not coded then 'NO_CODE' when regexp_matches({display_sql('disease')}, '{FRAGMENT_RE}') then 'FRAGMENT'
        when n = 0 then 'NO_MEAT_EVIDENCE' end as reason from g)
    select doc_id, ord, disease, reason, src[1] as section from r where reason is not null""")
def rejections(spark, sf):
    return rs.rejections(graded(spark, sf))


@query("route_coalesce", f"""
    with {G}, t as (select doc_id, ord, case when n >= 3 then 0 when n = 2 then 1 else 2 end as p from g)
    select doc_id, ord, ['dual_agent', 'single_pass', 'multi_step'][p + 1] as analysis_source from t where p = (select min(p) from t t2 where t2.doc_id = t.doc_id)""")
def route_coalesce(spark, sf):
    g = graded(spark, sf)
    tier = lambda *t: g.where(F.col("meat_tier").isin(*t))
    out = rs.route_coalesce([("dual_agent", tier("strong_evidence")), ("single_pass", tier("moderate_evidence")), ("multi_step", tier("weak_evidence", "no_meat"))])
    return out.select("doc_id", "ord", "analysis_source")


@query("mapping_stats", f"""
    with {G} select doc_id, count(*) as total, count(*) filter (confidence >= 0.9) as auto_assigned, count(*) filter (confidence >= 0.3 and confidence < 0.9) as manual_review,
        count(*) filter (confidence < 0.3) as not_found from g group by doc_id""")
def mapping_stats(spark, sf):
    status = F.when(F.col("confidence") >= 0.9, "auto_assigned").when(F.col("confidence") >= 0.3, "manual_review").otherwise("not_found")
    return rs.mapping_stats(graded(spark, sf).withColumn("status", status))
