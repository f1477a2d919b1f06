"""Reply, verdict, evaluation, status and budget queries."""
from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.arrays import explode_rows
from ..knowledge import coding as kc
from ..operators import evaluate as ev
from ..operators import replies as rp
from ..streaming import jobs
from .coding import G, graded
from .mapping import RCODES, result_codes
from .projection import CODES, duck, notes, pick, results, table
from .registry import query
from .sqltext import q, values

# replies drawn from events: sound, fenced, with a trailing comma, with text around, cut off
RAW = """case event_id % 5 when 0 then props when 1 then concat('```json', chr(10), props, chr(10), '```') when 2 then concat(left(props, length(props) - 1), ', }')
    when 3 then concat('Here it is: ', props, ' as asked') else left(props, length(props) - 1) end"""


@query("repair_json", """
    select event_id as doc_id, cast(json_extract(props, '$.k') as bigint) as k, ['none', 'tidied', 'tidied', 'balanced', 'balanced'][event_id % 5 + 1] as repair from events""")
def repair_json(spark, sf):
    raw = table(spark, sf, "events").selectExpr("event_id as doc_id", f"{RAW} as raw")
    return rp.repair(raw, "k bigint").select("doc_id", F.col("parsed.k").alias("k"), "repair")


def reply_rows(spark, sf):
    """One reply per result row, written as JSON by the engine itself."""
    g = graded(spark, sf)
    m = F.struct(*[F.col(f"{e}_evidence").alias(n) for e, n in zip(("monitoring", "evaluation", "assessment", "treatment"), ("M_monitor", "E_evaluate", "A_assess", "T_treat"))])
    d = F.struct(F.col("disease").alias("disease_name"), F.when(F.col("negated"), "resolved").otherwise("active").alias("active_status"),
                 F.col("sources")[0].alias("source_section"), F.col("icd_code").alias("icd10_code"), m.alias("meat_validation"))
    return g.select("doc_id", "ord", F.to_json(F.struct(F.array(d).alias("diseases"))).alias("raw"))


@query("explode_reply", "select doc_id, disease, icd_code, split_part(sources, ',', 1) as section, monitoring_evidence, treatment_evidence from results where not negated")
def explode_reply(spark, sf):
    rows = rp.reply_diseases(rp.repair(reply_rows(spark, sf), rp.REPLY))
    return rows.select("doc_id", "disease", "icd_code", F.col("sources")[0].alias("section"), "monitoring_evidence", "treatment_evidence")


VERDICT = "case ord % 4 when 0 then 'KEEP' when 1 then 'FIX' when 2 then 'REMOVE' else 'OTHER' end"


def verdict_rows(spark, sf):
    g = graded(spark, sf).where("negated and icd_code <> ''")
    return g.selectExpr(
        "doc_id", "lower(icd_code) as icd_code", "ord", f"{VERDICT} as verdict", "case when ord % 8 = 1 then 'Z99.9' end as corrected_icd_code",
        "case when ord % 3 = 0 then 'Corrected name' end as corrected_disease_name", "'checked' as new_monitoring", "'' as new_evaluation",
        "cast(null as string) as new_assessment", "'treated' as new_treatment")


@query("apply_verdicts", f"""
    with v as (select doc_id, upper(icd_code) as c, max_by({VERDICT}, ord) as verdict, max(ord) as vo from results where negated and icd_code <> '' group by 1, 2),
    j as (select r.*, v.verdict, v.vo, coalesce(v.verdict = 'FIX', false) as fix from results r left join v on v.doc_id = r.doc_id and v.c = upper(r.icd_code))
    select doc_id, ord, case when fix and vo % 8 = 1 then 'Z99.9' else icd_code end as icd_code, case when fix and vo % 3 = 0 then 'Corrected name' else disease end as disease,
        case when fix and monitoring_evidence = '' then 'checked' else monitoring_evidence end as monitoring_evidence,
        case when fix and treatment_evidence = '' then 'treated' else treatment_evidence end as treatment_evidence
    from j where coalesce(verdict, 'KEEP') <> 'REMOVE'""")
def apply_verdicts(spark, sf):
    out = rp.apply_verdicts(graded(spark, sf), verdict_rows(spark, sf))
    return out.select("doc_id", "ord", "icd_code", "disease", "monitoring_evidence", "treatment_evidence")


@query("parse_verdicts")
def parse_verdicts(spark, sf):
    v = verdict_rows(spark, sf)
    item = F.struct("icd_code", "verdict", "corrected_icd_code", "corrected_disease_name")
    raw = v.select("doc_id", "ord", F.to_json(F.struct(F.array(item).alias("verified_codes"))).alias("raw"))
    rows = explode_rows(rp.repair(raw, rp.VERDICTS), F.col("parsed.verified_codes"), "doc_id", "ord")
    known = F.upper("verdict").isin("KEEP", "FIX", "REMOVE")
    return rows.select("doc_id", "ord", "icd_code", F.when(known, F.upper("verdict")).otherwise("KEEP").alias("verdict"))


@query("merge_additions", """
    with a as (select 0 as side, doc_id, ord, disease, case when ord % 6 = 0 and icd_code <> '' then icd_code || ', X99' else icd_code end as icd_code from results where not negated
               union all select 1, doc_id, ord, disease, icd_code from results where negated),
    s as (select side, doc_id, ord, disease, trim(unnest(string_split(icd_code, ','))) as icd_code, generate_subscripts(string_split(icd_code, ','), 1) as i from a),
    r as (select *, row_number() over (partition by doc_id, upper(icd_code) order by side, ord, i) as rn from s)
    select doc_id, ord, disease, icd_code from r where icd_code = '' or rn = 1""")
def merge_additions(spark, sf):
    g = results(spark, sf).select("doc_id", "ord", "disease", "icd_code", "negated")
    kept = g.where("not negated").withColumn("icd_code", F.expr("case when ord % 6 = 0 and icd_code <> '' then concat(icd_code, ', X99') else icd_code end")).drop("negated")
    return rp.merge_additions(kept, g.where("negated").drop("negated"))


BANDS = values(kc.BMI_BANDS, "bands(lo, hi, code)")


@query("bmi_pairing", f"""
    with {BANDS}, f as (select doc_id, bool_or(starts_with(icd_code, 'E66')) as e, bool_or(starts_with(icd_code, 'Z68')) as z from results group by 1),
    n as (select f.doc_id, regexp_extract(text, {q(kc.BMI_VALUE)}, 1) as v from f join notes using (doc_id) where e and not z)
    select doc_id, disease, icd_code from results join f using (doc_id) where e or not starts_with(icd_code, 'Z68')
    union all select doc_id, 'BMI ' || v, code from n join bands on try_cast(v as double) >= lo and try_cast(v as double) < hi""")
def bmi_pairing(spark, sf):
    return rp.bmi_pairing(results(spark, sf).select("doc_id", "disease", "icd_code"), notes(spark, sf))


@query("bmi_code", f"""
    with {BANDS}, n as (select doc_id, try_cast(nullif(regexp_extract(text, {q(kc.BMI_VALUE)}, 1), '') as double) as v from notes)
    select doc_id, v as bmi, code from n left join bands on v >= lo and v < hi""")
def bmi_code(spark, sf):
    v = F.nullif(F.regexp_extract("text", kc.BMI_VALUE, 1), F.lit("")).cast("double")
    from ..operators.results import bmi_band

    return notes(spark, sf).select("doc_id", v.alias("bmi")).withColumn("code", bmi_band(F.col("bmi")))


# --- evaluation: rows that are not negated predict, all rows are expected -------------
def expected(spark, sf):
    return graded(spark, sf).withColumn("negated", F.col("ord") % 13 == 0)


def predicted(spark, sf):
    g = graded(spark, sf).where("not negated")
    return g.withColumn("candidates", F.array(F.lit("R69"), F.substring("icd_code", 1, 3), F.col("icd_code")))


PRF = """case when tp + fp > 0 then round_even(tp / (tp + fp), 4) else 0 end::double as precision, case when tp + fn > 0 then round_even(tp / (tp + fn), 4) else 0 end::double as recall,
    case when tp > 0 then round_even(2 * (tp / (tp + fp)) * (tp / (tp + fn)) / ((tp / (tp + fp)) + (tp / (tp + fn))), 4) else 0 end::double as f1"""
DET = f"""{G}, p as (select doc_id, lower(disease) as name, count(*) as p from g where not negated group by 1, 2), e as (select doc_id, lower(disease) as name, count(*) as e from g where ord % 13 <> 0 group by 1, 2),
    j as (select doc_id, coalesce(p, 0) as p, coalesce(e, 0) as e from p full join e using (doc_id, name)),
    t as (select doc_id, sum(least(p, e))::bigint as tp, (sum(p) - sum(least(p, e)))::bigint as fp, (sum(e) - sum(least(p, e)))::bigint as fn from j group by 1),
    det as (select *, {PRF} from t)"""


@query("eval_detection", f"with {DET} select * from det")
def eval_detection(spark, sf):
    return ev.detection(predicted(spark, sf), expected(spark, sf))


@query("eval_detection_fuzzy")
def eval_detection_fuzzy(spark, sf):
    return ev.detection_fuzzy(predicted(spark, sf), expected(spark, sf))


COD = """pc as (select doc_id, lower(disease) as name, min_by(icd_code, ord) as code from g where not negated group by 1, 2),
    cj as (select x.doc_id, upper(x.icd_code) as want, pc.name is not null as hit, upper(pc.code) as got from g x left join pc on pc.doc_id = x.doc_id and pc.name = lower(x.disease) where x.ord % 13 <> 0),
    cod as (select doc_id, count(*) as total_expected, count(*) filter (hit and got = want) as exact_correct, count(*) filter (hit and want in (got, 'R69', left(got, 3))) as top3_correct from cj group by 1),
    codr as (select *, round_even(exact_correct / total_expected, 4) as exact_match_accuracy, round_even(top3_correct / total_expected, 4) as top3_accuracy from cod)"""


@query("eval_codes", f"with {G}, {COD} select * from codr")
def eval_codes(spark, sf):
    return ev.codes(predicted(spark, sf), expected(spark, sf))


VAL = f"""pv as (select doc_id, lower(disease) as name, min_by(n >= 2, ord) as got from g where not negated group by 1, 2),
    vj as (select x.doc_id, x.n >= 2 as want, pv.got from g x left join pv on pv.doc_id = x.doc_id and pv.name = lower(x.disease) where x.ord % 13 <> 0),
    vt as (select doc_id, count(*) filter (want and got) as tp, count(*) filter (not want and got) as fp, count(*) filter (want and coalesce(not got, true)) as fn, count(*) filter (not want and not got) as tn from vj group by 1),
    val as (select *, {PRF} from vt)"""


@query("eval_meat", f"with {G}, {VAL} select * from val")
def eval_meat(spark, sf):
    return ev.validity(predicted(spark, sf), expected(spark, sf))


@query("eval_macro", f"""
    with {DET}, {COD}, {VAL} select count(*) as num_documents, round_even(avg(det.f1), 4) as avg_detection_f1, round_even(avg(exact_match_accuracy), 4) as avg_icd_exact,
        round_even(avg(top3_accuracy), 4) as avg_icd_top3, round_even(avg(val.f1), 4) as avg_meat_f1 from det join codr using (doc_id) join val using (doc_id)""")
def eval_macro(spark, sf):
    p, e = predicted(spark, sf), expected(spark, sf)
    return ev.macro(ev.detection(p, e), ev.codes(p, e), ev.validity(p, e))


# --- status and budget -------------------------------------------------------------
def status_events(spark, sf):
    return table(spark, sf, "events").selectExpr("event_id", "user_id as doc_id", "ts", "event_type as status")


@query("latest_status", "select user_id as doc_id, max_by(event_type, (ts, event_id)) as status, max(ts) as at, count(*) as changes from events group by 1")
def latest_status(spark, sf):
    return jobs.latest_status(status_events(spark, sf))


@query("status_windows", "select time_bucket(interval '1 hour', ts) as start, event_type as status, count(*) as n from events group by 1, 2")
def status_windows(spark, sf):
    return jobs.status_counts(status_events(spark, sf))


PRICES = [("click", "3.5", "10.5"), ("purchase", "10.0", "30.0"), ("view", "0.15", "0.6")]


@query("usage_budget", """
    with u as (select event_id, user_id as session, ts, cast(value * 1000 as bigint) as p, cast(value * 200 as bigint) as c,
        case event_type when 'click' then 3.5 when 'purchase' then 10.0 when 'view' then 0.15 else 0.075 end::decimal(12,4) as pin, case event_type when 'click' then 10.5 when 'purchase' then 30.0 when 'view' then 0.6 else 0.3 end::decimal(12,4) as pout from events),
    r as (select event_id, session, sum(p + c) over w as total_tokens, (sum(p * pin + c * pout) over w)::double / 1e6 as cost from u window w as (partition by session order by ts, event_id rows unbounded preceding))
    select event_id, session, cast(total_tokens as bigint) as total_tokens, cost as total_cost, total_tokens > 2000000 or cost > 5 as over_limit from r""")
def usage_budget(spark, sf):
    u = table(spark, sf, "events").selectExpr(
        "event_id", "user_id as session", "ts", "event_type as model", "cast(bround(value * 1000, 0) as bigint) as prompt_tokens", "cast(bround(value * 200, 0) as bigint) as completion_tokens")
    out = jobs.usage_budget(u, PRICES, ("0.075", "0.30"))
    return out.select("event_id", "session", "total_tokens", "total_cost", "over_limit")


# --- replies to results: one reply per document, a second look by name, codes of the dictionary ---
@query("reply_to_results", f"""
    with {RCODES}, dd as (select lower(description) as name, min_by(code, seq) as code from rc group by 1),
    kb as (select replace(upper(trim(code)), '.', '') as bare, min_by(struct_pack(code := code, description := description), seq) as hit from rc group by 1),
    a as (select * from results where not negated and trim(disease) <> ''),
    c as (select a.*, case when trim(icd_code) <> '' then trim(icd_code) when split_part(sources, ',', 1) in ('assessment', 'assessment_and_plan') then coalesce(dd.code, '') else '' end as code
        from a left join dd on dd.name = lower(disease)),
    k as (select c.*, hit, {' + '.join(f"cast({x} <> '' as int)" for x in rp.TEXTS)} as n, case when hit is null then 0.70::double else 0.95::double end as sure
        from c left join kb on kb.bare = replace(upper(code), '.', '') where code <> '')
    select doc_id, row_number() over (partition by doc_id order by ord) as number, disease, coalesce(hit.code, code) as icd_code, coalesce(hit.description, '') as icd_description, sure as icd_confidence,
        cast(n as bigint) as meat_score, case when n >= 3 then 'strong_evidence' when n = 2 then 'moderate_evidence' when n = 1 then 'weak_evidence' else 'no_meat' end as meat_tier,
        round_even(case when n = 0 then least(0.42::double, sure * 0.4::double) else n / 4 * 0.6::double + sure * 0.4::double end, 2) as confidence from k""")
def reply_to_results(spark, sf):
    g = graded(spark, sf)
    m = F.struct(*[F.col(f"{e}_evidence").alias(n) for e, n in zip(("monitoring", "evaluation", "assessment", "treatment"), ("M_monitor", "E_evaluate", "A_assess", "T_treat"))])
    d = F.struct("ord", F.col("disease").alias("disease_name"), F.when(F.col("negated"), "resolved").otherwise("active").alias("active_status"),
                 F.col("sources")[0].alias("source_section"), F.col("icd_code").alias("icd10_code"), m.alias("meat_validation"))
    replies = g.groupBy("doc_id").agg(F.to_json(F.struct(F.array_sort(F.collect_list(d)).alias("diseases"))).alias("raw"))
    codes = result_codes(spark, sf)
    by_name = codes.groupBy(F.lower("description").alias("_n")).agg(F.min_by("code", "seq").alias("icd_code"))
    lookup = lambda names: names.join(by_name, F.lower("name") == F.col("_n")).select("name", "icd_code")
    out = rp.reply_to_results(rp.reply_diseases(rp.repair(replies, rp.REPLY)), codes, lookup)
    return out.select("doc_id", F.col("number").cast("bigint"), "disease", "icd_code", "icd_description", "icd_confidence", F.col("meat_score").cast("bigint"), "meat_tier", "confidence")
