"""Code lookup queries: the part table as dictionary, and codes drawn from result rows."""
from __future__ import annotations

from pyspark.sql import functions as F

from ..knowledge.synonyms import CONTRADICTIONS, SYNONYMS
from ..operators import mapping as mp
from .coding import graded
from .projection import duck, results, table
from .registry import query
from .sqltext import q, values
from .texts import CLEAN, CODE_OF

# one code per part, described by name and type; searched names come from the same table
CODES = f"select {CODE_OF} as code, p_name || ' ' || lower(p_type) as description, p_partkey as seq from part"
CODES_SQL = f"codes as (select code, max_by(description, seq) as description, max(seq) as seq from ({CODES.replace('as string)', 'as varchar)')}) group by code)"
NAMES = "case p_partkey % 4 when 0 then concat(p_name, ' ', lower(p_type)) when 1 then p_name when 2 then concat(substr(p_name, 2), ' without ', lower(p_type)) else concat('HTN, ', p_name) end"
NAMES_SQL = f"names as (select distinct {NAMES} as name from part)"


def codes(spark, sf):
    rows = table(spark, sf, "part").selectExpr(f"{CODE_OF} as code", "concat(p_name, ' ', lower(p_type)) as description", "p_partkey as seq")
    last = rows.groupBy("code").agg(F.max_by("description", "seq").alias("description"), F.max("seq").alias("seq"))
    return last.withColumn("hcc_status", F.lit("Non-HCC"))


def names(spark, sf):
    return table(spark, sf, "part").selectExpr(f"{NAMES} as name").distinct()


SYN = values([(i, t, s) for i, (t, s) in enumerate(sorted(SYNONYMS, key=lambda p: -len(p[0])))], "syn(p, term, syn)")


def variants_sql(source: str) -> str:
    return f"""{SYN}, cl as (select name, {CLEAN.format(x='name')} as c from {source}),
    vr as (select name, c as variant, 0 as o from cl
           union all select name, regexp_replace(c, '\\b' || term || '\\b', syn, 'g'), p * 2 + 1 from cl join syn on regexp_matches(c, '\\b' || term || '\\b')
           union all select name, syn, p * 2 + 2 from cl join syn on regexp_matches(c, '\\b' || term || '\\b')),
    v as (select name, variant, row_number() over (partition by name order by min(o)) - 1 as ord from vr group by 1, 2)"""


@query("synonym_variants", f"with nm as (select distinct disease as name from results), {variants_sql('nm')} select name, cast(ord as bigint) as ord, variant from v")
def synonym_variants(spark, sf):
    nm = results(spark, sf).select(F.col("disease").alias("name")).distinct()
    return mp.with_variants(nm).select("name", F.col("ord").cast("bigint"), "variant")


def format_sql(c: str) -> str:
    return f"case when length({c}) > 3 and strpos({c}, '.') = 0 then left({c}, 3) || '.' || substr({c}, 4) else {c} end"


@query("exact_code_match", f"""
    with {CODES_SQL}, {NAMES_SQL}, {variants_sql('names')}, f as (select lower(description) as d, min_by(code, seq) as code, min_by(description, seq) as description from codes group by 1),
    h as (select name, variant, code, description, row_number() over (partition by name order by ord) as rn from v join f on f.d = variant)
    select name, {format_sql('code')} as icd_code, description, variant as via, cast(1.0 as double) as confidence from h where rn = 1""")
def exact_code_match(spark, sf):
    return mp.exact_match(names(spark, sf), codes(spark, sf))


STOPS = "['the','and','for','with','without','not','from','due','type','stage','grade','unspecified','other','bilateral','left','right','acute','chronic','primary','secondary']"
WORDS = lambda x: f"list_filter(string_split({CLEAN.format(x=x)}, ' '), lambda w: length(w) >= 3 and not list_contains({STOPS}, w))"
PAIRS = f"""{CODES_SQL}, {NAMES_SQL}, {variants_sql('names')},
    tm as (select name, ord * 2 as tier, [variant] as ns from v where variant <> '' union all select name, ord * 2 + 1, {WORDS('variant')} from v where len({WORDS('variant')}) >= 2
           union all select name, 100000 + i - 1, [w] from (select name, unnest(({WORDS('name')})[1:3]) as w, generate_subscripts(({WORDS('name')})[1:3], 1) as i from names) where length(w) >= 4),
    pr as (select name, code, min(tier) as tier, any_value(description) as description, min(seq) as seq
           from tm, codes where len(list_filter(ns, lambda s: not contains(lower(description), s))) = 0 group by name, code)"""


@query("code_candidates", f"with {PAIRS} select name, code, cast(tier as bigint) as tier, description, seq from pr")
def code_candidates(spark, sf):
    return mp.candidates(names(spark, sf), codes(spark, sf)).select("name", "code", (F.col("tier.kind") * 100000 + F.col("tier.at")).cast("bigint").alias("tier"), "description", "seq")


NUM = " or ".join(f"(regexp_extract({{a}}, '{p}(\\w+)', 1) <> '' and regexp_extract({{b}}, '{p}(\\w+)', 1) <> '' and regexp_extract({{a}}, '{p}(\\w+)', 1) <> regexp_extract({{b}}, '{p}(\\w+)', 1))" for p in ("type ", "stage ", "grade ", "class "))
OPP = " or ".join(f"(contains({{a}}, '{t}') and regexp_matches({{b}}, '\\b{o}'))" for t, o in CONTRADICTIONS)
PEN = f"(case when {NUM} then 30 else 0 end + case when {OPP} then 25 else 0 end)"


@query("contradiction_penalty", f"""
    with n as (select distinct doc_id, lower(disease) as a from results), p as (select doc_id, a, lead(a) over (partition by doc_id order by a) as b from n),
    x as (select a, b, count(*) as n from p where b is not null group by 1, 2)
    select a, b, n, cast({PEN.format(a='a', b='b')} as double) as penalty from x""")
def contradiction_penalty(spark, sf):
    from pyspark.sql import Window

    n = results(spark, sf).select("doc_id", F.lower("disease").alias("a")).distinct()
    p = n.withColumn("b", F.lead("a").over(Window.partitionBy("doc_id").orderBy("a"))).where("b is not null")
    return p.groupBy("a", "b").agg(F.count("*").alias("n")).withColumn("penalty", mp.contradiction(F.col("a"), F.col("b")))


@query("candidate_score")
def candidate_score(spark, sf):
    s = mp.score(mp.candidates(names(spark, sf), codes(spark, sf)))
    return s.select("name", "code", F.bround("score", 4).alias("score"))


@query("token_set_ratio")
def token_set_ratio(spark, sf):
    from ..functions import similarity as sim

    pairs = mp.candidates(names(spark, sf), codes(spark, sf))
    return pairs.select("name", "code", sim.token_set_ratio(F.lower("name"), F.lower("description")).cast("bigint").alias("score"))


@query("top_k_codes")
def top_k_codes(spark, sf):
    return mp.top_codes(mp.score(mp.candidates(names(spark, sf), codes(spark, sf))), k=5)


@query("search_combined")
def search_combined(spark, sf):
    return mp.search_combined(names(spark, sf), codes(spark, sf))


@query("assign_code")
def assign_code(spark, sf):
    return mp.assign_codes(mp.search_combined(names(spark, sf), codes(spark, sf)), codes(spark, sf))


# the dictionary of the result rows: one row per code
RCODES = "rc as (select icd_code as code, min(disease) as description, min(ord) as seq from results where icd_code not in ('', '—') and negated group by icd_code)"


def result_codes(spark, sf):
    r = results(spark, sf).where("icd_code not in ('', '—') and negated")
    return r.groupBy(F.col("icd_code").alias("code")).agg(F.min("disease").alias("description"), F.min("ord").alias("seq")).withColumn("hcc_status", F.lit("Non-HCC"))


@query("lookup_by_code", f"""
    with {RCODES}, b as (select replace(upper(trim(code)), '.', '') as bare, min_by(description, seq) as icd_description from rc group by 1)
    select doc_id, ord, icd_code, icd_description from results left join b on bare = replace(upper(trim(icd_code)), '.', '')""")
def lookup_by_code(spark, sf):
    return mp.lookup_by_code(results(spark, sf).select("doc_id", "ord", "icd_code"), result_codes(spark, sf))


TESTED = "case ord % 5 when 0 then replace(icd_code, '.', '') when 1 then icd_code when 2 then concat(left(icd_code, 3), '.99') when 3 then concat('X', icd_code) else lower(icd_code) end"


@query("validate_code", f"""
    with {RCODES}, t as (select doc_id, ord, {TESTED} as icd_code from results), u as (select *, upper(trim(icd_code)) as c from t),
    r as (select *, case when c in ('', '—', '-') then 'placeholder' when not regexp_matches(c, '^[A-Z][0-9]{{2}}(?:\\.[A-Z0-9]{{1,5}})?$') then 'format'
        when c in (select upper(trim(code)) from rc) then 'exact' when replace(c, '.', '') in (select replace(upper(trim(code)), '.', '') from rc) then 'dot_normalized'
        when left(c, 3) in (select left(upper(trim(code)), 3) from rc) then 'category' else 'unknown' end as reason from u)
    select doc_id, ord, icd_code, reason, reason in ('exact', 'dot_normalized', 'category') as valid from r""")
def validate_code(spark, sf):
    rows = results(spark, sf).selectExpr("doc_id", "ord", f"{TESTED} as icd_code")
    return mp.validate_codes(rows, result_codes(spark, sf)).select("doc_id", "ord", "icd_code", "reason", "valid")


@query("reject_invalid_codes", f"""
    with {RCODES}, t as (select doc_id, ord, {TESTED} as icd_code from results), u as (select *, upper(trim(icd_code)) as c from t),
    r as (select *, regexp_matches(c, '^[A-Z][0-9]{{2}}(?:\\.[A-Z0-9]{{1,5}})?$') and left(c, 3) in (select left(upper(trim(code)), 3) from rc) as ok from u)
    select doc_id, ord, case when ok then icd_code end as icd_code, case when ok then 'mapped' else 'not_found' end as status from r""")
def reject_invalid_codes(spark, sf):
    rows = results(spark, sf).selectExpr("doc_id", "ord", f"{TESTED} as icd_code")
    v = mp.validate_codes(rows, result_codes(spark, sf))
    return v.select("doc_id", "ord", F.when(F.col("valid"), F.col("icd_code")).alias("icd_code"), F.when(F.col("valid"), "mapped").otherwise("not_found").alias("status"))


@query("cross_validate")
def cross_validate(spark, sf):
    pairs = results(spark, sf).groupBy("disease", "icd_code").agg(F.count("*").alias("n"))
    return mp.cross_validate(pairs, result_codes(spark, sf)).select("disease", "icd_code", "n", "match_score", "match")


RANKED = "select disease as name, icd_code, (ord % 7 + 1) as model_rank, cast(ord % 11 as double) / 10 as model_score, icd_confidence as confidence, ord from results where icd_code not in ('', '—')"


@query("rank_blend", f"""
    with r as (select name, icd_code, min_by(model_rank, ord) as model_rank, min_by(model_score, ord) as model_score, min_by(confidence, ord) as confidence from ({RANKED}) group by 1, 2),
    b as (select name, icd_code, model_rank, cast(round_even(model_score * 0.7::double + confidence * 0.3::double, 3) as double) as confidence from r)
    select name, icd_code, confidence, row_number() over (partition by name order by model_rank, confidence desc, icd_code) as place from b""")
def rank_blend(spark, sf):
    r = results(spark, sf).where("icd_code not in ('', '—')").selectExpr(
        "disease as name", "icd_code", "ord % 7 + 1 as model_rank", "cast(ord % 11 as double) / 10 as model_score", "icd_confidence as confidence", "ord")
    g = r.groupBy("name", "icd_code").agg(*[F.min_by(c, "ord").alias(c) for c in ("model_rank", "model_score", "confidence")])
    out = mp.rank_blend(g.select("name", "icd_code", "confidence"), g.select("name", "icd_code", "model_rank", "model_score"))
    return out.select("name", "icd_code", "confidence", "place")
