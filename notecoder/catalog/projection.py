"""Clinical notes and result rows derived from the given tables.

Each projection is one SQL text that Spark and the checking engine both read, so the
inputs of every query are the same on both sides. Notes are one per order and result rows
one per line item: plain projections, without a shuffle, that grow with the tables.
"""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession



def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(rows: DataFrame, key: str) -> DataFrame:
    """Short source columns dealt over all cores before long texts are made of them.

    A file of one row group is read by one task, which would then do all the work on the texts.
    The number is given, so that the adaptive planner does not join the small partitions again.
    """
    return rows.repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), key)


def pick(options: list[str], index: str) -> str:
    """SQL for the option at ``index`` modulo the number of options."""
    return f"split_part('{'|'.join(options)}', '|', cast(({index}) % {len(options)} + 1 as int))"


TERMS = [
    "Type 2 Diabetes Mellitus", "Essential hypertension", "HTN",
    "Chronic kidney disease stage 3", "CKD 3", "Hyperlipidemia",
    "Major depression/moderate/recurrent", "Left knee osteoarthritis", "Right leg pain",
    "COPD", "Acute on chronic respiratory failure", "Asthma", "Hypothyroidism", "GERD",
    "Atrial fibrillation", "Pneumonia", "Cough", "Chest pain", "Iron deficiency anemia",
    "Peripheral neuropathy", "Obesity", "History of breast cancer", "Heart failure", "CHF",
    "Rheumatoid arthritis", "Urinary tract infection", "UTI", "Osteoporosis",
    "Anxiety disorder", "Migraine", "Metformin", "Elevated A1c",
    "Possible pulmonary embolism", "Diabetic retinopathy", "Hypertension", "Diabetes",
]
ACTIONS = [
    "stable on current dose, recheck labs in 3 months", "continue lisinopril 10 mg daily",
    "no evidence of progression", "worsening, increase dose and refer to cardiology",
    "HbA1c 8.1, continue metformin 500 mg bid", "counsel on diet and exercise",
    "denies symptoms", "resolved", "monitor creatinine and GFR", "well controlled",
    "x-ray showed mild degenerative change", "ruled out", "stage 3, unchanged",
    "history of flare, on meds", "started on sertraline 50 mg daily", "follow up in 6 weeks",
]
DRUGS = [
    "metformin 500 mg bid", "lisinopril 10 mg daily", "atorvastatin 20 mg at bedtime",
    "levothyroxine 75 mcg daily", "omeprazole 20 mg daily", "sertraline 50 mg daily",
    "gabapentin 300 mg tid", "albuterol inhaler prn", "warfarin 5 mg daily",
    "furosemide 40 mg daily", "alendronate 70 mg weekly", "insulin glargine 10 units",
]
SYMPTOMS = [
    "cough and fever", "chest pain with exertion", "left knee pain", "fatigue",
    "shortness of breath", "dysuria", "headache", "leg swelling",
]
K, C = "o_orderkey", "o_custkey"
P = "cast(floor(o_totalprice) as bigint)"
NL = "chr(10)"


def _note_parts() -> list[str]:
    t = lambda expr: pick(TERMS, expr)
    a = lambda expr: pick(ACTIONS, expr)
    d = lambda expr: pick(DRUGS, expr)
    s = lambda expr: pick(SYMPTOMS, expr)
    date = lambda expr: f"concat('0', cast(({expr}) % 9 + 1 as string), '/1', cast(({expr}) % 10 as string), '/202', cast(({expr}) % 5 as string))"
    when = lambda cond, text: f"case when {cond} then {text} else '' end"
    return [
        when(f"{K} % 4 = 0", f"concat('Page ', cast({K} % 7 + 1 as string), ' of 9', {NL})"),
        when(f"{K} % 5 = 0", f"concat('Printed on: 05/22/2024 by front desk', {NL})"),
        pick(["CHIEF COMPLAINT", "Chief Complaint:", "[Chief Complaint]", "Reason for Visit:"], K), NL,
        "'Patient presents with '", s(C), "'.'", NL, NL,
        pick(["[History of Present Illness]", "HPI:", "History of Present Ilness:", "Subjective:"], C), NL,
        "'Patient with history of '", t(f"{K} * 7 + {C}"), "' and '", t(f"{C} + 3"), "'. '",
        pick(["No evidence of infection", "Patient denies fever", "Pt reports SOB and uses   oxygen", "Symptoms worsening since last visit"], P),
        "'. '", "'BMI '", f"cast({P} % 28 + 19 as string)", "'.'", f"cast({C} % 10 as string)", "' today. '",
        pick(["RA dilated on heart echo", "MS flare last year", "PE noted on exam", "RA of both hands", "CP for two days", "systolic murmur and MS"], f"{K} + {C}"),
        "'.'", NL, NL,
        pick(["Past Medical History:", "PMH:", "PAST MEDICAL HISTORY", "Past Med Hx:"], f"{K} + 1"), NL,
        "'• '", t(f"{K} + 5"), "' Active '", date(K), NL,
        "'• '", t(f"{C} * 3 + 1"), "' Active '", date(C), NL,
        when(f"{K} % 3 = 0", f"concat('- ', {t(f'{P} + 2')}, {NL})"),
        when(f"{K} % 6 = 1", f"concat('• ', {t(f'{P}')}, ' • ', {t(f'{P} + 9')}, {NL})"),
        NL,
        pick(["=== Medications ===", "Current Medications:", "Medication List", "MEDICATIONS"], P), NL,
        d(K), NL, d(f"{C} + 4"), NL,
        when(f"{K} % 8 = 3", f"concat('(?) unknown tablet #', {NL})"),
        NL,
        "'Vitals: BP 1'", f"cast({C} % 6 + 2 as string)", "'0/80, HR 7'", f"cast({K} % 10 as string)", NL, NL,
        when(f"{K} % 2 = 0", f"concat('Social Hx ; 05/22/2024 10:30 AM)', {NL}, 'never smoker, occa-', {NL}, 'sional alcohol', {NL}, {NL})"),
        when(f"{K} % 9 = 4", f"concat('Allergies:', {NL}, 'Family History:', {NL}, 'mother with ', {t(f'{K}')}, {NL}, {NL})"),
        when(f"{K} % 10 = 7", f"concat('notes', {NL}, 'Date: 05/05/2024', {NL}, 'II. Review of Systems', {NL}, 'negative for chest pain', {NL}, {NL})"),
        pick(["ASSESSMENT AND PLAN", "Assessment and Plan:", "[Assessment/Plan]", "Assessment:"], f"{C} + 2"), NL,
        "'1. '", t(K), "': '", a(C), NL,
        "'2. '", t(f"{C} + 11"), "', '", t(f"{P} + 4"), "': '", a(f"{K} + 1"), NL,
        when(f"{K} % 3 <> 1", f"concat('3. ', {t(f'{P}')}, ': ', {a(f'{P}')}, {NL})"),
        when(f"{K} % 7 = 2", f"concat('4. Continue ', {d(f'{P}')}, {NL})"),
        when(f"{K} % 5 = 1", f"concat('Patient is a candi-', {NL}, 'date for therapy with no', {NL}, 'further delay', {NL})"),
        NL,
        pick(["Follow up: in 3 months", "Plan of Care:", "follow up in 6 weeks", "Electronic Health Record copy"], f"{K} + {P}"),
        when(f"{K} % 4 = 1", f"concat({NL}, 'Seen 10/25/2023 10:30 AM by * staff')"),
    ]


NOTE_TEXT = "concat(" + ", ".join(_note_parts()) + ")"
NOTES_SQL = f"select {K} as doc_id, {NOTE_TEXT} as text from orders"


def notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One clinical note per order: ``doc_id, text``."""
    rows = spread(table(spark, sf_dir, "orders").select(K, C, "o_totalprice"), K)
    return rows.selectExpr(f"{K} as doc_id", f"{NOTE_TEXT} as text")


def duck(sql: str) -> str:
    """The same projection for the checking engine (its text type is spelled varchar)."""
    return sql.replace(" as string)", " as varchar)")


# --- result rows: one per line item ------------------------------------------------
CODES = [
    ("Type 2 Diabetes Mellitus", "E11.9"), ("Essential hypertension", "I10"), ("HTN", "I10"),
    ("Chronic kidney disease stage 3", "N18.30"), ("CKD 3", "N18"), ("Hyperlipidemia", "E78.5"),
    ("Major depression/moderate/recurrent", "F33.1"), ("Left knee osteoarthritis", "M17.12"),
    ("Right leg pain", "M79.604"), ("COPD", "J44.9"), ("Acute on chronic respiratory failure", "J96.00"),
    ("Asthma", "J45.909"), ("Hypothyroidism", "E03.9"), ("GERD", "K21.9"), ("Atrial fibrillation", "I48.91"),
    ("Pneumonia", "J18.9"), ("Cough", "R05"), ("Chest pain", "R07.9"), ("Iron deficiency anemia", "D50.9"),
    ("Peripheral neuropathy", "G62.9"), ("Obesity", "E66.9"), ("History of breast cancer", "Z85.3"),
    ("Heart failure", "I50.9"), ("CHF", ""), ("Rheumatoid arthritis", "M06.9"),
    ("Urinary tract infection", "N39.0"), ("UTI", ""), ("Osteoporosis", "M81.0"),
    ("Anxiety disorder", "F41.9"), ("Migraine", "G43"), ("Metformin", ""), ("Elevated A1c", "R73.09"),
    ("Possible pulmonary embolism", "I26.99"), ("Diabetic retinopathy", "E11.319"),
    ("Hypertension, stable on meds", "I10"), ("Diabetes", "E11"), ("Type 1 diabetes", "E10.9"),
    ("Depression", "F32.9"), ("Stable angina", "—"), ("Migraine with aura", "G43.109"),
    ("BMI 31.4", "Z68.35"), ("stable on meds", "R69"),
]
SOURCES = [
    "assessment_and_plan", "past_medical_history", "medications", "history_present_illness",
    "assessment", "family_history", "past_medical_history,assessment", "social_history",
    "plan,medications", "problem_list", "chief_complaint", "imaging",
]
MONITOR = ["", "recheck labs in 3 months", "", "blood pressure monitored at home", "stable, follow up in 6 weeks"]
EVALUATE = ["", "HbA1c 8.1 measured today", "see plan", "", "creatinine 1.4 noted", "ECG showed no acute change", "lipid panel ordered"]
ASSESS = ["", "active today", "history of this condition", "possible, rule out next visit", "no evidence of disease", "left side worse than right", "listed in assessment", "denies symptoms", "elevated blood pressure reading"]
TREAT = ["", "continue lisinopril 10 mg daily", "", "increase dose", "on home meds only", "refill"]
L, LP, LS, LQ = "l_orderkey", "l_partkey", "l_suppkey", "cast(l_quantity as bigint)"

RESULT_COLUMNS = [
    ("doc_id", L),
    ("ord", f"((cast(l_linenumber as bigint) * 1000000000 + {LP}) * 1000000 + {LS}) * 100 + {LQ}"),
    ("disease", pick([n for n, _ in CODES], f"{LP} + {LS}")),
    ("icd_code", pick([c for _, c in CODES], f"{LP} + {LS}")),
    ("sources", pick(SOURCES, f"{LS} + {LQ}")),
    ("monitoring_evidence", pick(MONITOR, LP)),
    ("evaluation_evidence", pick(EVALUATE, LS)),
    ("assessment_evidence", pick(ASSESS, f"{LP} * 3 + {LQ}")),
    ("treatment_evidence", pick(TREAT, f"{LP} + {LQ}")),
    ("icd_confidence", f"cast(({LP} * 7 + {LS}) % 101 as double) / 100"),
    ("negated", f"({LP} + {LQ}) % 11 = 0"),
]
RESULTS_SQL = "select " + ", ".join(f"{e} as {n}" for n, e in RESULT_COLUMNS) + " from lineitem"


def results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Result rows, one per line item, with ``sources`` and evidence texts."""
    rows = table(spark, sf_dir, "lineitem").select(L, LP, LS, "l_linenumber", "l_quantity")
    return rows.selectExpr(*[f"{e} as {n}" for n, e in RESULT_COLUMNS])
