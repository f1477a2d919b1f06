"""Tables of the coding rules."""
from . import pairs, words

# Diagnosis pattern = symptoms it explains.
SUBSUMED = [(p, words(s)) for p, s in pairs(r"""
pneumonia = cough, fever, dyspnea, shortness of breath, chest pain, tachypnea, pleuritic pain
urinary\s+tract\s+infection|uti = dysuria, frequency, urgency, hematuria, suprapubic pain, fever
myocardial\s+infarction|mi|heart\s+attack = chest pain, diaphoresis, nausea, jaw pain, arm pain
congestive\s+heart\s+failure|chf|heart\s+failure = dyspnea, shortness of breath, edema, peripheral edema, orthopnea, paroxysmal nocturnal dyspnea
migraine = headache, nausea, photophobia, phonophobia, aura
appendicitis = abdominal pain, nausea, vomiting, fever, rlq pain
cholecystitis = abdominal pain, ruq pain, nausea, vomiting, fever
acute\s+bronchitis|bronchitis = cough, sore throat, chest congestion
influenza|flu = fever, cough, myalgia, fatigue, headache, sore throat
strep\s+pharyngitis|pharyngitis|strep\s+throat = sore throat, odynophagia, fever
gastroenteritis = nausea, vomiting, diarrhea, abdominal pain, abdominal cramps
copd|chronic\s+obstructive\s+pulmonary\s+disease = dyspnea, shortness of breath, wheezing, cough
asthma = wheezing, cough, dyspnea, shortness of breath, chest tightness
dvt|deep\s+vein\s+thrombosis = leg swelling, leg pain, calf pain, edema
pulmonary\s+embolism|pe = dyspnea, shortness of breath, chest pain, tachycardia, hemoptysis
cellulitis = erythema, swelling, warmth, pain, fever
pancreatitis = abdominal pain, epigastric pain, nausea, vomiting
meningitis = headache, fever, neck stiffness, photophobia, nausea
diverticulitis = abdominal pain, llq pain, fever, nausea
""")]

# Categories of chronic conditions.
CHRONIC_CATEGORIES = words("""
E08, E09, E10, E11, E13, I10, I11, I12, I13, I25, I50, J44, N18, K21, M05, M06, G35, E03,
E05, E78, G47, J45, F32, F33, F41, N40, G43, M15, M16, M17, M18, M19
""")

# Two name patterns, combination code, description.
COMBINATIONS = [
    ("diabetes", "neuropathy", "E11.40", "Type 2 diabetes mellitus with diabetic neuropathy, unspecified"),
    ("diabetes", r"nephropathy|kidney\s+disease", "E11.22", "Type 2 diabetes mellitus with diabetic chronic kidney disease"),
    ("diabetes", "retinopathy", "E11.319", "Type 2 diabetes mellitus with unspecified diabetic retinopathy without macular edema"),
    ("diabetes", r"peripheral\s+(?:vascular|angiopathy)", "E11.51", "Type 2 diabetes mellitus with diabetic peripheral angiopathy without gangrene"),
    ("hypertension|htn", r"(?:chronic\s+)?kidney\s+disease|ckd", "I12.9", "Hypertensive chronic kidney disease with stage 1-4 or unspecified CKD"),
    ("hypertension|htn", r"heart\s+(?:failure|disease)|chf", "I11.0", "Hypertensive heart disease with heart failure"),
]
EXCLUDES = [("E11", "E10"), ("I10", "I15"), ("J45", "J44"), ("F32", "F33")]

# Drug names rejected as diagnoses.
DRUG_MARKERS = words("""
metformin, lisinopril, atorvastatin, omeprazole, amlodipine, losartan, metoprolol,
gabapentin, levothyroxine, acetaminophen, ibuprofen, aspirin, warfarin, insulin, albuterol,
prednisone, amoxicillin, azithromycin, furosemide, hydrochlorothiazide, pantoprazole,
sertraline, fluoxetine, citalopram, duloxetine, tramadol, oxycodone, hydrocodone, morphine,
fentanyl, rosuvastatin, simvastatin, pravastatin, carvedilol, digoxin, spironolactone,
clopidogrel, apixaban, rivaroxaban, enoxaparin
""")

# Wording patterns.
SUSPECTED = (
    r"(?i)\b(?:rule\s*out|r/o|ruled\s*out|possible|probable|suspected|likely|differential|"
    r"questionable|uncertain|cannot\s+exclude|to\s+be\s+determined|pending\s+workup|presumed)\b"
)
LAB_NAME = (
    r"(?i)\b(?:elevated\s|low\s|high\s|abnormal\s|positive\s|negative\s)?"
    r"(?:a1c|hba1c|hemoglobin\s*a1c|creatinine|bun|gfr|egfr|wbc|rbc|platelet|troponin|bnp|inr|"
    r"ptt|pt\b|alt|ast|alkaline\s*phosphatase|bilirubin|albumin|sodium|potassium|chloride|"
    r"calcium|tsh|t3|t4|ldl|hdl|triglyceride|glucose|fasting\s*glucose|psa|esr|crp|hemoglobin|"
    r"hematocrit|ferritin|iron|vitamin\s*d|b12)\b"
    r"(?:\s*(?:level|value|result|of|at|is|was|=|:)\s*[\d.]+)?"
)
NEGATED = (
    r"(?i)\b(?:no\s+(?:history\s+of|evidence\s+of|signs?\s+of|diagnosis\s+of)|denies|without|"
    r"negative\s+for|ruled\s+out|not\s+(?:found|identified|present|seen)|absence\s+of|free\s+of)\b"
)
SIDE = r"(?i)\b(right|left|bilateral|unilateral|rt|lt|r/l|l/r)\b"
SIDE_NAMES = {"rt": "right", "lt": "left", "r/l": "right/left", "l/r": "left/right"}
ELEVATED_PRESSURE = (
    r"(?i)(?:elevated\s+(?:blood\s+)?(?:pressure|bp)|without\s+diagnosis\s+of\s+hypertension|"
    r"white\s*coat\s+(?:hypertension|effect|syndrome)|high\s+(?:blood\s+)?(?:pressure|bp)\s+reading)"
)
BMI_VALUE = r"(?i)\bbmi\b[^0-9]{0,8}([0-9]{2}(?:\.[0-9]+)?)"
HISTORY_NAME = r"(?i)(?:^|\b)(?:history\s+of|h/o|h\.o\.|hx\s+of|past\s+h/o|past\s+history\s+of)\b"
MANAGEMENT = (
    r"(?i)\b(?:start|started|initiat|prescrib|adjust|increase|decrease|taper|stop|discontinu|hold|"
    r"order|follow\s*up|f/?u|monitor|recheck|refer|discuss|counsel|reviewed|evaluat|treat|therapy|"
    r"plan|continu|maintain(?:ing)?|ongoing|manag|titrat|optimiz|uptitrat|wound\s*care|dress|"
    r"care\s*of|oxygen|wean|transfus|catheter|ventilat|dialys|infus|irrigat|suction|antibiotic|"
    r"analges|sedat|nutrition|supplement|replet)\b"
)
MAINTENANCE_ONLY = r"(?i)\b(?:on\s+home\s+meds?\s+only|med\s+list\s+reviewed\s+only)\b"

# Section ranks, tiers and scores.
SECTION_RANK = {
    "assessment_and_plan": 1, "assessment": 1, "chief_complaint": 2, "cc": 2,
    "history_present_illness": 3, "hpi": 3, "active_problems": 1, "active_problem_list": 1,
    "problem_list": 1, "plan": 4, "impression": 4, "past_medical_history": 6, "pmh": 6,
    "medical_history": 6,
}
TIER_SCORES = {
    "strong_evidence": 1.0, "moderate_evidence": 0.75, "agent2_recall": 0.55,
    "weak_evidence": 0.4, "no_meat": 0.0,
}
TIER_RANK = {"strong_evidence": 0, "moderate_evidence": 1, "weak_evidence": 2}

# Section sets of the section-priority filter.
ASSESSMENT_SECTIONS = words("assessment, assessment_and_plan, active_problems")
VISIT_ASSESSMENT = words("assessment, assessment_and_plan")
SECONDARY_SECTIONS = words("""
impression, plan, orders, order, diagnosis, working_diagnoses, final_diagnoses
""")
SOLE_SECTIONS = words("""
problem_list, active_problem_list, past_medical_history, pmh, medical_history,
surgical_history, past_surgical_history, family_history, fh, screening, social_history
""")
PRIMARY_SECTIONS = ASSESSMENT_SECTIONS + words("""
chief_complaint, cc, history_present_illness, hpi, past_medical_history, pmh,
medical_history, plan, impression, physical_exam, pe, objective
""")
CLINICAL_SECTIONS = PRIMARY_SECTIONS + words("""
medications, current_medications, review_of_systems, ros
""")
EVIDENCE_SECTIONS = words("""
medications, current_medications, vital_signs, vitals, physical_exam, pe, labs, imaging, procedures
""")
FOCUS_SECTIONS = words("chief_complaint, cc, history_present_illness, hpi")
GRACE_SECTIONS = words("""
history_present_illness, plan, chief_complaint, physical_exam, review_of_systems, objective,
past_medical_history, pmh, medical_history, medications, current_medications, hpi, cc
""")
FAMILY_SECTIONS = words("family_history, fh, screening")

# Section sets, words for cancers and code prefix of their history for the strict filter.
STRICT_ASSESSMENT = ASSESSMENT_SECTIONS + words("active_problem_list, problem_list")
STRICT_PRIMARY = PRIMARY_SECTIONS + words("active_problem_list, problem_list")
STRICT_CLINICAL = STRICT_PRIMARY + words("medications, current_medications, review_of_systems, ros")
RESTRICTED_SECTIONS = words("family_history, fh, screening, social_history")
CANCER = r"(?i)\b(?:neoplasm|malignant|cancer|carcinoma|melanoma|lymphoma|sarcoma|leukemia|myeloma|oncolog)\b"
CANCER_HISTORY_CODE = "Z85"
EXCLUDED_TIERS = words("history_only, invalid")

# BMI bands; one below 20, one per whole unit from 20 to below 40, then five.
BMI_BANDS = [(0, 20, "Z68.1")] + [(lo, lo + 1, f"Z68.{lo}") for lo in range(20, 40)] + [
    (40, 45, "Z68.41"), (45, 50, "Z68.42"), (50, 60, "Z68.43"), (60, 70, "Z68.44"), (70, 1000, "Z68.45")]
