"""Section vocabulary: canonical names, header variants and header tests."""
from . import words, pairs

# Canonical section = header variants, in matching order.
SECTION_VARIANTS = [(name, words(variants)) for name, variants in pairs("""
chief_complaint = chief complaint, cc, complaint, presenting problem, presenting complaint, reason for visit, reason for encounter, exam reason, chief complaints
history_present_illness = history of present illness, hpi, present illness, history present illness, subjective, hx present illness, hx of present illness, interval history
past_medical_history = past medical history, pmh, medical history, active problems, problem list, active problem list, past med hx, past medical hx, significant history, significant past history
past_surgical_history = past surgical history, psh, surgical history, past surg hx, prior surgeries, previous surgeries
medications = medications, medication, meds, current medications, active medications, medication list, rx, current meds, home medications, outpatient medications, med list, medication reconciliation
allergies = allergies, allergy, allergy list, drug allergies, allergic reactions, medication allergies, nkda, known allergies
social_history = social history, sh, social hx, social
family_history = family history, fh, fam hx, family hx, family medical history
review_of_systems = review of systems, ros, systems review, review of system, general adult ros, system review
vitals = vitals, vital signs, vs, vital sign
physical_exam = physical exam, physical examination, pe, exam, examination, objective exam, phys exam
objective = objective
immunizations = immunizations, immunization, immunisation, immunisations, vaccines, vaccination, vaccinations, immunization history, vaccine history, immunization record
lab_results = lab results, labs, laboratory, laboratory results, test results, lab values, lab data, diagnostic results, lab result
imaging = imaging, imaging results, radiology, x-ray, xray, diagnostic imaging, radiological findings
assessment = assessment, impression, dx, diagnoses, diagnosis, clinical impression, assessment note
plan = plan, treatment plan, tx, treatment, recommendations, plan of care, care plan, management plan
assessment_and_plan = assessment and plan, assessment & plan, a/p, a&p, assessment/plan, assessment plan, a and p, impression and plan, impression & plan, impression and recommendations
follow_up = follow up, f/u, followup, follow-up, return visit, follow up plan, disposition
""")]

VARIANT_ROWS = [
    (i, variant, name)
    for i, (variant, name) in enumerate((v, n) for n, vs in SECTION_VARIANTS for v in vs)
]

# Labels that never name a section.
NOT_SECTION_LABELS = words("""
diagnosis date, date, description, status, code, comments, onset date, resolved date,
priority, severity, provider, location, type, note, value, result, range, units,
reference range, flag, category, name, dose, frequency, route, start date, end date, sig,
quantity, refills, pharmacy, prescriber, diagnosis code, icd code, icd 10, cpt code,
procedure date, patient educational handouts, medical equipment, advance directives,
functional status, none recorded, no information available, unknown, reminders, orders,
dme orders
""")

# Table column labels rejected as header candidates.
COLUMN_LABELS = words("""
diagnosis date, date, description, status, code, comments, onset date, resolved date,
priority, severity, provider, location, type, note, notes, value, result, range, units,
reference range, flag, category, name, dose, frequency, route, start date, end date, sig,
quantity, refills, pharmacy, prescriber, diagnosis code, icd code, icd-10, cpt code
""")

# Words without section meaning; endings cut by the stemmer.
HEADER_STOP_WORDS = words("""
the, a, an, of, and, &, or, in, for, to, is, are, was, were, on, at, by, with, from,
note, notes, section, report, current, active, patient, clinical, general
""")
STEM_SUFFIXES = words("""
ations, ation, tions, tion, sions, sion, ments, ment, ings, ing, ness, ous, ive, al, ly
""")
STEM_ENDINGS = [("ies", 3), ("es", 3), ("s", 3), ("ed", 3), ("y", 4)]

# Base score of each header pattern.
HEADER_BASE_SCORES = [
    ("bracketed", 0.90), ("colon_block", 0.85), ("ehr_timestamp", 0.90), ("allcaps", 0.75),
    ("colon_inline", 0.65), ("numbered", 0.70), ("decorated", 0.80), ("standalone", 0.55),
]
FRAGMENT_STARTS = words("""
the, a, an, is, are, was, this, that, it, he, she, we, they, no, not
""")
INLINE_REJECT_STARTS = words("no, not, the, a, an, there")

# Sections whose text never yields diagnoses.
NON_DISEASE_SECTIONS = words("""
medications, allergies, immunizations, vitals, social_history, family_history, imaging,
lab_results, past_surgical_history
""")
ASSESSMENT_FAMILY = words("""
assessment_and_plan, assessment, active_problems, active_problem_list, problem_list
""")

# Header text = section, for validation without a model; a name of three or
# more characters also matches inside a longer header, first entry first.
HEADER_MAP = [(h, s) for s, hs in pairs("""
chief_complaint = chief complaint, cc, reason for visit, reason for encounter, exam reason
history_present_illness = history of present illness, hpi, present illness, history present illness, subjective
past_medical_history = past medical history, pmh, medical history, active problems, problem list, active problem list
past_surgical_history = past surgical history, psh, surgical history
medications = medications, meds, current medications, active medications, medication list
allergies = allergies, allergy list, drug allergies
social_history = social history, sh
family_history = family history, fh
review_of_systems = review of systems, ros
vitals = vitals, vital signs, vs
physical_exam = physical exam, physical examination, pe, exam
objective = objective
immunizations = immunizations, vaccines, immunization history
lab_results = lab results, labs, laboratory, laboratory results
imaging = imaging, imaging results, radiology
assessment = assessment, impression, dx, diagnoses, diagnosis
plan = plan, treatment plan, tx
assessment_and_plan = assessment and plan, assessment & plan, a/p, a&p
follow_up = follow up, f/u, followup, follow-up, return visit
""") for h in words(hs)]

# Subsection names, qualifiers and labels that are not sections.
SUBSECTION_NAMES = words("""
heart, lungs, cardiovascular, respiratory, heent, abdomen, musculoskeletal, neurological,
psychiatric, constitutional, skin, eyes, ent, gastrointestinal, genitourinary, extremities,
head, neck, chest, back, rectal, breast, lymph, vascular, integumentary, endocrine,
hematologic, immunologic, general, appearance, general adult ros
""")
NOISE_HEADERS = words("""
uncomplicated, complicated, unspecified, bilateral, unilateral, benign, malignant,
metastatic, recurrent, resolved, controlled, uncontrolled, stable, unstable, progressive,
intermittent, persistent, transient, moderate, mild, severe, primary, secondary, essential,
idiopathic, hereditary, congenital, acquired, chronic, subacute, initial, subsequent,
routine, normal, abnormal, positive, negative, patient educational handouts,
medical equipment, advance directives, functional status, unknown, none recorded,
no information available
""")
REJECTED_HEADERS = COLUMN_LABELS + words("""
procedure date, patient educational handouts, medical equipment, advance directives,
functional status, none recorded, no information available, unknown, reminders, orders,
dme orders, implant orders, reminders provider, mental status, question answer notes
""")

# Sections that state the assessment.
ASSESSMENT_KEYS = ["assessment_and_plan", "assessment", "active_problems", "active_problem_list", "problem_list"]
