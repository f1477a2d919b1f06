"""Families of lines that make up a block, and short forms in headers."""
from __future__ import annotations

#: Fixed values: (family, most lines between two hits, least hits, pattern) in order.
BLOCK_FAMILIES = [
    ("medications", 3, 2,
     r"(?i)[a-z]+(?:\s+[a-z]+){0,3}\s*(?:\([^)]{1,30}\))?\s+\d+(?:\.\d+)?\s*(?:mg|mcg|µg|ml|mL|units?|tabs?|tablets?|caps?|capsules?|"
     r"cream|ointment|solution|injection|patch|spray|drops?|suppository|inhaler|pen|vial|gm?|%)\b"),
    ("vitals", 3, 1,
     r"(?i)(?:\b(?:BP|Blood\s*Pressure)\s*:?\s*\d{2,3}\s*/\s*\d{2,3}|\b(?:HR|Heart\s*Rate|Pulse)\s*:?\s*\d{2,3}\b|"
     r"\b(?:Temp|Temperature)\s*:?\s*\d{2,3}(?:\.\d{1,2})?\s*(?:°?\s*[FCfc])?|\b(?:SpO2|O2\s*Sat|Oxygen\s*Sat)\s*:?\s*\d{2,3}\s*%?|\b(?:RR|Resp(?:iratory)?\s*Rate)\s*:?\s*\d{1,2}\b|"
     r"\b(?:Wt|Weight)\s*:?\s*\d{2,4}(?:\.\d+)?\s*(?:kg|lbs?|pounds?)?|\b(?:Ht|Height)\s*:?\s*\d[''′]?\s*\d{1,2}[\"″]?|\bBMI\s*:?\s*\d{2}(?:\.\d+)?)"),
    ("assessment", 4, 1, r"(?m)^\s*\d{1,2}\.\s+[A-Z][a-zA-Z\s,\-()]{3,}"),
    ("physical_exam", 3, 2,
     r"(?i)\b(?:HEENT|Head|Eyes?|Ears?|Nose|Throat|Neck|Lungs?|Chest|Heart|Cardiac|Cardiovascular|Abdomen|Abdominal|Extremities|Neuro(?:logical)?|Skin|Integumentary|"
     r"Musculoskeletal|MSK|Psych(?:iatric)?|Back|Spine|Lymph(?:atic)?|Genitourinary)\s*:"),
    ("allergies", 2, 1,
     r"(?i)(?:\bNKDA\b|\bNKA\b|\bNo\s+Known\s+(?:Drug\s+)?Allergies\b|\b[A-Za-z]+\s*[-–—:]\s*(?:rash|hives|anaphylax|swelling|itching|nausea|vomiting|angioedema|urticaria|dyspnea|throat\s+swell))"),
    ("review_of_systems", 3, 2,
     r"(?i)(?:\b(?:denies?|positive\s+for|negative\s+for|endorses?|no\s+complaints?\s+of)\b|\b(?:Constitutional|Cardiovascular|Respiratory|Gastrointestinal|"
     r"Genitourinary|Musculoskeletal|Neurologic(?:al)?|Psychiatric|Endocrine|Hematologic|Integumentary|Immunologic)\s*:)"),
    ("lab_results", 3, 2,
     r"(?i)\b(?:WBC|RBC|Hgb|Hemoglobin|Hct|Hematocrit|PLT|Platelets|BUN|Cr(?:eatinine)?|Na|K|Cl|CO2|Bicarb|Glucose|A1[cC]|HbA1[cC]|TSH|T[34]|"
     r"ALT|AST|ALP|Bilirubin|Albumin|GFR|eGFR|Cholesterol|LDL|HDL|Triglycerides|INR|PT|PTT|aPTT|ESR|CRP|BNP|Troponin)\s*:?\s*[<>]?\s*[\d.]+"),
    ("social_history", 5, 1,
     r"(?i)\b(?:smok(?:es?|ing|er)|tobacco|cigarettes?|pack[- ]?year|alcohol|drinks?|etoh|marijuana|cannabis|illicit\s+drugs?|substance\s+(?:use|abuse)|"
     r"occupation|employed|retired|lives\s+(?:alone|with)|married|divorced|widowed)\b"),
    ("family_history", 5, 1,
     r"(?i)\b(?:mother|father|brother|sister|son|daughter|aunt|uncle|maternal|paternal|grandmother|grandfather|sibling|parent)\b.*"
     r"\b(?:diabetes|hypertension|cancer|heart|stroke|asthma|copd|depression|alzheimer|dementia|arthritis|kidney|liver|thyroid|epilepsy|diagnosed|died|deceased)\b"),
]

#: Short forms of words in headers.
HEADER_SHORT_FORMS = {
    "hx": "history", "dx": "diagnosis", "tx": "treatment", "rx": "prescription", "sx": "symptoms", "fx": "fracture", "cx": "culture", "bx": "biopsy",
    "pt": "patient", "htn": "hypertension", "eval": "evaluation", "exam": "examination", "med": "medical", "surg": "surgical", "fam": "family",
    "prev": "previous", "fhx": "family history",
}
