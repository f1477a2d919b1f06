"""Status codes: words that lead to codes of history, long-term drugs and devices."""
from __future__ import annotations

# Pattern, code and description of a personal history.
HISTORY = (
    r"(?i)\b(?:personal\s+)?history\s+of\s+(?:\w+\s+)*?(?:cancer|carcinoma|malignant\s+neoplasm|malignancy|lymphoma|leukemia|melanoma|sarcoma)\b",
    "Z85.819", "Personal history of malignant neoplasm, unspecified",
)

# Drug class, code, drugs.
LONG_TERM_DRUGS = [
    ("anticoagulants", "Z79.01", ["warfarin", "Coumadin", "Eliquis", "apixaban", "Xarelto", "rivaroxaban", "Pradaxa", "dabigatran", "Savaysa", "edoxaban"]),
    ("antiplatelets", "Z79.02", ["aspirin 81mg", "aspirin 81 mg", "baby aspirin", "clopidogrel", "Plavix", "ticagrelor", "Brilinta", "prasugrel", "dipyridamole"]),
    ("insulin", "Z79.4", ["insulin", "Lantus", "glargine", "Humalog", "lispro", "Novolog", "aspart", "Tresiba", "degludec", "Basaglar", "Toujeo", "NPH"]),
    ("systemic_steroids", "Z79.52", ["prednisone", "prednisolone", "dexamethasone oral", "methylprednisolone oral", "hydrocortisone oral", "budesonide oral"]),
    ("hormonal_contraceptives", "Z79.890", ["Apri", "desogestrel", "ethinyl estradiol", "Lo Loestrin", "Sprintec", "Junel", "Yaz", "Microgestin", "Nexplanon", "Mirena", "NuvaRing", "OCP"]),
    ("bisphosphonates", "Z79.83", ["alendronate", "Fosamax", "risedronate", "Actonel", "ibandronate", "Boniva", "zoledronic acid", "Reclast"]),
    ("SERMs", "Z79.810", ["tamoxifen", "raloxifene", "Evista", "toremifene"]),
    ("aromatase_inhibitors", "Z79.811", ["anastrozole", "Arimidex", "letrozole", "Femara", "exemestane", "Aromasin"]),
    ("opiates", "Z79.891", ["oxycodone", "hydrocodone", "morphine", "oxymorphone", "hydromorphone", "Dilaudid", "fentanyl patch", "buprenorphine", "Suboxone", "methadone"]),
    ("immunosuppressants", "Z79.899", ["tacrolimus oral", "cyclosporine", "mycophenolate", "CellCept", "azathioprine", "Imuran", "methotrexate oral", "leflunomide"]),
]
NOT_RELEVANT = "ENCOUNTER_NOT_RELEVANT"

#: Conditions for which a class of drugs is taken: a starter of our own, to be extended by the user.
UNDERLYING = {
    "anticoagulants": ["atrial fibrillation", "atrial flutter", "deep vein thrombosis", "DVT", "pulmonary embolism", "mechanical valve"],
    "antiplatelets": ["coronary artery disease", "CAD", "stroke", "TIA", "peripheral artery disease", "coronary stent"],
    "insulin": ["diabetes", "diabetic", "hyperglycemia"],
    "systemic_steroids": ["asthma", "COPD", "rheumatoid arthritis", "lupus", "polymyalgia rheumatica"],
    "hormonal_contraceptives": ["contraception", "contraceptive", "menorrhagia", "endometriosis"],
    "bisphosphonates": ["osteoporosis", "osteopenia", "Paget disease"],
    "SERMs": ["breast cancer", "osteoporosis"],
    "aromatase_inhibitors": ["breast cancer"],
    "opiates": ["chronic pain", "cancer pain", "opioid dependence", "opioid use disorder"],
    "immunosuppressants": ["transplant", "rheumatoid arthritis", "lupus", "psoriasis", "Crohn disease", "ulcerative colitis"],
}

# Device or surgical status, code, trigger phrases.
DEVICES = [
    ("pacemaker", "Z95.0", ["pacemaker", "PPM", "device clinic", "pacemaker check"]),
    ("ICD_defibrillator", "Z95.810", ["ICD", "defibrillator", "ICD check"]),
    ("coronary_stent", "Z95.5", ["s/p stent", "coronary stent", "drug-eluting stent", "s/p PCI"]),
    ("CABG", "Z95.1", ["s/p CABG", "coronary artery bypass", "bypass graft"]),
    ("prosthetic_valve", "Z95.2", ["prosthetic valve", "mechanical valve", "bioprosthetic valve"]),
    ("postoperative_aftercare", "Z48.89", ["postoperative care", "post-op", "surgical aftercare", "s/p surgery", "s/p polypectomy"]),
    ("foley_urethral_catheter", "Z97.8", ["Foley catheter", "Foley", "Foley in place", "urethral catheter", "urethral urinary catheter in situ", "indwelling catheter", "chronic Foley", "urinary catheter in place"]),
    ("tracheostomy", "Z93.0", ["tracheostomy", "trach", "tracheostomy status"]),
]
