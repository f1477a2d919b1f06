"""Clinical abbreviations and the four whose reading depends on nearby words."""
from . import pairs

# abbreviation = expansion, in lookup order.
ABBREVIATIONS = pairs("""
DM = Diabetes Mellitus
DM1 = Type 1 Diabetes Mellitus
DM2 = Type 2 Diabetes Mellitus
T1DM = Type 1 Diabetes Mellitus
T2DM = Type 2 Diabetes Mellitus
HTN = Hypertension
CHF = Congestive Heart Failure
CAD = Coronary Artery Disease
COPD = Chronic Obstructive Pulmonary Disease
MI = Myocardial Infarction
CVA = Cerebrovascular Accident
CKD = Chronic Kidney Disease
ESRD = End Stage Renal Disease
GERD = Gastroesophageal Reflux Disease
OSA = Obstructive Sleep Apnea
RA = Rheumatoid Arthritis
OA = Osteoarthritis
PE = Pulmonary Embolism
DVT = Deep Vein Thrombosis
UTI = Urinary Tract Infection
URI = Upper Respiratory Infection
PNA = Pneumonia
SLE = Systemic Lupus Erythematosus
IBS = Irritable Bowel Syndrome
IBD = Inflammatory Bowel Disease
PCOS = Polycystic Ovarian Syndrome
UC = Ulcerative Colitis
AFib = Atrial Fibrillation
SVT = Supraventricular Tachycardia
MS = Multiple Sclerosis
CP = Chest Pain
ADHD = Attention Deficit Hyperactivity Disorder
ASD = Autism Spectrum Disorder
MDD = Major Depressive Disorder
GAD = Generalized Anxiety Disorder
HLD = Hyperlipidemia
BPH = Benign Prostatic Hyperplasia
AAA = Abdominal Aortic Aneurysm
STD = Sexually Transmitted Disease
STI = Sexually Transmitted Infection
SOB = Shortness of Breath
N/V = Nausea and Vomiting
HA = Headache
DOE = Dyspnea on Exertion
RUQ = Right Upper Quadrant
LUQ = Left Upper Quadrant
RLQ = Right Lower Quadrant
LLQ = Left Lower Quadrant
BRBPR = Bright Red Blood Per Rectum
BM = Bowel Movement
ADL = Activities of Daily Living
NAD = No Acute Distress
WNL = Within Normal Limits
RRR = Regular Rate and Rhythm
JVD = Jugular Venous Distension
HSM = Hepatosplenomegaly
PERRLA = Pupils Equal, Round, Reactive to Light and Accommodation
ASA = Aspirin
APAP = Acetaminophen
HCTZ = Hydrochlorothiazide
BB = Beta Blocker
ACE-I = ACE Inhibitor
ACEI = ACE Inhibitor
ARB = Angiotensin Receptor Blocker
PPI = Proton Pump Inhibitor
NSAID = Non-Steroidal Anti-Inflammatory Drug
SSRI = Selective Serotonin Reuptake Inhibitor
SNRI = Serotonin-Norepinephrine Reuptake Inhibitor
TCA = Tricyclic Antidepressant
MDI = Metered Dose Inhaler
OTC = Over The Counter
CBC = Complete Blood Count
CMP = Comprehensive Metabolic Panel
BMP = Basic Metabolic Panel
HbA1c = Hemoglobin A1c
A1c = Hemoglobin A1c
TSH = Thyroid Stimulating Hormone
LFT = Liver Function Test
PT = Prothrombin Time
INR = International Normalized Ratio
ESR = Erythrocyte Sedimentation Rate
CRP = C-Reactive Protein
ABG = Arterial Blood Gas
EKG = Electrocardiogram
ECG = Electrocardiogram
CXR = Chest X-Ray
MRI = Magnetic Resonance Imaging
CT = Computed Tomography
US = Ultrasound
EEG = Electroencephalogram
EMG = Electromyogram
Pt = Patient
Hx = History
Dx = Diagnosis
Tx = Treatment
Rx = Prescription
Sx = Symptoms
F/U = Follow Up
ROS = Review of Systems
PMH = Past Medical History
PSH = Past Surgical History
FH = Family History
SH = Social History
NKDA = No Known Drug Allergies
DNR = Do Not Resuscitate
DNI = Do Not Intubate
NPO = Nothing by Mouth
PRN = As Needed
BID = Twice Daily
TID = Three Times Daily
QID = Four Times Daily
QD = Daily
QHS = At Bedtime
PO = By Mouth
IV = Intravenous
IM = Intramuscular
SQ = Subcutaneous
SL = Sublingual
""")

# Abbreviation, words that switch its reading, the other reading.
CONTEXT_READINGS = [
    ("RA", ["cardiac", "heart", "atrium", "valve", "ventricle"], "Right Atrium"),
    ("MS", ["heart", "murmur", "valve", "mitral", "stenosis"], "Mitral Stenosis"),
    ("CP", ["cerebral", "brain", "developmental", "palsy"], "Cerebral Palsy"),
    ("PE", ["physical", "exam", "assessment"], "Physical Examination"),
]
CONTEXT_CHARS = 100


def first_by_key(entries, key) -> dict:
    """Entries as a dict under ``key(name)``; the first entry of a key wins."""
    out: dict = {}
    for name, value in entries:
        out.setdefault(key(name), value)
    return out


# Two names that differ only by case share one key; the earlier entry stands.
BY_UPPER = first_by_key(ABBREVIATIONS, str.upper)
# For name comparison the later entry of a lower-case key stands.
LOWER_TO_EXPANSION = {a.lower(): e.lower() for a, e in ABBREVIATIONS}
EXPANSION_TO_LOWER = {e.lower(): a.lower() for a, e in ABBREVIATIONS}
