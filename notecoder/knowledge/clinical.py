"""Drugs, laboratory words and the word lists of the evidence tests."""
from . import pairs, quoted, words

# Drug names that are not diagnoses.
MEDICATION_NAMES = words("""
metformin, insulin, glipizide, sitagliptin, jardiance, ozempic, lisinopril, amlodipine,
losartan, metoprolol, atenolol, hydrochlorothiazide, atorvastatin, rosuvastatin,
simvastatin, pravastatin, albuterol, fluticasone, montelukast, salmeterol, budesonide,
sertraline, escitalopram, fluoxetine, bupropion, venlafaxine, buspirone, lorazepam,
alprazolam, citalopram, levothyroxine, synthroid, omeprazole, pantoprazole, esomeprazole,
ranitidine, famotidine, tiotropium, ipratropium, furosemide, carvedilol, digoxin,
spironolactone, warfarin, aspirin, acetaminophen, ibuprofen, naproxen, prednisone,
prednisolone, amoxicillin, azithromycin, ciprofloxacin, doxycycline, gabapentin,
pregabalin, tramadol, oxycodone, hydrocodone, morphine, fentanyl, duloxetine, trazodone,
quetiapine, olanzapine, risperidone, aripiprazole, lithium, valproic, carbamazepine,
phenytoin, levetiracetam, lamotrigine, topiramate, clopidogrel, rivaroxaban, apixaban,
enoxaparin, heparin, anastrozole, tamoxifen, letrozole, alendronate, risedronate,
cholecalciferol, ergocalciferol, multivitamin, tylenol, seroquel, norvasc, lipitor
""")

# Single words that are never a diagnosis.
SINGLE_WORD_REJECT = words("""
patient, visit, follow, followup, stable, normal, negative, positive, history, review,
current, prior, date, none, unknown, monitor, refilled, continue, discussed, counseling,
examination, screening, vitamin, blood, pressure, level, value, lab, test, medication,
prescription, diet, exercise, weight, height, pulse, temperature, alert, oriented,
assessment, plan, impression, return, appointment, referral, consult, encounter, note
""")

# Endings of diagnosis words.
DISEASE_SUFFIXES = words("""
disease, disorder, syndrome, deficiency, failure, insufficiency, infection, inflammation,
neoplasm, carcinoma, tumor, malignancy, stenosis, occlusion, obstruction, fibrosis,
sclerosis, neuropathy, myopathy, arthritis, itis, emia, osis, opathy, penia, algia, uria,
plegia, paresis, ectasia, trophy, philia, cytosis, edema, dysplasia
""")

# Entries of a problem list that are not diagnoses.
PROBLEM_SKIP = words("""
follow-up consultation, follow up consultation, followup consultation,
orthopaedic complexity, orthopedic complexity, body mass index, bmi, history type,
none recorded, none recorded., none, n/a, not applicable, sleep rest pattern finding,
screening, general health check, routine examination
""")
PROBLEM_SKIP_PARTS = words("""
body mass index, follow-up, followup, none recorded, pattern finding, screening
""")

# disease = drugs that imply it, in scan order.
DISEASE_DRUGS = [(d, words(v)) for d, v in pairs("""
Type 2 Diabetes Mellitus = metformin, glipizide, glimepiride, sitagliptin, empagliflozin, dapagliflozin, trulicity, dulaglutide, semaglutide, ozempic, jardiance, farxiga, januvia, insulin
Essential Hypertension = lisinopril, losartan, valsartan, olmesartan, amlodipine, nifedipine, hydralazine, hydrochlorothiazide
Hyperlipidemia = atorvastatin, rosuvastatin, simvastatin, pravastatin, lovastatin
Hypothyroidism = levothyroxine, liothyronine, synthroid
Gastroesophageal Reflux Disease = omeprazole, pantoprazole, lansoprazole, esomeprazole, famotidine
Major Depressive Disorder = sertraline, fluoxetine, escitalopram, citalopram, paroxetine
Neuropathic Pain = gabapentin, pregabalin, duloxetine
Gout = allopurinol, febuxostat, colchicine
Benign Prostatic Hyperplasia = finasteride, tamsulosin, dutasteride
Asthma = albuterol, fluticasone, budesonide, montelukast
Chronic Obstructive Pulmonary Disease = tiotropium
Atrial Fibrillation = warfarin, apixaban, rivaroxaban
Heart Failure = furosemide, spironolactone, carvedilol
Osteoporosis = alendronate, risedronate, denosumab
Overactive Bladder Syndrome = myrbetriq, mirabegron, oxybutynin
Glaucoma = brimonidine, timolol, latanoprost, lumigan, bimatoprost
Dementia = donepezil, rivastigmine, memantine
Rheumatoid Arthritis = methotrexate, hydroxychloroquine
Anemia of Chronic Kidney Disease = erythropoietin, darbepoetin
""")]

# Disease word = drugs (or tests) looked for in its context.
CONTEXT_DRUGS = [(d, words(v)) for d, v in pairs("""
diabetes = metformin, insulin, glipizide, sitagliptin, jardiance, ozempic
hypertension = lisinopril, amlodipine, losartan, metoprolol, atenolol, hydrochlorothiazide
hyperlipidemia = atorvastatin, rosuvastatin, simvastatin, pravastatin, lipitor, crestor
asthma = albuterol, fluticasone, montelukast, salmeterol, budesonide
depression = sertraline, escitalopram, fluoxetine, bupropion, venlafaxine
anxiety = buspirone, sertraline, lorazepam, alprazolam, citalopram
hypothyroidism = levothyroxine, synthroid, thyroid
gerd = omeprazole, pantoprazole, esomeprazole, ranitidine, famotidine
copd = tiotropium, albuterol, salmeterol, ipratropium, fluticasone
heart failure = furosemide, carvedilol, lisinopril, digoxin, spironolactone
""")]
CONTEXT_LABS = [(d, words(v)) for d, v in pairs("""
diabetes = hba1c, glucose, fasting glucose, blood sugar, a1c
hypertension = blood pressure, bp, systolic, diastolic
hyperlipidemia = cholesterol, ldl, hdl, triglycerides, lipid panel
kidney disease = creatinine, gfr, egfr, bun, proteinuria
anemia = hemoglobin, hematocrit, rbc, ferritin, iron
thyroid = tsh, t3, t4, thyroid function
liver disease = alt, ast, bilirubin, albumin, liver function
heart failure = bnp, pro-bnp, ejection fraction, echocardiogram
""")]
GENERAL_DRUG_WORDS = words("""
medication, drug, prescription, prescribed, rx, taking, continue, start, began, initiated,
ordered, mg, mcg, ml, tablet, capsule, injection, dose, daily
""")
GENERAL_LAB_WORDS = words("""
lab, test, result, level, value, panel, hba1c, glucose, cholesterol, creatinine,
hemoglobin, blood pressure, bp, wbc, rbc, plt, esr, crp, urine, culture, biopsy, imaging,
x-ray, mri, ct scan
""")

# Words that show each evidence element (blanks are part of the words).
MONITORING_WORDS = quoted("""
follow up|followup|f/u|monitor|stable|tracking|watch|recheck|re-check|continue to|
maintaining|managed|controlled|checked|surveillance|observe|recurrence|return visit|
return to clinic|routine|interval|reassess|reevaluate|re-evaluate|annual|periodic|
ongoing|maintenance""")
EVALUATION_WORDS = quoted("""
lab |labs|test |tests|tested|result|showed|reveal|indicate|level|score|measure|imaging|
x-ray|mri|ct scan|biopsy|hba1c|a1c|creatinine|gfr|egfr|cholesterol|blood pressure|
bp |ekg|ecg|echocardiogram|ultrasound|diagnosed|workup|evaluated|physical exam|examined|
urinalysis|panel|culture|pathology|spirometry|dexa|bmi|phq|phq9|phq-9|worsening|
improving|unchanged|noted|observed|finding|monitor cr|serial|stable on""")
ASSESSMENT_WORDS = quoted("""
diagnosis|diagnosed|assessment|impression|presents with|problem list|active problem|
condition|clinical finding|consistent with|suggestive of|confirm|establish|
known history|history of|chronic|acute|uncontrolled|well-controlled|poorly controlled|
stage|type 2|type 1|moderate|severe|mild""")
TREATMENT_WORDS = quoted("""
prescrib|taking| mg | mg,|mg/|tablet|refill|medication|rx |dose|therapy|surgery|
injection|continue |initiated|started on|treated with|treating|capsule|inhaler|cream|
ointment|procedure|referred|referral|counsel| diet|exercise|lifestyle|increase|decrease|
reduce|add |switch|ordered|mcg| daily|consider | bid | tid | qd | prn|linzess|
metformin|insulin|statin|atorvastatin|lisinopril|amlodipine|losartan|sertraline|
omeprazole|fiber|fluids|lose weight""")

# Section sets and marker words of the gate and the status rules.
TEMPORAL_ACTIVE_SECTIONS = words("""
assessment_and_plan, assessment, chief_complaint, history_present_illness, active_problems,
active_problem_list, problem_list, medications, current_medications, plan
""")
HISTORY_SECTIONS = words("past_medical_history, medical_history, pmh")
GATE_ACTIVE_SECTIONS = words("""
assessment_and_plan, assessment, chief_complaint, history_present_illness
""")
TEMPORAL_MARKERS = words("""
history of, past history, previous, prior to, resolved, remission, pmh:, pmh includes,
past medical history, known history, hx of, h/o, h/x of
""")
NEGATION_MARKERS = words("""
no evidence, denies, without, negative for, ruled out, not identified
""")
CHRONIC_WORDS = words("""
chronic, long-standing, longstanding, ongoing, maintained, well-controlled,
poorly controlled, stable, uncontrolled, recurrent, persistent, established,
known history, history of, hx of, moderate, severe
""")
ACUTE_WORDS = words("""
acute, new onset, new-onset, sudden, recent, worsening, exacerbation, flare, presenting,
presents with, today, current episode, active
""")

# Shortest evidence that is held against the note, grades by the number of elements with a text.
LEAST_VERIFIED = 5
MEAT_GRADES = {0: "No MEAT", 1: "Partial MEAT", 2: "Half MEAT", 3: "Medium MEAT", 4: "Full MEAT"}
