"""Line patterns of sections that have no header."""
from __future__ import annotations

#: Fixed values: (section, weight, pattern) in order; of equal weights the first counts.
LINE_PATTERNS = [
    ("medications", 0.92,
     r"(?i)\b[a-z]{3,}(?:\s*/\s*[a-z]+)*\s+\d+(?:\.\d+)?\s*(?:mg|mcg|g|ml|units?|iu|meq|%)(?:\s*(?:/\s*\d+(?:\.\d+)?\s*(?:mg|mcg|g|ml|units?|iu|meq|%))?)"
     r"(?:\s+(?:tablet|tab|capsule|cap|solution|suspension|injection|cream|ointment|patch|inhaler|drops?|syrup|powder|vial|pen|spray|gel|suppository|lozenge|elixir|chewable|"
     r"extended.release|delayed.release|oral|topical|iv|im|sq|subq|sublingual|transdermal|ophthalmic|otic|nasal|rectal|vaginal)s?)?"),
    ("medications", 0.95,
     r"(?i)\b(?:take|inject|apply|inhale|instill|insert|chew|dissolve|use)\s+\d+\s+(?:tablet|cap|capsule|puff|drop|spray|patch|unit|ml|dose)s?"
     r"\s+(?:by mouth|orally|topically|subcutaneously|intramuscularly|intravenously|per|every|once|twice|three times|daily|bid|tid|qid|q\d+h|prn|as needed|at bedtime|qhs|qam|qpm)"),
    ("medications", 0.80, r"(?i)(?:qty|quantity|refills?|dispense|supply|days?\s*supply)\s*[:=]?\s*\d+"),
    ("medications", 0.95,
     r"(?i)^[a-z][a-z\- ]{2,30}\s+\d+(?:\.\d+)?\s*(?:mg|mcg|g|ml|units?|iu|meq|%)\s+\w+\s+(?:tab|cap|sol|susp|inj|crm|oint)"
     r"\s+(?:oral|topical|iv|im|sq|subq|sublingual|transdermal|ophthalmic|otic|nasal|rectal|vaginal|po|pr|sl)(?:\s+\d+)?"),
    ("medications", 0.90,
     r"(?i)\b[a-z]{4,}(?:\s+(?:er|sr|cr|xl|xr|dr|hcl|hct))?\s+\d+\s*(?:mg|mcg|g)\s+(?:po|pr|iv|im|sq|sl|top|inh|neb|od|bid|tid|qid|daily|q\d+h|prn|qhs|qam|qpm)\b"),
    ("allergies", 0.93,
     r"(?i)(?:^|\b)(?:allerg(?:y|ies|ic)\s+(?:to|reaction)|(?:nkda|nka|no\s+known\s+(?:drug\s+)?allergies)|"
     r"(?:causes?|reaction)\s*:\s*(?:hives|rash|anaphylaxis|swelling|itching|nausea|shortness of breath|angioedema))"),
    ("allergies", 0.90,
     r"(?i)^[A-Z][a-z]+(?:\s+[a-z]+)?\s*[-–—:]\s*(?:rash|hives|anaphylaxis|swelling|itching|nausea|shortness of breath|angioedema|urticaria|gi upset|"
     r"throat\s+swelling|tongue\s+swelling|wheezing|hypotension|vomiting|diarrhea)"),
    ("vitals", 0.91,
     r"(?i)(?:^|\b)(?:(?:bp|blood\s+pressure)\s*[:=]?\s*\d{2,3}\s*/\s*\d{2,3}|(?:hr|heart\s+rate|pulse)\s*[:=]?\s*\d{2,3}\s*(?:bpm)?|"
     r"(?:temp(?:erature)?|t)\s*[:=]?\s*\d{2,3}(?:\.\d)?\s*(?:[°ºf]|deg|celsius|fahrenheit)?|(?:rr|resp(?:iratory)?\s*rate)\s*[:=]?\s*\d{1,2}|"
     r"(?:spo2|o2\s*sat|oxygen\s+sat(?:uration)?)\s*[:=]?\s*\d{2,3}\s*%?|(?:wt|weight)\s*[:=]?\s*\d{2,4}\s*(?:kg|lb|lbs|pounds)?|"
     r"(?:ht|height)\s*[:=]?\s*\d{1,3}(?:[''′]\s*\d{1,2}[\"″]?|\s*(?:cm|in|ft))?)\b"),
    ("lab_results", 0.89,
     r"(?i)(?:^|\b)(?:(?:wbc|rbc|hgb|hct|plt|mcv|mch|mchc|rdw|mpv|hemoglobin|hematocrit|platelets?|sodium|potassium|chloride|co2|bicarb(?:onate)?|bun|creatinine|glucose|calcium|"
     r"magnesium|phosphorus|albumin|total\s+protein|bilirubin|ast|alt|alp|ggt|ldh|lipase|amylase|tsh|t3|t4|free\s+t4|inr|pt|ptt|aptt|hba1c|a1c|hemoglobin\s+a1c|troponin|bnp|nt-?probnp|"
     r"d-?dimer|ferritin|iron|tibc|transferrin|crp|esr|sed\s+rate|procalcitonin|gfr|egfr|ua|urinalysis|urine))\s*[:=]?\s*[<>]?\s*\d+(?:\.\d+)?"),
    ("lab_results", 0.85,
     r"(?i)(?:^|\b)[a-z][a-z\s]{2,25}:\s*\d+(?:\.\d+)?\s*(?:\(?\s*\d+(?:\.\d+)?\s*[-–]\s*\d+(?:\.\d+)?\s*\)?)\s*"
     r"(?:mg/dl|g/dl|mmol/l|meq/l|u/l|iu/l|ng/ml|pg/ml|mcg/dl|%|x10[³\^]?3?/?[uμ]?l|cells?/?[uμ]l|mm/hr|seconds?|sec|ratio)?"),
    ("physical_exam", 0.88,
     r"(?i)(?:^|\b)(?:(?:heent|cardiovascular|respiratory|abdomen|musculoskeletal|neurological|psychiatric|integumentary|lymphatic|genitourinary)\s*:|"
     r"(?:no\s+(?:murmurs?|rales|rhonchi|wheezing|edema|tenderness|guarding|rebound|rigidity|lymphadenopathy|cyanosis|clubbing|jaundice))|"
     r"(?:lungs?\s+(?:clear|cta)|heart\s+(?:rrr|regular))|(?:(?:pupils?|perrla|eomi|ncat|a&ox[234]|alert\s+and\s+oriented|regular\s+rate\s+and\s+rhythm|rrr|clear\s+to\s+auscultation|"
     r"soft[,\s]+non[- ]?tender[,\s]+non[- ]?distended|no\s+(?:focal|gross)\s+deficits?))|"
     r"(?:(?:normal|abnormal|wnl|within\s+normal\s+limits)\s+(?:gait|reflexes|strength|sensation|rom|range\s+of\s+motion)))"),
    ("imaging", 0.85,
     r"(?i)(?:^|\b)(?:(?:x-?ray|ct\s*(?:scan)?|mri|ultrasound|echo(?:cardiogram)?|mammogram|dexa|bone\s+density|pet\s+scan|fluoroscopy|angiograph?y|venogram|arthrogram)"
     r"\s*(?:of\s+(?:the\s+)?[a-z]+)?\s*[:=]?|(?:impression|finding|result)\s*:\s*(?:no\s+(?:acute|significant)|normal|unremarkable|stable|improved|worsened|new))"),
    ("immunizations", 0.88,
     r"(?i)(?:^|\b)(?:(?:influenza|flu|covid|tdap|td|tetanus|pneumo(?:coccal|vax)|prevnar|hepatitis\s*[ab]|hep\s*[ab]|mmr|varicella|zoster|shingrix|ipv|polio|hib|meningococcal|"
     r"hpv|gardasil|rotavirus)\s+(?:vaccine|vaccination|immunization|dose|booster|series)|(?:vaccine|vaccination|immunization|dose|booster)"
     r"\s+(?:given|administered|received|due|overdue|declined)(?:\s+(?:on\s+)?\d{1,2}[-/]\d{1,2}[-/]\d{2,4})?)"),
    ("assessment", 0.85, r"(?i)(?:^|\b)(?:icd[- ]?10\s*[:=]?\s*)?[A-TV-Z]\d{2,3}(?:\.\d{1,4})?\s*[-–:]\s*[A-Z][a-z]"),
    ("assessment", 0.78,
     r"(?i)^\s*\d+\.\s+[A-Z][a-z]+(?:\s+[a-z]+){0,5}\s*(?:\(?(?:icd|[A-TV-Z]\d{2})|\buncontrolled\b|\bcontrolled\b|\bstable\b|\bchronic\b|\bacute\b|"
     r"\btype\s*[12]\b|\bstage\b|\bwith\b|\bwithout\b)"),
    ("plan", 0.82,
     r"(?i)(?:^|\b)(?:(?:continue|start|stop|increase|decrease|titrate|switch|change|add|discontinue|taper|refill|renew)\s+(?:current\s+)?(?:medication|dose|regimen|therapy|treatment)|"
     r"(?:order(?:ed)?|schedule[d]?|refer(?:red)?(?:\s+to)?|recommend(?:ed)?|advise[d]?)\s+(?:lab|labs|imaging|ct|mri|x-?ray|ultrasound|echo|consult|follow[- ]?up|f/?u|return\s+visit|"
     r"physical\s+therapy|pt|ot|specialist|cardiology|neurology|endocrinology|dermatology|gastroenterology|ophthalmology)|"
     r"(?:return\s+(?:to\s+(?:clinic|office)|in)\s+\d+\s*(?:day|week|month)s?)|(?:patient\s+(?:educated|counseled|advised)\s+(?:on|about|regarding)))"),
    ("follow_up", 0.86,
     r"(?i)(?:^|\b)(?:(?:follow[- ]?up|f/?u|return)\s+(?:in\s+)?\d+\s*(?:day|week|month|year)s?|(?:next\s+(?:appointment|visit))\s*[:=]?|(?:rto|return\s+to\s+(?:office|clinic))\s+(?:in\s+)?\d+)"),
    ("social_history", 0.87,
     r"(?i)(?:^|\b)(?:(?:(?:current|former|never|non)[- ]?smoker|smokes?\s+\d+\s*(?:pack|ppd|cigarettes?)|tobacco\s+(?:use|history|abuse)|quit\s+(?:smoking|tobacco))|"
     r"(?:(?:drinks?|consumes?)\s+\d+\s*(?:drink|beer|wine|alcohol)|(?:alcohol|etoh)\s+(?:use|abuse|dependence|history)|social\s+drinker|denies\s+(?:alcohol|etoh|tobacco|drug|illicit))|"
     r"(?:(?:illicit|recreational)\s+drug\s+(?:use|abuse|history)|(?:marijuana|cannabis|cocaine|heroin|methamphetamine|opioid)\s+use)|"
     r"(?:(?:lives|resides)\s+(?:alone|with)|(?:married|single|divorced|widowed|separated)|(?:employed|retired|unemployed|disabled|occupation)))"),
    ("family_history", 0.86,
     r"(?i)(?:^|\b)(?:(?:(?:mother|father|sister|brother|parent|sibling|maternal|paternal|grandmother|grandfather|aunt|uncle|cousin|family\s+(?:member|history))\s+"
     r"(?:with|has|had|diagnosed|hx|history)\s+(?:of\s+)?[a-z])|(?:(?:no|negative|positive)\s+family\s+(?:history|hx))|(?:fh\s*[:=]\s*(?:positive|negative|significant|unremarkable)))"),
    ("review_of_systems", 0.86,
     r"(?i)(?:^|\b)(?:(?:(?:denies|reports?|endorses?|admits?|complains?\s+of|positive\s+for|negative\s+for|no)\s+(?:fever|chills|fatigue|malaise|weight\s+(?:loss|gain)|night\s+sweats?|"
     r"headache|dizziness|chest\s+pain|palpitations?|dyspnea|sob|(?:shortness\s+of\s+breath)|cough|wheez(?:e|ing)|nausea|vomiting|diarrhea|constipation|abdominal\s+pain|dysuria|frequency|"
     r"urgency|hematuria|(?:joint|muscle|back)\s+pain|rash|itching|(?:blurred|change\s+in)\s+vision|anxiety|depression|insomnia))|"
     r"(?:all\s+other\s+systems?\s+(?:reviewed?\s+and\s+)?negative)|(?:(?:\d+|fourteen|twelve|ten)\s*[- ]?point\s+ros))"),
    ("chief_complaint", 0.85,
     r"(?i)^(?:(?:(?:patient|pt)\s+(?:presents?|comes?\s+in|here|is\s+here|seen\s+(?:today|for))\s+(?:for|with|complaining\s+of))|(?:(?:reason\s+for\s+(?:visit|encounter)|chief\s+concern)\s*[:=]?))"),
    ("history_present_illness", 0.80,
     r"(?i)(?:^|\b)(?:(?:(?:patient|pt)\s+is\s+a\s+\d+\s*[-–]?\s*(?:year|yr|y/?o|y\.o\.?)(?:\s*[-–]?\s*old)?\s+(?:male|female|m|f|man|woman))|"
     r"(?:(?:\d+\s*[-–]?\s*(?:day|week|month|year)s?\s+(?:history|hx|ago))\s+(?:of|since)))"),
    ("past_surgical_history", 0.83,
     r"(?i)(?:^|\b)(?:(?:(?:appendectomy|cholecystectomy|hysterectomy|mastectomy|lumpectomy|colectomy|(?:total|partial)\s+(?:knee|hip)\s+(?:replacement|arthroplasty)|"
     r"(?:cabg|coronary\s+artery\s+bypass)|(?:c[- ]?section|cesarean)|(?:lap(?:aroscopic)?)\s+[a-z]+(?:ectomy|otomy|plasty|pexy)|tonsillectomy|adenoidectomy|hernia\s+repair|"
     r"(?:acl|rotator\s+cuff)\s+repair)\s*(?:\(?\s*\d{4}\s*\)?|\bin\s+\d{4}\b)?))"),
]
#: The class of a line that no pattern fits, and the shortest inferred section.
OTHER, LEAST_SECTION = "other", 10
