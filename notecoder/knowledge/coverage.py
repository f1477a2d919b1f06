"""Patterns of the assessment block and of its items that are no missed diagnoses."""
from __future__ import annotations

# Where the block begins and ends, and what its items look like.
BLOCK_START = r"(?im)(?:^|\n)[ \t]*(?:assessment\s*(?:and\s*plan|&\s*plan|/\s*plan)?|a\s*/\s*p)\s*[:\n]"
BLOCK_END = (r"(?i)\n[ \t]*(?:plan|medications?|physical\s*exam|review\s*of\s*systems?|follow|labs?|imaging|referral|problem\s*list|past\s*medical"
             r"|hpi|history\s*of\s*present|chief\s*complaint|vitals?|subjective|objective|sign)[^\n]*\n")
LIST_ITEM = r"(?m)(?:^|\n)[ \t]*(?:\d+[.):]\s*|[•\-\*]\s*)([A-Z][^\n]{4,120})"
PLAIN_ITEM = r"(?m)(?:^|\n)[ \t]*([A-Z][A-Za-z].{3,120})"

# First words of plain lines, and of any item, that name no condition.
SENTENCE_STARTS = """the this that there these those she her his patient will should please note also today currently recommend discussed plan need
would could may might has had was were are been being have does did can comments orders diagnoses referral ambulatory""".split()
SKIP_STARTS = "see f/u follow consult refer order schedule return review continue discuss monitoring education discussed informed counseled labs imaging".split()

# Items that are no disease, not managed, ordered only, or incidental; and actions that speak against the last two.
NOT_DISEASE = (r"(?i)(?:vaccine|vaccination|immunization|immunized|DTaP|MMR|IPV|Hep\s*[AB]|PENTACEL|INFANRIX|Rotavirus|Poliovirus|Pneumococcal|Varicella|PCV13|PROQUAD|ACTHIB|HAVRIX|VAQTA|"
               r"IPOL|ROTATEQ|VARIVAX|^CBC|^CMP|^Comprehensive Metabolic|^Iron Profile|^MRI\b|^CT\b|^X-ray|^Ultrasound|^Answers submitted|^Overview$|^Blood pressure today|^Advised him|"
               r"^ACE inhibitor|^VNA nursing|^Improvement or symptoms|^Still unclear)")
STABLE_ONLY = (r"(?i)(?:^|\s*[-–—:,]\s*)(?:stable|well\s+controlled|controlled|unchanged|continue\s+(?:current|same|home)\s+(?:meds|medications?|regimen|treatment)|no\s+change|at\s+goal|"
               r"resolved|quiescent|not\s+active|no\s+acute\s+issues?|asymptomatic|no\s+(?:new\s+)?(?:symptoms?|complaints?|concerns?)|doing\s+well|improved|improving|"
               r"noted\s+on\s+(?:colonoscopy|imaging|ct|mri|x-ray))(?:\s*$|\s*[,;.])")
INCIDENTAL = r"(?i)\b(?:incidental|old\s+finding|stable\s+from\s+prior|chronic\s+appearing|degenerative)\b"
ORDER_ONLY = r"(?i)\b(?:future|profile|panel|order(?:ed)?|test(?:ing)?|ige|lab\s+order|screening\s+order)\b"
ACTION = (r"(?i)\b(?:start|started|initiat|prescrib|adjust|increase|decrease|taper|stop|discontinu|hold|order|follow\s*up|f/?u|monitor|recheck|refer|discuss|counsel|reviewed|evaluat|treat|"
          r"therapy|plan)\b")

# Words that say little when a name is looked up in a text.
WEAK_WORDS = ["the", "and", "with", "type", "stage", "grade"]
