"""Candidate terms against plain loops over positions; named and quoted sections by hand."""
import random
import re

from notecoder.knowledge import terms as kt
from notecoder.operators.named_sections import section_name_fix, verbatim_sections
from notecoder.operators.terms import TITLES, candidate_terms

HEADER = re.compile(kt.HEADER)
END = re.compile(rf"(?i)\n[ \t]*{kt.END_HEADERS}[^\n]*\n")


def tidy(x):
    return x.strip().rstrip(":.,;")


def plain_terms(text):
    """Blocks from every header on, hits one by one."""
    out = set()
    for h in HEADER.finditer(text):
        stop = END.search(text, h.end())
        for item in re.findall(kt.LIST_ITEM, text[h.end():stop.start() if stop else len(text)]):
            item = tidy(item)
            plan = re.search("(?i)" + kt.PLAN_WORDS, item)
            item = item[:plan.start()].strip() if plan else item
            out |= {item} if kt.SHORTEST < len(item) < kt.LONGEST_ITEM else set()
    for hit in re.finditer(kt.ENDING, text):
        around = text[max(0, hit.start() - kt.CHARS_BEFORE):hit.end() + kt.CHARS_BEHIND]
        phrase = re.search(kt.PHRASE_START + hit.group(), around)
        term = tidy(phrase.group()) if phrase else ""
        out |= {term} if kt.SHORTEST < len(term) < kt.LONGEST_PHRASE else set()
    for term in re.findall(kt.LEADING_WORDS, text):
        term = tidy(term)
        end = re.search(kt.NAME_ENDS, term)
        term = term[:end.start()].strip() if end and end.start() > kt.LEAST_BEFORE_END else term
        out |= {term} if kt.SHORTEST < len(term) < kt.LONGEST_PHRASE else set()
    written = {t.replace(w, TITLES[k]) for t in out for w in t.split() if (k := w.lower().strip("(),")) in TITLES}
    return out | written


def test_terms_equal_plain_loops(spark):
    rng = random.Random(3)
    pieces = ["Assessment and Plan:\n", "\nA/P\n", "problem list: \n", "Impression:", "\nLabs today\n", "\nMedications:\n", "\n1. ", "\n- ", "\n• ", "Chronic kidney disease", "HTN, stable on meds",
              "CKD 3 (COPD)", "Type 2 diabetes = continue metformin", "arthritis", "Acute bronchitis", "hyperlipidemia;", "history of ", "h/o CHF with edema", "diagnosed with Gout on ", "Diagnosis: ", " the knee ", "\n",
              "é", "Severe Left-sided (old) neuropathy, ", "of systems " * 8, "PROLAPSE"]
    rows = [(i, "".join(rng.choices(pieces, k=rng.randint(1, 25)))) for i in range(300)] + [(900, None), (901, ""), (902, "nothing here")]
    got = {}
    for r in candidate_terms(spark.createDataFrame(rows, "doc_id int, text string")).collect():
        assert r.term not in got.setdefault(r.doc_id, set())
        got[r.doc_id].add(r.term)
    for i, text in rows:
        assert got.get(i, set()) == plain_terms(text or ""), text
    assert sum(map(len, got.values())) > 1000


def test_names_follow_headers(spark):
    rows = [(1, 0, "Assessment:", "physical_exam"), (1, 1, "[Medications]", "drug block"), (1, 2, "Zebra stripes", "no such name"), (1, 3, "Zebra stripes two", " Plan "),
            (2, 0, "Plan", "plan"), (2, 1, "PLAN:", "vitals"), (2, 2, "[]:", "plan"), (3, 0, "Zebra", None), (3, 1, None, "plan")]
    out = {(r.doc_id, r.key): r.section for r in section_name_fix(spark.createDataFrame(rows, "doc_id int, ord int, header string, named string")).collect()}
    assert out == {(1, "assessment"): "assessment", (1, "medications"): "medications", (1, "zebra stripes"): "other", (1, "zebra stripes two"): "plan",
                   (2, "plan"): "plan", (3, "zebra"): "other"}


def test_quotations_are_located(spark):
    note = "HPI: cough for two days.\nPlan:  rest   and fluids at home, return when worse or not better in a week or so. End."
    docs = spark.createDataFrame([(1, note), (2, None), (3, note)], "doc_id int, text string")
    long = note[5:] + " made up behind the first sixty"
    rows = [(1, 0, "HPI", "cough for two days."), (1, 1, "Plan", long), (1, 2, "Loose", "HPI:  COUGH\tfor two days"), (1, 3, "None", "nowhere to be found"), (1, 4, "Short", "a b c    "),
            (1, 5, "hpi", "return when worse"), (1, 6, "Null", None), (2, 0, "HPI", "cough for two days."), (4, 0, "HPI", "cough for two days.")]
    quoted = spark.createDataFrame(rows, "doc_id int, ord int, name string, content string")
    out = {(r.doc_id, r.section): (r.start, r.stop) for r in verbatim_sections(quoted, docs).collect()}
    at = note.index("return when worse")
    assert out == {(1, "hpi"): (at, at + 17), (1, "plan"): (5, 5 + len(long)), (1, "loose"): (0, 24), (1, "none"): (0, 19), (2, "hpi"): (0, 19)}
    text = {r.section: r.text for r in verbatim_sections(spark.createDataFrame([(1, 0, "x", "  one \n ... \n\n\n\n two lines ")], quoted.schema), docs).collect()}
    assert text == {"x": "one\n\ntwo lines"}
