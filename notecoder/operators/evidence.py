"""Evidence of monitoring, evaluation, assessment and treatment: detection and gate."""
from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import similarity as sim
from ..functions import text as tx
from ..functions.arrays import explode_rows, let
from ..functions.keywords import has, word_groups
from ..functions.skew import with_texts
from ..knowledge import clinical as kn
from ..settings import DEFAULTS, Settings
from .context import strip
from .rules import ELEMENTS

WORDS = {
    "monitoring": kn.MONITORING_WORDS, "evaluation": kn.EVALUATION_WORDS,
    "assessment": kn.ASSESSMENT_WORDS, "treatment": kn.TREATMENT_WORDS,
}


def evidence_lines(c: Column) -> Column:
    """Distinct lines of a context of eight or more characters, in source order."""
    one = lambda s: F.array(s)
    # a text that stands in several parts brings no new line the second time
    texts = F.array_distinct(F.concat(one(c["primary"]), c["around"], one(c["section"]), c["related"], c["drugs"], c["labs"]))
    lines = F.filter(F.flatten(F.transform(texts, lambda t: F.transform(F.split(t, "\n"), strip))), lambda s: F.length(s) >= 8)
    return let(F.array_distinct(lines), lambda a: let(F.transform(a, lambda s: F.lower(s)), lambda low: F.filter(
        a, lambda _, i: F.array_position(low, F.get(low, i)) == i + 1)))


def detected(rows: DataFrame, elements=tuple(ELEMENTS)) -> DataFrame:
    """``doc_id`` and the best line for each element, from ``doc_id, disease, lines, low`` (the lines in lower case).

    Every distinct line is searched for the elements' words once a worker.
    """
    rows = rows.withColumn("_bits", word_groups(F.col("low"), "elements"))
    profiles = F.transform("lines", lambda s, i: let(F.get("_bits", i), lambda b: F.struct(
        s.alias("s"), F.get("low", i).alias("low"), *[has(b, k).alias(e) for k, e in enumerate(ELEMENTS)])))
    return explode_rows(rows, F.array(detect_profiled(profiles, F.lower("disease"), elements)), "doc_id")


def line_profiles(text: Column) -> Column:
    """Lines of eight or more characters with their lower-case form and a bit per element.

    Made once per text, however many mentions look at it.
    """
    bits = lambda low: [low.rlike(tx.any_of(WORDS[e])).alias(e) for e in ELEMENTS]
    one = lambda s: let(F.lower(s), lambda low: F.struct(s.alias("s"), low.alias("low"), *bits(low)))
    return F.transform(F.filter(F.transform(F.split(text, "\n"), strip), lambda s: F.length(s) >= 8), one)


def detect_profiled(lines: Column, low_name: Column, elements=tuple(ELEMENTS)) -> Column:
    """Best line for each element as struct(evidence, confidence); null and 0 where none fits. Repeats change nothing.

    A line naming the disease counts more, and so does a short one; the first best wins. For the assessment the
    shortest line naming the disease stands, unless a keyword line is more certain.
    """
    rated = F.transform(lines, lambda x: F.struct(
        x["s"].alias("s"), F.length(x["s"]).alias("n"), F.contains(x["low"], low_name).alias("named"), *[x[e].alias(e) for e in ELEMENTS]))

    def best(all_: Column, e: str) -> Column:
        # Confidences and preferences.
        named_confidence = 0.75 if e == "assessment" else 0.70

        def rate(x: Column, i: Column) -> Column:
            conf = F.when(x["named"], F.lit(named_confidence)).otherwise(F.lit(0.55))
            score = conf + F.when(x["n"] < 120, F.lit(0.05)).otherwise(F.lit(0.0)) + F.when(x["named"], F.lit(0.10)).otherwise(F.lit(0.0))
            return F.when(x[e], F.struct(score.alias("score"), (-i).alias("o"), conf.alias("confidence"), x["s"].alias("line")))

        return let(F.array_max(F.transform(all_, rate)), lambda b: F.struct(
            F.trim(F.substring(b["line"], 1, 150)).alias("evidence"), F.coalesce(b["confidence"], F.lit(0.0)).alias("confidence")))

    def assessment(all_: Column) -> Column:
        named = F.transform(all_, lambda x, i: F.when(x["named"], F.struct(F.least(x["n"], F.lit(150)).alias("n"), i.alias("i"), x["s"].alias("s"))))
        pair = F.struct(F.array_min(named).alias("short"), best(all_, "assessment").alias("kw"))
        return let(pair, lambda p: F.when(
            p["kw"]["confidence"] > F.when(p["short"].isNotNull(), F.lit(0.65)).otherwise(F.lit(0.0)), p["kw"]
        ).otherwise(F.struct(
            F.trim(F.substring(p["short"]["s"], 1, 150)).alias("evidence"),
            F.when(p["short"].isNotNull(), F.lit(0.65)).otherwise(F.lit(0.0)).alias("confidence"))))

    return let(rated, lambda a: F.struct(*[(assessment(a) if e == "assessment" else best(a, e)).alias(e) for e in elements]))


def overall_confidence(confidences: list[Column]) -> Column:
    """Mean of the confidences above zero, two decimals."""
    n = sum(((c > 0).cast("int") for c in confidences), F.lit(0))
    total = sum((F.when(c > 0, c).otherwise(F.lit(0.0)) for c in confidences), F.lit(0.0))
    return F.when(n > 0, F.bround(total / n, 2)).otherwise(F.lit(0.0))


# --- gate --------------------------------------------------------------------------
PASS_A = "A AND (M OR E OR T) [PASS]"
PASS_T = "T AND (M OR E) [PASS]"
PASS_N = "MEAT count >= 2 [PASS]"
PASS_H = "history with active management [PASS]"
FAIL = "insufficient evidence [FAIL]"
REVERSED = "reversed after deterministic checks"


def squash(c: Column) -> Column:
    return tx.squeeze(F.lower(c))


def grounded(evidence: Column, context: Column) -> Column:
    """Whether an evidence text, or 70 percent of its words, occurs in the (squashed) context."""
    words = F.split(squash(evidence), " ")
    return F.contains(context, squash(evidence)) | (sim.word_overlap(words, F.split(context, " ")) >= 0.70)


#: Fixed value: window score from which an evidence text counts as found.
NEAR = 75


def gate(rows: DataFrame, settings: Settings = DEFAULTS, near: int | None = NEAR) -> DataFrame:
    """Deterministic validation of claimed evidence elements, in one row.

    ``rows`` has the four flags, ``*_evidence``, ``*_confidence``, ``overall_confidence``,
    ``context`` and ``sources``. Flags and confidences are replaced by the checked ones;
    ``rule, meat_valid, tier, review, issues`` are added. Each step is one projection over the
    columns of the step before. A text that is neither found verbatim nor by its words is
    scored against the context's windows; the scorer gets nulls for all others. ``near`` is the
    score from which it counts as found; None leaves the windows out.
    """
    ev = lambda e: F.trim(F.coalesce(F.col(f"{e}_evidence"), F.lit("")))
    low_sources = F.transform("sources", lambda s: F.lower(F.coalesce(s, F.lit(""))))
    hits = lambda names: F.arrays_overlap(F.col("_s"), tx.literal_array(names))
    m, e, a, t = (F.col(x) for x in ELEMENTS)
    count = lambda: sum((F.col(x).cast("int") for x in ELEMENTS), F.lit(0))
    # claimed elements against the core rule, and each text against the context
    rows = rows.withColumns({"_ctx": squash(F.col("context")), "_s": low_sources})
    stated = {x: F.col(x) & (F.length(ev(x)) >= 5) for x in ELEMENTS}
    rows = rows.withColumns({f"_g_{x}": F.coalesce(~s | grounded(ev(x), F.col("_ctx")), F.lit(False)) for x, s in stated.items()})
    open_ = lambda x, c: F.when(~F.col(f"_g_{x}"), c)
    score = lambda x: F.lit(0) if near is None else sim.partial_ratio(open_(x, squash(ev(x))), open_(x, F.col("_ctx")))
    rows = rows.withColumns({f"_n_{x}": score(x) for x in ELEMENTS})
    rule = F.when(a & (m | e | t), PASS_A).when(t & (m | e), PASS_T).when(count() >= 2, PASS_N).otherwise(FAIL)
    states = {
        f"_{x}": F.when(~F.col(x), "absent").when(F.length(ev(x)) < 5, "short")
        .when(F.col(f"_g_{x}") | (F.col(f"_n_{x}") >= (101 if near is None else near)), "found").otherwise("missing")
        for x in ELEMENTS
    }
    rows = rows.withColumns({"rule": rule, **states})
    issue = lambda test, text: F.when(test, F.lit(text))
    issues = [
        issue((F.col("rule") == FAIL) & ~a, "assessment missing"),
        issue((F.col("rule") == FAIL) & ~(m | e | t), "no management"),
    ] + [issue(F.col(f"_{x}") == "short", f"{x}: no evidence text") for x in ELEMENTS] + [
        issue(F.col(f"_{x}") == "missing", f"{x}: evidence not in source") for x in ELEMENTS]
    conf = F.col("overall_confidence")
    tier = F.when(conf >= settings.evidence_high, "high").when(conf >= settings.evidence_medium, "medium").otherwise("low")
    missing = reduce(lambda x, y: x | y, [F.col(f"_{x}") == "missing" for x in ELEMENTS])
    flags = {
        x: F.when(F.col(f"_{x}") == "missing", F.length(ev(x)) <= 15).otherwise(F.col(f"_{x}") == "found") for x in ELEMENTS
    }
    confs = {
        f"{x}_confidence": F.when(F.col(f"_{x}") == "short", F.lit(0.0))
        .when(F.col(f"_{x}") == "missing", F.greatest(F.lit(0.0), F.col(f"{x}_confidence") - 0.4))
        .otherwise(F.col(f"{x}_confidence")) for x in ELEMENTS
    }
    rows = rows.withColumns({
        "_issues": F.array(*issues), "tier": tier, "review": missing | (tier != "high"), "meat_valid": F.col("rule") != FAIL,
        **flags, **confs,
    })
    # past conditions: wording outside active sections, then history-only sections
    past = ~hits(kn.TEMPORAL_ACTIVE_SECTIONS) & tx.contains_any(F.lower(ev("assessment")), kn.TEMPORAL_MARKERS)
    history = hits(kn.HISTORY_SECTIONS) & ~hits(kn.GATE_ACTIVE_SECTIONS)
    rows = rows.withColumns({"_past": past, "_history": history})
    managed = (m.cast("int") + e.cast("int") + t.cast("int")) >= 2
    off = F.col("_past") | F.col("_history")
    rows = rows.withColumns({
        "_issues": F.concat("_issues", F.array(
            issue(F.col("tier") == "low", "low confidence"), issue(F.col("_past"), "past condition"),
            issue(F.col("_history") & a & ~F.col("_past"), "history only"))),
        "assessment": a & ~off,
        "assessment_confidence": F.when(F.col("_past") | (F.col("_history") & a), F.lit(0.0)).otherwise(F.col("assessment_confidence")),
        "meat_valid": F.when(F.col("_history"), managed).otherwise(F.col("meat_valid") & ~F.col("_past")),
        "rule": F.when(F.col("_history") & managed, F.lit(PASS_H)).otherwise(F.col("rule")),
    })
    # negation in the evidence takes the element away
    denied = {f"_{x}": F.col(x) & tx.contains_any(F.lower(ev(x)), kn.NEGATION_MARKERS) for x in ELEMENTS}
    rows = rows.withColumns(denied)
    rows = rows.withColumns({
        **{x: F.col(x) & ~F.col(f"_{x}") for x in ELEMENTS},
        **{f"{x}_confidence": F.when(F.col(f"_{x}"), F.lit(0.0)).otherwise(F.col(f"{x}_confidence")) for x in ELEMENTS},
        "_issues": F.concat("_issues", F.array(*[issue(F.col(f"_{x}"), f"{x}: negated") for x in ELEMENTS])),
    })
    # the core rule again on what is left, then the audit length of the texts
    holds = (a & (m | e | t)) | (t & (m | e)) | (count() >= 2)
    rows = rows.withColumns({
        "rule": F.when(~holds & F.col("rule").endswith("[PASS]"), F.lit(REVERSED)).otherwise(F.col("rule")),
        "meat_valid": F.col("meat_valid") & holds,
    })
    short = {x: F.col(x) & (F.length(ev(x)) < 8) for x in ELEMENTS}
    solid = reduce(lambda x, y: x | y, [F.col(x) & (F.length(ev(x)) >= 8) for x in ELEMENTS])
    valid = F.col("meat_valid")
    rows = rows.withColumns({
        "review": F.col("review") | (valid & reduce(lambda x, y: x | y, short.values())),
        "_issues": F.concat("_issues", F.array(
            *[issue(valid & s, f"{x}: text too short for audit") for x, s in short.items()], issue(valid & ~solid, "no verifiable evidence"))),
        "meat_valid": valid & solid,
    })
    return rows.withColumn("issues", F.array_compact("_issues")).drop("_issues", "_ctx", "_s", "_past", "_history", *[f"{p}{x}" for x in ELEMENTS for p in ("_", "_g_", "_n_")])


def evidence_tier(rows: DataFrame) -> DataFrame:
    """``meat_tier`` and ``final_status`` of gated rows."""
    n = sum((F.col(x).cast("int") for x in ELEMENTS), F.lit(0))
    hits = lambda names: F.arrays_overlap(F.transform("sources", F.lower), tx.literal_array(names))
    valid = F.col("meat_valid")
    tier = (
        F.when(valid & (n >= 3), "strong_evidence").when(valid & (n >= 2), "moderate_evidence")
        .when(n >= 1, "weak_evidence").otherwise("no_meat")
    )
    past = hits(kn.HISTORY_SECTIONS) & ~hits(kn.TEMPORAL_ACTIVE_SECTIONS)
    rows = rows.withColumn("meat_tier", tier)
    status = (
        F.when((F.col("meat_tier") == "no_meat") & past, "history_only").when(valid & F.col("review"), "review")
        .when(valid, "valid").otherwise("invalid")
    )
    return rows.withColumn("final_status", status)


def evidence_summary(rows: DataFrame) -> DataFrame:
    n = lambda s: F.count_if(F.col("final_status") == s)
    return rows.groupBy("doc_id").agg(
        F.count("*").alias("total"), n("valid").alias("valid"), n("review").alias("review_required"),
        n("invalid").alias("invalid"), n("history_only").alias("history_only"),
        F.bround((n("valid") + n("review")) / F.count("*"), 2).alias("success_rate"),
    )


# --- verification of stated evidence ------------------------------------------------
def in_document(evidence: Column, body: Column) -> Column:
    """Strict test: verbatim, or 30 percent of the long words of the first 80 characters; ``body`` is the lower-case text."""
    low = F.trim(F.lower(evidence))
    words = F.filter(F.split(F.substring(low, 1, 80), r"\s+"), lambda w: F.length(w) > 3)
    return F.contains(body, low) | let(words, lambda ws: (F.size(ws) > 0) & (
        F.size(F.filter(ws, lambda w: F.contains(body, w))) >= F.size(ws) * 0.3))


def trimmed(text: Column) -> Column:
    """Without white space at both ends; a null text is empty."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), r"\A\s+|\s+\z", "")


def in_document_lenient(evidence: Column, body: Column, spaced: Column) -> Column:
    """Lenient test: first 40 characters, any phrase of four characters, or half the distinct words of three letters.

    ``body`` is the lower-case text, ``spaced`` the same with blanks for all but letters. A text without
    such words can't be held against the note's words and passes.
    """
    def held(low: Column) -> Column:
        phrases = F.filter(F.transform(F.split(low, "[,;]"), trimmed), lambda p: F.length(p) >= 4)
        words = F.array_distinct(F.regexp_extract_all(low, F.lit("[a-z]{3,}"), F.lit(0)))
        cut = low.rlike("[,;]") | (F.length(low) > 40)  # else the only phrase was looked for
        return F.contains(body, F.substring(low, 1, 40)) | (cut & F.exists(phrases, lambda p: F.contains(body, p))) | let(words, lambda ws: (
            F.size(F.filter(ws, lambda w: F.contains(spaced, F.concat(F.lit(" "), w, F.lit(" "))))) >= F.size(ws) * 0.5))

    return let(trimmed(F.lower(evidence)), held)


def verify_evidence(rows: DataFrame, docs: DataFrame) -> DataFrame:
    """Evidence texts that the note doesn't hold by the lenient test become empty, as do null ones; score and grade follow.

    Texts of fewer than five characters are left as they are. Adds ``meat_score`` (elements with a text) and
    ``meat_grade``. Rows whose note is missing keep short texts only, and those without a word to look for.
    """
    joined = with_texts(rows, docs.select("doc_id", F.lower("text").alias("_body")))
    body, texts = F.coalesce("_body", F.lit("")), [f"{e}_evidence" for e in ELEMENTS]
    joined = joined.withColumn("_spaced", F.concat(F.lit(" "), F.regexp_replace(body, "[^a-z]+", " "), F.lit(" ")))
    stays = lambda c: (F.length(trimmed(F.col(c))) < kn.LEAST_VERIFIED) | in_document_lenient(F.col(c), body, F.col("_spaced"))
    out = joined.withColumns({c: F.when(stays(c), F.coalesce(c, F.lit(""))).otherwise("") for c in texts}).drop("_body", "_spaced")
    score = sum(((trimmed(F.col(c)) != "").cast("int") for c in texts), F.lit(0))
    grade = F.lit(None).cast("string")
    for n, name in kn.MEAT_GRADES.items():
        grade = F.when(F.col("meat_score") == n, name).otherwise(grade)
    return out.withColumn("meat_score", score).withColumn("meat_grade", grade)


def unique_evidence(rows: DataFrame, element: str) -> DataFrame:
    """Within a document only the first row keeps the same evidence text.

    The first row of each text is found by partial aggregation, not a window.
    """
    key = F.trim(F.lower(F.col(f"{element}_evidence")))
    keyed = rows.withColumn("_key", F.nullif(key, F.lit("")))
    first = keyed.where("_key is not null").groupBy("doc_id", "_key").agg(F.min("ord").alias("_first"))
    out = keyed.join(first, ["doc_id", "_key"], "left")
    own = F.col("_key").isNull() | (F.col("ord") == F.col("_first"))
    return out.withColumn(f"{element}_evidence", F.when(own, F.col(f"{element}_evidence")).otherwise("")).drop("_key", "_first")
