"""Code lookup: exact, synonym and fuzzy matching of names against a code dictionary.

Everything runs on distinct names, joined back by the caller. ``names`` has ``name``;
``codes`` has ``code, description, hcc_status, seq``.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import similarity as sim
from ..functions import text as tx
from ..functions.arrays import constant_rows, let
from ..knowledge.synonyms import COMPLICATION_WORDS, CONTRADICTIONS, SYNONYMS
from ..settings import DEFAULTS, Settings


def prepared(codes: DataFrame) -> DataFrame:
    return codes.withColumn("desc_key", F.lower("description"))


def variant_array(cleaned: Column, synonyms=SYNONYMS) -> Column:
    """Search variants of a cleaned name: itself, substitutions, synonyms; longest term first."""
    rows = [{"t": t, "s": s, "r": rf"\b\Q{t}\E\b"} for t, s in sorted(synonyms, key=lambda p: -len(p[0]))]
    table = constant_rows(rows, "t string, s string, r string")
    hits = F.filter(table, lambda r: F.call_function("rlike", cleaned, r["r"]))
    more = F.flatten(F.transform(hits, lambda r: F.array(F.call_function("regexp_replace", cleaned, r["r"], r["s"]), r["s"])))
    return F.array_distinct(F.concat(F.array(cleaned), more))


def with_variants(names: DataFrame, synonyms=SYNONYMS) -> DataFrame:
    """``name, ord, variant``: the search variants of each name in order."""
    v = let(tx.clean_search_term(F.col("name")), lambda c: variant_array(c, synonyms))
    return names.select("name", F.posexplode(v).alias("ord", "variant"))


def exact_match(names: DataFrame, codes: DataFrame, synonyms=SYNONYMS) -> DataFrame:
    """First variant equal to a description (first code of it), confidence 1."""
    first = prepared(codes).groupBy("desc_key").agg(F.min_by(F.struct("code", "description"), "seq").alias("c"))
    hits = with_variants(names, synonyms).join(first, F.col("variant") == F.col("desc_key"))
    best = hits.groupBy("name").agg(F.min_by(F.struct("c", "variant"), "ord").alias("b"))
    return best.select("name", tx.format_code(F.col("b.c.code")).alias("icd_code"), F.col("b.c.description").alias("description"),
                       F.col("b.variant").alias("via"), F.lit(1.0).alias("confidence"))


#: Fixed value: words of a name that are searched alone.
SINGLE_WORDS = 3


def short_grams(c: Column) -> Column:
    """All texts of one and two characters in ``c``."""
    of = lambda n: F.transform(F.sequence(F.lit(1), F.length(c) - (n - 1)), lambda i: F.substring(c, i, F.lit(n)))
    return F.when(F.length(c) > 1, F.array_distinct(F.concat(of(1), of(2)))).when(F.length(c) == 1, F.array(c)).otherwise(F.array().cast("array<string>"))


def trigrams(c: Column) -> Column:
    n = F.length(c) - 2
    return F.when(n > 0, F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), lambda i: F.substring(c, i, F.lit(3))))).otherwise(
        F.array().cast("array<string>"))


def search_terms(names: DataFrame, synonyms=SYNONYMS, single_words: int | None = SINGLE_WORDS) -> DataFrame:
    """``name, tier, needles``: texts that a description must hold, per search strategy.

    ``single_words`` is how many of a name's words are also searched alone; None: all.
    """
    v = with_variants(names, synonyms)
    words = tx.search_words(F.col("variant"))
    # strategies in order: phrase and all words of each variant in turn, then single words
    tier = lambda kind, at: F.struct(F.lit(kind).alias("kind"), at.cast("int").alias("at")).alias("tier")
    phrase = v.select("name", tier(0, F.col("ord") * 2), F.array("variant").alias("needles")).where("variant <> ''")
    every = v.select("name", tier(0, F.col("ord") * 2 + 1), words.alias("needles")).where(F.size("needles") >= 2)
    all_words = tx.search_words(F.col("name"))
    some = all_words if single_words is None else F.slice(all_words, 1, single_words)
    single = names.select("name", F.posexplode(some).alias("i", "w")).where(
        F.length("w") >= 4).select("name", tier(1, F.col("i")), F.array("w").alias("needles"))
    return phrase.union(every).union(single)


def candidates(names: DataFrame, codes: DataFrame, synonyms=SYNONYMS) -> DataFrame:
    """``name, code, description, seq, tier``: descriptions that hold a search term.

    An inverted index of description trigrams replaces the all-pairs comparison: each term
    is looked up under its rarest trigram, then verified; a term without a text of three
    characters is looked up under the whole of its rarest short text. Every hit is kept.
    """
    dictionary = prepared(codes).select("code", "description", "desc_key", "seq")
    terms = search_terms(names, synonyms)
    # a short text is its own gram; those of longer ones are left out, a longer one is rarer
    long_ = F.exists("needles", lambda s: F.length(s) >= 3)
    keys = F.when(long_, F.flatten(F.transform("needles", trigrams))).otherwise(F.filter("needles", lambda s: s != ""))
    grams = terms.select("name", "tier", "needles", F.explode(F.array_distinct(keys)).alias("gram"))
    asked = grams.where(F.length("gram") < 3).select("gram").distinct()
    short = dictionary.select("seq", F.explode(short_grams(F.col("desc_key"))).alias("gram")).join(asked, "gram", "left_semi")
    index = dictionary.select("seq", F.explode(trigrams(F.col("desc_key"))).alias("gram")).unionByName(short)
    frequency = index.groupBy("gram").agg(F.count("*").alias("n"))
    # a trigram that no description has rules the term out: its count is 0
    rated = grams.join(frequency, "gram", "left").select("name", "tier", "needles", "gram", F.coalesce("n", F.lit(0)).alias("n"))
    probe = rated.groupBy("name", "tier").agg(F.min(F.struct("n", "gram", "needles")).alias("p")).where("p.n > 0").select(
        "name", "tier", F.col("p.gram").alias("gram"), F.col("p.needles").alias("needles"))
    hits = probe.join(index, "gram").select("name", "tier", "needles", "seq").join(dictionary, "seq")
    ok = hits.where(F.forall("needles", lambda s: F.contains(F.col("desc_key"), s)))
    return ok.groupBy("name", "code").agg(F.min("tier").alias("tier"), F.first("description").alias("description"), F.min("seq").alias("seq"))


def contradiction(search: Column, candidate: Column) -> Column:
    """Penalty for contradicting qualifiers: 30 for numbered ones, 25 for opposed terms."""
    numbered = F.lit(False)
    for prefix in ("type ", "stage ", "grade ", "class "):
        a, b = F.regexp_extract(search, prefix + r"(\w+)", 1), F.regexp_extract(candidate, prefix + r"(\w+)", 1)
        numbered = numbered | ((a != "") & (b != "") & (a != b))
    opposed = F.lit(False)
    for term, other in CONTRADICTIONS:
        # "unstable" holds "stable": the contradicting word counts only where it stands alone
        opposed = opposed | (F.contains(search, F.lit(term)) & candidate.rlike(rf"\b{other}"))
    return F.when(numbered, F.lit(30.0)).otherwise(F.lit(0.0)) + F.when(opposed, F.lit(25.0)).otherwise(F.lit(0.0))


def penalized(base: Column, search: Column, candidate: Column) -> Column:
    return F.greatest(F.lit(0.0), base - contradiction(search, candidate))


WITH = r"\bwith\s+(?!out\b)"


def complication(c: Column) -> Column:
    return tx.contains_any(c, COMPLICATION_WORDS) | c.rlike(WITH) | F.contains(c, F.lit("due to ")) | F.contains(c, F.lit("in "))


def candidate_score(base: Column, cleaned: Column, description: Column, variant_best: Column) -> Column:
    """Score of one candidate from its base similarity (0 to 100) and wording.

    ``variant_best`` is the best penalized score over the other search variants, or null.
    """
    d = description
    add = lambda test, v: F.when(test, F.lit(float(v))).otherwise(F.lit(0.0))

    def denial(words: Column) -> Column:
        # the prefixes are tried in order; the whole name ends the search, a word does not
        total, done = F.lit(0.0), F.lit(False)
        for prefix in ("without ", "not ", "no ", "absent "):
            whole = F.contains(d, F.concat(F.lit(prefix), cleaned))
            total = total + F.when(done, 0.0).when(whole, 30.0).when(_negated_word(words, d, prefix), 20.0).otherwise(0.0)
            done = done | whole
        return total

    long_words = F.filter(tx.search_words(cleaned), lambda w: F.length(w) >= 5)
    first = F.split(cleaned, " ")[0]
    trails = F.call_function("rlike", d, F.concat(F.lit(r"(?:,\s*and\s+|,\s+|;\s+|\band\s+)\Q"), first, F.lit(r"\E")))
    without = F.contains(cleaned, F.lit("without "))

    def specific(x: Column) -> Column:
        mine, theirs = complication(cleaned), complication(d)
        extra = F.size(F.filter(tx.literal_array(COMPLICATION_WORDS), lambda w: F.contains(d, w) & ~F.contains(cleaned, w)))
        penalty = F.when(theirs & ~mine, F.greatest(F.lit(5), F.least(F.lit(15), extra * 5))).otherwise(F.lit(0))
        bonus = F.when(mine, 0).when(F.contains(d, F.lit("without complications")), 4).when(F.contains(d, F.lit("unspecified")), 3).otherwise(0)
        return F.when(x >= 85, x - penalty + bonus).otherwise(x)

    # each step takes the score of the step before, computed once
    steps = [
        lambda s: F.when(F.contains(d, cleaned), F.least(F.lit(100.0), s + 5)).otherwise(s) - let(long_words, denial),
        lambda s: F.when(F.length(first) >= 4, F.when(d.startswith(first), F.least(F.lit(100.0), s + 15))
                         .when(trails, s - 20).otherwise(s)).otherwise(s),
        lambda s: F.greatest(s, F.coalesce(variant_best, s)) - add(without & d.rlike(WITH), 20)
        + add(without & F.contains(d, F.lit("without ")), 5),
        specific,
    ]
    s = penalized(base, cleaned, d)
    for step in steps:
        s = let(s, step)
    return s


def _negated_word(words: Column, d: Column, prefix: str) -> Column:
    return F.exists(words, lambda w: F.contains(d, F.concat(F.lit(prefix), w)))


def score(pairs: DataFrame, method: str = "token_set", synonyms=SYNONYMS) -> DataFrame:
    """Add ``score`` to candidate pairs; base similarity by token sets or by Jaccard.

    The token-set base is an Arrow UDF over pairs; ``jaccard`` stays native.
    """
    def base(a: Column, b: Column) -> Column:
        if method == "token_set":
            return sim.token_set_ratio(a, b).cast("double")
        words = lambda c: F.array_distinct(F.split(c, " "))
        return 100 * sim.jaccard(words(a), words(b))

    # one row per pair and search variant, so each base similarity is computed in one pass
    keyed = pairs.select(
        *pairs.columns, F.lower(tx.strip_diacritics(F.col("description"))).alias("_d"),
        F.posexplode(let(tx.clean_search_term(F.col("name")), lambda c: variant_array(c, synonyms))).alias("_o", "_v"),
    ).withColumn("_b", base(F.col("_v"), F.col("_d")))
    v = penalized(F.col("_b"), F.col("_v"), F.col("_d"))
    v = F.when(F.contains("_d", F.col("_v")), F.least(F.lit(100.0), v + 5)).otherwise(v)
    own = F.col("_o") == 0
    rest = [c for c in pairs.columns if c not in ("name", "code")]
    g = keyed.groupBy("name", "code").agg(
        F.max(F.when(own, F.struct(F.col("_b").alias("b"), F.col("_v").alias("v"), F.col("_d").alias("d"), *rest))).alias("_own"),
        F.max(F.when(~own, v)).alias("_vb"),
    )
    s = candidate_score(F.col("_own.b"), F.col("_own.v"), F.col("_own.d"), F.col("_vb"))
    return g.withColumn("score", s).select("name", "code", *[F.col(f"_own.{c}").alias(c) for c in rest], "score")


def top_codes(scored: DataFrame, k: int = 5, threshold: float = DEFAULTS.fuzzy_threshold) -> DataFrame:
    """The best ``k`` codes per name at or above the threshold; confidence is capped at 1.

    A name has at most one row per code of the dictionary.
    """
    w = Window.partitionBy("name").orderBy(F.col("score").desc(), "tier", "seq")
    kept = scored.where(F.col("score") >= threshold).withColumn("rank", F.row_number().over(w).cast("bigint")).where(F.col("rank") <= k)
    return kept.select("name", "rank", tx.format_code(F.col("code")).alias("icd_code"), "description", "score",
                       F.least(F.lit(1.0), F.bround(F.col("score") / 100, 3)).alias("confidence"))


def search_combined(names: DataFrame, codes: DataFrame, method: str = "token_set", synonyms=SYNONYMS, k: int = 5) -> DataFrame:
    """Exact match, else the best fuzzy one, with the ``k`` best as ``candidates``.

    Fuzzy work is done only for names without an exact match. ``candidates`` is an array of
    (rank, icd_code, description, confidence); an exact match is its only one.
    """
    exact = exact_match(names, codes, synonyms)
    rest = names.join(exact.select("name"), "name", "left_anti")
    entry = F.struct("rank", "icd_code", "description", "confidence")
    ranked = top_codes(score(candidates(rest, codes, synonyms), method, synonyms), k=k)
    best = ranked.groupBy("name").agg(F.array_sort(F.collect_list(entry)).alias("candidates")).withColumn("b", F.col("candidates")[0])
    one = F.struct(F.lit(1).cast("bigint").alias("rank"), "icd_code", "description", "confidence")
    hits = exact.select("name", "icd_code", "description", "confidence", F.lit("exact").alias("search_method"), F.array(one).alias("candidates")).unionByName(
        best.select("name", "b.icd_code", "b.description", "b.confidence", F.lit("fuzzy").alias("search_method"), "candidates"))
    return names.join(hits, "name", "left").withColumn("search_method", F.coalesce("search_method", F.lit("none")))


def lookup_by_code(rows: DataFrame, codes: DataFrame) -> DataFrame:
    """Add the description of ``icd_code``, dots ignored."""
    bare = codes.groupBy(tx.bare_code(F.col("code")).alias("_bare")).agg(F.min_by("description", "seq").alias("icd_description"))
    return rows.withColumn("_bare", tx.bare_code(F.col("icd_code"))).join(bare, "_bare", "left").drop("_bare")


CODE_FORMAT = r"(?i)\A[A-Z][0-9]{2}(?:\.[A-Z0-9]{1,5})?\z"


def validate_codes(rows: DataFrame, codes: DataFrame) -> DataFrame:
    """``valid, reason`` of ``icd_code``: placeholder, format, exact, dot-free or category match."""
    code = F.upper(F.trim(F.coalesce("icd_code", F.lit(""))))
    known = codes.select(F.upper(F.trim("code")).alias("c"))
    exact = known.select(F.col("c").alias("_code")).distinct().withColumn("_exact", F.lit(True))
    bare = known.select(F.replace("c", F.lit("."), F.lit("")).alias("_bare")).distinct().withColumn("_nodot", F.lit(True))
    cats = known.select(F.substring("c", 1, 3).alias("_cat")).distinct().withColumn("_known", F.lit(True))
    keyed = rows.withColumns({"_code": code, "_bare": F.replace(code, F.lit("."), F.lit("")), "_cat": F.substring(code, 1, 3)})
    j = keyed.join(exact, "_code", "left").join(bare, "_bare", "left").join(cats, "_cat", "left")
    reason = (
        F.when(F.col("_code").isin("", "—", "-"), "placeholder").when(~F.col("_code").rlike(CODE_FORMAT), "format")
        .when(F.col("_exact"), "exact").when(F.col("_nodot"), "dot_normalized").when(F.col("_known"), "category").otherwise("unknown")
    )
    return j.withColumn("reason", reason).withColumn("valid", F.col("reason").isin("exact", "dot_normalized", "category")).drop(
        "_code", "_bare", "_cat", "_exact", "_nodot", "_known")


def cross_validate(rows: DataFrame, codes: DataFrame, settings: Settings = DEFAULTS) -> DataFrame:
    """``match, match_score``: token-set score of name and description of its code."""
    j = lookup_by_code(rows, codes)
    s = sim.token_set_ratio(F.lower("disease"), F.lower("icd_description"))
    return j.withColumn("match_score", s.cast("double") / 100).withColumn(
        "match", F.coalesce(F.col("match_score") * 100 >= settings.cross_check, F.lit(False)))


def rank_blend(candidates_: DataFrame, rankings: DataFrame) -> DataFrame:
    """Blend model scores (.7) with string confidence (.3); order by rank, then confidence."""
    j = candidates_.join(rankings, ["name", "icd_code"])
    blended = F.bround(F.col("model_score") * 0.7 + F.col("confidence") * 0.3, 3)
    w = Window.partitionBy("name").orderBy("model_rank", F.col("confidence").desc(), "icd_code")
    return j.withColumn("confidence", blended).withColumn("place", F.row_number().over(w).cast("bigint"))


def assign_codes(found: DataFrame, codes: DataFrame, settings: Settings = DEFAULTS) -> DataFrame:
    """Final status of looked-up names: automatic, manual review or not found."""
    v = validate_codes(found.withColumn("disease", F.col("name")), codes)
    x = cross_validate(v, codes, settings)
    exact = F.col("search_method") == "exact"
    ok = F.col("icd_code").isNotNull() & (exact | F.col("valid"))
    conf = F.when(exact, F.lit(1.0)).when(F.col("match"), F.col("confidence")).otherwise(F.least("confidence", F.lit(0.5)))
    out = x.select(
        "name", F.when(ok, F.col("icd_code")).alias("icd_code"), F.when(ok, F.col("description")).alias("description"),
        F.when(ok, conf).otherwise(F.lit(0.0)).alias("confidence"),
        *(["candidates"] if "candidates" in found.columns else []),
        F.when(F.col("icd_code").isNull(), "none").when(~ok, "rejected_invalid").when(exact, "exact_match").otherwise("fuzzy_match").alias("mapping_method"),
    )
    return out.withColumn("status", F.when(F.col("icd_code").isNull(), "not_found").when(F.col("confidence") >= settings.auto_assign, "auto_assigned").otherwise("manual_review"))
