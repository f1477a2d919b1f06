"""What a list of diseases misses of a note, and what it states that the note doesn't."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import similarity as sim
from ..functions import text as tx
from ..functions.arrays import explode_rows, let
from ..knowledge import coverage as kc
from ..session import reliable_checkpoint
from . import mapping as mp
from .sections import strip


# --- items of the assessment that no name covers ------------------------------------------
def _first_word(item: Column) -> Column:
    return F.lower(F.regexp_extract(item, r"\S+", 0))


def assessment_items(text: Column) -> Column:
    """List items of the first assessment block; its lines that name something, if it has no list."""
    rest = F.regexp_extract(text, kc.BLOCK_START + r"([\s\S]*)", 1)
    block = F.split(rest, kc.BLOCK_END, 2)[0]
    named = lambda line: let(F.regexp_replace(_first_word(line), r"[,:;]+\z", ""), lambda w: ~w.isin(kc.SENTENCE_STARTS) & (F.length(w) >= 3))

    def of(b: Column) -> Column:
        listed = F.regexp_extract_all(b, F.lit(kc.LIST_ITEM), F.lit(1))
        plain = F.filter(F.regexp_extract_all(b, F.lit(kc.PLAIN_ITEM), F.lit(1)), named)
        return let(listed, lambda v: F.when(F.size(v) > 0, v).otherwise(plain))

    return let(F.coalesce(block, F.lit("")), of)


def is_missable(raw: Column, item: Column) -> Column:
    """Whether a block's item may be a diagnosis that is managed at this visit."""
    acted = item.rlike(kc.ACTION)
    return (
        F.length(item).between(5, 120) & ~_first_word(item).isin(kc.SKIP_STARTS) & ~tx.non_disease_phrase(item, F.lit(False))
        & ~item.rlike(kc.NOT_DISEASE) & ~raw.rlike(kc.STABLE_ONLY) & ~(item.rlike(kc.ORDER_ONLY) & ~acted) & ~(item.rlike(kc.INCIDENTAL) & ~acted)
    )


def missable_items(docs: DataFrame) -> DataFrame:
    """``doc_id, pos, disease``: items of each note's assessment that a coder should not miss."""
    items = F.transform(assessment_items(F.col("text")), lambda raw, i: F.struct(
        i.alias("pos"), raw.alias("raw"), F.regexp_replace(strip(raw), r":+\z", "").alias("disease")))
    kept = F.filter(items, lambda x: is_missable(x["raw"], x["disease"]))
    return explode_rows(docs, kept, "doc_id").select("doc_id", "pos", "disease")


def profiled(name: Column) -> Column:
    return F.struct(name.alias("name"), tx.name_variants(name).alias("keys"), sim.significant_words(name).alias("words"))


def without_same(items: DataFrame, names: DataFrame) -> DataFrame:
    """Items (``doc_id, disease``) that denote no condition of their document's ``names`` (``doc_id, name``).

    Names are combined before the shuffle and meet the items as one array per document, so no
    pair becomes a row. Blank names match nothing; a document without names keeps its items.
    """
    low = names.select("doc_id", F.trim(F.lower("name")).alias("name")).where("name <> ''").distinct()
    held = low.select("doc_id", profiled(F.col("name")).alias("p")).groupBy("doc_id").agg(F.collect_list("p").alias("_held"))
    own = items.withColumn("_own", profiled(F.trim(F.lower("disease"))))
    joined = own.join(held, "doc_id", "left")
    same = lambda a, b: sim.same_condition(a["name"], b["name"], a["keys"], b["keys"], a["words"], b["words"])
    found = F.coalesce(F.exists("_held", lambda b: same(F.col("_own"), b)), F.lit(False))
    return joined.where(~found).drop("_own", "_held")


def assessment_coverage(docs: DataFrame, kept: DataFrame, codes: DataFrame, excluded: DataFrame | None = None) -> DataFrame:
    """Rows for items of the assessment that neither names nor codes of ``kept`` cover.

    ``kept`` has ``doc_id, disease, icd_code``, ``excluded`` has ``doc_id, disease``. Left items
    are looked up once per distinct text; one whose code the document has already goes. The
    result has ``doc_id, pos, disease, icd_code, icd_description, meat_score`` (1: stated only).
    """
    names = kept.select("doc_id", F.col("disease").alias("name"))
    if excluded is not None:
        names = names.unionByName(excluded.select("doc_id", F.col("disease").alias("name")))
    # texts are searched once: the lookup reads the left items several times
    left = reliable_checkpoint(without_same(missable_items(docs), names))
    found = mp.search_combined(left.select(F.col("disease").alias("name")).distinct(), codes)
    coded = left.join(found.select(F.col("name").alias("disease"), "icd_code", F.col("description").alias("icd_description")), "disease", "left")
    bare = lambda c: F.upper(F.trim(c))
    have = kept.select("doc_id", bare(F.col("icd_code")).alias("_code")).where("_code <> ''").distinct()
    new = coded.withColumn("_code", bare(F.coalesce("icd_code", F.lit("")))).join(have, ["doc_id", "_code"], "left_anti")
    return new.select("doc_id", "pos", "disease", F.coalesce("icd_code", F.lit("")).alias("icd_code"), F.coalesce("icd_description", F.lit("")).alias("icd_description"), F.lit(1).alias("meat_score"))


# --- stated diseases that the note does not hold -------------------------------------------
RUN = 30


def has_long_run(snippet: Column, text: Column, least: int = RUN) -> Column:
    """Whether the two share ``least`` characters in a row: one of the snippet's stretches of that length is in the text."""
    windows = F.when(F.length(snippet) >= least, F.sequence(F.lit(1), F.length(snippet) - (least - 1))).otherwise(F.array().cast("array<int>"))
    return F.exists(windows, lambda i: F.contains(text, F.substring(snippet, i, F.lit(least))))


def words_of(text: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(text, F.lit("[a-z]{3,}"), F.lit(0)))


def found_by(name: Column, snippets: Column, text: Column, text_words: Column) -> Column:
    """The first way in which a stated disease is in the text, or null.

    ``text`` is lower-case. Ways: ``name``, ``variant``, ``words`` (four in five), ``snippet``
    (the first fifty characters of a quotation), ``run`` (thirty characters in a row of a
    quotation's first eighty), ``significant`` (seven in ten telling words).
    """
    low = F.lower(strip(name))
    share = lambda words: F.size(F.array_intersect(words, text_words)) / F.size(words)

    def judge(d: Column) -> Column:
        telling = F.array_except(d["words"], tx.literal_array(kc.WEAK_WORDS))
        quoted = F.filter(F.transform(F.coalesce(snippets, F.array().cast("array<string>")), lambda s: F.lower(strip(s))), lambda s: s != "")
        return (
            F.when(F.contains(text, d["low"]), "name")
            .when(F.exists(tx.name_variants(d["low"]), lambda k: F.contains(text, k)), "variant")
            .when((F.size(d["words"]) > 0) & (share(d["words"]) >= 0.8), "words")
            .when(F.exists(quoted, lambda s: F.contains(text, F.left(s, F.lit(50)))), "snippet")
            .when(F.exists(quoted, lambda s: has_long_run(F.left(s, F.lit(80)), text)), "run")
            .when((F.size(telling) > 0) & (share(telling) >= 0.7), "significant")
        )

    return let(F.struct(low.alias("low"), words_of(low).alias("words")), judge)


def mention_verify(rows: DataFrame, docs: DataFrame, name: str = "disease", snippets: str = "snippets") -> DataFrame:
    """``rows`` with ``found_by`` and ``reason`` (``HALLUCINATED`` where the note has nothing of it).

    Rows of a document come to its text once, as one array, and its words are listed once. Blank and null
    names go; rows whose document is missing or without text are not found.
    """
    columns = rows.columns
    stated = rows.where(F.coalesce(strip(F.col(name)), F.lit("")) != "")
    per = stated.groupBy("doc_id").agg(F.collect_list(F.struct(*columns)).alias("_rows"))
    joined = per.join(docs.select("doc_id", "text"), "doc_id", "left")

    def of(d: Column) -> Column:
        return F.transform(d["rows"], lambda r: F.struct(*[r[c].alias(c) for c in columns], found_by(r[name], r[snippets], d["text"], d["words"]).alias("found_by")))

    low = F.lower(F.coalesce("text", F.lit("")))
    doc = let(low, lambda t: F.struct(t.alias("text"), words_of(t).alias("words"), F.col("_rows").alias("rows")))
    out = explode_rows(joined.select("_rows", "text"), let(doc, of))
    return out.withColumn("reason", F.when(F.col("found_by").isNull(), F.lit("HALLUCINATED")))
