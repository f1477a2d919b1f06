"""Evidence context of a mention, built inside the document's row.

Functions take the sentence array (or section text) of a document and a mention name, and
return text arrays; no sentence or section leaves its row.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as tx
from ..functions.arrays import constant_rows, explode_rows, let
from ..functions.keywords import has, word_groups
from ..knowledge import clinical as kn

#: What ``(?U)\s`` stands for.
WHITE = [chr(c) for c in (*range(0x09, 0x0E), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)]


def strip(c: Column) -> Column:
    """The text without white space at its ends; only one that has some is searched."""
    edged = F.substring(c, 1, 1).isin(WHITE) | F.substring(c, -1, 1).isin(WHITE)
    return F.when(edged, F.regexp_replace(c, r"(?U)\A\s+|\s+\z", "")).otherwise(c)


def sentence_array(text: Column) -> Column:
    """Non-empty sentences with their numbers (positions count empty pieces)."""
    pieces = F.transform(tx.sentence_pieces(text), lambda s, i: F.struct((i + 1).alias("number"), strip(s).alias("text")))
    return F.filter(pieces, lambda s: s["text"] != "")


def mentions_name(line: Column, name: Column) -> Column:
    return F.contains(F.lower(line), F.lower(name))


def primary_index(sentences: Column, name: Column) -> Column:
    """1-based place of the first sentence naming the disease, 0 if there is none."""
    return F.array_position(F.transform(sentences, lambda s: mentions_name(s, name)), True).cast("int")


def window(sentences: Column, at: Column, n: int) -> Column:
    """Sentences from ``n`` before to ``n`` after the place; empty for place 0."""
    first = F.greatest(at - n, F.lit(1))
    return F.when(at == 0, F.array().cast("array<string>")).otherwise(F.slice(sentences, first, at + n - first + 1))


def section_lines(text: Column, name: Column) -> Column:
    """Lines naming the disease or two of its long words, with one line before and two after.

    Without such a line the first eight lines stand in.
    """
    low = F.lower(name)
    keys = F.filter(F.split(low, r"\s+"), lambda w: F.length(w) >= 4)
    need = F.least(F.lit(2), F.size(keys))

    def pick(c: Column) -> Column:
        def hit(line: Column) -> Column:
            found = lambda s: F.size(F.filter(c["keys"], lambda w: F.contains(s, w)))
            return let(F.lower(line), lambda s: F.contains(s, c["name"]) | ((F.size(c["keys"]) > 0) & (found(s) >= c["need"])))

        return let(F.struct(c["lines"].alias("lines"), F.transform(c["lines"], hit).alias("hits")), lambda x: F.when(
            ~F.array_contains(x["hits"], True), F.slice(x["lines"], 1, 8)
        ).otherwise(F.filter(x["lines"], lambda _, i: F.array_contains(
            F.slice(x["hits"], F.greatest(i - 1, F.lit(1)), F.least(i + 2, F.lit(4))), True))))

    lines = F.filter(F.split(text, "\n"), lambda s: F.trim(s) != "")
    return let(F.struct(lines.alias("lines"), low.alias("name"), keys.alias("keys"), need.alias("need")), pick)


def _specific(name: Column, table: list) -> Column:
    """Keyword pattern of the first table entry whose disease word is in the name."""
    out = F.lit(None).cast("string")
    for disease, keywords in reversed(table):
        out = F.when(F.contains(F.lower(name), F.lit(disease)), F.lit(tx.any_of(keywords))).otherwise(out)
    return out


def _group(low_name: Column, table: list) -> Column:
    """Word group of the first table entry whose disease word is in the name; the general group if there is none."""
    out = F.lit(0)
    for k, (disease, _) in reversed(list(enumerate(table, 1))):
        out = F.when(F.contains(low_name, F.lit(disease)), F.lit(k)).otherwise(out)
    return out


#: The parts of a mention's context.
PARTS = ("primary", "around", "section", "related", "drugs", "labs")


def with_sentences(docs: DataFrame, parts=PARTS, text: str = "text") -> DataFrame:
    """Add ``sents``, their lower-case forms ``low`` and the word groups (``drugs``, ``labs``) that ``parts`` ask for."""
    docs = docs.withColumn("sents", F.transform(sentence_array(F.col(text)), lambda s: s["text"]))
    docs = docs.withColumn("low", F.transform("sents", lambda s: F.lower(s)))
    return docs.withColumns({p: word_groups(F.col("low"), p) for p in ("drugs", "labs") if p in parts})


def contexts(docs: DataFrame, parts, of, *keep: str, name: str = "disease") -> DataFrame:
    """``keep`` and the fields of the struct that ``of`` makes of the asked parts of each row's context.

    The struct leaves by an explode: fields taken from a column are computed once for each of them.
    """
    docs = with_sentences(docs, parts)
    return explode_rows(docs, F.array(let(build(docs, name, parts), of)), *keep)


def build(docs: DataFrame, name: str = "disease", parts=PARTS, text: str = "text", n: int = 5) -> Column:
    """The asked parts of the context of one mention as a struct; ``docs`` comes from ``with_sentences``.

    Distinct sentences with a word for the disease or a general one are its drugs and laboratory values.
    """
    # every column is bound before the first inner function: inlined there it would be computed again
    if tuple(parts) == ("section",):
        return F.struct(F.array_join(section_lines(docs[text], docs[name]), "\n").alias("section"))
    used = F.struct(*[docs[c].alias(a) for c, a in (("sents", "sents"), ("low", "low"), (text, "text"), (name, "name"))],
                    *[docs[p].alias(p) for p in ("drugs", "labs") if p in parts], F.lower(docs[name]).alias("low_name"))

    def of(d: Column) -> Column:
        def worded(p: str, table: list) -> Column:
            wanted = lambda g: F.filter(d["sents"], lambda _, i: let(F.get(d[p], i), lambda b: has(b, 0) | has(b, g)))
            return let(_group(d["low_name"], table), lambda g: F.array_distinct(wanted(g)))

        def gather(c: Column) -> Column:
            at = c["at"]
            primary = F.when(at > 0, F.get(d["sents"], at - 1)).otherwise(F.lit(""))
            made = {
                "primary": lambda p: p, "around": lambda p: window(d["sents"], at, n),
                "section": lambda p: F.array_join(section_lines(d["text"], d["name"]), "\n"),
                "related": lambda p: F.filter(d["sents"], lambda s, i: F.get(c["named"], i) & (s != p)),
                "drugs": lambda p: worded("drugs", kn.CONTEXT_DRUGS), "labs": lambda p: worded("labs", kn.CONTEXT_LABS),
            }
            return let(primary, lambda p: F.struct(*[made[x](p).alias(x) for x in parts]))

        named = F.transform(d["low"], lambda s: F.contains(s, d["low_name"]))
        return let(named, lambda v: let(F.struct(v.alias("named"), F.array_position(v, True).cast("int").alias("at")), gather))

    return let(used, of)


def sentence_profiles(sentences: Column, lines) -> Column:
    """Sentences with their lower-case form, general drug and laboratory bits and ``lines(text)``; made once per note."""
    one = lambda s: let(F.lower(s), lambda low: F.struct(
        s.alias("s"), low.alias("low"), low.rlike(tx.any_of(kn.GENERAL_DRUG_WORDS)).alias("drug"),
        low.rlike(tx.any_of(kn.GENERAL_LAB_WORDS)).alias("lab"), lines(s).alias("lines")))
    return F.transform(sentences, one)


def section_profiles(sections: Column, lines) -> Column:
    """Sections with their non-blank lines, each with its lower-case form and ``lines(text)``."""
    one = lambda t: F.struct(t.alias("s"), F.lower(t).alias("low"), lines(t).alias("lines"))
    return F.transform(sections, lambda s: F.struct(s["section"].alias("section"), F.transform(
        F.filter(F.split(s["text"], "\n"), lambda t: F.trim(t) != ""), one).alias("lines")))


def build_profiled(sents: Column, section: Column, name: Column, n: int = 5) -> Column:
    """Context of a mention from profiled sentences and section lines: ``text``, ``drugs`` and ``lines``."""
    low = F.lower(name)
    keys = F.filter(F.split(low, r"\s+"), lambda w: F.length(w) >= 4)
    fixed = F.struct(low.alias("name"), keys.alias("keys"), F.least(F.lit(2), F.size(keys)).alias("need"),
                     _specific(name, kn.CONTEXT_DRUGS).alias("drug"), _specific(name, kn.CONTEXT_LABS).alias("lab"))

    def parts(c: Column) -> Column:
        named = F.transform(sents, lambda s: F.contains(s["low"], c["name"]))
        keyed = lambda line: F.contains(line["low"], c["name"]) | ((F.size(c["keys"]) > 0) & (
            F.size(F.filter(c["keys"], lambda w: F.contains(line["low"], w))) >= c["need"]))
        special = lambda s, k: s[k] | F.coalesce(F.call_function("rlike", s["low"], c[k]), F.lit(False))

        def picked(hits: Column) -> Column:
            near = lambda i: F.array_contains(F.slice(hits, F.greatest(i - 1, F.lit(1)), F.least(i + 2, F.lit(4))), True)
            return F.when(F.array_contains(hits, True), F.filter(section, lambda _, i: near(i))).otherwise(F.slice(section, 1, 8))

        def gather(x: Column) -> Column:
            at = x["at"]
            first = F.greatest(at - n, F.lit(1))
            around = F.when(at == 0, F.slice(sents, 1, 0)).otherwise(F.slice(sents, first, at + n - first + 1))
            primary = F.when(at > 0, F.slice(sents, at, 1)).otherwise(F.slice(sents, 1, 0))
            main = F.coalesce(F.get(primary, F.lit(0))["s"], F.lit(""))
            related_ = F.filter(sents, lambda s, i: F.get(x["named"], i) & (s["s"] != main))
            drugs, labs = F.filter(sents, lambda s: special(s, "drug")), F.filter(sents, lambda s: special(s, "lab"))
            found = F.struct(primary.alias("p"), around.alias("a"), let(F.transform(section, keyed), picked).alias("section"), related_.alias("r"), drugs.alias("d"), labs.alias("l"), main.alias("main"))
            texts = lambda a: F.transform(a, lambda s: s["s"])
            return let(found, lambda f: F.struct(
                F.concat_ws(" ", f["main"], F.array_join(texts(f["a"]), " "), F.array_join(texts(f["section"]), "\n")).alias("text"), (F.size(f["d"]) > 0).alias("drugs"),
                F.flatten(F.concat(*[F.transform(f[k], lambda s: s["lines"]) for k in ("p", "a", "section", "r", "d", "l")])).alias("lines")))

        return let(named, lambda b: let(F.struct(b.alias("named"), F.array_position(b, True).cast("int").alias("at")), gather))

    return let(fixed, parts)


def size(c: Column) -> Column:
    """Characters of the primary, surrounding, section and related texts."""
    return (
        F.length(c["primary"]) + F.length(F.array_join(c["around"], " ")) + F.length(c["section"])
        + F.length(F.array_join(c["related"], " "))
    )


def summary(c: Column) -> Column:
    """Readable text block of a context."""
    block = lambda title, body, test: F.when(test, F.concat(F.lit(title), body))
    lines = lambda a: F.array_join(F.slice(a, 1, 5), "\n")
    return F.concat_ws(
        "\n\n",
        block("Primary mention: ", c["primary"], c["primary"] != ""),
        block("Surrounding context:\n", F.array_join(c["around"], "\n"), F.size(c["around"]) > 0),
        block("Section context:\n", F.substring(c["section"], 1, 1500), c["section"] != ""),
        block("Medications:\n", lines(c["drugs"]), F.size(c["drugs"]) > 0),
        block("Lab results:\n", lines(c["labs"]), F.size(c["labs"]) > 0),
    )


def fast_sections(rows: DataFrame, docs: DataFrame) -> DataFrame:
    """For each section of a document's mentions, the sentences that name one of them: ``doc_id, section, text``.

    ``rows`` has ``doc_id, ord, disease, section`` (null: unknown), ``docs`` has ``doc_id`` and ``sents``. Sentences
    follow the order of mentions, so one that names two stands twice; each is led by a blank.
    Mentions come to their document's sentences as one array; sections without a sentence are empty.
    """
    own = F.struct("ord", F.coalesce("section", F.lit("unknown")).alias("section"), F.lower("disease").alias("disease"))
    per = rows.where("disease is not null").groupBy("doc_id").agg(F.array_sort(F.collect_list(own)).alias("_m"))
    joined = per.join(docs.select("doc_id", "sents"), "doc_id", "left")

    def gather(d: Column) -> Column:
        naming = lambda m: F.transform(F.filter(d["s"], lambda s: F.contains(s["low"], m["disease"])), lambda s: F.concat(F.lit(" "), s["text"]))
        body = lambda name: F.array_join(F.flatten(F.transform(F.filter(d["m"], lambda m: m["section"] == name), naming)), "")
        return F.transform(F.array_distinct(F.transform(d["m"], lambda m: m["section"])), lambda n: F.struct(n.alias("section"), body(n).alias("text")))

    lowered = F.transform(F.coalesce("sents", F.array().cast("array<string>")), lambda s: F.struct(s.alias("text"), F.lower(s).alias("low")))
    return explode_rows(joined, let(F.struct(F.col("_m").alias("m"), lowered.alias("s")), gather), "doc_id")
