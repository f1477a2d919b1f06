"""Readers for notes, page tables, code dictionaries, replies and labelled data."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def read_parquet(spark: SparkSession, path: str, columns: list[str] | None = None) -> DataFrame:
    df = spark.read.parquet(path)
    return df.select(*columns) if columns else df


def code_lines(lines: DataFrame, line: str = "value", seq: str = "seq") -> DataFrame:
    """``CODE<blank>description`` lines to ``code, description, hcc_status, seq``.

    Blank and one-word lines are skipped; the last line of a code wins.
    """
    stripped = F.regexp_replace(F.col(line), r"(?U)\A\s+|\s+\z", "")
    parts = F.split(stripped, r"(?U)\s+", 2)
    rows = lines.select(parts.alias("parts"), F.col(seq).alias("seq")).where(F.size("parts") == 2)
    return latest_codes(rows.select(
        F.col("parts")[0].alias("code"), F.col("parts")[1].alias("description"),
        F.lit("Non-HCC").alias("hcc_status"), "seq",
    ))


def latest_codes(rows: DataFrame) -> DataFrame:
    """One row per code: the one with the highest ``seq`` (map-side combined)."""
    fields = [c for c in rows.columns if c not in ("code", "seq")]
    last = rows.groupBy("code").agg(F.max(F.struct("seq", *fields)).alias("last"))
    return last.select("code", *[F.col(f"last.{f}") for f in fields], F.col("last.seq").alias("seq"))


def code_table(df: DataFrame, seq: Column | None = None) -> DataFrame:
    """Code dictionary from a table whose columns are found by their headers."""
    heads = [(c, (c or "").strip()) for c in df.columns]
    code = next((c for c, h in heads if "decimal" in h.lower()), None) or next(
        (c for c, h in heads if h.upper() == "CODE"), heads[0][0]
    )
    description = next((c for c, h in heads if "description" in h.lower()), heads[min(2, len(heads) - 1)][0])
    hcc = next((c for c, h in heads if "hcc status" in h.lower()), None)
    clean = lambda c: F.nullif(F.trim(F.col(f"`{c}`").cast("string")), F.lit(""))
    rows = df.select(
        clean(code).alias("code"), clean(description).alias("description"),
        (F.coalesce(clean(hcc), F.lit("Non-HCC")) if hcc else F.lit("Non-HCC")).alias("hcc_status"),
        (seq if seq is not None else F.monotonically_increasing_id()).alias("seq"),
    )
    return latest_codes(rows.where("code is not null and description is not null and code <> 'None'"))


CODE_SHAPE = r"\A[A-Z][0-9][A-Z0-9.]{1,5}\z"


def code_profile(lines: DataFrame, line: str = "value") -> DataFrame:
    """One-row quality report of a code file."""
    text = F.regexp_replace(F.col(line), r"(?U)\A\s+|\s+\z", "")
    split = text.rlike(r"(?s)\A\S+\s+.*\z")
    code = F.regexp_extract(text, r"\A(\S+)\s", 1)
    state = (
        F.when(text == "", "empty").when(~split, "no_description")
        .when(~code.rlike(CODE_SHAPE), "bad_code")
        .when(F.contains(code, F.lit(".")), "dotted").otherwise("undotted")
    )
    n = lambda *s: F.count_if(F.col("state").isin(*s))
    return lines.select(state.alias("state")).agg(
        F.count("*").alias("total_lines"), n("empty").alias("empty_lines"),
        n("dotted", "undotted").alias("valid"), n("no_description").alias("missing_description"),
        n("bad_code").alias("invalid_code"), n("dotted").alias("with_dot"), n("undotted").alias("without_dot"),
    )


def assemble_pages(pages: DataFrame) -> DataFrame:
    """Pages to one text per document, in page order, joined by an empty line.

    The group of a document is as large as the text cell it produces.
    """
    ordered = F.array_sort(F.collect_list(F.struct("page_num", "text")))
    return pages.groupBy("doc_id").agg(ordered.alias("p")).select(
        "doc_id", F.array_join(F.transform("p", lambda x: x["text"]), "\n\n").alias("text"),
        F.size("p").cast("bigint").alias("page_count"),
    )


def classify_pages(pages: DataFrame) -> DataFrame:
    """Document type from its first three pages: digital, scanned or hybrid."""
    size = F.length(F.regexp_replace("text", r"(?U)\A\s+|\s+\z", ""))
    first = pages.select("doc_id", "page_num", size.alias("n")).where("page_num <= 3")
    g = first.groupBy("doc_id").agg(
        F.count("*").alias("checked"), F.count_if(F.col("n") > 100).alias("textual"),
        F.sum("n").alias("extractable_chars"), F.avg("n").alias("avg_chars"),
    )
    kind = F.when(F.col("textual") == F.col("checked"), "digital").when(F.col("textual") == 0, "scanned").otherwise("hybrid")
    g = g.withColumn("type", kind)
    return g.select(
        "doc_id", "type",
        F.when(F.col("type") == "digital", F.lit(0.95)).when(F.col("type") == "scanned", F.lit(0.90)).otherwise(F.lit(0.70)).alias("confidence"),
        (F.col("type") != "digital").alias("needs_ocr"), "extractable_chars", F.bround("avg_chars", 4).alias("avg_chars"),
    )


def catalog_page(documents: DataFrame, status: str | None = None, skip: int = 0, limit: int = 20) -> DataFrame:
    """A page of documents not deleted, with the total of the whole listing."""
    kept = documents.where(~F.col("deleted"))
    if status is not None:
        kept = kept.where(F.col("status") == status)
    total = kept.agg(F.count("*").alias("total"))
    page = kept.orderBy("doc_id").offset(skip).limit(min(limit, 100))
    return page.join(F.broadcast(total))  # total is a single row


def read_ground_truth(spark: SparkSession, path: str) -> DataFrame:
    """Labelled documents to one row per expected disease."""
    schema = (
        "documents array<struct<document_id string, diseases array<struct<"
        "name string, icd_code string, meat_valid boolean, negated boolean, section string>>>>"
    )
    docs = spark.read.schema(schema).json(path, multiLine=True).select(F.explode("documents").alias("d"))
    return docs.select("d.document_id", F.posexplode("d.diseases").alias("ord", "x")).select(
        F.col("document_id").alias("doc_id"), "ord", F.col("x.name").alias("disease"), "x.icd_code",
        F.coalesce("x.meat_valid", F.lit(False)).alias("meat_valid"),
        F.coalesce("x.negated", F.lit(False)).alias("negated"), "x.section",
    )


def read_replies(spark: SparkSession, path: str) -> DataFrame:
    """Raw model replies, one per document and stage, from JSON lines."""
    return spark.read.schema("doc_id bigint, stage string, raw string").json(path)
