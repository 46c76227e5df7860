"""Cleaned views of the scan tables that most operators start from.

Each function has a SQL twin of the same meaning, for the checks.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pageloom.session import small_batches, table

#: White space and line ends as Python counts them, as a pattern for Java and RE2.
SPACE = r"[\x09-\x0d\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
LINE_END = r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x{85}\x{2028}\x{2029}]"

PAGES = "pages AS (SELECT doc_id, page, max(text) AS text FROM page_text GROUP BY doc_id, page)"
DOCS = """docs AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY doc_id
    ORDER BY seen_at DESC NULLS LAST, pages_done DESC NULLS LAST, status, chars_after DESC NULLS LAST) AS rn FROM ocr_document) WHERE rn = 1)"""
FINDINGS = """findings AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, page
    ORDER BY script NULLS LAST, lang NULLS LAST, dpi, rotate) AS rn FROM page_finding) WHERE rn = 1)"""
JOBS = """jobs AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY job_id
    ORDER BY seen_at DESC NULLS LAST, finished_at DESC NULLS LAST, status) AS rn FROM ocr_job) WHERE rn = 1)"""
TOKENS = "tokens AS (SELECT DISTINCT doc_id, page, tok_no, lang, conf, text FROM ocr_token)"
UPLOADS = "uploads AS (SELECT DISTINCT batch_id, ord, filename, declared_bytes, actual_bytes FROM upload_file)"


def pages(spark: SparkSession, d: str) -> DataFrame:
    """``doc_id, page, text``: each scanned page once."""
    small_batches(spark)
    return table(spark, d, "page_text").groupBy("doc_id", "page").agg(F.max("text").alias("text"))


def _first(df: DataFrame, keys: list[str], order: list) -> DataFrame:
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_rn")


def documents(spark: SparkSession, d: str) -> DataFrame:
    """The latest row of each document."""
    return latest_documents(table(spark, d, "ocr_document"))


def latest_documents(df: DataFrame) -> DataFrame:
    return _first(df, ["doc_id"], [F.desc_nulls_last("seen_at"), F.desc_nulls_last("pages_done"), F.col("status"), F.desc_nulls_last("chars_after")])


def findings(spark: SparkSession, d: str) -> DataFrame:
    """One detection finding for each sampled page."""
    small_batches(spark)
    return _first(table(spark, d, "page_finding"), ["doc_id", "page"], [F.asc_nulls_last("script"), F.asc_nulls_last("lang"), F.col("dpi"), F.col("rotate")])


def jobs(spark: SparkSession, d: str) -> DataFrame:
    """The latest state of each job."""
    return latest_jobs(table(spark, d, "ocr_job"))


def latest_jobs(df: DataFrame) -> DataFrame:
    return _first(df, ["job_id"], [F.desc_nulls_last("seen_at"), F.desc_nulls_last("finished_at"), F.col("status")])


def tokens(spark: SparkSession, d: str) -> DataFrame:
    """Recognised tokens, repeated rows once."""
    return table(spark, d, "ocr_token").select("doc_id", "page", "tok_no", "lang", "conf", "text").distinct()


def uploads(spark: SparkSession, d: str) -> DataFrame:
    """Uploaded files, repeated rows once."""
    return table(spark, d, "upload_file").select("batch_id", "ord", "filename", "declared_bytes", "actual_bytes").distinct()


def stripped(column) -> F.Column:
    """The text without white space at its ends."""
    return F.regexp_replace(column, rf"^{SPACE}+|{SPACE}+$", "")


def stripped_sql(expression: str) -> str:
    return f"regexp_replace({expression}, '^{SPACE}+|{SPACE}+$', '', 'g')"
