"""Documents as pages of text: (doc_id, page, text), page numbers from 1."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..errors import RequestError

PAGES = "doc_id string, page int, text string"
MOST_BYTES = 25 * 1024 * 1024


def pdf_files(spark: SparkSession, path: str) -> DataFrame:
    """PDF files as (path, length, content), without those that can't be ones."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.pdf").load(path)
    return files.where(valid_pdf())


def valid_pdf(most: int = MOST_BYTES):
    """Not empty, not too long, and a PDF mark in the first 1024 bytes."""
    return F.col("length").between(1, most) & F.contains(F.substring("content", 1, 1024), F.lit(b"%PDF-"))


def page_counts(pages: DataFrame) -> DataFrame:
    return pages.groupBy("doc_id").agg(F.max("page").alias("n_pages"))


def search(pages: DataFrame, term: str) -> DataFrame:
    """Pages that hold a term, in any case."""
    if not term.strip():
        raise RequestError("a search needs a term")
    return pages.where(F.contains(F.lower("text"), F.lit(term.strip().lower())))


def search_all(pages: DataFrame, terms: list[str]) -> DataFrame:
    """Pages that hold all terms."""
    for term in terms:
        pages = search(pages, term)
    return pages


def has_text(pages: DataFrame, least: int = 50) -> DataFrame:
    return pages.groupBy("doc_id").agg((F.sum(F.length(F.regexp_replace("text", r"(?U)^\s+|\s+$", ""))) >= least).alias("has_text"))


def without_tables(pages: DataFrame, grids: DataFrame) -> DataFrame:
    return pages.select("doc_id", "page").join(grids.select("doc_id", "page").distinct(), ["doc_id", "page"], "left_anti")


def matching_profiles(pages: DataFrame, profiles: dict[str, list[str]]) -> DataFrame:
    """For each document the profiles of which all terms occur on some page, in one aggregation."""
    terms = list(dict.fromkeys(t for ts in profiles.values() for t in ts))
    found = pages.groupBy("doc_id").agg(*(F.bool_or(F.contains(F.lower("text"), F.lit(t.lower()))).alias(f"t{i}") for i, t in enumerate(terms)))
    names = []
    for name, needed in profiles.items():
        hit = F.lit(True)
        for t in needed:
            hit = hit & F.col(f"t{terms.index(t)}")
        names.append(F.when(hit, F.lit(name)))
    return found.select("doc_id", F.array_compact(F.array(*names)).alias("profiles"))
