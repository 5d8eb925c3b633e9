"""Words of documents: one rule for index and queries."""

from __future__ import annotations

import re
import unicodedata

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: What separates terms: everything but letters and digits of any script.
SEPARATOR = r"[^\p{L}\p{N}]+"
#: Term frequencies saturate here.
MAX_TF = 255


def terms(text: Column) -> Column:
    """Lower-case terms of a text, empty ones dropped; null gives null."""
    return F.filter(F.split(F.lower(text), SEPARATOR), lambda t: t != "")


def query_terms(word: str) -> list[str]:
    """The terms that a query word stands for."""
    kept = "".join(c if unicodedata.category(c)[0] in "LN" else " " for c in word.lower())
    return re.split(r" +", kept.strip()) if kept.strip() else []


def tokens(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, term): a row for each occurrence."""
    return docs.select(F.col(doc_id).alias("doc_id"), F.explode(terms(F.col(text))).alias("term"))


def postings(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, term, tf): occurrences counted up to MAX_TF."""
    counted = tokens(docs, doc_id, text).groupBy("doc_id", "term").agg(F.count("*").alias("tf"))
    return counted.select("doc_id", "term", F.least("tf", F.lit(MAX_TF)).cast("smallint").alias("tf"))
