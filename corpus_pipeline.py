"""A corpus from raw documents to packed sequences, in five stages.

Each stage takes (spark, docs, sf_dir) and gives a DataFrame that is written
as Parquet and read again as the docs of the next; all but the last return the
columns of documents, whatever other columns there are and however they are
called. Nulls may stand in any column, ids may repeat; an empty table passes
through all stages empty.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexispark.llm import exact_dedup, language_id, packing, simhash, substring_dedup
from lexispark.llm.common import stored, table


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language can't be told go: null, empty and letterless texts, near-ties, and texts that no learned language's tree can code.

    Rows that repeat are judged alike; texts are judged whole. Of documents
    without any usable lang nothing can be learned, and all go.
    """
    return language_id.keep_identified(docs)


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of texts that are equal but for blanks the one with the smallest doc_id stays.

    A null text counts as empty, a null id comes after all others; of rows
    that repeat both id and text one stays.
    """
    return exact_dedup.keep_first(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked by SimHash, directly or through others, the one with the smallest doc_id stays.

    Null and blank texts have fingerprint 0 and are linked like any other; null
    ids come after all others; of rows that repeat both id and text one stays.
    """
    return simhash.keep_one(docs)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeated passages go from the texts; texts without one stay as they are. n_chars follows the text.

    Every row stays, also one whose whole text goes (its text is empty then)
    and one of a null text. Rows that repeat id and text are each other's
    repeats. Of passages that several documents share none is spared.
    """
    names = docs.columns
    found = substring_dedup.cut(docs, keep=tuple(names))
    out = {n: F.col("row").getField(n) for n in names}
    cut = F.col("n_removed") > 0
    out["text"] = F.when(cut, F.col("kept")).otherwise(out["text"])
    if "n_chars" in names:
        out["n_chars"] = F.when(cut, F.char_length("kept").cast("long")).otherwise(out["n_chars"])
    return found.select(*[out[n].alias(n) for n in names])


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document's tokens, in pieces of at most 4096, each with its place in a packed sequence.

    Null and empty texts are the end id alone; rows that repeat an id are
    documents like any other, null ids stay null. Ties of length are in any
    order, and sequence numbers are any numbers.
    """
    return packing.pack(docs, packing.default_vocabulary(), with_ids=False)


STAGES = [
    ("language_id", identify_language),
    ("exact_dedup", drop_copies),
    ("simhash", drop_near_copies),
    ("substring_dedup", cut_repeats),
    ("packing", pack),
]

#: SQL can't express the first and the last stage; tests hold run() against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = stored(docs, f"pipeline-{name}")
    return docs
