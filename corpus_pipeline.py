"""Corpus pipeline: language ID, exact dedup, near-dedup, personal data, packing.

Each stage takes (spark, docs, sf_dir) and works on all documents that the one before it kept; all but the last
return the columns of documents, and others that docs may have. Null texts count as empty, rows with null ids are documents,
rows that repeat an id are judged each by its own text, and an empty table stays empty.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quillframe.llm.common import give_back, remove, workspace
from quillframe.llm.exact_dedup import drop_exact_duplicates
from quillframe.llm.langid import fit, keep_identified
from quillframe.llm.near_copies import drop_near_copies
from quillframe.llm.packing import pack_documents
from quillframe.llm.pii import mask_pii
from quillframe.session import ship


def begin(spark: SparkSession) -> None:
    """Before each stage: the package is there, and executors have returned the memory of the stages before."""
    ship(spark)
    give_back(spark)


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is recognised; those rejected go: null and empty texts, those without letters or with fewer than four
    bytes of them, and those whose two smallest sizes are equal or nearly so, whole and word by word."""
    begin(spark)
    return keep_identified(docs, fit(docs))


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of texts that are equal but for white space: the longest, then that of the smallest id (null
    last), then the earliest row."""
    begin(spark)
    return drop_exact_duplicates(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies (five-word Jaccard similarity of 0.8 or more): that of the smallest id (null last)."""
    begin(spark)
    return drop_near_copies(docs)


def pii(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with personal data masked; all stay, null texts as they are."""
    begin(spark)
    return mask_pii(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents with their place in the packed sequences; an empty text is one piece."""
    begin(spark)
    return pack_documents(docs)


STAGES = [
    ("language_id", language_id),
    ("exact_dedup", exact_dedup),
    ("near_dedup", near_dedup),
    ("pii", pii),
    ("packing", packing),
]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written to the shared folder and read again; only the last result stays."""
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, stage in STAGES:
        path = workspace(spark, f"pipeline-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
        if before:
            remove(spark, before)
        before = path
    return docs
