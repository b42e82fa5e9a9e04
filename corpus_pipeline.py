"""The corpus pipeline: language identification, near-duplicates, repeated passages, packing.

Each stage takes (spark, docs, sf_dir); docs has the columns of `documents`, and all stages but the last return
them. Nulls, empty texts, repeated rows and empty tables have the results that the operators' modules define:
texts without words go in the first stage, and rows that share a doc_id are one document from the second on.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spanwright.llm import langid, neardup, packing, substring
from spanwright.llm.common import cut, table
from spanwright.session import ship


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents whose language is accepted (operator 6)."""
    ship(spark)
    return langid.identify(docs, keep=True)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates, the one of least doc_id, and all others (operator 3)."""
    ship(spark)
    return neardup.drop_near_duplicates(docs)


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents without passages that occurred before; n_chars counts what is left (operator 2)."""
    ship(spark)
    cut = substring.cut_repeats(docs)
    return cut.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else cut


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Where each piece of each document goes (operator 1)."""
    ship(spark)
    return packing.best_fit_pack(docs)


STAGES = [
    ("language_id", language_id),
    ("near_dedup", near_dedup),
    ("substring_dedup", substring_dedup),
    ("best_fit_packing", best_fit_packing),
]
#: Sequential packing and signatures aren't expressible; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages applied to `documents` in turn; what a stage keeps is written once, to the shared folder, and read by the next."""
    docs = table(spark, sf_dir, "documents")
    for n, (_, stage) in enumerate(STAGES, 1):
        docs = stage(spark, docs, sf_dir)
        docs = cut(docs) if n < len(STAGES) else docs
    return docs
