"""A corpus in five stages: toxic texts go, near duplicates fold, personal data is renamed, sources are mixed, the rest is packed.

Each stage takes ``(spark, docs, sf_dir)`` and works on all that the stage before it kept; what it
returns is written and read again before the next one begins. All but the last return the columns of
``documents``. Whatever other columns ``documents`` has, and whatever they are called, they pass
through. A null text counts as empty: it isn't toxic, has no duplicates, stays null, is drawn with its
cell and packed as one end id. Rows with a null id stand for themselves; rows that repeat an id are
judged by their texts but stay or go together as duplicates and in the draw. Of equal texts the
smallest id stays. An empty table gives no rows in every stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillmark.llm import common, minhash_dedup, mixing, packing, pii, queries, toxicity


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity score is under 0.7."""
    return toxicity.without_toxic(docs, common.table(spark, sf_dir, "labels"))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates, at a similarity of 0.8 or more: the one with the smallest id."""
    dropped = minhash_dedup.group_near_duplicates(docs, percent=80).filter("NOT kept").select(F.col("doc_id").alias("dropped_id")).distinct()
    same = docs["doc_id"].cast("long") == dropped["dropped_id"]
    return docs.join(dropped, same, "left_anti")


def rename_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts with format-preserving pseudonyms."""
    return pii.pseudonymise_texts(docs, queries.pii_key(spark))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents drawn to the target weights of source, language and topic."""
    return mixing.sample_documents(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents in sequences of 4096 tokens."""
    return packing.pack_documents(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("minhash_dedup", drop_near_duplicates),
    ("pii", rename_personal_data),
    ("mixing", mix_sources),
    ("packing", pack),
]

#: SQL can express neither the fitted classifier nor the tokenizer; tests/llm compares with plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = common.table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = common.written(stage(spark, docs, sf_dir), name)
    return docs
