"""From raw documents to token ids, in five stages.

Each stage takes what its predecessor kept and returns it with the columns of
``documents``; the last returns token ids and decoded text. Between stages the rows are Parquet in
the folder that all executors share, so a lost executor costs a stage's tasks.

Null and empty texts pass every stage but the third, which keeps one of them; rows
that repeat whole are decided alike, and the third keeps one. Ids may be null or
repeat: texts of one id are told apart. Empty tables give empty results.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from moraine.llm import bpe, decontaminate, line_dedup, simhash, toxicity
from moraine.llm.common import discard, materialize, table

#: Words that a task keeps with their ids: executors also hold what the other stages left.
WORDS_KEPT = 100_000


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity model does not reject; null and empty texts stay."""
    return toxicity.keep_clean(docs, table(spark, sf_dir, "labels"))


def drop_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without lines that another line stands for; those that lose all lines go, null and blank texts stay."""
    return line_dedup.dedup_lines(spark, docs)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates, the least id, nulls last; texts without words are one group."""
    return simhash.keep_one(spark, docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item; null and empty texts hold none."""
    return decontaminate.keep_clean(spark, docs, table(spark, sf_dir, "benchmark"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document that is left, and the text decoded from them; none and "" for null or empty texts."""
    return bpe.encode_documents(docs, bpe.default_path(), kept=WORDS_KEPT)


STAGES = [
    ("toxicity", drop_toxic),
    ("line dedup", drop_lines),
    ("simhash near-dedup", drop_near_duplicates),
    ("benchmark decontamination", drop_contaminated),
    ("bpe encoding and decoding", encode),
]

#: SimHash and learned scores are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = table(spark, sf_dir, "documents")
    written = None
    for name, stage in STAGES[:-1]:
        docs = materialize(spark, stage(spark, docs, sf_dir), name.replace(" ", "-"))
        if written is not None:
            discard(spark, written)
        written = docs
    return STAGES[-1][1](spark, docs, sf_dir)
