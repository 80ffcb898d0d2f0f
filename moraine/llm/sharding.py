"""Sharding by weighted rendezvous hashing of stable record keys.

Every record scores each shard by ``-w / ln(u)``, where ``u`` in (0, 1) comes from
the MD5 of key and shard, and goes to the highest score. The score of a shard does
not depend on the others, so one more shard takes rows only into itself, and
about its weight's share of them. Only DataFrame functions are used.

Slots number the rows of a shard without gaps. Rows of a shard are split into
chunks by a hash of key and text; counts of the chunks give each chunk its first
slot, so no task ever orders a whole shard.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from moraine.llm.common import table

SHARDS = 40
#: Chunks of a shard. shards * CHUNKS rows of counts are the only data broadcast.
CHUNKS = 512
#: Bytes a row takes besides its text.
ROW_OVERHEAD = 16


def _score(key: Column, shard: Column, weight: Column) -> Column:
    digest = F.md5(F.concat_ws(":", key, shard.cast("string")))
    unit = (F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") + 0.5) / float(2**52)
    return -weight / F.log(unit)


def winner(key: Column, weights: list[float]) -> Column:
    """(score, back) of the shard of highest score, ``back`` being minus its number; the lower shard wins a tie."""
    scores = F.transform(
        F.sequence(F.lit(0), F.lit(len(weights) - 1)),
        lambda s: F.struct(_score(key, s, F.element_at(F.lit(weights), s + 1)).alias("score"), (-s).alias("back")),
    )
    return F.array_max(scores)


def rendezvous(key: Column, weights: list[float]) -> Column:
    """The shard of highest score."""
    return (-winner(key, weights).getField("back")).cast("int")


def shard_documents(docs: DataFrame, weights: list[float] | None = None, chunks: int = CHUNKS) -> DataFrame:
    """Place documents into ``len(weights)`` shards and number them there.

    The key is doc_id; a null doc_id is a key of its own, so such rows share a
    shard. A null text has size 16 and CRC 0. Repeated rows share the shard and
    get different slots. Extra input columns are ignored. Empty input, empty
    result. ``grown_shard`` is the shard after adding one of mean weight.
    """
    weights = weights or [1.0] * SHARDS
    new = len(weights)
    key = F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))
    chunk = F.pmod(F.xxhash64("doc_id", "text"), F.lit(chunks)).cast("int")
    # one more shard changes a row's only if its score beats the winner's
    beaten = _score(key, F.lit(new), F.lit(sum(weights) / new)) > F.col("won.score")
    won = (-F.col("won.back")).cast("int")
    placed = docs.select("doc_id", "text", winner(key, weights).alias("won"))
    placed = placed.select(
        "doc_id",
        (F.coalesce(F.octet_length("text"), F.lit(0)) + ROW_OVERHEAD).cast("long").alias("size"),
        F.crc32(F.coalesce(F.encode("text", "UTF-8"), F.lit(b""))).alias("text_crc32"),
        F.lit("key").alias("law"),
        won.alias("shard"),
        F.when(beaten, F.lit(new)).otherwise(won).alias("grown_shard"),
        chunk.alias("chunk"),
    )
    starts = (
        docs.select(rendezvous(key, weights).alias("shard"), chunk.alias("chunk"))
        .groupBy("shard", "chunk")
        .agg(F.count("*").alias("n"))
        .withColumn(
            "start",
            F.sum("n").over(Window.partitionBy("shard").orderBy("chunk").rowsBetween(Window.unboundedPreceding, 0)) - F.col("n"),
        )
        .drop("n")
    )
    within = F.row_number().over(Window.partitionBy("shard", "chunk").orderBy("doc_id", "text_crc32"))
    return (
        placed.withColumn("within", within.cast("long"))
        .join(F.broadcast(starts), ["shard", "chunk"])
        .select("doc_id", "size", "text_crc32", "law", "shard", (F.col("start") + F.col("within") - 1).alias("slot"), "grown_shard")
    )


def op10_rendezvous_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document into forty shards of equal weight."""
    return shard_documents(table(spark, sf_dir, "documents"))
