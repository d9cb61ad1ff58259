"""A training-data pipeline over documents: each stage calls one operator of rivulet.llm.

A stage takes (spark, docs, sf_dir), works on all that the stage before kept, and returns the
columns of documents; the last adds those of its shards.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rivulet.llm import decontamination, jaccard_join, mixing, sharding, toxicity
from rivulet.llm.common import checkpoint, free_prefix, n_words, read
from rivulet.llm.queries import SHARD_BYTES, WEIGHTS

TOXIC = 0.3


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents below the threshold stay, each row by its own text; null, empty and wordless texts have the score of no evidence.

    Columns and repeated rows stay as they are; an empty table stays empty.
    """
    model = toxicity.fit(docs, read(spark, sf_dir, "labels"))
    score = f"{free_prefix(docs)}score"
    return docs.withColumn(score, toxicity.toxicity_score(docs, model)).where(F.col(score) < TOXIC).drop(score)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each component stays, and every row without shingles or an id.

    Rows with shingles that repeat an id are one document: the first of them by text, then by the
    other columns, stays. Null and blank texts have no copies; columns stay as they are, whatever
    their names; an empty table stays empty.
    """
    found = checkpoint(jaccard_join.jaccard_components(docs))
    x = free_prefix(docs)
    copies = checkpoint(found.where("n_shingles > 0 AND component_id <> doc_id").select(F.col("doc_id").alias(f"{x}copy")).distinct())
    small = F.broadcast(copies) if copies.count() <= jaccard_join.BROADCAST_IDS else copies  # else the texts are shuffled
    kept = docs.join(small, F.col("doc_id") == F.col(f"{x}copy"), "left_anti")
    repeated = checkpoint(found.where("n_shingles > 0 AND doc_id IS NOT NULL").groupBy("doc_id").count().where("count > 1").select(F.col("doc_id").alias(f"{x}again")))
    if repeated.isEmpty():
        return kept
    again = kept.join(repeated, F.col("doc_id") == F.col(f"{x}again"), "left").withColumn(f"{x}again", F.col(f"{x}again").isNotNull() & (n_words(F.col("text")) > 0))
    columns = [F.col(f"`{c}`") for c in docs.columns]
    first = again.where(f"{x}again").groupBy("doc_id").agg(F.min(F.struct("text", *[F.col(f"`{c}`") for c in docs.columns if c != "text"])).alias(f"{x}row"))
    return again.where(f"NOT {x}again").select(*columns).unionByName(first.select(f"{x}row.*"))


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a benchmark item stay; null and blank texts hold none, rows that share an id go together.

    Columns and repeated rows stay as they are; an empty table stays empty.
    """
    return decontamination.clean(docs, read(spark, sf_dir, "benchmark"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each row as often as the mix takes it; rows without words are in no budget and stay once.

    A row is carried whole beside its own plan, so repeated and null ids and the names of its
    columns change nothing; a null source is a source; an empty table stays empty.
    """
    plan = mixing.mix_plan(docs, WEIGHTS, carried=True)
    times = F.when(F.col("size") > 0, (F.col("taken") / F.col("size")).cast("int")).otherwise(1)
    out = plan.withColumn("_times", times).where("_times > 0")
    return out.withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("_times")))).select("row.*")


def deal_shards(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All rows with their shard; rows that share an id, or have none and share a text, share it. An empty table stays empty."""
    return sharding.shard(docs, SHARD_BYTES)


STAGES = [
    ("toxicity", drop_toxic),
    ("ngram_jaccard_join", drop_near_copies),
    ("benchmark_decontamination", drop_leaks),
    ("source_mixing", mix_sources),
    ("sharding", deal_shards),
]
#: SQL can't express the fitted model; tests/llm holds the stages against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each result is written once and read by the next."""
    docs = read(spark, sf_dir, "documents")
    for _, stage in STAGES:
        docs = checkpoint(stage(spark, docs, sf_dir))
    return docs
