"""From raw documents to shuffled training shards in five stages.

Each stage takes (spark, docs, sf_dir) and works on all that its predecessor kept; all but the last return
the columns of documents. Language ID drops documents without a language, near-dedup keeps one document of
each group of near copies, decontamination drops documents with benchmark passages, mixing repeats or drops
documents so that sources meet their targets, sharding gives each row its shard and place.

Nulls in any column, empty and very long texts, ties, repeated rows, empty tables and extra columns are handled as each stage's
operator says, and no stage fails on them: a null or letterless text goes with language ID; a null id is an id like any other, but one of
a group of near copies goes before one with an id; repeated rows are copies of each other, of which near-dedup keeps one; a null source
is a source. Columns that have the name of a result column are kept as they are by all stages but the last.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sonoframe.llm import decontaminate, langid, mixing, near_dup, sharding
from sonoframe.llm.staging import mark, release, staged, table


def identified(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language can be told: `und` goes."""
    found = langid.identify(docs, langid.learn(docs))
    return found.filter("lang_pred <> 'und'").select(*docs.columns)


def deduplicated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: the one with the smallest id.

    Where ids are null or repeated, rows are told apart by a key of their own: of a group the row with the smallest
    id stays, null ids last, and of rows of that id only one. Two texts of one id are each judged by themselves.
    Rows without words belong to no group and are all kept.
    """
    if docs.groupBy("doc_id").count().filter("doc_id IS NULL OR count > 1").isEmpty():
        gone = near_dup.near_duplicates(docs).filter("NOT kept").select("doc_id").distinct()
        return docs.join(gone, "doc_id", "left_anti").select(*docs.columns)
    keyed = staged(docs.withColumn("_row", F.monotonically_increasing_id()), "pipeline-keyed")
    found = near_dup.near_duplicates(keyed, id_col="_row").select(F.col("doc_id").alias("_row"), "component_id")
    first = keyed.select("_row", "doc_id").join(found, "_row").groupBy("component_id").agg(F.min(F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "_row")).alias("first"))
    return keyed.join(first.select("first._row"), "_row", "left_semi").select(*docs.columns)


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage of the benchmark."""
    return decontaminate.find_contamination(docs, table(spark, sf_dir, "benchmark")).filter("n_hit = 0").select(*docs.columns)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it."""
    return mixing.materialise(mixing.mix_sources(docs), docs.columns)


def sharded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Shard and place of every row."""
    placed = sharding.shard_documents(docs)
    return placed.select("doc_id", "lang", "source", "size", F.crc32(F.coalesce("text", F.lit(""))).alias("text_crc32"), "law", "shard", "slot", "grown_shard")


STAGES = [("language", identified), ("near_dedup", deduplicated), ("decontaminate", decontaminated), ("mix", mixed), ("shard", sharded)]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    start = mark()
    for name, stage in STAGES[:-1]:
        docs = staged(stage(spark, docs, sf_dir), f"pipeline-{name}")
        release(start, keep_last=True)  # the stage before, and what this one wrote on its way
    return STAGES[-1][1](spark, docs, sf_dir)
