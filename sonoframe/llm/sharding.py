"""Sharding by a two-pass external shuffle.

Pass 1 scatters records uniformly, by seeded hashes of their whole rows, into buckets that fit in memory; a shard is a row of
buckets, as many as its own bytes need. Pass 2 brings each bucket into a canonical order, Fisher-Yates-shuffles it with a generator
seeded by shard and bucket, and lays it after the buckets before it, whose rows were counted. write_shards writes the buckets from
there, without another exchange. A rerun gives the same order, and a lost bucket is redone alone.

The shard follows from id and shard count (law "key"): the last j below n for which hash(id, j) mod (j + 1)
is 0. That is uniform, and one more shard takes rows only into itself.

Nulls: a null id is one key like any other; a null text is 16 bytes. Equal ids share a shard, but not a bucket, so a shard that holds
very many rows of one id has more buckets and no larger ones. Rows that are equal in all columns share a bucket and stay as many as
they were. An empty table gives an empty result. Input columns named like a result column are replaced by it.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sonoframe.llm import text_arrays as A
from sonoframe.llm.staging import apart, ship

OVERHEAD = 16


def shard_of(key: Column, n_shards: int, seed: int) -> Column:
    """Shard 0 to n_shards - 1 of a key."""
    lands = F.filter(F.sequence(F.lit(0), F.lit(n_shards - 1)), lambda j: F.pmod(F.xxhash64(key, j, F.lit(seed)), j + 1) == 0)
    return F.element_at(lands, -1)


def fisher_yates(n: int, seed: tuple[int, ...]) -> np.ndarray:
    """A uniform permutation of n places."""
    rng = np.random.Generator(np.random.PCG64(seed))
    order = np.arange(n)
    picks = rng.integers(0, np.arange(n, 0, -1)) + np.arange(n) if n else []
    for i, j in enumerate(picks):
        order[i], order[j] = order[j], order[i]
    return order


def shard_documents(docs: DataFrame, n_shards: int = 40, bucket_bytes: int = 64 << 20, seed: int = 29, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with size, law, shard, bucket, slot and grown_shard (the shard if there were one more)."""
    return apart(docs, [id_col, text_col], ["size", "law", "shard", "bucket", "slot", "grown_shard"], lambda own: _sharded(own, n_shards, bucket_bytes, seed, id_col, text_col))


def _sharded(docs: DataFrame, n_shards: int, bucket_bytes: int, seed: int, id_col: str, text_col: str) -> DataFrame:
    ship(docs.sparkSession)
    size = F.coalesce(F.octet_length(text_col), F.lit(0)).cast("long") + OVERHEAD
    key = F.coalesce(F.col(id_col).cast("string"), F.lit(""))
    shard = shard_of(key, n_shards, seed).cast("int")
    held = {r.s: r.b for r in docs.groupBy(shard.alias("s")).agg(F.sum(size).alias("b")).collect()}  # a row a shard
    n_buckets = F.element_at(F.array(*[F.lit(max(1, math.ceil(held.get(s, 0) / bucket_bytes))) for s in range(n_shards)]), F.col("_shard") + 1)
    results = ["size", "law", "shard", "bucket", "slot", "grown_shard"]
    kept = [c for c in docs.columns if c.lower() not in results]
    order = F.struct(key, F.xxhash64(text_col), F.xxhash64(*[F.col(f"`{c}`") for c in kept])).cast("struct<a:string,b:bigint,c:bigint>")
    scattered = docs.select(*[F.col(f"`{c}`") for c in kept], shard.alias("_shard"), order.alias("_order"))
    scattered = scattered.withColumn("_bucket", F.pmod(F.xxhash64("_order", F.lit(seed)), n_buckets).cast("int"))
    counts = scattered.groupBy("_shard", "_bucket").count()
    base = counts.select(F.col("_shard").alias("_s"), F.col("_bucket").alias("_b"), (F.sum("count").over(W.partitionBy("_shard").orderBy("_bucket")) - F.col("count")).alias("_base"))
    out = T.StructType([f for f in scattered.schema if f.name != "_order"]).add("_slot", "long")

    def shuffle_bucket(group: pa.Table, base: pa.Table) -> pa.Table:
        order = group["_order"].combine_chunks()
        order = pa.table([order.field(k) for k in range(3)], ["a", "b", "c"]).append_column("i", pa.array(np.arange(len(group))))
        first = order.sort_by([("a", "ascending"), ("b", "ascending"), ("c", "ascending")])["i"].to_numpy()
        moved = first[fisher_yates(len(first), (seed, group["_shard"][0].as_py(), group["_bucket"][0].as_py()))]
        A.trim()
        return group.drop_columns(["_order"]).take(pa.array(moved)).append_column("_slot", pa.array(base["_base"][0].as_py() + np.arange(len(moved))))

    placed = scattered.groupBy("_shard", "_bucket").cogroup(base.groupBy("_s", "_b")).applyInArrow(shuffle_bucket, out)
    made = [size.alias("size"), F.lit("key").alias("law"), F.col("_shard").alias("shard"), F.col("_bucket").alias("bucket"), F.col("_slot").alias("slot"), shard_of(key, n_shards + 1, seed).cast("int").alias("grown_shard")]
    return placed.select(*[F.col(f"`{c}`") for c in kept], *made)


def write_shards(sharded: DataFrame, path: str) -> None:
    """Folders shard=S/bucket=B of the rows of shard_documents, each file in the order of its slots: what pass 2 made is written where it was made."""
    sharded.sortWithinPartitions("shard", "bucket", "slot").write.mode("overwrite").partitionBy("shard", "bucket").parquet(path)
