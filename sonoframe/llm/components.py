"""Connected components of a distributed edge list by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sonoframe.llm.staging import staged, writers


def components(edges: DataFrame, name: str = "edges") -> DataFrame:
    """edges (a, b), longs -> (v, c): every vertex that has an edge, with the smallest vertex it reaches.

    Each round is two aggregations and two joins on thin rows, written to the shared folder; the driver sees a count of vertices. A star's
    centre is one key: its minimum is aggregated in parts and written, so that the join with it is one of two plain exchanges, which Spark
    splits where a key is large. The same aggregation tells whether all is stars already: then nobody has two smaller neighbours, nor a
    smaller and a larger one, and no further round is made. Self-loops and repeated edges change nothing; no edges give no rows.
    """
    few = writers(edges.sparkSession)
    now = staged(edges.filter("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct().coalesce(few), name)
    while True:
        both = now.union(now.select("v", "u"))
        up, down = F.count_if(F.col("v") < F.col("u")), F.count_if(F.col("v") > F.col("u"))
        least = staged(both.groupBy("u").agg(F.least(F.min("v"), "u").alias("m"), ((up > 1) | (up > 0) & (down > 0)).alias("more")).coalesce(few), f"{name}-least")
        if not least.agg(F.count_if("more")).first()[0]:
            break
        large = both.filter("v > u").join(least.select("u", "m"), "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        lower = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(lower, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(lower.select("u", "m"))
        now = staged(small.distinct().coalesce(few), name)
    return now.select(F.col("u").alias("v"), F.col("v").alias("c")).union(now.select(F.col("v"), F.col("v").alias("c")).distinct())
