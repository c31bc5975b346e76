"""Who speaks how often: censuses per recording and over all, band means, dominant roles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def first_seen_mode(rows: DataFrame, keys: list[str], value: str, order: Column) -> DataFrame:
    """The most frequent value of each key; of equals the one that came first."""
    counts = rows.groupBy(*keys, value).agg(F.count("*").alias("_n"), F.min(order).alias("_first"))
    rank = F.row_number().over(W.partitionBy(*keys).orderBy(F.desc("_n"), "_first"))
    return counts.withColumn("_r", rank).filter("_r = 1").drop("_r", "_n", "_first")


def entropy_of(rows: DataFrame, keys: list[str], value: str, name: str) -> DataFrame:
    """Shannon entropy in bits of value's frequencies within each key: two aggregations, the first map-side."""
    counts = rows.groupBy(*keys, value).count()
    n = F.sum("count")
    bits = F.log2(n) - F.sum(F.col("count") * F.log2("count")) / n
    return counts.groupBy(*keys).agg(F.round(F.abs(bits), 3).alias(name))


def parliament(rows: DataFrame, keys: list[str], role: str = "role", domain: str = "domain", band: str = "dominant_band") -> DataFrame:
    """Voices, percentages of domains, and diversity of roles (democracy) and bands (niches) of each key."""
    share = lambda d: (100.0 * F.count_if(F.col(domain) == d) / F.count("*")).alias(f"pct_{d}")
    base = rows.groupBy(*keys).agg(F.count("*").alias("total_voices"), *[share(d) for d in ("biophony", "geophony", "anthrophony", "transition")], F.count_distinct(role).alias("n_roles"))
    return base.join(entropy_of(rows, keys, role, "democracy_index"), keys).join(entropy_of(rows, keys, band, "niche_partitioning"), keys)


def parliament_rollup(rows: DataFrame, key: str, role: str = "role") -> DataFrame:
    """Role counts of each key and, where it is null, of all: one grouping-sets pass."""
    return rows.groupingSets([[key, role], [role]], key, role).agg(F.count("*").alias("voices"))


def reels(events: DataFrame, role: str = "role", order: tuple[str, ...] = ("event_id",), most: int = 24, least: int = 2) -> DataFrame:
    """Up to `most` clips, in event order, of every role that has at least `least`.

    Clips are counted apart, in parts, so that the ranking keeps no more than `most` rows of a role and partition.
    """
    counts = events.groupBy(role).agg(F.count("*").alias("n_clips")).filter(F.col("n_clips") >= least)
    placed = events.withColumn("clip_no", F.row_number().over(W.partitionBy(role).orderBy(*order))).filter(F.col("clip_no") <= most)
    return placed.join(counts, role)


def band_means(rows: DataFrame, keys: list[str], energies: str, bands: list[str]) -> DataFrame:
    """Mean energy of each band, a column a band. energies: array of (ord, name, energy), in which a name may be missing."""
    one = rows.select(*keys, F.explode(energies).alias("_e"))
    return one.groupBy(*keys).agg(*[F.round(F.avg(F.when(F.col("_e.name") == b, F.col("_e.energy"))), 4).alias(b) for b in bands])


def totals(recordings: DataFrame, events: DataFrame) -> DataFrame:
    """One row of a batch: files, silent files, events, events with a clip, and roles."""
    heard = events.agg(F.count("*").alias("n_events"), F.count_if(F.col("clip_path").isNotNull()).alias("n_clips"), F.count_distinct("role").alias("n_roles"))
    silent = recordings.join(events.select("recording").distinct(), "recording", "left_anti").agg(F.count("*").alias("n_silent"))
    return recordings.agg(F.count("*").alias("n_files")).crossJoin(silent).crossJoin(heard)  # three tables of one row each
