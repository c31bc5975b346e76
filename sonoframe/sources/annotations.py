"""Annotation tables and clips on disk: reading expert intervals, evenly spaced samples, cutting clips, file tables."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sonoframe.functions.text import clip_path
from sonoframe.operators import ranges
from sonoframe.session import ship
from sonoframe.sources import files, wav


def intervals(spark: SparkSession, path: str, label: str = "Species") -> DataFrame:
    """file, ref, ref_onset_s, ref_offset_s, label of tab-separated selection tables; ends before their start are cut to it."""
    rows = spark.read.option("header", True).option("sep", "\t").csv(path).withColumn("file", F.regexp_extract(F.col("_metadata.file_path"), "([^/]+?)(\\.[^./]+)*$", 1))
    on, off = F.col("`Begin Time (s)`").try_cast("double"), F.col("`End Time (s)`").try_cast("double")
    named = rows.select("file", on.alias("ref_onset_s"), F.greatest(on, off).alias("ref_offset_s"), F.col(f"`{label}`").alias("label")).filter("ref_onset_s IS NOT NULL")
    return named.withColumn("ref", F.row_number().over(W.partitionBy("file").orderBy("ref_onset_s", "ref_offset_s", "label")) - 1)


def stride_sample(rows: DataFrame, order: str, limit: int) -> DataFrame:
    """`limit` rows at even distances in order; all if there are no more. Rows are numbered in range partitions, not in one task."""
    placed = ranges.numbered(rows, None, [order])
    n = placed.count()
    if n <= limit:
        return placed.drop("_i")
    # row i is one of int(j * n / limit) for some j
    j = F.ceil(F.col("_i") * limit / n)
    return placed.filter((j < limit) & (F.floor(j * n / limit) == F.col("_i"))).drop("_i")


def cut_clips(clips: DataFrame, root: str, organize_by: str = "role") -> DataFrame:
    """Writes each clip as a WAV at native rate below root (a folder that all executors share); path, event_index, clip.

    Only a clip's own samples are read. A clip is written under a name of its attempt and renamed (see files.put), so a repeated task leaves
    one whole file.
    """
    ship(clips.sparkSession)
    named = clips.withColumn("clip", clip_path(F.col("domain"), F.col("role"), F.col("event_index"), F.col("clip_start_s"), F.col("clip_end_s"), organize_by))

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for path, own in pdf.groupby("path", sort=False):
                with wav.Source(path) as source:
                    wave = wav.Wave(source)
                    for c in own.itertuples():
                        files.put(f"{root}/{c.clip}", wav.encode(wave.seconds(c.clip_start_s, c.clip_end_s), wave.rate))
            yield pdf[["path", "event_index", "clip"]]

    return named.select("path", "event_index", "clip", "clip_start_s", "clip_end_s").mapInPandas(cut, "path string, event_index long, clip string")


def max_rate(probes: DataFrame, first: int = 50) -> DataFrame:
    """The highest sample rate of the first files by path."""
    return probes.orderBy("path").limit(first).agg(F.max("samplerate_hz").alias("samplerate_hz"))


def deployments(rows: DataFrame, by_id: DataFrame, by_cover: DataFrame) -> DataFrame:
    """rows with coordinates of their recorder, else of their cover, else 'No disponible'. Lookups: key, coordinates."""
    a, b = by_id.select(F.col("key").alias("audiomoth_id"), F.col("coordinates").alias("_a")), by_cover.select(F.col("key").alias("cover"), F.col("coordinates").alias("_b"))
    return rows.join(a, "audiomoth_id", "left").join(b, "cover", "left").withColumn("coordinates", F.coalesce(F.nullif("_a", F.lit("")), F.nullif("_b", F.lit("")), F.lit("No disponible"))).drop("_a", "_b")


def chart_rows(rows: DataFrame) -> DataFrame:
    """Readable, dated rows with a temperature other than zero."""
    return rows.filter(F.col("error").isNull() & F.col("recorded_at").isNotNull() & F.col("temperature_c").isNotNull() & (F.col("temperature_c") != 0))


def sort_as_text(rows: DataFrame, column: str, descending: bool = False) -> DataFrame:
    """Rows by a column's text, as a table in a page sorts them."""
    key = F.col(column).cast("string")
    return rows.orderBy(key.desc() if descending else key.asc())


def latest_reels(reels: DataFrame, order: str) -> DataFrame:
    """One reel a role: that of the last recording."""
    return reels.withColumn("_r", F.row_number().over(W.partitionBy("role").orderBy(F.desc(order)))).filter("_r = 1").drop("_r")
