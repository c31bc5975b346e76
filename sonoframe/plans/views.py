"""The driver's tables as recordings, events, frames and stations."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sonoframe.functions.bands import AUDIBLE
from sonoframe.session import mark, new_path, release, ship, staged
from sonoframe.sources import files, wav

RATE = 48000.0
AUDIO_RATE = 16000
BANDS = tuple(AUDIBLE)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def acoustic_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events as acoustic events: a recording is a user's day, k of props gives the measurements."""
    e = table(spark, sf_dir, "events")
    k = F.coalesce(F.get_json_object("props", "$.k").cast("int"), F.lit(0))
    base = e.select("event_id", "ts", F.col("user_id").alias("site"), F.to_date("ts").alias("day"), F.col("event_type").alias("role"), F.col("value").alias("peak_flux"), k.alias("k"))
    base = base.withColumn("recording", F.concat_ws("/", F.col("site").cast("string"), F.col("day").cast("string")))
    started = base.withColumn("rec_start", F.min("ts").over(W.partitionBy("recording")))  # one shuffle, which later windows of a recording reuse
    micros = lambda c: F.unix_micros(F.col(c).cast("timestamp"))
    out = started.withColumns({
        "onset_s": (micros("ts") - micros("rec_start")) / 1e6, "rec_hour": F.hour("rec_start"), "rec_minute": F.minute("rec_start"),
        "domain": F.when(F.col("role").isin("click", "view"), "biophony").when(F.col("role") == "purchase", "geophony").when(F.col("role") == "error", "anthrophony").otherwise("transition"),
        "dominant_band": F.element_at(F.array(*[F.lit(b) for b in BANDS]), F.col("k") % 5 + 1), "confidence": F.col("k") % 100 / 100,
        "duration_s": F.col("k") % 40 + 0.5, "flatness": F.col("k") % 50 / 100, "centroid": 200.0 + F.col("k") * 37 % 9000,
    })
    return out.withColumn("offset_s", F.col("onset_s") + F.col("duration_s"))


def recordings_made(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All recordings: recording, day, rec_hour."""
    return acoustic_events(spark, sf_dir).groupBy("recording").agg(F.min("day").alias("day"), F.min("rec_hour").alias("rec_hour"))


def heard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Acoustic events of a survey in which many recordings and some whole days are silent."""
    return acoustic_events(spark, sf_dir).filter("role IN ('click', 'purchase') AND k % 3 = 0 AND dayofmonth(day) % 7 <> 3")


def energies(k: Column) -> Column:
    """array<struct(ord, name, energy)> made from k."""
    return F.array(*[F.struct(F.lit(i).alias("ord"), F.lit(b).alias("name"), ((k * (i + 3)) % 17).cast("double").alias("energy")) for i, b in enumerate(BANDS)])


def spectral_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """embeddings as magnitude frames: label is the recording, vec_id the order."""
    v = table(spark, sf_dir, "embeddings")
    mag = F.transform("embedding", lambda x: F.abs(x.cast("double")))
    return v.select(F.col("label").alias("recording"), F.col("vec_id").alias("frame"), mag.alias("mag")).withColumn("frame_no", F.row_number().over(W.partitionBy("recording").orderBy("frame")) - 1)


def bins(frames: DataFrame) -> DataFrame:
    """A row for each bin of each frame: recording, frame, k, f (Hz), m."""
    return frames.select("recording", "frame", F.posexplode("mag").alias("k", "m")).withColumn("f", F.col("k") * (RATE / 2) / 63)


def field_audio(spark: SparkSession, sf_dir: str, portion: int = 0, portions: int = 1) -> str:
    """A folder of WAV files in the shared folder, one for each supplier (of a portion of all): six seconds of faint noise with a pulsed tone in the
    fourth, whose frequency the supplier's key gives; every fifth is silent."""
    root = new_path(spark, "field-audio")
    ship(spark)

    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        t = np.arange(6 * AUDIO_RATE) / AUDIO_RATE
        fourth = slice(3 * AUDIO_RATE, 4 * AUDIO_RATE)
        pulses = 0.4 * (np.sin(2 * np.pi * 8 * t[fourth]) > 0)
        for pdf in batches:
            for key in pdf["s_suppkey"]:
                x = 1e-4 * np.random.default_rng(int(key)).normal(size=len(t))
                if key % 5:
                    x[fourth] += pulses * np.sin(2 * np.pi * (500 + int(key) * 37 % 6500) * t[fourth])
                name = f"{root}/2024{1 + key % 12:02d}{1 + key % 28:02d}_{key % 24:02d}{key // 24 % 60:02d}{key // 1440 % 60:02d}.wav"
                files.put(name, wav.encode(x, AUDIO_RATE))
            yield pdf

    tasks = 4 * spark.sparkContext.defaultParallelism  # keys are few thin rows in one file, a key is some milliseconds of work
    keys = table(spark, sf_dir, "supplier").select("s_suppkey").filter(F.pmod(F.xxhash64("s_suppkey"), F.lit(portions)) == portion)
    keys.repartition(tasks, "s_suppkey").mapInPandas(write, "s_suppkey long").write.format("noop").mode("overwrite").save()
    return root


def of_field_audio(spark: SparkSession, sf_dir: str, measure: Callable[[str], DataFrame], size: int = 1 << 14) -> DataFrame:
    """The rows that `measure` makes of a folder of field audio, for all suppliers.

    Audio is a hundred thousand times its row, so it is written, measured and deleted in portions of some `size` files (3 GB): disk follows a portion
    and not the table. Only the measured rows of all portions are kept.
    """
    portions = max(1, -(-table(spark, sf_dir, "supplier").count() // size))
    out = []
    for i in range(portions):
        since = mark()
        out.append(staged(measure(field_audio(spark, sf_dir, i, portions)), "measured-audio"))
        release(since, keep_last=True)
    return reduce(DataFrame.unionByName, out)
