"""Short ranges of a recording are read together, and by themselves."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from sonoframe.sources import files, wav


def test_short_ranges_of_a_file_are_one_task(spark, tmp_path):
    rng = np.random.default_rng(3)
    for i in range(3):
        files.put(str(tmp_path / f"{i}.wav"), wav.encode(rng.normal(0, 0.1, 16000), 16000))
    found = wav.recordings(spark, str(tmp_path))
    rows = wav.frame_features(found, span=1).withColumn("task", F.spark_partition_id())
    tasks = rows.groupBy("path").agg(F.count_distinct("task").alias("n"), F.count("*").alias("frames")).collect()
    assert [(r.n, r.frames) for r in tasks] == [(1, (16000 - 2048) // 512 + 1)] * 3


def test_tones_at_the_edge_of_a_band(spark, tmp_path):
    """Pulsed tones one hertz below, at and above an edge: frames of 2,048 samples put the first into the upper band."""
    rate, t = 16000, np.arange(4 * 16000) / 16000
    tones = (1999, 2000, 2001, 3999, 4000)
    for hz in tones:
        x = 0.4 * np.sin(2 * np.pi * hz * t) * (np.sin(2 * np.pi * 8 * t) > 0) * ((t >= 1) & (t < 2))
        files.put(str(tmp_path / f"{hz}.wav"), wav.encode(x, rate))
    events = spark.createDataFrame([(str(tmp_path / f"{hz}.wav"), 1, 0.928, 1.984) for hz in tones], "path string, event_index int, onset_s double, offset_s double")
    got = {int(r.path.split("/")[-1][:-4]): max(r.band_energies, key=r.band_energies.get) for r in wav.event_bands(events).collect()}
    assert got == {1999: "geophony", 2000: "biophony_low", 2001: "biophony_low", 3999: "biophony_low", 4000: "biophony_mid"}
    longer = events.withColumn("offset_s", F.lit(4.0))
    sums = [{r.path: sum(r.band_energies.values()) for r in wav.event_bands(longer, longest=n).collect()} for n in (1, 8)]
    assert all(abs(sums[0][p] - sums[1][p]) < 0.01 * sums[1][p] for p in sums[1])  # an event is measured to its end, in pieces too
