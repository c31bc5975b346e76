"""Field audio is made, measured and deleted in portions, and files are dealt to many tasks."""

from __future__ import annotations

import os
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from sonoframe.plans import views
from sonoframe.sources import files, wav


@pytest.mark.parametrize("size", [4, 11, 1000])
def test_disk_follows_a_portion(spark, tmp_path, size):
    spark.createDataFrame([(k,) for k in range(11)], "s_suppkey long").coalesce(1).write.parquet(str(tmp_path / "supplier.parquet"))
    folders, there = [], []
    local = lambda path: re.sub("^file:(//)?", "", path)

    def measure(root):
        folders.append(local(root))
        there.append([len(os.listdir(f)) if os.path.exists(f) else 0 for f in folders])
        return wav.probe(wav.recordings(spark, root)).select(F.regexp_extract("path", "([^/]+)$", 1).alias("file"), "duration_s")

    found = views.of_field_audio(spark, str(tmp_path), measure, size)
    want = sorted(f"2024{1 + k:02d}{1 + k:02d}_{k:02d}0000.wav" for k in range(11))
    assert sorted(r.file for r in found.collect()) == want and {r.duration_s for r in found.collect()} == {6.0}
    assert len(folders) == -(-11 // size) and sum(n[-1] for n in there) == 11
    assert all(not any(n[:-1]) for n in there) and not any(os.path.exists(f) for f in folders)


def test_files_are_many_tasks(spark, tmp_path):
    """Thin rows that are much work are not gathered in one task by their bytes."""
    for i in range(24):
        files.put(str(tmp_path / f"{i}.wav"), wav.encode(np.zeros(4000), 16000))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.parallelismFirst", "false")
    try:
        rows = wav.file_indices(wav.recordings(spark, str(tmp_path))).select("path", F.spark_partition_id().alias("task"))
        assert len({r.task for r in rows.collect()}) > 3
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.parallelismFirst")
