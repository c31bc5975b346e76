"""From frame series to events: thresholds, islands, gap merging, padding, thinning."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sonoframe.functions import kernels
from sonoframe.operators import ranges
from sonoframe.session import ship


def running_median_mad(frames: DataFrame, key: str, order: str, value: str, width: int) -> DataFrame:
    """frames with median and mad of the last `width` values, fewer at the start. Memory is width values a row: for
    windows of thousands of frames take exact_baseline."""
    own = W.partitionBy(key).orderBy(order).rowsBetween(-(width - 1), 0)
    middle = F.percentile(F.col(value), F.lit(0.5)).over(own)
    held = frames.withColumns({"median": middle, "_own": F.collect_list(value).over(own)})
    dev = F.array_sort(F.transform("_own", lambda v: F.abs(v - F.col("median"))))
    n = F.size("_own")
    at = lambda i: F.element_at(dev, i.cast("int"))
    return held.withColumn("mad", (at(F.floor((n + 1) / 2)) + at(F.floor((n + 2) / 2))) / 2).drop("_own")


def exact_baseline(frames: DataFrame, key: str, order: str, value: str, width: int, size: int = 1 << 14) -> DataFrame:
    """As running_median_mad, for windows of thousands: frames are dealt by ranges, each with the width - 1 frames before it, and a sorted
    window slides over them. A frame costs the logarithm of the width, a group holds a range and a window, and a key is many groups."""
    rows = ranges.numbered(frames, key, [order])

    def add(group: pa.Table, lo: int, hi: int) -> pa.Table:
        skip = lo - group["_i"][0].as_py()
        found = kernels.exact_baseline(group[value].to_numpy().astype(float), width)
        return group.slice(skip).append_column("median", pa.array(found[0][skip:])).append_column("mad", pa.array(found[1][skip:]))

    return ranges.over_ranges(rows, key, "_i", max(size, width), width - 1, 0, add, T.StructType([*rows.schema, T.StructField("median", T.DoubleType()), T.StructField("mad", T.DoubleType())])).drop("_i")


def above_threshold(value: Column, median: Column, mad: Column, factor: float = 2.5, scale: float = 1.4826) -> Column:
    return value > median + factor * scale * mad


def islands(frames: DataFrame, key: str, order: str, above: str, time: str, value: str) -> DataFrame:
    """Contiguous runs of rows where `above` holds: onset, offset (last row above), peak, mean and row numbers."""
    own = W.partitionBy(key).orderBy(order)
    number = frames.withColumn("_i", F.row_number().over(own))
    runs = number.filter(above).withColumn("_run", F.col("_i") - F.row_number().over(own))
    return runs.groupBy(key, "_run").agg(
        F.min(time).alias("onset_s"), F.max(time).alias("offset_s"), F.max(value).alias("peak_flux"), F.avg(value).alias("mean_flux"), F.min("_i").alias("onset_frame"), F.max("_i").alias("offset_frame")
    ).drop("_run")


def merge_gaps(events: DataFrame, key: str, gap: float | Column) -> DataFrame:
    """Joins events of a key that are at most `gap` apart. The mean folds as ((m1 + m2) / 2 + m3) / 2 ..., here in closed
    form: of k means the first weighs 2^-(k-1), the i-th 2^-(k-i+1)."""
    own = W.partitionBy(key).orderBy("onset_s", "offset_s")
    new = F.coalesce((F.col("onset_s") - F.max("offset_s").over(own.rowsBetween(W.unboundedPreceding, -1)) > gap).cast("int"), F.lit(1))
    numbered = events.withColumn("_new", new).withColumn("_group", F.sum("_new").over(own))
    inside = W.partitionBy(key, "_group")
    placed = numbered.withColumns({"_i": F.row_number().over(inside.orderBy("onset_s", "offset_s")), "_k": F.count("*").over(inside)})
    weight = F.pow(F.lit(2.0), -(F.col("_k") - F.greatest(F.col("_i"), F.lit(2)) + 1).cast("double"))
    return placed.groupBy(key, "_group").agg(
        F.min("onset_s").alias("onset_s"), F.max("offset_s").alias("offset_s"), F.max("peak_flux").alias("peak_flux"),
        F.when(F.count("*") == 1, F.max("mean_flux")).otherwise(F.sum(F.col("mean_flux") * weight)).alias("mean_flux"), F.count("*").alias("n_regions"),
    ).drop("_group")


def long_enough(events: DataFrame, least: float | Column) -> DataFrame:
    return events.filter(F.col("offset_s") - F.col("onset_s") >= least)


def pad(events: DataFrame, duration: Column, pre: float = 20.0, post: float = 10.0, longest: float = 300.0) -> DataFrame:
    """clip_start_s and clip_end_s around each event, within the recording and no longer than `longest`."""
    start = F.greatest(F.lit(0.0), F.col("onset_s") - pre)
    end = F.least(duration, F.col("offset_s") + post)
    return events.withColumns({"clip_start_s": start, "clip_end_s": F.when(end - start > longest, start + longest).otherwise(end)})


def thin(events: DataFrame, key: str, onset: str, separation: float, payload: list[str]) -> DataFrame:
    """Greedy thinning: an event stays if it begins at least `separation` after the last that stayed.

    Events are sorted within partitions and stream by; the state is the key and the onset last kept, so a recording of any length
    takes constant memory.
    """
    ship(events.sparkSession)
    rows = events.select(key, onset, *payload)
    rows = rows.repartition(F.col(key)).sortWithinPartitions(key, onset, *payload)

    def stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, last = None, None
        for batch in batches:
            if not len(batch):
                continue
            at = batch.column(1).cast(pa.float64()).to_numpy(zero_copy_only=False)
            names = batch.column(0).dictionary_encode()
            code = names.indices.fill_null(-1).to_numpy(zero_copy_only=False)
            begin = np.flatnonzero(np.concatenate([[True], code[1:] != code[:-1]]))
            keep = np.zeros(len(batch), bool)
            for a, b in zip(begin, np.append(begin[1:], len(code)), strict=True):
                own = ("null",) if code[a] < 0 else (names.dictionary[int(code[a])].as_py(),)
                if own != now:
                    now, last = own, None
                last = kept_onsets(at[a:b], separation, last, keep[a:b])
            yield batch.filter(pa.array(keep))

    return rows.mapInArrow(stream, rows.schema)


def kept_onsets(at: np.ndarray, separation: float, last: float | None, keep: np.ndarray) -> float | None:
    """Marks in keep which of the sorted onsets stay; the last that stayed."""
    i = 0
    while True:
        if last is not None:
            i = max(i, int(np.searchsorted(at, last + separation)) - 1)
            while i < len(at) and at[i] - last < separation:
                i += 1
        if i >= len(at):
            return last
        keep[i], last = True, float(at[i])
        i += 1


def fixed_window(onset: Column, duration: Column, length: float = 60.0, before: float = 30.0) -> tuple[Column, Column]:
    """A clip of one length, moved inward at the edges of the recording."""
    start = F.greatest(F.lit(0.0), F.least(onset - min(before, length), F.greatest(F.lit(0.0), duration - length)))
    return start, F.least(duration, start + length)


def select(events: DataFrame, roles: tuple = (), domains: tuple = (), least: float = 0.0) -> DataFrame:
    """Events by role, domain and confidence; an empty tuple keeps all."""
    if roles:
        events = events.filter(F.lower("role").isin(*[r.lower() for r in roles]))
    if domains:
        events = events.filter(F.lower("domain").isin(*[d.lower() for d in domains]))
    return events.filter(F.col("confidence") >= least)
