"""Whole-spectrogram measures. Indices and baselines are made by ranges of frames (see ranges), so a recording is as many groups as it needs.

The shape of a band is that of an event's frames, which are one group: an hour at 94 frames a second and 64 bins is some 170 MB.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sonoframe.functions import kernels
from sonoframe.operators import ranges
from sonoframe.session import ship


def _measure(frames: DataFrame, key: str, order: str, mag: str, kernel: Callable[[np.ndarray], dict], fields: list[str]) -> DataFrame:
    ship(frames.sparkSession)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        found = kernel(np.stack(pdf.sort_values(order)[mag].to_numpy()).astype(np.float64))
        return pd.DataFrame([{key: pdf[key].iloc[0]} | {f: found[f] for f in fields}])

    kind = frames.schema[key].dataType.simpleString()
    return frames.select(key, order, mag).groupBy(key).applyInPandas(run, f"{key} {kind}, {', '.join(f'{f} double' for f in fields)}")


def _axis(bins: int, rate: float) -> np.ndarray:
    """Frequencies of bins from 0 to half the rate."""
    return np.arange(bins) * (rate / 2 / (bins - 1))


def indices(frames: DataFrame, key: str, order: str, mag: str, rate: float, floor_db: float = -50.0, size: int = 8192) -> DataFrame:
    """key, aci, bio, ndsi, adi, aei of each recording's magnitude frames.

    Frames are numbered and dealt by ranges of `size`, each with the frame before it; a range gives sums for each bin and kilohertz, which are added up
    with the sums of the other ranges. No group holds a recording.
    """
    name = frames.schema[key]
    rows = ranges.numbered(frames.select(key, order, mag), key, [order])

    def sums(group: pa.Table, lo: int, hi: int) -> pa.Table:
        whole = np.stack(group[mag].to_numpy(zero_copy_only=False)).astype(np.float64)
        skip = int(group["_i"][0].as_py() < lo)
        bins, active = kernels.index_states(whole[skip:], _axis(whole.shape[1], rate), whole[0] if skip else None, floor_db)
        n = whole.shape[1]
        at = np.concatenate([np.arange(n), -1 - np.arange(len(active)), [-100]])
        columns = np.concatenate([bins, np.zeros((4, len(active) + 1))], axis=1)
        columns[0, n:] = [*active, len(whole) - skip]
        return pa.table({key: pa.array([group[key][0].as_py()] * len(at), group.schema.field(key).type), "at": at} | {f"s{k}": columns[k] for k in range(4)})

    states = ranges.over_ranges(rows.select(key, "_i", mag), key, "_i", size, 1, 0, sums, T.StructType([name]).add("at", "long").add("s0", "double").add("s1", "double").add("s2", "double").add("s3", "double"))
    merged = states.groupBy(key, "at").agg(*[F.sum(f"s{k}").alias(f"s{k}") for k in range(4)])
    fields = ("aci", "bio", "ndsi", "adi", "aei")

    def finish(group: pa.Table) -> pa.Table:  # as many rows as bins
        group = group.sort_by("at")
        at, s = group["at"].to_numpy(), np.stack([group[f"s{k}"].to_numpy() for k in range(4)])
        found = kernels.indices_of(s[:, at >= 0], s[0, (at < 0) & (at > -100)][::-1], int(s[0, at == -100][0]), _axis(int((at >= 0).sum()), rate))
        return pa.table({key: pa.array([group[key][0].as_py()], group.schema.field(key).type)} | {f: [found[f]] for f in fields})

    out = T.StructType([name])
    for f in fields:
        out = out.add(f, "double")
    return merged.groupBy(key).applyInArrow(finish, out)


def band_shape(frames: DataFrame, key: str, order: str, mag: str, rate: float, lo: float, hi: float, frame_rate: float = 1.0) -> DataFrame:
    """key, crest, entropy, centroid and pulse train of a band of each recording."""
    fields = ["band_crest", "band_entropy", "band_centroid", "periodicity", "pulse_rate_hz"]
    return _measure(frames, key, order, mag, lambda m: kernels.band_features(m, _axis(m.shape[1], rate), lo, hi, frame_rate), fields)


def baseline(series: DataFrame, key: str, order: str, value: str, window: int, anchors: int = 2000, warmup: int = 512, size: int = 1 << 14) -> DataFrame:
    """key, order, median, mad: the causal baseline of each key's series, exact at anchors and linear between them."""
    rows = ranges.numbered(series.select(key, order, F.col(value).cast("double").alias("_value")), key, [order])
    counts = rows.groupBy(F.col(key).alias("_key")).agg((F.max("_i") + 1).alias("_n"), F.lit(window).alias("_window"))
    return anchored(rows, counts, key, "_value", anchors, warmup, size).drop("_i", "_value")


def anchored(rows: DataFrame, counts: DataFrame, key: str, value: str, anchors: int = 2000, warmup: int = 512, size: int = 1 << 14) -> DataFrame:
    """rows (numbered in _i) with median and mad. counts: _key, its number of rows _n and its _window.

    Ranges of rows reach back by a window and the distance of anchors, and forward by that distance, so each finds its own anchors.
    """
    longest = counts.agg(F.max("_window"), F.max("_n")).first()
    stride = kernels.anchor_stride(longest[1] or 0, anchors, warmup)
    left = (longest[0] or 1) - 1 + stride
    held = rows.join(counts, rows[key].eqNullSafe(counts["_key"])).drop("_key")

    def add(group: pa.Table, lo: int, hi: int) -> pa.Table:
        first, n = group["_i"][0].as_py(), group["_n"][0].as_py()
        median, mad = kernels.baseline(group[value].to_numpy(), group["_window"][0].as_py(), anchors, warmup, first, lo, hi, n)
        own = group.drop_columns(["_n", "_window"]).slice(lo - first, min(hi, n) - lo)
        return own.append_column("median", pa.array(median)).append_column("mad", pa.array(mad))

    return ranges.over_ranges(held, key, "_i", max(size, left), left, stride, add, T.StructType([*rows.schema, T.StructField("median", T.DoubleType()), T.StructField("mad", T.DoubleType())]))


def of_samples(audio: DataFrame, key: str, samples: str, rate: int, bands: dict, frame: int = 2048, hop: int = 512, target_rate: int = 0) -> DataFrame:
    """key, frame_idx, t_s, peak_hz, flux, centroid, flatness, band_energies of each frame of arrays of samples, resampled if asked for."""
    ship(audio.sparkSession)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for name, x in zip(pdf[key], pdf[samples], strict=True):
                own, own_rate = kernels.resample(np.asarray(x, np.float64), rate, target_rate)
                mag, freqs = kernels.magnitudes(own, frame, hop), kernels.frequency_axis(own_rate, frame)
                series = kernels.frame_series(mag, freqs, bands)
                energies = [dict(zip(bands, v, strict=True)) for v in zip(*(series[b] for b in bands), strict=True)]
                at = np.arange(len(mag))
                yield pd.DataFrame({key: name, "frame_idx": at, "t_s": at * hop / own_rate, "peak_hz": freqs[mag.argmax(axis=1)] if len(mag) else [], "flux": series["flux"], "centroid": series["centroid"], "flatness": series["flatness"], "band_energies": energies})

    kind = audio.schema[key].dataType.simpleString()
    return audio.select(key, samples).mapInPandas(run, f"{key} {kind}, frame_idx long, t_s double, peak_hz double, flux double, centroid double, flatness double, band_energies map<string,double>")
