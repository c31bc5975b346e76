"""Spectral features of magnitude arrays as JVM-side expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def total(x: Column) -> Column:
    return F.aggregate(x, F.lit(0.0), lambda a, v: a + v)


def frequencies(n_bins: Column | int, rate: float) -> Column:
    """Bin frequencies from 0 to half the rate."""
    n = n_bins if isinstance(n_bins, Column) else F.lit(n_bins)
    return F.transform(F.sequence(F.lit(0), n - 1), lambda k: k * (rate / 2) / (n - 1))


def flux(mag: Column, before: Column) -> Column:
    """Length of the positive change since the frame before; 0 for the first."""
    rise = F.zip_with(mag, before, lambda x, y: F.greatest(x - y, F.lit(0.0)))
    return F.when(before.isNull(), F.lit(0.0)).otherwise(F.sqrt(F.aggregate(rise, F.lit(0.0), lambda a, v: a + v * v)))


def centroid(mag: Column, freqs: Column) -> Column:
    """Mean frequency by magnitude; 0 in silence."""
    return total(F.zip_with(mag, freqs, lambda m, f: m * f)) / F.coalesce(F.nullif(total(mag), F.lit(0.0)), F.lit(1.0))


def flatness(mag: Column, floor: float = 1e-20) -> Column:
    """Geometric over arithmetic mean of power."""
    power = F.transform(mag, lambda m: F.greatest(m * m, F.lit(floor)))
    n = F.size(power)
    return F.exp(F.aggregate(power, F.lit(0.0), lambda a, v: a + F.ln(v)) / n) / (total(power) / n)


def band_energy(mag: Column, freqs: Column, lo: Column | float, hi: Column | float, nyquist: float) -> Column:
    """Power summed over the bins in [lo, hi), hi cut at half the rate; 0 for no bin."""
    lo, hi = (x if isinstance(x, Column) else F.lit(float(x)) for x in (lo, hi))
    own = F.filter(F.arrays_zip(mag.alias("m"), freqs.alias("f")), lambda z: (z["f"] >= lo) & (z["f"] < F.least(hi, F.lit(nyquist))))
    return F.aggregate(own, F.lit(0.0), lambda a, z: a + z["m"] * z["m"])


def entropy(counts: Column) -> Column:
    """Shannon entropy in bits of an array of counts; 0 of nothing."""
    all_ = F.aggregate(counts, F.lit(0.0), lambda a, v: a + v)
    return F.aggregate(counts, F.lit(0.0), lambda a, v: a - F.when(v > 0, (v / all_) * F.log2(v / all_)).otherwise(0.0))
