"""The calendar: daily summaries, hour-of-day patterns, dawn onsets, shifts between days, control values.

events: recording, day (date), rec_start (timestamp_ntz), rec_hour, onset_s, role, domain, event_id.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sonoframe.functions.bands import CV_FIELDS, NOCTURNAL
from sonoframe.operators.census import first_seen_mode

DOMAINS = ("biophony", "geophony", "anthrophony", "transition")


def _recordings(events: DataFrame, recordings: DataFrame | None) -> DataFrame:
    """Recordings with day and start hour; where none are given, those that have events."""
    if recordings is None:
        return events.groupBy("recording").agg(F.min("day").alias("day"), F.min("rec_hour").alias("rec_hour"))
    return recordings.select("recording", "day", "rec_hour")


def daily(events: DataFrame, recordings: DataFrame | None = None) -> DataFrame:
    """One row a day: recordings, events, richness, shares of domains, dominant role.

    recordings (recording, day, rec_hour): all that were made, silent ones too. A day without events has zeros, null shares and the
    role 'silence'. Without that table only recordings with events count.
    """
    made = _recordings(events, recordings)
    counts = [F.count_if(F.col("domain") == d).alias(f"n_{d}") for d in DOMAINS]
    heard = events.groupBy("day").agg(F.count("*").alias("n_events"), F.count_distinct("role").alias("richness"), *counts)
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    days = made.groupBy("day").agg(F.count_distinct("recording").alias("n_recordings")).join(heard, "day", "left")
    days = days.select("day", "n_recordings", *[zero(c) for c in ("n_events", "richness", *[f"n_{d}" for d in DOMAINS])])
    shares = {f"{d}_share": F.round(F.try_divide(f"n_{d}", "n_events"), 4) for d in DOMAINS}
    days = days.withColumns({"day_of_year": F.dayofyear("day"), "events_per_recording": F.round(F.col("n_events") / F.col("n_recordings"), 3), **shares})
    top = first_seen_mode(events, ["day"], "role", F.struct("rec_start", "event_id")).withColumnRenamed("role", "dominant_role")
    return days.join(top, "day", "left").withColumn("dominant_role", F.coalesce("dominant_role", F.lit("silence")))


def hourly(events: DataFrame, recordings: DataFrame | None = None, by_start: bool = False) -> DataFrame:
    """Events of each day and hour, with zeros for silent hours: the hour of the event, or with by_start that in which its recording began."""
    made = _recordings(events, recordings)
    of_event = F.pmod(F.floor(F.col("rec_hour") + (F.col("rec_minute") * 60 + F.col("onset_s")) / 3600), F.lit(24)).cast("int")
    hour = F.col("rec_hour") if by_start else of_event
    grid = made.select("day").distinct().withColumn("hour", F.explode(F.sequence(F.lit(0), F.lit(23))))
    return grid.join(events.groupBy("day", hour.alias("hour")).count(), ["day", "hour"], "left").select("day", "hour", F.coalesce("count", F.lit(0)).alias("n_events"))


def diel_pattern(events: DataFrame, recordings: DataFrame | None = None) -> DataFrame:
    """Mean and most events of a recording by its start hour; all 24 hours. recordings as for daily: silent ones lower the means."""
    made = _recordings(events, recordings)
    counted = events.groupBy("recording").agg(F.count("*").alias("n"), *[F.count_if(F.col("domain") == d).alias(f"n_{d}") for d in DOMAINS])
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    per = made.join(counted, "recording", "left").select("rec_hour", *[zero(c) for c in ("n", *[f"n_{d}" for d in DOMAINS])])
    hours = per.groupBy("rec_hour").agg(F.avg("n").alias("mean_events"), F.max("n").alias("max_events"), F.count("*").alias("n_recordings"), *[F.sum(f"n_{d}").alias(f"n_{d}") for d in DOMAINS])
    grid = events.sparkSession.range(24).select(F.col("id").cast("int").alias("hour"))
    filled = grid.join(hours, grid.hour == hours.rec_hour, "left").drop("rec_hour")
    return filled.select("hour", F.round(F.coalesce("mean_events", F.lit(0.0)), 6).alias("mean_events"), *[F.coalesce(c, F.lit(0)).alias(c) for c in ("max_events", "n_recordings", *[f"n_{d}" for d in DOMAINS])])


def diel_table(pattern: DataFrame) -> DataFrame:
    """Means over their peak, 24 rows, and whether an hour is the (first) peak."""
    whole = W.partitionBy()
    peak = F.max("mean_events").over(whole)
    scaled = pattern.select("hour", "mean_events", F.when(peak > 0, F.round(F.col("mean_events") / peak, 4)).otherwise(0.0).alias("level"), peak.alias("_peak"))
    first = F.min(F.when(F.col("mean_events") == F.col("_peak"), F.col("hour"))).over(whole)
    return scaled.select("hour", "level", (F.col("hour") == first).alias("is_peak"))


def dawn_onset(events: DataFrame) -> DataFrame:
    """Earliest biophonic minute of each day between three and eight. The window looks at the start hour alone, the value
    also at the start minute."""
    at = F.col("rec_hour") + F.col("onset_s") / 3600
    early = events.filter((F.col("domain") == "biophony") & at.between(3, 8))
    minutes = F.col("rec_hour") * 60 + F.col("rec_minute") + F.col("onset_s") / 60
    return early.groupBy("day").agg(F.round(F.min(minutes), 1).alias("onset_minutes")).withColumn("day_of_year", F.dayofyear("day"))


def dawn_shift(dawn: DataFrame, least: float = 15.0) -> DataFrame:
    """Days whose dawn came `least` minutes earlier or later than on the day with a dawn before."""
    shift = F.col("onset_minutes") - F.lag("onset_minutes").over(W.orderBy("day"))
    moved = dawn.withColumn("_s", shift).filter(F.abs("_s") > least)
    return moved.select(F.lit("dawn_chorus_advance_delay").alias("type"), "day", "day_of_year", F.round("_s", 1).alias("magnitude"))


def shifts(days: DataFrame, day_roles: DataFrame, dawn: DataFrame, breeding: float = 2.0, adi: float = 0.5, jump: int = 3) -> DataFrame:
    """(type, day, day_of_year, magnitude) of changes against the recorded day before; gaps are not filled.

    days: day, day_of_year, low, high (band energies), adi, n_geophony. day_roles: day, roles (array); a day without any has none.
    """
    by_day = W.orderBy("day")
    before = lambda c: F.lag(c).over(by_day)
    whole = days.join(day_roles, "day", "left").withColumns({"roles": F.coalesce("roles", F.array().cast("array<string>")), "adi": F.coalesce("adi", F.lit(0.0))})
    paired = whole.withColumns({f"_{c}": before(c) for c in ("day", "low", "high", "adi", "n_geophony", "roles")}).filter(F.col("_day").isNotNull())
    ratio = lambda c: F.col(c) / F.greatest(F.col(f"_{c}"), F.lit(1e-10))
    night = F.array(*[F.lit(r) for r in NOCTURNAL])
    turned = F.size(F.array_intersect(F.array_except("roles", "_roles"), night)) + F.size(F.array_intersect(F.array_except("_roles", "roles"), night))
    kinds = {
        "breeding_chorus_onset": ((F.col("_low") > 0) & (F.col("_high") > 0) & (ratio("low") > breeding) & (ratio("high") > breeding), F.round(F.least(ratio("low"), ratio("high")), 3)),
        "migration_acoustic_shift": (F.abs(F.col("adi") - F.col("_adi")) > adi, F.round(F.abs(F.col("adi") - F.col("_adi")), 3)),
        "rain_season_transition": (F.col("n_geophony") > F.col("_n_geophony") + jump, (F.col("n_geophony") - F.col("_n_geophony")).cast("double")),
        "nocturnal_community_change": (turned > 0, turned.cast("double")),
    }
    found = F.filter(F.array(*[F.when(c, F.struct(F.lit(k).alias("type"), m.alias("magnitude"))) for k, (c, m) in kinds.items()]), lambda x: x.isNotNull())
    out = paired.select("day", "day_of_year", F.explode(found).alias("_x")).select("_x.type", "day", "day_of_year", "_x.magnitude")
    return out.unionByName(dawn_shift(dawn)).orderBy("day", "type")


def cv_frames(frames: DataFrame, fields: tuple[str, ...] = CV_FIELDS) -> DataFrame:
    """Each field over its range in all days (shares 0 to 1, ndsi -1 to 1), as cv_<field>; 0 for null or no width."""
    whole = W.partitionBy()
    fixed = {"biophony": (0.0, 1.0), "geophony": (0.0, 1.0), "anthrophony": (0.0, 1.0), "ndsi": (-1.0, 1.0)}

    def scaled(c: str) -> Column:
        lo, hi = (F.lit(v) for v in fixed[c]) if c in fixed else (F.min(c).over(whole), F.max(c).over(whole))
        return F.when(F.col(c).isNotNull() & (hi - lo > 0), F.round((F.col(c) - lo) / (hi - lo), 4)).otherwise(0.0)

    return frames.withColumns({f"cv_{c}": scaled(c) for c in fields})


def heatmap(hours: DataFrame) -> DataFrame:
    """A row a day with a column for each hour. hours: day, hour, n_events."""
    return hours.groupBy("day").pivot("hour", list(range(24))).agg(F.sum("n_events"))
