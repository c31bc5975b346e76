"""From WAV files to classified events, results and a calendar: the whole batch as one plan."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sonoframe.functions import bands as B
from sonoframe.functions.text import normalize_cover
from sonoframe.operators import calendar, census, classify, detect, metadata, sites
from sonoframe.session import staged
from sonoframe.sources import annotations, wav


@dataclass(frozen=True)
class Settings:
    """Spectral, detection and selection settings; seconds and Hz."""

    frame: int = 2048
    hop: int = 512
    target_rate: int = 48000
    bands: dict = field(default_factory=lambda: dict(B.AUDIBLE))
    baseline_s: float = 60.0
    factor: float = 2.5
    min_duration: float = 2.0
    merge_gap: float = 5.0
    pre_roll: float = 20.0
    post_roll: float = 10.0
    longest_clip: float = 300.0
    fixed_clip: float = 0.0
    fixed_pre: float = 30.0
    min_separation: float = 0.0
    roles: tuple = ()
    domains: tuple = ()
    min_confidence: float = 0.0


def ultrasonic(timing: tuple[float, float] | None = None, **more) -> Settings:
    """Native rate, seven bands, short frames; shortest event 0.3 s and merge gap 1 s unless timing says otherwise."""
    least, gap = timing or (0.3, 1.0)
    return Settings(frame=1024, hop=256, target_rate=0, bands=dict(B.ULTRASONIC), min_duration=least, merge_gap=gap, **more)


def events(frames: DataFrame, probes: DataFrame, s: Settings = Settings()) -> DataFrame:
    """Detected and classified events of frame features (see wav.frame_features) and header probes."""
    base = wav.detect_baseline(frames, s.baseline_s)
    loud = base.withColumn("above", detect.above_threshold(F.col("flux"), F.col("median"), F.col("mad"), s.factor))
    found = detect.long_enough(detect.merge_gaps(detect.islands(loud, "path", "frame_idx", F.col("above"), "t_s", "flux"), "path", s.merge_gap), s.min_duration)
    # each frame goes to the last event that began by then: events of a recording do not overlap, so no range join is needed
    marks = found.select("path", F.col("onset_s").alias("t_s"), F.struct("onset_s", "offset_s").alias("_e"), F.lit(0).alias("_o"))
    rows = frames.select("path", "t_s", "centroid", "flatness", *[F.col("band_energies")[b].alias(b) for b in s.bands], F.lit(1).alias("_o"))
    held = rows.unionByName(marks, allowMissingColumns=True).withColumn("_e", F.last("_e", ignorenulls=True).over(W.partitionBy("path").orderBy("t_s", "_o")))
    inside = held.filter((F.col("_o") == 1) & (F.col("t_s") <= F.col("_e.offset_s")))
    means = inside.groupBy("path", F.col("_e.onset_s").alias("onset_s")).agg(F.avg("centroid").alias("centroid"), F.avg("flatness").alias("flatness"), *[F.avg(b).alias(b) for b in s.bands])
    table = F.array(*[F.struct(F.lit(i).alias("ord"), F.lit(b).alias("name"), F.col(b).alias("energy")) for i, b in enumerate(s.bands)])
    own = W.partitionBy("path").orderBy("onset_s")
    full = found.join(means, ["path", "onset_s"]).join(probes, "path").withColumns({"event_index": F.row_number().over(own), "_energies": table, "before": F.lag("peak_flux").over(own)})
    full = detect.pad(full, F.col("duration_s"), s.pre_roll, s.post_roll, s.longest_clip).withColumn("rec_hour", F.hour("recorded_at"))
    c = F.col
    heard = full.withColumns({"voices": classify.voices(c("_energies"), c("rec_hour"), c("offset_s") - c("onset_s"), c("flatness"), c("centroid"), c("peak_flux"), c("before")), "mix": classify.band_mix(c("_energies"))})
    maps = [F.map_from_arrays(F.array(*[F.lit(b) for b in s.bands]), F.array(*[F.lit(v[i]) for v in s.bands.values()])) for i in (0, 1)]
    lo, hi = classify.mix_span(c("mix"), c("voices")[0]["band"], *maps)
    return heard.select(
        "path", "recorded_at", "event_index", *[F.round(x, 3).alias(x) for x in ("onset_s", "offset_s", "clip_start_s", "clip_end_s")], F.round(c("offset_s") - c("onset_s"), 3).alias("duration_s"),
        *[F.round(x, 4).alias(x) for x in ("peak_flux", "mean_flux", "flatness")], F.round("centroid", 1).alias("centroid"),
        F.map_from_entries(F.transform("_energies", lambda e: F.struct(e["name"], F.round(e["energy"], 4)))).alias("band_energies"), F.map_from_entries(F.transform("mix", lambda m: F.struct(m["name"], F.round(m["share"], 4)))).alias("band_shares"),
        c("voices")[0]["role"].alias("role"), c("voices")[0]["domain"].alias("domain"), c("voices")[0]["confidence"].alias("confidence"), c("voices")[0]["certainty"].alias("certainty"), c("voices")[0]["band"].alias("dominant_band"),
        F.transform("voices", lambda v: v["role"]).alias("roles"), F.array_sort(F.array_distinct(F.transform("voices", lambda v: v["domain"]))).alias("domains"), classify.mix_label(c("mix")).alias("band_mix"), lo.alias("band_lo_hz"), hi.alias("band_hi_hz"),
    )


def clips(found: DataFrame, s: Settings = Settings()) -> DataFrame:
    """The events that earn a clip: selected, and thinned when clips have one length."""
    chosen = detect.select(found, s.roles, s.domains, s.min_confidence)
    if s.fixed_clip <= 0:
        return chosen
    kept = detect.thin(chosen, "path", "onset_s", s.min_separation or s.fixed_clip / 2, ["event_index"])
    ends = chosen.groupBy("path").agg(F.max("clip_end_s").alias("_end"))
    start, end = detect.fixed_window(F.col("onset_s"), F.col("_end"), s.fixed_clip, s.fixed_pre)
    return chosen.drop("clip_start_s", "clip_end_s").join(kept.select("path", "event_index"), ["path", "event_index"], "left_semi").join(ends, "path").withColumns({"clip_start_s": start, "clip_end_s": end}).drop("_end")


def new_recordings(files: DataFrame, stored: DataFrame) -> DataFrame:
    """Files that stored results (filepath) do not have yet."""
    plain = lambda c: F.regexp_replace(c, "^file:/*", "/")
    return files.withColumn("_p", plain(F.col("path"))).join(stored.select(plain(F.col("filepath")).alias("_p")).distinct(), "_p", "left_anti").drop("_p")


def analyse(spark: SparkSession, *paths: str, settings: Settings = Settings(), stations: DataFrame | None = None, known: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(recordings, events) of all WAV files at or below the paths.

    recordings: a row for each file, silent and unreadable ones too (with error), with its metadata, place, band means and indices. events: as
    of events(), with site, season and cover. Frames are computed once and written to the shared folder. stations (see
    sites.placemarks): each recording and event gets the fields of the station of its cover that was sampled nearest to it. known: stored
    results; recordings that they have are not read again.
    """
    files = wav.recordings(spark, *paths)
    files = files if known is None else new_recordings(files, known)
    rows = staged(metadata.of_probes(wav.probe(files)), "recordings")
    good = rows.filter("error IS NULL")
    frames = staged(wav.frame_features(good, settings.bands, settings.frame, settings.hop, settings.target_rate), "frames")
    found = events(frames, good.select("path", "duration_s", "recorded_at"), settings)
    means = frames.groupBy("path").agg(*[F.avg(F.col("band_energies")[b]).alias(b) for b in settings.bands])
    means = means.select("path", F.create_map(*[x for b in settings.bands for x in (F.lit(b), F.round(b, 4))]).alias("band_energies"))
    measured = wav.file_indices(good, frame=settings.frame, hop=settings.hop)
    measured = measured.select("path", F.create_map(*[x for i in ("aci", "bio", "ndsi", "adi", "aei") for x in (F.lit(i), F.col(i))]).alias("indices"))
    rows = rows.join(means, "path", "left").join(measured, "path", "left")
    own = ["site", "season", "cover"]
    if stations is not None:
        keyed = rows.withColumn("cover_key", F.nullif(normalize_cover(F.coalesce("cover", F.lit(""))), F.lit("")))
        placed = stations.withColumn("cover_key", F.nullif("cover_key", F.lit("")))  # no cover is none to match
        fields = sites.station_fields(placed, keep=("cover_key", "sampled_at", "file_ord"))
        rows = sites.nearest_station(keyed, fields, when="recorded_at").drop("cover_key", "sampled_at", "file_ord")
        own += ["station_id", "latitude", "longitude", "elevation_m"]
    rows = staged(rows, "recordings")
    return rows, staged(found.join(rows.select("path", *own), "path"), "events")


def detect_files(spark: SparkSession, *paths: str, settings: Settings = Settings()) -> DataFrame:
    """Events of all WAV files at or below the paths, with site, season and cover of their folders. Unreadable files give none."""
    return analyse(spark, *paths, settings=settings)[1]


def measured(found: DataFrame) -> DataFrame:
    """Events with indices and band features of their clips."""
    spans = found.select("path", F.col("event_index").cast("long").alias("event_index"), "onset_s", "offset_s", "clip_start_s", "clip_end_s", F.col("band_lo_hz").cast("double").alias("lo_hz"), F.col("band_hi_hz").cast("double").alias("hi_hz"))
    return staged(found.join(wav.measure_clips(spans), ["path", "event_index"]), "measured")


def results(found: DataFrame, recordings: DataFrame | None = None) -> DataFrame:
    """One nested row a recording, as the JSON results have them; recordings without events have none of them in their row.

    Without recordings only those with events have a row.
    """
    of_recording = ("path", "recorded_at", "site", "season", "cover", "duration_of_file")
    event = F.struct(*[c for c in found.columns if c not in of_recording])
    heard = found.groupBy("path").agg(F.array_sort(F.collect_list(event), lambda a, b: a["event_index"] - b["event_index"]).alias("_e"))
    if recordings is None:
        rows = found.groupBy("path", "recorded_at", "season", "cover").agg(F.lit(None).cast("double").alias("duration_s"))
    else:
        rows = recordings.filter("error IS NULL")
    more = {"samplerate_hz": ("sample_rate", "int"), "temperature_c": ("temperature_c", "double"), "indices": ("indices", "map<string,double>"), "band_energies": ("band_energies", "map<string,double>")}
    extra = [(F.col(c) if c in rows.columns else F.lit(None)).cast(t).alias(n) for c, (n, t) in more.items()]
    out = rows.join(heard, "path", "left").withColumn("_e", F.coalesce("_e", F.array().cast(heard.schema["_e"].dataType)))
    has = lambda c: F.size(F.filter("_e", lambda e: e[c].isNotNull())) if c in found.columns else F.lit(0)
    return out.select(
        F.element_at(F.split("path", "/"), -1).alias("filename"), F.col("path").alias("filepath"), F.date_format("recorded_at", "yyyy-MM-dd'T'HH:mm:ss").alias("recording_datetime"), "season", F.col("cover").alias("habitat"),
        "duration_s", *extra, F.size("_e").alias("n_events"), has("clip_path").alias("n_clips"), F.col("_e").alias("events"),
    )


def calendar_of(found: DataFrame, recordings: DataFrame | None = None) -> dict[str, DataFrame]:
    """Daily entries, hours of the day, dawns, dawn shifts and censuses of dated events. recordings (path, recorded_at): all that were
    made, so that silent ones and silent days count."""
    start = lambda at: [F.to_date(at).alias("day"), F.col(at).alias("rec_start"), F.hour(at).alias("rec_hour"), F.minute(at).alias("rec_minute")]
    dated = found.filter("recorded_at IS NOT NULL").select(F.col("path").alias("recording"), *start("recorded_at"), "onset_s", "role", "domain", "dominant_band", F.col("event_index").alias("event_id"))
    made = None if recordings is None else recordings.filter("recorded_at IS NOT NULL").select(F.col("path").alias("recording"), *start("recorded_at"))
    dawn = calendar.dawn_onset(dated)
    pattern = calendar.diel_pattern(dated, made)
    more = {} if recordings is None or "indices" not in recordings.columns else frames_and_shifts(dated, recordings, calendar.daily(dated, made), dawn)
    return more | {"daily": calendar.daily(dated, made), "hourly": calendar.hourly(dated, made, by_start=True), "diel": pattern, "diel_table": calendar.diel_table(pattern), "dawn": dawn, "dawn_shift": calendar.dawn_shift(dawn), "census": census.parliament(dated, ["recording"]), "census_all": census.parliament_rollup(dated, "recording")}


def frames_and_shifts(dated: DataFrame, recordings: DataFrame, daily: DataFrame, dawn: DataFrame) -> dict[str, DataFrame]:
    """Control frames of all days, and changes from day to day. recordings: path, recorded_at, indices, band_energies."""
    day = F.to_date("recorded_at").alias("day")
    measured = recordings.filter("recorded_at IS NOT NULL").groupBy(day).agg(*[F.avg(F.col("indices")[i]).alias(i) for i in ("ndsi", "adi", "aci")], *[F.sum(F.col("band_energies")[b]).alias(n) for b, n in (("biophony_low", "low"), ("biophony_high", "high"))])
    days = daily.join(measured, "day", "left").join(dawn.select("day", F.col("onset_minutes").alias("dawn")), "day", "left")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0.0)).cast("double")
    days = days.withColumns({"activity": F.col("events_per_recording"), "richness": F.col("richness").cast("double"), **{d: zero(f"{d}_share") for d in ("biophony", "geophony", "anthrophony")}, **{c: zero(c) for c in ("ndsi", "adi", "aci", "low", "high")}})
    roles = dated.groupBy("day").agg(F.collect_set("role").alias("roles"))
    return {"frames": calendar.cv_frames(days.drop("low", "high")), "shifts": calendar.shifts(days.select("day", "day_of_year", "low", "high", "adi", "n_geophony"), roles, dawn)}


def export(found: DataFrame, root: str, organize_by: str = "role", s: Settings = Settings()) -> DataFrame:
    """Events with the clip that was cut for each selected one below root, or why there is none."""
    cut = annotations.cut_clips(clips(found, s), root, organize_by).select("path", F.col("event_index").cast("int").alias("event_index"), F.col("clip").alias("clip_path"))
    return found.join(staged(cut, "clips"), ["path", "event_index"], "left").withColumn("clip_skipped", F.when(F.col("clip_path").isNull(), "not selected"))
