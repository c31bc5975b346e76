"""Stored results: one JSON document for each recording, calendars, tidy CSV, text bundles."""

from __future__ import annotations

from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sonoframe.functions.text import iso_datetime, relative_href

EVENT = (
    "event_index int, onset_s double, offset_s double, clip_start_s double, clip_end_s double, duration_s double, peak_flux double, mean_flux double, centroid double, flatness double, "
    "band_energies map<string,double>, band_shares map<string,double>, role string, domain string, certainty string, dominant_band string, band_mix string, reasoning string, confidence double, "
    "roles array<string>, domains array<string>, band_lo_hz int, band_hi_hz int, station_id string, latitude double, longitude double, elevation_m double, aci double, bio double, ndsi double, adi double, aei double, "
    "clip_path string, video_path string, poster_path string, thumbnail_path string, gif_path string, clip_skipped string"
)
RESULT = (
    "filename string, filepath string, recording_datetime string, duration_s double, sample_rate int, habitat string, season string, temperature_c double, indices map<string,double>, band_energies map<string,double>, "
    f"n_events int, n_clips int, output_dir string, events array<struct<{', '.join(': '.join(c.split(' ', 1)) for c in EVENT.split(', '))}>>"
)


def write_results(results: DataFrame, path: str, folders: bool = False, add: bool = False) -> None:
    """One JSON object a line for each recording, in as many files as there are partitions.

    With folders each recording has one of its own, named by its whole path, so equal file names don't collide: for surveys of
    thousands of recordings, not for millions. With add they join the results that are there.
    """
    mode = "append" if add else "overwrite"
    if folders:
        results.withColumn("recording_id", F.sha2(F.coalesce("filepath", F.lit("")), 256)).write.mode(mode).partitionBy("recording_id").json(path)
    else:
        results.write.mode(mode).json(path)


def read_results(spark: SparkSession, path: str, multi_line: bool = False) -> DataFrame:
    """All results below a path, dated ones first and in order. Missing keys are null, ndsi is lifted from the indices."""
    rows = spark.read.schema(RESULT).option("multiLine", multi_line).option("recursiveFileLookup", "true").option("pathGlobFilter", "*.json").json(path)
    rows = rows.withColumns({"recorded_at": iso_datetime(F.col("recording_datetime")), "source_path": F.col("_metadata.file_path"), "ndsi": F.coalesce(F.col("indices")["ndsi"], F.lit(0.0))})
    return rows.orderBy(F.asc_nulls_last("recorded_at"), "source_path")


def events_of(results: DataFrame) -> DataFrame:
    """A row for each event of each recording."""
    own = [c for c in ("path", "filename", "recorded_at", "habitat", "season") if c in results.columns]
    return results.select(*own, F.explode("events").alias("_e")).select(*own, "_e.*")


def gallery(events: DataFrame, base: str) -> DataFrame:
    """Events that have a clip or a video, by domain, role and confidence."""
    shown = events.filter(F.coalesce("clip_path", "video_path").isNotNull())
    return shown.withColumns({c: relative_href(F.col(c), base) for c in ("clip_path", "video_path")}).orderBy("domain", "role", F.desc("confidence"))


def search(events: DataFrame, text: str = "", hidden: tuple[str, ...] = ()) -> DataFrame:
    """Events whose role, domain, band, habitat, season, certainty or file holds the text, of domains not hidden."""
    blob = F.lower(F.concat_ws(" ", "role", "domain", "dominant_band", "habitat", "season", "certainty", "filename"))
    found = events.filter(blob.contains(text.lower()))
    return found.filter(~F.col("domain").isin(*hidden)) if hidden else found


def write_calendar(frames: DataFrame, path: str) -> None:
    """The calendar as JSON lines."""
    frames.select(F.to_json(F.struct("*")).alias("value")).write.mode("overwrite").text(path)


def read_calendar(spark: SparkSession, path: str) -> DataFrame:
    """A stored calendar; an error without days."""
    frames = spark.read.json(path)
    if "day" not in frames.columns:
        raise ValueError(f"{path} is no calendar")
    return frames


def write_csv(frames: DataFrame, path: str) -> None:
    """A tidy CSV, a row a day in order over its parts; nulls are empty."""
    frames.orderBy("day").write.mode("overwrite").csv(path, header=True, nullValue="")


def write_lines(lines: DataFrame, path: str) -> None:
    """Text lines, in their order over numbered parts: sorted lines stay in the ranges that the sort made, and no task writes them all."""
    lines.write.mode("overwrite").text(path)


def find_first(start: str, patterns: tuple[str, ...], upward: int = 1) -> str | None:
    """The first file, by name, of the first pattern that has any, at a local folder or one of those above it: a station table
    beside the recordings ("Ubicacion/KML/*.kml", "*.kml", "**/AudioMoth.kml"), a stored calendar ("**/calendar*.json")."""
    here = Path(start).resolve()
    here = here.parent if here.is_file() else here
    for folder in [here, *here.parents][:upward]:
        for pattern in patterns:
            if found := sorted(folder.glob(pattern)):
                return str(found[0])
    return None


#: where station tables lie
STATION_TABLES = ("Ubicacion/KML/*.kml", "*.kml", "**/AudioMoth.kml")
