"""What recorders and file names say about recordings: header comments, metadata rows, summaries and table filters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sonoframe.functions.text import file_url, place_from_path, quality_label


def recorder_fields(comment: Column) -> dict[str, Column]:
    """Id, time, zone, gain, battery and temperature of a recorder's header comment; null where it does not say.

    Fixed values: the wordings of the recorder's firmware, such as "Recorded at 19:17:30 20/02/2019 (UTC-5) by AudioMoth
    24E144085F256D88 at medium gain while battery was 4.2V and temperature was 19.2C."
    """
    part = lambda pattern, group=1: F.nullif(F.regexp_extract(comment, pattern, group), F.lit(""))
    at = F.concat_ws(" ", part(r"Recorded at (\d{2}:\d{2}:\d{2}) (\d{2}/\d{2}/\d{4})", 2), part(r"Recorded at (\d{2}:\d{2}:\d{2}) (\d{2}/\d{2}/\d{4})", 1))
    return {
        "audiomoth_id": part(r"AudioMoth ([0-9A-F]{16})"),
        "header_at": F.try_to_timestamp(F.nullif(at, F.lit("")), F.lit("dd/MM/yyyy HH:mm:ss")).cast("timestamp_ntz"),
        "timezone": part(r"\((UTC[^)]*)\)"),
        "gain": F.coalesce(part(r"at ((?:low|medium)-?(?:medium|high)?|high) gain"), part(r"gain setting (\d)")),
        "battery_v": part(r"battery (?:state )?was (?:less than |greater than )?(\d+(?:\.\d+)?)V").try_cast("double"),
        "temperature_c": part(r"temperature was (-?\d+(?:\.\d+)?)C").try_cast("double"),
    }


def of_probes(probes: DataFrame) -> DataFrame:
    """A metadata row for each probed file (path, samplerate_hz, duration_s, comment, recorded_at, error), errors included.

    The time is the header's, else the name's.
    """
    fields = recorder_fields(F.coalesce("comment", F.lit("")))
    place = place_from_path(F.col("path"))
    name = F.element_at(F.split("path", "/"), -1)
    where = F.concat_ws(" ", F.nullif("cover", F.lit("")), F.concat(F.lit("("), "season", F.lit(")")), F.concat(F.lit("- "), "site"))
    rows = probes.select("path", name.alias("filename"), file_url(F.regexp_replace("path", "^file:(//)?", "")).alias("file_url"), F.coalesce(fields.pop("header_at"), F.col("recorded_at")).alias("recorded_at"), "samplerate_hz", "duration_s", "error", *[v.alias(k) for k, v in (fields | place).items()])
    return rows.withColumns({"location": F.coalesce(F.nullif(where, F.lit("")), F.lit("Ubicación no especificada")), "quality": quality_label(F.coalesce("samplerate_hz", F.lit(0)))})


def summary(rows: DataFrame, keys: list[str], failed: Column, length: Column, place: str) -> DataFrame:
    """Files, failures, summed length and places of each key, or of all."""
    return rows.groupBy(*keys).agg(F.count("*").alias("n"), F.count_if(failed).alias("n_errors"), F.sum(length).alias("total"), F.count_distinct(place).alias("n_places"))


def per_hour(rows: DataFrame, hour: str) -> DataFrame:
    """Files that began in each of the 24 hours."""
    counts = rows.groupBy(F.col(hour).alias("_h")).count()
    grid = rows.sparkSession.range(24).select(F.col("id").cast("int").alias("hour"))
    return grid.join(counts, F.col("hour") == F.col("_h"), "left").select("hour", F.coalesce("count", F.lit(0)).alias("n"))


def by_place(rows: DataFrame, place: str, value: str) -> DataFrame:
    """Quartiles, mean, deviation and number of a place's values; nulls and zeros are no readings."""
    q = lambda p, n: F.round(F.percentile(value, F.lit(p)), 4).alias(n)
    read = rows.filter(F.col(value).isNotNull() & (F.col(value) != 0))
    return read.groupBy(place).agg(q(0.25, "q1"), q(0.5, "median"), q(0.75, "q3"), F.round(F.avg(value), 4).alias("mean"), F.round(F.coalesce(F.stddev(value), F.lit(0.0)), 4).alias("sd"), F.count("*").alias("n"))


def table_filter(rows: DataFrame, text: str = "", place: str = "", name_col: str = "filename", place_col: str = "location") -> DataFrame:
    """Rows whose file name holds the text, whatever its case, and whose place is the one asked for; empty asks for all."""
    if text:
        rows = rows.filter(F.lower(name_col).contains(text.lower()))
    return rows.filter(F.col(place_col) == place) if place else rows
