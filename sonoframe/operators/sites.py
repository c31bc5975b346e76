"""Stations of a survey: reading them from KML text and matching recordings to the nearest in time."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sonoframe.functions.text import normalize_cover, survey_date


def placemarks(texts: DataFrame, text: str = "value") -> DataFrame:
    """A row for each placemark that has coordinates: attributes (map), lon, lat, sampled_at, cover_key."""
    blocks = texts.select(F.posexplode(F.regexp_extract_all(text, F.lit("(?s)<Placemark[^>]*>(.*?)</Placemark>"), F.lit(1))).alias("file_ord", "_b"))
    pairs = F.regexp_extract_all("_b", F.lit('(?s)<SimpleData name="[^"]+">.*?</SimpleData>'), F.lit(0))
    entry = lambda p: F.struct(F.regexp_extract(p, 'name="([^"]+)"', 1).alias("key"), F.trim(F.regexp_extract(p, "(?s)>(.*)</SimpleData>", 1)).alias("value"))
    # of repeated names the last counts
    attributes = F.aggregate(F.transform(pairs, entry), F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<string>")), lambda m, e: F.map_concat(F.map_filter(m, lambda k, v: k != e["key"]), F.map_from_arrays(F.array(e["key"]), F.array(e["value"]))))
    place = "<coordinates>\\s*([-0-9.]+),([-0-9.]+)"
    rows = blocks.select("file_ord", attributes.alias("attributes"), F.regexp_extract("_b", place, 1).try_cast("double").alias("lon"), F.regexp_extract("_b", place, 2).try_cast("double").alias("lat"))
    return rows.filter("lon IS NOT NULL AND lat IS NOT NULL").withColumns({"sampled_at": survey_date(F.coalesce(F.col("attributes")["FEC_MUEST"], F.lit(""))), "cover_key": normalize_cover(F.coalesce(F.col("attributes")["N_COBERT"], F.lit("")))})


def station_fields(stations: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """The fields that go onto every event, after columns to keep: a blank elevation is 0, one that is no number is null."""
    a = lambda k: F.coalesce(F.col("attributes")[k], F.lit(""))
    elevation = F.when(a("COTA") == "", 0.0).otherwise(F.round(a("COTA").try_cast("double"), 1))
    return stations.select(
        *keep, a("ID_MUES_PT").alias("station_id"), F.round("lat", 6).alias("latitude"), F.round("lon", 6).alias("longitude"), elevation.alias("elevation_m"),
        a("VEREDA").alias("locality"), a("NOMENCLAT").alias("corine_code"), a("HABITAT").alias("habitat_description"), a("PROYECTO").alias("project"),
    )


def nearest_station(recordings: DataFrame, stations: DataFrame, key: str = "cover_key", when: str = "at", sampled: str = "sampled_at", station_id: str = "station_id", ord_col: str = "file_ord", cell_days: float = 1.0) -> DataFrame:
    """Each recording with the station of its cover that was sampled nearest to it, in either direction.

    Undated stations count only where no dated one is, or the recording has no date; ties go to the first in the file.
    Left outer: a recording without a cover, or whose cover has no station, keeps nulls. An as-of match both ways: recordings and stations of a cover and a cell of
    time are ordered together, and each recording takes the last station before and the first after it; what lies in
    other cells comes from a table of cells. No pairs are made, and a cover with most of the recordings is as many groups as it has cells.
    """
    columns = [c for c in stations.columns if c != key]
    micros = lambda c: F.unix_micros(F.col(c).cast("timestamp"))
    cell = lambda t: F.floor(t / F.lit(cell_days * 86_400e6))
    first = lambda rows, *by: rows.groupBy(*by).agg(F.min_by("_s", F.struct(F.col("_s")[ord_col].isNull(), F.col("_s")[ord_col], F.col("_s")[station_id])).alias("_s"))
    plots = stations.select(F.col(key).alias("_k"), micros(sampled).alias("_t"), F.struct(*columns).alias("_s")).filter("_k IS NOT NULL")
    default = first(plots, "_k").withColumnRenamed("_s", "_default")
    dated = first(plots.filter("_t IS NOT NULL"), "_k", "_t").withColumns({"_c": cell(F.col("_t")), "_at": F.struct(F.col("_t").alias("t"), F.col("_s").alias("s"))})
    made = recordings.withColumns({"_k": F.col(key), "_t": micros(when)}).withColumn("_c", cell(F.col("_t")))
    row = F.struct(*[c for c in recordings.columns])
    both = made.select("_k", "_c", "_t", row.alias("_r"), F.lit(None).cast(dated.schema["_at"].dataType).alias("_at")).filter("_t IS NOT NULL AND _k IS NOT NULL")
    both = both.unionByName(dated.select("_k", "_c", "_t", F.lit(None).cast(both.schema["_r"].dataType).alias("_r"), "_at"))
    inside = W.partitionBy("_k", "_c").orderBy("_t")
    held = both.withColumns({"_before": F.last("_at", ignorenulls=True).over(inside.rangeBetween(W.unboundedPreceding, 0)), "_after": F.first("_at", ignorenulls=True).over(inside.rangeBetween(0, W.unboundedFollowing))}).filter("_r IS NOT NULL")
    cells = both.groupBy("_k", "_c").agg(F.max_by("_at", F.col("_at")["t"]).alias("_last"), F.min_by("_at", F.col("_at")["t"]).alias("_first"))
    along = W.partitionBy("_k").orderBy("_c")
    cells = cells.select("_k", "_c", F.last("_last", ignorenulls=True).over(along.rowsBetween(W.unboundedPreceding, -1)).alias("_earlier"), F.first("_first", ignorenulls=True).over(along.rowsBetween(1, W.unboundedFollowing)).alias("_later"))
    held = held.join(cells, ["_k", "_c"]).select("_k", "_t", "_r", F.coalesce("_before", "_earlier").alias("_a"), F.coalesce("_after", "_later").alias("_b"))
    away = lambda c: F.when(F.col(c).isNotNull(), F.struct(F.abs(F.col(c)["t"] - F.col("_t")).alias("d"), F.col(c)["s"][ord_col].isNull().alias("n"), F.col(c)["s"][ord_col].alias("o"), F.col(c)["s"][station_id].alias("i"), F.col(c)["s"].alias("s")))
    a, b = away("_a"), away("_b")
    order = lambda x: F.struct(x["d"], x["n"], x["o"], x["i"])
    near = held.select("_k", "_r", F.when(a.isNull() | (b.isNotNull() & (order(b) < order(a))), b["s"]).otherwise(a["s"]).alias("_s"))
    undated = made.filter("_t IS NULL OR _k IS NULL").select("_k", row.alias("_r"), F.lit(None).cast(near.schema["_s"].dataType).alias("_s"))
    found = near.unionByName(undated).join(default, "_k", "left").withColumn("_s", F.coalesce("_s", "_default"))
    return found.select(F.col(f"_r.{key}").alias(key), *[F.col(f"_r.{c}").alias(c) for c in recordings.columns if c != key], *[F.col(f"_s.{c}").alias(c) for c in columns])
