"""Series that reports draw: events on a time line, their peaks and indices, shares of domains, groups by count."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sonoframe.functions.bands import lookup

# Colour of each domain; grey for others.
DOMAIN_COLOURS = {"biophony": "#27ae60", "geophony": "#3498db", "anthrophony": "#e74c3c", "transition": "#f39c12"}
GREY = "#95a5a6"


def in_order(events: DataFrame, keys: list[str], order: list[str], fields: list[str]) -> DataFrame:
    """The fields of each key's events as one array of structs in order. An array holds one recording's events, no more."""
    rows = events.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(*order, *[c for c in fields if c not in order]))).alias("_s"))
    return rows.select(*keys, *[F.col("_s")[c].alias(c) for c in fields])


def time_line(events: DataFrame, key: str) -> DataFrame:
    """A bar series for each domain of a recording: bases and lengths, in event order, and its colour."""
    bars = events.withColumns({"base": F.col("onset_s"), "length": F.col("offset_s") - F.col("onset_s"), "domain": F.coalesce("domain", F.lit("unknown"))})
    return in_order(bars, [key, "domain"], ["onset_s", "event_id"], ["base", "length"]).withColumn("colour", lookup(F.col("domain"), DOMAIN_COLOURS, GREY))


def flux_series(events: DataFrame, key: str) -> DataFrame:
    """Onset, peak, role and colour of a recording's events."""
    return in_order(events.withColumn("colour", lookup(F.coalesce("domain", F.lit("")), DOMAIN_COLOURS, GREY)), [key], ["onset_s", "event_id"], ["onset_s", "peak_flux", "role", "colour"])


def index_series(events: DataFrame, key: str, indices: tuple[str, ...] = ("aci", "ndsi", "adi")) -> DataFrame:
    """Indices of a recording's events, 0 where they were not measured, with labels E1, E2, ..."""
    zeros = events.withColumns({c: F.coalesce(F.col(c), F.lit(0.0)) for c in indices})
    rows = in_order(zeros, [key], ["onset_s", "event_id"], list(indices))
    return rows.withColumn("labels", F.transform(F.sequence(F.lit(1), F.size(indices[0])), lambda i: F.concat(F.lit("E"), i.cast("string"))))


def pie(census: DataFrame, key: str) -> DataFrame:
    """A row for each domain that a recording has, with its percentage and colour. census: see census.parliament."""
    parts = F.explode(F.array(*[F.struct(F.lit(d).alias("domain"), F.col(f"pct_{d}").alias("percent"), F.lit(c).alias("colour")) for d, c in DOMAIN_COLOURS.items()]))
    return census.select(key, parts.alias("_p")).select(key, "_p.*").filter("percent > 0")


def by_count(rows: DataFrame, value: str, order: list[str]) -> DataFrame:
    """Each value with its number of rows and its place: the most frequent first, of equals the one seen first."""
    counts = rows.groupBy(value).agg(F.count("*").alias("n"), F.min(F.struct(*order)).alias("_first"))
    return counts.orderBy(F.desc("n"), "_first").select(value, "n")
