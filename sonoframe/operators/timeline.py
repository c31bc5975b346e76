"""Timed control messages: events and days exploded into (at, seq, addr, args)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sonoframe.functions.bands import CV_FIELDS, colour_of
from sonoframe.functions.text import fixed, hz_to_voct


def _m(addr: str, *args: Column) -> Column:
    return F.struct(F.lit(addr).alias("addr"), F.array(*[a.cast("string") for a in args]).alias("args"))


def number(x: Column, digits: int = 4) -> Column:
    """A number as text with fixed digits, as printf and Python write it."""
    return fixed(x.cast("double"), digits)


def decimal(x: Column, digits: int = 4) -> Column:
    """A number that stands for its shortest decimal form, times of whole microseconds and shares of counts, as text with fixed digits; halves go up."""
    return F.format_string(f"%.{digits}f", x.cast("double"))


def event_messages(events: DataFrame, namespace: str = "/parliament") -> DataFrame:
    """24 messages an event, at its onset and in the order of the address list."""
    ns, c = namespace.rstrip("/"), lambda n, d: F.coalesce(F.col(n), F.lit(d)) if n in events.columns else F.lit(d)
    centroid, flux, band = c("centroid", 440.0), c("peak_flux", 0.0), c("dominant_band", "unknown")
    own = [
        _m(f"{ns}/event", F.lit(1)), _m(f"{ns}/event/onset", decimal(c("onset_s", 0.0))), _m(f"{ns}/event/duration", number(c("offset_s", 0.0) - c("onset_s", 0.0))),
        _m(f"{ns}/event/role", c("role", "unknown")), _m(f"{ns}/event/domain", c("domain", "unknown")), _m(f"{ns}/event/band", band),
        _m(f"{ns}/event/centroid", number(centroid)), _m(f"{ns}/event/voct", number(hz_to_voct(centroid))), _m(f"{ns}/event/flatness", number(c("flatness", 0.0))),
        _m(f"{ns}/event/flux", number(flux)), _m(f"{ns}/event/confidence", number(c("confidence", 0.0))),
        *[_m(f"{ns}/event/{i}", number(c(i, 0.0))) for i in ("aci", "ndsi", "bio", "adi")],
        _m(f"{ns}/habitat", c("habitat", "unknown")), _m(f"{ns}/season", c("season", "unknown")), _m(f"{ns}/temperature", number(c("temperature_c", 0.0))),
        _m(f"{ns}/hour", c("rec_hour", 0)), _m(f"{ns}/democracy_index", number(c("democracy_index", 0.0))),
        _m("/ilda/color", colour_of(band)), _m("/ilda/intensity", number(c("confidence", 0.0))),
        _m("/ilda/angle", number(F.least(centroid / 10000.0, F.lit(1.0)))), _m("/ilda/speed", number(F.least(flux / 100.0, F.lit(1.0)))),
    ]
    return events.select("event_id", F.col("onset_s").alias("at"), F.posexplode(F.array(*own)).alias("seq", "_m")).select("event_id", "at", "seq", "_m.addr", "_m.args")


def day_messages(frames: DataFrame, changes: DataFrame, rate: float = 1.0, namespace: str = "/phenology") -> DataFrame:
    """Days at their index over rate, changes a millisecond after their day, an end message last. frames: day, day_of_year,
    n_recordings, n_events, CV fields and cv_<field>s, dominant_role. changes: day, type, day_of_year, magnitude."""
    ns, rate = namespace.rstrip("/"), rate if rate > 0 else 1.0
    placed = frames.withColumn("_i", F.row_number().over(W.orderBy("day")) - 1)
    zero = lambda c: F.coalesce(F.col(c).cast("double"), F.lit(0.0))
    day = [
        _m(f"{ns}/day", F.col("_i"), F.col("day"), F.col("day_of_year")), _m(f"{ns}/day/recordings", F.col("n_recordings")), _m(f"{ns}/day/events", F.col("n_events")),
        *[_m(f"{ns}/day/{c}", number(zero(c)), number(zero(f"cv_{c}"))) for c in CV_FIELDS], _m(f"{ns}/day/dominant_role", F.col("dominant_role")),
    ]
    change = [_m(f"{ns}/event", F.col("type"), F.col("day"), F.col("day_of_year"), number(F.col("magnitude"), 3)), _m(f"{ns}/event/type", F.col("type")), _m(f"{ns}/event/day_of_year", F.col("day_of_year"))]
    flat = lambda df, at, group, sub, m: df.select(at.alias("at"), group.alias("grp"), sub.alias("sub"), F.posexplode(F.array(*m)).alias("seq", "_m")).select("at", "grp", "sub", "seq", "_m.addr", "_m.args")
    slots = placed.select("day", (F.col("_i") / rate).alias("_at"))
    shifted = changes.join(slots, "day", "left")
    end = placed.agg(F.count("*").alias("n")).filter("n > 0")
    return (
        flat(placed, F.col("_i") / rate, F.lit(1), F.lit(""), day)
        .unionByName(flat(shifted, F.coalesce("_at", F.lit(0.0)) + 1e-3, F.lit(2), F.col("type"), change))
        .unionByName(flat(end, F.col("n") / rate, F.lit(3), F.lit(""), [_m(f"{ns}/end", F.lit(1))]))
        .orderBy("at", "grp", "sub", "seq")
    )


def header_messages(frames: DataFrame, diel: DataFrame, dawn: DataFrame, rate: float = 1.0, namespace: str = "/phenology") -> DataFrame:
    """What a receiver needs first, all at 0: extent and speed, ranges of the control fields, the hours of the day, dawns.

    frames: as for day_messages; diel: hour, level; dawn: onset_minutes. Each becomes one small row before it is sent.
    """
    ns = namespace.rstrip("/")
    fixed = {"biophony": (0.0, 1.0), "geophony": (0.0, 1.0), "anthrophony": (0.0, 1.0), "ndsi": (-1.0, 1.0)}
    span = lambda c, i: F.lit(fixed[c][i]) if c in fixed else F.coalesce((F.max if i else F.min)(c).cast("double"), F.lit(0.0))
    extent = frames.agg(F.count("*").alias("n"), F.min("day").alias("first"), F.max("day").alias("last"), *[span(c, i).alias(f"{c}_{i}") for c in CV_FIELDS for i in (0, 1)])
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    a = extent.select(F.explode(F.array(_m(f"{ns}/meta", F.col("n"), text("first"), text("last"), number(F.lit(rate))), *[_m(f"{ns}/range/{c}", number(F.col(f"{c}_0")), number(F.col(f"{c}_1"))) for c in CV_FIELDS])).alias("_m"), F.lit(0).alias("grp"))
    levels = diel.agg(F.array_sort(F.collect_list(F.struct("hour", "level"))).alias("h")).filter(F.size("h") > 0)
    peak = F.array_sort(F.transform("h", lambda x: F.struct((-x["level"]).alias("n"), x["hour"].alias("hour"))))[0]["hour"]
    table = F.struct(F.lit(f"{ns}/diel/table").alias("addr"), F.transform("h", lambda x: number(x["level"])).alias("args"))
    b = levels.select(F.explode(F.array(table, _m(f"{ns}/diel/peak_hour", peak))).alias("_m"), F.lit(1).alias("grp"))
    dawns = dawn.agg(*[f("onset_minutes").alias(n) for f, n in ((F.avg, "mean"), (F.min, "first"), (F.max, "last"))]).filter("mean IS NOT NULL")
    c = dawns.select(F.explode(F.array(*[_m(f"{ns}/dawn_chorus/{n}", number(F.col(n))) for n in ("mean", "first", "last")])).alias("_m"), F.lit(2).alias("grp"))
    return a.unionByName(b).unionByName(c).select(F.lit(0.0).alias("at"), "grp", "_m.addr", "_m.args")


def role_messages(day_roles: DataFrame, namespace: str = "/phenology") -> DataFrame:
    """A message for each role of a day, the most frequent first: count and share. day_roles: day, role, n."""
    ns = namespace.rstrip("/")
    own = W.partitionBy("day")
    placed = day_roles.withColumns({"seq": F.row_number().over(own.orderBy(F.desc("n"), "role")) - 1, "_all": F.sum("n").over(own)})
    return placed.select("day", "seq", F.lit(f"{ns}/day/role").alias("addr"), F.array("role", F.col("n").cast("string"), decimal(F.col("n") / F.greatest("_all", F.lit(1)))).alias("args"))


def hourly_messages(hours: DataFrame, namespace: str = "/phenology") -> DataFrame:
    """One message a day with its 24 counts. hours: day, hour, n_events, all hours there."""
    counts = hours.groupBy("day").agg(F.array_sort(F.collect_list(F.struct("hour", "n_events"))).alias("h"))
    return counts.select("day", F.lit(f"{namespace.rstrip('/')}/day/hourly").alias("addr"), F.transform("h", lambda x: x["n_events"].cast("string")).alias("args"))


def address_map(namespace: str = "/phenology", queries: tuple[str, ...] = ("meta", "day", "date", "next", "prev", "events", "reply_port")) -> dict[str, str]:
    """Addresses that a receiver may see or send, with what their arguments are."""
    ns = namespace.rstrip("/")
    out = {f"{ns}/meta": "days, first, last, days a second", f"{ns}/day": "index, date, day of year", f"{ns}/day/recordings": "count", f"{ns}/day/events": "count", f"{ns}/day/dominant_role": "role", f"{ns}/day/role": "role, count, share", f"{ns}/day/hourly": "24 counts", f"{ns}/event": "type, date, day of year, magnitude", f"{ns}/end": "1"}
    out |= {f"{ns}/day/{c}": "raw, 0 to 1" for c in CV_FIELDS} | {f"{ns}/range/{c}": "least, most" for c in CV_FIELDS}
    return out | {f"/query/{q}": "request" for q in queries}


def season_messages(frames: DataFrame, changes: DataFrame, diel: DataFrame, dawn: DataFrame, rate: float = 1.0, namespace: str = "/phenology") -> DataFrame:
    """The whole season in order: what a receiver needs first, then days, changes and the end."""
    head = header_messages(frames, diel, dawn, rate, namespace).withColumns({"sub": F.lit(""), "seq": F.lit(0), "_before": F.lit(0)})
    days = day_messages(frames, changes, rate, namespace).withColumn("_before", F.lit(1))
    return head.unionByName(days).orderBy("_before", "at", "grp", "sub", "seq", "addr").drop("_before")


def bundle_lines(messages: DataFrame) -> DataFrame:
    """Tab-separated text: time, address, arguments."""
    return messages.select(F.concat_ws("\t", F.format_string("%.4f", "at"), F.col("addr"), F.array_join("args", "\t")).alias("value"))


def score_lines(messages: DataFrame) -> DataFrame:
    """Score text: [time, [address, arguments]], with text arguments quoted."""
    quote = lambda a: F.when(a.rlike("^-?[0-9]+(\\.[0-9]+)?$"), a).otherwise(F.concat(F.lit('"'), F.replace(F.replace(a, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"')), F.lit('"')))
    return messages.select(F.concat(F.lit("["), F.format_string("%.6f", "at"), F.lit(', ["'), F.col("addr"), F.lit('"'), F.array_join(F.transform("args", lambda a: F.concat(F.lit(", "), quote(a))), ""), F.lit("]],")).alias("value"))


def step(frames: DataFrame, at: int, by: int) -> DataFrame:
    """The day `by` steps from day number `at`, around the end of the calendar."""
    n = F.count("*").over(W.partitionBy())
    return frames.withColumns({"_i": F.row_number().over(W.orderBy("day")) - 1, "_n": n}).filter(F.col("_i") == F.pmod(F.lit(at + by), F.col("_n"))).drop("_i", "_n")
