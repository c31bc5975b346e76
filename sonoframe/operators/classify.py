"""Roles of events: an ordered rule list as one CASE, applied to up to three bands of an event."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from sonoframe.functions.bands import certainty, domain_of, is_bat_band, is_high


def transition(peak: Column, before: Column) -> Column:
    """Role by the change since the event before; null if it is neither rise nor fall, or there is none."""
    ratio = F.when(before.isNotNull(), peak / F.greatest(before, F.lit(1e-10)))  # greatest() passes over nulls
    return F.when(ratio > 5, "silence_to_activity").when(ratio < 0.2, "activity_to_silence")


def role_rules(band: Column, hour: Column, duration: Column, flatness: Column, centroid: Column, peak: Column, n_bands: Column, share: Column) -> Column:
    """struct(role, confidence) of the first rule that holds."""
    hour = F.coalesce(hour, F.lit(12))
    low, mid, geo = band == "biophony_low", band == "biophony_mid", band == "geophony"
    noise = geo & (flatness > 0.30)
    machine = geo & (flatness > 0.15) & (centroid < 1500)
    night = (hour >= 20) | (hour < 4)
    tonal = low & (flatness < 0.15)
    rules = [
        (noise & (duration > 30), "rain_event", 0.75),
        (noise & (duration > 10), "wind_event", 0.65),
        (noise, "water_flow", 0.5),
        (machine & (duration > 20), "mechanical_intrusion", 0.6),
        (machine & (duration > 5) & (duration < 60) & (centroid < 800), "aircraft_passage", 0.55),
        (is_bat_band(band) & (duration > 10), "insect_chorus", 0.6),
        (is_bat_band(band) & (duration <= 5), "bat_echolocation", 0.5),
        (is_bat_band(band), "insect_chorus", 0.4),
        (hour.between(4, 7) & (mid | low), "dawn_chorus_participant", 0.8),
        (hour.between(17, 19) & (mid | low), "dusk_chorus_participant", 0.75),
        (night & tonal, "amphibian_assembly", 0.7),
        (night & is_high(band), "nocturnal_voice", 0.65),
        (night & mid, "nocturnal_voice", 0.6),
        (is_high(band) & (duration > 10), "insect_chorus", 0.7),
        (tonal & (duration > 5), "amphibian_assembly", 0.65),
        ((duration < 5) & (peak > 0) & mid, "alarm_or_alert", 0.5),
        (mid & (flatness < 0.20) & (duration > 2) & (duration < 30), "territorial_announcement", 0.55),
        ((n_bands >= 3) & (share < 0.4), "community_shift", 0.45),
        (mid | low, "territorial_announcement", 0.3),
        (is_high(band), "insect_chorus", 0.3),
    ]
    out = F.when(F.lit(False), _voice("", 0.0))
    for condition, role, confidence in rules:
        out = out.when(condition, _voice(role, confidence))
    return out.otherwise(_voice("community_shift", 0.2))


def _voice(role: str, confidence: float) -> Column:
    return F.struct(F.lit(role).alias("role"), F.lit(float(confidence)).alias("confidence"))


def single(band: Column, hour: Column, duration: Column, flatness: Column, centroid: Column, peak: Column, before: Column, n_bands: Column, share: Column) -> Column:
    """struct(role, confidence) of one label, the change since the event before included."""
    change = transition(peak, before)
    return F.when(change.isNotNull(), F.struct(change.alias("role"), F.lit(0.7).alias("confidence"))).otherwise(role_rules(band, hour, duration, flatness, centroid, peak, n_bands, share))


def ranked_bands(energies: Column) -> Column:
    """array<struct(neg, ord, name, energy)> by energy, then by the table's order. energies: array<struct(ord, name, energy)>."""
    return F.array_sort(F.transform(energies, lambda e: F.struct((-e["energy"]).alias("neg"), e["ord"].alias("ord"), e["name"].alias("name"), e["energy"].alias("energy"))))


def let(value: Column, use) -> Column:
    """use(value) with value evaluated once: lambda variables are bound, repeated expressions in them are not shared."""
    return F.element_at(F.transform(F.array(value), use), 1)


def voices(energies: Column, hour: Column, duration: Column, flatness: Column, centroid: Column, peak: Column, before: Column) -> Column:
    """array<struct(role, domain, confidence, certainty, band)>, the primary first: one for each of the three strongest bands
    with 15 % of the energy (the strongest always), repeated roles left out."""
    full = lambda role, confidence, band: F.struct(role.alias("role"), domain_of(role).alias("domain"), confidence.alias("confidence"), certainty(confidence).alias("certainty"), band.alias("band"))

    def labels(x: Column) -> Column:
        def label(b: Column, i: Column) -> Column:
            share = b["energy"] / x["total"]
            voice = let(role_rules(b["name"], hour, duration, flatness, centroid, peak, x["n_bands"], share), lambda v: full(v["role"], F.round(v["confidence"] * (0.6 + 0.4 * share), 3), b["name"]))
            return F.when((i == 0) | (share >= 0.15), voice)

        return F.filter(F.transform(x["top"], label), lambda v: v.isNotNull())

    def first_of_role(heard: Column) -> Column:
        return F.filter(heard, lambda v, i: F.array_position(F.transform(heard, lambda w: w["role"]), v["role"]) == i + 1)

    def speak(x: Column) -> Column:
        nothing = F.array(full(F.lit("community_shift"), F.lit(0.2), F.lit("unknown")))
        changed = F.array(full(x["change"], F.lit(0.7), x["top"][0]["name"]))
        return F.when(~(x["total"] > 0), nothing).when(x["change"].isNotNull(), changed).otherwise(let(labels(x), first_of_role))

    return let(energies, lambda e: let(
        F.struct(
            F.aggregate(e, F.lit(0.0), lambda a, b: a + b["energy"]).alias("total"), F.size(F.filter(e, lambda b: b["energy"] > 0)).alias("n_bands"),
            F.slice(ranked_bands(e), 1, 3).alias("top"), transition(peak, before).alias("change"),
        ), speak))


def band_mix(energies: Column) -> Column:
    """array<struct(name, share)> of the bands with a tenth of the energy, strongest first."""
    total = F.aggregate(energies, F.lit(0.0), lambda a, e: a + e["energy"])
    total = F.when(total == 0, 1.0).otherwise(total)
    return F.transform(F.filter(ranked_bands(energies), lambda b: b["energy"] / total >= 0.10), lambda b: F.struct(b["name"].alias("name"), (b["energy"] / total).alias("share")))


def mix_label(mix: Column) -> Column:
    return F.array_join(F.transform(mix, lambda m: F.concat(F.replace(m["name"], F.lit("_"), F.lit(" ")), F.lit(" "), F.round(m["share"] * 100).cast("int").cast("string"), F.lit("%"))), "  ")


def mix_span(mix: Column, dominant: Column, lows: Column, highs: Column) -> tuple[Column, Column]:
    """Lowest and highest frequency of the bands in the mix (else of the dominant band); lows, highs: maps by band."""
    names = F.when(F.size(mix) > 0, F.transform(mix, lambda m: m["name"])).otherwise(F.array(dominant))
    ends = lambda table, pick: F.coalesce(pick(F.filter(F.transform(names, lambda n: F.element_at(table, n)), lambda v: v.isNotNull())), F.lit(0))
    return ends(lows, F.array_min), ends(highs, F.array_max)
