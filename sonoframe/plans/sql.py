"""DuckDB SQL that gives the rows of each query, written from the definitions and not from the Spark plans."""

from __future__ import annotations

_BANDS = "['geophony','biophony_low','biophony_mid','biophony_high','ultrasonic']"
_LO, _HI = "[0,2000,4000,8000,16000]", "[2000,4000,8000,16000,24000]"

AE = f"""
ae0 AS (SELECT event_id, ts, user_id AS site, CAST(ts AS DATE) AS day, event_type AS role, value AS peak_flux, coalesce(CAST(json_extract(props, '$.k') AS INTEGER), 0) AS k FROM events),
ae1 AS (SELECT *, CAST(site AS VARCHAR) || '/' || CAST(day AS VARCHAR) AS recording FROM ae0),
ae2 AS (SELECT *, min(ts) OVER (PARTITION BY recording) AS rec_start FROM ae1),
ae AS (SELECT *, (epoch_us(ts) - epoch_us(rec_start)) / CAST(1000000 AS DOUBLE) AS onset_s, CAST(hour(rec_start) AS INTEGER) AS rec_hour, CAST(minute(rec_start) AS INTEGER) AS rec_minute,
  CASE WHEN role IN ('click', 'view') THEN 'biophony' WHEN role = 'purchase' THEN 'geophony' WHEN role = 'error' THEN 'anthrophony' ELSE 'transition' END AS domain,
  ({_BANDS})[k % 5 + 1] AS dominant_band, (k % 100) / CAST(100 AS DOUBLE) AS confidence, k % 40 + CAST(0.5 AS DOUBLE) AS duration_s, (k % 50) / CAST(50 AS DOUBLE) / 2 AS flatness, CAST(200 + k * 37 % 9000 AS DOUBLE) AS centroid FROM ae2)
"""
DAILY = """
cnt AS (SELECT day, role, count(*) AS n, min(rec_start) AS fs, min_by(event_id, (rec_start, event_id)) AS fe FROM ae GROUP BY 1, 2),
top AS (SELECT day, role AS dominant_role FROM (SELECT *, row_number() OVER (PARTITION BY day ORDER BY n DESC, fs, fe) AS r FROM cnt) WHERE r = 1),
dy AS (SELECT day, count(DISTINCT recording) AS n_recordings, count(*) AS n_events, count(DISTINCT role) AS richness, count(*) FILTER (domain = 'biophony') AS n_biophony, count(*) FILTER (domain = 'geophony') AS n_geophony,
  count(*) FILTER (domain = 'anthrophony') AS n_anthrophony, count(*) FILTER (domain = 'transition') AS n_transition, CAST(dayofyear(day) AS INTEGER) AS day_of_year FROM ae GROUP BY day),
daily AS (SELECT dy.*, round(n_events / n_recordings, 3) AS events_per_recording, round(n_biophony / n_events, 4) AS biophony_share, round(n_geophony / n_events, 4) AS geophony_share,
  round(n_anthrophony / n_events, 4) AS anthrophony_share, round(n_transition / n_events, 4) AS transition_share, dominant_role FROM dy JOIN top USING (day))
"""
DAWN = """
dawn AS (SELECT day, round(min(rec_hour * 60 + rec_minute + onset_s / 60), 1) AS onset_minutes, CAST(dayofyear(day) AS INTEGER) AS day_of_year FROM ae
  WHERE domain = 'biophony' AND rec_hour + onset_s / 3600 BETWEEN 3 AND 8 GROUP BY day)
"""
DAWN_SHIFT = """
ds AS (SELECT 'dawn_chorus_advance_delay' AS type, day, day_of_year, round(s, 1) AS magnitude FROM (SELECT *, onset_minutes - lag(onset_minutes) OVER (ORDER BY day) AS s FROM dawn) WHERE abs(s) > 15)
"""
FRAMES = """
meas AS (SELECT day, round(avg((k % 11) / 11), 6) AS ndsi, round(avg((k % 7) / 7), 6) AS adi, round(avg((k % 13) / 13), 6) AS aci FROM ae GROUP BY day),
raw AS (SELECT d.*, events_per_recording AS activity, CAST(richness AS DOUBLE) AS rich, ndsi, adi, aci, onset_minutes AS dawn FROM daily d JOIN meas USING (day) LEFT JOIN (SELECT day, onset_minutes FROM dawn) USING (day)),
fr AS (SELECT *, """ + ", ".join(
    f"CASE WHEN {c} IS NOT NULL AND {hi} - {lo} > 0 THEN round(({c} - {lo}) / ({hi} - {lo}), 4) ELSE CAST(0 AS DOUBLE) END AS cv_{n}"
    for n, c, lo, hi in [
        *[(n, c, f"min({c}) OVER ()", f"max({c}) OVER ()") for n, c in (("activity", "activity"), ("richness", "rich"), ("adi", "adi"), ("aci", "aci"), ("dawn", "dawn"))],
        *[(n, f"{n}_share", "CAST(0 AS DOUBLE)", "CAST(1 AS DOUBLE)") for n in ("biophony", "geophony", "anthrophony")], ("ndsi", "ndsi", "CAST(-1 AS DOUBLE)", "CAST(1 AS DOUBLE)"),
    ]
) + " FROM raw)"
SHIFTS = """
sd AS (SELECT day, CAST(dayofyear(day) AS INTEGER) AS day_of_year, CAST(sum(CASE WHEN role = 'click' THEN k * 4 % 17 ELSE 0 END) AS DOUBLE) AS low, CAST(sum(CASE WHEN role = 'click' THEN k * 6 % 17 ELSE 0 END) AS DOUBLE) AS high,
  round(avg(k % 7), 6) AS adi, count(*) FILTER (domain = 'geophony') AS geo,
  list_distinct(list(CASE WHEN k % 23 = 0 THEN 'insect_chorus' WHEN k % 29 = 0 THEN 'amphibian_assembly' WHEN k % 31 = 0 THEN 'nocturnal_voice' END)) AS roles FROM ae GROUP BY day),
sp AS (SELECT *, lag(low) OVER w AS plow, lag(high) OVER w AS phigh, lag(adi) OVER w AS padi, lag(geo) OVER w AS pgeo, lag(roles) OVER w AS proles FROM sd WINDOW w AS (ORDER BY day)),
st AS (SELECT *, len(list_filter(roles, lambda x: NOT list_contains(proles, x))) + len(list_filter(proles, lambda x: NOT list_contains(roles, x))) AS turned FROM sp WHERE padi IS NOT NULL),
shift AS (
  SELECT 'breeding_chorus_onset' AS type, day, day_of_year, round(least(low / plow, high / phigh), 3) AS magnitude FROM st WHERE plow > 0 AND phigh > 0 AND low / plow > 1.2 AND high / phigh > 1.2
  UNION ALL SELECT 'migration_acoustic_shift', day, day_of_year, round(abs(adi - padi), 3) FROM st WHERE abs(adi - padi) > 0.5
  UNION ALL SELECT 'rain_season_transition', day, day_of_year, CAST(geo - pgeo AS DOUBLE) FROM st WHERE geo > pgeo + 3
  UNION ALL SELECT 'nocturnal_community_change', day, day_of_year, CAST(turned AS DOUBLE) FROM st WHERE turned > 0
  UNION ALL SELECT * FROM ds)
"""
DIEL = """
per AS (SELECT recording, rec_hour, count(*) AS n, count(*) FILTER (domain = 'biophony') AS b, count(*) FILTER (domain = 'geophony') AS g, count(*) FILTER (domain = 'anthrophony') AS a, count(*) FILTER (domain = 'transition') AS t FROM ae GROUP BY 1, 2),
hrs AS (SELECT rec_hour, avg(n) AS mean_events, max(n) AS max_events, count(*) AS n_recordings, sum(b) AS b, sum(g) AS g, sum(a) AS a, sum(t) AS t FROM per GROUP BY 1),
diel AS (SELECT CAST(hour AS INTEGER) AS hour, round(coalesce(mean_events, 0), 6) AS mean_events, coalesce(max_events, 0) AS max_events, coalesce(n_recordings, 0) AS n_recordings, CAST(coalesce(b, 0) AS BIGINT) AS n_biophony,
  CAST(coalesce(g, 0) AS BIGINT) AS n_geophony, CAST(coalesce(a, 0) AS BIGINT) AS n_anthrophony, CAST(coalesce(t, 0) AS BIGINT) AS n_transition FROM range(24) x(hour) LEFT JOIN hrs ON hour = rec_hour)
"""
BASE = """
v AS (SELECT event_id, user_id, value, epoch_us(ts) / CAST(1000000 AS DOUBLE) AS t FROM events),
bl AS (SELECT *, median(value) OVER w AS median, mad(value) OVER w AS mad FROM v WINDOW w AS (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN 19 PRECEDING AND CURRENT ROW))
"""
MAG = """
mag AS (SELECT label AS recording, vec_id AS frame, k - 1 AS k, abs(CAST(embedding[k] AS DOUBLE)) AS m, (k - 1) * CAST(24000 AS DOUBLE) / 63 AS f FROM embeddings, (SELECT unnest(range(1, 65)) AS k))
"""
ANN = """
det AS (SELECT recording AS file, event_id AS det, onset_s, onset_s + 1800 + 90 * k AS offset_s FROM ae WHERE role IN ('click', 'view')),
ref AS (SELECT recording AS file, event_id AS ref, onset_s AS r0, onset_s + 1800 + 60 * k AS r1, role AS label FROM ae WHERE role IN ('purchase', 'error'))
"""
EN = """
en AS (SELECT event_id, recording, o, (['geophony','biophony_low','biophony_mid','biophony_high','ultrasonic'])[o + 1] AS name, CAST(k * (o + 3) % 17 AS DOUBLE) AS energy FROM ae, (SELECT unnest(range(5)) AS o)),
tot AS (SELECT event_id, sum(energy) AS total, count(*) FILTER (energy > 0) AS nb FROM en GROUP BY 1),
rk AS (SELECT en.*, total, nb, row_number() OVER (PARTITION BY event_id ORDER BY energy DESC, o) AS i, CASE WHEN total > 0 THEN energy / total ELSE 0 END AS share FROM en JOIN tot USING (event_id)),
ctx0 AS (SELECT *, lag(peak_flux) OVER (PARTITION BY recording ORDER BY onset_s, event_id) AS before FROM ae),
ctx AS (SELECT *, CASE WHEN before IS NOT NULL THEN peak_flux / greatest(before, 1e-10) END AS ratio FROM ctx0)
"""
_RULES = """CASE
 WHEN name = 'geophony' AND flatness > 0.30 AND duration_s > 30 THEN {'r': 'rain_event', 'c': 0.75}
 WHEN name = 'geophony' AND flatness > 0.30 AND duration_s > 10 THEN {'r': 'wind_event', 'c': 0.65}
 WHEN name = 'geophony' AND flatness > 0.30 THEN {'r': 'water_flow', 'c': 0.5}
 WHEN name = 'geophony' AND flatness > 0.15 AND centroid < 1500 AND duration_s > 20 THEN {'r': 'mechanical_intrusion', 'c': 0.6}
 WHEN name = 'geophony' AND flatness > 0.15 AND centroid < 800 AND duration_s > 5 AND duration_s < 60 THEN {'r': 'aircraft_passage', 'c': 0.55}
 WHEN rec_hour BETWEEN 4 AND 7 AND name IN ('biophony_mid', 'biophony_low') THEN {'r': 'dawn_chorus_participant', 'c': 0.8}
 WHEN rec_hour BETWEEN 17 AND 19 AND name IN ('biophony_mid', 'biophony_low') THEN {'r': 'dusk_chorus_participant', 'c': 0.75}
 WHEN (rec_hour >= 20 OR rec_hour < 4) AND name = 'biophony_low' AND flatness < 0.15 THEN {'r': 'amphibian_assembly', 'c': 0.7}
 WHEN (rec_hour >= 20 OR rec_hour < 4) AND name IN ('biophony_high', 'ultrasonic') THEN {'r': 'nocturnal_voice', 'c': 0.65}
 WHEN (rec_hour >= 20 OR rec_hour < 4) AND name = 'biophony_mid' THEN {'r': 'nocturnal_voice', 'c': 0.6}
 WHEN name IN ('biophony_high', 'ultrasonic') AND duration_s > 10 THEN {'r': 'insect_chorus', 'c': 0.7}
 WHEN name = 'biophony_low' AND flatness < 0.15 AND duration_s > 5 THEN {'r': 'amphibian_assembly', 'c': 0.65}
 WHEN duration_s < 5 AND peak_flux > 0 AND name = 'biophony_mid' THEN {'r': 'alarm_or_alert', 'c': 0.5}
 WHEN name = 'biophony_mid' AND flatness < 0.20 AND duration_s > 2 AND duration_s < 30 THEN {'r': 'territorial_announcement', 'c': 0.55}
 WHEN nb >= 3 AND share < 0.4 THEN {'r': 'community_shift', 'c': 0.45}
 WHEN name IN ('biophony_mid', 'biophony_low') THEN {'r': 'territorial_announcement', 'c': 0.3}
 WHEN name IN ('biophony_high', 'ultrasonic') THEN {'r': 'insect_chorus', 'c': 0.3}
 ELSE {'r': 'community_shift', 'c': 0.2} END"""
_DOMAIN = """CASE WHEN {0} IN ('rain_event','wind_event','water_flow') THEN 'geophony' WHEN {0} IN ('mechanical_intrusion','aircraft_passage') THEN 'anthrophony'
 WHEN {0} IN ('silence_to_activity','activity_to_silence','community_shift') THEN 'transition' ELSE 'biophony' END"""
_CERTAINTY = "CASE WHEN {0} >= 0.6 THEN 'probable' WHEN {0} > 0.35 THEN 'candidate' ELSE 'unclassified' END"
_ACCENT = "trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(lower(strip_accents({0})), '[/\\-_]+', ' ', 'g'), '[^a-z0-9 ]+', ' ', 'g'), '\\b(y o|yo)\\b', ' ', 'g'), '(\\w+)s\\b', '\\1', 'g'), ' +', ' ', 'g'))"


#: messages of an event in their order; onsets are rounded in whole microseconds, half up
_MESSAGES = (
    ("/parliament/event", "'1'"), ("/parliament/event/onset", "printf('%d.%04d', (us + 50) // 1000000, (us + 50) % 1000000 // 100)"), ("/parliament/event/duration", "printf('%.4f', duration_s)"),
    ("/parliament/event/role", "role"), ("/parliament/event/domain", "domain"), ("/parliament/event/band", "dominant_band"),
    ("/parliament/event/centroid", "printf('%.4f', centroid)"), ("/parliament/event/voct", "printf('%.4f', CASE WHEN centroid > 0 THEN log2(centroid / CAST(261.63 AS DOUBLE)) ELSE -5 END)"),
    ("/parliament/event/flatness", "printf('%.4f', flatness)"), ("/parliament/event/flux", "printf('%.4f', peak_flux)"), ("/parliament/event/confidence", "printf('%.4f', confidence)"),
    *[(f"/parliament/event/{i}", "'0.0000'") for i in ("aci", "ndsi", "bio", "adi")],
    ("/parliament/habitat", "'unknown'"), ("/parliament/season", "'unknown'"), ("/parliament/temperature", "'0.0000'"),
    ("/parliament/hour", "CAST(rec_hour AS VARCHAR)"), ("/parliament/democracy_index", "'0.0000'"),
    ("/ilda/color", "CAST(k % 5 + 1 AS VARCHAR)"), ("/ilda/intensity", "printf('%.4f', confidence)"),
    ("/ilda/angle", "printf('%.4f', least(centroid / 10000, 1))"), ("/ilda/speed", "printf('%.4f', least(peak_flux / 100, 1))"),
)


def _with(*parts: str) -> str:
    return "WITH " + ",".join(parts) + " "


_MERGED = """
o1 AS (SELECT user_id, t, value, coalesce(CAST(t - lag(t) OVER (PARTITION BY user_id ORDER BY t) > 7200 AS INTEGER), 1) AS new FROM v),
o2 AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY t ROWS UNBOUNDED PRECEDING) AS g FROM o1),
m AS (SELECT user_id, g, count(*) AS n_regions, min(t) AS a, max(t) AS b, max(value) AS peak, list_reduce(list(value ORDER BY t), lambda x, y: (x + y) / 2) AS mean FROM o2 GROUP BY 1, 2)
"""

SQL: dict[str, str] = {
    "q01_daily_calendar": _with(AE, DAILY) + "SELECT * FROM daily",
    "q02_cv_frames": _with(AE, DAILY, DAWN, FRAMES) + "SELECT day, dawn, cv_activity, cv_richness, cv_biophony, cv_geophony, cv_anthrophony, cv_ndsi, cv_adi, cv_aci, cv_dawn FROM fr",
    "q03_diel_pattern": _with(AE, DIEL) + "SELECT * FROM diel",
    "q04_diel_table": _with(AE, DIEL) + "SELECT hour, CASE WHEN max(mean_events) OVER () > 0 THEN round(mean_events / max(mean_events) OVER (), 4) ELSE 0 END AS level, hour = first_value(hour) OVER (ORDER BY mean_events DESC, hour) AS is_peak FROM diel",
    "q05_dawn_onset": _with(AE, DAWN) + "SELECT * FROM dawn",
    "q06_dawn_shift": _with(AE, DAWN, DAWN_SHIFT) + "SELECT * FROM ds",
    "q07_phenology_shifts": _with(AE, DAWN, DAWN_SHIFT, SHIFTS) + "SELECT * FROM shift",
    "q08_parliament_by_recording": _with(AE) + """, h AS (SELECT recording, round(abs(entropy(role)), 3) AS democracy_index, round(abs(entropy(dominant_band)), 3) AS niche_partitioning FROM ae GROUP BY 1)
        SELECT recording, count(*) AS total_voices, round(100 * count(*) FILTER (domain = 'biophony') / count(*), 6) AS pct_biophony, round(100 * count(*) FILTER (domain = 'geophony') / count(*), 6) AS pct_geophony,
          round(100 * count(*) FILTER (domain = 'anthrophony') / count(*), 6) AS pct_anthrophony, round(100 * count(*) FILTER (domain = 'transition') / count(*), 6) AS pct_transition, count(DISTINCT role) AS n_roles,
          any_value(democracy_index) AS democracy_index, any_value(niche_partitioning) AS niche_partitioning FROM ae JOIN h USING (recording) GROUP BY recording""",
    "q09_parliament_rollup": _with(AE) + "SELECT site, role, count(*) AS voices FROM ae GROUP BY GROUPING SETS ((site, role), (role))",
    "q10_running_median_mad": _with(BASE) + "SELECT event_id, round(median, 6) AS median, round(mad, 6) AS mad FROM bl",
    "q11_flux_threshold_islands": _with(BASE) + """, n AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS i FROM bl),
        up AS (SELECT *, i - row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS g FROM n WHERE value > median + 0.5 * 1.4826 * mad)
        SELECT user_id, round(min(t), 6) AS onset_s, round(max(t), 6) AS offset_s, round(max(value), 4) AS peak_flux, round(avg(value), 8) AS mean_flux, CAST(min(i) AS INTEGER) AS onset_frame, CAST(max(i) AS INTEGER) AS offset_frame FROM up GROUP BY user_id, g""",
    "q12_gap_merge_events": _with(BASE, _MERGED) + """SELECT user_id, n_regions, round(a, 6) AS onset_s, round(b, 6) AS offset_s, round(peak, 4) AS peak_flux, round(mean, 10) AS mean_flux, round(greatest(0, a - 20), 6) AS clip_start_s,
        round(CASE WHEN least(1.8e9, b + 10) - greatest(0, a - 20) > 300 THEN greatest(0, a - 20) + 300 ELSE least(1.8e9, b + 10) END, 6) AS clip_end_s FROM m WHERE b - a >= 2""",
    "q13_thinned_clips": "WITH RECURSIVE " + AE + """, s AS (SELECT recording, event_id, onset_s, row_number() OVER (PARTITION BY recording ORDER BY onset_s, event_id) AS i FROM ae),
        f AS (SELECT recording, event_id, onset_s, i, onset_s AS last, TRUE AS keep FROM s WHERE i = 1
          UNION ALL SELECT s.recording, s.event_id, s.onset_s, s.i, CASE WHEN s.onset_s - f.last >= 3600 THEN s.onset_s ELSE f.last END, s.onset_s - f.last >= 3600 FROM f JOIN s ON s.recording = f.recording AND s.i = f.i + 1)
        SELECT recording, event_id, round(greatest(0, least(onset_s - 30, 86340)), 6) AS clip_start_s, round(least(86400, greatest(0, least(onset_s - 30, 86340)) + 60), 6) AS clip_end_s FROM f WHERE keep""",
    "q14_event_selection": _with(AE) + """SELECT event_id, role, domain, confidence, replace(recording, '/', '_') AS folder, 'clips/' || domain || '/' || role || '/event_' || CASE WHEN event_id < 1000 THEN lpad(CAST(event_id AS VARCHAR), 3, '0') ELSE CAST(event_id AS VARCHAR) END || '_' || role || '_' || printf('%.1fs-%.1fs', onset_s, onset_s + duration_s) || '.wav' AS clip
        FROM ae WHERE role IN ('click', 'purchase') AND domain IN ('biophony', 'geophony') AND confidence >= 0.5""",
    "q15_role_rules": _with(AE, EN) + f""", x AS (SELECT c.event_id, CASE WHEN ratio > 5 THEN {{'r': 'silence_to_activity', 'c': 0.7}} WHEN ratio < 0.2 THEN {{'r': 'activity_to_silence', 'c': 0.7}} ELSE {_RULES} END AS v FROM ctx c JOIN rk ON rk.event_id = c.event_id AND i = 1)
        SELECT event_id, v.r AS role, {_DOMAIN.format('v.r')} AS domain, CAST(v.c AS DOUBLE) AS confidence, {_CERTAINTY.format('v.c')} AS certainty FROM x""",
    "q16_multilabel_voices": _with(AE, EN) + f""", x AS (SELECT c.event_id, i, name, share, total, ratio, {_RULES} AS v FROM ctx c JOIN rk ON rk.event_id = c.event_id AND i <= 3),
        lab AS (
          SELECT event_id, 1 AS i, 'community_shift' AS role, CAST(0.2 AS DOUBLE) AS confidence, 'unknown' AS band FROM x WHERE i = 1 AND NOT total > 0
          UNION ALL SELECT event_id, 1, CASE WHEN ratio > 5 THEN 'silence_to_activity' ELSE 'activity_to_silence' END, CAST(0.7 AS DOUBLE), name FROM x WHERE i = 1 AND total > 0 AND (ratio > 5 OR ratio < 0.2)
          UNION ALL SELECT event_id, i, v.r, round(v.c * (CAST(0.6 AS DOUBLE) + CAST(0.4 AS DOUBLE) * share), 3), name FROM x WHERE total > 0 AND (ratio IS NULL OR NOT (ratio > 5 OR ratio < 0.2)) AND (i = 1 OR share >= 0.15)),
        fst AS (SELECT *, row_number() OVER (PARTITION BY event_id, role ORDER BY i) AS d FROM lab),
        ok AS (SELECT event_id, role, confidence, band, {_DOMAIN.format('role')} AS domain, CAST(row_number() OVER (PARTITION BY event_id ORDER BY i) - 1 AS INTEGER) AS voice FROM fst WHERE d = 1)
        SELECT event_id, array_to_string(list_sort(list_distinct(list(domain) OVER (PARTITION BY event_id))), ',') AS domains, voice, role, domain, confidence, {_CERTAINTY.format('confidence')} AS certainty, band FROM ok""",
    "q17_band_mix": _with(AE, EN) + f""", mx AS (SELECT event_id, i, o, name, share FROM rk WHERE share >= 0.10),
        ag AS (SELECT event_id, count(*) AS n, min(({_LO})[o + 1]) AS lo, max(({_HI})[o + 1]) AS hi, string_agg(name, ',' ORDER BY i) AS bands, round(sum(share), 4) AS covered FROM mx GROUP BY 1)
        SELECT event_id, CAST(coalesce(n, 0) AS INTEGER) AS n_bands, coalesce(lo, ({_LO})[k % 5 + 1]) AS band_lo_hz, coalesce(hi, ({_HI})[k % 5 + 1]) AS band_hi_hz, coalesce(bands, '') AS bands, coalesce(covered, 0) AS covered FROM ae LEFT JOIN ag USING (event_id)""",
    "q18_spectral_flux": _with(MAG) + ", d AS (SELECT recording, frame, greatest(m - lag(m) OVER (PARTITION BY recording, k ORDER BY frame), 0) AS r FROM mag) SELECT recording, frame, round(sqrt(sum(coalesce(r, 0) * coalesce(r, 0))), 6) AS flux FROM d GROUP BY 1, 2",
    "q19_centroid_flatness": _with(MAG) + "SELECT recording, frame, round(sum(m * f) / CASE WHEN sum(m) = 0 THEN 1 ELSE sum(m) END, 4) AS centroid, round(exp(avg(ln(greatest(m * m, 1e-20)))) / avg(greatest(m * m, 1e-20)), 6) AS flatness FROM mag GROUP BY 1, 2",
    "q20_band_energies": _with(MAG) + "SELECT recording, frame, " + ", ".join(f"round(coalesce(sum(m * m) FILTER (f >= {lo} AND f < {hi}), 0), 6) AS {n}" for n, lo, hi in (("geophony", 0, 2000), ("biophony_low", 2000, 4000), ("biophony_mid", 4000, 8000), ("biophony_high", 8000, 16000), ("ultrasonic", 16000, 24000))) + " FROM mag GROUP BY 1, 2",
    "q21_band_shape": _with(MAG) + """, s AS (SELECT recording, k, f, avg(m) AS m, avg(m * m) AS p, sum(m) AS w FROM mag WHERE f >= 2000 AND f < 8000 GROUP BY 1, 2, 3), q AS (SELECT *, p / sum(p) OVER (PARTITION BY recording) AS q FROM s)
        SELECT recording, round(max(m) / avg(m), 3) AS band_crest, round(-sum(q * ln(q)) / ln(count(*)), 4) AS band_entropy, round(sum(w * f) / sum(w), 1) AS band_centroid FROM q GROUP BY 1""",
    "q22_indices": _with(MAG) + """, n AS (SELECT *, lead(m) OVER (PARTITION BY recording, k ORDER BY frame) AS nx FROM mag),
        b AS (SELECT recording, k, f, sum(abs(nx - m)) AS d, sum(m) FILTER (nx IS NOT NULL) AS s, avg(m) AS a, avg(m * m) AS p FROM n GROUP BY 1, 2, 3),
        one AS (SELECT recording, round(sum(d / CASE WHEN s = 0 THEN 1 ELSE s END), 4) AS aci, round(sum(20 * log10(greatest(a, 1e-10))) FILTER (f BETWEEN 2000 AND 8000) - count(*) FILTER (f BETWEEN 2000 AND 8000) * min(20 * log10(greatest(a, 1e-10))) FILTER (f BETWEEN 2000 AND 8000), 4) AS bio,
          round((sum(p) FILTER (f >= 2000 AND f < 8000) - sum(p) FILTER (f >= 1000 AND f < 2000)) / (sum(p) FILTER (f >= 2000 AND f < 8000) + sum(p) FILTER (f >= 1000 AND f < 2000)), 4) AS ndsi FROM b GROUP BY 1),
        c AS (SELECT recording, frame, floor(f / 1000) AS band, CAST(10 * log10(greatest(avg(m * m), 1e-20)) > -30 AS INTEGER) AS up FROM mag WHERE f < 10000 GROUP BY 1, 2, 3),
        a AS (SELECT recording, band, avg(up) AS a FROM c GROUP BY 1, 2), r AS (SELECT *, a / sum(a) OVER (PARTITION BY recording) AS p, row_number() OVER (PARTITION BY recording ORDER BY a, band) AS i FROM a)
        SELECT recording, any_value(aci) AS aci, any_value(bio) AS bio, any_value(ndsi) AS ndsi, round(abs(sum(CASE WHEN p > 0 THEN -p * ln(p) ELSE 0 END)), 4) AS adi, round(sum((2 * i - 11) * a) / (10 * sum(a)), 4) AS aei FROM r JOIN one USING (recording) GROUP BY recording""",
    "q23_cover_normalise": "SELECT page_id, " + _ACCENT.format("regexp_extract(html, '<title>(.*?)</title>', 1)") + " AS cover_key FROM pages",
    "q24_nearest_station": """WITH s AS (SELECT s_nationkey AS cover_key, s_suppkey AS station_id, (SELECT min(l_shipdate) FROM lineitem WHERE l_suppkey = s_suppkey) AS sampled FROM supplier),
        o AS (SELECT o_orderkey AS recording, nullif(c_nationkey, 7) AS cover_key, CASE WHEN o_orderkey % 11 <> 0 THEN o_orderdate END AS made FROM orders JOIN customer ON o_custkey = c_custkey)
        SELECT recording, cover_key, station_id FROM (SELECT o.recording, o.cover_key, station_id, row_number() OVER (PARTITION BY recording ORDER BY abs(epoch_us(sampled) - epoch_us(made)) NULLS LAST, station_id NULLS LAST) AS r FROM o LEFT JOIN s USING (cover_key)) WHERE r = 1""",
    "q25_onset_band_join": _with(AE, ANN) + "SELECT file, det, ref, round(abs(onset_s - r0), 6) AS distance FROM det JOIN ref USING (file) WHERE abs(onset_s - r0) <= 3600",
    "q26_interval_overlap": _with(AE, ANN) + ", p AS (SELECT file, det, ref, greatest(0, least(offset_s, r1) - greatest(onset_s, r0)) AS i, offset_s - onset_s + r1 - r0 AS u FROM det JOIN ref USING (file)) SELECT file, det, ref, round(i / (u - i), 6) AS iou FROM p WHERE i / (u - i) >= 0.2",
    "q27_onset_match_scores": "WITH RECURSIVE " + AE + "," + ANN + """, p AS (SELECT file, det, ref, row_number() OVER (PARTITION BY file ORDER BY abs(onset_s - r0), det, ref) AS i FROM det JOIN ref USING (file) WHERE abs(onset_s - r0) <= 3600),
        w AS (SELECT file, CAST(0 AS BIGINT) AS i, CAST([] AS BIGINT[]) AS d, CAST([] AS BIGINT[]) AS r FROM (SELECT DISTINCT file FROM p)
          UNION ALL SELECT w.file, p.i, CASE WHEN list_contains(d, det) OR list_contains(r, ref) THEN d ELSE list_append(d, det) END, CASE WHEN list_contains(d, det) OR list_contains(r, ref) THEN r ELSE list_append(r, ref) END FROM w JOIN p ON p.file = w.file AND p.i = w.i + 1),
        tp AS (SELECT file, len(arg_max(d, i)) AS tp FROM w GROUP BY 1), nd AS (SELECT file, count(*) AS d FROM det GROUP BY 1), nr AS (SELECT file, count(*) AS r FROM ref GROUP BY 1)
        SELECT coalesce(nd.file, nr.file) AS file, CAST(coalesce(tp, 0) AS BIGINT) AS tp, CAST(coalesce(d, 0) - coalesce(tp, 0) AS BIGINT) AS fp, CAST(coalesce(r, 0) - coalesce(tp, 0) AS BIGINT) AS fn FROM nd FULL JOIN nr ON nd.file = nr.file LEFT JOIN tp ON tp.file = coalesce(nd.file, nr.file)""",
    "q28_time_level": _with(AE, ANN) + """, d AS (SELECT DISTINCT file, unnest(range(CAST(floor(onset_s) AS BIGINT), CAST(floor(least(offset_s, 86400)) AS BIGINT))) AS x FROM det), r AS (SELECT DISTINCT file, unnest(range(CAST(floor(r0) AS BIGINT), CAST(floor(least(r1, 86400)) AS BIGINT))) AS x FROM ref),
        b AS (SELECT coalesce(d.file, r.file) AS file, count(*) FILTER (d.x IS NOT NULL AND r.x IS NOT NULL) AS both_, count(d.x) AS n_det, count(r.x) AS n_ref FROM d FULL JOIN r ON d.file = r.file AND d.x = r.x GROUP BY 1)
        SELECT file, round(both_ / greatest(n_det, 1), 4) AS precision, round(both_ / greatest(n_ref, 1), 4) AS recall, n_det, n_ref FROM b""",
    "q29_config_grid": _with(AE, ANN) + """, g AS (SELECT CAST(i * 5 + j AS INTEGER) AS config, ([1.5, 2.5, 3, 4, 6, 8])[i + 1] AS f, ([2, 1, 0.5, 0.3, 0.25])[j + 1] AS d FROM range(6) a(i), range(5) b(j)),
        hit AS (SELECT DISTINCT file, det FROM det JOIN ref USING (file) WHERE abs(onset_s - r0) <= 1800),
        c AS (SELECT config, count(*) AS n, count(h.det) AS tp FROM det JOIN g ON offset_s - onset_s >= 1800 * CAST(f AS DOUBLE) * CAST(g.d AS DOUBLE) / 4 LEFT JOIN hit h ON h.file = det.file AND h.det = det.det GROUP BY 1),
        s AS (SELECT config, tp, n - tp AS fp, greatest(0, (SELECT count(*) FROM ref) - tp) AS fn, coalesce(tp / n, 0) AS p, coalesce(tp / (tp + greatest(0, (SELECT count(*) FROM ref) - tp)), 0) AS r FROM c)
        SELECT config, tp, fp, fn, round(p, 4) AS precision, round(r, 4) AS recall, round(coalesce(2 * p * r / nullif(p + r, 0), 0), 4) AS f1 FROM s ORDER BY f1 DESC, config LIMIT 12""",
    "q30_osc_timeline": _with(AE, DAILY, DAWN, DAWN_SHIFT, FRAMES, SHIFTS) + """, p AS (SELECT *, row_number() OVER (ORDER BY day) - 1 AS i FROM fr), s AS (SELECT day, i / CAST(2 AS DOUBLE) AS slot FROM p), c AS (SELECT shift.*, slot + 0.001 AS slot FROM shift JOIN s USING (day))
        SELECT round(slot, 4) AS "at", addr, args FROM (
          SELECT i / CAST(2 AS DOUBLE) AS slot, '/phenology/day' AS addr, i || '|' || day || '|' || day_of_year AS args FROM p
          UNION ALL SELECT i / CAST(2 AS DOUBLE), '/phenology/day/recordings', CAST(n_recordings AS VARCHAR) FROM p UNION ALL SELECT i / CAST(2 AS DOUBLE), '/phenology/day/events', CAST(n_events AS VARCHAR) FROM p
          """ + " ".join(f"UNION ALL SELECT i / CAST(2 AS DOUBLE), '/phenology/day/{n}', printf('%.4f|%.4f', CAST(coalesce({c}, 0) AS DOUBLE), cv_{n}) FROM p" for n, c in (("activity", "activity"), ("richness", "rich"), ("biophony", "biophony_share"), ("geophony", "geophony_share"), ("anthrophony", "anthrophony_share"), ("ndsi", "ndsi"), ("adi", "adi"), ("aci", "aci"), ("dawn", "dawn"))) + """
          UNION ALL SELECT i / CAST(2 AS DOUBLE), '/phenology/day/dominant_role', dominant_role FROM p
          UNION ALL SELECT slot, '/phenology/event', type || '|' || day || '|' || day_of_year || '|' || printf('%.3f', magnitude) FROM c UNION ALL SELECT slot, '/phenology/event/type', type FROM c UNION ALL SELECT slot, '/phenology/event/day_of_year', CAST(day_of_year AS VARCHAR) FROM c
          UNION ALL SELECT count(*) / CAST(2 AS DOUBLE), '/phenology/end', '1' FROM p HAVING count(*) > 0)""",
    "q31_metadata_summary": "SELECT lang, count(*) AS n, count(*) FILTER (n_chars < 50) AS n_errors, CAST(sum(n_chars) AS BIGINT) AS total, count(DISTINCT source) AS n_places FROM documents GROUP BY lang",
    "q32_recordings_per_hour": _with(AE) + ", r AS (SELECT rec_hour, count(DISTINCT recording) AS n FROM ae GROUP BY 1) SELECT CAST(hour AS INTEGER) AS hour, coalesce(n, 0) AS n FROM range(24) x(hour) LEFT JOIN r ON hour = rec_hour",
    "q33_temp_by_location": """SELECT s_nationkey, round(quantile_cont(s_acctbal, 0.25), 4) AS q1, round(quantile_cont(s_acctbal, 0.5), 4) AS median, round(quantile_cont(s_acctbal, 0.75), 4) AS q3, round(avg(s_acctbal), 4) AS mean, round(coalesce(stddev_samp(s_acctbal), 0), 4) AS sd, count(*) AS n
        FROM supplier WHERE s_acctbal <> 0 GROUP BY 1""",
    "q34_kml_extract": """WITH l AS (SELECT page_id, unnest(regexp_extract_all(html, '<a href="([^"]*)">', 1)) AS href FROM pages) SELECT page_id, count(*) AS n_links, count(DISTINCT href) AS n_distinct, min(href) AS first_href FROM l GROUP BY 1""",
    "q35_reels": _with(AE) + ", r AS (SELECT role, event_id, CAST(row_number() OVER (PARTITION BY role ORDER BY event_id) AS INTEGER) AS clip_no, count(*) OVER (PARTITION BY role) AS n_clips FROM ae) SELECT * FROM r WHERE n_clips >= 2 AND clip_no <= 24",
    "q36_event_messages": _with(AE) + ", t AS (SELECT *, epoch_us(ts) - epoch_us(rec_start) AS us FROM ae)" + " UNION ALL ".join(f"SELECT event_id, {i} AS seq, '{a}' AS addr, {x} AS args FROM t" for i, (a, x) in enumerate(_MESSAGES)),
    "q37_hourly_heatmap": _with(AE) + """, h AS (SELECT day, CAST(floor(rec_hour + (rec_minute * 60 + onset_s) / 3600) AS BIGINT) % 24 AS hour, count(*) AS n FROM ae GROUP BY 1, 2)
        SELECT d.day, CAST(g.hour AS INTEGER) AS hour, coalesce(n, 0) AS n_events FROM (SELECT DISTINCT day FROM ae) d CROSS JOIN range(24) g(hour) LEFT JOIN h ON h.day = d.day AND h.hour = g.hour""",
    "q38_band_means": _with(AE, EN) + "SELECT recording, " + ", ".join(f"round(avg(energy) FILTER (name = '{n}'), 4) AS {n}" for n in ("geophony", "biophony_low", "biophony_mid", "biophony_high", "ultrasonic")) + " FROM en GROUP BY 1",
    "q39_first_label": _with(AE, ANN) + "SELECT file, det, label FROM (SELECT file, det, label, row_number() OVER (PARTITION BY file, det ORDER BY r0, ref) AS i FROM det JOIN ref USING (file) WHERE abs(onset_s - r0) <= 3600) WHERE i = 1",
    "q40_reference_lengths": _with(AE, ANN) + "SELECT label, count(*) AS n, round(median(r1 - r0), 4) AS median_s, round(avg(CAST(r1 - r0 < 3600 AS INTEGER)), 6) AS short_fraction FROM ref GROUP BY 1",
    "q41_top_bands_of_site": _with(AE) + ", n AS (SELECT site, dominant_band, count(*) AS n, round(sum(peak_flux), 4) AS flux FROM ae GROUP BY 1, 2) SELECT * FROM (SELECT *, CAST(row_number() OVER (PARTITION BY site ORDER BY n DESC, dominant_band) AS INTEGER) AS rank FROM n) WHERE rank <= 3",
    "q42_all_event_messages": _with(AE) + ", t AS (SELECT *, epoch_us(ts) - epoch_us(rec_start) AS us FROM ae)" + " UNION ALL ".join(f"SELECT event_id, onset_s AS \"at\", {i} AS seq, '{a}' AS addr, {x} AS args FROM t" for i, (a, x) in enumerate(_MESSAGES)),
}
