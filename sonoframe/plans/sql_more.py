"""DuckDB SQL of the queries from q43 on, written from the definitions and not from the Spark plans."""

from __future__ import annotations

from sonoframe.plans.sql import _MESSAGES, AE, ANN, DAILY, DAWN, DIEL, FRAMES, MAG, _with

REC = "rec AS (SELECT recording, min(day) AS day, min(rec_hour) AS rec_hour FROM ae GROUP BY 1)"
ALL_HEARD = "he AS (SELECT * FROM ae)"
HE = "he AS (SELECT * FROM ae WHERE role IN ('click', 'purchase') AND k % 3 = 0 AND day(day) % 7 <> 3)"
_DOMAINS = ("biophony", "geophony", "anthrophony", "transition")
_COUNTED = ", ".join(f"count(*) FILTER (domain = '{d}') AS n_{d}" for d in _DOMAINS)
_COLOUR = "CASE domain WHEN 'biophony' THEN '#27ae60' WHEN 'geophony' THEN '#3498db' WHEN 'anthrophony' THEN '#e74c3c' WHEN 'transition' THEN '#f39c12' ELSE '#95a5a6' END"

# header comments are told from k, so their fields are too
COM = """
com AS (SELECT event_id, k, ts, k % 4 <> 3 AS has,
  CASE WHEN k % 4 <> 3 THEN lpad(upper(printf('%x', event_id * 7919)), 16, '0') END AS audiomoth_id,
  CASE WHEN k % 4 <> 3 THEN date_trunc('second', ts) END AS header_at,
  CASE k % 4 WHEN 0 THEN 'UTC' WHEN 1 THEN 'UTC-5' WHEN 2 THEN 'UTC+5:30' END AS timezone,
  CASE k % 4 WHEN 0 THEN CAST(k % 5 AS VARCHAR) WHEN 1 THEN 'medium-high' WHEN 2 THEN 'low' END AS gain,
  CASE k % 4 WHEN 0 THEN (30 + k % 15) / CAST(10 AS DOUBLE) WHEN 1 THEN CAST(2.5 AS DOUBLE) WHEN 2 THEN CAST(4.9 AS DOUBLE) END AS battery_v,
  CASE k % 4 WHEN 1 THEN CAST(-3.5 AS DOUBLE) WHEN 2 THEN (100 + k * 7 % 300) / CAST(10 AS DOUBLE) END AS temperature_c FROM ae)
"""

SQL_MORE: dict[str, str] = {
    "q43_calendar_of_recordings": _with(AE, REC, HE) + f""", cnt AS (SELECT day, role, count(*) AS n, min((rec_start, event_id)) AS f FROM he GROUP BY 1, 2),
        top AS (SELECT day, role FROM (SELECT *, row_number() OVER (PARTITION BY day ORDER BY n DESC, f) AS r FROM cnt) WHERE r = 1),
        d AS (SELECT day, count(DISTINCT recording) AS n_recordings FROM rec GROUP BY 1), h AS (SELECT day, count(*) AS n_events, count(DISTINCT role) AS richness, {_COUNTED} FROM he GROUP BY 1)
        SELECT d.day, n_recordings, coalesce(n_events, 0) AS n_events, coalesce(richness, 0) AS richness, {", ".join(f"coalesce(n_{x}, 0) AS n_{x}, round(n_{x} / n_events, 4) AS {x}_share" for x in _DOMAINS)},
          CAST(dayofyear(d.day) AS INTEGER) AS day_of_year, round(coalesce(n_events, 0) / n_recordings, 3) AS events_per_recording, coalesce(role, 'silence') AS dominant_role FROM d LEFT JOIN h ON h.day = d.day LEFT JOIN top ON top.day = d.day""",
    "q44_diel_of_recordings": _with(AE, REC, HE) + f""", n AS (SELECT recording, count(*) AS n, {_COUNTED} FROM he GROUP BY 1),
        h AS (SELECT rec_hour, avg(coalesce(n, 0)) AS m, max(coalesce(n, 0)) AS x, count(*) AS r, {", ".join(f"sum(coalesce(n_{d}, 0)) AS n_{d}" for d in _DOMAINS)} FROM rec LEFT JOIN n ON n.recording = rec.recording GROUP BY 1)
        SELECT CAST(hour AS INTEGER) AS hour, round(coalesce(m, 0), 6) AS mean_events, coalesce(x, 0) AS max_events, coalesce(r, 0) AS n_recordings, {", ".join(f"CAST(coalesce(n_{d}, 0) AS BIGINT) AS n_{d}" for d in _DOMAINS)} FROM range(24) g(hour) LEFT JOIN h ON hour = rec_hour""",
    "q45_kernel_indices": "WITH mag AS (SELECT label AS recording, vec_id AS frame, k - 1 AS k, abs(CAST(embedding[k] AS DOUBLE)) / 10 AS m, (k - 1) * CAST(24000 AS DOUBLE) / 63 AS f FROM embeddings, (SELECT unnest(range(1, 65)) AS k))" + """,
        n AS (SELECT *, lead(m) OVER (PARTITION BY recording, k ORDER BY frame) AS nx FROM mag),
        b AS (SELECT recording, k, f, sum(abs(nx - m)) AS d, sum(m) FILTER (nx IS NOT NULL) AS s, 20 * log10(greatest(avg(m), 1e-10)) AS l, avg(m * m) AS p FROM n GROUP BY 1, 2, 3),
        one AS (SELECT recording, round(sum(d / CASE WHEN s = 0 THEN 1 ELSE s END), 4) AS aci, round(sum(l) FILTER (f BETWEEN 2000 AND 8000) - count(*) FILTER (f BETWEEN 2000 AND 8000) * min(l) FILTER (f BETWEEN 2000 AND 8000), 4) AS bio,
          sum(p) FILTER (f >= 2000 AND f < 8000) AS hi, sum(p) FILTER (f >= 1000 AND f < 2000) AS lo FROM b GROUP BY 1),
        c AS (SELECT recording, frame, floor(f / 1000) AS band, CAST(10 * log10(greatest(avg(m * m), 1e-20)) > -50 AS INTEGER) AS up FROM mag WHERE f < 10000 GROUP BY 1, 2, 3),
        a AS (SELECT recording, band, avg(up) AS a FROM c GROUP BY 1, 2), r AS (SELECT *, a / sum(a) OVER (PARTITION BY recording) AS p, row_number() OVER (PARTITION BY recording ORDER BY a, band) AS i FROM a)
        SELECT recording, any_value(aci) AS aci, any_value(bio) AS bio, round((any_value(hi) - any_value(lo)) / (any_value(hi) + any_value(lo)), 4) AS ndsi, round(abs(sum(CASE WHEN p > 0 THEN -p * ln(p) ELSE 0 END)), 4) AS adi, round(sum((2 * i - 11) * a) / (10 * sum(a)), 4) AS aei FROM r JOIN one USING (recording) GROUP BY recording""",
    "q46_hourly_of_recordings": _with(AE, REC, HE) + """, n AS (SELECT day, rec_hour, count(*) AS n FROM he GROUP BY 1, 2)
        SELECT d.day, CAST(hour AS INTEGER) AS hour, coalesce(n, 0) AS n_events FROM (SELECT DISTINCT day FROM rec) d CROSS JOIN range(24) g(hour) LEFT JOIN n ON n.day = d.day AND n.rec_hour = hour""",
    "q47_recorder_comments": _with(AE, COM) + "SELECT event_id, audiomoth_id, header_at, timezone, gain, battery_v, temperature_c, CASE WHEN temperature_c < 20 THEN 'cold' WHEN temperature_c < 30 THEN 'mild' ELSE 'hot' END AS temperature_class FROM com",
    "q48_metadata_rows": _with(AE, COM) + """, p AS (SELECT *, CASE k % 3 WHEN 0 THEN 'Época lluvias' WHEN 1 THEN 'Época seca' END AS season, CASE WHEN k % 2 = 0 THEN 'Pastos limpios' ELSE 'Sitio sin nombre' END AS cover, CASE WHEN k % 5 = 0 THEN 'Luna Captiva' END AS site,
          CASE WHEN k % 7 <> 0 THEN ([8000, 48000, 96000, 192000, 384000])[k % 5 + 1] ELSE 0 END AS rate, strftime(ts, '%Y%m%d_%H%M%S') || '.WAV' AS name,
          CASE k % 3 WHEN 0 THEN '%C3%89poca%20lluvias' WHEN 1 THEN 'Epoca%20seca' ELSE 'otra' END AS folder FROM com)
        SELECT cover || CASE WHEN season IS NULL THEN '' ELSE ' (' || season || ')' END || CASE WHEN site IS NULL THEN '' ELSE ' - ' || site END AS location,
          CASE WHEN rate >= 384000 THEN 'Ultra Alta' WHEN rate >= 192000 THEN 'Muy Alta' WHEN rate >= 96000 THEN 'Alta' WHEN rate >= 48000 THEN 'Media' ELSE 'Estándar' END AS quality, site, season, cover,
          count(*) AS n, count(*) FILTER (k % 7 = 0) AS n_errors, count(battery_v) AS n_battery, min(date_trunc('second', ts)) AS first,
          min('file:///d/' || CASE WHEN k % 5 = 0 THEN 'Luna' ELSE 'x' END || '/' || folder || '/' || replace(cover, ' ', '%20') || '/' || name) AS url, count(DISTINCT audiomoth_id) AS n_recorders FROM p WHERE contains(name, '2') GROUP BY ALL""",
    "q49_groups_by_count": _with(AE) + " UNION ALL ".join(f"SELECT '{c}' AS kind, {c} AS value, count(*) AS n FROM ae GROUP BY 2" for c in ("role", "domain", "dominant_band")),
    "q50_time_lines": _with(AE) + f"SELECT recording, domain, any_value({_COLOUR}) AS colour, string_agg(printf('%.6f', onset_s), '|' ORDER BY onset_s, event_id) AS base, string_agg(printf('%.3f', CAST(2 * k AS DOUBLE)), '|' ORDER BY onset_s, event_id) AS length FROM ae GROUP BY 1, 2",
    "q51_flux_and_index_series": _with(AE) + f"""SELECT recording, string_agg(role, ',' ORDER BY onset_s, event_id) AS roles, string_agg({_COLOUR}, ',' ORDER BY onset_s, event_id) AS colours, array_to_string(list_transform(range(1, count(*) + 1), lambda i: 'E' || i), ',') AS labels,
        string_agg(printf('%.3f', k / CAST(4 AS DOUBLE)), '|' ORDER BY onset_s, event_id) AS aci, string_agg(printf('%.3f', CASE WHEN k % 2 = 0 THEN k / CAST(8 AS DOUBLE) ELSE CAST(0 AS DOUBLE) END), '|' ORDER BY onset_s, event_id) AS ndsi, CAST(count(*) AS INTEGER) AS n, round(max(peak_flux), 4) AS peak FROM ae GROUP BY 1""",
    "q52_domain_pies": _with(AE) + f"SELECT recording, domain, round(100 * n / sum(n) OVER (PARTITION BY recording), 6) AS percent, {_COLOUR} AS colour FROM (SELECT recording, domain, count(*) AS n FROM ae GROUP BY 1, 2)",
    "q53_batch_totals": _with(AE, REC, HE) + "SELECT (SELECT count(*) FROM rec) AS n_files, (SELECT count(*) FROM rec WHERE recording NOT IN (SELECT recording FROM he)) AS n_silent, count(*) AS n_events, count(*) FILTER (k % 4 = 0) AS n_clips, count(DISTINCT role) AS n_roles FROM he",
    "q54_confusion": _with(AE) + " UNION ALL ".join(f"SELECT '{c}' AS kind, {c} AS value, count(*) AS n FROM ae GROUP BY 2" for c in ("role", "domain", "dominant_band")),
    "q55_accuracy": _with(AE) + "SELECT site, count(*) AS n, round(avg(CAST(domain = 'biophony' AS INTEGER)), 4) AS domain_accuracy, round(avg(CAST(role = 'click' AS INTEGER)), 4) AS role_accuracy FROM ae GROUP BY 1",
    "q56_formats": r"""WITH o AS (SELECT *, CAST(o_orderkey AS INTEGER) AS n, CAST(o_orderdate AS TIMESTAMP) AS d, CAST(o_orderkey % 9000 AS DOUBLE) AS hz, ([16000, 48000, 192000])[o_orderkey % 3 + 1] AS rate FROM orders)
        SELECT o_orderkey, CAST(CASE n % 5 WHEN 0 THEN n % 700 WHEN 1 THEN n % 700 * 1024 WHEN 2 THEN n % 700 * 1048576 WHEN 3 THEN (n % 700) * CAST(1073741824 AS BIGINT) END AS BIGINT) AS size,
          round(CASE WHEN hz > 0 THEN log2(hz / CAST(261.63 AS DOUBLE)) ELSE CAST(-5 AS DOUBLE) END, 9) AS voct, round(CAST(rate AS DOUBLE) / 2048, 6) AS hz_per_bin, round(CAST(512000 AS DOUBLE) / rate, 6) AS ms_per_hop, round(greatest(CAST(50 AS DOUBLE), hz / 2), 6) AS lo, round(least(rate / CAST(2 AS DOUBLE), hz * 4), 6) AS hi,
          round(ln((hz + 100) / 100) / ln(CAST(100 AS DOUBLE)), 9) AS place, '&lt;a href=&quot;' || o_orderpriority || '&quot;&gt;&amp;' AS escaped, CASE WHEN n % 2 = 0 THEN '' ELSE '/else/' END || replace(o_orderpriority, ' ', '%20') || '%231' AS href,
          'file:///r/' || replace(o_orderpriority, ' ', '%20') || '%2B%C3%B1.wav' AS url, replace(o_orderpriority, ' ', '_') AS safe, n % 200 - 100 BETWEEN -90 AND 90 AND n % 400 - 200 BETWEEN -180 AND 180 AS on_earth,
          date_trunc('day', d) + to_hours(n % 24) + to_minutes(30) + to_seconds(15) AS referenced, CASE WHEN n % 3 < 2 THEN date_trunc('day', d) END AS surveyed, CASE WHEN n % 2 = 0 THEN date_trunc('day', d) + to_hours(4) + to_minutes(5) + to_seconds(6) END AS iso,
          'k=' || (['0', '0.5', '1', '1.5', '2', '2.5', '3', '3.5'])[n % 8 + 1] || ' min=' || n % 3 || 's merge=0.25s' AS label FROM o""",
    "q57_kml_stations": """SELECT s_name AS station_id, CASE WHEN k % 2 = 0 THEN 'pasto limpio' ELSE 'bosque de galeria ripario' END AS cover_key, TIMESTAMP '2024-03-01' + to_days(k % 28) AS sampled_at, k % 90 + CAST(0.5 AS DOUBLE) AS latitude, -(k % 180 + CAST(0.25 AS DOUBLE)) AS longitude,
        CASE k % 4 WHEN 0 THEN CAST(0 AS DOUBLE) WHEN 1 THEN NULL ELSE round(k / CAST(4 AS DOUBLE), 1) END AS elevation_m, 'last' AS locality FROM (SELECT *, CAST(s_suppkey AS INTEGER) AS k FROM supplier) WHERE k % 3 <> 0""",
    "q58_anchored_baseline": """WITH v AS (SELECT event_type, event_id, value, row_number() OVER (PARTITION BY event_type ORDER BY event_id) - 1 AS i, count(*) OVER (PARTITION BY event_type) AS n FROM events),
        w AS (SELECT *, median(value) OVER o AS m, mad(value) OVER o AS d, CAST(ceil((n - 100) / 200) AS BIGINT) AS stride FROM v WINDOW o AS (PARTITION BY event_type ORDER BY event_id ROWS BETWEEN 49 PRECEDING AND CURRENT ROW)),
        a AS (SELECT *, CASE WHEN n <= 300 OR i < 100 OR i = n - 1 OR (i - 100) % stride = 0 THEN i END AS pos FROM w),
        b AS (SELECT *, last_value(pos IGNORE NULLS) OVER p AS i0, last_value(CASE WHEN pos IS NOT NULL THEN m END IGNORE NULLS) OVER p AS m0, last_value(CASE WHEN pos IS NOT NULL THEN d END IGNORE NULLS) OVER p AS d0,
          first_value(pos IGNORE NULLS) OVER f AS i1, first_value(CASE WHEN pos IS NOT NULL THEN m END IGNORE NULLS) OVER f AS m1, first_value(CASE WHEN pos IS NOT NULL THEN d END IGNORE NULLS) OVER f AS d1 FROM a
          WINDOW p AS (PARTITION BY event_type ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), f AS (PARTITION BY event_type ORDER BY i ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))
        SELECT event_id, round(CASE WHEN i1 = i0 THEN m0 ELSE m0 + (m1 - m0) * (i - i0) / (i1 - i0) END, 6) AS median, round(CASE WHEN i1 = i0 THEN d0 ELSE d0 + (d1 - d0) * (i - i0) / (i1 - i0) END, 6) AS mad FROM b""",
    "q59_tones": """WITH s AS (SELECT s_suppkey, CAST(s_suppkey AS INTEGER) % 900 + 20 AS b FROM supplier), t AS (SELECT s_suppkey, b * CAST(96000 AS DOUBLE) / 4096 AS hz, i FROM s, range(3) r(i))
        SELECT s_suppkey, i AS frame_idx, round(i * CAST(512 AS DOUBLE) / 48000, 9) AS t_s, round(hz, 4) AS peak_hz, CASE WHEN hz < 2000 THEN 'geophony' WHEN hz < 4000 THEN 'biophony_low' WHEN hz < 8000 THEN 'biophony_mid' WHEN hz < 16000 THEN 'biophony_high' ELSE 'ultrasonic' END AS band, i = 0 AS first FROM t""",
    "q60_stream_daily_counts": "SELECT CAST(ts AS DATE) AS day, event_type, count(*) AS n FROM events GROUP BY 1, 2 HAVING CAST(CAST(ts AS DATE) AS TIMESTAMP) + INTERVAL 2 DAY <= (SELECT max(ts) FROM events)",
    "q61_stream_sessions": """WITH e AS (SELECT user_id, ts, value, coalesce(CAST(ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) >= INTERVAL 2 HOUR AS INTEGER), 1) AS new FROM events), g AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS g FROM e)
        SELECT user_id, epoch_us(min(ts)) / CAST(1000000 AS DOUBLE) AS onset_s, epoch_us(max(ts)) / CAST(1000000 AS DOUBLE) AS last_s, round(max(value), 4) AS peak, count(*) AS n FROM g GROUP BY user_id, g HAVING max(ts) + INTERVAL 2 HOUR <= (SELECT max(ts) - INTERVAL 1 DAY FROM events)""",
    "q62_stream_thinning": """WITH RECURSIVE s AS (SELECT user_id, epoch_us(ts) / CAST(1000000 AS DOUBLE) AS t, row_number() OVER (PARTITION BY user_id ORDER BY ts) AS i FROM events),
        f AS (SELECT user_id, t, i, t AS last, TRUE AS keep FROM s WHERE i = 1 UNION ALL SELECT s.user_id, s.t, s.i, CASE WHEN s.t - f.last >= 7200 THEN s.t ELSE f.last END, s.t - f.last >= 7200 FROM f JOIN s ON s.user_id = f.user_id AND s.i = f.i + 1)
        SELECT user_id, round(t, 6) AS "at" FROM f WHERE keep AND t <= (SELECT epoch_us(max(ts)) / CAST(1000000 AS DOUBLE) - 86400 FROM events)""",
    "q63_sweep": "WITH RECURSIVE " + AE + "," + ANN + """,
        g AS (SELECT CAST(i * 2 + j AS INTEGER) AS config, ([0, 0.5, 1])[i + 1] AS kf, ([0, 600])[j + 1] AS least, ([600, 7200])[j + 1] AS gap FROM range(3) a(i), range(2) b(j)),
        fr AS (SELECT recording AS file, event_id, onset_s AS t, peak_flux AS v, median(peak_flux) OVER w AS m, mad(peak_flux) OVER w AS d, row_number() OVER (PARTITION BY recording ORDER BY event_id) AS i FROM ae WINDOW w AS (PARTITION BY recording ORDER BY event_id ROWS BETWEEN 19 PRECEDING AND CURRENT ROW)),
        up AS (SELECT config, file, t, least, gap, i - row_number() OVER (PARTITION BY config, file ORDER BY event_id) AS run FROM fr, g WHERE v > m + CAST(kf AS DOUBLE) * 1.4826 * d),
        isl AS (SELECT config, file, least, gap, min(t) AS a, max(t) AS b FROM up GROUP BY config, file, least, gap, run),
        nw AS (SELECT *, coalesce(CAST(a - max(b) OVER (PARTITION BY config, file ORDER BY a, b ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) > gap AS INTEGER), 1) AS new FROM isl),
        gr AS (SELECT *, sum(new) OVER (PARTITION BY config, file ORDER BY a, b ROWS UNBOUNDED PRECEDING) AS grp FROM nw),
        ev AS (SELECT config, file, a, row_number() OVER (PARTITION BY config, file ORDER BY a) AS e FROM (SELECT config, file, min(a) AS a, max(b) AS b, any_value(least) AS least FROM gr GROUP BY config, file, grp) WHERE b - a >= least),
        p AS (SELECT config, ev.file, e, ref, row_number() OVER (PARTITION BY config, ev.file ORDER BY abs(a - r0), e, ref) AS i FROM ev JOIN ref ON ref.file = ev.file WHERE abs(a - r0) <= 1800),
        w AS (SELECT config, file, CAST(0 AS BIGINT) AS i, CAST([] AS BIGINT[]) AS x, CAST([] AS BIGINT[]) AS y FROM (SELECT DISTINCT config, file FROM p)
          UNION ALL SELECT w.config, w.file, p.i, CASE WHEN list_contains(x, e) OR list_contains(y, ref) THEN x ELSE list_append(x, e) END, CASE WHEN list_contains(x, e) OR list_contains(y, ref) THEN y ELSE list_append(y, ref) END FROM w JOIN p ON p.config = w.config AND p.file = w.file AND p.i = w.i + 1),
        tp AS (SELECT config, sum(n) AS tp FROM (SELECT config, file, len(arg_max(x, i)) AS n FROM w GROUP BY 1, 2) GROUP BY 1), ne AS (SELECT config, count(*) AS n FROM ev GROUP BY 1),
        sc AS (SELECT g.config, CAST(coalesce(tp, 0) AS BIGINT) AS tp, CAST(coalesce(n, 0) - coalesce(tp, 0) AS BIGINT) AS fp, CAST((SELECT count(*) FROM ref) - coalesce(tp, 0) AS BIGINT) AS fn FROM g LEFT JOIN tp ON tp.config = g.config LEFT JOIN ne ON ne.config = g.config),
        pr AS (SELECT *, coalesce(tp / nullif(tp + fp, 0), 0) AS pp, coalesce(tp / nullif(tp + fn, 0), 0) AS rr FROM sc)
        SELECT config, tp, fp, fn, round(pp, 4) AS precision, round(rr, 4) AS recall, round(coalesce(2 * pp * rr / nullif(pp + rr, 0), 0), 4) AS f1 FROM pr""",
    "q64_stream_baseline": """WITH v AS (SELECT user_id, epoch_us(ts) AS t, value FROM events),
        r AS (SELECT user_id, t, median(value) OVER w AS m, mad(value) OVER w AS d FROM v WINDOW w AS (PARTITION BY user_id ORDER BY t RANGE BETWEEN 172799999999 PRECEDING AND CURRENT ROW))
        SELECT user_id, round(t / CAST(1000000 AS DOUBLE), 6) AS "at", round(m, 6) AS median, round(d, 6) AS mad FROM r WHERE t <= (SELECT max(t) - 86400000000 FROM v)""",
    "q65_stream_flux": _with(MAG) + ", d AS (SELECT recording, frame, greatest(m - lag(m) OVER (PARTITION BY recording, k ORDER BY frame), 0) AS r FROM mag) SELECT recording, frame, round(sqrt(sum(coalesce(r, 0) * coalesce(r, 0))), 6) AS flux FROM d WHERE frame <= (SELECT max(vec_id) - 60 FROM embeddings) GROUP BY 1, 2",
    "q66_periodicity": _with(MAG) + """, e AS (SELECT recording, frame, sum(m * m) FILTER (f >= 2000 AND f < 8000) AS e FROM mag GROUP BY 1, 2),
        c AS (SELECT *, row_number() OVER (PARTITION BY recording ORDER BY frame) AS i, count(*) OVER (PARTITION BY recording) AS n, least(count(*) OVER (PARTITION BY recording), 20) AS w FROM e),
        d AS (SELECT a.recording, a.i, a.n, a.e - (SELECT coalesce(sum(b.e), 0) FROM c b WHERE b.recording = a.recording AND b.i BETWEEN a.i - a.w // 2 AND a.i + (a.w - 1) // 2) / a.w AS x FROM c a),
        x AS (SELECT recording, i, n, x - avg(x) OVER (PARTITION BY recording) AS x FROM d), p AS (SELECT recording, any_value(n) AS n, sum(x * x) AS p FROM x GROUP BY 1),
        l AS (SELECT a.recording, b.i - a.i AS lag, sum(a.x * b.x) / any_value(p.p) AS v FROM x a JOIN x b ON a.recording = b.recording AND b.i > a.i AND b.i - a.i <= 20 JOIN p ON p.recording = a.recording WHERE b.i - a.i <= p.n // 2 AND p.n >= 8 AND least(20, p.n // 2) - 1 >= 2 GROUP BY 1, 2),
        k AS (SELECT * FROM (SELECT *, lag(v) OVER (PARTITION BY recording ORDER BY lag) AS a, lead(v) OVER (PARTITION BY recording ORDER BY lag) AS b FROM l) WHERE a < v AND b < v),
        h AS (SELECT k.*, coalesce((SELECT max(lag) FROM l WHERE l.recording = k.recording AND l.lag < k.lag AND l.v > k.v), 0) AS lo, coalesce((SELECT min(lag) FROM l WHERE l.recording = k.recording AND l.lag > k.lag AND l.v > k.v), 99) AS hi FROM k),
        r AS (SELECT recording, lag, v - greatest((SELECT min(v) FROM l WHERE l.recording = h.recording AND l.lag > lo AND l.lag <= h.lag), (SELECT min(v) FROM l WHERE l.recording = h.recording AND l.lag >= h.lag AND l.lag < hi)) AS prom FROM h),
        f AS (SELECT recording, arg_min(prom, lag) AS prom, min(lag) AS lag FROM r WHERE prom >= 0.05 GROUP BY 1)
        SELECT p.recording, round(coalesce(least(prom, 1), 0), 4) AS periodicity, round(coalesce(10 / lag, 0), 3) AS pulse_rate_hz FROM p LEFT JOIN f USING (recording)""",
    "q67_results_round_trip": _with(AE, REC, ALL_HEARD) + """, e AS (SELECT recording, count(*) AS n, count(*) FILTER (k % 2 = 0) AS c, string_agg(role, ',' ORDER BY onset_s, event_id) AS roles FROM he GROUP BY 1)
        SELECT '/out/' || rec.recording AS filepath, CASE WHEN day(day) % 3 <> 0 THEN CAST(day AS TIMESTAMP) END AS recorded_at, 'pasto' AS habitat, 'seca' AS season, CAST(coalesce(n, 0) AS INTEGER) AS n_events, CAST(coalesce(c, 0) AS INTEGER) AS n_clips, round(rec_hour / CAST(24 AS DOUBLE), 6) AS ndsi, coalesce(roles, '') AS roles
        FROM rec LEFT JOIN e ON e.recording = rec.recording""",
    "q68_gallery_search": _with(AE, ALL_HEARD) + """SELECT role, domain, 'clips/' || role || '%20%23' || k % 3 || '.wav' AS clip_path, count(*) AS n, round(max(confidence), 4) AS confidence FROM he WHERE k % 2 = 0 AND role = 'purchase' GROUP BY 1, 2, 3""",
    "q69_score_lines": _with(AE) + """, m AS (SELECT onset_s, '/parliament/event/role' AS a, role AS x, '"' || role || '"' AS y FROM ae UNION ALL SELECT onset_s, '/parliament/hour', CAST(rec_hour AS VARCHAR), CAST(rec_hour AS VARCHAR) FROM ae
          UNION ALL SELECT onset_s, '/parliament/event/confidence', printf('%.4f', confidence), printf('%.4f', confidence) FROM ae),
        u AS (SELECT CAST(round(onset_s * 1000000) AS BIGINT) AS us, * FROM m)
        SELECT kind, value, count(*) AS n FROM (SELECT 'score' AS kind, printf('[%d.%06d, ["%s", %s]],', us // 1000000, us % 1000000, a, y) AS value FROM u UNION ALL SELECT 'bundle', printf('%d.%04d', (us + 50) // 1000000, (us + 50) % 1000000 // 100) || chr(9) || a || chr(9) || x FROM u) GROUP BY 1, 2""",
    "q70_calendar_files": _with(AE, REC, ALL_HEARD) + """, cnt AS (SELECT day, role, count(*) AS n, min((rec_start, event_id)) AS f FROM he GROUP BY 1, 2), top AS (SELECT day, role FROM (SELECT *, row_number() OVER (PARTITION BY day ORDER BY n DESC, f) AS r FROM cnt) WHERE r = 1),
        d AS (SELECT day, count(DISTINCT recording) AS n_recordings FROM rec GROUP BY 1), h AS (SELECT day, count(*) AS n, round(avg(CAST(domain = 'biophony' AS INTEGER)), 4) AS share FROM he GROUP BY 1)
        SELECT CAST(d.day AS VARCHAR) AS day, coalesce(n, 0) AS n_events, share, n_recordings, coalesce(role, 'silence') AS dominant_role FROM d LEFT JOIN h ON h.day = d.day LEFT JOIN top ON top.day = d.day""",
    "q71_header_messages": _with(AE, DAILY, DAWN, FRAMES, DIEL) + """, t AS (SELECT hour, CASE WHEN max(mean_events) OVER () > 0 THEN round(mean_events / max(mean_events) OVER (), 4) ELSE 0 END AS level FROM diel)
        SELECT '/phenology/meta' AS addr, count(*) || '|' || min(day) || '|' || max(day) || '|2.0000' AS args FROM fr
        """ + " ".join(f"UNION ALL SELECT '/phenology/range/{n}', printf('%.4f|%.4f', {lo}, {hi}) FROM fr HAVING count(*) > 0" for n, lo, hi in [*[(n, f"CAST(coalesce(min({c}), 0) AS DOUBLE)", f"CAST(coalesce(max({c}), 0) AS DOUBLE)") for n, c in (("activity", "activity"), ("richness", "rich"), ("adi", "adi"), ("aci", "aci"), ("dawn", "dawn"))], *[(n, "CAST(0 AS DOUBLE)", "CAST(1 AS DOUBLE)") for n in ("biophony", "geophony", "anthrophony")], ("ndsi", "CAST(-1 AS DOUBLE)", "CAST(1 AS DOUBLE)")]) + """
        UNION ALL SELECT '/phenology/diel/table', string_agg(printf('%.4f', CAST(level AS DOUBLE)), '|' ORDER BY hour) FROM t UNION ALL SELECT '/phenology/diel/peak_hour', CAST(arg_min(hour, (-level, hour)) AS VARCHAR) FROM t
        UNION ALL SELECT '/phenology/dawn_chorus/' || n, printf('%.4f', v) FROM (SELECT unnest(['mean', 'first', 'last']) AS n, unnest([avg(onset_minutes), min(onset_minutes), max(onset_minutes)]) AS v FROM dawn)""",
    "q72_stepping": _with(AE) + ", d AS (SELECT day, count(*) AS n_events, row_number() OVER (ORDER BY day) - 1 AS i, count(*) OVER () AS n FROM ae GROUP BY day) SELECT day, n_events, 'before' AS step FROM d WHERE i = n - 1 UNION ALL SELECT day, n_events, 'after' FROM d WHERE i = 5 % n",
    "q73_deployments": """SELECT s_suppkey, CASE WHEN s_suppkey % 7 IN (0, 1, 2, 4) THEN s_suppkey % 7 || ',1' WHEN s_nationkey < 12 THEN n_name ELSE 'No disponible' END AS coordinates FROM supplier JOIN nation ON n_nationkey = s_nationkey""",
    "q74_stride_sample": _with(AE, REC) + ", o AS (SELECT recording, row_number() OVER (ORDER BY recording) - 1 AS i, count(*) OVER () AS n FROM rec) SELECT recording FROM o WHERE n <= 40 OR i IN (SELECT j * (SELECT count(*) FROM rec) // 40 FROM range(40) r(j))",
    "q75_role_and_hour_messages": _with(AE, REC, ALL_HEARD) + """, r AS (SELECT day, role, count(*) AS n FROM he GROUP BY 1, 2), h AS (SELECT d.day, hour, count(he.event_id) AS n FROM (SELECT DISTINCT day FROM rec) d CROSS JOIN range(24) g(hour) LEFT JOIN he ON he.day = d.day AND he.rec_hour = hour GROUP BY 1, 2)
        SELECT day, '/phenology/day/role' AS addr, role || '|' || n || '|' || printf('%.4f', floor(n * 10000 / CAST(sum(n) OVER (PARTITION BY day) AS DOUBLE) + 0.5) / 10000) AS args FROM r UNION ALL SELECT day, '/phenology/day/hourly', string_agg(CAST(n AS VARCHAR), '|' ORDER BY hour) FROM h GROUP BY 1""",
    "q76_detection_of_audio": """WITH s AS (SELECT CAST(s_suppkey AS INTEGER) AS k FROM supplier), t AS (SELECT k, 500 + k * 37 % 6500 AS hz, k % 5 <> 0 AS loud, make_timestamp(2024, 1 + k % 12, 1 + k % 28, k % 24, k // 24 % 60, CAST(k // 1440 % 60 AS DOUBLE)) AS made FROM s)
        SELECT strftime(made, '%Y%m%d_%H%M%S') || '.wav' AS file, CAST(16000 AS BIGINT) AS samplerate_hz, CAST(6 AS DOUBLE) AS duration_s, made AS recorded_at, CAST(loud AS BIGINT) AS n_events, CASE WHEN loud THEN CAST(3 AS DOUBLE) END AS onset, CASE WHEN loud THEN CAST(4 AS DOUBLE) END AS "offset",
          CASE WHEN NOT loud THEN NULL WHEN hz < 2000 THEN 'geophony' WHEN hz < 4000 THEN 'biophony_low' ELSE 'biophony_mid' END AS band FROM t""",
    "q77_split_recordings": """WITH s AS (SELECT CAST(s_suppkey AS INTEGER) AS k FROM supplier), p AS (SELECT unnest([1, 7, 64, 183, 184]) AS span)
        SELECT strftime(make_timestamp(2024, 1 + k % 12, 1 + k % 28, k % 24, k // 24 % 60, CAST(k // 1440 % 60 AS DOUBLE)), '%Y%m%d_%H%M%S') || '.wav' AS file, span, CAST((96000 - 2048) // 512 + 1 AS BIGINT) AS n_frames,
          CAST(ceil(184 / CAST(span AS DOUBLE)) AS BIGINT) AS n_ranges, CAST(span AS BIGINT) AS longest, CAST(0 AS BIGINT) AS n_different FROM s, p""",
    "q78_wide_baseline": """SELECT event_id, round(median(value) OVER w, 6) AS median, round(mad(value) OVER w, 6) AS mad FROM events
        WINDOW w AS (PARTITION BY event_type ORDER BY event_id ROWS BETWEEN 4999 PRECEDING AND CURRENT ROW)""",
    "q79_stream_merged": """WITH m AS (SELECT max(epoch_us(ts)) - 86400000000 AS mark FROM events), e AS (SELECT user_id, epoch_us(ts) AS t, value, coalesce(CAST(epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY ts) > 7200000000 AS INTEGER), 1) AS new FROM events, m WHERE epoch_us(ts) <= mark),
        g AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY t ROWS UNBOUNDED PRECEDING) AS g FROM e)
        SELECT user_id, round(min(t) / CAST(1000000 AS DOUBLE), 6) AS onset_s, round(max(t) / CAST(1000000 AS DOUBLE), 6) AS last_s, round(max(value), 4) AS peak, round(list_reduce(list(value ORDER BY t), lambda a, b: (a + b) / 2), 6) AS mean, count(*) AS n
        FROM g, m GROUP BY user_id, g, mark HAVING max(t) + 7200000000 < mark""",
    "q80_stream_replies": "WITH RECURSIVE " + AE + """, d AS (SELECT CAST(day AS VARCHAR) AS day, row_number() OVER (ORDER BY day) - 1 AS i FROM (SELECT DISTINCT day FROM ae)), n AS (SELECT count(*) AS n FROM d),
        q AS (SELECT user_id, epoch_us(ts) AS t, event_type AS e, coalesce(CAST(json_extract(props, '$.k') AS INTEGER), 0) AS k, CAST(CAST(ts AS DATE) + coalesce(CAST(json_extract(props, '$.k') AS INTEGER), 0) % 20 AS DATE) AS want FROM events),
        v AS (SELECT user_id, t, CASE e WHEN 'click' THEN 'next' WHEN 'view' THEN 'prev' WHEN 'purchase' THEN 'day' WHEN 'error' THEN 'date' ELSE CASE WHEN k % 2 = 0 THEN 'meta' ELSE 'sleep' END END AS verb, CASE WHEN e = 'purchase' THEN CASE WHEN k % 7 <> 0 THEN k - 20 END WHEN e = 'error' THEN d.i END AS goal,
          row_number() OVER (PARTITION BY user_id ORDER BY t) AS r FROM q LEFT JOIN d ON e = 'error' AND d.day = CAST(want AS VARCHAR)),
        f AS (SELECT user_id, CAST(0 AS BIGINT) AS r, CAST(0 AS BIGINT) AS cursor FROM (SELECT DISTINCT user_id FROM v)
          UNION ALL SELECT v.user_id, v.r, CASE WHEN verb = 'next' THEN (cursor + 1) % n WHEN verb = 'prev' THEN (cursor - 1 + n) % n WHEN verb IN ('day', 'date') AND goal IS NOT NULL THEN greatest(0, least(goal, n - 1)) ELSE cursor END FROM f JOIN v ON v.user_id = f.user_id AND v.r = f.r + 1, n)
        SELECT user_id, round(t / CAST(1000000 AS DOUBLE), 6) AS "at", verb, CASE WHEN verb <> 'meta' THEN cursor END AS frame, CASE WHEN verb <> 'meta' THEN CAST(d.day AS DATE) END AS day
        FROM v JOIN f USING (user_id, r) LEFT JOIN d ON d.i = cursor WHERE verb <> 'sleep' AND (verb IN ('next', 'prev', 'meta') OR goal IS NOT NULL) AND t <= (SELECT max(epoch_us(ts)) - 86400000000 FROM events)""",
    "q81_overlap_match_scores": "WITH RECURSIVE " + AE + "," + ANN + """, o AS (SELECT file, det, ref, greatest(0, least(offset_s, r1) - greatest(onset_s, r0)) AS i, (offset_s - onset_s) + (r1 - r0) AS u FROM det JOIN ref USING (file)),
        p AS (SELECT file, det, ref, row_number() OVER (PARTITION BY file ORDER BY i / (u - i) DESC, det, ref) AS i FROM o WHERE i / (u - i) >= 0.2),
        w AS (SELECT file, CAST(0 AS BIGINT) AS i, CAST([] AS BIGINT[]) AS d, CAST([] AS BIGINT[]) AS r FROM (SELECT DISTINCT file FROM p)
          UNION ALL SELECT w.file, p.i, CASE WHEN list_contains(d, det) OR list_contains(r, ref) THEN d ELSE list_append(d, det) END, CASE WHEN list_contains(d, det) OR list_contains(r, ref) THEN r ELSE list_append(r, ref) END FROM w JOIN p ON p.file = w.file AND p.i = w.i + 1),
        tp AS (SELECT file, len(arg_max(d, i)) AS tp FROM w GROUP BY 1), nd AS (SELECT file, count(*) AS d FROM det GROUP BY 1), nr AS (SELECT file, count(*) AS r FROM ref GROUP BY 1)
        SELECT coalesce(nd.file, nr.file) AS file, CAST(coalesce(tp, 0) AS BIGINT) AS tp, CAST(coalesce(d, 0) - coalesce(tp, 0) AS BIGINT) AS fp, CAST(coalesce(r, 0) - coalesce(tp, 0) AS BIGINT) AS fn FROM nd FULL JOIN nr ON nd.file = nr.file LEFT JOIN tp ON tp.file = coalesce(nd.file, nr.file)""",
}
