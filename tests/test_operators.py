"""Operators on small fixtures with results worked out by hand."""

from __future__ import annotations

import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from sonoframe.functions import bands as B
from sonoframe.functions import text as X
from sonoframe.operators import calendar, census, classify, detect, matching, sites, timeline
from sonoframe.sources import results, wav
from sonoframe.streaming import sessions


def one(spark, **columns):
    return spark.range(1).select(*[v.alias(k) for k, v in columns.items()]).first()


def test_merge_folds_means_and_keeps_equal_gaps(spark):
    rows = [(1, 0.0, 1.0, 5.0, 4.0), (1, 3.0, 4.0, 9.0, 8.0), (1, 6.0, 7.0, 1.0, 2.0), (1, 20.0, 21.0, 3.0, 3.0)]
    got = detect.merge_gaps(spark.createDataFrame(rows, "r int, onset_s double, offset_s double, peak_flux double, mean_flux double"), "r", 2.0).orderBy("onset_s").collect()
    assert [(g.onset_s, g.offset_s, g.peak_flux, g.mean_flux, g.n_regions) for g in got] == [(0.0, 7.0, 9.0, ((4 + 8) / 2 + 2) / 2, 3), (20.0, 21.0, 3.0, 3.0, 1)]


def test_thinning_is_greedy_not_pairwise(spark):
    ev = spark.createDataFrame([("a", t, i) for i, t in enumerate([0.0, 6.0, 11.0, 19.0, 21.0])], "r string, onset double, id int")
    got = [g.onset for g in detect.thin(ev, "r", "onset", 10.0, ["id"]).orderBy("onset").collect()]
    assert got == [0.0, 11.0, 21.0]


def test_padding_and_fixed_windows(spark):
    ev = spark.createDataFrame([(5.0, 10.0), (100.0, 900.0)], "onset_s double, offset_s double")
    assert [(r.clip_start_s, r.clip_end_s) for r in detect.pad(ev, F.lit(1000.0)).collect()] == [(0.0, 20.0), (80.0, 380.0)]
    s, e = detect.fixed_window(F.lit(995.0), F.lit(1000.0))
    assert tuple(one(spark, s=s, e=e)) == (940.0, 1000.0)


RULES = [
    ("geophony", 12, 31, 0.31, 500, 1, 0.9, "rain_event"), ("geophony", 12, 30, 0.31, 500, 1, 0.9, "wind_event"), ("geophony", 12, 10, 0.31, 500, 1, 0.9, "water_flow"), ("geophony", 12, 21, 0.30, 1400, 1, 0.9, "mechanical_intrusion"),
    ("geophony", 12, 20, 0.2, 700, 1, 0.9, "aircraft_passage"), ("geophony", 12, 5, 0.2, 700, 1, 0.9, "community_shift"), ("ultrasonic_low", 12, 11, 0.2, 700, 1, 0.9, "insect_chorus"), ("ultrasonic_low", 12, 5, 0.2, 700, 1, 0.9, "bat_echolocation"),
    ("ultrasonic_low", 12, 7, 0.2, 700, 1, 0.9, "insect_chorus"), ("biophony_mid", 4, 5, 0.2, 700, 1, 0.9, "dawn_chorus_participant"), ("biophony_low", 19, 5, 0.2, 700, 1, 0.9, "dusk_chorus_participant"), ("biophony_low", 20, 5, 0.14, 700, 1, 0.9, "amphibian_assembly"),
    ("ultrasonic", 3, 5, 0.14, 700, 1, 0.9, "nocturnal_voice"), ("biophony_mid", 23, 5, 0.14, 700, 1, 0.9, "nocturnal_voice"), ("biophony_high", 12, 11, 0.5, 700, 1, 0.9, "insect_chorus"), ("biophony_low", 12, 6, 0.1, 700, 1, 0.9, "amphibian_assembly"),
    ("biophony_mid", 12, 4, 0.5, 700, 1, 0.9, "alarm_or_alert"), ("biophony_mid", 12, 5, 0.19, 700, 1, 0.9, "territorial_announcement"), ("biophony_mid", 12, 40, 0.5, 700, 3, 0.39, "community_shift"), ("biophony_low", None, 5, 0.5, 700, 3, 0.4, "territorial_announcement"),
    ("biophony_high", 12, 5, 0.5, 700, 1, 0.9, "insect_chorus"),
]


def test_rule_list(spark):
    df = spark.createDataFrame([(*r[:2], float(r[2]), r[3], float(r[4]), r[5], r[6], r[7]) for r in RULES], "band string, h int, d double, fl double, c double, n int, share double, want string")
    c = F.col
    got = df.select("want", classify.role_rules(c("band"), c("h"), c("d"), c("fl"), c("c"), F.lit(1.0), c("n"), c("share"))["role"].alias("got")).collect()
    assert [r.got for r in got] == [r.want for r in got]


def test_voices_share_rule_and_transitions(spark):
    e = lambda *v: F.array(*[F.struct(F.lit(i).alias("ord"), F.lit(n).alias("name"), F.lit(float(x)).alias("energy")) for i, (n, x) in enumerate(zip(B.AUDIBLE, v, strict=True))])
    base = (F.lit(12), F.lit(12.0), F.lit(0.1), F.lit(5000.0), F.lit(3.0))
    got = one(spark, a=classify.voices(e(0, 50, 0, 36, 14), *base, F.lit(None).cast("double")), b=classify.voices(e(0, 0, 0, 0, 0), *base, F.lit(3.0)), c=classify.voices(e(0, 1, 0, 0, 0), *base, F.lit(0.1)))
    assert [v.role for v in got.a] == ["amphibian_assembly", "insect_chorus"] and got.a[0].confidence == round(0.65 * 0.8, 3)
    assert [v.role for v in got.b] == ["community_shift"] and [(v.role, v.confidence) for v in got.c] == [("silence_to_activity", 0.7)]


def test_names_and_dates(spark):
    got = one(
        spark, a=X.normalize_cover(F.lit("Bosques de Galería y/o Ripario")), b=X.safe_name(F.lit("__ a/b ")), c=X.safe_name(F.lit("///")), d=X.recorder_datetime(F.lit("20240305_041500")), e=X.recorder_datetime(F.lit("x20240305")),
        f=X.reference_datetime(F.lit("INCT_20200101_235959_1.wav")), g=X.survey_date(F.lit("2024/03/05")), h=X.parse_size(F.lit("10M")), i=X.hz_to_voct(F.lit(523.26)), j=X.hz_to_voct(F.lit(0.0)), k=X.html_escape(F.lit('<a href="x&y">')),
        l=X.place_from_path(F.lit("/d/Captiva/Época seca/Pastos limpios/a.wav"))["cover"], m=X.place_from_path(F.lit("/d/lluvias/x/seca/b.wav"))["season"], n=X.file_url(F.lit("/a b/ñ.wav")),
    )
    assert (got.a, got.b, got.c, got.d, got.e) == ("bosque de galeria ripario", "a_b", "unknown", dt.datetime(2024, 3, 5, 4, 15), None)
    assert (got.f, got.g, got.h, got.i, got.j) == (dt.datetime(2020, 1, 1, 23, 59, 59), dt.datetime(2024, 3, 5), 10 << 20, 1.0, -5.0)
    assert (got.k, got.l, got.m, got.n) == ("&lt;a href=&quot;x&amp;y&quot;&gt;", "Pastos limpios", "Época seca", "file:///a%20b/%C3%B1.wav")


def test_placemarks(spark):
    kml = """<kml><Placemark id="1"><SimpleData name="ID_MUES_PT">P1</SimpleData><SimpleData name="N_COBERT">Pastos y/o limpios</SimpleData><SimpleData name="COTA"> </SimpleData>
      <SimpleData name="FEC_MUEST">2024/03/05</SimpleData><Point><coordinates> -75.5,4.25,0</coordinates></Point></Placemark><Placemark><SimpleData name="ID_MUES_PT">P2</SimpleData></Placemark></kml>"""
    rows = sites.placemarks(spark.createDataFrame([(kml,)], "value string"))
    r = rows.collect()
    assert len(r) == 1 and (r[0].lon, r[0].lat, r[0].cover_key, r[0].sampled_at) == (-75.5, 4.25, "pasto limpio", dt.datetime(2024, 3, 5))
    assert sites.station_fields(rows).first().elevation_m == 0.0


def test_nearest_station_prefers_dated_and_either_side(spark):
    at = lambda d: dt.datetime(2024, 1, d)
    st = spark.createDataFrame([("c", "s1", at(1), 0), ("c", "s2", at(20), 1), ("c", "s3", None, 2), ("d", "s4", None, 3)], "cover_key string, station_id string, sampled_at timestamp_ntz, file_ord int")
    rec = spark.createDataFrame([("r1", "c", at(12)), ("r2", "c", at(2)), ("r3", "d", at(2)), ("r4", "x", at(2)), ("r5", "c", None)], "recording string, cover_key string, at timestamp_ntz")
    assert {r.recording: r.station_id for r in sites.nearest_station(rec, st).collect()} == {"r1": "s2", "r2": "s1", "r3": "s4", "r4": None, "r5": "s1"}


def test_census_and_reels(spark):
    ev = spark.createDataFrame([(1, "x", "biophony", "low", i) for i in range(2)] + [(1, "y", "geophony", "low", 2), (1, "z", "geophony", "low", 3)], "rec int, role string, domain string, dominant_band string, event_id int")
    p = census.parliament(ev, ["rec"]).first()
    assert (p.total_voices, p.pct_biophony, p.democracy_index, p.niche_partitioning) == (4, 50.0, 1.5, 0.0)
    assert [r.role for r in census.reels(ev).collect()] == ["x", "x"]
    assert census.first_seen_mode(ev.filter("event_id > 0"), ["rec"], "role", F.col("event_id")).first().role == "x"


def test_matching_scores_and_time(spark):
    det = spark.createDataFrame([("f", 0, 1.0, 2.0), ("f", 1, 1.4, 3.0), ("f", 2, 9.0, 9.5)], "file string, det int, onset_s double, offset_s double")
    ref = spark.createDataFrame([("f", 0, 1.3, 2.5, "a"), ("f", 1, 1.8, 4.0, "b")], "file string, ref int, ref_onset_s double, ref_offset_s double, label string")
    pairs = matching.onset_pairs(det, ref, 0.5)
    chosen = matching.match_greedy(pairs, ["file"], "distance")
    assert sorted((r.det, r.ref) for r in chosen.collect()) == [(1, 0)]
    s = matching.micro(matching.scores(det, ref, chosen, ["file"]), ["file"]).first()
    assert (s.tp, s.fp, s.fn, s.precision) == (1, 2, 1, 0.3333)
    t = matching.time_level(det.withColumn("duration_s", F.lit(10.0)), ref.withColumn("duration_s", F.lit(10.0)), 10).first()
    assert (t.n_det, t.n_ref) == (25, 27) and t.precision == round(17 / 25, 4)
    assert {r.det: r.label for r in matching.first_label(det, ref, 0.5).collect()} == {0: "a", 1: "a"}
    assert matching.overlap_pairs(det, ref, 0.2, 2.0).count() == 3


def test_cv_and_shifts(spark):
    f = spark.createDataFrame([(1, 2.0, 0.5, None), (2, 4.0, 0.25, 300.0)], "day int, activity double, biophony double, dawn double")
    got = calendar.cv_frames(f, ("activity", "biophony", "dawn")).orderBy("day").collect()
    assert [(r.cv_activity, r.cv_biophony, r.cv_dawn) for r in got] == [(0.0, 0.5, 0.0), (1.0, 0.25, 0.0)]
    day = lambda d: dt.date(2024, 1, d)
    days = spark.createDataFrame([(day(1), 1, 1.0, 1.0, 0.1, 0), (day(3), 3, 3.0, 3.5, 0.7, 5)], "day date, day_of_year int, low double, high double, adi double, n_geophony long")
    roles = spark.createDataFrame([(day(1), ["insect_chorus"]), (day(3), ["nocturnal_voice", "rain_event"])], "day date, roles array<string>")
    dawn = spark.createDataFrame([(day(1), 320.0, 1), (day(3), 300.0, 3)], "day date, onset_minutes double, day_of_year int")
    assert {r.type: r.magnitude for r in calendar.shifts(days, roles, dawn).collect()} == {"breeding_chorus_onset": 3.0, "migration_acoustic_shift": 0.6, "rain_season_transition": 5.0, "nocturnal_community_change": 2.0, "dawn_chorus_advance_delay": -20.0}


def test_messages_and_stepping(spark):
    ev = spark.createDataFrame([(1, 2.0, 3.5, "rain_event", "geophony", "geophony", 20000.0, 250.0)], "event_id int, onset_s double, offset_s double, role string, domain string, dominant_band string, centroid double, peak_flux double")
    m = timeline.event_messages(ev).orderBy("seq").collect()
    assert len(m) == 24 and m[2].args == ["1.5000"] and m[20].args == ["1"] and m[22].args == m[23].args == ["1.0000"]
    assert timeline.bundle_lines(timeline.event_messages(ev)).count() == 24 and timeline.score_lines(timeline.event_messages(ev).filter("seq = 3")).first().value == '[2.000000, ["/parliament/event/role", "rain_event"]],'
    days = spark.createDataFrame([(d,) for d in (10, 20, 30)], "day int")
    assert timeline.step(days, 2, 1).first().day == 10 and timeline.step(days, 0, -1).first().day == 30


def test_presets_certainty_and_colours(spark):
    assert B.preset("dense") == (8.0, 0.3, 0.25) and B.preset("none") == B.PRESETS["balanced"] and B.preset("dense", threshold=3.0)[0] == 3.0
    got = one(spark, a=B.certainty(F.lit(0.6)), b=B.certainty(F.lit(0.36)), c=B.certainty(F.lit(0.35)), d=B.colour_of(F.lit("nothing")), e=B.domain_of(F.lit("rain_event")))
    assert tuple(got) == ("probable", "candidate", "unclassified", 0, "geophony")


@pytest.fixture(scope="module")
def audio_dir(tmp_path_factory):
    root = tmp_path_factory.mktemp("audio")
    t = np.arange(48000 * 3) / 48000
    quiet = 1e-4 * np.random.default_rng(0).normal(size=len(t))
    (root / "20240305_041500.WAV").write_bytes(wav.encode(quiet + np.where((t > 1.5) & (t < 2), 0.5 * np.sin(2 * np.pi * 3000 * t), 0), 48000))
    (root / "bad.wav").write_bytes(b"RIFFxxxxJUNK")
    return root


def test_wav_source(spark, audio_dir):
    files = wav.recordings(spark, str(audio_dir))
    got = {r.path.rsplit("/", 1)[1]: r for r in wav.probe(files).collect()}
    good, bad = got["20240305_041500.WAV"], got["bad.wav"]
    assert (good.samplerate_hz, good.duration_s, good.recorded_at) == (48000, 3.0, dt.datetime(2024, 3, 5, 4, 15)) and bad.error and bad.samplerate_hz is None
    whole = files.filter("path LIKE '%WAV'")
    frames = wav.frame_features(whole, block=50).cache()
    assert frames.count() == 1 + (144000 - 2048) // 512
    small, large = (sorted((r.frame_idx, round(r.flux, 9)) for r in f.collect()) for f in (frames, wav.frame_features(whole)))
    assert small == large
    base = wav.detect_baseline(frames)
    above = base.withColumn("above", detect.above_threshold(F.col("flux"), F.col("median"), F.col("mad"), 8.0))
    loud = detect.islands(above, "path", "frame_idx", F.col("above"), "t_s", "flux").orderBy(F.desc("peak_flux")).first()
    assert 1.4 < loud.onset_s < 1.6
    clip = whole.select("path").selectExpr("path", "1L event_index", "1.5D onset_s", "2.0D offset_s", "1.0D clip_start_s", "2.5D clip_end_s", "2000.0D lo_hz", "4000.0D hi_hz")
    measured = wav.measure_clips(clip).first()
    assert abs(measured.band_centroid - 3000) < 100 and measured.band_crest > 5
    assert wav.file_indices(whole, longest=1.5, slices=3).first().estimated_from_s == 1.5 and wav.file_indices(whole, content=True).first().aci > 0
    by_content = sorted((r.frame_idx, round(r.flux, 9)) for r in wav.frame_features(whole, content=True).collect())
    assert by_content == small and wav.probe(files, content=True).filter("error IS NULL").count() == 1


def test_results_round_trip(spark, tmp_path):
    made = spark.sql("""SELECT 'a.wav' filename, '/x/a.wav' filepath, '2024-03-05T04:15:00' recording_datetime, map('ndsi', 0.5D) indices,
      array(named_struct('event_index', 1, 'role', 'rain_event', 'domain', 'geophony', 'confidence', 0.7D, 'clip_path', '/x/c d.wav')) events""").union(spark.sql("SELECT 'b.wav', '/y/a.wav', NULL, NULL, NULL"))
    results.write_results(made, str(tmp_path / "r"))
    back = results.read_results(spark, str(tmp_path / "r"))
    rows = back.collect()
    assert [r.filename for r in rows] == ["a.wav", "b.wav"] and [r.ndsi for r in rows] == [0.5, 0.0]
    shown = results.gallery(results.events_of(back), "/x").collect()
    assert shown[0].clip_path == "c%20d.wav" and results.search(results.events_of(back), "RAIN").count() == 1 and results.search(results.events_of(back), "rain", ("geophony",)).count() == 0


def test_streams(spark, tmp_path):
    at = lambda s: dt.datetime(2024, 1, 1, 0, 0, s)
    rows = spark.createDataFrame([("a", at(s), float(s)) for s in (0, 3, 20, 24, 50)] + [("b", dt.datetime(2024, 1, 3), 1.0)], "k string, ts timestamp, v double")
    rows.write.parquet(str(tmp_path / "in"))
    stream = lambda: spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))

    def run(df, name, mode="append"):
        q = df.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", str(tmp_path / name)).start()
        q.processAllAvailable()
        q.stop()
        return spark.table(name).collect()

    merged = run(sessions.sessions(stream(), "k", "ts", "v", "5 seconds", "10 seconds"), "merged")
    assert sorted((r.peak, r.n) for r in merged if r.k == "a") == [(3.0, 2), (24.0, 2), (50.0, 1)]
    assert {(str(r.day)[:10], r.k, r.n) for r in run(sessions.daily_counts(stream(), "ts", "k", "1 hour"), "days")} == {("2024-01-01", "a", 5)}
