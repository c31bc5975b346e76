"""From WAV files to results, calendar, messages and scores."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from sonoframe import cli
from sonoframe.plans import detection
from sonoframe.sources import annotations, results, wav

RATE = 16000


@pytest.fixture(scope="module")
def audio(tmp_path_factory):
    root = tmp_path_factory.mktemp("field") / "Captiva" / "Época lluvias" / "Pastos limpios"
    root.mkdir(parents=True)
    rng = np.random.default_rng(5)
    t = np.arange(RATE * 12) / RATE
    for k, name in enumerate(("20240305_051500", "20240306_210000")):
        x = 1e-3 * rng.normal(size=len(t))
        for a in (4.0, 9.0):
            on = (t >= a) & (t < a + 1.0)
            x[on] += 0.4 * np.sin(2 * np.pi * (2500 + 3000 * k) * t[on]) * (np.sin(2 * np.pi * 8 * t[on]) > 0)
        (root / f"{name}.WAV").write_bytes(wav.encode(x, RATE))
    (root / "broken.wav").write_bytes(b"nothing")
    return root


@pytest.fixture(scope="module")
def found(spark, audio):
    s = detection.Settings(factor=8.0, min_duration=0.2, merge_gap=0.5)
    return detection.detect_files(spark, str(audio), settings=s).cache()


def test_events_of_recordings(found):
    rows = found.orderBy("path", "onset_s").collect()
    assert len(rows) >= 4 and {r.cover for r in rows} == {"Pastos limpios"} and {r.season for r in rows} == {"Época lluvias"} and {r.site for r in rows} == {"Luna Captiva"}
    for name, band in (("051500", "biophony_low"), ("210000", "biophony_mid")):
        own = [r for r in rows if name in r.path]
        for a in (4.0, 9.0):
            hit = min(own, key=lambda r: abs(r.onset_s - a))
            assert abs(hit.onset_s - a) < 0.2 and max(hit.band_energies, key=hit.band_energies.get) == band and hit.roles[0] == hit.role


def test_results_calendar_and_commands(spark, found, tmp_path):
    out = str(tmp_path / "out")
    results.write_results(detection.results(found), out)
    back = results.events_of(results.read_results(spark, out))
    assert back.count() == found.count() and back.filter("recorded_at IS NULL").count() == 0
    assert cli.main(["osc", out, "--mode", "map"], spark) == 0
    days = detection.calendar_of(found)
    assert days["daily"].count() == 2 and days["diel"].filter("n_recordings > 0").count() == 2 and days["hourly"].agg(F.sum("n_events")).first()[0] == found.count()
    assert cli.main(["phenology", out, "--output", str(tmp_path / "cal")], spark) == 0 and spark.read.json(str(tmp_path / "cal" / "daily")).count() == 2
    assert cli.main(["osc", out, "--output", str(tmp_path / "osc")], spark) == 0 and spark.read.text(str(tmp_path / "osc")).count() == 24 * found.count()
    assert cli.main(["gallery", out, "--output", str(tmp_path / "gal")], spark) == 0
    assert cli.main(["phenology", str(tmp_path / "none")], spark) == 1 and cli.main(["detect", "x", "--roles", "nobody"], spark) == 2 and cli.main(["doctor"]) == 0
    with pytest.raises(ValueError):
        results.read_calendar(spark, out)


def test_clips_are_cut_and_measured(spark, audio, found, tmp_path):
    chosen = detection.clips(found, detection.Settings(fixed_clip=2.0, fixed_pre=1.0))
    cut = annotations.cut_clips(chosen, f"file://{tmp_path}").collect()
    assert len(cut) == chosen.count() > 0
    data, rate = wav.decode((tmp_path / cut[0].clip).read_bytes())
    assert rate == RATE and abs(len(data) / rate - 2.0) < 0.01


def test_settings_of_flags():
    parse = lambda *a: cli.settings_of(cli.parser().parse_args(["detect", "x", *a]))
    assert (parse().factor, parse().min_duration) == (2.5, 2.0) and parse("--sensitivity", "dense", "--threshold", "3").factor == 3.0
    assert parse("--ultrasonic").merge_gap == 1.0 and parse("--ultrasonic", "--merge-gap", "4").merge_gap == 4.0 and "ultrasonic_mid" in parse("--ultrasonic").bands


def test_annotations_and_samples(spark, audio, tmp_path):
    (tmp_path / "20240305_051500.txt").write_text("Begin Time (s)\tEnd Time (s)\tSpecies\n9.0\t10.0\tb\n4.0\t3.0\ta\n\t\tnone\n")
    rows = annotations.intervals(spark, str(tmp_path)).orderBy("ref").collect()
    assert [(r.file, r.ref, r.ref_onset_s, r.ref_offset_s, r.label) for r in rows] == [("20240305_051500", 0, 4.0, 4.0, "a"), ("20240305_051500", 1, 9.0, 10.0, "b")]
    for n, limit in ((10, 3), (7, 7), (5, 9), (100, 6)):
        got = [r.id for r in annotations.stride_sample(spark.range(n), "id", limit).orderBy("id").collect()]
        assert got == (list(range(n)) if n <= limit else [int(j * n / limit) for j in range(limit)])
    assert cli.main(["validate", str(audio), str(tmp_path)], spark) == 0
    probes = wav.probe(wav.recordings(spark, str(audio)))
    assert annotations.max_rate(probes).first()[0] == RATE


def test_small_tables(spark):
    rows = spark.createDataFrame([("m1", "c1", None, 20.0), ("m2", "c1", "bad", 5.0), ("m3", "c9", None, 0.0)], "audiomoth_id string, cover string, error string, temperature_c double").withColumn("recorded_at", F.lit("2024-01-01"))
    ids, covers = spark.createDataFrame([("m1", "1,2"), ("m2", "")], "key string, coordinates string"), spark.createDataFrame([("c1", "3,4")], "key string, coordinates string")
    assert {r.audiomoth_id: r.coordinates for r in annotations.deployments(rows, ids, covers).collect()} == {"m1": "1,2", "m2": "3,4", "m3": "No disponible"}
    assert [r.audiomoth_id for r in annotations.chart_rows(rows).collect()] == ["m1"]
    assert [r.temperature_c for r in annotations.sort_as_text(rows, "temperature_c").collect()] == [0.0, 20.0, 5.0]
    assert [r.n for r in annotations.latest_reels(spark.createDataFrame([("x", 1, 1), ("x", 2, 2)], "role string, o int, n int"), "o").collect()] == [2]


def test_sweep_scores_every_configuration(spark, audio):
    from sonoframe.operators import matching
    from sonoframe.plans import validation

    files = wav.recordings(spark, str(audio)).filter("path LIKE '%WAV'")
    frames = wav.detect_baseline(wav.frame_features(files)).withColumn("file", F.regexp_extract("path", "([^/]+)\\.[^./]+$", 1))
    grid = matching.grid(spark, (4.0, 1e6), ((0.2, 0.5), (0.1, 0.2)))
    ref = spark.createDataFrame([(f, i, a, a + 1.0) for f in ("20240305_051500", "20240306_210000") for i, a in enumerate((4.0, 9.0))], "file string, ref int, ref_onset_s double, ref_offset_s double")
    rows = validation.report(validation.sweep(frames, grid), ref, grid).collect()
    assert [r.config for r in rows][:2] in ([0, 1], [1, 0]) and len(rows) == 4 and rows[0].recall == 1.0 and rows[-1].f1 == 0.0


def test_header_and_role_messages(spark):
    from sonoframe.operators import calendar, timeline

    frames = spark.createDataFrame([(1, 2.0), (2, 6.0)], "day int, activity double").withColumns({c: F.lit(None).cast("double") for c in ("richness", "biophony", "geophony", "anthrophony", "ndsi", "adi", "aci", "dawn")})
    diel = spark.createDataFrame([(0, 0.5), (1, 1.0), (2, 1.0)], "hour int, level double")
    dawn = spark.createDataFrame([(300.0,), (310.0,)], "onset_minutes double")
    got = {r.addr: r.args for r in timeline.header_messages(frames, diel, dawn).collect()}
    assert got["/phenology/meta"] == ["2", "1", "2", "1.0000"] and got["/phenology/range/activity"] == ["2.0000", "6.0000"] and got["/phenology/range/ndsi"] == ["-1.0000", "1.0000"]
    assert got["/phenology/diel/peak_hour"] == ["1"] and got["/phenology/dawn_chorus/mean"] == ["305.0000"] and len(got) == 15
    roles = spark.createDataFrame([(1, "a", 1), (1, "b", 3)], "day int, role string, n long")
    assert [r.args for r in timeline.role_messages(roles).orderBy("seq").collect()] == [["b", "3", "0.7500"], ["a", "1", "0.2500"]]
    hours = spark.range(24).select(F.lit(1).alias("day"), F.col("id").cast("int").alias("hour"), F.col("id").alias("n_events"))
    assert timeline.hourly_messages(hours).first().args == [str(i) for i in range(24)] and calendar.heatmap(hours).first()["7"] == 7
    assert timeline.address_map()["/query/prev"] == "request"


@pytest.fixture(scope="module")
def silent(tmp_path_factory):
    """One loud and two silent recordings on two days, a station table above them, and a header comment."""
    top = tmp_path_factory.mktemp("survey")
    root = top / "audio" / "Pastos limpios"
    root.mkdir(parents=True)
    rng = np.random.default_rng(6)
    t = np.arange(RATE * 8) / RATE
    comment = "Recorded at 05:15:00 05/03/2024 (UTC) by AudioMoth 24E144085F256D88 at medium gain while battery was 4.2V and temperature was 19.2C."
    for name, loud in (("20240305_051500", True), ("20240305_061500", False), ("20240306_051500", False)):
        x = 1e-3 * rng.normal(size=len(t)) + (0.4 * np.sin(2 * np.pi * 3000 * t) * (np.sin(2 * np.pi * 8 * t) > 0) * ((t > 4) & (t < 5)) if loud else 0)
        (root / f"{name}.WAV").write_bytes(wav.encode(x, RATE, comment if loud else ""))
    (root / "broken.wav").write_bytes(b"nothing")
    (top / "places.kml").write_text('<kml><Placemark><SimpleData name="ID_MUES_PT">P7</SimpleData><SimpleData name="N_COBERT">Pastos Limpios</SimpleData><SimpleData name="FEC_MUEST">2024/03/04</SimpleData><Point><coordinates>-74.5,4.5,0</coordinates></Point></Placemark></kml>')
    return root


def test_silent_recordings_count(spark, silent, tmp_path):
    s = detection.Settings(factor=12.0, min_duration=0.2, merge_gap=0.5)
    made, found = detection.analyse(spark, str(silent), settings=s)
    rows = {r.filename: r for r in made.collect()}
    assert len(rows) == 4 and rows["broken.wav"].error and rows["20240305_051500.WAV"].temperature_c == 19.2 and rows["20240305_051500.WAV"].audiomoth_id == "24E144085F256D88" and rows["20240306_051500.WAV"].temperature_c is None
    heard = {r.path.rsplit("/", 1)[1] for r in found.collect()}
    stored = {r.filename: r for r in detection.results(found, made).collect()}
    assert set(stored) == {n for n in rows if n != "broken.wav"} and all((stored[n].n_events > 0) == (n in heard) for n in stored) and "20240305_051500.WAV" in heard
    days = {str(r.day): r for r in detection.calendar_of(found.filter("path LIKE '%20240305_051500%'"), made)["daily"].collect()}
    assert [days[d].n_recordings for d in sorted(days)] == [2, 1] and days["2024-03-06"].dominant_role == "silence" and days["2024-03-06"].n_events == 0 and days["2024-03-06"].biophony_share is None
    assert days["2024-03-05"].events_per_recording == days["2024-03-05"].n_events / 2


def test_detect_writes_results_clips_and_calendar(spark, silent, tmp_path):
    out = str(tmp_path / "out")
    assert cli.main([str(silent), "-o", out, "--threshold", "12", "--min-duration", "0.2", "--merge-gap", "0.5", "--phenology", "--days-per-second", "2"], spark) == 0
    stored = results.read_results(spark, f"{out}/results")
    assert stored.count() == 3 and stored.filter("n_events = 0").count() >= 1
    ev = results.events_of(stored).collect()
    assert all(r.station_id == "P7" and r.latitude == 4.5 and r.clip_path and (tmp_path / "out" / r.clip_path).exists() and r.aci is not None for r in ev) and ev
    assert spark.read.json(f"{out}/phenology/frames").count() == 2 and spark.read.text(f"{out}/phenology/messages").count() >= 2 * 13
    assert cli.main(["metadata", str(silent), "-o", f"{out}/meta", "--text", "wav"], spark) == 0
    assert spark.read.json(f"{out}/meta/files").count() == 4 and spark.read.json(f"{out}/meta/summary").first().n_errors == 1 and spark.read.json(f"{out}/meta/temperatures").count() == 1
    for mode in ("phenology", "score"):
        assert cli.main(["osc", f"{out}/results", "-o", f"{out}/{mode}", "--mode", mode], spark) == 0 and spark.read.text(f"{out}/{mode}").count() > 20
    assert cli.main(["gallery", f"{out}/results", "-o", f"{out}/gal"], spark) == 0 and spark.read.json(f"{out}/gal/roles").count() >= 1
    tables = tmp_path / "ref"
    tables.mkdir()
    (tables / "20240305_051500.txt").write_text("Begin Time (s)\tEnd Time (s)\tSpecies\n4.0\t5.0\ta\n")
    assert cli.main(["validate", str(silent), str(tables), "--sweep", "--min-iou", "0.1", "-o", f"{out}/sweep"], spark) == 0
    swept = spark.read.json(f"{out}/sweep")
    assert swept.count() == 30 and {"iou_tp", "iou_f1"} <= set(swept.columns) and swept.filter("iou_tp > 0").count() > 0
    assert cli.main(["osc", "export", f"{out}/results", "-o", f"{out}/export"], spark) == 0
    lines = [r.value for r in spark.read.text(f"{out}/export/phenology").collect()]
    assert any(x.split("\t")[1] == "/phenology/meta" for x in lines[:1]) and sum("/phenology/range/" in x for x in lines) == 9 and spark.read.text(f"{out}/export/events").count() == 24 * len(ev)


def test_calendars_of_recordings_and_of_new_ones(spark, silent, tmp_path):
    """Without results recordings are analysed; an update reads new recordings only; --reanalyze reads all again."""
    out, more = str(tmp_path / "cal"), tmp_path / "more"
    assert cli.main(["phenology", str(silent), "-o", out, "--threshold", "12"], spark) == 0
    assert spark.read.json(f"{out}/daily").count() == 2 and results.read_results(spark, f"{out}/results").count() == 3
    more.mkdir()
    for p in silent.rglob("*.WAV"):
        (more / p.name).write_bytes(p.read_bytes())
    found = wav.recordings(spark, str(more))
    known = results.read_results(spark, f"{out}/results")
    assert detection.new_recordings(wav.recordings(spark, str(silent)), known).count() == 1  # the one that cannot be read has no result
    assert detection.new_recordings(found, known).count() == found.count()
    assert cli.main(["phenology", f"{out}/results", "-o", f"{out}/again", "--update", str(more), "--threshold", "12"], spark) == 0
    after = results.read_results(spark, f"{out}/results")
    assert after.count() == 3 + found.count() and detection.new_recordings(found, after).count() == 0
    before = after.count()
    assert cli.main(["phenology", f"{out}/results", "-o", f"{out}/again", "--update", str(more)], spark) == 0 and results.read_results(spark, f"{out}/results").count() == before
    assert cli.main(["phenology", str(silent), "-o", f"{out}/redone", "--reanalyze", "--threshold", "12"], spark) == 0 and spark.read.json(f"{out}/redone/daily").count() == 2
    assert cli.main(["phenology", str(tmp_path / "cal" / "daily"), "-o", f"{out}/none"], spark) in (0, 1)


def test_workers_need_not_have_the_package(silent, tmp_path):
    """A session of its own whose workers' path lacks this repository."""
    import subprocess
    import sys
    from pathlib import Path

    code = f"""
import sys; sys.path.insert(0, {str(Path(__file__).resolve().parent.parent)!r})
from pyspark.sql import SparkSession
spark = SparkSession.builder.master("local[2]").config("spark.sql.shuffle.partitions", "2").config("spark.ui.enabled", "false").getOrCreate()
from sonoframe.plans import detection
from sonoframe.operators import matching
assert detection.detect_files(spark, {str(silent)!r}, settings=detection.Settings(factor=12.0, min_duration=0.2)).count() > 0
pairs = spark.createDataFrame([("f", 1, 1, 0.5)], "file string, det int, ref int, distance double")
assert matching.match_greedy(pairs, ["file"], "distance").count() == 1
"""
    import os

    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    run = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=300)
    assert run.returncode == 0, run.stderr[-2000:]
