"""Ranges of long keys, state over micro-batches and restarts, split recordings, odd recordings and stations."""

from __future__ import annotations

import datetime as dt
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from sonoframe.functions import kernels
from sonoframe.operators import detect, matching, ranges, sites, spectrogram
from sonoframe.sources import files, wav
from sonoframe.streaming import sessions, stateful


def slow_baseline(values, width):
    own = [np.array(values[max(0, i - width + 1) : i + 1]) for i in range(len(values))]
    return [(float(np.median(o)), float(np.median(np.abs(o - np.median(o))))) for o in own]


def near(a, b):
    return len(a) == len(b) and np.allclose(np.array(a, float), np.array(b, float), rtol=1e-9, atol=1e-12)


@pytest.mark.parametrize("width", [1, 2, 3, 8, 50])
def test_sorted_window_equals_medians(width):
    rng = random.Random(width)
    for values in ([rng.randrange(6) / 2 for _ in range(120)], [rng.gauss(0, 1) for _ in range(120)], [1.0] * 30, []):
        median, mad = kernels.exact_baseline(np.array(values), width)
        assert near(list(zip(median.tolist(), mad.tolist(), strict=True)), slow_baseline(values, width))


def test_numbers_of_keys_over_many_partitions(spark):
    rows = [("a", i, i % 3) for i in range(500)] + [("b", 7, 0), (None, 3, 1), (None, 1, 1)] + [("c", i % 4, i) for i in range(9)]
    random.Random(1).shuffle(rows)
    table = spark.createDataFrame(rows, "k string, o int, _part int")
    found = ranges.numbered(table.withColumnRenamed("_part", "v"), "k", ["o"], "n")
    for key in ("a", "b", None, "c"):
        own = sorted((r.o, r.n) for r in found.collect() if r.k == key)
        assert [n for _, n in own] == list(range(len(own))) and own == sorted(own, key=lambda x: x[1])
    everything = ranges.numbered(table.select("o"), None, ["o"], "n").collect()
    assert sorted(r.n for r in everything) == list(range(len(rows))) and all(a.o <= b.o for a, b in zip(*(lambda x: (x, x[1:]))(sorted(everything, key=lambda r: r.n)), strict=False))
    assert ranges.numbered(table.limit(0).select("k", "o"), "k", ["o"]).count() == 0


def test_windows_by_ranges_equal_whole_keys(spark):
    rng = random.Random(3)
    series = {"long": [rng.gauss(0, 1) for _ in range(1500)], "short": [1.0, 5.0, 2.0], "one": [4.0]}
    table = spark.createDataFrame([(k, 10 * i, v) for k, own in series.items() for i, v in enumerate(own)], "k string, o int, v double").repartition(7)
    exact = {(r.k, r.o): (r.median, r.mad) for r in detect.exact_baseline(table, "k", "o", "v", 90, size=100).collect()}
    anchored = {(r.k, r.o): (r.median, r.mad) for r in spectrogram.baseline(table, "k", "o", "v", 90, anchors=200, warmup=50, size=64).collect()}
    for k, own in series.items():
        assert near([exact[k, 10 * i] for i in range(len(own))], slow_baseline(own, 90))
        median, mad = kernels.baseline(np.array(own), 90, 200, 50)
        assert near([anchored[k, 10 * i] for i in range(len(own))], list(zip(median.tolist(), mad.tolist(), strict=True)))
    assert len(exact) == len(anchored) == 1504


def test_indices_are_sums_of_ranges(spark):
    rng = np.random.default_rng(5)
    mags = {"a": np.abs(rng.normal(0, 0.02, (61, 33))), "b": np.abs(rng.normal(0, 0.5, (1, 33))), "c": np.zeros((5, 33))}
    rows = [(k, i, m.tolist()) for k, own in mags.items() for i, m in enumerate(own)]
    table = spark.createDataFrame(rows, "k string, o int, mag array<double>").repartition(5)
    for size in (1, 7, 1000):
        for r in spectrogram.indices(table, "k", "o", "mag", 24000.0, size=size).collect():
            want = kernels.indices(mags[r.k], np.arange(33) * 12000 / 32)
            assert [r[n] for n in want] == pytest.approx(list(want.values()), abs=2e-4)


def test_ranges_of_a_recording_equal_a_whole_read(spark, tmp_path):
    rng = np.random.default_rng(9)
    for name, rate, seconds in (("resampled", 96000, 1.3), ("plain", 16000, 2.0), ("tiny", 16000, 0.05)):
        files.put(str(tmp_path / f"{name}.wav"), wav.encode(0.1 * rng.normal(size=int(rate * seconds)), rate))
    found = wav.recordings(spark, str(tmp_path))
    frames = lambda **k: {(r.path, r.frame_idx): (r.t_s, r.flux, r.centroid, r.flatness, *sorted(r.band_energies.values())) for r in wav.frame_features(found, **k).collect()}
    whole = frames(span=1 << 20)
    assert len({p for p, _ in whole}) == 2
    for options in ({"span": 5}, {"span": 1}, {"span": 40, "block": 7}, {"content": True, "block": 9}):
        other = frames(**options)
        assert other.keys() == whole.keys() and all(other[k] == pytest.approx(v, rel=1e-9, abs=1e-12) for k, v in whole.items())
    assert wav.frame_ranges(found, 2048, 512, 48000, 5).count() > 20


@pytest.mark.parametrize(("kind", "bits"), [(6, 8), (7, 8), (1, 12), (3, 16), (2, 4), (1, 64)])
def test_other_codecs_are_error_rows(spark, tmp_path, kind, bits):
    raw = bytearray(wav.encode(np.zeros(3000), 8000))
    raw[20:22], raw[34:36] = kind.to_bytes(2, "little"), bits.to_bytes(2, "little")
    files.put(str(tmp_path / "x.wav"), bytes(raw))
    (row,) = wav.probe(wav.recordings(spark, str(tmp_path))).collect()
    assert row.error and "PCM" in row.error and row.duration_s is None
    with pytest.raises(ValueError, match="PCM"):
        wav.decode(bytes(raw))


def test_recordings_without_a_cover_keep_their_row(spark):
    at = dt.datetime(2024, 5, 1)
    recs = spark.createDataFrame([(1, "pasto", at), (2, None, at), (3, "pasto", None), (4, None, None), (5, "bosque", at)], "r int, cover_key string, at timestamp_ntz")
    stations = spark.createDataFrame([("S1", "pasto", at, 0), ("S9", None, at, 1)], "station_id string, cover_key string, sampled_at timestamp_ntz, file_ord int")
    found = {r.r: r.station_id for r in sites.nearest_station(recs, stations).collect()}
    assert found == {1: "S1", 2: None, 3: "S1", 4: None, 5: None}


def in_parts(spark, rows, schema, path, cuts):
    """rows as a stream of files, and a function that adds more."""
    frame = spark.createDataFrame(rows, schema)

    def add(own):
        spark.createDataFrame(own, schema).coalesce(1).write.mode("append").parquet(str(path))

    for a, b in zip([0, *cuts], [*cuts, len(rows)], strict=True):
        add(rows[a:b])
    return spark.readStream.schema(frame.schema).option("maxFilesPerTrigger", 1).parquet(str(path)), add


def test_state_does_not_depend_on_the_cut(spark, tmp_path):
    """Rows out of order across batches, within the lateness: however the stream is cut, and equal to a fold over sorted rows."""
    rng, start = random.Random(8), dt.datetime(2024, 1, 1)
    rows = sorted([(k, start + dt.timedelta(seconds=rng.uniform(0, 600)), round(rng.gauss(0, 1), 3)) for k in "ab" for _ in range(40)], key=lambda r: r[1] + dt.timedelta(seconds=rng.uniform(0, 20)))
    rows += [("z", start + dt.timedelta(seconds=3000), 0.0)]
    results = []
    for i, cuts in enumerate(([], [9, 20, 33, 50, 61, 80], list(range(5, 80, 12)))):
        stream, _ = in_parts(spark, rows, "k string, ts timestamp, v double", tmp_path / f"in{i}", cuts)
        collect = lambda df, name: sorted(tuple(r) for r in sessions.drained(df, name).collect())
        results.append((collect(stateful.thin(stream, "k", "ts", 30.0, "60 seconds"), "thin"), collect(stateful.running_baseline(stream, "k", "ts", "v", 60.0, "60 seconds"), "base"), collect(stateful.merged_events(stream, "k", "ts", "v", 12.0, "60 seconds"), "merged")))
    assert results[0] == results[1] == results[2]
    thin, base, merged = results[0]
    for k in "ab":
        own = sorted((r[1].timestamp(), r[2]) for r in rows if r[0] == k)
        kept, last = [], None
        for t, _ in own:
            if last is None or t - last >= 30:
                kept.append(t)
                last = t
        assert [t for key, t in thin if key == k] == pytest.approx(kept)
        for (_, t, v, m, d), (at, value) in zip([r for r in base if r[0] == k], own, strict=True):
            held = np.array([x for s, x in own if at - 60 < s <= at])
            assert (t, v) == pytest.approx((at, value)) and (m, d) == pytest.approx((np.median(held), np.median(np.abs(held - np.median(held)))))
        assert sum(r[5] for r in merged if r[0] == k) == 40 and all(b[1] - a[2] > 12 for a, b in zip(*(lambda x: (x, x[1:]))([r for r in merged if r[0] == k]), strict=False))


def test_a_stream_goes_on_from_its_checkpoint(spark, tmp_path):
    start = dt.datetime(2024, 1, 1)
    rows = [("c", start + dt.timedelta(seconds=60 * i), verb, arg) for i, (verb, arg) in enumerate([("next", None), ("next", None), ("day", "99"), ("next", None), ("prev", None), ("day", "x"), ("date", "2024-03-02"), ("date", "1999-01-01"), ("meta", None), ("what", None), ("prev", None), ("prev", None)])]
    calendar = ranges.numbered(spark.createDataFrame([(dt.date(2024, 3, d),) for d in range(1, 6)], "day date"), None, ["day"])
    stream, add = in_parts(spark, rows[:5], "client string, ts timestamp, verb string, arg string", tmp_path / "in", [2])
    path = str(tmp_path / "out")
    asked = lambda: stateful.replies(stream, "client", "ts", "verb", "arg", calendar, "10 seconds")
    first = sessions.drained(asked(), "replies", path=path).count()
    assert first == 4  # the last waits for the watermark
    add(rows[5:])
    add([("other", start + dt.timedelta(hours=9), "meta", None)])
    found = sorted((r.at, r.verb, r.frame) for r in sessions.drained(asked(), "replies", path=path).collect() if r.client == "c")
    assert [(v, f) for _, v, f in found] == [("next", 1), ("next", 2), ("day", 4), ("next", 0), ("prev", 4), ("date", 1), ("meta", None), ("prev", 0), ("prev", 4)]
    assert stateful.replies(stream, "client", "ts", "verb", "arg", calendar.limit(0), "10 seconds").isStreaming


def test_rounds_equal_the_greedy_order(spark):
    rng = random.Random(4)
    rows = [(f, d, r, rng.randrange(6) / 2) for f in "abc" for d in range(12) for r in range(9) if rng.random() < 0.4]
    rows += [("chain", i // 2, (i + 1) // 2, 50.0 - i) for i in range(12)]
    table = spark.createDataFrame(rows, "file string, det long, ref long, cost double").repartition(5)
    found = sorted(tuple(r) for r in matching.match_greedy(table, ["file"], "cost").collect())
    want = []
    for f in sorted({r[0] for r in rows}):
        dets, refs = set(), set()
        for _, d, r in sorted((c, d, r) for g, d, r, c in rows if g == f):
            if d not in dets and r not in refs:
                dets.add(d)
                refs.add(r)
                want.append((f, d, r))
    assert found == sorted(want) and matching.match_greedy(table.limit(0), ["file"], "cost").count() == 0
