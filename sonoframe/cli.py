"""Commands: detect, phenology, osc, gallery, metadata, validate, doctor."""

from __future__ import annotations

import argparse
import json
import sys
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sonoframe.functions.bands import DOMAIN_OF, PRESETS, preset
from sonoframe.operators import matching, metadata, series, sites, timeline
from sonoframe.plans import detection, validation
from sonoframe.session import staged
from sonoframe.sources import annotations, results, wav

MODES = ("events", "phenology", "score", "export", "map")
COMMANDS = ("detect", "phenology", "osc", "gallery", "metadata", "validate", "doctor")


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="sonoframe", description=__doc__)
    sub = p.add_subparsers(dest="command", required=True)
    d = sub.add_parser("detect", help="events of WAV files, their clips, results and messages")
    d.add_argument("inputs", nargs="+")
    d.add_argument("-o", "--output", "--output-dir", default="output")
    d.add_argument("--sensitivity", choices=sorted(PRESETS), default="balanced")
    for names in (("--threshold",), ("--min-duration", "--min-event-duration"), ("--merge-gap",), ("--min-confidence",)):
        d.add_argument(*names, type=float)
    for name, default in (("--baseline-window", 60.0), ("--pre-roll", 20.0), ("--post-roll", 10.0), ("--max-clip-duration", 300.0), ("--clip-duration", 0.0), ("--clip-pre", 30.0), ("--min-separation", 0.0), ("--days-per-second", 1.0)):
        d.add_argument(name, type=float, default=default)
    for name in ("--ultrasonic", "--json-only", "--phenology", "--no-csv", "--no-osc"):
        d.add_argument(name, action="store_true")
    d.add_argument("--organize-by", choices=("role", "domain", "flat"), default="role")
    d.add_argument("--roles", default="")
    d.add_argument("--domains", default="")
    d.add_argument("--stations", default="", help="KML of the stations; looked for beside and above the first input if not given")
    g = sub.add_parser("gallery", help="events with clips, and their groups")
    g.add_argument("directory")
    g.add_argument("-o", "--output", default="gallery")
    c = sub.add_parser("phenology", help="calendar of stored results, or of recordings that are analysed first")
    c.add_argument("directory")
    c.add_argument("-o", "--output", "--output-dir", default="phenology")
    c.add_argument("--reanalyze", action="store_true", help="analyse recordings even if there are results of them")
    c.add_argument("--update", default="", help="folder of recordings: those without a stored result are analysed, their results join the others")
    c.add_argument("--threshold", type=float, default=2.5)
    c.add_argument("--days-per-second", type=float, default=1.0)
    c.add_argument("--no-csv", action="store_true")
    c.add_argument("--no-osc", action="store_true")
    o = sub.add_parser("osc", help="timed messages of stored results")
    o.add_argument("directory")
    o.add_argument("-o", "--output", default="osc")
    o.add_argument("--mode", choices=MODES, default="events", help="may also stand as a word before the directory")
    o.add_argument("--days-per-second", type=float, default=1.0)
    m = sub.add_parser("metadata", help="a row for each WAV file, and a summary")
    m.add_argument("directory")
    m.add_argument("-o", "--output", default="metadata")
    m.add_argument("--text", default="")
    m.add_argument("--place", default="")
    v = sub.add_parser("validate", help="scores against annotations")
    v.add_argument("audio")
    v.add_argument("tables")
    v.add_argument("--tolerance", "--onset-tolerance", type=float, default=0.5)
    v.add_argument("--min-iou", type=float, default=0.2, help="overlap that a match by intersection over union needs")
    v.add_argument("--limit", type=int, default=0)
    v.add_argument("--sweep", action="store_true", help="all thresholds with all timings")
    v.add_argument("-o", "--output", default="")
    sub.add_parser("doctor", help="what is installed")
    return p


def settings_of(args: argparse.Namespace) -> detection.Settings:
    """Explicit flags before presets before defaults; ultrasonic timing only where no timing was given."""
    factor, least, gap = preset(args.sensitivity, threshold=args.threshold, min_duration=args.min_duration, merge_gap=args.merge_gap)
    names = lambda text: tuple(x.strip() for x in text.split(",") if x.strip())
    more = {
        "factor": factor, "roles": names(args.roles), "domains": names(args.domains), "min_confidence": args.min_confidence or 0.0, "baseline_s": args.baseline_window, "pre_roll": args.pre_roll, "post_roll": args.post_roll,
        "longest_clip": args.max_clip_duration, "fixed_clip": args.clip_duration, "fixed_pre": args.clip_pre, "min_separation": args.min_separation,
    }
    if args.ultrasonic:
        return detection.ultrasonic((least, gap) if args.min_duration is not None or args.merge_gap is not None else None, **more)
    return detection.Settings(min_duration=least, merge_gap=gap, **more)


def _json(rows: DataFrame, path: str) -> None:
    rows.select(F.to_json(F.struct("*")).alias("value")).write.mode("overwrite").text(path)


def _write_calendar(tables: dict[str, DataFrame], output: str, rate: float, csv: bool, osc: bool) -> None:
    for name, rows in tables.items():
        rows.write.mode("overwrite").json(f"{output}/{name}")
    if csv:
        results.write_csv(tables["frames"] if "frames" in tables else tables["daily"], f"{output}/daily_csv")
    if osc and "frames" in tables:
        results.write_lines(timeline.bundle_lines(timeline.season_messages(tables["frames"], tables["shifts"], tables["diel_table"], tables["dawn"], rate)), f"{output}/messages")


def _stored(spark: SparkSession, args: argparse.Namespace) -> DataFrame | None:
    """Results below the directory with, if asked for, those of recordings that have none yet; None if there is neither.

    Without results (or with --reanalyze) recordings below the directory are analysed, as measured data only, and their results written below the output.
    """
    analyse, update = getattr(args, "reanalyze", False), getattr(args, "update", "")
    read = None if analyse else results.read_results(spark, args.directory)
    if read is not None and not read.isEmpty():
        if update:
            made, found = detection.analyse(spark, update, settings=detection.Settings(factor=args.threshold), known=read)
            results.write_results(detection.results(found, made), args.directory, add=True)
            read = results.read_results(spark, args.directory)
        return read
    if args.command != "phenology" or wav.recordings(spark, args.directory).isEmpty():
        return None
    made, found = detection.analyse(spark, args.directory, settings=detection.Settings(factor=args.threshold))
    results.write_results(detection.results(found, made), f"{args.output}/results", folders=True)
    return results.read_results(spark, f"{args.output}/results")


def _detect(spark: SparkSession, args: argparse.Namespace) -> None:
    s = settings_of(args)
    table = args.stations or results.find_first(args.inputs[0], results.STATION_TABLES, 8) if "://" not in args.inputs[0] else args.stations
    stations = sites.placemarks(spark.read.text(table, wholetext=True)) if table else None
    made, found = detection.analyse(spark, *args.inputs, settings=s, stations=stations)
    if not args.json_only:
        found = detection.export(detection.measured(found), args.output, args.organize_by, s)
    results.write_results(detection.results(found, made), f"{args.output}/results", folders=True)
    if not args.no_osc and not args.json_only:
        results.write_lines(timeline.bundle_lines(timeline.event_messages(found.withColumn("event_id", F.col("event_index"))).orderBy("at", "event_id", "seq")), f"{args.output}/messages")
    if args.phenology:
        _write_calendar(detection.calendar_of(found, made), f"{args.output}/phenology", args.days_per_second, not args.no_csv, not args.no_osc)


def _validate(spark: SparkSession, args: argparse.Namespace) -> None:
    stem = F.regexp_extract("path", "([^/]+?)\\.[^./]+$", 1).alias("file")
    ref = annotations.intervals(spark, args.tables)
    files = wav.recordings(spark, args.audio).select("path", stem)
    if args.limit:
        files = files.join(annotations.stride_sample(files.join(ref, "file", "left_semi").select("file"), "file", args.limit), "file", "left_semi")
    files = files.join(wav.probe(files).filter("error IS NULL").select("path"), "path", "left_semi")
    ref = ref.join(files.select("file").distinct(), "file", "left_semi")
    base = wav.detect_baseline(wav.frame_features(files)).select(stem, "frame_idx", "t_s", "flux", "median", "mad")
    defaults = PRESETS["balanced"]
    grid = matching.grid(spark) if args.sweep else matching.grid(spark, (defaults[0],), (defaults[1:],))
    scored = validation.report(staged(validation.sweep(base, grid), "sweep"), ref, grid, args.tolerance, args.min_iou)
    scored = scored.withColumn("label", matching.config_label(F.col("factor"), F.col("min_duration"), F.col("merge_gap"))).orderBy(F.desc("f1"), "config")
    matching.reference_lengths(ref.withColumn("all", F.lit("all")), ["all"]).show()
    if args.output:
        validation.write_report(scored, args.output)
    scored.select("label", "tp", "fp", "fn", "precision", "recall", "f1", "iou_f1").show(12, truncate=False)


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    argv = sys.argv[1:] if argv is None else argv
    if len(argv) > 1 and argv[0] == "osc" and argv[1] in MODES:  # the mode as a word
        argv = ["osc", *(argv[2:] or ["."]), "--mode", argv[1]]
    args = parser().parse_args(["detect", *argv] if argv and argv[0] not in (*COMMANDS, "-h", "--help") else argv)  # a bare path means detect
    if args.command == "doctor":
        import numpy
        import pyarrow
        import pyspark

        print(f"pyspark {pyspark.__version__}, numpy {numpy.__version__}, pyarrow {pyarrow.__version__}")
        return 0
    if args.command == "detect" and (unknown := [r for r in args.roles.split(",") if r.strip() and r.strip().lower() not in DOMAIN_OF]):
        print(f"unknown roles: {', '.join(unknown)}", file=sys.stderr)
        return 2
    if args.command == "osc" and args.mode == "map":
        print(json.dumps(timeline.address_map(), indent=1))
        return 0
    if "directory" in args and not Path(args.directory).exists() and "://" not in args.directory:
        print(f"{args.directory} does not exist", file=sys.stderr)
        return 1
    spark = spark or SparkSession.builder.appName("sonoframe").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    if args.command == "detect":
        _detect(spark, args)
    elif args.command == "validate":
        _validate(spark, args)
    elif args.command == "metadata":
        rows = metadata.of_probes(wav.probe(wav.recordings(spark, args.directory)))
        _json(metadata.table_filter(rows, args.text, args.place), f"{args.output}/files")
        _json(metadata.summary(rows.withColumn("all", F.lit("all")), ["all"], F.col("error").isNotNull(), F.col("duration_s"), "location"), f"{args.output}/summary")
        read = annotations.chart_rows(rows)
        _json(metadata.per_hour(read.withColumn("hour_of", F.hour("recorded_at")), "hour_of"), f"{args.output}/hours")
        _json(metadata.by_place(read, "location", "temperature_c"), f"{args.output}/temperatures")
    else:
        made = _stored(spark, args)
        if made is None:
            print(f"no results and no recordings in {args.directory}", file=sys.stderr)
            return 1
        made = made.withColumn("path", F.coalesce("filepath", "filename"))
        stored = results.events_of(made)
        if args.command == "gallery":
            shown = results.gallery(stored, args.directory)
            _json(shown, f"{args.output}/items")
            for name in ("role", "domain"):
                _json(series.by_count(shown, name, ["filename", "event_index"]), f"{args.output}/{name}s")
        elif args.command == "osc" and args.mode in ("events", "score"):
            messages = timeline.event_messages(stored.withColumn("event_id", F.col("event_index"))).orderBy("at", "event_id", "seq")
            results.write_lines((timeline.score_lines if args.mode == "score" else timeline.bundle_lines)(messages), args.output)
        else:
            tables = detection.calendar_of(stored, made)
            if args.command == "osc":
                season = timeline.season_messages(tables["frames"], tables["shifts"], tables["diel_table"], tables["dawn"], args.days_per_second)
                results.write_lines(timeline.bundle_lines(season), f"{args.output}/phenology" if args.mode == "export" else args.output)
                if args.mode == "export":
                    messages = timeline.event_messages(stored.withColumn("event_id", F.col("event_index"))).orderBy("at", "event_id", "seq")
                    results.write_lines(timeline.bundle_lines(messages), f"{args.output}/events")
            else:
                _write_calendar(tables, args.output, args.days_per_second, not args.no_csv, not args.no_osc)
    return 0


if __name__ == "__main__":
    sys.exit(main())
