"""Parameter sweeps against annotations: frames are analysed once, all configurations are scored on them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sonoframe.operators import detect, matching
from sonoframe.session import staged


def sweep(frames: DataFrame, grid: DataFrame) -> DataFrame:
    """Events of every configuration: config, file, det, onset_s, offset_s.

    frames: file, frame_idx, t_s, flux, median, mad (see wav.detect_baseline). grid: config, factor, min_duration, merge_gap; a
    fixed table of some dozen rows, which is what is broadcast. Frames are numbered once, and each meets the distinct factors
    only, of which it keeps those that it exceeds; islands, which are few, meet the timings.
    """
    factors = F.broadcast(grid.select("factor").distinct())
    numbered = frames.withColumn("_i", F.row_number().over(W.partitionBy("file").orderBy("frame_idx")))
    loud = numbered.crossJoin(factors).filter(detect.above_threshold(F.col("flux"), F.col("median"), F.col("mad"), F.col("factor")))
    own = W.partitionBy("file", "factor").orderBy("_i")
    runs = loud.withColumn("_run", F.col("_i") - F.row_number().over(own)).groupBy("file", "factor", "_run")
    found = runs.agg(F.min("t_s").alias("onset_s"), F.max("t_s").alias("offset_s"), F.max("flux").alias("peak_flux"), F.avg("flux").alias("mean_flux"))
    cases = found.join(F.broadcast(grid), "factor").withColumn("run", F.struct("config", "file"))
    merged = detect.merge_gaps(cases, "run", F.col("merge_gap"))
    timed = merged.select("run.config", "run.file", "onset_s", "offset_s").join(F.broadcast(grid.select("config", "min_duration")), "config")
    kept = detect.long_enough(timed, F.col("min_duration"))
    return kept.select("config", "file", F.row_number().over(W.partitionBy("config", "file").orderBy("onset_s")).alias("det"), "onset_s", "offset_s")


def report(events: DataFrame, reference: DataFrame, grid: DataFrame, tolerance: float = 0.5, min_iou: float | None = None) -> DataFrame:
    """Micro-averaged onset scores of each configuration, best first; with min_iou also scores by overlap, in columns that begin with iou_."""
    keyed = events.withColumn("file", F.concat_ws("|", F.col("config").cast("string"), "file"))
    wanted = reference.crossJoin(F.broadcast(grid.select("config"))).withColumn("file", F.concat_ws("|", F.col("config").cast("string"), "file"))
    keyed, wanted = (staged(x.drop("config"), "scored") for x in (keyed, wanted))

    def micro(chosen: DataFrame) -> DataFrame:
        return matching.micro(matching.scores(keyed, wanted, chosen, ["file"]).withColumn("config", F.substring_index("file", "|", 1).cast("int")), ["config"])

    scored = micro(matching.match_greedy(matching.onset_pairs(keyed, wanted, tolerance), ["file"], "distance"))
    if min_iou is not None:
        overlap = micro(matching.match_overlap(keyed, wanted, min_iou, ["file"]))
        scored = scored.join(overlap.select("config", *[F.col(c).alias(f"iou_{c}") for c in overlap.columns if c != "config"]), "config", "left")
    return scored.join(grid, "config").orderBy(F.desc("f1"), "config")


def write_report(scored: DataFrame, path: str) -> None:
    """The report as JSON lines."""
    scored.coalesce(1).write.mode("overwrite").json(path)
