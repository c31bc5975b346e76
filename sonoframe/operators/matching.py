"""Scoring detections against annotations: band joins, greedy one-to-one matching in rounds, time rasters, micro averages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sonoframe.session import staged


def onset_pairs(found: DataFrame, reference: DataFrame, tolerance: float) -> DataFrame:
    """Pairs of one file whose onsets are at most `tolerance` apart. found: file, det, onset_s; reference: file, ref, ref_onset_s.

    A reference is put into the buckets of width tolerance beside its own, so the band is an equi join on (file, bucket).
    """
    bucket = lambda c: F.floor(F.col(c) / tolerance)
    near = reference.withColumn("_b", F.explode(F.sequence(bucket("ref_onset_s") - 1, bucket("ref_onset_s") + 1)))
    joined = found.withColumn("_b", bucket("onset_s")).join(near, ["file", "_b"]).drop("_b")
    return joined.withColumn("distance", F.abs(F.col("onset_s") - F.col("ref_onset_s"))).filter(F.col("distance") <= tolerance)


def iou(a0: Column, a1: Column, b0: Column, b1: Column) -> Column:
    """Intersection over union of two intervals; 0 without a union."""
    both = F.greatest(F.lit(0.0), F.least(a1, b1) - F.greatest(a0, b0))
    union = (a1 - a0) + (b1 - b0) - both
    return F.when(union > 0, both / union).otherwise(0.0)


def overlap_pairs(found: DataFrame, reference: DataFrame, least: float = 0.2, width: float = 60.0) -> DataFrame:
    """Pairs of one file with an intersection over union of `least` or more: an equi join on the time cells both touch."""
    cells = lambda a, b: F.explode(F.sequence(F.floor(F.col(a) / width), F.floor(F.greatest(F.col(a), F.col(b)) / width)))
    left, right = found.withColumn("_c", cells("onset_s", "offset_s")), reference.withColumn("_c", cells("ref_onset_s", "ref_offset_s"))
    joined = left.join(right, ["file", "_c"])
    first = F.floor(F.greatest(F.col("onset_s"), F.col("ref_onset_s")) / width) == F.col("_c")  # in one shared cell only
    return joined.filter(first).drop("_c").withColumn("iou", iou(F.col("onset_s"), F.col("offset_s"), F.col("ref_onset_s"), F.col("ref_offset_s"))).filter(F.col("iou") >= least)


def match_greedy(pairs: DataFrame, keys: list[str], cost: str) -> DataFrame:
    """One-to-one pairs of each key, cheapest first, ties by det then ref. pairs: keys, det, ref, cost.

    Rounds over all keys at once: a pair that is the best of both its sides is one that the greedy order would take, whatever comes before it, so all of
    them are taken and the pairs of their sides go. A round is a written table, so a file is no group and may hold most pairs; rounds are as many as the
    longest chain of pairs in which each is cheaper than the one before, mostly a handful.
    """
    order = F.struct(cost, "det", "ref")
    by_det, by_ref = W.partitionBy(*keys, "det"), W.partitionBy(*keys, "ref")
    left = pairs.select(*keys, "det", "ref", cost)
    out = None
    while True:
        seen = left.withColumn("_best", F.min(order).over(by_det)).withColumn("_taken", (F.col("_best") == order) & (F.min(order).over(by_ref) == order))
        seen = staged(seen.withColumn("_gone", F.max("_taken").over(by_ref)).withColumn("_gone", F.col("_gone") | F.max("_taken").over(by_det)).drop("_best"), "matching")
        found = seen.filter("_taken").select(*keys, "det", "ref")
        out = found if out is None else out.unionByName(found)
        left = seen.filter("NOT _gone").drop("_taken", "_gone")
        if left.isEmpty():
            return out


def match_overlap(found: DataFrame, reference: DataFrame, least: float, keys: list[str], width: float = 60.0) -> DataFrame:
    """One-to-one pairs by intersection over union, largest first, of `least` or more."""
    return match_greedy(overlap_pairs(found, reference, least, width).withColumn("_cost", -F.col("iou")), keys, "_cost")


def scores(found: DataFrame, reference: DataFrame, matches: DataFrame, keys: list[str]) -> DataFrame:
    """tp, fp and fn of each key."""
    counted = found.groupBy(*keys).agg(F.count("*").alias("_d")).join(reference.groupBy(*keys).agg(F.count("*").alias("_r")), keys, "full").join(matches.groupBy(*keys).agg(F.count("*").alias("tp")), keys, "left")
    n = lambda c: F.coalesce(c, F.lit(0))
    return counted.select(*keys, n("tp").alias("tp"), (n("_d") - n("tp")).alias("fp"), (n("_r") - n("tp")).alias("fn"))


def micro(scored: DataFrame, keys: list[str]) -> DataFrame:
    """Precision, recall and F1 of summed counts; 0 where undefined."""
    sums = scored.groupBy(*keys).agg(*[F.sum(c).alias(c) for c in ("tp", "fp", "fn")])
    p, r = F.coalesce(F.try_divide("tp", F.col("tp") + F.col("fp")), F.lit(0.0)), F.coalesce(F.try_divide("tp", F.col("tp") + F.col("fn")), F.lit(0.0))
    return sums.withColumns({"precision": F.round(p, 4), "recall": F.round(r, 4), "f1": F.round(F.coalesce(F.try_divide(2 * p * r, p + r), F.lit(0.0)), 4)})


def time_level(found: DataFrame, reference: DataFrame, rate: int = 100) -> DataFrame:
    """Precision, recall and ticks covered, at `rate` ticks a second. found: file, onset_s, offset_s, duration_s.

    A sweep over interval ends: between two ends nothing changes, so ticks are counted by differences and not made.
    """

    def ends(df: DataFrame, start: str, stop: str, side: int) -> DataFrame:
        a, b = F.floor(F.col(start) * rate), F.floor(F.least(F.col(stop), F.col("duration_s")) * rate)
        step = lambda at, by: F.struct(at.alias("tick"), F.lit(by * (1 - side)).alias("d"), F.lit(by * side).alias("r"))
        return df.filter(b > a).select("file", F.explode(F.array(step(F.greatest(a, F.lit(0)), 1), step(b, -1))).alias("_e")).select("file", "_e.*")

    steps = ends(found, "onset_s", "offset_s", 0).union(ends(reference, "ref_onset_s", "ref_offset_s", 1)).groupBy("file", "tick").agg(F.sum("d").alias("d"), F.sum("r").alias("r"))
    in_time = W.partitionBy("file").orderBy("tick")
    spans = steps.select("file", F.sum("d").over(in_time).alias("d"), F.sum("r").over(in_time).alias("r"), (F.lead("tick").over(in_time) - F.col("tick")).alias("n"))
    ticks = lambda c: F.coalesce(F.sum(F.when(c, F.col("n"))), F.lit(0))
    both = spans.groupBy("file").agg(ticks((F.col("d") > 0) & (F.col("r") > 0)).alias("both"), ticks(F.col("d") > 0).alias("n_det"), ticks(F.col("r") > 0).alias("n_ref"))
    share = lambda c: F.round(F.col("both") / F.greatest(F.col(c), F.lit(1)), 4)
    return both.select("file", share("n_det").alias("precision"), share("n_ref").alias("recall"), "n_det", "n_ref")


def first_label(found: DataFrame, reference: DataFrame, tolerance: float) -> DataFrame:
    """Detections that have a reference within tolerance, with the label of the earliest such reference: not one-to-one."""
    pairs = onset_pairs(found, reference, tolerance)
    return pairs.groupBy("file", "det").agg(F.min_by("label", F.struct("ref_onset_s", "ref")).alias("label"))


def confusion(matched: DataFrame, kinds: tuple[str, ...] = ("role", "domain", "dominant_band")) -> DataFrame:
    """(kind, value, n): how often matched events were given each role, domain and band, the most frequent first."""
    one = matched.select(F.explode(F.array(*[F.struct(F.lit(k).alias("kind"), F.col(k).alias("value")) for k in kinds])).alias("_x")).select("_x.*")
    return one.groupBy("kind", "value").agg(F.count("*").alias("n")).orderBy("kind", F.desc("n"), "value")


def accuracy(matched: DataFrame, keys: list[str], domain: str, role: str | None = None) -> DataFrame:
    """Matched events of each key, and which share has the expected domain and role; null without events or expectation."""
    share = lambda c, want: F.round(F.try_divide(F.count_if(F.col(c) == want), F.count("*")), 4) if want else F.lit(None).cast("double")
    return matched.groupBy(*keys).agg(F.count("*").alias("n"), share("domain", domain).alias("domain_accuracy"), share("role", role).alias("role_accuracy"))


def reference_lengths(reference: DataFrame, keys: list[str], short: float = 2.0) -> DataFrame:
    """Number, median length and share of short ones among the annotations."""
    long = F.col("ref_offset_s") - F.col("ref_onset_s")
    return reference.groupBy(*keys).agg(F.count("*").alias("n"), F.round(F.median(long), 4).alias("median_s"), F.round(F.avg((long < short).cast("double")), 6).alias("short_fraction"))


def config_label(factor: Column, least: Column, gap: Column) -> Column:
    """A configuration in words, numbers without superfluous zeros."""
    short = lambda c: F.regexp_replace(c.cast("string"), r"\.0$", "")
    return F.concat(F.lit("k="), short(factor), F.lit(" min="), short(least), F.lit("s merge="), short(gap), F.lit("s"))


def grid(spark, factors: tuple = (1.5, 2.5, 3.0, 4.0, 6.0, 8.0), timings: tuple = ((2.0, 5.0), (1.0, 3.0), (0.5, 1.0), (0.3, 0.5), (0.25, 0.25))) -> DataFrame:
    """Every factor with every (shortest event, merge gap): a fixed small table."""
    rows = [(i * len(timings) + j, float(f), float(a), float(b)) for i, f in enumerate(factors) for j, (a, b) in enumerate(timings)]
    return spark.createDataFrame(rows, "config int, factor double, min_duration double, merge_gap double")
