"""Events from a stream of threshold crossings by built-in windows: sessions by gap, tumbling counts; and draining a stream into a table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sonoframe.session import new_path


def sessions(crossings: DataFrame, key: str, time: str, value: str, gap: str, late: str) -> DataFrame:
    """Merged events of a stream: bounds, peak and number of crossings; rows later than `late` are left out."""
    at = crossings.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, late)
    merged = at.groupBy(key, F.session_window(time, gap).alias("w")).agg(F.max(value).alias("peak"), F.count("*").alias("n"), F.min(time).alias("onset"), F.max(time).alias("last"))
    return merged.select(key, "onset", "last", "peak", "n")


def daily_counts(events: DataFrame, time: str, kind: str, late: str) -> DataFrame:
    """Events of each day and kind as days close."""
    at = events.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, late)
    return at.groupBy(F.window(time, "1 day").alias("w"), kind).agg(F.count("*").alias("n")).select(F.col("w.start").alias("day"), kind, "n")


#: the state store that operators of stateful need
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def drained(stream: DataFrame, name: str, mode: str = "append", path: str | None = None) -> DataFrame:
    """All that a stream has now, in as many batches as it takes, as a written table in the shared folder.

    With the path of an earlier call it goes on where that call stopped, with the state that it left.
    """
    spark = stream.sparkSession
    path = path or new_path(spark, name)
    setting = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(setting, None)
    spark.conf.set(setting, ROCKS)
    try:
        query = stream.writeStream.format("parquet").outputMode(mode).option("checkpointLocation", f"{path}-progress").trigger(availableNow=True).start(path)
        query.awaitTermination()
    finally:
        spark.conf.set(setting, before) if before else spark.conf.unset(setting)
    return spark.read.schema(stream.schema).parquet(path)
