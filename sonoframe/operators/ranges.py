"""Ordered work on keys of any length: numbering without a single task, and ranges of a key with the neighbours that a window needs.

A recording is a key, and may hold most of all rows. Rows are sorted into range partitions by key and order, so a long key lies in several;
numbers are counted within each and shifted by what came before. Work on a window of w rows is then dealt by (key, range of numbers), each
range with a copy of the w rows before it: groups are bounded by the range and the window, whatever the key holds.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sonoframe.session import ship, staged


def numbered(rows: DataFrame, key: str | None, order: list[str], name: str = "_i") -> DataFrame:
    """rows with their place from 0 in the order of their key (of all rows, if it is None), as a written table.

    Nulls are keys and places like any other; rows that are equal in key and order are numbered in either order.
    """
    spark = rows.sparkSession
    ship(spark)
    by = ([key] if key else []) + order
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = rows.repartitionByRange(n, *by).sortWithinPartitions(*by).withColumn("_part", F.spark_partition_id())
    place = dealt.columns.index(key) if key else None

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, done = None, 0
        for batch in batches:
            if place is None:
                yield batch.append_column("_local", pa.array(np.arange(done, done + len(batch)), pa.int64()))
                done += len(batch)
                continue
            names = batch.column(place).dictionary_encode()
            code = names.indices.fill_null(-1).to_numpy(zero_copy_only=False)
            begin = np.flatnonzero(np.concatenate([[len(code) > 0], code[1:] != code[:-1]]))
            local = np.arange(len(code)) - np.repeat(begin, np.diff(np.append(begin, len(code))))
            if len(code):
                first = None if code[0] < 0 else names.dictionary[int(code[0])].as_py()
                if done and (first,) == now:
                    local[: begin[1] if len(begin) > 1 else len(code)] += done
                now, done = (None if code[-1] < 0 else names.dictionary[int(code[-1])].as_py(),), int(local[-1]) + 1
            yield batch.append_column("_local", pa.array(local, pa.int64()))

    held = staged(dealt.mapInArrow(count, T.StructType([*dealt.schema, T.StructField("_local", T.LongType())])), "numbered")
    counts = held.groupBy(*([F.col(key).alias("_key")] if key else []), F.col("_part").alias("_of")).agg((F.max("_local") + 1).alias("_n"))
    before = F.sum("_n").over((W.partitionBy("_key") if key else W.partitionBy()).orderBy("_of").rowsBetween(W.unboundedPreceding, -1))
    # only the first key of a partition can have begun in an earlier one: a row a partition at most
    shifts = F.broadcast(counts.withColumn("_before", before).filter("_before > 0").drop("_n"))
    same = (held["_part"] == shifts["_of"]) & (held[key].eqNullSafe(shifts["_key"]) if key else F.lit(True))
    found = held.join(shifts, same, "left")
    return found.select(*[held[c] for c in rows.columns], (F.col("_local") + F.coalesce("_before", F.lit(0))).alias(name))


def in_ranges(rows: DataFrame, number: str, size: int, left: int, right: int = 0) -> DataFrame:
    """rows with _range, the range of `size` numbers they are in; copies for the ranges that need them as neighbours on either side."""
    first, last = F.floor((F.col(number) - right) / size), F.floor((F.col(number) + left) / size)
    return rows.withColumn("_range", F.explode(F.sequence(F.greatest(first, F.lit(0)), last)))


def over_ranges(rows: DataFrame, key: str, number: str, size: int, left: int, right: int, work: Callable[[pa.Table, int, int], pa.Table | None], schema) -> DataFrame:
    """work(rows of a range and its neighbours in order, first number of the range, first number after it), for every range of every key."""
    ship(rows.sparkSession)

    def run(group: pa.Table) -> pa.Table:
        group = group.sort_by(number)
        r = group["_range"][0].as_py()
        if group[number][-1].as_py() < r * size:  # only neighbours: the key ended before
            return empty
        return work(group.drop_columns(["_range"]), r * size, (r + 1) * size)

    from pyspark.sql.pandas.types import to_arrow_schema

    empty = to_arrow_schema(schema).empty_table()
    return in_ranges(rows, number, size, left, right).groupBy(key, "_range").applyInArrow(run, schema)
