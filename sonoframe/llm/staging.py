"""Shared-folder tables and small helpers that every operator uses."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sonoframe.session import mark, new_path, release, shared_dir, ship, staged  # noqa: F401


def partitions(spark: SparkSession) -> int:
    """How many partitions the session deals shuffles into: the cluster's own measure of its data."""
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


def writers(spark: SparkSession) -> int:
    """How many tasks write a table of thin rows, a few longs each: such a task takes those of several partitions."""
    return max(spark.sparkContext.defaultParallelism, partitions(spark) // 8)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def free(taken: list[str], name: str) -> str:
    """name, with underscores in front until no column has it."""
    have = {c.lower() for c in taken}
    while name.lower() in have:
        name = f"_{name}"
    return name


def apart(docs: DataFrame, used: list[str], results: list[str], work: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """work(docs) with all columns but the used ones under names that nothing inside has, restored in the result.

    So a column of the input may have any name that an operator uses within; those named like a result are replaced by it.
    """
    gone = {c.lower() for c in results}
    kept = [c for c in docs.columns if c.lower() not in gone]
    inside = {c: f"input column {i}" for i, c in enumerate(kept) if c not in used}
    out = work(docs.select(*[F.col(f"`{c}`").alias(inside.get(c, c)) for c in kept], *[F.col(f"`{c}`") for c in docs.columns if c in used and c not in kept]))
    return out.select(*[F.col(f"`{inside.get(c, c)}`").alias(c) for c in kept], *[F.col(f"`{c}`") for c in results])
