"""Doubles as text with fixed digits, as printf writes them."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from sonoframe.functions import text
from sonoframe.operators import timeline


@pytest.mark.parametrize("digits", [1, 3, 4])
def test_fixed_equals_printf(spark, digits):
    rng = random.Random(digits)
    unit = 10**digits
    ties = [(rng.randrange(10**k) + 0.5) / unit for k in range(1, 10) for _ in range(40)]
    exact = [rng.randrange(10**k) + n / 32 for k in range(1, 9) for n in range(32)]
    values = [v * sign for v in [*ties, *exact, *(rng.uniform(0, 9e4) for _ in range(200)), 0.0, 1e-9, 1e15 + 0.5, 2.0**53, 0.42505] for sign in (1, -1)]
    got = spark.createDataFrame(list(enumerate(values)), "i int, x double").select("i", text.fixed(F.col("x"), digits).alias("t")).collect()
    assert [(v, t) for (i, t), v in zip(sorted(got), values, strict=True)] == [(v, f"{v:.{digits}f}") for v in values]


def test_names_of_clips_round_as_printf(spark):
    row = spark.sql("SELECT 'biophony' d, 'click' r, 7L i, 0.25D a, 16.15D b").select(text.clip_path(F.col("d"), F.col("r"), F.col("i"), F.col("a"), F.col("b"))).first()
    assert row[0] == f"clips/biophony/click/event_007_click_{0.25:.1f}s-{16.15:.1f}s.wav"


def test_day_messages_round_as_printf(spark):
    assert spark.range(1).select(timeline.number(F.lit(0.42505)), timeline.number(F.lit(0.03125))).first() == ("0.4250", "0.0312")
