"""Queries that are registered over whole tables."""

from __future__ import annotations

from pathlib import Path

import pytest
from pyspark.sql import functions as F

from sonoframe.plans import registry

DATA = Path("/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not DATA.exists(), reason="no driver tables here")


def test_a_query_sends_all_messages_of_every_event(spark):
    sent = {}
    for name in (n for n in registry.QUERIES if n.endswith("event_messages")):
        rows = registry.QUERIES[name](spark, str(DATA)).groupBy("event_id").agg(F.count("*").alias("n"), F.count_distinct("addr").alias("a")).collect()
        sent[name] = (len(rows), {(r.n, r.a) for r in rows})
    assert (spark.read.parquet(f"{DATA}/events.parquet").count(), {(24, 24)}) in sent.values()
