"""The second pass of op12 takes a batch's links in pieces."""

from __future__ import annotations

import tracemalloc

import numpy as np
import pyarrow as pa

from sonoframe.llm import alignment


def test_links_are_scored_in_pieces():
    rng = np.random.default_rng(7)
    rows = [rng.integers(0, 1000, n).astype(np.int32) for n in [0, 700, 0, *rng.integers(300, 900, 8000), 400_000, 0]]
    batch = pa.record_batch({"links": pa.array([r.tobytes() for r in rows], pa.binary())})
    pair, count, best = np.arange(1000), rng.integers(1, 9, 1000), rng.random(1000) < 0.5
    got, peak = [], 0
    tracemalloc.start()
    for part, *columns in alignment.scored_links(batch, np.int32, pair, count, best):
        assert all(len(c) == len(part) for c in columns)
        got.append(np.stack(columns))
        peak = max(peak, tracemalloc.get_traced_memory()[1])
    tracemalloc.stop()
    assert np.concatenate(got, axis=1).T.tolist() == [[len(r), int(best[r].sum()), int(count[r].sum())] for r in rows]
    assert peak < 40 << 20  # at once they took 200 MB
