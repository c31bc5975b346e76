"""How many tables components() writes: a graph of stars needs no round, others no round to see that nothing changed."""

from __future__ import annotations

from sonoframe.llm import components


def test_rounds_end_with_the_stars(spark, monkeypatch):
    wrote = []
    staged = components.staged
    monkeypatch.setattr(components, "staged", lambda df, name: (wrote.append(name), staged(df, name))[1])

    def found(edges):
        wrote.clear()
        return {r.v: r.c for r in components.components(spark.createDataFrame(edges, "a long, b long")).collect()}

    assert found([(1, 2), (3, 1), (7, 5), (5, 5), (2, 1)]) == {1: 1, 2: 1, 3: 1, 5: 5, 7: 5}
    assert wrote == ["edges", "edges-least"]
    assert found([(9, k) for k in range(9)]) == dict.fromkeys(range(10), 0)  # the centre is the largest: one round
    assert wrote == ["edges", "edges-least", "edges", "edges-least"]
    path = [(k, k + 1) for k in range(40)] + [(100, 99), (98, 99)]
    assert found(path) == dict.fromkeys(range(41), 0) | dict.fromkeys((98, 99, 100), 98)
