"""Shortest ways that are walked level by level, many sources at once, against plain relaxation."""

from __future__ import annotations

import random

import pytest

from placeframe.operators import graph


def relaxed(rows, sources, limit):
    out = {}
    for s in sources:
        dist = {s: 0.0}
        fell = True
        while fell:
            fell = False
            for a, b, v in rows:
                for u, w in ((a, b), (b, a)):
                    if u in dist and dist[u] + v <= min(limit, dist.get(w, 1e9)) and dist[u] + v < dist.get(w, 1e9):
                        dist[w], fell = dist[u] + v, True
        out |= {(s, n): d for n, d in dist.items()}
    return out


@pytest.mark.parametrize(("unit", "pack"), [(1.0, 1 << 17), (0.25, 4), (0.1, 4)])
def test_levels_are_written_packed(spark, monkeypatch, unit, pack):
    """A dense part, a long chain and a part of small ones: a source's word goes out in few rows; other lengths as before."""
    r = random.Random(3)
    rows = [(r.randrange(60), r.randrange(60), r.randrange(1, 8) * unit) for _ in range(400)]
    rows += [(i, i + 1, 2 * unit) for i in range(1000, 1080)] + [(5000 * k, 5000 * k + 1, 3 * unit) for k in range(1, 9)]
    sources = [*range(0, 60, 2), *range(1000, 1080, 9), *range(5000, 45000, 5000), 70]
    want = relaxed(rows, sources, 40 * unit)
    monkeypatch.setattr(graph, "PACK", pack)
    monkeypatch.setattr(graph, "LEAST", 4)
    written = []
    monkeypatch.setattr(graph, "table", lambda df, name, made=graph.table: written.append((name, made(df, name))) or written[-1][1])
    links = spark.createDataFrame(rows, "a long, b long, length double")
    made = [(x.source, x.node, x.dist) for x in graph.shortest_paths(links, spark.createDataFrame([(s,) for s in sources], "node_id long"), 40 * unit).collect()]
    assert len(made) == len(want) and {(s, n): pytest.approx(d) for s, n, d in made} == want
    out = sum(t.count() for name, t in written if name == "paths")
    assert out < 40 if unit != 0.1 else out == len(want) - 1
