"""Graph queries over all ways of a small table, against brute force."""

from __future__ import annotations

import math
import random

import pytest

from placeframe.operators import graph
from placeframe.plans import catalog

LINE = "l_orderkey long, l_linenumber long, l_partkey long, l_suppkey long, l_quantity double, l_extendedprice double, l_shipdate string"


@pytest.fixture(scope="module")
def ways():
    r = random.Random(11)
    return {w: [r.choice((r.randrange(40), r.randrange(100, 140))) for _ in range(r.randrange(1, 5))] for w in range(1, 31)} | {50: [200, 201], 51: [201, 202]}


@pytest.fixture(scope="module")
def folder(spark, ways, tmp_path_factory):
    out = str(tmp_path_factory.mktemp("ways"))
    rows = [(w, i, n, 0, 1.0, 1.0, "") for w, nodes in ways.items() for i, n in enumerate(nodes)]
    spark.createDataFrame(rows, LINE).write.parquet(f"{out}/lineitem.parquet")
    return out


@pytest.fixture(scope="module")
def links(ways):
    return {(min(a, b), max(a, b)): 1.0 + (a + b) % 7 for nodes in ways.values() for a, b in zip(nodes, nodes[1:], strict=False) if a != b}


def neighbours(links):
    out: dict[int, set[int]] = {}
    for a, b in links:
        out.setdefault(a, set()).add(b)
        out.setdefault(b, set()).add(a)
    return out


def place(n):
    return 68 + n * 7919 % 30000 / 1000, 6 + n * 10473 % 31500 / 1000


def test_components_of_all_ways(spark, folder, links):
    root = {n: n for n in neighbours(links)}
    for _ in root:
        for a, b in links:
            root[a] = root[b] = min(root[a], root[b])
    want = {}
    for c in set(root.values()):
        own = [n for n in root if root[n] == c]
        centre = [sum(place(n)[i] for n in own) / len(own) for i in (0, 1)]
        want[c] = (len(own), sum(v for (a, _), v in links.items() if root[a] == c), *(pytest.approx(v, abs=1e-5) for v in centre))
    made = {r.component: (r.nodes, r.length, r.lon, r.lat) for r in catalog.QUERIES["r3_network_components"](spark, folder).collect()}
    assert made == want


def test_dead_ends_of_all_ways(spark, folder, links):
    made = [r.node_id for r in catalog.QUERIES["r5_network_dead_ends"](spark, folder).collect()]
    assert sorted(made) == sorted(n for n, others in neighbours(links).items() if len(others) == 1)


def test_gap_edges(spark, links):
    near = neighbours(links)
    nodes = {n: (math.sin(n) * 3, math.cos(n * 7) * 3) for n in near}
    want = {}
    for n in (n for n in near if len(near[n]) == 1):
        apart = [(math.dist(nodes[n], nodes[m]), m) for m in nodes if m != n and m not in near[n]]
        if apart and min(apart)[0] <= 0.6:
            want[n] = min(apart)[1]
    links_df = spark.createDataFrame([(a, b, v) for (a, b), v in links.items()], "a long, b long, length double")
    nodes_df = spark.createDataFrame([(n, *xy) for n, xy in nodes.items()], "node_id long, lon double, lat double")
    assert {r.node_id: r.other for r in graph.gaps(links_df, nodes_df, 0.6).collect()} == want
    assert want


def test_paths_over_all_ways(spark, folder, links):
    near, want = neighbours(links), {}
    for s in (n for n in near if n % 20 == 0):
        dist = {s: 0.0}
        for _ in near:
            for (a, b), v in links.items():
                for u, w in ((a, b), (b, a)):
                    if u in dist and dist[u] + v <= min(14.0, dist.get(w, 99.0)):
                        dist[w] = dist[u] + v
        want |= {(s, n): d for n, d in dist.items()}
    made = {(r.source, r.node): r.dist for r in catalog.QUERIES["r6_network_paths"](spark, folder).collect()}
    assert made == want


def test_paths_through_blocks_of_a_large_part(spark, monkeypatch):
    """Parts that are cut into blocks: the same distances as one block gives, also for a source without links."""
    r = random.Random(5)
    rows = [(a, b, float(r.randrange(1, 9)) / 4) for a, b in ((r.randrange(80), r.randrange(80)) for _ in range(160))] + [(i, i + 1, 1.0) for i in range(100, 110)] + [(7, 7, 1.0)]
    links = spark.createDataFrame(rows, "a long, b long, length double")
    sources = spark.createDataFrame([(0,), (11,), (100,), (107,), (999,), (0,)], "node_id long")
    want = {}
    for s in (0, 11, 100, 107, 999):
        dist = {s: 0.0}
        for _ in range(90):
            for a, b, v in rows:
                for u, w in ((a, b), (b, a)):
                    if u in dist and dist[u] + v <= min(3.0, dist.get(w, 99.0)):
                        dist[w] = dist[u] + v
        want |= {(s, n): d for n, d in dist.items()}
    for block in (1 << 20, 40):
        monkeypatch.setattr(graph, "BLOCK", block)
        made = [(r.source, r.node, r.dist) for r in graph.shortest_paths(links, sources, 3.0).collect()]
        assert len(made) == len(want) and {(s, n): d for s, n, d in made} == want


def test_wanted_ways_alone(spark, monkeypatch):
    """Asked for pairs, the same distances, and no way to another node is written where parts are not cut."""
    r = random.Random(6)
    rows = [(a, b, float(r.randrange(1, 9)) / 4) for a, b in ((r.randrange(80), r.randrange(80)) for _ in range(200))] + [(100, 101, 1.0)]
    links = spark.createDataFrame(rows, "a long, b long, length double")
    pairs = sorted({(r.randrange(0, 80, 7), r.randrange(80)) for _ in range(150)} | {(100, 101), (100, 100), (100, 3), (999, 999), (999, 1)})
    wanted, sources = spark.createDataFrame(pairs, "source long, node long"), spark.createDataFrame([(s,) for s in (*range(0, 80, 7), 79, 100, 999)], "node_id long")
    want = {(x.source, x.node): x.dist for x in graph.shortest_paths(links, sources, 3.0).collect() if (x.source, x.node) in pairs}
    assert (100, 101) in want and (999, 999) in want and (100, 3) not in want
    written = []
    monkeypatch.setattr(graph, "table", lambda df, name, made=graph.table: written.append((name, made(df, name))) or written[-1][1])
    made = [(x.source, x.node, x.dist) for x in graph.shortest_paths(links, sources, 3.0, wanted).collect()]
    assert len(made) == len(want) and {(s, n): d for s, n, d in made} == want
    assert [t.count() for name, t in written if name == "paths"] == [len(want) - 1]  # 999 has no links and takes no walk
    monkeypatch.setattr(graph, "BLOCK", 40)
    made = [(x.source, x.node, x.dist) for x in graph.shortest_paths(links, sources, 3.0, wanted).collect()]
    assert len(made) == len(want) and {(s, n): d for s, n, d in made} == want


def test_circuity_writes_the_ways_of_its_pairs_alone(spark, monkeypatch):
    written = []
    monkeypatch.setattr(graph, "table", lambda df, name, made=graph.table: written.append((name, made(df, name))) or written[-1][1])
    nodes = spark.createDataFrame([(i, float(i), 0.0) for i in range(60)], "node_id long, x double, y double")
    links = spark.createDataFrame([(i, i + 1, 1.0) for i in range(59)], "a long, b long, length double")
    cities = spark.createDataFrame([(1, 3.0, 0.1), (2, 5.0, 0.1), (3, 40.0, 0.1)], "id long, x double, y double")
    rows = [(x.a, x.b, round(x.network, 6)) for x in graph.circuity(links, nodes, cities, 0.5, (0.5, 5.0), 1.0).collect()]
    assert rows == [(1, 2, 2.2)] and [t.count() for name, t in written if name == "paths"] == [1]


def test_no_row_for_each_source_and_link(spark, monkeypatch):
    """A part is walked through from its sources in one round, and only found ways are written."""
    written = []
    monkeypatch.setattr(graph, "table", lambda df, name, made=graph.table: written.append(name) or made(df, name))
    links = spark.createDataFrame([(i, i + 1, 1.0) for i in range(60)], "a long, b long, length double")
    made = graph.shortest_paths(links, spark.createDataFrame([(0,)], "node_id long"), 50.0)
    assert made.count() == 51 and written.count("paths") == 1


def test_only_open_parts_take_rounds(spark, monkeypatch):
    """Parts whose links fall in several chunks are joined by their roots alone; the others take no round."""
    r = random.Random(8)
    rows = [(k * 20 + r.randrange(20), k * 20 + r.randrange(20)) for k in range(12) for _ in range(25)] + [(3, 230), (45, 101)]
    root = {n: n for row in rows for n in row if row[0] != row[1]}
    for _ in root:
        for a, b in rows:
            if a != b:
                root[a] = root[b] = min(root[a], root[b])
    links = spark.createDataFrame(rows, "a long, b long")
    taken = []
    monkeypatch.setattr(graph, "_rounds", lambda e, made=graph._rounds: taken.append(e.count()) or made(e))
    assert {r.v: r.c for r in graph.components(links).collect()} == root and sum(taken) < 20
    monkeypatch.setattr(graph, "_contracted", lambda batches: iter(batches))  # nothing contracted: rounds do it all
    made = [(r.v, r.c) for r in graph.components(links).collect()]
    assert dict(made) == root and len(made) == len(root)
