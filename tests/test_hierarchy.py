"""Hierarchies, hub labels, sweeps and paths against Dijkstra's search."""

from __future__ import annotations

import heapq
import random

import pytest
from pyspark.sql import functions as F

from wayfarer.operators import graph
from wayfarer.operators import hierarchy as H

EDGE = "src long, dst long, travel_time long"


def grid(width=9, height=7, seed=3):
    """A road grid with one-way streets, several edges between some vertices, a long way across and a part of its own."""
    rng, out = random.Random(seed), []
    for y in range(height):
        for x in range(width):
            v = y * width + x
            for w in [*([v + 1] if x < width - 1 else []), *([v + width] if y < height - 1 else [])]:
                for a, b in ((v, w), (w, v)):
                    out += [(a, b, rng.randrange(1, 60)) for _ in range(rng.choice([0, 1, 1, 1, 2]))]
    return [*out, (0, width * height - 1, 5), (3, 3, 1), (200, 201, 7)]


def dijkstra(edges, source):
    near = {}
    for a, b, t in edges:
        near.setdefault(a, []).append((b, t))
    best, queue = {source: 0}, [(0, source)]
    while queue:
        d, u = heapq.heappop(queue)
        if d == best[u]:
            for w, t in near.get(u, []):
                if d + t < best.get(w, 1 << 40):
                    best[w] = d + t
                    heapq.heappush(queue, (d + t, w))
    return best


@pytest.fixture(scope="module")
def roads():
    return grid()


@pytest.fixture(scope="module")
def built(spark, roads):
    return H.hierarchy(spark.createDataFrame(roads, EDGE), least=4)


def ids(spark, values):
    return spark.createDataFrame([(v,) for v in values], "id long")


def test_distances_by_hubs(spark, roads, built):
    vertices = sorted({x for e in roads for x in e[:2]})
    everyone = ids(spark, vertices)
    a, b = H.labels_from(built, everyone), H.labels_to(built, everyone)
    want = {(s, w): d for s in vertices for w, d in dijkstra(roads, s).items() if w != s}
    assert {(r["src"], r["dst"]): r["travel_time"] for r in H.hub_distances(a, b).collect()} == want
    assert a.count() < len(want) / 2  # labels are far fewer than pairs
    assert {(r["src"], r["dst"]): r["travel_time"] for r in H.hub_distances(a, b, 40).collect()} == {k: d for k, d in want.items() if d <= 40}


def test_every_level_is_independent_and_shortcuts_hold(roads, built):
    level = {r["id"]: r["level"] for r in built.levels.collect()}
    exact = {v: dijkstra(roads, v) for v in level}
    core = {(r["src"], r["dst"]) for r in built.core.collect()}
    for r in built.up.collect():
        assert r["travel_time"] >= exact[r["src"]][r["dst"]]
        assert level[r["src"]] < level[r["dst"]] or (r["src"], r["dst"]) in core
    for r in built.down.collect():
        assert r["travel_time"] >= exact[r["src"]][r["dst"]]
        assert level[r["dst"]] < level[r["src"]] or (r["src"], r["dst"]) in core
    ranks = sorted((r["rank"], r["level"]) for r in built.order().collect())
    assert [k for k, _ in ranks] == list(range(len(level))) and [x for _, x in ranks] == sorted(x for _, x in ranks)
    report = H.hierarchy_report(built).collect()
    assert sum(r["vertices"] for r in report) == len(level) and any(r["shortcuts"] for r in report)


def test_sweep_reaches_every_vertex(spark, roads, built):
    begin = [(1, 0, 100), (1, 31, 30), (2, 200, 5), (2, 999, 5), (3, 62, -7), (3, 62, 4)]
    want = {}
    for q, v, a in begin:
        for w, d in dijkstra(roads, v).items():
            want[q, w] = min(want.get((q, w), 1 << 40), a + d)
    got = H.sweep(built, spark.createDataFrame(begin, "q long, vertex long, arrival long"), ["q"], "arrival").collect()
    assert len(got) == len(want) and {(r["q"], r["vertex"]): r["arrival"] for r in got} == want


def test_paths_are_made_of_roads(spark, roads, built):
    rng = random.Random(5)
    pairs = [(i, rng.randrange(63), rng.randrange(63)) for i in range(20)] + [(50, 200, 201), (51, 201, 200), (52, 4, 4)]
    least = {}
    for a, b, t in roads:
        least[a, b] = min(t, least.get((a, b), 1 << 40))
    paths = {}
    for r in H.shortest_paths(built, spark.createDataFrame(pairs, "path long, src long, dst long")).orderBy("path", "step").collect():
        paths.setdefault(r["path"], []).append(r)
    for i, s, t in pairs:
        want = dijkstra(roads, s).get(t)
        if s == t or want is None:
            assert i not in paths
            continue
        way = paths[i]
        assert way[0]["src"] == s and way[-1]["dst"] == t and all(x["dst"] == y["src"] for x, y in zip(way, way[1:], strict=False))
        assert all(least[r["src"], r["dst"]] == r["travel_time"] for r in way) and sum(r["travel_time"] for r in way) == want
        assert [r["step"] for r in way] == list(range(len(way)))


def test_core_of_kept_vertices_and_a_given_order(spark, roads):
    edges = spark.createDataFrame(roads, EDGE)
    vertices = sorted({x for e in roads for x in e[:2]})
    keep = [v for v in vertices if v % 6 == 0]
    order = spark.createDataFrame([(v, (v * 37) % 101) for v in vertices], "id long, rank long")
    h = H.hierarchy(edges, keep=ids(spark, keep), key=H.order_key(), order=order, least=0)
    assert {x for r in h.core.collect() for x in (r["src"], r["dst"])} <= set(keep)
    got = {(r["source"], r["vertex"]): r["distance"] for r in graph.distances(h.core.select("src", "dst", "travel_time"), ids(spark, keep).withColumnRenamed("id", "source")).collect()}
    assert got == {(s, w): d for s in keep for w, d in dijkstra(roads, s).items() if w in keep}


def test_no_edges(spark):
    h = H.hierarchy(spark.createDataFrame([], EDGE))
    assert h.up.count() == h.down.count() == h.levels.count() == 0
    assert [tuple(r) for r in H.labels_from(h, ids(spark, [7])).collect()] == [(7, 7, 0)]
    got = H.sweep(h, spark.createDataFrame([(1, 7, 9)], "q long, vertex long, arrival long"), ["q"], "arrival")
    assert [tuple(r) for r in got.select("q", "vertex", "arrival").collect()] == [(1, 7, 9)]


def test_walks_keep_the_best_at_each_hub(spark, roads, built):
    stops = ids(spark, [0, 8, 31, 62])
    hubs = H.Hubs.between(built, stops, ids(spark, [40]))
    rows = spark.createDataFrame([(1, 0, 100, "a"), (1, 31, 104, "b"), (2, 40, 3, "c")], "q long, stop long, arrival long, name string")
    got = {}
    for r in hubs.moved(rows, ["q"], "stop", "arrival", ["name"]).collect():
        key = r["q"], r["stop"]
        got[key] = min(got.get(key, 1 << 40), r["arrival"])
    want = {}
    for q, s, a, _ in [tuple(r) for r in rows.collect()]:
        for w, d in dijkstra(roads, s).items():
            if w in (0, 8, 31, 62) and w != s:
                want[q, w] = min(want.get((q, w), 1 << 40), a + d)
    assert all(got[k] == v for k, v in want.items() if (k[0], k[1]) not in {(1, 0), (1, 31)}) and set(got) >= {k for k in want if k not in {(1, 0), (1, 31)}}
    two = hubs.moved(rows.withColumn("cost", F.lit(0).cast("long")), ["q"], "stop", "arrival", costs=["cost"])
    assert {(r["q"], r["stop"]) for r in two.collect()} >= set(got)
