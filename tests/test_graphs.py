"""Graph operators and sinks on small hand-made inputs."""

from __future__ import annotations

import math
import xml.etree.ElementTree as ET

from wayfarer.operators import graph, transforms, triptransfers
from wayfarer.plans.network import Network
from wayfarer.sources import graphs

EDGE = "src long, dst long, travel_time long"


def _rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_pairs_near_the_pole_and_the_date_line(spark):
    places = [(0, 89.9, 0.0), (1, 89.9, 180.0), (2, 10.0, 179.99), (3, 10.0, -179.99), (4, 75.0, 20.0), (5, 75.0, 21.0), (6, -60.5, 0.0)]
    df = spark.createDataFrame(places, "id long, lat double, lon double")

    def metres(a, b):
        (p, x), (q, y) = ((math.radians(v) for v in r[1:]) for r in (a, b))
        return math.acos(max(-1, min(1, math.sin(p) * math.sin(q) + math.cos(p) * math.cos(q) * math.cos(x - y)))) * 6_378_137

    for cm in (300_000, 3_500_000, 2_000_000_000):
        got = {(r["id"], r["other"]) for r in graph.within_range(df, df, cm).where("id <> other").collect()}
        assert got == {(a[0], b[0]) for a in places for b in places if a != b and metres(a, b) * 100 <= cm}


def test_merged_graph(spark):
    """A stop on a road vertex takes its place, one nearby is tied to it, one far away stays alone."""
    stops = spark.createDataFrame([(0, 47.0, 8.0), (1, 47.0005, 8.0), (2, 48.0, 9.0)], "id long, lat double, lon double")
    road = spark.createDataFrame([(0, 47.0, 8.0), (1, 47.01, 8.0)], "id long, lat double, lon double")
    merged = graph.merge_graph(spark.createDataFrame([(1, 2, 900)], EDGE), stops, spark.createDataFrame([(0, 1, 60)], EDGE), road)
    got = {(r["src"], r["dst"]): r["travel_time"] for r in merged.collect()}
    assert got[(0, 4)] == got[(4, 0)] == 60 and got[(1, 2)] == got[(2, 1)] == 900
    assert got[(0, 1)] == got[(1, 0)] == int(6_378_137 * math.radians(0.0005) * 100 / 4.5 * 0.036)
    assert len(got) == 6


def test_graphml_is_a_document(spark, tmp_path):
    edges = spark.createDataFrame([(0, 1, 5), (1, 0, 7)], EDGE)
    vertices = spark.createDataFrame([(0, 47.5, 8.25), (1, 47.0, 8.0)], "id long, lat double, lon double")
    graphs.write_graphml(edges, vertices, str(tmp_path / "g"))
    text = "".join(p.read_text() for p in sorted((tmp_path / "g").glob("part-*")))
    root = ET.fromstring(text)
    space = "{http://graphml.graphdrawing.org/xmlns}"
    body = root.find(f"{space}graph")
    assert len(body.findall(f"{space}node")) == 2 and [e.get("source") for e in body.findall(f"{space}edge")].count("0") == 1


def test_closure_of_a_long_path(spark):
    path = spark.createDataFrame([(i, i + 1, 2) for i in range(20)], EDGE)
    got = {(a, b): t for a, b, t in _rows(graph.closure(path))}
    assert got == {(i, j): 2 * (j - i) for i in range(21) for j in range(i + 1, 21)}
    assert len(_rows(graph.closure(path, 6))) == sum(min(3, 20 - i) for i in range(20))


def test_balls_of_small_components(spark):
    edges = graph.symmetric(spark.createDataFrame([(0, 1, 500), (1, 2, 900), (5, 6, 10)], EDGE))
    got = _rows(graph.balls(edges, spark.createDataFrame([(0,), (5,), (9,)], "id long"), 2, start=1))
    assert got == [(0, 0, 0), (0, 1, 500), (5, 5, 0), (5, 6, 10), (9, 9, 0)]


def test_reduction_against_a_loop_over_labels(spark):
    """Transfers of a small network, kept as a sequential pass with labels per stop keeps them."""
    trips = {0: [(0, 0), (1, 100), (2, 200)], 1: [(1, 150), (3, 250), (2, 400)], 2: [(2, 230), (4, 300)], 3: [(1, 160), (3, 240)], 4: [(3, 260), (2, 190 + 120), (4, 500)]}
    rows = [(t, i, s, a, a + 5, len(h)) for t, h in trips.items() for i, (s, a) in enumerate(h)]
    edges = [(3, 4, 20), (4, 3, 20)]
    net = Network(
        spark.createDataFrame([(s, "", 0) for s in range(5)], "stop_id long, name string, min_transfer_time long"),
        spark.createDataFrame(rows, "trip long, idx long, stop long, arr long, dep long, n long"),
        spark.createDataFrame(edges, EDGE),
    )
    lines = net.events.select("trip", net.events.trip.alias("line")).distinct()
    transfers = triptransfers.event_transfers(net, lines)
    wide = triptransfers.event_transfers(net, lines, 10_000)
    assert _rows(transfers) == _rows(wide)
    walk = {}
    for a, b, t in edges:
        walk.setdefault(a, []).append((b, t))
    found = [tuple(r)[:4] for r in transfers.collect()]
    kept = set()
    for trip, halts in trips.items():
        label = {}

        def offer(stop, at, label=label):
            better = False
            for s, t in [(stop, 0), *walk.get(stop, [])]:
                if at + t < label.get(s, 1 << 60):
                    label[s] = at + t
                    better = True
            return better

        for i in range(len(halts) - 1, 0, -1):
            offer(*halts[i])
            mine = sorted((trips[b][j][1], b, j) for a, k, b, j in found if (a, k) == (trip, i))
            for _, b, j in mine:
                if any([offer(s, at) for s, at in trips[b][j + 1 :]]):
                    kept.add((trip, i, b, j))
    assert {r[:4] for r in _rows(triptransfers.reduce_transfers(transfers, net))} == kept


def test_places_in_an_order(spark):
    rows = spark.createDataFrame([(i * 7919 % 101, i) for i in range(300)], "a long, b long")
    got = sorted((r["place"], r["a"], r["b"]) for r in transforms.ranked(rows, ["a", "b"]).collect())
    assert [g[0] for g in got] == list(range(300)) and [g[1:] for g in got] == sorted((r["a"], r["b"]) for r in rows.collect())
