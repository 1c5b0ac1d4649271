"""Transfers of lines, the search over trip segments, shortcuts and bounded searches on small random networks."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from wayfarer.operators import hierarchy as H
from wayfarer.operators import triptransfers as T
from wayfarer.operators.skyline import merged_front, skyline
from wayfarer.plans import journeys as J
from wayfarer.plans import multicriteria as M
from wayfarer.plans import segments, shortcuts
from wayfarer.plans.network import Network

EDGE = "src long, dst long, travel_time long"


def lines_network(seed, stops=12, lines=7, trips=6):
    """(stops, events, edges, line of trip): lines over random stops, some of them twice, with trips at random times."""
    rng = random.Random(seed)
    events, line_of, trip = [], {}, 0
    for line in range(lines):
        way = [rng.randrange(stops)]
        while len(way) < rng.randrange(3, 7):
            way.append(rng.choice([s for s in range(stops) if s != way[-1]]))
        run = [rng.randrange(60, 400) for _ in way]
        for start in sorted(rng.randrange(0, 9000) for _ in range(trips)):
            at = start
            for i, s in enumerate(way):
                events.append((trip, i, s, at, at + 20, len(way)))
                at += run[i]
            line_of[trip] = line
            trip += 1
    wait = [(s, f"s{s}", rng.choice([0, 30, 60])) for s in range(stops)]
    edges = [(a, b, rng.randrange(60, 500)) for a in range(stops) for b in range(stops) if a != b and a // 3 == b // 3]
    return wait, events, edges, line_of


def frames(spark, data):
    wait, events, edges, line_of = data
    net = Network(spark.createDataFrame(wait, "stop_id long, name string, min_transfer_time long"), spark.createDataFrame(events, "trip long, idx long, stop long, arr long, dep long, n long"), spark.createDataFrame(edges, EDGE))
    return net, spark.createDataFrame(list(line_of.items()), "trip long, line long")


def transfers(data, route_based):
    """Every halt's first trip of each line, and what is left of them line pair by line pair."""
    wait, events, edges, line_of = data
    buffer = {s: w for s, _, w in wait}
    ev = {(t, i): (s, a, d, n) for t, i, s, a, d, n in events}
    lines = {}
    for t, line in line_of.items():
        lines.setdefault(line, []).append(t)
    for ts in lines.values():
        ts.sort(key=lambda t: (ev[t, 0][2], t))
    no = {t: k for ts in lines.values() for k, t in enumerate(ts)}
    ways = [*edges, *((s, s, 0) for s in buffer)]
    out = set()
    for line, trips in lines.items():
        for t in trips:
            for other, goals in lines.items():
                found, n = [], ev[goals[0], 0][3]
                for i in range(ev[t, 0][3] - 1, 0, -1):
                    for j in range(n - 1):
                        for a, b, walk in ways:
                            if a != ev[t, i][0] or b != ev[goals[0], j][0] or (line == other and i == j):
                                continue
                            ready = ev[t, i][1] + walk + buffer[b]
                            goal = next((g for g in goals if ev[g, j][2] >= ready), None)
                            if goal is None or (line == other and no[goal] >= no[t] and j >= i):
                                continue
                            if ev[t, i - 1][0] == ev[goal, j + 1][0] and ev[t, i - 1][1] + buffer[ev[t, i - 1][0]] <= ev[goal, j + 1][2]:
                                continue
                            if route_based and any(jj <= j and no[g] <= no[goal] for jj, g in found):
                                continue
                            found.append((j, goal))
                            out.add((t, i, goal, j, walk))
    return out


def rows(df):
    return sorted(tuple(r) for r in df.collect())


_EDGE = ("from_trip", "from_idx", "to_trip", "to_idx", "travel_time")


def test_transfers_of_lines(spark):
    data = lines_network(1)
    net, lines = frames(spark, data)
    for route_based, bucket in ((False, 500), (True, 7200)):
        assert rows(T.line_transfers(net, lines, route_based, bucket).select(*_EDGE)) == sorted(transfers(data, route_based))


def test_as_of_in_buckets(spark):
    rng = random.Random(7)
    left = spark.createDataFrame([(i, rng.randrange(3), rng.randrange(-500, 3000)) for i in range(300)], "i long, k long, t long")
    right = spark.createDataFrame([(rng.randrange(3), rng.choice([-300, 5, 1900, 2500]) + rng.randrange(60), j) for j in range(60)], "k long, s long, j long")
    want = rows(T.as_of(left, right, ["k"], "t", "s", ["s", "j"]))
    for bucket in (40, 700):
        assert rows(T.as_of(left, right, ["k"], "t", "s", ["s", "j"], bucket)) == want


def test_augmented_transfers(spark):
    net, lines = frames(spark, lines_network(3))
    found = T.line_transfers(net, lines)
    table = [r.asDict() for r in found.collect()]
    last = {}
    for r in T.numbered(net.events, lines).collect():
        last[r["line"]] = max(last.get(r["line"], 0), r["no"])
    for limit in (None, 1):
        want = set()
        for key in {(r["from_line"], r["from_idx"], r["to_line"], r["to_idx"]) for r in table}:
            best = None
            for no in range(last[key[0]], -1, -1):
                for r in table:
                    if (r["from_line"], r["from_idx"], r["to_line"], r["to_idx"]) == key and r["from_no"] == no and (best is None or r["to_no"] <= best["to_no"]):
                        best = r
                if best is not None and (limit is None or best["from_no"] <= no + limit):
                    want.add((*key, no, best["to_trip"]))
        got = T.augmented(found, limit).select("from_line", "from_idx", "to_line", "to_idx", "from_no", "to_trip")
        assert rows(got) == sorted(want)


def test_segments_find_what_rounds_of_stops_find(spark):
    net, lines = frames(spark, lines_network(4))
    batch = J.hashed_queries(net.stops, 5, 0, 4000)
    want = rows(J.pareto(net, batch))
    found = T.line_transfers(net, lines).select(*_EDGE)
    assert rows(segments.pareto_by_segments(net, lines, found, batch)) == want
    assert rows(segments.pareto_by_segments(net, lines, T.reduce_transfers(found, net), batch)) == want
    assert rows(segments.pareto_by_segments(net, lines, found, batch, max_trips=1)) == [r for r in want if r[2] <= 1]


@pytest.fixture(scope="module")
def walked(spark):
    """A network with walks of any length, and hubs for them."""
    net, lines = frames(spark, lines_network(6, stops=14, lines=8))
    rng = random.Random(8)
    road = spark.createDataFrame([(a, b, rng.randrange(200, 900)) for a in range(14) for b in ((a + 1) % 14, (a + 5) % 14) if rng.random() < 0.8] + [(100 + k, k, 90) for k in range(3)] + [(k, 100 + k, 90) for k in range(3)], EDGE)
    walks = J.unlimited(net, H.hierarchy(road, least=2))
    batch = J.hashed_queries(net.stops, 6, 0, 5000)
    return net, lines, road, walks, batch, rows(J.pareto(net, batch, walks=walks))


def test_walks_through_hubs_are_those_of_a_closure(spark, walked):
    from wayfarer.operators.graph import closure

    net, _, road, _, batch, want = walked
    assert rows(J.pareto(net.replace(edges=closure(road).where("src < 100 and dst < 100")), batch)) == want


def test_journeys_over_shortcuts(spark, walked):
    from wayfarer.operators.graph import wrong_shortcuts

    net, lines, road, walks, batch, want = walked
    found = shortcuts.stop_shortcuts(net, walks)
    assert wrong_shortcuts(found, road).count() == 0
    assert 0 < found.count() < 14 * 13
    assert rows(shortcuts.over_shortcuts(net, batch, walks, found)) == want
    assert rows(segments.pareto_by_segments(net, lines, shortcuts.event_shortcuts(net, walks), batch, walks=walks)) == want


def test_bounds_leave_restricted_sets_as_they_are(spark):
    net, _ = frames(spark, lines_network(9, stops=16, lines=10))
    batch = J.hashed_queries(net.stops, 6, 0, 4000)
    assert rows(M.restricted_to_targets(net, batch, 1.3, 1.25)) == rows(M.restricted_to_targets(net, batch, 1.3, 1.25, bounded=False))
    anchors = J.to_targets(J.pareto(net, batch), batch)
    within = M.useful_until(net, batch, anchors, 1.3, 1.25)
    assert 0 < M.pareto_sets(net, batch, within=within).count() < M.pareto_sets(net, batch).count() / 2


def test_merging_into_a_front(spark):
    rng = random.Random(10)
    for n in (2, 3):
        value = [f"c{i}" for i in range(n)]
        make = lambda: spark.createDataFrame([(rng.randrange(3), *(rng.randrange(6) for _ in range(n))) for _ in range(60)], "k long, " + ", ".join(f"{c} long" for c in value))  # noqa: E731, B023
        bag, new = skyline(make(), ["k"], value).cache(), make().cache()
        old = {tuple(r) for r in bag.collect()}
        whole = {tuple(r) for r in skyline(bag.unionByName(new), ["k"], value).collect()}
        got = [tuple(r) for r in merged_front(bag, new, ["k"], value).select("k", *value, "fresh").collect()]
        assert {r[:-1] for r in got} == whole and len(got) == len(whole) and {r[:-1] for r in got if r[-1]} == whole - old


def test_pareto_sets_at_vertices(spark, walked):
    net, _, road, _, batch, _ = walked
    h = H.hierarchy(road, least=2)
    front = J.pareto(net, batch, walks=J.unlimited(net, h))
    got = J.pareto_to_vertices(front, h, batch)
    best = got.groupBy("query_id", "vertex").agg(F.min("arrival").alias("arrival"))
    assert rows(best) == rows(J.to_vertices(front, h, batch).select("query_id", "vertex", "arrival"))
    at_stops = rows(got.where("vertex < 100").select("query_id", F.col("vertex").alias("stop"), "trips", "arrival"))
    assert at_stops == rows(front.select("query_id", "stop", "trips", "arrival"))


def test_line_transfers_are_not_shuffled(spark):
    """Only trips are grouped; what is found leaves its group without another exchange."""
    net, lines = frames(spark, lines_network(3))
    for route_based in (False, True):
        plan = T.line_transfers(net, lines, route_based)._jdf.queryExecution().executedPlan().toString()
        assert "Exchange" not in plan.split("FlatMapGroupsInArrow")[0] and plan.count("FlatMapGroupsInArrow") >= 1


def test_line_transfers_in_many_groups(spark, monkeypatch):
    """Groups of a few trips, and waits over hours without any trip."""
    monkeypatch.setattr(T, "TRIPS_EACH", 2)
    wait, events, edges, line_of = lines_network(5)
    data = wait, [(t, i, s, a + t % 3 * 20_000, d + t % 3 * 20_000, n) for t, i, s, a, d, n in events], edges, line_of
    net, lines = frames(spark, data)
    assert rows(T.line_transfers(net, lines, True, 7200).select(*_EDGE)) == sorted(transfers(data, True))
