"""Shortcuts for arrival and transfer time, and searches over them, beside plain searches on small random networks."""

from __future__ import annotations

import random

import pytest

from wayfarer.operators import hierarchy as H
from wayfarer.operators.graph import wrong_shortcuts
from wayfarer.plans import journeys as J
from wayfarer.plans import mcshortcuts as K
from wayfarer.plans import multicriteria as M

from .test_segments import EDGE, frames, lines_network

SETS = ["query_id", "stop", "trips", "arrival", "t_walk"]


def table(df, columns=SETS):
    return sorted(tuple(r) for r in df.select(*columns).collect())


@pytest.fixture(scope="module")
def network(spark):
    """A network with roads of several edges between its stops."""
    rng = random.Random(21)
    data = lines_network(21, stops=12, lines=6, trips=5)
    net, lines = frames(spark, data)
    pairs = {(a, (a + d) % 12) for a in range(12) for d in (1, 5)}
    road = spark.createDataFrame([e for a, b in sorted(pairs) for t in [rng.randrange(100, 700)] for e in ((a, b, t), (b, a, t))], EDGE)
    walks = J.unlimited(net, H.hierarchy(road, least=2))
    return net, lines, road, walks, J.hashed_queries(net.stops, 4, 0, 5000)


def test_searches_over_shortcuts_equal_the_plain_one(spark, network):
    net, lines, road, walks, batch = network
    want = table(M.pareto_sets(net, batch, walks=walks))
    assert len(want) > 60 and len({r[4] for r in want}) > 10
    events = K.event_shortcuts(net, lines, walks)
    assert events.count() == events.select("from_trip", "from_idx", "to_trip", "to_idx").distinct().count()
    short = K.stop_shortcuts(events)
    assert 0 < short.count() < 12 * 11 and wrong_shortcuts(short, road).count() == 0
    assert table(K.sets_over_shortcuts(net, batch, walks, short)) == want
    full = K.sets_by_segments(net, lines, events, batch, walks)
    assert table(full) == want
    assert table(K.earliest_of(full), SETS[:4]) == table(J.pareto(net, batch, walks=walks), SETS[:4])


def test_no_trips_and_no_queries(spark, network):
    net, lines, _, walks, batch = network
    still = net.replace(events=net.events.limit(0))
    none = K.event_shortcuts(still, lines, walks)
    assert none.count() == 0
    got = K.sets_by_segments(still, lines, none, batch, walks)
    assert table(got) == table(M.pareto_sets(still, batch, walks=walks)) and got.where("trips > 0").count() == 0
    assert K.sets_by_segments(net, lines, K.event_shortcuts(net, lines, walks), batch.limit(0), walks).count() == 0
    assert K.sets_over_shortcuts(net, batch.limit(0), walks, K.stop_shortcuts(none)).count() == 0


@pytest.mark.parametrize("seed", range(3))
def test_undominated_rows_keep_ties(spark, seed):
    rng = random.Random(seed)
    make = lambda n: [(rng.randrange(3), rng.randrange(5), rng.randrange(5), i) for i in range(n)]
    rows, by = make(30), make(6)
    beats = lambda o, r: o[0] == r[0] and o[1] <= r[1] and o[2] <= r[2] and o[1:3] != r[1:3]
    frame = lambda x: spark.createDataFrame(x, "k long, a long, b long, name long")
    for other in ([], by):
        want = sorted(r for r in rows if not any(beats(o, r) for o in rows + other))
        got = K.undominated(frame(rows), frame(by).drop("name") if other else None, ["k"], ["a", "b"])
        assert table(got, ["k", "a", "b", "name"]) == want


def test_last_walks_of_all_trips_at_once(spark, network, monkeypatch):
    """Labels of all numbers of trips are walked on from and compared together; no table is written for each of them."""
    net, _, _, walks, batch = network
    want = table(M.pareto_sets(net, batch, walks=walks))
    rides = spark.createDataFrame(want, ", ".join(f"{c} long" for c in SETS))
    monkeypatch.setattr(K, "cut", None)
    assert table(K.with_last_walk(rides, walks)) == want
