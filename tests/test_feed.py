"""A small feed with every case that readers must bear, and operators on hand-made networks."""

from __future__ import annotations

import pytest

from wayfarer.functions import parse_day
from wayfarer.operators import assembly, delays, graph, triptransfers
from wayfarer.plans import journeys
from wayfarer.plans.network import Network
from wayfarer.sources import gtfs, graphs

FILES = {
    "agency": 'agency_id,agency_name,agency_timezone\na1,"Lines, ""fast""",Europe/Berlin\n,none,x\na2,,UTC\n',
    "calendar": "service_id,sunday,monday,tuesday,wednesday,thursday,friday,saturday,start_date,end_date\nwk,0,1,1,1,1,1,0,20240101,20240107\nbad,1,1,1,1,1,1,1,20240107,20240101\n",
    "calendar_dates": "service_id,date,exception_type\nwk,20240103,2\nwk,20240106,1\nonly,20240102,1\n",
    "frequencies": "trip_id,start_time,end_time,headway_secs\nt1,6:00:00,7:00:00,1800\nt2,7:00:00,6:00:00,60\n",
    "routes": "route_id,agency_id,route_short_name,route_long_name,route_type,route_color\nr1,a1,7,Ring,3,zz\nr1,a1,8,Other,3,00FF00\n,a1,9,No,3,\n",
    "stops": "stop_id, stop_name ,stop_lat,stop_lon\nA, Alpha ,47.0,8.0\nB,,47.1,8.1\nC,Gamma,47.2,8.2\nC,Twice,0,0\n,No,1,1\n",
    "stop_times": "trip_id,arrival_time,departure_time,stop_id,stop_sequence\nt1,8:00:00,8:00:00,A,1\nt1,8:00:00,8:00:00,B,2\nt1,8:00:00,8:00:00,C,3\nt2,25:00:00,25:01:00,B,1\nt2,25:10:00,25:10:00,C,5\nt3,9:00:00,9:05:00,A,1\nt3,9:01:00,9:02:00,B,2\nt4,9:00:00,8:00:00,A,1\nt5,9:00:00,9:00:00,A,1\n",
    "transfers": "from_stop_id,to_stop_id,min_transfer_time,transfer_type\nA,A,60,2\nA,A,90,2\nA,B,120,2\nB,A,100,2\nB,C,30,3\nC,B,-5,2\n",
    "trips": "route_id,service_id,trip_id,trip_short_name\nr1,wk,t1,\nr1,only,t2,\nr1,wk,t3,\nr1,wk,t5,\nrx,wk,t6,\n",
}


@pytest.fixture(scope="module")
def feed(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("feed")
    for name, text in FILES.items():
        (folder / f"{name}.txt").write_text(text)
    return gtfs.read_feed(spark, str(folder))


def test_rows_that_are_read(feed):
    assert {(r["agency_id"], r["agency_name"]) for r in feed["agency"].collect()} == {("a1", 'Lines, "fast"'), ("a2", "NOT_NAMED")}
    assert feed["calendar"].count() == 1 and feed["frequencies"].count() == 1 and feed["stop_times"].count() == 8
    (route,) = feed["routes"].collect()
    assert route["name"] in ("[7] Ring", "[8] Other") and route["route_text_color"] == "000000"
    assert {r["stop_id"]: r["stop_name"] for r in feed["stops"].where("stop_id <> 'C'").collect()} == {"A": "Alpha", "B": "NOT_NAMED"} and feed["stops"].count() == 3
    assert feed["transfers"].count() == 4


def test_missing_files_are_empty(spark, tmp_path):
    (tmp_path / "stops.txt").write_text(FILES["stops"])
    t = gtfs.read_feed(spark, str(tmp_path))
    assert t["trips"].count() == 0 and t["stops"].count() == 3


def _window(spark):
    a, b = (spark.range(1).select(parse_day(__import__("pyspark").sql.functions.lit(x))).first()[0] for x in ("20240101", "20240107"))
    return a, b


def test_service_days(spark, feed):
    a, b = _window(spark)
    got = {(r["service_id"], r["day"]) for r in assembly.service_days(feed, a, b).collect()}
    assert got == {("wk", d) for d in (0, 1, 3, 4, 5)} | {("only", 1)}
    every = assembly.service_days(feed, a, b, ignore_days=True)
    assert every.count() == 14


def test_network_of_the_feed(spark, feed):
    net = assembly.from_feed(feed, *_window(spark))
    t1 = feed["stop_times"].where("trip_id = 't1'")
    (halts,) = assembly.trip_halts(t1).collect()
    assert [(h["arr"], h["dep"]) for h in halts["halts"]] == [(28799, 28800), (28801, 28801), (28802, 28803)]
    # t1: 5 days x 3 runs; t2: one day; t3 travels back in time, t5 has one halt
    assert net.events.select("trip").distinct().count() == 16
    day0 = net.events.where("idx = 0 and dep < 86400").select("dep").collect()
    assert sorted(r["dep"] for r in day0) == [21600, 23400, 25200]
    assert {(r["src"], r["dst"], r["travel_time"]) for r in net.edges.collect()} == {(0, 1, 100), (1, 0, 100)}
    assert {r["stop_id"]: r["min_transfer_time"] for r in net.stops.collect()} == {0: 90, 1: 0, 2: 0}


def _events(spark, trips):
    rows = [(t, i, s, a, d, len(h)) for t, h in trips.items() for i, (s, a, d) in enumerate(h)]
    return spark.createDataFrame(rows, "trip long, idx long, stop long, arr long, dep long, n long")


def test_lines_do_not_overtake(spark):
    ev = _events(spark, {1: [(0, 0, 0), (1, 100, 100)], 2: [(0, 10, 10), (1, 50, 50)], 3: [(0, 20, 20), (1, 120, 120)], 4: [(1, 0, 0), (0, 9, 9)]})
    lines = assembly.fifo_lines(ev)
    of = {r["trip"]: r["line"] for r in lines.collect()}
    assert of[1] == of[3] != of[2] and of[4] == 4
    assert assembly.overtaking(ev, lines).count() == 0
    assert assembly.overtaking(ev, lines.selectExpr("trip", "0L as line").where("trip < 3")).count() == 1


def test_as_of_join(spark):
    left = spark.createDataFrame([(1, "a", 5), (2, "a", 8), (3, "b", 1), (4, "a", 7)], "id int, k string, t int")
    right = spark.createDataFrame([("a", 5, 10), ("a", 7, 12), ("a", 7, 11)], "k string, u int, v int")
    got = triptransfers.as_of(left, right, ["k"], "t", "u", ["v"])
    assert {r["id"]: r["v"] for r in got.collect()} == {1: 10, 2: None, 3: None, 4: 11}


def test_delays_never_leave_before_arriving(spark):
    ev = _events(spark, {1: [(0, 0, 0), (1, 100, 130), (2, 200, 200)]})
    late = spark.createDataFrame([(1, 1, 300)], "trip long, first_idx long, delay long")
    got = {r["idx"]: (r["arr"], r["dep"]) for r in delays.delayed(ev, late, most_arrival=50).collect()}
    assert got[0] == (0, 0) and got[2][0] == 250 and got[1][0] <= got[1][1] <= got[2][0]


def test_last_update_overwrites(spark):
    rows = [(1, 0, 60, 100), (1, 2, 30, 200), (2, 0, 5, 50)]
    updates = spark.createDataFrame(rows, "trip long, first_idx long, delay long, reveal_time long")
    assert {tuple(r) for r in delays.latest(updates).collect()} == {(1, 2, 30), (2, 0, 5)}
    assert {tuple(r) for r in delays.known_at(updates, 150).collect()} == {(1, 0, 60), (2, 0, 5)}


def test_graph_files_round_trip(spark, tmp_path):
    edges = spark.createDataFrame([(0, 1, 5), (1, 2, 7)], "src long, dst long, travel_time long")
    vertices = spark.createDataFrame([(0, 47.5, 8.25), (1, 47.0, 8.0), (2, -1.5, 0.0)], "id long, lat double, lon double")
    base = str(tmp_path / "road")
    graphs.write_dimacs(edges, vertices, base)
    (tmp_path / "road.gr" / "more.txt").write_text("c comment\na 1 x 3\na 1 2\n")
    e, v = graphs.read_dimacs(spark, base)
    assert sorted(map(tuple, e.collect())) == sorted(map(tuple, edges.collect()))
    assert sorted((r["id"], round(r["lat"], 6), round(r["lon"], 6)) for r in v.collect()) == sorted(map(tuple, vertices.collect()))
    assert graphs.graphml_lines(edges, vertices).count() == 5


def test_components_and_contraction(spark):
    edges = spark.createDataFrame([(0, 1, 1), (1, 0, 1), (1, 2, 1), (2, 3, 1), (3, 2, 4)], "src long, dst long, travel_time long")
    ids = spark.range(5)
    assert {r["id"]: r["component"] for r in graph.strong_components(edges, ids).collect()} == {0: 0, 1: 0, 2: 2, 3: 2, 4: 4}
    assert {r["id"] for r in graph.largest_component(graph.strong_components(edges, ids)).collect()} == {0, 1}
    stops = spark.createDataFrame([(0,), (3,)], "stop_id long")
    path = spark.createDataFrame([(a, b, 10) for a, b in ((0, 1), (1, 2), (2, 3))], "src long, dst long, travel_time long")
    got = graph.reduce_graph(graph.symmetric(path), stops)
    assert {tuple(r) for r in got.select("src", "dst", "travel_time").collect()} == {(0, 3, 30), (3, 0, 30)}


def test_journeys_against_a_connection_scan(spark, sf_dir):
    from wayfarer.plans.network import derived

    net = derived(spark, sf_dir)
    batch = journeys.hashed_queries(net.stops, 3)
    got = {(r["query_id"], r["stop"]): r["arrival"] for r in journeys.earliest(net, batch).collect()}
    wait = {r["stop_id"]: r["min_transfer_time"] for r in net.stops.collect()}
    walk = {}
    for r in net.edges.collect():
        walk.setdefault(r["src"], []).append((r["dst"], r["travel_time"]))
    halts = {}
    for r in net.events.collect():
        halts.setdefault(r["trip"], {})[r["idx"]] = (r["stop"], r["arr"], r["dep"])
    conns = sorted((h[i][2], h[i + 1][1], h[i][0], h[i + 1][0], t) for t, h in halts.items() for i in range(len(h) - 1))
    want = {}
    for q in batch.collect():
        best = {q["source"]: q["dep_time"]}
        for s, t in walk.get(q["source"], []):
            best[s] = min(best.get(s, 1 << 60), q["dep_time"] + t)
        on = set()
        for dep, arr, a, b, trip in conns:
            if trip in on or best.get(a, 1 << 60) <= dep - wait[a]:
                on.add(trip)
                if arr < best.get(b, 1 << 60):
                    best[b] = arr
                    for s, t in walk.get(b, []):
                        best[s] = min(best.get(s, 1 << 60), arr + t)
        want |= {(q["query_id"], s): x for s, x in best.items()}
    assert got == want


def test_reversal_is_its_own_inverse(spark, sf_dir):
    from wayfarer.operators.transforms import reverse
    from wayfarer.plans.network import derived

    net: Network = derived(spark, sf_dir)
    twice = reverse(reverse(net))
    assert net.events.exceptAll(twice.events).count() == 0 and net.edges.exceptAll(twice.edges).count() == 0
