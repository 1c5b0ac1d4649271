"""Transfers under a stream of delays, lines put in order again, transfers for delays."""

from __future__ import annotations

import random

from pyspark.sql import functions as F

from wayfarer.operators import assembly, delays
from wayfarer.operators import triptransfers as T
from wayfarer.plans.network import Network
from wayfarer.storage import keep_path
from wayfarer.streaming.replacement import follow_transfers

from .test_segments import frames, lines_network, rows

_ROW = ("from_trip", "from_idx", "to_line", "to_idx", "travel_time", "to_trip", "dep")


def reachable(data, late):
    """Every halt's first trip of each line in the late events {(trip, idx): (stop, arr, dep, n)}, null included."""
    wait, _, edges, line_of = data
    buffer = {s: w for s, _, w in wait}
    ways = [*edges, *((s, s, 0) for s in buffer)]
    planned = {(t, i): d for t, i, _, _, d, _ in data[1]}
    lines = {}
    for t, line in line_of.items():
        lines.setdefault(line, []).append(t)
    for ts in lines.values():
        ts.sort(key=lambda t: (planned[t, 0], t))
    out = []
    for (t, i), (stop, arr, _, _) in late.items():
        for line, goals in lines.items():
            for j in range(late[goals[0], 0][3] - 1):
                if i and not (line == line_of[t] and i == j):
                    for a, b, walk in ways:
                        if a == stop and b == late[goals[0], j][0]:
                            fits = [(late[g, j][2], k, g) for k, g in enumerate(goals) if late[g, j][2] >= arr + walk + buffer[b]]
                            dep, _, goal = min(fits) if fits else (None, None, None)
                            out.append((t, i, line, j, walk, goal, dep))
    return sorted(out, key=str)


def test_stream_gives_what_all_updates_give(spark):
    data = lines_network(11, stops=9, lines=6, trips=8)
    net, lines = frames(spark, data)
    rng = random.Random(12)
    trips = list(data[3])
    updates = [(rng.choice(trips), rng.randrange(3), rng.choice([0, 0, 40, 300, 900]), reveal) for reveal in (100, 200, 300, 400) for _ in range(6)]
    seed = spark.createDataFrame([(trips[0], 0, 500), (trips[1], 1, 60)], "trip long, first_idx long, delay long")
    table = spark.createDataFrame(updates, "trip long, first_idx long, delay long, reveal_time long")
    found = follow_transfers(spark, net, lines, keep_path(table.repartition(4, "reveal_time"), "updates"), seed=seed)
    assert found.batches >= 2
    known = {t: (f, d) for t, f, d in map(tuple, seed.collect())}
    for t in {u[0] for u in updates}:
        _, f, d = max((r, f, d) for x, f, d, r in updates if x == t)
        known[t] = (f, d)
    final = spark.createDataFrame([(t, *v) for t, v in known.items()], "trip long, first_idx long, delay long")
    late = {(r["trip"], r["idx"]): (r["stop"], r["arr"], r["dep"], r["n"]) for r in delays.delayed(net.events, final).collect()}
    want = reachable(data, late)
    assert sorted((tuple(r) for r in found.state().select(*_ROW).collect()), key=str) == want
    assert sorted((tuple(r) for r in found.replayed().select(*_ROW).collect()), key=str) == want
    # no batch looks up all halts
    assert all(r["count"] < len(want) * 0.8 for r in found.log().groupBy("batch").count().collect())


def test_rebuilt_lines_do_not_overtake(spark):
    data = lines_network(13, lines=4, trips=30)
    net, lines = frames(spark, data)
    rng = random.Random(14)
    late = delays.delayed(net.events, spark.createDataFrame([(t, 0, rng.choice([0, 0, 200, 1500])) for t in data[3]], "trip long, first_idx long, delay long"))
    trips = T.numbered(net.events, lines)
    new = assembly.rebuilt_lines(late, trips)
    table = [r.asDict() for r in new.collect()]
    assert {(r["trip"], r["line"], r["no"]) for r in table} == {tuple(r) for r in trips.select("trip", "line", "no").collect()}
    times = {}
    for r in late.orderBy("trip", "idx").collect():
        times.setdefault(r["trip"], []).append((r["arr"], r["dep"]))
    groups = {}
    for r in sorted(table, key=lambda r: r["no"]):
        groups.setdefault((r["line"], r["overflow"]), []).append(r["trip"])
    assert len(groups) > 4
    for members in groups.values():
        for a, b in zip(members, members[1:], strict=False):
            assert all(x[0] <= y[0] and x[1] <= y[1] for x, y in zip(times[a], times[b], strict=True))
    place = {(r["trip"], r["idx"]): r["place"] for r in assembly.event_order(late, new).collect()}
    firsts = {k: min(r["no"] for r in table if (r["line"], r["overflow"]) == k) for k in groups}
    order = [(t, i) for k in sorted(groups, key=lambda k: (k[1] is not None, k[0], firsts[k] if k[1] is not None else -1)) for t in groups[k] for i in range(len(times[t]))]
    assert [place[x] for x in order] == list(range(len(order)))


def test_lines_that_keep_their_order_stay(spark):
    net, lines = frames(spark, lines_network(15, lines=2, trips=4))
    trips = T.numbered(net.events, lines)
    assert assembly.rebuilt_lines(net.events, trips).where("overflow is not null").count() == 0


def test_transfers_for_each_delay(spark):
    """For every delay up to the greatest, exactly the trip that one reaches then."""
    data = lines_network(16, stops=8, lines=4, trips=6)
    net, lines = frames(spark, data)
    found = [r.asDict() for r in T.delay_transfers(net, lines, 900).collect()]
    ready = {(t, i): a for t, i, _, a, _, _ in data[1]}
    by = {}
    for r in found:
        by.setdefault((r["from_trip"], r["from_idx"], data[3][r["to_trip"]], r["to_idx"], r["travel_time"]), []).append(r)
    for delay in (0, 1, 250, 900):
        moved = {(t, i): (s, a + delay, d, n) for t, i, s, a, d, n in data[1]}
        # origins late, goals on time
        on_time = {(t, i): (s, ready[t, i], d, n) for t, i, s, a, d, n in data[1]}
        want = {}
        for t, i, line, j, walk, goal, _ in reachable_from(data, moved, on_time):
            want[t, i, line, j, walk] = goal
        got = {}
        for key, options in by.items():
            fits = [r["to_trip"] for r in options if r["min_origin_delay"] <= delay <= r["max_origin_delay"]]
            assert len(fits) <= 1
            if fits:
                got[key] = fits[0]
        assert got == {k: g for k, g in want.items() if g is not None and k in by and g in {r["to_trip"] for r in by[k]}}
        missing = {k: g for k, g in want.items() if g is not None and k not in got}
        no = {r["trip"]: r["no"] for r in T.numbered(net.events, lines).collect()} if missing else {}
        assert all(data[3][k[0]] == k[2] and no[g] >= no[k[0]] and k[3] >= k[1] for k, g in missing.items())  # one's own line, no earlier


def reachable_from(data, origins, goals):
    """``reachable`` with other times for those who arrive than for those who depart."""
    both = {k: (origins[k][0], origins[k][1], goals[k][2], goals[k][3]) for k in origins}
    return reachable(data, both)


def test_no_updates(spark):
    data = lines_network(17, stops=6, lines=3, trips=3)
    net, lines = frames(spark, data)
    empty = spark.createDataFrame([], "trip long, first_idx long, delay long, reveal_time long")
    found = follow_transfers(spark, net, lines, keep_path(empty, "updates"))
    late = {(t, i): (s, a, d, n) for t, i, s, a, d, n in data[1]}
    state = found.state() if found.batches else found.state(-1)
    assert sorted((tuple(r) for r in state.select(*_ROW).collect()), key=str) == reachable(data, late)
    assert isinstance(net, Network) and state.where(F.col("dep") < F.col("ready")).count() == 0
