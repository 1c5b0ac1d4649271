"""Journey queries as rounds of joins and minima over a batch of queries.

One round adds one trip.  Labels (query, stop, arrival) that the last round
improved meet the events they can board and the label before them couldn't, so
a query boards an event once; a trip offers its later halts, which stand beside
the event; transfers follow from stops that a trip improved.  Labels that are
no better than the best so far go, so the frontier shrinks to nothing.  All queries of a batch share every scan, and every round
ends in reliable checkpoints, so that plans stay small and executors may fail.

``queries``: (query_id, source, dep_time), with a column ``target`` where a
query has one.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators.hierarchy import Hierarchy, Hubs, hierarchy, sweep
from ..storage import cut
from .network import Network

_KEY = ["query_id", "stop"]


def hashed_queries(stops: DataFrame, n: int, first: int = 0, last: int = 86_400) -> DataFrame:
    """``n`` queries with sources, targets and times that follow from their numbers alone: (query_id, source, target, dep_time)."""
    order = Window.orderBy("stop_id")  # one row per stop
    ranked = stops.select("stop_id", (F.row_number().over(order) - 1).cast("long").alias("rank"))
    count = stops.agg(F.count(F.lit(1)).alias("m"))
    rows = stops.sparkSession.range(n).select(F.col("id").alias("query_id")).crossJoin(F.broadcast(count))
    rows = rows.select("query_id", (F.col("query_id") * 7919 % F.col("m")).alias("s"), ((F.col("query_id") * 104_729 + 1) % F.col("m")).alias("t"), (F.col("query_id") * 15_485_863 % (last - first) + first).alias("dep_time"))
    rows = rows.join(ranked.select(F.col("rank").alias("s"), F.col("stop_id").alias("source")), "s")
    return rows.join(ranked.select(F.col("rank").alias("t"), F.col("stop_id").alias("target")), "t").select("query_id", "source", "target", "dep_time")


@dataclass(frozen=True)
class OneHop:
    """Transfers along single edges; the like of ``Hubs``."""

    edges: DataFrame

    def moved(self, rows: DataFrame, key: Sequence[str], place: str, time: str, carried: Sequence[str] = ()) -> DataFrame:
        """``rows`` after a transfer: (key, place, time, carried, via)."""
        there = rows.join(self.edges.select("src", "dst", "travel_time"), F.col(place) == F.col("src"))
        return there.select(*key, F.col("dst").alias(place), (F.col(time) + F.col("travel_time")).alias(time), *carried, F.col("src").alias("via"))


def initial_labels(queries: DataFrame, walks: OneHop | Hubs) -> DataFrame:
    """Round 0: the source, and what one walk reaches: (query_id, stop, arrival, via)."""
    start = queries.select("query_id", F.col("source").alias("stop"), F.col("dep_time").alias("arrival"))
    walk = walks.moved(start, ["query_id"], "stop", "arrival").select(*_KEY, "arrival", "via")
    both = start.withColumn("via", F.lit(None).cast("long")).unionByName(walk)
    return both.groupBy(*_KEY).agg(F.min(F.struct("arrival", "via")).alias("l")).select(*_KEY, "l.arrival", "l.via")


def labels(net: Network, queries: DataFrame, max_trips: int | None = None, initial: DataFrame | None = None, prune_targets: bool = False, walks: OneHop | Hubs | None = None, onward: Callable[[DataFrame], DataFrame] | None = None, named: bool = True, rides: DataFrame | None = None) -> DataFrame:
    """Every improvement: (query_id, stop, trips, arrival, trip, board_stop, board_idx, via).

    ``trip``, ``board_stop`` and ``board_idx`` name the trip taken last, ``via`` the stop that a closing transfer began at;
    without ``named`` they are left out, and a plain minimum is all that a round aggregates.
    ``walks``: how one gets from stop to stop, the network's own edges if not given; these must be closed under transitivity
    for one-hop transfers to be shortest paths.  ``onward``: of a round's new labels those that the next one begins with.
    ``rides``: those of the network, if several searches share them.
    """
    # every round reads these, so they are made once
    rides = net.rides() if rides is None else rides
    walks = OneHop(cut(net.edges.select("src", "dst", "travel_time"))) if walks is None else walks
    start = cut(initial if initial is not None else initial_labels(queries, walks))
    none = F.lit(None).cast("long")
    taken, ends = (["trip", "board_idx", "board_stop"], ["via"]) if named else ([], [])
    columns = [*_KEY, "trips", "arrival", *(["trip", "board_stop", "board_idx", "via"] if named else [])]

    def least(rows: DataFrame, more: list[str]) -> DataFrame:
        if not more:
            return rows.groupBy(*_KEY).agg(F.min("arrival").alias("arrival"))
        return rows.groupBy(*_KEY).agg(F.min(F.struct("arrival", *more)).alias("l")).select(*_KEY, "l.*")

    first = start.withColumn("trips", F.lit(0).cast("long"))
    for c in taken:
        first = first.withColumn(c, none)
    found = [first.select(*columns)]
    frontier, best = start.select(*_KEY, "arrival", none.alias("before")), start.select(*_KEY, F.col("arrival").alias("best"))
    target = queries.select("query_id", F.col("target").alias("stop")) if prune_targets else None
    k = 0
    while max_trips is None or k < max_trips:
        k += 1
        # what the label before could board was boarded then
        met = frontier.join(rides, "stop").where("ready >= arrival and (before is null or ready < before)")
        boarded = met.select("query_id", "trip", F.col("idx").alias("board_idx"), F.col("stop").alias("board_stop"), F.explode("later").alias("_h"))
        ride = least(boarded.select("query_id", F.col("_h.to").alias("stop"), F.col("_h.arr").alias("arrival"), *taken), taken)
        ride = ride.join(best, _KEY, "left").where("best is null or arrival < best").drop("best")
        if target is not None:
            limit = best.join(target, _KEY, "left_semi").select("query_id", F.col("best").alias("limit"))
            ride = ride.join(limit, "query_id", "left").where("limit is null or arrival < limit").drop("limit")
        ride = cut(ride)
        walk = walks.moved(ride, ["query_id"], "stop", "arrival", taken)
        both = ride.withColumn("via", none).unionByName(walk).select(*_KEY, "arrival", *taken, *ends)
        new = cut(least(both, ["trip", "board_stop", "board_idx", "via"] if named else []).join(best, _KEY, "left").where("best is null or arrival < best").withColumnRenamed("best", "before"))
        if not new.limit(1).count():
            break
        found.append(new.withColumn("trips", F.lit(k).cast("long")).select(*columns))
        # labels that weren't gone on with have boarded nothing
        frontier = new.select(*_KEY, "arrival", "before") if onward is None else onward(new).select(*_KEY, "arrival", none.alias("before"))
        best = cut(best.unionByName(new.select(*_KEY, F.col("arrival").alias("best"))).groupBy(*_KEY).agg(F.min("best").alias("best")))
    out = found[0]
    for x in found[1:]:
        out = out.unionByName(x)
    return out


def pareto(net: Network, queries: DataFrame, max_trips: int | None = None, **more) -> DataFrame:
    """(query_id, stop, trips, arrival): per stop the arrivals that more trips improve."""
    return labels(net, queries, max_trips, named=False, **more).select("query_id", "stop", "trips", "arrival")


def earliest(net: Network, queries: DataFrame, max_trips: int | None = None, **more) -> DataFrame:
    """(query_id, stop, arrival): the earliest arrival with any number of trips."""
    return pareto(net, queries, max_trips, **more).groupBy("query_id", "stop").agg(F.min("arrival").alias("arrival"))


def arrival_times(front: DataFrame, max_trips: int) -> DataFrame:
    """The front with a row for every number of trips up to ``max_trips``: a round inherits the one before."""
    k = F.explode(F.sequence(F.lit(0), F.lit(max_trips)).cast("array<long>"))
    grid = front.select("query_id", "stop").distinct().select("query_id", "stop", k.alias("trips"))
    order = Window.partitionBy("query_id", "stop").orderBy("trips")
    rows = grid.join(front, ["query_id", "stop", "trips"], "left")
    return rows.select("query_id", "stop", "trips", F.min("arrival").over(order).alias("arrival")).where("arrival is not null")


def unlimited(net: Network, roads: DataFrame | Hierarchy, sources: DataFrame | None = None) -> Hubs:
    """Walks of any length over ``roads`` between the network's stops, and from ``sources`` (id) to them, as ``walks`` of ``labels``."""
    h = roads if isinstance(roads, Hierarchy) else hierarchy(roads)
    return Hubs.between(h, net.stops.select(F.col("stop_id").alias("id")), sources)


def from_vertices(queries: DataFrame, walks: Hubs, stops: DataFrame) -> DataFrame:
    """Labels to begin with for queries from any vertex that ``walks`` leave from: all stops at their distance, as ``initial`` of ``labels``."""
    return initial_labels(queries, walks).join(stops.select(F.col("stop_id").alias("stop")), "stop", "left_semi").select(*_KEY, "arrival", "via")


def to_vertices(front: DataFrame, h: Hierarchy, queries: DataFrame | None = None) -> DataFrame:
    """One-to-all: (query_id, vertex, arrival) at all vertices of the roads, by a last walk from the best stop; ``queries`` adds the walk from the source itself."""
    begin = front.select("query_id", F.col("stop").alias("vertex"), "arrival")
    if queries is not None:
        begin = begin.unionByName(queries.select("query_id", F.col("source").alias("vertex"), F.col("dep_time").alias("arrival")))
    return sweep(h, begin, ["query_id"], "arrival")


def pareto_to_vertices(front: DataFrame, h: Hierarchy, queries: DataFrame) -> DataFrame:
    """One-to-all: (query_id, vertex, trips, arrival), at all vertices of the roads the arrivals that more trips improve.

    All numbers of trips are swept together, as keys of their own.
    """
    begin = front.select("query_id", "trips", F.col("stop").alias("vertex"), "arrival")
    begin = begin.unionByName(queries.select("query_id", F.lit(0).cast("long").alias("trips"), F.col("source").alias("vertex"), F.col("dep_time").alias("arrival")))
    rows = sweep(h, begin, ["query_id", "trips"], "arrival")
    fewer = F.min("arrival").over(Window.partitionBy("query_id", "vertex").orderBy("trips").rowsBetween(Window.unboundedPreceding, -1))
    return rows.withColumn("_fewer", fewer).where("_fewer is null or arrival < _fewer").select("query_id", "vertex", "trips", "arrival")


def to_targets(front: DataFrame, queries: DataFrame) -> DataFrame:
    """Only each query's own target."""
    return front.join(queries.select("query_id", F.col("target").alias("stop")), _KEY, "left_semi")


def to_sets(front: DataFrame, targets: DataFrame) -> DataFrame:
    """One-to-many: (set_id, query_id, stop, ...) for the stops of each target set (set_id, vertex)."""
    return front.join(targets.select("set_id", F.col("vertex").alias("stop")), "stop")


def legs(net: Network, found: DataFrame, wanted: DataFrame) -> DataFrame:
    """Journeys of ``wanted`` (query_id, stop, trips) out of labels: (query_id, stop, trips, leg, kind, from, to, dep, arr, trip).

    Legs count from the end.  A label's trip was boarded at a stop whose best label with fewer trips is the journey's rest.
    """
    now = wanted.select("query_id", F.col("stop").alias("goal"), F.col("trips").alias("total"), "stop", "trips")
    ev = net.events.select("trip", "idx", "stop", "arr", "dep")
    out = None
    most = found.agg(F.max("trips")).first()[0] or 0
    for step in range(int(most) + 1):
        prior = found.select("query_id", "stop", F.col("trips").alias("k"), "arrival", "trip", "board_stop", "board_idx", "via")
        pick = now.join(prior, ["query_id", "stop"]).where("k <= trips")
        last = pick.groupBy("query_id", "goal", "total", "stop").agg(F.max_by(F.struct("k", "arrival", "trip", "board_stop", "board_idx", "via"), "k").alias("l")).select("query_id", "goal", "total", "stop", "l.*")
        last = cut(last)
        if not last.limit(1).count():
            break
        alight = F.coalesce("via", "stop")
        ride_rows = last.where("trip is not null").withColumn("alight", alight)
        a = ev.select("trip", F.col("idx").alias("board_idx"), F.col("dep").alias("d"))
        b = ev.select("trip", F.col("idx").alias("i1"), F.col("stop").alias("alight"), F.col("arr").alias("a1"))
        rides = ride_rows.join(a, ["trip", "board_idx"]).join(b, ["trip", "alight"]).where("i1 > board_idx")
        one = rides.groupBy("query_id", "goal", "total").agg(F.min(F.struct(F.col("a1").alias("arr"), F.col("d").alias("dep"), "trip", "board_stop", "alight")).alias("r"))
        ride = one.select("query_id", "goal", "total", F.lit(2 * step + 1).alias("leg"), F.lit("trip").alias("kind"), F.col("r.board_stop").alias("from"), F.col("r.alight").alias("to"), F.col("r.dep").alias("dep"), F.col("r.arr").alias("arr"), F.col("r.trip").alias("trip"))
        walks = last.where("via is not null").join(net.edges, (F.col("via") == F.col("src")) & (F.col("stop") == F.col("dst")))
        walk = walks.select("query_id", "goal", "total", F.lit(2 * step).alias("leg"), F.lit("transfer").alias("kind"), F.col("via").alias("from"), F.col("stop").alias("to"), (F.col("arrival") - F.col("travel_time")).alias("dep"), F.col("arrival").alias("arr"), F.lit(None).cast("long").alias("trip"))
        legs_now = ride.unionByName(walk)
        out = legs_now if out is None else out.unionByName(legs_now)
        now = last.where("trip is not null").select("query_id", "goal", "total", F.col("board_stop").alias("stop"), (F.col("k") - 1).alias("trips"))
    return out.select("query_id", F.col("goal").alias("stop"), F.col("total").alias("trips"), "leg", "kind", "from", "to", "dep", "arr", "trip")


def journey_metrics(journey_legs: DataFrame) -> DataFrame:
    """Per journey: trips taken, total, initial and intermediate transfer time."""
    key = ["query_id", "stop", "trips"]
    last = F.max("leg").over(Window.partitionBy(*key))
    rows = journey_legs.withColumn("first_leg", F.col("leg") == last).withColumn("t", F.when(F.col("kind") == "transfer", F.col("arr") - F.col("dep")).otherwise(0))
    return rows.groupBy(*key).agg(
        F.count(F.when(F.col("kind") == "trip", 1)).alias("rides"),
        F.sum("t").alias("transfer_time"),
        F.sum(F.when(F.col("first_leg"), F.col("t")).otherwise(0)).alias("initial_transfer_time"),
        F.sum(F.when(~F.col("first_leg") & (F.col("leg") > 0), F.col("t")).otherwise(0)).alias("intermediate_transfer_time"),
    )


# -- the same relation in the oracle's SQL --------------------------------


def queries_sql(n: int, first: int = 0, last: int = 86_400) -> str:
    """hashed_queries as a SELECT over the CTE ``stops``."""
    return f"""SELECT i.query_id, s.stop_id AS source, t.stop_id AS target, CAST(i.query_id * 15485863 % {last - first} + {first} AS BIGINT) AS dep_time
FROM (SELECT CAST(range AS BIGINT) AS query_id FROM range({n})) i
JOIN (SELECT stop_id, row_number() OVER (ORDER BY stop_id) - 1 AS r FROM stops) s ON s.r = i.query_id * 7919 % (SELECT count(*) FROM stops)
JOIN (SELECT stop_id, row_number() OVER (ORDER BY stop_id) - 1 AS r FROM stops) t ON t.r = (i.query_id * 104729 + 1) % (SELECT count(*) FROM stops)"""


def rounds_sql(rounds: int) -> str:
    """CTEs a0 .. a<rounds> (improvements) and front (query_id, stop, trips, arrival), over stops, ev, edges and q."""
    parts = [
        "a0 AS MATERIALIZED (SELECT query_id, stop, min(arr) AS arr FROM (SELECT query_id, source AS stop, dep_time AS arr FROM q UNION ALL SELECT query_id, dst, dep_time + travel_time FROM q JOIN edges ON src = source) GROUP BY ALL)",
        "g0 AS (SELECT * FROM a0)",
    ]
    for k in range(1, rounds + 1):
        parts += [
            f"b{k} AS MATERIALIZED (SELECT a.query_id, e.trip, min(e.idx) AS idx FROM a{k - 1} a JOIN ev e ON e.stop = a.stop JOIN stops s ON s.stop_id = e.stop WHERE e.dep - s.min_transfer_time >= a.arr AND e.idx < e.n - 1 GROUP BY ALL)",
            f"r{k} AS MATERIALIZED (SELECT x.* FROM (SELECT b.query_id, e.stop, min(e.arr) AS arr FROM b{k} b JOIN ev e ON e.trip = b.trip AND e.idx > b.idx GROUP BY ALL) x LEFT JOIN g{k - 1} g ON g.query_id = x.query_id AND g.stop = x.stop WHERE g.arr IS NULL OR x.arr < g.arr)",
            f"a{k} AS MATERIALIZED (SELECT x.* FROM (SELECT query_id, stop, min(arr) AS arr FROM (SELECT * FROM r{k} UNION ALL SELECT query_id, dst, arr + travel_time FROM r{k} JOIN edges ON src = stop) GROUP BY ALL) x LEFT JOIN g{k - 1} g ON g.query_id = x.query_id AND g.stop = x.stop WHERE g.arr IS NULL OR x.arr < g.arr)",
            f"g{k} AS MATERIALIZED (SELECT query_id, stop, min(arr) AS arr FROM (SELECT * FROM g{k - 1} UNION ALL SELECT * FROM a{k}) GROUP BY ALL)",
        ]
    union = " UNION ALL ".join(f"SELECT query_id, stop, CAST({k} AS BIGINT) AS trips, arr AS arrival FROM a{k}" for k in range(rounds + 1))
    return ", ".join([*parts, f"front AS ({union})"])
