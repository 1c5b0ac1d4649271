"""Shortcuts for walks between trips when arrival and transfer time both count, and searches over them.

As for shortcuts of the earliest arrival there is a run for every stop and time
at which a trip can be boarded there.  A candidate is a ride with a trip of that
very time, a walk of any length, and a ride with the first trip of a line.  It
is needed unless another journey of two trips at most from the run's stop and
time, its walks at the start included, is as good in arrival and transfer time
and better in one of them.  Equal ones all stay: of all best journeys with equal
values, the one that is earliest from its end backwards consists of candidates
that nothing beats.

Candidates come first, for they are few: what they reach at the latest, and the
most that they walk, bounds the search for witnesses.  A walk after the second
ride is no witness here; a missed one costs a superfluous shortcut, never a
wrong journey.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators.hierarchy import Hubs
from ..operators.skyline import merged_front, skyline
from ..operators.triptransfers import as_of, numbered
from ..storage import cut
from .multicriteria import pareto_sets
from .network import Network

_KEY = ["query_id", "stop"]
_VALUE = ["arrival", "t_walk"]
#: Width of time by which the trips of a line's halt are split.
_SLOT = 7200


def undominated(rows: DataFrame, by: DataFrame | None, keys: Sequence[str], criteria: Sequence[str]) -> DataFrame:
    """``rows`` that no other row and no row of ``by`` beats, that is as good in both criteria and better in one; equal ones stay.

    One sort of both tables together.
    """
    first, second = criteria
    named = [*keys, *criteria]
    rest = F.struct(F.lit(True).alias("_own"), *(c for c in rows.columns if c not in named)).alias("_rest")
    both = rows.select(*named, rest)
    if by is not None:
        both = both.unionByName(by.select(*named, F.lit(None).cast(both.schema["_rest"].dataType).alias("_rest")))
    before = Window.partitionBy(*keys).orderBy(first).rangeBetween(Window.unboundedPreceding, -1)
    both = both.withColumn("_before", F.min(second).over(before)).withColumn("_beside", F.min(second).over(Window.partitionBy(*keys, first)))
    kept = both.where(F.col("_rest").isNotNull() & (F.col("_before").isNull() | (F.col("_before") > F.col(second))) & (F.col("_beside") >= F.col(second)))
    return kept.select(*(c if c in named else F.col(f"_rest.{c}").alias(c) for c in rows.columns))


class _Timetable:
    """The tables that every step reads, made once."""

    def __init__(self, net: Network, lines: DataFrame):
        number = numbered(net.events, lines)
        self.events = cut(net.events.join(number, "trip").select("trip", "line", "no", "idx", "stop", "arr", "dep", "n"))
        self.wait = net.stops.select(F.col("stop_id").alias("stop"), "min_transfer_time")
        self.board = self.events.where("idx < n - 1")
        self.halts = cut(self.board.select("line", "idx", "stop").distinct())

    def first_trips(self, rows: DataFrame, carried: Sequence[str]) -> DataFrame:
        """(query_id, trip, idx, carried): of each line around the trip that labels (query_id, stop, arrival, carried) reach first."""
        ready = rows.join(self.wait, "stop").join(self.halts, "stop")
        ready = cut(ready.select("query_id", "line", "idx", (F.col("arrival") + F.col("min_transfer_time")).alias("ready"), *carried))
        if not ready.limit(1).count():
            return ready.select("query_id", F.lit(None).cast("long").alias("trip"), "idx", *carried)
        found = as_of(ready, self.board.select("line", "idx", "dep", "no", "trip"), ["line", "idx"], "ready", "dep", ["no", "trip"], _SLOT)
        return found.where("trip is not null").select("query_id", "trip", "idx", *carried)

    def ridden(self, boarded: DataFrame, carried: Sequence[str]) -> DataFrame:
        """(query_id, stop, arrival, at, carried): where trips boarded at halt ``idx`` stop afterwards."""
        later = self.events.select("trip", F.col("idx").alias("at"), "stop", F.col("arr").alias("arrival"))
        return boarded.join(later, "trip").where("at > idx").select(*_KEY, "arrival", "at", *carried)


def _begin(queries: DataFrame, walks: Hubs) -> DataFrame:
    """Labels without a trip: the source, and all stops at their distance."""
    start = queries.select("query_id", F.col("source").alias("stop"), F.col("dep_time").alias("arrival"), F.lit(0).cast("long").alias("t_walk"))
    return cut(skyline(start.unionByName(_walked(start, walks, ["query_id"])), _KEY, _VALUE))


def _walked(rows: DataFrame, walks: Hubs, key: Sequence[str]) -> DataFrame:
    return walks.moved(rows, key, "stop", "arrival", costs=["t_walk"]).select(*key, "stop", *_VALUE)


def event_shortcuts(net: Network, lines: DataFrame, walks: Hubs) -> DataFrame:
    """(from_trip, from_idx, from_stop, to_trip, to_idx, to_stop, travel_time): changes between trips that journeys best in arrival, trips and transfer time need.

    ``lines``: (trip, line) without overtaking.
    """
    table = _Timetable(net, lines)
    # a run for every stop and time, numbered by them
    boarded = net.boardable().select((F.col("stop") * F.lit(2**32) + F.col("ready") + F.lit(2**31)).alias("query_id"), "stop", "ready", "trip", "idx")
    run = cut(boarded.select("query_id", F.col("stop").alias("source"), F.col("ready").alias("dep_time")).distinct())
    begin = _begin(run, walks)

    # candidates
    one = table.ridden(boarded.select("query_id", "trip", "idx"), ["trip"]).select("query_id", F.col("trip").alias("from_trip"), F.col("at").alias("from_idx"), F.col("stop").alias("from_stop"), "stop", "arrival", F.lit(0).cast("long").alias("t_walk"))
    left = ["query_id", "from_trip", "from_idx", "from_stop"]
    far = _walked(one, walks, left).groupBy(*left, "stop").agg(F.min("arrival").alias("arrival"), F.min("t_walk").alias("t_walk"))
    mid = cut(undominated(one.unionByName(far.select(*one.columns)), begin, _KEY, _VALUE))
    from_ = ["from_trip", "from_idx", "from_stop", "t_walk"]
    two = table.first_trips(mid, [*from_, "stop"]).withColumnRenamed("stop", "to_stop").where("trip <> from_trip or idx < from_idx")
    two = undominated(two, None, ["query_id", "trip"], ["idx", "t_walk"])
    end = table.ridden(two.withColumn("to_idx", F.col("idx")), [*from_, "trip", "to_idx", "to_stop"]).drop("at")
    end = cut(undominated(end, begin, _KEY, _VALUE))

    # witnesses, no later and no longer walks than the candidates of their run
    limit = cut(end.groupBy("query_id").agg(F.max("arrival").alias("_latest"), F.max("t_walk").alias("_most")))
    bounded = lambda rows: rows.join(limit, "query_id").where("arrival <= _latest and t_walk <= _most").select(*_KEY, *_VALUE)
    best = bounded(begin)
    for k in (1, 2):
        board = skyline(table.first_trips(best, ["t_walk"]), ["query_id", "trip"], ["idx", "t_walk"])
        ride = cut(skyline(bounded(table.ridden(board, ["t_walk"])), _KEY, _VALUE))
        more = ride if k == 2 else ride.unionByName(bounded(_walked(ride, walks, ["query_id"])))
        best = cut(skyline(best.unionByName(more), _KEY, _VALUE))
    need = undominated(end, best, _KEY, _VALUE)
    return cut(need.select("from_trip", "from_idx", "from_stop", F.col("trip").alias("to_trip"), "to_idx", "to_stop", F.col("t_walk").alias("travel_time")).distinct())


def stop_shortcuts(events: DataFrame) -> DataFrame:
    """(src, dst, travel_time): the walks among ``event_shortcuts``."""
    return events.where("from_stop <> to_stop").select(F.col("from_stop").alias("src"), F.col("to_stop").alias("dst"), "travel_time").distinct()


def with_last_walk(front: DataFrame, walks: Hubs) -> DataFrame:
    """The front (query_id, stop, trips, arrival, t_walk) after a last walk from wherever it is; all numbers of trips at once, as a third criterion."""
    rows = front.unionByName(_walked(front, walks, ["query_id", "trips"]).select(*front.columns))
    return merged_front(rows.limit(0), rows, _KEY, ["trips", *_VALUE]).select(*_KEY, "trips", *_VALUE)


def sets_over_shortcuts(net: Network, queries: DataFrame, walks: Hubs, shortcuts: DataFrame) -> DataFrame:
    """(query_id, stop, trips, arrival, t_walk): walks between trips are ``shortcuts`` (src, dst, travel_time) only, first and last ones of any length."""
    edges = shortcuts.select("src", "dst", "travel_time", F.col("travel_time").alias("t_walk"))
    return with_last_walk(pareto_sets(net, queries, edges, initial=_begin(queries, walks)), walks)


def earliest_of(sets: DataFrame) -> DataFrame:
    """(query_id, stop, trips, arrival): of Pareto sets the arrivals that more trips improve, whatever is walked."""
    best = sets.groupBy(*_KEY, "trips").agg(F.min("arrival").alias("arrival"))
    fewer = F.min("arrival").over(Window.partitionBy(*_KEY).orderBy("trips").rowsBetween(Window.unboundedPreceding, -1))
    return best.withColumn("_fewer", fewer).where("_fewer is null or arrival < _fewer").drop("_fewer")


def sets_by_segments(net: Network, lines: DataFrame, transfers: DataFrame, queries: DataFrame, walks: Hubs, max_trips: int | None = None) -> DataFrame:
    """(query_id, stop, trips, arrival, t_walk) by a search from trip to trip along ``event_shortcuts``; first and last walks are of any length.

    What is reached of a trip is a Pareto set of the halt where it is boarded and the time walked until then.
    """
    table = _Timetable(net, lines)
    edges = cut(transfers.select(F.col("from_trip").alias("trip"), F.col("from_idx").alias("at"), "to_trip", "to_idx", "travel_time"))
    trip, reach = ["query_id", "trip"], ["idx", "t_walk"]
    bag = _begin(queries, walks)
    board = cut(skyline(table.first_trips(bag, ["t_walk"]), trip, reach))
    reached, out, k = board, [bag.withColumn("trips", F.lit(0).cast("long"))], 0
    while (max_trips is None or k < max_trips) and board.limit(1).count():
        k += 1
        # what another label beats where a trip stops leads to nothing that the other one doesn't
        rides = cut(undominated(table.ridden(board, ["t_walk", "trip"]), bag, _KEY, _VALUE))
        ride = merged_front(bag, rides.select(*_KEY, *_VALUE), _KEY, _VALUE).where("fresh").drop("fresh")
        both = cut(merged_front(bag, ride.unionByName(_walked(ride, walks, ["query_id"])), _KEY, _VALUE))
        out.append(both.where("fresh").drop("fresh").withColumn("trips", F.lit(k).cast("long")))
        bag = both.drop("fresh")
        onward = rides.join(edges, ["trip", "at"]).select("query_id", F.col("to_trip").alias("trip"), F.col("to_idx").alias("idx"), (F.col("t_walk") + F.col("travel_time")).alias("t_walk"))
        both = cut(merged_front(reached, onward, trip, reach))
        board, reached = both.where("fresh").drop("fresh"), both.drop("fresh")
    return reduce(DataFrame.unionByName, out).select(*_KEY, "trips", *_VALUE)
