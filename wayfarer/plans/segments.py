"""Journeys as a search over trip segments that transfers between halts connect.

The frontier holds segments (query, trip, halts from ``begin`` to before
``until``).  A round takes the arrivals of all segments, walks on from those
that are improvements, and follows the transfers that leave from the segments'
halts.  What is reached of a line is a Pareto set of (number of the trip, halt):
an earlier trip reached at an earlier halt makes the rest of a later one
superfluous.  New segments and what was reached before are sorted together; a
segment ends where an earlier trip, or the same one, was reached already.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators.hierarchy import Hubs
from ..operators.triptransfers import as_of, numbered
from ..storage import cut
from .journeys import OneHop, initial_labels
from .network import Network

_KEY = ["query_id", "stop"]


def _reached(bag: DataFrame | None, offers: DataFrame, last: DataFrame) -> DataFrame:
    """The Pareto set of what is reached (query_id, line, no, begin, fresh), ``until`` being where each fresh segment ends."""
    columns = ["query_id", "line", "no", "begin"]
    both = offers.select(*columns, F.lit(True).alias("fresh"))
    if bag is not None:
        both = bag.select(*columns, F.lit(False).alias("fresh")).unionByName(both)
    order = Window.partitionBy("query_id", "line").orderBy("no", "begin", "fresh").rowsBetween(Window.unboundedPreceding, -1)
    rows = both.withColumn("least", F.min("begin").over(order)).where("least is null or begin < least")
    return rows.join(last, "line").select(*columns, "fresh", F.coalesce("least", "n").alias("until"))


def pareto_by_segments(net: Network, lines: DataFrame, transfers: DataFrame, queries: DataFrame, walks: OneHop | Hubs | None = None, max_trips: int | None = None) -> DataFrame:
    """(query_id, stop, trips, arrival): per stop the arrivals that more trips improve.

    ``lines``: (trip, line) without overtaking; ``transfers``: (from_trip, from_idx, to_trip, to_idx) as ``line_transfers`` or
    ``reduce_transfers`` give them.  ``walks``: how journeys begin and end, the network's edges if not given.
    """
    number = cut(numbered(net.events, lines))
    ev = cut(net.events.join(number, "trip").select("trip", "line", "no", "idx", "stop", "arr", "dep", "n"))
    last = cut(ev.groupBy("line").agg(F.max("n").alias("n")))
    edges = cut(transfers.select(F.col("from_trip").alias("trip"), F.col("from_idx").alias("at"), "to_trip", "to_idx"))
    walks = OneHop(cut(net.edges.select("src", "dst", "travel_time"))) if walks is None else walks
    start = cut(initial_labels(queries, walks).select(*_KEY, "arrival"))
    best, out, k = start, start.withColumn("trips", F.lit(0).cast("long")), 0
    # the first trip of each line at each halt near the source
    wait = net.stops.select(F.col("stop_id").alias("stop"), "min_transfer_time")
    halts = ev.where("idx < n - 1").select("line", "idx", "stop").distinct()
    ready = start.join(wait, "stop").join(halts, "stop").select("query_id", "line", "idx", (F.col("arrival") + F.col("min_transfer_time")).alias("ready"))
    first = as_of(ready, ev.where("idx < n - 1").select("line", "idx", "dep", "no"), ["line", "idx"], "ready", "dep", ["no"], 7200).where("no is not null")
    offers = first.select("query_id", "line", "no", (F.col("idx") + 1).alias("begin"))
    bag = cut(_reached(None, offers, last))
    names = ev.where("idx = 0").select("line", "no", "trip")
    while max_trips is None or k < max_trips:
        segments = cut(bag.where("fresh").join(names, ["line", "no"]).select("query_id", "trip", "begin", "until"))
        if not segments.limit(1).count():
            break
        k += 1
        ride = segments.join(ev.select("trip", "idx", "stop", "arr"), "trip").where("idx >= begin and idx < until").groupBy(*_KEY).agg(F.min("arr").alias("arrival"))
        old = best.select(*_KEY, F.col("arrival").alias("_best"))
        ride = cut(ride.join(old, _KEY, "left").where("_best is null or arrival < _best").drop("_best"))
        both = ride.unionByName(walks.moved(ride, ["query_id"], "stop", "arrival").select(*ride.columns)).groupBy(*_KEY).agg(F.min("arrival").alias("arrival"))
        new = cut(both.join(old, _KEY, "left").where("_best is null or arrival < _best").drop("_best"))
        out = out.unionByName(new.withColumn("trips", F.lit(k).cast("long")))
        best = cut(best.unionByName(new).groupBy(*_KEY).agg(F.min("arrival").alias("arrival")))
        onward = segments.join(edges, "trip").where("at >= begin and at < until").select("query_id", F.col("to_trip").alias("trip"), (F.col("to_idx") + 1).alias("begin"))
        onward = onward.groupBy("query_id", "trip").agg(F.min("begin").alias("begin")).join(number, "trip").select("query_id", "line", "no", "begin")
        bag = cut(_reached(bag, onward, last))
    return out.select(*_KEY, "trips", "arrival")
