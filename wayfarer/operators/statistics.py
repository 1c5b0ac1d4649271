"""Aggregates over networks and query results."""

from __future__ import annotations

from collections.abc import Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import geo_distance_cm
from ..plans.network import Network
from ..storage import cut, spread
from .transforms import connections, sequences
from .triptransfers import with_times

#: Upper ends of the headway classes, in minutes.
HEADWAY_MINUTES = (5, 10, 20, 30, 60, 120, 240)


def least_time_graph(net: Network) -> DataFrame:
    """Fastest way from stop to stop by one ride between neighbouring halts, or one transfer."""
    rides = connections(net.events).select(F.col("dep_stop").alias("src"), F.col("arr_stop").alias("dst"), (F.col("arr") - F.col("dep")).alias("travel_time"))
    both = rides.unionByName(net.edges.select("src", "dst", "travel_time"))
    return both.where("src <> dst").groupBy("src", "dst").agg(F.min("travel_time").alias("travel_time"))


def least_time_all_pairs(net: Network) -> DataFrame:
    """The same with all pairs of halts of a trip."""
    a = net.events.select("trip", F.col("idx").alias("i"), F.col("stop").alias("src"), "dep")
    b = net.events.select("trip", F.col("idx").alias("j"), F.col("stop").alias("dst"), "arr")
    rides = a.join(b, "trip").where("i < j").select("src", "dst", (F.col("arr") - F.col("dep")).alias("travel_time"))
    return rides.unionByName(net.edges.select("src", "dst", "travel_time")).where("src <> dst").groupBy("src", "dst").agg(F.min("travel_time").alias("travel_time"))


def average_time_graph(net: Network, first: int, last: int) -> DataFrame:
    """Mean over departure times in [first, last) of waiting and riding to a neighbouring halt, or of the transfer where that is faster.

    Between two departures of an edge the travel time falls by a second each second; so every piece is an integral
    of a line capped by the transfer time.
    """
    rides = connections(net.events).select(F.col("dep_stop").alias("src"), F.col("arr_stop").alias("dst"), "dep", "arr").where(F.col("dep") >= first)
    rides = spread(cut(rides), "src", "dst")
    # a later departure that arrives no later makes an earlier one useless
    later = Window.partitionBy("src", "dst").orderBy(F.desc("dep"), "arr").rowsBetween(Window.unboundedPreceding, -1)
    rides = rides.withColumn("beat", F.min("arr").over(later)).where("beat is null or arr < beat").drop("beat")
    order = Window.partitionBy("src", "dst").orderBy("dep")
    rides = rides.withColumn("begin", F.least(F.greatest(F.coalesce(F.lag("dep").over(order), F.lit(first)), F.lit(first)), F.lit(last))).withColumn("stop", F.least("dep", F.lit(last)))
    walk = net.edges.groupBy("src", "dst").agg(F.min("travel_time").alias("walk"))
    rows = rides.join(walk, ["src", "dst"], "left")
    hi, lo = F.col("arr") - F.col("begin"), F.col("arr") - F.col("stop")
    plain = (hi * hi - lo * lo) / 2
    w = F.col("walk")
    capped = F.when(w.isNull() | (hi <= w), plain).when(lo >= w, w * (hi - lo)).otherwise(w * (hi - w) + (w * w - lo * lo) / 2)
    total = rows.groupBy("src", "dst").agg(F.sum(capped).alias("area"), F.sum(F.col("stop") - F.col("begin")).alias("length"), F.first("walk").alias("walk"))
    rest = F.lit(last - first) - F.col("length")
    full = total.withColumn("area", F.when((rest > 0) & F.col("walk").isNotNull(), F.col("area") + rest * F.col("walk")).otherwise(F.col("area"))).withColumn("length", F.when(F.col("walk").isNotNull(), F.lit(last - first)).otherwise(F.col("length")))
    rode = full.where("length > 0").select("src", "dst", (F.col("area") / F.col("length")).alias("average_time"))
    only = walk.join(rode.select("src", "dst"), ["src", "dst"], "left_anti").select("src", "dst", F.col("walk").cast("double").alias("average_time"))
    return rode.unionByName(only)


def report(net: Network) -> DataFrame:
    """One row about a network."""
    e = net.events.agg(F.count_distinct("trip").alias("trips"), F.count(F.lit(1)).alias("events"), F.count_distinct("stop").alias("served_stops"), F.min("dep").alias("first_departure"), F.max("arr").alias("last_arrival"))
    s = net.stops.agg(F.count(F.lit(1)).alias("stops"), F.max("min_transfer_time").alias("longest_buffer"))
    g = net.edges.agg(F.count(F.lit(1)).alias("transfers"), F.max("travel_time").alias("longest_transfer"))
    return s.crossJoin(e).crossJoin(g)  # of one row each


def events_per_stop(net: Network) -> DataFrame:
    return net.stops.join(net.events.groupBy(F.col("stop").alias("stop_id")).agg(F.count(F.lit(1)).alias("k")), "stop_id", "left").select("stop_id", F.coalesce("k", F.lit(0)).alias("events"))


def events_per_day(events: DataFrame, days: int = 14) -> DataFrame:
    """Departures of each of the first service days."""
    return events.where((F.col("dep") >= 0) & (F.col("dep") < days * 86_400)).groupBy(F.floor(F.col("dep") / 86_400).cast("long").alias("day")).agg(F.count(F.lit(1)).alias("events"))


def patterns(net: Network) -> DataFrame:
    """(pattern, stops, trips): the distinct stop sequences, named by their smallest trip."""
    return sequences(net.events).groupBy("stops").agg(F.min("trip").alias("pattern"), F.count(F.lit(1)).alias("trips"))


def headways(net: Network, by: DataFrame | None = None) -> DataFrame:
    """Per headway class: lines and their share.  A line is a stop sequence with several trips on the first day; ``by``: (trip, route) instead."""
    if by is None:
        own = sequences(net.events)
        by = own.select("trip", F.min("trip").over(Window.partitionBy("stops")).alias("route"))
    start = net.events.where("idx = 0 and dep <= 86400").select("trip", "dep").join(by, "trip")
    lines = start.groupBy("route").agg(F.count(F.lit(1)).alias("n"), F.min("dep").alias("a"), F.max("dep").alias("b")).where("n > 1")
    headway = (F.col("b") - F.col("a")) / (F.col("n") - 1)
    bucket: Column = F.lit(len(HEADWAY_MINUTES))
    for k in reversed(range(len(HEADWAY_MINUTES))):
        bucket = F.when(headway <= HEADWAY_MINUTES[k] * 60, k).otherwise(bucket)
    counted = lines.groupBy(bucket.cast("long").alias("bucket")).agg(F.count(F.lit(1)).alias("lines"))
    return counted.withColumn("share", F.col("lines") / F.sum("lines").over(Window.partitionBy()))  # over the classes


def percentiles(rows: DataFrame, column: str, points: Sequence[float]) -> DataFrame:
    """One row per point: exact, between neighbours in proportion."""
    got = rows.agg(F.percentile(column, F.array(*map(F.lit, points))).alias("v"))
    return got.select(F.posexplode("v").alias("k", "value")).select(F.element_at(F.array(*map(F.lit, points)), F.col("k") + 1).alias("point"), "value")


def transfer_slacks(transfers: DataFrame, net: Network) -> DataFrame:
    """(from_trip, from_idx, to_trip, to_idx, slack) of event transfers: waiting time beyond the transfer's travel time."""
    return with_times(transfers, net).select("from_trip", "from_idx", "to_trip", "to_idx", (F.col("_to_dep") - F.col("_from_arr") - F.col("travel_time")).alias("slack"))


def query_statistics(found: DataFrame, exact: DataFrame, queries: DataFrame) -> DataFrame:
    """One row: queries, those without an answer although there is one, those with a later arrival, mean and greatest relative detour."""
    key = ["query_id", "stop"]
    best = lambda f, name: f.groupBy(*key).agg(F.min("arrival").alias(name))
    rows = best(exact, "exact").join(best(found, "found"), key, "left").join(queries.select("query_id", "dep_time"), "query_id")
    detour = (F.col("found") - F.col("dep_time")) / F.greatest(F.col("exact") - F.col("dep_time"), F.lit(1)) - 1
    return rows.agg(F.count(F.lit(1)).alias("journeys"), F.sum(F.col("found").isNull().cast("long")).alias("failed"), F.sum((F.col("found") > F.col("exact")).cast("long")).alias("later"), F.avg(detour).alias("mean_detour"), F.max(detour).alias("greatest_detour"))


def journeys_per_query(front: DataFrame) -> DataFrame:
    """One row: mean number of Pareto-optimal journeys of a query to a stop."""
    return front.groupBy("query_id", "stop").agg(F.count(F.lit(1)).alias("k")).agg(F.avg("k").alias("journeys"))


def two_smallest(rows: DataFrame, keys: Sequence[str], column: str) -> DataFrame:
    """The smallest and second smallest value of each key."""
    order = Window.partitionBy(*keys).orderBy(column)
    ranked = rows.withColumn("_k", F.row_number().over(order)).where("_k <= 2")
    return ranked.groupBy(*keys).agg(F.min(column).alias("smallest"), F.max(F.when(F.col("_k") == 2, F.col(column))).alias("second"))


def route_extremes(net: Network, places: DataFrame) -> DataFrame:
    """Per stop with a later halt: the greatest distance in kilometres, speed, and distance times speed, to a later halt of a trip through it.  ``places``: (id, lat, lon)."""
    at = places.select(F.col("id").alias("stop"), "lat", "lon")
    here = net.events.join(at, "stop").select("trip", "stop", F.col("idx").alias("i"), "dep", "lat", "lon")
    there = net.events.join(at, "stop").select("trip", F.col("idx").alias("j"), "arr", F.col("lat").alias("lat2"), F.col("lon").alias("lon2"))
    rows = here.join(there, "trip").where("i < j")
    km = geo_distance_cm(F.col("lat"), F.col("lon"), F.col("lat2"), F.col("lon2")) / 100_000.0
    rows = rows.withColumn("km", km).withColumn("speed", F.col("km") / (F.col("arr") - F.col("dep")))
    return rows.groupBy("stop").agg(F.max("km").alias("distance"), F.max("speed").alias("speed"), F.max(F.col("km") * F.col("speed")).alias("speed_distance"))


def feasibility(transfers: DataFrame) -> DataFrame:
    """One row about transfers with ``holds`` and ``slack``: how many, how many fail, the mean and worst slack of these."""
    bad = F.when(~F.col("holds"), F.col("slack"))
    return transfers.agg(F.count(F.lit(1)).alias("transfers"), F.count(bad).alias("failing"), F.avg(bad).alias("mean_slack"), F.min(bad).alias("worst_slack"))


def feasibility_of_counts(held: DataFrame) -> DataFrame:
    """The same of transfers that are counted already: (holds, transfers, slack, worst), slacks being summed and the least one."""
    bad = lambda c: F.when(~F.col("holds"), F.col(c))
    total = held.agg(F.coalesce(F.sum("transfers"), F.lit(0)).alias("transfers"), F.coalesce(F.sum(bad("transfers")), F.lit(0)).alias("failing"), F.sum(bad("slack")).alias("_slack"), F.min(bad("worst")).alias("worst_slack"))
    return total.select("transfers", "failing", F.when(F.col("failing") > 0, F.col("_slack") / F.col("failing")).alias("mean_slack"), "worst_slack")


def counted_slacks(found: pa.Table) -> pa.Table:
    """(slack, transfers) of transfers with ``_from_arr`` and ``_to_dep``: those that aren't missed, by their waiting time beyond the travel time."""
    slack = found.column("_to_dep").to_numpy() - found.column("_from_arr").to_numpy() - found.column("travel_time").to_numpy()
    counts = pa.table({"slack": slack[slack >= 0]}).group_by("slack").aggregate([([], "count_all")])
    return counts.select(["slack", "count_all"]).rename_columns(["slack", "transfers"])


def update_statistics(updates: DataFrame) -> DataFrame:
    """Per reveal time: updates, trips, mean and greatest delay."""
    return updates.groupBy("reveal_time").agg(F.count(F.lit(1)).alias("updates"), F.count_distinct("trip").alias("trips"), F.avg("delay").alias("mean_delay"), F.max("delay").alias("greatest_delay"))
