"""Operators from network to network: clipping, cleaning, shifting, buffers, reversal, renumbering."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import in_box
from ..plans.network import Network
from ..storage import cut


def sequences(events: DataFrame) -> DataFrame:
    """A row per trip: its stops, arrivals and departures in order.  Trips are short, so an array holds one."""
    halt = F.array_sort(F.collect_list(F.struct("idx", "stop", "arr", "dep")))
    trips = events.groupBy("trip").agg(halt.alias("h"))
    return trips.select("trip", F.col("h.stop").alias("stops"), F.col("h.arr").alias("arrs"), F.col("h.dep").alias("deps"))


def from_sequences(trips: DataFrame) -> DataFrame:
    """The inverse of ``sequences``."""
    halts = trips.select("trip", F.size("stops").cast("long").alias("n"), F.posexplode(F.arrays_zip("stops", "arrs", "deps")).alias("idx", "h"))
    return halts.select("trip", F.col("idx").cast("long").alias("idx"), F.col("h.stops").alias("stop"), F.col("h.arrs").alias("arr"), F.col("h.deps").alias("dep"), "n")


def drop_dominated(events: DataFrame) -> DataFrame:
    """Without trips whose next one of the same stops (by departures, then arrivals) leaves no earlier and arrives no later anywhere."""
    trips = sequences(events)
    order = Window.partitionBy("stops").orderBy("deps", F.transform("arrs", lambda x: -x), "trip")
    follower = F.lead(F.struct("arrs", "deps")).over(order)
    trips = trips.withColumn("f", follower)
    later = F.forall(F.zip_with("deps", "f.deps", lambda a, b: b >= a), lambda x: x)
    sooner = F.forall(F.zip_with("arrs", "f.arrs", lambda a, b: b <= a), lambda x: x)
    bad = trips.where(F.col("f").isNotNull() & later & sooner).select("trip")
    return events.join(bad, "trip", "left_anti")


def validate(net: Network) -> Network:
    """Trips of two halts at known stops, none dominated; stops that are served; no transfer from or to vertices without any edge but loops."""
    known = net.stops.select(F.col("stop_id").alias("stop"))
    bad = net.events.join(known, "stop", "left_anti").select("trip").union(net.events.where("n < 2").select("trip")).distinct()
    events = drop_dominated(net.events.join(bad, "trip", "left_anti"))
    served = events.select(F.col("stop").alias("stop_id")).distinct()
    return Network(net.stops.join(served, "stop_id", "left_semi"), events, net.edges.where("src <> dst"))


def dense_ids(net: Network) -> DataFrame:
    """(stop_id, new_id): served stops first, both kinds in old order."""
    served = net.events.select(F.col("stop").alias("stop_id")).distinct().withColumn("served", F.lit(0))
    order = Window.orderBy("served", "stop_id")  # one row per stop
    rows = net.stops.select("stop_id").join(served, "stop_id", "left").withColumn("served", F.coalesce("served", F.lit(1)))
    return rows.select("stop_id", (F.row_number().over(order) - 1).cast("long").alias("new_id"))


def renumber(net: Network, mapping: DataFrame) -> Network:
    """Stops renamed by ``mapping`` (stop_id, new_id); what it doesn't name goes."""
    m = mapping.select("stop_id", "new_id")
    stops = net.stops.join(m, "stop_id").drop("stop_id").withColumnRenamed("new_id", "stop_id").select(*net.stops.columns)
    events = net.events.join(m.withColumnRenamed("stop_id", "stop"), "stop").drop("stop").withColumnRenamed("new_id", "stop").select(*net.events.columns)
    edges = net.edges
    for end in ("src", "dst"):
        edges = edges.join(m.withColumnRenamed("stop_id", end), end).drop(end).withColumnRenamed("new_id", end)
    return Network(stops, events, edges.select(*net.edges.columns))


def clip(net: Network, kept: DataFrame) -> Network:
    """Only the stops ``kept`` (stop_id): trips that halt anywhere else go entirely."""
    gone = net.events.join(kept.select(F.col("stop_id").alias("stop")), "stop", "left_anti").select("trip").distinct()
    edges = net.edges
    for end in ("src", "dst"):
        edges = edges.join(kept.select(F.col("stop_id").alias(end)), end, "left_semi")
    return Network(net.stops.join(kept.select("stop_id"), "stop_id", "left_semi"), net.events.join(gone, "trip", "left_anti"), edges)


def duplicate_trips(net: Network, offset: int = 86_400) -> Network:
    """Every trip once more, ``offset`` later; the copies' ids go on where the others end."""
    top = net.events.agg((F.max("trip") + 1).alias("top"))
    copy = net.events.crossJoin(F.broadcast(top)).select((F.col("trip") + F.col("top")).alias("trip"), "idx", "stop", (F.col("arr") + offset).alias("arr"), (F.col("dep") + offset).alias("dep"), "n")
    return net.replace(events=net.events.unionByName(copy))


def with_headway(net: Network, copies: int = 3, headway: int = 1800, lined: bool = False, times: Sequence[str] = ()) -> Network:
    """Every trip ``copies`` times, ``headway`` apart: lines with several trips.  New ids are old id x copies + number.

    ``lined``: events keep the old id as ``line``, by which they still lie together.  ``times``: more columns of times;
    whatever else stands beside the events is the same for all copies.
    """
    k = F.explode(F.sequence(F.lit(0), F.lit(copies - 1))).alias("_copy")
    later = lambda c: (F.col(c) + F.col("_copy") * headway).alias(c)
    known = ["trip", "idx", "stop", "arr", "dep", "n"]
    rest = [later(c) if c in times else F.col(c) for c in net.events.columns if c not in known]
    line = [F.col("trip").alias("line")] if lined else []
    rows = net.events.select("*", k)
    return net.replace(events=rows.select((F.col("trip") * copies + F.col("_copy")).alias("trip"), "idx", "stop", later("arr"), later("dep"), "n", *line, *rest))


def shift(net: Network, offset: int) -> Network:
    return net.replace(events=net.events.withColumns({c: F.col(c) + offset for c in ("arr", "dep")}))


def scale_times(net: Network, factor: float) -> Network:
    """All times times ``factor``, truncated."""
    f = lambda c: (F.col(c) * factor).cast("long")
    return Network(net.stops.withColumn("min_transfer_time", f("min_transfer_time")), net.events.withColumns({"arr": f("arr"), "dep": f("dep")}), net.edges.withColumn("travel_time", f("travel_time")))


def departure_buffers(net: Network, on: bool = True) -> Network:
    """Minimum transfer times taken out of departures (or put back)."""
    wait = net.stops.select(F.col("stop_id").alias("stop"), "min_transfer_time")
    sign = -1 if on else 1
    events = net.events.join(wait, "stop").withColumn("dep", F.col("dep") + sign * F.col("min_transfer_time"))
    return net.replace(events=events.select(*net.events.columns))


def arrival_buffers(net: Network, on: bool = True) -> Network:
    """Minimum transfer times added to arrivals (or taken off)."""
    wait = net.stops.select(F.col("stop_id").alias("stop"), "min_transfer_time")
    sign = 1 if on else -1
    events = net.events.join(wait, "stop").withColumn("arr", F.col("arr") + sign * F.col("min_transfer_time"))
    return net.replace(events=events.select(*net.events.columns))


def reverse(net: Network) -> Network:
    """Backwards in time: halts in reverse order, arrivals and departures swapped and negated, edges turned round."""
    events = net.events.select("trip", (F.col("n") - 1 - F.col("idx")).alias("idx"), "stop", (-F.col("dep")).alias("arr"), (-F.col("arr")).alias("dep"), "n")
    return net.replace(events=events, edges=net.edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "travel_time"))


def cap_speed(edges: DataFrame, cm: str, kmh: float, only_slower: bool = True) -> DataFrame:
    """Travel times of the length column ``cm`` at a speed; with ``only_slower`` never below the old ones."""
    new = (F.col(cm) / float(kmh) * 0.036).cast("long")
    return edges.withColumn("travel_time", F.greatest("travel_time", new) if only_slower else new)


def least_travel_time(edges: DataFrame, seconds: int) -> DataFrame:
    return edges.withColumn("travel_time", F.greatest("travel_time", F.lit(seconds).cast("long")))


def impassable_vertices(net: Network) -> DataFrame:
    """Edges in which a vertex that is no stop can't be passed through: it has one copy for entering and one, numbered behind all, for leaving."""
    top = net.edges.select(F.greatest("src", "dst").alias("v")).union(net.stops.select(F.col("stop_id").alias("v"))).agg((F.max("v") + 1).alias("top"))
    stop = net.stops.select(F.col("stop_id").alias("src"), F.lit(True).alias("at_stop"))
    rows = net.edges.join(stop, "src", "left").crossJoin(F.broadcast(top))
    return rows.select(F.when(F.col("at_stop"), F.col("src")).otherwise(F.col("src") + F.col("top")).alias("src"), "dst", "travel_time")


def overhead_graph(net: Network, overhead: int) -> DataFrame:
    """Edges of a transfer mode that costs ``overhead`` to take up: stops reach the mode's own copy of the graph only through it."""
    top = net.edges.select(F.greatest("src", "dst").alias("v")).union(net.stops.select(F.col("stop_id").alias("v"))).agg((F.max("v") + 1).alias("top"))
    rows = net.edges.crossJoin(F.broadcast(top)).select((F.col("src") + F.col("top")).alias("src"), (F.col("dst") + F.col("top")).alias("dst"), "travel_time")
    gates = net.stops.crossJoin(F.broadcast(top))
    take = gates.select(F.col("stop_id").alias("src"), (F.col("stop_id") + F.col("top")).alias("dst"), F.lit(overhead).cast("long").alias("travel_time"))
    leave = gates.select((F.col("stop_id") + F.col("top")).alias("src"), F.col("stop_id").alias("dst"), F.lit(0).cast("long").alias("travel_time"))
    return rows.unionByName(take).unionByName(leave)


def connections(events: DataFrame) -> DataFrame:
    """Elementary connections: every two neighbouring halts of a trip."""
    order = Window.partitionBy("trip").orderBy("idx")
    rows = events.withColumn("t", F.lead(F.struct("stop", "arr")).over(order)).where("t is not null")
    return rows.select(F.col("stop").alias("dep_stop"), F.col("t.stop").alias("arr_stop"), "dep", F.col("t.arr").alias("arr"), "trip")


def events_from_connections(conns: DataFrame) -> DataFrame:
    """Trips out of connections; a trip's first arrival is its departure, its last departure its arrival."""
    order = Window.partitionBy("trip").orderBy("dep", "arr", "dep_stop")
    rows = conns.withColumn("k", F.row_number().over(order) - 1).withColumn("before", F.lag("arr").over(order)).withColumn("m", F.count(F.lit(1)).over(Window.partitionBy("trip")))
    heads = rows.select("trip", F.col("k").alias("idx"), F.col("dep_stop").alias("stop"), F.coalesce("before", "dep").alias("arr"), "dep", (F.col("m") + 1).alias("n"))
    tails = rows.where("k = m - 1").select("trip", (F.col("k") + 1).alias("idx"), F.col("arr_stop").alias("stop"), "arr", F.col("arr").alias("dep"), (F.col("m") + 1).alias("n"))
    return heads.unionByName(tails).select("trip", F.col("idx").cast("long").alias("idx"), "stop", "arr", "dep", F.col("n").cast("long").alias("n"))


def bounding_box(points: DataFrame) -> DataFrame:
    """One row: the least box around points (lat, lon)."""
    return points.agg(F.min("lon").alias("min_lon"), F.min("lat").alias("min_lat"), F.max("lon").alias("max_lon"), F.max("lat").alias("max_lat"))


def clip_to_box(net: Network, places: DataFrame, box: tuple[float, float, float, float]) -> Network:
    """Only stops whose place (id, lat, lon) lies in the box, then whatever still is a valid network."""
    inside = places.where(in_box(F.col("lon"), F.col("lat"), box)).select(F.col("id").alias("stop_id"))
    return validate(clip(net, inside))


def clip_graph(edges: DataFrame, places: DataFrame, box: tuple[float, float, float, float]) -> DataFrame:
    """Only edges between vertices (id, lat, lon) in the box."""
    inside = places.where(in_box(F.col("lon"), F.col("lat"), box)).select("id")
    for end in ("src", "dst"):
        edges = edges.join(inside.withColumnRenamed("id", end), end, "left_semi")
    return edges


def network_from_connections(conns: DataFrame, edges: DataFrame, waits: DataFrame) -> Network:
    """A network of connections: stops are where these begin or end, with their wait (stop_id, name, min_transfer_time)."""
    ends = conns.select(F.col("dep_stop").alias("stop_id")).union(conns.select("arr_stop")).distinct()
    return Network(waits.join(ends, "stop_id", "left_semi"), events_from_connections(conns), edges)


def keep_component(net: Network, ids: DataFrame) -> Network:
    """The network on a component's vertices (id) alone; the same ids give a second network its twin."""
    return clip(net, ids.select(F.col("id").alias("stop_id")))


def ranked(rows: DataFrame, order: list) -> DataFrame:
    """``rows`` with ``place``, from 0 in a total order: ranges are sorted apart, and only their sizes meet."""
    dealt = cut(rows.repartitionByRange(*order).withColumn("_part", F.spark_partition_id()))
    sizes = dealt.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))  # a row per partition
    inner = F.row_number().over(Window.partitionBy("_part").orderBy(*order)) - 1
    placed = dealt.withColumn("_i", inner).join(F.broadcast(sizes.select("_part", before.alias("_before"))), "_part")
    return placed.withColumn("place", (F.col("_i") + F.col("_before")).cast("long")).drop("_part", "_i", "_before")


#: Orders of connections; each ends in all columns, so that it is total.
CONNECTION_ORDERS = {
    "ascending": ("dep", "arr", "dep_stop", "arr_stop", "trip"),
    "descending": ("-dep", "-arr", "-dep_stop", "-arr_stop", "-trip"),
    "by_departure": ("dep_stop", "dep", "arr", "arr_stop", "trip"),
    "by_arrival": ("arr_stop", "arr", "dep", "dep_stop", "trip"),
    "arrivals_first": ("arr", "dep", "arr_stop", "dep_stop", "trip"),
}


def sorted_connections(conns: DataFrame, order: str) -> DataFrame:
    """Connections with their place in one of ``CONNECTION_ORDERS``."""
    return ranked(conns, [F.col(c.lstrip("-")).desc() if c[0] == "-" else F.col(c) for c in CONNECTION_ORDERS[order]])


def combinable(pairs: DataFrame, net: Network) -> DataFrame:
    """Pairs of connections (arr_stop, arr, trip; next_stop, next_dep, next_trip) with whether the second can follow the first.

    On the same trip always; at the same stop after its wait; between stops by their transfer; never before the arrival.
    """
    wait = net.stops.select(F.col("stop_id").alias("arr_stop"), F.col("min_transfer_time").alias("_wait"))
    way = net.edges.groupBy(F.col("src").alias("arr_stop"), F.col("dst").alias("next_stop")).agg(F.min("travel_time").alias("_walk"))
    rows = pairs.join(wait, "arr_stop", "left").join(way, ["arr_stop", "next_stop"], "left")
    need = F.when(F.col("arr_stop") == F.col("next_stop"), F.col("_wait")).otherwise(F.col("_walk"))
    fits = (F.col("arr") <= F.col("next_dep")) & ((F.col("trip") == F.col("next_trip")) | F.coalesce(F.col("arr") + need <= F.col("next_dep"), F.lit(False)))
    return rows.withColumn("combinable", fits).drop("_wait", "_walk")
