"""From a feed to a network: service days, runs of trips, transfers; lines whose trips don't overtake."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..plans.network import Network
from ..sources.gtfs import WEEKDAYS
from ..storage import cut
from .graph import symmetric
from .transforms import sequences


def service_days(feed: dict[str, DataFrame], first: int, last: int, ignore_days: bool = False) -> DataFrame:
    """(service_id, day): active days between two days, counted from the earliest active day of all services.

    ``ignore_days``: every service of either table runs every day.
    """
    cal, dates = feed["calendar"], feed["calendar_dates"]
    if ignore_days:
        ids = cal.select("service_id").union(dates.select("service_id")).distinct()
        days = ids.select("service_id", F.explode(F.sequence(F.lit(first), F.lit(last))).alias("day"))
    else:
        span = cal.select("service_id", F.array(*WEEKDAYS).alias("runs"), F.greatest("start_day", F.lit(first)).alias("a"), F.least("end_day", F.lit(last)).alias("b")).where("a <= b")
        span = span.select("service_id", "runs", F.explode(F.sequence("a", "b")).alias("day"))
        usual = span.where(F.get("runs", F.dayofweek(F.date_from_unix_date("day")) - 1)).select("service_id", "day")
        inside = dates.where(F.col("day").between(first, last))
        gone = inside.where("not added").select("service_id", "day")
        days = usual.unionByName(inside.where("added").select("service_id", "day")).distinct().join(gone, ["service_id", "day"], "left_anti")
    start = days.agg(F.min("day").alias("start"))
    return days.crossJoin(F.broadcast(start)).select("service_id", (F.col("day") - F.col("start")).cast("long").alias("day"))


def trip_halts(stop_times: DataFrame) -> DataFrame:
    """(trip_id, halts): halts in order; equal times are pushed apart by a second each, and trips that travel back in time go.

    A trip's first arrival is a second before its departure, its last departure a second after its arrival.
    """
    rows = F.array_sort(F.collect_list(F.struct("seq", "arr", "dep", "stop_id")))
    trips = stop_times.groupBy("trip_id").agg(rows.alias("r"))
    fold = """aggregate(r, named_struct('off', 0L, 'last', cast(null as bigint), 'ok', true, 'out', cast(array() as array<struct<stop_id: string, arr: bigint, dep: bigint>>)),
      (s, x) -> element_at(transform(array(s.off + if(s.last = x.arr + s.off, 1L, 0L)), o -> named_struct(
        'off', o, 'last', x.dep + o, 'ok', s.ok and (s.last is null or s.last < x.arr + o),
        'out', concat(s.out, array(named_struct('stop_id', x.stop_id, 'arr', x.arr + o, 'dep', x.dep + o))))), 1))"""
    trips = trips.select("trip_id", F.expr(fold).alias("s")).where("s.ok").select("trip_id", F.col("s.out").alias("h"))
    edge = "transform(h, (x, i) -> named_struct('stop_id', x.stop_id, 'arr', if(i = 0, x.dep - 1, x.arr), 'dep', if(i = size(h) - 1, x.arr + 1, x.dep)))"
    return trips.where(F.size("h") > 1).select("trip_id", F.expr(edge).alias("halts"))


def from_feed(feed: dict[str, DataFrame], first: int, last: int, ignore_days: bool = False) -> Network:
    """The network of a feed between two days.  Trips are named by a hash of their id, day and run; stops are numbered by their ids."""
    days = service_days(feed, first, last, ignore_days)
    trips = feed["trips"].join(feed["routes"].select("route_id"), "route_id", "left_semi").join(days, "service_id").select("trip_id", "day")
    halts = trip_halts(feed["stop_times"]).join(trips, "trip_id")
    begin = F.col("halts")[0]["dep"]
    every = feed["frequencies"].select("trip_id", F.explode(F.sequence("start", "end", "headway")).alias("start"))
    runs = halts.join(every, "trip_id", "left").select("trip_id", "day", "halts", (F.coalesce(F.col("start") - begin, F.lit(0)) + F.col("day") * 86_400).cast("long").alias("shift"))
    named = runs.distinct().select(F.shiftrightunsigned(F.xxhash64("trip_id", "day", "shift"), 1).alias("trip"), F.size("halts").cast("long").alias("n"), "shift", F.posexplode("halts").alias("idx", "h"))
    order = Window.orderBy("stop_id")  # a row per stop
    served = named.select(F.col("h.stop_id").alias("stop_id")).distinct()
    ids = feed["stops"].join(served, "stop_id", "left_semi").select("stop_id", "stop_name", "lat", "lon", (F.row_number().over(order) - 1).cast("long").alias("id"))
    events = named.join(ids.select(F.col("stop_id").alias("name"), F.col("id").alias("stop")), F.col("h.stop_id") == F.col("name"))
    events = events.select("trip", F.col("idx").cast("long").alias("idx"), "stop", (F.col("h.arr") + F.col("shift")).alias("arr"), (F.col("h.dep") + F.col("shift")).alias("dep"), "n")
    ways = feed["transfers"].join(ids.select(F.col("stop_id").alias("from_stop_id"), F.col("id").alias("src")), "from_stop_id").join(ids.select(F.col("stop_id").alias("to_stop_id"), F.col("id").alias("dst")), "to_stop_id")
    wait = ways.where("src = dst").groupBy(F.col("src").alias("id")).agg(F.max("travel_time").alias("wait"))
    stops = ids.join(wait, "id", "left").select(F.col("id").alias("stop_id"), F.col("stop_name").alias("name"), F.coalesce("wait", F.lit(0)).cast("long").alias("min_transfer_time"), "lat", "lon")
    return Network(stops, events, symmetric(ways.where("src <> dst").select("src", "dst", "travel_time")))


def _first_fit(key: str):
    """Names each trip's line: rows come by key and in order, and take the first open line of their key whose last trip is nowhere later."""

    def fit(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, last, names = None, np.zeros((0, 0)), []
        for rows in frames:
            out = np.zeros(len(rows), np.int64)
            for i, (trip, here, arrs, deps) in enumerate(zip(rows["trip"], rows[key], rows["arrs"], rows["deps"], strict=True)):
                times = np.concatenate([arrs, deps])
                if now is None or not np.array_equal(here, now):
                    now, last, names = here, np.zeros((0, len(times)), np.int64), []
                fits = (last[: len(names)] <= times).all(1)
                line = int(fits.argmax()) if fits.any() else len(names)
                if line == len(names):
                    names.append(trip)
                    if line == len(last):  # room for as many lines again
                        last = np.concatenate([last, np.zeros((max(4, len(last)), len(times)), np.int64)])
                last[line] = times
                out[i] = names[line]
            yield pd.DataFrame({"trip": rows["trip"], "line": out})

    return fit


def fifo_lines(events: DataFrame) -> DataFrame:
    """(trip, line): trips of one stop sequence in lines whose trips never overtake, by first fit in order of departures.

    Trips stream through sorted by their stops and departures; a task holds the last times of one sequence's open lines only.  A line is named by its first trip.
    """
    order = ["stops", "deps", F.transform("arrs", lambda x: -x), "trip"]
    return sequences(events).repartition("stops").sortWithinPartitions(*order).mapInPandas(_first_fit("stops"), "trip long, line long")


def rebuilt_lines(late: DataFrame, trips: DataFrame) -> DataFrame:
    """(trip, line, no, overflow): lines (trip, line, no) whose trips overtake each other in the events ``late``, put in order again.

    A trip that the next one of its line overtakes leaves it, until no trip of a line does; those that left form overflow
    lines by first fit in their old order, named by their first trips.  ``overflow`` is null for trips that stay.
    """
    rows = cut(late.join(trips, "trip").select("trip", "line", "no", "idx", "arr", "dep"))
    gone, stay = None, rows
    while True:
        order = Window.partitionBy("line", "idx").orderBy("no")
        beaten = stay.withColumn("_n", F.lead(F.struct("arr", "dep")).over(order)).where("_n.arr < arr or _n.dep < dep").select("trip").distinct()
        beaten = cut(beaten)
        if not beaten.limit(1).count():
            break
        gone = beaten if gone is None else cut(gone.unionByName(beaten))
        stay = cut(stay.join(beaten, "trip", "left_anti"))
    none = F.lit(None).cast("long")
    if gone is None:
        return trips.select("trip", "line", "no", none.alias("overflow"))
    times = rows.join(gone, "trip").groupBy("trip", "line", "no").agg(F.sort_array(F.collect_list(F.struct("idx", "arr", "dep"))).alias("h"))  # a trip's halts
    times = times.select("trip", "line", "no", F.col("h.arr").alias("arrs"), F.col("h.dep").alias("deps"))
    new = times.repartition("line").sortWithinPartitions("line", "no").mapInPandas(_first_fit("line"), "trip long, line long").withColumnRenamed("line", "overflow")
    return trips.join(new, "trip", "left").select("trip", "line", "no", "overflow")


def event_order(events: DataFrame, lines: DataFrame) -> DataFrame:
    """(trip, idx, place): events numbered line by line, those of overflow lines (trip, line, no, overflow) behind all others.

    A line's first place is the sum of what stands before it: a sum over lines, not over events.
    """
    rows = lines.withColumn("_o", F.col("overflow").isNotNull())
    first = rows.where("_o").groupBy("line", "overflow").agg(F.min("no").alias("_first"))
    rows = rows.join(first, ["line", "overflow"], "left")
    size = events.groupBy("trip").agg(F.count(F.lit(1)).alias("_k"))
    rows = rows.join(size, "trip")
    key = ["_o", "line", "_first"]
    total = rows.groupBy(*key).agg(F.sum("_k").alias("_t"))
    before = total.withColumn("_before", F.coalesce(F.sum("_t").over(Window.orderBy(*key).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("_t")  # a row for each line
    inner = F.coalesce(F.sum("_k").over(Window.partitionBy(*key).orderBy("no").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    placed = rows.withColumn("_in", inner)
    placed = placed.join(before.select(F.col("_o").alias("_bo"), F.col("line").alias("_bl"), F.col("_first").alias("_bf"), "_before"), (F.col("_o") == F.col("_bo")) & (F.col("line") == F.col("_bl")) & F.col("_first").eqNullSafe(F.col("_bf")))
    return events.select("trip", "idx").join(placed.select("trip", (F.col("_before") + F.col("_in")).alias("_at")), "trip").select("trip", "idx", (F.col("_at") + F.col("idx")).cast("long").alias("place"))


def overtaking(events: DataFrame, lines: DataFrame) -> DataFrame:
    """(line, trip, next_trip): neighbours of a line of which the later one is earlier somewhere."""
    rows = sequences(events).join(lines, "trip")
    order = Window.partitionBy("line").orderBy("deps", F.transform("arrs", lambda x: -x), "trip")
    rows = rows.withColumn("next", F.lead(F.struct("trip", "arrs", "deps")).over(order)).where("next is not null")
    early = lambda c: F.exists(F.zip_with(c, f"next.{c}", lambda a, b: b < a), lambda x: x)
    return rows.where(early("arrs") | early("deps")).select("line", "trip", F.col("next.trip").alias("next_trip"))
