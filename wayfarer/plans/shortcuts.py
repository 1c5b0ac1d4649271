"""Shortcuts for walks between trips: which of all walks of any length journeys need.

From every halt one may walk any length and take the first trip of each line
there.  Of these changes a trip needs those that lead somewhere sooner than it
does by staying seated or by its other changes, walks of any length behind them
included (``line_transfers`` with ``sooner``).  They are found in groups of a
line's trips, so the work grows with the trips and what lies around them, not
with a search from every stop at every time.  Other witnesses, such as journeys
that begin with another trip, aren't looked for; a missed one costs a
superfluous shortcut, never a wrong journey.  First and last walks are found by
searches themselves, through hubs.

Shortcuts between halts are these changes; those between stops their walks.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators.assembly import fifo_lines
from ..operators.hierarchy import Hubs, hub_distances
from ..operators.triptransfers import line_transfers
from ..storage import cut
from .journeys import OneHop, initial_labels, labels
from .network import Network

_KEY = ["query_id", "stop"]


def event_shortcuts(net: Network, walks: Hubs, lines: DataFrame | None = None) -> DataFrame:
    """(from_trip, from_idx, from_stop, to_trip, to_idx, to_stop, travel_time): changes between trips that journeys need, those at a stop among them.

    ``lines``: (trip, line) without overtaking, made here if not given.
    """
    lines = cut(fifo_lines(net.events)) if lines is None else lines
    far = net.replace(edges=cut(hub_distances(walks.out, walks.into)))
    found = cut(line_transfers(far, lines, sooner=True))
    # a line's trips have the same stops
    halts = cut(net.events.join(lines, "trip").select("line", "idx", "stop").distinct())
    a, b = (halts.select(F.col("line").alias(f"{c}_line"), F.col("idx").alias(f"{c}_idx"), F.col("stop").alias(f"{c}_stop")) for c in ("from", "to"))
    return found.join(a, ["from_line", "from_idx"]).join(b, ["to_line", "to_idx"]).select("from_trip", "from_idx", "from_stop", "to_trip", "to_idx", "to_stop", "travel_time")


def stop_shortcuts(net: Network, walks: Hubs, lines: DataFrame | None = None) -> DataFrame:
    """(src, dst, travel_time): the walks between trips that journeys need."""
    pairs = event_shortcuts(net, walks, lines).where("from_stop <> to_stop")
    return pairs.groupBy(F.col("from_stop").alias("src"), F.col("to_stop").alias("dst")).agg(F.min("travel_time").alias("travel_time"))


def over_shortcuts(net: Network, queries: DataFrame, walks: Hubs, shortcuts: DataFrame) -> DataFrame:
    """(query_id, stop, trips, arrival): per stop the arrivals that more trips improve; walks between trips are shortcuts only, first and last ones of any length."""
    found = labels(net, queries, initial=initial_labels(queries, walks), walks=OneHop(cut(shortcuts)))
    return with_last_walk(found.select(*_KEY, "trips", "arrival"), walks)


def with_last_walk(front: DataFrame, walks: Hubs) -> DataFrame:
    """The front after a last walk from wherever it is."""
    walked = walks.moved(front, ["query_id", "trips"], "stop", "arrival").select(*front.columns)
    best = front.unionByName(walked).groupBy(*_KEY, "trips").agg(F.min("arrival").alias("arrival"))
    fewer = F.min("arrival").over(Window.partitionBy(*_KEY).orderBy("trips").rowsBetween(Window.unboundedPreceding, -1))
    return best.withColumn("_fewer", fewer).where("_fewer is null or arrival < _fewer").select(*_KEY, "trips", "arrival")
