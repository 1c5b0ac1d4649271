"""Queries over hierarchies of roads and over a network of lines with many trips."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import assembly as B
from ..operators import delays as D
from ..operators import graph as G
from ..operators import hierarchy as H
from ..operators import statistics as A
from ..operators import triptransfers as T
from ..storage import keep_path
from ..streaming.replacement import follow_transfers
from . import journeys as J
from . import mcshortcuts as K
from . import multicriteria as M
from .catalog import _ANCHORED, _LATE, _Q, CLOSED, ROUNDS, _bags_sql, _batch, anchored_sql, roads
from .catalog_more import _FAR, _WALKS, _spurs
from .network import derived, derived_lines
from .registry import query
from . import shortcuts as U
from .segments import pareto_by_segments


def _ids(net):
    return net.stops.select(F.col("stop_id").alias("id"))


# -- hierarchies --------------------------------------------------------------------


@query(f", {CLOSED} SELECT * FROM sq7 WHERE src <> dst")
def hierarchy_distances(spark, sf_dir):
    """All distances between stops along the roads, as a join of hub labels out of a contraction hierarchy."""
    net = derived(spark, sf_dir)
    h = H.hierarchy(roads(net))
    return H.hub_distances(H.labels_from(h, _ids(net)), H.labels_to(h, _ids(net)))


@query(f", {CLOSED} SELECT src, dst, travel_time FROM sq7 WHERE src <> dst AND src % 3 = 0 AND dst % 3 = 0")
def core_distances(spark, sf_dir):
    """Distances within the core that is left when all vertices but every third stop, dead ends included, are contracted."""
    net = derived(spark, sf_dir)
    keep = _ids(net).where("id % 3 = 0")
    h = H.hierarchy(_spurs(net), keep=keep, least=0, most_degree=None)
    found = G.distances(h.core.select("src", "dst", "travel_time"), keep.select(F.col("id").alias("source")))
    return found.where("source <> vertex").select(F.col("source").alias("src"), F.col("vertex").alias("dst"), F.col("distance").alias("travel_time"))


@query(f", {CLOSED}, n AS (SELECT max(stop_id) + 1 AS n FROM stops), p AS (SELECT stop_id AS src, (stop_id * 7 + 3) % n AS dst FROM stops, n) SELECT p.src, p.dst, s.travel_time AS distance, true AS whole FROM p JOIN sq7 s ON s.src = p.src AND s.dst = p.dst WHERE p.src <> p.dst")
def shortest_road_paths(spark, sf_dir):
    """A shortest path for every stop, its shortcuts unpacked: its length, and whether its edges are roads that follow one another from end to end."""
    net = derived(spark, sf_dir)
    way = G.least_edges(roads(net))
    count = net.stops.agg((F.max("stop_id") + 1).alias("n"))
    pairs = net.stops.crossJoin(F.broadcast(count)).select(F.col("stop_id").alias("path"), F.col("stop_id").alias("src"), ((F.col("stop_id") * 7 + 3) % F.col("n")).alias("dst")).where("src <> dst")
    steps = H.shortest_paths(H.hierarchy(way), pairs)
    real = steps.join(way.withColumnRenamed("travel_time", "_t"), ["src", "dst"], "left")
    follows = F.coalesce(F.lag("dst").over(Window.partitionBy("path").orderBy("step")) == F.col("src"), F.col("step") == 0)
    rows = real.withColumn("_fits", follows & F.coalesce(F.col("_t") == F.col("travel_time"), F.lit(False)))
    ends = rows.groupBy("path").agg(F.min_by("src", "step").alias("_a"), F.max_by("dst", "step").alias("_b"), F.sum("travel_time").alias("distance"), F.bool_and("_fits").alias("_fits"))
    return pairs.join(ends, "path").select("src", "dst", "distance", (F.col("_fits") & (F.col("_a") == F.col("src")) & (F.col("_b") == F.col("dst"))).alias("whole"))


@query(
    _FAR + ", spur AS (SELECT query_id, stop AS vertex, trips, arrival FROM front UNION ALL SELECT query_id, stop + 1000000, trips, arrival + 50 + stop % 40 FROM front) SELECT * FROM spur"
)
def pareto_at_vertices(spark, sf_dir):
    """One-to-all: at every vertex of the roads, dead ends included, the arrivals that more trips improve, by sweeps down the hierarchy."""
    net = derived(spark, sf_dir)
    batch, h = _batch(net), H.hierarchy(_spurs(net))
    return J.pareto_to_vertices(J.pareto(net, batch, walks=J.unlimited(net, h)), h, batch)


# -- transfers of lines ------------------------------------------------------------

#: Full and route-based transfers of the network of lines.
_NUMBERS = "num AS MATERIALIZED (SELECT trip, line, row_number() OVER (PARTITION BY line ORDER BY dep, trip) - 1 AS no FROM ev WHERE idx = 0)"
_LINE_TRANSFERS = (
    f"{_NUMBERS}, e AS MATERIALIZED (SELECT ev.*, num.no FROM ev JOIN num USING (trip)), "
    "ways AS (SELECT src, dst, travel_time FROM edges UNION ALL SELECT stop_id, stop_id, 0 FROM stops), "
    "pairs AS MATERIALIZED (SELECT a.line AS from_line, a.idx AS from_idx, b.line AS to_line, b.idx AS to_idx, w.travel_time, s.min_transfer_time AS wait FROM line_stops a JOIN ways w ON w.src = a.stop JOIN line_stops b ON b.stop = w.dst JOIN stops s ON s.stop_id = w.dst WHERE a.idx > 0 AND b.idx < b.n - 1 AND (a.line <> b.line OR a.idx <> b.idx)), "
    "ready AS (SELECT e.trip AS from_trip, e.no AS from_no, p.*, e.arr + p.travel_time + p.wait AS ready FROM e JOIN pairs p ON p.from_line = e.line AND p.from_idx = e.idx), "
    "board AS (SELECT line, idx, dep, min(no) AS no, arg_min(trip, no) AS trip FROM e WHERE idx < n - 1 GROUP BY ALL), "
    "met AS (SELECT r.*, b.no AS to_no, b.trip AS to_trip FROM ready r ASOF JOIN board b ON b.line = r.to_line AND b.idx = r.to_idx AND r.ready <= b.dep), "
    "full_transfers AS MATERIALIZED (SELECT m.*, q.n FROM met m JOIN e p ON p.trip = m.from_trip AND p.idx = m.from_idx - 1 JOIN e q ON q.trip = m.to_trip AND q.idx = m.to_idx + 1 JOIN stops s ON s.stop_id = p.stop "
    "WHERE (m.to_line <> m.from_line OR m.to_no < m.from_no OR m.to_idx < m.from_idx) AND NOT (p.stop = q.stop AND p.arr + s.min_transfer_time <= q.dep)), "
    "spread AS (SELECT t.*, unnest(range(to_idx, n - 1)) AS p FROM full_transfers t), "
    "least AS (SELECT *, min(to_no) OVER (PARTITION BY from_trip, to_line, p ORDER BY from_idx DESC, to_idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS least FROM spread), "
    "transfers AS MATERIALIZED (SELECT from_trip, from_idx, to_trip, to_idx, travel_time, from_line, from_no, to_line, to_no FROM least WHERE p = to_idx AND (least IS NULL OR to_no < least))"
)


@query(f", {_LINE_TRANSFERS} SELECT from_trip, from_idx, to_trip, to_idx, travel_time FROM full_transfers", lines="orders")
def all_line_transfers(spark, sf_dir):
    """From every halt the next trip of every line around, whatever the wait."""
    net, lines = derived_lines(spark, sf_dir)
    return T.line_transfers(net, lines, route_based=False).select("from_trip", "from_idx", "to_trip", "to_idx", "travel_time")


@query(f", {_LINE_TRANSFERS} SELECT from_trip, from_idx, to_trip, to_idx, travel_time FROM transfers", lines="orders")
def line_transfers(spark, sf_dir):
    """Of these, without what a later halt reaches as well: route-based generation."""
    net, lines = derived_lines(spark, sf_dir)
    return T.line_transfers(net, lines).select("from_trip", "from_idx", "to_trip", "to_idx", "travel_time")


#: Trips that a transfer may be inherited over.
TRIP_LIMIT = 3


@query(
    f", {_LINE_TRANSFERS}, later AS (SELECT *, min(to_no) OVER w AS least FROM transfers WINDOW w AS (PARTITION BY from_line, from_idx, to_line, to_idx ORDER BY from_no DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)), "
    "records AS (SELECT *, lead(from_no) OVER (PARTITION BY from_line, from_idx, to_line, to_idx ORDER BY from_no DESC) AS below FROM later WHERE least IS NULL OR to_no <= least), "
    f"spans AS (SELECT *, unnest(range(greatest(coalesce(below + 1, 0), from_no - {TRIP_LIMIT}), from_no + 1)) AS own FROM records) "
    "SELECT n.trip AS from_trip, s.from_idx, s.to_trip, s.to_idx, s.travel_time FROM spans s JOIN num n ON n.line = s.from_line AND n.no = s.own",
    lines="orders",
)
def augmented_transfers(spark, sf_dir):
    """Trips that run late may take the transfers of up to three later trips of their line."""
    net, lines = derived_lines(spark, sf_dir)
    return T.line_transfers(net, lines, later_trips=TRIP_LIMIT).select("from_trip", "from_idx", "to_trip", "to_idx", "travel_time")


# -- delays of lines ---------------------------------------------------------------

_SLACK = "JOIN e a ON a.trip = from_trip AND a.idx = from_idx JOIN e b ON b.trip = to_trip AND b.idx = to_idx"


@query(f", {_LINE_TRANSFERS} SELECT b.dep - a.arr - t.travel_time AS slack, count(*) AS transfers FROM full_transfers t {_SLACK} GROUP BY ALL", lines="customer")
def line_transfer_slacks(spark, sf_dir):
    """How many transfers have how much time to spare, whatever the wait."""
    net, lines = derived_lines(spark, sf_dir, "customer")
    found = T.line_transfers(net, lines, route_based=False).select("from_trip", "from_idx", "to_trip", "to_idx", "travel_time")
    return A.transfer_slacks(found, net).groupBy("slack").agg(F.count(F.lit(1)).alias("transfers"))


#: Greatest delay of an origin, in seconds, that transfers are made for.
MOST_DELAY = 900
_DELAY_TRANSFERS = (
    f"{_LINE_TRANSFERS}, trips_of AS (SELECT line, idx, no, trip, dep, lag(dep) OVER (PARTITION BY line, idx ORDER BY no) AS missed FROM e WHERE idx < n - 1), "
    "reach AS (SELECT r.*, b.no AS to_no, b.trip AS to_trip, b.dep, b.missed FROM ready r JOIN trips_of b ON b.line = r.to_line AND b.idx = r.to_idx AND b.dep >= r.ready AND (b.missed IS NULL OR b.missed < r.ready + 900)), "
    "late_transfers AS MATERIALIZED (SELECT from_trip, from_idx, to_trip, to_idx, travel_time, CAST(CASE WHEN missed IS NULL OR missed < ready THEN 0 ELSE missed - ready + 1 END AS BIGINT) AS min_origin_delay, CAST(least(dep - ready, 900) AS BIGINT) AS max_origin_delay FROM reach "
    "WHERE (to_line <> from_line OR to_no < from_no OR to_idx < from_idx) AND (missed IS NULL OR missed < ready OR missed - ready + 1 <= least(dep - ready, 900)))"
)


@query(f", {_DELAY_TRANSFERS} SELECT * FROM late_transfers", lines="customer")
def delay_transfers(spark, sf_dir):
    """For every halt and line around, the trips that one reaches if the own trip is up to a quarter of an hour late, with the delays they hold for."""
    net, lines = derived_lines(spark, sf_dir, "customer")
    return T.delay_transfers(net, lines, MOST_DELAY)


@query(
    f", {_DELAY_TRANSFERS}, {_LATE}, held AS (SELECT a.arr - p.arr AS origin_delay, a.arr + t.travel_time <= b.dep AS holds, min_origin_delay AS lo, max_origin_delay AS hi FROM late_transfers t JOIN e p ON p.trip = from_trip AND p.idx = from_idx JOIN late a ON a.trip = from_trip AND a.idx = from_idx JOIN late b ON b.trip = to_trip AND b.idx = to_idx) "
    "SELECT origin_delay, holds, count(*) AS transfers FROM held WHERE lo <= origin_delay AND (NOT holds OR hi >= origin_delay) GROUP BY ALL",
    lines="customer",
)
def delay_transfers_under_delays(spark, sf_dir):
    """Of these, those made for the delay that their origin has, and whether they hold when their goals are late as well."""
    net, lines = derived_lines(spark, sf_dir, "customer")
    late = D.late_network(net, D.scenario(net.events), most_arrival=600, most_departure=900)
    held = D.holding_transfers(T.delay_transfers(net, lines, MOST_DELAY), net, late)
    return held.groupBy("origin_delay", "holds").agg(F.count(F.lit(1)).alias("transfers"))


#: Rounds of the oracle until no trip is overtaken by the next one; Spark goes on until there is none.
_SETTLED = 12
_REBUILT = (
    f"{_NUMBERS}, {_LATE}, r0 AS MATERIALIZED (SELECT trip, num.line, no, idx, arr, dep FROM late JOIN num USING (trip)), "
    + ", ".join(
        f"g{k} AS MATERIALIZED (SELECT DISTINCT trip FROM (SELECT trip, arr, dep, lead(arr) OVER w AS a2, lead(dep) OVER w AS d2 FROM r{k} WINDOW w AS (PARTITION BY line, idx ORDER BY no)) WHERE a2 < arr OR d2 < dep), r{k + 1} AS MATERIALIZED (SELECT * FROM r{k} WHERE trip NOT IN (SELECT trip FROM g{k}))"
        for k in range(_SETTLED)
    )
    + f", t AS MATERIALIZED (SELECT trip, line, no, list_concat(list(arr ORDER BY idx), list(dep ORDER BY idx)) AS times, row_number() OVER (PARTITION BY line ORDER BY no) AS k FROM r0 WHERE trip NOT IN (SELECT trip FROM r{_SETTLED}) GROUP BY trip, line, no), "
    "fit AS (SELECT line, k, [times] AS lasts, [trip] AS names, trip, trip AS overflow FROM t WHERE k = 1 UNION ALL "
    "SELECT line, k, CASE WHEN p IS NULL THEN list_append(lasts, times) ELSE list_transform(lasts, lambda x, i: CASE WHEN i = p THEN times ELSE x END) END, CASE WHEN p IS NULL THEN list_append(names, trip) ELSE names END, trip, CASE WHEN p IS NULL THEN trip ELSE names[p] END "
    "FROM (SELECT t.line, t.k, t.times, t.trip, f.lasts, f.names, nullif(list_position(list_transform(f.lasts, lambda l: len(list_filter(list_zip(l, t.times), lambda z: z[1] > z[2])) = 0), true), 0) AS p FROM fit f JOIN t ON t.line = f.line AND t.k = f.k + 1)), "
    "rebuilt AS MATERIALIZED (SELECT n.trip, n.line, n.no, f.overflow FROM num n LEFT JOIN fit f ON f.trip = n.trip)"
)


def _rebuilt(spark, sf_dir):
    net, lines = derived_lines(spark, sf_dir, "customer")
    late = D.late_network(net, D.scenario(net.events), most_arrival=600, most_departure=900)
    return late, B.rebuilt_lines(late.events, T.numbered(net.events, lines))


@query(f", {_REBUILT} SELECT trip, line, no, overflow FROM rebuilt", lines="customer", recursive=True)
def rebuilt_lines(spark, sf_dir):
    """Lines put in order again after delays: overtaken trips go to overflow lines."""
    return _rebuilt(spark, sf_dir)[1]


@query(f", {_REBUILT}, o AS (SELECT *, CASE WHEN overflow IS NOT NULL THEN min(no) OVER (PARTITION BY line, overflow) END AS first FROM rebuilt) SELECT trip, idx, row_number() OVER (ORDER BY overflow IS NOT NULL, o.line, first, no, idx) - 1 AS place FROM o JOIN late USING (trip)", lines="customer", recursive=True)
def rebuilt_event_order(spark, sf_dir):
    """Where each event stands once lines are rebuilt."""
    late, lines = _rebuilt(spark, sf_dir)
    return B.event_order(late.events, lines)


@query(
    f", {_LINE_TRANSFERS}, {_LATE}, el AS MATERIALIZED (SELECT late.*, num.line, num.no FROM late JOIN num USING (trip)), "
    "rl AS (SELECT el.trip AS from_trip, p.*, el.arr + p.travel_time + p.wait AS ready FROM el JOIN pairs p ON p.from_line = el.line AND p.from_idx = el.idx), "
    "bl AS (SELECT line, idx, dep, arg_min(trip, no) AS trip FROM el WHERE idx < n - 1 GROUP BY ALL) "
    "SELECT r.from_trip, r.from_idx, r.to_line, r.to_idx, r.travel_time, b.trip AS to_trip, b.dep FROM rl r ASOF LEFT JOIN bl b ON b.line = r.to_line AND b.idx = r.to_idx AND r.ready <= b.dep",
    lines="customer",
)
def followed_transfers(spark, sf_dir):
    """The earliest trip of every line around each halt, kept up to date while delays stream in; after the last update as if all had been known."""
    net, lines = derived_lines(spark, sf_dir, "customer")
    k = F.explode(F.array(*(F.lit(x) for x in range(4)))).alias("k")
    updates = D.scenario(net.events).select("*", k).where("k = 3 or pmod(trip + k, 3) = 0")
    updates = updates.select("trip", "first_idx", F.when(F.col("k") == 3, F.col("delay")).otherwise(F.col("k") * 7).alias("delay"), (F.col("k") * 600).cast("long").alias("reveal_time"))
    folder = keep_path(updates.repartition(4, "reveal_time"), "updates")
    found = follow_transfers(spark, net, lines, folder, files=2, most_arrival=600, most_departure=900)
    return found.state().select("from_trip", "from_idx", "to_line", "to_idx", "travel_time", "to_trip", "dep")


_LINE_FRONT = f", {_Q}, {J.rounds_sql(ROUNDS)} "


@query(_LINE_FRONT + "SELECT query_id, stop, trips, arrival FROM front", lines="orders")
def line_pareto_by_segments(spark, sf_dir):
    """Arrival and trips by a search over trip segments along route-based transfers, the same relation as by rounds of stops."""
    net, lines = derived_lines(spark, sf_dir)
    return pareto_by_segments(net, lines, T.line_transfers(net, lines), _batch(net))


@query(_LINE_FRONT + "SELECT query_id, stop, trips, arrival FROM front", lines="orders")
def line_pareto_by_reduced_segments(spark, sf_dir):
    """The same along transfers that lead somewhere sooner only."""
    net, lines = derived_lines(spark, sf_dir)
    return pareto_by_segments(net, lines, T.line_transfers(net, lines, sooner=True), _batch(net))


# -- shortcuts ---------------------------------------------------------------------

_LINE_FAR = f"{_FAR} SELECT query_id, stop, trips, arrival FROM front"


def _sparse(spark, sf_dir):
    """The network of lines with a trip per customer, and walks of any length along the roads."""
    net, lines = derived_lines(spark, sf_dir, "customer")
    return net, lines, J.unlimited(net, roads(net))


@query(_LINE_FAR, lines="customer")
def pareto_over_stop_shortcuts(spark, sf_dir):
    """Arrival and trips with walks of any length; those between trips are taken from precomputed shortcuts between stops."""
    net, lines, walks = _sparse(spark, sf_dir)
    return U.over_shortcuts(net, _batch(net), walks, U.stop_shortcuts(net, walks, lines))


@query(_LINE_FAR, lines="customer")
def pareto_over_event_shortcuts(spark, sf_dir):
    """The same by a search over trip segments along precomputed shortcuts between halts."""
    net, lines, walks = _sparse(spark, sf_dir)
    return pareto_by_segments(net, lines, U.event_shortcuts(net, walks, lines), _batch(net), walks=walks)


#: Rounds of the oracle for three criteria on this network, whose journeys have up to eight trips at its size; Spark goes on until none improves anything.
_SET_ROUNDS = 12
_LINE_BAGS = f", {_Q}, {_WALKS}, {_bags_sql(_SET_ROUNDS).replace('JOIN edges ON', 'JOIN walks ON')} SELECT * FROM mfront"
_LINE_ANCHORED = anchored_sql(_SET_ROUNDS).replace("JOIN edges ON", "JOIN walks ON").replace(f", {_Q}, ", f", {_Q}, {_WALKS}, ", 1)


@query(_LINE_BAGS, lines="customer")
def pareto_sets_over_stop_shortcuts(spark, sf_dir):
    """Arrival, trips and transfer time with walks of any length; those between trips are precomputed shortcuts for all three criteria."""
    net, lines, walks = _sparse(spark, sf_dir)
    return K.sets_over_shortcuts(net, _batch(net), walks, K.stop_shortcuts(K.event_shortcuts(net, lines, walks)))


@query(_LINE_BAGS, lines="customer")
def pareto_sets_over_event_shortcuts(spark, sf_dir):
    """The same by a search from trip to trip along shortcuts between halts."""
    net, lines, walks = _sparse(spark, sf_dir)
    return K.sets_by_segments(net, lines, K.event_shortcuts(net, lines, walks), _batch(net), walks)


@query(_LINE_ANCHORED + "SELECT DISTINCT query_id, stop, trips, arrival, t_walk FROM usable WHERE arrival - dep_time <= (a - dep_time) * 1.25::DOUBLE AND trips <= ceil(k * 1.25::DOUBLE)", lines="customer")
def restricted_sets_over_event_shortcuts(spark, sf_dir):
    """The restricted sets among these; the anchors are the sets' own earliest arrivals."""
    net, lines, walks = _sparse(spark, sf_dir)
    batch = _batch(net)
    full = K.cut(K.sets_by_segments(net, lines, K.event_shortcuts(net, lines, walks), batch, walks))
    return M.restricted(full, K.earliest_of(full), batch, 1.25, 1.25)


_ANCHORED_TARGETS = "SELECT DISTINCT u.query_id, u.stop, u.trips, u.arrival, u.t_walk FROM usable u JOIN q ON q.query_id = u.query_id AND q.target = u.stop WHERE u.arrival - u.dep_time <= (u.a - u.dep_time) * 1.25::DOUBLE AND u.trips <= ceil(u.k * 1.25::DOUBLE)"


@query(_ANCHORED + _ANCHORED_TARGETS)
def restricted_to_targets(spark, sf_dir):
    """One-to-one restricted sets, by a search that a search back from each target bounds in every round."""
    net = derived(spark, sf_dir)
    return M.restricted_to_targets(net, _batch(net), 1.25, 1.25)
