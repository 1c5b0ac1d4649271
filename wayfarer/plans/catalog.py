"""Queries over the driver's tables, one per operator, and the same results in the oracle's SQL."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from .. import functions as S
from ..operators import delays as D
from ..operators import graph as G
from ..operators import statistics as A
from ..operators import transforms as X
from ..operators.assembly import fifo_lines as fifo
from ..operators.skyline import skyline
from ..storage import keep_path
from ..streaming.delays import counts_by_window, follow
from . import journeys as J
from . import multicriteria as M
from .network import derived
from .registry import ORACLE_SQL, QUERIES  # noqa: F401  as this module's own
from .registry import query as _query

#: Queries of a batch, and the rounds that the oracle's unrolled SQL has.  Spark's rounds go on until none improves anything.
BATCH, ROUNDS = 6, 7


# -- network and transforms -----------------------------------------------


@_query("SELECT stop_id, name, min_transfer_time FROM stops")
def network_stops(spark, sf_dir):
    return derived(spark, sf_dir).stops


@_query("SELECT trip, idx, stop, arr, dep, n FROM ev")
def network_events(spark, sf_dir):
    return derived(spark, sf_dir).events


@_query("SELECT src, dst, travel_time FROM edges")
def network_transfers(spark, sf_dir):
    return derived(spark, sf_dir).edges


_CONN = "conn AS (SELECT * FROM (SELECT stop AS dep_stop, lead(stop) OVER w AS arr_stop, dep, lead(arr) OVER w AS arr, trip FROM ev WINDOW w AS (PARTITION BY trip ORDER BY idx)) WHERE arr IS NOT NULL)"


@_query(f", {_CONN} SELECT * FROM conn")
def connections(spark, sf_dir):
    return X.connections(derived(spark, sf_dir).events)


@_query(f", {_CONN}, k AS (SELECT *, row_number() OVER (PARTITION BY trip ORDER BY dep, arr, dep_stop) - 1 AS i, lag(arr) OVER (PARTITION BY trip ORDER BY dep, arr, dep_stop) AS b, count(*) OVER (PARTITION BY trip) AS m FROM conn) SELECT trip, i AS idx, dep_stop AS stop, coalesce(b, dep) AS arr, dep, m + 1 AS n FROM k UNION ALL SELECT trip, i + 1, arr_stop, arr, arr, m + 1 FROM k WHERE i = m - 1")
def events_from_connections(spark, sf_dir):
    return X.events_from_connections(X.connections(derived(spark, sf_dir).events))


_SEQ = "seq AS (SELECT trip, list(stop ORDER BY idx) AS stops, list(arr ORDER BY idx) AS arrs, list(dep ORDER BY idx) AS deps FROM {ev} GROUP BY trip)"


@_query(
    f", ev2 AS (SELECT trip * 2 + k AS trip, idx, stop, arr - CASE WHEN k = 1 AND idx > 0 THEN 60 ELSE 0 END AS arr, dep, n FROM ev, (SELECT CAST(range AS BIGINT) AS k FROM range(2))), {_SEQ.format(ev='ev2')}, "
    "f AS (SELECT trip, arrs, deps, lead(arrs) OVER w AS a2, lead(deps) OVER w AS d2 FROM seq WINDOW w AS (PARTITION BY stops ORDER BY deps, list_transform(arrs, lambda x: -x), trip)), "
    "bad AS (SELECT trip FROM f WHERE a2 IS NOT NULL AND len(list_filter(list_zip(arrs, a2), lambda x: x[2] > x[1])) = 0 AND len(list_filter(list_zip(deps, d2), lambda x: x[2] < x[1])) = 0) "
    "SELECT trip, idx, stop, arr, dep, n FROM ev2 WHERE trip NOT IN (SELECT trip FROM bad)"
)
def dominated_trips_dropped(spark, sf_dir):
    """Every trip beside a copy that arrives a minute earlier: the slower one goes."""
    ev = derived(spark, sf_dir).events
    two = ev.select("*", F.explode(F.array(F.lit(0), F.lit(1))).alias("k"))
    two = two.select((F.col("trip") * 2 + F.col("k")).alias("trip"), "idx", "stop", (F.col("arr") - F.when((F.col("k") == 1) & (F.col("idx") > 0), 60).otherwise(0)).alias("arr"), "dep", "n")
    return X.drop_dominated(two)


@_query("SELECT trip, idx, stop, arr, dep, n FROM ev WHERE trip NOT IN (SELECT trip FROM ev WHERE stop % 10 = 3)")
def clipped_events(spark, sf_dir):
    """Without the stops whose id ends in 3: trips through any of them go."""
    net = derived(spark, sf_dir)
    return X.clip(net, net.stops.where("stop_id % 10 <> 3")).events


@_query("SELECT trip, idx, stop, arr, dep, n FROM ev UNION ALL SELECT trip + (SELECT max(trip) + 1 FROM ev), idx, stop, arr + 86400, dep + 86400, n FROM ev")
def duplicated_trips(spark, sf_dir):
    return X.duplicate_trips(derived(spark, sf_dir)).events


@_query("SELECT trip, idx, stop, arr, dep - min_transfer_time AS dep, n FROM ev JOIN stops ON stop = stop_id")
def departure_buffers(spark, sf_dir):
    return X.departure_buffers(derived(spark, sf_dir)).events


@_query("SELECT trip, idx, stop, arr + min_transfer_time AS arr, dep, n FROM ev JOIN stops ON stop = stop_id")
def arrival_buffers(spark, sf_dir):
    return X.arrival_buffers(derived(spark, sf_dir)).events


@_query("SELECT trip, n - 1 - idx AS idx, stop, -dep AS arr, -arr AS dep, n FROM ev")
def reversed_events(spark, sf_dir):
    return X.reverse(derived(spark, sf_dir)).events


@_query("SELECT trip * 3 + k AS trip, idx, stop, arr + k * 1800 AS arr, dep + k * 1800 AS dep, n FROM ev, (SELECT CAST(range AS BIGINT) AS k FROM range(3))")
def headway_copies(spark, sf_dir):
    return X.with_headway(derived(spark, sf_dir)).events


@_query("SELECT trip, idx, stop, CAST(floor(arr * 1.5) AS BIGINT) AS arr, CAST(floor(dep * 1.5) AS BIGINT) AS dep, n FROM ev")
def scaled_events(spark, sf_dir):
    return X.scale_times(derived(spark, sf_dir), 1.5).events


@_query(", m AS (SELECT stop_id, row_number() OVER (ORDER BY stop_id IN (SELECT stop FROM ev) DESC, stop_id) - 1 AS new_id FROM stops) SELECT a.new_id AS src, b.new_id AS dst, travel_time FROM edges JOIN m a ON a.stop_id = src JOIN m b ON b.stop_id = dst")
def renumbered_transfers(spark, sf_dir):
    net = derived(spark, sf_dir)
    return X.renumber(net, X.dense_ids(net)).edges


@_query("SELECT CASE WHEN src IN (SELECT stop_id FROM stops WHERE stop_id % 2 = 0) THEN src ELSE src + t END AS src, dst, travel_time FROM edges, (SELECT max(stop_id) + 1 AS t FROM stops)")
def impassable_vertices(spark, sf_dir):
    """Only stops of even ids count as stops, so the others are split."""
    net = derived(spark, sf_dir)
    return X.impassable_vertices(net.replace(stops=net.stops.where("stop_id % 2 = 0")))


@_query(", t AS (SELECT max(stop_id) + 1 AS t FROM stops) SELECT src + t AS src, dst + t AS dst, travel_time FROM edges, t UNION ALL SELECT stop_id, stop_id + t, 300 FROM stops, t UNION ALL SELECT stop_id + t, stop_id, 0 FROM stops, t")
def overhead_graph(spark, sf_dir):
    return X.overhead_graph(derived(spark, sf_dir), S.MODE_OVERHEAD["bicycle"])


@_query("SELECT src, dst, greatest(travel_time, 200) AS travel_time FROM edges")
def least_transfer_time(spark, sf_dir):
    return X.least_travel_time(derived(spark, sf_dir).edges, 200)


@_query("SELECT src, dst, greatest(travel_time, CAST(floor(travel_time * 200 / 4.5 * 0.036) AS BIGINT)) AS travel_time FROM edges")
def capped_speed(spark, sf_dir):
    """A transfer's length is taken to be two metres for each of its seconds."""
    edges = derived(spark, sf_dir).edges.withColumn("cm", F.col("travel_time") * 200)
    return X.cap_speed(edges, "cm", 4.5).select("src", "dst", "travel_time")


# -- graphs ---------------------------------------------------------------

_RIDES = f"{_CONN}, rides AS (SELECT dep_stop AS src, arr_stop AS dst, arr - dep AS travel_time FROM conn)"


@_query(f", {_RIDES} SELECT src, dst, min(travel_time) AS travel_time FROM (SELECT * FROM rides UNION ALL SELECT * FROM edges) WHERE src <> dst GROUP BY ALL")
def least_time_graph(spark, sf_dir):
    return A.least_time_graph(derived(spark, sf_dir))


@_query("SELECT src, dst, min(travel_time) AS travel_time FROM (SELECT a.stop AS src, b.stop AS dst, b.arr - a.dep AS travel_time FROM ev a JOIN ev b ON a.trip = b.trip AND a.idx < b.idx UNION ALL SELECT * FROM edges) WHERE src <> dst GROUP BY ALL")
def least_time_all_pairs(spark, sf_dir):
    return A.least_time_all_pairs(derived(spark, sf_dir))


@_query("SELECT a.src, a.dst, a.travel_time, b.travel_time AS reverse_time FROM edges a LEFT JOIN edges b ON a.src = b.dst AND a.dst = b.src")
def reverse_edges(spark, sf_dir):
    return G.with_reverse(derived(spark, sf_dir).edges)


#: Transfers and a road that passes all stops, with gaps backwards after each twelve and both ways after each 24.
ROADS = (
    "roads AS MATERIALIZED (SELECT src, dst, min(travel_time) AS travel_time FROM (SELECT * FROM edges "
    "UNION ALL SELECT a.stop_id, b.stop_id, 100 + a.stop_id * 37 % 200 FROM stops a JOIN stops b ON b.stop_id = a.stop_id + 1 WHERE a.stop_id % 24 <> 23 "
    "UNION ALL SELECT b.stop_id, a.stop_id, 100 + a.stop_id * 53 % 200 FROM stops a JOIN stops b ON b.stop_id = a.stop_id + 1 WHERE a.stop_id % 12 <> 11) GROUP BY ALL)"
)
#: Shortest paths of up to 128 roads, by squaring.
CLOSED = f"{ROADS}, sq0 AS MATERIALIZED (SELECT * FROM roads UNION ALL SELECT stop_id, stop_id, 0 FROM stops), " + ", ".join(
    f"sq{k} AS MATERIALIZED (SELECT a.src, b.dst, min(a.travel_time + b.travel_time) AS travel_time FROM sq{k - 1} a JOIN sq{k - 1} b ON a.dst = b.src GROUP BY ALL)" for k in range(1, 8)
)


def roads(net):
    here, next_ = net.stops.select("stop_id"), net.stops.select((F.col("stop_id") - 1).alias("stop_id"))
    both = here.join(next_, "stop_id").select(F.col("stop_id").alias("a"), (F.col("stop_id") + 1).alias("b"))
    on = both.where("a % 24 <> 23").select(F.col("a").alias("src"), F.col("b").alias("dst"), (100 + F.col("a") * 37 % 200).alias("travel_time"))
    back = both.where("a % 12 <> 11").select(F.col("b").alias("src"), F.col("a").alias("dst"), (100 + F.col("a") * 53 % 200).alias("travel_time"))
    return G.least_edges(net.edges.unionByName(on).unionByName(back))


@_query(f", {ROADS} SELECT src, dst, min(travel_time) AS travel_time FROM (SELECT * FROM roads UNION ALL SELECT dst, src, travel_time FROM roads) GROUP BY ALL")
def symmetric_edges(spark, sf_dir):
    return G.symmetric(roads(derived(spark, sf_dir)))


@_query(f", {CLOSED} SELECT * FROM sq7 WHERE src <> dst")
def transitive_closure(spark, sf_dir):
    return G.closure(roads(derived(spark, sf_dir)))


@_query(f", {CLOSED} SELECT src, dst, min(travel_time) AS travel_time FROM (SELECT * FROM sq7 UNION ALL SELECT dst, src, travel_time FROM sq7) WHERE src <> dst AND travel_time <= 900 GROUP BY ALL")
def one_hop_transfers(spark, sf_dir):
    net = derived(spark, sf_dir)
    return G.one_hop_transfers(roads(net), net.stops, 900)


@_query(f", {CLOSED} SELECT a.src AS id, min(a.dst) AS component FROM sq7 a JOIN sq7 b ON a.src = b.dst AND a.dst = b.src GROUP BY a.src")
def strong_components(spark, sf_dir):
    net = derived(spark, sf_dir)
    return G.strong_components(roads(net), net.stops.select(F.col("stop_id").alias("id")))


@_query("SELECT (SELECT count(*) FROM stops) AS vertices, count(*) AS edges, CAST(sum(CAST(src = dst AS BIGINT)) AS BIGINT) AS loops, max(travel_time) AS longest, CAST(sum(travel_time) AS BIGINT) AS total, CAST(0 AS BIGINT) AS multi_edges, (SELECT count(*) FROM stops WHERE stop_id NOT IN (SELECT src FROM edges)) AS isolated FROM edges")
def graph_report(spark, sf_dir):
    net = derived(spark, sf_dir)
    return G.graph_report(net.edges, net.stops.select(F.col("stop_id").alias("id")))


#: Stops on a plane of whole numbers, so that both engines place them alike.
_PLACES = "places AS (SELECT stop_id AS id, CAST(47.0 + (stop_id * 37 % 101) * 0.001 AS DOUBLE) AS lat, CAST(8.0 + (stop_id * 53 % 97) * 0.001 AS DOUBLE) AS lon FROM stops)"


def _places(net):
    lat, lon = F.lit(47.0) + (F.col("stop_id") * 37 % 101) * F.lit(0.001), F.lit(8.0) + (F.col("stop_id") * 53 % 97) * F.lit(0.001)
    return net.stops.select(F.col("stop_id").alias("id"), lat.alias("lat"), lon.alias("lon"))


_DISTANCE = f"CASE WHEN a.lat = b.lat AND a.lon = b.lon THEN 0 ELSE acos(least(1.0, greatest(-1.0, sin(radians(a.lat)) * sin(radians(b.lat)) + cos(radians(a.lat)) * cos(radians(b.lat)) * cos(radians(a.lon - b.lon))))) * {S.EARTH_CM} END"


@_query(f", {_PLACES} SELECT id, other, CAST(round(d / 100) AS BIGINT) AS metres FROM (SELECT a.id, b.id AS other, {_DISTANCE} AS d FROM places a JOIN places b ON a.id <> b.id) WHERE d <= 100000")
def places_within_range(spark, sf_dir):
    places = _places(derived(spark, sf_dir))
    pairs = G.within_range(places, places, 100_000).where("id <> other")
    return pairs.select("id", "other", F.round(F.col("distance") / 100).cast("long").alias("metres"))


@_query(f", {_PLACES} SELECT id, CAST(round(min(d) / 100) AS BIGINT) AS metres FROM (SELECT a.id, {_DISTANCE} AS d FROM places a JOIN places b ON b.id % 5 = 0 WHERE a.id % 5 <> 0) GROUP BY id")
def nearest_place(spark, sf_dir):
    places = _places(derived(spark, sf_dir))
    near = G.nearest(places.where("id % 5 <> 0"), places.where("id % 5 = 0"))
    return near.select("id", F.round(F.col("distance") / 100).cast("long").alias("metres"))


# -- statistics -----------------------------------------------------------


@_query("SELECT (SELECT count(*) FROM stops) AS stops, (SELECT max(min_transfer_time) FROM stops) AS longest_buffer, count(DISTINCT trip) AS trips, count(*) AS events, count(DISTINCT stop) AS served_stops, min(dep) AS first_departure, max(arr) AS last_arrival, (SELECT count(*) FROM edges) AS transfers, (SELECT max(travel_time) FROM edges) AS longest_transfer FROM ev")
def network_report(spark, sf_dir):
    return A.report(derived(spark, sf_dir))


@_query("SELECT stop_id, count(trip) AS events FROM stops LEFT JOIN ev ON stop = stop_id GROUP BY stop_id")
def events_per_stop(spark, sf_dir):
    return A.events_per_stop(derived(spark, sf_dir))


@_query("SELECT CAST(floor(dep / 86400) AS BIGINT) AS day, count(*) AS events FROM (SELECT dep + k * 86400 AS dep FROM ev, (SELECT CAST(range AS BIGINT) AS k FROM range(2))) WHERE dep < 14 * 86400 GROUP BY 1")
def events_per_day(spark, sf_dir):
    return A.events_per_day(X.duplicate_trips(derived(spark, sf_dir)).events)


@_query(f", {_SEQ.format(ev='ev')} SELECT min(trip) AS pattern, count(*) AS trips, len(stops) AS stops FROM seq GROUP BY seq.stops")
def route_patterns(spark, sf_dir):
    return A.patterns(derived(spark, sf_dir)).select("pattern", "trips", F.size("stops").cast("long").alias("stops"))


@_query(
    ", lines AS (SELECT trip, min(d) AS a, max(d) AS b, count(*) AS n FROM (SELECT trip, dep + 1800 * k AS d FROM ev, (SELECT CAST(range AS BIGINT) AS k FROM range(3)) WHERE idx = 0) WHERE d <= 86400 GROUP BY trip), "
    "c AS (SELECT CAST(CASE WHEN h <= 300 THEN 0 WHEN h <= 600 THEN 1 WHEN h <= 1200 THEN 2 WHEN h <= 1800 THEN 3 WHEN h <= 3600 THEN 4 WHEN h <= 7200 THEN 5 WHEN h <= 14400 THEN 6 ELSE 7 END AS BIGINT) AS bucket FROM (SELECT (b - a) / (n - 1) AS h FROM lines WHERE n > 1)) "
    "SELECT bucket, lines, lines / sum(lines) OVER () AS share FROM (SELECT bucket, count(*) AS lines FROM c GROUP BY bucket)"
)
def headway_classes(spark, sf_dir):
    net = X.with_headway(derived(spark, sf_dir))
    lines = net.events.select("trip", F.floor(F.col("trip") / 3).alias("route")).distinct()
    return A.headways(net, lines)


@_query("SELECT unnest([0.05, 0.25, 0.5, 0.75, 0.95]::DOUBLE[]) AS point, unnest(quantile_cont(travel_time, [0.05, 0.25, 0.5, 0.75, 0.95])) AS value FROM edges")
def transfer_time_percentiles(spark, sf_dir):
    return A.percentiles(derived(spark, sf_dir).edges, "travel_time", [0.05, 0.25, 0.5, 0.75, 0.95])


@_query("SELECT src, smallest, second FROM (SELECT src, list(travel_time ORDER BY travel_time) AS l FROM edges GROUP BY src), LATERAL (SELECT l[1] AS smallest, l[2] AS second)")
def two_fastest_transfers(spark, sf_dir):
    return A.two_smallest(derived(spark, sf_dir).edges, ["src"], "travel_time")


# -- scalar functions -----------------------------------------------------


@_query(
    "SELECT trip, idx, dep AS seconds, (CASE WHEN dep // 3600 < 10 THEN '0' ELSE '' END) || (dep // 3600) || ':' || lpad(CAST(dep // 60 % 60 AS VARCHAR), 2, '0') || ':' || lpad(CAST(dep % 60 AS VARCHAR), 2, '0') AS clock, CAST(CASE WHEN dep <= 0 THEN 0 WHEN dep <= 600 THEN 1 WHEN dep <= 1200 THEN 2 WHEN dep <= 2400 THEN 3 ELSE 4 END AS BIGINT) AS bucket FROM ev"
)
def clock_times(spark, sf_dir):
    """Times written as text and read again."""
    clock = S.format_seconds(F.col("dep"))
    return derived(spark, sf_dir).events.select("trip", "idx", S.parse_seconds(clock).cast("long").alias("seconds"), clock.alias("clock"), S.transfer_bucket(F.col("dep")).alias("bucket"))


@_query("SELECT o_orderkey, strftime(o_orderdate, '%Y%m%d') AS day_text, CAST(datediff('day', DATE '1970-01-01', CAST(o_orderdate AS DATE)) AS BIGINT) AS day, CAST(dayofweek(o_orderdate) AS BIGINT) AS weekday FROM orders", network=False)
def service_days(spark, sf_dir):
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet")
    text = F.date_format("o_orderdate", "yyyyMMdd")
    day = S.parse_day(text)
    return orders.select("o_orderkey", S.format_day(day).alias("day_text"), day.cast("long").alias("day"), S.weekday(day).cast("long").alias("weekday"))


# -- journeys -------------------------------------------------------------

_Q = f"q AS MATERIALIZED ({J.queries_sql(BATCH)})"
_FRONT = f", {_Q}, {J.rounds_sql(ROUNDS)} "


def _batch(net):
    return J.hashed_queries(net.stops, BATCH)


@_query(f", {_Q} SELECT * FROM q")
def query_batch(spark, sf_dir):
    return _batch(derived(spark, sf_dir))


@_query(_FRONT + "SELECT query_id, stop, trips, arrival FROM front")
def pareto_arrivals(spark, sf_dir):
    """Arrival and trips, from every query's source to all stops."""
    net = derived(spark, sf_dir)
    return J.pareto(net, _batch(net))


@_query(_FRONT + "SELECT query_id, stop, min(arrival) AS arrival FROM front GROUP BY ALL")
def earliest_arrivals(spark, sf_dir):
    net = derived(spark, sf_dir)
    return J.earliest(net, _batch(net))


@_query(_FRONT + "SELECT front.* FROM front JOIN q ON q.query_id = front.query_id AND q.target = front.stop")
def target_journeys(spark, sf_dir):
    """One-to-one, with labels dropped that can't improve the target."""
    net = derived(spark, sf_dir)
    batch = _batch(net)
    return J.to_targets(J.pareto(net, batch, prune_targets=True), batch)


@_query(_FRONT + ", grid AS (SELECT DISTINCT query_id, stop, CAST(k AS BIGINT) AS trips FROM front, (SELECT range AS k FROM range(8))) SELECT * FROM (SELECT g.query_id, g.stop, g.trips, min(f.arrival) AS arrival FROM grid g LEFT JOIN front f ON f.query_id = g.query_id AND f.stop = g.stop AND f.trips <= g.trips GROUP BY ALL) WHERE arrival IS NOT NULL")
def arrivals_by_trips(spark, sf_dir):
    net = derived(spark, sf_dir)
    return J.arrival_times(J.pareto(net, _batch(net)), ROUNDS)


@_query(_FRONT + ", targets AS (SELECT s_nationkey AS set_id, s_suppkey AS vertex FROM supplier) SELECT CAST(set_id AS BIGINT) AS set_id, query_id, stop, trips, arrival FROM front JOIN targets ON vertex = stop")
def arrivals_at_target_sets(spark, sf_dir):
    """One-to-many: the stops of each nation are a target set."""
    net = derived(spark, sf_dir)
    sets = spark.read.parquet(f"{sf_dir}/supplier.parquet").select(F.col("s_nationkey").cast("long").alias("set_id"), F.col("s_suppkey").alias("vertex"))
    return J.to_sets(J.pareto(net, _batch(net)), sets).select("set_id", "query_id", "stop", "trips", "arrival")


@_query(_FRONT + "SELECT avg(k) AS journeys FROM (SELECT count(*) AS k FROM front GROUP BY query_id, stop)")
def journeys_per_query(spark, sf_dir):
    net = derived(spark, sf_dir)
    return A.journeys_per_query(J.pareto(net, _batch(net)))


@_query(
    ", p AS (SELECT stop, arr AS a, dep % 900 AS b FROM ev) SELECT DISTINCT stop, a, b FROM p WHERE NOT EXISTS (SELECT 1 FROM p o WHERE o.stop = p.stop AND o.a <= p.a AND o.b <= p.b AND (o.a < p.a OR o.b < p.b))"
)
def skyline_of_events(spark, sf_dir):
    rows = derived(spark, sf_dir).events.select("stop", F.col("arr").alias("a"), (F.col("dep") % 900).alias("b"))
    return skyline(rows, ["stop"], ["a", "b"])


def _bags_sql(rounds: int) -> str:
    """CTEs for three criteria: labels (query_id, stop, arr, w), their bags, and mfront."""
    best = lambda rows: f"SELECT DISTINCT query_id, stop, arr, w FROM (SELECT *, min(w) OVER (PARTITION BY query_id, stop ORDER BY arr, w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS m FROM (SELECT DISTINCT * FROM ({rows}))) WHERE m IS NULL OR w < m"
    fresh = lambda rows, bag: f"SELECT x.* FROM ({rows}) x WHERE NOT EXISTS (SELECT 1 FROM {bag} g WHERE g.query_id = x.query_id AND g.stop = x.stop AND g.arr <= x.arr AND g.w <= x.w)"
    parts = [f"m0 AS MATERIALIZED ({best('SELECT query_id, source AS stop, dep_time AS arr, CAST(0 AS BIGINT) AS w FROM q UNION ALL SELECT query_id, dst, dep_time + travel_time, travel_time FROM q JOIN edges ON src = source')})", "h0 AS (SELECT * FROM m0)"]
    for k in range(1, rounds + 1):
        parts += [
            f"c{k} AS MATERIALIZED (SELECT * FROM (SELECT *, min(w) OVER (PARTITION BY query_id, trip ORDER BY idx, w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS m FROM (SELECT DISTINCT a.query_id, e.trip, e.idx, a.w FROM m{k - 1} a JOIN ev e ON e.stop = a.stop JOIN stops s ON s.stop_id = e.stop WHERE e.dep - s.min_transfer_time >= a.arr AND e.idx < e.n - 1)) WHERE m IS NULL OR w < m)",
            f"d{k} AS MATERIALIZED ({fresh(best(f'SELECT c.query_id, e.stop, e.arr, c.w FROM c{k} c JOIN ev e ON e.trip = c.trip AND e.idx > c.idx'), f'h{k - 1}')})",
            f"m{k} AS MATERIALIZED ({fresh(best(f'SELECT * FROM d{k} UNION ALL SELECT query_id, dst, arr + travel_time, w + travel_time FROM d{k} JOIN edges ON src = stop'), f'h{k - 1}')})",
            f"h{k} AS MATERIALIZED ({best(f'SELECT * FROM h{k - 1} UNION ALL SELECT * FROM m{k}')})",
        ]
    union = " UNION ALL ".join(f"SELECT query_id, stop, CAST({k} AS BIGINT) AS trips, arr AS arrival, w AS t_walk FROM m{k}" for k in range(rounds + 1))
    return ", ".join([*parts, f"mfront AS ({union})"])


#: Rounds of the oracle for three criteria; Spark goes on until none improves anything.
_M_ROUNDS = 6


@_query(f", {_Q}, {_bags_sql(_M_ROUNDS)} SELECT * FROM mfront")
def pareto_with_walking(spark, sf_dir):
    """Arrival, trips and transfer time."""
    net = derived(spark, sf_dir)
    return M.pareto_sets(net, _batch(net))


def anchored_sql(rounds: int) -> str:
    """CTEs of the Pareto sets and their anchors: usable, labels (mfront) beside the anchors (k trips, a arrival) that count for them."""
    return (
        f", {_Q}, {J.rounds_sql(rounds)}, {_bags_sql(rounds)}, pairs AS (SELECT m.*, q.dep_time, f.trips AS k, f.arrival AS a FROM mfront m JOIN q USING (query_id) JOIN front f ON f.query_id = m.query_id AND f.stop = m.stop), "
        "usable AS (SELECT * FROM pairs p WHERE k > trips OR k = (SELECT max(f.trips) FROM front f WHERE f.query_id = p.query_id AND f.stop = p.stop AND f.trips <= p.trips)) "
    )


_ANCHORED = anchored_sql(_M_ROUNDS)


@_query(_ANCHORED + "SELECT DISTINCT query_id, stop, trips, arrival, t_walk FROM usable WHERE arrival - dep_time <= (a - dep_time) * 1.25::DOUBLE AND trips <= ceil(k * 1.25::DOUBLE)")
def restricted_pareto(spark, sf_dir):
    net = derived(spark, sf_dir)
    batch, rides = _batch(net), net.rides()
    return M.restricted(M.pareto_sets(net, batch, rides=rides), J.pareto(net, batch, rides=rides), batch, 1.25, 1.25)


# -- lines, transfers between trips, delays -------------------------------

_DELAYS = "delays AS (SELECT trip, trip * 15485863 % n AS first_idx, CASE " + " ".join(f"WHEN trip * 7919 % 1000 < {most} THEN {low} + trip * 104729 % {high - low + 1}" for most, low, high in D.CLASSES) + " END AS delay FROM ev WHERE idx = 0)"
_LATE = (
    f"{_DELAYS}, x AS (SELECT ev.*, arr + CASE WHEN idx >= first_idx THEN least(delay, 600) ELSE 0 END AS a, dep + CASE WHEN idx >= first_idx THEN least(delay, 900) ELSE 0 END AS d FROM ev JOIN delays USING (trip)), "
    "late AS (SELECT trip, idx, stop, CAST(min(least(a, d)) OVER (PARTITION BY trip ORDER BY idx ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS BIGINT) AS arr, "
    "CAST(least(d, coalesce(min(least(a, d)) OVER (PARTITION BY trip ORDER BY idx ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), d)) AS BIGINT) AS dep, n FROM x)"
)


@_query(f", {_DELAYS} SELECT trip, first_idx, delay FROM delays")
def delay_scenario(spark, sf_dir):
    return D.scenario(derived(spark, sf_dir).events)


@_query(f", {_LATE} SELECT * FROM late")
def delayed_events(spark, sf_dir):
    """Arrivals at most 600 and departures at most 900 seconds late."""
    ev = derived(spark, sf_dir).events
    return D.delayed(ev, D.scenario(ev), 600, 900)


_FIFO = (
    "e4 AS (SELECT trip * 3 + k AS trip, idx, stop, arr + k * 600 - CASE WHEN k = 1 THEN idx * 140 ELSE 0 END AS arr, dep + k * 600 - CASE WHEN k = 1 THEN idx * 140 ELSE 0 END AS dep, n FROM ev, (SELECT CAST(range AS BIGINT) AS k FROM range(3))), "
    f"{_SEQ.format(ev='e4')}, t AS MATERIALIZED (SELECT trip, stops, list_concat(deps, arrs) AS times, row_number() OVER (PARTITION BY stops ORDER BY deps, list_transform(arrs, lambda x: -x), trip) AS k FROM seq), "
    "fit AS (SELECT stops, k, [times] AS lasts, [trip] AS names, trip, trip AS line FROM t WHERE k = 1 UNION ALL "
    "SELECT stops, k, CASE WHEN p IS NULL THEN list_append(lasts, times) ELSE list_transform(lasts, lambda x, i: CASE WHEN i = p THEN times ELSE x END) END, CASE WHEN p IS NULL THEN list_append(names, trip) ELSE names END, trip, CASE WHEN p IS NULL THEN trip ELSE names[p] END "
    "FROM (SELECT t.stops, t.k, t.times, t.trip, f.lasts, f.names, nullif(list_position(list_transform(f.lasts, lambda l: len(list_filter(list_zip(l, t.times), lambda z: z[1] > z[2])) = 0), true), 0) AS p FROM fit f JOIN t ON t.stops = f.stops AND t.k = f.k + 1))"
)


def overtaken(events):
    """Three trips for each, ten minutes apart, the second of which makes up 140 seconds a halt."""
    k = F.explode(F.array(*(F.lit(x).cast("long") for x in range(3)))).alias("k")
    late = F.col("k") * 600 - F.when(F.col("k") == 1, F.col("idx") * 140).otherwise(0)
    return events.select("*", k).select((F.col("trip") * 3 + F.col("k")).alias("trip"), "idx", "stop", (F.col("arr") + late).alias("arr"), (F.col("dep") + late).alias("dep"), "n")


@_query(f", {_FIFO} SELECT trip, line FROM fit", recursive=True)
def fifo_lines(spark, sf_dir):
    """Lines without overtaking, by first fit in order of departures."""
    return fifo(overtaken(derived(spark, sf_dir).events))


_LINES = "e3 AS MATERIALIZED (SELECT trip * 3 + k AS trip, trip AS line, idx, stop, arr + k * 1800 AS arr, dep + k * 1800 AS dep, n FROM ev, (SELECT CAST(range AS BIGINT) AS k FROM range(3)))"
@_query(f", {_LATE} SELECT d.trip, d.first_idx, d.delay FROM delays d")
def streamed_delays(spark, sf_dir):
    """Updates written in four files and followed as a stream; every trip's last one is its delay."""
    ev = derived(spark, sf_dir).events
    final = D.scenario(ev)
    k = F.explode(F.array(*(F.lit(x) for x in range(4)))).alias("k")
    updates = final.select("*", k).where("k = 3 or pmod(trip + k, 3) = 0")
    updates = updates.select("trip", "first_idx", F.when(F.col("k") == 3, F.col("delay")).otherwise(F.col("k") * 7).alias("delay"), (F.col("k") * 600).cast("long").alias("reveal_time"))
    return follow(spark, keep_path(updates.repartition(4, "reveal_time"), "updates"), files=2)


@_query("SELECT time_bucket(INTERVAL '1 hour', CAST(ts AS TIMESTAMP)) AS start, count(*) AS events FROM events WHERE ts IS NOT NULL GROUP BY 1", network=False)
def streamed_event_counts(spark, sf_dir):
    table = spark.read.parquet(f"{sf_dir}/events.parquet")
    folder = keep_path(table.select(F.col("ts").cast("timestamp").alias("ts")), "events")
    return counts_by_window(spark, folder, "ts timestamp", "ts", lateness="3650 days")
