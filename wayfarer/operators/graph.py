"""Graph operators on edge tables (src, dst, travel_time).

Fixpoints are driver loops of joins and minima, each round ended by a reliable
checkpoint; the driver sees a row count, never rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import geo_distance_cm, travel_time
from ..storage import cut


def least_edges(edges: DataFrame, time: str = "travel_time") -> DataFrame:
    """One edge for each pair of vertices, the fastest."""
    return edges.groupBy("src", "dst").agg(F.min(time).alias(time))


def merge_edges(edges: DataFrame, **aggregates) -> DataFrame:
    """One edge for each pair of vertices, its attributes merged by the given aggregates."""
    return edges.groupBy("src", "dst").agg(*(c.alias(n) for n, c in aggregates.items()))


def without_loops(edges: DataFrame) -> DataFrame:
    return edges.where("src <> dst")


def transpose(edges: DataFrame) -> DataFrame:
    return edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), *(c for c in edges.columns if c not in ("src", "dst")))


def symmetric(edges: DataFrame) -> DataFrame:
    """Both directions of every edge, at the faster of the two."""
    return least_edges(edges.unionByName(transpose(edges)))


def with_reverse(edges: DataFrame) -> DataFrame:
    """Every edge beside the time of its reverse edge, null where there is none."""
    back = least_edges(edges).select(F.col("src").alias("dst"), F.col("dst").alias("src"), F.col("travel_time").alias("reverse_time"))
    return edges.join(back, ["src", "dst"], "left")


def graph_report(edges: DataFrame, vertices: DataFrame) -> DataFrame:
    """One row: vertices, edges, loops, pairs with several edges, isolated vertices, longest and total travel time."""
    pairs = edges.groupBy("src", "dst").agg(F.count(F.lit(1)).alias("k")).agg(F.coalesce(F.sum((F.col("k") > 1).cast("long")), F.lit(0)).alias("multi_edges"))
    touched = edges.where("src <> dst").select(F.explode(F.array("src", "dst")).alias("id")).distinct()
    isolated = vertices.join(touched, "id", "left_anti").agg(F.count(F.lit(1)).alias("isolated"))
    size = vertices.agg(F.count(F.lit(1)).alias("vertices"))
    own = edges.agg(F.count(F.lit(1)).alias("edges"), F.coalesce(F.sum((F.col("src") == F.col("dst")).cast("long")), F.lit(0)).alias("loops"), F.max("travel_time").alias("longest"), F.sum("travel_time").alias("total"))
    return size.crossJoin(own).crossJoin(pairs).crossJoin(isolated)  # of one row each


def distances(edges: DataFrame, sources: DataFrame, limit: int | None = None) -> DataFrame:
    """Shortest paths from every source (column ``source``): (source, vertex, distance), up to ``limit``."""
    edges = cut(least_edges(edges.where("src <> dst")))
    best = cut(sources.select("source", F.col("source").alias("vertex"), F.lit(0).cast("long").alias("distance")).distinct())
    frontier = best
    while True:
        step = frontier.join(edges, frontier.vertex == edges.src).select("source", F.col("dst").alias("vertex"), (F.col("distance") + F.col("travel_time")).alias("distance"))
        if limit is not None:
            step = step.where(F.col("distance") <= limit)
        step = step.groupBy("source", "vertex").agg(F.min("distance").alias("distance"))
        old = best.select("source", "vertex", F.col("distance").alias("old"))
        frontier = cut(step.join(old, ["source", "vertex"], "left").where("old is null or distance < old").drop("old"))
        if not frontier.limit(1).count():
            return best
        best = cut(best.unionByName(frontier).groupBy("source", "vertex").agg(F.min("distance").alias("distance")))


def closure(edges: DataFrame, limit: int | None = None) -> DataFrame:
    """Transitively closed: an edge for every shortest path (up to ``limit``).

    Paths double in length each round: those that the last round improved are joined to all before and behind them.
    """
    best = cut(least_edges(edges.where("src <> dst")))
    if limit is not None:
        best = best.where(F.col("travel_time") <= limit)
    new = best
    while True:
        ahead = lambda x, y: x.select("src", F.col("dst").alias("m"), F.col("travel_time").alias("s")).join(y.select(F.col("src").alias("m"), "dst", F.col("travel_time").alias("t")), "m").select("src", "dst", (F.col("s") + F.col("t")).alias("travel_time"))
        step = ahead(new, best).unionByName(ahead(best, new)).where("src <> dst")
        if limit is not None:
            step = step.where(F.col("travel_time") <= limit)
        old = best.select("src", "dst", F.col("travel_time").alias("old"))
        new = cut(least_edges(step).join(old, ["src", "dst"], "left").where("old is null or travel_time < old").drop("old"))
        if not new.limit(1).count():
            return best
        best = cut(least_edges(best.unionByName(new)))


def one_hop_transfers(edges: DataFrame, stops: DataFrame, limit: int) -> DataFrame:
    """Direct transfers between stops (stop_id) for every shortest path of ``limit`` at most, the faster direction for both; searches begin at stops only."""
    found = distances(edges, stops.select(F.col("stop_id").alias("source")), limit).join(stops.select(F.col("stop_id").alias("vertex")), "vertex", "left_semi")
    return symmetric(found.where("source <> vertex").select(F.col("source").alias("src"), F.col("vertex").alias("dst"), F.col("distance").alias("travel_time")))


def reach(edges: DataFrame, labels: DataFrame) -> DataFrame:
    """The smallest of ``labels`` (id, label) that reaches each vertex along edges."""
    edges = edges.select("src", "dst").distinct()
    best = cut(labels.select("id", "label"))
    frontier = best
    while True:
        step = frontier.join(edges, frontier.id == edges.src).groupBy(F.col("dst").alias("id")).agg(F.min("label").alias("new"))
        frontier = cut(step.join(best, "id").where("new < label").select("id", F.col("new").alias("label")))
        if not frontier.limit(1).count():
            return best
        best = cut(best.unionByName(frontier).groupBy("id").agg(F.min("label").alias("label")))


def strong_components(edges: DataFrame, vertices: DataFrame) -> DataFrame:
    """(id, component): vertices that reach each other; a component is named by its smallest vertex.

    Each turn, the smallest vertex that reaches a vertex names its candidate; those it is reached from as well,
    without leaving the candidate, form its component and go.
    """
    left = cut(vertices.select("id"))
    edges = cut(edges.select("src", "dst").where("src <> dst").distinct())
    done = None
    while left.limit(1).count():
        color = reach(edges, left.withColumn("label", F.col("id")))
        s, d = color.select(F.col("id").alias("src"), F.col("label").alias("a")), color.select(F.col("id").alias("dst"), F.col("label").alias("b"))
        inside = cut(edges.join(s, "src").join(d, "dst").where("a = b").select("src", "dst"))
        # backwards from each candidate's name
        roots = color.withColumn("label", F.when(F.col("id") == F.col("label"), F.lit(0)).otherwise(F.lit(1)))
        back = reach(transpose(inside), roots).where("label = 0").select("id")
        part = cut(color.join(back, "id").select("id", F.col("label").alias("component")))
        done = part if done is None else cut(done.unionByName(part))
        left = cut(left.join(part.select("id"), "id", "left_anti"))
        keep = left.select("id")
        edges = cut(inside.join(keep.withColumnRenamed("id", "src"), "src", "left_semi").join(keep.withColumnRenamed("id", "dst"), "dst", "left_semi"))
    return done if done is not None else vertices.select("id", F.col("id").alias("component"))


def component_sizes(components: DataFrame) -> DataFrame:
    return components.groupBy("component").agg(F.count(F.lit(1)).alias("size"))


def largest_component(components: DataFrame) -> DataFrame:
    """Ids of the largest component; of equal ones that with the smallest name."""
    top = component_sizes(components).orderBy(F.desc("size"), "component").limit(1).select("component")
    return components.join(top, "component", "left_semi").select("id")


def is_acyclic(edges: DataFrame) -> bool:
    """Whether no path leads back: vertices without incoming edges are taken away until none is left."""
    edges = cut(edges.select("src", "dst").distinct())
    while True:
        inner = edges.join(edges.select(F.col("dst").alias("src")).distinct(), "src", "left_semi")
        inner = cut(inner)
        if not inner.limit(1).count():
            return True
        if inner.count() == edges.count():
            return False
        edges = inner


def reduce_graph(edges: DataFrame, stops: DataFrame) -> DataFrame:
    """Without vertices, other than stops, that at most two neighbours touch; distances between the others stay.

    A round takes away vertices no two of which are neighbours: of neighbouring candidates the smallest.
    """
    keep = stops.select(F.col("stop_id").alias("id"))
    edges = cut(least_edges(edges.where("src <> dst")))
    while True:
        ends = edges.select("src", "dst").unionByName(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).distinct()
        few = ends.groupBy(F.col("src").alias("id")).agg(F.count(F.lit(1)).alias("k")).where("k <= 2").join(keep, "id", "left_anti").select("id")
        few = cut(few)
        near = ends.join(few.withColumnRenamed("id", "src"), "src", "left_semi").join(few.withColumnRenamed("id", "dst"), "dst", "left_semi")
        blocked = near.where("dst < src").select(F.col("src").alias("id")).distinct()
        gone = cut(few.join(blocked, "id", "left_anti"))
        if not gone.limit(1).count():
            return edges
        into = edges.join(gone.withColumnRenamed("id", "dst"), "dst", "left_semi").select(F.col("src").alias("a"), F.col("dst").alias("v"), F.col("travel_time").alias("s"))
        out = edges.join(gone.withColumnRenamed("id", "src"), "src", "left_semi").select(F.col("src").alias("v"), F.col("dst").alias("b"), F.col("travel_time").alias("t"))
        through = into.join(out, "v").where("a <> b").select(F.col("a").alias("src"), F.col("b").alias("dst"), (F.col("s") + F.col("t")).alias("travel_time"))
        rest = edges.join(gone.withColumnRenamed("id", "src"), "src", "left_anti").join(gone.withColumnRenamed("id", "dst"), "dst", "left_anti")
        edges = cut(least_edges(rest.unionByName(through)))


def isolate_degree_one(edges: DataFrame, keep: DataFrame) -> DataFrame:
    """Without vertices, other than those of ``keep`` (id), that a single neighbour touches, until none is left."""
    edges = cut(edges.where("src <> dst"))
    while True:
        ends = edges.select("src", "dst").unionByName(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).distinct()
        one = cut(ends.groupBy(F.col("src").alias("id")).agg(F.count(F.lit(1)).alias("k")).where("k = 1").join(keep.select("id"), "id", "left_anti").select("id"))
        if not one.limit(1).count():
            return edges
        for end in ("src", "dst"):
            edges = edges.join(one.withColumnRenamed("id", end), end, "left_anti")
        edges = cut(edges)


def min_change_time_graph(edges: DataFrame, stops: DataFrame) -> DataFrame:
    """Transfers that a walk away from a stop and back within its minimum transfer time can't replace.

    From every stop, paths go on as long as they take half its wait at most.  Vertices they end at that are stops or lie
    beyond, and that the stop has no edge to which is as short, get an edge both ways.
    """
    half = stops.select(F.col("stop_id").alias("source"), F.floor(F.col("min_transfer_time") / 2).cast("long").alias("range"))
    most = half.agg(F.max("range")).first()[0] or 0
    near = distances(edges, half.select("source"), int(most)).join(half, "source").where("distance <= range")
    least = least_edges(edges.where("src <> dst"))
    beyond = near.join(least, near.vertex == least.src).select("source", F.col("dst").alias("vertex"), (F.col("distance") + F.col("travel_time")).alias("distance"))
    best = near.select("source", "vertex", "distance").unionByName(beyond).groupBy("source", "vertex").agg(F.min("distance").alias("distance")).where("source <> vertex")
    direct = least.select(F.col("src").alias("source"), F.col("dst").alias("vertex"), F.col("travel_time").alias("straight"))
    rows = best.join(direct, ["source", "vertex"], "left").where("straight is null or straight > distance").join(half, "source")
    at_stop = stops.select(F.col("stop_id").alias("vertex"), F.lit(True).alias("at_stop"))
    rows = rows.join(at_stop, "vertex", "left").where("distance > range or at_stop")
    return symmetric(rows.select(F.col("source").alias("src"), F.col("vertex").alias("dst"), F.col("distance").alias("travel_time")))


def balls(edges: DataFrame, centers: DataFrame, size: int, start: int = 300) -> DataFrame:
    """(center, vertex, distance): the ``size`` nearest vertices of each center (id), itself among them; of equally near ones the smallest ids.

    The range doubles for centers that haven't found enough and still find more.
    """
    left, out, limit = cut(centers.select(F.col("id").alias("source"))), None, start
    longest = edges.agg(F.max("travel_time")).first()[0] or 0
    before = None
    while left.limit(1).count():
        found = cut(distances(edges, left, limit))
        many = found.groupBy("source").agg(F.count(F.lit(1)).alias("k"))
        done = many.where(F.col("k") >= size).select("source")
        if before is not None:  # the range grew by more than any edge: who found nothing new has found all
            done = done.union(many.join(before, ["source", "k"], "left_semi").select("source")).distinct()
        done = cut(done)
        order = Window.partitionBy("source").orderBy("distance", "vertex")
        part = found.join(done, "source", "left_semi").withColumn("n", F.row_number().over(order)).where(F.col("n") <= size)
        part = part.select(F.col("source").alias("center"), "vertex", "distance")
        out = part if out is None else out.unionByName(part)
        left = cut(left.join(done, "source", "left_anti"))
        before, limit = cut(many), limit * 2 + longest
    return out if out is not None else centers.select(F.col("id").alias("center"), F.col("id").alias("vertex"), F.lit(0).cast("long").alias("distance"))


def least_mode_edges(modes: dict[str, DataFrame]) -> DataFrame:
    """The fastest mode's time of each pair of vertices: a lower bound for searches over several modes."""
    out = None
    for edges in modes.values():
        out = edges.select("src", "dst", "travel_time") if out is None else out.unionByName(edges.select("src", "dst", "travel_time"))
    return least_edges(out)


def merge_shortcuts(old: DataFrame, new: DataFrame, most: int = 2**30) -> DataFrame:
    """Old shortcuts (src, dst, travel_time, min_delay, max_delay) and new ones (src, dst, travel_time): those that are new, or found again, count for every delay."""
    n = new.select("src", "dst", F.col("travel_time").alias("_t"))
    both = old.join(n, ["src", "dst"], "full_outer")
    again = F.col("_t").isNotNull()
    return both.select("src", "dst", F.coalesce("travel_time", "_t").alias("travel_time"), F.when(again, 0).otherwise(F.col("min_delay")).cast("long").alias("min_delay"), F.when(again, most).otherwise(F.col("max_delay")).cast("long").alias("max_delay"))


def wrong_shortcuts(shortcuts: DataFrame, edges: DataFrame) -> DataFrame:
    """Shortcuts (src, dst, travel_time) that aren't shortest paths of ``edges``, beside the distance, null where there is no path."""
    found = distances(edges, shortcuts.select(F.col("src").alias("source")).distinct())
    found = found.select(F.col("source").alias("src"), F.col("vertex").alias("dst"), "distance")
    return shortcuts.join(found, ["src", "dst"], "left").where("distance is null or distance <> travel_time").select("src", "dst", "travel_time", "distance")


# -- places ---------------------------------------------------------------


def _cells(points: DataFrame, degrees: float, spread: bool) -> DataFrame:
    """Points with their grid cell, or with the cells around it.  A cell's width in longitude follows from its row's latitude, and columns meet again at 180 degrees."""
    row = F.floor(F.col("lat") / degrees)
    near = F.array(*(row + j for j in (-1, 0, 1))) if spread else F.array(row)
    rows = points.withColumn("_y", F.explode(near))
    # the row's greatest latitude decides how wide its cells are, so that a neighbour is one column away at most
    edge = F.least(F.greatest(F.abs(F.col("_y")), F.abs(F.col("_y") + 1), F.abs(F.col("_y") + 2), F.abs(F.col("_y") - 1)) * degrees, F.lit(89.9))
    columns = F.greatest(F.floor(F.cos(F.radians(edge)) * (360 / degrees)), F.lit(1))
    x = F.floor((F.col("lon") + 180) / 360 * columns)
    beside = F.array_distinct(F.transform(F.array(*(F.lit(i) for i in (-1, 0, 1))), lambda i: F.pmod(x + i, columns))) if spread else F.array(F.pmod(x, columns))
    return rows.withColumn("_x", F.explode(beside))


def within_range(points: DataFrame, others: DataFrame, cm: float) -> DataFrame:
    """Pairs (id, other, distance) at most ``cm`` apart; both tables (id, lat, lon).

    An equality join on cells at least as wide as the range, then the exact distance, both for different places only; the
    points and others of each pair of places are joined to it afterwards, by place, which spreads them further than cells do.
    """
    degrees = min(max(cm / 100 / 55_000.0, 1e-6), 180.0)
    a = _cells(points.select("lat", "lon").distinct(), degrees, True)
    b = _cells(others.select("lat", "lon").distinct(), degrees, False)
    b = b.select(F.col("lat").alias("lat2"), F.col("lon").alias("lon2"), "_x", "_y")
    both = a.join(b, ["_x", "_y"]).withColumn("distance", geo_distance_cm(F.col("lat"), F.col("lon"), F.col("lat2"), F.col("lon2")))
    near = cut(both.where(F.col("distance") <= cm).select("lat", "lon", "lat2", "lon2", "distance"))
    # few places may stand for very many points, so their pairs are spread by number, not by size
    spread = near.repartition(int(near.sparkSession.conf.get("spark.sql.shuffle.partitions")), "lat", "lon", "lat2", "lon2")
    ids = spread.join(points.select("id", "lat", "lon"), ["lat", "lon"]).select("id", "lat2", "lon2", "distance")
    return ids.join(others.select(F.col("id").alias("other"), F.col("lat").alias("lat2"), F.col("lon").alias("lon2")), ["lat2", "lon2"]).select("id", "other", "distance")


def nearest(points: DataFrame, others: DataFrame, start_cm: float = 10_000.0) -> DataFrame:
    """The nearest of ``others`` for each point, of equal ones the smallest id: (id, other, distance); the range doubles for points that found none."""
    left, out, cm = cut(points.select("id", "lat", "lon")), None, start_cm
    some = others.limit(1).count() > 0
    while some and left.limit(1).count():
        hit = within_range(left, others, cm).groupBy("id").agg(F.min(F.struct("distance", "other")).alias("m"))
        hit = cut(hit.select("id", F.col("m.other").alias("other"), F.col("m.distance").alias("distance")))
        out = hit if out is None else cut(out.unionByName(hit))
        left = cut(left.join(hit.select("id"), "id", "left_anti"))
        cm *= 4
        if cm > 3e9:
            break
    return out if out is not None else points.select("id", F.lit(None).cast("long").alias("other"), F.lit(None).cast("double").alias("distance")).limit(0)


def transfers_by_range(stops: DataFrame, cm: float, kmh: float = 4.5) -> DataFrame:
    """Directed transfers between all stops (id, lat, lon) at most ``cm`` apart."""
    pairs = within_range(stops, stops, cm).where("id <> other")
    return pairs.select(F.col("id").alias("src"), F.col("other").alias("dst"), travel_time(F.col("distance"), kmh).alias("travel_time"))


def connect_isolated(edges: DataFrame, stops: DataFrame, cm: float = 1000.0, kmh: float = 4.5) -> DataFrame:
    """Adds transfers, both ways, between stops without outgoing edges and the stops at most ``cm`` away; distances count one centimetre at least."""
    lonely = stops.join(edges.select(F.col("src").alias("id")).distinct(), "id", "left_anti")
    pairs = within_range(lonely, stops, cm).where("id <> other")
    new = pairs.select(F.col("id").alias("src"), F.col("other").alias("dst"), travel_time(F.greatest("distance", F.lit(1.0)), kmh).alias("travel_time"))
    return least_edges(edges.unionByName(new).unionByName(transpose(new)))


def merge_graph(edges: DataFrame, stops: DataFrame, road_edges: DataFrame, road: DataFrame, unify_cm: float = 500.0, snap_cm: float = 10_000.0, kmh: float = 4.5) -> DataFrame:
    """Transfers of stops and of a road graph in one: a stop takes the place of its nearest road vertex within ``unify_cm`` (the closest stop of a vertex does), others within ``snap_cm`` are tied to it.

    Road vertices are renumbered behind the stops' ids; every road edge counts in both directions.
    """
    near = nearest(stops, road).where(F.col("distance") <= snap_cm)
    first = F.row_number().over(Window.partitionBy("other").orderBy("distance", "id"))
    near = cut(near.withColumn("one", (first == 1) & (F.col("distance") <= unify_cm)))
    top = stops.agg((F.max("id") + 1).alias("top"))
    names = road.select(F.col("id").alias("other")).crossJoin(F.broadcast(top)).join(near.where("one").select("other", F.col("id").alias("stop")), "other", "left")
    names = cut(names.select("other", F.coalesce("stop", F.col("other") + F.col("top")).alias("name")))
    moved = road_edges.select("src", "dst", "travel_time")
    for end in ("src", "dst"):
        moved = moved.join(names.withColumnRenamed("other", end), end).drop(end).withColumnRenamed("name", end)
    ties = near.where("not one").join(names, "other").select(F.col("id").alias("src"), F.col("name").alias("dst"), travel_time(F.greatest("distance", F.lit(1.0)), kmh).alias("travel_time"))
    return symmetric(edges.select("src", "dst", "travel_time").unionByName(moved.select("src", "dst", "travel_time")).unionByName(ties).where("src <> dst"))
