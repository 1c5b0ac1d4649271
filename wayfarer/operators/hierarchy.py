"""Contraction hierarchies of road graphs, hub labels and level sweeps, as joins and minima.

A round contracts a set of vertices no two of which are neighbours, those whose
key is smaller than their neighbours' keys.  Every pair of a neighbour before
and a neighbour behind a contracted vertex is a possible shortcut; it is added
unless a witness, a path of a few edges past all vertices of the round, is as
short.  What leaves the graph with a vertex are its edges, all to vertices of
higher levels: ``up`` has those that lead away from it, ``down`` those that lead
to it.  A round's work is bounded by the squares of the contracted vertices'
degrees; vertices of a greater degree than ``most_degree`` stay in the core.

Every shortest path has a form that goes up, through the core and down again.
So a search from a vertex along ``up`` and one from the goal against ``down`` meet
at a vertex of the path: their results are the hub labels of the two, distances
are equality joins on the hub, and the distances from some vertices to all are
a search upwards and one join a level downwards.

Edges: (src, dst, travel_time).
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..storage import cut
from .graph import distances, least_edges, transpose

#: Key of a vertex, by columns ins, outs, degree (neighbours) and level; the smallest of neighbouring ones goes first.
Key = Callable[[], Column]


def greedy_key(shortcut_weight: int = 1024, level_weight: int = 256) -> Column:
    """Few possible shortcuts for each edge that goes, and low levels; dead ends and passages first."""
    pairs = F.col("ins") * F.col("outs")
    key = (pairs * shortcut_weight / (F.col("ins") + F.col("outs"))).cast("long") + F.col("level") * level_weight
    return F.when(F.col("degree") <= 1, F.col("level") - 1_000_000_000).when(F.col("degree") == 2, F.col("level") - 1_000_000).otherwise(key).cast("long")


def order_key() -> Column:
    """Vertices in a given order: ``rank`` of the table given as ``order``."""
    return F.col("rank").cast("long")


@dataclass(frozen=True)
class Hierarchy:
    """``up`` and ``down`` (src, dst, travel_time, via) with the core's edges in both, ``levels`` (id, level), the core's level."""

    up: DataFrame
    down: DataFrame
    core: DataFrame
    levels: DataFrame
    top: int

    def order(self) -> DataFrame:
        """(id, level, rank): vertices in the order in which they were contracted, the core's last; equal levels by id, ranks level by level."""
        sizes = {r["level"]: r["n"] for r in self.levels.groupBy("level").agg(F.count(F.lit(1)).alias("n")).collect()}  # a row for each round
        before, at = {}, 0
        for k in sorted(sizes):
            before[k], at = at, at + sizes[k]
        first = F.element_at(F.create_map(*(F.lit(x).cast("long") for kv in before.items() for x in kv)), F.col("level")) if before else F.lit(0)
        # a level's vertices are numbered in ranges of ids, not in one task
        return _numbered(self.levels).withColumn("rank", F.col("rank") + first)


def _numbered(levels: DataFrame) -> DataFrame:
    """Vertices numbered from 0 within each level, by blocks of ids."""
    block = F.floor(F.col("id") / 4096)
    rows = levels.withColumn("_b", block)
    count = rows.groupBy("level", "_b").agg(F.count(F.lit(1)).alias("_n"))
    before = count.withColumn("_before", F.coalesce(F.sum("_n").over(Window.partitionBy("level").orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("_n")
    inner = F.row_number().over(Window.partitionBy("level", "_b").orderBy("id")) - 1
    return rows.withColumn("_k", inner).join(before, ["level", "_b"]).select("id", "level", (F.col("_before") + F.col("_k")).cast("long").alias("rank"))


def _chosen(edges: DataFrame, levels: DataFrame, keep: DataFrame | None, key: Column, most_degree: int | None, order: DataFrame | None) -> DataFrame:
    """Vertices (id) of an independent set: those whose key is the smallest around."""
    out = edges.groupBy(F.col("src").alias("id")).agg(F.count(F.lit(1)).alias("outs"))
    into = edges.groupBy(F.col("dst").alias("id")).agg(F.count(F.lit(1)).alias("ins"))
    ends = edges.select("src", "dst").unionByName(transpose(edges.select("src", "dst"))).distinct()
    degree = ends.groupBy(F.col("src").alias("id")).agg(F.count(F.lit(1)).alias("degree"))
    stats = degree.join(out, "id", "left").join(into, "id", "left").join(levels, "id", "left").na.fill(0, ["outs", "ins", "level"])
    if order is not None:
        stats = stats.join(order, "id")
    stats = stats.withColumn("key", key)
    if keep is not None:
        stats = stats.join(keep.select("id"), "id", "left_anti")
    if most_degree is not None:
        stats = stats.where(F.col("degree") <= most_degree)
    # of equal keys a hash decides, so that long rows of alike vertices aren't contracted one at a time
    ranked = stats.select("id", F.struct("key", F.xxhash64("id").alias("h"), "id").alias("k"))
    near = ends.join(ranked.select(F.col("id").alias("dst"), F.col("k").alias("other")), "dst").groupBy(F.col("src").alias("id")).agg(F.min("other").alias("least"))
    return ranked.join(near, "id", "left").where("least is null or k < least").select("id")


def _witnessed(pairs: DataFrame, rest: DataFrame, hops: int) -> DataFrame:
    """Pairs (src, dst, travel_time, via) that no path of at most ``hops`` edges of ``rest`` is as short as."""
    limit = pairs.groupBy(F.col("src").alias("_s")).agg(F.max("travel_time").alias("_most"))
    step = rest.select(F.col("src").alias("_x"), F.col("dst").alias("_y"), F.col("travel_time").alias("_t"))
    reach = limit.select("_s", "_most", F.col("_s").alias("_at"), F.lit(0).cast("long").alias("_d"))
    found = None
    for _ in range(hops):
        reach = reach.join(step, F.col("_at") == F.col("_x")).select("_s", "_most", F.col("_y").alias("_at"), (F.col("_d") + F.col("_t")).alias("_d")).where("_d <= _most and _at <> _s")
        reach = reach.groupBy("_s", "_at").agg(F.min("_d").alias("_d"), F.first("_most").alias("_most"))
        found = reach if found is None else found.unionByName(reach)
    best = found.groupBy(F.col("_s").alias("src"), F.col("_at").alias("dst")).agg(F.min("_d").alias("_d"))
    return pairs.join(best, ["src", "dst"], "left").where("_d is null or _d > travel_time").drop("_d")


def hierarchy(edges: DataFrame, keep: DataFrame | None = None, key: Column | None = None, order: DataFrame | None = None, hops: int = 2, most_degree: int | None = 64, least: int = 32) -> Hierarchy:
    """Contracts all vertices but those of ``keep`` (id), as long as more than ``least`` can go.

    ``order``: (id, rank), with ``key=order_key()``.  ``hops``: edges of a witness; ``most_degree``: vertices with more neighbours stay.
    """
    key = greedy_key() if key is None else key
    core = cut(least_edges(edges.where("src <> dst")).withColumn("via", F.lit(None).cast("long")).select("src", "dst", F.col("travel_time").cast("long").alias("travel_time"), "via"))
    ids = cut(core.select(F.explode(F.array("src", "dst")).alias("id")).distinct())
    # a vertex lies above all its neighbours that went before it
    floor = ids.select("id", F.lit(0).cast("long").alias("level"))
    gone: list[DataFrame] = []
    up: list[DataFrame] = []
    down: list[DataFrame] = []
    left, k = ids.count() - (keep.join(ids, "id", "left_semi").count() if keep is not None else 0), 0
    while left > least:
        chosen = cut(_chosen(core, floor, keep, key, most_degree, order))
        n = chosen.count()
        if not n:
            break
        # every edge leads away from a chosen vertex, to one, or neither
        sides = core.join(chosen.select(F.col("id").alias("src"), F.lit(1).alias("_s")), "src", "left").join(chosen.select(F.col("id").alias("dst"), F.lit(1).alias("_d")), "dst", "left")
        sides = cut(sides.select("src", "dst", "travel_time", "via", "_s", "_d"))
        away, into, rest = (sides.where(c).select(*core.columns) for c in ("_s = 1", "_d = 1", "_s is null and _d is null"))
        first = into.select("src", F.col("dst").alias("via"), F.col("travel_time").alias("_a"))
        second = away.select(F.col("src").alias("via"), "dst", F.col("travel_time").alias("_b"))
        pairs = first.join(second, "via").where("src <> dst").groupBy("src", "dst").agg(F.min(F.struct((F.col("_a") + F.col("_b")).alias("travel_time"), "via")).alias("m")).select("src", "dst", "m.*")
        added = _witnessed(cut(pairs), rest, hops)
        both = rest.unionByName(added.select(*core.columns))
        # of equally long ones the edge that was there
        core = cut(both.groupBy("src", "dst").agg(F.min(F.struct("travel_time", "via")).alias("m")).select("src", "dst", "m.travel_time", "m.via"))
        up.append(away)
        down.append(into)
        gone.append(chosen.withColumn("level", F.lit(k).cast("long")))
        near = away.select(F.col("dst").alias("id"), F.col("src").alias("_v")).unionByName(into.select(F.col("src").alias("id"), F.col("dst").alias("_v")))
        lifted = near.join(floor.select(F.col("id").alias("_v"), "level"), "_v").groupBy("id").agg((F.max("level") + 1).alias("_l"))
        floor = cut(floor.join(chosen, "id", "left_anti").join(lifted, "id", "left").select("id", F.greatest("level", F.coalesce("_l", "level")).alias("level")))
        left, k = left - n, k + 1
    levels = floor.select("id", F.lit(k).cast("long").alias("level"))
    ups, downs = core, core
    for part in gone:
        levels = levels.unionByName(part)
    for part in up:
        ups = ups.unionByName(part)
    for part in down:
        downs = downs.unionByName(part)
    return Hierarchy(cut(ups), cut(downs), core, cut(levels), k)


def hierarchy_report(h: Hierarchy) -> DataFrame:
    """(level, vertices, up_edges, down_edges, shortcuts): what each level has; shortcuts of both directions."""
    of = lambda edges, end, name: edges.join(h.levels.withColumnRenamed("id", end), end).groupBy("level").agg(F.count(F.lit(1)).alias(name), F.count("via").alias(f"_{name}"))
    rows = h.levels.groupBy("level").agg(F.count(F.lit(1)).alias("vertices"))
    rows = rows.join(of(h.up, "src", "up_edges"), "level", "left").join(of(h.down, "dst", "down_edges"), "level", "left").na.fill(0)
    return rows.select("level", "vertices", "up_edges", "down_edges", (F.col("_up_edges") + F.col("_down_edges")).alias("shortcuts"))


# -- hub labels -------------------------------------------------------------------


def _labels(search: DataFrame, against: DataFrame, sources: DataFrame, limit: int | None) -> DataFrame:
    """(vertex, hub, distance) along ``search``, without labels that an edge of ``against`` shows to be detours."""
    found = cut(distances(search.select("src", "dst", "travel_time"), sources.select(F.col("id").alias("source")).distinct(), limit))
    shorter = found.join(against.select(F.col("src").alias("vertex"), F.col("dst").alias("hub"), F.col("travel_time").alias("_t")), "vertex").groupBy("source", "hub").agg(F.min(F.col("distance") + F.col("_t")).alias("_d"))
    rows = found.withColumnRenamed("vertex", "hub").join(shorter, ["source", "hub"], "left").where("_d is null or _d >= distance")
    return cut(rows.select(F.col("source").alias("vertex"), "hub", "distance"))


def labels_from(h: Hierarchy, sources: DataFrame, limit: int | None = None) -> DataFrame:
    """Hubs that each source (id) reaches upwards: (vertex, hub, distance)."""
    return _labels(h.up, h.down, sources, limit)


def labels_to(h: Hierarchy, targets: DataFrame, limit: int | None = None) -> DataFrame:
    """Hubs that reach each target (id) downwards: (vertex, hub, distance)."""
    return _labels(transpose(h.down), transpose(h.up), targets, limit)


def hub_distances(a: DataFrame, b: DataFrame, limit: int | None = None) -> DataFrame:
    """(src, dst, travel_time) of the vertices of labels ``a`` (from) and ``b`` (to): a join on the hub, the least sum of each pair."""
    both = a.select("hub", F.col("vertex").alias("src"), F.col("distance").alias("_a")).join(b.select("hub", F.col("vertex").alias("dst"), F.col("distance").alias("_b")), "hub")
    rows = both.select("src", "dst", (F.col("_a") + F.col("_b")).alias("travel_time")).where("src <> dst")
    if limit is not None:
        rows = rows.where(F.col("travel_time") <= limit)
    return least_edges(rows)


@dataclass(frozen=True)
class Hubs:
    """Walks of any length between places, through the hubs they share."""

    out: DataFrame
    into: DataFrame

    @classmethod
    def between(cls, h: Hierarchy, stops: DataFrame, sources: DataFrame | None = None) -> Hubs:
        """From stops (id) and ``sources`` (id) to stops."""
        begin = stops.select("id") if sources is None else stops.select("id").unionByName(sources.select("id")).distinct()
        return cls(labels_from(h, begin), labels_to(h, stops))

    def moved(self, rows: DataFrame, key: Sequence[str], place: str, time: str, carried: Sequence[str] = (), costs: Sequence[str] = ()) -> DataFrame:
        """``rows`` after a walk to each stop: (key, place, time, carried, via), the best at each hub going on; ``via`` is where the walk began.

        With ``costs`` (numbers that grow with the walk like the time) all Pareto-optimal rows of a hub go on.
        """
        from .skyline import skyline

        began = rows.select(*key, F.col(place).alias("via"), time, *carried, *costs)
        out = self.out.select(F.col("vertex").alias("via"), "hub", "distance")
        at = began.join(out, "via").select(*key, "hub", "via", (F.col(time) + F.col("distance")).alias(time), *carried, *((F.col(c) + F.col("distance")).alias(c) for c in costs))
        if costs:
            at = skyline(at, [*key, "hub"], [time, *costs])
        else:
            at = at.groupBy(*key, "hub").agg(F.min(F.struct(time, *carried, "via")).alias("_m")).select(*key, "hub", "_m.*")
        into = self.into.select("hub", F.col("vertex").alias(place), "distance")
        end = at.join(into, "hub").where(F.col("via") != F.col(place))
        return end.select(*key, place, (F.col(time) + F.col("distance")).alias(time), *carried, "via", *((F.col(c) + F.col("distance")).alias(c) for c in costs))


# -- sweeps -----------------------------------------------------------------------


def sweep(h: Hierarchy, begin: DataFrame, key: Sequence[str], value: str) -> DataFrame:
    """(key, vertex, value): the least value at every vertex that the rows of ``begin`` (key, vertex, value) lead to.

    All keys search upwards together; then values go down level by level, one join a level, in which a level's vertices
    take offers from what lies above them.
    """
    key = list(key)
    least = lambda rows: rows.groupBy(*key, "vertex").agg(F.min(value).alias(value))
    up = h.up.select(F.col("src").alias("vertex"), "dst", "travel_time")
    best = cut(least(begin.select(*key, "vertex", value)))
    frontier = best
    while True:
        step = least(frontier.join(up, "vertex").select(*key, F.col("dst").alias("vertex"), (F.col(value) + F.col("travel_time")).alias(value)))
        old = best.select(*key, "vertex", F.col(value).alias("_old"))
        frontier = cut(step.join(old, [*key, "vertex"], "left").where(F.col("_old").isNull() | (F.col(value) < F.col("_old"))).drop("_old"))
        if not frontier.limit(1).count():
            break
        best = cut(least(best.unionByName(frontier)))
    placed = cut(best.join(h.levels.withColumnRenamed("id", "vertex"), "vertex").select(*key, "vertex", value, "level"))
    below = cut(h.down.join(h.levels.withColumnRenamed("id", "dst"), "dst").where(F.col("level") < h.top).select("src", "dst", "travel_time", "level"))
    done = placed.where(F.col("level") == h.top).drop("level")
    for k in range(h.top - 1, -1, -1):
        edges = below.where(F.col("level") == k).select(F.col("src").alias("vertex"), "dst", "travel_time")
        offers = done.join(edges, "vertex").select(*key, F.col("dst").alias("vertex"), (F.col(value) + F.col("travel_time")).alias(value))
        done = done.unionByName(cut(least(placed.where(F.col("level") == k).drop("level").unionByName(offers))))
    # vertices that no edge touches are in no level
    lone = best.join(h.levels.select(F.col("id").alias("vertex")), "vertex", "left_anti")
    return done.unionByName(lone.select(*done.columns))


# -- paths ------------------------------------------------------------------------


def unpacked(h: Hierarchy, edges: DataFrame) -> DataFrame:
    """(path, place, src, dst, travel_time): the original edges of ``edges`` (path, place array<int>, src, dst, travel_time, via), in order of ``place``.

    A shortcut over a vertex is that vertex's edge from before and its edge to behind it; each round takes one layer off.
    """
    into = h.down.select("src", F.col("dst").alias("via"), F.col("travel_time").alias("_t"), F.col("via").alias("_v"))
    away = h.up.select(F.col("src").alias("via"), "dst", F.col("travel_time").alias("_t"), F.col("via").alias("_v"))
    rows, out = cut(edges.select("path", "place", "src", "dst", "travel_time", "via")), None
    while True:
        plain = rows.where("via is null").drop("via")
        out = plain if out is None else out.unionByName(plain)
        over = rows.where("via is not null").drop("travel_time")
        if not over.limit(1).count():
            return out
        a = over.join(into, ["src", "via"]).select("path", F.array_append("place", F.lit(0)).alias("place"), "src", F.col("via").alias("dst"), F.col("_t").alias("travel_time"), F.col("_v").alias("via"))
        b = over.join(away, ["dst", "via"]).select("path", F.array_append("place", F.lit(1)).alias("place"), F.col("via").alias("src"), "dst", F.col("_t").alias("travel_time"), F.col("_v").alias("via"))
        rows = cut(a.unionByName(b))


def shortest_paths(h: Hierarchy, pairs: DataFrame) -> DataFrame:
    """(path, step, src, dst, travel_time): the original edges of a shortest path for each of ``pairs`` (path, src, dst), steps from 0.

    The two searches are followed back from the hub where they meet: each turn takes the edge by which a vertex was reached.
    """
    out, into = labels_from(h, pairs.select(F.col("src").alias("id"))), labels_to(h, pairs.select(F.col("dst").alias("id")))
    a = out.select(F.col("vertex").alias("src"), "hub", F.col("distance").alias("_a"))
    b = into.select(F.col("vertex").alias("dst"), "hub", F.col("distance").alias("_b"))
    met = pairs.where("src <> dst").join(a, "src").join(b, ["dst", "hub"]).groupBy("path", "src", "dst").agg(F.min(F.struct((F.col("_a") + F.col("_b")).alias("d"), "hub", "_a", "_b")).alias("m")).select("path", "src", "dst", "m.*")
    met = cut(met)
    found = None
    for forward in (True, False):
        label, end, rest = (out, "src", "_a") if forward else (into, "dst", "_b")
        step = (h.up if forward else transpose(h.down)).select(F.col("src").alias("_from"), F.col("dst").alias("at"), F.col("travel_time").alias("_t"), "via")
        at = met.select("path", F.col(end).alias("_end"), F.col("hub").alias("at"), F.col(rest).alias("left"))
        k = 0
        while True:
            at = at.where("left > 0 or at <> _end")
            back = at.join(step, "at").join(label.select(F.col("vertex").alias("_end"), F.col("hub").alias("_from"), F.col("distance").alias("_d")), ["_end", "_from"]).where("_d + _t = left")
            one = cut(back.groupBy("path", "_end", "at", "left").agg(F.min(F.struct("_from", "_t", "via", "_d")).alias("m")).select("path", "_end", "at", "m.*"))
            if not one.limit(1).count():
                break
            k += 1
            ends = (F.col("_from").alias("src"), F.col("at").alias("dst")) if forward else (F.col("at").alias("src"), F.col("_from").alias("dst"))
            part = one.select("path", F.array(F.lit(-k if forward else k)).alias("place"), *ends, F.col("_t").alias("travel_time"), "via")
            found = part if found is None else found.unionByName(part)
            at = one.select("path", "_end", F.col("_from").alias("at"), F.col("_d").alias("left"))
    if found is None:
        return pairs.select("path", F.lit(0).alias("step"), "src", "dst", F.lit(0).cast("long").alias("travel_time")).limit(0)
    rows = unpacked(h, found)
    return rows.select("path", (F.row_number().over(Window.partitionBy("path").orderBy("place")) - 1).alias("step"), "src", "dst", "travel_time")
