"""What operators shuffle and hold at larger sizes, seen in their plans."""

from __future__ import annotations

from pyspark.sql import functions as F

from wayfarer import storage
from wayfarer.operators import statistics as A
from wayfarer.operators import transforms as X
from wayfarer.operators import triptransfers as T
from wayfarer.operators.hierarchy import Hubs
from wayfarer.plans import catalog, catalog_more, shortcuts  # noqa: F401  catalog_more registers more queries
from wayfarer.plans.network import Network, derived

from .test_segments import frames, lines_network, rows


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_reduction_shuffles_no_offers(spark):
    """Transfers meet the others of their trip with their goals' halts beside them: no window sorts an offer for each halt and walk; equal transfers stay."""
    net, lines = frames(spark, lines_network(5))
    found = T.line_transfers(net, lines).select("from_trip", "from_idx", "to_trip", "to_idx", "travel_time")
    kept = T.reduce_transfers(found, net)
    assert "Window" not in plan(T.reduce_transfers(spark.createDataFrame(found.collect(), found.schema), net))
    assert 0 < kept.count() < found.count()
    twice = T.reduce_transfers(found.unionByName(found), net)
    assert rows(twice) == sorted([*rows(kept), *rows(kept)])
    # a halt at a stop that nobody knows leads nowhere, and hides no other halt
    unknown = net.replace(stops=net.stops.where("stop_id % 2 = 0"), edges=net.edges.where(F.col("src") % 2 == 0))
    assert T.reduce_transfers(found, unknown).count() > 0


def test_tasks_grow_with_the_table(spark, sf_dir, monkeypatch):
    """Windows over trips and edges run in as many tasks as the rows ask for, on the same exchange; small tables stay as they are."""
    few = derived(spark, sf_dir)
    assert few.events.rdd.getNumPartitions() <= 6
    graph = lambda net: rows(A.average_time_graph(net, 28_800, 29_100).withColumn("average_time", F.round("average_time", 6)))
    back = lambda net: X.events_from_connections(X.connections(net.events))
    want, want_graph = rows(back(few)), graph(few)
    monkeypatch.setattr(storage, "ROWS_OF_TASK", 500)
    many = derived(spark, sf_dir)
    assert many.events.rdd.getNumPartitions() == spark.read.parquet(f"{sf_dir}/lineitem.parquet").count() // 500 + 1
    assert plan(derived(spark, sf_dir).events).count("Exchange hashpartitioning") == 1
    assert back(many).rdd.getNumPartitions() >= many.events.rdd.getNumPartitions()
    assert rows(back(many)) == want
    assert graph(many) == want_graph


def test_pairs_are_counted_in_as_many_tasks_as_they_need(spark, sf_dir, monkeypatch):
    """What can meet, not a fixed number of partitions, says in how many tasks pairs of connections are found and counted."""
    few = rows(catalog.QUERIES["combinable_connections"](spark, sf_dir))
    monkeypatch.setattr(storage, "ROWS_OF_TASK", 500)
    many = catalog.QUERIES["combinable_connections"](spark, sf_dir)
    assert many.rdd.getNumPartitions() > 6
    assert rows(many) == few


def test_augmented_and_reduced_where_transfers_are(spark, monkeypatch):
    """Transfers of later trips, and those that lead somewhere sooner, are found in the groups of trips, which share no exchange with what follows; in small groups as in large ones."""
    net, lines = frames(spark, lines_network(5))
    found = T.line_transfers(net, lines)
    edge = ["from_trip", "from_idx", "to_trip", "to_idx", "travel_time"]
    trips = T.numbered(net.events, lines).select(F.col("line").alias("from_line"), F.col("no").alias("from_no"), F.col("trip").alias("from_trip"))
    want = {n: rows(T.augmented(found, n).join(trips, ["from_line", "from_no"]).select(*edge)) for n in (1, 3)}
    unknown = net.replace(stops=net.stops.where("stop_id % 2 = 0"), edges=net.edges.where(F.col("src") % 2 == 0))
    sooner = [(n, rows(T.reduce_transfers(T.line_transfers(n, lines).select(*edge), n))) for n in (net, unknown)]
    monkeypatch.setattr(T, "TRIPS_EACH", 2)
    monkeypatch.setattr(T, "TRIPS_REDUCED", 1)
    for n, all_rows in want.items():
        got = T.line_transfers(net, lines, bucket=2000, later_trips=n)
        assert rows(got.select(*edge)) == all_rows
        assert "Exchange" not in plan(got).split("FlatMapGroupsInArrow")[0]
    for n, all_rows in sooner:
        got = T.line_transfers(n, lines, bucket=2000, sooner=True)
        assert rows(got.select(*edge)) == all_rows
        assert "Exchange" not in plan(got).split("FlatMapGroupsInArrow")[0]


def test_shortcuts_need_no_search_from_every_departure(spark, monkeypatch):
    """Shortcuts are the transfers over walks of any length that lead somewhere sooner; no run for each stop and time is made for them, and walks between stops are theirs."""
    net, lines = frames(spark, lines_network(5))
    here = net.stops.select(F.col("stop_id").alias("vertex"), F.col("stop_id").alias("hub"), F.lit(0).cast("long").alias("distance"))
    walks = Hubs(here.unionByName(net.edges.select(F.col("src").alias("vertex"), F.col("dst").alias("hub"), F.col("travel_time").alias("distance"))), here)
    monkeypatch.setattr(Network, "rides", None)
    found = shortcuts.event_shortcuts(net, walks, lines)
    edge = ["from_trip", "from_idx", "to_trip", "to_idx", "travel_time"]
    assert rows(found.select(*edge)) == rows(T.reduce_transfers(T.line_transfers(net, lines).select(*edge), net))
    between = rows(shortcuts.stop_shortcuts(net, walks, lines))
    assert between and set(between) <= set(rows(net.edges))
