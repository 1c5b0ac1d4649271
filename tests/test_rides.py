"""Searches whose rounds shuffle labels only: what a round reads stands in buckets, and an event is boarded once."""

from __future__ import annotations

from pyspark.sql import functions as F

from wayfarer.plans import journeys as J
from wayfarer.plans import multicriteria as M
from wayfarer.plans.network import derived

from .test_segments import frames, lines_network, rows


def exchanges(df):
    return df._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning")


def test_rounds_do_not_shuffle_events(spark, sf_dir):
    """Rides meet labels in the buckets they were written in; events of trips take one exchange of the rows they come from."""
    net = derived(spark, sf_dir)
    rides = net.rides()
    labels = net.stops.select(F.col("stop_id").alias("stop"), F.lit(0).cast("long").alias("arrival"))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        assert exchanges(labels.join(rides, "stop").where("ready >= arrival")) == 1
        assert exchanges(net.events) == 1
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    later = rides.select("trip", "idx", F.posexplode("later").alias("k", "h")).select("trip", (F.col("idx") + F.col("k") + 1).alias("at"), "h.to", "h.arr").distinct()
    assert rows(later) == rows(net.events.where("idx > 0").select("trip", F.col("idx").alias("at"), F.col("stop").alias("to"), "arr"))


def test_labels_board_what_none_before_boards(spark):
    """Each fresh label boards until a cheaper one arrives; old ones and dearer ones bound nothing else."""
    two = spark.createDataFrame([(1, 5, 10, 9, False), (1, 5, 20, 7, True), (1, 5, 30, 4, False), (1, 5, 40, 2, True)], "query_id long, stop long, arrival long, w long, fresh boolean")
    assert rows(M._boarding(two, ["query_id", "stop"], ["arrival", "w"]).select("arrival", "until")) == [(20, 30), (40, None)]
    three = spark.createDataFrame([(1, 5, 10, 1, 9, True), (1, 5, 20, 0, 9, False), (1, 5, 30, 1, 8, True), (1, 5, 40, 0, 7, True)], "query_id long, stop long, arrival long, a long, b long, fresh boolean")
    assert rows(M._boarding(three, ["query_id", "stop"], ["arrival", "a", "b"]).select("arrival", "until")) == [(10, 20), (30, 40), (40, None)]


def test_named_labels_have_the_same_arrivals(spark):
    net, _ = frames(spark, lines_network(3))
    batch = J.hashed_queries(net.stops, 5)
    columns = ["query_id", "stop", "trips", "arrival"]
    named = J.labels(net, batch)
    assert rows(named.select(*columns)) == rows(J.labels(net, batch, named=False).select(*columns))
    # where its trip was boarded, a label with fewer trips was in time
    rides = named.where("trip is not null").select("query_id", "trips", "trip", F.col("board_stop").alias("stop"), F.col("board_idx").alias("idx"))
    ready = rides.join(net.rides().select("trip", "idx", "ready"), ["trip", "idx"])
    fits = ready.join(named.select("query_id", "stop", F.col("trips").alias("k"), "arrival"), ["query_id", "stop"]).where("k < trips and arrival <= ready")
    assert fits.select("query_id", "trips", "trip", "stop").distinct().count() == rides.distinct().select("query_id", "trips", "trip", "stop").distinct().count()


def test_front_of_three_criteria(spark):
    """Rows of a key are compared with its front only; the front is that of all pairs, equal rows of the bag standing first."""
    from itertools import product

    from wayfarer.operators.skyline import merged_front

    bag = [(k, *v) for k in (1, 2) for v in [(2, 2, 2), (0, 3, 3), (3, 0, 3)]]
    offers = [(k, (a * 7 + k) % 5, (b * 3 + a) % 5, (c * 2 + b + k) % 5) for k in (1, 2, 3) for a, b, c in product(range(4), repeat=3)]
    table = lambda x: spark.createDataFrame(x, "key long, a long, b long, c long")
    found = merged_front(table(bag), table(offers), ["key"], ["a", "b", "c"])
    everything = set(bag) | set(offers)
    best = {r for r in everything if not any(o != r and o[0] == r[0] and all(x <= y for x, y in zip(o[1:], r[1:])) for o in everything)}
    assert rows(found) == sorted((*r, r not in bag) for r in best)
    assert "Join" not in found._jdf.queryExecution().executedPlan().toString()
