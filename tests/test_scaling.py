"""What keeps exchanges small: columns kept beside transfers, and least values found where rows already are."""

from __future__ import annotations

from pyspark.sql import functions as F

from wayfarer.operators import delays as D
from wayfarer.operators import graph as G
from wayfarer.operators import statistics as A
from wayfarer.operators import triptransfers as T

from .test_segments import frames, lines_network, rows

_EDGE = ["from_trip", "from_idx", "to_trip", "to_idx", "travel_time"]


def test_kept_times_of_transfers(spark):
    """Times kept beside transfers give the same slacks and late transfers as times looked up, bounded waits or not."""
    net, lines = frames(spark, lines_network(4))
    late = D.late_network(net, D.scenario(net.events), most_arrival=600, most_departure=900)
    for wait in (None, 600):
        plain = T.event_transfers(net, lines, wait)
        kept = T.event_transfers(D.beside(net, late), lines, wait, ["arr", "late_arr"], ["dep", "late_dep"])
        assert rows(kept.select(*_EDGE)) == rows(plain) and plain.columns == _EDGE
        assert rows(A.transfer_slacks(T.feasible(kept, net), net)) == rows(A.transfer_slacks(T.feasible(plain, net), net))
        assert rows(D.holding_transfers(kept, net, late)) == rows(D.holding_transfers(plain, net, late))


def test_first_trips_need_no_further_exchange(spark):
    """Once halts and departures have met in their slots, transfers aren't shuffled again."""
    net, lines = frames(spark, lines_network(4))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = T.event_transfers(net, lines, 600)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert "SortMergeJoin" in plan and "Exchange" not in plan.split("SortMergeJoin")[0]


def test_range_of_many_points_at_few_places(spark):
    """Points that share a place are compared once; every pair of them is found, and exact distances agree with those of all pairs."""
    places = [(47.0 + k * 0.004, 8.0) for k in range(5)]
    points = [(i, *places[i % 5]) for i in range(200)]
    table = spark.createDataFrame(points, "id long, lat double, lon double")
    found = G.within_range(table, table, 100_000).groupBy((F.col("id") % 5).alias("a"), (F.col("other") % 5).alias("b")).agg(F.count("*"), F.count_distinct("distance"))
    near = [(a, b, 1600, 1) for a in range(5) for b in range(5) if abs(a - b) * 44_478 <= 100_000]
    assert rows(found) == sorted(near)
    plan = G.within_range(table, table, 100_000)._jdf.queryExecution().executedPlan().toString()
    assert "ACOS" not in plan.upper()  # no distance is left to be computed for pairs of points
