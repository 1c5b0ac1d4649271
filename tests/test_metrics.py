"""Measures of journeys and numbers as text."""

from __future__ import annotations

from pyspark.sql import functions as F

from wayfarer import functions as S
from wayfarer.plans import journeys as J

from .test_segments import frames, lines_network


def test_journey_metrics_add_up(spark):
    """A journey has as many rides as trips; its transfer time is that of the legs by foot."""
    net, _ = frames(spark, lines_network(18))
    batch = J.hashed_queries(net.stops, 4, 0, 4000)
    found = J.labels(net, batch)
    legs = J.legs(net, found, found.select("query_id", "stop", "trips"))
    table = {}
    for r in legs.collect():
        table.setdefault((r["query_id"], r["stop"], r["trips"]), []).append(r)
    got = {(r["query_id"], r["stop"], r["trips"]): r for r in J.journey_metrics(legs).collect()}
    assert set(got) == set(table)
    assert any(r["transfer_time"] for r in got.values())
    for key, parts in table.items():
        walks = {r["leg"]: r["arr"] - r["dep"] for r in parts if r["kind"] == "transfer"}
        first = max(r["leg"] for r in parts)
        assert got[key]["rides"] == key[2] == sum(r["kind"] == "trip" for r in parts)
        assert got[key]["transfer_time"] == sum(walks.values())
        assert got[key]["initial_transfer_time"] == walks.get(first, 0)
        assert got[key]["intermediate_transfer_time"] == sum(t for leg, t in walks.items() if 0 < leg < first)


def test_numbers_as_text(spark):
    rows = spark.createDataFrame([(0, 0.0), (1234, 0.125), (61_005, 1.0)], "ms long, share double")
    got = [tuple(r) for r in rows.select(S.format_milliseconds(F.col("ms")).alias("t"), S.percent(F.col("share")).alias("p")).collect()]
    assert got == [("0ms", "0.00%"), ("1s 234ms", "12.50%"), ("1m 1s 5ms", "100.00%")]
