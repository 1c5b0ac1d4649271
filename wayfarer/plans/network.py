"""Timetable networks as DataFrames, and the one that the driver's tables stand for.

A network is three tables:

* ``stops(stop_id, name, min_transfer_time)``
* ``events(trip, idx, stop, arr, dep, n)``: one row per halt of a trip, ``n`` halts in all
* ``edges(src, dst, travel_time)``: directed transfers

Times are seconds from the first service day and may pass 86400.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..storage import keep_by, spread

#: Integer arithmetic only: the same text runs in Spark and in the oracle.
STOPS_SQL = "SELECT CAST(s_suppkey AS BIGINT) AS stop_id, s_name AS name, CAST((s_suppkey * 37) % 4 * 60 AS BIGINT) AS min_transfer_time FROM {supplier}"
EVENTS_SQL = """
SELECT CAST(trip AS BIGINT) AS trip, CAST(idx AS BIGINT) AS idx, CAST(stop AS BIGINT) AS stop, CAST(arr AS BIGINT) AS arr, CAST(arr + 30 AS BIGINT) AS dep, CAST(n AS BIGINT) AS n
FROM (
  SELECT trip, stop, row_number() OVER (PARTITION BY trip ORDER BY rn) - 1 AS idx, count(*) OVER (PARTITION BY trip) AS n,
    (trip * 7919) % 72000 + sum(150 + (pk * 13) % 600) OVER (PARTITION BY trip ORDER BY rn) AS arr
  FROM (
    SELECT trip, stop, pk, rn, lag(stop) OVER (PARTITION BY trip ORDER BY rn) AS ps
    FROM (
      SELECT l_orderkey AS trip, l_suppkey AS stop, l_partkey AS pk,
        row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_discount, l_tax, l_shipdate) AS rn
      FROM {lineitem}) r) f
  WHERE ps IS NULL OR ps <> stop) h
WHERE n >= 2"""
#: In Spark a trip gets its name behind the first window, so that all windows over trips share one exchange.
SPARK_EVENTS_SQL = EVENTS_SQL.replace("SELECT l_orderkey AS trip, l_suppkey", "SELECT l_orderkey, l_suppkey").replace("FROM {lineitem}) r)", "FROM {lineitem}) r0)").replace("lag(stop) OVER (PARTITION BY trip ORDER BY rn) AS ps\n    FROM (", "lag(stop) OVER (PARTITION BY trip ORDER BY rn) AS ps\n    FROM (SELECT l_orderkey AS trip, stop, pk, rn FROM (").replace(") r0)", ") r0) r)")
EDGES_SQL = """
SELECT CAST(a.s_suppkey AS BIGINT) AS src, CAST(b.s_suppkey AS BIGINT) AS dst, CAST(60 + abs((a.s_suppkey * 37) % 900 - (b.s_suppkey * 37) % 900) AS BIGINT) AS travel_time
FROM {supplier} a JOIN {supplier} b ON a.s_suppkey - a.s_suppkey % 4 = b.s_suppkey - b.s_suppkey % 4 AND a.s_suppkey <> b.s_suppkey"""

#: Lines of eight stops in a row, every other one backwards, each sharing two with the next: (line, idx, stop, n, since), seconds since the start.
LINE_STOPS_SQL = """
SELECT line, idx, stop, n, CAST(sum(CASE WHEN idx = 0 THEN 0 ELSE 110 + (stop * 13) % 200 END) OVER (PARTITION BY line ORDER BY idx) AS BIGINT) AS since
FROM (
  SELECT line, stop, row_number() OVER (PARTITION BY line ORDER BY CASE WHEN line % 2 = 0 THEN stop ELSE -stop END) - 1 AS idx, count(*) OVER (PARTITION BY line) AS n
  FROM (
    SELECT CAST(floor(s_suppkey / 6) AS BIGINT) AS line, CAST(s_suppkey AS BIGINT) AS stop FROM {supplier}
    UNION ALL SELECT CAST(floor(s_suppkey / 6) AS BIGINT) - 1, CAST(s_suppkey AS BIGINT) FROM {supplier} WHERE s_suppkey % 6 < 2 AND s_suppkey >= 6) a) b
WHERE n >= 2"""
#: A trip per row of ``trips`` (key); trips of a line take the same time.
LINE_EVENTS_SQL = """
SELECT CAST(key AS BIGINT) AS trip, CAST(idx AS BIGINT) AS idx, stop, (key * 7919) % 72000 + since AS arr, (key * 7919) % 72000 + since + CASE WHEN idx < n - 1 THEN 20 ELSE 0 END AS dep, CAST(n AS BIGINT) AS n, line
FROM (SELECT key, key % m AS of_line FROM {trips} CROSS JOIN (SELECT max(line) + 1 AS m FROM {line_stops}) c) k JOIN {line_stops} ON line = of_line"""
#: Table and key of the trips: a dense timetable and one of a tenth of its trips.
LINE_TRIPS = {"orders": "o_orderkey", "customer": "c_custkey"}


@dataclass(frozen=True)
class Network:
    stops: DataFrame
    events: DataFrame
    edges: DataFrame

    def replace(self, **tables: DataFrame) -> Network:
        return replace(self, **tables)

    def boardable(self) -> DataFrame:
        """Events that a trip can be boarded at, with the latest time of being there: (trip, idx, stop, ready)."""
        wait = self.stops.select(F.col("stop_id").alias("stop"), "min_transfer_time")
        usable = self.events.where(F.col("idx") < F.col("n") - 1)
        return usable.join(wait, "stop").select("trip", "idx", "stop", (F.col("dep") - F.col("min_transfer_time")).alias("ready"))

    def rides(self) -> DataFrame:
        """``boardable`` with ``later``, the trip's later halts (to, arr), kept in buckets of stops: a search's round shuffles no events."""
        after = Window.partitionBy("trip").orderBy("idx").rowsBetween(1, Window.unboundedFollowing)
        later = F.collect_list(F.struct(F.col("stop").alias("to"), "arr")).over(after)
        wait = self.stops.select(F.col("stop_id").alias("stop"), "min_transfer_time")
        rows = self.events.withColumn("later", later).where("idx < n - 1").join(wait, "stop")
        return keep_by(rows.select("trip", "idx", "stop", (F.col("dep") - F.col("min_transfer_time")).alias("ready"), "later"), "stop", "rides")


def derived(spark: SparkSession, sf_dir: str) -> Network:
    """The network of the driver's tables: a stop per supplier, a trip per order, transfers among four neighbours."""
    supplier, lineitem = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("supplier", "lineitem"))
    return Network(
        spark.sql(STOPS_SQL, supplier=supplier),
        spark.sql(SPARK_EVENTS_SQL, lineitem=spread(lineitem, "l_orderkey")),
        spark.sql(EDGES_SQL, supplier=supplier),
    )


def derived_lines(spark: SparkSession, sf_dir: str, trips: str = "orders") -> tuple[Network, DataFrame]:
    """A network of few lines with many trips each over the same stops and transfers, and its lines (trip, line)."""
    supplier, rows = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("supplier", trips))
    line_stops = spark.sql(LINE_STOPS_SQL, supplier=supplier)
    events = spark.sql(LINE_EVENTS_SQL, trips=rows.select(F.col(LINE_TRIPS[trips]).cast("long").alias("key")), line_stops=line_stops)
    net = Network(spark.sql(STOPS_SQL, supplier=supplier), events.drop("line"), spark.sql(EDGES_SQL, supplier=supplier))
    return net, events.where("idx = 0").select("trip", "line")


def line_ctes(trips: str = "orders") -> str:
    """The tables of ``derived_lines`` as CTEs over the oracle's views: stops, ev (with line) and edges."""
    rows = f"(SELECT CAST({LINE_TRIPS[trips]} AS BIGINT) AS key FROM {trips}) t"
    return f"stops AS ({STOPS_SQL.format(supplier='supplier')}), line_stops AS MATERIALIZED ({LINE_STOPS_SQL.format(supplier='supplier')}), ev AS MATERIALIZED ({LINE_EVENTS_SQL.format(trips=rows, line_stops='line_stops')}), edges AS MATERIALIZED ({EDGES_SQL.format(supplier='supplier')})"


def network_ctes() -> str:
    """The same three tables as CTEs over the oracle's views."""
    names = {"supplier": "supplier", "lineitem": "lineitem"}
    return f"stops AS ({STOPS_SQL.format(**names)}), ev AS MATERIALIZED ({EVENTS_SQL.format(**names)}), edges AS MATERIALIZED ({EDGES_SQL.format(**names)})"
