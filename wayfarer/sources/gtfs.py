"""Timetable feeds: nine CSV files, read by Spark's CSV source and filtered row by row."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import is_color, parse_day, parse_seconds

WEEKDAYS = ("sunday", "monday", "tuesday", "wednesday", "thursday", "friday", "saturday")
#: The columns of each file.
COLUMNS = {
    "agency": ("agency_id", "agency_name", "agency_timezone"),
    "calendar": ("service_id", *WEEKDAYS, "start_date", "end_date"),
    "calendar_dates": ("service_id", "date", "exception_type"),
    "frequencies": ("trip_id", "start_time", "end_time", "headway_secs"),
    "routes": ("route_id", "agency_id", "route_short_name", "route_long_name", "route_type", "route_color", "route_text_color"),
    "stops": ("stop_id", "stop_name", "stop_lat", "stop_lon"),
    "stop_times": ("trip_id", "arrival_time", "departure_time", "stop_id", "stop_sequence"),
    "transfers": ("from_stop_id", "to_stop_id", "min_transfer_time", "transfer_type"),
    "trips": ("route_id", "service_id", "trip_id", "trip_short_name"),
}


def _raw(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """The file's known columns as text, blank where a row or the whole column lacks them; a missing file has no rows."""
    reader = spark.read.option("header", True).option("quote", '"').option("escape", '"').option("ignoreLeadingWhiteSpace", True).option("ignoreTrailingWhiteSpace", True)
    try:
        table = reader.csv(f"{folder}/{name}.txt")
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], ", ".join(f"{c} string" for c in COLUMNS[name]))
    return table.select(*(F.coalesce(F.trim(F.col(c)), F.lit("")).alias(c) if c in table.columns else F.lit("").alias(c) for c in COLUMNS[name]))


def _first(rows: DataFrame, key: str) -> DataFrame:
    """One row of each id; which of several is told by their texts, as files have no order across partitions."""
    order = Window.partitionBy(key).orderBy(*(c for c in rows.columns if c != key))
    return rows.withColumn("_n", F.row_number().over(order)).where("_n = 1").drop("_n")


def _whole(c: str) -> Column:
    return F.coalesce(F.expr(f"try_cast({c} as int)"), F.lit(0))


def read_feed(spark: SparkSession, folder: str) -> dict[str, DataFrame]:
    """The nine tables, typed, without rows that are not usable."""
    t = {name: _raw(spark, folder, name) for name in COLUMNS}
    named = lambda c: F.when(F.col(c) == "", "NOT_NAMED").otherwise(F.col(c)).alias(c)
    route = F.trim(F.concat(F.when(F.col("route_short_name") != "", F.concat(F.lit("["), "route_short_name", F.lit("] "))).otherwise(""), "route_long_name"))
    color = lambda c, other: F.when(is_color(F.col(c)), F.col(c)).otherwise(other).alias(c)
    return {
        "agency": _first(t["agency"].where("agency_id <> ''").select("agency_id", named("agency_name"), "agency_timezone"), "agency_id"),
        "calendar": t["calendar"].select("service_id", *(F.col(d).isin("1", "true").alias(d) for d in WEEKDAYS), parse_day(F.col("start_date")).alias("start_day"), parse_day(F.col("end_date")).alias("end_day")).where("service_id <> '' and start_day <= end_day"),
        "calendar_dates": t["calendar_dates"].where("service_id <> ''").select("service_id", parse_day(F.col("date")).alias("day"), (F.col("exception_type") == "1").alias("added")),
        "frequencies": t["frequencies"].select("trip_id", parse_seconds(F.col("start_time")).alias("start"), parse_seconds(F.col("end_time")).alias("end"), _whole("headway_secs").alias("headway")).where("trip_id <> '' and start <= end and headway > 0"),
        "routes": _first(t["routes"].where("route_id <> ''").select("route_id", "agency_id", route.alias("name"), _whole("route_type").alias("type"), color("route_color", "FFFFFF"), color("route_text_color", "000000")), "route_id"),
        "stops": _first(t["stops"].where("stop_id <> ''").select("stop_id", named("stop_name"), F.expr("try_cast(stop_lat as double)").alias("lat"), F.expr("try_cast(stop_lon as double)").alias("lon")), "stop_id"),
        "stop_times": t["stop_times"].select("trip_id", "stop_id", _whole("stop_sequence").alias("seq"), parse_seconds(F.col("arrival_time")).cast("long").alias("arr"), parse_seconds(F.col("departure_time")).cast("long").alias("dep")).where("trip_id <> '' and stop_id <> '' and arr <= dep"),
        "transfers": t["transfers"].where("from_stop_id <> '' and to_stop_id <> '' and transfer_type <> '3'").select("from_stop_id", "to_stop_id", _whole("min_transfer_time").cast("long").alias("travel_time")).where("travel_time >= 0"),
        "trips": _first(t["trips"].where("route_id <> '' and trip_id <> ''").select("trip_id", "route_id", "service_id", named("trip_short_name")), "trip_id"),
    }
