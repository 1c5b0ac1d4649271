"""Column functions: times, dates, text, geometry."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Radius of the Earth in centimetres, overheads of transfer modes in seconds, vehicle names by type.
EARTH_CM = 637_813_700.0
MODES = ("walking", "scooter", "bicycle")
MODE_OVERHEAD = {"walking": 0, "scooter": 300, "bicycle": 300}
VEHICLES = ("Tram", "Subway", "Rail", "Bus", "Ferry", "Cable car", "Gondola", "Funicular")


def parse_seconds(text: Column) -> Column:
    """Seconds of H+:MM:SS, read as digits of base 60; empty text is 0, hours may pass 24."""
    parts = F.filter(F.split(F.trim(text), ":"), lambda p: p != "")
    return F.aggregate(parts, F.lit(0), lambda total, p: total * 60 + p.cast("int"))


def format_seconds(seconds: Column) -> Column:
    """H+:MM:SS, with a sign for negative times."""
    s = F.abs(seconds)
    pad = lambda x: F.lpad(x.cast("string"), 2, "0")
    hours = F.floor(s / 3600)
    text = F.concat(F.when(hours < 10, pad(hours)).otherwise(hours.cast("string")), F.lit(":"), pad(F.floor(s / 60) % 60), F.lit(":"), pad(s % 60))
    return F.when(seconds < 0, F.concat(F.lit("-"), text)).otherwise(text)


def parse_day(text: Column) -> Column:
    """Days since the epoch of YYYYMMDD; null for other texts."""
    return F.unix_date(F.to_date(F.when(text.rlike(r"^\d{8}$"), text), "yyyyMMdd"))


def format_day(day: Column) -> Column:
    return F.date_format(F.date_from_unix_date(day), "yyyyMMdd")


def weekday(day: Column) -> Column:
    """0 for Sunday."""
    return F.dayofweek(F.date_from_unix_date(day)) - 1


def is_color(text: Column) -> Column:
    return F.coalesce(text.rlike("^[0-9A-Fa-f]{6}$"), F.lit(False))


def to_bool(text: Column) -> Column:
    return F.coalesce(F.lower(F.trim(text)).isin("1", "true"), F.lit(False))


def geo_distance_cm(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Great-circle distance by the spherical law of cosines, 0 for equal points."""
    a, b, d = F.radians(lat1), F.radians(lat2), F.radians(lon1 - lon2)
    inner = F.sin(a) * F.sin(b) + F.cos(a) * F.cos(b) * F.cos(d)
    return F.when((lat1 == lat2) & (lon1 == lon2), 0.0).otherwise(F.acos(F.least(F.lit(1.0), F.greatest(F.lit(-1.0), inner))) * EARTH_CM)


def euclidean(x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
    return F.sqrt((x1 - x2) * (x1 - x2) + (y1 - y2) * (y1 - y2))


def dot(x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
    return x1 * x2 + y1 * y2


def cross(x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
    return x1 * y2 - y1 * x2


def point_to_line(px: Column, py: Column, x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
    """Distance of a point from the line through two others; from the point where these are one."""
    length = euclidean(x1, y1, x2, y2)
    return F.when(length == 0, euclidean(px, py, x1, y1)).otherwise(F.abs(cross(x2 - x1, y2 - y1, px - x1, py - y1)) / length)


def approximate_geo_cm(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Equirectangular distance, with longitude corrected by the mean latitude."""
    x = F.radians(lon1 - lon2) * F.cos(F.radians((lat1 + lat2) / 2))
    y = F.radians(lat1 - lat2)
    return F.sqrt(x * x + y * y) * EARTH_CM


def travel_time(cm: Column, kmh: Column | float) -> Column:
    """Whole seconds that a distance takes at a speed."""
    speed = kmh if isinstance(kmh, Column) else F.lit(float(kmh))
    return (cm / speed * 0.036).cast("long")


def transfer_bucket(seconds: Column) -> Column:
    """0 for none, then up to 10, 20, 40 minutes, then the rest."""
    return F.when(seconds <= 0, 0).when(seconds <= 600, 1).when(seconds <= 1200, 2).when(seconds <= 2400, 3).otherwise(4).cast("long")


def mode_id(name: Column) -> Column:
    """Place of a transfer mode's name; null for others."""
    at = F.array_position(F.array(*map(F.lit, MODES)), F.lower(name))
    return F.when(at > 0, at - 1)


def vehicle_name(kind: Column) -> Column:
    return F.coalesce(F.get(F.array(*map(F.lit, VEHICLES)), kind.cast("int")), F.lit("Undefined"))


#: Fixed values: (min longitude, min latitude, max longitude, max latitude) of boxes with a name.
BOXES = {
    "germany": (5.730, 47.160, 15.130, 55.070),
    "deutschland": (5.730, 47.160, 15.130, 55.070),
    "switzerland": (5.826, 45.487, 10.819, 48.142),
    "bern": (7.307, 46.868, 7.563, 47.085),
    "london": (-0.612, 51.233, 0.715, 51.707),
}

Box = tuple[Column, Column, Column, Column]


def in_box(x: Column, y: Column, box: tuple[float, float, float, float]) -> Column:
    """Inside (min x, min y, max x, max y), edges included."""
    return x.between(box[0], box[2]) & y.between(box[1], box[3])


def boxes_intersect(a: tuple[Column, Column, Column, Column], b: tuple[Column, Column, Column, Column]) -> Column:
    return (a[0] <= b[2]) & (b[0] <= a[2]) & (a[1] <= b[3]) & (b[1] <= a[3])


def box_union(a: Box, b: Box) -> Box:
    """The least box around both."""
    return F.least(a[0], b[0]), F.least(a[1], b[1]), F.greatest(a[2], b[2]), F.greatest(a[3], b[3])


def box_intersection(a: Box, b: Box) -> Box:
    """What both cover; all null where they don't meet."""
    both = F.greatest(a[0], b[0]), F.greatest(a[1], b[1]), F.least(a[2], b[2]), F.least(a[3], b[3])
    return tuple(F.when(boxes_intersect(a, b), c) for c in both)


def box_around(box: Box, x: Column, y: Column) -> Box:
    """The box, extended to hold a point."""
    return box_union(box, (x, y, x, y))


def format_milliseconds(ms: Column) -> Column:
    """Minutes, seconds and milliseconds, without leading parts that are zero."""
    m, s, rest = F.floor(ms / 60_000), F.floor(ms / 1000) % 60, ms % 1000
    text = lambda x, unit: F.concat(x.cast("string"), F.lit(unit))
    parts = F.array(F.when(m > 0, text(m, "m")), F.when((m > 0) | (s > 0), text(s, "s")), text(rest, "ms"))
    return F.concat_ws(" ", F.filter(parts, lambda x: x.isNotNull()))


def percent(share: Column, digits: int = 2) -> Column:
    return F.concat(F.format_number(share * 100, digits), F.lit("%"))
