"""Road attributes as column expressions: integers as the importers give them, NULL where there is no value."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Road categories in rank order with default speed limit (km/h), lanes per direction, capacity per lane
# (vehicles/h) and direction; categories without defaults aren't open to cars.
CATEGORIES = (
    "motorway", "motorway_link", "trunk", "trunk_link", "primary", "primary_link", "secondary", "secondary_link",
    "tertiary", "tertiary_link", "unclassified", "residential", "living_street", "service", "pedestrian", "track",
    "footway", "bridleway", "steps", "path", "cycleway", "road",
)
DEFAULTS = {
    0: (120, 2, 2000, "forward"), 1: (80, 1, 1500, "forward"), 2: (80, 1, 2000, "both"), 3: (50, 1, 1500, "both"),
    4: (80, 1, 1500, "both"), 5: (60, 1, 1500, "both"), 6: (30, 1, 800, "both"), 7: (30, 1, 800, "both"),
    8: (25, 1, 600, "both"), 9: (25, 1, 600, "both"), 10: (15, 1, 600, "both"), 11: (15, 1, 600, "both"),
    12: (10, 1, 300, "both"), 13: (10, 1, 300, "both"),
}
MPH = 1.609344
EARTH = 6_371_000


def default(category: Column, what: int) -> Column:
    """Default of a category: what = 0 speed limit, 1 lanes, 2 capacity per lane, 3 direction."""
    return F.create_map(*[F.lit(x) for k, v in DEFAULTS.items() for x in (k, v[what])])[category]


def travel_time(length: Column, speed: Column) -> Column:
    """Deciseconds for metres at km/h, rounded half up; NULL at speed 0."""
    return F.when(speed > 0, F.floor((72 * length + speed) / (2 * speed)).cast("long"))


def free_flow_speed(limit: Column, given: Column, category: Column, length: Column) -> Column:
    slow = F.when(limit < 51, limit * 0.5).otherwise(limit)
    short = category.between(2, 9) & (length < 300)
    free = F.when(short, (limit - 10) * length / 300.0 + 10).otherwise(limit)
    return F.floor(F.when(given, slow).otherwise(free) + 0.5).cast("long")


def speed_limit(tag: Column, category: Column) -> Column:
    """Speed limit in km/h of a maxspeed tag; 0, no or unreadable tags give the category's default."""
    number = F.regexp_extract(tag, r"^\s*([0-9]+(?:\.[0-9]+)?)", 1).try_cast("double")
    value = F.when(tag.contains("mph"), number * MPH).otherwise(number)
    return F.coalesce(F.when(value > 0, value), default(category, 0).cast("double"))


def lanes(total: Column, own: Column, two_way: Column, category: Column) -> Column:
    """Lanes of one direction: its own tag, else all lanes (half of them on two-way roads), else the default."""
    split = F.when(two_way, total / 2.0).otherwise(total.cast("double"))
    return F.coalesce(own.cast("double"), split, default(category, 1).cast("double"))


def direction(oneway: Column, junction: Column, category: Column) -> Column:
    return (
        F.when(oneway.isin("no", "false", "0"), "both")
        .when(oneway.isin("yes", "true", "1"), "forward")
        .when(oneway.isin("-1", "reverse"), "reverse")
        .when(junction == "roundabout", "forward")
        .otherwise(default(category, 3))
    )


def capacity(n_lanes: Column, category: Column, length: Column) -> Column:
    per = default(category, 2) * F.when(length < 100, 2).otherwise(1)
    return F.floor(n_lanes * per + 0.5).cast("long")


def open_to_cars(category: Column) -> Column:
    return category <= 13


def open_to_pedestrians(category: Column) -> Column:
    return category.between(8, 20)


def open_to_cyclists(category: Column) -> Column:
    return category.between(6, 20) & (category != 18)


def matsim_travel_time(length: Column, speed: Column) -> Column:
    return F.floor(3.6 * length / speed).cast("long") * 10 + 10


def great_circle(lat1: Column, lng1: Column, lat2: Column, lng2: Column) -> Column:
    """Metres between two points in micro-degrees (haversine)."""
    rad = lambda x: F.radians(x / 1e6)
    a = F.pow(F.sin((rad(lat2) - rad(lat1)) / 2), 2) + F.cos(rad(lat1)) * F.cos(rad(lat2)) * F.pow(F.sin((rad(lng2) - rad(lng1)) / 2), 2)
    return 2 * EARTH * F.atan2(F.sqrt(a), F.sqrt(1 - a))


def clamp_lat(lat: Column) -> Column:
    return F.least(F.greatest(lat, F.lit(-90_000_000)), F.lit(90_000_000))


def wrap_lng(lng: Column) -> Column:
    return F.pmod(lng + 180_000_000, F.lit(360_000_000)) - 180_000_000


def plate_carree(lng: Column, lat: Column) -> tuple[Column, Column]:
    return lng, lat


def web_mercator_y(lat: Column) -> Column:
    """Micro-degrees of the Web Mercator ordinate."""
    return F.degrees(F.log(F.tan(F.radians(lat / 1e6) / 2 + F.lit(0.7853981633974483)))) * 1e6


def pair(text: Column) -> Column:
    """(a, b) of a cell "(a|b)"; an error on anything else."""
    m = lambda i: F.regexp_extract(text, r"^\s*\(\s*(-?[0-9.]+)\s*\|\s*(-?[0-9.]+)\s*\)\s*$", i)
    bad = F.raise_error(F.concat(F.lit("malformed pair: "), text)).cast("double")
    get = lambda i: F.when(m(1) != "", m(i).try_cast("double")).otherwise(bad)
    return F.struct(get(1).alias("a"), get(2).alias("b"))


def seconds_of(clock: Column) -> Column:
    """Seconds of "HH:MM[:SS]"."""
    p = F.split(clock, ":")
    part = lambda i: F.coalesce(F.try_element_at(p, F.lit(i)).try_cast("long"), F.lit(0))
    return part(1) * 3600 + part(2) * 60 + part(3)


def minutes_seconds(seconds: Column) -> Column:
    """MM:SS, rounded to the second first."""
    s = F.round(seconds).cast("long")
    return F.format_string("%02d:%02d", F.floor(s / 60), s % 60)


def hours_minutes(seconds: Column) -> Column:
    s = F.round(seconds).cast("long")
    return F.format_string("%02d:%02d", F.floor(s / 3600), F.floor(s % 3600 / 60))


# Polygons are arrays of (x, y) rows; the last point joins the first one.


def crossings(px: Column, py: Column, x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
    """1 if the edge (x1, y1)-(x2, y2) crosses the ray to the right of p; half-open in y, so that vertices count once."""
    spans = (y1 <= py) != (y2 <= py)
    cross = (x2 - x1) * (py - y1) - (px - x1) * (y2 - y1)
    return (spans & ((y2 > y1) == (cross > 0))).cast("long")


def doubled_area(x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
    """A summand of twice the signed area: the sum over a polygon's edges is positive if it runs counterclockwise."""
    return x1 * y2 - x2 * y1


def orientation(px: Column, py: Column, qx: Column, qy: Column, rx: Column, ry: Column) -> Column:
    return F.signum((qx - px) * (ry - py) - (qy - py) * (rx - px)).cast("int")


def between(v: Column, a: Column, b: Column) -> Column:
    return (F.least(a, b) <= v) & (v <= F.greatest(a, b))


def rectangles_meet(ax1: Column, ay1: Column, ax2: Column, ay2: Column, bx1: Column, by1: Column, bx2: Column, by2: Column) -> Column:
    """Whether rectangles with corners (x1, y1) south-west and (x2, y2) north-east have a point in common."""
    return (ax2 >= bx1) & (ax1 <= bx2) & (ay2 >= by1) & (ay1 <= by2)


def segments_meet(px, py, qx, qy, rx, ry, sx, sy) -> Column:
    """Whether the segments pq and rs have a point in common; collinear ones if their bounding boxes do."""
    o1, o2 = orientation(px, py, qx, qy, rx, ry), orientation(px, py, qx, qy, sx, sy)
    across = (o1 != o2) & (orientation(rx, ry, sx, sy, px, py) != orientation(rx, ry, sx, sy, qx, qy))
    box = lambda a, b: (F.least(a, b), F.greatest(a, b))
    (ax1, ax2), (ay1, ay2), (bx1, bx2), (by1, by2) = box(px, qx), box(py, qy), box(rx, sx), box(ry, sy)
    return across | ((o1 == 0) & (o2 == 0) & rectangles_meet(ax1, ay1, ax2, ay2, bx1, by1, bx2, by2))


def leading_zeros(x: Column) -> Column:
    """Zero bits before the highest one bit of a long; 64 for 0."""
    return (64 - F.when(x == 0, 0).otherwise(F.length(F.bin(x)))).cast("int")


def trailing_zeros(x: Column) -> Column:
    """Zero bits after the lowest one bit of a long; 64 for 0."""
    return F.when(x == 0, 64).otherwise(F.bit_count(x.bitwiseAND(-x) - 1)).cast("int")


def ones_before(x: Column, index: Column) -> Column:
    """One bits below the place ``index``."""
    return F.bit_count(x.bitwiseAND(F.pow(F.lit(2), index).cast("long") - 1))


# Names of days, English and German, long and short.
DAYS = (
    ("Monday", "Mon", "Montag", "Mo"), ("Tuesday", "Tue", "Dienstag", "Di"), ("Wednesday", "Wed", "Mittwoch", "Mi"), ("Thursday", "Thu", "Donnerstag", "Do"),
    ("Friday", "Fri", "Freitag", "Fr"), ("Saturday", "Sat", "Samstag", "Sa"), ("Sunday", "Sun", "Sonntag", "So"),
)


def day_of_week(name: Column) -> Column:
    """1 (Monday) to 7 of a day's name; an error on anything else."""
    table = F.create_map(*[F.lit(x) for i, names in enumerate(DAYS) for n in names for x in (n, i + 1)])
    return F.coalesce(table[name], F.raise_error(F.concat(F.lit("no day of the week: "), name)).cast("int"))


def time_of_day(text: Column) -> Column:
    """Seconds of HH:mm or HH:mm:ss within a day; an error on anything else."""
    m = lambda i: F.regexp_extract(text, r"^([01][0-9]|2[0-3]):([0-5][0-9])(?::([0-5][0-9]))?$", i).try_cast("int")
    bad = F.raise_error(F.concat(F.lit("not in format HH:mm:ss: "), text)).cast("int")
    return F.when(m(1).isNull(), bad).otherwise(m(1) * 3600 + m(2) * 60 + F.coalesce(m(3), F.lit(0)))


def seconds_since_monday(day: Column, time: Column) -> Column:
    return (day_of_week(day) - 1) * 86_400 + time_of_day(time)
