"""Drive records of REST services in several spellings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Keys in order of preference, for drives and for points, and the states that count as assisted.
KEYS = {
    "start": ("started_at", "start_date", "start_time", "starting_time", "start", "startedAt", "created_at"),
    "end": ("ended_at", "end_date", "end_time", "finishing_time", "finished_at", "end", "endedAt"),
    "duration": ("duration", "duration_sec", "duration_seconds"),
    "distance": ("distance", "distance_miles", "distance_mi", "miles", "odometer_distance"),
    "assisted": ("autopilot_distance", "autopilot_distance_miles", "fsd_distance", "autopilotDistanceMi"),
    "odometer": ("starting_odometer", "start_odometer", "odometer_start", "startingOdometer"),
    "start_lat": ("latitude_start", "starting_latitude", "start_latitude", "start_lat", "from_latitude"),
    "start_lng": ("longitude_start", "starting_longitude", "start_longitude", "start_lng", "from_longitude"),
    "end_lat": ("latitude_end", "ending_latitude", "end_latitude", "end_lat", "to_latitude"),
    "end_lng": ("longitude_end", "ending_longitude", "end_longitude", "end_lng", "to_longitude"),
    "id": ("id", "drive_id", "uuid", "public_id"),
    "points": ("progress", "path", "points", "locations", "coordinates", "gps", "route"),
}
POINT_KEYS = {
    "lat": ("latitude", "lat"), "lng": ("longitude", "lng", "lon", "long"), "t": ("timestamp", "time", "date", "recorded_at", "created_at", "t"),
    "speed": ("speed", "speed_mph", "velocity"), "ap": ("autopilot", "autopilot_state", "state", "ap"),
}
ENGAGED = "(?i)^(on|active|engaged|autopilot|autosteer|fsd|true|1)$"


def pick(fields: Column, names: tuple[str, ...]) -> Column:
    """The first non-null of the names in a map<string,string>; each exactly, then without regard to case."""
    lower = F.transform_keys(F.map_filter(fields, lambda k, v: v.isNotNull()), lambda k, v: F.lower(k))
    one = lambda n: F.coalesce(fields[n], F.element_at(F.map_from_entries(F.array_distinct(F.filter(F.map_entries(lower), lambda e: e["key"] == n.lower()))), n.lower()))
    return F.coalesce(*(one(n) for n in names))


def number(text: Column) -> Column:
    """The number at the beginning of a text, if any."""
    return F.regexp_extract(F.ltrim(text), r"^[-+]?(\d+\.?\d*|\.\d+)([eE][-+]?\d+)?", 0).try_cast("double")


def to_ms(text: Column) -> Column:
    """Epoch ms from seconds, milliseconds (above 1e12) or a date text."""
    n = F.when(F.regexp_like(text, F.lit(r"^[-+]?\d+(\.\d*)?([eE][-+]?\d+)?$")), text.try_cast("double"))
    return F.coalesce(F.when(n > 1e12, n).otherwise(n * 1000.0), F.unix_millis(text.try_cast("timestamp")).cast("double"))


def is_engaged(state: Column) -> Column:
    n = state.try_cast("double")
    return F.coalesce(F.when(n.isNotNull(), n > 0).otherwise(F.regexp_like(F.trim(state), F.lit(ENGAGED))), F.lit(False))


def response_records(responses: DataFrame, body: str = "body") -> DataFrame:
    """One row per record of a response's ``results``: ``record_no`` from 0 and ``json``; other columns stay. A body that cannot be read, or whose results are no list, has none."""
    found = F.try_variant_get(F.try_parse_json(body), "$.results", "array<variant>")
    return responses.select(*(c for c in responses.columns if c != body), F.posexplode(found).alias("record_no", "_v")).withColumn("json", F.to_json("_v")).drop("_v")


def response_paths(responses: DataFrame, body: str = "body") -> DataFrame:
    """One row per drive of a path response: ``path_no`` from 0 and ``points_json`` as provider_points takes it; other columns stay.

    A result is a list of points, or an object that holds one as ``path`` or else as ``points``; others
    are passed over. If no result is of these, and the first one is a point (has a latitude), all results are the points of one drive.
    """
    found = F.try_variant_get(F.try_parse_json(body), "$.results", "array<variant>")
    points = lambda v: F.coalesce(*(F.try_variant_get(v, at, "array<variant>") for at in ("$", "$.path", "$.points")))
    listed = F.filter(F.transform(found, points), lambda p: p.isNotNull())
    first = F.try_variant_get(F.get(found, F.lit(0)), "$.latitude", "variant")
    flat = (F.size(listed) == 0) & first.isNotNull() & ~F.is_variant_null(first)
    rows = responses.withColumns({"_p": F.when(flat, F.array(found)).otherwise(listed)})
    return rows.select(*(c for c in responses.columns if c != body), F.posexplode("_p").alias("path_no", "_p")).withColumn("points_json", F.to_json("_p")).drop("_p")


def provider_drives_normalized(records: DataFrame, json: str = "json") -> DataFrame:
    """start_ms, end_ms, distance_mi, assisted_mi, odometer, four coordinates and the points' JSON from any of the spellings.

    The end is the start plus the duration if missing; the assisted distance is a
    field or the difference of two counters.
    """
    rows = records.withColumn("_m", F.from_json(json, "map<string,string>", {"primitivesAsString": "true"}))
    m = F.col("_m")
    get = {k: pick(m, names) for k, names in KEYS.items()}
    start, end = to_ms(get["start"]), to_ms(get["end"])
    a, b = number(pick(m, ("self_driving_miles_start",))), number(pick(m, ("self_driving_miles_end",)))
    rows = rows.withColumns({
        "start_ms": start, "end_ms": F.coalesce(end, start + number(get["duration"]) * 1000.0), "distance_mi": F.coalesce(number(get["distance"]), F.lit(0.0)),
        "assisted_mi": F.coalesce(number(get["assisted"]), F.when(b >= a, b - a), F.lit(0.0)), "odometer": number(get["odometer"]), "points_json": get["points"], "provider_id": get["id"],
        **{c: number(get[c]) for c in ("start_lat", "start_lng", "end_lat", "end_lng")}})
    return rows.drop("_m")


def provider_points(drives: DataFrame, key: tuple[str, ...] = ("vehicle_id", "drive_id")) -> DataFrame:
    """One row per point of ``points_json``: lat, lng, t, speed_mph, ap (0 or 1); a point is an object or an array [lat, lng, t, speed]."""
    p = drives.select(*key, F.posexplode(F.from_json("points_json", "array<string>")).alias("i", "p"))
    obj, arr = F.from_json("p", "map<string,string>", {"primitivesAsString": "true"}), F.from_json("p", "array<string>")
    listed = F.ltrim("p").startswith("[")
    p = p.withColumns({"_o": F.when(~listed, obj), "_a": F.when(listed, arr)})
    at = lambda name, k: F.coalesce(pick(F.col("_o"), POINT_KEYS[name]), F.get("_a", F.lit(k)))
    out = p.select(*key, "i", number(at("lat", 0)).alias("lat"), number(at("lng", 1)).alias("lng"), to_ms(at("t", 2)).alias("t"), number(at("speed", 3)).alias("speed_mph"), is_engaged(pick(F.col("_o"), POINT_KEYS["ap"])).cast("int").alias("ap"))
    return out.where("lat IS NOT NULL AND lng IS NOT NULL")
