"""CSV exports of drives and breadcrumbs."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Hours from UTC by zone abbreviation in a header.
ZONES = {
    "UTC": 0, "GMT": 0, "EDT": -4, "EST": -5, "CDT": -5, "CST": -6, "MDT": -6, "MST": -7, "PDT": -7, "PST": -8, "AKDT": -8, "AKST": -9, "HDT": -9, "HST": -10, "ADT": -3, "AST": -4,
    "NDT": -2.5, "NST": -3.5, "BST": 1, "WET": 0, "WEST": 1, "CET": 1, "CEST": 2, "EET": 2, "EEST": 3, "MSK": 3, "SAST": 2, "WAT": 1, "CAT": 2, "EAT": 3, "GST": 4, "PKT": 5, "ICT": 7,
    "WIB": 7, "SGT": 8, "HKT": 8, "PHT": 8, "KST": 9, "JST": 9, "AWST": 8, "ACST": 9.5, "ACDT": 10.5, "AEST": 10, "AEDT": 11, "NZST": 12, "NZDT": 13,
}
DEFAULT_OFFSET_H = -4


def zone_offset_ms(header: str | None) -> int:
    """From ``Started At (ZONE)``; -4 h without a zone; an unknown zone raises."""
    found = re.search(r"\(([A-Z]{2,5})\)", header or "")
    if not found:
        return DEFAULT_OFFSET_H * 3_600_000
    if found[1] not in ZONES:
        raise ValueError(f"unknown time zone {found[1]!r} in the header")
    return int(ZONES[found[1]] * 3_600_000)


def _read(spark: SparkSession, path: str) -> DataFrame:
    df = spark.read.option("header", True).option("multiLine", True).option("quote", '"').option("escape", '"').option("mode", "PERMISSIVE").csv(path)
    return df.toDF(*(c.strip().lstrip("﻿") for c in df.columns))


def leading_number(text: Column) -> Column:
    return F.regexp_extract(F.ltrim(text), r"^[-+]?(\d+\.?\d*|\.\d+)([eE][-+]?\d+)?", 0).try_cast("double")


def local_ms(text: Column, offset_ms: int) -> Column:
    """Epoch ms of ``YYYY-MM-DD HH:MM[:SS]`` (or with T) at a fixed offset; null if unreadable."""
    t = F.regexp_replace(F.trim(text), "T", " ")
    at = F.coalesce(*(F.try_to_timestamp(t, F.lit(p)) for p in ("yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd HH:mm", "yyyy-MM-dd HH:mm:ss.SSS")))
    return F.unix_millis(at) - offset_ms


def read_import_drives(spark: SparkSession, path: str) -> DataFrame:
    """Drives: start_ms, end_ms, distance_mi, assisted_mi (0 if bad), odometers and coordinates (null if bad); rows without both times are dropped.

    The session's time zone must be UTC.
    """
    df = _read(spark, path)
    start = next((c for c in df.columns if c.startswith("Started At")), None)
    end = next((c for c in df.columns if c.startswith("Ended At")), None)
    offset = zone_offset_ms(start)
    num = lambda c: leading_number(F.col(f"`{c}`")) if c in df.columns else F.lit(None).cast("double")
    time = lambda c: local_ms(F.col(f"`{c}`"), offset) if c else F.lit(None).cast("bigint")
    zero = lambda c: F.coalesce(num(c), F.lit(0.0))
    return df.select(
        time(start).alias("start_ms"), time(end).alias("end_ms"), zero("Distance (mi)").alias("distance_mi"), zero("Autopilot Distance (mi)").alias("assisted_mi"), num("Starting Odometer (mi)").alias("odometer_start"),
        num("Ending Odometer (mi)").alias("odometer_end"), num("Starting Latitude").alias("start_lat"), num("Starting Longitude").alias("start_lng"), num("Ending Latitude").alias("end_lat"), num("Ending Longitude").alias("end_lng"),
    ).where("start_ms IS NOT NULL AND end_ms IS NOT NULL")


def read_import_states(spark: SparkSession, path: str) -> DataFrame:
    """Breadcrumbs in UTC: t_ms, lat, lng, shift (upper case, trimmed), speed_mph, odometer; rows without time or place are dropped. Unordered."""
    df = _read(spark, path)
    num = lambda c: leading_number(F.col(f"`{c}`")) if c in df.columns else F.lit(None).cast("double")
    return df.select(
        local_ms(F.col("`Timestamp (UTC)`"), 0).alias("t_ms"), num("Latitude").alias("lat"), num("Longitude").alias("lng"), F.upper(F.trim(F.coalesce("Shift State", F.lit("")))).alias("shift"),
        F.coalesce(num("Speed (mph)"), F.lit(0.0)).alias("speed_mph"), num("Odometer (mi)").alias("odometer")).where("t_ms IS NOT NULL AND lat IS NOT NULL AND lng IS NOT NULL")
