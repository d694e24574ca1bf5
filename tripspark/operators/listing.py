"""Filtered, ordered pages of drives; fresh cache rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def filter_drives(drives: DataFrame, tag: str | None = None, first_day: str | None = None, last_day: str | None = None) -> DataFrame:
    """Drives with the whole tag (case and outer blanks ignored; ``summon`` is a tag too) that start within the days, both included."""
    out = drives
    if tag:
        q = tag.strip().lower()
        has = F.exists("tags", lambda t: F.lower(F.trim(t)) == q)
        out = out.where(has | F.col("summon") if q == "summon" else has)
    if first_day:
        out = out.where(F.col("start_ts") >= F.to_timestamp(F.lit(first_day)))
    if last_day:
        out = out.where(F.col("start_ts") < F.to_timestamp(F.lit(last_day)) + F.expr("INTERVAL 1 DAY"))
    return out


def list_drives(drives: DataFrame, limit: int = 250, offset: int = 0) -> DataFrame:
    """A page, newest first, id breaking ties; 1 to 1000 rows. The first page is a top-k, no full sort."""
    page = drives.orderBy(F.desc("start_ms"), F.desc("id"))
    limit = max(1, min(1000, limit))
    return page.limit(limit) if not offset else page.offset(offset).limit(limit)


def with_total(page: DataFrame, drives: DataFrame) -> DataFrame:
    """The page's rows with the number of all drives."""
    return page.join(drives.agg(F.count(F.lit(1)).alias("total")), how="cross")  # one row


def page_of_drive(drives: DataFrame, id_: int, limit: int = 250) -> DataFrame:
    """``page_offset`` of the page that holds a drive: the drives ahead of it, in whole pages; counted, not ranked."""
    me = drives.where(F.col("id") == id_).select(F.col("start_ms").alias("_s"))
    ahead = F.count_if((F.col("start_ms") > F.col("_s")) | ((F.col("start_ms") == F.col("_s")) & (F.col("id") > id_)))
    return drives.join(F.broadcast(me.limit(1)), how="cross").agg(ahead.alias("n")).select((F.floor(F.col("n") / limit) * limit).cast("bigint").alias("page_offset"))


def drive_ids(drives: DataFrame) -> DataFrame:
    """A numeric ``id`` per vehicle in order of start, for listing only; the stable key is (vehicle_id, drive_id)."""
    n = F.row_number().over(Window.partitionBy("vehicle_id").orderBy("start_ms", "drive_id"))
    return drives.withColumn("id", n.cast("bigint"))


DAY_MS = 86_400_000


def is_fresh(label: Column, confidence: Column, age_ms: Column) -> Column:
    """365, 180 or 90 days by confidence; 30 for a miss or no label."""
    days = F.when(label.isNull() | (confidence == "miss"), 30).when(confidence == "high", 365).when(confidence == "medium", 180).otherwise(90)
    return (age_ms >= 0) & (age_ms < days * F.lit(DAY_MS).cast("bigint"))


def fresh_geocodes(cache: DataFrame, provider: str, now_ms: int) -> DataFrame:
    """Cache rows of the provider that are still fresh. Expects label, confidence, provider, resolved_at."""
    return cache.where((F.col("provider") == provider) & is_fresh(F.col("label"), F.col("confidence"), F.lit(now_ms) - F.col("resolved_at")))
