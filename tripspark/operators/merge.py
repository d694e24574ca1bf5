"""Edits of a store: merge, removal, tags."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

DRIVE_KEY = ["vehicle_id", "start_time"]


def merge_clips(into: DataFrame, other: DataFrame) -> DataFrame:
    """All clips of ``into`` and those of ``other`` whose path is new. Expects path."""
    return into.unionByName(other.join(into.select("vehicle_id", "path"), ["vehicle_id", "path"], "left_anti").select(*into.columns))


def merge_preview(into: DataFrame, other: DataFrame) -> DataFrame:
    """new and known: clips of ``other`` by whether their path is known."""
    known = other.join(into.select("vehicle_id", "path", F.lit(1).alias("_k")).distinct(), ["vehicle_id", "path"], "left")
    return known.agg(F.count_if(F.col("_k").isNull()).alias("new"), F.count("_k").alias("known"))


def merge_tags(into: DataFrame, other: DataFrame) -> DataFrame:
    """Tags (vehicle_id, start_time, tags) of both sides, order kept, none twice."""
    none = F.array().cast("array<string>")
    both = into.join(other.withColumnRenamed("tags", "_o"), DRIVE_KEY, "full")
    return both.select(*DRIVE_KEY, F.array_distinct(F.concat(F.coalesce("tags", none), F.coalesce("_o", none))).alias("tags"))


def edit_tags(tags: DataFrame, edits: DataFrame) -> DataFrame:
    """Adds and removes one tag per drive (``add``, ``remove``, either may be null); a drive without tags is dropped."""
    none = F.array().cast("array<string>")
    both = tags.join(edits, DRIVE_KEY, "full").withColumn("tags", F.coalesce("tags", none))
    plus = F.when(F.col("add").isNotNull(), F.array_distinct(F.array_append("tags", F.col("add")))).otherwise(F.col("tags"))
    out = both.withColumn("tags", plus).withColumn("tags", F.when(F.col("remove").isNotNull(), F.array_remove("tags", F.col("remove"))).otherwise(F.col("tags")))
    return out.where(F.size("tags") > 0).select(*DRIVE_KEY, "tags")


def remove_drives(clips: DataFrame, chosen: DataFrame) -> DataFrame:
    """Clips without those of the chosen drives (vehicle_id, drive_id). The same anti-join serves processed names and tags."""
    return clips.join(chosen, ["vehicle_id", "drive_id"], "left_anti")


def remove_drive_tags(tags: DataFrame, chosen: DataFrame) -> DataFrame:
    """Tags without those of the chosen drives (vehicle_id, start_time)."""
    return tags.join(chosen, DRIVE_KEY, "left_anti")


def remove_source(clips: DataFrame, source: str) -> DataFrame:
    return clips.where(~F.col("source").eqNullSafe(F.lit(source)))


def attach_drive_tags(drives: DataFrame, tags: DataFrame) -> DataFrame:
    """Adds ``tags`` (array, empty if none) by the drive's local start time as text."""
    return drives.join(tags.select(*DRIVE_KEY, "tags"), DRIVE_KEY, "left").withColumn("tags", F.coalesce("tags", F.array().cast("array<string>")))


def tag_library(tags: DataFrame) -> DataFrame:
    return tags.select(F.explode("tags").alias("tag")).distinct().orderBy("tag")
