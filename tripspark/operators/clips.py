"""Clips: duplicates, spans, evidence of driving, what is new."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tripspark.functions.paths import is_event_clip, normalize_clip_path


def with_paths(clips: DataFrame) -> DataFrame:
    """Adds ``path`` (canonical) and ``is_event``."""
    out = clips.withColumn("path", normalize_clip_path(F.col("file")))
    return out.withColumn("is_event", is_event_clip(F.col("path")))


def dedup_clips(clips: DataFrame) -> DataFrame:
    """The first clip (lowest ``seq``) of each vehicle and canonical path. Expects ``path``."""
    first = F.row_number().over(Window.partitionBy("vehicle_id", "path").orderBy("seq"))
    return clips.withColumn("_n", first).where("_n = 1").drop("_n")


def latest_route_per_file(clips: DataFrame, version: str = "run_seq") -> DataFrame:
    """The newest clip of each vehicle and path; the aggregate is partial, no sort. Expects ``path``."""
    cols = [c for c in clips.columns if c not in ("vehicle_id", "path")]
    best = clips.groupBy("vehicle_id", "path").agg(F.max_by(F.struct(*cols), version).alias("_r"))
    return best.select("vehicle_id", "path", *(F.col(f"_r.{c}").alias(c) for c in cols))


def ingest_counts(clips: DataFrame) -> DataFrame:
    """processed, routes, dropped (no path or no time) and duplicates. Expects ``path`` and ``t_ms``."""
    good = F.col("path").isNotNull() & F.col("t_ms").isNotNull()
    kept = clips.where(good).select("vehicle_id", "path").distinct().agg(F.count(F.lit(1)).alias("routes"))
    seen = clips.agg(F.count(F.lit(1)).alias("processed"), F.count_if(~good).alias("dropped"))
    both = seen.join(kept, how="cross")  # one row each
    return both.select("processed", "routes", "dropped", (F.col("processed") - F.col("dropped") - F.col("routes")).alias("duplicates"))


def clip_has_driving(gear_runs: Column, gear_states: Column, park_count: Column, frame_count: Column, speeds: Column, min_mps: float = 0.5) -> Column:
    """Any gear run or state but Park; without gear data fewer Park frames than frames; or any speed above ``min_mps``."""
    empty = F.coalesce(F.size(gear_runs), F.lit(0)) + F.coalesce(F.size(gear_states), F.lit(0)) <= 0
    moved = F.exists(gear_runs, lambda r: F.coalesce(r["gear"] != 0, F.lit(True))) | F.exists(gear_states, lambda g: g != 0)
    fewer = empty & F.coalesce(park_count < frame_count, F.lit(False))
    fast = F.exists(speeds, lambda s: F.abs(s) > min_mps)
    no = F.lit(False)
    return F.coalesce(moved, no) | fewer | F.coalesce(fast, no)


def clip_spans(clips: DataFrame, clip_ms: int = 60_000, key: tuple[str, ...] = ("vehicle_id",)) -> DataFrame:
    """``span_ms``: a native clip lasts until the next native clip if that begins 1 to ``clip_ms`` later, any other ``clip_ms``.

    Native: source ``sei`` and no bridge. The next native clip comes from a running
    last value over the reversed order, so the window stays linear.
    """
    native = (F.col("source") == "sei") & ~F.coalesce(F.col("is_bridge"), F.lit(False)) if "is_bridge" in clips.columns else F.col("source") == "sei"
    back = Window.partitionBy(*key).orderBy(F.desc("t_ms"), F.desc("seq")).rowsBetween(Window.unboundedPreceding, -1)
    gap = F.last(F.when(native, F.col("t_ms")), ignorenulls=True).over(back) - F.col("t_ms")
    return clips.withColumn("span_ms", F.when(native & (gap > 0) & (gap <= clip_ms), gap).otherwise(F.lit(clip_ms)).cast("bigint"))


def new_clips(listed: DataFrame, processed: DataFrame, cutoff: str) -> DataFrame:
    """Front clips listed on or after ``cutoff`` that are not processed, with ``status``.

    ``keep``, ``skip`` (an event clip without driving: processed, not kept) or
    ``retry`` (extraction failed). Expects path, date, has_driving, failed; paths in ``processed``.
    """
    todo = listed.where((F.col("date") >= cutoff) & F.col("is_front")).join(processed, ["vehicle_id", "path"], "left_anti")
    return todo.withColumn("status", F.when(F.col("failed"), "retry").when(F.col("is_event") & ~F.col("has_driving"), "skip").otherwise("keep"))
