"""Driverless manoeuvres: gates in a fixed order over the evidence of a drive's clips."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tripspark.functions import runs as R

BLINKERS, PEDALS, PARK = 1 | 2, 4 | 8, 0


def clip_evidence(clips: DataFrame, clip_ms: int = 60_000, bookend_ms: int = 10_000) -> DataFrame:
    """Per clip part, once: shape, top speed, pedals, hazards at its ends, Park around it, frames by mode.

    Expects flag_runs (flags, frames, max_mps), ap_runs (ap, frames), gear_runs (gear,
    frames), start_frame, end_frame, total_frames, start_ms, end_ms.
    """
    s, e, total = F.col("start_frame"), F.col("end_frame"), F.col("total_frames")
    c = clips.withColumns({"_f": R.spans(F.col("flag_runs"), "flags"), "_v": R.spans(F.col("flag_runs"), "max_mps"), "_a": R.spans(F.col("ap_runs"), "ap"), "_g": R.spans(F.col("gear_runs"), "gear")})
    book = F.greatest(F.ceil(total * float(bookend_ms) / clip_ms).cast("double"), F.lit(1.0))
    park = lambda frame: F.coalesce(R.value_at_frame(F.col("_g"), frame) == PARK, F.lit(False))
    after = R.value_at_frame(F.col("_g"), e)
    return c.withColumns({
        "shape_ok": F.coalesce((F.size("flag_runs") > 0) & (total > 0) & (e > s) & (s >= 0) & (e <= total), F.lit(False)) & R.runs_span_frames(F.col("flag_runs"), total),
        "top_mps": R.segment_max_speed(F.col("_v"), s, e),
        "pedal": R.flag_overlap(F.col("_f"), s, e, PEDALS),
        "hazard_start": R.flag_overlap(F.col("_f"), F.greatest(s - book, F.lit(0.0)), F.least(e, s + book), BLINKERS, True),
        "hazard_end": R.flag_overlap(F.col("_f"), F.greatest(s, e - book), F.least(total, e + book), BLINKERS, True),
        "modes_ok": R.runs_span_frames(F.col("ap_runs"), total) & R.runs_span_frames(F.col("gear_runs"), total),
        "park_before": F.when(s > 0, park(s - 1)).otherwise(park(F.lit(0.0))),
        "park_after": F.when(after.isNotNull(), after == PARK).otherwise(park(e - 1)),
        "modes": R.segment_ap_frames(F.col("_a"), s, e),
        "nominal_ms": F.try_divide((e - s) * clip_ms, total),
    }).drop("_f", "_v", "_a", "_g")


def evidence_aggs() -> list[Column]:
    """What the gates ask of a drive, over rows of clip_evidence with seq."""
    at = F.struct("start_ms", "seq")
    timed = F.coalesce(F.col("end_ms") > F.col("start_ms"), F.lit(False))
    return [
        F.bool_and("shape_ok").alias("shape_ok"), F.bool_and(timed).alias("timed"), F.sum("nominal_ms").alias("nominal"),
        F.sort_array(F.collect_list(F.struct("start_ms", "end_ms"))).alias("sp"),
        F.max("top_mps").alias("top"), F.bool_and(F.col("top_mps").isNotNull()).alias("exact"), F.bool_or("pedal").alias("pedal"),
        F.min_by("hazard_start", at).alias("h0"), F.max_by("hazard_end", at).alias("h1"), F.min_by("park_before", at).alias("p0"), F.max_by("park_after", at).alias("p1"),
        F.bool_and("modes_ok").alias("modes_ok"), F.bool_and(F.col("modes").isNotNull()).alias("has_modes"), F.sum("modes.fsd").alias("fsd"), F.sum("modes.other").alias("other"), F.sum("modes.total").alias("total")]


def is_summoned(max_ms: int = 600_000, max_mps: float = 4.5, uncovered_ms: int = 30_000, fsd_share: float = 0.5) -> Column:
    """The verdict over evidence_aggs, duration_ms, max_speed_mps and has_speeds, gate by gate."""

    def union(a, x):
        start = F.greatest(a["e"], x["start_ms"].cast("double"))
        end = F.greatest(a["e"], x["end_ms"].cast("double"))
        return F.struct((a["m"] + F.greatest(end - start, F.lit(0.0))).alias("m"), end.alias("e"))

    covered = F.when(F.col("timed"), F.aggregate("sp", F.struct(F.lit(0.0).alias("m"), F.lit(-1e300).alias("e")), union)["m"]).otherwise(F.col("nominal"))
    speed = F.when(F.col("exact"), F.col("top")).when(F.col("has_speeds"), F.col("max_speed_mps"))
    no = F.lit(False)
    verdict = (
        F.when(~F.coalesce((F.col("duration_ms") > 0) & (F.col("duration_ms") <= max_ms), no), no)
        .when(F.col("shape_ok").isNull() | ~F.col("shape_ok"), no)
        .when(F.col("duration_ms") - covered > uncovered_ms, no)
        .when(F.coalesce(~(speed > 0) | (speed > max_mps), F.lit(True)), no)
        .when(F.col("pedal"), no)
        .when(F.col("h0") & F.col("h1"), F.lit(True))
        .when(~F.col("modes_ok") | ~F.col("p0") | ~F.col("p1"), no)
        .when(~F.col("has_modes") | (F.col("other") > 0), no)
        .otherwise((F.col("total") > 0) & (F.col("fsd") >= F.col("total") * fsd_share)))
    return F.coalesce(verdict, no)


def summon_drives(clips: DataFrame, drives: DataFrame, max_ms: int = 600_000, max_mps: float = 4.5, uncovered_ms: int = 30_000, fsd_share: float = 0.5) -> DataFrame:
    """(vehicle_id, drive_id, summon). Expects drives: duration_ms, max_speed_mps, has_speeds; clips as in clip_evidence with drive_id and seq.

    In this order: duration, shape, coverage (interval union), speed, pedals; hazards
    at both ends decide for it; else all clips need full mode and gear runs, Park at
    both ends, no other mode, and FSD in at least half of the frames. Drives that
    fail on duration never reach the evidence.
    """
    possible = drives.where((F.col("duration_ms") > 0) & (F.col("duration_ms") <= max_ms))
    own = clip_evidence(clips.join(possible.select("vehicle_id", "drive_id"), ["vehicle_id", "drive_id"], "left_semi"))
    g = own.groupBy("vehicle_id", "drive_id").agg(*evidence_aggs())
    out = drives.select("vehicle_id", "drive_id", "duration_ms", "max_speed_mps", "has_speeds").join(g, ["vehicle_id", "drive_id"], "left")
    return out.select("vehicle_id", "drive_id", is_summoned(max_ms, max_mps, uncovered_ms, fsd_share).alias("summon"))


def without_summon_metrics(drives: DataFrame) -> DataFrame:
    """Summoned drives have no assist figures."""
    zero = [c for c in drives.columns if c.startswith(("fsd_", "autosteer_", "tacc_", "assisted_")) or c in ("disengagements", "accel_pushes")]
    return drives.withColumns({c: F.when(F.col("summon"), F.lit(0).cast(drives.schema[c].dataType)).otherwise(F.col(c)) for c in zero})
