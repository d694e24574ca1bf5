"""Sessions: work windows, drives, cuts at parking and at import signatures."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tripspark.functions.scalars import js_round
from tripspark.operators.scans import number_gaps


def _gaps(rows: DataFrame, gap_ms: int, name: str) -> DataFrame:
    order = Window.partitionBy("vehicle_id").orderBy("t_ms", "seq")
    new = F.coalesce(F.col("t_ms") - F.lag("t_ms").over(order) > gap_ms, F.lit(True))
    return rows.withColumn(name, F.sum(new.cast("bigint")).over(order))


def time_windows(clips: DataFrame, gap_ms: int = 1_800_000, spread: bool = False) -> DataFrame:
    """``window_id``: counts up at every pause of more than 30 minutes; no rule reaches across one.

    ``spread``: a vehicle may fill many tasks (see scans), for fleets in which a few hold most rows.
    """
    return number_gaps(clips, gap_ms, "window_id") if spread else _gaps(clips, gap_ms, "window_id")


def sessionize_drives(clips: DataFrame, gap_ms: int = 300_000, spread: bool = False) -> DataFrame:
    """``drive_id`` within the vehicle: a new one when clips start more than 5 minutes apart. ``spread`` as in time_windows."""
    return number_gaps(clips, gap_ms, "drive_id") if spread else _gaps(clips, gap_ms, "drive_id")


def signature_split(clips: DataFrame, key: tuple[str, ...] = ("vehicle_id",)) -> DataFrame:
    """``sub_drive``: within a drive that has signatures, 0 for unsigned clips, then signatures by first appearance."""
    drive = Window.partitionBy(*key, "drive_id")
    first = F.min(F.struct("t_ms", "seq")).over(Window.partitionBy(*key, "drive_id", "external_signature"))
    rows = clips.withColumn("_f", F.when(F.col("external_signature").isNotNull(), first))
    rank = F.dense_rank().over(drive.orderBy("_f"))  # nulls first
    unsigned = F.max(F.col("external_signature").isNull().cast("int")).over(drive)
    return rows.withColumn("sub_drive", F.when(F.col("external_signature").isNull(), 0).otherwise(rank - unsigned).cast("bigint")).drop("_f")


def park_segments(clips: DataFrame, park_s: float = 2.0, clip_ms: int = 60_000) -> DataFrame:
    """The parts of each clip with gear runs: seg_no, parked, start_frame, end_frame, total_frames, start_idx, end_idx, seg_t_ms.

    A Park run of at least ``park_s`` is a gap; all other runs in a row are one
    part. Points are sliced by the rounded share of frames; a part without points
    vanishes. Expects vehicle_id, seq, t_ms, n_points, gear_runs array<struct<gear,frames>>; drive_id is passed on if there.
    """
    return _parts(clips, park_s, clip_ms).drop("plain")


def _parts(clips: DataFrame, park_s: float, clip_ms: int = 60_000, plain: bool = False) -> DataFrame:
    """The rows of park_segments; with ``plain`` also each clip without gear runs as one part."""
    total = F.aggregate("gear_runs", F.lit(0.0), lambda a, r: a + r["frames"])
    whole_clip = F.lit(False) if not plain else F.col("gear_runs").isNull() | (F.size("gear_runs") == 0)
    also = [c for c in ("drive_id",) if c in clips.columns]
    none = F.array().cast("array<struct<parked:boolean,start_frame:double,end_frame:double>>")

    def add(acc: Column, r: Column) -> Column:
        """A run begins a part if it is a gap or follows one, else it lengthens the last part."""
        parts, end = acc["parts"], acc["end"] + r["frames"]
        parked = F.coalesce(r["gear"] == 0, F.lit(False)) & (r["frames"] * 60.0 / F.col("total_frames") >= park_s)
        last = F.element_at(parts, -1)
        new = F.struct(parked.alias("parked"), acc["end"].alias("start_frame"), end.alias("end_frame"))
        longer = F.struct(last["parked"].alias("parked"), F.least(last["start_frame"], acc["end"]).alias("start_frame"), F.greatest(last["end_frame"], end).alias("end_frame"))
        begins = (F.size(parts) == 0) | parked | F.coalesce(F.get(parts, F.size(parts) - 1)["parked"], F.lit(False))
        return F.struct(end.alias("end"), F.when(begins, F.array_append(parts, new)).otherwise(F.concat(F.slice(parts, 1, F.greatest(F.size(parts) - 1, F.lit(0))), F.array(longer))).alias("parts"))

    parts = F.aggregate("gear_runs", F.struct(F.lit(0.0).alias("end"), none.alias("parts")), add)["parts"]
    one = F.array(F.struct(F.lit(False).alias("parked"), F.lit(0.0).alias("start_frame"), F.lit(1.0).alias("end_frame")))
    runs = clips.withColumns({"plain": whole_clip, "total_frames": F.when(whole_clip, 1.0).otherwise(total)}).where("total_frames > 0")
    segs = runs.select("vehicle_id", "seq", *also, "t_ms", "n_points", "total_frames", "plain", F.posexplode(F.when(F.col("plain"), one).otherwise(parts)).alias("k", "part"))
    segs = segs.select("vehicle_id", "seq", *also, "t_ms", "n_points", "total_frames", "plain", (F.col("k") + 1).cast("bigint").alias("seg_no"), "part.*")
    n = F.col("n_points").cast("double")
    whole = (F.col("start_frame") == 0) & (F.col("end_frame") == F.col("total_frames"))
    start = F.greatest(F.least(js_round(F.col("start_frame") / F.col("total_frames") * n), n - 1), F.lit(0.0))
    end = F.greatest(F.least(js_round(F.col("end_frame") / F.col("total_frames") * n), n), start + 1)
    segs = segs.withColumn("start_idx", F.when(whole, 0.0).otherwise(start)).withColumn("end_idx", F.when(whole, n).otherwise(end))
    segs = segs.where(F.col("plain") | F.col("parked") | ((F.col("end_idx") <= n) & (n > 0)))
    shift = F.floor(F.col("start_frame") / F.col("total_frames") * clip_ms)
    return segs.withColumns({"start_idx": F.col("start_idx").cast("bigint"), "end_idx": F.col("end_idx").cast("bigint"), "seg_t_ms": (F.col("t_ms") + shift).cast("bigint")})


def park_splits(clips: DataFrame, park_s: float = 2.0, with_share: bool = False) -> DataFrame:
    """Driving parts of clips with ``cut_drive``, counted within the drive: every Park gap closes it; groups without points vanish.

    Clips without gear runs pass whole. Expects the columns of park_segments and drive_id.
    ``with_share`` adds ``share``, the part's share of its clip's frames.
    """
    segs = _parts(clips, park_s, plain=True).select(
        "vehicle_id", "seq", "drive_id", "t_ms", "seg_no", "parked", "start_idx", "end_idx", "seg_t_ms", *([((F.col("end_frame") - F.col("start_frame")) / F.col("total_frames")).alias("share")] if with_share else []))
    order = Window.partitionBy("vehicle_id", "drive_id").orderBy("t_ms", "seq", "seg_no")
    segs = segs.withColumn("gaps", F.sum(F.col("parked").cast("bigint")).over(order)).where("NOT parked")
    # the rank of the gaps, counted in the order that the rows have already
    fresh = F.coalesce(F.col("gaps") != F.lag("gaps").over(order), F.lit(True))
    segs = segs.withColumn("_new", fresh.cast("bigint"))
    cut = F.sum("_new").over(order)
    return segs.select("vehicle_id", "drive_id", cut.alias("cut_drive"), "seq", "seg_no", "start_idx", "end_idx", "seg_t_ms", *(["share"] if with_share else []))


def legacy_park_split(clips: DataFrame) -> DataFrame:
    """For drives without gear runs: mostly parked clips go and cut the drive (``cut_drive``); a single clip stays.

    Mostly parked: more than half of the raw frames, else of the gear states, are Park.
    Expects drive_id, park_count, frame_count, gear_states.
    """
    drive = Window.partitionBy("vehicle_id", "drive_id")
    by_states = F.size(F.filter("gear_states", lambda g: g == 0)) > F.size("gear_states") / 2.0
    parked = F.when(F.col("frame_count") > 0, F.coalesce(F.col("park_count") / F.col("frame_count") > 0.5, F.lit(False))).otherwise(F.coalesce(by_states, F.lit(False)))
    any_states = F.max((F.coalesce(F.size("gear_states"), F.lit(0)) > 0).cast("int")).over(drive) == 1
    rows = clips.withColumn("_p", parked & any_states & (F.count(F.lit(1)).over(drive) > 1))
    rows = rows.withColumn("_g", F.sum(F.col("_p").cast("bigint")).over(drive.orderBy("t_ms", "seq"))).where("NOT _p")
    return rows.withColumn("cut_drive", F.dense_rank().over(drive.orderBy("_g")).cast("bigint")).drop("_p", "_g")
