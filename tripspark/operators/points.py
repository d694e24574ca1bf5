"""GPS points of drives: times, outliers, speeds, runs, headings, drawing."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tripspark.functions.scalars import geodesic_m, heading, js_round, surely_within
from tripspark.operators.helpers import by_length, changes, whole_groups

DRIVE = ("vehicle_id", "drive_id")


def by_point() -> Window:
    return Window.partitionBy(*DRIVE).orderBy("idx")


def interpolate_point_times(clips: DataFrame, span: str = "span_ms") -> DataFrame:
    """One row per point: i, n, lat, lng, time_ms; point i of n is at start + span * i / (n - 1).

    State arrays count only if they are as long as ``points``. Expects points
    array<array<double>> and, if there, gear_states, ap_states, speeds, accel_positions.
    """
    n = F.size("points")
    out = clips.withColumn("n", n)
    keep = [c for c in clips.columns if c not in ("points", "gear_states", "ap_states", "speeds", "accel_positions")]
    for name, col in (("gear", "gear_states"), ("ap", "ap_states"), ("speed", "speeds"), ("accel", "accel_positions")):
        if col in clips.columns:
            out = out.withColumn(f"_{name}", F.when(F.size(col) == n, F.col(col)))
    states = [c for c in ("gear", "ap", "speed", "accel") if f"_{c}" in out.columns]
    rows = out.select(*keep, "n", *(f"_{c}" for c in states), F.posexplode("points").alias("i", "p"))
    time = F.col("t_ms") + F.when(F.col("n") > 1, F.col(span) * F.col("i") / (F.col("n") - 1)).otherwise(0.0)
    return rows.select(*keep, "n", "i", F.col("p")[0].alias("lat"), F.col("p")[1].alias("lng"), time.alias("time_ms"), *(F.get(f"_{c}", F.col("i")).alias(c) for c in states))


def drop_null_island(points: DataFrame, degrees: float = 1.0) -> DataFrame:
    """Points within a degree of 0, 0 on both axes are junk."""
    return points.where((F.abs("lat") >= degrees) | (F.abs("lng") >= degrees))


def median_cluster_filter(points: DataFrame, max_m: float = 1_000_000.0) -> DataFrame:
    """Drops points far from the mean of the drive's middle half; drives of up to two points stay."""
    drive = Window.partitionBy(*DRIVE)
    rows = points.withColumn("_i", F.row_number().over(by_point()) - 1).withColumn("_n", F.count(F.lit(1)).over(drive))
    mid = (F.col("_i") >= F.floor(F.col("_n") * 0.25)) & (F.col("_i") <= F.floor(F.col("_n") * 0.75))
    rows = rows.withColumn("_la", F.avg(F.when(mid, F.col("lat"))).over(drive)).withColumn("_ln", F.avg(F.when(mid, F.col("lng"))).over(drive))
    place = (F.col("lat"), F.col("lng"), F.col("_la"), F.col("_ln"))
    return rows.where((F.col("_n") <= 2) | surely_within(*place, max_m) | (geodesic_m(*place) <= max_m)).drop("_i", "_n", "_la", "_ln")


def geodesic_np(lat1, lng1, lat2, lng2):
    """geodesic_m for numpy arrays."""
    f = 1.0 / 298.257223563
    r = np.radians
    b1, b2 = np.arctan((1 - f) * np.tan(r(lat1))), np.arctan((1 - f) * np.tan(r(lat2)))
    p, q = (b1 + b2) / 2, (b2 - b1) / 2
    half = np.sin(r(np.asarray(lng2) - lng1) / 2)
    h = np.sin(q) ** 2 + np.cos(b1) * np.cos(b2) * half**2
    s = 2 * np.arctan2(np.sqrt(h), np.sqrt(np.maximum(1 - h, 0)))
    x = (s - np.sin(s)) * (np.sin(p) * np.cos(q)) ** 2 / np.maximum(1 - h, 1e-12)
    y = (s + np.sin(s)) * (np.cos(p) * np.sin(q)) ** 2 / np.maximum(h, 1e-12)
    return np.where(s == 0, 0.0, 6378137.0 * (s - f / 2 * (x + y)))


def _keep_no_jumps(lat: np.ndarray, lng: np.ndarray, max_m: float) -> np.ndarray:
    """Which points stay, of drives of one length, a drive a row: one pass backward over all of them."""
    far = geodesic_np(lat[:, :-1], lng[:, :-1], lat[:, 1:], lng[:, 1:]) > max_m
    none = np.zeros((len(lat), 1), bool)
    before, step = np.hstack([none, far]), np.hstack([far, none])
    keep, after = np.ones(lat.shape, bool), np.full(len(lat), -1)
    for i in range(lat.shape[1] - 1, -1, -1):
        ahead = step[:, i] & (after >= 0)
        other = np.flatnonzero(after > i + 1)  # the next point that stays is not the next one
        if len(other):
            ahead[other] = geodesic_np(lat[other, i], lng[other, i], lat[other, after[other]], lng[other, after[other]]) > max_m
        drop = (ahead & (before[:, i] | (i == 0))) | ((after < 0) & before[:, i])
        keep[:, i] = ~drop
        after = np.where(drop, after, i)
    return keep


def jump_filter(points: DataFrame, max_m: float = 5000.0) -> DataFrame:
    """Drops points more than 5 km from both the point before and the next one that stays (one side at the ends).

    The pass runs backward and carries the last survivor, so it is a helper, for drives of
    one length at once; drives without a long step are passed by untouched.
    """
    place = (F.col("_plat"), F.col("_plng"), F.col("lat"), F.col("lng"))
    far = ~surely_within(*place, max_m) & (geodesic_m(*place) > max_m)
    flagged = with_previous(points, "lat", "lng").withColumn("_any", F.max(F.coalesce(far, F.lit(False))).over(Window.partitionBy(*DRIVE)))
    plain = flagged.where("NOT _any").select(*points.columns)
    bad = flagged.where("_any").select(*points.columns)

    def of(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for cols, starts in whole_groups(batches, list(DRIVE)):
            keep = np.ones(len(cols["idx"]), bool)
            for at in by_length(starts, len(keep)):
                keep[at] = _keep_no_jumps(cols["lat"][at], cols["lng"][at], max_m)
            yield pd.DataFrame({c: v[keep] for c, v in cols.items()})

    # the windows have put a drive's points together
    return plain.unionByName(bad.sortWithinPartitions(*DRIVE, "idx").mapInPandas(of, points.schema))


def with_previous(points: DataFrame, *columns: str) -> DataFrame:
    """``_p<column>``: the value at the point before. Columns of their own, as an expression over a lag repeats the lag at each mention."""
    return points.withColumns({f"_p{c}": F.lag(c).over(by_point()) for c in columns})


def with_steps(points: DataFrame) -> DataFrame:
    """``d_m`` and ``dt_ms`` from the point before; null at the first."""
    rows = with_previous(points, "lat", "lng", "t_ms")
    d = geodesic_m(F.col("_plat"), F.col("_plng"), F.col("lat"), F.col("lng"))
    return rows.select(*points.columns, d.alias("d_m"), (F.col("t_ms") - F.col("_pt_ms")).alias("dt_ms"))


def point_speeds(points: DataFrame, cap: float = 70.0) -> DataFrame:
    """``speed_mps``: recorded if the drive has any, else by step and at most 70; to 0.01."""
    any_recorded = F.max((F.coalesce(F.col("speed"), F.lit(0.0)) != 0).cast("int")).over(Window.partitionBy(*DRIVE)) == 1
    rows = with_steps(points)
    derived = F.when(F.col("dt_ms") > 0, F.least(F.col("d_m") / (F.col("dt_ms") / 1000.0), F.lit(cap))).otherwise(0.0)
    speed = F.when(any_recorded, F.coalesce(F.col("speed"), F.lit(0.0))).otherwise(F.coalesce(derived, F.lit(0.0)))
    return rows.withColumn("speed_mps", js_round(speed * 100.0) / 100.0)


def headings(points: DataFrame) -> DataFrame:
    """``heading`` in degrees from the point before; null at the first."""
    rows = with_previous(points, "lat", "lng")
    return rows.select(*points.columns, heading(F.col("_plat"), F.col("_plng"), F.col("lat"), F.col("lng")).alias("heading"))


def encode_runs(frames: DataFrame, value: str, key: tuple[str, ...] = ("vehicle_id", "seq"), order: str = "i", extra: dict | None = None) -> DataFrame:
    """Runs of equal values: run_no, value, frames, and what ``extra`` aggregates."""
    w = Window.partitionBy(*key).orderBy(order)
    same = F.col(value).eqNullSafe(F.lag(value).over(w)) & (F.row_number().over(w) > 1)
    runs = frames.withColumn("run_no", F.sum((~same).cast("bigint")).over(w))
    aggs = [F.count(F.lit(1)).alias("frames"), *(c.alias(k) for k, c in (extra or {}).items())]
    return runs.groupBy(*key, "run_no", value).agg(*aggs)


def dedup_consecutive_points(points: DataFrame, key: tuple[str, ...] = ("vehicle_id", "seq"), order: str = "i") -> DataFrame:
    """Drops a point equal to the one before, with its states."""
    w = Window.partitionBy(*key).orderBy(order)
    same = (F.col("lat") == F.lag("lat").over(w)) & (F.col("lng") == F.lag("lng").over(w))
    return points.withColumn("_s", F.coalesce(same, F.lit(False))).where("NOT _s").drop("_s")


def frame_flags(left: Column, right: Column, brake: Column, accel: Column) -> Column:
    """Bit mask of a frame: 1 and 2 the blinkers, 4 the brake, 8 the accelerator."""
    bit = lambda on, k: F.when(on, k).otherwise(0)
    return (bit(left, 1) + bit(right, 2) + bit(brake, 4) + bit(accel > 0, 8)).cast("bigint")


#: The columns that frames_to_clips gives to each clip beside its key.
CLIP_COLUMNS = (
    "frame_count bigint, park_count bigint, points array<array<double>>, gear_states array<{gear}>, ap_states array<{ap}>, speeds array<double>, accel_positions array<double>,"
    " gear_runs array<struct<gear:{gear},frames:double>>, ap_runs array<struct<ap:{ap},frames:double>>, flag_runs array<struct<flags:{flags},frames:double,max_mps:double>>")


def _clips_of(clips: pa.RecordBatch) -> pa.RecordBatch:
    """The clips of lists of frames, from any order."""
    frames = pa.Table.from_struct_array(clips["frames"].flatten())
    ends = np.append(0, np.cumsum(clips["frames"].value_lengths().to_numpy()))
    starts, first = ends[:-1], np.zeros(len(frames), bool)
    first[starts] = True
    i = frames["i"].to_numpy()
    if frames["i"].null_count or ((i[1:] < i[:-1]) & ~first[1:]).any():
        clip = pa.array(np.repeat(np.arange(len(starts)), np.diff(ends)))
        frames = frames.take(pc.sort_indices(pa.table({"clip": clip, "i": frames["i"]}), sort_keys=[("clip", "ascending"), ("i", "ascending")], null_placement="at_start"))
    col = {c: pa.concat_arrays(frames[c].chunks) for c in frames.column_names}
    listed = lambda at, values: pa.ListArray.from_arrays(pa.array(np.searchsorted(at, ends), pa.int32()), values)
    at = np.flatnonzero(first | changes(col["lat"]) | changes(col["lng"]))
    place = np.stack([col[c].to_numpy(zero_copy_only=False)[at] for c in ("lat", "lng")], axis=1)
    out = {c: clips[c] for c in ("vehicle_id", "seq")}
    park = pc.fill_null(pc.equal(col["gear"], pa.scalar(0, col["gear"].type)), False).to_numpy(zero_copy_only=False)
    out |= {"frame_count": pa.array(np.diff(ends)), "park_count": pa.array(np.add.reduceat(park.astype(np.int64), starts))}
    out["points"] = listed(at, pa.ListArray.from_arrays(pa.array(np.arange(0, 2 * len(at) + 1, 2), pa.int32()), pa.array(place.ravel())))
    out |= {name: listed(at, col[c].take(pa.array(at))) for name, c in (("gear_states", "gear"), ("ap_states", "ap"), ("speeds", "speed"), ("accel_positions", "accel"))}
    for name, c in (("gear_runs", "gear"), ("ap_runs", "ap"), ("flag_runs", "flags")):
        # a run lasts until the next one starts, the last one to the end of the clip
        at = np.flatnonzero(first | changes(col[c]))
        parts = {c: col[c].take(pa.array(at)), "frames": pa.array(np.diff(at, append=len(first)).astype(float))}
        if c == "flags":
            speed = np.where(col["speed"].is_null().to_numpy(zero_copy_only=False), -np.inf, np.abs(col["speed"].to_numpy(zero_copy_only=False)))
            top = np.maximum.reduceat(speed, at) * 10.0
            with np.errstate(invalid="ignore"):
                parts["max_mps"] = pa.array((np.floor(top) + (top - np.floor(top) >= 0.5)) / 10.0, mask=top == -np.inf)
        out[name] = listed(at, pa.StructArray.from_arrays(list(parts.values()), list(parts)))
    return pa.RecordBatch.from_pydict(out)


def frames_to_clips(frames: DataFrame) -> DataFrame:
    """One row per clip from raw frames: counts, points, state arrays, runs of gear, mode and flags.

    Frames without a valid fix are dropped before anything is counted. Coordinates to
    1e-6 degrees, speed to 0.1, pedal to 0.01; runs and counts are of all frames left,
    points of those that differ from the one before. Expects vehicle_id, seq, i, lat,
    lng, gear, ap, speed, accel, flags (see frame_flags).

    Frames are gathered to a list per clip before they are shuffled, as far as they lie
    together; runs are found in the lists of many clips at once.
    """
    valid = "lat IS NOT NULL AND lng IS NOT NULL AND NOT isnan(lat) AND NOT isnan(lng) AND NOT (lat = 0 AND lng = 0) AND abs(lat) <= 90 AND abs(lng) <= 180"
    r = lambda c, k: (js_round(F.col(c) * k) / k).cast("double").alias(c)
    key = ["vehicle_id", "seq"]
    rows = frames.where(valid).select(*key, F.struct("i", r("lat", 1e6), r("lng", 1e6), "gear", "ap", r("speed", 10.0), r("accel", 100.0), "flags").alias("f"))

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from (_clips_of(clips) for clips in batches if clips.num_rows)

    kind = {f.name: f.dataType.simpleString() for f in [*rows.schema.fields, *rows.schema["f"].dataType.fields]}
    lists = rows.groupBy(*key).agg(F.collect_list("f").alias("frames"))
    return lists.mapInArrow(of, f"vehicle_id {kind['vehicle_id']}, seq {kind['seq']}, {CLIP_COLUMNS.format(**kind)}")


def mode_segments(points: DataFrame) -> DataFrame:
    """Stretches of engaged or manual driving: segment, engaged, first_idx, last_idx, n_points."""
    w = by_point()
    rows = points.withColumn("engaged", F.col("ap") != 0)
    cut = F.coalesce(F.col("engaged") != F.lag("engaged").over(w), F.lit(True))
    rows = rows.withColumn("segment", F.sum(cut.cast("bigint")).over(w))
    return rows.groupBy(*DRIVE, "segment", "engaged").agg(F.min("idx").alias("first_idx"), F.max("idx").alias("last_idx"), F.count(F.lit(1)).alias("n_points"))


def drive_bounds(points: DataFrame) -> DataFrame:
    """South, west, north and east of each drive."""
    return points.groupBy(*DRIVE).agg(F.min("lat").alias("south"), F.min("lng").alias("west"), F.max("lat").alias("north"), F.max("lng").alias("east"))


def drive_overview(points: DataFrame, drives: int | None = None, total: int = 200_000, least: int = 2, most: int = 120) -> DataFrame:
    """Points of a thinned drive: both ends and evenly spaced ones between, at most ``clamp(total / drives, least, most)``.

    A point stays if some step of the even spacing rounds to it, so nothing is
    collected: idx from 0 and n per drive are enough.
    """
    if drives is None:
        drives = points.select(*DRIVE).distinct().count()
    return thin_points(points, max(least, min(most, total // max(1, drives))))


def thin_points(points: DataFrame, budget: int) -> DataFrame:
    """``budget`` points of each drive (all of a shorter one), with all their states."""
    rows = points.withColumn("_i", F.row_number().over(by_point()) - 1).withColumn("_n", F.count(F.lit(1)).over(Window.partitionBy(*DRIVE)))
    if budget < 2:
        return rows.where("_i = 0").drop("_i", "_n")
    step = (F.col("_n") - 1) / float(budget - 1)
    near = js_round(F.col("_i") / step)
    hit = F.lit(False)
    for k in (-1, 0, 1):
        j = near + k
        hit = hit | ((j >= 0) & (j <= budget - 1) & (js_round(j * step) == F.col("_i")))
    return rows.where((F.col("_n") <= budget) | hit).drop("_i", "_n")


def smooth_path(points: DataFrame, rounds: int = 2) -> DataFrame:
    """Chaikin corner cutting, ends kept: idx, lat, lng; one round for drives of more than 100 points.

    Each round replaces a step by its points at a quarter and three quarters.
    """
    out = points.select(*DRIVE, F.col("idx").cast("double").alias("idx"), "lat", "lng").withColumn("_n", F.count(F.lit(1)).over(Window.partitionBy(*DRIVE)))
    for k in range(rounds):
        w = by_point()
        prev_lat, prev_lng, i = F.lag("lat").over(w), F.lag("lng").over(w), F.row_number().over(w)
        rows = out.withColumns({"pl": prev_lat, "pg": prev_lng, "i": i, "m": F.count(F.lit(1)).over(Window.partitionBy(*DRIVE))})
        mix = lambda t, a, b: F.col(a) * (1 - t) + F.col(b) * t
        one = lambda off, lat, lng: F.struct((F.col("i") * 2 + off).cast("double").alias("idx"), lat.alias("lat"), lng.alias("lng"))
        active = F.lit(True) if k == 0 else F.col("_n") <= 100
        none = F.array().cast("array<struct<idx:double,lat:double,lng:double>>")
        cutting = F.concat(
            F.when(F.col("i") > 1, F.array(one(-2, mix(0.25, "pl", "lat"), mix(0.25, "pg", "lng")), one(-1, mix(0.75, "pl", "lat"), mix(0.75, "pg", "lng")))).otherwise(none),
            F.when((F.col("i") == 1), F.array(one(-3, F.col("lat"), F.col("lng")))).otherwise(none),
            F.when((F.col("i") == F.col("m")) & (F.col("i") > 1), F.array(one(1, F.col("lat"), F.col("lng")))).otherwise(none),
        )
        same = F.array(one(0, F.col("lat"), F.col("lng")))
        out = rows.select(*DRIVE, "_n", F.explode(F.when(active & (F.col("m") > 2), cutting).otherwise(same)).alias("x")).select(*DRIVE, "_n", "x.idx", "x.lat", "x.lng")
    return out.drop("_n")
