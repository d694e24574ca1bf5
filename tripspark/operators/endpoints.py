"""Places of a drive's ends, and headings smoothed by helpers per drive."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from tripspark.operators.helpers import by_length, whole_groups
from tripspark.operators.points import DRIVE, geodesic_np


def marked_ends(points: DataFrame, window_ms: int = 30_000, most: int = 600) -> DataFrame:
    """``points`` with ``_k`` and ``_n`` of the drive, and whether they belong to the ``_start`` and to the ``_end``: up to ``most`` points within 30 s.

    The first point beyond 30 s and the last one bound the windows of both ends, so one order of the points does for both.
    """
    drive = Window.partitionBy(*DRIVE)
    order = drive.orderBy("idx")
    rows = points.withColumns({
        "_k": F.row_number().over(order) - 1, "_n": F.count(F.lit(1)).over(drive),
        "_first": F.first("t_ms").over(order.rowsBetween(Window.unboundedPreceding, 0)), "_last": F.last("t_ms").over(order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))})
    beyond = lambda t: F.when(F.abs(F.col("t_ms") - F.col(t)) > window_ms, F.col("_k"))
    rows = rows.withColumns({"_until": F.min(beyond("_first")).over(drive), "_from": F.max(beyond("_last")).over(drive)})
    start = (F.col("_k") < most) & F.coalesce(F.col("_k") < F.col("_until"), F.lit(True))
    end = (F.col("_n") - 1 - F.col("_k") < most) & F.coalesce(F.col("_k") > F.col("_from"), F.lit(True))
    return rows.withColumns({"_start": start, "_end": end}).select(*points.columns, "_k", "_n", "_start", "_end")


def _near_ends(points: DataFrame, window_ms: int = 30_000, most: int = 600) -> DataFrame:
    """Of ``marked_ends`` the points of either end."""
    return marked_ends(points, window_ms, most).where("_start OR _end")


def endpoint_window(points: DataFrame, window_ms: int = 30_000, most: int = 600) -> DataFrame:
    """For both ends (``which``) the points up to ``most`` and within 30 s of the end, ``k`` counting from it."""
    ends = F.array_compact(F.array(*(F.when(F.col(on), F.struct(F.lit(on[1:]).alias("which"), k.cast("int").alias("k"))) for on, k in (("_start", F.col("_k")), ("_end", F.col("_n") - 1 - F.col("_k"))))))
    return _near_ends(points, window_ms, most).withColumn("_e", F.explode(ends)).select(*points.columns, "_e.which", "_e.k")


def _snap(rows: dict[str, np.ndarray], radius_m: float = 15.0, seeds: int = 3) -> list[np.ndarray]:
    """lat, lng, accuracy, samples, stationary of ends with one number of points, an end a row; points in order of k."""
    lat, lng, t = (rows[c].astype(float) for c in ("lat", "lng", "t_ms"))
    gear, speed = rows["gear"].astype(float), np.abs(rows["speed"].astype(float))
    still = np.where((gear == 0), 1.0, np.where(np.isnan(speed), np.nan, (speed <= 0.75).astype(float)))
    evidence = ~np.isnan(still).all(axis=1)
    use = (still == 1) | ~evidence[:, None]
    best, most = np.zeros(lat.shape, bool), np.zeros(len(lat), np.int64)
    for i in range(min(seeds, lat.shape[1])):
        near = use & (geodesic_np(lat[:, i, None], lng[:, i, None], lat, lng) <= radius_m)
        many = near.sum(axis=1)
        held = np.where(near, t, -np.inf).max(axis=1) - np.where(near, t, np.inf).min(axis=1)
        better = (~evidence | (still[:, i] == 1)) & (many >= 3) & (held >= 2000) & (many > most)
        best[better], most[better] = near[better], many[better]
    out = [lat[:, 0].copy(), lng[:, 0].copy(), np.full(len(lat), 35.0), np.maximum(most, 1), most > 0]
    for n in np.unique(most[most > 0]):  # clusters of one size at once
        own = np.flatnonzero(most == n)
        for part in np.array_split(own, 1 + len(own) * n * n // 1_000_000):  # distances in bounded pieces
            a, b = (c[part][best[part]].reshape(-1, n) for c in (lat, lng))
            d = geodesic_np(a[:, :, None], b[:, :, None], a[:, None, :], b[:, None, :])
            m, k = d.sum(axis=2).argmin(axis=1), np.arange(len(part))
            reach = np.sort(d[k, m], axis=1)[:, min(n - 1, max(0, int(np.ceil(n * 0.9)) - 1))]
            out[0][part], out[1][part], out[2][part] = a[k, m], b[k, m], np.floor(np.maximum(reach, 5.0) * 10 + 0.5) / 10
    return out


def endpoint_snap(points: DataFrame) -> DataFrame:
    """Per drive and end: lat, lng, accuracy_m, samples, stationary.

    The medoid of the largest cluster of standing points near the end, else the end
    itself with 35 m. The window is cut by Spark (600 rows at most), distances are small
    numpy matrices, of many ends at once. gear and speed are null where they are no evidence.
    """
    values = ("lat", "lng", "t_ms", "gear", "speed")

    def of(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for cols, starts in whole_groups(batches, list(DRIVE)):
            drive = np.repeat(np.arange(len(starts)), np.diff(starts, append=len(cols["lat"])))
            for which, step in (("start", 1), ("end", -1)):
                own = np.flatnonzero(cols[f"_{which}"])[::step]
                begins = np.flatnonzero(np.diff(drive[own], prepend=-1))
                yield from _snapped(cols, ((own[at], which) for at in by_length(begins, len(own))), values)

    near = _near_ends(points.select(*DRIVE, "idx", *values))
    # the window has put a drive's points together in order, so no further shuffle
    ordered = near.sortWithinPartitions(*DRIVE, "idx").select(*DRIVE, "_start", "_end", *values)
    return ordered.mapInPandas(of, _snap_schema(points))


def _snap_schema(points: DataFrame) -> str:
    kind = points.schema["vehicle_id"].dataType.simpleString()
    return f"vehicle_id {kind}, drive_id bigint, which string, lat double, lng double, accuracy_m double, samples bigint, stationary boolean"


def _snapped(cols: dict[str, np.ndarray], ends: Iterator[tuple[np.ndarray, str | np.ndarray]], values: tuple[str, ...]) -> Iterator[pd.DataFrame]:
    """Rows of ends, given as the places of their points and their names."""
    for at, which in ends:
        found = _snap({c: cols[c][at] for c in values})
        yield pd.DataFrame({**{c: cols[c][at[:, 0]] for c in DRIVE}, "which": which, **dict(zip(("lat", "lng", "accuracy_m", "samples", "stationary"), found))})


def snap_ends(ends: DataFrame) -> DataFrame:
    """endpoint_snap over the rows of endpoint_window."""
    keys, values = [*DRIVE, "which"], ("lat", "lng", "t_ms", "gear", "speed")

    def of(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for cols, starts in whole_groups(batches, keys):
            yield from _snapped(cols, ((at, cols["which"][at[:, 0]]) for at in by_length(starts, len(cols["k"]))), values)

    slim = ends.select(*keys, "k", *values)
    # ends are many and small: passes over sorted partitions, many ends at once, instead of a call per end
    ordered = slim.repartition(*DRIVE).sortWithinPartitions(*DRIVE, "which", "k")
    return ordered.mapInPandas(of, _snap_schema(ends))


PLACE = "struct<lat:double,lng:double,accuracy_m:double,samples:bigint,stationary:boolean>"


def places_of_ends(drives: DataFrame, gathered: str) -> DataFrame:
    """Rows of drives with ``start_place`` and ``end_place`` (as of endpoint_snap) instead of ``gathered``, the array of a drive's points near its ends.

    Its elements are _k, _start, _end (of marked_ends), lat, lng, t_ms, gear, speed (doubles), in any order. Arrow data of many drives at once.
    """
    rest = [f for f in drives.schema.fields if f.name != gathered]
    kept = [f.name for f in rest]
    schema = T.StructType([*rest, *(T.StructField(c, T.StructType.fromDDL(PLACE)) for c in ("start_place", "end_place"))])

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = to_arrow_type(schema["start_place"].dataType)
        for batch in batches:
            lists = batch.column(gathered)
            points = lists.flatten()
            drive = np.repeat(np.arange(batch.num_rows), pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False))
            cols = {f.name: points.field(f.name).to_numpy(zero_copy_only=False) for f in points.type}
            order = np.lexsort((cols["_k"], drive))
            drive, cols = drive[order], {c: v[order] for c, v in cols.items()}
            places = []
            for which, step in (("_start", 1), ("_end", -1)):
                own = np.flatnonzero(cols[which])[::step]
                values, known = [np.zeros(batch.num_rows, t) for t in (float, float, float, np.int64, bool)], np.zeros(batch.num_rows, bool)
                for at in by_length(np.flatnonzero(np.diff(drive[own], prepend=-1)), len(own)):
                    at = own[at]
                    row = drive[at[:, 0]]
                    for v, found in zip(values, _snap({c: cols[c][at] for c in ("lat", "lng", "t_ms", "gear", "speed")})):
                        v[row] = found
                    known[row] = True
                places.append(pa.StructArray.from_arrays([pa.array(v, f.type) for v, f in zip(values, kind)], fields=list(kind), mask=pa.array(~known)))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), *places], names=schema.names)

    return drives.mapInArrow(of, schema)


# ---- headings

#: Metres between two places that tell a direction, m/s of a moving car, points that a window may reach to either side.
CLEAR_M, MOVING_MPS, REACH = 1.5, 0.5, 32
REVERSE = 2


def _up_to(x: np.ndarray, drives: int) -> np.ndarray:
    """Sums before each place of its own drive, so that the sum of a to b - 1 is one difference; a drive has one more than its points."""
    return np.cumsum(np.pad(x.reshape(drives, -1), ((0, 0), (1, 0))), axis=1).ravel()


def _bearing(lat1, lng1, lat2, lng2) -> np.ndarray:
    """Initial course in radians."""
    f1, f2, turn = np.radians(lat1), np.radians(lat2), np.radians(np.asarray(lng2) - lng1)
    return np.arctan2(np.sin(turn) * np.cos(f2), np.cos(f1) * np.sin(f2) - np.sin(f1) * np.cos(f2) * np.cos(turn))


def local_headings(lat: np.ndarray, lng: np.ndarray, speed: np.ndarray, gear: np.ndarray | None, window: int) -> np.ndarray:
    """The heading in degrees that the points round each point tell, as the car points; NaN where motion cannot be told from noise.

    All points of drives of one length at once: arrays of a drive, or of a drive a row; gear null all along a drive is no evidence. A window stays in a point's stretch of one gear. Round a
    moving point it doubles until its ends are CLEAR_M apart; round one without speed it is
    taken as it is, and must be straight and long enough. The heading is the mean of
    the clear steps' bearings by their lengths: of those driven at speed if there are any.
    """
    shape, n, drives = lat.shape, lat.shape[-1], lat.size // lat.shape[-1]
    lat, lng, speed = lat.ravel(), lng.ravel(), speed.ravel()
    at = np.arange(lat.size)
    own = at // n
    begins = at % n == 0
    if gear is not None:
        gear = gear.ravel()
        begins[1:] |= (gear[1:] != gear[:-1]) & ~np.isnan(gear.reshape(drives, n)).all(axis=1)[own[1:]]
    edges = np.append(np.flatnonzero(begins), lat.size)
    first, last = np.repeat(edges[:-1], np.diff(edges)), np.repeat(edges[1:] - 1, np.diff(edges))
    first, last = np.maximum(first, at - REACH), np.minimum(last, at + REACH)
    apart = lambda a, b: geodesic_np(lat[a], lng[a], lat[b], lng[b])

    a, b = np.maximum(first, at - window // 2), np.minimum(last, at + (window + 1) // 2)
    moved = np.where(b > a, apart(a, b), 0.0)
    pace = np.abs(speed)
    moving = _up_to((np.nan_to_num(pace) >= MOVING_MPS).astype(np.int64), drives)
    fast = moving[b + 1 + own] > moving[a + own]
    half = (window + 1) // 2
    wider = np.flatnonzero(fast & (b > a) & (moved < CLEAR_M) & ((a > first) | (b < last)))
    while len(wider):
        half *= 2
        a[wider], b[wider] = np.maximum(first[wider], wider - half), np.minimum(last[wider], wider + half)
        moved[wider] = apart(a[wider], b[wider])
        wider = wider[(moved[wider] < CLEAR_M) & ((a[wider] > first[wider]) | (b[wider] < last[wider]))]

    # to the next point of the drive; its last one has none
    to = np.where(at % n < n - 1, at + 1, at)
    step, course = apart(at, to), _bearing(lat, lng, lat[to], lng[to])
    between = lambda x: (lambda sums: sums[b + own] - sums[a + own])(_up_to(x, drives))
    driven = between(step)
    steady = (moved >= np.maximum(CLEAR_M, 0.4 * (b - a))) & ~((driven > 0) & (moved < 0.5 * driven))
    told = (b > a) & np.where(fast, moved >= CLEAR_M, steady)

    clear = step >= CLEAR_M
    at_speed = clear & np.isfinite(pace) & np.isfinite(pace[to]) & (np.fmax(pace[to], pace) >= MOVING_MPS)
    heading = np.degrees(_bearing(lat[a], lng[a], lat[b], lng[b]))  # where no step is clear, from end to end
    for steps in (clear, at_speed):  # the later one has the last word
        many, weight = between(steps.astype(np.int64)), np.where(steps, step, 0.0)
        mean = np.degrees(np.arctan2(between(weight * np.sin(course)), between(weight * np.cos(course))))
        heading = np.where(many > 0, mean, heading)
    if gear is not None:
        heading = heading + np.where(gear == REVERSE, 180.0, 0.0)
    return np.where(told, np.mod(heading, 360.0), np.nan).reshape(shape)


def carried_headings(told: np.ndarray, window: int) -> np.ndarray:
    """Where nothing is told, the heading of the last point before that tells one, in steps of half a window; else of the first point; else of the next one after."""
    shape, stride, n = told.shape, max(1, window // 2), told.shape[-1]
    told, out = np.atleast_2d(told), np.atleast_2d(told.copy())
    drive = np.arange(len(told))[:, None]
    for lane in range(min(stride, n)):
        own = told[:, lane::stride]
        clear, k = np.isfinite(own), np.arange(own.shape[1])
        before = np.maximum.accumulate(np.where(clear, k, -1), axis=1)
        after = np.minimum.accumulate(np.where(clear, k, len(k))[:, ::-1], axis=1)[:, ::-1]
        fill = np.where(after < len(k), own[drive, np.minimum(after, len(k) - 1)], np.nan)
        fill = np.where(np.isfinite(told[:, :1]), told[:, :1], fill)
        out[:, lane::stride] = np.where(before >= 0, own[drive, np.maximum(before, 0)], fill)
    return out.reshape(shape)


def smooth_heading(points: DataFrame, window: int = 6) -> DataFrame:
    """vehicle_id, drive_id, idx, heading (degrees, null if none can be told).

    What a standing car points at depends on what was told before, so a numpy helper works
    on drives, those of one length at once, linear in their points; Spark partitions and sorts the drives.
    """
    kind = points.schema["vehicle_id"].dataType.simpleString()

    def of(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for cols, starts in whole_groups(batches, list(DRIVE)):
            heading = np.full(len(cols["idx"]), np.nan)
            for at in by_length(starts, len(heading)):
                if at.shape[1] > 1:
                    lat, lng, speed, gear = (cols[c][at].astype(float) for c in ("lat", "lng", "speed", "gear"))
                    heading[at] = carried_headings(local_headings(lat, lng, speed, gear, window), window)
            yield pd.DataFrame({**{c: cols[c] for c in (*DRIVE, "idx")}, "heading": pd.array(heading, dtype="Float64")})

    slim = points.select(*DRIVE, "idx", "lat", "lng", "speed", "gear")
    ordered = slim.repartition(*DRIVE).sortWithinPartitions(*DRIVE, "idx")
    return ordered.mapInPandas(of, f"vehicle_id {kind}, drive_id bigint, idx bigint, heading double")
