"""The main flow from end to end: clips to drives.

What makes a drive is settled on slim rows of clips that lie by vehicle: one
shuffle, then windows and filters only. The arrays of points are shuffled
to the parts that the drives are made of, once, as arrays, and taken apart there;
every measure of a drive's points is then taken where the points lie, in one
pass, and the points are written nowhere.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tripspark.functions.scalars import js_round
from tripspark.operators import clips as C, endpoints, holes, imports, measure, merge, points as P, sessions, stats, summon
from tripspark.operators.points import DRIVE
from tripspark.operators.regions import shared_folder

BRIDGE = "-front-bridge.mp4"
ARRAYS = ("points", "gear_states", "ap_states", "speeds", "accel_positions")
#: Roll-up's columns and the fields of a clip's telemetry that they come from.
TELEMETRY = {
    "battery_start": "batteryPctStart", "battery_end": "batteryPctEnd", "interior_min": "interiorTempMin", "interior_max": "interiorTempMax", "exterior_avg": "exteriorTempAvg", "hvac_s": "hvacRuntimeS",
    "tire_fl": "tireFlPsi", "tire_fr": "tireFrPsi", "tire_rl": "tireRlPsi", "tire_rr": "tireRrPsi", "odometer_start": "odometerMiStart", "odometer_end": "odometerMiEnd",
    "location_start": "locationNameStart", "location_end": "locationNameEnd"}
#: Columns of clips that tests and older stores may lack.
OPTIONAL = {
    "date": "string", "imported_ap_pct": "double", "flag_runs": "array<struct<flags:bigint,frames:double,max_mps:double>>", "ap_runs": "array<struct<ap:bigint,frames:double>>",
    "telemetry": f"struct<{','.join(f'{v}:{'string' if k.startswith('location') else 'double'}' for k, v in TELEMETRY.items())}>"}


def _some(c: str) -> Column:
    return F.coalesce(F.size(c), F.lit(0)) > 0


def gear_segments(park_s: float = 2.0) -> Column:
    """array<struct<parked,s,e>> of a clip with gear_runs and total_frames: each Park run of at least park_s, and what lies between as one."""
    empty = F.array().cast("array<struct<parked:boolean,s:double,e:double>>")

    def step(a: Column, r: Column) -> Column:
        end, segs = a["p"] + r["frames"], a["o"]
        parked = F.coalesce(r["gear"] == 0, F.lit(False)) & (r["frames"] * 60.0 / F.col("total_frames") >= park_s)
        last = F.try_element_at(segs, F.lit(-1))
        goes_on = ~parked & F.coalesce(~last["parked"], F.lit(False))
        seg = F.struct(parked.alias("parked"), F.when(goes_on, last["s"]).otherwise(a["p"]).alias("s"), end.alias("e"))
        return F.struct(end.alias("p"), F.array_append(F.when(goes_on, F.slice(segs, 1, F.size(segs) - 1)).otherwise(segs), seg).alias("o"))

    return F.aggregate("gear_runs", F.struct(F.lit(0.0).alias("p"), empty.alias("o")), step)["o"]


def drive_parts(clips: DataFrame, clip_ms: int = 60_000, gap_ms: int = 300_000, spread: bool = False, only: DataFrame | None = None) -> DataFrame:
    """The parts of clips that make up the drives, in the order of time: vehicle_id, drive_id, part, seq, start_idx, end_idx, seg_t_ms, part_ms, start_frame, end_frame, total_frames.

    Clips without path or time are dropped; of one file the first clip stays; event
    clips come in where they fill holes; a pause of more than 5 minutes, a Park gap
    or another import signature begins a new drive. In a drive without gear runs clips that
    are mostly parked are gaps themselves (unless it is one clip). All of this is settled
    on slim rows that are shuffled once, by vehicle; points are not touched.

    ``spread``: rows lie by vehicle and work window instead, windows being told by a scan that
    spreads a heavy vehicle over tasks. Drives are the same; their numbers rise in time but
    leave room (window times 2^20) instead of being dense. ``only`` as in clips_to_drives.
    """
    key = ("vehicle_id", "window_id") if spread else ("vehicle_id",)
    slim = clips.where("path IS NOT NULL AND t_ms IS NOT NULL").select(
        "vehicle_id", "seq", "path", "t_ms", "source", "external_signature", F.col("path").contains(BRIDGE).alias("is_bridge"), F.size("points").cast("double").alias("n"), "gear_runs",
        (F.size(F.filter("gear_states", lambda g: g == 0)) > F.size("gear_states") / 2.0).alias("by_states"), _some("gear_states").alias("has_states"), F.col("raw_park_count").alias("park_count"), F.col("raw_frame_count").alias("frame_count"),
        # ordinary clips, event clips with driving and those without, which fill no hole: one column, so that both of the next step's readers share the shuffle
        F.when(~F.col("is_event"), 0).when(F.col("is_event") & C.clip_has_driving(F.col("gear_runs"), F.col("gear_states"), F.col("raw_park_count"), F.col("raw_frame_count"), F.col("speeds")), 1).alias("_kind"))
    slim = slim if only is None else slim.join(only.distinct(), ["vehicle_id", "seq"])
    once = sessions.time_windows(C.dedup_clips(slim), spread=True).repartition(*key) if spread else C.dedup_clips(slim.repartition(*key))
    once = once.where("_kind IS NOT NULL").withColumns({"is_event": F.col("_kind") == 1, "driving": F.lit(True)}).drop("_kind")
    rows = C.clip_spans(holes.fill_holes(once, key=key), key=key)
    vehicle, drive = Window.partitionBy(*key), Window.partitionBy(*key, "drive_id")
    pause = F.coalesce(F.col("t_ms") - F.lag("t_ms").over(vehicle.orderBy("t_ms", "seq")) > gap_ms, F.lit(True))
    rows = rows.withColumn("drive_id", F.sum(pause.cast("bigint")).over(vehicle.orderBy("t_ms", "seq")))
    rows = rows.withColumns({"has_runs": _some("gear_runs"), "total_frames": F.aggregate("gear_runs", F.lit(0.0), lambda a, r: a + r["frames"])})
    rows = rows.withColumns({"by_runs": F.max("has_runs").over(drive), "any_states": F.max(F.col("has_states") & ~F.col("has_runs")).over(drive), "clips": F.count(F.lit(1)).over(drive)})
    mostly = F.when(F.col("frame_count") > 0, F.coalesce(F.col("park_count") / F.col("frame_count") > 0.5, F.lit(False))).otherwise(F.coalesce("by_states", F.lit(False)))
    parked = ~F.col("by_runs") & mostly & F.col("any_states") & (F.col("clips") > 1)
    whole = F.array(F.struct(parked.alias("parked"), F.lit(None).cast("double").alias("s"), F.lit(None).cast("double").alias("e")))
    segs = rows.where("NOT has_runs OR total_frames > 0").select("*", F.posexplode(F.when(F.col("has_runs"), gear_segments()).otherwise(whole)).alias("seg_no", "g")).select("*", "g.*").drop("g", "gear_runs")
    share = (F.col("e") - F.col("s")) / F.col("total_frames")
    full = F.col("s").isNull() | ((F.col("s") == 0) & (F.col("e") == F.col("total_frames")))
    start = F.when(full, 0.0).otherwise(F.greatest(F.least(js_round(F.col("s") / F.col("total_frames") * F.col("n")), F.col("n") - 1), F.lit(0.0)))
    segs = segs.withColumn("start_idx", start)
    end = F.when(full, F.col("n")).otherwise(F.greatest(F.least(js_round(F.col("e") / F.col("total_frames") * F.col("n")), F.col("n")), F.col("start_idx") + 1))
    segs = segs.withColumns({"end_idx": end, "seg_t_ms": F.when(full, F.col("t_ms")).otherwise(F.col("t_ms") + F.floor(F.col("s") / F.col("total_frames") * clip_ms)).cast("bigint"), "part_ms": F.coalesce(share, F.lit(1.0)) * F.col("span_ms")})
    segs = segs.where("parked OR s IS NULL OR (end_idx <= n AND n > 0)")
    segs = segs.withColumn("gaps", F.sum(F.col("parked").cast("bigint")).over(drive.orderBy("t_ms", "seq", "seg_no"))).where("NOT parked")
    # a cut is a drive of its own to the split by signatures
    segs = segs.withColumn("drive_id", F.dense_rank().over(vehicle.orderBy("drive_id", "gaps")).cast("bigint"))
    segs = sessions.signature_split(segs.drop("t_ms").withColumn("t_ms", F.col("seg_t_ms")), key)
    number = F.dense_rank().over(vehicle.orderBy("drive_id", "sub_drive")).cast("bigint")
    segs = segs.withColumn("drive_id", F.col("window_id") * (1 << 20) + number if spread else number)
    part = F.row_number().over(drive.orderBy("seg_t_ms", "seq", "seg_no"))
    return segs.select(*DRIVE, part.cast("bigint").alias("part"), "seq", F.col("start_idx").cast("bigint").alias("start_idx"), F.col("end_idx").cast("bigint").alias("end_idx"), "seg_t_ms", "part_ms",
                       F.col("s").alias("start_frame"), F.col("e").alias("end_frame"), F.when(F.col("s").isNotNull(), F.col("total_frames")).alias("total_frames"))


def _with_clips(parts: DataFrame, clips: DataFrame, spread: bool = False) -> DataFrame:
    """``parts`` with the other columns of their clips; the parts of a drive lie together.

    Clips and parts are shuffled once, by vehicle, and lie so for all that is worked out per drive: a
    clip comes before its parts and hands its columns on to them. ``spread``: they are joined by clip
    and shuffled again by drive, so that a heavy vehicle is no single task's.
    """
    if spread:
        return parts.join(clips, ["vehicle_id", "seq"]).repartition(*DRIVE)
    own = [c for c in parts.columns if c not in ("vehicle_id", "seq")]
    rows = clips.select("vehicle_id", "seq", F.struct(*(c for c in clips.columns if c not in ("vehicle_id", "seq"))).alias("_c"))
    rows = parts.unionByName(rows, allowMissingColumns=True).repartition("vehicle_id")
    clip = Window.partitionBy("vehicle_id", "seq").orderBy(F.asc_nulls_first("part")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = rows.withColumn("_c", F.first("_c", ignorenulls=True).over(clip)).where("part IS NOT NULL AND _c IS NOT NULL")
    return rows.select("vehicle_id", "seq", *own, "_c.*")


def _odd_parts(parts: DataFrame, jump_m: float = 5000.0, far_m: float = 900_000.0) -> DataFrame:
    """``odd``: a drive in which some point may be junk, told from the boxes of its parts: only those need the filters of points."""
    ends = {k: F.struct(*(x.alias(n) for n, x in (("lat", of("lats")), ("lng", of("lngs"))))) for k, of in (("_a", lambda c: F.get(c, F.lit(0))), ("_z", lambda c: F.try_element_at(c, F.lit(-1))))}
    parts = parts.withColumns({"_s": F.array_min("lats"), "_n": F.array_max("lats"), "_w": F.array_min("lngs"), "_e": F.array_max("lngs"), **{k: F.when(F.size("lats") > 0, v) for k, v in ends.items()}})
    drive = Window.partitionBy(*DRIVE)
    wide = lambda a, b, c, d, m: (F.abs(F.col(b) - F.col(a)) + F.abs(F.col(d) - F.col(c))) * 112_000.0 > m
    before = F.last("_z", ignorenulls=True).over(drive.orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    parts = parts.withColumn("_b", before)
    step = (F.abs(F.col("_a.lat") - F.col("_b.lat")) + F.abs(F.col("_a.lng") - F.col("_b.lng"))) * 112_000.0 > jump_m
    absent = F.exists("lats", lambda x: x.isNull()) | F.exists("lngs", lambda x: x.isNull())
    junk = wide("_s", "_n", "_w", "_e", jump_m) | F.coalesce(step, F.lit(False)) | ((F.col("_s") < 1) & (F.col("_n") > -1) & (F.col("_w") < 1) & (F.col("_e") > -1)) | absent
    known = F.coalesce(junk, F.size("lats") > 0)
    parts = parts.withColumns({"_s": F.min("_s").over(drive), "_n": F.max("_n").over(drive), "_w": F.min("_w").over(drive), "_e": F.max("_e").over(drive), "odd": F.max(known).over(drive)})
    return parts.withColumn("odd", F.col("odd") | F.coalesce(wide("_s", "_n", "_w", "_e", far_m), F.lit(False))).drop("_s", "_n", "_w", "_e", "_a", "_z", "_b")


def drive_points(clips: DataFrame, parts: DataFrame, spread: bool = False) -> DataFrame:
    """The points of the drives, numbered (idx) in order: vehicle_id, drive_id, idx, seq, lat, lng, t_ms, gear, ap, speed, accel, evidence, and the columns of measured_points. Junk and outliers are gone."""
    even, odd = _points(clips, parts, spread)
    return even.unionByName(odd)


def _points(clips: DataFrame, parts: DataFrame, spread: bool) -> tuple[DataFrame, DataFrame]:
    """drive_points in two: of drives that need no filter of points, and of the others.

    The arrays of clips are shuffled to the parts cut from them and taken apart where they lie
    (``_with_clips``); nothing is shuffled point by point. evidence: 1 if the clip has gears, plus 2 if it has speeds.
    """
    # two arrays of numbers are fewer bytes than one of pairs
    slim = clips.select("vehicle_id", "seq", F.transform("points", lambda p: F.get(p, F.lit(0))).alias("lats"), F.transform("points", lambda p: F.get(p, F.lit(1))).alias("lngs"), *ARRAYS[1:])
    arrays = slim.columns[2:]
    n = F.greatest(F.col("end_idx") - F.col("start_idx"), F.lit(0))
    of = _with_clips(parts.select(*DRIVE, "seq", "part", "seg_t_ms", "part_ms", "start_idx", "end_idx"), slim, spread)
    of = of.select(*DRIVE, "part", "seq", F.col("seg_t_ms").alias("t_ms"), "part_ms", *(F.slice(c, F.col("start_idx") + 1, n).alias(c) for c in arrays))
    first = F.coalesce(F.sum(F.size("lats")).over(Window.partitionBy(*DRIVE).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    of = _odd_parts(of.withColumn("first", first))

    def apart(rows: DataFrame) -> DataFrame:
        # states count only if they are as many as the points
        rows = rows.withColumns({c: F.when(F.size(c) == F.size("lats"), F.col(c)) for c in arrays[2:]}).withColumn("n", F.size("lats"))
        rows = rows.select("*", F.posexplode("lats").alias("i", "lat"))
        time = F.col("t_ms") + F.when(F.col("n") > 1, F.col("part_ms") * F.col("i") / (F.col("n") - 1)).otherwise(0.0)
        own = {k: F.get(c, F.col("i")) for k, c in zip(("gear", "ap", "speed", "accel"), arrays[2:])}
        evidence = F.when(own["gear"].isNotNull(), 1).otherwise(0) + F.when(own["speed"].isNotNull(), 2).otherwise(0)
        zero = {c: F.coalesce(own[c], F.lit(0)) for c in ("gear", "ap")} | {c: F.coalesce(own[c], F.lit(0.0)) for c in ("speed", "accel")}
        return rows.select(*DRIVE, (F.col("first") + F.col("i")).cast("bigint").alias("idx"), "seq", "lat", F.get("lngs", F.col("i")).alias("lng"), time.alias("t_ms"), *(v.alias(k) for k, v in zero.items()), evidence.alias("evidence"))

    even, odd = apart(of.where("NOT odd")), apart(of.where("odd"))
    odd = P.jump_filter(P.median_cluster_filter(P.drop_null_island(odd)))
    return measure.measured_points(even), measure.measured_points(odd)


def drive_figures(clips: DataFrame, parts: DataFrame, spread: bool = False) -> DataFrame:
    """drive_measures and, as ``start_place`` and ``end_place``, both ends of each drive, in one pass over its points.

    The points near the ends are gathered with the measures and go no further than the places found among them.
    Both kinds of drives are measured before they are put together, as a union keeps no partitioning.
    """
    even, odd = (_figures(p) for p in _points(clips, parts, spread))
    return even.unionByName(odd)


def _figures(points: DataFrame) -> DataFrame:
    rows = endpoints.marked_ends(points)
    known = lambda bit, c: F.when(F.col("evidence").bitwiseAND(F.lit(bit)) != 0, F.col(c)).cast("double").alias(c)
    near = F.struct("_k", "_start", "_end", "lat", "lng", F.col("t_ms").cast("double").alias("t_ms"), known(1, "gear"), known(2, "speed"))
    return endpoints.places_of_ends(measure.drive_measures(rows, gather=F.when(F.col("_start") | F.col("_end"), near)), "gathered")


def _clip_rows(clips: DataFrame) -> DataFrame:
    """What drives take from their clips besides points, with nulls for what the clips have not."""
    add = {c: F.lit(None).cast(kind) for c, kind in OPTIONAL.items() if c not in clips.columns}
    c = clips.withColumns(add) if add else clips
    return c.select("vehicle_id", F.col("seq"), "path", "date", "source", "external_signature", "imported_ap_pct", "raw_frame_count", "flag_runs", "ap_runs", "gear_runs", *(F.col(f"telemetry.{v}").alias(k) for k, v in TELEMETRY.items()))


def clip_measures(clips: DataFrame, parts: DataFrame, spread: bool = False) -> DataFrame:
    """Per drive what comes from its clips: times, files, source, signature, date, telemetry, evidence of summon."""
    rows = _with_clips(parts, _clip_rows(clips), spread)
    flagged = F.aggregate("flag_runs", F.lit(0.0), lambda a, r: a + r["frames"])
    total = F.coalesce("total_frames", F.when(F.col("raw_frame_count") > 0, F.col("raw_frame_count")), flagged, F.lit(0.0))
    rows = rows.withColumns({"total_frames": total, "start_frame": F.coalesce("start_frame", F.lit(0.0)), "start_ms": F.col("seg_t_ms"), "end_ms": F.col("seg_t_ms") + F.col("part_ms")})
    rows = rows.withColumn("end_frame", F.coalesce("end_frame", "total_frames"))
    # the evidence is worked out only for parts that a drive of at most ten minutes may have
    rows = summon.clip_evidence(rows)
    end = F.floor(F.col("seg_t_ms") + js_round(F.col("part_ms")))
    first = F.min_by(F.struct("date", "source", "external_signature", "imported_ap_pct"), "part")
    g = rows.groupBy(*DRIVE).agg(
        F.min("seg_t_ms").alias("start_ms"), F.max_by(end, "part").cast("bigint").alias("end_ms"), F.count(F.lit(1)).alias("clip_count"), first.alias("_first"),
        F.transform(F.sort_array(F.collect_list(F.struct("part", "path"))), lambda x: x["path"]).alias("route_files"), F.bool_or(F.col("path").contains(BRIDGE)).alias("bridged"),
        *stats.telemetry_aggs(F.col("part")), *(c for c in summon.evidence_aggs()))
    return stats.telemetry_figures(g.select("*", "_first.*").drop("_first")).withColumn("duration_ms", F.col("end_ms") - F.col("start_ms"))


EVIDENCE = ("shape_ok", "timed", "nominal", "sp", "top", "exact", "pedal", "h0", "h1", "p0", "p1", "modes_ok", "has_modes", "fsd", "other", "total", "has_speeds", "max_speed_mps", "from_ms", "to_ms")


def clips_to_drives(clips: DataFrame, tags: DataFrame | None = None, tz: str = "UTC", spread: bool = False, only: DataFrame | None = None) -> dict[str, DataFrame]:
    """drives, hidden, points, parts and events of the clips that read_drive_data or read_routes give.

    drives: a row per drive: times (ms and local text), distances, speeds, assisted distance
    and time by mode, disengagements and pedal pushes, whether it was a summon manoeuvre (then
    without assist figures), telemetry, files, source, import signature, both ends with
    their accuracy, tags (of ``tags``: vehicle_id, start_time, tags) and whether a gap was bridged.
    Imported drives that overlap a recorded one are in ``hidden`` instead. A drive without
    points left has its clips' figures and no others (0). Parts and drives feed all that follows, so they are
    worked out once and cut off in the shared checkpoint folder. Points are many times as large and are not
    written: one pass takes all of a drive's figures from them. Who reads points or events has them worked out again.

    events: disengagement and accel_push with their places, none of summon drives.
    ``spread`` as in drive_parts. ``only``: (vehicle_id, seq) of the clips that count; the others need not be taken out of ``clips`` before.
    """
    shared_folder(clips.sparkSession)
    parts = drive_parts(clips, spread=spread, only=only).checkpoint()
    points = drive_points(clips, parts, spread)
    out = clip_measures(clips, parts, spread).join(drive_figures(clips, parts, spread), list(DRIVE), "left").withColumn("has_speeds", F.coalesce("has_speeds", F.lit(False)))
    out = out.withColumn("summon", summon.is_summoned()).drop(*EVIDENCE)
    figures = [c for c in out.columns if c.startswith(("fsd_", "autosteer_", "tacc_", "assisted_", "avg_", "max_", "distance_", "point_")) or c in ("disengagements", "accel_pushes")]
    out = summon.without_summon_metrics(out.na.fill(0, figures))
    local = lambda c: F.date_format(F.from_utc_timestamp(F.timestamp_millis(F.col(c)), tz), "yyyy-MM-dd'T'HH:mm:ss")
    out = out.withColumns({"start_time": local("start_ms"), "end_time": local("end_ms")})
    out = merge.attach_drive_tags(out, tags) if tags is not None else out.withColumn("tags", F.array().cast("array<string>"))
    out = out.checkpoint()  # a row per drive, for three readers
    hidden = imports.hidden_imports(out)
    return {"drives": out.join(hidden, list(DRIVE), "left_anti"), "hidden": out.join(hidden, list(DRIVE), "left_semi"), "points": points, "parts": parts, "events": drive_events(points, out)}


def drive_events(points: DataFrame, drives: DataFrame) -> DataFrame:
    """(vehicle_id, drive_id, idx, lat, lng, type) of drives that are no summon manoeuvre."""
    from tripspark.operators import assist

    kinds = {"disengagement": assist.disengagement_events(points), "accel_push": assist.accel_push_events(points)}
    rows = [e.withColumn("type", F.lit(k)) for k, e in kinds.items()]
    return rows[0].unionByName(rows[1]).join(drives.where("summon").select(*DRIVE), list(DRIVE), "left_anti")
