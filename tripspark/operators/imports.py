"""Histories from other services: overlap, calibration, clips."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tripspark.functions.paths import clip_file_name, external_signature
from tripspark.functions.scalars import js_round
from tripspark.operators.intervals import HOUR, overlapping, points_in_spans

MPH_TO_MPS = 0.44704


def _keyed(drives: DataFrame) -> DataFrame:
    return drives.withColumn("_id", F.col("drive_id"))


def hidden_imports(drives: DataFrame) -> DataFrame:
    """(vehicle_id, drive_id) of imported drives that overlap a recorded drive; summoned ones do not count."""
    own = drives.where("source = 'sei' AND NOT summon")
    return overlapping(_keyed(drives.where("source <> 'sei'")), own).withColumnRenamed("_id", "drive_id")


def hide_overlapping_imports(drives: DataFrame) -> DataFrame:
    """Drives without the hidden imports. Expects vehicle_id, drive_id, start_ms, end_ms, source, summon."""
    return drives.join(hidden_imports(drives), ["vehicle_id", "drive_id"], "left_anti")


def hidden_signatures(drives: DataFrame, source: str) -> DataFrame:
    """Signatures of one source's drives that overlap any recorded drive, summoned ones too. Expects external_signature."""
    mine = drives.where((F.col("source") == source) & F.col("external_signature").isNotNull())
    hit = overlapping(_keyed(mine), drives.where("source = 'sei'")).withColumnRenamed("_id", "drive_id")
    return mine.join(hit, ["vehicle_id", "drive_id"], "left_semi").select("vehicle_id", "external_signature").distinct()


def remove_hidden_imports(clips: DataFrame, drives: DataFrame, source: str) -> DataFrame:
    """Clips without those of the source's hidden signatures."""
    gone = hidden_signatures(drives, source).withColumn("source", F.lit(source))
    return clips.join(gone, ["vehicle_id", "external_signature", "source"], "left_anti")


def import_status(imports: DataFrame, drives: DataFrame, known: DataFrame) -> DataFrame:
    """``status`` of each import drive: duplicate (known signature), overlap (range widened to whole minutes), else import.

    Expects imports: vehicle_id, drive_id, start_ms, end_ms, signature; known: vehicle_id, signature.
    """
    widened = (F.floor(F.col("start_ms") / 60000) * 60000, F.ceil(F.col("end_ms") / 60000) * 60000)
    hit = overlapping(_keyed(imports), drives, *widened).select("vehicle_id", F.col("_id").alias("drive_id"), F.lit(True).alias("_o"))
    out = imports.join(known.select("vehicle_id", "signature", F.lit(True).alias("_d")).distinct(), ["vehicle_id", "signature"], "left").join(hit, ["vehicle_id", "drive_id"], "left")
    return out.withColumn("status", F.when(F.col("_d"), "duplicate").when(F.col("_o"), "overlap").otherwise("import")).drop("_d", "_o")


def import_preview(status: DataFrame) -> DataFrame:
    return status.groupBy("status").agg(F.count(F.lit(1)).alias("n"))


def calibrate_import_time(imports: DataFrame, states: DataFrame, window_ms: int = 6 * HOUR, degrees: float = 0.003, least_ms: int = 60_000) -> DataFrame:
    """Shifts a drive to the nearest ``D`` breadcrumb within 6 h and 0.003 degrees of its start; earlier wins ties; shifts under a minute are none.

    Expects imports: vehicle_id, drive_id, start_ms, end_ms, start_lat, start_lng; states: vehicle_id, t_ms, lat, lng, shift.
    """
    d = imports.select("vehicle_id", "drive_id", "start_ms", "start_lat", "start_lng", (F.col("start_ms") - window_ms).alias("_lo"), (F.col("start_ms") + window_ms).alias("_hi"))
    s = states.where("shift = 'D'").select("vehicle_id", "t_ms", "lat", "lng")
    pairs = points_in_spans(s, "t_ms", d, ("_lo", "_hi")).withColumn("dt", F.abs(F.col("t_ms") - F.col("start_ms"))).where(F.col("dt") <= window_ms)
    pairs = pairs.where((F.col("lat") - F.col("start_lat")) ** 2 + (F.col("lng") - F.col("start_lng")) ** 2 <= degrees * degrees)
    best = pairs.groupBy("vehicle_id", "drive_id").agg(F.min_by("t_ms", F.struct("dt", "t_ms")).alias("_t"))
    out = imports.join(best, ["vehicle_id", "drive_id"], "left")
    shift = F.col("_t") - F.col("start_ms")
    shift = F.when(F.abs(shift) >= least_ms, shift).otherwise(0)
    return out.withColumn("shift_ms", F.coalesce(shift, F.lit(0)).cast("bigint")).withColumns({"start_ms": F.col("start_ms") + F.col("shift_ms"), "end_ms": F.col("end_ms") + F.col("shift_ms")}).drop("_t")


def join_drive_states(imports: DataFrame, states: DataFrame, tolerance_ms: int = 90_000) -> DataFrame:
    """Breadcrumbs in gear (D or R) within 90 s of each drive: vehicle_id, drive_id, t_ms and the other columns."""
    d = imports.select("vehicle_id", "drive_id", (F.col("start_ms") - tolerance_ms).alias("_lo"), (F.col("end_ms") + tolerance_ms).alias("_hi"))
    pairs = points_in_spans(states.where("shift IN ('D', 'R')"), "t_ms", d, ("_lo", "_hi"))
    return pairs.where("t_ms BETWEEN _lo AND _hi").drop("_lo", "_hi")


def fill_minute_gaps(points: DataFrame, drives: DataFrame) -> DataFrame:
    """Points (vehicle_id, drive_id, t_ms, lat, lng, speed) with the drives' ends as anchors and a point at :30 of every empty minute.

    Empty minutes lie between two anchors in a row, so a window and a sequence are enough.
    """
    zero = F.lit(0.0).alias("speed")
    ends = [drives.where(f"{p}_lat IS NOT NULL AND {p}_lng IS NOT NULL").select("vehicle_id", "drive_id", F.col(f"{p}_ms").cast("double").alias("t_ms"), F.col(f"{p}_lat").alias("lat"), F.col(f"{p}_lng").alias("lng"), zero) for p in ("start", "end")]
    rows = points.select("vehicle_id", "drive_id", F.col("t_ms").cast("double").alias("t_ms"), "lat", "lng", "speed").unionByName(ends[0]).unionByName(ends[1])
    order = Window.partitionBy("vehicle_id", "drive_id").orderBy("t_ms", "lat", "lng")
    nxt = rows.withColumns({"nt": F.lead("t_ms").over(order), "nla": F.lead("lat").over(order), "nln": F.lead("lng").over(order)})
    minute = lambda c: F.floor(F.col(c) / 60000).cast("bigint")
    empty = nxt.where(minute("nt") > minute("t_ms") + 1).withColumn("m", F.explode(F.sequence(minute("t_ms") + 1, minute("nt") - 1)))
    mid = F.col("m") * 60000.0 + 30000.0
    f = (mid - F.col("t_ms")) / (F.col("nt") - F.col("t_ms"))
    filled = empty.select("vehicle_id", "drive_id", mid.alias("t_ms"), (F.col("lat") + (F.col("nla") - F.col("lat")) * f).alias("lat"), (F.col("lng") + (F.col("nln") - F.col("lng")) * f).alias("lng"), zero)
    return rows.unionByName(filled)


def minute_clips(points: DataFrame, source: str) -> DataFrame:
    """Clips of tumbling minutes: file, date, points, speeds, frame_count, gear_runs, source, external_signature.

    Expects vehicle_id, drive_id, t_ms, lat, lng, speed, signature. Coordinates to 1e-6, speeds not below 0.
    """
    p = points.withColumns({"_m": F.floor(F.col("t_ms") / 60000).cast("bigint"), "speed": F.greatest(F.coalesce("speed", F.lit(0.0)), F.lit(0.0))})
    r6 = lambda c: js_round(F.col(c) * 1e6) / 1e6
    g = p.groupBy("vehicle_id", "drive_id", "signature", "_m").agg(F.sort_array(F.collect_list(F.struct("t_ms", r6("lat").alias("lat"), r6("lng").alias("lng"), "speed"))).alias("w"))
    start = F.col("_m") * 60000
    n = F.size("w")
    zeros = F.array_repeat(F.lit(0), n)
    return g.select(
        "vehicle_id", "drive_id", start.alias("t_ms"), clip_file_name(F.lit(source), start, F.col("signature")).alias("file"), F.date_format(F.timestamp_millis(start), "yyyy-MM-dd").alias("date"),
        F.transform("w", lambda x: F.array(x["lat"], x["lng"])).alias("points"), F.transform("w", lambda x: x["speed"]).alias("speeds"), F.array_repeat(F.lit(1), n).alias("gear_states"), zeros.alias("ap_states"),
        n.cast("bigint").alias("frame_count"), F.lit(0).cast("bigint").alias("park_count"), F.array(F.struct(F.lit(1).alias("gear"), n.cast("double").alias("frames"))).alias("gear_runs"),
        F.lit(source).alias("source"), F.col("signature").alias("external_signature"))


def autopilot_percent(distance_mi: Column, assisted_mi: Column) -> Column:
    return F.when(distance_mi > 0, js_round(F.greatest(F.least(assisted_mi / distance_mi * 100.0, F.lit(100.0)), F.lit(0.0)) * 10.0) / 10.0).otherwise(0.0)


def api_points(points: DataFrame, drives: DataFrame) -> DataFrame:
    """Provider points (seconds or ms; mph) of each drive; a drive with fewer than two gets its summary ends, one with neither none."""
    return _api_points(points, drives).drop("signature")


def _api_points(points: DataFrame, drives: DataFrame, signature: Column | None = None) -> DataFrame:
    """The rows of api_points with the drive's signature: one pass over a drive's points, so that they are shuffled once."""
    t = F.when(F.col("t") > 1e12, F.col("t")).otherwise(F.col("t") * 1000.0)
    point = F.struct(t.cast("double").alias("t_ms"), "lat", "lng", (F.coalesce("speed_mph", F.lit(0.0)) * MPH_TO_MPS).alias("speed"))
    p = points.where("lat IS NOT NULL AND lng IS NOT NULL").groupBy("vehicle_id", "drive_id").agg(F.collect_list(point).alias("_p"))
    end = lambda w: F.struct(F.col(f"{w}_ms").cast("double").alias("t_ms"), F.col(f"{w}_lat").alias("lat"), F.col(f"{w}_lng").alias("lng"), F.lit(0.0).alias("speed"))
    ends = "start_lat IS NOT NULL AND start_lng IS NOT NULL AND end_lat IS NOT NULL AND end_lng IS NOT NULL AND start_ms IS NOT NULL AND end_ms IS NOT NULL"
    d = drives.select("vehicle_id", "drive_id", F.when(F.expr(ends), F.array(end("start"), end("end"))).alias("_e"), (F.lit(None).cast("string") if signature is None else signature).alias("signature"))
    few = F.concat(F.coalesce("_p", F.array().cast("array<struct<t_ms:double,lat:double,lng:double,speed:double>>")), F.col("_e"))
    # a drive that is not listed has its points, but no signature
    rows = d.join(p, ["vehicle_id", "drive_id"], "full" if signature is None else "left")
    return rows.select("vehicle_id", "drive_id", "signature", F.explode(F.when(F.size("_p") >= 2, F.col("_p")).otherwise(few)).alias("x")).select("vehicle_id", "drive_id", "signature", "x.*")


def api_drive_clips(points: DataFrame, drives: DataFrame, source: str) -> DataFrame:
    """Clips from provider drives. Expects drives with odometer_text (two decimals) for the signature."""
    signature = external_signature(F.lit(source), F.coalesce("start_ms", F.lit(0)), F.col("odometer_text"))
    return minute_clips(_api_points(points, drives, signature), source)


def skip_reasons(imports: DataFrame, states: DataFrame) -> DataFrame:
    """Counts of import drives that give no clips: bad-timestamps, no-coords, no-points."""
    have = join_drive_states(imports, states).select("vehicle_id", "drive_id", F.lit(True).alias("_p")).distinct()
    out = imports.join(have, ["vehicle_id", "drive_id"], "left")
    ends = F.col("start_lat").isNotNull() & F.col("start_lng").isNotNull() & F.col("end_lat").isNotNull() & F.col("end_lng").isNotNull()
    reason = F.when(F.col("end_ms") <= F.col("start_ms"), "bad-timestamps").when(F.col("_p"), None).when(~ends, "no-coords").otherwise(None)
    return out.select(reason.alias("reason")).where("reason IS NOT NULL").groupBy("reason").agg(F.count(F.lit(1)).alias("n"))
