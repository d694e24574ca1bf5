"""Queries of the scalar functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from tripspark.functions import paths as PA
from tripspark.functions import scalars as S
from tripspark.functions.fixed import to_fixed
from tripspark.plans.core import clips
from tripspark.plans.registry import query
from tripspark.plans.sqltext import geo, hav, jr, r1, r2
from tripspark.plans.testviews import cte

C = cte("clips")


@query("geodesic_m", C + f" SELECT vehicle_id, seq, {r2(geo('lat', 'lng', '37.5e0', '-121.5e0'))} AS m FROM clips")
def geodesic_m(spark, sf):
    return clips(spark, sf).select("vehicle_id", "seq", S.round2(S.geodesic_m(F.col("lat"), F.col("lng"), F.lit(37.5), F.lit(-121.5))).alias("m"))


@query("haversine_m", C + f" SELECT vehicle_id, seq, {r2(hav('lat', 'lng', '37.5e0', '-121.5e0'))} AS m FROM clips")
def haversine_m(spark, sf):
    return clips(spark, sf).select("vehicle_id", "seq", S.round2(S.haversine_m(F.col("lat"), F.col("lng"), F.lit(37.5), F.lit(-121.5))).alias("m"))


@query("js_round", C + f" SELECT seq, {jr('(seq - 5000) / 2e0')} AS whole, {r1('(seq - 5000) / 8e0')} AS one, {r2('(seq - 5000) / 64e0')} AS two FROM clips")
def js_round(spark, sf):
    x = F.col("seq") - 5000
    return clips(spark, sf).select("seq", S.js_round(x / 2.0).alias("whole"), S.round1(x / 8.0).alias("one"), S.round2(x / 64.0).alias("two"))


@query("coord_key", C + " SELECT seq, printf('%.5f,%.5f', lat, lng) AS key FROM clips")
def coord_key(spark, sf):
    return clips(spark, sf).select("seq", S.coord_key(F.col("lat"), F.col("lng")).alias("key"))


@query("epoch_seconds", C + " SELECT seq, CASE WHEN seq % 7 = 0 THEN NULL WHEN seq % 2 = 0 THEN t_ms * 1e3 / 1e3 ELSE t_ms / 1e3 END AS s FROM clips")
def epoch_seconds(spark, sf):
    raw = F.when(F.col("seq") % 7 == 0, -1.0).when(F.col("seq") % 2 == 0, F.col("t_ms") * 1000.0).otherwise(F.col("t_ms") / 1000.0)
    return clips(spark, sf).select("seq", S.epoch_seconds(raw).alias("s"))


@query("charging_state_key", "SELECT event_id AS seq, CASE event_type WHEN 'view' THEN 'nopower' ELSE concat(event_type, '2') END AS k FROM events")
def charging_state_key(spark, sf):
    e = spark.read.parquet(f"{sf}/events.parquet")
    raw = F.when(F.col("event_type") == "view", " No-Power ").otherwise(F.concat(F.upper("event_type"), F.lit(" #2 ")))
    return e.select(F.col("event_id").alias("seq"), S.charging_state_key(raw).alias("k"))


@query("drive_units", C + f" SELECT seq, {r2('speed * 2.23694e0')} AS mph, {r2('speed * 3.6e0')} AS kmh, {r2('(seq % 50) * 9e0 / 5e0 + 32e0')} AS fahrenheit, {r2('(30 + seq % 20) * 0.0689476e0')} AS bar, {jr('seq / 6e1')} AS minutes, {jr('seq % 97 / 97e0 * 1e3')} / 1e1 AS percent FROM clips")
def drive_units(spark, sf):
    q = F.col("seq")
    return clips(spark, sf).select(
        "seq", S.round2(F.col("speed") * S.MPS_TO_MPH).alias("mph"), S.round2(F.col("speed") * S.MPS_TO_KMH).alias("kmh"), S.round2(S.c_to_f((q % 50).cast("double"))).alias("fahrenheit"),
        S.round2(S.psi_to_bar((30 + q % 20).cast("double"))).alias("bar"), S.js_round(q / 60.0).alias("minutes"), S.percent_of((q % 97).cast("double"), F.lit(97.0)).alias("percent"))


FILES = "CASE seq % 4 WHEN 0 THEN concat('RecentClips', {BS}, 'a', {BS}, {FMT}, '-front.mp4') WHEN 1 THEN concat('SavedClips/x/', {FMT}, '-front.mp4') WHEN 2 THEN concat('SentryClips/2020-01-01_00-00-00/', {FMT}, '-front.mp4') ELSE 'RecentClips/' END"


def files(spark, sf):
    return clips(spark, sf).select("seq", "t_ms", F.expr(FILES.format(BS=r"'\\'", FMT="date_format(timestamp_millis(t_ms * 256), 'yyyy-MM-dd_HH-mm-ss')")).alias("file"))


STAMP = "strftime(make_timestamp(t_ms * 256000), '%Y-%m-%d_%H-%M-%S')"
NORM = f"CASE seq % 4 WHEN 0 THEN concat('a/', {STAMP}, '-front.mp4') WHEN 1 THEN concat('SavedClips/x/', {STAMP}, '-front.mp4') WHEN 2 THEN concat('SentryClips/2020-01-01_00-00-00/', {STAMP}, '-front.mp4') ELSE 'RecentClips/' END"


@query("normalize_clip_path", C + f" SELECT seq, {NORM} AS path FROM clips")
def normalize_clip_path(spark, sf):
    return files(spark, sf).select("seq", PA.normalize_clip_path(F.col("file")).alias("path"))


@query("is_event_clip", C + " SELECT seq, seq % 4 IN (1, 2) AS is_event FROM clips")
def is_event_clip(spark, sf):
    return files(spark, sf).select("seq", PA.is_event_clip(PA.normalize_clip_path(F.col("file"))).alias("is_event"))


@query("clip_timestamp", C + " SELECT seq, CASE WHEN seq % 4 <> 3 THEN t_ms * 256 // 1000 * 1000 END AS t FROM clips")
def clip_timestamp(spark, sf):
    return files(spark, sf).select("seq", PA.clip_timestamp_ms(F.col("file")).alias("t"))


@query("external_signature", C + " SELECT seq, concat('svc:', CAST(t_ms // 60000 AS VARCHAR), ':', CASE WHEN seq % 3 = 0 THEN 'x' ELSE CAST(CAST(CAST(seq / 4e0 AS DECIMAL(30, 10)) AS DECIMAL(20, 2)) AS VARCHAR) END) AS signature FROM clips")
def external_signature(spark, sf):
    odo = F.when(F.col("seq") % 3 != 0, to_fixed(F.col("seq") / 4.0))
    return clips(spark, sf).select("seq", PA.external_signature(F.lit("svc"), F.col("t_ms"), odo).alias("signature"))


@query("clip_file_name", C + f" SELECT seq, concat('svc/', strftime(make_timestamp(t_ms * 256000), '%Y-%m-%d'), '/', {STAMP}, '-front-svc-', CAST(seq AS VARCHAR), '125.mp4') AS file FROM clips")
def clip_file_name(spark, sf):
    sig = F.concat(F.lit("svc:"), F.col("seq").cast("string"), F.lit(":12.5"))
    return clips(spark, sf).select("seq", PA.clip_file_name(F.lit("svc"), F.col("t_ms") * 256, sig).alias("file"))
