"""Queries of listings and files."""

from __future__ import annotations

from pyspark.sql import functions as F

from tripspark.operators import listing as LI
from tripspark.operators import merge as M
from tripspark.plans.core import DRIVES, clips, trip_points
from tripspark.plans.join_queries import TAGGED, tags
from tripspark.plans.registry import query
from tripspark.plans.testviews import cte
from tripspark.sources import drive_data as DD

WITH = cte("clips") + ", " + DRIVES
K = "vehicle_id, drive_id"
ROWS = "dl AS (SELECT vehicle_id, drive_id, vehicle_id * 100000 + drive_id AS id, min(t_ms) AS start_ms FROM drv GROUP BY ALL)"


def rows(spark, sf):
    d = trip_points(spark, sf).groupBy("vehicle_id", "drive_id").agg(F.min("t_ms").alias("start_ms"))
    return d.withColumns({"id": F.col("vehicle_id") * 100000 + F.col("drive_id"), "start_time": F.col("drive_id").cast("string"), "start_ts": F.timestamp_millis(F.col("start_ms") * 256), "summon": F.col("drive_id") % 7 == 0})


@query("list_drives", f"{WITH}, {ROWS} SELECT id, start_ms FROM dl ORDER BY start_ms DESC, id DESC LIMIT 250")
def list_drives(spark, sf):
    return LI.list_drives(rows(spark, sf)).select("id", "start_ms")


@query("list_drives_page", f"{WITH}, {ROWS} SELECT id, start_ms, (SELECT count(*) FROM dl) AS total FROM dl ORDER BY start_ms DESC, id DESC LIMIT 100 OFFSET 200")
def list_drives_page(spark, sf):
    d = rows(spark, sf)
    return LI.with_total(LI.list_drives(d, 100, 200).select("id", "start_ms"), d)


@query("page_of_drive", f"{WITH}, {ROWS} SELECT (SELECT count(*) FROM dl d2 WHERE d2.start_ms > d.start_ms OR (d2.start_ms = d.start_ms AND d2.id > d.id)) // 250 * 250 AS page_offset FROM dl d WHERE id = 300002")
def page_of_drive(spark, sf):
    return LI.page_of_drive(rows(spark, sf), 300002)


@query("filter_drives", f"{WITH}, {ROWS}, {TAGGED} SELECT id FROM dl JOIN tg USING ({K}) WHERE lower(trim(t1)) = 'home' AND make_timestamp(start_ms * 256000) >= TIMESTAMP '2024-01-05' AND make_timestamp(start_ms * 256000) < TIMESTAMP '2024-01-21'")
def filter_drives(spark, sf):
    return LI.filter_drives(M.attach_drive_tags(rows(spark, sf), tags(spark, sf)), "HOME ", "2024-01-05", "2024-01-20").select("id")


@query("filter_drives_summon", f"{WITH}, {ROWS} SELECT id FROM dl WHERE drive_id % 7 = 0")
def filter_drives_summon(spark, sf):
    return LI.filter_drives(M.attach_drive_tags(rows(spark, sf), tags(spark, sf)), "summon").select("id")


@query("drives_geojson", f"{WITH} SELECT vehicle_id, drive_id, count(*) AS n FROM pts GROUP BY ALL HAVING count(*) >= 2")
def drives_geojson(spark, sf):
    g = DD.drives_geojson(trip_points(spark, sf))
    n = F.size(F.from_json(F.get_json_object("feature", "$.geometry.coordinates"), "array<array<double>>"))
    return g.select("vehicle_id", "drive_id", n.cast("bigint").alias("n"))


@query("route_round_trip", cte("clips") + " SELECT vehicle_id, seq, concat('a/', CAST(seq AS VARCHAR), '.mp4') AS path, concat(seq % 3, ',', seq % 200) AS gears FROM clips")
def route_round_trip(spark, sf):
    """Clips to wire form and back: byte arrays through base64."""
    fill = {f.name: F.lit(None).cast(f.dataType).alias(f.name) for f in DD.ROUTE.fields}
    fill["file"] = F.concat(F.lit("RecentClips\\a\\"), F.col("seq").cast("string"), F.lit(".mp4")).alias("file")
    fill["gearStates"] = DD.to_base64(F.array((F.col("seq") % 3).cast("int"), (F.col("seq") % 200).cast("int"))).alias("gearStates")
    back = DD.clips_from_routes(clips(spark, sf).select("vehicle_id", "seq", F.struct(*fill.values()).alias("r")))
    return back.select("vehicle_id", "seq", "path", F.array_join(F.transform("gear_states", lambda x: x.cast("string")), ",").alias("gears"))
