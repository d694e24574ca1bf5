"""Queries of joins, merges, removal and tags."""

from __future__ import annotations

from pyspark.sql import functions as F

from tripspark.functions.scalars import round2
from tripspark.operators import imports as I
from tripspark.operators import labels as L
from tripspark.operators import listing as LI
from tripspark.operators import merge as M
from tripspark.operators import sessions
from tripspark.operators import spatial as S
from tripspark.plans.charging_queries import ENDS, PLACED, endpoints
from tripspark.plans.core import DRIVES, clips, trip_points
from tripspark.plans.registry import query
from tripspark.plans.sqltext import r2
from tripspark.plans.testviews import cte, view

WITH = cte("clips") + ", " + DRIVES
K = "vehicle_id, drive_id"
#: Drives per source within a vehicle, so that sources overlap in time.
RANGES = f"""rg AS (SELECT vehicle_id, row_number() OVER (PARTITION BY vehicle_id ORDER BY start_ms, source) AS drive_id, source, start_ms, end_ms, start_ms % 5 = 0 AS summon, concat(source, ':', start_ms // 60000) AS external_signature FROM
 (SELECT vehicle_id, drive_id, source, min(t_ms) AS start_ms, max(end_t_ms) AS end_ms FROM pts GROUP BY ALL))"""


def ranges(spark, sf):
    from pyspark.sql import Window

    g = trip_points(spark, sf).groupBy("vehicle_id", "drive_id", "source").agg(F.min("t_ms").alias("start_ms"), F.max("end_t_ms").alias("end_ms"))
    n = F.row_number().over(Window.partitionBy("vehicle_id").orderBy("start_ms", "source")).cast("bigint")
    return g.withColumns({"drive_id": n, "summon": F.col("start_ms") % 5 == 0, "external_signature": F.expr("concat(source, ':', start_ms div 60000)")})


HIDDEN = "hd AS (SELECT DISTINCT i.vehicle_id, i.drive_id FROM rg i JOIN rg d ON i.vehicle_id = d.vehicle_id AND i.source <> 'sei' AND d.source = 'sei' AND NOT d.summon AND d.end_ms > i.start_ms AND d.start_ms < i.end_ms)"


@query("hide_overlapping_imports", f"{WITH}, {RANGES}, {HIDDEN} SELECT {K}, source FROM rg ANTI JOIN hd USING ({K})")
def hide_overlapping_imports(spark, sf):
    return I.hide_overlapping_imports(ranges(spark, sf)).select("vehicle_id", "drive_id", "source")


@query("hidden_imports", f"{WITH}, {RANGES}, {HIDDEN} SELECT * FROM hd")
def hidden_imports(spark, sf):
    return I.hidden_imports(ranges(spark, sf)).select("vehicle_id", "drive_id")


@query("remove_hidden_imports", f"""{WITH}, {RANGES}, sg AS (SELECT DISTINCT i.vehicle_id, i.external_signature FROM rg i JOIN rg d ON i.vehicle_id = d.vehicle_id AND i.source = 'svc_a' AND d.source = 'sei' AND d.end_ms > i.start_ms AND d.start_ms < i.end_ms),
 cs AS (SELECT vehicle_id, seq, source, CASE WHEN source <> 'sei' THEN concat(source, ':', t_ms // 60000) END AS external_signature FROM clips) SELECT vehicle_id, seq FROM cs WHERE NOT (source = 'svc_a' AND EXISTS (SELECT 1 FROM sg WHERE sg.vehicle_id = cs.vehicle_id AND sg.external_signature = cs.external_signature))""")
def remove_hidden_imports(spark, sf):
    c = clips(spark, sf).withColumn("external_signature", F.expr("CASE WHEN source <> 'sei' THEN concat(source, ':', t_ms div 60000) END"))
    return I.remove_hidden_imports(c, ranges(spark, sf), "svc_a").select("vehicle_id", "seq")


def statuses(spark, sf):
    r = ranges(spark, sf)
    imp = r.where("source <> 'sei'").withColumn("signature", F.col("external_signature"))
    known = r.where("start_ms % 4 = 0").select("vehicle_id", F.col("external_signature").alias("signature"))
    return I.import_status(imp, r.where("source = 'sei'"), known)


STATUS = """st1 AS (SELECT i.vehicle_id, i.drive_id, CASE WHEN EXISTS (SELECT 1 FROM rg k WHERE k.vehicle_id = i.vehicle_id AND k.external_signature = i.external_signature AND k.start_ms % 4 = 0) THEN 'duplicate'
 WHEN EXISTS (SELECT 1 FROM rg d WHERE d.vehicle_id = i.vehicle_id AND d.source = 'sei' AND d.end_ms > i.start_ms // 60000 * 60000 AND d.start_ms < (i.end_ms + 59999) // 60000 * 60000) THEN 'overlap' ELSE 'import' END AS status FROM rg i WHERE source <> 'sei')"""


@query("import_status", f"{WITH}, {RANGES}, {STATUS} SELECT * FROM st1")
def import_status(spark, sf):
    return statuses(spark, sf).select("vehicle_id", "drive_id", "status")


@query("import_preview", f"{WITH}, {RANGES}, {STATUS} SELECT status, count(*) AS n FROM st1 GROUP BY ALL")
def import_preview(spark, sf):
    return I.import_preview(statuses(spark, sf))


def states(spark, sf):
    return clips(spark, sf).select("vehicle_id", "seq", "t_ms", "lat", "lng", F.expr("CASE gear WHEN 1 THEN 'D' WHEN 2 THEN 'R' ELSE 'P' END AS shift"), "speed")


def import_drives(spark, sf):
    """Drives of imported clips: the ends, moved back an hour for every third."""
    p = trip_points(spark, sf).where("source <> 'sei'").withColumn("drive_id", F.col("seq"))
    off = F.when(F.col("seq") % 3 == 0, 3_600_000).otherwise(0)
    return p.select("vehicle_id", "drive_id", (F.col("t_ms") - off).alias("start_ms"), (F.col("end_t_ms") + (F.col("seq") % 7) * 60_000 - off).alias("end_ms"), F.col("lat").alias("start_lat"), F.col("lng").alias("start_lng"),
                    F.when(F.col("seq") % 5 != 0, F.col("lat") + 0.01).alias("end_lat"), F.when(F.col("seq") % 5 != 0, F.col("lng") + 0.01).alias("end_lng"))


IMPORTS = """im AS (SELECT vehicle_id, seq AS drive_id, t_ms - CASE WHEN seq % 3 = 0 THEN 3600000 ELSE 0 END AS start_ms, end_t_ms + (seq % 7) * 60000 - CASE WHEN seq % 3 = 0 THEN 3600000 ELSE 0 END AS end_ms, lat AS start_lat, lng AS start_lng,
 CASE WHEN seq % 5 <> 0 THEN lat + 1e-2 END AS end_lat, CASE WHEN seq % 5 <> 0 THEN lng + 1e-2 END AS end_lng FROM pts WHERE source <> 'sei')"""


@query("calibrate_import_time", f"""{WITH}, {IMPORTS}, b AS (SELECT i.vehicle_id, i.drive_id, c.t_ms AS bt FROM im i JOIN clips c ON c.vehicle_id = i.vehicle_id AND c.gear = 1 AND abs(c.t_ms - i.start_ms) <= 21600000 AND (c.lat - i.start_lat) ** 2 + (c.lng - i.start_lng) ** 2 <= 3e-3 * 3e-3
  QUALIFY row_number() OVER (PARTITION BY i.vehicle_id, i.drive_id ORDER BY abs(c.t_ms - i.start_ms), c.t_ms) = 1) SELECT i.vehicle_id, i.drive_id, start_ms + s AS start_ms, end_ms + s AS end_ms, s AS shift_ms FROM (SELECT im.*, CASE WHEN abs(bt - start_ms) >= 60000 THEN bt - start_ms ELSE 0 END AS s FROM im LEFT JOIN b USING ({K})) i""")
def calibrate_import_time(spark, sf):
    return I.calibrate_import_time(import_drives(spark, sf), states(spark, sf)).select("vehicle_id", "drive_id", "start_ms", "end_ms", "shift_ms")


@query("join_drive_states", f"{WITH}, {IMPORTS} SELECT i.vehicle_id, i.drive_id, c.seq FROM im i JOIN clips c ON c.vehicle_id = i.vehicle_id AND c.gear <> 0 AND c.t_ms BETWEEN i.start_ms - 90000 AND i.end_ms + 90000")
def join_drive_states(spark, sf):
    return I.join_drive_states(import_drives(spark, sf), states(spark, sf)).select("vehicle_id", "drive_id", "seq")


@query("skip_reasons", f"""{WITH}, {IMPORTS}, h AS (SELECT DISTINCT i.vehicle_id, i.drive_id FROM im i JOIN clips c ON c.vehicle_id = i.vehicle_id AND c.gear <> 0 AND c.t_ms BETWEEN i.start_ms - 90000 AND i.end_ms + 90000)
 SELECT 'no-coords' AS reason, count(*) AS n FROM im ANTI JOIN h USING ({K}) WHERE end_lat IS NULL""")
def skip_reasons(spark, sf):
    return I.skip_reasons(import_drives(spark, sf), states(spark, sf))


TAGS = "SELECT vehicle_id, CAST(drive_id AS {S}) AS start_time, drive_id, CASE WHEN drive_id % 3 = 0 THEN 'home' ELSE ' Home' END AS t1, concat('t', CAST(drive_id % 5 AS {S})) AS t2 FROM {d} WHERE drive_id % 4 <> 0"


def tags(spark, sf):
    d = sessions.sessionize_drives(clips(spark, sf)).select("vehicle_id", "drive_id").distinct()
    t = spark.sql(TAGS.replace("{S}", "STRING"), d=d)
    return t.select("vehicle_id", "start_time", F.array("t1", "t2").alias("tags"))


TAGGED = f"dd AS (SELECT DISTINCT {K} FROM drv), tg AS ({TAGS.format(S='VARCHAR', d='dd')})"


@query("attach_drive_tags", f"{WITH}, {TAGGED} SELECT dd.vehicle_id, dd.drive_id, CASE WHEN t1 IS NULL THEN '' ELSE concat(t1, '|', t2) END AS tags FROM dd LEFT JOIN tg USING ({K})")
def attach_drive_tags(spark, sf):
    d = sessions.sessionize_drives(clips(spark, sf)).select("vehicle_id", "drive_id").distinct().withColumn("start_time", F.col("drive_id").cast("string"))
    return M.attach_drive_tags(d, tags(spark, sf)).select("vehicle_id", "drive_id", F.array_join("tags", "|").alias("tags"))


@query("tag_library", f"{WITH}, {TAGGED} SELECT DISTINCT tag FROM (SELECT t1 AS tag FROM tg UNION ALL SELECT t2 FROM tg)")
def tag_library(spark, sf):
    return M.tag_library(tags(spark, sf))


@query("edit_tags", f"""{WITH}, {TAGGED} SELECT vehicle_id, start_time, CASE WHEN drive_id % 3 = 0 THEN concat(t2, '|new') ELSE concat(t1, '|', t2, '|new') END AS tags FROM tg WHERE drive_id % 2 = 1
 UNION ALL SELECT vehicle_id, start_time, CASE WHEN drive_id % 3 = 0 THEN t2 ELSE concat(t1, '|', t2) END FROM tg WHERE drive_id % 2 = 0""")
def edit_tags(spark, sf):
    t = tags(spark, sf)
    edits = t.select("vehicle_id", "start_time", F.when(F.col("start_time").cast("bigint") % 2 == 1, "new").alias("add"), F.lit("home").alias("remove"))
    return M.edit_tags(t, edits).select("vehicle_id", "start_time", F.array_join("tags", "|").alias("tags"))


@query("merge_drive_data", cte("clips") + " SELECT vehicle_id, seq, CASE WHEN seq % 2 = 0 THEN 'a' ELSE 'b' END AS side FROM clips WHERE seq % 2 = 0 OR seq % 3 = 0")
def merge_drive_data(spark, sf):
    c = clips(spark, sf).select("vehicle_id", "seq", F.col("seq").cast("string").alias("path"))
    return M.merge_clips(c.where("seq % 2 = 0").withColumn("side", F.lit("a")), c.where("seq % 3 = 0").withColumn("side", F.lit("b"))).select("vehicle_id", "seq", "side")


@query("merge_preview", cte("clips") + " SELECT count(*) FILTER (WHERE seq % 2 <> 0) AS new, count(*) FILTER (WHERE seq % 2 = 0) AS known FROM clips WHERE seq % 3 = 0")
def merge_preview(spark, sf):
    c = clips(spark, sf).select("vehicle_id", "seq", F.col("seq").cast("string").alias("path"))
    return M.merge_preview(c.where("seq % 2 = 0"), c.where("seq % 3 = 0"))


@query("merge_tags", f"{WITH}, {TAGGED} SELECT vehicle_id, start_time, concat(t1, '|', t2, '|more') AS tags FROM tg")
def merge_tags(spark, sf):
    t = tags(spark, sf)
    other = t.select("vehicle_id", "start_time", F.array(F.get("tags", F.lit(1)), F.lit("more")).alias("tags"))
    return M.merge_tags(t, other).select("vehicle_id", "start_time", F.array_join("tags", "|").alias("tags"))


@query("remove_drives", f"{WITH} SELECT vehicle_id, seq FROM drv WHERE drive_id % 3 <> 0")
def remove_drives(spark, sf):
    d = sessions.sessionize_drives(clips(spark, sf))
    return M.remove_drives(d, d.where("drive_id % 3 = 0").select("vehicle_id", "drive_id").distinct()).select("vehicle_id", "seq")


@query("remove_source", cte("clips") + " SELECT vehicle_id, seq FROM clips WHERE source <> 'svc_a'")
def remove_source(spark, sf):
    return M.remove_source(clips(spark, sf), "svc_a").select("vehicle_id", "seq")


NOW = 1_000_000_000_000
CACHE = "SELECT {K}, CASE WHEN seq % 6 <> 0 THEN concat('c', CAST(seq AS {S})) END AS label, CASE seq % 4 WHEN 0 THEN 'high' WHEN 1 THEN 'medium' WHEN 2 THEN 'miss' ELSE 'low' END AS confidence, CASE WHEN seq % 5 = 0 THEN 'other' ELSE 'main' END AS provider, 1000000000000 - (seq % 400) * 86400000 AS resolved_at, seq FROM {clips}"


@query("fresh_geocodes", cte("clips") + f""", ca AS ({CACHE.format(K='seq AS id', S='VARCHAR', clips='clips')}) SELECT seq FROM ca WHERE provider = 'main' AND resolved_at <= 1000000000000 AND
 1000000000000 - resolved_at < 86400000::BIGINT * CASE WHEN label IS NULL OR confidence = 'miss' THEN 30 WHEN confidence = 'high' THEN 365 WHEN confidence = 'medium' THEN 180 ELSE 90 END""")
def fresh_geocodes(spark, sf):
    c = spark.sql(CACHE.replace("{K}", "seq AS id").replace("{S}", "STRING"), clips=clips(spark, sf))
    return LI.fresh_geocodes(c, "main", NOW).select("seq")


@query("label_endpoints", cte("clips", "places") + f""", {ENDS}, {PLACED}, k AS (SELECT *, printf('%.5f,%.5f', lat, lng) AS ck FROM ends),
 ck AS (SELECT DISTINCT ck FROM k), cache AS (SELECT ck, concat('c', ck) AS l FROM ck WHERE length(ck) % 2 = 0 OR ends_with(ck, '0')), prov AS (SELECT ck, concat('p', ck) AS l FROM ck WHERE NOT ends_with(ck, '5'))
 SELECT k.vehicle_id, k.drive_id, k.which, coalesce(p.label, c.l, v.l) AS label, CASE WHEN p.label IS NOT NULL THEN 'place' WHEN c.l IS NOT NULL THEN 'cache' WHEN v.l IS NOT NULL THEN 'provider' END AS label_source
 FROM k LEFT JOIN placed p USING (vehicle_id, drive_id, which) LEFT JOIN cache c ON c.ck = k.ck LEFT JOIN prov v ON v.ck = k.ck""")
def label_endpoints(spark, sf):
    from tripspark.functions.scalars import coord_key

    e = endpoints(spark, sf)
    key = ("vehicle_id", "drive_id", "which")
    ck = e.select(coord_key(F.col("lat"), F.col("lng")).alias("coord_key")).distinct()
    cache = ck.where((F.length("coord_key") % 2 == 0) | F.col("coord_key").endswith("0")).select("coord_key", F.concat(F.lit("c"), "coord_key").alias("label"), F.lit("high").alias("confidence"), F.lit("main").alias("provider"), F.lit(NOW - 1000).alias("resolved_at"))
    prov = ck.where(~F.col("coord_key").endswith("5")).select("coord_key", F.concat(F.lit("p"), "coord_key").alias("label"))
    out = L.label_endpoints(e, S.match_places(e, view(spark, sf, "places"), key), cache, prov, "main", NOW, key)
    return out.select(*key, "label", "label_source")


#: Provider answers made from clips: point features and areas with an outline round the point or off it.
ANSWERS = """SELECT vehicle_id, seq, lat, lng, CAST(seq % 4 * 12 AS DOUBLE) AS accuracy_m, concat('{"osm_type":"', CASE WHEN seq % 2 = 0 THEN 'node' ELSE 'way' END, '","osm_id":', CAST(seq AS STRING), ',"category":"', CASE seq % 5 WHEN 0 THEN 'amenity' WHEN 1 THEN 'building' WHEN 2 THEN 'highway' WHEN 3 THEN 'place' ELSE 'shop' END,
 '","type":"', CASE WHEN seq % 10 = 0 THEN 'bench' ELSE 'cafe' END, '","name":"', CASE WHEN seq % 3 = 0 THEN '' ELSE concat('N', CAST(seq AS STRING)) END, '","lat":"', CAST(lat + (seq % 7) * 1e-4 AS STRING), '","lon":"', CAST(lng AS STRING),
 '","display_name":"12, High Street, Town","address":{', CASE WHEN seq % 4 <> 3 THEN '"road":"High Street",' ELSE '' END, CASE WHEN seq % 8 < 6 THEN '"house_number":"12",' ELSE '' END, '"city":"Town"},"geojson":{"type":"Polygon","coordinates":[[[', CAST(lng - 1e-3 AS STRING), ',', CAST(lat - 1e-3 AS STRING), '],[', CAST(lng + 1e-3 AS STRING), ',', CAST(lat - 1e-3 AS STRING), '],[',
 CAST(lng + 1e-3 AS STRING), ',', CAST(lat + (CASE WHEN seq % 6 < 3 THEN 1e-3 ELSE -5e-4 END) AS STRING), '],[', CAST(lng - 1e-3 AS STRING), ',', CAST(lat + (CASE WHEN seq % 6 < 3 THEN 1e-3 ELSE -5e-4 END) AS STRING), '],[', CAST(lng - 1e-3 AS STRING), ',', CAST(lat - 1e-3 AS STRING), ']]]}}') AS json FROM clips_"""


def answers(spark, sf):
    return spark.sql(ANSWERS.replace("{", "{{").replace("}", "}}").replace("FROM clips_", "FROM {c}"), c=clips(spark, sf))


LABELS = f"""x AS (SELECT *, seq % 2 = 1 AS area, seq % 5 IN (1, 3) AS addr, seq % 5 IN (0, 4) AND seq % 10 <> 0 AS poi, (seq % 7) * 1e-4 * 111000 AS dm, seq % 6 < 3 AS inn, seq % 3 <> 0 AS named, seq % 4 <> 3 AS road, seq % 8 < 6 AS house, seq % 4 * 12 AS acc FROM clips),
 y AS (SELECT *, named AND (addr OR poi) AND CASE WHEN area THEN inn ELSE dm <= CASE WHEN addr THEN 25 ELSE 30 END END AS bn, road AND house AND CASE WHEN area THEN inn ELSE dm <= 25 END AS bh FROM x),
 z AS (SELECT *, CASE WHEN bn OR bh THEN 'high' WHEN road THEN 'medium' ELSE 'low' END AS c FROM y),
 lb AS (SELECT vehicle_id, seq, CASE WHEN bn THEN concat('N', seq) WHEN bh THEN '12 High Street' WHEN road THEN 'High Street' ELSE 'Town' END AS label,
 CASE WHEN bn THEN CASE WHEN area THEN CASE WHEN seq % 5 = 1 THEN 'building' ELSE 'area' END WHEN addr THEN 'address-point' ELSE 'poi' END WHEN bh THEN CASE WHEN area THEN 'building' ELSE 'address-point' END WHEN road THEN 'road' ELSE 'locality' END AS feature_type,
 CASE WHEN acc <= 15 THEN c WHEN acc > 30 THEN 'low' WHEN c = 'high' THEN 'medium' ELSE 'low' END AS confidence, concat(CASE WHEN area THEN 'way/' ELSE 'node/' END, seq) AS osm_id FROM z)"""


@query("label_match", cte("clips") + f", {LABELS} SELECT * FROM lb")
def label_match(spark, sf):
    return L.label_match(answers(spark, sf)).select("vehicle_id", "seq", "label", "feature_type", "confidence", "osm_id")


@query("city_match", cte("clips") + " SELECT vehicle_id, seq, 'Town' AS label, 'locality' AS feature_type, 'low' AS confidence FROM clips")
def city_match(spark, sf):
    return L.label_match(answers(spark, sf), cities_only=True).select("vehicle_id", "seq", "label", "feature_type", "confidence")


@query("choose_better_match", cte("clips") + f""", {LABELS} SELECT vehicle_id, seq // 4 AS g, label, feature_type, confidence FROM lb
 QUALIFY row_number() OVER (PARTITION BY vehicle_id, seq // 4 ORDER BY CASE confidence WHEN 'high' THEN 1 WHEN 'medium' THEN 2 ELSE 3 END, CASE feature_type WHEN 'poi' THEN 1 WHEN 'building' THEN 2 WHEN 'address-point' THEN 2 WHEN 'area' THEN 3 WHEN 'road' THEN 4 ELSE 5 END, (seq % 7), seq) = 1""")
def choose_better_match(spark, sf):
    m = L.label_match(answers(spark, sf)).withColumns({"g": F.expr("seq div 4"), "rank": F.col("seq")})
    m = m.withColumn("distance_m", (F.col("seq") % 7).cast("double"))
    return L.best_match(m, ("vehicle_id", "g")).select("vehicle_id", "g", "label", "feature_type", "confidence")
