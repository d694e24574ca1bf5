"""Queries of imports to clips, repair, summon, endpoints, headings, provider records."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tripspark.functions import provider as PR
from tripspark.functions import runs as R
from tripspark.functions.scalars import round2
from tripspark.operators import endpoints as E
from tripspark.operators import imports as I
from tripspark.operators import repair as RE
from tripspark.operators import summon as SU
from tripspark.plans.core import DRIVES, clips, run_clips, trip_points
from tripspark.plans.join_queries import IMPORTS, import_drives
from tripspark.plans.registry import query
from tripspark.plans.sqltext import geo, jr, r2
from tripspark.plans.testviews import DUCK, SPARK, cte

WITH = cte("clips") + ", " + DRIVES
K = "vehicle_id, drive_id"

FILLED = f"""im2 AS (SELECT {K}, min(t_ms) AS start_ms, max(end_t_ms) AS end_ms, arg_min(lat, idx) AS start_lat, arg_min(lng, idx) AS start_lng, arg_max(lat, idx) AS end_lat, arg_max(lng, idx) AS end_lng FROM pts GROUP BY ALL),
 an AS (SELECT {K}, t_ms::DOUBLE AS t, lat, lng, speed FROM pts UNION ALL SELECT {K}, start_ms, start_lat, start_lng, 0e0 FROM im2 UNION ALL SELECT {K}, end_ms, end_lat, end_lng, 0e0 FROM im2),
 nx AS (SELECT *, lead(t) OVER w AS nt, lead(lat) OVER w AS nla, lead(lng) OVER w AS nln FROM an WINDOW w AS (PARTITION BY {K} ORDER BY t, lat, lng)),
 fl AS (SELECT {K}, t, lat, lng, speed FROM an UNION ALL SELECT {K}, m * 6e4 + 3e4, lat + (nla - lat) * ((m * 6e4 + 3e4 - t) / (nt - t)), lng + (nln - lng) * ((m * 6e4 + 3e4 - t) / (nt - t)), 0e0 FROM nx, LATERAL (SELECT unnest(range(CAST(floor(t / 6e4) AS BIGINT) + 1, CAST(floor(nt / 6e4) AS BIGINT))) AS m) WHERE nt IS NOT NULL)"""


def drive_ends(spark, sf):
    p = trip_points(spark, sf)
    at = lambda f, c: f(c, "idx")
    return p.groupBy("vehicle_id", "drive_id").agg(F.min("t_ms").alias("start_ms"), F.max("end_t_ms").alias("end_ms"), at(F.min_by, "lat").alias("start_lat"), at(F.min_by, "lng").alias("start_lng"), at(F.max_by, "lat").alias("end_lat"), at(F.max_by, "lng").alias("end_lng"))


def filled(spark, sf):
    return I.fill_minute_gaps(trip_points(spark, sf), drive_ends(spark, sf))


@query("fill_minute_gaps", f"{WITH}, {FILLED} SELECT {K}, t AS t_ms, {r2('lat * 1e4')} AS lat, {r2('lng * 1e4')} AS lng FROM fl")
def fill_minute_gaps(spark, sf):
    return filled(spark, sf).select("vehicle_id", "drive_id", "t_ms", round2(F.col("lat") * 1e4).alias("lat"), round2(F.col("lng") * 1e4).alias("lng"))


def _clip_sql(table: str, extra: str = "") -> str:
    return f"""SELECT {K}, m * 60000 AS t_ms, concat('svc/', strftime(make_timestamp(m * 60000000), '%Y-%m-%d'), '/', strftime(make_timestamp(m * 60000000), '%Y-%m-%d_%H-%M-%S'), '-front-svc-', sx, '.mp4') AS file, count(*) AS frame_count, {r2('sum(greatest(speed, 0))')} AS speeds
 FROM (SELECT *, CAST(floor(t / 6e4) AS BIGINT) AS m FROM {table}) GROUP BY ALL"""


def _clip_view(out):
    total = F.aggregate("speeds", F.lit(0.0), lambda a, x: a + x)
    return out.select("vehicle_id", "drive_id", "t_ms", "file", "frame_count", round2(total).alias("speeds"))


@query("minute_clips", f"{WITH}, {FILLED}, sg AS (SELECT *, concat(CAST(drive_id AS VARCHAR), 'x') AS sx FROM fl) " + _clip_sql("sg"))
def minute_clips(spark, sf):
    p = filled(spark, sf).withColumn("signature", F.concat(F.lit("svc:"), F.col("drive_id").cast("string"), F.lit(":x")))
    return _clip_view(I.minute_clips(p, "svc"))


@query("api_drive_clips", f"""{WITH}, {IMPORTS}, ap AS (SELECT vehicle_id, seq AS drive_id, (t_ms + i * 20000) / 1e3 AS t, lat, lng, 30e0 AS mph FROM pts, LATERAL (SELECT unnest(range(seq % 3)) AS i) WHERE source <> 'sei'),
 e AS (SELECT {K} FROM ap GROUP BY ALL HAVING count(*) >= 2), few AS (SELECT * FROM im ANTI JOIN e USING ({K}) WHERE end_lat IS NOT NULL), us AS (SELECT {K} FROM e UNION ALL SELECT {K} FROM few),
 al AS (SELECT {K}, t * 1e3 AS t, mph * 44704e-5 AS speed FROM ap UNION ALL SELECT {K}, start_ms, 0e0 FROM few UNION ALL SELECT {K}, end_ms, 0e0 FROM few),
 sg AS (SELECT al.*, concat(CAST(im.start_ms // 60000 AS VARCHAR), '1250') AS sx FROM al SEMI JOIN us USING ({K}) JOIN im USING ({K})) """ + _clip_sql("sg"))
def api_drive_clips(spark, sf):
    i = F.explode(F.when(F.col("seq") % 3 > 0, F.sequence(F.lit(0), (F.col("seq") % 3 - 1).cast("int"))).otherwise(F.array().cast("array<int>")))
    p = trip_points(spark, sf).where("source <> 'sei'").withColumn("i", i).select("vehicle_id", F.col("seq").alias("drive_id"), ((F.col("t_ms") + F.col("i") * 20000) / 1000.0).alias("t"), "lat", "lng", F.lit(30.0).alias("speed_mph"))
    return _clip_view(I.api_drive_clips(p, import_drives(spark, sf).withColumn("odometer_text", F.lit("12.50")), "svc"))


def gap_rows(spark, sf):
    return clips(spark, sf).select("vehicle_id", "seq", "t_ms", F.expr("cast(t_ms div 100000000 as string) AS date"), F.col("lat").alias("first_lat"), F.col("lng").alias("first_lng"), F.col("lat").alias("last_lat"), F.col("lng").alias("last_lng"), F.col("gear").alias("first_gear"), F.col("gear").alias("last_gear"))


GAPS = """nx AS (SELECT *, lead(t_ms) OVER w AS nt, lead(lat) OVER w AS nla, lead(lng) OVER w AS nln, lead(gear) OVER w AS ng FROM clips WINDOW w AS (PARTITION BY vehicle_id ORDER BY t_ms, seq)),
 gp AS (SELECT vehicle_id, seq, t_ms + 60000 AS cur_end, nt - t_ms - 60000 AS gap_ms, gear, lat, lng, nla, nln FROM nx WHERE nt - t_ms - 60000 > 60000 AND nt - t_ms - 60000 <= 300000 AND gear <> 0 AND ng <> 0 AND nt // 100000000 = t_ms // 100000000)"""


@query("find_recording_gaps", cte("clips") + f", {GAPS} SELECT vehicle_id, seq, cur_end, gap_ms, gear FROM gp")
def find_recording_gaps(spark, sf):
    return RE.find_recording_gaps(gap_rows(spark, sf)).select("vehicle_id", "seq", "cur_end", "gap_ms", "gear")


@query("bridge_gaps", cte("clips") + f""", {GAPS}, b AS (SELECT *, greatest({jr('gap_ms / 1e3')}, 2) AS n FROM gp) SELECT vehicle_id, cur_end AS t_ms, concat(d, '/', d, '_', strftime(make_timestamp(cur_end * 1000), '%H-%M-%S'), '-front-bridge.mp4') AS file, CAST(n - 1 AS BIGINT) AS n_points,
 {r2('(lat + (nla - lat) * (floor(n / 2) / n)) * 1e4')} AS mid_lat, {r2(geo('lat', 'lng', 'nla', 'nln') + ' / (gap_ms / 1e3)')} AS speed FROM (SELECT *, CAST((cur_end - 60000) // 100000000 AS VARCHAR) AS d FROM b)""")
def bridge_gaps(spark, sf):
    b = RE.bridge_gaps(RE.find_recording_gaps(gap_rows(spark, sf)))
    n = F.size("points")
    mid = F.col("points")[F.floor((n + 1) / 2).cast("int") - 1][0]
    return b.select("vehicle_id", "t_ms", "file", n.cast("bigint").alias("n_points"), round2(mid * 1e4).alias("mid_lat"), round2(F.col("speeds")[0]).alias("speed"))


@query("summon_candidates", f"""{WITH}, d AS (SELECT *, seq % 3 <> 0 AS slow, count(*) OVER (PARTITION BY {K}) AS n, row_number() OVER (PARTITION BY {K} ORDER BY t_ms, seq) AS a, row_number() OVER (PARTITION BY {K} ORDER BY t_ms DESC, seq DESC) AS z FROM drv),
 f AS (SELECT {K}, coalesce(min(CASE WHEN NOT slow THEN a END), 1000000) AS fa, coalesce(min(CASE WHEN NOT slow THEN z END), 1000000) AS fz FROM d GROUP BY ALL)
 SELECT vehicle_id, CAST(seq AS VARCHAR) AS path FROM d JOIN f USING ({K}) WHERE seq % 5 <> 0 AND (drive_id % 2 = 0 OR (a <= 10 AND (a < fa OR (a = fa AND a > 1))) OR (z <= 10 AND (z < fz OR (z = fz AND z > 1))))""")
def summon_candidates(spark, sf):
    from tripspark.operators import sessions

    c = sessions.sessionize_drives(clips(spark, sf)).select("vehicle_id", "drive_id", "t_ms", "seq", F.col("seq").cast("string").alias("path"), (F.col("seq") % 3 != 0).alias("slow"), (F.col("seq") % 5 == 0).alias("has_evidence"))
    d = c.select("vehicle_id", "drive_id").distinct().select("*", F.lit("sei").alias("source"), F.lit(False).alias("summon"), F.when(F.col("drive_id") % 2 == 0, 5.0).otherwise(50.0).alias("max_speed_mph"), F.lit(1000).alias("duration_ms"))
    return RE.summon_candidates(c, d)


#: Evidence of a clip: three flag, mode and gear runs of 30, 30 and 40 frames by arithmetic.
def evidence(spark, sf):
    from tripspark.operators import sessions

    c = sessions.sessionize_drives(clips(spark, sf))
    s = F.col("seq")
    run = lambda fields: F.array(*(F.struct(F.lit(float(n)).alias("frames"), *(f(k).alias(name) for name, f in fields.items())) for k, n in enumerate((30, 30, 40))))
    flags = lambda k: F.when(s % 7 == 0, 4 if k == 1 else 0).when(s % 2 == 0, 3 if k != 1 else 0).otherwise(0).cast("bigint")
    mps = lambda k: F.when(s % 11 == 0, 9.0).otherwise(1.0 + k)
    ap = lambda k: F.when(s % 13 == 0, 2).otherwise(1 if k == 1 else F.when(s % 3 == 0, 0).otherwise(1)).cast("bigint")
    gear = lambda k: F.when(F.lit(k) == 1, 1).otherwise(F.when(s % 5 == 0, 1).otherwise(0)).cast("bigint")
    return c.select("vehicle_id", "drive_id", "seq", run({"flags": flags, "max_mps": mps}).alias("flag_runs"), run({"ap": ap}).alias("ap_runs"), run({"gear": gear}).alias("gear_runs"),
                    F.lit(0.0).alias("start_frame"), F.lit(100.0).alias("end_frame"), F.lit(100.0).alias("total_frames"), F.col("t_ms").cast("double").alias("start_ms"), (F.col("t_ms") + 60000).cast("double").alias("end_ms"))


@query("summon_drives", f"""{WITH}, u AS (SELECT *, max(t_ms + 60000) OVER (PARTITION BY {K} ORDER BY t_ms, seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS pe FROM drv),
 g AS (SELECT {K}, max(t_ms) + 60000 - min(t_ms) AS dur, sum(t_ms + 60000 - greatest(t_ms, coalesce(pe, t_ms))) AS cov, bool_or(seq % 11 = 0) AS fast, bool_or(seq % 7 = 0) AS pedal,
  arg_min(seq, t_ms * 1000000 + seq) AS s0, arg_max(seq, t_ms * 1000000 + seq) AS s1, bool_or(seq % 13 = 0) AS oth, sum(CASE WHEN seq % 3 = 0 THEN 30 ELSE 100 END) AS fsd, count(*) * 100 AS tot FROM u GROUP BY ALL)
 SELECT {K}, CASE WHEN dur > 600000 OR dur - cov > 30000 OR fast OR pedal THEN false WHEN s0 % 2 = 0 AND s1 % 2 = 0 THEN true WHEN s0 % 5 = 0 OR s1 % 5 = 0 OR oth THEN false ELSE fsd >= tot * 5e-1 END AS summon FROM g""")
def summon_drives(spark, sf):
    ev = evidence(spark, sf)
    d = ev.groupBy("vehicle_id", "drive_id").agg((F.max("end_ms") - F.min("start_ms")).cast("bigint").alias("duration_ms")).withColumns({"max_speed_mps": F.lit(4.0), "has_speeds": F.lit(True)})
    return SU.summon_drives(ev, d)


@query("run_lookups", cte("runs") + f""", e AS (SELECT *, sum(frames) OVER (PARTITION BY vehicle_id, seq ORDER BY k) AS ef FROM runs), s AS (SELECT *, ef - frames AS sf FROM e)
 SELECT vehicle_id, seq, CAST(arg_min(gear, k) FILTER (WHERE ef > 20) AS BIGINT) AS gear_at_20, CAST(max(CASE WHEN ef > 5 AND sf < 25 THEN gear ELSE 0 END) AS BIGINT) AS top, bool_or(ef > 5 AND sf < 25 AND (gear & 2) <> 0) AS flagged,
 CAST(sum(CASE WHEN gear = 1 AND ef > 5 AND sf < 25 THEN least(ef, 25) - greatest(sf, 5) ELSE 0 END) AS BIGINT) AS fsd FROM s GROUP BY ALL""")
def run_lookups(spark, sf):
    """gear_at_frame, segment_max_speed, flag_overlap and segment_ap_frames over the five runs of a clip."""
    sp = R.spans(F.col("gear_runs"), "gear")
    c = run_clips(spark, sf).withColumn("sp", sp)
    a, b = F.lit(5.0), F.lit(25.0)
    return c.select("vehicle_id", "seq", R.value_at_frame(F.col("sp"), F.lit(20.0)).cast("bigint").alias("gear_at_20"), R.segment_max_speed(F.col("sp"), a, b).cast("bigint").alias("top"),
                    R.flag_overlap(F.col("sp"), a, b, 2).alias("flagged"), F.coalesce(R.segment_ap_frames(F.col("sp"), a, b)["fsd"], F.lit(0.0)).cast("bigint").alias("fsd"))


@query("runs_span_frames", cte("runs") + " SELECT vehicle_id, seq, seq % 2 = 0 AS whole FROM runs GROUP BY ALL")
def runs_span_frames(spark, sf):
    c = run_clips(spark, sf)
    total = F.aggregate("gear_runs", F.lit(0.0), lambda a, r: a + r["frames"])
    return c.select("vehicle_id", "seq", R.runs_span_frames(F.col("gear_runs"), total + F.when(F.col("seq") % 2 == 0, 0.0).otherwise(1.0)).alias("whole"))


def fine_points(spark, sf):
    """A second-by-second track from each clip: slow, so that ends have clusters."""
    i = spark.range(40).withColumnRenamed("id", "i")
    c = clips(spark, sf).crossJoin(F.broadcast(i))  # 40 fixed rows
    e = F.expr
    return c.select("vehicle_id", F.col("seq").alias("drive_id"), F.col("i").alias("idx"), (F.col("t_ms") + F.col("i") * 1000).alias("t_ms"), e("lat + (CASE WHEN i BETWEEN 10 AND 30 THEN i - 10 WHEN i > 30 THEN 20 ELSE 0 END) * 5e-5 + (i * 7 % 3) * 1e-6 AS lat"), "lng",
                    e("CASE WHEN i BETWEEN 10 AND 30 THEN 5e0 ELSE 0e0 END AS speed"), e("CASE WHEN seq % 2 = 0 THEN CASE WHEN i < 8 OR i > 32 THEN 0 ELSE 1 END END AS gear"))


FINE = """fine AS (SELECT vehicle_id, seq AS drive_id, i AS idx, t_ms + i * 1000 AS t_ms, lat + (CASE WHEN i BETWEEN 10 AND 30 THEN i - 10 WHEN i > 30 THEN 20 ELSE 0 END) * 5e-5 + (i * 7 % 3) * 1e-6 AS lat, lng, CASE WHEN i BETWEEN 10 AND 30 THEN 5e0 ELSE 0e0 END AS speed FROM clips, (SELECT unnest(range(40)) AS i))"""


@query("endpoint_snap", cte("clips") + f""", {FINE}, w AS (SELECT *, 'start' AS which, idx AS k FROM fine WHERE idx <= 30 UNION ALL SELECT *, 'end', 39 - idx FROM fine WHERE idx >= 9),
 sm AS (SELECT * FROM w WHERE speed = 0), sd AS (SELECT {K}, which, k, lat, lng FROM sm WHERE k < 3),
 pr AS (SELECT d.vehicle_id, d.drive_id, d.which, d.k AS sk, p.k, p.lat, p.lng, p.t_ms FROM sd d JOIN sm p USING ({K}, which) WHERE {geo('d.lat', 'd.lng', 'p.lat', 'p.lng')} <= 15),
 sz AS (SELECT {K}, which, sk, count(*) AS n FROM pr GROUP BY vehicle_id, drive_id, which, sk HAVING count(*) >= 3 AND max(t_ms) - min(t_ms) >= 2000 QUALIFY row_number() OVER (PARTITION BY {K}, which ORDER BY count(*) DESC, sk) = 1),
 cl AS (SELECT pr.* FROM pr JOIN sz USING ({K}, which, sk)), ds AS (SELECT a.vehicle_id, a.drive_id, a.which, a.k, {geo('a.lat', 'a.lng', 'b.lat', 'b.lng')} AS d FROM cl a JOIN cl b USING ({K}, which)),
 md AS (SELECT {K}, which, k, count(*) AS n, list_sort(list(d))[CAST(ceil(count(*) * 9e-1) AS BIGINT)] AS p90 FROM ds GROUP BY ALL)
 SELECT DISTINCT {K}, which, n AS samples, true AS stationary FROM md""")
def endpoint_snap(spark, sf):
    return E.endpoint_snap(fine_points(spark, sf)).select("vehicle_id", "drive_id", "which", "samples", "stationary")


@query("smooth_heading")
def smooth_heading(spark, sf):
    return E.smooth_heading(trip_points(spark, sf)).select("vehicle_id", "drive_id", "idx", round2(F.col("heading")).alias("heading"))


RECORDS = """SELECT vehicle_id, seq, concat('{"', CASE seq % 3 WHEN 0 THEN 'started_at' WHEN 1 THEN 'Start_Time' ELSE 'created_at' END, '":', CASE WHEN seq % 2 = 0 THEN CAST(t_ms div 1000 AS STRING) ELSE concat('"', date_format(timestamp_millis(t_ms), "yyyy-MM-dd'T'HH:mm:ss"), 'Z"') END,
 CASE WHEN seq % 4 = 0 THEN ',"duration":"90 s"' ELSE concat(',"end":', CAST(t_ms div 1000 + 60 AS STRING)) END, ',"distance":"', CAST(seq % 50 AS STRING), '.5 mi",', CASE WHEN seq % 5 = 0 THEN '"self_driving_miles_start":10,"self_driving_miles_end":14' ELSE '"fsd_distance":2.25' END,
 ',"start_lat":', CAST(lat AS STRING), ',"points":[{"lat":1.5,"lon":2.5,"time":1000,"speed":"30","state":"Active"},[1.25,2.25,1001,12]]}') AS json FROM clips_"""


def records(spark, sf):
    return spark.sql(RECORDS.replace("{", "{{").replace("}", "}}").replace("FROM clips_", "FROM {c}"), c=clips(spark, sf))


@query("provider_drives_normalized", cte("clips") + f""" SELECT vehicle_id, seq, CAST(t_ms // 1000 * 1000 AS DOUBLE) AS start_ms, CAST(t_ms // 1000 * 1000 + CASE WHEN seq % 4 = 0 THEN 90000 ELSE 60000 END AS DOUBLE) AS end_ms, seq % 50 + 5e-1 AS distance_mi, CASE WHEN seq % 5 = 0 THEN 4e0 ELSE 225e-2 END AS assisted_mi, {r2('lat * 1e3')} AS start_lat FROM clips""")
def provider_drives_normalized(spark, sf):
    out = PR.provider_drives_normalized(records(spark, sf))
    return out.select("vehicle_id", "seq", "start_ms", "end_ms", "distance_mi", "assisted_mi", round2(F.col("start_lat") * 1e3).alias("start_lat"))


@query("provider_points", cte("clips") + " SELECT vehicle_id, seq, i, CASE i WHEN 0 THEN 1.5e0 ELSE 1.25e0 END AS lat, CASE i WHEN 0 THEN 1e6 ELSE 1001e3 END AS t, CASE i WHEN 0 THEN 30e0 ELSE 12e0 END AS speed_mph, 1 - i AS ap FROM clips, (SELECT unnest(range(2)) AS i)")
def provider_points(spark, sf):
    out = PR.provider_points(PR.provider_drives_normalized(records(spark, sf)), ("vehicle_id", "seq"))
    return out.select("vehicle_id", "seq", F.col("i").cast("bigint").alias("i"), "lat", "t", "speed_mph", F.col("ap").cast("bigint").alias("ap"))


#: Path responses: by seq a list of points, an object with one of two names, or a flat list of points.
POINT_TEXT = "concat('{\"latitude\":', CAST(seq % 90 AS STRING), '.5,\"lon\":', CAST(seq % 7 + {0} AS STRING), ',\"time\":', CAST(t_ms div 1000 + {0} AS STRING), ',\"autopilot\":\"', CASE WHEN seq % 2 = {0} THEN 'Active' ELSE 'Standby' END, '\"}')"
BODIES = f"""SELECT vehicle_id, seq, concat('{{"results":[', CASE seq % 5 WHEN 0 THEN concat('[', a, ',', b, '],{{"path":[', b, ']}}') WHEN 1 THEN concat('{{"points":[', a, ']}},{{"path":null,"points":[', b, ']}}') WHEN 2 THEN concat(a, ',', b) WHEN 3 THEN '{{"latitude":null}}' ELSE concat('7,null,[', a, ']') END, ']}}') AS body
 FROM (SELECT vehicle_id, seq, {POINT_TEXT.replace('{0}', '0')} AS a, {POINT_TEXT.replace('{0}', '1')} AS b FROM clips_)"""


def bodies(spark, sf):
    return spark.sql(BODIES.replace("{", "{{").replace("}", "}}").replace("FROM clips_", "FROM {c}"), c=clips(spark, sf))


@query("response_paths", cte("clips") + """, w AS (SELECT vehicle_id, seq, t_ms, unnest(CASE seq % 5 WHEN 0 THEN [[0, 0, 0], [0, 1, 1], [1, 0, 1]] WHEN 1 THEN [[0, 0, 0], [1, 0, 1]] WHEN 2 THEN [[0, 0, 0], [0, 1, 1]] WHEN 4 THEN [[0, 0, 0]] END) AS x FROM clips)
 SELECT vehicle_id, seq, CAST(x[1] AS BIGINT) AS path_no, CAST(x[2] AS BIGINT) AS i, seq % 90 + 5e-1 AS lat, CAST(seq % 7 + x[3] AS DOUBLE) AS lng, CAST((t_ms // 1000 + x[3]) * 1000 AS DOUBLE) AS t, CAST(CASE WHEN seq % 2 = x[3] THEN 1 ELSE 0 END AS BIGINT) AS ap FROM w""")
def response_paths(spark, sf):
    """Responses to drives' paths, and the points of each."""
    out = PR.provider_points(PR.response_paths(bodies(spark, sf)), ("vehicle_id", "seq", "path_no"))
    return out.select("vehicle_id", "seq", F.col("path_no").cast("bigint").alias("path_no"), F.col("i").cast("bigint").alias("i"), "lat", "lng", "t", F.col("ap").cast("bigint").alias("ap"))


@query("response_records", cte("clips") + f""" SELECT vehicle_id, seq, r AS record_no, CAST(t_ms // 1000 * 1000 AS DOUBLE) AS start_ms, seq % 50 + 5e-1 AS distance_mi FROM clips, (SELECT unnest(range(2)) AS r) WHERE seq % 3 <> 0 OR r = 0""")
def response_records(spark, sf):
    """Lists of drive records, and their drives."""
    both = F.concat(F.lit('{"results":['), "json", F.when(F.col("seq") % 3 != 0, F.concat(F.lit(","), "json")).otherwise(F.lit("")), F.lit("]}"))
    out = PR.provider_drives_normalized(PR.response_records(records(spark, sf).select("vehicle_id", "seq", both.alias("body"))))
    return out.select("vehicle_id", "seq", F.col("record_no").cast("bigint").alias("record_no"), "start_ms", "distance_mi")


DATES = "concat('d/', substr({F}, 1, 8), lpad(CAST(1 + seq % 33 AS {S}), 2, '0'), substr({F}, 11, 9), '/x.mp4')"


@query("repair_times", cte("clips") + f""", f AS (SELECT seq, {DATES.replace('{F}', DUCK['FMT'].format('t_ms')).replace('{S}', 'VARCHAR')} AS file FROM clips)
 SELECT seq, CASE WHEN seq % 33 < 31 THEN epoch_ms(CAST(concat(substr(file, 3, 8), '01') AS TIMESTAMP) + to_days(CAST(seq % 33 AS INTEGER)) + CAST(replace(substr(file, 14, 8), '-', ':') AS INTERVAL)) END AS t_ms FROM f""")
def repair_times(spark, sf):
    """Times of folders in which the day is any number up to 33."""
    file = DATES.replace("{F}", SPARK["FMT"].format("t_ms")).replace("{S}", "STRING")
    return RE.repair_times(clips(spark, sf).select("seq", F.expr(file).alias("file"))).select("seq", "t_ms")
