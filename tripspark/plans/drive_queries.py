"""The main flow from clips with points, runs, event files, pedals, telemetry and imports to drives."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tripspark.operators import drives as D, incremental, scans
from tripspark.operators.regions import shared_folder
from tripspark.operators.stats import MODES
from tripspark.plans.core import SEGS, clips, run_clips
from tripspark.plans.registry import query
from tripspark.plans.sqltext import DRIVES, gaps, geo, jr, pct, r2
from tripspark.plans.testviews import cte

#: Point i of a clip, the same text in both dialects; a clip's points lie within some 300 m of its car's place.
LAT, LNG = "37e0 + (vehicle_id % 40) * 5e-2 + ((seq * 13 + i * 7) % 29) * 1e-4", "-122e0 + (vehicle_id % 40) * 5e-2 + ((seq * 5 + i * 3) % 31) * 1e-4"
AP, SPEED, GEAR, PEDAL = "((seq + i) div 3) % 4", "((seq * 3 + i) % 11) * 2e0", "CASE WHEN (seq + i) % 7 = 0 THEN 0 ELSE 1 END", "CASE WHEN (seq + i) % 3 = 0 THEN 0e0 ELSE 3e-1 END"
SIGNATURE = "CASE WHEN source = 'svc_a' THEN 'a' END"
#: Clips of an event folder, cars without gear runs, and their share of parked frames.
EVENT, BY_RUNS = "seq % 9 = 0 AND seq % 4 <> 0 AND n_points >= 2", "vehicle_id % 3 <> 0"
PATH = f"CASE WHEN {EVENT} THEN concat('SavedClips/', CAST(seq AS {{0}})) ELSE CAST(seq AS {{0}}) END"
BATTERY, BATTERY_END, OUTSIDE, PLACE = "CASE WHEN seq % 3 <> 0 THEN seq % 97 * 1e0 END", "CASE WHEN seq % 4 <> 0 THEN seq % 89 * 1e0 END", "CASE WHEN seq % 5 <> 0 THEN seq % 29 * 1e0 END", "CASE WHEN seq % 4 = 0 THEN concat('a', CAST(seq % 9 AS {0})) END"


def point_clips(spark: SparkSession, sf: str) -> DataFrame:
    """Clips as a store holds them: arrays of points and states, every third one twice under the same path."""
    rows = run_clips(spark, sf)
    each = lambda text: F.expr(f"transform(sequence(0, cast(n_points AS int) - 1, 1), i -> {text})")
    some = lambda text, kind: F.when(F.col("n_points") > 0, each(text)).otherwise(F.array()).cast(kind)
    rows = rows.select(
        "vehicle_id", "seq", F.expr(PATH.format("STRING")).alias("path"), F.expr(EVENT).alias("is_event"), "t_ms", "source", F.expr(SIGNATURE).alias("external_signature"), F.expr(f"CASE WHEN {BY_RUNS} THEN gear_runs END").alias("gear_runs"),
        some(f"array({LAT}, {LNG})", "array<array<double>>").alias("points"), some(GEAR, "array<int>").alias("gear_states"), some(AP, "array<int>").alias("ap_states"), some(SPEED, "array<double>").alias("speeds"), some(PEDAL, "array<double>").alias("accel_positions"),
        (F.col("seq") % 11).cast("double").alias("raw_park_count"), F.expr("CASE WHEN seq % 4 <> 0 THEN 10e0 END").alias("raw_frame_count"),
        F.struct(*(F.expr({"batteryPctStart": BATTERY, "batteryPctEnd": BATTERY_END, "exteriorTempAvg": OUTSIDE, "locationNameStart": PLACE.format("STRING")}.get(v, "NULL")).cast("string" if k.startswith("location") else "double").alias(v) for k, v in D.TELEMETRY.items())).alias("telemetry"))
    again = rows.where("seq % 3 = 0").withColumn("seq", F.col("seq") + 1_000_000_000)
    return rows.unionByName(again)


TAGS = "SELECT vehicle_id, {0} AS start_time, concat('t', min(seq % 3)) AS tag FROM {1} WHERE seq % 5 < 3 GROUP BY 1, 2"
LOCAL = "strftime(epoch_ms(CAST({0} AS BIGINT)), '%Y-%m-%dT%H:%M:%S')"
KEYS = "vehicle_id, drive_id"
_MODE_SUMS = ", ".join(f"coalesce(sum(CASE WHEN ap = {k} THEN dt END), 0) AS {n}_t, coalesce(sum(CASE WHEN ap = {k} THEN d END), 0) AS {n}_m" for n, k in MODES.items())
_MODES = ", ".join(f"coalesce(CAST({jr(f'{n}_t')} AS BIGINT), 0) AS {n}_engaged_ms, coalesce({r2(f'{n}_m / 1e3')}, 0) AS {n}_distance_km, coalesce({r2(f'{n}_m / 1609.344e0')}, 0) AS {n}_distance_mi, coalesce({pct(f'{n}_m', 'm')}, 0) AS {n}_percent" for n in MODES)
_FIRST = lambda c, f: f"{f}({c}, k) FILTER (WHERE {c} IS NOT NULL)"
SQL = "WITH RECURSIVE " + cte("clips", "runs")[5:] + f""",
 sl AS (SELECT vehicle_id, seq, t_ms, source, {SIGNATURE} AS sig, n_points, {EVENT} AS ev, {PATH.format('VARCHAR')} AS path FROM clips JOIN (SELECT DISTINCT vehicle_id, seq, n_points FROM runs) USING (vehicle_id, seq)),
 rc AS (SELECT vehicle_id, t_ms, seq FROM sl WHERE NOT ev),
 fr AS (SELECT e.vehicle_id, e.t_ms, e.seq, e.path FROM sl e WHERE ev AND NOT EXISTS (SELECT 1 FROM rc WHERE rc.vehicle_id = e.vehicle_id AND rc.t_ms <= e.t_ms AND e.t_ms - rc.t_ms <= 30000)),
 o AS (SELECT *, row_number() OVER (PARTITION BY vehicle_id ORDER BY t_ms, path, seq) AS k FROM fr),
 th AS (SELECT vehicle_id, k, t_ms, path, seq, true AS keep, t_ms AS lastk FROM o WHERE k = 1
   UNION ALL SELECT o.vehicle_id, o.k, o.t_ms, o.path, o.seq, o.t_ms - th.lastk > 30000, CASE WHEN o.t_ms - th.lastk > 30000 THEN o.t_ms ELSE th.lastk END FROM th JOIN o ON o.vehicle_id = th.vehicle_id AND o.k = th.k + 1),
 kk AS (SELECT vehicle_id, t_ms, seq FROM th WHERE keep),
 b AS (SELECT kk.*, (SELECT max(t_ms) FROM rc WHERE rc.vehicle_id = kk.vehicle_id AND rc.t_ms <= kk.t_ms) AS p, (SELECT min(t_ms) FROM rc WHERE rc.vehicle_id = kk.vehicle_id AND rc.t_ms >= kk.t_ms) AS n FROM kk),
 al AS (SELECT vehicle_id, t_ms, seq, 0 AS c FROM rc UNION ALL SELECT vehicle_id, t_ms, seq, 1 FROM kk),
 isl AS (SELECT *, sum(x) OVER (PARTITION BY vehicle_id ORDER BY t_ms, seq) AS i FROM (SELECT *, CASE WHEN coalesce(t_ms - lag(t_ms) OVER (PARTITION BY vehicle_id ORDER BY t_ms, seq) > 180000, true) THEN 1 ELSE 0 END AS x FROM al)),
 hs AS (SELECT vehicle_id, seq, c, min(c) OVER (PARTITION BY vehicle_id, i) AS m FROM isl),
 fill AS (SELECT vehicle_id, seq FROM rc UNION ALL SELECT b.vehicle_id, b.seq FROM b JOIN hs ON hs.vehicle_id = b.vehicle_id AND hs.seq = b.seq AND hs.c = 1
  WHERE (p < t_ms AND t_ms < n AND n - p > 90000 AND n - p <= 1800000) OR (m = 0 AND least(coalesce(t_ms - p, 1e18), coalesce(n - t_ms, 1e18)) <= 1800000)),
 cl AS (SELECT sl.* FROM sl JOIN fill USING (vehicle_id, seq)), {DRIVES.split("pts AS")[0].rstrip().rstrip(",").replace("clips", "cl")},
 rn AS (SELECT runs.* FROM runs JOIN cl USING (vehicle_id, seq) WHERE {BY_RUNS}), {SEGS.replace("FROM runs", "FROM rn")},
 lp AS (SELECT *, (CASE WHEN seq % 4 <> 0 THEN (seq % 11) / 1e1 > 5e-1 ELSE len(list_filter(range(n_points), lambda i: (seq + i) % 7 = 0)) > n_points / 2e0 END) AND max(n_points) OVER d > 0 AND count(*) OVER d > 1 AS parked
   FROM spans WHERE NOT ({BY_RUNS}) WINDOW d AS (PARTITION BY {KEYS})),
 j AS (SELECT segs.vehicle_id, segs.seq, segs.t_ms, seg_no, segs.parked, start_idx, end_idx, seg_t_ms, (q.ef - q.sf) / q.tot * sp.span_ms AS part_ms, sp.drive_id AS d0, sp.sig FROM segs JOIN sg q USING (vehicle_id, seq, seg_no) JOIN spans sp USING (vehicle_id, seq)
   UNION ALL SELECT vehicle_id, seq, t_ms, 0, parked, 0, n_points, t_ms, CAST(span_ms AS DOUBLE), drive_id, sig FROM lp),
 gp AS (SELECT *, sum(CASE WHEN parked THEN 1 ELSE 0 END) OVER (PARTITION BY vehicle_id, d0 ORDER BY t_ms, seq, seg_no) AS g FROM j),
 cu AS (SELECT *, dense_rank() OVER (PARTITION BY vehicle_id ORDER BY d0, g) AS cut FROM gp WHERE NOT parked),
 fs AS (SELECT *, CASE WHEN sig IS NOT NULL THEN min(seg_t_ms * 1000000000 + seq) OVER (PARTITION BY vehicle_id, cut, sig) END AS f FROM cu),
 pa AS (SELECT *, dense_rank() OVER (PARTITION BY vehicle_id ORDER BY cut, f NULLS FIRST) AS drive_id FROM fs),
 pk AS (SELECT pa.*, row_number() OVER (PARTITION BY {KEYS} ORDER BY seg_t_ms, seq, seg_no) AS k, cl.source, cl.path FROM pa JOIN cl USING (vehicle_id, seq)),
 tm AS (SELECT {KEYS}, min(seg_t_ms) AS start_ms, CAST(floor(arg_max(seg_t_ms + {jr('part_ms')}, k)) AS BIGINT) AS end_ms, count(*) AS clip_count, arg_min(source, k) AS source, min(CASE WHEN k = 1 THEN sig END) AS external_signature, string_agg(path, '|' ORDER BY k) AS route_files,
   {_FIRST(f'({BATTERY})', 'arg_min')} AS battery_start, {_FIRST(f'({BATTERY_END})', 'arg_max')} AS battery_end, {r2(f'avg({OUTSIDE})')} AS exterior_avg, {_FIRST(f"({PLACE.format('VARCHAR')})", 'arg_min')} AS location_start FROM pk GROUP BY ALL),
 pt AS (SELECT {KEYS}, seq, seg_no, seg_t_ms, i, row_number() OVER (PARTITION BY {KEYS} ORDER BY k, i) AS idx,
   CASE WHEN end_idx - start_idx > 1 THEN seg_t_ms + part_ms * (i - start_idx) / (end_idx - start_idx - 1) ELSE CAST(seg_t_ms AS DOUBLE) END AS t, {LAT} AS lat, {LNG} AS lng, {AP.replace("div", "//")} AS ap, {SPEED} AS speed, {GEAR} AS gear, ({PEDAL}) * 1e2 AS pc
   FROM pk, LATERAL (SELECT unnest(range(start_idx, end_idx)) AS i)),
 lg AS (SELECT *, lag(lat) OVER w AS pla, lag(lng) OVER w AS pln, lag(t) OVER w AS pt, lag(ap) OVER w AS pap FROM pt WINDOW w AS (PARTITION BY {KEYS} ORDER BY idx)),
 sp2 AS (SELECT *, {geo('pla', 'pln', 'lat', 'lng')} AS d, t - pt AS dt FROM lg),
 ms AS (SELECT {KEYS}, coalesce(sum(d), 0) AS m, coalesce(sum(CASE WHEN ap <> 0 THEN d END), 0) AS am, max(CASE WHEN speed <> 0 THEN 1 ELSE 0 END) AS anyr, count(*) AS n, {_MODE_SUMS},
   coalesce(max(CASE WHEN d IS NOT NULL AND speed < 100 THEN speed END), 0) AS rm, coalesce(max(CASE WHEN dt > 0 AND d / (dt / 1e3) < 70 THEN d / (dt / 1e3) END), 0) AS dm,
   coalesce(avg(CASE WHEN d IS NOT NULL AND speed < 100 THEN speed END), 0) AS ra, coalesce(avg(CASE WHEN dt > 0 AND d / (dt / 1e3) < 70 THEN d / (dt / 1e3) END), 0) AS da FROM sp2 GROUP BY ALL),
 lf AS (SELECT {KEYS}, idx, t FROM sp2 WHERE pap = 1 AND ap <> 1),
 nx AS (SELECT l.vehicle_id, l.drive_id, l.idx, min(CASE WHEN p.gear = 0 AND p.t - l.t <= 2000 THEN p.idx END) AS pk, min(CASE WHEN p.t - l.t > 2000 OR p.ap = 1 THEN p.idx END) AS ov FROM lf l LEFT JOIN pt p ON p.vehicle_id = l.vehicle_id AND p.drive_id = l.drive_id AND p.idx > l.idx GROUP BY ALL),
 lastg AS (SELECT {KEYS}, arg_max(gear, idx) AS lg FROM pt GROUP BY ALL),
 di AS (SELECT {KEYS}, count(*) AS disengagements FROM nx JOIN lastg USING ({KEYS}) WHERE CASE WHEN pk IS NULL AND ov IS NULL THEN lg <> 0 ELSE NOT (pk IS NOT NULL AND (ov IS NULL OR pk <= ov)) END GROUP BY ALL),
 ru AS (SELECT *, sum(e) OVER w AS rr, coalesce(last_value(CASE WHEN e = 1 THEN t END IGNORE NULLS) OVER w, 0) AS since FROM (SELECT *, CASE WHEN ap = 1 AND coalesce(pap, 1) <> 1 THEN 1 ELSE 0 END AS e FROM sp2) WINDOW w AS (PARTITION BY {KEYS} ORDER BY idx)),
 mk AS (SELECT *, CASE WHEN pc > 1 AND t - since >= 3000 THEN 1 WHEN pc <= 0 THEN 0 END AS mm FROM ru WHERE ap = 1 AND pap IS NOT NULL),
 pu AS (SELECT {KEYS}, count(*) AS accel_pushes FROM (SELECT *, lag(mm) OVER (PARTITION BY {KEYS}, rr ORDER BY idx) AS pm FROM mk WHERE mm IS NOT NULL) WHERE mm = 0 AND pm = 1 GROUP BY ALL),
 tg AS ({TAGS.format(LOCAL.format('t_ms'), 'clips')}),
 dr AS (SELECT tm.*, {LOCAL.format('start_ms')} AS start_time, end_ms - start_ms AS duration_ms, coalesce(n, 0) AS point_count, coalesce({r2('m / 1e3')}, 0) AS distance_km, coalesce({r2('m / 1609.344e0')}, 0) AS distance_mi,
  coalesce({r2('(CASE WHEN anyr = 1 THEN rm ELSE dm END) * 3.6e0')}, 0) AS max_speed_kmh, coalesce({r2('(CASE WHEN anyr = 1 THEN ra ELSE da END) * 2.23694e0')}, 0) AS avg_speed_mph, coalesce({pct('am', 'm')}, 0) AS assisted_percent, {_MODES},
  coalesce(disengagements, 0) AS disengagements, coalesce(accel_pushes, 0) AS accel_pushes FROM tm LEFT JOIN ms USING ({KEYS}) LEFT JOIN di USING ({KEYS}) LEFT JOIN pu USING ({KEYS}))
 SELECT dr.*, false AS summon, coalesce(tag, '') AS tags FROM dr LEFT JOIN tg USING (vehicle_id, start_time)
 WHERE NOT (source <> 'sei' AND end_ms > start_ms AND EXISTS (SELECT 1 FROM dr r WHERE r.vehicle_id = dr.vehicle_id AND r.source = 'sei' AND r.end_ms > r.start_ms AND r.end_ms > dr.start_ms AND r.start_ms < dr.end_ms))"""


def tag_table(spark, sf):
    rows = spark.sql(TAGS.format("date_format(timestamp_millis(t_ms), \"yyyy-MM-dd'T'HH:mm:ss\")", "{c}"), c=clips(spark, sf))
    return rows.select("vehicle_id", "start_time", F.array("tag").alias("tags"))


@query("clips_to_drives", SQL)
def clips_to_drives(spark, sf):
    stored = point_clips(spark, sf)
    out = D.clips_to_drives(stored, tag_table(spark, sf))["drives"]
    modes = [f"{n}_{c}" for n in MODES for c in ("engaged_ms", "distance_km", "distance_mi", "percent")]
    return out.select(
        "vehicle_id", "drive_id", "start_ms", "end_ms", "start_time", "duration_ms", "clip_count", "source", "external_signature", F.array_join("route_files", "|").alias("route_files"), "battery_start", "battery_end", "exterior_avg", "location_start", "point_count", "distance_km", "distance_mi",
        "max_speed_kmh", "avg_speed_mph", "assisted_percent", *modes, "disengagements", "accel_pushes", "summon", F.array_join("tags", "|").alias("tags"))


@query("incremental_drives", SQL.rsplit(" SELECT dr.*, false AS summon", 1)[0] + """ SELECT vehicle_id, start_ms, end_ms, clip_count, source, route_files, point_count, distance_km, avg_speed_mph, assisted_percent, disengagements, accel_pushes, fsd_engaged_ms, coalesce(tag, '') AS tags FROM dr LEFT JOIN tg USING (vehicle_id, start_time)
 WHERE NOT (source <> 'sei' AND end_ms > start_ms AND EXISTS (SELECT 1 FROM dr r WHERE r.vehicle_id = dr.vehicle_id AND r.source = 'sei' AND r.end_ms > r.start_ms AND r.end_ms > dr.start_ms AND r.start_ms < dr.end_ms))""")
def incremental_drives(spark, sf):
    """The store after two batches: most clips, then the last ones and some that lie between."""
    stored, store = point_clips(spark, sf), f"{shared_folder(spark)}/store-{uuid.uuid4().hex}"
    late, between = F.col("t_ms") > 6_641_500_000, F.col("seq") % 1_000_000_000 % 50 == 7
    for batch in (stored.where(~late & ~between), stored.where(late | between)):
        incremental.add_clips(store, batch, tag_table(spark, sf))
    out = incremental.current_drives(spark, store)
    return out.select("vehicle_id", "start_ms", "end_ms", "clip_count", "source", F.array_join("route_files", "|").alias("route_files"), "point_count", "distance_km", "avg_speed_mph", "assisted_percent", "disengagements", "accel_pushes", "fsd_engaged_ms", F.array_join("tags", "|").alias("tags"))


#: Nine of ten vehicles are one.
HEAVY = "CASE WHEN vehicle_id % 10 <> 0 THEN 1 ELSE vehicle_id END"


@query("heavy_time_windows", cte("clips") + f", hv AS (SELECT {HEAVY} AS vehicle_id, seq, t_ms FROM clips) SELECT a.vehicle_id, a.seq, window_id, drive_id FROM {gaps('hv', 1800000, 'window_id')} a JOIN {gaps('hv', 300000, 'drive_id')} b USING (seq)")
def heavy_time_windows(spark, sf):
    """time_windows and sessionize_drives in one scan, where one vehicle holds most rows."""
    rows = clips(spark, sf).select(F.expr(HEAVY).alias("vehicle_id"), "seq", "t_ms")
    return scans.scan(rows, ("t_ms", "seq"), scans.Scan(("vehicle_id",), gaps={"window_id": ("t_ms", 1_800_000), "drive_id": ("t_ms", 300_000)})).drop("t_ms")
