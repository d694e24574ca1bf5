"""Queries on charging, sites, stations, places and areas."""

from __future__ import annotations

from pyspark.sql import functions as F

from tripspark.functions.scalars import round2
from tripspark.operators import charging as C
from tripspark.operators import spatial as S
from tripspark.plans.core import clips, trip_points
from tripspark.plans.registry import query
from tripspark.plans.sqltext import DRIVES, geo, hav, jr, r1, r2
from tripspark.plans.testviews import cte, view

KEYS = "vehicle_id, session_no"
TERM = "('complete', 'stopped', 'disconnected', 'nopower')"
#: Session rows by islands of pauses and terminal states.
ROWS = f"""a AS (SELECT *, regexp_replace(lower(trim(charging_state)), '[^a-z0-9]', '', 'g') AS state FROM samples),
b AS (SELECT *, coalesce(state IN {TERM}, false) AS term, coalesce(state IN ('starting', 'charging'), false) AS act, lag(ts) OVER w AS pts, lead(pos) OVER w IS NULL AS lastall FROM a WINDOW w AS (PARTITION BY vehicle_id ORDER BY pos)),
c AS (SELECT *, sum(CASE WHEN coalesce(ts - pts > 1800, false) THEN 1 ELSE 0 END) OVER w AS g, coalesce(sum(CASE WHEN term THEN 1 ELSE 0 END) OVER (PARTITION BY vehicle_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS e,
  max(CASE WHEN battery_pct IS NOT NULL THEN pos END) OVER w AS bp, max(CASE WHEN lat IS NOT NULL AND lng IS NOT NULL THEN pos END) OVER w AS cp, max(CASE WHEN location_name IS NOT NULL THEN pos END) OVER w AS np FROM b WINDOW w AS (PARTITION BY vehicle_id ORDER BY pos)),
d AS (SELECT *, min(CASE WHEN act THEN pos END) OVER (PARTITION BY vehicle_id, g, e) AS fp FROM c),
sr AS (SELECT *, dense_rank() OVER (PARTITION BY vehicle_id ORDER BY fp) AS session_no FROM d WHERE pos >= fp)"""
SESSIONS = f"""{ROWS},
pw AS (SELECT {KEYS}, pos, ts, power_kw, sum(CASE WHEN power_kw <= 0 THEN 1 ELSE 0 END) OVER (PARTITION BY {KEYS} ORDER BY pos) AS sk FROM sr WHERE power_kw IS NOT NULL),
held AS (SELECT {KEYS}, max(h) AS h FROM (SELECT {KEYS}, ts - first(ts) OVER (PARTITION BY {KEYS}, sk ORDER BY pos) AS h FROM pw WHERE power_kw > 0) GROUP BY ALL),
ss AS (SELECT {KEYS}, arg_min(ts, pos) AS start_s, arg_max(ts, pos) AS end_s, first(bp ORDER BY pos) AS sbp, last(bp ORDER BY pos) AS ebp, max(pos) AS lp, min(pos) AS sp, max(power_kw) AS peak_kw,
  CASE WHEN max(energy_kwh) IS NOT NULL THEN greatest(max(energy_kwh), 0) END AS energy_kwh, max(cp) AS mcp, max(np) AS mnp, arg_min(raw_ts, pos) AS cost_key, arg_max(state, pos) AS st, arg_max(term, pos) AS tm, arg_max(lastall, pos) AS la FROM sr GROUP BY ALL),
sess AS (SELECT ss.vehicle_id, ss.session_no, concat('charge-', CASE WHEN start_s = floor(start_s) THEN CAST(CAST(start_s AS BIGINT) AS VARCHAR) ELSE regexp_replace(CAST(CAST(start_s AS DECIMAL(20, 3)) AS VARCHAR), '0+$', '') END, '-', ss.session_no) AS session_id,
  start_s, end_s, greatest(end_s - start_s, 0) AS duration_s, sb.battery_pct AS start_battery, eb.battery_pct AS end_battery, ss.energy_kwh, peak_kw,
  CASE WHEN mcp > sp OR start_s - cc.ts <= 900 THEN cc.lat END AS lat, CASE WHEN mcp > sp OR start_s - cc.ts <= 900 THEN cc.lng END AS lng, CASE WHEN mnp > sp OR start_s - nn.ts <= 900 THEN trim(nn.location_name) END AS location_name,
  CASE WHEN tm THEN st WHEN la THEN 'end-of-file' ELSE 'data-gap' END AS end_reason, cost_key
  FROM ss LEFT JOIN held USING ({KEYS}) LEFT JOIN samples sb ON sb.pos = sbp LEFT JOIN samples eb ON eb.pos = ebp LEFT JOIN samples cc ON cc.pos = mcp LEFT JOIN samples nn ON nn.pos = mnp WHERE coalesce(ss.energy_kwh, 0) > 0 OR coalesce(h, 0) >= 60)"""
WITH = cte("samples") + ", " + SESSIONS
ROUNDED = ", ".join(f"{r2(c)} AS {c}" for c in ("start_s", "end_s", "duration_s", "energy_kwh", "peak_kw"))


def samples(spark, sf):
    return view(spark, sf, "samples")


def sessions(spark, sf):
    return C.charging_sessions(samples(spark, sf))


def _round(df, *cols):
    return df.withColumns({c: round2(F.col(c)) for c in cols})


@query("charging_sessions", WITH + f" SELECT * EXCLUDE (start_s, end_s, duration_s, energy_kwh, peak_kw, lat, lng), {ROUNDED}, {r2('lat * 1e3')} AS lat, {r2('lng * 1e3')} AS lng FROM sess")
def charging_sessions(spark, sf):
    out = _round(sessions(spark, sf), "start_s", "end_s", "duration_s", "energy_kwh", "peak_kw")
    return out.withColumns({"lat": round2(F.col("lat") * 1e3), "lng": round2(F.col("lng") * 1e3)})


@query("charge_curve", cte("samples") + f", {ROWS} SELECT sr.vehicle_id, session_no, sr.pos, {r2('sr.power_kw')} AS power_kw, {r2('sr.energy_kwh')} AS energy_kwh, b.battery_pct FROM sr LEFT JOIN samples b ON b.pos = bp WHERE coalesce(sr.power_kw, sr.energy_kwh) IS NOT NULL")
def charge_curve(spark, sf):
    return _round(C.charge_curve(samples(spark, sf)), "power_kw", "energy_kwh").drop("s")


COSTS = "SELECT vehicle_id, raw_ts AS cost_key, pos % 50 / 2e0 AS amount, CASE WHEN pos % 2 = 0 THEN 'EUR' ELSE 'USD' END AS currency FROM {samples} WHERE pos % 3 = 0"
TAGS = "SELECT vehicle_id, raw_ts AS cost_key, CASE pos % 4 WHEN 0 THEN '[\"home\",\"night\"]' WHEN 1 THEN '\"work\"' WHEN 2 THEN '[\"trip\"]' END AS tag_json FROM {samples} WHERE pos % 5 <> 0"


def tagged(spark, sf):
    s = samples(spark, sf)
    return C.session_costs_tags(sessions(spark, sf), spark.sql(COSTS, samples=s), spark.sql(TAGS, samples=s))


TAG_SQL = f""", co AS ({COSTS.format(samples='samples')}), tg AS ({TAGS.format(samples='samples')}),
 tagged AS (SELECT s.*, co.amount, co.currency, CASE tag_json WHEN '["home","night"]' THEN 'home|night' WHEN '"work"' THEN 'work' WHEN '["trip"]' THEN 'trip' ELSE '' END AS tags FROM sess s LEFT JOIN co USING (vehicle_id, cost_key) LEFT JOIN tg USING (vehicle_id, cost_key))"""


@query("session_costs_tags", WITH + TAG_SQL + " SELECT session_id, vehicle_id, amount, currency, tags FROM tagged")
def session_costs_tags(spark, sf):
    return tagged(spark, sf).select("session_id", "vehicle_id", "amount", "currency", F.array_join("tags", "|").alias("tags"))


@query("list_sessions", WITH + f" SELECT session_id, {r2('start_s')} AS start_s FROM sess WHERE vehicle_id = 3 ORDER BY start_s DESC, session_id")
def list_sessions(spark, sf):
    return _round(C.list_sessions(sessions(spark, sf), 3).select("session_id", "start_s"), "start_s")


#: The greedy clusters as a recursion over each vehicle's sessions; a site is a struct of its centre and size.
SITES = f""", so AS (SELECT *, row_number() OVER (PARTITION BY vehicle_id ORDER BY start_s, session_no) AS k FROM sess WHERE lat IS NOT NULL AND lng IS NOT NULL),
 gr AS (SELECT vehicle_id, k, session_no, 1 AS c, [{{'la': lat, 'ln': lng, 'n': 1e0}}] AS cs, [session_id] AS names FROM so WHERE k = 1
   UNION ALL SELECT vehicle_id, k, session_no, c, CASE WHEN c > len(cs) THEN list_append(cs, {{'la': lat, 'ln': lng, 'n': 1e0}}) ELSE list_concat(list_concat(cs[1:c - 1], [{{'la': (cs[c].la * cs[c].n + lat) / (cs[c].n + 1), 'ln': (cs[c].ln * cs[c].n + lng) / (cs[c].n + 1), 'n': cs[c].n + 1}}]), cs[c + 1:]) END,
     CASE WHEN c > len(cs) THEN list_append(names, session_id) ELSE names END
   FROM (SELECT so.*, gr.cs, gr.names, CAST(coalesce(list_position([{hav('so.lat', 'so.lng', 'x.la', 'x.ln')} <= 150 FOR x IN gr.cs], true), len(gr.cs) + 1) AS INTEGER) AS c FROM gr JOIN so ON so.vehicle_id = gr.vehicle_id AND so.k = gr.k + 1)),
 st AS (SELECT sess.*, CASE WHEN gr.c IS NULL THEN 'unknown' ELSE concat('site-', gr.names[gr.c]) END AS site_id FROM sess LEFT JOIN gr USING ({KEYS}))"""
RWITH = "WITH RECURSIVE " + WITH[5:]


@query("charging_sites", RWITH + SITES + " SELECT vehicle_id, session_no, site_id FROM st")
def charging_sites(spark, sf):
    return C.charging_sites(sessions(spark, sf)).select("vehicle_id", "session_no", "site_id")


def sites(spark, sf):
    return C.site_summary(C.charging_sites(tagged(spark, sf)))


#: The mean of coordinates to 1e-9 degrees, in whole numbers: the same whatever the order.
centre = lambda c: f"CAST(sum(CAST({jr(f'{c} * 1e9')} AS BIGINT)) AS DOUBLE) / count({c}) / 1e9"
SUMMARY = SITES + TAG_SQL.replace(" tagged AS", " tgd AS") + f""", stt AS (SELECT st.*, tgd.tags FROM st JOIN tgd USING ({KEYS})),
 one AS (SELECT vehicle_id, site_id, t.tag, max({{'s': start_s, 'n': session_no, 'i': -t.i}}) AS o FROM stt, LATERAL (SELECT unnest(range(1, 3)) AS i, string_split(tags, '|')[i] AS tag) t WHERE t.tag IS NOT NULL AND t.tag <> '' GROUP BY ALL),
 tl AS (SELECT vehicle_id, site_id, string_agg(tag, '|' ORDER BY o DESC) AS tags FROM one GROUP BY ALL),
 su AS (SELECT vehicle_id, site_id, count(*) AS visits, max(start_s) AS latest_s, max(peak_kw) AS peak_kw, {centre('lat')} AS lat, {centre('lng')} AS lng, last(location_name ORDER BY start_s, session_no) FILTER (WHERE location_name IS NOT NULL) AS nm FROM stt GROUP BY ALL),
 sm AS (SELECT su.* EXCLUDE (nm), coalesce(tl.tags, '') AS tags, CASE WHEN site_id = 'unknown' THEN 'Unknown location' ELSE coalesce(nm, 'Charging location') END AS display_name, list_contains(string_split(coalesce(tl.tags, ''), '|'), 'home') AS is_home FROM su LEFT JOIN tl USING (vehicle_id, site_id))"""


@query("site_summary", RWITH + SUMMARY + f" SELECT vehicle_id, site_id, visits, {r2('latest_s')} AS latest_s, {r2('peak_kw')} AS peak_kw, {r2('lat * 1e3')} AS lat, {r2('lng * 1e3')} AS lng, tags, display_name, is_home FROM sm")
def site_summary(spark, sf):
    out = _round(sites(spark, sf), "latest_s", "peak_kw")
    return out.withColumns({"lat": round2(F.col("lat") * 1e3), "lng": round2(F.col("lng") * 1e3), "tags": F.array_join("tags", "|")})


def matched(spark, sf):
    return S.match_stations(sites(spark, sf), view(spark, sf, "stations"))


MATCHED = cte("stations")[5:] + SUMMARY + f""", mm AS (SELECT sm.vehicle_id, sm.site_id, s.station_id, s.power_kw, {hav('sm.lat', 'sm.lng', 's.lat', 's.lng')} AS m FROM sm, stations s),
 ms AS (SELECT sm.*, b.station_id, {r1('b.m')} AS station_m, b.power_kw, b.station_id IS NOT NULL AS is_supercharger FROM sm LEFT JOIN (SELECT * FROM mm WHERE m <= 250 QUALIFY row_number() OVER (PARTITION BY vehicle_id, site_id ORDER BY m, station_id) = 1) b USING (vehicle_id, site_id))"""
MWITH = RWITH + ", " + MATCHED


@query("match_stations", MWITH + " SELECT vehicle_id, site_id, station_id, station_m, power_kw, CAST(CASE WHEN NOT is_supercharger THEN 0 WHEN power_kw >= 250 THEN 3 WHEN power_kw >= 150 THEN 2 WHEN power_kw > 0 THEN 1 ELSE 0 END AS BIGINT) AS tier, is_supercharger FROM ms")
def match_stations(spark, sf):
    return matched(spark, sf).select("vehicle_id", "site_id", "station_id", "station_m", "power_kw", "tier", "is_supercharger")


@query("filter_sites", MWITH + f" SELECT vehicle_id, site_id, visits, {r2('latest_s')} AS latest_s FROM ms WHERE NOT is_supercharger ORDER BY visits DESC, latest_s DESC, site_id")
def filter_sites(spark, sf):
    return _round(C.filter_sites(matched(spark, sf), superchargers=False).select("vehicle_id", "site_id", "visits", "latest_s"), "latest_s")


@query("site_cells", MWITH + " SELECT CAST(floor(lat / 1e-1) AS BIGINT) AS cell_lat, CAST(floor(lng / 1e-1) AS BIGINT) AS cell_lng, CAST(sum(visits) AS BIGINT) AS visits, count(*) FILTER (WHERE is_supercharger) AS superchargers, count(*) FILTER (WHERE NOT is_supercharger) AS others, CASE WHEN count(*) FILTER (WHERE NOT is_supercharger) = 0 THEN 'sc' WHEN count(*) FILTER (WHERE is_supercharger) = 0 THEN 'other' ELSE 'mixed' END AS kind FROM ms WHERE lat IS NOT NULL GROUP BY 1, 2")
def site_cells(spark, sf):
    return C.site_cells(matched(spark, sf))


def endpoints(spark, sf):
    """First and last point of each drive."""
    pts = trip_points(spark, sf)
    g = pts.groupBy("vehicle_id", "drive_id").agg(F.min_by(F.struct("lat", "lng"), "idx").alias("a"), F.max_by(F.struct("lat", "lng"), "idx").alias("z"))
    both = F.array(F.struct(F.lit("start").alias("which"), F.col("a").alias("p")), F.struct(F.lit("end").alias("which"), F.col("z").alias("p")))
    return g.select("vehicle_id", "drive_id", F.explode(both).alias("e")).select("vehicle_id", "drive_id", "e.which", "e.p.lat", "e.p.lng")


ENDS = f"""{DRIVES}, ends AS (SELECT vehicle_id, drive_id, 'start' AS which, arg_min(lat, idx) AS lat, arg_min(lng, idx) AS lng FROM pts GROUP BY ALL UNION ALL SELECT vehicle_id, drive_id, 'end', arg_max(lat, idx), arg_max(lng, idx) FROM pts GROUP BY ALL)"""
PLACED = f"""cand AS (SELECT e.*, p.place_id, p.label, p.source AS psource, {geo('e.lat', 'e.lng', 'p.lat', 'p.lng')} AS d, p.radius_m FROM ends e JOIN places p ON abs(e.lat - p.lat) < 1e-2 AND abs(e.lng - p.lng) < 1e-2),
placed AS (SELECT vehicle_id, drive_id, which, place_id, label, psource AS source, {r1('d')} AS distance_m FROM cand WHERE d <= radius_m QUALIFY row_number() OVER (PARTITION BY vehicle_id, drive_id, which ORDER BY CASE psource WHEN 'manual' THEN 1 WHEN 'zone' THEN 2 ELSE 3 END, {r1('d')}, place_id) = 1)"""


@query("match_places", cte("clips", "places") + f", {ENDS}, {PLACED} SELECT * FROM placed")
def match_places(spark, sf):
    return S.match_places(endpoints(spark, sf), view(spark, sf, "places"), ("vehicle_id", "drive_id", "which"))


@query("drives_in_zone", cte("clips") + f", {ENDS} SELECT DISTINCT vehicle_id, drive_id FROM ends WHERE {geo('lat', 'lng', '37.52e0', '-121.48e0')} <= 5000")
def drives_in_zone(spark, sf):
    return S.drives_in_zone(endpoints(spark, sf), 37.52, -121.48, 5000.0)


AREAS = """SELECT s_suppkey AS area_id, 37e0 + (s_suppkey % 40) * 5e-2 AS south, -122e0 + (s_suppkey % 40) * 5e-2 AS west FROM {supplier}"""


@query("points_in_areas", cte("clips") + f""", ar AS ({AREAS.format(supplier='supplier')}) SELECT vehicle_id, seq, area_id FROM clips JOIN ar ON lat BETWEEN south AND south + 2e-2 AND lng BETWEEN west AND west + 4e-2
 WHERE NOT (lat > south + 5e-3 AND lat < south + 1e-2 AND lng > west + 1e-2 AND lng < west + 2e-2) AND (lat - south) / 2e-2 + (lng - west) / 4e-2 < 1.913e0""")
def points_in_areas(spark, sf):
    a = spark.sql(AREAS, supplier=spark.read.parquet(f"{sf}/supplier.parquet"))
    # a square with a hole and one corner cut along (lat + lng share = 1.913)
    ring = "concat('[', {0}, ',', {1}, ']')"
    pt = lambda dx, dy: ring.format(f"west + {dx}", f"south + {dy}")
    outer = ", ".join(["'[['"] + [x for p in (pt(0, 0), pt("4e-2", 0), pt("4e-2", "1.826e-2"), pt("3.652e-2", "2e-2"), pt(0, "2e-2"), pt(0, 0)) for x in (p, "','")][:-1] + ["'],['"] + [x for p in (pt("1e-2", "5e-3"), pt("2e-2", "5e-3"), pt("2e-2", "1e-2"), pt("1e-2", "1e-2"), pt("1e-2", "5e-3")) for x in (p, "','")][:-1] + ["']]'"])
    a = a.select("area_id", "south", "west", F.expr("south + 2e-2 AS north"), F.expr("west + 4e-2 AS east"), F.expr(f"concat('{{\"type\":\"Polygon\",\"coordinates\":', {outer}, '}}') AS geojson"))
    return S.points_in_areas(clips(spark, sf).select("vehicle_id", "seq", "lat", "lng"), a).select("vehicle_id", "seq", "area_id")


ELEMENTS = """SELECT s_suppkey AS pos, s_suppkey AS id, 'node' AS type, 37e0 + (s_suppkey % 9) * 1e-1 + (s_suppkey % 4) * 3e-4 AS lat, -122e0 + (s_suppkey % 9) * 1e-1 AS lon FROM {supplier}"""


def elements(spark, sf):
    e = spark.sql(ELEMENTS, supplier=spark.read.parquet(f"{sf}/supplier.parquet"))
    tags = F.expr("map('amenity', 'charging_station', 'brand', CASE WHEN pos % 5 = 0 THEN 'Other' ELSE 'Tesla Supercharger' END, 'name', CASE WHEN pos % 3 = 0 THEN concat('S', pos) ELSE '' END, 'socket:a:output', concat(50 + pos % 4 * 50, ' kW; 20'))")
    return e.withColumns({"center": F.struct(F.col("lat").alias("lat"), F.col("lon").alias("lon")), "tags": tags})


#: The greedy merge as a recursion over the features in order.
STATION_SQL = f"""WITH RECURSIVE so AS (SELECT *, row_number() OVER (ORDER BY pos) AS k FROM ({ELEMENTS.format(supplier='supplier')}) WHERE pos % 5 <> 0),
 gr AS (SELECT k, 1 AS c, [{{'la': lat, 'ln': lon, 'n': 1e0}}] AS cs FROM so WHERE k = 1
   UNION ALL SELECT k, c, CASE WHEN c > len(cs) THEN list_append(cs, {{'la': lat, 'ln': lon, 'n': 1e0}}) ELSE list_concat(list_concat(cs[1:c - 1], [{{'la': (cs[c].la * cs[c].n + lat) / (cs[c].n + 1), 'ln': (cs[c].ln * cs[c].n + lon) / (cs[c].n + 1), 'n': cs[c].n + 1}}]), cs[c + 1:]) END
   FROM (SELECT so.*, gr.cs, CAST(coalesce(list_position([{hav('so.lat', 'so.lon', 'x.la', 'x.ln')} <= 100 FOR x IN gr.cs], true), len(gr.cs) + 1) AS INTEGER) AS c FROM gr JOIN so ON so.k = gr.k + 1))
 SELECT concat('node/', min(so.pos)) AS station_id, coalesce(arg_min(concat('S', so.pos), so.pos) FILTER (WHERE so.pos % 3 = 0), 'Tesla Supercharger') AS name, {r2('avg(lat) * 1e4')} AS lat, {r2('avg(lon) * 1e4')} AS lng,
  max(CAST(50 + so.pos % 4 * 50 AS DOUBLE)) AS power_kw, string_agg(concat('node/', so.pos), '|' ORDER BY so.pos) AS features FROM so JOIN gr USING (k) GROUP BY c"""


@query("normalize_stations", STATION_SQL)
def normalize_stations(spark, sf):
    out = S.normalize_stations(elements(spark, sf))
    return out.select("station_id", "name", round2(F.col("lat") * 1e4).alias("lat"), round2(F.col("lng") * 1e4).alias("lng"), "power_kw", F.array_join("osm_features", "|").alias("features"))


@query("station_power_kw", f"SELECT pos, CAST(50 + pos % 4 * 50 AS DOUBLE) AS kw FROM ({ELEMENTS.format(supplier='supplier')}) WHERE pos % 5 <> 0")
def station_power_kw(spark, sf):
    return elements(spark, sf).where(S.is_supercharger(F.col("tags"))).select("pos", S.station_power_kw(F.col("tags")).alias("kw"))


@query("learn_places")
def learn_places(spark, sf):
    places = view(spark, sf, "places").withColumns({"vehicle_id": F.col("place_id") % 15, "updated_at": F.col("place_id")})
    got = endpoints(spark, sf).where("which = 'end'").select((F.col("vehicle_id") % 15).alias("vehicle_id"), F.concat(F.lit("place "), F.col("drive_id").cast("string")).alias("label"), "lat", "lng", F.lit(35.0).alias("radius_m"), (F.col("drive_id") + 1000).alias("updated_at"))
    return S.learn_places(places, got, most=40)
