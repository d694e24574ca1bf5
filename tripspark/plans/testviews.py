"""Trip tables derived from the given tables by plain arithmetic, as one SQL text for Spark and for DuckDB."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

#: What the two dialects spell differently.
SPARK = {"T": "unix_micros(CAST(ts AS TIMESTAMP)) div 256000", "DIV": "div", "S": "STRING", "FMT": "date_format(timestamp_millis({0}), 'yyyy-MM-dd_HH-mm-ss')", "BS": r"'\\'"}
DUCK = {"T": "epoch_us(ts) // 256000", "DIV": "//", "S": "VARCHAR", "FMT": "strftime(epoch_ms({0}), '%Y-%m-%d_%H-%M-%S')", "BS": r"'\'"}

CLIPS = """SELECT user_id AS vehicle_id, event_id AS seq, {T} AS t_ms,
  CAST(CASE event_type WHEN 'signup' THEN 0 WHEN 'error' THEN 2 ELSE 1 END AS BIGINT) AS gear,
  event_id % 4 AS ap, value / 8e0 AS speed, (event_id % 5) * 1e-1 AS accel,
  CASE event_id % 10 WHEN 0 THEN 'svc_a' WHEN 1 THEN 'svc_b' ELSE 'sei' END AS source, event_id % 9 = 0 AS is_event,
  37e0 + (user_id % 40) * 5e-2 + (event_id % 97) * 4e-4 AS lat, -122e0 + (user_id % 40) * 5e-2 + (event_id % 89) * 5e-4 AS lng
FROM {events}"""

#: Samples of a car's battery and charger; sparse.
SAMPLES = """SELECT user_id AS vehicle_id, event_id AS pos, CAST(event_id + 1 AS DOUBLE) * 0e0 + ({T}) / 1e3 AS ts, CAST(({T}) AS {S}) AS raw_ts,
  CASE event_type WHEN 'signup' THEN ' Starting' WHEN 'view' THEN 'charging' WHEN 'purchase' THEN 'Complete' WHEN 'error' THEN 'stopped' END AS charging_state,
  CASE WHEN event_id % 3 <> 0 THEN value END AS power_kw, CASE WHEN event_id % 3 <> 1 THEN value / 1e1 END AS energy_kwh,
  CASE WHEN event_id % 3 <> 0 THEN CAST(event_id % 100 AS DOUBLE) END AS battery_pct,
  CASE WHEN event_id % 4 = 0 THEN 37e0 + (user_id % 40) * 5e-2 + (event_id % 7) * 4e-3 END AS lat,
  CASE WHEN event_id % 4 = 0 THEN -122e0 + (user_id % 40) * 5e-2 END AS lng,
  CASE WHEN event_id % 6 = 0 THEN concat('place ', CAST(event_id % 11 AS {S})) END AS location_name
FROM {events}"""

STATIONS = """SELECT s_suppkey AS station_id, s_name AS name, 37e0 + (s_suppkey % 40) * 5e-2 + (s_suppkey % 7) * 4e-3 AS lat,
  -122e0 + (s_suppkey % 40) * 5e-2 + (s_suppkey % 3) * 1e-3 AS lng, CAST(50 + (s_suppkey % 6) * 50 AS DOUBLE) AS power_kw FROM {supplier}"""

PLACES = """SELECT c_custkey AS place_id, concat('place ', CAST(c_custkey AS {S})) AS label, 37e0 + (c_custkey % 40) * 5e-2 + (c_custkey % 97) * 4e-4 AS lat,
  -122e0 + (c_custkey % 40) * 5e-2 + (c_custkey % 89) * 5e-4 AS lng, CAST(50 + (c_custkey % 5) * 50 AS DOUBLE) AS radius_m,
  CASE c_custkey % 3 WHEN 0 THEN 'manual' WHEN 1 THEN 'zone' ELSE 'tesla' END AS source FROM {customer}"""

#: A clip of five gear runs, one point a frame pair.
RUNS = """SELECT user_id AS vehicle_id, event_id AS seq, {T} AS t_ms, (event_id % 23) AS n_points, k,
  CASE WHEN event_id % 6 = 0 THEN CAST(1 AS BIGINT) ELSE (event_id * (k + 1)) % 4 END AS gear, CAST(1 + (event_id * (k + 3)) % 37 AS DOUBLE) AS frames
FROM {events}, {range5}"""

VIEWS = {"clips": CLIPS, "samples": SAMPLES, "stations": STATIONS, "places": PLACES, "runs": RUNS}


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    read = lambda t: spark.read.parquet(f"{sf_dir}/{t}.parquet")
    text = VIEWS[name].format(**SPARK, events="{events}", supplier="{supplier}", customer="{customer}", range5="{range5}")
    frames = {t: read(t) for t in ("events", "supplier", "customer") if "{" + t + "}" in text}
    if "{range5}" in text:
        frames["range5"] = spark.range(5).withColumnRenamed("id", "k")
    return spark.sql(text, **frames)


def cte(*names: str) -> str:
    """``WITH`` clause with the views for DuckDB, to be followed by more tables or a SELECT."""
    own = dict(DUCK, events="events", supplier="supplier", customer="customer", range5="(SELECT unnest(range(5)) AS k) r5")
    return "WITH " + ", ".join(f"{n} AS ({VIEWS[n].format(**own)})" for n in names)
