"""Streaming jobs run to the end of the event files and compared with batch."""

from __future__ import annotations

import uuid
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tripspark.functions.scalars import charging_state_key, round2
from tripspark.operators import stats
from tripspark.operators.regions import shared_folder
from tripspark.plans.charging_queries import COSTS, SESSIONS, TAG_SQL, TAGS, samples
from tripspark.plans.core import DRIVES, FILL, trip_points
from tripspark.plans.registry import query
from tripspark.plans.sqltext import gaps, r2
from tripspark.plans.testviews import CLIPS, SAMPLES, SPARK, cte, view
from tripspark.streaming import holes, jobs

WITH = cte("clips") + ", " + DRIVES


def events_stream(spark: SparkSession, sf: str, text: str) -> DataFrame:
    path = f"{sf}/events.parquet"
    schema = spark.read.parquet(path).schema
    raw = spark.readStream.schema(schema).parquet(f"{sf}/events.parquet*")
    rows = spark.sql(text.format(**SPARK, events="{events}"), events=raw)
    return rows.withColumn("t", F.timestamp_millis(F.col("t_ms")) if "t_ms" in rows.columns else F.timestamp_seconds("ts"))


def run(stream: DataFrame, mode: str) -> DataFrame:
    """All that is available, through the stream into Parquet in the shared folder; a complete result replaces the one before."""
    spark = stream.sparkSession
    folder = f"{shared_folder(spark)}/stream-{uuid.uuid4().hex}"

    def put(batch: DataFrame, number: int) -> None:
        # a batch that is repeated overwrites itself
        batch.write.mode("overwrite").parquet(f"{folder}/out" if mode == "complete" else f"{folder}/out/batch={number}")

    q = stream.writeStream.foreachBatch(put).option("checkpointLocation", f"{folder}/checkpoint").outputMode(mode).trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.parquet(f"{folder}/out").select(*stream.columns)


@contextmanager
def rocksdb(spark: SparkSession):
    """The state store that keeps lists and timers, for the time of a job."""
    provider = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(provider)
    spark.conf.set(provider, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        yield
    finally:
        spark.conf.set(provider, before)


@query("stream_new_clips", cte("clips") + " SELECT vehicle_id, concat('x/', seq // 40) AS path FROM clips GROUP BY ALL")
def stream_new_clips(spark, sf):
    c = events_stream(spark, sf, CLIPS).withColumn("path", F.expr("concat('x/', seq div 40)"))
    return run(jobs.stream_new_clips(c, "400 days").select("vehicle_id", "path"), "append")


@query("stream_drives", WITH + " SELECT vehicle_id, min(t_ms) AS start_ms, max(t_ms) AS end_ms, count(*) AS n FROM drv GROUP BY vehicle_id, drive_id")
def stream_drives(spark, sf):
    return run(jobs.stream_drives(events_stream(spark, sf, CLIPS)), "complete")


@query("stream_filled_drives", "WITH RECURSIVE " + cte("clips")[5:] + f", {FILL} SELECT vehicle_id, min(t_ms) AS start_ms, max(t_ms) AS end_ms, count(*) AS n, count(*) FILTER (WHERE filled) AS filled FROM {gaps('fl', 300000, 'drive_id')} GROUP BY vehicle_id, drive_id")
def stream_filled_drives(spark, sf):
    """All clips of the feed, then a last row that moves the watermark past them, so that all drives end."""
    folder = f"{shared_folder(spark)}/last-{uuid.uuid4().hex}"
    c = events_stream(spark, sf, CLIPS).select("vehicle_id", "t", "t_ms", "seq", F.concat(F.lit("e"), F.lpad((F.col("seq") % 50).cast("string"), 3, "0")).alias("path"), "is_event", (F.col("gear") != 0).alias("driving"))
    newest = view(spark, sf, "clips").agg(F.max("t_ms").alias("t_ms"))
    newest.select(F.lit(-1).cast("bigint").alias("vehicle_id"), F.timestamp_millis(F.col("t_ms") + 100 * 86_400_000).alias("t"), "t_ms", F.lit(-1).cast("bigint").alias("seq"), F.lit("").alias("path"), F.lit(True).alias("is_event"), F.lit(True).alias("driving")).select(*c.columns).write.parquet(folder)
    with rocksdb(spark):
        return run(holes.stream_filled_drives(c.unionByName(spark.readStream.schema(c.schema).parquet(folder))), "append")


@query("stream_minute_clips", cte("clips") + f" SELECT vehicle_id, t_ms // 60000 * 60000 AS minute_ms, count(*) AS n, {r2('max(speed)')} AS max_speed FROM clips GROUP BY 1, 2")
def stream_minute_clips(spark, sf):
    return run(jobs.stream_minute_clips(events_stream(spark, sf, CLIPS)), "complete").withColumn("max_speed", F.floor(F.col("max_speed") * 100 + 0.5) / 100)


#: The batch sessions with samples in order of time; those still open at the end of the feed wait for their timer.
BY_TIME = cte("samples").replace("WITH samples AS (", "WITH samples AS (SELECT * REPLACE (row_number() OVER (ORDER BY vehicle_id, ts, pos) AS pos), pos AS pos0 FROM (", 1) + "), " + SESSIONS
FIGURES = ("start_s", "end_s", "duration_s", "energy_kwh", "peak_kw")
CURVES = f"cv AS (SELECT vehicle_id, session_no, count(*) AS n_curve, {r2('sum(coalesce(power_kw, 0))')} AS curve_kw FROM sr WHERE coalesce(power_kw, energy_kwh) IS NOT NULL GROUP BY ALL)"


@query("stream_charging", BY_TIME + TAG_SQL.replace("pos %", "pos0 %") + f""", {CURVES}
 SELECT vehicle_id, session_no, session_id, {', '.join(f'{r2(c)} AS {c}' for c in FIGURES)}, start_battery, end_battery, {r2('lat * 1e3')} AS lat, {r2('lng * 1e3')} AS lng, location_name, end_reason, cost_key, amount, currency, tags, n_curve, curve_kw
 FROM tagged LEFT JOIN cv USING (vehicle_id, session_no) WHERE end_reason <> 'end-of-file'""")
def stream_charging(spark, sf):
    """Sessions with costs, tags and curve; the store of costs is the batch table."""
    with rocksdb(spark):
        batch = samples(spark, sf)
        s = events_stream(spark, sf, SAMPLES).withColumns({"s": F.col("ts"), "state": charging_state_key(F.col("charging_state")), "rate_mph": F.lit(None).cast("double"), "name": F.nullif(F.trim("location_name"), F.lit(""))})
        rows = s.select("vehicle_id", "t", "s", "pos", "state", "energy_kwh", "power_kw", "rate_mph", "battery_pct", "lat", "lng", "name", "raw_ts")
        out = run(jobs.stream_charging(rows, spark.sql(COSTS, samples=batch), spark.sql(TAGS, samples=batch)), "append")
    kw = F.aggregate("curve", F.lit(0.0), lambda a, x: a + F.coalesce(x["power_kw"], F.lit(0.0)))
    out = out.withColumns({"n_curve": F.size("curve").cast("bigint"), "curve_kw": round2(kw), "tags": F.array_join("tags", "|"), "lat": round2(F.col("lat") * 1e3), "lng": round2(F.col("lng") * 1e3)})
    return out.withColumns({c: round2(F.col(c)) for c in FIGURES}).drop("curve")


@query("stream_totals", WITH + " SELECT vehicle_id, count(*) AS drives, CAST(sum(d) AS BIGINT) AS duration_ms FROM (SELECT vehicle_id, drive_id, max(end_t_ms) - min(t_ms) AS d FROM pts GROUP BY ALL) GROUP BY ALL")
def stream_totals(spark, sf):
    """Drives flow through foreachBatch, first as they stood half way, then as they ended; each counts once, as it was sent last."""
    folder = f"{shared_folder(spark)}/totals-{uuid.uuid4().hex}"
    drives = stats.drive_stats(trip_points(spark, sf)).select("vehicle_id", "start_ms", "duration_ms")
    feed = spark.readStream.schema("vehicle_id bigint, start_ms bigint, duration_ms bigint").parquet(f"{folder}/drives*")
    for k, rows in enumerate((drives.where("vehicle_id % 3 <> 0").withColumn("duration_ms", F.expr("duration_ms div 2")), drives)):
        rows.write.parquet(f"{folder}/drives{k}")
        q = feed.writeStream.foreachBatch(jobs.merge_drives(f"{folder}/totals", every=2)).option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start()
        q.awaitTermination()
    return jobs.read_totals(spark, f"{folder}/totals")
