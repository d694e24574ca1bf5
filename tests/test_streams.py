"""Streams over many batches against one batch."""

import random

import pandas as pd
import pytest
from pyspark.sql import functions as F

from tripspark.functions.scalars import charging_state_key
from tripspark.operators import charging, holes, sessions
from tripspark.streaming import holes as hole_streams
from tripspark.streaming import jobs


@pytest.fixture
def rocks(spark):
    key = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(key)
    spark.conf.set(key, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    yield spark
    spark.conf.set(key, before)


SCHEMA = "vehicle_id bigint, pos bigint, ts double, raw_ts string, charging_state string, power_kw double, energy_kwh double, battery_pct double, lat double, lng double, location_name string"
COLUMNS = ("vehicle_id", "session_id", "start_s", "end_s", "start_battery", "end_battery", "energy_kwh", "peak_kw", "lat", "lng", "location_name", "end_reason", "cost_key")


def samples():
    rnd, rows = random.Random(12), []
    for car in range(6):
        t = 1_700_000_000.0
        for k in range(250):
            t += rnd.choice([1, 20, 59, 61, 400, 1800, 1801, 2500])
            some = lambda x, p=0.6: x if rnd.random() < p else None
            place = some((48.0 + rnd.random(), 11.0), 0.3) or (None, None)
            rows.append((car, k, t, str(int(t)), rnd.choice([" Charging", "starting", "Complete", "stopped", None, None, "idle", "charging"]), some(rnd.choice([-1.0, 0.0, 5.0, 50.0, 150.0])), some(rnd.random() * 9), some(float(rnd.randrange(100))), *place, some(rnd.choice([" home ", "", "x"]), 0.3)))
        rows.append((car, 250, t + 10_000_000, "end", None, None, None, None, None, None, None))  # moves the watermark past all pauses
    return rows


@pytest.mark.parametrize("files", [1, 9])
def test_charging_in_many_batches(rocks, tmp_path, files):
    spark, rows = rocks, sorted(samples(), key=lambda r: r[2])
    for k in range(files):
        part = rows[len(rows) * k // files : len(rows) * (k + 1) // files]
        spark.createDataFrame(part, SCHEMA).coalesce(1).write.parquet(f"{tmp_path}/in/part{k}")
    feed = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in/*")
    feed = feed.withColumns({"t": F.timestamp_seconds("ts"), "s": F.col("ts"), "state": charging_state_key(F.col("charging_state")), "rate_mph": F.lit(None).cast("double"), "name": F.nullif(F.trim("location_name"), F.lit(""))})
    got = []
    q = jobs.stream_charging(feed).writeStream.foreachBatch(lambda b, n: got.extend(b.collect())).option("checkpointLocation", f"{tmp_path}/check").trigger(availableNow=True).start()
    q.awaitTermination()
    batch = spark.createDataFrame(rows, SCHEMA)
    want = charging.charging_sessions(batch).collect()
    pick = lambda rs: sorted(repr(tuple(r[c] for c in COLUMNS)) for r in rs)
    assert pick(got) == pick(want) and len(want) > 60 and {r.end_reason for r in want} >= {"data-gap", "complete", "stopped"}
    curve = {(r.vehicle_id, r.session_no, p.s) for r in got for p in r.curve}
    kept = {(r.vehicle_id, r.session_no) for r in want}
    assert curve == {(r.vehicle_id, r.session_no, r.s) for r in charging.charge_curve(batch).collect() if (r.vehicle_id, r.session_no) in kept}


def test_totals_after_changes_and_compaction(spark, tmp_path):
    rnd, last, put = random.Random(1), {}, jobs.merge_drives(f"{tmp_path}/t", every=4)
    for number in range(11):
        sent = {(rnd.randrange(3), rnd.randrange(20)): rnd.randrange(1000) for _ in range(12)}
        last |= sent
        batch = spark.createDataFrame([(*k, v) for k, v in sent.items()], "vehicle_id int, start_ms bigint, duration_ms bigint")
        put(batch, number)
        if number in (2, 7):
            put(batch, number)  # a batch that is repeated changes nothing
        got = {r.vehicle_id: (r.drives, r.duration_ms) for r in jobs.read_totals(spark, f"{tmp_path}/t").collect()}
        assert got == {c: (sum(k[0] == c for k in last), sum(v for k, v in last.items() if k[0] == c)) for c in {k[0] for k in last}}
    assert len([p for p in (tmp_path / "t").iterdir() if "=" in p.name]) <= 5


CLIP = "vehicle_id bigint, seq bigint, t_ms bigint, path string, is_event boolean, driving boolean"


def hole_clips():
    """Stretches of ordinary clips, of event clips alone (long chains), and of both, with all the limits' borders; ties in time."""
    rnd, rows, seq = random.Random(4), [], 0
    for car in range(11):
        t = 1_700_000_000_000
        for _ in range(45):
            events = rnd.choice([0.0, 0.0, 0.5, 1.0, 1.0])
            for _ in range(rnd.randrange(1, 14)):
                t += rnd.choice([0, 10_000, 30_000, 30_001, 60_000, 90_000, 90_001, 150_000, 180_000, 180_001])
                event = rnd.random() < events
                rows.append((car, seq, t, f"p{rnd.randrange(50)}", event, rnd.random() < 0.9))
                seq += 1
            t += rnd.choice([180_000, 300_000, 300_001, 900_000, 1_799_000, 1_800_000, 1_800_001, 2_500_000])
    return rows


@pytest.mark.parametrize("files", [1, 12])
def test_drives_with_late_event_clips(rocks, tmp_path, files):
    spark, rnd, rows = rocks, random.Random(files), hole_clips()
    # event clips come up to 50 minutes late
    order = sorted(rows, key=lambda r: r[2] + (rnd.randrange(3_000_000) if r[4] else 0))
    order.append((-1, -1, rows[-1][2] + 40_000_000_000, "end", False, True))  # moves the watermark on
    for k in range(files):
        part = order[len(order) * k // files : len(order) * (k + 1) // files]
        spark.createDataFrame(part, CLIP).coalesce(1).write.parquet(f"{tmp_path}/in/part{k:02}")
    feed = spark.readStream.schema(CLIP).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in/*").withColumn("t", F.timestamp_millis("t_ms"))
    got = []
    q = hole_streams.stream_filled_drives(feed).writeStream.foreachBatch(lambda b, n: got.extend(map(tuple, b.collect()))).option("checkpointLocation", f"{tmp_path}/check").trigger(availableNow=True).start()
    q.awaitTermination()
    filled = sessions.sessionize_drives(holes.fill_holes(spark.createDataFrame(rows, CLIP)))
    want = filled.groupBy("vehicle_id", "drive_id").agg(F.min("t_ms").alias("a"), F.max("t_ms").alias("z"), F.count(F.lit(1)).alias("n"), F.count_if("filled").alias("f")).drop("drive_id").collect()
    assert sorted(got) == sorted(map(tuple, want)) and len(want) > 100 and sum(r.f for r in want) > 200


def test_held_clips_are_settled_step_by_step():
    """Whatever steps the watermark takes, the drives are the same, and nothing is held longer than needed."""
    make = lambda: hole_streams.HoleDrivesProcessor(90_000, 1_800_000, 180_000, 30_000, 300_000)
    rows = pd.DataFrame([(r[2], r[1], r[3], r[4]) for r in hole_clips() if r[0] < 4 and (not r[4] or r[5])], columns=["t", "seq", "path", "event"]).drop_duplicates()

    def run(steps):
        now, held, out, seen = dict.fromkeys(hole_streams._NAMES), [], [], -1
        for until in steps:
            held += make().thinned(now, rows[(rows["t"] > seen) & (rows["t"] <= until)])
            ended, held = make().settle(now, held, until)
            out, seen = out + ended, until
            at = make().next_time(now, rows[:0], held, until)
            assert (at is None) == (not held and now["start"] is None)
        assert not held and now["start"] is None
        return out

    end = int(rows["t"].max()) + 10_000_000
    whole = run([end])
    for step in (7_000, 61_000, 500_000, 4_000_000):
        assert run([*range(int(rows["t"].min()), end, step), end]) == whole


@pytest.mark.parametrize("job", ["charging", "drives"])
def test_a_vehicle_costs_no_calls_to_a_state_server(spark, job):
    """States come with a batch's rows, many vehicles at a time; with a call for each value a vehicle took some twenty milliseconds."""
    rows = spark.readStream.format("rate").load().withColumnRenamed("timestamp", "t")
    if job == "drives":
        out = hole_streams.stream_filled_drives(rows.selectExpr("value AS vehicle_id", "t", "value AS t_ms", "false AS is_event", "true AS driving"))
    else:
        text, number = "'' AS state, '' AS raw_ts, '' AS name", ", ".join(f"0e0 AS {c}" for c in jobs.NUMBERS)
        out = jobs.stream_charging(rows.selectExpr("value AS vehicle_id", "t", "value AS pos", text.split(", ")[0], *text.split(", ")[1:], *number.split(", ")))
    plan = out._jdf.queryExecution().analyzed().toString()
    assert "FlatMapGroupsInPandasWithState" in plan and "TransformWithState" not in plan
