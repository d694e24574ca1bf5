"""Sessions are worked out in one pass over the samples."""

from tripspark.operators import charging

SCHEMA = "vehicle_id bigint, pos bigint, ts double, charging_state string, power_kw double, energy_kwh double, battery_pct double, lat double, lng double, location_name string, raw_ts string"


def test_samples_are_shuffled_once_and_sorted_by_time_once(spark):
    rows = [(1, p, 1000.0 + 30 * p, "charging" if p % 9 == 0 else "stopped" if p % 9 == 7 else None, None if p % 4 == 1 else float(p % 3), None, 50.0, None, None, None, str(p)) for p in range(60)]
    out = charging.charging_sessions(spark.createDataFrame(rows, SCHEMA))
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and "Join" not in plan
    assert sum("Sort [vehicle_id" in line and "pos" in line for line in plan.splitlines()) == 1


def test_streaks_do_not_run_on_into_the_next_session(spark):
    # powered all the time, but each session for 40 s only; the third one for 80 s, past a row without a reading
    states = ["charging", "stopped", "charging", "stopped", "charging", None, "stopped", None]
    power = [5.0, 5.0, 5.0, 5.0, 5.0, None, 5.0, 5.0]
    rows = [(1, p, 1000.0 + 40 * p, st, w, None, None, None, None, None, str(p)) for p, (st, w) in enumerate(zip(states, power))]
    out = charging.charging_sessions(spark.createDataFrame(rows, SCHEMA)).collect()
    assert [(r.session_no, r.start_s, r.end_s, r.end_reason) for r in out] == [(3, 1160.0, 1240.0, "stopped")]
