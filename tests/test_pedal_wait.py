"""The rule for pedal waits in the SQL of the main flow."""

import duckdb

from tripspark.plans.drive_queries import SQL


def test_the_sql_waits_from_the_last_time_engaged():
    """Clips may overlap, so times may step back: the last one counts, not the latest."""
    rule = "ru AS (" + SQL.split(" ru AS (", 1)[1].split(",\n mk AS", 1)[0]
    rows = "sp2(vehicle_id, drive_id, idx, t, ap, pap) AS (VALUES (1, 1, 0, 0e0, 0, NULL), (1, 1, 1, 9e3, 1, 0), (1, 1, 2, 9.5e3, 0, 1), (1, 1, 3, 1e3, 1, 0), (1, 1, 4, 4.5e3, 1, 1))"
    assert duckdb.sql(f"WITH {rows}, {rule} SELECT since FROM ru ORDER BY idx").fetchall() == [(0,), (9000,), (9000,), (1000,), (1000,)]
