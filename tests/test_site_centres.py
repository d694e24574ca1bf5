"""Centres of sites do not depend on the order of sums."""

from pyspark.sql import functions as F

from tripspark.operators import charging


def test_a_centre_does_not_depend_on_the_order_of_sums(spark):
    rows = [(v, i, "s", float(i), 1.0, [], None, x, float("nan") if i == 3 else x) for v, xs in ((1, [0.1, 0.2, 37.3, 1e-9]), (2, [1e-9, 37.3, 0.2, 0.1])) for i, x in enumerate(xs)]
    s = spark.createDataFrame(rows, "vehicle_id int, session_no bigint, site_id string, start_s double, peak_kw double, tags array<string>, location_name string, lat double, lng double").coalesce(1)
    got = {r.vehicle_id: (r.lat, r.lng) for r in charging.site_summary(s).collect()}
    assert got[1][0] == got[2][0] and got[1][1] is not None
    same = spark.range(6).select(F.lit(1).alias("vehicle_id"), F.col("id").alias("session_no"), F.lit("s").alias("site_id"), F.col("id").cast("double").alias("start_s"), F.lit(1.0).alias("peak_kw"), F.array().cast("array<string>").alias("tags"), F.lit(None).cast("string").alias("location_name"), F.lit(37.1).alias("lat"), F.lit(-121.9).alias("lng"))
    r = charging.site_summary(same).first()
    assert (r.lat, r.lng) == (37.1, -121.9)
