"""Charging: sessions as a state machine in windows, curves, sites, summaries."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tripspark.functions.scalars import charging_state_key, epoch_seconds, js_round
from tripspark.operators.helpers import whole_tables

ACTIVE, TERMINAL = ("starting", "charging"), ("complete", "stopped", "disconnected", "nopower")
UNKNOWN_SITE, UNNAMED_SITE, HOME = "Unknown location", "Charging location", "home"


def number_text(x: Column) -> Column:
    """Seconds as text: whole numbers without decimals, else up to three."""
    whole = F.floor(x).cast("bigint").cast("string")
    return F.when(x == F.floor(x), whole).otherwise(F.regexp_replace(F.round(x, 3).cast("decimal(20,3)").cast("string"), "0+$", ""))


def session_rows(samples: DataFrame, gap_s: int = 1800, fallback_s: int = 900) -> DataFrame:
    """The samples that belong to a charging session, with session_no (per vehicle, in order) and carried values.

    Expects vehicle_id, pos (file order), ts, charging_state, power_kw, energy_kwh, battery_pct, lat, lng, location_name.
    An island is what lies between pauses of more than ``gap_s`` and terminal states;
    its session begins at its first starting or charging row. All windows have one order,
    so the samples are shuffled and sorted once.
    """
    order = Window.partitionBy("vehicle_id").orderBy("pos")
    upto = order.rowsBetween(Window.unboundedPreceding, 0)
    name = F.nullif(F.trim("location_name"), F.lit(""))
    rows = samples.withColumns({"s": epoch_seconds(F.col("ts")), "state": charging_state_key(F.col("charging_state"))}).where("s IS NOT NULL")
    rows = rows.withColumns({
        "terminal": F.coalesce(F.col("state").isin(*TERMINAL), F.lit(False)),
        "active": F.coalesce(F.col("state").isin(*ACTIVE), F.lit(False)).cast("int"),
        "here": F.when(F.col("lat").isNotNull() & F.col("lng").isNotNull(), F.struct("lat", "lng", "s")),
        "named": F.when(name.isNotNull(), F.struct(name.alias("name"), F.col("s"))),
    })
    rows = rows.withColumns({
        "battery": F.last("battery_pct", ignorenulls=True).over(upto),
        "coords": F.last("here", ignorenulls=True).over(upto), "place": F.last("named", ignorenulls=True).over(upto),
        "cut": F.coalesce(F.col("s") - F.lag("s").over(order) > gap_s, F.lit(False)) | F.lag("terminal", 1, False).over(order),
        "actives": F.sum("active").over(upto), "last_of_all": F.lead("pos").over(order).isNull(),
    })
    # starting or charging rows before the island
    rows = rows.withColumn("earlier", F.coalesce(F.max(F.when(F.col("cut"), F.col("actives") - F.col("active"))).over(upto), F.lit(0))).where("actives > earlier")
    begins = (F.col("active") == 1) & (F.col("actives") == F.col("earlier") + 1)
    fresh = lambda c: F.when(begins & (F.col("s") - F.col(f"{c}.s") <= fallback_s), F.col(c))
    rows = rows.withColumns({"here": F.coalesce("here", fresh("coords")), "named": F.coalesce("named", fresh("place")), "session_no": F.sum(begins.cast("bigint")).over(upto)})
    return rows.drop("active", "actives", "earlier", "cut", "coords", "place")


def charging_sessions(samples: DataFrame, sustained_s: int = 60, **options) -> DataFrame:
    """One row per session with energy above 0 or power for at least ``sustained_s``; ids count all begun sessions."""
    rows = session_rows(samples, **options)
    # a streak of power: readings above 0, broken by one that is not; rows without a reading do not count
    order = Window.partitionBy("vehicle_id").orderBy("pos")
    before, upto = (order.rowsBetween(Window.unboundedPreceding, k) for k in (-1, 0))
    on = F.col("power_kw") > 0
    rows = rows.withColumn("_on_before", F.last(F.when(F.col("power_kw").isNotNull(), F.when(on, F.col("session_no")).otherwise(0)), ignorenulls=True).over(before))
    rows = rows.withColumn("_since", F.last(F.when(on & ~F.col("session_no").eqNullSafe(F.col("_on_before")), F.col("s")), ignorenulls=True).over(upto))
    known = lambda c: F.max_by(c, F.when(F.col(c).isNotNull(), F.col("pos")))
    g = rows.groupBy("vehicle_id", "session_no").agg(
        F.min_by(F.struct("s", "battery", "raw_ts"), "pos").alias("a"), F.max_by(F.struct("s", "battery", "state", "terminal", "last_of_all"), "pos").alias("z"),
        F.greatest(F.max("energy_kwh"), F.when(F.max("energy_kwh").isNotNull(), 0.0)).alias("energy_kwh"), F.max("power_kw").alias("peak_kw"),
        known("here").alias("h"), known("named").alias("n"), F.max(F.when(on, F.col("s") - F.col("_since"))).alias("held_s"))
    g = g.where((F.coalesce("energy_kwh", F.lit(0.0)) > 0) | (F.coalesce("held_s", F.lit(0.0)) >= sustained_s))
    g = g.withColumns({"start_s": F.col("a.s"), "end_s": F.col("z.s")})
    reason = F.when(F.col("z.terminal"), F.col("z.state")).when(F.col("z.last_of_all"), "end-of-file").otherwise("data-gap")
    return g.select(
        "vehicle_id", "session_no", F.concat(F.lit("charge-"), number_text(F.col("start_s")), F.lit("-"), F.col("session_no").cast("string")).alias("session_id"), "start_s", "end_s",
        F.greatest(F.col("end_s") - F.col("start_s"), F.lit(0.0)).alias("duration_s"), F.col("a.battery").alias("start_battery"), F.col("z.battery").alias("end_battery"), "energy_kwh", "peak_kw",
        F.col("h.lat").alias("lat"), F.col("h.lng").alias("lng"), F.col("n.name").alias("location_name"), reason.alias("end_reason"), F.col("a.raw_ts").alias("cost_key"))


def charge_curve(samples: DataFrame) -> DataFrame:
    """The samples of each session that carry power or energy (or a rate, if there is such a column)."""
    rows = session_rows(samples)
    rates = [c for c in ("power_kw", "energy_kwh", "rate_mph") if c in rows.columns]
    return rows.where(F.coalesce(*(F.col(c).cast("double") for c in rates)).isNotNull()).select("vehicle_id", "session_no", "pos", "s", *rates, F.col("battery").alias("battery_pct"))


def session_costs_tags(sessions: DataFrame, costs: DataFrame, tags: DataFrame) -> DataFrame:
    """Adds amount, currency and tags (array; a scalar is an array of one) by the raw start text. ``tags``: cost_key and JSON text."""
    text = F.trim("tag_json")
    many = F.when(text.startswith("["), F.from_json(text, "array<string>")).when(text.isNotNull() & (text != "null"), F.array(F.regexp_replace(text, '^"|"$', "")))
    out = sessions.join(costs.select("vehicle_id", "cost_key", "amount", "currency"), ["vehicle_id", "cost_key"], "left")
    out = out.join(tags.select("vehicle_id", "cost_key", "tag_json"), ["vehicle_id", "cost_key"], "left")
    return out.withColumn("tags", F.coalesce(many, F.array().cast("array<string>"))).drop("tag_json")


def haversine_np(lat, lng, lats, lngs):
    r = np.radians
    a = np.sin(r(lats - lat) / 2) ** 2 + np.cos(r(lat)) * np.cos(r(lats)) * np.sin(r(lngs - lng) / 2) ** 2
    return 6_371_000.0 * 2 * np.arctan2(np.sqrt(a), np.sqrt(1 - a))


def greedy_clusters(lat: np.ndarray, lng: np.ndarray, radius_m: float) -> np.ndarray:
    """The cluster of each point in order: the first whose running centre is within the radius, else a new one; -1 without coordinates."""
    la, ln, n = np.zeros(len(lat)), np.zeros(len(lat)), np.zeros(len(lat))
    out, k = np.full(len(lat), -1), 0
    for i, (a, b) in enumerate(zip(lat, lng)):
        if np.isnan(a) or np.isnan(b):
            continue
        near = np.flatnonzero(haversine_np(a, b, la[:k], ln[:k]) <= radius_m)
        c = int(near[0]) if len(near) else k
        k += c == k
        la[c], ln[c], n[c] = (la[c] * n[c] + a) / (n[c] + 1), (ln[c] * n[c] + b) / (n[c] + 1), n[c] + 1
        out[i] = c
    return out


#: Places of centres that many vehicles are given at once.
CENTRES = 1_000_000


def greedy_groups(lat: np.ndarray, lng: np.ndarray, starts: np.ndarray, radius_m: float) -> np.ndarray:
    """``greedy_clusters`` of each group of rows: the first points of all groups at once, then the second ones, and so on."""
    out = np.full(len(lat), -1)
    rows = np.flatnonzero(~(np.isnan(lat) | np.isnan(lng)))
    size = np.bincount(np.searchsorted(starts, rows, "right") - 1, minlength=len(starts))
    begin, order, done = np.cumsum(size) - size, np.argsort(-size, kind="stable"), 0
    while done < len(order) and size[order[done]]:
        # groups of similar size, the largest first, so that those still going on are always the first ones
        own = order[done : done + max(1, CENTRES // int(size[order[done]]))]
        done += len(own)
        n, at = size[own], begin[own]
        la, ln, w = (np.zeros((len(own), min(8, int(n[0])))) for _ in range(3))
        k = np.zeros(len(own), int)
        for i in range(n[0]):
            v = int(np.searchsorted(-n, -i, "left"))
            r, row, used = rows[at[:v] + i], np.arange(v), int(k[:v].max())
            a, b = lat[r], lng[r]
            near = (haversine_np(a[:, None], b[:, None], la[:v, :used], ln[:v, :used]) <= radius_m) & (np.arange(used) < k[:v, None])
            found = near.any(axis=1)
            c = np.where(found, near.argmax(axis=1), k[:v]) if used else k[:v].copy()
            k[:v] += ~found
            if c.max() >= la.shape[1]:
                la, ln, w = (np.hstack([x, np.zeros((len(own), min(x.shape[1], int(n[0]) - x.shape[1])))]) for x in (la, ln, w))
            m = w[row, c]
            la[row, c], ln[row, c], w[row, c] = (la[row, c] * m + a) / (m + 1), (ln[row, c] * m + b) / (m + 1), m + 1
            out[r] = c
    return out


def charging_sites(sessions: DataFrame, radius_m: float = 150.0) -> DataFrame:
    """Adds ``site_id``: greedy clusters per vehicle in time order, named after their first session; ``unknown`` without coordinates.

    A running centre depends on the order, so it is a helper, a pass over sorted partitions
    that takes many vehicles at once. The sessions pass through it as Arrow data, so that they
    are worked out once and not joined with their own sites.
    """

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, starts in whole_tables(batches, "vehicle_id"):
            lat, lng = (table[c].cast(pa.float64()).to_numpy() for c in ("lat", "lng"))
            c = greedy_groups(lat, lng, starts, radius_m)
            # clusters of all vehicles, numbered by the places of their vehicles
            c = np.where(c < 0, -1, c + np.repeat(starts, np.diff(starts, append=len(c))))
            _, first, own = np.unique(c, return_index=True, return_inverse=True)
            named = pc.binary_join_element_wise("site-", table["session_id"].take(pa.array(first[own])), "")
            yield from table.append_column("site_id", pc.if_else(pa.array(c < 0), "unknown", named).cast(table["session_id"].type)).to_batches()

    ordered = sessions.repartition("vehicle_id").sortWithinPartitions("vehicle_id", "start_s", "session_no")
    return ordered.mapInArrow(of, T.StructType([*sessions.schema.fields, T.StructField("site_id", T.StringType())]))


def site_summary(sessions: DataFrame) -> DataFrame:
    """Per site: centre (to 1e-9 degrees of each visit, so that it does not depend on the order of sums), visits, latest visit, peak power, tags (newest visit first, once each), home, latest reported name."""
    by = ("vehicle_id", "site_id")
    centre = lambda c: F.sum(js_round(F.col(c) * 1e9).try_cast("bigint")) / F.count(js_round(F.col(c) * 1e9).try_cast("bigint")) / 1e9
    tags = F.array_distinct(F.flatten(F.transform(F.sort_array(F.collect_list(F.struct("start_s", "session_no", "tags")), asc=False), lambda x: x["tags"])))
    name = F.max_by("location_name", F.when(F.col("location_name").isNotNull(), F.struct("start_s", "session_no")))
    g = sessions.groupBy(*by).agg(
        F.count(F.lit(1)).alias("visits"), F.max("start_s").alias("latest_s"), F.max("peak_kw").alias("peak_kw"), centre("lat").alias("lat"), centre("lng").alias("lng"), tags.alias("tags"), name.alias("_n"))
    shown = F.when(F.col("site_id") == "unknown", UNKNOWN_SITE).otherwise(F.coalesce("_n", F.lit(UNNAMED_SITE)))
    return g.withColumns({"display_name": shown, "is_home": F.exists("tags", lambda t: F.lower(F.trim(t)) == HOME)}).drop("_n")


def list_sessions(sessions: DataFrame, vehicle_id, site_id: str | None = None) -> DataFrame:
    """Sessions of a vehicle (and site), newest first."""
    out = sessions.where(F.col("vehicle_id") == vehicle_id)
    return (out if site_id is None else out.where(F.col("site_id") == site_id)).orderBy(F.desc("start_s"), "session_id")


def filter_sites(sites: DataFrame, superchargers: bool = True, others: bool = True) -> DataFrame:
    """Sites of the wanted kinds by visits, latest visit, id."""
    wanted = (F.col("is_supercharger") & F.lit(superchargers)) | (~F.col("is_supercharger") & F.lit(others))
    return sites.where(wanted).orderBy(F.desc("visits"), F.desc("latest_s"), "site_id")


def site_cells(sites: DataFrame, degrees: float = 0.1) -> DataFrame:
    """Map roll-up by grid cell: visits, superchargers, others and the kind (sc, other, mixed)."""
    cell = lambda c: F.floor(F.col(c) / degrees).cast("bigint")
    g = sites.where("lat IS NOT NULL AND lng IS NOT NULL").groupBy(cell("lat").alias("cell_lat"), cell("lng").alias("cell_lng")).agg(
        F.sum("visits").alias("visits"), F.count_if("is_supercharger").alias("superchargers"), F.count_if(~F.col("is_supercharger")).alias("others"))
    kind = F.when(F.col("others") == 0, "sc").when(F.col("superchargers") == 0, "other").otherwise("mixed")
    return g.withColumn("kind", kind)
