"""Incremental runs as Structured Streaming jobs."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tripspark.operators.charging import ACTIVE, TERMINAL, number_text, session_costs_tags


def stream_new_clips(clips: DataFrame, delay: str = "1 day") -> DataFrame:
    """Each clip of a path once; repeats within the watermark are dropped, older rows too. Expects t (timestamp), vehicle_id, path."""
    return clips.withWatermark("t", delay).dropDuplicatesWithinWatermark(["vehicle_id", "path"])


def stream_drives(clips: DataFrame, gap: str = "5 minutes", delay: str = "1 hour") -> DataFrame:
    """Drives by session windows; a gap of exactly 5 minutes still joins, as in the batch rule."""
    g = clips.withWatermark("t", delay).groupBy("vehicle_id", F.session_window("t", gap).alias("w")).agg(F.count(F.lit(1)).alias("n"), F.min("t_ms").alias("start_ms"), F.max("t_ms").alias("end_ms"))
    return g.select("vehicle_id", "start_ms", "end_ms", "n")


def stream_minute_clips(points: DataFrame, delay: str = "10 minutes") -> DataFrame:
    """Points by tumbling minutes: minute start and counts."""
    g = points.withWatermark("t", delay).groupBy("vehicle_id", F.window("t", "1 minute").alias("w")).agg(F.count(F.lit(1)).alias("n"), F.max("speed").alias("max_speed"))
    return g.select("vehicle_id", F.unix_millis("w.start").alias("minute_ms"), "n", "max_speed")


STATE = (
    "last double, seq bigint, battery double, lat double, lng double, at double, name string, named double,"
    " start double, end double, cost_key string, start_battery double, end_battery double, energy double, peak double, streak double, held double, here_lat double, here_lng double, here_name string"
)
CURVE = "s double, power_kw double, energy_kwh double, rate_mph double, battery_pct double"
SESSION = (
    "session_no bigint, start_s double, end_s double, start_battery double, end_battery double, energy_kwh double, peak_kw double, lat double, lng double, location_name string, end_reason string, cost_key string,"
    f" curve array<struct<{CURVE.replace(' double', ':double')}>>"
)
_NAMES = [f.strip().split()[0] for f in STATE.split(",")]
_CURVE = CURVE.replace(" double", "").split(", ")
_COLUMNS = ["vehicle_id", *(f.strip().split()[0] for f in SESSION.split(", curve")[0].split(",")), "curve"]
#: Numbers of a sample that go to the processor as one array.
NUMBERS = ("s", "energy_kwh", "power_kw", "rate_mph", "battery_pct", "lat", "lng")


def _value(x):
    return None if x is None or x != x else x


def _last(values: np.ndarray, known: np.ndarray, before):
    """The last known value, else ``before``."""
    at = np.flatnonzero(known)
    return values[at[-1]] if len(at) else before


def _forward(values: np.ndarray, known: np.ndarray, before) -> np.ndarray:
    """At each row the last known value so far, else ``before`` (null is nan)."""
    at = np.maximum.accumulate(np.where(known, np.arange(len(values)), -1))
    return np.where(at >= 0, values[np.maximum(at, 0)], np.nan if before is None else before)


class ChargingProcessor:
    """Per vehicle: what is carried from sample to sample, the figures of the open session and its curve in one state, and a time-out for the pause that ends it.

    The samples of a batch are cut where a pause or a terminal state ends an island, and an
    island is added to the open session as a whole.
    """

    def __init__(self, gap_s: float, sustained_s: float, fallback_s: float) -> None:
        self.gap_s, self.sustained_s, self.fallback_s = gap_s, sustained_s, fallback_s

    def _close(self, now: dict, end: float, reason: str) -> list[tuple]:
        kept = (now["energy"] or 0) > 0 or (now["held"] or 0) >= self.sustained_s
        points = [dict(zip(_CURVE, map(_value, p))) for p in zip(*[iter(now["curve"])] * len(_CURVE))] if kept else []
        out = (now["seq"], now["start"], end, now["start_battery"], now["end_battery"], now["energy"], now["peak"], now["here_lat"], now["here_lng"], now["here_name"], reason, now["cost_key"], points)
        now.update(dict.fromkeys(_NAMES[_NAMES.index("start"):]), curve=[])
        return [out] if kept else []

    def _island(self, now: dict, c: dict[str, np.ndarray], a: int, b: int, carried: dict[str, np.ndarray]) -> None:
        """Adds rows a to b to the open session, or begins one at the first of them that charges."""
        if now["start"] is None:
            begins = np.flatnonzero(c["active"][a:b])
            if not len(begins):
                return
            a += int(begins[0])
            fresh = lambda at: at == at and c["s"][a] - at <= self.fallback_s
            near, told = fresh(carried["at"][a]), fresh(carried["named"][a])
            now.update(seq=now["seq"] + 1, start=c["s"][a], cost_key=c["raw_ts"][a], start_battery=_value(carried["battery"][a]), held=0.0,
                       here_lat=carried["lat"][a] if near else None, here_lng=carried["lng"][a] if near else None, here_name=carried["name"][a] if told else None)
        own = {k: v[a:b] for k, v in c.items()}
        has = {k: ~np.isnan(own[k]) for k in ("energy_kwh", "power_kw", "rate_mph", "place")}
        now["end"], now["end_battery"] = own["s"][-1], _value(carried["battery"][b - 1])
        if has["energy_kwh"].any():
            now["energy"] = max(now["energy"] or 0.0, np.nanmax(own["energy_kwh"]))
        if has["power_kw"].any():
            power, at = own["power_kw"][has["power_kw"]], own["s"][has["power_kw"]]
            now["peak"] = max(power.max(), now["peak"] if now["peak"] is not None else power.max())
            on = power > 0
            first = np.where(on & ~np.concatenate([[now["streak"] is not None], on[:-1]]), at, -np.inf)
            since = np.maximum.accumulate(np.concatenate([[-np.inf if now["streak"] is None else now["streak"]], first]))[1:]
            now["held"] = max(now["held"], float(np.where(on, at - since, 0.0).max()))
            now["streak"] = float(since[-1]) if on[-1] else None
        now["here_lat"], now["here_lng"] = _last(own["lat"], has["place"], now["here_lat"]), _last(own["lng"], has["place"], now["here_lng"])
        now["here_name"] = _last(own["name"], own["told"], now["here_name"])
        some = has["energy_kwh"] | has["power_kw"] | has["rate_mph"]
        if some.any():
            columns = [own[k][some] for k in ("s", "power_kw", "energy_kwh", "rate_mph")] + [carried["battery"][a:b][some]]
            now["curve"] += np.column_stack(columns).ravel().tolist()

    def __call__(self, key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        """A step of one vehicle: its new samples, or none at its time-out."""
        held = state.get if state.exists else (*[None] * len(_NAMES), [])
        now, out = dict(zip(_NAMES, map(_value, held))) | {"curve": list(held[-1])}, []
        now["seq"] = now["seq"] or 0
        if state.hasTimedOut:
            out += self._close(now, now["end"], "data-gap") if now["start"] is not None else []
        else:
            out += self._add(now, list(parts))
        over = None if now["start"] is None else int((now["last"] + self.gap_s) * 1000)
        if over is not None and state.getCurrentWatermarkMs() > over:  # the pause has passed already
            out += self._close(now, now["end"], "data-gap")
            over = None
        plain = lambda x: None if x is None else x if isinstance(x, str) else int(x) if isinstance(x, (int, np.integer)) else float(x)
        state.update((*(plain(now[k]) for k in _NAMES), now["curve"]))
        if over is not None:
            state.setTimeoutTimestamp(max(1, over))
        if out:
            yield pd.DataFrame([(key[0], *row) for row in out], columns=_COLUMNS)

    def _add(self, now: dict, parts: list[pd.DataFrame]) -> list[tuple]:
        """The sessions that end with the samples."""
        numbers = np.concatenate([np.stack(p["x"].to_numpy()).astype(float) for p in parts])
        pos = np.concatenate([p["pos"].to_numpy(float) for p in parts])
        order = np.lexsort((pos, numbers[:, 0]))
        if now["last"] is not None:
            order = order[numbers[order, 0] >= now["last"]]  # older than what has been seen
        if not len(order):
            return []
        c = dict(zip(NUMBERS, numbers[order].T)) | {k: np.concatenate([p[k].to_numpy(object) for p in parts])[order] for k in ("state", "raw_ts", "name")}
        c["active"], terminal = (np.array([x in kinds for x in c["state"]], bool) for kinds in (ACTIVE, TERMINAL))
        c["told"] = ~pd.isna(c["name"])
        c["place"] = c["lat"] + c["lng"]
        place, told = ~np.isnan(c["place"]), c["told"]
        carried = {"battery": _forward(c["battery_pct"], ~np.isnan(c["battery_pct"]), now["battery"]), "lat": _forward(c["lat"], place, now["lat"]), "lng": _forward(c["lng"], place, now["lng"]), "at": _forward(c["s"], place, now["at"]),
                   "name": _forward(c["name"], told, now["name"]), "named": _forward(c["s"], told, now["named"])}
        pause = np.diff(c["s"], prepend=c["s"][0] if now["last"] is None else now["last"]) > self.gap_s
        cuts = np.flatnonzero(pause | np.concatenate([[False], terminal[:-1]]))
        out: list[tuple] = []
        for a, b in zip([0, *cuts], [*cuts, len(order)]):
            if a == b:
                continue
            if pause[a] and now["start"] is not None:
                out += self._close(now, now["end"], "data-gap")
            self._island(now, c, a, b, carried)
            if terminal[b - 1] and now["start"] is not None:
                out += self._close(now, c["s"][b - 1], c["state"][b - 1])
        now.update(last=c["s"][-1], **{k: _value(carried[k][-1]) for k in ("battery", "lat", "lng", "at", "name", "named")})
        return out


def stream_charging(samples: DataFrame, costs: DataFrame | None = None, tags: DataFrame | None = None, gap_s: float = 1800.0, sustained_s: float = 60.0, fallback_s: float = 900.0, delay: str = "1 hour") -> DataFrame:
    """Charging sessions as they end, with all columns of charging_sessions, their curve, and costs and tags from tables.

    Expects t (timestamp), s, pos, state, energy_kwh, power_kw, rate_mph, battery_pct, lat, lng, name, raw_ts. The state of a
    vehicle is a row with the curve of its open session; a time-out ends a session after the pause. Samples
    count in order of time; older ones than were seen are dropped. The RocksDB state store keeps states off the heap.
    """
    kind = samples.schema["vehicle_id"].dataType.simpleString()
    processor = ChargingProcessor(gap_s, sustained_s, fallback_s)
    rows = samples.withWatermark("t", delay).select("vehicle_id", "t", "pos", F.array(*(F.coalesce(F.col(c).cast("double"), F.lit(float("nan"))) for c in NUMBERS)).alias("x"), "state", "raw_ts", "name")
    out = rows.groupBy("vehicle_id").applyInPandasWithState(processor, f"vehicle_id {kind}, {SESSION}", f"{STATE}, curve array<double>", "append", GroupStateTimeout.EventTimeTimeout)
    out = out.select(
        "vehicle_id", "session_no", F.concat(F.lit("charge-"), number_text(F.col("start_s")), F.lit("-"), F.col("session_no").cast("string")).alias("session_id"), "start_s", "end_s", F.greatest(F.col("end_s") - F.col("start_s"), F.lit(0.0)).alias("duration_s"),
        "start_battery", "end_battery", "energy_kwh", "peak_kw", "lat", "lng", "location_name", "end_reason", "cost_key", "curve")
    return out if costs is None else session_costs_tags(out, costs, tags)


def merge_drives(path: str, every: int = 10):
    """A foreachBatch function that keeps drives (vehicle_id, start_ms, duration_ms) by their key in Parquet.

    A batch writes its drives under its number, so a repeated batch overwrites itself. Every
    tenth one also writes all valid drives as a new base and takes the files before it away, so
    readers list few files. Of a drive that is sent again the last batch's value counts.
    """

    def of(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        rows = batch.groupBy("vehicle_id", "start_ms").agg(F.max("duration_ms").alias("duration_ms"))
        rows.write.mode("overwrite").parquet(f"{path}/batch={number}")
        if number % every == every - 1:
            _valid(spark, path).write.mode("overwrite").parquet(f"{path}/base={number}")
            fs, at = _folder(spark, path)
            for name, n in _parts(fs, at):
                if n < number or name == "batch" and n == number:
                    fs.delete(spark._jvm.org.apache.hadoop.fs.Path(f"{path}/{name}={n}"), True)

    return of


def _folder(spark: SparkSession, path: str):
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()), at


def _parts(fs, at) -> list[tuple[str, int]]:
    """(kind, number) of the finished folders of a store of drives."""
    done = [f.getPath().getName() for f in fs.listStatus(at) if "=" in f.getPath().getName() and any(x.getPath().getName() == "_SUCCESS" for x in fs.listStatus(f.getPath()))]
    return sorted((name.split("=")[0], int(name.split("=")[1])) for name in done)


def _valid(spark: SparkSession, path: str) -> DataFrame:
    """The drives of the last base and of the batches after it, each with its last value."""
    parts = _parts(*_folder(spark, path))
    base = max((n for name, n in parts if name == "base"), default=-1)
    used = ([("base", base)] if base >= 0 else []) + [x for x in parts if x[0] == "batch" and x[1] > base]
    rows = None
    for name, n in used:
        part = spark.read.parquet(f"{path}/{name}={n}").select("vehicle_id", "start_ms", "duration_ms", F.lit(n).alias("number"))
        rows = part if rows is None else rows.unionByName(part)
    return rows.groupBy("vehicle_id", "start_ms").agg(F.max_by("duration_ms", "number").alias("duration_ms"))


def read_totals(spark: SparkSession, path: str) -> DataFrame:
    """vehicle_id, drives, duration_ms: sums over the valid drives."""
    return _valid(spark, path).groupBy("vehicle_id").agg(F.count(F.lit(1)).alias("drives"), F.sum("duration_ms").alias("duration_ms"))
