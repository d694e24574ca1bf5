"""Pieces of DuckDB text for the oracles."""

from __future__ import annotations


def jr(x: str) -> str:
    return f"(floor({x}) + CASE WHEN ({x}) - floor({x}) >= 0.5 THEN 1e0 ELSE 0e0 END)"


def r1(x: str) -> str:
    return f"({jr(f'({x}) * 1e1')} / 1e1)"


def r2(x: str) -> str:
    return f"({jr(f'({x}) * 1e2')} / 1e2)"


def pct(a: str, b: str) -> str:
    return f"(CASE WHEN {b} > 0 THEN {jr(f'({a}) / ({b}) * 1e3')} / 1e1 ELSE 0e0 END)"


def rad(x: str) -> str:
    return f"(({x}) * pi() / 180e0)"


def geo(a: str, b: str, c: str, d: str) -> str:
    """Metres on the ellipsoid between (a, b) and (c, d)."""
    f = "(1e0 / 298.257223563e0)"
    u = lambda x: f"atan((1e0 - {f}) * tan({rad(x)}))"
    b1, b2 = u(a), u(c)
    p, q = f"(({b1} + {b2}) / 2e0)", f"(({b2} - {b1}) / 2e0)"
    half = f"sin({rad(f'({d}) - ({b})')} / 2e0)"
    h = f"(sin({q}) * sin({q}) + cos({b1}) * cos({b2}) * {half} * {half})"
    s = f"(2e0 * atan2(sqrt({h}), sqrt(greatest(1e0 - {h}, 0e0))))"
    x = f"(({s} - sin({s})) * (sin({p}) * sin({p}) * cos({q}) * cos({q})) / greatest(1e0 - {h}, 1e-12))"
    y = f"(({s} + sin({s})) * (cos({p}) * cos({p}) * sin({q}) * sin({q})) / greatest({h}, 1e-12))"
    return f"(CASE WHEN {a} IS NULL OR {c} IS NULL THEN NULL WHEN {a} = {c} AND {b} = {d} THEN 0e0 ELSE 6378137e0 * ({s} - ({f} / 2e0) * ({x} + {y})) END)"


def hav(a: str, b: str, c: str, d: str) -> str:
    s1, s2 = f"sin({rad(f'({c}) - ({a})')} / 2e0)", f"sin({rad(f'({d}) - ({b})')} / 2e0)"
    h = f"({s1} * {s1} + cos({rad(a)}) * cos({rad(c)}) * {s2} * {s2})"
    return f"(6371000e0 * 2e0 * atan2(sqrt({h}), sqrt(1e0 - {h})))"


def gaps(table: str, gap: int, name: str) -> str:
    """The table with a count of its pauses."""
    return f"""(SELECT * EXCLUDE (_n), CAST(sum(_n) OVER (PARTITION BY vehicle_id ORDER BY t_ms, seq) AS BIGINT) AS {name} FROM
  (SELECT *, CASE WHEN coalesce(t_ms - lag(t_ms) OVER (PARTITION BY vehicle_id ORDER BY t_ms, seq) > {gap}, true) THEN 1 ELSE 0 END AS _n FROM {table}))"""


#: drv: clips with drive_id; pts: a point per clip with idx; st: with the step from the point before.
DRIVES = f"""drv AS {gaps('clips', 300000, 'drive_id')},
spans AS (SELECT d.*, CASE WHEN source = 'sei' AND nx - t_ms BETWEEN 1 AND 60000 THEN nx - t_ms ELSE 60000 END AS span_ms FROM
  (SELECT drv.*, min(CASE WHEN source = 'sei' THEN t_ms END) OVER (PARTITION BY vehicle_id ORDER BY t_ms, seq ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS nx FROM drv) d),
pts AS (SELECT *, t_ms + span_ms AS end_t_ms, row_number() OVER (PARTITION BY vehicle_id, drive_id ORDER BY t_ms, seq) - 1 AS idx FROM spans),
lagged AS (SELECT *, lag(lat) OVER w AS plat, lag(lng) OVER w AS plng, lag(t_ms) OVER w AS pt, lag(ap) OVER w AS pap FROM pts WINDOW w AS (PARTITION BY vehicle_id, drive_id ORDER BY idx)),
st AS (SELECT *, {geo('plat', 'plng', 'lat', 'lng')} AS d_m, t_ms - pt AS dt_ms FROM lagged)"""
