"""Look-ups in arrays of runs: half-open frame ranges by cumulative ends."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def spans(runs: Column, value: str) -> Column:
    """Runs with their first frame ``s`` and end ``e``: array<struct<s,e,v>>."""
    empty = F.array().cast("array<struct<s:double,e:double,v:double>>")

    def step(acc: Column, r: Column) -> Column:
        end = acc["p"] + r["frames"]
        return F.struct(end.alias("p"), F.array_append(acc["o"], F.struct(acc["p"].alias("s"), end.alias("e"), r[value].cast("double").alias("v"))).alias("o"))

    return F.aggregate(runs, F.struct(F.lit(0.0).alias("p"), empty.alias("o")), step)["o"]


def overlapping(spans_: Column, start: Column, end: Column) -> Column:
    return F.filter(spans_, lambda x: (x["e"] > start) & (x["s"] < end))


def value_at_frame(spans_: Column, frame: Column) -> Column:
    """The value of the first run that ends after ``frame``; null before 0, past the end or without runs."""
    return F.when(frame >= 0, F.get(F.filter(spans_, lambda x: x["e"] > frame), F.lit(0))["v"])


def runs_span_frames(runs: Column, total: Column) -> Column:
    """Are all runs longer than nothing and ``total`` together?"""
    positive = F.forall(runs, lambda r: r["frames"] > 0)
    total_is = F.aggregate(runs, F.lit(0.0), lambda a, r: a + r["frames"]) == total
    return F.coalesce((F.size(runs) > 0) & (total > 0) & positive & total_is, F.lit(False))


def segment_max_speed(spans_: Column, start: Column, end: Column) -> Column:
    """The top speed of the runs in the segment; null if one of them has none."""
    inside = overlapping(spans_, start, end)
    known = F.forall(inside, lambda x: x["v"].isNotNull() & ~F.isnan(x["v"]))
    top = F.aggregate(inside, F.lit(0.0), lambda a, x: F.greatest(a, x["v"]))
    return F.when(F.coalesce(known, F.lit(True)), F.coalesce(top, F.lit(0.0)))


def flag_overlap(spans_: Column, start: Column, end: Column, mask: int, need_all: bool = False) -> Column:
    """Does a run that overlaps [start, end) carry a flag of the mask (or all of them)?"""
    bits = lambda x: x["v"].cast("bigint").bitwiseAND(F.lit(mask).cast("bigint"))
    return F.coalesce(F.exists(spans_, lambda x: (x["e"] > start) & (x["s"] < end) & ((bits(x) == mask) if need_all else (bits(x) != 0))), F.lit(False))


def segment_ap_frames(spans_: Column, start: Column, end: Column) -> Column:
    """struct<fsd,other,total> frames of the segment by mode (1 is FSD, 0 off, a missing one counts as other); null without any."""

    def step(a: Column, x: Column) -> Column:
        n = F.least(x["e"], end) - F.greatest(x["s"], start)
        fsd, off = F.coalesce(x["v"] == 1, F.lit(False)), F.coalesce(x["v"] == 0, F.lit(False))
        return F.struct((a["fsd"] + F.when(fsd, n).otherwise(0.0)).alias("fsd"), (a["other"] + F.when(~fsd & ~off, n).otherwise(0.0)).alias("other"), (a["total"] + n).alias("total"))

    zero = F.struct(F.lit(0.0).alias("fsd"), F.lit(0.0).alias("other"), F.lit(0.0).alias("total"))
    out = F.aggregate(overlapping(spans_, start, end), zero, step)
    return F.when(out["total"] != 0, out)
