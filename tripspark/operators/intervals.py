"""Interval joins as equi-joins on dyadic blocks of time.

An interval is covered by blocks of 2^k units that lie at multiples of their
length, as few as can be: at most two of a length, so an interval of n units has at
most 2 log2(n) blocks, however long it is. A point lies in one block of each
length, so it meets an interval that holds it in exactly one block. Of two
intervals that overlap one holds the start of the other, so their join is two joins
of points with intervals, in which each pair comes up once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

HOUR = 3_600_000
#: Lengths of blocks: 2^22 hours are 478 years; times beyond are drawn in to the ends.
LEVELS = 22


def unit_of(at: Column, unit_ms: int = HOUR) -> Column:
    """The number of the unit that holds a time, from 0."""
    half = 1 << (LEVELS - 1)
    return (F.floor(F.greatest(F.lit(-float(half)), F.least(at / float(unit_ms), F.lit(half - 1.0)))) + half).cast("bigint")


def cover(start: Column, end: Column, unit_ms: int = HOUR) -> Column:
    """array<struct<_k,_m>>: the fewest blocks (length 2^_k, number _m) over the units that [start, end] touches; an end before the start counts as the start.

    From the shortest length up: a first block that is a right half and a last one
    that is a left half cannot be part of a longer one and are taken.
    """
    none = F.array().cast("array<struct<_k:int,_m:bigint>>")

    def up(a: Column, k: Column) -> Column:
        first, last, open_ = a["f"], a["l"], a["f"] <= a["l"]
        odd, even = open_ & (first % 2 == 1), open_ & (last % 2 == 0)
        block = lambda on, m: F.when(on, F.array(F.struct(k.cast("int").alias("_k"), m.alias("_m")))).otherwise(none)
        f, l = F.when(odd, first + 1).otherwise(first), F.when(even, last - 1).otherwise(last)
        more = f <= l
        return F.struct(F.when(more, F.shiftright(f, 1)).otherwise(F.lit(1).cast("bigint")).alias("f"), F.when(more, F.shiftright(l, 1)).otherwise(F.lit(0).cast("bigint")).alias("l"), F.concat(a["o"], block(odd, first), block(even, last)).alias("o"))

    begin = F.struct(unit_of(start, unit_ms).alias("f"), F.greatest(unit_of(start, unit_ms), unit_of(end, unit_ms)).alias("l"), none.alias("o"))
    return F.aggregate(F.sequence(F.lit(0), F.lit(LEVELS)), begin, up)["o"]


def points_in_spans(points: DataFrame, at: str, spans: DataFrame, span: tuple[str, str], key: tuple[str, ...] = ("vehicle_id",), unit_ms: int = HOUR) -> DataFrame:
    """Pairs of equal key whose span touches the unit of the point: each once, and a superset of those whose span holds it.

    Points are copied for the lengths that spans have only (a table of at most LEVELS + 1 rows): for spans
    of hours that is two or three copies. No column but the key may have the same name on both sides.
    """
    s = spans.withColumn("_b", F.explode(cover(F.col(span[0]), F.col(span[1]), unit_ms))).select(*spans.columns, "_b._k", "_b._m")
    lengths = s.select("_k").distinct()
    p = points.withColumns({"_u": unit_of(F.col(at), unit_ms), "_k": F.explode(F.sequence(F.lit(0), F.lit(LEVELS)))}).join(F.broadcast(lengths), "_k", "left_semi")
    p = p.select(*points.columns, "_k", F.expr("shiftright(_u, _k)").alias("_m"))
    return p.join(s, [*key, "_k", "_m"]).drop("_k", "_m")


def touching(left: DataFrame, right: DataFrame, left_span: tuple[str, str], right_span: tuple[str, str], key: tuple[str, ...] = ("vehicle_id",), unit_ms: int = HOUR) -> DataFrame:
    """Pairs of equal key whose spans touch a unit in common: each once, and a superset of those that overlap."""
    columns = [*key, *(c for c in (*left.columns, *right.columns) if c not in key)]
    ls, rs = unit_of(F.col(left_span[0]), unit_ms), unit_of(F.col(right_span[0]), unit_ms)
    later = points_in_spans(right, right_span[0], left, left_span, key, unit_ms).where(rs >= ls)
    earlier = points_in_spans(left, left_span[0], right, right_span, key, unit_ms).where(ls > rs)
    return later.select(*columns).unionByName(earlier.select(*columns))


def overlapping(left: DataFrame, right: DataFrame, start: Column | None = None, end: Column | None = None) -> DataFrame:
    """Rows of ``left`` that overlap any of ``right`` (half-open, both ranges not empty), for a left_semi or left_anti join on ``_id``.

    Expects vehicle_id, start_ms, end_ms on both and ``_id`` on the left; start and end may widen the left range.
    """
    start, end = F.col("start_ms") if start is None else start, F.col("end_ms") if end is None else end
    l = left.select("vehicle_id", "_id", start.alias("_s"), end.alias("_e")).where("_e > _s")
    r = right.select("vehicle_id", F.col("start_ms").alias("_rs"), F.col("end_ms").alias("_re")).where("_re > _rs")
    return touching(l, r, ("_s", "_e"), ("_rs", "_re")).where("_re > _s AND _rs < _e").select("vehicle_id", "_id").distinct()
