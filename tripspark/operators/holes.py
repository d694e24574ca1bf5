"""Recording holes filled with event clips."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

ORDER = ("t_ms", "seq")


def thin_30s(candidates: DataFrame, recent: DataFrame, gap_ms: int = 30_000, window_ms: int = 1_800_000) -> DataFrame:
    """Candidates (vehicle_id, t_ms, path, seq) left after thinning.

    One at most ``gap_ms`` after the last ordinary clip goes; of the rest, in order
    of time and path, one stays only if it is more than ``gap_ms`` after the last
    that stayed. The carried state cannot reach across a pause longer than
    ``window_ms``, so the fold runs over one array per vehicle and such window.
    """
    both = candidates.select("vehicle_id", "t_ms", "path", "seq").unionByName(recent.select("vehicle_id", "t_ms", F.lit(None).cast("string").alias("path"), F.lit(None).cast("bigint").alias("seq")))
    upto = Window.partitionBy("vehicle_id").orderBy("t_ms").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    free = both.withColumn("_r", F.max(F.when(F.col("path").isNull(), F.col("t_ms"))).over(upto))
    free = free.where(F.col("path").isNotNull() & (F.col("_r").isNull() | (F.col("t_ms") - F.col("_r") > gap_ms))).drop("_r")
    ordered = Window.partitionBy("vehicle_id").orderBy("t_ms", "path", "seq")
    new = F.coalesce(F.col("t_ms") - F.lag("t_ms").over(ordered) > window_ms, F.lit(True))
    free = free.withColumn("_w", F.sum(new.cast("int")).over(ordered))
    rows = free.groupBy("vehicle_id", "_w").agg(F.sort_array(F.collect_list(F.struct("t_ms", "path", "seq"))).alias("c"))
    kept = F.expr(
        f"aggregate(c, named_struct('last', cast(null as bigint), 'out', cast(array() as array<struct<t_ms:bigint,path:string,seq:bigint>>)), "
        f"(a, x) -> if(a.last is null or x.t_ms - a.last > {gap_ms}, named_struct('last', x.t_ms, 'out', array_append(a.out, x)), a)).out"
    )
    return rows.select("vehicle_id", F.explode(kept).alias("k")).select("vehicle_id", "k.t_ms", "k.path", "k.seq")


def _thinned(free: DataFrame, gap_ms: int, window_ms: int, key: tuple[str, ...]) -> DataFrame:
    """The rows left of candidates that no ordinary clip covers, in order of time and path: each more than ``gap_ms`` after the last that stayed."""
    ordered = Window.partitionBy(*key).orderBy("t_ms", "path", "seq")
    rows = free.withColumn("_w", F.sum(F.coalesce(F.col("t_ms") - F.lag("t_ms").over(ordered) > window_ms, F.lit(True)).cast("int")).over(ordered))
    listed = rows.groupBy(*key, "_w").agg(F.sort_array(F.collect_list(F.struct("t_ms", "path", "seq", F.struct(*free.columns).alias("row")))).alias("c"))
    kind = listed.schema["c"].dataType.simpleString()
    kept = F.expr(
        f"aggregate(c, named_struct('last', cast(null as bigint), 'out', cast(array() as {kind})), "
        f"(a, x) -> if(a.last is null or x.t_ms - a.last > {gap_ms}, named_struct('last', x.t_ms, 'out', array_append(a.out, x)), a)).out")
    return listed.select(F.explode(kept).alias("k")).select("k.row.*")


def fill_holes(clips: DataFrame, min_ms: int = 90_000, max_ms: int = 1_800_000, hop_ms: int = 180_000, thin_ms: int = 30_000, key: tuple[str, ...] = ("vehicle_id",)) -> DataFrame:
    """Ordinary clips and the admitted event clips (``filled``). Expects vehicle_id, t_ms, seq, path, is_event, driving.

    A thinned candidate is admitted if it lies strictly inside a hole of more than
    ``min_ms`` up to ``max_ms`` between ordinary clips, or if hops of at most
    ``hop_ms`` chain it to an ordinary clip and the nearest one is within ``max_ms``.
    All steps keep the rows of a ``key`` together: one shuffle, no join. With windows of
    time_windows as a part of the key the answer is the same and a heavy vehicle spreads.
    """
    by, columns = Window.partitionBy(*key), clips.columns
    # as-of on times, so that clips at the same instant see each other
    upto = by.orderBy("t_ms").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    down = by.orderBy(F.desc("t_ms")).rangeBetween(Window.unboundedPreceding, Window.currentRow)
    at = F.when(~F.col("is_event"), F.col("t_ms"))
    rows = clips.withColumn("_p", F.max(at).over(upto)).where(F.expr(f"NOT is_event OR (driving AND (_p IS NULL OR t_ms - _p > {thin_ms}))"))
    # the candidates that stay bring their rows along, so no join looks them up
    kept = _thinned(rows.where("is_event").select(*columns), thin_ms, max_ms, key)
    rows = rows.where("NOT is_event").select(*columns).unionByName(kept)
    rows = rows.withColumns({"_p": F.max(at).over(upto), "_n": F.min(at).over(down)})
    rows = rows.withColumn("_isl", F.sum(F.coalesce(F.col("t_ms") - F.lag("t_ms").over(by.orderBy(*ORDER)) > hop_ms, F.lit(True)).cast("int")).over(by.orderBy(*ORDER)))
    rows = rows.withColumn("_has", F.max((~F.col("is_event")).cast("int")).over(Window.partitionBy(*key, "_isl")))
    before, after = F.col("t_ms") - F.col("_p"), F.col("_n") - F.col("t_ms")
    hole = (before > 0) & (after > 0) & (before + after > min_ms) & (before + after <= max_ms)
    near = F.least(F.coalesce(before, F.lit(1 << 60)), F.coalesce(after, F.lit(1 << 60))) <= max_ms
    admitted = ~F.col("is_event") | F.coalesce(hole, F.lit(False)) | ((F.col("_has") == 1) & near)
    return rows.where(admitted).select(*columns, F.col("is_event").alias("filled"))
