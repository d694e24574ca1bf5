"""A store of clips and drives that grows by batches: only the work windows that new clips touch are grouped again.

No rule of the main flow reaches across a pause of more than 30 minutes, so new
clips can change the drives of the windows within 30 minutes of them and of no
others. The store holds the clips of each batch, the drives that each batch
worked out, and a table of windows that says which batch's drives are valid for
each. A batch appends files and ends with a new version of that table, its
commit; files of windows that are not touched are neither read nor written.

    <path>/clips/batch=N   <path>/drives/batch=N   <path>/windows/version=N
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tripspark.operators import clips as C, sessions
from tripspark.operators.drives import clips_to_drives
from tripspark.operators.intervals import points_in_spans, touching
from tripspark.operators.points import DRIVE

PAUSE_MS = 1_800_000
#: What tells which stored clips are worked out again.
TAKEN = ("vehicle_id", "seq", "path", "t_ms", "batch")


def latest_version(spark: SparkSession, path: str) -> int:
    """The last committed version; 0 for a store that does not exist."""
    jvm = spark._jvm
    folder = jvm.org.apache.hadoop.fs.Path(f"{path}/windows")
    fs = folder.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(folder):
        return 0
    done = [f.getPath() for f in fs.listStatus(folder) if fs.exists(jvm.org.apache.hadoop.fs.Path(f.getPath(), "_SUCCESS"))]
    return max((int(p.getName().split("=")[1]) for p in done), default=0)


def windows(spark: SparkSession, path: str, version: int) -> DataFrame:
    """vehicle_id, from_ms, to_ms, batch: the work windows and the batch whose drives are valid for each."""
    return spark.read.parquet(f"{path}/windows/version={version}")


def current_drives(spark: SparkSession, path: str) -> DataFrame:
    """The valid drives of the store, with window_ms (start of their window) and batch (that worked them out)."""
    now = windows(spark, path, latest_version(spark, path)).select("vehicle_id", F.col("from_ms").alias("window_ms"), "batch")
    return spark.read.parquet(f"{path}/drives").join(now, ["vehicle_id", "window_ms", "batch"], "left_semi")


def touched_windows(stored: DataFrame, fresh: DataFrame, pause_ms: int = PAUSE_MS) -> DataFrame:
    """Stored windows (vehicle_id, from_ms, to_ms, batch) that clips (vehicle_id, seq, t_ms) lie in or within ``pause_ms`` of."""
    near = sessions.time_windows(fresh.select("vehicle_id", "seq", "t_ms"), pause_ms).groupBy("vehicle_id", "window_id").agg((F.min("t_ms") - pause_ms).alias("n_from"), (F.max("t_ms") + pause_ms).alias("n_to"))
    pairs = touching(stored, near.drop("window_id"), ("from_ms", "to_ms"), ("n_from", "n_to"))
    return pairs.where("from_ms <= n_to AND to_ms >= n_from").select(*stored.columns).distinct()


def add_clips(path: str, fresh: DataFrame, tags: DataFrame | None = None, tz: str = "UTC", **options) -> int:
    """Adds a batch of clips (as of read_routes) and brings the drives of the windows they touch up to date; returns the version.

    A clip of a known path replaces the one the store has; within a batch the first one
    counts. Clips without path or time are kept out. A batch that fails leaves no trace
    in what is read, and its number is used again.
    """
    spark = fresh.sparkSession
    number = latest_version(spark, path) + 1
    # one shuffle of whole clips, by vehicle, for what finds copies and for the files
    fresh = C.dedup_clips(fresh.where("path IS NOT NULL AND t_ms IS NOT NULL").repartition("vehicle_id"))
    fresh.sortWithinPartitions("vehicle_id", "t_ms").write.mode("overwrite").parquet(f"{path}/clips/batch={number}")
    clips, only, kept = spark.read.parquet(f"{path}/clips/batch={number}"), None, None
    slim = clips.select("vehicle_id", "seq", "t_ms")
    if number > 1:
        stored = windows(spark, path, number - 1)
        touched = touched_windows(stored, slim).checkpoint()
        clips = spark.read.parquet(f"{path}/clips").where(F.col("batch") <= number)
        slim = taken_clips(clips.select(*TAKEN), touched, number).checkpoint()
        clips, only = clips_of(clips, slim)
        kept = stored.join(touched.select("vehicle_id", "from_ms"), ["vehicle_id", "from_ms"], "left_anti")
    out = clips_to_drives(clips.drop("batch"), tags, tz, only=only, **options)
    # every clip that was read tells its window, also those that make no drive
    spans = sessions.time_windows(slim.select("vehicle_id", "seq", "t_ms"), PAUSE_MS)
    spans = spans.groupBy("vehicle_id", "window_id").agg(F.min("t_ms").alias("from_ms"), F.max("t_ms").alias("to_ms")).drop("window_id").checkpoint()
    # a drive may begin up to a minute into the last clip of its window
    reach = spans.withColumn("end_ms", F.col("to_ms") + 60_000)
    placed = points_in_spans(out["drives"].select(*DRIVE, "start_ms"), "start_ms", reach, ("from_ms", "end_ms"))
    placed = placed.where("start_ms >= from_ms AND start_ms < end_ms").select(*DRIVE, F.col("from_ms").alias("window_ms"))
    out["drives"].join(placed, list(DRIVE)).drop("drive_id").write.mode("overwrite").parquet(f"{path}/drives/batch={number}")
    new = spans.withColumn("batch", F.lit(number))
    (new if kept is None else kept.unionByName(new.select(*kept.columns))).write.mode("overwrite").parquet(f"{path}/windows/version={number}")
    return number


def taken_clips(clips: DataFrame, touched: DataFrame, number: int) -> DataFrame:
    """Of the store's clips (TAKEN) those of batch ``number`` and, of the touched windows, the last of each path that it has not.

    Slim rows only: what is joined and copied here are no arrays.
    """
    fresh, before = clips.where(F.col("batch") == number), clips.where(F.col("batch") < number)
    inside = points_in_spans(before, "t_ms", touched.select("vehicle_id", "from_ms", "to_ms"), ("from_ms", "to_ms"))
    again = inside.where("t_ms BETWEEN from_ms AND to_ms").select(*TAKEN)
    again = newest(again.join(fresh.select("vehicle_id", "path"), ["vehicle_id", "path"], "left_anti"), before)
    return fresh.select(*TAKEN).unionByName(again.select(*TAKEN)).drop("path")


def clips_of(clips: DataFrame, taken: DataFrame, few: int = 100_000) -> tuple[DataFrame, DataFrame | None]:
    """(clips, only) for clips_to_drives: up to ``few`` taken clips are picked from the store by a broadcast.

    More are not: the store's clips would be shuffled for it and then again to their drives. All pass on,
    and ``only`` tells which count; clips of a number that another batch has taken go before.
    """
    key = ["vehicle_id", "seq", "batch"]
    if taken.count() <= few:
        return clips.join(F.broadcast(taken.select(*key)), key, "left_semi"), None
    named = taken.select("vehicle_id", "seq", F.col("batch").alias("_b"))
    stale = clips.select(*key).join(named, ["vehicle_id", "seq"]).where("batch <> _b").select(*key).checkpoint()
    n = stale.count()
    if n:
        clips = clips.join(F.broadcast(stale) if n <= few else stale, key, "left_anti")
    return clips, taken.select("vehicle_id", "seq")


def newest(clips: DataFrame, known: DataFrame) -> DataFrame:
    """Of the clips of a path those of the last batch that had it."""
    last = known.groupBy("vehicle_id", "path").agg(F.max_by(F.struct("seq", "batch"), "batch").alias("_l"))
    return clips.join(last.select("vehicle_id", "path", "_l.*"), ["vehicle_id", "path", "seq", "batch"], "left_semi")
