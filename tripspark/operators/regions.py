"""Regions of occupied grid cells that touch."""

from __future__ import annotations

import tempfile

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """The cluster's shared checkpoint folder; where none is set one of our own in local mode, as in tests, else an error."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if folder is None:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = tempfile.mkdtemp(prefix="spark-checkpoint-")
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(folder)
    return folder


def _name(r: Column, c: Column) -> Column:
    """A cell's name; names are ordered as rows and columns are."""
    return F.concat_ws(":", *(F.lpad((x + 1_000_000).cast("string"), 8, "0") for x in (r, c)))


def least_linked(links: DataFrame) -> DataFrame:
    """(u, v): for each end of the links (u above v) but the least of its chain, that least one.

    In turns the larger and the smaller neighbours of a cell move to its least
    neighbour, until nothing changes; the rounds grow with the logarithm of the
    longest chain.
    """
    now, before = links.distinct().checkpoint(), None
    while True:
        seen = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if seen == before or seen[0] == 0:
            return now
        before = seen
        around = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = around.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")).checkpoint()
        large = around.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct().checkpoint()
        low = large.groupBy("u").agg(F.min("v").alias("m")).checkpoint()
        moved = large.join(low, "u").where("v > m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        now = moved.unionByName(low.select("u", F.col("m").alias("v"))).distinct().checkpoint()


def link_cells(rows: DataFrame, degrees: float) -> DataFrame:
    """Adds ``region``: the least cell reachable over neighbouring occupied cells, over any number of them.

    Cells are few beside rows.
    """
    shared_folder(rows.sparkSession)
    at = lambda c: F.floor(F.col(c) / degrees).cast("bigint")
    tagged = rows.withColumns({"_r": at("lat"), "_c": at("lng")})
    cells = tagged.select("_r", "_c").distinct().withColumn("u", _name(F.col("_r"), F.col("_c"))).checkpoint()
    # half of a cell's neighbours; the others are linked from their side
    near = F.array(*(F.struct((F.col("_r") + r).alias("_r"), (F.col("_c") + c).alias("_c")) for r, c in ((-1, -1), (-1, 0), (-1, 1), (0, -1))))
    reach = cells.select("u", F.explode(near).alias("n")).select("u", "n._r", "n._c")
    links = reach.join(cells.select("_r", "_c", F.col("u").alias("v")), ["_r", "_c"]).select("u", "v")
    found = least_linked(links)
    own = cells.join(found, "u", "left").select("_r", "_c", F.coalesce("v", "u").alias("region"))
    return tagged.join(own, ["_r", "_c"]).drop("_r", "_c")
