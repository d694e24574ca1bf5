"""What the text operators share."""

from __future__ import annotations

import ctypes
import gc
import tempfile
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: ASCII white space: blank, and U+0009 to U+000D.
WS = " \t\n\x0b\x0c\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z and nothing else. Pure ASCII takes the built-in's byte-wise path."""
    is_ascii = F.octet_length(text) == F.char_length(text)
    return F.when(is_ascii, F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def checkpoint_folder(spark: SparkSession) -> str:
    """The shared folder of the cluster; where none is set a folder of our own in local mode, else an error."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder is None:
        folder = spark.sparkContext.getCheckpointDir()
    if folder is None:
        if not spark.sparkContext.master.split("[")[0] == "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = tempfile.mkdtemp(prefix="spark-checkpoint-")
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(folder)
    return folder


def remove_folder(spark: SparkSession, folder: str) -> None:
    """Delete a folder of the shared store that nothing reads any more."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def cut(df: DataFrame) -> DataFrame:
    """Cut the lineage: the rows go to the shared checkpoint folder and are read from there."""
    checkpoint_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def free_name(df: DataFrame, like: str) -> str:
    """A column name that ``df`` has not, in any case of letters."""
    taken = {c.lower() for c in df.columns}
    while like.lower() in taken:
        like += "_"
    return like


def small_batches(df: DataFrame, rows: int = 1000) -> None:
    """Arrow batches of documents hold thousands of characters a row: fewer rows a batch than Spark's 10 000, unless the user chose."""
    conf, key = df.sparkSession.conf, "spark.sql.execution.arrow.maxRecordsPerBatch"
    if conf.get(key) == "10000":
        conf.set(key, str(rows))


def free_memory() -> None:
    """At the end of a Python task: give what its tables took back, as workers live on and hold it else."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)  # of the GNU library only
    except (OSError, AttributeError):
        pass


_HELD: dict[tuple, object] = {}


def hold(key: tuple, build: Callable[[], object] = lambda: None) -> object:
    """The one model that a Python worker keeps from task to task: that of its last task. Any other is dropped."""
    if key not in _HELD:
        _HELD.clear()
        free_memory()
        _HELD[key] = build()
    return _HELD[key]
