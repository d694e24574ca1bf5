"""Mixing sources to target weights by Pfair scheduling.

Every source is cut into blocks of documents. Block j (from 0) of a source with
weight e / Q may start from slot floor(j Q / e) and is due by slot ceil((j + 1) Q / e);
one block runs in each slot, the one that is due earliest among those that may
start. The weights add up to one, so every block keeps its deadline and after any
number of slots each source is less than one block from its weight.

Weights are rounded to multiples of 1/Q, so the schedule repeats every Q slots:
one frame of Q rows is worked out once and broadcast (Q is a parameter; it grows
only with the number of sources, which is checked). Where a document goes is then
arithmetic on its rank within its source, and ranks come from counts of hashed
parts, so that no source, however large, passes through one task.

The stream ends when every source has been read whole once; sources that need
more blocks than they have until then begin anew (``epoch``). No row is dropped.
"""

from __future__ import annotations

import heapq
import math

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tripspark.llm.common import cut, documents, free_name

MAX_SOURCES = 16_384
#: Rows of a part within which ranks are counted, while that makes at most MAX_PARTS parts.
PART_ROWS, MAX_PARTS = 256, 100_000
ADDED = ("source_block", "epoch", "slot", "release", "deadline", "place")


def shares_of(weights: list[float], slots: int) -> list[int]:
    """Whole numbers of slots, at least 1 each and ``slots`` together, nearest to the weights (largest remainders)."""
    total = sum(weights)
    spare = slots - len(weights)
    exact = [w / total * slots for w in weights]
    base = [max(1, int(x)) for x in exact]
    over = sum(base) - slots
    for k in sorted(range(len(base)), key=lambda k: -base[k]):  # the ones put up to 1 are paid for by the largest
        take = min(max(0, over), base[k] - 1)
        base[k] -= take
        over -= take
    for k in sorted(range(len(base)), key=lambda k: base[k] - exact[k])[: max(0, -over)]:
        base[k] += 1
    assert sum(base) == slots and spare >= 0
    return base


def frame(shares: list[int]) -> list[tuple[int, int, int]]:
    """(source, block, slot) of one frame: earliest deadline first, of equal ones the first source."""
    slots = sum(shares)
    waiting = sorted((0, k, 0) for k in range(len(shares)))
    heapq.heapify(waiting)
    ready: list[tuple[int, int, int]] = []
    out = []
    for slot in range(slots):
        while waiting and waiting[0][0] <= slot:
            _, k, j = heapq.heappop(waiting)
            heapq.heappush(ready, (-(-(j + 1) * slots // shares[k]), k, j))
        due, k, j = heapq.heappop(ready)
        assert slot < due
        out.append((k, j, slot))
        if j + 1 < shares[k]:
            heapq.heappush(waiting, ((j + 1) * slots // shares[k], k, j + 1))
    return out


def _scheduled(docs: DataFrame, weights: dict[str | None, float] | None, exponent: float, block_docs: int, slots: int, id_col: str, source_col: str) -> DataFrame:
    """(row, source_block, epoch, slot, release, deadline, place): the rows of ``docs`` as structs, so that their columns cannot clash with ours."""
    spark = docs.sparkSession
    if weights is not None and any(not 0 < w < math.inf for w in weights.values()):
        raise ValueError("weights must be positive")
    counts = sorted(docs.groupBy(F.col(source_col).alias("source")).count().limit(MAX_SOURCES + 1).collect(), key=lambda r: (r.source is not None, r.source))
    if len(counts) > MAX_SOURCES:
        raise ValueError(f"more than {MAX_SOURCES} sources")
    slots = max(slots, 8 * len(counts))
    if weights is None:
        wanted = [r["count"] ** exponent for r in counts]
    else:
        wanted = [weights.get(r.source, min(weights.values(), default=1.0)) for r in counts]
    shares = shares_of(wanted, slots) if counts else []
    plan = frame(shares)
    at: list[list[int]] = [[] for _ in counts]
    for k, _, slot in plan:
        at[k].append(slot)
    blocks = [-(-r["count"] // block_docs) for r in counts]
    end = max(((b - 1) // e * slots + at[k][(b - 1) % e] + 1 for k, (b, e) in enumerate(zip(blocks, shares))), default=0)
    total = sum(r["count"] for r in counts)
    part_rows = max(PART_ROWS, -(-total // MAX_PARTS))
    table = [
        (r.source, k, e, b, end // slots * e + sum(s < end % slots for s in at[k]), -(-r["count"] // part_rows))
        for k, (r, e, b) in enumerate(zip(counts, shares, blocks))
    ]
    sources = spark.createDataFrame(table, "_source string, _k int, _share bigint, _blocks bigint, _runs bigint, _parts bigint")
    schedule = spark.createDataFrame([(k, j, s) for k, j, s in plan], "_k int, _j bigint, _at bigint")

    rows = docs.select(F.struct(*docs.columns).alias("row"), F.col(id_col).alias("_id"), F.col(source_col).alias("_of"))
    rows = rows.join(F.broadcast(sources), F.col("_of").eqNullSafe(F.col("_source"))).drop("_source", "_of")  # at most MAX_SOURCES rows
    rows = rows.withColumn("_hash", F.xxhash64(F.lit(4), F.col("_id")))
    rows = rows.withColumn("_part", F.pmod("_hash", "_parts"))
    sizes = rows.groupBy("_k", "_part").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy("_k").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    sizes = cut(sizes.select("_k", "_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before")))  # at most MAX_PARTS + sources rows
    rank = F.row_number().over(Window.partitionBy("_k", "_part").orderBy("_hash", "_id")) - 1
    rows = rows.withColumn("_rank", rank).join(F.broadcast(sizes), ["_k", "_part"]).withColumn("_rank", F.col("_rank") + F.col("_before"))
    rows = rows.withColumn("source_block", F.expr(f"_rank div {block_docs}")).withColumn("place", (F.col("_rank") % block_docs).cast("bigint"))
    rows = rows.withColumn("epoch", F.explode(F.expr("sequence(0L, (_runs - 1 - source_block) div _blocks)")))
    rows = rows.withColumn("_run", F.col("epoch") * F.col("_blocks") + F.col("source_block")).withColumn("_j", F.expr("_run % _share"))
    rows = rows.join(F.broadcast(schedule), ["_k", "_j"])
    return rows.select(
        "row", "source_block", "epoch",
        F.expr(f"_run div _share * {slots} + _at").alias("slot"),
        F.expr(f"_run * {slots} div _share").alias("release"),
        F.expr(f"((_run + 1) * {slots} + _share - 1) div _share").alias("deadline"),
        "place",
    )


def mix_sources(
    docs: DataFrame, weights: dict[str | None, float] | None = None, exponent: float = 0.8, block_docs: int = 64, slots: int = 1024, id_col: str = "doc_id", source_col: str = "source"
) -> DataFrame:
    """The rows of ``docs`` with source_block, epoch, slot, release, deadline and place (within the block).

    ``weights``: target weight by source (positive, else an error; a source left out
    weighs as the least one given, with no weights at all the sources weigh the same);
    without it, the number of rows to the power ``exponent``. Order by slot and place
    for the mixed stream. Within a source the order is a hash's, of equal ids any.
    A null source is a source of its own. Rows that repeat an id are rows of their
    own. More than MAX_SOURCES sources are an error. An empty table gives no rows.
    Columns named as the added ones are replaced; other names cannot clash.
    """
    mixed = _scheduled(docs, weights, exponent, block_docs, slots, id_col, source_col)
    own = [c for c in docs.columns if c.lower() not in ADDED]
    return mixed.select(*(F.col("row").getField(c).alias(c) for c in own), *ADDED[:-1], "place")


def mixed_stream(
    docs: DataFrame, weights: dict[str | None, float] | None = None, exponent: float = 0.8, block_docs: int = 64, slots: int = 1024, id_col: str = "doc_id", source_col: str = "source"
) -> DataFrame:
    """The mixed rows with the columns of ``docs`` and nothing else, dealt into partitions in the order of the stream and sorted within them.

    All columns keep their values, whatever their names. Nulls, repeated rows and
    empty tables as in mix_sources; written as files, ``stream_position`` gives the order.
    """
    mixed = _scheduled(docs, weights, exponent, block_docs, slots, id_col, source_col)
    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return mixed.repartitionByRange(n, "slot", "place").sortWithinPartitions("slot", "place").select("row.*")


def stream_position(docs: DataFrame) -> DataFrame:
    """``docs``, read from the files of a written stream, with stream_part and stream_row: the number of the file and the row in it.

    Ordered by both the rows are in the order of the stream, however Spark packs the
    files into partitions. Of rows that were not read from files both are null. A
    column of either name is replaced.
    """
    names = {c.lower() for c in docs.columns}
    try:
        where = docs.select("*", F.col("_metadata").alias(free_name(docs, "file_metadata"))) if "_metadata" not in names else None
        where and where.schema
    except AnalysisException:
        where = None
    own = [c for c in docs.columns if c.lower() not in ("stream_part", "stream_row")]
    if where is None:
        return docs.select(*own, F.lit(None).cast("int").alias("stream_part"), F.lit(None).cast("bigint").alias("stream_row"))
    file = where[where.columns[-1]]
    return where.select(*own, F.regexp_extract(file["file_name"], r"part-(\d+)", 1).try_cast("int").alias("stream_part"), file["row_index"].alias("stream_row"))


def op4_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_sources(documents(spark, sf_dir).select("doc_id", "source"))
