"""Running values over ordered rows where one key may span many tasks.

A window over ``partitionBy(vehicle)`` puts all rows of a vehicle into one task. Here
the rows are dealt by ranges of (key, order), so a heavy key fills as many tasks as
its rows need. A first pass says of each part how it ends: its last key and the
running values there; those few rows, one a part, give every part the state it
begins with; a second pass works the values out. Both are single passes over
sorted rows, in numpy arrays a batch at a time.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tripspark.operators.regions import shared_folder


@dataclass
class Scan:
    """What to work out: the value of the row before (lag), the last value not null so far (last), running sums, and counts of gaps: rows that come first or whose value is more than a limit above the one before."""

    key: tuple[str, ...]
    lag: tuple[str, ...] = ()
    last: tuple[str, ...] = ()
    sums: tuple[str, ...] = ()
    gaps: dict[str, tuple[str, float]] = field(default_factory=dict)  # name -> (column, limit)

    def fields(self, schema: T.StructType) -> list[T.StructField]:
        whole = lambda c: T.DoubleType() if isinstance(schema[c].dataType, (T.DoubleType, T.FloatType)) else T.LongType()
        return [
            *(T.StructField(f"lag_{c}", schema[c].dataType) for c in self.lag), *(T.StructField(f"last_{c}", schema[c].dataType) for c in self.last),
            *(T.StructField(f"sum_{c}", whole(c)) for c in self.sums), *(T.StructField(name, T.LongType()) for name in self.gaps)]

    def before(self) -> list[str]:
        """Columns whose value at the row before is needed."""
        return list(dict.fromkeys([*self.lag, *(c for c, _ in self.gaps.values())]))

    def run(self, batch: pa.RecordBatch, state: dict | None) -> tuple[list[pa.Array], dict]:
        """The values of a batch that follows ``state``, and the state that it ends with."""
        n, col = batch.num_rows, lambda c: batch.column(batch.schema.get_field_index(c))
        at, begins = np.arange(n), np.zeros(n, bool)
        for k in self.key:
            codes = col(k).dictionary_encode(null_encoding="encode").indices.to_numpy()
            begins[1:] |= codes[1:] != codes[:-1]
        goes_on = state is not None and state["key"] == [col(k)[0].as_py() for k in self.key]
        begins[0] = not goes_on
        # where the key of each row began; -1: before this batch
        start = np.maximum.accumulate(np.where(begins, at, -1))
        end = {"key": [col(k)[n - 1].as_py() for k in self.key], "lag": {}, "last": {}, "sum": {}}
        led, out = {}, []

        def take(c: str, idx: np.ndarray, known: np.ndarray, kind: str) -> pa.Array:
            held = pa.concat_arrays([pa.array([state[kind][c] if goes_on else None], col(c).type), col(c)])
            return held.take(pa.array(idx + 1, mask=~known))

        for c in self.before():
            led[c] = take(c, at - 1, at - 1 >= start, "lag")
            end["lag"][c] = col(c)[n - 1].as_py()
        out += [led[c] for c in self.lag]
        for c in self.last:
            seen = np.maximum.accumulate(np.where(col(c).is_valid().to_numpy(zero_copy_only=False), at, -2))
            here = seen >= np.maximum(start, 0)
            out.append(take(c, np.where(here, seen, -1), here | (start < 0), "last"))
            end["last"][c] = out[-1][n - 1].as_py()

        def running(name: str, values: np.ndarray) -> pa.Array:
            total = np.cumsum(values)
            base = np.where(start > 0, total[np.maximum(start, 1) - 1], 0) - np.where(start < 0, state["sum"][name] if goes_on else 0, 0)
            end["sum"][name] = (total - base)[-1].item()
            return pa.array(total - base)

        for c in self.sums:
            out.append(running(c, col(c).fill_null(0).to_numpy(zero_copy_only=False)))
        for name, (c, limit) in self.gaps.items():
            step = col(c).to_numpy(zero_copy_only=False).astype(float) - led[c].to_numpy(zero_copy_only=False).astype(float)
            out.append(running(name, (~(step <= limit)).astype(np.int64)))
        return out, end

    def joined(self, before: dict | None, part: dict) -> dict:
        """The state after a part that follows ``before``."""
        end = part["end"]
        if before is None or not part["one"] or before["key"] != end["key"]:
            return end
        sums = {k: v + before["sum"][k] for k, v in end["sum"].items()}
        for name, (c, limit) in self.gaps.items():
            a, b = before["lag"][c], part["first"][c]
            sums[name] -= a is not None and b is not None and b - a <= limit  # the part took its first row for a gap
        return {"key": end["key"], "lag": end["lag"], "last": {c: before["last"][c] if v is None else v for c, v in end["last"].items()}, "sum": sums}


def scan(rows: DataFrame, order: tuple[str, ...], what: Scan) -> DataFrame:
    """``rows`` with lag_, last_ and sum_ columns and the counts of gaps, in the order of ``what.key`` and ``order``, which tell all rows apart.

    Counts and sums include the row itself. Rows go to the shared folder once, so that
    both passes see the same parts. Equal to windows over the key; an empty table gives
    no rows. Null values of a summed column count 0; a gap follows or precedes a null value.
    """
    import pickle

    spark = rows.sparkSession
    shared_folder(spark)
    parted = rows.repartitionByRange(*what.key, *order).sortWithinPartitions(*what.key, *order).checkpoint()
    parted = parted.withColumn("_chunk", F.spark_partition_id())

    def ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state = chunk = first = None
        one = True
        for batch in batches:
            if batch.num_rows:
                col = {c: batch.column(batch.schema.get_field_index(c)) for c in (*what.key, "_chunk", *what.before())}
                if first is None:
                    chunk, first, key = col["_chunk"][0].as_py(), {c: col[c][0].as_py() for c in what.before()}, [col[k][0].as_py() for k in what.key]
                _, state = what.run(batch, state)
                one = one and state["key"] == key
        if state is not None:
            yield pa.RecordBatch.from_arrays([pa.array([chunk], pa.int32()), pa.array([pickle.dumps({"end": state, "one": one, "first": first})], pa.binary())], names=["chunk", "part"])

    used = [c for c in dict.fromkeys([*what.key, *what.before(), *what.last, *what.sums])]
    told = parted.select(*used, "_chunk").mapInArrow(ends, "chunk int, part binary").collect()  # a row per part
    begin, state = {}, None
    for r in sorted(told, key=lambda r: r.chunk):
        begin[r.chunk] = state
        state = what.joined(state, pickle.loads(bytes(r.part)))
    carried = spark.sparkContext.broadcast(begin)
    schema = T.StructType([*rows.schema.fields, *what.fields(rows.schema)])

    def values(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state, began = None, False
        for batch in batches:
            if batch.num_rows:
                if not began:
                    state, began = carried.value[batch.column(batch.num_columns - 1)[0].as_py()], True
                out, state = what.run(batch, state)
                yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *out], names=schema.names)

    return parted.mapInArrow(values, schema)


def number_gaps(rows: DataFrame, gap_ms: int, name: str) -> DataFrame:
    """``name`` counts up at every pause of more than gap_ms: time_windows and sessionize_drives for vehicles of any size. Expects vehicle_id, t_ms, seq."""
    return scan(rows, ("t_ms", "seq"), Scan(("vehicle_id",), gaps={name: ("t_ms", gap_ms)}))
