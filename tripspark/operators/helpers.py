"""Small helpers for order-dependent steps."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa


def sorted_groups(batches: Iterator[pd.DataFrame], keys: list[str]) -> Iterator[dict[str, np.ndarray]]:
    """The groups of a partition that is sorted by its keys, as arrays; a group may span batches."""
    rest = None
    for pdf in batches:
        pdf = pdf if rest is None else pd.concat([rest, pdf], ignore_index=True)
        if not len(pdf):
            continue
        new = (pdf[keys] != pdf[keys].shift()).any(axis=1).to_numpy()
        at = np.flatnonzero(new)
        cols = {c: pdf[c].to_numpy() for c in pdf.columns}
        for a, b in zip(at[:-1], at[1:]):
            yield {c: v[a:b] for c, v in cols.items()}
        rest = pdf.iloc[at[-1] :].reset_index(drop=True)
    if rest is not None and len(rest):
        yield {c: rest[c].to_numpy() for c in rest.columns}


def whole_groups(batches: Iterator[pd.DataFrame], keys: list[str]) -> Iterator[tuple[dict[str, np.ndarray], np.ndarray]]:
    """(columns, where groups begin) of a partition that is sorted by its keys: many whole groups at a time, so that small ones cost no call each."""
    rest: list[pd.DataFrame] = []

    def placed(parts: list[pd.DataFrame]) -> tuple[dict[str, np.ndarray], np.ndarray]:
        pdf = parts[0] if len(parts) == 1 else pd.concat(parts, ignore_index=True)
        cols = {c: pdf[c].to_numpy() for c in pdf.columns}
        new = np.ones(len(pdf), bool)
        new[1:] = np.any([cols[k][1:] != cols[k][:-1] for k in keys], axis=0)
        return cols, np.flatnonzero(new)

    for pdf in batches:
        if not len(pdf):
            continue
        # the last group of what came so far may go on
        same = bool(rest) and all(rest[-1][k].iat[-1] == pdf[k].iat[0] for k in keys)
        last = placed([pdf[keys]])[1][-1]
        if rest and not (same and last == 0):
            yield placed([*rest, pdf.iloc[:last]] if last else rest)
            rest = []
        elif not rest and last:
            yield placed([pdf.iloc[:last]])
        rest.append(pdf.iloc[last:])
    if rest:
        yield placed(rest)


def changes(values: pa.Array) -> np.ndarray:
    """Which values differ from the one before; nulls are equal to nulls, as are NaNs. The first one does."""
    null = values.is_null().to_numpy(zero_copy_only=False)
    if null.all():
        return np.arange(len(null)) == 0
    v = (values.fill_null(values.drop_null()[0]) if values.null_count else values).to_numpy(zero_copy_only=False)
    new = np.ones(len(v), bool)
    new[1:] = v[1:] != v[:-1]
    if pa.types.is_floating(values.type):
        new[1:] &= ~(np.isnan(v[1:]) & np.isnan(v[:-1]))
    if values.null_count:
        new[1:] = np.where(null[1:] & null[:-1], False, new[1:] | (null[1:] != null[:-1]))
    return new


def whole_tables(batches: Iterator[pa.RecordBatch], *keys: str) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """``whole_groups`` for rows that pass as Arrow data, whatever their columns."""
    rest: list[pa.RecordBatch] = []

    def begins(rows: pa.RecordBatch | pa.Table) -> np.ndarray:
        return np.flatnonzero(np.any([changes(pa.concat_arrays(c.chunks) if isinstance(c, pa.ChunkedArray) else c) for c in map(rows.column, keys)], axis=0))

    def placed(parts: list[pa.RecordBatch]) -> tuple[pa.Table, np.ndarray]:
        table = pa.Table.from_batches(parts).combine_chunks()
        return table, begins(table)

    for batch in batches:
        if not batch.num_rows:
            continue
        # the last group of what came so far may go on
        same = bool(rest) and all(rest[-1][k][-1].as_py() == batch[k][0].as_py() for k in keys)
        last = int(begins(batch)[-1])
        if rest and not (same and last == 0):
            yield placed([*rest, batch.slice(0, last)] if last else rest)
            rest = []
        elif not rest and last:
            yield placed([batch.slice(0, last)])
        rest.append(batch.slice(last))
    if rest:
        yield placed(rest)


def by_length(starts: np.ndarray, rows: int) -> Iterator[np.ndarray]:
    """For each length of groups that occurs the places of their rows, a group a row of the matrix."""
    sizes = np.diff(starts, append=rows)
    for n in np.unique(sizes):
        yield starts[sizes == n][:, None] + np.arange(n)
