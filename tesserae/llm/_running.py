"""Running sums within groups of any size: rows are range-sorted, so that a large group spans many tasks.

Each task sums its own rows; what the last group of a partition has reached is carried into the next partition. The
driver sees one row for each partition. Sums are of 64-bit integers and wrap around, which lets them be sums of hashes.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tesserae.session import checkpoint_ready


def runs(batch: pa.RecordBatch, places: list[int], last: tuple | None) -> tuple[np.ndarray, bool, tuple]:
    """Where a new group begins after the first row, whether the first row goes on with the last group, and the last row's group."""
    columns = [batch.column(i).to_numpy(zero_copy_only=False) for i in places]
    begins = np.flatnonzero(np.any([c[1:] != c[:-1] for c in columns], axis=0)) + 1
    return begins, last == tuple(int(c[0]) for c in columns), tuple(int(c[-1]) for c in columns)


def within(values: np.ndarray, begins: np.ndarray, carried: np.integer) -> np.ndarray:
    """Running sums that start anew at each begin; the first run starts from what is carried."""
    with np.errstate(over="ignore"):
        sums = np.cumsum(values, dtype=np.int64)
        starts = np.concatenate([[0], begins])
        reached = np.concatenate([[carried], -sums[begins - 1]])
        return sums + np.repeat(reached, np.diff(np.append(starts, len(values))))


def running(rows: DataFrame, group: list[str], order: list, sums: dict[str, str], before: dict[str, str] | None = None) -> DataFrame:
    """rows with a column for each of sums (new name: column), its sum over the group up to and with this row in the order.

    group: integer columns without nulls; before (new name: column of sums' values) gives the sum without this row.
    """
    before = before or {}
    checkpoint_ready(rows.sparkSession)
    at = [F.col(c) for c in group] + [F.col(c) if isinstance(c, str) else c for c in order]
    ordered = rows.repartitionByRange(*at).sortWithinPartitions(*at).checkpoint()
    names = ordered.columns
    keys, values = [names.index(c) for c in group], [names.index(c) for c in sums.values()]

    def reached(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = last = None
        total, several = [np.int64(0)] * len(values), False
        for batch in (b for b in batches if b.num_rows):
            begins, same, now = runs(batch, keys, last)
            first = first or tuple(int(batch.column(i)[0].as_py()) for i in keys)
            several |= bool(len(begins)) or not (same or last is None)
            total = [within(batch.column(v).to_numpy(), begins, t if same else np.int64(0))[-1] for v, t in zip(values, total)]
            last = now
        if last is not None:
            yield pa.record_batch([pa.array([TaskContext.get().partitionId()]), pa.array([list(first)]), pa.array([list(last)]), pa.array([several]), pa.array([[int(t) for t in total]])], ["part", "first", "last", "several", "total"])

    found = sorted(map(tuple, ordered.select(*names).mapInArrow(reached, "part long, first array<long>, last array<long>, several boolean, total array<long>").collect()))
    carried, state = {}, None
    for part, first, last, several, total in found:
        carried[part] = state
        if state and not several and tuple(first) == state[0]:
            with np.errstate(over="ignore"):
                total = [int(np.int64(a) + np.int64(b)) for a, b in zip(total, state[1])]
        state = tuple(last), total

    def summed(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, total = carried.get(TaskContext.get().partitionId()) or (None, [0] * len(values))
        for batch in (b for b in batches if b.num_rows):
            begins, same, last = runs(batch, keys, last)
            own = [batch.column(v).to_numpy() for v in values]
            out = [within(x, begins, np.int64(t if same else 0)) for x, t in zip(own, total)]
            total = [int(x[-1]) for x in out]
            with np.errstate(over="ignore"):
                less = [out[list(sums).index(name)] - own[list(sums).index(name)] for name in before.values()]
            yield pa.RecordBatch.from_arrays([*batch.columns, *map(pa.array, out), *map(pa.array, less)], [*names, *sums, *before])

    added = "".join(f", {c} long" for c in [*sums, *before])
    return ordered.mapInArrow(summed, ", ".join(f"`{c}` {kind}" for c, kind in ordered.dtypes) + added)
