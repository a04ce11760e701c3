"""Order-dependent folds within groups, many groups to a batch.

applyInPandas costs milliseconds a group and holds its rows; here a task walks its sorted partition. select_in_order sees a group as a
slice of an Arrow table; fold_in_order sees one row at a time and holds only the state that the fold keeps."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from typing import Any

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def dealt(df: DataFrame, keys: list[str]) -> DataFrame:
    """df with the rows of one key in one partition.

    By a hash of the keys, not by the keys: Spark leaves out a repartition by the columns that a join or aggregate below has dealt by already, and as
    mapInArrow asks for no distribution, it may then turn that join into a broadcast, or split its large partitions, which parts the rows of a key."""
    return df.repartition(F.xxhash64(*keys))


def select_in_order(df: DataFrame, keys: list[str], order: list, choose: Callable[[dict[str, list]], list[int]], needs: list[str]) -> DataFrame:
    """The rows of df that `choose` picks from each group: it gets the group's columns `needs` as lists, in order, and returns indexes.

    Rows of one key go to one task and are held there together."""
    schema = df.schema

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        key = None

        def chosen() -> Iterator[pa.RecordBatch]:
            table = pa.Table.from_batches(held)
            picked = choose({n: table.column(n).to_pylist() for n in needs})
            if picked:
                yield from table.take(picked).to_batches()

        out, rows = [], 0
        for batch in batches:
            names = list(zip(*(batch.column(k).to_pylist() for k in keys), strict=True))
            start = 0
            for i, own in enumerate(names):
                if own != key:
                    if i > start:
                        held.append(batch.slice(start, i - start))
                    if held:
                        out += chosen()
                        rows = sum(b.num_rows for b in out)
                        if rows > 10_000:
                            yield from pa.Table.from_batches(out).combine_chunks().to_batches()
                            out = []
                    held, key, start = [], own, i
            if start < len(names):
                held.append(batch.slice(start))
        if held:
            out += chosen()
        if out:
            yield from pa.Table.from_batches(out).combine_chunks().to_batches()

    return dealt(df, keys).sortWithinPartitions(*keys, *order).mapInArrow(walk, schema)


def whole_groups(batches: Iterator[pa.RecordBatch], key: str) -> Iterator[tuple[Any, pa.Table]]:
    """(value, rows) of the groups of a partition sorted by key: for groups whose size is bounded by how they were dealt."""
    held: list[pa.RecordBatch] = []
    now = None
    for batch in batches:
        values = batch.column(key).to_numpy(zero_copy_only=False)
        starts = [0, *(np.flatnonzero(values[1:] != values[:-1]) + 1).tolist()] if len(values) else []
        for lo, hi in zip(starts, [*starts[1:], len(values)], strict=True):
            if held and values[lo] != now:
                yield now, pa.Table.from_batches(held)
                held = []
            now = values[lo]
            held.append(batch.slice(lo, hi - lo))
    if held:
        yield now, pa.Table.from_batches(held)


ARROW = {"bigint": pa.int64(), "string": pa.string(), "timestamp_ntz": pa.timestamp("us"), "array<double>": pa.list_(pa.float64())}


def _lists(column: pa.Array) -> list:
    """Values of a column; lists of numbers are arrays of doubles."""
    if not pa.types.is_list(column.type):
        return column.to_pylist()
    ends = np.cumsum(pc.list_value_length(column).fill_null(0).to_numpy())
    return np.split(column.flatten().to_numpy(zero_copy_only=False).astype(float), ends[:-1])


def unit(vector: np.ndarray) -> np.ndarray:
    return vector / max(np.linalg.norm(vector), 1e-12)


def fold_in_order(df: DataFrame, keys: list[str], order: list, start: Callable[[], Any], step: Callable[[Any, tuple], Iterable[tuple]], schema: str, end: Callable[[tuple, Any], Iterable[tuple]] = lambda key, state: ()) -> DataFrame:
    """Rows that `step` gives for each row of a key in order (the columns of df without the keys) and `end` gives for the key, with a state made by `start`.

    A task holds the state of one key and a batch of rows, never all rows of a key. An empty table gives none."""
    names, types = zip(*(c.split() for c in schema.split(", ")), strict=True)
    needs = [c for c in df.columns if c not in keys]

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, state, out = None, None, []

        def told() -> pa.RecordBatch:
            columns = [pa.array(values, ARROW[t]) for values, t in zip(zip(*out, strict=True), types, strict=True)]
            out.clear()
            return pa.RecordBatch.from_arrays(columns, list(names))

        for batch in batches:
            if not batch.num_rows:
                continue
            for own, row in zip(zip(*(batch.column(k).to_pylist() for k in keys), strict=True), zip(*(_lists(batch.column(c)) for c in needs), strict=True), strict=True):
                if own != key:
                    if key is not None:
                        out.extend(end(key, state))
                    key, state = own, start()
                out.extend(step(state, row))
            if len(out) > 10_000:
                yield told()
        if key is not None:
            out.extend(end(key, state))
        if out:
            yield told()

    return dealt(df, keys).sortWithinPartitions(*keys, *order).mapInArrow(walk, schema)
