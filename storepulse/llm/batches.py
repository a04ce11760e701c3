"""Helpers of the Arrow stages: every text is handled whole, a bounded slice of rows at a time."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Bytes of text that a task holds as Python objects at once (one longer text is held alone).
SLICE_BYTES = 4 << 20


def text_bytes(column: str) -> Column:
    """The column's UTF-8 bytes; null gives empty. bytes.split() then parts words at exactly [\\x20\\x09-\\x0D]."""
    return F.coalesce(F.col(column).cast("binary"), F.lit(b""))


def slices(batches: Iterator[pa.RecordBatch], text: str, most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The batches' rows in order, in slices of at most `most` bytes of `text`, or one row."""
    for batch in batches:
        sizes = pc.fill_null(pc.binary_length(batch.column(text)), 0).to_pylist()
        start = held = 0
        for i, size in enumerate(sizes):
            if i > start and held + size > most:
                yield batch.slice(start, i - start)
                start, held = i, 0
            held += size
        if start < len(sizes):
            yield batch.slice(start)


def runs(batches: Iterator[pa.RecordBatch], keys: list[str], most: int) -> Iterator[tuple[tuple, int, pa.Table]]:
    """Runs of equal keys of a sorted partition, each in blocks of at most `most` rows.

    Yields (key, number of the block in its run, rows, whether the run ends with this block)."""
    held: list[pa.RecordBatch] = []
    rows, key, number = 0, None, 0

    def block(last: bool):
        nonlocal held, rows, number
        out = (key, number, pa.Table.from_batches(held), last)
        held, rows, number = [], 0, number + 1
        return out

    import numpy as np

    for batch in batches:
        if not batch.num_rows:
            continue
        columns = [batch.column(k).to_numpy(zero_copy_only=False) for k in keys]
        change = np.zeros(batch.num_rows, dtype=bool)
        for c in columns:
            change[1:] |= c[1:] != c[:-1]
        starts = [0, *np.flatnonzero(change).tolist(), batch.num_rows]
        for lo, hi in zip(starts, starts[1:], strict=False):
            own = tuple(c[lo] for c in columns)
            if key is not None and own != key:
                if rows:
                    yield block(True)
                number = 0
            key = own
            while lo < hi:
                if rows == most:
                    yield block(False)
                take = min(hi - lo, most - rows)
                held.append(batch.slice(lo, take))
                rows += take
                lo += take
    if rows:
        yield block(True)


def renamed(df: DataFrame, **columns: str) -> DataFrame:
    """Only the named columns, under our names, so that clashing extra columns are left out."""
    return df.select(*(F.col(f"`{theirs}`").alias(ours) for ours, theirs in columns.items()))
