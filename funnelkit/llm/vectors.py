"""Helpers for operators that work on Arrow batches of vectors."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

# Components are whole numbers up to this in size, so that sums of squares over
# thousands of components, and 64 times such a sum, fit 64 bits.
LARGEST = 1 << 24


def integer_rows(batch: pa.RecordBatch, vector: str, scale: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``(rows, lengths, values)``: the rows whose vector is not null and holds no null,
    non-finite or too large component, and floor(scale * component) of all their
    components, row after row."""
    column = batch.column(batch.schema.get_field_index(vector))
    there = np.asarray(pc.is_valid(column))
    rows = np.flatnonzero(there)
    column = column.filter(pa.array(there))
    lengths = np.asarray(pc.list_value_length(column)).astype(np.int64)
    flat = pc.fill_null(column.flatten().cast(pa.float64()), float("nan"))
    with np.errstate(over="ignore", invalid="ignore"):
        values = np.floor(np.asarray(flat) * scale)
        bad = ~(np.abs(values) <= LARGEST)
    ends = np.cumsum(lengths)
    total = np.concatenate(([0], np.cumsum(bad)))
    good = total[ends] == total[ends - lengths]
    values = values[np.repeat(good, lengths)].astype(np.int64)
    return rows[good], lengths[good], values
