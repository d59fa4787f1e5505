"""Helpers for operators that work on Arrow batches of documents."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

# Texts of one batch are worked through in slices of about this many bytes, so
# that a batch of very long documents needs no more memory than one of short ones.
SLICE_BYTES = 4 << 20
ASCII_SPACE = " \t\n\r\x0b\x0c"


def text_column(batch: pa.RecordBatch, name: str) -> pa.Array:
    """The named column with null texts read as empty."""
    return pc.fill_null(batch.column(batch.schema.get_field_index(name)).cast(pa.large_string()), "")


def slices(batch: pa.RecordBatch, text: str, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The batch in row ranges of about ``limit`` bytes of text (one row at least)."""
    size = np.cumsum(np.asarray(pc.binary_length(text_column(batch, text))))
    at = 0
    while at < batch.num_rows:
        done = size[at - 1] if at else 0
        end = max(at + 1, int(np.searchsorted(size, done + limit)))
        yield batch.slice(at, end - at)
        at = end


def released(work: Callable) -> Callable:
    """``work`` on batches, after the last of which Arrow gives back the memory that it
    holds for reuse: Spark keeps workers between tasks and stages, and an idle one's
    memory counts as its executor's."""
    def run(batches):
        yield from work(batches)
        pa.default_memory_pool().release_unused()
    return run


def distinct_words(texts: pa.Array, separator: str | None = None):
    """``(words, codes, offsets)``: the distinct words of all texts, for every word
    in order its place in ``words``, and where each text's words begin.

    Words stand between runs of ASCII white space, or between single
    ``separator`` characters (which keeps empty words)."""
    if separator is None:
        parts = pc.ascii_split_whitespace(texts)
    else:
        parts = pc.split_pattern(texts, separator)
    flat = parts.flatten().dictionary_encode()
    return flat.dictionary, np.asarray(flat.indices), np.asarray(parts.offsets) - parts.offsets[0].as_py()


def runs(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Indices of the concatenated ranges ``start .. start + length``."""
    total = int(lengths.sum())
    shift = np.repeat(starts - (np.cumsum(lengths) - lengths), lengths)
    return shift + np.arange(total)


def sums(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Sum of ``values`` in each ``offsets[i]:offsets[i + 1]``."""
    total = np.concatenate(([0], np.cumsum(values, dtype=np.int64)))
    return total[offsets[1:]] - total[offsets[:-1]]


def columns_kept(schema, names: list[str]) -> str:
    """DDL of the named columns of a Spark schema."""
    return ", ".join(f"`{n}` {schema[n].dataType.simpleString()}" for n in names)
