"""Operator 4: packing by power-of-two decomposition.

A document's ids (its text's, then one end id) are cut into pieces whose lengths
are the powers of two of its token count, with the longest length, ``max_len``,
taken as often as it fits. Each piece is a sequence of its own: no sequence crosses
documents, none needs padding, and sequences of equal length form one bucket
(column ``length``), from which batches of one shape are drawn.

Nothing is shuffled: a document's pieces follow from its own count, and
``sequence_id`` numbers the pieces of each input partition. Each partition's pieces
come bucket by bucket, long ones first, so a file written from it holds every length
in one run. ``by_length`` deals pieces by bucket, and ``write_buckets`` writes the
sequences into one folder a length.

A null text is empty and gives one piece, the end id. Repeated rows are packed
each by themselves, so every row's ids stand in sequences of their own. Columns
besides key and text are not carried. An empty table gives no pieces.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from funnelkit.llm.batches import columns_kept, released, slices, text_column
from funnelkit.llm.bpe import SLICE, coder

MAX_LEN = 2048
END_ID = 1


def piece_lengths(n: int, max_len: int = MAX_LEN) -> list[int]:
    """Powers of two that add up to ``n``, long pieces first."""
    rest = n % max_len
    return [max_len] * (n // max_len) + [1 << b for b in range(max_len.bit_length() - 1, -1, -1) if rest >> b & 1]


def _pieces(path: str, text: str, keep: list[str], max_len: int, end_id: int, with_ids: bool):
    def work(batches):
        own = coder(path)
        for whole in batches:
            for batch in slices(whole, text, SLICE):
                ids, offsets = own.encode_texts(text_column(batch, text))
                ids = np.insert(ids, offsets[1:], end_id).astype("<u4")
                offsets = offsets + np.arange(len(offsets))
                row, start, length = [], [], []
                for r, n in enumerate(np.diff(offsets).tolist()):
                    at = 0
                    for size in piece_lengths(n, max_len):
                        row.append(r)
                        start.append(at)
                        length.append(size)
                        at += size
                row, start, length = (np.array(x, dtype=np.int64) for x in (row, start, length))
                begin = offsets[row] + start
                data = memoryview(ids).cast("B")
                crc = [zlib.crc32(data[4 * a:4 * b]) for a, b in zip(begin.tolist(), (begin + length).tolist())]
                cols = [batch.column(batch.schema.get_field_index(k)).take(pa.array(row)) for k in keep]
                cols += [pa.array(x, pa.int64()) for x in (start, length, crc, np.diff(offsets)[row])]
                names = [*keep, "start", "length", "ids_crc32", "doc_tokens"]
                if with_ids:
                    ends = pa.array(np.append(begin, offsets[-1]).astype(np.int32))
                    cols.append(pa.ListArray.from_arrays(ends, pa.array(ids.astype(np.int32))))
                    names.append("ids")
                yield pa.RecordBatch.from_arrays(cols, names=names)
    return work


def pack_power_of_two(df: DataFrame, path: str, text: str = "text", key: str = "doc_id",
                      max_len: int = MAX_LEN, end_id: int = END_ID, with_ids: bool = True) -> DataFrame:
    """One row a piece: key, ``start``, ``length``, ``ids_crc32``, ``doc_tokens``,
    ``sequence_id``, ``offset`` and, ``with_ids``, the piece's ``ids``.

    ``max_len`` is a power of two. ``sequence_id`` is unique in one evaluation of the
    frame; write the frame once (as the pipeline does) before reading it twice."""
    if max_len < 1 or max_len & (max_len - 1):
        raise ValueError("max_len must be a power of two")
    keep = [key] if key in df.columns else []
    schema = columns_kept(df.schema, keep) + (", " if keep else "")
    schema += "start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint"
    if with_ids:
        schema += ", ids array<int>"
    pieces = df.select(*keep, text).mapInArrow(released(_pieces(path, text, keep, max_len, end_id, with_ids)), schema)
    return pieces.withColumns({"sequence_id": F.monotonically_increasing_id(),
                               "offset": F.lit(0).cast("bigint")}).sortWithinPartitions(F.desc("length"))


def by_length(pieces: DataFrame) -> DataFrame:
    """The pieces bucket by bucket: those of one length stand together, a bucket of many
    pieces in several partitions of like size, one of few in one (adaptive rebalancing)."""
    return pieces.hint("rebalance", "length").sortWithinPartitions(F.desc("length"))


def write_buckets(pieces: DataFrame, path: str) -> None:
    """The sequences as Parquet, one folder a length (at most 1 + log2(max_len) of
    them, each task writing to any): a training job reads one bucket at a time."""
    pieces.select("sequence_id", "ids", F.col("length").alias("bucket")) \
        .write.mode("overwrite").partitionBy("bucket").parquet(path)
