"""Operator 7: document fingerprints by consistent weighted sampling.

A text is a bag of words weighted by their counts. For each of ``SAMPLES`` draws every
word gets r and c from Gamma(2, 1) and b from [0, 1), all functions of the word and
the draw alone; with t = floor(ln w / r + b) its value is ln c - r (t - b + 1), and the
word of least value, with its t, is the draw's sample. Two texts draw the same sample
with a probability equal to their generalised Jaccard similarity, so the share of equal
samples estimates it. Samples are kept as 16-bit hashes, four hex digits each; zero is
left to texts without words, so a hash of zero becomes one.

For the edited texts each document needs its neighbour in id order. Documents are dealt
into ranges of (id, text hash); the ranges' last rows (one a range, collected as ids
only) are also sent to the range behind, so each range is worked through by itself, in
order and as a stream. Texts are shuffled once. No range depends on how often an id
occurs, as repeated ids are told apart by their texts.

A null text is empty; texts without words have a fingerprint of their own that equals
only itself. Repeated rows follow each other, so the neighbour of one is the other. A
null id is smaller than any other. Extra columns are not carried. An empty table gives
an empty result.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from funnelkit.llm.batches import columns_kept, distinct_words, slices, text_column

SAMPLES = 64
SLICE = 3 << 20
BLOCK = 4096
GOLDEN = np.uint64(0x9E3779B97F4A7C15)


def _mixed(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _halves(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two uniforms in (0, 1) of each 64-bit value."""
    scale = np.float32(2.0 ** -32)
    low = (x & np.uint64(0xFFFFFFFF)).astype(np.float32)
    high = (x >> np.uint64(32)).astype(np.float32)
    one = np.float32(1 - 2.0 ** -24)
    return (np.minimum((low + np.float32(0.5)) * scale, one), np.minimum((high + np.float32(0.5)) * scale, one))


def draws(hashes: np.ndarray, samples: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """r, b and the value at weight one, ln c - r + r b, of every word and draw."""
    r, b, base = (np.empty((len(hashes), samples), dtype=np.float32) for _ in range(3))
    steps = [(np.arange(samples, dtype=np.uint64) * np.uint64(3) + np.uint64(j + 1)) * GOLDEN for j in range(3)]
    for at in range(0, len(hashes), BLOCK):
        part = slice(at, at + BLOCK)
        h = hashes[part, None]
        u1, u2 = _halves(_mixed(h + steps[0]))
        u3, u4 = _halves(_mixed(h + steps[1]))
        r[part] = -np.log(u1 * u2)
        b[part] = _halves(_mixed(h + steps[2]))[0]
        base[part] = np.log(-np.log(u3 * u4)) - r[part] + r[part] * b[part]
    return r, b, base


def signatures(texts: pa.Array, samples: int = SAMPLES) -> np.ndarray:
    """One row of 16-bit samples a text."""
    words, codes, offsets = distinct_words(texts)
    names = words.to_pylist()
    hashes = np.fromiter((xxhash.xxh64_intdigest(w) for w in names), dtype=np.uint64, count=len(names))
    # words in the order of their hashes, so that equal texts break ties alike
    order = np.argsort(hashes, kind="stable")
    place = np.empty(len(order), dtype=np.int64)
    place[order] = np.arange(len(order))
    hashes = hashes[order]
    empty = np.fromiter((not w for w in names), dtype=bool, count=len(names))[order]
    codes = place[codes]
    r, b, base = draws(hashes, samples)
    out = np.zeros((len(texts), samples), dtype=np.uint16)
    draw = np.arange(samples)
    for i, (lo, hi) in enumerate(zip(offsets[:-1].tolist(), offsets[1:].tolist())):
        found, counts = np.unique(codes[lo:hi], return_counts=True)
        if empty.any():
            real = ~empty[found]
            found, counts = found[real], counts[real]
        if not len(found):
            continue
        value = base[found]
        t = None
        many = np.flatnonzero(counts > 1)
        if len(many):
            own = found[many]
            rate, shift = r[own], b[own]
            t = np.floor(np.log(counts[many]).astype(np.float32)[:, None] / rate + shift)
            value[many] -= rate * t
        best = value.argmin(axis=0)
        level = np.zeros(samples, dtype=np.uint64)
        if t is not None:
            row = np.full(len(found), -1)
            row[many] = np.arange(len(many))
            hit = row[best]
            level = np.where(hit >= 0, t[np.maximum(hit, 0), draw], 0).astype(np.int64).astype(np.uint64)
        sample = _mixed(hashes[found[best]] + level * GOLDEN)
        out[i] = np.maximum(sample >> np.uint64(48), np.uint64(1))  # zero is left to empty texts
    return out


def _hexed(rows: np.ndarray) -> list[str]:
    return [x.astype(">u2").tobytes().hex() for x in rows]


def _worked(key: str, samples: int, types: dict):
    def work(batches):
        last_range, last_text, last_signature = None, "", None
        for whole in batches:
            for batch in slices(whole, "text", SLICE):
                ranges = batch.column(batch.schema.get_field_index("range")).to_pylist()
                ahead = batch.column(batch.schema.get_field_index("ahead")).to_pylist()
                values = text_column(batch, "text").to_pylist()
                follow = []  # the text each row's edit is taken from
                for k, text in zip(ranges, values):
                    follow.append(last_text if k == last_range else "")
                    last_range, last_text = k, text
                cut = [len(v) - len(v) // 3 for v in values]
                edited = [v[:c] + f[:len(v) - c] for v, f, c in zip(values, follow, cut)]
                both = signatures(pa.array(values + edited, pa.large_string()), samples)
                own, other = both[:len(values)], both[len(values):]
                before = np.vstack([own[:1] if last_signature is None else last_signature, own[:-1]])
                last_signature = own[-1:]
                near = [(own == x).mean(axis=1) for x in (other, before)]
                keep = pa.array([not a for a in ahead])
                sha = [hashlib.sha256(e.encode("utf-8", "surrogatepass")).hexdigest() for e in edited]
                cols = [batch.column(batch.schema.get_field_index(key)), pa.array(list(map(len, values)), pa.int64()),
                        pa.array(sha, pa.string()), pa.array(_hexed(own), pa.string()),
                        pa.array(_hexed(other), pa.string()), *(pa.array(x, pa.float64()) for x in near)]
                out = pa.RecordBatch.from_arrays(cols, names=[key, *types])
                yield out.filter(keep)
    return work


def neighbour_ranges(df: DataFrame, key: str, text: str, parts: int) -> DataFrame:
    """``key, text, range, ahead`` in order of id inside each range. Rows that are
    ``ahead`` come first in their range and are the neighbour of its first row."""
    own = df.select(F.col(key).alias(key), F.col(text).alias("text"))
    place = F.struct(F.col(key).alias("k"), F.xxhash64("text").alias("h"))
    ends = own.select(place.alias("p")).repartitionByRange(parts, "p") \
        .groupBy(F.spark_partition_id()).agg(F.max("p").alias("p")).orderBy("p").collect()  # one row a range
    if not ends:
        return own.select("*", F.lit(0).alias("range"), F.lit(False).alias("ahead"))
    kind = own.schema[key].dataType.simpleString()
    table = df.sparkSession.createDataFrame([(i, *e.p) for i, e in enumerate(ends)], f"i int, k {kind}, h bigint")
    table = table.groupBy().agg(F.transform(F.sort_array(F.collect_list(F.struct("i", F.struct("k", "h").alias("p")))),
                                            lambda x: x["p"]).alias("ends")).scalar()
    # the range is the number of ends below the row, found by halving steps
    steps = [1 << b for b in range(len(ends).bit_length() - 1, -1, -1)]
    below = F.aggregate(F.array(*map(F.lit, steps)), F.lit(0), lambda lo, s: F.when(
        F.coalesce(F.get(F.col("ends"), lo + s - 1) < F.col("place"), F.lit(False)), lo + s).otherwise(lo))
    dealt = own.withColumns({"place": place, "ends": table}).withColumn("range", below)
    at_end = F.get(F.col("ends"), F.col("range")).eqNullSafe(F.col("place"))
    own_row = F.struct("range", F.lit(False).alias("ahead"))
    sent = F.struct(F.pmod(F.col("range") + 1, F.lit(len(ends))).alias("range"), F.lit(True).alias("ahead"))
    rows = dealt.withColumn("to", F.explode(F.when(at_end, F.array(own_row, sent)).otherwise(F.array(own_row))))
    return rows.select(key, "text", "place", "to.range", "to.ahead") \
        .repartitionById(max(1, len(ends)), F.col("range")).sortWithinPartitions("range", F.desc("ahead"), "place").drop("place")


def document_fingerprints(df: DataFrame, text: str = "text", key: str = "doc_id", samples: int = SAMPLES) -> DataFrame:
    """Key, ``n_chars``, ``edited_sha256``, ``fingerprint``, ``edited_fingerprint``,
    ``near_edited`` and ``near_next`` of every document. The edited text has its last
    third replaced by the beginning of the next document by descending id (after the
    last: the first)."""
    types = {"n_chars": "bigint", "edited_sha256": "string", "fingerprint": "string",
             "edited_fingerprint": "string", "near_edited": "double", "near_next": "double"}
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = neighbour_ranges(df, key, text, parts)
    schema = columns_kept(df.schema, [key]) + ", " + ", ".join(f"{n} {t}" for n, t in types.items())
    return rows.mapInArrow(_worked(key, samples, types), schema)


def fingerprint_texts(df: DataFrame, text: str = "text", key: str = "doc_id", samples: int = SAMPLES) -> DataFrame:
    """Key and ``fingerprint`` of every document, without neighbours (nothing is shuffled)."""
    def work(batches):
        for whole in batches:
            for batch in slices(whole, "text", SLICE):
                own = signatures(text_column(batch, "text"), samples)
                yield pa.RecordBatch.from_arrays([batch.column(batch.schema.get_field_index(key)),
                                                  pa.array(_hexed(own), pa.string())], names=[key, "fingerprint"])
    rows = df.select(F.col(key).alias(key), F.col(text).alias("text"))
    return rows.mapInArrow(work, columns_kept(df.schema, [key]) + ", fingerprint string")
