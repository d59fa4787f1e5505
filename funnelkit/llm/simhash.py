"""Operator 2: SimHash near-duplicates by multi-index hashing.

A fingerprint is cut into segments. If two fingerprints differ in at most ``d``
bits, then for radii with ``sum(radius + 1) = d + 1`` over the segments some segment
differs in at most its radius. So a table keyed by (segment, value) holds every
fingerprint once a segment, and each fingerprint probes the small Hamming balls
around its own values: the table's matches are compared on all 64 bits. How many
segments there are follows the number of different fingerprints (``segments``), so a
bucket holds few by chance at any size: three of 21 or 22 bits for some millions, two
of 32 bits from some tens of millions on.

Equal fingerprints are folded into one before any of this, so copies are never
paired. A table bucket of more than ``BUCKET`` different fingerprints is not
paired either: its members and all that probe it are linked through shared
midpoints. Two fingerprints differ in at most ``2r`` bits exactly if some value
lies within ``r`` bits of both; each emits the (bounded) ball around itself, and
fingerprints that meet at a midpoint are linked to the smallest there. That is
exact and linear in the members, whatever the size of the bucket.

Nulls and texts without words have fingerprint zero and are linked like others.
A null id counts as larger than any other and never names a component; a
component of null ids alone has a null id. Repeated rows are returned as often as
they come. Columns besides id and text are not read. Empty tables give empty results.
"""

from __future__ import annotations

from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from funnelkit.llm.batches import columns_kept, released, slices, text_column
from funnelkit.llm.components import components
from funnelkit.sources.sinks import cut_lineage

WORDS, BITS, SEED = 4, 4, 42
BUCKET = 2048         # about a midpoint ball: from here on pairs would cost more
MAX_PROBES = 4096     # of one fingerprint; the expression lists them
SALTS = 32


def fingerprint(text: str, words: int = WORDS) -> int:
    """64-bit SimHash of the word shingles of a text, unsigned. Words stand between
    ASCII white space, A-Z count as a-z."""
    found = text.encode("utf-8", "surrogatepass").lower().split()
    if not found:
        return 0
    if len(found) < words:
        shingles = [b" ".join(found)]
    else:
        data = b" ".join(found)
        lengths = np.fromiter(map(len, found), dtype=np.int64, count=len(found))
        ends = np.cumsum(lengths + 1) - 1
        starts = ends - lengths
        shingles = [data[a:b] for a, b in zip(starts[:len(found) - words + 1].tolist(), ends[words - 1:].tolist())]
    total = np.zeros(64, dtype=np.int64)
    for at in range(0, len(shingles), 1 << 16):
        part = shingles[at:at + (1 << 16)]
        h = np.array([xxhash.xxh64_intdigest(s, SEED) for s in part], dtype=">u8")
        total += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * total > len(shingles)).tobytes(), "big")


def _fingerprints(text: str, keep: list[str], words: int):
    def work(batches):
        for whole in batches:
            for batch in slices(whole, text):
                values = text_column(batch, text).to_pylist()
                found = np.array([fingerprint(v, words) for v in values], dtype=np.uint64).view(np.int64)
                cols = [batch.column(batch.schema.get_field_index(k)) for k in keep]
                yield pa.RecordBatch.from_arrays([*cols, pa.array(found)], names=[*keep, "fp"])
    return work


def fingerprints(df: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id",),
                 words: int = WORDS) -> DataFrame:
    """The ``keep`` columns and ``fp``, the fingerprint as a signed long."""
    schema = columns_kept(df.schema, list(keep)) + ", fp bigint"
    return df.select(*keep, text).mapInArrow(released(_fingerprints(text, list(keep), words)), schema)


def segments(bits: int, count: int = 0) -> list[tuple[int, int]]:
    """(width, radius) of the segments from the lowest bit up, for a table of ``count``
    fingerprints. Radii plus one add up to ``bits + 1`` whatever their number, which makes
    the search exact; fewer and wider segments take more probes and meet fewer rows by
    chance, so their number follows the count: the least of probes and chance matches."""
    def cut(parts: int) -> list[tuple[int, int]]:
        return [(64 // parts + (i >= parts - 64 % parts), (bits + 1) // parts - 1 + (i < (bits + 1) % parts))
                for i in range(parts)]

    def cost(found: list[tuple[int, int]]) -> float:
        return sum(_ball_size(w, r) * (1 + count / 2 ** w) + 1 for w, r in found)
    cuts = [c for c in map(cut, range(1, bits + 2)) if sum(_ball_size(w, r) for w, r in c) <= MAX_PROBES]
    # beyond three, segments are so short that chance matches outgrow what probes they spare
    return min([c for c in cuts if len(c) <= 3] or cuts, key=cost)


def _ball_size(width: int, radius: int) -> int:
    return sum(comb(width, r) for r in range(radius + 1))


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _ball(width: int, radius: int, shift: int = 0) -> list[int]:
    """Masks of all values within ``radius`` bits, as signed longs."""
    out = [0]
    for r in range(1, radius + 1):
        out += [_signed(sum(1 << (shift + b) for b in bits)) for bits in combinations(range(width), r)]
    return out


def links(fps: DataFrame, bits: int = BITS, bucket: int = BUCKET,
          cut: list[tuple[int, int]] | None = None) -> DataFrame:
    """Edges ``(a, b)`` between different fingerprints of ``fps`` (distinct, column
    ``fp``) whose components are those of all pairs at most ``bits`` apart. ``cut`` gives
    the segments; by default they follow the number of fingerprints, which is counted."""
    shift, table, probes = 0, [], []
    for i, (width, radius) in enumerate(cut or segments(bits, fps.count())):
        part = F.shiftrightunsigned("fp", shift).bitwiseAND(F.lit(_signed((1 << width) - 1)))
        table.append(F.struct(F.lit(i).alias("seg"), part.alias("val")))
        probes.append(F.array(*[F.struct(F.lit(i).alias("seg"), part.bitwiseXOR(F.lit(m)).alias("val"))
                                for m in _ball(width, radius)]))
        shift += width
    table = fps.select(F.col("fp").alias("b"), F.inline(F.array(*table)))
    probes = fps.select(F.col("fp").alias("a"), F.inline(F.concat(*probes)))
    sizes = table.groupBy("seg", "val").agg(F.count("*").alias("n"))
    sized = table.join(sizes, ["seg", "val"])
    apart = F.bit_count(F.col("a").bitwiseXOR(F.col("b")))
    small = sized.where(F.col("n") <= bucket)
    close = probes.alias("p").join(small.alias("t"), (F.col("p.seg") == F.col("t.seg")) & (F.col("p.val") == F.col("t.val"))
                                   & (F.col("a") < F.col("b")) & (apart <= bits)).select("a", "b")
    # the rest: everything that is in, or probes, a larger bucket
    large = sizes.where(F.col("n") > bucket).select("seg", "val")
    crowd = sized.where(F.col("n") > bucket).select(F.col("b").alias("fp")) \
        .unionAll(probes.join(large, ["seg", "val"], "left_semi").select(F.col("a").alias("fp"))).distinct()
    return close.unionAll(midpoint_links(crowd, bits))


def midpoint_links(fps: DataFrame, bits: int = BITS) -> DataFrame:
    """The same edges through shared midpoints: each fingerprint emits all values
    within ``ceil(bits / 2)`` bits (2,081 for four bits), and a midpoint's group, never
    larger than that, is linked to its smallest member. For an odd distance the pairs
    are checked again, as the halves could add up to one bit more."""
    radius = (bits + 1) // 2
    met = fps.select("fp", F.col("fp").alias("mid"))
    steps = [2] * (radius // 2) + [1] * (radius % 2)  # wider balls are made of steps of two bits
    for step in steps:
        masks = F.array(*[F.lit(m).cast("bigint") for m in _ball(64, step)])
        met = met.select("fp", F.explode(F.transform(masks, lambda m: F.col("mid").bitwiseXOR(m))).alias("mid"))
    met = met.distinct() if len(steps) > 1 else met
    if bits % 2:
        pairs = met.alias("x").join(met.alias("y"), F.col("x.mid") == F.col("y.mid")) \
            .select(F.col("x.fp").alias("a"), F.col("y.fp").alias("b"))
        return pairs.where((F.col("a") < F.col("b"))
                           & (F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= bits)).distinct()
    low = met.withColumn("a", F.min("fp").over(W.partitionBy("mid")))
    return low.where("a <> fp").select("a", F.col("fp").alias("b")).distinct()


def near_duplicates(fps: DataFrame, key: str = "doc_id", bits: int = BITS, bucket: int = BUCKET) -> DataFrame:
    """For every different fingerprint ``fp`` its component's smallest fingerprint
    (``root``) and smallest key (``component_id``), over links of at most ``bits``
    differing bits."""
    distinct = cut_lineage(fps.groupBy("fp").agg(F.min(key).alias("least")))
    found = cut_lineage(components(links(distinct.select("fp"), bits, bucket), "a", "b"))
    linked = found.join(distinct, found["node"] == distinct["fp"]).select("fp", "least", "root")
    # a component may hold most fingerprints: its smallest key goes to each salt of its root
    roots = linked.groupBy("root").agg(F.min("least").alias("component_id")) \
        .withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    named = linked.withColumn("salt", F.pmod(F.xxhash64("fp"), F.lit(SALTS)).cast("int")) \
        .join(roots, ["root", "salt"]).select("fp", "root", "component_id")
    # the others stand alone
    alone = distinct.join(found, distinct["fp"] == found["node"], "left_anti")
    return named.unionAll(alone.select("fp", F.col("fp").alias("root"), F.col("least").alias("component_id")))


def simhash_near_dedup(df: DataFrame, text: str = "text", key: str = "doc_id", words: int = WORDS,
                       bits: int = BITS, bucket: int = BUCKET) -> DataFrame:
    """Key, ``fingerprint`` (16 hex digits) and ``component_id`` of every row."""
    own = cut_lineage(fingerprints(df, text, (key,), words))
    out = own.join(near_duplicates(own, key, bits, bucket), "fp")
    return out.select(key, F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def keep_one(df: DataFrame, text: str = "text", key: str = "doc_id", words: int = WORDS,
             bits: int = BITS, bucket: int = BUCKET) -> DataFrame:
    """The rows of ``df`` without near-duplicates: of each component the row with the
    smallest key stays (and of rows that repeat it, one). Rows come back whole.

    Texts are shuffled only where a key repeats: rows are told by key and a hash of
    the text, and those that stay are picked by a semi join."""
    row = F.xxhash64(F.coalesce(F.col(text), F.lit("")))
    named = df.select(F.col(key).alias("k"), row.alias("h"), F.col(text).alias("t"))
    own = cut_lineage(fingerprints(named, "t", ("k", "h"), words))
    groups = own.join(near_duplicates(own, "k", bits, bucket), "fp")
    # a row of the smallest key in each component; among its texts the one of least hash
    first = groups.groupBy("root").agg(F.min(F.struct(F.col("k").isNull().alias("last"), "k", "h")).alias("m")) \
        .select(F.col("m.k").alias("k"), F.col("m.h").alias("h"))
    times = own.groupBy("k", "h").agg(F.count("*").alias("n"))
    pick = cut_lineage(first.join(times, first["k"].eqNullSafe(times["k"]) & (first["h"] == times["h"]))
                       .select(first["k"].alias("__k"), first["h"].alias("__h"), "n"))
    # working columns stand beside the row in a struct, so no name of the caller's clashes
    marked = df.select(F.struct(*[df[c] for c in df.columns]).alias("d"), F.col(key).alias("k"), row.alias("h"))
    same = marked["k"].eqNullSafe(F.col("__k")) & (marked["h"] == F.col("__h"))
    once = marked.join(pick.where("n = 1"), same, "left_semi")
    again = marked.join(pick.where("n > 1"), same, "left_semi").groupBy("k", "h").agg(F.first("d").alias("d"))
    return once.select("d").unionAll(again.select("d")).select(*[F.col("d").getField(c).alias(c) for c in df.columns])
