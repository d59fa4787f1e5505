"""Operator 12: exact top-k search by norm-bucketed retrieval.

Vectors are grouped by length: buckets are ranges of the squared length (quantiles of
all rows, by width), each cut into slots of about ``SLOT_BYTES``. A query knows a lower
bound of its k-th best score from the start, its score among the longest vectors of
all. It is sent to the slots of those buckets alone whose longest vector could reach
that bound. In a slot the bound becomes a local threshold of the cosine, bound /
(query's length * longest length there):

* above one, the slot holds nothing for the query;
* at ``COORDINATES`` and above, coordinates prune: a vector within the angle has each
  coordinate of its direction in an interval around the query's. Sorted lists of the
  query's largest coordinates give the candidates, the shortest interval first;
* below, lengths prune: the slot's vectors stand by falling length, and only those that
  can reach the bound are candidates.

Candidates are then verified by their products in whole numbers, and a slot's ``k``
best are merged with those of other slots.

The query set grows with the table, and meets it in blocks: a slot's vectors are held
in memory while its queries stream past, so that a task needs one slot and one batch
whatever the input, and copies of a vector (or equal lengths) are spread over slots.
Vectors are shuffled once; a query once a slot. Slots are dealt to tasks by number. The
driver sees a row a bucket and the ``SEEDS`` longest vectors (``SEED_BYTES`` at most).

Vectors that are null, or hold a null, non-finite or (in whole numbers) larger than
``vectors.LARGEST`` component take no part. Of vectors of unlike widths the shorter one
counts as ending in zeros (so a vector without components scores 0). Rows with the
query's id are its own; a null id is no query and comes last among ties. A query row
that repeats is answered as often. Columns besides id and vector are not read. An empty
table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from funnelkit.llm.tables import written
from funnelkit.llm.vectors import integer_rows

K, EVERY, SCALE = 5, 50, 256
RANGES = 16                # buckets of like length, for each width
SLOT_BYTES = 4 << 20       # of a slot's vectors as doubles
SEEDS, SEED_BYTES = 1024, 4 << 20
COORDINATES = 0.9          # local cosine threshold from which coordinates prune
FOCUS = 4                  # coordinates looked at
BLOCK_BYTES = 8 << 20      # of products held at a time
NONE = np.iinfo(np.int64).max
ROOM = 1e-9                # for rounding, in bounds alone

VECTORS = "k bigint, v binary, n int, square bigint"
QUERIES = VECTORS + ", query bigint, least bigint"
VECTORS_NAMES = ["k", "v", "n", "square"]


def _whole(scale: int):
    def work(batches):
        for batch in batches:
            rows, lengths, values = integer_rows(batch, "v", scale)
            ends = np.cumsum(lengths)
            total = np.concatenate(([0], np.cumsum(values * values)))
            packed = [values[e - n:e].astype("<i4").tobytes() for e, n in zip(ends.tolist(), lengths.tolist())]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(rows)), pa.array(packed, pa.binary()), pa.array(lengths, pa.int32()),
                 pa.array(total[ends] - total[ends - lengths], pa.int64())], names=["k", "v", "n", "square"])
    return work


def _matrix(packed: list[bytes], width: int) -> np.ndarray:
    """Vectors as rows of ``width`` whole numbers, cut or filled up with zeros."""
    out = np.zeros((len(packed), width), dtype=np.int64)
    sizes = {len(p) for p in packed}
    if len(sizes) == 1:
        n = sizes.pop() // 4
        values = np.frombuffer(b"".join(packed), dtype="<i4").reshape(len(packed), n)
        out[:, :min(n, width)] = values[:, :width]
        return out
    for row, p in zip(out, packed):
        values = np.frombuffer(p, dtype="<i4")[:width]
        row[:len(values)] = values
    return out


class Slot:
    """Vectors by falling length, and the lists that prune them."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, squares: np.ndarray):
        order = np.argsort(-squares, kind="stable")
        self.ids, self.vectors, squares = ids[order], vectors[order], squares[order]
        self.lengths = np.sqrt(squares.astype(np.float64))
        self.largest = int(np.abs(vectors).max(initial=0))
        self.doubles = self.vectors.astype(np.float64)
        self.lists: dict[int, tuple[np.ndarray, np.ndarray]] = {}

    def products(self, queries: np.ndarray, rows: slice | np.ndarray) -> np.ndarray:
        """Exact products; as doubles where no sum can leave their whole numbers."""
        if self.largest * int(np.abs(queries).max(initial=0)) * max(1, queries.shape[1]) < 1 << 53:
            return (queries.astype(np.float64) @ self.doubles[rows].T).astype(np.int64)
        return queries @ self.vectors[rows].T

    def direction(self, f: int, rows: np.ndarray | slice = slice(None)) -> np.ndarray:
        return self.doubles[rows, f] / np.maximum(self.lengths[rows], 1e-300)

    def listed(self, f: int) -> tuple[np.ndarray, np.ndarray]:
        if f not in self.lists:
            values = self.direction(f)
            order = np.argsort(values, kind="stable")
            self.lists[f] = (order, values[order])
        return self.lists[f]

    def by_coordinates(self, query: np.ndarray, length: float, least: int, cosine: float) -> np.ndarray:
        """Rows that can reach a cosine of ``cosine``, by the query's largest coordinates."""
        q = query / length
        cosine = min(cosine, 1.0)
        focus = np.argsort(-np.abs(q))[:FOCUS]
        away = np.sqrt((1 - cosine * cosine) * np.maximum(1 - q[focus] ** 2, 0))
        low = np.where(q[focus] < -cosine, -1.0, q[focus] * cosine - away) - ROOM
        high = np.where(q[focus] > cosine, 1.0, q[focus] * cosine + away) + ROOM
        spans = []
        for f, a, b in zip(focus.tolist(), low, high):
            values = self.listed(f)[1]
            spans.append((int(np.searchsorted(values, a)), int(np.searchsorted(values, b, side="right"))))
        first = min(range(len(spans)), key=lambda i: spans[i][1] - spans[i][0])
        rows = self.listed(int(focus[first]))[0][slice(*spans[first])]
        for i, f in enumerate(focus.tolist()):
            if i != first:
                values = self.direction(f, rows)
                rows = rows[(values >= low[i]) & (values <= high[i])]
        return rows[self.lengths[rows] * length >= least * (1 - ROOM)]

    def best(self, score: np.ndarray, rows: np.ndarray, k: int) -> np.ndarray:
        """Places of the ``k`` best, ties to the smaller id (a null one is the largest)."""
        if len(score) > k:
            last = np.partition(score, len(score) - k)[len(score) - k]
            at = np.flatnonzero(score >= last)
        else:
            at = np.arange(len(score))
        return at[np.lexsort((self.ids[rows[at]], -score[at]))][:k]

    def search(self, ids: np.ndarray, queries: np.ndarray, lengths: np.ndarray, least: np.ndarray, known: np.ndarray,
               k: int):
        """``(query, ids, scores)`` of the best for every query, and by which list they
        were pruned: nothing, ``"length"`` or ``"coordinate"``."""
        local = np.where(known & (least > 0), least / np.maximum(lengths * self.lengths[0], 1e-300), 0.0)
        by_length = []
        for i in np.flatnonzero(local <= 1 + ROOM).tolist():
            if local[i] < COORDINATES or not queries.shape[1]:
                by_length.append(i)
                continue
            rows = self.by_coordinates(queries[i], lengths[i], int(least[i]), local[i] * (1 - ROOM))
            rows = rows[self.ids[rows] != ids[i]]
            score = self.products(queries[i:i + 1], rows)[0]
            yield i, *self._found(score, rows, least[i], True, k), "coordinate"
        # queries whose prefixes are of like length share a block of products
        reach = np.full(len(ids), len(self.ids))
        for i in by_length:
            if local[i] > 0:
                reach[i] = np.searchsorted(-self.lengths, -(least[i] / lengths[i]) * (1 - ROOM), side="right")
        by_length.sort(key=lambda i: reach[i])
        size = max(1, BLOCK_BYTES // (8 * len(self.ids)))
        for at in range(0, len(by_length), size):
            block = by_length[at:at + size]
            every = np.arange(reach[block[-1]])
            scores = self.products(queries[block], slice(0, len(every)))
            for i, score in zip(block, scores):
                rows = np.flatnonzero(self.ids[:reach[i]] != ids[i])
                yield i, *self._found(score[rows], rows, least[i], known[i], k), "length"

    def _found(self, score, rows, least, known, k):
        if known:
            enough = score >= least
            score, rows = score[enough], rows[enough]
        at = self.best(score, rows, k)
        return self.ids[rows[at]], score[at]


def _ids(batch: pa.RecordBatch) -> np.ndarray:
    return np.asarray(batch.column(batch.schema.get_field_index("k")).fill_null(NONE))


def _bounded(seeds: list[tuple], k: int):
    """Queries with the k-th best of their scores among the seeds."""
    ids = np.array([NONE if s[0] is None else s[0] for s in seeds], dtype=np.int64)
    width = max((len(s[1]) for s in seeds), default=0) // 4
    slot = Slot(ids, _matrix([s[1] for s in seeds], width), np.array([s[2] for s in seeds], dtype=np.int64)) if seeds else None

    def work(batches):
        for batch in batches:
            own = _ids(batch)
            bounds = [None] * len(own)
            packed = batch.column(1).to_pylist()
            for at in range(0, len(own), 1024) if slot else ():
                scores = slot.products(_matrix(packed[at:at + 1024], width), slice(None))
                for i, (score, me) in enumerate(zip(scores, own[at:at + 1024]), at):
                    score = score[slot.ids != me]
                    if len(score) >= k:
                        bounds[i] = int(np.partition(score, len(score) - k)[len(score) - k])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(bounds, pa.int64())],
                                             names=[*batch.schema.names, "least"])
    return work


def _searched(k: int):
    """A slot's vectors come before its queries. They are held, the queries stream."""
    def work(batches):
        held, slot, at = [], None, None
        for batch in batches:
            numbers = np.asarray(batch.column(batch.schema.get_field_index("slot")))
            asks = np.asarray(batch.column(batch.schema.get_field_index("query")).is_valid())
            edges = np.flatnonzero((np.diff(numbers) != 0) | (np.diff(asks) != 0)) + 1
            for a, b in zip([0, *edges.tolist()], [*edges.tolist(), len(numbers)]):
                part = batch.slice(a, b - a)
                if numbers[a] != at:
                    held, slot, at = [], None, numbers[a]
                ids, packed = _ids(part), part.column(part.schema.get_field_index("v")).to_pylist()
                squares = np.asarray(part.column(part.schema.get_field_index("square")))
                if not asks[a]:
                    held.append((ids, packed, squares))
                    continue
                if slot is None and held:
                    packs = [p for h in held for p in h[1]]
                    slot = Slot(np.concatenate([h[0] for h in held]), _matrix(packs, max(map(len, packs)) // 4),
                                np.concatenate([h[2] for h in held]))
                    held = []
                if slot is None:        # a slot that no vector was dealt to
                    continue
                query = np.asarray(part.column(part.schema.get_field_index("query")))
                least = part.column(part.schema.get_field_index("least"))
                known, least = np.asarray(least.is_valid()), np.asarray(least.fill_null(0))
                step = max(1, SLOT_BYTES // (8 * max(1, slot.vectors.shape[1])))
                for c in range(0, len(ids), step):
                    own = slice(c, c + step)
                    out = ([], [], [], [])
                    for i, near, score, _ in slot.search(ids[own], _matrix(packed[own], slot.vectors.shape[1]),
                                                         np.sqrt(squares[own].astype(np.float64)), least[own], known[own], k):
                        out[0].append(np.full(len(near), query[c + i]))
                        out[1].append(np.full(len(near), ids[c + i]))
                        out[2].append(near)
                        out[3].append(score)
                    if out[0]:
                        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x), pa.int64()) for x in out],
                                                         names=["query", "query_id", "near", "score"])
    return work


def top_k(df: DataFrame, vector: str = "embedding", key: str = "vec_id", k: int = K, every: int = EVERY,
          scale: int = SCALE, slot_bytes: int = SLOT_BYTES) -> DataFrame:
    """``query_id, rank, vec_id, score``: for every row whose id ``every`` divides, the
    ``k`` other rows of the highest products."""
    spark = df.sparkSession
    own = df.select(F.col(key).cast("bigint").alias("k"), F.col(vector).alias("v"))
    own = written(own.mapInArrow(_whole(scale), VECTORS), "vectors")
    width = F.when(F.col("n") < 2, 0).otherwise(F.ceil(F.log2(F.col("n").cast("double")))).cast("int")
    cuts = own.agg(F.percentile_approx("square", [i / RANGES for i in range(1, RANGES)])).first()[0] or []  # RANGES values
    place = sum((F.when(F.col("square") > c, 1).otherwise(0) for c in sorted(set(cuts))), F.lit(0))
    placed = own.withColumn("bucket", F.struct(place.alias("r"), width.alias("w")))
    # a row for each range and width: some hundreds at most
    facts = placed.groupBy("bucket").agg(F.max("square").alias("square"), F.max("n").alias("n"),
                                         F.sum(F.greatest(F.col("n"), F.lit(1)).cast("bigint") * 8).alias("bytes")) \
        .orderBy(F.desc("square"), "bucket").collect()
    first, table = 0, []
    for f in facts:
        slots = -(-f.bytes // slot_bytes)
        table.append((f.bucket.r, f.bucket.w, float(f.square), first, slots))
        first += slots
    widest = max((f.n for f in facts), default=0)
    seeds = max(k + 1, min(SEEDS, SEED_BYTES // (4 * max(1, widest))))
    longest = [(r.k, bytes(r.v), r.square) for r in own.orderBy(F.desc("square"), "k", "v").limit(seeds).collect()]

    listed = spark.createDataFrame(table, "r int, w int, most double, first bigint, slots bigint")
    dealt = placed.join(F.broadcast(listed), (F.col("bucket.r") == F.col("r")) & (F.col("bucket.w") == F.col("w")))
    rows = dealt.select(
        (F.col("first") + F.pmod(F.monotonically_increasing_id(), F.col("slots"))).alias("slot"),
        *VECTORS_NAMES, F.lit(None).cast("bigint").alias("query"), F.lit(None).cast("bigint").alias("least"))

    asked = own.where(F.col("k") % every == 0).withColumn("query", F.monotonically_increasing_id())
    asked = asked.mapInArrow(_bounded(longest, k), QUERIES)
    buckets = F.array(*[F.struct(F.lit(t[2]).alias("most"), F.lit(t[3]).cast("bigint").alias("first"),
                                 F.lit(t[4]).cast("bigint").alias("slots")) for t in table])
    bound = F.col("least").cast("double")
    open_ = F.filter(buckets, lambda b: F.coalesce(bound <= 0, F.lit(True))
                     | (bound * bound <= F.col("square").cast("double") * b["most"] * (1 + ROOM)))
    slots = F.flatten(F.transform(open_, lambda b: F.sequence(b["first"], b["first"] + b["slots"] - 1)))
    asked = asked.select(F.explode(slots).alias("slot"), *VECTORS_NAMES, "query", "least") if table else rows
    parts = max(1, min(first, 4 * max(int(spark.conf.get("spark.sql.shuffle.partitions")),
                                      spark.sparkContext.defaultParallelism)))
    met = rows.unionByName(asked).repartitionById(parts, F.pmod("slot", F.lit(parts)).cast("int")) \
        .sortWithinPartitions("slot", F.col("query").isNotNull())
    found = met.mapInArrow(_searched(k), "query bigint, query_id bigint, near bigint, score bigint")
    order = Window.partitionBy("query").orderBy(F.desc("score"), "near")
    ranked = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", F.when(F.col("near") != NONE, F.col("near")).alias("vec_id"), "score")

