"""Operators 11 and 12 against brute force."""

import hashlib
import math
import random

import numpy as np
import pytest

from funnelkit.llm.clusters import Centroids, centroid_clusters
from funnelkit.llm.topk import Slot, top_k

SF = "/root/testdata/sf0.001"
SCHEMA = "vec_id bigint, embedding array<float>, label int, cluster int, k string, score bigint, `row` int, distance string"


def embeddings(spark):
    return spark.read.parquet(f"{SF}/embeddings.parquet")


def odd_vectors(spark, dim=64, n=90, seed=5):
    """Nulls in any column, wrong lengths, odd components, ties, repeated rows and clashing names."""
    rnd = random.Random(seed)
    rows = [(i, [rnd.gauss(0, 1) * (1 + i % 7) for _ in range(dim)]) for i in range(n)]
    rows += [(n + i, rows[3][1]) for i in range(20)]                      # copies under ids of their own
    rows += [rows[5], rows[5], (None, rows[7][1]), (None, None), (None, [1.0] * dim)]
    rows += [(500, None), (501, []), (502, [1.0] * (dim - 1)), (503, [0.5] * (dim + 1)), (504, [None] * dim),
             (505, [float("nan")] + [0.0] * (dim - 1)), (506, [float("inf")] * dim), (507, [3e38] * dim),
             (508, [0.0] * dim), (509, [-0.0] * dim), (510, [-1e-30] * dim), (511, [60000.0] * dim), (550, [0.0] * dim)]
    return spark.createDataFrame([(i, v, None, 1, "x", 2, 3, "y") for i, v in rows], SCHEMA)


def whole(vector, scale):
    """The vector in whole numbers, or None where it takes no part."""
    if vector is None or any(x is None or not math.isfinite(x) for x in vector):
        return None
    out = [math.floor(scale * x) for x in vector]
    return None if any(abs(x) > 1 << 24 for x in out) else out


def lloyd(rows, k=16, rounds=3, dim=64):
    kept = [(i, w) for i, v in rows if (w := whole(v, 64)) is not None and len(w) == dim]
    hashed = sorted(kept, key=lambda r: (r[0] is None, hashlib.sha256(f"1:{r[0]}".encode()).hexdigest(), r[1]))
    points, x = np.array([w for _, w in hashed[:k]]), np.array([w for _, w in kept])
    for _ in range(rounds):
        which = ((x[:, None] - points[None]) ** 2).sum(-1).argmin(1)
        for c in set(which.tolist()):
            points[c] = x[which == c].sum(0) // (which == c).sum()
    far = ((x[:, None] - points[None]) ** 2).sum(-1)
    which, best = far.argmin(1), far.min(1)
    sha = [hashlib.sha256(",".join(map(str, p)).encode()).hexdigest() for p in points.tolist()]
    return sorted([(i, c, int(d), int(best[which == c].sum()), int(best.sum()), sha[c])
                   for (i, _), c, d in zip(kept, which.tolist(), best)], key=repr)


@pytest.mark.parametrize("frame,args", [(embeddings, {}), (odd_vectors, {}), (odd_vectors, {"k": 150, "rounds": 2}),
                                        (odd_vectors, {"k": 1}), (odd_vectors, {"dim": 65})])
def test_clusters_equal_lloyd(spark, frame, args):
    df = frame(spark)
    got = centroid_clusters(df, **args)
    assert got.columns == ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]
    want = lloyd([(r.vec_id, r.embedding) for r in df.collect()], **args)
    assert sorted(map(tuple, got.collect()), key=repr) == want and len(want) > 0


def test_clusters_of_nothing(spark):
    assert centroid_clusters(odd_vectors(spark).limit(0)).count() == 0
    assert centroid_clusters(odd_vectors(spark), dim=7).count() == 0


def test_inequalities_spare_distances_and_ties_go_to_the_smaller_number():
    rnd = np.random.default_rng(2)
    centres = rnd.integers(-400, 400, (64, 1)) + rnd.integers(-20, 20, (64, 16)) * rnd.integers(1, 9, (64, 1))
    x = centres[rnd.integers(0, 64, 3000)] + rnd.integers(-3, 4, (3000, 16))
    which, best, measured = Centroids(centres).nearest(x)
    far = ((x[:, None] - centres[None]) ** 2).sum(-1)
    assert (which == far.argmin(1)).all() and (best == far.min(1)).all()
    assert measured < len(x) * len(centres) / 8
    same = np.repeat(rnd.integers(-9, 9, (5, 16)), 4, axis=0)[rnd.permutation(20)]     # equal centroids
    which, best, _ = Centroids(same).nearest(x[:200] % 10)
    far = ((x[:200, None] % 10 - same[None]) ** 2).sum(-1)
    assert (which == far.argmin(1)).all() and (best == far.min(1)).all()


def nearest(rows, k=5, every=50):
    kept = [(i, w) for i, v in rows if (w := whole(v, 256)) is not None]
    out = []
    for q, x in kept:
        if q is None or q % every:
            continue
        scored = [(-sum(a * b for a, b in zip(x, y)), i is None, i or 0, i) for i, y in kept if i != q]
        out += [(q, n, i, -s) for n, (s, _, _, i) in enumerate(sorted(scored)[:k], 1)]
    return sorted(out, key=repr)


def copied(spark, dim=64):
    """A third of all rows are copies of one vector, others stand close to it."""
    rnd = random.Random(9)
    one = [rnd.gauss(0, 1) for _ in range(dim)]
    rows = [(i, one if i % 3 == 0 else [x + rnd.gauss(0, 0.02 if i % 3 == 1 else 1) for x in one]) for i in range(400)]
    return spark.createDataFrame([(i, v, None, 1, "x", 2, 3, "y") for i, v in rows], SCHEMA)


@pytest.mark.parametrize("frame,args", [(embeddings, {}), (odd_vectors, {}), (odd_vectors, {"k": 1, "every": 1}), (copied, {}),
                                        (odd_vectors, {"k": 200, "every": 7}), (copied, {"every": 20, "k": 9})])
@pytest.mark.parametrize("slot_bytes", [4 << 20, 4096])
def test_top_k_equals_brute_force(spark, frame, args, slot_bytes):
    df = frame(spark)
    got = top_k(df, slot_bytes=slot_bytes, **args)
    assert got.columns == ["query_id", "rank", "vec_id", "score"]
    assert sorted(map(tuple, got.collect()), key=repr) == nearest([(r.vec_id, r.embedding) for r in df.collect()], **args)


def test_top_k_of_little(spark):
    assert top_k(odd_vectors(spark).limit(0)).count() == 0
    assert top_k(odd_vectors(spark).where("vec_id = 50")).count() == 0          # no other row
    assert top_k(odd_vectors(spark).where("vec_id in (1, 2)")).count() == 0     # no query
    assert top_k(odd_vectors(spark).where("vec_id in (50, 2)")).count() == 1


def test_pruning_is_chosen_by_the_local_threshold():
    rnd = np.random.default_rng(4)
    x = rnd.integers(-200, 200, (500, 24))
    x[:40] = 2 * x[0] + rnd.integers(-3, 4, (40, 24))
    squares = (x * x).sum(1)
    slot = Slot(np.arange(500), x, squares)
    scores = x[:60] @ x.T
    np.fill_diagonal(scores, np.iinfo(np.int64).min)
    least = np.sort(scores, axis=1)[:, -5]
    least[50:] = squares.max() * 4                                               # nothing reaches that
    found = {i: (ids, score, by) for i, ids, score, by in slot.search(
        np.arange(60), x[:60], np.sqrt(squares[:60].astype(float)), least, np.ones(60, dtype=bool), 5)}
    assert set(found) == set(range(50))
    assert {by for _, _, by in found.values()} == {"coordinate", "length"}
    for i, (ids, score, _) in found.items():
        want = sorted((-s, j) for j, s in enumerate(scores[i].tolist()))[:5]
        assert [(-s, j) for j, s in zip(ids.tolist(), score.tolist())] == want
    # directions outside the angle are left out before any product is made
    some = slot.by_coordinates(x[3], float(np.sqrt(squares[3])), 1, 0.97)
    assert 40 <= len(some) < 250
